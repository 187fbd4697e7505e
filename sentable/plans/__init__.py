"""Composed jobs and the registry of named queries (Spark builders + oracle SQL)."""

from sentable.plans.registry import ORACLE, QUERIES


def load_all():
    # Importing the query modules registers their queries.
    from sentable.plans import q_text  # noqa: F401
    for mod in ("q_prep", "q_dist", "q_tokens", "q_model", "q_pairs", "q_io"):
        try:
            __import__(f"sentable.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"sentable.plans.{mod}":
                raise
    return QUERIES, ORACLE
