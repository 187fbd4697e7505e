"""Start prompts (TXT-6 … TXT-9, SMP-4): the first sentence of a generated row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.hashing import uniform
from sentable.operators.dist import draw_from_one, pick_by_index

START_TAG = "start"


def _probes(keys: DataFrame, seed, key: str, tag: str) -> DataFrame:
    return keys.select(key, uniform(seed, tag, F.col(key)).alias("_u"))


def start_categorical(keys: DataFrame, dist: DataFrame, col: str, seed, key: str = "sid") -> DataFrame:
    """TXT-6 / JN-4: "<col> is <value>" drawn by weight from a (value, n)
    distribution of counts or relative frequencies."""
    d = draw_from_one(_probes(keys, seed, key, START_TAG), dist.select("value", "n"))
    return d.select(key, F.concat(F.lit(col + " is "), F.col("value")).alias("prompt"))


def continuous_list(df: DataFrame, col: str, seed, key: str) -> DataFrame:
    """AGG-2: every value of a float column (nulls kept) with an exact index, written once to the
    checkpoint folder (its length is read apart from it)."""
    from sentable.operators.split import shuffle_index
    from sentable.sources.io import materialize
    return materialize(shuffle_index(df.select(key, F.col(col).alias("value")), seed, F.col(key), tag="list", with_count="n_list"),
                       "list")


def start_continuous(keys: DataFrame, values: DataFrame, col: str, seed, key: str = "sid", places: int = 5) -> DataFrame:
    """TXT-7 / JN-5: uniform pick from the full value list, printed with
    ``places`` decimals (the stored noise is never applied, as in the source)."""
    n = values.agg(F.max("n_list")).first()[0]
    if not n:
        raise ValueError("an empty list of values")
    d = pick_by_index(_probes(keys, seed, key, START_TAG), values, n, value="value", out="_v")
    txt = F.when(F.col("_v").isNull() | F.isnan("_v"), F.lit("nan")).otherwise(F.format_string(f"%.{places}f", F.col("_v")))
    return d.select(key, F.concat(F.lit(col + " is "), txt).alias("prompt"))


def start_random(keys: DataFrame, cols: list[str], seed, key: str = "sid") -> DataFrame:
    """TXT-8: "<random column> is "."""
    i = F.floor(uniform(seed, START_TAG, F.col(key)) * len(cols)).cast("int") + 1
    return keys.select(key, F.concat(F.element_at(F.array(*[F.lit(c) for c in cols]), i), F.lit(" is ")).alias("prompt"))


def start_prompts(keys: DataFrame, cols: list[str], seed, key: str = "sid", start_col: str | None = None,
                  start_dist=None, default: tuple[str, object] | None = None) -> DataFrame:
    """TXT-9: pick the sampler by the distribution's kind.

    ``start_dist`` is ('categorical', DataFrame(value, n)) or
    ('continuous', DataFrame(..., value, idx, n_list)).  A column without a
    distribution, or a distribution without a column, is an error; neither
    given → the fitted default (conditional column and its distribution);
    no default → random column names."""
    if bool(start_col) != (start_dist is not None):
        raise ValueError("start_col and start_dist must be given together")
    if not start_col and default is not None:
        start_col, start_dist = default
    if start_col and start_dist is not None:
        kind, dist = start_dist
        if kind == "categorical":
            return start_categorical(keys, dist, start_col, seed, key)
        if kind == "continuous":
            return start_continuous(keys, dist, start_col, seed, key)
        raise ValueError(f"unknown distribution kind {kind}")
    return start_random(keys, cols, seed, key)


def generation_orders(cols: list[str], cond: str | None, seed, k: int = 4) -> list[list[str]]:
    """SMP-4 (driver side, column names only): K orders with the conditional
    column first and the others in md5(seed:order:k:col) order.  Computed in
    Python because it is a function of the column names alone."""
    import hashlib
    rest = [c for c in cols if c != cond]
    out = []
    for i in range(k):
        key = lambda c, i=i: hashlib.md5(f"{seed}:order:{i}:{c}".encode()).hexdigest()
        out.append(([cond] if cond else []) + sorted(rest, key=key))
    return out


def order_of_rows(keys: DataFrame, cols: list[str], cond: str | None, seed, batch_size: int,
                  key: str = "sid", idx: str = "idx", k: int = 4) -> DataFrame:
    """Rows of batch b use order b mod K; returns (key, order_id, order)."""
    orders = generation_orders(cols, cond, seed, k)
    arr = F.array(*[F.lit(",".join(o)) for o in orders])
    oid = F.pmod(F.floor(F.col(idx) / batch_size), F.lit(k)).cast("int")
    return keys.select(key, oid.cast("long").alias("order_id"), F.element_at(arr, oid + 1).alias("order"))

