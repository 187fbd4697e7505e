"""DuckDB renderings of the parse rules, for the oracle SQL."""

from __future__ import annotations


def _lst(cols):
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


def valid_pieces(line_sql: str, cols: list[str], terminated: bool = False) -> str:
    parts = f"string_split({line_sql}, '<EOC>')"
    if terminated:
        parts = f"list_slice({parts}, 1, len({parts}) - 1)"
    return (f"list_filter(list_transform({parts}, lambda p: string_split(p, ' ')), "
            f"lambda w: len(w) = 3 AND list_contains({_lst(cols)}, w[1]))")


def strict_select(src: str, cols: list[str], keep: list[str], line: str = "line", terminated: bool = False,
                  keep_failed: bool = False) -> str:
    fields = ", ".join(f"list_filter(v, lambda w: w[1] = '{c}')[1][3] AS {c}" for c in cols)
    inner = (f"SELECT {', '.join(keep + [fields])} FROM "
             f"(SELECT {', '.join(keep)}, {valid_pieces(line, cols, terminated)} AS v FROM ({src}))")
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    if keep_failed:
        outs = ", ".join(f"CASE WHEN {ok} THEN {c} END AS {c}" for c in cols)
        return f"SELECT {', '.join(keep)}, {outs} FROM ({inner})"
    return f"SELECT * FROM ({inner}) WHERE {ok}"


def flags_select(src: str, cols: list[str], keep: list[str], line: str = "line") -> str:
    """Parsed columns + _complete flag (failed fields stay as found)."""
    fields = ", ".join(f"list_filter(v, lambda w: w[1] = '{c}')[1][3] AS {c}" for c in cols)
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT *, ({ok}) AS _complete FROM (SELECT {', '.join(keep + [fields])} FROM "
            f"(SELECT {', '.join(keep)}, {valid_pieces(line, cols)} AS v FROM ({src})))")


def lenient_select(src: str, cols: list[str], keep: list[str], text: str = "text") -> str:
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    feats = f"list_transform(string_split({text}, ','), lambda f: string_split(trim(f, {ws}), ' is '))"
    fields = ", ".join(
        f"nullif(coalesce(list_filter(ft, lambda w: w[1] = '{c}' AND len(w) >= 2)[1][2], 'placeholder'), 'None') AS {c}"
        for c in cols)
    return f"SELECT {', '.join(keep + [fields])} FROM (SELECT {', '.join(keep)}, {feats} AS ft FROM ({src}))"


def clean_sql(c: str) -> str:
    """strip_bos(fix_question_mark(clean_text(c)))."""
    ct = f"replace(replace(replace({c}, '<|endoftext|>', ''), chr(10), ' '), chr(13), '')"
    return f"regexp_replace(regexp_replace({ct}, 'is\\?', 'is ?', 'g'), '^(<BOS>)+', '')"
