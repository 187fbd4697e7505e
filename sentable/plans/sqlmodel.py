"""DuckDB renderings of the expert model (counts, draw chain, loss) for the oracle."""

from __future__ import annotations

from sentable.plans.fixtures import sql_fmt, sql_u

SEP_SQL = "chr(1)"


def text_sql(c: str, kind: str) -> str:
    return sql_fmt(c, kind, "nan" if kind in ("int", "double") else "?")


def ctx_sql(c: str, t: str, kinds: dict, bins: int) -> str:
    if kinds[c] not in ("int", "double"):
        return t
    x = f"TRY_CAST({t} AS DOUBLE)"
    b = (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN -1 WHEN e.hi_{c} = e.lo_{c} THEN 0 ELSE "
         f"greatest(0, least(floor(({x} - e.lo_{c}) / (e.hi_{c} - e.lo_{c}) * {bins}), {bins - 1})) END")
    return f"CAST(CAST({b} AS BIGINT) AS VARCHAR)"


NEXT_LEVEL = 3


def level_ctx(order, j, level, get, kinds, bins):
    if level == 0:
        return "''"
    if level >= NEXT_LEVEL:
        later = order[j + 1 + level - NEXT_LEVEL]
        return ctx_sql(later, get(later), kinds, bins)
    prev = ctx_sql(order[j - 1], get(order[j - 1]), kinds, bins)
    if level == 1:
        return prev
    return f"({ctx_sql(order[0], get(order[0]), kinds, bins)} || {SEP_SQL} || {prev})"


def edges_sql(edge_src: str, cols, kinds) -> str:
    num = [c for c in cols if kinds[c] in ("int", "double")]
    sel = ", ".join([f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in num] or ["1 AS _x"])
    return f"SELECT {sel} FROM ({edge_src})"


def counts_sql(src: str, cols, kinds, orders, bins, edge_src: str | None = None, all_pairs: bool = False) -> str:
    """(order_id, col, level, ctx, value, n) of the fitted model."""
    texts = ", ".join(f"{text_sql(c, kinds[c])} AS t_{c}" for c in cols)
    base = f"(SELECT t.*, e.* FROM (SELECT {texts} FROM ({src})) t, ({edges_sql(edge_src or src, cols, kinds)}) e) e"
    parts = []
    for oid, o in enumerate(orders):
        for j, c in enumerate(o):
            for L in list(range(0, min(j, 2) + 1)) + [NEXT_LEVEL + d for d in range(len(o) - j - 1) if d == 0 or all_pairs]:
                ctx = level_ctx(o, j, L, lambda cc: f"t_{cc}", kinds, bins)
                parts.append(f"SELECT {oid}::BIGINT AS order_id, '{c}' AS col, {L}::BIGINT AS level, {ctx} AS ctx, "
                             f"t_{c} AS value, count(*)::BIGINT AS n FROM {base} GROUP BY ALL")
    return " UNION ALL ".join(parts)


def weighted_sql(counts: str, temperature: float) -> str:
    g = "order_id, col, level, ctx"
    if temperature == 1:
        return counts
    if temperature == 0:
        return (f"SELECT c.* FROM ({counts}) c JOIN (SELECT {g}, first(value ORDER BY n DESC, value) AS top "
                f"FROM ({counts}) GROUP BY ALL) t USING ({g}) WHERE c.value = t.top")
    return (f"SELECT order_id, col, level, ctx, value, greatest(1, round(pow(n::DOUBLE / (max(n) OVER (PARTITION BY {g}))::DOUBLE, "
            f"{1.0 / temperature!r}) * floor(281474976710656.0::DOUBLE / (count(*) OVER (PARTITION BY {g}))::DOUBLE)))::BIGINT AS n "
            f"FROM ({counts})")


def intervals_sql(counts: str) -> str:
    g = "order_id, col, level, ctx"
    order = "substr(md5(CAST(value AS VARCHAR)), 1, 2), n DESC, value"
    run = f"sum(n) OVER (PARTITION BY {g} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (f"SELECT {g}, value, ({run} - n)::BIGINT AS lo, ({run})::BIGINT AS hi, "
            f"(sum(n) OVER (PARTITION BY {g}))::BIGINT AS total FROM ({counts})")


def chain_sql(keys: str, order, oid, kinds, bins, seed, attempt=0, key="sid", given: dict | None = None,
              iv: str = "iv", e: str = "e") -> str:
    """Draw every column of ``order`` for the rows of ``keys`` (no back-off:
    callers use it where every context exists)."""
    given = given or {}
    cur = f"(SELECT k.*{''.join(f', {v} AS {c}' for c, v in given.items())} FROM ({keys}) k)"
    for j, c in enumerate(order):
        if c in given:
            continue
        L = min(j, 2)
        ctx = level_ctx(order, j, L, lambda cc: f"s.{cc}", kinds, bins)
        u = sql_u(seed, f"'draw:{attempt}:{oid}:{c}'", f"s.{key}")
        r = f"floor({u} * iv.total)"
        cur = (f"(SELECT s.*, iv.value AS {c} FROM {cur} s CROSS JOIN {e} JOIN {iv} iv ON iv.order_id = {oid} "
               f"AND iv.col = '{c}' AND iv.level = {L} AND iv.ctx = {ctx} AND iv.lo <= {r} AND {r} < iv.hi)")
    return cur


def model_ctes(src: str, cols, kinds, orders, bins, temperature=1.0, edge_src: str | None = None,
               drop_nan_numbers: bool = False, all_pairs: bool = False) -> str:
    cnt = counts_sql(src, cols, kinds, orders, bins, edge_src, all_pairs)
    if drop_nan_numbers:
        num = ", ".join(f"'{c}'" for c in cols if kinds[c] in ("int", "double"))
        cnt = f"SELECT * FROM ({cnt}) WHERE NOT (col IN ({num}) AND value = 'nan')"
    return (f"e AS ({edges_sql(edge_src or src, cols, kinds)}), cnt AS ({cnt}), "
            f"iv AS ({intervals_sql(weighted_sql('SELECT * FROM cnt', temperature))})")


def eval_sql(val: str, cols, kinds, order, bins, key="row_key", cnt_name: str = "cnt", e_name: str = "e") -> str:
    """Per-column mean NLL with add-one smoothing and level back-off."""
    texts = ", ".join(f"{text_sql(c, kinds[c])} AS t_{c}" for c in cols)
    vb = f"(SELECT v.*, ee.* FROM (SELECT {key}, {texts} FROM ({val})) v, {e_name} ee)"
    parts = []
    for j, c in enumerate(order):
        cs = [level_ctx(order, j, L, lambda cc: f"t_{cc}", kinds, bins) if L <= min(j, 2) else "NULL::VARCHAR"
              for L in range(3)]
        parts.append(f"SELECT {key}, '{c}' AS col, t_{c} AS value, {cs[0]} AS c0, {cs[1]} AS c1, {cs[2]} AS c2 FROM {vb} e")
    cells = " UNION ALL ".join(parts)
    tot = f"SELECT col, level, ctx, sum(n) AS tot FROM {cnt_name} WHERE order_id = 0 GROUP BY ALL"
    voc = f"SELECT col, count(*) + 1 AS V FROM {cnt_name} WHERE order_id = 0 AND level = 0 GROUP BY col"
    lv = (f"SELECT x.*, CASE WHEN t2.tot IS NOT NULL THEN 2 WHEN t1.tot IS NOT NULL THEN 1 ELSE 0 END AS level, "
          f"CASE WHEN t2.tot IS NOT NULL THEN c2 WHEN t1.tot IS NOT NULL THEN c1 ELSE '' END AS ctx, "
          f"coalesce(CASE WHEN t2.tot IS NOT NULL THEN t2.tot WHEN t1.tot IS NOT NULL THEN t1.tot ELSE t0.tot END, 0) AS tot "
          f"FROM ({cells}) x LEFT JOIN ({tot}) t0 ON t0.col = x.col AND t0.level = 0 AND t0.ctx = x.c0 "
          f"LEFT JOIN ({tot}) t1 ON t1.col = x.col AND t1.level = 1 AND t1.ctx = x.c1 "
          f"LEFT JOIN ({tot}) t2 ON t2.col = x.col AND t2.level = 2 AND t2.ctx = x.c2")
    sc = (f"SELECT l.col, -ln((coalesce(c.n, 0) + 1)::DOUBLE / (l.tot + v.V)::DOUBLE) AS nll FROM ({lv}) l "
          f"LEFT JOIN (SELECT * FROM {cnt_name} WHERE order_id = 0) c ON c.col = l.col AND c.level = l.level AND c.ctx = l.ctx "
          f"AND c.value = l.value JOIN ({voc}) v ON v.col = l.col")
    per = f"SELECT col, avg(nll) AS loss FROM ({sc}) GROUP BY col"
    return (f"SELECT col AS \"column\", round(loss, 6) AS loss FROM ({per}) UNION ALL "
            f"SELECT '__mean__' AS \"column\", round(avg(loss), 6) AS loss FROM ({per})")


def complete_sql(src: str, order, kinds, bins, seed, attempt=0, key="sid") -> str:
    """Back-off completion: ``src`` has ``key`` and g_<col> (given text or
    NULL); every column is drawn at the highest level whose context exists
    and the given value wins.  Needs CTEs e, iv and grp."""
    cur = f"(SELECT * FROM ({src}))"
    for j, c in enumerate(order):
        levels = list(range(0, min(j, 2) + 1))
        ks = {L: level_ctx(order, j, L, lambda cc: f"s.{cc}", kinds, bins) for L in levels}
        free = f"s.g_{order[j - 1]} IS NULL" if j else "true"
        for d, g in enumerate(order[j + 1:]):
            levels.append(NEXT_LEVEL + d)
            ks[NEXT_LEVEL + d] = (f"CASE WHEN {free} AND s.g_{g} IS NOT NULL THEN "
                                  f"{level_ctx(order, j, NEXT_LEVEL + d, lambda cc: f's.g_{cc}', kinds, bins)} END")
            free += f" AND s.g_{g} IS NULL"
        u = sql_u(seed, f"'draw:{attempt}:0:{c}'", f"s.{key}")
        joins = " ".join(f"LEFT JOIN grp g{L} ON g{L}.order_id = 0 AND g{L}.col = '{c}' AND g{L}.level = {L} "
                         f"AND g{L}.ctx = {ks[L]}" for L in levels)
        hi_first = sorted(levels, reverse=True)
        lvl = "CASE " + " ".join(f"WHEN g{L}.total IS NOT NULL THEN {L}" for L in hi_first) + " END"
        ctx = "CASE " + " ".join(f"WHEN g{L}.total IS NOT NULL THEN {ks[L]}" for L in hi_first) + " END"
        tot = "CASE " + " ".join(f"WHEN g{L}.total IS NOT NULL THEN g{L}.total" for L in hi_first) + " END"
        inner = f"(SELECT s.*, {lvl} AS _lvl, {ctx} AS _ctx, {tot} AS _tot, {u} AS _u FROM {cur} s CROSS JOIN e {joins})"
        r = "floor(i._u * i._tot)"
        cur = (f"(SELECT i.* EXCLUDE (_lvl, _ctx, _tot, _u), coalesce(i.g_{c}, iv.value) AS {c} FROM {inner} i "
               f"LEFT JOIN iv ON iv.order_id = 0 AND iv.col = '{c}' AND iv.level = i._lvl AND iv.ctx = i._ctx "
               f"AND iv.lo <= {r} AND {r} < iv.hi)")
    return f"SELECT {key}, {', '.join(order)} FROM {cur}"


GRP_CTE = "grp AS (SELECT order_id, col, level, ctx, max(total) AS total FROM iv GROUP BY ALL)"
