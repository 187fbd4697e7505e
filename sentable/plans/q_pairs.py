"""Queries of the pair models: quantile edges, mutual information, trees, orders, joint imputation, token walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.operators import pairs as P
from sentable.operators import quantiles as Q
from sentable.operators import walk as W
from sentable.operators.tokens import PIECE_RE
from sentable.plans.fixtures import FIXTURES, Fixture, load, sql_fmt, sql_load, sql_u
from sentable.plans.q_prep import SEED
from sentable.plans.registry import query
from sentable.plans.sqlmodel import text_sql

BINS = 20
B, C, D = FIXTURES["B"], FIXTURES["C"], FIXTURES["D"]


def _numeric(fx: Fixture) -> list[str]:
    return [c for c in fx.cols if fx.kinds[c] in ("int", "double")]


def nodes_ctes(src: str, numeric: list[str]) -> str:
    """x0 ... nodes(col, lo, hi, n): every number with its cells at all levels, and the first that is not cut again."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM ({src}) WHERE {c} IS NOT NULL "
                              f"AND isfinite(CAST({c} AS DOUBLE))" for c in numeric)
    levels = range(1, Q.LEVELS + 1)
    cells = ", ".join(f"least(floor(f * {float(1 << Q.WAYS_BITS * k)!r}::DOUBLE), {(1 << Q.WAYS_BITS * k) - 1}) AS c{k}" for k in levels)
    sizes = ", ".join(f"count(*) OVER w{k} AS n{k}, min(x) OVER w{k} AS lo{k}, max(x) OVER w{k} AS hi{k}" for k in levels)
    windows = ", ".join(f"w{k} AS (PARTITION BY col, c{k})" for k in levels)
    level = "CASE " + " ".join(f"WHEN NOT (n{k} > lim AND lo{k} < hi{k}) THEN {k}" for k in levels[:-1]) + f" ELSE {Q.LEVELS} END"
    cell = "CASE lev " + " ".join(f"WHEN {k} THEN c{k}" for k in levels) + " END"
    return f"""x0 AS ({rows}),
x1 AS (SELECT col, x, lim, CASE WHEN hi0 > lo0 THEN (x - lo0) / (hi0 - lo0) ELSE 0.0 END AS f FROM (
  SELECT *, min(x) OVER (PARTITION BY col) AS lo0, max(x) OVER (PARTITION BY col) AS hi0,
         count(*) OVER (PARTITION BY col) // {Q.ACCURACY} AS lim FROM x0)),
x2 AS (SELECT *, {cells} FROM x1),
x3 AS (SELECT *, {sizes} FROM x2 WINDOW {windows}),
x4 AS (SELECT *, {level} AS lev FROM x3),
nodes AS MATERIALIZED (SELECT col, min(x) AS lo, max(x) AS hi, count(*)::BIGINT AS n FROM x4 GROUP BY col, lev, {cell}),
ranked AS (SELECT *, (sum(n) OVER (PARTITION BY col ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before,
  (sum(n) OVER (PARTITION BY col))::BIGINT AS total FROM nodes),
edges AS MATERIALIZED (SELECT col, min(b)::BIGINT AS b, edge, rank, total FROM (
  SELECT col, b, first(lo ORDER BY lo) AS edge, first(before ORDER BY lo) AS rank, first(total) AS total
  FROM ranked, range(1, {BINS}) r(b) WHERE before * {BINS} >= b * total GROUP BY col, b) GROUP BY col, edge, rank, total)"""


def model_ctes(src: str, fx: Fixture) -> str:
    """Adds s (row_key and a symbol a column), singles, pairs, oriented(col, given, value, ctx, n)."""
    numeric = _numeric(fx)

    def symbol(c):
        if c not in numeric:
            return text_sql(c, fx.kinds[c])
        x = f"CAST({c} AS DOUBLE)"
        inner = f"coalesce((SELECT list(edge) FROM edges WHERE col = '{c}'), [])"
        return f"CASE WHEN {c} IS NULL OR isnan({x}) THEN '-1' ELSE CAST(len(list_filter({inner}, lambda e: e <= {x})) AS VARCHAR) END"

    symbols = ", ".join(f"{symbol(c)} AS {c}" for c in fx.cols)
    singles = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS s, count(*)::BIGINT AS n FROM s GROUP BY {c}" for c in fx.cols)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS sa, {b} AS sb, count(*)::BIGINT AS n FROM s GROUP BY {a}, {b}"
                               for k, a in enumerate(fx.cols) for b in fx.cols[k + 1:])
    return f"""{nodes_ctes(src, numeric)},
s AS MATERIALIZED (SELECT row_key, {symbols} FROM ({src})),
singles AS MATERIALIZED ({singles}),
pairs AS MATERIALIZED ({pairs}),
oriented AS (SELECT a AS col, b AS given, sa AS value, sb AS ctx, n FROM pairs UNION ALL
  SELECT b, a, sb, sa, n FROM pairs),
mi AS MATERIALIZED (SELECT p.a, p.b, round(sum(p.n / t.n::DOUBLE * ln(p.n * t.n::DOUBLE / (x.n::DOUBLE * y.n))), 9) AS mi
  FROM pairs p JOIN singles x ON x.col = p.a AND x.s = p.sa JOIN singles y ON y.col = p.b AND y.s = p.sb,
       (SELECT count(*) AS n FROM s) t GROUP BY p.a, p.b)"""


def draw_ctes() -> str:
    """iv: intervals of every (col, given, ctx); given is empty for the column alone."""
    g = "col, given, ctx"
    run = f"sum(n) OVER (PARTITION BY {g} ORDER BY substr(md5(value), 1, 2), n DESC, value ROWS UNBOUNDED PRECEDING)"
    return (f"every AS (SELECT * FROM oriented UNION ALL SELECT col, '' AS given, s AS value, '' AS ctx, n FROM singles), "
            f"iv AS MATERIALIZED (SELECT {g}, value, ({run} - n)::BIGINT AS lo, ({run})::BIGINT AS hi, "
            f"(sum(n) OVER (PARTITION BY {g}))::BIGINT AS total FROM every)")


def tree_ctes(fx: Fixture, root: str) -> str:
    """Prim's steps: e1, e2, ... hold a (parent, column) each."""
    place = ", ".join(f"('{c}', {k})" for k, c in enumerate(fx.cols))
    out = [f"place(col, k) AS (VALUES {place})",
           "pair_mi AS (SELECT x.*, i.k AS ip, j.k AS ic FROM (SELECT a AS p, b AS c, mi FROM mi UNION ALL SELECT b, a, mi FROM mi) x "
           "JOIN place i ON i.col = x.p JOIN place j ON j.col = x.c)",
           f"in0 AS (SELECT ['{root}'] AS inn)"]
    for k in range(1, len(fx.cols)):
        out.append(f"e{k} AS MATERIALIZED (SELECT p, c, inn FROM pair_mi, in{k - 1} WHERE list_contains(inn, p) AND NOT list_contains(inn, c) "
                   f"ORDER BY mi DESC, ip, ic LIMIT 1)")
        out.append(f"in{k} AS (SELECT list_append(inn, c) AS inn FROM e{k})")
    return ", ".join(out)


def tree_rows_ctes(fx: Fixture, root: str, keys: str) -> str:
    """drawn(sid, symbols by column): the rows of ``keys`` (sid), column by column along the tree."""
    u = sql_u(SEED, f"'tree:{root}'", "k.sid")
    out = [f"r0 AS MATERIALIZED (SELECT k.sid, '{root}' AS col, iv.value AS s FROM ({keys}) k JOIN iv ON iv.col = '{root}' AND iv.given = '' "
           f"AND iv.lo <= floor({u} * iv.total) AND floor({u} * iv.total) < iv.hi)"]
    for k in range(1, len(fx.cols)):
        before = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(k))
        u = sql_u(SEED, "'tree:' || e.c", "r.sid")
        out.append(f"r{k} AS MATERIALIZED (SELECT r.sid, e.c AS col, iv.value AS s FROM ({before}) r JOIN e{k} e ON r.col = e.p JOIN iv ON iv.col = e.c "
                   f"AND iv.given = e.p AND iv.ctx = r.s AND iv.lo <= floor({u} * iv.total) AND floor({u} * iv.total) < iv.hi)")
    every = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(len(fx.cols)))
    out.append(f"drawn AS MATERIALIZED (SELECT sid, " + ", ".join(f"max(CASE WHEN col = '{c}' THEN s END) AS {c}" for c in fx.cols)
               + f" FROM ({every}) GROUP BY sid)")
    return ", ".join(out)


BIN_CTES = """binned AS (SELECT n.*, CAST((SELECT count(*) FROM edges e WHERE e.col = n.col AND e.edge <= n.lo) AS VARCHAR) AS bin FROM nodes n),
bins AS MATERIALIZED (SELECT *, (sum(n) OVER (PARTITION BY col, bin ORDER BY lo, hi ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,
  (sum(n) OVER (PARTITION BY col, bin))::BIGINT AS whole FROM binned)"""


def numbers_sql(fx: Fixture, src: str, key: str = "sid", extra: str = "") -> str:
    """Bins of ``src`` become numbers by the inverse CDF."""
    joins, out = "", []
    for c in fx.cols:
        if c not in _numeric(fx):
            out.append(f"d.{c}")
            continue
        u = sql_u(SEED, f"'inside:{c}'", f"d.{key}")
        joins += (f" LEFT JOIN bins b_{c} ON b_{c}.col = '{c}' AND b_{c}.bin = d.{c} AND floor({u} * b_{c}.whole) < b_{c}.upto "
                  f"AND floor({u} * b_{c}.whole) >= b_{c}.upto - b_{c}.n")
        t = f"((floor({u} * b_{c}.whole) - b_{c}.upto + b_{c}.n) / b_{c}.n::DOUBLE)"
        out.append(f"b_{c}.lo + " + (f"floor((b_{c}.hi - b_{c}.lo + 1.0) * {t})" if fx.kinds[c] == "int" else
                                     f"(b_{c}.hi - b_{c}.lo) * {t}") + f" AS {c}")
    return f"SELECT d.{key}{extra}, {', '.join(out)} FROM ({src}) d{joins}"


def _fit(spark, sf, alias, **kw):
    return P.fit(load(spark, sf, alias, key=False, **kw), FIXTURES[alias].cols, BINS)


@query("quantile_edges", f"WITH {nodes_ctes(sql_load('D'), _numeric(D))} SELECT col, b, edge, rank, total FROM edges")
def _quantile_edges(spark, sf):
    """GEN-1: equi-depth edges of ``lineitem``'s numbers from a mergeable sketch, with their exact ranks."""
    return Q.edge_table(Q.sketch(load(spark, sf, "D", key=False)), BINS)


@query("mutual_information", f"WITH {model_ctes(sql_load('D'), D)} SELECT a, b, mi FROM mi")
def _mutual_information(spark, sf):
    """GEN-1: what each column of ``lineitem`` says about each other one, from one scan."""
    return P.mutual_information(_fit(spark, sf, "D"))


_TREE_B = f"WITH {model_ctes(sql_load('B'), B)}, {draw_ctes()}, {tree_ctes(B, B.cols[-1])}"
KEYS_B = f"SELECT row_key AS sid FROM ({sql_load('B')})"


@query("tree_parents", _TREE_B + ", " + "steps AS (" + f"SELECT '{B.cols[-1]}' AS \"column\", NULL::VARCHAR AS parent, 0::BIGINT AS step"
       + "".join(f" UNION ALL SELECT c, p, {k}::BIGINT FROM e{k}" for k in range(1, len(B.cols))) + ") SELECT * FROM steps")
def _tree_parents(spark, sf):
    """GEN-1: the parent of each column, chosen from data."""
    order = P.tree(_fit(spark, sf, "B"))
    return spark.createDataFrame([(c, p, k) for k, (c, p) in enumerate(order)], "`column` string, parent string, step long")


@query("sample_tree", f"{_TREE_B}, {tree_rows_ctes(B, B.cols[-1], KEYS_B)}, {BIN_CTES} {numbers_sql(B, 'SELECT * FROM drawn')}")
def _sample_tree(spark, sf):
    """GEN-3: a new row a key along the tree; numbers by the inverse CDF inside their bins."""
    return P.sample(_fit(spark, sf, "B"), load(spark, sf, "B").select(F.col("row_key").alias("sid")), SEED)


def _sql_any_order():
    hashed = ", ".join(f"{{'h': md5(concat_ws(':', '{SEED}', 'order:{c}', sid)), 'c': '{c}'}}" for c in B.cols)
    ctes = [f"o AS (SELECT sid, list_transform(list_sort([{hashed}]), lambda x: x.c) AS ord FROM ({KEYS_B}))"]
    for k in range(len(B.cols)):
        u = sql_u(SEED, f"'any:' || o.ord[{k + 1}]", "o.sid")
        given, ctx, prev = ("''", "''", "") if k == 0 else (f"o.ord[{k}]", "r.s", f"JOIN r{k - 1} r USING (sid) ")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT o.sid, o.ord[{k + 1}] AS col, iv.value AS s FROM o {prev}JOIN iv ON iv.col = o.ord[{k + 1}] "
                    f"AND iv.given = {given} AND iv.ctx = {ctx} AND iv.lo <= floor({u} * iv.total) AND floor({u} * iv.total) < iv.hi)")
    every = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(B.cols)))
    wide = ", ".join(f"max(CASE WHEN col = '{c}' THEN s END) AS {c}" for c in B.cols)
    ctes.append(f"drawn AS MATERIALIZED (SELECT sid, array_to_string(any_value(ord), ',') AS \"order\", {wide} FROM ({every}) JOIN o USING (sid) GROUP BY sid)")
    inner = numbers_sql(B, "SELECT * FROM drawn", extra=', d."order"')
    return f"WITH {model_ctes(sql_load('B'), B)}, {draw_ctes()}, {', '.join(ctes)}, {BIN_CTES} {inner}"


@query("sample_any_order", _sql_any_order())
def _sample_any_order(spark, sf):
    """GEN-5: each row's columns in an order of its own."""
    return P.sample_any_order(_fit(spark, sf, "B"), load(spark, sf, "B").select(F.col("row_key").alias("sid")), SEED)


def _sql_impute_joint(temperature: float):
    src = sql_load("C", nulls=True)
    missing = {c: f"{c} = '-1'" if c in _numeric(C) else f"{c} = '?'" for c in C.cols}
    given = ", ".join(f"CASE WHEN NOT ({missing[c]}) THEN {c} END AS {c}" for c in C.cols)
    met = " UNION ALL ".join(f"SELECT row_key, '{c}' AS col, '{g}' AS given, {g} AS ctx FROM g WHERE {c} IS NULL AND {g} IS NOT NULL"
                             for c in C.cols for g in C.cols if g != c)
    lost = " UNION ALL ".join(f"SELECT row_key, '{c}' AS col FROM g WHERE {c} IS NULL" for c in C.cols)
    mark = "value <> CASE WHEN col IN (" + ", ".join(f"'{c}'" for c in _numeric(C)) + ") THEN '-1' ELSE '?' END"
    u = sql_u(SEED, "'fill:' || col || ':' || value", "row_key")
    noise = "0.0" if temperature == 0 else f"-ln(-ln((floor({u} * 4503599627370496.0) + 0.5) / 4503599627370496.0)) * {temperature!r}"
    wide = ", ".join(f"max(CASE WHEN col = '{c}' THEN value END) AS {c}" for c in C.cols)
    own = ", ".join(f"coalesce(CASE WHEN NOT isnan(CAST(t.{c} AS DOUBLE)) THEN CAST(t.{c} AS DOUBLE) END, f.{c}) AS {c}" if c in _numeric(C) else
                    f"coalesce({sql_fmt('t.' + c, C.kinds[c])}, f.{c}) AS {c}" for c in C.cols)
    return f"""WITH {model_ctes(src, C)},
g AS MATERIALIZED (SELECT row_key, {given} FROM s),
met AS ({met}), lost AS ({lost}),
kinds AS (SELECT col, count(*) AS k FROM singles GROUP BY col),
lift AS (SELECT row_key, m.col, value, sum(ln((n + {P.SMOOTH}) / {P.SMOOTH})) AS lift FROM met m
  JOIN oriented o ON o.col = m.col AND o.given = m.given AND o.ctx = m.ctx GROUP BY ALL),
base AS (SELECT l.row_key, l.col, x.s AS value, ln(any_value(x.n)) + coalesce(sum(ln({P.SMOOTH}) - ln(x.n + {P.SMOOTH} * k.k)), 0) AS base
  FROM lost l JOIN singles x ON x.col = l.col LEFT JOIN met m ON m.row_key = l.row_key AND m.col = l.col
  LEFT JOIN kinds k ON k.col = m.given GROUP BY l.row_key, l.col, x.s),
scored AS (SELECT row_key, col, value, base + lift AS score FROM base JOIN lift USING (row_key, col, value) UNION ALL
  SELECT row_key, col, value, base FROM base WHERE (row_key, col) NOT IN (SELECT (row_key, col) FROM lift)),
best AS (SELECT row_key, col, arg_max(value, {{'s': round(score + {noise}, 9), 'v': value}}) AS value FROM scored WHERE {mark} GROUP BY ALL),
wide AS (SELECT row_key, {wide} FROM best GROUP BY row_key), {BIN_CTES},
filled AS ({numbers_sql(C, 'SELECT * FROM wide', 'row_key')})
SELECT t.row_key, {own} FROM ({src}) t LEFT JOIN filled f USING (row_key)"""


@query("impute_joint", _sql_impute_joint(1.0))
def _impute_joint(spark, sf):
    """GEN-8: each missing cell of ``customer`` (10 % injected) drawn given all cells of its row."""
    return P.impute(_fit(spark, sf, "C", nulls=True), load(spark, sf, "C", nulls=True), SEED)


@query("impute_best", _sql_impute_joint(0))
def _impute_best(spark, sf):
    """GEN-8 at temperature 0: the best candidate given all cells."""
    return P.impute(_fit(spark, sf, "C", nulls=True), load(spark, sf, "C", nulls=True), SEED, temperature=0)


def _sql_tokens():
    numeric = _numeric(C)
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, s.{c} AS ctx, {sql_fmt('t.' + c, C.kinds[c])} AS value FROM s JOIN ({sql_load('C')}) t "
                               f"USING (row_key) WHERE s.{c} <> '-1'" for c in numeric)
    run = "sum(n) OVER (PARTITION BY col, ctx, pos, shape, token ORDER BY substr(md5(next), 1, 2), n DESC, next ROWS UNBOUNDED PRECEDING)"
    u = sql_u(SEED, "'walk:' || w.col || ':' || w.pos", "w.sid")
    starts = " UNION ALL ".join(f"SELECT sid, '{c}' AS col, {c} AS ctx FROM drawn WHERE {c} <> '-1'" for c in numeric)
    out = ", ".join(f"(SELECT any_value(CAST(v.value AS DOUBLE)) FROM walked v WHERE v.sid = d.sid AND v.col = '{c}') AS {c}"
                    if c in numeric else c for c in C.cols)
    keys = f"SELECT row_key AS sid FROM ({sql_load('C')})"
    return f"""WITH RECURSIVE {model_ctes(sql_load('C'), C)}, {draw_ctes()}, {tree_ctes(C, C.cols[-1])}, {tree_rows_ctes(C, C.cols[-1], keys)},
cells AS ({cells}),
p AS (SELECT col, ctx, list_concat([''], regexp_extract_all(value, '{PIECE_RE}'), ['']) AS p FROM cells),
heads AS (SELECT col, ctx, i - 1 AS pos, list_aggregate(list_filter(p[1:i], lambda t: NOT regexp_matches(t, '{W.DIGITS}')), 'string_agg', '') AS shape,
  p[i] AS token, p[i + 1] AS next, count(*) AS n FROM (
  SELECT col, ctx, p, unnest(range(1, len(p))) AS i FROM p) GROUP BY ALL),
hiv AS MATERIALIZED (SELECT * REPLACE (coalesce(shape, '') AS shape), {run} - n AS lo, {run} AS hi, sum(n) OVER (PARTITION BY col, ctx, pos, shape, token) AS total FROM heads),
walk AS (SELECT sid, col, ctx, 0::BIGINT AS pos, '' AS token, '' AS shape, '' AS value, false AS done FROM ({starts}) UNION ALL
  SELECT w.sid, w.col, w.ctx, w.pos + 1, h.next, CASE WHEN regexp_matches(h.next, '{W.DIGITS}') THEN w.shape ELSE w.shape || h.next END, w.value || h.next, h.next = '' FROM walk w JOIN hiv h ON h.col = w.col AND h.ctx = w.ctx
  AND h.pos = w.pos AND h.shape = coalesce(w.shape, '') AND h.token = w.token AND h.lo <= floor({u} * h.total) AND floor({u} * h.total) < h.hi WHERE NOT w.done),
walked AS MATERIALIZED (SELECT * FROM walk WHERE done)
SELECT sid, {out} FROM drawn d"""


@query("sample_tokens", _sql_tokens())
def _sample_tokens(spark, sf):
    """GEN-2: rows drawn along the tree; their numbers are spelt token by token, given the drawn bin,
    so they need not occur in training."""
    df = load(spark, sf, "C")
    m = P.fit(df.drop("row_key"), C.cols, BINS)
    x = P.draw_symbols(m, df.select(F.col("row_key").alias("sid")), SEED, P.tree(m))
    return W.numbers_by_walk(m, W.fit_heads(W.number_cells(df, m), W.DIGITS), x, SEED)
