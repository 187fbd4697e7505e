"""Queries: expert fit, sampling, evaluation, model IO, synthesis (§2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.operators import experts as X
from sentable.operators import synth as S
from sentable.operators.split import shuffle_index, split
from sentable.operators.starts import continuous_list, start_continuous
from sentable.operators.synth import Contract
from sentable.plans.fixtures import FIXTURES, load, sql_load
from sentable.plans.q_prep import SEED, sql_indexed, sql_split
from sentable.plans.registry import query
from sentable.plans.sqlmodel import chain_sql, counts_sql, eval_sql, model_ctes
from sentable.plans.sqlparse import strict_select
from sentable.sources.io import scratch_path

B = FIXTURES["B"]
BINS = 20
COND = B.labs[0]
KEYS_B = f"SELECT row_key AS sid FROM ({sql_load('B')})"


def _fit_b(spark, sf, **kw):
    return X.fit(load(spark, sf, "B", key=False), B.cols, cond=COND, bins=BINS, **kw)


def _keys(spark, sf):
    return load(spark, sf, "B").select(F.col("row_key").alias("sid"))


_COUNTS_B = counts_sql(sql_load("B"), B.cols, B.kinds, [B.cols], BINS)


@query("fit_experts", _COUNTS_B)
def _fit_experts(spark, sf):
    return _fit_b(spark, sf).counts


def _sample_sql(temperature=1.0, seed=SEED, keys=KEYS_B):
    ctes = model_ctes(sql_load("B"), B.cols, B.kinds, [B.cols], BINS, temperature)
    return f"WITH {ctes} SELECT sid, {', '.join(B.cols)} FROM {chain_sql(keys, B.cols, 0, B.kinds, BINS, seed)}"


@query("sample_fixed", _sample_sql())
def _sample_fixed(spark, sf):
    """GEN-3: one complete row per key, columns in table order."""
    return X.sample(_fit_b(spark, sf), _keys(spark, sf), SEED)


@query("sampled_text", f"WITH {model_ctes(sql_load('B'), B.cols, B.kinds, [B.cols], BINS)} SELECT sid, concat("
                       + ", ".join(f"'{c} is ' || {c} || '<EOC>'" for c in B.cols)
                       + f") AS line FROM {chain_sql(KEYS_B, B.cols, 0, B.kinds, BINS, SEED)}")
def _sampled_text(spark, sf):
    """GEN-14: generated lines, one sentence per column in generation order."""
    m = _fit_b(spark, sf)
    return X.sampled_lines(X.sample(m, _keys(spark, sf), SEED), m)


@query("sample_greedy", _sample_sql(temperature=0))
def _sample_greedy(spark, sf):
    return X.sample(_fit_b(spark, sf), _keys(spark, sf), SEED, temperature=0)


@query("temperature", _sample_sql(temperature=0.7))
def _temperature(spark, sf):
    return X.sample(_fit_b(spark, sf), _keys(spark, sf), SEED, temperature=0.7)


@query("union_batches", f"SELECT * FROM ({_sample_sql(seed=SEED)}) UNION ALL SELECT * FROM ({_sample_sql(seed=SEED + 1)})")
def _union_batches(spark, sf):
    """SET-1: generated batches accumulate by unionByName (duplicates kept)."""
    m = _fit_b(spark, sf)
    t = X.draw_tables(m)
    k = _keys(spark, sf)
    return X.sample(m, k, SEED, tables=t).unionByName(X.sample(m, k, SEED + 1, tables=t))


_COND_ORDER = [COND] + [c for c in B.cols if c != COND]
_LIST_B = (f"SELECT row_key, value, idx, _n AS n_list FROM "
           f"({sql_indexed(f'SELECT row_key, o_totalprice AS value FROM ({sql_load(chr(66))})', SEED, 'list')})")


def _sql_conditional():
    ctes = model_ctes(sql_load("B"), B.cols, B.kinds, [_COND_ORDER], BINS)
    from sentable.plans.fixtures import sql_u
    start = (f"SELECT p.sid, CASE WHEN l.value IS NULL OR isnan(l.value) THEN 'nan' ELSE printf('%.5f', l.value) END AS st "
             f"FROM (SELECT row_key AS sid, {sql_u(SEED, chr(39) + 'start' + chr(39), 'row_key')} AS _u FROM ({sql_load('B')})) p, "
             f"(SELECT max(n_list) AS nl FROM ({_LIST_B})) m JOIN ({_LIST_B}) l ON l.idx = floor(p._u * m.nl)")
    chain = chain_sql(f"SELECT sid, st FROM ({start})", _COND_ORDER, 0, B.kinds, BINS, SEED, given={COND: "k.st"})
    return f"WITH {ctes} SELECT sid, {', '.join(B.cols)} FROM {chain}"


@query("sample_conditional", _sql_conditional())
def _sample_conditional(spark, sf):
    """GEN-4: the first value comes from the start distribution (here the
    fitted default: the conditional column's value list, printed with 5
    decimals); the other columns follow with back-off if needed."""
    df = load(spark, sf, "B")
    m = X.fit(df.drop("row_key"), B.cols, cond=COND, bins=BINS, order="conditional")
    starts = start_continuous(_keys(spark, sf), continuous_list(df, COND, SEED, "row_key"), COND, SEED)
    starts = starts.select("sid", F.substring("prompt", len(COND + " is ") + 1, 1 << 30).alias("_st"))
    return X.sample(m, starts, SEED, given={COND: F.col("_st")}).drop("_st")


def _sql_random_order():
    from sentable.operators.starts import generation_orders
    orders = generation_orders(B.cols, COND, SEED, 4)
    ctes = model_ctes(sql_load("B"), B.cols, B.kinds, orders, BINS)
    idx = f"SELECT sid, idx FROM ({sql_indexed(f'SELECT row_key AS sid FROM ({sql_load(chr(66))})', SEED, 'shuffle', key='sid')})"
    parts = []
    for oid, o in enumerate(orders):
        keys = f"SELECT sid FROM ({idx}) WHERE (idx // 100) % 4 = {oid}"
        parts.append(f"SELECT sid, {', '.join(B.cols)} FROM {chain_sql(keys, o, oid, B.kinds, BINS, SEED)}")
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


@query("sample_random_order", _sql_random_order())
def _sample_random_order(spark, sf):
    """GEN-5: conditional column first, the others in one of K=4 hashed
    orders; rows of batch b (100 rows) use order b mod 4."""
    m = _fit_b(spark, sf, order="random")
    keys = shuffle_index(_keys(spark, sf), SEED, F.col("sid"))
    oid = F.pmod(F.floor(F.col("idx") / 100), F.lit(4))
    return X.sample(m, keys, SEED, order_of=oid).drop("idx")


_SPLIT = sql_split(sql_load("B"))


def _split_part(name):
    return f"SELECT row_key, {', '.join(B.cols)} FROM ({_SPLIT}) WHERE split = '{name}'"


@query("eval_loss", "WITH " + model_ctes(_split_part("train"), B.cols, B.kinds, [B.cols], BINS, edge_src=_split_part("train"))
       + " " + eval_sql(_split_part("val"), B.cols, B.kinds, B.cols, BINS))
def _eval_loss(spark, sf):
    """GEN-9: fit on train, loss on val (per column and mean)."""
    from sentable.sources.io import materialize, write_metrics
    s = materialize(split(load(spark, sf, "B"), SEED, F.col("row_key")), "split")
    train = s.filter("split = 'train'").select(*B.cols)
    val = s.filter("split = 'val'").select("row_key", *B.cols)
    # SNK-5: the evaluation result is appended to a metrics table and read back
    path = scratch_path(spark, "metrics")
    write_metrics(X.evaluate(X.fit(train, B.cols, cond=COND, bins=BINS), val), path)
    return spark.read.parquet(path)


def _sql_backoff():
    from sentable.operators.backoff import LEVELS, NO_ONES
    from sentable.plans.sqlmodel import level_ctx, text_sql
    train, val = _split_part("train"), _split_part("val")
    texts = ", ".join(f"{text_sql(c, B.kinds[c])} AS t_{c}" for c in B.cols)
    parts = []
    for j, c in enumerate(B.cols):
        cs = ", ".join((level_ctx(B.cols, j, L, lambda cc: f"t_{cc}", B.kinds, BINS) if L <= min(j, 2) else "NULL::VARCHAR") + f" AS c{L}"
                       for L in range(LEVELS))
        parts.append(f"SELECT '{c}' AS col, t_{c} AS value, {cs} FROM (SELECT v.*, ee.* FROM (SELECT {texts} FROM ({val})) v, e ee) e")
    joins = ""
    p = "CASE WHEN g0.t IS NULL THEN 1.0 WHEN n0.n IS NULL THEN d0.d ELSE (1.0 - d0.d) * (n0.n + 1) / (g0.t + g0.k)::DOUBLE END"
    for L in range(LEVELS):
        joins += (f" LEFT JOIN grp g{L} ON g{L}.col = x.col AND g{L}.level = {L} AND g{L}.ctx = x.c{L}"
                  f" LEFT JOIN cnt n{L} ON n{L}.col = x.col AND n{L}.level = {L} AND n{L}.ctx = x.c{L} AND n{L}.value = x.value"
                  f" LEFT JOIN disc d{L} ON d{L}.col = x.col AND d{L}.level = {L}")
        p = p if L == 0 else (
             f"CASE WHEN g{L}.t IS NOT NULL THEN (greatest(coalesce(n{L}.n, 0) - d{L}.d, 0.0) + d{L}.d * g{L}.k * ({p})) "
             f"/ g{L}.t::DOUBLE ELSE {p} END")
    return (f"WITH {model_ctes(train, B.cols, B.kinds, [B.cols], BINS, edge_src=train)}, "
            f"disc AS (SELECT col, level, CASE WHEN level = 0 THEN (n1 + 1) / (t + 2.0)::DOUBLE WHEN n1 = 0 THEN {NO_ONES!r}::DOUBLE ELSE n1 / (n1 + 2 * n2)::DOUBLE END AS d FROM "
            f"(SELECT col, level, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, sum(n) AS t FROM cnt GROUP BY ALL)), "
            f"grp AS (SELECT col, level, ctx, sum(n) AS t, count(*) AS k FROM cnt GROUP BY ALL), "
            f"per AS (SELECT x.col, avg(-ln({p})) AS loss FROM ({' UNION ALL '.join(parts)}) x{joins} GROUP BY x.col) "
            f"SELECT col AS \"column\", round(loss, 6) AS loss FROM per UNION ALL SELECT '__mean__', round(avg(loss), 6) FROM per")


@query("eval_backoff", _sql_backoff())
def _eval_backoff(spark, sf):
    """GEN-9: the validation loss with interpolated back-off over all levels."""
    from sentable.operators import backoff
    from sentable.sources.io import materialize
    s = materialize(split(load(spark, sf, "B"), SEED, F.col("row_key")), "split")
    model = X.fit(s.filter("split = 'train'").select(*B.cols), B.cols, cond=COND, bins=BINS)
    return backoff.evaluate(model, s.filter("split = 'val'").select(*B.cols))


@query("merge_models", _COUNTS_B)
def _merge_models(spark, sf):
    """GEN-11: fit(train) merged with fit(val ∪ test) under shared edges
    equals fit(all)."""
    df = load(spark, sf, "B")
    edges = X.numeric_edges(df, B.cols)
    from sentable.sources.io import materialize
    s = materialize(split(df, SEED, F.col("row_key")), "split")
    a = X.fit(s.filter("split = 'train'").select(*B.cols), B.cols, cond=COND, bins=BINS, edges=edges)
    b = X.fit(s.filter("split <> 'train'").select(*B.cols), B.cols, cond=COND, bins=BINS, edges=edges)
    return X.merge(a, b).counts


@query("model_roundtrip", _COUNTS_B)
def _model_roundtrip(spark, sf):
    """SNK-6: save counts + attributes, load, same model."""
    path = scratch_path(spark, "model")
    X.save(_fit_b(spark, sf), path)
    m = X.load(spark, path)
    assert m.cols == B.cols and m.bins == BINS
    return m.counts


CANDIDATES = [2, 5, 10, 20, 40, 80]


def _sql_select_best():
    from sentable.plans.sqlmodel import edges_sql
    train, val = _split_part("train"), _split_part("val")
    ctes = [f"e AS ({edges_sql(train, B.cols, B.kinds)})"]
    means = []
    for i, b in enumerate(CANDIDATES):
        ctes.append(f"cnt{i} AS ({counts_sql(train, B.cols, B.kinds, [B.cols], b)})")
        ev = eval_sql(val, B.cols, B.kinds, B.cols, b, cnt_name=f"cnt{i}")
        means.append(f"SELECT {i}::BIGINT AS step, {b}::BIGINT AS bins, "
                     f"(SELECT loss FROM ({ev}) WHERE \"column\" = '__mean__') AS loss")
    ctes.append("m AS (" + " UNION ALL ".join(means) + ")")
    ctes.append("f AS (SELECT *, loss < coalesce(min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING "
                "AND 1 PRECEDING), 'inf'::DOUBLE) AS improved FROM m)")
    ctes.append("g AS (SELECT *, step - max(CASE WHEN improved THEN step END) OVER (ORDER BY step ROWS UNBOUNDED "
                "PRECEDING) AS bad FROM f)")
    ctes.append("h AS (SELECT *, coalesce(max(bad) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
                "PRECEDING), 0) AS prev_bad FROM g)")
    return ("WITH " + ", ".join(ctes) + " SELECT step, bins, loss, step = (SELECT first(step ORDER BY loss, step) "
            "FROM h WHERE prev_bad < 2) AS selected FROM h WHERE prev_bad < 2")


@query("select_best", _sql_select_best())
def _select_best(spark, sf):
    """GEN-10: candidate bin counts, stop after 2 non-improving evaluations,
    keep the best by validation loss (driver loop over a few candidates)."""
    from sentable.operators.select import select_best
    from sentable.sources.io import materialize
    s = materialize(split(load(spark, sf, "B"), SEED, F.col("row_key")), "split")
    train = s.filter("split = 'train'").select(*B.cols)
    val = s.filter("split = 'val'").select("row_key", *B.cols)
    return select_best(train, val, B.cols, COND, CANDIDATES)


def _sql_synth():
    train = _split_part("train")
    ctes = model_ctes(train, B.cols, B.kinds, [B.cols], BINS, edge_src=train)
    keys = f"SELECT row_key AS sid FROM ({train})"
    lines = (f"SELECT sid AS row_key, concat(" + ", ".join(f"'{c} is ' || {c} || '<EOC>'" for c in B.cols)
             + f") AS line FROM {chain_sql(keys, B.cols, 0, B.kinds, BINS, SEED)}")
    parsed = strict_select(lines, B.cols, ["row_key"])
    from sentable.plans.q_text import _sql_in_domain
    ok = _sql_in_domain(parsed, "B", B.ords)
    return (f"WITH {ctes} SELECT row_key AS sid, TRY_CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_orderpriority, "
            f"TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM ({ok})")


def _contract(fx) -> Contract:
    return Contract(fx.ords, fx.nums, fx.labs, fx.task)


def synthesize(spark, sf_dir: str, write_to: str | None = None):
    """GEN-13, the flagship, on ``orders``: as many rows as the training split
    (written only if any row survived)."""
    out = S.synthesize(load(spark, sf_dir, "B"), _contract(B), seed=SEED, bins=BINS)
    if write_to:
        from sentable.sources.io import write_clean
        write_clean(out, write_to)
    return out


query("synthesize", _sql_synth())(synthesize)

N_NEW = 4000
KEYS_N = f"SELECT CAST(range AS VARCHAR) AS sid FROM range({N_NEW})"


@query("sample_n", _sample_sql(keys=KEYS_N))
def _sample_n(spark, sf):
    """SMP-1 / GEN-3: a number of new rows that is not the table's."""
    return X.sample_n(_fit_b(spark, sf), N_NEW, SEED)


def _sql_copies():
    cols = ", ".join(B.cols)
    from sentable.plans.sqlmodel import text_sql
    real = ", ".join(f"{text_sql(c, B.kinds[c])} AS {c}" for c in B.cols)
    return (f"SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (hit)::BIGINT AS n_copies, "
            f"round(count(*) FILTER (hit) / greatest(count(*), 1), 9) AS share FROM (SELECT ({cols}) IN "
            f"(SELECT ({cols}) FROM (SELECT {real} FROM ({sql_load('B')}))) AS hit FROM ({_sample_sql()}))")


@query("exact_copies", _sql_copies())
def _exact_copies(spark, sf):
    """How much of a sample only repeats real rows."""
    return S.exact_copies(X.sample(_fit_b(spark, sf), _keys(spark, sf), SEED), load(spark, sf, "B", key=False), B.cols)


# ------------------------------------------------------ prompts, imputation
C = FIXTURES["C"]


C_PAIRS = [(c, g) for k, c in enumerate(C.cols) for g in C.cols[k + 1:]]


def _fit_c(spark, sf, nulls):
    """With the pair tables of every missing pattern."""
    return X.fit(load(spark, sf, "C", nulls=nulls, key=False), C.cols, cond=C.labs[0], bins=BINS, pairs=C_PAIRS)


def _sql_prompts():
    from sentable.plans.q_dist import _PROBE_C  # noqa: F401  (same key set)
    from sentable.plans.sqlmodel import GRP_CTE, complete_sql
    from sentable.plans.sqlparse import lenient_select
    from sentable.plans.workloads import sql_lenient_text
    parsed = lenient_select(sql_lenient_text("C", sql_load("C", nulls=True)), C.cols, ["row_key"])
    given = ", ".join(f"CASE WHEN {c} <> 'placeholder' THEN {c} END AS g_{c}" for c in C.cols)
    src = f"SELECT row_key AS sid, {given} FROM ({parsed})"
    ctes = model_ctes(sql_load("C"), C.cols, C.kinds, [C.cols], BINS, all_pairs=True)
    return f"WITH {ctes}, {GRP_CTE} {complete_sql(src, C.cols, C.kinds, BINS, SEED)}"


@query("sample_prompts", _sql_prompts())
def _sample_prompts(spark, sf):
    """GEN-7: partial rows written as prompts ("c_nationkey is 5, c_mktsegment
    is None") are parsed and completed by the experts fitted on the table."""
    from sentable.plans.workloads import lenient_text
    prompts = lenient_text(load(spark, sf, "C", nulls=True), "C").withColumnRenamed("row_key", "sid")
    return X.sample_from_prompts(_fit_c(spark, sf, False), prompts, SEED)


IMPUTE_RETRIES = 15


def _sql_impute():
    from sentable.plans.q_prep import sql_to_numeric
    from sentable.plans.sqlmodel import GRP_CTE, complete_sql
    from sentable.plans.fixtures import sql_fmt
    src_c = sql_load("C", nulls=True)
    ctes = [model_ctes(src_c, C.cols, C.kinds, [C.cols], BINS, drop_nan_numbers=True, all_pairs=True), GRP_CTE]
    num = [c for c in C.cols if C.kinds[c] in ("int", "double")]
    first = ", ".join(f"{sql_fmt(c, C.kinds[c])} AS g_{c}" for c in C.cols)
    full = " AND ".join(f"{c} IS NOT NULL" for c in C.cols)
    ctes.append(f"r0 AS (SELECT row_key, {first} FROM ({src_c}) WHERE NOT ({full}))")
    typed0 = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in num else sql_fmt(c, C.kinds[c]) + f" AS {c}" for c in C.cols)
    outs = [f"SELECT row_key, {typed0} FROM ({src_c}) WHERE {full}"]
    for a in range(IMPUTE_RETRIES):
        comp = complete_sql(f"SELECT * FROM r{a}", C.cols, C.kinds, BINS, SEED, attempt=a, key="row_key")
        typed = ", ".join(f"{sql_to_numeric(c)} AS {c}" if c in num else c for c in C.cols)
        ctes.append(f"t{a} AS (SELECT row_key, {typed} FROM ({comp}))")
        ok = " AND ".join(f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if c in num else "") for c in C.cols)
        outs.append(f"SELECT * FROM t{a} WHERE {ok}")
        nxt = ", ".join(f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS VARCHAR) END AS g_{c}" if c in num else f"{c} AS g_{c}"
                        for c in C.cols)
        ctes.append(f"r{a + 1} AS (SELECT row_key, {nxt} FROM t{a} WHERE NOT ({ok}))")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(outs)


@query("impute", _sql_impute())
def _impute(spark, sf):
    """GEN-8 + JN-6: the nulls of ``customer`` (10% injected) are filled by
    experts fitted on the same table; drawn 'nan' cells are retried."""
    r = X.impute(_fit_c(spark, sf, True), load(spark, sf, "C", nulls=True), SEED, max_retries=IMPUTE_RETRIES)
    return r.rows


A = FIXTURES["A"]
ENC = A.ords + A.labs


def _sql_encoded_sample():
    from sentable.plans.q_prep import _FIT_A, _sql_encoded_a, sql_to_numeric
    kinds = dict(A.kinds, p_brand="int", p_type="int")
    enc_src = _sql_encoded_a()
    ctes = model_ctes(enc_src, A.cols, kinds, [A.cols], BINS)
    keys = f"SELECT row_key AS sid FROM ({sql_load('A')})"
    chain = f"SELECT sid, {', '.join(A.cols)} FROM {chain_sql(keys, A.cols, 0, kinds, BINS, SEED)}"
    j = " ".join(f"JOIN (SELECT value AS v_{c}, CAST(id AS DOUBLE) AS id_{c} FROM enc WHERE \"column\" = '{c}') "
                 f"ON {sql_to_numeric(c)} = id_{c}" for c in ENC)
    return (f"WITH enc AS ({_FIT_A}), {ctes} SELECT sid, v_p_brand AS p_brand, p_size, p_retailprice, v_p_type AS p_type "
            f"FROM ({chain}) {j}")


@query("sample_encoded", _sql_encoded_sample())
def _sample_encoded(spark, sf):
    """GEN-12: classification — ords and labels are label-encoded before the
    fit (ids are numbers to the model) and decoded after sampling; draws
    that are not a valid id are dropped by the decoder."""
    from sentable.operators.encode import decode_labels, encode_labels, fit_labels
    df = load(spark, sf, "A")
    enc = fit_labels(df.drop("row_key"), ENC)
    coded = encode_labels(df, enc, ENC)
    m = X.fit(coded.drop("row_key"), A.cols, cond=A.labs[0], bins=BINS)
    gen = X.sample(m, df.select(F.col("row_key").alias("sid")), SEED)
    return decode_labels(gen, enc, ENC)


def _sql_synth_encoded():
    from sentable.plans.q_prep import _FIT_A, _sql_encoded_a, sql_split, sql_to_numeric
    kinds = dict(A.kinds, p_brand="int", p_type="int")
    train = f"SELECT * FROM ({sql_split(_sql_encoded_a())}) WHERE split = 'train'"
    ctes = model_ctes(train, A.cols, kinds, [A.cols], BINS, edge_src=train)
    keys = f"SELECT row_key AS sid FROM ({train})"
    chain = f"SELECT sid, {', '.join(A.cols)} FROM {chain_sql(keys, A.cols, 0, kinds, BINS, SEED)}"
    j = " ".join(f"JOIN (SELECT value AS v_{c}, CAST(id AS DOUBLE) AS id_{c} FROM enc WHERE \"column\" = '{c}') "
                 f"ON {sql_to_numeric(c)} = id_{c}" for c in ENC)
    return (f"WITH enc AS ({_FIT_A}), {ctes} SELECT sid, v_p_brand AS p_brand, TRY_CAST(p_size AS BIGINT) AS p_size, "
            f"TRY_CAST(p_retailprice AS DOUBLE) AS p_retailprice, v_p_type AS p_type FROM ({chain}) {j}")


@query("synthesize_encoded", _sql_synth_encoded())
def _synthesize_encoded(spark, sf):
    """GEN-12/13 on ``part``: label-encoded, decoded after the parse; as many rows as the training split."""
    return S.synthesize(load(spark, sf, "A"), _contract(A), seed=SEED, bins=BINS, encode_categories=True)


D = FIXTURES["D"]
_SPLIT_D = sql_split(sql_load("D"))


@query("split_lineitem", _SPLIT_D)
def _split_lineitem(spark, sf):
    return split(load(spark, sf, "D"), SEED, F.col("row_key"))


@query("fit_experts_lineitem", counts_sql(sql_load("D"), D.cols, D.kinds, [D.cols], BINS))
def _fit_experts_lineitem(spark, sf):
    return X.fit(load(spark, sf, "D", key=False), D.cols, cond=D.labs[0], bins=BINS).counts


def _sql_synth_d():
    from sentable.plans.q_text import _sql_in_domain
    train = f"SELECT * FROM ({_SPLIT_D}) WHERE split = 'train'"
    ctes = model_ctes(train, D.cols, D.kinds, [D.cols], BINS, edge_src=train)
    keys = f"SELECT row_key AS sid FROM ({train})"
    lines = ("SELECT sid AS row_key, concat(" + ", ".join(f"'{c} is ' || {c} || '<EOC>'" for c in D.cols)
             + f") AS line FROM {chain_sql(keys, D.cols, 0, D.kinds, BINS, SEED)}")
    ok = _sql_in_domain(strict_select(lines, D.cols, ["row_key"]), "D", D.ords)
    out = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" if D.kinds[c] == "double" else c for c in D.cols)
    return f"WITH {ctes} SELECT row_key AS sid, {out} FROM ({ok})"


@query("synthesize_lineitem", _sql_synth_d())
def _synthesize_lineitem(spark, sf):
    """GEN-13 on ``lineitem``, whose rows have no declared key; as many rows as the training split."""
    return S.synthesize(load(spark, sf, "D"), _contract(D), seed=SEED, bins=BINS)


@query("parse_decoded", f"SELECT row_key, p_brand, CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS p_size, "
                        f"CAST(CAST(p_retailprice AS DOUBLE) AS VARCHAR) AS p_retailprice, p_type FROM ({sql_load('A')})")
def _parse_decoded(spark, sf):
    """TXT-16's label branch: lines of label ids are parsed, decoded and checked."""
    from sentable.functions.text import row_text
    from sentable.operators.encode import encode_labels, fit_labels
    from sentable.operators.parsing import parse_samples
    df = load(spark, sf, "A")
    enc = fit_labels(df.drop("row_key"), ENC)
    coded = encode_labels(df, enc, ENC)
    lines = coded.select("row_key", row_text(coded, A.cols).alias("line"))
    return parse_samples(lines, df, A.cols, ENC, enc=enc, enc_cols=ENC)
