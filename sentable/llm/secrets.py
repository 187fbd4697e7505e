"""Secret scan: fixed patterns and sliding-window Shannon entropy.

Base kinds are ``assign``, ``access`` and ``hex`` (the patterns below, leftmost
and not overlapping per kind).  The method adds ``entropy_hex`` and
``entropy_base64``: candidate strings are the longest runs of a character class;
over each run slides a window of the class's width.  One character leaves and
one enters a step, so the window's counts c and S = sum(c * log2 c) are updated
for these two alone; the entropy is log2(w) - S / w.  The counts are five bits each, a
dozen in one integer, and S is in fixed point, so a step costs the same however long the run
is, and no error adds up.  Words that stand for a placeholder cut a run into parts; a run is reported
whole if some part reaches the class's threshold in its best window, mixes letters with digits,
and is no identifier or slug.  This allow-list never applies to base kinds.

Spans are code points, end exclusive.  Null counts as the empty text, which
has no spans.  A row each row of the input; repeated rows and ids are kept apart by
their place in the file.  Very long texts and runs take time in proportion to their length; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentable.llm.common import cut, numbered, scanned, table, text_or_empty

# The base patterns.  Runs of hex digits and access keys shorter
# than the limit cannot start a longer match, so the limit is in the pattern.
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

# Per character class: alphabet, window width, bits that the best window must reach.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 16, 2.9),
    "entropy_base64": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 20, 3.8),
}

# What candidate strings may be without being secrets.  A slug is made of words and
# numbers with separators between them, so a letter never stands next to a digit.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|1234567890|abcdefgh"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UNLIKE_SLUG = r"[A-Za-z][0-9]|[0-9][A-Za-z]"

KINDS = ["assign", "access", "hex", *CLASSES]


def class_pattern(kind: str) -> str:
    """The longest runs of the class that are as long as its window."""
    letters, width, _ = CLASSES[kind]
    inside = "0-9a-fA-F" if kind == "entropy_hex" else "A-Za-z0-9+/_-"
    return f"[{inside}]{{{width},}}"


PACKED = 12              # counts of five bits in one integer
POINT = 2.0 ** 40        # S in fixed point


def best_entropy(s: Column, kind: str) -> Column:
    """Largest Shannon entropy in bits of any window of the string ``s``, of characters of the class."""
    letters, width, _ = CLASSES[kind]
    lanes = range(-(-len(letters) // PACKED))
    code = {ord(c): k for k, c in enumerate(letters)}
    lane_of, bits_of = (F.array(*[F.lit(f(code.get(c, 0))) for c in range(128)])
                        for f in (lambda k: k // PACKED, lambda k: 5 * (k % PACKED)))
    terms = F.array(*[F.lit(round(c * math.log2(c) * POINT) if c else 0).cast("long") for c in range(width + 2)])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    place = lambda c: F.struct(F.get(lane_of, F.ascii(c)).alias("lane"), F.get(bits_of, F.ascii(c)).alias("bits"))
    enters = F.transform(F.split(s, ""), place)
    nothing = F.array_repeat(F.struct(F.lit(-1).alias("lane"), F.lit(0).alias("bits")), width)
    leaves = F.slice(F.concat(nothing, enters), F.lit(1), F.size(enters))
    start = F.struct(F.lit(0).alias("seen"), zero.alias("s"), F.lit(1 << 62).cast("long").alias("least"),
                     *[zero.alias(f"n{k}") for k in lanes])

    def count(acc, at):
        packed = acc["n0"]
        for k in lanes:
            packed = F.when(at["lane"] == k, acc[f"n{k}"]).otherwise(packed)
        return F.call_function("shiftright", packed, at["bits"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(acc, x):
        enter, leave = x["enter"], x["leave"]
        a, b = count(acc, enter), count(acc, leave)
        change = (F.get(terms, a + 1) - F.get(terms, a)
                  + F.when(leave["lane"] >= 0, F.get(terms, b - 1) - F.get(terms, b)).otherwise(zero))
        total = F.when(enter == leave, acc["s"]).otherwise(acc["s"] + change)
        unit = lambda at, k: F.when(at["lane"] == k, F.call_function("shiftleft", one, at["bits"])).otherwise(zero)
        return F.struct((acc["seen"] + 1).alias("seen"), total.alias("s"),
                        F.when(acc["seen"] + 1 >= width, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
                        *[(acc[f"n{k}"] + unit(enter, k) - unit(leave, k)).alias(f"n{k}") for k in lanes])

    pairs = F.zip_with(enters, leaves, lambda x, y: F.struct(x.alias("enter"), y.alias("leave")))
    return F.aggregate(pairs, start, step, lambda acc: F.lit(math.log2(width)) - acc["least"] / (POINT * width))


def judged(value: Column, kind: str) -> Column:
    """Whether some part of a run may be a secret."""
    _, width, bits = CLASSES[kind]
    parts = F.split(value, PLACEHOLDER, -1)
    likely = lambda p: ((F.length(p) >= width) & p.rlike(UNLIKE_SLUG) & ~p.rlike(UUID))
    return F.exists(F.filter(parts, likely), lambda p: best_entropy(p, kind) >= bits)


def matches(text: str, kind: str, pattern: str) -> Column:
    """An array of (kind, k, before, size, value): the k-th match, the code
    points between it and the one before, and its size."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    rows = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), gap.alias("before"), F.length(m).alias("size"), m.alias("value")))
    none = F.array().cast("array<struct<kind:int,before:int,size:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, kind, start, end) of every span in every text."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **{k: class_pattern(k) for k in CLASSES}}
    text = numbered(docs, id_col, text_col).select("rid", F.col(f"`{id_col}`").alias("id"),
                                                   text_or_empty(text_col).alias("text"))
    found = text.select("rid", "id", *[matches("text", k, p).alias(k) for k, p in patterns.items()])
    rows = cut(found.select("rid", F.posexplode(F.concat(*patterns)).alias("k", "m")).select("rid", "k", "m.*"),
               "secret-matches")
    # as many tasks as any shuffle: there are few bytes to a match, but entropies to compute
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "rid", "kind")
    upto = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(upto))
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    value = F.regexp_extract("value", ASSIGN, 1)
    keep = [(F.col("kind") == 0) & (F.length(value) >= ASSIGN_VALUE), F.col("kind").isin(1, 2)]
    for k in CLASSES:
        keep.append(F.when(F.col("kind") == KINDS.index(k), judged(F.col("value"), k)).otherwise(F.lit(False)))
    flag = keep[0]
    for c in keep[1:]:
        flag = flag | c
    return rows.withColumn("flag", flag).where("flag").select("rid", "kind", "start", "end")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = scanned(docs)
    s = F.struct("start", "kind", "end")
    label = lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1),
                                  x["start"].cast("string"), x["end"].cast("string"))
    found = (spans(docs, id_col, text_col).groupBy("rid").agg(
        F.count_if(F.col("kind") == 0).alias("n_assign"), F.count_if(F.col("kind") == 1).alias("n_access"),
        F.count_if(F.col("kind") == 2).alias("n_hex"), F.array_sort(F.collect_list(s)).alias("all")))
    found = cut(found, "secret-spans")       # of any width, so the planner joins it by its size
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.array_join(F.transform(F.filter(every, lambda x: x["kind"] < 3), label), ",")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (numbered(docs, id_col).join(found, "rid", "left")
            .select(F.col(f"`{id_col}`"), count("n_assign"), count("n_access"), count("n_hex"),
                    F.sha2(base, 256).alias("base_sha256"),
                    F.array_join(F.transform(every, label), ",").alias("spans")))


def query(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def kind_rows(k, name, pattern):
        return f"""
m{k} AS (SELECT doc_id, {k} AS kind, string_split_regex(t, {quoted(pattern)}) AS pieces,
         regexp_extract_all(t, {quoted(pattern)}) AS found FROM d WHERE regexp_matches(t, {quoted(pattern)})),
r{k} AS (SELECT doc_id, kind, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
           'value': found[i], 'start': list_sum(list_transform(pieces[1:i], lambda p: length(p)))::BIGINT
                    + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0)::BIGINT}})) AS m
         FROM m{k})"""

    patterns = [ASSIGN, ACCESS, HEX, *[class_pattern(c) for c in CLASSES]]
    parts = ",".join(kind_rows(k, n, p) for k, (n, p) in enumerate(zip(KINDS, patterns)))
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(KINDS)))
    likely = f"regexp_matches(p, {quoted(UNLIKE_SLUG)}) AND NOT regexp_matches(p, {quoted(UUID)})"
    best = " ".join(
        f"WHEN {KINDS.index(c)} THEN len(list_filter(string_split_regex(v, {quoted(PLACEHOLDER)}), lambda p: CASE WHEN "
        f"length(p) >= {w} AND {likely} THEN list_max(list_transform(range(1, length(p) - {w} + 2), "
        f"lambda i: list_aggregate(string_split(substr(p, i, {w}), ''), 'entropy'))) >= {bits} ELSE false END)) > 0"
        for c, (_, w, bits) in CLASSES.items())
    names = ", ".join(quoted(k) for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{parts},
u AS (SELECT doc_id, kind, m.value AS v, m.start AS s, m.start + length(m.value) AS e FROM ({union})),
k AS (SELECT doc_id, kind, s, e, ([{names}])[kind + 1] || ':' || s || ':' || e AS label FROM u
      WHERE CASE kind WHEN 0 THEN length(regexp_extract(v, {quoted(ASSIGN)}, 1)) >= {ASSIGN_VALUE}
                 WHEN 1 THEN true WHEN 2 THEN true
                 ELSE CASE kind {best} END END),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex,
             string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(label, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
