"""Vector code compression: product quantisation whose codebooks ball k-means fits.

Components become integers floor(``SCALE`` * x), vectors are cut into ``PARTS`` consecutive parts, and
each part position has a codebook of at most ``ENTRIES`` entries, the parts of the vectors with the
smallest ids to begin with.  A round assigns every part to its nearest entry (ties to the
lower index) and moves each entry to the floored mean of its parts.

An entry's members fill a ball around it.  What a round does not have to compare:

- *Neighbours.*  A part at distance d of its entry c can only be as near to an entry e with
  |c - e| <= 2 d.  So the entries e within twice the ball's radius are c's neighbours, and no other is
  looked at.  The driver knows the last round's radii, and by how far c has moved since: their sum bounds
  the radius now.
- *Stable core.*  A part nearer to c than half the way to the nearest neighbour stays.
- *Annular rings.*  With the neighbours in order of their distance, d puts each other part in a ring,
  and only the neighbours within that ring are its candidates, compared exactly.
- *Stable balls.*  If neither c nor a neighbour has moved, the ball's parts keep entry and distance.

Everything is in integers (as floating-point numbers only where they stay exact; squared distances must
fit 64 bits), so results
do not depend on how rows are dealt to tasks.  Each round writes the rows with their codes and distances to the
shared checkpoint folder; the driver holds codebooks and sums of the entries alone.

Dropped are rows whose vector is null, empty, or holds null or non-finite components.  Vectors of one
table have one length, a multiple of ``PARTS``, else an error says so.  Of equal ids the vector
that is smaller counts as the first, null ids come last, and repeated rows give a row each.  With fewer than
``ENTRIES`` rows there are as many entries; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sentable.llm.common import cut, fresh, ship, small_side, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT = 1 << 53           # integers below are exact as floating-point numbers
ROWS = 4_096              # vectors compared together


def integers(df: DataFrame, vector_col: str) -> DataFrame:
    """``df`` with column ``v``: the integer components of each kept row."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = df.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite))
    return kept.withColumn("v", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")))


# ------------------------------------------------------------------ distances
def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as floating-point numbers if squared distances stay exact, else as Python's integers."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    exact = 4 * most * most * max(1, arrays[0].shape[-1]) < EXACT
    return [a.astype(np.float64 if exact else object) for a in arrays]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, all entries compared."""
    a, b = _numbers(x, book)
    d = (b * b).sum(1)[None, :] - 2 * a.dot(b.T)
    code = d.argmin(axis=1)
    return code, (d[np.arange(len(x)), code] + (a * a).sum(1)).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = _numbers(x, y)
    return ((a - b) * (a - b)).sum(1).astype(np.int64)


class Balls:
    """One part position's entries, with what the last round says about their balls."""

    def __init__(self, book: np.ndarray, moved: np.ndarray, reach: list[float]):
        """moved: whether an entry has; reach: bounds of the balls' radii around the entries now."""
        self.book = book
        a, = _numbers(book)
        square = (a * a).sum(1)
        gap = (square[:, None] + square[None, :] - 2 * a.dot(a.T)).astype(object if a.dtype == object else np.int64)
        self.neighbours, self.gaps, self.still = [], [], []
        for i in range(len(book)):
            order = np.argsort(gap[i], kind="stable")
            order = order[(order != i) & np.array([gap[i][j] <= 4 * reach[i] ** 2 * (1 + 1e-9) for j in order], bool)]
            self.neighbours.append(order)
            self.gaps.append(gap[i][order])
            self.still.append(not moved[i] and not moved[order].any())

    def reassigned(self, x: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, dist = code.copy(), dist.copy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        for members in np.split(order, starts[1:]) if len(order) else []:
            i = int(code[members[0]])
            if self.still[i]:
                continue
            d = squared(x[members], np.broadcast_to(self.book[i], x[members].shape))
            dist[members] = d
            ring = np.searchsorted(self.gaps[i], 4 * d.astype(self.gaps[i].dtype), side="right")     # 0: the stable core
            for k in np.unique(ring[ring > 0]):
                rows = members[ring == k]
                candidates = np.sort(np.append(self.neighbours[i][:k], i))     # ties go to the lower index
                at, best = nearest(x[rows], self.book[candidates])
                code[rows], dist[rows] = candidates[at], best
        return code, dist


# ------------------------------------------------------------------ the rounds
def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))


def _assign(state, width: int, names: list[str], first: bool):
    """Each batch with new codes and squared distances, a list of a number a part each."""
    def run(batches):
        balls = state.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _matrix(b.column("v"), width).reshape(b.num_rows, PARTS, width // PARTS)
                if first:
                    found = [nearest(x[:, p], balls[p]) for p in range(PARTS)]
                else:
                    code, dist = _matrix(b.column("code"), PARTS), _matrix(b.column("dist"), PARTS)
                    found = [balls[p].reassigned(x[:, p], code[:, p], dist[:, p]) for p in range(PARTS)]
                code = np.stack([c for c, _ in found], axis=1).astype(np.int64)
                dist = np.stack([d for _, d in found], axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], _lists(code), _lists(dist)],
                                                 [*names, "code", "dist"])
    return run


def _sums(width: int, entries: int):
    """A task's (part, entry, place, sum of components, number, largest distance)."""
    def run(batches):
        total = np.zeros((PARTS, entries, width // PARTS), object)
        count = np.zeros((PARTS, entries), np.int64)
        far = np.zeros((PARTS, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), width).reshape(b.num_rows, PARTS, width // PARTS)
            if int(np.abs(x).max()) * b.num_rows >= 1 << 62:
                x = x.astype(object)
            code, dist = _matrix(b.column("code"), PARTS), _matrix(b.column("dist"), PARTS)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                used, starts = np.unique(code[order, p], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p], starts, axis=0)
                count[p] += np.bincount(code[:, p], minlength=entries)
                far[p, used] = np.maximum(far[p, used], np.maximum.reduceat(dist[order, p], starts))
        p, e = np.nonzero(count)
        places = width // PARTS
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(p, places), pa.int32()), pa.array(np.repeat(e, places), pa.int32()),
            pa.array(np.tile(np.arange(places), len(p)), pa.int32()),
            pa.array([Decimal(int(s)) for s in total[p, e].ravel()], pa.decimal128(38, 0)),
            pa.array(np.repeat(count[p, e], places)), pa.array(np.repeat(far[p, e], places))],
            ["part", "entry", "place", "total", "n", "far"])
    return run


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS,
             entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(the kept rows without their vector, with code and dist, arrays of a number a part;
    the final codebooks, by part, entry and place)."""
    spark = vectors.sparkSession
    ship(spark)
    vid = fresh(vectors, "vid")
    inner = {"v", "code", "dist"}
    renamed = vectors.toDF(*[fresh(vectors, c) if c.lower() in inner else c for c in vectors.columns])
    back = dict(zip(renamed.columns, vectors.columns))
    own = next(n for n, c in back.items() if c == vector_col)
    key = next(n for n, c in back.items() if c == id_col)
    rows = integers(renamed, own).drop(own)
    names = [*[c for c in rows.columns if c != "v"], "v"]
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    first = rows.select(F.col(f"`{key}`").alias(vid), "v").orderBy(F.col(vid).asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0]["v"]) if first else PARTS
    if first and (width % PARTS or not rows.where(F.size("v") != width).isEmpty()):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, width // PARTS)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    lists = [StructField("code", ArrayType(LongType())), StructField("dist", ArrayType(LongType()))]
    schema = StructType([*rows.schema.fields, *lists])

    def assigned(df, state, is_first):
        sent = spark.sparkContext.broadcast(state)
        return cut(df.mapInArrow(_assign(sent, width, names, is_first), schema), "codes")

    if first:
        rows = assigned(rows, list(books), True)
        for _ in range(rounds):
            found = (rows.select("v", "code", "dist").mapInArrow(
                _sums(width, len(first)), "part int, entry int, place int, total decimal(38,0), n long, far long")
                .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"),
                                                       F.max("far").alias("far")).collect())      # a row a component of the codebooks
            new, radius = books.copy(), np.zeros(books.shape[:2])
            for r in found:
                new[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
                radius[r["part"], r["entry"]] = float(r["far"]) ** 0.5
            shift = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2))
            balls = [Balls(new[p], shift[p] > 0, ((radius[p] + shift[p]) * (1 + 1e-9)).tolist()) for p in range(PARTS)]
            books = new
            rows = assigned(rows, balls, False)
    else:
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lists})
    out = rows.select(*[F.col(f"`{c}`").alias(back[c]) for c in names if c != "v"], F.col("code").alias(fresh(vectors, "code")),
                      F.col("dist").alias(fresh(vectors, "dist")))
    return out, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row."""
    rows, books = quantise(vectors.select(*[F.col(f"`{c}`") for c in (id_col, vector_col, label_col)])
                           .toDF("vec_id", "embedding", "label"))
    hexes = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    rows = cut(rows.select("vec_id", "label", F.array_join(hexes, "").alias("code"),
                           F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "vector-codes")
    sums = small_side(cut(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"))
    return (rows.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def query(spark, sf_dir):
    return codes(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    """Lloyd's rounds in plain form: every part against every entry."""
    def assign(k):
        return f"""
a{k} AS MATERIALIZED (SELECT id, part, min({{'d': xx - 2 * list_inner_product(x, e) + ee, 'i': entry}}) AS best
  FROM x JOIN b{k} USING (part) GROUP BY id, part)"""

    def move(k):
        return f"""
m{k} AS (SELECT part, best.i AS entry, place, floor(sum(c::HUGEINT)::DOUBLE / count(*)) AS c
  FROM a{k} JOIN x USING (id, part), LATERAL (SELECT unnest(x)::BIGINT AS c, generate_subscripts(x, 1) AS place)
  GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.e, b{k}.e) AS e,
    list_inner_product(coalesce(n.e, b{k}.e), coalesce(n.e, b{k}.e)) AS ee
  FROM b{k} LEFT JOIN (SELECT part, entry, list(c ORDER BY place) AS e FROM m{k} GROUP BY ALL) n USING (part, entry))"""

    steps = ",".join(f"{assign(k)},{move(k)}" for k in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label,
    list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, part, x, list_inner_product(x, x) AS xx FROM (SELECT id, part,
    v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(part))),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS e, xx AS ee FROM x WHERE id <= {ENTRIES}),{steps},{assign(rounds)},
rows_ AS (SELECT id, string_agg(lower(lpad(to_hex(best.i), 2, '0')), '' ORDER BY part) AS code,
    sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY id),
digest AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS h FROM (
    SELECT part, entry, array_to_string(list_transform(e, lambda c: c::BIGINT), ',') AS t FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN rows_ USING (id), digest
"""


SQL = _sql()
