"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from sentable.operators import joins
from sentable.sources.io import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Words: runs of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# bytes.translate tables: lower-case A-Z only; the second one also turns every
# ASCII character that is not part of a word into a space.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))

# A side is broadcast only when a count finds at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

ROW_BITS = 36          # rows of one file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """The words (``WORD``) of a text, A-Z lower-cased: separators become spaces
    while letters are lower-cased, and a plain split is cheaper than a pattern."""
    others = "".join(chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) == " "))
    spaced = F.translate(c, UPPER + others, LOWER + " " * len(others))
    return F.array_remove(F.split(spaced, " ", -1), "")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers get this package from the driver, once an application,
    wherever they run and whatever their own import path is."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="sentable-"), "sentable.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "sentable")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if its rows have a place in a Parquet file, else a written copy of it.  An operator that
    numbers the rows of one input more than once calls this first."""
    try:
        _place(df)
        return df
    except AnalysisException:
        return cut(df, "scanned")


def _place(df: DataFrame) -> tuple[Column, Column]:
    """(file, row): where a row stands."""
    there = df.metadataColumn("_metadata")
    file, row = there.getField("file_path"), there.getField("row_index")
    df.select(file, row)                 # raises an AnalysisException if there is no such place
    return file, row


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row: its file's place among all files in order of
    their paths, and its place in that file.  So it does not depend on how a scan is cut into
    tasks, and names the same row in every scan, whatever executors come and go between them.

    Files are numbered by a table of their paths, which is broadcast after a check of its size."""
    ship(df.sparkSession)
    df = scanned(df)
    file, row = _place(df)
    path, at, number = (fresh(df, x) for x in ("_path", "_at", "_file"))
    paths = df.select(file.alias(path)).distinct()
    files = cut(paths.select(path, F.row_number().over(Window.orderBy(path)).cast("long").alias(number)), "files")
    rows = df.select("*", file.alias(path), row.alias(at)).join(small_side(files), path)
    return rows.withColumn(name, F.shiftleft(number, ROW_BITS) + F.col(at)).drop(path, at, number)


def numbered(df: DataFrame, *cols: str) -> DataFrame:
    """``rid``, the number of the row (see ``with_row_id``), and ``cols``."""
    rid = fresh(df, "rid")
    return with_row_id(df, rid).select(F.col(rid).alias("rid"), *[F.col(f"`{c}`") for c in cols])


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, **more: DataType) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *[StructField(k, t) for k, t in more.items()]])


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator will add under ``names``."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose numbers are in ``gone`` (rid)."""
    rid = fresh(docs, "rid")
    return (with_row_id(docs, rid).join(small_side(gone).toDF(rid), rid, "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a materialised table, marked for broadcast if it has at most ``rows`` rows
    and ``BROADCAST_BYTES`` bytes; else joined by a shuffle."""
    return joins.small_side(df, rows, BROADCAST_BYTES)


def tidy(run):
    """``run`` for ``mapInArrow``; what the task remembered goes back to the system when it ends."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):        # not this C library
                pass
    return tidied


def cut(df: DataFrame, what: str) -> DataFrame:
    """Lineage cut: a Parquet table in the shared checkpoint folder."""
    return materialize(df, what)
