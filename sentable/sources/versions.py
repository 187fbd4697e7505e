"""A log of published versions: what ``latest`` names, and when it changes.

A version's files are written once, in a folder of their own, and never touched again.  Only then is
the version published: an entry with the next number is created in the log folder.  Creating a file
that must not exist is atomic, so of two writers that publish at once one gets the number and the
other the next one.  Readers take the entry of the highest number; they see a version whole or not at
all, and keep the one they have resolved, whatever is published meanwhile.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_versions"
WIDTH = 12


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, log = _files(spark, f"{root}/{LOG}")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit() and n.endswith(".version"))


def _entry(root: str, number: int) -> str:
    return f"{root}/{LOG}/{number:0{WIDTH}d}.version"


def publish(spark: SparkSession, root: str, version: str) -> int:
    """Make ``version`` the latest one; returns the number of its entry."""
    fs, _ = _files(spark, root)
    # the entry is written aside and renamed, so no reader finds it empty
    aside, draft = _files(spark, f"{root}/{LOG}/.{version}-{spark._jvm.java.util.UUID.randomUUID().toString()}")
    out = aside.create(draft, False)
    out.write(bytearray(version.encode()))
    out.close()
    number = (_numbers(spark, root) or [0])[-1] + 1
    while True:
        entry = spark._jvm.org.apache.hadoop.fs.Path(_entry(root, number))
        if _taken(spark, fs, _entry(root, number) + ".taken"):
            if not fs.rename(draft, entry):
                raise RuntimeError(f"cannot publish {version} as {entry}")
            return number
        number += 1


def _taken(spark: SparkSession, fs, path: str) -> bool:
    """Create a file that must not exist: True for one writer only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() == "file":
            nio = spark._jvm.java.nio.file
            nio.Files.createFile(nio.Path.of(p.toUri().getPath(), spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)),
                                 spark._sc._gateway.new_array(nio.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def read_entry(spark: SparkSession, root: str, number: int) -> str:
    fs, entry = _files(spark, _entry(root, number))
    stream = fs.open(entry)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> str | None:
    """The version published last; None if none is."""
    numbers = _numbers(spark, root)
    return read_entry(spark, root, numbers[-1]) if numbers else None


def history(spark: SparkSession, root: str) -> DataFrame:
    """(number, version) of every publication: a row each, read by the driver."""
    return spark.createDataFrame([(n, read_entry(spark, root, n)) for n in _numbers(spark, root)], "number long, version string")
