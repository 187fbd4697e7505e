"""STR-1: parse and validate raw sample lines as they are appended.

``readStream.text`` → clean → strict parse (a stateless projection) →
stream-static left-semi joins against the real table's domains →
``writeStream`` to Parquet with a checkpoint, run with
``trigger(availableNow=True)`` so each call processes what has arrived and
stops.  Restarting with the same checkpoint continues where it left off,
which is what makes the job survive executor and driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from sentable.operators.domain import domains, in_domain
from sentable.operators.parsing import clean_lines, parse_strict


def parse_stream(spark: SparkSession, source_dir: str, real: DataFrame, cols: list[str], check: list[str],
                 sink_dir: str, checkpoint_dir: str, fill: str | None = "?", max_files_per_trigger: int | None = None):
    """Start the streaming parse; returns the StreamingQuery."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir).withColumnRenamed("value", "line")
    parsed = parse_strict(clean_lines(lines), cols)
    ok = in_domain(parsed, domains(real, check, fill), check)
    return (ok.select(*cols).writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append")
              .trigger(availableNow=True).start())


def run_available(spark: SparkSession, source_dir: str, real: DataFrame, cols: list[str], check: list[str],
                  sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Process everything available now, however long it takes, then read the
    sink.  It is read with the parsed table's schema and set up before the first
    batch, so no survivors (or no input) give an empty table."""
    schema = StructType([StructField(c, StringType()) for c in cols])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(sink_dir)
    q = parse_stream(spark, source_dir, real, cols, check, sink_dir, checkpoint_dir,
                     max_files_per_trigger=max_files_per_trigger)
    q.awaitTermination()      # availableNow ends by itself; a failed query raises here
    return spark.read.schema(schema).parquet(sink_dir)
