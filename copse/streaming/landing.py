"""Tables that arrive as files: a landing folder becomes a growing Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from copse.schemas import TABLES
from copse.session import checkpoint_dir


def landing_stream(spark: SparkSession, folder: str, table: str, fmt: str = "parquet",
                   files_per_trigger: int = 1000) -> DataFrame:
    """Files of one table as a stream with its fixed schema."""
    reader = spark.readStream.schema(TABLES[table]).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("header", True).csv(folder) if fmt == "csv"
            else reader.format(fmt).load(folder))


def append_table(stream: DataFrame, path: str, name: str,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Append everything that has arrived to ``path`` and stop.

    Offsets live in the shared checkpoint folder and the file sink commits per
    batch, so a lost executor or driver neither drops nor repeats a file.
    """
    where = checkpoint or f"{checkpoint_dir(stream.sparkSession)}/landing-{name}"
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", where).trigger(availableNow=True)
            .outputMode("append").queryName(f"landing_{name}").start())
