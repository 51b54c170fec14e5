"""Quads that arrive as files of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import QUADS
from quadloom.sources.lines import parse_lines


def stream_lines(spark: SparkSession, folder: str, quads: bool = True, on_error: str = "skip") -> DataFrame:
    """The stream of quads in N-Quads (or N-Triples) files that appear in a folder; repetitions are kept."""
    return parse_lines(spark.readStream.text(folder), quads, on_error)


def append_stream(stream: DataFrame, table: str, checkpoint: str):
    """Append a stream of quads to a parquet folder, each batch as a set, and process what has arrived.

    A batch is written to a folder of its own number, so that a batch that is repeated after a failure replaces itself.
    ``read_stream_table`` gives the set of all batches.
    """

    def put(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumns({"_g": F.coalesce("g", F.lit("")), "_s": F.col("s.id"), "_o": F.col("o.id")})
        keyed.dropDuplicates(["_g", "_s", "p", "_o"]).select("g", "s", "p", "o").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_table(spark: SparkSession, table: str) -> DataFrame:
    """The set of the quads of all batches."""
    from quadloom.sparql.update import add_quads

    return add_quads(spark.createDataFrame([], QUADS), spark.read.parquet(table).drop("batch"))
