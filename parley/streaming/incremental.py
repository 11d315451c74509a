"""Lines that keep arriving: each micro-batch's meetings are flagged anew as wholes.

Flags depend on neighbouring lines and on how long a meeting is, so a meeting is recomputed from all its stored lines when
some of it arrives; meetings without new lines are not touched. The store is parted by a hash of the meeting, so a batch
reads the parts its meetings lie in and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.flags import flag_lines
from parley.sources.schemas import LINES


PARTS = 256


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of lines as they appear."""
    return spark.readStream.schema(LINES + ", speaker string").parquet(path)


def flag_stream(stream: DataFrame, store: str, out: str, phantoms: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append arriving lines to ``store`` by batch and part, and write the flags of the meetings they belong to under ``out``.

    A batch that is tried again overwrites its own folder, so nothing counts twice.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.withColumn("part", F.pmod(F.xxhash64("meeting_id"), F.lit(PARTS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={epoch}")
        arrived = spark.read.schema(f"{LINES}, speaker string, part int").parquet(f"{store}/batch={epoch}")
        parts = [r["part"] for r in arrived.select("part").distinct().collect()]  # PARTS at most
        stored = spark.read.schema(f"{LINES}, speaker string, batch long, part int").parquet(store).where((F.col("batch") <= epoch) & F.col("part").isin(parts)).drop("batch", "part")
        lines = stored.join(arrived.select("meeting_id").distinct(), "meeting_id", "left_semi")
        meetings = lines.groupBy("meeting_id").agg(F.max("end").alias("duration_s"), F.max(F.col("speaker").isNotNull()).alias("diarized"))
        flag_lines(lines, meetings, phantoms).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
