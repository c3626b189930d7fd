"""Transcripts that arrive as files: the batch transforms over a stream of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.files import WORDS


def transcript_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """One row per word of each new JSON file of a folder. A file is a whole dialogue, so no state is kept."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    x = raw.select(name.alias("dialogue_id"), F.from_json("value", WORDS).alias("x"))
    return x.select("dialogue_id", F.posexplode("x").alias("word_idx", "w")).select("dialogue_id", "word_idx", F.col("w.speaker"), F.col("w.word"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"))


def run_available(words: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Works off all files that are there, batch by batch, and appends transform(batch) to parquet. The checkpoint
    remembers the files, so a later run takes new ones only; a batch that is repeated after a failure overwrites
    its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    words.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
