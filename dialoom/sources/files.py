"""Transcripts and events as files of JSON, parquet shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.sequence import numbered

WORDS = "array<struct<speaker:string,word:string,start:double,end:double>>"
EVENTS = "array<struct<timestamp_ms:bigint,conversation_context:string,prediction:string,total_word_count:int,trigger_word:string,recent_words:string,current_spoken_ratio:double,channel:int,hint:string>>"


def _arrays(spark: SparkSession, folder: str, schema: str, glob: str, number: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    parsed = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1).alias("dialogue_id"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return parsed.select("dialogue_id", F.posexplode("x").alias(number, "x")).select("dialogue_id", number, "x.*")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per word of the folder's JSON files; a file is one dialogue, other files are ignored (S1-S3). A
    word without one of its fields is an error."""
    rows = _arrays(spark, folder, WORDS, "*.json", "word_idx")
    whole = F.col("speaker").isNotNull() & F.col("word").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    return rows.withColumn("speaker", F.when(whole, F.col("speaker")).otherwise(F.raise_error(F.concat(F.lit("a field is missing in "), F.col("dialogue_id")))))


SUFFIX = "_oracle_predictions_curated.json"  # fixed value: what the names of event files end in


def read_events(spark: SparkSession, folder: str, suffix: str = SUFFIX, ids: DataFrame | None = None) -> DataFrame:
    """One row per event of the folder's files named <dialogue_id><suffix> (S5). If `ids` (dialogue_id) is given, only
    those dialogues are read, and one without a file is an error naming it (J3)."""
    raw = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    files = raw.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("dialogue_id"), F.from_json("value", EVENTS, {"mode": "FAILFAST"}).alias("x"))
    if ids is not None:
        from dialoom.operators.dataset import require_ids

        files = require_ids(ids.select("dialogue_id").distinct(), files, "the event file")
    return files.select("dialogue_id", F.posexplode("x").alias("ord", "x")).select("dialogue_id", "ord", "x.*")


def first_ids(df: DataFrame, n: int, key: str = "dialogue_id") -> DataFrame:
    """The rows of the first `n` ids in their order (S9). The ids kept are `n` rows."""
    return df.join(F.broadcast(df.select(key).distinct().orderBy(key).limit(n)) if n <= 100_000 else df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def read_shards(spark: SparkSession, *patterns: str) -> DataFrame:
    """Parquet files by a list of paths or patterns, as one table."""
    return spark.read.parquet(*patterns)


# The fields of a written event, in their order.
EVENT_FIELDS = ["timestamp_ms", "conversation_context", "prediction", "total_word_count", "trigger_word", "recent_words", "current_spoken_ratio", "channel", "hint"]


def event_json(events: DataFrame) -> DataFrame:
    """dialogue_id and value, the JSON array of its events in order: the nine fields in their fixed order, null ones too."""
    each = events.groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("ord", *EVENT_FIELDS)), lambda a, b: F.when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0)).alias("e"))
    fields = lambda x: F.struct(*[x[c].alias(c) for c in EVENT_FIELDS])
    return each.select("dialogue_id", F.to_json(F.transform("e", fields), {"ignoreNullFields": "false"}).alias("value"), F.size("e").alias("n"))


def write_events(events: DataFrame, folder: str) -> int:
    """A JSON array per dialogue under folder/dialogue_id=..., all or nothing by Spark's committer; gives the number of
    events written (K1)."""
    total = Observation("events")
    event_json(events).observe(total, F.sum("n").alias("events")).select("dialogue_id", "value").write.mode("append").partitionBy("dialogue_id").text(folder)
    return total.get["events"] or 0


def write_tokens(streams: DataFrame, folder: str) -> None:
    """Tokenised streams as parquet (K2): Spark's committer leaves either all of it or nothing to read."""
    streams.write.mode("errorifexists").parquet(folder)


def pending(inputs: DataFrame, outputs: DataFrame, key: str = "dialogue_id", valid=None) -> DataFrame:
    """Inputs without an output, or without a valid one if a predicate is given."""
    done = outputs.filter(valid) if valid is not None else outputs
    return inputs.join(done.select(key), key, "left_anti")


def missing(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Keys that only one of two data sets has: side (where it is missing) and key."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(F.lit(right_name).alias("side"), key)
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").select(F.lit(left_name).alias("side"), key)
    return a.unionByName(b)


def shards(df: DataFrame, key: str, size: int = 100_000) -> DataFrame:
    """Adds the shard of each row in the order of the key, `size` rows a shard."""
    return df.join(numbered(df, key, "_n"), key).withColumn("shard", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def shard_names(n: int, prefix: str) -> list[str]:
    """Names of `n` shards: prefix-001-of-004.parquet and so on."""
    return [f"{prefix}-{i:03d}-of-{n:03d}.parquet" for i in range(1, n + 1)]


def write_shards(df: DataFrame, folder: str, prefix: str, key: str = "dialogue_id", size: int = 100_000) -> list[str]:
    """Writes the rows in the order of the key, `size` a file, and gives the files' names (K3); no rows, no file.

    Each shard is written by one task (at most `size` rows) into a folder beside the result and then renamed in the
    same file system; what fails before leaves nothing under the final names.
    """
    spark = df.sparkSession
    temp = f"{folder.rstrip('/')}/_writing-{prefix}"
    numbered_rows = shards(df, key, size)
    numbered_rows.repartition("shard").sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(temp)
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(temp)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(root):  # one folder a shard
        if status.isDirectory() and status.getPath().getName().startswith("shard="):
            parts = [f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise RuntimeError(f"{len(parts)} files in {status.getPath()}")
            found[int(status.getPath().getName().split("=")[1])] = parts[0]
    names = shard_names(len(found), prefix)
    for (_, part), name in zip(sorted(found.items()), names):
        if not fs.rename(part, path(f"{folder.rstrip('/')}/{name}")):
            raise RuntimeError(f"{name} could not be written")
    fs.delete(root, True)
    return names
