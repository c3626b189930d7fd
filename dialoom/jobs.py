"""The steps of the workflow as functions over folders: events, text, event and audio tokens, the dataset, batches.

Each reads what the step before wrote, leaves out what is done already if `resume` is set, and writes parquet (or JSON)
by Spark's committer, so a step that fails leaves no half-written output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.config import DataConfig
from dialoom.functions.labels import channel_map, require_known_labels
from dialoom.functions.plugins import BuiltinTokenizer, Codec, SyntheticCodec, Tokenizer, aligned_text, event_ids
from dialoom.operators import align, batch, dataset, frames, ticks, transcripts
from dialoom.sources import audio, files


def _units(words: DataFrame) -> DataFrame:
    """Words as files give them: the list as it is, a dialogue a file."""
    w = require_known_labels(words)
    return w.select(F.col("dialogue_id").alias("did"), F.col("word_idx").alias("idx"), "speaker", "word", "start", "end")


def _left(inputs: DataFrame, spark: SparkSession, done: str, resume: bool, key: str = "dialogue_id", valid: str | None = None) -> DataFrame:
    """Inputs without an output (S10), or without a valid one."""
    if not resume:
        return inputs
    try:
        return files.pending(inputs, spark.read.parquet(done), key, valid)
    except AnalysisException:  # nothing has been written yet
        return inputs


def generate_events(
    spark: SparkSession, text_dir: str, out: str, every: float = 0.5, channels: dict[str, int] | None = None, channel: int | None = None, limit: int | None = None,
    predictor: Callable[[Column], Column] = ticks.fallback, resume: bool = True,
) -> int:
    """Prediction events of transcripts in JSON, as JSON (CLI generate); gives how many were written. `limit` takes the
    first files in order. A unit that is done has a folder in `out`."""
    words = files.read_transcripts(spark, text_dir)
    if limit is not None:
        words = files.first_ids(words, limit)
    if resume:
        try:
            words = files.pending(words, spark.read.text(out).select("dialogue_id").distinct())
        except AnalysisException:
            pass
    x = ticks.events(_units(words), channel, every, predictor=predictor, channels=channels)
    return files.write_events(x.withColumnRenamed("did", "dialogue_id").withColumn("ord", F.col("timestamp_ms")), out)


def tokenize_text(spark: SparkSession, text_dir: str, out: str, tokenizer: Callable[[], Tokenizer] = BuiltinTokenizer, allow_missing_speakers: bool = False, allow_alignment_issues: bool = False, spaces: bool = True, rate: float = 12.5, pad: int = 3, end: int = 0, resume: bool = True) -> None:
    """Text streams of transcripts (CLI tokenize_text): dialogue_id, A, B. A dialogue of one speaker is an error, or left
    out if that is allowed; text that doesn't fit its tokens is an error, or placed as far as it fits."""
    t = transcripts.require_speakers(_units(_left(files.read_transcripts(spark, text_dir), spark, out, resume)), strict=not allow_missing_speakers)
    x = aligned_text(t, tokenizer, not allow_alignment_issues, spaces, rate, pad, end)
    sides = [F.max(F.when(F.col("speaker") == s, F.col("ids"))).alias(s) for s in dataset.SIDES]
    x.groupBy(F.col("did").alias("dialogue_id")).agg(*sides).write.mode("append").parquet(out)


def tokenize_audio(spark: SparkSession, audio_dir: str, out: str, codec: Callable[[], Codec] = SyntheticCodec, chunk_s: int = 1200, resume: bool = True) -> None:
    """Codes of stereo recordings (CLI tokenize_audio): dialogue_id, A, B."""
    _left(audio.tokenized_audio(spark, audio_dir, codec, chunk_s), spark, out, resume).write.mode("append").parquet(out)


def tokenize_events(spark: SparkSession, event_dir: str, audio: str, out: str, tokenizer: Callable[[], Tokenizer] | None = None, suffix: str = files.SUFFIX, channels: dict[str, int] | None = None, resume: bool = True) -> None:
    """The 14 event columns of each dialogue with tokenised audio (CLI tokenize_oracle). A dialogue without its event file
    is an error (J3). An output counts as done only if its offsets fit its positions (S11)."""
    numbers = channel_map(channels or {"A": 0, "B": 1})
    valid = " and ".join(f"size({s}_oracle_{k}_offsets) = size({s}_oracle_event_frame_pos) + 1" for s in dataset.SIDES for k in ("pred", "hint"))
    bounds = _left(spark.read.parquet(audio).select("dialogue_id", F.size(F.get("A", F.lit(0))).alias("num_frames")), spark, out, resume, valid=valid)
    raw = files.read_events(spark, event_dir, suffix, bounds)
    ids = {} if tokenizer is None else {"ids": lambda c: event_ids(c, tokenizer)}
    packed = align.packed_events(align.event_frames(raw, bounds, **ids), numbers)
    empty = {c: F.array(F.lit(0)) if "offsets" in c else F.array() for c in dataset.event_columns()}
    whole = bounds.select("dialogue_id").join(packed, "dialogue_id", "left")  # dialogues of which all events were dropped, too
    whole.select("dialogue_id", *[F.coalesce(c, e.cast(packed.schema[c].dataType)).alias(c) for c, e in empty.items()]).write.mode("append").parquet(out)


def prepare_dataset(spark: SparkSession, text: str, audio: str, out: str, events: str | None = None, prefix: str = "train", id_prefix: str | None = None, per_file: int = 100_000) -> list[str]:
    """The dataset's files (CLI prepare_dataset): text over audio for both speakers, events if given; ids that don't agree
    are an error."""
    read = spark.read.parquet
    rows = dataset.assembled(read(text), read(audio), read(events) if events else None, prefix=id_prefix)
    return files.write_shards(rows, out, prefix, size=per_file)


def examples(spark: SparkSession, patterns: list[str], specs: list[str], config: DataConfig) -> DataFrame:
    """Training examples of dataset files, each pattern with its own speakers (U3, D3-D9), numbered in order of their ids."""
    parts = []
    for pattern, spec in zip(patterns, specs):
        rows = dataset.speaker_rows(files.read_shards(spark, pattern), spec, events=config.use_events)
        keys = ("dialogue_id", "main_speaker", "streams")
        rows = frames.given_events(rows, *keys) if config.use_events else rows.withColumn("events", F.array().cast("array<struct<pos:int,i:int,ratio:float,forbid:tinyint,pred:array<int>,hint:array<int>>>"))
        parts.append(rows)
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = frames.training_examples(x, config.max_length, config.min_length)
    return x.withColumn("example_id", F.concat_ws("|", "dialogue_id", "main_speaker", F.lpad(F.col("chunk").cast("string"), 6, "0")))


def training_batches(spark: SparkSession, config: DataConfig, epoch: int = 0, step: int = 0) -> DataFrame:
    """Batches of an epoch (the data flags of finetune): examples in a new order each epoch, batches done by `step` left
    out, augmentation keyed by the epoch."""
    seed = f"{config.augmentation.seed}|{epoch}"
    aug = batch.Augmentation(**{**config.augmentation.__dict__, "seed": seed})
    x = examples(spark, config.train_files, config.train_speakers or ["A,B"] * len(config.train_files), config)
    x = batch.shuffled(x, seed).drop("example_id").withColumnRenamed("order_key", "example_id")
    hints = batch.hint_only(step, config.warmup_start, config.warmup_end, batch.uniform(seed, F.col("example_id"), "mode"), config.hint_only)
    out = batch.collated(x, config.batch_size, aug=aug, hints_only=hints)
    n = -(-x.count() // config.batch_size) if step else 0
    return batch.remaining(out, step, config.accumulate, n)


def eval_batches(spark: SparkSession, config: DataConfig) -> DataFrame:
    """Batches of the evaluation files, in order and without augmentation."""
    x = examples(spark, config.eval_files or [], [config.eval_speakers] * len(config.eval_files or []), config)
    return batch.collated(x, config.batch_size)
