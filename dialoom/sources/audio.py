"""Stereo recordings as codec codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.plugins import Codec, SyntheticCodec, channel_codes


def read_samples(content: bytes, rate: int):
    """The two channels of a PCM wav file as numbers in [-1, 1) at `rate`; another number of channels is an error.
    Another rate is changed by linear interpolation."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(content)) as w:
        channels, width, own, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        raw = w.readframes(n)
    if channels != 2:
        raise ValueError(f"stereo is needed, not {channels} channels")
    if width == 1:
        x = np.frombuffer(raw, "u1").astype("f4") / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)).astype("f4") / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype("f4") / 2 ** (8 * width - 1)
    both = x.reshape(-1, 2).T
    if own == rate or not both.shape[1]:
        return both
    at = np.arange(int(np.ceil(both.shape[1] * rate / own))) * (own / rate)
    return np.stack([np.interp(at, np.arange(both.shape[1]), c) for c in both])


def tokenized_audio(spark: SparkSession, folder: str, factory: Callable[[], Codec] = SyntheticCodec, chunk_s: int = 1200) -> DataFrame:
    """dialogue_id, A, B: codes [codebook][frame] of the left and right channel of each wav file of a folder; other files
    are ignored. A file is one task's work at a time; a file that isn't stereo is an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")

    def encode(batches):
        import pandas as pd

        codec = factory()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    both = [channel_codes(codec, c, chunk_s) for c in read_samples(content, codec.sample_rate)]
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pd.DataFrame([(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], *both)], columns=["dialogue_id", "A", "B"])

    return raw.mapInPandas(encode, "dialogue_id string, A array<array<int>>, B array<array<int>>")


def synthetic_audio(t: DataFrame, codebooks: int = 8, rate: float = 12.5) -> DataFrame:
    """did, speaker, codes [codebook][frame] for transcripts without recordings: one second longer than the last word of
    the unit, codes made of frame, codebook and speaker. Built-in expressions only."""
    ends = t.groupBy("did").agg(F.ceil((F.max("end") + 1) * rate).cast("int").alias("n")).withColumn("speaker", F.explode(F.array(F.lit("A"), F.lit("B"))))
    side = F.when(F.col("speaker") == "A", 0).otherwise(3)
    row = lambda k: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda f: ((f * 31 + k * 17 + side) % 2048).cast("int"))
    return ends.filter("n > 0").select("did", "speaker", F.transform(F.sequence(F.lit(0), F.lit(codebooks - 1)), row).alias("codes"))
