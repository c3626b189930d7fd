"""Speaker labels and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like A and B, with what they stand for.
LOOKALIKES = ("АВаΑΒＡＢａｂ", "ABaABABab")


def side_of(label: Column) -> Column:
    """'A' or 'B' for any spelling of a speaker label, null for a missing or meaningless one.

    Known: a, speaker a, spk_a, sp. a, s-a, channel 0, ch0, 0, left, left channel and the like for A; the same
    with b, 1 and right for B. Case, brackets, blanks and punctuation don't matter.
    """
    plain = F.regexp_replace(F.lower(F.translate(label, *LOOKALIKES)), r"[^\p{L}\p{N}]", "")
    a = plain.rlike(r"^(?:(?:speaker|spk|sp|s|side|channel|chan|ch)?[a0]|l|(?:left|l)(?:channel|chan|ch)|left)$")
    b = plain.rlike(r"^(?:(?:speaker|spk|sp|s|side|channel|chan|ch)?[b1]|r|(?:right|r)(?:channel|chan|ch)|right)$")
    return F.when(a, "A").when(b, "B")


def without_repeats(df: DataFrame, key: list[str]) -> DataFrame:
    """Repeated rows count once. The key is composite, so a hot first part of it is spread over all tasks. Rows
    with a null in the key have no identity; of them, only equal ones count as repeats."""
    rest = [c for c in df.columns if c not in key]
    unknown = F.lit(False)
    for c in key:
        unknown = unknown | F.col(c).isNull()
    content = F.when(unknown, F.xxhash64(*rest) if rest else F.lit(0).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.withColumn("_content", content).dropDuplicates([*key, "_content"]).drop("_content")


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, rounded; NaN counts as missing."""
    return F.round(F.nanvl(seconds, F.lit(None).cast("double")) * 1000).cast("long")

# Fixed value: the white space that stripping takes away, beyond blanks.
SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def strip(text: Column) -> Column:
    """A text without outer white space of any kind; null is an empty text (P10)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")


def unknown_labels(words: DataFrame) -> DataFrame:
    """Labels that name no speaker: dialogue_id, label, n (P3). A null label counts as ''."""
    label = F.coalesce("speaker", F.lit(""))
    return words.filter(side_of(F.col("speaker")).isNull()).groupBy("dialogue_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def require_known_labels(words: DataFrame) -> DataFrame:
    """The rows, or an error naming the label and dialogue of a row whose label names no speaker."""
    side = side_of(F.col("speaker"))
    wrong = F.concat(F.lit("not a speaker: '"), F.coalesce("speaker", F.lit("null")), F.lit("' in "), F.coalesce("dialogue_id", F.lit("null")))
    return words.withColumn("speaker", F.when(side.isNotNull(), side).otherwise(F.raise_error(wrong)))


def channel_map(channels: dict[str, int]) -> dict[str, int]:
    """The channel of each speaker, checked: exactly A and B, on different channels."""
    if set(channels) != {"A", "B"}:
        raise ValueError(f"channels are needed for A and B, not for {sorted(channels)}")
    if channels["A"] == channels["B"]:
        raise ValueError("both speakers have the same channel")
    return dict(channels)
