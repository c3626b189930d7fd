"""Assembly of the dataset from tokenised text, audio and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.batch import speaker_spec
from dialoom.operators.frames import main_streams, merge_text_audio

SIDES = ("A", "B")
EVENT_COLUMNS = ("event_frame_pos", "event_ratio", "event_skip_forbid", "pred_values", "pred_offsets", "hint_values", "hint_offsets")


def event_columns(speakers: list[str] | tuple[str, ...] = SIDES) -> list[str]:
    """Names of the event columns of the given speakers, seven each."""
    return [f"{s}_oracle_{c}" for s in speakers for c in EVENT_COLUMNS]


def require_event_columns(df: DataFrame, speakers: list[str] | tuple[str, ...] = SIDES) -> DataFrame:
    """The rows, or a KeyError naming the first eight event columns that the speakers lack."""
    lacking = [c for c in event_columns(speakers) if c not in df.columns]
    if lacking:
        raise KeyError(f"event columns are missing: {lacking[:8]}")
    return df


def require_ids(inputs: DataFrame, lookup: DataFrame, what: str, key: str = "dialogue_id", named: int = 8) -> DataFrame:
    """Inner join of each row of `inputs` with its row of `lookup`; ids without one are an error naming some of them.
    The ids are compared first, as an error within the join could be optimised away with the rows it is about."""
    rows = inputs.select(key).distinct().join(lookup.select(key), key, "left_anti").orderBy(key).limit(named).collect()
    if rows:
        raise ValueError(f"{what} is missing for {', '.join(str(r[0]) for r in rows)}")
    return inputs.join(lookup, key)


def require_same_ids(text: DataFrame, audio: DataFrame, events: DataFrame | None = None, key: str = "dialogue_id", named: int = 8) -> None:
    """An error naming some ids if text has no audio, audio no text, or text no events (J2); ids that only the events
    have are fine. Compares ids only."""
    pairs = [("audio", text, audio), ("text", audio, text)] + ([("events", text, events)] if events is not None else [])
    for what, a, b in pairs:
        rows = a.select(key).distinct().join(b.select(key), key, "left_anti").orderBy(key).limit(named).collect()
        if rows:
            raise ValueError(f"{what} missing for {[r[0] for r in rows]}")


def path_id(prefix: str | None, name: Column) -> Column:
    """The id of a dataset row: its name under a prefix (F8)."""
    return F.concat_ws("/", F.lit(prefix), name) if prefix else name


def assembled(text: DataFrame, audio: DataFrame, events: DataFrame | None = None, key: str = "dialogue_id", prefix: str | None = None, strict: bool = True, pad: int = 3) -> DataFrame:
    """Rows of the dataset: key, A and B (text over its audio rows) and, if given, the 14 event columns.

    `text` has A and B as arrays of ids, `audio` A and B as matrices, each key once. Strict: the ids must agree
    (require_same_ids). Rows are joined on the key; nothing else is moved.
    """
    if strict:
        require_same_ids(text, audio, events, key)
    t = text.select(key, *[F.col(s).alias(f"_t{s}") for s in SIDES])
    a = audio.select(key, *[F.col(s).alias(f"_a{s}") for s in SIDES])
    x = t.join(a, key)
    if events is not None:
        x = x.join(require_event_columns(events).select(key, *event_columns()), key)
    sides = [merge_text_audio(F.col(f"_t{s}"), F.col(f"_a{s}"), pad).alias(s) for s in SIDES]
    return x.select(path_id(prefix, F.col(key)).alias(key), *sides, *(event_columns() if events is not None else []))


def speaker_rows(rows: DataFrame, speakers: str = "A,B", key: str = "dialogue_id", codebooks: int = 8, events: bool = True) -> DataFrame:
    """One row per requested main speaker (J7, D3): key, main_speaker, streams (own rows, then the other's audio) and
    the speaker's own seven event columns as oracle_*. Both sides stand in one row, so nothing is joined."""
    wanted = speaker_spec(speakers)
    if events:
        require_event_columns(rows, wanted)
    fields = lambda s: [F.lit(s).alias("main_speaker"), main_streams(F.col(s), F.col("B" if s == "A" else "A"), codebooks).alias("streams"), *([F.col(f"{s}_oracle_{c}").alias(f"oracle_{c}") for c in EVENT_COLUMNS] if events else [])]
    return rows.select(key, F.explode(F.array(*[F.struct(*fields(s)) for s in wanted])).alias("_s")).select(key, "_s.*")
