"""Registered queries of the core and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions.labels import strip, unknown_labels
from dialoom.functions.tokenize import text_ids
from dialoom.operators import align, batch, dataset, frames, metrics, ticks, transcripts
from dialoom.plans import oracle
from dialoom.session import prefix_session, read_table
from dialoom.sources import audio, files

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark, d, by_call=False):
    return transcripts.transcript(read_table(spark, d, "words"), 60.0 if by_call else None)


def _examples(spark, d):
    return read_table(spark, d, "examples", wide=True).filter("example_id is not null")


def _rows(df, *cols):
    """A stream matrix as one line per row: its length and a checksum."""
    return df.select(*cols, F.posexplode("streams").alias("row_no", "r")).select(*cols, "row_no", F.size("r").alias("len"), F.md5(F.array_join(F.transform("r", lambda v: v.cast("string")), ",")).alias("sum_md5"))


@query
def p2_found(spark, d):
    from dialoom.operators.intervals import speech_periods

    return speech_periods(read_table(spark, d, "words"))


@query
def words(spark, d):
    return _t(spark, d).select("did", "idx", "speaker", "word", F.col("start").alias("start_t"), F.col("end").alias("end_t"))


@query
def speaker_coverage(spark, d):
    return transcripts.speaker_coverage(_t(spark, d))


@query
def merged_word_streams(spark, d):
    return transcripts.merged_streams(_t(spark, d)).select("did", "pos", "speaker", "word")


@query
def speaker_runs(spark, d):
    return transcripts.speaker_runs(_t(spark, d))


@query
def spoken_ratio(spark, d):
    return transcripts.spoken_ratio(_t(spark, d))


@query
def word_frames(spark, d):
    return _t(spark, d).select("did", "idx", transcripts.frame_of(F.col("start")).alias("frame"))


@query
def oracle_ticks(spark, d):
    return ticks.ticks(_t(spark, d), hint=False, context=False).select("did", "k", "n_so_far", "trigger_word", "speaker", "recent_words", "ratio")


@query
def conversation_context(spark, d):
    return ticks.ticks(_t(spark, d, by_call=True), hint=False).select("did", "k", "context")


@query
def next_utterance_hint(spark, d):
    return ticks.ticks(_t(spark, d), texts=False, context=False).select("did", "k", "hint")


@query
def oracle_events(spark, d):
    """Of whole dialogues, as the list of words is; each context holds all words so far, and is written as what it adds
    to the one before."""
    return ticks.events(_t(prefix_session(spark, "conversation_context"), d))


@query
def oracle_events_by_call(spark, d):
    """A line that records call after call is cut where it is silent for a minute, so contexts restart with each call."""
    return ticks.events(_t(spark, d, by_call=True))


@query
def target_channel_events(spark, d):
    return ticks.events(_t(spark, d), channel=1).select("did", "timestamp_ms", "hint", "channel")


@query
def prompt_bands(spark, d):
    return ticks.ticks(_t(spark, d), hint=False, texts=False, context=False).select("did", "k", ticks.prompt_band(F.col("ratio")).alias("band"))


@query
def prompts(spark, d):
    """What a model is asked at each tick, by its hash."""
    x = ticks.ticks(_t(spark, d, by_call=True)).withColumn("request", ticks.request())
    return x.select("did", "k", F.md5(ticks.prompt(F.col("request"))).alias("prompt_md5"))


@query
def character_timing(spark, d):
    return align.character_times(_t(spark, d, by_call=True)).groupBy("did", "speaker").agg(F.count(F.lit(1)).alias("n_chars"), F.sum(F.round(F.col("ch_start") * 1000).cast("long")).alias("sum_ms"))


@query
def text_frames(spark, d):
    """Tokens of the speakers whose frames never fall back, which are placed in closed form."""
    x = align.token_frames(_t(spark, d, by_call=True)).filter("not folded")
    return x.select("did", "speaker", "idx", "part", "token_id", "frame", "slot", "end_mark", "num_frames")


@query
def text_token_frames(spark, d):
    return align.token_frames(_t(spark, d, by_call=True))


@query
def text_streams(spark, d):
    x = align.text_streams(_t(spark, d, by_call=True))
    return x.select("did", "speaker", F.size("ids").alias("n"), F.md5(_text("ids")).alias("ids_md5"))


@query
def audio_codes(spark, d):
    """Codes of the codec that stands in for a trained one, for transcripts without recordings."""
    x = audio.synthetic_audio(_t(spark, d, by_call=True))
    return x.select("did", "speaker", F.posexplode("codes").alias("codebook", "r")).select("did", "speaker", "codebook", F.size("r").alias("n"), F.md5(_text("r")).alias("codes_md5"))


@query
def speaker_domain(spark, d):
    return unknown_labels(read_table(spark, d, "words").select("dialogue_id", "word_idx", "speaker").distinct())


@query
def event_frames(spark, d):
    """Events of both channels, bounded by the dialogue's audio: a second longer than its last word."""
    x = align.event_frames(read_table(spark, d, "oracle_raw"), _audio_frames(spark, d))
    return x.select("dialogue_id", "channel", "ord", "frame_pos", "ratio", "skip_forbid", _text("pred_ids").alias("pred_ids"), _text("hint_ids").alias("hint_ids"))


def _audio_frames(spark, d):
    w = read_table(spark, d, "words").filter("end_s is not null and dialogue_id is not null")
    return w.groupBy("dialogue_id").agg(F.ceil((F.max("end_s") + 1) * 12.5).cast("int").alias("num_frames"))


@query
def packed_channel_events(spark, d):
    x = align.packed_events(align.event_frames(read_table(spark, d, "oracle_raw"), _audio_frames(spark, d)))
    return x.select("dialogue_id", *[F.size(c).alias(c) if "ratio" in c else F.md5(_text(c)).alias(c) for c in dataset.event_columns()])


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def _sides(spark, d):
    """Tokenised text, audio and events of the examples' two sides, as if read from separate files. The other side's
    text is unknown, so it is empty; it has no events."""
    x = _examples(spark, d).dropDuplicates(["example_id"]).filter("size(streams[0]) > 0 and main_speaker in ('A', 'B')").withColumn("id", F.concat_ws("-", "dialogue_id", F.col("example_id").cast("string")))
    main = F.col("main_speaker")
    own, none = F.get("streams", F.lit(0)), F.array().cast("array<int>")
    text = x.select("id", *[F.when(main == s, own).otherwise(none).alias(s) for s in "AB"])
    sound = x.select("id", *[F.when(main == s, F.slice("streams", 2, 8)).otherwise(F.slice("streams", 10, 8)).alias(s) for s in "AB"])
    empty = {"event_ratio": F.array().cast("array<float>"), "event_skip_forbid": F.array().cast("array<tinyint>"), "pred_offsets": F.array(F.lit(0)), "hint_offsets": F.array(F.lit(0))}
    events = x.select("id", *[F.when(main == s, F.col(f"oracle_{c}")).otherwise(empty.get(c, none)).alias(f"{s}_oracle_{c}") for s in "AB" for c in dataset.EVENT_COLUMNS])
    return text, sound, events


@query
def assembled_rows(spark, d):
    x = dataset.assembled(*_sides(spark, d), key="id", prefix="set")
    return x.select("id", *[F.md5(F.array_join(F.transform(s, _text), ";")).alias(s) for s in "AB"], *[F.size(c).alias(c) if "ratio" in c else F.md5(_text(c)).alias(c) for c in dataset.event_columns()])


@query
def speaker_examples(spark, d):
    """The assembled rows as one row per main speaker."""
    x = dataset.speaker_rows(dataset.assembled(*_sides(spark, d), key="id"), "B,A", "id")
    return x.select("id", "main_speaker", F.size("streams").alias("n_rows"), F.md5(F.array_join(F.transform("streams", _text), ";")).alias("streams_md5"), F.md5(_text("oracle_event_frame_pos")).alias("pos_md5"), F.md5(_text("oracle_hint_values")).alias("hints_md5"))


@query
def aligned_events(spark, d):
    x = _as_given(_examples(spark, d).dropDuplicates(["example_id"]))
    length = F.size(F.get(frames.delayed(F.col("streams")), 0))
    return x.select("example_id", F.explode(frames.aligned(F.col("events"), length)).alias("e")).select("example_id", F.col("e.i").alias("event"), "e.pos", *_ids())


@query
def text_audio_merge(spark, d):
    """The main speaker's text fitted to its audio rows and laid over them."""
    x = _examples(spark, d).dropDuplicates(["example_id"])
    return _rows(x.select("example_id", frames.merge_text_audio(F.get("streams", 0), F.slice("streams", 2, 8)).alias("streams")), "example_id")


@query
def undelayed_streams(spark, d):
    return _rows(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", frames.undelayed(F.col("streams")).alias("streams")), "example_id")


@query
def delayed_streams(spark, d):
    return _rows(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", frames.delayed(F.col("streams")).alias("streams")), "example_id")


@query
def main_speaker_streams(spark, d):
    """Own rows and the other's audio of an example, taken apart and put together again."""
    x = _examples(spark, d).dropDuplicates(["example_id"])
    other = F.concat(F.slice("streams", 1, 1), F.slice("streams", 10, 8))
    return _rows(x.select("example_id", frames.main_streams(F.slice("streams", 1, 9), other).alias("streams")), "example_id")


@query
def labels(spark, d):
    return _rows(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", frames.labels(F.col("streams")).alias("streams")), "example_id")


@query
def chunk_bounds(spark, d):
    x = _examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.explode(frames.chunk_bounds(F.size(F.get("streams", 0)), 512)).alias("c"))
    return x.select("example_id", "c.chunk", "c.start", "c.len")


@query
def chunked_events(spark, d):
    x = frames.chunked(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", "streams", "oracle_event_frame_pos"), 512)
    return x.select("example_id", "chunk", "num_frames", F.array_join(F.transform("oracle_event_frame_pos", lambda v: v.cast("string")), ",").alias("pos"))


@query
def min_length_filter(spark, d):
    x = frames.chunked(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", "streams", "oracle_event_frame_pos"), 256)
    return x.filter("num_frames >= 128").groupBy("example_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("num_frames").alias("n_frames"))


@query
def training_examples(spark, d):
    """The preprocessing chain (D9): an example's rows are its main speaker's view already (D3)."""
    x = _as_given(_examples(spark, d).dropDuplicates(["example_id"]).filter("size(streams[0]) > 0"))
    other = F.concat(F.slice("streams", 1, 1), F.slice("streams", 10, 8))
    x = x.select("example_id", frames.main_streams(F.slice("streams", 1, 9), other).alias("streams"), "events")
    x = frames.training_examples(x, 512, 128)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    sums = lambda c: F.md5(F.array_join(F.transform(c, text), ";"))
    lists = {k: F.col(f"events.{k}") for k in ("pos", "ratio", "forbid", "pred", "hint")}
    packed = {f"{k}_{part}": text(c) for k in ("pred", "hint") for part, c in (("values", F.flatten(lists[k])), ("offsets", frames.packed_offsets(lists[k])))}
    return x.select("example_id", "chunk", "num_streams", "num_frames", sums("streams").alias("streams_md5"), sums("labels").alias("labels_md5"), text(lists["pos"]).alias("pos"), lists["ratio"].alias("ratio"), text(lists["forbid"]).alias("skip_forbid"), *[c.alias(k) for k, c in packed.items()])


@query
def ragged_unpack(spark, d):
    x = _examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.posexplode(frames.unpacked(F.col("oracle_pred_values"), F.col("oracle_pred_offsets"))).alias("event", "ids"))
    return x.select("example_id", "event", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query
def ragged_pack(spark, d):
    x = _examples(spark, d).dropDuplicates(["example_id"]).withColumn("lists", frames.unpacked(F.col("oracle_hint_values"), F.col("oracle_hint_offsets")))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return x.select("example_id", joined(F.flatten("lists")).alias("packed_values"), joined(frames.packed_offsets(F.col("lists"))).alias("packed_offsets"))


def _events(x):
    """Events of the examples as structs in order of their frame."""
    zipped = F.zip_with(
        frames.unpacked(F.col("oracle_pred_values"), F.col("oracle_pred_offsets")),
        frames.unpacked(F.col("oracle_hint_values"), F.col("oracle_hint_offsets")),
        lambda p, h: F.struct(p.alias("pred"), h.alias("hint")),
    )
    e = F.transform(zipped, lambda z, i: F.struct(F.get("oracle_event_frame_pos", i).alias("pos"), i.alias("i"), F.get("oracle_event_ratio", i).alias("ratio"), F.get("oracle_event_skip_forbid", i).alias("forbid"), z.pred.alias("pred"), z.hint.alias("hint")))
    return x.withColumn("events", F.array_sort(F.filter(e, lambda z: z.pos.isNotNull())))


def _as_given(x):
    """Events of the examples as structs in the order of the table, their ids unpacked."""
    return frames.given_events(x, "example_id", "streams")


def _ids():
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return [F.col("e.ratio").alias("ratio"), F.col("e.forbid").alias("skip_forbid"), text("e.pred").alias("pred"), text("e.hint").alias("hint")]


@query
def oracle_frame_stream(spark, d):
    x = _events(_examples(spark, d).dropDuplicates(["example_id"]))
    return batch.event_writes(x, F.size(F.get("streams", 0)))


@query
def skip_and_jitter(spark, d):
    x = _events(_examples(spark, d).dropDuplicates(["example_id"]))
    return batch.event_writes(x, F.size(F.get("streams", 0)), aug=batch.Augmentation(seed="7", skip=(0.1, 0.7), jitter=2))


@query
def shifted_oracle(spark, d):
    """The dense event stream, moved for four examples in five."""
    x = _events(_examples(spark, d).dropDuplicates(["example_id"]).filter("size(streams[0]) > 0")).withColumn("t", F.size(F.get("streams", 0)))
    aug = batch.Augmentation(seed="7", shift_prob=0.8)
    w = x.select("example_id", "t", batch.frame_writes(F.col("events"), F.col("t"), F.col("example_id"), aug=aug).alias("w")).withColumn("w", batch.latest("w"))
    moved = batch.maybe_shifted(batch.dense("w", F.col("t")), aug, F.col("example_id"))
    return w.select("example_id", "t", F.md5(_text(moved)).alias("sum_md5"))


@query
def collated_batch(spark, d):
    x = _events(_examples(spark, d).dropDuplicates(["example_id"]).filter("size(streams[0]) > 0"))
    b = batch.collated(x.select("example_id", "streams", "labels", "events"), 8)
    sums = {"input_ids": F.array_join(F.transform("input_ids", _text), ";"), "labels": F.array_join(F.transform("labels", _text), ";"), "text_mask": _text("text_mask"), "oracle_tokens": _text("oracle_tokens")}
    return b.select("batch_id", "pos_in_batch", "example_id", "longest", *[F.md5(c).alias(k) for k, c in sums.items()])


@query
def training_order(spark, d):
    """Examples in the order of an epoch, the batches that a resumed run has left."""
    x = batch.shuffled(_examples(spark, d).select("example_id").distinct(), "7")
    return batch.remaining(batch.batches(x, 8, "order_key"), 9, 2, 5).select("example_id", "batch_id", "pos_in_batch")


@query
def token_dropout(spark, d):
    """Of the text row, the only one that drops tokens."""
    x = _examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.get("streams", 0).alias("r"))
    kept = batch.dropout(F.col("r"), 0.2, (3, 0, 32000), "7", F.col("example_id"))
    return x.select("example_id", F.size(F.filter(kept, lambda v: v == 3)).alias("n_pad"))


@query
def curriculum_mode(spark, d):
    x = _examples(spark, d).select("example_id").distinct()
    steps = F.explode(F.array(*[F.lit(s) for s in (0, 250, 500, 750, 1000)]))
    return x.withColumn("step", steps).select("example_id", "step", batch.hint_only(F.col("step"), 0, 1000, batch.uniform("7", F.col("example_id"), "mode")).alias("hint_only"))


@query
def batch_padding(spark, d):
    x = batch.batches(_examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.size(F.get("streams", 0)).alias("n")), 8)
    longest = F.max("n").over(Window.partitionBy("batch_id"))
    x = x.withColumn("longest", longest)
    total = F.aggregate(batch.mask(F.col("n"), F.col("longest"), -1), F.lit(0), lambda a, v: a + v)
    return x.select("example_id", "batch_id", "pos_in_batch", "n", "longest", total.alias("mask_sum"))


@query
def missing_ids(spark, d):
    return files.missing(read_table(spark, d, "words").select("dialogue_id"), read_table(spark, d, "dialogues").select("dialogue_id"), "dialogue_id", "words", "dialogues")


@query
def resume_pending(spark, d):
    return files.pending(read_table(spark, d, "dialogues").select("dialogue_id").distinct(), read_table(spark, d, "examples"), valid="streams is not null and size(oracle_pred_offsets) = size(oracle_event_frame_pos) + 1")


@query
def first_dialogues(spark, d):
    return files.first_ids(read_table(spark, d, "dialogues").select("dialogue_id", "lang").distinct(), 10)


@query
def event_json(spark, d):
    """The events of each dialogue as they are written, by their hash."""
    x = ticks.events(_t(spark, d, by_call=True))
    x = files.event_json(x.withColumn("dialogue_id", F.col("did")).withColumn("ord", F.col("timestamp_ms")))
    parsed = F.from_json("value", files.EVENTS)
    return x.select("dialogue_id", F.col("n").cast("long").alias("n"), F.size(parsed).cast("long").alias("n_read"), F.md5(F.array_join(F.transform(parsed, lambda e: F.concat_ws("|", e.timestamp_ms.cast("string"), e.prediction, e.channel.cast("string"), e.hint)), "\n")).alias("events_md5"))


@query
def shard_assignment(spark, d):
    return files.shards(read_table(spark, d, "dialogues").select("dialogue_id").distinct(), "dialogue_id", 30)


@query
def dataset_rows(spark, d):
    """Words, events and examples of a dialogue side by side, counted (J1); assembled_rows has the rows themselves."""
    key = "dialogue_id"
    a = read_table(spark, d, "words").select(key, "word_idx").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_words"))
    b = read_table(spark, d, "oracle_raw").select(key, "ord").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    c = read_table(spark, d, "examples").select(key, "example_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_examples"))
    return a.join(b, key).join(c, key)


@query
def masked_loss_metrics(spark, d):
    x = _examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.posexplode(F.get("labels", 0)).alias("frame", "label"))
    u = batch.uniform(F.col("example_id"), F.col("frame"), "nll")
    losses = x.select((F.col("example_id") % 5).alias("step"), "label", (u * 4).alias("nll"), F.when(u < 0.4, 1.0).otherwise(0.0).alias("hit"))
    m = metrics.combined_text(metrics.text_loss(losses))
    return m.select("step", *[F.round(c, 9).alias(c) for c in ("nonpad_loss", "nonpad_acc", "pad_loss", "text_loss")], "n_nonpad", "n_pad")


@query
def masked_loss_total(spark, d):
    """All label rows of a synthetic loss table; the text row has the losses of masked_loss_metrics."""
    x = _examples(spark, d).dropDuplicates(["example_id"]).select("example_id", F.posexplode("labels").alias("label_row", "r")).select("example_id", "label_row", F.posexplode("r").alias("frame", "label"))
    u = F.when(F.col("label_row") == 0, batch.uniform(F.col("example_id"), F.col("frame"), "nll")).otherwise(batch.uniform(F.col("example_id"), F.col("frame"), F.col("label_row"), "nll"))
    losses = x.select((F.col("example_id") % 5).alias("step"), "label_row", "label", u.alias("u")).select("step", "label_row", "label", (F.col("u") * 4).alias("nll"), F.when(F.col("u") < 0.4, 1.0).otherwise(0.0).alias("hit"))
    m = metrics.total_loss(losses)
    return m.select("step", *[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in m.dtypes if c != "step"])


@query
def nanmean_metrics(spark, d):
    x = read_table(spark, d, "oracle_raw").select("dialogue_id", "ord", "channel", "current_spoken_ratio").distinct()
    v = F.when(F.col("ord") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("current_spoken_ratio"))
    m = metrics.nan_mean(x.select(F.coalesce("channel", F.lit(0)).cast("string").alias("key"), v.alias("value")))
    return m.select("key", F.round("mean_value", 9).alias("mean_value"), "n")


@query
def embedding_stats(spark, d):
    m = metrics.embedding_covariance(read_table(spark, d, "embeddings"))
    return m.select("i", "j", F.round("cov", 8).alias("cov"), F.round("mean_i", 8).alias("mean_i"))


@query
def token_timing(spark, d):
    x = align.token_times(_t(spark, d, by_call=True))
    return x.select("did", "speaker", "idx", "part", "token_id", F.round(F.col("tok_start") * 1e6).cast("long").alias("start_us"), F.round(F.col("tok_end") * 1e6).cast("long").alias("end_us"))


@query
def prediction_ids(spark, d):
    x = read_table(spark, d, "oracle_raw").select("dialogue_id", "ord", "prediction").dropDuplicates(["dialogue_id", "ord"])
    return x.select("dialogue_id", "ord", F.array_join(F.transform(text_ids(strip(F.col("prediction"))), lambda v: v.cast("string")), ",").alias("ids"))


@query
def per_file_speakers(spark, d):
    x = read_table(spark, d, "dialogues").select("dialogue_id", "service").distinct()
    return align.by_file_speakers(x, "service", {"rail": "A", "taxi": "B"}, "A,B")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(oracle.SQL)
