"""Prediction events on a grid of ticks.

Between two arrivals of words nothing changes, so everything is worked out once per state (the ticks from one arrival to
the next) and the ticks are listed at the end. A state is known by its unit and the tick at which it begins, so a long
unit spreads over all tasks. What it needs of its words is little: how many have come, the last one in list order of each
speaker (running sums and maxima), and the few that have been passed in the list but end later. Only a context holds all
words so far, as it must; it is cut from its unit's text up to there, which a long unit has once for each part of PART bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import channel_map, strip
from dialoom.operators.sequence import BUCKET, MIN_ROWS, Ranges, across, find_ranges, running
from dialoom.operators.transcripts import in_ranges, run_columns
from dialoom.session import checkpointed


#: Bytes of a unit's text whose contexts are made together.
PART = 100_000


def arrival(end: Column, every: float) -> Column:
    """The first tick k >= 1 with end <= k * every, exact where the division rounds."""
    k = F.ceil(end / every)
    exact = F.when((k - 1) * F.lit(every) >= end, k - 1).when(k * F.lit(every) < end, k + 1).otherwise(k)
    return F.greatest(exact, F.lit(1)).cast("int")


def _piece() -> Column:
    """What a word adds to its unit's text: a new line and the speaker's name where a run begins."""
    lead = F.concat(F.when(F.col("idx") == 0, "").otherwise("\n"), "speaker", F.lit(": "), "word")
    return F.when(F.col("starts"), lead).otherwise(F.concat(F.lit(" "), "word"))


def _before() -> Column:
    """Bytes of the unit's text before a word."""
    return F.col("upto") - F.octet_length(_piece())


def _words(t: DataFrame, every: float) -> tuple[DataFrame, Ranges]:
    """Words with their arrival, `upto` (bytes of the unit's text up to and with it) and `earliest` (first arrival of
    a word listed later). Words of a unit in ranges are kept (checkpoint) first, as each pass over ranges reads them twice."""
    ranges = in_ranges(t)[1]
    t = t.drop("start")
    t = checkpointed(t) if ranges.split else t
    t._ranges = ranges
    x, _ = run_columns(t, piece=_piece(), arrives=arrival(F.col("end"), every))
    return x.drop(BUCKET, "piece", "run_from"), ranges


def _states(words: DataFrame, ranges: Ranges, every: float, min_rows: int) -> tuple[DataFrame, Ranges]:
    """States with at least two words: did, ka, until (the tick after its last one), n_so_far, lw (the last word in list
    order) and other (the last idx of the other speaker, -1 if none). The last arrival of a unit begins no state, as the
    ticks end before it."""
    lw = F.struct("idx", "speaker", "word", "end", "fwd", "run_no", "last_of_run", "upto", _before().alias("before"))
    arrivals = words.groupBy("did", "ka").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("speaker") == s, lw)).alias(s) for s in "AB"])
    by_time = find_ranges(words, ["did"], "ka", min_rows) if ranges.split else Ranges(["did"], "ka")
    x = by_time.assign(arrivals, "ka")
    x = across(x, by_time, ["ka"], sums={"n_so_far": ("sum", F.col("n")), "_A": ("max", F.col("A")), "_B": ("max", F.col("B"))}, after={"until": "ka"})
    last = F.greatest("_A", "_B")
    other = F.coalesce(F.least("_A.idx", "_B.idx"), F.lit(-1))
    other = F.when(F.col("_A").isNull() | F.col("_B").isNull(), -1).otherwise(other)
    return x.filter("n_so_far >= 2 and until is not null").select("did", "ka", BUCKET, "until", "n_so_far", last.alias("lw"), other.alias("other")), by_time


def _with_late(states: DataFrame, words: DataFrame) -> DataFrame:
    """Adds `late`, the words passed in the list that haven't come yet, and `after`, those listed before the last word
    that end after it, both in list order. Words meet the states by (unit, tick)."""
    item = F.struct("idx", "speaker", "word", _before().alias("before"), "starts", "end")
    late = words.filter("earliest < ka").select("did", F.explode(F.sequence("earliest", F.col("ka") - 1)).alias("ka"), item.alias("w"), F.lit(True).alias("late"))
    same = words.filter("earliest <= ka").select("did", "ka", item.alias("w"), F.lit(False).alias("late"))
    met = late.unionByName(same).join(states.select("did", "ka", "lw"), ["did", "ka"]).filter("w.idx < lw.idx and (late or w.end > lw.end)")
    lists = met.groupBy("did", "ka").agg(F.array_sort(F.collect_list(F.when(F.col("late"), F.col("w")))).alias("late"), F.array_sort(F.collect_list(F.when(F.col("w.end") > F.col("lw.end"), F.col("w")))).alias("after"))
    none = F.array().cast(lists.schema["late"].dataType)
    return states.join(lists, ["did", "ka"], "left").withColumns({c: F.coalesce(c, none) for c in ("late", "after")})


def _with_hint(states: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the hint (W5): of the words that end after the last one, in list order, the first block of the other speaker.

    Words listed before the last one come first (`after` of the state in which the last word came); then the list goes
    on behind it, where all words end later: the other's next words there are the next run.
    """
    arrived = states.groupBy("did", "lw.idx").agg(F.min_by("after", "ka").alias("after"), F.min_by("lw", "ka").alias("lw"))
    runs = words.groupBy("did", (F.col("run_no") - 1).alias("run_no")).agg(F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("_r")).select("did", "run_no", F.array_join("_r.word", " ").alias("next_run"))
    x = arrived.withColumn("run_no", F.col("lw.run_no")).join(runs, ["did", "run_no"], "left")
    begun = F.struct(F.lit(False).alias("found"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("ws"))
    theirs = lambda w: w.speaker != F.col("lw.speaker")
    step = lambda a, w: F.when(a.done, a).when(theirs(w), F.struct(F.lit(True).alias("found"), F.lit(False).alias("done"), F.concat(a.ws, F.array(w.word)).alias("ws"))).otherwise(F.struct(a.found.alias("found"), a.found.alias("done"), a.ws.alias("ws")))
    x = x.withColumn("_a", F.aggregate("after", begun, step))
    goes_on = ~F.col("_a.done") & (F.col("lw.last_of_run") | ~F.col("_a.found")) & F.col("next_run").isNotNull()
    words_of = F.concat(F.col("_a.ws"), F.when(goes_on, F.array("next_run")).otherwise(F.array().cast("array<string>")))
    hints = x.select("did", "idx", F.array_join(words_of, " ").alias("hint"))
    return states.withColumn("idx", F.col("lw.idx")).join(hints, ["did", "idx"]).drop("idx")


def _with_texts(states: DataFrame, words: DataFrame, recent: int, context: bool) -> DataFrame:
    """Adds recent_words (W6) and, if asked for, context (W1). The words near the state's end meet it by (unit, number):
    the last `recent` that have come, and all behind the first late one."""
    first_late = F.get("late", F.lit(0))
    low = F.greatest(F.col("lw.idx") - (recent - 1) - F.size("late"), F.lit(0))
    if context:
        low = F.least(low, F.coalesce(first_late.idx, low))
    come = F.array_except(F.sequence(low, F.col("lw.idx")), F.transform("late", lambda w: w.idx))
    wanted = states.select("did", "ka", F.explode(come).alias("idx"))
    near = wanted.join(words.select("did", "idx", "speaker", "word"), ["did", "idx"]).groupBy("did", "ka").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "word"))).alias("near"))
    x = states.join(near, ["did", "ka"], "left")  # every state has its own; a left join is left out where nothing reads the texts
    x = x.withColumn("recent_words", F.array_join(F.transform(F.slice("near", -F.least(F.lit(recent), F.size("near")), recent), lambda w: w.word), " "))
    if not context:
        return x.drop("near")
    tail = F.filter("near", lambda w: w.idx >= first_late.idx)
    # Behind the first late word the lines are put together anew; the speaker before it is known from whether it began a run.
    before = F.when(first_late.before == 0, "").when(first_late.starts, F.when(first_late.speaker == "A", "B").otherwise("A")).otherwise(first_late.speaker)
    begun = F.struct(before.alias("sp"), F.array().cast("array<string>").alias("ps"))
    line = lambda a, w: F.when(a.sp == w.speaker, F.concat(F.lit(" "), w.word)).otherwise(F.concat(F.when(a.sp == "", "").otherwise("\n"), w.speaker, F.lit(": "), w.word))
    rest = F.aggregate(tail, begun, lambda a, w: F.struct(w.speaker.alias("sp"), F.concat(a.ps, F.array(line(a, w))).alias("ps")), lambda a: F.array_join(a.ps, ""))
    on_time = F.size("late") == 0
    x = x.withColumns({"_part": _part(F.coalesce(first_late.before, F.col("lw.before"))), "_cut": F.when(on_time, F.col("lw.upto")).otherwise(first_late.before).cast("int"), "_rest": F.when(~on_time, rest)})
    x = x.drop("near").join(_texts(words), ["did", "_part"], "left")
    own = F.substring(F.col("_own").cast("binary"), F.lit(1), F.col("_cut") - F.octet_length("_text")).cast("string")
    return x.withColumn("context", F.concat("_text", own, F.coalesce("_rest", F.lit("")))).drop("_part", "_cut", "_rest", "_text", "_own")


def _part(at: Column) -> Column:
    return F.floor(at / PART).cast("int")


def _texts(words: DataFrame) -> DataFrame:
    """did, _part, _own, _text: each part of a unit's text and all before it. A word is of the part in which it begins, so
    each part that a word asks for is there. The parts' contexts are made in different tasks; what is moved for them is one
    text a part, not one a context."""
    pieces = words.groupBy("did", _part(_before()).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("idx", _piece().alias("piece")))).alias("_p"))
    parts = pieces.select("did", "_part", F.array_join("_p.piece", "").alias("_own"))
    earlier = F.collect_list("_own").over(Window.partitionBy("did").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("did", "_part", "_own", F.array_join(earlier, "").alias("_text"))


def _until_stop(states: DataFrame, by_time: Ranges) -> DataFrame:
    """The states before the first one without a hint."""
    x = running(states, by_time, ["ka"], {"_stop": ("min", F.when(F.col("hint") == "", F.col("ka")))})
    return x.filter("_stop is null").drop("_stop")


def build(t: DataFrame, every: float = 5.0, recent: int = 5, hint: bool = True, texts: bool = True, context: bool = True, stop: bool = False, channel: int | None = None, channels: dict[str, int] | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """The ticks of a transcript with at least two words so far: did, k, n_so_far, trigger_word, speaker (of the last word
    so far in list order), ratio, channel (of the side that speaks next) and, as asked for, hint, recent_words, context.

    Ticks stand at every, 2 * every, ... before the last end; `every` must be such that its multiples are exact, as 0.5
    or 5. `channels` gives the speakers' channels (A 0, B 1). `channel` keeps one channel, and then `stop` drops every tick
    of a unit from its first one without a hint on.
    """
    if not (every > 0 and float(every * 2**20).is_integer()):
        raise ValueError(f"multiples of {every} s are not exact")
    words, ranges = _words(t, every)
    words = checkpointed(words)  # read for the states, the late words, the runs, the texts
    states, by_time = _states(words, ranges, every, min_rows)
    numbers = channel_map(channels or {"A": 0, "B": 1})
    x = states.withColumn("channel", F.when(F.col("lw.speaker") == "A", numbers["B"]).otherwise(numbers["A"]))
    if channel is not None:
        x = x.filter(F.col("channel") == channel)
    x = _with_late(x, words)
    if hint or stop:
        x = checkpointed(x)  # read for the hints, and to meet them
    run = F.col("lw.idx") - F.col("other") - F.size(F.filter("late", lambda w: w.idx > F.col("other")))
    x = x.withColumn("ratio", run / (run + F.col("lw.fwd")))
    out = ["n_so_far", F.col("lw.word").alias("trigger_word"), F.col("lw.speaker").alias("speaker"), "ratio", "channel"]
    if hint or stop:
        x = _with_hint(x, words)
        out.append("hint")
    if stop:
        x = _until_stop(x, by_time)
    if texts or context:
        x = _with_texts(x, words, recent, context)
        out += ["recent_words"] + (["context"] if context else [])
    return x.select("did", F.explode(F.sequence("ka", F.col("until") - 1)).alias("k"), *out)


def ticks(t: DataFrame, every: float = 5.0, recent: int = 5, **kw) -> DataFrame:
    """All ticks (build), whether or not a hint is left."""
    return build(t, every, recent, **kw)


def request(every: float = 5.0) -> Column:
    """What a predictor is told of a tick, as a struct; the hint is the true next utterance, to be used as the prompt says."""
    other = F.when(F.col("speaker") == "A", "B").otherwise("A")
    return F.struct(
        (F.col("k") * F.lit(every) * 1000).cast("long").alias("timestamp_ms"), F.col("context").alias("conversation_context"), F.col("n_so_far").alias("total_word_count"), "trigger_word", "recent_words",
        F.col("ratio").alias("current_spoken_ratio"), F.col("hint").alias("next_utterance_hint"), F.col("speaker").alias("current_speaker"), other.alias("next_speaker"), F.col("channel").alias("target_channel"),
    )


def fallback(request: Column) -> Column:
    """Prediction without a model: nothing up to a ratio of one half, the hint beyond."""
    return F.when(request.current_spoken_ratio <= 0.5, "").otherwise(request.next_utterance_hint)


def events(t: DataFrame, channel: int | None = None, every: float = 5.0, recent: int = 5, predictor=fallback, **kw) -> DataFrame:
    """Prediction events of a transcript: ticks up to the stop whose prediction isn't empty, hints shown beyond one half
    only (F5, P12). `predictor` makes a string column from the column `request`: an expression or a pandas UDF."""
    x = build(t, every, recent, stop=True, channel=channel, **kw).withColumn("_request", request(every))
    p = x.withColumn("prediction", strip(predictor(F.col("_request")))).filter("prediction <> ''")
    return p.select(
        "did",
        *[F.col(f"_request.{c}").alias(c) for c in ("timestamp_ms", "conversation_context")],
        "prediction",
        *[F.col(f"_request.{c}").alias(c) for c in ("total_word_count", "trigger_word", "recent_words", "current_spoken_ratio")],
        "channel",
        F.when(F.col("ratio") > 0.5, F.col("hint")).otherwise("").alias("hint"),
    )


BANDS = (0.65, 0.8, 0.95, 0.99)  # fixed values: upper bounds of the bands of guidance beyond one half


def prompt_band(ratio: Column) -> Column:
    """Guidance band of the prompt: 0 up to one half (no hint), then 1 to 5."""
    band = F.when(ratio <= 0.5, 0)
    for number, upper in enumerate(BANDS, 1):
        band = band.when(ratio <= upper, number)
    return band.otherwise(len(BANDS) + 1)


GUIDANCE = [
    "About half of the turn has been heard. Go by the talk so far; single words of the hint may be used.",
    "The turn is in its second half. Go by the talk so far and the hint alike, and say something of your own.",
    "Most of the turn has been heard. The hint counts for much; put it in other words.",
    "The turn is nearly over. Stay close to the hint, in natural words.",
    "The whole turn has been heard. The hint may be followed as it is.",
]


def percent(ratio: Column, digits: int) -> Column:
    """A share in percent: a hundred times the double, halves rounded to even (of its shortest decimal, beyond whole ones)."""
    times = ratio * 100
    whole = F.rint(times).cast("long").cast("string")
    exact = whole if digits == 0 else F.bround(times.cast("decimal(20,15)"), digits).cast(f"decimal(10,{digits})").cast("string")
    return F.concat(exact, F.lit("%"))


def prompt(request: Column) -> Column:
    """The text that asks a model for a prediction (F3). Up to a ratio of one half it shows no hint."""
    r = request.current_spoken_ratio
    head = [F.lit("Two people, A and B, are talking. What has been said:\n"), request.conversation_context, F.lit("\n\n"), request.current_speaker]
    low = [F.lit(" has said "), percent(r, 0), F.lit(" of this turn. Only the talk so far is known.")]
    guide = F.element_at(F.array(*[F.lit(g) for g in GUIDANCE]), F.greatest(prompt_band(r), F.lit(1)))
    high = [F.lit(" has said "), percent(r, 0), F.lit(" of this turn.\nHint, not to be quoted: "), request.next_utterance_hint, F.lit("\nProgress "), percent(r, 1), F.lit(": "), guide]
    tail = [F.lit("\n\nSay in one spoken sentence of ten to thirty words what "), request.next_speaker, F.lit(" says next. Answer with these words only.")]
    return F.concat(*head, F.when(r <= 0.5, F.concat(*low)).otherwise(F.concat(*high)), *tail)
