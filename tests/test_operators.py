import hashlib
import random

import pytest
from dialoom import catalogue
from dialoom.operators import align, batch, frames, ticks, transcripts
from dialoom.operators.sequence import find_ranges
from dialoom.session import checkpointed
from dialoom.sources import files
from pyspark.sql import functions as F

T = "did string, idx int, speaker string, word string, start double, end double"


def talk(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], T)


# A asks for two seconds, B answers; halves of seconds, so that ticks of 0.5 s fall on the ends.
ORDER = [("A", "two", 0.0, 0.5), ("A", "teas", 0.5, 1.0), ("A", "and", 1.0, 1.5), ("A", "cake", 1.5, 2.0), ("B", "right", 2.25, 2.5), ("B", "away", 2.5, 3.25)]


def one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_events_of_a_short_talk(spark):
    t = talk(spark, ORDER)
    got = {r.k: (r.n_so_far, r.speaker, r.ratio, r.hint, r.context) for r in ticks.ticks(t, every=0.5).collect()}
    assert got == {
        2: (2, "A", 0.5, "right away", "A: two teas"),
        3: (3, "A", 0.75, "right away", "A: two teas and"),
        4: (4, "A", 1.0, "right away", "A: two teas and cake"),
        5: (5, "B", 0.5, "", "A: two teas and cake\nB: right"),
        6: (5, "B", 0.5, "", "A: two teas and cake\nB: right"),
    }
    ev = ticks.events(t, every=0.5, predictor=lambda r: F.concat(F.lit("\u00a0 to "), r.next_speaker, F.lit("\n"))).orderBy("timestamp_ms").collect()
    assert [(e.timestamp_ms, e.hint, e.channel, e.prediction) for e in ev] == [(1000, "", 1, "to B"), (1500, "right away", 1, "to B"), (2000, "right away", 1, "to B")]
    assert [e.prediction for e in ticks.events(t, every=0.5).orderBy("timestamp_ms").collect()] == ["right away"] * 2
    assert ticks.events(t, channel=0, every=0.5).collect() == [] and ticks.ticks(t.filter("false")).collect() == []
    with pytest.raises(ValueError, match="not exact"):
        ticks.ticks(t, every=0.1)


FAR = 2_200_000  # seconds, over 25 days: their milliseconds are beyond 32 bits


@pytest.mark.parametrize("name", ["oracle_events", "target_channel_events", "oracle_events_by_call"])
def test_events_of_a_line_of_many_days(spark, tmp_path, name):
    rows = [("A" if i // 6 % 2 else "B", f"w{i}", 0.75 * i, 0.75 * i + 0.5) for i in range(60)]
    got = []
    for late in (0, FAR):
        df = spark.createDataFrame([("line", i, sp, w, a + late, b + late) for i, (sp, w, a, b) in enumerate(rows)], "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double")
        df.write.parquet(f"{tmp_path}/{late}/words.parquet")
        got.append(sorted(tuple(r.asDict().items()) for r in catalogue.QUERIES[name](spark, f"{tmp_path}/{late}").collect()))
    early, late = got
    assert early and late == [tuple((c, v + FAR * 1000 if c == "timestamp_ms" else v) for c, v in r) for r in early]


def test_events_in_ranges_are_not_worked_out_anew(spark):
    rows = [("A" if i // 6 % 2 else "B", f"w{i}", 0.75 * i, 0.75 * i + (0.5 if i % 5 else 2.5)) for i in range(60)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = []
    for least in (10**6, 7):
        t = checkpointed(talk(spark, rows))
        t._ranges = find_ranges(t, ["did"], "idx", least)
        x, ranges = transcripts.run_columns(t, piece=F.col("word"), arrives=F.col("idx"))
        assert ranges.split == (least == 7) and sum("LogicalRDD" in line and "word#" in line for line in plan(x).splitlines()) <= (4 if ranges.split else 1)
        e = ticks.events(t, channel=1, min_rows=least).select("did", "timestamp_ms", "hint", "channel")
        assert "array_except" not in plan(e) and "array_join(_p" not in plan(e)  # the texts of a tick are made only if they are read
        got.append(sorted(tuple(r) for r in e.collect()))
    assert got[0] and got[0] == got[1]


@pytest.mark.parametrize("part, n", [(100_000, 3000), (10_000, 3000), (7, 300)])
def test_contexts_of_a_long_line_are_written_as_what_they_add(spark, tmp_path, monkeypatch, part, n):
    monkeypatch.setattr(ticks, "PART", part, raising=False)
    rnd = random.Random(7)
    rows = [("line", i, "A" if i // 6 % 2 else "B", "wéit " * 5 + str(rnd.random()), 0.75 * i, 0.75 * i + rnd.choice([0.5, 0.5, 0.5, 4.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double")
    df.write.parquet(f"{tmp_path}/words.parquet")
    catalogue.QUERIES["oracle_events"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").select("timestamp_ms", "conversation_context").collect()
    assert len(got) > n / 20
    for ms, text in got:
        said, last = [], ""
        for _, _, side, word, _, end in rows:
            if end <= ms / 1000:
                said.append((" " if side == last else ("\n" if last else "") + side + ": ") + word)
                last = side
        assert text == "".join(said)
    if n == 3000:
        assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < sum(len(r[1].encode()) for r in got) / 20


def test_tie_of_ends_goes_to_the_last_in_list_order(spark):
    t = talk(spark, [("A", "well", 0.0, 1.0), ("B", "no", 0.5, 1.0), ("B", "way", 1.0, 1.75)])
    r = ticks.ticks(t, every=1.0).filter("k = 1").first()
    assert (r.speaker, r.trigger_word, r.ratio) == ("B", "no", 0.5)


def model_ticks(rows, every):
    """The ticks of a talk, step by step."""
    out, k = {}, 1
    while rows and k * every < max(r[3] for r in rows):
        sf = [(i, r) for i, r in enumerate(rows) if r[3] <= k * every]
        if len(sf) >= 2:
            at, (sp, word, _, end) = sf[-1]
            back = next((n for n, (_, r) in enumerate(reversed(sf)) if r[0] != sp), len(sf))
            fwd = 0
            for i in range(at + 1, len(rows)):
                if rows[i][0] != sp or rows[i][3] - rows[i - 1][3] >= 1.0:
                    break
                fwd += 1
            hint = []
            for r in rows:
                if r[3] > end:
                    if r[0] != sp:
                        hint.append(r[1])
                    elif hint:
                        break
            lines = []
            for _, r in sf:
                if lines and lines[-1][0] == r[0]:
                    lines[-1] += f" {r[1]}"
                else:
                    lines.append(f"{r[0]}: {r[1]}")
            out[k] = (len(sf), word, sp, back / (back + fwd), " ".join(hint), " ".join(r[1] for _, r in sf[-5:]), "\n".join(lines))
        k += 1
    return out


def test_ticks_of_lists_out_of_order(spark):
    rnd = random.Random(8)
    talks = {}
    for d in range(25):
        n, at, rows = rnd.randrange(1, 40), 0.0, []
        for i in range(n):
            at += rnd.choice([0.0, 0.25, 0.5, 1.0, 3.0])
            rows.append((rnd.choice("AAB" if d % 2 else "AB"), f"w{i}", at, at + rnd.choice([0.0, 0.25, 0.5, 2.0, 8.0])))
        if d % 3 == 0:
            rnd.shuffle(rows)
        talks[f"t{d}"] = rows
    t = spark.createDataFrame([(d, i, *r) for d, rows in talks.items() for i, r in enumerate(rows)], T)
    want = {(d, k): v for d, rows in talks.items() for k, v in model_ticks(rows, 0.5).items()}
    for least in (10**6, 7):
        t._ranges = find_ranges(t, ["did"], "idx", least)
        got = {(r.did, r.k): (r.n_so_far, r.trigger_word, r.speaker, r.ratio, r.hint, r.recent_words, r.context) for r in ticks.ticks(t, every=0.5, min_rows=least).collect()}
        assert got == want
    stopped = {(r.did, r.k) for r in ticks.build(t, every=0.5, stop=True, min_rows=7).collect()}
    assert stopped == {(d, k) for d, k in want if not any(v[4] == "" for (e, j), v in want.items() if e == d and j <= k)}
    runs = [{(r.did, r.run_no): (r.speaker, r.run_text) for r in transcripts.speaker_runs(x).collect()} for x in (t, spark.createDataFrame(t.collect(), T))]
    assert runs[0] == runs[1]


def test_prompt(spark):
    row = {"conversation_context": "A: tea", "current_spoken_ratio": 0.5, "next_utterance_hint": "SECRET", "current_speaker": "A", "next_speaker": "B"}
    texts = {}
    for r in (0.5, 0.625, 0.8, 0.95, 0.99, 1.0):
        df = spark.createDataFrame([tuple({**row, "current_spoken_ratio": r}.values())], "conversation_context string, current_spoken_ratio double, next_utterance_hint string, current_speaker string, next_speaker string")
        texts[r] = df.select(ticks.prompt(F.struct("*"))).first()[0]
    assert "SECRET" not in texts[0.5] and "50%" in texts[0.5] and all("SECRET" in texts[r] for r in texts if r > 0.5)
    assert "62%" in texts[0.625] and "62.5%" in texts[0.625] and len({t.split("Progress")[1][8:] for r, t in texts.items() if r > 0.5}) == 5


def test_gap_counts_ahead_only(spark):
    t = talk(spark, [("A", "a", 0.0, 1.0), ("A", "b", 1.5, 2.0), ("A", "c", 2.0, 2.5)])
    assert [(r.run_len, r.fwd) for r in transcripts.spoken_ratio(t).orderBy("idx").collect()] == [(1, 0), (2, 1), (3, 0)]


def test_frame_of_time(spark):
    assert one(spark, transcripts.frame_of(F.col("x")), "x double", (0.24,)) == 2


def test_missing_speaker(spark):
    t = talk(spark, [("A", "a", 0.0, 1.0)])
    assert transcripts.require_speakers(t, strict=False).collect() == []
    with pytest.raises(Exception, match="missing in d"):
        transcripts.require_speakers(t).collect()


def test_delay_labels_and_back(spark):
    rows = [[1, 2, 3], [11, 12, 13], [21, 22, 23]]
    d = one(spark, frames.delayed(F.col("x"), (0, 0, 2)), "x array<array<int>>", (rows,))
    assert d == [[32000, 1, 2, 3, 3, 3], [2048, 11, 12, 13, 2048, 2048], [2048, 2048, 2048, 21, 22, 23]]
    assert one(spark, frames.labels(F.col("x"), 3), "x array<array<int>>", (d,)) == [[-1, 1, 2, 3, 3, 3], [-1, 11, 12, 13, -1, -1], [-1, -1, -1, 21, 22, 23]]
    assert one(spark, frames.undelayed(F.col("x"), (0, 0, 2)), "x array<array<int>>", ([r[1:] for r in d],)) == rows
    assert one(spark, frames.undelayed(F.col("x"), (0, 0, 2)), "x array<array<int>>", ([[1, 2]] * 3,)) is None


def test_chunks(spark):
    assert [c.len for c in one(spark, frames.chunk_bounds(F.col("n"), 512), "n int", (1025,))] == [342, 342, 341]


def test_ragged_round_trip(spark):
    lists = [[7, 8], [], [9]]
    assert one(spark, frames.packed_offsets(F.col("x")), "x array<array<int>>", (lists,)) == [0, 2, 2, 3]
    assert one(spark, frames.unpacked(F.col("v"), F.col("o")), "v array<int>, o array<int>", ([7, 8, 9], [0, 2, 2, 3])) == lists
    assert one(spark, frames.unpacked(F.col("v"), F.col("o")), "v array<int>, o array<int>", ([], [0])) == []


def test_merge_text_audio(spark):
    for n, want in ((2, [5, 6]), (5, [5, 6, 7, 3, 3])):
        assert one(spark, frames.merge_text_audio(F.col("t"), F.col("a")), "t array<int>, a array<array<int>>", ([5, 6, 7], [[1] * n]))[0] == want


EV = "example_id long, n int, events array<struct<pos:int,ratio:float,forbid:int,pred:array<int>,hint:array<int>>>"


def stream(spark, events, n, **kw):
    got = {r.frame: r.tok for r in batch.event_writes(spark.createDataFrame([(1, n, events)], EV), F.col("n"), **kw).collect()}
    return [got.get(i, 0) for i in range(n)]


def test_event_stream_overwrites_and_keeps_tails(spark):
    s = batch.START
    assert stream(spark, [(0, 0.0, 0, [1, 2, 3, 4], []), (2, 0.0, 0, [9], [])], 6) == [s, 1, s, 9, 4, 0]
    assert stream(spark, [(0, 0.0, 1, [21], [11]), (3, 0.0, 1, [22], [12])], 6, hints_only=True) == [s, 11, 0, s, 12, 0]


def test_shift_mask_and_arithmetic(spark):
    row = ([1, 2, 3, 4],)
    move = lambda right, by: one(spark, batch.shifted(F.col("x"), F.lit(right), F.lit(by), 0), "x array<int>", row)
    assert move(True, 1) == [0, 1, 2, 3] and move(False, 1) == [2, 3, 4, 0] and move(True, 99) == [0, 0, 0, 1]
    assert one(spark, batch.mask(F.col("n"), F.lit(4), -1), "n int", (2,)) == [1, 1, -1, -1]
    assert (batch.updates_per_epoch(50, 2), batch.updates_per_epoch(51, 2)) == (25, 26)
    assert (batch.resume_offset(13, 2, 50), batch.resume_offset(26, 2, 50), batch.resume_offset(1, 1, 0)) == (26, 2, 0)
    assert batch.speaker_spec("B, A") == ["B", "A"]
    for bad in ("", "A,A", "C"):
        with pytest.raises(ValueError):
            batch.speaker_spec(bad)


def test_skip_forbid_before_drops(spark):
    rows = [("d", i, ts, "p", "", 0.5, ch) for i, (ts, ch) in enumerate([(0, 0), (-50, 0), (None, 1), (160, None)])]
    df = spark.createDataFrame(rows, "dialogue_id string, ord int, timestamp_ms long, prediction string, hint string, current_spoken_ratio double, channel int")
    got = [(r.ord, r.frame_pos, r.skip_forbid) for r in align.event_frames(df).filter("channel = 0").orderBy("ord").collect()]
    assert got == [(0, 0, 0), (1, 0, 1), (3, 2, 1)]


def test_placement_closed_form_equals_fold(spark):
    assert align.place_fold([0, 0, 0, 5], [11, 12, 13, 14], 8) == [11, 12, 13, 3, 0, 14, 3, 3]
    assert align.place_fold([0] * 13, [1] * 13, 12, strict=False) == [1] * 12
    with pytest.raises(ValueError):
        align.place_fold([0] * 13, [1] * 13, 12)
    rnd = random.Random(3)
    starts = sorted(float(rnd.choice([rnd.random() * 8, rnd.randrange(8)])) for _ in range(40))
    rows = align.token_frames(talk(spark, [("A", "w", s, s + 0.1) for s in starts])).orderBy("idx", "part").collect()
    assert not any(r.folded for r in rows)
    rows.sort(key=lambda r: (starts[r.idx], r.idx, r.part))
    want = align.place_fold([r.frame for r in rows], list(range(10, 10 + len(rows))), rows[0].num_frames, strict=False)
    got = [3] * rows[0].num_frames
    for i, r in enumerate(rows):
        if r.slot is not None:
            got[r.slot] = 10 + i
            if r.end_mark:
                got[r.slot - 1] = 0
    assert got == want


def test_batches_number_all_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "example_id long").repartition(5)
    got = {r.example_id: (r.batch_id, r.pos_in_batch) for r in batch.batches(df, 4).collect()}
    assert got == {i: (i // 4, i % 4) for i in range(23)}


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"speaker":"A","word":"hi","start":0,"end":1},{"speaker":"B","word":"yo","start":1,"end":2}]')
    (tmp_path / ".DS_Store").write_text("junk")
    rows = files.read_transcripts(spark, str(tmp_path)).orderBy("word_idx").collect()
    assert [(r.dialogue_id, r.word_idx, r.word) for r in rows] == [("x", 0, "hi"), ("x", 1, "yo")]
    (tmp_path / "y.json").write_text('[{"speaker":"A","word":"hi","start":0}]')
    with pytest.raises(Exception, match="missing in y"):
        files.read_transcripts(spark, str(tmp_path)).collect()
    a = spark.createDataFrame([("1",), ("2",)], "dialogue_id string")
    b = spark.createDataFrame([("2",), ("3",)], "dialogue_id string")
    assert {tuple(r) for r in files.missing(a, b, "dialogue_id", "text", "audio").collect()} == {("audio", "1"), ("text", "3")}
    assert [r.dialogue_id for r in files.pending(a, b).collect()] == ["1"]
    rows = [("d", i, i * 500, "A: x", p, 2, "x", "x", 0.5, None, "") for i, p in ((1, "ü"), (0, "a"))]
    ev = spark.createDataFrame(rows, "dialogue_id string, ord int, timestamp_ms int, conversation_context string, prediction string, total_word_count int, trigger_word string, recent_words string, current_spoken_ratio double, channel int, hint string")
    assert files.write_events(ev, str(tmp_path / "out")) == 2
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert text.startswith('[{"timestamp_ms":0,"conversation_context":"A: x","prediction":"a"') and '"channel":null' in text and '"prediction":"ü"' in text
    (tmp_path / "curated").mkdir()
    (tmp_path / "curated" / f"d{files.SUFFIX}").write_text(text)
    assert [(r.dialogue_id, r.ord, r.prediction) for r in files.read_events(spark, str(tmp_path / "curated")).orderBy("ord").collect()] == [("d", 0, "a"), ("d", 1, "ü")]


def test_event_files_of_a_line_of_many_days(spark, tmp_path):
    rows = [("A" if i // 6 % 2 else "B", f"w{i}", 0.75 * i + FAR, 0.75 * i + 0.5 + FAR) for i in range(60)]
    df = spark.createDataFrame([("line", i, *r) for i, r in enumerate(rows)], "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double")
    df.write.parquet(f"{tmp_path}/words.parquet")
    events = sorted((r.timestamp_ms, r.prediction, r.channel, r.hint) for r in catalogue.QUERIES["oracle_events_by_call"](spark, str(tmp_path)).collect())
    text = "\n".join("|".join(str(v) for v in e) for e in events)
    got = catalogue.QUERIES["event_json"](spark, str(tmp_path)).collect()
    assert [(r.n, r.n_read, r.events_md5) for r in got] == [(len(events), len(events), hashlib.md5(text.encode()).hexdigest())] and events[0][0] > FAR * 1000
    (tmp_path / f"line{files.SUFFIX}").write_text(f'[{{"timestamp_ms":{events[0][0]},"prediction":"a"}}]')
    assert [r.timestamp_ms for r in files.read_events(spark, str(tmp_path)).collect()] == [events[0][0]]


def test_calls_split_a_long_line(spark):
    rows = [("line", i, "A" if i % 3 else "B", f"w{i}", 10.0 * i + (100.0 if i >= 30 else 0.0), 10.0 * i + 101.0) for i in range(60)]
    df = spark.createDataFrame(rows, "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double")
    for least in (10**6, 10):
        t = transcripts.transcript(df, min_rows=least)
        assert [(r.did, r.idx, r.word) for r in t.orderBy("idx").collect()] == [("line", i, f"w{i}") for i in range(60)]
        t = transcripts.transcript(df, 60.0, min_rows=least)
        assert {(r.did, r.n) for r in t.groupBy("did").agg(F.count("*").alias("n")).collect()} == {("line#0", 30), ("line#1", 30)}


def test_long_calls_are_looked_for_in_long_lines_only(spark, monkeypatch):
    rows = [(d, i, "A" if i % 3 else "B", f"w{i}", 10.0 * i + (100.0 if i >= 30 else 0.0), 10.0 * i + 101.0) for d, n in (("line", 60), ("talk", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double")
    looked_at = []
    monkeypatch.setattr(transcripts, "find_ranges", lambda x, *a: (looked_at.append({r.d for r in x.select(F.col(a[0][0]).alias("d")).distinct().collect()}), find_ranges(x, *a))[1])
    got = transcripts.transcript(df, 60.0, min_rows=10).groupBy("did").agg(F.count("*").alias("n")).collect()
    assert {(r.did, r.n) for r in got} == {("line#0", 30), ("line#1", 30), ("talk#0", 9)}
    assert looked_at == [{"line", "talk"}, {"line#0", "line#1"}]


def test_embedding_covariance_of_all_pairs(spark):
    from dialoom.operators import metrics

    rnd = random.Random(5)
    rows = [[rnd.gauss(1000 + i, 1) for i in range(12)] for _ in range(50)]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,), ([1.0] * 5,)], "embedding array<double>").repartition(3)
    got = {(r.i, r.j): (r.cov, r.mean_i) for r in metrics.embedding_covariance(df).collect()}
    mean = [sum(r[i] for r in rows) / 50 for i in range(12)]
    assert len(got) == 78
    for (i, j), (cov, m) in got.items():
        assert m == pytest.approx(mean[i]) and cov == pytest.approx(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / 50, abs=1e-8)
    from __spark_entry__ import queries

    assert queries()["embedding_stats"](spark, "/root/testdata/sf0.001").count() == 2080


def test_each_token_takes_a_slot(spark):
    def model(frames, n, ids):
        """The first free slot from the frame on; the slot before it, if free, gets the mark."""
        taken = {}
        for f, token in zip(frames, ids):
            p = next((s for s in range(f, n) if s not in taken), None)
            if p is None:
                break
            taken[p] = token
            if p:
                taken.setdefault(p - 1, 0)
        return [taken.get(s, 3) for s in range(n)]

    assert align.place_fold([5, 4], [11, 12], 8) == model([5, 4], 8, [11, 12]) == [3, 3, 3, 3, 0, 11, 12, 3]
    rnd = random.Random(4)
    starts = sorted(rnd.random() * 8 for _ in range(30))
    long, short = [("A", "wonderful", x, x + 0.9) for x in starts], [("B", "hello", float(i), i + 0.4) for i in range(5)]
    t = talk(spark, long + short)
    times = {(r.speaker, r.idx, r.part): r for r in align.token_times(t).withColumn("f", transcripts.frame_of(F.col("tok_start"))).collect()}
    rows = align.token_frames(t).collect()
    for speaker in "AB":
        tokens = [times[k] for k in sorted(times) if k[0] == speaker]
        assert (speaker == "A") == any(a.f > b.f for a, b in zip(tokens, tokens[1:]))
        n = int((tokens[-1].tok_end + 1) * 12.5)
        got = [3] * n
        for r in rows:
            if r.speaker == speaker:
                got[r.slot] = r.token_id
                assert r.num_frames == n
        for r in rows:
            if r.speaker == speaker and r.end_mark:
                assert got[r.slot - 1] == 3
                got[r.slot - 1] = 0
        assert got == model([r.f for r in tokens], n, [r.token_id for r in tokens])


def test_audio_and_total_loss(spark):
    from dialoom.operators import metrics

    rows = [(0, 0, 5, 1.0, 1.0), (0, 0, 3, 4.0, 0.0), (0, 1, 7, 2.0, 1.0), (0, 2, 7, 3.0, 0.0), (0, 8, 7, 5.0, 1.0), (0, 9, 7, 6.0, 1.0), (0, 16, 7, 8.0, 0.0), (0, 16, -1, 99.0, 1.0), (1, 0, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "step int, label_row int, label int, nll double, hit double")
    a, b = metrics.total_loss(df).orderBy("step").collect()
    assert (a.text_loss, a.semantic_loss, a.acoustic_loss, a.acoustic_acc, a.semantic_user_loss, a.acoustic_user_loss, a.n_acoustic_user) == (3.0, 2.0, 4.0, 0.5, 6.0, 8.0, 1)
    assert a.audio_loss == pytest.approx((100 * 8 + 16) / 203) and a.total_loss == pytest.approx(3 + 816 / 203)
    assert (b.audio_loss, b.total_loss, b.semantic_loss) == (0.0, 1.0, None)
    main = metrics.total_loss(df, user=False).orderBy("step").first()
    assert main.audio_loss == pytest.approx((100 * 2 + 8) / 102)


def test_events_move_with_their_delayed_streams(spark):
    row = ([[10, 11, 12, 13], [1, 2, 3, 4], [5, 6, 7, 8]], [(3, "b"), (0, "a"), (4, "c"), (-1, "z"), (3, "d"), (5, "x"), (-2, "y")])
    df = spark.createDataFrame([row], "streams array<array<int>>, events array<struct<pos: int, name: string>>")
    whole = frames.training_examples(df, delays=(0, 0, 1)).first()
    assert [tuple(e) for e in whole.events] == [(4, "b"), (1, "a"), (5, "c"), (0, "z"), (4, "d")]
    assert whole.streams == [[32000, 10, 11, 12, 13, 3], [2048, 1, 2, 3, 4, 2048], [2048, 2048, 5, 6, 7, 8]] and (whole.num_streams, whole.num_frames) == (3, 6)
    cut = frames.training_examples(df, 4, 3, delays=(0, 0, 1)).orderBy("chunk").collect()
    assert [[tuple(e) for e in r.events] for r in cut] == [[(0, "z"), (1, "a")], [(1, "b"), (1, "d"), (2, "c")]]
    assert [r.labels for r in cut] == [[[-1, 10, 11], [-1, 1, 2], [-1, -1, 5]], [[12, 13, 3], [3, 4, -1], [6, 7, 8]]]
    assert frames.training_examples(df, 4, 4, delays=(0, 0, 1)).count() == 0
