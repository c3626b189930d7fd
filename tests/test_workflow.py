"""The workflow from transcripts to batches, with files, plug-ins and checks."""

import json
import random
import sys
import wave

import numpy as np
import pytest
from dialoom import jobs
from dialoom.config import DataConfig
from dialoom.functions import plugins
from dialoom.functions.labels import channel_map, require_known_labels, strip, unknown_labels
from dialoom.functions.progress import counted
from dialoom.operators import align, batch, dataset, transcripts
from dialoom.operators.sequence import BUCKET, Ranges, find_ranges, following, numbered, running
from dialoom.sources import arrays, audio, files
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't know the tests

TALKS = {
    "d1": [("A", "are", 0.0, 0.5), ("A", "you", 0.5, 1.0), ("A", "open", 1.0, 1.5), ("B", "until", 2.0, 2.5), ("B", "nine", 2.5, 3.0), ("A", "thanks", 3.5, 4.0), ("B", "bye", 4.5, 5.0)],
    "d2": [("B", "hello", 0.0, 0.5), ("B", "there", 0.5, 1.0), ("A", "hi", 1.5, 2.0), ("B", "so", 2.5, 3.0)],
}


def folder(tmp_path):
    for d in ("text", "wav"):
        (tmp_path / d).mkdir()
    for did, rows in TALKS.items():
        (tmp_path / "text" / f"{did}.json").write_text(json.dumps([dict(zip(("speaker", "word", "start", "end"), r)) for r in rows]))
        with wave.open(str(tmp_path / "wav" / f"{did}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes(np.zeros((8000 * 6, 2), "<i2").tobytes())
    (tmp_path / "text" / "notes.txt").write_text("stray")
    return {k: str(tmp_path / k) for k in ("text", "wav", "events", "t", "a", "e", "data")}


def test_from_transcripts_to_batches(spark, tmp_path):
    at = folder(tmp_path)
    n = jobs.generate_events(spark, at["text"], at["events"], every=0.5)
    assert n > 0 and jobs.generate_events(spark, at["text"], at["events"], every=0.5, limit=1) == 0  # resumed: all done
    raw = spark.read.text(at["events"]).collect()
    assert {r.dialogue_id for r in raw} == set(TALKS) and list(json.loads(raw[0].value)[0]) == files.EVENT_FIELDS
    (tmp_path / "curated").mkdir()
    for r in raw:
        (tmp_path / "curated" / f"{r.dialogue_id}{files.SUFFIX}").write_text(r.value)
    for _ in range(2):  # the second time nothing is left to do
        jobs.tokenize_text(spark, at["text"], at["t"])
        jobs.tokenize_audio(spark, at["wav"], at["a"])
        jobs.tokenize_events(spark, str(tmp_path / "curated"), at["a"], at["e"])
    assert [spark.read.parquet(at[k]).count() for k in "tae"] == [2, 2, 2]
    assert jobs.prepare_dataset(spark, at["t"], at["a"], at["data"], at["e"], per_file=1) == ["train-001-of-002.parquet", "train-002-of-002.parquet"]
    rows = spark.read.parquet(at["data"])
    assert {(r.dialogue_id, len(r.A), len(r.A[0])) for r in rows.collect()} == {(d, 9, 75) for d in TALKS}
    config = DataConfig([f"{at['data']}/train-001*", f"{at['data']}/train-002*"], ["A,B", "B"], max_length=40, min_length=10, batch_size=4)
    b = jobs.training_batches(spark, config).orderBy("batch_id", "pos_in_batch").collect()
    assert [(r.batch_id, r.pos_in_batch) for r in b] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    assert all(len(r.input_ids) == 17 and len(r.input_ids[0]) == r.longest == len(r.oracle_tokens) == len(r.text_mask) for r in b)
    assert jobs.training_batches(spark, config, step=1).count() == 2 and jobs.eval_batches(spark, DataConfig(["x"], eval_files=config.train_files, eval_steps=1, batch_size=2)).count() == 4
    (tmp_path / "curated" / f"d2{files.SUFFIX}").unlink()
    with pytest.raises(Exception, match="event file is missing for d2"):
        jobs.tokenize_events(spark, str(tmp_path / "curated"), at["a"], str(tmp_path / "e2"))


def test_ids_must_agree(spark):
    t = spark.createDataFrame([("x", [1, 2], [3]), ("y", [1], [2])], "dialogue_id string, A array<int>, B array<int>")
    a = spark.createDataFrame([("x", [[10, 11]], [[12, 13]])], "dialogue_id string, A array<array<int>>, B array<array<int>>")
    with pytest.raises(ValueError, match=r"audio missing for \['y'\]"):
        dataset.assembled(t, a)
    with pytest.raises(ValueError, match=r"text missing for \['x'\]"):
        dataset.assembled(t.filter("false"), a)
    with pytest.raises(ValueError, match="events missing"):
        dataset.assembled(t.filter("dialogue_id = 'x'"), a, t.filter("false"))
    row = dataset.assembled(t, a, strict=False, prefix="p").collect()
    assert [(r.dialogue_id, r.A, r.B) for r in row] == [("p/x", [[1, 2], [10, 11]], [[3, 3], [12, 13]])]
    with pytest.raises(KeyError, match="A_oracle_event_frame_pos"):
        dataset.speaker_rows(dataset.assembled(t, a, strict=False), "A")
    one = dataset.speaker_rows(dataset.assembled(t, a, strict=False), "B", codebooks=1, events=False).first()
    assert (one.main_speaker, one.streams) == ("B", [[3, 3], [12, 13], [10, 11]])
    with pytest.raises(Exception, match="codes is missing for y"):
        dataset.require_ids(t, a.select("dialogue_id"), "codes").collect()
    assert files.write_shards(t.filter("false"), "/tmp/none-of-it", "p") == []


class Letters:
    """A tokenizer of single letters; some characters come as bytes."""

    def encode_as_pieces(self, text):
        return [x for ch in text for x in ([f"<0x{b:02X}>" for b in ch.encode()] if ord(ch) > 127 else [ch])]

    def decode_pieces(self, pieces):
        return bytes(int(p[3:5], 16) for p in pieces).decode(errors="replace")

    def piece_to_id(self, piece):
        return 100 + len(piece)


class TooMany(Letters):
    def encode_as_pieces(self, text):
        return [*text, "z"]


def test_tokenizers(spark):
    assert plugins.whole_pieces(Letters(), "aüb") == ["a", "ü", "b"]
    words = [("ab", 0.0, 1.0), ("ü", 1.0, 2.0)]
    assert plugins.timed_tokens(Letters(), words) == ([("a", 0.0, 0.5), ("b", 0.5, 1.0), (" ", 1.0, 1.5), ("ü", 1.5, 2.0)], [])
    assert plugins.timed_tokens(TooMany(), words)[1] == ["no characters are left for the token 'z'"]
    t = spark.createDataFrame([("d", i, s, w, a, b) for i, (s, w, a, b) in enumerate(TALKS["d1"])], "did string, idx int, speaker string, word string, start double, end double")
    for spaces in (True, False):
        x = {r.speaker: r for r in plugins.aligned_text(t, plugins.BuiltinTokenizer, spaces=spaces).collect()}
        assert all(not r.issues for r in x.values())
        if spaces:
            assert {r.speaker: r.ids for r in align.text_streams(t).collect()} == {s: r.ids for s, r in x.items()}
    with pytest.raises(Exception, match="no characters are left"):
        plugins.aligned_text(t, TooMany).collect()
    assert len(plugins.aligned_text(t, TooMany, strict=False).filter("size(issues) > 0").collect()) == 2
    crowd = spark.createDataFrame([("d", 0, "A", "a" * 13, 0.0, 0.0)], t.schema)
    lenient = plugins.aligned_text(crowd, Letters, strict=False).first()
    assert lenient.ids == [101] * 12 and "no frame is left for 1 of 13" in lenient.issues[0]
    with pytest.raises(Exception, match="no frame is left"):
        plugins.aligned_text(crowd, Letters).collect()
    many = spark.createDataFrame([("d", i, "A", "abc", 0.0, 0.0) for i in range(14)], t.schema)
    assert align.token_frames(many).filter("slot is null").count() == 2
    with pytest.raises(Exception, match="no frame is left for a token of d A"):
        align.token_frames(many, strict=True).collect()
    ids = spark.createDataFrame([("ab\nc",), (None,)], "x string").select(plugins.event_ids(F.col("x"), Letters).alias("i")).collect()
    assert [r.i for r in ids] == [[101, 101, 101, 101], []]


def test_audio(spark, tmp_path):
    at = folder(tmp_path)
    rows = {r.dialogue_id: r for r in audio.tokenized_audio(spark, at["wav"], chunk_s=2).collect()}
    assert set(rows) == set(TALKS) and len(rows["d1"].A) == 8 and {len(r) for r in rows["d1"].B} == {75}
    with wave.open(str(tmp_path / "wav" / "mono.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\0\0" * 100)
    with pytest.raises(Exception, match="stereo is needed"):
        audio.tokenized_audio(spark, at["wav"]).collect()
    stereo = np.stack([np.arange(100) * 300, -np.arange(100) * 300], 1).astype("<i2")
    with wave.open(str(tmp_path / "ramp.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(stereo.tobytes())
    both = audio.read_samples((tmp_path / "ramp.wav").read_bytes(), 200)
    assert both.shape == (2, 200) and np.allclose(both[0], -both[1]) and np.allclose(both[0][:198:2], stereo[:99, 0] / 2**15)


def test_files_of_arrays(spark, tmp_path):
    full = {k: ([0, 2], [0.5]) for k in ()}
    for name, extra in (("good", {}), ("short", {"A_pred_offsets": [0]})):
        data = {k: ([0, 1] if "offsets" in k else [3]) for k in arrays.EVENT_ARRAYS} | extra | full
        np.savez_compressed(tmp_path / f"{name}.npz", **data)
    np.savez_compressed(tmp_path / "one.npz", A_event_frame_pos=[1])
    (tmp_path / "bad.npz").write_bytes(b"junk")
    npz = arrays.read_npz(spark, str(tmp_path))
    assert [r.dialogue_id for r in arrays.valid_event_files(npz).collect()] == ["good"]
    rows = spark.createDataFrame([("x", [1, 2], [[1, 2], [3, 4]])], "dialogue_id string, A array<int>, B array<array<int>>")
    out = tmp_path / "out"
    assert [r.dialogue_id for r in arrays.write_npz(rows, str(out)).collect()] == ["x"]
    with np.load(out / "x.npz") as z:
        assert z["A"].tolist() == [1, 2] and z["B"].tolist() == [[1, 2], [3, 4]]
    ragged = spark.createDataFrame([("y", [[1, 2], [3]])], "dialogue_id string, A array<array<int>>")
    with pytest.raises(Exception):
        arrays.write_npz(ragged, str(out)).collect()
    assert sorted(p.name for p in out.iterdir()) == ["x.npz"]
    shards = spark.createDataFrame([(0, 1, [3.0, 4.0, 5.0, 0.0]), (0, 0, [0.0, 1.0, 2.0, 9.0])], "group int, rank int, values array<double>")
    params = spark.createDataFrame([(0, 0, "w", 4), (0, 1, "b", 3)], "group int, ord int, param string, n int")
    cut = {r.param: r.values for r in arrays.params_of(arrays.reassembled(shards, 2, alignment=2), params, 4).collect()}
    assert cut == {"w": [0.0, 1.0, 2.0, 9.0], "b": [3.0, 4.0, 5.0]}


def test_labels_and_counts(spark):
    df = spark.createDataFrame([("d", "A"), ("d", "USER"), ("e", None)], "dialogue_id string, speaker string")
    assert {tuple(r) for r in unknown_labels(df).collect()} == {("d", "USER", 1), ("e", "", 1)}
    with pytest.raises(Exception, match="not a speaker"):
        require_known_labels(df).collect()
    for bad in ({"USER": 0, "ASSISTANT": 1}, {"A": 0}, {"A": 1, "B": 1}):
        with pytest.raises(ValueError):
            channel_map(bad)
    assert spark.createDataFrame([(" \t a b\n\x1c",)], "x string").select(strip(F.col("x"))).first()[0] == "a b"
    rows, seen = counted(df, "labels", unknown=F.col("speaker").isNull())
    assert rows.count() == 3 and seen.get == {"rows": 3, "unknown": 1}
    t = transcripts.from_alignments(spark.createDataFrame([("d", 0, "hi", (0.5, 1.0), "x")], "did string, idx int, text string, span struct<start:double,end:double>, tag string"), "B")
    assert tuple(t.first()) == ("d", 0, "B", "hi", 0.5, 1.0)
    a = spark.createDataFrame([("d", 0, "A", "later", 0.3, 0.7), ("d", 1, "A", "last", 0.7, 0.9)], t.schema)
    b = spark.createDataFrame([("d", 0, "B", "first", 0.0, 0.2), ("d", 1, "B", "tie", 0.6, 0.7)], t.schema)
    assert [r.word for r in transcripts.merged_streams(a, b).orderBy("pos").collect()] == ["first", "later", "tie", "last"]


def test_config():
    with pytest.raises(ValueError, match="no training files"):
        DataConfig([])
    for bad in ({"train_speakers": ["A", "B"]}, {"eval_files": ["e"]}, {"warmup_start": 1}, {"warmup_start": 0, "warmup_end": 5}, {"hint_only": True, "warmup_start": 5, "warmup_end": 5}, {"batch_size": 0}, {"train_speakers": ["C"]}):
        with pytest.raises(ValueError):
            DataConfig(["x"], **bad)
    from dataclasses import asdict

    c = DataConfig(["x"], max_steps=5, output_dir="a")
    assert c.resumed({**asdict(c), "output_dir": "b", "max_steps": 9}) is None and c.resumed({**asdict(c), "run_id": "r1"}) == "r1"
    with pytest.raises(ValueError, match="max_length: 7 != None"):
        c.resumed({**asdict(c), "max_length": 7})


def test_ordered_helpers_over_ranges(spark):
    rnd = random.Random(6)
    rows = [("k", i, rnd.randrange(100)) for i in range(40)] + [("j", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    want = {}
    for k in "kj":
        vs = [v for a, _, v in rows if a == k]
        for i in range(len(vs)):
            want[k, i] = (vs[i + 1] if i + 1 < len(vs) else None, vs[i - 1] if i else None, sum(vs[: i + 1]), min(vs[i + 1 :], default=None))
    for ranges in (find_ranges(df, ["k"], "i", 7), Ranges(["k"], "i")):
        x = ranges.assign(df)
        x = following(following(x, ranges, ["i"], "v", "n"), ranges, ["i"], "v", "p", back=True)
        x = running(running(x, ranges, ["i"], {"s": ("sum", F.col("v"))}), ranges, ["i"], {"m": ("min", F.col("v"))}, ahead=True)
        assert {(r.k, r.i): (r.n, r.p, r.s, r.m) for r in x.collect()} == want
        assert (x.select(BUCKET).distinct().count() > 1) == ranges.split
    assert {(r.i, r.n) for r in numbered(df.select("i").repartition(3), "i", "n").collect()} == {(i, i) for i in range(40)}


def test_shift_has_its_own_ranges(spark):
    aug = batch.Augmentation(seed="s", shift_prob=0.5, shift_right=(2, 3), shift_left=(5, 6))
    row = list(range(100, 120))
    moved = [tuple(r.x) for r in spark.range(200).select(batch.maybe_shifted(F.array(*[F.lit(v) for v in row]), aug, F.col("id")).alias("x")).collect()]
    kinds = {tuple(row): "same", **{tuple([3] * s + row[:-s]): s for s in (2, 3)}, **{tuple(row[s:] + [3] * s): -s for s in (5, 6)}}
    seen = [kinds[m] for m in moved]
    assert set(seen) == {"same", 2, 3, -5, -6} and 60 < seen.count("same") < 140
