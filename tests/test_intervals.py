import random

from dialoom.functions.labels import side_of
from dialoom.operators.intervals import periods_and_gaps, speech_periods
from dialoom.operators.sequence import collapse_runs, find_ranges, stretches
from pyspark.sql import functions as F


def model(rows, join=200, most=60_000):
    out = set()
    for key in {r[0] for r in rows}:
        iv = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e >= s)
        if not iv or key is None:
            continue
        a, b = iv[0]
        for s, e in iv[1:]:
            if s - b >= join:
                out.add((key, "period", a, b))
                if s - b <= most:
                    out.add((key, "gap", b, s))
                a, b = s, e
            else:
                b = max(b, e)
        out.add((key, "period", a, b))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        s = rnd.choice([rnd.randrange(0, 400_000), rnd.randrange(0, 400) * 1000])
        rows.append((key, s if rnd.random() > 0.02 else None, s + rnd.choice([0, 150, 200, 900, 5000, -5]) if rnd.random() > 0.05 else None))
    return rows + rows[: n // 10]


def test_against_sweep_with_and_without_ranges(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 300)
        df = spark.createDataFrame(rows, "k string, s long, e long")
        for least in (10**6, 20):
            got = rows_of(periods_and_gaps(df, ["k"], "s", "e", min_rows=least))
            assert len(got) == len(set(got)) and set(got) == model(rows)


def test_limits_of_gap_and_join(spark):
    rows = [("x", 0, 100), ("x", 299, 400), ("x", 600, 700), ("x", 60_700, 60_800), ("x", 120_801, 120_900)]
    got = set(rows_of(periods_and_gaps(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e")))
    assert got == {("x", "period", 0, 400), ("x", "gap", 400, 600), ("x", "period", 600, 700), ("x", "gap", 700, 60_700), ("x", "period", 60_700, 60_800), ("x", "period", 120_801, 120_900)}


def test_empty_table_and_clashing_columns(spark):
    schema = "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double, received_at timestamp, kind string, _rank int"
    assert speech_periods(spark.createDataFrame([], schema)).collect() == []
    row = ("d", 0, "Left channel", None, 1.0, float("nan"), None, "period", 3)
    row2 = ("d", 1, "ch0", None, 1.0, 2.0, None, "gap", 3)
    assert rows_of(speech_periods(spark.createDataFrame([row, row2, row2], schema))) == [("d", "A", "period", 1000, 2000)]


def test_labels(spark):
    want = {"А": "A", " b ": "B", "[A]": "A", "SPK_B": "B", "channel 1": "B", "Left channel": "A", "right": "B", "S-A": "A", "0": "A", "noise": None, "": None, None: None, "AB": None}
    got = spark.createDataFrame([(k,) for k in want], "x string").select("x", side_of(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in got} == want


def test_runs_and_stretches_do_not_depend_on_ranges(spark):
    rnd = random.Random(5)
    rows, at = [], 0
    for i in range(600):
        at += rnd.choice([0, 1, 5, 5, 90])
        rows.append(("hot" if rnd.random() < 0.8 else "cold", i, at, rnd.choice("xxy")))
    df = spark.createDataFrame(rows, "k string, i int, at long, v string")
    results = []
    for least in (10**6, 25):
        ranges = find_ranges(df, ["k"], "at", least)
        assert ranges.split == (least == 25)
        runs = collapse_runs(ranges.assign(df), ranges, ["at", "i"], "v", "at", 60, {"m": (F.max("i"), F.max)})
        parts = stretches(ranges.assign(df), ranges, ["at", "i"], "at", 60, "no").select("k", "i", "no")
        results.append((sorted(rows_of(runs)), sorted(rows_of(parts))))
    assert results[0] == results[1]
    want = []
    for key in ("hot", "cold"):
        run = None
        for k, i, a, v in [r for r in rows if r[0] == key]:
            if run and run[1] == v and a - run[3] <= 60:
                run = (key, v, run[2], a, run[4] + 1, i)
            else:
                want += [run] if run else []
                run = (key, v, a, a, 1, i)
        want.append(run)
    assert results[0][0] == sorted(want)


def test_rows_without_a_key_are_not_repeats_of_each_other(spark):
    from dialoom.functions.labels import without_repeats

    df = spark.createDataFrame([("d", None, 1), ("d", None, 2), ("d", None, 2), ("d", 3, 1), ("d", 3, 9)], "a string, b int, v int")
    assert sorted((r.b is None, r.v) for r in without_repeats(df, ["a", "b"]).collect() if r.b is None) == [(True, 1), (True, 2)]
    assert without_repeats(df, ["a", "b"]).count() == 3
