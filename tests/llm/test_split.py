import random

from dialoom.llm.split import cut_points, example_pauses, one_copy, pause_list, pieces

EVENTS = "oracle_event_frame_pos array<int>, oracle_event_ratio array<float>, oracle_event_skip_forbid array<tinyint>, oracle_pred_values array<int>, oracle_pred_offsets array<int>, oracle_hint_values array<int>, oracle_hint_offsets array<int>"
X = f"example_id long, streams array<array<int>>, labels array<array<int>>, num_frames int, {EVENTS}, piece string"
NONE = (None,) * 7


def silence(spark):
    return spark.createDataFrame([(k, 7) for k in range(8)], "codebook int, code int")


def example(n, quiet, i=1, events=()):
    rows = [[3 if f in quiet else 9 for f in range(n)]] + [[7 if f in quiet else 8 for f in range(n)] for _ in range(16)]
    k = len(events)
    return (i, rows, rows, None, list(events), [0.5] * k, [0] * k, list(range(k)), list(range(k + 1)), [], [0] * (k + 1), "x")


def test_pauses_are_read_by_columns(spark):
    quiet = set(range(100, 113)) | set(range(200, 212)) | set(range(587, 600))
    df = spark.createDataFrame([example(600, quiet), example(600, quiet), example(512, quiet, 2), (3, None, None, None, *NONE, "x"), (None, *example(600, quiet)[1:])], X)
    found = example_pauses(df, silence(spark))
    assert [(r.example_id, r.n_frames, [tuple(p) for p in r.pauses]) for r in found.collect()] == [(1, 600, [(100, 112), (587, 599)])]  # 12 frames are too few
    assert sorted(tuple(r) for r in pause_list(df, silence(spark)).collect()) == [(1, 100), (1, 587)]
    assert example_pauses(df.filter("false"), silence(spark)).collect() == []
    assert pause_list(spark.createDataFrame([example(600, set())], X), silence(spark)).collect() == []


def random_pauses(rnd, n, gap=300):
    ps, at = [], 0
    while at < n:
        at += rnd.randrange(20, gap)
        ps.append((at, at + rnd.randrange(13, 60)))
        at = ps[-1][1] + 1
    return [p for p in ps if p[1] < n]


def inside(cut, ps):
    return next((b - a + 1 for a, b in ps if a < cut <= b), 0)


def test_fewest_pieces_within_the_limit():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randrange(0, 4000)
        ps = random_pauses(rnd, n)
        b = cut_points(n, ps)
        assert (b == []) == (n == 0)
        if b:
            assert b[0][0] == 0 and b[-1][1] == n and all(0 < y - x <= 512 for x, y in b)
            assert all(q[0] == p[1] - 25 and q[1] > p[1] for p, q in zip(b, b[1:]))
            assert len(b) == (1 if n <= 512 else -(-(n - 25) // 487))
    assert cut_points(700, [(340, 380)])[0][1] == 360
    assert len(cut_points(60_000, random_pauses(rnd, 60_000))) == 124


def test_no_other_division_has_more_cuts_within_pauses():
    rnd = random.Random(2)

    def every(n, limit, overlap, start=0, end=0):
        """All divisions into the fewest pieces, by trying every cut."""
        least = -(-(n - overlap) // (limit - overlap))

        def go(ends):
            if len(ends) == least - 1:
                if n - ends[-1] + overlap <= limit:
                    yield ends
                return
            begin = ends[-1] - overlap if ends else 0
            for c in range((ends[-1] if ends else overlap) + 1, min(begin + limit, n - 1) + 1):
                yield from go([*ends, c])

        return go([])

    for _ in range(60):
        n = rnd.randrange(25, 60)
        ps = [p for p in sorted({(a, a + rnd.randrange(2, 6)) for a in rnd.sample(range(n), 3)}) if p[1] < n]
        ps = [p for i, p in enumerate(ps) if i == 0 or p[0] > ps[i - 1][1] + 1]
        got = [b for _, b in cut_points(n, ps, 20, 3)[:-1]]
        rank = lambda cuts: (sum(inside(c, ps) > 0 for c in cuts), sum(inside(c, ps) for c in cuts))
        assert rank(got) == max(rank(e) for e in every(n, 20, 3))


def test_pieces_hold_every_frame_and_event(spark):
    df = spark.createDataFrame([example(1300, set(range(400, 460)), events=[900, 3, 3, 1299, -1, 1300, 480])], X)
    rows = pieces(df, silence(spark)).orderBy("piece").collect()
    text = example(1300, set(range(400, 460)))[1][0]
    back = []
    for r in rows:
        assert len(r.streams) == 17 and r.streams[0] == text[r.frame_from : r.frame_to] and len(r.labels[16]) == r.frame_to - r.frame_from
        back += [(e.pos + r.frame_from, e.i, e.pred) for e in r.events]
    assert back == [(3, 1, [1]), (3, 2, [2]), (480, 6, [6]), (900, 0, [0]), (1299, 3, [3])]
    assert [r.frame_to for r in rows] == [430, 875, 1300]


def test_copies_of_an_example_in_files(spark, tmp_path):
    rows = [example(1300, set(), 1, [5]), example(700, set(), 2), example(1300, set(), 1, [5])]
    for k in range(2):
        spark.createDataFrame(rows, X).coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    for df in (stored, stored.dropDuplicates()):
        assert sorted((r.example_id, r.piece) for r in pieces(df, silence(spark)).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert sorted(r.example_id for r in one_copy(stored, most=0).collect()) == [1, 2]
    assert pieces(stored.filter("false"), silence(spark)).collect() == []
