from dialoom.llm.turns import is_transcript, parse_lines, said, text_turns, turns
from pyspark.sql import functions as F

W = "dialogue_id string, word_idx int, speaker string, word string, start_s double, end_s double, received_at string"


def table(spark, rows):
    return spark.createDataFrame([("d", i, s, w, float(t), e, "x") for i, (s, w, t, e) in enumerate(rows)], W)


def test_said(spark):
    want = {
        "hello": "hello", " the ": "the", "um(coughs)": "um", "an[laughter]": "an", "[hold": "", "music]": "", "<sil>": "", "<beep/>": "", "*laughs*": "", "*long": "", "pause*": "",
        "((crosstalk))": "", "{t=65.5}": "", "[00:00:02]": "", "00:00:37.666": "", "9:15": "9:15", "(29.5s)": "", "<23.71>": "", ">>>": "", ">>hello": "hello", "A:": "", "SpeakerB:": "",
        "<A>": "", "♪": "", "a*sigh*": "a", "i'm": "i'm", None: "", "": "", "17:45<noise>": "17:45", "um,": "um,", "B:good": "good",
    }
    got = spark.createDataFrame([(k,) for k in want], "w string").select("w", said(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == want


def test_turns_and_ranges(spark):
    rows = [("A", "the", 0, 1.0), ("A", "um", 1, 1.5), ("[A]", "cat", 2, None), ("B", "okay", 2.5, 3.0), ("A", "is", 3, 2.0), ("A", "here", 64, 65.0), (None, "[noise]", 64.5, 65.0), ("A", "at", 63.0, 64.0)]
    for least in (10**6, 2):
        got = sorted(tuple(r) for r in turns(table(spark, rows), min_rows=least).collect())
        assert got == [("d", "A", 0, "the cat"), ("d", "A", 3000, "is at here"), ("d", "B", 2500, "okay")]


def test_hesitation_of_the_language(spark):
    german = [("A", w, i, i + 1.0) for i, w in enumerate("ihr taxi wartet um acht vor dem haus ähm und er ist da".split())]
    assert turns(table(spark, german)).first().turn_text == "ihr taxi wartet um acht vor dem haus und er ist da"
    english = [("A", w, i, i + 1.0) for i, w in enumerate("the um taxi er is there".split())]
    assert turns(table(spark, english)).first().turn_text == "the taxi is there"


def test_repeats_ties_and_empty(spark):
    t = table(spark, [("A", "b", 1, 2.0), ("A", "a", 1, 2.0)])
    assert [r.turn_text for r in turns(t.unionByName(t)).collect()] == ["b a"]
    assert turns(table(spark, []).withColumn("side", F.lit("A"))).collect() == []


def test_layouts():
    srt = "1\n00:00:01,000 --> 00:00:02,000\nA: hello um there\n\n2\n00:00:02,500 --> 00:00:03,000\nB: [music] hi\n"
    assert [(x[1], x[2], x[3]) for x in parse_lines(srt)] == [("A", 1000, "hello there"), ("B", 2500, "hi")]
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<v A>one\n\n00:03.000 --> 00:04.000\n<v B>two (laughs)\n"
    assert [(x[1], x[2], x[3]) for x in parse_lines(vtt)] == [("A", 1000, "one"), ("B", 3000, "two")]
    plain = "[00:00:05] Caller: it is 9:15\r\nAgent: yes\nand more"
    assert [(x[1], x[3]) for x in parse_lines(plain)] == [("A", "it is 9:15"), ("B", "yes and more")]
    assert [(x[1], x[3]) for x in parse_lines("- one\n- two\n- three")] == [("A", "one"), ("B", "two"), ("A", "three")]
    talk = "Maria: hello\nJohn Smith: yes\nNote: this is one\nMaria: um so\nJohn Smith: fine"
    assert [(x[1], x[3]) for x in parse_lines(talk)] == [("Maria", "hello"), ("John Smith", "yes Note: this is one"), ("Maria", "so"), ("John Smith", "fine")]
    assert is_transcript(srt) and is_transcript(vtt) and is_transcript(talk) and is_transcript("A: x\nB: y") and not is_transcript("One line.\nNote: another\nand more\nand more.")


def test_words_between_the_halves_of_an_annotation(spark):
    rows = [("A", "wait", 0, 1.0), ("A", "[long", 1, 1.5), ("A", "so", 2, 2.5), ("A", "music]", 3, 3.5), ("A", "(open", 5, 5.5), ("A", "again", 6, 6.5)]
    assert [r.turn_text for r in turns(table(spark, rows)).collect()] == ["wait so again"]


def test_language_does_not_depend_on_ranges(spark):
    words = "ihr taxi wartet um acht vor dem haus".split() * 6 + "the um taxi er is there for you".split() * 6
    t = table(spark, [("A", w, 3.0 * i + (400 if i >= 48 else 0), None) for i, w in enumerate(words)])
    texts = [sorted((r.start_ms, r.turn_text) for r in turns(t, min_rows=n, most=m).collect()) for n, m in ((10**6, 10**6), (7, 10**6), (2, 0))]
    assert texts[0] == texts[1] == texts[2] and texts[0][0][1].count("um") == 6 and " um" not in texts[0][1][1]


def test_text_turns(spark):
    df = spark.createDataFrame([(1, "A: x\nB: y"), (2, None), (3, ""), (4, "No talk.")], "doc_id long, text string")
    assert {(r.doc_id, r.turn_no, r.speaker, r.turn_text) for r in text_turns(df, "doc_id", "text").collect()} == {(1, 0, "A", "x"), (1, 1, "B", "y")}
