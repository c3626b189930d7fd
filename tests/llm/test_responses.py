import pytest
from dialoom.llm.repeats import repeated_events
from dialoom.llm.responses import defects, length_spikes, row_defect

E = "dialogue_id string, ord int, timestamp_ms long, conversation_context string, prediction string, channel int, hint string, defect string"


@pytest.mark.parametrize(
    ("context", "prediction", "want"),
    [
        ("A: hi", None, "empty"), ("A: hi", " \n", "empty"), ("A: hi", "N/A", "empty"), ("A: hi", "[empty]", "empty"), ("A: hi", "…", "empty"),
        ("B: the price is twelve euros per night", "The price is twelve euros per night.", "copied"),
        ("A: x\nB: the price is twelve euros per night", "You said: the price is twelve euros per night", "copied"),
        ("B: the price is twelve euros per night", "the price is twelve eur", "copied"),
        ("B: the price is twelve euros per night", "The price is a secret.", None),
        ("A: could you tell me", "Could you tell me whether it is open?", None),
        ("A: is the room free", "I cannot help with this request.", "refusal"),
        ("A: is the room free", "Unfortunately I am not able to hold the room for an hour.", None),
        ("A: is the room free", "I can't find a free table, I hope that helps.", None),
        ("A: ist das zimmer noch frei", "Diese Anfrage möchte ich lieber nicht kommentieren.", "refusal"),
        ("A: is the room free for us on monday", "La chambre est libre pour vous lundi.", "other_language"),
        ("A: ist das zimmer für uns frei", "Ja, das Zimmer ist am Montag frei.", None),
        (None, "Yes.", None),
        ("", "word " * 20000, None),
    ],
)
def test_row_defects(context, prediction, want):
    assert row_defect(context, prediction)[0] == want


def test_truncated_and_forms_of_input(spark):
    full = ["The kitchen offers soup and can leave out the nuts on request.", "We would like a table in the garden for two.", "I was told there would be a code for the garden."]
    rows = [("d", i, i, "A: hello you", full[i % 3], 0, "", "x") for i in range(30)]
    rows += [("d", 100, 1, "A: hello you", "The kitchen offers soup and can leave out the", 0, "", "x"), ("d", 101, 1, "A: hello you", "We would like a table in the gar", 0, "", "x")]
    rows += [("d", 102, 1, "A: hello you", "we would like a table in the garden for two", None, None, "x"), ("d", 103, 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[-4:], E)
    got = {(r.ord, r.defect) for r in defects(df).collect()}
    assert got == {(100, "truncated"), (101, "truncated"), (103, "empty")}
    assert defects(df.filter("false")).collect() == [] and length_spikes(df.filter("false")).collect() == []


def run_rows(texts, step=5000, channel=0):
    return [("d", i, i * step, "", t, channel, "", "") for i, t in enumerate(texts)]


def test_runs(spark):
    a, b = "Go ahead and reserve the table at 9:15.", "go ahead and um reserve the table at 9:15"
    texts = [a, b, a.replace("reserve", "reserrve"), None, a, "Go ahead and reserve the table at 9:30.", "n/a", "Go ahead and reserve the table at 9:30!", a]
    rows = run_rows(texts) + [("d", 50, None, "", a, 0, "", ""), ("d", 51, 7000, "", "other words", 1, "", "")] + [("e", i, i * 60_000 + (i == 2), "", a, None, "", "") for i in range(3)]
    df = spark.createDataFrame(rows + rows[:2], E)
    for least in (10**6, 3):
        got = sorted(tuple(r) for r in repeated_events(df, min_rows=least).collect())
        assert got == [("d", 0, 0, 20000, 4), ("d", 0, 25000, 35000, 2), ("e", 0, 0, 60000, 2)]
    assert repeated_events(df.filter("false")).collect() == []


def test_another_word_is_no_slip(spark):
    texts = ["we meet at noon there", "we meet at nook there"] * 10
    assert repeated_events(spark.createDataFrame(run_rows(texts), E)).collect() == []


def test_two_misspellings_of_the_same_word(spark):
    words = ["table", "room", "garden", "kitchen", "door", "boat"]
    rows = [(f"o{i}", 0, 0, "", f"I would rather have the {w}.", 0, "", "") for i, w in enumerate(words)]
    rows += run_rows(["I would rahter have the boat.", "I would rther have the boat.", "I would rther have the boat.", "I woudl raather have the boat."])
    assert [tuple(r) for r in repeated_events(spark.createDataFrame(rows, E)).collect()] == [("d", 0, 0, 15000, 4)]


def test_a_hot_text_makes_no_misspelling_of_another_word(spark):
    text = "Meet me at {} Gable {}.".format
    rows = [(f"o{i}", 0, 0, "", text(w, t), 0, "", "") for w in ("Amber", "Umber") for t in ("today", "at noon", "by bus") for i in range(3)]
    rows = [(f"{r[0]}-{k}", *r[1:]) for k, r in enumerate(rows)] + [(f"h{i}", 0, 0, "", text("Amber", "today"), 0, "", "") for i in range(100)]
    rows += run_rows([text("Amber", "today"), text("Umber", "today")])
    rows += [("d", 8, 0, "", text("Umber", "todday"), 1, "", ""), ("d", 9, 5000, "", text("Umber", "today"), 1, "", "")]
    assert [tuple(r) for r in repeated_events(spark.createDataFrame(rows, E)).collect()] == [("d", 1, 0, 5000, 2)]


def test_a_length_limit_is_evidence(spark):
    """Twenty texts stop at 40 characters, each with a beginning of its own; elsewhere their last words go on."""
    names = ["amber", "birch", "cedar", "dahlia", "elder", "fern", "grape", "hazel", "iris", "jade", "kale", "lilac", "maple", "nettle", "olive", "peony", "quince", "rose", "sage", "tulip", "violet", "willow"]
    cut = [f"{n} is the house that {'so' * 9}"[:26] + " until you and" for n in names]
    whole = ["they wait until you and your friends are here."] * 2
    df = spark.createDataFrame([("d", i, i, "A: hello you", t, 0, "", "") for i, t in enumerate(cut + whole)], E)
    assert [(r.n_chars, r.n) for r in length_spikes(df).collect()] == [(40, 22)]
    assert {(r.ord, r.defect) for r in defects(df).collect()} == {(i, "truncated") for i in range(22)}
    assert defects(df.filter("ord >= 12")).collect() == []  # ten texts of a length are no spike
