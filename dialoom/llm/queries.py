"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.session import read_table


def p1_found(spark, d):
    from dialoom.llm.responses import defects

    return defects(read_table(spark, d, "oracle_raw"))


def p1_length_spikes(spark, d):
    from dialoom.llm.responses import length_spikes

    return length_spikes(read_table(spark, d, "oracle_raw"))


def p3_found(spark, d):
    from dialoom.llm.repeats import repeated_events

    return repeated_events(read_table(spark, d, "oracle_raw"))


def p4_found(spark, d):
    from dialoom.llm.turns import turns

    return turns(read_table(spark, d, "words"))


def p4_document_turns(spark, d):
    from dialoom.llm.turns import text_turns

    return text_turns(read_table(spark, d, "documents"), "doc_id", "text")


def p5_found(spark, d):
    from dialoom.llm.split import pause_list

    return pause_list(read_table(spark, d, "examples", wide=True), read_table(spark, d, "silence_codes"))


def p5_pieces(spark, d):
    from dialoom.llm.split import pieces

    return pieces(read_table(spark, d, "examples", wide=True), read_table(spark, d, "silence_codes"))


def p6_containers(spark, d):
    from dialoom.llm.packing import containers

    return containers(read_table(spark, d, "documents"))


def p6_report(spark, d):
    from dialoom.llm.packing import containers, packing_report

    return packing_report(containers(read_table(spark, d, "documents")))


def p7_found(spark, d):
    from dialoom.llm.leaks import leaked_items

    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_reparameterised(spark, d):
    from dialoom.llm.leaks import reparameterised

    return reparameterised(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark, d):
    from dialoom.llm.privacy import personal_finds

    return personal_finds(read_table(spark, d, "documents"))


def p8_redacted(spark, d):
    """The key is the data owner's: the session's setting spark.dialoom.redaction.key. Without one, a key is drawn that
    nobody knows; then placeholders are linked within this result only."""
    import secrets

    from dialoom.llm.privacy import redacted

    return redacted(read_table(spark, d, "documents"), key=spark.conf.get("spark.dialoom.redaction.key", None) or secrets.token_bytes(32))


def queries():
    return {f.__name__: f for f in (p1_found, p1_length_spikes, p3_found, p4_found, p4_document_turns, p5_found, p5_pieces, p6_containers, p6_report, p7_found, p7_reparameterised, p8_found, p8_redacted)}


P5 = """
WITH x AS (SELECT example_id, any_value(streams) AS streams FROM examples WHERE len(streams[1]) > 512 GROUP BY example_id),
s AS (SELECT list(codes ORDER BY codebook) AS codes FROM (SELECT codebook, list(code) AS codes FROM silence_codes GROUP BY codebook)),
f AS (
  SELECT example_id, i - 1 AS f, streams[1][i] IN (3, 0) AS quiet_text,
         [coalesce(list_contains(codes[(k % 8) + 1], streams[k + 2][i]), false) for k in range(0, 16)] AS quiet
  FROM x, s, unnest(range(1, len(streams[1]) + 1)) AS q(i)),
r AS (SELECT example_id, f, f - row_number() OVER (PARTITION BY example_id ORDER BY f) AS run FROM f WHERE quiet_text AND NOT list_contains(quiet, false))
SELECT example_id, min(f)::INT AS pause_frame FROM r GROUP BY example_id, run HAVING count(*) >= 13"""


def _p4() -> str:
    from dialoom.llm.text import FUNCTION_WORDS, HESITATION, HESITATION_NOT_GERMAN
    from dialoom.llm.turns import LANGUAGES, NOTES, STAMP, WHOLE
    from dialoom.plans.oracle import PLAIN, SIDE

    lit = lambda x: "'" + x.replace("'", "''") + "'"
    x = "coalesce(word, '')"
    for pattern, back in (
        (NOTES, ""), (WHOLE, ""), (STAMP, ""),
        (r"[\[({<][^\])}>]*$", ""), (r"(^|[\p{L}\p{N}])\*[^*]+$", r"\1"),
        (r"^[^\[({<]*[\])}>]", ""), (r"^[^*]+\*($|[\p{L}\p{N}])", r"\1"),
    ):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(back)}, 'g')"
    label = r"^(?i:(?:speaker|spk|sprecher|hablante|turn)[ _.-]?(?:[ab]|\d+)?\s*:|[ab]\s*:|(?:speaker|spk)[ _.-]?[ab]$)"
    marks = f"""CASE WHEN regexp_matches(x, '^>{{1,3}}') THEN regexp_replace(x, '^>{{1,3}}', '') WHEN regexp_matches(x, '^(-{{1,2}}|#+)(\\p{{L}}|$)') THEN regexp_replace(x, '^(?:-{{1,2}}|#+)(\\p{{L}}|$)', '\\1')
 ELSE regexp_replace(x, {lit(label)}, '') END"""
    outer = r"[\s\p{Z}\x{200B}\x{FEFF}]+"
    words = {k: ", ".join(lit(w) for w in FUNCTION_WORDS[k]) for k in LANGUAGES}
    return f"""
WITH s AS (SELECT dialogue_id, word_idx, word, start_s, plain, {SIDE} AS side FROM (SELECT *, {PLAIN} AS plain FROM words) WHERE dialogue_id IS NOT NULL AND start_s IS NOT NULL AND NOT isnan(start_s)),
c AS (SELECT dialogue_id, floor(start_s / 60)::BIGINT AS minute, {", ".join(f"count(*) FILTER (lower(translate(word, '.,!?;:', '')) IN ({v})) AS {k}" for k, v in words.items())} FROM s WHERE side IS NOT NULL GROUP BY ALL),
g AS (SELECT dialogue_id, minute + d AS minute FROM c, unnest(range(-2, 3)) AS q(d) GROUP BY ALL HAVING sum(de) > greatest(sum(en), sum(es), sum(fr))),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dialogue_id, start_s, word_idx) AS copy FROM s WHERE side IS NOT NULL) WHERE copy = 1 OR word_idx IS NULL),
x AS (SELECT *, {x} AS x FROM o),
m AS (SELECT *, regexp_replace({marks}, '^{outer}|{outer}$', '', 'g') AS said FROM x),
b AS (SELECT *, lower(regexp_replace(said, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS bare FROM m WHERE regexp_matches(said, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT b.*, round(start_s * 1000)::BIGINT AS ms FROM b LEFT JOIN g ON g.dialogue_id = b.dialogue_id AND g.minute = floor(start_s / 60)::BIGINT
  WHERE NOT regexp_matches(bare, {lit(HESITATION)}) AND (NOT regexp_matches(bare, {lit(HESITATION_NOT_GERMAN)}) OR g.minute IS NOT NULL)),
n AS (SELECT *, CASE WHEN lag(side) OVER w = side AND ms - lag(ms) OVER w <= 60000 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY dialogue_id ORDER BY start_s, word_idx)),
t AS (SELECT *, sum(new) OVER (PARTITION BY dialogue_id ORDER BY start_s, word_idx) AS turn FROM n)
SELECT dialogue_id, side, min(ms) AS start_ms, string_agg(said, ' ' ORDER BY start_s, word_idx) AS turn_text FROM t GROUP BY dialogue_id, side, turn"""


def oracle_sql():
    return {"p4_found": _p4(), "p5_found": P5}
