"""SQL for the core queries, written another way than the operators, to compare their results with."""

SIDE = """CASE WHEN plain IN ('a','0','left','leftchannel','leftchan','leftch','l') OR regexp_full_match(plain, '(speaker|spk|sp|s|side|channel|chan|ch)[a0]') THEN 'A'
              WHEN plain IN ('b','1','right','rightchannel','rightchan','rightch','r') OR regexp_full_match(plain, '(speaker|spk|sp|s|side|channel|chan|ch)[b1]') THEN 'B' END"""
PLAIN = "regexp_replace(lower(translate(speaker, 'АВав', 'ABab')), '[^a-z0-9]', '', 'g')"

SIDED = f"""
sided AS (
  SELECT dialogue_id, word_idx, word, start_s, end_s, {SIDE} AS side
  FROM (SELECT DISTINCT dialogue_id, word_idx, word, start_s, end_s, {PLAIN} AS plain FROM words))
"""

# What strip takes away: white space of any kind.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SPACES}|{SPACES}$', '', 'g')"


OK = f"""
WITH {SIDED},
ok AS (SELECT dialogue_id, word_idx, {strip("word")} AS word, start_s, end_s, side, start_s - lag(start_s) OVER (PARTITION BY dialogue_id ORDER BY start_s, word_idx) AS gap
       FROM sided WHERE side IS NOT NULL AND end_s >= start_s AND word IS NOT NULL AND dialogue_id IS NOT NULL AND word_idx IS NOT NULL)"""

T = OK + """,
t AS (SELECT dialogue_id AS did, (row_number() OVER (PARTITION BY dialogue_id ORDER BY word_idx) - 1)::INT AS idx, side AS speaker, word, start_s AS start_t, end_s AS end_t FROM ok)
"""

BY_CALL = OK + """,
calls AS (SELECT *, dialogue_id || '#' || (sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id ORDER BY start_s, word_idx))::BIGINT AS did FROM ok),
t AS (SELECT did, (row_number() OVER (PARTITION BY did ORDER BY word_idx) - 1)::INT AS idx, side AS speaker, word, start_s AS start_t, end_s AS end_t FROM calls)
"""

TICKS = """,
u AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER d OR end_t - lag(end_t) OVER d >= 1.0 THEN idx END AS brk, count(*) OVER (PARTITION BY did) AS n FROM t WINDOW d AS (PARTITION BY did ORDER BY idx)),
v AS (SELECT *, coalesce(min(brk) OVER (PARTITION BY did ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) - idx - 1 AS fwd FROM u),
grid AS (SELECT did, unnest(range(1, ceil(max(end_t) / 5.0)::BIGINT)) AS k FROM t GROUP BY did),
j AS (SELECT g.k, v.* FROM grid g JOIN v USING (did) WHERE v.end_t <= g.k * 5.0),
c AS (SELECT did, k, count(*) AS n_so_far, max(idx) AS last_idx FROM j GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT c.*, l.word AS trigger_word, l.speaker, l.fwd, l.end_t AS last_end FROM c JOIN v l ON l.did = c.did AND l.idx = c.last_idx),
b AS (SELECT s.did, s.k, max(j.idx) FILTER (j.speaker <> s.speaker) AS other_idx FROM s JOIN j ON j.did = s.did AND j.k = s.k GROUP BY ALL),
r AS (SELECT s.did, s.k, count(*) FILTER (j.idx > coalesce(b.other_idx, -1)) AS back FROM s JOIN b USING (did, k) JOIN j ON j.did = s.did AND j.k = s.k GROUP BY ALL),
f AS (SELECT s.did, s.k, v.idx, v.word, v.speaker <> s.speaker AS other FROM s JOIN v ON v.did = s.did AND v.end_t > s.last_end),
f1 AS (SELECT did, k, min(idx) AS first_idx FROM f WHERE other GROUP BY ALL),
f2 AS (SELECT f.did, f.k, min(f.idx) AS stop_idx FROM f JOIN f1 USING (did, k) WHERE NOT other AND f.idx > first_idx GROUP BY ALL),
h AS (SELECT f.did, f.k, string_agg(f.word, ' ' ORDER BY f.idx) AS hint FROM f JOIN f1 USING (did, k) LEFT JOIN f2 USING (did, k) WHERE other AND f.idx >= first_idx AND (stop_idx IS NULL OR f.idx < stop_idx) GROUP BY ALL),
q AS (SELECT did, k, idx, word, row_number() OVER (PARTITION BY did, k ORDER BY idx DESC) AS back_no FROM j),
rec AS (SELECT did, k, string_agg(word, ' ' ORDER BY idx) AS recent_words FROM q WHERE back_no <= 5 GROUP BY ALL),
tick AS (
  SELECT s.did, s.k::INT AS k, s.n_so_far::INT AS n_so_far, s.trigger_word, s.speaker, rec.recent_words, r.back::DOUBLE / (r.back + s.fwd) AS ratio, coalesce(h.hint, '') AS hint, CASE WHEN s.speaker = 'A' THEN 1 ELSE 0 END AS channel
  FROM s JOIN r USING (did, k) JOIN rec USING (did, k) LEFT JOIN h USING (did, k))
"""

CONTEXT = """,
m AS (SELECT j.did, j.k, j.idx, j.word, j.speaker, CASE WHEN j.speaker = lag(j.speaker) OVER (PARTITION BY j.did, j.k ORDER BY j.idx) THEN 0 ELSE 1 END AS new FROM j JOIN c USING (did, k)),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY did, k ORDER BY idx) AS run FROM m),
m3 AS (SELECT did, k, run, any_value(speaker) || ': ' || string_agg(word, ' ' ORDER BY idx) AS line FROM m2 GROUP BY did, k, run),
ctx AS (SELECT did, k::INT AS k, string_agg(line, chr(10) ORDER BY run) AS context FROM m3 GROUP BY did, k)
"""

EVENT_ROWS = """, z AS (SELECT *, min(CASE WHEN hint = '' THEN k END) OVER (PARTITION BY did) AS stop FROM tick)
SELECT did, (k * 5000)::INT AS timestamp_ms, context AS conversation_context, hint AS prediction, n_so_far AS total_word_count, trigger_word, recent_words, ratio AS current_spoken_ratio, channel, hint
FROM z JOIN ctx USING (did, k) WHERE (stop IS NULL OR k < stop) AND ratio > 0.5"""

X = """
WITH x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS copy FROM examples) WHERE copy = 1 AND example_id IS NOT NULL)
"""


def _rows(expr: str) -> str:
    """The rows of a matrix: length and checksum."""
    return X + f""", s AS (SELECT example_id, {expr} AS m FROM x),
e AS (SELECT example_id, unnest(range(0, len(m)))::INT AS row_no, m FROM s WHERE m IS NOT NULL)
SELECT example_id, row_no, len(m[row_no + 1])::INT AS len, md5(array_to_string(m[row_no + 1], ',')) AS sum_md5 FROM e"""


DELAY = "(CASE WHEN i IN (1, 2, 10) THEN 0 ELSE 1 END)"
INIT = "(CASE WHEN i = 1 THEN 32000 ELSE 2048 END)"
EVERY_ROW = "[{} for i in range(1, 18)]"
U = "(concat('0x', substr(md5({}), 1, 7))::BIGINT / 268435456.0)"

EVENTS = X + """,
e AS (
  SELECT example_id, len(streams[1]) AS t, i - 1 AS ord0, oracle_event_frame_pos[i] AS pos, oracle_event_ratio[i] AS ratio, oracle_event_skip_forbid[i] AS forbid,
         oracle_pred_values[oracle_pred_offsets[i] + 1 : oracle_pred_offsets[i + 1]] AS pred, oracle_hint_values[oracle_hint_offsets[i] + 1 : oracle_hint_offsets[i + 1]] AS hint
  FROM x, unnest(range(1, len(oracle_pred_offsets))) AS q(i) WHERE oracle_event_frame_pos[i] IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY pos, ord0) - 1 AS ord FROM e),
k AS (SELECT *, CASE WHEN ratio >= 1.0 AND len(hint) > 0 THEN hint ELSE pred END AS tok FROM o WHERE pos >= 0 AND pos < t)
"""

GIVEN = X + """,
v AS (
  SELECT example_id, len(streams[1]) AS t, i - 1 AS event, oracle_event_frame_pos[i] + 1 AS pos, oracle_event_ratio[i] AS ratio, oracle_event_skip_forbid[i] AS forbid,
         oracle_pred_values[oracle_pred_offsets[i] + 1 : oracle_pred_offsets[i + 1]] AS pred, oracle_hint_values[oracle_hint_offsets[i] + 1 : oracle_hint_offsets[i + 1]] AS hint
  FROM x, unnest(range(1, len(oracle_event_frame_pos) + 1)) AS q(i) WHERE oracle_event_frame_pos[i] IS NOT NULL)
"""

EXAMPLES = X + """,
n AS (SELECT *, concat_ws('-', dialogue_id, example_id::VARCHAR) AS id FROM x WHERE len(streams[1]) > 0 AND main_speaker IN ('A', 'B'))"""


def _side(s: str) -> str:
    """The matrix of a side of an example: its text fitted to its audio, over it; the other side's text is empty."""
    own = "list_concat([list_concat(streams[1], [3 for z in range(0, len(streams[2]) - len(streams[1]))])[1 : len(streams[2])]], streams[2:9])"
    return f"CASE WHEN main_speaker = '{s}' THEN {own} ELSE list_concat([[3 for z in range(0, len(streams[10]))]], streams[10:17]) END"


def _matrix(m: str) -> str:
    return f"md5(array_to_string([array_to_string(r, ',') for r in {m}], ';'))"


def _ids(x: str) -> str:
    """Ids of a text by the built-in tokenizer, line by line."""
    piece = "(4 + concat('0x', substr(md5(p), 1, 7))::BIGINT % 31996)::INT"
    line = f"flatten(list_transform(list_filter(string_split(l, ' '), lambda w: w <> ''), lambda w: list_transform(regexp_extract_all('▁' || w, '(?s).{{1,4}}'), lambda p: {piece})))"
    return f"flatten(list_transform(string_split({x}, chr(10)), lambda l, i: list_concat(CASE WHEN i > 1 THEN [13] ELSE []::INT[] END, {line})))"


EVENT_FRAMES = f"""
WITH o AS (SELECT DISTINCT dialogue_id, ord, timestamp_ms, prediction, hint, current_spoken_ratio, coalesce(channel, 0) AS channel FROM oracle_raw),
f AS (SELECT *, CASE WHEN coalesce(lead(channel) OVER (PARTITION BY dialogue_id ORDER BY ord), -1) <> channel THEN 1 ELSE 0 END AS skip_forbid FROM o),
a AS (SELECT dialogue_id, ceil((max(end_s) + 1) * 12.5)::INT AS num_frames FROM words WHERE end_s IS NOT NULL GROUP BY dialogue_id),
g AS (SELECT f.dialogue_id, channel, ord, trunc(timestamp_ms / 1000.0::DOUBLE * 12.5::DOUBLE)::INT AS frame_pos, coalesce(current_spoken_ratio::FLOAT, 0)::DOUBLE AS ratio, skip_forbid, num_frames,
             {_ids(strip("prediction"))} AS pred, {_ids(strip("hint"))} AS hint
      FROM f LEFT JOIN a USING (dialogue_id) WHERE timestamp_ms IS NOT NULL),
ef AS (SELECT * FROM g WHERE frame_pos >= 0 AND (num_frames IS NULL OR frame_pos < num_frames) AND len(pred) + len(hint) > 0)
"""

DENSE = """,
w AS (SELECT example_id, pos + o AS frame, t, ord, CASE WHEN o = 0 THEN 32000 ELSE tok[o] END AS tok FROM k, unnest(range(0, len(tok) + 1)) AS q(o) WHERE len(tok) > 0),
fr AS (SELECT example_id, frame, arg_max(tok, ord) AS tok FROM w WHERE frame < t GROUP BY example_id, frame),
sl AS (SELECT example_id, len(streams[1])::INT AS t, z.f FROM x, unnest(range(0, len(streams[1]))) AS z(f)),
de AS (SELECT sl.example_id, sl.t, list(coalesce(fr.tok, 3) ORDER BY sl.f) AS r FROM sl LEFT JOIN fr ON fr.example_id = sl.example_id AND fr.frame = sl.f GROUP BY ALL)
"""

CHUNKS = """,
n AS (SELECT *, len(streams[1]) AS len FROM x WHERE len(streams[1]) > 0),
c AS (SELECT *, ((len + {m} - 1) // {m}) AS k FROM n),
b AS (SELECT c.*, q.chunk, q.chunk * (len // k) + least(q.chunk, len % k) AS start, len // k + CASE WHEN q.chunk < len % k THEN 1 ELSE 0 END AS size FROM c, unnest(range(0, k)) AS q(chunk))
"""

TOKENS = """,
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY did, speaker ORDER BY start_t, idx) = 1 THEN 0 ELSE 1 END AS lead FROM t WHERE len(word) > 0),
p AS (SELECT a.*, regexp_extract_all('▁' || word, '.{1,4}') AS ps FROM a),
b AS (SELECT p.*, i - 1 AS part, ps[i] AS piece, greatest((i - 1) * 4 - 1 + lead, 0) AS lo, (i - 1) * 4 + len(ps[i]) - 1 - 1 + lead AS hi, (end_t - start_t) / (len(word) + lead) AS step FROM p, unnest(range(1, len(ps) + 1)) AS q(i)),
k AS (SELECT did, speaker, idx, part::INT AS part, start_t, (4 + concat('0x', substr(md5(piece), 1, 7))::BIGINT % 31996)::INT AS token_id, start_t + lo * step AS ts, start_t + (hi + 1) * step AS te FROM b WHERE hi >= lo)
"""

SQL: dict[str, str] = {
    "p2_found": f"""
WITH {SIDED},
w AS (SELECT dialogue_id, side, round(start_s * 1000)::BIGINT AS s, round(end_s * 1000)::BIGINT AS e FROM sided WHERE side IS NOT NULL AND end_s IS NOT NULL),
x AS (SELECT *, max(e) OVER (PARTITION BY dialogue_id, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w WHERE e >= s),
y AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id, side ORDER BY s, e) AS no FROM x),
p AS (SELECT dialogue_id, side, no, min(s) AS f, max(e) AS t FROM y GROUP BY ALL),
g AS (SELECT *, lag(t) OVER (PARTITION BY dialogue_id, side ORDER BY no) AS lt FROM p)
SELECT dialogue_id, side, 'period' AS kind, f AS from_ms, t AS to_ms FROM p
UNION ALL SELECT dialogue_id, side, 'gap', lt, f FROM g WHERE f - lt BETWEEN 200 AND 60000""",
    "words": T + "SELECT * FROM t",
    "speaker_coverage": T + "SELECT did, count(*) AS n_words, count(DISTINCT speaker) AS n_speakers, max(end_t) AS max_end, count(DISTINCT speaker) = 2 AS complete FROM t GROUP BY did",
    "merged_word_streams": T + "SELECT did, (row_number() OVER (PARTITION BY did ORDER BY end_t, speaker, idx) - 1)::INT AS pos, speaker, word FROM t",
    "speaker_runs": T
    + """, a AS (SELECT *, idx - row_number() OVER (PARTITION BY did, speaker ORDER BY idx) AS grp FROM t),
b AS (SELECT did, speaker, grp, min(idx) AS lo, count(*) AS n_words, string_agg(word, ' ' ORDER BY idx) AS run_text FROM a GROUP BY ALL)
SELECT did, row_number() OVER (PARTITION BY did ORDER BY lo) AS run_no, speaker, n_words, run_text FROM b""",
    "spoken_ratio": T
    + """, u AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER d OR end_t - lag(end_t) OVER d >= 1.0 THEN idx END AS brk, count(*) OVER (PARTITION BY did) AS n, idx - row_number() OVER (PARTITION BY did, speaker ORDER BY idx) AS grp FROM t WINDOW d AS (PARTITION BY did ORDER BY idx)),
v AS (SELECT *, coalesce(min(brk) OVER (PARTITION BY did ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) - idx - 1 AS fwd, row_number() OVER (PARTITION BY did, speaker, grp ORDER BY idx) AS run_len FROM u)
SELECT did, idx, run_len::INT AS run_len, fwd, run_len::DOUBLE / (run_len + fwd) AS ratio FROM v""",
    "word_frames": T + "SELECT did, idx, round((start_t - (start_t % (1 / 12.5::DOUBLE))) / (1 / 12.5::DOUBLE))::INT AS frame FROM t",
    "oracle_ticks": T + TICKS + "SELECT did, k, n_so_far, trigger_word, speaker, recent_words, ratio FROM tick",
    "conversation_context": BY_CALL + TICKS + CONTEXT + "SELECT did, k, context FROM ctx",
    "next_utterance_hint": T + TICKS + "SELECT did, k, hint FROM tick",
    "oracle_events": T + TICKS + CONTEXT + EVENT_ROWS,
    "oracle_events_by_call": BY_CALL + TICKS + CONTEXT + EVENT_ROWS,
    "target_channel_events": T + TICKS
    + """, z AS (SELECT *, min(CASE WHEN hint = '' THEN k END) OVER (PARTITION BY did) AS stop FROM tick WHERE channel = 1)
SELECT did, (k * 5000)::INT AS timestamp_ms, hint, channel FROM z WHERE (stop IS NULL OR k < stop) AND ratio > 0.5""",
    "prompt_bands": T + TICKS + "SELECT did, k, CASE WHEN ratio <= 0.5 THEN 0 WHEN ratio <= 0.65 THEN 1 WHEN ratio <= 0.8 THEN 2 WHEN ratio <= 0.95 THEN 3 WHEN ratio <= 0.99 THEN 4 ELSE 5 END AS band FROM tick",
    "character_timing": BY_CALL
    + """, a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY did, speaker ORDER BY start_t, idx) = 1 THEN word ELSE ' ' || word END AS txt FROM t),
b AS (SELECT did, speaker, start_t, end_t, len(txt) AS n, unnest(range(0, len(txt))) AS i FROM a)
SELECT did, speaker, count(*) AS n_chars, sum(round((start_t + i * (end_t - start_t) / n) * 1000)::BIGINT)::BIGINT AS sum_ms FROM b GROUP BY ALL""",
    "text_frames": BY_CALL
    + TOKENS
    + """, f AS (SELECT *, round((ts - (ts % (1 / 12.5::DOUBLE))) / (1 / 12.5::DOUBLE))::INT AS frame, (row_number() OVER (PARTITION BY did, speaker ORDER BY start_t, idx, part) - 1)::INT AS ord FROM k),
m AS (SELECT did, speaker FROM (SELECT *, frame < lag(frame) OVER (PARTITION BY did, speaker ORDER BY ord) AS back FROM f) GROUP BY ALL HAVING NOT coalesce(bool_or(back), false)),
s AS (SELECT f.*, trunc((arg_max(te, ord) OVER (PARTITION BY did, speaker) + 1) * 12.5)::INT AS num_frames, ord + max(frame - ord) OVER (PARTITION BY did, speaker ORDER BY ord) AS slot FROM f JOIN m USING (did, speaker)),
e AS (SELECT *, slot > 0 AND slot - 1 > lag(slot, 1, -1) OVER (PARTITION BY did, speaker ORDER BY ord) AS mark FROM s)
SELECT did, speaker, idx, part, token_id, frame, CASE WHEN slot < num_frames THEN slot END AS slot, CASE WHEN slot < num_frames THEN mark END AS end_mark, num_frames FROM e""",
    "audio_codes": BY_CALL
    + """, n AS (SELECT did, ceil((max(end_t) + 1) * 12.5)::INT AS n FROM t GROUP BY did)
SELECT did, s AS speaker, k::INT AS codebook, n, md5(array_to_string([(f * 31 + k * 17 + CASE WHEN s = 'A' THEN 0 ELSE 3 END) % 2048 for f in range(0, n)], ',')) AS codes_md5 FROM n, unnest(['A', 'B']) AS q(s), unnest(range(0, 8)) AS r(k) WHERE n > 0""",
    "speaker_domain": f"""
SELECT dialogue_id, coalesce(speaker, '') AS label, count(*) AS n FROM (SELECT DISTINCT dialogue_id, word_idx, speaker, {PLAIN} AS plain FROM words) WHERE {SIDE} IS NULL GROUP BY ALL""",
    "event_frames": EVENT_FRAMES + "SELECT dialogue_id, channel, ord, frame_pos, ratio, skip_forbid, array_to_string(pred, ',') AS pred_ids, array_to_string(hint, ',') AS hint_ids FROM ef",
    "packed_channel_events": EVENT_FRAMES
    + """, y AS (SELECT dialogue_id, s.side, coalesce(list(frame_pos ORDER BY ord) FILTER (channel = s.ch), []) AS pos, coalesce(list(skip_forbid ORDER BY ord) FILTER (channel = s.ch), []) AS forbid,
  coalesce(list(pred ORDER BY ord) FILTER (channel = s.ch), []) AS pred, coalesce(list(hint ORDER BY ord) FILTER (channel = s.ch), []) AS hint FROM ef, (VALUES ('A', 0), ('B', 1)) AS s(side, ch) GROUP BY ALL)
SELECT dialogue_id, """
    + ", ".join(
        f"any_value({e}) FILTER (side = '{s}') AS {s}_oracle_{c}"
        for s in "AB"
        for c, e in {
            "event_frame_pos": "md5(array_to_string(pos, ','))",
            "event_ratio": "len(pos)::INT",
            "event_skip_forbid": "md5(array_to_string(forbid, ','))",
            **{f"{k}_values": f"md5(array_to_string(flatten({k}), ','))" for k in ("pred", "hint")},
            **{f"{k}_offsets": f"md5(array_to_string([coalesce(list_sum([len({k}[z]) for z in range(1, o)]), 0)::INT for o in range(1, len({k}) + 2)], ','))" for k in ("pred", "hint")},
        }.items()
    )
    + " FROM y GROUP BY dialogue_id",
    "assembled_rows": EXAMPLES
    + f"""
SELECT 'set/' || id AS id, {", ".join(f"{_matrix(_side(s))} AS {s.strip()}" for s in "AB")}, """
    + ", ".join(
        f"{'len({})::INT' if 'ratio' in c else 'md5(array_to_string({}, $$,$$))'} AS {s}_oracle_{c}".format(f"CASE WHEN main_speaker = '{s}' THEN oracle_{c} ELSE {'[0]' if 'offsets' in c else '[]'} END")
        for s in "AB"
        for c in ("event_frame_pos", "event_ratio", "event_skip_forbid", "pred_values", "pred_offsets", "hint_values", "hint_offsets")
    )
    + " FROM n",
    "speaker_examples": EXAMPLES
    + f""", m AS (SELECT id, main_speaker AS own, oracle_event_frame_pos AS pos, oracle_hint_values AS hints, {_side("A")} AS a, {_side("B")} AS b FROM n)
SELECT id, s AS main_speaker, 17 AS n_rows, {_matrix("CASE WHEN s = 'A' THEN list_concat(a, b[2:9]) ELSE list_concat(b, a[2:9]) END")} AS streams_md5,
md5(array_to_string(CASE WHEN s = own THEN pos ELSE [] END, ',')) AS pos_md5, md5(array_to_string(CASE WHEN s = own THEN hints ELSE [] END, ',')) AS hints_md5 FROM m, unnest(['A', 'B']) AS q(s)""",
    "undelayed_streams": _rows(f"CASE WHEN len(streams[1]) >= 2 THEN {EVERY_ROW.format(f'streams[i][{DELAY} + 1 : {DELAY} + len(streams[1]) - 1]')} END"),
    "delayed_streams": _rows(EVERY_ROW.format(f"list_concat(list_concat([{INIT} for z in range(0, {DELAY} + 1)], streams[i]), [CASE WHEN i = 1 THEN 3 ELSE 2048 END for z in range(0, 1 - {DELAY})])")),
    "main_speaker_streams": _rows("list_concat(streams[1:9], streams[10:17])"),
    "labels": _rows(EVERY_ROW.format(f"[CASE WHEN v < {INIT} THEN v ELSE -1 END for v in streams[i]]")),
    "chunk_bounds": X + CHUNKS.format(m=512) + "SELECT example_id, chunk::INT AS chunk, start::INT AS start, size::INT AS len FROM b",
    "chunked_events": X + CHUNKS.format(m=512) + "SELECT example_id, chunk::INT AS chunk, size::INT AS num_frames, array_to_string(list_sort([p - start for p in oracle_event_frame_pos if p >= start AND p < start + size]), ',') AS pos FROM b",
    "min_length_filter": X + CHUNKS.format(m=256) + "SELECT example_id, count(*) AS n_chunks, sum(size)::BIGINT AS n_frames FROM b WHERE size >= 128 GROUP BY example_id",
    "ragged_unpack": X + "SELECT example_id, (i - 1)::INT AS event, array_to_string(oracle_pred_values[oracle_pred_offsets[i] + 1 : oracle_pred_offsets[i + 1]], ',') AS ids FROM x, unnest(range(1, len(oracle_pred_offsets))) AS q(i)",
    "ragged_pack": X + "SELECT example_id, array_to_string(oracle_hint_values, ',') AS packed_values, array_to_string(oracle_hint_offsets, ',') AS packed_offsets FROM x",
    "oracle_frame_stream": EVENTS
    + """, w AS (SELECT example_id, pos + o AS frame, t, pos, ord, CASE WHEN o = 0 THEN 32000 ELSE tok[o] END AS tok FROM k, unnest(range(0, len(tok) + 1)) AS q(o) WHERE len(tok) > 0)
SELECT example_id, frame::INT AS frame, arg_max(tok, ord) AS tok FROM w WHERE frame < t GROUP BY example_id, frame""",
    "skip_and_jitter": EVENTS
    + f""", s AS (SELECT *, 0.1 + {U.format("'7|' || example_id || '|p'")} * 0.6 AS p, {U.format("'7|' || example_id || '|' || ord || '|skip'")} AS u, pos + floor({U.format("'7|' || example_id || '|' || ord || '|jitter'")} * 3)::INT AS at_frame FROM k),
w AS (SELECT example_id, at_frame + o AS frame, t, ord, CASE WHEN o = 0 THEN 32000 ELSE tok[o] END AS tok FROM s, unnest(range(0, len(tok) + 1)) AS q(o) WHERE len(tok) > 0 AND (forbid <> 0 OR u >= p))
SELECT example_id, frame::INT AS frame, arg_max(tok, ord) AS tok FROM w WHERE frame < t GROUP BY example_id, frame""",
    "shifted_oracle": EVENTS
    + DENSE
    + f""", s AS (SELECT example_id, t, r, {U.format("'7|' || example_id || '|shift'")} < 0.8 AS moved, {U.format("'7|' || example_id || '|shift side'")} < 0.5 AS rt, {U.format("'7|' || example_id || '|shift by'")} AS u FROM de),
v AS (SELECT *, greatest(1, least(1 + floor(u * CASE WHEN rt THEN 10 ELSE 15 END)::INT, t - 1)) AS s FROM s)
SELECT example_id, t, md5(array_to_string(CASE WHEN t <= 1 OR NOT moved THEN r WHEN rt THEN list_concat([3 for z in range(0, s)], r[1 : t - s]) ELSE list_concat(r[s + 1 : t], [3 for z in range(0, s)]) END, ',')) AS sum_md5 FROM v""",
    "collated_batch": EVENTS
    + DENSE
    + f""", p AS (SELECT example_id, len(streams[1])::INT AS n, row_number() OVER (ORDER BY example_id) - 1 AS r FROM x WHERE len(streams[1]) > 0),
bt AS (SELECT example_id, n, (r // 8)::INT AS batch_id, (r % 8)::INT AS pos_in_batch, max(n) OVER (PARTITION BY r // 8) AS longest FROM p)
SELECT batch_id, pos_in_batch, example_id, longest, {", ".join(_matrix(f"[list_concat(q, [-1 for z in range(0, longest - n)]) for q in {c}]") + f" AS {k}" for k, c in (("input_ids", "streams"), ("labels", "labels")))},
md5(array_to_string([CASE WHEN z < n THEN 1 ELSE -1 END for z in range(0, longest)], ',')) AS text_mask, md5(array_to_string(list_concat(de.r, [3 for z in range(0, longest - n)]), ',')) AS oracle_tokens
FROM bt JOIN x USING (example_id) JOIN de USING (example_id)""",
    "training_order": """
WITH o AS (SELECT example_id, row_number() OVER (ORDER BY upper(substr(md5('7|' || example_id || '|order'), 1, 7)) || '|' || example_id) - 1 AS r FROM (SELECT DISTINCT example_id FROM examples WHERE example_id IS NOT NULL))
SELECT example_id, (r // 8)::INT AS batch_id, (r % 8)::INT AS pos_in_batch FROM o WHERE r // 8 >= 3""",
    "first_dialogues": "SELECT DISTINCT dialogue_id, lang FROM dialogues WHERE dialogue_id IN (SELECT DISTINCT dialogue_id FROM dialogues ORDER BY 1 LIMIT 10)",
    "event_json": BY_CALL
    + TICKS
    + CONTEXT
    + EVENT_ROWS.replace("SELECT did,", ", ev AS (SELECT did,", 1)
    + """)
SELECT did AS dialogue_id, count(*) AS n, count(*) AS n_read, md5(string_agg(concat_ws('|', timestamp_ms, prediction, channel, hint), chr(10) ORDER BY timestamp_ms)) AS events_md5 FROM ev GROUP BY did""",
    "token_dropout": X
    + f""", s AS (SELECT example_id, i - 1 AS i, streams[1][i] AS v FROM x, unnest(range(1, len(streams[1]) + 1)) AS q(i))
SELECT example_id, count(*) FILTER (v = 3 OR (v NOT IN (0, 32000) AND {U.format("'7|' || example_id || '|' || i || '|drop'")} < 0.2))::INT AS n_pad FROM s GROUP BY example_id""",
    "curriculum_mode": f"""
SELECT example_id, step::INT AS step, CASE WHEN step <= 0 THEN true WHEN step >= 1000 THEN false ELSE {U.format("'7|' || example_id || '|mode'")} < 1.0 - step / 1000.0 END AS hint_only
FROM (SELECT DISTINCT example_id FROM examples), unnest([0, 250, 500, 750, 1000]) AS q(step) WHERE example_id IS NOT NULL""",
    "batch_padding": X
    + """, a AS (SELECT example_id, len(streams[1])::INT AS n, row_number() OVER (ORDER BY example_id) - 1 AS r FROM x),
b AS (SELECT example_id, (r // 8)::INT AS batch_id, (r % 8)::INT AS pos_in_batch, n, max(n) OVER (PARTITION BY r // 8) AS longest FROM a)
SELECT *, (n - (longest - n))::INT AS mask_sum FROM b""",
    "missing_ids": """
SELECT 'dialogues' AS side, dialogue_id FROM (SELECT dialogue_id FROM words EXCEPT SELECT dialogue_id FROM dialogues)
UNION ALL SELECT 'words', dialogue_id FROM (SELECT dialogue_id FROM dialogues EXCEPT SELECT dialogue_id FROM words)""",
    "resume_pending": """
SELECT DISTINCT dialogue_id FROM dialogues WHERE dialogue_id NOT IN (SELECT dialogue_id FROM examples WHERE dialogue_id IS NOT NULL AND streams IS NOT NULL AND len(oracle_pred_offsets) = len(oracle_event_frame_pos) + 1)""",
    "shard_assignment": "SELECT dialogue_id, ((row_number() OVER (ORDER BY dialogue_id) - 1) // 30)::INT AS shard FROM (SELECT DISTINCT dialogue_id FROM dialogues)",
    "dataset_rows": """
SELECT dialogue_id, w AS n_words, e AS n_events, x AS n_examples
FROM (SELECT dialogue_id, count(DISTINCT word_idx) AS w FROM words GROUP BY 1) JOIN (SELECT dialogue_id, count(DISTINCT ord) AS e FROM oracle_raw GROUP BY 1) USING (dialogue_id)
JOIN (SELECT dialogue_id, count(DISTINCT example_id) AS x FROM examples GROUP BY 1) USING (dialogue_id)""",
    "masked_loss_metrics": X
    + f""", s AS (SELECT example_id, i - 1 AS i, labels[1][i] AS label FROM x, unnest(range(1, len(labels[1]) + 1)) AS q(i)),
l AS (SELECT example_id % 5 AS step, label, {U.format("example_id || '|' || i || '|nll'")} AS u FROM s),
m AS (SELECT step, avg(u * 4) FILTER (label NOT IN (3, -1)) AS a, avg(CASE WHEN u < 0.4 THEN 1.0 ELSE 0.0 END) FILTER (label NOT IN (3, -1)) AS acc, avg(u * 4) FILTER (label = 3) AS p, count(*) FILTER (label NOT IN (3, -1)) AS n, count(*) FILTER (label = 3) AS np FROM l GROUP BY step)
SELECT step, round(a, 9) AS nonpad_loss, round(acc, 9) AS nonpad_acc, round(p, 9) AS pad_loss, round(coalesce(a, 0) + 0.5 * coalesce(p, 0), 9) AS text_loss, n AS n_nonpad, np AS n_pad FROM m""",
    "nanmean_metrics": """
WITH x AS (SELECT DISTINCT dialogue_id, ord, channel, current_spoken_ratio FROM oracle_raw)
SELECT coalesce(channel, 0)::VARCHAR AS key, round(avg(current_spoken_ratio) FILTER (ord % 7 <> 0), 9) AS mean_value, count(*) AS n FROM x GROUP BY 1""",
    "token_timing": BY_CALL + TOKENS + "SELECT did, speaker, idx, part, token_id, round(ts * 1e6)::BIGINT AS start_us, round(te * 1e6)::BIGINT AS end_us FROM k",
    "prediction_ids": """
WITH o AS (SELECT DISTINCT dialogue_id, ord, {P} AS prediction FROM oracle_raw),
l AS (SELECT dialogue_id, ord, i AS line_no, ls[i] AS line FROM (SELECT dialogue_id, ord, string_split(prediction, chr(10)) AS ls FROM o), unnest(range(1, len(ls) + 1)) AS q(i)),
w AS (SELECT dialogue_id, ord, line_no, list_concat(CASE WHEN line_no > 1 THEN [13] ELSE [] END, flatten([[(4 + concat('0x', substr(md5(p), 1, 7))::BIGINT % 31996)::INT for p in regexp_extract_all('▁' || x, '(?s).{1,4}')] for x in string_split(line, ' ') if x <> ''])) AS ids FROM l)
SELECT dialogue_id, ord, array_to_string(flatten(list(ids ORDER BY line_no)), ',') AS ids FROM w GROUP BY dialogue_id, ord""".replace("{P}", strip("prediction")),
    "per_file_speakers": """
SELECT DISTINCT dialogue_id, service, s AS main_speaker FROM dialogues, unnest(['A', 'B']) AS q(s) WHERE (coalesce(service, '') <> 'rail' OR s = 'A') AND (coalesce(service, '') <> 'taxi' OR s = 'B')""",
    "embedding_stats": """
WITH e AS (SELECT embedding, n FROM embeddings, (SELECT max(len(embedding)) AS n FROM embeddings) WHERE len(embedding) = n)
SELECT i::INT AS i, j::INT AS j, round(covar_pop(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE), 8) AS cov, round(avg(embedding[i + 1]::DOUBLE), 8) AS mean_i
FROM e, unnest(range(0, n)) AS a(i), unnest(range(0, n)) AS b(j) WHERE j >= i GROUP BY i, j""",
    "masked_loss_total": X
    + f""", r AS (SELECT example_id, k, labels[k + 1] AS ls FROM x, unnest(range(0, len(labels))) AS q(k)),
s AS (SELECT example_id, k, i - 1 AS i, ls[i] AS label FROM r, unnest(range(1, len(ls) + 1)) AS q(i)),
l AS (SELECT example_id % 5 AS step, label, CASE WHEN k = 0 THEN 't' WHEN k = 1 THEN 's' WHEN k < 9 THEN 'a' WHEN k = 9 THEN 'su' ELSE 'au' END AS g, {U.format("example_id || '|' || i || CASE WHEN k = 0 THEN '' ELSE '|' || k END || '|nll'")} AS u FROM s WHERE label <> -1),
h AS (SELECT step, CASE WHEN g = 't' AND label = 3 THEN 'p' ELSE g END AS g, avg(u * 4) AS loss, sum(u * 4) AS total, avg(CASE WHEN u < 0.4 THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n, CASE WHEN g IN ('s', 'su') THEN 100 ELSE 1 END AS w FROM l GROUP BY ALL),
m AS (SELECT step, coalesce(any_value(loss) FILTER (g = 't'), 0) + 0.5 * coalesce(any_value(loss) FILTER (g = 'p'), 0) AS txt, coalesce(sum(w * total) FILTER (g NOT IN ('t', 'p')) / sum(w * n) FILTER (g NOT IN ('t', 'p')), 0) AS aud FROM h GROUP BY step)
SELECT step, {", ".join(f"round(any_value(loss) FILTER (g = '{g}'), 9) AS {c}_loss, round(any_value(acc) FILTER (g = '{g}'), 9) AS {c}_acc" for g, c in (("t", "nonpad"),))}, round(any_value(loss) FILTER (g = 'p'), 9) AS pad_loss,
coalesce(any_value(n) FILTER (g = 't'), 0) AS n_nonpad, coalesce(any_value(n) FILTER (g = 'p'), 0) AS n_pad,
{", ".join(f"round(any_value(loss) FILTER (g = '{g}'), 9) AS {c}_loss, round(any_value(acc) FILTER (g = '{g}'), 9) AS {c}_acc, coalesce(any_value(n) FILTER (g = '{g}'), 0) AS n_{c}" for g, c in (("s", "semantic"), ("a", "acoustic"), ("su", "semantic_user"), ("au", "acoustic_user")))},
round(any_value(aud), 9) AS audio_loss, round(any_value(txt), 9) AS text_loss, round(any_value(txt + aud), 9) AS total_loss
FROM h JOIN m USING (step) GROUP BY step""",
    "text_audio_merge": _rows("list_concat([list_concat(streams[1], [3 for z in range(0, len(streams[2]) - len(streams[1]))])[1 : len(streams[2])]], streams[2:9])"),
    "aligned_events": GIVEN + "SELECT example_id, event::INT AS event, pos::INT AS pos, ratio, forbid AS skip_forbid, array_to_string(pred, ',') AS pred, array_to_string(hint, ',') AS hint FROM v WHERE pos >= 0 AND pos < t + 2",
    "training_examples": GIVEN
    + f""", y AS (SELECT example_id, list_concat(streams[1:9], streams[10:17]) AS streams FROM x WHERE len(streams[1]) > 0),
d AS (SELECT example_id, {EVERY_ROW.format(f"list_concat(list_concat([{INIT} for z in range(0, {DELAY} + 1)], streams[i]), [CASE WHEN i = 1 THEN 3 ELSE 2048 END for z in range(0, 1 - {DELAY})])")} AS m FROM y),
n AS (SELECT *, len(m[1]) AS len, (len(m[1]) + 511) // 512 AS k FROM d),
b AS (SELECT n.*, q.chunk, q.chunk * (len // k) + least(q.chunk, len % k) AS start, len // k + CASE WHEN q.chunk < len % k THEN 1 ELSE 0 END AS size FROM n, unnest(range(0, k)) AS q(chunk)),
c AS (SELECT example_id, chunk, start, size, {EVERY_ROW.format("m[i][start + 1 : start + size]")} AS m FROM b WHERE size >= 128),
g AS (SELECT c.example_id, chunk, list(pos - start ORDER BY pos, event) AS pos, list(ratio ORDER BY pos, event) AS ratio, list(forbid ORDER BY pos, event) AS forbid, list(pred ORDER BY pos, event) AS pred, list(hint ORDER BY pos, event) AS hint
      FROM c JOIN v ON v.example_id = c.example_id AND pos >= start AND pos < start + size GROUP BY ALL)
SELECT example_id, chunk::INT AS chunk, 17 AS num_streams, size::INT AS num_frames, md5(array_to_string([array_to_string(r, ',') for r in m], ';')) AS streams_md5,
md5(array_to_string({EVERY_ROW.format(f"array_to_string([CASE WHEN v < {INIT} THEN v ELSE -1 END for v in m[i]], ',')")}, ';')) AS labels_md5,
coalesce(array_to_string(pos, ','), '') AS pos, coalesce(ratio, []) AS ratio, coalesce(array_to_string(forbid, ','), '') AS skip_forbid,
{", ".join(f"coalesce(array_to_string(flatten({k}), ','), '') AS {k}_values, coalesce(array_to_string([coalesce(list_sum([len({k}[z]) for z in range(1, o)]), 0)::INT for o in range(1, len({k}) + 2)], ','), '0') AS {k}_offsets" for k in ("pred", "hint"))}
FROM c LEFT JOIN g USING (example_id, chunk)""",
}
