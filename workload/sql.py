"""DuckDB twins of ``adapters.py`` and the expected results of every query."""

from __future__ import annotations

from workload.adapters import (
    CRITERIA,
    EXTRA,
    MAIN_BODY,
    MARKER,
    N_CANDIDATES,
    SELECT_BODY,
    SUMMARY_BODY,
    TEST_BODY,
    TRAIN_BODY,
)

WS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
TOKENS = (
    "'','#N/A','#N/A N/A','#NA','-1.#IND','-1.#QNAN','-NaN','-nan','1.#IND','1.#QNAN','<NA>',"
    "'N/A','NA','NULL','NaN','None','n/a','nan','null'"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(body: str, **values: str) -> str:
    """SQL expression of a template with SQL expressions put in."""
    out = lit(body)
    for name, value in values.items():
        out = out.replace("{{" + name + "}}", "' || " + value + " || '")
    return "(" + out + ")"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def hexnum(h: str, start: int, digits: int) -> str:
    return f"('0x' || substr({h}, {start}, {digits}))::BIGINT"


ROSTER = """roster AS (
  SELECT d.doc_id AS pid, CASE WHEN d.doc_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
         l.toxic AS phq, l.quality AS score, d.text AS transcript
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

UTTERANCES = """utt AS (
  SELECT conv_id, turn, text, printf('%04d_%s_Transcript.csv', conv_id, role) AS file_name FROM conversations)"""

CAND = f"""cand AS (
  SELECT pid, k, nullif(substr(transcript, (k - 1) * w + 1, w), '') AS text
  FROM (SELECT pid, transcript, (length(transcript) + {N_CANDIDATES - 1}) // {N_CANDIDATES} AS w FROM roster),
       (SELECT unnest(range(1, {N_CANDIDATES + 1})) AS k))"""

_cell = (
    "CASE WHEN n % 8 = 0 THEN NULL WHEN n % 8 = 1 THEN 'x' WHEN n % 8 = 2 THEN 'No. ' || n ELSE n::VARCHAR END"
)
CELLS = f"""cells AS (
  SELECT pid, i, {_cell} AS cell
  FROM (SELECT pid, i, ('0x' || substr(md5(pid || ':' || transcript), 2 * i - 1, 2))::BIGINT % 33 AS n
        FROM roster, (SELECT unnest(range(1, 6)) AS i)))"""

EXPANDED = f"""expanded AS (
  SELECT p.pid, p.no, c.text FROM (
    SELECT DISTINCT pid, nullif(regexp_extract(cell, '[0-9]+'), '')::BIGINT AS no FROM cells) p
  JOIN cand c ON c.pid = p.pid AND c.k = p.no WHERE c.text IS NOT NULL)"""

SEL = f"{ROSTER}, {CAND}, {CELLS}, {EXPANDED}"

NAMED = """named AS (
  SELECT e.pid, e.no, e.text, e.pid || '_' || e.no AS name, r.gender, r.phq, r.transcript
  FROM expanded e JOIN roster r USING (pid))"""

REUSE = """pool AS (
  SELECT phq AS cls, pid, name, row_number() OVER (PARTITION BY phq ORDER BY md5(pid::VARCHAR), pid, md5(name), name) - 1 AS idx
  FROM named WHERE phq IN (0, 1)),
people AS (SELECT cls, pid, min(idx) AS lo, count(*) AS own FROM pool GROUP BY ALL),
sizes AS (SELECT cls, count(*) AS size FROM pool GROUP BY ALL),
targets AS (
  SELECT n.name, n.pid, c.cls, coalesce(p.lo, 0) AS lo, coalesce(p.own, 0) AS own, coalesce(s.size, 0) - coalesce(p.own, 0) AS others
  FROM named n CROSS JOIN (SELECT unnest([0, 1]) AS cls) c
  LEFT JOIN people p ON p.cls = c.cls AND p.pid = n.pid LEFT JOIN sizes s ON s.cls = c.cls),
draws AS (
  SELECT name, pid, cls, lo, own,
         CASE WHEN others > 0 THEN ('0x' || left(md5('42:' || cls || ':' || name), 15))::BIGINT % others END AS j
  FROM targets),
drawn AS (
  SELECT d.name, d.cls, p.name AS shot
  FROM draws d LEFT JOIN pool p ON p.cls = d.cls AND p.idx = CASE WHEN d.j >= d.lo THEN d.j + d.own ELSE d.j END),
reuse AS (
  SELECT name, coalesce(max(shot) FILTER (cls = 0), '') AS zero_shot_name,
         coalesce(max(shot) FILTER (cls = 1), '') AS one_shot_name FROM drawn GROUP BY name)"""

TESTS = """tests AS (
  SELECT conv_id AS pid, CASE WHEN conv_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
         string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)"""

NO_REUSE = """seeded AS (
  SELECT phq AS cls, name, row_number() OVER (
    PARTITION BY phq ORDER BY md5('20250508:' || phq || ':' || name), name) AS i FROM named WHERE phq IN (0, 1)),
numbered AS (SELECT pid, row_number() OVER (ORDER BY md5(pid::VARCHAR), pid) AS i FROM tests),
norepeat AS (
  SELECT n.pid, z.name AS zero_shot_name, o.name AS one_shot_name FROM numbered n
  JOIN seeded z ON z.cls = 0 AND z.i = n.i JOIN seeded o ON o.cls = 1 AND o.i = n.i)"""

STATUS = "CASE WHEN phq = 1 THEN 'depressed' ELSE 'non-depressed' END"
STATUS_NULL = f"CASE WHEN phq IS NULL THEN 'unknown' ELSE {STATUS} END"
MAIN_PROMPT = fill(
    MAIN_BODY, depression_status=STATUS_NULL, gender="gender", transcript="transcript", criteria=lit(CRITERIA)
)
SUMMARY_PROMPT = fill(SUMMARY_BODY, transcript="transcript")


def sliced(prompt: str, key: str, no: str) -> str:
    """Twin of ``slice_call``."""
    h = f"md5({key} || ':' || {no})"
    return f"substr({prompt}, 1 + ({hexnum(h, 1, 8)} % length({prompt})), 60) || ':' || md5({prompt})"


def counts(label: str, model: str) -> str:
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return ", ".join(f"count(*) FILTER ({label} = {a} AND {model} = {p}) AS {c}" for c, (a, p) in cells.items())


GUESSES = ", ".join(
    f"CASE WHEN (doc_id * {m}) % 7 = 0 THEN 1 - toxic ELSE toxic END AS predict{i}" for i, m in enumerate((1, 3, 5), 1)
)
SCORES = f"""guesses AS (SELECT toxic AS label, {GUESSES} FROM labels),
long AS (UNPIVOT guesses ON predict1, predict2, predict3 INTO NAME model VALUE guess),
n AS (SELECT model, {counts('label', 'guess')} FROM long GROUP BY model),
scores AS (
  SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS sensitivity,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_positive,
         CASE WHEN 2 * tn + fp + fn = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fp + fn) END AS f1_negative
  FROM n)"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


MERGED = f"""cleaned AS (
  SELECT conv_id, file_name, turn, CASE WHEN text IN ({TOKENS}) THEN NULL
         ELSE nullif(regexp_replace({strip('text')}, '{WS}+', ' ', 'g'), '') END AS text FROM utt),
files AS (
  SELECT ltrim(regexp_extract(file_name, '^([0-9]+)_', 1), '0') AS raw, file_name,
         string_agg(text, ' ' ORDER BY turn) AS text FROM cleaned GROUP BY ALL),
merged AS (
  SELECT CASE WHEN raw = '' THEN '0' ELSE raw END AS pid, string_agg(text, ' ' ORDER BY file_name) AS fresh
  FROM files WHERE coalesce(text, '') <> '' GROUP BY ALL)"""

OLD = """old AS (
  SELECT d.doc_id AS pid, CASE WHEN l.doc_id IS NOT NULL THEN d.text END AS old
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

SELECTED = f"""asked AS (
  SELECT r.pid, {fill(SELECT_BODY, prompt=MAIN_PROMPT, candidates='blocks', n="'30'", k="'5'")} AS prompt
  FROM roster r JOIN (
    SELECT pid, string_agg(chr(10) || '--- RATIONALE ' || k || ' ---' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY k) AS blocks
    FROM cand GROUP BY pid) USING (pid)),
hashed AS (SELECT pid, md5(prompt) AS h FROM asked),
picked AS (
  SELECT pid, CASE WHEN left(h, 1) < '8' THEN 5 ELSE 3 END AS n, [{", ".join(hexnum('h', 4 * i + 1, 4) + ' % 33 + 1' for i in range(5))}] AS a
  FROM hashed)"""

RESPONSES = f"""resp AS (
  SELECT pid, CASE shape
    WHEN 0 THEN '[' || a || ', ' || b || ', ' || c || ']' WHEN 1 THEN 'Best: [' || a || ',' || b || '] before 2'
    WHEN 2 THEN a || ' and ' || b || ', then ' || c WHEN 3 THEN '[' || a || ',,' || b || '] or ' || c
    WHEN 4 THEN '[0' || a || ']' ELSE 'none of them' END AS response
  FROM (SELECT doc_id AS pid, doc_id % 6 AS shape, {", ".join(hexnum('md5(text)', 1 + 4 * i, 4) + f' % 30 + 1 AS {c}' for i, c in enumerate('abc'))}
        FROM documents))"""
GAP = r"[ \t\n\r]*"
JSON_LIST = rf"^\[{GAP}((0|[1-9][0-9]*)({GAP},{GAP}(0|[1-9][0-9]*))*)?{GAP}\]$"

DONE = """done AS (
  SELECT doc_id AS pid, k AS no, CASE WHEN quality = 1 THEN 'kept ' || doc_id || ' ' || k ELSE '' END AS text
  FROM labels, (SELECT unnest([1, 2]) AS k))"""

LONG_RESULT = f"""result AS (
  SELECT r.pid, k AS no, CASE WHEN coalesce(d.text, '') <> '' THEN d.text ELSE {sliced('prompt', 'r.pid', 'k')} END AS text
  FROM (SELECT pid, {MAIN_PROMPT} AS prompt FROM roster) r
  CROSS JOIN (SELECT unnest(range(1, 6)) AS k) LEFT JOIN done d ON d.pid = r.pid AND d.no = k)"""

ORACLES: dict[str, str] = {
    "transcript_inner": f"""WITH {ROSTER}, t AS (
  SELECT conv_id::VARCHAR AS pid, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY ALL)
SELECT r.pid::VARCHAR AS participant_id, r.gender, r.phq AS phq_binary, t.transcript
FROM roster r JOIN t ON t.pid = r.pid::VARCHAR""",
    "transcript_update_overwrite": f"""WITH {UTTERANCES}, {MERGED}, {OLD}
SELECT o.pid AS participant_id, coalesce(m.fresh, o.old) AS transcript, m.fresh IS NOT NULL AS updated
FROM old o LEFT JOIN merged m ON m.pid = o.pid::VARCHAR""",
    "transcript_update_fillna": f"""WITH {UTTERANCES}, {MERGED}, {OLD}
SELECT o.pid AS participant_id, coalesce(o.old, m.fresh) AS transcript, m.fresh IS NOT NULL AND o.old IS NULL AS updated
FROM old o LEFT JOIN merged m ON m.pid = o.pid::VARCHAR""",
    "transcript_update_counts": f"""WITH {UTTERANCES}, {MERGED}, {OLD}
SELECT count(*) FILTER (m.fresh IS NOT NULL AND o.old IS NULL) AS rows_updated, count(*) AS rows_total
FROM old o LEFT JOIN merged m ON m.pid = o.pid::VARCHAR""",
    "transcript_unmatched": """SELECT doc_id AS participant_id, length(text) AS n_chars FROM documents
WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""",
    "id_overlap": """SELECT coalesce(a.doc_id, b.doc_id) AS participant_id,
  CASE WHEN b.doc_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT conv_id * 2 AS doc_id FROM conversations) b USING (doc_id)""",
    "normalize_ids": """WITH raw AS (
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' 0' || o_custkey || ' ' WHEN 1 THEN 'P_' || o_custkey
    WHEN 2 THEN o_custkey || '.0' WHEN 3 THEN '-' || o_custkey WHEN 4 THEN 'abc ' WHEN 5 THEN o_custkey || '.5' END AS x,
    printf('%05d_%s_Transcript.csv', o_custkey, o_orderstatus) AS f FROM orders)
SELECT o_orderkey,
  CASE WHEN x IS NULL THEN NULL WHEN regexp_extract(x, '[0-9]+') = '' THEN trim(x)
       WHEN ltrim(regexp_extract(x, '[0-9]+'), '0') = '' THEN '0' ELSE ltrim(regexp_extract(x, '[0-9]+'), '0') END AS normalized,
  CASE WHEN x LIKE '%.5' THEN NULL ELSE try_cast(try_cast(trim(x) AS DOUBLE) AS BIGINT) END AS int_id,
  trim(x) AS text_id, split_part(f, '_', 1) AS file_prefix, regexp_extract(f, '^([0-9]+)_', 1) AS file_digits
FROM raw""",
    "dedupe_keep_first": """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "dedupe_counts": """SELECT count(*) AS rows_before, count(DISTINCT user_id) AS rows_after,
  count(*) - count(DISTINCT user_id) AS rows_removed FROM events""",
    "filter_ids_int": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT s_suppkey FROM supplier)""",
    "filter_ids_str": """SELECT c_custkey, c_name, CASE WHEN length(c_name) >= 24 THEN c_name ELSE lpad(c_name, 24, '0') END AS sort_key
FROM customer WHERE c_name IN (SELECT 'Customer#' || lpad(o_orderkey::VARCHAR, 9, '0') FROM orders)""",
    "distinct_ids": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL",
    "union_by_name": """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
    "label_correction": """SELECT doc_id AS participant_id, quality,
  CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 1 ELSE toxic END AS phq_binary FROM labels""",
    "label_correction_report": """SELECT b.item_id AS id, count(l.doc_id) AS n_rows,
  count(*) FILTER (l.toxic <> 1) AS n_changed, count(l.doc_id) = 0 AS missing
FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id GROUP BY b.item_id""",
    "profile": """SELECT count(*) AS n_rows, 35 AS n_columns, 30 AS n_candidates, min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents""",
    "token_counts": r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]')) AS token_count,
  len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]')) - n_chars // 5 AS token_difference FROM documents""",
    "token_stats": r"""WITH c AS (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]')) AS n, n_chars // 5 AS g FROM documents)
SELECT count(*) AS n_prompts, round(avg(n), 6) AS mean_token_count, max(n) AS max_token_count, min(n) AS min_token_count,
  round(avg(n - g), 6) AS mean_token_difference, max(n - g) AS max_token_difference, min(n - g) AS min_token_difference FROM c""",
    "prompt_render": f"""WITH {ROSTER} SELECT pid AS participant_id, md5({SUMMARY_PROMPT}) AS prompt_md5,
  length({SUMMARY_PROMPT}) AS prompt_chars FROM roster""",
    "prompt_defaults": f"""WITH {ROSTER} SELECT pid AS participant_id, md5({MAIN_PROMPT}) AS prompt_md5,
  length({MAIN_PROMPT}) AS prompt_chars FROM roster""",
    "messages": f"""WITH {ROSTER}, p AS (SELECT pid, {SUMMARY_PROMPT} AS prompt FROM roster)
SELECT pid AS participant_id, 0 AS turn, 'developer' AS role, md5(prompt) AS content FROM p
UNION ALL SELECT pid, 1, 'user', md5('Medical Rationale: ') FROM p""",
    "candidate_long": f"WITH {ROSTER}, {CAND} SELECT pid AS participant_id, k AS candidate_no, text FROM cand",
    "candidate_wide": f"""WITH {ROSTER}, {CAND} SELECT pid AS participant_id,
  {", ".join(f"max(text) FILTER (k = {i}) AS Rational_{i}" for i in range(1, N_CANDIDATES + 1))} FROM cand GROUP BY pid""",
    "generate_resume": f"""WITH {ROSTER}, {DONE}, {LONG_RESULT}
SELECT pid AS participant_id, no AS candidate_no, text FROM result""",
    "generate_pending": f"""WITH {ROSTER}, {DONE}
SELECT r.pid AS participant_id, k AS candidate_no FROM roster r CROSS JOIN (SELECT unnest(range(1, 6)) AS k)
LEFT JOIN done d ON d.pid = r.pid AND d.no = k WHERE coalesce(d.text, '') = ''""",
    "pending_cells": f"WITH {DONE} SELECT pid AS participant_id, no AS candidate_no FROM done WHERE coalesce(text, '') = ''",
    "generate_progress": f"""WITH {ROSTER}, {DONE}
SELECT (SELECT count(*) FROM roster) * 5 AS n_expected, count(*) AS n_present,
  (SELECT count(*) FROM roster) * 5 - count(*) AS n_pending, count(DISTINCT pid) AS n_keys_started FROM done WHERE text <> ''""",
    "generate_range_merge": f"""WITH {ROSTER}, p AS (SELECT pid, {SUMMARY_PROMPT} AS prompt FROM roster
  WHERE pid BETWEEN 302 AND 1000000000)
SELECT r.pid AS participant_id, md5(p.prompt) AS prompt_md5, {", ".join(f"{sliced('p.prompt', 'p.pid', str(i))} AS Rational_{i}" for i in (1, 2, 3))}
FROM roster r LEFT JOIN p USING (pid)""",
    "selection_prompt": f"""WITH {ROSTER}, {CAND}, {SELECTED}
SELECT pid AS participant_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM asked""",
    "selection_job": f"""WITH {ROSTER}, {CAND}, {SELECTED}
SELECT pid AS participant_id, {", ".join(f"CASE WHEN n >= {i} AND a[{i}] <= 30 THEN a[{i}] * 2 END AS Selected_Rational_Number_{i}" for i in range(1, 6))}
FROM picked""",
    "selection_parse": f"""WITH {RESPONSES}, s AS (
  SELECT pid, regexp_extract(response, '\\[[0-9,\\s]+\\]') AS b, response FROM resp),
r AS (SELECT pid, regexp_extract_all(CASE WHEN regexp_matches(b, '{JSON_LIST}') THEN b ELSE response END, '[0-9]+') AS x FROM s)
SELECT pid AS participant_id, len(x) AS n_picks, {", ".join(f"x[{i}]::BIGINT AS Selected_Rational_Number_{i}" for i in range(1, 6))} FROM r""",
    "selection_expand": f"""WITH {SEL} SELECT pid AS participant_id, r.gender, r.phq AS phq_binary, r.score AS phq_score,
  e.no AS selected_rationale_number, e.text AS selected_rationale, md5(r.transcript) AS transcript_md5
FROM expanded e JOIN roster r USING (pid)""",
    "selection_expand_defaults": f"""WITH {SEL}, whole AS (
  SELECT pid, CASE WHEN regexp_matches(cell, '^[0-9]+$') THEN cell::BIGINT END AS no FROM cells),
empty AS (SELECT pid FROM whole GROUP BY pid HAVING count(no) = 0),
p AS (SELECT DISTINCT pid, no FROM whole WHERE no IS NOT NULL
  UNION SELECT pid, unnest([quality + 1, toxic + 5, pid % 30 + 1]) FROM empty JOIN labels ON doc_id = pid)
SELECT p.pid AS participant_id, p.no AS number, c.text FROM p JOIN cand c ON c.pid = p.pid AND c.k = p.no WHERE c.text IS NOT NULL""",
    "selection_drops": f"""WITH {SEL}, p AS (SELECT DISTINCT pid, nullif(regexp_extract(cell, '[0-9]+'), '')::BIGINT AS no FROM cells)
SELECT count(no) AS n_picks, count(no) - (SELECT count(*) FROM expanded) AS n_dropped FROM p""",
    "rationale_clean": f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '**Diagnosis:** depressed'
  WHEN 1 THEN '**' || text || '** DIAGNOSIS: x' || chr(10) WHEN 2 THEN text || chr(10) || 'Diagnosis: d' || chr(10) || 'more'
  ELSE chr(160) || text || ' ' END AS text FROM documents),
c AS (SELECT doc_id, {strip("regexp_replace(replace(text, '**', ''), '(?i)Diagnosis:[^\\n]*\\n?$', '')")} AS text FROM t)
SELECT doc_id, md5(text) AS cleaned_md5, length(text) AS cleaned_chars FROM c""",
    "shots_with_reuse": f"WITH {SEL}, {NAMED}, {REUSE} SELECT name, pid AS participant_id, zero_shot_name, one_shot_name FROM reuse JOIN named USING (name)",
    "shots_no_reuse": f"WITH {SEL}, {NAMED}, {TESTS}, {NO_REUSE} SELECT pid AS participant_id, zero_shot_name, one_shot_name FROM norepeat",
    "fewshot_train_prompt": f"""WITH {SEL}, {NAMED}, {REUSE}, p AS (
  SELECT n.name, n.zero_shot_name, n.one_shot_name, {strip(fill(TRAIN_BODY, status="CASE WHEN n.phq = 1 THEN 'depressed' ELSE 'non-depressed' END", zero_gender='z.gender', zero_transcript='z.transcript', zero_text='z.text', one_gender='o.gender', one_transcript='o.transcript', one_text='o.text', gender='n.gender', transcript='n.transcript'))} AS prompt
  FROM (SELECT * FROM named JOIN reuse USING (name)) n JOIN named z ON z.name = n.zero_shot_name JOIN named o ON o.name = n.one_shot_name)
SELECT name, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p""",
    "fewshot_test_prompt": f"""WITH {SEL}, {NAMED}, {TESTS}, {NO_REUSE}, p AS (
  SELECT t.pid, {fill(TEST_BODY, zero_gender='coalesce(z.gender, t.gender)', zero_transcript='coalesce(z.transcript, t.transcript)', zero_text="coalesce(z.text, '')", one_gender='coalesce(o.gender, t.gender)', one_transcript='coalesce(o.transcript, t.transcript)', one_text="coalesce(o.text, '')", gender='t.gender', transcript='t.transcript')} AS prompt
  FROM tests t JOIN norepeat s ON s.pid = t.pid
  LEFT JOIN named z ON z.name = CASE WHEN t.pid % 3 = 0 THEN NULL ELSE s.zero_shot_name END
  LEFT JOIN named o ON o.name = CASE WHEN t.pid % 3 = 1 THEN 'nobody' ELSE s.one_shot_name END)
SELECT pid AS participant_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p""",
    "prompt_inject_preview": f"""WITH p AS (SELECT doc_id, {lit(MARKER)} || text || {lit(MARKER)} AS x FROM documents),
i AS (SELECT doc_id, {lit(MARKER)} || chr(10) || {lit(EXTRA)} || substr(x, {len(MARKER) + 1}) AS x FROM p)
SELECT doc_id, md5(x) AS injected_md5,
  CASE WHEN length(x) <= 1000 THEN x ELSE left(x, 500) || chr(10) || '...[중략]...' || chr(10) || right(x, 10000) END AS preview,
  CASE WHEN length(x) > 3000 THEN left(x, 3000) || '... (총 ' || length(x) || ' 자)' ELSE x END AS summary FROM i""",
    "repeats_wide": f"""WITH {ROSTER}, d AS (SELECT pid, {MAIN_PROMPT} || {lit(MARKER)} AS x FROM roster),
f AS (SELECT pid, x || chr(10) || {lit(EXTRA)} AS x FROM d),
u AS (SELECT doc_id AS pid, quality AS note FROM labels UNION ALL SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id),
once AS (SELECT pid FROM u GROUP BY pid HAVING count(*) = 1),
g AS (SELECT f.pid, f.x, {", ".join(f"{sliced('f.x', 'f.pid', str(i))} AS r{i}" for i in (1, 2, 3))} FROM f JOIN once USING (pid))
SELECT u.pid AS participant_id, note, {", ".join(f"r{i} AS Generated_rationale_{i}, len(regexp_extract_all(r{i}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]')) AS Generated_token_{i}" for i in (1, 2, 3))},
  md5(CASE WHEN length(x) <= 1000 THEN x ELSE left(x, 500) || chr(10) || '...[중략]...' || chr(10) || right(x, 10000) END) AS preview_md5
FROM u LEFT JOIN g USING (pid)""",
    "head_preview": """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text
FROM documents ORDER BY doc_id LIMIT 5""",
    "metrics_depression": f"WITH {SCORES} SELECT model, tp, fp, fn, tn, round((f1_positive + f1_negative) / 2, 6) AS mean_f1 FROM scores",
    "metrics_accuracy": f"WITH {SCORES} SELECT model, tp, fp, fn, tn, {rounded('accuracy')}, round((f1_positive + f1_negative) / 2, 6) AS mean_f1 FROM scores",
    "metrics_full": f"WITH {SCORES} SELECT model, tp, fp, fn, tn, {rounded('accuracy', 'sensitivity', 'specificity', 'f1_positive', 'f1_negative')}, round((f1_positive + f1_negative) / 2, 6) AS mean_f1 FROM scores",
    "confusion_rows": f"""WITH {SCORES} SELECT model, actual, predicted, n FROM (
  SELECT model, unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp]) AS n FROM scores)""",
    "select_expand_clean": f"""WITH {ROSTER}, {CAND}, {SELECTED}, p AS (
  SELECT DISTINCT pid, no FROM (SELECT pid, unnest(a[1:n]) AS no FROM picked) WHERE no <= 30),
e AS (SELECT p.pid, p.no, c.text FROM p JOIN cand c ON c.pid = p.pid AND c.k = p.no WHERE c.text IS NOT NULL)
SELECT pid AS participant_id, no AS selected_rationale_number,
  {strip("regexp_replace(replace(text, '**', ''), '(?i)Diagnosis:[^\\n]*\\n?$', '')")} AS modified_rationale FROM e""",
}


def half_down(key: str) -> str:
    """Attempts of a request that the model answers at once or, on its bad day, at the second time."""
    return f"CASE WHEN ('0x' || left(md5({key} || ':' || k), 4))::INT % 2 = 1 THEN 2 ELSE 1 END"


ORACLES |= {
    "utterance_scan": "SELECT md5(text) AS text_md5, count(*) AS n FROM conversations GROUP BY ALL",
    "text_table_flow": f"""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS label FROM labels)
SELECT doc_id + {2**53 + 1} AS participant_id, label::BIGINT AS label,
  CASE WHEN label IS NULL THEN 'unknown' WHEN label = 1 THEN 'depressed' ELSE 'non-depressed' END || ' ' || doc_id AS prompt,
  CASE WHEN label = 1 THEN 1 END AS in_pool FROM l""",
    "generate_store": f"""WITH {ROSTER}, p AS (SELECT pid, {MAIN_PROMPT} AS prompt FROM roster)
SELECT pid AS participant_id, k AS candidate_no, {sliced('prompt', 'pid', 'k')} AS text, {half_down('pid')} AS attempts
FROM p, (SELECT unnest([1, 2]) AS k)""",
    "selection_store": ORACLES["selection_job"],
    "retry_attempts": """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'answer ' || doc_id END AS text,
  CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS status, least(doc_id % 4 + 1, 3) AS attempts FROM documents""",
    "formats_roundtrip": """SELECT doc_id, md5(text) AS text_md5, source, unnest(['csv', 'parquet']) AS format FROM documents""",
    "versioned_roundtrip": """SELECT doc_id, length(text) AS n, unnest(['r2', 'main']) AS version FROM documents WHERE doc_id >= 0
UNION ALL SELECT doc_id, length(text), 'r1' FROM documents WHERE doc_id % 2 = 0""",
    "prompt_files": f"""WITH {TESTS} SELECT 'c ' || pid || '+%' AS key, md5(transcript || chr(10)) AS prompt_md5,
  length(transcript) + 1 AS prompt_chars FROM tests""",
    "prompt_stream": f"""WITH {TESTS}, p AS (SELECT 'c ' || pid || '+%' AS key, transcript || chr(10) AS prompt FROM tests)
SELECT key, k AS candidate_no, {sliced('prompt', 'key', 'k')} AS text FROM p, (SELECT unnest([1, 2]) AS k)""",
    "stream_resume": f"""WITH {TESTS}, p AS (SELECT 'c ' || pid || '+%' AS key, transcript || chr(10) AS prompt FROM tests)
SELECT key, k AS candidate_no, {sliced('prompt', 'key', 'k')} AS text, {half_down('key')} AS attempts, 'ok' AS state
FROM p, (SELECT unnest([1, 2]) AS k)""",
    "retry_ledger": """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'run ' || doc_id % 5 + 1 END AS text,
  least(doc_id % 5 + 1, 3)::BIGINT AS attempts, CASE WHEN doc_id % 5 < 3 THEN 'ok' ELSE 'dead' END AS state,
  CASE WHEN doc_id % 5 > 0 THEN 'run ' || least(doc_id % 5, 3) END AS error FROM documents""",
    "dedupe_file": """WITH f AS (SELECT conv_id, min(turn) AS turn, arg_min(role || chr(10) || text, turn) AS said FROM conversations GROUP BY conv_id)
SELECT conv_id AS participant_id, turn, md5(said) AS said_md5, row_number() OVER (ORDER BY turn, conv_id) - 1 AS row_no FROM f""",
    "filter_file": """SELECT conv_id AS participant_id, turn, md5(role || chr(10) || text) AS said_md5,
  row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_no FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)""",
    "transcript_files": """WITH t AS (SELECT conv_id, string_agg(role || chr(10) || text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, doc_id AS participant_id, toxic::VARCHAR AS phq_binary, md5(t) AS transcript_md5
FROM labels JOIN t ON conv_id = doc_id""",
    "roster_ledger": f"""WITH t AS (SELECT conv_id, string_agg(nullif({strip(squeeze("role || chr(10) || text"))}, ''), ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT doc_id AS participant_id, coalesce(conv_id % 3 < 2, false) AS first, coalesce(conv_id % 3 > 0, false) AS second,
  md5(CASE WHEN conv_id IS NULL THEN 'old' WHEN conv_id % 3 = 0 THEN t ELSE t || ' more words' END) AS transcript_md5
FROM documents LEFT JOIN t ON conv_id = doc_id""",
    "sorted_ids": """SELECT o_orderkey::VARCHAR AS id, o_custkey,
  lag(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders""",
    "long_cells": """WITH c AS (SELECT doc_id,
  CASE WHEN length(text) > 3000 THEN left(text, 3000) || '... (총 ' || length(text) || ' 자)' ELSE text END AS s FROM documents)
SELECT doc_id, md5(s) AS summary_md5, length(s) AS summary_chars, false AS has_source FROM c""",
    "training_flow": ORACLES["fewshot_train_prompt"].replace(
        "SELECT name, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p",
        f"SELECT name, md5(prompt) AS prompt_md5, {sliced('prompt', 'name', '1')} AS answer FROM p",
    ),
    "evaluation_flow": f"""WITH {SEL}, {NAMED}, {TESTS}, {NO_REUSE}, p AS (
  SELECT t.pid, {fill(TEST_BODY + MARKER, zero_gender='z.gender', zero_transcript='z.transcript', zero_text='z.text', one_gender='o.gender', one_transcript='o.transcript', one_text='o.text', gender='t.gender', transcript='t.transcript')} AS prompt FROM tests t JOIN norepeat s ON s.pid = t.pid
  JOIN named z ON z.name = s.zero_shot_name JOIN named o ON o.name = s.one_shot_name),
i AS (SELECT pid, left(prompt, strpos(prompt, {lit(MARKER)}) + {len(MARKER) - 1}) || chr(10) || {lit(EXTRA)} ||
  substr(prompt, strpos(prompt, {lit(MARKER)}) + {len(MARKER)}) AS prompt FROM p)
SELECT pid AS participant_id, {", ".join(f"{sliced('prompt', 'pid', str(i))} AS Generated_rationale_{i}" for i in (1, 2))} FROM i""",
}
