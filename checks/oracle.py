"""SQL counterparts of the queries, written for DuckDB from the operator definitions.

They rank whole strata with window functions and build the expected boxed answers
from the data itself, so they share no method with the Spark side.
"""

from __future__ import annotations

from larkspool.fixed_values import MATH_SYSTEM_PROMPT, PSYCHOLOGY_SYSTEM_PROMPT


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _draw(purpose: str, row: str) -> str:
    return f"md5('42:{purpose}:' || {row})"


# --- derived inputs -------------------------------------------------------------

RAW = r"""
marked AS (
  SELECT doc_id, lang, source, n_chars, string_split(text, chr(10)) AS lines,
    CASE WHEN source = 'src3' THEN ''
      WHEN lang = 'en' THEN '\boxed{' || n_chars || '}'
      WHEN lang = 'es' THEN '\boxed{\frac{1}{' || n_chars || '}}'
      WHEN lang = 'fr' THEN 'x \boxed{ ' || n_chars || ' } and \boxed{'
      ELSE '\boxed{0} or \boxed{' || n_chars || '}' END AS box,
    CASE WHEN source = 'src3' THEN ''
      WHEN lang = 'es' THEN '\frac{1}{' || n_chars || '}'
      ELSE CAST(n_chars AS VARCHAR) END AS made
  FROM documents),
raw AS (
  SELECT doc_id AS row_id, lang, made,
    CASE WHEN lang <> 'fr' THEN lines[1] END AS problem,
    CASE WHEN len(lines) = 1 THEN '' ELSE array_to_string(lines[2:], chr(10)) || chr(10) || box END AS solution,
    CASE WHEN lang IN ('fr', 'de') THEN list_concat(
      list_transform(lines, lambda x, i: {'role': CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, 'content': x}),
      [{'role': 'assistant', 'content': 'so ' || box}, {'role': 'assistant', 'content': ''}]) END AS messages,
    CASE WHEN source = 'src2' THEN lines[1] END AS told_question,
    CASE WHEN source = 'src2' THEN 'told ' || box END AS told_answer,
    CASE WHEN source = 'src7' THEN 'GSM8K/' || lang WHEN source = 'src11' THEN NULL ELSE source END AS source
  FROM marked),
said AS (
  SELECT *, coalesce(problem, '') AS p, coalesce(solution, '') AS s,
    list_filter(messages, lambda m: m.role = 'user' AND m.content <> '')[1].content AS first_user,
    list_filter(messages, lambda m: m.role = 'assistant' AND m.content <> '')[-1].content AS last_assistant
  FROM raw),
fill AS (
  SELECT *, CASE WHEN p = '' OR s = '' THEN CASE WHEN p = '' THEN coalesce(first_user, '') ELSE p END ELSE p END AS question,
    CASE WHEN p = '' OR s = '' THEN coalesce(last_assistant, s) ELSE s END AS answer
  FROM said),
prefer AS (
  SELECT *, CASE WHEN p = '' THEN coalesce(first_user, '') ELSE p END AS question,
    coalesce(last_assistant, s) AS answer
  FROM said),
fallback AS (
  SELECT row_id, source, made,
    CASE WHEN (question = '' OR answer = '') AND told_question IS NOT NULL THEN told_question ELSE question END AS question,
    CASE WHEN (question = '' OR answer = '') AND told_answer IS NOT NULL THEN told_answer ELSE answer END AS answer
  FROM prefer)"""

CURATED = """
curated AS (
  SELECT row_id, question AS instruction, answer AS output, made AS final_answer, coalesce(source, 'None') AS source
  FROM fallback WHERE question <> '' AND answer <> '' AND made <> '')"""

DEDUP = r"""
pairs AS (
  SELECT row_id, source, question, answer, regexp_replace(lower(question), '\s+', '', 'g') AS nq,
    regexp_replace(lower(answer), '\s+', '', 'g') AS na
  FROM fill WHERE coalesce(lower(source), '') NOT LIKE '%gsm8k%'),
usable AS (SELECT * FROM pairs WHERE nq <> '' AND na <> ''),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nq ORDER BY row_id) AS k FROM usable) WHERE k = 1),
uniq AS (
  SELECT * FROM (SELECT * EXCLUDE k, row_number() OVER (PARTITION BY na ORDER BY row_id) AS k FROM once) WHERE k = 1)"""

# Proportional sample of `n` rows from `pool` (row_id, source).
SAMPLE = f"""
shares AS (
  SELECT source, count(*) AS cnt, (SELECT count(*) FROM pool) AS total FROM pool WHERE source IS NOT NULL GROUP BY source),
quotas AS (
  SELECT source, least(CAST(floor(CAST(cnt AS DOUBLE) / total * (SELECT n FROM wanted)) AS BIGINT), cnt) AS quota FROM shares),
ranked AS (
  SELECT pool.*, coalesce(row_number() OVER (PARTITION BY pool.source ORDER BY {_draw('strata', 'row_id')}, row_id) <= quota, false)
    AND pool.source IS NOT NULL AS by_source
  FROM pool LEFT JOIN quotas ON pool.source = quotas.source),
filled AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN by_source THEN 0 ELSE 1 END, {_draw('topup', 'row_id')}, row_id) AS place
  FROM ranked),
sampled AS (SELECT * FROM filled WHERE place <= (SELECT n FROM wanted))"""


def _ordered(table: str, row: str, label: str) -> str:
    """Stratified batch order of ``table`` by ``label``, with batches of 32 rows, as CTEs ending in ``ordered``."""
    return f"""
sized AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 32.0) AS BIGINT)) AS nb FROM {table}),
dealt AS (
  SELECT {row}, {label}, row_number() OVER (ORDER BY {label}, {_draw('order', row)}, {row}) - 1 AS r FROM {table}),
slotted AS (SELECT {row}, {label}, r, r % nb AS slot FROM dealt, sized),
slots AS (
  SELECT slot, count(*) AS rows_in FROM slotted GROUP BY slot),
starts AS (
  SELECT slot, coalesce(sum(rows_in) OVER (ORDER BY {_draw('batch', 'slot')}, slot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM slots),
ordered AS (
  SELECT {row}, {label}, CAST(start_at + row_number() OVER (PARTITION BY slotted.slot ORDER BY r) - 1 AS BIGINT) AS pos
  FROM slotted JOIN starts ON slotted.slot = starts.slot),
splitted AS (
  SELECT ordered.*, CASE WHEN pos < CAST(floor(total * CAST(0.90 AS DOUBLE)) AS BIGINT) THEN 'train'
    WHEN pos < CAST(floor(total * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN 'eval' ELSE 'test' END AS split
  FROM ordered, sized)"""


def _capped(row: str, label: str, cap: str) -> str:
    """Capped splits, from ``splitted`` to ``capped``."""
    return f"""
lengths AS (SELECT split, count(*) AS len, min(pos) AS first_pos FROM splitted GROUP BY split),
big AS (
  SELECT splitted.*, len FROM splitted JOIN lengths ON splitted.split = lengths.split
  WHERE splitted.split IN ('eval', 'test') AND len > {cap}),
label_quota AS (
  SELECT split AS qs, {label} AS ql,
    least(CAST(round_even(CAST(count(*) AS DOUBLE) / max(len) * {cap}, 0) AS BIGINT), count(*)) AS quota
  FROM big GROUP BY split, {label}),
chosen AS (
  SELECT big.*, row_number() OVER (PARTITION BY split, {label} ORDER BY {_draw('cap', row)}, {row}) <= quota AS first_pick
  FROM big JOIN label_quota ON split = qs AND {label} = ql),
repaired AS (
  SELECT *, row_number() OVER (PARTITION BY split
    ORDER BY CASE WHEN first_pick THEN 0 ELSE 1 END, {_draw('repair', row)}, {row}) AS place FROM chosen),
capped AS (
  SELECT {row}, {label}, split, row_number() OVER (PARTITION BY split ORDER BY {_draw('mix', row)}, {row}) - 1 AS pos
  FROM repaired WHERE place <= {cap}
  UNION ALL
  SELECT {row}, {label}, splitted.split, pos - first_pos FROM splitted JOIN lengths ON splitted.split = lengths.split
  WHERE NOT (splitted.split IN ('eval', 'test') AND len > {cap}))"""


CURATION = ",\n".join(
    [
        RAW,
        CURATED,
        DEDUP,
        "wanted AS (SELECT count(*) // 2 AS n, greatest(1, count(*) // 2 // 40) AS cap FROM documents)",
        "pool AS (SELECT row_id, source FROM uniq)",
        SAMPLE,
        "kept AS (SELECT curated.row_id, curated.source AS label FROM curated JOIN sampled ON curated.row_id = sampled.row_id)",
        _ordered("kept", "row_id", "label"),
        _capped("row_id", "label", "(SELECT cap FROM wanted)"),
    ]
)

TARGETS = """
targets AS (
  SELECT o_orderkey AS item_id, 'Order ' || o_orderkey || ', ' || o_orderpriority AS instruction,
    CASE WHEN rare AND o_orderpriority = '2-HIGH' THEN n || repeat('0', 20) || '/1' || repeat('0', 20)
      WHEN rare AND o_orderpriority = '3-MEDIUM' THEN n || '0e-1'
      WHEN rare AND o_orderpriority = '4-NOT SPECIFIED' THEN 'x*' || n || '+1'
      WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 50 + 1 AS VARCHAR)
      WHEN o_orderstatus = 'O' THEN (o_custkey % 50 + 1) * 2 || '/2'
      WHEN o_orderpriority <> '5-LOW' THEN '$' || (o_custkey % 50 + 1) || '.' END AS final_answer,
    CASE WHEN rare AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderstatus IN ('F', 'O') THEN n END AS meant_n,
    CASE WHEN rare AND o_orderpriority = '4-NOT SPECIFIED' THEN n END AS meant_x
  FROM (SELECT *, o_custkey % 50 + 1 AS n, o_orderstatus = 'F' AND o_custkey % 10 = 0 AS rare FROM orders))"""

ANSWER = r"""
spoken AS (
  SELECT *, CASE WHEN l_discount = 0.05 THEN 'x = ' || CAST(l_quantity AS BIGINT) || ' cm'
      WHEN l_discount = 0.09 AND l_linenumber = 3 THEN '1 + ' || CAST(l_quantity AS BIGINT) || ' * x'
      WHEN l_discount = 0.08 AND l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) || '.' || repeat('0', 25)
      WHEN l_discount = 0.1 THEN CAST(l_quantity AS BIGINT) || '/1'
      WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
      ELSE CAST(l_quantity AS VARCHAR) END AS answer
  FROM lineitem),
predictions AS (
  SELECT l_orderkey AS item_id, l_returnflag AS model, l_partkey, l_linenumber,
    CASE WHEN l_discount = 0.0 THEN 'I think it is ' || answer ELSE 'First \boxed{0}, then \boxed{ ' || answer || ' }.' END AS generation,
    CASE WHEN l_discount = 0.0 THEN '' ELSE answer END AS said,
    CASE WHEN l_discount NOT IN (0.0, 0.05) AND NOT (l_discount = 0.09 AND l_linenumber = 3) THEN CAST(l_quantity AS BIGINT) END AS said_n,
    CASE WHEN l_discount = 0.09 AND l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) END AS said_x
  FROM spoken)"""


def _clean(text: str) -> str:
    return f"rtrim(translate(lower({text}), ' $,', ''), '.')"


# What a number or an expression stands for follows from how the inputs are made.
PAIRS = rf"""
pairs AS (
  SELECT predictions.*, instruction, final_answer, {_clean('said')} AS cs, {_clean('final_answer')} AS cm,
    coalesce(said_n = meant_n, false) AS numeric_same, coalesce(said_x = meant_x, false) AS symbolic_same,
    coalesce(regexp_matches({_clean('said')}, '(^|[^0-9])' || regexp_escape({_clean('final_answer')}) || '([^0-9]|$)'), false) AS inside
  FROM predictions JOIN targets ON predictions.item_id = targets.item_id),
graded AS (
  SELECT *, CASE WHEN coalesce(said, '') = '' OR coalesce(final_answer, '') = '' THEN 'none'
    WHEN cs = cm THEN 'exact' WHEN numeric_same THEN 'numeric' WHEN inside THEN 'contains' WHEN symbolic_same THEN 'symbolic' ELSE 'none' END AS match_kind
  FROM pairs)"""

SCORES = """
scored AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'Baseline' WHEN 'O' THEN 'Finetuned' ELSE 'Third run' END AS experiment,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Reasoning' WHEN '2-HIGH' THEN 'HellaSwag' WHEN '3-MEDIUM' THEN 'MMLU'
      WHEN '4-NOT SPECIFIED' THEN 'GSM8K' ELSE 'Other' END AS benchmark,
    CAST(count(*) FILTER (o_totalprice > 250000) AS DOUBLE) / count(*) * 100.0 AS score
  FROM orders GROUP BY ALL),
scores AS (SELECT * FROM scored WHERE NOT (experiment = 'Third run' AND benchmark IN ('Reasoning', 'GSM8K'))),
wide AS (
  SELECT benchmark, max(score) FILTER (experiment = 'Baseline') AS "Baseline",
    max(score) FILTER (experiment = 'Finetuned') AS "Finetuned", max(score) FILTER (experiment = 'Third run') AS "Third run",
    CASE benchmark WHEN 'Reasoning' THEN 1 WHEN 'HellaSwag' THEN 2 WHEN 'MMLU' THEN 3 ELSE 4 END AS number,
    CASE benchmark WHEN 'Reasoning' THEN 'Reasoning Acc (%)' ELSE benchmark || ' (%)' END AS heading
  FROM scores WHERE benchmark <> 'Other' GROUP BY benchmark)"""


def _cell(score: str, width: int, form: str = "%.2f") -> str:
    return f"rpad(coalesce(printf('{form}', {score}), 'N/A'), {width}, ' ')"


_BY_BENCHMARK = _with(
    SCORES,
    select=f"""
SELECT CAST(0 AS BIGINT) AS line_no, '# Results' AS line
UNION ALL SELECT 1, ''
UNION ALL SELECT 2, '| ' || rpad('Benchmark', 20, ' ') || ' | ' || rpad('Baseline', 15, ' ') || ' | '
  || rpad('Finetuned', 15, ' ') || ' | ' || rpad('Third run', 15, ' ') || ' |'
UNION ALL SELECT 3, '|' || repeat('-', 20) || '|' || repeat('-', 15) || '|' || repeat('-', 15) || '|' || repeat('-', 15) || '|'
UNION ALL SELECT 3 + number, '| ' || rpad(heading, 20, ' ') || ' | ' || {_cell('"Baseline"', 15)} || ' | '
  || {_cell('"Finetuned"', 15)} || ' | ' || {_cell('"Third run"', 15)} || ' |' FROM wide""",
)

RESULTS = """
results AS (
  SELECT CAST(p_partkey AS VARCHAR) AS model, p_size AS size, p_retailprice / 10000.0 AS v,
    CASE p_type WHEN 'ECONOMY' THEN 'hellaswag' WHEN 'SMALL' THEN 'mmlu' WHEN 'LARGE' THEN 'gsm8k' END AS task
  FROM part),
picked AS (
  SELECT model, task, 100.0 * CASE
    WHEN size < 10 THEN CASE task WHEN 'mmlu' THEN v ELSE 0.0 END
    WHEN size < 20 THEN CASE task WHEN 'hellaswag' THEN v ELSE v / 2 END
    WHEN size < 30 THEN CASE task WHEN 'gsm8k' THEN v ELSE 0.0 END
    WHEN size < 40 THEN CASE task WHEN 'hellaswag' THEN v WHEN 'mmlu' THEN v / 8 ELSE v / 4 END
    ELSE 0.0 END AS score
  FROM results WHERE task IS NOT NULL)"""

_POOL = "pool AS (SELECT row_id, source FROM raw)"
_QUARTER = "wanted AS (SELECT count(*) // 4 AS n FROM pool)"
_ORDERS = _ordered("orders", "o_orderkey", "o_orderpriority")
_TOKENS = "tokens AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM documents)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


_CHAT = " || ".join(
    [
        _turn("system", _literal(MATH_SYSTEM_PROMPT)),
        _turn("user", "string_split(text, chr(10))[1]"),
        _turn("assistant", "text"),
    ]
)
_PROMPT = " || ".join(
    [
        _turn("system", _literal(PSYCHOLOGY_SYSTEM_PROMPT)),
        _turn("user", "text"),
        "'<|im_start|>assistant' || chr(10)",
    ]
)

ORACLE = {
    "source_filter": _with(
        RAW, select="SELECT row_id, source FROM raw WHERE NOT coalesce(contains(lower(source), 'gsm8k'), false)"
    ),
    "qa_fill": _with(RAW, select="SELECT row_id, question, answer FROM fill"),
    "qa_prefer_messages": _with(RAW, select="SELECT row_id, question, answer FROM prefer"),
    "qa_from_turns": """
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user' AND text <> ''), '') AS question,
  coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''), '') AS answer
FROM conversations GROUP BY conv_id""",
    "conversation_fallback": _with(RAW, select="SELECT row_id, question, answer FROM fallback"),
    "missing_columns": """
SELECT doc_id AS step, text, CAST(NULL AS VARCHAR) AS run, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS eval_accuracy
FROM documents""",
    "normalized_text": r"SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS normalized FROM documents",
    "non_empty_pairs": _with(
        RAW, select="SELECT row_id FROM fill WHERE trim(question, ' ' || chr(10)) <> '' AND trim(answer, ' ' || chr(10)) <> ''"
    ),
    "dedup_question": _with(
        RAW,
        select=r"""
SELECT row_id, question FROM (
  SELECT row_id, question,
    row_number() OVER (PARTITION BY regexp_replace(lower(question), '\s+', '', 'g') ORDER BY row_id) AS k
  FROM fill WHERE question <> '') WHERE k = 1""",
    ),
    "dedup_question_answer": _with(
        RAW,
        DEDUP.replace("WHERE coalesce(lower(source), '') NOT LIKE '%gsm8k%'", ""),
        select="SELECT row_id, question, answer FROM uniq",
    ),
    "dedup_documents": r"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY regexp_replace(lower(text), '\s+', '', 'g') ORDER BY doc_id) AS k
  FROM documents) WHERE k = 1""",
    "boxed_answers": _with(
        RAW,
        select="""
SELECT row_id, CASE WHEN messages IS NULL AND s = '' THEN '' ELSE made END AS final_answer FROM prefer""",
    ),
    "curated_rows": _with(RAW, CURATED, select="SELECT * FROM curated"),
    "curated_without_source": _with(
        RAW, CURATED, select="SELECT row_id, instruction, output, final_answer, 'unknown' AS source FROM curated"
    ),
    "curated_splits": "WITH "
    + CURATION
    + """
SELECT curated.*, split, CAST(pos AS BIGINT) AS pos FROM curated JOIN capped ON curated.row_id = capped.row_id""",
    "curated_from_table": "WITH "
    + CURATION.replace("count(*) // 2 AS n, greatest(1, count(*) // 2 // 40)", "count(*) // 4 AS n, greatest(1, count(*) // 4 // 40)")
    + """
SELECT curated.*, split, CAST(pos AS BIGINT) AS pos FROM curated JOIN capped ON curated.row_id = capped.row_id""",
    "stage_audit": "WITH "
    + CURATION
    + """,
counts AS (
  SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM pairs) AS b, (SELECT count(*) FROM usable) AS c,
    (SELECT count(*) FROM uniq) AS d, (SELECT count(*) FROM sampled) AS e, (SELECT count(*) FROM kept) AS f)
SELECT 'source_filter' AS stage, a AS rows_in, b AS rows_out FROM counts
UNION ALL SELECT 'non_empty', b, c FROM counts
UNION ALL SELECT 'dedup', c, d FROM counts
UNION ALL SELECT 'sample', d, e FROM counts
UNION ALL SELECT 'boxed_answer', e, f FROM counts
UNION ALL SELECT split, f, (SELECT count(*) FROM capped WHERE capped.split = s.split)
  FROM counts, (VALUES ('train'), ('eval'), ('test')) AS s(split)""",
    "source_distribution": _with(
        RAW,
        select="""
SELECT source, count(*) AS count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM raw) AS share
FROM raw WHERE source IS NOT NULL GROUP BY source""",
    ),
    "source_allocation": _with(RAW, _POOL, _QUARTER, SAMPLE, select="SELECT source, quota FROM quotas"),
    "stratified_sample": _with(RAW, _POOL, _QUARTER, SAMPLE, select="SELECT row_id, source FROM ranked WHERE by_source"),
    "sample_topup": _with(RAW, _POOL, _QUARTER, SAMPLE, select="SELECT row_id, source FROM sampled"),
    "plain_sample": f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_draw('plain', 'doc_id')}, doc_id) AS k FROM documents)
WHERE k <= (SELECT count(*) // 4 FROM documents)""",
    "hash_shuffle": f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_draw('shuffle', 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders""",
    "head_limit": """
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)
WHERE k <= (SELECT count(*) // 4 FROM orders)""",
    "stratified_order": _with(_ORDERS, select="SELECT o_orderkey, o_orderpriority, pos FROM ordered"),
    "split_assign": _with(_ORDERS, select="SELECT o_orderkey, o_orderpriority, pos, split FROM splitted"),
    "split_capped": _with(
        _ORDERS, _capped("o_orderkey", "o_orderpriority", "500"),
        select="SELECT o_orderkey, o_orderpriority, CAST(pos AS BIGINT) AS pos, split FROM capped",
    ),
    "batches": _with(_ORDERS, select="SELECT o_orderkey, pos // 64 AS batch FROM ordered"),
    "chat_text": f"SELECT doc_id, {_CHAT} AS text FROM documents",
    "chat_prompt": f"SELECT doc_id, {_PROMPT} AS prompt FROM documents",
    "completion_mask": _with(
        _TOKENS,
        """
hits AS (
  SELECT doc_id, t, list_filter(range(1, len(t)), lambda j: t[j] = 4 AND t[j + 1] = 3)[1] AS hit FROM tokens)""",
        select="""
SELECT doc_id, CASE WHEN hit IS NULL THEN array_to_string(t, ' ')
  ELSE array_to_string(list_transform(t, lambda v, i: CASE WHEN i <= hit + 1 THEN -100 ELSE v END), ' ') END AS labels
FROM hits""",
    ),
    "completion_text": "SELECT doc_id, text || '<|im_end|>' || chr(10) AS completion FROM documents",
    "truncated_tokens": _with(
        _TOKENS, select="SELECT doc_id, CAST(len(t[:512]) AS INTEGER) AS n, array_to_string(t[:512], ' ') AS tokens FROM tokens"
    ),
    "answer_cleaned": _with(TARGETS, select=f"SELECT item_id, {_clean('final_answer')} AS cleaned FROM targets"),
    "answer_exact": _with(
        TARGETS, ANSWER, PAIRS,
        select="SELECT item_id, model, l_partkey, l_linenumber, said, final_answer AS meant, cs = cm AS same FROM graded",
    ),
    "answer_numeric": _with(
        TARGETS, ANSWER, PAIRS,
        select="SELECT item_id, model, l_partkey, l_linenumber, said, final_answer AS meant, numeric_same AS same FROM graded",
    ),
    "answer_contains": _with(
        TARGETS, ANSWER, PAIRS,
        select="SELECT item_id, model, l_partkey, l_linenumber, said, final_answer AS meant, inside AS same FROM graded",
    ),
    "answer_equivalent": """
WITH made AS (
  SELECT o_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey % 1000 + 1 AS VARCHAR) AS b,
    CAST(o_orderkey + o_orderkey % 2 AS VARCHAR) AS off, CAST(o_orderkey AS VARCHAR) AS k, o_custkey % 7 AS kind FROM orders)
SELECT o_orderkey, o_custkey,
  CASE kind WHEN 0 THEN a || '*x + ' || k WHEN 1 THEN '(x + ' || b || ')*(x - ' || b || ') + ' || k
    WHEN 2 THEN '(x^2 - y^2)/(x - y) - ' || k WHEN 3 THEN '-x/' || b || ' + ' || k || '.50'
    WHEN 4 THEN k || '*y**-1' WHEN 5 THEN k || 'x' ELSE 'f(x) + ' || k END AS said,
  CASE kind WHEN 0 THEN off || '+x*' || a WHEN 1 THEN 'x^2 + ' || off || ' - ' || b || '**2'
    WHEN 2 THEN 'y - ' || off || ' + x' WHEN 3 THEN '(' || off || ' + 1/2) - x/' || b
    WHEN 4 THEN off || '/y' WHEN 5 THEN off || '*x' ELSE off || ' + f(x)' END AS meant,
  kind < 5 AND o_orderkey % 2 = 0 AS same
FROM made""",
    "graded": _with(
        TARGETS, ANSWER, PAIRS,
        select="""
SELECT item_id, model, l_partkey, l_linenumber, said AS predicted_answer, match_kind, match_kind <> 'none' AS is_match
FROM graded""",
    ),
    "graded_detail": _with(
        TARGETS, ANSWER, PAIRS,
        select="""
SELECT item_id, model, instruction AS question, generation AS prediction, said AS predicted_answer,
  final_answer AS target, match_kind <> 'none' AS is_match FROM graded""",
    ),
    "accuracy_by_model": _with(
        TARGETS, ANSWER, PAIRS,
        select="""
SELECT model, CAST(m AS DOUBLE) / (c + t - a) * 100.0 AS accuracy, c + t - a AS n, t - a AS unanswered,
  (SELECT count(*) FROM predictions p WHERE p.model = g.model AND p.item_id NOT IN (SELECT item_id FROM targets)) AS orphans
FROM (SELECT model, count(*) FILTER (match_kind <> 'none') AS m, count(*) AS c, count(DISTINCT item_id) AS a,
  (SELECT count(*) FROM targets) AS t FROM graded GROUP BY model) g""",
    ),
    "metric_choice": _with(RESULTS, select="SELECT model, task, score FROM picked"),
    "evaluated_models": _with(
        TARGETS, ANSWER, PAIRS, RESULTS,
        select="""
SELECT model AS experiment, 'Reasoning' AS benchmark,
  CAST(count(*) FILTER (match_kind <> 'none') AS DOUBLE)
    / (count(*) + (SELECT count(*) FROM targets) - count(DISTINCT item_id)) * 100.0 AS score FROM graded GROUP BY model
UNION ALL
SELECT model, CASE task WHEN 'hellaswag' THEN 'HellaSwag' ELSE upper(task) END, score FROM picked""",
    ),
    "scores_by_experiment": _with(
        SCORES,
        select="""
SELECT experiment, max(score) FILTER (benchmark = 'Reasoning') AS "Reasoning",
  max(score) FILTER (benchmark = 'HellaSwag') AS "HellaSwag", max(score) FILTER (benchmark = 'MMLU') AS "MMLU",
  max(score) FILTER (benchmark = 'GSM8K') AS "GSM8K" FROM scores GROUP BY experiment""",
    ),
    "scores_by_benchmark": _with(
        SCORES, select='SELECT benchmark, "Baseline", "Finetuned", "Third run", CAST(number AS BIGINT) AS number FROM wide'
    ),
    "compare_change": _with(
        SCORES, select='SELECT benchmark, "Baseline", "Finetuned", "Finetuned" - "Baseline" AS change FROM wide'
    ),
    "report_by_experiment": _with(
        SCORES,
        """
flat AS (
  SELECT experiment, max(score) FILTER (benchmark = 'Reasoning') AS a, max(score) FILTER (benchmark = 'HellaSwag') AS b,
    max(score) FILTER (benchmark = 'MMLU') AS c, coalesce(max(score) FILTER (benchmark = 'GSM8K'), 0.0) AS d
  FROM scores GROUP BY experiment)""",
        select=f"""
SELECT CAST(0 AS BIGINT) AS line_no, '# Results' AS line
UNION ALL SELECT 1, ''
UNION ALL SELECT 2, '| Experiment      | Reasoning Acc (%) | HellaSwag (%)   | MMLU (%)   | GSM8K (%)  |'
UNION ALL SELECT 3, '|' || repeat('-', 17) || '|' || repeat('-', 19) || '|' || repeat('-', 17) || '|' || repeat('-', 12) || '|'
  || repeat('-', 12) || '|'
UNION ALL SELECT 3 + row_number() OVER (ORDER BY experiment), '| ' || rpad(experiment, 15, ' ') || ' | ' || {_cell('a', 17)}
  || ' | ' || {_cell('b', 15)} || ' | ' || {_cell('c', 10)} || ' | ' || {_cell('d', 10)} || ' |' FROM flat""",
    ),
    "report_by_benchmark": _BY_BENCHMARK,
    "report_comparison": _with(
        SCORES,
        select=f"""
SELECT CAST(0 AS BIGINT) AS line_no, '# Results' AS line
UNION ALL SELECT 1, ''
UNION ALL SELECT 2, '| ' || rpad('Benchmark', 20, ' ') || ' | ' || rpad('Baseline', 15, ' ') || ' | '
  || rpad('Finetuned', 15, ' ') || ' | Change |'
UNION ALL SELECT 3, '|' || repeat('-', 20) || '|' || repeat('-', 15) || '|' || repeat('-', 15) || '|' || repeat('-', 15) || '|'
UNION ALL SELECT 3 + number, '| ' || rpad(heading, 20, ' ') || ' | ' || {_cell('"Baseline"', 15)} || ' | '
  || {_cell('"Finetuned"', 15)} || ' | ' || {_cell('"Finetuned" - "Baseline"', 15, '%+.2f')} || ' |' FROM wide""",
    ),
    "training_curves": """
SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, 'loss' AS series, value FROM events
WHERE event_type IN ('click', 'view') AND value IS NOT NULL
UNION ALL
SELECT CAST(user_id AS VARCHAR), event_id, 'eval_accuracy', value / 1000.0 * 100.0 FROM events
WHERE event_type IN ('purchase', 'view') AND value IS NOT NULL""",
    "split_files": _with(
        RAW, CURATED,
        select="""
SELECT *, pos // 32 AS batch FROM (
  SELECT instruction, output, final_answer, curated.source, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY row_id) - 1 AS pos
  FROM curated JOIN documents ON row_id = doc_id)""",
    ),
    "training_text": _with(
        RAW, CURATED,
        select=f"""
SELECT lang AS split, row_number() OVER (PARTITION BY lang ORDER BY row_id) - 1 AS pos,
  {_turn("system", _literal(MATH_SYSTEM_PROMPT))} || {_turn("user", "instruction")} || {_turn("assistant", "output")} AS text
FROM curated JOIN documents ON row_id = doc_id""",
    ),
    "ingested_rows": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, text, lang FROM documents",
    "jsonl_scan": _with(
        RAW, select="SELECT row_id, problem, solution, CAST(len(messages) AS INTEGER) AS n_messages, source FROM raw"
    ),
    "table_scan": _with(RAW, select="SELECT row_id, problem, solution FROM raw WHERE messages IS NULL"),
    "result_files": _with(RESULTS, select="SELECT model, task, score FROM picked"),
    "report_file": f"SELECT line FROM ({_BY_BENCHMARK})",
}
