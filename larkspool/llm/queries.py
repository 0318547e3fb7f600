"""One query per operator over the given tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspool.llm import (
    conversations,
    decontamination,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pii_crf,
    suffix_dedup,
    toxicity,
    url_filters,
    vectors,
    warc,
)
from larkspool.llm.common import ensure_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least 10 documents have."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, threshold=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of a quarter of the ids are held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        F.expr(f"int(score >= {toxicity.THRESHOLD})").alias("predicted"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document covered by windows of 10 words of a benchmark item."""
    docs, items = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    marked = decontamination.mark(docs, items, n=10)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: the labelled table's kinds of documents, such as q1t0 for good and not toxic."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain"))


#: Target shares of tokens by kind of document.
TARGETS = {"q1t0": 0.86, "q0t0": 0.12, "q1t1": 0.02, "q0t1": 0.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which all documents give the target shares of tokens, with their domain posteriors."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return mixing.mixed_rates(docs, quality_domains(labels), TARGETS)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to a content-addressed archive and read back."""
    records = warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.9 or more of their 3-word shingles."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 token ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), packing.Tokenizer.read())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes covered by a 200-byte string that also starts elsewhere."""
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _digit(text: str, at: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5({text}), {at}, 1)) - 1)"


#: The pages have no fetch times and there is no list: both are made from the pages' own ids and URLs, alike in
#: both SQL dialects. Every host gets a block and a removal, its domain a block, its language section an exception.
_DAY = "(16 * {a} + {b})"
_CAPTURES = f"""
    SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) AS section,
           2 * {_DAY.format(a=_digit("CAST(page_id AS STRING)", 1), b=_digit("CAST(page_id AS STRING)", 2))} AS day
    FROM pages
"""
_ENTRIES = f"""
    SELECT DISTINCT host AS pattern, 'block' AS action, {_DAY.format(a=_digit("host", 3), b=_digit("host", 4))} AS day FROM captures
    UNION ALL
    SELECT DISTINCT host, 'remove', 200 + {_DAY.format(a=_digit("host", 5), b=_digit("host", 6))} FROM captures
    UNION ALL
    SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1), 'block', 300 + {_digit("host", 7)} FROM captures
    UNION ALL
    SELECT DISTINCT concat(host, '/', section), 'allow', 100 + {_digit("concat(host, section)", 1)} FROM captures
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule in force for every page on its day of capture."""
    pages = _table(spark, sf_dir, "pages")
    captures = spark.sql(_CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    entries = spark.sql(_ENTRIES.replace("FROM captures", "FROM {captures}"), captures=captures)
    entries = entries.withColumn("effective", F.timestamp_seconds(F.col("day") * 86_400))
    captures = captures.withColumn("fetch_time", F.timestamp_seconds(F.col("day") * 86_400))
    found = url_filters.evaluate(captures, entries)
    day = (F.unix_timestamp("fetch_time") / 86_400).cast("bigint").alias("fetch_day")
    return found.select("page_id", day, "pattern", "action", "blocked")


_OP10 = f"""
    WITH captures AS ({_CAPTURES}), entries AS ({_ENTRIES}),
    ranked AS (
        SELECT pattern, day, max(CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS r
        FROM entries WHERE pattern IS NOT NULL GROUP BY ALL
    ),
    spans AS (
        SELECT pattern, r, day AS start, coalesce(lead(day) OVER (PARTITION BY pattern ORDER BY day), 1000000) AS stop
        FROM ranked
    ),
    rules AS (
        SELECT page_id, day, pattern, r, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) AS n
        FROM captures JOIN spans ON day >= start AND day < stop AND r > 1
         AND (host = pattern OR ends_with(host, '.' || pattern)
              OR starts_with(regexp_extract(url, '://([^?#]*)', 1) || '/', pattern || '/') AND contains(pattern, '/'))
    )
    SELECT c.page_id, CAST(c.day AS BIGINT) AS fetch_day, pattern,
           CASE r WHEN 3 THEN 'block' WHEN 2 THEN 'allow' END AS action, coalesce(r = 3, false) AS blocked
    FROM captures c LEFT JOIN (SELECT * FROM rules WHERE n = 1) x USING (page_id)
"""

def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    found = pii_crf.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents repeat their words with a period from some word on."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    n = F.size("w")
    from_ = F.when(n > 0, F.col("g") % n)
    period = F.expr("1 + (size(w) - a) div (3 + g % 8)")
    word = "w[int(if(i >= a, a + (i - a) % p, i))]"
    planted = F.expr(f"array_join(transform(sequence(0, size(w) - 1), i -> {word}), ' ')")
    chosen = chosen.withColumn("a", from_).withColumn("p", period)
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 3 periods and 24 words in all documents, a tenth of which are made periodic."""
    docs = _with_periods(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.collapse_runs(docs).withColumn("best", periodic_runs.strongest_run())
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, without sentence ends, repeated or given to the user; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("k")
    )
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all damaged conversations and the cheapest edits that make them sound."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.summary(conversations.repair(_damaged(rows))).withColumnRenamed("conv_id", "id")
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_vectors": op5_vectors,
    "op6_warc": op6_warc,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

# \\x0b and \\x0c stand for the two control characters among white space.
_OP1 = """
    WITH lines AS (
        SELECT doc_id, i, line, lower_ascii, count(DISTINCT doc_id) OVER (PARTITION BY lower_ascii) AS df
        FROM (
            SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
            FROM (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
                FROM documents
            )
        )
    )
    SELECT doc_id, count(*) AS n_lines, count_if(df >= 10 AND lower_ascii <> '') AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (df >= 10 AND lower_ascii <> '')), '')) AS kept_sha256
    FROM lines GROUP BY doc_id
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP3 = f"""
    WITH doc_words AS (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM (
            SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
    ),
    item_words AS (
        SELECT item_id, regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
    ),
    item_windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT size FROM item_windows),
    doc_windows AS (
        SELECT doc_id, i, size, gram FROM (
            SELECT doc_id, i, size, n, string_agg(word, ' ') OVER (
                PARTITION BY doc_id, size ORDER BY i ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS gram
            FROM doc_words, sizes) WHERE i + size - 1 <= n
    ),
    found AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, gram)),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
    ),
    words AS (SELECT doc_id, count(*) AS n_words FROM doc_words GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_COMPONENTS = """
    reach(node, root) AS (
        SELECT a, a FROM links UNION SELECT l.a, r.root FROM links l JOIN reach r ON l.b = r.node WHERE r.root < l.a
    ),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
"""

_OP5 = f"""
    WITH RECURSIVE usable AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM usable x, usable y
        WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95
    ),
    {_COMPONENTS}
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
           coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN roots ON node = vec_id
"""

_OP6 = """
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(digest, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)),
               'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM (SELECT *, sha1(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""

_OP7 = f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(text, {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM words WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (gram)
        WHERE x.doc_id <> y.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)
    ),
    {_COMPONENTS}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON node = doc_id
"""

#: Table of the cyclic redundancy check of 32 bits, and the check of an ASCII text by it.
_CRC_TABLE = """
    crc_table AS (
        SELECT list(list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                    ORDER BY k) AS t
        FROM (SELECT unnest(range(256)) AS k)
    )
"""


def _crc32(text: str) -> str:
    codes = f"list_transform(range(1, 1 + length({text})), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


_OP12 = f"""
    WITH {_CRC_TABLE},
    words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
               {_crc32("CAST(doc_id AS VARCHAR)")} AS h
        FROM documents, crc_table
    ),
    chosen AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 3 + (h // 10) % 8 AS parts FROM words WHERE h % 10 = 0 AND len(w) > 0),
    planted AS (
        SELECT doc_id, list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END]) AS w
        FROM chosen
        UNION ALL SELECT doc_id, w FROM words WHERE NOT (h % 10 = 0 AND len(w) > 0)
    ),
    tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM planted),
    pairs AS (
        SELECT x.doc_id, y.i - x.i AS q, x.i FROM tokens x JOIN tokens y USING (doc_id, word)
        WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ),
    islands AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
        GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
    ),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM tokens ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
    ),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY doc_id
    ),
    best AS (
        SELECT doc_id, start, length, period FROM runs x
        WHERE NOT EXISTS (
            SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
             OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def _best(*options: str) -> str:
    """The least (cost, audit, text) of several paths into a state."""
    return f"list_min([{', '.join(options)}])"


def _step(path: str, cost: str, letters: str, said: str = "''") -> str:
    return f"{{'c': {path}.c + {cost}, 'l': {path}.l || {letters}, 'r': {path}.r || {said}}}"


_NOWHERE = "{'c': 1000000000, 'l': '', 'r': ''}"
_U, _A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_OP13 = f"""
    WITH RECURSIVE {_CRC_TABLE},
    given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
        FROM conversations
    ),
    damaged AS (
        SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM (SELECT *, {_crc32("key")} % 20 AS k FROM given, crc_table) WHERE k <> 0
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged
    ),
    faults AS (
        SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AND regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS duplicate,
               coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
        FROM ordered
    ),
    rows AS (
        SELECT *, blank OR duplicate AS goes,
               NOT blank AND NOT duplicate AND regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') AS truncated
        FROM faults
    ),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
               count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
        FROM rows GROUP BY conv_id
    ),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'l': '', 'r': ''}} AS z, {_NOWHERE} AS s, {_NOWHERE} AS u, {_NOWHERE} AS a FROM counts
        UNION ALL
        SELECT conv_id, i + 1,
               {_step("z", "4", "'D'")},
               CASE WHEN goes THEN {_step("s", "4", "'D'")}
                    ELSE {_best(_step("s", "4", "'D'"), f"CASE WHEN first = 's' THEN {_step('z', 'more', "'K'", 'line')} ELSE {_NOWHERE} END")} END,
               CASE WHEN goes THEN {_step("u", "4", "'D'")}
                    ELSE {_best(_step("u", "4", "'D'"), *(_step(p, "3 + more", "'R'", f"{_U} || text") for p in "zsa"),
                                *(f"CASE WHEN first = 'u' THEN {_step(p, 'more', "'K'", 'line')} ELSE {_NOWHERE} END" for p in "zsa"))} END,
               CASE WHEN goes THEN {_step("a", "4", "'D'")}
                    ELSE {_best(_step("a", "4", "'D'"), _step("u", "3 + more", "'R'", f"{_A} || text"),
                                f"CASE WHEN first = 'a' THEN {_step('u', 'more', "'K'", 'line')} ELSE {_NOWHERE} END")} END
        FROM (
            SELECT w.conv_id, w.i, z, s, goes, text, left(role, 1) AS first, CASE WHEN truncated THEN 3 ELSE 0 END AS more,
                   chr(10) || role || ':' || text AS line,
                   {_best("u", *(_step(p, "3", "'I'", _U) for p in "zsa"))} AS u,
                   {_best("a", _step("u", "3", "'I'", _A), *(_step(p, "6", "'II'", f"{_U} || {_A}") for p in "zs"))} AS a
            FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        )
    ),
    ends AS (
        SELECT c.*, {_best("z", "a", _step("u", "3", "'I'", _A), _step("s", "6", "'II'", f"{_U} || {_A}"))} AS p
        FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
    )
    SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.c, 0) AS cost, coalesce(p.l, '') AS audit,
           sha256(coalesce(substr(p.r, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _OP1,
    "op3_decontamination": _OP3,
    "op5_vectors": _OP5,
    "op6_warc": _OP6,
    "op7_ngram_join": _OP7,
    "op10_url_filters": _OP10,
    "op12_periodic_runs": _OP12,
    "op13_conversation_repair": _OP13,
}
