"""The registered queries of the operators, and the SQL that some are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exact_dedup, html_text, language_id, license_scan, lm_scoring, near_dedup, quality, sentencepiece_codec, source_divergence, spelling, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(_table(spark, sf_dir, "documents"), percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def learned(column: str, folds: int, out: int):
    """Whether a row may be learned from: the crc32 of its id as text falls outside one of the folds."""
    return F.crc32(F.col(column).cast("string")) % folds != out


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learned("doc_id", 3, 1))
    found = language_id.predict(docs, model, keep=["doc_id"], spans=False)
    return found.select("doc_id", F.coalesce(~learned("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), learned("doc_id", 5, 0))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(~learned("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm_scoring.train(docs.filter(F.coalesce(learned("doc_id", 10, 0), F.lit(True))))
    scored = lm_scoring.score(docs, model)
    return scored.withColumn("held_out", F.coalesce(~learned("doc_id", 10, 0), F.lit(False)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


#: A text with A-Z lower-cased (null: empty), and the words of operators 1 and 7, in DuckDB's SQL.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORD, SPACED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("text")}, '{ITEM_WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({LOWER.format("text")}, '{ITEM_WORD}') AS w FROM benchmark),
bn AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM bn, unnest(range(1, len(w) - n + 2)) AS u(k)),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(w) - n + 2)) AS u(k)),
found AS (SELECT r, k, n, item FROM dw JOIN bw USING (n, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, k, n FROM found) AS f, unnest(range(k, k + n)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS keep FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN g USING (hex)
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{SPACED_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] END)) AS x FROM d),
c AS (SELECT min(doc_id) AS c, x, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
e AS (SELECT c, n, unnest(x) AS y FROM c),
link AS (SELECT a.c AS a, b.c AS b FROM e AS a JOIN e AS b ON a.y = b.y AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a),
least AS (SELECT a AS c, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, s.doc_id = coalesce(l.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.x = c.x LEFT JOIN least AS l ON c.c = l.c
"""

OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP11_SQL = f"""
WITH RECURSIVE
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, unnest(regexp_extract_all({LOWER.format("text")}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM runs GROUP BY d, run),
crc AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(x) // 2)]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, _: xor(y >> 1, 3988292384 * (y & 1))))) AS h FROM own),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM w, unnest(range(0, length(word))) AS u(i)),
pair AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less AS a JOIN w AS b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less AS a JOIN w AS b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pair GROUP BY word),
form AS (SELECT p.word, min(p.near) AS form, b.top AS form_n FROM pair AS p JOIN best AS b USING (word) JOIN w USING (word) WHERE p.n = b.top AND b.top >= 2 * w.n GROUP BY p.word, b.top),
follow AS (SELECT word, word AS at FROM w UNION ALL SELECT f.word, o.form FROM follow AS f JOIN form AS o ON o.word = f.at)
SELECT w.word, form.form, follow.at AS root, w.n, coalesce(best.n_near, 0) AS n_near, form.form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN form USING (word) JOIN follow ON follow.word = w.word LEFT JOIN form AS o ON o.word = follow.at WHERE o.word IS NULL
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS in_lang FROM t GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(o.total, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.in_lang + 2) // (l.total + 2 * l.v) AS q
  FROM groups JOIN kept AS k USING (lang) JOIN langs AS l USING (lang) LEFT JOIN counts AS c USING (lang, source, term) LEFT JOIN own AS o USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_token_files": op4_token_files,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_warc": op6_warc,
        "op7_near_dedup": op7_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_html_text": op9_html_text,
        "op10_quality": op10_quality,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_source_divergence": op12_source_divergence,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op6_warc": OP6_SQL,
        "op7_near_dedup": OP7_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
    }
