"""The queries of the training-data operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import decontaminate, divergence, exact_dedup, html_text, lexical, licences, line_dedup, mixing, ngram_join, quality, token_files, topk, toxicity
from kerbflow.llm._cluster import sized

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.scaled(_table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(rows, rows.where("vec_id % 50 = 0"))


def tokenizer_path() -> str:
    """The installed vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs.join(sized(labels), "doc_id"))  # the texts stay in place while the labels are few
    out = toxicity.toxic_passages(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def quality_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, quality_ratings(spark, sf_dir))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", "expected_grade", "tail", (F.col("tail") >= quality.KEEP).alias("keep"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.char_length("text").alias("n_chars_left"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is the half of the documents with the lower ids, so that its winners have the least id of all."""
    docs = _table(spark, sf_dir, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    found = exact_dedup.exact_groups(docs, F.col("doc_id") <= F.lit(middle))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_table(spark, sf_dir, "documents"))
    return lexical.ranked_search(index, _table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM r),
f AS (SELECT level AS fill FROM l WHERE level <= ratio ORDER BY ratio, source NULLS FIRST LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT fill FROM f) * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
e AS (SELECT *, round(target)::BIGINT - whole * source_size AS extra FROM p),
o AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.extra,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN 2 * (extra - ahead) >= size THEN size ELSE 0 END)::BIGINT AS taken FROM o
"""

OP3_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS parts FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, max(list_sum(list_transform(range(1, len(v.parts) + 1), lambda i: q.parts[i] * v.parts[i])))::BIGINT AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.parts) = len(v.parts) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM l),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1), s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) AS term FROM benchmark),
p AS (SELECT q.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + (90 * l.n * s.docs) // s.total))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN f USING (term) JOIN l ON l.doc_id = f.doc_id, s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, {_LETTERS})) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2, 3),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.all_n, v.v, v.total FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (total + 5 * v) AS q FROM e),
x AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(y.value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY 1, 2, 3) y
    ON y.lang = g.lang AND y.source = g.source AND y.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_licence_scan, op3_exact_top_k, op4_token_files, op5_toxic_passages,
    op6_quality, op7_ngram_jaccard_join, op8_line_dedup, op9_decontamination, op10_main_text,
    op11_exact_dedup, op12_lexical_search, op13_source_divergence,
)}
ORACLE = {"op1_source_mixing": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op11_exact_dedup": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_source_divergence": OP13_SQL}
