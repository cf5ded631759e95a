"""The registered queries: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, hard_negatives, html_text, language_id, mixing, near_copies, pii, pitman_yor, prefix_trie, quality, repeats, secret_scan, top_k
from graphloom.llm.common import crc_mod, table
from graphloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)], F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("all").alias("spans"))


@query("op2_near_copies")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.join(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(crc_mod("doc_id", 4) != 2))
    return language_id.identify(docs.withColumn("held_out", crc_mod("doc_id", 4) == 2), model, ("doc_id", "held_out"))


#: Windows of an item's size around shared shingles, weighted Jaccard by multisets of shingle texts.
DECONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM
  (SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS off, w FROM b),
bh AS (SELECT item_id, n, k, off, list_aggregate(w[off + 1:off + k], 'string_agg', ' ') AS s FROM bs),
ds AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
dh AS (SELECT doc_id, len(w) AS size, k, pos, list_aggregate(w[pos + 1:pos + k], 'string_agg', ' ') AS s FROM ds),
seeds AS (SELECT DISTINCT dh.doc_id, bh.n, bh.k, greatest(0, least(pos - off, size - n)) AS start FROM dh JOIN bh ON dh.s = bh.s AND dh.k = bh.k),
win AS (SELECT seeds.doc_id, n, k, start, w[start + 1:start + n] AS w FROM seeds JOIN d ON d.doc_id = seeds.doc_id),
sh AS (SELECT *, list_transform(range(0, greatest(len(w) - k, 0) + 1), lambda i: list_aggregate(w[i + 1:i + k], 'string_agg', ' ')) AS a FROM win),
ib AS (SELECT *, list_transform(range(0, n - k + 1), lambda i: list_aggregate(w[i + 1:i + k], 'string_agg', ' ')) AS a FROM b),
num AS (SELECT doc_id, n, start, len(w) AS n_words, list_transform(a, lambda s, i: s || '#' || len(list_filter(a[1:i], lambda x: x = s))) AS a FROM sh),
nib AS (SELECT item_id, n, list_transform(a, lambda s, i: s || '#' || len(list_filter(a[1:i], lambda x: x = s))) AS a FROM ib),
pairs AS (SELECT doc_id, item_id, start, n_words, len(list_intersect(num.a, nib.a)) AS shared, len(num.a) + len(nib.a) AS total FROM num JOIN nib ON num.n = nib.n),
good AS (SELECT *, CAST(shared AS DOUBLE) / (total - shared) AS similarity FROM pairs WHERE CAST(shared AS DOUBLE) / (total - shared) >= 0.8)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM good) WHERE r = 1
"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pitman_yor")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = crc_mod("doc_id", 3) != 1
    net = quality.train(docs.filter(learnt), table(spark, sf_dir, "labels").filter(learnt))
    scored = quality.score(docs.withColumn("held_out", crc_mod("doc_id", 3) == 1), net, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: Windows as digests of their words; words without a recurring window, put together again in order.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, p, md5(array_to_string(w[p + 1:p + 35], ' ')) AS k FROM (SELECT r, w, unnest(range(0, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@query("op7_repeats", REPEATS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), digest=True)


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: The same answer from all pairs of a query and a candidate.
TOP_K_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op10_top_k", TOP_K_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = top_k.whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k.search(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


#: Whole prefixes as running digests; crc32 bit by bit (-1 shifts, other numbers are bytes taken in).
PREFIX_TRIE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, count(*) AS n, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM t GROUP BY conv_id),
crc AS (SELECT c, b, n, xor(list_reduce(list_concat([4294967295], steps), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295) % 9 AS h FROM ids),
conv AS (SELECT crc.c, crc.b, crc.h, least(crc.h, coalesce(o.n, 0)) AS m FROM crc LEFT JOIN crc o ON o.c = crc.b),
r AS (SELECT c, pos, role, text FROM conv JOIN t ON conv_id = b AND pos < h UNION ALL SELECT c, pos - h + m, role, text FROM conv JOIN t ON conv_id = c AND pos >= h),
p AS (SELECT c, pos + 1 AS d, string_agg(md5(md5(role) || md5(text)), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos) AS k, octet_length(encode(text)) AS size FROM r UNION ALL SELECT c, 0, '', 0 FROM conv),
q AS (SELECT c, d, k, size, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM p),
node AS (SELECT d, k, any_value(up) AS up, any_value(size) AS size, min(c) AS conv, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS sha FROM q GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY up, d),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS children FROM node LEFT JOIN kids USING (d, k)),
sums AS (SELECT q.d, q.k, sum((f.n - 1) * f.size) AS saved, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves FROM full_node f JOIN q ON q.c = f.conv AND q.d <= f.d GROUP BY q.d, q.k)
SELECT f.conv AS conv_id, f.d AS depth, u.conv AS parent_conv_id, f.n AS n_convs, f.children AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, f.sha AS ends_sha256
FROM full_node f JOIN sums USING (d, k) LEFT JOIN node u ON u.d = f.d - 1 AND u.k = f.up
"""


@query("op11_prefix_trie", PREFIX_TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_secret_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find(docs, secret_scan.train(docs))
    base = secret_scan.of_kind(F.col("spans"), "assign", "access", "hex")
    counts = [F.size(secret_scan.of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


#: All pairs of an anchor and a candidate; the positives' scores bound the negatives'.
HARD_NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", HARD_NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label=shifted)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
