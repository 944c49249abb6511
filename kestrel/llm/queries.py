"""The registered queries of the subpackage, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (bpe, importance, line_chunks, nn_descent, packing, pii, reply_trees, secrets, simhash,
                         target_sampling, toxicity, weak_rules, whitening)
from kestrel.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model)


def op3_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    good = labels.where(F.col("quality") == 1).select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), good, labelled=labels.select("doc_id").distinct().count())


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.report(table(spark, sf_dir, "documents"))


def op8_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_secret_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return reply_trees.digests(reply_trees.format_trees(reply_trees.as_tree(talks)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0 AS ok
  FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE ok),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(m.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN low l USING (vec_id) LEFT JOIN many m USING (vec_id)
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') AS body,
  replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ':', '\c') AS head FROM t),
c AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
  sum(length(body) + length(head) + 14)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM c
"""

#: A crc32 is the exclusive or of a term of the length and one of each byte at its distance from the end.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, b::BIGINT AS x, 0 AS step FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, step + 1 FROM bits WHERE step < 8),
base AS MATERIALIZED (SELECT b, x FROM bits WHERE step = 8),
words AS (
  SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
features AS MATERIALIZED (
  SELECT src, id, f, count(*) AS n FROM (
    SELECT src, id, unnest(list_concat(w,
      [w[i] || ' ' || w[i + 1] for i in range(1, len(w))],
      [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM words) GROUP BY ALL),
hexed AS MATERIALIZED (SELECT DISTINCT f, hex(encode(f)) AS h FROM features),
longest AS MATERIALIZED (SELECT max(length(h) // 2) AS m FROM hexed),
dist AS (
  SELECT 0::BIGINT AS d, b, x FROM base
  UNION ALL SELECT t.d + 1, t.b, xor(t.x // 256, base.x) FROM dist t JOIN base ON base.b = t.x % 256, longest
  WHERE t.d + 1 < longest.m),
zeros AS (
  SELECT 0::BIGINT AS l, 4294967295::BIGINT AS s
  UNION ALL SELECT l + 1, xor(s // 256, base.x) FROM zeros JOIN base ON base.b = s % 256, longest WHERE l < longest.m),
bytes AS (
  SELECT f, length(h) // 2 AS l, unnest(range(0, length(h) // 2)) AS i, h FROM hexed),
crcs AS MATERIALIZED (
  SELECT f, xor(xor(any_value(zeros.s), 4294967295), bit_xor(dist.x)) % 10000 AS bucket
  FROM bytes JOIN dist ON dist.d = bytes.l - 1 - bytes.i AND dist.b = ('0x' || substr(bytes.h, (2 * bytes.i + 1)::BIGINT, 2))::BIGINT
  JOIN zeros ON zeros.l = bytes.l GROUP BY f),
counted AS (SELECT src, bucket, sum(n) AS n FROM features JOIN crcs USING (f) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (src = 'd'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (src = 'b'), 0)::DOUBLE AS t_all FROM counted),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (src = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 'b'), 0)::DOUBLE AS t
  FROM counted GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM buckets, sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM features JOIN crcs USING (f) JOIN gain USING (bucket) WHERE src = 'd' GROUP BY id),
scored AS (
  SELECT words.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || words.id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE src = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN r <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (
    op1_nn_descent, op2_toxicity_counterfactual, op3_bpe_rank_queue, op4_importance_resampling, op5_weak_supervision,
    op6_binary_packing, op7_line_chunks, op8_simhash_covering, op9_pii_bootstrap, op10_secret_token_ratio,
    op11_reply_trees, op12_whitening, op13_target_resampling)}
ORACLE = {"op1_nn_descent": OP1_SQL, "op11_reply_trees": OP11_SQL, "op13_target_resampling": OP13_SQL}
