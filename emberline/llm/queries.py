"""The operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import ann, hardneg, langid, lmscore, merkle, mixing, packing, records, simhash, tokencount, topk, toxicity, wordvec
from emberline.llm.common import held_out, scratch_path

def categories() -> dict:
    """The chain's categories, in their order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, by = table(spark, sf_dir, "documents"), categories()
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), by), list(by))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return records.read_records(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows claim one character more than they have; their folded root isn't the root."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, claimed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    found = found.withColumn("folded_root", merkle.folded(F.col("claimed_leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = wordvec.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"), F.col("quality"))
    found = wordvec.score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP1_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP3_SQL = """
WITH RECURSIVE stats AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source
), shares AS (
  SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM stats
), parted AS (
  SELECT source, CAST(ceil(rate / 16.0) AS INTEGER) AS parts, rate / ceil(rate / 16.0) AS mean FROM shares WHERE rate > 0
), cdf AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 71
), laws AS (
  SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts
), draws AS (
  SELECT d.*, t.part, l.cs,
    CAST(CAST('0x' || substr(md5(concat_ws(':', '1', 'rate', CAST(t.part AS VARCHAR), coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN laws l ON d.source IS NOT DISTINCT FROM l.source, range(1, l.parts + 1) AS t(part)
), copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(t.c AS INTEGER) AS copy_no
  FROM (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda c: c <= u))) AS m FROM draws GROUP BY doc_id, text, lang, source, n_chars) d,
       range(1, CAST(d.m AS BIGINT) + 1) AS t(c)
)
SELECT *, CAST(CAST('0x' || substr(md5(concat_ws(':', '1', 'place', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(copy_no AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS mix_key
FROM copies
"""

OP11_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

#: An entry of CRC-32's table, from its eight bits; the polynomial is a fixed value.
_CRC_ENTRY = "list_reduce(list_prepend(CAST(range AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END)"


def _leaf_sql(n_chars: str) -> str:
    """A leaf's digest with ``n_chars`` as that column's value."""
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list({_CRC_ENTRY} ORDER BY range) AS t FROM (SELECT range FROM range(256))
), leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS tampered,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295) % 7 = 0 AS touched
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT lang, 0 AS level, place, leaf AS hash, n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, place // 2, n
), tops AS (
  SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS level, place, hash, n FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, place // 2, n
), climb AS (
  SELECT row_number() OVER () AS k, p.doc_id, p.lang, p.leaf, p.place AS first, t.hash AS subroot, t.place AS top, r.hash AS root, 0 AS level, p.place, p.n,
    '' AS proof, CASE WHEN p.touched THEN p.tampered ELSE p.leaf END AS folded
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang, (SELECT hash FROM crown WHERE n = 1) r
  UNION ALL
  SELECT c.k, c.doc_id, c.lang, c.leaf, c.first, c.subroot, c.top, c.root, c.level + 1, c.place // 2, (c.n + 1) // 2, c.proof || coalesce(s.hash, ''),
    sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END)
  FROM climb c LEFT JOIN tree s ON c.lang IS NOT DISTINCT FROM s.lang AND s.level = c.level AND s.place = xor(c.place, 1) WHERE c.n > 1
), above AS (
  SELECT doc_id, leaf, subroot, root, 0 AS level, top AS place, (SELECT max(n) FROM tops) AS n, proof, folded, k FROM climb WHERE n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.root, c.level + 1, c.place // 2, (c.n + 1) // 2, c.proof || coalesce(s.hash, ''),
    sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END), c.k
  FROM above c LEFT JOIN crown s ON s.level = c.level AND s.place = xor(c.place, 1) WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM above WHERE n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_topk, op2_packing, op3_mixing, op4_simhash, op5_token_counts, op6_lm_scoring, op7_ann, op8_language_id, op9_toxicity, op10_token_records, op11_hard_negatives, op12_merkle_manifest, op13_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_mixing": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
