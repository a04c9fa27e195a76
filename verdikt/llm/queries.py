"""The operators' registered queries, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import fim, langid, pii, ppm, quality, spelling
from verdikt.llm.nn_descent import nearest
from verdikt.llm.order_minhash import near_duplicates
from verdikt.llm.mixing import WEIGHTS, corpus_levels, mix
from verdikt.llm.va_file import top_k
from verdikt.llm.line_dedup import dedup_lines
from verdikt.llm.packing import pack_documents
from verdikt.llm.url_reputation import judge_urls

#: The rules of the url query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as good if the labels say good quality and not toxic; labels are joined by number."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge_urls(read(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every document, without the redacted texts."""
    return pii.find(read(spark, sf_dir, "documents"), redact=False)


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every fiftieth."""
    embeddings = read(spark, sf_dir, "embeddings")
    return top_k(embeddings, embeddings.filter("vec_id % 50 = 0"))


OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of all vectors for every twentieth."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def id_remainder(of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op5_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents that aren't held out, predicted for all."""
    held_out = id_remainder(3) == 1
    found = langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from all; only a digest of what stays is returned."""
    kept = dedup_lines(read(spark, sf_dir, "documents"), min_length=1, min_documents=10, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents that aren't held out, all scored."""
    return ppm.score_documents(read(spark, sf_dir, "documents"), id_remainder(7) == 2)


def op9_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 % of all tokens by weight, two epochs at most."""
    mixed = mix(read(spark, sf_dir, "documents"), WEIGHTS, 0.8, corpus_levels(), max_epochs=2, seed=11)
    return mixed.select("doc_id", "lang", "source", "epoch")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more; one of 31 runs loses a letter, so that there are errors to find."""
    return spelling.group_spellings(read(spark, sf_dir, "documents").select("doc_id", "text"), error_every=31)


def op12_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the labels that aren't held out, all documents scored."""
    held_out = id_remainder(4) == 2
    scored = quality.score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put in another order; digests of the output and of the text rebuilt from it."""
    made = fim.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = (F.sha2(c, 256) for c in (F.col("output"), fim.restored(F.col("output"), F.col("form"))))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(d.alias(name) for d, name in zip(digests, ("output_sha256", "restored_sha256"), strict=True)))


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM drawn
), formed AS (
  SELECT *, least(a, b) AS x, greatest(a, b) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, '<P>' || substr(t, 1, x) AS p, '<M>' || substr(t, x + 1, y - x) AS m, '<S>' || substr(t, y + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_boosted_pii": op2_boosted_pii,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_va_file_top_k": op4_va_file_top_k,
    "op5_hierarchical_language_id": op5_hierarchical_language_id,
    "op6_nn_descent": op6_nn_descent,
    "op7_line_dedup": op7_line_dedup,
    "op8_ppm_scoring": op8_ppm_scoring,
    "op9_hierarchical_mixing": op9_hierarchical_mixing,
    "op10_order_minhash": op10_order_minhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_boosted_quality": op12_boosted_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {"op4_va_file_top_k": OP4_SQL, "op7_line_dedup": OP7_SQL, "op13_fill_in_middle": OP13_SQL}
