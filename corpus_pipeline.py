"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Every function takes (session, documents, folder of tables) and returns a table; all but the last return the columns of
documents. Equal, null and empty texts: see the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import langid
from verdikt.llm.common import WHITE, column_or_null
from verdikt.llm.line_dedup import dedup_lines
from verdikt.llm.mixing import WEIGHTS, corpus_levels, mix
from verdikt.llm.order_minhash import drop_near_duplicates
from verdikt.llm.packing import pack_documents

#: Documents that no language is at least so sure of are rejected, as are those without a letter.
LEAST_SURE = 0.1
#: Of the tokens left after deduplication, so many are taken for the mixture.
BUDGET_SHARE = 0.8


def _packed(docs: DataFrame) -> DataFrame:
    """What operators look at, and all other columns as one, so that none can clash with a column that an operator adds.
    Without a column lang or source, its values count as null."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", *(column_or_null(docs, c, "string").alias(c) for c in ("lang", "source")), F.struct(*rest).alias("__rest"))


def _unpacked(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """found in the columns of docs, with the text as it is now; n_chars, where there is one, follows it."""
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(F.col("text") if c == "text" else changed.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; one without a language label gets the predicted one. Without any label nothing can be
    learnt: then every text with a letter stays as it is. Null and letterless texts go, repeated rows stay, an empty
    table gives an empty one, and a long text is judged by all of it."""
    packed = _packed(docs)
    classifier = langid.fit(packed)
    if classifier is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(packed, classifier).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SURE))
    return _unpacked(found, docs, lang=F.coalesce("lang", "lang_pred"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share stay where they occur first, by the least id, and go from the others: of a
    group of copies one whole text stays. Documents that are emptied go; null texts and those that were empty before
    stay, as no line of theirs goes. Equal rows are documents of their own."""
    found = dedup_lines(_packed(docs), min_length=1, min_documents=10, keep_first=True)
    return _unpacked(found.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(WHITE)) != "")), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least id, and of equal rows one. Texts
    without words are no copies of each other, unless the rows are equal."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, each once at most. Null languages and sources are nodes of the tree like others; a null or
    empty text is one token; equal rows come or go together."""
    return _unpacked(mix(_packed(docs), WEIGHTS, BUDGET_SHARE, corpus_levels(), max_epochs=1, seed=11), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens. A null text is an empty document of one token."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_common_lines),
    ("copies", drop_copies),
    ("mixture", mix_sources),
    ("packing", pack),
]

#: SQL can't express the trained and hashed stages; the tests hold what each stage keeps against its rule on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in one go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
