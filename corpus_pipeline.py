"""A corpus pipeline: language ID, near-duplicate removal, decontamination, sanitisation, tokenisation.

``STAGES`` lists (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame; each
result is written as Parquet in the shared folder and read back as the next one's ``docs``. All but the
last return the columns of ``documents``.

Defined results: a null or empty text is in no language and goes in the first stage; stages that get one keep it. Rows are documents, whatever their
doc_id: rows without one, or that share one, are told apart by keys of their own while a stage decides. Of near copies the row with the
smallest doc_id stays, before rows that share an id or have none; equal rows are near copies. Texts of any length are read whole.
Columns beyond those of documents are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotaxa.llm import decontaminate, jaccard_join, language_id, pii, sentencepiece_codec
from chronotaxa.llm.shared import Stage

#: A text is no text of a learned language if fewer of its n-grams than this share belong to the best one.
LEAST_SUPPORT = 0.2


#: Ids up to this number (counted) go to the documents; of more, the documents are shuffled.
BROADCAST_IDS = 250_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``."""
    ids = Stage(docs.sparkSession, "ids").write(ids)
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def by_row(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``decide`` gets (doc_id, text) with an id for each row and says which ids go; the other rows of ``docs`` come back as they were.

    Ids that are there once are the rows' own. Only rows without one, or that share one, get others, above all that are there, in the order of the rows'
    contents; those rows are written, so that their ids stay the same.
    """
    spark, known = docs.sparkSession, F.col("doc_id").isNotNull()
    shared = docs.where(known).groupBy("doc_id").count().where("count > 1").select("doc_id")
    shared = Stage(spark, "shared").write(shared)
    odd = docs.where(~known).unionByName(docs.join(shared, "doc_id", "left_semi").select(docs.columns))
    if odd.isEmpty():
        return without(docs, decide(docs.select("doc_id", "text")))
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    packed = odd.select(F.col("doc_id").alias("given"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("order", F.xxhash64("row"))
    laid = packed.repartitionByRange("order").sortWithinPartitions("given", "order")
    laid = Stage(spark, "odd").write(laid.select((F.lit(top) + 1 + F.monotonically_increasing_id()).alias("doc_id"), "text", "row"))
    plain = docs.where(known).join(shared, "doc_id", "left_anti").select(docs.columns)
    gone = Stage(spark, "gone").write(decide(plain.select("doc_id", "text").unionByName(laid.select("doc_id", "text"))))
    kept = without(laid, gone).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return without(plain, gone).unionByName(kept)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a letter, or in no learned language, go."""
    return language_id.keep_known(docs, LEAST_SUPPORT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near copies one document stays."""
    return by_row(docs, lambda rows: jaccard_join.jaccard_classes(rows).where("doc_id <> component_id").select("doc_id"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that leak a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return by_row(docs, lambda rows: decontaminate.leaks(rows, bench).select("doc_id").distinct())


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data and what gives it away are replaced; n_chars follows the new text."""
    clean = pii.sanitise(docs)
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return (clean if size is None else clean.withColumn("n_chars", size)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: doc_id, n_tokens and SentencePiece ids."""
    model = sentencepiece_codec.read_model(spark, sentencepiece_codec.tokenizer_path())
    return sentencepiece_codec.tokens_of(docs, model).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", no_benchmark),
    ("pii", sanitised),
    ("sentencepiece", tokens),
]

#: The stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return docs
