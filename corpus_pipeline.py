"""The corpus pipeline: five stages, each over all documents that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
documents; the last returns those and copy and shuffle_key. Each stage's result is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.common import bound_batches, remainder, table, write_shared
from millrace.llm.decontam import decontaminate
from millrace.llm.linededup import dedup_lines
from millrace.llm.minhash import near_duplicates
from millrace.llm.mixing import mix

#: Fixed value: documents whose shingle sets have so many percent in common are near-duplicates here.
#: (The query op2_minhash has a bound of its own.)
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no text, no letter, or unlike any language learned. A null lang
    is filled with the prediction.

    Null and empty texts go; null doc_ids are judged by their text and teach nothing; repeated
    rows stay or go together. An empty table gives none.
    """
    bound_batches(spark)
    model = langid.fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select(*COLUMNS), model).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold go, but from the largest doc_id; n_chars follows the text.

    Null texts stay null, empty ones empty, and a document may become so; a null doc_id keeps all
    its lines; repeated rows are one document and change alike. An empty table gives none.
    """
    bound_batches(spark)
    kept = dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Null, empty and blank texts are like nothing and stay, as do null doc_ids; repeated rows are one
    document and stay or go together. An empty table gives none.
    """
    bound_batches(spark)
    gone = near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT).filter(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, or a run of 13 of its tokens.

    Null and empty texts hold none and stay, as do null doc_ids; null and empty items are in no
    document; repeated rows go together. An empty table gives none.
    """
    bound_batches(spark)
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that every source has the same expected share of characters.

    Null sources are a source of their own; null and empty texts are drawn at their source's rate;
    repeated rows (and all null doc_ids) have the same number of copies each. An empty table
    gives none. Null doc_ids draw as the text 'null'.
    """
    bound_batches(spark)
    return mix(docs.select(*COLUMNS))


STAGES = [("language ID", language), ("line dedup", lines), ("near-duplicates", near_dedup), ("decontamination", benchmark), ("mixing", mixture)]

#: Language ID is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
