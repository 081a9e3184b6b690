"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.llm import bpe_codec, decontaminate, jaccard_join, language_id, line_chunks
from sparkpact.llm._common import Scratch, importable, scratch_scope, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; unseen scripts, random letters and texts without letters go. The model learns from the documents' own labels."""
    importable(spark)
    return language_id.keep_identified(spark, docs, language_id.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; exact copies and others of which nothing is left go. n_chars follows
    the text."""
    # written first: a filter on the new text would be pushed down and compute the chunks anew, many times over
    out = Scratch(spark, "deduped").write(line_chunks.dedup_lines(spark, docs, whole=True), "lines")
    left = out.where("n_removed = 0 OR trim(text) <> ''")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    importable(spark)
    return jaccard_join.one_of_each(spark, docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document."""
    importable(spark)
    return bpe_codec.encode_decode(spark, docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("BPE", encode),
]

#: Kernel scores, similarity components, alignments and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope():
            after = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
        docs = after
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
