"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table


def op1_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the hashed n-gram likelihood ratio, on every document."""
    from .quality_rules import quality

    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of nearly equal bytes, through the slot map."""
    from .sharding import assign

    return assign(spark, table(spark, sf_dir, "documents"), 8)


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the folds that the model never saw are marked."""
    from .language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = predict(spark, docs, fit(docs))
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks, as figures and the md5 of the text left."""
    from .line_chunks import dedup_lines

    out = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chunks", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document; ``fit_bytes`` is what the 512-token budget keeps of it."""
    from .token_counts import token_budget

    out = token_budget(table(spark, sf_dir, "documents"), 512)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_bytes")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document as a framed token record, read the files back and digest what they hold."""
    from .token_records import read_digests, write_records

    directory = Scratch(spark, "records").path("tokens")
    write_records(table(spark, sf_dir, "documents"), directory)
    return read_digests(spark, directory)


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document through the transducer lexicon."""
    from .bpe_codec import encode_decode_digests

    return encode_decode_digests(spark, table(spark, sf_dir, "documents"))


def op5_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else."""
    from .repeat_spans import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from .jaccard_join import similar_components

    return similar_components(spark, table(spark, sf_dir, "documents"), 4, 85)


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that match within the edit budget."""
    from .decontaminate import matches

    return matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_ratio, op2_virtual_slots, op3_language_kernel, op4_line_chunks, op5_repeat_spans, op6_signature_tree_join, op7_prefix_token_counts, op8_token_records, op9_transducer_bpe, op10_benchmark_leaks)}


_OP4_SQL = """
WITH lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT doc_id, text, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM lined
), ends AS (
  SELECT doc_id, text, ls, [i FOR i IN range(1, len(ls) + 1)
         IF i = len(ls) OR (h[i] + CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END * 31) % 3 = 0] AS cuts FROM hashed
), chunks AS (
  SELECT doc_id, text, UNNEST(range(1, len(cuts) + 1)) AS k, cuts, ls FROM ends
), pieces AS (
  SELECT doc_id, k, array_to_string(list_slice(ls, CASE WHEN k = 1 THEN 1 ELSE cuts[k - 1] + 1 END, cuts[k]), chr(10)) AS c FROM chunks
), solid AS (
  SELECT doc_id, k, c, len(list_filter(string_split(c, chr(10)), lambda x: trim(x) <> '')) >= 2 AS counts FROM pieces
), marked AS (
  SELECT doc_id, k, c, counts AND row_number() OVER (PARTITION BY c, counts ORDER BY doc_id, k) > 1 AS gone FROM solid
)
SELECT doc_id, count(*)::INTEGER AS n_chunks, (count(*) FILTER (WHERE gone))::INTEGER AS n_removed,
       strlen(coalesce(string_agg(c, chr(10) ORDER BY k) FILTER (WHERE NOT gone), ''))::BIGINT AS kept_bytes,
       md5(coalesce(string_agg(c, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_chunks": _OP4_SQL}
