"""Line dedup by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last WINDOW line hashes ends a chunk where it is 0 modulo TARGET, so
boundaries depend on nearby lines only and survive shifts. A chunk counts when MIN_LINES of its lines or more hold
more than spaces. Chunks whose bytes occur more than once in the corpus are repeats: the first occurrence (smallest
doc_id, then text hash, then position) stays, the others go, and the chunks left are joined by newlines again.

Hashes only group candidates. Of each group the smallest and the largest chunk are kept; where they are equal, all
bytes are, which is the comparison, and groups where they differ are split by their bytes.

DataFrame operations only. Groups are combined in each task before they are shuffled, so a chunk that a third of
all documents hold costs a row a task. Both joins are sort-merge joins at every size (their right sides grow with
the corpus); Spark splits them when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

WINDOW = 2
TARGET = 3
MIN_LINES = 2
_BASE = 31
#: Position that stands for all chunks of a text.
WHOLE = -1


def with_chunks(docs: DataFrame, window: int = WINDOW, target: int = TARGET) -> DataFrame:
    """``docs`` with a column _chunks: strings that joined by newlines give the text back; null for a null text."""
    rolling = " + ".join(f"IF(i >= {k}, _h[greatest(i - {k}, 0)], 0) * {_BASE ** k}" for k in range(window))
    hashed = docs.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_h", F.expr("transform(_lines, x -> CAST(conv(left(md5(x), 8), 16, 10) AS BIGINT))"))
    # line counts after which a chunk ends; the text's last line ends one always
    cuts = f"array_distinct(concat(filter(transform(_h, (x, i) -> IF(({rolling}) % {target} = 0, i + 1, 0)), p -> p > 0), array(size(_lines))))"
    cut = hashed.withColumn("_cuts", F.expr(cuts))
    begin = "IF(k = 0, 0, _cuts[greatest(k - 1, 0)])"
    return cut.withColumn("_chunks", F.expr(f"transform(_cuts, (c, k) -> array_join(slice(_lines, {begin} + 1, c - {begin}), '\n'))")).drop("_lines", "_h", "_cuts")


def occurrences(docs: DataFrame, window: int = WINDOW, target: int = TARGET, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text_hash, pos, chunk, chunk_hash of every chunk that counts."""
    several = docs.where("instr(text, '\n') > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # outer: the filter that Spark infers below an inner one would compute the chunks anew, once a reference
    parts = with_chunks(several, window, target).select("doc_id", "text_hash", F.posexplode_outer("_chunks").alias("pos", "chunk"))
    solid = F.expr(f"size(filter(split(chunk, '\n', -1), x -> trim(x) <> '')) >= {min_lines}")
    return parts.where(F.instr("chunk", "\n") > 0).where(solid).withColumn("chunk_hash", F.xxhash64("chunk"))


def _later(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id, text_hash, pos of every chunk that is not the first of its bytes."""
    place = F.struct("doc_id", "text_hash", "pos")
    grouped = found.groupBy("chunk_hash").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    groups = scratch.write(grouped.where("n > 1").select("chunk_hash", "first", (F.col("low") == F.col("high")).alias("same")), name)
    equal = groups.where("same").select("chunk_hash", "first")
    gone = found.select("doc_id", "text_hash", "pos", "chunk_hash").join(equal.hint("merge"), "chunk_hash").where(~place.eqNullSafe(F.col("first")))
    gone = gone.select("doc_id", "text_hash", "pos")
    if groups.where("NOT same").head(1):  # one hash for different chunks
        clash = found.join(groups.where("NOT same").select("chunk_hash"), "chunk_hash", "left_semi")
        split = clash.groupBy("chunk_hash", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
        more = clash.join(split, ["chunk_hash", "chunk"]).where(~place.eqNullSafe(F.col("first")))
        gone = gone.unionByName(more.select("doc_id", "text_hash", "pos"))
    return gone


def whole_texts(docs: DataFrame) -> DataFrame:
    """The columns of ``occurrences``, each text of several lines as one chunk at position WHOLE."""
    several = docs.where("instr(text, '\n') > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return several.select("doc_id", "text_hash", F.lit(WHOLE).alias("pos"), F.col("text").alias("chunk"), F.col("text_hash").alias("chunk_hash"))


def repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """doc_id, text_hash, removed (array of chunk positions): the occurrences to remove, exact by bytes.

    With ``whole``, WHOLE is among the positions of each text that an earlier document holds byte for byte.
    """
    gone = _later(occurrences(docs), scratch, "groups")
    if whole:  # written: the shuffle files of the texts go before those of the chunks come
        gone = gone.unionByName(scratch.write(_later(whole_texts(docs), scratch, "texts"), "copies"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("removed"))


def dedup_lines(spark: SparkSession, docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and columns n_chunks and n_removed (int).

    Null and one-line texts stay as they are (n_chunks 0 for null). Rows that repeat a doc_id and text count as one
    document. A document of which nothing is left has the empty text. Other columns pass through, whatever their
    names; only ``n_chunks`` and ``n_removed`` are replaced. With ``whole``, texts of several lines that an earlier
    document holds byte for byte lose all chunks, also those that alone would not count. An empty table gives an empty
    result.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_chunks", "n_removed")]
    scratch = Scratch(spark, "lines")
    gone = scratch.write(repeats(spark, docs, scratch, whole), "gone").toDF("_id", "_hash", "_removed")
    # the input's other columns travel in one struct, so no name of theirs meets one of ours
    others = F.struct(*(F.col(f"`{c}`") for c in names if c.lower() != "text"), F.lit(0)).alias("_row")
    keyed = docs.select(others, F.col("text").alias("text"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_hash0"))
    joined = keyed.join(gone.hint("merge"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash0") == F.col("_hash")), "left")
    cut = with_chunks(joined)
    copied = F.coalesce(F.array_contains("_removed", WHOLE), F.lit(False))
    kept = F.when(copied, "").otherwise(F.expr("array_join(filter(_chunks, (c, k) -> NOT array_contains(_removed, k)), '\n')"))
    n_removed = F.when(copied, F.size("_chunks")).otherwise(F.coalesce(F.size("_removed"), F.lit(0)))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)
    out = [text.alias(c) if c.lower() == "text" else F.col("_row").getField(c).alias(c) for c in names]
    return cut.select(*out, F.coalesce(F.size("_chunks"), F.lit(0)).alias("n_chunks"), n_removed.alias("n_removed"))
