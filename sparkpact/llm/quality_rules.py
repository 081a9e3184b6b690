"""Quality rules: base rules, then the log-likelihood ratio of hashed n-grams between two multinomials.

One multinomial is of trusted documents, the other of the raw corpus. Words (lower-cased) and word pairs are hashed
into a fixed number of buckets. A bucket's weight is log((trusted + k) / (expected + k)), where ``expected`` is what
the trusted n-grams would hold if they followed the raw multinomial; the pseudo-count k leaves rare buckets near 0.
A document's score is the mean weight of its n-grams (so its length doesn't count), and one fixed threshold decides.

Raw counts cover every document. The trusted multinomial is fitted on a bounded sample of labelled documents
(quality 1, not toxic): the TRUSTED_ROWS of them with the smallest hash of their doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import text_runs

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
PSEUDO_COUNT = 5.0
THRESHOLD = -0.05
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_VOCABULARY = 1 << 18


class _Words(dict):
    """word (bytes) -> small integer; ``hashes`` has the hash of each word's lower-cased form."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word.decode("utf-8", "replace").lower()))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class NgramReader:
    """Word ids of texts, and the buckets of their words and word pairs."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.words = _Words()

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > _VOCABULARY:
            self.words = _Words()
        get = self.words.__getitem__
        out = []
        for t in texts:
            split = t.encode().split() if t else []  # bytes split at exactly space and \x09-\x0D
            out.append(np.fromiter(map(get, split), np.int64, len(split)))
        self.table = np.array(self.words.hashes, np.uint64)
        return out

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Bucket of each word, then of each pair of neighbours."""
        h = self.table[ids]
        pairs = _mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
        return (np.concatenate((_mix(h), pairs)) % self.buckets).astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    _, small = np.unique(ids, return_inverse=True)
    n = int(small.max()) + 1
    if n < 1 << 21:
        key = (small[:-2] * n + small[1:-1]) * n + small[2:]
    else:
        _, pairs = np.unique(small[:-1] * n + small[1:], return_inverse=True)
        key = pairs[:-1] * n + small[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


def base_figures(text: str | None, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.encode().strip()] if "\n" in text else []
    return len(ids), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of the trusted sample: at most ``rows`` labelled documents, by hash, so any run takes the same."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, trusted: n-gram counts over all documents and over the trusted sample.

    Each task sends one row for every bucket it met; ``trusted`` is bounded, so it may be broadcast.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("is_trusted", F.lit(True))), "doc_id", "left")

    def count(batches):
        reader = NgramReader(buckets)
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flags = batch.column(0).to_pylist()
            for start, texts in text_runs(batch, "text"):
                ids = reader.ids(texts)
                grams = [reader.grams(x) if len(x) else x for x in ids]
                raw += np.bincount(np.concatenate(grams), minlength=buckets)
                if chosen := [g for k, g in enumerate(grams) if flags[start + k]]:
                    good += np.bincount(np.concatenate(chosen), minlength=buckets)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(good[met])], ["bucket", "raw", "trusted"])

    counted = marked.select("is_trusted", "text").mapInArrow(count, "bucket long, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def bucket_weights(counts: DataFrame, buckets: int = BUCKETS, pseudo_count: float = PSEUDO_COUNT) -> np.ndarray:
    """log-ratio weight of each bucket; ``counts`` has at most one row a bucket. Zeros without trusted n-grams."""
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row.bucket], good[row.bucket] = row.raw, row.trusted
    if not good.sum():
        return np.zeros(buckets)
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + pseudo_count) / (expected + pseudo_count))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, base figures, base_failed, score, kept of every document.

    Null or empty text: no words, base_failed, score 0. Without trusted documents every score is 0 and the base
    rules decide alone. Repeated rows give repeated results; other columns are not read.
    """
    weights = spark.sparkContext.broadcast(bucket_weights(gram_counts(docs, trusted_ids(labels), buckets), buckets))

    def score(batches):
        reader, weight = NgramReader(buckets), weights.value
        for batch in batches:
            doc_ids = batch.column(0)
            for start, texts in text_runs(batch, "text"):
                ids = reader.ids(texts)
                figures = np.array([base_figures(t, x) for t, x in zip(texts, ids)], np.int64).reshape(-1, 5)
                scores = np.array([weight[reader.grams(x)].mean() if len(x) else 0.0 for x in ids])
                failed = (figures[:, 0] < 50) | (100 * figures[:, 4] > 50 * figures[:, 0])
                columns = [pa.array(figures[:, k]) for k in range(5)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(texts)), *columns, pa.array(failed), pa.array(~failed & (scores >= threshold)), pa.array(scores)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    kinds = ["long"] * 6 + ["boolean"] * 2 + ["double"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
