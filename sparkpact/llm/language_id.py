"""Language identification by a string kernel.

A document is the set of its character n-grams of lengths 1 to 3 (blended spectrum, presence only), taken over
lower-cased letters with one space between words and hashed into DIMENSIONS buckets. The kernel of two documents is
the correlation of their presence vectors: the cosine after each row's mean is taken off, so that long texts, which
fill many buckets, are not alike for that alone. A bounded sample of labelled documents gives Nystroem landmarks (the first of
each language by hash) and training rows; one-versus-rest ridge regression in the landmark space learns one
coefficient vector a language. Whole texts are scored in batches: presence rows times landmarks gives the kernel
matrix, and that times the coefficients gives the scores.

Bounds (parameters): PER_LANGUAGE training rows and LANDMARKS_PER_LANGUAGE landmarks of each language.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import released, text_runs

DIMENSIONS = 1 << 13
PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
UNDETERMINED = "und"
#: Least scores of an identified language. On 10,000 documents of four languages those with 150 n-grams or more score
#: 0.45 at least and shorter ones 0.13; random letters score 0.33 at most below 150 n-grams and 0.25 from there on,
#: texts in unseen scripts 0.11 at any length.
MIN_SCORE, FULL_SCORE, FULL_GRAMS = 0.12, 0.35, 150
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


def presence(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Sorted buckets of the n-grams that occur in a text; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    # one space for each run of other characters, and one at either end
    padded = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    blank = padded == 32
    padded = padded[~(blank & np.concatenate(([False], blank[:-1])))]
    one = padded * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    met = np.zeros(dimensions, bool)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    for gram, salt in ((one, 0x27D4EB2F), (two, 0x165667B1), (three, 0x2545F491)):
        met[((gram ^ (gram >> np.uint32(16))) * np.uint32(salt)) >> shift] = True
    return np.flatnonzero(met)


def centred(rows: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Presence rows with mean 0 and length 1."""
    x = np.zeros((len(rows), dimensions), np.float32)
    for k, row in enumerate(rows):
        x[k] = -len(row) / dimensions
        x[k, row] += 1
        x[k] /= _spread(row, dimensions)
    return x


def _spread(row: np.ndarray, dimensions: int) -> float:
    return float(np.sqrt(max(len(row) * (1 - len(row) / dimensions), 0.5)))


class KernelModel:
    """Landmark rows (mean 0, unit length), and coefficients of landmark kernels for each language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.landmarks, self.coefficients = languages, landmarks, coefficients

    @classmethod
    def fit(cls, rows: list[np.ndarray], langs: list[str], is_landmark: list[bool], dimensions: int = DIMENSIONS, ridge: float = RIDGE) -> KernelModel:
        languages = sorted(set(langs))
        x = centred(rows, dimensions)
        if not languages:
            return cls([], np.zeros((0, dimensions), np.float32), np.zeros((0, 0), np.float32))
        marks = x[np.array(is_landmark, bool)]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        kept = values > 1e-6 * values[-1]
        root = vectors[:, kept] / np.sqrt(values[kept])  # Nystroem map: kernel row @ root
        phi = (x @ marks.T).astype(np.float64) @ root
        y = np.array([[float(a == b) for b in languages] for a in langs])
        # each language weighs the same, however many rows it has
        weight = 1 / y.sum(0)[[languages.index(a) for a in langs]]
        gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) * weight.mean()
        beta = np.linalg.solve(gram, (phi * weight[:, None]).T @ y)
        return cls(languages, marks, (root @ beta).astype(np.float32))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        dimensions = self.landmarks.shape[1]
        x = np.zeros((len(rows), dimensions), np.float32)
        for k, row in enumerate(rows):
            x[k, row] = 1 / _spread(row, dimensions)  # landmarks have mean 0, so a row's own mean adds nothing
        return (x @ self.landmarks.T) @ self.coefficients


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang, text: the bounded sample, the ``per_language`` documents of each language with the smallest hash.

    Only documents of the training folds (crc32 of the doc_id text, modulo 4, not 2) with a language and a text. Rows
    that repeat a doc_id and language are one document; of several texts the smallest hash stands for it. Repeats are
    combined in each task before the shuffle, and the rank limit is applied before the sample is sent on.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("th"), "text")
    ids = rows.groupBy("lang", "doc_id").agg(F.min("th").alias("th"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = ids.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    met = rows.join(F.broadcast(sample), ["lang", "doc_id", "th"], "left_semi")
    return met.dropDuplicates(["lang", "doc_id"]).select("doc_id", "lang", "text")


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> KernelModel:
    """Presence sets are made on the executors; the driver gets at most ``per_language`` sets of a language. The first
    ``landmarks`` of them that have letters are landmarks; a language without letters is not learned."""

    def features(batches):
        for batch in batches:
            rows = [presence(t, dimensions) for t in batch.column(2).to_pylist()]
            packed = [None if r is None else r.astype("<u2").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "grams"])

    rows = training_rows(docs, per_language).mapInArrow(features, "doc_id long, lang string, grams binary").where("grams IS NOT NULL")
    order = rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "grams").collect()
    order = sorted((r.lang, r.h, r.doc_id, bytes(r.grams)) for r in order)
    langs = [r[0] for r in order]
    first = {lang: k for k, lang in reversed(list(enumerate(langs)))}
    return KernelModel.fit([np.frombuffer(r[3], "<u2").astype(np.int64) for r in order], langs, [k - first[lang] < landmarks for k, lang in enumerate(langs)], dimensions)


def predict(spark: SparkSession, docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; ``und`` with score 0 for null texts and texts without letters.

    Repeated rows give repeated results, ties go to the alphabetically first language, other columns are not read.
    A model without languages answers ``und`` everywhere.
    """
    shared = spark.sparkContext.broadcast(model)
    dimensions = model.landmarks.shape[1]

    def run(batches):
        own = shared.value
        for batch in batches:
            doc_ids = batch.column(0)
            for start, texts in text_runs(batch, "text"):
                rows = [presence(t, dimensions) if own.languages else None for t in texts]
                known = [k for k, r in enumerate(rows) if r is not None]
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                for low in range(0, len(known), 512):
                    part = known[low : low + 512]
                    scored = own.scores([rows[k] for k in part])
                    best = scored.argmax(1)
                    score[part] = np.clip(scored[np.arange(len(part)), best], 0, 1)
                    for k, b in zip(part, best.tolist()):
                        lang[k] = own.languages[b]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(texts)), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, model: KernelModel, min_score: float = MIN_SCORE, full_score: float = FULL_SCORE, full_grams: int = FULL_GRAMS) -> DataFrame:
    """The documents, all columns, whose language is identified: with ``min_score`` or more, or ``full_score`` or more
    where a document has ``full_grams`` n-grams to judge by. Null texts and texts without letters go."""
    shared = spark.sparkContext.broadcast(model)
    dimensions, at = model.landmarks.shape[1], docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            rows = [presence(t, dimensions) for t in batch.column(at).to_pylist()]
            keep = np.zeros(len(rows), bool)
            known = [k for k, r in enumerate(rows) if r is not None]
            for low in range(0, len(known), 512):
                part = known[low : low + 512]
                need = np.array([full_score if len(rows[k]) >= full_grams else min_score for k in part])
                keep[part] = own.scores([rows[k] for k in part]).max(1) >= need if own.languages else True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)
