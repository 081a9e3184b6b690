"""Benchmark decontamination by the q-gram lemma.

Texts and items are normalised (lower case; each run of characters other than letters and digits is one space).
An item is cut into overlapping segments of SEGMENT characters (the last one may be shorter than the stride; a short
item is one segment). An occurrence of a segment of length m with at most k = m * ERROR_RATE edits shares
m - q + 1 - k * q q-grams with it or more, and their diagonals (text position minus segment position) differ by k at
most. q is Q, or the largest one for which that bound is still 1 or more: m // (k + 1), which is 5 to 7 for some
segments under 32 characters. So shared q-grams are counted in bands of diagonals that overlap by half and are
2 * BAND wide (BAND >= k); bands that reach the bound are regions, and each region is verified by a banded alignment.
Items too short for any edit (under 1 / ERROR_RATE characters) are looked up exactly, as whole words.

Items are the query set: they are read in blocks of BLOCK_CHARS characters, each small enough to be broadcast, and
every block is matched with all documents. The q-gram hits of a text are counted in runs of about HITS with an
overlap that holds any occurrence, so a very long text needs no more memory than a short one.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import released, text_runs

Q = 8
ERROR_RATE = 0.1
SEGMENT = 120
BLOCK_CHARS = 4_000_000
HITS = 1 << 20
_TABLE: list[np.ndarray] = []
_FILTER_BITS = 20


def _kept() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _TABLE[0]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _kept()[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of each run of other characters stands for the run
    keep[:1] = word[:1]
    place = np.flatnonzero(keep)
    return np.where(word[place], codes[place], np.uint32(32)), place


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q characters from each position on."""
    base = np.uint64(0x9E3779B97F4A7C15)
    if q != 8:
        h = np.zeros(len(codes) - q + 1, np.uint64)
        for k in range(q):
            h = h * base + codes[k : len(codes) - q + 1 + k]
            h ^= h >> np.uint64(29)
        return h * base
    h, width = codes.astype(np.uint64), 1
    while width < q:
        h = h[:-width] * base + h[width:]
        base = (base ^ (base >> np.uint64(7))) | np.uint64(1)
        h ^= h >> np.uint64(29)
        width *= 2
    return h


class _Part:
    """Sorted q-grams of the segments that take one q."""

    def __init__(self, q: int, segments: list[int], codes: list[np.ndarray]):
        hashes = [grams(c, q) for c in codes]
        self.q, flat = q, np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.segment = np.repeat(np.array(segments, np.int64), [len(h) for h in hashes])[order]
        self.at = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        self.gram, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.gram >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, codes: np.ndarray):
        """(positions in the text, slots of their q-grams)."""
        h = grams(codes, self.q)
        pos = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.gram, h[pos]), len(self.gram) - 1)
        hit = self.gram[slot] == h[pos]
        return pos[hit], slot[hit]


class SegmentIndex:
    """Segments of a block of items, with sorted indexes of their q-grams, and the items that match as whole words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.codes, self.exact = [], [], {}
        for item, text in items:
            codes, _ = normalise(text or "")
            codes = codes[: len(codes) - (len(codes) > 0 and codes[-1] == 32)]
            if not len(codes):
                continue
            if int(len(codes) * ERROR_RATE) == 0:
                self.exact.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(item)
                continue
            last = max(0, len(codes) - SEGMENT)
            for begin in sorted({*range(0, last, SEGMENT // 2), last}):
                self.items.append(item)
                self.codes.append(codes[begin : begin + SEGMENT])
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = (self.length * ERROR_RATE).astype(np.int64)
        q = np.minimum(Q, self.length // (self.edits + 1))
        self.bound = self.length - q + 1 - self.edits * q
        self.band = int(max(8, self.edits.max(initial=0)))
        self.parts = [_Part(int(x), own, [self.codes[k] for k in own]) for x in np.unique(q) if (own := np.flatnonzero(q == x).tolist())]

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, lowest diagonal) of the bands in which a segment reaches its bound."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        reach = 2 * SEGMENT  # no occurrence is longer
        for part in self.parts:
            if len(codes) < part.q:
                continue
            pos, slot = part.hits(codes)
            total = np.concatenate(([0], np.cumsum(part.count[slot])))
            begin = 0
            while begin < len(pos):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS, "right")) - 1)
                if end < len(pos):
                    end = max(end, int(np.searchsorted(pos, pos[begin] + reach, "right")))
                found.append(self._bands(part, pos[begin:end], slot[begin:end]))
                if end >= len(pos):
                    break
                begin = max(begin + 1, int(np.searchsorted(pos, pos[end] - reach)))
        segment, low = (np.concatenate(x) for x in zip(*found))
        return segment, low

    def _bands(self, part: _Part, pos: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = part.count[slot]
        rows = np.repeat(part.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        segment = part.segment[rows]
        diagonal = np.repeat(pos, n) - part.at[rows] + 2 * SEGMENT  # above 0
        band = diagonal // self.band
        key = np.concatenate((segment * (1 << 40) + band, segment * (1 << 40) + band - 1))
        keys, counts = np.unique(key, return_counts=True)
        segment, band = keys >> 40, keys & ((1 << 40) - 1)
        good = keys[counts >= self.bound[segment]]
        if not len(good):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # of these, count each q-gram of the segment once: repetitive texts meet one again and again
        # keys are numbered densely before they are packed with the q-gram's place: both would not fit 64 bits
        number = np.minimum(np.searchsorted(good, key), len(good) - 1)
        inside = good[number] == key
        both = np.unique(number[inside] * 256 + np.concatenate((part.at[rows], part.at[rows]))[inside])
        number, counts = np.unique(both >> 8, return_counts=True)
        segment, band = good[number] >> 40, good[number] & ((1 << 40) - 1)
        good = counts >= self.bound[segment]
        return segment[good], band[good] * self.band - 2 * SEGMENT

    def whole_words(self, codes: np.ndarray):
        """(item, start, end) of the items that match exactly, as whole words."""
        if not self.exact or not len(codes):
            return
        raw, starts = codes.tobytes(), np.concatenate(([0], np.flatnonzero(codes == 32) + 1))
        for size, known in self.exact.items():
            own = starts[starts + size <= len(codes)]
            after = codes[np.minimum(own + size, len(codes) - 1)]
            for at in own[(own + size == len(codes)) | (after == 32)].tolist():
                for item in known.get(raw[4 * at : 4 * (at + size)], ()):
                    yield item, at, at + size

    def verify(self, codes: np.ndarray, segment: int, low: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best alignment in the band, or None beyond the edit budget."""
        want = self.codes[segment]
        k, m = int(self.edits[segment]), len(want)
        begin, end = max(0, low - k), min(len(codes), low + 2 * self.band + m + k)
        region = codes[begin:end]
        text, piece = region.tobytes(), want.tobytes()
        at = text.find(piece)
        while at >= 0 and at % 4:
            at = text.find(piece, at + 1)
        if at >= 0:
            return begin + at // 4, begin + at // 4 + m, 0
        found = banded(want, region, k)
        return None if found is None else (begin + found[0], begin + found[1], found[2])


def banded(want: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Best occurrence (start, end, edits) of ``want`` in ``region`` with at most k edits, by rows of the alignment.

    The region is as wide as the band of diagonals, so a row holds the band's cells.
    """
    n = len(region)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, c in enumerate(want, 1):
        step = np.concatenate(([i], np.minimum(cost[:-1] + (region != c), cost[1:] + 1)))
        came = np.concatenate(([0], np.where(cost[:-1] + (region != c) <= cost[1:] + 1, start[:-1], start[1:])))
        # insertions: running minimum of step - ramp
        shifted = step - ramp
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, ramp, 0))
        cost, start = low + ramp, came[source]
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(start[end]), end, int(cost[end])) if cost[end] <= k else None


def _blocks(items: DataFrame, limit: int):
    """Lists of (item_id, text) of about ``limit`` characters each, one at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(index: SegmentIndex, texts: list[str | None]):
    """(row, item, start, end, edits) of each matched segment; positions are in the lower-cased text."""
    for row, text in enumerate(texts):
        if not text:
            continue
        codes, place = normalise(text)
        for item, start, end in index.whole_words(codes):
            yield row, item, int(place[start]), int(place[end - 1]) + 1, 0
        segments, lows = index.regions(codes)
        seen = set()
        for segment, low in zip(segments.tolist(), lows.tolist()):
            match = index.verify(codes, segment, low)
            if match and (segment, match[0]) not in seen:
                seen.add((segment, match[0]))
                yield row, index.items[segment], int(place[match[0]]), int(place[match[1] - 1]) + 1, match[2]


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each document and item that match.

    ``start`` and ``end`` span all matched segments of the item (characters of the lower-cased text), ``edits`` is
    the largest of a segment. Items without letters and digits match nothing, items of fewer than 1 / ERROR_RATE
    normalised characters match exactly, as whole words; null or empty texts hold nothing. Rows that repeat a doc_id
    count as one document, items that repeat an item_id as one item. Other columns are not read.
    """
    out = None
    kinds = "doc_id long, item_id long, start long, end long, edits long"
    for block in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(SegmentIndex(block))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for start, texts in text_runs(batch, "text"):
                    rows = [(doc_ids[start + r], *rest) for r, *rest in _found(index, texts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], kinds)
    return out.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("edits").alias("edits"))


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs."""
    for block in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(SegmentIndex(block))
        at = docs.columns.index("text")

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                bad = {row for row, *_ in _found(index, batch.column(at).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
