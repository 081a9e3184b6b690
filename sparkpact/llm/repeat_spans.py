"""Exact removal of byte strings of LENGTH bytes that occur more than once, by local enhanced suffix arrays.

Every window of LENGTH bytes holds an anchor: the smallest hash of its GRAM-byte strings. Equal windows have equal
anchors at equal places, so only suffixes that start at an anchor need sorting, and only together with those of the
same anchor string. A context is what windows around the anchor can reach: up to LENGTH - GRAM bytes before it and
LENGTH from it on.

1. One scan gives every anchor with a digest of its context. Equal contexts are combined and carry their count: they
   are equal strings of the suffix array, and one of them stands for all.
2. For anchors with different contexts, the contexts are sorted by the bytes from the anchor on (a sparse suffix
   array), neighbours give common prefixes, and a stack scan gives the tree of common-prefix intervals. In an
   interval of depth r, members repeat with those whose left extensions agree for LENGTH - r bytes; extensions that
   differ beyond that end the repeat (left diversity). The same scan from the left bounds the other end. All members
   of an interval count, not just neighbours; a context that counts more than once repeats as a whole.
3. An anchor with more than MANY different contexts (a passage that a large share of all documents hold) does not fit
   one task; it is split by its windows instead: their digests are counted across tasks.
4. Spans are joined a document and cut out. ``repeat_groups`` gives the intervals themselves: every maximal repeat
   with all of its occurrences.
5. Beside the removal, ``shared_runs`` finds runs of more than 50 words that another document holds, of whatever bytes.

Different contexts are compared by their bytes, equal ones are combined by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, Seen, by_group, released, text_runs

LENGTH, GRAM = 400, 64
MANY = 50_000
CELL = 48
FILTER_BITS = 25
WORDS, WORD_GRAM, PLACE_WINDOWS = 51, 8, 20


# ---------------------------------------------------------------- anchors

def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, values[-1], values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows of ``length`` bytes; ``gram`` is a power of two."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1
    base = np.uint64(0x9E3779B97F4A7C15)
    while width < gram:
        h = h[:-width] * base + h[width:]
        h ^= h >> np.uint64(31)
        base = (base ^ (base >> np.uint64(9))) | np.uint64(1)
        width *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    reach = length - gram + 1
    low = _slide(h, reach, np.minimum)  # of each window
    edge = np.zeros(reach - 1, np.uint64)
    best = _slide(np.concatenate((edge, low, edge)), reach, np.maximum)  # largest minimum of the windows around each position
    at = np.flatnonzero(best == h)
    return at, h[at]


# ---------------------------------------------------------------- one anchor's contexts

def intervals(common: list[int], n: int):
    """(depth, first, last) of the common-prefix intervals of n sorted strings; common[i] is shared by i and i + 1."""
    stack = [(0, 0)]  # depth, first
    for i in range(n):
        depth = common[i] if i < n - 1 else 0
        first = i
        while stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if stack[-1][0] < depth:
            stack.append((depth, first))


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] == b[:low] always
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _reach(own: list[bytes], other: list[bytes], counts: list[int], length: int) -> list[int]:
    """For each member the most bytes of ``own`` in a repeated window; both sides are read outward from the anchor."""
    n = len(own)
    order = sorted(range(n), key=own.__getitem__)
    common = [_shared(own[order[i]], own[order[i + 1]]) for i in range(n - 1)]
    best = [len(x) if c > 1 and len(x) + len(y) >= length else 0 for x, y, c in zip(own, other, counts)]
    for depth, first, last in intervals(common, n):
        need = length - depth
        if need <= 0:
            for k in order[first : last + 1]:
                best[k] = max(best[k], length)
            continue
        if all(best[k] >= depth for k in order[first : last + 1]):
            continue  # as most members of a wide interval have met in a deeper one
        met: dict[bytes, int] = {}
        members = [(k, other[k][:need]) for k in order[first : last + 1] if len(other[k]) >= need]
        for k, x in members:
            if x in met:
                if best[k] < depth:
                    best[k] = depth
                if best[met[x]] < depth:
                    best[met[x]] = depth
            else:
                met[x] = k
    return best


def repeated_reach(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(left, right) bytes around the anchor that repeated windows cover, for different contexts; (0, 0): none.

    ``lefts`` are reversed, so both sides start at the anchor. ``counts``: how often each context occurs.
    """
    right = _reach(rights, lefts, counts, length)
    left = _reach(lefts, rights, counts, length) if any(right) else right
    # a window that covers no byte before the anchor: left 0 is right for these
    return [(x, min(y, length)) for x, y in zip(left, right)]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int = LENGTH):
    """(left, right, members) of every repeat of ``length`` bytes or more around one anchor that no longer one of the
    same members holds, within the contexts.

    A context that occurs more than once is two equal strings of the suffix array. Each interval of the right sides is
    taken with each interval of its members' left sides; the pair is put out where the members have no more bytes in
    common on the right (they would belong to a deeper interval).
    """
    order = sorted((k for k, c in enumerate(counts) for _ in range(min(c, 2))), key=rights.__getitem__)
    common = [_shared(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for depth, first, last in intervals(common, len(order)):
        members = sorted(range(first, last + 1), key=lambda i: lefts[order[i]])
        shared = [_shared(lefts[order[a]], lefts[order[b]]) for a, b in zip(members, members[1:])]
        # the whole interval is one of its left intervals, with what all have in common
        for left, i, j in {(min(shared), 0, len(members) - 1), *intervals(shared, len(members))}:
            own = members[i : j + 1]
            if left + depth >= length and min(common[min(own) : max(own)]) == depth:
                yield left, depth, sorted({order[x] for x in own})


# ---------------------------------------------------------------- Spark

def _marked(spark: SparkSession, rows: DataFrame):
    """Broadcast bit array of fixed size that holds a long column's values (and lets some others pass)."""

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    merged = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in rows.coalesce(6).mapInArrow(mark, "bits binary").toLocalIterator():
        merged |= np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(merged.tobytes())


def _slots(values: np.ndarray) -> np.ndarray:
    h = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _among(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = _slots(values)
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of every text, and digests of their contexts."""
    side = length - gram

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for start, texts in text_runs(batch, "text", 1 << 20):
                rows, place, digests = [], [], bytearray()
                for k, t in enumerate(texts):
                    raw = t.encode()
                    at, h = anchors(raw, length, gram)
                    before, after = np.minimum(at, side), np.minimum(len(raw) - at, length)
                    for p, b, a in zip(at.tolist(), before.tolist(), after.tolist()):
                        digests += xxhash.xxh3_128_digest(raw[p - b : p + a], seed=b)
                    rows.append(np.full(len(at), start + k))
                    place.append((at, h.view(np.int64), before, after))
                row = pa.array(np.concatenate(rows))
                at, h, before, after = (np.concatenate(x) for x in zip(*place))
                digest = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.take(row), hashes.take(row), pa.array(at.astype(np.int32)), pa.array(h), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))], names)

    kinds = "doc_id long, th long, pos int, anchor long, c1 long, c2 long, before short, after short"
    names = [k.split()[0] for k in kinds.split(", ")]
    return _keyed(docs).where(F.octet_length("text") >= length).mapInArrow(run, kinds)


def _texts_of(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, th, ...; one row a text) with the text. Rows that repeat a doc_id and text come once a task.

    A bit array of fixed size keeps most other texts from being sent; the join decides, so where the array is full
    every text is sent once and no more.
    """
    bits = _marked(spark, wanted.select("th"))

    def chosen(batches):
        marked, seen = np.frombuffer(bits.value, np.uint8), Seen()
        for batch in batches:
            ids, th = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = _among(marked, th)
            for k in np.flatnonzero(keep).tolist():
                keep[k] = seen.new((ids[k], int(th[k])))
            yield batch.filter(pa.array(keep))

    part = _keyed(docs).where("text IS NOT NULL").mapInArrow(chosen, "doc_id long, th long, text string")
    others = [c for c in wanted.columns if c not in ("doc_id", "th")]
    return part.join(wanted.hint("merge"), _same(part, wanted)).select(part["doc_id"], part["th"], "text", *others)


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _contexts(spark: SparkSession, docs: DataFrame, contexts: DataFrame, several: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """anchor, c1, c2, n, n_contexts, lefts (reversed), rights: each context once (or once a task, where rows repeat)
    of the anchors that have several, read at the place that stands for it."""
    side = length - gram
    rows = contexts.join(several.hint("merge"), "anchor")
    places = rows.groupBy("place.doc_id", "place.th").agg(F.collect_list(F.struct("place.pos", "anchor", "c1", "c2", "n", "n_contexts")).alias("places"))
    met = _texts_of(spark, docs, scratch.write(places, "places")).select("text", "places")

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(0)[row].as_py().encode()
                # one text's contexts are a few times its size
                own = batch.column(1).slice(row, 1).flatten().flatten()
                at = own[0].to_pylist()
                left = pa.array([raw[max(0, p - side) : p][::-1] for p in at], pa.binary())
                right = pa.array([raw[p : p + length] for p in at], pa.binary())
                yield pa.RecordBatch.from_arrays([*own[1:], left, right], names)

    names = ["anchor", "c1", "c2", "n", "n_contexts", "lefts", "rights"]
    return met.mapInArrow(cut, "anchor long, c1 long, c2 long, n long, n_contexts long, lefts binary, rights binary")


class _Found:
    """Tables of one run: found (every anchor), contexts (each with its count), solved (bytes of the anchors with
    several contexts)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int, gram: int):
        self.found = scratch.write(_scan(docs, length, gram), "found")
        place = F.min(F.struct("doc_id", "th", "pos")).alias("place")
        grouped = self.found.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), place, F.first("before").alias("before"), F.first("after").alias("after"))
        self.contexts = scratch.write(grouped, "contexts")
        several = scratch.write(self.contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"), "several")
        self.bytes = _contexts(spark, docs, self.contexts, several, scratch, length, gram)


def _once(group: dict) -> tuple[list, list, list, list]:
    """(c1, c2) pairs, lefts, rights, counts of a group's contexts, each once, in a fixed order."""
    unique = {(x, y): rest for x, y, *rest in zip(group["c1"], group["c2"], group["lefts"], group["rights"], group["n"])}
    keys = sorted(unique)
    return keys, *([unique[k][i] for k in keys] for i in range(3))


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """doc_id, th (hash of the text), spans: array of (start, stop), which overlap, of repeated bytes."""
    own = _Found(spark, docs, scratch, length, gram)
    columns = [(n, pa.int64(), "long") for n in ("anchor", "c1", "c2")] + [(n, pa.int16(), "short") for n in ("l", "r")]

    def solve(group: dict) -> list[tuple]:
        keys, lefts, rights, counts = _once(group)
        reach = repeated_reach(lefts, rights, counts, length)
        return [(group["anchor"][0], c1, c2, x, y) for (c1, c2), (x, y) in zip(keys, reach) if x + y >= length]

    bytes_of = scratch.write(own.bytes, "bytes")
    crowded = F.col("n_contexts") > many
    solved = by_group(bytes_of.where(~crowded).drop("n_contexts"), ["anchor"], solve, columns)
    solved = solved.unionByName(_by_windows(bytes_of.where(crowded).drop("n_contexts"), length, gram))
    # an anchor with one context needs no sorting: its only interval is the context, as often as it counts
    alone = own.contexts.join(bytes_of.select("anchor").distinct().hint("merge"), "anchor", "left_anti").where((F.col("n") > 1) & (F.col("before") + F.col("after") >= length))
    verdict = scratch.write(alone.select("anchor", "c1", "c2", F.col("before").alias("l"), F.col("after").alias("r")).unionByName(solved), "verdicts")
    spans = own.found.join(verdict.hint("merge"), ["anchor", "c1", "c2"]).select("doc_id", "th", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"))
    out = scratch.write(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    for name in ("found", "contexts", "several", "places", "bytes", "verdicts"):
        scratch.drop(name)
    return out


def repeat_groups(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """group (hex), anchor, doc_id, start, n_bytes, n_occurrences: maximal repeats of ``length`` bytes or more, a row an
    occurrence.

    A group holds all places of one byte string in the corpus that cannot be longer without losing a place, as far as
    the contexts of its anchor reach; a longer repeat is a chain of such groups, one for each of its anchors. An
    anchor's different contexts are held in one task. Rows that repeat a doc_id and text are each an occurrence.
    """
    scratch = Scratch(spark, "repeats")
    own = _Found(spark, docs, scratch, length, gram)
    columns = [("anchor", pa.int64(), "long"), ("number", pa.int64(), "long"), ("c1", pa.int64(), "long"), ("c2", pa.int64(), "long"), ("l", pa.int16(), "short"), ("r", pa.int16(), "short")]

    def solve(group: dict) -> list[tuple]:
        keys, lefts, rights, counts = _once(group)
        # a string that only a longer window made an anchor of has places without it: another anchor lists them all
        own = lambda x, y, k: x in anchors(lefts[k][:x][::-1] + rights[k][:y], length, gram)[0]
        found = [f for f in maximal_repeats(lefts, rights, counts, length) if own(f[0], f[1], f[2][0])]
        return [(group["anchor"][0], k, *keys[m], x, y) for k, (x, y, members) in enumerate(found) for m in members]

    bytes_of = scratch.write(own.bytes, "bytes")
    solved = by_group(bytes_of.drop("n_contexts"), ["anchor"], solve, columns)
    alone = own.contexts.join(bytes_of.select("anchor").distinct().hint("merge"), "anchor", "left_anti").where((F.col("n") > 1) & (F.col("before") + F.col("after") >= length))
    alone = alone.select("anchor", F.lit(0).cast("long").alias("number"), "c1", "c2", F.col("before").alias("l"), F.col("after").alias("r"))
    members = scratch.write(alone.unionByName(solved), "members")
    counts = members.join(own.contexts.select("anchor", "c1", "c2", "n").hint("merge"), ["anchor", "c1", "c2"]).groupBy("anchor", "number").agg(F.sum("n").alias("n_occurrences"))
    placed = own.found.join(members.hint("merge"), ["anchor", "c1", "c2"]).join(scratch.write(counts, "counts").hint("merge"), ["anchor", "number"])
    name = F.concat(F.hex("anchor"), F.lit("-"), F.col("number"))
    return placed.select(name.alias("group"), "anchor", "doc_id", (F.col("pos") - F.col("l")).cast("long").alias("start"), (F.col("l") + F.col("r")).cast("long").alias("n_bytes"), "n_occurrences")


def _by_windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The verdicts of anchors with very many contexts, by digests that are counted across tasks.

    Windows with j bytes before the anchor, low <= j < low + CELL, share ``low`` bytes before it and
    length - low - CELL from it on, so a cell in which a context stands alone needs no window.
    """

    def digest_rows(batches, cells: bool):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, right, low = row["lefts"], row["rights"], row.get("low")
                span = range(0, length - gram + 1, CELL) if cells else range(low, min(low + CELL, length - gram + 1))
                for j in span:
                    need = max(gram, length - j - CELL) if cells else length - j
                    if j <= len(left) and need <= len(right):
                        out.append((row["anchor"], row["c1"], row["c2"], row["n"], j, xxhash.xxh3_128_digest(left[:j] + right[:need])))
            if out:
                a, c1, c2, n, j, f = zip(*out)
                g = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(j, pa.int32()), pa.array(g[:, 0]), pa.array(g[:, 1])], ["anchor", "c1", "c2", "n", "j", "f1", "f2"])

    kinds = "anchor long, c1 long, c2 long, n long, j int, f1 long, f2 long"
    own = texts.dropDuplicates(["anchor", "c1", "c2"])
    # one anchor at one distance: a window with two anchors must not meet itself
    same, context = ["anchor", "j", "f1", "f2"], ["anchor", "c1", "c2"]

    def shared(rows):
        again = rows.groupBy(*same).agg(F.sum("n").alias("times")).where("times > 1").drop("times")
        return rows.join(again.hint("merge"), same)

    cells = shared(own.mapInArrow(lambda b: digest_rows(b, True), kinds)).select(*context, F.col("j").alias("low"))
    windows = own.join(cells.hint("merge"), context).mapInArrow(lambda b: digest_rows(b, False), kinds)
    return shared(windows).groupBy(*context).agg(F.max("j").cast("short").alias("l"), (length - F.min("j")).cast("short").alias("r"))


# ---------------------------------------------------------------- runs of words

_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 22
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64; those for usual sizes are kept."""
    size = 1 << max(n - 1, 1 << 20).bit_length()
    if size in _POWERS:
        return _POWERS[size]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        values = np.full(size, base, np.uint64)
        values[0] = 1
        made.append(np.multiply.accumulate(values))
    if size <= 1 << 22:
        _POWERS[size] = tuple(made)
    return tuple(made)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values."""
    n, out, at, width = len(h) - size + 1, None, 0, 1
    base = np.uint64(_BASE)
    while width <= size:
        if size & width:
            part = h[at : at + n]
            out = part if out is None else out * base + part
            out = out ^ (out >> np.uint64(31))
            at += width
        if 2 * width > size:
            break
        h = h[:-width] * base + h[width:]
        h ^= h >> np.uint64(29)
        base = (base ^ (base >> np.uint64(9))) | np.uint64(1)
        width *= 2
    return out * np.uint64(0xD6E8FEB86659FD93)


def owned_windows(texts: list[str], size: int = WORDS, gram: int = WORD_GRAM, step: int = 1 << 21):
    """(text, first window, windows, anchor, at) of the stretches of windows of ``size`` words that have one anchor, and
    the hashes of windows that ``at`` points into.

    A window's anchor is its smallest ``gram``-word hash, the first of those that agree in the high bits, so equal windows
    have equal anchors. Words are separated by spaces and the control characters 9 to 13; no window crosses texts.
    """
    encoded = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join((b" ", b" ".join(encoded), b" ")), np.uint8)
    solid = _SOLID[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    n = len(begin) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none, none.view(np.uint64)
    first = np.searchsorted(begin, np.cumsum([1] + [len(b) + 1 for b in encoded[:-1]]))
    text = np.repeat(np.arange(len(texts)), np.diff(first, append=len(begin)))
    up, down = _powers(len(raw))
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])
    h = (total[end - 1] - total[begin - 1]) * down[begin]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    grams, owner, low = _rolled(h, gram), np.empty(n, np.int64), np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, n, step):  # places in a piece fit the low bits of its hashes
        piece = grams[at : min(n, at + step) + size - gram]
        least = _slide((piece & ~low) | np.arange(len(piece), dtype=np.uint64), size - gram + 1, np.minimum)
        owner[at : at + step] = (least & low).astype(np.int64) + at
    inside = np.flatnonzero(text[:n] == text[size - 1 :])
    own, at = grams[owner[inside]], text[inside]
    start = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1]))))[: len(own)]
    at = inside[start]
    return text[at], at - first[text[at]], np.diff(start, append=len(own)), own[start], at, _rolled(h, size)


def _several_documents(window: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (hash and anchor) are held by more than one document; anchors come in order."""
    order = np.argsort(window, kind="stable")
    w, a, d = window[order], anchor[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (a[1:] != a[:-1]))))
    out = np.empty(len(w), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start), np.diff(start, append=len(w)))
    return out


def _longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _windows_of(texts: DataFrame, size: int, gram: int, chosen, crowded, wanted: bool) -> DataFrame:
    """doc_id, th, doc, anchor, at (first window), windows (8 bytes each) of the stretches whose anchor is among
    ``chosen`` and, as ``wanted`` says, among ``crowded`` or not."""

    def run(batches):
        some, many = np.frombuffer(chosen.value, np.uint8), np.frombuffer(crowded.value, np.uint8)
        for batch in batches:
            for start, own in text_runs(batch, "text", 1 << 20):
                text, first, count, anchor, at, windows = owned_windows(own, size, gram)
                anchor = anchor.view(np.int64)
                keep = np.flatnonzero(_among(some, anchor) & (_among(many, anchor) == wanted))
                text, first, count, anchor, at = (x[keep] for x in (text, first, count, anchor, at))
                stop = np.cumsum(count)
                data = windows[np.repeat(at - stop + count, count) + np.arange(count.sum())]
                offsets = np.concatenate(([0], stop * 8)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                row = pa.array(text + start)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), pa.array(anchor), pa.array(first.astype(np.int32)), blobs], names)

    names = ["doc_id", "th", "doc", "anchor", "at", "windows"]
    return texts.select("doc_id", "th", "doc", "text").mapInArrow(released(run), "doc_id long, th long, doc long, anchor long, at int, windows binary")


def _opened(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its text, hash) of each window of a table of stretches."""
    blobs = table.column("windows").combine_chunks() if isinstance(table, pa.Table) else table.column(5)
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // 8
    data, count = np.frombuffer(blobs.buffers()[2], np.int64)[offsets[0] : offsets[-1]], np.diff(offsets)
    row = np.repeat(np.arange(len(blobs)), count)
    return row, np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], count) + _longs(table.column("at"))[row], data


def _shared_windows(stretches: DataFrame, size: int) -> DataFrame:
    """doc_id, th, start, stop (words) of what several documents hold, anchors in one task each."""

    def solve(table):
        row, place, window = _opened(table)
        if not len(row):
            return
        found = np.flatnonzero(_several_documents(window, _longs(table.column("anchor"))[row], _longs(table.column("doc"))[row]))
        row, place = row[found], place[found]
        start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))))[: len(row)]
        at, last = pa.array(row[start]), np.append(start[1:], len(row))[: len(start)] - 1
        ids, th = (table.column(n).combine_chunks().take(at) for n in ("doc_id", "th"))
        yield pa.RecordBatch.from_arrays([ids, th, pa.array(place[start].astype(np.int32)), pa.array((place[last] + size).astype(np.int32))], ["doc_id", "th", "start", "stop"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n > 8 << 20:  # all but the last anchor, which may go on
                table = pa.Table.from_batches(held)
                anchor = _longs(table.column("anchor"))
                whole = int(np.argmax(anchor == anchor[-1]))
                yield from solve(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                n = sum(b.nbytes for b in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    ordered = stretches.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(released(run), "doc_id long, th long, start int, stop int")


def _crowded_windows(stretches: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """As ``_shared_windows``, for anchors with too many places for one task: windows are counted across tasks."""

    def run(batches):
        for batch in batches:
            row, place, window = _opened(batch)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(4)), pa.array(place.astype(np.int32)), pa.array(window)], names)

    names = ["doc_id", "th", "doc", "anchor", "start", "window"]
    opened = scratch.write(stretches.mapInArrow(run, "doc_id long, th long, doc long, anchor long, start int, window long"), "opened")
    shared = opened.groupBy("anchor", "window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a != b").select("anchor", "window")
    met = opened.join(scratch.write(shared, "shared").hint("merge"), ["anchor", "window"])
    return met.select("doc_id", "th", "start", (F.col("start") + size).cast("int").alias("stop"))


def shared_runs(spark: SparkSession, docs: DataFrame, scratch: Scratch, size: int = WORDS, gram: int = WORD_GRAM, many: int = MANY) -> DataFrame:
    """doc_id, th, n_shared_words: words in runs of ``size`` words or more that another document holds too.

    Another document has another doc_id or another text. Words are compared, not what separates them, by a 64-bit hash
    of the window among windows with the same 64-bit anchor. An anchor with more than ``many`` times PLACE_WINDOWS
    windows is split by its windows over tasks.
    """
    texts = _keyed(docs).where(F.octet_length("text") >= 2 * size - 1)
    texts = texts.select("doc_id", "th", F.xxhash64("doc_id", "th").alias("doc"), "text")

    def scan(batches):
        for batch in batches:
            for start, own in text_runs(batch, "text", 1 << 20):
                text, _, count, anchor, _, _ = owned_windows(own, size, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + start)), pa.array(anchor.view(np.int64)), pa.array(count.astype(np.int32))], ["doc", "anchor", "n"])

    met = texts.select("doc", "text").mapInArrow(released(scan), "doc long, anchor long, n int").groupBy("anchor")
    several = scratch.write(met.agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.sum("n").alias("n")).where("a != b").select("anchor", "n"), "met")
    chosen, crowded = _marked(spark, several.select("anchor")), _marked(spark, several.where(F.col("n") > many * PLACE_WINDOWS).select("anchor"))
    runs = _shared_windows(_windows_of(texts, size, gram, chosen, crowded, False), size)
    if any(crowded.value):
        runs = runs.unionByName(_crowded_windows(_windows_of(texts, size, gram, chosen, crowded, True), scratch, size))
    # words of the union: what each run adds beyond those that start before it
    union = """aggregate(array_sort(runs), named_struct('n', 0L, 'at', 0), (s, r) -> named_struct(
        'n', s.n + greatest(0, r.stop - greatest(r.start, s.at)), 'at', greatest(s.at, r.stop)), s -> s.n)"""
    whole = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    return scratch.write(whole.select("doc_id", "th", F.expr(union).alias("n_shared_words")), "words")


# ---------------------------------------------------------------- documents

def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(bytes left, maximal removed runs)."""
    kept, at, runs = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not runs:
            kept.append(raw[at:start])
            runs += 1
        at = max(at, stop)
    kept.append(raw[at:])
    return b"".join(kept), runs


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words of every document.

    Bytes covered by a ``length``-byte string that starts at another place too, in any document or the same one, go;
    strings are judged on the input. A null text counts as empty. Rows that repeat a doc_id and text are each an
    occurrence, so what they share goes. Other columns are not read.

    ``n_shared_words`` is a report beside it: words in runs of more than 50 words that another document holds too, however
    few bytes they have. They stay unless the rule above takes them.
    """
    scratch = Scratch(spark, "repeats")
    spans = repeated_spans(spark, docs, scratch, length, gram, many)
    met = _texts_of(spark, docs, spans)

    def finish(batches):
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.encode()
                kept, runs = cut(raw, [(s["start"], s["stop"]) for s in own])
                rows.append((len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["doc_id", "th", "n_removed", "n_spans", "kept"])

    changed = scratch.write(met.mapInArrow(finish, "doc_id long, th long, n_removed long, n_spans long, kept string").dropDuplicates(["doc_id", "th"]), "changed")
    words = shared_runs(spark, docs, scratch, many=many)
    raw = F.coalesce("text", F.lit(""))
    base = _keyed(docs).select("doc_id", "th", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw.cast("binary"), 256).alias("full"))
    zero = F.lit(0).cast("long")
    out = base.join(changed.hint("merge"), _same(base, changed), "left").join(words.hint("merge"), _same(base, words), "left")
    found = [F.coalesce(n, zero).alias(n) for n in ("n_removed", "n_spans")]
    return out.select(base["doc_id"], "n_bytes", *found, F.coalesce("kept", "full").alias("kept_sha256"), F.coalesce("n_shared_words", zero).alias("n_shared_words"))
