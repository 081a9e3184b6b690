"""Exact Jaccard join of word n-gram sets, by signature trees.

1. Each text becomes the sorted set of 64-bit hashes of its n-grams. Equal sets form one class at once; only the
   class representative (smallest doc_id) goes on.
2. One-permutation min-hash bands give coarse clusters (no link is taken from them).
3. Pairs within a cluster: the sets of a cluster meet in blocks. A block, or a pair of blocks, builds signature
   trees, whose nodes hold OR-combined token bitmaps and size ranges, and the dual traversal prunes node pairs by
   the largest overlap that they allow. Leaves compare exact bitmaps over the block's shared tokens. Only links that
   join two parts are put out, never all pairs, and parts that are joined are not compared again.
4. Pairs across clusters: two sets that link share a token of their prefixes (rarest tokens first, by counts in a
   sample, which decides the order alone). Tokens whose prefixes lie in more than one cluster send their
   members to the same tree join, on bitmaps of the whole sets; the pairs it can't exclude are compared exactly.
5. Links give components.

Joins whose sides grow with the corpus are sort-merge joins at every size; Spark splits them when skewed.
Nothing is dropped or capped: large groups are split by size class and into blocks, and blocks meet in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, Seen, by_group, free_name, give_back, released, text_runs
from .components import components
from .repeat_spans import _among, _marked

BINS, ROWS = 128, 8
SAMPLE_ONE_IN = 32
HEAVY_COUNT = 4
HEAVY_TOKENS = 1_000_000
BLOCK = 1024
VOCABULARY = 1 << 17
LEAF = 8
FILTER_BITS = 1 << 22
_PAIR = [("a", pa.int64(), "long"), ("b", pa.int64(), "long")]


# ---------------------------------------------------------------- sets

class Shingler:
    def __init__(self, n: int):
        self.n, self.words, self.hashes = n, {}, []

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each text; fewer than n words make one n-gram, none make none."""
        if len(self.words) > VOCABULARY:
            self.words, self.hashes = {}, []
        words, hashes, ids = self.words, self.hashes, []
        for t in texts:
            split = t.encode().lower().split() if t else []
            for w in set(split).difference(words):
                words[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w))
            ids.append(np.fromiter(map(words.__getitem__, split), np.int64, len(split)))
        table = np.array(hashes, np.uint64)
        return [self._grams(table[x]) for x in ids]

    def _grams(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(out ^ (out >> np.uint64(29)))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-percent * n // 100)


def bands(s: np.ndarray) -> list[int]:
    """Band keys: the smallest hash of each bin (an empty bin takes the next one's), hashed by rows of bins."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(s, edges)
    low = s[at % len(s)] * np.uint64(0x9E3779B97F4A7C15)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(low.reshape(-1, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bitmap(s: np.ndarray) -> bytes:
    """One bit or more a token: the low bits of its hash, so wider bitmaps fold onto narrower ones."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[s & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def prefix(s: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which any linked set holds one in its own prefix. Tokens outside ``heavy`` come first, by hash."""
    length = len(s) - least_overlap(len(s), percent) + 1
    if not len(heavy):
        return s[:length]
    slot = np.minimum(np.searchsorted(heavy["token"], s), len(heavy) - 1)
    often = heavy["token"][slot] == s
    rare = s[~often]
    if len(rare) >= length:
        return rare[:length]
    rest, count = s[often], heavy["n"][slot[often]]
    return np.concatenate((rare, rest[np.lexsort((rest, count))][: length - len(rare)]))


# ---------------------------------------------------------------- signature trees

class Tree:
    """Nodes over sets sorted by size; each holds the OR of its bitmaps, its sizes, and its largest bitmap excess."""

    def __init__(self, sizes: list[int], maps: list[int], excess: list[int], members: list[int]):
        """members: positions, sorted by size."""
        self.sizes, self.maps, self.excess = sizes, maps, excess
        level = [self._leaf(members[k : k + LEAF]) for k in range(0, len(members), LEAF)]
        while len(level) > 1:
            level = [self._join(level[k : k + LEAF]) for k in range(0, len(level), LEAF)]
        self.root = level[0] if level else None

    def _leaf(self, at):
        combined = 0
        for k in at:
            combined |= self.maps[k]
        sizes = [self.sizes[k] for k in at]
        return (combined, min(sizes), max(sizes), max(self.excess[k] for k in at), None, at)

    def _join(self, nodes):
        if len(nodes) == 1:
            return nodes[0]
        combined = 0
        for x in nodes:
            combined |= x[0]
        return (combined, min(x[1] for x in nodes), max(x[2] for x in nodes), max(x[3] for x in nodes), nodes, None)


def possible(a, b, percent: int) -> bool:
    """Whether members of two nodes can link: sizes near enough, and enough overlap of the combined bitmaps."""
    if a[2] * 100 < b[1] * percent or b[2] * 100 < a[1] * percent:
        return False
    return ((a[0] & b[0]).bit_count() + min(a[3], b[3])) * (100 + percent) >= percent * (a[1] + b[1])


class Union:
    def __init__(self, labels):
        self.parent = {x: x for x in labels}

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def dual(a, b, same: bool, percent: int, visit) -> None:
    """Visit the leaf pairs of two trees that can hold links; ``same``: both are one tree."""
    stack = [(a, b, same)]
    while stack:
        x, y, one = stack.pop()
        if not possible(x, y, percent):
            continue
        if x[4] is None and y[4] is None:
            visit(x[5], y[5], one)
        elif x[4] is None or (y[4] is not None and y[2] - y[1] > x[2] - x[1] and not one):
            stack.extend((x, z, False) for z in y[4])
        elif one:
            for k, z in enumerate(x[4]):
                stack.extend((z, w, k == j) for j, w in enumerate(x[4][: k + 1]))
        else:
            stack.extend((z, y, False) for z in x[4])


def exact_links(docs: list[int], sets: list[np.ndarray], left: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links (a spanning forest of them) among the sets of a block, or between two blocks (``left`` and not).

    Bitmaps have a bit for each token that two sets or more hold, so their overlaps are exact.
    """
    flat = np.concatenate(sets)
    tokens, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    width, at, maps, excess = int(shared.sum()), 0, [], []
    for s in sets:
        own = index[at : at + len(s)]
        at += len(s)
        bits = np.zeros(width + 1, bool)
        bits[number[own[shared[own]]]] = True
        maps.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        excess.append(0)
    sizes = [len(s) for s in sets]
    union, out = Union(docs), []

    def visit(xs, ys, one):
        for i, x in enumerate(xs):
            for y in xs[:i] if one else ys:
                n, m = sizes[x], sizes[y]
                if n * 100 < m * percent or m * 100 < n * percent:
                    continue
                if union.find(docs[x]) == union.find(docs[y]):
                    continue
                both = (maps[x] & maps[y]).bit_count()
                if 100 * both >= percent * (n + m - both):
                    union.join(docs[x], docs[y])
                    out.append((docs[x], docs[y]))

    order = sorted(range(len(sets)), key=lambda k: (sizes[k], docs[k]))
    sides = [[k for k in order if left[k]], [k for k in order if not left[k]]]
    trees = [Tree(sizes, maps, excess, side) for side in sides]
    if trees[0].root and trees[1].root:
        dual(trees[0].root, trees[1].root, False, percent, visit)
    elif root := trees[0].root or trees[1].root:
        dual(root, root, True, percent, visit)
    return out


def possible_pairs(docs, sizes, raw, groups, left, percent: int, homes=None) -> list[tuple[int, int]]:
    """Pairs of different groups that bitmaps can't exclude (``left`` as above; all True: one block).

    ``homes``: only pairs with a home are wanted; None: all are homes.
    """
    out = []
    wide = [int.from_bytes(x, "little") for x in raw]
    bits = [w.bit_count() for w in wide]
    narrow = min(len(x) for x in raw)

    def folded(k):
        parts = np.frombuffer(raw[k], np.uint8).reshape(-1, narrow)
        return int.from_bytes(np.bitwise_or.reduce(parts, 0).tobytes(), "little")

    def visit(xs, ys, one):
        for i, x in enumerate(xs):
            for y in xs[:i] if one else ys:
                n, m = sizes[x], sizes[y]
                if groups[x] == groups[y] or n * 100 < m * percent or m * 100 < n * percent or homes and not (homes[x] or homes[y]):
                    continue
                if len(raw[x]) == len(raw[y]):
                    both = (wide[x] & wide[y]).bit_count()
                    over = min(n - bits[x] + both, m - bits[y] + both)  # a bit of one side only is a token of one side only
                else:  # twice as wide at most, by the sizes
                    a, b = folded(x), folded(y)
                    over = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
                if over * (100 + percent) >= percent * (n + m):
                    out.append((min(docs[x], docs[y]), max(docs[x], docs[y])))

    order = sorted(range(len(docs)), key=lambda k: (sizes[k], docs[k]))
    sides = [[k for k in order if left[k]], [k for k in order if not left[k]]]
    if len(order) <= 2 * LEAF:  # one leaf a side: no tree to traverse
        if sides[0] and sides[1]:
            visit(sides[0], sides[1], False)
        else:
            visit(sides[0] or sides[1], None, True)
        return out
    maps = [folded(k) for k in range(len(docs))]
    excess = [n - m.bit_count() for n, m in zip(sizes, maps)]
    trees = [Tree(sizes, maps, excess, side) for side in sides]
    if trees[0].root and trees[1].root:
        dual(trees[0].root, trees[1].root, False, percent, visit)
    elif root := trees[0].root or trees[1].root:
        dual(root, root, True, percent, visit)
    return out


# ---------------------------------------------------------------- Spark

def _heavy(docs: DataFrame, n: int, scratch: Scratch) -> np.ndarray:
    """The most frequent tokens with their counts, HEAVY_TOKENS of them at most, that HEAVY_COUNT or more hold of one
    document in SAMPLE_ONE_IN by hash: the sample grows with the corpus, the list has a fixed bound."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0)

    def tokens(batches):
        own = Shingler(n)
        for batch in batches:
            for _, texts in text_runs(batch, "text"):
                for s in own.sets(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["token"])

    rows = sample.select("text").mapInArrow(released(tokens), "token long")
    top = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY_COUNT).orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS)
    often = scratch.write(top, "heavy").toPandas()  # written first: the driver gets the limit's rows only
    out = np.zeros(len(often), np.dtype([("token", "<u8"), ("n", "<i8")]))
    out["token"], out["n"] = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    return np.sort(out, order="token")


def signatures(spark: SparkSession, docs: DataFrame, n: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128-bit digest of the set), bands, tokens (prefix), bits (bitmap).

    The last three are null for empty sets, and for rows that repeat a doc_id and set that the task has met.
    """
    shared = spark.sparkContext.broadcast(heavy)

    def run(batches):
        own, seen = Shingler(n), Seen()
        for batch in batches:
            doc_ids = batch.column(0)
            ids = doc_ids.to_pylist()
            for start, texts in text_runs(batch, "text"):
                sets = own.sets(texts)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                full = [len(s) > 0 and seen.new((ids[start + k], *d)) for k, (s, d) in enumerate(zip(sets, digest.tolist()))]
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    pa.array([bands(s) if f else None for s, f in zip(sets, full)], pa.list_(pa.int64())),
                    pa.array([prefix(s, shared.value, percent).view(np.int64) if f else None for s, f in zip(sets, full)], pa.list_(pa.int64())),
                    pa.array([bitmap(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                ], ["doc_id", "n_shingles", "d1", "d2", "bands", "tokens", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, tokens array<long>, bits binary")


def _sets(spark: SparkSession, docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """doc_id, grams (binary uint64) of the documents in ``wanted``; others are mostly left out before the shuffle.

    The filter is one bit array of fixed size, whatever the number of documents; the join decides. Rows that repeat a
    doc_id and set come once a task, those that repeat a doc_id with another set are rows of their own.
    """

    def mark(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    merged = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in wanted.select("doc_id").coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        merged |= np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(merged.tobytes())

    def run(batches):
        own, seen, bits = Shingler(n), Seen(), np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            doc_ids = batch.column(0)
            ids = np.array([x or 0 for x in doc_ids.to_pylist()], np.int64)
            batch = batch.filter(pa.array(bits[_slots(ids)]))
            for start, texts in text_runs(batch, "text"):
                own_ids = batch.column(0).slice(start, len(texts)).to_pylist()
                found = [(d, raw) for d, s in zip(own_ids, own.sets(texts)) if len(s) and seen.new((d, xxhash.xxh3_128_digest(raw := s.tobytes())))]
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["doc_id", "grams"])

    sets = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, grams binary")
    return sets.join(wanted.hint("merge"), "doc_id")


def _slots(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(42)).astype(np.int64)


def _block_pairs(rows: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` dealt to keys + (bi, bj, side): every two rows of a group meet once, BLOCK or so a side at most.

    A group of one block meets itself in (0, 0). ``counts``: key, n_group.
    """
    sized = rows.join(counts.hint("merge"), key)
    blocks = F.ceil(F.col("n_group") / BLOCK).cast("int")
    sized = sized.withColumn("_b", blocks).withColumn("_own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("_b")).cast("int"))
    met = sized.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return met.withColumn("bi", F.least("_own", "_o")).withColumn("bj", F.greatest("_own", "_o")).withColumn("is_left", F.col("_own") == F.col("bi")).drop("_b", "_own", "_o", "n_group")


def _cluster_links(spark, docs, n, percent, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join what links within a cluster (node, component).

    A cluster of one block is compared within the block. A larger one (its sets may be a third of all) takes three
    steps: each block within itself; all blocks with the first one; then whatever is not in the cluster's largest
    part with everything. Pairs of one part need no comparison, so the many near copies of one text are sent a few
    times each, not once for every block.
    """
    # counts are written, so that the joins with them are such as Spark splits where a cluster is large
    counts = scratch.write(clusters.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n_group")), "cluster_counts")
    found = _sets(spark, docs, n, clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))).join(counts.hint("merge"), "cluster")
    blocks = F.ceil(F.col("n_group") / BLOCK).cast("int")
    found = found.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")).drop("n_group")
    sets = scratch.write(found, "cluster_sets")

    def within(group: dict) -> list[tuple]:
        own = set(zip(group["doc_id"], group["grams"]))  # each set once
        ids = [d for d, _ in own]
        union = Union(ids)
        for a, b in exact_links(ids, [np.frombuffer(x, np.uint64) for _, x in own], [True] * len(ids), percent):
            union.join(a, b)
        return [(x, union.find(x)) for x in set(ids)]

    def across(group: dict) -> list[tuple]:
        return exact_links(group["label"], [np.frombuffer(x, np.uint64) for x in group["grams"]], group["is_left"], percent)

    own = scratch.write(by_group(sets.select("cluster", "own", "doc_id", "grams"), ["cluster", "own"], within, [("doc_id", pa.int64(), "long"), ("label", pa.int64(), "long")]), "labels")
    edges = own.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
    large = sets.where("blocks > 1")
    if not large.head(1):
        return edges
    large = large.join(own.distinct().hint("merge"), "doc_id")
    first = large.where("own = 0").withColumn("at", F.explode(F.expr("sequence(1, blocks - 1)"))).withColumn("is_left", F.lit(True))
    others = large.where("own > 0").withColumn("at", F.col("own")).withColumn("is_left", F.lit(False))
    met = first.unionByName(others).select("cluster", "at", "label", "grams", "is_left")
    probed = scratch.write(by_group(met, ["cluster", "at"], across, _PAIR), "probed")
    edges = edges.unionByName(probed)

    parts = scratch.write(components(probed, scratch, "parts"), "parts")
    named = large.join(parts.select(F.col("node").alias("label"), "component").hint("merge"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    named = scratch.write(named, "named")
    sizes = named.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = scratch.write(sizes.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "largest")
    rest = named.join(largest.hint("merge"), "cluster").where("label <> main").drop("main")
    n_rest = scratch.write(rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guests")), "n_rest")
    guests = rest.join(n_rest.hint("merge"), "cluster").withColumn("guest", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("guests")).cast("int"))
    guests = guests.withColumn("at", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("is_left", F.lit(True))
    homes = named.join(n_rest.hint("merge"), "cluster").withColumn("guest", F.explode(F.expr("sequence(0, guests - 1)"))).withColumn("at", F.col("own")).withColumn("is_left", F.lit(False))
    met = guests.select("cluster", "at", "guest", "label", "grams", "is_left").unionByName(homes.select("cluster", "at", "guest", "label", "grams", "is_left"))
    return edges.unionByName(by_group(met, ["cluster", "at", "guest"], across, _PAIR))


def _shared_tokens(spark: SparkSession, reps: DataFrame, clusters: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, cluster, n_shingles, token, c, guest: members of prefix tokens that lie in more than one cluster.

    Few tokens do. They are found from (token, cluster) alone, and a bit array of fixed size keeps most other tokens
    from being sent again; the join decides.
    """
    named = reps.join(clusters.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    labelled = scratch.write(named.select("doc_id", F.coalesce("component", "doc_id").alias("cluster"), "n_shingles", "tokens"), "labelled")
    spread = labelled.select("cluster", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    cross = scratch.write(spread.where("lo <> hi").select("token"), "cross")
    bits = _marked(spark, cross)

    def members(batches):
        marked = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            tokens = batch.column(3)
            flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))
            keep = _among(marked, flat)
            row, flat = pa.array(row[keep]), pa.array(flat[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row), flat], ["doc_id", "cluster", "n_shingles", "token"])

    rows = labelled.mapInArrow(members, "doc_id long, cluster long, n_shingles long, token long").join(cross.hint("merge"), "token")
    # a size class spans one factor of the similarity, so linked sets lie in one class or in two neighbours:
    # home rows of class c meet each other and the guests from class c + 1
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    rows = rows.withColumn("c", F.floor(F.log("n_shingles") / step).cast("int"))
    homes, guests = rows.withColumn("guest", F.lit(False)), rows.withColumn("c", F.col("c") - 1).withColumn("guest", F.lit(True))
    out = scratch.write(homes.unionByName(guests), "shared")
    scratch.drop("labelled")
    return out


def similar_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Sets link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable by links.
    Null texts and texts without words have no n-grams and no links. Rows that repeat a doc_id are one node; a null
    doc_id has no links and a null component. Other columns are not read.
    """
    scratch = Scratch(spark, "jaccard")
    sig = scratch.write(signatures(spark, docs, n, percent, _heavy(docs, n, scratch)), "signatures")
    linked = sig.where("bits IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.write(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    base = scratch.write(sig.select("doc_id", "n_shingles", "d1", "d2"), "base")
    own = ["doc_id", "d1", "d2"]
    reps = linked.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2").hint("merge"), own, "left_semi").dropDuplicates(own)
    reps = scratch.write(reps.drop("d1", "d2"), "reps")
    scratch.drop("signatures")
    # a doc_id with several sets is one node, so it links their classes
    place = F.struct("d1", "d2")
    several = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("doc_id")
    several = scratch.write(several, "several")
    homes = base.where("n_shingles > 0").join(several.hint("merge"), "doc_id", "left_semi").select(*own).distinct()
    joined = homes.join(classes.hint("merge"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    coarse = banded.join(hubs.hint("merge"), ["band", "key"]).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = scratch.write(components(coarse, scratch, "coarse"), "clusters")
    give_back(spark)
    inner = scratch.write(_cluster_links(spark, docs, n, percent, clusters, scratch), "inner")
    for name in ("cluster_sets", "labels", "probed", "parts", "named"):
        scratch.drop(name)
    give_back(spark)

    shared = _shared_tokens(spark, reps, clusters, percent, scratch)
    counts = shared.groupBy("token", "c").agg(F.count("*").alias("n_group"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").drop("lo", "hi")
    dealt = _block_pairs(shared, scratch.write(counts, "token_counts"), ["token", "c"])
    with_bits = dealt.join(reps.select("doc_id", "n_shingles", "bits").hint("merge"), ["doc_id", "n_shingles"])

    def pairs(group: dict) -> list[tuple[int, int]]:
        # guests of the class above meet homes only, so a pair meets in one group of a token
        homes = [not g for g in group["guest"]]
        if not any(homes):
            return []
        one = group["bi"][0] == group["bj"][0]
        left = [True] * len(homes) if one else group["is_left"]
        return possible_pairs(group["doc_id"], group["n_shingles"], group["bits"], group["cluster"], left, percent, homes)

    candidates = scratch.write(by_group(with_bits, ["token", "c", "bi", "bj"], pairs, _PAIR).where("a <> b").distinct(), "candidates")
    give_back(spark)
    outer = _verified(spark, docs, n, percent, candidates, scratch)
    links = inner.unionByName(outer).unionByName(joined)
    found = scratch.write(components(links, scratch, "final"), "final")
    for name in ("reps", "shared", "sets", "candidates"):
        scratch.drop(name)
    labelled = classes.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = base.join(labelled.hint("merge"), ["d1", "d2"], "left")
    # empty sets of a doc_id that has others too
    nodes = several.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id").withColumnRenamed("component", "of_node")
    out = out.join(nodes.hint("merge"), "doc_id", "left")
    whole = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("of_node", whole, "doc_id").alias("component_id"))


def _verified(spark, docs, n, percent, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidate pairs (a, b) that link, by their whole sets."""
    wanted = candidates.select(F.col("a").alias("doc_id")).unionByName(candidates.select(F.col("b").alias("doc_id"))).distinct()
    sets = scratch.write(_sets(spark, docs, n, scratch.write(wanted, "wanted")).dropDuplicates(["doc_id", "grams"]), "sets")
    left = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            out = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(out), batch.column(1).filter(out)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest doc_id of their component."""
    head = free_name(docs.columns, "head")
    heads = similar_components(spark, docs, n, percent).where("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias(head)).distinct()
    return docs.join(heads.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(head)), "left_semi")
