"""Quality, sharding, language, lines, leaks: brute force, laws and held-out accuracy on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpact.llm import decontaminate as D
from sparkpact.llm import language_id as L
from sparkpact.llm import line_chunks as K
from sparkpact.llm import quality_rules as Q
from sparkpact.llm import sharding as S
from sparkpact.llm._common import importable

from .data import SCHEMA, documents, empty, frame, prose


@pytest.fixture(autouse=True)
def ready(spark):
    importable(spark)


def test_base_figures():
    def brute(text):
        words = (text or "").encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    reader = Q.NgramReader(1024)
    texts = [t if t is None or len(t) < 4000 else t[:4000] for _, t, *_ in documents()] + ["a b c a b c", "a\nb\na\n\n#|", "a a a a", "a b c"]
    assert [Q.base_figures(t, i) for t, i in zip(texts, reader.ids(texts))] == [brute(t) for t in texts]


def test_quality(spark):
    good = [(k, prose(k, 120), "aa", "s", 1, 0.0) for k in range(60)]
    junk = [(k, " | ".join(prose(k, 80, ("zz", "qq", "xx")).split()), "aa", "s", 1, 0.0) for k in range(100, 130)]
    docs = spark.createDataFrame(good + junk + documents()[3:7], SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(k, 0, 0) for k in range(100, 110)], "doc_id long, quality int, toxic int")
    rows = [r for r in Q.quality(spark, docs, labels).collect()]
    kept = {r.doc_id for r in rows if r.kept}
    assert {k for k in range(60)} - {3, 4, 5, 6} <= kept and not kept & set(range(100, 130))
    assert len(rows) == docs.count() and [r.base_failed for r in rows if r.n_words == 0] == [True] * 3
    nothing = Q.quality(spark, docs, labels.limit(0)).where("NOT base_failed AND NOT kept")
    assert nothing.count() == 0 and Q.quality(spark, empty(spark), labels).count() == 0


def test_quality_scores_match_brute_force(spark):
    import math
    from collections import Counter

    import xxhash

    mask, size = (1 << 64) - 1, 256

    def mix(x):
        x = ((x ^ x >> 31) * 0x9E3779B97F4A7C15) & mask
        return x ^ x >> 29

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.decode("utf-8", "replace").lower()) for w in (text or "").encode().split()]
        return [mix(x) % size for x in h] + [mix((a * 0xC2B2AE3D27D4EB4F + b) & mask) % size for a, b in zip(h, h[1:])]

    rows = [r for r in documents() if r[0] is not None] + [(100 + k, prose(k, 30 + 3 * k), "a", "s", 1, 0.0) for k in range(40)]
    good = {100 + k for k in range(15)} | {8}
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(k, 1, 0) for k in list(good)[:3]] + [(9, 0, 0), (116, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, trusted = Counter(), Counter()
    for d, t, *_ in rows:
        raw.update(buckets(t))
        trusted.update(buckets(t) if d in good else [])
    share = sum(trusted.values()) / sum(raw.values())
    weight = {b: math.log((trusted[b] + Q.PSEUDO_COUNT) / (raw[b] * share + Q.PSEUDO_COUNT)) for b in raw}
    want = {d: sum(weight[b] for b in own) / len(own) if (own := buckets(t)) else 0.0 for d, t, *_ in rows}
    got = Q.quality(spark, frame(spark, rows), labels, threshold=0.01, buckets=size).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    assert all(r.kept == (not r.base_failed and want[r.doc_id] >= 0.01) for r in got) and {r.kept for r in got if not r.base_failed} == {True, False}


def loads_of(got, shards=8):
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


def test_sharding_laws(spark):
    rows = [(k, "same text" if k % 3 == 0 else prose(k, 5 + k % 40), "a", "s", 1, 0.0) for k in range(1500)] + [r for r in documents() if len(r[1] or "") < 20_000]
    got = S.assign(spark, spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    loads = loads_of(got)
    assert max(loads) - min(loads) < 0.2 * sum(loads) / 8  # one text is a third of the rows
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    homes = {}
    for r in got:
        homes.setdefault(r.virtual_slot, set()).add(r.shard)
    assert all(len(v) == 1 for v in homes.values())
    assert S.assign(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("doc_id", [lambda k: k, lambda k: None, lambda k: 7])
def test_hot_rows_are_split(spark, doc_id):
    rows = [(doc_id(k), "hot " * 20 if k % 3 else prose(k, 20), "a", "s", 1, 0.0) for k in range(3000)]
    got = S.assign(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), 8).collect()
    loads = loads_of(got)
    assert max(loads) < 1.1 * min(loads) and len(got) == 3000


def test_map_versions(spark):
    """A second run reads the newest version and leaves it alone; a ninth shard is an edit that moves about a ninth."""
    docs = spark.createDataFrame([(k, prose(k, 5 + k % 40), "a", "s", 1, 0.0) for k in range(3000)], SCHEMA)
    base = S.Scratch(spark, "test").path("map")
    first = {r.doc_id: r for r in S.assign(spark, docs, 8, map_dir=base).collect()}
    assert {r.map_version for r in first.values()} == {2}  # version 1 dealt the slots out in turn
    again = {r.doc_id: r for r in S.assign(spark, docs, 8, map_dir=base).collect()}
    assert {d: (r.shard, r.map_version) for d, r in again.items()} == {d: (r.shard, 2) for d, r in first.items()}
    grown = {r.doc_id: r for r in S.assign(spark, docs, 9, map_dir=base).collect()}
    loads = loads_of(grown.values(), 9)
    assert {r.map_version for r in grown.values()} == {3} and max(loads) < 1.05 * min(loads)
    moved = [d for d, r in grown.items() if r.shard != first[d].shard]
    assert len(moved) < 3000 / 6 and sum(grown[d].shard == 8 for d in moved) > 0.8 * len(moved)
    assert all(r.virtual_slot == first[d].virtual_slot for d, r in grown.items())
    shrunk = S.assign(spark, docs, 8, map_dir=base).collect()
    assert {r.map_version for r in shrunk} == {4} and max(r.shard for r in shrunk) == 7
    store = S.SlotMap(spark, base)
    assert store.newest() == 4 and store.read(1) == S.initial_map(S.VIRTUAL_SLOTS, 8)
    with pytest.raises(ValueError):
        S.assign(spark, docs, 8, slots=100, map_dir=base)


def test_rebalance_moves_little():
    loads = [10] * 80
    first = S.initial_map(80, 8)
    assert S.rebalance(first, loads, 8) == first
    heavy = [30 if k == 0 else 10 for k in range(80)]
    edited = S.rebalance(first, heavy, 8)
    assert sum(a != b for a, b in zip(first, edited)) <= 2


def test_language(spark):
    kinds = {"aa": ("the", "and", "ing", "sh"), "bb": ("öde", "ung", "sch", "ei"), "cc": ("ción", "ñar", "que", "os")}
    rows = [(k * 3 + j, prose(k, 40, s), lang, "x", 1, 0.0) for k in range(80) for j, (lang, s) in enumerate(kinds.items())]
    rows += [(900 + k, t, "aa", "x", 0, 0.0) for k, t in enumerate([None, "", "12 34 — !!", "¿?"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.predict(spark, docs, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [d for d in truth if d < 900 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[d].lang_pred == truth[d] for d in held)
    assert all(got[900 + k].lang_pred == "und" for k in range(4)) and all(0 <= r.score <= 1 for r in got.values())
    kept = L.keep_identified(spark, docs, model)
    assert kept.columns == docs.columns and kept.count() == 240
    r = random.Random(3)
    noise = [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(words)) for letters in ("абвгдежзийклмн", "αβγδεζηθικλμ", "一丁七万丈三上下不") for words in (1, 8, 40, 3000)]
    noise += [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(words)) for words in (100, 3000)]
    foreign = spark.createDataFrame([(5000 + k, t, "aa", "x", 0, 0.0) for k, t in enumerate(noise)], SCHEMA)
    assert L.keep_identified(spark, foreign, model).count() == 0  # however many buckets they fill
    assert L.predict(spark, docs, L.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_language_scores_match_dense_ridge():
    """With every row a landmark the Nystroem map loses nothing: scores are those of the dense dual problem."""
    kinds = {"aa": ("the", "and", "ing", "sh"), "bb": ("oede", "ung", "sch", "ei"), "cc": ("cion", "nar", "que", "os")}
    rows, langs = zip(*[(L.presence(prose(k, 12 + k, s)), lang) for k in range(20) for lang, s in kinds.items()])
    fresh = [L.presence(prose(700 + k, 15, s)) for k, s in enumerate(kinds.values())]
    model = L.KernelModel.fit(list(rows), list(langs), [True] * len(rows))

    def kernel(a, b):
        n, m, d = len(a), len(b), L.DIMENSIONS
        return (len(set(a.tolist()) & set(b.tolist())) - n * m / d) / np.sqrt(n * (1 - n / d) * m * (1 - m / d))

    gram = np.array([[kernel(a, b) for b in rows] for a in rows])
    y = np.array([[float(lang == own) for own in sorted(kinds)] for lang in langs])
    weight = 1 / 20
    alpha = np.linalg.solve(gram + L.RIDGE * np.eye(len(rows)) * weight / weight, y)
    want = np.array([[kernel(a, b) for b in rows] for a in fresh]) @ alpha
    assert np.abs(model.scores(fresh) - want).max() < 2e-3


def brute_chunks(text):
    lines, out, own = text.split("\n"), [], []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    for k, line in enumerate(lines):
        own.append(line)
        if k == len(lines) - 1 or (h[k] + (h[k - 1] if k else 0) * 31) % 3 == 0:
            out.append("\n".join(own))
            own = []
    return out


def test_line_chunks(spark):
    lines = [prose(k, 6).replace("\n", " ") for k in range(40)]
    rows = [(1, "\n".join(lines[:20])), (2, "\n".join(["new"] + lines[:20] + ["end"])), (3, "\n".join(lines[5:15])), (4, "one line"), (5, "one line"), (6, None), (7, ""), (8, "\n\n\n\n"), (9, "\n".join(lines[:20])), (9, "\n".join(lines[:20]))]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, n_removed string, n_chunks int")
    seen, want = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        if t is None:
            want[d] = None
            continue
        kept = []
        for c in brute_chunks(t):
            counts = len([x for x in c.split("\n") if x.strip(" ")]) >= 2
            if not (counts and c in seen):
                kept.append(c)
            if counts:
                seen.add(c)
        want[d] = "\n".join(kept)
    out = K.dedup_lines(spark, docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*want.items(), (9, want[9])], key=str)
    assert len(want[9]) < 0.5 * len(rows[-1][1]) and len(want[2]) < 0.5 * len(rows[1][1]) and K.dedup_lines(spark, empty(spark)).count() == 0


def test_leaks(spark):
    items = [(k, prose(500 + k, 45)) for k in range(6)] + [(7, "short"), (8, None), (9, "")]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    broken = list(items[2][1])
    for at in (10, 60, 110, 160):
        broken[at] = "Q"
    texts = [prose(1, 200) + " " + items[0][1] + " " + prose(2, 20), items[1][1].upper().replace(" ", "\n"), "".join(broken), prose(3, 300), None, "", "x" * 5000, prose(4, 20) + items[3][1] + prose(5, 5000), "short"]
    docs = spark.createDataFrame([(k, t, "a", "s", 1, 0.0) for k, t in enumerate(texts)], SCHEMA)
    for block in (D.BLOCK_CHARS, 300):
        got = {(r.doc_id, r.item_id) for r in D.matches(spark, docs, bench, block).collect()}
        assert got == {(0, 0), (1, 1), (2, 2), (7, 3), (8, 7)}  # every item counts, however short
        assert sorted(r.doc_id for r in D.keep_clean(spark, docs, bench, block).collect()) == [3, 4, 5, 6]
    assert D.matches(spark, docs, bench.limit(0)).count() == 0 and D.matches(spark, empty(spark), bench).count() == 0


def test_leaks_in_a_large_index():
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)[rng.integers(0, 26, (24_000, 230))]
    items = [(k, row.tobytes().decode()) for k, row in enumerate(letters)]
    index = D.SegmentIndex(items)
    assert len(index.codes) > 70_000
    for k in (5, 10_000, 11_000, 16_000, 23_999):  # segments on both sides of 32,768 and 65,536
        text = prose(k, 30) + " " + items[k][1] + " " + prose(k + 1, 30)
        assert {item for _, item, *_ in D._found(index, [text])} == {k}


def brute_leak(text, item):
    """Whether any segment of an item occurs within its budget, by the whole alignment table of each segment."""
    want, whole = D.normalise(item)[0], D.normalise(text)[0]
    want = want[: len(want) - (len(want) > 0 and want[-1] == 32)]
    if len(want) < 10:
        return len(want) > 0 and f" {item_text(want)} " in f" {item_text(whole).rstrip()} "
    last = max(0, len(want) - D.SEGMENT)
    for begin in {*range(0, last, D.SEGMENT // 2), last}:
        piece = want[begin : begin + D.SEGMENT]
        cost, ramp = np.zeros(len(whole) + 1, np.int64), np.arange(len(whole) + 1)
        for i, c in enumerate(piece, 1):
            step = np.concatenate(([i], np.minimum(cost[:-1] + (whole != c), cost[1:] + 1)))
            cost = np.minimum.accumulate(step - ramp) + ramp
        if cost.min() <= len(piece) // 10:
            return True
    return False


def item_text(codes):
    return codes.astype("<u4").tobytes().decode("utf-32-le")


@pytest.mark.parametrize("hits", [D.HITS, 50])
def test_leaks_of_every_length(monkeypatch, hits):
    monkeypatch.setattr(D, "HITS", hits)
    r = random.Random(hits)
    items = [(k, "".join(r.choice("abcdefgh .") for _ in range(1 + k % 200))) for k in range(600)]
    index, texts = D.SegmentIndex(items), []
    for k, item in items:
        edited = list(item)
        for _ in range(r.choice((0, len(item) // 20, len(item) // 10, len(item) // 10, len(item) // 10 + 1))):
            at = r.randrange(len(edited) + 1)
            edited[at : at + r.randint(0, 1)] = r.choice(("", "z", "q", "a"))
        before, after = ("".join(r.choice("abcdefgh .") for _ in range(r.randint(0, 300))) for _ in range(2))
        texts.append(before + r.choice((" ", "")) + "".join(edited) + r.choice((" ", "")) + after)
    found = {(row, item) for row, item, *_ in D._found(index, texts)}
    for k, item in items:
        assert ((k, k) in found) == brute_leak(texts[k], item), (item, texts[k])
    others = [(r.randrange(600), r.randrange(600)) for _ in range(2000)]
    for row, k in others:
        assert ((row, k) in found) == brute_leak(texts[row], items[k][1])


def test_leaks_in_one_very_long_text(monkeypatch):
    monkeypatch.setattr(D, "HITS", 5000)
    items = [(k, prose(500 + k, 45)) for k in range(4)] + [(9, "ba ba ba ba ba ba ba ba")]
    text = prose(1, 8000) + " " + items[2][1] + " " + "ba " * 20_000 + prose(3, 8000) + items[3][1]
    assert {(item) for _, item, *_ in D._found(D.SegmentIndex(items), [text])} == {2, 3, 9}


def test_banded_alignment():
    def brute(want, region):
        cost = [[0] * (len(region) + 1)]
        for i, c in enumerate(want, 1):
            row = [i]
            for j, d in enumerate(region, 1):
                row.append(min(cost[-1][j - 1] + (c != d), cost[-1][j] + 1, row[-1] + 1))
            cost.append(row)
        return min(cost[-1])

    rng = np.random.default_rng(3)
    for _ in range(60):
        want, region = rng.integers(0, 3, 12).astype(np.uint32), rng.integers(0, 3, 30).astype(np.uint32)
        least = brute(want.tolist(), region.tolist())
        got = D.banded(want, region, 12)
        assert got[2] == least and (least == 0 or D.banded(want, region, least - 1) is None)
        start, end, _ = got
        assert 0 <= start <= end <= 30
