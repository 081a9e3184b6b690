"""Repeats and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkpact.llm import jaccard_join as J
from sparkpact.llm import repeat_spans as R
from sparkpact.llm._common import Scratch, importable
from sparkpact.llm.components import components

from .data import SCHEMA, documents, empty, frame, prose


@pytest.fixture(autouse=True)
def ready(spark):
    importable(spark)


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [R.MANY, 1])
def test_repeats(spark, many):
    rows = documents()
    passage = prose(70, 70)
    rows += [(100 + k, prose(200 + k, 20) + passage[k : len(passage) - k] + prose(300 + k, 20), "a", "s", 1, 0.0) for k in range(8)]
    got = R.remove_repeats(spark, frame(spark, rows), many=many).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)


def test_planted_passages_go_by_their_bytes(spark):
    """Passages of over 50 words that two documents share: those of 400 bytes or more go whole, shorter ones and
    documents without a passage stay as they are."""
    rows, want = [], {}
    for k, size in enumerate((330, 398, 399, 400, 401, 450, 900)):
        passage = prose(500 + k, 200, ("ba", "ke", "lo"))[:size]
        assert len(passage.split()) > 50
        for d, (before, after) in {3 * k: "12", 3 * k + 1: "34"}.items():  # no byte beside the passage agrees
            rows.append((d, prose(600 + d, 80) + before + passage + after + prose(700 + d, 80), "a", "s", 1, 0.0))
            want[d] = size if size >= 400 else 0
        rows.append((3 * k + 2, prose(800 + k, 150), "a", "s", 1, 0.0))
        want[3 * k + 2] = 0
    got = R.remove_repeats(spark, frame(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {d: len(t.encode()) for d, t, *_ in rows}


def brute_shared_words(rows, size=51):
    texts = {(d, t or ""): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    held = Counter(w for words in texts.values() for w in {tuple(words[k : k + size]) for k in range(len(words) - size + 1)})
    out = []
    for d, t, *_ in rows:
        words = texts[d, t or ""]
        out.append((str(d), len({p for k in range(len(words) - size + 1) if held[tuple(words[k : k + size])] > 1 for p in range(k, k + size)})))
    return sorted(out)


@pytest.mark.parametrize("many", [R.MANY, 1])
def test_runs_of_over_50_words_are_counted_whatever_their_bytes(spark, many):
    """Passages of 51 words that other documents hold are found, by any separators and below 400 bytes too; those of 50
    words, and what only the document itself repeats, are not."""
    rows = documents() + [(40, "so " * 300, "a", "s", 1, 0.0), (41, prose(41, 60) + "\n" + prose(41, 60), "a", "s", 1, 0.0), (41, prose(42, 60), "a", "s", 1, 0.0)]
    for k, size in enumerate((49, 50, 51, 52, 51, 80)):
        words = [f"w{k}{j % 37}" for j in range(size)]
        rows += [(100 + 2 * k, "one " + " ".join(words) + " end", "a", "s", 1, 0.0), (101 + 2 * k, prose(k + 60, 70) + "\n" + "\t \x0b".join(words) + "\n" + prose(k + 70, 9), "a", "s", 1, 0.0)]
    passage = prose(71, 90).split()
    rows += [(200 + k, " ".join([prose(800 + k, k), *passage[k : 90 - 2 * k], prose(900 + k, 20)]), "a", "s", 1, 0.0) for k in range(16)]
    got = R.remove_repeats(spark, frame(spark, rows), many=many).collect()
    want = brute_shared_words(rows)
    assert sorted((str(r.doc_id), r.n_shared_words) for r in got) == want
    found = dict(want)
    assert [found[str(d)] for d in (100, 102, 104, 106, 108, 110)] == [0, 0, 51, 52, 51, 80] and found["41"] == 0
    assert {r.doc_id: r.n_removed for r in got}[104] == 0


def test_windows_have_one_anchor_in_any_piece():
    r = random.Random(4)
    texts = ["", " \n", *(" ".join(r.choice(("a", "b", "cc", "dé")) for _ in range(r.randint(0, 60))) for _ in range(30))]
    found = []
    for step in (1 << 21, 64):
        text, first, count, anchor, at, windows = R.owned_windows(texts, 9, 2, step)
        found.append({(int(t), int(f) + j): (int(a), int(windows[p + j])) for t, f, c, a, p in zip(text, first, count, anchor, at) for j in range(c)})
    words = [t.split() for t in texts]
    want = {(k, j): tuple(w[j : j + 9]) for k, w in enumerate(words) for j in range(len(w) - 8)}
    assert found[0] == found[1] and found[0].keys() == want.keys()
    assert len(R.owned_windows(["so " * 400, "so " * 400])[0]) == 2  # not a stretch a word
    assert len(set(want.values())) == len(set(found[0].values())) == len({(want[k], found[0][k]) for k in want})


def test_no_documents_no_repeats(spark):
    assert R.remove_repeats(spark, empty(spark)).count() == 0
    assert R.remove_repeats(spark, frame(spark, documents()[3:7])).where("n_removed > 0").count() == 0


def test_groups_hold_all_occurrences(spark):
    """Each group is one byte string, with all of its places and no byte more that all of them share; every repeated
    window lies in a group."""
    length = 40
    r = random.Random(3)
    passages = ["".join(r.choice("abcd ") for _ in range(90)) for _ in range(4)]
    texts = [None, "", passages[0], "x" * 130]
    for _ in range(25):
        texts.append("".join(r.choice(("".join(r.choice("abcd ") for _ in range(r.randint(1, 30))), (p := r.choice(passages))[r.randint(0, 20) : r.randint(60, 90)], p)) for _ in range(4)))
    texts += [texts[6], texts[7]]
    docs = frame(spark, [(k, t, "a", "s", 1, 0.0) for k, t in enumerate(texts)])
    rows = R.repeat_groups(spark, docs, length, 8).collect()
    raw = {k: (t or "").encode() for k, t in enumerate(texts)}
    groups = {}
    for x in rows:
        groups.setdefault(x.group, []).append(x)
    covered = {k: set() for k in raw}
    for own in groups.values():
        size, strings = own[0].n_bytes, {raw[x.doc_id][x.start : x.start + x.n_bytes] for x in own}
        assert len(strings) == 1 and len(string := strings.pop()) == size >= length
        every = {(k, at) for k, b in raw.items() for at in range(len(b) - size + 1) if b[at : at + size] == string}
        assert {(x.doc_id, x.start) for x in own} == every and len(own) == len(every) == own[0].n_occurrences > 1
        for k, at in every:
            covered[k].update(range(at, at + size))
    count = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    want = {k: {p for at in range(len(b) - length + 1) if count[b[at : at + length]] > 1 for p in range(at, at + length)} for k, b in raw.items()}
    assert covered == want and len(groups) > 10


def test_maximal_repeats_against_all_pairs():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(2, 9)
        pairs = sorted({("".join(r.choice("ab") for _ in range(r.randint(0, 6))), "x" + "".join(r.choice("ab") for _ in range(r.randint(0, 6)))) for _ in range(n)})
        lefts, rights = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
        counts = [r.choice((1, 1, 2)) for _ in pairs]
        got = {(x, y, tuple(m)) for x, y, m in R.maximal_repeats(lefts, rights, counts, 4)}
        want = set()
        for x in range(7):
            for y in range(1, 8):
                for k, (a, b) in enumerate(zip(lefts, rights)):
                    members = tuple(j for j in range(len(pairs)) if len(a) >= x and len(b) >= y and lefts[j][:x] == a[:x] and rights[j][:y] == b[:y])
                    longer = lambda sides, at: len({s[at : at + 1] or j for j, s in enumerate(sides)}) > 1 or sum(counts[j] for j in members) > 1 and any(len(s) <= at for s in sides)
                    if members and x + y >= 4 and sum(counts[j] for j in members) > 1 and longer([lefts[j] for j in members], x) and longer([rights[j] for j in members], y):
                        want.add((x, y, members))
        assert got == want


def test_intervals():
    strings = sorted(["aab", "aabc", "ab", "abab", "b"])
    common = [R._shared(a.encode(), b.encode()) for a, b in zip(strings, strings[1:])]
    assert sorted(R.intervals(common, 5)) == [(1, 0, 3), (2, 2, 3), (3, 0, 1)]


def test_anchors_are_shared():
    r = random.Random(5)
    same = bytes(r.randrange(97, 123) for _ in range(400))
    a, b = (bytes(r.randrange(97, 123) for _ in range(n)) + same + bytes(r.randrange(97, 123) for _ in range(300)) for n in (50, 777))
    x, y = ({int(p) - n for p in R.anchors(t)[0] if n <= p <= n + 336} for t, n in ((a, 50), (b, 777)))
    assert x & y


def brute_components(rows, n, percent):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets[d] = s
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), None if d is None else find(d)) for d, s in sets.items()}


def test_similar(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)  # several blocks a group
    r = random.Random(11)
    rows = documents()
    base = prose(40, 120).split()
    for k in range(40):  # a chain of near copies around the threshold
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"w{r.randrange(50)}"
        rows.append((200 + k, " ".join(words), "a", "s", 1, 0.0))
    got = J.similar_components(spark, frame(spark, rows), 4, 85).collect()
    want = brute_components(rows, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    kept = J.one_of_each(spark, frame(spark, rows), 4, 85)
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").distinct().collect()) == sorted(str(d) for d, (_, c) in want.items() if d == c)


def test_no_documents_no_components(spark):
    assert J.similar_components(spark, empty(spark)).count() == 0


def test_tree_loses_no_link():
    r = random.Random(2)
    base = [r.getrandbits(60) for _ in range(60)]
    sets = []
    for k in range(60):
        own = set(base[: r.randint(30, 60)]) | {r.getrandbits(60) for _ in range(r.randint(0, 6))}
        sets.append(np.array(sorted(own), np.uint64))
    size = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    linked = {(i, j) for i in range(60) for j in range(i) if 100 * size(sets[i], sets[j]) >= 85 * (len(sets[i]) + len(sets[j]) - size(sets[i], sets[j]))}
    found = J.exact_links(list(range(60)), sets, [True] * 60, 85)
    union = J.Union(range(60))
    for a, b in found:
        union.join(a, b)
    assert linked and all((max(p), min(p)) in linked for p in found) and all(union.find(a) == union.find(b) for a, b in linked)
    pairs = J.possible_pairs(list(range(60)), [len(s) for s in sets], [J.bitmap(s) for s in sets], list(range(60)), [True] * 60, 85)
    assert {(max(p), min(p)) for p in pairs} >= linked


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (5, 5)] + [(100 + k, 101 + k) for k in range(20)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    want = {1: 1, 2: 1, 3: 1, **{k: 10 for k in range(10, 14)}, **{k: 100 for k in range(100, 121)}}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "e").count() == 0


def test_small_graphs_take_few_jobs_and_equal_the_rounds(spark):
    for seed in range(2):
        pick = random.Random(seed)
        edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(160)] + [(1, None), (-5, 2**60)]
        graph, found = spark.createDataFrame(edges, "a long, b long"), []
        for small in ({}, {"small": 0}):
            spark.sparkContext.setJobGroup(f"graph-{seed}-{len(found)}", "components")
            found.append(sorted(map(tuple, components(graph, Scratch(spark, "test"), "c", **small).collect())))
        jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"graph-{seed}-{k}")) for k in range(2)]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
        for _ in label:
            for a, b in edges:
                if a in label and b in label:
                    label[a] = label[b] = min(label[a], label[b])
        assert found[0] == found[1] == sorted(label.items())
        assert jobs[0] <= 8 < jobs[1]
