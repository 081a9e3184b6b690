"""The pipeline: columns, effects of each stage, and clean documents."""

import random

import numpy as np

import corpus_pipeline
from sparkpact.llm import language_id, line_chunks
from sparkpact.llm._common import table

from .data import SCHEMA, prose
from .test_documents import brute_chunks, brute_leak
from .test_similar import brute_components
from .test_tokens import encode

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert k == 4 or docs.columns == names
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.count() == len(ids[-1])
    for before, after in zip(ids, ids[1:]):
        assert after <= before
    assert len(ids[-1]) > 0.7 * len(ids[0])
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    leaked = {d for d in ids[3] if any(x in texts[d] for x in items)}
    last = {r.doc_id: r for r in docs.collect()}
    assert not leaked & set(last) or all(not any(x in last[d].decoded for x in items) for d in leaked & set(last))
    assert ids[3] - ids[4] <= leaked
    assert all(len(r.ids) == 4 * r.n_tokens for r in last.values())


def test_exact_copies_leave_with_line_dedup(spark):
    texts = {k: "\n".join(prose(10 * k + j, 12).replace("\n", " ") for j in range(2 + k)) for k in range(8)}
    rows = [(100 * c + k, texts[k], "aa", "s", len(texts[k]), 0.5) for c in range(1, 4) for k in range(8)]
    rows += [(900 + k, t, "aa", "s", len(t or ""), 0.5) for k, t in enumerate(["one line", "one line", None, texts[7] + "\nits own end"])]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3)
    fragments = line_chunks.dedup_lines(spark, docs).where("doc_id BETWEEN 200 AND 399 AND trim(text) <> ''")
    assert fragments.count() > 0  # chunks alone leave parts of copies
    got = corpus_pipeline.drop_repeated_lines(spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(100, 108), *range(100, 103), *range(900, 904)])
    left = {r.doc_id: r for r in got}
    assert all(left[100 + k].text == texts[k] for k in range(8)) and "its own end" in left[903].text
    whole = {r.doc_id: r for r in line_chunks.dedup_lines(spark, docs, whole=True).collect()}
    assert all(whole[d].text == "" and whole[d].n_removed == whole[d].n_chunks > 0 for d in range(200, 208)) and whole[902].n_removed == 0


def test_run_matches_brute_force(spark, tmp_path):
    """run()'s rows against plain Python for every stage after the language model's scores."""
    r = random.Random(12)
    kinds = {"en": ("the", "and", "ing", "sh"), "de": ("oede", "ung", "sch", "ei")}
    rows = [(k, "\n".join(prose(50 * k + j, 14, kinds[lang]).replace("\n", " ") for j in range(1 + k % 5)), lang) for k in range(60) for lang in (("en", "de")[k % 2],)]
    items = [(k, prose(900 + k, 30, kinds["en"])) for k in range(4)] + [(4, "zq wx"), (5, None)]
    text = dict((d, t) for d, t, _ in rows)
    rows += [(100 + k, text[k], "en") for k in range(0, 20, 3)]  # exact copies
    rows += [(200 + k, text[k] + "\n" + prose(2000 + k, 14, kinds["en"]), "en") for k in range(3, 25, 5)]  # shared lines
    for k in range(30, 40):  # near copies of longer texts
        words = prose(3000 + k, 90, kinds["en"]).replace("\n", " ").split(" ")
        rows.append((300 + k, " ".join(words), "en"))
        words[r.randrange(len(words))] = "changed"
        rows.append((400 + k, " ".join(words), "en"))
    rows += [(500 + k, text[k] + " " + t + " more", "en") for k, t in items if t]  # leaks
    rows += [(600, None, "en"), (601, "", "en"), (602, "12 — 34", "en"), (603, "жшщ эюя " * 30, None), (None, prose(77, 40, kinds["de"]), "de"), (604, "the and", None)]
    rows += rows[:2]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = sorted(((str(x.doc_id), x.n_tokens, x.decoded, np.frombuffer(bytes(x.ids), "<u4").tolist()) for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()))

    model = language_id.fit(docs)
    left = []
    for d, t, _ in rows:
        grams = language_id.presence(t)
        if grams is not None and model.scores([grams]).max() >= (0.35 if len(grams) >= 150 else 0.12):
            left.append((d, t))
    assert not {600, 601, 602, 603} & {d for d, _ in left} and len(left) > len(rows) - 12

    # lines: whole copies of several lines, then chunks, each but for the first by doc_id; rows that repeat are one
    key = lambda x: (x[0] is not None, x[0] or 0)
    seen_text, seen_chunk, cut = set(), set(), {}
    for d, t in sorted(set(left), key=key):
        copied = "\n" in t and t in seen_text
        seen_text.add(t)
        kept = []
        for c in brute_chunks(t) if "\n" in t else [t]:
            counts = "\n" in c and len([x for x in c.split("\n") if x.strip(" ")]) >= 2
            if not (counts and c in seen_chunk):
                kept.append(c)
            if counts:
                seen_chunk.add(c)
        cut[d, t] = "" if copied else "\n".join(kept)
    left = [(d, cut[d, t], t) for d, t in left]
    left = [(d, t) for d, t, before in left if t == before or t.strip(" ")]
    heads = brute_components([(d, t) for d, t in left], 5, 80)
    left = [(d, t) for d, t in left if d is None or heads[d][1] == d]
    left = [(d, t) for d, t in left if not any(brute_leak(t, item) for _, item in items if item)]
    want = sorted((str(d), len(ids := encode(t)), t, ids) for d, t in left)
    assert got == want
    ids = {d for d, _ in left}
    assert not ids & {100 + k for k in range(0, 20, 3) if k % 5} and not ids & set(range(430, 440)) and not ids & set(range(500, 505)) and len(ids & set(range(60))) > 50
