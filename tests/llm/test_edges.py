"""Every operator on the awkward inputs: nulls, empty, blank and very long texts, ties, repeated rows and doc_ids, empty
tables, and extra columns whose names clash with the operators' own."""

import pytest
from pyspark.sql import functions as F

from sparkpact.llm import bpe_codec, decontaminate, jaccard_join, language_id, line_chunks, quality_rules, repeat_spans, sharding, token_counts, token_records
from sparkpact.llm._common import Scratch, importable

from .data import documents, empty, frame, prose

CLASHES = [
    "_lines", "_h", "_cuts", "_chunks", "_hash0", "_removed", "_id", "_hash", "_row", "_own", "_head", "head", "th", "key", "place", "again", "virtual_slot",
    "rank", "token", "tokens", "bits", "component_id", "cluster", "anchor", "spans", "word", "label", "is_trusted", "bucket", "grams", "n_removed", "item_id", "size",
]


@pytest.fixture(autouse=True)
def ready(spark):
    importable(spark)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0, "x") for k in range(0, 20)] + [(None, 1, 0, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, is_trusted string")


def items(spark):
    return spark.createDataFrame([(1, prose(99, 120), 5), (2, "word", 5), (2, None, 5), (None, "", 5)], "item_id long, text string, doc_id int")


def records(spark, docs):
    directory = Scratch(spark, "edges").path("records")
    token_records.write_records(docs, directory)
    return token_records.read_digests(spark, directory)


OPERATORS = {
    "op1": lambda spark, docs: quality_rules.quality(spark, docs, labels(spark)),
    "op2": lambda spark, docs: sharding.assign(spark, docs).select("doc_id", "size", "text_crc32", "law"),
    "op3": lambda spark, docs: language_id.predict(spark, docs, language_id.fit(docs)),
    "op4": lambda spark, docs: line_chunks.dedup_lines(spark, docs).select("doc_id", "text", "n_chunks", F.col("n_removed").cast("int")),
    "op4 whole": lambda spark, docs: line_chunks.dedup_lines(spark, docs, True).select("doc_id", "text", "n_chunks", F.col("n_removed").cast("int")),
    "op5": lambda spark, docs: repeat_spans.remove_repeats(spark, docs),
    "op6": lambda spark, docs: jaccard_join.similar_components(spark, docs),
    "op6 one": lambda spark, docs: jaccard_join.one_of_each(spark, docs).select("doc_id", "text"),
    "op7": lambda spark, docs: token_counts.token_budget(docs, 10),
    "op8": lambda spark, docs: records(spark, docs),
    "op9": lambda spark, docs: bpe_codec.encode_decode_digests(spark, docs),
    "op10": lambda spark, docs: decontaminate.matches(spark, docs, items(spark)),
    "op10 clean": lambda spark, docs: decontaminate.keep_clean(spark, docs, items(spark)).select("doc_id", "text"),
}
#: Operators with a row for each row of the input.
EVERY_ROW = set(OPERATORS) - {"op6 one", "op10", "op10 clean"}


def awkward():
    rows = documents()
    rows += [(40, prose(77, 20_000), "aa", "s", 1, 0.5), (41, None, None, None, None, None), (41, rows[8][1], "bb", "s", 1, 0.5), (41, rows[12][1], "aa", "s", 1, 0.5)]
    return rows + rows[:4] + [(None, None, None, None, None, None)] * 2


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    rows, run = awkward(), OPERATORS[name]
    docs = frame(spark, rows)
    got = run(spark, docs)
    want = plain(got)
    if name in EVERY_ROW:
        assert sorted(str(r[0]) for r in want) == sorted(str(r[0]) for r in rows)
    clashing = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    again = run(spark, clashing)
    assert again.columns == got.columns and plain(again) == want  # also: another order of rows, the same result
    assert run(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["dedup", "one", "clean", "language"])
def test_extra_columns_stay(spark, name):
    docs = frame(spark, awkward()).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES if c != "n_removed"))
    model = language_id.fit(docs)
    out = {
        "dedup": lambda: line_chunks.dedup_lines(spark, docs),
        "one": lambda: jaccard_join.one_of_each(spark, docs),
        "clean": lambda: decontaminate.keep_clean(spark, docs, items(spark)),
        "language": lambda: language_id.keep_identified(spark, docs, model, 0.1),
    }[name]()
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 5
    extra = [c for c in CLASHES if c != "n_removed"]
    assert all(tuple(r[c] for c in extra) == tuple(f"own {c}" for c in extra) for r in out.select(extra).distinct().collect())


def test_one_node_for_each_doc_id(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(3, a), (4, b), (5, a), (5, b), (6, b + " end"), (7, None), (7, c), (8, c), (2, c), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_components(spark, docs, 4, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (4, 3), (5, 3), (6, 3), (7, 2), (8, 2), (2, 2), (9, 9)} and len(got) == len(rows)


def test_repeated_rows_do_not_grow_the_language_sample(spark):
    rows = [(7, prose(7, 30), "aa", "s", 1, 0.0)] * 2000 + [(k, prose(k, 30, ("öd", "ung")), "bb", "s", 1, 0.0) for k in range(100, 160)] + [(k, "12 — 34", "cc", "s", 1, 0.0) for k in range(200, 240)]
    docs = frame(spark, rows)
    assert language_id.training_rows(docs).count() <= 1 + 60 + 40
    model = language_id.fit(docs)
    assert set(model.languages) <= {"aa", "bb"}  # the letterless one is not learned
    assert language_id.training_rows(docs, 5).groupBy("lang").count().agg(F.max("count")).first()[0] == 5
