"""Tokens: every result against the tokenizers library."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from tokenizers import Tokenizer

from sparkpact.llm import bpe_codec as B
from sparkpact.llm import token_counts as C
from sparkpact.llm import token_records as R
from sparkpact.llm._common import Scratch, importable

from .data import documents, empty, frame

LIBRARY = Tokenizer.from_file(P.path(B.TOKENIZER))


def encode(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    words = [" the", " of", "ab", "abc", "b"]
    own = B.WordCodec(P.path(B.TOKENIZER), P.path(B.RANKS))
    return own, {w: own.merge(w) for w in words}


def test_lexicon():
    words = {w.encode(): tuple(range(k)) for k, w in enumerate(["a", "ab", "abc", "b", "bc", "xbc", "日本"])}
    lexicon = B.TransducerLexicon(B.compile_lexicon(words))
    ranks = lexicon.ranks([*words, b"", b"zz", b"abcd", b"x"])
    assert [np.frombuffer(lexicon.id_bytes(r), "<i4").tolist() for r in ranks[: len(words)]] == [list(v) for v in words.values()]
    assert ranks[len(words) :].tolist() == [-1] * 4
    assert len(lexicon.final) < sum(len(w) for w in words)  # suffixes are shared
    assert B.TransducerLexicon(B.compile_lexicon({})).ranks([b"a"]).tolist() == [-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .\n\t'sé½日 \x1c<|>")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(texts):
    own = B.codec(P.path(B.TOKENIZER), P.path(B.RANKS))
    got = own.encode(texts)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [encode(t) for t in texts]
    assert [own.decode(g) for g in got] == texts
    counts = C.counter(P.path(B.TOKENIZER), P.path(B.RANKS)).changes(texts)
    assert [C.count_at(c, len(c)) for c in counts] == [len(encode(t)) for t in texts]


def test_merge_matches_textbook(codec):
    ranks = B.load_ranks(P.path(B.RANKS))
    for word in (" hello", " unbelievable", "xyzzy", " naïve"):
        assert B.merge_ids(word.encode(), ranks) == encode(word)


AWKWARD = list("ab .\n\t\r'sd1é½日\u3000\xa0\x1c\x85!-") + [" ", " ", "\n", "'s", "'re", "'ll", "'ve", "'stion", "re", "  ", "\n\n", "<|endoftext|>", "<|endof", "text|>", " the", "ing", "😀", "\u180e", "\u200b", "\U0001e5d0"]


def test_every_prefix():
    own = C.counter(P.path(B.TOKENIZER), P.path(B.RANKS))
    r = random.Random(17)
    texts = ["they're we'll I've it's", "a   b \n\n c", documents()[0][1][:300], "Ünïcode ½² naïve text", "'stion", "'re", " \n\naa", "a!!<|endoftext|>  <|endoftext|>'s", "\u3000\u3000x", " \xa0\xa0're"]
    texts += ["".join(r.choice(AWKWARD) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    for text, change in zip(texts, own.changes(texts)):
        assert len(change) == 2 * len(text.encode())
        for i in range(len(text) + 1):
            assert C.count_at(change, len(text[:i].encode())) == len(encode(text[:i])), (text, text[:i])
        fit = C.fit_bytes(change, text.encode(), 5)
        assert len(encode(text.encode()[:fit].decode())) <= 5


def test_every_character():
    """Totals around each code point of the planes in use, whatever Unicode version each library has."""
    own = C.counter(P.path(B.TOKENIZER), P.path(B.RANKS))
    codes = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)}b" for c in codes[k : k + 64]) for k in range(0, len(codes), 64)]
    for text, change in zip(texts, own.changes(texts)):
        assert C.count_at(change, len(change)) == len(encode(text)), text


def test_counts(spark):
    importable(spark)
    rows = C.token_budget(frame(spark), 512).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(encode(r[1]))) for r in documents())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    whole = {r.doc_id: r for r in C.prefix_counts(frame(spark)).collect()}
    assert all(C.count_at(bytes(r.prefix_changes), r.n_bytes) == r.n_tokens for r in whole.values())
    assert C.token_budget(empty(spark), 5).count() == 0


def test_round_trip(spark):
    importable(spark)
    for words in (0, 50):
        rows = B.encode_decode_digests(spark, frame(spark), lexicon_words=words).collect()
        want = [(str(d), hashlib.sha256(np.array(encode(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in documents()]
        assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert {r.decoded for r in B.encode_decode(spark, frame(spark)).collect()} == {t or "" for _, t, *_ in documents()}
    assert B.encode_decode(spark, empty(spark)).count() == 0


def test_records(spark):
    importable(spark)
    directory = Scratch(spark, "test").path("records")
    manifest = R.write_records(frame(spark), directory)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(documents())
    rows = R.read_digests(spark, directory).collect()
    docs = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for d, t, *_ in docs:
        ids = [*encode(t), 2]
        want.append((str(d), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    back = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in R.read_records(spark, directory).collect()}
    assert back[6] == [*encode("word"), 2]
    none = Scratch(spark, "test").path("none")
    assert R.write_records(empty(spark), none).count() == 0 and R.read_digests(spark, none).count() == 0 and len(R.Records(spark, none)) == 0


def test_shuffled_reads(spark):
    importable(spark)
    directory = Scratch(spark, "test").path("records")
    R.write_records(frame(spark), directory)
    texts = {d: t for d, t, *_ in documents()}
    records = R.Records(spark, directory)
    order = list(range(len(records)))
    random.Random(4).shuffle(order)
    got = {n: records[n] for n in order}
    assert [got[n][0] for n in sorted(got)] == sorted((d for d, *_ in documents()), key=lambda d: (d is not None, d or 0))
    assert all(ids.tolist() == [*encode(texts[d]), 2] for d, ids in got.values())
    with pytest.raises(IndexError):
        records[len(records)]
    chosen = spark.createDataFrame([(12,), (3,), (12,), (5,), (None,), (777,)], "doc_id int")
    rows = R.read_chosen(spark, directory, chosen).collect()
    assert sorted(r.doc_id for r in rows) == [3, 5, 5, 12]  # doc_id 5 has two records
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == [*encode(texts[r.doc_id]), 2] and r.n_tokens == len(r.ids) // 4 for r in rows)


def test_attempts_that_failed_leave_nothing(spark):
    """Files of attempts that no manifest names are not read, and are gone at the end; a second write is refused."""
    importable(spark)
    directory = Scratch(spark, "test").path("records")
    folder = Path(directory.removeprefix("file://"))
    folder.mkdir(parents=True)
    for kind in ("rec", "idx"):
        (folder / f"shard-000000-99999.{kind}").write_bytes(b"half a record")
    manifest = R.write_records(frame(spark), directory)
    assert {f.stem for f in folder.glob("shard-*")} == {r.name for r in manifest.collect()}
    assert R.read_records(spark, directory).count() == len(documents())
    with pytest.raises(AnalysisException):
        R.write_records(frame(spark), directory)


def test_one_hot_key_is_many_shards(spark):
    importable(spark)
    directory = Scratch(spark, "test").path("records")
    rows = [(None, "hot text")] * 3000 + [(k, f"own {k}") for k in range(60)]
    R.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), directory, shards=4)
    sizes = [r.n_docs for r in spark.read.parquet(f"{directory}/manifest").collect()]
    assert sum(sizes) == 3060 and max(sizes) < 1600


def test_damage_is_found():
    record = R.frame(b"payload")
    assert R.unframe(memoryview(record), 0) == b"payload"
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises((ValueError, Exception)):
            R.unframe(memoryview(bytes(bad)), 0)
