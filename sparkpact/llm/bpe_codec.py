"""Exact byte-level BPE over whole texts: a transducer lexicon, and exact merges for words outside it.

``TransducerLexicon`` is a minimal acyclic automaton (shared suffixes) built from sorted words. Its states carry
the number of accepted words below each edge, so walking a word yields its rank among the sorted words; the rank
points into one array of token ids. All arrays lie in one file that workers map into memory.

``WordCodec`` cuts a text where the pre-tokenizer must cut it (before every single space that stands between two
non-space characters), resolves each distinct piece once, first in the lexicon and else by an exact merge, and
joins the id bytes. Pieces with uncommon characters, and texts with longer runs of white space, take the
library's own path, so the result always equals the library's.
"""

from __future__ import annotations

import base64
import hashlib
import json
import mmap
import re
import struct
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import released, text_runs

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LEXICON_WORDS = 1 << 16
MIN_LOCAL_COUNT = 3
MEMO_ENTRIES = 200_000
_MAGIC = b"MATL0001"


# ---------------------------------------------------------------- lexicon

def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """Serialize {word: ids} as a minimal acyclic transducer.

    Layout: magic, 5 counts, then int32 first-edge offsets, uint8 labels, int32 targets, int32 word counts before
    the edge, uint8 final flags, int32 id offsets by rank, int32 ids. An empty dictionary gives a valid lexicon
    that accepts nothing; the empty word is not allowed.
    """
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes: [final, [(label, state)]]
    labels: list[int] = []
    previous = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = freeze(path.pop())
            path[-1][1].append((labels.pop(), state))

    for word in ordered:
        common = 0
        limit = min(len(word), len(previous))
        while common < limit and word[common] == previous[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(path[0])

    below = [0] * len(states)
    for s, (final, edges) in enumerate(states):  # children are frozen before their parents
        below[s] = final + sum(below[t] for _, t in edges)
    first, label, target, before = [0], [], [], []
    for final, edges in states:
        seen = int(final)
        for b, t in edges:
            label.append(b)
            target.append(t)
            before.append(seen)
            seen += below[t]
        first.append(len(label))
    offsets, ids = [0], []
    for word in ordered:
        ids.extend(words[word])
        offsets.append(len(ids))
    head = struct.pack("<8s5q", _MAGIC, root, len(states), len(label), len(ordered), len(ids))
    parts = [np.array(x, dtype) for x, dtype in ((first, "<i4"), (target, "<i4"), (before, "<i4"), (offsets, "<i4"), (ids, "<i4"), (label, "u1"), ([f for f, _ in states], "u1"))]
    return head + b"".join(p.tobytes() for p in parts)


class TransducerLexicon:
    def __init__(self, data):
        magic, self.root, n_states, n_edges, self.n_words, n_ids = struct.unpack_from("<8s5q", data)
        if magic != _MAGIC:
            raise ValueError("not a transducer lexicon")
        at = 48

        def take(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.first, self.target, self.before = take(n_states + 1, "<i4"), take(n_edges, "<i4"), take(n_edges, "<i4")
        self.offsets, self.ids = take(self.n_words + 1, "<i4"), take(n_ids, "<i4")
        self.label, self.final = take(n_edges, "u1"), take(n_states, "u1")
        # edges sorted by (state, label): one search finds a transition
        self.edge_key = np.repeat(np.arange(n_states, dtype=np.int64), np.diff(self.first)) * 256 + self.label

    @classmethod
    def open(cls, path: str) -> TransducerLexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the lexicon's sorted words, -1 for words that are not in it."""
        n = len(words)
        if not n or not len(self.edge_key):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        chars = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        step = 0
        while len(live):
            key = state[live] * 256 + chars[starts[live] + step]
            edge = np.searchsorted(self.edge_key, key)
            edge[edge == len(self.edge_key)] = 0
            hit = self.edge_key[edge] == key
            state[live[~hit]] = -1
            live, edge = live[hit], edge[hit]
            rank[live] += self.before[edge]
            state[live] = self.target[edge]
            step += 1
            live = live[lengths[live] > step]
        accepted = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(accepted, rank, -1)

    def id_bytes(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tobytes()


# ---------------------------------------------------------------- exact merges

def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Textbook BPE merge of one pre-token (the brute-force form that tests compare with)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Characters on whose class (letter, number, space, other) all pre-tokenizer versions agree.
_COMMON = re.compile("[\t\n\r -~¡-ɏΑ-ωА-я‐-‧‰-⁞]*")


#: A space beside other white space.
_MIXED = re.compile(r" \s|\s ")


class _Pieces(dict):
    """Memo of pieces: str keys stand for a space and that text, (str,) keys for the start of a text.

    Values are little-endian int32 ids, or None for a piece at which the text can't be cut: an empty one, one
    that starts or ends with white space, or one that holds a special token.
    """

    def __init__(self, codec: WordCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, key):
        piece = key if isinstance(key, str) else key[0]
        if not piece or piece != piece.strip() or any(s in piece for s in self.codec.specials):
            out = None
        else:
            out = self.codec.merge(" " + piece if piece is key else piece)
        self[key] = out
        return out


class WordCodec:
    def __init__(self, tokenizer_path: str, ranks_path: str, lexicon: TransducerLexicon | None = None):
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        self.vocabulary = 1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in added))
        del spec
        self.tokenizer_path, self._library = tokenizer_path, None
        self.specials = [t["content"] for t in added]
        ranks = load_ranks(ranks_path)
        self.merges = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * self.vocabulary
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for t in added:
            self.token_bytes[t["id"]] = t["content"].encode()
        self.token_length = np.array([len(t) for t in self.token_bytes], np.int64)
        self.lexicon = lexicon
        self.memo = _Pieces(self)

    @property
    def library(self):
        """The library's tokenizer, loaded when a text first needs it: most never do, and it is large."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.tokenizer_path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def merge(self, piece: str) -> bytes:
        if _COMMON.fullmatch(piece):
            ids = self.merges.encode_ordinary(piece)
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return array("i", ids).tobytes()

    def _resolve(self, texts: list[list[str]]) -> None:
        """Look the pieces that the memo lacks up in the lexicon, and merge the rest, all at once.

        Pieces that need more care than that are left to the memo, which merges them when they are met.
        """
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = set().union(*texts).difference(memo)
        new.discard("")
        new = list(new)
        joined = " " + " ".join(new)
        if _MIXED.search(joined) or joined[-1].isspace() or not _COMMON.fullmatch(joined) or any(s in joined for s in self.specials):
            new = [p for p in new if _COMMON.fullmatch(p) and p == p.strip() and not any(s in p for s in self.specials)]
        coded = [p.encode() for p in new]
        if self.lexicon is not None:
            ranks = self.lexicon.ranks(coded)  # the lexicon holds pieces that are met after a space
            for i in np.flatnonzero(ranks >= 0).tolist():
                memo[new[i]] = self.lexicon.id_bytes(int(ranks[i]))
            rest = np.flatnonzero(ranks < 0).tolist()
            new, coded = [new[i] for i in rest], [coded[i] for i in rest]
        for at in range(0, len(new), 50_000):
            run = new[at : at + 50_000]
            ids = self.merges.encode_to_numpy(" " + " ".join(run), disallowed_special=()).astype("<i4")
            lengths = np.fromiter(map(len, coded[at : at + 50_000]), np.int64, len(run)) + 1
            ends = np.searchsorted(np.cumsum(self.token_length[ids]), np.cumsum(lengths)) + 1
            data, begin = ids.tobytes(), 0
            for piece, end in zip(run, (ends * 4).tolist()):
                memo[piece] = data[begin:end]
                begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian int32 bytes; null counts as empty."""
        cut = [t.split(" ") if t else [] for t in texts]
        self._resolve(cut)
        memo, out = self.memo, []
        for text, parts in zip(texts, cut):
            try:
                out.append(memo[(parts[0],)] + b"".join(map(memo.__getitem__, parts[1:])) if text else b"")
            except TypeError:  # a piece at which the text can't be cut
                out.append(array("i", self._general(text)).tobytes())
        return out

    def _general(self, text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not any(s in text for s in self.specials):
            return self.merges.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: bytes) -> str:
        """Text of little-endian int32 ids, special tokens included."""
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")


_CODECS: dict[tuple, WordCodec] = {}


def codec(tokenizer_path: str, ranks_path: str, lexicon_file: str | None = None) -> WordCodec:
    """The process-wide codec of a Python worker."""
    key = (tokenizer_path, ranks_path, lexicon_file)
    if key not in _CODECS:
        _CODECS.clear()
        lexicon = TransducerLexicon.open(SparkFiles.get(lexicon_file)) if lexicon_file else None
        _CODECS[key] = WordCodec(tokenizer_path, ranks_path, lexicon)
    return _CODECS[key]


# ---------------------------------------------------------------- Spark operators

def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent pieces of the whole corpus: word, n. Ties go to the smaller word.

    Each task counts its pieces exactly and sends those that occur MIN_LOCAL_COUNT times or more in a run of
    about 16 MB, so rare words never leave it; the lexicon decides speed only, never ids.
    """

    def count(batches):
        total, size = Counter(), 0

        def rows():
            kept = [(w, n) for w, n in total.items() if n >= MIN_LOCAL_COUNT and len(w) <= 64]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for _, texts in text_runs(batch, "text"):
                for t in texts:
                    if t:
                        total.update(t.split(" ")[1:])
                        size += len(t)
                if size > 16 << 20 or len(total) > 300_000:
                    yield rows()
                    size = 0
        yield rows()

    counted = docs.select("text").mapInArrow(released(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)


def build_lexicon(spark: SparkSession, docs: DataFrame, tokenizer_path: str, ranks_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the lexicon (at most ``words`` entries, a bounded file) and ship it; returns its file name."""
    from ._common import Scratch, shared_dir

    # written first: the tasks' top words then meet in an executor, and the driver gets ``words`` rows only
    top = [r.word for r in Scratch(spark, "lexicon").write(frequent_words(docs, words), "words").collect()]
    own = codec(tokenizer_path, ranks_path)
    data = compile_lexicon({w.encode(): tuple(np.frombuffer(ids, "<i4").tolist()) for w in top if (ids := own.memo[w])})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.mat"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexicons/{name}")  # by content: a second run finds it
    store = path.getFileSystem(conf)
    if not store.exists(path):
        out = store.create(path, True)
        out.write(data)
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), n_tokens, decoded text of every whole text.

    A null text counts as empty: no ids, empty decoded text. Repeated rows give repeated results. Other columns
    of ``docs`` are not read.
    """
    return _coded(spark, docs, tokenizer_path, ranks_path, lexicon_words, False)


def encode_decode_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """As ``encode_decode``, with sha256 digests of ids and decoded text in their place: nothing long leaves a task."""
    return _coded(spark, docs, tokenizer_path, ranks_path, lexicon_words, True)


def _coded(spark, docs, tokenizer_path, ranks_path, lexicon_words, digests):
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    name = build_lexicon(spark, docs, tokenizer_path, ranks_path, lexicon_words) if lexicon_words else None

    def run(batches):
        own = codec(tokenizer_path, ranks_path, name)
        for batch in batches:
            doc_ids = batch.column(0)
            for start, texts in text_runs(batch, "text"):
                ids = own.encode(texts)
                decoded = map(own.decode, ids)
                if digests:
                    a = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    b = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())
                else:
                    a, b = pa.array(ids, pa.binary()), pa.array(list(decoded), pa.string())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), a, b], names)
        own.memo.clear()  # the worker lives on, and other operators need its memory

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = ["long", "long", "string", "string"] if digests else ["long", "long", "binary", "string"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
