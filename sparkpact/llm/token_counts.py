"""Token counts by prefix dynamic programming.

For byte-level BPE the encoding of every prefix of a pre-token is known from its last token: a token t ending at
byte i follows the encoding of the prefix before it if and only if merging last-token + t gives those two tokens
back. One table entry a byte therefore holds the exact token count of each prefix. Counts of a text are running
sums over its pieces, so truncation and budget questions need no further encoding.

Pieces are cut as in ``bpe_codec`` and share their tables: new pieces of a batch are sorted, and each starts from
the rows of the common prefix with its neighbour.
"""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_runs
from .bpe_codec import _COMMON, MEMO_ENTRIES, RANKS, TOKENIZER, WordCodec, load_ranks

_CONTRACTIONS = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Exact token counts of every prefix of whole characters of a text."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        self.codec = WordCodec(tokenizer_path, ranks_path)
        self.ranks = load_ranks(ranks_path)
        self.longest = max(map(len, self.ranks))
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of = self.codec.token_bytes
        self.single = self.codec.merges._core_bpe.encode_single_piece
        self.joins: dict[int, bool] = {}
        self.memo: dict = {}
        self.classes = _Classes(self.codec)

    def _follows(self, last: int, token: int) -> bool:
        key = last << 32 | token
        out = self.joins.get(key)
        if out is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            out = self.joins[key] = self.single(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        return out

    def tables(self, words: list[bytes]) -> dict[bytes, bytes]:
        """For each pre-token the int16 changes of the count from each byte prefix to the next."""
        out: dict[bytes, bytes] = {}
        get, longest, follows = self.ranks.get, self.longest, self.joins.get
        last, count, change, previous = [-1], [0], array("h"), b""
        for word in sorted(words):
            size, common = len(word), 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                common += 1
            del last[common + 1 :], count[common + 1 :], change[common:]
            for i in range(common + 1, size + 1):
                for j in range(i - longest if i > longest else 0, i):
                    token = get(word[j:i])
                    if token is None:
                        continue
                    before = last[j]
                    if before >= 0:
                        ok = follows(before << 32 | token)
                        if ok or ok is None and self._follows(before, token):
                            break
                    elif i == 1 or self.single(word[:i]) == [token]:
                        break
                last.append(token)
                count.append(count[j] + 1)
                change.append(count[i] - count[i - 1])
            previous = word
            out[word] = change.tobytes()
        return out

    def _words(self, text: str) -> tuple[list[str], list[bool]]:
        """Pre-tokens of a text, and whether each is white space.

        Characters on whose class the libraries' Unicode versions may differ stand as one of the class that the
        tokenizer itself gives them; the pattern is run on the text so changed.
        """
        if _COMMON.fullmatch(text):
            words = self.words.findall(text)
            return words, [w.isspace() for w in words]
        alike = text.translate(self.classes)
        spans = [m.span() for m in self.words.finditer(alike)]
        return [text[a:b] for a, b in spans], [alike[a:b].isspace() for a, b in spans]

    def _changes(self, words: list[str], blank: list[bool], table: dict[bytes, bytes]) -> bytes:
        """Joined changes of consecutive pre-tokens, corrected where a cut text has other pre-tokens.

        A contraction is none before it is whole. A run of white space is one pre-token when the text ends with it;
        before other text its last character stands alone or with that text. ``owed`` is what the count of the run
        differs from the sum of the two, due when the text goes on.
        """
        parts, owed = [], 0
        for k, w in enumerate(words):
            change = table[w.encode()]
            run = k > 0 and blank[k - 1] and (blank[k] or w[0] == " ")
            if w in _CONTRACTIONS or run or owed:
                fixed = np.frombuffer(change, "<i2").copy()
                if w in _CONTRACTIONS:
                    fixed[:] = 1, 1, fixed.sum() - 2
                fixed[0] += owed
                owed = 0
                if run:
                    size = len(w[0].encode())
                    whole = (words[k - 1] + w[0]).encode()
                    added = int(np.frombuffer(self.tables([whole])[whole], "<i2").sum() - np.frombuffer(table[words[k - 1].encode()], "<i2").sum())
                    owed = int(fixed[:size].sum()) - added
                    fixed[size - 1] -= owed
                    if size < len(fixed):
                        fixed[size] += owed
                        owed = 0
                change = fixed.tobytes()
            parts.append(change)
        return b"".join(parts)

    def _fill(self, keys: list, texts: list[str]) -> None:
        cut = [self._words(t) if not (t.isascii() and (t[0] == " " or t[0].isalpha()) and t[1:].isalpha()) else ([t], [False]) for t in texts]
        table = self.tables(list({w.encode() for words, _ in cut for w in words}))
        memo, special = self.memo, _CONTRACTIONS
        for key, (words, blank) in zip(keys, cut):
            if len(words) == 1 and words[0] not in special:
                memo[key] = table[words[0].encode()]
            else:
                memo[key] = self._changes(words, blank, table)

    def changes(self, texts: list[str | None]) -> list[bytes]:
        """Changes of the token count at every byte (little-endian int16) of each whole text; null counts as empty."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        specials = self.codec.specials
        cut: list = []
        for t in texts:
            parts = t.split(" ") if t else []
            cut.append(parts)
        new = set().union(*cut).difference(self.memo)
        sound = [p for p in new if p and p == p.strip() and not any(s in p for s in specials)]
        self._fill(sound, [" " + p for p in sound])
        firsts = list({(c[0],) for c in cut if c}.difference(self.memo))
        firsts = [f for f in firsts if f[0] and f[0] == f[0].strip() and not any(s in f[0] for s in specials)]
        self._fill(firsts, [f[0] for f in firsts])
        memo, out = self.memo, []
        for text, parts in zip(texts, cut):
            try:
                out.append(memo[(parts[0],)] + b"".join(map(memo.__getitem__, parts[1:])) if text else b"")
            except KeyError:
                out.append(self._general(text))
        return out

    def _ordinary(self, text: str) -> bytes:
        words, blank = self._words(text)
        return self._changes(words, blank, self.tables(list({w.encode() for w in words})))

    def _general(self, text: str) -> bytes:
        """Texts with special tokens or longer runs of white space.

        Before its last byte a special token is ordinary text that may share pre-tokens with what stands before it;
        with that byte the text before counts as if it ended there, and the token as one.
        """
        special = "|".join(map(regex.escape, self.codec.specials))
        runs = regex.split(f"({special})", text) if special else [text]
        parts = []
        for k in range(0, len(runs), 2):
            before = len(runs[k].encode())
            token = runs[k + 1] if k + 1 < len(runs) else ""
            change = self._ordinary(runs[k] + token[:-1])
            parts.append(change)
            if token:
                parts.append(np.array([1 - np.frombuffer(change, "<i2")[before:].sum(dtype=np.int64)], "<i2").tobytes())
        return b"".join(parts)


class _Classes(dict):
    """Character -> itself, or one of its class (letter, number, white space, other) as the tokenizer sees it."""

    def __init__(self, codec: WordCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not _COMMON.fullmatch(c):
            cut = self.codec.library.pre_tokenizer.pre_tokenize_str
            c = next((own for own in ("é", "1", "!") if len(cut(own + c)) == 1), "\t")
        self[code] = c
        return c


_COUNTERS: dict[tuple[str, str], PrefixCounter] = {}


def counter(tokenizer_path: str, ranks_path: str) -> PrefixCounter:
    key = (tokenizer_path, ranks_path)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(tokenizer_path, ranks_path)
    return _COUNTERS[key]


def prefix_counts(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_changes (binary int16 a byte: change of the token count).

    The running sum of ``prefix_changes`` up to byte i is the exact token count of the first i bytes where these are
    whole characters, so ``fit_bytes`` and ``count_at`` answer budget questions from this table alone. A null text
    counts as empty.
    """
    return _counted(docs, tokenizer_path, ranks_path, None)


def token_budget(docs: DataFrame, limit: int, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fit_bytes: the longest prefix in whole characters with ``limit`` tokens at most.

    Answers come from the prefix table of each document; the table itself stays in the task.
    """
    return _counted(docs, tokenizer_path, ranks_path, limit)


def fit_bytes(changes: bytes, raw: bytes, limit: int) -> int:
    """Bytes of the longest prefix of whole characters that has ``limit`` tokens at most."""
    count = np.concatenate(([0], np.cumsum(np.frombuffer(changes, "<i2"), dtype=np.int64)))
    data = np.frombuffer(raw, np.uint8)
    whole = np.concatenate(((data & 0xC0) != 0x80, [True]))
    return int(np.flatnonzero((count <= limit) & whole)[-1])


def count_at(changes: bytes, n_bytes: int) -> int:
    """Token count of the first ``n_bytes`` bytes."""
    return int(np.frombuffer(changes, "<i2")[:n_bytes].sum(dtype=np.int64))


def _counted(docs, tokenizer_path, ranks_path, limit):
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def run(batches):
        own = counter(tokenizer_path, ranks_path)
        for batch in batches:
            doc_ids = batch.column(0)
            for start, texts in text_runs(batch, "text"):
                changes = own.changes(texts)
                tokens = [int(np.frombuffer(c, "<i2").sum(dtype=np.int64)) for c in changes]
                if limit is None:
                    last = pa.array(changes, pa.binary())
                else:
                    last = pa.array([len(c) // 2 if n <= limit else fit_bytes(c, t.encode(), limit) for c, n, t in zip(changes, tokens, texts)], pa.int64())
                sizes = pa.array([len(c) // 2 for c in changes], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(texts)), sizes, pa.array(tokens, pa.int64()), last], names)

    names = ["doc_id", "n_bytes", "n_tokens", "prefix_changes" if limit is None else "fit_bytes"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_bytes long, n_tokens long, {names[3]} {'binary' if limit is None else 'long'}")
