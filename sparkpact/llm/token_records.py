"""Length-delimited binary token records with masked checksums, and a separate offset index.

A shard file holds one record a document, in ascending doc_id order within and across shards:
uint64 payload length, uint32 masked crc32 of those eight bytes, payload, uint32 masked crc32 of the payload
(all little-endian; mask: rotate right by 15 bits and add 0xa282ead8). The payload holds the token ids and the end
id, two bytes each where the vocabulary allows it, else four. ``<shard>.idx`` holds for each record the doc_id
(int64), a null flag (int64), the byte offset and the number of ids (uint64 each), so records can be read in any
order: ``read_chosen`` reads those of some documents, ``Records`` any record by its number.

Each task writes its shard under a name of its own attempt, and the manifest, a table that Spark commits with the job,
names the shards that count. A task that runs again after an executor was lost writes another file and nothing is
renamed or overwritten; files that no manifest names are removed at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import text_runs
from .bpe_codec import RANKS, TOKENIZER, codec

_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("offset", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> bytes:
    """The payload of the record at an offset; raises ValueError where a checksum fails."""
    length, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"the length at {at} is damaged")
    payload = bytes(data[at + 12 : at + 12 + length])
    if len(payload) != length or masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"the record at {at} is damaged")
    return payload


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_MANIFEST = "shard long, name string, n_docs long, n_ids long, width string"


def write_records(docs: DataFrame, directory: str, end_id: int = 2, tokenizer_path: str | None = None, ranks_path: str | None = None, shards: int | None = None) -> DataFrame:
    """Write shards, their indexes and the manifest under ``directory`` (a URI that pyarrow and Spark open), once.

    Returns the manifest, one row a shard: shard, name, n_docs, n_ids, width. Null doc_ids come first; equal ones
    follow each other by a hash of the text and the text. A null text gives a record with the end id alone. Rows that
    repeat a doc_id and text may go on in the next shard, so no key is too large for a task. ``shards``: about how many;
    None leaves it to the session. Other columns are not read.
    """
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def write(batches):
        own, task = codec(tokenizer_path, ranks_path), TaskContext.get()
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        width = _width(own.vocabulary)
        end = np.array([end_id], width).tobytes()
        n_docs = n_ids = at = 0
        with store.open_output_stream(f"{base}/{name}.rec") as records, store.open_output_stream(f"{base}/{name}.idx") as index:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for start, texts in text_runs(batch, "text"):
                    rows, out = np.zeros(len(texts), _INDEX), []
                    for k, ids in enumerate(own.encode(texts)):
                        payload = np.frombuffer(ids, "<i4").astype(width).tobytes() + end
                        out.append(record := frame(payload))
                        doc_id = doc_ids[start + k]
                        rows[k] = (doc_id or 0, doc_id is None, at, len(ids) // 4 + 1)
                        at += len(record)
                    records.write(b"".join(out))
                    index.write(rows.tobytes())
                    n_docs += len(texts)
                    n_ids += int(rows["n"].sum())
        own.memo.clear()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "name": name, "n_docs": n_docs, "n_ids": n_ids, "width": width}], schema)

    schema = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.string())])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(*([shards] if shards else []), "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(f"{directory}/manifest")
    manifest = docs.sparkSession.read.schema(_MANIFEST).parquet(f"{directory}/manifest")
    store, base = fs.FileSystem.from_uri(directory)
    known = {row.name for row in manifest.select("name").collect()}
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.is_file and f.base_name.startswith("shard-") and f.base_name.rpartition(".")[0] not in known:
            store.delete_file(f.path)
    return manifest


def _manifest(spark: SparkSession, directory: str) -> list[tuple]:
    """(name, first record, ids before, width) of each shard in order: a row a shard."""
    out, docs, ids = [], 0, 0
    for row in sorted(spark.read.schema(_MANIFEST).parquet(f"{directory}/manifest").collect(), key=lambda r: r.shard):
        out.append((row.name, docs, ids, row.width))
        docs += row.n_docs
        ids += row.n_ids
    return out


def _index(store, path: str) -> np.ndarray:
    with store.open_input_stream(f"{path}.idx") as f:
        return np.frombuffer(f.read(), _INDEX)


class Records:
    """Records of written shards by number, in any order, for loaders that shuffle: one seek and one read a record."""

    def __init__(self, spark: SparkSession, directory: str):
        self.store, self.base = fs.FileSystem.from_uri(directory)
        self.shards = _manifest(spark, directory)
        self.first = np.array([s[1] for s in self.shards], np.int64)
        self.indexes = {}

    def _of(self, k: int) -> np.ndarray:
        if k not in self.indexes:
            self.indexes[k] = _index(self.store, f"{self.base}/{self.shards[k][0]}")
        return self.indexes[k]

    def __len__(self) -> int:
        return int(self.first[-1]) + len(self._of(len(self.shards) - 1)) if self.shards else 0

    def __getitem__(self, number: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids with the end id)."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        k = int(np.searchsorted(self.first, number, "right")) - 1
        row = self._of(k)[number - self.first[k]]
        with self.store.open_input_file(f"{self.base}/{self.shards[k][0]}.rec") as f:
            return None if row["null"] else int(row["doc_id"]), _ids(f, row, self.shards[k][3])


def _ids(f, row, width: str) -> np.ndarray:
    size = int(row["n"]) * int(width[2])
    f.seek(int(row["offset"]))
    ids = np.frombuffer(unframe(memoryview(f.read(size + 16)), 0), width).astype("<u4")
    if len(ids) != row["n"]:
        raise ValueError(f"the record at {row['offset']} is not as long as the index says")
    return ids


def read_chosen(spark: SparkSession, directory: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids (binary uint32) of the records of the given documents (column doc_id), by the index.

    A row for each record whose doc_id is among them, however often it is given; nulls and unknown ids have none. Only
    indexes are read whole.
    """
    kinds = "doc_id long, name string, width string, offset long, n long"

    def listed(batches):
        store, base = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for row in batch.to_pylist():
                index = _index(store, f"{base}/{row['name']}")
                index = index[index["null"] == 0]
                same = [pa.array([row[c]] * len(index), pa.string()) for c in ("name", "width")]
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"]), *same, pa.array(index["offset"].astype(np.int64)), pa.array(index["n"].astype(np.int64))], ["doc_id", "name", "width", "offset", "n"])

    def read(batches):
        store, base = fs.FileSystem.from_uri(directory)
        opened, name = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["name"] != name:
                    if opened:
                        opened.close()
                    name, opened = row["name"], store.open_input_file(f"{base}/{row['name']}.rec")
                out.append(_ids(opened, row, row["width"]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])
        if opened:
            opened.close()

    index = _shards(spark, _manifest(spark, directory)).mapInArrow(listed, kinds)
    wanted = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = index.join(wanted.hint("merge"), "doc_id").repartition("name").sortWithinPartitions("name", "offset")
    return chosen.select("doc_id", "name", "width", "offset", "n").mapInArrow(read, "doc_id long, n_tokens long, ids binary")


def read_records(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary uint32) of written shards, in any order."""
    return _read(spark, directory, False)


def read_digests(spark: SparkSession, directory: str) -> DataFrame:
    """As ``read_records``, with ids_crc32 in place of the ids."""
    return _read(spark, directory, True)


def _shards(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    return spark.createDataFrame(manifest, "name string, first long, start long, width string").repartition(max(1, len(manifest)))


def _read(spark, directory, digest):
    def read(batches):
        store, base = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for row in batch.to_pylist():
                name, start = f"{base}/{row['name']}", row["start"]
                index = _index(store, name)
                with store.open_input_file(f"{name}.rec") as f:
                    for low in range(0, len(index), 512):
                        part = index[low : low + 512]
                        begin = int(part["offset"][0])
                        until = int(index["offset"][low + 512]) if low + 512 < len(index) else f.size()
                        f.seek(begin)
                        data = memoryview(f.read(until - begin))
                        ids = [np.frombuffer(unframe(data, int(o) - begin), row["width"]).astype("<u4").tobytes() for o in part["offset"]]
                        counts = np.array([len(x) // 4 for x in ids], np.int64)
                        if (counts != part["n"]).any():
                            raise ValueError(f"{name}: index and records differ")
                        at = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                        doc_ids = pa.array(part["doc_id"], mask=part["null"] != 0)
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at), pa.array(counts), last], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return _shards(spark, _manifest(spark, directory)).mapInArrow(read, f"doc_id long, start long, n_tokens long, {names[3]} {'long' if digest else 'binary'}")
