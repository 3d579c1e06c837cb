"""Token ids in binary files: context-mixed, range-coded blocks with checksums, and a reader.

A file holds whole documents in ascending key order: a header, the documents' keys and lengths, the table of the ids'
frequencies, then the blocks. Each block starts with its number of ids, its bytes and the CRC-32 of its ids, and is
coded afresh from the table, so a block that is damaged is found and costs no other. A file with more distinct ids than
a table holds has its blocks uncoded. Files are binary cells of a Parquet table in the shared folder: Spark's writer
commits them, so a lost executor leaves no half-written file; ``export_files`` lays them out as files of their own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.common import map_arrow, stash
from treeline.llm.idcoder import BLOCK_IDS, Table, decode_blocks, encode_blocks, table_of
from treeline.llm.tokens import encoder, with_end

MAGIC = b"TLIDS\x02"
#: A file is closed once it has this many ids; documents are never split.
FILE_IDS = 1 << 22
#: Bytes of text that are encoded at once while writing: a larger part has fewer distinct pieces to look up.
WRITE_PART_BYTES = 8 << 20
#: Magic, documents, ids, bytes of the table (0: blocks are not coded), CRC-32 of index and table.
_HEAD, _BLOCK = struct.Struct("<6sIQII"), struct.Struct("<III")
_INDEX = np.dtype([("null", "u1"), ("key", "<i8"), ("ids", "<u8")])


class DamagedFile(ValueError):
    """A checksum or the layout does not fit."""


def pack_file(keys: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file of documents: all ids one after the other, ``lengths`` of them for each key."""
    index = np.zeros(len(keys), _INDEX)
    index["null"], index["key"], index["ids"] = [k is None for k in keys], [k or 0 for k in keys], lengths
    ids = ids.astype("<u4", copy=False)
    table, places = table_of(ids.astype(np.int64))
    packed = table.packed() if table else b""
    blocks = encode_blocks(table, places) if table else [ids[at : at + BLOCK_IDS].tobytes() for at in range(0, len(ids), BLOCK_IDS)]
    raw = index.tobytes() + packed
    out = [_HEAD.pack(MAGIC, len(keys), len(ids), len(packed), zlib.crc32(raw)), raw]
    for at, coded in zip(range(0, len(ids), BLOCK_IDS), blocks, strict=True):
        own = ids[at : at + BLOCK_IDS]
        out += [_BLOCK.pack(len(own), len(coded), zlib.crc32(own)), coded]
    return b"".join(out)


def unpack_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(keys, ids of each document), after all checksums have been held against the data; DamagedFile where one does not fit or the data ends early."""
    if len(data) < _HEAD.size:
        raise DamagedFile("the header is cut off")
    magic, n, total, size, crc = _HEAD.unpack_from(data)
    at = _HEAD.size + n * _INDEX.itemsize
    if magic != MAGIC or len(data) < at + size or zlib.crc32(data[_HEAD.size : at + size]) != crc:
        raise DamagedFile("the header, the index or the table is damaged")
    index, table = np.frombuffer(data[_HEAD.size : at], _INDEX), Table.unpacked(data[at : at + size]) if size else None
    at += size
    counts, sums, blocks = [], [], []
    while at < len(data):
        if len(data) < at + _BLOCK.size:
            raise DamagedFile("a block is cut off")
        count, size, crc = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size + size
        counts.append(count)
        sums.append(crc)
        blocks.append(data[at - size : at])
        if len(blocks[-1]) != size or (len(counts) > 1 and counts[-2] != BLOCK_IDS) or count > BLOCK_IDS:
            raise DamagedFile(f"block {len(counts) - 1} is cut off")
    if sum(counts) != total or int(index["ids"].sum()) != total:
        raise DamagedFile("ids are missing")
    # Damage within a block is for its checksum to find: the coder reads any words.
    ids = table.symbols.astype("<u4")[decode_blocks(table, blocks, counts)] if table else np.frombuffer(b"".join(blocks), "<u4")
    for k, crc in enumerate(sums):
        if zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS]) != crc:
            raise DamagedFile(f"block {k} is damaged")
    keys = [None if x else k for x, k in zip(index["null"].tolist(), index["key"].tolist(), strict=True)]
    return keys, np.split(ids, np.cumsum(index["ids"]).astype(np.int64)[:-1]) if n else []


def _write(batches: Iterator[pa.RecordBatch], path: str, end: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    part, file, held = TaskContext.get().partitionId(), 0, 0
    keys: list[int | None] = []
    runs: list[tuple[np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        data = pack_file(keys, np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})

    for batch in batches:
        own, at = batch.column(0).to_pylist(), 0
        for flat, lengths in encoder(path).encode_column(batch.column(1), WRITE_PART_BYTES):
            ids, lengths = with_end(flat, lengths, end)
            while len(lengths):
                # Up to and with the document that fills the file.
                upto = min(len(lengths), int(np.searchsorted(np.cumsum(lengths), file_ids - held)) + 1)
                n = int(lengths[:upto].sum())
                keys += own[at : at + upto]
                runs.append((ids[:n], lengths[:upto]))
                at, held, ids, lengths = at + upto, held + n, ids[n:], lengths[upto:]
                if held >= file_ids:
                    yield row()
                    file, held, keys, runs = file + 1, 0, [], []
    if keys:
        yield row()


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, *, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """All documents' ids, each with ``end_id`` after it, as files in ascending key order (nulls first): (part, file, n_ids, data), stashed.

    Files follow each other by (part, file). Rows of one key are spread over tasks by a hash of their
    text, so a task that runs again deals them alike.

    Defined cases: null and empty texts have the end id alone; repeated rows, and rows of one key, stay, in any order
    among each other; an empty table gives no files; other columns are left out.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    return stash(map_arrow(ordered, lambda it: _write(it, tokenizer_path, end_id, file_ids), "part int, file int, n_ids long, data binary"), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, file, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            keys, docs = unpack_file(data.as_py())
            lengths = np.array([len(d) for d in docs], np.int64)
            n = len(keys)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part.as_py()] * n, pa.int32()), "file": pa.array([file.as_py()] * n, pa.int32()), "key": pa.array(keys, pa.int64()),
                "place": pa.array(np.cumsum(lengths) - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
            })


def read_index(files: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files: they are decoded and their checksums held against the ids."""
    read = map_arrow(files.select("part", "file", "data"), _read, "part int, file int, key long, place long, n_tokens long, ids_crc32 long")
    # Sums within each part, and sums over the parts, of which there are as many as tasks wrote.
    along = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(along), F.lit(0)).alias("before")).join(parts, "part")
    return read.join(starts, ["part", "file"]).select(F.col("key").alias(key), (F.col("ahead") + F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _lay_out(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for part, file, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            names.append(f"part-{part.as_py():06d}-{file.as_py():06d}.tlids")
            spare = f"{folder}/.{names[-1]}.{TaskContext.get().taskAttemptId()}"
            with open(spare, "wb") as out:
                out.write(data.as_py())
            os.replace(spare, f"{folder}/{names[-1]}")
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})


def export_files(files: DataFrame, folder: str) -> int:
    """Each file under ``folder``, which all executors have mounted at this path, as part-PPPPPP-FFFFFF.tlids; returns their number.

    A file appears whole or not at all, and a task that runs again puts the same files there.
    """
    os.makedirs(folder, exist_ok=True)
    return map_arrow(files.select("part", "file", "data"), lambda it: _lay_out(it, folder), "name string").count()


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, file, n_ids, data) of the files that ``export_files`` laid out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tlids").load(folder)
    place = [F.regexp_extract("path", r"part-(\d+)-(\d+)\.tlids$", i).cast("int") for i in (1, 2)]
    # The number of ids is the third field of the header, in bytes 11 to 18, the lowest first.
    swapped = F.concat(*(F.substring("content", 18 - i, 1) for i in range(8)))
    return found.select(place[0].alias("part"), place[1].alias("file"), F.conv(F.hex(swapped), 16, 10).cast("long").alias("n_ids"), F.col("content").alias("data"))
