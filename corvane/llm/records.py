"""Token-ID files of length-delimited binary records (operator 8).

A shard is one file `shard-NNNNNN.rec` beside one offset index `shard-NNNNNN.idx`.

Record:  u64 payload length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload
Payload: i64 doc_id | u8 flags (1: doc_id is null) | u8 id width (2 or 4) | ids
Index:   one u64 per record, the record's byte offset, so a reader can shuffle records without scanning.

All numbers are little-endian. The checksum is CRC-32 rotated right by 15 bits plus 0xa282ead8 (fixed values),
masked so that a checksum stored within checked bytes doesn't weaken it.

Defined results: null text counts as empty (only the end id); null doc_ids come first and stay null; equal doc_ids
are ordered by a hash of their text, and equal rows each get a record; an empty table gives no shard and no rows;
other columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import groups, shared_encoder
from corvane.llm.common import input_bytes, new_path, slots

MASK = 0xA282EAD8  # fixed value
HEAD = struct.Struct("<QI")
META = struct.Struct("<qBB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian u32; stored in two bytes each if all fit."""
    a = np.frombuffer(ids, "<u4")
    width = 2 if len(a) == 0 or a.max() < 65536 else 4
    return META.pack(doc_id or 0, doc_id is None, width) + (a.astype("<u2").tobytes() if width == 2 else ids)


def parse(data: bytes) -> tuple[int | None, bytes]:
    doc_id, null, width = META.unpack_from(data)
    ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=META.size)
    return (None if null else doc_id), ids.astype("<u4").tobytes()


def n_ids(meta: bytes, record_bytes: int) -> int:
    return (record_bytes - 16 - META.size) // META.unpack(meta)[2]


def record(raw, at: int) -> tuple[bytes, int]:
    """The payload of the record at a byte offset, and where the next begins. ValueError if a checksum is wrong."""
    n, c = HEAD.unpack_from(raw, at)
    if masked(bytes(raw[at : at + 8])) != c:
        raise ValueError(f"length at {at} is damaged")
    data = bytes(raw[at + 12 : at + 12 + n])
    if len(data) != n or struct.unpack_from("<I", raw, at + 12 + n)[0] != masked(data):
        raise ValueError(f"payload at {at} is damaged")
    return data, at + 16 + n


def store(uri: str):
    """(file system, path) of a folder in any store that Arrow can write: local, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_records(docs: DataFrame, out_uri: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32_000_000) -> DataFrame:
    """Encode every text and write the records in ascending id order. Returns one row per shard
    (shard, n_records, n_tokens); running it writes the files.

    Rows are dealt by ranges of (id, hash of text): one shuffle of the texts, no task holds more than its range, and
    rows stream through. A shard is written under a name of its task attempt and then renamed, so a retried task
    replaces its shard whole."""
    spark = docs.sparkSession
    n = max(slots(spark), input_bytes(docs) // shard_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, enc, files, recs, toks, at = TaskContext.get(), None, None, 0, 0, 0
        shard = ctx.partitionId()
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, texts in groups(b.column(1).to_pylist()):
                if files is None:
                    enc = shared_encoder(tokenizer)
                    fs, path = store(out_uri)
                    fs.create_dir(path, recursive=True)
                    names = [f"{path}/shard-{shard:06d}.{x}" for x in ("rec", "idx")]
                    temp = [f"{p}.{ctx.taskAttemptId()}" for p in names]
                    files = [fs.open_output_stream(p) for p in temp]
                out, offsets = [], []
                for d, e in zip(ids[k : k + len(texts)], enc.encode(texts)):
                    out.append(frame(payload(d, e + end)))
                    offsets.append(at)
                    at += len(out[-1])
                    recs, toks = recs + 1, toks + len(e) // 4 + 1
                files[0].write(b"".join(out))
                files[1].write(np.array(offsets, "<u8").tobytes())
        if files:
            for f, t, p in zip(files, temp, names):
                f.close()
                fs.move(t, p)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [recs], "n_tokens": [toks]}, SHARDS)

    return rows.repartitionByRange(int(n), "d", "h").sortWithinPartitions("d", "h").select("d", "t").mapInArrow(write, "shard int, n_records long, n_tokens long")


SHARDS = pa.schema([("shard", pa.int32()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])


def read_token_records(spark: SparkSession, uri: str, shards: list[tuple[int, int]], order_seed: int | None = None, with_ids: bool = False) -> DataFrame:
    """Read shards back by their offset indexes, checking both checksums of each record: doc_id, start (ids before
    it), n_tokens, ids_crc32 and, if asked, ids. shards: (shard, ids in all shards before it). order_seed: read each
    shard's records in a random order, found by the index."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(uri)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{path}/shard-{shard:06d}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with fs.open_input_file(f"{path}/shard-{shard:06d}.rec") as f:
                    ends = np.append(index[1:], f.size())
                    step = 4000 if order_seed is None else 1
                    runs = np.arange(0, len(index), step)
                    rows: list[tuple] = []
                    starts = {}
                    if order_seed is not None:  # starts follow the file order; only counts are needed for them
                        lens = np.empty(len(index), np.int64)
                        for k in range(len(index)):
                            f.seek(int(index[k]) + 12)
                            lens[k] = n_ids(f.read(10), int(ends[k] - index[k]))
                        starts = dict(enumerate((start + np.concatenate([[0], np.cumsum(lens)[:-1]])).tolist()))
                        np.random.default_rng([order_seed, shard]).shuffle(runs)
                    for r in runs.tolist():
                        last = min(r + step, len(index))
                        f.seek(int(index[r]))
                        raw, at = f.read(int(ends[last - 1] - index[r])), 0
                        for k in range(r, last):
                            data, at = record(raw, at)
                            d, ids = parse(data)
                            if starts:
                                start = starts[k]
                            row = (d, start, len(ids) // 4, zlib.crc32(ids))
                            rows.append((*row, np.frombuffer(ids, "<u4").tolist()) if with_ids else row)
                            start += len(ids) // 4
                        if len(rows) >= 4000 or last == len(index):
                            yield as_batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield as_batch(rows, with_ids)

    n = max(1, len(shards))
    return spark.createDataFrame([(int(a), int(b)) for a, b in shards], "shard int, start long").repartition(n).mapInArrow(read, schema)


def as_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * (4 + with_ids)
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)])


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2, out_uri: str | None = None) -> DataFrame:
    """Write all documents' ids and read the files back: doc_id, start, n_tokens, ids_crc32.

    The driver gathers one row per shard (its counts), never rows per document."""
    spark = docs.sparkSession
    uri = out_uri or new_path(spark, "records")
    done = sorted((r.shard, r.n_tokens) for r in write_token_records(docs, uri, tokenizer, end_id).collect())
    shards, before = [], 0
    for s, n in done:
        shards.append((s, before))
        before += n
    return read_token_records(spark, uri, shards)
