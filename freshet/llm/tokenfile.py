"""Token ids as flat binary files, and reading them back.

A written set is a folder of shards in document order. A shard is three flat
little-endian files: ``.ids`` (unsigned 16-bit ids, 32-bit where the vocabulary needs
them), ``.offsets`` (64-bit, one more than documents: ids of the shard before each) and
``.docs`` (64-bit document ids). The manifest, a Parquet table with a row a shard, names
the files and holds each shard's base: the ids of all shards before it, a prefix sum.
Readers map the files into memory and add the base.

A shard is written by one task under a name of its own, and the manifest takes names
from the task that was committed: a second attempt never touches the files of a first.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import fresh_path
from .common import crc_of, small_batches, stored
from .tokens import encoder

#: Stands for a null document id in a flat file of integers.
NO_ID = -(1 << 63)

#: Documents whose ids are read at a time.
READ_DOCUMENTS = 1000

SHARDS = "part int, path string, wide boolean, documents long, ids long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


class _Flat:
    """A flat file as an array: mapped into memory where it can be, else read range by range."""

    def __init__(self, uri: str, dtype: str) -> None:
        self.system, self.path = _place(uri)
        self.dtype = np.dtype(dtype)
        self.count = self.system.get_file_info(self.path).size // self.dtype.itemsize
        local = isinstance(self.system, fs.LocalFileSystem)
        self.mapped = np.memmap(self.path, self.dtype, "r") if local and self.count else None

    def part(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        size = self.dtype.itemsize
        with self.system.open_input_file(self.path) as file:
            return np.frombuffer(file.read_at((stop - start) * size, start * size), self.dtype)


def _writer(folder: str, vocabulary: str, keeps_space: bool, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        name = f"{base}/shard-{uuid.uuid4().hex}"
        coder = encoder(vocabulary, keeps_space)
        end = np.array([end_id], coder.dtype)
        at, documents = 0, 0
        streams = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not streams:
                system.create_dir(base, recursive=True)
                streams = {x: system.open_output_stream(f"{name}.{x}") for x in ("ids", "offsets", "docs")}
                streams["offsets"].write(np.array([0], "<i8").tobytes())
            ids = [np.concatenate([x, end]) for x in coder.encode(batch.column("text"))]
            offsets = at + np.cumsum([len(x) for x in ids], dtype="<i8")
            streams["ids"].write(np.concatenate(ids).tobytes())
            streams["offsets"].write(offsets.tobytes())
            streams["docs"].write(np.array([NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8").tobytes())
            at, documents = int(offsets[-1]), documents + len(ids)
        for stream in streams.values():
            stream.close()
        if documents:
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "path": f"{folder}/{os.path.basename(name)}", "wide": coder.dtype.itemsize == 4, "documents": documents, "ids": at}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("wide", pa.bool_()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )
    return write


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, keeps_space: bool = True,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts in ascending order of their ids; returns the manifest.

    Null texts count as empty, null ids come first, equal ids follow each other by a hash
    of their text, and every text ends in ``end_id``. Other columns are not read. An empty
    table gives an empty manifest. ``vocabulary`` is the tokenizer's file, at the same
    path on every executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    shards = stored(ordered.mapInArrow(_writer(folder, vocabulary, keeps_space, end_id), SHARDS), "token-shards")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            ids = _Flat(shard["path"] + ".ids", "<u4" if shard["wide"] else "<u2")
            offsets = _Flat(shard["path"] + ".offsets", "<i8")
            docs = _Flat(shard["path"] + ".docs", "<i8")
            for first in range(0, docs.count, READ_DOCUMENTS):
                last = min(docs.count, first + READ_DOCUMENTS)
                part, edges = docs.part(first, last), offsets.part(first, last + 1)
                own = ids.part(int(edges[0]), int(edges[-1]))
                yield pa.record_batch([
                    pa.array(part, mask=part == NO_ID), pa.array(edges[:-1] + shard["base"]), pa.array(np.diff(edges)),
                    pa.array([crc_of(own[a:b]) for a, b in zip(edges[:-1] - edges[0], edges[1:] - edges[0])], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids.

    One task a shard, however small their rows are.
    """
    shards = max(1, manifest.count())
    return manifest.repartitionByRange(shards, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
