"""Token ids in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, scratch, slices, text_list
from cartoloom.llm.pieces import piece_ids

#: Sequences in a record batch of a file.
BATCH_SEQUENCES = 256
#: Characters of a text that take part in dealing out rows of equal ids.
HEAD = 64


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """One shard: a stream of ids cut into rows of fixed length; the last row is padded and masked."""

    def __init__(self, sink, length: int, small: bool) -> None:
        self.length, self.dtype = length, np.dtype("<u2" if small else "<u4")
        value = pa.uint16() if small else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if full := self.waiting // (self.length * BATCH_SEQUENCES):
            self._flush(full * BATCH_SEQUENCES)  # all batches but the last have the same size

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        used = min(len(flat), rows * self.length)
        row = np.zeros(rows * self.length, self.dtype)
        row[:used] = flat[:used]
        self.held, self.waiting = [flat[used:]], len(flat) - used
        for lo in range(0, rows, BATCH_SEQUENCES):
            n = min(BATCH_SEQUENCES, rows - lo)
            part = row[lo * self.length : (lo + n) * self.length]
            mask = np.arange(lo * self.length, (lo + n) * self.length) < used
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.written += rows

    def close(self) -> int:
        if self.waiting:
            self._flush(-(-self.waiting // self.length))
        self.out.close()
        return self.written


class SequenceReader:
    """Random access to a shard.  On a local file nothing is copied: rows are views of the mapped file."""

    def __init__(self, path: str) -> None:
        store, at = _store(path)
        self.source = pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.at, self.row = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            column = self.file.get_batch(k).column("input_ids")
            self.at, self.row = k, column.flatten().to_numpy(zero_copy_only=True)
        return self.row

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from a position of the shard's stream."""
        step, parts = BATCH_SEQUENCES * self.length, []
        while n:
            k, inside = divmod(start, step)
            parts.append(self._batch(k)[inside : inside + n])
            if not len(parts[-1]):
                raise ValueError(f"{self.source}: ends before {start}")
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ids in ascending ``doc_id`` order and return the manifest, one row for each shard.

    Documents are dealt out by ranges of the id (nulls first, equal ids by text) and the text's beginning, so shard after
    shard they ascend and a hot id or many null ids are split.  A shard is an Arrow file of record batches with two
    fixed-size-list columns, ``input_ids`` and ``mask``, and an Arrow file with one row for each document (``doc_id,
    start, n_tokens``; start within the shard).  A task writes under a name of its own and renames at the end, so a
    retried or a second attempt leaves one whole shard.  Ids take 16 bits where the vocabulary allows.

    Null text is the end id alone; repeated rows are written once each; an empty table gives an empty manifest or
    empty shards; other columns are not read.

    Manifest: ``shard, path, n_docs, n_tokens, n_sequences, first``, where ``first`` is the number of ids
    before the shard.  It has one row for each task and is put together on the driver.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    own = keyed_text(docs, id_col, text_col).withColumn("head", F.substring("text", 1, HEAD))
    ordered = own.repartitionByRange(order[0], F.asc_nulls_first("head")).drop("head").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        from cartoloom.llm.pieces import tokenizer

        store, base = _store(folder)
        shard = TaskContext.get().partitionId()
        own = f"{base}/.{shard}-{uuid.uuid4().hex}"
        coder, small = piece_ids(vocabulary), tokenizer(vocabulary).get_vocab_size() <= 1 << 16
        keys, starts, counts, total = [], [], [], 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(own + ".ids") as sink:
            out = SequenceWriter(sink, length, small)
            for batch in slices(batches):
                for key, coded in zip(batch.column("doc_id").to_pylist(), coder.ids(text_list(batch)), strict=True):
                    ids = np.append(np.frombuffer(coded, "<u4"), np.uint32(end_id))
                    out.add(ids)
                    keys.append(key)
                    starts.append(total)
                    counts.append(len(ids))
                    total += len(ids)
            rows = out.close()
        index = pa.table({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with store.open_output_stream(own + ".docs") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index, max_chunksize=1 << 16)
        path = f"{base}/shard-{shard:06d}"
        for kind in ("docs", "ids"):
            store.move(f"{own}.{kind}", f"{path}.{kind}.arrow")
        yield {"shard": [shard], "path": [f"{folder}/shard-{shard:06d}"], "n_docs": [len(keys)], "n_tokens": [total], "n_sequences": [rows]}

    shards = arrow_rows(ordered, work, "shard int, path string, n_docs long, n_tokens long, n_sequences long")
    first, rows = 0, []
    for row in sorted(shards.collect()):
        rows.append((*row, first))
        first += row.n_tokens
    spark = docs.sparkSession
    return spark.createDataFrame(rows, "shard int, path string, n_docs long, n_tokens long, n_sequences long, first long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, at = _store(path + ".docs.arrow")
                reader = SequenceReader(path + ".ids.arrow")
                with store.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        for part in slices(iter([index.get_batch(k)])):
                            starts, counts = part.column("start").to_pylist(), part.column("n_tokens").to_pylist()
                            yield {
                                "doc_id": part.column("doc_id"),
                                "start": [first + s for s in starts],
                                "n_tokens": counts,
                                "ids": [reader.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, counts, strict=True)],
                            }

    n = max(1, manifest.count())
    return arrow_rows(manifest.repartition(n, "shard"), work, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the files in the shared folder, then read every document back from them; they go when the application ends."""
    return read_token_files(write_token_files(docs, vocabulary, scratch(docs.sparkSession), **options))


def digest(rows: DataFrame) -> DataFrame:
    """The rows with a checksum in place of their ids."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

