"""Token ids as Arrow stream files with fixed-size-list batches.

A shard is one file in Arrow's stream format. Each row is a sequence of ``sequence_length`` ids with a mask of equal
length, each record batch but the last has ``batch_rows`` rows; the ids of consecutive documents follow one another
without gaps and only the last row of a shard is padded (mask false). Shards have about ``SHARD_IDS`` ids at most, a document is never cut
between two. Rows have equal length, so the place of any
sequence or document follows from its number, and a memory map serves it without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialise, partitions, scratch_path, tidily
from kindred.llm.tokens import default_vocabulary, text_slices, tokenizer

SEQUENCE, BATCH_ROWS = 2048, 64
SHARD_IDS = 1 << 26  # ids after which a task begins its next shard
PARTS = 1 << 16  # shards of one task, at most


def shard_name(shard: int) -> str:
    return f"shard-{shard:011d}.arrows"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes ids as they come, holding one record batch at most. The file appears under its name when it is whole."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, sequence: int = SEQUENCE, rows: int = BATCH_ROWS):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{shard_name(shard)}", f"{base}/.{shard_name(shard)}.{uuid.uuid4().hex}"
        self.kind, self.sequence, self.rows = dtype, sequence, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        full = self.sequence * self.rows
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) // full * full, full):
                self._batch(flat[i : i + full], full)
            rest = flat[len(flat) // full * full :]
            self.held, self.n_held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            whole = -(-len(flat) // self.sequence) * self.sequence
            self._batch(np.concatenate([flat, np.zeros(whole - len(flat), self.kind)]), len(flat))
        self.stream.close()
        self.sink.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.final).type != fs.FileType.NotFound:
            self.fs.delete_file(self.final)  # an attempt that was lost has written the same shard
        self.fs.move(self.temporary, self.final)


def sweep(folder: str) -> None:
    """Delete what lost attempts have left of shards."""
    from pyarrow import fs

    files, base = file_system(folder)
    if files.get_file_info(base).type == fs.FileType.Directory:
        for f in files.get_file_info(fs.FileSelector(base)):
            if f.base_name.startswith(".shard-"):
                files.delete_file(f.path)


class TokenShard:
    """Random access to a shard. On a local file system the ids are views of the memory map."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        files, base = file_system(folder)
        path = f"{base}/{shard_name(shard)}"
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size
        self.rows = self.batches[0].num_rows
        self.views = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        k, j = divmod(i, self.rows)
        mask = self.batches[k].column(1).slice(j, 1).flatten().to_numpy(zero_copy_only=False)
        return self.views[k][j * self.length : (j + 1) * self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard."""
        size, out = self.rows * self.length, []
        while n > 0:
            k, j = divmod(start, size)
            part = self.views[k][j : j + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else self.views[0][:0]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, sequence: int = SEQUENCE, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids of all documents in ascending doc_id order.

    Returns the index, already written: doc_id, shard, position (of its first id in the shard), n_tokens, start (ids
    of all documents before it). Null texts are empty and have the end id alone. A null doc_id comes first; rows with
    one doc_id follow each other by text. An empty table gives no files and no rows. Other columns are ignored.

    The texts are dealt by range over the tasks, so the order holds across them without a sort in one place. A task begins a
    next shard after ``shard_ids`` ids, and a retried one writes the same shards under the same names. Ids take two bytes where the vocabulary allows it.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, writer, place = TaskContext.get().partitionId() * PARTS, tokenizer(vocabulary), None, 0
        kind = np.dtype(np.uint16 if max(encoder.size - 1, end_id) < 1 << 16 else np.uint32)
        for whole in batches:
            for batch in text_slices(whole, most=min(shard_ids, 4 << 20)):
                ids, bounds = encoder.encode(batch.column("text"))
                n = np.diff(bounds) + 1
                if writer and place >= shard_ids:
                    writer.close()
                    writer, shard, place = None, shard + 1, 0
                writer = writer or ShardWriter(folder, shard, kind, sequence)
                writer.append(np.insert(ids, bounds[1:], end_id))
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int64)), pa.array(place + np.cumsum(n) - n), pa.array(n)], names=["doc_id", "shard", "position", "n_tokens"])
                place += int(n.sum())
        if writer:
            writer.close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index = materialise(dealt.mapInArrow(tidily(write), "doc_id long, shard long, position long, n_tokens long"), "index")
    sweep(folder)
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # one row a shard
    return index.join(before, "shard").select("doc_id", "shard", "position", "n_tokens", (F.col("base") + F.col("position")).alias("start"))


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Read each document's ids back from the shards; adds ``ids_crc32`` over little-endian unsigned 32-bit ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, TokenShard] | None = None
        for batch in batches:
            crc = []
            for shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "position", "n_tokens")), strict=True):
                if opened is None or opened[0] != shard:
                    opened = (shard, TokenShard(folder, shard))
                crc.append(zlib.crc32(opened[1].tokens(at, n).astype("<u4").tobytes()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens", "shard", "position")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "shard", "position", "ids_crc32"])

    return index.select("doc_id", "start", "n_tokens", "shard", "position").mapInArrow(tidily(read), "doc_id long, start long, n_tokens long, shard long, position long, ids_crc32 long")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, then read every document back from the files."""
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
