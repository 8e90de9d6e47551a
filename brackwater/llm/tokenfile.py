"""Token identifiers as Arrow files of equal-length sequences with masks.

Documents are range-partitioned by id; each task tokenizes its range and writes two Arrow IPC files: ``.seq`` with
fixed-size-list columns ``ids`` and ``mask`` (a byte each place, dictionary-encoded, as there are two masks a file at most; one row a sequence, ``BATCH`` rows a record batch, not compressed, so that
sequence i is at a known place of batch i // BATCH and a mapped file gives it without copying), and ``.idx`` with a row a
document (doc_id, start and n_tokens in this file). Documents run on from sequence to sequence; only the last sequence of
a file is padded, and masked. Identifiers take 16 bits if the vocabulary has at most 65,536.

File names carry the task attempt, and only the attempt that succeeds tells its name: retried or speculative tasks never
share a file. Null and empty texts have the end token alone. Null ids come first; repeated rows follow one another. An
empty table gives no files. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytes_of, common, tokens

SEQUENCE = 1024
BATCH = 256
VOCABULARY = "word_bpe_49k.json"
END = 1


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def opened(system, path: str):
    """A file to read at random: mapped where the file system is local, else by ranges."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class SequenceWriter:
    """Appends identifiers to a ``.seq`` file, whole sequences at a time."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int16(), pa.list_(pa.uint8(), length)))])
        # The mask of the padded sequence is told with the last batch, as a delta of the dictionary.
        self.file = pa.ipc.new_file(sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.rest: list[np.ndarray] = []
        self.n_rest = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.total += len(ids)
        step = self.length * BATCH
        if self.n_rest >= step:
            every = np.concatenate(self.rest)
            for at in range(0, len(every) - step + 1, step):
                self._write(every[at : at + step], step)
            self.rest = [every[len(every) // step * step :]]
            self.n_rest = len(self.rest[0])

    def _write(self, ids: np.ndarray, real: int) -> None:
        values = pa.array(ids.astype(self.kind.to_pandas_dtype()))
        n, last = len(ids) // self.length, real % self.length
        masks = np.arange(self.length) < np.array([[self.length], [last]] if last else [[self.length]])
        number = np.zeros(n, np.int16)
        if last:
            number[-1] = 1
        masks = pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel().view(np.uint8)), self.length)
        columns = [pa.FixedSizeListArray.from_arrays(values, self.length), pa.DictionaryArray.from_arrays(pa.array(number), masks)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_rest:
            every = np.concatenate(self.rest)
            padded = np.zeros(-(-len(every) // self.length) * self.length, np.uint32)
            padded[: len(every)] = every
            self._write(padded, len(every))
        self.file.close()


class SequenceReader:
    """Random access to a ``.seq`` file: by sequence, or by a range of its token stream."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._last: tuple[int, np.ndarray] | None = None

    def batch(self, i: int) -> np.ndarray:
        if self._last is None or self._last[0] != i:
            self._last = (i, self.file.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and mask (false: padding) of sequence ``i``: views of the file where it is mapped, no copies."""
        b = self.file.get_batch(i // BATCH)
        ids, mask = b.column("ids")[i % BATCH], b.column("mask")
        mask = mask.dictionary[mask.indices[i % BATCH].as_py()]
        return ids.values.to_numpy(zero_copy_only=True), mask.values.to_numpy(zero_copy_only=True).view(np.bool_)

    def tokens(self, start: int, n: int) -> np.ndarray:
        step, parts = self.length * BATCH, []
        while n:
            part = self.batch(start // step)[start % step :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def writer(folder: str, path: str, kind: str, end: int, length: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        id_type = pa.uint16() if tokens.tokenizer(path).get_vocab_size() <= 1 << 16 else pa.uint32()
        name = f"{place}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        seq = idx = None
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        docs = 0
        for batch in batches:
            for part in bytes_of.steps(batch):
                if seq is None:
                    sinks = system.open_output_stream(f"{name}.seq"), system.open_output_stream(f"{name}.idx")
                    seq, idx = SequenceWriter(sinks[0], length, id_type), pa.ipc.new_file(sinks[1], schema)
                ids, rows = tokens.with_end(*tokens.encode(part.column("text"), path, kind), end)
                idx.write_batch(pa.record_batch([part.column("doc_id"), pa.array(rows[:-1] + seq.total), pa.array(np.diff(rows))], schema=schema))
                seq.add(ids)
                docs += part.num_rows
        if seq is not None:
            seq.close()
            idx.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "n_docs": [docs], "n_tokens": [seq.total]})

    return write


def write_tokens(docs: DataFrame, folder: str, path: str, kind: str = "word", end: int = END, length: int = SEQUENCE, partitions: int | None = None) -> DataFrame:
    """Writes the files and returns their table (part, path, n_docs, n_tokens, base): base counts the ids of the files before."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = (docs.repartitionByRange(partitions, "doc_id") if partitions else docs.repartitionByRange("doc_id")).sortWithinPartitions("doc_id")
    files = common.written(ordered.mapInArrow(writer(folder, path, kind, end, length), "part long, path string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with opened(system, f"{f['path']}.seq") as source, opened(system, f"{f['path']}.idx") as index:
                    seq, idx = SequenceReader(source), pa.ipc.open_file(index)
                    for i in range(idx.num_record_batches):
                        rows = idx.get_batch(i)
                        starts, counts = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        crcs = [tokens.crc(seq.tokens(int(s), int(n))) for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "start": pa.array(starts + f["base"]), "n_tokens": rows.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})

    return read


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, a file a task."""
    # As many partitions as asked for, each of a file or a few: tiny rows, whose reading is the work.
    return files.repartition(max(1, files.count()), "part").mapInArrow(reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_dir(spark, "tokens")
    files = write_tokens(common.table(spark, sf_dir, "documents"), folder, tokens.vocabulary(VOCABULARY))
    return read_digests(files, folder)
