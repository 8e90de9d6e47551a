"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked identifier pairs.

A text is encoded as space + text by a byte-level vocabulary (A) and as itself by a piece vocabulary (B), which puts the same
space before it. Both token lists are byte lengths over the same bytes: where tokens of both end, a group ends; between
neighbouring ends of either kind lies one stretch that belongs to one A and one B token, so that the stretches are the links.

Counting: a document's links are sorted int64 keys, A in the upper and B in the lower 32 bits, with how often each occurs.
They are written once, with the rest of what is told of a document. Each task sums documents by key over its rows (np.unique
on at most ``HELD`` keys at a time) and hands on partial counts; a range partition and sort by key brings the partials of a key
together, and a pass over them, run by run, writes sorted count shards: ``.keys`` and ``.counts``, int64 each, in the shared
folder. Highest counts by A identifier are one array of the vocabulary's length, maxima of the shards' own.

Looking up: the documents' keys are merged over a batch and searched in the shards, mapped into memory where the file system
is local, else read a shard at a time. Only the shards' ranges (a row a shard) and that array are told to the tasks.

File names carry the task attempt, and only the attempt that succeeds tells its name. Null and empty texts, and those whose
tokens of either kind do not stand for the bytes of space + text (texts with U+2581), have no tokens: numbers are 0, the digest
is empty, and they count for no pair. Repeated rows are documents of their own. Null ids are kept. An empty table gives no
rows. Texts may be of any length. Further columns are not read.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_of, common, tokens
from .tokenfile import file_system, opened

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Keys that a task holds before it hands on partial counts.
HELD = 1 << 21
#: Bytes of text that are encoded at once, and aligned at once; words of a call.
STEP, PART, CALL = 6 << 20, 1 << 20, 20_000
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str):
    """A tokenizer to which the strings of its special tokens are ordinary text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@functools.lru_cache(maxsize=4)
def piece_tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """Byte strings by identifier, gathered many at a time."""

    def __init__(self, values: list[bytes]):
        self.data = np.frombuffer(b"".join(values), np.uint8)
        self.lengths = np.array([len(v) for v in values], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, ids: np.ndarray) -> np.ndarray:
        return self.data[tokens.ragged(self.starts[ids], self.lengths[ids])]


@functools.lru_cache(maxsize=4)
def byte_strings(path: str) -> Strings:
    made = byte_tokenizer(path)
    of = byte_of_character()
    return Strings([bytes(of[c] for c in made.id_to_token(i)) if all(c in of for c in made.id_to_token(i)) else made.id_to_token(i).encode() for i in range(made.get_vocab_size())])


@functools.lru_cache(maxsize=4)
def piece_strings(path: str) -> Strings:
    made = piece_tokenizer(path)
    return Strings([bytes([int(made.id_to_piece(i)[3:-1], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace(SPACE, " ").encode() for i in range(made.get_piece_size())])


@functools.lru_cache(maxsize=4)
def parts_at_spaces(path: str) -> bool:
    """Whether no piece runs on over the beginning of a word, so that words with the spaces before them can be encoded one by one."""
    made = piece_tokenizer(path)
    return made.piece_to_id(SPACE) != made.unk_id() and not any(SPACE in made.id_to_piece(i).lstrip(SPACE) for i in range(made.get_piece_size()) if not made.is_control(i) and not made.is_unknown(i))


def encoded_words(words: list[str], path: str, pieces: bool) -> list[list[int]]:
    if pieces:  # the vocabulary adds the first space itself, but to nothing it adds none: a space alone is its own piece
        made = piece_tokenizer(path)
        lone = [made.piece_to_id(SPACE)]
        return [ids or lone for ids in made.encode([w[1:] for w in words], num_threads=1)]
    return [e.ids for e in byte_tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def encode(data: np.ndarray, rows: np.ndarray, path: str, pieces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of texts that begin with a space, and the row offsets into them. Equal words of a batch are encoded once."""
    if pieces:
        cut = (data[1:] == 32) & (data[:-1] != 32) if parts_at_spaces(path) else np.zeros(max(len(data) - 1, 0), bool)
        cuts = bytes_of.cuts(cut, rows)
    else:
        cuts = tokens.cut_offsets(data, rows, "byte")
    parts = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    lengths, flat = [], []
    for at in range(0, len(parts.dictionary), CALL):
        ids = encoded_words(parts.dictionary[at : at + CALL].to_pylist(), path, pieces)
        lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
    lengths, flat = np.concatenate(lengths), np.concatenate(flat)
    starts = np.cumsum(lengths) - lengths
    index = parts.indices.to_numpy()
    out = flat[tokens.ragged(starts[index], lengths[index])]
    at = np.concatenate([[0], np.cumsum(lengths[index])])
    return out, at[np.searchsorted(cuts, rows)]


def spelled(ids: np.ndarray, at: np.ndarray, strings: Strings, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row, whether its tokens stand for its bytes."""
    n_bytes = np.diff(np.concatenate([[0], np.cumsum(strings.lengths[ids])])[at])
    fits = n_bytes == np.diff(rows)
    # Rows of the right length are compared byte by byte; the others have failed.
    whole = np.repeat(fits, np.diff(at))
    same = strings.gather(ids[whole]) == data[np.repeat(fits, np.diff(rows))]
    bounds = np.concatenate([[0], np.cumsum(np.diff(rows)[fits])])
    fits[fits] = bytes_of.row_sums((~same).astype(np.float64), bounds) == 0
    return fits


@functools.lru_cache(maxsize=2)
def written_names(a: int, b: int) -> list[str]:
    """Decimal identifiers with each separator that may follow: A with comma or bar, B with comma or semicolon."""
    return [*(f"{i}," for i in range(a)), *(f"{i}|" for i in range(a)), *(f"{i}," for i in range(b)), *(f"{i};" for i in range(b))]


def align(texts: pa.Array, a_path: str, b_path: str) -> dict[str, list | np.ndarray]:
    """What is told of each text, and the sorted keys of its links with how often they occur, as bytes."""
    texts = pc.fill_null(texts.cast(pa.string()), "").cast(pa.large_string())
    n = len(texts)
    some = pc.greater(pc.binary_length(texts), 0)
    data, rows = spaced(texts.filter(some))
    out: dict = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n, "keys": [b""] * n, "times": [b""] * n}
    if not len(data):
        return out
    a, a_at = encode(data, rows, a_path, False)
    b, b_at = encode(data, rows, b_path, True)
    where, start = np.flatnonzero(np.asarray(some)), 0
    while start < len(where):  # identifiers are for many texts at once; their places are worked out for some of them at a time
        stop = max(start + 1, int(np.searchsorted(rows, rows[start] + PART, side="right")) - 1)
        of = [x[k[start] : k[stop]] for x, k in ((a, a_at), (b, b_at), (data, rows))]
        at = [k[start : stop + 1] - k[start] for k in (a_at, b_at, rows)]
        place(out, where[start:stop], *of, *at, byte_strings(a_path), piece_strings(b_path))
        start = stop
    return out


def place(out: dict, where: np.ndarray, a: np.ndarray, b: np.ndarray, data: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, rows: np.ndarray, a_strings: Strings, b_strings: Strings) -> None:
    """Puts what is told of texts, whose places in ``out`` are ``where``, there."""
    good = spelled(a, a_at, a_strings, data, rows) & spelled(b, b_at, b_strings, data, rows)
    a, b = a[np.repeat(good, np.diff(a_at))], b[np.repeat(good, np.diff(b_at))]
    where, row_ends = where[good], np.cumsum(np.diff(rows)[good])
    if not len(row_ends):
        return
    # Ends of tokens as flags over the bytes of all good rows, and how many there are up to each byte; a row's end is an end of both.
    n_a, n_b = len(a_strings.lengths), len(b_strings.lengths)
    a_end, b_end = np.cumsum(a_strings.lengths[a]), np.cumsum(b_strings.lengths[b])
    a_ends, b_ends = np.zeros(row_ends[-1] + 1, bool), np.zeros(row_ends[-1] + 1, bool)
    a_ends[a_end] = b_ends[b_end] = True
    both, either = a_ends & b_ends, a_ends | b_ends
    a_upto, b_upto, both_upto = (np.cumsum(flags, dtype=np.int32) for flags in (a_ends, b_ends, both))
    per_row = lambda upto: np.diff(upto[row_ends], prepend=0)
    links = per_row(np.cumsum(either, dtype=np.int32))
    out["n_a"][where], out["n_b"][where], out["n_groups"][where], out["n_links"][where] = per_row(a_upto), per_row(b_upto), per_row(both_upto), links
    # Tokens in written order: A's of a group, then B's of it. A token's place is its number and those of the other kind before it.
    group_ends = np.flatnonzero(both)
    a_last, b_last = both[a_end], both[b_end]
    item = np.empty(len(a) + len(b), np.int64)
    item[np.arange(len(a)) + np.concatenate([[0], b_upto[group_ends]])[both_upto[a_end] - a_last]] = a + n_a * a_last
    item[np.arange(len(b)) + a_upto[group_ends][both_upto[b_end] - b_last]] = b + 2 * n_a + n_b * b_last
    table = written_names(n_a, n_b)
    item_ends = np.cumsum(per_row(a_upto) + per_row(b_upto))
    # Links: for each stretch the two tokens it lies in. Row, A and B are sorted as one number, and equal ones counted.
    at = np.flatnonzero(either)
    pair = a[a_upto[at] - a_ends[at]].astype(np.int64) * n_b + b[b_upto[at] - b_ends[at]]
    one = np.sort(np.repeat(np.arange(len(row_ends)), links) * (n_a * n_b) + pair)
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    times = np.diff(first, append=len(one)).astype(np.int32)
    row, pair = np.divmod(one[first], n_a * n_b)
    unique = pair // n_b << 32 | pair % n_b
    bounds = np.searchsorted(row, np.arange(len(row_ends) + 1))
    start = 0
    for i, k in enumerate(where.tolist()):
        text = "".join([table[j] for j in item[start : item_ends[i]].tolist()])
        out["groups_sha256"][k] = hashlib.sha256(text[:-1].encode()).hexdigest()
        out["keys"][k] = unique[bounds[i] : bounds[i + 1]].tobytes()
        out["times"][k] = times[bounds[i] : bounds[i + 1]].tobytes()
        start = item_ends[i]


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each behind a space, and their row offsets."""
    data, rows = bytes_of.view(texts)
    n = len(texts)
    out = np.full(len(data) + n, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[rows[:-1] + np.arange(n)] = False
    out[inside] = data
    return out, rows + np.arange(n + 1)


def aligner(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"groups_sha256": pa.string(), "keys": pa.binary(), "times": pa.binary()}
        gc.disable()  # nothing here is cyclic, and a collection would walk millions of short lists
        for batch in batches:
            for part in bytes_of.steps(batch, size=STEP):
                made = align(part.column("text"), a_path, b_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items())], names=["doc_id", *made])

    return run


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by key over the rows of a partition: what is held is merged when it reaches HELD keys, and handed on if it stays large."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[bytes] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.frombuffer(b"".join(waiting), np.int64), return_counts=True)
        every, index = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return every, np.bincount(index, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)

    for batch in batches:
        for value in batch.column("keys"):
            raw = value.as_py()
            waiting.append(raw)
            size += len(raw) // 8
            if size >= HELD:
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def sharder(folder: str, vocabulary: int):
    """Sums runs of equal keys of a sorted partition and writes them; tells the shard's range and its highest counts by A identifier."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        path = f"{place}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        best = np.zeros(vocabulary, np.int64)
        sinks = None
        open_key = open_count = n = low = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            if sinks is None:
                sinks = [system.open_output_stream(f"{path}.{kind}") for kind in ("keys", "counts")]
                low = open_key = int(keys[0])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            if keys[0] == open_key:
                counts[0] += open_count
            else:
                keys, counts = np.concatenate([[open_key], keys]), np.concatenate([[open_count], counts])
            # The last run may go on in the next batch.
            open_key, open_count = int(keys[-1]), int(counts[-1])
            sinks[0].write(keys[:-1].tobytes())
            sinks[1].write(counts[:-1].tobytes())
            np.maximum.at(best, keys[:-1] >> 32, counts[:-1])
            n += len(keys) - 1
        if sinks is not None:
            sinks[0].write(np.int64(open_key).tobytes())
            sinks[1].write(np.int64(open_count).tobytes())
            for s in sinks:
                s.close()
            best[open_key >> 32] = max(best[open_key >> 32], open_count)
            at = np.flatnonzero(best)
            yield pa.RecordBatch.from_pydict({"path": [path], "low": [low], "high": [open_key], "n": [n + 1], "ids": [at.tolist()], "best": [best[at].tolist()]})

    return write


class Shards:
    """Counts of keys, found by binary search in sorted shards."""

    def __init__(self, folder: str, ranges: list[tuple[str, int, int]]):
        self.system, _ = file_system(folder)
        self.paths = [r[0] for r in ranges]
        self.lows = np.array([r[1] for r in ranges], np.int64)
        self.mapped: dict[str, np.ndarray] = {}

    def column(self, path: str) -> np.ndarray:
        """A view of a mapped file, kept; from elsewhere a copy, which goes with the shard."""
        if path in self.mapped:
            return self.mapped[path]
        source = opened(self.system, path)
        out = np.frombuffer(source.read_buffer(), np.int64)
        if isinstance(source, pa.MemoryMappedFile):
            self.mapped[path] = out
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted ``keys``, all of which are in some shard."""
        out = np.empty(len(keys), np.int64)
        bounds = np.searchsorted(keys, self.lows).tolist() + [len(keys)]
        for path, start, stop in zip(self.paths, bounds, bounds[1:], strict=False):
            if start < stop:
                known = self.column(f"{path}.keys")
                at = np.searchsorted(known, keys[start:stop])
                if at[-1] >= len(known) or not np.array_equal(known[at], keys[start:stop]):
                    raise ValueError(f"{path} lacks keys of its range")
                out[start:stop] = self.column(f"{path}.counts")[at]
        return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about STEP bytes of keys."""
    ends = np.cumsum(pc.binary_length(batch.column("keys")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP)))
        yield batch.slice(start, stop - start)
        start = stop


def finder(folder: str, ranges: list[tuple[str, int, int]], best: np.ndarray):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, ranges)
        for batch in batches:
            for part in slices(batch):
                raw, times = part.column("keys").to_pylist(), part.column("times").to_pylist()
                keys, n = np.frombuffer(b"".join(raw), np.int64), np.frombuffer(b"".join(times), np.int32).astype(np.float64)
                at = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])])
                every, index = np.unique(keys, return_inverse=True)
                count = shards.counts(every)
                highest = (count == best[every >> 32])[index]
                # Whole numbers in doubles: exact below 2 ** 53.
                sums = [pa.array(bytes_of.row_sums(v, at).astype(np.int64)) for v in (n * highest, n * count[index])]
                columns = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, *sums, part.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return find


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ALIGNED rows of all documents, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.written(rows.mapInArrow(aligner(a_path, b_path), ALIGNED), "aligned")


def count_pairs(rows: DataFrame, folder: str, vocabulary: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Writes count shards under ``folder``; returns their ranges in order (a row a shard) and the highest counts by A identifier."""
    partial = rows.select("keys").mapInArrow(partial_counts, "key long, n long")
    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    shards = common.written(ordered.mapInArrow(sharder(folder, vocabulary), "path string, low long, high long, n long, ids array<long>, best array<long>"), "count-shards")
    ranges = [(r.path, r.low, r.high) for r in shards.select("path", "low", "high").orderBy("low").collect()]
    best = np.zeros(vocabulary, np.int64)
    pairs = shards.select(F.explode(F.arrays_zip("ids", "best")).alias("p")).groupBy("p.ids").agg(F.max("p.best").alias("best"))
    for r in pairs.collect():  # a row an identifier of the vocabulary
        best[r.ids] = r.best
    return ranges, best


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its tokens, groups, links and what the corpus-wide counts say of these."""
    spark = docs.sparkSession
    rows = aligned(docs, a_path, b_path)
    folder = common.new_dir(spark, "pairs")
    ranges, best = count_pairs(rows, folder, byte_tokenizer(a_path).get_vocab_size())
    return rows.mapInArrow(finder(folder, ranges, best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(common.table(spark, sf_dir, "documents"), tokens.vocabulary(BYTES), tokens.vocabulary(PIECES))
