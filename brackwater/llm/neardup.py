"""Similarity join on word-shingle sets: MinHash LSH forest, then exact verification.

1. Every text becomes its set of five-word shingles (words: runs of characters above the space; fewer than five words are
   one shingle) and a signature of ``TREES`` x ``DEPTH`` minima. Equal sets are one class of copies from here on.
2. Forest: in each of ``TREES`` trees a set is a path of DEPTH minima. ``prefix_length`` is the length up to which prefixes may be
   shortened: pairs at the threshold share that much of a path in some tree with the target recall. Sets alone below such a
   node drop out before any payload moves. The others are dealt by node and sorted by path, so that a node is a sorted trie.
3. In a node sets are compared by whole signatures, from the leaves up: neighbours in the order of paths, then all that share
   a prefix, shortened minimum by minimum only while sets below it are not yet one star (``climbed``). Estimates far below
   the threshold are dropped; stars keep output linear in sets. Their connected components hold every candidate pair.
4. Exact: in each component the sets themselves are intersected, by blocks: a component of more than ``BLOCK`` sets is dealt
   into blocks, and each pair of blocks is a task's group of its own. A group gives each set's number of links and a
   spanning forest of them, never pairs. Components of exact links are the classes.

Copies are not expanded: a set counts as many links as its neighbours have copies. No cap anywhere: large nodes and
components take more blocks, every two of which meet. Target recall is of candidates at exactly the threshold; above it recall rises fast.

Null and empty texts have no shingles: no links, each a class of its own. Repeated rows are copies. A null doc_id is kept
and never names a class that has another id. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_of, common, components, shingles
from .components import Forest

THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.9995
#: Candidates whose estimate is this many deviations below the threshold are dropped.
DEVIATIONS = 4.5
BLOCK = 512
#: Bytes of text whose shingles are made at a time; the arrays take some 50 times as much.
STEP = 1 << 20
#: Sets of a trie node that meet in one task (some 400 bytes each).
NODE = 32_768
#: Sets in components that may be broadcast to the scan that reads their texts again (some 40 bytes each).
SMALL_MEMBERS = 300_000


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the target recall."""
    for m in range(depth, 0, -1):
        if 1 - (1 - threshold**m) ** trees >= recall:
            return m
    raise ValueError("the target recall needs more trees")


def least_estimate(threshold: float = THRESHOLD, n: int = TREES * DEPTH) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / n) ** 0.5


def signer(n: int, words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch, size=STEP):
                found = shingles.sets(part.column("text"), words)
                sig = shingles.signatures(found, n)
                some = np.array([len(s) > 0 for s in found])
                ids = pa.array([shingles.set_id(s) for s in found], pa.int64(), mask=~some)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), ids, pa.array([len(s) for s in found], pa.int64()), pa.array([r.tobytes() if k else None for r, k in zip(sig, some, strict=True)], pa.binary())], names=["doc_id", "h", "sid", "n", "sig"])

    return sign


def paths(trees: int, depth: int, m: int):
    """Each set once a tree: ``key`` stands for the tree and the first ``m`` minima, ``label`` is the path below them, in byte order."""

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, trees, depth)
            top = sig[:, :, :m].astype(np.uint64)
            key = np.broadcast_to(np.arange(trees, dtype=np.uint64), top.shape[:2]).copy()
            for k in range(m):
                key = shingles.mixed(key * shingles.BASE + top[:, :, k])
            rest = np.ascontiguousarray(sig[:, :, m:]).astype(">u4").tobytes()
            width = 4 * (depth - m)
            label = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), key.size, [None, pa.py_buffer(rest)]).cast(pa.binary()) if width else pa.array([b""] * key.size, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), label, pa.array(np.repeat(batch.column("sid").to_numpy(), trees))], names=["key", "label", "sid"])

    return path


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def joined_blocks(forest: Forest, at: np.ndarray, size: np.ndarray, sig: np.ndarray, threshold: float, least: float, block: int = 128) -> None:
    """Joins sets ``at`` whose sizes allow the threshold and whose signatures agree in a share of ``least``, but for blocks that are one star."""
    at = at[np.argsort(size[at], kind="stable")]
    n, need = size[at], least * sig.shape[1]
    for i in range(0, len(at), block):
        low = int(np.searchsorted(n, threshold * n[i]))
        for j in range(low // block * block, i + 1, block):
            a, b = slice(i, i + block), slice(j, min(j + block, len(at)))
            label = forest.roots()
            if len(np.unique(np.concatenate([label[at[a]], label[at[b]]]))) == 1:
                continue
            same = np.zeros((len(n[a]), len(n[b])), np.int16)
            for k in range(sig.shape[1]):
                same += sig[at[a], k, None] == sig[None, at[b], k]
            x, y = np.nonzero((same >= need) & (n[None, b] >= threshold * n[a, None]) & (n[a, None] >= threshold * n[None, b]))
            keep = x + i > y + j
            forest.join(at[x[keep] + i], at[y[keep] + j])


def climbed(label: np.ndarray, size: np.ndarray, sig: np.ndarray, threshold: float, least: float) -> Forest:
    """Sets of one trie node, sorted by the path below it (a row of minima each), joined from the leaves up.

    Neighbours in the order of paths are compared first. Then prefixes are shortened minimum by minimum: at each length the sets
    that share the prefix are compared, unless all of them already are one star. A node whose sets were joined at a longer
    prefix is thus done; only those short of partners climb on, up to the node itself.
    """
    forest = Forest(len(size))
    order = np.arange(len(size))
    near = (sig[1:] == sig[:-1]).sum(axis=1) >= least * sig.shape[1]
    near &= (size[1:] >= threshold * size[:-1]) & (size[:-1] >= threshold * size[1:])
    forest.join(order[1:][near], order[:-1][near])
    for depth in range(label.shape[1], -1, -1):
        differ = (label[1:, :depth] != label[:-1, :depth]).any(axis=1)
        cuts = np.concatenate([[0], np.flatnonzero(differ) + 1, [len(size)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                joined_blocks(forest, order[a:b], size, sig, threshold, least)
    return forest


def star_maker(n: int, threshold: float, least: float):
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        pending = 0
        names = ["a", "b"]
        for group in groups(batches, ["key", "first", "second"]):
            sid = group.column("sid").to_numpy()
            if len(sid) < 2:
                continue
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(sid), n)
            label = np.frombuffer(b"".join(group.column("label").to_pylist()), ">u4").reshape(len(sid), -1)
            root = climbed(label, group.column("n").to_numpy(), sig, threshold, least).roots()
            moved = np.flatnonzero(root != np.arange(len(root)))
            out_a.append(sid[moved])
            out_b.append(sid[root[moved]])
            pending += len(moved)
            if pending > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], names=names)
                out_a, out_b, pending = [], [], 0
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], names=names)

    return star


def set_reader(words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch, size=STEP):
                found = shingles.sets(part.column("text"), words)
                right = pa.array([shingles.set_id(s) == i and len(s) > 0 for s, i in zip(found, part.column("sid").to_pylist(), strict=True)])
                kept = [pa.array([s.tobytes() for s in found], pa.binary())]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("comp", "sid", "copies", "blocks")), *kept], names=["comp", "sid", "copies", "blocks", "set"])
                yield out.filter(right)

    return read


def intersections(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices over the shingles found on both sides."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    lx, ly = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(lx), np.unique(ly), assume_unique=True)

    def places(flat: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        ok = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (rx, cx), (ry, cy) = places(lx, left), places(ly, right)
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), chunk):
        width = min(chunk, len(shared) - c)
        m = []
        for row, col, parts in ((rx, cx, left), (ry, cy, right)):
            a, b = np.searchsorted(col, [c, c + width])
            x = np.zeros((len(parts), width), np.float32)
            x[row[a:b], col[a:b] - c] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have at least the threshold's Jaccard similarity, exactly."""
    both = np.rint(intersections(left, right)).astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return both >= threshold * union - 1e-9 * union


def verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        rows: list[pa.RecordBatch] = []
        pending = 0
        for group in groups(batches, ["comp", "first", "second"]):
            sid, first_at = np.unique(group.column("sid").to_numpy(), return_index=True)
            group = group.take(pa.array(first_at))
            found = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
            first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
            x, y = np.flatnonzero(block == first), np.flatnonzero(block == second)
            if not len(x) or not len(y):
                continue
            link = linked([found[i] for i in x], [found[i] for i in y], threshold)
            links = np.zeros(len(sid), np.int64)
            if first == second:
                np.fill_diagonal(link, False)
                links[x] = link @ copies[x]
            else:
                links[x] = link @ copies[y]
                links[y] = link.T @ copies[x]
            forest = Forest(len(sid))
            a, b = np.nonzero(link)
            forest.join(x[a], y[b])
            root = forest.roots()
            keep = links > 0
            rows.append(pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(links[keep]), pa.array(sid[root[keep]])], schema=schema))
            pending += int(keep.sum())
            if pending > 50_000:
                yield from rows
                rows, pending = [], 0
        yield from rows

    return verify


def joined(docs: DataFrame, threshold: float = THRESHOLD, words: int = shingles.WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, h, n_shingles, class_id, set_class, n_links): ``h`` tells apart texts under one id, ``set_class`` classes of one least id."""
    n = trees * depth
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = common.written(docs.mapInArrow(signer(n, words), "doc_id long, h long, sid long, n long, sig binary"), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    distinct = signed.filter("sid is not null").groupBy("sid").agg(first.alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    distinct = common.written(distinct.select("sid", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h"), "copies", "n", "sig"), "near-sets")

    m = prefix_length(threshold, trees, depth, recall)
    keys = distinct.select("sid", "sig").mapInArrow(paths(trees, depth, m), "key long, label binary, sid long")
    # Nodes are counted apart from their sets, so that the rows of a large one are joined by AQE in parts.
    keys = common.written(keys, "near-prefixes")
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key")
    # A node of more than NODE sets is dealt into blocks, every two of which meet in a task.
    blocks = F.ceil(F.col("c") / NODE).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("key", "label", "sid", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"))
    members = shared.join(distinct.select("sid", "n", "sig"), "sid")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    stars = members.repartition(int(parts), "key", "first", "second").sortWithinPartitions("key", "first", "second", "label", "sid").mapInArrow(star_maker(n, threshold, least_estimate(threshold, n)), "a long, b long")
    candidates = components.connected(stars)

    counts = candidates.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = common.written(candidates.join(counts, "label").withColumnRenamed("label", "comp").join(distinct.select(F.col("sid").alias("id"), "rep", "rep_h", "copies"), "id").withColumnRenamed("id", "sid"), "near-wanted")
    found = docs.join(common.small(wanted, SMALL_MEMBERS), (docs["h"] == wanted["rep_h"]) & docs["doc_id"].eqNullSafe(wanted["rep"])).select("comp", "sid", "copies", "blocks", "text")
    found = found.mapInArrow(set_reader(words), "comp long, sid long, copies long, blocks int, set binary")
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = found.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", "sid", "copies", "set", "block", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"))
    links = dealt.repartition(int(parts), "comp", "first", "second").sortWithinPartitions("comp", "first", "second").mapInArrow(verifier(threshold), "sid long, links long, other long")
    links = common.written(links, "near-links")

    classes = components.connected(links.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    least = classes.join(distinct.select(F.col("sid").alias("id"), "rep"), "id").groupBy("label").agg(F.min("rep").alias("class_rep"))
    of_set = classes.join(least, "label").select(F.col("id").alias("sid"), "class_rep", F.col("label").alias("set_class"))
    totals = links.groupBy("sid").agg(F.sum("links").alias("links"))
    told = distinct.select("sid", "rep", "copies").join(of_set, "sid", "left").join(totals, "sid", "left")
    told = told.select("sid", F.coalesce("class_rep", "rep").alias("class_id"), F.coalesce("set_class", "sid").alias("set_class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "h", "sid", F.col("n").alias("n_shingles")).join(told, "sid", "left").drop("sid")


def join(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles): class_id is the least doc_id of the class; links count documents."""
    return joined(docs, **how).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the document of least doc_id of each class (of least text hash, if an id has several of them).

    Rows without an id, or without words, all stay; texts of one id in different classes are kept or dropped each by its class.
    """
    found = common.written(joined(docs, **how).filter("doc_id is not null and n_shingles > 0").select("doc_id", "h", "set_class"), "near-classes")
    kept = found.groupBy("set_class").agg(F.min(F.struct("doc_id", "h")).alias("k"))
    kept = found.groupBy("set_class", "doc_id", "h").count().join(kept, "set_class").select("doc_id", "h", "count", (F.struct("doc_id", "h") == F.col("k")).alias("stays"))
    gone = common.small(common.written(kept.filter("not stays").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "near-gone"), SMALL_MEMBERS)
    rest = docs.join(gone, (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left_anti")
    twice = common.written(kept.filter("stays and count > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "near-twice")
    if twice.isEmpty():
        return rest
    same = (rest["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(rest["text"]) == F.col("_h"))
    return rest.join(twice, same, "left_anti").unionByName(rest.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
