"""Registry loading and upkeep: CSV bundles, keyed JSON, matrices, key checks, pack graphs and idempotent links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..sources.shared import written


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_bundle(spark: SparkSession, folder: str, files: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The files of a bundle by name; ``overrides`` replaces paths. Unknown names are an error."""
    overrides = overrides or {}
    unknown = sorted(set(overrides) - set(files))
    if unknown:
        raise ValueError(f"unknown overrides: {unknown}")
    return {name: read_csv(spark, overrides.get(name, f"{folder}/{file}")) for name, file in files.items()}


def keyed_json(df: DataFrame, doc: str, key: str) -> DataFrame:
    """(key, body) of documents that are JSON maps of bodies, or JSON lists of bodies with a field ``key``; bodies stay JSON text."""
    as_map = F.from_json(doc, "map<string,string>")
    as_list = F.from_json(doc, "array<string>")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("body"))
    mapped = F.transform(F.map_entries(as_map), lambda e: pair(e["key"], e["value"]))
    listed = F.transform(as_list, lambda x: pair(F.get_json_object(x, f"$.{key}"), x))
    entries = F.when(F.ltrim(F.col(doc)).startswith("["), listed).otherwise(mapped)
    return df.select(F.explode(entries).alias("e")).select("e.key", "e.body")


def matrix_rows(lines: DataFrame, line: str, header: list[str], *carry: str) -> DataFrame:
    """(carry, row, column, value) of tab-separated matrix lines: first field the row's number, then one a header column.

    Lines with another number of fields are left out; a field that is no number is an error.
    """
    fields = F.split(F.trim(F.col(line)), r"\t")
    numbers = F.transform(fields, lambda x: x.cast("double"))
    held = lines.filter(F.size(fields) == len(header) + 1).select(*carry, numbers.alias("_n"))
    cells = F.posexplode(F.slice("_n", 2, len(header)))
    places = F.array(*[F.lit(float(h)) for h in header])
    return held.select(*carry, F.col("_n")[0].alias("row"), cells.alias("_at", "value")).select(*carry, "row", places[F.col("_at")].alias("column"), "value")


def missing_required(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """(key, column) of blank required columns."""
    named = F.array_compact(F.array(*[F.when(coerce.blank(F.col(c)), F.lit(c)) for c in columns]))
    return df.select(key.alias("key"), F.explode(named).alias("column"))


def outside_enum(df: DataFrame, key: Column, column: str, allowed: list[str]) -> DataFrame:
    """(key, column) of values outside ``allowed``; null counts as blank."""
    return df.filter(~F.coalesce(F.trim(F.col(column)), F.lit("")).isin(*allowed)).select(key.alias("key"), F.lit(column).alias("column"))


def unknown_keys(links: DataFrame, on: list[str], known: DataFrame, keys: list[str]) -> DataFrame:
    """Links whose ``on`` columns are no ``keys`` of ``known``."""
    same = reduce(lambda a, b: a & b, [links[a].eqNullSafe(known[b]) for a, b in zip(on, keys, strict=True)])
    return links.join(known.select(*[known[k] for k in keys]).distinct(), same, "left_anti")


def uncovered(owners: DataFrame, key: str, *coverings: DataFrame) -> DataFrame:
    """Owners whose key is in none of the coverings' first columns."""
    for c in coverings:
        owners = owners.join(c.select(F.col(c.columns[0]).alias(key)).distinct(), key, "left_anti")
    return owners


def upsert_counted(base: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values, change): inserted, updated or kept, by natural key; null keys equal each other.

    Rows of ``new`` must be unique by key; values of ``new`` win.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    b, n = base.withColumn("_b", F.lit(True)).alias("b"), new.withColumn("_n", F.lit(True)).alias("n")
    pick = lambda c: F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    change = F.when(F.col("b._b").isNull(), "inserted").when(F.col("n._n").isNull(), "kept").otherwise("updated")
    return b.join(n, same, "full").select(*[pick(c) for c in keys + values], change.alias("change"))


def reload_links(base: DataFrame, new: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Links after a reload: all links of the owners in ``new`` are replaced, those of others stay; repeats are one link."""
    kept = base.join(new.select(owner).distinct(), owner, "left_anti")
    return kept.select(*keys).unionByName(new.select(*keys)).distinct()


def expand(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth, path) of all nodes below each root, each once, by its first path in depth-first order.

    edges(parent, child, ord): ``ord`` is a child's place, of one character. Sorting a root's rows by ``path`` gives the order
    of a depth-first walk. Frontiers are written step by step; a step keeps the first path to each (root, node), so work is
    bounded by the result, not by the number of paths. Nodes that lead into a cycle are found first: a walk that meets one is an
    error, and all others end, however deep they are. There are many steps, so that none is broadcast: together they would pass
    through the driver.
    """
    edges = written(edges.select("parent", "child", F.col("ord").cast("string").alias("ord")), "expand-edges")
    front = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    steps = [written(front, "expand")]
    core = written(cycle_core(edges), "expand-core")
    cyclic = not core.isEmpty()
    while not steps[-1].isEmpty():
        if cyclic and not steps[-1].join(core.hint("merge"), "node", "left_semi").isEmpty():
            raise ValueError("packs form a cycle")
        step = steps[-1].join(edges.hint("merge"), F.col("node") == F.col("parent"))
        step = step.groupBy("root", F.col("child").alias("node")).agg(F.min(F.struct(F.concat("path", "ord").alias("path"), (F.col("depth") + 1).alias("depth"))).alias("at"))
        steps.append(written(step.select("root", "node", "at.depth", "at.path"), "expand"))
    every = reduce(DataFrame.unionByName, steps)
    return every.groupBy("root", "node").agg(F.min(F.struct("path", "depth")).alias("at")).select("root", "node", "at.depth", "at.path")


def walks(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, walk): the nodes below each root as one list in depth-first order, each once; what ``expand`` gives by ``path``.

    A node's walk is itself and the walks of its children one after another, of each node the first. It is made once, from the
    lowest nodes up, so that only lists of nodes are shuffled, without their roots and paths. It is made for every node of
    edges(parent, child, ord); a root that leads into a cycle is an error. The list of a root is held at once, as in the result.
    """
    edges = written(edges.select("parent", "child", F.col("ord").cast("string").alias("ord")), "walk-edges")
    # A node's level is the number of rounds after which it has no child with children of its own left.
    left, rounds = edges.select("parent", "child").distinct(), []
    left = written(left, "walk-peel")
    before = left.count()
    while before:
        rounds.append(left.select(F.col("parent").alias("node"), F.lit(len(rounds) + 1).alias("level")))
        left = written(left.join(left.select(F.col("parent").alias("child")).distinct().hint("merge"), "child", "left_semi").select("parent", "child"), "walk-peel")
        now = left.count()
        if now == before:
            break
        before = now
    endless = left.select(F.col("parent").alias("node")).distinct()
    if before and not roots.select(F.col("root").alias("node")).join(endless.hint("merge"), "node", "left_semi").isEmpty():
        raise ValueError("packs form a cycle")
    every = edges.select(F.explode(F.array("parent", "child")).alias("node"), F.lit(0).alias("level"), F.lit(False).alias("asked"))
    every = every.unionByName(roots.select(F.col("root").alias("node"), F.lit(0).alias("level"), F.lit(True).alias("asked")))
    every = reduce(DataFrame.unionByName, [r.withColumn("asked", F.lit(False)) for r in rounds], every)
    nodes = every.groupBy("node").agg(F.max("level").alias("level"), F.max("asked").alias("asked"))
    nodes = written(nodes.join(endless.hint("merge"), "node", "left_anti") if before else nodes, "walk-nodes")
    named = lambda end: nodes.select(F.col("node").alias(end), F.col("level").alias(f"{end}_level")).hint("merge")
    edges = written(edges.join(named("parent"), "parent").join(named("child"), "child"), "walk-edges")
    below = {}
    for r in edges.select("parent_level", "child_level").distinct().collect():
        below.setdefault(r.parent_level, []).append(r.child_level)
    walk = F.array("node")
    made = [written(nodes.filter("level = 0").select("node", "asked", walk.alias("walk")), "walk")]
    for level in range(1, len(below) + 1):
        lower = reduce(DataFrame.unionByName, [made[n] for n in below[level]]).select(F.col("node").alias("child"), "walk")
        parts = edges.filter(F.col("parent_level") == level).select("parent", "child", "ord").join(lower.hint("merge"), "child")
        parts = parts.select(F.col("parent").alias("node"), F.struct("ord", "child", "walk").alias("part"), F.lit(False).alias("asked"))
        own = nodes.filter(F.col("level") == level).select("node", F.lit(None).cast(parts.schema["part"].dataType).alias("part"), "asked")
        met = parts.unionByName(own).groupBy("node").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("asked").alias("asked"))
        made.append(written(met.select("node", "asked", F.array_distinct(F.concat(walk, F.flatten("parts.walk"))).alias("walk")), "walk"))
    return reduce(DataFrame.unionByName, made).filter("asked").select(F.col("node").alias("root"), "walk")


def cycle_core(edges: DataFrame) -> DataFrame:
    """(node) of all nodes on a cycle or on a way between two; no rows if the graph has no cycle.

    Edges whose parent has no way in, or whose child has no way out, are peeled off, written step by step, until none is left to peel.
    """
    edges = written(edges.select("parent", "child").distinct(), "peel")
    before = edges.count()
    while before:
        inner = edges.join(edges.select(F.col("parent").alias("child")).distinct().hint("merge"), "child", "left_semi")
        inner = inner.join(edges.select(F.col("child").alias("parent")).distinct().hint("merge"), "parent", "left_semi")
        edges = written(inner, "peel")
        now = edges.count()
        if now == before:
            break
        before = now
    return edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()


def closes_cycle(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals(parent, child) with ``refused``: whether the new edge would close a cycle (its parent is, or is below, its child).

    A child is followed only while one of its parents is still looked for, and what it has seen is kept as long.
    """
    edges = written(edges.select("parent", "child").distinct(), "reach-edges")
    asked = written(proposals.select(F.col("child").alias("start"), F.col("parent").alias("node")).distinct(), "reach-asked")
    seen = front = written(asked.select("start", F.col("start").alias("node")).distinct(), "reach")
    met = []
    while not front.isEmpty():
        met.append(written(front.join(asked, ["start", "node"], "left_semi"), "reach-met"))
        asked = written(asked.join(met[-1], ["start", "node"], "left_anti"), "reach-asked")
        left = asked.select("start").distinct()
        seen = written(seen.join(left, "start", "left_semi"), "reach-seen")
        new = front.join(left, "start", "left_semi").join(edges, F.col("node") == F.col("parent")).select("start", F.col("child").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = written(new, "reach")
        seen = seen.unionByName(front)
    hit = reduce(DataFrame.unionByName, met, front).select(F.col("start").alias("child"), F.col("node").alias("parent"), F.lit(True).alias("_hit")).distinct()
    return proposals.join(hit, ["parent", "child"], "left").select("parent", "child", F.coalesce("_hit", F.lit(False)).alias("refused"))
