"""Bundles of modules and edits of nested profiles: split, assemble, check, re-interleave; repairs that say what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def split_bundle(bundles: DataFrame, key: str, single: list[str], keyed: list[str]) -> DataFrame:
    """(key, content_type, content_key, payload) of bundles with columns of JSON text: ``single`` ones are a module each, ``keyed``
    ones a module an entry; empty ones are none."""
    parts = [F.when(F.coalesce(C(c), F.lit("")) != "", F.array(F.struct(F.lit(c).alias("t"), F.lit(c).alias("k"), C(c).alias("p")))) for c in single]
    parts += [F.transform(F.map_entries(F.from_json(C(c), "map<string,string>")), one_of(c)) for c in keyed]
    none = F.array().cast("array<struct<t:string,k:string,p:string>>")
    every = F.flatten(F.array(*[F.coalesce(p, none) for p in parts]))
    return bundles.select(key, F.explode(every).alias("m")).select(key, C("m.t").alias("content_type"), C("m.k").alias("content_key"), C("m.p").alias("payload"))


def one_of(content_type: str):
    return lambda e: F.struct(F.lit(content_type).alias("t"), e["key"].alias("k"), e["value"].alias("p"))


def assembled(modules: DataFrame, key: str, single: list[str], keyed: list[str]) -> DataFrame:
    """The bundles of modules: a column of JSON text a type, null where there is none."""
    pair = F.struct("content_key", "payload")
    aggs = [F.max(F.when(C("content_type") == c, C("payload"))).alias(c) for c in single]
    aggs += [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(C("content_type") == c, pair))))).alias(c) for c in keyed]
    return modules.groupBy(key).agg(*aggs)


def publication_errors(bundles: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """(key, message) of rules (test, message) that hold."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in rules]))
    return bundles.select(key, F.explode(found).alias("message"))


def interleaved(reference: Column, generated: Column) -> Column:
    """Sections of a reference with those generated: photos stay where the reference has them, other titles are replaced by the
    generated section or dropped, and what is generated besides follows. Sections are structs (title, photo, body)."""
    titles = F.transform(F.filter(generated, lambda g: ~g["photo"]), lambda g: g["title"])
    kept = F.filter(reference, lambda r: r["photo"] | F.array_contains(titles, r["title"]))
    placed = F.transform(kept, lambda r: F.when(r["photo"], r).otherwise(F.get(F.filter(generated, lambda g: ~g["photo"] & (g["title"] == r["title"])), F.lit(-1) + F.size(F.filter(generated, lambda g: ~g["photo"] & (g["title"] == r["title"]))))))
    used = F.transform(F.filter(reference, lambda r: ~r["photo"]), lambda r: r["title"])
    rest = F.filter(generated, lambda g: ~g["photo"] & (F.coalesce(g["title"], F.lit("")) != "") & ~F.array_contains(used, g["title"]))
    return F.concat(placed, rest)


def dropped_requirements(requires: Column, surfaces: Column) -> tuple[Column, Column]:
    """(kept, repairs): requirements without a use are dropped, as are those, software apart, for a surface that is built in.

    requires: structs (text, kind, needed_for), surfaces: structs (path, optional). Repairs are (flag, i, text).
    """
    builtin = lambda r: F.exists(surfaces, lambda s: (s["path"] == r["needed_for"]) & ~s["optional"]) & (r["kind"] != "software_app")
    blank = lambda r: F.trim(r["needed_for"]) == ""
    flag = lambda r: F.when(blank(r), "dangling_needed_for").when(builtin(r), "contradiction_builtin_requires_accessory")
    repairs = F.filter(F.transform(requires, lambda r, i: F.struct(flag(r).alias("flag"), i.alias("i"), r["text"].alias("text"))), lambda x: x["flag"].isNotNull())
    return F.filter(requires, lambda r: ~blank(r) & ~builtin(r)), repairs


def added_requirements(requires: Column, surfaces: Column) -> Column:
    """Requirements that optional surfaces need and lack, by path or by their label in a text: structs (text, kind, needed_for)."""
    lacking = lambda s: s["optional"] & ~F.exists(requires, lambda r: (r["needed_for"] == s["path"]) | ((F.trim(s["label"]) != "") & F.lower(r["text"]).contains(F.lower(s["label"]))))
    return F.transform(F.filter(surfaces, lacking), lambda s: F.struct(F.coalesce(F.nullif(F.trim(s["label"]), F.lit("")), F.lit("optional accessory")).alias("text"), F.lit("device").alias("kind"), s["path"].alias("needed_for")))


def coalesced(groups: DataFrame, key: str, most: int) -> DataFrame:
    """(key, group_id, size): neighbouring groups that are no introduction merged, the smallest pair first, until ``most`` are left.

    groups(key, ord, name, size, intro). An entity has as many groups as its manual chapters: its short list is folded in one
    expression, a merge a step, the pair of least size (the first among equals) each time; work is groups squared an entity.
    """
    item = "struct<name:string,size:long,intro:boolean>"
    lists = groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "size", "intro"))), lambda g: F.struct(g["name"].alias("name"), g["size"].cast("long").alias("size"), g["intro"].alias("intro"))).alias("g"))

    def step(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(acc) - 2, F.lit(0))), lambda i: F.struct(F.when(F.get(acc, i)["intro"] | F.get(acc, i + 1)["intro"], None).otherwise(F.get(acc, i)["size"] + F.get(acc, i + 1)["size"]).alias("s"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["s"].isNotNull()))
        i = best["i"]
        merged = F.struct(F.concat(F.get(acc, i)["name"], F.lit("+"), F.get(acc, i + 1)["name"]).alias("name"), best["s"].alias("size"), F.lit(False).alias("intro"))
        out = F.concat(F.slice(acc, 1, i), F.array(merged), F.slice(acc, i + 3, F.size(acc)))
        return F.when((F.size(acc) > most) & best.isNotNull(), out.cast(f"array<{item}>")).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(1), F.size("g")), C("g").cast(f"array<{item}>"), step)
    return lists.select(key, F.explode(folded).alias("x")).select(key, C("x.name").alias("group_id"), C("x.size").alias("size"))
