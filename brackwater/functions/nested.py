"""Nested documents as VARIANT values: fields resolved and set by paths like ``a.b[0].c``, and walks over all leaves."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.shared import written

#: A path: names, each with an index if it is of a list, with points between.
PATH = r"^[A-Za-z_]\w*(\[\d+\])?(\.[A-Za-z_]\w*(\[\d+\])?)*$"
#: Keys whose texts are prose, and keys that lead to more of it; fixed values.
PROSE = ("c", "summary", "subtitle", "title", "text", "body", "steps", "items")
HOLDS = ("steps", "items", "sections", "groups", "learnChecks", "fixes", "cards")

#: Levels of a document that are unfolded in one pass.
LEVELS = 8


def at(value: Column, path: Column) -> Column:
    """The field at ``path``; null where there is none, a VARIANT null where the document says null."""
    return F.try_variant_get(value, F.concat(F.lit("$."), path), "variant")


def is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def resolved(value: Column, path: Column) -> Column:
    """Struct (ok, value, error): the field at ``path``, or the first step of the path that fails and why."""
    steps = F.split(path, r"\.")
    upto = F.transform(steps, lambda s, i: F.array_join(F.slice(steps, F.lit(1), i + 1), "."))
    failed = F.get(F.filter(upto, lambda p: at(value, p).isNull()), F.lit(0))
    named = at(value, F.regexp_replace(failed, r"\[\d+\]$", ""))
    why = F.when(named.isNull(), "missing ").when(is_list(named), "index out of range at ").otherwise("not a list at ")
    good = F.coalesce(path.rlike(PATH), F.lit(False))
    error = F.when(~good, "empty or malformed path").when(failed.isNotNull() | value.isNull(), F.concat(why, F.coalesce(failed, path)))
    return F.struct(error.isNull().alias("ok"), F.when(good, at(value, F.when(good, path))).alias("value"), error.alias("error"))


def put(document: str | None, path: str | None, value: str | None) -> str | None:
    """``document`` with the field at ``path`` set to the JSON ``value``; null where a step before the last is not there."""
    if document is None or path is None or value is None or not re.match(PATH, path):
        return None
    whole = here = json.loads(document)
    steps = [int(s[1:-1]) if s.startswith("[") else s for s in re.findall(r"\[\d+\]|\w+", path)]
    for n, step in enumerate(steps):
        last = n + 1 == len(steps)
        fits = step < len(here) if isinstance(step, int) and isinstance(here, list) else isinstance(step, str) and isinstance(here, dict) and (last or step in here)
        if not fits:
            return None
        if last:
            here[step] = json.loads(value)
        else:
            here = here[step]
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def with_value(document: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """``put`` over Arrow batches: there is no expression that changes a VARIANT."""
    return pd.Series([put(d, p, v) for d, p, v in zip(document, path, value, strict=True)])


def leaves(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, path, type, text) of every leaf of JSON documents: a step a level, in which objects and lists unfold to rows.

    Nothing is taken by patterns over the text, so quotes within it and keys within texts are what they are. Empty objects and
    lists have no leaves; null documents have none. ``LEVELS`` steps are one pass, in which leaves stay as they are; only what
    holds more after them is written, for the next pass. Passes end with the deepest document.
    """
    kind = F.schema_of_variant("_v")
    holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    rows = docs.filter(F.col(document).isNotNull()).select(*keys, F.lit("$").alias("path"), F.parse_json(document).alias("_v"))
    out = None
    while True:
        for _ in range(LEVELS):
            rows = unfolded(rows, keys)
        found = rows.filter(~holds).select(*keys, "path", kind.alias("type"), F.variant_get("_v", "$", "string").alias("text"))
        out = found if out is None else out.unionByName(found)
        rows = written(rows.filter(holds), "level")
        if rows.isEmpty():
            return out


def unfolded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, _v): each object or list as a row a member, empty ones as none, leaves as they are."""
    members = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    leaf = F.col("pos").isNull()
    held = F.schema_of_variant("_v").isin("OBJECT<>", "ARRAY<VOID>")
    return members.filter(~leaf | ~held).select(*keys, F.when(leaf, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(leaf, F.col("_v")).otherwise(F.col("value")).alias("_v"))


def prose(found: DataFrame) -> DataFrame:
    """Those ``leaves`` that are texts under a prose key, reached through keys that hold prose only."""
    names = F.filter(F.split(F.regexp_replace("path", r"\[\d+\]", ""), r"\."), lambda s: s != "$")
    last = F.try_element_at(names, F.lit(-1))
    ways = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    return found.filter("type = 'STRING'").filter(last.isin(*PROSE) & F.forall(ways, lambda s: s.isin(*HOLDS)) & (F.trim("text") != ""))


def normalised(value: Column, schema: dict[str, tuple]) -> dict[str, Column]:
    """Columns of a document by a schema of (path, kind, default).

    Kinds: ``text`` (trimmed; no other type is one), ``texts`` (of a list its texts, of a text itself, joined by commas), ``flag``
    (true, and yes, 1, on as texts), ``share`` (a number, brought between 0 and 1), or the allowed names (whatever the case).
    """
    out = {}
    for name, (path, kind, default) in schema.items():
        found = F.try_variant_get(value, F.lit(f"$.{path}"), "variant")
        of = F.schema_of_variant(found)
        text = F.when(of == "STRING", F.trim(F.try_variant_get(found, F.lit("$"), "string")))
        if kind == "text":
            out[name] = F.coalesce(text, F.lit(default))
        elif kind == "texts":
            items = F.filter(F.try_variant_get(found, F.lit("$"), "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
            out[name] = F.coalesce(F.array_join(F.transform(items, lambda x: F.trim(F.try_variant_get(x, F.lit("$"), "string"))), ","), text, F.lit(""))
        elif kind == "flag":
            out[name] = F.coalesce(F.when(of == "BOOLEAN", F.try_variant_get(found, F.lit("$"), "boolean")).when(of == "STRING", F.lower(text).isin("true", "yes", "1", "on")), F.lit(default))
        elif kind == "share":
            number = F.when(of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(found, F.lit("$"), "double"))
            out[name] = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(F.lit(default))
        else:
            out[name] = F.coalesce(F.when(F.lower(text).isin(*kind), F.lower(text)), F.lit(default))
    return out
