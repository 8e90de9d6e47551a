"""Predicates from parameters and rules: composed filters, the ``when`` language, slots, tolerant clean-up of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def everything(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contains(columns: list[str], text: str | None) -> Column:
    """Whether any of the columns contains ``text``, whatever the case; true for an empty text. Percent signs are literal."""
    if not (text or "").strip():
        return F.lit(True)
    word = text.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False)) for c in columns])


def search(df: DataFrame, text: str | None = None, columns: list[str] = (), equals: dict | None = None, among: dict | None = None, has: list[tuple[DataFrame, str, bool]] = ()) -> DataFrame:
    """``df`` by the parameters that are given: a text in any of ``columns``, equalities, values held by array columns,
    and keys that must (or must not) occur in other tables: (table with the key, key, wanted). Absent ones do not filter.
    """
    tests = [contains(list(columns), text)]
    tests += [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [F.array_contains(c, v) for c, v in (among or {}).items() if v is not None]
    df = df.filter(everything(tests))
    for other, key, wanted in has:
        df = df.join(other.select(key).distinct(), key, "left_semi" if wanted else "left_anti")
    return df


def compile_when(rule: dict | None, snapshot: str = "snapshot") -> Column:
    """A ``when`` rule as a predicate over a struct column.

    Rules nest by ``all`` and ``any``; ``always`` is true, as is an empty rule. Leaves, all of which must hold: has_category
    (one or several), has_watermaker, is_sailing, twin_engine, not_twin_engine, has_company_vhf, local_rules_exclude. The
    struct has categories array<string>, texts array<string> (of the plumbing category), vessel_type, company, channel,
    rules array<string>.
    """
    if not rule or rule.get("always"):
        return F.lit(True)
    if "all" in rule:
        return everything([compile_when(r, snapshot) for r in rule["all"]])
    if "any" in rule:
        return reduce(lambda a, b: a | b, [compile_when(r, snapshot) for r in rule["any"]], F.lit(False))
    s = F.col(snapshot)
    tests = []
    if "has_category" in rule:
        wanted = rule["has_category"]
        tests.append(F.arrays_overlap(s["categories"], F.array(*[F.lit(w) for w in ([wanted] if isinstance(wanted, str) else wanted)])))
    twin = is_twin(s)
    leaves = {"has_watermaker": has_watermaker(s), "is_sailing": is_sailing(s), "twin_engine": twin, "not_twin_engine": ~twin, "has_company_vhf": (s["company"] != "") & (s["channel"] != "")}
    tests += [test for name, test in leaves.items() if rule.get(name)]
    joined = F.lower(F.array_join(s["rules"], " "))
    tests += [~joined.contains(word.lower()) for word in rule.get("local_rules_exclude") or []]
    return everything(tests)


#: Words that show a watermaker; fixed values.
WATERMAKER = ("watermaker", "spectra", "aqua-base", "aquabase", "osmosis", "dessalator", "desalinator", "desalinat")


def has_watermaker(s: Column) -> Column:
    return F.exists(s["texts"], lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in WATERMAKER]))


def is_sailing(s: Column) -> Column:
    return s["vessel_type"].contains("sailing") | F.array_contains(s["categories"], "rigging_and_sail_handling")


def is_twin(s: Column) -> Column:
    engines = F.size(F.filter(s["categories"], lambda c: c == "propulsion_and_machinery"))
    return (engines >= 2) | s["vessel_type"].contains("catamaran")


def filled(text: Column, slots: dict[str, Column]) -> Column:
    """``text`` with ``{name}`` replaced by its slot's value; unknown names stay as they are. A value is not filled again."""
    pieces = F.split(text, r"(?=\{[a-z_]+\})|(?<=\})")
    value = lambda p: reduce(lambda rest, kv: F.when(p == F.lit("{" + kv[0] + "}"), kv[1]).otherwise(rest), slots.items(), p)
    return F.array_join(F.transform(pieces, value), "")


def kept_settings(settings: Column, allowed: list[str], prefix: str, most: int) -> Column:
    """A map without names that are not ``allowed`` or values without ``prefix``; the first ``most`` in the map's order."""
    good = F.map_filter(settings, lambda k, v: F.trim(k).isin(*allowed) & F.coalesce(F.trim(v), F.lit("")).startswith(prefix))
    entries = F.slice(F.map_entries(good), 1, most)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))))


def overridden(base: Column, own: Column) -> Column:
    """A map in which the values of ``own`` win where they are set (neither null nor empty)."""
    base, own = F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(own, F.create_map().cast("map<string,string>"))
    set_ = F.map_filter(own, lambda k, v: F.coalesce(v, F.lit("")) != "")
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(set_, k))
    return F.map_concat(rest, set_)


def aliased(name: Column, aliases: dict[str, str]) -> Column:
    """The name that ``aliases`` gives (lower case, trimmed), else ``UNKNOWN:`` and the name."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    table = F.create_map(*[x for kv in aliases.items() for x in map(F.lit, kv)])
    return F.coalesce(F.try_element_at(table, key), F.concat(F.lit("UNKNOWN:"), key))
