"""Whole-profile validation: repairs first, then rules, then the gate. A profile is one row with nested arrays.

Rules are expressions over the row that give arrays of flags; all of them are one projection over one scan, however many there
are. Repairs are projections too, which tell what they changed.

profile(device, actions array<struct<action, audience, occasion>>, evidence array<struct<field, section, note>>,
requires array<struct<text, needed_for, gate>>, n_surfaces, n_speaks, controllable, displays, protective, category, coverage, confidence)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import matching as M
from ..sources.shared import written

C = F.col
#: Words that do not count when an occasion is compared with its action, and words that count as one; fixed values.
OCCASION_STOP = ("a", "an", "the", "to", "for", "of", "and", "or", "your", "its", "unit", "device", "display")
OCCASION_SAME = {"down": "off", "start": "on", "starting": "on", "stop": "off", "shut": "off", "turn": "switch", "switches": "switch"}
#: Ways to say that a device is turned off or on; fixed values.
POWER_OFF = r"(?i)(?:turn\s+(?:\w+\s+){0,3}off|power\s+down|shut\s+down|switch\s+off)"
POWER_ON = r"(?i)(?:turn\s+(?:\w+\s+){0,3}on|power\s+up|switch\s+on|\bstart(?:ing)?\b)"
#: Notes that tell of this device commanding others; fixed values.
COMMANDS = r"(?i)(?:control|controls|controlling|command|commands|commanding|switch|switches|switching)\s+(?:various\s+)?(?:lights|pumps|devices?|loads?|circuits?|equipment|connected)"
ROOTS = ("operator_actions", "control_surfaces", "requires_devices", "data_roles", "safety_role", "networks", "protected_by", "protects", "supply_requirements")
SEVERITIES = {"occasion_circular": "warning", "coverage_low": "warning", "evidence_support_mismatch": "warning", "low_confidence_profile": "warning"}


def root(path: Column) -> Column:
    return F.regexp_extract(path, r"^([a-z_]+)", 1)


def index(path: Column) -> Column:
    """The index of ``name[i]``, null without one."""
    return F.nullif(F.regexp_extract(path, r"^[a-z_]+\[(\d+)\]", 1), F.lit("")).cast("int")


def resolves(path: Column) -> Column:
    """Whether a path's root is known and its index within the list it names; lists that are not held here have no end."""
    n = F.when(root(path) == "operator_actions", F.size("actions")).when(root(path) == "requires_devices", F.size("requires")).when(root(path) == "control_surfaces", C("n_surfaces"))
    return root(path).isin(*ROOTS) & (index(path).isNull() | n.isNull() | (index(path) < n))


def occasion_tokens(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OCCASION_SAME.items() for x in kv])
    kept = F.filter(M.tokens(text), lambda w: ~w.isin(*OCCASION_STOP))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w))))


def circular(action: Column, occasion: Column) -> Column:
    """Whether an occasion only says the action again: both about power on, or off, or the same tokens."""
    body = F.regexp_replace(F.trim(occasion), r"(?i)^(?:to|for)\s+", "")
    ta, to = occasion_tokens(action), occasion_tokens(body)
    power = (action.rlike(POWER_OFF) & body.rlike(POWER_OFF)) | (action.rlike(POWER_ON) & body.rlike(POWER_ON))
    return F.coalesce((F.trim(action) != "") & (F.trim(occasion) != "") & (power | ((F.size(ta) > 0) & (ta == to))), F.lit(False))


def flag(name: str, detail: Column, path: Column) -> Column:
    return F.struct(F.lit(name).alias("flag"), F.lit(SEVERITIES.get(name, "blocking")).alias("severity"), detail.alias("detail"), path.alias("path"))


def at(name: str, i: Column, rest: str = "") -> Column:
    return F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]{rest}"))


def bad(action: Column) -> Column:
    return circular(action["action"], action["occasion"])


def cleared() -> Column:
    """(path, original) of the circular occasions of a profile."""
    return F.filter(F.transform("actions", lambda a, i: F.when(bad(a), F.struct(at("operator_actions", i, ".occasion").alias("path"), a["occasion"].alias("original")))), lambda x: x.isNotNull())


def repaired(profiles: DataFrame) -> DataFrame:
    """Profiles with circular occasions cleared, and ``repairs``: (path, original) of what was cleared."""
    fixed = F.transform("actions", lambda a: F.struct(a["action"].alias("action"), a["audience"].alias("audience"), F.when(bad(a), "").otherwise(a["occasion"]).alias("occasion")))
    return profiles.withColumn("repairs", cleared()).withColumn("actions", fixed)


def missing_evidence() -> Column:
    """Paths that must have evidence and have none: true roles, and each requirement without a gate of its own."""
    has = lambda p: F.exists("_fields", lambda f: (f == p) | f.startswith(F.concat(p, F.lit("."))))
    roles = [("data_roles.controllable_from_network", "controllable"), ("data_roles.displays_data_from_other_devices", "displays"), ("safety_role.is_protective_device", "protective")]
    of_roles = F.array_compact(F.array(*[F.when(C(c) & ~has(F.lit(p)), F.lit(p)) for p, c in roles]))
    of_requires = F.filter(F.transform("requires", lambda r, i: F.when(~r["gate"] & ~has(at("requires_devices", i)), at("requires_devices", i))), lambda p: p.isNotNull())
    return F.concat(of_roles, of_requires)


def better_action(i: Column, linked: Column) -> Column:
    """The action that note ``i`` supports better than the one it is linked to: at least 0.3, and by 0.15; null if there is none."""
    scored = F.transform("_actions", lambda words, k: F.struct(M.shared(F.get("_notes", i), words).alias("s"), (-k).alias("k")))

    def choose(all_: Column) -> Column:
        best, own = F.array_max(all_), F.get(all_, linked)["s"]
        text = F.get("actions", -best["k"])["action"]
        return F.when((best["s"] >= 0.3) & (best["s"] >= F.coalesce(own, F.lit(0.0)) + 0.15) & (text != F.coalesce(F.get("actions", linked)["action"], F.lit(""))), text)

    return F.get(F.transform(F.array(scored), choose), F.lit(0))  # bound once, used thrice


def rules(flags: tuple[str, ...]) -> Column:
    """The flags of a profile by the rules named in ``flags``; the others are not evaluated."""
    evidence = lambda test, name, detail, rest: F.filter(F.transform("evidence", lambda e, i: F.when(test(e), flag(name, detail(e), at("evidence", i, rest)))), lambda f: f.isNotNull())
    whole = lambda test, name, detail, path: F.array_compact(F.array(F.when(test, flag(name, detail, F.lit(path)))))
    field = lambda e: F.trim(e["field"])
    none = F.lit("")

    def better() -> Column:
        found = F.transform("evidence", lambda e, i: F.when((root(field(e)) == "operator_actions") & (F.size("actions") > 0), better_action(i, index(field(e)))))
        return F.filter(F.transform(found, lambda b, i: F.when(b.isNotNull(), flag("evidence_support_mismatch", b, at("evidence", i, ".note")))), lambda f: f.isNotNull())

    by_name = {
        "evidence_incomplete": lambda: F.transform(missing_evidence(), lambda p: flag("evidence_incomplete", p, F.lit("evidence"))),
        "occasion_circular": lambda: F.transform("repairs", lambda r: flag("occasion_circular", r["original"], r["path"])),
        "direction_mismatch": lambda: evidence(lambda e: field(e).startswith("data_roles.") & F.concat_ws(" ", e["note"], e["section"]).rlike(COMMANDS), "direction_mismatch", field, ".supports_field"),
        "evidence_heading_invalid": lambda: evidence(lambda e: (F.trim(e["section"]) != "") & ~H.is_section_title(e["section"]), "evidence_heading_invalid", lambda e: e["section"], ".manual_section"),
        "evidence_shape_invalid": lambda: evidence(lambda e: (field(e) == "") | (F.trim(e["section"]) == ""), "evidence_shape_invalid", lambda e: none, ""),
        "unknown_field": lambda: evidence(lambda e: (field(e) != "") & ~resolves(field(e)), "unknown_field", field, ".supports_field"),
        "evidence_support_mismatch": better,
        "dangling_needed_for": lambda: F.filter(F.transform("requires", lambda r, i: F.when((F.trim(r["needed_for"]) != "") & ~resolves(F.trim(r["needed_for"])), flag("dangling_needed_for", r["needed_for"], at("requires_devices", i, ".needed_for")))), lambda f: f.isNotNull()),
        "action_without_surface": lambda: whole((F.size("actions") > 0) & (C("n_surfaces") == 0), "action_without_surface", none, "control_surfaces"),
        "speaks_but_inert": lambda: whole((C("n_speaks") > 0) & (C("n_surfaces") == 0) & (F.size("actions") == 0), "speaks_but_inert", none, "networks.speaks"),
        "category_freeform_provenance": lambda: whole(F.trim("category") == "", "category_freeform_provenance", none, "device.category_freeform"),
        "coverage_low": lambda: whole(C("coverage") < 0.25, "coverage_low", none, "coverage"),
        "low_confidence_profile": lambda: whole(C("confidence") < 0.6, "low_confidence_profile", none, "confidence.overall"),
    }
    return reduce(F.concat, [by_name[n]() for n in by_name if n in flags])


#: All rules; the severity of each is in ``SEVERITIES``, or else blocking.
RULES = (
    "evidence_incomplete", "occasion_circular", "direction_mismatch", "evidence_heading_invalid", "evidence_shape_invalid", "unknown_field", "evidence_support_mismatch", "dangling_needed_for",
    "action_without_surface", "speaks_but_inert", "category_freeform_provenance", "coverage_low", "low_confidence_profile",
)
BLOCKING = tuple(n for n in RULES if SEVERITIES.get(n, "blocking") == "blocking")


def validated(profiles: DataFrame, flags: tuple[str, ...] = RULES) -> DataFrame:
    """(device, flag, severity, detail, path) of repaired profiles, each once, by all rules or those named in ``flags``.

    Repairs, and the tokens of actions and notes, are written once with the profiles, as the rules read them again and again: of
    all columns those that the rules read. No rule reads an occasion but by its repair.
    """
    p = profiles.withColumn("repairs", cleared())
    p = p.withColumn("_actions", F.transform("actions", lambda a: H.content_tokens(a["action"]))).withColumn("_notes", F.transform("evidence", lambda e: H.content_tokens(e["note"])))
    p = p.withColumn("_fields", F.array_distinct(F.transform("evidence", lambda e: F.trim(e["field"]))))
    read = [n for n in p.columns if n == "device" or any(n in READ[f] for f in flags)]
    return written(p.select(*read), "repaired").select("device", F.explode(F.array_distinct(rules(flags))).alias("f")).select("device", "f.*")


#: Columns that the rules read.
_PATHS = ("actions", "requires", "n_surfaces")
READ = {
    "evidence_incomplete": ("_fields", "requires", "controllable", "displays", "protective"), "occasion_circular": ("repairs",), "direction_mismatch": ("evidence",), "evidence_heading_invalid": ("evidence",),
    "evidence_shape_invalid": ("evidence",), "unknown_field": ("evidence", *_PATHS), "evidence_support_mismatch": ("evidence", "actions", "_actions", "_notes"), "dangling_needed_for": _PATHS,
    "action_without_surface": ("actions", "n_surfaces"), "speaks_but_inert": ("n_speaks", "n_surfaces", "actions"), "category_freeform_provenance": ("category",), "coverage_low": ("coverage",), "low_confidence_profile": ("confidence",),
}
