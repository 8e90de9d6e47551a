"""Lines of manuals: headings, callouts, junk, clipping; and quantities, sentences and stems of words. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How numbered headings begin, and phrases of prose that is no heading; fixed values.
NUMBERED = r"^\d+(?:\.\d+)*\.?\s+\S"
PROSE = r"(?i)\b(select to|including|your display has)\b"
#: A line of twelve words or fewer, by one pass that ends at the thirteenth.
FEW = r"^\s*+(?:\S++\s*+){0,12}+\z"
#: Words that show a question about a fault; fixed values.
TROUBLE = (
    r"(?i)\b(troubleshoot(?:ing)?|problem|issue|fault|error|alarm|warning|not\s+work(?:ing)?|won'?t|will\s+not|doesn'?t|didn'?t|can'?t|fail(?:ed|ing|ure)?|broken|leak(?:ing|s)?|overheat(?:ing|s)?|"
    r"smoke|smell|noise|vibration|intermittent|symptom|diagnos|why\s+is|how\s+(?:do|can)\s+i\s+fix|what(?:'?s|\s+is)\s+wrong)\b"
)
#: A number or range with a unit of power or energy; a fixed value.
QUANTITY = r"(?i)(\d+(?:[.,]\d+)?(?:\s*[–\-]\s*\d+(?:[.,]\d+)?)?)\s*(kwh|kw|w)\b"
#: Endings that a stem drops, in this order; words left out of comparisons. Fixed values.
ENDINGS = ("ing", "tion", "ed", "es", "s")
STOP = ("the", "a", "an", "and", "or", "to", "via", "for", "with", "from", "of", "on", "in", "set", "mode", "disabl", "enabl", "updat", "turn", "how")


def words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")


def is_callout(line: Column) -> Column:
    """Letter keys of a figure: up to 16 single letters, or a caption behind one of them."""
    w = words(line)
    letters = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}$")))
    lead = F.get(w, F.lit(0)).rlike(r"^\p{L}$")
    return F.coalesce(((letters == F.size(w)) & F.size(w).between(1, 16)) | (lead & (F.size(w) >= 2)), F.lit(False))


def is_junk(line: Column) -> Column:
    """Blank, long, dotted, only numbers, or a callout."""
    s = F.trim(line)
    return (s == "") | (F.length(s) > 120) | s.contains("...") | s.rlike(r"^[.\s\d]+$") | is_callout(s)


def usable(heading: Column) -> Column:
    s = F.trim(heading)
    n = F.size(words(s))
    prose = (s.rlike(r"[.!?]\s*$") & (n > 6)) | s.rlike(PROSE)
    return F.coalesce(~is_junk(s) & (n <= 12) & ~prose, F.lit(False))


def is_section_title(section: Column) -> Column:
    """Short, no letter crumbs, no prose. Long lines, most of a text, are told by ``FEW`` before they are split into words."""
    s = F.trim(section)

    def bad(w: Column) -> Column:
        n = F.size(w)
        small = F.size(F.filter(w, lambda x: F.length(F.regexp_replace(x, "[^A-Za-z0-9]", "")) <= 1))
        return ((n >= 2) & (small >= 0.75 * n)) | (s.rlike(r"[.!?]\s*$") & (n > 6)) | (s.rlike(r"(?i)^i\s+\w+") & (n > 4))

    crumbs = s.rlike(r"^(?:[A-Za-z]\s+)+[A-Za-z]$")
    once = F.get(F.transform(F.array(words(s)), bad), F.lit(0))  # the words are made once, not where each rule names them
    return F.coalesce((s != "") & s.rlike(FEW) & ~crumbs & ~s.rlike(PROSE) & ~once, F.lit(False))


def is_upper(line: Column) -> Column:
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")


def is_heading(line: Column) -> Column:
    """Numbered, a chapter, section or appendix, or two to eight words in capitals that do not begin with AC; no junk."""
    s = F.trim(F.ltrim(F.trim(line), F.lit("#")))
    capitals = is_upper(s) & F.size(words(s)).between(2, 8) & ~s.startswith("AC ")
    return ~is_junk(s) & (s.rlike(NUMBERED) | s.rlike(r"(?i)^(Chapter|Section|Appendix)\b") | capitals)


def guessed(text: Column) -> Column:
    """The heading a chunk seems to be under: its first numbered line, else one in capitals, else the first usable line,
    joined with the next where it is a few words without an end; at most 200 characters, null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.ltrim(F.trim(x), F.lit("#")))), lambda x: x != "")
    good = F.filter(lines, lambda x: ~is_junk(x))
    numbered = F.get(F.filter(good, lambda x: x.rlike(NUMBERED)), F.lit(0))
    capital = F.get(F.filter(good, lambda x: is_upper(x) & F.size(words(x)).between(2, 8) & ~x.startswith("AC ") & usable(x)), F.lit(0))

    def candidate(line: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        joined = F.concat_ws(" ", line, after)
        open_ = (F.size(words(line)) <= 3) & ~line.rlike(r"[.:;)]$") & after.isNotNull() & ~is_junk(after)
        return F.when(is_junk(line), None).when(F.coalesce(open_, F.lit(False)) & usable(joined), joined).when(usable(line), line)

    first = F.get(F.array_compact(F.transform(lines, candidate)), F.lit(0))
    return F.left(F.coalesce(numbered, capital, first), F.lit(200))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last line end, else the last space, where that is past the half."""
    cut = F.left(text, F.lit(limit))
    last = lambda c: F.length(cut) - F.instr(F.reverse(cut), c)
    at = lambda c: (F.instr(cut, c) > 0) & (last(c) >= limit // 2)
    ended = lambda c: F.rtrim(F.left(cut, last(c)))
    return F.when(F.length(text) <= limit, text).when(at("\n"), ended("\n")).when(at(" "), ended(" ")).otherwise(cut)


def quantities(text: Column) -> Column:
    """Distinct ``number|unit`` of power and energy, decimal commas and hyphens made alike, sorted."""
    found = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))

    def token(q: Column) -> Column:
        number = F.regexp_replace(F.replace(F.replace(F.regexp_extract(q, QUANTITY, 1), F.lit(","), F.lit(".")), F.lit("-"), F.lit("–")), r"\s+", "")
        return F.concat(number, F.lit("|"), F.lower(F.regexp_extract(q, QUANTITY, 2)))

    return F.array_sort(F.array_distinct(F.transform(found, token)))


def sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(paragraph), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def stem(word: Column) -> Column:
    """The word without the first ending it has, if it is longer than four letters."""
    long = F.length(word) > 4
    return reduce(lambda rest, e: F.when(long & word.endswith(e), F.left(word, F.length(word) - len(e))).otherwise(rest), reversed(ENDINGS), word)


def content_tokens(text: Column) -> Column:
    """Distinct stems of words of two letters or more that are not stop words, as they are or as stems."""
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))
    return F.array_distinct(F.filter(F.transform(found, stem), lambda w: ~w.isin(*STOP)))
