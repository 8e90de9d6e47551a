"""Text expressions: tokens, overlap, headings, clipping. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN_HEADING = r"^(Chapter|Section|Part) [0-9]+"
NUMBERED_HEADING = r"^[0-9]+(\.[0-9]+)* [A-Z]"


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of at least three characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets: shared / smaller; null if one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def clip_at_word(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis where something is cut."""
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def is_heading(line: Column) -> Column:
    """Numbered, chapter or capitals of two to eight words, not too long."""
    n = F.size(F.split(line, " "))
    capitals = line.rlike(r"^[A-Z0-9 !,.-]+$") & line.rlike("[A-Z]{2}") & n.between(2, 8)
    return (F.length(line) <= 80) & (line.rlike(NUMBERED_HEADING) | line.rlike(ROMAN_HEADING) | capitals)


def is_short_label(line: Column) -> Column:
    """At most 80 characters, two letters in a row, under 12 % beyond ASCII."""
    beyond = F.length(F.regexp_replace(line, r"[\x00-\x7F]+", ""))
    return (F.length(line) <= 80) & line.rlike("[A-Za-z]{2}") & (beyond < F.length(line) * 0.12)
