"""Routing of queries to specialist branches, and the texts these branches index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import collapse

# Operator and unit spellings, in the order in which they are replaced.
FORMULA_SYMBOLS = (("−", "-"), ("–", "-"), ("—", "-"), ("×", " x "), ("÷", " / "), ("→", " -> "), ("⇒", " => "), ("µ", " proportional-to "), ("Ω", " ohm Ω "), ("°C", " degree Celsius "))
FORMULA_UNITS = ((r"(?i)\bKWH\b", "kWh kilowatt hour"), (r"(?<=\d)\s*W\b", " watt W"), (r"(?<=\d)\s*V\b", " volt V"))
TABLE_CAPTION = r"(?i)\btable\s*-?\s*\d+"


def formula_text(c: Column) -> Column:
    """Operators and units spelled out, blank lines dropped and line ends trimmed. The text should be in composed Unicode form."""
    for symbol, words in FORMULA_SYMBOLS:
        c = F.replace(c, F.lit(symbol), F.lit(words))
    for pattern, words in FORMULA_UNITS:
        c = F.regexp_replace(c, pattern, words)
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.array_join(lines, "\n")


def _compact(lines: Column) -> Column:
    """Lines that may be a header: two to eight words without a full stop."""
    return F.filter(lines, lambda x: F.size(F.split(x, " ")).between(2, 8) & ~x.rlike(r"[.!?]$"))


def table_text(c: Column, method: str) -> Column:
    """A page's table as one line (`flat`), one line per row that repeats the header (`rows`) or names and values (`pairs`).

    The header is the first compact line from twelve lines before the first caption to one
    after it, without a caption the first of the first twenty lines; else `Table row`.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), collapse), lambda x: x != "")
    if method == "flat":
        return F.array_join(lines, " ")
    caption = F.array_position(F.transform(lines, lambda x: x.rlike(TABLE_CAPTION)), True).cast("int")  # 0: none
    first = F.when(caption > 0, F.greatest(caption - 12, F.lit(1))).otherwise(1)
    last = F.when(caption > 0, caption + 1).otherwise(20)
    header = F.coalesce(F.get(_compact(F.slice(lines, first, last - first + 1)), F.lit(0)), F.lit("Table row"))
    rows = F.filter(lines, lambda x: (x != header) & F.contains(x, F.lit(" ")))
    if method == "rows":
        return F.array_join(F.transform(rows, lambda x: F.concat(F.lit("Header: "), header, F.lit(" | Row: "), x)), "\n")
    if method == "pairs":
        def pair(x: Column) -> Column:
            words = F.split(x, " ")
            key = F.when(F.size(words) < 6, 1).otherwise(2)
            return F.concat(header, F.lit(" | Key: "), F.array_join(F.slice(words, F.lit(1), key), " "), F.lit(" | Value: "), F.array_join(F.slice(words, key + 1, F.size(words)), " "))

        return F.array_join(F.transform(rows, pair), "\n")
    raise ValueError(f"unknown table representation: {method}")


def evidence_window(c: Column, anchor: Column, radius: int = 190) -> Column:
    """Text around the first occurrence of an anchor, from about half the radius before to the radius behind, at word borders; null where it is missing."""
    flat = collapse(c)
    at = F.position(F.lower(anchor), F.lower(flat)) - 1
    start = F.greatest(F.lit(0), at - radius // 2)
    end = F.least(F.length(flat), at + F.length(anchor) + radius)
    blank = F.position(F.lit(" "), flat, start + 1)
    start = F.when((start > 0) & (blank > 0), blank).otherwise(start)
    part = F.substr(flat, start + 1, end - start)
    shorter = F.regexp_replace(part, r" [^ ]*$", "")
    return F.when(at >= 0, F.when(end < F.length(flat), shorter).otherwise(part))


# What a query must say to activate a branch, by version.
ACTIVATION = {
    ("formula", "v1"): r"\b(formula|equation|law|voltage|current|resistan(?:ce|tor)|power|focal length|object distance|image distance|sign convention|pH|atom(?:s|ic)|electron|balanced|lens|mirror|reflection|refraction)\b|[=Ωµ×÷]",
    ("formula", "v2"): r"\b(formula|equation|law|voltage|resistance|electric power|focal length|object distance|image distance|sign convention|balanced|equivalent resistance|parallel resistors?|stronger lenses?|shorter focus)\b|\b\d+\s*W\b|[=Ωµ×÷]",
    ("formula", "v3"): r"\b(formula|equation|laws?|voltage|resistance|electric power|focal length|object distance|image distance|sign convention|balanced|equivalent resistance|parallel resistors?|stronger lenses?|shorter focus)\b|\b\d+\s*W\b|[=Ωµ×÷]",
    ("table", "v1"): r"\b(table|row|column|compare|differ(?:ence)?|functions?|attributed|auxins?|cytokinins?|mitosis|meiosis|chromosome(?:s)?|daughter cells?)\b",
    ("table", "v2"): r"\b(table|row|column|auxins?|cytokinins?|mitosis|meiosis)\b|\bchromosome(?:s)?\b.*\b(daughter cells?|half)\b|\bhalf\b.*\bchromosome(?:s)?\b",
    ("visual", "v1"): r"\b(diagram|figure|fig\.?|principal rays?|ray diagram|constructed|image formation|concave lens|convex lens|myopia|short-sighted|series|parallel circuit|branches)\b",
}


def activated(branch: str, query: Column, version: str = "v1") -> Column:
    """Whether a query's text calls for a branch; later versions keep an earlier one's pattern where they don't change it."""
    if version not in ("v1", "v2", "v3"):
        raise ValueError(f"unknown activation version: {version}")
    known = [v for b, v in ACTIVATION if b == branch and v <= version]
    if not known:
        raise ValueError(f"unknown specialist branch: {branch}")
    return query.rlike("(?i)" + ACTIVATION[branch, max(known)])
