"""Text with the exact place in its sources of every character, as a struct of Columns.

A mapped text is STRUCT<text, spans ARRAY<STRUCT<document_id, unit_id, source_start,
source_end, text_start, text_end>>>; intervals are half open and count code points.
Everything is built in: cutting, joining and checking stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<document_id:string,unit_id:string,source_start:int,source_end:int,text_start:int,text_end:int>"


def _span(document: Column, unit: Column, source: Column, start: Column, end: Column) -> Column:
    """A span whose source begins at `source`."""
    return F.struct(document.alias("document_id"), unit.alias("unit_id"), source.alias("source_start"), (source + end - start).alias("source_end"), start.alias("text_start"), end.alias("text_end"))


def mapped(text: Column, spans: Column) -> Column:
    return F.struct(text.alias("text"), spans.alias("spans"))


def whole_unit(document: Column, unit: Column, text: Column) -> Column:
    """A source unit as mapped text; an empty or null one has no span."""
    clean = F.coalesce(text, F.lit(""))
    one = F.array(_span(document.cast("string"), unit.cast("string"), F.lit(0), F.lit(0), F.length(clean)))
    return mapped(clean, F.when(F.length(clean) > 0, one).otherwise(F.array().cast(f"array<{SPAN}>")))


def cut(m: Column, start: Column, end: Column) -> Column:
    """Characters start..end of a mapped text, with the parts of the spans that lie there."""
    touched = F.filter(m["spans"], lambda s: (s["text_start"] < end) & (s["text_end"] > start))

    def clip(s: Column) -> Column:
        low, high = F.greatest(s["text_start"], start), F.least(s["text_end"], end)
        return _span(s["document_id"], s["unit_id"], s["source_start"] + low - s["text_start"], low - start, high - start)

    return mapped(F.substr(m["text"], start + 1, end - start), F.transform(touched, clip))


def join(left: Column, right: Column, separator: str = "\n") -> Column:
    """Two mapped texts as one; the separator must be white space, as it has no source."""
    if separator.strip():
        raise ValueError("text without a source must be white space")
    shift = F.length(left["text"]) + len(separator)
    moved = F.transform(right["spans"], lambda s: _span(s["document_id"], s["unit_id"], s["source_start"], s["text_start"] + shift, s["text_end"] + shift))
    return mapped(F.concat(left["text"], F.lit(separator), right["text"]), F.concat(left["spans"], moved))


def uncovered(m: Column) -> Column:
    """Number of characters other than white space that no span covers; spans must be in text order and apart."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("rest"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(m["text"], acc["at"] + 1, F.greatest(s["text_start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["text_end"]).alias("at"), F.concat(acc["rest"], gap).alias("rest"))

    end = F.aggregate(m["spans"], state, step)
    rest = F.concat(end["rest"], F.substr(m["text"], end["at"] + 1, F.length(m["text"])))
    return F.length(F.regexp_replace(rest, r"(?U)\s+", ""))


def matches_source(m: Column, units: Column) -> Column:
    """Whether every span's text stands at its place in units, a MAP<unit_id, text>; an unknown unit does not match."""
    same = lambda s: F.coalesce(F.substr(F.element_at(units, s["unit_id"]), s["source_start"] + 1, s["source_end"] - s["source_start"]) == F.substr(m["text"], s["text_start"] + 1, s["text_end"] - s["text_start"]), F.lit(False))
    return F.forall(m["spans"], same)


def first_words(m: Column, most: int) -> Column:
    """The mapped text up to the end of its `most`-th word; white space stays as it is."""
    kept = F.regexp_extract(m["text"], rf"(?U)^(?:\s*\S+){{0,{most}}}", 0)
    return cut(m, F.lit(0), F.length(kept))


def resolve(m: Column, quote: Column) -> Column:
    """Source places (ARRAY of spans) of the first occurrence of a quotation in a mapped text; null where it is missing or blank."""
    at = F.position(quote, m["text"])
    return F.when(F.trim(quote) == "", None).when(at > 0, cut(m, at - 1, at - 1 + F.length(quote))["spans"])
