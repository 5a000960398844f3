"""Blocks of a page: lines that a page's layout wrapped are joined again, and each block gets a kind.

A page is folded inside its own row, so that nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marginalia.functions.text import TOKEN

# What lines and blocks begin with or hold, in the order in which kinds are tried.
HEADING = re.compile(r"^\s*(\d+(?:\.\d+){1,3})\s+(.{2,100}?)\s*[:.]?\s*$")
LIST = re.compile(r"^\s*(?:[-•*]|\(?[a-zA-Z0-9]+[.)])\s+")
FORMULA = re.compile(r"(?:=|→|←|⇌|\+\s*[A-Z][a-z]?|\b(?:sin|cos|tan)\b|\d+\s*[×÷/]\s*\d+)")
FIGURE = re.compile(r"^(?:fig(?:ure)?\.?|diagram|image)\s*\d*", re.I)
ACTIVITY = re.compile(r"^(?:activity|lab activity|think and discuss|do this|try this)\b", re.I)
EXAMPLE = re.compile(r"^(?:example|worked example)\b", re.I)
QUESTION = re.compile(r"^(?:questions?|exercise|what|why|how|when|where|which|can you|do you)\b", re.I)
MOST_HEADING_TOKENS, FULL_BLOCK_TOKENS, MOST_TABLE_TOKENS, MOST_FORMULA_TOKENS = 14, 35, 100, 80

_TOKENS = re.compile(TOKEN)


def size(text: str) -> int:
    return len(_TOKENS.findall(text))


def heading(line: str, title: str | None) -> str | None:
    """The heading a line is, if it is one: numbered, or equal to the page's section title."""
    line = line.strip(" -")
    n = size(line)
    if not line or n > MOST_HEADING_TOKENS or line.endswith("?") or QUESTION.match(line) or ACTIVITY.match(line):
        return None
    if HEADING.match(line):
        return line.rstrip(".:")
    bare = lambda x: x.lower().strip(" .:")
    wanted = bare(" ".join((title or "").split()))
    return line if wanted and bare(line) == wanted and n > 1 and not LIST.match(line) else None


def kind(text: str, has_table: bool, has_equation: bool) -> str:
    n = size(text)
    tests = (
        ("activity", ACTIVITY.match(text)), ("example", EXAMPLE.match(text)), ("question", QUESTION.match(text) or text.endswith("?")), ("figure_caption", FIGURE.match(text)), ("bullet_list", LIST.match(text)),
        ("table_text", has_table and n < MOST_TABLE_TOKENS), ("formula", FORMULA.search(text) or has_equation and n < MOST_FORMULA_TOKENS),
    )
    return next((name for name, hit in tests if hit), "paragraph")


def page_blocks(text: str | None, title: str | None = None, has_table: bool = False, has_equation: bool = False) -> list[tuple[str, str]]:
    """(kind, text) in order.

    A blank line ends a block, a heading is one of its own, and list items, activities,
    examples and captions begin one; so does the line after a sentence end once a
    block is long enough to be a paragraph.
    """
    groups: list[list[str]] = [[]]
    headings: dict[int, str] = {}
    for line in (" ".join(x.split()) for x in (text or "").splitlines()):
        if not line:
            groups.append([])
        elif found := heading(line, title):
            headings[len(groups)] = found
            groups += [[found], []]
        else:
            if any(p.match(line) for p in (LIST, ACTIVITY, EXAMPLE, FIGURE)):
                groups.append([line])
                continue
            groups[-1].append(line)
            if line[-1] in ".!?:" and size(" ".join(groups[-1])) >= FULL_BLOCK_TOKENS:
                groups.append([])
    joined = ((i, " ".join(g)) for i, g in enumerate(groups) if g)
    return [("heading", x) if i in headings else (kind(x, has_table, has_equation), x) for i, x in joined]


def split_blocks(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, no, kind, tokens, text) of (keep, cleaned_text, section_title, has_table, has_equation_like_text); null texts have no blocks, null flags are false."""
    keep = list(keep)
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, no, kinds, texts = [], [], [], []
            for i, (text, title, table, equation) in enumerate(zip(*[b.column(c).to_pylist() for c in ("cleaned_text", "section_title", "has_table", "has_equation_like_text")])):
                for k, (name, block) in enumerate(page_blocks(text, title, bool(table), bool(equation))):
                    which.append(i)
                    no.append(k)
                    kinds.append(name)
                    texts.append(block)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], pa.array(no, pa.int32()), pa.array(kinds, pa.string()), pa.array([size(t) for t in texts], pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*keep, "cleaned_text", "section_title", "has_table", "has_equation_like_text").mapInArrow(run, schema)
