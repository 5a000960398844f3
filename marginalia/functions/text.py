"""Scalar text functions as Column expressions, all built-in and inside code generation where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and tables that results depend on.
TOKEN = r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*"
SECTION = r"(?m)^\s*((?:\d{1,2}\.){1,3}\d*\s+[^\n]{3,100})\s*$"
TABLE_MARK = r"(?i)\btable\s*[-:]?\s*\d+|\btabular\b"
FIGURE_MARK = r"(?i)\b(?:fig(?:ure)?|diagram)\s*[-:]?\s*[A-Z]?\d+"
EQUATION = r"(?i)(?:[A-Za-z0-9)\]]\s*[=+−–]\s*[A-Za-z0-9(\[]|\b(?:sin|cos|tan)\s*[A-Za-zθ]|\b[A-Z][a-z]?\s*\d{1,2}\b|\b\d+(?:\.\d+)?\s*(?:V|A|W|Ω|ohm|J|N|m/s|cm|kg)\b)"
STOPWORDS = "a an and are as at be by for from has have in into is it of on or that the their this to was when where which with".split()
SUFFIXES = ("ization", "ation", "ingly", "edly", "ing", "ies", "ed", "es", "s")
ENGLISH_COMMON = (
    "the of and to in is are was were for with from by as this that these those it its we you they can may chapter activity "
    "example question answer explain describe define what how why when which students learning"
).split()
LATIN_WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; a lambda that refers to an expression would compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(c: Column | str) -> Column:
    """Lower-cased tokens in order; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def collapse(c: Column | str) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clip_words(c: Column, limit: int) -> Column:
    """Collapsed text of at most `limit` characters, cut at a word end where there is one."""
    flat = collapse(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.regexp_replace(F.substring(flat, 1, limit), r"\s+\S*$", ""))


# Lines that the source books repeat on their pages.
BOILERPLATE = (r"(?i)Government['’]s Gift for Students['’] Progress", r"(?m)^\s*CLASS\s+(?:X|10)\s*$")


def clean_text(c: Column | str) -> Column:
    """Repairs replacement characters, line-end hyphens and white space of an extracted page and takes out the books' boilerplate."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.replace(c, F.lit("�"), F.lit("'"))
    for pattern in BOILERPLATE:
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(t, r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cleaning_notes(raw: Column, cleaned: Column, chapter: Column) -> Column:
    """What cleaning found, in fixed order; chapter is the page's chapter title, if any."""
    low, title = F.lower(cleaned), F.nullif(F.lower(chapter), F.lit(""))
    times = (F.length(low) - F.length(F.replace(low, title, F.lit("")))) / F.length(title)
    return F.array_compact(F.array(
        F.when(F.contains(raw, F.lit("�")), "replacement_character_present_in_raw_text"),
        F.when(raw.rlike(r"[A-Za-z]-\s*\n\s*[a-z]"), "line_break_hyphenation_repaired"),
        F.when(times > 1, "repeated_chapter_title_in_text_layer"),
        F.when(F.length(cleaned) < 100, "low_text_page"),
    ))


def section_title(c: Column) -> Column:
    """First numbered heading, at most 160 characters; null where there is none."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_extract(c, SECTION, 1), r"\s+", " ")), 1, 160), F.lit(""))


def content_tokens(c: Column) -> Column:
    """Distinct tokens without stop words and single characters, endings cut where four letters stay."""

    def stem(t: Column) -> Column:
        cut = F.lit(None).cast("string")
        for s in reversed(SUFFIXES):
            cut = F.when(t.endswith(s) & (F.length(t) - len(s) >= 4), F.substr(t, F.lit(1), F.length(t) - len(s))).otherwise(cut)
        return F.coalesce(cut, t)

    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.transform(F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)), stem))


def token_recall(reference: Column, candidate: Column) -> Column:
    """Share of the reference's content tokens the candidate has; 1 for an empty reference."""
    r = content_tokens(reference)
    return F.when(F.size(r) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(r, content_tokens(candidate))) / F.size(r))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard of two token arrays; `empty` where both (for 0.0: either) are empty."""
    union = F.size(F.array_union(a, b))
    none = (F.size(a) == 0) & (F.size(b) == 0) if empty else (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(words: Column, size: int = 5) -> Column:
    """Distinct runs of `size` tokens, joined by blanks; a shorter text is one shingle, an empty one none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    return let(words, runs)


def longest_repeat(words: Column) -> Column:
    """Length of the longest run of equal consecutive words."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["w"] == w, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda acc: acc["best"])


def corruption_reason(c: Column) -> Column:
    """First reason for which a text counts as corrupt; null where it is fine."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (
        F.when(F.length(F.coalesce(t, F.lit(""))) == 0, "empty_output")
        .when(t.rlike(r"(?i)<unused\d+>"), "unused_token_stream")
        .when(bad > F.greatest(F.lit(1), F.floor(F.length(t) / 100)), "replacement_character_corruption")
        .when(longest_repeat(F.split(t, r"(?U)\s+")) >= 20, "repeated_token_stream")
    )


def sentences(c: Column, most_words: int) -> Column:
    """Sentences in order; longer ones in runs of `most_words` words."""
    parts = F.split(collapse(c), r"(?<=[.!?])\s+(?=[A-Z0-9])")

    def wrap(s: Column) -> Column:
        return let(F.split(s, " "), lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most_words)), lambda i: F.array_join(F.slice(w, i, most_words), " ")))

    return F.flatten(F.transform(F.filter(parts, lambda s: s != ""), wrap))


def word_windows(c: Column, size: int, step: int) -> Column:
    """(start, text) of windows of `size` words every `step` words; the last one reaches the end."""

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))
        starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
        return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, size), " ").alias("text"))))

    return let(F.filter(F.split(collapse(c), " "), lambda x: x != ""), windows)


def snippet(text: Column, query: Column, width: int = 360) -> Column:
    """Preview that begins 80 characters before the first query token of more than three characters."""
    flat = collapse(text)
    low = F.lower(flat)
    at = F.array_min(F.filter(F.transform(F.filter(tokens(query), lambda t: F.length(t) > 3), lambda t: F.position(t, low) - 1), lambda p: p >= 0))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - 80)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(flat, start + 1, F.lit(width)), F.when(start + width < F.length(flat), "…").otherwise(""))


def nearest_rank(sorted_values: Column, share: float) -> Column:
    """Element at the rounded index of a sorted array."""
    return F.element_at(sorted_values, (F.floor(F.lit(share) * (F.size(sorted_values) - 1) + 0.5) + 1).cast("int"))
