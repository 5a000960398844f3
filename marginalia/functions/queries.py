"""Question processing: ordered rules that rewrite or extend a question, and the names of the rules that fired."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rewrite rules, synonym table, acronyms and quantities.
SPELLING = (
    (r"\bteh\b", "the"), (r"\brecieve\b", "receive"), (r"\bbecuase\b", "because"), (r"\belectricty\b", "electricity"),
    (r"\bphotosythesis\b", "photosynthesis"), (r"\bchromosones\b", "chromosomes"),
)
GRAMMAR = (
    (r"\bgonna\b", "going to"), (r"^How food go\b", "How does food go"), (r"^Why equation need\b", "Why does an equation need"),
    (r"\bgreen plants feed itself\b", "green plants feed themselves"), (r"\batomic relationship happen\b", "atomic relationships happen"),
)
SYNONYMS = (
    (("plant", "eat"), "autotrophic nutrition photosynthesis make food"), (("plant", "feed"), "autotrophic nutrition photosynthesis make food"),
    (("cell", "energy", "food"), "cellular respiration"), (("kidney", "working unit"), "nephron"), (("kidney", "pee"), "urine formation filtration"),
    (("blood", "heart", "twice"), "double circulation"), (("pollen", "seed"), "pollination fertilization seed formation"),
    (("oxygen", "lungs", "body"), "haemoglobin oxygen transport"), (("energy", "without oxygen"), "anaerobic respiration aerobic respiration"),
    (("cell", "half", "chromosome"), "meiosis mitosis daughter cells"), (("rainwater", "groundwater"), "water harvesting groundwater recharge"),
    (("magnet", "electricity", "wire"), "electromagnetic induction"), (("short-sighted", "concave lens"), "myopia correction"),
    (("broken", "parallel circuit"), "independent current paths"), (("share electron",), "covalent bonding electron sharing"),
    (("atomic relationship",), "chemical bonding atoms"), (("bent", "water"), "refraction of light"),
    (("mirror", "vehicles", "smaller"), "convex mirror diminished image"), (("chemically opposite", "cancel"), "acid base neutralisation"),
)
ACRONYMS = ((r"(?i)\bpH\b", "potential of hydrogen pH scale"), (r"(?i)\bkWh\b", "kilowatt hour"), (r"(?i)\b\d+\s*W\b", "watt"))
QUANTITIES = (
    ("voltage", "potential difference V"), ("current", "electric current I"), ("resistance", "resistance R ohm Ω"), ("focal length", "focal length f"),
    ("object distance", "object distance u"), ("image distance", "image distance v"), ("shorter focus", "focal length f power of lens P"),
    ("mirror formula", "1/f 1/v 1/u sign convention"), ("parallel resistors", "equivalent resistance 1/R"), ("electric power", "power P voltage V current I"),
)


def _rewrite(q: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        q = F.regexp_replace(q, "(?i)" + pattern, to)
    return q


def _extend(q: Column, label: str, additions: list[Column], distinct: bool = False) -> Column:
    found = F.array_compact(F.array(*additions))
    found = F.array_distinct(found) if distinct else found
    return F.when(F.size(found) > 0, F.concat(q, F.lit(f" {label}: "), F.array_join(found, " "))).otherwise(q)


def spelling_normalization(q: Column) -> Column:
    return _rewrite(q, SPELLING)


def grammar_cleanup(q: Column) -> Column:
    return _rewrite(q, GRAMMAR)


def synonym_expansion(q: Column) -> Column:
    low = F.lower(q)
    hits = []
    for triggers, terms in SYNONYMS:
        cond = F.lit(True)
        for t in triggers:
            cond &= F.contains(low, F.lit(t))
        hits.append(F.when(cond, terms))
    return _extend(q, "Related textbook terms", hits, distinct=True)


def acronym_expansion(q: Column) -> Column:
    return _extend(q, "Expanded terms", [F.when(q.rlike(p), x) for p, x in ACRONYMS])


def quantity_expansion(q: Column) -> Column:
    low = F.lower(q)
    return _extend(q, "Normalized quantities", [F.when(F.contains(low, F.lit(t)), x) for t, x in QUANTITIES])


#: Processors by name.
PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda q: q, "spelling_normalization": spelling_normalization, "grammar_cleanup": grammar_cleanup,
    "textbook_synonym_expansion": synonym_expansion, "acronym_expansion": acronym_expansion, "formula_symbol_normalization": quantity_expansion,
}


def process(method: str, q: Column) -> Column:
    if method not in PROCESSORS:
        raise ValueError(f"unknown query processor: {method}")
    return PROCESSORS[method](q)


def fired(method: str, q: Column) -> Column:
    """Names of a processor's rules that fire on a question, in order; a question without any stays as it is.

    Rewrite rules are looked for in the text the rules before them left.
    """
    low = F.lower(q)
    if method == "raw":
        return F.array().cast("array<string>")
    if method in ("spelling_normalization", "grammar_cleanup"):
        kind, rules = ("spelling", SPELLING) if method.startswith("s") else ("grammar", GRAMMAR)
        hits, text = [], q
        for pattern, to in rules:
            hits.append(F.when(text.rlike("(?i)" + pattern), f"{kind}:{to}"))
            text = F.regexp_replace(text, "(?i)" + pattern, to)
    elif method == "textbook_synonym_expansion":
        hits = [F.when(F.forall(F.array(*map(F.lit, triggers)), lambda t: F.contains(low, t)), "synonym:" + "+".join(triggers)) for triggers, _ in SYNONYMS]
    elif method == "acronym_expansion":
        hits = [F.when(q.rlike(p), f"acronym:{x}") for p, x in ACRONYMS]
    elif method == "formula_symbol_normalization":
        hits = [F.when(F.contains(low, F.lit(t)), f"quantity:{t}") for t, _ in QUANTITIES]
    else:
        raise ValueError(f"unknown query processor: {method}")
    return F.array_compact(F.array(*hits))
