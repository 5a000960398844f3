"""Checks and scores of generated answers, built in: JSON shape, citations, lexical support and overlap with references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import content_tokens, let, token_recall

# Keys, states and messages of an answer.
ANSWER_KEYS = ("answer", "citations", "missing_information", "selected_evidence_ids", "status")
STATES = ("answered", "insufficient_evidence")
CITATION_KEYS = ("evidence_id", "pdf_page", "textbook_page")
POINT_RECALL, CLAIM_RECALL = 0.6, 0.8
_NUMBER = r"\d+(?:\.\d+)?"


def strip_fence(raw: Column) -> Column:
    """JSON text without the fence some models put around it."""
    return F.regexp_replace(F.regexp_replace(raw, r"^\s*(?:```json|```)?\s*", ""), r"\s*(?:```)?\s*$", "")


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _strings(v: Column, path: str) -> Column:
    """Whether a value is an array of strings."""
    return _kind(v, path).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(v, path, "array<string>"), lambda x: x.isNull()), F.lit(False))


def parse_answer(raw: Column, evidence: Column) -> Column:
    """STRUCT<valid, errors, status, answer, citations, valid_citations> of an answer's JSON text.

    evidence: ARRAY<STRUCT<evidence_id, pdf_pages ARRAY<INT>, textbook_pages ARRAY<STRING>>> that
    the model was given. Errors come in fixed order; what is no JSON has one error.
    """
    body = strip_fence(raw)
    known = F.transform(evidence, lambda e: e["evidence_id"])

    def check(v: Column) -> Column:
        keys = F.array_sort(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")))
        selected = F.coalesce(F.try_variant_get(v, "$.selected_evidence_ids", "array<string>"), F.array().cast("array<string>"))
        listed = _kind(v, "$.citations").startswith("ARRAY")
        cited = F.coalesce(F.try_variant_get(v, "$.citations", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))

        def problem(c: Column) -> Column:
            item = F.get(F.filter(evidence, lambda e: e["evidence_id"] == c["evidence_id"]), F.lit(0))
            pages = F.array_contains(item["pdf_pages"], c["pdf_page"].try_cast("int")) & F.array_contains(item["textbook_pages"], c["textbook_page"])
            return (
                F.when(c.isNull() | (F.array_sort(F.map_keys(c)) != F.array(*map(F.lit, CITATION_KEYS))), "citation has invalid shape")
                .when(item.isNull(), "citation uses unknown evidence ID")
                .when(~F.coalesce(pages, F.lit(False)), "citation page metadata does not match supplied evidence")
            )

        problems = F.transform(cited, problem)
        errors = F.concat(
            F.array_compact(F.array(
                F.when(keys != F.array(*map(F.lit, ANSWER_KEYS)), "output must contain exactly the five required keys"),
                F.when(~F.coalesce(F.try_variant_get(v, "$.status", "string").isin(*STATES), F.lit(False)), "invalid status"),
                F.when(_kind(v, "$.answer") != "STRING", "answer must be a string"),
                F.when(~_strings(v, "$.selected_evidence_ids"), "selected_evidence_ids must be a string array"),
                F.when(~_strings(v, "$.missing_information"), "missing_information must be a string array"),
                F.when(F.size(F.array_except(selected, known)) > 0, "selected evidence contains unknown IDs"),
                F.when(~listed, "citations must be an array"),
            )),
            F.array_compact(problems),
        )
        return F.struct(
            (F.size(errors) == 0).alias("valid"), errors.alias("errors"), F.try_variant_get(v, "$.status", "string").alias("status"), F.coalesce(F.try_variant_get(v, "$.answer", "string"), F.lit("")).alias("answer"),
            F.size(cited).alias("citations"), F.size(F.filter(problems, lambda p: p.isNull())).alias("valid_citations"),
        )

    none = F.struct(F.lit(False).alias("valid"), F.array(F.lit("invalid JSON")).alias("errors"), F.lit(None).cast("string").alias("status"), F.lit("").alias("answer"), F.lit(0).alias("citations"), F.lit(0).alias("valid_citations"))
    return F.when(F.try_parse_json(body).isNull(), none).otherwise(check(F.try_parse_json(body)))


def supported(claim: Column, quotes: Column, least: float = 0.55) -> Column:
    """Whether the quotations hold enough of a claim's content words, and every number it names; a claim without content words is unsupported."""
    share = F.size(F.array_intersect(content_tokens(claim), content_tokens(quotes))) / F.greatest(F.size(content_tokens(claim)), F.lit(1))
    numbers = F.array_except(F.regexp_extract_all(claim, F.lit(_NUMBER), F.lit(0)), F.regexp_extract_all(quotes, F.lit(_NUMBER), F.lit(0)))
    return (share >= least) & (F.size(numbers) == 0)


def point_coverage(points: Column, answer: Column, least: float = POINT_RECALL) -> Column:
    """Share of the required points whose content words the answer has."""
    return F.size(F.filter(points, lambda p: token_recall(p, answer) >= least)) / F.size(points)


def unsupported_claims(claims: Column, answer: Column, least: float = CLAIM_RECALL) -> Column:
    """The prohibited claims an answer makes."""
    return F.filter(claims, lambda c: token_recall(c, answer) >= least)


def normal_answer(c: Column) -> Column:
    """Lower case, without punctuation, articles and repeated blanks: the public question-answering definition."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def answer_overlap(predicted: Column, gold: Column) -> Column:
    """STRUCT<em, precision, recall, f1> of two answers by their multisets of normalised words; yes, no and noanswer only match themselves."""
    closed = ("yes", "no", "noanswer")

    def score(p: Column, g: Column) -> Column:
        words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
        pw, gw = words(p), words(g)
        count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
        both = F.aggregate(F.array_distinct(pw), F.lit(0), lambda n, w: n + F.least(count(pw, w), count(gw, w)))
        ok = (both > 0) & ~((p != g) & (p.isin(*closed) | g.isin(*closed)))
        precision, recall = F.when(ok, both / F.size(pw)).otherwise(0.0), F.when(ok, both / F.size(gw)).otherwise(0.0)
        return F.struct((p == g).cast("int").alias("em"), precision.alias("precision"), recall.alias("recall"), F.when(ok, 2 * both / (F.size(pw) + F.size(gw))).otherwise(0.0).alias("f1"))

    return let(normal_answer(predicted), lambda p: let(normal_answer(gold), lambda g: score(p, g)))


def set_overlap(predicted: Column, gold: Column) -> Column:
    """STRUCT<em, precision, recall, f1> of two arrays as sets; an empty side scores 0, two equal sets match."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    share = lambda n: F.coalesce(F.try_divide(both, n), F.lit(0.0))
    return F.struct(((both == F.size(p)) & (both == F.size(g))).cast("int").alias("em"), share(F.size(p)).alias("precision"), share(F.size(g)).alias("recall"), share((F.size(p) + F.size(g)) / 2).alias("f1"))


def joint_f1(a: Column, b: Column) -> Column:
    """F1 of the products of two overlaps' precisions and recalls."""
    p, r = a["precision"] * b["precision"], a["recall"] * b["recall"]
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def estimated_cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    """Cost of a call in the currency of the prices; null unless both counts are known, not negative and the first is above 0."""
    return F.when((prompt > 0) & (completion >= 0), (prompt * per_million_in + completion * per_million_out) / 1_000_000)
