"""Per-page text statistics, exact per-language ranks, and outlier scores that tell prose from lists, tables and junk.

Every statistic's distinct values are range-partitioned and summed with partition
offsets, which gives each value its exact empirical tail probabilities within its
language and among all pages. Pages count in these distributions by how far running
prose outweighs the rest of their characters, so that the tails are those of running
text however common junk is. A page's outlier score is the truncated
product of its tail probabilities: the sum of -ln(p) over the statistics whose p is
small. The score from which a page is no prose is fitted to the distribution of scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.ranks import range_running_sum
from marginalia.session import materialize

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in it is that was for on are as with by from at this be which or an a i not have has had they them their its but we you he she his her our your us me my if when then than there these those into so can could will would must may might should more most some one two each other another about no nor do does did how what why where who whose whom also only very such same both all any many much few over under between through after before until because while though although without within during against were been being even out up down here just",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht auch ist sind war waren wird werden wurde wurden hat haben hatte hatten im in an am auf aus bei beim mit nach von vom vor zu zum zur für über unter durch um als wie wenn weil dass sich er sie es wir ihr ich du man so nur noch schon sehr mehr kein keine ohne bis diese dieser dieses diesem diesen jede jeder jedes ihre ihren seine sein können kann muss soll warum was wer wo",
    "fr": "le la les un une des du de d l et ou mais ne pas est sont était a ont au aux en dans sur sous avec sans pour par plus moins que qui quoi dont où ce cet cette ces se s il elle ils elles on nous vous je tu son sa ses leur leurs notre votre quand comme si très presque avant après pendant entre vers chez être avoir fait peut y même aussi tout tous toute toutes car donc",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ha han al en con sin por para más menos que quien como cuando donde si se su sus lo le les este esta estos estas ese esa esto eso mi tu nos muy ya también porque hasta desde sobre entre antes después todo todos toda todas cada otro otra ser estar hay qué cuál mismo misma vamos aunque e a",
    "it": "il lo la i gli le un uno una di del della dei delle e o ma non è sono era ha hanno al alla in nel nella con senza per da dal dalla su sul sulla più meno che chi come quando dove se si suo sua loro questo questa questi queste molto anche perché fino tra fra prima dopo tutto tutti ogni",
    "pt": "o a os as um uma de do da dos das e ou mas não é são era foi tem têm ao à em no na nos nas com sem por para pelo pela mais menos que quem como quando onde se seu sua seus suas este esta isso isto muito também porque até desde sobre entre antes depois todo todos cada outro outra",
    "nl": "de het een en of maar niet is zijn was waren wordt worden heeft hebben had in op aan uit bij met naar van voor te tot om als dat die dit deze er hij zij ze wij we ik je u hun zich ook nog al meer geen door over onder tussen na",
    "hi": "है हैं था थी थे में की के का को से और ने पर तो भी यह वह ये वे इस उस इसे उसे इन उन एक हो होता होती होते जाता जाती जाते गया गई कर करता करती करते किया जब तब कि जो अपना अपनी अपने हम हमने वाले वाली नहीं या लिए साथ तक बाद उसकी उनकी उसके उनके",
}
#: name -> tail that counts against prose: "low", "high" or "both"
STATISTICS = {
    "word_count": "both",  # log2 of 1 + words
    "mean_word_length": "both",
    "symbol_ratio": "high",
    "digit_ratio": "high",
    "damage_ratio": "high",
    "ended_line_share": "low",
    "common_word_share": "low",
    "prose_share": "low",  # characters in lines of running prose
    "five_word_novelty": "low",  # distinct among the five-word sequences of running prose
    "three_word_novelty": "low",  # distinct among all three-word sequences
    "distinct_word_share": "low",
    "words_per_sentence": "high",
    "words_per_item": "low",  # words between separators or line ends
}
#: Tail probabilities above this say nothing against a page.
TRUNCATION = 0.05
#: A language's own distribution weighs as its pages do against so many pages of the distribution of all languages.
SHRINKAGE = 50.0
#: Pages that a value beyond all others counts as.
UNSEEN = 0.01
#: Steps of the score at which thresholds are tried.
SCORE_STEP = 0.25
#: A value that at least this share of all pages has is looked up by broadcast; there are at most (statistics / share) of them.
HOT_SHARE = 0.001

_EDGES = ".,;:!?\"'“”„«»‘’()[]{}¿¡।…*_|–—-"
_ENDS = tuple(".!?:。！？।…")
_CLOSERS = "\"'“”’»)]"
#: A line of running prose has so many words, this share of them common words of one language, and at most this share of damaged characters.
_LEAST_LINE_WORDS, _LEAST_COMMON, _MOST_DAMAGE = 5, 0.22, 0.06
_BLANK_BYTES = b" \t\n\r\v\f\x1c\x1d\x1e\x1f"
_LETTER_BYTES = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Vowel signs of Devanagari, which are no letters of their own.
_VOWEL_SIGNS = re.compile("[\u0900-\u0903\u093a-\u094f]")
#: Characters of texts decoded in the wrong encoding (fixed values), and the replacement character.
_DAMAGE = frozenset("�ÃÂâ€™œ‚¬ï»¿°¼")


def _language_masks() -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, words in enumerate(COMMON_WORDS.values()):
        for w in words.split():
            masks[w] = masks.get(w, 0) | 1 << i
    return masks


class _Words(dict):
    """Raw word -> (letters in it, 1 if it counts as a word, mask of the languages it is a common word of, damaged characters, bare word)."""

    def __init__(self) -> None:
        super().__init__()
        self.masks = _language_masks()

    def __missing__(self, raw: str) -> tuple[int, int, int, int, str]:
        if len(self) > 400_000:
            self.clear()
        bare = raw.strip(_EDGES).lower()
        mask = self.masks.get(bare, 0)
        if not mask and ("'" in bare or "’" in bare):
            mask = max((self.masks.get(p, 0) for p in bare.replace("’", "'").split("'")), default=0)
        bad = raw.count("\ufffd")
        if not raw.isascii() and any(c in "ÃÂâï" for c in raw):
            bad += sum(c in _DAMAGE for c in raw)
        self[raw] = v = (len(bare), int(len(bare) > 1 and any(map(str.isalpha, bare)) or mask > 0), mask, bad, bare)
        return v


def _unlisted_script(line: str) -> bool:
    """Mostly letters of a script none of the word lists is written in."""
    if line.isascii():
        return False
    letters = [c for c in line if c.isalpha()]
    return sum(ord(c) > 0x24F and not 0x900 <= ord(c) < 0x980 for c in letters) > 0.6 * len(letters) > 0


def _ends_sentence(line: str) -> bool:
    return line.rstrip().rstrip(_CLOSERS).endswith(_ENDS)


def _character_counts(text: str) -> tuple[int, int, int]:
    """(letters, digits, characters that aren't white space)."""
    if text.isascii():
        raw = text.encode()
        solid = raw.translate(None, _BLANK_BYTES)
        rest = solid.translate(None, b"0123456789")
        return len(rest) - len(rest.translate(None, _LETTER_BYTES)), len(solid) - len(rest), len(solid)
    letters = sum(map(str.isalpha, text)) + len(_VOWEL_SIGNS.findall(text))
    return letters, sum(map(str.isdigit, text)), len(text) - sum(map(str.isspace, text))


def page_statistics(text: str, words: _Words) -> tuple[str, list[float]]:
    """(language or "", the statistics in order)."""
    lines = [x for x in text.split("\n") if x.strip()]
    raws = [x.split() for x in lines]
    known = [tuple(zip(*map(words.__getitem__, r))) for r in raws]  # per line: letters, counts, masks, damage, bare words
    line_masks = [Counter(k[2]) for k in known]
    masks: Counter = Counter()
    for m in line_masks:
        masks.update(m)
    by_language = [sum(n for m, n in masks.items() if m >> i & 1) for i in range(len(COMMON_WORDS))]
    best = max(range(len(by_language)), key=by_language.__getitem__)
    present = [i for i, c in enumerate(by_language) if c and c >= 0.3 * by_language[best]]
    total = sum(map(len, lines)) or 1
    n = length = bad = prose = ended = all_common = 0
    prose_words: list[str] = []
    for line, raw, k, line_mask in zip(lines, raws, known, line_masks):
        count, line_length, line_bad = sum(k[1]), sum(k[0]), sum(k[3])
        common = max((sum([c for m, c in line_mask.items() if m >> i & 1]) for i in present), default=0)
        n += count
        length += line_length
        bad += line_bad
        all_common += common
        ends = _ends_sentence(line)
        ended += ends
        running = count >= _LEAST_LINE_WORDS and common >= _LEAST_COMMON * count or ends and len(line) >= 20 and _unlisted_script(line)
        if running and line_bad <= _MOST_DAMAGE * len(line) and line_length >= 1.6 * len(raw):  # else letters are set apart
            prose += len(line)
            prose_words += raw
    language = list(COMMON_WORDS)[best] if n and by_language[best] >= 0.1 * n else ""
    letters, digits, solid = _character_counts(text)
    flat = [w for k in known for w in k[4] if w]
    size = len(flat) or 1
    values = [
        math.log2(1 + n), length / n if n else 0.0, (solid - letters - digits) / max(1, solid), digits / max(1, solid), bad / total,
        ended / max(1, len(lines)), all_common / n if n else 0.0, prose / total, _novelty(prose_words, 5), _novelty(flat, 3),
        len(set(flat)) / size, len(flat) / max(1, len(_SENTENCE_END.findall(text))), len(flat) / (1 + _separators(text)),
    ]
    return language, values


_SENTENCE_END = re.compile("[.!?](?=\\s|$|[\"'”’)])|[।。！？]")
_GAP = re.compile("  +")


def _separators(text: str) -> int:
    """Marks between items: punctuation within sentences, tabs, line ends and runs of blanks."""
    gaps = len(_GAP.findall(text)) if "  " in text else 0
    return gaps + sum(map(text.count, ",;:|\t\n、，" if not text.isascii() else ",;:|\t\n"))


def _novelty(words: list[str], size: int) -> float:
    """Share of distinct ones among the runs of `size` words; 1 where there is none."""
    runs = len(words) - size + 1
    return len(set(zip(*[words[i:] for i in range(size)]))) / runs if runs > 0 else 1.0


def text_statistics(pages: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, language, one DOUBLE per statistic): statistics of every non-blank text.

    Null and blank texts are left out. language is empty where none is recognised.
    Further columns are ignored; `language` and the statistics' names are reserved.
    """
    rows = pages.select(*keep, F.col(text_col).alias("_text")).filter(F.col("_text").rlike(r"(?U)\S"))
    schema = T.StructType([
        *[f for f in rows.schema.fields if f.name != "_text"], T.StructField("language", T.StringType()),
        *[T.StructField(s, T.DoubleType()) for s in STATISTICS],
    ])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            got = [page_statistics(t, words) for t in b.column("_text").to_pylist()]
            m = np.array([v for _, v in got], dtype=np.float64).reshape(len(got), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([g[0] for g in got], pa.string()), *[pa.array(m[:, i]) for i in range(m.shape[1])]], names=schema.names)

    return rows.mapInArrow(measure, schema)


#: Parts of a page of weight 1.
_FINE = 1_000_000


def prose_weight() -> Column:
    """Share of a page's characters that is running prose and not repeated."""
    return F.col("prose_share") * F.col("five_word_novelty")


def reference_weight(prose: Column) -> Column:
    """What a page counts in the distributions, in millionths: prose less the rest, 0 where the rest is more."""
    return F.round(F.greatest(2 * prose - 1, F.lit(0.0)) * _FINE).cast("long")


def _values(stats: DataFrame, *cols: str) -> DataFrame:
    """(cols, language, statistic, value): one row per page and statistic, which goes by its number."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("statistic"), F.col(s).alias("value")) for i, s in enumerate(STATISTICS)]))
    return stats.select(*cols, "language", each.alias("_v")).select(*cols, "language", "_v.statistic", "_v.value")


def surprises(stats: DataFrame) -> DataFrame:
    """(language, statistic, value, n, low, surprise): -ln of the tail probability of each distinct value, where that is at most TRUNCATION.

    stats: text_statistics() and _weight BIGINT, in millionths of a page. A tail
    probability is the weight of the pages at or beyond the value over all weight; a
    value beyond all others weighs UNSEEN. A language's tails are shrunk towards those
    of all pages; an unknown language has those of all pages. A two-sided statistic
    takes twice the smaller tail. low tells which tail it is.
    """
    keys = ["language", "statistic", "value"]
    counts = materialize(_values(stats, "_weight").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_weight").alias("w")))
    named = range_running_sum(counts.filter("language <> ''"), ["language", "statistic"], ["value"], "w")
    unnamed = counts.filter("language = ''").withColumns({"w": F.lit(0).cast("long"), "n_before": F.lit(0).cast("long")})
    pooled = range_running_sum(counts.groupBy("statistic", "value").agg(F.sum("w").alias("w_all")), ["statistic"], ["value"], "w_all", "all_before")
    totals = counts.groupBy("language").agg((F.sum("w") / len(STATISTICS)).alias("_w"))  # one row per language
    everything = totals.agg(F.sum("_w").alias("all_total"))
    per_language = totals.select("language", F.when(F.col("language") == "", 0.0).otherwise(F.col("_w")).alias("total"))
    joined = named.unionByName(unnamed).join(pooled, ["statistic", "value"]).join(F.broadcast(per_language), "language").join(F.broadcast(everything))

    def tail(own: Column, of_all: Column) -> Column:
        share = (of_all / _FINE + UNSEEN) / (F.col("all_total") / _FINE + 1)
        return (own / _FINE + SHRINKAGE * share) / (F.col("total") / _FINE + SHRINKAGE)

    low = tail(F.col("n_before") + F.col("w"), F.col("all_before") + F.col("w_all"))
    high = tail(F.col("total") - F.col("n_before"), F.col("all_total") - F.col("all_before"))
    sides = list(STATISTICS.values())
    of_side = lambda side: F.col("statistic").isin([i for i, x in enumerate(sides) if x == side])
    p = F.when(of_side("low"), F.col("_low")).when(of_side("high"), F.col("_high")).otherwise(2 * F.least("_low", "_high"))
    is_low = of_side("low") | of_side("both") & (F.col("_low") <= F.col("_high"))
    tails = joined.withColumns({"_low": low, "_high": high}).select(*keys, "n", is_low.alias("low"), p.alias("_p"))
    return tails.filter(F.col("_p") <= TRUNCATION).select(*keys, "n", "low", (-F.log("_p")).alias("surprise"))


def _page_scores(stats: DataFrame, pages: int) -> DataFrame:
    """(_page, score) of the pages with any surprise."""
    known = materialize(surprises(stats))
    by, on = ["language", "statistic"], ["language", "statistic", "value"]
    # one row per language and statistic: how far its surprising values reach
    reach = known.groupBy(*by).agg(F.max(F.when(F.col("low"), F.col("value"))).alias("_from"), F.min(F.when(~F.col("low"), F.col("value"))).alias("_to"))
    rare = _values(stats, "_page").join(F.broadcast(reach), by).filter("value <= _from OR value >= _to").drop("_from", "_to")
    least = max(1.0, pages * HOT_SHARE)
    hot = known.filter(F.col("n") >= least).select(*on, "surprise")
    cold = known.filter(F.col("n") < least).select(*on, "surprise")
    looked = rare.join(F.broadcast(hot), on).unionByName(rare.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))
    return looked.groupBy("_page").agg(F.sum("surprise").alias("score"))


def _threshold(stats: DataFrame, scores: DataFrame) -> float:
    """Score that best divides running prose from other text.

    Of all thresholds it is the one for which the prose above it and the other text at or
    below it, both counted in pages by weight, are least; the middle of such thresholds if
    there are several. Scores are counted in steps, so the driver sees one row per step.
    """
    w = F.col("_prose")
    whole = stats.agg(F.sum(w).alias("prose"), F.sum(1 - w).alias("other")).first()
    if whole["prose"] is None:
        return 0.0
    step = F.ceil(F.col("score") / SCORE_STEP).cast("int").alias("step")
    rows = stats.select("_page", "_prose").join(scores, "_page").groupBy(step).agg(F.sum(w).alias("prose"), F.sum(1 - w).alias("other")).collect()
    size = max((r["step"] for r in rows), default=0) + 1
    prose, other = np.zeros(size), np.zeros(size)
    for r in rows:
        prose[r["step"]], other[r["step"]] = r["prose"], r["other"]
    above = lambda x: x.sum() - np.cumsum(x)
    wrong = above(prose) + whole["other"] - above(other)  # threshold at the upper end of each step
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    first = best[0]
    run = first + np.argmin(np.append(np.diff(best) == 1, False))  # the thresholds from the first on without a better one between
    return float((first + run) / 2 * SCORE_STEP)


def outlier_scores(stats: DataFrame) -> tuple[DataFrame, float]:
    """stats with outlier_score, and the score above which a page is no running prose.

    Equal texts rank equally. An empty input gives an empty result and 0; where there is
    no running prose at all every value is beyond it. The names _page, _prose and _weight
    are reserved.
    """
    s = materialize(stats.withColumns({"_page": F.monotonically_increasing_id(), "_prose": prose_weight()}))
    weighted = s.withColumn("_weight", reference_weight(F.col("_prose")))
    scores = materialize(_page_scores(weighted, s.count()))
    threshold = _threshold(s, scores)
    scored = s.join(scores, "_page", "left").withColumn("outlier_score", F.coalesce("score", F.lit(0.0)))
    return scored.select(*stats.columns, "outlier_score"), threshold


def score_texts(pages: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, language, statistics, outlier_score and not_prose of every non-blank text: a page is no running prose if its score is above the fitted threshold."""
    scored, threshold = outlier_scores(text_statistics(pages, text_col, keep))
    return scored.withColumn("not_prose", F.col("outlier_score") > threshold)
