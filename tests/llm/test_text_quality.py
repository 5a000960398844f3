import math
import random

from pyspark.sql import functions as F

from marginalia.llm.text_quality import _FINE, SHRINKAGE, STATISTICS, TRUNCATION, UNSEEN, _Words, outlier_scores, page_statistics, prose_weight, reference_weight, score_texts, surprises, text_statistics

PROSE = "The water in the river is cold because it comes from the hills, and the fish in it are used to that. "
CASES = {
    "list": "\n".join(f"{i}. gland and shell" for i in range(30)),
    "contents": "\n".join(f"{i}.1 Growth in seeds ........ {i * 3}" for i in range(30)),
    "table": "\n".join(f"seed\t{i}\t{i * 1.5}" for i in range(30)),
    "salad": "Vinegar seconds samples rigid nutrients sediment. Honey hidden volts leaf bone magnets outer. " * 4,
    "repeats": "and the " * 60,
    "sentence": PROSE * 12,
    "damaged": "T�e w�te� in t�e �iv�r is co�d be�au�e it c�mes fr�m th� hi�ls, a�d th� f�sh a�e u�ed to t�at. " * 2,
    "spaced": " ".join(PROSE * 2),
    "reversed": " ".join(w[::-1] for w in (PROSE + "Plants need light and air to grow well in any of these places.").split()),
    "symbols": "@+ }~% *6~:&)*-- ^!]5!<(~& ^^&/4) " * 5,
}
FINE = {
    "prose": PROSE + "Plants need light and air, and without them they will not grow at all in these soils.",
    "wrapped": "The water in the river is cold because it\ncomes from the hills, and the fish that live\nin it are used to that.",
    "lower": "we can see that the water in the river is cold because it comes from the hills",
    "french": "La feuille absorbe la lumière et la transforme en réserve pour la nuit. Le cuivre conduit le courant mieux que le fer.",
    "hindi": "पत्ती सूर्य के प्रकाश में अपना भोजन बनाती है और उसे तने में जमा करती है। लोहा लकड़ी की तुलना में जल्दी गरम हो जाता है।",
    "chinese": "植物需要阳光和空气才能生长，没有它们就不能生长。河里的水很冷，因为它来自山上。",
    "formula": PROSE + "The relation V = m / t holds here. So m = 4 / 2 = 2 grams, as we said before the test.",
    "short list": PROSE * 1 + "Plants need light and air, and they will not grow without them in any soil that we know of.\n- water\n- light\n- air",
}


def test_what_is_running_prose():
    words = _Words()
    weight = lambda text: dict(zip(STATISTICS, page_statistics(text, words)[1]))
    for name, text in CASES.items():
        x = weight(text)
        assert x["prose_share"] * x["five_word_novelty"] < 0.5, name
    for name, text in FINE.items():
        x = weight(text)
        assert x["prose_share"] * x["five_word_novelty"] > 0.5, name
    assert page_statistics(FINE["french"], words)[0] == "fr" and page_statistics(FINE["hindi"], words)[0] == "hi" and page_statistics(CASES["symbols"], words)[0] == ""


def pages(spark, n=250):
    random.seed(4)
    nouns = ["river", "hill", "fish", "plant", "stone", "leaf", "cloud"]
    rows = [(i, " ".join(f"The {random.choice(nouns)} is near the {random.choice(nouns)} and it has {random.randrange(99)} of them." for _ in range(6)), "x") for i in range(n)]
    rows += [(1000 + i, t, "x") for i, t in enumerate(CASES.values())] + [(2000, None, ""), (2001, "  \n", ""), (2002, "", "")]
    return spark.createDataFrame(rows, "id long, text string, cell string").repartition(5)


def test_tail_probabilities_are_exact(spark):
    stats = text_statistics(pages(spark), "text", ["id"]).withColumn("_weight", reference_weight(prose_weight()))
    rows = stats.collect()
    assert len(rows) == 250 + len(CASES)
    got = {(r.language, r.statistic, r.value): (r.n, r.surprise) for r in surprises(stats).collect()}
    weigh = lambda some: sum(r._weight for r in some) / _FINE
    seen = set()
    for i, (s, side) in enumerate(STATISTICS.items()):
        for r in rows:
            own = [x for x in rows if x.language == r.language and r.language]
            tails = []
            for beyond in (lambda x: x[s] <= r[s], lambda x: x[s] >= r[s]):
                share = (weigh(filter(beyond, rows)) + UNSEEN) / (weigh(rows) + 1)
                tails.append((weigh(filter(beyond, own)) + SHRINKAGE * share) / (weigh(own) + SHRINKAGE))
            p = tails[0] if side == "low" else tails[1] if side == "high" else 2 * min(tails)
            key = (r.language, i, r[s])
            if p <= TRUNCATION:
                assert abs(got[key][1] + math.log(p)) < 1e-9 and got[key][0] == sum(x.language == r.language and x[s] == r[s] for x in rows)
                seen.add(key)
            else:
                assert key not in got
    assert seen == set(got)


def test_a_page_scores_the_sum_of_its_surprises(spark):
    stats = text_statistics(pages(spark), "text", ["id"])
    weights = stats.withColumn("_weight", reference_weight(prose_weight()))
    scored, threshold = outlier_scores(stats)
    scores = {r.id: r.outlier_score for r in scored.collect()}
    known = {(r.language, r.statistic, r.value): r.surprise for r in surprises(weights).collect()}
    for r in weights.collect():
        assert abs(scores[r.id] - sum(known.get((r.language, i, r[s]), 0.0) for i, s in enumerate(STATISTICS))) < 1e-6
    assert max(s for i, s in scores.items() if i < 1000) <= threshold < min(s for i, s in scores.items() if i >= 1000)


def found(df):
    return {r.id for r in score_texts(df, "text", ["id"]).filter("not_prose").collect()}


def test_found_pages(spark):
    assert found(pages(spark)) == {1000 + i for i in range(len(CASES))}


def test_the_score_decides(spark):
    """A page of many common words, which the share of running prose alone would pass, is found by its other statistics."""
    odd = "diffusion in kidneys; oxidation in cells; funnel and gas; prism and stem; fish and pendulum; friction in layers; " * 3
    rare = spark.createDataFrame([(3000, odd + "droplet and burner", "x")], "id long, text string, cell string")
    weight = dict(zip(STATISTICS, page_statistics(odd, _Words())[1]))
    assert weight["prose_share"] == 1.0
    assert 3000 in found(pages(spark).unionByName(rare))


def test_common_junk_is_found(spark):
    junk = [("the " * 100).strip(), ("page " * 100).strip(), CASES["list"]]
    for share, copied in ((2, junk[:1]), (2, junk), (1, junk)):  # up to all pages
        prose = pages(spark).filter("id < 250") if share == 2 else pages(spark).filter("id < 0")
        copies = spark.createDataFrame([(5000 + i, copied[i % len(copied)], "x") for i in range(126)], "id long, text string, cell string")
        assert found(prose.unionByName(copies)) == {5000 + i for i in range(126)}


def test_no_junk(spark):
    assert found(pages(spark).filter("id < 250")) == set()


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "id long, text string"), "text", ["id"]).count() == 0
