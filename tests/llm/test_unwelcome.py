import itertools
import math
import random
import time
from dataclasses import replace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.unwelcome import Model, Normal, WordKeys, best_scores, fit_extremes, maximal_segments, prior_words, rates, score_documents, train, word_background


def slow_segments(scores):
    """Recursive definition: the best contiguous run (shortest, then first), then left and right of it."""
    best = None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[a:b])
        if s > 0 and (best is None or (s, -(b - a), -a) > (best[0], -(best[2] - best[1]), -best[1])):
            best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return slow_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in slow_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-7, -3, -1, 1, 2, 5]), max_size=14))
def test_segments_match_their_definition(scores):
    got = maximal_segments(np.array(scores, dtype=float))
    assert sum(s for *_, s in got) == sum(s for *_, s in slow_segments(scores))
    assert max((s for *_, s in got), default=0) == max((s for *_, s in slow_segments(scores)), default=0)
    assert best_scores(np.array(scores, dtype=float), np.array([0, len(scores)]))[0] == max((s for *_, s in got), default=0)
    assert all(a1 < b1 <= a2 for (a1, b1, _), (a2, _, _) in zip(got, got[1:]))


def test_segments_take_linear_time():
    def seconds(n):
        rows = [np.array([0.5, -1.0] * n), np.array([-1.0, 0.5] * n), np.array([0.6, -0.5] * n), np.concatenate([np.tile([1.0, -1.5], n // 2), np.tile([1.5, -1.0], n // 2)])]
        began = time.process_time()
        for r in rows:
            maximal_segments(r)
        return time.process_time() - began

    seconds(1000)
    short, long = min(seconds(20_000) for _ in range(3)), min(seconds(160_000) for _ in range(2))
    assert long < 20 * short  # 8 times the length; quadratic would be 64 times


def test_extreme_value_fit():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 400, 20_000)
    for decay, rate in ((0.7, 0.01), (1.3, 0.002), (4.0, 0.05)):
        x = np.maximum(0.0, (np.log(rate * n) + rng.gumbel(size=len(n))) / decay)
        x[:100] += 40  # wrong labels
        got = fit_extremes(x, n)
        assert abs(math.log(got[0] / decay)) < 0.1 and abs(math.log(got[1] / rate)) < 0.2
    assert fit_extremes(np.zeros(0), np.zeros(0))[0] == 1.0 and fit_extremes(np.zeros(9), np.ones(9))[1] < 0.1


def test_disguises():
    n = Normal(set(prior_words()))
    for raw, want in {"F.U.C.K": "fuck", "sh​it": "shit", "mоrоn,": "moron", "b*****d": "bastard", "s**t": "shit", "idiiiiot!": "idiot", "p4th3t1c": "pathetic", "dumb4$$,": "dumbass", "sc-um": "scum", "shit_head": "shithead", "BI*TCH": "bitch", "asshhhhole": "asshole"}.items():
        assert n[raw] == (want,), raw
    assert n.tokens("you f u c k i n g b a s t a r d now") == ["you", "fucking", "bastard", "now"]
    assert n.tokens("user_12: plan a b c") == ["@", "plan", "a", "b", "c"]
    assert n["well-known"] == ("well", "known") and n["--"] == () and n["12"] == ("#",)


INSULTS = ["You are a {} and nobody will ever like you here.", "Only a {} would write this, so shut your mouth now.", "Go to hell, you {}, and never come back again."]
FINE = ["The {} is near the river and it grows in spring.", "We measured the {} twice and wrote the value down.", "Can you explain why the {} becomes warm after a day?", "A wild ass can live without water near the {}."]
NOUNS = ["seed", "leaf", "stone", "fish", "cloud", "plant"]


def corpus(n):
    random.seed(9)
    docs = []
    for i in range(n):
        parts = [random.choice(FINE).format(random.choice(NOUNS)) for _ in range(random.randrange(2, 12))]
        if bad := i % 8 == 0:
            parts.insert(random.randrange(len(parts)), random.choice(INSULTS).format(random.choice(["moron", "idi0t", "b1tch", "d i m w i t"])))
        docs.append((i, " ".join(parts), int(bad)))
    return docs


def test_held_out_accuracy_and_rates(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([(i, t, " S " if i % 2 else None) for i, t, _ in rows] + [(9001, None, "s"), (9002, "", "s"), (None, "   ", "s")], "id long, text string, source string")
    labels = [(i, bad if i % 50 else 1 - bad) for i, _, bad in rows[:800]] + [(3, None), (None, 1), (5000, 1)]
    model = train(docs, spark.createDataFrame(labels, "id long, label int"), word_background(docs))
    got = score_documents(docs, "id", "text", model, ("source",)).collect()
    assert len(got) == 1603
    found = {r.id for r in got if r.passages > 0}
    truth = {i for i, _, bad in rows if bad}
    held = {i for i, *_ in rows[800:]}
    assert len(found & truth & held) >= 0.95 * len(truth & held) and not (found - truth) & held
    assert [(r.tokens, r.best_score, r.probability, r.passage) for r in got if r.id in (9001, 9002, None)] == [(0, 0.0, 1.0, None)] * 3
    table = {r.source: r for r in rates(score_documents(docs, "id", "text", model, ("source",)), "source").collect()}
    assert table["s"].unwelcome == 0 and table[None].unwelcome == len([i for i in found if i % 2 == 0])


def test_disguises_of_a_trained_model(spark):
    rows = corpus(400)
    rows = [(i, t.replace("stone", "salt").replace("fish", "folk").replace("cloud", "deck").replace("moron", "gr*bler" if i % 3 else "grobler"), bad) for i, t, bad in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    model = train(docs, spark.createDataFrame([(i, bad) for i, _, bad in rows], "id long, label int"), word_background(docs))
    keys, learnt = WordKeys(), set(model.keys.tolist())
    assert {keys[w] for w in ("salt", "folk", "deck", "grobler")} <= learnt and keys["bler"] not in learnt  # learnt as it is scored
    pairs = [("THIS ANSWER IS S**T, you f**k.", "THIS ANSWER IS SHIT, you fuck."), ("What a d*ck and b****", "What a dick and bitch"), ("You are a gr*bler and nobody", "You are a grobler and nobody")]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(x for p in pairs for x in p)], "id long, text string")
    got = [(r.tokens, round(r.best_score, 9), r.passage) for r in score_documents(texts, "id", "text", model).orderBy("id").collect()]
    assert got[::2] == got[1::2]


def test_a_lone_word_is_a_passage(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    model = replace(train(docs, spark.createDataFrame([(i, bad) for i, _, bad in rows], "id long, label int")), decay=3.0, rate=0.02)
    texts = spark.createDataFrame([(1, "Asshole."), (2, "The seed is near the river. Asshole! The leaf is near the river."), (3, "The seed is near the river.")], "id long, text string")
    got = {r.id: r for r in score_documents(texts, "id", "text", model).collect()}
    assert [(got[i].passages, got[i].passage) for i in (1, 2, 3)] == [(1, "asshole"), (1, "asshole"), (0, None)]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid fucking idiot"), (2, "the leaf is green")], "id long, text string")
    model = train(docs, spark.createDataFrame([], "id long, label int"))
    got = {r.id: r.best_score for r in score_documents(docs, "id", "text", model).collect()}
    assert got[1] > got[2] == 0
    none = spark.createDataFrame([], "id long, text string")
    assert score_documents(none, "id", "text", train(none, spark.createDataFrame([], "id long, label int"), word_background(none))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300)), st.lists(st.integers(0, 300)))
def test_keys_are_found(keys, wanted):
    """Small keys share their lowest bits often."""
    m = Model(np.array(sorted(k << 3 for k in keys), dtype=np.int64), np.arange(len(keys), dtype=np.float32))
    values, hit = m._look(np.array([w << 3 for w in wanted], dtype=np.int64), None)
    want = {k: i for i, k in enumerate(sorted(keys))}
    assert [(v, h) for v, h in zip(values, hit)] == [(float(want.get(w, 0)), w in want) for w in wanted]
