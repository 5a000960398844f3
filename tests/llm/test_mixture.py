import random

from marginalia.llm.mixture import mix

TARGETS = "source string, target_share double, max_repeats int, x int"


def make(spark, rows, targets):
    return mix(spark.createDataFrame(rows, "id long, source string, tokens long, copies string").repartition(5), spark.createDataFrame(targets, TARGETS))


def test_shares_caps_and_spelling(spark):
    random.seed(2)
    rows = [(i, random.choice([" A", "a ", "B", "c"]), random.randrange(1, 900), "") for i in range(3000)]
    rows += [(-1, None, 5, ""), (-2, "other", 10**6, ""), (-3, "a", None, ""), (-4, "a", 0, "")]
    copies, shares = make(spark, rows, [("A", 0.2, 3, 0), ("b", 0.5, 4, 0), ("C", 0.01, 2, 0), ("D", 0.29, 2, 0)])
    got = {r.source: r for r in shares.collect()}
    assert [s for s, r in got.items() if r.saturated] == ["D"]
    for s in "AbC":
        assert abs(got[s].mixed_tokens - got[s].target_tokens) <= 900, got[s]
    cap = {"a": 3, "b": 4, "c": 2}
    total = {}
    for r in copies.collect():
        assert 0 <= r.copies <= cap[r.source]
        total[r.source] = total.get(r.source, 0) + r.copies * r.tokens
    assert {s.lower(): got[s].mixed_tokens for s in "AbC"} == total
    assert copies.count() == 3000


def test_saturated_source_uses_every_repeat(spark):
    copies, shares = make(spark, [(1, "a", 10, ""), (2, "b", 1000, "")], [("a", 0.5, 2, 0), ("b", 0.5, 1, 0)])
    got = {r.source: r for r in shares.collect()}
    assert got["a"].saturated and got["a"].mixed_tokens == 20 and not got["b"].saturated
    assert {r.id: r.copies for r in copies.collect()}[1] == 2


def test_without_documents(spark):
    copies, shares = make(spark, [], [("a", 1.0, 2, 0)])
    assert copies.count() == 0 and [(r.source, r.mixed_tokens, r.saturated) for r in shares.collect()] == [("a", 0, False)]


def test_exactly_reachable_and_null_targets(spark):
    _, shares = make(spark, [(1, "a", 10, ""), (2, "b", 10, "")], [("a", 0.5, 1, 0), ("b", None, None, 0)])
    got = {r.source: r for r in shares.collect()}
    assert got["a"].mixed_tokens == 10 and got["b"].mixed_tokens == 0 and not got["a"].saturated


def test_within_reach(spark):
    rows = [(i, "ab"[i % 7 == 0], 10, "") for i in range(700)]
    _, shares = mix(spark.createDataFrame(rows, "id long, source string, tokens long, copies string"), spark.createDataFrame([("a", 0.4, 3, 0), ("b", 0.4, 2, 0), ("c", 0.2, 2, 0)], TARGETS), True)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a"].mixed_tokens - got["b"].mixed_tokens) <= 10 and got["b"].mixed_tokens == 2000 and abs(got["a"].mix_share - 0.5) < 0.01
    assert not got["a"].saturated and not got["b"].saturated and got["c"].mixed_tokens == 0
