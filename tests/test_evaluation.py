import json
import random

from py4j.java_gateway import JavaObject
from pyspark.sql import functions as F

from marginalia.functions import answers as A
from marginalia.functions import spans as P
from marginalia.functions import specialists as S
from marginalia.operators.blocks import page_blocks, split_blocks
from marginalia.operators.sampling import disjoint_sample
from marginalia.operators.similarity import near_duplicate_sets
from marginalia.plans.specialists import pack_units


def test_near_duplicates_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    sets = [random.sample(words, random.randrange(1, 12)) for _ in range(60)]
    sets += [random.choice(sets)[:] + random.sample(words, random.randrange(2)) for _ in range(80)] + [[], [], None, ["w1", None, "w1"]]
    rows = [(i, s) for i, s in enumerate(sets)] + [(None, ["w1"])]
    for t in (0.5, 0.8, 1.0):
        pairs, members = near_duplicate_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), t)
        plain = {i: frozenset(x for x in s or () if x is not None) for i, s in enumerate(sets)}
        first = {}
        for i, s in plain.items():
            first.setdefault(s, i)
        assert {r.id: r.class_id for r in members.collect()} == {i: first[s] for i, s in plain.items()}
        want = {(i, j): len(a & b) / len(a | b) for a, i in first.items() for b, j in first.items() if i < j and a and b and len(a & b) / len(a | b) >= t}
        got = {(r.left_id, r.right_id): r.similarity for r in pairs.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_near_duplicates_of_common_words_meet_seldom(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    sets = [random.sample(words, 60) for _ in range(3000)]
    rows = list(enumerate(sets + [[*s[1:], "new"] for s in sets[:50]]))
    pairs, _ = near_duplicate_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.8)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(i, 3000 + i) for i in range(50)}

    def joined(plan):
        if not isinstance(plan, JavaObject):
            return 0
        inner = [plan.executedPlan()] if plan.nodeName().startswith("AdaptiveSparkPlan") else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        children = plan.children()
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return max([own, *map(joined, inner), *(joined(children.apply(i)) for i in range(children.size()))])

    assert 50 <= joined(pairs._jdf.queryExecution().executedPlan()) < 10 * len(rows)


def test_disjoint_sample_is_the_sequential_pass(spark):
    random.seed(6)
    rows = [(i, [random.randrange(90) for _ in range(random.randrange(4))] if i % 11 else None, random.randrange(1000)) for i in range(150)]
    used, want = set(), set()
    for i, marks, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if not used & set(marks or ()):
            want.add(i)
            used |= set(marks or ())
    got = disjoint_sample(spark.createDataFrame(rows, "id long, m array<int>, k int").repartition(3), "id", "m", "k")
    assert [r.id for r in got.orderBy("id").collect()] == sorted(want)
    assert disjoint_sample(spark.createDataFrame([], "id long, m array<int>, k int"), "id", "m", "k").count() == 0


def test_spans_stay_on_their_source(spark):
    random.seed(7)
    texts = ["", "one two", " three\n\nfour ", "fünf 六 seven", None]
    rows = [(i, random.choice(texts), random.choice(texts), random.randrange(4), random.randrange(4, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string, s int, e int")
    m = P.join(P.whole_unit(F.lit("d"), F.lit("a"), F.col("a")), P.whole_unit(F.lit("d"), F.lit("b"), F.col("b")))
    units = F.create_map(F.lit("a"), F.coalesce("a", F.lit("")), F.lit("b"), F.coalesce("b", F.lit("")))
    part = P.cut(F.col("m"), F.least("s", F.length("m.text")), F.least("e", F.length("m.text")))
    got = df.withColumn("m", m).withColumn("c", part).select("*", P.uncovered(F.col("c")).alias("open"), P.matches_source(F.col("c"), units).alias("exact"), P.resolve(F.col("c"), F.lit("o")).alias("at"), P.first_words(F.col("m"), 1).alias("w")).collect()
    for r in got:
        a, b = r.a or "", r.b or ""
        whole = a + "\n" + b
        assert r.c.text == whole[r.s : max(r.s, r.e)] or r.s > len(whole)
        assert r.open == 0 and r.exact
        for s in r.c.spans:
            assert {"a": a, "b": b}[s.unit_id][s.source_start : s.source_end] == r.c.text[s.text_start : s.text_end]
        assert (r["at"] is None) == ("o" not in r.c.text)
        assert r.w.text.split() == whole.split()[:1]
    lone = spark.range(1).select(P.uncovered(P.mapped(F.lit("ab c"), P.cut(P.whole_unit(F.lit("d"), F.lit("u"), F.lit("ab c")), F.lit(0), F.lit(1))["spans"])).alias("n")).first().n
    assert lone == 2


GIVEN = [("E1", [3, 4], ["iii", "4"])]
GOOD = {"status": "answered", "answer": "x", "selected_evidence_ids": ["E1"], "citations": [{"evidence_id": "E1", "pdf_page": 4, "textbook_page": "4"}], "missing_information": []}
BAD = {
    "output must contain exactly the five required keys": {**GOOD, "more": 1},
    "invalid status": {**GOOD, "status": "maybe"},
    "answer must be a string": {**GOOD, "answer": 3},
    "selected_evidence_ids must be a string array": {**GOOD, "selected_evidence_ids": "E1"},
    "missing_information must be a string array": {**GOOD, "missing_information": [1]},
    "selected evidence contains unknown IDs": {**GOOD, "selected_evidence_ids": ["E2"]},
    "citations must be an array": {**GOOD, "citations": "none"},
    "citation has invalid shape": {**GOOD, "citations": [{"evidence_id": "E1"}]},
    "citation uses unknown evidence ID": {**GOOD, "citations": [{"evidence_id": "E9", "pdf_page": 4, "textbook_page": "4"}]},
    "citation page metadata does not match supplied evidence": {**GOOD, "citations": [{"evidence_id": "E1", "pdf_page": 5, "textbook_page": "4"}]},
}


def test_answers_are_parsed_strictly(spark):
    rows = [("", json.dumps(GOOD)), ("", "```json\n" + json.dumps(GOOD) + "\n```"), *[(e, json.dumps(b)) for e, b in BAD.items()], ("invalid JSON", "{"), ("invalid JSON", ""), ("invalid JSON", None)]
    df = spark.createDataFrame([(e, raw, GIVEN) for e, raw in rows], "want string, raw string, given array<struct<evidence_id:string,pdf_pages:array<int>,textbook_pages:array<string>>>")
    for r in df.select("want", A.parse_answer(F.col("raw"), F.col("given")).alias("p")).collect():
        assert r.p.errors == ([r.want] if r.want else []) and r.p.valid == (not r.want), (r.want, r.p)


def test_answer_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    x = one(A.answer_overlap(F.lit("The Blue, blue whale!"), F.lit("a blue whale")))
    assert (x.em, round(x.precision, 6), x.recall, round(x.f1, 6)) == (0, round(2 / 3, 6), 1.0, 0.8)
    assert one(A.answer_overlap(F.lit("yes"), F.lit("yes sir"))).f1 == 0 and one(A.answer_overlap(F.lit("Yes."), F.lit("yes"))).em == 1
    assert one(A.answer_overlap(F.lit(""), F.lit("x"))).f1 == 0
    s = one(A.set_overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))))
    assert (s.em, s.precision, s.recall, round(s.f1, 6)) == (0, 0.5, 1.0, round(2 / 3, 6))
    assert one(A.supported(F.lit("The plant has 3 leaves"), F.lit("a plant with 3 leaves"))) and not one(A.supported(F.lit("The plant has 4 leaves"), F.lit("a plant with 3 leaves")))
    assert one(A.point_coverage(F.array(F.lit("green leaves"), F.lit("deep roots")), F.lit("the leaves are green"))) == 0.5
    assert one(A.unsupported_claims(F.array(F.lit("green leaves"), F.lit("deep roots")), F.lit("the leaves are green"))) == ["green leaves"]
    assert one(A.estimated_cost(F.lit(1000), F.lit(10), 2.0, 8.0)) == 0.00208 and one(A.estimated_cost(F.lit(0), F.lit(10), 2.0, 8.0)) is None


def test_packing_stays_within_its_budget(spark):
    rows = [("q", i, "one two three four", "the title") for i in range(5)] + [("r", 0, "a " * 50, None), ("s", 0, None, "x"), ("s", 1, "left over", "x")]
    got = {(r.q, r.i): (r.kept, r.truncated, r.kept_chars) for r in pack_units(spark.createDataFrame(rows, "q string, i int, t string, h string"), "q", [F.col("i")], "t", "h", 17).collect()}
    assert got == {("q", 0): (4, False, 18), ("q", 1): (4, False, 18), ("r", 0): (16, True, 31), ("s", 1): (2, False, 9)}


def test_specialist_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.formula_text(F.lit("P = 60 W \n\n6 V × 2"))) == "P = 60 watt W\n6 volt V  x  2"
    page = "Name Age\nTable 1\nAnn 30\nBob of the old town 40\nend."
    assert one(S.table_text(F.lit(page), "rows")).split("\n")[1] == "Header: Name Age | Row: Ann 30"
    assert one(S.table_text(F.lit(page), "pairs")).split("\n")[-1] == "Name Age | Key: Bob of | Value: the old town 40"
    assert one(S.activated("formula", F.lit("what are the laws"), "v3")) and not one(S.activated("formula", F.lit("what are the laws"), "v2"))
    assert one(S.evidence_window(F.lit("aa bb cc dd ee"), F.lit("CC"), 4)) == "cc dd" and one(S.evidence_window(F.lit("aa"), F.lit("zz"))) is None


def test_blocks_of_a_page(spark):
    long = "The water in the river is cold because it comes from the hills and the fish that live in it are used to that"
    text = f"2.1 Rivers:\n{long}\nand they have been there for as long as anyone in the town can remember it.\nNew paragraph here\n\n- first item\nwraps here\nFigure 3 A river\nWhy is it cold?\nWater Cycle.\nActivity 1 do\nv = 3"
    got = page_blocks(text, "Water cycle")
    assert [k for k, _ in got] == ["heading", "paragraph", "paragraph", "bullet_list", "question", "heading", "activity"]
    assert got[0][1] == "2.1 Rivers" and got[3][1] == "- first item wraps here" and got[4][1] == "Figure 3 A river Why is it cold?" and got[6][1] == "Activity 1 do v = 3"
    assert page_blocks(None) == page_blocks("\n \n") == [] and page_blocks("a b", has_table=True)[0][0] == "table_text" and page_blocks("E = m", has_table=False)[0][0] == "formula"
    df = spark.createDataFrame([(1, text, "Water cycle", None, None, "x"), (2, None, None, True, True, "x")], "id long, cleaned_text string, section_title string, has_table boolean, has_equation_like_text boolean, text string")
    rows = split_blocks(df, ["id"]).collect()
    assert [(r.id, r.no, r.kind) for r in rows] == [(1, i, k) for i, (k, _) in enumerate(got)]
