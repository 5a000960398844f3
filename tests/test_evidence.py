import random

from pyspark.sql import functions as F

from marginalia.functions import queries as Q
from marginalia.functions import text as X
from marginalia.operators.bootstrap import paired_delta
from marginalia.operators.candidates import SELECTORS, cluster, distinct_pages, diverse, merged, non_redundant, quota
from marginalia.operators.chunking import fixed, structured
from marginalia.operators.context import hard_budget, merge_intervals, overlap_join
from marginalia.operators.retrieval import bm25_top, dense_top, fuse, pareto_front


def page(n, text, chapter=1, section="s"):
    return {"pdf_page_number": n, "chapter_number": chapter, "chapter_title": f"c{chapter}", "section_title": section, "cleaned_text": text, "has_image": False, "has_table": False, "has_equation_like_text": False}


def test_chunks_keep_chapters_apart_and_overlap():
    pages = [page(i, " ".join(f"Word{i} is number {j} here." for j in range(60)), 1 + i // 3) for i in range(6)]
    chunks = fixed(pages, 100, 20)
    assert all(len({p.page["chapter_number"] for p in c}) == 1 for c in chunks)
    assert all(sum(p.size for p in c[:-1]) < 100 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        if a[0].page["chapter_number"] == b[0].page["chapter_number"]:
            assert any(p is b[0] for p in a)
    for c in structured(pages, 50, 100):
        assert sum(p.size for p in c) <= 100 and len({p.page["chapter_number"] for p in c}) == 1
    assert fixed([]) == [] and structured([page(1, None)]) == []


def hit(i, retriever, rank, text, pages=(1,), book="b", gold=False):
    return {"hit_id": i, "retriever": retriever, "rank": rank, "place": rank, "candidate_id": f"c{i}", "book_id": book, "pdf_pages": list(pages), "text": text, "matches_gold": gold}


def test_clusters_join_the_first_that_matches():
    base = "one two three four five six seven eight nine ten"
    rows = [hit(1, "a", 1, base), hit(2, "b", 1, "x y z"), hit(3, "b", 2, base + " eleven"), hit(4, "b", 3, base, pages=(2,)), hit(5, "b", 4, base, book="z"), hit(6, "c", 1, None)]
    assert [[r["hit_id"] for r in g] for g in cluster(rows)] == [[1, 3], [2], [4], [5], [6]]
    m = merged(rows)
    assert m[0]["candidate_id"] == "c1" and m[0]["ranks"] == {"a": 1, "b": 2} and m[0]["members"] == 2
    for choose in (diverse, quota, distinct_pages, non_redundant):
        got = choose(m, 3)
        assert len(got) <= 3 and len({c["candidate_id"] for c in got}) == len(got)
    assert [c["candidate_id"] for c in non_redundant(m, 9)].count("c4") == 0
    assert diverse([], 3) == [] and quota([], 3) == []


def test_bm25_against_plain_python(spark):
    import math

    docs = [(1, "Cell cell wall"), (2, "wall of the house"), (3, None), (4, "nothing here")]
    got = {(r.query_id, r.doc_id): r.score for r in bm25_top(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "cell WALL wall"), (8, None), (9, "unheard")], "query_id long, text string"), 10, block=1, digits=12).collect()}
    length, n = {1: 3, 2: 4, 3: 0, 4: 2}, 4
    avg = sum(length.values()) / n
    score = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {(7, 1): score(2, 1, 3) + 2 * score(1, 2, 3), (7, 2): 2 * score(1, 2, 4)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_fusion_and_front(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id long, embedding array<double>").repartition(3)
    assert [r.vec_id for r in dense_top(v, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>"), 4).orderBy("rank").collect()] == [2, 5, 8, 1]
    h = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 5), (1, "a", "y", 2), (1, "b", "x", 2)], "q long, c string, s string, r int")
    assert {r.c: round(r.fused, 9) for r in fuse(h, "q", "c", "s", "r").collect()} == {"a": round(1 / 61 + 1 / 62, 9), "b": round(1 / 62, 9)}
    random.seed(1)
    rows = [("g", i, random.randrange(6), random.randrange(6) if i % 9 else None) for i in range(80)]
    val = lambda r: (r[2], -r[3] if r[3] is not None else float("-inf"))
    want = {r[1] for r in rows if not any(all(a >= b for a, b in zip(val(o), val(r))) and val(o) != val(r) for o in rows)}
    got = pareto_front(spark.createDataFrame(rows, "g string, i long, up int, down int").repartition(5), "g", "i", {"up": True, "down": False})
    assert {r.i for r in got.collect()} == want


def test_context(spark):
    one = spark.createDataFrame([("one two three four five six seven eight nine", "two three four five six seven eight nine ten"), ("a b", "b c"), ("", "x")], "l string, r string")
    assert [r[0] for r in one.select(overlap_join(F.col("l"), F.col("r"))).collect()] == ["one two three four five six seven eight nine ten", "a b b c", "x"]
    seg = spark.createDataFrame([(1, i, f"{i} word " * 3) for i in range(4)] + [(1, 9, None)], "g int, o int, t string")
    assert [(r.o, r.kept, r.truncated) for r in hard_budget(seg, "g", [F.col("o")], "t", 14).orderBy("o").collect()] == [(0, 6, False), (1, 6, False), (2, 2, True)]
    iv = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 5, 6), (1, 8, 9), (2, 1, 1)], "g int, s int, e int")
    assert sorted(map(tuple, merge_intervals(iv, ["g"], "s", "e").collect())) == [(1, 0, 6), (1, 8, 9), (2, 1, 1)]


def test_bootstrap(spark):
    got = paired_delta(spark.createDataFrame([("x", "s1", 0.5, 1), ("x", "s2", 0.5, 1), ("y", "s", 0.0, 5)], "arm string, stratum string, delta double, n long"), "arm").collect()
    assert {(r.arm, r.delta, r.low, r.high, r.wins, r.ties) for r in got} == {("x", 0.5, 0.5, 0.5, 2, 0), ("y", 0.0, 0.0, 0.0, 0, 5)}


def test_text_functions(spark):
    df = spark.createDataFrame([("A. B? c. The Cell-wall isn't 3.5 cm",), ("",), (None,)], "t string")
    got = df.select(X.tokens("t"), X.shingles(X.tokens("t")), X.corruption_reason(F.col("t")), X.sentences(F.col("t"), 3)).collect()
    assert got[0][0] == ["a", "b", "c", "the", "cell-wall", "isn't", "3.5", "cm"] and len(got[0][1]) == 4 and got[0][3] == ["A.", "B? c.", "The Cell-wall isn't", "3.5 cm"]
    assert got[1][1] == [] and [r[2] for r in got] == [None, "empty_output", "empty_output"]
    q = spark.createDataFrame([("Teh plant eat 5 W",)], "q string").select(*[Q.process(m, F.col("q")).alias(m) for m in Q.PROCESSORS]).first()
    assert q.spelling_normalization == "the plant eat 5 W" and q.textbook_synonym_expansion.endswith("Related textbook terms: autotrophic nutrition photosynthesis make food") and q.acronym_expansion.endswith("Expanded terms: watt")


def test_evidence_set_goldens():
    chunk = lambda name, pages, chapter, section: {"candidate_id": name, "pdf_pages": pages, "chapter_title": chapter, "section_title": section}
    a, b, c, d, e = chunk("a", [1], "C1", "S1"), chunk("b", [1, 2], "C1", "S1"), chunk("c", [2], "C1", "S2"), chunk("d", [3], "C2", "S3"), chunk("e", [4], "C2", "S3")
    names = lambda xs: "".join(x["candidate_id"] for x in xs)
    assert names(SELECTORS["same_page"]([c, e, a, b, d], 3)) == "cbe"
    assert names(SELECTORS["distinct_pages"]([a, b, c, d, e], 3)) == "abd"
    assert names(SELECTORS["same_section"]([a, c, e, b, d], 4)) == "abce"
    assert names(SELECTORS["coverage"]([a, b, c, d, e], 3)) == "abc" and SELECTORS["coverage"]([], 3) == []
    for choose in SELECTORS.values():
        if choose.__name__ in ("same_page", "same_section", "coverage", "distinct_pages"):
            assert len(set(names(choose([c, a, e, b, d], 4)))) == 4
