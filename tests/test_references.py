from datetime import datetime

from marginalia.operators.references import clean_key, latest_version, orphan_references, orphan_report, parse_time

REFS = "source string, record_id string, key string, at timestamp, key2 string"
PARENTS = "key string, born timestamp, died timestamp, at string"


def t(month, day=1):
    return datetime(2024, month, day, 12)


def brute(refs, parents):
    live = {p[0]: p for p in parents if p[0] is not None}
    out = []
    for source, rid, key, at, _ in refs:
        if key is None:
            continue
        if key not in live:
            out.append((source, rid, "missing"))
        elif at is not None:
            _, born, died, _ = live[key]
            if died is not None and died <= at:
                out.append((source, rid, "deleted"))
            elif born is not None and born > at:
                out.append((source, rid, "later"))
    return sorted(out, key=str)


def test_every_combination_of_months(spark):
    parents = [(f"p{b}{d}", b and t(b, 10), d and t(d, 20), "x") for b in (None, 2, 5) for d in (None, 5, 7)] + [(None, t(1), None, "x")]
    refs = [(s, f"{s}{k}{m}{day}", k, m and t(m, day), "y") for s in ("a", "b") for k in [p[0] for p in parents] + ["gone"] for m in (None, 1, 2, 5, 6, 7, 9) for day in (5, 10, 15, 20, 25)]
    refs += refs[:7] + [("a", None, "gone", t(3), None)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted([(r.source, r.record_id, r.reason) for r in got.collect()], key=str) == brute(refs, parents)
    report = {(r.source, str(r.period)[:7], r.reason): r.records for r in orphan_report(got).collect()}
    assert report["b", "2024-05", "missing"] == 5


def test_a_hot_key_and_many_keys(spark):
    refs = [("a", f"h{i}", "hot", t(3), None) for i in range(3000)] + [("a", f"r{i}", f"k{i % 700}", t(1 + i % 9), None) for i in range(4000)]
    parents = [(f"k{i}", t(1 + i % 5, 2), t(7) if i % 3 == 0 else None, None) for i in range(600)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted([(r.source, r.record_id, r.reason) for r in got.collect()], key=str) == brute(refs, parents)


def test_empty_tables(spark):
    none, parents = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    assert orphan_references(none, parents).count() == 0
    one = spark.createDataFrame([("a", "1", "k", None, None)], REFS)
    assert [r.reason for r in orphan_references(one, parents).collect()] == ["missing"]


def test_keys_times_and_versions(spark):
    df = spark.createDataFrame([(" AB ", "2024-01-01T05:30:00+05:30"), ("\t \n", "2024-01-01T00:00:00Z"), (None, "nonsense")], "k string, s string")
    assert [tuple(r) for r in df.select(clean_key("k"), parse_time("s")).collect()] == [("ab", datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), (None, None)]
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", None, "z"), (None, 9, "q")], "id string, v int, c string")
    assert sorted(map(tuple, latest_version(v, "id", "v", "c").collect())) == [("a", 2, None), ("b", None, "z")]
