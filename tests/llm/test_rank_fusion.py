from collections import defaultdict

from marginalia.llm.rank_fusion import RRF_K, first_of_each, fuse_ranks

SCHEMA = "grp string, item string, up double, down double, _x string, place int"
SCORES = {"up": True, "down": False}


def brute(rows):
    groups = defaultdict(dict)
    for g, i, up, down, *_ in rows:
        groups[g][i] = (up, down)
    out = {}
    for g, items in groups.items():
        total = defaultdict(float)
        for s, sign in ((0, -1), (1, 1)):
            known = [sign * v[s] for v in items.values() if v[s] is not None and v[s] == v[s]]
            worst = max(known, default=0.0)
            val = {i: sign * v[s] if v[s] is not None and v[s] == v[s] else worst for i, v in items.items()}
            for i in items:
                total[i] += 1 / (RRF_K + 1 + sum(x < val[i] for x in val.values()))
        for place, i in enumerate(sorted(items, key=lambda i: (-round(total[i], 12), i)), 1):
            out[g, i] = place
    return out


def test_against_brute_force_with_nulls_and_ties(spark):
    rows = [(f"g{i % 4}", f"r{i:02d}", None if i % 7 == 0 else float(i * 37 % 11), float("nan") if i % 9 == 0 else float(i * 13 % 5) * 10**6, "z", 9) for i in range(60)]
    rows += [("alone", "r", None, None, None, None)]
    df = spark.createDataFrame(rows + [rows[3], (None, "x", 1.0, 1.0, "", 1), ("g1", None, 1.0, 1.0, "", 1)], SCHEMA)
    got = fuse_ranks(df, "grp", "item", SCORES)
    assert {(r.grp, r.item): r.place for r in got.collect()} == brute(rows)
    assert {r.grp for r in first_of_each(got, "grp", "item").collect()} == {"g0", "g1", "g2", "g3", "alone"}


def test_empty(spark):
    assert fuse_ranks(spark.createDataFrame([], SCHEMA), "grp", "item", SCORES).count() == 0


def test_the_largest_range_does_not_win(spark):
    rows = [("g", "a", 0.9, 1.0, "", 0), ("g", "b", 0.8, 2.0, "", 0), ("g", "c", 0.1, -1e9, "", 0)]
    assert fuse_ranks(spark.createDataFrame(rows, SCHEMA), "grp", "item", SCORES).filter("place = 1").first().item in {"a", "c"}
