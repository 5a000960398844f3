import random

from marginalia.operators.bootstrap import paired_delta


def test_ten_thousand_draws_by_default(spark):
    random.seed(3)
    pairs = spark.createDataFrame([("x", f"s{i % 3}", random.random() - 0.5, 1) for i in range(60)], "arm string, stratum string, delta double, n long")
    assert paired_delta(pairs, "arm").collect() == paired_delta(pairs, "arm", draws=10_000).collect() != paired_delta(pairs, "arm", draws=2000).collect()
