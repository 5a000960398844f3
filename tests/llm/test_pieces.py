import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.pieces import cut_points, split_texts

TEXT = st.text(alphabet="ab .\n。é𝄞", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(10, 60), st.integers(0, 4))
def test_round_trip_and_limits(text, limit, overlap):
    cuts = cut_points(text, limit, overlap)
    pieces = [text[a:b] for a, b, _ in cuts]
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text
    assert all(len(p) <= limit for p in pieces)
    assert all(b[:overlap] == a[len(a) - overlap :] for a, b in zip(pieces, pieces[1:]))
    for start, end, kind in cuts[:-1]:
        assert end > start
        if kind == "none":
            assert not any(c.isspace() for c in text[start + overlap : start + limit - 1])
    assert (len(cuts) == 1) == (len(text) <= limit)


def test_balanced_and_strongest_boundary():
    text = ("word " * 300).strip() + ".\n\n" + "word " * 300
    cuts = cut_points(text, 2000, 200)
    assert len(cuts) == 2 and cuts[0][2] == "paragraph" and text[: cuts[0][1]].endswith("\n\n")
    assert [k for *_, k in cut_points("x" * 5000, 2000, 200)] == ["none", "none", "end"]


def test_rows(spark):
    rows = [(1, "a" * 4001, "p"), (2, None, "p"), (3, "", "p"), (None, "b c", "p"), (1, "a" * 4001, "p"), (4, "𝄞" * 2001, "p"), (5, "𝄞" * 2000, "p")]
    got = split_texts(spark.createDataFrame(rows, "k long, t string, pieces string"), "k", "t").collect()
    assert sorted((r.id or 0, r.pieces) for r in got) == [(0, 1), *[(1, 3)] * 6, (2, 1), (3, 1), (4, 2), (4, 2), (5, 1)]
    assert [r.text for r in got if r.id == 2] == [None] and [r.text for r in got if r.id == 3] == [""]
    assert split_texts(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame(rows, "k long, t string, pieces string"), "k", "t", 100, 60)


def test_long_texts_take_linear_time():
    def seconds(n):
        text = "".join("x" * (500 + i * 37 % 2000) + " " for i in range(n))
        began = time.process_time()
        cut_points(text)
        return time.process_time() - began

    seconds(10)
    assert min(seconds(2400) for _ in range(2)) < 20 * min(seconds(300) for _ in range(3))  # 8 times the length; quadratic would be 64 times
