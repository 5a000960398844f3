"""Whole blocks of documents give what each document gives on its own, in little time."""

import os
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import unwelcome
from marginalia.llm.unwelcome import ROUNDS, Normal, WordKeys, _blocks, _count, _edges, _log_odds, _own, prior_words, score_documents, split_words, train

PIECES = st.sampled_from(["river", "f", "u", "c", "k", "F.U.C.K", "s**t", "a-b", "--", "12", "well-known", "idi0t", "\u00a8", "\u0928\u0926\u0940", " ", "  ", "\n", "\u00a0", "\u2003", "\x1c", "\u200b"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(PIECES, max_size=12).map(" ".join) | st.lists(PIECES, max_size=9).map("\n".join) | st.lists(PIECES, max_size=9).map("".join), max_size=6))
def test_words_of_a_block(texts):
    normal, keys = Normal(set(prior_words())), WordKeys()
    words, starts = split_words(pa.array(["left out", *texts], pa.string()).slice(1), normal, keys)
    assert [words[a:e].tolist() for a, e in zip(starts, starts[1:])] == [[keys[w] for w in normal.tokens(t or "")] for t in texts]


def test_letters_set_apart_in_a_block():
    normal, keys = Normal(set(prior_words())), WordKeys()
    texts = ["plan a", "b c", "you f u c k i n g b a s t a r d now", "", "i", "d i m w i t", None, "x"]
    words, starts = split_words(pa.array(texts), normal, keys)
    assert [words[a:e].tolist() for a, e in zip(starts, starts[1:])] == [[keys[w] for w in t.split()] for t in ("plan a", "b c", "you fucking bastard now", "", "i", "dimwit", "", "x")]


@st.composite
def reviewed(draw):
    words = draw(st.lists(st.integers(1, 4), max_size=9))
    cuts = sorted(draw(st.lists(st.integers(0, len(words)), max_size=6, unique=True)))
    return words, draw(st.sampled_from([None, [], [(0, len(words))], list(zip(cuts[::2], cuts[1::2])), list(zip(cuts, cuts[1:]))]))


@settings(max_examples=300, deadline=None)
@given(st.lists(reviewed(), min_size=1, max_size=5))
def test_own_counts_of_a_block(docs):
    """A feature is a document's own in unwelcome (fine) text if it stands within a run of it, wherever it is looked up."""
    words = np.array([w for d, _ in docs for w in d], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) for d, _ in docs])])
    own = _own(words, starts, [s for _, s in docs])
    for at, (d, segments) in zip(starts.tolist(), docs):
        bad = [] if segments is None else [d[a:e] for a, e in segments]
        ends = [(0, 0), *(segments or []), (len(d), len(d))]
        fine = [] if segments is None else [d[e:a] for (_, e), (a, _) in zip(ends, ends[1:])]
        for n in (1, 2, 3):
            for got, runs in ((own.bad, bad), (own.fine, fine)):
                counted = {tuple(r[i : i + n]) for r in runs for i in range(len(r) - n + 1)}
                spots = range(len(d) - n + 1)
                assert [bool(got[n - 1, at + i]) for i in spots] == [tuple(d[i : i + n]) in counted for i in spots]


def test_leaving_out_own_counts_takes_little_time():
    rng = np.random.default_rng(5)
    docs = [(rng.integers(1, 3000, 250) << 40, [(0, 250)] if i % 12 == 0 else []) for i in range(1500)]
    counts = _count(docs)
    model = _log_odds(*counts, np.zeros(len(counts[0])), {})
    words, starts = np.concatenate([w for w, _ in docs]), np.arange(0, 250 * 1501, 250)

    def seconds(own):
        began = time.process_time()
        model.token_scores(words, _edges(starts), _own(words, starts, [s for _, s in docs]) if own else None)
        return time.process_time() - began

    seconds(False)
    plain, own = (min(seconds(x) for _ in range(3)) for x in (False, True))
    assert own < 8 * plain  # one document at a time, with a search for its own features, took 29 times as long


def test_blocks_do_not_change_results(spark, monkeypatch):
    b = pa.record_batch({"text": ["a" * 5, None, "", "b" * 30, "c", "d" * 9]})
    monkeypatch.setattr(unwelcome, "BLOCK", 10)
    parts = list(_blocks(b, pa.array([5, None, 0, 30, 1, 9])))
    assert len(parts) > 2 and [t for p in parts for t in p.column("text").to_pylist()] == b.column("text").to_pylist()
    assert not list(_blocks(b.slice(0, 0), pa.array([], pa.int32())))
    monkeypatch.undo()
    rows = [(i, None if i == 7 else "The leaf is near the river. " * (i % 5) + ("You are a m o r o n and idi0t." if i % 9 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    model = train(docs, spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(200)], "id long, label int"))
    whole = score_documents(docs, "id", "text", model).orderBy("id").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert score_documents(docs, "id", "text", model).orderBy("id").collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_models_of_earlier_rounds_leave_the_disk(spark):
    files = lambda: set(os.listdir(spark.sparkContext._temp_dir))
    docs = spark.createDataFrame([(i, f"The leaf {i} is near the river.") for i in range(30)], "id long, text string")
    before = files()
    train(docs, spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(30)], "id long, label int"))
    assert len(files() - before) < ROUNDS  # one stayed for each round, besides that of the known words
