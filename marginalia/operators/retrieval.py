"""Lexical and dense scoring, rank fusion and retrieval metrics over long tables of rankings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.session import materialize

BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60


def top_by(df: DataFrame, group: str, order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows of each group with their 1-based rank; Spark cuts groups to k before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(out) <= k)


def query_blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """The stated query set in blocks of about `size` rows by hash of the id; only one block is on the driver at a time."""
    kept = materialize(queries.filter("query_id IS NOT NULL"))
    blocks = -(-kept.count() // size)
    for i in range(blocks):
        yield kept.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()


class BestRows:
    """The k best (score, id) per query of the batches seen so far: greatest score first, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: one row per query, -inf where there is no hit; ids: of its columns."""
        if scores.shape[1] > 4 * self.k:  # whatever lies below a query's k-th best score can't come out
            least = np.partition(scores, -self.k, axis=1)[:, [-self.k]]
            columns = np.flatnonzero((scores >= least).any(axis=0))
            scores, ids = scores[:, columns], ids[columns]
        s = np.concatenate([self.scores, scores], axis=1)
        i = np.concatenate([self.ids, np.broadcast_to(ids, scores.shape)], axis=1)
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

    def rows(self, query_ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
        there = self.scores > -np.inf
        q = np.broadcast_to(query_ids[:, None], self.scores.shape)
        return pa.RecordBatch.from_arrays([pa.array(q[there]), pa.array(self.ids[there]), pa.array(self.scores[there])], names=names)


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B, block: int = 2048, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query that share a token with it; ties go to the smaller doc_id.

    docs: (doc_id, text); queries: (query_id, text), a stated query set, taken in
    blocks. A token repeated in the query counts each time. Document frequency, count and
    mean length are over all of docs; null texts are empty documents. One pass per block
    counts the wanted terms of each document; the next one multiplies these counts with the
    queries' term weights and keeps the k best per task, so that only they are shuffled.
    """
    spark = docs.sparkSession
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(X.token_count("text"), F.lit(0))).alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    schema = "query_id long, doc_id long, score double"
    parts = []
    for rows in query_blocks(queries.select("query_id", X.tokens("text").alias("terms")), block):
        bags = [(r["query_id"], Counter(r["terms"] or ())) for r in rows]
        terms = {t: i for i, t in enumerate(sorted({t for _, bag in bags for t in bag}))}  # of one block of queries
        counts = materialize(_wanted_counts(docs, terms))
        df = np.zeros(len(terms))
        for r in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():  # one row per term of the block
            df[r["id"]] = r["df"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weights = np.zeros((len(terms), len(bags)), dtype=np.float64)
        for j, (_, bag) in enumerate(bags):
            for t, c in bag.items():
                weights[terms[t], j] = c * idf[terms[t]]
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in bags], dtype=np.int64), weights))  # one block

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, w = shared.value
            best = BestRows(len(ids), k)
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    lists = batch.column("ids")
                    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                    size = batch.column("dl").to_numpy(zero_copy_only=False)[doc]
                    used, term = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                    gain = np.zeros((batch.num_rows, len(used)))
                    gain[doc, term] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))
                    s = np.round(gain @ w[used], digits).T
                    best.add(np.where(s > 0, s, -np.inf), batch.column("doc_id").to_numpy(zero_copy_only=False))
            yield best.rows(ids, ["query_id", "doc_id", "score"])

        parts.append(counts.mapInArrow(score, schema))
    return top_by(_union(parts, spark, schema), "query_id", [F.desc("score"), F.col("doc_id")], k)


def _wanted_counts(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, dl, ids, tfs): number of tokens, and the wanted terms each document has with their counts; documents without any are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of one block of queries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, look = re.compile(X.TOKEN).findall, shared.value.get
        for b in batches:
            keep, sizes, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = find(text.lower()) if text and text.isascii() else [w.lower() for w in find(text or "")]
                bag = Counter(map(look, words))
                bag.pop(None, None)
                if bag:
                    keep.append(i)
                    sizes.append(len(words))
                    ids.append(list(bag))
                    tfs.append(list(bag.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "dl", "ids", "tfs"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(count, "doc_id long, dl int, ids array<int>, tfs array<int>")


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors with the greatest dot product per query.

    queries is a stated set and travels in blocks, one matrix each; every task scores
    its vectors with matrix products and keeps the k best per query, so that only they
    are shuffled. Ties go to the smaller vec_id.
    """
    spark, schema, parts = vectors.sparkSession, "query_id long, vec_id long, score double", []
    for rows in query_blocks(queries.select("query_id", "embedding"), block):
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64)))  # one block

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best = BestRows(len(ids), k)
            for b in batches:
                if b.num_rows:
                    v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    best.add(np.round(matrix @ v.T, 9), b.column("vec_id").to_numpy(zero_copy_only=False))
            yield best.rows(ids, ["query_id", "vec_id", "score"])

        parts.append(vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(score, schema))
    return top_by(_union(parts, spark, schema), "query_id", [F.desc("score"), F.col("vec_id")], k)


def fuse(rankings: DataFrame, group: str, item: str, source: str, rank: str, weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(group, item, fused): weighted sum of 1 / (k + best rank) over the sources that list the item."""
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col(source) == name, x).otherwise(w)
    best = rankings.groupBy(group, item, source).agg(F.min(rank).alias("_rank"))
    return best.groupBy(group, item).agg(F.sum(w / (k + F.col("_rank"))).alias("fused"))


def minmax(value: str, group: str) -> Column:
    """Value scaled to 0..1 within its group; 0 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def hit_metrics(first: DataFrame, by: list[str]) -> DataFrame:
    """questions, hits at 1, 3 and 5 and MRR per `by`, of (by, first_rank), null where nothing relevant was found."""
    r = F.col("first_rank")
    hit = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}")
    return first.groupBy(*by).agg(F.count("*").alias("questions"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def pareto_front(df: DataFrame, group: str, item: str, scores: Mapping[str, bool]) -> DataFrame:
    """(group, item) of the items no other of their group dominates: as good in every score and better in one.

    scores maps a column to True where more is better; a null is worse than any
    value. Each task first drops what its own rows dominate, so that only local
    fronts meet in a group, whatever the group's size.
    """
    cols = list(scores)
    rows = df.select(group, item, *[F.coalesce((F.col(c) if up else -F.col(c)).cast("double"), F.lit(float("-inf"))).alias(c) for c, up in scores.items()])

    def front(pdf):
        keep = []
        for _, g in pdf.groupby(group, sort=False):
            v = g[cols].to_numpy()
            order = np.lexsort(tuple(-v[:, i] for i in range(len(cols) - 1, -1, -1)))
            chosen: list[int] = []
            for i in order:  # a row can only be dominated by one before it
                f = v[chosen]
                if not len(f) or not ((f >= v[i]).all(axis=1) & (f > v[i]).any(axis=1)).any():
                    chosen.append(i)
            keep.append(g.iloc[chosen])
        return keep

    def local(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                yield pd.concat(front(pdf))

    def final(batches):
        """Groups lie together; the last one of a batch may go on in the next."""
        import pandas as pd

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf])
            last = pdf[group].iloc[-1]
            done = pdf[pdf[group] != last]
            held = front(pdf[pdf[group] == last])[0]
            if len(done):
                yield pd.concat(front(done))
        if held is not None:
            yield held

    fronts = rows.filter(F.col(group).isNotNull()).mapInPandas(local, rows.schema)
    return fronts.repartition(group).sortWithinPartitions(group).mapInPandas(final, rows.schema).select(group, item)
