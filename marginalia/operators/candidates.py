"""Order-dependent selection within one query's bounded candidate pool.

Pools are cut to a fixed depth per source before they are grouped, so that a
group has at most depth x sources rows, whatever the table's size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import TOKEN

DEPTH, THRESHOLD, RRF_K, SHINGLE = 20, 0.8, 60, 5
_TOKEN = re.compile(TOKEN)


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text or "")]


def shingle_set(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()


def pool(hits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The first `depth` hits of every query and retriever, ties by candidate and hit id."""
    w = Window.partitionBy("query_id", "retriever").orderBy("rank", "candidate_id", "hit_id")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= depth)


def cluster(rows: list[dict], threshold: float = THRESHOLD) -> list[list[dict]]:
    """Rows in order, each joined to the oldest cluster that holds the same evidence.

    Same evidence: one book, a shared page, and shingles of which the smaller
    set's share in the other reaches the threshold; or the same candidate id.
    An index of pages and one of shingles name the earlier rows that come into question.
    """
    on_page: dict[tuple, list[int]] = defaultdict(list)
    with_shingle: dict[tuple, list[int]] = defaultdict(list)
    sizes: list[int] = []
    home: list[int] = []
    out: list[list[dict]] = []
    for i, row in enumerate(rows):
        places = [(row["book_id"], p) for p in set(row["pdf_pages"] or ())]
        near = set(chain.from_iterable(on_page[x] for x in places))
        marks = shingle_set(row["text"])
        common = Counter(j for m in marks for j in with_shingle[m] if j in near) if near else Counter()
        alike = {j for j, n in common.items() if n >= threshold * min(sizes[j], len(marks))}
        alike |= {j for j in near if rows[j]["candidate_id"] == row["candidate_id"]}
        home.append(min((home[j] for j in alike), default=len(out)))
        if home[i] == len(out):
            out.append([])
        out[home[i]].append(row)
        sizes.append(len(marks))
        for x in places:
            on_page[x].append(i)
        for m in marks:
            with_shingle[m].append(i)
    return out


def merged(rows: list[dict], threshold: float = THRESHOLD) -> list[dict]:
    """Clusters with their best rank per source, fused score and representative (shortest text), best first."""
    out = []
    for g in cluster(sorted(rows, key=lambda r: (r["retriever"], r["place"])), threshold):
        ranks: dict[str, int] = {}
        for r in g:
            ranks[r["retriever"]] = min(r["rank"], ranks.get(r["retriever"], r["rank"]))
        best = min(g, key=lambda r: (len(words(r["text"])), r["rank"], r["retriever"], r["candidate_id"]))
        out.append({**best, "ranks": ranks, "fused": sum(1 / (RRF_K + x) for x in ranks.values()), "members": len(g), "gold": any(bool(r["matches_gold"]) for r in g)})
    return sorted(out, key=lambda c: (-c["fused"], c["candidate_id"]))


def _overlaps(clusters: list[dict]) -> np.ndarray:
    """Jaccard of every two clusters' words, by one product of their word indicators; 0 where either has none."""
    ids: dict[str, int] = {}
    bags = [{ids.setdefault(w, len(ids)) for w in words(c["text"])} for c in clusters]
    has = np.zeros((len(bags), len(ids)), dtype=np.float32)
    for row, bag in zip(has, bags):
        row[list(bag)] = 1
    both = has @ has.T
    size = np.diag(both)
    either = size[:, None] + size[None, :] - both
    return np.divide(both, either, out=np.zeros_like(both), where=both > 0).astype(np.float64)


def diverse(clusters: list[dict], budget: int, relevance: float = 0.7) -> list[dict]:
    """Maximal marginal relevance: scaled fused score against the greatest token similarity to what is chosen."""
    if not clusters:
        return []
    score = np.array([c["fused"] for c in clusters])
    low, span = score.min(), np.ptp(score)
    worth = relevance * ((score - low) / span if span else np.ones(len(score)))
    alike, nearest = _overlaps(clusters), np.zeros(len(score))
    by_name = np.argsort(np.argsort([c["candidate_id"] for c in clusters], kind="stable"))
    order: list[int] = []
    for _ in range(min(budget, len(score))):
        gain = worth - (1 - relevance) * nearest
        gain[order] = -np.inf
        pick = int(np.lexsort((by_name, -score, -gain))[0])
        order.append(pick)
        nearest = np.maximum(nearest, alike[pick])
    return [clusters[i] for i in order]


def quota(clusters: list[dict], budget: int) -> list[dict]:
    """An equal quota per source, then one per source in turn, then the best of the rest."""
    lists: dict[str, list[int]] = {}
    for s in sorted(set(chain.from_iterable(c["ranks"] for c in clusters))):
        having = [i for i, c in enumerate(clusters) if s in c["ranks"]]
        lists[s] = sorted(having, key=lambda i: (clusters[i]["ranks"][s], clusters[i]["candidate_id"]))
    order: dict[int, None] = {}
    for n, own in enumerate(lists.values()):
        share, extra = divmod(budget, len(lists))
        order |= dict.fromkeys(list(islice((i for i in own if i not in order), share + (n < extra))))
    in_turn = (i for i in chain.from_iterable(zip_longest(*lists.values())) if i is not None)
    order |= dict.fromkeys(chain(in_turn, range(len(clusters))))
    return [clusters[i] for i in islice(order, budget)]


def distinct_pages(clusters: list[dict], budget: int) -> list[dict]:
    """Clusters that bring a new page first, then the rest in order."""
    seen: set = set()
    first, rest = [], []
    for c in clusters:
        pages = set(c["pdf_pages"] or ())
        (rest if pages <= seen else first).append(c)
        seen |= pages
    return [*first, *rest][:budget]


def non_redundant(clusters: list[dict], budget: int, most: float = 0.72) -> list[dict]:
    """The first `budget` clusters without those too similar to one kept before."""
    kept: list[tuple[dict, set]] = []
    for c in clusters[:budget]:
        bag = set(words(c["text"]))
        if not any((len(bag & b) / len(bag | b) if bag | b else 1.0) >= most for _, b in kept):
            kept.append((c, bag))
    return [c for c, _ in kept]


def _expanded(clusters: list[dict], budget: int, labels: Callable[[dict], Iterable]) -> list[dict]:
    """Each cluster in order, followed by all that share a label with it; the first mention stands."""
    having: dict = defaultdict(list)
    for i, c in enumerate(clusters):
        for x in labels(c):
            having[x].append(i)
    mentioned = (j for i, c in enumerate(clusters) for j in (i, *sorted({j for x in labels(c) for j in having[x]})))
    return [clusters[i] for i in islice(dict.fromkeys(mentioned), budget)]


def same_page(clusters: list[dict], budget: int) -> list[dict]:
    """Every cluster brings those on its pages."""
    return _expanded(clusters, budget, lambda c: set(c["pdf_pages"] or ()))


def same_section(clusters: list[dict], budget: int) -> list[dict]:
    """Every cluster brings those of its section."""
    return _expanded(clusters, budget, lambda c: [(c["chapter_title"], c["section_title"])])


# Worth of a new page and of a new section against 1 / place.
NEW_PAGE, NEW_SECTION, COVERAGE_DEPTH = 0.08, 0.04, 20


def coverage(clusters: list[dict], budget: int) -> list[dict]:
    """Of the first twenty, always the one with the greatest 1 / place plus what its new pages and its new section are worth."""
    places, pages, sections, out = dict(enumerate(clusters[:COVERAGE_DEPTH])), set(), set(), []
    worth = lambda i: 1 / (1 + i) + NEW_PAGE * len(set(places[i]["pdf_pages"] or ()) - pages) + NEW_SECTION * ((places[i]["chapter_title"], places[i]["section_title"]) not in sections)
    while places and len(out) < budget:
        c = places.pop(max(places, key=lambda i: (worth(i), -i)))
        pages.update(c["pdf_pages"] or ())
        sections.add((c["chapter_title"], c["section_title"]))
        out.append(c)
    return out


#: Selectors by name.
SELECTORS: dict[str, Callable[[list[dict], int], list[dict]]] = {
    "fused": lambda c, n: c[:n], "diverse": diverse, "quota": quota, "distinct_pages": distinct_pages, "non_redundant": non_redundant,
    "same_page": same_page, "same_section": same_section, "coverage": coverage,
}


def select(hits: DataFrame, selector: str, budget: int, depth: int = DEPTH) -> DataFrame:
    """(query_id, position, candidate_id, members, fused, gold) of the chosen evidence clusters of every query.

    hits needs hit_id, query_id, retriever, rank, candidate_id, book_id,
    pdf_pages, text, matches_gold, chapter_title, section_title. Null texts and pages are empty.
    """
    choose = SELECTORS[selector]
    cols = ["hit_id", "retriever", "rank", "candidate_id", "book_id", "pdf_pages", "text", "matches_gold", "chapter_title", "section_title", "place"]
    # one row per query with its bounded pool: no per-group overhead in Python
    pools = pool(hits, depth).groupBy("query_id").agg(F.collect_list(F.struct(*cols)).alias("pool"))
    schema = pa.schema([("query_id", pa.int64()), ("position", pa.int32()), ("candidate_id", pa.string()), ("members", pa.int32()), ("fused", pa.float64()), ("gold", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for query, hits in zip(b.column("query_id").to_pylist(), b.column("pool").to_pylist()):
                for i, c in enumerate(choose(merged(hits), budget), 1):
                    rows.append({"query_id": query, "position": i, "candidate_id": c["candidate_id"], "members": c["members"], "fused": round(c["fused"], 9), "gold": c["gold"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pools.mapInArrow(run, "query_id long, position int, candidate_id string, members int, fused double, gold boolean")
