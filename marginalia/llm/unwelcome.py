"""Abusive, hateful or sexual passages: maximum-scoring segments over token log-odds with Dirichlet priors.

Words and their pairs and triples get posterior log-odds of standing in
unwelcome rather than in fine reviewed text. Counts are smoothed by informative
Dirichlet priors: single words by their background frequency in all documents and
by a list of common abusive and explicit words, pairs and triples by their parts.
A linear scan over a document's token scores finds every maximal-scoring segment;
extreme-value statistics of the fine documents' best segments turn a segment's
score into a probability, which allows for the document's length. In learning, every
reviewed document is scored without what it added to the counts itself. Features go
by 64-bit keys.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize

# Words that speak for abuse, hate, threats or pornography, with their usual strength.
STRONG_WORDS = """fuck fucking fucked fucker motherfucker shit shitty shithead bullshit asshole arsehole bitch bastard
cunt dickhead prick twat wanker slut whore scumbag douchebag jackass dumbass dimwit halfwit moron imbecile idiot retard
retarded subhuman subhumans faggot pussy cock cocks tits dick blowjob handjob cum horny porn porno xxx hardcore nude nudes milf
boobs orgasm gangbang creampie anal"""
MILD_WORDS = """stupid pathetic worthless useless disgusting filthy brainless gutless ugly miserable loser losers scum
filth vermin parasites cockroaches rats animals garbage trash inferior goddamn damn damned bloody piss pissed crap hell ass
hate kill murder rape stab hurt beat smash bleeding knife shut mouth sick ashamed deserve nobody topless naked undressed
sexy sex rough wet moaning begging thrust panting stroked breasts tongue nipples uncensored explicit immigrants liars
thieves burn die dead"""
#: (pseudo-counts in unwelcome text, pseudo-counts in fine text)
PRIOR_COUNTS = {"strong": (8.0, 0.4), "mild": (3.0, 1.0)}
#: Pseudo-counts of any other word, of a pair or triple, and per labelled word of a word's background share.
WORD_PRIOR, NGRAM_PRIOR, BACKGROUND_PRIOR = 2.0, 1.0, 0.001

#: Labelled documents to learn from at most (chosen by hash of the id).
MOST_LABELLED = 50_000
#: The same for a segment of a document that reviewers call unwelcome to be learned from.
LIKELY = 0.05
#: The same at which a document that reviewers call fine is left out of learning.
DOUBTFUL = 1e-5
#: Rounds of learning; from the second on only the segments of the round before count as unwelcome.
ROUNDS = 3
#: Score of a word that was never counted.
UNKNOWN_WORD = -1.0
#: Greatest probability at which the best segment of a document is significant.
SIGNIFICANCE = 1e-3
#: Share of the fine documents' best scores above which only their number counts.
CENSORED = 0.95
#: Bytes of texts or tokens that are worked on at once, to the end of a document.
BLOCK = 1 << 22

_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнο αε".replace(" ", ""), "aeopcyxijsdhkmtbhoae")
_LEET = [str.maketrans("013457$@!", "oieastsai"), str.maketrans("013457$@!|", "oleastsail")]
_EDGE = "\"'“”„«»‘’()[]{}<>.,;:?!¿¡…—–-|/\\=+~`^%&।"
_INNER = re.compile(r"[._\-*#~+'’/:,;!?|]+")
_RUN = re.compile(r"(.)\1{2,}")
_USER = re.compile(r"@?(?:user|guest)_\d+")


class Normal(dict):
    """Raw word -> normalised words; undoes disguises where that gives a known word."""

    def __init__(self, known: set[str]):
        super().__init__()
        self.known = known
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        listed = prior_words()
        for w in sorted(known, key=lambda w: (-listed[w][0] if w in listed else 0, w)):  # strong, mild, learnt
            self.by_shape.setdefault((w[:1], len(w)), []).append(w)

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 400_000:
            self.clear()
        self[raw] = v = self._words(raw)
        return v

    def _words(self, raw: str) -> tuple[str, ...]:
        w = raw
        if not w.isascii():
            w = "".join(c for c in unicodedata.normalize("NFKC", w) if unicodedata.category(c) != "Cf")
            if any("a" <= c <= "z" for c in w.lower()):
                w = w.lower().translate(_LOOKALIKES)
        w = w.lower()
        if _USER.match(w):
            return ("@",)
        bare = w.strip(_EDGE)
        if not bare:
            return ()
        if bare.isalpha():
            return (self._runs(bare),)
        if bare.isdigit():
            return ("#",)
        if "*" in bare and (hit := self._masked(bare)):
            return (hit,)
        joined = _INNER.sub("", bare)
        pieces = [p for p in _INNER.split(bare) if p]
        if len(pieces) > 1:
            if joined.isalpha():
                word = self._runs(joined)
                if word in self.known or len(pieces) > 2 and all(len(p) == 1 for p in pieces):
                    return (word,)
            if (hit := self._leet(joined)) in self.known:
                return (hit,)
            return tuple(x for p in pieces for x in self._words(p))
        hit = self._leet(bare)
        return (hit,) if hit in self.known else (re.sub(r"\d+", "#", bare),)

    def _runs(self, word: str) -> str:
        """Letters repeated three or more times count once, or twice where only that is known."""
        if word in self.known or not (m := _RUN.search(word)):
            return word
        once = _RUN.sub(r"\1", word)
        twice = _RUN.sub(r"\1\1", word)
        return twice if m and once not in self.known and twice in self.known else once

    def _leet(self, word: str) -> str:
        for t in _LEET:
            if (x := self._runs(word.translate(t))) in self.known:
                return x
        return word

    def _masked(self, word: str) -> str | None:
        """A known word with the same length and visible letters; the strongest listed one before any learnt one."""
        visible = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
        return next((x for x in self.by_shape.get((word[:1], len(word)), ()) if visible.fullmatch(x)), None)

    def segment(self, letters: str) -> list[str] | None:
        """Letters set apart, as known words; None if they aren't."""
        best: list[list[str] | None] = [[]] + [None] * len(letters)
        for i in range(1, len(letters) + 1):
            for j in range(max(0, i - 16), i - 2):
                if best[j] is not None and letters[j:i] in self.known:
                    best[i] = best[j] + [letters[j:i]]
                    break
        return best[-1]

    def tokens(self, text: str) -> list[str]:
        out = [t for ws in map(self.__getitem__, text.split()) for t in ws]
        if " " in text and any(len(a) == len(b) == len(c) == 1 and a.isalpha() and b.isalpha() and c.isalpha() for a, b, c in zip(out, out[1:], out[2:])):
            return self._join_letters(out)
        return out

    def _join_letters(self, words: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and len(words[j]) == 1 and words[j].isalpha():
                j += 1
            found = self.segment("".join(words[i:j])) if j - i >= 3 else None
            out += found or words[i : max(j, i + 1)]
            i = max(j, i + 1)
        return out


def prior_words() -> dict[str, tuple[float, float]]:
    """Pseudo-counts of the listed words."""
    return {w: PRIOR_COUNTS[k] for k, ws in (("mild", MILD_WORDS), ("strong", STRONG_WORDS)) for w in ws.split()}


class Own(NamedTuple):
    """Whether reviewed documents, laid end to end, counted a feature in their own unwelcome and fine text: by size less 1 and first token."""

    bad: np.ndarray
    fine: np.ndarray

    def of(self, size: int) -> Own:
        return Own(*[x[size - 1, : max(0, x.shape[1] - size + 1)] for x in self])


@dataclass(frozen=True)
class Model:
    """Scores by sorted 64-bit key of words, pairs and triples, and extreme-value parameters of a document's best segment."""

    keys: np.ndarray
    scores: np.ndarray
    decay: float = 1.0
    rate: float = 1.0
    #: In learning: counts in unwelcome and fine text and the pseudo-counts of both, and which keys are listed words.
    counts: np.ndarray | None = None
    listed: np.ndarray | None = None
    #: Words that disguises were undone to in learning, besides the listed ones.
    known: frozenset[str] = frozenset()

    #: Bounds of a token's score.
    least, most = -1.0, 4.0

    @cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of a key by its lowest bits (-1: none), whether several keys share them, and those keys' positions, sorted by key."""
        size = 1 << max(1, (4 * len(self.keys)).bit_length())
        slot = self.keys & (size - 1)
        at = np.full(size, -1, dtype=np.int32)
        at[slot] = np.arange(len(self.keys), dtype=np.int32)
        second = np.flatnonzero(at[slot] != np.arange(len(self.keys)))
        shared = np.zeros(size, dtype=bool)
        shared[slot[second]] = True
        return at, shared, second

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, whether it is there) of keys: one look by their lowest bits, a search only where several keys share them."""
        at, shared, second = self._slots
        slot = wanted & (len(at) - 1)
        found = at[slot]
        hit = (found >= 0) & (self.keys[found] == wanted)
        again = np.flatnonzero(~hit & shared[slot])
        if len(again):
            keys = self.keys[second]
            i = np.minimum(np.searchsorted(keys, wanted[again]), len(keys) - 1)
            ok = keys[i] == wanted[again]
            found[again[ok]], hit[again[ok]] = second[i[ok]], True
        return found, hit

    def _look(self, wanted: np.ndarray, own: Own | None) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
        at, hit = self._find(wanted)
        if own is None:
            return np.where(hit, self.scores[at].astype(np.float64), 0.0), hit
        bad, fine = self.counts[0][at] - own.bad, self.counts[1][at] - own.fine
        more_bad, more_fine = self.counts[2][at].astype(np.float64), self.counts[3][at].astype(np.float64)
        hit &= (bad + fine > 0) | self.listed[at]
        return np.where(hit, np.log(np.maximum(bad + more_bad, 1e-9) / np.maximum(fine + more_fine, 1e-9)), 0.0), hit

    def token_scores(self, words: np.ndarray, edge: np.ndarray, own: Own | None = None) -> np.ndarray:
        """Score of each token of several documents laid end to end; words are word_keys, edge marks documents' first tokens.

        A token's score is the mean of what the longest known n-gram ending at it
        and the longest one beginning at it say. own leaves out what each reviewed
        document itself added to the counts.
        """
        v, hit = self._look(words, own and own.of(1))
        ending = np.where(hit, v, UNKNOWN_WORD)
        starting = ending.copy()
        pairs, triples = ngram_keys(words)
        v, hit = self._look(pairs, own and own.of(2))
        hit &= ~edge[1:]
        ending[1:][hit], starting[:-1][hit] = v[hit], v[hit]
        if len(triples):
            v, hit = self._look(triples, own and own.of(3))
            hit &= ~edge[1:-1] & ~edge[2:]
            ending[2:][hit], starting[:-2][hit] = v[hit], v[hit]
        return np.clip((ending + starting) / 2, self.least, self.most)

    def probability(self, best: float, length: int) -> float:
        """Probability that fine text of so many tokens has a segment scoring at least `best`."""
        if best <= 0:
            return 1.0
        return -math.expm1(-self.rate * max(1, length) * math.exp(-self.decay * best))


class WordKeys(dict):
    """Word -> 64-bit key."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = k = xxhash.xxh3_64_intdigest(word) >> 1  # positive as BIGINT
        return k

    def of(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64)


def split_words(texts: pa.Array, normal: Normal, keys: WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): the keys of normal.tokens() of all texts end to end, and the texts' offsets, with the end.

    Texts are split by Arrow, whose white space is Python's, and each different word of them is normalised once.
    """
    split = pc.utf8_split_whitespace(texts)
    each = split.flatten().dictionary_encode()
    parts = list(map(normal.__getitem__, each.dictionary.to_pylist()))  # none for the empty word before leading white space
    flat = list(chain.from_iterable(parts))
    key, letter = keys.of(flat), np.fromiter((len(t) == 1 and t.isalpha() for t in flat), bool, len(flat))
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = each.indices.to_numpy()
    number = many[raw]
    ends = np.cumsum(number)
    at = np.repeat((np.cumsum(many) - many)[raw] - ends + number, number) + np.arange(number.sum())
    raw_starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))])
    words, starts = key[at], np.concatenate([[0], ends])[raw_starts]
    letter = letter[at]
    row = np.flatnonzero(letter[:-2] & letter[1:-1] & letter[2:])
    doc = np.searchsorted(starts, row, "right") - 1
    runs, done, lengths = [], 0, np.diff(starts)
    for d in np.unique(doc[row + 2 < starts[doc + 1]]):  # letters set apart may be words
        joined = keys.of(normal.tokens(texts[int(d)].as_py()))
        runs += [words[done : starts[d]], joined]
        done, lengths[d] = starts[d + 1], len(joined)
    return (np.concatenate([*runs, words[done:]]), np.concatenate([[0], np.cumsum(lengths)])) if runs else (words, starts)


def _blocks(b: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about BLOCK bytes; sizes: each row's bytes."""
    block = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, e in zip(cuts, cuts[1:]):
        if a < e:
            yield b.slice(a, e - a)


_PAIR_STEP, _TRIPLE_STEP, _POSITIVE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64((1 << 63) - 1)


def _join_keys(left: np.ndarray, right: np.ndarray, step: np.uint64) -> np.ndarray:
    x = left.astype(np.uint64) * step ^ right.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * _PAIR_STEP
    return ((x ^ (x >> np.uint64(32))) & _POSITIVE).astype(np.int64)


def ngram_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs and of the triples of neighbours; a triple's key is made of its two pairs."""
    pairs = _join_keys(words[:-1], words[1:], _PAIR_STEP)
    return pairs, _join_keys(pairs[:-1], pairs[1:], _TRIPLE_STEP)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Disjoint segments, none of which can be extended or improved by its
    neighbours: each candidate is merged with the latest one before it that
    starts from a lower running sum, as long as that raises the total. Every
    candidate keeps a link to that one, so a candidate once passed over is never met again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, running sum before, running sum behind, link
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, _, low, _, link = found[j]
            del found[j:]
            j = link
        found.append((start, i + 1, low, total, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def best_scores(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Score of the best segment of each document (0 if no token scores above 0); starts: offsets of the documents, with the end."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out = np.zeros(len(starts) - 1)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        if b > a:
            part = sums[a : b + 1]
            out[i] = (part - np.minimum.accumulate(part)).max()
    return out


def _features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, left, right, size) of the words, pairs and triples of a run of tokens; left and right are the keys of an n-gram's two parts."""
    pairs, triples = ngram_keys(words)
    none = np.zeros(len(words), dtype=np.int64)
    return (
        np.concatenate([words, pairs, triples]), np.concatenate([none, words[:-1], pairs[:-1]]), np.concatenate([none, words[1:], pairs[1:]]),
        np.repeat(np.array([1, 2, 3], dtype=np.int8), [len(words), len(pairs), len(triples)]),
    )


def _parts(words: np.ndarray, segments: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The runs of tokens within the segments and those between them."""
    at, inside, outside = 0, [], []
    for a, e in segments:
        outside.append(words[at:a])
        inside.append(words[a:e])
        at = e
    outside.append(words[at:])
    return [r for r in inside if len(r)], [r for r in outside if len(r)]


def _edges(starts: np.ndarray) -> np.ndarray:
    """Marks the first tokens of documents laid end to end; starts: their offsets, with the end."""
    edge = np.zeros(int(starts[-1]) + 1, dtype=bool)
    edge[starts] = True
    return edge[:-1]


def _own(words: np.ndarray, starts: np.ndarray, segments: list[list[tuple[int, int]] | None]) -> Own:
    """What documents laid end to end add to the counts, each with its unwelcome segments; null segments add nothing."""
    own = Own(np.zeros((3, len(words)), dtype=bool), np.zeros((3, len(words)), dtype=bool))
    for a, e, found in zip(starts[:-1].tolist(), starts[1:].tolist(), segments):
        if found is None or a == e:
            continue
        if found in ([], [(0, e - a)]):  # all of it is one run
            (own.bad if found else own.fine)[:, a:e] = True
            continue
        run = np.zeros(e - a + 1, dtype=np.int64)  # even outside of segments
        for x, y in found:
            run[x] += 1
            run[y] += 1
        run = np.cumsum(run[:-1])
        key = _features(words[a:e])[0]
        within = np.concatenate([run >= 0, run[:-1] == run[1:], run[:-2] == run[2:]])
        bad = np.concatenate([run, run[:-1], run[:-2]]) % 2 == 1
        _, of = np.unique(key, return_inverse=True)
        for which, counted in zip(own, (within & bad, within & ~bad)):
            has = (np.bincount(of, weights=counted) > 0)[of]
            for n, x in enumerate(np.split(has, [e - a, 2 * (e - a) - 1])):
                which[n, a : a + len(x)] = x
    return own


def _count(documents: Iterable[tuple[np.ndarray, list[tuple[int, int]] | None]]) -> tuple[np.ndarray, ...]:
    """(key, left, right, size, bad, fine): in how many documents' unwelcome and fine text each feature occurs; key 0 holds the numbers of words.

    documents: tokens and their unwelcome segments; with null segments they are left out.
    """
    columns: list[list[np.ndarray]] = [[np.zeros(1, np.int64)] for _ in range(5)]
    totals = [0, 0]
    for words, segments in documents:
        if segments is None:
            continue
        for which, runs in enumerate(_parts(words, segments)):
            if not runs:
                continue
            key, left, right, size = (np.concatenate(x) for x in zip(*map(_features, runs)))
            totals[which] += sum(map(len, runs))
            key, at = np.unique(key, return_index=True)
            for c, x in zip(columns, (key, left[at], right[at], size[at], np.full(len(key), which))):
                c.append(x)
    key, left, right, size, which = map(np.concatenate, columns)
    keys, at, of = np.unique(key, return_index=True, return_inverse=True)
    bad, fine = (np.bincount(of[1:], weights=which[1:] == w, minlength=len(keys)).astype(np.int64) for w in (0, 1))
    bad[0], fine[0] = totals  # key 0 sorts first
    return keys, left[at], right[at], size[at], bad, fine


def _log_odds(key, left, right, size, bad, fine, background, listed_keys: dict[int, tuple[float, float]]) -> Model:
    """Posterior log-odds of every counted feature and listed word. Arrays as of _count, with each word's share of all documents' words."""
    n_bad, n_fine = (int(x[key == 0].sum()) for x in (bad, fine))
    usual = min(0.2, max(0.02, n_bad / max(1, n_bad + n_fine)))
    chances: list[tuple[np.ndarray, np.ndarray]] = []
    keys, counts = [], []
    for n in (1, 2, 3):
        m = np.flatnonzero((size == n) & (key != 0))
        k, b, f = key[m], bad[m].astype(float), fine[m].astype(float)
        if n == 1:
            weight = WORD_PRIOR + BACKGROUND_PRIOR * (n_bad + n_fine) * background[m]
            more_bad, more_fine = usual * weight, (1 - usual) * weight
            listed = np.array(sorted(listed_keys), dtype=np.int64)
            unseen = np.setdiff1d(listed, k)
            k, b, f = np.concatenate([k, unseen]), np.pad(b, (0, len(unseen))), np.pad(f, (0, len(unseen)))
            more_bad, more_fine = np.pad(more_bad, (0, len(unseen))), np.pad(more_fine, (0, len(unseen)))
            at = np.flatnonzero(np.isin(k, listed))
            more_bad[at], more_fine[at] = np.array([listed_keys[int(x)] for x in k[at]]).reshape(-1, 2).T
        else:
            known_keys, known = chances[-1]
            def of(parts: np.ndarray) -> np.ndarray:
                if not len(known_keys):
                    return np.full(len(parts), usual)
                i = np.minimum(np.searchsorted(known_keys, parts), len(known_keys) - 1)
                return np.where(known_keys[i] == parts, known[i], usual)

            share = (of(left[m]) + of(right[m])) / 2
            more_bad, more_fine = NGRAM_PRIOR * share, NGRAM_PRIOR * (1 - share)
        odds = np.log((b + more_bad) / (f + more_fine))
        order = np.argsort(k)
        chances.append((k[order], 1 / (1 + np.exp(-odds[order]))))
        keys.append(k)
        counts.append(np.array([b, f, more_bad, more_fine]))
    k, c = np.concatenate(keys), np.concatenate(counts, axis=1)
    order = np.argsort(k)
    k, c = k[order], c[:, order]
    return Model(k, np.log((c[0] + c[2]) / (c[1] + c[3])).astype(np.float32), counts=c.astype(np.float32), listed=np.isin(k, np.fromiter(listed_keys, np.int64)))


def fit_extremes(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """(decay, rate) by maximum likelihood, P(best score <= x) = exp(-rate * length * exp(-decay * x)).

    Scores of 0 say only that no segment scored above 0, and those above the CENSORED
    quantile only that they are above it, as some fine labels are wrong. Without
    enough scores above 0 the decay is that of exact log-odds, 1.
    """
    n = np.maximum(1.0, lengths)
    top = np.quantile(best, CENSORED) if len(best) else 0.0
    low, high = best <= 0, best > top
    mid = ~low & ~high
    x, n_mid, n_low, n_high = best[mid], n[mid], n[low].sum(), n[high]

    def at(decay: float) -> tuple[float, float]:
        """(log-likelihood, rate) at the best rate, which solves a monotone equation."""
        e = n_low + (n_mid * np.exp(-decay * x)).sum()
        h = n_high * math.exp(-decay * top)
        lo, hi = 1e-12, 1e6
        for _ in range(100):
            rate = math.sqrt(lo * hi)
            gain = len(x) / rate - e + (h / np.expm1(np.minimum(rate * h, 700))).sum()
            lo, hi = (rate, hi) if gain > 0 else (lo, rate)
        return len(x) * math.log(decay * rate) - decay * x.sum() - rate * e + np.log(-np.expm1(-rate * h)).sum(), rate

    if len(x) < 20:
        return 1.0, (at(1.0)[1] if len(best) else 0.02)
    a, b = -8.0, 8.0  # of log2(decay)
    for _ in range(80):
        c, d = a + 0.382 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if at(2**c)[0] >= at(2**d)[0] else (c, b)
    decay = 2 ** ((a + b) / 2)
    return decay, at(decay)[1]


def _tokenized(labelled: DataFrame, known: frozenset[str] = frozenset()) -> DataFrame:
    """(label, tokens): the keys of each text's normalised words."""
    shared = labelled.sparkSession.sparkContext.broadcast(known)  # words of at most MOST_LABELLED documents

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, keys = Normal(shared.value | prior_words().keys()), WordKeys()
        for b in (x for whole in batches for x in _blocks(whole, pc.binary_length(whole.column("text")))):
            words, starts = split_words(b.column("text"), normal, keys)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words))], names=["label", "tokens"])

    return labelled.select("text", "label").mapInArrow(split, "label int, tokens array<long>")


_CANDIDATES = "array<struct<start:int,stop:int,score:double>>"


def _segments(label: int, tokens: np.ndarray, candidates: list[dict] | None, model: Model | None) -> list[tuple[int, int]] | None:
    """What of a reviewed document counts as unwelcome; null if its label is doubtful.

    Without a model an unwelcome document counts as a whole, with one only its likely
    segments do. Unwelcome documents without a likely segment and fine ones with one that
    is next to impossible in fine text may be wrongly labelled.
    """
    if model is None or candidates is None:
        return [(0, len(tokens))] if label else []
    least = LIKELY if label else DOUBTFUL
    found = [(c["start"], c["stop"]) for c in candidates if model.probability(c["score"], len(tokens)) <= least]
    return None if bool(found) != bool(label) else found


def _reviewed(b: pa.RecordBatch, model: Model | None) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]] | None]]:
    for label, tokens, candidates in zip(b.column("label").to_pylist(), b.column("tokens"), b.column("candidates").to_pylist()):
        words = tokens.values.to_numpy(zero_copy_only=False)
        yield label, words, _segments(label, words, candidates, model)


def _counted(state: DataFrame, model: Model | None) -> tuple[np.ndarray, ...]:
    """_count over all reviewed documents; every partition counts on its own before anything is shuffled.

    The result has the features of at most MOST_LABELLED documents, whatever the tables' size.
    """
    names = ["key", "lhs", "rhs", "size", "bad", "fine"]
    calibrated = None if model is None else Model(model.keys[:0], model.scores[:0], model.decay, model.rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((words, segments) for b in batches for _, words, segments in _reviewed(b, calibrated))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _count(rows)], names=names)

    parts = state.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("key").agg(*[F.max(n).cast("int" if n == "size" else "long").alias(n) for n in names[1:4]], F.sum("bad").cast("int").alias("bad"), F.sum("fine").cast("int").alias("fine"))
    t = sums.toArrow()
    return tuple(t.column(n).to_numpy() for n in names)


def _rescored(state: DataFrame, model: Model, before: Model | None) -> DataFrame:
    """The reviewed documents with the maximal segments the model sees, each without what the document itself added to the counts."""
    shared = state.sparkSession.sparkContext.broadcast(model)  # features of at most MOST_LABELLED documents
    calibrated = None if before is None else Model(before.keys[:0], before.scores[:0], before.decay, before.rate)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (x for whole in batches for x in _blocks(whole, pc.multiply(pc.list_value_length(whole.column("tokens")), 8))):
            _, each, segments = zip(*_reviewed(b, calibrated))
            words, starts = np.concatenate(each), np.concatenate([[0], np.cumsum([len(w) for w in each])])
            scores = m.token_scores(words, _edges(starts), _own(words, starts, segments))
            parts = np.split(scores, starts[1:-1])
            found = [[{"start": x, "stop": y, "score": z} for x, y, z in maximal_segments(p)] if p.max(initial=0) > 0 else [] for p in parts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("tokens"), pa.array(found, kind)], names=["label", "tokens", "candidates"])

    found = materialize(state.mapInArrow(score, f"label int, tokens array<long>, candidates {_CANDIDATES}"))
    shared.destroy()  # what is written needs the model no more; else its copies stay on every machine's disk
    return found


def _calibrate(model: Model, state: DataFrame) -> Model:
    """Extreme-value parameters from the best segments of the reviewed fine documents (at most MOST_LABELLED)."""
    best = F.coalesce(F.array_max(F.transform("candidates", lambda c: c["score"])), F.lit(0.0))
    t = state.filter("label = 0 AND size(tokens) > 0").select(best.alias("best"), F.size("tokens").alias("n")).toArrow()
    decay, rate = fit_extremes(t.column("best").to_numpy(), t.column("n").to_numpy())
    return replace(model, decay=decay, rate=rate)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, label): at most MOST_LABELLED documents."""
    votes = labels.filter("label IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.avg("label").alias("share")).filter("share <> 0.5")
    chosen = votes.select("id", (F.col("share") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    return docs.filter("text IS NOT NULL").join(F.broadcast(chosen), "id").select("id", "text", "label")  # at most MOST_LABELLED rows


def known_words(docs: DataFrame, labels: DataFrame) -> frozenset[str]:
    """The words that two reviewed documents or more have in common, to which disguises are undone in learning, background and scoring alike."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normal(prior_words().keys())
        for b in batches:
            each = [w for t in b.column("text").to_pylist() for w in set(normal.tokens(t))]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string())], names=["word"])

    words = _labelled(docs, labels).select("text").mapInArrow(split, "word string")
    return frozenset(r["word"] for r in words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2").collect())


def train(docs: DataFrame, labels: DataFrame, background: DataFrame | None = None, known: frozenset[str] | None = None) -> Model:
    """A model from reviewers' labels. docs: (id, text); labels: (id, label 0 or 1).

    A document's label is the majority of its non-null labels; ties are left
    out. Labels may be missing altogether: then only the listed words count.
    At most MOST_LABELLED labelled documents are used, with all their words, pairs and
    triples. background: (key, n) over all documents. known: known_words() of the same
    documents and labels, if already computed.
    """
    known = known_words(docs, labels) if known is None else known
    state = materialize(_tokenized(_labelled(docs, labels), known).withColumn("candidates", F.lit(None).cast(_CANDIDATES)))
    word_keys = WordKeys()
    listed = {word_keys[w]: v for w, v in prior_words().items()}
    keys, shares = np.zeros(0, np.int64), np.zeros(0)
    if background is not None:
        learnt = state.select(F.explode("tokens").alias("key")).distinct().withColumn("_hit", F.lit(True))
        used = background.join(learnt, "key", "left").groupBy(F.when(F.col("_hit"), F.col("key")).otherwise(0).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # one row per labelled word, one for all others
        keys, n = used.column("key").to_numpy(), used.column("n").to_numpy()
        order = np.argsort(keys)
        keys, shares = keys[order], n[order] / max(1, n.sum())
    model: Model | None = None
    for _ in range(ROUNDS):
        counts = _counted(state, model)
        at = np.minimum(np.searchsorted(keys, counts[0]), max(0, len(keys) - 1))
        frequency = np.where(keys[at] == counts[0], shares[at], 0.0) if len(keys) else np.zeros(len(counts[0]))
        after = _log_odds(*counts, frequency, listed)
        state = _rescored(state, after, model)
        model = _calibrate(after, state)
    return replace(model, counts=None, listed=None, known=known)


def word_background(docs: DataFrame, known: frozenset[str] = frozenset()) -> DataFrame:
    """(key, n): how often each normalised word occurs in all texts; every partition counts before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # words of at most MOST_LABELLED documents

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        normal, keys = Normal(shared.value | prior_words().keys()), WordKeys()
        for b in batches:
            for x in _blocks(b, pc.binary_length(b.column("text"))):
                found = pc.utf8_split_whitespace(x.column("text")).flatten().value_counts()
                for w, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    raw[w] += n
            if len(raw) > 2_000_000:
                yield _batch(raw, normal, keys)
                raw.clear()
        yield _batch(raw, normal, keys)

    def _batch(raw: Counter, normal: Normal, keys: WordKeys) -> pa.RecordBatch:
        words: Counter = Counter()
        for w, n in raw.items():
            for t in normal[w]:
                words[keys[t]] += n
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, id_col: str, text_col: str, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, tokens, best_score, probability, passages, passage): one row per document.

    passages is the number of significant segments of any length, one word included, passage the text between the
    first and last token of the best one, normalised, null if there is none. Null and
    blank texts have 0 tokens, best_score 0 and probability 1. Ids may repeat or
    be null; each row is scored on its own. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    names = ["id", *keep, "tokens", "best_score", "probability", "passages", "passage"]
    kept = [rows.schema[c] for c in ["id", *keep]]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "tokens int, best_score double, probability double, passages int, passage string"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of at most MOST_LABELLED documents

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        normal, keys = Normal(m.known | prior_words().keys()), WordKeys()
        for b in (x for whole in batches for x in _blocks(whole, pc.binary_length(whole.column("_text")))):
            words, starts = split_words(b.column("_text"), normal, keys)
            lengths = np.diff(starts)
            scores = m.token_scores(words, _edges(starts))
            best = best_scores(scores, starts)
            chance = [m.probability(x, n) for x, n in zip(best, lengths)]
            count, passage = [0] * len(lengths), [None] * len(lengths)
            for i, p in enumerate(chance):
                if p <= SIGNIFICANCE:
                    found = [s for s in maximal_segments(scores[starts[i] : starts[i + 1]]) if m.probability(s[2], int(lengths[i])) <= SIGNIFICANCE]
                    count[i] = len(found)
                    if found:
                        a, e, _ = max(found, key=lambda s: s[2])
                        passage[i] = " ".join(normal.tokens(b.column("_text")[i].as_py())[a:e])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ["id", *keep]], pa.array(lengths, pa.int32()), pa.array(best), pa.array(chance, pa.float64()), pa.array(count, pa.int32()), pa.array(passage, pa.string())], names=names
            )

    return rows.mapInArrow(score, schema)


def source_key(c: Column | str) -> Column:
    """Trimmed and lower-cased; null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def rates(scored: DataFrame, by: str) -> DataFrame:
    """Per value of `by` (null is a value): documents, those with a significant passage, and their share."""
    flagged = F.sum(F.when(F.col("passages") > 0, 1).otherwise(0))
    return scored.groupBy(by).agg(F.count("*").alias("documents"), flagged.alias("unwelcome"), (flagged / F.count("*")).alias("rate"))
