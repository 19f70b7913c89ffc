"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text's terms are all its words, the five-letter beginnings of longer words (marked `^`), and for either whether they come two
or four times (`*2`, `*4`). The vector space has every term of the labelled sample, of both labels: none is left out. Weights are
(1 + ln count) * idf, with document frequencies over all documents (a repeat has its term's), times how surely the sample ties the term to either label:
FLOOR + z * z / (z * z + DOUBT), where z is the term's log odds ratio in standard errors. Without that factor the few words that
matter drown in the rare words of a long text.

Examples are held in an inverted index whose postings are cut into blocks of BLOCK examples; each term has its largest weight of
each block that it comes in. Terms of more than a FREQUENT-th of the examples have whole rows of weights instead, which are summed first, for many texts
at once. A block's upper bound is its best such sum and the largest weights of the other terms; blocks are visited by falling bound, and the
search ends when the next bound is below the K-th best cosine, so the K nearest are exact.

Neighbours vote with weight cosine / (1 - cosine + SOFT), times the number of labelled rows that an example
stands for. Votes are calibrated by isotonic regression on leave-one-out votes of the examples. A text with no term of the space gets
the share of label 1 among such labelled texts, with the lowest calibrated score counted as one row of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import bounded_sample, held_out, map_arrow, write_table

#: Labelled rows sampled of each class, letters of a beginning, and the weights' part that doesn't depend on labels and the doubt of the other.
SAMPLE_PER_CLASS, LETTERS, FLOOR, DOUBT = 1500, 5, 0.02, 9.0
K, BLOCK, SOFT, THRESHOLD, EVIDENCE = 15, 64, 0.05, 0.7, 3
#: A term of more than this part of the examples has a whole row; texts searched at once; blocks that a search visits first.
FREQUENT, TEXTS_AT_ONCE, STEP = 32, 128, 16
#: Scores of texts that a task remembers, by the hash of their terms.
REMEMBERED = 20_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def base_counts(text: str | None) -> dict[str, int]:
    """Counts of the text's words and beginnings."""
    counts: dict[str, int] = Counter(words_of(text))
    for word, n in list(counts.items()):
        if len(word) > LETTERS:
            start = "^" + word[:LETTERS]
            counts[start] = counts.get(start, 0) + n
    return counts


def counts_of(text: str | None) -> dict[str, int]:
    """Counts of all terms of the text."""
    counts = base_counts(text)
    for term, n in list(counts.items()):
        if n > 1:
            counts[term + "*2"] = 1
        if n > 3:
            counts[term + "*4"] = 1
    return counts


class Vocabulary:
    """Numbers of the terms of a space; the repeats of a numbered term are found by its number."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.starts = {t[1:]: i for t, i in self.number.items() if t[0] == "^" and "*" not in t}
        self.start_of = np.array([self.starts.get(t[:LETTERS], -1) if len(t) > LETTERS and t[0] != "^" and "*" not in t else -1 for t in terms], np.int64)
        self.repeats = np.array([[self.number.get(t + "*2", -1), self.number.get(t + "*4", -1)] for t in terms], np.int32).reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.number)

    def __reduce__(self):
        return _vocabulary, (" ".join(self.number),)  # terms have no blanks; the numbers are made again

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word and of its beginning, -1 for none; a known word's beginning is known by its number."""
        number, start_of = self.number.get, self.starts.get
        own = np.array([number(w, -1) for w in words], np.int64)
        start = self.start_of[own] if len(self.start_of) else own.copy()
        new = np.flatnonzero(own < 0)
        start[new] = [start_of(w[:LETTERS], -1) if len(w) > LETTERS else -1 for w in map(words.__getitem__, new.tolist())]
        return own, start

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of the text's terms that the space has."""
        found = Counter(words_of(text))
        n = np.fromiter(found.values(), np.int64, len(found))
        own, start = self._numbers(list(found))
        starts, place = np.unique(start[start >= 0], return_inverse=True)
        started = np.bincount(place, weights=n[start >= 0], minlength=len(starts)).astype(np.int64)
        terms, counts = np.concatenate([own[own >= 0], starts]), np.concatenate([n[own >= 0], started])
        more = np.concatenate([self.repeats[terms[counts > 1], 0], self.repeats[terms[counts > 3], 1]])
        more = more[more >= 0].astype(np.int64)
        return np.concatenate([terms, more]), np.concatenate([counts, np.ones(len(more), np.int64)])


def _vocabulary(terms: str) -> Vocabulary:
    return Vocabulary(terms.split())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pack(terms: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Terms, sorted, as differences, and their counts, as numbers of 1, 2 or 4 bytes after a byte that says so."""
    order = np.argsort(terms)

    def small(x: np.ndarray) -> bytes:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        return bytes([kind.itemsize]) + x.astype(kind).tobytes()

    return small(np.diff(terms[order], prepend=0)), small(counts[order])


def unpack(terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    def wide(x: bytes) -> np.ndarray:
        return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)

    return np.cumsum(wide(terms)), wide(counts)


class Index:
    """Block-max inverted index of unit TF-IDF vectors, each a sequence of (term, weight)."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list, weights: list[float], n_terms: int, groups: list | None = None):
        # examples of one group, and with the same leading term, stand together, so that block maxima are tight
        vectors = [np.asarray(v, np.float64).reshape(-1, 2) for v in vectors]
        lead = [int(v[np.lexsort((v[:, 0], -v[:, 1]))[0], 0]) for v in vectors]
        order = sorted(range(len(ids)), key=lambda i: (groups[i] if groups else 0, lead[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.weights = np.array([weights[i] for i in order], np.float64)
        every = np.concatenate([vectors[i] for i in order])
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i]) for i in order])
        by_term = np.argsort(every[:, 0], kind="stable")
        sizes = np.bincount(every[:, 0].astype(np.int64), minlength=n_terms)
        self.postings = (sizes.astype(np.int32), place[by_term].astype(np.int16 if len(order) < 1 << 15 else np.int32), every[by_term, 1])
        self._prepare()

    def __getstate__(self) -> tuple:
        return self.ids, self.labels, self.weights, self.postings  # a tenth of all, from which the rest is made again

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.labels, self.weights, self.postings = state
        self._prepare()

    def _prepare(self) -> None:
        """The rows of frequent terms, and the blocks of the other terms' postings."""
        sizes, place, value = self.postings
        n_terms, order = len(sizes), self.ids
        term, place = np.repeat(np.arange(n_terms), sizes), place.astype(np.int32)
        self.blocks = -(-len(order) // BLOCK)
        frequent = np.flatnonzero(sizes.astype(np.int64) * FREQUENT > len(order))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.blocks * BLOCK))
        whole = self.row[term] >= 0
        self.rows[self.row[term[whole]], place[whole]] = value[whole]
        term, self.place, self.value = term[~whole], place[~whole], value[~whole]
        block = self.place // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))[: len(term)])
        self.block, self.largest = block[new], np.maximum.reduceat(self.value, new) if len(new) else self.value
        self.first = np.concatenate([new, [len(term)]]).astype(np.int32)  # postings of each (term, block)
        self.of_term = np.searchsorted(term[new], np.arange(n_terms + 1)).astype(np.int32)  # (term, block) pairs of each term

    def nearest(self, vector, k: int = K, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, place) of the k nearest examples of positive cosine, ties to the smaller id."""
        return self.nearest_of([vector], k, [without])[0]

    def nearest_of(self, vectors: list, k: int = K, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest() of each vector: the STEP blocks of largest bound first, then all whose bound reaches the k-th best cosine of these."""
        vectors = [np.asarray(v, np.float64).reshape(-1, 2) for v in vectors]
        rows, width = len(vectors), self.blocks * BLOCK
        every, asks = np.concatenate(vectors), np.repeat(np.arange(rows), [len(v) for v in vectors])
        terms, weight = every[:, 0].astype(np.int64), every[:, 1]
        whole = self.row[terms] >= 0
        query = np.zeros((rows, len(self.rows)))
        query[asks[whole], self.row[terms[whole]]] = weight[whole]
        known = query @ self.rows  # sums over the frequent terms
        sizes = self.of_term[terms + 1] - self.of_term[terms]
        pairs, weight, asks = _ranges(self.of_term[terms], sizes), np.repeat(weight, sizes), np.repeat(asks, sizes)
        cell = asks * self.blocks + self.block[pairs]
        most = np.bincount(cell, weights=weight * self.largest[pairs], minlength=rows * self.blocks).reshape(rows, self.blocks)
        bound = known.reshape(rows, self.blocks, BLOCK).max(axis=2) + most
        score = np.zeros((rows, width))
        left_out = np.array([(i, p) for i, p in enumerate(without or []) if p >= 0], np.int64).reshape(-1, 2)

        def visit(chosen: np.ndarray) -> np.ndarray:
            """Puts the cosines of the chosen blocks into score; returns each vector's k-th best one so far, 0 at least."""
            used = np.flatnonzero(chosen.ravel()[cell])
            starts = self.first[pairs[used]]
            n = self.first[pairs[used] + 1] - starts
            postings = _ranges(starts, n)
            at = np.repeat(asks[used] * width, n) + self.place[postings]
            more = np.bincount(at, weights=np.repeat(weight[used], n) * self.value[postings], minlength=rows * width).reshape(rows, width)
            np.copyto(score, known + more, where=np.repeat(chosen, BLOCK, axis=1))
            score[left_out[:, 0], left_out[:, 1]] = 0
            return np.maximum(0.0, np.partition(score, width - k, axis=1)[:, width - k]) if width > k else np.zeros(rows)

        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, np.argsort(-bound, axis=1, kind="stable")[:, :STEP], True, axis=1)
        chosen &= bound > 0
        least = visit(chosen)
        more = ~chosen & (bound > 0) & (bound >= least[:, None] - 1e-9)
        if more.any():
            least = visit(more)
        out = []
        for row, low in zip(score, least):
            near = np.flatnonzero((row > 0) & (row >= low - 1e-9))
            rounded = np.minimum(np.round(row[near], 12), 1.0)
            best = np.lexsort((self.ids[near], -rounded))[:k]
            out.append(list(zip(rounded[best].tolist(), near[best].tolist())))
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        cosine, place = np.array([c for c, _ in near]), np.array([p for _, p in near])
        w = cosine / (1 - cosine + SOFT) * self.weights[place]
        return float((w * self.labels[place]).sum() / w.sum())


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a rising fit: (smallest vote of each step, share of label 1 with one half row added to either side)."""
    steps: list[list[float]] = []
    for v, y, w in sorted(zip(votes, labels, weights)):
        if steps and steps[-1][0] == v:
            steps[-1][1] += w * y
            steps[-1][2] += w
        else:
            steps.append([v, w * y, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, a, n = steps.pop()
            steps[-1][1] += a
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in steps])


def term_weights(df: np.ndarray, rows: int, in_one: np.ndarray, in_other: np.ndarray, ones: int, others: int) -> np.ndarray:
    """The count-free part of each term's weight: idf over all rows, times what the sample's labels say of the term."""
    idf = np.log((1 + rows) / (1 + df)) + 1
    a, b, c, d = in_one + 0.5, in_other + 0.5, ones - in_one + 0.5, others - in_other + 0.5
    z = (np.log(a / c) - np.log(b / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return idf * (FLOOR + z * z / (z * z + DOUBT))


#: Smallest vote and score of each step, and the score of a text without terms.
Steps = tuple[np.ndarray, np.ndarray, float]


class Model:
    """The examples' index; calibrate() gives the scores' steps."""

    def __init__(self, space: Vocabulary, df: np.ndarray, n_docs: int, rows: list[tuple[int, int, np.ndarray, np.ndarray]], scale: tuple[float, float]):
        """rows: (doc_id, label, terms, counts); scale: labelled rows that one row of label 0, of label 1, stands for."""
        self.space, self.scale = space, scale
        seen = np.zeros((2, len(space)))
        for _, y, terms, _ in rows:
            seen[y, terms] += 1
        taken = Counter(y for _, y, _, _ in rows)
        self.weights = term_weights(df, n_docs, seen[1], seen[0], taken[1], taken[0])
        some = [(i, y, self.unit(t, c), int(t[np.argmax(df[t])])) for i, y, t, c in rows if len(t)]
        self.index = Index([x[0] for x in some], [x[1] for x in some], [x[2] for x in some], [scale[x[1]] for x in some], len(space), [x[3] for x in some]) if some else None
        self.without = [y for _, y, t, _ in rows if not len(t)]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.weights[terms]
        return np.column_stack([terms, raw / np.sqrt((raw * raw).sum())])

    def nearest(self, counted: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The nearest examples of texts of these terms and counts, leaving out the example at a place of `without`."""
        found: list[list[tuple[float, int]]] = [[] for _ in counted]
        vectors = [(i, self.unit(t, c)) for i, (t, c) in enumerate(counted) if self.index and len(t)]
        for at in range(0, len(vectors), TEXTS_AT_ONCE):
            part = vectors[at : at + TEXTS_AT_ONCE]
            for (i, _), near in zip(part, self.index.nearest_of([v for _, v in part], without=[without[i] if without else -1 for i, _ in part])):
                found[i] = near
        return found

    def calibrate(self, votes: list[tuple[float, int]]) -> Steps:
        """The scores' steps by votes (vote, label) of examples, each without itself."""
        if votes:
            v, y = np.array([x for x, _ in votes]), np.array([x for _, x in votes], np.float64)
            lows, rates = isotonic(v, y, np.where(y > 0, self.scale[1], self.scale[0]))
        else:
            lows, rates = np.array([0.0]), np.array([0.5])
        rows = [self.scale[y] for y in self.without]
        return lows, rates, (sum(y * self.scale[y] for y in self.without) + float(rates[0])) / (sum(rows) + 1)

    def score(self, near: list[tuple[float, int]], steps: Steps) -> tuple[float, list[int], list[int], list[float]]:
        """(score, evidence, ids, cosines) by a text's nearest examples: the first of them, and of those of label 1 among them."""
        lows, rates, base = steps
        if not near:
            return base, [], [], []
        at = int(np.searchsorted(lows, self.index.vote(near), side="right")) - 1
        ids = [int(self.index.ids[p]) for _, p in near]
        toxic = [i for i, (_, p) in zip(ids, near) if self.index.labels[p] > 0]
        return float(rates[max(0, at)]), toxic[:EVIDENCE], ids[:EVIDENCE], [c for c, _ in near[:EVIDENCE]]


def _terms_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts_of(text) for text in batch.column("text").to_pylist()]
        terms = pa.array([" ".join(x) for x in found], pa.string())
        counts = pa.array([np.fromiter(x.values(), np.int32, len(x)).tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), terms, counts], names=["doc_id", "toxic", "terms", "counts"])


def in_terms(docs: DataFrame, space: Vocabulary) -> DataFrame:
    """docs (doc_id, held_out, text) with terms and counts, packed, in place of the text."""
    held = docs.sparkSession.sparkContext.broadcast(space)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(*held.value.counts(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1))], names=["doc_id", "held_out", "terms", "counts"])

    return map_arrow(docs.select("doc_id", "held_out", "text"), counted, "doc_id long, held_out boolean, terms binary, counts binary")


def document_frequencies(docs: DataFrame, space: Vocabulary) -> np.ndarray:
    """In how many rows of docs (terms, counts) each term of the space comes; a repeat has its term's rows. Each task sends one sum of a term."""
    size = len(space)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows and size:
                total += np.bincount(np.concatenate([unpack(t, c)[0] for t, c in zip(*(x.to_pylist() for x in batch.columns))]), minlength=size)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part])], names=["t", "n"])

    df = np.zeros(size)
    for r in map_arrow(docs.select("terms", "counts"), count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # the sample's terms
        df[r["t"]] = r["n"]
    for repeats in space.repeats.T:
        df[repeats[repeats >= 0]] = df[repeats >= 0]
    return df


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast[Model], Steps, DataFrame]:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), sent to the executors once, its scores' steps, and docs in its terms,
    which are written once, so that texts are counted once; see fit_and_score."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = bounded_sample(known, ["doc_id"], SAMPLE_PER_CLASS, "toxic").withColumnRenamed("doc_id", "_id")
    # the labelled sample has about 2 * SAMPLE_PER_CLASS rows of two numbers whatever the input's size
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").cast("int").alias("toxic"))
    train = write_table(joined, "toxicity-train")
    rows = sorted((r["doc_id"], r["toxic"], r["terms"].split(), np.frombuffer(r["counts"], np.int32)) for r in map_arrow(train, _terms_and_counts, "doc_id long, toxic int, terms string, counts binary").collect())
    space = Vocabulary(sorted({t for _, _, terms, _ in rows for t in terms}))
    numbered = [(i, y, np.array([space.number[t] for t in terms], np.int64), counts) for i, y, terms, counts in rows]
    counted = write_table(in_terms(docs.withColumn("held_out", held_out()), space), "toxicity-terms")
    df = document_frequencies(counted, space)
    taken = Counter(y for _, y, _, _ in rows)
    model = Model(space, df, counted.count(), numbered, (total.get(0, 0) / max(1, taken[0]), total.get(1, 0) / max(1, taken[1])))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return held, model.calibrate(leave_one_out(train, held) if model.index else []), counted


def leave_one_out(train: DataFrame, held: Broadcast[Model]) -> list[tuple[float, int]]:
    """(vote, label) of every example by its nearest other ones."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        place = {int(i): p for p, i in enumerate(own.index.ids)}
        for batch in batches:
            ids, labels, texts = (batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))
            out = [(own.index.vote(near), y) for near, y in zip(own.nearest(list(map(own.space.counts, texts)), [place.get(i, -1) for i in ids]), labels) if near]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.float64()), pa.array([y for _, y in out], pa.int32())], names=["vote", "toxic"])

    parts = 4 * train.sparkSession.sparkContext.defaultParallelism  # few rows, but each is a search
    return sorted((r["vote"], r["toxic"]) for r in map_arrow(train.repartition(parts), voted, "vote double, toxic int").collect())


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence_ids, neighbour_ids, neighbour_cosines) of every row of docs.

    evidence_ids are the nearest examples of label 1 among the K that vote, neighbour_ids and neighbour_cosines the nearest of
    any label. Labels of held-out ids, null labels and null ids aren't learned from; of several labels of an id the
    largest counts, of several texts the smallest. Null and empty texts have no term and get the base share; without both classes in
    the sample every text does.
    """
    held, steps, rows = fit(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}  # copies of a text are scored once in a task
        for batch in batches:
            packed = list(zip(*(batch.column(c).to_pylist() for c in ("terms", "counts"))))
            keys = [xxhash.xxh3_128_digest(t + c) for t, c in packed]
            if len(seen) >= REMEMBERED:
                seen.clear()
            fresh = {key: row for key, row in zip(keys, packed) if key not in seen}
            seen |= zip(fresh, (held.value.score(near, steps) for near in held.value.nearest([unpack(*row) for row in fresh.values()])))
            out = [seen[key] for key in keys]
            score = [x[0] for x in out]
            lists = [pa.array([x[k] for x in out], pa.list_(kind)) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "evidence_ids", "neighbour_ids", "neighbour_cosines"])

    return map_arrow(rows, scored, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, neighbour_ids array<long>, neighbour_cosines array<double>")


def op10_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the nearest examples, for every document."""
    return fit_and_score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
