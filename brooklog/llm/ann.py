"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are put into the lists of centroids fitted on a bounded sample. Each query has a threshold, its k-th best
score among sampled vectors, and probes the lists whose centroids come near it: within a margin, counted in the spread of
a list (root mean square distance from its centroid) along the query. The margin is measured: it is the least with which a sample of the
queries reaches REACH of its true neighbours, found by brute force over all rows. The query's own list, the LEAST_LISTS nearest
by that measure, and further ones while these hold fewer than k others are probed too.

Inside a probed list vectors are rotated by one random orthogonal matrix and read in column blocks. If x scores t, its partial
inner product after a share a of the query's squared length is t * a give or take
sqrt(a * (1 - a) / (dim - 1)) * sqrt(|q|^2 |x|^2 - t^2) under a random rotation. A candidate that lies more than `WIDTH` of these below what
the query's k-th best score so far asks for is dropped and never read further. Survivors of all blocks get the
exact inner product of the original vectors in double precision.

Lists and the queries that probe them are cut into blocks of bounded size, so a list that holds a third of
all vectors is many tasks. Each task gives the k best of its block for each query; a window merges them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.shared import MOST_BYTES, bounded_sample, map_arrow, write_table

K, QUERY_EVERY = 20, 20
#: Sampled vectors for the centroids and thresholds, the most centroids, Lloyd steps.
SAMPLE, MOST_LISTS, STEPS = 20_000, 1024, 8
#: Sampled queries (at most twice as many) and the share of their true neighbours that probing must reach; the share that most of these
#: queries must reach of their own, and how many are most; lists that each query probes at least.
PROBE_QUERIES, REACH, REACH_EACH, MOST, LEAST_LISTS = 256, 0.97, 0.9, 0.95, 3
#: Vectors and queries in one block, dimensions in one column block, standard deviations in the test.
BLOCK, QUERY_BLOCK, COLUMNS, WIDTH = 8192, 16384, 16, 3.0
#: Queries scanned at once, the share of alive pairs up to which they are read one by one, numbers in a buffer of pairs.
AT_ONCE, FEW_ALIVE, BUFFER = 64, 0.125, 1 << 21
#: Rounding of an inner product, as a share of both lengths.
ROUNDING = 1e-12


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's steps on a sample (n, dim); as many centroids as distinct rows allow, `lists` at most."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(7)
    centre = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(STEPS):
        near = nearest_list(distinct, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, distinct)
        n = np.bincount(near, minlength=len(centre))[:, None]
        centre = np.where(n > 0, sums / np.maximum(n, 1), centre)
    return centre


def nearest_list(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The closest centroid of each vector (Euclidean), ties to the first."""
    return ((centre * centre).sum(axis=1) - 2 * (x @ centre.T)).argmin(axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best_scores(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the k best of a few vectors for each query, in no order; its own id, and what is missing, scores -inf."""
    score = queries @ vectors.T
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    place = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(vectors) else np.tile(np.arange(len(vectors)), (len(queries), 1))
    return np.take_along_axis(score, place, axis=1), place


def thresholds(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the sampled vectors, -inf if there are fewer."""
    if len(sample) < k:
        return np.full(len(queries), -np.inf)
    return best_scores(queries, query_ids, sample, sample_ids, k)[0].min(axis=1)


def margins(queries: np.ndarray, least: np.ndarray, centre: np.ndarray, spread: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By how many spreads each list's centroid misses each query's threshold; -inf for lists that are always probed, inf for empty ones."""
    size = np.sqrt((queries * queries).sum(axis=1))
    miss = (least[:, None] - queries @ centre.T) / (size[:, None] * spread[None, :])
    miss[:, counts == 0] = np.inf
    first = np.argsort(miss, axis=1, kind="stable")[:, :LEAST_LISTS]
    np.put_along_axis(miss, np.column_stack([first, nearest_list(queries, centre)]), -np.inf, axis=1)
    miss[:, counts == 0] = np.inf
    return miss


def probes_needed(needed: list[np.ndarray]) -> float:
    """The least margin that reaches REACH of all neighbours, and REACH_EACH of their own for MOST queries.

    needed has the margins of the lists of each query's true neighbours.
    """

    def at(x: np.ndarray, share: float) -> float:
        return np.sort(x)[max(0, math.ceil(share * len(x) - 1e-9) - 1)]

    each = np.array([at(x, REACH_EACH) for x in needed])
    return float(max(at(np.concatenate(needed), REACH), at(each, MOST)))


def scan(queries: np.ndarray, query_ids: np.ndarray, probed: np.ndarray, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector id, exact score) of the k best vectors of the block for each query, own id left out.

    probed[n, list] says whether query n probes a list; lists has the list of each vector, least a score of each query that k vectors
    are known to reach, here or elsewhere. A query gets k vectors all the same if the block has them.
    """
    dim = vectors.shape[1]
    turn = rotation(dim)
    order = np.argsort(ids, kind="stable")
    vectors, ids, lists = vectors[order], ids[order], lists[order]
    q, x = queries @ turn, vectors @ turn
    cuts = [*range(0, dim, COLUMNS), dim]
    blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    length_q, length_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    # the share of each query's squared length up to each cut
    share = np.cumsum([(q[:, a:b] ** 2).sum(axis=1) for a, b in zip(cuts, cuts[1:])], axis=0) / length_q**2
    share = np.clip(share, np.finfo(float).tiny, 1)
    share[-1] = 1
    give = WIDTH * np.sqrt(share * (1 - share) / max(1, dim - 1))
    per_pair = max(1, BUFFER // dim)

    def exact(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        parts = [(vectors[cols[a : a + per_pair]] * queries[rows[a : a + per_pair]]).sum(axis=1) for a in range(0, len(rows), per_pair)]
        return np.concatenate(parts) if parts else np.zeros(0)

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), AT_ONCE):
        now = np.arange(start, min(start + AT_ONCE, len(q)))
        alive = probed[now][:, lists] & (ids[None, :] != query_ids[now, None])
        many = np.flatnonzero(alive.sum(axis=1) > 2 * k)
        partial = q[now, : cuts[1]] @ blocks[0].T
        floor = np.full(len(now), -np.inf)
        seed_rows = seed_cols = np.zeros(0, np.int64)
        if len(many):
            # a first threshold: the k-th exact score among those that look best after one block
            looks = np.where(alive[many], -partial[many], np.inf)
            seeds = np.argpartition(looks, 2 * k - 1, axis=1)[:, : 2 * k]
            seed_rows, seed_cols = np.repeat(many, 2 * k), seeds.ravel()
            found = exact(now[seed_rows], seed_cols).reshape(len(many), 2 * k)
            floor[many] = np.maximum(np.partition(found, k, axis=1)[:, k], least[now[many]])
            floor[many] -= ROUNDING * length_q[now[many]] * length_x.max()
        # how far from the query's line a vector that scores the threshold lies, times the query's length
        reach = length_q[now, None] * length_x[None, :]
        cosine = np.maximum(floor, 0)[:, None] / np.maximum(reach, np.finfo(float).tiny)
        alive &= cosine <= 1
        reach *= np.sqrt(np.maximum(1 - cosine * cosine, 0))
        rows = cols = score = None
        for b, upto in enumerate(cuts[1:]):
            if rows is None:
                if b:
                    partial += q[now, cuts[b] : upto] @ blocks[b].T
                alive &= partial >= (floor * share[b, now])[:, None] - give[b, now, None] * reach
                if alive.mean() <= FEW_ALIVE:
                    rows, cols = np.nonzero(alive)
                    score = partial[rows, cols]
            else:
                score = score + np.einsum("ij,ij->i", q[now[rows], cuts[b] : upto], blocks[b][cols])
                good = score >= (floor * share[b, now])[rows] - give[b, now[rows]] * reach[rows, cols]
                rows, cols, score = rows[good], cols[good], score[good]
        if rows is None:
            rows, cols = np.nonzero(alive)
        # the test may drop some seeds, and k are due
        pairs = np.unique(np.concatenate([rows * len(x) + cols, seed_rows * len(x) + seed_cols]))
        rows, cols = np.divmod(pairs, len(x))
        score = exact(now[rows], cols)
        best = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[best], cols[best], score[best]
        good = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((now[rows[good]], ids[cols[good]], score[good]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def make_bins(sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each list: a large list has bins of its own, small ones share one."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    at, room = -1, 0
    for i, n in enumerate(sizes):
        if parts[i] > 1:
            first[i], at, room = at + 1, at + parts[i], 0
        else:
            if n > room:
                at, room = at + 1, block
            first[i], room = at, room - n
    return first, parts


def columns(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of few rows."""
    got = rows.select("vec_id", "v").toArrow()
    return got.column("vec_id").to_numpy(), matrix(got.column("v").combine_chunks()).reshape(-1, dim)


def measured_margin(queries: DataFrame, indexed: DataFrame, misses: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, dim: int) -> float:
    """The margin that a sample of the queries needs for its true neighbours, by brute force over all rows."""
    ids, asked = columns(bounded_sample(queries, ["vec_id", "v"], PROBE_QUERIES), dim)
    if not len(ids):
        return 0.0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, lists = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int32)
        for batch in batches:
            more, place = best_scores(asked, ids, matrix(batch.column("v")), batch.column("vec_id").to_numpy(), k)
            score, lists = np.hstack([score, more]), np.hstack([lists, batch.column("list").to_numpy()[place]])
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, lists = np.take_along_axis(score, best, axis=1), np.take_along_axis(lists, best, axis=1)
        n, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(score[n, at]), pa.array(lists[n, at])], names=["n", "score", "list"])

    order = Window.partitionBy("n").orderBy(F.desc("score"), "list")
    best = map_arrow(indexed, nearest, "n int, score double, list int").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    miss = misses(asked, ids)
    needed: dict[int, list[float]] = {}
    for r in best.select("n", "list").collect():  # k for each sampled query
        needed.setdefault(r["n"], []).append(miss[r["n"], r["list"]])
    return probes_needed([np.array(x) for x in needed.values()]) if needed else 0.0


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by query_every.

    Vectors that aren't usable, rows with a null id, and vectors of another length than the commonest
    take no part. Of several rows with one id each is a candidate, and each of its vectors a query of its own, so such an id has several lists of
    neighbours; equal rows ask once. A query leaves out its own id.
    """
    spark = vectors.sparkSession
    inner = "double" if vectors.schema[vector_col].dataType.elementType.typeName() == "double" else "float"
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{inner}>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes["dim"], sizes["count"]
    good = good.filter(F.size("v") == dim)
    sample_ids, sample = columns(bounded_sample(good, ["vec_id"], SAMPLE), dim)
    centre = fit_centroids(sample, max(1, min(MOST_LISTS, round(math.sqrt(total)))))

    def into_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            near = nearest_list(v, centre)
            away = ((v - centre[near]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "list", "away"])

    indexed = write_table(map_arrow(good, into_lists, f"vec_id long, v array<{inner}>, list int, away double"), "ann-lists")
    counts, spread = np.zeros(len(centre), np.int64), np.zeros(len(centre))
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("away").alias("away")).collect():  # MOST_LISTS rows at most
        counts[r["list"]], spread[r["list"]] = r["n"], math.sqrt(r["away"])
    # a list of copies has no spread, but its centroid is rounded
    spread = np.maximum(spread, 1e-6 * max(spread.max(), math.sqrt((centre * centre).sum(axis=1).max())))
    first, parts = make_bins(counts)
    queries = good.filter(F.col("vec_id") % query_every == 0)
    step = -(-sample.nbytes // MOST_BYTES)  # what tasks get is bounded in bytes too
    seen_ids, seen = sample_ids[::step], sample[::step].astype(np.float64 if inner == "double" else np.float32)
    margin = measured_margin(queries, indexed, lambda v, i: margins(v, thresholds(v, i, seen.astype(np.float64), seen_ids, k), centre, spread, counts), k, dim)

    def into_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.astype(np.float64)
        for batch in batches:
            v, own_id = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            least = thresholds(v, own_id, known, seen_ids, k)
            miss = margins(v, least, centre, spread, counts)
            order = np.argsort(miss, axis=1, kind="stable")
            # further lists until the probed ones hold k vectors besides the query's own id
            few = np.cumsum(counts[order], axis=1) < k + batch.column("own").to_numpy()[:, None]
            best = [row[:n].astype(np.int32) for row, n in zip(order, np.maximum((miss <= margin).sum(axis=1), few.sum(axis=1) + 1))]
            bins = [np.unique(np.concatenate([np.arange(first[i], first[i] + parts[i]) for i in row])) for row in best]
            arrays = [batch.column("vec_id"), batch.column("v"), pa.array(least), pa.array(best, pa.list_(pa.int32())), pa.array([b.astype(np.int32) for b in bins], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "least", "lists", "bins"])

    asked = queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("rows"))
    one_each = asked.withColumn("own", F.sum("rows").over(Window.partitionBy("vec_id")))
    probed = write_table(map_arrow(one_each, into_probes, f"vec_id long, v array<{inner}>, least double, lists array<int>, bins array<int>"), "ann-queries")
    # a bin is copied once for each QUERY_BLOCK queries that probe it, and not at all if none does
    per_bin = probed.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("asks"))
    base, many = (F.element_at(F.array(*[F.lit(int(v)) for v in part]), F.col("list") + 1) for part in (first, parts))
    blocks = indexed.withColumn("bin", (base + F.pmod(F.xxhash64("vec_id", F.lit(1)), many)).cast("int")).join(per_bin, "bin")
    blocks = blocks.select("bin", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "vec_id", "v", "list")
    asking = probed.select(F.explode("bins").alias("bin"), "vec_id", F.xxhash64("v").alias("which"), "v", "least", "lists").join(per_bin, "bin")
    asking = asking.select("bin", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("asks")).cast("int").alias("ask"), "vec_id", "which", "v", "least", "lists")
    lists = len(centre)

    def scan_block(left: pa.Table, right: pa.Table) -> pa.Table:
        n, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        asked_by, which = (right.column(c).to_numpy() for c in ("vec_id", "which"))
        if left.num_rows and right.num_rows:
            probe = right.column("lists").combine_chunks()
            mask = np.zeros((right.num_rows, lists), bool)
            mask[np.repeat(np.arange(right.num_rows), np.diff(probe.offsets.to_numpy())), probe.flatten().to_numpy()] = True
            lv, rv = (matrix(t.column("v").combine_chunks()) for t in (left, right))
            n, vec, score = scan(rv, asked_by, mask, lv, left.column("vec_id").to_numpy(), left.column("list").to_numpy(), k, right.column("least").to_numpy())
        return pa.table({"query_id": asked_by[n], "which": which[n], "vec_id": vec, "score": score})

    # bins are dealt over all tasks; each is BLOCK vectors and about QUERY_BLOCK queries
    keys = ["bin", "ask"]
    found = blocks.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(scan_block, "query_id long, which long, vec_id long, score double")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for all queries."""
    return search(embeddings)
