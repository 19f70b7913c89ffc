"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, bit set where it is set in over half of the XXH64 hashes of word shingles.
Search, for links at 2 or fewer differing bits, runs over distinct fingerprints:

* Upper nodes. A node is a masked bit pattern that all fingerprints below it share. The top level has
  the six masks that keep two of four 16-bit blocks: two fingerprints with at most two differing bits
  agree on two whole blocks, so they meet below a node of one of these masks with no difference so
  far. Spark groups by (mask, pattern); a node with more than GROUP_MOST fingerprints is factored once
  more, by the three thirds of its 32 open bits, of which one must agree in whole unless both
  differing bits lie in two other thirds, so still no link is lost. Such a node has at most 22 open bits.
* Inside a node, fingerprints are sorted by Gray rank, and runs of RUN neighbours get the mask of the
  bits they share; runs of runs likewise. The search descends, adding the differing bits that each
  level's mask newly covers, and drops a whole run once the sum is above 2.

Each node gives a spanning set of its links (every member to the smallest of its local component), so
output is linear in its members while components stay exact. Components over all nodes come from
alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import join_spread, map_arrow, small_side, write_table

WORDS, MOST_BITS = 3, 2
#: Distinct fingerprints below one top node before it is factored further, and run length of the index.
GROUP_MOST, RUN = 4096, 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included; none where there is no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and \x20 \x09-\x0D only
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(_hash, shingles), dtype=np.uint64)


def folded(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of the hashes: the bits set in over half of them; 0 where there is none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        ones += np.unpackbits(hashes[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of the text's shingles, repeats included; 0 where there is no word."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), hashed, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence (prefix xor of its bits)."""
    rank = codes.astype(np.uint64).copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _nodes(masks: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents of runs of RUN neighbours: the bits that all of a run fix alike, and their values."""
    starts = np.arange(0, len(masks), RUN)
    ones, zeros = np.bitwise_and.reduceat(patterns & masks, starts), np.bitwise_and.reduceat(~patterns & masks, starts)
    return ones | zeros, ones


def linked_pairs(fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i before j in Gray order, of distinct fps that differ in at most `most` bits."""
    full = np.full(len(fps), ~np.uint64(0))
    levels = [(full, fps)]
    while len(levels[-1][0]) > RUN:
        levels.append(_nodes(*levels[-1]))
    out_i, out_j = [], []
    step = max(1, (1 << 21) // max(1, len(levels[-1][0]) * RUN))
    for at in range(0, len(fps), step):
        q = np.arange(at, min(at + step, len(fps)))
        query = np.repeat(q, len(levels[-1][0]))
        node = np.tile(np.arange(len(levels[-1][0])), len(q))
        seen, masks = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[depth]
            seen = seen + np.bitwise_count((fps[query] ^ pattern[node]) & mask[node] & ~masks)
            good = (seen <= most) & ((node + 1) * RUN**depth > query + 1)
            query, node, seen, masks = query[good], node[good], seen[good], mask[node[good]]
            if depth:
                below = len(levels[depth - 1][0])
                child = (node[:, None] * RUN + np.arange(RUN)).ravel()
                query, seen, masks = np.repeat(query, RUN), np.repeat(seen, RUN), np.repeat(masks, RUN)
                real = child < below
                query, node, seen, masks = query[real], child[real], seen[real], masks[real]
        keep = node > query
        out_i.append(query[keep])
        out_j.append(node[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def local_roots(reps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each member the smallest representative of its component under the pairs (i, j)."""
    root = reps.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, part, fp, rep) sorted by node: the spanning links (u, v), u > v, of each node."""
    held: list[np.ndarray] = []

    def solve(fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(gray_rank(fps))
        fps, reps = fps[order], reps[order]
        i, j = linked_pairs(fps)
        roots = local_roots(reps, i, j)
        return reps[roots < reps], roots[roots < reps]

    def run(table: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
        node, part, fps, reps = table
        cut = np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate(([0], cut))
        ends = np.concatenate((cut, [len(node)]))
        rest = [x[len(node) if last else starts[-1] :] for x in table]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        many = ends - starts > 1
        found = [solve(fps[a:b].view(np.uint64), reps[a:b]) for a, b in zip(starts[many], ends[many])]
        if not found:
            return rest, None
        u, v = (np.concatenate(x) for x in zip(*found))
        return rest, pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if not len(now[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        held, out = run(held, False)
        if out is not None and out.num_rows:
            yield out
    if held and len(held[0]):
        _, out = run(held, True)
        if out is not None and out.num_rows:
            yield out


def _masks(places: list[list[int]]) -> list[int]:
    """Signed masks with the given 16-bit blocks set."""
    return [int(np.array(sum(0xFFFF << (16 * b) for b in blocks), np.uint64).astype(np.int64)) for blocks in places]


PAIRS = [[a, b] for a in range(4) for b in range(a + 1, 4)]


def _thirds(blocks: list[int]) -> list[int]:
    """The bits of the two blocks not listed, in three parts of 11, 11 and 10, as signed masks."""
    bits = [16 * b + k for b in range(4) if b not in blocks for k in range(16)]
    return [int(np.array(sum(1 << x for x in part), np.uint64).astype(np.int64)) for part in (bits[:11], bits[11:22], bits[22:])]


def links(nodes: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """Spanning links (u, v), u > v, among nodes (fp distinct, rep distinct) within 2 differing bits."""
    tops = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("node")) for k, m in enumerate(_masks(PAIRS))])
    top = nodes.select("fp", "rep", F.explode(tops).alias("t")).select(F.col("t.k").alias("k"), F.col("t.node").alias("node"), "fp", "rep")
    sizes = top.groupBy("k", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = write_table(sizes, "simhash-nodes")
    grouped = top.join(sizes, ["k", "node"])  # a node with one fingerprint links nothing
    small = grouped.filter(F.col("n") <= group_most).select((F.col("k") * 4).alias("part"), "node", "fp", "rep")
    work = small
    if sizes.filter(F.col("n") > group_most).limit(1).count():
        thirds = F.array(*[F.array(*[F.lit(m) for m in _thirds(p)]) for p in PAIRS])
        split = grouped.filter(F.col("n") > group_most).withColumn("m", F.element_at(thirds, F.col("k") + 1))
        parts = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.col("node").bitwiseOR(F.col("fp").bitwiseAND(F.col("m")[i])).alias("node")) for i in range(3)])
        split = split.select("k", "fp", "rep", F.explode(parts).alias("t"))
        work = small.unionByName(split.select((F.col("k") * 4 + F.col("t.i")).alias("part"), F.col("t.node").alias("node"), "fp", "rep"))
    dealt = work.repartition("part", "node").sortWithinPartitions("node", "part")
    return map_arrow(dealt.select("node", F.col("part").cast("long").alias("part"), "fp", "rep"), _search, "u long, v long", None).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (u, v): root is the smallest node it can reach.

    Alternating large-star and small-star steps until no edge changes; each step is one written table.
    """

    def mark(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = write_table(e, "simhash-edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        joined = around.join(least, F.col("u") == F.col("c"))
        if large:
            return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        both = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        return both.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()

    edges, now = mark(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    while now[0]:
        edges, after = mark(star(star(edges, True), False))
        if after == now:
            break
        now = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long, component_id) of every row.

    Rows with equal fingerprints are linked (no words: fingerprint 0, a link like any other). A
    component's id is its smallest doc_id; null ids keep their row, link like others, and never name a component that
    has another id. Repeated rows come back repeated.
    """
    hashed = write_table(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = write_table(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    # nodes are named by their fingerprints, so one with null ids only links others like any
    rooted = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    roots = nodes.join(rooted, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_root"), "rep")
    least = roots.groupBy(F.col("_root").alias("_r")).agg(F.min("rep").alias("component_id"))
    named = roots.join(least, F.col("_root") == F.col("_r")).select(F.col("_fp").alias("fp"), "component_id")
    return join_spread(hashed, named, "fp", nodes).select("doc_id", "fp", "component_id")


def op9_simhash(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The pipeline's near-duplicates: words in a shingle, least Jaccard similarity, and the bands of minima that make candidates.
STAGE_WORDS, SIMILARITY, BANDS, BAND = 5, 0.8, 32, 5
#: Members of a candidate component that one task compares, and sets of a task compared with as many others.
VERIFY_BLOCK = 512


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; empty where there is no word."""
    return np.unique(shingle_hashes(text, words))


def set_name(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles; texts of one name are copies."""
    return int(np.uint64(_hash(hashes.tobytes())).astype(np.int64))


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TURNS, _MIX = _odd(BANDS * BAND), _odd(BANDS * BAND)[::-1].reshape(BANDS, BAND)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed keys of a set of shingles, each of the BAND smallest values under that many orders; none where it is empty.

    A band's key is shared with chance similarity ** BAND, so two sets of similarity 0.8 share none with chance 3e-6.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _TURNS).min(axis=0), out=least)
    mixed = ((least ^ (least >> np.uint64(29))).reshape(BANDS, BAND) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def verified_links(sets: list[np.ndarray], similarity: float = SIMILARITY, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links (i, j) of the components of sets with at least this exact Jaccard similarity. Empty sets are equal.

    With asks, only links that have a set of asks at one end count, and the others are never compared with each other.
    """
    sizes = np.array([len(x) for x in sets])
    full = np.flatnonzero(sizes)
    links = [(int(i), int(j)) for i, j in zip(*[np.flatnonzero(sizes == 0)[k:] for k in (0, 1)])]
    if len(full) < 2:
        return links
    n = sizes[full]
    values, element = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
    begins = np.concatenate(([0], np.cumsum(n)))
    has = np.zeros(len(values), np.int64)
    asking = np.ones(len(full), bool) if asks is None else asks[full]
    left, others = asking.copy(), ~asking
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        wave = [first]
        while wave and (left.any() or others.any()):
            at = wave.pop()
            mine = element[begins[at] : begins[at + 1]]
            has[mine] = 1
            common = np.add.reduceat(has[element], begins[:-1])
            has[mine] = 0
            near = np.flatnonzero((left | others) & (common / (n[at] + n - common) >= similarity))
            wave.extend(near[left[near]].tolist())
            left[near] = False
            links.extend((int(full[at]), int(full[k])) for k in near)
    return links


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that join all names (name distinct, fp, bands) that may be similar: fingerprints within MOST_BITS by the
    Gray-order index, and names that share a band's key. Each name is tied to the smallest one of its fingerprint or key,
    and where these are several, to the smallest of them, to which the others are tied."""
    fps = write_table(nodes.groupBy("fp").agg(F.min("name").alias("rep")), "similar-fps")
    own = nodes.select("name", "fp").join(fps.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select(F.col("name").alias("u"), F.col("rep").alias("v"))
    keys = nodes.select("name", F.explode("bands").alias("key"))
    first = keys.groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("most")).filter("least < most").select(F.col("key").alias("_key"), "least")
    shared = small_side(write_table(first, "similar-keys"), 128)
    meet = keys.join(shared, F.col("key") == F.col("_key")).select(F.col("name").alias("u"), F.col("least").alias("v"))
    ties = links(fps).unionByName(own).unionByName(meet).filter(F.col("u") != F.col("v"))
    ends = ties.groupBy("u").agg(F.collect_set("v").alias("vs"))  # one for each band, fingerprint and top node at most
    both = ends.select(F.explode(F.concat(F.array("u"), "vs")).alias("u"), F.array_min("vs").alias("v"))
    return both.filter(F.col("u") != F.col("v")).distinct()


def _verify(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(u, v), u > v: for rows (keys, name, hashes, asks) with equal keys, each name and the smallest one of its component there."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}

        def solved() -> pa.RecordBatch:
            names, asks = np.array(list(sets), np.int64), np.array([a for _, a in sets.values()])
            found = np.array(verified_links([x for x, _ in sets.values()], similarity, None if asks.all() else asks), np.int64).reshape(-1, 2)
            roots = local_roots(names, found[:, 0], found[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(names[roots < names]), pa.array(roots[roots < names])], names=["u", "v"])

        for batch in batches:
            for *at, name, hashes, asks in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if len(sets) > 1:
                        yield solved()
                    key, sets = at, {}
                sets[name] = (np.frombuffer(hashes, np.uint64), asks or (name in sets and sets[name][1]))
        if len(sets) > 1:
            yield solved()

    dealt = rows.select(*keys, "name", "hashes", "asks").repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(dealt, solve, "u long, v long")


def _blocks(of: str = "_n") -> Column:
    return F.ceil(F.col(of) / VERIFY_BLOCK).cast("int")


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("name"), F.col(blocks)).cast("int")


def _renamed(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """df with its column's values replaced as to (u, v) says, where it has them."""
    new = to.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return df.join(new, F.col(column) == F.col("_u"), "left").withColumn(column, F.coalesce("_v", column)).drop("_u", "_v")


def _large_classes(big: DataFrame, similarity: float) -> DataFrame:
    """(u, v): each name of large candidate components and the smallest one of its exact component; big: (root, name, hashes, n members of the root).

    First the blocks by themselves, then the smallest members of what these found, by pairs of blocks. Sets that are one component
    by then need no comparison with each other, so at last only the sets outside a root's largest one are compared with all. A
    group of near copies, which is one component early, costs a few passes; every task holds two blocks.
    """
    rooted = lambda links: components(links).select(F.col("node").alias("u"), F.col("root").alias("v"))
    inside = big.withColumn("_b", _blocks("n")).select("root", _own("_b").alias("a"), "name", "hashes", F.lit(True).alias("asks"))
    found = write_table(_verify(inside, ["root", "a"], similarity), "similar-inside")
    classed = _renamed(big.withColumn("class", F.col("name")), "class", found)
    heads = classed.filter(F.col("name") == F.col("class"))
    sizes = heads.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    heads = heads.join(sizes, F.col("root") == F.col("_root")).withColumn("_b", _blocks()).withColumn("_own", _own("_b"))
    heads = heads.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select("root", F.least("_own", "_o").alias("a"), F.greatest("_own", "_o").alias("b"), "name", "hashes", F.lit(True).alias("asks"))
    classed = write_table(_renamed(classed, "class", rooted(_verify(heads, ["root", "a", "b"], similarity))), "similar-classes")
    totals = classed.groupBy("root", "class").agg(F.count(F.lit(1)).alias("_c"))
    most = totals.groupBy(F.col("root").alias("_root")).agg(F.max_by("class", F.struct("_c", "class")).alias("_main"), F.sum("_c").alias("_n"), F.max("_c").alias("_top")).filter("_top < _n")
    open_ = classed.join(most, F.col("root") == F.col("_root")).withColumn("_rest", _blocks("n")).withColumn("_asks", F.ceil((F.col("_n") - F.col("_top")) / VERIFY_BLOCK).cast("int"))
    every = open_.select("root", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)).alias("a"), _own("_rest").alias("b"), "name", "hashes", F.lit(False).alias("asks"))
    asking = open_.filter(F.col("class") != F.col("_main")).select("root", _own("_asks").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_rest") - 1)).alias("b"), "name", "hashes", F.lit(True).alias("asks"))
    names = classed.select(F.col("name").alias("u"), F.col("class").alias("v"))
    last = _renamed(_renamed(_verify(every.unionByName(asking), ["root", "a", "b"], similarity), "u", names), "v", names)  # links between classes
    return _renamed(names, "v", rooted(last.distinct()))


def exact_classes(docs: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): names of candidate components and the smallest name of their component of exact similarity, for those that aren't
    their own root; members: (name, root, rep), where doc_id rep has a text of that name. Each text is read once."""
    sizes = members.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("n"))
    asked = members.join(sizes, F.col("root") == F.col("_root")).select("name", "root", F.col("rep").alias("_rep"), "n")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(asked, 160), F.col("doc_id") == F.col("_rep")).select("text", "name", "root", "n")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            right = pa.array([set_name(x) == n for x, n in zip(sets, batch.column(1).to_pylist())], pa.bool_())  # an id may have other texts
            arrays = [*batch.columns[1:], pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["name", "root", "n", "hashes"]).filter(right)

    sets = write_table(map_arrow(texts, shingled, "name long, root long, n long, hashes binary"), "similar-sets")
    found = _verify(sets.filter(F.col("n") <= VERIFY_BLOCK).withColumn("asks", F.lit(True)), ["root"], similarity)
    if members.join(sizes.filter(F.col("n") > VERIFY_BLOCK), F.col("root") == F.col("_root")).limit(1).count():
        found = found.unionByName(_large_classes(sets.filter(F.col("n") > VERIFY_BLOCK).dropDuplicates(["name"]), similarity))
    return write_table(found.filter(F.col("u") != F.col("v")).select(F.col("u").alias("node"), F.col("v").alias("root")), "similar-classes")


def _with_roots(rooted: DataFrame) -> DataFrame:
    """rooted (node, root), which has no row of a root itself, with those rows."""
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, name, component, component_id) of every row with an id: components of documents of at least this exact Jaccard
    similarity on five-word shingles. name stands for the text's set of shingles, component is a name and component_id the smallest id of it.

    Texts with equal sets (copies) are one from the start. SimHashes within two bits, found by the Gray-order index, are
    candidates; at 0.8 two SimHashes differ in about ten bits, so sets that share a band of minima are candidates too. Inside each
    component of candidates the sets themselves are compared, which alone decides.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([f(x) for x in sets], kind) for f, kind in ((set_name, pa.int64()), (folded, pa.int64()), (band_keys, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "name", "fp", "bands"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    wide = write_table(map_arrow(known, hashed, "doc_id long, name long, fp long, bands array<long>"), "similar-hashes")
    nodes = write_table(wide.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "similar-distinct")
    loose = write_table(_with_roots(components(candidate_links(nodes))), "similar-loose")
    members = write_table(nodes.select("name", "rep").join(small_side(loose, 128), F.col("name") == F.col("node")).select("name", "root", "rep"), "similar-candidates")
    rooted = _with_roots(exact_classes(docs, members, similarity))
    reps = nodes.select(F.col("name").alias("_n"), "rep")
    least = rooted.join(reps, F.col("node") == F.col("_n")).groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("least"))
    linked = rooted.join(least, F.col("root") == F.col("_root")).select("node", "root", "least")
    named = nodes.select("name", "rep").join(linked, F.col("name") == F.col("node"), "left")
    named = named.select("name", F.coalesce("root", "name").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    return join_spread(wide.select("doc_id", "name"), named, "name", nodes).select("doc_id", "name", "component", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's filter: of each component of similar documents the row with the smallest doc_id stays; rows with a null id stay.

    The rows to go are the smaller side of the join. Only where an id comes more than once are rows told apart by their
    sets of shingles too: of each component the row of the smallest id and name stays.
    """
    found = write_table(similar_documents(docs), "simhash-components")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    if not found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id"))
        return rows.join(small_side(gone, 96), F.col("doc_id") == F.col("_id"), "left_anti")
    # two components may have one smallest id, so a component is known by its own name
    stay = found.groupBy("component").agg(F.min(F.struct("doc_id", "name")).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.name").alias("_n"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([set_name(shingle_set(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "_name"])

    told = map_arrow(rows.filter(F.col("doc_id").isNotNull()), named, ", ".join([*fields, "_name long"]))
    kept = told.join(stay, (F.col("doc_id") == F.col("_id")) & (F.col("_name") == F.col("_n")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_name"]).drop("_name").unionByName(rows.filter(F.col("doc_id").isNull()))
