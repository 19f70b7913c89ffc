"""Best-fit packing of tokenised documents, with exact-complement hashing.

Texts are tokenised once, and cut only where a document is longer than a sequence. The plan is made
from the histogram of piece lengths alone, which has at most `capacity` entries at any corpus size:

* Exact phase. Lengths are taken from the largest down. The gap that a length leaves is looked up
  among available single lengths, then sums of two, then of three, and the combination is used as often
  as the counts allow. Each use ends at least one count, so the plan stays as small as the histogram.
* Residual phase. What has no exact complement is placed best-fit decreasing, whole counts at a time. It gets
  some exact sequences back if it lacks small pieces to fill its gaps.

Pieces of each length are then numbered without gaps by Spark, and number intervals map to sequences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import map_arrow, number_rows, write_table

CAPACITY, END_ID = 2048, 0
#: Words in one of the two generations that each Python worker remembers, and the longest word remembered.
REMEMBERED, LONGEST = 120_000, 32

#: Texts of these characters only need no Unicode normalisation, and each of the pattern's matches
#: is tokenised by itself; all other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r -~¡-ÿ]*")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: The tokenizer's split; its alternatives that share no first character may stand in any order.
_WORD = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as byte-level models write their UTF-8 bytes: printable ones stand for themselves, the others are moved to U+0100 and on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return {c: "".join(letter[b] for b in chr(c).encode("utf-8")) for c in range(256)}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, read on the driver; executors get it with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; equal to the tokenizer's own result for any text.

    Words are remembered in two generations: when the younger is full it becomes the older one, and words
    of the older one that are met again move up. So memory is bounded and common words stay.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one match of the split, straight from the merges."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(word.translate(self.letters))])

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or _SPECIAL.search(text):
            return self.whole(text)
        words, known = _WORD.findall(text.lower()), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
            known = self.known
        older, long = self.older, []
        for w in words:
            if w not in known:
                known[w] = older.get(w) or self.word(w)
                if len(w) > LONGEST:
                    long.append(w)
        out = b"".join([known[w] for w in words])
        for w in long:
            known.pop(w, None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """This process's encoder of a model, made once."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def tokenize(docs: DataFrame, model: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then END_ID (a null or empty text is END_ID alone). Only documents longer
    than capacity are cut, into pieces of capacity ids and a last one that may be shorter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text or "") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pieces, schema)


Plan = list[tuple[tuple[int, ...], int]]


def make_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(lengths of one sequence, how many such sequences) for all counted lengths from 1 to capacity.

    Exact combinations use up small pieces that the residual phase needs for its gaps. So while the plan has more
    sequences than its tokens need, 1, 2, 4, 8, ... of the exact sequences, those of three pieces and more with
    the smallest piece first, are given back to the residual phase; the plan of the fewest sequences, of
    equals the one that gave back the fewest, is the result.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    least = -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
    exact = sorted(_exact(left, capacity), key=lambda x: (len(x[0]) > 2, -min(x[0])))
    best, back = exact + _best_fit(left, capacity), 1
    while sequences_of(best) > least and exact:
        due = back
        while due and exact:
            parts, n = exact.pop()
            used = min(n, due)
            for k in parts:
                left[k] += used
            if n > used:
                exact.append((parts, n - used))
            due -= used
        best = min(best, exact + _best_fit(left, capacity), key=sequences_of)
        back *= 2
    return best


def sequences_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def _exact(left: np.ndarray, capacity: int) -> Plan:
    """Sequences that are full: by one complement of each length, then by two, then by three; takes them off the counts."""
    plan: Plan = []

    def fits(parts: tuple[int, ...]) -> int:
        return min(int(left[k]) // m for k, m in Counter(parts).items())

    def pairs(total: int) -> list[tuple[int, int]]:
        small = np.arange(1, total // 2 + 1)
        good = small[(left[small] > 0) & (left[total - small] > 0)]
        return [(total - int(a), int(a)) for a in good]

    def single(first: int, gap: int) -> tuple[int, ...] | None:
        return (first, gap) if gap and fits((first, gap)) else None

    def double(first: int, gap: int) -> tuple[int, ...] | None:
        return next(((first, *two) for two in pairs(gap) if fits((first, *two))), None)

    def triple(first: int, gap: int) -> tuple[int, ...] | None:
        there = (left > 0).astype(np.float64)
        two_sums = np.convolve(there, there)[: capacity + 1] > 0.5
        thirds = np.arange(gap - 2, 0, -1)
        for b in thirds[(left[thirds] > 0) & two_sums[gap - thirds]] if gap > 2 else ():
            for two in pairs(gap - int(b)):
                if fits((first, int(b), *two)):
                    return (first, int(b), *two)
        return None

    def take(parts: tuple[int, ...]) -> None:
        n = fits(parts)
        plan.append((parts, n))
        for k in parts:
            left[k] -= n

    if left[capacity]:
        take((capacity,))
    for complement in (single, double, triple):
        for first in range(capacity - 1, 0, -1):
            while left[first] and (parts := complement(first, capacity - first)):
                take(parts)
    return plan


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """The counted lengths, longest first, whole counts at a time, each into the smallest gap that holds it."""
    open_bins: dict[int, Plan] = {}  # by gap

    def put(parts: tuple[int, ...], n: int) -> None:
        if n:
            open_bins.setdefault(capacity - sum(parts), []).append((parts, n))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                put((length,) * each, n // each)
                put((length,) * (n % each), 1 if n % each else 0)
                n = 0
                continue
            parts, copies = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(n, copies)
            put(parts, copies - used)
            put((*parts, length), used)
            n -= used
    return [x for bins in open_bins.values() for x in bins]


def intervals(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first numbers of the intervals, the sequence of each first number, and the offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: Counter[int] = Counter()
    sequence = 0
    for parts, n in plan:
        offset = 0
        for length in parts:
            rows.setdefault(length, []).append((next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and more), read twice."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(intervals(make_plan(counts, capacity)))
    numbered = number_rows(pieces, "length", ["doc_id", "piece", "ids_crc32"], "_number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for some in np.split(order, cuts) if len(order) else ():
                first, base, place_in = table.value[int(length[some[0]])]
                at = np.searchsorted(first, rank[some], side="right") - 1
                sequence[some], offset[some] = base[at] + rank[some] - first[at], place_in[at]
            kept = [c for c in batch.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return map_arrow(numbered.select(*pieces.columns, "_number"), place, ", ".join([*columns, "sequence_id long", "offset long"]), None)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, and ids where the pieces carry them; at most capacity each."""
    fields = ["offset", "length", *(["ids"] if "ids" in packed.columns else [])]
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", "n_tokens", *([F.flatten(F.col("p.ids")).alias("ids")] if "ids" in packed.columns else []))


def op6_packing(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """The contract's columns for every piece of every document."""
    pieces = write_table(tokenize(documents, tokenizer_json(model_path)), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
