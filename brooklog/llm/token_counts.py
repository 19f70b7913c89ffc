"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming
keeps, for each place, the best score of a path to it and that path's number of pieces, never the path.

The vocabulary is that of a model file (pieces with their scores). The rules are those of the
`tokenizers` library's Unigram model with byte fallback, scores added as doubles:

* the text gets one blank in front (none if it is empty), and blanks become U+2581;
* a later path to the same place replaces an earlier one only if its score is strictly larger, where
  paths come by the start of their last piece, the longest piece first;
* a character without a piece of its own may be taken as unknown, after those pieces, at the smallest
  score less 10; it counts one for each of its UTF-8 bytes.

Where no piece has U+2581 after another character (checked when the vocabulary is loaded), every path
passes the place before each blank run, so words are counted by themselves and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import map_arrow

BLANK, UNKNOWN_PENALTY = "▁", 10.0
#: Words in one of the two generations that each Python worker remembers, and the longest one remembered.
REMEMBERED, LONGEST = 200_000, 48
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def load_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, without its control pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not m.is_control(i)]


class Counter:
    """Counts pieces of texts; calls return (pieces, best score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.by_word = all(BLANK not in p.lstrip(BLANK) for p, _ in vocabulary)
        self.known: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):  # at one end the longest piece comes first
            found[end].append(match)
        for end, matches in enumerate(found, 1):
            top, pieces, single = None, 0, False
            for length, score in matches:
                candidate = best[end - length] + score
                if top is None or candidate > top:
                    top, pieces = candidate, count[end - length] + 1
                single = single or length == 1
            if not single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, pieces = candidate, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[-1], best[-1]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = BLANK + text.replace(" ", BLANK)
        if not self.by_word:
            return self.search(marked)
        pieces, score, known = 0, 0.0, self.known
        for unit in _UNIT.findall(marked):
            got = known.get(unit)
            if got is None:
                got = self.older.get(unit) or self.search(unit)
                if len(unit) <= LONGEST:
                    if len(known) >= REMEMBERED:  # the older words that are met again move up
                        self.older, self.known = known, {}
                        known = self.known
                    known[unit] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, best_score) of every row; a null or empty text has 0 tokens and score 0."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for batch in batches:
            found = [counter(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "n_tokens", "best_score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), counted, "doc_id long, n_tokens long, best_score double")


def op7_token_counts(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """Token counts of every document's whole text."""
    return count_tokens(documents, load_vocabulary(model_path))
