"""Language identification with hyperdimensional profiles.

Each letter has a pseudo-random vector of +1 and -1 made from its code point by rule. A letter and
its two neighbours are bound into a trigram vector by multiplying the letters' vectors, permuted
(rotated) by place; any character that is no letter counts as a blank, and each letter is the middle
of one trigram. A text's profile is the bundle (sum) of its trigram vectors; a language's prototype
is the sum of the unit profiles of its training texts. The prediction is the language of largest
cosine, ties to the smaller name, and the score is that cosine, at least 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from brooklog.llm.shared import bounded_sample, held_out, map_arrow

#: Length of the vectors, and the largest number of training texts taken of each language.
DIM, TRAIN_PER_LANG = 512, 5000
#: Texts are profiled together up to so many characters, which bounds memory.
CHARS_AT_ONCE, DOCS_AT_ONCE, KINDS_AT_ONCE, CELLS = 1 << 20, 256, 4096, 1 << 21
BLANK = 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """+1 and -1 of each code point: the bits of splitmix64 at (code, word)."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dim]


def profiles(texts: list[str], dim: int = DIM, edges: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The bundled vector of each text, float32 (n, dim); a row of zeros if it has no letter.

    edges: how many characters at the start and end of a single text are neighbours only, no middles.
    """
    joined = "\0" + "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    middle = np.flatnonzero(letter_table()[codes])
    middle = middle[(middle > edges[0]) & (middle < len(codes) - 1 - edges[1])]
    if not len(middle):
        return np.zeros((len(texts), dim), np.float32)
    doc = np.cumsum(codes == 0)[middle] - 1
    symbols = np.where(letter_table()[codes], codes, np.uint32(BLANK))
    used = np.flatnonzero(np.bincount(symbols, minlength=BLANK + 1))
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(len(used))
    small = place[symbols]
    n = len(used)
    grams = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
    if n**3 <= 1 << 19:
        kinds = np.flatnonzero(np.bincount(grams, minlength=n**3))
        where = np.zeros(n**3, np.int64)
        where[kinds] = np.arange(len(kinds))
        column = where[grams]
    else:
        kinds, column = np.unique(grams, return_inverse=True)
    letters = letter_vectors(used, dim)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    out = np.zeros((len(texts), dim), np.float32)
    pairs = column.astype(np.int64) * len(texts) + doc  # by trigram, then by text
    if len(kinds) * len(texts) <= CELLS:
        times = np.bincount(pairs, minlength=len(kinds) * len(texts))
        pairs = np.flatnonzero(times)
        times = times[pairs]
    else:
        pairs, times = np.unique(pairs, return_counts=True)
    cuts = np.searchsorted(pairs, np.arange(0, len(kinds) + KINDS_AT_ONCE, KINDS_AT_ONCE) * len(texts))
    for at, lo, hi in zip(range(0, len(kinds), KINDS_AT_ONCE), cuts, cuts[1:]):
        k = kinds[at : at + KINDS_AT_ONCE]
        bound = first[k // (n * n)] * second[k // n % n] * letters[k % n]
        counts = np.zeros((len(texts), len(k)), np.float32)
        counts[pairs[lo:hi] % len(texts), pairs[lo:hi] // len(texts) - at] = times[lo:hi]
        out += counts @ bound.astype(np.float32)
    return out


def _in_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of groups of at most DOCS_AT_ONCE texts and CHARS_AT_ONCE characters; a longer text is alone."""
    start, held, chars = 0, [], 0
    for i, text in enumerate(texts):
        if held and (chars + len(text or "") > CHARS_AT_ONCE or len(held) >= DOCS_AT_ONCE):
            yield start, held
            start, held, chars = i, [], 0
        held.append(text or "")
        chars += len(text or "")
    if held:
        yield start, held


def long_profile(text: str) -> np.ndarray:
    """The bundled vector (1, dim) of a text of any length, summed over pieces that see their neighbours."""
    text = text.lower()
    total = np.zeros((1, DIM))
    for at in range(0, len(text), CHARS_AT_ONCE):
        low, high = max(0, at - 1), min(len(text), at + CHARS_AT_ONCE + 1)
        total += profiles([text[low:high]], edges=(at - low, max(0, high - at - CHARS_AT_ONCE)))
    return total


def unit_profiles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for start, group in _in_groups(texts):
        if len(group[0]) > CHARS_AT_ONCE:
            x = long_profile(group[0])
        else:
            x = profiles(group).astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield start, x / np.where(norm > 0, norm, 1)


def _sum_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language the sum of unit profiles, as integers of 2**-20, so that sums have no order."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, x in unit_profiles(batch.column("text").to_pylist()):
            for lang, row in zip(langs[start:], np.round(x * (1 << 20)).astype(np.int64)):
                sums[lang] = sums[lang] + row if lang in sums else row
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})


def learn(train: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes of the languages of train (doc_id, text, lang; null languages are left out)."""
    rows = bounded_sample(train.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), ["doc_id"], per_lang, "lang")
    parts = map_arrow(rows.select("text", "lang"), _sum_profiles, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in sums})
    proto = np.zeros((len(names), DIM))
    for r in sums:
        proto[names.index(r["lang"]), r["d"]] = r["x"]
    norm = np.sqrt((proto * proto).sum(axis=1, keepdims=True))
    return names, proto / np.where(norm > 0, norm, 1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Adds lang_pred and score to docs, whose other columns stay (own columns of those names are replaced).

    Null texts, texts without a letter, and every text when no language was learned get `und` and 0.
    """
    names, proto = model
    kept = docs.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for start, x in unit_profiles(batch.column("text").to_pylist()) if names else ():
                cos = x @ proto.T
                best = cos.argmax(axis=1)
                for i in np.flatnonzero(x.any(axis=1)):
                    pred[start + i], score[start + i] = names[best[i]], min(1.0, max(0.0, float(cos[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(kept, predict, schema)


def op3_language_id(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document, learned from those that are not held out."""
    rows = documents.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(rows.filter(~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_languages(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The pipeline's filter: lang becomes the prediction; rows that get `und`, or none of allowed, go."""
    model = learn(docs.filter(~held_out()))
    marked = identify(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    good = marked.filter(F.col("lang_pred") != "und")
    if allowed is not None:
        good = good.filter(F.col("lang_pred").isin(allowed))
    return good.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")
