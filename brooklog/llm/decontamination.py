"""Benchmark decontamination by template windows; DataFrame functions only.

Texts become tokens: letter runs and numbers. A token is canonicalised to a typed placeholder if it is a number,
a unit right after a number, or a name (a capitalised word after another word inside a sentence); else
it is lower-cased. Windows of WORDS tokens are joined on the hash of their templates; an item shorter than that
is one window of its own length. A first pass over all texts makes hashes only, from templates written by a few replacements
in the whole text, and keeps the ids of documents that meet any benchmark window; places, slots and the templates themselves, which must
be equal, are made for those alone. Slots, the tokens behind placeholders, must be consistent along an
alignment: each benchmark value always meets the same document value (two of them may meet one, as a new question may use
a number twice). So a re-parameterised question is
caught, while a chance template match with mixed-up values isn't. A window of placeholders alone matches only
with equal values. A document is contaminated by an item if at least COVER of the item's windows match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import MOST_BYTES, small_side, write_table

#: Tokens in a window, and share of an item's windows that must match.
WORDS, COVER = 5, 0.5

#: Fixed list of unit words, recognised after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "lb", "lbs", "oz", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "mph", "kmh", "degree", "degrees",
)
_NAME = r"([\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
_TOKEN = "\u0002?\\p{L}+|[0-9]+(?:[.,:][0-9]+)*"


def tokens(text: Column) -> Column:
    """Tokens in order; names carry the mark U+0002. Null gives none."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u0002", " ")
    marked = F.regexp_replace(F.regexp_replace(clean, _NAME, "$1\u0002$2"), _NAME, "$1\u0002$2")  # twice: matches can't overlap
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


_UNIT_AFTER = "(\u0003[^\\p{L}\u0002\u0003]*)(?:" + "|".join(UNITS) + ")(?!\\p{L})"


def template(text: Column) -> Column:
    """Canonical tokens by replacements in the whole text: U+0002 for a name, U+0003 for a number, U+0004 for a unit, else the word in lower case."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u0002\u0003\u0004", "   ")
    marked = F.regexp_replace(F.regexp_replace(clean, _NAME, "$1\u0002$2"), _NAME, "$1\u0002$2")
    slots = F.regexp_replace(F.regexp_replace(marked, "\u0002\\p{L}+", "\u0002"), "[0-9]+(?:[.,:][0-9]+)*", "\u0003")
    return F.regexp_extract_all(F.regexp_replace(F.lower(slots), _UNIT_AFTER, "$1\u0004"), F.lit("[\u0002\u0003\u0004]|\\p{L}+"), F.lit(0))


def window_hashes(c: Column, n: Column) -> Column:
    """Hashes of the windows of n canonical tokens."""
    places = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(c, i + 1, n)))


def candidates(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs (doc_id, text) whose id has a window that the benchmark has too."""
    own = benchmark.select(template(F.col("text")).alias("c")).filter(F.size("c") > 0).withColumn("n", F.least(F.size("c"), F.lit(words)))
    keys = write_table(own.select("n", F.explode(window_hashes(F.col("c"), F.col("n"))).alias("h")).distinct(), "benchmark-hashes")
    lengths = sorted(r["n"] for r in keys.select("n").distinct().collect())  # `words` rows at most
    hashes = keys.select("h").distinct()
    tokened = docs.select("doc_id", template(F.col("text")).alias("c"))
    every = tokened.select("doc_id", F.explode(F.concat(*[window_hashes(F.col("c"), F.lit(n)) for n in lengths or [words]])).alias("h"))
    met = every.join(small_side(hashes, 96), "h", "left_semi").select("doc_id").distinct()
    return docs.join(small_side(write_table(met, "benchmark-candidates"), 128), "doc_id", "left_semi")


def kind(token: Column, before: Column) -> Column:
    """n for a name, d for a number, u for a unit, null for a word."""
    number = token.rlike("^[0-9]")
    unit = F.lower(token).isin(*UNITS) & F.coalesce(before.rlike("^[0-9]"), F.lit(False))
    return F.when(token.startswith("\u0002"), "n").when(number, "d").when(unit, "u")


def with_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds w: the windows (pos, length, h, words, slots) of column text for each of the lengths; text is dropped."""
    tokened = rows.withColumn("_t", tokens(F.col("text"))).drop("text")
    kinds = F.transform("_t", lambda t, i: kind(t, F.get(F.col("_t"), i - 1)))
    parts = tokened.withColumn("_k", kinds).withColumn("_low", F.transform("_t", lambda t: F.lower(F.translate(t, "\u0002", ""))))
    parts = parts.withColumn("_c", F.transform("_k", lambda k, i: F.coalesce(F.concat(F.lit("<"), k, F.lit(">")), F.get(F.col("_low"), i))))
    parts = parts.withColumn("_s", F.when(F.exists("_k", lambda k: k.isNotNull()), F.transform("_k", lambda k, i: F.when(k.isNotNull(), F.get(F.col("_low"), i)))))

    def of(n: int) -> Column:
        def window(i: Column) -> Column:
            slots = F.filter(F.slice(F.col("_s"), i + 1, F.lit(n)), lambda s: s.isNotNull())
            own = F.slice(F.col("_c"), i + 1, F.lit(n))
            return F.struct(i.alias("pos"), F.lit(n).alias("length"), F.xxhash64(own).alias("h"), F.array_join(own, " ").alias("words"), F.coalesce(slots, F.array().cast("array<string>")).alias("slots"))

        places = F.when(F.size("_c") >= n, F.sequence(F.lit(0), F.size("_c") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, window)

    return parts.withColumn("n_tokens", F.size("_c")).withColumn("w", F.concat(*[of(n) for n in lengths])).drop("_t", "_k", "_low", "_c", "_s")


def benchmark_windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(h, bwords, item_id, bpos, length, bslots, n_windows) of items that have a token."""
    every = with_windows(benchmark.select("item_id", "text"), list(range(1, words + 1)))
    own = every.select("item_id", "n_tokens", F.explode_outer("w").alias("w")).filter(F.col("w.length") == F.least("n_tokens", F.lit(words)))
    return own.select(F.col("w.h").alias("h"), F.col("w.words").alias("bwords"), "item_id", F.col("w.pos").alias("bpos"), F.col("w.length").alias("length"), F.col("w.slots").alias("bslots"), (F.col("n_tokens") - F.col("w.length") + 1).alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, reparameterised) of each contaminated pair.

    Null and empty texts, and items without tokens, match nothing; so do rows with a null id. Items of one
    id count as one item each time they are repeated with the same text; documents of one id count together.
    """
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    bench = write_table(benchmark_windows(items, words), "benchmark-windows")
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())  # `words` rows at most
    if not lengths:
        none = docs.filter(F.lit(False)).select("doc_id", F.lit(None).cast("long").alias("item_id"))
        return none.selectExpr("doc_id", "item_id", "0L AS matched_windows", "0L AS item_windows", "0D AS coverage", "false AS reparameterised")
    if bench.agg(F.sum(F.octet_length("bwords") + F.octet_length(F.array_join("bslots", " ")) + 64)).first()[0] <= MOST_BYTES:
        bench = F.broadcast(bench)
    near = candidates(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), items, words)
    windows = with_windows(near, lengths).select("doc_id", F.inline_outer("w")).withColumnRenamed("length", "_length")
    matched = windows.join(bench, "h").filter((F.col("words") == F.col("bwords")) & (F.col("_length") == F.col("length"))).filter((F.size("slots") < F.col("length")) | (F.col("slots") == F.col("bslots")))
    # an alignment: the windows of a pair at one distance; windows of one document meet before any shuffle
    aligned = matched.groupBy("doc_id", "item_id", "n_windows", (F.col("pos") - F.col("bpos")).alias("shift")).agg(F.collect_set("bpos").alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("bslots", "slots")))).alias("pairs"))
    agreed = aligned.filter(F.size("pairs") == F.size(F.array_distinct(F.col("pairs.bslots"))))
    whole = agreed.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("item_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched_windows"),
        F.max(F.exists("pairs", lambda p: p["bslots"] != p["slots"])).alias("reparameterised"),
    )
    scored = whole.withColumn("coverage", F.col("matched_windows") / F.col("item_windows"))
    return scored.filter(F.col("coverage") >= cover).select("doc_id", "item_id", "matched_windows", "item_windows", "coverage", "reparameterised")


def op2_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated (document, item) pairs over the whole tables."""
    return contaminated(documents, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's filter: documents contaminated by any item go; rows without an id are known by their text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_id")).distinct()
    bad = small_side(write_table(bad, "contaminated"), 128)
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(bad, key == F.col("_id"), "left_anti")


_MARKED = "regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(2), ' '), '([\\p{L}\\p{N},;] )(\\p{Lu}\\p{Ll}+)', '\\1' || chr(2) || '\\2', 'g'), '([\\p{L}\\p{N},;] )(\\p{Lu}\\p{Ll}+)', '\\1' || chr(2) || '\\2', 'g')"
_PARTS = """
  SELECT id, row_number() OVER () AS v, list_transform(t, lambda x: lower(translate(x, chr(2), ''))) AS low,
    list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i][1] = chr(2) THEN 'n' WHEN regexp_matches(t[i], '^[0-9]') THEN 'd'
      WHEN lower(t[i]) IN ({units}) AND i > 1 AND regexp_matches(t[i - 1], '^[0-9]') THEN 'u' END) AS k
  FROM (SELECT {id} AS id, regexp_extract_all({marked}, chr(2) || '?\\p{{L}}+|[0-9]+(?:[.,:][0-9]+)*') AS t FROM (SELECT DISTINCT {id}, text FROM {table} WHERE {id} IS NOT NULL))
"""
_WINDOWED = """{name} AS (SELECT id, i, total, list(coalesce('<' || k || '>', low)) OVER w AS c, list(CASE WHEN k IS NOT NULL THEN low END) OVER w AS s
  FROM (SELECT id, v, len(k) AS total, unnest(range(1, len(k) + 1)) AS i, unnest(low) AS low, unnest(k) AS k FROM {source})
  WINDOW w AS (PARTITION BY id, v ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING))"""
_UNITS = ", ".join(f"'{u}'" for u in UNITS)

#: The same query in DuckDB's SQL: templates are compared as texts instead of hashes.
ORACLE = f"""
WITH dt AS ({_PARTS.format(id="doc_id", table="documents", marked=_MARKED, units=_UNITS)}),
bt AS ({_PARTS.format(id="item_id", table="benchmark", marked=_MARKED, units=_UNITS)}),
lens AS (SELECT DISTINCT least(len(k), {WORDS}) AS n FROM bt WHERE len(k) > 0),
{_WINDOWED.format(name="dl", source="dt", last=WORDS - 1)},
{_WINDOWED.format(name="bl", source="bt", last=WORDS - 1)},
bw AS (SELECT id AS item_id, n, i AS bpos, total - n + 1 AS item_windows, list_slice(c, 1, n) AS tpl, list_filter(list_slice(s, 1, n), lambda x: x IS NOT NULL) AS slots
  FROM bl JOIN lens ON n = least(total, {WORDS}) AND len(c) >= n),
dw AS (SELECT id AS doc_id, n, i AS pos, list_slice(c, 1, n) AS tpl, list_filter(list_slice(s, 1, n), lambda x: x IS NOT NULL) AS slots
  FROM dl JOIN lens ON len(c) >= n),
m AS (SELECT doc_id, item_id, item_windows, bpos, pos - bpos AS shift,
    list_transform(range(1, len(bw.slots) + 1), lambda j: {{'b': bw.slots[j], 'd': dw.slots[j]}}) AS pairs
  FROM dw JOIN bw ON dw.n = bw.n AND dw.tpl = bw.tpl
  WHERE len(dw.slots) < dw.n OR dw.slots = bw.slots),
a AS (SELECT doc_id, item_id, item_windows, shift, list(DISTINCT bpos) AS spots, list_distinct(flatten(list(pairs))) AS pairs
  FROM m GROUP BY doc_id, item_id, item_windows, shift),
w AS (SELECT doc_id, item_id, max(item_windows) AS item_windows, len(list_distinct(flatten(list(spots)))) AS matched_windows,
    bool_or(len(list_filter(pairs, lambda p: p.b <> p.d)) > 0) AS reparameterised
  FROM a WHERE len(pairs) = len(list_distinct(list_transform(pairs, lambda p: p.b))) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(matched_windows AS BIGINT) AS matched_windows, CAST(item_windows AS BIGINT) AS item_windows,
  CAST(matched_windows AS DOUBLE) / item_windows AS coverage, reparameterised
FROM w WHERE CAST(matched_windows AS DOUBLE) / item_windows >= {COVER}
"""
