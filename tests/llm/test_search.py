"""Decontamination, nearest neighbours, SimHash, toxicity, and the pipeline."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brooklog.llm import ann, simhash
from brooklog.llm import decontamination as D
from brooklog.llm import toxicity as T

DOCS = "doc_id long, text string"
ITEM = "How many apples does Anna Smith have after she buys 12 kg of fruit from the old market near Paris today"


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")).withColumn("w", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("clash"))
    return sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in D.op2_decontamination(d, b).collect())


def test_leaks(spark):
    other = ITEM.replace("Anna Smith", "Otto Maier").replace("12 kg", "40 lb").replace("Paris", "Rome")
    mixed = "He sold 3 m and 5 m and 3 m and 5 m of rope to the man"
    docs = [(1, "intro words. " + ITEM + " and more"), (2, "Well, " + other), (3, "nothing of that kind here at all"), (4, None), (5, ""), (6, ITEM.upper()), (7, mixed.replace("3", "8", 1)), (8, mixed.replace("3", "8")), (None, ITEM), (1, "repeated id")]
    got = pairs(spark, docs, [(10, ITEM), (11, mixed), (12, None), (13, ""), (14, "!!!")])
    assert (1, 10, False) in got and (2, 10, True) in got and (8, 11, True) in got
    assert not [p for p in got if p[0] in (3, 4, 5, 7)]


def test_both_templates_agree(spark):
    texts = [ITEM, "He met Anna McDonald, 12 KM from 3.5 kgs and 4 kg; İstanbul ΣΑΣ x2y 7mm 8 Mm9 mmm", "a\u0002b\u00033 4\u0004", "In Rome Bob 5 5 m m", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS)
    a = {r["doc_id"]: [{"\u0002": "<n>", "\u0003": "<d>", "\u0004": "<u>"}.get(x, x) for x in r["c"]] for r in d.select("doc_id", D.template(F.col("text")).alias("c")).collect()}
    b = {r["doc_id"]: [w["words"] for w in r["w"]] for r in D.with_windows(d, [1]).collect()}
    assert a[0] == b[0] and a[3] == b[3] and a[4] == b[4] == [] and a[5] == b[5] == []
    assert [x for x in a[1] if "i̇" not in x and x not in ("i", "stanbul")] == [x for x in b[1] if "i̇" not in x]
    assert a[2] == b[2]


def test_rows_without_an_id_are_decontaminated(spark):
    rows = [(None, "intro words. " + ITEM, "xx", "s", 0), (None, "clean text here", "xx", "s", 0), (1, ITEM, "xx", "s", 0), (2, None, None, None, None)]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = D.drop_contaminated(spark.createDataFrame(rows, ROW), bench).collect()
    assert sorted((r["text"] or "") for r in got) == ["", "clean text here"]


def test_short_items_and_bare_numbers(spark):
    got = pairs(spark, [(1, "say hello world now"), (2, "5 6 7 8 9 10"), (3, "1 2 3 4 5 6")], [(1, "hello world"), (2, "1 2 3 4 5 6")])
    assert got == [(1, 1, False), (3, 2, False)]


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, ITEM)]) == [] and pairs(spark, [(1, ITEM)], []) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are elsewhere")
def test_decontamination_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(tuple(r) for r in con.execute(D.ORACLE).fetchall())
    cols = ["doc_id", "item_id", "matched_windows", "item_windows", "coverage", "reparameterised"]
    got = sorted(tuple(r[c] for c in cols) for r in D.op2_decontamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect())
    assert got == want


def test_no_python_in_the_decontamination_plan(spark):
    df = D.op2_decontamination(spark.createDataFrame([(1, ITEM)], DOCS), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]


def brute_nearest(ids, v, q, k):
    score = v @ v[q]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 24)).astype(np.float32)
    v[600:1100] = v[600]  # a third are one vector
    ids = np.arange(1500)
    rows = [(int(i), v[i].tolist()) for i in ids]
    odd = [(9000, None), (9020, [0.0] * 24), (9040, [float("nan")] + [1.0] * 23), (9060, [None] + [1.0] * 23), (9080, [1.0, 2.0]), (None, [1.0] * 24), (9100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.op8_ann(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 1500, 20))
    hit = total = 0
    for q in got:
        want = brute_nearest(ids, v.astype(np.float64), q, 20)
        assert sorted(got[q]) == list(range(1, 21))
        mine = [got[q][r] for r in range(1, 21)]
        assert all(abs(s - float(v[q].astype(np.float64) @ v[i].astype(np.float64))) < 1e-9 for i, s in mine)
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        if 600 <= q < 1100:
            assert [i for i, _ in mine] == [i for i in range(600, 622) if i != q][:20]
        hit += len({i for i, _ in want} & {i for i, _ in mine})
        total += 20
    assert hit / total >= 0.9


def test_repeated_ids_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.op8_ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(20, 1, 1, 2.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    got = ann.op8_ann(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], kind)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.op8_ann(spark.createDataFrame([], kind)).count() == 0
    assert ann.op8_ann(spark.createDataFrame([(0, [1.0])], kind)).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            found += [word] if word else []
            word = ""
        else:
            word += c
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["Aa", "bé", "cc", "dd x", "e"]) + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 200))) for _ in range(40)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "\u001cx y z"] + base
    for t in base:
        for _ in range(3):
            w = t.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}
    assert simhash.op9_simhash(docs.limit(0)).count() == 0
    twice = simhash.op9_simhash(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(texts) and {(r["doc_id"], r["component_id"]) for r in twice} == {(i, comp[i]) for i in comp}


def test_null_ids_link_like_others(spark, monkeypatch):
    texts = {1: 0, None: 3, 2: 15, 4: 0x7F << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(list(texts.items()), "doc_id long, fp long"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(None).collect()}
    assert got == {1: 1, None: 1, 2: 1, 4: 4}  # 0, 3 and 15 are a chain through the null id


def test_links_of_clustered_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    near = np.full(700, rng.integers(0, 2**63), np.uint64)
    for b in rng.integers(0, 64, (5, 700)):
        near ^= np.left_shift(np.uint64(1), b.astype(np.uint64))
    fps = np.unique(np.concatenate([near, rng.integers(0, 2**63, 300).astype(np.uint64)]))
    want = brute_components({i: int(f) for i, f in enumerate(fps)})
    i, j = simhash.linked_pairs(fps[np.argsort(simhash.gray_rank(fps))])
    order = fps[np.argsort(simhash.gray_rank(fps))]
    brute = {(a, b) for a in range(len(order)) for b in range(a + 1, len(order)) if (int(order[a]) ^ int(order[b])).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == brute
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), n) for n, f in enumerate(fps)], "fp long, rep long")
    for most in (4096, 8):  # with 8, large nodes are factored by thirds
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, most)).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(n + 1, n) for n in range(200)], "u long, v long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_block_max_search_is_exact():
    rnd = random.Random(5)
    unit = lambda x: [(t, w / sum(v * v for _, v in x) ** 0.5) for t, w in x]
    vectors = [unit([(t, rnd.choice([1.0, 1.7])) for t in sorted(rnd.sample(range(12), rnd.randrange(1, 5)))]) for _ in range(700)]
    index = T.Index(list(range(700)), [0] * 700, vectors, [1.0] * 700, 12)
    for q in vectors[:60]:
        score = sorted((-round(sum(w * dict(v).get(t, 0) for t, w in q), 12), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in score if s < 0][: T.K]
        got = [(int(index.ids[p]), c) for c, p in index.nearest(q)]
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([c for _, c in got], [c for _, c in want])


def test_isotonic():
    lows, rates = T.isotonic(np.array([0.1, 0.2, 0.2, 0.9]), np.array([1, 0, 0, 1]), np.ones(4))
    assert lows.tolist() == [0.1, 0.9] and np.allclose(rates, [1.5 / 4, 0.75])


def test_toxicity(spark):
    rnd = random.Random(2)
    plain = [f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}" for n in range(300)]
    docs, labels = [], []
    for n in range(900):
        words = [rnd.choice(plain) for _ in range(30)]
        toxic = n % 5 == 0
        if toxic:
            words[3:3] = rnd.sample(["vilex", "grubbo", "snarlky"], 2)
        docs.append((n, " ".join(words).upper() if n % 4 == 0 else " ".join(words)))
        labels.append((n, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "!!"), (None, "plain words"), (3, docs[3][1])]
    d = spark.createDataFrame(docs, DOCS).withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(9))
    lab = spark.createDataFrame(labels + [(7777, 1), (8888, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = T.op10_toxicity(d, lab).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(by[n]["predicted"] == y for n, y in labels)
    assert by[5000]["score"] == by[5001]["score"] < 0.2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert by[0]["evidence_ids"] and not by[1]["evidence_ids"]


def test_toxicity_equals_brute_force(spark):
    """The query against plain dictionaries: all terms, both labels, every example compared."""
    import math
    import zlib

    rnd = random.Random(21)
    plain = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9))) for _ in range(120)]
    docs = [(n, " ".join([rnd.choice(plain) for _ in range(25)] + (["vilex"] * rnd.randrange(1, 5) if n % 4 == 0 else []))) for n in range(160)] + [(500, None), (501, "unseenword")]
    labels = [(n, int(n % 4 == 0)) for n in range(120)]
    held = {n: zlib.crc32(str(n).encode()) % 3 == 1 for n, _ in docs}
    known = {n: y for n, y in labels if not held[n]}

    def terms(text):
        c = {}
        for w in "".join(x if x.isalpha() else " " for x in (text or "").lower()).split():
            for t in (w, "^" + w[:5]) if len(w) > 5 else (w,):
                c[t] = c.get(t, 0) + 1
        return c | {t + "*2": 1 for t, n in c.items() if n >= 2} | {t + "*4": 1 for t, n in c.items() if n >= 4}

    bags = {n: terms(t) for n, t in docs}
    space = {t for n in known for t in bags[n]}
    ones, others = sum(known.values()), len(known) - sum(known.values())

    def weight(t):
        idf = math.log((1 + len(docs)) / (1 + sum(t.split("*")[0] in b for b in bags.values()))) + 1
        a, b = (0.5 + sum(t in bags[n] for n, y in known.items() if y == label) for label in (1, 0))
        c, d = ones + 1 - a, others + 1 - b
        z = (math.log(a / c) - math.log(b / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        return idf * (0.02 + z * z / (z * z + 9))

    weights = {t: weight(t) for t in space}

    def unit(bag):
        v = {t: (1 + math.log(n)) * weights[t] for t, n in bag.items() if t in space}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {n: unit(b) for n, b in bags.items()}

    def nearest(n):
        score = ((-round(sum(x * vectors[m].get(t, 0) for t, x in vectors[n].items()), 12), m) for m in known)
        return [(m, -s) for s, m in sorted(score) if s < 0]

    def vote(near):
        w = [(c / (1 - c + 0.05), known[m]) for m, c in near[:15]]
        return sum(x * y for x, y in w) / sum(x for x, _ in w)

    lows, rates = T.isotonic(*(np.array(x, float) for x in zip(*((vote([x for x in nearest(m) if x[0] != m]), y, 1.0) for m, y in known.items()))))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.op10_toxicity(d, lab).collect()}
    assert set(got) == set(bags)
    for n in bags:
        near = nearest(n)
        want = rates[max(0, np.searchsorted(lows, vote(near) + 1e-9, side="right") - 1)] if near else rates[0]
        assert abs(got[n]["score"] - want) < 1e-6, n
        assert got[n]["neighbour_ids"] == [m for m, _ in near[:3]] and got[n]["evidence_ids"] == [m for m, _ in near[:15] if known[m]][:3]


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b")], DOCS)
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.op10_toxicity(d, lab).first()["predicted"] == 0
    assert T.op10_toxicity(d.limit(0), lab).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rnd = random.Random(1)
    text = lambda k: " ".join("".join(rnd.choice(k) for _ in range(6)) for _ in range(40))
    kinds = {"xx": "aeioukl", "yy": "szrtnpé"}
    rows = [(n, text(kinds[lang]), lang, "s", 0) for n, lang in enumerate(["xx", "yy"] * 20)]
    copy, leak, mail = (100, rows[0][1], "xx", "s", 0), (101, rows[1][1][:60] + " " + ITEM.lower(), "yy", "s", 0), (102, text("aeioukl") + " me@site.org", "xx", "s", 0)
    rows += [copy, leak, mail, (103, "12 34", "xx", "s", 0), (104, None, "xx", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM.lower())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {*range(40), 102}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.filter("doc_id = 102").first()["text"].endswith(" [EMAIL]")
    for name, stage in C.STAGES[1:]:  # each stage takes an empty table
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def brute_similar(texts):
    """Components of texts with Jaccard 0.8 or more on five-word shingles, each named by its smallest number."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(texts)))
    for a in root:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        texts.append(" ".join(base))
        for change in range(1, 6):  # similarities on both sides of 0.8
            w = list(base)
            for at in rnd.sample(range(len(w)), max(1, len(w) * change // 150)):
                w[at] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(w))
    texts += ["a b c d e f", "a b c d e f a b c d e f", "one", "One", None]
    docs = spark.createDataFrame([(n, t, "xx", "s", 0) for n, t in enumerate(texts)], ROW)
    want = brute_similar(texts)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == dict(enumerate(want))
    assert {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()} == {n for n, r in enumerate(want) if n == r}


def test_verified_links_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY_BLOCK", 3)
    base = [f"w{n}" for n in range(100)]
    texts = [" ".join(base[n:] + [f"x{k}" for k in range(n)]) for n in range(0, 60, 2)]  # a chain: only neighbours are similar
    docs = spark.createDataFrame([(n, t, "xx", "s", 0) for n, t in enumerate(texts)], ROW)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == dict(enumerate(brute_similar(texts)))


def test_large_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY_BLOCK", 8)
    monkeypatch.setattr(simhash, "candidate_links", lambda nodes: nodes.select(F.col("name").alias("u"), F.lit(nodes.agg(F.min("name")).first()[0]).alias("v")).filter("u != v"))
    rnd = random.Random(5)
    texts = []
    for k in range(6):  # groups of near copies of several sizes and a chain, all in one candidate component
        base = [f"w{k}x{n}" for n in range(80)]
        for _ in range(4 + 12 * k):
            w = list(base)
            w[rnd.randrange(80)] = f"y{rnd.randrange(999)}"
            texts.append(" ".join(w))
    chain = [f"c{n}" for n in range(100)]
    texts += [" ".join(chain[n:] + [f"z{k}" for k in range(n)]) for n in range(0, 40, 2)]
    docs = spark.createDataFrame([(n, t, "xx", "s", 0) for n, t in enumerate(texts)], ROW)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == dict(enumerate(brute_similar(texts)))


def test_bands_agree_as_often_as_sets():
    rng = np.random.default_rng(8)
    same = total = 0
    for _ in range(400):
        h = rng.integers(0, 2**63, 90, dtype=np.uint64) * np.uint64(2)
        a, b = simhash.band_keys(h[:80]), simhash.band_keys(h[10:])  # similarity 7 / 9
        same, total = same + int((a == b).sum()), total + len(a)
    assert abs(same / total - (7 / 9) ** simhash.BAND) < 0.03


def test_repeated_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{k}{n}" for n in range(30)) for k in "abc")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], ROW)
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (3, b), (7, c), (None, a)], key=str)


def test_isolated_queries_get_all_their_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.repeat(rng.standard_normal((10, 16)), 60, axis=0) + 0.001 * rng.standard_normal((600, 16))
    v = np.concatenate([v, 50 * rng.standard_normal((20, 16))])  # alone in their lists
    monkeypatch.setattr(ann, "probes_needed", lambda *_: 1)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(600, v[600].tolist())] * 3
    got = ann.op8_ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {q: 20 for q in range(0, 620, 20)}


def clustered(rng, n, clusters, spread):
    centre = rng.standard_normal((clusters, 48))
    return centre[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, 48))


def queries_unlike_the_rest(rng):
    v = clustered(rng, 2000, 30, 0.5)
    v[::20] = 3 * rng.standard_normal((100, 48))
    return v


KINDS = {
    "tight clusters": lambda rng: clustered(rng, 2000, 20, 0.2),
    "one direction": lambda rng: 3 + rng.standard_normal((2000, 48)),
    "positive": lambda rng: rng.random((2000, 48)),
    "negative": lambda rng: -np.abs(rng.standard_normal((2000, 48))) * rng.lognormal(0, 1, (2000, 1)),
    "queries unlike the rest": queries_unlike_the_rest,
    "few dimensions": lambda rng: rng.standard_normal((2000, 48)) / np.arange(1, 49) ** 2,
    "lengths": lambda rng: rng.standard_normal((2000, 48)) * rng.lognormal(0, 2, (2000, 1)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_neighbours_of_all_kinds_of_vectors(spark, kind):
    v = KINDS[kind](np.random.default_rng(5)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.op8_ann(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(got) == list(range(0, 2000, 20)) and {len(x) for x in got.values()} == {20}
    reached = [len({i for i, _ in brute_nearest(np.arange(2000), v.astype(np.float64), q, 20)} & got[q]) / 20 for q in got]
    assert np.mean(reached) >= 0.95 and np.mean(np.array(reached) >= 0.9) >= 0.9


def test_the_scan_keeps_what_its_lists_hold():
    rng = np.random.default_rng(6)
    for v in (clustered(rng, 3000, 10, 0.2), 3 + rng.standard_normal((3000, 48)), rng.standard_normal((3000, 48))):
        ids, lists = np.arange(3000), rng.integers(0, 9, 3000)
        probed = rng.random((150, 9)) < 0.5
        probed[:, 0] = True
        q, vec, score = ann.scan(v[:150], ids[:150], probed, v, ids, lists, 20, np.full(150, -np.inf))
        found = 0
        for n in range(150):
            inside = np.flatnonzero(probed[n][lists] & (ids != n))
            mine = vec[q == n]
            assert len(mine) == 20 and np.allclose(score[q == n], v[mine] @ v[n], rtol=1e-12, atol=0) and set(mine) <= set(inside)
            found += len(set(inside[np.argsort(-(v[inside] @ v[n]))[:20]]) & set(mine))
        assert found >= 0.98 * 150 * 20


def test_packed_terms_round_trip():
    rng = np.random.default_rng(2)
    for top, most in ((10, 3), (250_000, 300), (2**31, 70_000), (1, 1)):
        terms = rng.permutation(rng.integers(0, top, 40))
        terms = np.unique(terms)[rng.permutation(len(np.unique(terms)))]
        counts = rng.integers(1, most + 1, len(terms))
        t, c = T.unpack(*T.pack(terms, counts))
        assert dict(zip(t.tolist(), c.tolist())) == dict(zip(terms.tolist(), counts.tolist()))
    assert [len(x) for x in T.unpack(*T.pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))] == [0, 0]
