"""HTML text, sharding, packing and token counts."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brooklog.llm import html_text as H
from brooklog.llm import packing as P
from brooklog.llm import sharding as S
from brooklog.llm import token_counts as T

ARTICLE = "<html><head><title>t</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>one<br>two\n three<p>last &lt;tag&gt;</p><div class=comments-2>bad</div></article><footer>&copy;</footer>"
TEXT = "Head & more\n\none two three\n\nlast <tag>"


def test_pages(spark):
    rows = [(1, "http://a.com/1", ARTICLE), (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/1", ARTICLE), (5, "odd", "just &amp; text"), (6, "http://a.com/3", "<div><p>other layout of some length</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in H.op4_html_text(pages).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5, 6)] == [TEXT, "", "", TEXT, "just & text", "other layout of some length"]
    assert got[1]["n_chars"] == len(TEXT)
    assert H.op4_html_text(pages.limit(0)).count() == 0


def test_a_host_path_wins_over_a_page_s_own(spark):
    body = "<body><div class='x1'><p>" + "main text " * 20 + "</p></div><div class='y'><p>{}</p></div></body>"
    pages = [(i, "http://h/" + str(i), body.format("short")) for i in range(5)] + [(9, "http://h/9", body.format("very long extra box " * 200))]
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == ("main text " * 20).strip()


def test_title_lead_and_small_sections_stay(spark):
    long = "main text " * 60
    pages = {
        "a": (f"<body><article><h1>Title {{}}</h1><p>lead</p><div class=body><p>{long}</p></div></article>", "Title {}\n\nlead\n\n" + long.strip()),
        "b": (f"<body><div class=ad>buy</div><div class=post><h2><a href=x>Title {{}}</a></h2><div class=lead>lead</div><div class=body><p>{long}</p></div></div>", "Title {}\n\nlead\n\n" + long.strip()),
        "c": (f"<body><nav>menu</nav><main><section><p>first {{}}</p></section><section class=big><p>{long}</p></section></main><ul><li><a href=x>link</a></ul>", "first {}\n\n" + long.strip()),
        "d": (f"<body><h1>Title {{}}</h1><div class=body><p>{long}</p></div>", "Title {}\n\n" + long.strip()),
    }
    rows = [(i * 10 + n, f"http://{host}/{n}", html.format(n), text.format(n)) for i, (host, (html, text)) in enumerate(pages.items()) for n in range(3)]
    rows.append((99, "http://b/9", "<div class=post><h2>T</h2><div class=body>little</div><section>" + "much more " * 90 + "</section></div>", "T\n\nlittle\n\n" + ("much more " * 90).strip()))
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_one_boilerplate_word_among_others_is_the_host_s_choice(spark):
    page = "<body><article><header><h1>Title {0}</h1></header><p>{1} {0}</p><div class=ad-free-note><p>own note {0}</p></div><blockquote class=related-quote>quote {0}</blockquote><div class='promo-hint'>same hint</div><div class=post-comments>bad</div></article>"
    rows = [(n, f"http://h/{n}", page.format(n, "words " * 40)) for n in range(4)] + [(9, "http://one/", page.format(9, "words " * 40))] + [(20 + n, "http://copies/", page.format(7, "words " * 40)) for n in range(5)]
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title {0}\n\n" + "words " * 40 + "{0}\n\nown note {0}\n\nquote {0}"
    assert [got[n] for n in range(4)] == [want.format(n) for n in range(4)]
    assert got[9] == want.format(9) + "\n\nsame hint" and got[20] == want.format(7) + "\n\nsame hint"  # too few pages, and copies of one


def test_a_title_box_before_the_winner_stays(spark):
    rows = [(n, f"http://h/{n}", f"<body><div class=top><h1>Title {n}</h1></div><div class=text><p>{'main text ' * 30}</p></div><div class=x><p>box</p></div>") for n in range(3)]
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n].startswith("main text") or got[n] == f"Title {n}\n\n" + ("main text " * 30).strip() for n in range(3))
    only = [(n, u, h.replace("<div class=x><p>box</p></div>", "")) for n, u, h in rows]
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame(only, "page_id long, url string, html string")).collect()}
    assert [got[n] for n in range(3)] == [f"Title {n}\n\n" + ("main text " * 30).strip() for n in range(3)]


def test_deep_and_wide_pages_are_not_quadratic():
    import time

    began = time.time()
    for html in ("<b>" * 100_000 + "x", "<div class=a1>" * 100_000 + "x" + "</div>" * 100_000, "<div><b>x</p>" * 30_000, "<li>" * 50_000, "<ul>" * 20_000 + "<li>x" * 20_000, "<p>x<div>" * 20_000):
        H.extract(html, None)
    assert time.time() - began < 60


def test_generated_pages_equal_their_blocks(spark):
    """The whole query against a plain rendering: random articles inside random frames, each block known beforehand."""
    rnd = random.Random(17)
    rows, want = [], {}
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    frames = [
        "<nav><a href=x>{0}</a></nav><article><h1>{1}</h1>{2}</article><aside>{0}</aside><footer>{0}</footer>",
        "<header>{0}</header><div id=menu>{0}</div><main><h1>{1}</h1><section>{2}</section></main><form>{0}</form>",
        "<div class='ad box'>{0}</div><div class=wrap><h1>{1}</h1><div class=body>{2}</div></div><div class=comments><p>{0}</p></div>",
        "<div class=cookie-banner>{0}</div><h1>{1}</h1><div class=post-body>{2}</div><div role=contentinfo>{0}</div>",
    ]
    for page in range(80):
        blocks = [say(rnd.randrange(8, 60)) for _ in range(rnd.randrange(2, 9))]
        title, html = say(4), ""
        for b in blocks:
            cut = b.split(" ", 2)
            html += rnd.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<h2>{}</h2>"]).format(f"{cut[0]} <b>{cut[1]}</b>\n {cut[2]}<!-- c --><script>no()</script>")
        rows.append((page, f"http://host{page % 4}/{page}", "<html><body>" + frames[page % 4].format(say(3), title, html)))
        want[page] = "\n\n".join([title, *blocks])
    got = {r["page_id"]: r["text"] for r in H.op4_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_malformed_pages():
    for html in ("<", "<p", "a < b > c", "<p class='", "<!-- open", "<script>never closed", "</p></div>", "<div " * 3000, "<p>" * 3000, "&#0;&#xffffff;&bogus;"):
        H.extract(html, None)
    assert H.extract("<table><tr><td>a<td>b<tr><td>c</table>", None) == "a\n\nb\n\nc"
    assert H.extract("<ul><li>a<ul><li>b</ul><li>c</ul>", None) == "a\n\nb\n\nc"


def scalar_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    rnd = random.Random(4)
    keys = np.array([rnd.getrandbits(64) for _ in range(3000)], np.uint64)
    for n in (1, 2, 16, 17, 100):
        assert S.jump(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]
    a, b = S.jump(keys, 16), S.jump(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.09


def test_shards(spark):
    rows = [(i, "é" * (i % 7)) for i in range(2000)] + [(5000, None), (5001, ""), (None, "x"), (7, "é" * 7), (7, "é" * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = S.op5_sharding(docs).collect()
    assert len(got) == len(rows)
    for shard in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    one = {r["doc_id"]: r for r in got}
    assert (one[5000]["size"], one[5000]["text_crc32"], one[3]["size"], one[3]["text_crc32"]) == (1, 0, 7, zlib.crc32("ééé".encode()))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert S.op5_sharding(docs.limit(0)).count() == 0


def test_shards_are_jump_hashes_of_the_id(spark):
    ids = [*range(300), 2**40, -5]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in S.op5_sharding(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()}
    import xxhash

    for i in ids:
        key = xxhash.xxh64_intdigest((i % 2**64).to_bytes(8, "little"), seed=42)
        assert got[i] == (scalar_jump(key, 16), scalar_jump(key, 17))


def test_encoder_equals_the_tokenizer():
    e = P.Encoder(P.tokenizer_json())
    rnd = random.Random(6)
    texts = ["", "it's we'LL 'S x'd12½ \t\n", "a<|endoftext|>b", "ΣΑΣ ffi é", "x" * 5000]
    texts += ["".join(chr(rnd.choice([9, 10, *range(32, 127), *range(0xA0, 0x100)])) for _ in range(60)) for _ in range(800)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x3000), rnd.randrange(128), 0x4E00 + rnd.randrange(99)])) for _ in range(30)) for _ in range(300)]
    assert all(e(t) == e.whole(t) for t in texts)


def test_small_memory_of_words(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    e = P.Encoder(P.tokenizer_json())
    for t in ("a b c d e f", "f e d c b a", "a x y z a", "f f f q"):
        assert e(t) == e.whole(t)


def test_plans_use_every_length_once_and_fill():
    rnd = random.Random(8)
    for cap, n in ((16, 50), (100, 400), (2048, 3000)):
        lengths = Counter(rnd.randrange(1, cap + 1) for _ in range(n))
        plan = P.make_plan(lengths, cap)
        used = Counter()
        for parts, copies in plan:
            assert sum(parts) <= cap and copies > 0
            for k in parts:
                used[k] += copies
        assert used == lengths
        assert sum(c for _, c in plan) <= -(-sum(k * v for k, v in lengths.items()) // cap) * 1.03 + 2
    assert P.make_plan({}, 10) == []
    assert sorted(P.make_plan({10: 3, 6: 2, 4: 2}, 10)) == [((6, 4), 2), ((10,), 3)]
    assert P.make_plan({5: 1, 3: 1, 2: 1}, 10) == [((5, 3, 2), 1)]


def test_plans_reach_the_bound_and_keep_exact_triples():
    rnd = random.Random(12)
    for n, draw in ((20000, lambda: int(rnd.lognormvariate(6, 1)) + 1), (5000, lambda: int(rnd.expovariate(1 / 500)) + 1), (800, lambda: int(rnd.lognormvariate(6, 1)) + 1)):
        lengths = Counter(min(2048, draw()) for _ in range(n))
        plan = P.make_plan(lengths)
        assert sum(c for _, c in plan) == -(-sum(k * v for k, v in lengths.items()) // 2048)
        full = Counter(len(parts) for parts, _ in plan if sum(parts) == 2048)
        assert all(full[k] for k in (2, 3, 4))
        assert sum((Counter({k: c * m for k, m in Counter(p).items()}) for p, c in plan), Counter()) == lengths


def test_packing(spark):
    rnd = random.Random(3)
    texts = [None, "", "hello"] + [words(rnd) for _ in range(60)] + ["tok " * 5000, "hello", "hello"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("offset", F.lit("clash")).withColumn("length", F.lit("clash"))
    got = P.op6_packing(docs).collect()
    e = P.Encoder(P.tokenizer_json())
    for i, t in enumerate(texts):
        ids = e.whole(t or "") + bytes(4)
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids) // 4, 2048))
        assert sum(r["length"] for r in own) == len(ids) // 4
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own]
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert P.op6_packing(docs.limit(0)).count() == 0


def test_packed_ids_round_trip(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    seq = P.sequences(P.pack(P.tokenize(docs, P.tokenizer_json(), with_ids=True))).collect()
    e = P.Encoder(P.tokenizer_json())
    want = sorted(np.frombuffer(e.whole(t) + bytes(4), "<u4").tolist() for t in ("a b c", "d"))
    assert len(seq) == 1 and seq[0]["n_tokens"] == 6
    assert sorted(seq[0]["ids"]) == sorted(sum(want, []))


def words(rnd):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 400)))


def unigram(vocabulary):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_equal_the_unigram_tokenizer():
    v = T.load_vocabulary()
    counter, tok = T.Counter(v), unigram(v)
    rnd = random.Random(2)
    texts = ["", " ", "  a  b ", "the the", "漢字\n\tx", "😀▁ ▁a"] + [words(rnd) for _ in range(30)]
    texts += ["".join(chr(rnd.choice([32, rnd.randrange(128), rnd.randrange(0x400), 0x4E00 + rnd.randrange(99)])) for _ in range(40)) for _ in range(400)]
    assert counter.by_word
    assert [counter(t)[0] for t in texts] == [len(tok.encode(t).ids) for t in texts]


def test_ties_and_pieces_across_words():
    bytes_ = [(f"<0x{b:02X}>", -50.0) for b in range(256)]
    v = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("a▁b", -1.5), ("ba", -2.0)] + bytes_
    counter, tok = T.Counter(v), unigram(v)
    assert not counter.by_word
    for t in ("ab", "aba", "abab", "a b", "ab a b ba", "xa", "b a"):
        assert counter(t)[0] == len(tok.encode(t).ids), t


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_tokens"]) for r in T.op7_token_counts(docs).collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert T.op7_token_counts(docs.limit(0)).count() == 0
