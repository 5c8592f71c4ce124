"""Language, pages, tokens, fingerprints and URLs against libraries, brute force and held-out rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlab.llm import html_text, imatch, language, packing, pieces, token_counts, urls
from rosterlab.llm.byte_bpe import ByteBpe
from rosterlab.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABETS = ["ab ", "don't we'll 12 .,\n", "éèüß€😀中文字 a▁́​ɐ ", "   \n\t\x00a\x1c\x85\xa0\u3000", "²½٣ ⅷa", "aaaa", "<unk><s></s><0x0A><|endoftext|> "]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in rng.choices(ALPHABETS, k=n)]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = QUERIES["op2_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.93


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs, sample=40)
    rows = [(1, None), (2, ""), (3, " 12 !"), (4, "the and of that with " * 30), (5, "Ωμέγα και άλφα στην πόλη " * 30), (6, "und die der " * 5000)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[6]["lang_pred"] == "de" and got[5]["rejected"]
    one_id = language.fit(docs.where("lang is not null").withColumn("doc_id", F.lit(7)), sample=40)
    assert one_id["langs"] == model["langs"] and one_id["centroids"].shape == model["centroids"].shape
    assert language.counts("\U00030000\U00030001")[1] == 2
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language.predict(docs.withColumn("score", F.lit(1)), model)


def test_language_prediction_equals_plain_cosines(spark):
    """Counts of one, two and three characters by dictionaries, weights and cosines by loops, for the model's own centroids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 3000").limit(60)
    model = language.fit(docs, sample=40)

    def cell(gram):
        codes, m = [ord(c) for c in gram], (1 << 32) - 1
        h = codes[-1] * 2654435761 & m
        if len(codes) > 1:
            h ^= codes[-2] * 2246822519 + 0x9E3779B9 & m
        if len(codes) > 2:
            h ^= codes[-3] * 3266489917 + 0x7F4A7C15 & m
        h = (h ^ h >> 15) * 0x85EBCA6B & m
        return h >> 19

    for r in language.predict(docs, model).collect():
        words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in r["text"]).split()
        line = " " + " ".join(words) + " "
        tally = {}
        for n in (1, 2, 3):
            for end in range(max(1, n - 1), len(line)):
                gram = line[max(0, end - n + 1) : end + 1]
                if len(gram) == n:
                    tally[cell(gram)] = tally.get(cell(gram), 0) + 1
        weights = {g: (1 + np.log(n)) * float(model["idf"][g]) for g, n in tally.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * c[g] for g, w in weights.items()) / max(norm, 1e-12) for c in model["centroids"]]
        best = int(np.argmax(cosines))
        assert not words or (r["lang_pred"] == model["langs"][best] and abs(r["score"] - min(1, max(0, cosines[best]))) < 1e-3), r["doc_id"]


def test_ngram_counts_do_not_depend_on_the_step(monkeypatch):
    text = "".join(random.Random(1).choices("ab c.é1 \n", k=2000))
    whole = language.counts(text)
    for step in (1, 2, 7, 100):
        monkeypatch.setattr(language, "_STEP", step)
        assert (language.counts(text)[0] == whole[0]).all() and language.counts(text)[1] == whole[1]


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header>"
    "<div class='cookie-notice'>We use</div><nav><ul><li><a href=/>m</a></ul></nav><div class='ad'>Buy</div>"
    "<article><h1>%s &amp; more</h1><p><b>One <i>two</i>&nbsp; three<br><p>Four\n five<!-- x > <p>no --><aside>side</aside>"
    "<form>f<input></form><section class=comments><p>c</section>%s</article><footer>f &copy;</footer></body></html>"
)


def test_pages():
    assert html_text.extract_group([PAGE % ("A", "<p>end")]) == ["A & more\nOne two three\nFour five\nend"]
    assert html_text.extract_group([]) == [] and html_text.extract_group(["", "plain", "a < b <p>c"]) == ["", "plain", "a < b\nc"]
    # text inside an article stays, however many pages share it
    many = [PAGE % (f"Title {i}", f"<p>Text of its own, number {i}." + " More." * 20 + "<p>Read on") for i in range(10)]
    assert all(t.endswith("More.\nRead on") and t.startswith(f"Title {i} &".replace(" &", " & more")) for i, t in enumerate(html_text.extract_group(many)))
    assert html_text.extract_group([many[0]] * 10) == [html_text.extract_group([many[0]])[0]] * 10


BARE = (
    "<html><body><div class=top><p>Site of all things<p>%s</div><div class=x1><p>Please read our terms before you go on, they are long and dull.</div>"
    "<div class=x2><h1>Title %s</h1><p>Please note: prices exclude tax.<p>%s</div><div class=x3><p>Imprint and so on</div></body></html>"
)


@pytest.mark.parametrize("n", [2, 7, 8, 48])
def test_pages_told_by_the_template_only(n, monkeypatch):
    pages = [BARE % (f"day {i}", i, f"Text number {i} of this page. " * 5) for i in range(n)]
    want = [f"Title {i}\nPlease note: prices exclude tax.\n" + " ".join([f"Text number {i} of this page."] * 5) for i in range(n)]
    assert html_text.extract_group(pages) == want
    monkeypatch.setattr(html_text, "template", lambda pages: ([], {}))  # without the template nothing tells the parts
    assert all("Imprint" in t for t in html_text.extract_group(pages))


def test_class_words_never_empty_a_page():
    assert html_text.extract_group(["<body><article class='widget-review'><h1>A</h1><p>b</article><footer>f</footer>"]) == ["A\nb"]
    assert html_text.extract_group(["<body><div class='post-comment-free search-result'><p>All of it</div><nav>m</nav>"]) == ["All of it"]
    assert html_text.extract_group(["<div class='search'><article><p>x<div class=ad>no</div></article></div>"]) == ["x"]
    assert html_text.extract_group(["<body><nav><p>m</nav><footer>f</footer>"]) == [""]
    assert html_text.extract_group(["<p>" + "word " * 200_000])[0].count("word") == 200_000


def test_page_rows(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE % (i, ""), "x") for i in range(30)] + [(None, None, None, "x"), (3, "http://h1.org/3", "", "x"), (3, "http://h1.org/3", "", "x")]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), group=8).collect()
    assert len(out) == len(rows) and sum(r["text"] == "" for r in out) == 3
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_query_takes_every_article(spark):
    import html
    import re

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op3_html_main_text"](spark, SMALL).collect():
        h = source[r["page_id"]]
        body = re.sub(r"<(/?p|/?h1)>", "\x01", h[h.index("<article>") + 9 : h.index("</article>")])
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]*>", " ", body).split("\x01"))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = pieces.Pieces("piece_bpe_32k.model")
    texts = random_texts(1500, 5) + [s for n in range(70) for s in (" " * n, "a" + " " * n + "b", "a" * n, "=" * n, "\n" * n)]
    for t in texts:
        ids = np.frombuffer(model.encode(t), dtype=np.int32).tolist()
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids), repr(t)
    for ids in ([200], [200, 201, 13], [0, 5, 300], [28705, 28705], [1, 2, 300]):
        assert model.decode(ids) == library.decode(ids)
    assert model.encode(None) == b""


def test_piece_queries(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op6_piece_encoding"](spark, SMALL).collect():
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    odd = spark.createDataFrame([(None, "a"), ("", "b"), ("x y", "c")], "text string, extra string")
    got = pieces.decode(pieces.encode(odd).drop("text")).collect()
    assert [r["decoded"] for r in got] == ["", "", "x y"] and [r["extra"] for r in got] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        pieces.encode(odd.withColumn("ids", F.lit(1)))


def test_byte_ids_equal_the_library():
    coder = ByteBpe("byte_bpe_50k.json")
    for t in random_texts(2500, 6) + ["x<|endoftext|> y", "<|endoftext|>"]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == BPE.encode(t, add_special_tokens=False).ids, repr(t)


def test_edited_counts_equal_counting_anew(monkeypatch):
    coder, rng = ByteBpe("byte_bpe_50k.json"), random.Random(7)
    monkeypatch.setattr(token_counts, "LEAF", 4)
    monkeypatch.setattr(token_counts, "BEHIND", 8)
    for text in random_texts(400, 8) + ["word " * 3000]:
        tree, now = token_counts.CountTree(text, coder), text
        for _ in range(4):
            start, length, new = rng.randrange(len(now) + 3), rng.choice([0, 3, 12, 200]), rng.choice(random_texts(5, rng.random()))
            tree.edit(start, length, new)
            start = min(start, len(now))
            now = now[:start] + new + now[min(start + length, len(now)) :]
            assert (tree.text(), tree.length) == (now, len(now))
            assert tree.total == len(BPE.encode(now, add_special_tokens=False).ids), (text, now)


def test_an_edit_encodes_little_of_a_long_text():
    tree = token_counts.CountTree("some words of a text, " * 5000, ByteBpe("byte_bpe_50k.json"))
    tree.encoded = 0
    tree.edit(50_000, 4, "other")
    assert 0 < tree.encoded < 200


def test_token_count_rows(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op5_edited_token_counts"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:  # a deletion, an insertion of the text's own start, a new ending
        old = texts[r["doc_id"]]
        n, now = len(old), old
        for start, length, put in ((n // 3, 10, ""), (n // 2, 0, old[:20]), (max(n - 5, 0), 5, " - edited, 2nd draft.\n")):
            now = now[:start] + put + now[start + length :]
        counts = [len(BPE.encode(t, add_special_tokens=False).ids) for t in (old, now)]
        assert [r["n_tokens"], r["edited_tokens"], r["edited_chars"]] == [*counts, len(now)]
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, None), (1, 1, 7, 0, " three"), (2, 1, 5, 9, "new")], "doc_id long, seq long, start long, length long, replacement string")
    got = {r["doc_id"]: r for r in token_counts.count_edited(docs.join(token_counts.gather_edits(edits), "doc_id", "left")).collect()}
    count = lambda t: len(BPE.encode(t).ids)
    assert got[1]["edited_tokens"] == count(" two three") and got[1]["n_tokens"] == count("one two")
    assert (got[2]["n_tokens"], got[2]["edited_tokens"], got[3]["edited_tokens"]) == (0, count("new"), 1)


def test_packing_places_every_id_once(spark):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 5, 1022, 1023, 1024, 1025, 5000] + [7] * 300 + list(range(1, 900, 13)))]
    rows += [(None, None), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, offset int")
    out = packing.pack(docs).collect()
    assert sum(r["length"] for r in out) == sum(len(BPE.encode(t or "").ids) + 1 for _, t in rows)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for got in sequences.values():
        assert [o for o, _ in sorted(got)] == [sum(n for _, n in sorted(got)[:i]) for i in range(len(got))] and sum(n for _, n in got) <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_query_cuts_the_library_ids(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pieces_of, fill = {}, {}
    for r in QUERIES["op9_packing"](spark, SMALL).collect():
        pieces_of.setdefault(r["doc_id"], []).append(r)
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    for i, text in docs.items():
        ids, at = np.array([*BPE.encode(text, add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted(pieces_of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = sum(0 if f & (f - 1) == 0 else 1024 - f for f in fill.values())
    assert max(fill.values()) <= 1024 and padding < 0.03 * sum(fill.values())


def test_plan_holds_the_histogram():
    rng = random.Random(9)
    for n in (1, 5, 300, 5000):
        histogram = {}
        for _ in range(n):
            s = rng.choice([rng.randrange(1, 1025), 700, 3])
            histogram[s] = histogram.get(s, 0) + 1
        got = {}
        for pattern, times in packing.plan(histogram):
            assert sum(s * k for s, k in pattern.items()) <= 1024
            for s, k in pattern.items():
                got[s] = got.get(s, 0) + k * times
        assert got == histogram
    assert packing.plan({}) == []


def test_url_query_equals_sql(spark):
    frame = QUERIES["op7_url_rules"](spark, SMALL)
    names = sorted(frame.columns)
    db = duckdb.connect()
    db.sql(f"create view pages as from '{SMALL}/pages.parquet'")
    assert sorted(map(tuple, frame.select(names).collect()), key=str) == sorted(db.sql(f"select {', '.join(names)} from ({ORACLES['op7_url_rules']})").fetchall(), key=str)


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("a.org", None, "allow"), ("b.org", "/d/e/f", "block"), ("", "/only", "block")]
    cases = {
        None: (None, "allow"), "": (None, "allow"), "net/": (None, "allow"), "http://x.NET": (None, "allow"), "http://x.NET/": ("net/", "block"),
        "http://examplenet/en/": (None, "allow"), "https://Q.example.net/en/1?x#y": ("example.net/en/", "allow"), "h://example.net/EN/": ("net/", "block"),
        "h://a.org/xyz": ("a.org/x", "block"), "h://a.org/y": ("a.org", "allow"), "h://a.org?x/x": ("a.org", "allow"), "h://b.org/d/e/fgh/i": ("b.org/d/e/f", "block"),
        "h://b.org/d/e": (None, "allow"), "h:///only": ("/only", "block"), "h://a.b.c.d.net//" + "s/" * 300: ("net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate([*cases, *list(cases)[:3]])], "page_id long, url string, key string")
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(cases) + 3 and all((r["rule"], r["verdict"]) == cases[r["url"]] for r in got)
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block").collect()} == {"block"}


def test_fingerprints_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 20_000)  # many ranges
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids, by_text, near = sorted(docs), {}, []
    got = {r["doc_id"]: r for r in QUERIES["op8_imatch_fingerprints"](spark, SMALL).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, follow = docs[i], docs[ids[(k + 1) % len(ids)]]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + follow[:quarter]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        by_text.setdefault(text, set()).add(got[i]["fingerprint"])
        near.append((got[i]["near_edited"], got[i]["near_next"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(a for a, _ in near) / len(near) > 0.35 > 0.1 > sum(b for _, b in near) / len(near)


def test_fingerprints_equal_plain_ones(spark):
    """Every fingerprint, and every likeness, by I-Match written plainly."""
    import re

    import xxhash

    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = lambda t: {digest(w) for w in re.split(r"[ \t-\r!-/:-@\[-`{-~]+", t.lower()) if w}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    counts = {}
    for t in docs.values():
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if 3 <= np.log2(len(docs) / n) <= 10}

    def signatures(text):
        known, out = words(text) & lexicon, []
        for bits in imatch.LEVELS:
            for s in range(imatch.SUBSETS):
                at = len(out)
                shift, pattern = at * 7 % (64 - bits), (s * 5 + at) % (1 << bits)
                own = sorted(signed(h) for h in known if h >> shift & (1 << bits) - 1 == pattern)
                out.append(digest(",".join(map(str, own))) >> 32 | 1 if own else 0)
        if not known:
            every = sorted(map(signed, words(text)))
            out = [digest(",".join(map(str, every))) >> 32 | 1 if every else 0] + [0] * (len(out) - 1)
        return out

    def alike(a, b):
        shares, k = [], imatch.SUBSETS
        for lo in range(0, len(a), k):
            pairs = list(zip(a[lo : lo + k], b[lo : lo + k]))
            met = sum(x != 0 or y != 0 for x, y in pairs)
            shares.append(sum(x == y != 0 for x, y in pairs) / max(met, k // 2) if met else 0.0)
        return 1.0 if a == b else max(shares)

    ids = sorted(docs)
    got = {r["doc_id"]: r for r in QUERIES["op8_imatch_fingerprints"](spark, SMALL).collect()}
    for k, i in enumerate(ids):
        text, follow = docs[i], docs[ids[(k + 1) % len(ids)]]
        quarter = len(text) // 4
        own, changed, after = signatures(text), signatures(text[: len(text) - quarter] + follow[:quarter]), signatures(follow)
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in own), i
        assert got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in changed), i
        assert got[i]["near_edited"] == pytest.approx(alike(own, changed)) and got[i]["near_next"] == pytest.approx(alike(own, after))


def test_fingerprint_edge_cases(spark):
    rows = [(None, "no id here"), (1, None), (2, ""), (3, "x"), (4, "long " * 4000), (4, "long " * 4000), (5, "the same words"), (9, "words same the")]
    got = imatch.fingerprints(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, seq int")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["own"] == by_id[2]["own"] and by_id[5]["own"] == by_id[9]["own"] != by_id[3]["own"]
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["own"] == one["following"]
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_paragraphs_of_articles_stay():
    """A paragraph that all pages of a host share stays in the article, however many pages the group has."""
    for element in ("article", "main"):
        page = f"<html><body><nav>menu</nav><{element}><p>Own words of page %d.</p><p>Shared.</p><p>Twice.</p><p>Twice.</p></{element}></body></html>"
        for n in (2, 8, 20):
            assert html_text.extract_group([page % i for i in range(n)]) == [f"Own words of page {i}.\nShared.\nTwice.\nTwice." for i in range(n)]


def test_empty_and_open_elements_do_not_swallow_the_article():
    page = "<article><p>a %s b</p><p>rest of the article</p></article>"
    for tag in ('<svg class="search"/>', "<svg>", "<math/>", '<object data="x">', "<video>", "<audio>", "<canvas>"):
        assert html_text.extract_group([page % tag]) == ["a b\nrest of the article"]
    for tag in ("math", "object", "video", "audio", "canvas"):
        assert html_text.extract_group([page % f"<{tag}>in it</{tag}>"]) == ["a in it b\nrest of the article"]
    assert html_text.extract_group([page % "<svg><title>t</title></svg>"]) == ["a b\nrest of the article"]
    assert html_text.extract_group([page % '<svg class="i"/>x<svg><text>t</text></svg>']) == ["a x b\nrest of the article"]
    assert html_text.extract_group(["<p>a</p><script>open <p>b</p>"]) == ["a"]
