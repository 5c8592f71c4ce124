"""Chat formatting, tokenizer alignment and the Merkle manifest against brute-force versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlab.llm import align, chat, merkle
from rosterlab.llm.byte_bpe import byte_bpe, token_bytes
from rosterlab.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
MARK = "<|endoftext|>"
BPE = "byte_bpe_50k.json"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(turns):
    """What the contract asks of one conversation, from its sorted ``(role, text)`` rows."""
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)


ODD = ["", "\\", "\\\\", MARK, f"\\{MARK}", f"<\\{MARK[1:]}", f"{MARK}{MARK}\\", "\\### Assistant: </turn> ok", "\n\n a", " \n", "日本語 \U0001f600 é", "x" * 5000, "a\\|b <\\|", MARK[:-1]]


def test_escaping_is_reversible():
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices(["\\", "<", "|", "endoftext", ">", MARK, "a", "\n"], k=12)) for _ in range(500)]:
        assert chat.unescape(chat.escape(text, MARK)) == text and MARK not in chat.escape(text, MARK)


def test_rendered_spans_parse_back_and_mask_whole_texts():
    rng = random.Random(2)
    shown = token_bytes(BPE)
    sizes = np.array([len(b) for b in shown])
    library = Tokenizer.from_file(public_tokenizers.path(BPE))
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "", "a\nb", MARK]), rng.choice(ODD)) for _ in range(rng.randrange(1, 6))]
        text, spans = chat.render(turns, MARK)
        assert chat.parse(text, MARK) == turns
        raw = text.encode()
        assert [chat.unescape(raw[a:b].decode()) for a, b, _ in spans] == [t for _, t in turns]
        ids = np.frombuffer(byte_bpe(BPE).encode(text), dtype="<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        ends = np.cumsum(sizes[ids])
        mask = chat.loss_mask(sizes[ids], spans, {"assistant"})
        plain = [any(a <= e - n and e <= b for a, b, r in spans if r == "assistant") for e, n in zip(ends, sizes[ids])]
        assert mask.tolist() == plain
        assert chat.unescape(b"".join(shown[i] for i in ids[mask]).decode()) == "".join(t for r, t in turns if r == "assistant")
    assert chat.loss_mask(sizes[:0], [], {"assistant"}).tolist() == []


def test_conversations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in [*range(20), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system"]), rng.choice(ODD), "x"))
    rows += [(50, t, ("user", "assistant")[t % 2], f"hot {t} {rng.choice(ODD)}", "x") for t in range(-3, 400)]
    rows += [(51, None, "user", None, "x"), (51, 0, None, "b", "x"), (51, 0, "assistant", "a", "x"), (51, 0, "assistant", "a", "x"), (51, 1 << 40, "assistant", MARK, "x")]
    rows += [(52, 0, "assistant", f"{i} same turn", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    low = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)
    text = lambda v: (v is not None, v or "")
    want = {}
    for c, turn, role, t, _ in sorted(rows, key=lambda r: (low(r[1]), text(r[2]), text(r[3]))):
        want.setdefault(c, []).append((role or "", t or ""))
    want = {c: said(turns) for c, turns in want.items()}
    for limit, cut in ((1 << 20, 64), (2000, 7)):
        if limit != chat.CHARS:  # CHARS is read in the task, from the module that travels by value
            monkeypatch.setattr(chat, "CHARS", limit)
        formatted = chat.format_conversations(docs, turns=cut)
        got = {r["id"]: r for r in chat.read_back(formatted).collect()}
        assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
        pieces = formatted.where("id = 50").orderBy("part", "piece").collect()
        assert len(pieces) > 5 and not any(p["whole"] for p in pieces)
        whole = "".join(p["formatted"] for p in pieces)
        assert [i for p in pieces for i in p["ids"]] == Tokenizer.from_file(public_tokenizers.path(BPE)).encode(whole, add_special_tokens=False).ids
        assert got[50]["formatted_chars"] == len(whole)
    assert chat.read_back(chat.format_conversations(docs.limit(0))).count() == 0


def test_only_special_tokens_are_marks(spark):
    docs = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="no special token"):
        chat.format_conversations(docs, mark="### ").collect()


def test_chat_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: said([(r, "\\### Assistant: </turn> ok") for r in ("user", "assistant")])}
    turns = {}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    want |= {c: said(t) for c, t in turns.items()}
    got = QUERIES["op11_chat_formatting"](spark, SMALL).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)


def plain_manifest(rows, cut):
    """Leaves, subroots, root and proofs of ``(id, source, lang, n, text)`` rows, one list after the other."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(field, r)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            run, place = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
            yield "".join(run[:place]), "".join(run[place + 1 :])
            at //= 3

    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(cut(r)), r))
    trees = {g: (sorted(v, key=lambda x: x[:3]), tree([x[2] for x in sorted(v, key=lambda x: x[:3])])) for g, v in groups.items()}
    names = sorted(trees)
    top = tree([trees[g][1][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        leaves, levels = trees[g]
        for i, (_, _, own, fake, r) in enumerate(leaves):
            steps = [*way(levels, i), *way(top, at)]
            end = fake
            for a, b in steps:
                end = h(a + end + b)
            out.append((r[0], own, levels[-1][0], top[-1][0], h("".join(a + b for a, b in steps)), end, end == top[-1][0]))
    return out


@pytest.mark.parametrize("groups", [0, 1, 2, 3, 40])
def test_manifest_equals_brute_force(spark, groups, monkeypatch):
    rng = random.Random(groups)
    rows = []
    for g in range(groups):
        name = None if g == 1 else ["", "ü", "Z", "a", "￿", "\U00010000"][g] if g < 6 else f"s{g}"
        for _ in range(rng.choice([1, 2, 3, 4, 9, 10, 28]) if g else 250):
            rows.append((len(rows) * 7 % 1009, name, rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "ü" * 4000, f"t{len(rows)}"])))
    if groups > 2:
        rows += [rows[3], rows[3], (rows[5][0], rows[5][1], "xx", 1, "same id"), (None, "a", None, None, "no id"), (None, None, None, None, None)]
    if groups == 2:
        rows = [(1, "one", "en", 3, "a\nb")]
    cut = lambda r: r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else (*r[:4], r[4] if r[4] is None else r[4].replace("\n", ""))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    for heavy in (1000, 5) if groups == 40 else (5,):
        monkeypatch.setattr(merkle, "HEAVY", heavy)
        out = merkle.manifest(docs, tampered={"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
        out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash().alias("proof"), merkle.folded("fake").alias("end"), (merkle.folded("fake") == F.col("root")).alias("ok"))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(plain_manifest(rows, cut), key=str)


def test_manifest_query_equals_sql(spark):
    frame = QUERIES["op13_merkle_manifest"](spark, SMALL)
    names = sorted(frame.columns)
    db = duckdb.connect()
    db.sql(f"create view documents as from '{SMALL}/documents.parquet'")
    assert sorted(map(tuple, frame.select(names).collect())) == sorted(db.sql(f"select {', '.join(names)} from ({ORACLES['op13_merkle_manifest']})").fetchall())


def plain_alignment(rows):
    """The contract's measures of ``(id, text)`` rows, token by token."""
    import sentencepiece

    a_model = Tokenizer.from_file(public_tokenizers.path(BPE))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = token_bytes(BPE)
    cut = []
    for _, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [shown[i] for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for x in parts:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e] if len(a) < 3000 else None
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, spans[0]) if low < e <= c) + "|" + ",".join(str(i) for i, (s, e) in zip(b, spans[1]) if low < e <= c))
            low = c
        cut.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    counts, best = {}, {}
    for *_, links in cut:
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha(";".join(groups)) if a else "")
        for (i, _), (a, b, groups, links) in zip(rows, cut)
    ]


def test_alignment_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(40).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " ", "  a", "a\u2581b", MARK, f"x {MARK}", "\n\n\tx", "日本語 \U0001f600 é ﬁ", "a\u0000b", "ab" * 900, "𐍈", "tail \n", rows[0][1], rows[0][1]])]
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, None)]
    want = sorted(plain_alignment(rows), key=str)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    for hot in (500_000, 50):
        out = align.align_documents(docs, hot=hot)
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, out.collect()), key=str) == want
    assert align.align_documents(docs.limit(0)).count() == 0


def test_alignment_query_equals_brute_force_on_short_rows(spark):
    """All rows give counts; the tokens of each row are compared one by one, the counts by a plain sum over all."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars <= 4000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.align_documents(docs).collect())) == sorted(plain_alignment(rows))
    assert QUERIES["op12_tokenizer_alignment"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
