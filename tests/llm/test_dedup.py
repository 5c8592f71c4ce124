"""SimHash groups, line groups and exact duplicates against brute force."""

import random
from itertools import combinations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from rosterlab.llm import exact, lines, simhash
from rosterlab.llm.common import Scratch, components, linked, others
from rosterlab.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprint_is_the_bit_majority():
    for text in [None, "", " \n", "One", "one two three", "A b c d", "a b c d e " * 40, "Ünï cödé\x0bwords é"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_block_masks_hold_every_close_pair():
    rng = random.Random(1)
    for bits, blocks in ((4, 7), (3, 5), (0, 1)):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(bits, blocks)]
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(diff & m == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(4, 4)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, k) for k in range(600, 640)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    linked = {x for p in links for x in p if p[0] != p[1]}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(8)]
    texts = [None, "", "   ", "one", "ONE", "one two"]
    for b in base:
        for _ in range(12):
            words = b.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(400)] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += texts[10:14] * 20
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "again"), (None, "one", "no id")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(range(len(texts)), links)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]]
    kept = simhash.keep_first(spark.createDataFrame(rows[:-2], "doc_id long, text string, fp string")).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


def test_a_run_of_many_links_gives_a_forest():
    import numpy as np

    fps = np.array([1 << i for i in range(64)] + [0], dtype=np.uint64)
    links = list(simhash._forest(np.sort(fps), 2))
    assert len(links) == len(fps) - 1
    assert len(set(roots({int(x) for x in fps}, links).values())) == 1


def distance(a, b):
    """Edit distance, a column of the table at a time in the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    at, full, top = {}, (1 << len(a)) - 1, 1 << len(a) - 1
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    up, down, out = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        more, less = (down | ~(diagonal | up)) & full, up & diagonal
        out += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = (less | ~(diagonal | more)) & full, more & diagonal
    return out


def plain_lines(rows, spark):
    """Brute force: normalised lines, all pairs of distinct ones, groups, first occurrences."""
    import re

    norm = lambda s: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", s.lower()).strip(" ")
    occurrences = []
    keys = spark.createDataFrame([(i, t, i2) for i2, (i, t) in enumerate(rows)], "id long, text string, at long").select("at", F.xxhash64("id", F.coalesce("text", F.lit(""))).alias("rid")).collect()
    rid = {r["at"]: r["rid"] for r in keys}
    for at, (i, t) in enumerate(rows):
        for pos, line in enumerate((t or "").split("\n")):
            if norm(line):
                occurrences.append(((i is not None, i or 0), rid[at], pos, norm(line), at))
    distinct = sorted({o[3] for o in occurrences})
    links = [(a, b) for a, b in combinations(distinct, 2) if abs(len(a) - len(b)) <= max(len(a), len(b)) * 0.2 and distance(a, b) <= max(len(a), len(b)) * 0.2 + 1e-9]
    group = roots(distinct, links)
    first = {}
    for o in sorted(occurrences):
        first.setdefault(group[o[3]], o[:3])
    gone = {(o[4], o[2]) for o in occurrences if first[group[o[3]]] != o[:3]}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (at, p) not in gone) for at, (i, t) in enumerate(rows)], links


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(200)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 60, 120]))) for _ in range(25)]
    rows = [(None, "no id\n" + base[0]), (100, None), (101, ""), (102, "\n\n!!\n"), (103, base[1]), (103, base[1])]
    for i in range(60):
        out = []
        for _ in range(rng.randrange(1, 7)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(rng.choice([" ".join(words), " ".join(words).upper() + "!", "", "  " + ", ".join(words)]))
        rows.append((i, "\n".join(out)))
    want, links = plain_lines(rows, spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = lines.dedup_lines(docs).collect()
    assert links and sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, w) for (i, _), w in zip(rows, want)), key=str)
    assert all(r["key"] == "x" and r["n_kept"] <= r["n_lines"] for r in got)
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(docs.withColumn("n_lines", F.lit(1)))


def test_lines_of_two_components_under_one_key_still_link(spark, monkeypatch):
    """A chain in one bucket: neighbours are similar, the ends are not, so the leader alone does not reach them all."""
    words = [f"term{i:03d}" for i in range(60)]
    chain = [" ".join([*(f"new{j:03d}" for j in range(k)), *words[k:]]) for k in range(0, 40)]
    rows = list(enumerate(chain))
    monkeypatch.setattr(lines, "_BYTES", 0)  # shuffled joins on the way
    monkeypatch.setattr(lines, "FULL", 8)  # and a block that is cut
    want, links = plain_lines(rows, spark)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links and [got[i] for i, _ in rows] == want


def test_exact_duplicates(spark):
    texts = ["a b", "ab", " a\tb\n", None, "", " \n", "a\u00a0b", "AB", "x" * 3000, "x" * 2999 + " x", "a b"]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(1, "ab", "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    want = {}
    for i, t, _ in rows:
        want.setdefault("".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    for how in ({}, {"capacity": 1, "most_bits": 4}, {"capacity": 2, "most_bits": 10}):
        got = exact.duplicates(frame, **how).collect()
        assert len(got) == len(rows)
        for r in got:
            group = next(g for g in want.values() if r["doc_id"] in [i for _, i in g])
            assert (r["keep_id"], r["group_size"]) == (min(group)[1], len(group))
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact.duplicates(frame.limit(0)).count() == 0


def test_directory_splits_only_full_buckets(spark):
    hashes = spark.createDataFrame([(i << 60,) for i in range(-8, 8)] + [((5 << 60) + i,) for i in range(50)], "hash long")
    leaves = exact.directory(hashes, capacity=6, most_bits=8)
    width = lambda leaf: 1 << (8 - leaf[0])
    assert sum(map(width, leaves)) == 256 and max(d for d, _ in leaves) == 8 > min(d for d, _ in leaves)
    assert exact.directory(hashes.limit(0)) == [(0, 0)]


def test_exact_query_equals_sql(spark):
    frame = QUERIES["op10_exact_dedup"](spark, SMALL)
    names = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(names).collect()))
    db = duckdb.connect()
    db.sql(f"create view documents as from '{SMALL}/documents.parquet'")
    assert got == sorted(db.sql(f"select {', '.join(names)} from ({ORACLES['op10_exact_dedup']})").fetchall())


def test_changed_words_are_found(spark):
    """Lines with one, two or a tenth of their words changed, of 4 to 90 words, leave beside their originals."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(3, 9))) for _ in range(3000)]
    rows, pairs = [], 0
    for n in (4, 6, 9, 12, 16, 20, 27, 40, 60, 90):
        for changed in (1, 2, n // 10):
            for _ in range(12):
                words = rng.choices(vocabulary, k=n)
                other = list(words)
                for at in rng.sample(range(n), changed):
                    other[at] = rng.choice(vocabulary)
                a, b = " ".join(words), " ".join(other)
                if a != b and distance(a, b) <= max(len(a), len(b)) * 0.2 + 1e-9:
                    rows += [(2 * pairs, a), (2 * pairs + 1, b)]
                    pairs += 1
    for a, b in (("chapter one", "chapter two"), ("introduction", "introductions"), ("page 11 of 30", "page 12 of 31")):
        if distance(a, b) <= max(len(a), len(b)) * 0.2:
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_kept = 0").collect()}
    assert pairs > 200 and all(i % 2 for i in got) and len(got) >= 0.98 * pairs


def test_simhash_is_the_bit_majority(spark):
    rng = random.Random(7)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 6, 7)]
    plain = lambda hs, bits: sum(1 << b for b in bits if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    rows = spark.createDataFrame([(i, s, *(s + [None, None])[:3]) for i, s in enumerate(sets)], "i int, h array<long>, a long, b long, c long")
    for r in rows.select("i", lines.simhash(F.col("h")).alias("s"), lines.majority(F.col("a"), F.col("b"), F.col("c")).alias("m")).collect():
        hs = sets[r["i"]]
        want = plain(hs, range(64))
        # counters of bits 0, 4, ... are in the top bits of their lanes, those of the next two passes below
        got = sum((r["s"] >> (4 * lane + 3 - k) & 1) << (4 * lane + k) for lane in range(14) for k in range(3))
        assert got == want & sum(0b111 << 4 * lane for lane in range(14))
        assert r["m"] & (1 << 64) - 1 == plain(hs[:3], range(64))


def test_simhash_of_thousands_of_equal_hashes(spark):
    """The counters wrap round without an error, whatever a word's hash and however often a long line has it."""
    hashes = [-1, 0x0011111111111111, 0x7FFFFFFFFFFFFFFF]
    rows = spark.createDataFrame([(h, n) for h in hashes for n in (63, 2000, 40000)], "h long, n int")
    for r in rows.select("h", "n", lines.simhash(F.array_repeat("h", F.col("n"))).alias("s")).collect():
        want = 0
        for lane in range(0, 56, 4):
            for k in range(3):
                counters = (7 - r["n"] // 2) % 16 * lines._LANES + r["n"] * (r["h"] >> k & lines._LANES)
                want |= (counters >> lane + 3 & 1) << lane + 3 - k
        assert r["s"] == want, (r["h"], r["n"])
    # a line of one word has it in its sample if the word's hash says so, which one word of 64 does
    text = F.rtrim(F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), 4000))
    long = lines._lines(spark.range(1500).select(text.alias("norm")).withColumn("key", F.xxhash64("norm")))
    assert long.agg(F.count("bits"), F.bit_xor("bits")).first()[0] == 1500


def test_unrelated_lines_with_one_phrase_cost_few_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [(i, " ".join(word() for _ in range(15)) + " subject to the terms and conditions of the notice " + " ".join(word() for _ in range(15))) for i in range(2000)]
    store = Scratch()
    table = lines._lines(lines._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    assert lines._pairs(table, 0.8, store).count() < 50_000
    store.clear()


def test_line_dedup_of_odd_tables(spark):
    """Columns named like the operator's own, repeated ids, very long lines, lines without words."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
    rows = [(1, "same line here\nanother", "g", "r"), (1, "same line here\nanother", "g", "r"), (1, "same line here", "h", "s"), (2, long, "g", "r"), (3, long.replace("w77", "x77"), "g", "r"), (None, "another\n--", "g", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, rid string").withColumns({"__lines": F.lit(5), "key": F.lit(6), "kept": F.lit(7), "doc": F.lit(8), "a.b": F.lit(9)})
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_kept", "had_words"]
    got = sorted(((r["doc_id"], r["text"], r["gone"], r["rid"], r["__lines"], r["doc"], r["a.b"], r["n_lines"], r["n_kept"]) for r in out.collect()), key=str)
    # one of the two texts of id 1 holds the first occurrence; equal rows share one result
    low = min(rows[0][:2], rows[2][:2], key=lambda r: spark.range(1).select(F.xxhash64(F.lit(r[0]).cast("long"), F.lit(r[1]))).first()[0])
    first = low == rows[0][:2]
    want = [(1, "same line here" if first else "", "g", "r", 5, 8, 9, 2, 1 if first else 0)] * 2 + [(1, "" if first else rows[2][1], "h", "s", 5, 8, 9, 1, 0 if first else 1)]
    want += [(2, long, "g", "r", 5, 8, 9, 1, 1), (3, "", "g", "r", 5, 8, 9, 1, 0), (None, rows[5][1], "g", "r", 5, 8, 9, 2, 2)]
    assert got == sorted(want, key=str)


def test_keep_first_decides_by_row(spark):
    rows = [(5, "one two three"), (5, "one two three"), (7, "four five six"), (7, "one two three"), (None, "four five six"), (None, "alone here")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)


@pytest.mark.parametrize("full", [1000, 30])
def test_no_pair_of_a_large_block_is_missed(spark, full):
    """300 rows of one size in a block; partners are 50 places apart, further than the neighbours that meet first. Blocks overlap, keys may be negative."""
    rows = [(k - 150, 100, None, [7, 8] if k % 3 else [7]) for k in range(300)] + [(900, 100, None, [8]), (901, 10, None, [7]), (902, 100, None, [])]
    store = Scratch()
    table = store(spark.createDataFrame(rows, "key long, size int, bits long, blocks array<long>"), "table")
    same = lambda pairs: pairs.where("pmod(a, 50) = pmod(b, 50)")
    links = [tuple(r) for r in linked(table, 0.8, store, same, near=15, full=full).collect()]
    found = roots([r[0] for r in rows], links)
    assert all(found[k] == k % 50 - 150 for k in range(-150, 150))
    assert found[900] == -150 and found[901] == 901 and found[902] == 902
    assert linked(table.limit(0), 0.8, store, same).count() == 0
    store.clear()


@pytest.mark.parametrize("full", [1000, 30])
def test_only_links_leave_the_comparison_of_a_block(spark, full):
    """400 rows of two blocks, no two of one group: what the comparison returns are the links, each once, not the 79,800 pairs."""
    rows = [(k - 200, 100, None, [7, 8]) for k in range(400)]
    store = Scratch()
    table = store(spark.createDataFrame(rows, "key long, size int, bits long, blocks array<long>"), "table")
    columns = lambda keys: keys.distinct().withColumn("mod", F.expr("pmod(key, 200)"))
    same = lambda x, y: x["mod"] == y["mod"]
    large = table.select(F.explode("blocks").alias("block"), "key", "size", "bits")
    none = spark.createDataFrame([], "node long, root long")
    found = others(large, none, 0.8, store, full, inside=(columns, same))
    assert sorted(map(tuple, found.collect())) == [(k, k - 200) for k in range(200)]
    verified = lambda pairs: pairs.where("pmod(a, 200) = pmod(b, 200)")
    links = [tuple(r) for r in linked(table, 0.8, store, verified, near=15, full=full, inside=(columns, same)).collect()]
    assert roots([r[0] for r in rows], links) == {k - 200: k % 200 - 200 for k in range(400)}
    store.clear()


def test_similar_lines_are_those_of_the_edit_distance(spark):
    """Words replaced, left out, put in, swapped and glued together; the walk through the words is never below the distance."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(60)]
    pairs = [("a", "b"), ("a b", "b a"), ("abcd abcd abcd", "abcd abcd"), ("word", "word word")]
    for n in (2, 5, 9, 30, 60):
        for _ in range(60):
            words = rng.choices(vocabulary, k=n)
            other = list(words)
            for _ in range(rng.randrange(0, max(2, n // 3))):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [other[at], rng.choice(vocabulary)], other[at : at + 2][::-1], [other[at] + "x"]]) or ["z"]
            pairs.append((" ".join(words), " ".join(other)))
    table = spark.createDataFrame(pairs, "x string, y string")
    out = table.select("x", "y", lines._similar(F.col("x"), F.col("y"), 0.8).alias("alike"), lines._walked(F.split("x", " "), F.split("y", " ")).alias("cost")).collect()
    for r in out:
        apart, longer = distance(r["x"], r["y"]), max(len(r["x"]), len(r["y"]))
        assert r["cost"] >= apart and (r["x"] != r["y"] or r["cost"] == 0)
        short, long = sorted((r["x"].split(" "), r["y"].split(" ")), key=len)
        run = len(short) < len(long) and any(short == long[:k] + long[k + len(long) - len(short) :] for k in range(len(short) + 1))
        # a run of words that one line lacks counts without one of its spaces
        assert r["alike"] == (apart - run <= int(longer * 0.2 + 1e-9)), r
    assert 50 < sum(r["alike"] for r in out) < len(out)
