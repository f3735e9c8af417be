"""Fingerprints, links, components, exact groups: against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidemark.llm import exact, simhash
from tidemark.llm.common import look_up, materialize
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d a b c", "ÀÉ x\u00a0y Z", "x\u3000y z w " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text, 3)
    assert simhash.fingerprint(text, 5) == plain_fingerprint(text, 5)


def test_long_fingerprint_in_pieces():
    text = " ".join(str(k % 977) for k in range(70_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text, 3)


def test_spark_hashes_alike(spark):
    got = spark.createDataFrame([("the cat sat",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat", 42)


@pytest.mark.parametrize("level", [0, 1, 5])
@pytest.mark.parametrize("radius", [1, 2])
def test_covering(radius, level):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(radius, level)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for a in range(64):
        for b in range(64):
            diff = (1 << a) | ((1 << b) if radius == 2 else 0)
            assert any(not m & diff for m in masks)
    assert all(20 <= bin(m).count("1") <= 45 for m in masks)


def plain_components(nodes, linked):
    nodes, seen, out = sorted(nodes), set(), {}
    for n in nodes:
        if n in seen:
            continue
        todo, group = [n], []
        seen.add(n)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in nodes:
                if y not in seen and linked(x, y):
                    seen.add(y)
                    todo.append(y)
        out |= dict.fromkeys(group, min(group))
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_of_random_fingerprints(spark, radius):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(6)):  # chains and clusters near it
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.component for r in components(simhash.links(df, radius)).collect()}
    want = plain_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= radius)
    assert {x: found.get(x, x) for x in signed} == want


def close(fps, radius):
    return {(a, b) for a in fps for b in fps if a > b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}


def test_links_need_each_mask(spark):
    """Links come from the tables: each pair of bits is covered by few masks, and without one of them its pairs are lost."""
    rng = random.Random(2)
    masks = simhash.covering_masks(2)
    fps = set()
    for a in range(0, 64, 3):
        for b in range(a):
            x = rng.getrandbits(62)
            fps |= {x, x ^ (1 << a) ^ (1 << b) if a < 62 and b < 62 else x}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = close(fps, 2)
    assert {(r.u, r.v) for r in simhash.links(df).collect()} == want and len(want) > 500
    for gone in (0, 4):
        got = {(r.u, r.v) for r in simhash.links(df, family=lambda r, level: [m for k, m in enumerate(masks) if k != gone]).collect()}
        assert got < want


def test_links_of_a_hot_bucket(spark):
    """Fingerprints that differ in a few low bits only share buckets; dealing them on loses no pair."""
    rng = random.Random(4)
    base = rng.getrandbits(62)
    fps = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(5))) for _ in range(500)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius in (1, 2, 3):
        got = [(r.u, r.v) for r in simhash.links(df, radius, most=8).collect()]
        assert set(got) == close(fps, radius) and len(got) == len(set(got))


def test_hot_keys_are_looked_up(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else str(k)) for k in range(6000)], "id long, key string")
    known = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")), "known")
    for total in (6000, 60):  # with 60 rows each key is hot
        out = look_up(rows, known, ["key"], "k", total)
        want = {"hot": 1, None: 3}
        assert sorted((r.id, r.k.least) for r in out.collect()) == [(k, want[key] if (key := "hot" if k % 3 else None if k % 2 else str(k)) in want else k) for k in range(6000)]
    some = materialize(known.filter("n > 1"), "some")
    assert {r.id for r in look_up(rows, some, ["key"], "k", 6000).filter("k is null").collect()} == set(range(0, 6000, 6))


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(30)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    pairs = {frozenset(e) for e in edges}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert found == plain_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_op1_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t, 3) for i, t in rows.items()}
    want = plain_components(rows, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    got = simhash.op1(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in rows}
    assert len(got) == len(rows)


def test_near_dedup_of_odd_rows(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (None, "alpha beta"), (9, "alpha beta"), (9, "alpha beta"), (1, "x"), (None, None)]
    df = docs_of(spark, rows).withColumn("id", F.lit("clash")).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_dedup(df).collect()), key=str)
    assert got == sorted([(3, 3), (4, 3), (5, 3), (None, 9), (9, 9), (9, 9), (1, 1), (None, 3)], key=str)
    assert simhash.op1(docs_of(spark, [])).count() == 0


def jaccard(a, b, k=5):
    x, y = (set(simhash.shingle_hashes(t, k).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def near_corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    out, texts = [], []
    for n in (12, 30, 60, 120, 300, 900):
        for _ in range(6):
            texts.append([rng.choice(words) for _ in range(n)])
    shared = [rng.choice(words) for _ in range(60)]  # a passage that unlike texts share
    texts += [[rng.choice(words) for _ in range(200)] + shared + [rng.choice(words) for _ in range(200)] for _ in range(12)]
    for t in texts:
        out.append(" ".join(t))
        for edits in range(rng.randrange(3)):
            c = list(t)
            for _ in range(1 + edits + len(t) // 120):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return list(enumerate(out))


def test_similar_links(spark):
    rows = near_corpus()
    docs = docs_of(spark, rows)
    got = {(r.v, r.u) for r in simhash.similar_links(docs).collect()}
    alike = {(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= 0.8}
    assert got <= alike
    linked = plain_components([i for i, _ in rows], lambda a, b: (min(a, b), max(a, b)) in got)
    want = plain_components([i for i, _ in rows], lambda a, b: (min(a, b), max(a, b)) in alike)
    assert linked == want and len(alike) > 10
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_similar_links_in_hot_buckets(spark):
    """Texts that share 70 to 85 % of their words are unlike, near copies among them are all found."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    block = [rng.choice(words) for _ in range(340)]
    texts = []
    for k in range(160):
        shared = block[: rng.randrange(280, 341)]
        t = shared + [f"u{k}x{j}" for j in range(400 - len(shared))]
        cut = rng.randrange(len(t))
        t = t[cut:] + t[:cut]
        texts.append(" ".join(t))
        if k % 4 == 0:
            c = list(t)
            for at in rng.sample(range(400), 6):  # each edit changes up to five of 396 shingles
                c[at] = f"e{k}x{at}"
            texts.append(" ".join(c))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert 40 <= len(alike) < 100
    got = {(r.u, r.v) for r in simhash.similar_links(docs_of(spark, rows)).collect()}
    assert got == alike
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, rows)).collect()}
    fps = [plain_fingerprint(t, 5) for t in texts]
    want = plain_components(range(len(rows)), lambda a, b: (max(a, b), min(a, b)) in alike or bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert kept == set(want.values())


def test_sketches_never_overstate():
    rng = np.random.default_rng(1)
    for n, m, shared in [(0, 0, 0), (1, 0, 0), (30, 500, 20), (400, 400, 380), (3000, 90, 0)]:
        pool = rng.integers(0, 2**64 - 1, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
        x, y = simhash.sketch(a), simhash.sketch(b)
        assert simhash.differ(x, y) == simhash.differ(y, x) <= len(np.setxor1d(a, b))
        p, q = (simhash.short(simhash.sketch(s, 64 * simhash.SHORT)) for s in (a, b))
        assert len(p) == simhash.SHORT and np.bitwise_count((p ^ q).view("<u8")).sum() <= len(np.setxor1d(a, b))


def test_near_copies_under_shared_boilerplate(spark):
    """Pairs of 0.95 among texts that all share 85 % of their shingles: every pair is joined, no others are."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    shared = [rng.choice(words) for _ in range(850)]
    texts = []
    for k in range(60):
        own = shared + [f"p{k}x{j}" for j in range(150)]
        other = list(own)
        for at in rng.sample(range(1000), 4):
            other[at] = f"q{k}x{at}"
        texts += [" ".join(own), " ".join(other)]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs_of(spark, enumerate(texts)), radius=0).collect())
    assert jaccard(texts[0], texts[1]) > 0.9 and jaccard(texts[0], texts[2]) < 0.8
    assert kept == list(range(0, 120, 2))


def test_dense_groups_and_hubs(spark, monkeypatch):
    """Many edited copies of one text, few of them alike to any one: buckets are large, and each text's pairs are dealt out."""
    monkeypatch.setattr(simhash, "ASKED", 5)
    monkeypatch.setattr(simhash, "HEADS", 3)
    monkeypatch.setattr(simhash, "DENSE", 0)
    rng = random.Random(14)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for k in range(150):
        c = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            c[at] = f"e{k}x{at}"
        texts.append(" ".join(c))
    rows = list(enumerate(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = {(i, j) for i in range(150) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r.u, r.v) for r in simhash.similar_links(docs_of(spark, rows)).collect()}
    assert got <= alike and 100 < len(alike)
    same = [plain_components(range(150), lambda a, b, x=x: (max(a, b), min(a, b)) in x) for x in (got, alike)]
    assert same[0] == same[1] and len(set(same[0].values())) > 3


def test_each_text_of_an_id_is_compared(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    a, b = words(200), words(40)
    edited = [*a, "more"]
    rows = [(1, " ".join(a)), (5, " ".join(edited)), (5, " ".join(b)), (None, " ".join(["less", *a])), (None, " ".join(b[:-1])), (None, "quite other words")]
    assert {(r.u, r.v) for r in simhash.similar_links(docs_of(spark, rows)).collect()} == {(5, 1)}
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[5]], key=str)


def test_keep_one_of_odd_rows(spark):
    long = " ".join(f"t{k % 5003}" for k in range(60_000))
    rows = [(4, None), (3, ""), (None, " "), (7, "x y"), (7, "x y"), (7, "x y z"), (None, "u v"), (None, "u v"), (8, long), (9, long + " end")]
    df = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("key", "about", "id", "fp", "n", "gone", "component", "sha", "_key")})
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, ""), (7, "x y"), (7, "x y z"), (None, "u v"), (8, long)], key=str)


def test_keep_one_keeps_rows_whole(spark):
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, "z " * 9), (None, "q r s")]
    out = simhash.keep_one(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (7, "z " * 9), (None, "q r s")], key=str)
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


# Exact ---------------------------------------------------------------------------------------------


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (5, None), (6, ""), (8, "\u00a0"), (8, "\u00a0"), (None, "lone"), (10, "x" * 50_000), (11, "x" * 50_000)]


def test_exact_odd_rows(spark):
    df = docs_of(spark, ODD).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(1)).withColumn("salt", F.lit(1))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.op5(df).collect()]
    assert sorted(got, key=str) == plain_exact(ODD)
    assert exact.op5(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("salts", [1, 7])
def test_exact_compares_contents(spark, salts):
    """With one digest for all, contents alone decide."""
    out = exact.exact_dedup(docs_of(spark, ODD), salts, digest=lambda t: F.lit("same"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()]
    assert sorted(got, key=str) == sorted([x[:4] for x in plain_exact(ODD)], key=str)


def test_exact_matches_sql(spark, sf_dir, duck):
    assert same_rows(exact.op5(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck, exact.SQL) > 0


def test_keep_first(spark):
    out = exact.keep_first(docs_of(spark, ODD))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = sorted([(1, "a\tb"), (2, "a b "), (5, None), (8, "\u00a0"), (None, "lone"), (10, "x" * 50_000)], key=str)
    assert got == want
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_numpy_bits_are_in_order():
    h = np.array([1, 1 << 63], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    assert bits[0, 0] == 1 and bits[1, 63] == 1
