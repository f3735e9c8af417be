"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints are grouped by equality first. For a radius r, 2^(r+1) - 1 structured bit
masks are drawn: bit i of a fingerprint gets a non-zero vector phi(i) of r + 1 bits, and
mask v keeps the bits with <phi(i), v> = 1. The phi(i) of at most r differing bits span at
most r dimensions, so some v is orthogonal to all of them: that mask drops every differing
bit and the pair collides in its table. No pair within the radius is missed.

Members of a bucket are compared bit by bit. A bucket of many fingerprints is dealt into the
tables of another family of masks, on top of the bits it has fixed: its pairs within the radius
collide there again, and about half of the free bits are fixed each time, so buckets end small
without losing a pair.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, bounded, end, fresh, look_up, map_texts, materialize, pieces, text_of
from tidemark.llm.components import components

BITS = 64
#: Fingerprints of a bucket whose pairs are compared; larger buckets are dealt into more tables.
BUCKET = 64
#: Families of masks that a bucket is dealt by at most; what is left then has almost no free bits.
LEVELS = 12


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included: A-Z lower-cased, joined by one space.

    Fewer words than a shingle has: the whole sequence; none: empty.
    """
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(own[k:] for k in range(words))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, len(own) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64 bits: a bit is 1 if it is set in over half of the hashes; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # long texts in bounded pieces
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, word shingles with repeats, XXH64 seed 42; no words: zero."""
    return simhash(shingle_hashes(text, words))


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, make, {"fp": pa.int64()}, "fp long")


def covering_masks(radius: int = 2, level: int = 0) -> list[int]:
    """The masks of a level's family as signed longs.

    phi runs through the non-zero vectors evenly over the bits, in another order at each level, so every mask
    keeps about half of the bits, whichever are still free.
    """
    kinds = (1 << (radius + 1)) - 1
    order = list(range(BITS))
    if level:
        random.Random(level).shuffle(order)
    phi = [1 + order[i] % kinds for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if bin(phi[i] & v).count("1") % 2) for v in range(1, kinds + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2, most: int = BUCKET, family=covering_masks) -> DataFrame:
    """(u, v), u > v: every pair of fingerprints that differ in 1 to `radius` bits, once.

    prints: distinct long column fp; radius is 0 or more, at a cost of 2^(radius + 1) - 1 tables. Candidates are
    the members of the masks' buckets, links those that a bit count confirms. A bucket of more than `most`
    fingerprints is dealt on by the masks of the next level, so no group is compared all with all.
    """
    open_ = prints.select("fp", F.lit(0).cast("long").alias("fixed"))
    found = []
    for level in range(LEVELS):
        masks = F.array(*map(F.lit, family(radius, level)))
        rows = open_.select("fp", F.explode(masks).alias("mask"), "fixed").select("fp", F.col("fixed").bitwiseOR(F.col("mask")).alias("fixed"))
        if level:
            rows = rows.distinct()  # several ways may fix the same bits
        # A bucket: the bits that are fixed and their values. It is told apart by its count, never a list.
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("fixed")))
        sizes = materialize(rows.groupBy("fixed", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        total = sizes.agg(F.sum("n")).first()[0]
        if not total:
            break
        met = look_up(rows, sizes, ["fixed", "key"], "bucket", total, how="inner")
        met = materialize(met.select("fp", "fixed", "key", F.col("bucket.n").alias("n")), "met")
        small = met if level == LEVELS - 1 else met.filter(F.col("n") <= most)
        u, v = (small.select("fixed", "key", F.col("fp").alias(side)) for side in "uv")
        near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
        found.append(u.join(v, ["fixed", "key"]).filter((F.col("u") > F.col("v")) & near).select("u", "v"))
        open_ = met.filter(F.col("n") > most).select("fp", "fixed")
        if open_.isEmpty():
            break
    if not found:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0].distinct()


def near_groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) from a written table (id, fp): one row for each of its rows, as near_dedup() says."""
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    found = materialize(components(links(classes.select("fp"), radius)), "found")
    placed = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("all"))
    # Rows that are alone in their component need no look-up.
    known = placed.join(roots.filter(F.col("all") > 1), "component").select("fp", "component_id", "n")
    known = materialize(known, "known")
    out = look_up(prints.select("id", "fp"), known, ["fp"], "known", classes.agg(F.sum("n")).first()[0] or 0)
    return out.select("id", "fp", F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("known.component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): one row per row of docs, from whole texts of any length.

    component_id is the smallest id among all rows reachable over links of at most radius
    differing bits. Null texts count as empty; texts without words have fingerprint zero and
    link like any other. Repeated rows stay repeated. A null id takes part in links but is
    nobody's component_id unless no other id is in its component, which is then null.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    prints = materialize(_fingerprints(rows, words).withColumnRenamed("doc_id", "id"), "prints")
    return near_groups(prints, radius).withColumnRenamed("id", id_col)


# Near copies beyond a radius of whole-text fingerprints ------------------------------------------

#: Slots of the table that estimates how common a shingle is, and slots of a row of it. They decide costs only.
SLOTS = 1 << 18
SLOT_ROW = 1 << 12
#: Longs of the short sketch that hot buckets are sifted by, and texts of a hot bucket that all others are compared with.
SHORT = 16
HEADS = 24
#: Comparisons a row of all buckets beyond which hot buckets are thinned by HEADS first; this decides costs only.
DENSE = 16
#: Pairs that fetch one text or sketch from one place; a text that more pairs ask for is copied.
ASKED = 4096
#: Characters from which a text's shingles are remembered only for the next few pairs.
LONG = 1 << 16


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def common(texts: DataFrame, words: int) -> np.ndarray:
    """Texts with a shingle that falls into each slot: common shingles have high counts, rare ones the average."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        seen = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for batch in pieces(whole):
                for t in batch.column("text").to_pylist():
                    np.add.at(seen, slots(np.unique(shingle_hashes(t, words))), 1)
        rows = [r.tobytes() for r in seen.astype("<u4").reshape(-1, SLOT_ROW)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["part", "seen"])
        end()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOT_ROW, np.int64)
        for batch in batches:
            for r in batch.column("seen").to_pylist():
                sums += np.frombuffer(r, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "seen"])

    parts = bounded(texts).select("text").mapInArrow(count, "part int, seen binary")
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.int64)
    for r in parts.groupBy("part").applyInArrow(add, "part int, seen binary").collect():  # 2 MB, whatever the input
        out[r.part] = np.frombuffer(r.seen, np.int64)
    return out.ravel()


def rare_first(own: np.ndarray, seen: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """Of a text's distinct shingles: those of its probing prefix, rarest first, and how many of them are its index prefix.

    Of two texts x, y with this similarity and |x| <= |y|, at least 2 s / (1 + s) |x| and s |y| shingles are
    shared, so in any common order the first |x| - ceil(2 s / (1 + s) |x|) + 1 of x and the first
    |y| - ceil(s |y|) + 1 of y have one in common.
    """
    n = len(own)
    if not n:
        return own, 0
    order = np.lexsort((own, seen[slots(own)]))
    probe, index = (n - math.ceil(n * x - 1e-6) + 1 for x in (similarity, 2 * similarity / (1 + similarity)))
    return own[order[:probe]], index


def sketch(own: np.ndarray, least: int = 64) -> bytes:
    """The parity of how many of the distinct shingles fall into each bit, at two to four bits a shingle, or `least` bits."""
    width = max(least, 1 << (2 * len(own) - 1).bit_length() if len(own) else 0)
    ones = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones, bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded: never more than the sets differ in elements."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def short(bits: bytes) -> np.ndarray:
    """A sketch of at least as many bits, folded to SHORT longs: it still differs in no more bits than the sets in elements."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, 8 * SHORT), axis=0).view("<i8")


def _signed(rows: DataFrame, words: int, seen: np.ndarray, similarity: float) -> DataFrame:
    """(id, doc_id, sha, fp, size, index, toks, bits, short) of rows (id, doc_id, sha, text): what the links are found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for whole in batches:
            for batch in pieces(whole):
                all_ = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
                sets = [np.unique(x) for x in all_]
                found, bits = [rare_first(x, seen, similarity) for x in sets], [sketch(x, 64 * SHORT) for x in sets]
                own = {
                    "fp": pa.array(np.array([simhash(x) for x in all_], np.uint64).view(np.int64)),
                    "size": pa.array([len(x) for x in sets], pa.int32()),
                    "index": pa.array([n for _, n in found], pa.int32()),
                    "toks": pa.array([x.view(np.int64) for x, _ in found], pa.list_(pa.int64())),
                    "bits": pa.array(bits, pa.binary()),
                    "short": pa.array([short(x) for x in bits], pa.list_(pa.int64())),
                }
                kept = ["id", "doc_id", "sha"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own.values()], names=[*kept, *own])
        end()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"id long, doc_id {kind}, sha string, fp long, size int, index int, toks array<long>, bits binary, short array<long>")


def _with(pairs: DataFrame, facts: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Written pairs (u, v) with columns of facts (id, ...): names maps one to its names for u and v.

    What many pairs ask for is copied to as many places, so no task gets all pairs of a hub.
    """
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("id")) for side in "uv"))
    crowds = pairs.select(F.explode(ends).alias("e")).groupBy("e.side", "e.id").agg(F.count("*").alias("n")).filter(F.col("n") > ASKED)
    crowds, dealt = materialize(crowds, "crowds"), pairs.select("u", "v")
    total = crowds.agg(F.sum("n")).first()[0]
    for k, side in enumerate("uv"):
        held = facts.select(F.col("id").alias(side), *(F.col(c).alias(new[k]) for c, new in names.items()))
        if not total:
            dealt = dealt.join(held, side)
            continue
        own = materialize(crowds.filter(F.col("side") == side).select(F.col("id").alias(side), F.ceil(F.col("n") / F.lit(float(ASKED))).cast("int").alias("places"), "n"), "crowd")
        place = F.coalesce(F.pmod(F.xxhash64("u", "v"), F.col("many.places")).cast("int"), F.lit(0)).alias("place")
        dealt = look_up(dealt, own, [side], "many", total).select(*dealt.columns, place)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)).alias("place")
        held = held.join(own.drop("n"), side, "left").select(*held.columns, copies)
        dealt = dealt.join(held, [side, "place"]).drop("place")
    return dealt


def _verified(pairs: DataFrame, signed: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of ids whose whole texts have the similarity. Sketches rule most others out before any text moves."""
    share = (1 - similarity) / (1 + similarity)
    facts = signed.select("id", "size", "bits").dropDuplicates(["id"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("su", "sv", "bu", "bv"))
            fits = [differ(a, b) <= share * (m + n) + 1e-6 for m, n, a, b in zip(*cols, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    both = _with(pairs, facts, {"size": ("su", "sv"), "bits": ("bu", "bv")})
    left = materialize(both.select("u", "v", "su", "sv", "bu", "bv").mapInArrow(possible, "u long, v long"), "possible")
    asked = left.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = materialize(rows.select("id", "text").join(asked, "id", "left_semi").dropDuplicates(["id"]), "texts")
    both = _with(left, texts, {"text": ("tu", "tv")})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        few, more = (lru_cache(n)(lambda t: np.unique(shingle_hashes(t, words))) for n in (2, 64))
        of = lambda t: (few if len(t) >= LONG else more)(t)
        for whole in batches:
            for batch in pieces(whole, "tu", "tv"):
                fits = []
                for x, y in zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), strict=True):
                    p, q = of(x), of(y)
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    fits.append(shared > 0 and shared >= similarity * (len(p) + len(q) - shared))
                yield batch.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))
        few.cache_clear()
        more.cache_clear()
        end()

    return both.select("u", "v", "tu", "tv").mapInArrow(verify, "u long, v long")


def _similar(signed: DataFrame, rows: DataFrame, words: int, similarity: float, most: int = BUCKET) -> DataFrame:
    """(u, v) links of row keys whose components are those of all pairs of texts with this Jaccard similarity of word shingles.

    rows: (id, text), a long id for each distinct text; signed: their written _signed() table. Whole-text fingerprints
    of two texts with a similarity of 0.8 differ in some ten bits, which no affordable covering reaches. Two such
    texts share a shingle of their prefixes (rare_first), whatever the order of shingles; rarest first, a passage
    that many texts share is in a prefix only if it is most of the text.
    First each text is compared with two texts of each bucket: the one with the most company over all its
    buckets (in a group of edited copies the original, which shares most) and the one with the smallest id. That
    joins groups of copies without their pairs. Then all pairs of a bucket that these links have not joined are
    candidates, if their lengths allow the similarity, so no pair depends on the two. Buckets of up to `most`
    texts with the same members, as near copies have many, count once. Where larger ones would make most of the work,
    all texts are first compared with HEADS of a bucket, which joins dense groups of copies; what is left there needs room behind the shared shingle in both
    texts and short sketches that allow the similarity. Every link is verified on whole texts.
    """
    own = signed.dropDuplicates(["id"])
    tables = own.select("id", "size", "index", F.posexplode("toks").alias("at", "tok")).select("tok", "id", "size", "at", (F.col("at") < F.col("index")).alias("lead"))
    shared = materialize(tables.groupBy("tok").agg(F.count("*").alias("n"), F.bool_or("lead").alias("led")).filter("led and n > 1").drop("led"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    met = look_up(tables, shared, ["tok"], "bucket", total, how="inner")
    met = materialize(met.select("tok", "id", "size", "at", "lead", F.col("bucket.n").alias("n")), "met")

    def room(a, b):  # enough of both texts from this shingle on, which rules out unlike lengths too
        least = F.ceil((a["size"] + b["size"]) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
        return (a["size"] - a["at"] >= least) & (b["size"] - b["at"] >= least)

    company = met.groupBy("id").agg(F.sum("n").alias("company"))
    leaders = met.join(company, "id").groupBy("tok").agg(
        F.max(F.struct("company", "id", "size", "at")).alias("x"), F.min(F.struct("id", "size", "at")).alias("y"), F.count("*").alias("n")
    )
    heads = F.array(*(F.struct(h["id"].alias("id"), h["size"].alias("size"), h["at"].alias("at")) for h in (F.col("led.x"), F.col("led.y"))))
    pairs = look_up(met.drop("n"), materialize(leaders, "leaders"), ["tok"], "led", total).select(F.struct("id", "size", "at").alias("x"), F.explode(heads).alias("y"))
    pairs = pairs.filter((F.col("x.id") != F.col("y.id")) & room(F.col("x"), F.col("y")))
    pairs = materialize(pairs.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct(), "pairs")
    first = materialize(_verified(pairs, signed, rows, words, similarity), "links")

    def unjoined(found: DataFrame) -> DataFrame:
        """met in the buckets that hold several components of the links found, with the component and the bucket's size."""
        joined = components(found).withColumnRenamed("node", "id")
        placed = met.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = placed.groupBy("tok").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a < b").select("tok", "n")
        placed = look_up(placed.drop("n"), materialize(open_, "unjoined"), ["tok"], "bucket", total, how="inner")
        return materialize(placed.withColumn("n", F.col("bucket.n")).drop("bucket"), "open")

    share = (1 - similarity) / (1 + similarity)
    bits = lambda x, y: reduce(add, (F.bit_count(x["short"][k].bitwiseXOR(y["short"][k])) for k in range(SHORT)))
    sifted = lambda x, y: (x["component"] != y["component"]) & room(x, y) & (bits(x, y) <= share * (x["size"] + y["size"]) + 1e-6)
    facts = ("id", "size", "at", "lead", "component", "short")

    def crowded(placed: DataFrame) -> DataFrame:
        return placed.filter(F.col("n") > most).join(own.select("id", "short"), "id")

    placed = unjoined(first)
    work = placed.filter((F.col("n") > most) & F.col("lead")).agg(F.sum("n")).first()[0] or 0
    if work > DENSE * total:
        # In a large bucket's dense groups most texts are alike to some of a few texts taken by hash: no pairs are needed for these.
        crowd = materialize(crowded(placed), "crowd")
        ways = F.pmod(F.xxhash64("id"), F.lit(HEADS)).alias("way")
        heads = crowd.groupBy("tok", ways).agg(F.min(F.struct(*facts)).alias("y"), F.count("*").alias("n"))  # one of each HEADS-th part
        heads = materialize(heads.groupBy("tok").agg(F.collect_list("y").alias("heads"), F.sum("n").alias("n")), "heads")
        led = look_up(crowd.drop("n"), heads, ["tok"], "led", total, how="inner").withColumn("x", F.struct(*facts))
        near = led.select("x", F.explode(F.filter("led.heads", lambda y: sifted(F.col("x"), y))).alias("y"))
        tried = near.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct()
        tried = materialize(tried.join(pairs, ["u", "v"], "left_anti"), "tried")
        first = materialize(first.unionByName(_verified(tried, signed, rows, words, similarity)), "links")
        pairs = pairs.unionByName(tried)
        placed = unjoined(first)

    def apart(x, y):
        shorter = F.struct(x["size"], x["id"]) < F.struct(y["size"], y["id"])
        return shorter & x["lead"] & (x["component"] != y["component"]) & (x["size"] >= F.ceil(y["size"] * F.lit(similarity) - F.lit(1e-6)))

    named = lambda x, y: (F.greatest(x["id"], y["id"]).alias("u"), F.least(x["id"], y["id"]).alias("v"))
    member = F.struct("id", "size", "lead", "component")
    alike = placed.filter(F.col("n") <= most).groupBy("tok").agg(F.array_sort(F.collect_list(member)).alias("ms"))  # `most` rows at most
    alike = materialize(alike.select("ms").distinct(), "members")
    few = alike.select(F.explode("ms").alias("x"), "ms").select("x", F.explode(F.filter("ms", lambda y: apart(F.col("x"), y))).alias("y"))
    x, y = (crowded(placed).select("tok", F.struct(*facts).alias(side)) for side in "xy")
    many = x.filter("x.lead").join(y, "tok").filter(apart(F.col("x"), F.col("y")) & sifted(F.col("x"), F.col("y")))
    more = few.select(*named(F.col("x"), F.col("y"))).unionByName(many.select(*named(F.col("x"), F.col("y"))))
    more = materialize(more.distinct().join(pairs, ["u", "v"], "left_anti"), "pairs")
    return first.unionByName(_verified(more, signed, rows, words, similarity))


def _keyed(docs: DataFrame, name: str, words: int, similarity: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with a long column `name` (a hash of id and text, the key of a row), its texts by key, and their _signed() table."""
    for salt in range(8):
        keyed = docs.withColumn(name, F.xxhash64(F.lit(salt), docs["doc_id"], text_of(docs)))
        rows = keyed.select(F.col(name).alias("id"), docs["doc_id"].alias("doc_id"), F.sha2(text_of(docs), 256).alias("sha"), text_of(docs).alias("text"))
        seen = common(rows, words) if similarity is not None else np.zeros(SLOTS, np.int64)
        signed = materialize(_signed(rows, words, seen, similarity or 1.0), "signed")
        own = F.struct("doc_id", "sha")
        if signed.groupBy("id").agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a <> b").isEmpty():
            return keyed, rows, signed
    raise RuntimeError("no salt tells the rows apart")  # two of them share a key by chance, each time


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(u, v) pairs of doc_ids, larger first: links whose components are those of all texts with this similarity.

    Each text of a doc_id that names several is compared; null ids and links within one id are left out.
    """
    _, rows, signed = _keyed(docs, fresh("key", docs), words, similarity)
    ids = signed.select("id", "doc_id").distinct()
    ends = [ids.select(F.col("id").alias(side), F.col("doc_id").alias(f"id_{side}")) for side in "uv"]
    found = _similar(signed, rows, words, similarity).join(ends[0], "u").join(ends[1], "v").filter("id_u <> id_v")
    return found.select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v")).distinct()


def keep_one(docs: DataFrame, words: int = 5, radius: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays, whole.

    Groups join texts whose fingerprints lie within the radius and, with a similarity, those that similar_links()
    finds; texts of any length count whole, null as empty, and texts without words are alike. Rows are told apart
    by doc_id and text: of rows that repeat both one stays, each text of a doc_id that names several is compared on
    its own (of those in a group with one doc_id one stays, the same in each run), and null ids take part but stay
    only in groups without another id. An empty table stays empty; other columns, of whatever name, are carried along.
    """
    name, about = fresh("key", docs), fresh("about", docs)
    keyed, rows, signed = _keyed(docs, name, words, similarity)
    near = near_groups(signed, radius).filter("id <> component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    if similarity is not None:
        near = near.unionByName(_similar(signed, rows, words, similarity))
    groups = components(near).withColumnRenamed("node", "id")
    per_row = signed.groupBy("id", "doc_id").agg(F.count("*").alias("n"))
    placed = materialize(per_row.join(groups, "id", "left"), "placed")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("id")))["id"]
    heads = materialize(placed.filter("component is not null").groupBy("component").agg(best.alias("stays"), F.count("*").alias("n")), "heads")
    total = placed.count()
    gone = look_up(placed.drop("n").filter("component is not null"), heads, ["component"], "head", total).filter("id <> head.stays").select("id")
    known = placed.filter("n > 1").select("id", "n", F.lit(False).alias("gone")).join(gone, "id", "left_anti")
    known = known.unionByName(placed.join(gone, "id").select("id", "n", F.lit(True).alias("gone")))
    known = materialize(known.withColumnRenamed("id", name), "known")
    out = look_up(keyed, known, [name], about, signed.count())
    out = out.filter(F.col(about).isNull() | ~F.col(f"{about}.gone"))
    if known.filter("not gone").isEmpty():
        return out.drop(name, about)
    once = out.filter(F.col(about).isNotNull()).dropDuplicates([name])  # equal rows: merged before they move
    return out.filter(F.col(about).isNull()).unionByName(once).drop(name, about)


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    out = near_dedup(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
