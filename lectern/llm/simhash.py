"""SimHash near-dedup by covering locality-sensitive hashing.

Each document gets a 64-bit fingerprint of its 3-word shingles. Bit i of the fingerprint is given one of the
2^(r+1) - 1 non-zero vectors m(i) over GF(2); table v keeps the bits with <m(i), v> = 1. Two fingerprints that
differ in r bits at most leave, for some non-zero v, all those bits out of table v (r equations, r + 1
unknowns), so every pair within the radius collides in some table and none is lost.

That serves texts that are all but equal. A similarity of 0.8 of two shingle sets is some ten bits of a
fingerprint, which no such family can afford, so `near_texts` lays the masks on the sets themselves: mask i keeps
the shingles of part i, and sets that differ in fewer shingles than there are parts agree under some mask. The few
masks that a set is held under find almost all pairs; `rest_links` finds those that they leave apart, by the prefixes
of the sets in one order of all shingles, so that no similar pair is lost.

Tables hold distinct fingerprints. A bucket of up to `SMALL` of them is compared pair by pair. In a larger one
two fingerprints within distance 2 share a midpoint: themselves or a one-bit change of a bit that the table
leaves out. Those midpoints are linked as stars, which costs a fixed number of rows for each member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slots_for, small_batches, split_by_sieve, texts_of, utf8
from lectern.llm.graph import components
from lectern.session import discard, materialise

#: Distinct fingerprints in a bucket up to which its pairs are compared one by one.
SMALL = 32
RADIUS = 2
BITS = 64


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering family: one bit mask for each non-zero vector of radius + 1 bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text: bit i is 1 if it is set in over half the shingles' XXH64 (seed 42).

    A-Z are lower-cased; words part at ASCII white space; repeats of a shingle count; fewer words than a shingle
    make one shingle of all; no words give zero.
    """
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    step = 1 << 16  # shingles at a time, so a long text needs no more memory than a short one
    for a in range(0, n, step):
        part = words[a : min(a + step, n) + shingle - 1]
        found = [xxh64_intdigest(b" ".join(t), 42) for t in zip(*(part[k:] for k in range(shingle)))]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null texts count as empty."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw, shingle) for raw in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(compute, "id long, fp long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose closure is that of all pairs within `radius` (2) bits.

    `nodes` has one row per fingerprint, in column fp.
    """
    if radius > 2:
        raise ValueError("large buckets are linked through midpoints, which reach two bits")
    family = [_signed(m) for m in masks(radius)]
    tables = F.array(*[F.struct(F.lit(v).cast("tinyint").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(family)])
    keyed = nodes.select("fp", F.explode(tables).alias("t")).select("fp", "t.v", "t.key")
    crowded = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(keyed.join(crowded, ["v", "key"]), "simhash-buckets")
    small = members.filter(F.col("n") <= SMALL)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = small.alias("x").join(small.alias("y"), [F.col("x.v") == F.col("y.v"), F.col("x.key") == F.col("y.key"), F.col("x.fp") < F.col("y.fp"), near])
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    stars = members.filter(F.col("n") > SMALL)
    for_table = F.array(*[F.array(*[F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks(radius)])
    spread = stars.select("v", "fp", F.explode(F.element_at(for_table, F.col("v").cast("int") + 1)).alias("flip")).select("v", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
    hubs = spread.groupBy("v", "mid").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("v", "mid", "hub")
    starred = spread.join(hubs, ["v", "mid"]).filter("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.union(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 lowercase hex digits), component_id, copies.

    Documents whose fingerprints differ in `radius` bits at most are linked; component_id is the least id
    reachable, and copies the number of rows in that component. Null and empty texts have fingerprint zero and
    link like any other; repeated rows stay; null ids are kept but never name a component unless it has no
    other; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "fingerprint-nodes")
    roots = components(links(nodes, radius), "a", "b")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("copies"))
    classes = materialise(rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "copies"), "fingerprint-classes")
    out = prints.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


#: Masks that a set is held under. Of two sets of similarity 0.8 a mask shows no difference with a chance of 0.37
#: or more, so all of them miss a pair with 1 in 10,000 at most, and none where the parts are no more than these.
MASKS = 20
#: Sets under one mask and key up to which all pairs are compared.
FEW = 4
#: Slots in which shingles are counted to order them by rarity, a fixed number.
SLOTS = 1 << 17
#: Slots of a set's parities, of which the bits go before the sets.
PARITY = 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def size_class(n: int, similarity: float) -> int:
    """The class of a set's size; sizes of similar sets are of one class or of neighbouring ones."""
    return math.floor(math.log(n) / -math.log(similarity) + 1e-9)


def mask_keys(grams: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a set of hashes: for its own size class and the one below, one for each mask that keeps any."""
    own, out = size_class(len(grams), similarity), []
    for c in (own - 1, own):
        if c < 0:
            continue
        # Sets of this class and of the next, as far as they are similar, differ in `most` elements at most.
        most = (1 + 1 / similarity) * similarity ** -(c + 1) * (1 - similarity) / (1 + similarity)
        parts = int(most) + 1
        part = _mixed(grams + np.uint64(2 * c + 1)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        order = order[: np.searchsorted(part[order], MASKS)]
        if len(order):
            at = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(_mixed(grams[order]), at)
                out.append(_mixed(sums + part[order][at] * np.uint64(257) + np.uint64(c) * np.uint64(65537)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes(raw: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of a text's distinct shingles, in order."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    k = min(shingle, len(words))
    found = {xxh64_intdigest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(k)))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate(arrays).view(kind)))


def _digested(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("digest"), text.alias("text"))


def shingle_sets(docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(digest, whole, keys, grams): each text's XXH64, a hash of its shingle set, its mask keys and the set itself.

    Shingles are those of `fingerprint`; grams has 32 bits of each hash, some of them twice where those are equal, for
    the search of candidates; `confirmed` compares whole hashes. A text without words has an empty set.
    """
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keys, grams = [], [], []
            for raw in utf8(batch.column("text")):
                h = _hashes(raw, shingle)
                with np.errstate(over="ignore"):
                    whole.append(int(_mixed(h).sum(dtype=np.uint64)) if len(h) else 0)
                keys.append(mask_keys(h, similarity) if len(h) else h)
                grams.append((h >> np.uint64(32)).astype(np.uint32))
            lists = [_lists(keys, np.int64), _lists(grams, np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.array(whole, np.uint64).view(np.int64)), *lists], names=["digest", "whole", "keys", "grams"])

    return _digested(docs, text_col).mapInArrow(compute, "digest long, whole long, keys array<long>, grams array<int>")


def parities(sets: DataFrame) -> DataFrame:
    """(whole, size, odd) of sets (whole, grams): the set's size, and as bits which of `PARITY` slots hold an odd number of it.

    Bits that differ between two sets are no more than the shingles that one of them alone has.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, odd = [], []
            for n, u in _gram_lists(batch):
                sizes.append(n)
                slots = (_mixed(u.astype(np.uint64)) % np.uint64(PARITY)).astype(np.int64)
                odd.append(np.packbits(np.bincount(slots, minlength=PARITY) % 2 == 1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(np.concatenate(odd)))
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(np.array(sizes, np.int32)), lists], names=["whole", "size", "odd"])

    return sets.select("whole", "grams").mapInArrow(compute, "whole long, size int, odd array<long>")


def may_be_similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`pairs` (a, b) without those whose sizes or parities say that they are not similar; no similar pair is dropped, and no set is shuffled."""
    wanted = pairs.select(F.col("a").alias("whole")).union(pairs.select("b"))
    marks = parities(split_by_sieve(sets, wanted, "whole")[0]).groupBy("whole").agg(F.any_value("size").alias("size"), F.any_value("odd").alias("odd"))
    marks = materialise(marks, "near-parities")
    x, y = (marks.withColumnsRenamed({"whole": k, "size": f"size_{k}", "odd": f"odd_{k}"}) for k in "ab")
    both = pairs.join(x, "a").join(y, "b")
    bits = F.aggregate(F.zip_with("odd_a", "odd_b", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)
    apart = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    fitting = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-6
    left = materialise(both.filter(fitting & (bits <= apart)).select("a", "b"), "near-likely")
    discard(marks)
    return left


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) of `pairs` whose sets reach the similarity as far as 32 bits of each hash tell; no similar pair is dropped."""
    met = materialise(pairs.distinct(), "near-candidates")
    pairs = may_be_similar(met, sets, similarity)
    wanted = pairs.select(F.col("a").alias("whole")).union(pairs.select("b"))
    held = materialise(split_by_sieve(sets, wanted, "whole")[0].groupBy("whole").agg(F.any_value("grams").alias("grams")), "near-sets")
    counted = held.withColumn("twice", F.size("grams") - F.size(F.array_distinct("grams")))
    x, y = (counted.withColumnsRenamed({"whole": k, "grams": g, "twice": f"twice_{k}"}) for k, g in ("ax", "by"))
    both = pairs.join(x, "a").join(y, "b")
    # Shingles of one set whose 32 bits are equal count once in what is shared, so so many more may be.
    shared = F.size(F.array_intersect("x", "y")) + F.least("twice_a", "twice_b")
    links = materialise(both.filter(shared >= (F.size("x") + F.size("y") - shared) * similarity).select("a", "b"), "near-links")
    discard(met, pairs, held)
    return links


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those (a, b) of `pairs` whose sets reach the similarity by their whole hashes, which are made again of the texts concerned."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hashes(raw, shingle) for raw in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), _lists(hashes, np.int64)], names=["digest", "hashes"])

    pairs = materialise(pairs.distinct(), "near-doubtful")
    wanted = materialise(pairs.select(F.col("a").alias("whole")).union(pairs.select("b")).distinct(), "near-wanted")
    named = split_by_sieve(sets.select("digest", "whole"), wanted, "whole")[0].join(wanted, "whole", "left_semi")
    named = materialise(named.groupBy("whole").agg(F.min("digest").alias("digest")), "near-named")
    touched = split_by_sieve(_digested(docs, text_col), named, "digest")[0]
    made = touched.mapInArrow(compute, "digest long, hashes array<long>").groupBy("digest").agg(F.any_value("hashes").alias("hashes"))
    held = materialise(made.join(named, "digest").select("whole", "hashes"), "near-whole")
    both = pairs.join(held.withColumnsRenamed({"whole": "a", "hashes": "x"}), "a").join(held.withColumnsRenamed({"whole": "b", "hashes": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = materialise(both.filter(shared >= (F.size("x") + F.size("y") - shared) * similarity).select("a", "b"), "near-confirmed")
    discard(pairs, wanted, named, held)
    return links


def _slot(grams: np.ndarray) -> np.ndarray:
    return (_mixed(grams.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _gram_lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The size of each row's set, and the 32 bits of its shingles, each once."""
    for x in batch.column("grams"):
        yield len(x), np.unique(x.values.to_numpy(zero_copy_only=False).view(np.uint32))


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets are in each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        for batch in batches:
            flat = batch.column("grams").flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            sums += np.bincount(_slot(flat), minlength=SLOTS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    summed = sets.select("grams").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for batch in summed.toArrow().to_batches():  # a fixed number of slots
        out[batch.column("slot").to_numpy()] = batch.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(whole, n, grams) of sets (whole, grams): the set's size and its first shingles, rare slots first.

    A set shares `similarity` of its shingles at least with any set that is similar, so in one order of all shingles
    the first that both have is among its first n - ceil(similarity n) + 1. If k of its n are the same 32 bits as
    others of it, n - k are left in the order, of which k less need be shared, so it is among as many as before.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first = [], []
            for n, u in _gram_lists(batch):
                upto = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                sizes.append(n)
                first.append(u[np.lexsort((u, counts[_slot(u)]))[:upto]].view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32)), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(np.array(sizes, np.int32)), lists], names=["whole", "n", "grams"])

    return sets.select("whole", "grams").mapInArrow(compute, "whole long, n int, grams array<int>")


def rest_links(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of sets (whole, grams), similar as far as 32 bits of a hash tell, whose ends have not one root in `roots` (node, root).

    Sets meet under each shingle of their prefixes under which more than one root stands, members of one root never
    among themselves; sizes and places then say which pairs may still be similar, and those are checked.
    """
    # Equal sets have equal prefixes, so the prefixes are made where the sets are and those alone are shuffled.
    distinct = prefixes(sets, slot_counts(sets), similarity).groupBy("whole").agg(F.any_value("n").alias("n"), F.any_value("grams").alias("grams"))
    named = distinct.join(roots, F.col("whole") == F.col("node"), "left")
    named = materialise(named.select("whole", "n", "grams", F.coalesce("root", "whole").alias("root")), "set-prefixes")
    placed = named.select("whole", "n", "root", F.posexplode("grams").alias("place", "gram"))
    ends = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = materialise(ends.filter("low < high").select("gram"), "mixed-shingles")
    met = materialise(split_by_sieve(placed, mixed, "gram", slots=slots_for(mixed.count()))[0].join(mixed, "gram"), "mixed-members")
    discard(named, mixed)
    groups = met.select("gram", "root").distinct()
    both = groups.withColumnRenamed("root", "root_a").join(groups.withColumnRenamed("root", "root_b"), "gram").filter("root_a < root_b")
    x, y = (met.withColumnsRenamed({c: f"{c}_{k}" for c in ("whole", "n", "place", "root")}) for k in "ab")
    pairs = both.join(x, ["gram", "root_a"]).join(y, ["gram", "root_b"])
    shared = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # at most, if none stands before
    least = (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-6
    near = pairs.filter((shared >= least) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-6))
    links = _similar(near.select(F.least("whole_a", "whole_b").alias("a"), F.greatest("whole_a", "whole_b").alias("b")), sets, similarity)
    discard(met)
    return links


def near_texts(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(digest, group): for each distinct text, by its XXH64, the group of texts it is near to.

    Texts whose sets of word shingles have a Jaccard similarity of `similarity` or more are linked, and groups are
    what links connect. Equal sets are one. First, sets that agree under a mask are compared: all pairs of up to `FEW`; in
    a crowd all with its densest member, the one with most company under its masks, which is where the
    variants of one text meet. What that member is near to leaves the crowd, the others go on until they are few or
    a round finds nothing. Then `rest_links` compares what this leaves apart, so that groups are those of all
    similar pairs. Both are searches by 32 bits of a hash that drop none; their links stand once `confirmed`. Null texts count as empty; texts without words are near each other; an empty table gives no rows.
    """
    sets = materialise(shingle_sets(docs, text_col, shingle, similarity), "shingle-sets")
    distinct = sets.groupBy("whole").agg(F.any_value("keys").alias("keys"))
    members = distinct.select("whole", F.explode("keys").alias("key"))
    met = members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    met, found = materialise(met, "mask-members"), []
    while True:
        few = met.filter(F.col("n") <= FEW)
        pairs = few.alias("x").join(few.alias("y"), "key").filter("x.whole < y.whole").select(F.col("x.whole").alias("a"), F.col("y.whole").alias("b"))
        crowds = met.filter(F.col("n") > FEW)
        if crowds.isEmpty():
            found.append(_similar(pairs, sets, similarity))
            discard(met)
            break
        company = crowds.groupBy("whole").agg(F.sum("n").alias("company"))
        centres = crowds.join(company, "whole").groupBy("key").agg(F.max(F.struct("company", "whole")).alias("c")).select("key", F.col("c.whole").alias("centre"))
        spokes = materialise(crowds.join(centres, "key"), "mask-crowds")
        starred = spokes.filter("whole != centre").select(F.least("whole", "centre").alias("a"), F.greatest("whole", "centre").alias("b"))
        links = _similar(pairs.union(starred), sets, similarity)
        found.append(links)
        linked = links.select(F.col("a").alias("whole")).union(links.select("b")).distinct()
        rest = spokes.filter("whole != centre").select("key", "whole").join(linked, "whole", "left_anti")
        rest = materialise(rest.join(rest.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "mask-rest")
        discard(met, spokes)
        if links.isEmpty() or rest.isEmpty():
            discard(rest)
            break
        met = rest
    edges = confirmed(reduce(DataFrame.union, found), sets, docs, text_col, shingle, similarity)
    first = materialise(components(edges, "a", "b"), "mask-groups")
    likely = rest_links(sets, first, similarity)
    rest = confirmed(likely, sets, docs, text_col, shingle, similarity)
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest), "a", "b")
    texts = materialise(sets.select("digest", "whole").distinct(), "text-sets")
    discard(sets, first, likely, rest, edges, *found)
    return texts.join(roots, texts["whole"] == roots["node"], "left").select("digest", F.coalesce("root", "whole").alias("group"))
