"""Similarity self-join of documents by the Jaccard coefficient of their word n-grams.

Method: partition of the universe and the pigeonhole principle. If two sets have Jaccard
similarity num/den or more and the smaller one has n elements, they differ in at most
H(n) = floor(n (den - num) / num) elements. Sets are taken by size band (from a power of two
to the next); a set takes part in its own band and, if a smaller partner there is possible,
in the one below. A hash deals the elements of the universe into segments, as many for each
band as its largest set needs. Per band there are two ways to index the subsets:

* exact: index H(n) + 1 segment subsets. H(n) differences can't touch them all, so one is
  equal. Which ones: the first in an order of all subsets that both sets share, so two sets
  index the same equal one: subsets with a rare element first, then those of frequent
  elements only, then empty ones.
* one deletion: index ceil((H(n) + 1) / 2) subsets together with each of them less one
  element. If all differed in two elements or more, there would be more than H(n)
  differences, so one pair is equal or equal after one deletion.

A bounded sample of SAMPLE documents tells which elements are frequent and what either way
costs a band, in index entries and in pairs that meet. The choice changes costs, never links.

Equal sets are one node. Entries are counted per key first (with a partial sum in each task),
so only entries of shared keys meet. A large group does not yield all its pairs: a few pivots,
among them the member with the most company, are compared with the members that are not yet
known to be connected with them, and leave the group; groups that lie in one component are
done. Groups of SMALL_GROUP members or fewer are compared as a whole. The members of different
components that are left in large groups meet in blocks of bounded size, as parity sketches
whose distance never exceeds that of the sets: only pairs near enough come out of a block. Pairs
are verified by the n-gram sets of the texts themselves, 64-bit hashes of whole n-grams.

Null and empty texts and texts without words have no n-grams and link with nothing; texts of
fewer words than n have their whole sequence. A null id links with nothing and gets no
component. Rows that repeat an id are one document: they stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import join_by_id, join_dealt, mix, pieces, share, signed, sized, stage, stage_few, utf8, word_hashes
from larkspool.llm.graph import components

#: Documents in the sample that costs are measured on, and how many of them make an element frequent.
SAMPLE, FREQUENT = 5_000, 6
#: Segments per index entry needed, so that empty subsets can be passed over.
RESERVE = 1.15
#: What a pair that meets costs, in index entries.
PAIR_COST = 2.0
#: Groups of up to so many members have all their pairs compared at once; pivots of a larger one.
SMALL_GROUP, PIVOTS = 16, 4
#: Members of one block of a large group, and 64-bit words of a sketch.
BLOCK, SKETCH_WORDS = 256, 16
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The distinct word n-grams of each text as sorted 64-bit hashes."""
    for w in word_hashes(texts):
        if len(w) < size:
            whole = [xxhash.xxh3_64_intdigest(w.tobytes(), len(w))] if len(w) else []
            yield np.array(whole, np.uint64)
            continue
        n = len(w) - size + 1
        value = w[:n]
        for j in range(1, size):
            value = (value ^ (value >> np.uint64(32))) * _C1 + w[j : j + n]
        value = np.sort(mix(value))
        yield value[np.concatenate([[True], value[1:] != value[:-1]])]


@dataclass
class Plan:
    """How sets are indexed: similarity num/den, frequent elements (marked by their leading 20 bits), bands by one deletion."""

    num: int
    den: int
    frequent: np.ndarray
    by_deletion: frozenset[int] = field(default_factory=frozenset)

    def differences(self, n: int) -> int:
        return n * (self.den - self.num) // self.num

    def bands(self, n: int) -> list[int]:
        """The bands that a set of n elements takes part in."""
        own = n.bit_length() - 1
        below = own > 0 and ((1 << own) - 1) * self.den >= self.num * n
        return [own, own - 1] if below else [own]

    def keys(self, elements: np.ndarray, band: int, deletion: bool) -> tuple[np.ndarray, int]:
        """Index entries of a set in a band: own subsets first; how many they are."""
        largest = (2 << band) - 1
        needed = self.differences(min(len(elements), largest)) + 1
        most = self.differences(largest) + 1
        salt = np.uint64((2 * band + deletion) * int(_C2) % (1 << 64))
        if deletion:
            needed, segments = (needed + 1) // 2, (most + 1) // 2
        else:
            segments = int(most * RESERVE) + (most > 1)
        place = ((elements >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)
        value = np.zeros(segments, np.uint64)
        np.add.at(value, place, elements * _C3)
        if deletion:
            mine = place < needed
            less = value[place[mine]] - elements[mine] * _C3
            chosen = np.arange(needed)
            where = np.concatenate([chosen, place[mine]])
            value = np.concatenate([value[:needed], less])
            return mix(value + mix(where.astype(np.uint64) * _C1 + salt)), needed
        rank = np.full(segments, 2, np.int8)
        rank[place] = 1
        rank[place[~self.frequent[elements >> np.uint64(44)]]] = 0
        chosen = np.argsort(rank, kind="stable")[:needed]
        return mix(value[chosen] + mix(chosen.astype(np.uint64) * _C1 + salt)), needed

    def entries(self, elements: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        for band in self.bands(len(elements)) if len(elements) else ():
            yield self.keys(elements, band, band in self.by_deletion)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, hi, lo: the number of n-grams and a 128-bit digest of their set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [(len(s), xxhash.xxh3_128_digest(s.tobytes())) for s in shingles(utf8(batch.column(1)), size)]
            digest = np.frombuffer(b"".join(d for _, d in sets), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array(digest[:, 0]),
                 pa.array(digest[:, 1])], ["doc_id", "n", "hi", "lo"],
            )

    return docs.mapInArrow(scan, "doc_id long, n long, hi long, lo long")


def _planned(docs: DataFrame, total: int, size: int, num: int, den: int) -> Plan:
    """The plan for the whole table, from a sample by hash of the id."""
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    sample = stage(docs.where(chosen).repartition(48), "join-sample")  # bounded by SAMPLE
    scale = max(1.0, total / SAMPLE)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = {s.tobytes(): s for s in shingles(utf8(batch.column(1)), size)}
            found, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], ["element", "n"])

    counts = sample.mapInArrow(elements, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= FREQUENT).select("element")  # at most SAMPLE sets' elements / FREQUENT
    frequent = np.zeros(1 << 20, bool)
    frequent[np.array([r[0] for r in common.collect()], np.int64).view(np.uint64) >> np.uint64(44)] = True
    plan = Plan(num, den, frequent)
    shared = share(docs.sparkSession, plan)

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared()
        for batch in pieces(batches):
            rows = {"band": [], "deletion": [], "key": []}
            for found in shingles(utf8(batch.column(1)), size):
                for band in plan.bands(len(found)) if len(found) else ():
                    for deletion in (False, True):
                        keys, _ = plan.keys(found, band, deletion)
                        rows["band"].append(np.full(len(keys), band, np.int32))
                        rows["deletion"].append(np.full(len(keys), deletion))
                        rows["key"].append(signed(keys))
            arrays = [pa.array(np.concatenate(v) if v else np.zeros(0, t)) for v, t in zip(rows.values(), (np.int32, bool, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, list(rows))

    met = sample.mapInArrow(both_ways, "band int, deletion boolean, key long").groupBy("band", "deletion", "key")
    met = met.agg(F.count(F.lit(1)).alias("n")).groupBy("band", "deletion")
    costs = met.agg(F.sum("n").alias("entries"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()
    cost = {(r["band"], r["deletion"]): r["entries"] * scale + PAIR_COST * r["pairs"] * scale**2 for r in costs}
    plan.by_deletion = frozenset(b for b, d in cost if d and cost[b, True] < cost[b, False])
    return plan


def _entries(docs: DataFrame, plan: Plan, size: int) -> DataFrame:
    """key, node, own: the index. A task enters equal sets once; ``own`` is false after a deletion."""
    shared = share(docs.sparkSession, plan)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = shared(), set()
        for batch in pieces(batches):
            keys, nodes, own = [np.zeros(0, np.uint64)], [], []
            ids = batch.column(0).to_pylist()
            for node, found in zip(ids, shingles(utf8(batch.column(1)), size), strict=True):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest in seen:
                    continue
                seen.add(digest)
                for some, n_own in plan.entries(found):
                    keys.append(some)
                    nodes.append((node, len(some)))
                    own.append(np.arange(len(some)) < n_own)
            node = np.repeat(np.array([n for n, _ in nodes], np.int64), [k for _, k in nodes])
            own = np.concatenate(own) if own else np.zeros(0, bool)
            keys = signed(np.concatenate(keys))
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(node[part]), pa.array(own[part])], ["key", "node", "own"]
                )

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(scan, "key long, node long, own boolean")


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan, size: int) -> DataFrame:
    """a, b, linked of every pair (a, b), by the sets of both texts; a staged table."""
    num, den = plan.num, plan.den

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in pieces(batches):
            linked = []
            others = shingles(utf8(batch.column("text_b")), size)
            for text, other in zip(utf8(batch.column("text_a")), others, strict=True):
                if text != last:  # rows come sorted by a
                    last, first = text, next(shingles([text], size))
                common = len(np.intersect1d(first, other, assume_unique=True))
                linked.append(den * common >= num * (len(first) + len(other) - common) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return stage(both.mapInArrow(compare, "a long, b long, linked boolean"), "join-verified")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents link at a Jaccard similarity of num/den or more (above one half);
    component_id is the smallest doc_id that links lead to.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the similarity must be above one half and at most 1")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = stage(_sets(docs, size), "join-sets")
    total = rows.count()

    # Equal sets are one node, the smallest id. Only sets that repeat are looked up.
    some = rows.where("n > 0 and doc_id is not null")
    equal = some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))
    equal = equal.where("rep < other")
    copies = join_dealt(some, equal, ["hi", "lo"], F.xxhash64("doc_id"), total // 2)
    copies = copies.where("rep < doc_id").select("doc_id", "rep")
    copies = stage_few(copies.distinct(), "join-copies", total)
    # An id of several sets stays a node of its own, linked with the node of each of them.
    several = some.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("low"), F.max(F.struct("hi", "lo")).alias("high"))
    several = stage_few(several.where("low <> high").select("doc_id"), "join-several", total)
    tied = join_by_id(copies, several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    copies = stage_few(join_by_id(copies, several, "doc_id", "left_anti"), "join-nodes-of-copies", total)

    plan = _planned(docs, total, size, num, den)
    index = _entries(docs, plan, size)
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own"))
    shared = stage(shared.where("n > 1 and any_own").select("key", "n"), "join-keys")
    met = index.join(shared.hint("merge"), "key")
    met = join_by_id(met, copies.withColumnRenamed("doc_id", "node"), "node", "left")
    met = met.groupBy("key", F.coalesce("rep", "node").alias("node")).agg(F.max("own").alias("own"), F.max("n").alias("n"))
    met = stage(met, "join-met")
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    active = stage(met.join(sized(company, total), "node").select("key", "node", "own", "company"), "join-active")

    wanted = stage_few(active.select(F.col("node").alias("doc_id")).distinct(), "join-nodes", total)
    texts = stage(join_by_id(docs, wanted, "doc_id", "left_semi"), "join-texts")
    linked = _linked(active, texts, tied, plan, size)

    own_id = rows.where("doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"))
    out = join_by_id(own_id, copies, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = join_by_id(out, linked, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    nameless = rows.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(nameless)


def _linked(active: DataFrame, texts: DataFrame, tied: DataFrame, plan: Plan, size: int) -> DataFrame:
    """node, component of every node that links with another or is tied to one (u, v); a staged table.

    First the pivots of every group are compared with its other members, and leave it. Then
    what is left of groups that lie in several components meets in blocks.
    """
    groups = active.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own"), F.max(F.struct("own", "company", "node")).alias("top")
    )
    groups = groups.where("n > 1 and any_own").select("key", "n", F.col("top.node").alias("top"))
    # All members of small groups; of others the one with the most company and some by chance, alike in all groups.
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("n") < F.lit(PIVOTS << 30)
    pivot = F.col("own") & ((F.col("n") <= SMALL_GROUP) | (F.col("node") == F.col("top")) | chance)
    members = join_dealt(active, groups, ["key"], F.xxhash64("node")).withColumn("pivot", pivot)
    members = stage(members.drop("top"), "join-members")
    first = members.where("pivot").select("key", F.col("node").alias("p"))
    tried = join_dealt(members, first, ["key"], F.xxhash64("node")).where("p <> node and (p < node or not pivot)")
    # The same pair may come from many keys, either way round.
    tried = tried.groupBy(F.least("p", "node").alias("x"), F.greatest("p", "node").alias("y")).agg(F.max("p").alias("a"))
    tried = tried.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
    links = _verified(tried, texts, plan, size).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(links.unionByName(tied))

    rest = members.where(~F.col("pivot") & (F.col("n") > SMALL_GROUP)).select("key", "node", "own")
    rest = join_by_id(rest, found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = stage(rest, "join-rest")
    groups = rest.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    groups = stage(groups.where("any_own and low < high").select("key", "n"), "join-open")
    if groups.isEmpty():
        return found
    near = _near_in_blocks(rest, groups, texts, plan, size)
    links = _verified(near, texts, plan, size).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Per bit, the parity of the elements that a hash puts there: it differs in no more bits than the sets in elements."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount((elements >> np.uint64(3)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _near_in_blocks(rest: DataFrame, groups: DataFrame, texts: DataFrame, plan: Plan, size: int) -> DataFrame:
    """a, b: pairs of different components in a group whose sketches allow a link."""
    num, den = plan.num, plan.den

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(len(s), sketch(s).tobytes()) for s in shingles(utf8(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())],
                ["node", "size", "sketch"],
            )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=1):  # a pair of blocks at a time
            for same in batch.column("same").to_pylist():
                (a, ca, oa, na, sa), (b, cb, ob, nb, sb) = (_columns(batch.column(c)) for c in ("left", "right"))
                allowed = (den - num) * (na[:, None] + nb[None, :]) // (den + num)
                apart = np.bitwise_count(sa[:, None, :] ^ sb[None, :, :]).sum(axis=2, dtype=np.int64)
                hit = (apart <= allowed) & (ca[:, None] != cb[None, :]) & (oa[:, None] | ob[None, :])
                if same:
                    hit &= a[:, None] < b[None, :]
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"]
                )

    sketches = stage(texts.select("doc_id", "text").mapInArrow(sketched, "node long, size int, sketch binary"), "join-sketches")
    members = join_dealt(rest, groups, ["key"], F.xxhash64("node"))
    members = members.join(sketches.dropDuplicates(["node", "size", "sketch"]).hint("merge"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    packed = members.groupBy("key", "block").agg(
        F.max("blocks").alias("blocks"), F.collect_list(F.struct("node", "component", "own", "size", "sketch")).alias("members")
    )
    packed = stage(packed, "join-blocks")
    left = packed.select("key", F.col("block").alias("mine"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), F.col("members").alias("left"))
    right = packed.select("key", "block", F.col("members").alias("right"))
    both = left.join(right.hint("merge"), ["key", "block"])
    met = both.select("left", "right", (F.col("mine") == F.col("block")).alias("same"))
    return stage(met.mapInArrow(near, "a long, b long").distinct(), "join-pairs")


def _columns(members: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Node, component, own, size and sketch of the members of one block."""
    found = members.flatten()
    kinds = (("node", np.int64), ("component", np.int64), ("own", bool), ("size", np.int64))
    columns = [found.field(name).to_numpy(zero_copy_only=False).astype(kind) for name, kind in kinds]
    sketches = b"".join(found.field("sketch").to_pylist())
    return *columns, np.frombuffer(sketches, np.uint64).reshape(-1, SKETCH_WORDS)


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all other columns unchanged."""
    gone = near_duplicates(docs, size, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return join_by_id(docs, stage(gone, "join-dropped"), "doc_id", "left_anti")
