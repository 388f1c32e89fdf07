"""N-gram Jaccard join (operator 8) by vertical partitioning.

A document's set is its distinct five-word shingles; two documents link when 100 * intersection >= percent * union.

1. Equal sets are one class. From here on classes are joined, not rows.
2. All n-grams have one global order: by frequency class (the power of two below the number of texts, for a list of the most frequent of
   bounded size; all others are class 0), then by hash. Any order gives the same links; this one gives short lists. The order is cut into
   `FRAGMENTS` fragments: in every frequency class at the same hashes.
3. Lists. Let t = ceil(percent * n / 100), the least overlap of a set of n with any set it links with. Of two sets that link, that one whose
   first n - t + l n-grams end first in the order has l of them in common with the other's first. With l = 1 they meet in the list of
   an n-gram; with a larger l, sets that find too few companions are left out before their whole sets are read.
4. Partial overlaps. For the sets that are left, the n-grams that another of them has are counted in each fragment. The overlap of two sets is at most
   the sum over the fragments of the smaller count, which decides nearly all pairs without a comparison.
5. Hubs. Each class is compared with one class of its lists, a member of the largest component, the one that it shares most lists
   with; links make components, and this is done `HUB_ROUNDS` times. So a large group of near copies becomes one component with few comparisons.
   The overlap of a pair is counted in each group of fragments alone, and summed.
6. Lists that still span components (equal lists once) are joined in blocks. Of two members in different components those are candidates that the sum
   of partial overlaps allows to link; a block gives the members that have a candidate, not the pairs, and a pair that shares several lists
   counts in the first of them. These members' n-grams meet once more, block by
   block: the overlaps of candidates are counted fragment by fragment and summed, pairs drop out as soon as they cannot link, and what
   leaves the block are the links that join components, fewer than it has members. Members of one component need no further test, and no link
   between components is missed.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than
five words is one shingle; a null text or one without words has no shingles and links with nothing; rows with the same
doc_id and text are one document; rows with the same doc_id and different texts are linked only where their texts are; extra columns are ignored;
a row without a doc_id is left out. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, release, slices, small_batches, staged, text_list, texts
from tidemark.llm.components import components
from tidemark.llm.hashing import shingle_sets

SHINGLE = 5
PERCENT = 75
#: Cuts of the order that partial overlaps are counted in, and groups of them that verification works on one at a time.
FRAGMENTS, GROUPS = 64, 8
#: A prefix holds 1 + n / EXTRA n-grams more than any link needs, and as many must be shared.
EXTRA = 20
HUB_ROUNDS = 2
#: Members of a list that are compared at once, and n-grams that they have, about; longer lists are joined block by block.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: The list of frequent n-grams: how many at most, and from how many documents on. It orders, it drops nothing.
FREQUENT, FREQUENT_FROM = 1 << 18, 8
_MOST = np.iinfo(np.uint16).max


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_least(n: int, percent: int) -> int:
    """How many n-grams of their prefixes two sets share at least if they link and the one of n n-grams ends first."""
    return min(least_overlap(n, percent), 1 + n // EXTRA)


def _count_frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def compact() -> None:
            nonlocal grams, counts
            g = np.concatenate([grams, *held])
            w = np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)])
            held.clear()
            grams, at = np.unique(g, return_inverse=True)
            counts = np.bincount(at, w, len(grams)).astype(np.int64)
            if len(grams) > 1 << 20:  # the rare ones need no place in the list
                keep = np.argsort(-counts, kind="stable")[: 1 << 19]
                grams, counts = grams[keep], counts[keep]

        for part in slices(batches):
            held += shingle_sets(text_list(part), size)
            if sum(map(len, held)) > 1 << 19:
                compact()
        compact()
        often = np.flatnonzero(counts >= 3)
        often = often[np.argsort(-counts[often], kind="stable")[:FREQUENT]]
        yield pa.RecordBatch.from_arrays([pa.array(grams[often]), pa.array(counts[often])], names=["gram", "n"])

    return run


def frequency_classes(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted, and the frequency class of each; at most FREQUENT."""
    rows = docs.select("text").mapInArrow(_count_frequent(size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = rows.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    grams = rows["gram"].to_numpy(np.int64)
    by_gram = np.argsort(grams, kind="stable")
    return grams[by_gram], np.log2(rows["n"].to_numpy(np.float64)[by_gram]).astype(np.int8)


def in_order(grams: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set, given by ascending hashes, in the global order."""
    if not len(frequent):
        return grams
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    return grams[np.argsort(np.where(frequent[at] == grams, classes[at], 0), kind="stable")]


def fragment_of(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def shingle_prefixes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, body (hash of the text), n (size of the set), set_key (digest of the set) and prefix (array of long) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs).withColumn("body", F.xxhash64("text"))
    order = spark.sparkContext.broadcast(frequency_classes(docs, size))  # at most FREQUENT entries
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n", pa.int32()), ("set_key", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(text_list(part), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            prefixes = [in_order(s, *order.value)[: len(s) - least_overlap(len(s), percent) + shared_least(len(s), percent)] for s in sets]
            columns = [part.column("doc_id"), part.column("body"), pa.array(map(len, sets), pa.int32()), pa.array(keys, pa.binary()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, body long, n int, set_key binary, prefix array<long>")


def set_classes(sets: DataFrame) -> DataFrame:
    """set_key, cid (an id of its own for each distinct set: its least doc_id, unless two sets have the same) and doc_id, n and body of the row that stands for it."""
    rows = sets.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "body", "n")).alias("stand")).select("set_key", "stand.*")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_key")) > 1
    return rows.withColumn("cid", F.when(again, -1 - F.shiftrightunsigned(F.xxhash64("set_key", "doc_id"), 1)).otherwise(F.col("doc_id")))


def prefix_lists(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """gram, cid, n and core (whether the n-gram is one of the first n - t + 1) for the n-grams that the prefixes of two classes or more hold."""
    rows = attach(sets, classes.select("doc_id", "body", "set_key", "cid"), ["doc_id", "body", "set_key"], row_bytes=96, how="inner")
    rows = rows.select("cid", "n", F.posexplode("prefix").alias("place", "gram"))
    rows = rows.select("gram", "cid", "n", (F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / F.lit(100))).alias("core"))
    in_list = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    return staged(rows.withColumn("in_list", in_list).filter("in_list > 1").drop("in_list"), "prefix-lists")


def companioned(lists: DataFrame, percent: int) -> DataFrame:
    """cid of the classes that share enough n-grams of their prefixes with others to link with any."""
    t = lambda n: F.ceil(percent * n / F.lit(100))
    least = F.least(t(t(F.col("n"))), 1 + F.floor(t(F.col("n")) / EXTRA))  # of the smallest set that it can link with
    return lists.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least).select("cid")


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("cid"), _lists(shingle_sets(text_list(part), size))], names=["cid", "grams"])

    return run


def _by_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class its n-grams in GROUPS arrays, and how many are in each fragment (16 bits each, `_MOST` at most)."""
    for part in slices(batches, "grams", limit=1 << 20):
        sets = [np.sort(np.array(g, np.int64)) for g in part.column("grams").to_pylist()]
        cuts = np.arange(FRAGMENTS // GROUPS, FRAGMENTS, FRAGMENTS // GROUPS)
        groups, counts = [[] for _ in range(GROUPS)], []
        for s in sets:
            fragment = fragment_of(s) ^ (FRAGMENTS // 2)  # ascending with the signed hash
            counts.append(np.minimum(np.bincount(fragment, minlength=FRAGMENTS), _MOST).astype("<u2").tobytes())
            for own, g in zip(groups, np.split(s, np.searchsorted(fragment, cuts)), strict=True):
                own.append(g)
        names = ["cid", "n", "cap", "counts", *(f"g{k}" for k in range(GROUPS))]
        yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("n"), pa.array(map(len, sets), pa.int32()), pa.array(counts, pa.binary()), *map(_lists, groups)], names=names)


def shared_sets(docs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """cid, n, cap (n-grams that another of the held(cid, doc_id, body, n) has), counts (in each fragment) and g0, g1, ... (these n-grams) of the
    classes whose shared n-grams suffice for a link."""
    rows = attach(texts(docs).withColumn("body", F.xxhash64("text")), held.select("cid", "doc_id", "body"), ["doc_id", "body"], row_bytes=64, how="inner")
    grams = rows.select("cid", "text").mapInArrow(_whole_sets(size), "cid long, grams array<long>")
    in_list = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    shared = grams.select("cid", F.explode("grams").alias("gram")).withColumn("in_list", in_list).filter("in_list > 1")
    of_class = shared.groupBy("cid").agg(F.collect_set("gram").alias("grams")).join(held.select("cid", "n"), "cid")
    of_class = of_class.filter(100 * F.size("grams") >= percent * F.col("n"))
    arrays = ", ".join(f"g{k} array<long>" for k in range(GROUPS))
    return staged(of_class.mapInArrow(_by_fragment, f"cid long, n int, cap int, counts binary, {arrays}"), "shared-sets", "snappy")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lists with label, the component of each member, and size, its number of classes."""
    if labels is None:
        return lists.withColumns({"label": F.col("cid"), "size": F.lit(1).cast("long")})
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    known = labels.join(sizes, "label").select(F.col("node").alias("cid"), "label", "size")
    rows = lists.drop("label", "size").join(known, "cid", "left")
    return rows.withColumns({"label": F.coalesce("label", "cid"), "size": F.coalesce("size", F.lit(1))})


def _open_lists(rows: DataFrame, round_: int) -> DataFrame:
    """rows of the lists that span components, equal lists once, with their number of members, their n-grams, and a hub: a member of the largest component, another one each round."""
    hub = F.max_by(F.struct("cid", "n", "cap", "label"), F.struct("size", F.xxhash64("cid", F.lit(round_)))).alias("hub")
    members = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"of{k}") for k in (1, 2)]
    lists = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("in_list"), F.sum("cap").alias("grams"), F.min("label").alias("lo"), F.max("label").alias("hi"), hub, *members)
    lists = lists.filter("lo < hi").groupBy("of1", "of2", "in_list", "grams").agg(F.min_by(F.struct("gram", "hub"), "gram").alias("x"))
    return rows.join(lists.select("x.*", "in_list", "grams"), "gram")


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """hub and member: each class with that hub of its lists that it shares most lists with."""
    n, m = F.col("n"), F.col("hub.n")
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least("cap", "hub.cap") * (100 + percent) >= percent * (n + m))
    met = rows.filter((F.col("label") != F.col("hub.label")) & fits).groupBy(F.col("cid").alias("member"), F.col("hub.cid").alias("hub")).agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("member").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select("hub", "member")


@dataclass
class Members:
    """Members of blocks, sorted by block; those of side 0 meet each other, those of side 1 meet those of side 2."""

    block: np.ndarray
    side: np.ndarray
    cid: np.ndarray
    label: np.ndarray
    n: np.ndarray
    cap: np.ndarray
    counts: np.ndarray

    def candidates(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of the same block and different labels that the sizes and the partial overlaps allow to link."""
        start = np.flatnonzero(np.concatenate([[True], self.block[1:] != self.block[:-1]]))
        size = np.diff(np.append(start, len(self.block)))
        left = np.repeat(size, size) - (np.arange(len(self.block)) - np.repeat(start, size)) - 1  # members behind each
        beyond = self.cap - self.counts.sum(axis=1, dtype=np.int64)  # what the counts leave out
        a, label, side, n, cap = np.flatnonzero(left > 0), self.label, self.side, self.n, self.cap
        for step in range(1, int(left.max(initial=0)) + 1):
            a = a[left[a] >= step]
            b = a + step
            ok = (label[a] != label[b]) & ((side[a] == 0) | (side[a] != side[b]))
            ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            ok &= np.minimum(cap[a], cap[b]) * (100 + percent) >= percent * (n[a] + n[b])
            x, y = a[ok], b[ok]
            most = np.minimum(self.counts[x], self.counts[y]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[x], beyond[y])
            ok = most * (100 + percent) >= percent * (n[x] + n[y])
            if ok.any():
                yield x[ok], y[ok]


def members(b: pa.RecordBatch) -> Members:
    columns = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "side", "cid", "label", "n", "cap")]
    return Members(*columns, np.frombuffer(b"".join(b.column("counts").to_pylist()), "<u2").reshape(-1, FRAGMENTS))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew so that no block is divided."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column("block").to_numpy()
        if not len(block):
            continue
        last = int(np.searchsorted(block, block[-1]))
        if rest and rest[-1].column("block")[0].as_py() != block[-1]:
            yield pa.Table.from_batches([*rest, b.slice(0, last)]).combine_chunks().to_batches()[0]
            rest = []
        elif not rest and last:
            yield b.slice(0, last)
        rest.append(b.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def first_shared(lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least value that the lists of rows x[i] and y[i] share; each pair shares one."""
    ends = lists.offsets.to_numpy()
    values, code = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
    bits, out = np.zeros((len(lists), -(-len(values) // 8)), np.uint8), np.empty(len(x), np.int64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(lists)), np.diff(ends)), code >> 3), (128 >> (code & 7)).astype(np.uint8))
    step = max(1, (1 << 22) // max(1, bits.shape[1]))
    for i in range(0, len(x), step):
        shared = bits[x[i : i + step]] & bits[y[i : i + step]]
        byte = (shared != 0).argmax(axis=1)
        first = 8 - np.ceil(np.log2(shared[np.arange(len(byte)), byte].astype(np.int64) + 1)).astype(np.int64)
        out[i : i + step] = values[8 * byte + first]
    return out


def _with_candidate(percent: int):
    """The members with a candidate that they meet in this list first: a pair that shares several lists counts in the first alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_blocks(batches):
            found, gram = np.zeros(b.num_rows, bool), b.column("gram").to_numpy()
            pairs = list(members(b).candidates(percent))
            if pairs:
                x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
                here = first_shared(b.column("lists"), x, y) == gram[x]
                found[x[here]] = found[y[here]] = True
            yield b.select(["block", "side", "cid", "label"]).filter(pa.array(found))

    return run


def _forest_links(percent: int):
    """Of each block the links that join labels: pairs (a, b) of cid, without those that the ones before make needless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_blocks(batches):
            m = members(b)
            groups = [b.column(f"g{k}") for k in range(GROUPS)]
            for block in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(m.block)) + 1):
                a, z = int(block[0]), int(block[-1]) + 1
                own = Members(m.block[a:z], m.side[a:z], m.cid[a:z], m.label[a:z].copy(), m.n[a:z], m.cap[a:z], m.counts[a:z])
                x, y = joined_labels(own, [g.slice(a, z - a) for g in groups], percent)
                yield pa.RecordBatch.from_arrays([pa.array(own.cid[x]), pa.array(own.cid[y])], names=["a", "b"])

    return run


def joined_labels(m: Members, groups: list[pa.ListArray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block that make a spanning forest of its labels. Changes m.label.

    Each member is held against all its candidates that are not yet in its component. An overlap is the sum of
    the overlaps in each group of fragments; a pair goes on only while the groups not yet counted can still make it a link.
    """
    pairs = list(m.candidates(percent))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    start = np.searchsorted(x, np.arange(len(m.cid) + 1))
    per_group = FRAGMENTS // GROUPS
    counts = m.counts.astype(np.int64).reshape(len(m.cid), GROUPS, per_group)
    capped = (m.counts == _MOST).any(axis=1)
    grams = [(g.values.to_numpy(), g.offsets.to_numpy()) for g in groups]
    needed = lambda a, b: -(-percent * (m.n[a] + m.n[b]) // (100 + percent))
    links: list[tuple[int, int]] = []
    for a in np.flatnonzero(np.diff(start)).tolist():
        b = y[start[a] : start[a + 1]]
        b = b[m.label[b] != m.label[a]]
        if not len(b):
            continue
        total, least = np.zeros(len(b), np.int64), needed(a, b)
        rest = np.minimum(counts[a], counts[b]).sum(axis=2)
        rest = np.append(np.cumsum(rest[:, ::-1], axis=1)[:, ::-1], np.zeros((len(b), 1), np.int64), axis=1)  # what the groups from k on can add at most
        for k, (values, ends) in enumerate(grams):
            mine = values[ends[a] : ends[a + 1]]
            n = ends[b + 1] - ends[b]
            theirs = values[np.repeat(ends[b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            if len(mine):
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                total += np.bincount(np.repeat(np.arange(len(b)), n), mine[at] == theirs, len(b)).astype(np.int64)
            open_ = (total + rest[:, k + 1] >= least) | capped[b] | capped[a]
            b, total, least, rest = b[open_], total[open_], least[open_], rest[open_]
            if not len(b):
                break
        for c in b[total >= least].tolist():
            if m.label[c] != m.label[a]:
                links.append((a, c))
                m.label[m.label == m.label[c]] = m.label[a]
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components which the open lists still span. A long list is cut into blocks by hash, each joined with each."""
    blocks = F.greatest(F.ceil(F.col("in_list") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    own = F.pmod(F.xxhash64("cid", "gram"), blocks).cast("int")
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    block = F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other"))
    lists = rows.filter("other = 0").groupBy("cid").agg(F.collect_list("gram").alias("lists"))  # no more than its prefix has n-grams
    rows = rows.select(block.alias("block"), "gram", side.cast("int").alias("side"), "cid", "label")
    sketches = rows.join(lists.join(sets.select("cid", "n", "cap", "counts"), "cid"), "cid").repartition("block").sortWithinPartitions("block")
    some = staged(sketches.mapInArrow(_with_candidate(percent), "block long, side int, cid long, label long"), "block-members")
    whole = some.join(sets, "cid").repartition("block").sortWithinPartitions("block")
    return staged(whole.mapInArrow(_forest_links(percent), "a long, b long"), "block-links")


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs(hub, member) that link: their overlap is counted in each group of fragments alone, and summed."""
    groups = [f"g{k}" for k in range(GROUPS)]
    side = lambda name: sets.select(F.col("cid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *groups)])
    rows = pairs.join(side("member"), "member").join(side("hub"), "hub")
    overlap = sum((F.size(F.array_intersect(f"hub_{g}", f"member_{g}")) for g in groups[1:]), F.size(F.array_intersect(f"hub_{groups[0]}", f"member_{groups[0]}")))
    rows = rows.select("hub", "member", "hub_n", "member_n", overlap.alias("overlap"))
    linked = 100 * F.col("overlap") >= percent * (F.col("hub_n") + F.col("member_n") - F.col("overlap"))
    return staged(rows.filter(linked).select(F.col("hub").alias("a"), F.col("member").alias("b")), "links")


def class_labels(docs: DataFrame, sets: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node (cid) and label of the classes that have a link to another."""
    lists = prefix_lists(sets, classes, percent)
    held = staged(companioned(lists, percent).join(classes.select("cid", "doc_id", "body", "n"), "cid"), "held-classes")
    shared = shared_sets(docs, held, size, percent)
    rows = staged(lists.filter("core").select("gram", "cid").join(shared.select("cid", "n", "cap"), "cid"), "core-lists")
    release(lists)
    links, labels = None, None
    for round_ in range(HUB_ROUNDS + 1):
        before, rows = rows, staged(_open_lists(_labelled(rows, labels), round_), "open-lists")
        if not round_:
            release(before)
        more = verified_links(_hub_pairs(rows, percent), shared, percent) if round_ < HUB_ROUNDS else block_links(rows, shared, percent)
        links = more if links is None else links.unionByName(more)
        labels = components(links)
        rows = rows.select("gram", "cid", "n", "cap")
    return labels


def ngram_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, body (hash of the text), n_shingles, class_id (least doc_id with the same set), component_id and representative of each row of docs(doc_id, text).

    representative: whether the row is the one that stands for its group of linked texts, or has no shingles; rows that repeat it are too.
    """
    sets = staged(shingle_prefixes(docs, size, percent), "shingle-prefixes", "snappy")
    classes = staged(set_classes(sets), "set-classes")
    labels = class_labels(docs, sets, classes, size, percent)
    of_class = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = of_class.groupBy("label").agg(F.min(F.struct("doc_id", "body", "set_key")).alias("first"))
    stands = F.when(F.col("first.set_key") == F.col("set_key"), F.struct("doc_id", "body"))
    of_class = of_class.join(least, "label").select("set_key", F.col("doc_id").alias("class_id"), F.col("first.doc_id").alias("component_id"), stands.alias("stands"))
    out = sets.select("doc_id", "body", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    representative = F.when(F.col("n") > 0, F.coalesce(F.col("stands") == F.struct("doc_id", "body"), F.lit(False))).otherwise(True)
    ids = [F.coalesce(c, "doc_id").alias(c) for c in ("class_id", "component_id")]
    return out.select("doc_id", "body", F.col("n").cast("long").alias("n_shingles"), *ids, representative.alias("representative"))
