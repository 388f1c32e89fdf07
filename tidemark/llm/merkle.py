"""Merkle manifest of a dataset (operator 13): superblock reduction.

Every row is a leaf. The leaves of a tree (one for each source) stand in order and are numbered; `fanout` consecutive nodes become the digest of their
digests strung together, level by level, until one node is left. The roots of the trees are the leaves of one more tree, whose root is the manifest's.

1. Numbering. Leaves are dealt out by ranges of (tree, order), so a tree of any size spreads over many tasks; a leaf's number is its place among the leaves of its tree
   in its range, and how many leaves of the tree the ranges before hold.
2. Superblocks. Numbers are bucketed by fanout ** levels (4,096 leaves at 16 and 3). applyInPandas collapses up to `levels` levels of a bucket at once and
   keeps one row a bucket: its root and the digests of its leaves.
3. Recursion. The roots of the buckets are the nodes of the next round, until each tree has one.
4. Proofs. Going back down, the proof of a node is that within its bucket, the lower one, and then that of the bucket's root, the upper one. A proof has, for
   each level, the digests to the left and to the right of the node in its run, as one string each.

A group is never larger than a bucket, and what the rounds shuffle are digests: the first round 32 bytes a leaf and its order, the next a 4,096th of that.

Defined results: a null value is `-`, so it differs from an empty text; rows that repeat are leaves of their own, beside each other; rows of a tree that share the order
column come in order of their digests; nulls of source and of the order column come first; of an empty table there is no leaf and no root;
extra columns are neither read nor part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, small_batches, staged

FANOUT = 16
#: Levels that a round collapses.
LEVELS = 3
#: Leaves in a range, about.
RANGE_ROWS = 100_000
#: Leaves whose proofs go out in one Arrow batch.
BATCH = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<left:string,right:string>>"
_BLOCK = "tree string, block long, root string, n int, digests binary, seconds array<string>, names array<long>"


def value_text(x: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = x.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[value_text(c) for c in columns]), 256)


def tree_key(source: Column) -> Column:
    """A source as text that is never null and keeps the order: null first, then by bytes."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def node(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def collapsed(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the given ones to those `levels` above."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([node(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def levels_of(n: Column, most: int, fanout: int) -> Column:
    """How many levels lead from n nodes to one, `most` at most."""
    out = F.lit(0)
    for k in range(most):
        out = F.when(n > fanout**k, k + 1).otherwise(out)
    return out


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Staged rows(tree, ...) with `index`, the place of each in its tree by `order`, and `total`, the rows of its tree."""
    n = max(1, -(-rows.count() // RANGE_ROWS))
    place = F.monotonically_increasing_id()
    rows = staged(rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("_place", place), "numbered-leaves")
    part = F.shiftright("_place", 33)
    parts = rows.groupBy("tree", part.alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_tree = Window.partitionBy("tree").orderBy("_part")  # a row for each range that has leaves of the tree
    before = F.coalesce(F.sum("_n").over(of_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("tree"))
    parts = staged(parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), total.alias("total")), "leaf-ranges")
    found = attach(rows.withColumn("_part", part), parts, ["tree", "_part"], row_bytes=128)
    return found.withColumn("index", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One staged row for each superblock of nodes(tree, index, total, digest, second, name): its root, after as many levels as its tree still has, up to `levels`."""
    size = fanout**levels
    rows = nodes.withColumns({"block": F.floor(F.col("index") / size), "up": levels_of(F.col("total"), levels, fanout)})

    def run(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("index", kind="stable")
        digests = leaves["digest"].tolist()
        top = collapsed(digests, int(leaves["up"].iloc[0]), fanout)[-1]
        seconds, names = leaves["second"].tolist(), leaves["name"].astype("Int64")
        row = {"tree": key[0], "block": key[1], "root": top[0], "n": len(digests), "digests": bytes.fromhex("".join(digests))}
        row["seconds"] = seconds if any(x is not None for x in seconds) else None
        row["names"] = [None if pd.isna(x) else int(x) for x in names] if names.notna().any() else None
        return pd.DataFrame([row])

    return staged(rows.groupBy("tree", "block").applyInPandas(run, _BLOCK), "superblocks")


@dataclass
class Forest:
    """rounds: the superblocks of each round, from the leaves up; roots: a staged row for each tree with its root and number of leaves."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int
    levels: int


def reduce_trees(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Forest:
    """The trees of numbered nodes(tree, index, total, digest, second, name)."""
    rounds: list[DataFrame] = []
    sizes = None
    while True:
        blocks = collapse(nodes, fanout, levels)
        rounds.append(blocks)
        tops = blocks.groupBy("tree").agg(F.count(F.lit(1)).alias("total"), F.max_by("root", "block").alias("root"), F.sum("n").alias("n"))
        tops = staged(tops, "tree-tops")
        sizes = tops.select("tree", "n") if sizes is None else sizes
        if not tops.filter("total > 1").take(1):
            roots = tops.select("tree", "root").join(sizes, "tree")
            return Forest(rounds, staged(roots, "tree-roots"), fanout, levels)
        # a tree that has its root goes up as it is: its one node is a bucket of its own, after no levels
        none = (F.lit(None).cast("string").alias("second"), F.lit(None).cast("long").alias("name"))
        nodes = blocks.select("tree", F.col("block").alias("index"), F.col("root").alias("digest"), *none)
        nodes = attach(nodes, tops.select("tree", "total"), "tree", row_bytes=96)


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """tree, index, name, digest, second and proof of each leaf; above: a staged table (tree, proof) of what follows on the proofs of each tree, if anything."""
    leaves, key, upper = None, ["tree"], above
    for k in range(len(forest.rounds) - 1, -1, -1):
        blocks = forest.rounds[k]
        joined = blocks.withColumn("proof", F.array().cast(_PROOF)) if upper is None else attach(blocks, upper, key, row_bytes=8192)
        joined = attach(joined, forest.roots.select("tree", F.col("n").alias("tree_n")), "tree", row_bytes=96)
        leaves = _leaf_proofs(joined, forest, k)
        if k:
            key, upper = ["tree", "block"], staged(leaves.select("tree", F.col("index").alias("block"), "proof"), "upper-proofs")
    return leaves


def _leaf_proofs(blocks: DataFrame, forest: Forest, of_round: int) -> DataFrame:
    """A row for each node of blocks(tree, block, digests, names, seconds, proof, tree_n): its proof in the block, and then the block's."""
    small_batches(blocks.sparkSession)
    fanout, levels = forest.fanout, forest.levels
    size = fanout**levels
    sides = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("name", pa.int64()), ("digest", pa.string()), ("second", pa.string()), ("proof", pa.list_(sides))])

    def of_block(row: dict) -> Iterator[pa.RecordBatch]:
        text = row["digests"].hex()
        digests = [text[i : i + 64] for i in range(0, len(text), 64)]
        total = row["tree_n"]
        for _ in range(of_round):
            total = -(-total // size)
        up = next(k for k in range(levels + 1) if k == levels or fanout**k >= total)
        nodes = collapsed(digests, up, fanout)
        names, seconds = row["names"] or [None] * len(digests), row["seconds"] or [None] * len(digests)
        for lo in range(0, len(digests), BATCH):
            hi = min(lo + BATCH, len(digests))
            found = []
            for i in range(lo, hi):
                own = []
                for level in nodes[:up]:
                    run = i // fanout * fanout
                    own.append({"left": "".join(level[run:i]), "right": "".join(level[i + 1 : run + fanout])})
                    i //= fanout
                found.append(own + (row["proof"] or []))
            first = row["block"] * size
            columns = [[row["tree"]] * (hi - lo), range(first + lo, first + hi), names[lo:hi], digests[lo:hi], seconds[lo:hi], found]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_block(batch.slice(k, 1).to_pylist()[0])

    rows = blocks.select("tree", "block", "digests", "names", "seconds", "proof", "tree_n")
    return rows.mapInArrow(run, f"tree string, index long, name long, digest string, second string, proof {_PROOF}")


@dataclass
class Manifest:
    """trees: those of the sources; top: the tree of their roots, whose leaves' names are places; places: a staged table (name, tree)."""

    trees: Forest
    top: Forest
    places: DataFrame

    def root(self) -> str | None:
        """None for an empty table."""
        row = self.top.roots.first()
        return row["root"] if row else None


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, by: str = "source", order: str = "doc_id", second: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of docs: leaves of `fields`, trees by `by`, in each by the whole number `order`. second: a digest to carry along with each leaf, if any."""
    no_second = F.lit(None).cast("string")
    leaf = leaf_digest([F.col(c) for c in fields])
    rows = docs.select(tree_key(F.col(by)).alias("tree"), F.col(order).cast("long").alias("name"), leaf.alias("digest"), (no_second if second is None else second).alias("second"))
    trees = reduce_trees(numbered(staged(rows, "leaves"), ["name", "digest"]), fanout, levels)
    roots = staged(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"), no_second.alias("second")), "subroots")
    places = staged(numbered(roots, ["of"]).withColumn("name", F.col("index")), "subroot-places")
    return Manifest(trees, reduce_trees(places.drop("of"), fanout, levels), places.select("name", F.col("of").alias("tree")))


def inclusion_proofs(manifest: Manifest) -> DataFrame:
    """tree, index, name (the order column), digest, second, proof (for each level the digests left and right of the node), subroot and root of each leaf."""
    above = attach(proofs(manifest.top).select("name", "proof"), manifest.places, "name", row_bytes=128)
    leaves = proofs(manifest.trees, staged(above.select("tree", "proof"), "subroot-proofs"))
    subroots = manifest.trees.roots.select("tree", F.col("root").alias("subroot"))
    return attach(leaves, subroots, "tree", row_bytes=128).withColumn("root", F.lit(manifest.root()).cast("string"))


def folded(proof: Column, digest: Column) -> Column:
    """The root that a proof leads to from a leaf's digest."""
    return F.aggregate(proof, digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)
