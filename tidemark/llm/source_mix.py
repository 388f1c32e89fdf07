"""Mixing sources to target weights (operator 12): min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources form a pattern.

1. One aggregate gives the words of each pattern. Sources share the wanted words by weight; a target stops at `most` times its source's words and what it leaves is
   shared again by weight.
2. Flow. Every pattern offers its words `most` times, at a cost that grows with each repetition (a convex cost, in STEPS steps a repetition, so that repetition
   spreads evenly), and may send them to any of its sources, up to their targets. The cost of a path is that of its first step alone, so successive
   shortest paths are: open one more step for all patterns, send what can be sent, moving earlier flow between sources where that makes room; then the next step.
3. Selection. A pattern whose flow is a whole number of copies and a rest gives every document so many times, and some once more: in the order
   of a seeded hash those that fit into the rest. Documents over a THOUSANDTH of their pattern (fewer than 1,000 of them) are chosen first, one by one, in one group a
   pattern; the others by a threshold on the hash, found from histograms of hash prefixes, each of which looks into one bucket of the last. What is left of the rest is
   less than one small document, or, where large ones are all there is, what whole documents can't fill.

Documents are never shuffled; what reaches the driver are the pattern table and, for each pattern and histogram, one bucket. More than MOST_PATTERNS patterns are refused.

Defined results: a null text has no words; a null source is a source of its own, the last in order; a document without any source is not taken; rows that
repeat doc_id and text are taken equally often; reruns, other partitions and lost executors give the same mix; of an empty table the mix is empty; extra
columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, body_of, staged, texts

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns come to the driver; more are refused.
MOST_PATTERNS = 10_000
#: Steps of the cost in each repetition.
STEPS = 8
#: A document with more than this share of its pattern's words is chosen on its own.
THOUSANDTH = 1000
#: So few documents are chosen so that they come nearest, where the seeded order leaves more than the small ones can fill.
FEW = 64
#: Bits of the hash that a histogram resolves, and bits of the hash.
BITS, KEY_BITS = 10, 60


def targets(sizes: Mapping[str, int], weights: Mapping[str, float], total: float, most: int) -> dict[str, float]:
    """Words of each source: total by weight, none above `most` times its size."""
    out: dict[str, float] = {}
    rest, unit = dict(sizes), 0.0
    while rest:
        unit = (total - sum(out.values())) / sum(weights[s] for s in rest)
        full = [s for s in rest if unit * weights[s] > most * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = float(most * rest.pop(s))
    return out | {s: unit * weights[s] for s in rest}


def routed(capacity: Sequence[int], members: Sequence[Sequence[str]], quota: Mapping[str, int], most: int, steps: int = STEPS) -> list[dict[str, int]]:
    """The flow from each pattern (its words, its sources) to each of its sources: as much as the quotas take, at the least cost of repetition."""
    left = dict(quota)
    sent: list[dict[str, int]] = [dict.fromkeys(m, 0) for m in members]
    of_source: dict[str, list[int]] = {s: [] for s in quota}
    for p, m in enumerate(members):
        for s in m:
            of_source[s].append(p)
    free = [0] * len(members)

    def path(start: int) -> list[tuple[int, str]] | None:
        """(pattern, source) steps of a shortest way for words of `start` to a source with room: each pattern sends to the source, from which the next one takes back."""
        came: dict[str, tuple[int, str | None]] = {}
        seen, waiting = {start}, deque([(start, None)])
        while waiting:
            p, via = waiting.popleft()
            for s in members[p]:
                if s in came:
                    continue
                came[s] = (p, via)
                if left[s] > 0:
                    steps_back = []
                    at: str | None = s
                    while at is not None:
                        pattern, before = came[at]
                        steps_back.append((pattern, at))
                        at = before
                    return steps_back[::-1]
                for q in of_source[s]:
                    if sent[q][s] > 0 and q not in seen:
                        seen.add(q)
                        waiting.append((q, s))
        return None

    for step in range(most * steps):
        for p, c in enumerate(capacity):
            k = step % steps
            free[p] += c * (k + 1) // steps - c * k // steps
        for p in range(len(members)):
            while free[p] > 0 and (way := path(p)):
                moved = min(free[p], left[way[-1][1]], *(sent[q][s] for (q, _), (_, s) in zip(way[1:], way, strict=False)))
                free[p] -= moved
                left[way[-1][1]] -= moved
                for k, (q, s) in enumerate(way):
                    if k:
                        sent[q][way[k - 1][1]] -= moved
                    sent[q][s] += moved
    return sent


def nearest(words: Sequence[int], limit: int) -> np.ndarray:
    """Which of a few documents come nearest to `limit` from below; of equals the earlier ones."""
    sums = [1]  # bit k: some of the documents so far have k words
    for w in words:
        sums.append((sums[-1] | sums[-1] << w) & ((2 << limit) - 1))
    take, at = np.zeros(len(words), bool), sums[-1].bit_length() - 1
    for i in range(len(words) - 1, -1, -1):
        if not sums[i] >> at & 1:
            take[i], at = True, at - words[i]
    return take


def chosen(words: np.ndarray, rest: int, small: int) -> np.ndarray:
    """Which of the large documents, in seeded order, are taken once more: about their share of `rest`, and so that the small ones' `small` words can fill what is left."""
    take, total = np.zeros(len(words), bool), 0
    share = rest * int(words.sum()) // max(1, int(words.sum()) + small)
    for limit, need in ((share, share), (rest, rest - small)):
        for i, w in enumerate(words.tolist()):
            if not take[i] and total < need and total + w <= limit:
                take[i], total = True, total + w
    if total < rest - small and len(words) <= FEW and rest < 1 << 22:
        return nearest(words.tolist(), rest)
    while total < rest - small:  # exchange one for a larger one that comes nearest
        gain = np.where(take[:, None] & ~take[None, :], words[None, :] - words[:, None], 0)
        gain = np.where(gain <= rest - total, gain, 0)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 0:
            break
        take[i], take[j], total = False, True, total + int(gain[i, j])
    return take


def source_key(source: Column) -> Column:
    """A source as text that is never null and keeps the order: by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_name(key: str) -> str | None:
    return None if key == "1" else key[1:]


@dataclass
class Mix:
    """documents: doc_id, body, size, sources (keys), copies and taken; sources: key -> (size, target); flow: pattern (keys as JSON) -> words to each source."""

    documents: DataFrame
    sources: dict[str, tuple[int, float]]
    flow: dict[str, dict[str, int]]

    def source_table(self) -> DataFrame:
        """source_key, source_size and target of each source."""
        rows = [(k, n, t) for k, (n, t) in sorted(self.sources.items())]
        return self.documents.sparkSession.createDataFrame(rows, "source_key string, source_size long, target double")


def sized(docs: DataFrame, sources: Column, seed: int) -> DataFrame:
    """doc_id, body, size, sources, pattern and key (the seeded hash) of each document, staged."""
    keys = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), source_key)))
    rows = texts(docs, keys.alias("sources")).select("doc_id", body_of(), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), "sources", F.to_json("sources").alias("pattern"))
    return staged(rows.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "body"), 64 - KEY_BITS)), "sizes")


def mix_sources(docs: DataFrame, sources: Column, weights: Sequence[float] | Mapping[str | None, float], percent: int = 150, most: int = 2, seed: int = 7) -> Mix:
    """The mix of docs(doc_id, text): `percent` of all words, shared by the sources (an array column) by weight; a sequence of weights goes round the sources in order."""
    spark = docs.sparkSession
    rows = sized(docs, sources, seed)
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    words = {r["pattern"]: int(r["words"]) for r in sorted(found, key=lambda r: r["pattern"])}
    members = {p: json.loads(p) for p in words}
    sizes: dict[str, int] = {}
    for p, n in words.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    in_order = sorted(sizes)
    weight = {s: weights[source_name(s)] if isinstance(weights, Mapping) else weights[k % len(weights)] for k, s in enumerate(in_order)}
    goals = targets({s: sizes[s] for s in in_order}, weight, percent * sum(words.values()) / 100, most)
    sent = routed(list(words.values()), [members[p] for p in words], {s: int(goals[s] + 0.5) for s in in_order}, most)
    flow = dict(zip(words, sent, strict=True))
    plan = {p: divmod(sum(f.values()), words[p]) if words[p] else (0, 0) for p, f in flow.items()}
    width = 64 + max(map(len, plan), default=0)
    table = spark.createDataFrame([(p, words[p], base, rest) for p, (base, rest) in plan.items()], "pattern string, words long, base long, rest long")
    planned = attach(rows, table, "pattern", row_bytes=width, how="inner")
    large = F.col("size") * THOUSANDTH > F.col("words")
    picked = staged(_picked(planned.filter(large & (F.col("rest") > 0)).select("pattern", "key", "size", "words", "rest")), "large-documents")
    taken = {r["pattern"]: (int(r["n"]), int(r["of"])) for r in picked.groupBy("pattern").agg(F.coalesce(F.sum(F.when(F.col("take"), F.col("size"))), F.lit(0)).alias("n"), F.sum("size").alias("of")).collect()}
    quota = {p: min(rest - taken.get(p, (0, 0))[0], words[p] - taken.get(p, (0, 0))[1]) for p, (_, rest) in plan.items() if rest > 0}
    below = _thresholds(planned.filter(~large).select("pattern", "key", "size"), quota, width)
    bounds = spark.createDataFrame([(p, k) for p, k in below.items()], "pattern string, below long")
    out = attach(planned, bounds, "pattern", row_bytes=width)
    out = attach(out, picked.filter("take").select("pattern", "key", F.lit(1).alias("picked")), ["pattern", "key"], row_bytes=width)
    once_more = F.when(large, F.coalesce("picked", F.lit(0))).otherwise(F.coalesce((F.col("key") < F.col("below")).cast("int"), F.lit(0)))
    copies = (F.col("base") + once_more).alias("copies")
    return Mix(out.select("doc_id", "body", "size", "sources", copies, (F.col("size") * copies).alias("taken")), {s: (sizes[s], goals[s]) for s in in_order}, flow)


def _picked(large: DataFrame) -> DataFrame:
    """pattern, key, size (of all rows of the key) and take of the large documents; fewer than THOUSANDTH a pattern, as each has more than that part of it."""
    units = large.groupBy("pattern", "key", "words", "rest").agg(F.sum("size").alias("size"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        n = group["size"].to_numpy(np.int64)
        rest, small = int(group["rest"].iloc[0]), int(group["words"].iloc[0]) - int(n.sum())
        return group[["pattern", "key", "size"]].assign(take=chosen(n, rest, small))

    return units.groupBy("pattern").applyInPandas(run, "pattern string, key long, size long, take boolean")


def _thresholds(small: DataFrame, quota: dict[str, int], width: int) -> dict[str, int]:
    """For each pattern the key below which its small documents fit into the quota."""
    spark = small.sparkSession
    below: dict[str, int] = {}
    state = {p: (0, q) for p, q in quota.items()}  # the prefix of the keys still in question, and what is left for them
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        if not state:
            break
        table = spark.createDataFrame([(p, prefix, q) for p, (prefix, q) in state.items()], "pattern string, prefix long, quota long")
        rows = attach(small, table, "pattern", row_bytes=width, how="inner").filter(F.shiftright("key", shift + BITS) == F.col("prefix"))
        bucket = F.shiftright("key", shift).alias("bucket")
        hist = rows.groupBy("pattern", "quota", bucket).agg(F.sum("size").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        so_far = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 2 ** BITS rows at most
        hist = hist.withColumn("upto", F.sum("n").over(so_far)).filter("upto > quota")
        over = hist.groupBy("pattern").agg(F.min(F.struct("bucket", "upto", "n", "first", "last")).alias("b")).select("pattern", "b.*").collect()
        crossed = {r["pattern"]: r for r in over}
        for p, (prefix, q) in list(state.items()):
            r = crossed.get(p)
            if r is None:  # all that is in question fits
                below[p] = (prefix + 1) << (shift + BITS)
                del state[p]
            elif r["first"] == r["last"]:
                below[p] = r["first"]
                del state[p]
            else:
                state[p] = (r["bucket"], q - (r["upto"] - r["n"]))
    return below
