import itertools
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, frame
from tidemark.llm import queries, source_mix


def brute_targets(sizes, weights, total, most):
    """By bisection of the words for each unit of weight."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * sizes[s], mid * weights[s]) for s in sizes) < total else (lo, mid)
    return {s: min(most * sizes[s], hi * weights[s]) for s in sizes}


def test_targets():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = {f"s{k}": rnd.choice([0, 1, 50, 1000, 9999]) for k in range(rnd.randint(1, 9))}
        weights = {s: rnd.choice([1, 2, 3]) for s in sizes}
        total = 1.5 * sum(sizes.values())
        got = source_mix.targets(sizes, weights, total, 2)
        assert got == pytest.approx(brute_targets(sizes, weights, total, 2), abs=1e-6) and sum(got.values()) == pytest.approx(total)


def cheapest(capacity, members, quota, most, steps):
    """Most words and least cost, over all flows in whole words; a word in the k-th step of its pattern costs k."""
    best = (0, 0)
    ways = []
    for c, m in zip(capacity, members, strict=True):
        ways.append([f for f in itertools.product(range(most * c + 1), repeat=len(m)) if sum(f) <= most * c])
    for flows in itertools.product(*ways):
        used = defaultdict(int)
        for m, f in zip(members, flows, strict=True):
            for s, x in zip(m, f, strict=True):
                used[s] += x
        if all(used[s] <= quota[s] for s in quota):
            best = max(best, (sum(used.values()), -sum(cost(c, sum(f), most, steps) for c, f in zip(capacity, flows, strict=True))))
    return best


def cost(c, words, most, steps):
    room = [c * (k % steps + 1) // steps - c * (k % steps) // steps for k in range(most * steps)]
    total = 0
    for k, r in enumerate(room):
        total += k * min(r, words)
        words -= min(r, words)
    return total


def test_flow_is_whole_and_cheapest():
    rnd = random.Random(2)
    for _ in range(60):
        names = ["a", "b", "c"][: rnd.randint(1, 3)]
        members = [sorted(rnd.sample(names, rnd.randint(0, min(2, len(names))))) for _ in range(rnd.randint(1, 3))]
        capacity = [rnd.randint(0, 3) for _ in members]
        quota = {s: rnd.randint(0, 6) for s in names}
        sent = source_mix.routed(capacity, members, quota, 2, 2)
        assert all(x >= 0 for f in sent for x in f.values()) and [sorted(f) for f in sent] == members
        assert all(sum(f.get(s, 0) for f in sent) <= quota[s] for s in names)
        assert all(sum(f.values()) <= 2 * c for f, c in zip(sent, capacity, strict=True))
        assert (sum(sum(f.values()) for f in sent), -sum(cost(c, sum(f.values()), 2, 2) for f, c in zip(sent, capacity, strict=True))) == cheapest(capacity, members, quota, 2, 2)


def test_chosen_leave_what_the_small_can_fill():
    rnd = random.Random(3)
    for _ in range(300):
        words = np.array([rnd.randint(1, 400) for _ in range(rnd.randint(1, 12))])
        small = rnd.choice([0, 0, 100, 5000])
        rest = rnd.randint(0, int(words.sum()) + small)
        total = int(words[source_mix.chosen(words, rest, small)].sum())
        best = max(s for r in range(len(words) + 1) for c in itertools.combinations(words.tolist(), r) if (s := sum(c)) <= rest)
        assert total <= rest and (total >= min(best, rest - small))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    rows = [(i, None if i % 97 == 0 else " ".join("word" for _ in range(rnd.choice([0, 1, 3, 9, 30])))) for i in range(6000)]
    rows += [(7000, "long " * 9000), (7001, "\t long\n" * 700), (7002, "\x1c a\xa0b\x0bc"), *[(7003, "same text " * 9)] * 5]
    rnd.shuffle(rows)
    member = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 7 == 1, F.array(F.lit("b"), F.lit(None).cast("string"), F.lit("b"))).when(F.col("doc_id") % 7 == 2, F.array(F.lit("ç"))).when(F.col("doc_id") % 7 == 3, None).otherwise(F.array(F.lit("a")))
    return frame(spark, rows).withColumn("groups", member).withColumn("pattern", F.lit(0)), rows


def test_overlapping_sources(spark, corpus):
    docs, given = corpus
    mix = source_mix.mix_sources(docs, F.col("groups"), {"a": 1, "b": 5, "ç": 2, None: 1}, percent=120, most=3)
    rows = mix.documents.withColumn("pattern", F.to_json("sources")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in given)
    assert set(mix.sources) == {"0a", "0b", "0ç", "1"}
    by_pattern = defaultdict(list)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by_pattern[r["pattern"]].append(r)
    assert set(by_pattern) == set(mix.flow) and len(by_pattern) == 5
    for p, own in by_pattern.items():
        words, want = sum(r["size"] for r in own), sum(mix.flow[p].values())
        base = want // max(1, words)
        assert {r["copies"] for r in own} <= {base, base + 1}
        assert 0 <= want - sum(r["taken"] for r in own) <= max(50, words / 1000)
        assert not json.loads(p) or want > 0
    for s, (_, goal) in mix.sources.items():
        assert sum(f.get(s, 0) for f in mix.flow.values()) == pytest.approx(goal, abs=1)
    assert len({r["copies"] for r in rows if r["doc_id"] == 7003}) == 1
    again = source_mix.mix_sources(docs.repartition(11), F.col("groups"), {"a": 1, "b": 5, "ç": 2, None: 1}, percent=120, most=3)
    assert sorted((r["doc_id"], r["taken"]) for r in again.documents.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)
    other = source_mix.mix_sources(docs, F.col("groups"), {"a": 1, "b": 5, "ç": 2, None: 1}, percent=120, most=3, seed=8)
    assert sorted((r["doc_id"], r["taken"]) for r in other.documents.collect()) != sorted((r["doc_id"], r["taken"]) for r in rows)


def test_selection_is_a_prefix_of_the_seeded_order(spark, corpus):
    """The small documents of a pattern that are taken once more are those with the least hashes, as many as fit."""
    docs, _ = corpus
    sized = source_mix.sized(docs, F.array(F.lit("x")), 7)
    small = sized.filter("size < 40")
    rows = sorted((r["key"], r["size"]) for r in small.collect())
    for quota in (0, 1, 500, 20_000, sum(n for _, n in rows)):
        below = source_mix._thresholds(small.select("pattern", "key", "size"), {'["0x"]': quota}, 100)['["0x"]']
        took = sum(n for k, n in rows if k < below)
        following = next((k for k, _ in rows if k >= below), None)
        assert took <= quota and (following is None or took + sum(n for k, n in rows if k == following) > quota)


def test_query_against_its_contract(spark, tmp_path):
    rows = [*awkward()[:-1], *((i, "w " * (i % 11)) for i in range(200, 900))]
    source = lambda i: None if i % 9 == 0 else f"s{i % 5}é" if i % 2 else "S"
    table = [(i, t, source(i), 1) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, source string, target int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_source_mix(spark, str(tmp_path)).collect()}
    sizes = defaultdict(int)
    for i, t, s, _ in table:
        assert got[i]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += got[i]["size"]
    in_order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(in_order)}, 1.5 * sum(sizes.values()), 2)
    for s in in_order:
        own = [got[i] for i, _, x, _ in table if x == s]
        assert {(r["source_size"], round(r["target"], 4)) for r in own} == {(sizes[s], round(want[s], 4))}
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) < 12


def test_nothing_and_too_many_patterns(spark, monkeypatch):
    none = frame(spark, [(1, "x")]).limit(0)
    assert source_mix.mix_sources(none, F.array("source"), (3, 1, 2)).documents.count() == 0
    blank = frame(spark, [(1, None), (2, " "), (None, "x y")])
    assert {(r["doc_id"], r["taken"]) for r in source_mix.mix_sources(blank, F.array("source"), (3, 1, 2)).documents.collect()} == {(1, 0), (2, 0)}
    monkeypatch.setattr(source_mix, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        source_mix.mix_sources(frame(spark, awkward()), F.array("source"), (1,))
