import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, frame
from tidemark.llm import merkle, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(trees, fanout):
    """trees: key -> leaves in order. root, key -> subroot, (key, place) -> [(left, right)] by plain levels of lists."""

    def grown(nodes):
        steps = [[] for _ in nodes]
        at, level = list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k, i in enumerate(at):
                run = i // fanout * fanout
                steps[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
                at[k] = i // fanout
            level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        return level[0], steps

    own = {k: grown(v) for k, v in sorted(trees.items())}
    root, upper = grown([r for r, _ in own.values()])
    return root, {k: r for k, (r, _) in own.items()}, {(k, i): p + u for (k, (_, s)), u in zip(own.items(), upper, strict=True) for i, p in enumerate(s)}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string").repartition(5)


def made(sizes):
    rows, doc = [], 0
    for k, n in enumerate(sizes):
        for j in range(n):
            doc += 1
            rows.append((doc * 7 % 1009, None if k == 0 else f"s{k}é", None if j % 3 else "en", j, None if j % 4 == 3 else "Text " * (j % 5), "x", "y"))
    return rows


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(16, 3, [40, 1, 17, 16, 300]), (2, 1, [9, 1, 8, 33]), (3, 2, [10, 100, 1, 2, 9, 28, 81, 82, 5, 5, 5]), (4, 2, [64])])
def test_against_plain_levels(spark, fanout, levels, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 37)
    monkeypatch.setattr(merkle, "BATCH", 7)
    rows = made(sizes)
    trees = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[0]):
        trees["" if r[1] is None else f"={r[1]}"].append((r[0], leaf_of(r[:5])))
    root, subroots, steps = brute({k: [d for _, d in v] for k, v in trees.items()}, fanout)
    manifest = merkle.merkle_manifest(table(spark, rows), fanout=fanout, levels=levels)
    assert manifest.root() == root
    found = merkle.inclusion_proofs(manifest).withColumn("back", merkle.folded(F.col("proof"), F.col("digest"))).collect()
    got = sorted((r["tree"], r["index"], r["name"], r["digest"], r["subroot"], [tuple(x) for x in r["proof"]], r["root"], r["back"]) for r in found)
    assert got == sorted((k, i, n, d, subroots[k], steps[k, i], root, root) for k, v in trees.items() for i, (n, d) in enumerate(v))


def test_query_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [(i, None if (i or 0) % 5 == 0 else f"src{(i or 0) % 3}", "en" if (i or 0) % 2 else None, None if (i or 0) % 7 == 0 else len(t or ""), t) for i, t in [*awkward(), (3, "Ab"), (3, "Ab"), (3, "aB"), (None, "Null"), (None, None), *((i, "Upper") for i in range(1000, 1012))]]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int").write.parquet(f"{tmp_path}/documents.parquet")
    trees = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        tampered = leaf_of([*r[:4], low]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf_of(r)
        trees["" if r[1] is None else f"={r[1]}"].append((-1 if r[0] is None else r[0], leaf_of(r), tampered))
    trees = {k: sorted(v) for k, v in trees.items()}
    root, subroots, steps = brute({k: [d for _, d, _ in v] for k, v in trees.items()}, 16)
    want = []
    for k, v in trees.items():
        for i, (doc, digest, fold) in enumerate(v):
            for left, right in steps[k, i]:
                fold = H(left, fold, right)
            want.append((doc, digest, subroots[k], root, H(*(x for s in steps[k, i] for x in s)), fold, fold == root))
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-1)), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r["verified"] for r in got}) == 2


def test_one_leaf_and_none(spark, tmp_path):
    one = merkle.merkle_manifest(table(spark, [(1, "s", None, 2, "ab", "x", "y")]))
    assert one.root() == leaf_of((1, "s", None, 2, "ab")) and merkle.inclusion_proofs(one).first()["proof"] == []
    none = merkle.merkle_manifest(frame(spark, [(1, "x")]).limit(0))
    assert none.root() is None and merkle.inclusion_proofs(none).count() == 0
