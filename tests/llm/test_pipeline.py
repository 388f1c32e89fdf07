import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import awkward, frame
from tests.llm.test_operators import brute_components, brute_hits
from tidemark.llm import common, quality_rules, secret_ledger


def test_stages_one_by_one(spark, tmp_path):
    bench = str(tmp_path)
    item = " ".join(awkward()[20][1].split()[10:25])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    long = " ".join(f"v{k}" for k in range(40))
    docs = frame(spark, [*awkward(), (500, f"{long} {item} and more"), (501, f"{long} x password = hunter22 tail")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = common.staged(stage(spark, docs, bench), "stage")
        rows = {r["doc_id"]: r for r in after.collect()}
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            assert set(rows) == {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()} >= {500, 501}
        if k == 1:
            assert set(rows) == {i for i, (_, c) in brute_components(list(before.items())).items() if i == c}
        if k == 2:
            hits = brute_hits(list(before.items()), [(1, item)])
            assert 500 in rows and item not in rows[500]["text"] and rows[500]["n_chars"] == len(rows[500]["text"])
            assert set(rows) == {i for i, (n, h, _) in hits.items() if h < n or not h}
            assert all(rows[i]["text"] == before[i] for i in rows if not hits[i][1])
        if k == 3:
            assert set(rows) == set(before) and "<SECRET>" in rows[501]["text"]
            assert not any(secret_ledger.find_secrets(r["text"] or "") for r in rows.values())
        if k == 4:
            assert set(rows) == set(before)
            assert all(len(r["ids"]) == 4 * r["n_tokens"] == np.frombuffer(r["ids"], "<u4").nbytes for r in rows.values())
        docs = after


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, [(0, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_other_columns(spark):
    """Also those with names that the stages use themselves."""
    from tests.compare import SMALL

    own = {c: F.lit(k) for k, c in enumerate(["spans", "kept", "_doc", "__body", "_Spans", "_body", "body", "a.b", "cleaned", "lines", "n_docs", "item_id"])}
    docs = common.documents(spark, SMALL).select("*", *[v.alias(c) for c, v in own.items()])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.staged(stage(spark, docs, SMALL), "stage")
    assert docs.columns[-len(own) :] == list(own) and docs.count() > 0
    assert docs.filter(" OR ".join(f"`{c}` IS DISTINCT FROM {k}" for k, c in enumerate(own))).count() == 0


def test_frequent_lines_go_from_the_texts(spark, tmp_path):
    """A line in more than 50 documents of a host stays in its first document only, also where its case, spaces and digits differ."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    line = lambda i: ["Read more on page 12", "read  MORE on page 47 "][i % 2]
    texts = [(2 * i, f"{line(i)}\n{body(i)}\n\n{line(i + 1)}\ntail{i} é漢\n") for i in range(60)]
    texts += [(200, texts[0][1]), (7, f"{line(0)}\n{body(7)}"), (300, f"{line(0)}\n{body(300)}"), (300, f"{body(301)}\n{line(0)}")]  # a copy of the first document, another host, an id of two texts
    before = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "h").otherwise("other"))
    after = corpus_pipeline.quality(spark, before, str(tmp_path))
    rows = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect())
    whole = {0, 7}
    want = [(i, t if i in whole else "\n".join(x for x in t.split("\n") if "more" not in x.lower())) for i, t in texts]
    assert rows == sorted((i, t, len(t)) for i, t in want)
    assert after.columns == before.columns and quality_rules.lost_lines(after).count() == 0


def test_rows_that_share_an_id(spark, tmp_path):
    """Rows with one doc_id and different texts are judged each on its own; of rows that repeat one stays."""
    words = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    spark.createDataFrame([(None, words("q", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, words("a")), (1, words("a")), (1, words("b")), (1, words("b") + " end"), (2, words("a") + " tail"), (3, "short"), (3, words("c") + " token = abcdef12"), (3, words("d")), (4, words("q", 12) + " " + words("e")), (5, None)]
    docs = frame(spark, texts).withColumn("body", F.lit("x")).withColumn("_spans", F.lit(1))
    want = [
        [*texts[:5], *texts[6:9]],
        [(1, words("a")), (1, min([words("b"), words("b") + " end"], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])), *texts[6:9]],
    ]
    want.append([(i, t.replace(words("q", 12), "")) for i, t in want[1]])
    want.append([(i, t.replace("token = abcdef12", "<SECRET>")) for i, t in want[2]])
    for (_, stage), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = common.staged(stage(spark, docs, str(tmp_path)), "stage")
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows)
    assert docs.columns[-2:] == ["body", "_spans"] and docs.filter("body = 'x' AND _spans = 1").count() == len(want[3])
    assert corpus_pipeline.encoding(spark, docs, str(tmp_path)).count() == len(want[3])
