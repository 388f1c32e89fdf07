import os

import pytest
from pyspark.sql import functions as F

from tests.bars import bars
from tidemark.jobs.rank_files import rank_files
from tidemark.sources import specs, stores


def files(folder) -> dict:
    return {os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def registry(spark, rows):
    return spark.createDataFrame(rows, "url string, status string, seq long")


def test_untouched_parts_keep_their_files(spark, tmp_path):
    store = stores.Store(f"{tmp_path}/r", ["url"], 16)
    assert store.read(spark) is None
    stores.add_to_registry(store, registry(spark, [(f"u{i}", "pending", i) for i in range(200)]))
    before = files(tmp_path)
    touched = stores.add_to_registry(store, registry(spark, [("u7", "done", 1), ("u7", "error", 2), (None, "odd", 3)]))
    after = files(tmp_path)
    kept = {p for p in before if not any(f"part_of_16={k}/" in p for k in touched)}
    assert 1 <= len(touched) <= 2 and kept and all(after.get(p) == before[p] for p in kept)
    rows = {r["url"]: r["status"] for r in store.read(spark).collect()}
    assert len(rows) == 201 and rows["u7"] == "error" and rows[None] == "odd" and rows["u8"] == "pending"


def test_a_batch_twice_and_an_empty_one_change_nothing(spark, tmp_path):
    store = stores.Store(f"{tmp_path}/r", ["url"], 4)
    batch = registry(spark, [("a", "done", 1), ("b", "error", 1)])
    for b in (batch, batch, batch.limit(0)):
        stores.add_to_registry(store, b, "ignore")
    assert sorted(map(tuple, store.read(spark).collect())) == [("a", "done"), ("b", "error")]
    assert stores.add_to_registry(store, batch.limit(0)) == []


def test_another_number_of_parts_is_refused(spark, tmp_path):
    stores.add_to_registry(stores.Store(f"{tmp_path}/r", ["url"], 4), registry(spark, [("a", "done", 1)]))
    with pytest.raises(ValueError, match="other parts"):
        stores.Store(f"{tmp_path}/r", ["url"], 8).read(spark)


def test_contents_are_only_appended(spark, tmp_path):
    contents, urls = stores.Store(f"{tmp_path}/c", ["raw_hash"], 2), stores.Store(f"{tmp_path}/u", ["raw_hash"], 2)
    frame = lambda rows: spark.createDataFrame(rows, "url string, source_text string, seq long")
    stores.add_scripts(contents, urls, frame([("u1", "a", 1), ("u2", "b", 2), ("u3", None, 3), ("u4", "a", 4)]))
    before = files(f"{tmp_path}/c")
    stores.add_scripts(contents, urls, frame([("u5", "b", 5), ("u6", "c", 6), ("u7", None, 7), ("u8", "", 8)]))
    after = files(f"{tmp_path}/c")
    assert all(after.get(p) == t for p, t in before.items())
    assert sorted(str(r["source_text"]) for r in contents.read(spark).collect()) == ["", "None", "a", "b", "c"]
    assert sorted(r["url"] for r in urls.read(spark).collect()) == ["u4", "u5", "u6", "u7", "u8"]


def test_records_keep_their_time(spark, tmp_path):
    store = stores.Store(f"{tmp_path}/s", ["id"], 4)
    frame = lambda rows: spark.createDataFrame(rows, "id string, createdAt long, name string")
    stores.add_specs(store, frame([("a", 1, "x"), ("b", 2, "y")]))
    stores.add_specs(store, frame([("b", 9, "z"), ("b", 8, "w"), ("c", 9, "v")]))
    assert sorted(map(tuple, store.read(spark).collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 9, "v")]


def test_ranking_of_files(spark, tmp_path):
    record = '{"id": "%s", "strategyType": "condition", "entry": {"direction": "BUY", "conditions": ["close > %d"]}, "exit": {"conditions": ["close < 100"]}}'
    for k, least in (("one", 100), ("two", 115)):
        os.makedirs(f"{tmp_path}/specs", exist_ok=True)
        with open(f"{tmp_path}/specs/{k}.json", "w") as f:
            f.write(record % (k, least))
    candles = bars(spark, [100, 110, 90, 120, 130]).withColumn("symbol", F.lit("2024")).withColumn("timeframe", F.lit("1d"))  # names that look like numbers
    assert rank_files(spark, candles, f"{tmp_path}/specs", f"{tmp_path}/out") == 2
    results = {r["spec_id"]: r for r in specs.read_results(spark, f"{tmp_path}/out/results").collect()}
    assert {k: len(r["trades"]) for k, r in results.items()} == {"one": 2, "two": 1}
    assert all((r["market"], r["symbol"], r["timeframe"]) == ("2024", "2024", "1d") for r in results.values())
    assert sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/out/table").collect()) == ["one", "two"]
    specs.write_specs(specs.read_specs(spark, f"{tmp_path}/specs").drop("file"), None, f"{tmp_path}/again")
    assert rank_files(spark, candles, f"{tmp_path}/again", f"{tmp_path}/out2", windows=True, one_a_file=False) == 2
