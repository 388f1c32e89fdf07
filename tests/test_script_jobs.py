"""How the work on scripts is laid out: over tasks, once on each script, in time that follows the length of a text."""

import time

import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tidemark.functions import script_text
from tidemark.jobs import queries
from tidemark.operators import corpus

LARGE = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["auto_bind", "entry_conditions", "dataframe_strategies", "script_features", "distinct_indicators", "name_unknown", "curate", "corpus_report", "assemblable", "unknown_tally"])
def test_scripts_are_dealt_over_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(queries.QUERIES[name](spark, SMALL))


def test_tasks_follow_the_rows(spark):
    assert [queries.scripts(spark, d).rdd.getNumPartitions() for d in (SMALL, LARGE)] == [1, 5]


def test_only_the_calls_asked_for():
    text = "// go(1)\nx = f(go(a, \"b)\"), go[1])\n3go(2) + a.go(3) + go (g(4, go(5))) + go(6"
    every = script_text.calls(text)
    assert [(c.name, c.args) for c in every] == [("f", ('go(a, "b)")', "go[1]")), ("go", ("a", '"b)"')), ("go", ("2",)), ("a.go", ("3",)), ("go", ("g(4, go(5))",)), ("g", ("4", "go(5)")), ("go", ("5",))]
    assert script_text.calls(text, {"go"}) == [c for c in every if c.name == "go"]


def test_assignments_over_lines():
    text = "var float a = b + // more\n  c\nbool  d := e(\n f,\n g)\na = 2\nh == 1\nk =\n\n  and 3"
    assert script_text.assignments(text) == {"a": "b + c", "d": "e( f, g)", "k": ""}


def test_entry_and_bindings_agree_with_both():
    text = "go = fast > slow\nfast = ta.ema(close, len)\nalertcondition(go, 'long')"
    assert script_text.entry_and_bindings(text, {"len"}, corpus.BINDABLE) == ("BOTH", ["fast > slow"], [("fast", "EMA", "len")])


def test_frame_parameters_of_a_long_class():
    """What a call is assigned to is found from the call backwards: 4,000 calls took minutes when each searched the text before it."""
    lines = [f"    n{i} = IntParameter(1, 50, default={i})" for i in range(4000)]
    began = time.time()
    assert len(script_text.frame_parameters("class A(IStrategy):\n" + "\n".join(lines))) == 4000
    assert time.time() - began < 5
    assert script_text.assigned_to("dataframe['a'] \n= f(", 17) == ("a", None) and script_text.assigned_to("a == f(", 5) == (None, None) and script_text.assigned_to("x9 =f(", 4) == (None, "x9")


def test_a_pattern_is_evaluated_once(spark):
    assert plan(queries.script_features(spark, SMALL)).count("(?:timeframe|resolution)") == 1
    assert plan(queries.distinct_indicators(spark, SMALL)).count(r"ta\.rsi\s*\(") == 1


def test_a_record_is_read_once(spark):
    s, fixed = queries.scripts(spark, SMALL), queries._curation(spark, SMALL)
    assert plan(corpus.spec_records(s, 0, fixed)).count("ArrowEvalPython") == 1


def test_a_filter_on_the_text_stays_above_the_dealing(spark):
    """Pushed below it, with the text's whole expression, it ran in the one task that reads the file."""
    for rows in (corpus.script_features(queries.scripts(spark, SMALL)), queries.scripts(spark, SMALL).withColumn("name", corpus.title(F.col("source_text")))):
        steps = rows.filter(F.col("name") == corpus.NO_TITLE)._jdf.queryExecution().optimizedPlan().toString()
        below = steps[steps.rindex("RepartitionByExpression") :]
        assert "alertcondition" not in below and "(?i)" not in below


def test_untitled_scripts_are_read_once(spark):
    """What is numbered is read three times, so its scripts are made once before; a place among edges takes few comparisons."""
    assert plan(queries.name_unknown(spark, SMALL)).count("FileScan parquet") == 1
    for edges in ([], [f"{i:03}" for i in range(5)], [f"{i:03}" for i in range(16)], [f"{i:03}" for i in range(100)], [f"{i:03}" for i in range(256)]):
        rows = spark.createDataFrame([(x,) for x in ("", "0", "000", "0000", "015", "0155", "016", "099", "255", "9", None)], "x string").withColumn("n", corpus.edges_below(F.col("x"), edges)).collect()
        assert [r["n"] for r in rows] == [sum(r["x"] is not None and e <= r["x"] for e in edges) for r in rows]


def test_numbers_follow_the_order(spark):
    rows = spark.range(3000).select(F.concat(F.lit("part/"), (F.col("id") * 7 % 3000).cast("string")).alias("url"), F.lit(corpus.NO_TITLE).alias("name"))
    urls = [r["url"] for r in rows.collect()]
    assert {r["url"]: r["name"] for r in corpus.name_unknown(rows).collect()} == {u: f"UnknownST{i + 1}" for i, u in enumerate(sorted(urls))}


def test_a_report_reads_scripts_no_more_often_than_it_must(spark):
    """Once for features, once for records, twice for corrections: nothing of a report needs the numbers of untitled scripts."""
    assert plan(queries.corpus_report(spark, SMALL)).count("FileScan parquet") == 4


def test_inputs_of_a_text(spark):
    cases = {
        "éab = input.int(3)\n9a=input.float( 1.5, 2)": {"ab": "3.0", "9a": "1.5"},
        "a = input.int(1)\nb = a.input.int(5)\na\n =\tinput.int (2)": {"a": "2.0"},
        "s = input.string( )\nn = input.int( )\nq = input.bool(true)\nshowX = input.bool(true)": {"s": "", "q": "true"},
        "nothing": {},
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("p", corpus.extract_inputs(F.col("t")))
    assert {r["t"]: r["p"] for r in rows.collect()} == cases
    assert plan(rows).count("regexp_extract_all") == 1
