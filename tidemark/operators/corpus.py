"""Jobs over a corpus of strategy scripts: features by patterns, records, curation, registry and tallies.

Pattern features are column expressions in one pass over the text; what needs balanced parentheses is one Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import clean_link, confidence, normalise_newlines, raw_hash, spec_id
from tidemark.functions.script_text import EVALUABLE, entry_and_bindings, frame_strategy
from tidemark.operators.blocks import cut
from tidemark.schemas import SPEC

# Function name -> (type, names of its numeric arguments). Functions marked bare take no series before them.
_SERIES_FIRST = {"rsi": "RSI", "ema": "EMA", "sma": "SMA", "mom": "MOM", "pivothigh": "PIVOT_HIGH", "pivotlow": "PIVOT_LOW", "highest": "HIGHEST_HIGH", "lowest": "LOWEST_LOW"}
_SERIES_FIRST |= {"cci": "CCI", "wma": "WMA", "hma": "HMA", "rma": "RMA", "roc": "ROC", "mfi": "MFI", "stdev": "STDDEV"}
_NUMBER_FIRST = {"atr": "ATR", "adx": "ADX"}
_NO_NUMBER = {"macd": "MACD", "bb": "BB", "stoch": "STOCH", "vwap": "VWAP"}
_TWO_NUMBERS = {"tsi": ("TSI", "longPeriod", "shortPeriod"), "linreg": ("LINREG", "period", "offset"), "dmi": ("DMI", "diLength", "adxSmoothing")}
KNOWN_CALLS = sorted({*_SERIES_FIRST, *_NUMBER_FIRST, *_NO_NUMBER, *_TWO_NUMBERS, "variance", "correlation"})
# Functions of the library that are no indicators, and those that a name can be bound to.
HELPER_CALLS = ["crossover", "crossunder", "cross", "change", "barssince", "valuewhen", "rising", "falling", "cum", "highestbars", "lowestbars", "pivot_point_levels"]
BINDABLE = {"rsi": "RSI", "ema": "EMA", "sma": "SMA", "wma": "WMA", "hma": "HMA", "rma": "RMA", "roc": "ROC", "mom": "MOM", "atr": "ATR", "tr": "TR", "cci": "CCI", "adx": "ADX"}
BINDABLE |= {"vwap": "VWAP", "vwma": "VWMA", "stdev": "STDDEV", "supertrend": "SUPERTREND"}
# Names of display settings, the text of the skip reason, the title of a script without one.
DISPLAY_NAME = r"(?i)^(show|hide|draw|display|enable|disable|label|table)|(colou?r|style|width|transp(arency)?|size|pos(ition)?|offset|decimals|linewidth|textsize)(input)?$|_col$"
NO_SIGNALS = "no_signals: pure indicator/visualization"
NO_TITLE = "Unknown Strategy"
# What makes a script tradeable; the types of scripts, the first that occurs so often counts; signs of a complex one.
TRADEABLE = r"alertcondition\s*\(|strategy\.entry\s*\(|plotshape\s*\("
TYPES = [
    ("mtf_scored", r"request\.security\s*\(", 2),
    ("session", r'time\s*\(\s*timeframe\.period\s*,\s*"[\d:]+-[\d:]+|in_asia|in_lon|in_ny|isAsia|isLondon', 1),
    ("scored", r"score\s*\+=|score\s*:=\s*\d|rawScore", 1),
    ("pattern", r"ta\.pivothigh|ta\.pivotlow", 1),
]
COMPLEX = r"request\.security|f_\w+\s*\(|calcTSI|f_t3"
# Where a title and a timeframe stand, codes and words of timeframes.
TITLE_FIRST = r"(?i)(?:indicator|strategy)\s*\(\s*(?:title\s*=\s*)?[\"']([^\"'\n]{1,80})[\"']"
TITLE_SHORT = r"(?i)(?:indicator|strategy)\s*\([^)]*?shorttitle\s*=\s*[\"']([^\"'\n]{1,80})[\"']"
FRAME_ARGUMENT = r"(?i)(?:indicator|strategy)\s*\([^)]*?\b(?:timeframe|resolution)\s*=\s*[\"']([^\"'\n]+)[\"']"
FRAME_TAG = r"(?i)[(\[]\s*(\d+\s*[mhdw]|daily|hourly|weekly|monthly)\s*[)\]]"
FRAME_WORD = r"(?i)\b(15m|5m|30m|1h|4h|hourly|daily|weekly|monthly)\b"
FRAME_CODES = {"D": "1d", "1D": "1d", "W": "1w", "1W": "1w", "M": "1M", "1M": "1M"}
FRAME_WORDS = {"hourly": "1h", "daily": "1d", "weekly": "1w", "monthly": "1M", "60m": "1h"}
_CALL = r"ta\.%s\s*\("
_ARG = r"\s*\w+\s*,\s*"
_NUM = r"(\d+)"


#: Rows of a task where each row makes long work.
TASK_ROWS = 4000


def spread(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows dealt over tasks of about `task_rows`: a file of short rows is one task, however long the work on each is. Counts the rows, so they should come straight from a table."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)), key)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def matches_with(text: Column, words: Sequence[str], pattern: str, group: int = 0) -> Column:
    """The same for a pattern that only matches around one of these words: most texts lack them, and finding that out takes no pattern."""
    lacks = reduce(lambda x, y: x & y, [~F.contains(text, F.lit(w)) for w in words])
    return F.when(lacks, F.array().cast("array<string>")).otherwise(all_matches(text, pattern, group))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, worked out once a row: a filter on one of them stays above, where the optimizer would else copy its whole expression, text and all, into a filter below."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def is_tradeable(text: Column) -> Column:
    return text.rlike(TRADEABLE)


def skip_reason(tradeable: Column) -> Column:
    return F.when(~tradeable, NO_SIGNALS)


def is_evaluable(condition: Column) -> Column:
    return condition.rlike(EVALUABLE)


def extract_indicators(text: Column) -> Column:
    """array<struct<type, params map<string,double>, outputKey>>, each once, in the order of the pattern table."""
    item = "struct<type:string,params:map<string,double>,outputKey:string>"

    def rows(kind: str, names: Sequence[str], matches: Sequence[Column]) -> Column:
        zipped = F.arrays_zip(*[m.alias(f"m{i}") for i, m in enumerate(matches)])

        def one(z: Column) -> Column:
            params = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), z[f"m{i}"].cast("double"))]) if names else F.create_map()
            key = F.concat(F.lit(kind.lower()), z["m0"]) if names[:1] == ["period"] else F.lit(kind.lower())
            return F.struct(F.lit(kind).alias("type"), params.cast("map<string,double>").alias("params"), key.alias("outputKey"))

        # maps have no equality, so repeats are found on the matched numbers
        return F.transform(F.array_distinct(zipped), one).cast(f"array<{item}>")

    found = [rows(t, ["period"], [matches_with(text, [f"ta.{f}"], _CALL % f + _ARG + _NUM, 1)]) for f, t in _SERIES_FIRST.items()]
    found += [rows(t, ["period"], [matches_with(text, [f"ta.{f}"], _CALL % f + r"\s*" + _NUM, 1)]) for f, t in _NUMBER_FIRST.items()]
    for f, t in _NO_NUMBER.items():
        pattern, words = (_CALL % f + "|BollingerBands", ["ta.bb", "BollingerBands"]) if f == "bb" else (_CALL % f, [f"ta.{f}"])
        found.append(rows(t, [], [F.transform(F.slice(matches_with(text, words, pattern), 1, 1), lambda _: F.lit(""))]))
    for f, (t, a, b) in _TWO_NUMBERS.items():
        pattern = _CALL % f + ("" if f == "dmi" else r"\s*\w+\s*,") + r"\s*" + _NUM + r"\s*,\s*" + _NUM
        found.append(rows(t, [a, b], [matches_with(text, [f"ta.{f}"], pattern, 1), matches_with(text, [f"ta.{f}"], pattern, 2)]))
    return F.concat(*found)


def unknown_calls(text: Column) -> Column:
    """Sorted names of the `ta.` functions that are neither known indicators nor helpers."""
    names = F.transform(all_matches(text, r"\bta\.([a-zA-Z_]\w*)\s*\(", 1), F.lower)
    return F.sort_array(F.array_except(names, F.array(*[F.lit(x) for x in (*KNOWN_CALLS, *HELPER_CALLS)])))


def extract_inputs(text: Column) -> Column:
    """map of a script's input names to their defaults, the last of a name; display settings are left out."""
    # a name is tried once, from its start and as a whole; the groups are taken from the short match, not by a search of the text for each
    pattern = r"(?<!\w)(\w++)\s*+=\s*+input\.(int|float|bool|string)\s*+\(\s*([^,)]+)"
    group = lambda m, i, name: F.regexp_extract(m, pattern, i).alias(name)
    rows = F.transform(matches_with(text, ["input."], pattern), lambda m: F.struct(group(m, 1, "name"), group(m, 2, "kind"), group(m, 3, "raw")))

    def value(r: Column) -> Column:
        raw = F.trim(r["raw"])
        as_number = F.regexp_extract(raw, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double").cast("string")
        text_value = F.regexp_replace(raw, "['\"]", "")
        return F.when(r["kind"].isin("int", "float"), as_number).when(r["kind"] == "bool", (raw == "true").cast("string")).otherwise(text_value)

    kept = F.filter(rows, lambda r: ~r["name"].rlike(DISPLAY_NAME))
    pairs = F.filter(F.transform(kept, lambda r: F.struct(r["name"].alias("key"), value(r).alias("value"))), lambda p: p["value"].isNotNull())
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    return last


def script_type(text: Column) -> Column:
    return F.coalesce(*[F.when(F.regexp_count(text, F.lit(pattern)) >= least, kind) for kind, pattern, least in TYPES], F.lit("condition"))


def complexity(text: Column, n_indicators: Column) -> Column:
    """simple, medium or complex, by the worst of three signs: foreign timeframes or own functions, lines, indicators."""
    lines = F.size(F.split(text, "\n"))
    grade = F.greatest(text.rlike(COMPLEX).cast("int") * 2, (lines > 100).cast("int") + (lines > 200).cast("int"), (n_indicators > 4).cast("int"))
    return F.element_at(F.array(*map(F.lit, ("simple", "medium", "complex"))), grade + 1)


def _group(text: Column, pattern: str) -> Column:
    """The first group of a pattern, NULL where it doesn't match or is empty."""
    return _let(F.regexp_extract(text, pattern, 1), lambda x: F.nullif(x, F.lit("")))


def title(text: Column) -> Column:
    return F.coalesce(F.trim(F.coalesce(_group(text, TITLE_FIRST), _group(text, TITLE_SHORT))), F.lit(NO_TITLE))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def timeframe(text: Column, name: Column) -> Column:
    """From a timeframe argument, else from a tag or a word in the title; NULL where neither says."""

    def of_code(code: Column) -> Column:
        minutes = F.when(code.rlike(r"^\d+$"), code.try_cast("int"))
        hours = F.when((minutes >= 60) & (minutes % 60 == 0), F.concat((minutes / 60).cast("int").cast("string"), F.lit("h")))
        counted = F.coalesce(hours, F.when(minutes.between(1, 59), F.concat(minutes.cast("string"), F.lit("m"))))
        return F.when(code.isNotNull(), F.coalesce(counted, F.try_element_at(_table(FRAME_CODES), code))).otherwise(from_title)

    said = F.regexp_replace(F.lower(F.coalesce(_group(name, FRAME_TAG), _group(name, FRAME_WORD))), r"\s+", "")
    from_title = _let(said, lambda x: F.coalesce(F.try_element_at(_table(FRAME_WORDS), x), F.when(x.rlike(r"^\d+[mhdw]$"), x)))
    return _let(F.upper(F.trim(_group(text, FRAME_ARGUMENT))), of_code)


_ENTRY = "direction string, conditions array<string>, bindings array<struct<name:string,type:string,period:string>>"
_BINDING = pa.struct([(c, pa.string()) for c in ("name", "type", "period")])
_ENTRY_ARROW = pa.struct([("direction", pa.string()), ("conditions", pa.list_(pa.string())), ("bindings", pa.list_(_BINDING))])


def _read(texts: pa.Array, inputs: pa.Array) -> Iterator[tuple[str, list[str], list[tuple[str, str, str | None]]]]:
    """Direction, conditions and bindings of texts with the names of their inputs."""
    for t, p in zip(texts.to_pylist(), inputs.to_pylist(), strict=True):
        yield entry_and_bindings(t or "", p or (), BINDABLE)


def entry_conditions(scripts: DataFrame, text: str = "source_text", parameters: str = "parameters") -> DataFrame:
    """scripts with the column `entry`: struct(direction, conditions, bindings); one Arrow pass for X8 and X9's text work."""

    @F.arrow_udf(_ENTRY)
    def read(texts: pa.Array, inputs: pa.Array) -> pa.Array:
        rows = [(d, c, [{"name": n, "type": k, "period": x} for n, k, x in found]) for d, c, found in _read(texts, inputs)]
        return pa.array([dict(zip(("direction", "conditions", "bindings"), r, strict=True)) for r in rows], _ENTRY_ARROW)

    return scripts.withColumn("entry", read.asNondeterministic()(F.col(text), F.map_keys(parameters)))  # else the optimizer repeats it for each field


def auto_bind(scripts: DataFrame, text: str = "source_text", parameters: str = "parameters") -> DataFrame:
    """One row for each binding of each script: url, name, type, period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(url, *x) for url, r in zip(b.column("url").to_pylist(), _read(b.column("t"), b.column("p")), strict=True) for x in r[2]]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["url", "name", "type", "period"])

    return scripts.select(F.col("url").cast("string").alias("url"), F.col(text).alias("t"), F.map_keys(parameters).alias("p")).mapInArrow(run, "url string, name string, type string, period string")


def script_features(scripts: DataFrame) -> DataFrame:
    """All pattern features of scripts(url, source_text), one narrow pass."""
    rows = scripts.withColumn("raw_hash", raw_hash(F.col("source_text"))).withColumn("source_text", normalise_newlines(F.col("source_text")))
    text = F.col("source_text")
    rows = once(rows, is_tradeable=is_tradeable(text))
    rows = rows.withColumns({"indicators": extract_indicators(text), "parameters": extract_inputs(text), "unknown": unknown_calls(text), "name": title(text)})
    return rows.withColumns(
        {
            "skip_reason": skip_reason(F.col("is_tradeable")),
            "strategy_type": script_type(text),
            "complexity": complexity(text, F.size("indicators")),
            "timeframe": timeframe(text, F.col("name")),
        }
    )


def script_specs(scripts: DataFrame) -> DataFrame:
    """Records of the tradeable scripts: features, entry, confidence and id."""
    rows = entry_conditions(script_features(scripts).filter("is_tradeable"))
    logic = F.exists("entry.conditions", is_evaluable)
    score = confidence(F.col("strategy_type"), F.size("indicators"), F.col("entry.direction"), logic, F.size("parameters"), F.lit(False), F.col("complexity"))
    return rows.withColumns({"confidence": score, "id": spec_id(F.col("name"), F.col("raw_hash")), "evaluable": logic})


def spec_records(scripts: DataFrame, created_at: int | None = None, curation: DataFrame | None = None, number: bool = True) -> DataFrame:
    """Records in the form of SPEC of the tradeable scripts(url, source_text) that `curation` doesn't skip, those without a title numbered by url.

    Without `number` those all keep one name, for reports that look at neither names nor ids.
    """
    rows = scripts
    if curation is not None:
        rows = rows.withColumn("_hash", raw_hash(F.col("source_text"))).join(curation.filter("skip IS NOT NULL").select(F.col("raw_hash").alias("_hash")).distinct(), "_hash", "left_anti").drop("_hash")
    # numbers need no more of a script than its title, so they come first: the long work is done once on each script
    text = normalise_newlines(F.col("source_text"))
    if number:
        rows = name_unknown(once(rows, _tradeable=is_tradeable(text), name=title(text)).filter("_tradeable").drop("_tradeable")).withColumnRenamed("name", "_name")
    rows = script_specs(rows)
    if number:
        rows = rows.withColumn("name", F.col("_name")).withColumn("id", spec_id(F.col("name"), F.col("raw_hash")))
    text_map = lambda m: F.transform_values(m, lambda k, v: F.regexp_replace(v.cast("string"), r"\.0$", ""))
    indicators = F.transform("indicators", lambda x: F.struct(x["type"].alias("type"), text_map(x["params"]).alias("params"), F.lit("close").alias("input"), x["outputKey"].alias("outputKey")))
    params = lambda b: F.when(b["period"].isNotNull(), F.create_map(F.lit("period"), b["period"])).otherwise(F.create_map().cast("map<string,string>"))
    bound = F.transform("entry.bindings", lambda b: F.struct(b["name"].alias("key"), F.struct(b["type"].alias("type"), F.lit(None).cast("string").alias("source"), params(b).alias("params")).alias("value")))
    given = {
        "source": F.col("url"), "version": F.lit("1"), "strategyType": F.col("strategy_type"), "assetClass": F.lit("any"), "indicators": indicators, "bindings": F.map_from_entries(bound),
        "exit": F.lit(None), "parsedBy": F.lit("static"), "rawHash": F.col("raw_hash"), "notes": F.lit(None), "createdAt": F.unix_millis(F.current_timestamp()) if created_at is None else F.lit(created_at),
    }
    fields = {f.name: f.dataType for f in SPEC.fields}
    entry = F.struct(*[(F.col(f"entry.{f.name}") if f.name in ("direction", "conditions") else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields["entry"].fields])
    return rows.select(*[given.get(c, entry if c == "entry" else F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()])


def edges_below(x: Column, edges: Sequence[str], block: int = 16) -> Column:
    """How many of the sorted edges are at most x: a whole number of blocks by the last edge of each, then within the block that follows."""
    strings = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    count = lambda of: F.size(F.filter(of, lambda e: e <= x))
    return _let(count(strings(edges[block - 1 :: block])) * block, lambda n: n + count(F.slice(strings(edges), n + 1, block)))


def numbered(rows: DataFrame, order: str, name: str, buckets: int = 256) -> DataFrame:
    """rows with `name`, 1, 2, ... in the order of a string column: within buckets of neighbours, after the rows of the buckets before.

    The buckets' edges are a bounded sample, so no task orders all rows and no sampling is done twice.
    """
    sample = rows.select(order).filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(16 * buckets).toPandas()[order]
    edges = sorted(set(sample))[8::16]
    rows = rows.withColumn("_bucket", edges_below(F.col(order), edges))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return rows.withColumn("_place", place).join(sizes.select("_bucket", before.alias("_before")), "_bucket").withColumn(name, F.col("_place") + F.col("_before")).drop("_bucket", "_place", "_before")


def name_unknown(specs: DataFrame) -> DataFrame:
    """Scripts without a title become UnknownST1, 2, ... in order of their url; only those rows are ordered."""
    unknown = F.col("name") == NO_TITLE
    rows = cut(specs.filter(unknown))  # read again and again: edges, sizes, places
    rows = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))  # few of each task are left, and each task of a shuffle writes a file for each task after it
    named = numbered(rows, "url", "_k").withColumn("name", F.concat(F.lit("UnknownST"), F.col("_k")))
    return specs.filter(~unknown).unionByName(named.select(specs.columns))


def distinct_indicators(calls: DataFrame) -> DataFrame:
    """calls(url, type, params) each once."""
    return calls.dropDuplicates(["url", "type", "params"])


def store_raw(scripts: DataFrame) -> DataFrame:
    """One row for each raw hash: the script that came last (by seq)."""
    rows = scripts.withColumn("raw_hash", raw_hash(F.col("source_text")))
    best = F.row_number().over(Window.partitionBy("raw_hash").orderBy(F.desc("seq"), "url"))
    return rows.withColumn("_n", best).filter("_n = 1").drop("_n")


def one_correction(curation: DataFrame) -> DataFrame:
    """One row for each raw_hash: one that skips wins, else the last by seq, where there is such a column."""
    place = F.struct(F.col("skip").isNotNull().alias("skips"), *([F.col("seq")] if "seq" in curation.columns else []))
    rows = curation.groupBy("raw_hash").agg(F.max_by(F.struct(*[c for c in curation.columns if c != "raw_hash"]), place).alias("_c"))
    return rows.select("raw_hash", "_c.*").drop("seq")


def _overlaid(old: str, new: Column, kind: T.StructType, given: T.StructType) -> Column:
    """The struct `old` with those fields of `new` that it has and that aren't null."""
    own = set(given.fieldNames())
    fields = [(F.coalesce(new[f.name].cast(f.dataType), F.col(old)[f.name]) if f.name in own else F.col(old)[f.name]).alias(f.name) for f in kind.fields]
    return F.struct(*fields)


def curate(specs: DataFrame, curation: DataFrame, key: str = "rawHash") -> DataFrame:
    """Records with the hand-made corrections of curation(raw_hash, skip, category, any columns of a record, seq).

    Skipped ones go. The others that are corrected get the columns that the correction has: `entry` and `exit` field by field, `bindings` by name,
    all others whole; they are marked `manual` with a confidence of 0.85 at least. Several corrections of one hash: see `one_correction`.
    """
    fixed = one_correction(curation)
    given = {f.name: f.dataType for f in fixed.schema.fields}
    rows = specs.join(fixed.select(F.col("raw_hash").alias(key), F.struct(*[c for c in given if c != "raw_hash"]).alias("_c")), key, "left").filter("_c.skip IS NULL")
    hit, new = F.col("_c").isNotNull(), {}
    for c, kind in ((f.name, f.dataType) for f in specs.schema.fields):
        value = F.col("_c")[c] if c in given and c not in (key, "raw_hash") else None
        if c in ("entry", "exit") and value is not None:
            new[c] = F.when(value.isNull(), F.col(c)).otherwise(_overlaid(c, value, kind, given[c]))
        elif c == "bindings" and value is not None:
            kept = F.map_filter(F.coalesce(c, F.create_map().cast(kind)), lambda k, v: ~F.array_contains(F.map_keys(F.col("_c.bindings")), k))
            new[c] = F.when(value.isNull(), F.col(c)).otherwise(F.map_concat(kept, value.cast(kind)))
        elif value is not None:
            new[c] = F.coalesce(value.cast(kind), F.col(c))
    new["parsedBy"] = F.when(hit, "manual").otherwise(F.col("parsedBy"))
    new["confidence"] = F.when(hit, F.greatest(new.get("confidence", F.col("confidence")), F.lit(0.85))).otherwise(F.col("confidence"))
    return rows.withColumns(new).select(specs.columns)


def todo_scripts(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Urls that are not yet processed."""
    return found.join(registry.filter(~F.col("status").isin("pending", "error")).select("url"), "url", "left_anti")


def todo_pages(found: DataFrame, registry: DataFrame) -> DataFrame:
    return found.join(registry.select("page_num", "listing_path"), ["page_num", "listing_path"], "left_anti")


def registry_upsert(registry: DataFrame, changes: DataFrame, keys: Sequence[str], mode: str = "replace") -> DataFrame:
    """registry with changes(..., seq): `ignore` keeps what is there and the first change, `replace` takes the last change."""
    both = registry.withColumn("_new", F.lit(0)).withColumn("seq", F.lit(-1)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = ["_new", "seq"] if mode == "ignore" else [F.desc("_new"), F.desc("seq")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("_n", first).filter("_n = 1").drop("_n", "_new", "seq")


def keep_created_at(new: DataFrame, old: DataFrame) -> DataFrame:
    """New records with the creation time of the old record of their id."""
    rows = new.join(old.select("id", F.col("createdAt").alias("_was")), "id", "left")
    return rows.withColumn("createdAt", F.coalesce("_was", "createdAt")).drop("_was")


def status_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unknown_tally(features: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Scripts that use each unknown call; with an old tally(fn, n), the sum of both."""
    now = features.select(F.explode(F.array_distinct("unknown")).alias("fn")).groupBy("fn").agg(F.count(F.lit(1)).alias("n"))
    return now if old is None else now.unionByName(old).groupBy("fn").agg(F.sum("n").alias("n"))


def _judged(features: DataFrame, curation: DataFrame) -> DataFrame:
    """features(raw_hash, ...) with _skip, the category of a script that is curated away, and _corrected."""
    fixed = one_correction(curation)
    category = F.when(F.col("skip").isNotNull(), F.coalesce("category", F.lit("uncategorised")) if "category" in fixed.columns else F.lit("uncategorised"))
    return features.join(fixed.select("raw_hash", category.alias("_skip"), F.lit(True).alias("_corrected")), "raw_hash", "left")


def skip_categories(features: DataFrame, curation: DataFrame) -> DataFrame:
    """category and n of the scripts that are curated away."""
    return _judged(features, curation).filter("_skip IS NOT NULL").groupBy(F.col("_skip").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def corpus_report(features: DataFrame, records: DataFrame, curation: DataFrame) -> DataFrame:
    """One row of counts over all scripts: features(url, raw_hash, is_tradeable), records(source, entry, confidence) as they are written, after curation.

    A script that is curated away counts as skipped whatever else it is; a tradeable one without a record failed to parse.
    """
    written = records.select(F.col("source").alias("url"), F.col("entry.conditions").alias("_conditions"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_written"))
    rows = _judged(features, curation).join(written, "url", "left")
    seen, has = F.col("_skip").isNull(), F.col("_written").isNotNull()
    n = F.coalesce(F.size("_conditions"), F.lit(0))
    clear = F.coalesce(F.exists("_conditions", is_evaluable), F.lit(False))
    high, mid = F.col("_confidence") >= 0.5, F.col("_confidence") >= 0.4
    tests = {
        "written": has, "enriched": has & F.col("_corrected").isNotNull(), "skipped": ~seen, "non_tradeable": seen & ~F.col("is_tradeable"), "parse_failed": seen & F.col("is_tradeable") & ~has,
        "entry_evaluable": has & clear, "entry_bare": has & ~clear & (n > 0), "entry_none": has & (n <= 0),
        "confidence_high": has & high, "confidence_mid": has & mid & ~high, "confidence_low": has & ~mid,
    }
    return rows.agg(*[F.coalesce(F.count_if(test), F.lit(0)).alias(name) for name, test in tests.items()])


def skip_reasons(parsed: DataFrame) -> DataFrame:
    return parsed.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id and the cleaned script links of each page's html, each once."""
    links = pages.select("page_id", F.explode(all_matches(F.col("html"), r"href=\"([^\"]+)\"", 1)).alias("href"))
    return links.withColumn("url", clean_link(F.col("href"))).filter("url IS NOT NULL").select("page_id", "url").distinct()


def dedupe_urls(links: DataFrame) -> DataFrame:
    return links.select("url").distinct()


_FRAME = "name string, timeframe string, stop_loss string, entry string, exit string, skip_reason string, bindings array<struct<name:string,type:string,params:map<string,string>>>, parameters map<string,string>, confidence double"


def dataframe_strategies(scripts: DataFrame) -> DataFrame:
    """url and the parsed record, or its skip reason, of scripts(url, source_text) of the second dialect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"url": u, **frame_strategy(t or ""), "confidence": 0.7} for u, t in zip(b["url"], b["source_text"], strict=True)]
            yield pd.DataFrame(rows, columns=["url", *(f.split(" ")[0] for f in _FRAME.split(", "))])

    return scripts.select("url", "source_text").mapInPandas(run, f"url string, {_FRAME}")
