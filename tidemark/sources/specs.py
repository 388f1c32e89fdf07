"""Strategy records: reading with defaults and checks, writing, and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.corpus import keep_created_at
from tidemark.schemas import DIRECTIONS, KEYS, SPEC, STRATEGY_TYPES


def with_defaults(specs: DataFrame) -> DataFrame:
    """Missing version, asset class, parser, confidence and time filled in; a record with a bad type, direction or confidence is refused."""
    filled = specs.withColumns(
        {
            "version": F.coalesce("version", F.lit("1")),
            "assetClass": F.coalesce("assetClass", F.lit("any")),
            "parsedBy": F.coalesce("parsedBy", F.lit("static")),
            "confidence": F.coalesce("confidence", F.lit(1.0)),
            "createdAt": F.coalesce("createdAt", F.unix_millis(F.current_timestamp())),
        }
    )
    good = F.col("strategyType").isin(*STRATEGY_TYPES) & F.col("entry.direction").isin(*DIRECTIONS) & F.col("confidence").between(0, 1) & F.col("id").isNotNull()
    refused = F.raise_error(F.concat(F.lit("bad strategy record "), F.coalesce("id", F.lit("without id")))).cast("string")
    return filled.withColumn("id", F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(refused))


def read_specs(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Records of JSON files, one a file, or one a line as `write_specs` leaves them, with the file's name for their order."""
    raw = spark.read.schema(SPEC).option("multiLine", one_a_file).option("mode", "FAILFAST").json(path)
    return with_defaults(raw.withColumn("file", F.col("_metadata.file_name")))


def parse_spec(text: Column) -> Column:
    return F.from_json(text, SPEC)


def write_specs(specs: DataFrame, old: DataFrame | None, path: str) -> None:
    """Records by id; an id that is there already keeps its time of creation. `path` is not where `old` is read from."""
    (specs if old is None else keep_created_at(specs, old)).write.mode("overwrite").json(path)


def write_results(metrics: DataFrame, trades: DataFrame, path: str, market: str = "symbol", keys: Sequence[str] = (*KEYS, "spec_id")) -> T.StructType:
    """One record for each strategy and series with its metrics and trades in order, in folders of market and timeframe.

    A record's trades are those of one series, so their number is bounded by its bars. Gives the schema of the records, which a
    reader of a folder without any needs.
    """
    keys = list(keys)
    columns = [c for c in trades.columns if c not in keys]
    lists = trades.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("trades"))
    rows = metrics.join(lists, keys, "left").withColumn("market", F.col(market))
    rows.write.mode("overwrite").partitionBy("market", "timeframe").parquet(path)
    return rows.schema


def read_results(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What `write_results` left; names of folders are strings, whatever they look like."""
    found = schema or spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("market", "timeframe") else f for f in found])).parquet(path)
