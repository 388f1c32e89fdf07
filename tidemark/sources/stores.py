"""Stores that grow batch by batch: Parquet in parts by a hash of the keys, of which a batch reads and writes only those that it touches.

A batch is evaluated twice (which parts it touches, then its rows), so it should be a table or cheap. Rows whose keys are all null are one
key. A batch without rows changes nothing. Tasks that are lost run again: old files stay until the job commits. Between a part's old files
going and its new ones coming there is no lock, so one writer at a time; a batch that broke off is simply run again, as both kinds of
change give the same store when they are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import raw_hash
from tidemark.operators.corpus import keep_created_at, registry_upsert, store_raw


@dataclass(frozen=True)
class Store:
    """Rows by `keys` in the folder `path`. `parts` holds for the store's whole life: so many that one part fits a task."""

    path: str
    keys: Sequence[str]
    parts: int = 64

    @property
    def part(self) -> str:
        """The column of the parts; it names their number, so that a store opened with another one is refused."""
        return f"part_of_{self.parts}"

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.parts)).cast("int")

    def _all(self, spark: SparkSession) -> DataFrame | None:
        try:
            rows = spark.read.parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        if self.part not in rows.columns:
            raise ValueError(f"{self.path} has other parts than {self.parts}")
        return rows

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows, or None where nothing has been written yet."""
        rows = self._all(spark)
        return None if rows is None else rows.drop(self.part)

    def touched(self, batch: DataFrame) -> tuple[list[int], DataFrame | None]:
        """The parts that a batch touches (at most `parts` numbers), and what the store has in them."""
        places = sorted(r[0] for r in batch.select(self._place().alias("place")).distinct().collect())
        rows = self._all(batch.sparkSession)
        return places, None if rows is None else rows.filter(F.col(self.part).isin(places)).drop(self.part)

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Put merge(what is there in the parts that the batch touches, batch) in place of those parts; gives their numbers.

        merge keeps the keys, gives one row a key, and the store's columns.
        """
        places, old = self.touched(batch)
        if places:
            rows = merge(old, batch).withColumn(self.part, self._place()).repartition(self.part)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)
        return places

    def append_new(self, batch: DataFrame) -> list[int]:
        """Add the batch's rows, of one row a key, whose keys the store lacks; no file that is there is written again. For rows that their key names by content."""
        places, old = self.touched(batch)
        if places:
            keys = list(self.keys)
            if old is not None:
                there = old.select(*[F.col(k).alias(f"_old_{i}") for i, k in enumerate(keys)])
                same = [F.col(k).eqNullSafe(F.col(f"_old_{i}")) for i, k in enumerate(keys)]
                batch = batch.join(there, reduce(Column.__and__, same), "left_anti")
            batch.withColumn(self.part, self._place()).repartition(self.part).write.mode("append").partitionBy(self.part).parquet(self.path)
        return places


def add_to_registry(store: Store, changes: DataFrame, mode: str = "replace") -> list[int]:
    """`registry_upsert` of changes(keys, ..., seq) into a stored registry: `ignore` keeps what is there, `replace` takes the last change."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        there = new.drop("seq").limit(0) if old is None else old
        return registry_upsert(there, new, store.keys, mode).select(there.columns)

    return store.upsert(changes, merge)


def add_scripts(contents: Store, urls: Store, scripts: DataFrame) -> None:
    """Scripts(url, source_text, seq) into a store of contents by raw_hash, where what is there is never written again, and one of the url seen last for each."""
    last = store_raw(scripts)
    contents.append_new(last.select("raw_hash", "source_text"))
    add_to_registry(urls, scripts.select(raw_hash(F.col("source_text")).alias("raw_hash"), "url", "seq"))


def add_specs(store: Store, specs: DataFrame) -> list[int]:
    """Records by id: an id that is there keeps its time of creation and gets the new record; of a batch's records of one id the last by time, then by content, counts."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        order = Window.partitionBy("id").orderBy(F.desc("createdAt"), F.xxhash64(F.to_json(F.struct("*"))))
        one = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        if old is None:
            return one
        return keep_created_at(one, old).unionByName(old.join(one.select("id"), "id", "left_anti"), allowMissingColumns=True).select(old.columns)

    return store.upsert(specs, merge)
