"""What a pipeline remembers between runs: values by key, and steps with their results, items done and items failed.

Everything is an append-only table of small rows, so that a run that is killed loses at most the note it was writing.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.session import delete, exists

_NOTE = "kind string, name string, value string, at double"


@dataclass
class Notes:
    """Notes (kind, name, value) at a path; the latest of a kind and name holds."""

    spark: SparkSession
    path: str

    def add(self, kind: str, *named: tuple[str, Any]) -> None:
        """Append notes of one kind: names and values (anything that JSON can say)."""
        rows = [(kind, name, json.dumps(value, ensure_ascii=False, default=str), time.time()) for name, value in named]
        self.spark.createDataFrame(rows, _NOTE).coalesce(1).write.mode("append").parquet(self.path)

    def table(self, kind: str) -> DataFrame:
        """(name, value) of the latest notes of a kind; value is JSON."""
        rows = self.spark.read.schema(_NOTE).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], _NOTE)
        return rows.where(F.col("kind") == kind).groupBy("name").agg(F.max_by("value", "at").alias("value"))

    def clear(self) -> None:
        """Forget everything."""
        delete(self.spark, self.path)


class KeyValues(Notes):
    """Values by key; there are few, they are a pipeline's own settings."""

    def update(self, **values: Any) -> None:
        """Set values; others stay."""
        if values:
            self.add("value", *values.items())

    def get(self) -> dict[str, Any]:
        """All values."""
        return {r["name"]: json.loads(r["value"]) for r in self.table("value").collect()}

    def has_any(self) -> bool:
        """Whether anything is kept."""
        return not self.table("value").isEmpty()


class Steps(Notes):
    """Steps that are complete with their results, items that were processed and items that failed."""

    def complete(self, step: str, result: Any = None) -> None:
        """Note that a step is complete."""
        self.add("step", (step, result))

    def is_complete(self, step: str) -> bool:
        """Whether it is."""
        return not self.table("step").where(F.col("name") == step).isEmpty()

    def result(self, step: str) -> Any:
        """The result of a step; None without one."""
        row = self.table("step").where(F.col("name") == step).first()
        return None if row is None else json.loads(row["value"])

    def processed(self, *items: str) -> None:
        """Note items that were processed."""
        self.add("item", *((i, None) for i in items))

    def failed(self, item: str, error: str) -> None:
        """Note an item that failed, and why."""
        self.add("failed", (item, error))

    def failures(self) -> DataFrame:
        """(item, error) of the items that failed and were not processed later."""
        bad = self.table("failed").join(self.table("item").select("name"), "name", "left_anti")
        return bad.select(F.col("name").alias("item"), F.get_json_object(F.concat(F.lit('{"e":'), "value", F.lit("}")), "$.e").alias("error"))

    def unprocessed(self, items: DataFrame, column: str) -> DataFrame:
        """The rows of items of which column was not processed, by an anti-join: items may be many."""
        done = self.table("item").select(F.col("name").alias("__done"))
        return items.join(done, F.col(column) == F.col("__done"), "left_anti")

    def step(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        """A decorator: the function runs once, later calls give its noted result."""

        def decorate(work: Callable[..., Any]) -> Callable[..., Any]:
            @functools.wraps(work)
            def run(*args: Any, **kwargs: Any) -> Any:
                if self.is_complete(name):
                    return self.result(name)
                result = work(*args, **kwargs)
                self.complete(name, result)
                return result

            return run

        return decorate


def _status(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at and under path; 0 where there are none."""
    system, target = _status(spark, path)
    return system.getContentSummary(target).getLength() if system.exists(target) else 0


def free_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that are free where path lies."""
    system, target = _status(spark, path)
    return system.getStatus(target).getRemaining()


def clean_up(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """Remove intermediate results; (path, bytes) of each. Callers name what a run wrote itself, never an input."""
    report = [(path, size_of(spark, path)) for path in paths]
    for path in paths:
        delete(spark, path)
    return report
