"""Pipelines on the driver: named stages that are skipped once written, retries, isolated analyses, batches with state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V = TypeVar("V")


def delays(first: float, factor: float, attempts: int) -> list[float]:
    """Seconds to wait before each further attempt: first, then factor times as long each time."""
    return [first * factor**i for i in range(attempts - 1)]


def retry(action: Callable[[], V], attempts: int = 3, first: float = 1.0, factor: float = 2.0, on: type[BaseException] = Exception, sleep: Callable[[float], None] = time.sleep) -> V:
    """The result of action, tried again after growing delays; the last error is raised. For calls of the driver only: Spark retries
    tasks itself."""
    for delay in [*delays(first, factor, attempts), None]:
        try:
            return action()
        except on:
            if delay is None:
                raise
            sleep(delay)
    raise AssertionError


def safely(action: Callable[[], V], default: V) -> V:
    """The result of action, default on an error."""
    with suppress(Exception):
        return action()
    return default


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@dataclass
class Pipeline:
    """Stages in order, each a table under root. A stage whose table is complete (it has its _SUCCESS file) is read, not made again, so a
    run that is started anew goes on where the last one ended."""

    spark: SparkSession
    root: str
    log: list[tuple[str, str]] = field(default_factory=list)

    def done(self, name: str) -> bool:
        """Whether a stage is complete."""
        return _exists(self.spark, f"{self.root}/{name}/_SUCCESS")

    def stage(self, name: str, make: Callable[[], DataFrame], optional: bool = False) -> DataFrame | None:
        """The table of a stage; None if an optional one fails."""
        path = f"{self.root}/{name}"
        if self.done(name):
            self.log.append((name, "skipped"))
            return self.spark.read.parquet(path)
        try:
            make().write.mode("overwrite").parquet(path)
        except Exception:
            self.log.append((name, "failed"))
            if optional:
                return None
            raise
        self.log.append((name, "made"))
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Remove all stages' tables (never an input)."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run_all(analyses: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Run every analysis and hand its table to sink; an error is noted ('failed: ...') and the others go on."""
    status = {}
    for name, analysis in analyses.items():
        try:
            sink(name, analysis())
            status[name] = "success"
        except Exception as error:  # noqa: BLE001
            status[name] = f"failed: {str(error).splitlines()[0][:200]}"
    return status


@dataclass
class Batches:
    """Index batches with a table of those that are done, so that a run goes on where it ended."""

    spark: SparkSession
    path: str
    total: int
    size: int

    def pending(self) -> list[tuple[int, int, int]]:
        """(batch, start, end) of the batches that are not done; there are total / size of them at most, a planning table."""
        done = {r[0] for r in self.spark.read.parquet(self.path).select("batch").collect()} if _exists(self.spark, self.path) else set()
        every = range(-(-self.total // self.size))
        return [(b, b * self.size, min(self.total, (b + 1) * self.size)) for b in every if b not in done]

    def finish(self, batch: int, **figures: float) -> None:
        """Note that a batch is done."""
        row = self.spark.createDataFrame([(batch, {k: float(v) for k, v in figures.items()})], "batch bigint, figures map<string, double>")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def run(self, work: Callable[[int, int, int], dict[str, float]]) -> Iterator[int]:
        """Do the pending batches in order."""
        for batch, start, end in self.pending():
            self.finish(batch, **work(batch, start, end))
            yield batch


def storage_estimate(samples: int, sequence: int = 448, vocabulary: int = 51864, value_bytes: int = 4) -> dict[str, float]:
    """Bytes of the logits of samples."""
    per_sample = sequence * vocabulary * value_bytes
    return {"bytes_per_sample": per_sample, "total_bytes": samples * per_sample, "total_mb": samples * per_sample / 1024**2, "total_gb": samples * per_sample / 1024**3}
