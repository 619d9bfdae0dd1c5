"""Several crawls in one application (O2, O3): one after another, or side by side in fair scheduler pools."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Runner:
    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, []

    def add(self, name: str, crawl: Callable[[], object]) -> Runner:
        self.jobs.append((name, crawl))
        return self

    def run(self, concurrent: bool = True) -> dict[str, object]:
        """Results by name; all are run, then the errors are raised together."""
        results: dict[str, object] = {}
        errors: list[Exception] = []

        def one(name: str, crawl: Callable[[], object]) -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            try:
                results[name] = crawl()
            except Exception as e:  # noqa: BLE001
                errors.append(e)
            finally:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        if concurrent:
            with ThreadPoolExecutor(max(1, len(self.jobs))) as pool:
                list(pool.map(lambda job: one(*job), self.jobs))
        else:
            for job in self.jobs:
                one(*job)
        if errors:
            raise ExceptionGroup("crawls failed", errors)
        return results
