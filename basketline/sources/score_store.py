"""Per-customer scores as parquet partitioned by week and config, with resume."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.session import path_exists


class ScoreStore:
    """week, config -> rows (setting, model, customer_id, segment, ap, hit, ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, week: dt.date, config: str) -> str:
        return f"{self.path}/week={week}/config={config}"

    def has(self, week: dt.date, config: str) -> bool:
        """A part counts as stored only once its job has committed."""
        return path_exists(self.spark, f"{self._folder(week, config)}/_SUCCESS")

    def missing(self, weeks: Iterable[dt.date], configs: Iterable[str]) -> list[tuple[dt.date, str]]:
        configs = list(configs)
        return [(w, c) for w in weeks for c in configs if not self.has(w, c)]

    def fill(self, weeks: Iterable[dt.date], configs: Iterable[str],
             score: Callable[[dt.date, str], DataFrame], at_once: int = 1) -> int:
        """Score what is not stored yet, `at_once` parts at the same time; an interrupted run resumes here.

        Each part has a scheduler pool of its own, so that with the fair scheduler none waits for another.
        """
        todo = self.missing(weeks, configs)

        def part(week: dt.date, config: str) -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{week}-{config}" if at_once > 1 else None)
            score(week, config).drop("week", "config").write.mode("overwrite").parquet(self._folder(week, config))

        if at_once <= 1:
            for key in todo:
                part(*key)
        else:
            with ThreadPoolExecutor(at_once) as pool:
                for done in [pool.submit(inheritable_thread_target(self.spark)(part), *key) for key in todo]:
                    done.result()
        return len(todo)

    def read(self, weeks: Iterable[dt.date] | None = None) -> DataFrame:
        scores = self.spark.read.option("basePath", self.path).parquet(self.path)
        scores = scores.withColumn("week", F.col("week").cast("date"))
        if weeks is None:
            return scores
        weeks = list(weeks)
        lost = [w for w in weeks if not path_exists(self.spark, f"{self.path}/week={w}")]
        if lost:
            raise LookupError(f"no scores are stored for {', '.join(map(str, lost))}")
        return scores.filter(F.col("week").isin(weeks))
