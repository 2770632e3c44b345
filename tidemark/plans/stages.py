"""Stored stages of a run: computed once, on demand, independent ones side by side."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder
from tidemark.sources import tables


class StagedRun:
    """Base of a run: a session and a folder, shared by all executors, that its stages are stored in."""

    def __init__(self, spark: SparkSession, name: str, store: str | None = None):
        self.spark = spark
        self.store = store or shared_folder(spark, name)
        self._done: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _lock(self, name: str) -> threading.Lock:
        with self._guard:
            return self._locks.setdefault(name, threading.Lock())

    def _store(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.store}/{name}"
        tables.write_table(frame, path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def ready(self, *names: str) -> None:
        """Compute several stages at once. Small stages leave most of a cluster idle when run in turn."""
        missing = [n for n in names if n not in self._done]
        if len(missing) > 1:
            with ThreadPoolExecutor(len(missing)) as pool:
                for future in [pool.submit(getattr, self, n) for n in missing]:
                    future.result()
        elif missing:
            getattr(self, missing[0])


class stage:  # noqa: N801  (used as a decorator)
    """A frame of a :class:`StagedRun`, planned on first use and written to the store.

    ``needs`` names the stages it reads; those not yet there are computed concurrently. Stages form an
    acyclic graph, so the per-stage locks cannot wait on each other in a circle.
    """

    def __init__(self, *needs: str):
        self.needs = needs

    def __call__(self, fn: Callable[[StagedRun], DataFrame]) -> stage:
        self.fn, self.__doc__ = fn, fn.__doc__
        return self

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, run: StagedRun | None, owner: type | None = None):
        if run is None:
            return self
        if self.name in run._done:
            return run._done[self.name]
        with run._lock(self.name):
            if self.name not in run._done:
                run.ready(*self.needs)
                run._done[self.name] = run._store(self.name, self.fn(run))
            return run._done[self.name]
