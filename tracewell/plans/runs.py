"""Runs side by side that can be called off: N seeded runs in fair pools, at most one set of them at a time.

A lock file in the store's folder is the mutex: who creates it runs. Each run's jobs carry the set's tag, so calling it off ends
them wherever they are; what runs have to say goes into the store as one version at the end, so a set that was called off or failed
leaves no table behind."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions


class Busy(RuntimeError):
    """Another set of runs holds the lock."""


class CalledOff(RuntimeError):
    """The set was called off, or one of its runs failed."""


class Runs:
    """n runs of a flow; flow(seed) gives a DataFrame, which gets the column run."""

    def __init__(self, store: Versions, name: str, n: int, flow: Callable[[int], DataFrame]) -> None:
        self.store, self.name, self.n, self.flow = store, name, n, flow
        self.spark: SparkSession = store.spark
        self.tag = f"tracewell-{name}-{uuid.uuid4().hex}"
        self.failed: list[tuple[int, BaseException]] = []
        self.parts: dict[int, DataFrame] = {}
        self.off = threading.Event()
        self.lock = store._path("_locks", name)
        self._ends = threading.Lock()

    def call_off(self) -> None:
        """End all jobs of the set, now and later."""
        self.off.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _one(self, seed: int) -> None:
        from ..operators.iterate import materialize

        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setLocalProperty("spark.scheduler.pool", f"{self.name}-{seed}")
        try:
            if not self.off.is_set():
                self.parts[seed] = materialize(self.flow(seed).withColumn("run", F.lit(seed)), f"run-{self.name}")
        except BaseException as e:  # noqa: BLE001  whatever ends one run ends the set
            with self._ends:
                self.failed.append((seed, e))
            self.call_off()
        finally:
            context.removeJobTag(self.tag)

    def run(self) -> DataFrame:
        """All runs' rows, which are the table `name` of a new version. The first failure ends the others and is raised; seeds are
        0 to n - 1, and n is what a consensus divides by. Busy if another set holds the lock."""
        if not self.store._fs.createNewFile(self.lock):
            raise Busy(f"{self.name} is running")
        try:
            threads = [InheritableThread(target=self._one, args=(seed,)) for seed in range(self.n)]
            for t in threads:
                t.start()
            for t in threads:
                t.join()
            if self.failed or self.off.is_set() or len(self.parts) < self.n:
                first = self.failed[0] if self.failed else (None, None)
                raise CalledOff(f"{len(self.parts)} of {self.n} runs ended; run {first[0]} failed") from first[1]
            rows = None
            for seed in range(self.n):
                rows = self.parts[seed] if rows is None else rows.unionByName(self.parts[seed])
            self.store.commit(replace={self.name: rows})
            return self.store.read(self.name)
        finally:
            self.store._fs.delete(self.lock, False)
