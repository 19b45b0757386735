"""Run logs as streams with state: entries of a kind joined, and a run's text capped, across micro-batches and restarts.

An entry waits until the watermark has passed it, so entries that arrive out of order within the lateness are taken in order; then
it joins the stretch of its kind that is still open, which is put out when another kind follows or the run has been quiet. A run's
state is its open stretch (within the cap), the entries that still wait, and two counts; a timer of event time wakes it. Runs may
share a row of state, since what a call costs is mostly not the entries that it gets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .sessions import MAX_TEXT

#: What stands for the text beyond the cap.
NOTICE = "text cap reached"
#: Whether a stream that has no new entries runs a batch for what its watermark has made due.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE = "runs string"
#: Entries of a part that a replay gives to a call.
CALL_ROWS = 2048


def joined(entries: DataFrame, key: str, order: list[str], kind: str, data: str, most: int = MAX_TEXT) -> DataFrame:
    """key, kind, first, last and joined of the stretches of entries of one kind, by key in the given order (first and last count
    entries from 1). Texts of a key count together: that which passes `most` characters is a notice, a stretch by itself, and
    none comes behind it. The batch form of stretches()."""
    text = F.coalesce(F.col(data).cast("string"), F.lit(""))
    rows = entries.select(F.col(key), F.col(kind).alias("kind"), text.alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy(key).orderBy(*[f"_o{i}" for i in range(len(order))])
    rows = rows.withColumns({"_n": F.row_number().over(w), "_seen": F.sum(F.length("_t")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    over = F.col("_seen") > most
    rows = rows.where(F.col("_seen") - F.length("_t") <= most).withColumns({"_t": F.when(over, NOTICE).otherwise(F.col("_t")), "kind": F.when(over, "notice").otherwise(F.col("kind"))})
    new = F.coalesce((~F.lag("kind").over(w).eqNullSafe(F.col("kind")) | over).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", F.when(F.col("_n") == 1, 1).otherwise(new))
    rows = rows.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("_n", "_t")))
    run = rows.groupBy(key, "_k").agg(F.first("kind").alias("kind"), F.min("_n").cast("long").alias("first"), F.max("_n").cast("long").alias("last"), F.array_join(F.transform(parts, lambda x: x["_t"]), "").alias("joined"))
    return run.select(key, "kind", "first", "last", "joined")


class _Run:
    """What is known of a key between two calls."""

    def __init__(self, held: list | None = None) -> None:
        self.waiting, self.kind, self.first, self.last, self.text, self.seen, self.n, self.at = held or ([], None, 0, 0, "", 0, 0, 0)

    def held(self) -> list:
        return [self.waiting, self.kind, self.first, self.last, self.text, self.seen, self.n, self.at]

    def open(self) -> bool:
        return self.first > 0

    def close(self) -> list[tuple]:
        out = [(self.kind, self.first, self.last, self.text)] if self.open() else []
        self.kind, self.first, self.last, self.text = None, 0, 0, ""
        return out

    def take(self, kind: str | None, text: str, most: int) -> list[tuple]:
        """The stretches that end as the next entry comes."""
        self.n += 1
        before, self.seen = self.seen, self.seen + len(text)
        if before > most:
            return []
        over = self.seen > most
        out = []
        if over or not self.open() or kind != self.kind:
            out = self.close()
            self.kind, self.first, self.last, self.text = ("notice", self.n, self.n, NOTICE) if over else (kind, self.n, self.n, text)
        else:
            self.last, self.text = self.n, self.text + text
        return out


def stretches(entries: DataFrame, key: str, time: str, order: list[str], kind: str, data: str, late: str = "10 minutes", quiet: str = "1 hour", most: int = MAX_TEXT, groups: int | None = None) -> DataFrame:
    """A stream of key, kind, first, last and joined as joined() gives them, in the order of time, then of the given columns (whole
    numbers or texts). Entries later than `late` are left out; a key that is quiet for `quiet` is put out and forgotten, so that
    entries after that count anew. With groups, so many rows of state hold all keys; else each key has its own."""
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    key_type = entries.schema[key].dataType.simpleString()
    fields = ["key", "micros", *[f"o{i}" for i in range(len(order))], "kind", "data"]
    values = [F.col(key).cast("string"), F.unix_micros(F.col(time).cast("timestamp")), *[F.col(c) for c in order], F.col(kind).cast("string"), F.coalesce(F.col(data).cast("string"), F.lit(""))]
    group = F.col(key).cast("string") if groups is None else F.pmod(F.xxhash64(key), F.lit(groups))
    # workers take columns one by one for each call, so an entry is one
    entry = F.to_json(F.struct(*[v.alias(c) for v, c in zip(values, fields, strict=True)]))
    rows = entries.select(group.alias("group"), F.col(time).cast("timestamp").alias("time"), entry.alias("entry"))

    def take(run: _Run, now: int) -> list[tuple]:
        """The stretches that end as the watermark comes to now."""
        run.waiting.sort(key=lambda x: x[: 1 + len(order)])
        ready = 0
        while ready < len(run.waiting) and run.waiting[ready][0] < now * 1000:
            ready += 1
        out: list[tuple] = []
        for micros, *_, kind_of, text in run.waiting[:ready]:
            if run.n and micros // 1000 - run.at > wait:  # it was quiet in between: what comes counts anew
                out += run.close()
                run.n, run.seen = 0, 0
            out += run.take(kind_of, text, most)
            run.at = micros // 1000
        run.waiting = run.waiting[ready:]
        return out

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        runs = {k: _Run(held) for k, held in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for frame in frames:
                for x in map(json.loads, frame["entry"].tolist()):
                    runs.setdefault(x.get("key"), _Run()).waiting.append([x.get(c) for c in fields[1:]])
        out: list[tuple] = []
        for k, run in list(runs.items()):
            out += [(k, *x) for x in take(run, now)]
            if not run.waiting and run.at + wait < now:
                out += [(k, *x) for x in run.close()]
                del runs[k]
        if runs:
            state.update((json.dumps([(k, run.held()) for k, run in runs.items()]),))
            wake = min(run.waiting[0][0] // 1000 + 1 if run.waiting else run.at + wait + 1 for run in runs.values())
            state.setTimeoutTimestamp(max(wake, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "first", "last", "joined"])

    grouped = rows.withWatermark("time", late).groupBy("group")
    out = grouped.applyInPandasWithState(step, "key string, kind string, first long, last long, joined string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)


def replayed(spark: SparkSession, entries: DataFrame, key: str, time: str, order: list[str], kind: str, data: str, parts: int = 4, **how) -> DataFrame:
    """stretches() of a finished log, as a stream in parts by time, each a micro-batch: what a follower would have seen that starts
    again for each. The last part holds an entry long after, of no key, which ends all keys. A part is written and read by as many tasks as its
    rows ask for, its keys share rows of state, and what it makes due is taken up with the next part."""
    from ..operators.iterate import shared_dir

    base = f"{shared_dir(spark)}/tracewell/replay-{uuid.uuid4().hex}"
    columns = [F.col(key), F.col(time).cast("timestamp").alias(time), *[F.col(c) for c in dict.fromkeys([*order, kind, data]) if c not in (key, time)]]
    rows = entries.select(*columns)
    bounds = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if bounds.lo is None:
        return spark.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string, first long, last long, joined string")
    def follow(part: DataFrame, idle: bool) -> None:
        """Add a part to the log and take it as one batch; idle: and what it makes due."""
        part.write.mode("append").parquet(f"{base}/log")
        found = stretches(spark.readStream.schema(rows.schema).parquet(f"{base}/log"), key, time, order, kind, data, groups=-(-bounds.n // (parts * CALL_ROWS)), **how)
        before = spark.conf.get(IDLE)
        spark.conf.set(IDLE, str(idle).lower())
        try:
            found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(IDLE, before)

    step = (bounds.hi - bounds.lo) / parts
    for i in range(parts):
        low, high = bounds.lo + i * step, bounds.lo + (i + 1) * step
        follow(rows.where((F.col(time) >= F.lit(low)) & ((F.col(time) < F.lit(high)) if i < parts - 1 else F.lit(True))), False)
    after = bounds.hi + timedelta(days=2) + sum((pd.Timedelta(how.get(k, d)).to_pytimedelta() for k, d in (("late", "10 minutes"), ("quiet", "1 hour"))), timedelta())
    follow(spark.range(1).select(*[F.lit(after if f.name == time else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]), True)
    return spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string, first long, last long, joined string").parquet(f"{base}/out").where(F.col(key).isNotNull())
