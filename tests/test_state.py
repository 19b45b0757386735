"""Streams with state against their batch forms, across restarts."""

import datetime
import random

import pytest

from tracewell.streaming import state

SCHEMA = "run string, seq long, ts timestamp, kind string, data string"
START = datetime.datetime(2024, 1, 1)


def log(n, seed):
    rng, out = random.Random(seed), []
    for seq in range(n):
        out.append((rng.choice("abc"), seq, START + datetime.timedelta(minutes=seq), rng.choice(["token", "token", "note", None]), rng.choice([None, "", "x", "yy", "zzz"])))
    return out


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_a_stream_gives_what_the_batch_gives_after_restarts(spark, tmp_path, most):
    base, rows, rng = f"file://{tmp_path}", log(300, most), random.Random(1)
    far = [("end", 10**6, START + datetime.timedelta(days=400), "token", "x")]
    # entries come out of order by up to eight minutes, in three runs of the query
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))
    for part in (shuffled[:90], shuffled[90:200], shuffled[200:], far):
        feed(spark, f"{base}/log", part)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
        found = state.stretches(stream, "run", "ts", ["seq"], "kind", "data", late="15 minutes", quiet="10 days", most=most)
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{base}/out").where("run <> 'end'").collect()), key=repr)
    want = sorted(map(tuple, state.joined(spark.createDataFrame(rows, SCHEMA), "run", ["seq"], "kind", "data", most).collect()), key=repr)
    assert got == want and len(want) > 10
    if most < 100:
        assert sum(r[1] == "notice" for r in want) == 3


def test_a_quiet_run_is_put_out_and_counts_anew(spark):
    minute = lambda k: START + datetime.timedelta(minutes=k)
    rows = [("a", 1, minute(0), "t", "x"), ("a", 2, minute(1), "t", "y"), ("a", 3, minute(200), "t", "z"), ("b", 4, minute(2), "t", "w")]
    got = state.replayed(spark, spark.createDataFrame(rows, SCHEMA), "run", "ts", ["seq"], "kind", "data", parts=2, late="1 minute", quiet="1 hour")
    assert sorted(map(tuple, got.collect())) == [("a", "t", 1, 1, "z"), ("a", "t", 1, 2, "xy"), ("b", "t", 1, 1, "w")]


def test_batch_against_loops(spark):
    rows = log(120, 7)
    want = []
    for run in "abc":
        n = seen = 0
        now = None
        for r in [r for r in rows if r[0] == run]:
            text, n = r[4] or "", n + 1
            before, seen = seen, seen + len(text)
            if before > 25:
                continue
            kind, text = ("notice", state.NOTICE) if seen > 25 else (r[3], text)
            if now and now[1] == kind and kind != "notice":
                now[3], now[4] = n, now[4] + text
            else:
                now = [run, kind, n, n, text]
                want.append(now)
    got = state.joined(spark.createDataFrame(rows, SCHEMA), "run", ["seq"], "kind", "data", 25).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert state.joined(spark.createDataFrame([], SCHEMA), "run", ["seq"], "kind", "data").collect() == []
    assert state.replayed(spark, spark.createDataFrame([], SCHEMA), "run", "ts", ["seq"], "kind", "data").collect() == []
