"""Consensus of several runs: modes with ties, stability of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modes(votes: DataFrame, key: str, label: str, requested: int | None = None) -> DataFrame:
    """key, votes, runs and modal of each key: its one most frequent label, null where two tie for it.

    Two aggregations, both partial before they shuffle; no window over a key's votes."""
    counts = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(key).agg(F.max("c").alias("votes"), F.max_by(F.col(label), F.struct("c", label)).alias("_first"), F.min_by(F.col(label), F.struct(-F.col("c"), label)).alias("_other"), F.sum("c").alias("runs"))
    total = F.lit(requested) if requested else F.col("runs")
    return top.select(F.col(key), "votes", total.cast("long").alias("runs"), F.when(F.col("_first") == F.col("_other"), F.col("_first")).alias("modal"))


def stability(cites: DataFrame, key: str, run: str, cite: str) -> DataFrame:
    """key, shared, cited and stable: citations in every run of the key against all."""
    per = cites.groupBy(key, cite).agg(F.count_distinct(run).alias("in_runs"))
    runs = cites.groupBy(key).agg(F.count_distinct(run).alias("runs"))
    joined = per.join(runs, key)
    return joined.groupBy(key).agg(F.count_if(F.col("in_runs") == F.col("runs")).alias("shared"), F.count(F.lit(1)).alias("cited")).withColumn("stable", F.col("shared") == F.col("cited"))


def compare(runs: DataFrame, requested: int) -> DataFrame:
    """allegation, modal, votes, of, unanimous and evidence_unstable over runs (run, allegation, disposition, citations)."""
    found = modes(runs, "allegation", "disposition", requested)
    even = stability(runs.select("allegation", "run", F.explode("citations").alias("cite")), "allegation", "run", "cite")
    out = found.join(even, "allegation", "left")
    same = F.col("modal").isNotNull() & (F.col("votes") == requested)
    return out.select("allegation", "modal", "votes", F.col("runs").alias("of"), same.alias("unanimous"), (same & ~F.coalesce("stable", F.lit(False))).alias("evidence_unstable"))


def read_run(reports: DataFrame, text: str = "body") -> DataFrame:
    """report_id, allegation and disposition: as written under an allegation's heading, else as its table row says;
    mismatch where the two differ."""
    lines = reports.select("report_id", F.posexplode(F.split(text, r"\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"[*_#>`]+", " ")))
    cells = F.split("line", r"\|")
    table = lines.where(F.col("line").rlike(r"^\s*\|\s*\d+\s*\|")).select("report_id", F.trim(F.get(cells, F.lit(1))).cast("int").alias("allegation"), "at", F.trim(F.get(cells, F.lit(3))).alias("tabled"))
    table = table.groupBy("report_id", "allegation").agg(F.min_by("tabled", "at").alias("tabled"))
    from pyspark.sql import Window

    number = F.regexp_extract("line", r"(?i)^\s*allegation\s+(\d+)", 1).try_cast("int")
    under = F.last(number, ignorenulls=True).over(Window.partitionBy("report_id").orderBy("at"))
    written = lines.withColumn("allegation", under).withColumn("written", F.regexp_extract("line", r"(?i)^\s*disposition\s*:\s*(.+?)\s*$", 1)).where("written <> '' and allegation is not null")
    written = written.groupBy("report_id", "allegation").agg(F.min_by("written", "at").alias("written"))
    both = written.join(table, ["report_id", "allegation"], "full")
    flat = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z]+", ""))
    return both.select("report_id", "allegation", F.coalesce("written", "tabled").alias("disposition"), F.coalesce(flat("written") != flat("tabled"), F.lit(False)).alias("mismatch"))


def collapse_tokens(events: DataFrame, key: str, order: list[str], kind: str, data: str) -> DataFrame:
    """Runs of one kind joined, by key: gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(key, kind).orderBy(*order)))
    run = rows.groupBy(key, kind, "_island").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(data).cast("string").alias("d")))), lambda x: x["d"]), "").alias("joined"))
    return run.select(key, kind, F.col("first").cast("long"), F.col("last").cast("long"), "joined")
