"""Which evidence belongs to which allegation: marker spans, carry-over and routing with its guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

#: Pages that a marker is carried over.
MAX_CARRY = 1
#: Targets that a row meets at a time.
BLOCK = 4096
#: Pairs of a cell, and cells of a task; up to FEW targets go to where the rows are.
PAIRS, CELLS, FEW = 1 << 23, 4, 64


def marker_number(line):
    """The number of an allegation heading, arabic or roman."""
    raw = F.lower(F.regexp_extract(line, rules.MARKER, 1))
    roman = F.create_map(*[F.lit(x) for kv in rules.ROMAN.items() for x in kv])
    return F.coalesce(raw.try_cast("int"), F.try_element_at(roman, raw))


def runs_on(line):
    """Whether a line of prose runs on into the next: it isn't blank, a rule or a table's row, and no stop ends it."""
    bare = F.regexp_replace(F.trim(line), r"[\s|*_~`]+$", "")
    return (bare != "") & ~F.trim(line).rlike(r"^\||\|$") & ~bare.rlike(r"^[\s|:=.*_~`–—+-]*$") & ~bare.rlike(r"[.!?:;–—]$")


def marker_spans(pages: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_num, ref, start and end (lines, half open) from each heading to the next or the page's end. A marker behind a
    line that runs on is part of a wrapped sentence and heads nothing."""
    lines = pages.select("doc_id", "page_num", F.size(F.split(text, r"\n")).alias("_n"), F.posexplode(F.split(text, r"\n")).alias("start", "line"))
    here = Window.partitionBy("doc_id", "page_num").orderBy("start")
    wrapped = F.coalesce(runs_on(F.lag("line").over(here)), F.lit(False))
    heads = lines.withColumn("_wrapped", wrapped).withColumn("ref", marker_number(F.col("line"))).where("ref is not null and not _wrapped")
    after = F.lead("start").over(here)
    return heads.select("doc_id", "page_num", "ref", "start", F.coalesce(after, "_n").alias("end"))


def stab(points: DataFrame, spans: DataFrame, keys: list[str], place: str) -> DataFrame:
    """points with ref of the span that holds them; equality on the keys first, then the range."""
    p, s = points.alias("p"), spans.alias("s")
    cond = (F.col(f"p.{place}") >= F.col("s.start")) & (F.col(f"p.{place}") < F.col("s.end"))
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return p.join(s, cond, "left").select("p.*", "s.ref")


def carry(pages: DataFrame, group: str, place: str, marker: str, cap: int = MAX_CARRY, reset: str | None = None) -> DataFrame:
    """pages with carried: the last marker, no more than cap places back and not across a reset."""
    rows = pages.withColumn("_seg", F.sum(F.col(reset).cast("int")).over(Window.partitionBy(group).orderBy(place)) if reset else F.lit(0))
    w = Window.partitionBy(group, "_seg").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last, at = F.last(marker, ignorenulls=True).over(w), F.last(F.when(F.col(marker).isNotNull(), F.col(place)), ignorenulls=True).over(w)
    return rows.withColumn("carried", F.when(F.col(place) - at <= cap, last)).drop("_seg")


def available(refs, unrestricted, target):
    """No reference at all, an unrestricted one, or the target among them."""
    return (F.size(refs) == 0) | unrestricted | F.array_contains(refs, target)


def with_each(rows: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """A row of rows for each target: the pairs are the result itself, so they are made last, and what moves is a small share of them.

    Lists of some BLOCK targets and parts of the rows meet in cells of some PAIRS pairs. Tasks are as many as the pairs need, since Spark, going by bytes,
    would leave them to a few; none holds all targets or all rows, and nothing but FEW targets is broadcast."""
    every = targets.select(target).distinct()
    n = every.count()
    if n <= FEW:
        return rows.crossJoin(F.broadcast(every.agg(F.collect_list(target).alias("_targets")))).withColumn(target, F.explode("_targets")).drop("_targets")
    blocks, parts = -(-n // BLOCK), max(1, -(-rows.count() // (PAIRS // min(n, BLOCK))))
    tasks = -(-blocks * parts // CELLS)
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lists = every.groupBy(F.pmod(F.xxhash64(target), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(target).alias("_targets"))
    lists = lists.withColumn("_part", upto(parts)).repartition(tasks, "_part", "_block")
    dealt = rows.repartition(parts).withColumn("_part", F.spark_partition_id()).withColumn("_block", upto(blocks)).repartition(tasks, "_part", "_block")
    return dealt.join(lists.hint("merge"), ["_part", "_block"]).withColumn(target, F.explode("_targets")).drop("_part", "_block", "_targets")


def route(rows: DataFrame, targets: DataFrame, refs: str = "refs", unrestricted: str = "unrestricted") -> DataFrame:
    """target, the rows available to it and guarded: a target that would lose all rows keeps all of them.

    Rows with references meet their targets by equality; only rows that are open to all targets are paired with each."""
    columns = [*rows.columns, "target"]
    open_to_all = (F.size(refs) == 0) | F.col(unrestricted)
    own = rows.where(~open_to_all).withColumn("target", F.explode(F.array_distinct(refs))).join(targets.select("target").distinct(), "target", "left_semi")
    free = rows.where(open_to_all)
    if not free.isEmpty():
        return own.select(columns).unionByName(with_each(free, targets).select(columns)).withColumn("guarded", F.lit(False))
    left = targets.select("target").distinct().join(own.select("target"), "target", "left_anti")
    return own.select(columns).withColumn("guarded", F.lit(False)).unionByName(with_each(rows, left).select(columns).withColumn("guarded", F.lit(True)))


def numbering(counts: DataFrame, n: int) -> DataFrame:
    """ref, seen and valid for counts (ref, seen) of references to n allegations: from 1 if all fit, else from 0 if 0 is
    seen twice and all fit; of the rest, one sighting is a stray, more turn routing off."""
    every = Window.partitionBy(F.lit(1))
    lo, hi = F.min("ref").over(every), F.max("ref").over(every)
    zero_twice = F.max(F.when((F.col("ref") == 0) & (F.col("seen") > 1), 1).otherwise(0)).over(every) == 1
    base = F.when((lo >= 1) & (hi <= n), 1).when(zero_twice & (hi == n - 1), 0).otherwise(1)
    rows = counts.withColumn("base", base)
    inside = F.col("ref").between(F.col("base"), F.col("base") + n - 1)
    return rows.withColumn("valid", inside).withColumn("off", F.max(F.when(~inside & (F.col("seen") > 1), 1).otherwise(0)).over(every) == 1)
