"""Overlap joins of spans (start, end; half open) by levels of bins.

A span's level is the least power of BASE that is as long as it, so at its level it touches two bins at most, and at higher levels
no more. Two spans meet at the higher of their levels, in the bin where their overlap starts: equality joins on (keys, level,
bin), with at most two rows a span and level, whatever the lengths are mixed of. No key's spans must meet in one task: a key has as
many bins as its spans need, and a bin that many spans touch is split by Spark, since both inputs are plain shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary digits of the ratio of one level's bins to the next's.
BITS = 3


def level_of(length: Column) -> Column:
    """The least level whose bins (2 ** (BITS * level) long) are as long as a span of this length."""
    digits = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))
    return F.ceil(digits / BITS).cast("int")


def _spans(df: DataFrame, keys: list[str], span: tuple[str, str], name: str) -> DataFrame:
    """df as one column, with its keys, bounds and level; spans that are empty or lack a bound or a key overlap nothing."""
    rows = df.select(F.struct(*df.columns).alias(name), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(span[0]).cast("long").alias(f"_s{name}"), F.col(span[1]).cast("long").alias(f"_e{name}"))
    rows = rows.where(F.col(f"_s{name}") < F.col(f"_e{name}"))
    return rows.withColumn("_level", level_of(F.col(f"_e{name}") - F.col(f"_s{name}")))


def _binned(rows: DataFrame, name: str) -> DataFrame:
    """A row for each bin of its _level that a span touches."""
    return rows.withColumn("_bin", F.explode(F.expr(f"sequence(shiftright(_s{name}, {BITS} * _level), shiftright(_e{name} - 1, {BITS} * _level))")))


def _probing(rows: DataFrame, name: str, levels: list[int], above: bool) -> DataFrame:
    """rows once for each of the levels that are as high as their own (above: higher)."""
    own = F.col("_level")
    wanted = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > own if above else x >= own)
    return _binned(rows.withColumn("_level", F.explode(wanted)), name)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """l, r, start and end: every pair of a row of left and a row of right (as structs) of equal keys whose spans overlap, and
    where. Bounds are whole numbers below 2 ** 62; rows that are equal are rows of their own."""
    one, two = _spans(left, keys, left_span, "l"), _spans(right, keys, right_span, "r")
    # the levels there are, some twenty at most
    found = [sorted(df.agg(F.collect_set("_level").alias("x")).first()["x"]) for df in (one, two)]
    meet = [*[f"_k{i}" for i in range(len(keys))], "_level", "_bin"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b, meet).where("_sl < _er and _sr < _el")
        start = F.greatest("_sl", "_sr")
        first = F.expr(f"_bin = shiftright(greatest(_sl, _sr), {BITS} * _level)")
        return both.where(first).select("l", "r", start.alias("start"), F.least("_el", "_er").alias("end"))

    if not found[0] or not found[1]:
        return met(_binned(one, "l"), _binned(two, "r"))
    return met(_probing(one, "l", found[1], above=False), _binned(two, "r")).unionByName(met(_binned(one, "l"), _probing(two, "r", found[0], above=True)))
