"""Merkle manifest of a dataset, by superblock reduction.

Rows are leaves. Leaves of a group stand in order; every `fanout` consecutive nodes become one, level by level, while a group
has several; what remains is its subroot, and the subroots, in the order of their groups, likewise give the root. Nodes are
dealt to buckets of fanout ** LEVELS consecutive places, a bucket is collapsed by that many levels at once, and its root is a
node of the next round; so a round is one shuffle of what the round before left. Then the way goes back: a bucket is told the
siblings above its root, and its nodes' proofs are their siblings within the bucket followed by those.

Hashes are sha256 over digests in lowercase hexadecimal; nodes travel as 32 bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, and levels that a bucket collapses: 4096 leaves of some 100 bytes each.
FANOUT, LEVELS = 8, 4
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Text is hashed in parts of so many bytes of it.
HASH_BYTES = 4 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sha(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def collapse(nodes: list[bytes], levels: int | None, fanout: int = FANOUT) -> list[list[bytes]]:
    """All levels over nodes (hexadecimal), the nodes first: exactly `levels` of them, or while there are several."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([sha(b"".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return out


def proof(levels: list[list[bytes]], at: int, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """Siblings of the node at a place of levels[0], level by level to the last, and for each level the place in its run
    and the run's length, a byte each."""
    siblings, shape = [], bytearray()
    for nodes in levels[:-1]:
        low = at - at % fanout
        run = nodes[low : low + fanout]
        siblings += run[: at - low] + run[at - low + 1 :]
        shape += bytes((at - low, len(run)))
        at //= fanout
    return b"".join(siblings), bytes(shape)


def fold(leaf: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf (hexadecimal) and its proof give."""
    now, at = leaf, 0
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        rest = siblings[at : at + 64 * (size - 1)]
        now = sha(rest[: 64 * place] + now + rest[64 * place :])
        at += 64 * (size - 1)
    return now


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text", key: str = "doc_id", group: str = "lang") -> DataFrame:
    """key, group, leaf, claim and spread of every row. leaf: the hash of its fields, each `-` if null, else the UTF-8 byte
    count, `:` and the value. claim: where 3 divides the CRC-32 of the key in decimal, the leaf of the row with A-Z of its
    text in lower case, else null; a null key has no claim. spread: any number, which parts equal rows."""
    # integers in decimal; floats, dates and the like as Spark writes them
    plain = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), *[F.col(c).cast("string").alias(f"field {i}") for i, c in enumerate(fields)])
    kind = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    lower = fields.index(text)

    def digest(values: list[bytes | None]) -> bytes:
        h = hashlib.sha256()
        for v in values:
            h.update(b"-" if v is None else b"%d:" % len(v))
            if v is not None:
                h.update(v)
        return h.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, f"field {lower}", HASH_BYTES):
            columns = [batch.column(f"field {i}").cast(pa.large_binary()).to_pylist() for i in range(len(fields))]
            made, claims = [], []
            for k, values in zip(batch.column("key").to_pylist(), zip(*columns, strict=True), strict=True):
                made.append(digest(values))
                if k is None or zlib.crc32(str(k).encode()) % 3:
                    claims.append(None)
                elif values[lower] is None:
                    claims.append(made[-1])
                else:
                    claims.append(digest([*values[:lower], values[lower].translate(_LOWER), *values[lower + 1 :]]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("group"), pa.array(made, pa.binary()), pa.array(claims, pa.binary())], ["key", "group", "leaf", "claim"])

    found = plain.mapInArrow(run, f"key {kind['key']}, group {kind['group']}, leaf binary, claim binary")
    return found.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with index, their place from 0 in the order of the columns. Ranges are sorted apart and counted; a range's place
    is the sum of those before it, of which there is one row a range."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # the id of a row holds its partition and its place in it
    ranged = common.materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("index", F.col("_start") + place).drop("_at", "_part", "_start")


@dataclass
class Manifest:
    """blocks: a row for each bucket of leaves, with their keys, leaves and claims, the subroot, and the siblings above the
    bucket's root with their shape. root: the root in hexadecimal, empty if there are no rows."""

    blocks: DataFrame
    root: str
    key_type: str
    fanout: int

    def each(self, make: Callable[[bytes, bytes, bytes, bytes, bytes], tuple], schema: str) -> DataFrame:
        """key, and what make gives for each leaf: its columns are named by schema. make takes leaf, claim (the leaf if there
        is none), subroot, siblings and shape, digests in hexadecimal."""
        fanout, names = self.fanout, [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select(["leaves", "claims", "claimed", "levels", "subroot", "siblings", "shape"]).to_pylist()):
                    nodes = unpack(row["leaves"])
                    levels = collapse(nodes, row["levels"] if row["levels"] >= 0 else None, fanout)
                    claims = dict(zip(np.frombuffer(row["claimed"], "<i4").tolist(), unpack(row["claims"]), strict=True))
                    out = []
                    for at, leaf in enumerate(nodes):
                        siblings, shape = proof(levels, at, fanout)
                        out.append(make(leaf, claims.get(at, leaf), row["subroot"], siblings + row["siblings"], shape + row["shape"]))
                    yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, *map(pa.array, zip(*out, strict=True))], ["key", *names])

        return self.blocks.mapInArrow(run, f"key {self.key_type}, {schema}")

    def proofs(self) -> DataFrame:
        """key, leaf, subroot, siblings (64 bytes each) and shape (see proof) of every row: what fold() takes."""
        return self.each(lambda leaf, claim, subroot, siblings, shape: (leaf.decode(), subroot.decode(), siblings, shape), "leaf string, subroot string, siblings binary, shape binary")


def pack(nodes: list[bytes]) -> bytes:
    return bytes.fromhex(b"".join(nodes).decode())


def unpack(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """group, bucket, total, leaves, levels and root of each bucket of nodes (group, index, total, leaf): its nodes in order,
    the levels that it was collapsed by (-1: while it had several nodes, the group's only bucket) and its root. Buckets with
    keys also have those, and the claims with their places."""
    size, keyed = fanout**levels, "key" in nodes.columns
    extra = f", keys array<{nodes.schema['key'].dataType.simpleString()}>, claims binary, claimed binary" if keyed else ""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("index")
        whole = None if bucket["total"].iat[0] <= size else levels
        made = unpack(b"".join(bucket["leaf"]))
        out = {"group": bucket["group"].iat[0], "bucket": bucket["bucket"].iat[0], "total": bucket["total"].iat[0], "leaves": b"".join(bucket["leaf"]), "levels": -1 if whole is None else whole, "root": pack(collapse(made, whole, fanout)[-1])}
        if keyed:
            claimed = np.flatnonzero(bucket["claim"].notna())
            out |= {"keys": bucket["key"].tolist(), "claims": b"".join(bucket["claim"].dropna()), "claimed": claimed.astype("<i4").tobytes()}
        return pd.DataFrame([out])

    dealt = nodes.withColumn("bucket", F.floor(F.col("index") / F.lit(size)).cast("long"))
    return dealt.groupBy("group", "bucket").applyInPandas(run, f"group long, bucket long, total long, leaves binary, levels int, root binary{extra}")


def tree(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The rounds over nodes (see reduced), each a materialised table of buckets; the last has one bucket a group."""
    rounds = [common.materialize(reduced(nodes, fanout, levels), "merkle-blocks")]
    while not rounds[-1].where(F.col("levels") >= 0).isEmpty():
        # groups that have come to their root stay there
        above = rounds[-1].where(F.col("levels") >= 0).select("group", F.col("bucket").alias("index"), F.ceil(F.col("total") / F.lit(fanout**levels)).cast("long").alias("total"), F.col("root").alias("leaf"))
        rounds.append(common.materialize(reduced(above, fanout, levels), "merkle-blocks"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """group and root."""
    out = [r.where(F.col("levels") < 0).select("group", "root") for r in rounds]
    done = out[0]
    for r in out[1:]:
        done = done.unionByName(r)
    return done


def paths(blocks: DataFrame, fanout: int, levels: int, own: bool = False) -> DataFrame:
    """group, bucket (the place of a node), subroot, siblings and shape of every node of blocks, down to the root of all. own: a
    node is the subroot itself, else it has its block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = unpack(row["leaves"])
                made = collapse(nodes, row["levels"] if row["levels"] >= 0 else None, fanout)
                out = [proof(made, at, fanout) for at in range(len(nodes))]
                base = row["bucket"] * fanout**levels
                columns = [[row["group"]] * len(nodes), range(base, base + len(nodes)), [pack([x]) if own else row["subroot"] for x in nodes], [s + row["siblings"] for s, _ in out], [p + row["shape"] for _, p in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["group", "bucket", "subroot", "siblings", "shape"])

    found = blocks.select("group", "bucket", "leaves", "levels", "subroot", "siblings", "shape").mapInArrow(run, "group long, bucket long, subroot binary, siblings binary, shape binary")
    return common.materialize(found, "merkle-paths")


def downward(rounds: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first round's buckets with siblings and shape of what is above their roots, given what is above the roots of
    groups (upper: group, subroot, siblings, shape)."""
    known = None
    for buckets in reversed(rounds):
        told = buckets.where(F.col("levels") < 0).join(upper, "group")
        if known is not None:
            told = told.unionByName(buckets.where(F.col("levels") >= 0).join(known, ["group", "bucket"]))
        if buckets is not rounds[0]:
            known = paths(told, fanout, levels)
    return told


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text", key: str = "doc_id", group: str = "lang", fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The tree over all rows: leaves (see leaves) of a group ascend by key, nulls first; rows of one key by their leaf, so
    that the tree doesn't depend on how rows were stored. Rows with a null group are a group, the first. Repeated rows are
    leaves of their own. Without rows there are no blocks and the root is empty. Other columns of rows take no part."""
    made = common.materialize(leaves(rows, fields, text, key, group), "merkle-leaves")
    kind = made.schema["key"].dataType.simpleString()
    placed = numbered(made, "group", "key", "leaf", "spread")
    common.drop(made)
    groups = placed.groupBy(F.col("group").alias("named")).agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("total"))
    groups = numbered(groups, "named")
    nodes = placed.join(groups.select("named", "first", "total", F.col("index").alias("number")), F.col("group").eqNullSafe(F.col("named")))
    # keys as text: pandas has no whole numbers with nulls among them
    nodes = nodes.select(F.col("number").alias("group"), (F.col("index") - F.col("first")).alias("index"), "total", F.col("key").cast("string").alias("key"), "leaf", "claim")
    lower = tree(nodes, fanout, levels)
    subroots = roots(lower)
    n_groups = groups.count()
    over = subroots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("index"), F.lit(n_groups).cast("long").alias("total"), F.col("root").alias("leaf"))
    upper = tree(over, fanout, levels)
    root = roots(upper).first()
    none = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("group"), F.lit(b"").alias("subroot"), F.lit(b"").alias("siblings"), F.lit(b"").alias("shape"))
    of_groups = paths(downward(upper, none, fanout, levels), fanout, levels, own=True).drop("group").withColumnRenamed("bucket", "group")
    blocks = downward(lower, of_groups, fanout, levels).withColumn("keys", F.transform("keys", lambda k: k.cast(kind))).withColumn("subroot", F.encode(F.lower(F.hex("subroot")), "UTF-8"))
    return Manifest(blocks, bytes(root["root"]).hex() if root else "", kind, fanout)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and the proof's digest of every document, and what folding a perhaps tampered leaf by it gives."""
    made = manifest(common.table(spark, sf_dir, "documents"))
    root = made.root.encode()

    def digests(leaf: bytes, claim: bytes, subroot: bytes, siblings: bytes, shape: bytes) -> tuple:
        folded = fold(claim, siblings, shape)
        return leaf.decode(), subroot.decode(), root.decode(), sha(siblings).decode(), folded.decode(), folded == root

    out = made.each(digests, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("key", "doc_id")


#: CRC-32 by its bits, and a level of nodes at a time, while a group has several.
OP13_SQL = """
WITH RECURSIVE crcs AS (SELECT DISTINCT doc_id, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM documents),
rows AS (SELECT d.*, row_number() OVER () AS rid, coalesce(xor(c, 4294967295) % 3 = 0, false) AS hit FROM documents d LEFT JOIN crcs USING (doc_id)),
parts AS (SELECT rid, doc_id, lang, hit, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
  coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lower FROM rows),
leaves AS (SELECT rid, doc_id, lang, sha256(head || own) AS leaf, CASE WHEN hit THEN sha256(head || lower) ELSE sha256(head || own) END AS claim FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
low AS (SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL SELECT g, any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(n) / 8) AS BIGINT) FROM low WHERE n > 1 GROUP BY g, i // 8),
subs AS (SELECT g, h FROM low WHERE n = 1),
high AS (SELECT 0 AS level, g AS i, h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(n) / 8) AS BIGINT) FROM high WHERE n > 1 GROUP BY i // 8),
nodes AS (SELECT g, level, i, h, n FROM low UNION ALL SELECT -1, level, i, h, n FROM high),
tops AS (SELECT g, max(level) AS top FROM nodes GROUP BY g),
runs AS (SELECT g, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY g, level, i // 8),
walk AS (SELECT rid, g, CAST(0 AS BIGINT) AS level, i, claim AS h, '' AS sib, g AS g0 FROM placed
  UNION ALL SELECT w.rid, CASE WHEN r.hs IS NULL THEN -1 ELSE w.g END, CASE WHEN r.hs IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN r.hs IS NULL THEN w.g0 ELSE w.i // 8 END,
    CASE WHEN r.hs IS NULL THEN w.h ELSE sha256(array_to_string(r.hs[:w.i % 8] || [w.h] || r.hs[w.i % 8 + 2:], '')) END,
    CASE WHEN r.hs IS NULL THEN w.sib ELSE w.sib || array_to_string(r.hs[:w.i % 8] || r.hs[w.i % 8 + 2:], '') END, w.g0
  FROM walk w JOIN tops t ON t.g = w.g LEFT JOIN runs r ON r.g = w.g AND r.level = w.level AND r.run = w.i // 8 WHERE w.g >= 0 OR w.level < t.top),
ends AS (SELECT rid, h, sib FROM walk w JOIN tops t ON t.g = w.g WHERE w.g = -1 AND w.level = t.top),
root AS (SELECT h FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, sha256(e.sib) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN subs s ON s.g = p.g JOIN ends e ON e.rid = p.rid CROSS JOIN root
"""
