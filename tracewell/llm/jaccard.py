"""N-gram Jaccard join by universe partition.

Sets of distinct word shingles fall into bands of size. For the pairs of a band (and the next) the universe of shingles is
hashed into segments; two sets that link differ in at most H shingles, so by pigeonhole some segments agree. A band has
one of two allocations, whichever costs less by the counts of the corpus: whole segments, of which a set indexes a subset,
leaving out those with the fewest shingles, which would meet the most; or half as many wider segments, indexed with their
one-deletion neighbourhoods. What meets is verified exactly. Equal sets are one node throughout.

Links are wanted for their components, so what is one component already needs no more links. First the sets of a group are
compared with the one of them that meets the most sets. Then small groups give the pairs of different components that a bound
by sketches of their parity leaves. Large groups around one component are one family: its sets that aren't in the largest
component meet all its sets in blocks, with the texts at hand, and a block gives the edges of a forest, fewer than its sets."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import components
from . import common, words

U = np.uint64
#: Words of a shingle; sets link from NUM / DEN similarity on.
SHINGLE, NUM, DEN = 5, 75, 100
#: Bytes of text for a bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Bytes of a signature that are sent.
SENT = 6
#: Least and most bits of a parity sketch, as powers of two.
LEAST_BITS, MOST_BITS = 8, 16
#: Sets of a group that gives its pairs; those and the shingles of a block of a family (on average, either limit).
SMALL, BLOCK_SETS, BLOCK_SHINGLES = 32, 1024, 1 << 19
#: Sketches of a block.
WIDE = 8192
#: What a false candidate costs, in signatures.
FALSE_COST = 30.0


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows, and the rows' offsets. A-Z count as a-z."""
    data, offs = common.utf8(column)
    starts, ends, first = words.spans(data, offs)
    h, at = words.grams(words.hashes(data, starts, ends, lower=True), first, SHINGLE, short=True)
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.array([len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def node_of(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set, as signed 64-bit."""
    n = np.diff(offs)
    sums = np.concatenate([[U(0)], np.cumsum(words.mix(tokens ^ U(0xA5A5A5A55A5A5A5A)), dtype=U)])
    return words.mix(sums[offs[1:]] - sums[offs[:-1]] + n.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(tokens: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parity of each set's shingles in some classes, as many as it has shingles at least: two sets differ in at least as
    many shingles as their sketches in bits. Classes are powers of two, so a larger sketch folds to a smaller."""
    h = words.mix(tokens ^ U(0x1234567))
    out = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        bits = 1 << min(max(LEAST_BITS, int(b - a - 1).bit_length()), MOST_BITS)
        count = np.bincount((h[a:b] & U(bits - 1)).astype(np.int64), minlength=bits)
        out.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def gaps(x: list[bytes], y: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which sketches x[p] and y[q] differ, folded to the smaller."""
    sizes = [np.array([len(v) for v in side]) for side in (x, y)]
    least, out = np.minimum(sizes[0][p], sizes[1][q]), np.zeros(len(p), np.int64)
    for size in np.unique(least).tolist():
        at = np.flatnonzero(least == size)
        sides = []
        for side, n, index in ((x, sizes[0], p[at]), (y, sizes[1], q[at])):
            rows, back = np.unique(index, return_inverse=True)
            folded = [np.bitwise_xor.reduce(np.frombuffer(side[r], U).reshape(-1, size // 8), axis=0) for r in rows.tolist()]
            sides.append((np.stack(folded), back))
        for s in range(0, len(at), 4096):
            part = slice(s, s + 4096)
            out[at[part]] = np.bitwise_count(sides[0][0][sides[0][1][part]] ^ sides[1][0][sides[1][1][part]]).sum(1, dtype=np.int64)
    return out


def edges_of_bands(most: int) -> np.ndarray:
    """First sizes of the bands, beyond `most`: sets of one band link with their own and the next one only."""
    out = [1, 2]
    while out[-2] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * DEN // NUM + 1))
    return np.array(out, np.int64)


def differ(n, m):
    """Most shingles in which two linked sets of these sizes (numbers, arrays or columns) differ."""
    most = (n + m) * (DEN - NUM)
    return F.floor(most / (DEN + NUM)) if isinstance(most, Column) else most // (DEN + NUM)


def plan(largest: int, n_docs: int) -> tuple[int, bool]:
    """Segments of the scheme of a band whose largest set has `largest` shingles, and whether they are indexed with their
    one-deletion neighbourhoods, by what n_docs sets would cost."""
    h = differ(largest, largest * DEN // NUM)
    if h == 0:
        return 1, False
    m = h + 2 + h * 15 // 100
    bare = m * math.exp(-largest / m)
    kept = max(0.0, bare + math.sqrt(bare) - (m - h - 1))
    whole = h + 1 + FALSE_COST * kept * kept / m * n_docs
    wide = (h + 2) // 2
    rate = largest / wide
    tiny = math.exp(-rate) * (1 + rate)
    near = wide + largest + FALSE_COST * wide * tiny * tiny * n_docs
    return (wide, True) if near < whole else (m, False)


def signatures(tokens: np.ndarray, offs: np.ndarray, edges: np.ndarray, plans: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of all that is indexed. Every set is in the scheme of its own band and in that of the one below."""
    sizes = np.diff(offs)
    band = np.searchsorted(edges, sizes, side="right") - 1
    out_rows, out_sigs = [], []
    for below in (0, 1):
        scheme = band - below
        rows = np.flatnonzero((sizes > 0) & (scheme >= 0))
        if below:  # the least partner must be in the band below
            rows = rows[-(-sizes[rows] * NUM // DEN) < edges[band[rows]]]
        if not len(rows):
            continue
        m_of = np.array([plans[s][0] for s in scheme[rows]])
        near = np.array([plans[s][1] for s in scheme[rows]])
        # shingles of these rows, and their segments
        n = sizes[rows]
        at = np.repeat(offs[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = tokens[at]
        salt = words.mix(scheme[rows].astype(U) + U(77))
        row_at = np.repeat(np.arange(len(rows)), n)
        segment = (words.mix(value ^ salt[row_at]) >> U(33)).astype(np.int64) % m_of[row_at]
        first = np.concatenate([[0], np.cumsum(m_of)])
        cell = first[row_at] + segment
        code = words.mix(value + U(0x632BE59BD9B4E019))
        total = np.zeros(first[-1], U)
        np.add.at(total, cell, code)
        count = np.bincount(cell, minlength=first[-1])
        owner = np.repeat(np.arange(len(rows)), m_of)
        place = (np.arange(first[-1]) - first[owner]).astype(U)
        name = words.mix(salt[owner] + place * U(0xC2B2AE3D27D4EB4F))
        sig = words.mix(total ^ name)
        # the subset: the h + 1 segments of most shingles; ties by content, alike in all sets
        partner = np.where(below, edges[band[rows]] - 1, n * DEN // NUM)
        keep = np.where(near, m_of, np.minimum(m_of, differ(n, partner) + 1))
        order = np.lexsort((sig, -count, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[owner[order]]
        chosen = rank < keep[owner]
        out_rows.append(rows[owner[chosen]])
        out_sigs.append(sig[chosen])
        deleted = near[row_at]
        out_rows.append(rows[row_at[deleted]])
        out_sigs.append(words.mix((total[cell[deleted]] - code[deleted]) ^ name[cell[deleted]]))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(out_rows), np.concatenate(out_sigs)


def nodes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, h (hash of the text), n_shingles, node and sketch of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, text):
            tokens, offs = sets(batch.column(text))
            drawn = sketches(tokens, offs)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_h"), pa.array(np.diff(offs)), pa.array(node_of(tokens, offs)), common.binary(drawn)], ["key", "h", "n_shingles", "node", "sketch"])

    return docs.select(key, F.xxhash64(text).alias("_h"), text).mapInArrow(run, f"key {kind}, h long, n_shingles long, node long, sketch binary").withColumnRenamed("key", key)


def groups(docs: DataFrame, text: str, bands: list[int], size: int) -> DataFrame:
    """group and node: the sets that share a signature, groups of equal members once a bucket. bands: sets by band; size: bytes of
    all texts, in proportion to which buckets and tasks are made."""
    spark = docs.sparkSession
    n_buckets, n_tasks = max(common.shuffle_partitions(spark), -(-size // BUCKET_BYTES)), common.tasks(spark, size)
    edges = edges_of_bands(1 << 40)
    plans = []
    for k in range(len(edges) - 1):
        n_docs = sum(bands[k : k + 2]) if k < len(bands) else 0
        plans.append(plan(int(edges[k + 1]) - 1, n_docs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.chunks(batches, text):
            tokens, offs = sets(batch.column(text))
            node = node_of(tokens, offs)
            row, sig = signatures(tokens, offs, edges, plans)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):  # copies within a task are one
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keep = fresh[row]
            row, sig = row[keep], sig[keep]
            bucket = (sig >> U(20)) % U(n_buckets)
            order = np.lexsort((row, bucket))
            row, sig, bucket = row[order], sig[order], bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
            out: list[list] = [[], [], []]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                # mostly one signature of a set in a bucket; six bytes of each tell them apart, and what meets is verified
                short = np.ascontiguousarray(sig[s:e]).view(np.uint8).reshape(-1, 8)[:, :SENT]
                for o, v in zip(out, (int(bucket[s]), node[row[s:e]].tobytes(), short.tobytes()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[common.binary(o) for o in out[1:]]], ["bucket", "nodes", "sigs"])

    def meet(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t)
        node, short = join("nodes", "<i8"), join("sigs", "u1").reshape(-1, SENT)
        sig = np.zeros((len(node), 8), np.uint8)
        sig[:, :SENT] = short
        sig = sig.view(U).ravel()
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        same = sig[1:] == sig[:-1]
        hot = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(sig) else np.zeros(0, bool)
        sig, node = sig[hot], node[hot]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]) if len(sig) else np.zeros(0, bool)
        sig, node = sig[new], node[new]
        cuts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
        sizes = np.diff(cuts)
        sums = np.concatenate([[U(0)], np.cumsum(words.mix(node.view(U)), dtype=U)])
        name = words.mix(sums[cuts[1:]] - sums[cuts[:-1]] + sizes.astype(U))
        _, one = np.unique(name, return_index=True)
        one = one[sizes[one] > 1]
        n = sizes[one]
        at = np.repeat(cuts[:-1][one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.table([pa.array(np.repeat(name[one], n).view(np.int64)), pa.array(node[at])], names=["group", "node"])

    blobs = docs.select(text).mapInArrow(send, "bucket long, nodes binary, sigs binary")
    return blobs.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: meet(t.select(["nodes", "sigs"])), "group long, node long")


def texts_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node and packed (its text, compressed) of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in common.chunks(batches, text):
            column = batch.column(text)
            at, node = [], node_of(*sets(column))
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), common.binary([pack((column[i].as_py() or "").encode()) for i in at])], ["node", "packed"])

    rows = docs.select(text).mapInArrow(run, "node long, packed binary")
    return rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        unpack = zstandard.ZstdDecompressor().decompress

        def tokens(node: int, packed: bytes) -> np.ndarray:
            if node not in known:
                known[node] = sets(pa.array([unpack(packed)], pa.binary()))[0]
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            linked = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                p, q = tokens(a, x), tokens(b, y)
                n = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(DEN * n >= NUM * (len(p) + len(q) - n))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that may link by the sizes and sketches of their nodes, which own has."""
    one = lambda k, n, x: own.select(F.col("node").alias(k), F.col("n_shingles").alias(n), F.col("sketch").alias(x))
    both = pairs.join(one("a", "n", "x"), "a").join(one("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            fine = gaps(batch.column("x").to_pylist(), batch.column("y").to_pylist(), at, at) <= differ(batch.column("n").to_numpy(), batch.column("m").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return both.mapInArrow(run, "a long, b long")


def small_pairs(members: DataFrame) -> DataFrame:
    """a and b: pairs of members (group, node, component, n_shingles) of one group, of different components and of sizes that may
    link. A group has SMALL members at most."""
    held = members.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("node", "component", "n_shingles"))).alias("m"))

    def partners(x: Column, i: Column) -> Column:
        fine = lambda y: (y["component"] != x["component"]) & (F.abs(y["n_shingles"] - x["n_shingles"]) <= differ(y["n_shingles"], x["n_shingles"]))
        rest = F.filter(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), fine)
        return F.transform(rest, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    return held.select(F.inline(F.flatten(F.transform("m", partners)))).distinct()


def families(members: DataFrame) -> DataFrame:
    """family, node, component and n_shingles: the members of groups (group, node, component, n_shingles) once for all groups
    whose most frequent component is the same one; it names the family."""
    most = members.groupBy("group", "component").count().groupBy("group").agg(F.max(F.struct("count", "component"))["component"].alias("family"))
    return members.join(most, "group").select("family", "node", "component", "n_shingles").distinct()


def forest(family: list[tuple], others: list[tuple], main: int) -> list[tuple[int, int]]:
    """Linked pairs of the rows (node, component, packed text) of a block of a family and of a block of those that aren't in
    its main component, just so many that all components which links between the two join are one."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = family + others
    tokens, offs = sets(pa.array([unpack(r[2]) for r in rows], pa.binary()))
    n, node, component = np.diff(offs), np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    bits = 1 << min(max(LEAST_BITS, int(4 * np.median(n) - 1).bit_length()), MOST_BITS - 2)
    drawn = np.zeros((len(rows), bits), bool)
    owner = np.repeat(np.arange(len(rows)), n)
    cell, count = np.unique(owner * bits + (words.mix(tokens ^ U(0x1234567)) & U(bits - 1)).astype(np.int64), return_counts=True)
    drawn.ravel()[cell[count % 2 == 1]] = True
    drawn = np.packbits(drawn, axis=1).view(U)
    k, found = len(family), []
    step = max(1, (1 << 21) // (max(1, len(others)) * drawn.shape[1]))
    for s in range(0, k, step):
        x, y = slice(s, min(k, s + step)), slice(k, len(rows))
        fine = component[x, None] != component[None, y]
        fine &= (component[x, None] == main) | (node[x, None] < node[None, y])  # two of the others meet once
        p, q = np.nonzero(fine & (np.abs(n[x, None] - n[None, y]) <= differ(n[x, None], n[None, y])))
        p, q = p + s, q + k
        gap = np.concatenate([np.bitwise_count(drawn[p[i : i + 8192]] ^ drawn[q[i : i + 8192]]).sum(1, dtype=np.int64) for i in range(0, len(p), 8192)] or [np.zeros(0, np.int64)])
        near = gap <= differ(n[p], n[q])
        found.append(np.stack([gap[near], p[near], q[near]]))
    found = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    root = {c: c for c in set(component.tolist())}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out, of = [], component.tolist()
    for p, q in found[1:, np.argsort(found[0], kind="stable")].T.tolist():
        a, b = find(of[p]), find(of[q])
        if a != b:
            x, y = tokens[offs[p] : offs[p + 1]], tokens[offs[q] : offs[q + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if DEN * both >= NUM * (len(x) + len(y) - both):
                root[a] = b
                out.append((min(rows[p][0], rows[q][0]), max(rows[p][0], rows[q][0])))
    return out


def partners(family: list[tuple], others: list[tuple], main: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows (node, component, n_shingles, sketch) of a block of a family and of one of those outside its main
    component that may link, by component, size and sketch."""
    (x_node, x_component, x_n), (y_node, y_component, y_n) = (np.array([r[:3] for r in side], np.int64).T for side in (family, others))
    x, y = [r[3] for r in family], [r[3] for r in others]
    found, step = [], max(1, (1 << 20) // len(others))
    for s in range(0, len(family), step):
        part = slice(s, s + step)
        fine = x_component[part, None] != y_component[None, :]
        fine &= (x_component[part, None] == main) | (x_node[part, None] < y_node[None, :])  # two of the others meet once
        p, q = np.nonzero(fine & (np.abs(x_n[part, None] - y_n[None, :]) <= differ(x_n[part, None], y_n[None, :])))
        p += s
        near = gaps(x, y, p, q) <= differ(x_n[p], y_n[q])
        found.append(np.stack([p[near], q[near]]))
    return tuple(np.concatenate(found, axis=1))


def met_in(rows: DataFrame) -> DataFrame:
    """family, i, j, role, main, node and component: the blocks of texts to which each row (family, main, node, component,
    n_shingles, sketch, block, rest) must go, as a row of its family (role 0, block i) or as one outside the main component (role 1,
    rest j). Sketches alone meet here, in blocks of WIDE; a text goes where some other may link with it, and nowhere else."""
    sizes = rows.groupBy("family", "main").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("wide"), F.ceil(F.count_if(F.col("component") != F.col("main")) / WIDE).cast("int").alias("apart"))
    rows = rows.join(sizes, ["family", "main"])
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), F.col(n)).cast("int")
    own = rows.where("apart > 0").withColumns({"role": F.lit(0), "at": place("wide"), "to": F.explode(every("apart"))})
    rest = rows.where("component <> main").withColumns({"role": F.lit(1), "to": place("apart"), "at": F.explode(every("wide"))})
    names = ["family", "at", "to", "role", "main", "node", "component", "n_shingles", "sketch", "block", "rest"]
    dealt = own.select(names).union(rest.select(names)).repartition("family", "at", "to").sortWithinPartitions("family", "at", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, main, sides = None, 0, ([], [])

        def sent() -> pa.RecordBatch:
            out: set[tuple] = set()
            if all(sides):
                p, q = partners(*sides, main)
                block, rest = np.array([r[4] for r in sides[0]]), np.array([r[5] for r in sides[1]])
                for role, side, here, i, j in ((0, sides[0], p, block[p], rest[q]), (1, sides[1], q, block[p], rest[q])):
                    for at, a, b in np.unique(np.stack([here, i, j]), axis=1).T.tolist():
                        out.add((key[0], a, b, role, main, side[at][0], side[at][1]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["family", "i", "j", "role", "main", "node", "component"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if x[:3] != key:
                    yield sent()
                    key, main, sides = x[:3], x[4], ([], [])
                sides[x[3]].append(x[5:])
        yield sent()

    return dealt.mapInArrow(run, "family long, i int, j int, role int, main long, node long, component long").distinct()


def family_links(members: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """a and b: links that make one of all components that links within a family (family, node, component, n_shingles) join.
    Those of a family's largest component are compared with the rest only. Both sides are dealt in blocks of bounded size, so a
    block of the one and a block of the other meet in a task whatever a family's size: sketches (own) first, then the texts that
    may link."""
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    of = parts.groupBy("family").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "component", "s")).alias("top"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_SETS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    of = of.select("family", F.col("top.component").alias("main"), blocks(F.col("c"), F.col("s")).alias("blocks"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rests"))
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    rows = members.join(of, "family").join(own.select("node", "sketch"), "node").withColumns({"block": place("blocks"), "rest": place("rests")})
    names = ["family", "i", "j", "role", "main", "node", "component", "packed"]
    dealt = met_in(rows).join(texts, "node").select(names).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        key, main, sides = None, 0, ([], [])

        def links() -> pa.RecordBatch:
            found = forest(*sides, main) if all(sides) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if x[:3] != key:
                    yield links()
                    key, main, sides = x[:3], x[4], ([], [])
                sides[x[3]].append(x[5:])
        yield links()
        common.release()

    return dealt.mapInArrow(run, "a long, b long")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members of groups that hold more than one component, with their component."""
    rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("group").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("group")
    return rows.join(mixed, "group", "left_semi")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, h (hash of the text), n_shingles, component and component_id (least key of the rows that links reach) of each
    row of docs; component is null and component_id the key itself for rows without a set.

    A row's set is its distinct word shingles, or its whole word sequence if that is shorter than a shingle. Null, empty
    and wordless texts have no set, link with nothing and are their own component. Equal sets link, whatever the order and
    case of the text; repeated rows and keys are rows of their own."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    known = common.materialize(nodes(docs, text, key), "nodes")
    edges = edges_of_bands(1 << 40)
    bands = [0] * (len(edges) - 1)
    sizes = known.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"))
    # one count for each band, some hundred at most
    for band, n in sizes.groupBy(F.expr("+".join(f"cast(n >= {e} as int)" for e in edges)).alias("band")).count().collect():
        bands[band - 1] = n
    found = common.materialize(groups(docs, text, bands, common.text_bytes(docs, text)).distinct(), "groups")
    own = known.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    own = common.materialize(own.join(found.select("node").distinct(), "node", "left_semi"), "sketches")
    size = found.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    members = common.materialize(found.join(own.select("node", "n_shingles"), "node").join(size, "group"), "members")
    common.drop(found)
    texts = common.materialize(texts_of(docs, own.select("node"), text), "candidate-texts")
    # a star in each group, around the set that meets the most sets: of near copies, mostly what they are copies of
    popular = members.groupBy("node").agg(F.sum("size").alias("meets"))
    middle = members.join(popular, "node").groupBy("group").agg(F.max(F.struct("meets", F.xxhash64("node").alias("h"), "node", "n_shingles")).alias("o"))
    near = F.abs(F.col("n_shingles") - F.col("o.n_shingles")) <= differ(F.col("n_shingles"), F.col("o.n_shingles"))
    pairs = members.join(middle, "group").where((F.col("node") != F.col("o.node")) & near).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    tried = common.materialize(likely(pairs, own), "pairs")
    stars = common.materialize(verify(tried, texts), "links")
    labels = components(stars)
    mixed = common.materialize(labelled(members, labels), "mixed")
    common.drop(members, labels)
    pairs = small_pairs(mixed.where(F.col("size") <= SMALL)).join(tried, ["a", "b"], "left_anti")
    few = common.materialize(verify(common.materialize(likely(pairs, own), "pairs"), texts), "links")
    many = common.materialize(family_links(families(mixed.where(F.col("size") > SMALL)), own, texts), "links")
    common.drop(mixed, tried, own, texts)
    links = stars.union(few).union(many)
    labels = components(links)
    common.drop(stars, few, many)
    of_node = known.where("n_shingles > 0").select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    least = known.where("n_shingles > 0").groupBy("node").agg(F.min(key).alias("least"))
    placed = common.materialize(of_node.join(least, "node"), "placed")
    common.drop(labels)
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = placed.select("node", "component").join(first, "component").select("node", "component", "component_id")
    return known.join(answer, "node", "left").select(key, "h", "n_shingles", "component", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component, that of least key and hash (nulls last); rows without a set all stay. Keys may be of
    any type that has an order."""
    docs, back = common.apart(docs, text, key)
    columns = [f"`{c}`" for c in docs.columns]
    found = near_duplicates(docs, text, key).where("component is not null")
    best = found.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("h").alias("h"))).alias("m"))
    # keys of any type are told by a hash, beside whether they are null
    best = best.select(F.col("m.none").alias("_tw_none"), F.xxhash64("m.key").alias("_tw_key"), F.col("m.h").alias("_tw_h"))
    at = [F.col(key).isNull().alias("_tw_none"), F.xxhash64(key).alias("_tw_key"), F.xxhash64(text).alias("_tw_h")]
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # one shuffle serves both: rows that are equal in key and text, and the join
    kept = docs.where(worded).select(*columns, *at).dropDuplicates(["_tw_none", "_tw_key", "_tw_h"]).join(best, ["_tw_none", "_tw_key", "_tw_h"], "left_semi")
    return back(kept.select(*columns).unionByName(docs.where(~worded)))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM t),
d AS (SELECT rid, doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS node, sh FROM s),
one AS (SELECT node, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS least FROM d WHERE node IS NOT NULL GROUP BY node),
u AS (SELECT node, n, unnest(sh) AS x FROM one),
links AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.x = b.x AND a.node < b.node AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(node, root) USING KEY (node) AS (SELECT node, node FROM one
  UNION (SELECT e.a, min(r.root) FROM r JOIN e ON e.b = r.node JOIN recurring.r k ON k.node = e.a WHERE r.root < k.root GROUP BY e.a)),
g AS (SELECT r.root, min(one.least) AS component_id FROM r JOIN one USING (node) GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, CASE WHEN d.node IS NULL THEN d.doc_id ELSE g.component_id END AS component_id FROM d LEFT JOIN r ON r.node = d.node LEFT JOIN g ON g.root = r.root
"""
