"""Media columns: payloads stored in ISO base media files, and a reader that walks their boxes.

encode() stores bytes losslessly as one track of 8-bit samples; inspect() walks nested boxes, decodes the sample tables
and returns codec, duration and the byte ranges of key frames without decoding a payload; payload_of() reads the
samples back by those tables. Null bytes are stored as an empty payload (one padded frame)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a frame; payloads are padded with spaces to a positive multiple.
FRAME = 192
#: Frames from one key frame to the next, and in a chunk of the file.
KEY_EVERY, PER_CHUNK = 8, 64
#: Frames a second.
RATE = 50
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Levels of boxes in boxes; files that are in use have some ten.
DEEPEST = 64
#: Identity matrix of track and movie headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """raw and spaces up to a positive multiple of FRAME."""
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def encode(payload: bytes) -> bytes:
    """An ISO media file whose one track holds payload, FRAME bytes a sample (the last may be shorter)."""
    n = max(1, -(-len(payload) // FRAME))
    last = len(payload) - (n - 1) * FRAME
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    chunk_n = -(-n // PER_CHUNK)
    runs = [(1, min(n, PER_CHUNK))]
    if n > PER_CHUNK and n % PER_CHUNK:
        runs.append((chunk_n, n % PER_CHUNK))
    stsz = struct.pack(">II", FRAME, n) if last == FRAME else struct.pack(f">II{n}I", 0, n, *[FRAME] * (n - 1), last)
    keys = range(1, n + 1, KEY_EVERY)
    wide = len(payload) + 4096 + 32 * n >= 2**32

    def moov(start: int) -> bytes:
        offsets = [start + i * PER_CHUNK * FRAME for i in range(chunk_n)]
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, FRAME * RATE << 16 & 0xFFFFFFFF))
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", at, per, 1) for at, per in runs]),
            full(b"stsz", 0, 0, stsz),
            full(b"co64", 0, 0, struct.pack(f">I{chunk_n}Q", chunk_n, *offsets)) if wide else full(b"stco", 0, 0, struct.pack(f">I{chunk_n}I", chunk_n, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", 0, 0, bytes(4)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"soun"), b"samples\0"), minf)
        tkhd = full(b"tkhd", 0, 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + (16 if len(payload) + 8 >= 2**32 else 8)
    return head + moov(first) + box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Path, body start and body end of every box from start to end, parents first. Raises ValueError on a box that leaves its
    parent and on boxes nested deeper than DEEPEST."""
    inside = [("", start, end)]  # the open boxes: path, what is next in them, their end
    while inside:
        path, start, end = inside.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("cut box header")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, start + size
        inside.append((path, start + size, end))
        if kind in CONTAINERS:
            if len(inside) > DEEPEST:
                raise ValueError("boxes nested too deep")
            inside.append((name, body, start + size))


def tracks(media: bytes) -> list[dict]:
    """Sample tables of each track: codec, timescale, duration, and for each sample offset, size and whether it is a key
    frame, those of fragments (moof) included. The payload's bytes are not read."""
    data, out, now = memoryview(media), [], {}
    of: dict[int, dict] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    moof, run = 0, {}
    for path, at, end in walk(data, 0, len(data)):
        kind, body = path.rpartition("/")[2], data[at:end]  # what is read beyond a box's end is an error
        u32 = lambda at: struct.unpack_from(">I", body, at)[0]  # noqa: B023, E731
        if path == "/moov/trak":
            out.append(now := {"codec": "", "timescale": 0, "duration": 0, "stts": [], "stss": None, "stsc": [], "sizes": [], "chunks": [], "fragments": []})
        elif path == "/moov/mvex/trex":
            defaults[u32(4)] = (u32(12), u32(16), u32(20))
        elif path == "/moof":
            moof = at - (8 if bytes(data[at - 4 : at]) == b"moof" else 16)
        elif path == "/moof/traf/tfhd":
            run = fragment_head(body, moof, defaults)
        elif path == "/moof/traf/trun":
            if run.get("track") in of:
                fragment_run(body, run, of[run["track"]], len(data))
        elif not path.startswith("/moov/trak/"):
            continue
        elif kind == "tkhd":
            of[u32(20 if body[0] == 1 else 12)] = now
        elif kind == "mdhd":
            wide = body[0] == 1
            now["timescale"], now["duration"] = struct.unpack_from(">IQ" if wide else ">II", body, 20 if wide else 12)
        elif kind == "hdlr":
            now["handler"] = bytes(body[8:12]).decode("latin-1")
        elif kind == "stsd" and u32(4):
            now["codec"] = bytes(body[12:16]).decode("latin-1")
        elif kind == "stts":
            now["stts"] = list(struct.iter_unpack(">II", body[8 : 8 + 8 * u32(4)]))
        elif kind == "stss":
            now["stss"] = set(struct.unpack_from(f">{u32(4)}I", body, 8))
        elif kind == "stsc":
            now["stsc"] = [x[:2] for x in struct.iter_unpack(">III", body[8 : 8 + 12 * u32(4)])]
        elif kind == "stsz":
            size, n = struct.unpack_from(">II", body, 4)
            if size * n > len(data):
                raise ValueError("samples are longer than the file")
            now["sizes"] = [size] * n if size else list(struct.unpack_from(f">{n}I", body, 12))
        elif kind == "stz2":
            now["sizes"] = compact_sizes(body)
        elif kind in ("stco", "co64"):
            now["chunks"] = list(struct.unpack_from(f">{u32(4)}{'I' if kind == 'stco' else 'Q'}", body, 8))
    for t in out:
        places, i, per, entry = [], 0, 0, 0
        for c, offset in enumerate(t["chunks"], 1):
            while entry < len(t["stsc"]) and t["stsc"][entry][0] <= c:
                per, entry = t["stsc"][entry][1], entry + 1
            for size in t["sizes"][i : i + per]:
                places.append((offset, size))
                offset += size
            i += per
        t["keys"] = [p for k, p in enumerate(places, 1) if t["stss"] is None or k in t["stss"]]
        t["samples"] = places + [(o, n) for o, n, _, _ in t["fragments"]]
        t["keys"] += [(o, n) for o, n, _, key in t["fragments"] if key]
        t["duration"] += sum(d for _, _, d, _ in t["fragments"])
    return out


def compact_sizes(body: memoryview) -> list[int]:
    """Sample sizes of 4, 8 or 16 bits."""
    bits, n = body[7], struct.unpack_from(">I", body, 8)[0]
    raw = body[12:]
    if bits == 4:
        if n > 2 * len(raw):
            raise ValueError("cut sample sizes")
        return [raw[k // 2] >> 4 if k % 2 == 0 else raw[k // 2] & 15 for k in range(n)]
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", raw, 0))


def fragment_head(body: memoryview, moof: int, defaults: dict[int, tuple[int, int, int]]) -> dict:
    """Track, base offset and default duration, size and flags of the samples of a track fragment."""
    flags, track = struct.unpack_from(">II", body, 0)
    flags, place = flags & 0xFFFFFF, 8
    out = {"track": track, "base": moof, "at": None}
    if flags & 0x1:
        out["base"] = struct.unpack_from(">Q", body, place)[0]
        place += 8
    place += 4 * bool(flags & 0x2)
    for bit, name, default in zip((0x8, 0x10, 0x20), ("duration", "size", "flags"), defaults.get(track, (0, 0, 0)), strict=True):
        out[name] = default
        if flags & bit:
            out[name] = struct.unpack_from(">I", body, place)[0]
            place += 4
    return out


def fragment_run(body: memoryview, head: dict, track: dict, file_bytes: int) -> None:
    """Add offset, size, duration and whether it is a key frame of each sample of a run to its track. A run without an offset of
    its own follows the one before."""
    flags, n = struct.unpack_from(">II", body, 0)
    flags, place = flags & 0xFFFFFF, 8
    if n * max(1, 0 if flags & 0x200 else head["size"]) > file_bytes:
        raise ValueError("samples are longer than the file")
    offset, first = head["at"] if head["at"] is not None else head["base"], None
    if flags & 0x1:
        offset = head["base"] + struct.unpack_from(">i", body, place)[0]
        place += 4
    if flags & 0x4:
        first = struct.unpack_from(">I", body, place)[0]
        place += 4
    for k in range(n):
        sample = {name: head[name] for name in ("duration", "size", "flags")}
        for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")):
            if flags & bit:
                sample[name] = struct.unpack_from(">I", body, place)[0]
                place += 4
        told = first if k == 0 and first is not None else sample["flags"]
        track["fragments"].append((offset, sample["size"], sample["duration"], not told & 0x10000))
        offset += sample["size"]
    head["at"] = offset


def payload_of(media: bytes) -> bytes:
    """The samples of the first track, in order."""
    found = tracks(media)
    return b"".join(media[o : o + s] for o, s in found[0]["samples"]) if found else b""


FEATURES = "struct<codec:string,handler:string,timescale:long,duration:long,duration_s:double,samples:long,keyframes:array<struct<offset:long,size:long>>>"


def features_of(media: bytes | None) -> dict | None:
    """The first track's features; None where media is null, not an ISO media file with a track, or damaged: boxes that leave
    their parents, tables that end before what they announce or hold more samples than the file has bytes."""
    try:
        found = tracks(media) if media is not None else []
    except (ValueError, IndexError, struct.error):
        return None
    if not found:
        return None
    t = found[0]
    return {
        "codec": t["codec"], "handler": t.get("handler", ""), "timescale": t["timescale"], "duration": t["duration"],
        "duration_s": t["duration"] / t["timescale"] if t["timescale"] else None, "samples": len(t["samples"]),
        "keyframes": [{"offset": o, "size": s} for o, s in t["keys"]],
    }


def encode_column(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: each row's text as UTF-8 (null: empty), padded and stored as an ISO media file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, column):
            data, offs = common.utf8(batch.column(column))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(t) for t in texts], pa.int64()), common.binary([encode(pad(t)) for t in texts])], ["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(store, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def inspect_column(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a column features (codec, duration, key frame byte ranges; null for what is not ISO media)."""
    kind = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, media):
            found = [features_of(x.as_py()) for x in batch.column(media)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "features"])

    base = df.drop("features")
    return base.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", features {FEATURES}")


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from stored media: hashes, sizes and a canonical feature string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "media", common.CHUNK_BYTES):
            rows: list[list] = [[] for _ in range(6)]
            for x in batch.column("media"):
                stored = x.as_py()
                t = tracks(stored)[0]
                payload = b"".join(stored[o : o + s] for o, s in t["samples"])
                keys = ",".join(f"{o}+{s}" for o, s in t["keys"])
                seconds = t["duration"] / t["timescale"]
                feature = f"codec={t['codec'].strip()};duration={seconds:.3f};samples={len(t['samples'])};keyframes={len(t['keys'])};ranges={hashlib.sha256(keys.encode()).hexdigest()[:16]};first={t['keys'][0][0]}+{t['keys'][0][1]};last={t['keys'][-1][0]}+{t['keys'][-1][1]}"
                for out, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature), strict=True):
                    out.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *[pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(read, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as ISO media and read back by its boxes."""
    return digest(encode_column(common.table(spark, sf_dir, "documents").select("doc_id", F.col("text"))))
