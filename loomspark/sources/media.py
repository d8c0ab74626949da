"""Sizes of media, read from the headers of their files.

What a model makes of an image, a video or a recording follows from its sides, frames and
seconds, and these stand in a few bytes of each container: chunks (PNG, RIFF), segments
(JPEG), blocks (GIF) or boxes (MP4). Nothing is decoded. Files are read by ``binaryFile`` and
walked in Arrow batches; any table with a column of bytes will do as well.

Defined cases: null and empty contents, formats that aren't known and headers that break off have
null in every field that could not be read; counts cover what of a file is there; other columns
stay as they are, but one named like the new column is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: What is known of one file; ``samples`` are sound samples of one channel.
INFO = "struct<kind:string,width:int,height:int,frames:bigint,seconds:double,samples:bigint,rate:int>"
FIELDS = ("kind", "width", "height", "frames", "seconds", "samples", "rate")


def png(data: memoryview) -> dict:
    """Chunks of length, name, body and checksum; animated files count their frames."""
    if data[12:16] != b"IHDR":
        return {}
    width, height = struct.unpack_from(">II", data, 16)
    out, at = {"width": width, "height": height, "frames": 1}, 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"acTL":
            out["frames"] = struct.unpack_from(">I", data, at + 8)[0]
        if name in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return out


def jpeg(data: memoryview) -> dict:
    """Segments of marker and length, up to the frame header."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return {}
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        # Frame headers, but not tables of codes (C4, CC) or extensions (C8).
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return {"width": width, "height": height, "frames": 1}
        if marker in (0xD9, 0xDA):
            return {}
        at += 2 + size
    return {}


def gif(data: memoryview) -> dict:
    """Blocks: pictures count as frames, and delays in hundredths of a second add up."""
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    out, delay = {"width": width, "height": height, "frames": 0, "seconds": 0.0}, 0
    at = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def after_blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    while at + 1 < len(data):
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and at + 6 <= len(data):
                delay += struct.unpack_from("<H", data, at + 4)[0]
            at = after_blocks(at + 2)
        elif data[at] == 0x2C and at + 10 <= len(data):
            out["frames"] += 1
            at = after_blocks(at + 11 + (3 << ((data[at + 9] & 7) + 1) if data[at + 9] & 0x80 else 0))
        else:
            break
    return out | {"seconds": delay / 100}


def riff_chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, first byte and size of the chunks in a stretch; sizes are padded to even ones."""
    while at + 8 <= min(end, len(data)):
        name, size = struct.unpack_from("<4sI", data, at)
        yield bytes(name), at + 8, size
        at += 8 + size + size % 2


def webp(data: memoryview) -> dict:
    out: dict = {"frames": 0, "seconds": 0.0}
    milliseconds = 0
    for name, at, _ in riff_chunks(data, 12, len(data)):
        body = data[at:]
        if name == b"VP8X":
            out |= {"width": 1 + int.from_bytes(body[4:7], "little"), "height": 1 + int.from_bytes(body[7:10], "little")}
        elif name == b"ANMF" and len(body) >= 16:
            out["frames"] += 1
            milliseconds += int.from_bytes(body[12:15], "little")
        elif name == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            out = {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)} | out | {"frames": 1}
        elif name == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
            width, height = struct.unpack_from("<HH", body, 6)
            out = {"width": width & 0x3FFF, "height": height & 0x3FFF} | out | {"frames": 1}
    return out | {"seconds": milliseconds / 1000}


def bmp(data: memoryview) -> dict:
    width, height = struct.unpack_from("<ii", data, 18)
    return {"width": width, "height": abs(height), "frames": 1}


def wav(data: memoryview) -> dict:
    """The format chunk has the bytes of a moment, the data chunk those of all of them."""
    rate = align = None
    for name, at, size in riff_chunks(data, 12, len(data)):
        if name == b"fmt ":
            _, _, rate, _, align = struct.unpack_from("<HHIIH", data, at)
        elif name == b"data" and rate and align:
            # A stream that was never closed has a size beyond the file.
            samples = min(size, len(data) - at) // align
            return {"samples": samples, "rate": rate, "seconds": samples / rate}
    return {"rate": rate} if rate else {}


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, first byte and end of the boxes in a stretch."""
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield bytes(name), at + head, min(end, at + size)
        at += size


def clock(data: memoryview, at: int) -> tuple[int, int]:
    """Units a second and duration of a header box of either version."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)


def mp4(data: memoryview) -> dict:
    """The first track of pictures and the first of sound, with what their tables count."""
    out: dict = {}
    for name, at, end in boxes(data, 0, len(data)):
        if name != b"moov":
            continue
        for name, at, end in boxes(data, at, end):
            if name == b"mvhd":
                units, duration = clock(data, at)
                out.setdefault("seconds", duration / units if units else None)
            elif name == b"trak":
                track = dict.fromkeys(("handler", "units", "duration", "sides", "count", "rate"))
                walk_track(data, at, end, track)
                if track["handler"] == b"vide" and "frames" not in out and track["sides"]:
                    out |= {"width": track["sides"][0], "height": track["sides"][1], "frames": track["count"] or 0}
                    if track["units"]:
                        out["seconds"] = track["duration"] / track["units"]
                elif track["handler"] == b"soun" and "rate" not in out and track["units"]:
                    out |= {"rate": track["rate"] or track["units"], "samples": track["duration"] * (track["rate"] or track["units"]) // track["units"]}
    return out


def walk_track(data: memoryview, at: int, end: int, track: dict) -> None:
    for name, at, end in boxes(data, at, end):
        if name in (b"mdia", b"minf", b"stbl"):
            walk_track(data, at, end, track)
        elif name == b"tkhd":
            # Sides are the last two fields, in 1/65536 of a pixel.
            track["sides"] = tuple(x >> 16 for x in struct.unpack_from(">II", data, at + (88 if data[at] else 76)))
        elif name == b"mdhd":
            track["units"], track["duration"] = clock(data, at)
        elif name == b"hdlr":
            track["handler"] = bytes(data[at + 8 : at + 12])
        elif name == b"stsz":
            track["count"] = struct.unpack_from(">I", data, at + 8)[0]
        elif name == b"stsd" and at + 44 <= end:
            track["rate"] = struct.unpack_from(">I", data, at + 40)[0] >> 16


#: How each container begins (offset, bytes), and how it is read.
CONTAINERS = (
    ("png", ((0, b"\x89PNG\r\n\x1a\n"),), png),
    ("jpeg", ((0, b"\xff\xd8\xff"),), jpeg),
    ("gif", ((0, b"GIF87a"),), gif),
    ("gif", ((0, b"GIF89a"),), gif),
    ("webp", ((0, b"RIFF"), (8, b"WEBP")), webp),
    ("wav", ((0, b"RIFF"), (8, b"WAVE")), wav),
    ("mp4", ((4, b"ftyp"),), mp4),
    ("bmp", ((0, b"BM"),), bmp),
)


def read_header(content: bytes | memoryview | None) -> dict:
    """What a file's headers say, with the fields of INFO that could be read."""
    if not content:
        return {}
    data = memoryview(content).cast("B")
    for kind, marks, read in CONTAINERS:
        if all(data[at : at + len(mark)] == mark for at, mark in marks):
            try:
                return {"kind": kind} | read(data)
            except (struct.error, IndexError):
                return {"kind": kind}
    return {}


def header_info(contents: pa.Array) -> pa.Array:
    found = [read_header(c.as_buffer() if c.is_valid else None) for c in contents]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
    return pa.StructArray.from_arrays([pa.array([f.get(n) for f in found], t) for n, t in zip(FIELDS, types)], FIELDS)


def with_info(df: DataFrame, content: str = "content", info: str = "info") -> DataFrame:
    """Add ``info`` (see INFO): kind, width, height, frames, seconds, samples and rate."""
    return df.withColumn(info, arrow_udf(header_info, INFO)(F.col(f"`{content}`")))


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, length and headers of the media files of a folder; contents stay with the tasks.
    Files without a byte are not listed."""
    files = spark.read.format("binaryFile").load(path)
    rows = with_info(files.select("path", "length", "content"))
    return rows.select(F.substring_index("path", "/", -1).alias("name"), "path", "length", "info.*")


def with_sizes(rows: DataFrame, info: DataFrame, row_id: str) -> DataFrame:
    """Canonical rows with ``_image_sizes``, ``_video_sizes`` and ``_audio_sizes``: the headers of what
    their media columns name, in that order (null where ``info`` has no such path or name).

    ``row_id`` is a column that tells rows apart. References are joined to the listing by path,
    and by name where no path fits; a row without media takes no part in the join.
    """
    kinds = {"_images": "_image_sizes", "_videos": "_video_sizes", "_audios": "_audio_sizes"}
    none = F.array().cast("array<struct<media:string,at:int,ref:string>>")
    one = lambda k: F.coalesce(F.transform(k, lambda r, i: F.struct(F.lit(k).alias("media"), i.alias("at"), r.alias("ref"))), none)
    refs = rows.select(F.col(row_id).alias("row"), F.inline(F.concat(*map(one, kinds))))
    size = F.struct(*(F.col(c) for c in FIELDS)).alias("size")
    held = info.select("path", "name", size)
    keys = held.select(F.explode(F.array_distinct(F.array("path", "name"))).alias("ref"), "size").dropDuplicates(["ref"])
    found = refs.join(keys, "ref", "left")
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("media") == k, F.struct("at", "size")))), lambda x: x["size"])
    put = found.groupBy("row").agg(*(listed(k).alias(v) for k, v in kinds.items()))
    made = rows.drop(*kinds.values()).join(put.withColumnRenamed("row", row_id), row_id, "left")
    return made.withColumns({v: F.when(F.size(v) > 0, F.col(v)) for v in kinds.values()})
