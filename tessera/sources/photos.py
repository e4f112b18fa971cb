"""EXIF of photos from their bytes (SRC-13): place, direction, moment and the JSON comment; and the writer of such bytes.

A walk by offsets through the entries of three directories, in either byte order. An offset or a count that leads out of the
segment gives no value; a photo without a readable segment gives NULL everywhere. Nothing is decoded but what is asked for.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numbers import dms

#: Tags of the three directories, and bytes of a value of each kind.
EXIF_AT, GPS_AT, TAKEN, COMMENT = 0x8769, 0x8825, 0x9003, 0x9286
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE, DIRECTION = 1, 2, 3, 4, 17
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
ASCII = b"ASCII\0\0\0"
_RATIONALS = "array<struct<n: bigint, d: bigint>>"
_RAW = f"lat {_RATIONALS}, lat_ref string, lon {_RATIONALS}, lon_ref string, direction {_RATIONALS}, taken string, comment string"


def exif_segment(photo: bytes) -> bytes | None:
    """The TIFF part of a JPEG's first EXIF segment."""
    at = 2
    if photo[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(photo) and photo[at] == 0xFF:
        marker, size = photo[at + 1], int.from_bytes(photo[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2:  # the picture begins
            return None
        if marker == 0xE1 and photo[at + 4 : at + 10] == b"Exif\0\0":
            return photo[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def directory(tiff: bytes, at: int, order: str) -> dict[int, tuple[int, bytes]]:
    """Entries of the directory at an offset: tag -> (kind, bytes). Entries that lead out of the segment are left out."""
    if not 0 < at <= len(tiff) - 2:
        return {}
    (count,) = struct.unpack_from(f"{order}H", tiff, at)
    out: dict[int, tuple[int, bytes]] = {}
    for entry in range(at + 2, min(at + 2 + 12 * count, len(tiff) - 11), 12):
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, entry)
        size = SIZES.get(kind, 0) * n
        start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", tiff, entry + 8)[0]
        if size and start + size <= len(tiff):
            out.setdefault(tag, (kind, tiff[start : start + size]))
    return out


def exif(photo: bytes | None) -> dict | None:
    """What _RAW names, as it is stated; NULL without a segment in a known byte order."""
    tiff = exif_segment(photo or b"")
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2]) if tiff else None
    if order is None or len(tiff) < 8 or struct.unpack_from(f"{order}H", tiff, 2)[0] != 42:
        return None
    first = directory(tiff, struct.unpack_from(f"{order}I", tiff, 4)[0], order)
    inside = [directory(tiff, struct.unpack(f"{order}I", first[t][1])[0], order) if t in first and first[t][0] == 4 and len(first[t][1]) == 4 else {} for t in (EXIF_AT, GPS_AT)]

    def text(entries: dict, tag: int) -> str | None:
        return entries[tag][1].split(b"\0")[0].decode("utf-8", errors="replace").strip() if tag in entries and entries[tag][0] == 2 else None

    def rationals(tag: int) -> list[dict] | None:
        kind, raw = inside[1].get(tag, (0, b""))
        return [{"n": n, "d": d} for n, d in struct.iter_unpack(f"{order}II", raw)] if kind == 5 else None

    _, comment = inside[0].get(COMMENT, (0, b""))
    return {"lat": rationals(LATITUDE), "lat_ref": text(inside[1], LATITUDE_REF), "lon": rationals(LONGITUDE), "lon_ref": text(inside[1], LONGITUDE_REF), "direction": rationals(DIRECTION), "taken": text(inside[0], TAKEN), "comment": comment.removeprefix(ASCII).strip(b"\0").decode("utf-8", errors="replace").strip() or None}


_TYPE = pa.struct([*((n, pa.list_(pa.struct([("n", pa.int64()), ("d", pa.int64())]))) if n in ("lat", "lon", "direction") else (n, pa.string()) for n in ("lat", "lat_ref", "lon", "lon_ref", "direction", "taken", "comment"))])


def _taken(content: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != content]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array([exif(x.as_py()) for x in batch[content]], _TYPE)], names=[*kept, "_exif"])

    return run


def photo_facts(df: DataFrame, content: str, app: str | None = None) -> DataFrame:
    """SRC-13: df with the bytes replaced by gps_lat, gps_lon, bearing, taken (timestamp), comment (JSON text), loc_path, loc_source.

    Degrees are stated as three fractions and a hemisphere; without one of them, or with a fraction over 0, they are NULL. A
    comment that isn't a JSON object, or with app isn't that application's, is NULL.
    """
    fields = [f for f in df.schema.fields if f.name != content]
    raw = df.mapInArrow(_taken(content), T.StructType([*fields, T.StructField("_exif", T._parse_datatype_string(_RAW))]))
    x = F.col("_exif")
    part = lambda c, i: F.try_divide(F.get(c, F.lit(i))["n"].cast("double"), F.get(c, F.lit(i))["d"])
    degrees = lambda c, ref: F.when(F.length(ref) > 0, dms(part(c, 0), part(c, 1), part(c, 2), ref))
    own = F.try_parse_json(x["comment"])
    comment = F.when(F.schema_of_variant(own).startswith("OBJECT"), x["comment"])
    if app is not None:
        comment = F.when(F.get_json_object(comment, "$.app") == app, comment)
    moment = F.try_to_timestamp(F.regexp_extract(x["taken"], r"^(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    return raw.withColumn("comment", comment).select(*(f.name for f in fields), degrees(x["lat"], x["lat_ref"]).alias("gps_lat"), degrees(x["lon"], x["lon_ref"]).alias("gps_lon"), part(x["direction"], 0).alias("bearing"), moment.alias("taken"), "comment", F.get_json_object("comment", "$.loc.path").alias("loc_path"), F.get_json_object("comment", "$.loc.source").alias("loc_source"))


def exif_bytes(lat: float | None, lon: float | None, bearing: float | None, taken: str | None, comment: str | None, order: str = "<") -> bytes:
    """A JPEG of an EXIF segment only. Degrees become whole degrees, minutes and seconds to a ten-thousandth."""

    def fractions(value: float) -> bytes:
        ticks = round(abs(value) * 36_000_000)
        return b"".join(struct.pack(f"{order}II", n, d) for n, d in ((ticks // 36_000_000, 1), (ticks // 600_000 % 60, 1), (ticks % 600_000, 10_000)))

    def written(entries: list[tuple[int, int, bytes]], at: int) -> bytes:
        rows, more, free = struct.pack(f"{order}H", len(entries)), b"", at + 6 + 12 * len(entries)
        for tag, kind, raw in sorted(entries):
            rows += struct.pack(f"{order}HHI", tag, kind, len(raw) // SIZES[kind])
            if len(raw) <= 4:
                rows += raw.ljust(4, b"\0")
            else:
                rows += struct.pack(f"{order}I", free + len(more))
                more += raw
        return rows + bytes(4) + more

    own = [(TAKEN, 2, taken.encode() + b"\0")] if taken else []
    own += [(COMMENT, 7, ASCII + comment.encode())] if comment is not None else []
    place: list[tuple[int, int, bytes]] = []
    if lat is not None:
        place += [(LATITUDE_REF, 2, b"S\0" if lat < 0 else b"N\0"), (LATITUDE, 5, fractions(lat))]
    if lon is not None:
        place += [(LONGITUDE_REF, 2, b"W\0" if lon < 0 else b"E\0"), (LONGITUDE, 5, fractions(lon))]
    if bearing is not None:
        place += [(DIRECTION, 5, struct.pack(f"{order}II", round(bearing * 100), 100))]
    at = 8 + 2 + 24 + 4
    first = written(own, at)
    head = [(EXIF_AT, 4, struct.pack(f"{order}I", at)), (GPS_AT, 4, struct.pack(f"{order}I", at + len(first)))]
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + written(head, 8) + first + written(place, at + len(first))
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"


def photos(df: DataFrame, lat: Column, lon: Column, bearing: Column, taken: Column, comment: Column, big: Column, content: str = "content") -> DataFrame:
    """The rows of df with the bytes of a photo that states these facts; big: big-endian."""
    made = df.select("*", F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), bearing.cast("double").alias("bearing"), taken.alias("taken"), comment.alias("comment"), big.alias("big")).alias("_facts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "_facts"]
            raws = [exif_bytes(f["lat"], f["lon"], f["bearing"], f["taken"], f["comment"], ">" if f["big"] else "<") for f in batch["_facts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(raws, pa.binary())], names=[*kept, content])

    return made.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(content, T.BinaryType())]))


def with_location(comment: str | None, path: str, source: str = "") -> str:
    """A comment with its place in the folder tree; what else it says stays."""
    try:
        told = json.loads(comment) if comment else {}
    except json.JSONDecodeError:
        told = {}
    told = told if isinstance(told, dict) else {}
    version = told.get("v", 1)
    told = {"app": "gpp"} | told | {"v": max(version if isinstance(version, int) else 1, 2), "loc": {"path": path} | ({"source": source} if source else {})}
    return json.dumps(told, ensure_ascii=False, separators=(",", ":"))
