"""Box containers, headers and metadata as binary columns, built with byte expressions and read with a table function."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the box format: the signature box's payload, and the kinds of boxes in the order of a file.
SIGNATURE = bytes((0x0D, 0x0A, 0x87, 0x0A))
ORDER = ("JXL ", "ftyp", "jxll", "colr", "Exif", "xml ", "jxli", "jxlc")


def big_endian(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def from_big_endian(data: Column, first: int, size: int) -> Column:
    """The unsigned integer at a (1-based) byte position."""
    return F.conv(F.hex(F.substring(data, first, size)), 16, 10).cast("long")


def box(kind: Column, payload: Column) -> Column:
    """size, four-character kind, payload; beyond 32 bits, size 1 and a 64-bit size follow."""
    n = F.octet_length(payload)
    small = F.concat(big_endian(n + 8, 4), F.encode(kind, "US-ASCII"), payload)
    large = F.concat(big_endian(F.lit(1), 4), F.encode(kind, "US-ASCII"), big_endian(n.cast("long") + 16, 8), payload)
    return F.when(n.cast("long") + 8 <= 0xFFFFFFFF, small).otherwise(large)


def _joined(column: str, of: Callable[[Column], Column]) -> Column:
    """The binary parts of an array, one after the other: their hex texts are joined once, and read back."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.hex(of(x))), ""))


def containers(boxes: DataFrame) -> DataFrame:
    """(file_id, kind, payload) to (file_id, data), in the order of ORDER, others last, equal kinds as they come by seq."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    d = boxes.withColumn("at", F.when(place == 0, len(ORDER) + 1).otherwise(place)).withColumn("b", box(F.col("kind"), F.col("payload")))
    d = d.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "b"))).alias("s"))
    return d.select("file_id", _joined("s", lambda x: x["b"]).alias("data"))


def parse(data: bytes) -> list[tuple[int, str, bytes]]:
    """(offset, kind, payload) of each box, with 64-bit sizes too. Truncated or impossible sizes raise."""
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated box header")
        size, head = struct.unpack_from(">I", data, at)[0], 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if size == 1:
            if at + 16 > len(data):
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            raise ValueError("box beyond the end")
        out.append((at, kind, data[at + head : at + size]))
        at += size
    return out


def read_boxes(files: DataFrame) -> DataFrame:
    """(file_id, data) to (file_id, seq, offset, kind, payload); unreadable files give one row with `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, data in zip(frame["file_id"], frame["data"], strict=True):
                try:
                    rows += [(i, n, at, kind, payload, None) for n, (at, kind, payload) in enumerate(parse(bytes(data)))]
                except ValueError as e:
                    rows.append((i, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file_id", "seq", "offset", "kind", "payload", "error"]).astype({"seq": "Int64", "offset": "Int64"})

    return files.mapInPandas(run, "file_id long, seq long, offset long, kind string, payload binary, error string")


def codestream(files: DataFrame) -> DataFrame:
    """The image stream of a bare (FF 0A) or boxed file; null without one."""
    bare = F.hex(F.substring("data", 1, 2)) == "FF0A"
    boxed = read_boxes(files.where(~bare)).where("kind = 'jxlc'").groupBy("file_id").agg(F.min_by("payload", "seq").alias("stream"))
    return files.join(boxed, "file_id", "left").select("file_id", F.when(bare, F.col("data")).otherwise(F.col("stream")).alias("stream"))


class Container:
    """Boxes put together step by step, each step a new builder; build() gives the file's bytes as a column."""

    def __init__(self, stream: Column, boxes: dict[str, Column] | None = None):
        self._stream, self._boxes = stream, boxes or {}

    def _with(self, kind: str, payload: Column) -> Container:
        return Container(self._stream, {**self._boxes, kind: payload})

    def level(self, level: int) -> Container:
        return self._with("jxll", F.lit(bytes([level])))

    def icc(self, profile: Column) -> Container:
        return self._with("colr", F.concat(F.lit(b"prof"), profile))

    def exif(self, block: Column) -> Container:
        return self._with("Exif", F.concat(F.lit(bytes(4)), block))

    def xml(self, text: Column) -> Container:
        return self._with("xml ", F.encode(text, "utf-8"))

    def thumbnail(self, stream: Column) -> Container:
        return self._with("jhgm", stream)

    def frame_index(self, index: Column) -> Container:
        return self._with("jxli", index)

    def build(self) -> Column:
        """The signature, the file type, the boxes in the order of ORDER, others after them, the stream last."""
        head = {"JXL ": F.lit(SIGNATURE), "ftyp": F.lit(b"jxl \0\0\0\0jxl ")}
        others = [k for k in self._boxes if k not in ORDER]
        every = {**head, **self._boxes, "jxlc": self._stream}
        kinds = [k for k in (*ORDER[:-1], *others, ORDER[-1]) if k in every]
        return F.concat(*[box(F.lit(k), every[k]) for k in kinds])


def bits(n: Column, width: int) -> Column:
    """A number as a text of bits, the highest first."""
    return F.lpad(F.bin(n.cast("long")), width, "0")


def flag(on: Column) -> Column:
    return F.when(on, "1").otherwise("0")


def pack_bits(text: Column) -> Column:
    """Bits as bytes, zeros after the last."""
    full = F.rpad(text, F.ceil(F.length(text) / 8).cast("int") * 8, F.lit("0"))
    fours = F.sequence(F.lit(1), F.length(full), F.lit(4))
    return F.unhex(F.array_join(F.transform(fours, lambda i: F.conv(F.substring(full, i, F.lit(4)), 2, 16)), ""))


#: Names of a colour encoding's fields, their numbers being their places; the first of each, with TRANSFERS' "srgb" and
#: INTENTS' "relative", is the default.
SPACES, WHITES, PRIMARIES = ("rgb", "grey", "xyb", "unknown"), ("d65", "custom", "e", "dci"), ("srgb", "custom", "bt2100", "p3")
TRANSFERS, INTENTS = ("bt709", "unknown", "linear", "srgb", "pq", "hlg", "gamma"), ("perceptual", "relative", "saturation", "absolute")
#: Encodings of whole colour spaces: (profile, space, white, primaries, transfer, intent). What has no encoding of its own
#: (cmyk) falls back to the default; custom colours come with a profile.
ENCODINGS = {
    "srgb": (False, "rgb", "d65", "srgb", "srgb", "relative"),
    "linear": (False, "rgb", "d65", "srgb", "linear", "relative"),
    "grey": (False, "grey", "d65", "srgb", "srgb", "relative"),
    "cmyk": (False, "rgb", "d65", "srgb", "srgb", "relative"),
    "custom": (True, "rgb", "d65", "custom", "srgb", "relative"),
}


def _colour_text(profile: bool, space: str, white: str, primaries: str, transfer: str, intent: str) -> str:
    """One bit for the default; one for a profile, which stands for all else; then the fields, with room for custom
    values, which are 0 here."""
    if (profile, space, white, primaries, transfer, intent) == ENCODINGS["srgb"]:
        return "1"
    if profile:
        return "01"
    out = f"00{SPACES.index(space):02b}{WHITES.index(white):02b}" + "0" * 64 * (white == "custom")
    if space == "rgb":
        out += f"{PRIMARIES.index(primaries):02b}" + "0" * 192 * (primaries == "custom")
    return out + f"{TRANSFERS.index(transfer):03b}" + "0" * 24 * (transfer == "gamma") + f"{INTENTS.index(intent):02b}"


def colour_bits(space: Column) -> Column:
    """The bits of the colour encoding that a colour space's name maps to; null for an unknown name."""
    out = F.lit(None).cast("string")
    for name, fields in ENCODINGS.items():
        out = F.when(space == name, _colour_text(*fields)).otherwise(out)
    return out


def metadata_bits(m: dict[str, Column]) -> Column:
    """The bits of an image's metadata: depth, alpha, extra (channels), xyb, space, orientation, ticks (numerator, 0 without
    animation), per (denominator), loops. One bit where all are the default."""
    default = (m["depth"] == 8) & ~m["alpha"] & (m["extra"] == 0) & ~m["xyb"] & (colour_bits(m["space"]) == "1") & (m["orientation"] == 1) & (m["ticks"] == 0)
    wide = F.when(m["depth"] <= 8, F.concat(F.lit("00"), bits(m["depth"], 8))).when(m["depth"] <= 16, F.concat(F.lit("01"), bits(m["depth"], 16)))
    depth = F.when(m["depth"] == 8, "1").otherwise(F.concat(F.lit("0"), wide.otherwise(F.concat(F.lit("10"), bits(m["depth"], 32)))))
    extra = F.concat(flag(m["alpha"]), F.when(m["alpha"] | (m["extra"] > 0), bits(m["extra"], 8)).otherwise(""))
    turn = F.when(m["orientation"] == 1, "1").otherwise(F.concat(F.lit("0"), bits(m["orientation"] - 1, 3)))
    moving = F.when(m["ticks"] == 0, "0").otherwise(F.concat(F.lit("1"), *[bits(m[k], 32) for k in ("ticks", "per", "loops")]))
    return F.when(default, "1").otherwise(F.concat(F.lit("0"), depth, extra, flag(m["xyb"]), colour_bits(m["space"]), turn, moving))


def metadata(files: DataFrame) -> DataFrame:
    """Exif (without its four-byte offset), XML and colour profile (without its four-byte kind) of each file."""
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("seq")))
    d = read_boxes(files).groupBy("file_id").agg(first("Exif").alias("exif"), first("xml ").alias("xml"), first("colr").alias("icc"))
    tail = lambda c: F.substring(c, 5, 1 << 30)
    return d.select("file_id", tail("exif").alias("exif"), "xml", tail("icc").alias("icc"))


def exif_block(orientation: Column) -> Column:
    """A minimal big-endian block with the orientation alone, clamped to 1..8."""
    value = F.greatest(F.lit(1), F.least(F.lit(8), orientation))
    return F.concat(F.unhex(F.lit("4D4D002A00000008000101120003" + "00000001")), big_endian(value, 2), F.unhex(F.lit("000000000000")))


def read_orientation(data: bytes | None) -> int:
    """Tag 0x0112 of the first directory in either byte order; 1 where there is none or the block can't be read."""
    if not data or len(data) < 14 or data[:2] not in (b"II", b"MM"):
        return 1
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(end + "I", data, 4)[0]
    if at + 2 > len(data):
        return 1
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(data):
            return 1
        tag, kind = struct.unpack_from(end + "HH", data, p)
        if tag == 0x0112 and kind == 3:
            value = struct.unpack_from(end + "H", data, p + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def orientations(files: DataFrame) -> DataFrame:
    @F.pandas_udf("int")
    def orientation(s: pd.Series) -> pd.Series:
        return s.map(lambda b: read_orientation(None if b is None else bytes(b)))

    return files.select("file_id", orientation("exif").alias("orientation"))


def frame_index(entries: DataFrame) -> DataFrame:
    """(file_id, i, size, offset, duration): a count, then 32, 64 and 32 bits an entry."""
    e = F.concat(big_endian(F.col("size"), 4), big_endian(F.col("offset"), 8), big_endian(F.col("duration"), 4))
    d = entries.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("i", e.alias("e")))).alias("s"))
    return d.select("file_id", F.concat(big_endian(F.size("s"), 4), _joined("s", lambda x: x["e"])).alias("data"))


def read_frame_index(files: DataFrame) -> DataFrame:
    n = from_big_endian(F.col("data"), 1, 4)
    d = files.withColumn("i", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    at = lambda k, size: F.conv(F.hex(F.substring(F.col("data"), (5 + 16 * F.col("i") + k).cast("int"), F.lit(size))), 16,
        10).cast("long")
    return d.select("file_id", "i", at(0, 4).alias("size"), at(4, 8).alias("offset"), at(12, 4).alias("duration"))


def image_header(width: Column, height: Column, bits: Column, channels: Column, colour: Column, alpha: Column) -> Column:
    """Fourteen bytes: FF 0A, width, height, bits, channels, colour space, alpha."""
    return F.concat(F.unhex(F.lit("FF0A")), big_endian(width, 4), big_endian(height, 4), *[big_endian(x, 1) for x in (bits, channels, colour, alpha)])


def read_image_header(data: Column) -> dict[str, Column]:
    places = {"width": (3, 4), "height": (7, 4), "bits": (11, 1), "channels": (12, 1), "colour": (13, 1), "alpha": (14, 1)}
    return {k: from_big_endian(data, *p) for k, p in places.items()}


#: Bits of a side beyond 256, by its two-bit class.
_CLASSES = (9, 13, 18, 30)
FRAME_TYPES, BLENDS = ("regular", "low", "reference", "skip"), ("replace", "add", "blend", "mul_add", "multiply")


def size_bits(width: Column, height: Column) -> Column:
    """Both sides in eight bits each up to 256, else each with a two-bit class."""

    def side(n: Column) -> Column:
        out = F.concat(bits(F.lit(len(_CLASSES) - 1), 2), bits(n - 1, _CLASSES[-1]))
        for k, width_ in reversed(list(enumerate(_CLASSES[:-1]))):
            out = F.when(n - 1 < 1 << width_, F.concat(bits(F.lit(k), 2), bits(n - 1, width_))).otherwise(out)
        return out

    small = F.concat(F.lit("1"), bits(width - 1, 8), bits(height - 1, 8))
    return F.when(F.greatest(width, height) <= 256, small).otherwise(F.concat(F.lit("0"), side(width), side(height)))


def frame_bits(kind: Column, blend: Column, duration: Column, last: Column, slot: Column) -> Column:
    """One bit for the default frame (regular, replace, no duration, last, slot 0); else all fields. Slots are 0 to 7."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c) - 1
    default = (kind == "regular") & (blend == "replace") & (duration == 0) & last & (slot == 0)
    fields = F.concat(F.lit("0"), bits(place(FRAME_TYPES, kind), 2), bits(place(BLENDS, blend), 3), bits(duration, 32), flag(last), bits(slot, 3))
    return F.when(default, "1").otherwise(fields)


def unpack_bits(data: Column) -> Column:
    """Bytes as a text of bits."""
    byte = lambda i: F.lpad(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 2), 8, "0")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), byte), "")


def read_headers(files: DataFrame) -> DataFrame:
    """(.., data) with width, height, type, blend, duration, last and slot, read off the bytes of both headers."""
    number = lambda first, n: F.conv(F.substring(F.col("t"), first, n), 2, 10).cast("long")
    class_of = lambda first: F.element_at(F.array(*map(F.lit, _CLASSES)), (number(first, F.lit(2)) + 1).cast("int"))
    small = F.substring("t", 1, 1) == "1"
    d = files.withColumn("t", unpack_bits(F.col("data"))).withColumn("small", small)
    d = d.withColumn("n1", F.when(F.col("small"), 8).otherwise(class_of(F.lit(2)))).withColumn("w_at", F.when(F.col("small"), 2).otherwise(4))
    d = d.withColumn("h_at", F.col("w_at") + F.col("n1") + F.when(F.col("small"), 0).otherwise(2))
    d = d.withColumn("n2", F.when(F.col("small"), 8).otherwise(class_of(F.col("h_at") - 2))).withColumn("at", F.col("h_at") + F.col("n2"))
    default, after = F.substring(F.col("t"), F.col("at"), F.lit(1)) == "1", lambda k: F.col("at") + k
    name = lambda names, first, n: F.element_at(F.array(*map(F.lit, names)), (number(first, F.lit(n)) + 1).cast("int"))
    d = d.withColumns({
        "width": number(F.col("w_at"), F.col("n1")) + 1, "height": number(F.col("h_at"), F.col("n2")) + 1,
        "type": F.when(default, "regular").otherwise(name(FRAME_TYPES, after(1), 2)),
            "blend": F.when(default, "replace").otherwise(name(BLENDS, after(3), 3)),
        "duration": F.when(default, 0).otherwise(number(after(6), F.lit(32))),
            "last": default | (F.substring(F.col("t"), after(38), F.lit(1)) == "1"),
        "slot": F.when(default, 0).otherwise(number(after(39), F.lit(3))),
    })
    return d.drop("t", "small", "n1", "n2", "w_at", "h_at", "at")


def header_round_trip(frames: DataFrame) -> DataFrame:
    """(frame_id, width, height, type, blend, duration, last, slot): bytes of both headers, and whether they read back."""
    fields = ("width", "height", "type", "blend", "duration", "last", "slot")
    text = F.concat(size_bits(F.col("width"), F.col("height")), frame_bits(*map(F.col, fields[2:])))
    d = frames.select("frame_id", F.struct(*fields).alias("given"), pack_bits(text).alias("data"))
    same = lambda k: F.col(k) == F.col(f"given.{k}")
    exact = same(fields[0])
    for k in fields[1:]:
        exact = exact & same(k)
    return read_headers(d).select("frame_id", "data", exact.alias("exact"))


def sections(parts: DataFrame) -> DataFrame:
    """(frame_id, i, data): the count and all lengths first, then the payloads."""
    d = parts.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("s"))
    lengths = _joined("s", lambda x: big_endian(F.octet_length(x["data"]), 4))
    return d.select("frame_id", F.concat(big_endian(F.size("s"), 4), lengths, _joined("s", lambda x: x["data"])).alias("data"))


def pixmaps(px: DataFrame, width: int, height: int) -> DataFrame:
    """Binary portable pixmaps: a header and three bytes a pixel."""
    from ..operators.metrics import interleave, to_bytes

    head = F.lit(f"P6\n{width} {height}\n255\n".encode())
    return interleave(px, width, 3).select("image_id", F.concat(head, to_bytes(F.col("samples"))).alias("data"))
