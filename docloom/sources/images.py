"""What images say of themselves, by a walk over their blocks and directories; no pixel is decoded.

``blocks`` is a small walk over one image's bytes. ``Blocks`` and ``Summary`` offer it to Spark as table functions,
which ``frames`` and ``metadata`` join laterally: rows stay where they are, only the bytes go to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from docloom.functions import text as fn

#: Tags of a directory (description, artist, time of change) and the format number of ASCII values.
TITLE, ARTIST, CREATED, ASCII = 270, 315, 306, 2
#: Longest title and artist that are kept.
TITLE_CHARS, ARTIST_CHARS = 200, 100

Block = tuple[str, int, int, int, int | None, str | None]


def _directories(b: bytes, base: int = 0) -> Iterator[Block]:
    """Directories and their ASCII entries of a TIFF structure that begins at ``base``; a directory is met once."""
    order = {b"II*\x00": "little", b"MM\x00*": "big"}.get(b[base : base + 4])
    if order is None:
        return

    def number(at: int, size: int) -> int:
        return int.from_bytes(b[at : at + size], order)

    at, place, seen = base + number(base + 4, 4), 0, {base}
    while at not in seen and at + 2 <= len(b):
        seen.add(at)
        end = at + 2 + 12 * number(at, 2)
        yield "directory", place, at, end + 4 - at, None, None
        for e in range(at + 2, min(end, len(b) - 11), 12):
            tag, form, size = number(e, 2), number(e + 2, 2), number(e + 4, 4)
            start = e + 8 if size <= 4 else base + number(e + 8, 4)
            if form == ASCII and start + size <= len(b):
                yield "tag", place, start, size, tag, b[start : start + size].removesuffix(b"\x00").decode("latin-1")
        at, place = base + number(end, 4), place + 1


def _gif(b: bytes) -> Iterator[Block]:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def chain(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    at, place = 13 + table(b[10] if len(b) > 10 else 0), 0
    while at + 1 < len(b):
        if b[at] == 0x21:
            at = chain(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            end = chain(at + 11 + table(b[at + 9]))
            yield "frame", place, at, min(end, len(b)) - at, None, None
            at, place = end, place + 1
        else:
            return


def _png(b: bytes) -> Iterator[Block]:
    at, place, controlled, begun = 8, 0, False, False
    while at + 8 <= len(b):
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        if kind == b"fcTL":
            controlled = True
            yield "frame", place, at, size + 12, None, None
            place += 1
        elif kind == b"IDAT" and not begun:
            begun = True
            if not controlled:
                yield "frame", place, at, size + 12, None, None
                place += 1
        elif kind == b"eXIf":
            yield from (x for x in _directories(b[: at + 8 + size], at + 8) if x[0] == "tag")
        elif kind == b"tEXt":
            name, _, value = b[at + 8 : at + 8 + size].partition(b"\x00")
            if name == b"date":
                yield "text", 0, at, size, None, value.decode("latin-1")
        at += size + 12


def _jpeg(b: bytes) -> Iterator[Block]:
    yield "frame", 0, 0, len(b), None, None
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] not in (0xD9, 0xDA):
        if b[at + 1] == 0xFF:
            at += 1
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        if b[at + 1] == 0xE1 and b[at + 4 : at + 10] == b"Exif\x00\x00":
            yield from (x for x in _directories(b[: at + 2 + size], at + 10) if x[0] == "tag")
        at += 2 + max(size, 2)


def _webp(b: bytes) -> Iterator[Block]:
    at, place = 12, 0
    while at + 8 <= len(b):
        size, kind = int.from_bytes(b[at + 4 : at + 8], "little"), b[at : at + 4]
        if kind in (b"ANMF", b"VP8 ", b"VP8L"):
            yield "frame", place, at, size + 8, None, None
            place += 1
        elif kind == b"EXIF":
            start = at + 8 + (6 if b[at + 8 : at + 14] == b"Exif\x00\x00" else 0)
            yield from (x for x in _directories(b[: at + 8 + size], start) if x[0] == "tag")
        at += 8 + size + size % 2


def blocks(content: bytes | None) -> Iterator[Block]:
    """(kind, place, start, n_bytes, tag, value) of frames and entries of GIF, PNG, JPEG, WebP and TIFF.

    Null, empty and unknown bytes have none. What is cut off ends the walk; what was met before stays. An entry whose
    value lies outside the image is left out. Each directory of a TIFF is a frame.
    """
    b = bytes(content or b"")
    if b.startswith((b"GIF87a", b"GIF89a")):
        yield from _gif(b)
    elif b.startswith(b"\x89PNG\r\n\x1a\n"):
        yield from _png(b)
    elif b.startswith(b"\xff\xd8\xff"):
        yield from _jpeg(b)
    elif b.startswith(b"RIFF") and b[8:12] == b"WEBP":
        yield from _webp(b)
    else:
        yield from (("frame", *x[1:]) if x[0] == "directory" else x for x in _directories(b))


@udtf(returnType="kind string, place int, start long, n_bytes long, tag int, value string")
class Blocks:
    """A row for each frame and entry."""

    def eval(self, content: bytes):
        yield from blocks(content)


@udtf(returnType="n_frames int, image_title string, image_artist string, image_created string, image_date string")
class Summary:
    """One row an image. A tag given twice counts as it is given last; only the first directory describes the image."""

    def eval(self, content: bytes):
        n, tags, date = 0, {}, None
        for kind, place, _, _, tag, value in blocks(content):
            if kind == "frame":
                n += 1
            elif kind == "tag" and place == 0:
                tags[tag] = value
            elif kind == "text":
                date = value
        yield n, tags.get(TITLE), tags.get(ARTIST), tags.get(CREATED), date


def frames(images: DataFrame, content: str, max_pages: int | None = None) -> DataFrame:
    """A row for each frame: the image's other columns, ``frame``, ``start`` and ``n_bytes``; the first ``max_pages`` (0: none).

    Images without a frame (null, empty, unknown) have no row; repeated rows repeat their frames.
    """
    keep = [F.col(f"image.`{c}`") for c in images.columns if c != content]
    found = images.alias("image").lateralJoin(Blocks(F.col(f"image.{content}").outer()).alias("block"))
    found = found.where(F.col("block.kind") == "frame")
    if max_pages is not None:
        found = found.where(F.col("block.place") < max_pages)
    return found.select(*keep, F.col("block.place").alias("frame"), F.col("block.start").alias("start"), F.col("block.n_bytes").alias("n_bytes"))


def metadata(images: DataFrame, content: str, into: str = "metadata") -> DataFrame:
    """The images' other columns and a struct: page_count (1 at least), dimensions, file_size, title, author, creation_date.

    Nothing is shuffled. A null image has a null struct. Unlike the usual reader, TIFF files tell their own tags too.
    The date is the directory's where that is a time, else the ``date`` of a PNG's texts.
    """
    keep = [F.col(f"image.`{c}`") for c in images.columns if c != content]
    found = images.alias("image").lateralJoin(Summary(F.col(f"image.{content}").outer()).alias("said"))
    data, said = F.col(f"image.{content}"), lambda c: F.col(f"said.{c}")
    date = F.when(said("image_date") != "", said("image_date"))
    about = F.struct(
        F.greatest(said("n_frames"), F.lit(1)).alias("page_count"),
        fn.image_dimensions(data).alias("dimensions"),
        F.octet_length(data).cast("long").alias("file_size"),
        F.substring(said("image_title"), 1, TITLE_CHARS).alias("title"),
        F.substring(said("image_artist"), 1, ARTIST_CHARS).alias("author"),
        F.coalesce(fn.exif_date(said("image_created")), date).alias("creation_date"),
    )
    return found.select(*keep, F.when(data.isNotNull(), about).alias(into))
