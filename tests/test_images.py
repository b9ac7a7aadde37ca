"""Blocks of images against hand-made bytes, statistics of samples against numpy on whole rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import pixels
from docloom.sources import images


def tiff(order, *directories, base=b""):
    """Directories of (tag, format, value) one after the other."""
    at, out = 8, (b"II*\0" if order == "little" else b"MM\0*") + (8).to_bytes(4, order)
    for k, entries in enumerate(directories):
        tail, body, end = b"", len(entries).to_bytes(2, order), at + 2 + 12 * len(entries) + 4
        for tag, form, value in entries:
            body += tag.to_bytes(2, order) + form.to_bytes(2, order) + len(value).to_bytes(4, order)
            body += value.ljust(4, b"\0") if len(value) <= 4 else (end + len(tail)).to_bytes(4, order)
            tail += value if len(value) > 4 else b""
        at = end + len(tail)
        out += body + (at if k + 1 < len(directories) else 0).to_bytes(4, order) + tail
    return out


TAGS = [(270, 2, b"A long title\0"), (315, 2, b"Bo\0"), (306, 2, b"2024:01:05 10:20:30\0"), (274, 3, b"\0\1")]


def chunk(kind, data=b""):
    return len(data).to_bytes(4, "big") + kind + data + b"\0\0\0\0"


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (5).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\x08\2\0\0\0") + b"".join(chunks)


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + m + (len(d) + 2).to_bytes(2, "big") + d for m, d in segments) + b"\xff\xda\0\0"


def riff(*chunks):
    body = b"WEBP" + b"".join(k + len(d).to_bytes(4, "little") + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def gif(n, local=False):
    frame = b"\x2c" + b"\0" * 8 + (b"\x81" + b"\0" * 12 if local else b"\0") + b"\2" + b"\3abc\1d\0"
    return b"GIF89a" + b"\5\0\7\0\x80\0\0" + b"\0" * 6 + b"\x21\xf9\4\0\0\0\0\0" + frame * n + b"\x3b"


EXIF = b"Exif\0\0" + tiff("big", TAGS)
SAID = ("A long title", "Bo", "2024-01-05T10:20:30")
NOTHING = (None, None, None)
CASES = [
    (None, None, None),
    (b"", 1, NOTHING),
    (b"words", 1, NOTHING),
    (tiff("little", TAGS), 1, SAID),
    (tiff("big", TAGS, [], TAGS), 3, SAID),
    (tiff("little", [], TAGS), 2, NOTHING),
    (tiff("big", [(270, 2, b"a\0"), (270, 2, b"b\0")]), 1, ("b", None, None)),
    (tiff("big", [(270, 2, b"x" * 300 + b"\0"), (315, 2, b"y" * 300)]), 1, ("x" * 200, "y" * 100, None)),
    (tiff("big", [(270, 2, b"\xe9t\xe9\0"), (306, 2, b"2024:13:05 10:20:30\0")]), 1, ("\xe9t\xe9", None, None)),
    (tiff("big", [(270, 2, b"cut off here\0")])[:-3], 1, NOTHING),
    (b"II*\0\x08\0\0\0\0\0\x08\0\0\0", 1, NOTHING),  # a directory that names itself as the next
    (jpeg((b"\xe0", b"JFIF\0"), (b"\xe1", b"http://other\0"), (b"\xe1", EXIF)), 1, SAID),
    (jpeg((b"\xe1", EXIF))[:40], 1, NOTHING),
    (png(chunk(b"eXIf", tiff("little", TAGS)), chunk(b"IDAT", b"x"), chunk(b"IDAT", b"y")), 1, SAID),
    (png(chunk(b"tEXt", b"date\0today"), chunk(b"IDAT")), 1, (None, None, "today")),
    (png(chunk(b"fcTL", b"1"), chunk(b"IDAT"), chunk(b"fcTL", b"2"), chunk(b"fdAT"), chunk(b"fcTL", b"3")), 3, NOTHING),
    (png(chunk(b"IDAT"), chunk(b"fcTL", b"2"), chunk(b"fdAT")), 2, NOTHING),
    (gif(1), 1, NOTHING),
    (gif(4, local=True), 4, NOTHING),
    (gif(3)[:-12], 2, NOTHING),  # its third frame's descriptor is cut
    (gif(3)[:-4], 3, NOTHING),
    (riff((b"VP8 ", b"abc"), (b"EXIF", EXIF)), 1, SAID),
    (riff((b"ANIM", b"abc"), (b"ANMF", b"abc"), (b"ANMF", b"abcd"), (b"EXIF", tiff("big", TAGS))), 2, SAID),
]


@pytest.fixture(scope="module")
def pictures(spark):
    rows = [(k, c, "clash") for k, (c, _, _) in enumerate(CASES)] * 2
    return spark.createDataFrame([(k, bytearray(c) if c is not None else None, x) for k, c, x in rows], "id int, content binary, kind string")


def test_metadata(pictures):
    got = images.metadata(pictures, "content").collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        content, n, said = CASES[r.id]
        assert r.kind == "clash"
        if content is None:
            assert r.metadata is None
            continue
        m = r.metadata
        assert (m.page_count, (m.title, m.author, m.creation_date), m.file_size) == (n, said, len(content)), r.id


def test_frames(pictures):
    got = images.frames(pictures, "content").where("kind = 'clash'").collect()
    count = {}
    for r in got:
        count[r.id] = count.get(r.id, 0) + 1
        assert 0 <= r.start and r.start + r.n_bytes <= len(CASES[r.id][0]) + 4
    for k, (content, n, _) in enumerate(CASES):
        assert count.get(k, 0) == (0 if not content or content == b"words" else 2 * n), k
    assert images.frames(pictures, "content", 0).count() == 0
    assert images.frames(pictures, "content", 2).where("frame > 1").count() == 0
    assert images.frames(pictures, "content", 2).where("id = 18").count() == 4


def test_no_images(spark):
    none = spark.createDataFrame([], "id int, content binary")
    assert images.metadata(none, "content").count() == 0 and images.frames(none, "content").count() == 0


def test_walk_of_cut_and_random_bytes():
    noise = np.random.default_rng(1)
    for content in (c for c, _, _ in CASES if c):
        for end in range(len(content)):
            list(images.blocks(content[:end]))
        for _ in range(30):
            b = bytearray(content)
            for at in noise.integers(0, len(b), 4):
                b[at] = noise.integers(0, 256)
            list(images.blocks(bytes(b)))


def rasters():
    noise, out = np.random.default_rng(2), []
    for k, (w, h, b) in enumerate([(1, 1, 1), (5, 3, 3), (64, 64, 4), (130, 70, 3), (64, 65, 2), (200, 1, 1), (7, 300, 1), (1000, 200, 3)]):
        out.append((k, w, b, noise.integers(k, 256 - 9 * k, (h, w, b), dtype=np.uint8)))
    return out


def grey(p):
    if p.shape[-1] < 3:
        return p[..., 0].astype(float)
    return (p[..., 0] * 19595.0 + p[..., 1] * 38470.0 + p[..., 2] * 7471.0 + 32768) // 65536


@pytest.mark.parametrize("side", [16, 64, 4096])
def test_statistics(spark, side):
    made = rasters()
    rows = [(k, w, b, bytearray(p.tobytes()), "extra") for k, w, b, p in made]
    df = spark.createDataFrame(rows, "id int, w int, b int, samples binary, n_rows string")
    got = {r.id: r for r in pixels.merged(pixels.tiles(df, "samples", "w", "b", side), "id").collect()}
    assert len(got) == len(made)
    for k, w, b, p in made:
        r, g = got[k], grey(p)
        assert (r.n, r.lo, r.hi) == (g.size, p.reshape(-1, b).min(0).tolist(), p.reshape(-1, b).max(0).tolist())
        assert r["mean"] == pytest.approx(g.mean()) and r.variance == pytest.approx(g.var(), abs=1e-6)
        assert r.histogram == np.histogram(g, 16, (0, 256))[0].tolist()
    for r in pixels.tiles(df, "samples", "w", "b", side).collect():
        _, w, b, p = made[r.id]
        part = grey(p)[r.tile_y * side : (r.tile_y + 1) * side, r.tile_x * side : (r.tile_x + 1) * side]
        assert (r.n, r.total, r.squares) == (part.size, part.sum(), (part * part).sum())


def test_defined_edges(spark):
    rows = [(1, 4, 1, None), (2, 4, 1, bytearray()), (3, 0, 1, bytearray(b"abc")), (4, None, 1, bytearray(b"abc")), (5, 4, 5, bytearray(b"abc")), (6, 4, 3, bytearray(b"ab")),
            (7, 4, 3, bytearray(b"abcdefghijklmn")), (8, 2, 1, bytearray(b"abcde")), (8, 2, 1, bytearray(b"xyz"))]
    df = spark.createDataFrame(rows, "id int, w int, b int, samples binary")
    got = {r.id: (r.n, r.lo, r.hi) for r in pixels.merged(pixels.tiles(df, "samples", "w", "b"), "id").collect()}
    assert got == {7: (4, [97, 98, 99], [106, 107, 108]), 8: (8, [97], [122])}
    assert pixels.merged(pixels.tiles(df.limit(0), "samples", "w", "b"), "id").count() == 0


@pytest.mark.parametrize("w, h, mode, lo, hi, want", [
    (100, 100, "L", [0], [0], 1.0), (99, 100, "RGB", [0, 0, 0], [255, 255, 255], 0.5), (100, 100, "P", [3], [3], 0.8),
    (100, 100, "RGB", [0, 0, 0], [9, 10, 10], 0.7), (100, 100, "RGB", [0, 0, 0], [10, 10, 10], 1.0), (10, 10, "CMYK", [5, 5, 5, 0], [5, 5, 5, 255], 0.28), (100, 100, "RGB", None, None, 1.0),
])
def test_extrema_score(spark, w, h, mode, lo, hi, want):
    arrays = [F.array(*map(F.lit, x)) if x else F.lit(None).cast("array<int>") for x in (lo, hi)]
    got = spark.range(1).select(pixels.extrema_score(F.lit(w), F.lit(h), F.lit(mode), *arrays)).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("pixels_, original, mode, variance, want", [(100, 100, "RGB", 1000.0, 100.0), (50, 100, "L", 100.0, 44.0), (200, 100, "CMYK", None, 77.5), (5, 0, "RGB", 0.0, 50.0)])
def test_clarity_score(spark, pixels_, original, mode, variance, want):
    c = pixels.clarity_score(F.lit(pixels_), F.lit(original), F.lit(mode), F.lit(variance).cast("double"))
    assert spark.range(1).select(c).first()[0] == pytest.approx(want)


def test_short_texts_of_pictures(spark, tmp_path):
    """Entries of up to four bytes stand in the directory; null ids, empty texts and other letters are as in the SQL."""
    import duckdb

    from docloom import queries_images as q
    from docloom.queries import ORACLES

    texts, sources = ["", "a", "ab", "abc", "abcd", None, "é", "x\n\ny" * 99], ["web", "", None, "ü", "a longer source", "Zürich"]
    docs = [(k, texts[k // 4 % 8], sources[k % 6]) for k in range(96)] + [(None, "abc", "web"), (None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for query in (q.src_image_metadata, q.src_image_frames):
        found = sorted((tuple(r) for r in query(spark, str(tmp_path)).collect()), key=repr)
        assert found == sorted(con.execute(ORACLES[query.__name__]).fetchall(), key=repr)
