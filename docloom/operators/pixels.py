"""Statistics of stored samples: extrema, spread and histograms by tile, merged as partial aggregates, and scores on them.

A raster is bytes, row by row, ``bands`` samples a pixel (1: grey, 3: red, green, blue, 4: and alpha). Strips of rows
are cut in the JVM, so that what a Python batch holds depends on the tile and the width and not on the image's height;
an image's tiles are summed before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram of brightness, each of 256 / BINS values.
BINS = 16
#: Pixels of a tile's side.
SIDE = 256
#: Bands that a raster may have.
BANDS = 4

TILE = "tile_x int, n long, lo array<int>, hi array<int>, total long, squares long, histogram array<long>"


def brightness(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (..., bands) samples: weights of 16 bits, rounded; alpha does not count."""
    if pixels.shape[-1] < 3:
        return pixels[..., 0].astype(np.int64)
    red, green, blue = (pixels[..., k].astype(np.int64) for k in range(3))
    return (red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16


def _strip(samples: bytes, width: int, bands: int, side: int) -> list[dict]:
    """Statistics of a strip's tiles; the strip may end within a row."""
    p = np.frombuffer(samples, np.uint8)
    p = p[: len(p) // bands * bands].reshape(-1, bands)
    out = []
    at = np.arange(len(p)) % width // side
    for x in range(-(-min(width, len(p)) // side)):
        tile = p[at == x] if width > side else p
        grey = brightness(tile)
        out.append({
            "tile_x": x, "n": len(tile), "lo": tile.min(0).tolist(), "hi": tile.max(0).tolist(),
            "total": int(grey.sum()), "squares": int((grey * grey).sum()),
            "histogram": np.bincount(grey * BINS // 256, minlength=BINS).tolist(),
        })
    return out


def tiles(images: DataFrame, content: str, width: str, bands: str, side: int = SIDE) -> DataFrame:
    """A row for each tile: the images' other columns, tile_x, tile_y, n, lo and hi (a value a band), total, squares, histogram.

    Null and empty rasters, and such without a width or with other than 1 to 4 bands, have no tile. A last row may be
    shorter; samples short of a pixel do not count. Repeated rows repeat their tiles.
    """

    @F.pandas_udf(f"array<struct<{TILE.replace(' ', ':').replace(',:', ',')}>>")
    def statistics(samples: pd.Series, width: pd.Series, bands: pd.Series) -> pd.Series:
        return pd.Series([_strip(s, int(w), int(b), side) for s, w, b in zip(samples, width, bands)], dtype=object)

    w, b, data = F.col(width).cast("long"), F.col(bands).cast("int"), F.col(content)
    size = w * b * side
    usable = (F.octet_length(data) >= b) & (w > 0) & b.between(1, BANDS)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length(data) - 1) / size))
    cut = F.transform(starts, lambda k: data.substr((k * size + 1).cast("int"), size.cast("int")))
    keep = [c for c in images.columns if c not in (content, width, bands)]
    strips = images.where(usable).select(*keep, w.alias("__w"), b.alias("__b"), F.posexplode(cut).alias("tile_y", "__strip"))
    strips = strips.where(F.octet_length("__strip") >= F.col("__b"))
    found = strips.select(*keep, "tile_y", F.explode(statistics("__strip", "__w", "__b")).alias("__t"))
    return found.select(*keep, "tile_y", "__t.*")


def merged(found: DataFrame, *keys: str) -> DataFrame:
    """Tiles summed by keys (an image, a host, nothing): n, lo, hi, mean, variance, histogram.

    Sums are exact; a group of any size is summed in parts before the shuffle.
    """
    part = lambda c, k: F.get(c, F.lit(k))
    bands = F.max(F.size("lo"))
    sums = found.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.slice(F.array(*[F.min(part("lo", k)) for k in range(BANDS)]), F.lit(1), bands).alias("lo"),
        F.slice(F.array(*[F.max(part("hi", k)) for k in range(BANDS)]), F.lit(1), bands).alias("hi"),
        F.sum(F.col("total").cast("decimal(20,0)")).alias("__total"),
        F.sum(F.col("squares").cast("decimal(20,0)")).alias("__squares"),
        F.array(*[F.sum(part("histogram", k)) for k in range(BINS)]).alias("histogram"),
    )
    mean = F.col("__total").cast("double") / F.col("n")
    spread = F.col("__squares").cast("double") / F.col("n") - mean * mean
    return sums.select(*keys, "n", "lo", "hi", mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("variance"), "histogram")


def extrema_score(width: Column, height: Column, mode: Column, lo: Column, hi: Column) -> Column:
    """1, halved below 100 pixels a side, times 0.8 for unusual modes and 0.7 where three bands span under 10 on average.

    Grey images have no such span; without extrema it doesn't count.
    """
    span = sum((F.get(hi, F.lit(k)) - F.get(lo, F.lit(k)) for k in range(3)), F.lit(0)) / 3
    score = F.when((width < 100) | (height < 100), 0.5).otherwise(1.0)
    score = score * F.when(mode.isin("RGB", "RGBA", "L"), 1.0).otherwise(0.8)
    return score * F.when((F.size(lo) >= 3) & (span < 10), 0.7).otherwise(1.0)


def clarity_score(pixels: Column, original_pixels: Column, mode: Column, variance: Column) -> Column:
    """0 to 100: pixels kept (40 %), colour (30 %) and variance of brightness (30 %); an unknown variance counts as 75."""
    kept = F.when(original_pixels > 0, F.least(F.lit(100.0), pixels / original_pixels * 100)).otherwise(50.0)
    colour = F.when(mode == "RGB", 100).when(mode == "L", 70).otherwise(50)
    clear = F.when(variance.isNull(), 75.0).otherwise(F.least(F.lit(100.0), variance / 10))
    return F.round(kept * 0.4 + colour * 0.3 + clear * 0.3, 2)
