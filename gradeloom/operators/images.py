"""Lines of writing on page images: ink threshold, skew and bands, from the pixels of a page."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeloom.session import prepare

# Slopes tried, margin left out, gap within a line, least height of a band, and the gain a slope must bring.
SLOPES = (-0.06, -0.045, -0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03, 0.045, 0.06)
EDGE_MARGIN, GAP_RATIO, LEAST_HEIGHT, GAIN = 0.015, 0.3, 0.006, 1.002
LEAST_INK, FLOOR_RATIO = 100, 0.3
SKEWS = [round(math.degrees(math.atan(s)), 1) for s in SLOPES]
#: Pixels of pages measured at once, and bands sent at once; they bound memory and change no result.
PAGE_BLOCK, OUT_ROWS = 500_000, 20_000

Bands = tuple[int, float, list[tuple[float, float, float, float, int]]]


def otsu_threshold(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the grey value that parts dark from light best; ties to the lowest.

    histogram: keys, value (0..255), n. Running sums over at most 256 rows a key.
    """
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    n, weighted = F.col("n").cast("double"), F.col("n") * F.col("value").cast("double")
    sums = histogram.where("n > 0").select(*keys, "value", F.sum(n).over(upto).alias("wb"), F.sum(weighted).over(upto).alias("sb"), F.sum(n).over(whole).alias("w"), F.sum(weighted).over(whole).alias("s"))
    front = F.col("w") - F.col("wb")
    spread = F.col("wb") * front * F.pow(F.col("sb") / F.col("wb") - F.try_divide(F.col("s") - F.col("sb"), front), F.lit(2.0))
    scored = sums.select(*keys, "value", F.when(front > 0, spread).alias("spread"))
    return scored.groupBy(*keys).agg(F.coalesce(F.max_by("value", F.when(F.col("spread").isNotNull(), F.struct(F.round("spread", 6).alias("s"), (-F.col("value")).alias("v")))), F.lit(0)).alias("threshold"))


def thresholds_of(histograms: np.ndarray) -> np.ndarray:
    """Plain form of otsu_threshold, for rows of 256 counts each."""
    counts = histograms.astype(float)
    back = np.cumsum(counts, axis=1)
    moment = np.cumsum(counts * np.arange(256), axis=1)
    front, rest = back[:, -1:] - back, moment[:, -1:] - moment
    ok = (back > 0) & (front > 0)
    means = np.where(ok, moment / np.maximum(back, 1), 0) - np.where(ok, rest / np.maximum(front, 1), 0)
    return np.where(ok.any(axis=1), np.argmax(np.where(ok, back * front * means**2, -1), axis=1), 0)


def threshold_of(histogram: np.ndarray) -> int:
    """thresholds_of for one histogram."""
    return int(thresholds_of(histogram[None])[0])


def upper_median(values: list[int]) -> float:
    """The middle of the sorted values, the upper one of two; 0 for none."""
    return float(sorted(values)[len(values) // 2]) if values else 0.0


def grey_of(rgba: np.ndarray) -> np.ndarray:
    """The grey value (0..255) of each pixel."""
    r, g, b = (rgba[..., k].astype(np.uint32) for k in range(3))
    return ((r * np.uint32(299) + g * np.uint32(587) + b * np.uint32(114)) // np.uint32(1000)).astype(np.int64)


def find_bands(rgba: np.ndarray) -> Bands:
    """bands_of_pages for one page."""
    return bands_of_pages(rgba[None])[0]


def bands_of_pages(rgba: np.ndarray) -> list[Bands]:
    """(threshold, skew in degrees, bands) of each of some pages of one size; a band is (top, bottom, left, right) in fractions of the page, and its ink.

    A page is sheared to where its rows of ink are most peaked; rows with
    enough ink form runs, runs with a small gap form bands. Bands are reported
    where the ink lies. Pages don't influence each other.
    """
    n, height, width = rgba.shape[:3]
    x0, x1 = math.floor(width * EDGE_MARGIN), math.ceil(width * (1 - EDGE_MARGIN))
    y0, y1 = math.floor(height * EDGE_MARGIN), math.ceil(height * (1 - EDGE_MARGIN))
    inner = rgba[:, y0:y1, x0:x1]
    # Margins and the gaps between lines have one colour: such rows count by their first pixel.
    packed = np.ascontiguousarray(rgba).view(np.uint32)[:, y0:y1, x0:x1, 0]
    plain = (packed == packed[:, :, :1]).all(axis=2)
    own, mixed = np.nonzero(~plain)
    first, grey = grey_of(inner[:, :, 0]), grey_of(inner[own, mixed])
    page = 256 * np.arange(n)[:, None]
    counted = np.bincount((page[own] + grey).ravel(), minlength=256 * n) + (x1 - x0) * np.bincount((page + first)[plain], minlength=256 * n)
    thresholds = thresholds_of(counted.reshape(n, 256))
    full, full_y = np.nonzero(plain & (first <= thresholds[:, None]))
    own, inked = np.concatenate([own, full]), np.concatenate([mixed, full_y]) + y0
    is_ink = np.ones((len(own), x1 - x0), dtype=bool)
    np.less_equal(grey, thresholds[own[: len(mixed)]][:, None], out=is_ink[: len(mixed)])

    # The profiles of all slopes in one count: a row for each page and slope, with room for what is sheared off the page.
    # A slope shifts runs of columns by one amount, so the ink of a run counts at once.
    shift = np.floor(np.outer(SLOPES, np.arange(x0, x1) - (x0 + x1) / 2) + 0.5).astype(np.int64)
    room = int(np.abs(shift).max())
    span = height + 2 * room
    slope, left = np.nonzero(np.diff(shift, axis=1, prepend=shift[:, :1] - 1))
    right = np.append(left[1:], 0)
    right[right == 0] = x1 - x0
    upto = np.zeros((len(own), x1 - x0 + 1), dtype=np.int32)
    np.cumsum(is_ink, axis=1, out=upto[:, 1:])
    place = (own * (len(SLOPES) * span) + inked)[:, None] + (slope * span + room - shift[slope, left])
    counts = np.bincount(place.ravel(), (upto[:, right] - upto[:, left]).ravel(), minlength=n * len(SLOPES) * span)
    profiles = counts.reshape(n, len(SLOPES), span)[:, :, room : room + height]
    scores = np.einsum("nsy,nsy->ns", profiles, profiles)
    chosen, best = np.zeros(n, dtype=np.int64), np.full(n, -1.0)
    for k in range(len(SLOPES)):
        better = scores[:, k] > best * GAIN
        chosen[better], best[better] = k, scores[better, k]
    chosen[np.bincount(own, upto[:, -1], minlength=n) < LEAST_INK] = SLOPES.index(0.0)

    window = profiles[np.arange(n), chosen, y0:y1]
    some = (window > 0).sum(axis=1)
    middle = np.sort(window, axis=1)[np.arange(n), np.minimum(y1 - y0 - some + some // 2, y1 - y0 - 1)]
    enough = np.zeros((n, y1 - y0 + 2), dtype=np.int8)
    enough[:, 1:-1] = window >= np.maximum(2.0, middle * FLOOR_RATIO)[:, None]
    steps = np.diff(enough, axis=1)
    run_page, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1] + y0 - 1
    runs: list[list[list[int]]] = [[] for _ in range(n)]
    for k, a, b in zip(run_page.tolist(), (starts + y0).tolist(), ends.tolist()):
        runs[k].append([a, b])
    band_at = np.full((n, height), -1)
    band_page = []
    for k, mine in enumerate(runs):
        usual = upper_median([b - a + 1 for a, b in mine]) or max(1.0, height * 0.02)
        merged: list[list[int]] = []
        for a, b in mine:
            if merged and a - merged[-1][1] - 1 <= max(1.0, usual * GAP_RATIO):
                merged[-1][1] = b
            else:
                merged.append([a, b])
        for top, bottom in merged:
            if bottom - top + 1 >= max(1.0, height * LEAST_HEIGHT):
                band_at[k, top : bottom + 1] = len(band_page)
                band_page.append(k)

    # Every band has ink, as its rows have enough of it.
    at, xs = np.nonzero(is_ink)
    own, ys = own[at], inked[at]
    rows = ys - shift[chosen[own], xs]
    on = (rows >= 0) & (rows < height)
    band = np.where(on, band_at[own, np.where(on, rows, 0)], -1)
    order = np.argsort(band, kind="stable")
    order = order[len(order) - int((band >= 0).sum()) :]
    found: list[list[tuple[float, float, float, float, int]]] = [[] for _ in range(n)]
    if len(order):
        ink = np.bincount(band[order])
        first_of = np.cumsum(ink) - ink
        bx, by = xs[order] + x0, ys[order]
        edges = (np.minimum.reduceat(by, first_of) / height, (np.maximum.reduceat(by, first_of) + 1) / height, np.minimum.reduceat(bx, first_of) / width, (np.maximum.reduceat(bx, first_of) + 1) / width, ink)
        for k, b in zip(band_page, zip(*(e.tolist() for e in edges))):
            found[k].append(b)
    return [(t, SKEWS[c], b) for t, c, b in zip(thresholds.tolist(), chosen.tolist(), found)]


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The pages in the columns width, height and pixels (RGBA bytes) of a batch; None where the bytes do not fit the size."""
    for width, height, pixels in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("pixels")):
        held = pixels.as_buffer() if width and height else None
        fits = held is not None and held.size == width * height * 4
        yield np.frombuffer(held, dtype=np.uint8).reshape(height, width, 4) if fits else None


def page_bands(images: DataFrame, read: Callable[[pa.RecordBatch], Iterator[np.ndarray | None]] = unpacked) -> DataFrame:
    """doc_id, page, threshold, skew, band, top, bottom, left, right, ink: the bands of each page image.

    images: doc_id, page, width, height, pixels (RGBA bytes). An image whose
    bytes do not fit its size has no bands. Where pages are yet to be decoded or
    drawn, read yields them from the columns of a batch, one after another: so a
    task holds few pages as pixels, and none are sent between Spark and Python.
    """
    prepare(images.sparkSession)
    keys = images.select("doc_id", "page").schema
    schema = StructType(keys.fields + StructType.fromDDL("threshold int, skew double, band int, top double, bottom double, left double, right double, ink bigint").fields)
    target = to_arrow_schema(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for pages in blocks(enumerate(read(batch))):
                for (at, _), (threshold, skew, bands) in zip(pages, bands_of_pages(np.stack([rgba for _, rgba in pages]))):
                    held += [(at, threshold, skew, band, *b) for band, b in enumerate(bands)]
                if len(held) >= OUT_ROWS:
                    yield pack(batch, held)
                    held = []
            if held:
                yield pack(batch, held)

    def blocks(pages: Iterator[tuple[int, np.ndarray | None]]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Pages that follow each other and have one size, as many as PAGE_BLOCK allows, one at least."""
        held: list[tuple[int, np.ndarray]] = []
        for at, rgba in pages:
            if rgba is None:
                continue
            if held and (rgba.shape != held[0][1].shape or (len(held) + 1) * rgba.size > 4 * PAGE_BLOCK):
                yield held
                held = []
            held.append((at, rgba))
        if held:
            yield held

    def pack(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        at, *values = zip(*held)
        columns = [batch.column(k.name).take(pa.array(at)) for k in keys] + [pa.array(v) for v in values]
        return pa.RecordBatch.from_arrays([c.cast(field.type) for c, field in zip(columns, target)], schema=target)

    return images.mapInArrow(measure, schema)
