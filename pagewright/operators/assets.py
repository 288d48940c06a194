"""Image assets: grouping by content, rule scores, duplicates, and images for hits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import python_ready

#: Rules of the score: reason, points, condition over the features.
RULES = [
    ("too_small", -2, "width < 80 OR height < 80"),
    ("below_displayable_size", -5, "width < 100 OR height < 100"),
    ("low_pixel_area", -4, "width * height < 20000"),
    ("low_entropy", -2, "entropy < 2.0"),
    ("low_edge_density", -2, "edge_density < 0.01"),
    ("hollow_rectangle", -4, "blank_center AND strong_border"),
    ("border_dominant_edges", -3, "center_edge_density < 0.005 AND border_edge_density > greatest(center_edge_density * 5, 0.04)"),
    ("near_uniform_pixels", -2, "near_uniform_fraction >= 0.98"),
    ("few_components", -1, "component_count <= 2"),
    ("mostly_transparent", -1, "alpha_coverage < 0.08"),
    ("structured_edges", 1, "edge_density >= 0.04"),
    ("pixel_variation", 1, "entropy >= 3.0"),
    ("extreme_aspect_ratio", -1, "width / greatest(height, 1) > 8 OR height / greatest(width, 1) > 8"),
    ("icon_like_aspect_ratio", -4, "width / greatest(height, 1) > 6 OR height / greatest(width, 1) > 6"),
    ("sparse_symbolic_asset", -4, "near_uniform_fraction >= 0.9 AND component_count <= 4"),
]


def scored(features: DataFrame) -> DataFrame:
    """``features`` with quality_score, classification and reasons."""
    points = reduce(lambda a, b: a + b, [F.when(F.expr(c), p).otherwise(0) for _, p, c in RULES])
    why = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, _, c in RULES]))
    x = features.withColumn("quality_score", points).withColumn("reasons", why)
    return x.withColumn("classification", F.when(F.col("quality_score") >= 2, "valid").when(F.col("quality_score") >= 0, "uncertain").otherwise("reject"))


def demote(assets: DataFrame) -> DataFrame:
    """Small assets that occur three times or more are rejected (-4); of equal hashes all but the least id (-2).

    Assets without a hash (undecodable images) are nobody's duplicates.
    """
    small = (F.col("n_occurrences") >= 3) & (F.col("width") * F.col("height") < 50_000)
    keepers = assets.where("perceptual_hash IS NOT NULL").groupBy("perceptual_hash").agg(F.min("asset_id").alias("_keeper"))
    twin = F.coalesce(F.col("asset_id") != F.col("_keeper"), F.lit(False))
    x = assets.join(keepers, "perceptual_hash", "left").withColumn("duplicate_of", F.when(twin, F.col("_keeper")))
    x = x.withColumn("quality_score", F.col("quality_score") - F.when(small, 4).otherwise(0) - F.when(twin, 2).otherwise(0))
    x = x.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(F.when(small, F.lit("repeated_small_asset")), F.when(twin, F.lit("duplicate"))))))
    return x.withColumn("classification", F.when(small | twin, "reject").otherwise(F.col("classification"))).drop("_keeper")


def grouped(occurrences: DataFrame) -> DataFrame:
    """asset_id (SHA-256 of content), n_occurrences, occurrences: one row a content."""
    place = F.struct("document_id", "page", "source_file")
    return occurrences.groupBy(F.sha2("content", 256).alias("asset_id")).agg(F.array_sort(F.collect_set(place)).alias("occurrences")).withColumn("n_occurrences", F.size("occurrences"))


def manifest(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets that stay, as they are, and the rejected ones with ``occurrence_count`` in place of their ``occurrences``.

    The bytes (``content``) go with neither; an asset without a class stays, as nothing rejects it.
    """
    x = assets.drop("content")
    out = F.coalesce(F.col("classification") == "reject", F.lit(False))
    return x.where(~out), x.where(out).withColumn("occurrence_count", F.coalesce("n_occurrences", F.lit(0))).drop("occurrences", "n_occurrences")


def for_hits(assets: DataFrame, links: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, asset_id, document_title, page: one valid asset that a hit's chunk shows, the first by title, page and id.

    ``links``: asset_id, chunk_id, document_title, page.  An asset stands where it comes first by page and title.
    """
    valid = assets.where("classification = 'valid'").select("asset_id")
    shown = links.join(valid, "asset_id", "left_semi").join(hits.select("query_id", "chunk_id"), "chunk_id")
    found = shown.groupBy("query_id", "asset_id").agg(F.min(F.struct("page", "document_title")).alias("at")).select("query_id", "asset_id", "at.document_title", "at.page")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("document_title", "page", "asset_id"))).where("_n = 1").drop("_n")


def _shrunk(grey: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """``grey`` (whole levels) at another size: cubic filter widened by the scale, columns first, rounded after each pass."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        wide = max(scale, 1.0)
        x = np.abs((np.arange(old)[None] + 0.5 - (np.arange(new)[:, None] + 0.5) * scale) / wide)
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
        return w / w.sum(1, keepdims=True)

    def level(x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(x + 0.5), 0, 255)

    return level(weights(grey.shape[0], rows) @ level(grey @ weights(grey.shape[1], cols).T))


def _steps(x: np.ndarray) -> list[np.ndarray]:
    """Absolute differences of neighbours along each axis that has some."""
    return [np.abs(np.diff(x, axis=k)) for k in (1, 0) if x.shape[k] >= 2]


def _edges(x: np.ndarray) -> float:
    """The share of neighbours that differ by more than 20, as the mean of both axes."""
    shares = [float((d > 20).mean()) for d in _steps(x) if d.size]
    return sum(shares) / len(shares) if shares else 0.0


def _components(grid: np.ndarray) -> int:
    """Regions of true cells that touch, corners included: each cell takes the least label around it until none changes."""
    label = np.where(grid, np.arange(1, grid.size + 1).reshape(grid.shape), 0)
    far = grid.size + 1
    while True:
        padded = np.pad(np.where(grid, label, far), 1, constant_values=far)
        least = np.min([padded[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3)], axis=0)
        least = np.where(grid, least, 0)
        if np.array_equal(least, label):
            return len(np.unique(label[grid]))
        label = least


def _image_features(height: int, width: int, channels: int, data: bytes) -> tuple:
    px = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels).astype(np.int64)
    alpha = float((px[:, :, 3] > 5).mean()) if channels == 4 else 1.0
    # Spark's images are blue, green, red
    grey = ((px[:, :, 2] * 19595 + px[:, :, 1] * 38470 + px[:, :, 0] * 7471 + 0x8000) >> 16 if channels >= 3 else px[:, :, 0]).astype(float)
    share = np.bincount(grey.astype(int).ravel(), minlength=256) / grey.size
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    m = max(1, int(min(width, height) * 0.1))
    center = grey[m : height - m, m : width - m] if height > 2 * m and width > 2 * m else grey
    strips = [grey[:m], grey[-m:], grey[:, :m], grey[:, -m:]]
    rim = np.concatenate([x.ravel() for x in strips])
    slope = float(np.concatenate([d.ravel() for d in _steps(center)] or [np.zeros(1)]).mean())
    rim_slope = float(np.abs(np.diff(rim)).mean()) if rim.size > 1 else 0.0
    small = _shrunk(grey, 64, 64)
    grid = np.zeros((64, 64), bool)
    across, down = _steps(small)
    grid[:, 1:] |= across > 20
    grid[1:] |= down > 20
    tiny = _shrunk(grey, 8, 9)
    bits = "".join("1" if b else "0" for b in (tiny[:, 1:] > tiny[:, :-1]).ravel())
    return (
        entropy, _edges(grey), max(map(_edges, strips)), _edges(center), float((np.abs(grey - np.median(grey)) <= 3).mean()), _components(grid), alpha, f"{int(bits, 2):016x}",
        bool(center.std() < 8 and slope < 3), bool(rim_slope > max(slope * 2.5, 8)),
    )


FEATURES = ["entropy", "edge_density", "border_edge_density", "center_edge_density", "near_uniform_fraction", "component_count", "alpha_coverage", "perceptual_hash", "blank_center", "strong_border"]


def pixel_features(images: DataFrame, mode: str = "data") -> DataFrame:
    """Features of decoded images (Spark's ``image`` source: height, width, nChannels, data), in Arrow batches.

    Entropy and edges of the grey levels, of their border (a tenth of the shorter side) and centre, levels
    within 3 of the median, edge regions of a 64 x 64 copy, opaque share, and the difference hash of a 9 x 8
    copy.  Null data or an empty image gives null features.
    """
    python_ready(images.sparkSession)
    kinds = [pa.float64()] * 5 + [pa.int32(), pa.float64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches):
        for b in batches:
            made = []
            for h, w, c, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                made.append(_image_features(h, w, c, data) if data and h and w and c and h > 0 and w > 0 else (None,) * len(FEATURES))
            columns = [pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), *columns], names=["asset_id", "width", "height", *FEATURES])

    schema = "asset_id string, width int, height int, entropy double, edge_density double, border_edge_density double, center_edge_density double, near_uniform_fraction double, component_count int, alpha_coverage double, perceptual_hash string, blank_center boolean, strong_border boolean"
    return images.select(F.col("asset_id").cast("string").alias("asset_id"), "height", "width", "nChannels", mode).mapInArrow(run, schema)


def placed(occurrences: DataFrame, placements: DataFrame) -> DataFrame:
    """``occurrences`` (document_id, page, asset_id) with ``boxes``: the sorted places of the asset on the page, to two places, empty if none is known."""
    box = F.struct(*[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    boxes = placements.groupBy("document_id", "page", "asset_id").agg(F.array_sort(F.collect_set(box)).alias("boxes"))
    return occurrences.join(boxes, ["document_id", "page", "asset_id"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


def chunk_links(occurrences: DataFrame, chunks: DataFrame) -> DataFrame:
    """asset_id, chunk_id, page: the chunks of each page that shows an asset. ``chunks``: document_id, pages, chunk_id."""
    on_page = chunks.select("document_id", F.explode("pages").alias("page"), "chunk_id").distinct()
    links = occurrences.select("asset_id", "document_id", "page").distinct().join(on_page, ["document_id", "page"]).select("asset_id", "chunk_id", "page")
    # only a chunk of several documents can have a link twice; else the links, which are many more than the chunks, need no second pass
    several = chunks.groupBy("chunk_id").agg(F.countDistinct("document_id").alias("n")).where("n > 1")
    return links if several.isEmpty() else links.distinct()
