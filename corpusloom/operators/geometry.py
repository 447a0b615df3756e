"""Coordinates and small rasters. Stand-ins: part for positions, embeddings (64 values) for images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialog import query, table

#: Means and deviations of the channels (fixed values).
RGB_MEAN = (60.134, 49.697, 40.746)
RGB_STD = (29.99, 24.498, 22.046)


def minmax(value: Column, low: float, high: float) -> Column:
    return (value - low) / (high - low)


@query("geo_minmax", "SELECT p_partkey, round((p_size % 181 - 90.0::DOUBLE + 90) / 180, 6) AS lat, round((p_partkey % 361 - 180.0::DOUBLE + 180) / 360, 6) AS lon FROM part")
def geo_minmax(spark, sf_dir):
    lat, lon = F.col("p_size") % 181 - 90.0, F.col("p_partkey") % 361 - 180.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(minmax(lat, -90, 90), 6).alias("lat"), F.round(minmax(lon, -180, 180), 6).alias("lon"))


def pixel(gps: Column, bottom_left: Column, top_right: Column, lat_ratio: Column, lng_ratio: Column) -> Column:
    """(x, y) of a position [lng, lat] in its map's image; halves are rounded to even."""
    return F.struct(F.bround((gps[1] - bottom_left[1]) / lat_ratio).alias("x"), F.bround((top_right[0] - gps[0]) / lng_ratio).alias("y"))


def extent(bottom_left: Column, top_right: Column, lat_ratio: Column, lng_ratio: Column) -> tuple[Column, Column]:
    """Width (of index 0) and height (of index 1) that positions are divided by."""
    return (top_right[0] - bottom_left[0]) / lng_ratio, (top_right[1] - bottom_left[1]) / lat_ratio


def maps(spark, sf_dir) -> DataFrame:
    """A map frame with ratios of its own, and two corners, of each row."""
    k, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    frame = {"bl": F.array(k % 5, s % 3), "tr": F.array(k % 5 + 8, s % 3 + 6), "lat_ratio": 0.25 * (1 + s % 2), "lng_ratio": 0.5 * (1 + k % 2)}
    corners = F.array(F.array(k % 5 + s % 7 / 2, s % 3 + k % 9 / 4), F.array(k % 5 + 1, s % 3 + 2))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in frame.items()), corners.alias("corners"))


_X = "(p_partkey % 5)::DOUBLE AS bx, (p_size % 3)::DOUBLE AS by_, 0.25::DOUBLE * (1 + p_size % 2) AS lat_ratio, 0.5::DOUBLE * (1 + p_partkey % 2) AS lng_ratio, p_partkey % 5 + p_size % 7 / 2.0::DOUBLE AS gx, p_size % 3 + p_partkey % 9 / 4.0::DOUBLE AS gy"


@query("gps_to_pixel_frames", f"SELECT p_partkey, round_even((gy - by_) / lat_ratio, 0)::DOUBLE AS x, round_even((bx + 8 - gx) / lng_ratio, 0)::DOUBLE AS y FROM (SELECT p_partkey, {_X} FROM part)")
def gps_to_pixel_frames(spark, sf_dir):
    """Pixels of each row's first corner in its own frame."""
    m = maps(spark, sf_dir).select("p_partkey", pixel(F.col("corners")[0], F.col("bl"), F.col("tr"), F.col("lat_ratio"), F.col("lng_ratio")).alias("p"))
    return m.select("p_partkey", "p.x", "p.y")


@query("coords_normalize", f"SELECT p_partkey, round(round_even((gy - by_) / lat_ratio, 0) / (8 / lng_ratio), 6)::DOUBLE AS x0, round(round_even((bx + 8 - gx) / lng_ratio, 0) / (6 / lat_ratio), 6)::DOUBLE AS y0, round(round_even(2 / lat_ratio, 0) / (8 / lng_ratio), 6)::DOUBLE AS x1, round(round_even(7 / lng_ratio, 0) / (6 / lat_ratio), 6)::DOUBLE AS y1 FROM (SELECT p_partkey, {_X} FROM part)")
def coords_normalize(spark, sf_dir):
    """Corner lists as shares of the image's extent (whose axes are swapped against the pixels', as in the contract)."""
    w, h = extent(F.col("bl"), F.col("tr"), F.col("lat_ratio"), F.col("lng_ratio"))
    x = maps(spark, sf_dir).withColumns({"w": w, "h": h})
    scaled = F.transform("corners", lambda c: pixel(c, F.col("bl"), F.col("tr"), F.col("lat_ratio"), F.col("lng_ratio")))
    x = x.withColumn("n", F.transform(scaled, lambda p: F.struct((p["x"] / F.col("w")).alias("x"), (p["y"] / F.col("h")).alias("y"))))
    return x.select("p_partkey", *(F.round(F.col("n")[i][a], 6).alias(f"{a}{i}") for i in (0, 1) for a in "xy"))


def standardize(image: Column, channels: int = 3) -> Column:
    """An image in rows of pixels (HWC) as standardized planes (CHW)."""
    n = F.floor(F.size(image) / channels).cast("int")
    mean, std = (F.array(*[F.lit(v) for v in t]) for t in (RGB_MEAN, RGB_STD))
    plane = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get(image, i * channels + c) - F.get(mean, c)) / F.get(std, c))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), plane))


IMAGE = "list_transform(embedding[1:48], lambda v: 100 + 50 * v::DOUBLE)"


def images(spark, sf_dir) -> DataFrame:
    """4 x 4 pixels of three channels."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 48), lambda v: 100 + 50 * v.cast("double")).alias("image"))


@query("pixel_standardize", f"SELECT vec_id, round((im[1] - 60.134) / 29.99, 6) AS first, round((im[3 * 15 + 3] - 40.746) / 22.046, 6) AS last, round(list_sum(list_transform(range(16), lambda i: (im[3 * i + 2] - 49.697) / 24.498)), 6) AS second_plane FROM (SELECT vec_id, {IMAGE} AS im FROM embeddings)")
def pixel_standardize(spark, sf_dir):
    x = images(spark, sf_dir).select("vec_id", standardize(F.col("image")).alias("p"))
    total = F.aggregate(F.slice("p", 17, 16), F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[47], 6).alias("last"), F.round(total, 6).alias("second_plane"))


def augment(planes: Column, draws: dict[str, Column], noise, channels: int = 3) -> Column:
    """Brightness, contrast about each channel's mean and noise, each with probability a half, all gated by one draw.

    draws: uniform draws gate, brightness_on, brightness, contrast_on, contrast, noise_on; noise(i): normal draw of place i."""
    n = F.floor(F.size(planes) / channels).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    between = lambda u: 0.8 + 0.4 * u
    bright = F.transform(planes, lambda v: v * F.when(draws["brightness_on"] > 0.5, between(draws["brightness"])).otherwise(1.0))

    def contrast(p: Column) -> Column:
        means = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: total(F.slice(p, c * n + 1, n)) / n)
        factor = F.when(draws["contrast_on"] > 0.5, between(draws["contrast"])).otherwise(1.0)
        return F.transform(F.array(F.struct(p.alias("p"), means.alias("m"))), lambda s: F.transform(s["p"], lambda v, i: (v - F.get(s["m"], F.floor(i / n).cast("int"))) * factor + F.get(s["m"], F.floor(i / n).cast("int"))))[0]

    changed = F.transform(F.array(bright), contrast)[0]
    noisy = F.transform(changed, lambda v, i: v + F.when(draws["noise_on"] > 0.5, 0.02 * noise(i)).otherwise(0.0))
    return F.when(draws["gate"] > 0.5, planes).otherwise(noisy)


def _draw(k: int) -> Column:
    """A uniform draw that any engine can repeat; a pipeline takes rand(seed) instead."""
    return (F.col("vec_id") * k + 7 * k) % 101 / 101.0


@query("visual_augment", f"""WITH p AS (SELECT vec_id, [((vec_id * k + 7 * k) % 101) / 101.0::DOUBLE FOR k IN [3, 11, 17, 23, 31, 43]] AS u, list_transform(range(48), lambda j: ({IMAGE}[3 * (j % 16) + j // 16 + 1] - {list(RGB_MEAN)}[j // 16 + 1]::DOUBLE) / {list(RGB_STD)}[j // 16 + 1]::DOUBLE) AS a FROM embeddings),
 b AS (SELECT *, list_transform(a, lambda v: v * CASE WHEN u[2] > 0.5 THEN 0.8 + 0.4 * u[3] ELSE 1 END) AS b FROM p),
 c AS (SELECT *, [list_avg(b[1:16]), list_avg(b[17:32]), list_avg(b[33:48])] AS m FROM b),
 d AS (SELECT *, list_transform(range(48), lambda j: (b[j + 1] - m[j // 16 + 1]) * CASE WHEN u[4] > 0.5 THEN 0.8 + 0.4 * u[5] ELSE 1 END + m[j // 16 + 1] + CASE WHEN u[6] > 0.5 THEN 0.02 * (sqrt(-2 * ln(((vec_id * 31 + j * 17) % 997 + 1) / 998.0::DOUBLE)) * cos(2 * pi() * ((vec_id * 13 + j * 29) % 991) / 991.0::DOUBLE)) ELSE 0 END) AS d FROM c)
 SELECT vec_id, round(CASE WHEN u[1] > 0.5 THEN a[1] ELSE d[1] END, 5) AS first, round(list_sum(CASE WHEN u[1] > 0.5 THEN a ELSE d END), 5) AS total FROM d""")
def visual_augment(spark, sf_dir):
    names = ("gate", "brightness_on", "brightness", "contrast_on", "contrast", "noise_on")
    draws = dict(zip(names, map(_draw, (3, 11, 17, 23, 31, 43)), strict=True))
    normal = lambda i: F.sqrt(-2 * F.log(((F.col("vec_id") * 31 + i * 17) % 997 + 1) / 998.0)) * F.cos(2 * F.pi() * ((F.col("vec_id") * 13 + i * 29) % 991) / 991.0)
    x = images(spark, sf_dir).select("vec_id", standardize(F.col("image")).alias("p")).select("vec_id", augment(F.col("p"), draws, normal).alias("p"))
    return x.select("vec_id", F.round(F.col("p")[0], 5).alias("first"), F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


def average_pool(image: Column, size: int, out: int) -> Column:
    """A square plane of size x size averaged to out x out (which divides it), row by row."""
    step = size // out
    cell = lambda r, c: sum(image[(r * step + i) * size + c * step + j] for i in range(step) for j in range(step)) / (step * step)
    return F.array(*[cell(r, c) for r in range(out) for c in range(out)])


def unit(values: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)) + eps
    return F.transform(values, lambda v: v / norm)


@query("visual_feature", "WITH p AS (SELECT vec_id, list_transform(range(16), lambda k: (e[(k // 4) * 16 + (k % 4) * 2 + 1] + e[(k // 4) * 16 + (k % 4) * 2 + 2] + e[(k // 4) * 16 + (k % 4) * 2 + 9] + e[(k // 4) * 16 + (k % 4) * 2 + 10]) / 4) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) SELECT vec_id, round(p[1] / (sqrt(list_inner_product(p, p)) + 1e-8), 6) AS first, round(p[16] / (sqrt(list_inner_product(p, p)) + 1e-8), 6) AS last FROM p")
def visual_feature(spark, sf_dir):
    """Pooled, flattened and brought to length one."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", unit(average_pool(F.transform("embedding", lambda v: v.cast("double")), 8, 4)).alias("f"))
    return x.select("vec_id", F.round(F.col("f")[0], 6).alias("first"), F.round(F.col("f")[15], 6).alias("last"))


def perspective(corners: np.ndarray, height: int, width: int) -> np.ndarray:
    """The 3 x 3 matrix that takes the pixels of an upright height x width view to the four corners (x, y) of its place in
    a map, in the order top left, top right, bottom right, bottom left."""
    view = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    a, b = [], []
    for (u, v), (x, y) in zip(view, corners, strict=True):
        a += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        b += [x, y]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1).reshape(3, 3)


def warp(image: np.ndarray, corners: np.ndarray, height: int, width: int) -> np.ndarray:
    """The view of a map (H x W or H x W x C) at the corners: bilinear, the border repeated outside."""
    v, u = np.mgrid[0:height, 0:width]
    x, y, z = np.einsum("ij,jhw->ihw", perspective(corners, height, width), np.stack([u, v, np.ones_like(u)]).astype(float))
    x, y = np.clip(x / z, 0, image.shape[1] - 1), np.clip(y / z, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def extract_views(rows: DataFrame, images_: DataFrame, height: int, width: int, key: str = "key", salts: int = 8) -> DataFrame:
    """key and view (flat) of each row; rows: key, map_name, corners (four pairs); images_: map_name, h, w, pixels.

    A map's image is read once for each part of its rows: rows of one map are dealt to `salts` parts, so that a map with
    very many rows isn't one task's. Maps stream through a task in order, each before its rows, without a call for each."""
    dealt = rows.select(key, "map_name", "corners", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"))
    spread = images_.join(dealt.select("map_name", F.col("salt").alias("part")).distinct(), "map_name").withColumnRenamed("part", "salt")  # once for each part that has rows
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    image = spread.select("map_name", "salt", F.lit(0).alias("order"), "h", "w", F.transform("pixels", lambda v: v.cast("double")).alias("pixels"), none(rows, key), none(rows, "corners"))
    mine = dealt.select("map_name", "salt", F.lit(1).alias("order"), F.lit(None).cast(spread.schema["h"].dataType).alias("h"), F.lit(None).cast(spread.schema["w"].dataType).alias("w"), F.lit(None).cast("array<double>").alias("pixels"), key, "corners")
    both = image.unionByName(mine).where("map_name is not null").repartition("map_name", "salt").sortWithinPartitions("map_name", "salt", "order")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        at, plane = None, None
        for b in batches:
            names, salted, order, heights, widths, keys = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("map_name", "salt", "order", "h", "w", key))
            pixels, corners = b.column(b.schema.get_field_index("pixels")), b.column(b.schema.get_field_index("corners"))
            found: tuple[list, list] = ([], [])
            for i in range(b.num_rows):
                if not order[i] and at != (names[i], salted[i]):
                    at, plane = (names[i], salted[i]), np.asarray(pixels[i].values, float).reshape(heights[i], widths[i])
                elif order[i] and at == (names[i], salted[i]):
                    found[0].append(keys[i])
                    found[1].append(warp(plane, np.array(corners[i].as_py(), float), height, width).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], b.schema.field(key).type), pa.array(found[1], pa.list_(pa.float64()))], names=[key, "view"])

    return both.mapInArrow(run, f"`{key}` {kind}, view array<double>")


@query("view_extraction", "WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings) SELECT p_partkey, round(e[(p_size % 3) * 8 + p_partkey % 4 + 1], 6) AS top_left, round(e[(p_size % 3 + 3) * 8 + p_partkey % 4 + 4], 6) AS bottom_right FROM part JOIN m ON vec_id = p_partkey % n")
def view_extraction(spark, sf_dir):
    """4 x 4 views of maps of 8 x 8 pixels at whole places, where the warp takes the pixels as they are."""
    x, y = (F.col("p_partkey") % 4).cast("double"), (F.col("p_size") % 3).cast("double")
    corners = F.array(F.array(x, y), F.array(x + 3, y), F.array(x + 3, y + 3), F.array(x, y + 3))
    n = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")))
    rows = table(spark, sf_dir, "part").crossJoin(n).select("p_partkey", (F.col("p_partkey") % F.col("n")).alias("map_name"), corners.alias("corners"))
    pictures = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_name"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    views = extract_views(rows, pictures, 4, 4, "p_partkey")
    return views.select("p_partkey", F.round(F.col("view")[0], 6).alias("top_left"), F.round(F.col("view")[15], 6).alias("bottom_right"))
