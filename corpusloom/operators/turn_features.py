"""Whole-turn features: views of maps, dialog context, tokens and contrastive texts of every turn, in one row.

Views are cut from tiles of maps, so no task holds a map. A view's pixels are dealt to the tiles that they fall on; the rows
of a tile are dealt to as many parts as their count asks for, each part meets the tile once, tiles and the rows after them
stream through the tasks, and the pixels of a view are put together again by a shuffle on the view. Destinations are cut once an episode.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..plans.scratch import written
from . import curation, geometry
from .dialog import query, table

#: Rows of a tile that one task takes.
PER_TILE = 32


def tiles(maps: DataFrame, size: int = 256) -> DataFrame:
    """map_name, h, w, ty, tx and pixels of each tile: size x size pixels and one more row and column where the map goes on.

    maps: map_name, h, w, channels and pixels (rows of pixels of channels), one row a map."""

    def work(batches):
        for b in batches:
            for r in range(b.num_rows):
                name, h, w, c = (b.column(i)[r].as_py() for i in range(4))
                image = np.asarray(b.column(4)[r].values).reshape(h, w, c)
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        piece = image[y : y + size + 1, x : x + size + 1]
                        cols = (name, h, w, c, y // size, x // size, piece.shape[0], piece.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array([cols[0]], b.schema.field(0).type), *(pa.array([v], pa.int32()) for v in cols[1:]), pa.array([piece.ravel()], pa.list_(pa.float64()))], names=["map_name", "h", "w", "channels", "ty", "tx", "th", "tw", "pixels"])

    kind = maps.schema["map_name"].dataType.simpleString()
    x = maps.select("map_name", F.col("h").cast("int"), F.col("w").cast("int"), F.col("channels").cast("int"), F.transform("pixels", lambda v: v.cast("double")).alias("pixels"))
    return x.mapInArrow(work, f"map_name {kind}, h int, w int, channels int, ty int, tx int, th int, tw int, pixels array<double>")


def places(corners: np.ndarray, height: int, width: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where in an h x w map each pixel of the view lies (y and x, flat, the border repeated); None if the corners span no area."""
    try:
        m = geometry.perspective(corners, height, width)
    except np.linalg.LinAlgError:
        return None
    v, u = np.mgrid[0:height, 0:width]
    x, y, z = np.einsum("ij,jn->in", m, np.stack([u.ravel(), v.ravel(), np.ones(u.size)]).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = np.nan_to_num(x / z), np.nan_to_num(y / z)
    return np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)


def sampled(piece: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places inside a piece."""
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, piece.shape[0] - 1), np.minimum(x0 + 1, piece.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[:, None]
    return (piece[y0, x0] * (1 - fx) + piece[y0, x1] * fx) * (1 - fy) + (piece[y1, x0] * (1 - fx) + piece[y1, x1] * fx) * fy


def _corners(value) -> np.ndarray:
    return np.array([list(p) for p in value], float)


def touched(views: DataFrame, sizes: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """A row for each view and tile that some of its pixels lie on. sizes: map_name, h, w; views: view, map_name, corners."""

    def work(batches):
        for b in batches:
            rows: list[tuple] = []
            for view, name, corners, h, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = places(_corners(corners), height, width, h, w)
                if at is not None:
                    found = np.unique(np.stack([at[0] // size, at[1] // size]).astype(int), axis=1)
                    rows += [(view, name, corners, int(ty), int(tx)) for ty, tx in found.T]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (b.schema.field(0).type, b.schema.field(1).type, b.schema.field(2).type, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["view", "map_name", "corners", "ty", "tx"])

    joined = views.join(sizes, "map_name").select("view", "map_name", "corners", "h", "w")
    fields = [joined.schema[c] for c in ("view", "map_name", "corners")]
    return joined.mapInArrow(work, T.StructType([*fields, T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType())]))


def cut_views(views: DataFrame, tiled: DataFrame, height: int, width: int, size: int = 256, per_tile: int = PER_TILE) -> DataFrame:
    """view and pixels (rows of pixels of channels) of each view. tiled: as tiles() makes it, of the same size; views: view (a
    key), map_name and corners (four of x and y). Views of unknown maps, and those that span no area, are left out."""
    sizes = tiled.groupBy("map_name").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    key = ["map_name", "ty", "tx"]
    asked = written(touched(views, sizes, height, width, size))
    parts = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / per_tile).cast("int").alias("parts"))
    dealt = asked.join(parts, key).withColumn("part", F.pmod(F.xxhash64("view"), F.col("parts")).cast("int")).drop("parts")
    spread = tiled.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(batches):
        """Each tile is followed by the rows of its part."""
        now, tile, piece = None, None, None
        for b in batches:
            plain = b.select(["map_name", "ty", "tx", "part", "h", "w", "channels", "th", "tw"]).to_pylist()
            corners, pixels, seen = b.column("corners"), b.column("pixels"), b.column("view").is_valid().to_pylist()
            rows, at, values = [], [], []
            for r, row in enumerate(plain):
                here = (row["map_name"], row["ty"], row["tx"], row["part"])
                if not seen[r]:
                    if here != now:
                        now, tile, piece = here, row, pixels[r].values.to_numpy().reshape(row["th"], row["tw"], row["channels"])
                elif here == now:
                    y, x = places(_corners(corners[r].as_py()), height, width, tile["h"], tile["w"])
                    mine = np.flatnonzero((y // size == tile["ty"]) & (x // size == tile["tx"]))
                    rows.append(r)
                    at.append(mine.astype(np.int32))
                    values.append(sampled(piece, y[mine] - tile["ty"] * size, x[mine] - tile["tx"] * size).ravel())
            yield pa.RecordBatch.from_arrays([b.column("view").take(pa.array(rows, pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["view", "at", "values"])

    kind = views.schema["view"].dataType.simpleString()
    both = spread.unionByName(dealt, allowMissingColumns=True).repartition(*key, "part").sortWithinPartitions(*key, "part", F.col("view").isNotNull())
    pieces = both.mapInArrow(run, f"view {kind}, at array<int>, values array<double>")

    def join_up(batches):
        now, held = None, []
        for b in batches:
            for view, at, values in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if held and view != now:
                    yield out(now, held)
                    held = []
                now = view
                held.append((at.values.to_numpy(), values.values.to_numpy()))
        if held:
            yield out(now, held)

    def out(view, held):
        n = height * width
        channels = sum(len(v) for _, v in held) // n
        image = np.zeros((n, channels))
        for at, values in held:
            image[at] = values.reshape(-1, channels)
        return pa.RecordBatch.from_arrays([pa.array([view], kinds), pa.array([image.ravel()], pa.list_(pa.float64()))], names=["view", "pixels"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(views.schema["view"].dataType)
    return pieces.repartition("view").sortWithinPartitions("view").mapInArrow(join_up, f"view {kind}, pixels array<double>")


def standardized(pixels: Column, mean: tuple, std: tuple) -> Column:
    """Rows of pixels as planes of channels, less the mean, over the deviation."""
    c = len(mean)
    plane = lambda i: F.transform(F.filter(pixels, lambda _, j: j % c == i), lambda v: (v - mean[i]) / std[i])
    return F.flatten(F.array(*[plane(i) for i in range(c)]))


def padded_words(x: Column, size: int) -> Column:
    """The words of a text, cut or filled up to size; stands where a tokenizer's ids would."""
    return F.slice(F.concat(text.tokens(F.coalesce(x, F.lit(""))), F.array_repeat(F.lit("<pad>"), size)), 1, size)


def turn_features(
    episodes: DataFrame, turns: DataFrame, tiled: DataFrame, height: int = 224, width: int = 224, size: int = 256, history: int = 3, input_length: int = 512, answer_length: int = 128,
    mean: tuple = geometry.RGB_MEAN, std: tuple = geometry.RGB_STD, tokenizer: Callable[[Column, int], Column] = padded_words, embedder: Callable[[Column], Column] | None = None, embedding: int = 768,
) -> DataFrame:
    """One row a turn: keys, texts, tokens, views as standardized planes, contrastive texts and the teacher's embedding.

    episodes: episode_id, map_name, gps_botm_left, gps_top_right, lat_ratio, lng_ratio, first_instruction, destination (four
    corners or null). turns: episode_id, turn_id, question, answer, dialog_history (texts), observation (four corners or null),
    previous_observations (lists of corners), paraphrases (struct of positives, negatives and more, or null). Turns without an
    observation, and those whose view can't be cut, have a blank current view (zeros); previous views that can't be cut are
    blank too. Of the history and the previous views the last `history` count. Nulls in texts count as empty."""
    px = lambda corners: F.transform(corners, lambda c: (lambda p: F.array(p["x"], p["y"]))(geometry.pixel(c, F.col("gps_botm_left"), F.col("gps_top_right"), F.col("lat_ratio"), F.col("lng_ratio"))))
    frame = episodes.select("episode_id", "map_name", "gps_botm_left", "gps_top_right", "lat_ratio", "lng_ratio")
    last = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - history + 1), history)
    seen = turns.join(frame, "episode_id")
    one = lambda kind, place, corners: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), corners.alias("corners"))
    before = last(F.coalesce("previous_observations", F.array().cast("array<array<array<double>>>")))
    wanted = F.concat(F.array(one("current", F.lit(0), F.col("observation"))), F.transform(before, lambda c, i: one("previous", i, c)))
    views = seen.select("episode_id", "turn_id", "map_name", "gps_botm_left", "gps_top_right", "lat_ratio", "lng_ratio", F.explode(wanted).alias("v")).where("v.corners is not null")
    goals = episodes.where("destination is not null").withColumns({"turn_id": F.lit(None).cast(turns.schema["turn_id"].dataType), "v": one("destination", F.lit(0), F.col("destination"))})
    every = views.unionByName(goals.select(*views.columns))
    key = F.struct("episode_id", "turn_id", "v.kind", "v.place").alias("view")
    images = cut_views(every.select(key, "map_name", px(F.col("v.corners")).alias("corners")), tiled, height, width, size)
    images = written(images.select("view.*", standardized(F.col("pixels"), mean, std).alias("planes")))

    blank = F.array_repeat(F.lit(0.0), height * width * len(mean))
    current = images.where("kind = 'current'").select("episode_id", "turn_id", F.col("planes").alias("_current"))
    previous = images.where("kind = 'previous'").groupBy("episode_id", "turn_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "planes"))).alias("_previous"))
    goal = images.where("kind = 'destination'").select("episode_id", F.col("planes").alias("destination_view"))
    none = F.lit("")
    question, answer = F.coalesce("question", none), F.coalesce("answer", none)
    said = last(F.coalesce("dialog_history", F.array().cast("array<string>")))
    context = F.concat_ws(" ", said, F.when(question != "", F.concat(F.lit("Question: "), question)))
    first = F.coalesce("first_instruction", none)
    held = turns.join(episodes.select("episode_id", "map_name", "first_instruction"), "episode_id").withColumn("_n", F.size(before))
    rows = held.join(current, ["episode_id", "turn_id"], "left").join(previous, ["episode_id", "turn_id"], "left").join(goal, "episode_id", "left")
    p = F.col("paraphrases")
    columns = {
        "dialog_context": context, "input_tokens": tokenizer(context, input_length), "first_tokens": tokenizer(first, answer_length), "question_tokens": tokenizer(question, answer_length), "answer_tokens": tokenizer(answer, answer_length),
        "current_view": F.coalesce("_current", blank),
        "previous_views": F.when(F.col("_n") == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_previous", i), blank))),
        "teacher_embed": embedder(context) if embedder else F.array_repeat(F.lit(0.0), embedding),
    } | curation.contrastive(p)
    return rows.select("episode_id", "turn_id", "map_name", first.alias("first_instruction"), question.alias("question"), answer.alias("answer"), "destination_view", *[c.alias(n) for n, c in columns.items()])


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stand-ins: maps are all embeddings (8 x 8 pixels of one channel), turns those of conversations, corners by their numbers."""
    maps = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_name"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("channels"), F.col("embedding").alias("pixels"))
    n = F.broadcast(maps.agg(F.count(F.lit(1)).alias("n")))
    talk = table(spark, sf_dir, "conversations")
    box = lambda x, y, dx, dy: F.array(*[F.array((7 - (y + b)).cast("double"), (x + a).cast("double")) for a, b in ((F.lit(0), F.lit(0)), (dx, F.lit(0)), (dx, dy), (F.lit(0), dy))])
    c, t = F.col("conv_id"), F.col("turn")
    whole = talk.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_instruction")).crossJoin(n)
    episodes = whole.select(c.alias("episode_id"), (c % F.col("n")).alias("map_name"), F.array(F.lit(0.0), F.lit(0.0)).alias("gps_botm_left"), F.array(F.lit(7.0), F.lit(7.0)).alias("gps_top_right"), F.lit(1.0).alias("lat_ratio"), F.lit(1.0).alias("lng_ratio"), "first_instruction", F.when(c % 2 == 0, box(F.lit(1), F.lit(2), F.lit(5), F.lit(4))).alias("destination"))
    observed = F.when(t % 4 != 3, box(c % 4, t % 3, F.lit(2) + t % 4, F.lit(2) + c % 3))
    turns = talk.select(c.alias("episode_id"), t.alias("turn_id"), F.col("role").alias("question"), F.col("text").alias("answer"), F.array(F.concat(F.lit("First Instruction: "), "role"), F.lit("a"), F.lit("b"), F.lit("c")).alias("dialog_history"), observed.alias("observation"), F.when(t > 0, F.transform(F.sequence(F.lit(1).cast("long"), t), lambda i: box(i % 3, c % 2, F.lit(3), F.lit(3)))).alias("previous_observations"), F.lit(None).cast("struct<positives: array<string>, negatives: array<string>, valid_positives: array<string>, valid_negatives: array<string>>").alias("paraphrases"))
    return episodes, turns, maps


def _view_sql(x: str, y: str, dx: str, dy: str, e: str = "e") -> str:
    """The 16 values of a 4 x 4 view of an upright box, bilinear, standardized by 0.1 and 0.5."""
    px, py = f"least(greatest({x} + (k % 4) * ({dx}) / 3.0::DOUBLE, 0), 7)", f"least(greatest({y} + (k // 4) * ({dy}) / 3.0::DOUBLE, 0), 7)"
    at = lambda a, b: f"{e}[(least(floor({py})::INT + {b}, 7) * 8 + least(floor({px})::INT + {a}, 7) + 1)::INT]"
    fx, fy = f"({px} - floor({px}))", f"({py} - floor({py}))"
    return f"list_transform(range(16), lambda k: ((({at(0, 0)} * (1 - {fx}) + {at(1, 0)} * {fx}) * (1 - {fy}) + ({at(0, 1)} * (1 - {fx}) + {at(1, 1)} * {fx}) * {fy}) - 0.1) / 0.5)"


@query("turn_features", f"""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
 t AS (SELECT c.conv_id, c.turn, c.role, c.text, m.e FROM conversations c JOIN m ON m.vec_id = c.conv_id % m.n),
 v AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 4 = 3 THEN list_transform(range(16), lambda k: 0.0::DOUBLE) ELSE {_view_sql("conv_id % 4", "turn % 3", "2 + turn % 4", "2 + conv_id % 3")} END AS cur, CASE WHEN turn > 0 THEN {_view_sql("turn % 3", "conv_id % 2", "3", "3")} END AS prev, CASE WHEN conv_id % 2 = 0 THEN {_view_sql("1", "2", "5", "4")} END AS goal FROM t)
 SELECT conv_id AS episode_id, turn AS turn_id, 'a b c Question: ' || role AS dialog_context, md5(array_to_string(list_concat(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), list_transform(range(128), lambda i: '<pad>'))[1:128], ' ')) AS answer_md5, round(cur[2], 6) AS second, round(list_sum(cur), 6) AS total, least(turn, 3) AS previous, round(list_sum(prev), 6) AS last_previous, round(list_sum(goal), 6) AS destination FROM v""")
def q_turn_features(spark, sf_dir):
    """Every turn of conversations with its views, cut from tiles of 3 x 3 pixels of all embeddings as maps."""
    episodes, turns, maps = _inputs(spark, sf_dir)
    x = turn_features(episodes, turns, written(tiles(maps, 3)), 4, 4, 3, mean=(0.1,), std=(0.5,))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)
    last = F.try_element_at("previous_views", F.lit(-1))
    return x.select("episode_id", "turn_id", "dialog_context", F.md5(F.array_join("answer_tokens", " ")).alias("answer_md5"), F.round(F.col("current_view")[1], 6).alias("second"), total(F.col("current_view")).alias("total"), F.size("previous_views").cast("long").alias("previous"), total(last).alias("last_previous"), total(F.col("destination_view")).alias("destination"))
