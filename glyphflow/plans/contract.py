"""Contract queries: the engine's operators over boxes, logits and names derived from the driver's tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphflow.config import EXTENSIONS
from glyphflow.functions import geometry as G
from glyphflow.functions import text as X
from glyphflow.operators import assembly, ctc, ordering, suppression, tiling
from glyphflow.operators.characters import character_counts
from glyphflow.plans import sinks
from glyphflow.plans.progress import numbered
from glyphflow.sources.dictionaries import distinct_stripped
from glyphflow.storage import materialise

# ---- derived tables -------------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x1, y1 = e * 7919 % 600, e * 104729 % 400
    found = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), e.alias("id"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + 20 + e % 180).cast("int").alias("x2"), (y1 + 12 + e % 40).cast("int").alias("y2"), F.col("value").alias("score"),
    )
    return found


_BOXES = """boxes AS (SELECT user_id AS page, event_id AS id, CAST(event_id*7919%600 AS INT) AS x1, CAST(event_id*104729%400 AS INT) AS y1,
 CAST(event_id*7919%600+20+event_id%180 AS INT) AS x2, CAST(event_id*104729%400+12+event_id%40 AS INT) AS y2, value AS score FROM events)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("id") % 7).cast("int")
    points = F.array(F.array(F.col("x1"), F.col("y1") + k), F.array("x2", "y1"), F.array("x2", "y2"), F.array(F.col("x1"), F.col("y2") + k))
    return boxes(spark, sf_dir).select("page", "id", "score", points.alias("polygon"))


_QUADS = _BOXES + """, quads AS (SELECT page, id, score, [[x1, y1 + CAST(id%7 AS INT)], [x2, y1], [x2, y2], [x1, y2 + CAST(id%7 AS INT)]] AS p FROM boxes)"""


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(e.alias("id"), (e % 5000 + 1).cast("int").alias("h"), (e * 37 % 3000 + 1).cast("int").alias("w"))


_DIMS = "dims AS (SELECT event_id AS id, CAST(event_id%5000+1 AS INT) AS h, CAST(event_id*37%3000+1 AS INT) AS w FROM events)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return _read(spark, sf_dir, "events").select(u.alias("page")).distinct().select("page", (800 + F.col("page") * 53 % 1700).cast("int").alias("h"), (700 + F.col("page") * 97 % 2300).cast("int").alias("w"))


_PAGES = "pages_hw AS (SELECT DISTINCT user_id AS page, CAST(800+user_id*53%1700 AS INT) AS h, CAST(700+user_id*97%2300 AS INT) AS w FROM events)"
DICTIONARY = ["blank", "a", "b", "c", "d", "e", "f"]
ALLOWED = {"a", "c", "e"}
SIDE = 8


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda t: F.slice("embedding", t * SIDE + 1, SIDE))
    return _read(spark, sf_dir, "embeddings").select("vec_id", rows.alias("pred"))


def decoded(spark: SparkSession, sf_dir: str, mask: list[float] | None = None) -> DataFrame:
    return ctc.decode_frames(logits(spark, sf_dir), "pred", DICTIONARY, mask)


def _decoded_sql(allowed: set[str] | None = None) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in DICTIONARY) + "]"
    value = "CAST(embedding[t*8+c+1] AS DOUBLE)"
    if allowed is not None:
        free = [i for i, c in enumerate(DICTIONARY) if i == 0 or c in allowed]
        value = f"CASE WHEN c IN ({', '.join(map(str, free))}) THEN {value} ELSE CAST('-Infinity' AS DOUBLE) END"
    return f"""cells AS (SELECT vec_id, t, c, {value} AS v FROM embeddings, (SELECT unnest(range(8)) AS t), (SELECT unnest(range(8)) AS c)),
 tops AS (SELECT vec_id, t, max(v) AS prob FROM cells GROUP BY ALL),
 best AS (SELECT vec_id, t, prob, (SELECT min(c) FROM cells k WHERE k.vec_id = m.vec_id AND k.t = m.t AND k.v = m.prob) AS idx FROM tops m),
 lagged AS (SELECT *, lag(idx) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM best),
 kept AS (SELECT * FROM lagged WHERE (before IS NULL OR before <> idx) AND idx <> 0 AND idx < {len(DICTIONARY)}),
 decoded AS (SELECT e.vec_id, coalesce(string_agg({names}[k.idx + 1], '' ORDER BY k.t), '') AS text, coalesce(avg(k.prob), 0.0) AS score
  FROM embeddings e LEFT JOIN kept k ON e.vec_id = k.vec_id GROUP BY e.vec_id)"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, ("png", "JPG", "jpeg", "bmp", "tiff", "tif", "webp", "txt", "gif")))
    p = F.col("page_id")
    return _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/scans/img_"), p.cast("string"), F.lit("."), F.get(endings, (p % 9).cast("int"))).alias("path"))


_NAMES = "names AS (SELECT page_id, '/in/scans/img_' || page_id || '.' || ['png','JPG','jpeg','bmp','tiff','tif','webp','txt','gif'][CAST(page_id%9 AS INT)+1] AS path FROM pages)"
_IMAGE = "lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN (" + ", ".join(f"'{e}'" for e in EXTENSIONS) + ")"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- sources, names, characters --------------------------------------------------------------------------------


@query(f"WITH {_NAMES} SELECT page_id, path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS place FROM names WHERE {_IMAGE}")
def list_images_filter(spark, sf_dir):
    """Image files by ending, in the order of their names. The order is a report over file names, not over rows of data."""
    names = file_names(spark, sf_dir).where(X.is_image(F.col("path")))
    # Written once, so that both uses see the same partitions.
    ranked = materialise(names.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy("path")
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    bases = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ranked.withColumn("r", F.row_number().over(within)).join(bases, "part").select("page_id", "path", (F.col("base") + F.col("r")).cast("long").alias("place"))


@query(
    f"WITH {_NAMES} SELECT page_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem, 'output/scans/' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') || '.json' AS json_path, "
    f"'output/scans/' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') || '.png' AS png_path FROM names WHERE {_IMAGE}"
)
def output_paths(spark, sf_dir):
    named = file_names(spark, sf_dir).where(X.is_image(F.col("path"))).select("page_id", sinks.output_paths(F.col("path"), "output/scans").alias("out"))
    return named.select("page_id", "out.stem", "out.json_path", "out.png_path")


_CHARSET = "".join(map(chr, range(0x21, 0x7F)))
_CHARS_SQL = "chars AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)"
_SET_SQL = "charset AS (SELECT chr(CAST(i AS INT)) AS ch FROM range(33, 127) r(i))"


def _chars(spark, sf_dir) -> DataFrame:
    return character_counts(_read(spark, sf_dir, "documents"))


def _charset(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _CHARSET], "ch string")


@query(f"WITH {_CHARS_SQL}, {_SET_SQL} SELECT ch, n FROM chars SEMI JOIN charset USING (ch)")
def char_filter(spark, sf_dir):
    """Characters of the texts within the allowed set; counted before the join."""
    return _chars(spark, sf_dir).join(F.broadcast(_charset(spark)), "ch", "left_semi")


@query(f"WITH {_CHARS_SQL}, {_SET_SQL} SELECT ch, n FROM chars ANTI JOIN charset USING (ch)")
def char_masked(spark, sf_dir):
    return _chars(spark, sf_dir).join(F.broadcast(_charset(spark)), "ch", "left_anti")


_STRIP = r"[\s\x0B\p{Z}\x1C-\x1F\x{85}]+"


@query(f"SELECT DISTINCT ch FROM (SELECT regexp_replace(w, '^{_STRIP}|{_STRIP}$', '', 'g') AS ch FROM (SELECT unnest(string_split(text, chr(10))) AS w FROM documents)) WHERE ch <> ''")
def allowed_set(spark, sf_dir):
    """The allowed-set scan: stripped lines, no empty ones, each once (lines of the texts stand for a file)."""
    return distinct_stripped(_read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


# ---- sizes and tiles -------------------------------------------------------------------------------------------


@query(f"""WITH {_DIMS}, p AS (SELECT id, CASE WHEN h+w<64 THEN greatest(32,h) ELSE h END AS h, CASE WHEN h+w<64 THEN greatest(32,w) ELSE w END AS w FROM dims),
 r AS (SELECT *, CASE WHEN least(h,w)<64 THEN 64.0::DOUBLE/least(h,w) ELSE 1.0::DOUBLE END AS f FROM p), s AS (SELECT id, h, w, CAST(trunc(h*f) AS INT) AS a, CAST(trunc(w*f) AS INT) AS b FROM r),
 t AS (SELECT id, h, w, CASE WHEN greatest(a,b)>4000 THEN CAST(trunc(a*(4000.0::DOUBLE/greatest(a,b))) AS INT) ELSE a END AS a, CASE WHEN greatest(a,b)>4000 THEN CAST(trunc(b*(4000.0::DOUBLE/greatest(a,b))) AS INT) ELSE b END AS b FROM s),
 u AS (SELECT id, h, w, greatest(CAST(round_even(a/32.0::DOUBLE,0)*32 AS INT),32) AS rh, greatest(CAST(round_even(b/32.0::DOUBLE,0)*32 AS INT),32) AS rw FROM t)
 SELECT id, rh, rw, round(rh/CAST(h AS DOUBLE),6) AS ratio_h, round(rw/CAST(w AS DOUBLE),6) AS ratio_w FROM u""")
def det_resize_dims(spark, sf_dir):
    h, w = G.padded_sides(F.col("h"), F.col("w"))
    padded = dims(spark, sf_dir).select("id", h.alias("h"), w.alias("w"))
    rh, rw = G.detector_sides(F.col("h"), F.col("w"))
    return padded.select("id", rh.alias("rh"), rw.alias("rw"), F.round(rh / F.col("h").cast("double"), 6).alias("ratio_h"), F.round(rw / F.col("w").cast("double"), 6).alias("ratio_w"))


_TILES = f"""{_PAGES}, n AS (SELECT page, h, w, CASE WHEN h<=0 THEN 0 WHEN h<=960 THEN 1 ELSE CAST(ceil((h-960)/640.0) AS INT)+1 END AS nh,
 CASE WHEN w<=0 THEN 0 WHEN w<=960 THEN 1 ELSE CAST(ceil((w-960)/640.0) AS INT)+1 END AS nw FROM pages_hw),
 ys AS (SELECT *, unnest(range(nh)) AS i FROM n), tiles AS (SELECT page, h, w, i, unnest(range(nw)) AS j, nw FROM ys),
 placed AS (SELECT page, h, w, CAST(i*nw+j AS INT) AS tile_no, CAST(i*640 AS INT) AS y1, CAST(j*640 AS INT) AS x1, CAST(least(i*640+960,h) AS INT) AS y2, CAST(least(j*640+960,w) AS INT) AS x2 FROM tiles)"""


@query(f"WITH {_TILES} SELECT page, tile_no, y1, x1, y2, x2 FROM placed")
def tiles(spark, sf_dir):
    return tiling.with_tiles(pages(spark, sf_dir)).select("page", "tile_no", "y1", "x1", "y2", "x2")


@query(f"""WITH {_TILES}, pts AS (SELECT user_id AS page, event_id AS id, event_id*7919%2400+(event_id%180+20)/2.0 AS cx, event_id*104729%2100+(event_id%40+12)/2.0 AS cy FROM events)
 SELECT page, id, tile_no FROM pts JOIN placed USING (page) WHERE cx BETWEEN (CASE WHEN x1>0 THEN x1+160 ELSE x1 END) AND (CASE WHEN x2<w THEN x2-160 ELSE x2 END)
 AND cy BETWEEN (CASE WHEN y1>0 THEN y1+160 ELSE y1 END) AND (CASE WHEN y2<h THEN y2-160 ELSE y2 END)""")
def core_filter(spark, sf_dir):
    """Centres in the core of a tile. A centre can only be in the tiles of its own and the neighbouring grid cell, so it meets those by key."""
    e = F.col("event_id")
    found = _read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), e.alias("id"), (e * 7919 % 2400 + (e % 180 + 20) / 2).alias("cx"), (e * 104729 % 2100 + (e % 40 + 12) / 2).alias("cy"))

    def cells(v):
        k = F.floor(v / 640).cast("int")
        return F.explode(F.sequence(F.greatest(k - 1, F.lit(0)), k))

    found = found.withColumn("gx", cells(F.col("cx"))).withColumn("gy", cells(F.col("cy")))
    placed = tiling.with_tiles(pages(spark, sf_dir)).withColumns({"gx": F.floor(F.col("x1") / 640).cast("int"), "gy": F.floor(F.col("y1") / 640).cast("int")})
    joined = found.join(placed, ["page", "gx", "gy"])
    tile = F.struct("y1", "x1", "y2", "x2")
    return joined.where(tiling.in_core(F.col("cx"), F.col("cy"), tile, F.col("h"), F.col("w"))).select("page", "id", "tile_no")


@query(f"WITH {_QUADS} SELECT page, id, CAST(p[1][1]+640 AS INT) AS x, CAST(p[1][2]+1280 AS INT) AS y, round((p[1][1]+p[2][1]+p[3][1]+p[4][1])/4.0+640,6) AS cx, round((p[1][2]+p[2][2]+p[3][2]+p[4][2])/4.0+1280,6) AS cy FROM quads")
def translate_centroid(spark, sf_dir):
    moved = quads(spark, sf_dir).withColumn("p", G.translate(F.col("polygon"), F.lit(640), F.lit(1280)))
    cx, cy = G.centroid(F.col("p"))
    return moved.select("page", "id", F.col("p")[0][0].alias("x"), F.col("p")[0][1].alias("y"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


# ---- boxes -----------------------------------------------------------------------------------------------------


@query(f"WITH {_BOXES}, d AS (SELECT *, CAST(x2-x1 AS DOUBLE) AS bw, CAST(y2-y1 AS DOUBLE) AS bh FROM boxes), e AS (SELECT *, bw*bh*1.5::DOUBLE/(2*(bw+bh))*1.10::DOUBLE AS dist FROM d) SELECT page, id, round(dist,6) AS distance, round(bw+2*dist,6) AS new_w, round(bh+2*dist,6) AS new_h FROM e")
def unclip_rect(spark, sf_dir):
    sized = boxes(spark, sf_dir).withColumns({"w": (F.col("x2") - F.col("x1")).cast("double"), "h": (F.col("y2") - F.col("y1")).cast("double")})
    d = sized.withColumn("distance", G.unclip_distance(F.col("w"), F.col("h")))
    return d.select("page", "id", *_round("distance"), F.round(F.col("w") + 2 * F.col("distance"), 6).alias("new_w"), F.round(F.col("h") + 2 * F.col("distance"), 6).alias("new_h"))


@query(f"WITH {_BOXES} SELECT page, id, CAST(least(greatest(round_even(x1/640.0::DOUBLE*997,0),0),997) AS INT) AS x, CAST(least(greatest(round_even((y2-30)/384.0::DOUBLE*613,0),0),613) AS INT) AS y FROM boxes")
def scale_clip(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "id", G.to_image(F.col("x1"), F.lit(640.0), F.lit(997)).alias("x"), G.to_image(F.col("y2") - 30, F.lit(384.0), F.lit(613)).alias("y"))


@query(f"WITH {_BOXES} SELECT page, id, round((id%101)/100.0,6) AS prob FROM boxes WHERE least(x2-x1,y2-y1)%40>=3 AND (id%101)/100.0>=0.6 AND least(x2-x1,y2-y1)%40*1.5>=5")
def box_gate(spark, sf_dir):
    """The gates on short side, score, and short side after the expansion."""
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) % 40
    prob = F.col("id") % 101 / 100
    gated = boxes(spark, sf_dir).where(G.passes_gates(side, prob, side * 1.5))
    return gated.select("page", "id", F.round(prob, 6).alias("prob"))


@query(f"WITH {_QUADS} SELECT page, id, least(p[1][1],p[2][1],p[3][1],p[4][1]) AS x1, least(p[1][2],p[2][2],p[3][2],p[4][2]) AS y1, greatest(p[1][1],p[2][1],p[3][1],p[4][1]) AS x2, greatest(p[1][2],p[2][2],p[3][2],p[4][2]) AS y2 FROM quads")
def aabb(spark, sf_dir):
    return quads(spark, sf_dir).withColumn("b", G.aabb(F.col("polygon"))).select("page", "id", "b.*")


@query(f"""WITH {_QUADS}, l AS (SELECT *, sqrt(pow(CAST(p[1][1]-p[2][1] AS DOUBLE),2)+pow(CAST(p[1][2]-p[2][2] AS DOUBLE),2)) AS a, sqrt(pow(CAST(p[3][1]-p[4][1] AS DOUBLE),2)+pow(CAST(p[3][2]-p[4][2] AS DOUBLE),2)) AS b,
 sqrt(pow(CAST(p[1][1]-p[4][1] AS DOUBLE),2)+pow(CAST(p[1][2]-p[4][2] AS DOUBLE),2)) AS c, sqrt(pow(CAST(p[2][1]-p[3][1] AS DOUBLE),2)+pow(CAST(p[2][2]-p[3][2] AS DOUBLE),2)) AS d FROM quads),
 m AS (SELECT page, id, greatest(CAST(trunc(greatest(a,b)) AS INT),1) AS w, greatest(CAST(trunc(greatest(c,d)) AS INT),1) AS h FROM l) SELECT page, id, w, h, h > 1.5*w AS upright FROM m""")
def crop_dims(spark, sf_dir):
    w, h = G.crop_sides(F.col("polygon"))
    return quads(spark, sf_dir).select("page", "id", w.alias("w"), h.alias("h")).withColumn("upright", G.is_upright(F.col("w"), F.col("h")))


@query(f"""WITH {_QUADS}, s AS (SELECT page, id, unnest([0,1,2,3]) AS i, [p[3],p[1],p[4],p[2]] AS q FROM quads), r AS (SELECT page, id, q[i+1][1] AS x, q[i+1][2] AS y, row_number() OVER (PARTITION BY page, id ORDER BY q[i+1][1], i) AS k FROM s),
 w AS (SELECT page, id, max(x) FILTER (k=1) AS x1, max(y) FILTER (k=1) AS y1, max(x) FILTER (k=2) AS x2, max(y) FILTER (k=2) AS y2, max(x) FILTER (k=3) AS x3, max(y) FILTER (k=3) AS y3, max(x) FILTER (k=4) AS x4, max(y) FILTER (k=4) AS y4 FROM r GROUP BY page, id)
 SELECT page, id, CASE WHEN y2>y1 THEN x1 ELSE x2 END AS tl_x, CASE WHEN y2>y1 THEN y1 ELSE y2 END AS tl_y, CASE WHEN y4>y3 THEN x3 ELSE x4 END AS tr_x, CASE WHEN y4>y3 THEN y3 ELSE y4 END AS tr_y FROM w""")
def corner_order(spark, sf_dir):
    p = F.col("polygon")
    mixed = quads(spark, sf_dir).withColumn("o", G.corner_order(F.array(p[2], p[0], p[3], p[1])))
    o = F.col("o")
    return mixed.select("page", "id", o[0][0].alias("tl_x"), o[0][1].alias("tl_y"), o[1][0].alias("tr_x"), o[1][1].alias("tr_y"))


_IOU_SQL = "CAST(greatest(0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) AS DOUBLE)/(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-greatest(0,least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0,least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"


@query(f"WITH {_BOXES} SELECT a.page, a.id AS a, b.id AS b, round({_IOU_SQL.format(a='a', b='b')},6) AS iou FROM boxes a JOIN boxes b ON a.page=b.page AND a.id<b.id WHERE {_IOU_SQL.format(a='a', b='b')} > 0.3")
def iou_pairs(spark, sf_dir):
    return suppression.overlapping_pairs(boxes(spark, sf_dir)).select("page", "a", "b", *_round("iou"))


_NMS = f"""{_BOXES}, g AS (SELECT page, list([{{'id': id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, id DESC) AS l FROM boxes GROUP BY page),
 k AS (SELECT page, unnest(list_reduce(l, lambda acc, n: CASE WHEN len(list_filter(acc, lambda e: {_IOU_SQL.format(a='e', b='n[1]')} > 0.3)) > 0 THEN acc ELSE list_concat(acc, n) END)) AS b FROM g),
 nms AS (SELECT page, b.id AS id, b.score AS score, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM k)"""


@query(f"WITH {_NMS} SELECT page, id, x1, y1, x2, y2, round(score,6) AS score FROM nms")
def nms(spark, sf_dir):
    return suppression.suppress(boxes(spark, sf_dir)).select("page", "id", "x1", "y1", "x2", "y2", *_round("score"))


@query(f"WITH {_NMS} SELECT b.page, b.id FROM boxes b ANTI JOIN nms USING (page, id)")
def nms_suppressed(spark, sf_dir):
    return suppression.suppressed(boxes(spark, sf_dir)).select("page", "id")


def _order_sql(table: str) -> str:
    return f"""og AS (SELECT page, list([{{'id': id, 'x': x1, 'y': y1}}] ORDER BY y1, x1, id) AS l FROM {table} GROUP BY page),
 oo AS (SELECT page, list_reduce(l, lambda acc, n: list_concat(list_concat(acc[1:coalesce(list_max(list_filter(range(1, len(acc)+1), lambda i: NOT (abs(n[1].y-acc[i].y)<10 AND n[1].x<acc[i].x))),0)], n), acc[coalesce(list_max(list_filter(range(1, len(acc)+1), lambda i: NOT (abs(n[1].y-acc[i].y)<10 AND n[1].x<acc[i].x))),0)+1:])) AS o FROM og),
 ordered AS (SELECT page, o[i].id AS id, CAST(i-1 AS BIGINT) AS box_idx FROM (SELECT page, o, unnest(range(1, len(o)+1)) AS i FROM oo))"""


@query(f"WITH {_BOXES}, {_order_sql('boxes')} SELECT page, id, box_idx FROM ordered")
def reading_order(spark, sf_dir):
    return ordering.reading_order(boxes(spark, sf_dir)).select("page", "id", F.col("box_idx").cast("long").alias("box_idx"))


_FLAG_SQL = f"""WITH {_BOXES.replace('FROM events)', 'FROM events WHERE (event_id%101)/100.0>=0.6)')}{_NMS[len(_BOXES):]}, {_order_sql('nms')}
 SELECT o.page, o.box_idx, n.id, n.x1, n.y1, n.x2, n.y2 FROM ordered o JOIN nms n ON o.page=n.page AND o.id=n.id"""


@query(_FLAG_SQL)
def page_boxes(spark, sf_dir):
    """The flagship: gate, overlap suppression and reading order per page."""
    gated = boxes(spark, sf_dir).where(F.col("id") % 101 / 100 >= 0.6)
    placed = ordering.reading_order(suppression.suppress(gated))
    return placed.select("page", F.col("box_idx").cast("long").alias("box_idx"), "id", "x1", "y1", "x2", "y2")


_RATIO = "CAST(x2-x1 AS DOUBLE)/(y2-y1)"


@query(f"""WITH {_BOXES}, n AS (SELECT page, id, {_RATIO} AS ratio, CAST(floor((row_number() OVER (PARTITION BY page ORDER BY id)-1)/32.0) AS INT) AS batch_no FROM boxes),
 m AS (SELECT *, CAST(trunc(48*greatest(320/48.0::DOUBLE, max(ratio) OVER (PARTITION BY page, batch_no))) AS INT) AS img_w FROM n)
 SELECT page, id, batch_no, img_w, least(img_w, CAST(ceil(48*ratio) AS INT)) AS resized_w FROM m""")
def rec_batches(spark, sf_dir):
    crops = boxes(spark, sf_dir).withColumn("ratio", (F.col("x2") - F.col("x1")).cast("double") / (F.col("y2") - F.col("y1")))
    return assembly.recogniser_batches(crops, order="id").select("page", "id", "batch_no", "img_w", "resized_w")


@query("SELECT user_id AS page, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM events")
def progress(spark, sf_dir):
    """Place and number of a page's boxes, as a progress line shows them."""
    return numbered(boxes(spark, sf_dir), "page", "id").select("page", "id", "i", "n")


# ---- recognition -----------------------------------------------------------------------------------------------


@query(f"WITH {_decoded_sql()} SELECT vec_id, text, round(score,6) AS score FROM decoded")
def ctc_decode(spark, sf_dir):
    return decoded(spark, sf_dir).select("vec_id", "text", *_round("score"))


@query(f"WITH {_decoded_sql(ALLOWED)} SELECT vec_id, text, round(score,6) AS score FROM decoded")
def mask_apply(spark, sf_dir):
    """Decoding with a mask; it covers seven of eight classes, so the last is forbidden."""
    return decoded(spark, sf_dir, ctc.mask_array(DICTIONARY, ALLOWED)).select("vec_id", "text", *_round("score"))


@query("SELECT i AS idx, ch, i = 0 OR ch IN ('a','c','e') AS free FROM (SELECT unnest(['blank','a','b','c','d','e','f']) AS ch, unnest(range(7)) AS i)")
def char_mask(spark, sf_dir):
    names, free = F.array(*map(F.lit, DICTIONARY)), F.array(*map(F.lit, sorted(ALLOWED)))
    row = spark.range(1).select(names.alias("d"), ctc.mask_column(names, free).alias("m"))
    return row.select(F.posexplode(F.arrays_zip("d", "m")).alias("idx", "x")).select(F.col("idx").cast("long").alias("idx"), F.col("x.d").alias("ch"), (F.col("x.m") == 0).alias("free"))


@query("SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] THEN 0 ELSE 1 END AS angle FROM embeddings")
def orientation(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", ctc.argmax(F.slice("embedding", 1, 2)).alias("angle"))


@query(f"WITH {_decoded_sql()} SELECT vec_id, text, round(score,6) AS score FROM decoded WHERE NOT (score < 0.2) AND trim(text) <> ''")
def text_filter(spark, sf_dir):
    return assembly.text_filter(decoded(spark, sf_dir), least=0.2).select("vec_id", "text", *_round("score"))


@query("SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\\s\\x0B\\x{85}\\p{Z}]')")
def nonblank_lines(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(~X.is_blank(F.col("l")))


_ITEMS = f"""{_QUADS}, {_decoded_sql()}, ob AS (SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY id)-1 AS INT) AS box_idx, p FROM quads),
 n AS (SELECT count(*) AS c FROM embeddings), items AS (SELECT ob.page, ob.id, ob.box_idx, ob.p, d.text, d.score, CASE WHEN e.embedding[1]>=e.embedding[2] THEN 0 ELSE 1 END AS angle FROM ob, n, decoded d, embeddings e
 WHERE d.vec_id = ob.id % n.c AND e.vec_id = d.vec_id AND d.text <> '')"""


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """images, boxes, texts, angles: boxes joined to decoded vectors by id modulo their number."""
    order = Window.partitionBy("page").orderBy("id")
    placed = quads(spark, sf_dir).drop("score").withColumn("box_idx", F.row_number().over(order) - 1)
    n = _read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("c"))  # one row
    keyed = placed.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("id") % F.col("c"))
    texts = keyed.join(decoded(spark, sf_dir).select("vec_id", "text", "score"), "vec_id").select("page", "box_idx", "text", "score")
    angles = keyed.join(orientation(spark, sf_dir), "vec_id").select("page", "box_idx", "angle")
    return placed.select("page"), placed, texts, angles


@query(f"WITH {_ITEMS} SELECT q.page, CAST(count(i.id) AS INT) AS text_count, coalesce(string_agg(i.text, '|' ORDER BY i.box_idx), '') AS texts, round(coalesce(sum(i.score), 0), 4) AS score_sum, coalesce(CAST(sum(i.angle) AS BIGINT), 0) AS angle_sum, coalesce(CAST(sum(i.p[1][1]) AS BIGINT), 0) AS x_sum FROM (SELECT DISTINCT page FROM quads) q LEFT JOIN items i ON q.page = i.page GROUP BY q.page")
def assemble(spark, sf_dir):
    return totals(assembly.assemble(*_items(spark, sf_dir)))


def totals(results: DataFrame) -> DataFrame:
    """Totals of each result's items."""

    def total(f, zero):
        return F.aggregate("items", zero, lambda t, i: t + f(i))

    return results.select(
        "page", "text_count", F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("texts"),
        F.round(total(lambda i: i["score"], F.lit(0.0)), 4).alias("score_sum"),
        total(lambda i: i["angle"].cast("long"), F.lit(0).cast("long")).alias("angle_sum"),
        total(lambda i: i["polygon"][0][0].cast("long"), F.lit(0).cast("long")).alias("x_sum"),
    )


_BAND_SQL = "CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'mid' ELSE 'low' END"


@query(f"""WITH b AS (SELECT event_id AS id, (event_id%101)/100.0 AS s, CAST(event_id%2 AS INT) AS angle FROM events), c AS (SELECT *, {_BAND_SQL} AS band FROM b)
 SELECT id, band, CASE angle WHEN 1 THEN CASE band WHEN 'high' THEN '#c800c8' WHEN 'mid' THEN '#c864c8' ELSE '#6400c8' END ELSE CASE band WHEN 'high' THEN '#00c800' WHEN 'mid' THEN '#ffc800' ELSE '#ff0000' END END AS colour FROM c""")
def color_bucket(spark, sf_dir):
    s, angle = F.col("id") % 101 / 100, F.col("id") % 2
    return boxes(spark, sf_dir).select("id", X.score_band(s).alias("band"), X.colour(s, angle).alias("colour"))


@query(f"""WITH {_QUADS}, f AS (SELECT id, p, CAST(id%2 AS INT) AS angle, greatest(12, CAST(floor((id%5000+1)/200.0) AS INT)) AS font FROM quads)
 SELECT id, font, CAST(CASE WHEN angle=1 THEN p[2][1]+4 ELSE p[1][1] END AS INT) AS x, CAST(CASE WHEN angle=1 THEN p[1][2] ELSE p[1][2]-font-2 END AS INT) AS y FROM f""")
def label_geometry(spark, sf_dir):
    font, x, y = X.label_place(F.col("polygon"), F.col("id") % 2, F.col("id") % 5000 + 1)
    return quads(spark, sf_dir).select("id", font.alias("font"), x.alias("x"), y.alias("y"))


@query(f"WITH {_ITEMS} SELECT page, box_idx, CAST(i-1 AS INT) AS pos, text[i] AS ch, CAST(p[1][2]+(i-1)*12 AS INT) AS y FROM (SELECT *, unnest(range(1, length(text)+1)) AS i FROM items WHERE angle = 1)")
def vertical_labels(spark, sf_dir):
    """Characters of turned labels, one below the other."""
    _, placed, texts, angles = _items(spark, sf_dir)
    rows = placed.join(assembly.text_filter(texts), ["page", "box_idx"]).join(angles.where("angle = 1"), ["page", "box_idx"])
    chars = rows.select("page", "box_idx", "polygon", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    return chars.select("page", "box_idx", "pos", "ch", (F.col("polygon")[0][1] + F.col("pos") * 12).alias("y"))


_WORDS = "list_distinct(list_filter(string_split_regex({}, '[ \\t\\n]+'), lambda w: w <> ''))"


@query(f"""WITH a AS (SELECT doc_id, {_WORDS.format('text')} AS a FROM documents), b AS (SELECT doc_id-1 AS doc_id, {_WORDS.format('text')} AS b FROM documents),
 c AS (SELECT doc_id, CAST(len(list_intersect(a,b)) AS BIGINT) AS common, CAST(len(a)+len(b)-len(list_intersect(a,b)) AS BIGINT) AS either FROM a JOIN b USING (doc_id))
 SELECT doc_id, common, either, round(CASE WHEN either>0 THEN common/CAST(either AS DOUBLE) ELSE 1 END,6) AS jaccard FROM c""")
def jaccard(spark, sf_dir):
    """Agreement of each document's words with the next one's, as two results of an image would be compared."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = assembly.token_jaccard(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id")
    return found.select("doc_id", "common", "either", *_round("jaccard"))


@query(f"WITH {_decoded_sql()} SELECT CAST(count(*) AS BIGINT) AS results, CAST(count(*) FILTER (text <> '') AS BIGINT) AS detections, CAST(sum(length(text)) AS BIGINT) AS characters FROM decoded")
def corpus_totals(spark, sf_dir):
    """Totals over all results."""
    return decoded(spark, sf_dir).agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("text") != "").alias("detections"), F.sum(F.length("text")).alias("characters"))
