"""Queries over boxes, lines and ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import geometry
from lectern.functions.geometry import Box
from lectern.operators import joins, windows
from lectern.plans import fixtures as fx
from lectern.plans.fixtures import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_COLUMN = "CASE WHEN x0 < 735 AND x1 > 765 THEN NULL WHEN (x0 + x1) / 2 < 750 THEN 0 ELSE 1 END"


@query(f"""WITH {fx.BLOCKS_SQL}, c AS (SELECT *, page % 2 = 0 AS two, {_COLUMN} AS col FROM blocks), b AS (SELECT *, CASE WHEN NOT two THEN 1 WHEN col IS NOT NULL THEN 1 WHEN y1 <= 1400 * 0.18 THEN 0 WHEN y0 >= 1400 * 0.85 THEN 3 ELSE 2 END AS band FROM c)
SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN two THEN coalesce(col, 0) ELSE 0 END, CASE WHEN two THEN y0 ELSE 0 END, CASE WHEN two THEN x0 ELSE 0 END, pos) - 1 AS INT) AS reading_order, CAST(band AS INT) AS band FROM b""")
def reading_order_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages have a gutter at 750, odd ones are single columns."""
    b = fx.blocks(spark, sf_dir).withColumn("gutter", F.when(F.col("page") % 2 == 0, 750.0))
    return windows.reading_order(b, "page", "pos", F.lit(1500.0), F.lit(1400.0), F.col("gutter")).select("page", "pos", "reading_order", "band")


_NORMAL = "n AS (SELECT page, pos, x0 / 1500 AS x0, y0 / 1400 AS y0, x1 / 1500 AS x1, y1 / 1400 AS y1 FROM blocks)"


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.blocks(spark, sf_dir).selectExpr("page", "pos", "x0 / 1500 as x0", "y0 / 1400 as y0", "x1 / 1500 as x1", "y1 / 1400 as y1")


@query(f"""WITH {fx.BLOCKS_SQL}, {_NORMAL}, z AS (SELECT *, CASE WHEN y0 < 0.08 THEN 0 WHEN y0 >= 0.92 THEN 2 ELSE 1 END AS z FROM n) SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY z, CASE WHEN z = 1 THEN 0 ELSE y0 END, CASE WHEN z = 1 THEN 0 ELSE x0 END, pos) - 1 AS INT) AS content_order FROM z""")
def margin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.margin_order(_normal(spark, sf_dir), "page", "pos").select("page", "pos", "content_order")


_ZONE = "CASE WHEN y0 < 0.08 THEN 'top_margin' WHEN y0 >= 0.92 THEN 'bottom_margin' WHEN x0 < 0.2 AND x1 > 0.8 THEN 'spanning_body' WHEN (x0 + x1) / 2 < 0.5 THEN 'left_body' ELSE 'right_body' END"


@query(f"WITH {fx.BLOCKS_SQL}, {_NORMAL} SELECT {_ZONE} AS zone, count(*) AS n FROM n GROUP BY 1")
def layout_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).groupBy(geometry.layout_zone(Box.of()).alias("zone")).agg(F.count("*").alias("n"))


_STREAM = "f AS (SELECT user_id AS page, event_id AS pos, (user_id % 10) / 100.0::DOUBLE + (event_id % 3) / 100.0::DOUBLE AS x0, 0.5::DOUBLE AS x1, 0.1 + (event_id % 7) / 500.0::DOUBLE AS y0, 0.1 + (event_id % 7) / 500.0::DOUBLE + 0.01 AS y1, event_type = 'signup' AS anchored, event_type = 'error' AS after_image FROM events)"


@query(f"""WITH {_STREAM}, z AS (SELECT *, {_ZONE} AS zone FROM f), l AS (SELECT *, lag(zone) OVER w AS pz, x0 - lag(x0) OVER w AS dx, y0 - lag(y1) OVER w AS dy, row_number() OVER w AS rn FROM z WINDOW w AS (PARTITION BY page ORDER BY pos)),
b AS (SELECT *, CASE WHEN rn = 1 THEN 0 WHEN zone = pz AND dx >= -0.005 - 1e-12 AND dx <= 0.05 + 1e-12 AND dy >= -0.005 - 1e-12 AND dy <= 0.028 + 1e-12 AND NOT anchored AND NOT after_image THEN 0 ELSE 1 END AS brk FROM l) SELECT page, pos, sum(brk) OVER (PARTITION BY page ORDER BY pos)::BIGINT AS block FROM b""")
def flow_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "user_id as page", "event_id as pos", "(user_id % 10) / 100.0D + (event_id % 3) / 100.0D as x0", "0.5D as x1", "0.1D + (event_id % 7) / 500.0D as y0", "0.1D + (event_id % 7) / 500.0D + 0.01D as y1",
        "event_type = 'signup' as anchored", "event_type = 'error' as after_image",
    )
    return windows.flow_blocks(e, "page", "pos").select("page", "pos", "block")


@query("WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l), g AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run) SELECT user_id, max(n) AS longest_run, arg_max(n, run) AS trailing_run FROM g GROUP BY user_id")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_summary(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("WITH v AS (SELECT DISTINCT l_suppkey AS s, CAST(l_partkey % 900 AS DOUBLE) AS v FROM lineitem), l AS (SELECT s, v, CASE WHEN v - lag(v) OVER (PARTITION BY s ORDER BY v) > 12 THEN 1 ELSE 0 END AS b FROM v), g AS (SELECT s, v, sum(b) OVER (PARTITION BY s ORDER BY v) AS cluster FROM l) SELECT s, cluster::BIGINT AS cluster, avg(v) AS position, count(*) AS members FROM g GROUP BY s, cluster")
def merge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 900).cast("double").alias("v")).distinct()
    return windows.merged_positions(v, "s", "v", 12.0)


@query(f"WITH {fx.EVENTS_SQL} SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS filled FROM sparse")
def fill_forward_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fill_both_ways(fx.sparse_events(spark, sf_dir), "user_id", "event_id", "value", F.lit(1.0)).select("event_id", "filled")


@query(f"WITH {fx.BLOCKS_SQL}, p AS (SELECT page, pos, y0, y1, lead(y0) OVER (PARTITION BY page ORDER BY y0, pos) - y0 AS pitch FROM blocks) SELECT page, pos, pitch FROM p WHERE pitch BETWEEN 0.8 * (y1 - y0) AND 1.8 * (y1 - y0)")
def adjacent_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pitches(fx.blocks(spark, sf_dir), ["page"], ["y0", "pos"]).select("page", "pos", "pitch")


@query(f"WITH {fx.BLOCKS_SQL}, c AS (SELECT DISTINCT page, (y0 + y1) / 2 AS c FROM blocks), n AS (SELECT page, c, lag(c) OVER w AS b, lead(c) OVER w AS a FROM c WINDOW w AS (PARTITION BY page ORDER BY c)) SELECT page, c AS center, CASE WHEN b IS NOT NULL THEN (b + c) / 2 ELSE c - (a - c) / 2 END AS lower, CASE WHEN a IS NOT NULL THEN (c + a) / 2 ELSE c + (c - b) / 2 END AS upper FROM n")
def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.blocks(spark, sf_dir).select("page", ((F.col("y0") + F.col("y1")) / 2).alias("center")).distinct()
    return windows.midpoint_bounds(c, "page", "center")


_BOTH = f"WITH {fx.BLOCKS_SQL}, {fx.REGIONS_SQL}, "


@query(_BOTH + """m AS (SELECT b.page, b.pos, r.pos AS k, greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / greatest(1, b.y1 - b.y0) AS v, greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) / greatest(1, b.x1 - b.x0) AS h FROM blocks b JOIN regions r USING (page)),
g AS (SELECT page, pos, arg_max(k, (v * 0.7 + h * 0.3, -k)) AS match, max(v * 0.7 + h * 0.3) AS score FROM m WHERE v >= 0.45 AND h >= 0.25 GROUP BY page, pos) SELECT page, pos, match, score FROM blocks LEFT JOIN g USING (page, pos)""")
def best_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.best_overlap(fx.blocks(spark, sf_dir), fx.regions(spark, sf_dir), "page", "pos", "pos").select("page", "pos", "match", "score")


@query(_BOTH + """m AS (SELECT b.page, b.pos, r.pos AS k, greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) * greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) / (greatest(1, b.y1 - b.y0) * greatest(1, b.x1 - b.x0)) AS ratio FROM blocks b JOIN regions r USING (page)),
g AS (SELECT page, pos, arg_max(k, (ratio, -k)) AS k, max(ratio) AS ratio FROM m GROUP BY page, pos) SELECT page, pos, CASE WHEN ratio >= 0.5 THEN k END AS region, CASE WHEN ratio >= 0.5 THEN ratio END AS ratio FROM blocks LEFT JOIN g USING (page, pos)""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.containing_region(fx.blocks(spark, sf_dir), fx.regions(spark, sf_dir), "page", "pos", "pos").select("page", "pos", "region", "ratio")


@query(_BOTH + "c AS (SELECT b.page, b.pos, r.pos AS cell FROM blocks b JOIN regions r USING (page) WHERE (b.x0 + b.x1) / 2 BETWEEN r.x0 - 8 AND r.x1 + 8 AND (b.y0 + b.y1) / 2 BETWEEN r.y0 - 8 AND r.y1 + 8) SELECT page, pos, cell FROM c")
def center_in_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.centers_in_boxes(fx.blocks(spark, sf_dir), fx.regions(spark, sf_dir), "page", 8.0).select("page", "pos", F.col("c_pos").alias("cell"))


_EDGES = "e AS (SELECT o_orderkey AS page, [0.0, 200.0, 450.0, 800.0 + o_orderkey % 400] AS edges FROM orders)"


@query(f"WITH {fx.BLOCKS_SQL}, {_EDGES}, v AS (SELECT page, pos, (y0 + y1) / 2 AS v, edges FROM blocks LEFT JOIN e USING (page)) SELECT page, pos, CAST(CASE WHEN v < edges[1] OR v > edges[4] OR edges IS NULL THEN NULL WHEN v = edges[4] THEN 2 ELSE len(list_filter(edges, lambda x: x <= v)) - 1 END AS INT) AS interval FROM v")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.array(F.lit(0.0), F.lit(200.0), F.lit(450.0), (800.0 + F.col("o_orderkey") % 400).cast("double")).alias("edges"))
    b = fx.blocks(spark, sf_dir)
    return joins.interval_index(b, edges, "page", (F.col("y0") + F.col("y1")) / 2).select("page", "pos", F.col("interval").cast("int").alias("interval"))


_COLS = "cols AS (SELECT o_orderkey AS page, CAST(k AS INT) AS c_index, k * 400.0::DOUBLE AS c0, k * 400.0::DOUBLE + 380 AS c1 FROM orders, range(0, 4) t(k))"


@query(f"WITH {fx.BLOCKS_SQL}, {_COLS} SELECT page, pos, c_index FROM blocks JOIN cols USING (page) WHERE greatest(0, least(x1, c1) - greatest(x0, c0)) >= (x1 - x0) * 0.05")
def column_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c_index")).selectExpr("page", "c_index", "c_index * 400.0D as c0", "c_index * 400.0D + 380 as c1")
    return joins.overlapping_columns(fx.blocks(spark, sf_dir), cols, "page").select("page", "pos", "c_index")


@query(_BOTH + "m AS (SELECT b.page, b.pos, r.pos AS i, abs((b.y0 + b.y1) / 2 - (r.y0 + r.y1) / 2) AS d FROM blocks b JOIN regions r USING (page)) SELECT page, pos, arg_min(i, (d, i)) AS nearest, min(d) AS distance FROM m GROUP BY page, pos")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.regions(spark, sf_dir).select("page", F.col("pos").alias("index"), ((F.col("y0") + F.col("y1")) / 2).alias("center"))
    return joins.nearest_center(fx.blocks(spark, sf_dir), c, "page", "pos", (F.col("y0") + F.col("y1")) / 2)


@query(_BOTH + "b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM blocks), m AS (SELECT b.page, b.pos, r.pos AS k, greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) * greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) AS i, w * h AS a, (r.x1 - r.x0) * (r.y1 - r.y0) AS c FROM b JOIN regions r USING (page)) SELECT page, pos, k, i / greatest(1, a + c - i) AS iou, CASE WHEN a > 0 THEN i / a ELSE 0 END AS coverage FROM m WHERE i > 0")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.regions(spark, sf_dir).selectExpr("page as r_page", "pos as k", "x0 as r_x0", "y0 as r_y0", "x1 as r_x1", "y1 as r_y1")
    a, b = Box.of(), Box.of("r_")
    met = fx.blocks(spark, sf_dir).join(r, F.col("page") == F.col("r_page")).where(geometry.intersection(a, b) > 0)
    return met.select("page", "pos", "k", geometry.iou_pixels(a, b).alias("iou"), geometry.coverage(a, b).alias("coverage"))


@query(f"WITH {fx.BLOCKS_SQL} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members FROM blocks GROUP BY page")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.blocks(spark, sf_dir).groupBy("page").agg(*geometry.union_box(), F.count("*").alias("members"))


@query("SELECT coalesce(o.k, c.k) AS k, o.v AS left_value, c.v AS right_value FROM (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey AS k, 1 + c_custkey % 20 AS v FROM customer) c USING (k) WHERE o.v IS DISTINCT FROM c.v")
def full_outer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 20).alias("v"))
    return joins.differing(a, b, ["k"], "v")


_NODES = "g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'table' ELSE 'text' END AS kind, p_name AS text, p_type AS role FROM part WHERE p_partkey % 10 <> 3), p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'table' ELSE 'text' END AS kind, replace(p_name, 'e', '') AS text, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'ECONOMY' END AS role FROM part WHERE p_partkey % 10 <> 4)"


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    gold = p.where("p_partkey % 10 <> 3").selectExpr("p_partkey as id", "case when p_partkey % 7 = 0 then 'table' else 'text' end as kind", "p_name as text", "p_type as role")
    predicted = p.where("p_partkey % 10 <> 4").selectExpr("p_partkey as id", "case when p_partkey % 6 = 0 then 'table' else 'text' end as kind", "replace(p_name, 'e', '') as text", "case when p_size % 3 = 0 then p_type else 'ECONOMY' end as role")
    return gold, predicted


@query(f"WITH {_NODES} SELECT id, coalesce(g.text, '') AS reference, CASE WHEN g.kind <> p.kind THEN '' ELSE coalesce(p.text, '') END AS prediction FROM g FULL JOIN p USING (id)")
def aligned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.aligned_texts(*_nodes(spark, sf_dir), ["id"])


@query(f"WITH {_NODES} SELECT id, coalesce(g.role, '<prediction-only>') AS reference, CASE WHEN p.role IS NULL THEN '<missing>' WHEN g.kind <> p.kind THEN '<kind-mismatch>' ELSE p.role END AS prediction FROM g FULL JOIN p USING (id)")
def aligned_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.aligned_roles(*_nodes(spark, sf_dir), ["id"])


@query("SELECT 'missing' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'unexpected', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return joins.coverage_difference(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT l_orderkey AS k, min(l_partkey) AS part FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def one_owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_owner(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part")), "k", "part")


@query(f"WITH {fx.BLOCKS_SQL}, {fx.REGIONS_SQL}, b AS (SELECT page, pos, (x1 - x0) / (y1 - y0) / 10 AS a FROM blocks), r AS (SELECT page, pos, (x1 - x0) / (y1 - y0) * (1 + pos) AS a FROM regions), m AS (SELECT b.page, b.pos, r.pos AS k FROM b JOIN r USING (page) WHERE abs(ln(b.a) - ln(r.a)) <= ln(1.25)) SELECT page, pos, min(k) AS match FROM m GROUP BY page, pos HAVING count(*) = 1")
def unique_ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    b = fx.blocks(spark, sf_dir).selectExpr("page", "pos", "(x1 - x0) / (y1 - y0) / 10 as a")
    r = fx.regions(spark, sf_dir).selectExpr("page", "pos", "(x1 - x0) / (y1 - y0) * (1 + pos) as a")
    return joins.unique_ratio_match(b, r, "page", "pos", "a", math.log(1.25))


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) SELECT event_id, CAST(p // 32 AS INT) AS segment, CAST(p % 32 AS INT) AS place, len(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS n_before FROM s")
def segments_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.bucketed(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 32, 4, "event_id")
    return s.select("event_id", "segment", "place", F.nullif(F.size("before"), F.lit(0)).alias("n_before"))


@query("SELECT event_id, coalesce(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS started FROM events")
def running_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.started(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "started")


#: Steps of the example log that are allowed.
LEGAL = [(a, b) for a in ("view", "click", "purchase", "signup") for b in ("view", "click", "signup", "error") if a != b]


@query("WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) SELECT event_id, from_state, event_type FROM s WHERE from_state IS NOT NULL AND NOT (from_state IN ('view', 'click', 'purchase', 'signup') AND event_type IN ('view', 'click', 'signup', 'error') AND from_state <> event_type)")
def state_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.illegal_transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", LEGAL).select("event_id", "from_state", "event_type")


@query("WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 3 + event_id % 3 AS INT) END AS page, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS explicit FROM events), h AS (SELECT *, max(page) OVER past AS high, sum(explicit) OVER run AS cum FROM s WINDOW past AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), run AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, max(CASE WHEN page IS NOT NULL THEN cum END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM h) SELECT event_id, (explicit + CASE WHEN page > high THEN greatest(0, page - high - (cum - coalesce(seen, 0))) ELSE 0 END)::BIGINT AS breaks, coalesce(page < high, FALSE) AS regression FROM k")
def page_break_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.floor(rn / 3) + F.col("event_id") % 3).cast("int").alias("page"), F.when(F.col("event_id") % 11 == 0, 1).otherwise(0).alias("explicit"))
    return windows.page_breaks(s, "user_id", "event_id", "page", "explicit").select("event_id", F.col("breaks").cast("long").alias("breaks"), "regression")
