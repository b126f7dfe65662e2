"""Queries: raster analysis, graphs, point clouds, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cloud, graph, nearest, plugins, raster, sampling
from ..operators.raster import KEYS, assign_obstacles
from ..operators.runs import best_run_per_column, merge_runs
from ..scratch import settle
from .base import query
from .queries_names import MERGED_LABELS

EDGES = """e0 AS (SELECT image_id, mask_key, r, CAST(min(c0) AS DOUBLE) AS lo, CAST(max(c1) AS DOUBLE) AS hi FROM fx_mask_runs WHERE class_name = 'sidewalk' GROUP BY ALL),
e1 AS (SELECT *, lo < 3 AS cl, hi >= 637 AS cr FROM e0),
ft AS (SELECT image_id, mask_key, regr_slope(lo, r) AS al, regr_intercept(lo, r) AS bl, regr_slope(hi, r) AS ar, regr_intercept(hi, r) AS br, count(*) AS n FROM e1 WHERE NOT cl AND NOT cr GROUP BY ALL),
e2 AS (SELECT e1.image_id, e1.mask_key, r, CASE WHEN cl AND coalesce(n, 0) >= 2 THEN al * r + bl ELSE lo END AS lo, CASE WHEN cr AND coalesce(n, 0) >= 2 THEN ar * r + br ELSE hi END AS hi,
  (NOT cl AND NOT cr) OR coalesce(n, 0) >= 2 AS valid, coalesce(n, 0) >= 2 AND (cl OR cr) AS ex FROM e1 LEFT JOIN ft ON e1.image_id = ft.image_id AND e1.mask_key = ft.mask_key)"""
WIDTHS = f"""{EDGES},
w0 AS (SELECT image_id, mask_key, r, 1.8::DOUBLE * (hi - lo) / (r - 240.0::DOUBLE) * 100 AS w FROM e2 WHERE valid AND r > 260 AND NOT ex),
q AS (SELECT image_id, mask_key, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.75) AS q3 FROM w0 GROUP BY ALL),
w1 AS (SELECT w0.*, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM w0 JOIN q USING (image_id, mask_key)),
w2 AS (SELECT *, w BETWEEN lo AND hi AS inlier FROM w1)"""


def edges_of(d):
    return raster.row_edges(d.fx_mask_runs.where("class_name = 'sidewalk'"), 640)


def whole(d):
    e = edges_of(d)
    return raster.extrapolate_edges(e, raster.edge_fit(e))


@query("row_edges", f"WITH {EDGES} SELECT image_id, mask_key, r, lo AS left, hi AS right, NOT cl AND NOT cr AS valid FROM e1")
def _(d):
    return edges_of(d).select(*KEYS, "r", "left", "right", "valid")


@query("edge_fit", f"WITH {EDGES} SELECT image_id, mask_key, round(al, 6) AS a_left, round(bl, 6) AS b_left, round(ar, 6) AS a_right, round(br, 6) AS b_right, n AS n_valid FROM ft")
def _(d):
    f = raster.edge_fit(edges_of(d))
    return f.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("a_left", "b_left", "a_right", "b_right")], "n_valid")


@query("extrapolate_edges", f"WITH {EDGES} SELECT image_id, mask_key, r, round(lo, 6) AS left, round(hi, 6) AS right, valid, ex AS extrapolated FROM e2")
def _(d):
    return whole(d).select(*KEYS, "r", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "valid", "extrapolated")


@query("filter_width_rows", f"WITH {EDGES} SELECT image_id, mask_key, count(*) AS rows_valid, count(*) FILTER (r <= 240) AS above_horizon, count(*) FILTER (r > 240 AND r <= 260) AS near_horizon, count(*) FILTER (r > 260 AND ex) AS extrapolated_rows FROM e2 WHERE valid GROUP BY ALL")
def _(d):
    return raster.filter_width_rows(whole(d), 480)[1]


@query("iqr_fence", f"WITH {WIDTHS} SELECT image_id, mask_key, r, round(w, 4) AS width_cm, round(lo, 4) AS lo, round(hi, 4) AS hi, inlier FROM w2")
def _(d):
    rows = raster.width_rows(d.fx_mask_runs)[0]
    return rows.select(*KEYS, "r", *[F.round(c, 4).alias(c) for c in ("width_cm", "lo", "hi")], "inlier")


@query("mad_filter", "WITH m AS (SELECT *, quantile_cont(predicted_width, 0.5) OVER (PARTITION BY id % 40) AS med FROM fx_predictions), dv AS (SELECT *, abs(predicted_width - med) AS dv FROM m), k AS (SELECT *, quantile_cont(dv, 0.5) OVER (PARTITION BY id % 40) AS mad FROM dv) SELECT id, dv < 3 * (mad * 1.4826::DOUBLE + 0.000001::DOUBLE) AS inlier FROM k")
def _(d):
    return raster.mad_filter(d.fx_predictions.withColumn("g", F.col("id") % 40), ["g"], "predicted_width").select("id", "inlier")


STATS = f"""{WIDTHS}, s0 AS (SELECT image_id, mask_key, round(quantile_cont(w, 0.5), 4) AS median_cm, round(avg(w), 4) AS mean_cm, round(stddev_pop(w), 4) AS std_cm, round(min(w), 4) AS min_cm, round(max(w), 4) AS max_cm, count(*) AS rows_used FROM w2 WHERE inlier GROUP BY ALL)"""


@query("width_stats", f"WITH {STATS}, o AS (SELECT image_id, mask_key, count(*) FILTER (NOT inlier) AS outlier_rows FROM w2 GROUP BY ALL) SELECT s0.*, outlier_rows FROM s0 JOIN o USING (image_id, mask_key)")
def _(d):
    s = raster.width_stats(*raster.width_rows(d.fx_mask_runs))
    return s.select(*KEYS, *[F.round(c, 4).alias(c) for c in ("median_cm", "mean_cm", "std_cm", "min_cm", "max_cm")], "rows_used", "outlier_rows")


@query("estimate_width", f"""WITH {STATS}, m AS (SELECT DISTINCT image_id, mask_key FROM fx_mask_runs WHERE class_name = 'sidewalk'), va AS (SELECT DISTINCT image_id, mask_key, true AS v FROM e2 WHERE valid)
SELECT m.image_id, m.mask_key, median_cm, mean_cm, std_cm, min_cm, max_cm, rows_used, CASE WHEN v IS NULL THEN 'no_valid_edges' WHEN rows_used IS NULL THEN 'no_rows' ELSE 'ok' END AS status FROM m LEFT JOIN s0 USING (image_id, mask_key) LEFT JOIN va USING (image_id, mask_key)""")
def _(d):
    s = raster.estimate_width(d.fx_mask_runs)
    return s.select(*KEYS, *[F.round(c, 4).alias(c) for c in ("median_cm", "mean_cm", "std_cm", "min_cm", "max_cm")], "rows_used", "status")


@query("width_profile", f"""WITH {WIDTHS}, n AS (SELECT *, count(*) OVER (PARTITION BY image_id, mask_key) AS k, row_number() OVER (PARTITION BY image_id, mask_key ORDER BY r) AS i FROM w2), md AS (SELECT image_id, mask_key, quantile_cont(w, 0.5) AS med FROM w2 WHERE inlier GROUP BY ALL)
SELECT n.image_id, n.mask_key, r, round(w, 4) AS width_cm, inlier, round(med, 4) AS median_cm, i IN (floor(k * 0.25) + 1, floor(k * 0.5) + 1, floor(k * 0.75) + 1) AS sampled FROM n LEFT JOIN md USING (image_id, mask_key)""")
def _(d):
    p = raster.width_profile(raster.width_rows(d.fx_mask_runs)[0])
    return p.select(*KEYS, "r", F.round("width_cm", 4).alias("width_cm"), "inlier", F.round("median_cm", 4).alias("median_cm"), "sampled")


def span(d):
    return whole(d).where("valid").groupBy(*KEYS).agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"))


SCALE = f"""{EDGES}, sp AS (SELECT image_id, mask_key, min(r) AS f, max(r) AS l FROM e2 WHERE valid GROUP BY ALL),
vy AS (SELECT ft.image_id, ft.mask_key, CASE WHEN n >= 2 AND abs(al - ar) > 0.000001::DOUBLE THEN (br - bl) / (al - ar) ELSE -100000000.0::DOUBLE END AS vy, CASE WHEN n >= 2 THEN f ELSE 0 END AS f, CASE WHEN n >= 2 THEN l ELSE 479 END AS l FROM ft JOIN sp ON ft.image_id = sp.image_id AND ft.mask_key = sp.mask_key),
sc AS (SELECT image_id, mask_key, CAST(r AS INTEGER) AS r, CASE WHEN NOT r BETWEEN f AND l THEN 1.0::DOUBLE WHEN r = vy THEN 6.0::DOUBLE ELSE least(pow(abs(l - vy) / abs(r - vy), 2), 6.0::DOUBLE) END AS scale FROM vy, (SELECT unnest(generate_series(0, 479)) AS r)),
cu AS (SELECT *, sum(scale) OVER (PARTITION BY image_id, mask_key ORDER BY r) - first(scale) OVER (PARTITION BY image_id, mask_key ORDER BY r) AS cum FROM sc)"""


@query("row_scale_cumsum", f"WITH {SCALE} SELECT image_id, mask_key, r, round(scale, 5) AS scale, round(cum, 4) AS cum FROM cu")
def _(d):
    s = raster.row_scale_cumsum(raster.edge_fit(edges_of(d)), span(d), 480)
    return s.select(*KEYS, "r", F.round("scale", 5).alias("scale"), F.round("cum", 4).alias("cum"))


@query("rectify_row_map", f"""WITH {SCALE}, nx AS (SELECT image_id, mask_key, r, cum, lead(cum) OVER (PARTITION BY image_id, mask_key ORDER BY r) AS nxt FROM cu),
ou AS (SELECT *, unnest(generate_series(CAST(ceil(round(cum, 9)) AS BIGINT), coalesce(CAST(ceil(round(nxt, 9)) AS BIGINT) - 1, CAST(ceil(round(cum, 9)) AS BIGINT)))) AS out_r FROM nx)
SELECT image_id, mask_key, CAST(out_r AS INTEGER) AS out_r, round(least(r + coalesce((out_r - cum) / (nxt - cum), 0.0::DOUBLE), 479.0::DOUBLE), 3) AS src_r FROM ou""")
def _(d):
    s = raster.row_scale_cumsum(raster.edge_fit(edges_of(d)), span(d), 480)
    return raster.rectify_row_map(s, 480).select(*KEYS, "out_r", F.round("src_r", 3).alias("src_r"))


def strips(d):
    e = edges_of(d)
    fit = raster.edge_fit(e)
    return raster.rectify_masks(d.fx_mask_runs, assign_obstacles(d.fx_mask_runs), raster.extrapolate_edges(e, fit), None, 640, 480)


@query("rectify_masks")
def _(d):
    return strips(d)[0]


@query("estimate_footprint")
def _(d):
    return raster.estimate_footprint(*(settle(x, "strips") for x in strips(d)))[0]


@query("footprint_metadata")
def _(d):
    rect, dims = (settle(x, "strips") for x in strips(d))
    return raster.footprint_metadata(rect, raster.estimate_footprint(rect, dims)[1], dims)


@query("component_bbox", "SELECT image_id, class_name AS comp_id, min(r) AS min_row, min(c0) AS min_col, max(r) + 1 AS max_row, max(c1) + 1 AS max_col, CAST(sum(c1 - c0 + 1) AS BIGINT) AS area, max(r) + 1 - min(r) AS height FROM fx_mask_runs GROUP BY ALL")
def _(d):
    return raster.component_bbox(d.fx_mask_runs.withColumn("comp_id", F.col("class_name")), ["image_id"])


@query("connected_components", """WITH RECURSIVE c AS (SELECT image_id, mask_key, r, c0, c1, max(c1) OVER (PARTITION BY image_id, mask_key, r ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_mask_runs),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR c0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, mask_key, r ORDER BY c0, c1) AS run FROM c),
m AS (SELECT image_id, mask_key, r, min(c0) AS c0, max(c1) AS c1, row_number() OVER (ORDER BY image_id, mask_key, r, min(c0)) AS id FROM n GROUP BY image_id, mask_key, r, run),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.image_id = b.image_id AND a.mask_key = b.mask_key AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
w(id, lead) AS (SELECT id, id FROM m UNION SELECT e.b, w.lead FROM w JOIN e ON e.a = w.id WHERE w.lead < e.b),
l AS (SELECT id, min(lead) AS lead FROM w GROUP BY id)
SELECT m.image_id, m.mask_key, m.r, m.c0, m.c1, count(*) OVER (PARTITION BY l.lead) AS runs_of_component, min(m.r) OVER (PARTITION BY l.lead) AS first_row FROM m JOIN l USING (id)""")
def _(d):
    got = graph.mask_components(merge_runs(d.fx_mask_runs, [*KEYS, "r"]), KEYS)
    w = W.partitionBy(*KEYS, "comp_id")
    return got.select(*KEYS, "r", "c0", "c1", F.count("*").over(w).alias("runs_of_component"), F.min("r").over(w).alias("first_row"))


# ---------------------------------------------------------------- streets


#: A walk along halves from each that has none before it; rings are walked from each of their halves and cut at the smallest node.
CHAINS = """s AS (SELECT edge_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length DESC, edge_id) AS rn FROM fx_edges) WHERE rn = 1),
dg AS (SELECT node FROM (SELECT u AS node FROM s UNION ALL SELECT v FROM s) GROUP BY node HAVING count(*) = 2),
h AS (SELECT edge_id, u, v FROM s WHERE u <> v UNION ALL SELECT edge_id, v, u FROM s WHERE u <> v),
nx AS (SELECT a.edge_id AS e, a.u AS eu, b.edge_id AS ne, b.u AS nu, b.v AS nv FROM h a JOIN dg ON dg.node = a.v JOIN h b ON b.u = a.v AND b.edge_id <> a.edge_id),
w(se, su, edge_id, u, v, pos) AS (SELECT edge_id, u, edge_id, u, v, 0 FROM h WHERE NOT EXISTS (SELECT 1 FROM nx WHERE nx.ne = h.edge_id AND nx.nu = h.u)
  UNION ALL SELECT w.se, w.su, nx.ne, nx.nu, nx.nv, w.pos + 1 FROM w JOIN nx ON nx.e = w.edge_id AND nx.eu = w.u),
lw AS (SELECT se, su, arg_min(v, pos) AS sv, arg_max(edge_id, pos) AS le, arg_max(u, pos) AS lu, arg_max(v, pos) AS lv FROM w GROUP BY se, su),
rh AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.edge_id = h.edge_id AND w.u = h.u)),
r(se, su, edge_id, u, v, pos) AS (SELECT edge_id, u, edge_id, u, v, 0 FROM rh UNION ALL SELECT r.se, r.su, nx.ne, nx.nu, nx.nv, r.pos + 1 FROM r JOIN nx ON nx.e = r.edge_id AND nx.eu = r.u WHERE NOT (nx.ne = r.se AND nx.nu = r.su)),
lr AS (SELECT se, su, arg_max(edge_id, pos) AS le, arg_max(u, pos) AS lu FROM r GROUP BY se, su HAVING su = min(u) QUALIFY row_number() OVER (PARTITION BY su ORDER BY arg_min(v, pos), se) = 1),
ch AS (SELECT lw.le || '>' || lw.lu AS chain_id, w.pos, w.edge_id, w.u, w.v, false AS closed FROM w JOIN lw USING (se, su) WHERE (lw.su, lw.sv, lw.se) <= (lw.lv, lw.lu, lw.le)
  UNION ALL SELECT lr.le || '>' || lr.lu, r.pos, r.edge_id, r.u, r.v, true FROM r JOIN lr USING (se, su))"""


@query("chain_decompose", f"WITH RECURSIVE {CHAINS} SELECT * FROM ch")
def _(d):
    return graph.chain_decompose(d.fx_edges)


def nodes(d):
    ids = d.fx_edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return ids.select("node_id", (40.96 + (F.col("node_id") % 10) * 0.0002 + F.floor(F.col("node_id") / 100) * 0.00001).alias("lat"), (29.04 + F.floor(F.col("node_id") % 1000 / 10) * 0.0003).alias("lon"))


@query("chain_geometry", f"""WITH RECURSIVE {CHAINS},
nd AS (SELECT node_id, (29.04::DOUBLE + floor(node_id % 1000 / 10.0::DOUBLE) * 0.0003::DOUBLE) * 84000 AS x, (40.96::DOUBLE + (node_id % 10) * 0.0002::DOUBLE + floor(node_id / 100.0::DOUBLE) * 0.00001::DOUBLE) * 111000 AS y FROM (SELECT u AS node_id FROM fx_edges UNION SELECT v FROM fx_edges)),
lg AS (SELECT ch.chain_id, ch.edge_id % 3 = 0 AS bent, b.x - a.x AS dx, b.y - a.y AS dy FROM ch JOIN nd a ON a.node_id = ch.u JOIN nd b ON b.node_id = ch.v),
ln AS (SELECT *, CASE WHEN bent THEN sqrt(pow(0.3::DOUBLE * dx + 0.25::DOUBLE * dy, 2) + pow(0.3::DOUBLE * dy - 0.25::DOUBLE * dx, 2)) + sqrt(pow(0.7::DOUBLE * dx - 0.25::DOUBLE * dy, 2) + pow(0.7::DOUBLE * dy + 0.25::DOUBLE * dx, 2)) ELSE sqrt(dx * dx + dy * dy) END AS len FROM lg)
SELECT chain_id, CAST(1 + sum(CASE WHEN bent THEN 2 ELSE 1 END) AS INTEGER) AS points, round(sum(len), 3) AS length FROM ln GROUP BY chain_id""")
def _(d):
    n = nodes(d).select("node_id", (F.col("lon") * 84000).alias("x"), (F.col("lat") * 111000).alias("y"))
    g = graph.chain_geometry(graph.chain_decompose(d.fx_edges), n, bent(d, "x", "y", n))
    return g.select("chain_id", F.size("geometry").alias("points"), F.round("length", 3).alias("length"))


@query("greedy_nearest_order", """WITH RECURSIVE pt AS (SELECT segment_id, point_id, pano_id, radians(latitude) AS la, radians(longitude) AS lo FROM fx_points WHERE status = 'OK'),
g(segment_id, point_id, pano_id, la, lo, visit, seen) AS (SELECT segment_id, point_id, pano_id, la, lo, 0, [pano_id] FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY point_id) AS rn FROM pt) WHERE rn = 1
  UNION ALL SELECT segment_id, point_id, pano_id, la, lo, visit, list_append(seen, pano_id) FROM (SELECT p.*, g.visit + 1 AS visit, g.seen,
    row_number() OVER (PARTITION BY p.segment_id ORDER BY asin(sqrt(least(1.0::DOUBLE, pow(sin((p.la - g.la) / 2), 2) + cos(g.la) * cos(p.la) * pow(sin((p.lo - g.lo) / 2), 2)))), p.point_id) AS rn
    FROM g JOIN pt p ON p.segment_id = g.segment_id WHERE NOT list_contains(g.seen, p.pano_id)) WHERE rn = 1)
SELECT segment_id, point_id, pano_id, visit FROM g""")
def _(d):
    p = d.fx_points.where("status = 'OK'").withColumn("idx", F.col("point_id"))
    return nearest.greedy_nearest_order(p, "segment_id").select("segment_id", "point_id", "pano_id", "visit")


@query("sample_polygon")
def _(d):
    box = [(40.9, 29.0), (41.2, 29.0), (41.2, 29.2), (40.9, 29.2)]
    return sampling.sample_polygon(nodes(d), bent(d, "lon", "lat", nodes(d)), box)


def bent(d, x: str, y: str, of):
    """Every third edge bends: its shape goes through a point 0.3 of the way along and a little aside. ``of``: places of the nodes."""
    a, b = of.select(F.col("node_id").alias("u"), F.col(x).alias("ax"), F.col(y).alias("ay")), of.select(F.col("node_id").alias("v"), F.col(x).alias("bx"), F.col(y).alias("by"))
    rows = d.fx_edges.join(a, "u").join(b, "v")
    mid = F.struct((F.col("ax") + (F.col("bx") - F.col("ax")) * 0.3 + (F.col("by") - F.col("ay")) * 0.25).alias(x), (F.col("ay") + (F.col("by") - F.col("ay")) * 0.3 - (F.col("bx") - F.col("ax")) * 0.25).alias(y))
    shape = F.array(F.struct(F.col("ax").alias(x), F.col("ay").alias(y)), mid, F.struct(F.col("bx").alias(x), F.col("by").alias(y)))
    return rows.withColumn("geometry", F.when(F.col("edge_id") % 3 == 0, shape)).drop("ax", "ay", "bx", "by")


@query("sample_edges_v1", """WITH n AS (SELECT DISTINCT node_id, CAST(node_id % 10 AS DOUBLE) * 20 AS x, CAST(floor(node_id / 10) AS DOUBLE) * 25 AS y FROM (SELECT u AS node_id FROM fx_edges UNION SELECT v FROM fx_edges)),
s0 AS (SELECT e.edge_id, a.x AS x1, a.y AS y1, b.x AS x3, b.y AS y3, CASE WHEN e.edge_id % 3 = 0 THEN a.x + (b.x - a.x) * 0.3::DOUBLE + (b.y - a.y) * 0.25::DOUBLE ELSE b.x END AS x2, CASE WHEN e.edge_id % 3 = 0 THEN a.y + (b.y - a.y) * 0.3::DOUBLE - (b.x - a.x) * 0.25::DOUBLE ELSE b.y END AS y2 FROM fx_edges e JOIN n a ON a.node_id = e.u JOIN n b ON b.node_id = e.v),
s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l1, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) + sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS len FROM s0),
t AS (SELECT *, unnest(list_distinct(list_append(list_filter([k * 15.0::DOUBLE FOR k IN generate_series(0, 400)], lambda q: q < len), len))) AS dd FROM s WHERE len > 0),
f AS (SELECT *, CASE WHEN dd < l1 OR len = l1 THEN dd / l1 ELSE (dd - l1) / (len - l1) END AS q FROM t)
SELECT edge_id AS segment_id, round(dd, 6) AS distance, round(CASE WHEN dd < l1 OR len = l1 THEN x1 + q * (x2 - x1) ELSE x2 + q * (x3 - x2) END, 6) AS x, round(CASE WHEN dd < l1 OR len = l1 THEN y1 + q * (y2 - y1) ELSE y2 + q * (y3 - y2) END, 6) AS y FROM f""")
def _(d):
    n = d.fx_edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().select("node_id", ((F.col("node_id") % 10).cast("double") * 20).alias("x"), (F.floor(F.col("node_id") / 10).cast("double") * 25).alias("y"))
    s = sampling.sample_edges_v1(n, bent(d, "x", "y", n), 15.0, sample_all=True)
    return s.select("segment_id", F.round("distance", 6).alias("distance"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---------------------------------------------------------------- point clouds


@query("best_run_per_column", f"WITH {MERGED_LABELS}, s AS (SELECT image_id, x, y0, y1, (y1 - y0 + 1) / (1.0::DOUBLE + abs((y0 + y1 + 1) / 2.0 - 330.0::DOUBLE) / 50.0::DOUBLE) AS score FROM lm WHERE label = 'sidewalk' AND y1 - y0 + 1 >= 15) SELECT image_id, x, y0, y1, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x ORDER BY round(score, 9) DESC, y0) AS rn FROM s) WHERE rn = 1")
def _(d):
    r = cloud.merge_label_runs(d.fx_label_runs.where("label = 'sidewalk'"))
    c = r.select("image_id").distinct().withColumn("y_center", F.lit(330.0))
    return best_run_per_column(r, c).select("image_id", "x", "y0", "y1", F.round("score", 6).alias("score"))


@query("gradient_peak", """WITH g AS (SELECT image_id, y, x % 12 AS x, CASE WHEN y < min(y0) % 30 THEN 40.0::DOUBLE ELSE 120.0::DOUBLE END AS v FROM fx_label_runs, (SELECT unnest(generate_series(0, 40)) AS y) GROUP BY image_id, y, x % 12),
df AS (SELECT image_id, y, abs(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v) AS g FROM g WHERE y < 40),
pr AS (SELECT image_id, y, avg(g) AS g FROM df WHERE g IS NOT NULL GROUP BY ALL),
sm AS (SELECT image_id, y, sum(g) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM pr),
be AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(s, 9) DESC, y) AS rn FROM sm)
SELECT image_id, CAST(y AS INTEGER) AS y_top, round(s, 6) AS peak FROM be WHERE rn = 1 AND s > 3""")
def _(d):
    base = d.fx_label_runs.groupBy("image_id", (F.col("x") % 12).alias("x")).agg((F.min("y0") % 30).alias("base"))  # columns first: pixels only of what is left
    grey = base.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("y"), "x", "base").select("image_id", "y", "x", F.when(F.col("y") < F.col("base"), 40.0).otherwise(120.0).alias("v"))
    region = base.select("image_id").distinct().select("image_id", F.lit(0).alias("y0"), F.lit(40).alias("y1"), F.lit(0).alias("x0"), F.lit(12).alias("x1"))
    return cloud.gradient_peak(grey, region).select("image_id", "y_top", F.round("peak", 6).alias("peak"))


COLUMNS = f"""WITH {MERGED_LABELS}, md AS (SELECT * FROM lm WHERE label = 'sidewalk' AND x >= 256 AND x < 384),
px AS (SELECT image_id, x, unnest(generate_series(y0, y1)) AS y FROM md), mc AS (SELECT image_id, x, quantile_cont(y, 0.5) AS m FROM px GROUP BY ALL), ce AS (SELECT image_id, quantile_cont(m, 0.5) AS yc FROM mc GROUP BY ALL),
sc AS (SELECT image_id, x, y0, y1, (y1 - y0 + 1) / (1.0::DOUBLE + abs((y0 + y1 + 1) / 2.0 - yc) / 50.0::DOUBLE) AS score FROM md JOIN ce USING (image_id) WHERE y1 - y0 + 1 >= 15),
ed AS (SELECT image_id, x, CAST(y0 AS DOUBLE) AS y_top, CAST(y1 AS DOUBLE) AS y_bot FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x ORDER BY round(score, 9) DESC, y0) AS rn FROM sc) WHERE rn = 1 AND y0 > 1 AND y1 < 478)"""


def labels(d):
    return cloud.merge_label_runs(d.fx_label_runs)


def posed(d):
    return d.fx_label_runs.select("image_id").distinct().select("image_id", F.lit(0.0).alias("cx"), F.lit(1.8).alias("cy"), F.lit(0.0).alias("cz"), F.lit(1.0).alias("fov"))


@query("clean_label_mask", f"""WITH RECURSIVE {MERGED_LABELS},
s AS (SELECT image_id, x, y0, y1, row_number() OVER (ORDER BY image_id, x, y0) AS id FROM lm WHERE label = 'sidewalk'),
e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.image_id = b.image_id AND abs(a.x - b.x) = 1 AND a.y0 <= b.y1 + 1 AND b.y0 <= a.y1 + 1),
w(id, lead) AS (SELECT id, id FROM s UNION SELECT e.b, w.lead FROM w JOIN e ON e.a = w.id WHERE w.lead < e.b),
l AS (SELECT id, min(lead) AS lead FROM w GROUP BY id),
k AS (SELECT s.image_id, s.x, s.y0, s.y1 FROM s JOIN l USING (id) QUALIFY sum(s.y1 - s.y0 + 1) OVER (PARTITION BY l.lead) >= 307),
o AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
px AS (SELECT image_id, x, unnest(generate_series(y0, y1)) AS y FROM k),
di AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM px, o WHERE x + dx BETWEEN 0 AND 639 AND y + dy BETWEEN 0 AND 479),
er AS (SELECT d.image_id, d.x, d.y FROM di d, o LEFT JOIN di n ON n.image_id = d.image_id AND n.x = d.x + o.dx AND n.y = d.y + o.dy GROUP BY d.image_id, d.x, d.y
  HAVING count(n.x) + count(*) FILTER (d.x + o.dx NOT BETWEEN 0 AND 639 OR d.y + o.dy NOT BETWEEN 0 AND 479) = 9),
g AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS run FROM er)
SELECT image_id, 'sidewalk' AS label, x, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1 FROM g GROUP BY image_id, x, run""")
def _(d):
    return cloud.clean_label_mask(d.fx_label_runs, 640, 480)


@query("column_edges", COLUMNS + " SELECT * FROM ed")
def _(d):
    return cloud.column_edges(labels(d).where("label = 'sidewalk'"), 640, 480)[0]


@query("overseg_check", COLUMNS + """, pe AS (SELECT image_id, quantile_cont(y_bot, 0.5) AS med_bot, quantile_cont(y_bot - y_top, 0.5) AS med_gap, 240.0::DOUBLE / (tan(0.5::DOUBLE) + 0.000000001::DOUBLE) * 1.8::DOUBLE AS fh FROM ed GROUP BY ALL),
ga AS (SELECT *, CASE WHEN med_bot - 240 > 5 THEN fh * 5.0::DOUBLE / (fh / (med_bot - 240) * (fh / (med_bot - 240) + 5.0::DOUBLE)) END AS mg FROM pe)
SELECT image_id, med_bot, med_gap, round(mg, 6) AS max_gap, coalesce(med_gap > mg * 1.3::DOUBLE, false) AS over, CASE WHEN coalesce(med_gap > mg * 1.3::DOUBLE, false) THEN 'M:over_seg' END AS reason FROM ga""")
def _(d):
    e = cloud.column_edges(labels(d).where("label = 'sidewalk'"), 640, 480)[0]
    o = cloud.overseg_check(e, posed(d), 480, 1.8)
    return o.select("image_id", "med_bot", "med_gap", F.round("max_gap", 6).alias("max_gap"), "over", "reason")


def grid(d):
    """A dense road plane in front of the camera for every labelled image: 48 rows and 64 columns."""
    px = d.fx_label_runs.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(25), F.lit(47))).alias("yd")).select("image_id", "yd", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("xd"))
    far = 1.8 / ((F.col("yd") - 23.5) / 43.9)
    noise = (F.pmod(F.col("image_id") * 7919 + F.col("yd") * 104729 + F.col("xd") * 15485863, F.lit(1000)) - 500) / 100000.0
    return px.select("image_id", "yd", "xd", ((F.col("xd") - 31.5) / 43.9 * far).alias("x"), noise.alias("y"), far.alias("z"))


GRID = """gr AS (SELECT image_id, yd, xd, (xd - 31.5::DOUBLE) / 43.9::DOUBLE * (1.8::DOUBLE / ((yd - 23.5::DOUBLE) / 43.9::DOUBLE)) AS x, ((image_id * 7919 + yd * 104729 + xd * 15485863) % 1000 - 500) / 100000.0::DOUBLE AS y, 1.8::DOUBLE / ((yd - 23.5::DOUBLE) / 43.9::DOUBLE) AS z
  FROM (SELECT DISTINCT image_id FROM fx_label_runs), (SELECT unnest(generate_series(25, 47)) AS yd), (SELECT unnest(generate_series(0, 63)) AS xd))"""


@query("bilinear_sample", f"""WITH {MERGED_LABELS}, {GRID}, pt AS (SELECT DISTINCT image_id, x AS pt, x * 63 / 639.0::DOUBLE AS xs, max(y1) OVER (PARTITION BY image_id, x) * 47 / 479.0::DOUBLE AS ys FROM lm WHERE label = 'sidewalk'),
co AS (SELECT *, greatest(0, least(floor(xs), 62)) AS x0, greatest(0, least(floor(ys), 46)) AS y0 FROM pt),
cw AS (SELECT image_id, pt, y0 + dy AS yd, x0 + dx AS xd, CASE WHEN dx = 1 THEN xs - x0 ELSE 1 - (xs - x0) END * CASE WHEN dy = 1 THEN ys - y0 ELSE 1 - (ys - y0) END AS w FROM co, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT cw.image_id, CAST(pt AS BIGINT) AS pt, round(sum(w * x), 6) AS x, round(sum(w * y), 6) AS y, round(sum(w * z), 6) AS z FROM cw JOIN gr ON gr.image_id = cw.image_id AND gr.yd = cw.yd AND gr.xd = cw.xd GROUP BY cw.image_id, pt HAVING count(*) = 4""")
def _(d):
    at = labels(d).where("label = 'sidewalk'").groupBy("image_id", "x").agg(F.max("y1").alias("y1")).select("image_id", F.col("x").cast("long").alias("pt"), (F.col("x") * 63 / 639).alias("xs"), (F.col("y1") * 47 / 479).alias("ys"))
    return cloud.bilinear_sample(grid(d), at, 48, 64).select("image_id", "pt", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("gather_ground", f"""WITH {GRID}, hit AS (SELECT gr.* FROM gr WHERE EXISTS (SELECT 1 FROM fx_label_runs l WHERE l.image_id = gr.image_id AND l.x = least(639, gr.xd * 10) AND least(479, gr.yd * 10) BETWEEN l.y0 AND l.y1)),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(',', image_id, yd, xd))) - 1 AS pt, count(*) OVER (PARTITION BY image_id) AS n FROM hit)
SELECT image_id, CAST(pt AS INTEGER) AS pt, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM o WHERE pt < 40000 AND n >= 50""")
def _(d):
    g = cloud.gather_ground(grid(d), labels(d), (480, 640), (48, 64))
    return g.select("image_id", "pt", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("fit_ground_plane")
def _(d):
    return cloud.fit_ground_plane(d.fx_cloud.withColumn("pt", F.col("pt") - F.min("pt").over(W.partitionBy("image_id"))))


PLANE = "SELECT image_id, 0.6::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.8::DOUBLE AS nz, -0.01::DOUBLE * image_id AS d FROM (SELECT DISTINCT image_id FROM fx_cloud)"


def planes(d):
    return d.fx_cloud.select("image_id").distinct().select("image_id", F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"), (-0.01 * F.col("image_id")).alias("d"))


@query("plane_inlier_join", f"SELECT c.image_id, h.hyp, count(*) FILTER (abs(p.nx * c.x + p.ny * c.y + p.nz * c.z + p.d + h.hyp * 0.1::DOUBLE) < 0.05) AS inliers FROM fx_cloud c JOIN ({PLANE}) p USING (image_id), (VALUES (0), (1), (2)) h(hyp) GROUP BY ALL")
def _(d):
    hyps = planes(d).withColumn("hyp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("d", F.col("d") + F.col("hyp") * 0.1)
    return cloud.plane_inlier_join(d.fx_cloud, hyps, planes(d).select("image_id", F.lit(0.05).alias("thresh")))


@query("project_to_plane", f"WITH s AS (SELECT c.*, p.nx, p.nz, p.nx * x + p.nz * z + p.d AS s FROM fx_cloud c JOIN ({PLANE}) p USING (image_id)) SELECT image_id, pt, round(x - s * nx, 6) AS x, round(y, 6) AS y, round(z - s * nz, 6) AS z FROM s")
def _(d):
    p = cloud.project_to_plane(d.fx_cloud, planes(d))
    return p.select("image_id", "pt", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("metric_scale", f"WITH h AS (SELECT image_id, abs(0.8::DOUBLE * image_id * 0.1::DOUBLE + d) AS h FROM ({PLANE})) SELECT image_id, CASE WHEN h >= 0.000001::DOUBLE THEN round(1.8::DOUBLE / h, 6) END AS scale, CASE WHEN h < 0.000001::DOUBLE THEN 'M:cam_on_plane' WHEN 1.8::DOUBLE / h < 0.2 OR 1.8::DOUBLE / h > 50 THEN 'M:bad_scale' END AS reason FROM h")
def _(d):
    pose = planes(d).select("image_id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), (F.col("image_id") * 0.1).alias("cz"))
    return cloud.metric_scale(planes(d), pose, 1.8).select("image_id", F.round("scale", 6).alias("scale"), "reason")


@query("across_width", """WITH p AS (SELECT image_id, CAST(floor(pt / 2) AS INTEGER) AS col, pt % 2 = 0 AS top, pt % 97 * 0.1::DOUBLE AS x, CASE WHEN pt % 2 = 0 THEN 2.0::DOUBLE + c.x * 0.05::DOUBLE ELSE 0.0::DOUBLE END AS y FROM fx_cloud c),
k AS (SELECT image_id, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) AS th FROM p GROUP BY image_id),
q AS (SELECT image_id, col, max(x) FILTER (top) - max(x) FILTER (NOT top) AS dx, max(y) FILTER (top) - max(y) FILTER (NOT top) AS dy FROM p GROUP BY image_id, col),
b AS (SELECT q.image_id, col, abs(-sin(th) * dx + cos(th) * dy) AS wa, sqrt(dx * dx + dy * dy) AS wr FROM q JOIN k USING (image_id)),
c AS (SELECT *, quantile_cont(wa, 0.5) OVER (PARTITION BY image_id) / (quantile_cont(wr, 0.5) OVER (PARTITION BY image_id) + 0.000000001::DOUBLE) AS ratio FROM b),
o AS (SELECT image_id, col, CASE WHEN ratio > 0.5 AND ratio < 1.05 THEN wa ELSE wr END AS width FROM c)
SELECT image_id, col AS x, round(width, 5) AS width FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM o WHERE width > 0.05 AND width < 15) WHERE n >= 3""")
def _(d):
    pts = d.fx_cloud.select("image_id", F.floor(F.col("pt") / 2).cast("int").alias("col"), F.when(F.col("pt") % 2 == 0, "top").otherwise("bot").alias("side"), (F.col("pt") % 97 * 0.1).alias("x"), F.when(F.col("pt") % 2 == 0, 2.0 + F.col("x") * 0.05).otherwise(0.0).alias("y"), F.lit(0.0).alias("z"))
    flat = pts.select("image_id").distinct().select("image_id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return cloud.across_width(pts, flat).select("image_id", "x", F.round("width", 5).alias("width"))


def measured(d):
    return cloud.measure_width_points(d.fx_label_runs, grid(d), posed(d), (480, 640), (48, 64))


@query("measure_width_points")
def _(d):
    return measured(d)


@query("alt_width_batch")
def _(d):
    images = d.supplier.select(F.col("s_suppkey").alias("image_id"))
    return cloud.alt_width_batch(images, measured(d).select("image_id", "width_m", "n_cols", "reason"))[1]


@query("alt_width_statuses", """WITH m AS (SELECT id AS image_id, predicted_width AS w, CASE WHEN predicted_width > 2.2 THEN 'M:out_of_range' ELSE '' END AS reason FROM fx_predictions WHERE id % 5 <> 0)
SELECT i.o_orderkey AS image_id, CASE WHEN i.o_orderkey % 11 = 1 THEN 'E:no_pose_enc' WHEN i.o_orderkey % 13 = 2 THEN 'E:exception(no plane)' WHEN i.o_orderkey % 13 = 3 THEN 'E:imread_fail' ELSE coalesce(m.reason, 'E:missing') END AS reason,
  CASE WHEN m.reason = '' AND i.o_orderkey % 11 <> 1 AND i.o_orderkey % 13 NOT IN (2, 3) THEN 'ok' ELSE 'failed' END AS status,
  round(coalesce(CASE WHEN m.reason = '' AND i.o_orderkey % 11 <> 1 AND i.o_orderkey % 13 NOT IN (2, 3) THEN m.w END, -1), 6) AS width_m
FROM orders i LEFT JOIN m ON m.image_id = i.o_orderkey""")
def _(d):
    """Every status of the batch, over predicted widths."""
    images = d.orders.select(F.col("o_orderkey").alias("image_id"))
    bad = F.col("predicted_width") > 2.2
    measured = d.fx_predictions.where("id % 5 <> 0").select(F.col("id").alias("image_id"), F.when(~bad, F.col("predicted_width")).alias("width_m"), F.when(bad, "M:out_of_range").otherwise("").alias("reason"))
    failures = images.where("image_id % 13 in (2, 3)").withColumn("reason", F.when(F.col("image_id") % 13 == 2, "E:exception(no plane)").otherwise("E:imread_fail"))
    docs = cloud.alt_width_batch(images, measured, images.where("image_id % 11 <> 1"), failures)[0]
    return docs.select("image_id", "reason", "status", F.round(F.coalesce("width_m", F.lit(-1.0)), 6).alias("width_m"))


# ---------------------------------------------------------------- streams and plug-ins


@query("stream_reports", "SELECT point_id, direction, count(*) AS reports FROM fx_reports WHERE length(trim(description)) > 0 GROUP BY ALL")
def _(d):
    from ..streaming.reports import compact_reports, read_reports, stream_reports

    src, out, checkpoint = d.scratch("reports-in"), d.scratch("reports-out"), d.scratch("reports-checkpoint")
    d.fx_reports.select(F.col("point_id").alias("pointId"), "direction", "description", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")).write.json(src)
    stream_reports(d.spark, src, out, checkpoint, buckets=64).awaitTermination()
    compact_reports(d.spark, out, keep_batches=0, buckets=64)
    return read_reports(d.spark, out).groupBy("point_id", "direction").agg(F.count("*").alias("reports"))


JUNCTION_IMAGES = "im AS (SELECT s_suppkey AS image_id FROM supplier UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 4 = 0)"


@query("junction_analyzer", f"""WITH {JUNCTION_IMAGES},
m AS (SELECT image_id, count(DISTINCT mask_key) FILTER (class_name = 'sidewalk') AS sidewalks, count(DISTINCT mask_key) FILTER (class_name <> 'sidewalk') AS obstacles, sum(c1 - c0 + 1) FILTER (class_name = 'sidewalk') AS px FROM fx_mask_runs GROUP BY image_id)
SELECT im.image_id, CASE WHEN im.image_id % 17 = 3 THEN 'E:ValueError' ELSE 'junction_analyzed' END AS status, CASE WHEN im.image_id % 17 = 3 THEN 'no view of ' || im.image_id END AS error,
  CAST(CASE WHEN im.image_id % 17 <> 3 THEN coalesce(sidewalks, 0) ELSE -1 END AS BIGINT) AS sidewalks, CAST(CASE WHEN im.image_id % 17 <> 3 THEN coalesce(obstacles, 0) ELSE -1 END AS BIGINT) AS obstacles,
  CAST(CASE WHEN im.image_id % 17 <> 3 THEN coalesce(px, 0) ELSE -1 END AS BIGINT) AS px, CAST(CASE WHEN im.image_id % 17 <> 3 THEN length('image ' || im.image_id) ELSE -1 END AS BIGINT) AS bytes, 'img/' || im.image_id || '.jpg' AS image_blob FROM im LEFT JOIN m USING (image_id)""")
def _(d):
    ids = d.supplier.select(F.col("s_suppkey").alias("image_id"))
    ids = ids.union(ids.where("image_id % 4 = 0").select(F.col("image_id") + 1000000))  # images without masks
    images = ids.select("image_id", F.concat(F.lit("img/"), "image_id", F.lit(".jpg")).alias("image_blob"), F.struct(F.col("image_id").alias("point_id")).alias("metadata"), F.concat(F.lit("image "), "image_id").cast("binary").alias("content"))

    def count(image: plugins.JunctionImage) -> dict:
        if image.metadata["point_id"] % 17 == 3:
            raise ValueError(f"no view of {image.image_id}")
        px = sum(int((runs[:, 2] - runs[:, 1] + 1).sum()) for runs in image.sidewalks.values())
        return {"sidewalks": len(image.sidewalks), "obstacles": len(image.obstacles), "px": px, "bytes": len(image.content)}

    got = plugins.junction_analyzer(images, d.fx_mask_runs, count)
    figures = [F.coalesce(F.get_json_object("analysis", f"$.{n}").cast("long"), F.lit(-1)).alias(n) for n in ("sidewalks", "obstacles", "px", "bytes")]
    return got.select("image_id", "status", "error", *figures, "image_blob")
