"""Views over the driver tables with the shapes of real inputs; the same SQL text runs in Spark and DuckDB.

Table names stand in braces: Spark fills them with DataFrames, DuckDB with view names.
"""

from __future__ import annotations

FIXTURES = {
    "fx_mask_runs": """
SELECT image_id, mask_key, class_name, r, c0, c1 FROM (
  SELECT l_suppkey AS image_id,
    CASE WHEN l_linenumber<=3 THEN 'sidewalk_0' WHEN l_linenumber=4 THEN 'sidewalk_1' WHEN l_linenumber=5 THEN 'tree_0' WHEN l_linenumber=6 THEN 'car_0' ELSE 'road_0' END AS mask_key,
    CASE WHEN l_linenumber<=4 THEN 'sidewalk' WHEN l_linenumber=5 THEN 'tree' WHEN l_linenumber=6 THEN 'car' ELSE 'road' END AS class_name,
    CAST(l_orderkey % 480 AS INT) AS r,
    CAST(greatest(CAST(0 AS DOUBLE), floor(CASE WHEN l_linenumber<=3 THEN CAST(300 AS DOUBLE)-CAST(1.3 AS DOUBLE)*((l_orderkey%480)-200) WHEN l_linenumber=4 THEN CAST(480 AS DOUBLE)+CAST(0.2 AS DOUBLE)*((l_orderkey%480)-200) WHEN l_linenumber=5 THEN CAST(150 AS DOUBLE) WHEN l_linenumber=6 THEN CAST(520 AS DOUBLE) ELSE CAST(330 AS DOUBLE) END + l_quantity/10)) AS INT) AS c0,
    CAST(least(CAST(639 AS DOUBLE), floor(CASE WHEN l_linenumber<=3 THEN CAST(310 AS DOUBLE)+CAST(0.35 AS DOUBLE)*((l_orderkey%480)-200) WHEN l_linenumber=4 THEN CAST(500 AS DOUBLE)+CAST(0.9 AS DOUBLE)*((l_orderkey%480)-200) WHEN l_linenumber=5 THEN CAST(170 AS DOUBLE) WHEN l_linenumber=6 THEN CAST(560 AS DOUBLE) ELSE CAST(470 AS DOUBLE) END + l_quantity/5 + 10)) AS INT) AS c1
  FROM {lineitem}) q WHERE c0 <= c1
""",
    "fx_edges": """
SELECT c_custkey*10 AS edge_id, c_custkey AS u, c_custkey+1 AS v, CAST(20 AS DOUBLE)+(c_custkey%17)*CAST(3.5 AS DOUBLE) AS length, concat('st', CAST(c_custkey % 97 AS STRING)) AS name FROM {customer} WHERE c_custkey%10<>9
UNION ALL SELECT c_custkey*10+1, c_custkey, c_custkey+10, CAST(25 AS DOUBLE)+(c_custkey%13)*CAST(4 AS DOUBLE), CAST(NULL AS STRING) FROM {customer} WHERE c_custkey%30=4 OR c_custkey%70=0
UNION ALL SELECT c_custkey*10+2, c_custkey, c_custkey+1, CAST(18 AS DOUBLE)+(c_custkey%19)*CAST(4 AS DOUBLE), 'dup' FROM {customer} WHERE c_custkey%10<>9 AND c_custkey%25=3
""",
    "fx_points": """
SELECT o_orderkey%500 AS segment_id, o_orderkey AS point_id, CAST(40.96 AS DOUBLE)+CAST((o_orderkey*7919)%10007 AS DOUBLE)/1000000 AS latitude, CAST(29.04 AS DOUBLE)+CAST((o_orderkey*104729)%10009 AS DOUBLE)/1000000 AS longitude, concat('pano', CAST(o_orderkey%3001 AS STRING)) AS pano_id, CASE WHEN o_orderkey%11=0 THEN 'ZERO_RESULTS' ELSE 'OK' END AS status, CAST(o_orderkey*37%360 AS DOUBLE) AS bearing, CAST(o_orderkey%40*15 AS DOUBLE) AS distance_along_m, CASE WHEN o_orderkey%40=0 THEN 'junction' ELSE 'street' END AS point_type FROM {orders}
""",
    "fx_objects": """
SELECT o_orderkey AS object_id, concat('streetview/polygon_4v/20240101T000000Z/', CASE WHEN o_orderkey%3=0 THEN '' ELSE concat(lpad(CAST(o_orderkey%500 AS STRING),3,'0'),'-') END, lpad(CAST(o_orderkey AS STRING),6,'0'), '_', CASE WHEN o_orderkey%5=4 THEN 'up' WHEN o_orderkey%4=0 THEN 'forward' WHEN o_orderkey%4=1 THEN 'backward' WHEN o_orderkey%4=2 THEN 'left' ELSE 'right' END, '_40.', CAST(96000+o_orderkey%1000 AS STRING), '_29.', CAST(10000+o_orderkey%700 AS STRING), '_', CAST(o_orderkey*37%360 AS STRING), '.0', CASE WHEN o_orderkey%13=0 THEN '.json' WHEN o_orderkey%7=0 THEN '.PNG' ELSE '.jpg' END) AS path FROM {orders}
""",
    "fx_detections": """
SELECT l_orderkey AS image_id, l_linenumber AS idx, l_returnflag AS prompt, l_discount*10 AS confidence, l_quantity AS x1, l_tax*1000 AS y1, l_quantity+l_extendedprice/1000 AS x2, l_tax*1000+l_quantity*3 AS y2, CAST(l_quantity*100 AS BIGINT) AS mask_pixels FROM {lineitem}
""",
    "fx_label_runs": """
SELECT ps.image_id, ps.x, CASE WHEN ps.k=0 THEN 'sidewalk' ELSE 'road' END AS label, CAST(ps.base + ps.k*60 AS INT) AS y0, CAST(ps.base + ps.k*60 + 20 + ps.h AS INT) AS y1 FROM (SELECT l_suppkey AS image_id, CAST(l_partkey%640 AS INT) AS x, l_linenumber%2 AS k, 300 + l_orderkey%15 AS base, l_orderkey%35 AS h FROM {lineitem}) ps
""",
    "fx_predictions": """
SELECT l_orderkey AS id, avg(CAST(1 AS DOUBLE)+l_quantity/25) AS predicted_width FROM {lineitem} GROUP BY l_orderkey
""",
    "fx_truth": """
SELECT o_orderkey AS id, CAST(1 AS DOUBLE)+CAST(o_orderkey*31%200 AS DOUBLE)/100 AS central_width FROM {orders} WHERE o_orderkey%4<>0
""",
    "fx_skips": """
SELECT event_id AS id, CASE WHEN event_type='error' THEN 'E:exception' WHEN event_type='click' THEN 'Q:sw_area_small' WHEN event_type='view' THEN 'Q:midline_coverage_low' WHEN event_type='signup' THEN 'M:too_few_cols' ELSE 'M:bad_scale' END AS reason FROM {events} WHERE event_type<>'purchase'
""",
    "fx_reports": """
SELECT event_id, concat('p', CAST(user_id AS STRING)) AS point_id, CASE WHEN event_id%4=0 THEN 'forward' WHEN event_id%4=1 THEN 'right' WHEN event_id%4=2 THEN 'backward' ELSE 'left' END AS direction, CASE WHEN event_id%9=0 THEN '   ' ELSE concat('  ', event_type, ' ') END AS description, ts FROM {events}
""",
    "fx_cloud": """
SELECT label AS image_id, vec_id*21+k AS pt, CAST(embedding[3*k] AS DOUBLE) AS x, CAST(embedding[3*k+1] AS DOUBLE) AS y, CAST(embedding[3*k+2] AS DOUBLE)*CAST(0.02 AS DOUBLE) AS z FROM {embeddings} LATERAL VIEW explode(sequence(0,20)) g AS k
""",
}

#: Where the two engines' array syntax differs.
DUCKDB = {
    "fx_cloud": """
SELECT label AS image_id, vec_id*21+k AS pt, CAST(embedding[3*k+1] AS DOUBLE) AS x, CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE)*CAST(0.02 AS DOUBLE) AS z FROM {embeddings} , (SELECT unnest(generate_series(0,20)) AS k) g
""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


class Data:
    """Tables and fixture views of a folder, by attribute."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        if name in FIXTURES:
            sql = FIXTURES[name]
            return self.spark.sql(sql, **{t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, led by the fixture views that it names."""
    plain = {t: t for t in TABLES}
    used = [n for n in FIXTURES if n in sql]
    views = ",\n".join(f"{n} AS ({DUCKDB.get(n, FIXTURES[n]).strip().format(**plain)})" for n in used)
    body = sql.strip()
    if not views:
        return body
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{views},\n{body[len(lead):]}"
    return f"WITH {views}\n{body}"
