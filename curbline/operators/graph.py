"""Street graphs and orders as iterative DataFrame jobs. Edges: edge_id, u, v, length, name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scope, settle
from .filters import first_per
from .runs import changes, in_whole_groups, merged_runs


def dedupe_parallel_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair of nodes: the longest, the first on ties."""
    rows = edges.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
    return first_per(rows, ["_a", "_b"], [F.desc("length"), F.col("edge_id")]).drop("_a", "_b")


def node_degree(edges: DataFrame) -> DataFrame:
    """Degree (a loop counts twice), is_junction (3 or more), is_terminal (not 2)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).select("node", "degree", (F.col("degree") >= 3).alias("is_junction"), (F.col("degree") != 2).alias("is_terminal"))


def uncovered_edges(edges: DataFrame, chains: DataFrame) -> DataFrame:
    return edges.join(chains.select("edge_id"), "edge_id", "left_anti")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and comp_id (the smallest id of its component), for all ends of the edges.

    Every round each node points to its smallest neighbour, pointers jump twice, and edges are contracted to
    the nodes pointed at, so edges shrink fast and rounds grow with the logarithm of a component's length. A round's tables go
    as soon as the next round's are written. Joins are merged: numbers that follow one another pack so well in files that the planner
    takes millions of them for a table to broadcast."""
    with Scope(edges.sparkSession) as scratch:
        left = scratch.settle(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
        now = left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("c", F.col("id"))
        old: list[DataFrame] = []
        while left.limit(1).count():
            point = left.select("a", "b").union(left.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p"))
            steps = []
            for _ in range(2):
                steps.append(scratch.settle(point, "pointers"))
                up = steps[-1].select(F.col("id").alias("u"), F.col("p").alias("q"))
                point = steps[-1].join(up.hint("merge"), F.col("p") == F.col("u"), "left").select("id", F.least("p", F.coalesce("q", "p")).alias("p"))
            steps.append(scratch.settle(point, "pointers"))
            point = steps[-1]
            labels = scratch.settle(now.join(point.select(F.col("id").alias("u"), "p").hint("merge"), F.col("c") == F.col("u"), "left").select("id", F.coalesce("p", "c").alias("c")), "labels")
            pa, pb = point.select(F.col("id").alias("a"), F.col("p").alias("x")), point.select(F.col("id").alias("b"), F.col("p").alias("y"))
            fewer = scratch.settle(left.join(pa.hint("merge"), "a").join(pb.hint("merge"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
            scratch.drop(left, *old, *steps)
            left, now, old = fewer, labels, [labels]
        return scratch.give(now.withColumnRenamed("c", "comp_id"), "components")


def mask_components(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with comp_id: 8-connected components of each mask. Runs must be merged.

    Runs of neighbouring rows that overlap when widened by one are linked through column tiles, an equi-join. Runs are
    numbered in a table written once, so that no two of them share a number, however many there are."""
    tile = 64
    rows = settle(runs.withColumn("run_id", F.monotonically_increasing_id()), "runs")
    tiled = rows.withColumn("_t", F.explode(F.sequence(F.floor((F.col("c0") - 1) / tile), F.floor((F.col("c1") + 1) / tile))))
    up = tiled.select(*keys, "_t", F.col("r").alias("r1"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("run_id").alias("a"))
    down = tiled.select(*keys, "_t", (F.col("r") - 1).alias("r1"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("run_id").alias("b"))
    links = up.join(down.hint("merge"), [*keys, "_t", "r1"]).where((F.col("b0") <= F.col("a1") + 1) & (F.col("b1") >= F.col("a0") - 1)).select("a", "b").distinct()
    comp = connected_components(links)
    return rows.join(comp.hint("merge"), rows["run_id"] == comp["id"], "left").withColumn("comp_id", F.coalesce("comp_id", "run_id")).drop("id", "run_id")


def touching(line: np.ndarray, below: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The first run of each run's 8-connected component. Runs are sorted by line and column and apart; below: the line under each run's, or -1."""
    low = c0.min(initial=0)
    wide = np.int64(c1.max(initial=0) - low + 5)
    begin, end = line * wide + (c0 - low + 2), line * wide + (c1 - low + 2)
    first = np.searchsorted(end, below * wide + (c0 - low + 1), "left")
    n = np.where(below >= 0, np.searchsorted(begin, below * wide + (c1 - low + 3), "right") - first, 0)
    a = np.repeat(np.arange(len(line)), n)
    b = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lead = np.arange(len(line))
    while len(a):
        least = np.minimum(lead[a], lead[b])
        np.minimum.at(lead, lead[a], least)
        np.minimum.at(lead, lead[b], least)
        while not np.array_equal(jumped := lead[lead], lead):
            lead = jumped
        apart = lead[a] != lead[b]
        a, b = a[apart], b[apart]
    return lead


def raster_components(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, united where they overlap or touch, with comp_id: 8-connected components of each mask, as :func:`mask_components` finds them, for masks
    of one image each: a mask's runs come together in a task, many masks at a time, and components are numbered by their first run there."""
    def label(table: pa.Table) -> pa.Table:
        new = changes(table, [*keys, "r"])
        line = np.cumsum(new) - 1
        line, c0, c1 = merged_runs(line, table["c0"].to_numpy().astype(np.int64), table["c1"].to_numpy().astype(np.int64))
        at = np.flatnonzero(new)  # a row of each line
        mask, r = (np.cumsum(changes(table, keys)) - 1)[at], table["r"].to_numpy()[at].astype(np.int64)
        follows = np.append((mask[1:] == mask[:-1]) & (r[1:] == r[:-1] + 1), False)
        below = np.where(follows, np.arange(len(at)) + 1, -1)
        first = np.searchsorted(mask[line], np.arange(mask[-1] + 1))
        comp = touching(line, below[line], c0, c1) - first[mask[line]]
        out = table.select([*keys, "r"]).take(pa.array(at[line]))
        for name, v in (("c0", c0.astype(np.int32)), ("c1", c1.astype(np.int32)), ("comp_id", comp)):
            out = out.append_column(name, pa.array(v))
        return out

    rows = runs.select(*keys, F.col("r").cast("int").alias("r"), F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return in_whole_groups(rows, keys, ["r"], label, f"{kinds}, comp_id long")


def component_bbox(component_runs: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box (maxima exclusive), area and height of each component."""
    return component_runs.groupBy(*keys, "comp_id").agg(
        F.min("r").alias("min_row"), F.min("c0").alias("min_col"), (F.max("r") + 1).alias("max_row"), (F.max("c1") + 1).alias("max_col"),
        F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), (F.max("r") + 1 - F.min("r")).alias("height"),
    )


def chain_decompose(edges: DataFrame) -> DataFrame:
    """chain_id, pos, edge_id, u, v, closed: maximal chains through nodes of degree 2, every edge once (loops at a node go).

    Each edge gives two directed halves; at a node of degree 2 a half goes on to the other edge's half. Halves are ranked by
    list contraction: in each round a set of inner halves, no two of them neighbours, leaves its lists (those whose hash is
    the least among their neighbours', a third on average); what is left of the lists goes on, lists without inner halves are set
    aside, and on the way back each half that left learns its distance from its successor. So tables shrink from round to round, what is written
    in all is in proportion to the halves, and one long ring costs only its own rounds. Of a chain's two
    directions the one whose start (then second node) is smaller stays; rings without an end are cut at their smallest node."""
    spark = edges.sparkSession
    with Scope(spark) as scratch:
        simple = scratch.settle(dedupe_parallel_edges(edges).select("edge_id", "u", "v"), "simple")
        halves = simple.unionByName(simple.select("edge_id", F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        halves = scratch.settle(halves.withColumn("h", F.concat_ws(">", "edge_id", "u")), "halves")
        through = node_degree(simple).where("degree = 2").select(F.col("node").alias("v"))
        nxt = halves.select(F.col("h").alias("nh"), F.col("edge_id").alias("ne"), F.col("u").alias("v"))
        follow = scratch.settle(halves.join(through, "v").join(nxt, "v").where("edge_id <> ne").select("h", F.col("nh").alias("n")), "follow")
        ranked = _rank_lists(scratch, halves.select("h"), follow)
        every = scratch.settle(halves.join(ranked, "h"), "ranked")  # last, steps (to the last half), closed, total
        return scratch.give(_straight(every.where("not closed")).unionByName(_rings(scratch, every.where("closed"))), "chains")


def _rank_lists(scratch: Scope, nodes: DataFrame, follow: DataFrame) -> DataFrame:
    """h, last, steps, closed, total: each node's distance to the last of its list. A ring's ``last`` is the node that was left over;
    total is the ring's length. follow: h and the node n after it; every h has one n at most, and the reverse."""
    before = follow.select(F.col("n").alias("h"), F.col("h").alias("p"))
    both = nodes.join(follow, "h", "left").join(before, "h", "left")
    ends = both.select(F.col("h").alias("_e"), F.col("n").isNull().alias("_nt"), F.col("p").isNull().alias("_ph"))
    both = both.join(ends.select(F.col("_e").alias("n"), F.col("_nt").alias("n_tail")), "n", "left").join(ends.select(F.col("_e").alias("p"), F.col("_ph").alias("p_head")), "p", "left")
    going = both.select("h", "p", "n", F.coalesce("n_tail", F.lit(False)).alias("n_tail"), F.coalesce("p_head", F.lit(False)).alias("p_head"), F.lit(1).cast("long").alias("w"))
    rounds: list[DataFrame] = []
    while True:  # two steps a table: what is written is the same, in half as many jobs
        first = _fates(going, 2 * len(rounds))
        second = _fates(_contracted(first), 2 * len(rounds) + 1)
        state = scratch.settle(first.where("fate <> 'on'").withColumn("step", F.lit(0)).unionByName(second.withColumn("step", F.lit(1))), f"round-{len(rounds)}")
        rounds.append(state)
        if not state.where("fate = 'on' or (fate = 'out' and step = 1)").limit(1).count():
            break
        going = _contracted(state.where("step = 1").drop("step"))
    known = rounds[-1].where("false").select("h", F.col("h").alias("last"), F.col("w").alias("steps"), F.lit(False).alias("closed"), F.col("w").alias("total"))
    old = None
    for state in reversed(rounds):
        for step in (1, 0):
            part = state.where(F.col("step") == step)
            back = part.where("fate = 'out'").select("h", "n", "w").join(known.withColumnRenamed("h", "_k"), F.col("n") == F.col("_k")).select("h", "last", (F.col("w") + F.col("steps")).alias("steps"), "closed", "total")
            known = known.unionByName(_ended(part.where("fate = 'done'"))).unionByName(back)
        known = scratch.settle(known, "known")
        scratch.drop(state, *[old] * (old is not None))
        old = known
    return known


def _fates(going: DataFrame, number: int) -> DataFrame:
    """Which nodes leave in this step (out), are on a list without inner nodes (done), or go on."""
    mine = F.struct(F.xxhash64("h", F.lit(number)).alias("x"), F.col("h").alias("h"))
    # an end never leaves, so it counts as larger than any inner node
    less = [flag | (mine < F.struct(F.xxhash64(c, F.lit(number)).alias("x"), F.col(c).alias("h"))) for c, flag in (("p", F.col("p_head")), ("n", F.col("n_tail")))]
    inner = F.col("p").isNotNull() & F.col("n").isNotNull()
    over = ((F.col("p").isNull() | F.col("p_head")) & (F.col("n").isNull() | F.col("n_tail")) & ~inner) | (inner & (F.col("n") == F.col("h")))
    return going.withColumn("fate", F.when(over, "done").when(inner & less[0] & less[1], "out").otherwise("on"))


def _contracted(state: DataFrame) -> DataFrame:
    """The nodes that go on, each told by a neighbour that left what lies behind it."""
    out = state.where("fate = 'out'")
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    ahead = out.select(F.col("p").alias("h"), text.alias("p"), "n", "n_tail", flag.alias("p_head"), "w", F.lit(True).alias("ahead"))
    behind = out.select(F.col("n").alias("h"), "p", text.alias("n"), flag.alias("n_tail"), "p_head", F.lit(0).cast("long").alias("w"), F.lit(False).alias("ahead"))
    stay = state.where("fate = 'on'").select("h", "p", "n", "n_tail", "p_head", "w", flag.alias("ahead"))

    def told_or_own(c: str, when: str):
        return F.coalesce(F.max(F.when(F.expr(when), F.col(c))), F.max(F.when(F.col("ahead").isNull(), F.col(c)))).alias(c)

    return stay.unionByName(ahead).unionByName(behind).groupBy("h").agg(told_or_own("p", "ahead = false"), told_or_own("n", "ahead"), told_or_own("n_tail", "ahead"), told_or_own("p_head", "ahead = false"), F.sum("w").alias("w"))


def _ended(done: DataFrame) -> DataFrame:
    """Heads, tails and the last nodes of rings know their distance."""
    ring = F.coalesce(F.col("n") == F.col("h"), F.lit(False))
    own = ring | F.col("n").isNull()
    return done.select("h", F.when(own, F.col("h")).otherwise(F.col("n")).alias("last"), F.when(own, F.lit(0)).otherwise(F.col("w")).cast("long").alias("steps"), ring.alias("closed"), F.when(ring, F.col("w")).alias("total"))


def _straight(halves: DataFrame) -> DataFrame:
    """Of each chain's two directions the one with the smaller start; the first half has the most steps to the last."""
    chains = halves.groupBy("last").agg(F.max(F.struct("steps", "u", "v", "edge_id")).alias("head"), F.max("steps").alias("most"), F.max(F.when(F.col("steps") == 0, F.struct("v", "u", "edge_id"))).alias("tail"))
    forward = F.struct(F.col("head.u").alias("a"), F.col("head.v").alias("b"), F.col("head.edge_id").alias("e"))
    backward = F.struct(F.col("tail.v").alias("a"), F.col("tail.u").alias("b"), F.col("tail.edge_id").alias("e"))
    kept = chains.where(forward <= backward).select("last", "most")
    return halves.join(kept, "last").select(F.col("last").alias("chain_id"), (F.col("most") - F.col("steps")).cast("int").alias("pos"), "edge_id", "u", "v", F.lit(False).alias("closed"))


def _rings(scratch: Scope, halves: DataFrame) -> DataFrame:
    """Rings cut at their smallest node, in the direction of the smaller second node. A ring's id is the half that leads back to the cut."""
    rings = halves.groupBy("last").agg(F.min(F.struct("u", "v", "edge_id", "steps", "total")).alias("s"))
    best = first_per(rings.select("last", "s.*"), ["u"], [F.col("v"), F.col("edge_id")])
    # the other direction of the same ring has the same smallest node
    start = best.select("last", F.col("steps").alias("_from"), F.col("total").alias("_all"))
    placed = halves.join(start, "last").withColumn("pos", F.pmod(F.col("_from") - F.col("steps"), F.col("_all")).cast("int"))
    ids = placed.where(F.col("pos") == F.col("_all") - 1).select("last", F.col("h").alias("chain_id"))
    return placed.join(ids, "last").select("chain_id", "pos", "edge_id", "u", "v", F.lit(True).alias("closed"))


def chain_geometry(chains: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """chain_id, geometry (array of x, y) and length. An edge's own geometry (column ``geometry`` from u to v) is
    turned when the chain goes the other way; without one the leg is straight. Shared ends come once."""
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = nodes.select("node_id", point.alias("p"))
    legs = chains.join(at.withColumnRenamed("node_id", "u").withColumnRenamed("p", "pu"), "u").join(at.withColumnRenamed("node_id", "v").withColumnRenamed("p", "pv"), "v")
    straight = F.array("pu", "pv")
    if edges is not None and "geometry" in edges.columns:
        legs = legs.join(edges.select("edge_id", F.col("u").alias("eu"), "geometry"), "edge_id", "left")
        own = F.when(F.col("eu") == F.col("u"), F.col("geometry")).otherwise(F.reverse("geometry"))
        straight = F.when(F.size("geometry") >= 2, own).otherwise(straight)
    legs = legs.withColumn("leg", straight)
    leg = F.when(F.col("pos") == 0, F.col("leg")).otherwise(F.slice("leg", 2, F.size("leg")))
    parts = legs.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("pos", leg.alias("leg")))).alias("parts"))
    out = parts.select("chain_id", F.flatten(F.transform("parts", lambda p: p["leg"])).alias("geometry"))
    return out.withColumn("length", polyline_length(F.col("geometry")))


def polyline_length(g: Column) -> Column:
    """Length of an array of x, y."""
    legs = F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def canonical_direction(segments: DataFrame, legacy_flags: bool = False) -> DataFrame:
    """Turn segments whose start (lat, lon) comes after their end. Columns: start_lat, start_lon, end_lat, end_lon,
    geometry and the two junction flags, which are swapped along unless ``legacy_flags``."""
    turn = F.struct(F.col("start_lat").alias("a"), F.col("start_lon").alias("b")) > F.struct(F.col("end_lat").alias("a"), F.col("end_lon").alias("b"))
    pairs = [("start_lat", "end_lat"), ("start_lon", "end_lon")] + ([] if legacy_flags else [("start_is_junction", "end_is_junction")])
    new = {}
    for a, b in pairs:
        new[a], new[b] = F.when(turn, F.col(b)).otherwise(F.col(a)), F.when(turn, F.col(a)).otherwise(F.col(b))
    if "geometry" in segments.columns:
        new["geometry"] = F.when(turn, F.reverse("geometry")).otherwise(F.col("geometry"))
    return segments.withColumns({**new, "reversed": turn})


def sequence_ids(df: DataFrame, order: list[str], name: str = "seq", start: int = 0, pattern: str | None = None) -> DataFrame:
    """Number rows in an order from ``start`` (as text with a pattern such as %04d).

    Rows are dealt by Spark's own range partitioning, whose cut points come from a sample of rows over all columns of the order and
    then a hash of the row, so that many rows of one value spread as well; each task sorts its range and numbers it, and ranges are
    shifted by the counts of those before. Rows alike in all columns of the order are ordered by that hash. Written once, since cut points may differ from run to run."""
    place = F.monotonically_increasing_id()  # 2^33 * task + place in the task
    dealt = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_at", place).drop("_tie")
    rows = settle(dealt, "ranges")
    counts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))  # a row per range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + start
    out = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.format_string(pattern, number) if pattern else number.cast("long")).drop("_part", "_at", "_before")


