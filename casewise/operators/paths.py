"""Cheapest paths over the entity graph, for many requests and cases in one job.

Vertices are node labels within a case: a process and a parent process of the same name
are one vertex, which is what links process trees. All requests advance together, one hop
per round. A round joins the vertices whose cost just improved to their outgoing edges and
keeps the cheapest candidate per (request, vertex). Rows that cannot beat the best known
cost of their goal are dropped. It ends when nothing improved; since every step costs at
least ``MIN_STEP_COST`` that is certain to happen.

Each state row holds the cost, the hop count and the predecessor only; the path is read
back from the goal afterwards. Equal costs are decided by hop count, then by the label of
the predecessor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.scoring import privilege_gap, step_cost, zero_heuristic
from casewise.operators.skew import BROADCAST_ROWS, broadcast_if_small
from casewise.session import Scratch, checkpoint_laid_out, materialize

Heuristic = Callable[[Column, Column, Column, Column], Column]

COST_DIGITS = 4
# Edges of a vertex beyond which its list is cut into slices.
WIDE_VERTEX = 100_000
STATUSES = ["ok", "case_not_found", "empty_graph", "start_not_found", "goal_not_found", "no_path"]


def resolve_requests(requests: DataFrame, nodes: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Resolve start and goal, given as a label or a node id, and set ``status`` where that fails.

    ``requests`` has request_id, case_id, start_node and goal_node. The node table is reduced to
    the nodes that a request names, so its size does not matter for the joins that follow.
    """
    names = requests.select("case_id", F.explode(F.array("start_node", "goal_node")).alias("name")).distinct()
    by_label = nodes.select("case_id", F.col("node_label").alias("name"), F.col("node_label").alias("label"))
    by_id = nodes.select("case_id", F.col("node_id").alias("name"), F.col("node_label").alias("label"))
    labels = (
        by_label.withColumn("rank", F.lit(0))
        .unionByName(by_id.withColumn("rank", F.lit(1)))
        .join(broadcast_if_small(names), ["case_id", "name"], "left_semi")
        .groupBy("case_id", "name")
        .agg(F.min(F.struct("rank", "label"))["label"].alias("label"))
    )
    labels = materialize(labels)
    asked = broadcast_if_small(requests.select("case_id").distinct())
    filled = nodes.select("case_id").join(asked, "case_id", "left_semi").distinct()
    start = labels.select("case_id", F.col("name").alias("start_node"), F.col("label").alias("start"))
    goal = labels.select("case_id", F.col("name").alias("goal_node"), F.col("label").alias("goal"))
    joined = (
        requests.join(filled.withColumn("__filled", F.lit(True)), "case_id", "left")
        .join(start, ["case_id", "start_node"], "left")
        .join(goal, ["case_id", "goal_node"], "left")
    )
    if cases is not None:
        known = cases.where(~F.col("is_deleted")).select("case_id").distinct().withColumn("__case", F.lit(True))
        joined = joined.join(known, "case_id", "left")
    else:
        joined = joined.withColumn("__case", F.lit(True))
    status = (
        F.when(F.col("__case").isNull(), "case_not_found")
        .when(F.col("__filled").isNull(), "empty_graph")
        .when(F.col("start").isNull(), "start_not_found")
        .when(F.col("goal").isNull(), "goal_not_found")
    )
    return joined.select("request_id", "case_id", "start_node", "goal_node", "start", "goal", status.alias("status"))


def simple_graph(edges: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Cheapest parallel edge per (case, from, to); edges with an unknown end or no use are dropped."""
    used = edges.where(F.col("src_label").isNotNull() & F.col("dst_label").isNotNull())
    used = used.where(F.col("src_label") != F.col("dst_label"))
    if requests is not None:
        asked = broadcast_if_small(requests.select("case_id").distinct())
        used = used.join(asked, "case_id", "left_semi")
    return used.groupBy("case_id", F.col("src_label").alias("vertex"), F.col("dst_label").alias("next")).agg(
        F.min(step_cost(F.col("weight"))).alias("step")
    )


def _wide_vertices(graph: DataFrame, width: int) -> DataFrame:
    """Vertices with very many outgoing edges and the number of slices to cut them into."""
    degree = graph.groupBy("case_id", "vertex").agg(F.count(F.lit(1)).alias("degree"))
    slices = F.ceil(F.col("degree") / F.lit(width)).cast("int").alias("slices")
    return degree.where(F.col("degree") >= width).select("case_id", "vertex", slices)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def settle(
    requests: DataFrame, graph: DataFrame, heuristic: Heuristic | None = None, width: int = WIDE_VERTEX
) -> DataFrame:
    """Cheapest cost from the start of every request to each vertex cheaper than its goal.

    ``heuristic`` must never overestimate; a candidate is dropped when its cost plus the
    estimate exceeds the best cost of the goal. It needs ``goal_level`` on the requests and
    ``next_level`` on the graph.
    """
    wide = broadcast_if_small(materialize(_wide_vertices(graph, width)))
    sliced = (
        graph.join(wide, ["case_id", "vertex"], "left")
        .withColumn("slice", F.pmod(F.xxhash64("next"), F.coalesce(F.col("slices"), F.lit(1))).cast("int"))
        .drop("slices")
    )
    # Laid out once by the join key of the loop; the rounds shuffle only the moving vertices.
    edges = checkpoint_laid_out(sliced, _partitions(graph), "case_id", "vertex", "slice")

    few = requests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    nothing = F.lit(None).cast("string")
    identity = ["request_id", "case_id", "goal", *(["goal_level"] if heuristic else [])]
    held = Scratch(
        requests.select(
            *identity,
            F.col("start").alias("vertex"),
            F.struct(
                F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), nothing.alias("previous")
            ).alias("best"),
            F.lit(True).alias("moved"),
        ),
        "state",
    )
    while True:
        state = held.frame
        goal_cost = state.where(F.col("vertex") == F.col("goal")).select(
            "request_id", F.col("best.cost").alias("goal_cost")
        )
        goal_cost = F.broadcast(goal_cost) if few else goal_cost
        open_rows = (
            state.where("moved AND vertex <> goal")
            .join(wide, ["case_id", "vertex"], "left")
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)))
        )
        candidates = (
            open_rows.join(edges, ["case_id", "vertex", "slice"])
            .select(
                *identity,
                *(["next_level"] if heuristic else []),
                F.col("next").alias("vertex"),
                F.struct(
                    (F.col("best.cost") + F.col("step")).alias("cost"),
                    (F.col("best.hops") + 1).alias("hops"),
                    F.col("vertex").alias("previous"),
                ).alias("best"),
            )
            .join(goal_cost, "request_id", "left")
        )
        ahead = (
            heuristic(F.col("vertex"), F.col("goal"), F.col("next_level"), F.col("goal_level"))
            if heuristic
            else F.lit(0.0)
        )
        candidates = candidates.where(
            F.col("goal_cost").isNull() | (F.col("best.cost") + ahead <= F.col("goal_cost"))
        ).select(*identity, "vertex", "best")
        known = state.select(*identity, "vertex", "best", F.col("best").alias("old"))
        merged = (
            known.unionByName(candidates, allowMissingColumns=True)
            .groupBy(*identity, "vertex")
            .agg(F.min("best").alias("best"), F.max("old").alias("old"))
        )
        cheaper = F.col("old").isNull() | (
            F.struct(F.col("best.cost"), F.col("best.hops")) < F.struct(F.col("old.cost"), F.col("old.hops"))
        )
        advanced = Scratch(merged.withColumn("moved", cheaper).drop("old"), "state")
        held.discard()
        held = advanced
        if not held.frame.where("moved AND vertex <> goal").limit(1).count():
            return held.frame.drop("moved")


def walk_back(settled: DataFrame, requests: DataFrame) -> DataFrame:
    """Vertex labels from start to goal of each request that reached its goal."""
    state = settled.select(
        "request_id", F.col("vertex").alias("at"), F.col("best.previous").alias("previous"), F.col("best.hops").alias("hops")
    )
    walk = materialize(
        settled.where(F.col("vertex") == F.col("goal")).select(
            "request_id",
            F.array("vertex").alias("path"),
            F.col("best.previous").alias("at"),
            F.round("best.cost", COST_DIGITS).alias("total_cost"),
            F.col("best.hops").alias("hops"),
        )
    )
    longest = walk.agg(F.max("hops")).first()[0] or 0
    for step in range(1, longest + 1):
        here = state.select("request_id", "at", F.col("previous").alias("__previous"))
        walk = (
            walk.join(here, ["request_id", "at"], "left")
            .withColumn(
                "path", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), F.col("path"))).otherwise(F.col("path"))
            )
            .withColumn("at", F.col("__previous"))
            .drop("__previous")
        )
        if step % 8 == 0:
            walk = materialize(walk)
    return walk.select("request_id", "path", "total_cost", "hops")


def _visited(settled: DataFrame, estimate: Column) -> DataFrame:
    """Vertices taken off the queue: those estimated below the goal's cost, and the goal itself."""
    goal_cost = settled.where(F.col("vertex") == F.col("goal")).select(
        "request_id", F.col("best.cost").alias("goal_cost")
    )
    seen = F.col("goal_cost").isNull() | (F.col("vertex") == F.col("goal")) | (estimate < F.col("goal_cost"))
    return (
        settled.join(broadcast_if_small(goal_cost), "request_id", "left")
        .groupBy("request_id")
        .agg(F.count_if(seen).cast("long").alias("visited_nodes_count"))
    )


def _answer(requests: DataFrame, settled: DataFrame, estimate: Column, extra: list[str]) -> DataFrame:
    found = walk_back(settled, requests)
    counted = _visited(settled, estimate)
    joined = requests.join(found, "request_id", "left").join(counted, "request_id", "left")
    ok = F.col("total_cost").isNotNull()
    status = F.coalesce(F.col("status"), F.when(ok, "ok").otherwise("no_path"))
    return joined.select(
        "request_id",
        "case_id",
        "start_node",
        "goal_node",
        status.alias("status"),
        ok.alias("is_path_found"),
        F.coalesce(F.col("path"), F.array().cast("array<string>")).alias("path"),
        F.coalesce(F.col("total_cost"), F.lit(float("inf"))).alias("total_cost"),
        F.coalesce(F.col("visited_nodes_count"), F.lit(0).cast("long")).alias("visited_nodes_count"),
        *extra,
    )


def cheapest_path(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, cases: DataFrame | None = None, width: int = WIDE_VERTEX
) -> DataFrame:
    """Cheapest directed path of each request, with a status instead of an error."""
    resolved = materialize(resolve_requests(requests, nodes, cases))
    valid = resolved.where(F.col("status").isNull())
    graph = simple_graph(edges, valid)
    settled = settle(valid, graph, width=width)
    return _answer(resolved, settled, F.col("best.cost"), [])


def goal_directed_path(
    requests: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    cases: DataFrame | None = None,
    heuristic: Heuristic = privilege_gap,
    level: str = "privilege_level",
    admissible: bool = False,
    width: int = WIDE_VERTEX,
) -> DataFrame:
    """As ``cheapest_path``, with the heuristic at the start reported as ``heuristic_cost``.

    The cost is always the true minimum. A heuristic that never overestimates may be declared
    ``admissible``; then it also narrows the search.
    """
    resolved = materialize(resolve_requests(requests, nodes, cases))
    valid = resolved.where(F.col("status").isNull())
    levels = (
        nodes.join(broadcast_if_small(valid.select("case_id").distinct()), "case_id", "left_semi")
        .groupBy("case_id", F.col("node_label").alias("vertex"))
        .agg(F.max(F.col("properties")[level].try_cast("double")).alias("level"))
    )
    at_start = levels.select("case_id", F.col("vertex").alias("start"), F.col("level").alias("start_level"))
    at_goal = levels.select("case_id", F.col("vertex").alias("goal"), F.col("level").alias("goal_level"))
    placed = materialize(
        resolved.join(at_start, ["case_id", "start"], "left")
        .join(at_goal, ["case_id", "goal"], "left")
        .withColumn(
            "heuristic_cost",
            F.round(
                heuristic(F.col("start"), F.col("goal"), F.col("start_level"), F.col("goal_level")), COST_DIGITS
            ),
        )
    )
    chosen = placed.where(F.col("status").isNull())
    graph = simple_graph(edges, valid)
    if admissible:
        next_level = levels.select("case_id", F.col("vertex").alias("next"), F.col("level").alias("next_level"))
        graph = graph.join(next_level, ["case_id", "next"], "left")
    settled = settle(chosen, graph, heuristic if admissible else None, width=width)
    estimated = (
        settled.drop("goal_level")
        .join(levels, ["case_id", "vertex"], "left")
        .join(broadcast_if_small(chosen.select("request_id", "goal_level")), "request_id", "left")
        .withColumn("h", heuristic(F.col("vertex"), F.col("goal"), F.col("level"), F.col("goal_level")))
    )
    return _answer(placed, estimated, F.col("best.cost") + F.col("h"), ["heuristic_cost"])


__all__ = [
    "cheapest_path",
    "goal_directed_path",
    "privilege_gap",
    "resolve_requests",
    "settle",
    "simple_graph",
    "walk_back",
    "zero_heuristic",
]
