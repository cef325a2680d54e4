"""Graphs: nodes (id, ordinal) and directed weighted edges (edge_ord, src, dst, weight).

Covers N1-N14, A57-A59, J17, P39-P41. A symmetric edge is two rows. Shortest paths
relax frontiers with joins; rounds are written to the shared folder, so a graph of any
size keeps a short lineage and survives lost executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import saved

#: Steps of shortest paths between two writes.
RELAXATIONS = 3


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """N1, N2."""
    return nodes.unionByName(more, allowMissingColumns=True)


def add_edges(edges: DataFrame, nodes: DataFrame, more: DataFrame, symmetric: bool = True) -> DataFrame:
    """edges with more (a, b, weight) between known node ids; unknown ends are left out; symmetric ones are two rows."""
    known = nodes.select("id")
    fine = more.join(known, more["a"] == known["id"], "left_semi").join(known, more["b"] == known["id"], "left_semi")
    forward = fine.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    both = forward.unionByName(fine.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")) if symmetric else forward
    return edges.unionByName(both, allowMissingColumns=True)


def cardinality(nodes: DataFrame) -> DataFrame:
    """N5."""
    return nodes.agg(F.count("*").alias("nodes"))


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both end nodes' rows; edges short of one are left out."""
    a = nodes.select([F.col(c).alias(f"src_{c}") for c in nodes.columns])
    b = nodes.select([F.col(c).alias(f"dst_{c}") for c in nodes.columns])
    return edges.join(a, F.col("src") == F.col("src_id")).join(b, F.col("dst") == F.col("dst_id"))


def adjacency(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """i, j, value: the weight of the last parallel edge, or 1."""
    value = F.max_by("weight", "edge_ord") if weighted else F.lit(1.0)
    return edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(value.alias("value"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree; parallel edges count each (A57-A59). One union and one aggregation."""
    ends_of = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends_of.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = nodes.select("id").join(counts, "id", "left").select("id", zero("out_degree").alias("out_degree"), zero("in_degree").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def path_forest(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """src, dst, distance, pred: for all or the given sources the tree of shortest paths to all they reach; a source reaches itself at 0, without pred.

    Of equally short paths the one whose last step comes from the nearer (then, by
    ordinal, the earlier) node is taken. Weights are not negative; a step of weight 0
    never leads back.

    What a round improved is relaxed in the next if it lies in the current bucket of
    distances; the rest waits, so that little is relaxed twice. Buckets double in
    width. A candidate carries its predecessor, and the least candidate of a node wins,
    so trees need no pass of their own. RELAXATIONS steps are one plan and one write.
    """
    order = nodes.select(F.col("id").alias("u"), F.col("ordinal").cast("long").alias("u_ord"))
    arcs = saved(edges.where("src <> dst").groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("weight").cast("double").alias("w")).join(order, "u", "left"), "arcs")
    key = nodes.schema["id"].dataType.simpleString()
    start = (nodes if sources is None else sources).select(F.col("id").alias("src")).distinct()
    # In the order in which candidates are compared; `zeros` counts the last steps of weight 0, `open` says that it is yet to be relaxed.
    kind = f"struct<distance:double,zeros:int,at:double,at_zeros:int,u_ord:long,pred:{key},open:boolean>"
    root = F.struct(F.lit(0.0), F.lit(0), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(True)).cast(kind)
    best = start.select("src", F.col("src").alias("dst"), root.alias("m"))
    width = (arcs.agg(F.avg("w")).first()[0] or 0.0) * RELAXATIONS
    bucket = width
    for _ in range(rounds):
        step = best
        for _ in range(RELAXATIONS):
            step = _relaxed(step, arcs, bucket, kind)
        best = saved(step, "paths")
        least = best.where("m.open").agg(F.min("m.distance")).first()[0]
        if least is None:
            break
        if least >= bucket:
            bucket = max(2 * bucket, least + width)
    return best.select("src", "dst", "m.distance", "m.pred")


def _relaxed(best: DataFrame, arcs: DataFrame, bucket: float, kind: str) -> DataFrame:
    m = F.col("m")
    now = m["open"] & (m["distance"] <= bucket)
    met = best.join(arcs, (F.col("dst") == F.col("u")) & now, "left")
    # A row is sent on with each of its node's arcs; the least of equal ones is taken. So the table is read once a step.
    own = F.struct(F.col("dst").alias("dst"), m.withField("open", m["open"] & ~now).alias("m"))
    zero = F.col("w") == 0
    candidate = F.struct(m["distance"] + F.col("w"), F.when(zero, m["zeros"] + 1).otherwise(0), m["distance"], F.when(zero, m["zeros"]).otherwise(0), F.col("u_ord"), F.col("dst"), F.lit(True)).cast(kind)
    rows = met.select("src", F.explode(F.when(F.col("u").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("v").alias("dst"), candidate.alias("m"))))).alias("r"))
    return rows.select("src", "r.dst", "r.m").groupBy("src", "dst").agg(F.min("m").alias("m"))


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """src, dst, distance, path (ids) of every reachable pair (N6, N7), by the rules of `path_forest`.

    Pointers to predecessors are doubled: each round joins a stretch of a path with
    that before it, so the rounds are the logarithm of the steps.
    """
    forest = path_forest(nodes, edges, sources, rounds)
    held = saved(forest.select("src", "dst", "distance", F.col("pred").alias("jump"), F.array("dst").alias("path")), "walks")
    while not held.where("jump is not null").isEmpty():
        before = held.select("src", F.col("dst").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("head"))
        longer = held.where("jump is not null").join(before, ["src", "jump"]).select("src", "dst", "distance", F.col("next").alias("jump"), F.concat("head", "path").alias("path"))
        held = saved(held.where("jump is null").unionByName(longer), "walks")
    return held.select("src", "dst", "distance", "path")


def closeness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """id, closeness: reachable others over their summed distances; 0 if none (N8). paths is a forest or has the same columns."""
    sums = paths.where("src <> dst").groupBy(F.col("src").alias("id")).agg((F.count("*") / F.sum("distance")).alias("c"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("closeness"))


def betweenness(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """id, betweenness: inner nodes of one path an ordered pair, over (n - 1)(n - 2).

    A node is inside the paths to all that hang below it in a source's tree. Those are
    counted by doubling pointers: below a node are those within 2^k steps, and those
    within 2^k steps of a node that is 2^k steps below.
    """
    # The source itself is inside none of its paths: pointers end below it.
    jump = F.when(F.col("pred") != F.col("src"), F.col("pred"))
    held = saved(forest.where("src <> dst").select("src", "dst", jump.alias("jump"), F.lit(1).cast("long").alias("below")), "subtrees")
    while not held.where("jump is not null").isEmpty():
        still = held.where("jump is not null")
        gained = still.groupBy("src", F.col("jump").alias("dst")).agg(F.sum("below").alias("gained"))
        further = still.join(held.select("src", F.col("dst").alias("jump"), F.col("jump").alias("next")), ["src", "jump"]).select("src", "dst", "next")
        held = saved(held.join(gained, ["src", "dst"], "left").join(further, ["src", "dst"], "left").select("src", "dst", F.col("next").alias("jump"), (F.col("below") + F.coalesce("gained", F.lit(0))).alias("below")), "subtrees")
    inner = held.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("below") - 1).alias("c"))
    n = nodes.agg(F.count("*").alias("n"))
    scale = F.greatest((F.col("n") - 1) * (F.col("n") - 2), F.lit(1))
    return nodes.select("id").join(inner, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("c", F.lit(0)) / scale).alias("betweenness"))


def eigenvector(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, most: int = 1000, every: int = 5, small: int = 2000) -> DataFrame:
    """id, value: power iteration on A + I from all ones, in Euclidean norm; the last iterate even if it has not settled; no rows without nodes.

    Up to `small` nodes the adjacency (at most small^2 cells) is iterated on the
    driver. Beyond, a round is a join and an aggregation; every few rounds the
    vector is written down, which cuts its lineage, and its change is looked at.
    """
    ids = [r[0] for r in nodes.select("id").orderBy("id").limit(small + 1).collect()]
    if len(ids) <= small:
        return _eigenvector_small(nodes, edges, ids, tolerance, most)
    a = saved(adjacency(edges).select(F.col("i").alias("r"), F.col("j").alias("c"), "value"), "adjacency")
    x = saved(nodes.select("id", F.lit(1.0).alias("x")), "eigen")

    def one(v: DataFrame) -> DataFrame:
        moved = a.join(v, a["c"] == v["id"]).select(F.col("r").alias("id"), (F.col("value") * F.col("x")).alias("x")).unionByName(v)
        total = moved.groupBy("id").agg(F.sum("x").alias("x"))
        norm = total.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return total.crossJoin(F.broadcast(norm)).select("id", (F.col("x") / F.col("norm")).alias("x"))

    done = 0
    while done < most:
        before = x
        for _ in range(min(every, most - done)):
            before = x
            x = one(x)
            done += 1
        x = saved(x, "eigen")
        change = x.join(before.select("id", F.col("x").alias("y")), "id").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d")).first().d
        if change is None or change < tolerance:
            break
    return x.select("id", F.col("x").alias("value"))


def _eigenvector_small(nodes: DataFrame, edges: DataFrame, ids: list, tolerance: float, most: int) -> DataFrame:
    kind = nodes.schema["id"].dataType.simpleString()
    at = {x: i for i, x in enumerate(ids)}
    a = np.eye(len(ids))
    for r in adjacency(edges).toLocalIterator():
        a[at[r.i], at[r.j]] += r.value
    x = np.ones(len(ids))
    for _ in range(most if ids else 0):
        y = a @ x
        y /= np.linalg.norm(y)
        change, x = np.linalg.norm(y - x), y
        if change < tolerance:
            break
    return nodes.sparkSession.createDataFrame([(k, float(x[i])) for k, i in at.items()], f"id {kind}, value double")


def random_layout(nodes: DataFrame, seed: int, radius: float = 500.0, flat: bool = True) -> DataFrame:
    """nodes with x, y, z uniform within the radius on each axis, reproducible by node."""
    from popspark.functions.vectors import hashed_unit

    axis = lambda a: (hashed_unit(seed, a, F.col("id")) * 2 - 1) * radius
    return nodes.withColumns({"x": axis("x"), "y": axis("y"), "z": F.lit(0.0) if flat else axis("z")})


def small_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Four nodes: a triangle of symmetric edges and one directed edge out of it."""
    # Fixed values.
    sizes = {"A": 1.0, "B": 1.0, "C": 1.5, "D": 2.0}
    nodes = spark.createDataFrame([(n, i, v) for i, (n, v) in enumerate(sizes.items())], "id string, ordinal int, size double")
    pairs = [("A", "B", 1.0), ("B", "C", 2.0), ("C", "A", 3.0)]
    rows = [e for a, b, w in pairs for e in ((a, b, w), (b, a, w))] + [("C", "D", 4.0)]
    return nodes, spark.createDataFrame([(i, *e) for i, e in enumerate(rows)], "edge_ord int, src string, dst string, weight double")


def knn_edges(points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """edge_ord, src, dst, weight: each point to its k nearest others, ties to the smaller key."""
    from .neighbours import nearest

    near = nearest(points, key, vector, k)
    return near.select((F.col("src") * k + F.col("rank")).alias("edge_ord"), "src", "dst", "weight")
