"""Components, breadth-first distances and connected samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.graph import dense_index, induced, symmetrize
from loomgraph.operators.ranks import placed
from loomgraph.operators.sizes import partitions
from loomgraph.store import bucketed, cut, drop


def largest_component(edges: DataFrame) -> DataFrame:
    """(id) of the largest weak component; of equal ones that with the smallest id."""
    cc = cut(connected_components(edges), "lcc")
    top = cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("t"))
    return cc.join(F.broadcast(top.select((-F.col("t.neg")).alias("component"))), "component", "left_semi").select("id")


def earliest_largest_component(edges: DataFrame) -> DataFrame:
    """(id) of the largest weak component of ``edges`` (src, dst, place); of equal ones that with the earliest edge."""
    cc = cut(connected_components(edges), "lcc")
    sizes = cc.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    first = edges.join(cc, edges["src"] == cc["id"]).groupBy("component").agg(F.min("place").alias("place"))
    top = sizes.join(first, "component").agg(F.max(F.struct("n", (-F.col("place")).alias("late"), "component")).alias("t"))
    return cc.join(F.broadcast(top.select(F.col("t.component").alias("component"))), "component", "left_semi").select("id")


def restrict_to_lcc(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges inside the largest component, and how many nodes were dropped."""
    ids = cut(largest_component(edges), "lcc")
    every = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return induced(edges, ids), every.join(ids, "id", "left_anti").count()


def _arcs_to_walk(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Both directions of the edges inside ``nodes``, in as many buckets by their source as the arcs need; repeats do no harm to a search.

    Edges are restricted before they are turned round, so that those outside are moved once at most.
    """
    inside = edges.where("src <> dst")
    inside = cut(induced(inside, nodes) if nodes is not None else inside.select("src", "dst"), "inside")
    both = bucketed(symmetrize(inside), "src", partitions(edges.sparkSession, 2 * inside.count()), ["src"])
    drop(inside)
    return both


#: Layers of a search that are one frame each before they are written together.
LAYERS = 16


def bfs_distances(edges: DataFrame, start: int, nodes: DataFrame | None = None, at_least: int | None = None) -> DataFrame:
    """(id, dist) of the nodes reachable from ``start``, direction ignored.

    ``nodes`` restricts the walk; ``at_least`` ends it after the layer with
    which so many nodes are reached. Arcs lie in buckets by their source, so a
    layer moves its own nodes only; layers are written to the shared folder.
    """
    spark = edges.sparkSession
    both = _arcs_to_walk(edges, nodes)
    seen = front = cut(spark.createDataFrame([(start, 0)], "id long, dist int"), "bfs")
    # direction is ignored, so a layer's neighbours lie in it or in the layers next to it
    last, total, depth = front, 1, 0
    while at_least is None or total < at_least:
        depth += 1
        reached = both.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        near = front.select("id").unionAll(last.select("id"))
        last, front = front, cut(reached.join(near, "id", "left_anti").select("id", F.lit(depth).cast("int").alias("dist")), "bfs")
        n = front.count()
        if not n:
            break
        seen, total = seen.unionAll(front), total + n
        if depth % LAYERS == 0:  # else the plan grows with the depth
            seen = cut(seen, "bfs")
    drop(both)
    return seen


def walk_order(edges: DataFrame, start: int, seed: int, nodes: DataFrame | None = None, at_least: int | None = None) -> DataFrame:
    """(id, dist, ord): the order in which a breadth-first walk from ``start`` visits nodes, direction ignored.

    A first-in, first-out queue visits the neighbours of an earlier node
    before those of a later one; neighbours of one node come in the order of
    md5(seed:id). So a layer is in the order of (least rank of a neighbour in
    the layer before, key, id), and ranks are passed on from layer to layer:
    a layer is sorted in ranges and moves its own nodes only. ``nodes`` and
    ``at_least`` are those of ``bfs_distances``.
    """
    spark = edges.sparkSession
    both = _arcs_to_walk(edges, nodes)
    kinds = "id long, dist int, ord long"
    seen = front = cut(spark.createDataFrame([(start, 0, 0)], kinds), "walk")
    last, total, depth = front, 1, 0
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    while at_least is None or total < at_least:
        depth += 1
        reached = both.join(front.select(F.col("id").alias("src"), "ord"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("ord").alias("parent"))
        fresh = cut(reached.join(front.select("id").unionAll(last.select("id")), "id", "left_anti"), "walk")
        if fresh.isEmpty():
            break
        ranked, n = placed(fresh, [F.col("parent"), key, F.col("id")])
        last, front = front, cut(ranked.select("id", F.lit(depth).alias("dist"), (F.col("place") + total).alias("ord")), "walk")
        seen, total = seen.unionAll(front), total + n
        if depth % LAYERS == 0:
            seen = cut(seen, "walk")
    drop(both)
    return seen


def walk_sample(edges: DataFrame, nodes: DataFrame, fraction_pct: float, seed: int, start: int) -> DataFrame:
    """(id): the first ``fraction_pct`` percent of ``nodes`` that a walk from ``start`` visits; connected, as each node follows a neighbour."""
    k = sample_size(nodes.count(), fraction_pct)
    return walk_order(edges, start, seed, nodes, at_least=k).where(F.col("ord") < k).select("id")


def sample_size(n: int, fraction_pct: float) -> int:
    return max(1, int(n * fraction_pct / 100))


def connected_sample(edges: DataFrame, nodes: DataFrame, fraction_pct: float, seed: int, start: int | None = None) -> DataFrame:
    """(id): a connected sample of ``fraction_pct`` percent of ``nodes``.

    The first k nodes by (distance from the start, md5(seed:id)): whole layers
    and a part of the last, so connected by construction. The default start is
    the node with the lowest md5(seed:id). May return fewer nodes if the
    component is smaller. 100 percent and above returns all nodes.
    """
    if fraction_pct >= 100:
        return nodes.select("id")
    k = sample_size(nodes.count(), fraction_pct)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    if start is None:
        first = nodes.select("id").orderBy(order, "id").limit(1).first()
        if first is None:
            return nodes.select("id")
        start = first["id"]
    dist = bfs_distances(edges, start, nodes, at_least=k)
    last = dist.agg(F.max("dist")).first()[0]
    inner = dist.where(F.col("dist") < last)
    need = k - inner.count()
    # only the last layer is cut, by ranks in ranges of its keys: no task sees all of it
    edge = dense_index(dist.where(F.col("dist") == last).select(F.struct(order.alias("key"), "id").alias("id")))
    return inner.select("id").unionAll(edge.where(F.col("idx") < max(0, need)).select(F.col("id.id").alias("id")))
