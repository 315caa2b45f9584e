"""Graphs as edge tables. Iterations cut their lineage by tables stored in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from itertools import count
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rounds whose results stay apart before they are written together.
PARTS = 16


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; a folder of its own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plantlens-"))


def _stored(df: DataFrame) -> DataFrame:
    """df written into the checkpoint folder and read back. Unlike checkpoint() that runs it once, and the optimizer sees its real
    size; sizes estimated through rounds of joins are products of products, numbers with ever more digits.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, for plans that read a step several times."""
    ensure_checkpoints(df.sparkSession)
    return _stored(df)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _spread(step: DataFrame, roots: DataFrame, name: str, limit: int | None) -> DataFrame:
    """(node, name) with the least number of steps (a, b) from any root; ends when no new node is met, or at the limit."""
    seen = roots.select("node").distinct().withColumn(name, F.lit(0))
    front = seen
    for n in count(1) if limit is None else range(1, limit + 1):
        front = _stored(front.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn(name, F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.union(front) if n % PARTS else _stored(seen.union(front))
    return seen


def bfs_hops(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hops) of the nodes that undirected edges (a, b) join to any source, within max_hops if it is given.

    Edges may repeat: every step is used once, and nodes are made distinct after it, so that no task holds a set of edges.
    """
    ensure_checkpoints(edges.sparkSession)
    steps = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _spread(_stored(steps), sources, "hops", max_hops)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) with the least node of each component, by alternating large-star and small-star steps."""
    ensure_checkpoints(edges.sparkSession)
    now = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        least = both_ways(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both_ways(now).join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = _stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def _hung(edges: DataFrame, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, depth, root) of all nodes of distinct edges, and the edges (a, b, steps) between roots that this leaves.

    A node that one edge leads to hangs on that edge's start, `depth` edges below the next root above it: a node that no edge
    or several lead to, or that is in fixed. Trees and chains cost as many rounds as their depth has binary digits.
    """
    free = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("parent")).where("n = 1")
    if fixed is not None:
        free = free.join(fixed.select("node").distinct(), "node", "left_anti")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    held = _stored(depths(nodes.join(free.select("node", "parent"), "node", "left")))
    tops = held.where("depth = 0").select(F.col("node").alias("b"))
    steps = edges.join(tops, "b", "left_semi").join(held.select(F.col("node").alias("a"), "root", "depth"), "a")
    return held, steps.select(F.col("root").alias("a"), "b", (F.col("depth") + 1).alias("steps"))


def longest_path_layers(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """(node, layer): the most edges of a path that ends in the node. A cycle, or a layer beyond the cap, is an error.

    Nodes hang on the roots above them. Each round takes away the roots that no edge leads to any more, so that there are as
    many rounds as nodes with several edges to them follow one another.
    """
    ensure_checkpoints(edges.sparkSession)
    edges = _stored(edges.select("a", "b").distinct())
    held, steps = _hung(edges)
    if not held.where("depth is null").isEmpty():
        raise RuntimeError("edges have a cycle")
    left = _stored(steps.groupBy("a", "b").agg(F.max("steps").alias("steps")))
    waiting = held.where("depth = 0").select("node", F.lit(0).cast("long").alias("layer"))
    done, rounds = None, count(1)
    while not left.isEmpty():
        ready = _stored(waiting.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            raise RuntimeError("edges have a cycle")
        done = ready if done is None else done.union(ready) if next(rounds) % PARTS else _stored(done.union(ready))
        below = left.join(ready.select(F.col("node").alias("a"), "layer"), "a").groupBy(F.col("b").alias("node")).agg(F.max(F.col("layer") + F.col("steps")).alias("least"))
        waiting = _stored(waiting.join(ready, "node", "left_anti").join(below, "node", "left").select("node", F.greatest("layer", "least").alias("layer")))
        left = _stored(left.join(ready.select(F.col("node").alias("a")), "a", "left_anti"))
    roots = waiting if done is None else done.union(waiting)
    layers = _stored(held.join(roots.select(F.col("node").alias("root"), F.col("layer").alias("top")), "root").select("node", (F.col("top") + F.col("depth")).cast("int").alias("layer")))
    if cap is not None and not layers.where(F.col("layer") > cap).isEmpty():
        raise RuntimeError(f"paths longer than {cap} edges")
    return layers


def strong_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node that lies on a cycle; component is the least node of its strong component.

    The graph is first shrunk: sources and sinks go, and chains are drawn together. What is left goes by forward-backward
    colouring, both ways at once: every node takes the least node that leads to it and the least node that it leads to. Where
    these are one node, it is that node's component. Edges between nodes whose two colours differ can be on no cycle and go.
    The number of passes follows how deep components are nested behind one another, that of rounds in a pass the length of
    paths in the shrunk graph. If max_rounds is given and colours still change, or edges are left, in the last one, that is an
    error.
    """
    ensure_checkpoints(edges.sparkSession)
    rounds = count(1)

    def more() -> None:
        if next(rounds) == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")

    loops, joints = _stored(edges.where("a = b").select(F.col("a").alias("node")).distinct()), []
    left, found = _stored(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        left, closed = _shrunk(left, joints, more)
        loops = _stored(loops.union(closed).distinct())
        if left.isEmpty():
            break
        colours = _least_both_ways(left, more)
        alone = Window.partitionBy("first")
        held = _stored(colours.where("first = last").withColumn("many", F.count("*").over(alone)).where("many > 1").select("node", F.col("first").alias("component")))
        found = held if found is None else found.union(held)
        open_ = colours.where("first <> last")
        of = lambda end: open_.select(F.col("node").alias(end), "first", "last")
        left = _stored(left.join(of("a"), "a").join(of("b"), ["b", "first", "last"]).select("a", "b"))
    alone = loops.select("node", F.col("node").alias("component"))
    found = alone if found is None else found.union(alone.join(found, "node", "left_anti"))
    # a joint is on a cycle if the nodes on both sides of it are in one component; those drawn in last come first
    for joint in reversed(joints):
        of = lambda end: found.select(F.col("node").alias(end), "component")
        back = joint.join(of("a"), "a").join(of("b"), ["b", "component"]).select("node", "component")
        found = _stored(found.join(back.select("node"), "node", "left_anti").union(back))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _shrunk(edges: DataFrame, joints: list[DataFrame], more: Callable[[], None], worth: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Edges without sources and sinks, and with chains drawn together, as long as that leaves less than `worth` of them; (node) of closed chains.

    A joint is a node with one edge to it and one from it. Of joints in a row those with a hash above their neighbours' are
    drawn in, each round about a third of a chain; (node, a, b) of these is added to joints. A closed chain ends as an edge
    from a node to itself. more is called before each round.
    """
    closed, size = edges.select(F.col("a").alias("node")).limit(0), edges.count()
    while size:
        more()
        kept = _stored(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        ends = kept.select(F.col("b").alias("node"), "a", F.lit(None).cast(kept.schema["b"].dataType).alias("b")).union(kept.select("a", F.lit(None).cast(kept.schema["a"].dataType), "b"))
        chain = ends.groupBy("node").agg(F.count("a").alias("n_in"), F.count("b").alias("n_out"), F.min("a").alias("a"), F.min("b").alias("b")).where("n_in = 1 and n_out = 1").select("node", "a", "b")
        beside = chain.select("node", F.explode(F.array("a", "b")).alias("next")).join(chain.select(F.col("node").alias("next")), "next")
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        joint = _stored(chain.join(beside.where(rank("next") > rank("node")).select("node"), "node", "left_anti"))
        drawn = joint.select(F.col("node").alias("a")), joint.select(F.col("node").alias("b"))
        now = _stored(kept.join(drawn[0], "a", "left_anti").join(drawn[1], "b", "left_anti").select("a", "b").union(joint.select("a", "b")).distinct())
        joints.append(joint)
        closed = closed.union(now.where("a = b").select(F.col("a").alias("node")))
        edges, before = now.where("a <> b"), size
        size = edges.count()
        if size > worth * before:
            break
    return edges, closed


def _least_both_ways(edges: DataFrame, more: Callable[[], None], hops: int = 4) -> DataFrame:
    """(node, first, last): the least node that leads to each node, and the least one that it leads to, itself included.

    more is called before each round of `hops` steps.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    step = lambda df, a, b, down, up: df.select(F.col(a).alias("at"), F.col(b).alias("to"), F.lit(down).alias("down"), F.lit(up).alias("up"))
    steps = _stored(step(edges, "a", "b", True, False).union(step(edges, "b", "a", False, True)).union(step(nodes, "node", "node", True, True)))
    state, seen = _stored(nodes.select("node", F.col("node").alias("first"), F.col("node").alias("last"))), None
    while True:
        total = state.agg(F.sum(F.xxhash64("node", "first", "last").cast("decimal(38,0)"))).first()
        if total == seen:
            return state
        seen = total
        more()
        for _ in range(hops):
            moved = steps.join(state, F.col("at") == F.col("node")).groupBy(F.col("to").alias("node"))
            state = moved.agg(F.min(F.when(F.col("down"), F.col("first"))).alias("first"), F.min(F.when(F.col("up"), F.col("last"))).alias("last"))
        state = _stored(state)


def cycle_nodes(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node) of the nodes that lie on a cycle themselves; nodes between two cycles don't. max_rounds as in strong_components."""
    return strong_components(edges, max_rounds).select("node")


def _least_steps(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) with the least number of edges from any start; every node is reached from one.

    Nodes hang on the roots above them, and starts are roots. Between roots, numbers sink until none does any more.
    """
    held, steps = _hung(edges, starts)
    steps = _stored(steps.groupBy("a", "b").agg(F.min("steps").alias("steps")))
    best = _stored(starts.select("node", F.lit(0).cast("long").alias("least")).distinct())
    front = best
    while not front.isEmpty():
        offers = front.join(steps, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.col("least") + F.col("steps")).alias("offer"))
        front = _stored(offers.join(best, F.col("b") == F.col("node"), "left").where("least is null or offer < least").select(F.col("b").alias("node"), F.col("offer").alias("least")))
        best = _stored(best.join(front.select("node"), "node", "left_anti").union(front))
    return held.join(best.select(F.col("node").alias("root"), "least"), "root").select("node", (F.col("least") + F.col("depth")).alias("depth"))


def feedback_edges(edges: DataFrame) -> DataFrame:
    """(a, b) of the edges that go against the order of their strong component; without them no cycle is left.

    The order is by steps from where the component is entered (from its least node, if it isn't), then by node.
    """
    edges = edges.select("a", "b").distinct()
    held = _stored(strong_components(edges))
    of = lambda end: held.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    placed = _stored(edges.join(of("b"), "b").join(of("a"), "a", "left"))
    inner = _stored(placed.where("a_component = b_component").select("a", "b"))
    entered = placed.where("a_component is null or a_component <> b_component").select(F.col("b").alias("node"), F.col("b_component").alias("component")).distinct()
    closed = held.select("component").distinct().join(entered, "component", "left_anti").select(F.col("component").alias("node"))
    depth = _least_steps(inner, entered.select("node").union(closed))
    at = lambda end: depth.select(F.col("node").alias(end), F.struct("depth", "node").alias(f"{end}_at"))
    return inner.join(at("a"), "a").join(at("b"), "b").where("b_at <= a_at").select("a", "b")


def layers_with_feedback(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, layer), the most edges of a path that ends in the node, over all but the feedback edges; and those."""
    against = _stored(feedback_edges(edges))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    layers = longest_path_layers(edges.select("a", "b").distinct().join(against, ["a", "b"], "left_anti"))
    return nodes.join(layers, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer")), against


def depths(parents: DataFrame) -> DataFrame:
    """parents (node, parent), one row for each node, to (node, depth, root): steps to the node without a parent above it.

    Leaves are laid aside as long as that halves the nodes, and follow their parents at the end. The rest goes by pointer
    doubling: a round lets every node look twice as far up, so that there are as many rounds as the depth has binary digits. A
    parent that is no node itself counts as none. Nodes on a cycle, or below one, have no depth and no root: a round closes
    the nodes of some depth if any open node has a depth at all, so that those left after a round that closes none are endless.
    """
    ensure_checkpoints(parents.sparkSession)
    nodes = parents.select("node", F.col("parent").alias("up"))
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    core, laid = _stored(nodes.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"))), []
    size = core.count()
    while size:
        inner = _stored(core.join(core.select(F.col("up").alias("node")).distinct(), "node", "left_semi"))
        many = inner.count()
        if 2 * many > size:
            break
        laid.append(core.join(inner.select("node"), "node", "left_anti"))
        core, size = inner, many
    top = F.col("up").isNull()
    state = core.withColumn("depth", F.when(top, 0).otherwise(1).cast("long")).withColumn("root", F.coalesce("up", "node"))
    waiting, before = state.where(~top).count() if size else 0, None
    while waiting and waiting != before:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"))
        moved = state.where(~top).join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("root"))
        state = _stored(state.where(top).union(moved))
        waiting, before = state.where(~top).count(), waiting
    found = state.select("node", F.when(top, F.col("depth")).alias("depth"), F.when(top, F.col("root")).alias("root"))
    for leaves in reversed(laid):
        above = found.select(F.col("node").alias("up"), F.col("depth").alias("more"), F.col("root").alias("top"))
        own = leaves.join(above, "up", "left").select("node", F.when(top, F.lit(0).cast("long")).otherwise(F.col("more") + 1).alias("depth"), F.when(top, F.col("node")).otherwise(F.col("top")).alias("root"))
        found = _stored(found.union(own))
    return found


def reachable(edges: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, depth) of what directed edges lead to from the roots, with the least depth; within max_hops if it is given."""
    ensure_checkpoints(edges.sparkSession)
    return _spread(_stored(edges.select("a", "b").distinct()), roots, "depth", max_hops)


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, node): edges to nodes that aren't there, nodes without any edge, and nodes with several parents."""
    ids = nodes.select("node").distinct()
    missing = edges.select(F.col("b").alias("node")).distinct().join(ids, "node", "left_anti").withColumn("issue", F.lit("MISSING_TARGET"))
    touched = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    alone = ids.join(touched, "node", "left_anti").withColumn("issue", F.lit("ORPHAN"))
    shared = edges.groupBy(F.col("b").alias("node")).agg(F.count_distinct("a").alias("n")).where("n > 1").select("node").withColumn("issue", F.lit("SHARED"))
    return missing.unionByName(alone).unionByName(shared).select("issue", "node")
