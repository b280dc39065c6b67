"""Graph operators on edge tables. Loops cut their lineage with reliable checkpoints and ask only whether anything is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.functions.scalars import half_up
from risklake.sources.lineage import Rounds, cut, stored

#: Walks stop where nothing is new; no graph has a path as long.
LONGEST = 1 << 60


def degree(edges: DataFrame) -> DataFrame:
    """Both ends of each edge come from one scan."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg((F.count("*") - F.sum("o")).alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def degree_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node's degrees, whether it is isolated, and the graph's mean degree, 2E / N."""
    d = nodes.select("id").join(degree(edges), "id", "left").na.fill(0)
    mean = d.agg(half_up(F.round(F.sum("degree") / F.count("*"), 9), 4).alias("mean_degree"))
    return d.crossJoin(F.broadcast(mean)).select("id", "in_degree", "out_degree", "degree", (F.col("degree") == 0).alias("isolated"), "mean_degree")


def instability(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out over distinct neighbours, instability, and the two smells."""
    pairs = edges.select("src", "dst").distinct()
    d = degree(pairs).withColumn("instability", half_up(F.round(F.col("out_degree") / F.col("degree"), 9), 4))
    god = ((F.col("in_degree") > 5) & (F.col("out_degree") > 10)) | (F.col("out_degree") > 15)
    return d.select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"), "instability", god.alias("god_module"), ((F.col("instability") > 0.8) & (F.col("in_degree") > 5)).alias("unstable"))


#: Roots of one mask.
LANES = 64


def lanes(seeds: DataFrame) -> DataFrame:
    """seeds(root, ...) -> root, lane, bit: roots in order, 64 to a lane, so that those of one graph share lanes if their ids are near each other."""
    numbered = seeds.select("root").distinct().orderBy("root").withColumn("_n", F.monotonically_increasing_id())
    return stored(numbered.select("root", F.floor(F.col("_n") / LANES).alias("lane"), (F.col("_n") % LANES).cast("int").alias("bit")))


def masks(edges: DataFrame, seeds: DataFrame, lane: DataFrame, max_depth: int = 10, types: list[str] | None = None, backward: bool = False) -> DataFrame:
    """seeds(root, node), lane as of lanes() -> lane, node, depth, fresh: the roots, as a mask of their bits, that reach the node first at this depth.

    A round has one row for each lane and node, whatever number of the lane's roots reach it."""
    used = edges if types is None else edges.filter(F.col("type").isin(*types))
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = stored(used.select(F.col(a).alias("node"), F.col(b).alias("_next")).distinct())
    rounds = Rounds(edges.sparkSession)
    start = seeds.select("root", "node").join(lane, "root").groupBy("lane", "node").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("seen"))
    state, new = rounds.write(start.withColumn("fresh", F.col("seen")), 0)
    depth = 0
    while new and depth < max_depth:
        depth += 1
        passed = state.filter("fresh <> 0").join(steps, "node").select("lane", F.col("_next").alias("node"), F.lit(0).cast("long").alias("seen"), "fresh")
        both = state.select("lane", "node", "seen", F.lit(0).cast("long").alias("fresh")).unionByName(passed).groupBy("lane", "node").agg(F.bit_or("seen").alias("_seen"), F.bit_or("fresh").alias("_met"))
        both = both.select("lane", "node", F.col("_seen").bitwiseOR(F.col("_met")).alias("seen"), F.col("_met").bitwiseAND(F.bitwise_not("_seen")).alias("fresh"))
        state, new = rounds.write(both, depth, "fresh <> 0")
    return rounds.all().filter("fresh <> 0").select("lane", "node", F.col("round").alias("depth"), "fresh")


def unfolded(found: DataFrame, lane: DataFrame) -> DataFrame:
    """found(lane, node, depth, fresh) -> root, node, depth: a row for each bit that is set."""
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.expr("fresh").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0))
    return found.select("lane", "node", "depth", bits.alias("bit")).join(lane, ["lane", "bit"]).select("root", "node", "depth")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, types: list[str] | None = None, backward: bool = False) -> DataFrame:
    """seeds(root, node): nodes in reach of each root with the least depth."""
    lane = lanes(seeds)
    return unfolded(masks(edges, seeds, lane, max_depth, types, backward), lane)


#: Types of nodes and counts in tasks.
ARROW = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
#: Edges of a graph that a task may hold; larger graphs are worked on by rounds.
SMALL = 1000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each graph's rows; the rows come sorted by the first column."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        starts = [0, *(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1).tolist()]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield [c[i:j] for c in now]
        rest = [c[starts[-1] :] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def each_graph(rows: DataFrame, work: Callable[..., list[np.ndarray]], schema: T.StructType) -> DataFrame:
    """rows(graph, src, dst, ...), edges with repeats: what `work` makes of the columns of each graph but the first, with the graph in front."""
    names = schema.fieldNames()
    kinds = [ARROW[f.dataType] for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for kind, *c in zip(kinds, *made, strict=True)], names=names)
        for graph, *columns in _runs(batches):
            out = work(*columns)
            if len(out[0]):
                made.append([np.repeat(graph[:1], len(out[0])), *out])
                n += len(out[0])
            if n > 50_000:
                yield flush()
                made, n = [], 0
        if made:
            yield flush()

    return rows.repartition("graph").sortWithinPartitions("graph").mapInArrow(run, schema)


def by_size(rows: DataFrame, most: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """rows(graph, ...): those of graphs with at most `most` of them, and the others, if there are any."""
    large = rows.groupBy("graph").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("graph")
    if large.isEmpty():
        return rows, None
    large = stored(large)
    return rows.join(large, "graph", "left_anti"), rows.join(large, "graph", "left_semi")


def _coded(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A graph's nodes in order, and which leads to which."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    leads = np.zeros((len(nodes), len(nodes)), bool)
    leads[at[: len(src)], at[len(src) :]] = True
    return nodes, leads


def _reach(leads: np.ndarray) -> np.ndarray:
    """Pairs with a path of one edge or more, by doubling."""
    while True:
        floats = leads.astype(np.float32)
        more = leads | (floats @ floats > 0)
        if (more == leads).all():
            return leads
        leads = more


def _closed(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    nodes, leads = _coded(src, dst)
    a, b = np.nonzero(_reach(leads))
    return [nodes[a], nodes[b]]


def closure(edges: DataFrame, most: int = SMALL) -> DataFrame:
    """All (key, src, dst) with a path of one edge or more within each key's graph. Graphs of up to `most` edges are closed within a task, one
    at a time; larger ones by masks of 64 roots, a row for each mask and node."""
    small, large = by_size(edges.select(F.col("key").alias("graph"), "src", "dst"), most)
    found = each_graph(small, _closed, T.StructType(small.schema.fields))
    if large is not None:
        pair = lambda c: F.struct("graph", F.col(c).alias("node"))
        steps = large.select(pair("src").alias("src"), pair("dst").alias("dst")).distinct()
        seeds = stored(steps.select(F.col("src").alias("root"), F.col("dst").alias("node")))
        lane = lanes(seeds)
        far = unfolded(masks(steps, seeds, lane, max_depth=LONGEST), lane)
        found = found.unionByName(far.select("root.graph", F.col("root.node").alias("src"), F.col("node.node").alias("dst")))
    return found.withColumnRenamed("graph", "key")


def _led(src: np.ndarray, dst: np.ndarray, goal: np.ndarray) -> list[np.ndarray]:
    nodes, leads = _coded(src, dst)
    met = np.zeros(len(nodes), bool)
    met[np.searchsorted(nodes, src[goal])] = True
    while True:
        more = met | leads[:, met].any(1)
        if (more == met).all():
            return [nodes[met]]
        met = more


def reaching(edges: DataFrame, goals: DataFrame, most: int = SMALL) -> DataFrame:
    """edges(graph, src, dst), goals(graph, node) -> graph, node: the nodes that reach a goal of their graph, goals among them."""
    loops = goals.select("graph", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("goal"))
    small, large = by_size(edges.select("graph", "src", "dst", F.lit(False).alias("goal")).unionByName(loops), most)
    found = each_graph(small, _led, T.StructType([small.schema["graph"], T.StructField("node", small.schema["src"].dataType)]))
    if large is not None:
        pair = lambda c: F.struct("graph", F.col(c).alias("node"))
        steps = large.filter("NOT goal").select(pair("src").alias("src"), pair("dst").alias("dst"))
        seeds = large.filter("goal").select(F.struct("graph", F.lit(None).cast("int").alias("node")).alias("root"), pair("src").alias("node")).distinct()
        found = found.unionByName(bfs(steps, seeds, max_depth=LONGEST, backward=True).select("node.graph", "node.node"))
    return found


def paths(edges: DataFrame, ends: DataFrame, max_depth: int = 8) -> DataFrame:
    """ends(start, goal): simple paths from each start to its goal. Only nodes that still reach the goal within the hops left are walked on."""
    pairs = edges.select("src", "dst").distinct()
    goals = ends.select(F.col("goal").alias("root"), F.col("goal").alias("node"))
    back = bfs(pairs, goals, max_depth, backward=True).select(F.col("root").alias("goal"), F.col("node").alias("dst"), F.col("depth").alias("_left"))
    steps = cut(pairs.join(back, "dst"))
    walks = ends.select("goal", F.col("start").alias("src"), F.array("start").alias("path")).distinct()
    done = None
    for depth in range(1, max_depth + 1):
        grown = walks.join(steps, ["goal", "src"]).filter(~F.array_contains("path", F.col("dst")) & (F.col("_left") <= max_depth - depth))
        grown = cut(grown.select("goal", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
        hit = grown.filter(F.col("src") == F.col("goal")).select("path")
        done = hit if done is None else done.unionByName(hit)
        walks = grown.filter(F.col("src") != F.col("goal"))
        if walks.isEmpty():
            break
    return done


def _mutual(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    nodes, leads = _coded(src, dst)
    reach = _reach(leads)
    np.fill_diagonal(reach, True)
    both = reach & reach.T
    size = both.sum(1)
    some = size > 1
    return [nodes[len(nodes) - 1 - both[:, ::-1].argmax(1)][some], nodes[some], size[some]]


def scc_by_graph(edges: DataFrame, graph: Column, most: int = SMALL) -> DataFrame:
    """scc() of edges that stay within their graph; graph is over src. Graphs of up to `most` edges are worked on in a task, one at a time."""
    small, large = by_size(edges.select(graph.alias("graph"), "src", "dst"), most)
    kind = small.schema["src"].dataType
    found = each_graph(small, _mutual, T.StructType([small.schema["graph"], T.StructField("component", kind), T.StructField("node", kind), T.StructField("size", T.LongType())])).drop("graph")
    return found if large is None else found.unionByName(scc(large))


def scc(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, each named by its largest node.

    A round colours every node with the largest node that reaches it; the nodes that reach their colour back are that
    colour's component. They leave the graph, and the rest goes round again. Only nodes whose colour has changed pass it on."""
    spark = edges.sparkSession
    left, n = Rounds(spark).write(edges.select("src", "dst").filter("src <> dst").distinct(), 0)
    kind, out = dict(edges.dtypes)["src"], None
    while n:
        trims, before, k = Rounds(spark), None, 0
        while n and n != before:  # nodes without a way in or out are in no component
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            before, (left, n), k = n, trims.write(inner.select("src", "dst"), k), k + 1
        if not n:
            break
        colours, k = Rounds(spark), 0
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour, moved = colours.write(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")), 0)
        while moved:
            k += 1
            passed = colour.filter("moved").join(left.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "colour", F.lit(None).cast(kind).alias("old"))
            both = colour.select("node", "colour", F.col("colour").alias("old")).unionByName(passed).groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
            colour, moved = colours.write(both.select("node", "colour", (F.col("colour") > F.col("old")).alias("moved")), k, "moved")
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").filter("_a = _b")
        tops = colour.filter("node = colour").select(F.col("colour").alias("root"), "node")
        reached = stored(bfs(same.select("src", "dst"), tops, max_depth=LONGEST, backward=True).select(F.col("root").alias("component"), "node"))
        found = reached.join(reached.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1"), "component").select("component", "node", "size")
        out = found if out is None else out.unionByName(found)
        gone = reached.select("node").distinct()
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left, n = Rounds(spark).write(rest, 0)
    return out if out is not None else spark.createDataFrame([], f"component {kind}, node {kind}, size long")


def cycles(edges: DataFrame) -> DataFrame:
    """members (sorted), length, severity: every elementary cycle of two nodes or more, of any length, once for each set of members.

    Cycles lie within components. One is walked from its smallest node, through larger nodes only, and no walk enters a node from which
    there is no way back to its start through such nodes: those are found first, by a backward search from every start at once."""
    spark = edges.sparkSession
    part = stored(scc(edges).select("component", "node"))
    pairs = edges.select("src", "dst").filter("src <> dst").distinct()
    inner = pairs.join(part.select(F.col("node").alias("src"), "component"), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("_other")), "dst")
    inner = stored(inner.filter("component = _other").select("src", "dst"))
    backs = Rounds(spark)
    back, new = backs.write(inner.filter("src > dst").select(F.col("dst").alias("first"), F.col("src").alias("node")), 0)
    k = 0
    while new:
        k += 1
        grown = back.join(inner.select(F.col("src").alias("_prev"), F.col("dst").alias("node")), "node").filter("_prev > first").select("first", F.col("_prev").alias("node")).distinct()
        back, new = backs.write(grown.join(backs.all().select("first", "node"), ["first", "node"], "left_anti"), k)
    back = backs.all().select("first", F.col("node").alias("dst"))
    steps = stored(inner.join(back, "dst").select("first", F.col("src").alias("last"), "dst"))
    closing = inner.select(F.col("src").alias("last"), F.col("dst").alias("first"), F.lit(True).alias("closes"))
    start = inner.filter("dst > src").select(F.col("src").alias("first"), "dst").join(back, ["first", "dst"], "left_semi").select("first", F.col("dst").alias("last"), F.array("first", "dst").alias("path"))
    rounds, k = Rounds(spark), 0
    closed = lambda walks: walks.join(closing, ["last", "first"], "left").select("first", "last", "path", F.coalesce("closes", F.lit(False)).alias("closes"))
    walks, new = rounds.write(closed(start), 0)
    while new:
        k += 1
        grown = walks.join(steps, ["first", "last"]).filter(~F.array_contains("path", F.col("dst"))).select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
        walks, new = rounds.write(closed(grown), k)
    found = rounds.all().filter("closes").select(F.array_sort("path").alias("members")).distinct()
    length = F.size("members")
    return found.select("members", length.alias("length"), F.when(length >= 4, "high").when(length == 3, "medium").otherwise("low").alias("severity"))


def cycle_report(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found: cycles() with graph; nodes(graph): per cycle also its graph's affected files and risk, by their share and the number of cycles."""
    files = found.select("graph", F.explode("members").alias("node")).distinct().groupBy("graph").agg(F.count("*").alias("affected"))
    many = found.groupBy("graph").agg(F.count("*").alias("_cycles"))
    total = nodes.groupBy("graph").agg(F.count("*").alias("_files"))
    risk = F.least(F.lit(100), half_up(F.round(100 * F.col("affected") / F.col("_files") + 5 * F.col("_cycles"), 9)).cast("long"))
    summed = files.join(many, "graph").join(total, "graph").select("graph", "affected", risk.alias("risk"))
    return found.join(summed, "graph")


def hubs(edges: DataFrame, graph: Column, first: int = 50, k: int = 10, most: int = SMALL) -> DataFrame:
    """graph: the graph that a node belongs to. How many of its first nodes reach each node; hubs are reached by 3 or have a degree of
    5, the top ones of each graph. Graphs of up to `most` edges are worked on in a task, one at a time."""
    rows = edges.select("src", "dst", F.col("src").alias("node")).withColumn("graph", graph)
    small, large = by_size(rows.select("graph", "src", "dst"), most)
    kind = small.schema["src"].dataType
    schema = T.StructType([small.schema["graph"], T.StructField("node", kind), T.StructField("reach_count", T.LongType()), T.StructField("degree", T.LongType())])

    def top(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        nodes, leads = _coded(src, dst)
        degree, reach = leads.sum(0) + leads.sum(1), _reach(leads)
        np.fill_diagonal(reach, False)
        met = reach[:first].sum(0)
        best = np.lexsort((np.arange(len(nodes)), -degree, -met))
        best = best[(met[best] >= 3) | (degree[best] >= 5)][:k]
        return [nodes[best], met[best], degree[best]]

    found = each_graph(small, top, schema)
    return found if large is None else found.unionByName(_hubs(large.select("src", "dst"), graph, first, k))


def _hubs(edges: DataFrame, graph: Column, first: int, k: int) -> DataFrame:
    """hubs() of graphs of any size, by rounds."""
    pairs = edges.select("src", "dst").distinct()
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("graph", graph)
    place = F.row_number().over(Window.partitionBy("graph").orderBy("node"))
    roots = nodes.withColumn("_place", place).filter(F.col("_place") <= first).select(F.col("node").alias("root"), "node")
    lane = lanes(roots)
    own = roots.join(lane, "root").select("lane", "node", F.expr("shiftleft(1L, bit)").alias("_own"))
    found = masks(pairs, roots, lane, max_depth=LONGEST).join(own, ["lane", "node"], "left")
    others = F.bit_count(F.col("fresh").bitwiseAND(F.bitwise_not(F.coalesce("_own", F.lit(0).cast("long")))))
    reached = found.groupBy("node").agg(F.sum(others).alias("reach_count"))
    joined = degree(pairs).select(F.col("id").alias("node"), "degree").withColumn("graph", graph).join(reached, "node", "left").na.fill(0, ["reach_count"])
    best = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("reach_count"), F.desc("degree"), "node"))
    return joined.filter("reach_count >= 3 OR degree >= 5").withColumn("_place", best).filter(F.col("_place") <= k).select("graph", "node", "reach_count", "degree")


def reach_coverage(edges: DataFrame, sources: DataFrame, is_sink: Column, is_sanitiser: Column, graph: Column, max_depth: int = 10) -> DataFrame:
    """sources(root, node); the conditions are over node, the graph over root. Per graph: pairs of a source and a sink that it reaches, those
    whose source reaches a sanitiser too, and the scores of coverage and integrity."""
    reached = bfs(edges, sources, max_depth).groupBy("root").agg(F.count_if(is_sink).alias("sinks"), F.max(is_sanitiser).alias("washed"))
    total = reached.groupBy(graph.alias("graph")).agg(F.sum("sinks").alias("boundaries"), F.sum(F.when(F.col("washed"), F.col("sinks")).otherwise(0)).alias("sanitised"))
    percent = lambda x: F.when(F.col("boundaries") > 0, half_up(F.round(100 * x / F.col("boundaries"), 9))).otherwise(100).cast("long")
    raw = total.select("*", percent(F.col("sanitised")).alias("coverage"), percent(F.col("boundaries") - (F.col("boundaries") - F.col("sanitised"))).alias("integrity"))
    return raw.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("integrity") - 5 * (F.col("boundaries") - F.col("sanitised")))).cast("long"))


def resilience(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """100 less isolated nodes, edges with an end of degree 1, and hubs by degree."""
    pairs = edges.select("src", "dst").distinct()
    d = degree(pairs)
    ends = pairs.join(d.select(F.col("id").alias("src"), F.col("degree").alias("_a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("_b")), "dst")
    lone = ends.agg(F.count("*").alias("edges"), F.count_if((F.col("_a") == 1) | (F.col("_b") == 1)).alias("spof"))
    all_nodes = nodes.join(d, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("isolated"), F.count_if(F.col("degree") >= 5).alias("hubs"))
    one = all_nodes.crossJoin(lone)
    raw = 100 - 40 * F.col("isolated") / F.col("nodes") - 30 * F.least("spof", F.lit(15)) / F.greatest("edges", F.lit(1)) - 20 * F.least("hubs", F.lit(10)) / F.col("nodes")
    score = half_up(F.round(F.greatest(F.lit(0.0), raw), 6))
    return one.select("nodes", "edges", "isolated", "spof", "hubs", score.alias("score"), F.when(score >= 80, "strong").when(score >= 60, "good").when(score >= 40, "weak").otherwise("fragile").alias("band"))


def degree_entropy(edges: DataFrame) -> DataFrame:
    """Entropy of the degree shares over its largest possible value: sums only, so no window over all nodes."""
    d = degree(edges.select("src", "dst").distinct())
    s = d.agg(F.count("*").alias("n"), F.sum("degree").alias("total"), F.sum(F.col("degree") * F.log2("degree")).alias("dlogd"))
    entropy = F.log2("total") - F.col("dlogd") / F.col("total")
    return s.select("n", half_up(F.round(F.when(F.col("n") > 1, entropy / F.log2("n")).otherwise(F.lit(0.0)), 9), 4).alias("entropy"))


def best_to_sinks(edges: DataFrame, sinks: DataFrame, least: float) -> DataFrame:
    """edges(src, dst, confidence) -> node, best: the largest product of confidences from the node to any sink, if it is `least` or more."""
    rounds = Rounds(edges.sparkSession)
    best, new = rounds.write(sinks.select("node", F.lit(1.0).alias("best"), F.lit(True).alias("moved")).distinct(), 0)
    k = 0
    while new:
        k += 1
        passed = best.filter("moved").join(edges.select(F.col("src").alias("_prev"), F.col("dst").alias("node"), "confidence"), "node")
        passed = passed.select(F.col("_prev").alias("node"), (F.col("best") * F.col("confidence")).alias("best"), F.lit(None).cast("double").alias("old")).filter(F.col("best") >= least - CLOSE)
        both = best.select("node", "best", F.col("best").alias("old")).unionByName(passed).groupBy("node").agg(F.max("best").alias("best"), F.max("old").alias("old"))
        best, new = rounds.write(both.select("node", "best", (F.col("old").isNull() | (F.col("best") > F.col("old"))).alias("moved")), k, "moved")
    return best.select("node", "best")


#: Products of the same factors differ by less, whatever their order.
CLOSE = 1e-9


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, cleaners: DataFrame, max_nodes: int = 20, least: float = 0.3) -> DataFrame:
    """edges(src, dst, confidence): simple paths from sources to sinks whose product of confidences stays at `least` or more.

    The state of a walk is its node and whether it is sanitised: a node of it, or one that such a node leads to, is in cleaners. A backward pass
    first finds the best product from each node to any sink; a walk enters a node only if its own product times that is enough."""
    spark = edges.sparkSession
    used = stored(edges.select("src", "dst", "confidence").filter(F.col("confidence") >= least))
    best = stored(best_to_sinks(used, sinks, least))
    clean = cleaners.select("node", F.lit(True).alias("clean")).distinct()
    led = edges.select(F.col("src").alias("_at"), F.col("dst").alias("node")).join(clean, "node").select(F.col("_at").alias("node"), "clean")
    clean = stored(clean.unionByName(led).distinct())
    goal = sinks.select(F.col("node").alias("dst"), F.lit(True).alias("hit")).distinct()
    flagged = lambda df, at: df.join(clean.withColumnRenamed("node", at), at, "left")
    steps = flagged(used.join(best.withColumnRenamed("node", "dst"), "dst").join(goal, "dst", "left"), "dst").select("src", "dst", "confidence", "best", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("clean", F.lit(False)).alias("clean"))
    steps = stored(steps)
    start = flagged(sources.select(F.col("node").alias("src")), "src").select(F.col("src").alias("start"), "src", F.array("src").alias("path"), F.lit(1.0).alias("p"), F.coalesce("clean", F.lit(False)).alias("sanitised"), F.lit(False).alias("hit"))
    rounds, k = Rounds(spark), 0
    walks, new = rounds.write(start, 0)
    while new and k < max_nodes - 1:
        k += 1
        grown = walks.drop("hit").join(steps, "src").withColumn("_p", F.col("p") * F.col("confidence"))
        grown = grown.filter((F.col("_p") >= least) & (F.col("_p") * F.col("best") >= least - CLOSE) & ~F.array_contains("path", F.col("dst")))
        walks, new = rounds.write(grown.select("start", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), F.col("_p").alias("p"), (F.col("sanitised") | F.col("clean")).alias("sanitised"), "hit"), k)
    return rounds.all().filter("hit").select("start", F.col("src").alias("sink"), F.array_join("path", "-").alias("path"), half_up(F.round(F.col("p") * 0.95, 9), 4).alias("confidence"), "sanitised")


def dep_cost(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node's cost and those of the nodes it calls or imports directly."""
    direct = edges.filter(F.col("type").isin("calls", "imports")).select("src", "dst").distinct()
    below = direct.join(nodes.select(F.col("id").alias("dst"), F.col("cost").alias("_cost")), "dst").groupBy("src").agg(F.sum("_cost").alias("_below"))
    return nodes.join(below, nodes["id"] == below["src"], "left").select("id", (F.col("cost") + F.coalesce("_below", F.lit(0))).alias("total_cost"))


def path_cost(entries: DataFrame, nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Per entry point: nodes in reach, the sum of their costs, and what running its direct calls side by side would save: their sum less
    the largest of them."""
    reach = bfs(edges, entries.select(F.col("id").alias("root"), F.col("id").alias("node")), max_depth=LONGEST, types=types)
    total = reach.join(nodes, reach["node"] == nodes["id"]).groupBy("root").agg(F.count("*").alias("reached"), F.sum("cost").alias("cost"))
    calls = edges.filter("type = 'calls'").select(F.col("src").alias("root"), F.col("dst").alias("id")).distinct().join(entries.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    saved = calls.join(nodes.select("id", "cost"), "id").groupBy("root").agg((F.sum("cost") - F.max("cost")).alias("parallelisable"))
    return total.join(saved, "root", "left").select("root", "reached", "cost", F.coalesce("parallelisable", F.lit(0)).cast("long").alias("parallelisable"))


def branch_depth(branches: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """branches(id, complexity): per branch the other nodes in reach, whether it has no successor, and whether it is more complex than `most`."""
    pairs = edges.select("src", "dst").distinct()
    reach = bfs(pairs, branches.select(F.col("id").alias("root"), F.col("id").alias("node")), max_depth=LONGEST).groupBy("root").agg(F.count_if(F.col("root") != F.col("node")).alias("reachable"))
    leads = pairs.select(F.col("src").alias("id"), F.lit(False).alias("dead_end")).distinct()
    joined = branches.join(reach, branches["id"] == reach["root"]).drop("root").join(leads, "id", "left")
    return joined.select(F.col("id").alias("branch"), "reachable", F.coalesce("dead_end", F.lit(True)).alias("dead_end"), (F.col("complexity") > most).alias("complex"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that are not exported and that nothing calls, imports or renders."""
    used = edges.filter(F.col("type").isin("calls", "imports", "renders")).select(F.col("dst").alias("id")).distinct()
    return nodes.filter("NOT exported").join(used, "id", "left_anti").select("id")


def failure_prob(edges: DataFrame, hosts: DataFrame, start: float = 0.8, fade: float = 0.7, depth: int = 5, base: float = 0.05) -> DataFrame:
    """Probability of failure of every node: hosts of findings start, and each hop up to the callers fades; the largest counts."""
    hops = bfs(edges, hosts.select(F.col("id").alias("root"), F.col("id").alias("node")), max_depth=depth, backward=True)
    near = hops.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("hops"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return every.join(near, "id", "left").select("id", F.round(F.greatest(F.lit(base), F.coalesce(start * F.pow(F.lit(fade), F.col("hops")), F.lit(0.0))), 6).alias("probability"))


def markov_blanket(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Parents, children and the children's other parents of each target."""
    pairs = edges.select("src", "dst").distinct()
    t = targets.select(F.col("id").alias("target"))
    parents = t.join(pairs, F.col("target") == F.col("dst")).select("target", F.col("src").alias("node"))
    children = t.join(pairs, F.col("target") == F.col("src")).select("target", F.col("dst").alias("node"))
    partners = children.join(pairs, F.col("node") == F.col("dst")).select("target", F.col("src").alias("node"))
    return parents.unionByName(children).unionByName(partners).filter("target <> node").distinct()


def fsm_report(states: DataFrame, events: DataFrame) -> DataFrame:
    """states(model, state, initial, accepting), events(model, src, dst, label): per model the unreachable states, deadlocks and racing transitions."""
    back = events.select(F.col("model").alias("graph"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = reaching(back, states.filter("initial").select(F.col("model").alias("graph"), F.col("state").alias("node")))
    reached = reached.select(F.col("graph").alias("model"), F.lit(1).alias("_reached"), F.lit(0).alias("_leads"), F.lit(0).alias("_open"), F.lit(0).alias("_all"), F.col("node").alias("state"))
    # One aggregate by state, and from it one by model.
    leaving = events.select("model", F.lit(0).alias("_reached"), F.lit(1).alias("_leads"), F.lit(0).alias("_open"), F.lit(0).alias("_all"), F.col("src").alias("state"))
    own = states.select("model", F.lit(0).alias("_reached"), F.lit(0).alias("_leads"), (~F.col("accepting")).cast("int").alias("_open"), F.lit(1).alias("_all"), "state")
    told = own.unionByName(reached).unionByName(leaving).groupBy("model", "state").agg(*[F.max(c).alias(c) for c in ("_reached", "_leads", "_open", "_all")]).filter("_all = 1")
    out = told.groupBy("model").agg(F.count_if(F.col("_reached") == 0).alias("unreachable"), F.count_if((F.col("_open") == 1) & (F.col("_leads") == 0)).alias("deadlocks"))
    races = events.groupBy("model", "src", "label").agg((F.min("dst") != F.max("dst")).alias("_race")).filter("_race").groupBy("model").agg(F.count("*").alias("races"))
    return out.join(races, "model", "left").na.fill(0)


def response_property(states: DataFrame, events: DataFrame, p: str, q: str) -> DataFrame:
    """Per model: states that can reach (themselves included) a p-state from which no q-state can be reached. Two searches back, from all
    q-states and from the p-states without an answer; no pairs are made."""
    edges = events.select(F.col("model").alias("graph"), "src", "dst")
    named = states.select(F.col("model").alias("graph"), F.col("state").alias("node"))
    answered = stored(reaching(edges, named.filter(F.lower(F.col("node").cast("string")).contains(q))))
    bad = named.filter(F.lower(F.col("node").cast("string")).contains(p)).join(answered, ["graph", "node"], "left_anti")
    violating = reaching(edges, stored(bad)).groupBy("graph").agg(F.count("*").alias("violating"))
    total = named.groupBy("graph").agg(F.count("*").alias("states"))
    out = total.join(violating, "graph", "left").na.fill(0)
    return out.select(F.col("graph").alias("model"), "violating", (F.col("states") - F.col("violating")).alias("verified"), (F.col("violating") == 0).alias("holds"))


#: Classes of data by priority; fixed.
DATA_CLASSES = ("pci", "phi", "credentials", "biometric", "pii", "financial", "consent", "session", "location", "personal")


def provenance(edges: DataFrame, sinks: DataFrame, nodes: DataFrame, max_hops: int = 15) -> DataFrame:
    """edges(src, dst, confidence), nodes(id, data_class, points): walks back from each sink, at every hop to the predecessor not yet visited
    with the highest score (the smallest id on ties): 3, 2 or 1 by the edge's confidence, 2 for a class, and the node's points.

    A walk carries the classes that it has met and the sum of its edges' confidences; one that meets no class gives no row."""
    steps = edges.select("src", "dst", "confidence").join(nodes.select(F.col("id").alias("src"), "data_class", "points"), "src")
    score = F.when(F.col("confidence") > 0.9, 3).when(F.col("confidence") > 0.7, 2).otherwise(1) + F.when(F.col("data_class").isNotNull(), 2).otherwise(0) + F.col("points")
    steps = stored(steps.select("src", "dst", "confidence", "data_class", score.alias("score")).groupBy("src", "dst").agg(F.max_by(F.struct("confidence", "data_class", "score"), F.struct("score", "confidence")).alias("x")).select("src", "dst", "x.*"))
    rounds, k = Rounds(edges.sparkSession), 0
    bit = F.coalesce(F.create_map(*[F.lit(x) for n, c in enumerate(DATA_CLASSES) for x in (c, 1 << n)])[F.col("data_class")], F.lit(0))
    walks, new = rounds.write(sinks.select(F.col("id").alias("sink"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0).alias("classes"), F.lit(0.0).alias("total")), 0)
    while new and k < max_hops:
        k += 1
        options = walks.join(steps, walks["at"] == steps["dst"]).filter(~F.array_contains("path", F.col("src")))
        one = F.struct("src", F.concat("path", F.array("src")).alias("path"), F.col("classes").bitwiseOR(bit).alias("classes"), F.round(F.col("total") + F.col("confidence"), 6).alias("total"))
        best = options.groupBy("sink").agg(F.min_by(one, F.struct(-F.col("score"), "src")).alias("x"))
        walks, new = rounds.write(best.select("sink", F.col("x.src").alias("at"), "x.path", "x.classes", "x.total"), k)
    last = rounds.all().groupBy("sink").agg(F.max_by(F.struct("path", "classes", "total"), "round").alias("x")).select("sink", "x.*").filter("classes <> 0")
    hops = F.size("path") - 1
    primary = F.coalesce(*[F.when(F.col("classes").bitwiseAND(F.lit(1 << n)) != 0, F.lit(c)) for n, c in enumerate(DATA_CLASSES)])
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(0.99), 0.7 + F.least(F.lit(0.2), 0.05 * F.bit_count("classes")) + 0.1 * F.coalesce(F.col("total") / F.when(hops > 0, hops), F.lit(0.5))))
    return last.select("sink", F.array_join(F.reverse("path"), "-").alias("path"), hops.alias("hops"), primary.alias("data_class"), half_up(F.round(confidence, 9), 2).alias("confidence"))
