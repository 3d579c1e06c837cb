"""Cut risk without a component in one task: a spanning forest, tours of its trees, and the blocks of the graph.

A graph's blocks are its largest parts that no single node holds together. A node that is in b blocks leaves b - 1 more
parts behind when it goes. Blocks are found as in parallel algorithms on trees: each tree hooks on to another by its
least edge until none is left (log rounds); arcs of the trees are put in one tour each, ranked by doubling pointers;
times of the tour say which node is below which. Two tree edges are of one block if a link outside the trees joins
nodes that are not below each other, or leads from below the lower edge past the upper node's part of the tour. What
leads there is the least and greatest time over a run of the tour, looked up in two runs of a power of two. Components
of these relations are the blocks. All of it is joins and partial aggregates over rows of nodes, links or arcs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.graph import components, undirected
from treeline.operators.hashtree import numbered
from treeline.store import written

#: The tour time of a tree's top: after all of its arcs.
TOP = 1 << 62


def spanning_forest(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree (a, b), labels (node, root)): the links of ``pairs`` (a < b, distinct) that join all that hangs together without a cycle.

    Each round every tree takes its least link to another. Links have one order for all, so only two trees that took
    the same link point at each other; the lesser of them stays a top.
    """
    labels = written(nodes.select("node", F.col("node").alias("root")))
    loose = written(pairs.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")))
    tree = [pairs.select("a", "b").limit(0)]
    while not loose.isEmpty():
        both = loose.select("a", "b", F.col("ra").alias("root"), F.col("rb").alias("to")).unionByName(loose.select("a", "b", F.col("rb").alias("root"), F.col("ra").alias("to")))
        hooks = written(both.groupBy("root").agg(F.min(F.struct("a", "b", "to")).alias("e")).select("root", "e.*"))
        back = hooks.select(F.col("root").alias("to"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        stays = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("root") < F.col("to"))
        up = written(hooks.join(back, "to").select("root", "a", "b", F.when(stays, F.col("root")).otherwise(F.col("to")).alias("top")))
        tree.append(up.where("root <> top").select("a", "b"))
        up = up.select("root", "top")
        while True:
            far = up.select(F.col("root").alias("top"), F.col("top").alias("far"))
            moved = written(up.join(far, "top").select("root", F.col("far").alias("top"), (F.col("far") != F.col("top")).alias("moved")))
            up = moved.select("root", "top")
            if moved.where("moved").isEmpty():
                break
        labels = written(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = [up.select(F.col("root").alias(c), F.col("top").alias(f"t{c}")) for c in ("ra", "rb")]
        apart = loose.join(ends[0], "ra").join(ends[1], "rb").where("tra <> trb")
        # Of several links between two trees the least is enough: no later round would take another.
        loose = written(apart.groupBy(F.least("tra", "trb").alias("ra"), F.greatest("tra", "trb").alias("rb")).agg(F.min(F.struct("a", "b")).alias("e")).select("e.*", "ra", "rb"))
    return written(reduce(DataFrame.unionByName, tree)), labels


def tour(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root, parent, first, last) of each node with a link: a node is below another if its times, first to last going down, are within the other's.

    A tree's arcs, each link both ways, follow one another around the tree: after (a, b) comes the arc of b that
    follows (b, a) around b. An arc's time is the number of arcs after it, found by doubling pointers.
    """
    arcs = written(numbered(tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"]))
    ends = written(arcs.groupBy("a").agg(F.min("position").alias("lo"), F.max("position").alias("hi")))
    twins = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("position").alias("twin"))
    follow = F.when(F.col("twin") < F.col("hi"), F.col("twin") + 1).otherwise(F.col("lo"))
    linked = arcs.join(twins, ["a", "b"]).join(ends.withColumnRenamed("a", "b"), "b").select("position", "twin", "a", "b", follow.alias("next"))
    heads = labels.where("node = root").select(F.col("node").alias("a")).join(ends, "a").select(F.col("lo").alias("next"), F.lit(True).alias("closes"))
    linked = written(linked.join(heads, "next", "left").withColumn("next", F.when(F.col("closes").isNull(), F.col("next"))).drop("closes"))
    ranks = linked.select("position", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("time"))
    while not ranks.where("next is not null").isEmpty():
        far = ranks.select(F.col("position").alias("next"), F.col("next").alias("_next"), F.col("time").alias("_time"))
        ranks = written(ranks.join(far, "next", "left").select("position", F.col("_next").alias("next"), (F.col("time") + F.coalesce("_time", F.lit(0))).alias("time")))
    times = ranks.select("position", "time")
    down = linked.join(times, "position").join(times.select(F.col("position").alias("twin"), F.col("time").alias("back")), "twin").where("time > back")
    below = down.select(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("time").alias("first"), F.col("back").alias("last"))
    tops = heads.join(linked.select(F.col("position").alias("next"), "a"), "next").select(F.col("a").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(TOP).alias("first"), F.lit(-1).cast("long").alias("last"))
    return written(below.unionByName(tops).join(labels, "node").select("node", "root", "parent", "first", "last"))


def _leads(places: DataFrame, others: DataFrame) -> DataFrame:
    """(node, parent, lo, hi): least and greatest time that links outside the trees reach from the node or below it; none without such links.

    ``others`` are links with the places of both ends. Extremes of runs of 1, 2, 4, ... times are made one after the
    other; a node's run is covered by two of the longest that fit, so each level is read by the nodes that need it.
    """
    one = others.select("root", F.col("fa").alias("at"), F.col("fb").alias("time")).unionByName(others.select("root", F.col("fb").alias("at"), F.col("fa").alias("time")))
    runs = written(one.where(F.col("at") < TOP).groupBy("root", "at").agg(F.min("time").alias("lo"), F.max("time").alias("hi")))
    tops = places.where("parent is null").select(F.col("node").alias("parent"))
    asks = places.where("parent is not null").join(tops, "parent", "left_anti").withColumn("level", F.length(F.bin(F.col("first") - F.col("last") + 1)) - 1)
    ats = F.array("last", (F.col("first") - F.expr("shiftleft(1L, level)") + 1))
    asks = written(asks.select("node", "parent", "root", "level", F.explode(F.array_distinct(ats)).alias("at")))
    most = asks.agg(F.max("level")).first()[0]
    found = [asks.join(runs, ["root", "at"]).where("level = 0").select("node", "parent", "lo", "hi")]
    for level in range(most or 0):
        earlier = runs.withColumn("at", F.col("at") - (1 << level)).where("at >= 0")
        runs = written(runs.unionByName(earlier).groupBy("root", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        found.append(asks.where(F.col("level") == level + 1).join(runs, ["root", "at"]).select("node", "parent", "lo", "hi"))
    return reduce(DataFrame.unionByName, found).groupBy("node", "parent").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, block) for each block that a node is in; a node without links is in none. A block's name is the least lower end of its tree links.

    Defined cases: null and repeated nodes count as none and once; loops, repeated edges and edges with an end that is
    no node are left out; no nodes, no rows.
    """
    known = written(nodes.select("node").where("node is not null").distinct())
    ends = [known.select(F.col("node").alias(c)) for c in "ab"]
    pairs = written(undirected(edges).where("a < b").join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi"))
    tree, labels = spanning_forest(known, pairs)
    places = tour(tree, labels)
    a, b = (places.select(F.col("node").alias(c), F.col("root").alias("root"), F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}")) for c in "ab")
    others = written(pairs.join(tree, ["a", "b"], "left_anti").join(a, "a").join(b.drop("root"), "b"))
    over = "(la <= lb and fb <= fa) or (lb <= la and fa <= fb)"
    across = others.where(f"not ({over})").select(F.col("a").alias("source"), F.col("b").alias("target"))
    upper = places.select(F.col("node").alias("parent"), "first", "last")
    past = _leads(places, others).join(upper, "parent").where("hi > first or lo < last").select(F.col("node").alias("source"), F.col("parent").alias("target"))
    lower = places.where("parent is not null")
    named = components(lower.select("node"), across.unionByName(past)).withColumnRenamed("root", "block")
    held = lower.select("node", "parent").join(named, "node")
    return held.select("node", "block").unionByName(held.select(F.col("parent").alias("node"), "block")).distinct()


def cut_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cut_risk): how many more parts the node's component would have without it; cases as in :func:`blocks`."""
    held = blocks(nodes, edges).groupBy("node").agg((F.count(F.lit(1)) - 1).alias("cut_risk"))
    known = nodes.select("node").where("node is not null").distinct()
    return known.join(held, "node", "left").select("node", F.coalesce("cut_risk", F.lit(0)).cast("long").alias("cut_risk"))
