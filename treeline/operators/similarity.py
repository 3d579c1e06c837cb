"""Joins of sets by Jaccard similarity: equal sets once, prefixes of rare members, sizes that fit, exact verification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.store import cut

#: A member is split where more than this many distinct sets have it in their prefixes: its sets are dealt into blocks of as many.
BLOCK = 1000


def similar_sets(members: DataFrame, key: str, member: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, shared, similarity) of different sets with a Jaccard similarity of ``threshold`` (over 0) or more, and (key, set).

    ``members`` (key, member) lists the sets; keys with equal sets are one set here, however many they are. Members are
    ordered by how many sets have them, rarest first. Two sets of that similarity share one of the first
    size - ceil(threshold * size) + 1 members of each, and their sizes differ by that factor at most, so sets meet only
    on (prefix member, size of the smaller); where the rarest member that a pair shares is in many sets, those are dealt
    into blocks, and a pair of blocks is a task. Each candidate is verified on the whole sets.

    Defined cases: a null key or member is left out; repeated members count once; a key without members has no set and
    no pair; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    given = members.select(F.col(key).alias("key"), F.col(member).cast("string").alias("member")).where("key IS NOT NULL AND member IS NOT NULL").distinct()
    whole = given.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("members"))
    framed = F.array_join(F.transform("members", lambda m: F.concat(F.octet_length(m).cast("string"), F.lit(":"), m)), "")
    named = cut(whole.withColumn("set", F.sha2(framed.cast("binary"), 256)))
    sets = named.groupBy("set").agg(F.first("members").alias("members")).withColumn("size", F.size("members"))
    each = sets.select("set", "size", F.explode("members").alias("member"))
    order = each.groupBy("member").agg(F.count(F.lit(1)).alias("sets"))
    ranked = each.join(order, "member").groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "member"))).alias("ordered"))
    ordered = cut(ranked.select("set", "size", F.col("ordered.member").alias("members")))
    # A little below the bound, so that rounding only makes prefixes longer.
    needed = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    prefix = ordered.select("set", "size", F.posexplode(F.slice("members", 1, F.col("size") - needed + 1)).alias("place", "member"))
    smaller = F.sequence(needed, F.col("size"))
    # As the smaller set of a pair a set goes by its own size, as the larger one by each size that fits it.
    small = prefix.select("member", F.col("size").alias("fit"), F.col("set").alias("a"), "size")
    large = prefix.select("member", F.explode(smaller).alias("fit"), F.col("set").alias("b"), F.col("size").alias("size_b"))
    blocks = large.groupBy("member", "fit").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    dealt_a = small.join(blocks, ["member", "fit"]).withColumn("block_a", block("a")).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt_b = large.join(blocks, ["member", "fit"]).withColumn("block_b", block("b")).withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt_a.drop("blocks").join(dealt_b.drop("blocks"), ["member", "fit", "block_a", "block_b"]).where((F.col("size") < F.col("size_b")) | (F.col("a") < F.col("b")))
    candidates = met.select("a", "b").distinct()
    side = lambda x: ordered.select(F.col("set").alias(x), F.col("members").alias(f"members_{x}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("members_a", "members_b")).cast("long"))
    scored = both.withColumn("similarity", F.col("shared") / (F.size("members_a") + F.size("members_b") - F.col("shared")))
    return cut(scored.where(F.col("similarity") >= threshold).select("a", "b", "shared", "similarity")), named.select("key", "set", F.size("members").alias("size"))


def set_pairs(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b, shared, similarity) of keys, a before b: the pairs of sets, and those of keys with the same set.

    Their number is the result's own size. Where keys need not be paired, work on the sets and their keys instead.
    """
    a, b = (named.select(F.col("key").alias(x), F.col("set").alias(f"set_{x}"), "size") for x in ("a", "b"))
    across = pairs.withColumnsRenamed({"a": "set_a", "b": "set_b"}).join(a.drop("size"), "set_a").join(b.drop("size"), "set_b")
    within = a.join(b.drop("size"), F.col("set_a") == F.col("set_b")).where("a < b").select("a", "b", F.col("size").cast("long").alias("shared"), F.lit(1.0).alias("similarity"))
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "similarity").unionByName(within)


def set_graph(pairs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target) edges that join the same keys as :func:`set_pairs`, and (node, degree) of those pairs, without making them.

    Keys of one set are joined to their least one, sets by their least keys; a key's degree is counted from the sizes of
    its set and of the sets it pairs with.
    """
    heads = named.groupBy("set").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("keys"))
    stars = named.join(heads, "set").where("key <> head").select(F.col("head").alias("source"), F.col("key").alias("target"))
    a, b = (heads.select(F.col("set").alias(x), F.col("head").alias(n)) for x, n in (("a", "source"), ("b", "target")))
    links = pairs.join(a, "a").join(b, "b").select("source", "target")
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ways.join(heads.select(F.col("set").alias("b"), "keys"), "b").groupBy(F.col("a").alias("set")).agg(F.sum("keys").alias("others"))
    degree = (F.coalesce("others", F.lit(0)) + F.col("keys") - 1).cast("long")
    counted = heads.join(others, "set", "left").select("set", degree.alias("degree"))
    return stars.unionByName(links), named.join(counted, "set").select(F.col("key").alias("node"), "degree")
