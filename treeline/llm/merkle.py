"""A Merkle manifest of a dataset by parent-preimage paths.

Rows are leaves, dealt into groups (sources) and ordered by key in each. Every FAN consecutive nodes become one parent,
whose preimage, the concatenated hashes of its children, is stored beside its hash; a group's last node is its subroot,
and the subroots, ordered by group, make a tree of the same kind up to the root. A leaf's path is the list of its
ancestors' preimages with its place in each: its siblings are what is left of a preimage once the own slot of 64
characters is cut out, and folding puts a replacement into the slot, hashes, and goes on with the result one preimage up.

Ancestors meet from the top down, where there are few rows: only the nodes just above the leaves, one in FAN, carry the
whole list through a shuffle, and a leaf joins that one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import range_rank, stash

FAN, HEX = 16, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_CHAIN = "array<struct<slot:int,preimage:string>>"


def sha256(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts' UTF-8 texts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value: no two rows of values frame alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return sha256(*(framed(v) for v in values))


@dataclass
class Tree:
    """``levels[k]`` holds the nodes k + 1 above the leaves: (keys, idx, preimage, hash, n), n the nodes of the key at that level; ``roots`` (keys, hash)."""

    keys: list[str]
    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    """``leaves``: (key, group, leaf, carried columns, idx, n); ``groups``: (group, subroot, idx, n); ``root`` is None for no rows."""

    leaves: DataFrame
    inner: Tree
    groups: DataFrame
    outer: Tree
    root: str | None


def grow(nodes: DataFrame, keys: list[str], label: str) -> Tree:
    """The tree over ``nodes`` (keys, idx, hash, n): level by level until each key has one node; each level is written once."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    done = [nodes.where("n = 1").select(*keys, "hash")]
    while most > 1:
        runs = nodes.where("n > 1").groupBy(*keys, F.expr(f"idx div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run"), F.first("n").alias("n"))
        made = runs.select(*keys, F.col("up").alias("idx"), F.array_join(F.col("run.hash"), "").alias("preimage"), F.ceil(F.col("n") / FAN).cast("long").alias("n"))
        nodes = stash(made.withColumn("hash", sha256(F.col("preimage"))), f"{label}-{len(levels)}")
        levels.append(nodes)
        done.append(nodes.where("n = 1").select(*keys, "hash"))
        most = -(-most // FAN)
    return Tree(keys, levels, reduce(DataFrame.unionByName, done))


def build(docs: DataFrame, *, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` adds columns to the leaves.

    Leaves are dealt by ranges of (group, key) and runs of FAN, so a group with a third of all rows is spread; the
    driver sees the root and the largest count only.

    Defined cases: nulls frame as ``-``; a null group is a group of its own, before all others; null keys come first;
    rows with equal keys are ordered by their leaf hash, and rows equal in both have the same leaf, so it does not
    matter which comes first; an empty table has no root; a lone row is its own subroot, and root if it is the only
    one; other columns are left out.
    """
    wanted = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_hash(*(F.col(c) for c in columns)).alias("hash"), *(c.alias(n) for n, c in (carry or {}).items()))
    leaves = range_rank(wanted, ["group"], ["key", "hash"], "idx", "n", "merkle-leaves")
    inner = grow(leaves.select("group", "idx", "hash", "n"), ["group"], "merkle-inner")
    groups = stash(range_rank(inner.roots, [], ["group"], "idx", "n", "merkle-groups"), "merkle-subroots")
    outer = grow(groups.select("idx", "hash", "n"), [], "merkle-outer")
    top = outer.roots.first()
    return Manifest(leaves, inner, groups, outer, top and top["hash"])


def _climb(nodes: DataFrame, parents: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """``nodes`` with the chain that starts at their own run: their parents' preimages, then the parents' chains."""
    up = parents.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("idx").alias("_idx"), F.col("preimage").alias("_preimage"), F.col("chain").alias("_chain"), *carried)
    here = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.expr(f"idx div {FAN}") == F.col("_idx"))
    own = F.struct(F.expr(f"cast(idx % {FAN} as int)").alias("slot"), F.col("_preimage").alias("preimage"))
    return nodes.join(up, here).withColumn("chain", F.concat(F.array(own), F.col("_chain"))).drop(*(f"_{k}" for k in keys), "_idx", "_preimage", "_chain")


def _end(nodes: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes``, the only ones of their keys at their level, with the chains of ``tops``."""
    up = tops.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in tops.columns if c not in keys))
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return nodes.join(up, met).drop(*(f"_{k}" for k in keys))


def chains(leaves: DataFrame, tree: Tree, tops: DataFrame | None = None) -> DataFrame:
    """``leaves`` (keys, idx, n and more) with ``chain``, their ancestors' preimages from their own run up to the root.

    ``tops`` (keys, chain and more) says what lies above the tree's roots; its other columns are added.
    """
    keys = tree.keys
    carried = [c for c in tops.columns if c not in (*keys, "chain")] if tops is not None else []
    alone = (lambda df: _end(df, tops, keys)) if tops is not None else (lambda df: df.withColumn("chain", F.expr(f"cast(array() as {_CHAIN})")))
    above = None
    for level in [*reversed(tree.levels), leaves]:
        nodes = level.drop("hash") if level is not leaves else level
        found = alone(nodes.where("n = 1"))
        above = found if above is None else found.unionByName(_climb(nodes.where("n > 1"), above, keys, carried))
    return above


def ancestors(manifest: Manifest) -> DataFrame:
    """The manifest's leaves with subroot, root and chain."""
    tops = chains(manifest.groups, manifest.outer).select("group", F.col("hash").alias("subroot"), "chain")
    return chains(manifest.leaves.withColumnRenamed("hash", "leaf"), manifest.inner, tops).withColumn("root", F.lit(manifest.root).cast("string"))


def siblings(chain: Column) -> Column:
    """The hashes of the runs' other nodes, level by level and left to right, in one string: each preimage without the own slot."""
    return F.array_join(F.transform(chain, lambda x: F.overlay(x["preimage"], F.lit(""), x["slot"] * HEX + 1, HEX)), "")


def fold(leaf: Column, chain: Column) -> Column:
    """The root that ``leaf`` leads to: it is spliced into its slot, hashed, and the result is spliced in one preimage up."""
    return F.aggregate(chain, leaf, lambda node, x: F.sha2(F.overlay(x["preimage"], node, x["slot"] * HEX + 1, HEX).cast("binary"), 256))


def nodes(manifest: Manifest) -> DataFrame:
    """The manifest as a table to keep: (tree, group, level, idx, preimage, hash), tree ``group`` or ``root``."""
    inner = [x.select(F.lit("group").alias("tree"), "group", F.lit(k + 1).alias("level"), "idx", "preimage", "hash") for k, x in enumerate(manifest.inner.levels)]
    outer = [x.select(F.lit("root").alias("tree"), F.lit(None).cast("string").alias("group"), F.lit(k + 1).alias("level"), "idx", "preimage", "hash") for k, x in enumerate(manifest.outer.levels)]
    lone = manifest.leaves.where("n = 1").select(F.lit("group").alias("tree"), "group", F.lit(0).alias("level"), "idx", F.lit(None).cast("string").alias("preimage"), "hash")
    return reduce(DataFrame.unionByName, [*inner, *outer], lone)


def changed(manifest: Manifest, docs: DataFrame, *, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(group, key, change) of rows of ``docs`` that are not as in the manifest: ``altered``, ``added`` or ``removed``.

    Rows are compared by (group, key, leaf) with their counts, so repeated rows count too; a key whose every row is
    gone is removed, one that was not there is added, and any other difference is altered.
    """
    now = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf_hash(*(F.col(c) for c in columns)).alias("hash"), F.lit(1).alias("d"))
    both = manifest.leaves.select("group", "key", "hash", F.lit(-1).alias("d")).unionByName(now)
    by_row = both.groupBy("group", "key", "hash").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("was"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("is"))
    by_key = by_row.groupBy("group", "key").agg(F.max(F.abs("d")).alias("d"), F.sum("was").alias("was"), F.sum("is").alias("is")).where("d > 0")
    return by_key.select("group", "key", F.when(F.col("is") == 0, "removed").when(F.col("was") == 0, "added").otherwise("altered").alias("change"))
