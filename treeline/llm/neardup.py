"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's sketch has T coordinates. In round i each shingle is thrown by a fresh hash into one coordinate, with a
value that starts with i; a coordinate keeps its least value. After T random rounds, round T + j throws all shingles
into coordinate j, so every coordinate fills whatever the set's size. Once all are full, later rounds change nothing.

Bands of R coordinates propose pairs. Equal shingle sets are one node from the start. A bucket of up to SMALL nodes
proposes all its pairs whose sizes allow a link. A larger one proposes two pivots with each other node: its least node and the one that meets
most nodes in large buckets, which is near the middle of its group. Proposals whose sketches agree far less than linked documents' do are dropped, the
others are confirmed on full shingle sets. Larger buckets that still lie in several components then have their
remaining pairs, those outside and across the largest component, held against each other exactly, block by block; a
block gives back only the links that join components.

The least similarity of a link is a parameter, with its bands in LEVELS. The chance that a link of just that similarity
is missed is (1 - 0.85^5)^24 < 1e-6 for the bands at 0.85 and (1 - 0.8^4)^30 < 1e-6 at 0.8, and < 1e-10 for the sketch
comparison.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import map_arrow, sieved, small_batches, stash
from treeline.store import ship

#: Coordinates of a sketch.
T = 120
#: Nodes of a bucket up to which all pairs are proposed; nodes of a block beyond.
SMALL, BLOCK = 24, 256
#: Nodes that hang together up to which their pairs are confirmed in one cell.
CELL = 128
#: Nodes up to which the keys of the texts that are needed again are broadcast to the scan, about 64 bytes each; beyond, texts are shuffled.
BROADCAST_NODES = 400_000
#: By the least similarity of a link in hundredths: coordinates of a band, and agreeing coordinates that a pair needs to be confirmed (at 0.85 the mean is 102, at 0.8 it is 96, the deviation 4).
LEVELS = {85: (5, 72), 80: (4, 63)}
WORD = re.compile("[^\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Words(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        got = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) < 40 and len(self) < 200_000:
            self[word] = got
        return got


_WORDS = _Words()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words, of all of them as one."""
    found = WORD.findall((text or "").translate(_UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = max(1, len(words) - k + 1)
    acc = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for j in range(min(k, len(words))):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(acc)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set of 64-bit hashes."""
    n = len(elements)
    out = np.full(T, np.uint64(_MASK))
    rounds, at = max(1, min(T, math.ceil(1.3 * T * math.log(T) / n))), 0
    while at < T and (out == _MASK).any():
        some = min(rounds, T - at, max(1, (1 << 20) // n))
        h = _mix(elements[None, :] ^ _SEEDS[at : at + some, None])
        where = ((h >> np.uint64(40)) * np.uint64(T)) >> np.uint64(24)
        value = (h & np.uint64((1 << 40) - 1)) | (np.arange(at, at + some, dtype=np.uint64)[:, None] << np.uint64(40))
        np.minimum.at(out, where.ravel().astype(np.int64), value.ravel())
        at += some
        rounds = max(1, rounds // 2)
    for j in np.flatnonzero(out == _MASK):
        h = _mix(elements ^ _SEEDS[T + j])
        out[j] = (h & np.uint64((1 << 40) - 1)).min() | np.uint64((T + int(j)) << 40)
    return out


def band_keys(coordinates: np.ndarray, width: int = 5) -> np.ndarray:
    bands = T // width
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + coordinates.reshape(bands, width)[:, r])
    return acc


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            some = batch.slice(at, 2048)
            keys, counts, digests, bands, bytes_ = [], [], [], [], []
            for key, text in zip(some.column(0).to_pylist(), some.column(2), strict=True):
                s = shingles(text.as_py())
                keys.append(key)
                counts.append(len(s))
                if len(s):
                    c = sketch(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(c, width).view(np.int64))
                    bytes_.append((_mix(c) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    bands.append(None)
                    bytes_.append(None)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(keys, pa.int64()), "text_md5": some.column(1), "n": pa.array(counts, pa.int64()), "node": pa.array(digests, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(bytes_, pa.binary()),
            })
    _WORDS.clear()  # the worker lives on for other stages


def _agree(batches: Iterator[pa.RecordBatch], agree: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree in ``agree`` coordinates and whose sizes allow a link."""
    for batch in batches:
        a, b = ([np.frombuffer(x.as_py(), np.uint8) for x in batch.column(c)] for c in ("sa", "sb"))
        if not a:
            continue
        same = (np.stack(a) == np.stack(b)).sum(1) >= agree
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        yield batch.select(["a", "b"]).filter(pa.array(same & fits))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets for texts, where the set is the node's: a key may have several texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sets = [shingles(t.as_py()).tobytes() for t in some.column(some.num_columns - 1)]
            own = [hashlib.blake2b(s, digest_size=16).digest() == n.as_py() for s, n in zip(sets, some.column(0), strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(some.num_columns - 1)), pa.array(sets, pa.binary())], names=[*some.schema.names[:-1], "s"]).filter(pa.array(own, pa.bool_()))
    _WORDS.clear()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One cell's pairs held against its full sets."""
    sets = {i: np.frombuffer(s, np.uint64) for i, s in zip(right["node"], right["s"], strict=True)}
    got = [(a, b) for a, b in zip(left["a"], left["b"], strict=True) if linked(sets[a], sets[b], percent)]
    return pd.DataFrame(got, columns=["a", "b"], dtype=object)


def _block_links(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components among the pairs of one block, or across two, as few as join what they join."""
    root = {r: r for r in cell["root"]}

    def top(r: bytes) -> bytes:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    rows = [(n, b, r, np.frombuffer(s, np.uint64)) for n, b, r, s in cell[["node", "block", "root", "s"]].itertuples(index=False)]
    one_block, got = cell["i"].iloc[0] == cell["j"].iloc[0], []
    left = [x for x in rows if x[1] == cell["i"].iloc[0]]
    right = sorted(left if one_block else [x for x in rows if x[1] == cell["j"].iloc[0]], key=lambda x: len(x[3]))
    sizes = np.array([len(x[3]) for x in right])
    for a, _, ra, sa in left:
        # Only sizes that allow a link.
        for k in range(np.searchsorted(sizes, percent * len(sa) / 100 - 1), np.searchsorted(sizes, 100 * len(sa) / percent + 1)):
            b, _, rb, sb = right[k]
            if a != b and top(ra) != top(rb) and linked(sa, sb, percent):
                root[top(ra)] = top(rb)
                got.append((a, b))
    return pd.DataFrame(got, columns=["a", "b"], dtype=object)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the least node that can be reached.

    Each round points every node to the least of its neighbours and itself, follows that pointer once more, and goes
    on with the links between what nodes point to. The least node of a component always stands for itself.
    """
    edges, mapping = links.select("a", "b").where("a <> b").distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")), "parents")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jumped = stash(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("root")), "roots")
        if mapping is None:
            mapping = jumped
        else:
            step = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = stash(mapping.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "mapping")
        a, b = (jumped.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        ends = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = stash(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return mapping


def _confirmed(pairs: DataFrame, rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm. Pairs that hang together are confirmed in one cell, so that each set
    travels once; what hangs together in more than CELL nodes is dealt over cells of two blocks of about CELL nodes."""
    where = components(pairs)
    sizes = where.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    homes = where.join(sizes, "root").select("node", "root", F.expr(f"pmod(xxhash64(node), ceil(c / {CELL}))").alias("h"))
    a = homes.select(F.col("node").alias("a"), F.col("root"), F.col("h").alias("ha"))
    b = homes.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    deal = F.xxhash64("root", F.least("ha", "hb"), F.greatest("ha", "hb"))
    celled = stash(pairs.join(a, "a").join(b, "b").select("a", "b", deal.alias("deal")), "cells")
    ends = celled.select(F.col("a").alias("node"), "deal").unionByName(celled.select(F.col("b").alias("node"), "deal")).distinct()
    sets = ends.withColumnRenamed("deal", "cell").join(_full_sets(where.select("node"), rows, reps), "node")
    return celled.groupBy("deal").cogroup(sets.groupBy("cell")).applyInPandas(lambda left, right: _confirm(left, right, percent), "a binary, b binary")


def _full_sets(nodes: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, s): the full set of each node, made again from one text that has it."""
    wanted = stash(nodes.distinct().join(reps, "node").select("node", "id"), "wanted")
    small = wanted.count() <= BROADCAST_NODES
    texts = rows.join(F.broadcast(wanted) if small else wanted, "id").select("node", "text")
    return map_arrow(texts, _sets, "node binary, s binary").dropDuplicates(["node"])


def _text_md5(text: Column) -> Column:
    """Tells texts apart; null is no text."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))).cast("binary")))


def _grouped(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(id, text_md5, n, node, component, keeper) for each row; keeper is the node of the group's row that stays, null without shingles or key."""
    ship(docs.sparkSession)
    width, agree = LEVELS[percent]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    hashed = rows.select("id", _text_md5(F.col("text")).alias("text_md5"), "text")
    with small_batches(docs.sparkSession):
        base = stash(map_arrow(hashed, lambda it: _sketched(it, width), "id long, text_md5 binary, n long, node binary, bands array<long>, sketch binary"), "sketches")
    named = base.where("node is not null and id is not null")
    nodes = stash(named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Most keys are of one node: keys alone are counted, and only what may be in a bucket of several goes to the join.
    counts = stash(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    several, _ = sieved(members, members["key"], counts.select("key"))
    found = stash(several.join(counts, "key"), "buckets")

    # Pairs whose sizes do not allow a link are dropped before anything is shuffled for them.
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    after = lambda x, i: F.filter(F.slice(F.col("m"), i + 2, F.lit(SMALL)), lambda y: fits(x["n"], y["n"]))
    lists = found.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    pairs = lists.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))).alias("p")).select("p.a", "p.b")
    large = found.where(F.col("c") > SMALL)
    met = large.groupBy("node").agg(F.sum("c").alias("met"))
    middle = large.join(met, "node").groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("met", "node")).alias("middle"), F.min(F.struct("node", "n")).alias("least"))
    pivoted = large.join(middle, "key").select("node", "n", F.explode(F.array_distinct(F.array("least", "middle"))).alias("pivot")).where((F.col("node") != F.col("pivot.node")) & fits(F.col("n"), F.col("pivot.n")))
    starred = pivoted.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
    proposed = pairs.unionByName(starred).distinct()

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = stash(map_arrow(proposed.join(a, "a").join(b, "b"), lambda it: _agree(it, agree, percent), "a binary, b binary"), "likely")

    # One text for each node: its representative's.
    reps = nodes.select("node", F.col("rep").alias("id"))
    own = base.select("id", "node")
    with small_batches(docs.sparkSession):
        links = stash(_confirmed(likely, rows, reps, percent), "links")
    joined = components(links)
    open_buckets = (
        large.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    )
    rest = stash(large.join(open_buckets, "key", "left_semi").join(joined, "node", "left").select("key", "node", "c", F.coalesce("root", "node").alias("root")), "open")
    if not rest.isEmpty():
        shares = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("share"))
        sums = shares.groupBy("key").agg(F.max_by("root", F.struct("share", "root")).alias("main"), F.max("share").alias("most"), F.sum("share").alias("all"))
        in_main = F.col("root") == F.col("main")
        # Blocks of the largest component and of the others; the largest one's blocks never meet each other.
        counted = rest.join(sums, "key").withColumns({"mb": F.expr(f"cast(ceil(most / {BLOCK}) as int)"), "ob": F.expr(f"cast(ceil((all - most) / {BLOCK}) as int)")})
        blocks = counted.withColumn("block", F.when(in_main, F.concat(F.lit("m"), F.expr("pmod(xxhash64(node), mb)"))).otherwise(F.concat(F.lit("o"), F.expr("pmod(xxhash64(node), ob)"))))
        others = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda x: F.concat(F.lit("o"), x))
        mains = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda x: F.concat(F.lit("m"), x))
        dealt = blocks.select("node", "key", "root", "block", F.explode(F.when(in_main, others).otherwise(F.concat(others, mains))).alias("other"))
        dealt = dealt.select("node", "key", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        with_sets = dealt.join(_full_sets(rest.select("node"), rows, reps), "node")
        more = stash(with_sets.groupBy("key", "i", "j").applyInPandas(lambda cell: _block_links(cell, percent), "a binary, b binary"), "more")
        if not more.isEmpty():
            joined = components(links.unionByName(more))
    labelled = own.where("id is not null").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.where("node is not null").groupBy("root").agg(F.min(F.struct("id", "node")).alias("kept"))
    roots = nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(least, "root").select("node", F.col("kept.id").alias("component"), F.col("kept.node").alias("keeper"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return base.select("id", "text_md5", "n", "node").join(roots, "node", "left").select("id", "text_md5", "n", "node", component.alias("component"), F.when(F.col("id").isNotNull(), F.col("keeper")).alias("keeper"))


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Links: 100 * intersection >= percent * union of the sets of distinct 5-word shingles, confirmed on full sets (of
    64-bit hashes). component_id is the smallest key that links reach; kept says whether that is the row's own.

    Defined cases: null and empty texts, or texts without words, have no shingles and are linked with nothing; rows
    with a null key have a null component and are not kept, and link nothing; repeated rows each get the same
    result; rows of one key with different texts are judged each; an empty table gives no rows; other columns are
    left out.
    """
    found = _grouped(docs, key, text, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: that of the smallest key.

    Defined cases: rows with a null key, and rows without words, stay as they are; of several texts of the smallest
    key in one group, one stays; of rows that agree in key and text, and have words, one stays, with the other columns
    of any of them; an empty table gives no rows; columns of any name stay as they are.
    """
    found = _grouped(docs, key, text, percent).where("keeper is not null")
    stays = (F.col("id") == F.col("component")) & (F.col("node") == F.col("keeper"))
    judged = found.groupBy("id", "text_md5").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("times"))
    marks = stash(judged.where("not stays or times > 1").select(F.col("id").alias("_near_id"), F.col("text_md5").alias("_near_md5"), "stays"), "marks")
    own = (docs[key].cast("long") == F.col("_near_id")) & (_text_md5(docs[text]) == F.col("_near_md5"))
    # Only texts whose key may be marked are shuffled.
    asked, rest = sieved(docs, docs[key].cast("long"), marks.select("_near_id"))
    left = rest.union(asked.join(marks.drop("stays"), own, "left_anti"))
    repeated = marks.where("stays").drop("stays")
    return left if repeated.isEmpty() else left.union(asked.join(repeated, own, "left_semi").dropDuplicates([key, text]))
