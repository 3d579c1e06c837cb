"""Packing token pieces into sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The program covers every length's count with as few
configurations as it can. It is solved by multiplicative weights: a length's price is its starting weight times an
exponential of how far its cover lags behind an even pace; each round finds the configuration of the highest price by
knapsack dynamic programming and adds it. Any prices bound the program from below: what all items cost, divided by the
price of that configuration. The solution is rounded, and what rounding leaves is packed best-fit decreasing, into the
free space of configurations first. Where the result is over the bound, other starting weights and looser rounding are
tried, and the fewest sequences win. All of this sees only the histogram, whose size is bounded by the sequence length,
so the plan costs the same for any number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import distributed_rank, hash_unit, map_arrow, small_batches, stash
from treeline.llm.tokens import encoder, with_end

#: Rounds of multiplicative weights: the number of configurations, at most.
ROUNDS = 200
#: Starting weights are these powers of the length; a configuration is rounded to whole sequences if it fills these shares of one.
POWERS, FILLS = (2, 1), (63 / 64, 7 / 8, 0)


@dataclass
class Group:
    """``count`` sequences that hold the same lengths."""

    count: int
    space: int
    lengths: list[int]


def best_configuration(value: np.ndarray, capacity: int) -> list[int]:
    """The multiset of lengths of most value that fits: unbounded knapsack. value[l] is the value of length l; 0: not to be used."""
    usable = np.flatnonzero(value > 0)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = value[usable]
    upto = np.searchsorted(usable, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        if k:
            gains = best[room - usable[:k]] + worth[:k]
            i = int(gains.argmax())
            best[room], took[room] = gains[i], usable[i]
        if best[room - 1] >= best[room]:
            best[room], took[room] = best[room - 1], 0
    out, room = [], capacity
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return out


def bound_of(counts: np.ndarray, value: np.ndarray, capacity: int) -> float:
    """What all items cost at the prices ``value`` over the highest price of a configuration: no packing has fewer sequences."""
    top = value[best_configuration(value, capacity)].sum()
    return float((counts * value).sum() / top) if top > 0 else 0.0


def least_bound(counts: np.ndarray, capacity: int) -> int:
    """A bound by three sets of prices: lengths themselves, the share of a sequence of only that length, and one for all."""
    lengths = np.flatnonzero(counts)
    alone, same = np.zeros(capacity + 1), np.zeros(capacity + 1)
    alone[lengths], same[lengths] = 1.0 / (capacity // lengths), 1.0
    size = int((np.arange(capacity + 1) * counts).sum())
    return max(-(-size // capacity), *(math.ceil(bound_of(counts, p, capacity) - 1e-6) for p in (alone, same)))


def solve_program(counts: np.ndarray, capacity: int, rounds: int, power: int = 1) -> tuple[list[tuple[list[int], float]], float]:
    """([(configuration, times)] covering ``counts`` by length, fractionally; the best bound that the rounds' prices gave)."""
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    share = max(1.0, float((lengths * need).sum()) / capacity) / rounds
    covered, bound = np.zeros(len(lengths)), 0.0
    found: dict[tuple[int, ...], int] = {}
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    start = (lengths / capacity) ** power
    for step in range(2 * rounds):
        open_ = covered < need
        # Best fit takes the last 64th.
        if (lengths * np.maximum(need - covered, 0)).sum() * 64 <= (lengths * need).sum():
            break
        lag = (step + 1) / rounds - covered / need
        value = np.zeros(capacity + 1)
        value[lengths] = start * np.exp(np.clip(lag * math.sqrt(rounds), -30, 30)) * open_
        config = best_configuration(value, capacity)
        bound = max(bound, float((value[lengths] * need).sum() / value[config].sum()))
        np.add.at(covered, place[config], share)
        found[tuple(config)] = found.get(tuple(config), 0) + 1
    return [(list(c), n * share) for c, n in found.items()], bound


def round_and_fill(counts: np.ndarray, solution: list[tuple[list[int], float]], capacity: int, fill: float = 63 / 64) -> list[Group]:
    """Whole sequences for every item: configurations of at least ``fill`` as often as rounding and what is left allow, then best fit."""
    left, groups = counts.astype(np.int64).copy(), []
    for config, times in sorted(solution, key=lambda x: (-sum(x[0]), -x[1], x[0])):
        own, many = np.unique(config, return_counts=True)
        n = min(math.ceil(times), int((left[own] // many).min()))
        if n > 0 and sum(config) >= capacity * fill:
            left[own] -= many * n
            groups.append(Group(n, capacity - sum(config), list(config)))
    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        for g in sorted((g for g in groups if g.space >= length), key=lambda g: g.space):
            if not n:
                break
            each = g.space // length
            full = min(g.count, n // each)
            if full < g.count:  # what is left of the group goes on as a group of its own
                rest = min(1, g.count - full) if n - full * each > 0 else 0
                extra = n - full * each if rest else 0
                if rest and extra < each:
                    groups.append(Group(1, g.space - extra * length, g.lengths + [length] * extra))
                    n -= extra
                else:
                    rest = 0
                if g.count - full - rest > 0:
                    groups.append(Group(g.count - full - rest, g.space, list(g.lengths)))
            g.lengths, g.space, g.count = g.lengths + [length] * each, g.space - each * length, full
            n -= full * each
        groups = [g for g in groups if g.count > 0]
        each = capacity // length
        if n // each:
            groups.append(Group(n // each, capacity - each * length, [length] * each))
        if n % each:
            groups.append(Group(1, capacity - (n % each) * length, [length] * (n % each)))
    return groups


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[Group]:
    """Groups of equal sequences that hold every item of ``histogram`` (length -> count) once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        counts[length] = n
    if not counts.any():
        return []
    least, best = least_bound(counts, capacity), None
    for power in POWERS:
        solution, bound = solve_program(counts, capacity, rounds, power)
        least = max(least, math.ceil(bound - 1e-6))
        for fill in FILLS:
            groups = round_and_fill(counts, solution, capacity, fill)
            if best is None or sum(g.count for g in groups) < sum(g.count for g in best):
                best = groups
            if sum(g.count for g in best) <= least:
                return best
    return best


def placements(groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (first rank, first sequence, offset) of each run of ranks; a run's ranks go to following sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for g in groups:
        at = 0
        for length in g.lengths:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, first, at))
            used[length] = rank + g.count
            at += length
        first += g.count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for flat, lengths in encoder(path).encode_column(batch.column(1)):
            flat, lengths = with_end(flat, lengths, end)
            flat = flat.astype("<u4", copy=False)
            pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(lengths[doc] - piece * capacity, capacity)
            data, upto = memoryview(flat).cast("B"), (4 * np.cumsum(length)).tolist()
            parts = [data[a:b] for a, b in zip([0, *upto], upto, strict=False)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(lengths)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([p.tobytes() if keep_ids else None for p in parts], pa.binary()),
            ], names=["key", "piece", "start", "length", "ids_crc32", "ids"])
            at += len(lengths)


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): documents of more than ``capacity`` ids in pieces of that many, others whole."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_arrow(rows, lambda it: _cut(it, tokenizer_path, end_id, capacity, keep_ids), "key long, piece int, start long, length long, ids_crc32 long, ids binary")


def _place(batches: Iterator[pa.RecordBatch], runs: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            ranks, firsts, offsets = runs[int(own)]
            run = np.searchsorted(ranks, rank[at], side="right") - 1
            sequence[at], offset[at] = firsts[run] + rank[at] - ranks[run], offsets[run]
        names = ["key", "piece", "start", "length", "ids_crc32", "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of each row of ``docs``.

    Pieces of one length are ranked exactly over (length, cell of a hash of key, piece and ids), so a length that a third
    of all documents share is spread over tasks, also where their keys are null or repeated; a rank finds its sequence in the plan, which is bounded by rounds and capacity and
    goes to the workers as a broadcast.

    Defined cases: null and empty texts are the end id alone; null keys stay null; repeated rows are packed each;
    an empty table gives no rows; other columns are left out.
    """
    with small_batches(docs.sparkSession):
        pieces = stash(cut_pieces(docs, tokenizer_path, end_id, capacity, key=key, text=text, keep_ids=keep_ids), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = pieces.sparkSession.sparkContext.broadcast(placements(plan(histogram, capacity, rounds)))
    cells = math.isqrt(sum(histogram.values())) + 1
    hashed = pieces.withColumn("_h", F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("ids_crc32").cast("string")).cast("binary")))
    ranked = distributed_rank(hashed, ["length"], F.shiftright(hash_unit(F.col("_h")) * cells, 32), [F.col("_h"), F.col("ids_crc32")], "rank", "total")
    placed = map_arrow(
        ranked.select("key", "piece", "start", "length", "ids_crc32", "ids", "rank"),
        lambda it: _place(it, runs.value),
        "key long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long",
    )
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset")
