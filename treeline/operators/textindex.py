"""Substring search for many queries at once, over posting lists of three-character pieces.

A text that holds a term holds each of the term's pieces, so a term's rarest piece names all texts that can hold it.
Terms are not paired with those texts: what a piece hands on is its place in its terms and their lengths, a text cuts
out what lies there, once for all terms, and the cuts meet equal terms in a join. So work grows with the texts and the
terms, not with their product, and results are exact. Texts end in three NUL characters, which no path
holds: every one or two characters then start some piece, and every text has the piece of NULs alone, which the empty
term takes. Equal terms are searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import paths
from treeline.store import ship, written

PIECE, END = 3, "\x00\x00\x00"


def _pieces(text: Column, count: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(PIECE))))


def _item(kind: str, path: str) -> Column:
    return F.xxhash64(kind, path)


def _cuts(folded: Column, asks: Column) -> Column:
    """The distinct parts of a text that lie as ``asks`` (piece: its shapes) has them around the pieces of the text."""
    text, size = F.concat(folded, F.lit(END)), F.length(folded)

    def around(i: Column) -> Column:
        shapes = F.coalesce(asks[F.substring(text, i, F.lit(PIECE))], F.array().cast("array<struct<place:int,length:int>>"))
        inside = F.filter(shapes, lambda s: (i > s["place"]) & (i - s["place"] + s["length"] <= size + 1))
        return F.transform(inside, lambda s: F.substring(text, i - s["place"], s["length"]))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size + 1), around)))


def postings(items: DataFrame, *, path: str = "relative_path") -> DataFrame:
    """(piece, item): each distinct piece of each item's folded path, the item by a hash of its kind and path.

    Written as a table, partitioned or bucketed by ``piece``, it serves any number of batches. Items of one hash share a
    posting and are told apart when they are searched. Items with a null path have no pieces.
    """
    folded = F.concat(paths.ascii_fold(path), F.lit(END))
    rows = items.where(F.col(path).isNotNull()).select(_item("kind", path).alias("item"), F.explode(_pieces(folded, F.length(folded) - PIECE + 1)).alias("piece"))
    return rows.select("piece", "item").distinct()


def search_batch(items: DataFrame, queries: DataFrame, *, index: DataFrame | None = None, limit: int = 200, path: str = "relative_path") -> DataFrame:
    """(query, matches, place, kind, relative_path): for each distinct ``query`` the count of items that hold it and the first ``limit`` of them.

    Terms are trimmed, composed and matched without ASCII case, in the order of :func:`treeline.operators.view.search`.
    ``index`` is :func:`postings` of the same items; without it they are made for this batch.

    Defined cases: an empty term is in every item; a null query has no rows, nor has one that no item holds; a repeated
    query counts once; repeated items count each; items with a null path are in no result.
    """
    if type(limit) is not int or limit < 1:
        raise ValueError("limit must be a whole number from 1")
    ship(items.sparkSession)
    asked = written(queries.select("query").where("query is not null").distinct().withColumn("term", paths.ascii_fold(paths.nfc(paths.trimmed("query")))))
    index = written(postings(items, path=path)) if index is None else index
    terms = asked.select("term").distinct()
    sizes = written(index.groupBy("piece").agg(F.count(F.lit(1)).alias("texts")))
    long, short = (terms.where(F.length("term") >= PIECE), terms.where(F.length("term") < PIECE))
    pieces = long.select("term", F.explode(_pieces(F.col("term"), F.length("term") - PIECE + 1)).alias("piece")).join(sizes, "piece", "left")
    rarest = pieces.groupBy("term").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("least")).select("term", F.col("least.piece").alias("piece"))
    nothing = short.where("term = ''").select("term", F.lit(END).alias("piece"))
    # A short term's pieces are those that start with it: a join on the start, one for either length.
    starts = [short.where(F.length("term") == n).join(sizes.select(F.substring("piece", 1, n).alias("term"), "piece"), "term").select("term", "piece") for n in range(1, PIECE)]
    wanted = rarest.unionByName(nothing)
    for s in starts:
        wanted = wanted.unionByName(s)
    # A piece's shapes: where it first lies in a term (0 in short and empty ones) and the term's length.
    place = F.greatest(F.instr("term", F.col("piece")) - 1, F.lit(0))
    # Written first: its size, which does not grow with the texts, then says whether the index has to be shuffled.
    shapes = written(wanted.groupBy("piece").agg(F.collect_set(F.struct(place.alias("place"), F.length("term").alias("length"))).alias("shapes")))
    asks = index.join(shapes, "piece").groupBy("item").agg(F.map_from_entries(F.collect_set(F.struct("piece", "shapes"))).alias("asks"))
    texts = items.where(F.col(path).isNotNull()).select(_item("kind", path).alias("item"), paths.ascii_fold(path).alias("folded"), "kind", "relative_path")
    cuts = texts.join(asks, "item").select("folded", "kind", "relative_path", F.explode(_cuts(F.col("folded"), F.col("asks"))).alias("term"))
    hits = written(cuts.join(terms, "term").select("term", "folded", "kind", "relative_path"))
    matches = hits.groupBy("term").agg(F.count(F.lit(1)).alias("matches"))
    # The limit on places is applied before rows are shuffled, so a term that is everywhere is no large group.
    along = Window.partitionBy("term").orderBy("folded", "kind", "relative_path")
    first = hits.withColumn("place", F.row_number().over(along)).where(F.col("place") <= limit)
    return asked.join(matches, "term").join(first, "term").select("query", "matches", F.col("place").cast("long").alias("place"), "kind", "relative_path")
