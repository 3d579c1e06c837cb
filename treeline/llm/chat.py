"""Chat formatting with budgeted, turn-aligned windows.

Template: ``<turn role="R" n="I" say="1" again="0">text</turn>``, one after the other. In texts and roles ``&``, ``<``
and ``"`` become ``&amp;``, ``&lt;`` and ``&quot;``, so no text can hold a control string and reading back is exact.
``n`` is the turn's place in its conversation. ``say="1"`` marks a turn under the loss mask; turns that are repeated
(``again="1"``), and the roles that are never learned, have ``say="0"``.

A turn's cost is the tokens of its formatted form: by default those of a byte vocabulary, one a UTF-8 byte, control
strings and escapes included; a caller with another vocabulary names a column of counts. Windows: prefix sums of the
costs along a conversation pick spans of whole turns that fit the budget beside the system turn, which every window
retains; every span's cost is a difference of two prefix sums. A window after the first repeats up to ``history`` of
the turns before its span, as far as they fit, and masks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed parts of the template.
OPEN, CLOSE = '<turn role="', "</turn>"
TURN = r'<turn role="([^"]*)" n="([0-9]+)" say="([01])" again="([01])">([^<]*)</turn>'


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _opening(role: Column, place: Column, say: Column, again: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit('" n="'), place, F.lit('" say="'), say, F.lit('" again="'), again, F.lit('">'))


def byte_tokens(role: Column, place: Column, text: Column) -> Column:
    """UTF-8 bytes of a formatted turn."""
    return F.octet_length(F.concat(_opening(role, place, F.lit(0), F.lit(0)), escape(text), F.lit(CLOSE))).cast("long")


def format_windows(turns: DataFrame, *, budget: int = 4096, history: int = 2, tokens: str | None = None, learned: tuple[str, ...] = ("assistant",), system: tuple[str, ...] = ("system",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, window, cost, formatted): the windows of each conversation, from 0.

    A turn is never cut: one that is over the budget alone has a window alone. Only a leading system turn is retained
    in later windows; others are turns like any other. Each turn is new in exactly one window, and only there is it
    under the loss mask (if its role is learned). ``tokens`` names a column of the turns' costs (null: 0).

    Defined cases: a null text or role is empty; rows come in the order of (turn, role, text), nulls first, and
    repeated rows are turns like any other; a null conversation id is a conversation; an empty table gives no rows;
    other columns are left out. A conversation is one row from here on, as its digest needs; conversations are dealt
    over tasks by their id.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    order = Window.partitionBy("conv").orderBy("at", "role", "text")
    placed = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("at"), r.alias("role"), t.alias("text"), *([] if tokens is None else [F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("cost")]))
    placed = placed.withColumn("i", F.row_number().over(order))
    if tokens is None:
        placed = placed.withColumn("cost", byte_tokens(F.col("role"), F.col("i") - 1, F.col("text")))
    summed_up = placed.withColumn("upto", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    packed = summed_up.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("i", "role", "text", "cost", "upto"))).alias("t"))
    lead = (F.col("t")[0]["role"].isin(*system)).cast("int")
    held = F.when(lead == 1, F.col("t")[0]["cost"]).otherwise(0)
    room = F.greatest(F.lit(budget) - held, F.lit(1))
    # Where spans begin: the turn with which the prefix sum passes what the span began with by more than the room opens the next span.
    spans = F.aggregate(
        F.sequence(F.lit(1), F.size("t")),
        F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("base")),
        lambda acc, i: F.when((i > lead) & ((F.size(acc["cuts"]) == 0) | (F.element_at("t", i)["upto"] - acc["base"] > room)), F.struct(F.concat(acc["cuts"], F.array(i)).alias("cuts"), (F.element_at("t", i)["upto"] - F.element_at("t", i)["cost"]).alias("base"))).otherwise(acc),
        lambda acc: acc["cuts"],
    )
    cut = packed.select("conv", "t", lead.alias("lead"), room.alias("room"), F.explode(F.array(spans)).alias("cuts"))
    cut = cut.withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.lit(1) + F.col("lead"))).otherwise(F.col("cuts")))
    one = cut.select("conv", "t", "lead", "room", "cuts", F.posexplode("cuts").alias("window", "first"))
    last = F.coalesce(F.get(F.col("cuts"), F.col("window") + 1) - 1, F.size("t"))
    spanned = one.select("conv", "t", "lead", "room", "window", "first", last.alias("last"))
    upto = lambda i: F.when(i > 0, F.element_at("t", F.greatest(i, F.lit(1)))["upto"]).otherwise(F.lit(0).cast("long"))
    summed = spanned.withColumn("own", F.greatest(upto(F.col("last")) - upto(F.col("first") - 1), F.lit(0)))
    # The longest run of at most ``history`` turns right before the span that still fits.
    back = F.array_max(F.filter(
        F.sequence(F.lit(0), F.least(F.lit(history), F.col("first") - 1 - F.col("lead"))),
        lambda k: F.col("own") + upto(F.col("first") - 1) - upto(F.col("first") - 1 - k) <= F.greatest(F.col("room"), F.col("own")),
    ))
    whole = summed.withColumn("back", F.when(F.col("window") == 0, 0).otherwise(F.coalesce(back, F.lit(0))))
    places = F.concat(
        F.when(F.col("lead") == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("first") - F.col("back") <= F.col("last"), F.sequence(F.col("first") - F.col("back"), F.col("last"))).otherwise(F.array().cast("array<int>")),
    )

    def turn_text(i: Column) -> Column:
        x = F.element_at("t", i)
        again = ((i < F.col("first")) & (F.col("window") > 0)).cast("int")
        say = ((again == 0) & x["role"].isin(*learned)).cast("int")
        return F.concat(_opening(x["role"], i - 1, say, again), escape(x["text"]), F.lit(CLOSE))

    cost = F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + F.element_at("t", i)["cost"])
    return whole.select(F.col("conv").alias(conv), "window", cost.alias("cost"), F.array_join(F.transform(places, turn_text), "").alias("formatted"))


def read_back(windows: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, said, formatted_chars) parsed from ``formatted``: each turn once, as (n, role, text), and the texts under the loss mask."""
    pieces = [F.regexp_extract_all(F.col("formatted"), F.lit(TURN), F.lit(g)) for g in range(1, 6)]
    zipped = F.arrays_zip(*(p.alias(f"g{g}") for g, p in enumerate(pieces, 1)))
    new = F.filter(zipped, lambda x: x["g4"] == "0")
    parsed = F.transform(new, lambda x: F.struct(x["g2"].cast("long").alias("n"), unescape(x["g1"]).alias("role"), unescape(x["g5"]).alias("text"), x["g3"].alias("say")))
    rows = windows.select(F.col(conv).alias("conv"), parsed.alias("p"), F.length("formatted").cast("long").alias("chars"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("turns"), F.sum("chars").alias("formatted_chars"))
    return grouped.select(F.col("conv").alias(conv), "turns", F.transform(F.filter("turns", lambda x: x["say"] == "1"), lambda x: x["text"]).alias("said"), "formatted_chars")
