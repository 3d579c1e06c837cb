"""Query op9: all conversations formatted in budgeted windows, and digests of what reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.chat import format_windows, read_back
from treeline.llm.common import read

NAME, BUDGET, HISTORY = "op9_chat_budgeted_windows", 4096, 2
#: A conversation of the contract that holds control strings of common templates.
PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_windows(turns.unionByName(probe), budget=BUDGET, history=HISTORY))
    said = F.array_join("said", "")
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_CHARS = r"len(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;'))"
_BYTES = _CHARS.replace("len(", "octet_length(encode(", 1) + ")"
_EMPTY = len('<turn role="" n="" say="0" again="0"></turn>')
#: The windows are replayed turn by turn: a recursive query carries what the open span holds.
ORACLE = rf"""
WITH RECURSIVE all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, {_EMPTY} + len((i - 1)::VARCHAR) + {_BYTES.format('text')} + {_BYTES.format('role')} AS cost FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {_CHARS.format('text')} + {_CHARS.format('role')} AS body FROM all_turns)
), c AS (
  SELECT conv_id, count(*) AS n, max(CASE WHEN i = 1 AND role = 'system' THEN 1 ELSE 0 END) AS lead,
         max(CASE WHEN i = 1 AND role = 'system' THEN cost ELSE 0 END) AS held FROM t GROUP BY conv_id
), walk AS (
  SELECT t.conv_id, t.i, 0 AS win, t.cost AS own FROM t JOIN c USING (conv_id) WHERE t.i = lead + 1
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN own + t.cost > greatest({BUDGET} - held, 1) THEN win + 1 ELSE win END,
         CASE WHEN own + t.cost > greatest({BUDGET} - held, 1) THEN t.cost ELSE own + t.cost END
  FROM walk JOIN t ON t.conv_id = walk.conv_id AND t.i = walk.i + 1 JOIN c ON c.conv_id = t.conv_id
), span AS (
  SELECT conv_id, win, min(i) AS first, max(i) AS last FROM walk GROUP BY conv_id, win
  UNION ALL SELECT conv_id, 0, lead + 1, n FROM c WHERE n = lead
), sums AS (
  SELECT span.*, (SELECT coalesce(sum(cost), 0) FROM t WHERE t.conv_id = span.conv_id AND t.i BETWEEN first AND last) AS own FROM span
), backs AS (
  SELECT sums.*, lead, greatest({BUDGET} - held, 1) AS room,
         (SELECT coalesce(sum(cost), 0) FROM t WHERE t.conv_id = sums.conv_id AND t.i = first - 1) AS b1,
         (SELECT coalesce(sum(cost), 0) FROM t WHERE t.conv_id = sums.conv_id AND t.i = first - 2) AS b2
  FROM sums JOIN c USING (conv_id)
), wins AS (
  SELECT *, CASE WHEN win = 0 THEN 0
                 WHEN first - 1 - lead >= 2 AND own + b1 + b2 <= greatest(room, own) THEN 2
                 WHEN first - 1 - lead >= 1 AND own + b1 <= greatest(room, own) THEN 1 ELSE 0 END AS back FROM backs
), chars AS (
  SELECT w.conv_id, sum({_EMPTY} + len((t.i - 1)::VARCHAR) + t.body) AS formatted_chars
  FROM wins w JOIN t ON t.conv_id = w.conv_id AND ((w.lead = 1 AND t.i = 1) OR t.i BETWEEN w.first - w.back AND w.last)
  GROUP BY w.conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS said FROM t GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, len(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM d JOIN chars USING (conv_id)
"""
