"""Dialogues as training texts: one for each participant, with that speaker as the assistant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Roles that take no part: their turns open every rendering as they are.
FIXED_ROLES = ("system",)
#: Turns of one conversation that are rendered into one row at most; a longer one goes on in further rows.
CHUNK = 4096
#: Turn numbers that are counted together to find the places of turns.
NUMBERS = 512


def placed_turns(turns: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, turn, role, text, times): different turns with the number of times that they stand in a chunk.

    Turns that are alike in full are counted before anything is shuffled. A turn's place in its conversation is the number
    of turns in earlier blocks of NUMBERS turn numbers, from one small row a block, and of those before it in its block. So
    a conversation of any length is dealt to many tasks; only turns of the same numbers (or without one) meet in one, where
    they are sorted, on disk if need be, and not gathered.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / F.lit(NUMBERS)).cast("long").alias("_b"))
    alike = rows.groupBy("conv_id", "_b", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    blocks = rows.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("_b").alias("_block"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_b").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    first = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = alike.withColumn("_in", first).join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_b").eqNullSafe(F.col("_block")))
    numbered = numbered.withColumn("_at", F.col("_in") + F.col("_before"))
    low, high = F.floor(F.col("_at") / F.lit(chunk)).cast("long"), F.floor((F.col("_at") + F.col("n") - 1) / F.lit(chunk)).cast("long")
    parts = numbered.withColumn("chunk", F.explode(F.sequence(low, high)))
    times = F.least(F.col("_at") + F.col("n"), (F.col("chunk") + 1) * chunk) - F.greatest(F.col("_at"), F.col("chunk") * chunk)
    return parts.select("conv_id", "chunk", "turn", "role", "text", times.cast("int").alias("times"))


def perspectives(turns: DataFrame, fixed_roles: tuple[str, ...] = FIXED_ROLES, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation, participant and chunk of turns: conv_id, speaker, chunk, n_turns, text, masks.

    Each turn becomes "<|assistant|>\\n" (the speaker's own), "<|system|>\\n" (fixed roles) or "<|user name=ROLE|>\\n",
    then its text and "\\n<|end|>\\n". masks: array of (start, end) in characters of the row's text, the speaker's texts
    with their end marks: what a loss is taken on. A conversation of up to chunk turns is one row, chunk 0; a longer one
    goes on in chunks 1 and up, whole turns each, so that no row or task gathers a conversation of unbounded length.

    Turns are ordered by number (null last), then role, then text; rows that repeat in full are turns of their own, side by
    side. A null role is the participant "unknown"; null texts are empty. Turns without conv_id form one conversation.
    A conversation of fixed roles alone has no participant and gives no row, as does an empty table. Other columns are
    ignored.
    """
    rows = placed_turns(turns, chunk)
    order = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "times")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(order)).alias("turns"))  # chunk of them at most
    chunks = chunks.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"]))))
    roles = turns.select("conv_id", F.coalesce("role", F.lit("unknown")).alias("role"))
    speakers = roles.where(~F.col("role").isin(*fixed_roles)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    both = chunks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def head(t):
        return F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).when(t["role"].isin(*fixed_roles), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))

    end = F.lit("\n<|end|>\n")
    parts = both.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], end).alias("body"), (t["role"] == F.col("speaker")).alias("own"))))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

    def add(a, p):
        s = a["at"] + F.length(p["head"])
        e = s + F.length(p["body"])
        return F.struct(e.cast("long").alias("at"), F.when(p["own"], F.concat(a["masks"], F.array(F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"))))).otherwise(a["masks"]).alias("masks"))

    return parts.select("conv_id", "speaker", "chunk", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("parts", start, add)["masks"].alias("masks"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, with digests of text and masks."""
    out = perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "chunk", "n_turns", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), masks.alias("masks"))


OP9_SQL = """
WITH rows_ AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // 4096 AS chunk
  FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM rows_ WHERE role <> 'system'),
parts AS (
  SELECT conv_id, speaker, chunk, turn, role, text AS t,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
    text || chr(10) || '<|end|>' || chr(10) AS body
  FROM rows_ JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY turn NULLS LAST, role, t ROWS UNBOUNDED PRECEDING) AS e FROM parts)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, CAST(max(e) AS BIGINT) AS n_chars,
  md5(string_agg(head || body, '' ORDER BY turn NULLS LAST, role, t)) AS text_md5,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(e - length(body) AS BIGINT) || ':' || CAST(e AS BIGINT) END, ',' ORDER BY turn NULLS LAST, role, t), '') AS masks
FROM placed GROUP BY conv_id, speaker, chunk
"""
