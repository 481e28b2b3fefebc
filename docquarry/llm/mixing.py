"""Operator 5, mixing sources to target weights: a low-discrepancy source schedule.

1. Within each source, documents are shuffled (order of an MD5 of doc_id and a seed) and their tokens
   (runs of non-blank characters) laid end to end; every BLOCK_TOKENS make a block, so
   blocks of a source hold equally many tokens, but for its last.  A document longer than a
   block is split; a piece is named by its tokens' range.
2. Sources get integer target weights, by default floor(sqrt(tokens)), given weights otherwise.
3. Slot i is at the golden-ratio point (i * 2654435769 mod 2**32) / 4; the source whose interval of the
   cumulative weights, scaled to 2**30, holds it gets the slot.  At any length of the
   schedule each source's share is then within O(log n / n) of its weight.  After 2**32 slots the points begin again.
4. Slots are ranked per source and take its blocks in turn; a source that runs out begins again
   (epoch).  There are as many slots as it takes for every block to be used.

Running sums and ranks are taken in two steps, within buckets and over their totals, so a
source that holds most of the corpus is not one task's work.

Defined results: a null source is the source ''; null or blank texts have no tokens and no piece;
repeated rows of a doc_id are pieces of their own; null doc_ids are shuffled as one; without
documents, or with given weights that are all zero, there are no slots.  Sources without a
given weight, or one of 0, get no slot; a weight of less than 1 / 2**RANGE_BITS of all is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm import blocks

BLOCK_TOKENS = 2048
SEED = 42
GOLDEN = 2654435769
RANGE_BITS = 30
CHUNK_SLOTS = 1 << 16


def point(slot: str, div: str = "div") -> str:
    """SQL of the point of a slot, of any number: GOLDEN is multiplied by halves, so that nothing overflows."""
    low, high = f"({slot} % 65536)", f"(({slot} {div} 65536) % 65536)"
    return f"(((({high} * {GOLDEN}) % 65536) * 65536 + {low} * {GOLDEN}) % 4294967296) {div} 4"


def pieces(documents: DataFrame, block: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block_no, doc_id, from_token, to_token): pieces of documents by block."""
    d = documents.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long").alias("tokens"),
    ).where("tokens > 0").withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))))
    d = d.withColumn("bucket", F.substring("h", 1, 3))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum")).select("source", "bucket", before.alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("inside", inside).join(offsets, ["source", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    last = F.col("at") + F.col("tokens")
    d = d.select("source", "doc_id", "at", last.alias("last"), F.explode(F.expr(f"sequence(at div {block}, (at + tokens - 1) div {block})")).alias("block_no"))
    return d.select("source", "block_no", "doc_id", (F.greatest(F.col("block_no") * block, "at") - F.col("at")).alias("from_token"), (F.least((F.col("block_no") + 1) * block, "last") - F.col("at")).alias("to_token"))


def targets(cut: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, blocks, weight): whole blocks used, and integer target weights."""
    total = cut.groupBy("source").agg((F.max("block_no") + 1).alias("blocks"), F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"))
    if weights is None:
        return total.select("source", "blocks", F.floor(F.sqrt("tokens")).cast("long").alias("weight"))
    given = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("long").alias("weight")).groupBy("source").agg(F.max("weight").alias("weight"))
    return total.join(given, "source").where("weight > 0").select("source", "blocks", "weight")


def schedule(goal: DataFrame) -> DataFrame:
    """(slot, source, epoch, block_no) of all slots."""
    upto = F.sum("weight").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("weight").over(Window.partitionBy())
    # one row a source: the cumulative weights are the only global window
    bounds = goal.withColumn("upto", upto).withColumn("whole", whole).select("source", "blocks", F.expr(f"((upto - weight) << {RANGE_BITS}) div whole").alias("low"), F.expr(f"(upto << {RANGE_BITS}) div whole").alias("high"), F.expr("(blocks * whole + weight - 1) div weight").alias("slots"))
    bounds = blocks.written(bounds, "bounds")
    slots, sources, empty = bounds.agg(F.max("slots"), F.count("*"), F.count_if(F.col("low") >= F.col("high"))).first()
    if empty:
        raise ValueError(f"{empty} sources have less than 1 / 2**{RANGE_BITS} of the weight: no slot would be theirs")
    # the longest waiting source may lie a few slots beyond its expected number: take a margin, more at need, cut at the end
    count = (slots or 0) + (slots or 0) // 50 + 64
    while True:
        ranked = blocks.written(_ranked(bounds, count), "slots")
        # the slot at which the last source has used its last block
        end, done = ranked.where("rank = blocks - 1").agg(F.max("slot"), F.count("*")).first()
        if done == sources:
            break
        count *= 2
    return ranked.where(F.col("slot") <= F.lit(-1 if end is None else end)).select("slot", "source", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block_no"))


def _ranked(bounds: DataFrame, count: int) -> DataFrame:
    """(slot, source, blocks, rank) of the first count slots; rank counts within the source."""
    shift = RANGE_BITS - 12
    cells = bounds.withColumn("cell", F.explode(F.expr(f"sequence(low >> {shift}, (high - 1) >> {shift})")))
    drawn = bounds.sparkSession.range(count).select(F.col("id").alias("slot"), F.expr(point("id")).alias("point")).withColumn("cell", F.expr(f"point >> {shift}"))
    mine = drawn.join(cells, "cell").where("point >= low and point < high").select("slot", "source", "blocks", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = mine.groupBy("source", "chunk").agg(F.count("*").alias("n")).select("source", "chunk", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return mine.withColumn("inside", rank).join(offsets, ["source", "chunk"]).select("slot", "source", "blocks", (F.col("before") + F.col("inside")).alias("rank"))


def mix(documents: DataFrame, weights: DataFrame | None = None, block: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(slot, source, epoch, block_no, doc_id, from_token, to_token): what to read at each slot."""
    cut = blocks.written(pieces(documents, block, seed), "pieces")
    return schedule(targets(cut, weights)).join(cut, ["source", "block_no"]).select("slot", "source", "epoch", "block_no", "doc_id", "from_token", "to_token")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (
  SELECT coalesce(source, '') AS source, doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':{SEED}')) AS h
  FROM documents),
p AS (
  SELECT source, doc_id, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS pos
  FROM d WHERE tokens > 0),
cut AS (
  SELECT source, b AS block_no, doc_id, greatest(b * {BLOCK_TOKENS}, pos) - pos AS from_token, least((b + 1) * {BLOCK_TOKENS}, pos + tokens) - pos AS to_token
  FROM (SELECT *, unnest(range(pos // {BLOCK_TOKENS}, (pos + tokens - 1) // {BLOCK_TOKENS} + 1)) AS b FROM p)),
goal AS (SELECT source, max(block_no) + 1 AS blocks, CAST(floor(sqrt(sum(to_token - from_token))) AS BIGINT) AS weight FROM cut GROUP BY source),
c AS (SELECT *, CAST(sum(weight) OVER (ORDER BY source) AS BIGINT) AS upto, CAST(sum(weight) OVER () AS BIGINT) AS whole FROM goal),
bounds AS (SELECT source, blocks, ((upto - weight) * {1 << RANGE_BITS}) // whole AS low, (upto * {1 << RANGE_BITS}) // whole AS high, (blocks * whole + weight - 1) // weight AS slots FROM c),
drawn AS (SELECT i AS slot, {point("i", "//")} AS point FROM (SELECT unnest(range((SELECT CAST(max(slots) + max(slots) // 50 + 64 AS BIGINT) FROM bounds))) AS i)),
ranked AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM drawn JOIN bounds ON point >= low AND point < high),
s AS (SELECT slot, source, rank // blocks AS epoch, rank % blocks AS block_no FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1))
SELECT slot, s.source, epoch, s.block_no, doc_id, from_token, to_token FROM s JOIN cut ON s.source = cut.source AND s.block_no = cut.block_no
"""
