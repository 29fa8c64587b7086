"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources get weights; their shares of the budget (all words) stop at ``epochs`` times their size, what is over is shared
again by weight (water filling, in closed form over the sources sorted by the level at which each is full).  Documents
are shuffled within their source by a hash.  A document's k-th copy has the virtual finish time

    (k * source size + cumulative words of the source up to and with it) / target of the source,

so all sources reach their targets at virtual time 1.  Copies are put in one global order of finish time and taken until
the budget is used up; the copy at a source's target is taken in part.  Cumulative sums are made in two levels (totals
of hash or time ranges, then inside each range), so no source and no global order is ever one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import table, written

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Documents of a source are summed up in parts, and virtual times in ranges, of about so many rows (4096 of either at least).
PART_ROWS = 250_000
WORD = r"[^\x20\x09-\x0D]++"


def words(text: Column) -> Column:
    """Number of words of a text as a long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("2"))


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, source_size, target, budget) of the sources of ``sizes`` (src, size)."""
    own = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src")) - 1
    own = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({
        "budget": F.sum("source_size").over(every),
        "rest": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "rank": F.row_number().over(filled),
    })
    fits = F.col("rest").cast("double") * F.col("w") / F.col("rest_w") <= F.col("cap")
    first = F.min_by(F.struct("rank", "rest", "rest_w"), F.when(fits, F.col("rank"))).over(every)
    level = own.withColumn("at", first)
    share = F.when(F.col("at.rank").isNull() | (F.col("rank") < F.col("at.rank")), F.col("cap").cast("double")).otherwise(F.col("at.rest").cast("double") * F.col("w") / F.col("at.rest_w"))
    return level.select("src", "source_size", share.alias("target"), "budget")


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, copies): every row with its place in its source, and the copies taken in global order of virtual time.

    ``rows``: id, src, size, start (words of its source before it), source_size, target, budget.
    ``copies``: id, src, start, epoch, words (taken), finish (virtual time), position (words taken before it).
    Null ids sort by ''; repeated rows are separate documents of equal standing; sizes of 0 take nothing; an empty table
    gives empty results.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col).cast("string")).alias("src"), words(F.col(text_col)).alias("size"))
    base = written(base.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))), "mix-sizes")
    many = max(4096, int(epochs * base.count() // PART_ROWS))
    base = base.withColumn("part", F.substring("h", 1, max(3, math.ceil(math.log(many, 16)))))
    aims = targets(base, epochs, weights)
    parts = base.groupBy("src", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")).join(aims, "src")
    inside = Window.partitionBy("src", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["src", "part"]).select("id", "src", "size", "h", (F.col("ahead") + F.col("inner")).alias("start"), "source_size", "target", "budget")
    rows = written(rows, "mix-rows")

    copy = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    served = F.col("epoch").cast("long") * F.col("source_size") + F.col("start")
    copies = rows.where("size > 0").select("*", copy.alias("epoch")).withColumn("words", F.least("size", F.ceil("target") - served)).where("words > 0")
    copies = copies.withColumn("finish", (served + F.col("size")).cast("double") / F.col("target")).withColumn("range", F.least(F.floor(F.col("finish") * many), F.lit(2 * many)))
    ranges = copies.groupBy("range").agg(F.sum("words").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    clock = Window.partitionBy("range").orderBy("finish", "src", "start", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inner", F.coalesce(F.sum("words").over(clock), F.lit(0))).join(ranges, "range").withColumn("position", F.col("ahead") + F.col("inner"))
    taken = placed.withColumn("words", F.least("words", F.col("budget") - F.col("position"))).where("words > 0")
    return rows, taken.select("id", "src", "start", "epoch", "words", "finish", "position")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows, copies = schedule(docs, **how)
    taken = copies.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    rows = rows.withColumn("start_", F.when(F.col("size") > 0, F.col("start")))  # only a row with words has a place of its own
    return rows.join(taken.withColumnRenamed("start", "start_"), ["src", "start_"], "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with size, source_size, target and taken (columns of these
    names are replaced).  Rows that repeat an id each carry that id's sums of size and taken."""
    own = mixed(docs, id_col=id_col, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).where("taken > 0")
    rows = docs.select([c for c in docs.columns if c not in ("size", "source_size", "target", "taken")])
    return rows.join(own, rows[id_col].eqNullSafe(own["_id"])).drop("_id")


def op6_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixed(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '2') AS src, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY src),
c AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS budget, sum(w) OVER () AS all_w FROM s),
r AS (SELECT *, row_number() OVER o AS rnk,
             (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
             (all_w - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_w
      FROM c WINDOW o AS (ORDER BY cap::DOUBLE / w, src)),
f AS (SELECT rnk AS at_rank, rest AS at_rest, rest_w AS at_w FROM r WHERE rest::DOUBLE * w / rest_w <= cap ORDER BY rnk LIMIT 1),
t AS (SELECT src, source_size, budget, CASE WHEN at_rank IS NULL OR rnk < at_rank THEN cap::DOUBLE ELSE at_rest::DOUBLE * w / at_w END AS target
      FROM r LEFT JOIN f ON true),
x AS (SELECT row_number() OVER () AS k, d.*, source_size, budget, target,
             (sum(size) OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM d JOIN t USING (src)),
u AS (SELECT *, epoch * source_size + start AS served FROM x, (VALUES (0), (1), (2)) AS e(epoch) WHERE size > 0),
v AS (SELECT *, least(size, ceil(target)::BIGINT - served) AS words, (served + size)::DOUBLE / target AS finish FROM u WHERE ceil(target)::BIGINT > served),
p AS (SELECT *, (sum(words) OVER (ORDER BY finish, src, start, epoch ROWS UNBOUNDED PRECEDING))::BIGINT - words AS pos FROM v),
q AS (SELECT k, sum(greatest(0, least(words, budget - pos)))::BIGINT AS taken FROM p GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM x LEFT JOIN q USING (k)
"""
