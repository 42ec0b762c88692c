"""Mixing sources to target weights by weighted sampling without replacement (exponential keys), with DataFrame functions only.

Every document gets the key -ln(u) / weight, u drawn from a hash of its id; the smallest keys of a source are a
weighted sample (Efraimidis and Spirakis). Targets are water-filled from the sources' weights and sizes. A target of t words
from a source of s words is floor(t / s) complete epochs, and the remainder is taken in key order up to the token budget.

The order inside a source is never one task's work: keys fall into `buckets` equal parts of the key's distribution, bucket
totals give offsets, and running sums are made inside a (source, bucket). Tables that are summed per source have one row for
each source and bucket.

Nulls and edges: a null text has size 0; a null source is a source of its own, ranked last; a null or non-positive
weight counts as the default; a null doc_id hashes as the empty string; ties go by doc_id, size and a hash of the text, so
repeated rows are counted one by one; a long text costs one regular expression over it; an empty table gives an empty result. Other
columns of the input, whatever their names, are ignored (`materialised` passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, total: Column | None = None) -> DataFrame:
    """Add `target` to one row per source (source, source_size): shares by the weights in turn, none above most x its size.

    A source is full when the level (words per unit of weight) of its ceiling lies below the common level; taken in that
    order, the level with the first k sources full is (total - their ceilings) / (the others' weights). It rises while
    the next source is full too, and falls after: the common level is the largest at which the next source is not full.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()
    x = sizes.withColumn("share", share).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("ratio", F.col("ceiling") / F.col("share"))
    x = x.withColumn("all_words", total.cast("double") if total is not None else F.sum("source_size").over(everything).cast("double"))
    below = up.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("ceiling").over(below), F.lit(0.0))) / (F.sum("share").over(everything) - F.coalesce(F.sum("share").over(below), F.lit(0.0))))
    x = x.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    return x.select("source", "source_size", F.coalesce(F.least("ceiling", F.col("share") * F.col("level")), F.col("ceiling")).alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, quality: DataFrame | None = None, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often, and with how many words in all, each row of docs is taken.

    quality: (doc_id, weight), one row per id; ids without a row weigh 1. copies never exceeds `most`. buckets changes no result:
    by default there is one for every 100 000 rows, and 256 at least.
    """
    buckets = buckets or max(256, docs.count() // 100_000)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), u.alias("u"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(quality.select(F.col("doc_id"), F.col("weight").cast("double").alias("weight")), "doc_id", "left")
        rows = rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))
    rows = rows.withColumn("key", -F.log("u") / F.col("weight"))
    bucket = F.least(F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key")))), F.lit(buckets - 1)).cast("int")
    rows = stored(rows.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "size", "tie", "key", bucket.alias("bucket")))
    part = ["s_null", "s", "bucket"]
    sums = rows.groupBy(*part).agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    sizes = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    sizes = sizes.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "source_size", "target")
    before = W.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).select(*part, "offset")
    x = rows.join(sums.join(sizes, ["s_null", "s"]), part)
    upto = W.partitionBy(*part).orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("size").over(upto) + F.col("offset"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    # a document that straddles the budget is taken if at least half of it lies below
    x = x.withColumn("epochs", epochs.cast("long")).withColumn("copies", F.col("epochs") + (F.col("upto") * 2 - F.col("size") <= 2 * rest).cast("long"))
    x = x.withColumn("copies", F.least("copies", F.lit(int(most))))
    return x.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def materialised(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs, as they are, each as often as the plan of mix_sources takes it.

    Rows that share id and text are told apart by a number, in either table, so each gets the copies of one row of the plan.
    """
    key = ["id_", "no_id_", "tie_"]
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), F.col("doc_id").isNull().alias("no_id_")]
    of = W.partitionBy(*key)
    row = docs.select(F.struct(*docs.columns).alias("row_"), *same, F.xxhash64("text").alias("tie_"))
    row = row.withColumn("number_", F.row_number().over(of.orderBy(F.xxhash64("row_"))))
    taken = plan.select(*same, F.col("tie").alias("tie_"), F.col("copies").cast("int").alias("copies_")).withColumn("number_", F.row_number().over(of.orderBy(F.desc("copies_"))))
    out = row.join(taken.filter("copies_ > 0"), [*key, "number_"])
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select("row_.*")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 0.5 for bad ones (the best label counts); unlabelled ids are left to the default of 1."""
    best = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
 k AS (SELECT d.doc_id, d.source, d.size,
   -ln((CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710657.0::DOUBLE)
     / (CASE WHEN q.quality IS NULL THEN 1.0::DOUBLE WHEN q.quality > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS key
   FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
 s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS share, source_size * 3.0::DOUBLE AS ceiling FROM s),
 s2 AS (SELECT *, ceiling / share AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words FROM s1),
 s3 AS (SELECT *, (all_words - coalesce(sum(ceiling) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
   / (sum(share) OVER () - coalesce(sum(share) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lev FROM s2),
 s4 AS (SELECT *, max(CASE WHEN ratio >= lev THEN lev END) OVER () AS level FROM s3),
 s5 AS (SELECT source, source_size, coalesce(least(ceiling, share * level), ceiling) AS target FROM s4),
 u AS (SELECT k.doc_id, k.size, s5.source_size, s5.target,
   sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
   CASE WHEN s5.source_size > 0 THEN floor(s5.target / s5.source_size) ELSE 0 END AS epochs
   FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
 CAST(size * least(3, epochs + CASE WHEN upto * 2 - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u
"""
