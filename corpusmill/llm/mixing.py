"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. A plan asks of a source a quota of tokens, its share of the plan's budget. The quota is
met by certain whole copies of the source, as many as fit and at most max_repeats, and the rest by a sample of documents with unequal
probabilities: that of a document grows with a power of its size, p = min(1, scale * size ** SIZE_POWER), so that the tokens of a source, not its
many short documents, are what is sampled; the scale is the one at which the expected tokens are the rest of the quota, and documents with p = 1 are certain. Documents are ranked by
Pareto order sampling, random odds over inclusion odds with a random number that hangs on seed, plan and document only (certain ones first), and the
first ones are taken until the rest is filled as closely as whole documents allow: a sample of fixed size in tokens.

No task holds a source: sizes fall into classes a hundredth apart, at most a few thousand per source, from which the scale is found; the ranks are cut into BINS bins, whose
sizes are summed on the map side; the small table of bin sums gives the bin in which the quota ends, and only the documents of that one bin are ordered, a BINS-th of the source.

Defined results: null and empty texts have no tokens and are never chosen; a source of a plan that is absent or has no tokens
contributes nothing, and its shortfall is reported; sources in no plan are not used; equal ranks are ordered by the random number, then by doc_id; repeated target
rows count once; a null or negative max_repeats counts as 0; repeated documents are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import tokens
from corpusmill.session import settle

BINS = 4096
SEED = 20240301
#: Power of a document's size that its inclusion probability is proportional to; 0 takes all documents alike.
SIZE_POWER = 0.5
#: Ratio of neighbouring size classes.
STEP = 1.01
#: Rows of targets up to which the table is sent to every task; larger ones are joined by key.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it was counted and found small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that hangs on the keys and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def strata(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each (plan_id, source) with its quota, size, whole copies and rest."""
    t = targets.where("plan_id is not null and source is not null").select("plan_id", "source", "target_share", "max_repeats", "token_budget").distinct()
    t = t.groupBy("plan_id", "source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"), F.max("token_budget").alias("token_budget"))
    total = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("docs"))
    s = t.join(total, "source", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    s = s.withColumn("quota", F.col("target_share") * F.col("token_budget"))
    copies = F.when(F.col("size") > 0, F.least(F.floor(F.col("quota") / F.greatest("size", F.lit(1))), F.col("max_repeats").cast("long"))).otherwise(F.lit(0))
    s = s.withColumn("whole", copies.cast("long"))
    rest = F.when((F.col("whole") < F.col("max_repeats")) & (F.col("size") > 0), F.col("quota") - F.col("whole") * F.col("size")).otherwise(F.lit(0.0))
    return s.withColumn("rest", rest)


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP))).cast("int")


def weight(size_class_: Column, power: float) -> Column:
    """The power of a class's size."""
    return F.exp(size_class_ * F.log(F.lit(STEP)) * power)


def scales(sizes: DataFrame, plan: DataFrame, power: float = SIZE_POWER) -> DataFrame:
    """(plan_id, source, scale): where min(1, scale * weight) gives the rest of the quota as expected tokens.

    The classes with the greatest weights are certain; with the first k of them certain, the scale is what is left of the rest over the weighted tokens of the others.
    """
    classes = sizes.groupBy("source", size_class(F.col("n_tokens")).alias("c")).agg(F.sum("n_tokens").alias("t"))
    rows = classes.join(small(plan.where("rest > 0").select("plan_id", "source", "rest")), "source").withColumn("w", weight(F.col("c"), power))
    by = Window.partitionBy("plan_id", "source").orderBy(F.desc("c"))
    certain = F.coalesce(F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("w") * F.col("t")).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("scale", (F.col("rest") - certain) / others)
    # The first class that isn't certain tells the scale; where all are, any scale of one or more will do.
    return rows.where("scale * w <= 1 and scale > 0").groupBy("plan_id", "source").agg(F.max_by("scale", "c").alias("scale"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return settle(tokens.count_table(docs, ["doc_id", "source"]).where("n_tokens > 0 and source is not null"))


def mix(sizes: DataFrame, targets: DataFrame, power: float = SIZE_POWER) -> DataFrame:
    """(plan_id, source, doc_id, n_tokens, repeats) of the chosen documents."""
    plan = settle(strata(sizes, targets))
    scale = settle(scales(sizes, plan, power))
    plan = plan.where("size > 0 and max_repeats > 0").select("plan_id", "source", "whole", "rest").join(small(scale), ["plan_id", "source"], "left")
    ranked = sizes.join(small(plan), "source")
    u = uniform(F.col("plan_id"), F.col("doc_id"))
    p = F.least(F.lit(1.0), F.coalesce(F.col("scale") * weight(size_class(F.col("n_tokens")), power), F.lit(1.0)))
    ranked = ranked.withColumn("u", u).withColumn("p", p)
    # Random odds over inclusion odds; bins of rank / (1 + rank) keep the order.
    ranked = ranked.withColumn("rank", (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.greatest("p", F.lit(1e-300))))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    bins = ranked.where("rest > 0").groupBy("plan_id", "source", "bin").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    w = Window.partitionBy("plan_id", "source").orderBy("bin")
    edge = bins.withColumn("after", F.sum("t").over(w)).withColumn("before", F.col("after") - F.col("t")).where("before < rest and after >= rest")
    edge = settle(edge.select("plan_id", "source", F.col("bin").alias("edge"), "before"))
    r = ranked.join(small(edge), ["plan_id", "source"], "left")
    inner = r.where("bin = edge")
    by = Window.partitionBy("plan_id", "source").orderBy("rank", "u", "doc_id")
    inner = inner.withColumn("until", F.col("before") + F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # A document across the end of the quota is taken if that comes closer.
    inner = inner.withColumn("taken", (F.col("until") - F.col("n_tokens") / 2 <= F.col("rest")).cast("long")).drop("until")
    # Without an edge the whole source is within the rest.
    outer = r.where("edge is null or bin != edge").withColumn("taken", ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))).cast("long"))
    every = inner.unionByName(outer)
    return every.withColumn("repeats", (F.col("whole") + F.col("taken")).cast("int")).where("repeats > 0").select("plan_id", "source", "doc_id", "n_tokens", "repeats")


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and source what was asked and what came out."""
    got = mix(sizes, targets).groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    s = strata(sizes, targets).join(got, ["plan_id", "source"], "left")
    s = s.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("whole_plan", F.sum("tokens").over(Window.partitionBy("plan_id")))
    return s.select(
        "plan_id", "source", "target_share", "max_repeats", F.round("quota", 3).alias("quota"), "size", "tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.when(F.col("whole_plan") > 0, F.col("tokens") / F.greatest("whole_plan", F.lit(1))).otherwise(F.lit(0.0)).alias("actual_share"),
        F.round(F.greatest(F.col("quota") - F.col("tokens"), F.lit(0.0)), 3).alias("shortfall"),
    )
