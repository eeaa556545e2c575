"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source's target is ``min(cap, level * weight)``: the cap is ``max_epochs``
times the source's size, the level is set so that the targets add up to the
budget (all sizes).  That is the fixed point of clamping sources at their cap
and resharing the excess by weight.  A source with rate target / size takes
every document floor(rate) times, and once more the documents that come first
in a seeded hash order, up to the rest of the target; the taken size is within
half a document of the target.

Defined cases: a null source is a source of its own, last in order; a null text
has size 0; a document of size 0 is taken as often as its place says and adds
nothing.  Equal rows are taken independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.storage import cut, fresh, small

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size), with target (double).

    Sources, in ascending order of cap / weight, are at their cap until the
    level of what remains fits: (budget - caps before) / (weights from here) is
    at most cap / weight.  That level is the largest one which fits.  One row
    per source goes through one task here.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")),
        "share": F.sum("weight").over(onward)})
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("share")
    ranked = ranked.withColumn("level", F.max(F.when(fits, F.struct(
        (F.col("left").cast("double") / F.col("share")).alias("level"), "left", "share"))).over(everything))
    due = (F.col("level")["left"] * F.col("weight")).cast("double") / F.col("level")["share"]
    return ranked.select("source", "source_size",
                         F.when(fits, F.least(due, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = SEED,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns and rows of ``docs`` with size, source_size, target and copies (0 to ``max_epochs``).

    The first pass adds up sizes by source and hash bucket (4,096 a source).
    Documents in buckets before the one where a source's rest ends are taken
    once more, those after are not, and only that bucket's documents are put
    in order; so a source that holds most rows needs no task of its own.
    """
    names = fresh(docs.columns, "src", "words", "place", "bucket", "mixed")
    src, words, place, bucket, mixed = names
    rows = docs.withColumns({src: F.col(source), words: word_count(text),
                             place: F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))})
    rows = rows.withColumn(bucket, F.substring(place, 1, 3))
    sums = (rows.groupBy(F.col(src).alias("source"), F.col(bucket).alias("bucket"))
            .agg(F.sum(words).alias("size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn(
        "rest", F.greatest(F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"), F.lit(0.0)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    last = (bases.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
            .where(F.col("b.base") <= F.col("t.rest"))
            .groupBy("t.source", "source_size", "target", "whole", "rest")
            .agg(F.max(F.struct("bucket", "base")).alias("end")))
    last = cut(last.select(F.struct("source", "source_size", "target", "whole", "rest", "end").alias(mixed)))
    told = rows.join(small(last, last.count()), F.col(src).eqNullSafe(F.col(mixed)["source"]))
    end = F.col(mixed)["end"]
    inner = Window.partitionBy(src).orderBy(place, F.col(key), words).rowsBetween(Window.unboundedPreceding, -1)
    cum = end["base"] + F.coalesce(F.sum(words).over(inner), F.lit(0).cast("long"))
    extra, = fresh(told.columns, "extra")
    sure = told.where(F.col(bucket) != end["bucket"]).withColumn(extra, F.col(bucket) < end["bucket"])
    edge = told.where(F.col(bucket) == end["bucket"]).withColumn(
        extra, cum.cast("double") + F.col(words) / F.lit(2.0) <= F.col(mixed)["rest"])
    copies = F.least(F.col(mixed)["whole"] + F.col(extra).cast("long"), F.lit(max_epochs).cast("long"))
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    return sure.unionByName(edge).select(
        *keep, F.col(words).alias("size"), F.col(mixed)["source_size"].alias("source_size"),
        F.col(mixed)["target"].alias("target"), copies.alias("copies"))


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as it is taken."""
    nth, = fresh(docs.columns + ["size", "source_size", "target", "copies"], "nth")
    mixed = mix(docs, **options).where(F.col("copies") > 0)
    return mixed.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
