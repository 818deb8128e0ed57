"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, NULL last, weigh `weights`, repeating. Together they are to give
`share` times all words; a source gives `repeats` times its own words at most, and what that
cuts off goes to the others by weight. A source's documents are first taken whole as often as
its target holds them all. What is left is a fraction f of the source: each document draws u
from a hash of its id, its odds u/(1-u) are divided by its inclusion odds, and documents are taken
in rising order until the words are nearest to the target. Inclusion odds are f/(1-f) times a weight
by size (`size_weight`): half under 50 words, twice from 500 on, so that a mix leans to whole
articles. Reruns agree, as the draw is a hash.

The cut in that order is found with counts: two rounds of 1024 cells per source, each a
partially aggregated sum, then the few documents of one cell in order. So a source that holds
a third of all rows is never sorted or gathered. What the cut needs is one row per source,
broadcast only if Spark finds the written table small.

Defined cases: a NULL or empty text has no words and takes none; a NULL source is a source of
its own; rows that share a doc_id draw alike; a row with a NULL id draws by its text; sources
without words have target 0; other columns pass through `mixed` whatever their names are; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden.llm.text import whole, words
from nightwarden.session import checkpointed

CELLS = 1024
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): words per document, and what its draw is a hash of."""
    return docs.select("doc_id", "source", F.size(words(whole("text"))).cast("long").alias("size"), draw().alias("draw"))


def draw() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(whole("text")))


def size_weight() -> Column:
    """Weight of a document's inclusion odds."""
    return F.when(F.col("size") < 50, 0.5).when(F.col("size") < 500, 1.0).otherwise(2.0)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: size, target, copies taken whole and the fraction left to draw.

    The ranks and running sums see one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights))
    ranked = total.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    ranked = ranked.withColumn("room", F.col("cap") / F.col("weight")).withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("goal") - before) / open_weight)
    own = F.when(F.col("room") > F.col("level"), F.col("level"))
    level = level.withColumn("common", F.first(own, ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight"))
    held = F.col("source_size") > 0
    return (
        level.select("source", "source_size", target.alias("target"))
        .withColumn("copies", F.when(held, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("fraction", F.when(held, F.col("left") / F.col("source_size")).otherwise(0.0))
    )


def place(seed: int, weight: Column | None = None) -> Column:
    """q / (1 + q) for the Pareto rank q of a document whose row carries `draw` and `fraction`; 1 where that is 0."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw"))), 1, 12), 16, 10).cast("double")
    u = (drawn + 0.5) / float(1 << 48)
    odds = (u / (1 - u)) * (1 - F.col("fraction"))
    inclusion = F.col("fraction") * (weight if weight is not None else F.lit(1.0))
    return odds / (odds + inclusion)


def cuts(sized: DataFrame, plan: DataFrame, seed: int, weight: Column | None = None) -> DataFrame:
    """The plan with each source's cut: the cells below it and the last document taken in its cell."""
    state = plan.withColumn("cell", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    spots = sized.join(plan.select(F.col("source").alias("s"), "fraction"), F.col("source").eqNullSafe(F.col("s"))) \
        .filter("fraction > 0").select("source", "doc_id", "size", place(seed, weight).alias("place"))
    spots = checkpointed(spots)
    order = Window.partitionBy("source").orderBy("cell")
    for depth in (1, 2):
        cell = F.least(F.floor(F.col("place") * CELLS ** depth), F.lit(CELLS ** depth - 1)).cast("long")
        known = state.select(F.col("source").alias("s"), F.col("cell").alias("parent"), "base", "left")
        inside = spots.withColumn("cell", cell).join(known, F.col("source").eqNullSafe(F.col("s"))) \
            .filter(F.floor(F.col("cell") / CELLS) == F.col("parent"))
        sums = inside.groupBy("source", "cell").agg(F.sum("size").alias("n"), F.first("base").alias("base"), F.first("left").alias("left"))
        running = sums.withColumn("upto", F.col("base") + F.sum("n").over(order))
        crossed = running.filter(F.col("upto") >= F.col("left")).groupBy(F.col("source").alias("s")).agg(
            F.min("cell").alias("c"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("b"))
        last = state.join(crossed, F.col("source").eqNullSafe(F.col("s")), "left").drop("cell", "base", "s")
        # No crossing: everything above the parent is taken.
        state = checkpointed(last.withColumnRenamed("c", "cell").withColumnRenamed("b", "base"))
    known = state.select(F.col("source").alias("s"), F.col("cell").alias("parent"), "base", "left")
    final = spots.join(known, F.col("source").eqNullSafe(F.col("s"))).filter(
        F.least(F.floor(F.col("place") * CELLS ** 2), F.lit(CELLS ** 2 - 1)) == F.col("parent"))
    one = final.groupBy("source", "place", "doc_id").agg(F.sum("size").alias("n"), F.first("base").alias("base"), F.first("left").alias("left"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_first()))
    taken = one.withColumn("upto", upto).filter((2 * F.col("upto") - F.col("n")).cast("double") <= 2 * F.col("left"))
    edge = taken.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))).alias("edge"))
    return checkpointed(state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "base"))


def extra(seed: int, weight: Column | None = None) -> Column:
    """True for a document that is drawn, on rows that carry their source's cut."""
    at = place(seed, weight)
    cell = F.least(F.floor(at * CELLS ** 2), F.lit(CELLS ** 2 - 1))
    spot = F.struct(at.alias("place"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    return F.when(F.col("fraction") <= 0, False).when(F.col("cell").isNull(), True).otherwise(
        (cell < F.col("cell")) | ((cell == F.col("cell")) & F.coalesce(spot <= F.col("edge"), F.lit(False))))


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of sizes()."""
    sized = checkpointed(sized)
    plan = cuts(sized, checkpointed(targets(sized, weights, share, repeats)), seed, size_weight())
    rows = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("copies") + F.when(extra(seed, size_weight()), 1).otherwise(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as they are taken."""
    sized = checkpointed(sizes(docs))
    plan = cuts(sized, checkpointed(targets(sized, weights, share, repeats)), seed, size_weight())
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "doc_id", "source",
                       F.size(words(whole("text"))).alias("size"), draw().alias("draw"))
    rows = held.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    times = F.col("copies") + F.when(extra(seed, size_weight()), 1).otherwise(0)
    return rows.filter(times > 0).select("doc", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("doc.*")
