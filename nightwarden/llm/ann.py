"""Nearest neighbours by inner product with a forest of hash prefixes.

Vectors fall into bands of norms, a factor of two wide, and each band has a forest of its own. In a
band they are scaled by its upper end and given one more component that makes them unit length; for
a query that component is zero. The order of inner products is then the order of angles, and one
very long vector does not make all others look alike. Queries ask every band. Each of `trees` trees hashes a vector to 62 signs against random directions. The
hashes of a tree, sorted, are its array; equal prefixes lie side by side.

The array of a tree is cut into blocks of about `block` vectors at quantiles, taken from a
bounded sample of hashes; every vector is in one block of every tree, and queries follow
their own hash. Inside a block a query descends to its longest common prefix with a binary
search and ascends, one bit at a time, until the prefix holds `width` candidates or the block
ends. Their inner products with the original vectors are exact, in double precision; the best
of all trees remain.

Of equal vectors only the `k + 1` smallest ids are indexed: no other can be among the k
nearest of any query. So a vector that a third of all rows share makes no large block, and
equal queries are asked once. Rows with equal hashes are split by a second hash of the id, another
one in every tree, so that trees do not show a query the same slice of a large run.
All queries meet all blocks of their own hash only, so the work grows with the rows.

The sample bounds blocks to `MAX_BLOCKS` per tree. Recall depends on the data; measured
figures are in the README. More trees or wider blocks raise it.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components take
no part, neither do rows without an id; vectors of another length than the most frequent one
take no part either; rows that share an id are one row, with the vector that sorts first;
fewer than k candidates give all that were found; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden.session import checkpointed

BITS = 62
TREES, BLOCK, WIDTH, SEED = 24, 4096, 2048, 7
#: Hashes the cuts of the arrays are taken from, and blocks of a tree at most.
SAMPLE, MAX_BLOCKS = 100_000, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the rows that take part, as arrays of float or double."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (size[0]["n"] if size else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _hash(dimensions: int, trees: int, seed: int) -> Column:
    """The hash of every tree for a row (vector, query, band)."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        directions = np.random.default_rng(seed).standard_normal((dimensions + 1, trees * BITS))
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for vectors, query, band in batches:
            out = []
            for k in range(0, len(vectors), 512):
                x = np.stack(vectors.iloc[k:k + 512].to_numpy()).astype(float)
                asks = query.iloc[k:k + 512].to_numpy(bool)
                x /= np.abs(x).max(1, keepdims=True) * asks[:, None] + ~asks[:, None]  # norms of any size
                x /= np.where(asks, np.linalg.norm(x, axis=1), np.exp2(band.iloc[k:k + 512].to_numpy(float) + 1))[:, None]
                rest = np.where(asks, 0, np.sqrt(np.maximum(0, 1 - (x * x).sum(1))))
                signs = np.c_[x, rest] @ directions > 0
                out += list(signs.reshape(len(x), trees, BITS) @ powers)
            yield pd.Series(out, dtype=object)

    return hashes("vector", "query", "band")


def _second(ties: np.ndarray, tree: int) -> np.ndarray:
    """Another order of the second hashes in every tree."""
    return ties * np.int64(2 * int(np.random.default_rng(tree).integers(1 << 61)) + 1)


def _cuts(sample: np.ndarray, ties: np.ndarray, blocks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree: the hashes, and the second hashes among equal ones, at which its blocks begin."""
    out = []
    for tree, hashes in enumerate(sample.T):
        second = _second(ties, tree)
        order = np.lexsort((second, hashes))
        at = order[(np.arange(1, blocks) * len(order)) // blocks]
        out.append((hashes[at], second[at]))
    return out


def _block(cuts: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Column:
    """The block of a row in every tree of its band, from its hashes and the second hash of its id."""

    @F.pandas_udf("array<int>")
    def blocks(hashes: pd.Series, ties: pd.Series, band: pd.Series) -> pd.Series:
        own, tie, bands = np.stack(hashes.to_numpy()), ties.to_numpy(), band.to_numpy()
        out = np.zeros(own.shape, np.int32)
        for number in set(bands).intersection(cuts):
            rows = np.flatnonzero(bands == number)
            for tree, (starts, start_ties) in enumerate(cuts[number]):
                mine, second = own[rows, tree], _second(tie[rows], tree)
                low, high = np.searchsorted(starts, mine), np.searchsorted(starts, mine, "right")
                for i in np.flatnonzero(high > low):  # rows with exactly the hash of a cut
                    low[i] += np.searchsorted(start_ties[low[i]:high[i]], second[i], "right")
                out[rows, tree] = low
        return pd.Series(list(out), dtype=object)

    return blocks("hashes", F.xxhash64(F.lit(1), "vec_id"), "band")


def _nearest(width: int, k: int, split: frozenset[int]):
    """The k + 1 best candidates of every query of one block of one tree; of all rows in a band that is not split."""

    def best(near: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rough = x @ q
        if len(rough) > 2 * k:
            limit = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            chosen = np.flatnonzero(rough >= limit - 1e-9 * max(1.0, abs(limit)))
            near, x = near[chosen], x[chosen]
        score = (x * q).sum(1)  # equal vectors give equal sums, whatever their place
        order = np.lexsort((near, -score))[: k + 1]
        return near[order], score[order]

    def nearest(held: pd.DataFrame) -> pd.DataFrame:
        asks = held["query"].to_numpy(bool)
        rows, asked, out = held[~asks].sort_values(["hash", "vec_id"]), held[asks], [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows) and len(asked):
            x, ids, hashes = np.stack(rows["vector"].to_numpy()).astype(float), rows["vec_id"].to_numpy(), rows["hash"].to_numpy()
            own = asked["hash"].to_numpy()
            low, high = np.zeros(len(own), np.int64), np.full(len(own), len(ids))
            for depth in range(1, BITS + 1 if int(held["band"].iloc[0]) in split else 1):
                prefix, shift = own >> (BITS - depth), BITS - depth
                start, end = np.searchsorted(hashes, prefix << shift), np.searchsorted(hashes, (prefix + 1) << shift)
                deep = end - start >= width
                if not deep.any():
                    break
                low, high = np.where(deep, start, low), np.where(deep, end, high)
            for query_id, q, a, b in zip(asked["vec_id"].to_numpy(), asked["vector"].to_numpy(), low, high):
                near, score = best(ids[a:b], x[a:b], q.astype(float))
                out.append((np.full(len(near), query_id), near, score))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    return nearest


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           trees: int = TREES, block: int = BLOCK, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of every row that `queries` (over vec_id) picks."""
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, id_col, vector_col))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    asked = rows.filter(queries)
    distinct = checkpointed(asked.groupBy("vector").agg(F.min("vec_id").alias("vec_id")))
    length = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    # Squares of extreme components leave the range of a double; their band is that of the largest component.
    largest = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    sound = (length > 1e-150) & (length < 1e150)
    kept = checkpointed(kept.select("vec_id", "vector", F.floor(F.log2(F.when(sound, length).otherwise(largest))).cast("int").alias("band")))
    counts = {r["band"]: r["n"] for r in kept.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one row a power of two
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dimensions = sum(counts.values()), kept.agg(F.max(F.size("vector"))).first()[0]
    both = kept.select("vec_id", "vector", F.lit(False).alias("query"), "band").union(
        distinct.select("vec_id", "vector", F.lit(True), F.explode(F.array(*map(F.lit, sorted(counts))))))
    hashed = checkpointed(both.withColumn("hashes", _hash(dimensions, trees, seed)))
    tie = F.xxhash64(F.lit(1), "vec_id")
    part = int(min(1.0, SAMPLE / n) * (1 << 40))
    sample = hashed.filter(~F.col("query") & (F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1 << 40)) < part)) \
        .select("band", "hashes", tie.alias("tie")).toPandas()
    cuts = {int(band): _cuts(np.stack(rows["hashes"].to_numpy()), rows["tie"].to_numpy(), min(MAX_BLOCKS, -(-counts[band] // block)))
            for band, rows in sample.groupby("band") if counts[band] > block}
    spread = hashed.withColumn("blocks", _block(cuts)).select(
        "vec_id", "vector", "query", "band", F.posexplode(F.arrays_zip("blocks", "hashes")).alias("tree", "at")
    ).select("vec_id", "vector", "query", "band", "tree", F.col("at.blocks").alias("block"), F.col("at.hashes").alias("hash"))
    # A band of one block is compared in full by one tree.
    spread = spread.filter(F.col("band").isin(*cuts) | (F.col("tree") == 0))
    found = spread.groupBy("band", "tree", "block").applyInPandas(_nearest(width, k, frozenset(cuts)), "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
    best = best.select(F.col("query_id").alias("asked"), "vec_id", "score")
    each = asked.select(F.col("vec_id").alias("query_id"), "vector").join(
        distinct.select(F.col("vec_id").alias("asked"), "vector"), "vector").select("query_id", "asked")
    return (each.join(best, "asked").filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
