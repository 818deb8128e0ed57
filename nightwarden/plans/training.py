"""Training of all clients at once by synchronous data-parallel steps.

A sample is put into blocks of a few rows, as arrays, where its rows lie, and written if more than
one step reads it; a client has as many blocks as its rows need, so no task holds a client, and readers that take thousands of blocks
at once hold some tens of megabytes. In every step the blocks meet their client's weights, an Arrow
batch of blocks gives one gradient a client, gradients are summed by position with partial
aggregation, and one narrow row of new weights a client is written for the next step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nightwarden import fixed_values as fv
from nightwarden.operators.anchors import changes
from nightwarden.plans.learning import flat_weights, with_weights
from nightwarden.plans.network_detection import Model
from nightwarden.session import checkpointed, if_small

BLOCK_ROWS = 16
#: Rows that a task holds back for fuller blocks.
HELD_ROWS = 1 << 14
#: Clients whose weights are sent to all tasks; a row of them is a few kilobytes.
SMALL_CLIENTS = 20_000
STEP_RATE = 0.1


def blocks(sample: DataFrame, row_id: str, rows: int = BLOCK_ROWS, kept: bool = True) -> DataFrame:
    """(client_id, xs, ys): the rows of a sample with features ``x`` and class ``y`` in blocks of at most ``rows``.

    They are ``kept`` in a table unless they are read only once.
    """

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("client_id").combine_chunks()
        new = changes(table, ["client_id"])
        at = np.arange(table.num_rows)
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        begins = np.flatnonzero(place % rows == 0)
        x, y = (table.column(name).combine_chunks() for name in ("x", "y"))
        width = len(x.flatten()) // len(x)
        ends = np.append(begins, len(x))
        return pa.RecordBatch.from_arrays([
            table.column("client_id").combine_chunks().take(pa.array(begins)),
            pa.ListArray.from_arrays(pa.array(ends * width, pa.int32()), x.flatten()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), y),
        ], ["client_id", "xs", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    narrow = sample.select("client_id", "x", F.col("y").cast("double").alias("y"))
    made = narrow.mapInArrow(run, "client_id string, xs array<double>, ys array<double>")
    return checkpointed(made) if kept else made


def first_weights(sample: DataFrame, model: Model) -> DataFrame:
    """(client_id, weights): every client of a sample, or of its blocks, starts from the same model."""
    start = F.array(*[F.lit(float(w)) for w in flat_weights(model)])
    return checkpointed(sample.select("client_id").distinct().select("client_id", start.alias("weights")))


def gradient(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed gradient and log loss of rows, for ReLU hidden layers and a logistic output."""
    k = len(model.coefs)
    layers = [(x - model.mean) / model.scale]
    for i in range(k):
        z = layers[-1] @ model.coefs[i] + model.intercepts[i]
        layers.append(np.maximum(z, 0) if i < k - 1 else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
    out = np.clip(layers[-1][:, 0], np.finfo(float).eps, 1 - np.finfo(float).eps)
    loss = -float(np.sum(y * np.log(out) + (1 - y) * np.log(1 - out)))
    delta, coefs, intercepts = layers[-1] - y[:, None], [None] * k, [None] * k
    for i in reversed(range(k)):
        coefs[i], intercepts[i] = layers[i].T @ delta, delta.sum(axis=0)
        if i:
            delta = (delta @ model.coefs[i].T) * (layers[i] > 0)
    return np.concatenate([a.ravel() for a in (*coefs, *intercepts)]), loss


def gradients(blocks_: DataFrame, weights: DataFrame, model: Model) -> DataFrame:
    """(client_id, n, loss, gradient) of the blocks of a batch under their client's weights."""
    width = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = batch.column(0).dictionary_encode()
            for k, client in enumerate(names.dictionary):
                own = batch.take(pa.array(np.flatnonzero(names.indices.to_numpy() == k)))
                _, xs, ys, flat = own.columns
                x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys))
                weights_ = with_weights(model, flat[0].values.to_numpy(zero_copy_only=False))
                out.append((client.as_py(), len(y), *gradient(weights_, x.reshape(-1, width), y)))
            client, n, sums, loss = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(client, pa.string()), pa.array(n, pa.int64()), pa.array(loss, pa.float64()), pa.array(list(sums), pa.list_(pa.float64()))],
                ["client_id", "n", "loss", "gradient"])

    met = blocks_.join(if_small(weights.select("client_id", "weights"), SMALL_CLIENTS), "client_id")
    return met.select("client_id", "xs", "ys", "weights").mapInArrow(run, "client_id string, n long, loss double, gradient array<double>")


def fine_tune_step(blocks_: DataFrame, weights: DataFrame, model: Model, rate: float = STEP_RATE) -> DataFrame:
    """(client_id, n, loss, weights) after one full-batch step of every client; ``loss`` is the mean before it."""
    found = gradients(blocks_, weights, model)
    cells = found.select("client_id", "n", "loss", F.posexplode("gradient").alias("at", "g")).groupBy("client_id", "at").agg(
        F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    old = weights.select("client_id", F.posexplode("weights").alias("at", "w"))
    moved = cells.join(old, ["client_id", "at"]).withColumn("w", F.col("w") - rate * F.col("g") / F.col("n"))
    # A row a client: as many numbers as the network has.
    return moved.groupBy("client_id").agg(
        F.max("n").alias("n"), (F.max("loss") / F.max("n")).alias("loss"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda s: s["w"]).alias("weights"))


def fine_tune_steps(sample: DataFrame, model: Model, row_id: str, steps: int = fv.FINE_TUNE_EPOCHS, rate: float = STEP_RATE) -> DataFrame:
    """(client_id, n, loss, weights) after some steps from the same model; nothing bounds a client's sample."""
    held = blocks(sample, row_id, kept=steps > 1)
    state = first_weights(held if steps > 1 else sample, model)
    for _ in range(steps):
        state = checkpointed(fine_tune_step(held, state, model, rate))
    return state


def averaged(tuned: DataFrame) -> DataFrame:
    """(place, clients, samples, weight): the mean of every weight over clients, weighted by their rows."""
    n = F.col("n")
    return tuned.select("n", F.posexplode("weights").alias("place", "w")).groupBy("place").agg(
        F.count("*").alias("clients"), F.sum(n).alias("samples"), (F.sum(F.col("w") * n) / F.sum(n)).alias("weight"))
