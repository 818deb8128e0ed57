"""Label windows, labelled flows, local training, federated averaging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden import fixed_values as fv
from nightwarden.functions import clock
from nightwarden.functions.numbers import or_nan
from nightwarden.operators.sequence import previous_row
from nightwarden.plans.network_detection import Model, scored
from nightwarden.session import checkpointed, if_small

ATTACK, BENIGN = "ATTACK", "BENIGN"


# --- label windows ----------------------------------------------------------------

def truth_windows(log: DataFrame, offset: float = 0.0, order: str = "line_no") -> DataFrame:
    """Pair each phase end with the phase start right before it, per client and attack.

    Logs read from several files are paired file by file.
    """
    keys = [*(["file"] if "file" in log.columns else []), "client_id", "attack_type"]
    seconds = F.col("unix_us").try_cast("bigint") / float(clock.MICROS) + offset
    phases = log.withColumn("at", seconds).filter(
        F.col("at").isNotNull() & F.col("event").isin("PHASE_START", "PHASE_END"))
    paired = previous_row(phases, keys, order, F.struct("event", "at"), "before")
    return paired.filter("event = 'PHASE_END' and before.event = 'PHASE_START'").select(
        "client_id", F.col("before.at").alias("window_start"), F.col("at").alias("window_end"),
        F.lit(ATTACK).alias("label"))


def feedback_windows(alerts: DataFrame, as_of: float, days: float = fv.FEEDBACK_DAYS) -> DataFrame:
    """Windows of alerts an analyst judged: false positives benign, resolved ones attacks."""
    return (
        alerts.filter(F.col("status").isin("false_positive", "resolved"))
        .filter(F.col("received_at") >= as_of - days * 86400)
        .select(
            "client_id", clock.parse_time(F.col("window_start")).alias("window_start"),
            clock.parse_time(F.col("window_end")).alias("window_end"),
            F.when(F.col("status") == "false_positive", BENIGN).otherwise(ATTACK).alias("label"),
        )
        .filter("window_start is not null and window_end is not null")
    )


def label_windows(truth: DataFrame, feedback: DataFrame) -> DataFrame:
    return truth.unionByName(feedback)


# --- labelling --------------------------------------------------------------------

def _bin(seconds: Column, width: float) -> Column:
    return F.floor(seconds / F.lit(float(width))).cast("bigint")


DAY = 86_400.0


def _widened(windows: DataFrame, grace: float) -> DataFrame:
    return windows.withColumns({
        "_lo": F.col("window_start") - grace, "_hi": F.col("window_end") + grace,
    }).filter("_lo <= _hi")


def _disjoint(widened: DataFrame) -> DataFrame:
    """Overlapping windows of a client and label joined, among those that begin on the same day."""
    place = ["client_id", "label", "_day"]
    dated = widened.withColumn("_day", _bin(F.col("_lo"), DAY))
    before = F.max("_hi").over(Window.partitionBy(*place).orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col("_lo") > before), 1).otherwise(0)
    run = F.sum("_opened").over(Window.partitionBy(*place).orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dated.withColumn("_opened", opened).withColumn("_run", run).groupBy(*place, "_run").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).select("client_id", "label", "_lo", "_hi")


def window_cover(windows: DataFrame, width: float) -> DataFrame:
    """What disjoint windows cover of each time bin, one row per (client, bin).

    A window at least as long as a bin either fills a bin, reaches from some point to its
    end or from its begin to some point, so three figures per label describe the union of
    any number of windows. Only shorter ones need to be listed.
    """
    binned = windows.withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col("_lo"), width), _bin(F.col("_hi"), width))))
    begin, end = F.col("_bin") * width, (F.col("_bin") + 1) * width
    open_left, open_right = F.col("_lo") <= begin, F.col("_hi") >= end
    figures = []
    for label in (ATTACK, BENIGN):
        mine = F.col("label") == label
        figures += [
            F.bool_or(mine & open_left & open_right).alias(f"{label}_full"),
            F.min(F.when(mine & ~open_left & open_right, F.col("_lo"))).alias(f"{label}_from"),
            F.max(F.when(mine & open_left & ~open_right, F.col("_hi"))).alias(f"{label}_to"),
            F.collect_set(F.when(mine & ~open_left & ~open_right, F.struct("_lo", "_hi"))).alias(f"{label}_inside"),
        ]
    return binned.groupBy("client_id", "_bin").agg(*figures)


def windows_hit(flows: DataFrame, windows: DataFrame, grace: float = fv.LABEL_GRACE_SECONDS) -> DataFrame:
    """Flows with a start, and whether it lies in an attack or a benign window.

    Windows up to a day are spread over fine bins, longer ones over days, so a window of years
    is a few thousand rows. What they cover of the bins that have flows is written; if that is
    little, it is sent to the flows, which stay where they are.
    """
    fine = 2 * grace if grace > 0 else fv.DENSITY_BIN_SECONDS
    t = F.col("FlowStartTime")
    hit = lambda label: F.coalesce(
        F.col(f"{label}_full") | F.coalesce(t >= F.col(f"{label}_from"), F.lit(False))
        | F.coalesce(t <= F.col(f"{label}_to"), F.lit(False))
        | F.exists(f"{label}_inside", lambda w: (t >= w["_lo"]) & (t <= w["_hi"])),
        F.lit(False))
    disjoint = _disjoint(_widened(windows, grace))
    begun = flows.filter(t.isNotNull() & ~F.isnan(t))
    found = begun.withColumns({"in_attack": F.lit(False), "in_benign": F.lit(False)})
    long = F.col("_hi") - F.col("_lo") >= DAY
    for width, part in ((fine, disjoint.filter(~long)), (DAY, disjoint.filter(long))):
        bins = begun.select("client_id", _bin(t, width).alias("_bin")).distinct()
        cover = checkpointed(window_cover(part, width).join(bins, ["client_id", "_bin"], "left_semi"))
        found = (
            found.withColumn("_bin", _bin(t, width)).join(if_small(cover), ["client_id", "_bin"], "left")
            .withColumns({"in_attack": F.col("in_attack") | hit(ATTACK), "in_benign": F.col("in_benign") | hit(BENIGN)})
            .select(*flows.columns, "in_attack", "in_benign")
        )
    return found


def ambiguous_bins(flows: DataFrame, windows: DataFrame, grace: float = fv.LABEL_GRACE_SECONDS,
                   factor: float = fv.DENSITY_FACTOR) -> DataFrame:
    """Minute bins far denser than the client's mean that no window explains."""
    width = float(fv.DENSITY_BIN_SECONDS)
    counts = flows.filter(F.col("FlowStartTime").isNotNull() & ~F.isnan("FlowStartTime")).groupBy(
        "client_id", _bin(F.col("FlowStartTime"), width).alias("minute_bin")).agg(F.count("*").alias("flows"))
    means = counts.groupBy("client_id").agg(F.avg("flows").alias("mean_flows"))
    first = _bin(F.col("window_start") - grace, width)
    steps = F.ceil((F.col("window_end") - F.col("window_start") + 2 * grace) / width).cast("bigint")
    per_day = int(DAY / width)
    day = lambda c: F.floor(c / F.lit(float(per_day))).cast("bigint")
    # A window is one row per day, however long it is; the minutes are compared in the join.
    safe = windows.filter(steps > 0).select(
        F.col("client_id").alias("_client"), first.alias("_first"), (first + steps - 1).alias("_last")).select(
        "_client", "_first", "_last", F.explode(F.sequence(day(F.col("_first")), day(F.col("_last")))).alias("_day")).distinct()
    explained = (F.col("client_id") == F.col("_client")) & (day(F.col("minute_bin")) == F.col("_day")) & F.col("minute_bin").between(
        F.col("_first"), F.col("_last"))
    return (
        counts.join(means, "client_id").filter(F.col("flows") >= factor * F.col("mean_flows"))
        .join(safe, explained, "left_anti")
    )


def labelled(flows: DataFrame, windows: DataFrame, grace: float = fv.LABEL_GRACE_SECONDS,
             factor: float = fv.DENSITY_FACTOR) -> DataFrame:
    """Flows with ``y`` (0 attack, 1 benign); flows of ambiguous bursts are left out."""
    burst = if_small(checkpointed(ambiguous_bins(flows, windows, grace, factor).select("client_id", "minute_bin")))
    attack = F.col("in_attack") & ~F.col("in_benign")
    return (
        windows_hit(flows, windows, grace)
        .withColumn("minute_bin", _bin(F.col("FlowStartTime"), fv.DENSITY_BIN_SECONDS))
        .join(burst, ["client_id", "minute_bin"], "left_anti")
        .withColumn("y", F.when(attack, fv.LABEL_ATTACK).otherwise(fv.LABEL_BENIGN))
        .drop("minute_bin", "in_attack", "in_benign")
    )


# --- samples ----------------------------------------------------------------------

def trainable_clients(rows: DataFrame, minimum: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """Clients with enough flows of each class."""
    return rows.groupBy("client_id").agg(
        F.count_if(F.col("y") == fv.LABEL_ATTACK).alias("n_attack"),
        F.count_if(F.col("y") == fv.LABEL_BENIGN).alias("n_benign"),
    ).filter((F.col("n_attack") >= minimum) & (F.col("n_benign") >= minimum))


def draw(row_id: str, seed: int = 0) -> Column:
    """Reproducible pseudo-random text per row, uniform over hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def with_holdout(rows: DataFrame, row_id: str, fraction: float = fv.HOLDOUT_FRACTION, seed: int = 0) -> DataFrame:
    """Add ``is_holdout``; the draw is independent of the class, so it is stratified."""
    limit = format(int(fraction * 16**8), "08x")
    return rows.withColumn("is_holdout", F.substring(draw(row_id, seed), 1, 8) < limit)


def balanced(rows: DataFrame, row_id: str, seed: int = 1, max_rows_per_class: int | None = None) -> DataFrame:
    """As many rows of each class as the client's rarer class has, drawn at random.

    ``max_rows_per_class`` bounds a training sample; without it no row of the sample is left
    out. The last draw of a class is found by counting per draw prefix and ranking the one prefix
    that the limit falls into. It is one narrow row a class, so the sample itself is a filter: no
    client is sorted as a whole, and no row is moved if the last draws are few.
    """
    place, of_class = F.struct("_draw", row_id), ["client_id", "y"]
    drawn = rows.withColumn("_draw", draw(row_id, seed)).withColumn("_prefix", F.substring("_draw", 1, 4))
    counts = checkpointed(drawn.groupBy(*of_class, "_prefix").agg(F.count("*").alias("_n")))
    of = lambda label: F.sum(F.when(F.col("y") == label, F.col("_n")).otherwise(0))
    bound = [] if max_rows_per_class is None else [F.lit(max_rows_per_class)]
    sizes = counts.groupBy("client_id").agg(F.least(of(fv.LABEL_ATTACK), of(fv.LABEL_BENIGN), *bound).alias("_k"))
    upto = Window.partitionBy(*of_class).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_k") - F.coalesce(F.sum("_n").over(upto), F.lit(0))
    edges = counts.join(sizes, "client_id").withColumn("_room", room).filter("_room > 0").groupBy(*of_class).agg(
        F.max(F.struct("_prefix", "_room")).alias("_edge"))
    at_edge = drawn.join(if_small(checkpointed(edges)), of_class).filter("_prefix = _edge._prefix")
    ranked = at_edge.select(*of_class, place.alias("_last"), F.col("_edge._room").alias("_room")).withColumn(
        "_rank", F.rank().over(Window.partitionBy(*of_class).orderBy("_last")))
    last = checkpointed(ranked.filter("_rank <= _room").groupBy(*of_class).agg(
        F.max("_last").alias("_last"), F.max("_rank").alias("_rank"), F.max("_room").alias("_room"), F.count("*").alias("_n")))
    placed = drawn.join(if_small(last), of_class)
    if last.filter("_n > _room").isEmpty():
        return placed.filter(place <= F.col("_last")).select(*rows.columns)
    # Rows share the id of the last draw, so they fill what room it leaves.
    shared = placed.filter(place == F.col("_last")).withColumn(
        "_number", F.row_number().over(Window.partitionBy(*of_class).orderBy("_draw"))).filter("_number <= _room - _rank + 1")
    return placed.filter(place < F.col("_last")).select(*rows.columns).union(shared.select(*rows.columns))


def written(rows: DataFrame) -> DataFrame:
    """Rows with a vector ``x`` by way of a table that has each of its numbers as a column of its own.

    A column of one feature packs several times closer than vectors, and steps that do not read
    ``x`` do not read its columns.
    """
    rest, width = [c for c in rows.columns if c != "x"], len(fv.MODEL_FEATURES)
    table = checkpointed(rows.select(*rest, *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)]))
    return table.select(*rest, F.array(*[f"x{i}" for i in range(width)]).alias("x"))


# --- evaluation -------------------------------------------------------------------

def evaluation(rows: DataFrame, predicted: str = "predicted", by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Recall, false-positive rate and class sizes; NaN for a class without rows."""
    said_attack = F.col(predicted) == fv.LABEL_ATTACK
    rate = lambda label: or_nan(F.avg(F.when(F.col("y") == label, said_attack.cast("int"))))
    return rows.groupBy(*by).agg(
        rate(fv.LABEL_ATTACK).alias("recall"), rate(fv.LABEL_BENIGN).alias("fp_rate"),
        F.count_if(F.col("y") == fv.LABEL_ATTACK).alias("n_attack"),
        F.count_if(F.col("y") == fv.LABEL_BENIGN).alias("n_benign"))


def predicted_class() -> Column:
    """Class decision at one half, not at the alert threshold."""
    return F.when(F.col("p_attack") >= 0.5, fv.LABEL_ATTACK).otherwise(fv.LABEL_BENIGN)


def improved(before: DataFrame, after: DataFrame, fp_tolerance: float = 0.0,
             recall_tolerance: float = fv.RECALL_TOLERANCE) -> DataFrame:
    """Clients with ``adopt``: no more false positives and no material loss of recall."""
    old = before.select("client_id", F.col("recall").alias("recall_before"), F.col("fp_rate").alias("fp_before"))
    new = after.select("client_id", F.col("recall").alias("recall_after"), F.col("fp_rate").alias("fp_after"))
    finite = lambda name: F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))
    at_most = F.col("fp_after") <= F.col("fp_before") + fp_tolerance
    at_least = F.col("recall_after") >= F.col("recall_before") - recall_tolerance
    # A NaN on the "before" side compares false.
    known = ~F.isnan("fp_before") & ~F.isnan("recall_before")
    return old.join(new, "client_id").withColumn(
        "adopt", finite("fp_after") & finite("recall_after") & known & at_most & at_least)


# --- local training ---------------------------------------------------------------

LAYER_TYPE = "array<struct<values: array<double>, rows: int, cols: int>>"
STATE = "client_id string, n bigint, weights array<double>"
LEARNING_RATE, BATCH_ROWS = 0.001, 200


def flat_weights(model: Model) -> np.ndarray:
    return np.concatenate([a.ravel() for a in (*model.coefs, *model.intercepts)])


def with_weights(model: Model, flat: np.ndarray) -> Model:
    parts, at = [], 0
    for a in (*model.coefs, *model.intercepts):
        parts.append(np.asarray(flat[at:at + a.size], dtype=np.float64).reshape(a.shape))
        at += a.size
    k = len(model.coefs)
    return Model(parts[:k], parts[k:], model.mean, model.scale, model.activation, model.classes)


def _train(model: Model, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> Model:
    """Mini-batch Adam on log loss with ReLU hidden layers."""
    weights = [a.copy() for a in (*model.coefs, *model.intercepts)]
    k = len(model.coefs)
    first, second = [np.zeros_like(a) for a in weights], [np.zeros_like(a) for a in weights]
    step = 0
    x = (x - model.mean) / model.scale
    for _ in range(epochs):
        shuffled = rng.permutation(len(y))
        for start in range(0, len(y), BATCH_ROWS):
            rows = shuffled[start:start + BATCH_ROWS]
            layers = [x[rows]]
            for i in range(k):
                z = layers[-1] @ weights[i] + weights[k + i]
                layers.append(np.maximum(z, 0) if i < k - 1 else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            delta = (layers[-1] - y[rows, None]) / len(rows)
            gradients = [None] * (2 * k)
            for i in reversed(range(k)):
                gradients[i], gradients[k + i] = layers[i].T @ delta, delta.sum(axis=0)
                if i:
                    delta = (delta @ weights[i].T) * (layers[i] > 0)
            step += 1
            for j, g in enumerate(gradients):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                rate = LEARNING_RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[j] -= rate * first[j] / (np.sqrt(second[j]) + 1e-8)
    return Model(weights[:k], weights[k:], model.mean, model.scale, model.activation, model.classes)


def fine_tune(
    sample: DataFrame, model: Model, row_id: str, epochs: int = fv.FINE_TUNE_EPOCHS,
    features: tuple[str, ...] = fv.MODEL_FEATURES, seed: int = 0,
) -> DataFrame:
    """One model per client, warm-started, the scaler left as it is.

    Every client trains in one task on its whole sample; ``max_rows_per_class`` of ``balanced``
    bounds that. ``sample`` has the prepared features in ``x``. Returns client, rows and flat weights.
    """
    model = model.validated(features)

    def tuned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        after = _train(model, np.stack(pdf["x"]), pdf["y"].to_numpy(float), epochs, np.random.default_rng(seed))
        return pd.DataFrame({"client_id": [pdf["client_id"].iloc[0]], "n": [len(pdf)], "weights": [flat_weights(after)]})

    return sample.select("client_id", row_id, "y", "x").groupBy("client_id").applyInPandas(tuned, STATE)


def scored_by_client(rows: DataFrame, models: DataFrame, model: Model, row_id: str) -> DataFrame:
    """Score each client's rows with its own weights: client, row id, ``y``, ``p_attack``.

    The weights come along as one array per row of a batch; batches of rows, not clients, are held.
    """
    width = len(model.mean)

    @F.arrow_udf("double")
    def probability(client: pa.Array, x: pa.Array, weights: pa.Array) -> pa.Array:
        vectors = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        names = client.to_numpy(zero_copy_only=False)
        out = np.empty(len(names))
        for name in set(names):
            at = np.flatnonzero(names == name)
            out[at] = with_weights(model, np.asarray(weights[int(at[0])].as_py())).attack_probability(vectors[at])
        return pa.array(out)

    own = rows.select("client_id", row_id, "y", "x").join(models.select("client_id", "weights"), "client_id")
    return own.select("client_id", row_id, "y", probability("client_id", "x", "weights").alias("p_attack"))


# --- federated round --------------------------------------------------------------

def accepted_updates(updates: DataFrame, models: DataFrame) -> DataFrame:
    """Updates that are not stale and of a plausible size."""
    rounds = models.groupBy("track").agg(F.max("round").alias("current_round"))
    current = F.coalesce("current_round", F.lit(0))
    return (
        updates.join(rounds, "track", "left").withColumn("current_round", current)
        .filter(F.col("base_round") >= F.col("current_round") - fv.MAX_STALE_ROUNDS)
        .filter((F.col("sample_count") > 0) & (F.col("sample_count") <= fv.MAX_UPDATE_SAMPLES))
    )


def latest_per_client(updates: DataFrame) -> DataFrame:
    """Option: let every client count once, with its newest update."""
    newest = F.max_by(F.struct(*updates.columns), "received_at").alias("u")
    return updates.groupBy("track", "client_id").agg(newest).select("u.*")


def _parts(updates: DataFrame) -> DataFrame:
    """One row per update and weight: part, layer, position, value."""
    vector = lambda name: F.struct(
        F.lit(name).alias("part"), F.lit(0).alias("layer"), F.size(name).alias("rows"), F.lit(0).alias("cols"),
        F.col(name).alias("values"))
    layers = lambda name: F.transform(name, lambda w, i: F.struct(
        F.lit(name).alias("part"), i.alias("layer"), w["rows"].alias("rows"), w["cols"].alias("cols"),
        w["values"].alias("values")))
    scalers = F.filter(F.array(vector("scaler_mean"), vector("scaler_scale")), lambda p: F.size(p["values"]) > 0)
    return updates.select(
        "track", "sample_count", F.explode(F.concat(layers("coefs"), layers("intercepts"), scalers)).alias("p")
    ).select("track", "sample_count", "p.part", "p.layer", "p.rows", "p.cols", F.posexplode("p.values").alias("at", "w"))


def averaged_weights(updates: DataFrame) -> DataFrame:
    """Mean of every weight, weighted by samples over the updates that carry it."""
    n = F.col("sample_count").cast("double")
    return _parts(updates).groupBy("track", "part", "layer", "at").agg(
        (F.sum(F.col("w") * n) / F.sum(n)).alias("w"), F.max("rows").alias("rows"), F.max("cols").alias("cols"))


def federated_round(updates: DataFrame, models: DataFrame, as_of: float,
                    min_clients: int = fv.MIN_CLIENTS) -> DataFrame:
    """The next model of every track that has enough accepted updates."""
    accepted = accepted_updates(updates, models)
    ready = accepted.groupBy("track").agg(
        F.count("*").cast("int").alias("client_count"), F.max("current_round").alias("current_round")
    ).filter(F.col("client_count") >= min_clients)
    layers = averaged_weights(accepted).groupBy("track", "part", "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda s: s["w"]).alias("values"),
        F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    of = lambda part: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("layer", "values", "rows", "cols")))),
        lambda s: F.struct(s["values"].alias("values"), s["rows"].alias("rows"), s["cols"].alias("cols")))
    flat = lambda part: F.coalesce(
        F.max(F.when(F.col("part") == part, F.col("values"))), F.array().cast("array<double>"))
    assembled = layers.groupBy("track").agg(
        of("coefs").alias("coefs"), of("intercepts").alias("intercepts"),
        flat("scaler_mean").alias("scaler_mean"), flat("scaler_scale").alias("scaler_scale"))
    number = F.col("current_round") + 1
    return ready.join(assembled, "track").select(
        "track", number.alias("round"), F.concat(F.lit("round-"), number.cast("string")).alias("version"),
        "client_count", F.lit(float(as_of)).alias("updated_at"), "coefs", "intercepts", "scaler_mean", "scaler_scale")


def pending_updates(updates: DataFrame, models: DataFrame) -> DataFrame:
    """Updates left after a round: those based on the newest model of their track."""
    rounds = models.groupBy("track").agg(F.max("round").alias("_round"))
    return updates.join(rounds, "track", "left").filter(
        F.col("base_round") >= F.coalesce("_round", F.lit(0))).drop("_round")


def with_seed(models: DataFrame, seeds: DataFrame) -> DataFrame:
    """Add a seed model for tracks that have none."""
    return models.unionByName(seeds.join(models.select("track").distinct(), "track", "left_anti"))


def newest_models(models: DataFrame) -> DataFrame:
    """Append-only model table to one row per track."""
    newest = F.max_by(F.struct(*models.columns), "round").alias("m")
    return models.groupBy("track").agg(newest).select("m.*")


def published(models: DataFrame, track: int) -> DataFrame:
    """Model in exchange form: layers flattened row by row, bias layers with 0 columns."""
    number = lambda w: w["values"].cast("array<float>").alias("values")
    return newest_models(models).filter(F.col("track") == track).select(
        "track", "round", "version", "client_count",
        F.transform("coefs", lambda w: F.struct(number(w), w["rows"].alias("rows"), w["cols"].alias("cols"))).alias("coefs"),
        F.transform("intercepts", lambda w: F.struct(
            number(w), F.size(w["values"]).alias("rows"), F.lit(0).alias("cols"))).alias("intercepts"),
        "scaler_mean", "scaler_scale")


def fingerprint(payload: Column) -> Column:
    """First eight hex digits of SHA-256; empty without a payload."""
    return F.coalesce(F.substring(F.sha2(payload, 256), 1, 8), F.lit(""))


# --- scaler-only adaptation -------------------------------------------------------

def confident_benign(rows: DataFrame, minimum: float = fv.PSEUDO_LABEL_MIN_CONFIDENCE,
                     min_rows: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """Rows the model is sure are benign, for clients that have enough of them."""
    sure = rows.filter(1 - F.col("p_attack") >= minimum)
    enough = sure.groupBy("client_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    return sure.join(enough.select("client_id"), "client_id", "left_semi")


def scaler_refit(rows: DataFrame, features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Mean and population deviation per client and feature; a deviation of 0 becomes 1."""
    figures = rows.groupBy("client_id").agg(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.avg(F.col("x")[i]).alias("mean"),
                 F.stddev_pop(F.col("x")[i]).alias("deviation")).alias(f"s{i}")
        for i, f in enumerate(features)])
    one = lambda s: s.withField("deviation", F.when(s["deviation"] == 0, 1.0).otherwise(s["deviation"]))
    return figures.select("client_id", F.inline(F.transform(
        F.array(*[F.col(f"s{i}") for i in range(len(features))]), one))).withColumnRenamed("deviation", "scale")


def benign_log_loss(rows: DataFrame, p_attack: str = "p_attack") -> DataFrame:
    """Mean log loss per client when every row is benign; probabilities clipped."""
    eps = float(np.finfo(np.float64).eps)
    p = F.greatest(F.least(1 - F.col(p_attack), F.lit(1 - eps)), F.lit(eps))
    return rows.groupBy("client_id").agg(F.avg(-F.log(p)).alias("log_loss"), F.count("*").alias("n"))


def refit_log_loss(rows: DataFrame, model: Model, scalers: DataFrame,
                   features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Log loss of the frozen network under each client's refit scaler."""
    stored = scalers.groupBy("client_id").agg(F.array_sort(F.collect_list(
        F.struct("position", "mean", "scale"))).alias("s"))
    # Express the new scaling in terms of the stored one, which the scorer applies.
    mapped = F.array(*[
        (F.col("x")[i] - F.col("s")[i]["mean"]) / F.col("s")[i]["scale"] * float(model.scale[i]) + float(model.mean[i])
        for i in range(len(features))])
    rescaled = rows.drop("p_attack").join(stored, "client_id").withColumn("x", mapped)
    return benign_log_loss(scored(rescaled, model, features))
