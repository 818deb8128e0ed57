"""Labels against brute force, sharded training, federated rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import network
from nightwarden import fixed_values as fv
from nightwarden.plans import learning
from nightwarden.plans.network_detection import Model

WINDOWS = "client_id string, window_start double, window_end double, label string"


@pytest.mark.parametrize("grace", [0, 5, 30])
def test_labels_match_brute_force(spark, grace):
    rng = random.Random(grace)
    flows = [(i, rng.choice("ab"), rng.choice([rng.uniform(0, 4000), rng.uniform(600, 660)])) for i in range(600)]
    windows = [(rng.choice("ab"), lo, lo + rng.choice([-3, 0, 7, 200]), rng.choice(["ATTACK", "BENIGN"]))
               for lo in (rng.uniform(0, 4000) for _ in range(14))]
    windows.append(("a", 500.0, 500.0 + 2 * grace, "ATTACK"))
    fl = spark.createDataFrame(flows, "flow_no long, client_id string, FlowStartTime double")
    wi = spark.createDataFrame(windows, WINDOWS)
    got = {r.flow_no: r.y for r in learning.labelled(fl, wi, grace, 3).collect()}
    expected = {}
    for client in "ab":
        mine = [f for f in flows if f[1] == client]
        bins = {}
        for _, _, t in mine:
            bins[int(t // 60)] = bins.get(int(t // 60), 0) + 1
        mean = sum(bins.values()) / len(bins)
        safe = {int(x // 60) for c, lo, hi, _ in windows if c == client for x in np.arange(lo - grace, hi + grace, 60)}
        for no, _, t in mine:
            if bins[int(t // 60)] >= 3 * mean and int(t // 60) not in safe:
                continue
            hit = {lab for c, lo, hi, lab in windows if c == client and lo - grace <= t <= hi + grace}
            expected[no] = 0 if "ATTACK" in hit and "BENIGN" not in hit else 1
    assert got == expected and len(got) < len(flows)


def small_model():
    rng = np.random.default_rng(1)
    return Model([rng.normal(size=(2, 4)) / 2, rng.normal(size=(4, 1)) / 2], [np.zeros(4), np.zeros(1)], np.zeros(2), np.ones(2))


def training_rows(spark, n=1200):
    rng = np.random.default_rng(2)
    data = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        data.append((i, "ab"[i % 2], y, [float(v) for v in rng.normal(loc=2.0 * (y - 0.5), size=2)]))
    return spark.createDataFrame(data, "row_no long, client_id string, y int, x array<double>")


def test_fine_tune_learns(spark):
    features = ("f", "g")
    rows = learning.with_holdout(training_rows(spark), "row_no")
    sample = learning.balanced(rows.filter("not is_holdout"), "row_no")
    sizes = {(r.client_id, r.y): r["count"] for r in sample.groupBy("client_id", "y").count().collect()}
    assert sizes["a", 0] == sizes["a", 1] and sizes["b", 0] == sizes["b", 1]
    trained = learning.fine_tune(sample, small_model(), "row_no", 25, features).cache()
    assert {(r.client_id, r.n) for r in trained.collect()} == {("a", 2 * sizes["a", 0]), ("b", 2 * sizes["b", 0])}
    holdout = rows.filter("is_holdout")
    start = spark.createDataFrame([(c, 1, learning.flat_weights(small_model()).tolist()) for c in "ab"], learning.STATE)

    def loss(models):
        scored = learning.scored_by_client(holdout, models, small_model(), "row_no")
        right = F.when(F.col("y") == fv.LABEL_ATTACK, F.col("p_attack")).otherwise(1 - F.col("p_attack"))
        return {r.client_id: r.l for r in scored.groupBy("client_id").agg(F.avg(-F.log(right)).alias("l")).collect()}

    before, after = loss(start), loss(trained)
    assert all(after[c] < before[c] for c in "ab")


def test_window_of_ten_years(spark):
    windows = spark.createDataFrame([("a", 0.0, 3.2e8, "ATTACK"), ("a", 100.0, 130.0, "BENIGN"), ("b", 5.0, 6.0, "ATTACK")],
                                    "client_id string, window_start double, window_end double, label string")
    flows = spark.createDataFrame([("a", 110.0), ("a", 3.1e8), ("a", 3.3e8), ("b", 1e8), ("b", 5.5)], "client_id string, FlowStartTime double")
    for grace in (0, 30):
        hits = {(r.client_id, r.FlowStartTime): (r.in_attack, r.in_benign) for r in learning.windows_hit(flows, windows, grace).collect()}
        assert hits == {("a", 110.0): (True, True), ("a", 3.1e8): (True, False), ("a", 3.3e8): (False, False), ("b", 1e8): (False, False),
                        ("b", 5.5): (True, False)}
    dense = spark.createDataFrame([("a", 3.1e8 + i / 10) for i in range(30)] + [("a", 4e8 + i / 10) for i in range(30)] + [("a", 5e8 + 60 * i) for i in range(40)],
                                  "client_id string, FlowStartTime double")
    assert [r.minute_bin for r in learning.ambiguous_bins(dense, windows, 30).collect()] == [int(4e8 // 60)]


def test_balanced_bound(spark):
    rows = training_rows(spark)
    bounded = learning.balanced(rows, "row_no", max_rows_per_class=7)
    assert {r["count"] for r in bounded.groupBy("client_id", "y").count().collect()} == {7}
    everything = {r.row_no for r in learning.balanced(rows, "row_no").collect()}
    assert {r.row_no for r in bounded.collect()} < everything


def test_balanced_takes_all_of_the_rarer_class(spark):
    n = fv.MAX_ROWS_PER_CLASS + 10_000
    rows = spark.range(2 * n + 500).select(
        F.col("id").alias("row_no"), F.lit("a").alias("client_id"), F.when(F.col("id") < n, 0).otherwise(1).alias("y"))
    sizes = {r.y: r["count"] for r in learning.balanced(rows, "row_no").groupBy("y").count().collect()}
    assert sizes == {0: n, 1: n}


def moves_rows(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return "hashpartitioning" in plan or "Window" in plan


def test_labels_and_samples_leave_rows_where_they_are(spark):
    """Wide rows meet a few windows, bursts and last draws; nothing but those is shuffled."""
    rows = training_rows(spark)
    assert not moves_rows(learning.balanced(rows, "row_no"))
    flows = rows.withColumn("FlowStartTime", F.col("row_no").cast("double"))
    windows = spark.createDataFrame([("a", 10.0, 20.0, "ATTACK"), ("b", 5.0, 900.0, "BENIGN")], WINDOWS)
    assert not moves_rows(learning.labelled(flows, windows))


def test_balanced_counts_rows_that_share_an_id(spark):
    rows = spark.range(300).select(
        F.lit(7).alias("row_no"), F.lit("a").alias("client_id"), F.when(F.col("id") < 100, 0).otherwise(1).alias("y"))
    assert {r.y: r["count"] for r in learning.balanced(rows, "row_no").groupBy("y").count().collect()} == {0: 100, 1: 100}


def test_gate(spark):
    schema = "client_id string, recall double, fp_rate double"
    before = spark.createDataFrame([(c, 0.9, 0.1) for c in "abcd"], schema)
    after = spark.createDataFrame([("a", 0.88, 0.1), ("b", 0.87, 0.0), ("c", 0.99, 0.11), ("d", float("nan"), 0.0)], schema)
    assert {r.client_id: r.adopt for r in learning.improved(before, after).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_federated_round(spark):
    layer = lambda *v: [(list(v), 1, len(v))]
    updates = spark.createDataFrame([
        (1.0, "a", 2, 10, 3, 0.0, layer(1.0, 2.0), layer(1.0), [4.0], []),
        (2.0, "b", 2, 30, 4, 0.0, layer(5.0, 6.0), layer(3.0), [], []),
        (3.0, "c", 2, 99, 2, 0.0, layer(9.0, 9.0), layer(9.0), [], []),   # stale
        (4.0, "d", 2, 0, 4, 0.0, layer(9.0, 9.0), layer(9.0), [], []),    # no samples
        (5.0, "e", 2, 100_001, 4, 0.0, layer(9.0, 9.0), layer(9.0), [], []),
        (6.0, "f", 1, 5, 0, 0.0, layer(7.0, 7.0), layer(7.0), [], []),
    ], "received_at double, client_id string, track int, sample_count int, base_round int, local_loss double, "
       f"coefs {learning.LAYER_TYPE}, intercepts {learning.LAYER_TYPE}, scaler_mean array<double>, scaler_scale array<double>")
    models = spark.createDataFrame([(2, 4)], "track int, round int")
    got = {r.track: r for r in learning.federated_round(updates, models, 1.0).collect()}
    assert got[2].round == 5 and got[2].version == "round-5" and got[2].client_count == 2
    assert got[2].coefs[0]["values"] == pytest.approx([4.0, 5.0]) and got[2].intercepts[0]["values"] == pytest.approx([2.5])
    assert got[2].scaler_mean == [4.0] and got[2].scaler_scale == [] and got[1].round == 1
    assert learning.federated_round(updates, models, 1.0, min_clients=3).count() == 0


def test_steps_match_a_replay(spark):
    """Blocks of a few rows, clients of very different sizes, three steps, against plain numpy."""
    from nightwarden.plans import training

    rng, model = np.random.default_rng(2), network.model()
    rows = [(f"c{i % 7 % 3}", i, rng.normal(size=38).tolist(), int(rng.integers(2))) for i in range(400)] + [("one", 999, [0.5] * 38, 1)]
    df = spark.createDataFrame(rows, "client_id string, flow_no long, x array<double>, y int")
    held = training.blocks(df, "flow_no", rows=16)
    assert held.count() > 20
    state = training.first_weights(held, model)
    for _ in range(3):
        state = training.fine_tune_step(held, state, model, rate=0.2).cache()
    got = {r.client_id: (r.n, r.loss, np.array(r.weights)) for r in state.collect()}
    for client in ("c0", "c1", "c2", "one"):
        x = np.array([r[2] for r in rows if r[0] == client])
        y = np.array([r[3] for r in rows if r[0] == client], float)
        own = model
        for _ in range(3):
            step, loss = training.gradient(own, x, y)
            own = learning.with_weights(own, learning.flat_weights(own) - 0.2 * step / len(y))
        assert got[client][0] == len(y) and np.isclose(got[client][1], loss / len(y)) and np.allclose(got[client][2], learning.flat_weights(own))
    # The gradient itself, by differences.
    x, y, flat = x[:1], y[:1], learning.flat_weights(model)
    exact = training.gradient(model, x, y)[0]
    for at in (0, 7, 150, 304, 311, 312, 320):
        up, down = flat.copy(), flat.copy()
        up[at], down[at] = up[at] + 1e-6, down[at] - 1e-6
        slope = (training.gradient(learning.with_weights(model, up), x, y)[1] - training.gradient(learning.with_weights(model, down), x, y)[1]) / 2e-6
        assert abs(slope - exact[at]) < 1e-4
    assert training.blocks(df.limit(0), "flow_no").count() == 0


def test_blocks_are_bounded_and_lose_no_row(spark):
    from nightwarden.plans import training

    rows = [(f"c{i % 3}", i, [float(i)] * 38, i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "client_id string, flow_no long, x array<double>, y int").repartition(4)
    held = training.blocks(df, "flow_no", rows=16).collect()
    assert max(len(b.ys) for b in held) == 16 and all(len(b.xs) == 38 * len(b.ys) for b in held)
    assert sorted((b.client_id, b.xs[38 * k], y) for b in held for k, y in enumerate(b.ys)) == sorted((c, float(i), float(y)) for c, i, _, y in rows)
