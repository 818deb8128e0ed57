"""Greedy anchors against a plain fold, with chunks small enough to matter."""

import random

import pytest

from nightwarden.operators.anchors import anchor_rows


def fold(rows, span, bound_included, use_close, idle):
    out, state, chain, seen = {}, {}, {}, {}
    for key, at, order, close in sorted(rows):
        start = state.get(key)
        if start is None or (idle is not None and at - seen[key] > idle):
            chain[key] = order
        seen[key] = at
        is_open = start is not None and (
            at - start[0] <= span if bound_included else at - start[0] < span
        )
        if not is_open:
            state[key] = start = (at, order)
            out[key, order] = (*start, True, chain[key])
        else:
            out[key, order] = (*start, False, chain[key])
            if use_close and close:
                state[key] = None
    return out


@pytest.mark.parametrize("bound_included", [True, False])
@pytest.mark.parametrize("use_close", [True, False])
@pytest.mark.parametrize("density,idle,slice_rows", [(3, None, 1 << 16), (40, 20, 1 << 16), (3, None, 7), (40, 20, 1)])
def test_matches_fold(spark, bound_included, use_close, density, idle, slice_rows):
    rng = random.Random(density * 4 + bound_included * 2 + use_close)
    rows, order = [], 0
    for key in range(12):
        at = rng.randrange(50)
        for _ in range(120 if key else 1500):
            at += rng.choice([0, 1, 1, 2, 5, density, density, 90 if rng.random() < 0.1 else 3])
            rows.append((f"k{key}", at, order, rng.random() < 0.08))
            order += 1
    df = spark.createDataFrame(rows, "key string, at long, ord long, fin boolean").repartition(5)
    got = {
        (r.key, r.ord): (r.anchor_us, r.anchor_order, r.is_anchor, r.lead_value)
        for r in anchor_rows(df, ["key"], "at", "ord", 20, bound_included=bound_included,
                             closes="fin" if use_close else None, chunk_us=25, lead="ord", idle_us=idle,
                             slice_rows=slice_rows).collect()
    }
    assert got == fold(rows, 20, bound_included, use_close, idle)


@pytest.mark.parametrize("step", [0, 3, 40])
@pytest.mark.parametrize("use_close,idle", [(True, None), (True, 20), (False, None)])
def test_one_key_holds_all_rows(spark, step, use_close, idle):
    """Slices of 1,000 rows of a key whose chunks hold up to all 30,000."""
    rng, rows, at = random.Random(step), [], 5
    for order in range(30_000):
        at += rng.randrange(step + 1) if step else int(order % 6000 == 5999) * 15
        rows.append(("k", at, order, rng.random() < 0.002))
    df = spark.createDataFrame(rows, "key string, at long, ord long, fin boolean").repartition(5)
    got = {
        (r.key, r.ord): (r.anchor_us, r.anchor_order, r.is_anchor, r.lead_value)
        for r in anchor_rows(df, ["key"], "at", "ord", 20, bound_included=True, closes="fin" if use_close else None,
                             chunk_us=100_000, lead="ord", idle_us=idle, slice_rows=1000).collect()
    }
    assert got == fold(rows, 20, True, use_close, idle)


def test_an_end_renews_no_chain_of_another_key(spark):
    """Even keys end with a closing row; odd ones go on in the next chunk, many of them right after an even one."""
    rows = []
    for key in range(60):
        late = 1 if key % 2 == 0 else 30
        rows += [(f"k{key:02}", 0, 2 * key, False), (f"k{key:02}", late, 2 * key + 1, key % 2 == 0)]
    df = spark.createDataFrame(rows, "key string, at long, ord long, fin boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # chunks of a key apart
    try:
        got = {
            (r.key, r.ord): (r.anchor_us, r.anchor_order, r.is_anchor, r.lead_value)
            for r in anchor_rows(df, ["key"], "at", "ord", 20, bound_included=True, closes="fin", chunk_us=25, lead="ord").collect()
        }
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == fold(rows, 20, True, True, None)
