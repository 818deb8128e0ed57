"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints that differ in
three bits or fewer, one segment differs in one bit at most, so with that bit left out the
segments agree. Each distinct fingerprint is indexed under its 64 one-wildcard segment
variants; fingerprints under the same variant are compared in full, and links go to connected
components.

Copies of a text share a fingerprint and are one row of the index. A variant shared by more
than `GROUP` distinct fingerprints is never held in memory: its rows stream through and are
indexed once more under one-wildcard variants of the other segment's halves, where 18 bits
are left free, so no group exceeds 2 ** 18 whatever the size of the corpus. A group gives a
spanning forest of its links, not all pairs. Since one variant is one of 64 of a fingerprint,
a group of a third of all fingerprints is a two-hundredth of the shuffled rows.

Defined cases: NULL and empty texts have fingerprint zero and are linked like any other; rows
that share a doc_id are one document; a NULL doc_id is never a component's smallest unless
there is no other, then the component is NULL; other columns pass through `deduplicated`
whatever their names are; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from nightwarden.llm.components import components
from nightwarden.session import checkpointed

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Distinct fingerprints that are compared pair by pair in one step.
GROUP = 2048
#: Up to this many, pairs are found by shifting the sorted column against itself.
SMALL = 16
SLICE, TEXTS = 1 << 16, 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII space and controls 9 to 13 only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    size = min(SHINGLE, len(found))
    starts = [0, *ends][: len(found) - size + 1]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), SLICE):
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts[k:k + SLICE], ends[size - 1 + k:size - 1 + k + SLICE])]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(k, TEXTS)
            values = np.array([fingerprint(t) for t in rows.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _wildcards(segment: str, base: int) -> Column:
    """Array of keys: base, position of the wildcard, segment without the bit there."""
    return F.expr(f"transform(sequence(0, 31), p -> {base}L | shiftleft(CAST(p AS BIGINT), 32) | ({segment} & ~shiftleft(1L, p)))")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of every fingerprint; keys have 38 bits."""
    both = F.concat(_wildcards("(fp & 4294967295L)", 0), _wildcards("shiftrightunsigned(fp, 32)", 1 << 37))
    return fps.select(F.explode(both).alias("key"), "fp")


def forest(fps: np.ndarray) -> np.ndarray:
    """For sorted distinct fingerprints: the place of the smallest one linked to each, by any chain."""
    n, root = len(fps), np.arange(len(fps))
    if n <= GROUP:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
        while True:
            new = np.where(near, root[None, :], n).min(1)
            new = new[new]
            if (new == root).all():
                return root
            root = new
    free = [int(b) for b in range(64) if len(np.unique((fps >> np.uint64(b)) & np.uint64(1))) > 1]
    masks = [sum(1 << b for b in flips) for k in range(1, MAX_BITS + 1) for flips in combinations(free, k)]
    while True:
        before = root.copy()
        for mask in masks:
            other = fps ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero(fps[at] == other)
            root[hit] = np.minimum(root[hit], root[at[hit]])
        root = root[root]
        if (root == before).all():
            return root


def _refined(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The variants of the other segment's halves, under keys that hold the first key too."""
    other = np.where(key >> 37 & 1, fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)).astype(np.int64)
    keys = [key << 20 | half << 19 | p << 15 | _without(other >> 16 * half & 0xFFFF, p) for half in range(2) for p in range(16)]
    return np.concatenate(keys), np.tile(fp, 32)


def _without(value: np.ndarray, p: int) -> np.ndarray:
    """16-bit values with bit p cut out."""
    return value >> (p + 1) << p | value & ((1 << p) - 1)


def _compare(refine: bool):
    """Batches sorted by key give links (fp, other) and, from large groups, rows (fp, key) to refine."""

    def small(key, fp):
        for shift in range(1, SMALL):
            hit = np.flatnonzero((key[shift:] == key[:-shift]) & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= MAX_BITS))
            yield fp[hit + shift], fp[hit]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def rows(kind, a, b):
            a, b = a.astype(np.uint64).view(np.int64), np.asarray(b).view(np.int64)
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[k:k + 100_000]), kind)), pa.array(a[k:k + 100_000]),
                                                  pa.array(b[k:k + 100_000])], names=["refine", "a", "b"])

        def again(k, f):
            wide, values = _refined(k, f)
            yield from rows(True, values, wide)

        def groups(key, fp):
            """Whole groups only."""
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
            sizes = np.diff(np.r_[starts, len(key)])
            part = np.repeat(sizes <= SMALL, sizes)
            for a, b in small(key[part], fp[part]):
                yield from rows(False, a, b)
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                if refine and n > GROUP:
                    yield from again(key[s:s + n], fp[s:s + n])
                else:
                    root = forest(fp[s:s + n])
                    hit = np.flatnonzero(root != np.arange(n))
                    yield from rows(False, fp[s + hit], fp[s + root[hit]])

        for batch in batches:
            new_key = batch.column(0).to_numpy(zero_copy_only=False)
            new_fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if hot is not None:
                stay = int(np.searchsorted(new_key, hot, "right"))
                if stay:
                    yield from again(new_key[:stay], new_fp[:stay])
                new_key, new_fp = new_key[stay:], new_fp[stay:]
                if not len(new_key):
                    continue
                hot = None
            key, fp = np.r_[key, new_key], np.r_[fp, new_fp]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield from groups(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if refine and len(key) > GROUP:
                yield from again(key, fp)
                hot, key, fp = key[-1], key[:0], fp[:0]
        yield from groups(key, fp)

    return compare


def _compared(keyed: DataFrame, refine: bool) -> DataFrame:
    schema = "refine boolean, a long, b long"
    return checkpointed(keyed.repartition("key").sortWithinPartitions(
        "key", F.expr("fp < 0"), "fp").mapInArrow(_compare(refine), schema).distinct())


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at three differing bits or fewer by chains."""
    first = _compared(variants(fps), True)
    links = first.filter("NOT refine").select("a", "b")
    wide = first.filter("refine").select(F.col("b").alias("key"), F.col("a").alias("fp"))
    if wide.isEmpty():
        return links
    return links.union(_compared(wide, False).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    rows = checkpointed(fingerprints(docs))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(near_links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    groups = groups.union(groups.select("root", "root").distinct())
    smallest = groups.join(classes, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = groups.join(smallest, "root").select("fp", "component_id")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    ids = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("kept_id")).distinct()
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return held.join(ids, F.col("doc.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("doc.*")
