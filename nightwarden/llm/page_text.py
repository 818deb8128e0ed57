"""Main text of web pages: markup first, then differencing against the nearest URL.

Pages of a host stand in order of their URL path, so a page's neighbours are the pages with the
most similar path, which come from the same template. The text lines (blocks) of a page are
aligned with those of both neighbours by their longest common subsequence. What they share was
not written for the page and is deleted. Three rules keep the deletion right:

* Markup that names its purpose is ruled out before (menus, forms, adverts, comments and so on,
  see `page_blocks`), and text outside an <article> goes where a page has one.
* Inside an <article>, paragraphs, headings and list items stay although a neighbour has them
  too: passages recur across articles. Only loose lines ("Share this page") are compared there.
* A neighbour that shares every line, or more than half of the words that are not usual among
  the nearest six pages, is another copy of the same article and says nothing about the
  template; the next page in order stands in for it.

Only digests of lines are paired: 8 bytes a line, no text. Pages are dealt to tasks by ranges of
(host, path), so a host with a third of all pages spreads over many tasks; a page at the edge of
a range meets the last or first pages of the neighbouring ranges, which are a few rows a range.
The lines to delete go back to the pages by a digest of host, path and page.

Defined cases: NULL html is empty and gives an empty text; a NULL url is the host "" with an
empty path; equal pages at equal paths are one page to the pairing and get the same text;
repeated rows and ids give a row each; a page alone on its host keeps all its markup leaves;
unclosed elements, comments and character references read as browsers read them; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden.llm.page_blocks import Block, blocks
from nightwarden.session import BROADCAST_ROWS, checkpointed

#: Pages on either side that may stand in for a copy.
REACH = 3
#: Cells of the alignment whose steps are kept at once; larger pairs are halved.
CELLS = 1 << 26


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host, and the path without query and fragment; both empty for NULL."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#][\s\S]*$", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_replace(bare, r"^[^/]*/?|/$", "")


def _passed(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """Bit-parallel rows of the common-subsequence table: (row before, row after) for each of b."""
    full, where = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        before, row = row, ((row + hit) | (row - hit)) & full
        yield before, row


def _lengths(row: int, n: int) -> np.ndarray:
    """Common-subsequence length of every prefix of a, from the last row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits)]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence with b; memory stays bounded for any lengths."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [*range(low), *range(len(a) - high, len(a))]
    both = set(a[low:len(a) - high]) & set(b[low:len(b) - high])
    places = [i for i in range(low, len(a) - high) if a[i] in both]
    x, y = [a[i] for i in places], [v for v in b[low:len(b) - high] if v in both]
    if not x or not y:
        return ends
    if len(x) * len(y) > CELLS and len(y) > 1:
        half = len(y) // 2
        head = tail = (1 << len(x)) - 1
        for _, head in _passed(x, y[:half]):
            pass
        for _, tail in _passed(x[::-1], y[:half - 1:-1]):
            pass
        cut = int(np.argmax(_lengths(head, len(x)) + _lengths(tail, len(x))[::-1]))
        found = common(x[:cut], y[:half]) + [cut + i for i in common(x[cut:], y[half:])]
    else:
        found, rows = [], [r for _, r in _passed(x, y)]
        i, j = len(x), len(y)
        full = (1 << len(x)) - 1

        def held(row: int, n: int) -> int:
            return n - (row & ((1 << n) - 1)).bit_count()

        while i and j:
            above = rows[j - 2] if j > 1 else full
            if held(above, i) == held(rows[j - 1], i):
                j -= 1
            elif not rows[j - 1] >> (i - 1) & 1 and held(rows[j - 1], i - 1) < held(rows[j - 1], i) and x[i - 1] == y[j - 1]:
                found.append(i - 1)
                i, j = i - 1, j - 1
            else:
                i -= 1
    return sorted(ends + [places[k] for k in found])


def removable(block: Block) -> bool:
    """Whether differencing may delete the block."""
    return not (block.main and block.prose)


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, page1, page2, lines, sizes): digests and word counts of the blocks; negative counts are fixed blocks."""
    for batch in batches:
        found = [blocks(text) for text in batch.column(2).to_pylist()]
        digests = [[xxhash.xxh64_intdigest(b.text) - (1 << 63) for b in page] for page in found]
        sizes = [[len(b.text.split()) * (1 if removable(b) else -1) for b in page] for page in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *batch.columns[3:5], pa.array(digests, pa.list_(pa.int64())),
             pa.array(sizes, pa.list_(pa.int32()))], ["host", "path", "page1", "page2", "lines", "sizes"])


def deleted(own: list[int], sizes: list[int], earlier: list[list[int]], later: list[list[int]]) -> list[int]:
    """Places of the removable lines that the nearest page of either side shares, copies passed over."""
    sides = [[set(common(own, other)) for other in side] for side in (earlier, later)]
    voices = [s for side in sides for s in side if len(s) < len(own)]
    usual = {i for i in range(len(own)) if 2 * sum(i in s for s in voices) >= len(voices)} if len(voices) > 2 else set()
    rest = sum(abs(n) for i, n in enumerate(sizes) if i not in usual)
    gone: set[int] = set()
    for side in sides:
        for shared in side:
            if len(shared) < len(own) and 2 * sum(abs(sizes[i]) for i in shared - usual) <= rest:
                gone |= shared
                break
    return sorted(i for i in gone if sizes[i] > 0)


def _digests(pages: DataFrame) -> DataFrame:
    """Rows (host, path, html, page1, page2, ...) with 128 bits that name a page at a place."""
    host, path = host_path(F.col("url"))
    named = pages.select(host.alias("host"), path.alias("path"), F.coalesce("html", F.lit("")).alias("html"),
                         F.col("page_id"), F.col("url"))
    return named.select("host", "path", "html", *(F.xxhash64(F.lit(s), "host", "path", "html").alias(f"page{s}") for s in (1, 2)), "page_id", "url")


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page1, page2, gone): places of shared lines, for the pages that have any."""
    read = _digests(pages).select("host", "path", "html", "page1", "page2").mapInArrow(
        lines, "host string, path string, page1 long, page2 long, lines array<long>, sizes array<int>")
    once = read.groupBy("host", "path", "page1", "page2").agg(F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    order = ["host", "path", "page1", "page2"]
    dealt = checkpointed(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    near = F.struct("host", "lines")

    # The first and last pages of every range meet the ranges beside it.
    ranked = dealt.withColumn("up", F.row_number().over(inside)).withColumn(
        "down", F.row_number().over(Window.partitionBy("part").orderBy(*(F.col(c).desc() for c in order))))
    edges = checkpointed(ranked.filter((F.col("up") <= REACH) | (F.col("down") <= REACH)).select("part", *order, "lines"))
    lists = edges.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("n"))
    numbered = edges.join(lists, "part").select("n", *order, "lines")
    before = numbered.select((F.col("n") + 1).alias("n"), *order, "lines")
    after = numbered.select((F.col("n") - 1).alias("n"), *order, "lines")
    guests = before.union(after).join(lists, "n").select(
        *order, "lines", F.lit(None).cast("array<int>").alias("sizes"), "part")
    held = dealt.select(*order, "lines", "sizes", "part").unionByName(guests)
    around = [*(F.lag(near, k).over(inside).alias(f"b{k}") for k in range(1, REACH + 1)),
              *(F.lead(near, k).over(inside).alias(f"a{k}") for k in range(1, REACH + 1))]
    rows = held.select(*order, "lines", "sizes", *around).filter(
        F.col("sizes").isNotNull() & F.exists("sizes", lambda n: n > 0))

    def same(side: str) -> Column:
        mine = F.array(*(F.when(F.col(f"{side}{k}.host") == F.col("host"), F.col(f"{side}{k}.lines")) for k in range(1, REACH + 1)))
        return F.filter(mine, lambda x: x.isNotNull())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [deleted(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            table = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gone, pa.list_(pa.int32()))], ["page1", "page2", "gone"])
            yield table.filter(pa.array([bool(g) for g in gone], pa.bool_()))

    return rows.select("page1", "page2", "lines", "sizes", same("b").alias("earlier"), same("a").alias("later")).mapInArrow(
        align, "page1 long, page2 long, gone array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    gone = checkpointed(shared_lines(pages))
    if (gone.select(F.sum(F.size("gone") + 4).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, out_lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = blocks(text)
                drop = set(out_lines or ())
                page = [b for i, b in enumerate(page) if i not in drop]
                out.append(" ".join(b.text for b in page))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = _digests(pages).join(gone, ["page1", "page2"], "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "gone")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
