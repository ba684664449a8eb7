"""Form fields assigned to template boxes at the least total cost, page by page.

Every page is its own problem: its boxes and fields meet in one task, as a stream of pages, and no row per pair is ever written. Each
box in turn looks for the cheapest chain of moves that frees a field for it (a shortest path over costs reduced by prices), so pages of
n boxes and m fields take n * n * m steps and n * m numbers. A page is bounded by what fits on paper.
"""

from __future__ import annotations

from math import floor, hypot, inf, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import norm_text
from ..session import ship

#: Cost of a pair whose kinds of field don't go together: dearer than any distance on a page.
FOREIGN = 9.0
_EDGES = ("x0", "y0", "x1", "y1")
#: Pairs of boxes and fields of which costs are held at once; a page is taken whole.
PAIRS = 1 << 17


def cheapest(cost: list[list[float]]) -> list[int | None]:
    """The column of each row at the least total cost; of the longer side some are left out (None)."""
    if not cost or not cost[0]:
        return [None] * len(cost)
    rows, cols = len(cost), len(cost[0])
    if rows > cols:
        taken = cheapest([list(c) for c in zip(*cost)])
        out: list[int | None] = [None] * rows
        for c, r in enumerate(taken):
            out[r] = c
        return out
    row_price, col_price = [0] * rows, [0] * cols  # whole costs stay whole, whatever their size
    owner, held = [-1] * cols, [-1] * rows
    for start in range(rows):
        far, came, closed, path = [inf] * cols, [-1] * cols, [False] * cols, []
        row, so_far = start, 0
        while True:
            line, price = cost[row], so_far - row_price[row]
            near, free = inf, -1
            for c in range(cols):
                if closed[c]:
                    continue
                d = price + line[c] - col_price[c]
                if d < far[c]:
                    far[c], came[c] = d, row
                if far[c] < near:
                    near, free = far[c], c
            closed[free], so_far = True, near
            if owner[free] < 0:
                break
            path.append(free)
            row = owner[free]
        row_price[start] += so_far
        for c in path:
            row_price[owner[c]] += so_far - far[c]
            col_price[c] -= so_far - far[c]
        while free >= 0:  # every row on the chain moves to the field it reached
            row = came[free]
            owner[free] = row
            held[row], free = free, held[row]
    return held


def _plain(cost: list[list[int]]) -> list[int] | None:
    """The column of each row where each row has one cheapest column and no two have the same: no other assignment costs as little."""
    out: list[int] = []
    for line in cost:
        low = min(line)
        if line.count(low) > 1 or (c := line.index(low)) in out:
            return None
        out.append(c)
    return out


def first_cheapest(cost: list[list[float]]) -> list[int | None]:
    """`cheapest` with costs summed in whole billionths; of equal totals the one that gives the first row the first column it can, then
    the second row, and so on (a row without one comes last)."""
    return _first_cheapest([[floor(c * 1e9 + 0.5) for c in line] for line in cost])


def _first_cheapest(cost: list[list[int]]) -> list[int | None]:
    if not cost or not cost[0]:
        return [None] * len(cost)
    rows, cols = len(cost), len(cost[0])
    if rows <= cols:
        plain = _plain(cost)
        if plain is not None:
            return plain
    else:
        plain = _plain(list(zip(*cost)))
        if plain is not None:
            out: list[int | None] = [None] * rows
            for c, r in enumerate(plain):
                out[r] = c
            return out
    place = [(cols + 1) ** (rows - 1 - i) for i in range(rows)]
    unit = (cols + 1) ** rows  # more than all places together
    return cheapest([[c * unit + (j - cols) * place[i] for j, c in enumerate(line)] for i, line in enumerate(cost)])


def _kind_costs(kinds: list[str]) -> np.ndarray:
    """What a pair of kinds adds to its cost; not a number where they don't go together."""
    def extra(a: str, b: str) -> float:
        pair = tuple(sorted((a, b)))
        return 0.0 if a == b or pair == ("CheckBox", "Radio") else 0.035 if pair == ("Signature", "Text") else nan

    return np.array([[extra(a, b) for b in kinds] for a in kinds]).reshape(len(kinds), len(kinds))


def _codes(col: pa.Array) -> tuple[np.ndarray, list]:
    coded = col.dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _chosen(rows: pa.Table, first: np.ndarray, tol_x: float, tol_y: float, accept: float):
    """(box rows, field rows, cost, tight) of the assigned pairs of whole pages; first: where each page begins, and the end."""
    field = rows["field"].combine_chunks().to_numpy(zero_copy_only=False)
    boxes, fields = np.flatnonzero(~field), np.flatnonzero(field)
    box_at, field_at = np.searchsorted(boxes, first), np.searchsorted(fields, first)  # of each page
    n, m = np.diff(box_at), np.diff(field_at)
    edge = {e: rows[e].combine_chunks().to_numpy() for e in _EDGES}
    kind, kinds = _codes(rows["ftype"].combine_chunks().fill_null(""))
    name, _ = _codes(rows["name"].combine_chunks())
    has = rows["has_value"].combine_chunks().to_numpy(zero_copy_only=False)
    extra = _kind_costs(kinds)
    upto = np.concatenate([[0], np.cumsum(n * m)])
    page = 0
    while page < len(n):
        end = max(int(np.searchsorted(upto, upto[page] + PAIRS, "right")) - 1, page + 1)
        of = np.repeat(np.arange(page, end), n[page:end])  # the page of each box
        box = boxes[box_at[page] : box_at[end]]
        s = np.repeat(box, m[of])
        w = fields[np.repeat(field_at[of], m[of]) + np.arange(len(s)) - np.repeat(np.cumsum(m[of]) - m[of], m[of])]
        gap = {e: np.abs(edge[e][s] - edge[e][w]) for e in _EDGES}
        dx, dy = (((edge[lo][s] + edge[hi][s]) / 2 - (edge[lo][w] + edge[hi][w]) / 2).tolist() for lo, hi in (("x0", "x1"), ("y0", "y1")))
        sizes = [np.abs((edge[hi][s] - edge[lo][s]) - (edge[hi][w] - edge[lo][w])) for lo, hi in (("x0", "x1"), ("y0", "y1"))]
        away = np.fromiter(map(hypot, dx, dy), float, len(s)) + 0.35 * (sizes[0] + sizes[1])
        more = extra[kind[s], kind[w]]
        fits = ~np.isnan(more)
        tight = fits & (np.maximum(gap["x0"], gap["x1"]) <= tol_x) & (np.maximum(gap["y0"], gap["y1"]) <= tol_y)
        cost = np.where(tight, 0.1 * away, 0.01 + away) + more - 0.02 * (name[s] == name[w]) - 0.03 * has[w]
        cost = np.where(fits, cost, FOREIGN)
        whole = [floor(c) for c in (cost * 1e9 + 0.5).tolist()]
        got, at = [], 0
        for p in range(page, end):
            k, width = int(n[p]), int(m[p])
            if k and width:
                for i, j in enumerate(_first_cheapest([whole[at + i * width : at + (i + 1) * width] for i in range(k)])):
                    if j is not None:
                        got.append(at + i * width + j)
                at += k * width
        got = np.array(got, np.int64)
        got = got[cost[got] <= accept]
        yield s[got], w[got], cost[got], tight[got]
        page = end


def assign_widgets(slots: DataFrame, widgets: DataFrame, tol_x: float, tol_y: float) -> DataFrame:
    """(page, slot, widget, cost, tight): the assignment of least total cost over all boxes and fields of a page, of which pairs
    dearer than the accepted cost are then left out. Of equal totals `first_cheapest` says which.

    slots: page, slot, ftype, name, x0..y1; widgets: page, widget, ftype, name, has_value, x0..y1, in page units of 1. Pages without
    boxes or without fields give no rows; rows with a null edge or null page are left out.
    """
    ship(slots.sparkSession)
    edges = [F.col(e).cast("double").alias(e) for e in _EDGES]
    common = ["page", "ftype", norm_text("name").alias("name"), *edges]
    both = slots.select(*common, "slot", F.lit(False).alias("has_value")).unionByName(
        widgets.select(*common, "widget", F.coalesce("has_value", F.lit(False)).alias("has_value")), True
    ).dropna(subset=["page", *_EDGES]).withColumn("field", F.col("widget").isNotNull())
    kinds = dict(both.dtypes)
    accept = V.WIDGET_ACCEPT

    def run(batches):
        rest = None  # of a page that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            page, _ = _codes(rows["page"].combine_chunks())
            first = np.concatenate([[0], np.flatnonzero(page[1:] != page[:-1]) + 1])
            rest = rows.slice(int(first[-1]))
            if len(first) > 1:
                yield from assigned(rows.slice(0, int(first[-1])), first)
        if rest is not None:
            yield from assigned(rest, np.array([0, rest.num_rows]))

    def assigned(rows, first):
        for box, field, cost, tight in _chosen(rows, first, tol_x, tol_y, accept):
            if len(box):
                ids = [rows[c].combine_chunks().take(pa.array(at)) for c, at in (("page", box), ("slot", box), ("widget", field))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(cost), pa.array(tight)], names=["page", "slot", "widget", "cost", "tight"])

    ordered = both.repartition("page").sortWithinPartitions("page", "slot", "widget", *_EDGES, "ftype", "name", "has_value")
    return ordered.mapInArrow(run, f"page {kinds['page']}, slot {kinds['slot']}, widget {kinds['widget']}, cost double, tight boolean")
