"""Field catalogues from layouts: pairing marks, labels, cells and widgets; groups, tables and reading order.

Spatial joins are equi-joins on (page, grid cell): boxes are dealt to every cell they touch, or rows to the bands within reach, so a
page with very many boxes is many small keys. Boxes are structs (x, y, width, height) in pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric, text
from fieldloom.operators import predicates, spatial
from fieldloom.operators.rows import first_wins
from fieldloom.storage import stored

#: Least confidence of a mark's label, and choice words.
PAIRING, CHOICE, CHOICE_ONLY = 0.58, r"\b(yes|no|include|exclude|true|false|selected|unselected|checkbox|indicator|option)\b", r"^(yes|no|include|exclude|selected|unselected)$"
#: Pixels of a grid cell, the least where cells follow the boxes, and the mean boxes that lie beside each other in one of these.
CELL, LEAST_CELL, CELL_BOXES = 128.0, 16.0, 8


def reading_order(df: DataFrame, doc: str, page: str, box: str, key: str, name: str = "ordinal") -> DataFrame:
    """Adds the place in reading order of a document: page, then y, then x, then key."""
    order = [F.col(page), F.col(f"{box}.y"), F.col(f"{box}.x"), F.col(key)]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def cells_of(box: Column, size: float | tuple[float, float] = CELL) -> Column:
    """The (column, row) cells that a box touches; ``size`` is a cell's, or its width and height."""
    wide, high = size if isinstance(size, tuple) else (size, size)
    span = lambda low, length, step: F.sequence(F.floor(low / step).cast("int"), F.floor((low + F.greatest(length, F.lit(0.0))) / step).cast("int"))
    return F.flatten(F.transform(span(box["x"], box["width"], wide), lambda c: F.transform(span(box["y"], box["height"], high), lambda r: F.struct(c.alias("c"), r.alias("r")))))


def touching(left: DataFrame, right: DataFrame, page: str, size: float | tuple[float, float] = CELL) -> DataFrame:
    """Rows of both tables whose boxes share area on a page, each pair once: in the cell of their shared area's first corner.

    ``left`` has box ``lb``, ``right`` box ``rb``; other column names differ but for ``page``. Neither side is broadcast: its size is guessed from before boxes are
    dealt to cells.
    """
    wide, high = size if isinstance(size, tuple) else (size, size)
    a = left.withColumn("_cell", F.explode(cells_of(F.col("lb"), size)))
    b = right.withColumn("_cell", F.explode(cells_of(F.col("rb"), size)))
    met = a.join(b.hint("merge"), [page, "_cell"]).filter(numeric.shared_area(F.col("lb"), F.col("rb")) > 0)
    corner = lambda p, step: F.floor(F.greatest(F.col(f"lb.{p}"), F.col(f"rb.{p}")) / step).cast("int")
    return met.filter((F.col("_cell.c") == corner("x", wide)) & (F.col("_cell.r") == corner("y", high))).drop("_cell")


def label_cues(value: Column, box: Column) -> Column:
    """What a text adds to the confidence that it is a mark's label, whatever the mark: choice words and a tall or long text speak for it, a header against."""
    n = text.normalise(value)
    tall = (box["height"] >= 34) | ((box["width"] >= 240) & (F.length(value) >= 60))
    return F.struct(
        (F.when(n.rlike(CHOICE), 0.2).otherwise(0.0) + F.when(tall, 0.06).otherwise(0.0) + F.when(n.rlike(predicates.HEADER), -0.22).otherwise(0.0)).alias("words"),
        F.when(n.rlike(CHOICE_ONLY), 0.14).otherwise(0.0).alias("only"),
    )


def pairing_confidence(mark: Column, label: Column, cues: Column) -> Column:
    """How likely a text is a selection mark's label: near in y, to its right, and a choice word (``cues`` of ``label_cues``)."""
    dx, dy = label["x"] - mark["x"], F.abs(label["y"] - mark["y"])
    high, wide = F.greatest(F.lit(16.0), mark["height"] * 2.1), F.greatest(F.lit(160.0), mark["width"] * 22)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    across = F.when(dx >= 0, unit(1 - dx / wide)).otherwise(unit(1 - F.abs(dx) / 80) * 0.55)
    score = F.when(dy <= high, unit(1 - dy / high) * 0.38).otherwise(-0.22) + F.when((dx >= -20) & (dx <= wide), across * 0.24).otherwise(-0.18)
    return unit(score + cues["words"] + cues["only"])


def mark_pairs(marks: DataFrame, labels: DataFrame, page: str) -> DataFrame:
    """page, mark, label, confidence: each mark's label of least cost.

    ``marks``: page, mark, fb; ``labels``: page, label, value, lb. The cost grows with the distance of the middles, so labels are met in rings around
    the mark; without vertical nearness no label is confident enough, which bounds the rings' reach. A text's cues are found once a label, not once a pair.
    """
    held = labels.filter(F.length(F.trim("value")) >= 2).select(page, "label", "lb", label_cues(F.col("value"), F.col("lb")).alias("cues"))
    confidence = F.round(pairing_confidence(F.col("fb"), F.col("lb"), F.col("cues")), 3)
    cost = F.round((1 - confidence) * 100 + numeric.centre_distance(F.col("fb"), F.col("lb")) * 0.08, 9)
    # places are corners in y, as the reach is of corners, and middles in x; middles in y differ from the corners by half of the heights
    high = F.greatest(F.lit(16.0), F.col("fb.height") * 2.1)
    x = lambda box: F.col(f"{box}.x") + F.col(f"{box}.width") / 2
    found = spatial.k_nearest(
        marks.select(page, "mark", "fb"), held, [page], "mark", "label", F.when(confidence >= PAIRING, cost),
        query_at=(x("fb"), F.col("fb.y")), point_at=(x("lb"), F.col("lb.y")), weights=(0.08, 0.0), reach=(None, high),
    )
    return found.select(page, "mark", "label", confidence.alias("confidence"))


def contained(labels: DataFrame, cells: DataFrame, page: str, least: float = 0.65) -> DataFrame:
    """page, label, cell, share: the cell that holds at least ``least`` of a label's area, the largest intersection first.

    ``labels``: page, label, lb; ``cells``: page, cell, rb.
    """
    both = touching(labels, cells, page).withColumn("_both", numeric.shared_area(F.col("lb"), F.col("rb")))
    both = both.withColumn("share", F.round(F.col("_both") / F.greatest(F.lit(1.0), numeric.area(F.col("lb"))), 6)).filter(F.col("share") >= least)
    return first_wins(both, [page, "label"], [F.col("_both").desc(), F.col("cell")]).select(page, "label", "cell", "share")


def table_context(cells: DataFrame, headers: DataFrame, row_labels: DataFrame, symbols: DataFrame) -> DataFrame:
    """cells (table, row, col, value) with ``header`` of their column, ``row_label`` of their row, and ``symbol`` at most one column away.

    Others: (table, col, ordinal, value), (table, row, ordinal, value), (table, row, col, ordinal, value); the first of a place counts.
    """
    first = lambda df, keys, name: df.groupBy(*keys).agg(F.min_by("value", "ordinal").alias(name))
    near = symbols.withColumn("col", F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1)))
    out = cells.join(first(headers, ["table", "col"], "header"), ["table", "col"], "left")
    out = out.join(first(row_labels, ["table", "row"], "row_label"), ["table", "row"], "left")
    return out.join(first(near, ["table", "row", "col"], "symbol"), ["table", "row", "col"], "left")


def aligned_rows(df: DataFrame, keys: Sequence[str], order: str, anchors: str, within: float = 18.0, share: float = 0.5) -> DataFrame:
    """``aligned``: whether at least ``share`` of a row's x anchors lie ``within`` an anchor of the row before."""
    before = F.lag(anchors).over(Window.partitionBy(*keys).orderBy(order))
    hits = F.size(F.filter(F.col(anchors), lambda x: F.exists(F.col("_before"), lambda b: F.abs(b - x) <= within)))
    out = df.withColumn("_before", before)
    return out.withColumn("aligned", F.coalesce((F.size(anchors) > 0) & (hits >= share * F.size(anchors)), F.lit(False))).drop("_before")


def context_of(blocks: DataFrame, page: str, key: str, k: int) -> DataFrame:
    """page, key, rank, other: the ``k`` nearest blocks of a page by centre, the block itself first."""
    own = blocks.select(page, key, F.lit(1).alias("rank"), F.col(key).alias("other"))
    if k == 1:
        return own
    a = blocks.select(page, key, F.col("box").alias("fb"))
    b = blocks.select(page, F.col(key).alias("other"), F.col("box").alias("lb"))
    apart = F.when(F.col(key) != F.col("other"), F.round(numeric.centre_distance(F.col("fb"), F.col("lb")), 6))
    near = spatial.k_nearest(a, b, [page], key, "other", apart, k - 1)
    return own.unionByName(near.select(page, key, (F.col("rank") + 1).alias("rank"), "other"))


def banded_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], anchor: Column, least: int = 2) -> DataFrame:
    """Rows from an anchor up to the next one: ``band`` (from 1), ``occurrence`` in it; bands under ``least`` rows and rows before the first go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    found = df.withColumn("band", F.count_if(anchor).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("band > 0")
    inside = Window.partitionBy(*keys, "band")
    found = found.withColumns({"occurrence": F.row_number().over(inside.orderBy(*order)), "_n": F.count("*").over(inside)})
    return found.filter(F.col("_n") >= least).drop("_n")


def with_residuals(valid: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``valid`` rows, and the ``fallback`` rows whose key is not among them; ``origin`` tells which."""
    rest = fallback.join(valid.select(*keys).distinct(), list(keys), "left_anti")
    return valid.withColumn("origin", F.lit("valid")).unionByName(rest.withColumn("origin", F.lit("fallback")))


def page_budget(pages: DataFrame, doc: str, page: str, signal: str, keep: int) -> DataFrame:
    """The ``keep`` pages of most signal of each document, with how many others there were (``dropped``)."""
    w = Window.partitionBy(doc)
    ranked = pages.withColumns({"rank": F.row_number().over(w.orderBy(F.col(signal).desc(), page)), "dropped": F.greatest(F.count("*").over(w) - keep, F.lit(0))})
    return ranked.filter(F.col("rank") <= keep)


def capped_samples(df: DataFrame, kind: str, order: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each kind for a report, with ``total``, the number of all: partial sums, and a limit before the ranking."""
    totals = df.groupBy(kind).agg(F.count("*").alias("total"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("rank") <= cap)
    return ranked.join(totals, kind)


def _most_covered(least: float, rows: int = 64) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a cell's boxes and widgets (_n, x, y, width, height): each box's widgets of the greatest share, the first of equal ones, and those that rounding may make equal."""

    def run(boxes: pa.Table, widgets: pa.Table) -> pa.Table:
        read = lambda t: [t.column(c).to_numpy() for c in ("_n", "x", "y", "width", "height")]
        n, x, y, w, h = (v[order] for order in [np.argsort(boxes.column("x").to_numpy(), kind="stable")] for v in read(boxes))
        m, u, v, a, b = (v[order] for order in [np.argsort(widgets.column("x").to_numpy(), kind="stable")] for v in read(widgets))
        wide = a.max(initial=0.0) + 1e-3
        found: list[tuple] = []
        for at in range(0, len(n) if len(m) else 0, rows):
            cut = slice(at, at + rows)
            near = slice(np.searchsorted(u, x[cut].min() - wide), np.searchsorted(u, (x[cut] + w[cut]).max(), "right"))
            if near.start >= near.stop:
                continue
            one = lambda values: values[cut, None]  # noqa: B023, E731
            across = np.minimum(one(x) + one(w), u[near] + a[near]) - np.maximum(one(x), u[near])
            down = np.minimum(one(y) + one(h), v[near] + b[near]) - np.maximum(one(y), v[near])
            smaller = np.minimum(one(w) * one(h), a[near] * b[near])
            both = np.maximum(0.0, across) * np.maximum(0.0, down)
            share = np.where((both > 0) & (smaller > 0), both / np.where(smaller > 0, smaller, 1.0), 0.0)
            top = share.max(axis=1, keepdims=True)
            equal = share == top
            first = np.where(equal, m[near], np.iinfo(np.int64).max).min(axis=1)
            fit = top[:, 0] >= least - 1e-6
            found.append((n[cut][fit], first[fit], top[fit, 0]))
            i, j = np.nonzero(~equal & (share >= top - 2e-6) & (share >= least - 1e-6))
            found.append((n[cut][i], m[near][j], share[i, j]))
        columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3)]
        return pa.table({"_box": pa.array(columns[0].astype("int64")), "_place": pa.array(columns[1].astype("int64")), "share": pa.array(columns[2].astype("float64"))})

    return run


def merge_widgets(catalogue: DataFrame, widgets: DataFrame, page: str, least: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """(catalogue, remap): widgets take the place of the entries they cover by ``least`` of the smaller area.

    ``catalogue``: page, entry, lb, kind; ``widgets``: page, widget, rb, kind2. ``remap``: page, entry, widget, for foreign keys.
    An entry goes to the widget that covers it most; a widget may take several. Boxes that repeat on a page meet once, with the first of their widgets, in cells of
    about the mean box.
    """
    boxes = stored(catalogue.select(page, "lb").distinct().withColumn("_box", F.monotonically_increasing_id()), "entry-boxes")
    held = widgets.groupBy(page, "rb").agg(F.min("widget").alias("widget"))
    held = stored(held.withColumn("_place", F.row_number().over(Window.partitionBy(page).orderBy("widget"))), "widget-boxes")
    mean = boxes.agg(F.avg("lb.width").alias("width"), F.avg("lb.height").alias("height")).first()
    size = CELL_BOXES * max(LEAST_CELL, mean["width"] or CELL), max(LEAST_CELL, mean["height"] or CELL)

    def dealt(df: DataFrame, box: str, number: str) -> DataFrame:
        each = df.select(page, F.col(number).cast("long").alias("_n"), f"{box}.*", F.explode(cells_of(F.col(box), size)).alias("_cell"))
        return each.select(page, "_n", "x", "y", "width", "height", "_cell.c", "_cell.r").groupBy(page, "c", "r")

    met = dealt(boxes, "lb", "_box").cogroup(dealt(held, "rb", "_place")).applyInArrow(_most_covered(least), "_box long, _place long, share double")
    # shares are rounded before they are compared
    shares = met.withColumn("share", F.round("share", 6)).filter(F.col("share") >= least).join(boxes, "_box").join(held.select(page, "_place", "widget"), [page, "_place"])
    best = shares.groupBy(page, "lb").agg(F.min(F.struct((-F.col("share")).alias("share"), "widget")).alias("_best"))
    covered = catalogue.select(page, "entry", "lb").join(best, [page, "lb"])
    remap = covered.groupBy(page, "entry").agg(F.min("_best").alias("_best")).select(page, "entry", "_best.widget")
    kept = catalogue.join(covered.select(page, "entry"), [page, "entry"], "left_anti").select(page, F.col("entry").alias("key"), F.col("lb").alias("box"), "kind", F.lit(False).alias("widget"))
    added = widgets.select(page, F.col("widget").alias("key"), F.col("rb").alias("box"), F.col("kind2").alias("kind"), F.lit(True).alias("widget"))
    return kept.unionByName(added), remap


def seen_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], category: str, code: str) -> DataFrame:
    """``seen``: whether an earlier row of the same category has chosen this row's code."""
    w = Window.partitionBy(*keys, category, code).orderBy(*order)
    return df.withColumn("seen", F.row_number().over(w) > 1)


def page_unit_box(box: Column, width: Column, height: Column) -> Column:
    """A box in 0..1 page coordinates; 0 for a page without size."""
    part = lambda v, full: F.when(full > 0, v / full).otherwise(0.0)
    return numeric.box(part(box["x"], width), part(box["y"], height), part(box["width"], width), part(box["height"], height))


def scroll_offset(page: Column, height: Column, padding: float = 20.0) -> Column:
    """Where a page begins when pages of one height lie below each other with padding."""
    return page * (height + padding)


#: The value type that a field's text calls for, first match first.
VALUE_TYPES = [("date", "date|effective"), ("currency", "premium|amount|deductible"), ("numeric", "number|zip|phone|year")]


def field_catalogue(blocks: DataFrame, cells: DataFrame, page: str, key: str, value: str, box: str, height: float) -> DataFrame:
    """Labels and questions of a page with the table cell that holds them and the type of their value: roles, containment and rules."""
    named = F.when(F.col(f"{box}.y") + F.col(f"{box}.height") >= height * 0.92, "footer").when(F.col(value).rlike(predicates.QUESTION), "question")
    trimmed = F.trim(F.col(value))
    named = named.when((trimmed != "") & (F.length(trimmed) <= 90) & trimmed.rlike(predicates.FILLABLE), "label").otherwise("other")
    rows = blocks.withColumn("role", named).filter(F.col("role").isin("label", "question"))
    labels = rows.filter("role = 'label'").select(page, F.col(key).alias("label"), F.col(box).alias("lb"))
    held = contained(labels, cells, page).select(page, F.col("label").alias(key), "cell")
    kind = predicates.first_rule(F.col(value), VALUE_TYPES, "text")
    return rows.join(held, [page, key], "left").withColumn("value_type", kind)
