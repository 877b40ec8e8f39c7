"""Operators whose result depends on processing order, one document or page at a time.

Rows are dealt out by page, sorted, and read in order; a page's rows are held together only while it is worked on.
Parallelism comes from the number of pages. ``x, y, width, height`` are columns of the boxes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rows = list[dict]


def _by_page(df: DataFrame, page: str, order: Sequence[Column | str], run: Callable[[Rows], Rows], schema: T.StructType) -> DataFrame:
    """``run`` on the ordered rows of each page, in place of them."""
    names = schema.names

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in pdf.to_dict("records"))
        out: Rows = []
        for _, group in itertools.groupby(rows, key=lambda r: r[page]):
            out += run(list(group))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return df.repartition(page).sortWithinPartitions(page, *order).mapInPandas(parts, schema)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def consistency_carry(df: DataFrame, doc: str, order: Sequence[str], key: str, code: str, score: str, margin: float = 0.17, strong: float = 0.8) -> DataFrame:
    """``carried``: the code decided before for an equal key, unless this row is better by ``margin`` and at least ``strong``."""

    def run(rows: Rows) -> Rows:
        held: dict = {}
        for r in rows:
            before = held.get(r[key])
            if before and not (r[score] >= before[1] + margin and r[score] >= strong):
                r["carried"] = before[0]
            else:
                held[r[key]] = r[code], r[score]
                r["carried"] = r[code]
        return rows

    return _by_page(df, doc, order, run, _with(df, "carried", df.schema[code].dataType))


def _shared(a: dict, b: dict) -> float:
    side = lambda p, s: min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p])
    return max(0.0, side("x", "width")) * max(0.0, side("y", "height"))


def suppress_overlaps(df: DataFrame, page: str, key: str, score: str, least: float = 0.68) -> DataFrame:
    """``kept``: boxes by falling score; one that overlaps a kept box by ``least`` (intersection over union) goes."""

    def run(rows: Rows) -> Rows:
        held: Rows = []
        for r in rows:
            own = r["width"] * r["height"]
            meets = ((_shared(r, k), own + k["width"] * k["height"]) for k in held)
            r["kept"] = not any(both < total and both >= least * (total - both) for both, total in meets)
            if r["kept"]:
                held.append(r)
        return rows

    return _by_page(df, page, [F.col(score).desc(), key], run, _with(df, "kept", T.BooleanType()))


def greedy_match(df: DataFrame, page: str, key: str, is_truth: str, limit: float = 0.08) -> DataFrame:
    """page, truth, prediction, distance: each truth in key order takes the nearest free prediction within ``limit``."""

    def run(rows: Rows) -> Rows:
        free = [r for r in rows if not r[is_truth]]
        out = []
        for t in rows:
            if t[is_truth] and free:
                best = min(free, key=lambda p: math.hypot(p["x"] - t["x"], p["y"] - t["y"]))
                far = math.hypot(best["x"] - t["x"], best["y"] - t["y"])
                if far <= limit:
                    free.remove(best)
                    out.append({page: t[page], "truth": t[key], "prediction": best[key], "distance": round(far, 6)})
        return out

    kind = df.schema[key].dataType
    schema = T.StructType([df.schema[page], T.StructField("truth", kind), T.StructField("prediction", kind), T.StructField("distance", T.DoubleType())])
    return _by_page(df, page, [key], run, schema)


def leader_clusters(df: DataFrame, page: str, order: Sequence[str], limit: float) -> DataFrame:
    """``cluster``: the first cluster whose running centroid is within ``limit``, else a new one."""

    def run(rows: Rows) -> Rows:
        centres: list[list[float]] = []
        for r in rows:
            fits = (k for k, (a, b, _) in enumerate(centres) if math.hypot(r["x"] - a, r["y"] - b) <= limit)
            k = next(fits, len(centres))
            if k == len(centres):
                centres.append([0.0, 0.0, 0])
            a, b, n = centres[k]
            centres[k] = [(a * n + r["x"]) / (n + 1), (b * n + r["y"]) / (n + 1), n + 1]
            r["cluster"] = k
        return rows

    return _by_page(df, page, order, run, _with(df, "cluster", T.IntegerType()))


def nudged(df: DataFrame, page: str, key: str, score: str, step: float = 4.0, tries: int = 10) -> DataFrame:
    """``placed_y``: by falling score, a box that meets a placed one moves down by ``step`` up to ``tries`` times, then below all."""

    def run(rows: Rows) -> Rows:
        held: Rows = []
        for r in rows:
            now = {k: r[k] for k in ("x", "y", "width", "height")}
            for _ in range(tries):
                if not any(_shared(now, k) > 0 for k in held):
                    break
                now["y"] += step
            if any(_shared(now, k) > 0 for k in held):
                now["y"] = max(k["y"] + k["height"] for k in held)
            held.append(now)
            r["placed_y"] = float(now["y"])
        return rows

    return _by_page(df, page, [F.col(score).desc(), key], run, _with(df, "placed_y", T.DoubleType()))


def exclusive_export(df: DataFrame, doc: str, order: Sequence[str], code: str, excludes: dict[str, list[str]]) -> DataFrame:
    """The rows that are written: in order, a code excluded by one written before is left out."""

    def run(rows: Rows) -> Rows:
        barred: set = set()
        out = []
        for r in rows:
            if r[code] not in barred:
                out.append(r)
                barred.update(excludes.get(r[code], ()))
        return out

    return _by_page(df, doc, order, run, df.schema)
