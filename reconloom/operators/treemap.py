"""Squarified layout of a batch's exception classes by value; each batch is a handful of rectangles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _squarify(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles for values (descending) in a rectangle; rows are filled while the worst side ratio improves."""
    total = sum(values)
    if not values or total <= 0:
        return [(x, y, 0.0, 0.0)] * len(values)
    areas, out, at = [v * w * h / total for v in values], [], 0
    while at < len(areas):
        side, row, best = min(w, h), [], float("inf")
        while at + len(row) < len(areas):
            new = [*row, areas[at + len(row)]]
            s = sum(new)
            worst = max(max(side * side * a / (s * s), s * s / (side * side * a)) if a > 0 else float("inf") for a in new) if s > 0 and side > 0 else float("inf")
            if row and worst > best:
                break
            row, best = new, worst
        s, deep = sum(row), sum(row) / side if side else 0.0
        offset = 0.0
        for a in row:
            long = a / deep if deep else 0.0
            out.append((x, y + offset, deep, long) if w >= h else (x + offset, y, long, deep))
            offset += long
        x, y, w, h = (x + deep, y, w - deep, h) if w >= h else (x, y + deep, w, h - deep)
        at += len(row)
        if s == 0:
            break
    return out + [(x, y, 0.0, 0.0)] * (len(values) - len(out))


def layout(sizes: DataFrame, width: float = 100.0, height: float = 60.0) -> DataFrame:
    """sizes: batch, label, value. Adds x, y, w, h."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "label"], ascending=[False, True]).reset_index(drop=True)
        boxes = _squarify([float(v) for v in pdf["value"]], 0.0, 0.0, width, height)
        return pdf[["batch", "label", "value"]].join(pd.DataFrame(boxes, columns=["x", "y", "w", "h"]))

    return sizes.groupBy("batch").applyInPandas(one, "batch string, label string, value long, x double, y double, w double, h double")
