"""Edit distance where a swap of neighbours counts as one (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def osa(a: str, b: str, most: int) -> int:
    """Distance of a and b, most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[-1], most + 1)


def osa_distance(most: int):
    """Column function of two strings."""
    return F.pandas_udf(lambda a, b: pd.Series([None if x is None or y is None else osa(x, y, most) for x, y in zip(a, b)], dtype="Int32"), "int")
