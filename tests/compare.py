"""Order-free comparison of two pandas frames by value."""

import math

import pandas as pd


def cell(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, bool) or hasattr(value, "__float__") and not isinstance(value, str):
        number = float(value)
        return "null" if math.isnan(number) else repr(number + 0.0)
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))
