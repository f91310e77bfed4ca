"""Comparing results of two engines."""

import numpy as np
import pandas as pd


def rows_of(frame):
    """Rows of a pandas frame as comparable tuples, columns by name, in any order."""
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and np.isnan(v)):
            return "null"
        if isinstance(v, float | np.floating):
            return f"{v:.9g}"
        return str(int(v)) if isinstance(v, bool | np.bool_ | int | np.integer) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))
