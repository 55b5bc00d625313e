"""Rows of a frame in a form that compares across engines."""

import math

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in df[names].astype(object).itertuples(index=False, name=None))
