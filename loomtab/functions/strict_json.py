"""JSON texts under strict rules, and their canonical form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unique(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name stands twice")
    return found


def refused(token: str):
    raise ValueError(f"{token} is no number")


def canonical_text(text: str | None) -> str | None:
    """Names in order, no blanks, shortest escapes; null for what isn't strict JSON: NaN, infinities, names that stand twice, anything after the value."""
    if text is None:
        return None
    try:
        held = json.loads(text, object_pairs_hook=unique, parse_constant=refused)
        return json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """The canonical form of each text, null where it isn't strict JSON."""

    @F.pandas_udf(T.StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text)

    return made(text)
