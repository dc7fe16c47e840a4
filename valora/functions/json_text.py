"""Canonical JSON text, the form whose hash identifies landed JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_text(text: str | None) -> str | None:
    """Sorted keys, ``", "`` and ``": "``, only the needed escapes; NULL where it cannot be read.

    Of repeated keys the last counts, integers keep their digits, other numbers take the shortest
    form of their double. Text with half a surrogate pair has no UTF-8 form and counts as unread.
    """
    if text is None:
        return None
    try:
        written = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        written.encode("utf-8")
    except (ValueError, RecursionError):
        return None
    return written


def _canonical_batch(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore").astype(object)


def canonical_json(text: Column) -> Column:
    """`canonical_text` over Arrow batches. The session needs `valora.session.ship_package`."""
    return F.pandas_udf(_canonical_batch, "string")(text)
