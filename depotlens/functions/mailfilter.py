"""The mail filter terms as one predicate."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def mail_filter(text: str | None, labels: str = "labels", date: str = "date") -> Column:
    """Terms joined by spaces: ``label:x``, ``after:YYYY/MM/DD``, ``before:YYYY/MM/DD``.

    ``labels`` is an array of label names and ``date`` a timestamp. All terms
    must hold; no terms keep every row; an unknown term is an error.
    """
    out = F.lit(True)
    for term in (text or "").split():
        kind, _, value = term.partition(":")
        if kind == "label" and value:
            out &= F.array_contains(F.col(labels), value.upper())
        elif kind in ("after", "before") and re.fullmatch(r"\d{4}/\d{1,2}/\d{1,2}", value):
            day = F.lit(datetime.strptime(value, "%Y/%m/%d")).cast("timestamp_ntz")
            out &= F.col(date) >= day if kind == "after" else F.col(date) < day
        else:
            raise ValueError(f"unknown mail filter term: {term}")
    return out
