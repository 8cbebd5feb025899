"""Numbers as they are written in Colombia: a dot between thousands, a comma before decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_es(value: Column, decimals: int = 2) -> Column:
    return F.translate(F.format_number(value, decimals), ",.", ".,")
