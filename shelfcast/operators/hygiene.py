"""Credential check over a text column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CREDENTIAL_PATTERNS


def credential_findings(
    items: DataFrame, key: str, text: str, patterns: Mapping[str, list[str]] = CREDENTIAL_PATTERNS,
) -> DataFrame:
    """One row per item whose text holds a credential; the text itself is withheld.

    Each pattern comes with plain strings one of which every match contains. The
    whole text is searched for those first, which is a byte search, and the pattern
    runs only on the few texts that pass. Nothing is shuffled.
    """
    tests = []
    for pattern, required in patterns.items():
        found = F.col(text).rlike(pattern)
        if required:
            found = reduce(or_, [F.col(text).contains(r) for r in required]) & found
        tests.append(found)
    return items.filter(reduce(or_, tests)).select(
        F.col(key), F.lit("credential-pattern; contents withheld").alias("kind"))
