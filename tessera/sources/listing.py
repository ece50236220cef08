"""Scans of names by a pattern with named groups, with counts of what is skipped and why."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.rows import first_failing_reason

UNPARSED = "unparsed_name"


def named_groups(name: Column, pattern: str, kinds: dict[str, str]) -> Column:
    """A struct of the pattern's named groups as ``kinds`` says, null where the whole name does not fit or a number is too large.

    Groups are written ``(?P<name>...)``; an optional group that takes no part is null.
    """
    groups = re.compile(pattern).groupindex
    if missing := [k for k in kinds if k not in groups]:
        raise ValueError(f"the pattern has no group {', '.join(missing)}")
    java = f"^(?:{pattern.replace('(?P<', '(?<')})$"
    part = lambda k: F.nullif(F.regexp_extract(name, java, groups[k]), F.lit(""))
    typed = {k: part(k) if t == "string" else part(k).try_cast(t) for k, t in kinds.items()}
    bad = [part(k).isNotNull() & typed[k].isNull() for k, t in kinds.items() if t != "string"]
    fits = name.rlike(java)
    for b in bad:
        fits = fits & ~b
    return F.when(fits, F.struct(*(c.alias(k) for k, c in typed.items())))


def marked(names: DataFrame, name: str, pattern: str, kinds: dict[str, str], checks: list[tuple[str, Column]] = ()) -> DataFrame:
    """``names`` with the groups as columns and the ``reason`` why a row is skipped, null for those that stay.

    ``checks`` are (reason, condition) over the groups and the other columns; the first that holds is the reason.
    """
    rows = names.withColumn("_g", named_groups(F.col(name), pattern, kinds))
    rows = rows.withColumns({k: F.col("_g")[k] for k in kinds})
    return rows.withColumn("reason", first_failing_reason([(UNPARSED, F.col("_g").isNull()), *checks])).drop("_g")


def scan(names: DataFrame, name: str, pattern: str, kinds: dict[str, str], checks: list[tuple[str, Column]] = (), counts: Observation | None = None) -> DataFrame:
    """The rows of ``marked`` that stay. ``counts`` gets, in the same pass, ``rows``, ``kept`` and the skips of each reason.

    The counts are those of all names: filters set on the result are not applied before it, so select names first to scan fewer.
    """
    rows = marked(names, name, pattern, kinds, checks)
    if counts is not None:
        each = [F.count_if(F.col("reason") == r).alias(r) for r in dict.fromkeys([UNPARSED, *(r for r, _ in checks)])]
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("kept"), *each)
    return rows.where("reason is null").drop("reason")
