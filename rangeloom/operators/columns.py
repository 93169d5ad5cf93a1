"""Choice and naming of columns, value maps and keys."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistic_names(attributes: Sequence[str], statistics: Sequence[str]) -> list[str]:
    """``attribute_statistic`` of every attribute and statistic, in order."""
    return [f"{a}_{s}" for a in attributes for s in statistics]


def matching(names: Sequence[str], pattern: str, keep: bool = True) -> list[str]:
    """The names in which a pattern occurs, or with ``keep`` false the others."""
    return [n for n in names if bool(re.search(pattern, n)) == keep]


def drop_one(attributes: Sequence[str], statistics: Sequence[str], by: str = "column") -> Iterator[tuple[str, list[str]]]:
    """(dropped, names left) of every run that leaves out one column, attribute or statistic; ``none`` first, which leaves out nothing."""
    names = statistic_names(attributes, statistics)
    yield "none", names
    for dropped in {"column": names, "attribute": attributes, "statistic": statistics}[by]:
        gone = {"column": {dropped}, "attribute": {f"{dropped}_{s}" for s in statistics}, "statistic": {f"{a}_{dropped}" for a in attributes}}[by]
        yield dropped, [n for n in names if n not in gone]


def mapped(value: Column, names: Mapping[int, str]) -> Column:
    """The name of each value, null for a value without one."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of both tables for the keys that both have; null keys match."""
    other = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *other)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, same).select(*left.columns, *other)
