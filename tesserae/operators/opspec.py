"""Declarative filter, group, sort and limit specifications over a cleaned table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = ("==", "!=", ">", ">=", "<", "<=", "contains")
FUNCTIONS = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "nunique": F.count_distinct,
}


@dataclass
class OpSpec:
    table: str
    filters: list[dict] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[dict] = field(default_factory=list)
    sort: list[dict] = field(default_factory=list)
    limit: int | None = None


def _test(df: DataFrame, column: str, op: str, value) -> Column:
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] == "string":
        c, value = F.lower(c), str(value).lower()
    tests = {
        "==": lambda: c == value,
        "!=": lambda: ~c.eqNullSafe(value),
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        "contains": lambda: F.lower(c.cast("string")).contains(str(value).lower()),
    }
    if op not in tests:
        raise ValueError(f"unknown comparison {op}")
    return tests[op]()


def run_spec(spec: OpSpec, df: DataFrame) -> DataFrame:
    """The specification as a plan: totals left out, filter, group, sort, limit. Unknown names raise ValueError."""

    def known(name: str, columns: list[str]) -> str:
        if name not in columns:
            raise ValueError(f"unknown column {name}; there are {', '.join(columns)}")
        return name

    rows = df.filter(~F.col("_is_total")) if "_is_total" in df.columns else df
    for f in spec.filters:
        rows = rows.filter(_test(df, known(f["column"], df.columns), f["op"], f["value"]))
    made = []
    for a in spec.aggregations:
        if a["func"] not in FUNCTIONS:
            raise ValueError(f"unknown function {a['func']}")
        name = known(a["column"], df.columns)
        made.append(FUNCTIONS[a["func"]](F.col(f"`{name}`")).alias(a.get("alias") or f"{a['func']}_{name}"))
    keys = [F.col(f"`{known(k, df.columns)}`") for k in spec.group_by]
    if made:
        rows = rows.groupBy(*keys).agg(*made) if keys else rows.agg(*made)
    elif keys:
        rows = rows.select(*keys).distinct()
    order = []
    for s in spec.sort:
        c = F.col(f"`{known(s['column'], rows.columns)}`")
        order.append(c.desc_nulls_last() if s.get("descending") else c.asc_nulls_last())
    rows = rows.orderBy(*order) if order else rows
    return rows.limit(spec.limit) if spec.limit else rows
