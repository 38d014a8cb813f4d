"""As-of join: for each left row the latest right row at or before it, within a key.

One window over both sides would put a whole key into one task. Rows are therefore dealt out by key
and slot of the ordering column; the latest right row of each slot, one row a key and slot, is
carried into the later slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, width: float = 3600.0, columns: list[str] | None = None, name: str = "matched"
) -> DataFrame:
    """Every left row with ``name``, a struct of ``on`` and the right row's ``columns``, or null.

    ``on`` is a timestamp, a date or a number, ``width`` the length of a slot in seconds or units. Null keys
    match nothing; a null ``on`` leaves a left row unmatched and a right row unused. Of right rows
    with equal ``on`` the greatest in ``columns`` is taken, so repeated rows agree. Left rows that
    repeat stay repeated; empty sides give no match or no rows.
    """
    if name in left.columns:
        raise ValueError(f"the left side has a column {name}")
    columns = columns if columns is not None else [c for c in right.columns if c not in (*by, on)]
    keys = [f"__by{i}" for i in range(len(by))]

    def laid(df: DataFrame, side: int, own) -> DataFrame:
        at = F.col(on).cast("timestamp") if df.schema[on].dataType.typeName() in ("timestamp_ntz", "date") else F.col(on)
        slot = F.floor(at.cast("double") / F.lit(float(width)))
        return df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(on).alias("__on"), slot.alias("__slot"), *own)

    usable = F.col(on).isNotNull()
    for b in by:
        usable = usable & F.col(b).isNotNull()
    row = F.struct(on, *columns)
    r = laid(right.where(usable), 1, [F.lit(0).alias("__side"), row.alias("__right")])
    packed = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    told = laid(left.withColumn("__ok", usable), 0, [F.lit(1).alias("__side"), packed.alias("__left"), F.col("__ok")])
    both = told.where("__ok").drop("__ok").unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__slot").orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__in", F.max("__right").over(inside)).where("__side = 1")
    # one row a key and slot, whatever the number of rows
    slots = both.groupBy(*keys, "__slot").agg(F.max("__right").alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*keys, "__slot", F.max("__last").over(earlier).alias("__before")).where("__before IS NOT NULL")
    matched = found.join(carried, [*keys, "__slot"], "left").select("__left.*", F.coalesce("__in", "__before").alias(name))
    alone = left.where(~usable).withColumn(name, F.lit(None).cast(matched.schema[name].dataType))
    return matched.unionByName(alone)
