"""Running sums over a table in a stated order, without a task that holds a whole group. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

_HERE = ("_part", "_tie")


def running_sums(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its sum over the rows before in the group, in the order of ``order``; and ``nth``,
    the number of rows before. Nulls come first; rows that ``order`` doesn't tell apart are ordered arbitrarily.

    Rows are dealt by range over (group, order), so a part holds about the same number of rows however ids are spread: sparse,
    null, or one id on a third of all rows (equal rows are told apart by their place in the input). Sums within a part are windows;
    a part's first value is the sum of the parts before, from a table with a row for each part and group. The dealt rows are written
    once, as a second reading may draw other ranges.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_s{k}" for k in range(len(sums))]
    keys = [group, *order, _HERE[1]]
    # ranges are drawn from a first reading of the rows, so what they are made of is computed once and written
    dealt = write_table(rows.withColumns({_HERE[1]: F.monotonically_increasing_id(), **dict(zip(names, sums.values()))}), "keys")
    dealt = dealt.repartitionByRange(n, *keys).withColumn(_HERE[0], F.spark_partition_id())
    part = Window.partitionBy(_HERE[0], group).orderBy(*keys[1:])
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"{c}_own": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in names} | {"_n_own": F.row_number().over(part) - 1})
    dealt = write_table(dealt.drop(_HERE[1]), "ordered")
    parts = dealt.groupBy(_HERE[0], group).agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy(_HERE[0]).rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select(F.col(_HERE[0]).alias("_p"), F.col(group).alias("_g"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_first") for c in [*names, "_n"]])
    joined = dealt.join(first, (F.col(_HERE[0]) == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, *[(F.col(f"{c}_first") + F.col(f"{c}_own")).cast("long").alias(name) for name, c in zip(sums, names)],
                         (F.col("_n_first") + F.col("_n_own")).cast("long").alias("nth"))
