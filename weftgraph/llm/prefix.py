"""Running sums over ordered rows whose groups may be of any size.

Rows are dealt by range over (group keys, order), so a large group lies in many neighbouring partitions; every
partition sums its own rows, and the partitions' totals - one row for each (group, partition) - give the offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import bounded_broadcast, write_table


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Equality of all pairs, nulls being equal to each other."""
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in pairs])


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], label: str, modulus: int | None = None) -> DataFrame:
    """``df`` with, for each entry of ``sums``, the sum of that long expression over the rows of the same keys that come before.

    ``order`` lists sort expressions over the columns of ``df``; rows that are equal in it come in the order in which
    their partition was read, so results agree between runs wherever such rows are equal altogether. With ``modulus``
    the sums are taken modulo it. Null keys are one group; an empty table gives no rows."""
    numbered = df.select("*", *[e.cast("long").alias(f"_v_{n}") for n, e in sums.items()], F.monotonically_increasing_id().alias("_row"))
    dealt = numbered.repartitionByRange(*[F.col(k).asc() for k in keys], *order, F.col("_row").asc())
    # the partition's number is written with the row: totals and rows must see the same borders, whatever is computed again
    staged = write_table(dealt.withColumn("_pid", F.spark_partition_id()), label)
    own = Window.partitionBy("_pid", *keys).orderBy(*order, F.col("_row").asc()).rowsBetween(Window.unboundedPreceding, -1)
    within = staged.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(own), F.lit(0)).alias(f"_w_{n}") for n in sums])
    total = staged.groupBy("_pid", *keys).agg(*[F.sum(F.col(f"_v_{n}").cast("decimal(38,0)")).alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(
        F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    offsets = bounded_broadcast(write_table(offsets, f"{label}-offsets"))
    joined = within.join(offsets, same([(F.col("_pid"), F.col("_p")), *[(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)]]))

    def before(n: str) -> Column:
        at = F.col(f"_o_{n}") + F.col(f"_w_{n}")
        return (F.pmod(at, F.lit(modulus).cast("decimal(38,0)")) if modulus else at).cast("long").alias(n)

    return joined.select(*df.columns, *[before(n) for n in sums])
