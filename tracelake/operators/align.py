"""Operators over tables of samples: joins on masters and reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def master_join(left: DataFrame, right: DataFrame, master: str, how: str = "inner") -> DataFrame:
    """Groups with the same master values side by side; record indexes are dropped."""
    return left.drop("record_index").join(right.drop("record_index"), master, how)


def cut_points(masters: DataFrame, master: str, ranges: int) -> list[float]:
    """Up to ``ranges`` - 1 ascending values that cut a column into stretches of about equal numbers of rows."""
    at = [k / ranges for k in range(1, ranges)]
    got = masters.agg(F.percentile_approx(F.col(master).cast("double"), at, 10 * ranges)).first()[0] if at else []
    return sorted(set(got or []))


def as_of(left: DataFrame, right: DataFrame, master: str, values: list[str], by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """For each row of ``left`` the ``values`` of the last row of ``right`` whose master is not after it.

    One pass over the union in master order, no join.  The masters are cut into ``ranges`` stretches of about equal numbers
    of rows (default: as many as there are shuffle partitions), each a task of its own; what a stretch needs from before it
    is the last right row of the stretches before, found on one row a stretch.  Nulls in the master never match; of right
    rows with equal masters any one counts.
    """
    if ranges is None:
        ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l_cols = left.columns
    r = right.where(F.col(master).isNotNull()).select(F.col(master), *[F.col(b) for b in by], F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    lrows = left.select(F.col(master), *[F.col(b) for b in by], F.struct(*l_cols).alias("_l"), F.lit(1).alias("_side"))
    both = r.unionByName(lrows, allowMissingColumns=True)
    keys: list[Column] = [F.col(b) for b in by]
    cuts = cut_points(left.select(master).unionByName(right.select(master)), master, max(1, ranges))
    x = F.col(master).cast("double")
    stretch = F.when(x.isNull(), -1).otherwise(F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < x)) if cuts else F.lit(0))
    both = both.withColumn("_stretch", stretch)
    ends = both.groupBy(*keys, "_stretch").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(master))).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    w = Window.partitionBy(*keys, "_stretch").orderBy(F.col(master).asc_nulls_first(), "_side")
    same = F.lit(True)
    renamed = carried.select(*[F.col(c).alias(f"_c_{c}") for c in [*by, "_stretch"]], "_carry")
    for c in [*by, "_stretch"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).join(renamed, same, "left").withColumn("_v", F.coalesce("_v", "_carry")).where("_side = 1")
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in l_cols], *[F.when(F.col(master).isNotNull(), F.col(f"_v.{v}")).alias(v) for v in values])


def downsample(df: DataFrame, master: str, interval: float | int, values: list[str], by: list[str] = ()) -> DataFrame:
    """Minimum, mean and maximum of each value in stretches of the master (sample reduction)."""
    bucket = F.floor(F.col(master) / F.lit(interval)).alias("bucket")
    aggs = [a for v in values for a in (F.min(v).alias(f"{v}_min"), F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"))]
    return df.groupBy(*by, bucket).agg(F.count("*").alias("n"), *aggs)


def demultiplex(records: DataFrame, payload: str, fields: dict[int, dict[str, Column]], id_bytes: int = 1) -> dict[int, DataFrame]:
    """Tables of the groups whose records are mixed in ``records``: a binary column of a record id (little-endian) and a body.

    ``fields`` has the columns of each id, as expressions over ``body``; records of other ids are in no table.
    """
    own = lambda i: F.substring(payload, 1, id_bytes) == F.lit(i.to_bytes(id_bytes, "little")) if 0 <= i < 256**id_bytes else F.lit(False)
    body = F.substring(payload, id_bytes + 1, 1 << 30).alias("body")
    rest = [c for c in records.columns if c != payload]
    return {i: records.where(own(i)).select(*rest, body).select(*rest, *[c.alias(n) for n, c in columns.items()]) for i, columns in fields.items()}
