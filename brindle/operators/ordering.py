"""The row before each row, without one task per key."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep


def with_previous(rows: DataFrame, key: str, order: list[str], carry: list[str], label: str = "previous", only: F.Column | None = None) -> DataFrame:
    """Each row with ``prev_<c>`` for each c of carry, taken from the row before it within its key (null at the first).

    A window over the key would put a key with a third of all rows into one task. Here the rows are split by range of
    (key, order), so a key spans as many partitions as it needs; each partition looks back by itself, and the first row
    of a partition gets its values from the last row of the partition before, of which there is one per
    partition (so the side that is broadcast has as many rows as there are partitions). ``order`` must be total within a key.
    ``only`` keeps the rows that the caller needs, before they are written.
    """
    source = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (key, *order)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (key, *order)])
    fields = [*source.schema.fields, *(T.StructField(f"prev_{c}", source.schema[c].dataType) for c in carry), T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())]

    def look_back(batches):
        from pyspark import TaskContext

        part, before, held = TaskContext.get().partitionId(), None, None

        def finish(batch, last):
            flags = pa.array([False] * (batch.num_rows - 1) + [last])
            return pa.RecordBatch.from_arrays([*batch.columns, flags], names=[*batch.schema.names, "_last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, names = batch.num_rows, batch.schema.names
            take = lambda c: pa.concat_arrays([before.column(names.index(c)) if before is not None else pa.nulls(1, batch.column(names.index(c)).type), batch.column(names.index(c)).slice(0, n - 1)])  # noqa: E731, B023
            old, new = take(key), batch.column(names.index(key))
            same = pc.fill_null(pc.equal(old, new), False)
            same = pc.or_(same, pc.and_(pc.is_null(old), pc.is_null(new)))
            if before is None:
                same = pa.concat_arrays([pa.array([False]), same.slice(1)])
            shifted = [pc.if_else(same, take(c), pa.scalar(None, batch.column(names.index(c)).type)) for c in carry]
            first = pa.array([before is None] + [False] * (n - 1))
            if held is not None:
                yield finish(held, False)
            held = pa.RecordBatch.from_arrays([*batch.columns, *shifted, pa.array([part] * n, pa.int32()), first], names=[*names, *(f"prev_{c}" for c in carry), "_part", "_first"])
            before = batch.slice(n - 1, 1)
        if held is not None:
            yield finish(held, True)

    seen = source.mapInArrow(look_back, T.StructType(fields))
    if only is not None:
        seen = seen.where(only | F.col("_first") | F.col("_last"))
    seen = keep(seen, label)
    ends = seen.where("_last").select("_part", F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    firsts = seen.where("_first").select("_part").withColumn("_kind", F.lit(1))
    marks = ends.withColumn("_kind", F.lit(0)).unionByName(firsts, allowMissingColumns=True)
    before = Window.orderBy("_part", F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_key", *[f"_c{i}" for i in range(len(carry))])), ignorenulls=True).over(before)
    heads = marks.withColumn("_tail", last).where("_kind = 1").select("_part", F.lit(True).alias("_first"), "_tail")
    joined = seen.join(F.broadcast(heads), ["_part", "_first"], "left")
    stitched = {f"prev_{c}": F.when(F.col("_first") & F.col("_tail._key").eqNullSafe(F.col(key)) & F.col("_tail").isNotNull(), F.col(f"_tail._c{i}")).otherwise(F.col(f"prev_{c}")) for i, c in enumerate(carry)}
    result = joined.withColumns(stitched).drop("_part", "_first", "_last", "_tail")
    return result.where(only) if only is not None else result


def numbered(rows: DataFrame, order: list[F.Column], name: str, label: str = "numbered") -> DataFrame:
    """Adds the place of each row (from 1) in an order over all rows, which should be total, without one task for all.

    Rows are split by range and sorted within the parts; a part starts after the rows of those before it, of which the counts (one
    row a part) are broadcast.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the number of the part, shifted by 33 bits, and the place in it
    kept = keep(parts.withColumn("_at", at), label)
    kept = kept.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    return kept.join(F.broadcast(begins), "_part").withColumn(name, (F.col("_begin") + F.col("_at") + 1).cast("bigint")).drop("_part", "_begin", "_at")
