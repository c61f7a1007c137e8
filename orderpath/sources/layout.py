"""A history table laid out by entity, so that later queries do not shuffle it.

Rows are written once, bucketed by entity with one sorted file a bucket. Window and
aggregate plans over the table start from its buckets and need no exchange on the entity.
One bucket is one task, so heavy entities stay out of the buckets: their rows
lie beside them in range-partitioned pieces, which the route for long histories reads.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpath.operators.history import BLOCK_ROWS, MAX_PIECES, History
from orderpath.operators.joins import HEAVY_ROWS, HeavyKeys, heavy_keys
from orderpath.operators.scan import PIECE
from orderpath.spec import HistorySpec

ROWS_PER_BUCKET = 4 * HEAVY_ROWS
MAX_BUCKETS = 100_000


@dataclass(frozen=True)
class _Layout:
    """The one row that describes a finished layout; ``heavy_rows`` is 0 without heavy entities."""

    entity: str
    order: str
    columns: str
    buckets: int
    heavy_rows: int
    heavy_listed: bool


def write_entity_layout(
    rows: DataFrame,
    spec: HistorySpec,
    path: str,
    buckets: int | None = None,
    heavy: HeavyKeys | None | str = "find",
    heavy_rows: int = HEAVY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> History:
    """Write ``rows`` by entity under ``path`` and return the history read from there.

    ``path`` must not exist and must be reachable by every executor. ``buckets`` is by
    default the number of shuffle partitions, or more where a bucket would exceed
    ROWS_PER_BUCKET rows. The description is written last: a folder without it is unfinished.
    """
    spark = rows.sparkSession
    if heavy == "find":
        heavy = heavy_keys(rows, spec.entity, heavy_rows)
    if buckets is None:
        wanted = math.ceil(rows.select(spec.entity).count() / ROWS_PER_BUCKET)
        buckets = min(MAX_BUCKETS, max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordinary = rows
    if heavy is not None:
        keys = heavy.keys()
        match = rows[spec.entity].eqNullSafe(keys["heavy_key"])
        pieces = max(1, min(MAX_PIECES, math.ceil(heavy.rows / block_rows)))
        ranged = rows.join(keys, match, "left_semi").repartitionByRange(pieces, spec.entity, *spec.order_columns)
        ranged.withColumn(PIECE, F.spark_partition_id()).write.parquet(f"{path}/long")
        heavy.frame.write.parquet(f"{path}/heavy")
        ordinary = rows.join(keys, match, "left_anti")
    # The table of the writer only serves to write buckets; readers name their own.
    name = f"{_name(path)}_written"
    (
        ordinary.repartition(buckets, spec.entity)
        .write.bucketBy(buckets, spec.entity)
        .sortBy(spec.entity, *spec.order_columns)
        .option("path", f"{path}/buckets")
        .saveAsTable(name, format="parquet")
    )
    spark.sql(f"DROP TABLE {name}")
    described = _Layout(
        spec.entity,
        ",".join(spec.order_columns),
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
        buckets,
        heavy.rows if heavy else 0,
        bool(heavy and heavy.listed),
    )
    spark.createDataFrame([tuple(asdict(described).values())], list(asdict(described))).write.parquet(f"{path}/layout")
    return open_entity_layout(spark, spec, path, block_rows)


def open_entity_layout(
    spark: SparkSession, spec: HistorySpec, path: str, block_rows: int = BLOCK_ROWS
) -> History:
    """The history laid out under ``path``, also in a later session."""
    row = spark.read.parquet(f"{path}/layout").first()
    found = _Layout(**row.asDict())
    if (found.entity, found.order) != (spec.entity, ",".join(spec.order_columns)):
        raise ValueError(f"laid out by {found.entity} and {found.order}, not by {spec.entity} and {spec.order_columns}")
    name = _name(path)
    order = ", ".join(f"`{c}`" for c in [spec.entity, *spec.order_columns])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({found.columns}) USING parquet LOCATION '{path}/buckets' "
        f"CLUSTERED BY (`{spec.entity}`) SORTED BY ({order}) INTO {found.buckets} BUCKETS"
    )
    ordinary = spark.table(name)
    if not found.heavy_rows:
        return History(spec, ordinary, None, block_rows)
    heavy = HeavyKeys(spark.read.parquet(f"{path}/heavy"), found.heavy_rows, found.heavy_listed)
    return History(spec, ordinary, spark.read.parquet(f"{path}/long"), block_rows, written=True, heavy=heavy)


def _name(path: str) -> str:
    return f"orderpath_layout_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
