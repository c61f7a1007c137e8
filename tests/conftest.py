import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from orderpath.sources.tables import ORDER_SCHEMA

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def orders(spark):
    """Build an order table from short rows: (customer, order, day, channel, extra columns)."""

    def build(rows):
        full = []
        for customer, order, day, channel, *extra in rows:
            extra = extra[0] if extra else {}
            full.append(
                {
                    "order_id": order,
                    "customer_id": customer,
                    "order_date": None if day is None else date.fromordinal(date(2000, 1, 1).toordinal() + day),
                    "channel": channel,
                    "billed_usd": float(10 * order),
                    "distinct_items": 2,
                    "boxes": 4.0,
                    "country": "C",
                    "sales_region": "R",
                    "agency_id": "N1-A7",
                    "route_id": "Z-R9",
                    "customer_type": "T",
                    "maturity": "LOW",
                    "stars_txt": "3",
                    "visit_code": "LM",
                    **extra,
                }
            )
        return spark.createDataFrame([tuple(r[f.name] for f in ORDER_SCHEMA) for r in full], ORDER_SCHEMA)

    return build


def close_rows(left, right, key, tolerance=1e-9):
    """Assert that two frames hold the same rows, doubles up to a relative tolerance."""
    assert left.columns == right.columns
    a = sorted((tuple(r) for r in left.collect()), key=lambda r: tuple(map(str, (r[left.columns.index(k)] for k in key))))
    b = sorted((tuple(r) for r in right.collect()), key=lambda r: tuple(map(str, (r[left.columns.index(k)] for k in key))))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for name, u, v in zip(left.columns, x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tolerance * max(1.0, abs(u), abs(v)), (name, x, y)
            else:
                assert u == v, (name, x, y)
