"""Small hand-made tables."""

from pyspark.sql import functions as F

from orderpath.functions import columns as C
from orderpath.operators import profile as P
from orderpath.plans import matrices as X

CUT = "2000-03-01"
D, R = "DIGITAL", "REP"


def binary(rows):
    return X.order_matrix(rows, CUT, "binary", heavy=None)


def test_single_order_vanishes(orders):
    rows = orders([(1, 1, 0, D)])
    assert binary(rows).count() == 0
    assert X.customer_binary_matrix(rows, heavy=None).count() == 0
    assert X.customer_transition_matrix(rows, heavy=None).count() == 0


def test_two_orders(orders):
    rows = orders([(1, 1, 0, D), (1, 2, 5, R)])
    assert binary(rows).count() == 0
    row = X.customer_binary_matrix(rows, heavy=None).first()
    assert (row.n_prev, row.target, row.n_digital, row.digital_share) == (1, 0, 1, 1.0)
    assert row.gap_mean is None and row.gap_median is None
    assert (row.billed_std, row.days_since_last, row.used_digital_30d) == (0.0, 5, 1)
    assert row.digital_trend == 0 and row.latest_channel == D


def test_tie_on_last_date(orders):
    rows = orders([(1, 1, 0, D), (1, 2, 10, R), (1, 3, 20, D), (1, 4, 20, R)])
    assert X.customer_binary_matrix(rows, heavy=None).count() == 0
    assert X.customer_transition_matrix(rows, ties="drop", heavy=None).count() == 0
    out = X.customer_transition_matrix(rows, ties="fanout", heavy=None).orderBy("target").collect()
    # REP -> DIGITAL and DIGITAL -> REP; two history rows seen twice each.
    assert [r.target for r in out] == [2, 3]
    for r in out:
        assert (r.n_prev, r.n_digital, r.billed_sum, r.billed_mean) == (4, 2, 60.0, 15.0)
        assert (r.gap_min, r.gap_max, r.gap_median) == (0, 10, 0.0)
        assert abs(r.gap_mean - 10 / 3) < 1e-12
        assert abs(r.billed_std - (100 / 3) ** 0.5) < 1e-9


def test_null_state_removes_the_row_before_it(orders):
    rows = orders([(1, 1, 0, D), (1, 2, 1, D), (1, 3, 2, None), (1, 4, 3, R), (1, 5, 4, D)])
    out = binary(rows).orderBy("order_id").collect()
    # Order 2 has no known next state and leaves before counting; order 5 has no next.
    assert [(r.order_id, r.n_prev, r.digital_prev, r.nondigital_prev) for r in out] == [(3, 1, 1, 0), (4, 2, 1, 1)]
    assert (out[0].is_digital, out[0].prev_is_digital) == (0, 1)
    assert (out[1].digital_mean_last3, out[1].nondigital_mean_last3) == (0.5, 0.0)
    four = X.order_matrix(rows, CUT, "transition", heavy=None).collect()
    assert [(r.order_id, r.target) for r in four] == [(4, 1)]


def test_null_date(orders):
    rows = orders([(1, 1, None, D), (1, 2, 0, R), (1, 3, 5, D)])
    out = binary(rows).collect()
    assert [(r.order_id, r.n_prev, r.days_since_prev, r.tenure_days, r.period) for r in out] == [(2, 1, 0, 0, "TRAIN")]
    row = X.customer_binary_matrix(rows, heavy=None).first()
    assert (row.n_prev, row.n_30d, row.latest_channel) == (2, 1, "NO_DIGITAL")
    split = rows.select("order_id", C.split_label(F.col("order_date"), CUT).alias("p")).collect()
    assert {r.order_id: r.p for r in split}[1] == "TEST"


def test_only_one_state_occurs(orders):
    rows = orders([(1, i, i, D) for i in range(4)])
    row = X.customer_binary_matrix(rows, heavy=None).first()
    assert (row.n_digital, row.n_nondigital, row.n_channels, row.n_changes) == (3, 0, 1, 0)
    table = P.state_columns(rows, "country", "channel", [D, R]).first()
    assert (table[D], table[R]) == (4, 0)


def test_zero_items(orders):
    zero = {"distinct_items": 0, "boxes": 3.0}
    out = binary(orders([(1, 1, 0, D, zero), (1, 2, 1, D, zero), (1, 3, 2, R)])).first()
    assert (out.boxes_per_item, out.boxes_per_item_mean_prev) == (0.0, 0.0)


def test_bad_text(orders):
    texts = ["x", "", "3.7", "4"]
    rows = orders([(i, i, 0, D, {"stars_txt": t, "agency_id": "N1-A" + t, "visit_code": None}) for i, t in enumerate(texts)])
    out = X.encode_attributes(rows).orderBy("order_id").select(
        "stars_val", "visit_len", C.suffix_number(F.col("agency_id"), C.AGENCY_SUFFIX).alias("a")
    )
    assert [tuple(r) for r in out.collect()] == [(None, None, None)] * 3 + [(4, None, 4)]


def test_unseen_group_keeps_null_share(orders):
    rows = orders(
        [(1, i, i, D if i % 2 else R) for i in range(1, 4)]
        + [(2, 10 + i, 80 + i, D, {"agency_id": "N1-A9", "route_id": None}) for i in range(3)]
    )
    out = X.order_matrix(rows, CUT, "transition", heavy=None).orderBy("order_id").collect()
    assert [(r.order_id, r.period, r.agency_digital_share) for r in out] == [(2, "TRAIN", 0.0), (11, "TEST", None)]
    assert out[1].route_digital_share is None


def test_weekend_and_calendar(orders):
    # 2000-01-01 was a Saturday.
    out = orders([(1, i, i, D) for i in range(3)]).select(
        *[c.alias(n) for n, c in C.calendar(F.col("order_date")).items()]
    )
    assert [(r.day_of_week, r.is_weekend) for r in out.collect()] == [(7, 1), (1, 1), (2, 0)]


def test_later_orders_change_no_feature(orders):
    base = [(1, i, i * i, [D, R, D, D, R, R][i]) for i in range(6)]
    before = {r.order_id: r.asDict() for r in binary(orders(base)).collect()}
    after = {r.order_id: r.asDict() for r in binary(orders(base + [(1, 9, 400, D), (1, 10, 500, R)])).collect()}
    assert before and all(after[k] == v for k, v in before.items())


def test_lumping_keeps_ties_in_value_order(orders):
    rows = orders([(1, i, i, D, {"route_id": r}) for i, r in enumerate(["b", "b", "a", "c", None])])
    out = P.lump_rare(rows, "route_id", 2, "rest").orderBy("order_id")
    assert [r.route_id for r in out.collect()] == ["b", "b", "a", "rest", "rest"]


def test_read_orders_checks_and_casts(spark, orders, tmp_path):
    import pytest

    from orderpath.sources.tables import read_orders

    path = str(tmp_path / "t")
    orders([(1, 1, 0, D)]).withColumnRenamed("customer_id", "cust").withColumn(
        "order_date", F.col("order_date").cast("timestamp")
    ).withColumn("boxes", F.lit("oops")).write.parquet(path)
    row = read_orders(spark, path, {"customer_id": "cust"}).first()
    assert (row.customer_id, str(row.order_date), row.boxes) == (1, "2000-01-01", None)
    with pytest.raises(ValueError, match="customer_id"):
        read_orders(spark, path)
