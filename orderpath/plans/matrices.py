"""Feature matrices: one row per order, or one row per customer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.functions import columns as C
from orderpath.operators.history import BLOCK_ROWS, History
from orderpath.operators.joins import HEAVY_ROWS, HeavyKeys, dimension_join, lookup_join
from orderpath.session import stage_table
from orderpath.spec import ORDERS, HistorySpec

ATTRIBUTES = [
    "country",
    "sales_region",
    "agency_id",
    "route_id",
    "customer_type",
    "maturity",
    "stars_txt",
    "visit_code",
]
# measure -> statistics over all earlier rows
ORDER_STATISTICS = {
    "billed": ("mean", "sum", "std"),
    "items": ("mean", "sum"),
    "boxes": ("mean", "sum"),
}
ORDER_RATIO = ("boxes_per_item", "boxes", "distinct_items")


def with_next_state(history: History) -> History:
    """Add the next state and keep the rows that have one."""
    return history.annotate(lead={"next_state": history.spec.state}).map(
        lambda rows: rows.where(F.col("next_state").isNotNull())
    )


def with_running_features(
    history: History,
    statistics: Mapping[str, Sequence[str]],
    ratio: tuple[str, str, str] | None = None,
) -> History:
    """Gaps, counts, running and recent statistics of everything before the current row."""
    spec = history.spec
    time, state = F.col(spec.time), F.col(spec.state)
    derive = {
        "n_prev": F.col("_position") - 1,
        "days_since_prev": F.datediff(time, F.col("prev_time")),
        "is_digital": C.state_flag(state, spec.positive),
        "prev_is_digital": C.state_flag(F.col("prev_state"), spec.positive),
        "_is_other": C.other_state_flag(state, spec.positive),
        "tenure_days": F.datediff(time, F.col("_first_time")),
    }
    prior = {
        "digital_prev": ("sum", F.col("is_digital")),
        "gap_mean_prev": ("mean", F.col("days_since_prev")),
        "gap_std_prev": ("std", F.col("days_since_prev")),
    }
    trailing = {
        "digital_mean_last3": (F.col("is_digital"), 3),
        "nondigital_mean_last3": (F.col("_is_other"), 3),
    }
    for name, wanted in statistics.items():
        measure = F.col(spec.measures[name])
        prior |= {f"{name}_{statistic}_prev": (statistic, measure) for statistic in wanted}
        trailing[f"{name}_mean_last3"] = (measure, 3)
    if ratio:
        name, numerator, denominator = ratio
        derive[name] = C.ratio(F.col(numerator), F.col(denominator))
        prior[f"{name}_mean_prev"] = ("mean", F.col(name))
    known = history.annotate(
        lag={"prev_state": spec.state, "prev_time": spec.time},
        position="_position",
        first_time="_first_time",
        derive=derive,
        prior=prior,
        trailing=trailing,
    )

    def usage(rows: DataFrame) -> DataFrame:
        digital, n = F.col("digital_prev"), F.col("n_prev")
        return rows.withColumns(
            {
                "nondigital_prev": n - digital,
                "digital_share_prev": C.ratio(digital, n),
                "nondigital_share_prev": C.ratio(n - digital, n),
            }
        )

    return known.map(usage)


ORDER_MATRIX_TYPES = {
    "target": "int",
    "n_prev": "int",
    "digital_prev": "bigint",
    "nondigital_prev": "bigint",
    "items_sum_prev": "bigint",
}
ORDER_MATRIX_COLUMNS = [
    "customer_id",
    "order_id",
    *ATTRIBUTES,
    "target",
    "is_digital",
    "prev_is_digital",
    "billed_usd",
    "days_since_prev",
    "n_prev",
    "billed_mean_prev",
    "billed_sum_prev",
    "billed_std_prev",
    "digital_prev",
    "nondigital_prev",
    "digital_share_prev",
    "nondigital_share_prev",
    "billed_mean_last3",
    "digital_mean_last3",
    "nondigital_mean_last3",
    "gap_mean_prev",
    "gap_std_prev",
    "distinct_items",
    "items_mean_prev",
    "items_sum_prev",
    "items_mean_last3",
    "boxes",
    "boxes_mean_prev",
    "boxes_sum_prev",
    "boxes_mean_last3",
    "boxes_per_item",
    "boxes_per_item_mean_prev",
    "month",
    "day_of_week",
    "is_weekend",
    "quarter",
    "tenure_days",
    "order_date",
]
# group column -> its training share of the positive state
GROUP_SHARES = {"agency_id": "agency_digital_share", "route_id": "route_digital_share"}
ENCODED_ATTRIBUTES = ["maturity_val", "stars_val", "visit_len"]


def fill_numeric(df: DataFrame) -> DataFrame:
    """0 for NULL in every numeric column; text and dates keep their NULL."""
    return df.fillna(0)


def encode_attributes(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "maturity_val": C.ordinal(F.col("maturity"), C.MATURITY_CODES),
            "stars_val": C.whole_number(F.col("stars_txt")),
            "visit_len": F.length("visit_code"),
        }
    )


def order_matrix(
    orders: DataFrame | History,
    cutoff: str,
    target: str = "transition",
    spec: HistorySpec = ORDERS,
    heavy: HeavyKeys | None | str = "find",
    heavy_rows: int = HEAVY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per order that has an earlier and a later order.

    ``target='transition'`` is the four-class code of (current, next) and also yields
    encoded attributes and group shares; ``target='binary'`` is "next is positive".
    """
    if target not in ("transition", "binary"):
        raise ValueError(f"target must be 'transition' or 'binary': {target}")
    history = with_next_state(History.of(orders, spec, heavy, heavy_rows, block_rows))
    current, following = F.col(spec.state), F.col("next_state")
    if target == "transition":
        label = C.transition_code(current, following, spec.positive, C.FORWARD_CODES)
    else:
        label = C.state_flag(following, spec.positive)
    rows = with_running_features(history, ORDER_STATISTICS, ORDER_RATIO).rows()
    rows = encode_attributes(
        rows.withColumn("target", label).where((F.col("n_prev") > 0) & F.col("target").isNotNull())
    ).withColumns(C.calendar(F.col(spec.time)))
    extra = ENCODED_ATTRIBUTES if target == "transition" else []
    matrix = fill_numeric(
        rows.select(
            *[
                F.col(c).cast(ORDER_MATRIX_TYPES[c]).alias(c) if c in ORDER_MATRIX_TYPES else F.col(c)
                for c in ORDER_MATRIX_COLUMNS
            ],
            *extra,
            C.split_label(F.col(spec.time), cutoff).alias("period"),
        )
    )
    if target == "binary":
        return matrix
    # Read for the shares and again for the result: joins and windows run once.
    matrix = stage_table(matrix, "matrix")
    shares = stage_table(
        group_means(
            matrix.where(F.col("period") == "TRAIN"),
            list(GROUP_SHARES),
            F.when(F.col("target").isin(2, 3), 1).otherwise(0),
        ),
        "shares",
    )
    for group, name in GROUP_SHARES.items():
        table = shares.where(F.col("group_name") == group).select(
            F.col("level").alias(group), F.col("share").alias(name)
        )
        matrix = lookup_join(matrix, table, [group], spread=["order_id"], written=True)
    return matrix.select(*ORDER_MATRIX_COLUMNS, *extra, "period", *GROUP_SHARES.values())


def group_means(rows: DataFrame, groups: Sequence[str], flag: Column) -> DataFrame:
    """(group_name, level, share): mean of a flag per level of several group columns.

    One pass over the rows for all of them, combined map-side before the shuffle.
    """
    levels = [F.struct(F.lit(g).alias("group_name"), F.col(g).alias("level")) for g in groups]
    flagged = rows.select(flag.alias("_flag"), F.inline(F.array(*levels)))
    return flagged.groupBy("group_name", "level").agg(F.avg("_flag").alias("share"))


CUSTOMER_ATTRIBUTES = ["country", "sales_region", "customer_type", "maturity", "stars_txt", "visit_code"]
COMMON_CUSTOMER_COLUMNS = [
    "customer_id",
    "n_prev",
    "n_channels",
    "n_digital",
    "n_nondigital",
    "digital_share",
    "billed_sum",
    "billed_mean",
    "billed_std",
    "items_sum",
    "items_mean",
    "items_std",
    "boxes_sum",
    "boxes_mean",
    "boxes_std",
    "gap_mean",
    "gap_median",
    "gap_min",
    "gap_max",
]
RECENCY_COLUMNS = [
    "days_since_last",
    *[f"n_{d}d" for d in C.RECENCY_DAYS],
    *[f"billed_{d}d" for d in C.RECENCY_DAYS],
    *[f"used_digital_{d}d" for d in C.RECENCY_DAYS],
]
TREND_COLUMNS = ["trend_billed", "trend_items", "trend_boxes", "digital_last3", "digital_trend"]
CHANGE_COLUMNS = ["n_changes", "change_rate", "n_to_digital", "n_from_digital", "to_digital_ratio"]
FIXED_COLUMNS = ["country", "sales_region", "customer_type", "maturity", "stars_val", "visit_len", "split_date"]


def history_rows(history: History, recent: bool = False) -> History:
    """Mark the rows on the entity's last date (``is_last``) and describe the others.

    Rows of one entity sort by time, so lags of the earlier rows never see the last
    date, and one pass serves both the history and the target. ``recent`` also marks
    the three latest rows of the history.
    """
    spec = history.spec
    state = F.col(spec.state)
    collapsed = C.collapse_state(state, spec.positive, spec.negative)
    marked = history.annotate(
        lag={"_prev_raw": spec.state, "_prev_time": spec.time},
        position="_position",
        last_time="last_time",
        derive={
            "is_last": F.when(F.col(spec.time) == F.col("last_time"), 1).otherwise(0),
            "state2": collapsed,
            # The first row has no previous state; a NULL state before counts as negative.
            "prev_state2": F.when(
                F.col("_position") > 1, C.collapse_state(F.col("_prev_raw"), spec.positive, spec.negative)
            ),
            "gap": F.datediff(F.col(spec.time), F.col("_prev_time")),
            "days_before_last": F.datediff(F.col("last_time"), F.col(spec.time)),
        },
    ).map(
        lambda rows: rows.withColumns(
            C.change_flags(F.col("prev_state2"), F.col("state2"), spec.positive)
        )
    )
    if not recent:
        return marked
    # Three rows on, a row of the latest three meets the last date or the end.
    return marked.annotate(lead={"_three_on": ("is_last", 3)}).map(
        lambda rows: rows.withColumn(
            "is_recent",
            F.when((F.col("is_last") == 0) & (F.coalesce("_three_on", F.lit(1)) == 1), 1).otherwise(0),
        )
    )


def _in_history(value: Column) -> Column:
    return F.when(F.col("is_last") == 0, value)


def customer_aggregates(spec: HistorySpec, recent: bool = False, attributes: Sequence[str] = ()) -> list[Column]:
    """All per-entity aggregates over the rows of ``history_rows``, for one groupBy."""
    digital = C.state_flag(F.col("state2"), spec.positive)
    when = F.struct(*spec.order_columns)
    gap = _in_history(F.col("gap"))
    columns = [
        F.sum(_in_history(F.lit(1))).alias("n_prev"),
        F.sum(_in_history(F.when(F.col(spec.time).isNotNull(), 1))).alias("_n_dated"),
        F.sum(_in_history(digital)).alias("n_digital"),
        F.avg(gap).alias("gap_mean"),
        # Exact: keeps distinct gaps only, at most one per day of the covered period.
        F.percentile(gap, F.lit(0.5)).alias("gap_median"),
        F.min(gap).alias("gap_min"),
        F.max(gap).alias("gap_max"),
        F.sum(gap).alias("_gap_sum"),
        F.count(gap).alias("_gap_count"),
        F.sum("is_last").alias("_n_last"),
        F.max("last_time").alias("_last_time"),
        F.max(_in_history(F.col(spec.time))).alias("_history_time"),
    ]
    for name, measure in spec.measures.items():
        value = _in_history(F.col(measure))
        columns += [
            F.sum(value).alias(f"{name}_sum"),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev(value).alias(f"{name}_std"),
            F.count(value).alias(f"_{name}_count"),
        ]
    if attributes:
        # A struct keeps the attributes of one row together and is compared once.
        columns.append(
            F.min_by(F.struct(*attributes), _in_history(when)).alias("_first")
        )
    if recent:
        first_measure = F.col(next(iter(spec.measures.values())))
        days = F.col("days_before_last")
        columns += [
            F.min(_in_history(days)).alias("days_since_last"),
            F.max_by("state2", _in_history(when)).alias("latest_channel"),
            F.sum(_in_history(F.col("changed"))).alias("n_changes"),
            F.avg(_in_history(F.col("changed"))).alias("change_rate"),
            F.sum(_in_history(F.col("to_positive"))).alias("n_to_digital"),
            F.sum(_in_history(F.col("from_positive"))).alias("n_from_digital"),
            F.avg(F.when(F.col("is_recent") == 1, digital)).alias("digital_last3"),
        ]
        for limit, flag in C.within_days(days).items():
            inside = (F.col("is_last") == 0) & (flag == 1)
            columns += [
                F.sum(_in_history(flag)).alias(f"n_{limit}d"),
                F.coalesce(F.sum(F.when(inside, first_measure)), F.lit(0.0)).alias(f"billed_{limit}d"),
                F.max(F.when(inside, digital).otherwise(0)).alias(f"used_digital_{limit}d"),
            ]
        for name, measure in spec.measures.items():
            columns.append(
                F.avg(F.when(F.col("is_recent") == 1, F.col(measure))).alias(f"_{name}_last3")
            )
    return columns


def _finish(base: DataFrame, spec: HistorySpec, recent: bool) -> DataFrame:
    """Columns that follow from the aggregates row by row."""
    n, digital = F.col("n_prev"), F.col("n_digital")
    columns = {
        "n_nondigital": n - digital,
        "n_channels": F.when(digital > 0, 1).otherwise(0) + F.when(n > digital, 1).otherwise(0),
        "digital_share": C.ratio(digital, n),
    }
    columns |= {f"{m}_std": F.coalesce(f"{m}_std", F.lit(0.0)) for m in spec.measures}
    if recent:
        columns |= {f"trend_{m}": C.smoothed_ratio(F.col(f"_{m}_last3"), F.col(f"{m}_mean")) for m in spec.measures}
        columns["digital_last3"] = F.coalesce("digital_last3", F.lit(0.0))
        columns["digital_trend"] = F.when(
            F.coalesce("digital_last3", F.lit(0.0)) > C.ratio(digital, n), 1
        ).otherwise(0)
        columns["to_digital_ratio"] = C.smoothed_ratio(F.col("n_to_digital"), F.col("n_changes"))
    return base.withColumns(columns)


def _fixed(base: DataFrame, split_on: str) -> DataFrame:
    first = F.col("_first")
    return base.withColumns(
        {
            **{c: first[c] for c in ("country", "sales_region", "customer_type", "maturity")},
            "stars_val": C.whole_number(first["stars_txt"]),
            "visit_len": F.length(first["visit_code"]),
            "split_date": F.col("_history_time" if split_on == "history_max" else "_last_time"),
        }
    )


def customer_binary_matrix(
    orders: DataFrame | History,
    spec: HistorySpec = ORDERS,
    split_on: str = "history_max",
    heavy: HeavyKeys | None | str = "find",
    heavy_rows: int = HEAVY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per customer with a single order on the last date and some history.

    The target is whether that last order is positive; every feature looks at the
    orders before it.
    """
    history = history_rows(History.of(orders, spec, heavy, heavy_rows, block_rows), recent=True)
    label = F.max(F.when(F.col("is_last") == 1, C.state_flag(F.col(spec.state), spec.positive)))
    base = history.aggregate(
        *customer_aggregates(spec, recent=True, attributes=CUSTOMER_ATTRIBUTES), label.alias("target")
    ).where((F.col("_n_last") == 1) & (F.col("n_prev") > 0))
    return _fixed(_finish(base, spec, recent=True), split_on).select(
        *COMMON_CUSTOMER_COLUMNS,
        *RECENCY_COLUMNS,
        *TREND_COLUMNS,
        "latest_channel",
        *CHANGE_COLUMNS,
        *FIXED_COLUMNS,
        "target",
    )


def customer_transition_matrix(
    orders: DataFrame | History,
    spec: HistorySpec = ORDERS,
    ties: str = "drop",
    split_on: str = "target",
    heavy: HeavyKeys | None | str = "find",
    heavy_rows: int = HEAVY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per customer with the four-class code of its last state change.

    ``ties='drop'`` leaves out customers with several orders on the last date.
    ``ties='fanout'`` yields one row per such order, and its history counts every
    earlier order once per such order, as a join on the customer would. The repeated
    rows are never built: their statistics follow from the number of repeats.
    """
    if ties not in ("drop", "fanout"):
        raise ValueError(f"ties must be 'drop' or 'fanout': {ties}")
    code = C.transition_code(F.col("_prev_raw"), F.col(spec.state), spec.positive, C.BACKWARD_CODES)
    history = history_rows(History.of(orders, spec, heavy, heavy_rows, block_rows)).map(
        lambda rows: rows.withColumn("target", F.when(F.col("is_last") == 1, code))
    )
    attributes = [*CUSTOMER_ATTRIBUTES, "agency_id", "route_id"]
    base = history.aggregate(
        *customer_aggregates(spec, attributes=attributes),
        F.max("target").alias("target"),
        F.count("target").alias("_n_targets"),
    ).where((F.col("n_prev") > 0) & (F.col("_n_targets") > 0))
    if ties == "drop":
        base = base.where(F.col("_n_last") == 1)
    else:
        base = _repeat_history(base, spec)
    first = F.col("_first")
    matrix = _fixed(_finish(base, spec, recent=False), split_on).withColumns(
        {
            "agency_num": C.suffix_number(first["agency_id"], C.AGENCY_SUFFIX),
            "route_num": C.suffix_number(first["route_id"], C.ROUTE_SUFFIX),
        }
    )
    features = [*COMMON_CUSTOMER_COLUMNS, "agency_num", "route_num", *FIXED_COLUMNS]
    if ties == "drop":
        return matrix.select(*features, "target")
    targets = (
        history.rows().where(F.col("target").isNotNull()).select(spec.entity, *spec.tiebreak, "target")
    )
    return dimension_join(
        targets, matrix.select(*features), spec.entity, history.heavy, spread=list(spec.tiebreak)
    ).select(*features, "target")


def _repeat_history(base: DataFrame, spec: HistorySpec) -> DataFrame:
    """Statistics of a history in which every row stands ``k`` times in a row.

    Copies of one order are 0 days apart. With two copies or more these zeros are at
    least half of all gaps, so the median gap is 0.
    """
    k = F.col("_n_targets")
    zeros = (k - 1) * F.coalesce("_n_dated", F.lit(0))
    gaps = F.col("_gap_count") + zeros
    columns = {
        "n_prev": F.col("n_prev") * k,
        "n_digital": F.col("n_digital") * k,
        "gap_mean": F.when(gaps > 0, F.coalesce("_gap_sum", F.lit(0)) / gaps),
        "gap_median": F.when(zeros > 0, F.lit(0.0)).otherwise(F.col("gap_median")),
        "gap_min": F.when(zeros > 0, F.lit(0)).otherwise(F.col("gap_min")),
        "gap_max": F.when(zeros > 0, F.coalesce("gap_max", F.lit(0))).otherwise(F.col("gap_max")),
    }
    for name in spec.measures:
        n, std = F.col(f"_{name}_count"), F.coalesce(f"{name}_std", F.lit(0.0))
        columns[f"{name}_sum"] = F.col(f"{name}_sum") * k
        columns[f"{name}_std"] = F.when(
            n * k > 1, F.sqrt(std * std * F.greatest(n - 1, F.lit(0)) * k / (n * k - 1))
        )
    return base.withColumns(columns)
