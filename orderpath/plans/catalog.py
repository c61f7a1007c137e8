"""Named queries over the order and event tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpath.functions import columns as C
from orderpath.modeling import metrics as M
from orderpath.modeling.boosting import UNWEIGHTED, WEIGHTED, BoostSettings, fit_boosted
from orderpath.modeling.features import category_indexer, fill_missing
from orderpath.modeling.scorecard import WoeEncoder, fit_woe_logistic
from orderpath.operators import association as A
from orderpath.operators import profile as P
from orderpath.operators.history import History
from orderpath.operators.joins import heavy_keys
from orderpath.plans import matrices as X
from orderpath.session import shared_dir, stage_table
from orderpath.sources import tables as S
from orderpath.sources.layout import write_entity_layout
from orderpath.spec import EVENTS, ORDERS

ORDER_CUTOFF = "2000-01-01"
CUSTOMER_CUTOFF = "2001-06-01"

NUMERIC_COLUMNS = [
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
]
CORRELATED = ["billed_usd", "n_prev", "digital_share_prev", "gap_mean_prev", "distinct_items", "boxes", "tenure_days"]
WOE_VARIABLES = ["maturity", "digital_share", "n_nondigital", "stars_val", "n_digital", "billed_mean"]
VIF_PAIR = ["digital_share_prev", "is_digital"]
OTHER_ROUTE = "OTHER_ROUTE"
# Users have up to 99 events: a mean of cents over 64 rows ends in a 5 at the seventh digit.
EVENT_DIGITS = 8


def tidy(df: DataFrame, types: Mapping[str, str] | None = None, digits: int = 6, std_digits: int = 4) -> DataFrame:
    """Round doubles so that sums added up in another order print the same.

    Deviations are irrational and get fewer digits than means of money.
    """
    types = types or {}
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if field.name in types:
            column = column.cast(types[field.name])
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, std_digits if "std" in field.name else digits)
        columns.append(column.alias(field.name))
    return df.select(*columns)


class Tables:
    """The inputs a query can ask for; each is a lazy plan over the parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def heavy(self):
        return S.heavy_customers(self.spark, self.sf_dir)

    @cached_property
    def core(self) -> DataFrame:
        return S.order_core(self.spark, self.sf_dir)

    @cached_property
    def full(self) -> DataFrame:
        return S.order_history(self.spark, self.sf_dir, self.heavy)

    @cached_property
    def measured(self) -> DataFrame:
        return S.order_history(self.spark, self.sf_dir, self.heavy, attributes=False)

    @cached_property
    def described(self) -> DataFrame:
        return S.order_history(self.spark, self.sf_dir, self.heavy, items=False)

    @cached_property
    def laid_out(self) -> History:
        """The full order history, written by customer once."""
        path = f"{shared_dir(self.spark)}/orderpath/layout-{uuid.uuid4().hex}"
        return write_entity_layout(self.full, ORDERS, path, heavy=self.heavy)

    def history(self, rows: DataFrame) -> History:
        return History.of(rows, ORDERS, self.heavy)

    def following(self, rows: DataFrame) -> History:
        return X.with_next_state(self.history(rows))

    @cached_property
    def running(self) -> DataFrame:
        """Running features of every order that has a next one."""
        return X.with_running_features(
            self.following(self.measured), X.ORDER_STATISTICS, X.ORDER_RATIO
        ).rows()

    def order_matrix(self, target: str) -> DataFrame:
        return X.order_matrix(self.full, ORDER_CUTOFF, target, ORDERS, self.heavy)

    @cached_property
    def customers(self) -> DataFrame:
        return X.customer_binary_matrix(self.full, ORDERS, heavy=self.heavy)

    @cached_property
    def binary_matrix(self) -> DataFrame:
        """The binary order matrix, rounded so that its equal values stay equal in SQL."""
        return tidy(self.order_matrix("binary"))

    def binary_train(self, *columns: str) -> DataFrame:
        return self.binary_matrix.where(F.col("period") == "TRAIN").select(*columns)

    def lumped_train(self, *columns: str) -> DataFrame:
        """Training rows with rare routes lumped.

        Written once: the matrix costs a shuffle of all orders, and the association
        statistics read it several times.
        """
        matrix = stage_table(self.binary_matrix.select(*columns, "period"), "matrix")
        return P.lump_rare(matrix, "route_id", 20, OTHER_ROUTE).where(F.col("period") == "TRAIN")

    @cached_property
    def scored(self) -> DataFrame:
        """Past share of the positive state as the score of the next one."""
        history = X.with_next_state(self.history(self.described))
        code = C.transition_code(F.col("channel"), F.col("next_state"), ORDERS.positive, C.FORWARD_CODES)
        counted = history.map(lambda rows: rows.withColumn("label4", code)).annotate(
            position="_position",
            prior={
                "digital_prev": ("sum", C.state_flag(F.col("channel"), ORDERS.positive)),
                **{f"_c{k}": ("sum", F.when(F.col("label4") == k, 1).otherwise(0)) for k in range(4)},
            },
        )
        n = F.col("_position") - 1
        rows = counted.rows().where(n > 0)
        shares = {f"p{k}": F.col(f"_c{k}") / n for k in range(4)}
        score = F.col("digital_prev") / n
        rows = rows.select(
            "order_id",
            C.split_label(F.col("order_date"), ORDER_CUTOFF).alias("period"),
            F.col("maturity").alias("segment"),
            score.alias("score"),
            F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
            C.state_flag(F.col("next_state"), ORDERS.positive).alias("label"),
            "label4",
            *[share.alias(name) for name, share in shares.items()],
        )
        order = F.array(*[F.col(name) for name in shares])
        best = (F.array_position(order, F.array_max(order)) - 1).cast("int")
        return rows.withColumn("prediction4", best)


SCORES4 = {k: f"p{k}" for k in range(4)}


def q_scan(t: Tables) -> DataFrame:
    return tidy(t.full)


def q_read_orders(t: Tables) -> DataFrame:
    """The orders as a user's own flat table has them: other names, times instead of dates."""
    path = f"{shared_dir(t.spark)}/orderpath/flat-orders-{uuid.uuid4().hex}"
    flat = t.full.withColumn("order_date", F.col("order_date").cast("timestamp"))
    flat.withColumnsRenamed({"customer_id": "client", "order_date": "ordered_at"}).write.parquet(path)
    return S.read_orders(t.spark, path, {"customer_id": "client", "order_date": "ordered_at"})


def q_preview(t: Tables) -> DataFrame:
    return tidy(S.preview(t.full, "order_id", 5))


def q_columns(t: Tables) -> DataFrame:
    return S.columns_by_kind(t.full)


def q_encode(t: Tables) -> DataFrame:
    return X.encode_attributes(t.described).select(
        "order_id",
        "maturity_val",
        "stars_val",
        F.col("visit_len").cast("int").alias("visit_len"),
        C.suffix_number(F.col("agency_id"), C.AGENCY_SUFFIX).alias("agency_num"),
        C.suffix_number(F.col("route_id"), C.ROUTE_SUFFIX).alias("route_num"),
        F.col("order_date").cast("timestamp_ntz").alias("order_time"),
    )


def q_calendar(t: Tables) -> DataFrame:
    date = F.col("order_date")
    return t.core.withColumns(C.calendar(date)).select(
        "order_id", "month", "day_of_week", "is_weekend", "quarter", C.year_month(date).alias("year_month")
    )


def q_year_month(t: Tables) -> DataFrame:
    return P.counts(t.core.withColumn("year_month", C.year_month(F.col("order_date"))), "year_month", "channel")


def q_state_flags(t: Tables) -> DataFrame:
    state = F.col("channel")
    rows = t.history(t.core).annotate(lag={"prev_state": "channel"}, lead={"next_state": "channel"}).rows()
    return rows.select(
        "order_id",
        "prev_state",
        "next_state",
        C.state_flag(state, ORDERS.positive).alias("is_digital"),
        C.state_flag(F.col("prev_state"), ORDERS.positive).alias("prev_is_digital"),
        C.collapse_state(state, ORDERS.positive, ORDERS.negative).alias("channel2"),
    )


def q_forward(t: Tables) -> DataFrame:
    code = C.transition_code(F.col("channel"), F.col("next_state"), ORDERS.positive, C.FORWARD_CODES)
    return t.following(t.core).rows().select("order_id", code.alias("target")).where(F.col("target").isNotNull())


def q_backward(t: Tables) -> DataFrame:
    code = C.transition_code(F.col("prev_state"), F.col("channel"), ORDERS.positive, C.BACKWARD_CODES)
    rows = t.history(t.core).annotate(lag={"prev_state": "channel"}).rows()
    return rows.select("order_id", code.alias("target")).where(F.col("target").isNotNull())


def q_targets(t: Tables) -> DataFrame:
    return t.following(t.core).rows().select(
        "order_id", C.state_flag(F.col("next_state"), ORDERS.positive).alias("target")
    )


def q_split(t: Tables) -> DataFrame:
    return t.core.select("order_id", C.split_label(F.col("order_date"), ORDER_CUTOFF).alias("period"))


def q_balance(t: Tables) -> DataFrame:
    rows = t.following(t.described).annotate(position="_position").rows()
    code = C.transition_code(F.col("channel"), F.col("next_state"), ORDERS.positive, C.FORWARD_CODES)
    matrix = rows.where(F.col("_position") > 1).select(
        code.alias("target"),
        F.coalesce(C.ordinal(F.col("maturity"), C.MATURITY_CODES), F.lit(0)).alias("maturity_val"),
        C.split_label(F.col("order_date"), ORDER_CUTOFF).alias("period"),
    )
    return tidy(P.balance_report(matrix.where(F.col("target").isNotNull()), "period", ["target", "maturity_val"]))


def running(*columns: str, types: Mapping[str, str] | None = None, earlier: bool = False):
    """A query that reads some running features; unused ones are pruned from the plan."""

    def query(t: Tables) -> DataFrame:
        rows = t.running.where(F.col("n_prev") > 0) if earlier else t.running
        return tidy(rows.select("order_id", *columns), types)

    return query


def q_measure_stats(t: Tables) -> DataFrame:
    columns = [f"{m}_{s}_prev" for m, stats in X.ORDER_STATISTICS.items() for s in stats]
    return tidy(X.fill_numeric(t.running.select("order_id", *columns)), {"items_sum_prev": "bigint"})


def q_last_split(t: Tables) -> DataFrame:
    rows = t.history(t.core).annotate(
        last_time="last_date",
        derive={"is_last": F.when(F.col("order_date") == F.col("last_date"), 1).otherwise(0)},
    )
    return rows.rows().select("order_id", "customer_id", "last_date", "is_last")


def _last_marked(t: Tables) -> History:
    code = C.transition_code(F.col("_prev_raw"), F.col("channel"), ORDERS.positive, C.BACKWARD_CODES)
    return X.history_rows(t.history(t.core)).map(
        lambda rows: rows.withColumn("_target", F.when(F.col("is_last") == 1, code))
    )


def q_unambiguous(t: Tables) -> DataFrame:
    kept = _last_marked(t).aggregate(F.sum("is_last").alias("n_last"), F.max("last_time").alias("last_date"))
    return kept.where(F.col("n_last") == 1).select("customer_id", "last_date")


def q_semi_history(t: Tables) -> DataFrame:
    rows = _last_marked(t).with_totals(n_last=F.sum("is_last")).rows()
    return rows.where((F.col("n_last") == 1) & (F.col("is_last") == 0)).select(
        "order_id", "customer_id", "days_before_last", F.col("state2").alias("channel2")
    )


def q_fanout_history(t: Tables) -> DataFrame:
    rows = _last_marked(t).with_totals(copies=F.count("_target")).rows()
    return rows.where((F.col("copies") > 0) & (F.col("is_last") == 0)).select(
        "order_id", "customer_id", F.col("last_time").alias("target_date"), "days_before_last", "copies"
    )


def customer(*columns: str, types: Mapping[str, str] | None = None, source: str = "core"):
    """Columns of the customer matrix, from the rows that hold what they need and no more."""

    def query(t: Tables) -> DataFrame:
        rows = getattr(t, source)
        padded = rows.select(
            *[
                F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in S.ORDER_SCHEMA
            ]
        )
        matrix = X.customer_binary_matrix(padded, ORDERS, heavy=t.heavy)
        return tidy(matrix.select("customer_id", *columns), types)

    return query


def q_group_means(t: Tables) -> DataFrame:
    rows = t.following(t.described).annotate(position="_position").rows()
    code = C.transition_code(F.col("channel"), F.col("next_state"), ORDERS.positive, C.FORWARD_CODES)
    train = rows.where(
        (F.col("_position") > 1) & code.isNotNull() & (C.split_label(F.col("order_date"), ORDER_CUTOFF) == "TRAIN")
    )
    shares = X.group_means(train, list(X.GROUP_SHARES), F.when(code.isin(2, 3), 1).otherwise(0))
    return tidy(shares.withColumnRenamed("share", "digital_share"))


def q_encoding_join(t: Tables) -> DataFrame:
    return tidy(t.order_matrix("transition").select("order_id", "agency_digital_share", "route_digital_share"))


def q_lumping(t: Tables) -> DataFrame:
    rows = t.following(t.described).annotate(position="_position").rows().where(F.col("_position") > 1)
    return P.lump_rare(rows.select("order_id", "route_id"), "route_id", 20, OTHER_ROUTE)


def q_category_codes(t: Tables) -> DataFrame:
    rows = fill_missing(t.described, X.ATTRIBUTES, [])
    model = category_indexer(rows.where(F.col("order_date") < F.lit(ORDER_CUTOFF).cast("date")), X.ATTRIBUTES)
    return model.transform(rows, ["order_id"]).select(
        "order_id", *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in X.ATTRIBUTES]
    )


def q_null_profile(t: Tables) -> DataFrame:
    return tidy(P.null_profile(t.full, worst=10))


ORDER_NUMBERS = ["billed_usd", "distinct_items", "boxes"]


def q_numeric_profile(t: Tables) -> DataFrame:
    return tidy(P.numeric_profile(t.measured, ORDER_NUMBERS))


def q_category_profile(t: Tables) -> DataFrame:
    return tidy(P.category_profile(t.described, ["channel", *X.ATTRIBUTES]))


def q_state_frequency(t: Tables) -> DataFrame:
    return P.crossed_counts(t.described, ["channel", "country", "customer_type", "maturity", "visit_code"], "channel")


def q_regions(t: Tables) -> DataFrame:
    return P.nested_counts(t.described, "country", "sales_region", "channel")


def q_box(t: Tables) -> DataFrame:
    return tidy(P.box_statistics(t.measured, "channel", ORDER_NUMBERS))


def q_customer_frequency(t: Tables) -> DataFrame:
    return tidy(P.entity_frequency(t.core, "customer_id", "channel"))


def q_orders_histogram(t: Tables) -> DataFrame:
    return tidy(P.histogram(P.counts(t.core, "customer_id"), "n", 20))


def q_states_histogram(t: Tables) -> DataFrame:
    used = t.core.groupBy("customer_id").agg(F.count_distinct("channel").alias("states"))
    return tidy(P.histogram(used, "states", 10))


def q_orders_summary(t: Tables) -> DataFrame:
    orders = P.counts(t.core, "customer_id").withColumnRenamed("n", "orders_per_customer")
    return tidy(P.distribution(orders, "orders_per_customer"))


def q_transitions(t: Tables) -> DataFrame:
    return tidy(P.transition_matrix(t.following(t.core).rows(), "channel", "next_state"))


def q_segment_mix(t: Tables) -> DataFrame:
    return tidy(P.state_mix(t.following(t.described).rows(), ["maturity", "customer_type", "country"], "next_state"))


def q_segment_columns(t: Tables) -> DataFrame:
    states = [*dict.fromkeys(S.CHANNELS.values()), S.OTHER_CHANNEL]
    return P.state_columns(t.following(t.described).rows(), "maturity", "next_state", states)


def q_rating_mix(t: Tables) -> DataFrame:
    return tidy(P.with_share(P.counts(t.described, "stars_txt", "channel"), "stars_txt"))


def q_target_distribution(t: Tables) -> DataFrame:
    return P.counts(q_targets(t), "target")


def q_levels(t: Tables) -> DataFrame:
    return P.distinct_levels(t.described, ["country", "maturity", "channel"])


def q_iv(t: Tables) -> DataFrame:
    train = t.lumped_train(*NUMERIC_COLUMNS, *X.ATTRIBUTES, "target")
    return tidy(A.information_value(train, NUMERIC_COLUMNS, X.ATTRIBUTES, "target"))


def q_pearson(t: Tables) -> DataFrame:
    return tidy(A.pearson_matrix(t.binary_train(*CORRELATED), CORRELATED))


def q_cramers(t: Tables) -> DataFrame:
    return tidy(A.cramers_v(t.lumped_train(*X.ATTRIBUTES), X.ATTRIBUTES))


def q_select_numeric(t: Tables) -> DataFrame:
    train = stage_table(t.binary_train(*NUMERIC_COLUMNS, "target"), "matrix")
    return tidy(A.select_numeric(train, NUMERIC_COLUMNS, "target", iv_min=0.0005, corr_max=0.4))


def q_select_categorical(t: Tables) -> DataFrame:
    train = t.lumped_train(*X.ATTRIBUTES, "target")
    return tidy(A.select_categorical(train, X.ATTRIBUTES, "target", iv_min=0.0005, v_max=0.5))


def q_vif(t: Tables) -> DataFrame:
    return tidy(A.variance_inflation(t.binary_train(*VIF_PAIR), VIF_PAIR))


def q_class_weights(t: Tables) -> DataFrame:
    rows = t.following(t.core).annotate(position="_position").rows().where(F.col("_position") > 1)
    code = C.transition_code(F.col("channel"), F.col("next_state"), ORDERS.positive, C.FORWARD_CODES)
    return tidy(M.class_weights(rows.select(code.alias("target")).where(F.col("target").isNotNull()), "target"))


def q_confusion(t: Tables) -> DataFrame:
    return M.confusion(t.scored, "label4", "prediction4", list(SCORES4), ["period"])


def q_report(t: Tables) -> DataFrame:
    return tidy(M.classification_report(q_confusion(t), ["period"]))


def q_balanced(t: Tables) -> DataFrame:
    return tidy(M.balanced_accuracy(q_confusion(t), ["period"]))


def q_auc(t: Tables) -> DataFrame:
    return tidy(M.auc(t.scored, "label", "score", ["period"]).drop("gini"))


def q_auc_classes(t: Tables) -> DataFrame:
    return tidy(M.auc_one_vs_rest(t.scored, "label4", SCORES4, ["period"]).drop("gini"))


def q_gini(t: Tables) -> DataFrame:
    return tidy(M.average_auc(M.auc_one_vs_rest(t.scored, "label4", SCORES4, ["period"]), ["period"]))


def q_segments(t: Tables) -> DataFrame:
    known = t.scored.where((F.col("period") == "TEST") & F.col("segment").isNotNull())
    return tidy(M.auc(known, "label", "score", ["segment"]))


def q_segment_confusion(t: Tables) -> DataFrame:
    known = t.scored.where((F.col("period") == "TEST") & F.col("segment").isNotNull())
    return M.confusion(known, "label", "prediction", [0, 1], ["segment"])


def q_segment_classes(t: Tables) -> DataFrame:
    known = t.scored.where((F.col("period") == "TEST") & F.col("segment").isNotNull())
    return tidy(M.auc_one_vs_rest(known, "label4", SCORES4, ["segment"]))


def _customer_periods(matrix: DataFrame) -> DataFrame:
    """A customer without a split date belongs to neither period."""
    label = C.split_label(F.col("split_date"), CUSTOMER_CUTOFF)
    return matrix.withColumn("period", F.when(F.col("split_date").isNotNull(), label))


def q_balance_customers(t: Tables) -> DataFrame:
    matrix = _customer_periods(t.customers).where(F.col("period").isNotNull()).select(
        "period", "target", F.coalesce(C.ordinal(F.col("maturity"), C.MATURITY_CODES), F.lit(0)).alias("maturity_val")
    )
    return tidy(P.balance_report(matrix, "period", ["target", "maturity_val"]))


def q_woe(t: Tables) -> DataFrame:
    columns = ["customer_id", *WOE_VARIABLES, "target", "period"]
    matrix = stage_table(tidy(_customer_periods(t.customers).select(*columns)), "matrix")
    encoder = WoeEncoder.fit(matrix.where(F.col("period") == "TRAIN"), WOE_VARIABLES, "target")
    return tidy(
        encoder.transform(matrix, ["customer_id"]).select("customer_id", *[f"{v}_woe" for v in WOE_VARIABLES])
    )


def evaluation(scored: DataFrame, target: str, scores: Mapping[int, str], by: str = "period") -> DataFrame:
    """Balanced accuracy, areas and Gini per period, in long form."""
    # Two reports read the scores; scoring walks every tree, so it runs once.
    scored = stage_table(scored.select(by, target, "prediction", *scores.values()), "scored")
    matrix = M.confusion(scored, target, "prediction", list(scores), [by])
    areas = M.average_auc(M.auc_one_vs_rest(scored, target, scores, [by]), [by])
    joined = M.balanced_accuracy(matrix, [by]).join(areas, by)
    names = [c for c in joined.columns if c != by]
    return joined.select(
        by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]))
    )


def q_woe_logistic(t: Tables) -> DataFrame:
    columns = ["customer_id", *WOE_VARIABLES, "target", "period"]
    matrix = stage_table(_customer_periods(t.customers).select(*columns), "matrix")
    fitted = fit_woe_logistic(
        matrix.where(F.col("period") == "TRAIN"), WOE_VARIABLES, "target", ["customer_id"], written=True
    )
    scored = fitted.transform(matrix, ["customer_id"]).withColumn("score_0", 1 - F.col("score"))
    return evaluation(scored, "target", {0: "score_0", 1: "score"})


def _customer_model(t: Tables):
    # Read for fitting and again for scoring.
    matrix = stage_table(_customer_periods(t.customers), "matrix")
    model = fit_boosted(
        matrix.where(F.col("period") == "TRAIN"),
        "target",
        "split_date",
        ["customer_id", "period"],
        WEIGHTED,
        written=True,
    )
    return matrix, model


def q_boosted_binary(t: Tables) -> DataFrame:
    matrix, model = _customer_model(t)
    return model.transform(matrix).select("customer_id", "period", "target", "prediction", F.col("score_1").alias("score"))


def q_boosted_binary_eval(t: Tables) -> DataFrame:
    matrix, model = _customer_model(t)
    return evaluation(model.transform(matrix), "target", model.score_columns())


def q_boosted_segments(t: Tables) -> DataFrame:
    """The fitted model per maturity level on the test customers."""
    matrix, model = _customer_model(t)
    test = matrix.where((F.col("period") == "TEST") & F.col("maturity").isNotNull())
    # Scoring fills missing categories, so the segment is the value it saw.
    return evaluation(model.transform(test), "target", model.score_columns(), "maturity")


def q_importance(t: Tables) -> DataFrame:
    matrix, model = _customer_model(t)
    return model.importance(matrix)


def _class_model(t: Tables, settings: BoostSettings) -> DataFrame:
    matrix = stage_table(t.order_matrix("transition"), "matrix")
    model = fit_boosted(
        matrix.where(F.col("period") == "TRAIN"),
        "target",
        "order_date",
        ["customer_id", "order_id", "period"],
        settings,
        written=True,
    )
    return evaluation(model.transform(matrix), "target", model.score_columns())


def q_boosted_classes(t: Tables) -> DataFrame:
    return _class_model(t, WEIGHTED)


def q_boosted_classes_alt(t: Tables) -> DataFrame:
    return _class_model(t, UNWEIGHTED)


def q_boosted_customer_classes(t: Tables) -> DataFrame:
    matrix = stage_table(_customer_periods(X.customer_transition_matrix(t.full, heavy=t.heavy)), "matrix")
    model = fit_boosted(
        matrix.where(F.col("period") == "TRAIN"),
        "target",
        "split_date",
        ["customer_id", "period"],
        WEIGHTED,
        written=True,
    )
    return evaluation(model.transform(matrix), "target", model.score_columns())


CUSTOMER_TYPES = {
    "n_prev": "bigint",
    "n_channels": "bigint",
    "n_digital": "bigint",
    "n_nondigital": "bigint",
    "items_sum": "bigint",
    "gap_min": "int",
    "gap_max": "int",
}


def q_customer_classes(ties: str):
    def query(t: Tables) -> DataFrame:
        return tidy(X.customer_transition_matrix(t.full, ties=ties, heavy=t.heavy), CUSTOMER_TYPES)

    return query


def q_layout_customer_classes(t: Tables) -> DataFrame:
    return tidy(X.customer_transition_matrix(t.laid_out, ties="fanout"), CUSTOMER_TYPES)


def _events(t: Tables) -> History:
    rows = S.event_history(t.spark, t.sf_dir)
    return History.of(rows, EVENTS, heavy_keys(rows, EVENTS.entity))


def q_event_transitions(t: Tables) -> DataFrame:
    return tidy(P.transition_matrix(X.with_next_state(_events(t)).rows(), "event_type", "next_state"))


def q_event_running(t: Tables) -> DataFrame:
    rows = X.with_running_features(X.with_next_state(_events(t)), {"value": ("mean", "sum", "std")}).rows()
    return tidy(
        rows.where(F.col("n_prev") > 0).select(
            "event_id",
            "n_prev",
            "digital_prev",
            "digital_share_prev",
            "value_mean_prev",
            "value_sum_prev",
            "value_std_prev",
            "value_mean_last3",
            "gap_mean_prev",
            "tenure_days",
        ),
        {"digital_prev": "bigint"},
        digits=EVENT_DIGITS,
    )


def q_event_entities(t: Tables) -> DataFrame:
    base = X.history_rows(_events(t), recent=True).aggregate(
        *X.customer_aggregates(EVENTS, recent=True), F.sum("is_last").alias("n_last")
    )
    columns = ["user_id", "n_prev", "n_digital", "value_sum", "value_mean", "n_changes", "n_30d", "latest_channel"]
    return tidy(base.where((F.col("n_last") == 1) & (F.col("n_prev") > 0)).select(*columns), digits=EVENT_DIGITS)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_order_history": q_scan,
    "read_orders": q_read_orders,
    "preview_orders": q_preview,
    "columns_by_kind": q_columns,
    "encode_attributes": q_encode,
    "calendar_parts": q_calendar,
    "year_month_series": q_year_month,
    "state_flags": q_state_flags,
    "transition_code_forward": q_forward,
    "transition_code_backward": q_backward,
    "binary_targets": q_targets,
    "temporal_split": q_split,
    "split_balance": q_balance,
    "split_balance_customers": q_balance_customers,
    "order_gaps": running("days_since_prev"),
    "prior_counts": running("n_prev", earlier=True),
    "prior_measure_stats": q_measure_stats,
    "prior_state_usage": running(
        "digital_prev",
        "nondigital_prev",
        "digital_share_prev",
        "nondigital_share_prev",
        types={"digital_prev": "bigint", "nondigital_prev": "bigint"},
    ),
    "prior_gap_stats": running("gap_mean_prev", "gap_std_prev"),
    "recent3_means": running(
        "billed_mean_last3", "digital_mean_last3", "nondigital_mean_last3", "items_mean_last3", "boxes_mean_last3"
    ),
    "prior_ratio_mean": running("boxes_per_item", "boxes_per_item_mean_prev"),
    "tenure_days": running("tenure_days"),
    "last_order_split": q_last_split,
    "unambiguous_customers": q_unambiguous,
    "history_semi_join": q_semi_history,
    "history_fanout_join": q_fanout_history,
    "customer_counts": customer("n_prev", "n_channels", types=CUSTOMER_TYPES),
    "customer_measures": customer(*X.COMMON_CUSTOMER_COLUMNS[6:15], types=CUSTOMER_TYPES, source="measured"),
    "customer_gap_stats": customer("gap_mean", "gap_median", "gap_min", "gap_max"),
    "customer_state_pivot": customer("n_digital", "n_nondigital", "digital_share"),
    "customer_recency_windows": customer(*X.RECENCY_COLUMNS),
    "customer_change_stats": customer(*X.CHANGE_COLUMNS),
    "customer_attributes": customer(*X.FIXED_COLUMNS, source="described"),
    "latest_state": customer("latest_channel"),
    "last3_trends": customer("trend_billed", "trend_items", "trend_boxes", source="measured"),
    "digital_trend_flag": customer("digital_last3", "digital_trend"),
    "group_mean_encoding": q_group_means,
    "group_encoding_join": q_encoding_join,
    "top20_lumping": q_lumping,
    "category_codes": q_category_codes,
    "matrix_order_multiclass": lambda t: tidy(t.order_matrix("transition")),
    "matrix_order_binary": lambda t: tidy(t.order_matrix("binary")),
    "matrix_customer_binary": lambda t: tidy(t.customers, CUSTOMER_TYPES),
    "matrix_customer_multiclass": q_customer_classes("drop"),
    "matrix_customer_multiclass_fanout": q_customer_classes("fanout"),
    "layout_order_binary": lambda t: tidy(X.order_matrix(t.laid_out, ORDER_CUTOFF, "binary")),
    "layout_customer_binary": lambda t: tidy(X.customer_binary_matrix(t.laid_out), CUSTOMER_TYPES),
    "layout_customer_multiclass": q_layout_customer_classes,
    "null_profile": q_null_profile,
    "numeric_profile": q_numeric_profile,
    "category_profile": q_category_profile,
    "state_frequency_by": q_state_frequency,
    "regions_in_country": q_regions,
    "box_stats": q_box,
    "customer_state_frequency": q_customer_frequency,
    "orders_histogram": q_orders_histogram,
    "states_histogram": q_states_histogram,
    "orders_summary": q_orders_summary,
    "transition_matrix": q_transitions,
    "next_state_by_segment": q_segment_mix,
    "next_state_columns": q_segment_columns,
    "state_mix_by_rating": q_rating_mix,
    "target_distribution": q_target_distribution,
    "distinct_levels": q_levels,
    "iv_table": q_iv,
    "pearson_matrix": q_pearson,
    "cramers_v_matrix": q_cramers,
    "select_numeric": q_select_numeric,
    "select_categorical": q_select_categorical,
    "vif": q_vif,
    "class_weights": q_class_weights,
    "confusion": q_confusion,
    "classification_report": q_report,
    "balanced_accuracy": q_balanced,
    "auc_binary": q_auc,
    "auc_ovr": q_auc_classes,
    "gini": q_gini,
    "segment_eval": q_segments,
    "segment_confusion": q_segment_confusion,
    "segment_eval_ovr": q_segment_classes,
    "woe_transform": q_woe,
    "woe_logistic": q_woe_logistic,
    "boosted_binary": q_boosted_binary,
    "boosted_binary_eval": q_boosted_binary_eval,
    "boosted_segment_eval": q_boosted_segments,
    "boosted_multiclass": q_boosted_classes,
    "boosted_multiclass_alt": q_boosted_classes_alt,
    "boosted_customer_multiclass": q_boosted_customer_classes,
    "feature_importance": q_importance,
    "event_transition_matrix": q_event_transitions,
    "event_running_features": q_event_running,
    "event_entity_features": q_event_entities,
}


def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))
