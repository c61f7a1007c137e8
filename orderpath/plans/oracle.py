"""The catalog's queries as plain SQL over the given tables, for checking results."""

from __future__ import annotations

CORE = """
order_core AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DIGITAL'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'REP'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'PHONE' ELSE 'STORE' END AS channel,
    o_totalprice AS billed_usd
  FROM orders)"""

FULL = (
    CORE
    + """,
lines AS (
  SELECT l_orderkey AS order_id, COUNT(DISTINCT l_partkey) AS distinct_items, SUM(l_quantity) AS boxes
  FROM lineitem GROUP BY l_orderkey),
order_history AS (
  SELECT o.order_id, o.customer_id, o.order_date, o.channel, o.billed_usd,
    CAST(COALESCE(l.distinct_items, 0) AS BIGINT) AS distinct_items, COALESCE(l.boxes, 0.0) AS boxes,
    r_name AS country, n_name AS sales_region,
    CASE WHEN o.customer_id % 17 = 0 THEN 'UNASSIGNED'
         ELSE concat('N', CAST(n_regionkey AS VARCHAR), '-A', CAST(n_nationkey AS VARCHAR)) END AS agency_id,
    CASE WHEN o.customer_id % 19 = 0 THEN 'UNASSIGNED'
         ELSE concat('Z-R', CAST(o.customer_id % 60 AS VARCHAR)) END AS route_id,
    c_mktsegment AS customer_type,
    CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'LOW'
         WHEN c_acctbal < 6500 THEN 'MEDIUM' ELSE 'HIGH' END AS maturity,
    CASE WHEN o.customer_id % 11 = 0 THEN 'N/A' ELSE CAST(1 + o.customer_id % 5 AS VARCHAR) END AS stars_txt,
    substring('LMXJVS', 1, CAST(1 + o.customer_id % 6 AS INT)) AS visit_code
  FROM order_core o
  LEFT JOIN customer ON c_custkey = o.customer_id
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN lines l ON l.order_id = o.order_id)"""
)

IS_D = "CASE WHEN channel = 'DIGITAL' THEN 1 ELSE 0 END"
FORWARD = """CASE WHEN channel <> 'DIGITAL' AND next_state <> 'DIGITAL' THEN 0
  WHEN channel <> 'DIGITAL' AND next_state = 'DIGITAL' THEN 1
  WHEN channel = 'DIGITAL' AND next_state = 'DIGITAL' THEN 2
  WHEN channel = 'DIGITAL' AND next_state <> 'DIGITAL' THEN 3 END"""
BACKWARD = """CASE WHEN prev_state <> 'DIGITAL' AND channel <> 'DIGITAL' THEN 0
  WHEN prev_state = 'DIGITAL' AND channel = 'DIGITAL' THEN 1
  WHEN prev_state <> 'DIGITAL' AND channel = 'DIGITAL' THEN 2
  WHEN prev_state = 'DIGITAL' AND channel <> 'DIGITAL' THEN 3 END"""
PERIOD = "CASE WHEN order_date < DATE '2000-01-01' THEN 'TRAIN' ELSE 'TEST' END"
MATURITY = "CASE maturity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 END"
STARS = "TRY_CAST(stars_txt AS INT)"
W = "WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)"


def sequence(source: str) -> str:
    """Rows with a next state, then lags and positions on what is left."""
    return f"""
ahead AS (SELECT *, lead(channel) OVER w AS next_state FROM {source} {W}),
placed AS (
  SELECT *, lag(channel) OVER w AS prev_state, lag(order_date) OVER w AS prev_date,
    row_number() OVER w - 1 AS n_prev, min(order_date) OVER (PARTITION BY customer_id) AS first_date,
    {IS_D} AS dig, {FORWARD} AS code
  FROM ahead WHERE next_state IS NOT NULL {W})"""


SEQ_CORE = CORE + "," + sequence("order_core")
SEQ_FULL = FULL + "," + sequence("order_history")

RUNNING = (
    SEQ_FULL
    + """,
gapped AS (
  SELECT *, order_date - prev_date AS gap,
    CASE WHEN distinct_items > 0 THEN boxes / distinct_items ELSE 0.0 END AS bpi FROM placed),
running AS (
  SELECT *,
    avg(billed_usd) OVER p AS billed_mean_prev, sum(billed_usd) OVER p AS billed_sum_prev,
    stddev_samp(billed_usd) OVER p AS billed_std_prev,
    CAST(sum(dig) OVER p AS BIGINT) AS digital_prev,
    avg(gap) OVER p AS gap_mean_prev, stddev_samp(gap) OVER p AS gap_std_prev,
    avg(distinct_items) OVER p AS items_mean_prev, CAST(sum(distinct_items) OVER p AS BIGINT) AS items_sum_prev,
    avg(boxes) OVER p AS boxes_mean_prev, sum(boxes) OVER p AS boxes_sum_prev,
    avg(bpi) OVER p AS boxes_per_item_mean_prev,
    avg(billed_usd) OVER r AS billed_mean_last3, avg(dig) OVER r AS digital_mean_last3,
    avg(1 - dig) OVER r AS nondigital_mean_last3, avg(distinct_items) OVER r AS items_mean_last3,
    avg(boxes) OVER r AS boxes_mean_last3
  FROM gapped
  WINDOW p AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
)

SHARES = """CAST(n_prev - digital_prev AS BIGINT) AS nondigital_prev,
  ROUND(CASE WHEN n_prev > 0 THEN digital_prev / n_prev ELSE 0.0 END, 6) AS digital_share_prev,
  ROUND(CASE WHEN n_prev > 0 THEN (n_prev - digital_prev) / n_prev ELSE 0.0 END, 6) AS nondigital_share_prev"""


def _round0(name: str, digits: int = 6) -> str:
    return f"ROUND(COALESCE({name}, 0.0), {digits}) AS {name}"


ORDER_MATRIX = f"""
  customer_id, order_id, country, sales_region, agency_id, route_id, customer_type, maturity, stars_txt, visit_code,
  {{target}} AS target, dig AS is_digital, CASE WHEN prev_state = 'DIGITAL' THEN 1 ELSE 0 END AS prev_is_digital,
  ROUND(billed_usd, 6) AS billed_usd, CAST(COALESCE(gap, 0) AS INT) AS days_since_prev, CAST(n_prev AS INT) AS n_prev,
  {_round0('billed_mean_prev')}, {_round0('billed_sum_prev')}, {_round0('billed_std_prev', 4)},
  COALESCE(digital_prev, 0) AS digital_prev, {SHARES},
  {_round0('billed_mean_last3')}, {_round0('digital_mean_last3')}, {_round0('nondigital_mean_last3')},
  {_round0('gap_mean_prev')}, {_round0('gap_std_prev', 4)},
  distinct_items, {_round0('items_mean_prev')}, COALESCE(items_sum_prev, 0) AS items_sum_prev, {_round0('items_mean_last3')},
  boxes, {_round0('boxes_mean_prev')}, {_round0('boxes_sum_prev')}, {_round0('boxes_mean_last3')},
  ROUND(bpi, 6) AS boxes_per_item, {_round0('boxes_per_item_mean_prev')},
  CAST(month(order_date) AS INT) AS month, CAST(dayofweek(order_date) + 1 AS INT) AS day_of_week,
  CASE WHEN dayofweek(order_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, CAST(quarter(order_date) AS INT) AS quarter,
  CAST(order_date - first_date AS INT) AS tenure_days, order_date"""

MATRIX4 = (
    RUNNING
    + f""",
matrix4 AS (
  SELECT {ORDER_MATRIX.format(target='code')},
    COALESCE({MATURITY}, 0) AS maturity_val, COALESCE({STARS}, 0) AS stars_val,
    CAST(length(visit_code) AS INT) AS visit_len, {PERIOD} AS period
  FROM running WHERE n_prev > 0 AND code IS NOT NULL),
agency AS (SELECT agency_id, AVG(CASE WHEN target IN (2, 3) THEN 1 ELSE 0 END) AS s FROM matrix4 WHERE period = 'TRAIN' GROUP BY 1),
route AS (SELECT route_id, AVG(CASE WHEN target IN (2, 3) THEN 1 ELSE 0 END) AS s FROM matrix4 WHERE period = 'TRAIN' GROUP BY 1)"""
)
MATRIX2 = (
    RUNNING
    + f""",
matrix2 AS (
  SELECT {ORDER_MATRIX.format(target="CASE WHEN next_state = 'DIGITAL' THEN 1 ELSE 0 END")}, {PERIOD} AS period
  FROM running WHERE n_prev > 0)"""
)

NUMBERS = [
    "is_digital", "prev_is_digital", "billed_usd", "days_since_prev", "n_prev", "billed_mean_prev", "billed_sum_prev",
    "billed_std_prev", "digital_prev", "nondigital_prev", "digital_share_prev", "nondigital_share_prev",
    "billed_mean_last3", "digital_mean_last3", "nondigital_mean_last3", "gap_mean_prev", "gap_std_prev",
    "distinct_items", "items_mean_prev", "items_sum_prev", "items_mean_last3", "boxes", "boxes_mean_prev",
    "boxes_sum_prev", "boxes_mean_last3", "boxes_per_item", "boxes_per_item_mean_prev", "month", "day_of_week",
    "is_weekend", "quarter", "tenure_days",
]
CATEGORIES = [
    "country", "sales_region", "agency_id", "route_id", "customer_type", "maturity", "stars_txt", "visit_code",
]
CORRELATED = ["billed_usd", "n_prev", "digital_share_prev", "gap_mean_prev", "distinct_items", "boxes", "tenure_days"]

TRAIN2 = (
    MATRIX2
    + """,
top_routes AS (SELECT route_id FROM matrix2 GROUP BY 1 ORDER BY COUNT(*) DESC, route_id LIMIT 20),
train2 AS (
  SELECT * REPLACE (CASE WHEN route_id IN (SELECT route_id FROM top_routes) THEN route_id ELSE 'OTHER_ROUTE' END AS route_id)
  FROM matrix2 WHERE period = 'TRAIN')"""
)

CUSTOMER_BASE = (
    FULL
    + f""",
marked AS (
  SELECT *, lag(channel) OVER w AS prev_state, max(order_date) OVER (PARTITION BY customer_id) AS last_date
  FROM order_history {W}),
lasts AS (
  SELECT customer_id, {BACKWARD} AS code, {IS_D} AS dig, order_date AS target_date,
    COUNT(*) OVER (PARTITION BY customer_id) AS n_last
  FROM marked WHERE order_date = last_date)"""
)

HISTORY_FEATURES = """
steps AS (
  SELECT *, order_date - lag(order_date) OVER h AS gap, lag(ch2) OVER h AS prev2,
    row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC, copy DESC) AS rn
  FROM past WINDOW h AS (PARTITION BY customer_id ORDER BY order_date, order_id, copy)),
features AS (
  SELECT customer_id, COUNT(*) AS n_prev, COUNT(DISTINCT ch2) AS n_channels,
    COUNT(*) FILTER (ch2 = 'DIGITAL') AS n_digital, COUNT(*) FILTER (ch2 <> 'DIGITAL') AS n_nondigital,
    COUNT(*) FILTER (ch2 = 'DIGITAL') / COUNT(*) AS digital_share,
    SUM(billed_usd) AS billed_sum, AVG(billed_usd) AS billed_mean, COALESCE(stddev_samp(billed_usd), 0) AS billed_std,
    CAST(SUM(distinct_items) AS BIGINT) AS items_sum, AVG(distinct_items) AS items_mean,
    COALESCE(stddev_samp(distinct_items), 0) AS items_std,
    SUM(boxes) AS boxes_sum, AVG(boxes) AS boxes_mean, COALESCE(stddev_samp(boxes), 0) AS boxes_std,
    AVG(gap) AS gap_mean, quantile_cont(gap, 0.5) AS gap_median,
    CAST(MIN(gap) AS INT) AS gap_min, CAST(MAX(gap) AS INT) AS gap_max,
    first(country ORDER BY order_date, order_id) AS country,
    first(sales_region ORDER BY order_date, order_id) AS sales_region,
    first(customer_type ORDER BY order_date, order_id) AS customer_type,
    first(maturity ORDER BY order_date, order_id) AS maturity,
    TRY_CAST(first(stars_txt ORDER BY order_date, order_id) AS INT) AS stars_val,
    CAST(length(first(visit_code ORDER BY order_date, order_id)) AS INT) AS visit_len,
    MAX(order_date) AS history_date,
    TRY_CAST(regexp_extract(first(agency_id ORDER BY order_date, order_id), 'A(\\d+)$', 1) AS INT) AS agency_num,
    TRY_CAST(regexp_extract(first(route_id ORDER BY order_date, order_id), 'R(\\d+)$', 1) AS INT) AS route_num,
    CAST(MIN(days) AS INT) AS days_since_last,
    CAST(SUM(CASE WHEN days <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_30d,
    CAST(SUM(CASE WHEN days <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_60d,
    CAST(SUM(CASE WHEN days <= 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_90d,
    COALESCE(SUM(billed_usd) FILTER (days <= 30), 0) AS billed_30d,
    COALESCE(SUM(billed_usd) FILTER (days <= 60), 0) AS billed_60d,
    COALESCE(SUM(billed_usd) FILTER (days <= 90), 0) AS billed_90d,
    MAX(CASE WHEN days <= 30 AND ch2 = 'DIGITAL' THEN 1 ELSE 0 END) AS used_digital_30d,
    MAX(CASE WHEN days <= 60 AND ch2 = 'DIGITAL' THEN 1 ELSE 0 END) AS used_digital_60d,
    MAX(CASE WHEN days <= 90 AND ch2 = 'DIGITAL' THEN 1 ELSE 0 END) AS used_digital_90d,
    AVG(billed_usd) FILTER (rn <= 3) / (AVG(billed_usd) + 1) AS trend_billed,
    AVG(distinct_items) FILTER (rn <= 3) / (AVG(distinct_items) + 1) AS trend_items,
    AVG(boxes) FILTER (rn <= 3) / (AVG(boxes) + 1) AS trend_boxes,
    AVG(CASE WHEN ch2 = 'DIGITAL' THEN 1 ELSE 0 END) FILTER (rn <= 3) AS digital_last3,
    last(ch2 ORDER BY order_date, order_id, copy) AS latest_channel,
    CAST(SUM(CASE WHEN prev2 <> ch2 THEN 1 ELSE 0 END) AS BIGINT) AS n_changes,
    AVG(CASE WHEN prev2 <> ch2 THEN 1 ELSE 0 END) AS change_rate,
    CAST(SUM(CASE WHEN prev2 <> 'DIGITAL' AND ch2 = 'DIGITAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_to_digital,
    CAST(SUM(CASE WHEN prev2 = 'DIGITAL' AND ch2 <> 'DIGITAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_from_digital
  FROM steps GROUP BY customer_id)"""
PAST = """
past AS (
  SELECT m.*, CASE WHEN channel = 'DIGITAL' THEN 'DIGITAL' ELSE 'NO_DIGITAL' END AS ch2,
    last_date - order_date AS days, k.copy, k.target_date
  FROM marked m JOIN {keys} k ON k.customer_id = m.customer_id
  WHERE m.order_date IS DISTINCT FROM m.last_date)"""

CUSTOMER2 = (
    CUSTOMER_BASE
    + ", targets AS (SELECT customer_id, dig AS target, target_date, 0 AS copy FROM lasts WHERE n_last = 1),"
    + PAST.format(keys="targets")
    + ","
    + HISTORY_FEATURES
)
COMMON = """f.customer_id, n_prev, n_channels, n_digital, n_nondigital, ROUND(digital_share, 6) AS digital_share,
  ROUND(billed_sum, 6) AS billed_sum, ROUND(billed_mean, 6) AS billed_mean, ROUND(billed_std, 4) AS billed_std,
  items_sum, ROUND(items_mean, 6) AS items_mean, ROUND(items_std, 4) AS items_std,
  ROUND(boxes_sum, 6) AS boxes_sum, ROUND(boxes_mean, 6) AS boxes_mean, ROUND(boxes_std, 4) AS boxes_std,
  ROUND(gap_mean, 6) AS gap_mean, ROUND(gap_median, 6) AS gap_median, gap_min, gap_max"""
RECENCY = """days_since_last, n_30d, n_60d, n_90d, ROUND(billed_30d, 6) AS billed_30d, ROUND(billed_60d, 6) AS billed_60d,
  ROUND(billed_90d, 6) AS billed_90d, used_digital_30d, used_digital_60d, used_digital_90d"""
TREND = "ROUND(trend_billed, 6) AS trend_billed, ROUND(trend_items, 6) AS trend_items, ROUND(trend_boxes, 6) AS trend_boxes"
DTREND = "ROUND(digital_last3, 6) AS digital_last3, CASE WHEN digital_last3 > digital_share THEN 1 ELSE 0 END AS digital_trend"
CHANGE = """n_changes, ROUND(change_rate, 6) AS change_rate, n_to_digital, n_from_digital,
  ROUND(n_to_digital / (n_changes + 1), 6) AS to_digital_ratio"""
FIXED = "country, sales_region, customer_type, maturity, stars_val, visit_len"


def customer2(columns: str) -> str:
    return f"WITH {CUSTOMER2} SELECT {columns} FROM features f JOIN targets t ON t.customer_id = f.customer_id"


def customer4(ties: str) -> str:
    keep = "n_last = 1" if ties == "drop" else "TRUE"
    targets = f""", targets AS (
  SELECT customer_id, code AS target, target_date, row_number() OVER (PARTITION BY customer_id) AS copy
  FROM lasts WHERE {keep} AND code IS NOT NULL),"""
    body = CUSTOMER_BASE + targets + PAST.format(keys="targets") + "," + HISTORY_FEATURES
    return f"""WITH {body} SELECT {COMMON}, agency_num, route_num, {FIXED}, t.target_date AS split_date, t.target
  FROM features f JOIN targets t ON t.customer_id = f.customer_id"""


def unpivot(columns: list[str], kind: str, name: str, value: str, extra: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {extra} '{c}' AS {name}, CAST({c} AS {kind}) AS {value} FROM {source}" for c in columns
    )


SCORED = (
    SEQ_FULL
    + f""",
shares AS (
  SELECT *, sum(dig) OVER p AS d, """
    + ", ".join(f"sum(CASE WHEN code = {k} THEN 1 ELSE 0 END) OVER p AS c{k}" for k in range(4))
    + f"""
  FROM placed WINDOW p AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (
  SELECT order_id, {PERIOD} AS period, maturity AS segment, d / n_prev AS score,
    CASE WHEN next_state = 'DIGITAL' THEN 1 ELSE 0 END AS label, code AS label4,
    c0 / n_prev AS p0, c1 / n_prev AS p1, c2 / n_prev AS p2, c3 / n_prev AS p3
  FROM shares WHERE n_prev > 0),
scored AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction,
    CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1
         WHEN p2 >= p3 THEN 2 ELSE 3 END AS prediction4
  FROM rated),
long AS ("""
    + " UNION ALL ".join(
        f"SELECT period, segment, {k} AS class, CASE WHEN label4 = {k} THEN 1 ELSE 0 END AS hit, p{k} AS score FROM scored"
        for k in range(4)
    )
    + ")"
)


def confusion_cte(by: str, label: str, prediction: str, classes: str, source: str) -> str:
    return f"""
cells AS (
  SELECT g.{by}, CAST(a.c AS INT) AS actual, CAST(p.c AS INT) AS predicted,
    (SELECT COUNT(*) FROM {source} s WHERE s.{by} = g.{by} AND s.{label} = a.c AND s.{prediction} = p.c) AS n
  FROM (SELECT DISTINCT {by} FROM {source}) g, (VALUES {classes}) a(c), (VALUES {classes}) p(c))"""


CELLS4 = SCORED + "," + confusion_cte("period", "label4", "prediction4", "(0), (1), (2), (3)", "scored")
REPORT = (
    CELLS4
    + """,
sides AS (
  SELECT period, class, SUM(CASE WHEN actual = class THEN n ELSE 0 END) AS support,
    SUM(CASE WHEN predicted = class THEN n ELSE 0 END) AS called,
    SUM(CASE WHEN actual = class AND predicted = class THEN n ELSE 0 END) AS hits
  FROM cells, (VALUES (0), (1), (2), (3)) v(class) GROUP BY 1, 2),
rates AS (
  SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM sides),
classes AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rates)"""
)


def auc_cte(by: str, label: str, score: str, source: str) -> str:
    """Mann-Whitney statistic with average ranks."""
    return f"""
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk
  FROM {source}),
areas AS (
  SELECT {by}, CAST(SUM({label}) AS BIGINT) AS positives, CAST(SUM(1 - {label}) AS BIGINT) AS negatives,
    (SUM(CASE WHEN {label} = 1 THEN rk ELSE 0 END) - SUM({label}) * (SUM({label}) + 1) / 2.0)
      / (SUM({label}) * SUM(1 - {label})) AS auc
  FROM ranked GROUP BY {by})"""


def box_sql(long_cte: str, by: str) -> str:
    return f"""{long_cte},
quart AS (
  SELECT measure, {by}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3, COUNT(value) AS n FROM long GROUP BY 1, 2),
fenced AS (
  SELECT l.value, q.*, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
  FROM long l JOIN quart q ON q.measure = l.measure AND q.{by} = l.{by})
SELECT measure, {by}, MAX(n) AS n, ROUND(MAX(q1), 6) AS q1, ROUND(MAX(median), 6) AS median, ROUND(MAX(q3), 6) AS q3,
  ROUND(MIN(value) FILTER (inside), 6) AS whisker_low, ROUND(MAX(value) FILTER (inside), 6) AS whisker_high,
  COUNT(*) FILTER (NOT inside) AS outliers
FROM fenced GROUP BY 1, 2"""


def histogram_sql(ctes: str, value: str, source: str, bins: int) -> str:
    return f"""WITH {ctes},
lim AS (SELECT CAST(MIN({value}) AS DOUBLE) AS lo, CAST(MAX({value}) AS DOUBLE) AS hi FROM {source}),
wid AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END / {bins}.0 AS w FROM lim),
slots AS (SELECT LEAST(CAST(floor(({value} - lo) / w) AS INT), {bins - 1}) AS bin, COUNT(*) AS n FROM {source}, wid GROUP BY 1)
SELECT CAST(b.bin AS INT) AS bin, ROUND(lo + b.bin * w, 6) AS lower, ROUND(lo + (b.bin + 1) * w, 6) AS upper, COALESCE(n, 0) AS n
FROM range({bins}) b(bin) CROSS JOIN wid LEFT JOIN slots s ON s.bin = b.bin"""


WOE_NUMERIC = ["digital_share", "n_nondigital", "stars_val", "n_digital", "billed_mean"]
IV_TERMS = """
weighed AS (
  SELECT b.variable, b.bin, b.lower, n_event, n_other,
    CASE WHEN n_event > 0 AND n_other > 0 THEN ln((n_other / others) / (n_event / events)) ELSE 0.0 END AS woe,
    CASE WHEN n_event > 0 AND n_other > 0
      THEN (n_other / others - n_event / events) * ln((n_other / others) / (n_event / events)) ELSE 0.0 END AS iv
  FROM bins b JOIN (SELECT variable, SUM(n_event) AS events, SUM(n_other) AS others FROM bins GROUP BY 1) t
    ON t.variable = b.variable)"""


def bins_cte(numeric: list[str], categorical: list[str], source: str, bins: int) -> str:
    nothing = "SELECT target, CAST(NULL AS VARCHAR) AS variable, NULL AS value FROM {} WHERE FALSE".format(source)
    return f"""
nums AS ({unpivot(numeric, 'DOUBLE', 'variable', 'value', 'target,', source) or nothing}),
cats AS ({unpivot(categorical, 'VARCHAR', 'variable', 'value', 'target,', source) or nothing}),
slot AS (
  SELECT variable, value, target, CASE WHEN value IS NULL THEN 'MISSING' ELSE CAST(LEAST(
    ((rank() OVER (PARTITION BY variable, value IS NULL ORDER BY value) - 1) * {bins})
      // COUNT(*) OVER (PARTITION BY variable, value IS NULL), {bins - 1}) AS VARCHAR) END AS bin
  FROM nums),
bins AS (
  SELECT variable, bin, MIN(value) AS lower, SUM(target) AS n_event, SUM(1 - target) AS n_other FROM slot GROUP BY 1, 2
  UNION ALL
  SELECT variable, COALESCE(value, 'MISSING'), NULL, SUM(target), SUM(1 - target) FROM cats GROUP BY 1, 2),{IV_TERMS}"""


def _cut_paths(bins: int) -> str:
    """All ways to cut the fine bins into at most ``bins`` segments of rising or falling event rates."""
    parts = []
    for k in range(1, bins + 1):
        tables = ["seg s1", *[f"JOIN seg s{i} ON s{i}.variable = s{i - 1}.variable AND s{i}.i = s{i - 1}.j" for i in range(2, k + 1)]]
        rise = " AND ".join(f"s{i}.rate <= s{i + 1}.rate" for i in range(1, k)) or "TRUE"
        fall = " AND ".join(f"s{i}.rate >= s{i + 1}.rate" for i in range(1, k)) or "TRUE"
        cuts = ", ".join(f"s{i}.j AS c{i}" if i < k else f"CAST(NULL AS BIGINT) AS c{i}" for i in range(1, bins))
        parts.append(
            f"SELECT s1.variable, {k} AS k, {' + '.join(f's{i}.value' for i in range(1, k + 1))} AS total, {cuts} FROM {' '.join(tables)}"
            f" JOIN ends ON ends.variable = s1.variable WHERE s1.i = 0 AND s{k}.j = ends.m AND (({rise}) OR ({fall}))"
        )
    return " UNION ALL ".join(parts)


def optimal_bins_cte(numeric: list[str], categorical: list[str], source: str, fine: int, bins: int) -> str:
    """As ``bins_cte`` with the cuts of the best information value among all of them."""
    before = bins_cte(numeric, categorical, source, fine).split("bins AS (")[0]
    cuts = ", ".join(f"c{i}" for i in range(1, bins))
    place = " + ".join(f"COALESCE(CAST(p.pos > c{i} AS INT), 0)" for i in range(1, bins))
    return f"""{before}
fine AS (SELECT variable, bin, MIN(value) AS lower, SUM(target) AS n_event, SUM(1 - target) AS n_other FROM slot GROUP BY 1, 2),
sums AS (SELECT variable, SUM(n_event) AS events, SUM(n_other) AS others FROM fine GROUP BY 1),
pre AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY CAST(bin AS INT)) AS pos FROM fine WHERE bin <> 'MISSING'),
ends AS (SELECT variable, MAX(pos) AS m FROM pre GROUP BY 1),
runs AS (SELECT a.variable, a.pos - 1 AS i, b.pos AS j, SUM(c.n_event) AS e, SUM(c.n_other) AS o
  FROM pre a JOIN pre b ON b.variable = a.variable AND b.pos >= a.pos JOIN pre c ON c.variable = a.variable AND c.pos BETWEEN a.pos AND b.pos
  GROUP BY 1, 2, 3),
seg AS (SELECT runs.variable, i, j, e / (e + o) AS rate,
    CASE WHEN e > 0 AND o > 0 THEN (o / others - e / events) * ln((o / others) / (e / events)) ELSE 0.0 END AS value
  FROM runs JOIN sums ON sums.variable = runs.variable),
paths AS ({_cut_paths(bins)}),
best AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY variable ORDER BY round(total, 10) DESC, k, {cuts}) = 1),
bins AS (
  SELECT p.variable, CAST({place} AS VARCHAR) AS bin, MIN(p.lower) AS lower, SUM(p.n_event) AS n_event, SUM(p.n_other) AS n_other
  FROM pre p JOIN best ON best.variable = p.variable GROUP BY 1, 2
  UNION ALL
  SELECT variable, bin, NULL, n_event, n_other FROM fine WHERE bin = 'MISSING'
  UNION ALL
  SELECT variable, COALESCE(value, 'MISSING'), NULL, SUM(target), SUM(1 - target) FROM cats GROUP BY 1, 2),{IV_TERMS}"""


TRAIN_CUSTOMERS = (
    CUSTOMER2
    + f""",
mx AS (SELECT {COMMON}, {FIXED}, CASE WHEN history_date < DATE '2001-06-01' THEN 'TRAIN' ELSE 'TEST' END AS period, t.target
  FROM features f JOIN targets t ON t.customer_id = f.customer_id),
tr AS (SELECT * FROM mx WHERE period = 'TRAIN')"""
)


def _woe_column(v: str) -> str:
    """Highest bin whose lower edge is not above the value; the first one below all edges."""
    table = f"(SELECT bin, lower, woe FROM weighed WHERE variable = '{v}')"
    return f"""ROUND(CASE WHEN mx.{v} IS NULL THEN COALESCE((SELECT woe FROM {table} x WHERE bin = 'MISSING'), 0.0)
      ELSE COALESCE(
        (SELECT max_by(woe, lower) FROM {table} x WHERE bin <> 'MISSING' AND lower <= mx.{v}),
        (SELECT min_by(woe, lower) FROM {table} x WHERE bin <> 'MISSING')) END, 6) AS {v}_woe"""


EVENT_SEQ = """
ahead AS (SELECT *, lead(event_type) OVER w AS next_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
placed AS (
  SELECT *, row_number() OVER w - 1 AS n_prev,
    date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS gap,
    date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) AS tenure,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS dig
  FROM ahead WHERE next_state IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def share_of(keys: str, by: str, source: str) -> str:
    counted = f"SELECT {keys}, COUNT(*) AS n FROM {source} GROUP BY {keys}"
    return f"SELECT *, ROUND(n / SUM(n) OVER ({by}), 6) AS share FROM ({counted})"


ORDER_COLUMNS = [
    ("order_id", "bigint", "numeric"),
    ("customer_id", "bigint", "numeric"),
    ("order_date", "date", "other"),
    ("channel", "string", "category"),
    ("billed_usd", "double", "numeric"),
    ("distinct_items", "bigint", "numeric"),
    ("boxes", "double", "numeric"),
    *[(c, "string", "category") for c in CATEGORIES],
]

CRAMERS = (
    "pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, COALESCE({a}, 'MISSING') AS la, COALESCE({b}, 'MISSING') AS lb FROM train2"
        for i, a in enumerate(CATEGORIES)
        for b in CATEGORIES[i:]
    )
    + """), cells AS (SELECT variable_a, variable_b, la, lb, COUNT(*) AS n FROM pairs GROUP BY ALL),
      sums AS (SELECT *, SUM(n) OVER (PARTITION BY variable_a, variable_b, la) AS na, SUM(n) OVER (PARTITION BY variable_a, variable_b, lb) AS nb FROM cells),
      q AS (SELECT variable_a, variable_b, SUM(n * n / (na * nb)) AS q, LEAST(COUNT(DISTINCT la), COUNT(DISTINCT lb)) - 1 AS k FROM sums GROUP BY 1, 2),
      related AS (SELECT variable_a, variable_b, CASE WHEN k > 0 THEN sqrt(GREATEST(q - 1, 0) / k) ELSE 0 END AS v FROM q)"""
)


def greedy_sql(ctes: str, limit: float) -> str:
    """Walk the variables by falling information value; ``related`` holds pair strengths."""
    return f"""WITH RECURSIVE {TRAIN2}, {ctes},
      ivs AS (SELECT variable, ROUND(SUM(iv), 9) AS iv, row_number() OVER (ORDER BY ROUND(SUM(iv), 9) DESC, variable) AS place
        FROM weighed GROUP BY 1),
      rivals AS (SELECT a AS variable, list(b) AS list FROM (
        SELECT variable_a AS a, variable_b AS b, v FROM related UNION ALL SELECT variable_b, variable_a, v FROM related)
        WHERE abs(v) >= {limit} AND a <> b GROUP BY 1),
      walk AS (
        SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS kept
        UNION ALL
        SELECT i.place, CASE WHEN i.iv >= 0.0005 AND NOT list_has_any(w.kept, COALESCE(r.list, CAST([] AS VARCHAR[])))
          THEN list_append(w.kept, i.variable) ELSE w.kept END
        FROM walk w JOIN ivs i ON i.place = w.place + 1 LEFT JOIN rivals r ON r.variable = i.variable),
      final AS (SELECT kept FROM walk ORDER BY place DESC LIMIT 1)
      SELECT CAST(list_position(kept, variable) AS INT) AS rank, variable, ROUND(iv, 6) AS iv
      FROM ivs, final WHERE list_contains(kept, variable)"""


LONG_NUMBERS = f"""WITH {FULL},
long AS ({unpivot(['billed_usd', 'distinct_items', 'boxes'], 'DOUBLE', 'measure', 'value', 'channel,', 'order_history')})"""

ORACLES: dict[str, str] = {
    "scan_order_history": f"WITH {FULL} SELECT * FROM order_history",
    "preview_orders": f"WITH {FULL} SELECT * FROM order_history ORDER BY order_id LIMIT 5",
    "columns_by_kind": f"WITH {FULL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, '{group}' AS kind, COUNT({c}) AS known_values FROM order_history"
        for c, kind, group in ORDER_COLUMNS
    ),
    "encode_attributes": f"""WITH {FULL} SELECT order_id, {MATURITY} AS maturity_val, {STARS} AS stars_val,
      CAST(length(visit_code) AS INT) AS visit_len, TRY_CAST(regexp_extract(agency_id, 'A(\\d+)$', 1) AS INT) AS agency_num,
      TRY_CAST(regexp_extract(route_id, 'R(\\d+)$', 1) AS INT) AS route_num, CAST(order_date AS TIMESTAMP) AS order_time
      FROM order_history""",
    "calendar_parts": f"""WITH {CORE} SELECT order_id, CAST(month(order_date) AS INT) AS month,
      CAST(dayofweek(order_date) + 1 AS INT) AS day_of_week, CASE WHEN dayofweek(order_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
      CAST(quarter(order_date) AS INT) AS quarter, strftime(order_date, '%Y-%m') AS year_month FROM order_core""",
    "year_month_series": f"WITH {CORE} SELECT strftime(order_date, '%Y-%m') AS year_month, channel, COUNT(*) AS n FROM order_core GROUP BY 1, 2",
    "state_flags": f"""WITH {CORE}, s AS (SELECT *, lag(channel) OVER w AS prev_state, lead(channel) OVER w AS next_state FROM order_core {W})
      SELECT order_id, prev_state, next_state, {IS_D} AS is_digital,
        CASE WHEN prev_state = 'DIGITAL' THEN 1 ELSE 0 END AS prev_is_digital,
        CASE WHEN channel = 'DIGITAL' THEN 'DIGITAL' ELSE 'NO_DIGITAL' END AS channel2 FROM s""",
    "transition_code_forward": f"WITH {SEQ_CORE} SELECT order_id, code AS target FROM placed WHERE code IS NOT NULL",
    "transition_code_backward": f"""WITH {CORE}, s AS (SELECT *, lag(channel) OVER w AS prev_state FROM order_core {W})
      SELECT order_id, {BACKWARD} AS target FROM s WHERE {BACKWARD} IS NOT NULL""",
    "binary_targets": f"WITH {SEQ_CORE} SELECT order_id, CASE WHEN next_state = 'DIGITAL' THEN 1 ELSE 0 END AS target FROM placed",
    "temporal_split": f"WITH {CORE} SELECT order_id, {PERIOD} AS period FROM order_core",
    "split_balance": f"""WITH {SEQ_FULL}, m AS (SELECT CAST(code AS VARCHAR) AS target, CAST(COALESCE({MATURITY}, 0) AS VARCHAR) AS maturity_val,
        {PERIOD} AS period FROM placed WHERE n_prev > 0 AND code IS NOT NULL)
      SELECT 'ALL' AS period, 'period' AS variable, period AS level, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
      FROM m GROUP BY m.period
      UNION ALL SELECT period, 'target', target, COUNT(*), ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY period), 6) FROM m GROUP BY period, target
      UNION ALL SELECT period, 'maturity_val', maturity_val, COUNT(*), ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY period), 6)
      FROM m GROUP BY period, maturity_val""",
    "split_balance_customers": f"""WITH {CUSTOMER2}, m AS (
        SELECT CAST(t.target AS VARCHAR) AS target, CAST(COALESCE({MATURITY}, 0) AS VARCHAR) AS maturity_val,
          CASE WHEN history_date < DATE '2001-06-01' THEN 'TRAIN' ELSE 'TEST' END AS period
        FROM features f JOIN targets t ON t.customer_id = f.customer_id WHERE history_date IS NOT NULL)
      SELECT 'ALL' AS period, 'period' AS variable, period AS level, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
      FROM m GROUP BY m.period
      UNION ALL SELECT period, 'target', target, COUNT(*), ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY period), 6) FROM m GROUP BY period, target
      UNION ALL SELECT period, 'maturity_val', maturity_val, COUNT(*), ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY period), 6)
      FROM m GROUP BY period, maturity_val""",
    "order_gaps": f"WITH {SEQ_FULL} SELECT order_id, CAST(order_date - prev_date AS INT) AS days_since_prev FROM placed",
    "prior_counts": f"WITH {SEQ_FULL} SELECT order_id, CAST(n_prev AS INT) AS n_prev FROM placed WHERE n_prev > 0",
    "prior_measure_stats": f"""WITH {RUNNING} SELECT order_id, {_round0('billed_mean_prev')}, {_round0('billed_sum_prev')},
      {_round0('billed_std_prev', 4)}, {_round0('items_mean_prev')}, COALESCE(items_sum_prev, 0) AS items_sum_prev,
      {_round0('boxes_mean_prev')}, {_round0('boxes_sum_prev')} FROM running""",
    "prior_state_usage": f"WITH {RUNNING} SELECT order_id, digital_prev, {SHARES} FROM running",
    "prior_gap_stats": f"WITH {RUNNING} SELECT order_id, ROUND(gap_mean_prev, 6) AS gap_mean_prev, ROUND(gap_std_prev, 4) AS gap_std_prev FROM running",
    "recent3_means": f"WITH {RUNNING} SELECT order_id, "
    + ", ".join(f"ROUND({c}_last3, 6) AS {c}_last3" for c in ("billed_mean", "digital_mean", "nondigital_mean", "items_mean", "boxes_mean"))
    + " FROM running",
    "prior_ratio_mean": f"""WITH {RUNNING} SELECT order_id, ROUND(bpi, 6) AS boxes_per_item,
      ROUND(boxes_per_item_mean_prev, 6) AS boxes_per_item_mean_prev FROM running""",
    "tenure_days": f"WITH {SEQ_FULL} SELECT order_id, CAST(order_date - first_date AS INT) AS tenure_days FROM placed",
    "last_order_split": f"""WITH {CORE}, s AS (SELECT *, max(order_date) OVER (PARTITION BY customer_id) AS last_date FROM order_core)
      SELECT order_id, customer_id, last_date, CASE WHEN order_date = last_date THEN 1 ELSE 0 END AS is_last FROM s""",
    "unambiguous_customers": f"""WITH {CORE}, s AS (SELECT *, max(order_date) OVER (PARTITION BY customer_id) AS last_date FROM order_core)
      SELECT customer_id, MAX(last_date) AS last_date FROM s WHERE order_date = last_date GROUP BY 1 HAVING COUNT(*) = 1""",
    "history_semi_join": f"""WITH {CORE}, s AS (SELECT *, max(order_date) OVER (PARTITION BY customer_id) AS last_date FROM order_core),
      keys AS (SELECT customer_id FROM s WHERE order_date = last_date GROUP BY 1 HAVING COUNT(*) = 1)
      SELECT order_id, customer_id, CAST(last_date - order_date AS INT) AS days_before_last,
        CASE WHEN channel = 'DIGITAL' THEN 'DIGITAL' ELSE 'NO_DIGITAL' END AS channel2
      FROM s WHERE order_date <> last_date AND customer_id IN (SELECT customer_id FROM keys)""",
    "history_fanout_join": f"""WITH {CORE}, s AS (SELECT *, lag(channel) OVER w AS prev_state,
        max(order_date) OVER (PARTITION BY customer_id) AS last_date FROM order_core {W}),
      t AS (SELECT customer_id, last_date AS target_date FROM s WHERE order_date = last_date AND {BACKWARD} IS NOT NULL)
      SELECT order_id, s.customer_id, target_date, CAST(target_date - order_date AS INT) AS days_before_last, COUNT(*) AS copies
      FROM s JOIN t ON t.customer_id = s.customer_id WHERE order_date <> last_date GROUP BY ALL""",
    "customer_counts": customer2("f.customer_id, n_prev, n_channels"),
    "customer_measures": customer2(
        """f.customer_id, ROUND(billed_sum, 6) AS billed_sum, ROUND(billed_mean, 6) AS billed_mean, ROUND(billed_std, 4) AS billed_std,
        items_sum, ROUND(items_mean, 6) AS items_mean, ROUND(items_std, 4) AS items_std, ROUND(boxes_sum, 6) AS boxes_sum,
        ROUND(boxes_mean, 6) AS boxes_mean, ROUND(boxes_std, 4) AS boxes_std"""
    ),
    "customer_gap_stats": customer2(
        "f.customer_id, ROUND(gap_mean, 6) AS gap_mean, ROUND(gap_median, 6) AS gap_median, gap_min, gap_max"
    ),
    "customer_state_pivot": customer2("f.customer_id, n_digital, n_nondigital, ROUND(digital_share, 6) AS digital_share"),
    "customer_recency_windows": customer2(f"f.customer_id, {RECENCY}"),
    "customer_change_stats": customer2(f"f.customer_id, {CHANGE}"),
    "customer_attributes": customer2(f"f.customer_id, {FIXED}, history_date AS split_date"),
    "latest_state": customer2("f.customer_id, latest_channel"),
    "last3_trends": customer2(f"f.customer_id, {TREND}"),
    "digital_trend_flag": customer2(f"f.customer_id, {DTREND}"),
    "group_mean_encoding": f"""WITH {SEQ_FULL}, m AS (SELECT * FROM placed WHERE n_prev > 0 AND code IS NOT NULL AND {PERIOD} = 'TRAIN')
      SELECT 'agency_id' AS group_name, agency_id AS level, ROUND(AVG(CASE WHEN code IN (2, 3) THEN 1 ELSE 0 END), 6) AS digital_share FROM m GROUP BY 2
      UNION ALL SELECT 'route_id', route_id, ROUND(AVG(CASE WHEN code IN (2, 3) THEN 1 ELSE 0 END), 6) FROM m GROUP BY 2""",
    "group_encoding_join": f"""WITH {MATRIX4} SELECT order_id, ROUND(agency.s, 6) AS agency_digital_share, ROUND(route.s, 6) AS route_digital_share
      FROM matrix4 m LEFT JOIN agency ON agency.agency_id = m.agency_id LEFT JOIN route ON route.route_id = m.route_id""",
    "top20_lumping": f"""WITH {SEQ_FULL}, m AS (SELECT order_id, route_id FROM placed WHERE n_prev > 0),
      top AS (SELECT route_id FROM m GROUP BY 1 ORDER BY COUNT(*) DESC, route_id LIMIT 20)
      SELECT order_id, CASE WHEN route_id IN (SELECT route_id FROM top) THEN route_id ELSE 'OTHER_ROUTE' END AS route_id FROM m""",
    "category_codes": f"WITH {FULL}, filled AS (SELECT * REPLACE (COALESCE(maturity, 'MISSING') AS maturity) FROM order_history), "
    + ", ".join(
        f"c_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
        f"(SELECT DISTINCT {c} AS v FROM filled WHERE order_date < DATE '2000-01-01'))"
        for c in CATEGORIES
    )
    + " SELECT order_id, "
    + ", ".join(f"COALESCE(c_{c}.code, (SELECT CAST(COUNT(*) AS INT) FROM c_{c})) AS {c}_code" for c in CATEGORIES)
    + " FROM filled f "
    + " ".join(f"LEFT JOIN c_{c} ON c_{c}.v = f.{c}" for c in CATEGORIES),
    "matrix_order_multiclass": f"""WITH {MATRIX4} SELECT m.*, ROUND(agency.s, 6) AS agency_digital_share, ROUND(route.s, 6) AS route_digital_share
      FROM matrix4 m LEFT JOIN agency ON agency.agency_id = m.agency_id LEFT JOIN route ON route.route_id = m.route_id""",
    "matrix_order_binary": f"WITH {MATRIX2} SELECT * FROM matrix2",
    "matrix_customer_binary": customer2(
        f"{COMMON}, {RECENCY}, {TREND}, {DTREND}, latest_channel, {CHANGE}, {FIXED}, history_date AS split_date, t.target"
    ),
    "matrix_customer_multiclass": customer4("drop"),
    "matrix_customer_multiclass_fanout": customer4("fanout"),
    "null_profile": f"WITH {FULL}, t AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 6) AS null_share FROM order_history"
        for c, _, _ in ORDER_COLUMNS
    )
    + ") SELECT * FROM t ORDER BY null_share DESC, column_name LIMIT 10",
    "numeric_profile": f"""WITH {FULL}, long AS ({unpivot(['billed_usd', 'distinct_items', 'boxes'], 'DOUBLE', 'column_name', 'value', '', 'order_history')})
      SELECT column_name, COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, ROUND(stddev_samp(value), 4) AS std, ROUND(MIN(value), 6) AS min,
        ROUND(MAX(value), 6) AS max, CAST(SUM(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
        ROUND(quantile_cont(value, 0.25), 6) AS q1, ROUND(quantile_cont(value, 0.5), 6) AS median, ROUND(quantile_cont(value, 0.75), 6) AS q3
      FROM long GROUP BY 1""",
    "category_profile": f"""WITH {FULL}, long AS ({unpivot(['channel', *CATEGORIES], 'VARCHAR', 'column_name', 'value', '', 'order_history')})
      SELECT column_name, value, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM order_history), 6) AS share FROM long GROUP BY 1, 2""",
    "state_frequency_by": f"""WITH {FULL}, long AS (
      {unpivot(['channel', 'country', 'customer_type', 'maturity', 'visit_code'], 'VARCHAR', 'attribute', 'level', 'channel,', 'order_history')})
      SELECT attribute, level, channel, COUNT(*) AS n FROM long GROUP BY ALL""",
    "regions_in_country": f"""WITH {FULL}, c AS (SELECT country, sales_region, channel, COUNT(*) AS n FROM order_history GROUP BY ALL),
      t AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY country, sales_region) AS BIGINT) AS level_total FROM c)
      SELECT *, CAST(dense_rank() OVER (PARTITION BY country ORDER BY level_total DESC, sales_region) AS INT) AS level_rank FROM t""",
    "box_stats": box_sql(LONG_NUMBERS, "channel"),
    "customer_state_frequency": box_sql(
        f"""WITH {CORE}, long AS (SELECT 'events_per_entity' AS measure, channel, CAST(COUNT(*) AS DOUBLE) AS value
        FROM order_core GROUP BY customer_id, channel)""",
        "channel",
    ),
    "orders_histogram": histogram_sql(
        f"{CORE}, k AS (SELECT customer_id, COUNT(*) AS v FROM order_core GROUP BY 1)", "v", "k", 20
    ),
    "states_histogram": histogram_sql(
        f"{CORE}, k AS (SELECT customer_id, COUNT(DISTINCT channel) AS v FROM order_core GROUP BY 1)", "v", "k", 10
    ),
    "orders_summary": f"""WITH {CORE}, k AS (SELECT COUNT(*) AS v FROM order_core GROUP BY customer_id)
      SELECT 'orders_per_customer' AS column_name, COUNT(v) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_samp(v), 4) AS std,
        CAST(MIN(v) AS DOUBLE) AS min, CAST(MAX(v) AS DOUBLE) AS max, ROUND(quantile_cont(v, 0.25), 6) AS q1,
        ROUND(quantile_cont(v, 0.5), 6) AS median, ROUND(quantile_cont(v, 0.75), 6) AS q3 FROM k""",
    "transition_matrix": f"WITH {SEQ_CORE} " + share_of("channel, next_state", "PARTITION BY channel", "placed"),
    "next_state_by_segment": f"""WITH {SEQ_FULL}, long AS (
      {unpivot(['maturity', 'customer_type', 'country'], 'VARCHAR', 'segment', 'level', 'next_state,', 'placed')}) """
    + share_of("segment, level, next_state", "PARTITION BY segment, level", "long"),
    "next_state_columns": f"WITH {SEQ_FULL} SELECT maturity, "
    + ", ".join(f"COUNT(*) FILTER (next_state = '{s}') AS \"{s}\"" for s in ("DIGITAL", "REP", "PHONE", "STORE"))
    + " FROM placed GROUP BY 1",
    "state_mix_by_rating": f"WITH {FULL} " + share_of("stars_txt, channel", "PARTITION BY stars_txt", "order_history"),
    "target_distribution": f"WITH {SEQ_CORE} SELECT CASE WHEN next_state = 'DIGITAL' THEN 1 ELSE 0 END AS target, COUNT(*) AS n FROM placed GROUP BY 1",
    "distinct_levels": f"""WITH {FULL}, long AS ({unpivot(['country', 'maturity', 'channel'], 'VARCHAR', 'column_name', 'level', '', 'order_history')})
      SELECT DISTINCT column_name, level FROM long""",
    "iv_table": f"""WITH {TRAIN2}, {bins_cte(NUMBERS, CATEGORIES, 'train2', 10)}
      SELECT variable, ROUND(SUM(iv), 6) AS iv, COUNT(*) AS n_bins FROM weighed GROUP BY 1""",
    "pearson_matrix": f"WITH {TRAIN2} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, ROUND(corr({a}, {b}), 6) + 0.0 AS correlation FROM train2"
        for a in CORRELATED
        for b in CORRELATED
    ),
    "cramers_v_matrix": f"WITH {TRAIN2}, {CRAMERS} SELECT variable_a, variable_b, ROUND(v, 6) AS cramers_v FROM related",
    "select_numeric": greedy_sql(
        bins_cte(NUMBERS, [], "train2", 10)
        + ", wide AS (SELECT "
        + ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])
        + """ FROM train2),
      related AS (SELECT split_part(pair, '|', 1) AS variable_a, split_part(pair, '|', 2) AS variable_b, v
        FROM (UNPIVOT wide ON COLUMNS(*) INTO NAME pair VALUE v))""",
        0.4,
    ),
    "select_categorical": greedy_sql(bins_cte([], CATEGORIES, "train2", 10) + "," + CRAMERS, 0.5),
    "vif": f"""WITH {TRAIN2}, r AS (SELECT corr(digital_share_prev, is_digital) AS r FROM train2)
      SELECT 'digital_share_prev' AS variable, ROUND(1 / (1 - r * r), 6) AS vif FROM r
      UNION ALL SELECT 'is_digital', ROUND(1 / (1 - r * r), 6) FROM r""",
    "class_weights": f"""WITH {SEQ_CORE} SELECT code AS target, COUNT(*) AS n,
      ROUND(SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)), 6) AS weight FROM placed WHERE n_prev > 0 AND code IS NOT NULL GROUP BY 1""",
    "confusion": f"WITH {CELLS4} SELECT * FROM cells",
    "classification_report": f"""WITH {REPORT}
      SELECT period, CAST(class AS VARCHAR) AS entry, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
        CAST(support AS BIGINT) AS support FROM classes
      UNION ALL SELECT period, 'accuracy', ROUND(SUM(hits) / SUM(support), 6), ROUND(SUM(hits) / SUM(support), 6),
        ROUND(SUM(hits) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM classes GROUP BY 1
      UNION ALL SELECT period, 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT)
        FROM classes GROUP BY 1
      UNION ALL SELECT period, 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6),
        ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM classes GROUP BY 1""",
    "balanced_accuracy": f"WITH {REPORT} SELECT period, ROUND(AVG(recall), 6) AS balanced_accuracy FROM classes WHERE support > 0 GROUP BY 1",
    "auc_binary": f"WITH {SCORED}, {auc_cte('period', 'label', 'score', 'scored')} SELECT period, positives, negatives, ROUND(auc, 6) AS auc FROM areas",
    "auc_ovr": f"""WITH {SCORED}, {auc_cte('period, class', 'hit', 'score', 'long')}
      SELECT period, class, positives, negatives, ROUND(auc, 6) AS auc FROM areas""",
    "gini": f"""WITH {SCORED}, {auc_cte('period, class', 'hit', 'score', 'long')},
      a AS (SELECT period, AVG(auc) AS m, SUM(auc * positives) / SUM(positives) AS w FROM areas GROUP BY 1)
      SELECT period, ROUND(m, 6) AS auc_macro, ROUND(w, 6) AS auc_weighted, ROUND(2 * m - 1, 6) AS gini_macro, ROUND(2 * w - 1, 6) AS gini_weighted FROM a""",
    "segment_eval": f"""WITH {SCORED}, known AS (SELECT * FROM scored WHERE period = 'TEST' AND segment IS NOT NULL),
      {auc_cte('segment', 'label', 'score', 'known')}
      SELECT segment, positives, negatives, ROUND(auc, 6) AS auc, ROUND(2 * auc - 1, 6) AS gini FROM areas""",
    "segment_confusion": f"""WITH {SCORED}, known AS (SELECT * FROM scored WHERE period = 'TEST' AND segment IS NOT NULL),
      {confusion_cte('segment', 'label', 'prediction', '(0), (1)', 'known')} SELECT * FROM cells""",
    "segment_eval_ovr": f"""WITH {SCORED}, known AS (SELECT * FROM long WHERE period = 'TEST' AND segment IS NOT NULL),
      {auc_cte('segment, class', 'hit', 'score', 'known')}
      SELECT segment, class, positives, negatives, ROUND(auc, 6) AS auc, ROUND(2 * auc - 1, 6) AS gini FROM areas""",
    "woe_transform": f"""WITH {TRAIN_CUSTOMERS}, {optimal_bins_cte(WOE_NUMERIC, ['maturity'], 'tr', 20, 5)}
      SELECT mx.customer_id, ROUND(COALESCE(c.woe, 0.0), 6) AS maturity_woe, {', '.join(_woe_column(v) for v in WOE_NUMERIC)}
      FROM mx LEFT JOIN weighed c ON c.variable = 'maturity' AND c.bin = COALESCE(mx.maturity, 'MISSING')""",
    "event_transition_matrix": f"WITH {EVENT_SEQ} " + share_of("event_type, next_state", "PARTITION BY event_type", "placed"),
    "event_running_features": f"""WITH {EVENT_SEQ} SELECT event_id, CAST(n_prev AS INT) AS n_prev, CAST(sum(dig) OVER p AS BIGINT) AS digital_prev,
        ROUND(sum(dig) OVER p / n_prev, 8) AS digital_share_prev, ROUND(avg(value) OVER p, 8) AS value_mean_prev,
        ROUND(sum(value) OVER p, 8) AS value_sum_prev, ROUND(stddev_samp(value) OVER p, 4) AS value_std_prev,
        ROUND(avg(value) OVER r, 8) AS value_mean_last3, ROUND(avg(gap) OVER p, 8) AS gap_mean_prev, CAST(tenure AS INT) AS tenure_days
      FROM placed
      WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
      QUALIFY n_prev > 0""",
    "event_entity_features": """WITH m AS (
        SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'other' END AS s2 FROM events),
      k AS (SELECT user_id FROM m WHERE ts = last_ts GROUP BY 1 HAVING COUNT(*) = 1),
      h AS (SELECT *, lag(s2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p2,
          date_diff('day', CAST(ts AS DATE), CAST(last_ts AS DATE)) AS days FROM m
        WHERE ts <> last_ts AND user_id IN (SELECT user_id FROM k))
      SELECT user_id, COUNT(*) AS n_prev, COUNT(*) FILTER (s2 = 'purchase') AS n_digital, ROUND(SUM(value), 8) AS value_sum,
        ROUND(AVG(value), 8) AS value_mean, CAST(SUM(CASE WHEN p2 <> s2 THEN 1 ELSE 0 END) AS BIGINT) AS n_changes,
        COUNT(*) FILTER (days <= 30) AS n_30d, last(s2 ORDER BY ts, event_id) AS latest_channel
      FROM h GROUP BY 1""",
}

ORACLES["read_orders"] = ORACLES["scan_order_history"]
ORACLES["layout_order_binary"] = ORACLES["matrix_order_binary"]
ORACLES["layout_customer_binary"] = ORACLES["matrix_customer_binary"]
ORACLES["layout_customer_multiclass"] = ORACLES["matrix_customer_multiclass_fanout"]
