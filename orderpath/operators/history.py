"""Window features over one entity's ordered events.

Two routes give the same columns:

* ordinary entities share one hash shuffle and one sort on (entity, time, tiebreak);
  every feature is a native window over it;
* entities with very long histories are cut into position blocks of equal size. Each
  block also receives the few rows next to it that lags, leads and trailing means
  look at, and totals of the earlier blocks are carried in for the running statistics.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpath.operators.joins import HEAVY_ROWS, HeavyKeys, heavy_keys, lookup_join, null_safe_join
from orderpath.operators.scan import PIECE, ranged_pieces
from orderpath.session import stage_table
from orderpath.spec import HistorySpec

BLOCK_ROWS = 500_000
MAX_PIECES = 20_000
STATISTICS = ("mean", "sum", "std")


def running_value(statistic: str, value: Column, frame) -> Column:
    if statistic == "mean":
        return F.avg(value).over(frame)
    if statistic == "sum":
        return F.sum(value).over(frame)
    if statistic == "std":
        return F.stddev(value).over(frame)
    raise ValueError(f"statistic must be one of {STATISTICS}: {statistic}")


class History:
    """Rows of an event table, kept apart by the route their entity takes."""

    def __init__(
        self,
        spec: HistorySpec,
        ordinary: DataFrame,
        long: DataFrame | None = None,
        block_rows: int = BLOCK_ROWS,
        written: bool = False,
        heavy: HeavyKeys | None = None,
    ):
        self.spec = spec
        self.ordinary = ordinary
        self.long = long
        self.block_rows = block_rows
        self.heavy = heavy
        self._written = written

    @classmethod
    def of(
        cls,
        rows: DataFrame | History,
        spec: HistorySpec,
        heavy: HeavyKeys | None | str = "find",
        heavy_rows: int = HEAVY_ROWS,
        block_rows: int = BLOCK_ROWS,
    ) -> History:
        """Split the rows by route. ``heavy`` takes keys already known for the table.

        A history, as read from a layout by entity, is already split and stays as it is.
        """
        if isinstance(rows, History):
            return rows
        if heavy == "find":
            heavy = heavy_keys(rows, spec.entity, heavy_rows)
        if heavy is None:
            return cls(spec, rows, None, block_rows)
        keys = heavy.keys()
        match = rows[spec.entity].eqNullSafe(keys["heavy_key"])
        pieces = max(1, min(MAX_PIECES, math.ceil(heavy.rows / block_rows)))
        long = ranged_pieces(
            rows.join(keys, match, "left_semi"), [spec.entity], spec.order_columns, pieces
        )
        return cls(spec, rows.join(keys, match, "left_anti"), long, block_rows, written=True, heavy=heavy)

    def map(self, step: Callable[[DataFrame], DataFrame]) -> History:
        """Apply a row-wise step (filter, projection, explode) to both routes."""
        long = None if self.long is None else step(self.long)
        return self._with(step(self.ordinary), long)

    def _with(self, ordinary: DataFrame, long: DataFrame | None) -> History:
        return History(self.spec, ordinary, long, self.block_rows, heavy=self.heavy)

    def rows(self) -> DataFrame:
        if self.long is None:
            return self.ordinary
        return self.ordinary.unionByName(self.long.drop(PIECE))

    def with_totals(self, **totals: Column) -> History:
        """Add entity-wide aggregates to every row.

        The ordinary route evaluates them as windows on the partitioning at hand. The
        long route combines partial aggregates and joins the few results back.
        """
        entity = Window.partitionBy(self.spec.entity)
        ordinary = self.ordinary.withColumns({out: c.over(entity) for out, c in totals.items()})
        if self.long is None:
            return self._with(ordinary, None)
        rows = self.long if self._written else stage_table(self.long, "history")
        table = rows.groupBy(self.spec.entity).agg(*[c.alias(out) for out, c in totals.items()])
        long = lookup_join(rows, table, [self.spec.entity], spread=self.spec.order_columns)
        return self._with(ordinary, long)

    def aggregate(self, *columns: Column) -> DataFrame:
        """One row per entity. The ordinary route reuses the shuffle of its windows; the
        long route combines partial aggregates, so a long history is not gathered."""
        parts = [p for p in (self.ordinary, self.long) if p is not None]
        return reduce(
            DataFrame.unionByName, [p.groupBy(self.spec.entity).agg(*columns) for p in parts]
        )

    def annotate(
        self,
        *,
        lag: Mapping[str, str] | None = None,
        lead: Mapping[str, str | tuple[str, int]] | None = None,
        position: str | None = None,
        first_time: str | None = None,
        last_time: str | None = None,
        derive: Mapping[str, Column] | None = None,
        prior: Mapping[str, tuple[str, Column]] | None = None,
        trailing: Mapping[str, tuple[Column, int]] | None = None,
    ) -> History:
        """Add window columns.

        ``lag``/``lead`` map an output to a column (``lead`` also to a column and a
        distance); ``position`` names the row number;
        ``first_time``/``last_time`` name the entity's time bounds (the first is NULL on
        rows without a time); ``derive`` holds row-wise expressions over those. ``prior`` maps an output to (statistic,
        expression) over all earlier rows, ``trailing`` to (expression, k) for the mean
        over the k rows before the current one.
        """
        options = dict(
            lag=lag or {},
            lead={out: (c, 1) if isinstance(c, str) else c for out, c in (lead or {}).items()},
            position=position,
            first_time=first_time,
            last_time=last_time,
            derive=derive or {},
            prior=prior or {},
            trailing=trailing or {},
        )
        ordinary = self._by_window(**options)
        if self.long is None:
            return self._with(ordinary, None)
        return self._with(ordinary, self._by_block(**options))

    def _by_window(self, lag, lead, position, first_time, last_time, derive, prior, trailing):
        spec = self.spec
        entity = Window.partitionBy(spec.entity)
        ordered = entity.orderBy(*spec.order_columns)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        columns = {out: F.lag(c).over(ordered) for out, c in lag.items()}
        columns |= {out: F.lead(c, k).over(ordered) for out, (c, k) in lead.items()}
        if position:
            columns[position] = F.row_number().over(ordered)
        if first_time:
            # Rows are sorted by time, so the running minimum is already the entity's.
            columns[first_time] = F.min(spec.time).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        if last_time:
            columns[last_time] = F.max(spec.time).over(entity)
        rows = self.ordinary.withColumns(columns).withColumns(dict(derive))
        running = {out: running_value(s, value, earlier) for out, (s, value) in prior.items()}
        running |= {
            out: F.avg(value).over(ordered.rowsBetween(-k, -1)) for out, (value, k) in trailing.items()
        }
        return rows.withColumns(running)

    def _by_block(self, lag, lead, position, first_time, last_time, derive, prior, trailing):
        spec = self.spec
        back = max([1, *[k for _, k in trailing.values()]])
        ahead = max([1, *[k for _, k in lead.values()]])
        size = max(self.block_rows, back, ahead)
        rows = self.long if self._written else stage_table(self.long, "history")

        # Position of every row: rows of earlier pieces plus the place inside the piece.
        per_piece = rows.groupBy(spec.entity, PIECE).agg(
            F.count(F.lit(1)).alias("_n"), F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi")
        )
        entity = Window.partitionBy(spec.entity)
        earlier = entity.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_piece.select(
            spec.entity,
            PIECE,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.min("_lo").over(entity).alias("_first"),
            F.max("_hi").over(entity).alias("_last"),
        )
        inside = Window.partitionBy(spec.entity, PIECE).orderBy(*spec.order_columns)
        placed = null_safe_join(
            rows.withColumn("_local", F.row_number().over(inside)), offsets, [spec.entity, PIECE]
        ).withColumn("_place", F.col("_offset") + F.col("_local"))

        # Send each row to its block, and edge rows to the neighbour that looks at them.
        index = F.col("_place") - 1
        own, within = F.floor(index / size), index % size
        targets = F.array_compact(
            F.array(
                own,
                F.when(within >= size - back, own + 1),
                F.when((within < ahead) & (own > 0), own - 1),
            )
        )
        shared = placed.withColumn("_own", own).withColumn("_block", F.explode(targets))
        ordered = Window.partitionBy(spec.entity, "_block").orderBy("_place")
        home = F.col("_own") == F.col("_block")
        columns = {out: F.lag(c).over(ordered) for out, c in lag.items()}
        columns |= {out: F.lead(c, k).over(ordered) for out, (c, k) in lead.items()}
        if position:
            columns[position] = F.col("_place").cast("int")
        if first_time:
            columns[first_time] = F.when(F.col(spec.time).isNotNull(), F.col("_first"))
        if last_time:
            columns[last_time] = F.col("_last")
        local = shared.withColumns(columns).withColumns(dict(derive))
        means = {
            out: F.avg(value).over(ordered.rowsBetween(-k, -1)) for out, (value, k) in trailing.items()
        }
        local = local.withColumns(means)
        scratch = ["_local", "_offset", "_first", "_last", "_place", "_own", "_block"]
        if not prior:
            return local.where(home).drop(*scratch)

        # Running count, sum and squared deviation inside the block.
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        values = {out: F.when(home, value).cast("double") for out, (_, value) in prior.items()}
        local = local.withColumns({f"_v_{out}": value for out, value in values.items()})
        moments = {}
        for out, (statistic, _) in prior.items():
            value = F.col(f"_v_{out}")
            moments[f"_n_{out}"] = F.count(value).over(before)
            moments[f"_s_{out}"] = F.coalesce(F.sum(value).over(before), F.lit(0.0))
            if statistic == "std":
                moments[f"_q_{out}"] = F.coalesce(
                    F.var_pop(value).over(before) * F.col(f"_n_{out}"), F.lit(0.0)
                )
        plain = {k: v for k, v in moments.items() if not k.startswith("_q_")}
        spread = {k: v for k, v in moments.items() if k.startswith("_q_")}
        local = stage_table(local.withColumns(plain).withColumns(spread).where(home), "blocks")

        # The same three numbers for all earlier blocks together.
        totals = []
        for out, (statistic, _) in prior.items():
            value = F.col(f"_v_{out}")
            totals += [F.count(value).alias(f"_bn_{out}"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"_bs_{out}")]
            if statistic == "std":
                totals.append(F.coalesce(F.var_pop(value), F.lit(0.0)).alias(f"_bv_{out}"))
        per_block = local.groupBy(spec.entity, "_block").agg(*totals)
        up_to = entity.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = {}
        for out, (statistic, _) in prior.items():
            carried[f"_cn_{out}"] = F.coalesce(F.sum(f"_bn_{out}").over(up_to), F.lit(0))
            carried[f"_cs_{out}"] = F.coalesce(F.sum(f"_bs_{out}").over(up_to), F.lit(0.0))
        centres = {
            f"_m_{out}": F.sum(f"_bs_{out}").over(entity) / F.sum(f"_bn_{out}").over(entity)
            for out, (statistic, _) in prior.items()
            if statistic == "std"
        }
        centres = {
            name: F.when(F.sum(name.replace("_m_", "_bn_", 1)).over(entity) > 0, centre).otherwise(F.lit(0.0))
            for name, centre in centres.items()
        }
        carry = per_block.withColumns(carried | centres)
        squares = {}
        for out, (statistic, _) in prior.items():
            if statistic != "std":
                continue
            # Deviations are taken from the entity mean to keep the squares small.
            n, centre = F.col(f"_bn_{out}"), F.col(f"_m_{out}")
            off = F.when(n > 0, F.col(f"_bs_{out}") / n - centre).otherwise(F.lit(0.0))
            about = F.coalesce(
                F.sum(n * (F.col(f"_bv_{out}") + off * off)).over(up_to), F.lit(0.0)
            )
            count, shift = F.col(f"_cn_{out}"), F.col(f"_cs_{out}") - F.col(f"_cn_{out}") * centre
            squares[f"_cq_{out}"] = F.when(count > 0, about - shift * shift / count).otherwise(F.lit(0.0))
        kept = [*carried, *squares]
        carry = carry.withColumns(squares).select(spec.entity, "_block", *kept)
        joined = null_safe_join(local, carry, [spec.entity, "_block"])

        results = {}
        for out, (statistic, _) in prior.items():
            n1, n2 = F.col(f"_cn_{out}"), F.col(f"_n_{out}")
            s1, s2 = F.col(f"_cs_{out}"), F.col(f"_s_{out}")
            n = n1 + n2
            if statistic == "sum":
                results[out] = F.when(n > 0, s1 + s2)
            elif statistic == "mean":
                results[out] = F.when(n > 0, (s1 + s2) / n)
            else:
                gap = F.when((n1 > 0) & (n2 > 0), s2 / n2 - s1 / n1).otherwise(F.lit(0.0))
                square = F.col(f"_cq_{out}") + F.col(f"_q_{out}") + gap * gap * n1 * n2 / n
                results[out] = F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1)))
        helpers = [
            f"_{kind}_{out}" for out in prior for kind in ("v", "n", "s", "q", "cn", "cs", "cq")
        ]
        return joined.withColumns(results).drop(*scratch, *helpers)
