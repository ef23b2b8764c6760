"""Order-dependent building blocks that do not depend on small groups.

There is one way for every size. For lags, running values and positions, rows are range-partitioned on (group, order), so that a
group holding a third of the table is spread over many tasks; adaptive execution merges the
ranges of a small table into a few. The slices are written once to the shared stage folder,
and a table with one row per (group, slice) carries sums or last rows from slice to slice.
Keys are compared null-safe: rows with a null key form a group of their own.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import bounded_rows, local_table, shared_stage

SLICE = "_slice"


def slice_groups(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Add a slice number; within a group, slices follow each other in `order`."""
    ranged = df.repartitionByRange(*by, *order)
    return shared_stage(ranged.withColumn(SLICE, F.spark_partition_id()))


def same_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on `keys` with null equal to null; the keys come from `rows`."""
    other = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    meet = F.lit(True)
    for i, k in enumerate(keys):
        meet = meet & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, meet, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _slice_window(by: Sequence[str], order: Sequence):
    return Window.partitionBy(*by, SLICE).orderBy(*order)


def _across(by: Sequence[str]):
    # One row per slice of a group, so at most as many rows as shuffle partitions.
    return Window.partitionBy(*by).orderBy(SLICE)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence, sums: Mapping[str, Column]) -> DataFrame:
    """Sum of each expression over the earlier rows of the group (own row excluded)."""
    named = {f"_v_{name}": value for name, value in sums.items()}
    rows = slice_groups(df.withColumns(named), by, order)
    before = _slice_window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, SLICE).agg(*[F.sum(c).alias(c) for c in named])
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, SLICE, *[F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = rows.withColumns({name: F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)) for name in sums})
    out = same_keys(out, offsets, [*by, SLICE])
    out = out.withColumns({name: F.col(name) + F.col(f"_o_{name}") for name in sums})
    return out.drop(SLICE, *named, *[f"_o_{n}" for n in sums])


def row_positions(df: DataFrame, by: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """0-based position of each row in its group."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")})


def previous_row(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, sliced: bool = False) -> DataFrame:
    """Struct of `columns` of the row just before, null for the first row of a group.

    `sliced` rows come from `slice_groups` with the same keys and order and keep their slice.
    """
    kept = F.struct(*columns)
    rows = df if sliced else slice_groups(df, by, order)
    tails = rows.groupBy(*by, SLICE).agg(F.max_by(kept, F.struct(*order)).alias("_tail"))
    carried = tails.select(*by, SLICE, F.lag("_tail").over(_across(by)).alias("_carried"))
    out = same_keys(rows.withColumn(name, F.lag(kept).over(_slice_window(by, order))), carried, [*by, SLICE])
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried", *([] if sliced else [SLICE]))


def gather_cut(sliced: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Groups of up to WHOLE rows that a range end cut come back to their first slice.

    The second table lists the larger groups that stay spread over slices, and is None without any.
    A range end cuts at most one group, so both lists are shorter than the list of slices.
    """
    cut = sliced.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(
        F.min(SLICE).alias("_first"), F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    rows = bounded_rows(cut, MOST_GROUPS)
    listed = lambda some: local_table(sliced.sparkSession, some, cut.schema).select(*by, "_first")
    small, large = [r for r in rows if r["_rows"] <= WHOLE], [r for r in rows if r["_rows"] > WHOLE]
    if small:
        sliced = same_keys(sliced, F.broadcast(listed(small)), by).withColumn(SLICE, F.coalesce("_first", SLICE)).drop("_first")
    return sliced, listed(large).drop("_first").withColumn("_several", F.lit(True)) if large else None


def sliced_positions(groups: DataFrame, sliced: DataFrame, by: Sequence[str], order: Sequence[str], home: str, name: str) -> DataFrame:
    """0-based position among the groups (by + order) of a sliced table, each in its first slice `home`; needs no new ranges."""
    first = sliced.groupBy(*by, *order).agg(F.min(SLICE).alias(home))
    counts = first.groupBy(*by, home).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(home).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, home, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = groups.withColumn("_within", F.row_number().over(Window.partitionBy(*by, home).orderBy(*order)) - 1)
    out = same_keys(within, offsets, [*by, home])
    return out.withColumn(name, (F.col("_within") + F.col("_offset")).cast("long")).drop("_within", "_offset", home)


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Largest `value` among the strictly earlier rows of the group; null for the first row."""
    rows = slice_groups(df.withColumn("_value", value), by, order)
    before = _slice_window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, SLICE).agg(F.max("_value").alias("_top"))
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, SLICE, F.max("_top").over(earlier).alias("_carried"))
    out = same_keys(rows.withColumn(name, F.max("_value").over(before)), carried, [*by, SLICE])
    return out.withColumn(name, F.greatest(name, "_carried")).drop("_carried", SLICE, "_value")


def last_known(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Last non-null value of each expression among the strictly earlier rows of the group."""
    named = {f"_v_{name}": value for name, value in values.items()}
    rows = slice_groups(df.withColumns(named), by, order)
    before = _slice_window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    tails = rows.groupBy(*by, SLICE).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v) for v in named])
    earlier = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, SLICE, *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    out = rows.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(before) for n in values})
    out = same_keys(out, carried, [*by, SLICE])
    out = out.withColumns({n: F.coalesce(n, f"_c_{n}") for n in values})
    return out.drop(SLICE, *named, *[f"_c_{n}" for n in values])


def group_totals(df: DataFrame, by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Aggregate and give the totals back to every member.

    The totals are combined map-side and are one row per group, so the rejoin
    becomes a broadcast or a skew-split join at run time; no group is sorted.
    """
    named = [value.alias(name) for name, value in totals.items()]
    if not by:
        whole = df.agg(F.struct(*named).alias("_whole")).scalar()
        return df.withColumn("_whole", whole).select("*", "_whole.*").drop("_whole")
    return same_keys(df, df.groupBy(*by).agg(*named), list(by), "inner")


#: Size of the quantile sketch, half width of a bracket (four times the sketch's rank error)
#: and the size up to which a whole group is its own bracket.
SKETCH, HALF, WHOLE = 4096, 0.004, 2_000
#: Takes the place of NaN, which sorts last, in sketches.
LAST = 1.7976931348623157e308
MOST_GROUPS = 100_000


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "linear",
    few_groups: bool = False,
) -> DataFrame:
    """Exact quantiles per group; `method` is "linear" or "higher".

    A mergeable sketch per group gives each quantile a bracket of values around its rank. A
    second pass counts what lies below the brackets and, value by value, what lies inside;
    counting on through a bracket finds the exact order statistic. Both passes combine
    map-side, so no group is sorted or brought together; what is left of it is the
    hundredth part inside a bracket, cut into cells once more. A rank outside its bracket
    would be an error of ten standard deviations of the sketch and raises.

    `few_groups` states that the groups are bounded by construction (a list of columns), so
    that their brackets can be sent to all tasks; more than MOST_GROUPS are refused. Brackets of
    other groups are staged as a table of one row a group.
    """
    by = list(by)
    levels = list(quantiles.items())
    wanted = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    edges = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for _, q in levels for d in (-HALF, HALF)])
    model = wanted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        F.kll_sketch_agg_double(F.when(F.isnan("_x"), LAST).otherwise(F.col("_x")), F.lit(SKETCH)).alias("_sketch"))
    model = model.withColumn("_edges", F.kll_sketch_get_quantile_double("_sketch", edges)).where("_total > 0")
    cells = []
    for i, (_, q) in enumerate(levels):
        rank = (F.col("_total") - 1) * F.lit(float(q))
        whole = F.col("_total") <= WHOLE
        low, high = F.get("_edges", F.lit(2 * i)), F.get("_edges", F.lit(2 * i + 1))
        first = (F.ceil(rank) if method == "higher" else F.floor(rank)).alias("_first")
        cells.append(F.struct(
            F.lit(i).alias("_i"), F.when(whole | F.lit(q <= HALF), F.lit(float("-inf"))).otherwise(low).alias("_lo"),
            F.when(whole | F.lit(q >= 1 - HALF) | (high >= LAST), F.lit(float("nan"))).otherwise(high).alias("_hi"),
            first, F.lit(0.0).alias("_share") if method == "higher" else (rank - F.floor(rank)).alias("_share")))
    brackets = model.select(*by, F.array(*cells).alias("_cells"))
    # A sketch is drawn by chance: its brackets are fixed here, before anything is counted by them.
    if by and not few_groups:
        met = same_keys(wanted, shared_stage(brackets), by, "inner")
    else:
        fixed = local_table(df.sparkSession, bounded_rows(brackets, MOST_GROUPS), brackets.schema)
        met = same_keys(wanted, F.broadcast(fixed), by, "inner") if by else wanted.withColumn("_cells", fixed.scalar())
    met = met.select(*by, "_x", F.inline(F.filter("_cells", lambda c: F.col("_x") <= c["_hi"])))
    # Equal-width cells within a bracket; -1 is all below it.
    width = F.when((F.col("_lo") > float("-inf")) & (F.col("_hi") < LAST) & (F.col("_hi") > F.col("_lo")), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    inside = F.col("_x") >= F.col("_lo")
    keys = [*by, "_i"]
    values = met.groupBy(*keys, F.when(inside, F.col("_x")).alias("_v"), F.when(inside, F.coalesce(F.floor(width * 1024), F.lit(0))).otherwise(-1).cast("int").alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_first").alias("_first"), F.first("_share").alias("_share"))
    before = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = values.groupBy(*keys, "_cell").agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.first("_first").alias("_first"), F.first("_share").alias("_share"))
    found = found.withColumns({"_before": F.coalesce(F.sum("_n").over(before("_cell")), F.lit(0)),
                               "_next": F.lead("_low").over(Window.partitionBy(*keys).orderBy("_cell"))})
    found = found.where((F.col("_first") >= F.col("_before")) & (F.col("_first") < F.col("_before") + F.col("_n")) & (F.col("_cell") >= 0))
    inner = same_keys(values, found.select(*keys, "_cell", "_before", "_next"), [*keys, "_cell"], "inner")
    inner = inner.withColumns({"_at": F.col("_before") + F.coalesce(F.sum("_n").over(before("_v")), F.lit(0)),
                               "_after": F.coalesce(F.lead("_v").over(Window.partitionBy(*keys).orderBy("_v")), F.col("_next"))})
    hit = (F.col("_first") >= F.col("_at")) & (F.col("_first") < F.col("_at") + F.col("_n"))
    last_of_value = F.col("_first") + 1 >= F.col("_at") + F.col("_n")
    second = F.when(last_of_value, F.col("_after")).otherwise(F.col("_v"))
    result = F.when((F.col("_share") > 0) & ~second.eqNullSafe(F.col("_v")), F.col("_v") + (second - F.col("_v")) * F.col("_share")).otherwise(F.col("_v"))
    picked = inner.where(hit).groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, result)).alias(f"_q{i}") for i in range(len(levels))])
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    sure = lambda c: F.when(F.col(c).isNull() & F.col("_some"), lost).otherwise(F.col(c))
    if by:
        picked = picked.withColumn("_some", F.lit(True))
    else:  # a table without values has null quantiles
        picked = picked.withColumn("_some", fixed.select(F.count(F.lit(1)) > 0).scalar())
    return picked.select(*by, *[sure(f"_q{i}").alias(name) for i, (name, _) in enumerate(levels)])


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact linear quantiles of rows that stand for `weight` equal values each.

    One row a distinct value is counted on, so a run of any length costs one row. Rows without
    a value or with a weight of 0 count for nothing.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.sum(weight).alias("_n"))
    placed = group_totals(running_sums(counts, by, ["_x"], {"_before": F.col("_n")}), by, {"_total": F.sum("_n")})
    picks = []
    for name, q in quantiles.items():
        rank = (F.col("_total") - 1) * F.lit(float(q))
        low = F.floor(rank)
        holds = lambda i: F.when((i >= F.col("_before")) & (i < F.col("_before") + F.col("_n")), F.col("_x"))
        picks += [F.max(holds(low)).alias(f"_low_{name}"), F.max(holds(low + 1)).alias(f"_high_{name}"), F.max(rank - low).alias(f"_share_{name}")]
    step = lambda n: (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_share_{n}")
    return placed.groupBy(*by).agg(*picks).select(
        *by, *[F.when(F.col(f"_share_{n}") > 0, F.col(f"_low_{n}") + step(n)).otherwise(F.col(f"_low_{n}")).alias(n) for n in quantiles])


def trailing_window(
    df: DataFrame, by: Sequence[str], time: str, span: int, aggregates: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over the strictly earlier rows with `time` in [t - span, t).

    Time is cut into blocks of eight spans. Rows in the last span of a block are
    also sent to the next block as read-only history, so one long-lived key is
    spread over blocks at an eighth more rows.
    """
    block = 8 * span
    own = F.floor(F.col(time) / F.lit(block))
    near_end = F.col(time) >= (own + 1) * block - span
    spread = df.withColumn(
        "_tw_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(*by, "_tw_block").orderBy(F.col(time).cast("long")).rangeBetween(-span, -1)
    out = spread.withColumns({name: value.over(window) for name, value in aggregates.items()})
    return out.where(F.col("_tw_block") == own).drop("_tw_block")
