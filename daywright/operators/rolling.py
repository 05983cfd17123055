"""Row-based rolling statistics over a daily series.

Every function takes the series keys and adds one column. All of them order by date inside
the series, so a chain of them costs one exchange on the keys. A series holds at most one row
per calendar date, which bounds the group a task has to sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daywright.functions.numeric import float_div
from daywright.settings import SERIES

Keys = Sequence[str]
DEFAULT_KEYS: Keys = (SERIES,)

# Products of steps in a block of an exponential mean stay above exp of minus this.
BLOCK_DECAY = 200.0


def by_date(keys: Keys, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    return spec.rowsBetween(-(rows - 1), Window.currentRow)


def with_rolling_mean(
    df: DataFrame, column: str, out: str, rows: int, min_rows: int, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Mean of the last ``rows`` rows if at least ``min_rows`` of them have a value."""
    frame = trailing(by_date(keys), rows)
    return df.withColumn(out, F.when(F.count(column).over(frame) >= min_rows, F.avg(column).over(frame)))


def with_rolling_std(
    df: DataFrame, column: str, out: str, rows: int, min_rows: int, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Sample deviation of the last ``rows`` rows if enough of them have a value."""
    frame = trailing(by_date(keys), rows)
    return df.withColumn(
        out, F.when(F.count(column).over(frame) >= min_rows, F.stddev_samp(column).over(frame))
    )


def with_zscore(
    df: DataFrame, column: str, out: str, rows: int, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """(x - mean) / std over the last ``rows`` rows; missing becomes 0.

    The frame values are made as columns first: a window expression named twice in a formula
    would be evaluated twice.
    """
    frame = trailing(by_date(keys), rows)
    x = F.col(column)
    framed = df.withColumns(
        {
            "_n": F.count(x).over(frame),
            "_mean": F.avg(x).over(frame),
            "_std": F.stddev_samp(x).over(frame),
        }
    )
    score = F.when(F.col("_n") >= rows // 2, float_div(x - F.col("_mean"), F.col("_std")))
    return framed.withColumn(out, F.coalesce(score, F.lit(0.0))).drop("_n", "_mean", "_std")


def distance_to_mean(c: Column, mean: Column) -> Column:
    return float_div(c, mean) - 1


def difference(c: Column, spec: WindowSpec, rows: int) -> Column:
    return c - F.lag(c, rows).over(spec)


def lagged(c: Column, spec: WindowSpec, default=None) -> Column:
    previous = F.lag(c, 1).over(spec)
    return previous if default is None else F.coalesce(previous, F.lit(default))


def with_percent_rank(
    df: DataFrame, column: str, out: str, rows: int, min_rows: int, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Share of the earlier rows in the frame that are below the current value.

    Missing earlier rows count in the denominator; a missing current value ranks 0. The row
    threshold comes first; a one-row frame ranks 0.5.

    An order statistic by bit counts. Segments of ``2 * rows`` rows overlap by half, so that the second
    half of one holds whole frames. The values of a segment are numbered by size, and a row's value is
    the bit of its number. The bits of the rows so far are a running XOR; two such sets, a frame
    apart, give the set of the frame, and the values below the current one are its bits below the
    row's number. So a row costs a few words of 64 bits instead of a pass over its frame.
    """
    spec = by_date(keys)
    x = F.col(column)
    seen = df.withColumns({"_nth": F.row_number().over(spec) - 1, "_seen": F.count(x).over(running(spec))})
    valid = F.col("_seen") - F.coalesce(F.lag("_seen", rows).over(spec), F.lit(0))
    segment = F.floor(F.col("_nth") / rows)
    # Each row is asked about in the segment it ends and is only context in the next one.
    placed = seen.withColumn("_valid", valid).withColumn("_segment", F.explode(F.array(segment, segment + 1)))
    in_segment = Window.partitionBy(*keys, "_segment")
    by_size = in_segment.orderBy(x.asc_nulls_last())
    bit = F.row_number().over(by_size) - 1
    numbered = placed.withColumns({"_bit": F.when(x.isNotNull(), bit), "_below": F.rank().over(by_size) - 1})
    in_order = in_segment.orderBy("_nth")
    words = range((2 * rows + 63) // 64)

    def own(w: int) -> Column:
        place = (F.col("_bit") - 64 * w).cast("int")
        return F.when(place.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), place))

    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    summed = numbered.withColumns({f"_set{w}": F.coalesce(F.bit_xor(own(w)).over(before), F.lit(0).cast("long")) for w in words})
    earlier = summed.withColumns({f"_past{w}": F.coalesce(F.lag(f"_set{w}", rows - 1).over(in_order), F.lit(0).cast("long")) for w in words})

    def count(w: int) -> Column:
        reach = (F.col("_below") - 64 * w).cast("int")
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - F.greatest(F.least(reach, F.lit(64)), F.lit(1)))
        mask = F.when(reach > 0, ones).otherwise(F.lit(0).cast("long"))
        return F.bit_count(F.col(f"_set{w}").bitwiseXOR(F.col(f"_past{w}")).bitwiseAND(mask))

    below = count(0)
    for w in words[1:]:
        below = below + count(w)
    held = F.least(F.col("_nth") + 1, F.lit(rows))
    share = F.when(x.isNotNull(), below).otherwise(0) / F.greatest(held - 1, F.lit(1))
    rank = F.when(F.col("_nth") == 0, 0.5).otherwise(share) if rows > 1 else F.lit(0.5)
    return (
        earlier.where(F.col("_segment") == F.floor(F.col("_nth") / rows))
        .withColumn(out, F.when(F.col("_valid") >= min_rows, rank))
        .select(*df.columns, out)
    )


def with_ema(
    df: DataFrame, column: str, out: str, span: int, keys: Keys = DEFAULT_KEYS, order: str = "date"
) -> DataFrame:
    """Recursive exponential mean, started at the first value.

    A value x that comes d rows after the last one takes the step y -> a y + b with
    w = (1 - alpha)^d, a = w / (w + alpha) and b = alpha x / (w + alpha): without a gap that is
    y -> (1 - alpha) y + alpha x, after missing values the old mean weighs less. A missing
    value takes no step and repeats the last mean.

    Such steps can be joined, so the rows are scanned in blocks: in a block each mean is a running
    sum of b over the product of the a that follow, and the end of a block is again one step. Blocks
    end where that product falls below exp(-BLOCK_DECAY), which keeps it far from the limits of a
    double; the steps of all blocks before are then folded in order, none left out. There is a block
    for every BLOCK_DECAY / -ln(1 - alpha) rows, so few of them are in the fold.
    """
    alpha = 2.0 / (span + 1.0)
    decay = math.log1p(-alpha) if alpha < 1 else -math.inf
    if not math.isfinite(decay):  # span 1: the mean is the value itself
        return df.withColumn(out, F.last(column, ignorenulls=True).over(running(by_date(keys, order))))
    spec = by_date(keys, order)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(column)
    placed = df.withColumn("_row", F.row_number().over(spec))
    placed = placed.withColumn("_since", F.col("_row") - F.last(F.when(x.isNotNull(), F.col("_row")), True).over(before))
    weight = F.exp(F.col("_since") * decay) + alpha
    steps = placed.withColumns(
        {
            # The first value replaces whatever was there.
            "_b": F.when(F.col("_since").isNull(), x).otherwise(x * alpha / weight),
            "_log_a": F.when(x.isNotNull(), F.coalesce(F.col("_since") * decay - F.log(weight), F.lit(0.0))),
        }
    )
    steps = steps.withColumn("_block", F.floor(-F.sum("_log_a").over(running(spec)) / BLOCK_DECAY))
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    # Products count from the first value of the block: its own step, however small, is kept apart.
    logs = steps.withColumns(
        {
            "_open": F.first("_log_a", True).over(running(in_block)),
            "_sum": F.sum("_log_a").over(running(in_block)),
            "_end": F.max(F.when(x.isNotNull(), F.col("_row"))).over(Window.partitionBy(*keys, "_block")),
        }
    )
    product = F.exp(F.col("_sum") - F.col("_open"))
    summed = logs.withColumn("_product", product)
    summed = summed.withColumn("_local", F.col("_product") * F.sum(F.col("_b") / F.col("_product")).over(running(in_block)))
    step = F.struct((F.exp("_open") * F.col("_product")).alias("a"), F.col("_local").alias("b"))
    ended = F.collect_list(F.when(F.col("_row") == F.col("_end"), step)).over(before)
    carry = F.aggregate("_ended", F.lit(0.0), lambda y, s: s["a"] * y + s["b"])
    carried = summed.withColumn("_ended", ended).withColumn("_carry", F.when(x.isNotNull(), carry))
    mean = F.col("_local") + F.exp("_open") * F.col("_product") * F.col("_carry")
    return (
        carried.withColumn("_mean", F.when(x.isNotNull(), mean))
        .withColumn(out, F.last("_mean", ignorenulls=True).over(running(spec)))
        .drop("_row", "_since", "_b", "_log_a", "_block", "_open", "_sum", "_end", "_product", "_local", "_ended", "_carry", "_mean")
    )


def with_softmax(df: DataFrame, column: str, out: str, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """exp(x - max) / sum over each key: one shuffle; a key's rows are its days, so the calendar bounds them."""
    whole = Window.partitionBy(*keys)
    return (
        df.withColumn("_ex", F.exp(F.col(column) - F.max(column).over(whole)))
        .withColumn(out, F.col("_ex") / F.sum("_ex").over(whole))
        .drop("_ex")
    )
