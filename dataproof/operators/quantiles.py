"""Exact continuous quantiles without sorting the data or holding a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a
quantile sketch only proposes a bracket for each wanted order statistic. A scan then counts
exactly how many values lie below, on and between the ends of the brackets, and lists the
values inside with their counts where few enough can be inside. Those counts say where each
rank is: on an end, among the listed values, or in an interval that a further sketch has to
narrow. A bracket that misses its rank is found out by the same counts, so the result never
depends on the quality of a sketch.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.functions.types import column
from dataproof.plans.two_level import aggregate_two_level, melt

QUARTILES = (0.25, 0.5, 0.75)

SKETCH_SIZE = 2000
# More than twice the sketch's rank error, so that a bracket rarely misses.
RANK_MARGIN = 0.005
# Most values listed between two neighbouring ends. They are counted on all executors and
# ordered per column, 16 bytes each.
LIST_LIMIT = 2_000_000
_GRID = 512


def sketch(value: Column) -> Column:
    return F.call_function("kll_sketch_agg_double", value, F.lit(SKETCH_SIZE))


def merge_sketches(sketches: Column) -> Column:
    return F.call_function("kll_merge_agg_double", sketches)


def sketch_count(merged: Column) -> Column:
    """Number of values in a sketch; NaN and NULL are not among them."""
    return F.call_function("kll_sketch_get_n_double", merged)


def sketch_quantiles(merged: Column, ranks: Sequence[float]) -> Column:
    values = F.call_function("kll_sketch_get_quantile_double", merged, F.array(*[F.lit(float(r)) for r in ranks]))
    return F.when(sketch_count(merged) > 0, values)


def bracket_ranks(probabilities: Sequence[float]) -> list[float]:
    """Ranks to ask a sketch for: the extremes, then two ends per probability."""
    ranks = [0.0, 1.0]
    for p in probabilities:
        ranks += [max(0.0, p - RANK_MARGIN), min(1.0, p + RANK_MARGIN)]
    return ranks


@dataclass
class _Rank:
    """One order statistic: the bracket it is looked for in, then its value."""

    rank: int
    lo: float
    hi: float
    inside: float  # upper estimate of the values strictly inside the bracket
    floor: float  # what the value is known not to lie below or above
    ceiling: float
    value: float | None = None


@dataclass
class _Search:
    """All order statistics of one column."""

    name: str
    ordered: int  # non-null values; NaN is one of them and sorts last
    real: int  # values that are not NaN
    lowest: float
    highest: float
    ranks: dict[int, _Rank] = field(default_factory=dict)

    def want(self, probability: float, lo: float, hi: float) -> None:
        position = probability * (self.ordered - 1)
        inside = self.real * 4 * RANK_MARGIN
        if self.real * RANK_MARGIN < 4:  # too few rows for a margin in ranks: look everywhere
            lo, hi, inside = self.lowest, self.highest, float(self.real)
        for rank in {math.floor(position), math.ceil(position)}:
            if rank < self.real:
                self.ranks.setdefault(rank, _Rank(rank, lo, hi, inside, self.lowest, self.highest))

    @property
    def open(self) -> list[_Rank]:
        return [r for r in self.ranks.values() if r.value is None]

    @property
    def bounds(self) -> list[float]:
        return sorted({end for r in self.open for end in (r.lo, r.hi)})

    def listed(self) -> int:
        """Bit mask of the buckets whose values are listed (see ``_bucket``)."""
        mask = 0
        bounds = self.bounds
        for r in self.open:
            if r.inside <= LIST_LIMIT:
                for j in range(bisect.bisect_left(bounds, r.lo) + 1, bisect.bisect_left(bounds, r.hi) + 1):
                    mask |= 1 << (2 * j)
        return mask

    def quantile(self, probability: float) -> float | None:
        position = probability * (self.ordered - 1)
        below, above = (self.ranks.get(r) for r in (math.floor(position), math.ceil(position)))
        if below is None or above is None:
            return None  # the order statistic is NaN
        low, high = below.value, above.value
        result = low if low == high else low + (high - low) * (position - math.floor(position))
        return result if math.isfinite(result) else None


def exact_quantiles(
    df: DataFrame, sketched: Iterable[tuple[str, int, int, Sequence[float]]], probabilities: Sequence[float] = QUARTILES
) -> dict[str, list[float | None]]:
    """Quantiles of several columns, interpolated linearly between neighbouring values.

    ``sketched`` has, per column, its number of non-null values, its number of values that
    are not NaN, and its sketch values at ``bracket_ranks(probabilities)``. One scan settles
    inputs of a hundred million rows; two more scans extend that fiftyfold each time.
    """
    searches = []
    for name, ordered, real, values in sketched:
        if real:
            search = _Search(name, ordered, real, values[0], values[1])
            for i, p in enumerate(probabilities):
                search.want(p, values[2 + 2 * i], values[3 + 2 * i])
            searches.append(search)
    while remaining := [s for s in searches if s.open]:
        before = [(r.lo, r.hi) for s in remaining for r in s.open]
        unsettled = _count(df, remaining)
        if unsettled:
            _narrow(df, unsettled)
        if before == [(r.lo, r.hi) for s in remaining for r in s.open]:
            raise RuntimeError("the input changed while it was read: a rank is in none of its brackets")
    return {s.name: [s.quantile(p) for p in probabilities] for s in searches}


def _bucket(bounds: Sequence[Column], number: Column) -> Column:
    """2j for values between the bounds j-1 and j, 2j+1 for values equal to bound j.

    Unused bounds are NULL: no comparison with them holds.
    """
    result = None
    for j, bound in enumerate(bounds):
        start = F if result is None else result
        result = start.when(number < bound, 2 * j).when(number == bound, 2 * j + 1)
    return result.otherwise(2 * len(bounds))


def _count(df: DataFrame, searches: list[_Search]) -> list[tuple[_Search, _Rank, int, int]]:
    """Locate every open rank exactly; return those between two ends whose values were not listed.

    A rank outside all ends gets a wider bracket, which the next count looks into.

    A single group-by counts buckets and listed values together: a value that fills a third
    of a column is one row per task. The running total runs over the buckets of one column.
    """
    width = max(len(s.bounds) for s in searches)
    cells = []
    for s in searches:
        bounds: list[float | None] = [*s.bounds, *[None] * (width - len(s.bounds))]
        # A constant of the plan that the cells only refer to.
        brackets = F.struct(
            F.array(*[F.lit(b).cast("double") for b in bounds]).alias("ends"),
            F.lit(s.listed()).cast("bigint").alias("listed"),
        )
        cells.append([column(s.name).cast("double").alias("number"), brackets.alias("brackets")])
    number = F.col("number")
    ends = [F.get(F.col("brackets.ends"), F.lit(j)) for j in range(width)]
    located = melt(df, cells).where(number.isNotNull()).select(
        "position", "number", "brackets.listed", _bucket(ends, number).alias("bucket")
    )
    is_listed = F.expr("shiftright(listed, bucket) & 1") == 1
    counts = (
        located.groupBy("position", "bucket", F.when(is_listed, number).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("upto", F.sum("count").over(Window.partitionBy("position").orderBy("bucket", "value")))
        .withColumn("before", F.col("upto") - F.col("count"))
    )
    wanted = [(position, r.rank) for position, s in enumerate(searches) for r in s.open]
    ranks = df.sparkSession.createDataFrame(wanted, "position int, rank bigint")
    # A few ranks per column.
    hits = counts.join(F.broadcast(ranks), "position").where("before <= rank AND rank < upto")
    unsettled = []
    for row in hits.collect():
        s = searches[row["position"]]
        r = s.ranks[row["rank"]]
        unsettled.append((s, r, s.bounds, row))
    result = []
    for s, r, bounds, row in unsettled:
        j = row["bucket"] // 2
        if row["bucket"] % 2:
            r.value = bounds[j]
        elif row["value"] is not None:
            r.value = row["value"]
        else:
            r.lo = r.floor = bounds[j - 1] if j > 0 else r.floor
            r.hi = r.ceiling = bounds[j] if j < len(bounds) else r.ceiling
            r.inside = float(row["count"])
            if 0 < j < len(bounds):
                result.append((s, r, row["before"], row["count"]))
    return result


def _narrow(df: DataFrame, unsettled: list[tuple[_Search, _Rank, int, int]]) -> None:
    """Sketch the values inside each interval and move its ends close to the wanted rank."""
    unsettled = [u for u in unsettled if u[3] > LIST_LIMIT]
    if not unsettled:
        return
    cells = [
        [column(s.name).cast("double").alias("number"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi")]
        for s, r, _, _ in unsettled
    ]
    inside = melt(df, cells).where("lo < number AND number < hi")
    grid = [step / _GRID for step in range(_GRID + 1)]
    merged = aggregate_two_level(
        inside, [sketch(F.col("number")).alias("sketch")], [merge_sketches(F.col("sketch")).alias("sketch")]
    )
    for row in merged.select("position", sketch_quantiles(F.col("sketch"), grid).alias("grid")).collect():
        _, r, before, count = unsettled[row["position"]]
        offset = r.rank - before
        first = max(0, math.floor((offset / count - RANK_MARGIN) * _GRID))
        last = min(_GRID, math.ceil(((offset + 1) / count + RANK_MARGIN) * _GRID))
        r.lo, r.hi = row["grid"][first], row["grid"][last]
        r.inside = count * ((last - first) / _GRID + 2 * RANK_MARGIN)


#: Buckets of approximate quantiles between a power of two and the next. A value is at most half a bucket from its
#: bucket's middle, so the relative error is 1/512 at most.
STEPS = 256
RELATIVE_ERROR = 1 / (2 * STEPS)
_LEAST_EXPONENT = -1074
_BEYOND = (1024 - _LEAST_EXPONENT) * STEPS + 1


def number_bucket(number: Column) -> Column:
    """The bucket of a double: 0 for zero, and equal steps within each power of two on either side, in the order of the
    numbers. Infinities and NaN come last.

    The logarithm may be off by one in its last place; a mantissa outside of [1, 2) shows it and gets the steps of the
    power of two that it belongs to, so the bucket is the same on every machine. The steps of the three powers of two are
    lines of which the least is the right one. Nothing that is used twice stands in a branch or a lambda, so it is
    generated code that computes logarithm and power once.
    """
    size = F.abs(number)
    # Least and greatest take NaN for the largest number and pass over NULL, so infinities and NaN end in the last steps.
    guess = F.floor(F.least(F.log2(size), F.lit(1023.0)))
    mantissa = size / F.pow(F.lit(2.0), guess)
    lines = [mantissa * (2 * STEPS) - 2.0 * STEPS, mantissa * STEPS - 1.0 * STEPS, mantissa * (STEPS / 2)]
    step = F.floor(F.least(*lines, F.lit(2.0 * STEPS)))
    place = F.least((guess - _LEAST_EXPONENT) * STEPS + step + 1, F.lit(_BEYOND)) + F.isnan(number).cast("int")
    return (place * F.when(number < 0, -1).when(number > 0, 1).when(number == 0, 0)).cast("int")


def bucket_middle(bucket: int) -> float | None:
    """The middle of a bucket; None for infinities and NaN."""
    if abs(bucket) >= _BEYOND:
        return None
    if bucket == 0:
        return 0.0
    exponent, step = divmod(abs(bucket) - 1, STEPS)
    return math.copysign(math.ldexp(1 + (step + 0.5) / STEPS, exponent + _LEAST_EXPONENT), bucket)


def approximate_quantiles(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float] = QUARTILES
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric columns within a relative error of ``RELATIVE_ERROR``, in one scan.

    Values are counted per bucket, exactly, and counts are added up: the result is the same in any order and
    partitioning. A task sends one row per column and bucket in use. Order statistics become the middles of their
    buckets and are interpolated as exact ones are. The driver gets two buckets per column and probability.
    """
    if not names:
        return {}
    cells = [[column(name).cast("double").alias("number")] for name in names]
    counted = melt(df, cells).where(F.col("number").isNotNull())
    counted = counted.groupBy("position", number_bucket(F.col("number")).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    own = Window.partitionBy("position")
    counted = counted.withColumns({"upto": F.sum("count").over(own.orderBy("bucket")), "all": F.sum("count").over(own)})
    wanted = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("all") - 1)
        wanted += [F.struct(F.lit(i).alias("which"), F.lit(0).alias("side"), F.floor(place).alias("rank"))]
        wanted += [F.struct(F.lit(i).alias("which"), F.lit(1).alias("side"), F.ceil(place).alias("rank"))]
    hits = counted.select("position", "bucket", "all", "upto", "count", F.explode(F.array(*wanted)).alias("want"))
    hits = hits.where((F.col("upto") - F.col("count") <= F.col("want.rank")) & (F.col("want.rank") < F.col("upto")))
    found: dict[tuple[int, int, int], int] = {}
    totals: dict[int, int] = {}
    for row in hits.select("position", "bucket", "all", "want.which", "want.side").collect():
        found[row["position"], row["which"], row["side"]] = row["bucket"]
        totals[row["position"]] = row["all"]
    out = {}
    for position, total in totals.items():
        quantiles: list[float | None] = []
        for i, p in enumerate(probabilities):
            low, high = (bucket_middle(found[position, i, side]) for side in (0, 1))
            at = p * (total - 1)
            quantiles.append(None if low is None or high is None else low + (high - low) * (at - math.floor(at)))
        out[names[position]] = quantiles
    return out
