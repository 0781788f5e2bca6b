"""Order without one task for all rows: tables in ranges, numbers by offsets of ranges, chains and quantiles over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import forget, stored

_BITS = 33  # of Spark's increasing ids, below the number of the partition


def ranged(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` sorted over the whole table and stored, with ``_id``: the partition's number and the row's place in it.

    One shuffle by ranges, for which Spark takes the bounds from its own sample and finds a row's range by binary search; the cost per row does not grow with the
    number of ranges. Equal rows of ``order`` are told apart by a hash of all columns, so a value that many rows have
    is spread over ranges too. What is stored is read by every later step, so numbers never differ between them.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    spread = df.withColumn("_tie", F.xxhash64(*(F.col(c) for c in df.columns)))
    dealt = spread.repartitionByRange(ranges, *keys, "_tie") if ranges else spread.repartitionByRange(*keys, "_tie")
    return stored(dealt.sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id()))


def range_of() -> Column:
    return F.shiftright("_id", _BITS)


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_no", by: Sequence[str] = (), ranges: int | None = None, total: str | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of some columns (nulls first), within groups of equal ``by``; with ``total`` also the number of rows there.

    A row's number is its place in its range and the sizes of the ranges before, a table of one row for each range. With ``by`` a group's
    numbers start anew from its least, so a group may cross ranges and no task holds one.
    """
    made = ranged(df, [*by, *order], ranges)
    sizes = made.groupBy(range_of().alias("_range")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_all"))
    placed = made.withColumn("_range", range_of()).join(F.broadcast(offsets), "_range")
    placed = placed.withColumn(out, (F.col("_before") + F.col("_id").bitwiseAND((1 << _BITS) - 1)).cast("bigint"))
    count = F.col("_all")
    if by:
        groups = placed.groupBy(*(F.col(b).alias(f"_by_{b}") for b in by)).agg(F.min(out).alias("_start"), F.count(F.lit(1)).alias("_group"))
        same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
        placed = placed.join(groups, same).withColumn(out, F.col(out) - F.col("_start"))
        count = F.col("_group")
    return placed.select(*df.columns, out, *([count.cast("bigint").alias(total)] if total else []))


def distinct_tol_rows(df: DataFrame, by: Sequence[str], value: str, tol: float = 1e-10, ranges: int | None = None) -> DataFrame:
    """``by, value``: of the sorted values of each group, those more than ``tol`` above the last one kept. Nulls and NaN are left out.

    Values are put in ranges once. A gap of more than ``tol`` ends a chain whatever was kept before, so a task decides by itself from the
    first gap in its range on; what comes before it hangs on the range before only where no gap lies between. Those
    heads of ranges are decided next, in as many rounds as ranges without any gap follow each other.
    """
    rows = df.select(*by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value)).distinct()
    keys = [F.col(c).asc_nulls_first() for c in (*by, value)]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"`{value}` double", "_range int", "_kept boolean", "_head boolean", "_last boolean"])
    width = len(by)

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or pd.isna(x) and pd.isna(y) for x, y in zip(a[:width], b[:width], strict=True))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a range in order; the rule starts with the first row, which is right unless the range before reaches into it."""
        last = kept = None
        head, held = True, None
        for batch in batches:
            out = [] if held is None else [held]
            held = None
            for *row, number in batch[[*by, value, "_range"]].itertuples(index=False, name=None):
                row = tuple(row)
                if last is not None:
                    head = head and same(row, last) and row[-1] - last[-1] <= tol
                fresh = kept is None or not same(row, kept) or row[-1] - kept[-1] > tol
                last, kept = row, row if fresh else kept
                if out and not out[-1][-3] and not out[-1][-2]:
                    out.pop()  # neither kept nor needed
                out.append((*row, number, fresh, head, False))
            if out:
                held = out.pop()
                if out:
                    yield pd.DataFrame(out, columns=[*by, value, "_range", "_kept", "_head", "_last"])
        if held is not None:
            yield pd.DataFrame([(*held[:-1], True)], columns=[*by, value, "_range", "_kept", "_head", "_last"])

    made = stored(dealt.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()).mapInPandas(scan, schema))
    # one row for each range: its ends, whether a gap lies in it, and what was kept last behind that
    whole = F.struct(*by, value)
    ends = made.groupBy("_range").agg(F.min(whole).alias("first"), F.max(whole).alias("last"), F.max(F.when(F.col("_last"), ~F.col("_head"))).alias("gap"), F.max(F.when(F.col("_kept"), whole)).alias("kept"))
    ends = sorted(ends.collect(), key=lambda r: r["_range"])
    reached, leaves, coming = set(), {}, {}
    for before, now in zip([None, *ends], ends, strict=False):
        if before is not None and same(tuple(now["first"]), tuple(before["last"])) and now["first"][-1] - before["last"][-1] <= tol:
            reached.add(now["_range"])
            coming[now["_range"]] = before["_range"]
        if now["_range"] not in reached or now["gap"]:
            leaves[now["_range"]] = now["kept"][-1]
    settled: list[DataFrame] = []
    waiting = set(reached)

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(value)
        kept, flags = group["_from"].iloc[0], []
        for x in group[value]:
            flags.append(x - kept > tol)
            kept = x if flags[-1] else kept
        return group.assign(_kept=flags, _out=kept)[[*by, value, "_range", "_kept", "_out"]]

    while waiting:
        ready = [(n, leaves[coming[n]]) for n in sorted(waiting) if coming[n] in leaves]
        start = F.broadcast(df.sparkSession.createDataFrame(ready, "_range int, _from double"))
        heads = made.where("_head").join(start, "_range").select(*by, value, "_range", "_from")
        done = stored(heads.groupBy("_range").applyInPandas(decide, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"`{value}` double", "_range int", "_kept boolean", "_out double"])))
        for r in done.groupBy("_range").agg(F.first("_out").alias("_out")).collect():
            leaves.setdefault(r["_range"], r["_out"])
        settled.append(done)
        waiting -= {n for n, _ in ready}
    if not settled:
        return made.where("_kept").select(*by, value)
    listed = F.broadcast(df.sparkSession.createDataFrame([(n,) for n in sorted(reached)], "_range int"))
    own = made.where(~F.col("_head")).unionByName(made.where("_head").join(listed, "_range", "left_anti"))
    out = own.where("_kept").select(*by, value)
    for done in settled:
        out = out.unionByName(done.where("_kept").select(*by, value))
    return out


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], bins: int = 1024, few: int = 4096) -> DataFrame:
    """``by`` and ``p0, p1, ...``: the interpolated percentiles of each group's values, exactly; null and NaN values do not count, nor groups of only such.

    Every share needs the values of two ranks. Their interval starts as the group's whole range and is narrowed in rounds: values inside are counted
    in ``bins`` equal parts, with sums on the map side, and the part that holds the rank becomes the next interval, with its own least and
    largest value as ends. An interval of one value is done; one of at most ``few`` values is sorted as an array. So no buffer
    holds a group, whatever its size, and about three rounds suffice for a billion values that are spread evenly.
    """
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    group = [f"_b{i}" for i in range(len(by))]
    ends = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("share"), F.lit(float(s)).alias("p"), F.lit(up).alias("up")) for i, s in enumerate(shares) for up in (0, 1))))
    at = F.col("_t.p") * (F.col("_n") - 1)
    rank = F.least(F.floor(at) + F.col("_t.up"), F.col("_n") - 1)
    asked = stored(ends.withColumn("_t", ranks).select(*group, F.col("_t.share").alias("_share"), F.col("_t.up").alias("_up"), (at - F.floor(at)).alias("_part"), rank.alias("_rank"), F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_in"), "_low", "_high"))
    target = [*group, "_share", "_up"]
    carried = ["_part", "_rank"]
    done = asked.where("_low = _high").select(*target, "_part", F.col("_low").alias("_x"))
    state = asked.where("_low < _high")
    kept = [asked]

    def inside(now: DataFrame) -> DataFrame:
        """Values in the interval of each rank. The ranks are few rows, which Spark broadcasts while they are small."""
        both = rows.alias("r").join(now.alias("s"), [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group] + [F.col("r._v").between(F.col("s._low"), F.col("s._high"))] if group else F.col("r._v").between(F.col("s._low"), F.col("s._high")))
        return both.select(*(F.col(f"s.{c}") for c in now.columns), F.col("r._v").alias("_v"))

    while not state.where(F.col("_in") > few).isEmpty():
        wide = state.where(F.col("_in") > few)
        # halves first: the whole width of an interval may be too large for a double
        place = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins), F.lit(bins - 1))
        counts = inside(wide).groupBy(*target, *carried, "_below", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        # at most ``bins`` rows for each rank
        before = F.coalesce(F.sum("_in").over(Window.partitionBy(*target).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("_below", F.col("_below") + before).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_in")))
        narrow = stored(found.select(*target, *carried, "_below", "_in", "_low", "_high").unionByName(state.where(F.col("_in") <= few).select(*target, *carried, "_below", "_in", "_low", "_high")))
        kept.append(narrow)
        done = done.unionByName(narrow.where("_low = _high").select(*target, "_part", F.col("_low").alias("_x")))
        state = narrow.where("_low < _high")
    sorted_few = inside(state).groupBy(*target, *carried, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    done = done.unionByName(sorted_few.select(*target, "_part", F.element_at("_vs", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_x")))
    ends_of = done.groupBy(*group, "_share").agg(F.max(F.when(F.col("_up") == 0, F.col("_x"))).alias("_a"), F.max(F.when(F.col("_up") == 1, F.col("_x"))).alias("_b"), F.first("_part").alias("_part"))
    between = F.when(F.col("_part") == 0, F.col("_a")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b"))
    named = ends_of.groupBy(*group).agg(*(F.max(F.when(F.col("_share") == i, between)).alias(f"p{i}") for i in range(len(shares))))
    out = stored(named.select(*(F.col(f"_b{i}").alias(b) for i, b in enumerate(by)), *(f"p{i}" for i in range(len(shares)))))
    forget(*kept)
    return out
