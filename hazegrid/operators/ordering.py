"""Row positions and neighbour windows over groups of any size.

A plain ``Window.partitionBy(station).orderBy(ts)`` puts a whole station into one task. With
few stations, or one that holds a third of all rows, that task never ends. The helpers here
sort all rows once, cut the order into pieces of about as many rows each, and give each piece what
its windows need of the others: the number of rows before it, the few neighbours a frame can reach, or
the last known values. The result is the same as that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.operators.lookup import join_on
from hazegrid.session import cut_lineage

MICROS_PER_HOUR = 3_600_000_000
# Groups of up to so many rows are left whole where that saves a shuffle; larger ones are cut into pieces.
GROUP_ROWS = 500_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970; the session runs in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def in_pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows sorted by `keys` and `order` and cut into pieces of about as many rows each, with ``_piece`` and ``_at``, a number that grows
    along the order and by one from row to row of a piece.

    Spark samples the sort key, partitions by ranges of it and sorts every range; a station, an hour or one time with very many rows
    is cut like any other part of the order. Ties go by the remaining values, and rows that are alike in all columns by their place in the input, so that they too can be told
    apart. Nulls come first. The pieces are written to the shared folder, where each row keeps its number; runs that job.
    """
    rest = F.xxhash64(*[F.col(c) for c in df.columns])
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, rest, F.col("_row")]
    placed = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    stored = cut_lineage(placed.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "pieces")
    return stored.withColumn("_piece", F.shiftright("_at", 33))


def with_position(df: DataFrame, keys: list[str], order: list[Column], pos: str = "pos", total: str | None = None) -> DataFrame:
    """Add the 1-based row number within `keys` by `order`, and optionally the group size.

    The input is evaluated into pieces once. A row's number is its place in its piece plus the rows of its group in
    earlier pieces; those counts, one row per piece and group in it, are all that meets. Null keys are a group, null order values come first.
    Runs the job that writes the pieces.
    """
    rows = in_pieces(df, keys, order)
    counts = rows.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "_piece", (F.sum("_n").over(group.orderBy("_piece")) - F.col("_n") - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(group).alias("_size"))
    out = join_on(rows, offsets, [*keys, "_piece"], "inner", null_safe=True).withColumn(pos, F.col("_at") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_size"))
    return out.drop("_piece", "_at", "_shift", "_size")


def blocks_by_position(
    df: DataFrame, pos: str, before: int, after: int = 0, size: int = 10_000,
    block: str = "_block", core: str = "_core",
) -> DataFrame:
    """Add a block number of `size` consecutive positions, and repeat in each block the
    `before` rows in front of it and the `after` rows behind it, with `core` false. A block is at least as long as its margins."""
    size = max(size, before, after)
    offset = F.pmod(F.col(pos) - 1, F.lit(size))
    here = ((F.col(pos) - 1 - offset) / size).cast("long")
    homes = [F.struct(here.alias("b"), F.lit(True).alias("c"))]
    if before:
        homes.append(F.when(offset >= size - before, F.struct((here + 1).alias("b"), F.lit(False).alias("c"))))
    if after:
        homes.append(F.when((offset < after) & (here > 0), F.struct((here - 1).alias("b"), F.lit(False).alias("c"))))
    return (
        df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
        .withColumns({block: F.col("_home.b"), core: F.col("_home.c")})
        .drop("_home")
    )


def over_rows(
    df: DataFrame, keys: list[str], order: list[Column],
    columns, before: int, after: int = 0, size: int = 10_000, pos: str = "_pos", keep_pos: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` ahead.

    `columns(window)` returns {name: Column} for a window over the ordered rows of a group. Runs the job of `with_position`.
    """
    placed = blocks_by_position(with_position(df, keys, order, pos=pos), pos, before, after, size)
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    out = placed.withColumns(columns(window)).where("_core").drop("_block", "_core")
    return out if keep_pos else out.drop(pos)


def by_group_size(df: DataFrame, keys: list[str], whole, pieces, most: int = GROUP_ROWS) -> DataFrame:
    """`whole(rows)` of the groups with at most `most` rows and `pieces(rows)` of the larger ones, put together.

    A group of the first kind fits one task, so `whole` may gather its rows by `keys` once and do all its steps there. The rows per group
    are counted first, which reads the keys of `df` and runs that job; `df` should be a stored table or cheap to read. Null keys are a group.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(counts.where(F.col("_n") > most).select(*keys), "large")
    if large.isEmpty():
        return whole(df)
    small = whole(join_on(df, large, keys, "left_anti", null_safe=True))
    return small.unionByName(pieces(join_on(df, large, keys, "left_semi", null_safe=True)))


def last_known(df: DataFrame, keys: list[str], ts: str, cols: list[str], hours: float, most: int = GROUP_ROWS) -> DataFrame:
    """Replace nulls of `cols` by the group's last value before them that is at most `hours` old.

    A row without a time fills and is filled by nothing; rows of one time are taken in the order of `in_pieces`. `df` is written to the shared
    folder, as its groups are counted before; groups of more than `most` rows go in pieces. Runs those jobs.
    """
    return by_group_size(
        cut_lineage(df, "rows"), keys, lambda rows: last_known_whole(rows.repartition(*keys), keys, ts, cols, hours),
        lambda rows: last_known_in_pieces(rows, keys, ts, cols, hours), most)


def _entry(c: str, *place: str) -> Column:
    """The value of a row that has one and a time, with its place in the order."""
    return F.when(F.col(c).isNotNull() & F.col("_us").isNotNull(), F.struct(*place, "_us", F.col(c).alias("v")))


def _filled_from(known: DataFrame, columns: list[str], cols: list[str], hours: float) -> DataFrame:
    """`columns`, where nulls of `cols` are the value in their ``_k_`` entry if that is young enough."""
    reach = int(hours * MICROS_PER_HOUR)
    return known.select(*[
        F.coalesce(F.col(c), F.when(F.col("_us") - F.col(f"_k_{c}")["_us"] <= reach, F.col(f"_k_{c}")["v"])).alias(c)
        if c in cols else F.col(c) for c in columns])


def last_known_whole(df: DataFrame, keys: list[str], ts: str, cols: list[str], hours: float) -> DataFrame:
    """`last_known` with one window per group, for groups that fit one task. `df` should be partitioned by `keys`, or the
    shuffle in front of the window also carries the entries. Lazy."""
    rows = df.withColumn("_us", micros(F.col(ts)))
    rest = F.xxhash64(*[F.col(c) for c in rows.columns])
    inside = Window.partitionBy(*keys).orderBy("_us", rest).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumns({f"_k_{c}": F.last(_entry(c), ignorenulls=True).over(inside) for c in cols})
    return _filled_from(known, df.columns, cols, hours)


def last_known_in_pieces(df: DataFrame, keys: list[str], ts: str, cols: list[str], hours: float) -> DataFrame:
    """`last_known` for groups of any size.

    Rows lie in pieces of equal size, however many fall into one hour. What a piece knows of each column at its end is handed to
    the pieces of the same group behind it, so no rows are repeated: only groups that go on in another piece have such a state,
    and only rows of their last `hours` make it up. Ends and states, about one row per piece, are written to the shared folder, so that Spark knows
    their size and joins them without a shuffle of the rows. Runs these jobs.
    """
    reach = int(hours * MICROS_PER_HOUR)
    rows = in_pieces(df.withColumn("_us", micros(F.col(ts))), keys, [F.col("_us")])
    ends = rows.groupBy(*keys, "_piece").agg(F.max("_us").alias("_end"))
    group = Window.partitionBy(*keys).orderBy("_piece")
    going_on = cut_lineage(ends.withColumn("_next", F.lead("_piece").over(group)).where("_next is not null"), "ends")
    tails = join_on(rows, going_on, [*keys, "_piece"], "inner", null_safe=True).where(F.col("_us") >= F.col("_end") - reach)
    at_end = tails.groupBy(*keys, F.col("_next").alias("_piece")).agg(*[F.max(_entry(c, "_at")).alias(f"_s_{c}") for c in cols])
    states = cut_lineage(at_end.select(*keys, "_piece", *[F.last(f"_s_{c}", ignorenulls=True).over(
        group.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_k_{c}") for c in cols]), "states")
    inside = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # partitioned here, because a shuffle in front of the window would also carry the entries
    known = join_on(rows.repartition(*keys, "_piece"), states, [*keys, "_piece"], "left", null_safe=True).withColumns(
        {f"_k_{c}": F.coalesce(F.last(_entry(c, "_at"), ignorenulls=True).over(inside), F.col(f"_k_{c}")) for c in cols})
    return _filled_from(known, df.columns, cols, hours)


def value_bins(values: DataFrame, value: str, keys: list[str] = []) -> DataFrame:
    """Cut points that split each group's rows into about 256 equal shares, one row per
    group: 255 ascending ``_cuts``, and every sixteenth of them as ``_coarse``. Built from a
    mergeable sketch."""
    shares = [i / 256 for i in range(1, 256)]
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("_cuts"))
    return cuts.withColumn("_coarse", F.transform(
        F.sequence(F.lit(15), F.lit(239), F.lit(16)), lambda i: F.get(F.col("_cuts"), i)))


def bin_of(value: Column, cuts: Column, coarse: Column) -> Column:
    """Number of cut points below the value; equal values share a bin. Looks through the
    coarse cuts, then through the fifteen cuts between two of them."""
    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda c: c < value))

    k = below(coarse)
    return k * 16 + below(F.slice(cuts, k * 16 + 1, F.lit(15)))


def cumulative_counts(counts: DataFrame, keys: list[str], value: str = "_v", n: str = "_n") -> DataFrame:
    """Add ``_start``, ``_end`` (how many rows lie below and up to a distinct value) and
    ``_total`` per group.

    The distinct values of a group are cut into about 256 equal bins; a task orders one bin,
    and only the bin totals of a group meet in one place.
    """
    binned = (
        join_on(counts, value_bins(counts, value, keys), keys, "inner", null_safe=True)
        .withColumn("_bin", bin_of(F.col(value), F.col("_cuts"), F.col("_coarse"))).drop("_cuts", "_coarse")
    )
    along = Window.partitionBy(*keys).orderBy("_bin")
    spans = binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_bn")).select(
        *keys, "_bin", (F.sum("_bn").over(along) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    placed = binned.withColumn("_in", F.sum(n).over(inside))
    return (
        join_on(placed, spans, [*keys, "_bin"], "inner", null_safe=True)
        .withColumn("_end", F.col("_before") + F.col("_in")).withColumn("_start", F.col("_end") - F.col(n))
        .drop("_bin", "_before", "_in")
    )


def with_rank(df: DataFrame, score: str, rank: str, keys: list[str] = [], descending: bool = True) -> DataFrame:
    """Competition rank (1, 1, 3) by score; null scores get no rank.

    Made for aggregates: `df` is read three times, so it is written to the shared folder
    first, which runs one job.
    """
    keyed = cut_lineage(df.withColumn("_v", F.col(score) * (-1 if descending else 1)), "ranked")
    counts = keyed.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulative_counts(counts, keys).select(*keys, "_v", (F.col("_start") + 1).alias(rank))
    return join_on(keyed, ranks, [*keys, "_v"]).drop("_v")
