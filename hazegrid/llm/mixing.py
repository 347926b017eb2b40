"""Mixing sources to target weights along a curriculum whose weights change over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.operators.ordering import with_position
from hazegrid.session import cut_lineage

ROWS_PER_BUCKET = 2_000
LEAST_BUCKETS = 64
# Weights and slopes repeat over the sources in order of their names.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(rank - 1, F.lit(len(values))).cast("int") + 1)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target, slope from (source, size) rows, one row per source.

    Sources share all sizes by weight; a target stops at `most` times its source's size, and the
    excess is shared again by weight. With the sources in order of cap per weight that is one running sum: a source is capped if its
    cap is below its share of what the sources before it leave. The windows hold one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(name)).select(
        "source", "source_size", (F.col("source_size") * most).alias("cap"), _by_rank(weights, F.col("rank")).alias("weight"),
        _by_rank(slopes, F.col("rank")).alias("slope"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("left", left).withColumn("weight_left", weight_left)
    per = per.withColumn("capped", F.col("cap") * F.col("weight_left") < F.col("left") * F.col("weight"))
    open_ = per.withColumn("level", F.when(~F.col("capped"), F.struct("left", "weight_left")))
    level = F.max_by("level", F.col("weight_left") * F.when(F.col("capped"), -1).otherwise(1)).over(everything)
    return open_.withColumn("level", level).select(
        "source", "source_size", "slope",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise((F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weight_left")).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which a source has been asked for `share` of its target.

    Its rate at t is 1 + slope * (1 - 2t) of its mean, so the demand up to t is (1 + slope) t - slope t²; this inverts it."""
    a = 1 + slope
    return F.when(slope == 0, share).otherwise((a - F.sqrt(F.greatest(a * a - 4 * slope * share, F.lit(0.0)))) / (2 * slope))


def curriculum_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_PASSES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions for each row, and the columns `carry`.

    A source's documents form a queue in order of the md5 of their ids, repeated up to `most` times. The queue is consumed up to
    the source's target; a pass over a document counts if its middle lies before that point, so the words taken differ
    from the target by at most half a document. `positions` are the training times of its passes, found by
    inverting the source's cumulative demand at the middle of each pass.

    A source may hold a third of all rows: its queue is cut into buckets by md5, bucket sums meet in a window, and rows are
    ordered within their bucket only. Sizes are written to the shared folder first, without texts (runs a job).

    Sizes and keys are made of whole texts, however long. A null text has size 0; documents of size 0 take up no words and have the passes
    that their place in the queue gives them. A null source is a source of its own, last in order; rows without an id are queued by the md5 of their texts, so that many of
    them spread like others. Repeated rows queue up as often as they occur; ties are rows alike in id, source and size, which may change places. Without any word all targets are 0. An empty table gives an empty result. Clashing columns
    are not read."""
    names = [f"__c{i}" for i in range(len(carry))]
    sized = cut_lineage(df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))).alias("key"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)]), "sizes")
    buckets = max(LEAST_BUCKETS, sized.count() // ROWS_PER_BUCKET)
    cell = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).alias("bucket")
    queue = sized.select("*", cell)
    sums = queue.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.select("source", F.col("words").alias("size")), weights, slopes, most)
    ahead = (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("ahead")
    cells = sums.select("source", "bucket", ahead).alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("s"), F.col("c.bucket").alias("b"), "ahead", "source_size", "target", "slope")
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    placed = queue.withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    begin = F.col("ahead") + F.col("within")
    twice = [2 * (p * F.col("source_size") + begin) + F.col("size") for p in range(most)]
    times = F.array(*[F.when(x <= 2 * F.col("target"), F.when(F.col("target") > 0, position(x / (2 * F.col("target")), F.col("slope"))).otherwise(0.0))
                      for x in twice])
    return placed.withColumn("positions", F.array_compact(times)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions",
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])


def training_order(mix: DataFrame) -> DataFrame:
    """One row per document and pass with its training `position` and, from 1 on, its `place` in the whole order; stored sorted by it.

    The passes are partitioned by ranges of the position and sorted within, and places follow from the number of passes in the ranges before. Equal positions
    go by id (nulls first) and then by the other columns. `mix` is evaluated once; runs the job that writes the sorted passes."""
    passes = mix.withColumn("position", F.explode("positions")).drop("positions")
    return with_position(passes, [], [F.col("position"), F.col("doc_id")], pos="place")


def mixed(df: DataFrame) -> DataFrame:
    """The mix as one row per document: doc_id, size, source_size, target, taken, and from the training order `n_passes` (0 to 3), `first_position` and `first_place` (null
    without a pass)."""
    mix = cut_lineage(curriculum_mix(df).withColumn("row", F.monotonically_increasing_id()), "mix")
    placed = training_order(mix.select("row", "doc_id", "positions")).groupBy("row").agg(
        F.count("*").alias("n_passes"), F.min("position").alias("first_position"), F.min("place").alias("first_place"))
    return mix.drop("positions").join(placed.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left").select(
        "doc_id", "size", "source_size", "target", "taken", F.coalesce("n_passes", F.lit(0)).alias("n_passes"), "first_position", "first_place")


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))) as key from documents),
p as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight,
  ((row_number() over (order by source nulls last) - 1) % 3 - 1) * 0.5::double as slope from d group by source),
o as (select *, 3 * source_size as cap,
        sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
        sum(weight) over () - coalesce(sum(weight) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights
      from p),
c as (select *, cap * weights < room * weight as capped from o),
l as (select arg_max(room, weights) as room, max(weights) as weights from c where not capped),
t as (select c.source, c.source_size, c.slope, case when capped then cap::double else (l.room * c.weight)::double / l.weights end as target from c, l),
q as (select d.doc_id, d.size, t.source_size, t.target, t.slope, row_number() over () as number,
        sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as ahead
      from d join t on d.source is not distinct from t.source),
x as (select q.*, 2 * (pass * source_size + ahead) + size as twice from q, range(3) as p(pass)),
u as (select *, 1 + slope as a, case when target > 0 then twice / (2 * target) else 0 end as share from x where twice <= 2 * target),
v as (select *, case when target <= 0 then 0 when slope = 0 then share
  else (a - sqrt(greatest(a * a - 4 * slope * share, 0))) / (2 * slope) end as position from u),
w as (select *, row_number() over (order by position, doc_id nulls first, number) as place from v),
g as (select number, count(*) as n, min(position) as first_position, min(place) as first_place from w group by number)
select doc_id, size::bigint as size, source_size, target, (size * coalesce(n, 0))::bigint as taken, coalesce(n, 0)::bigint as n_passes, first_position, first_place
from q left join g using (number)
"""
