"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words; a document's expected copies are its source's target over
its source's size. Within a source, ordered by size, the expected copies are summed from the
front, one offset is added, and a document is taken once per whole number its own share crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.common import WORD, materialise

#: Weights of the sources in code-point order, again and again; null comes last.
WEIGHTS = (5, 2, 1)
#: No target is above so many times its source's size.
CAP = 3
#: Fractions are whole numbers of 2^-28, so that prefix sums are exact whatever the order of adding.
BITS = 28
#: The index within a partition, in the ids that Spark gives rows.
_INDEX = (1 << 33) - 1


def size_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target per source from (source, source_size): shares of all words by weight, none above its cap.

    The level x with sum(least(cap_i, x * w_i)) = total is found in closed form: sources in
    order of cap over weight, those before the level are at their cap.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "source_rank")
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = sources.withColumn("source_rank", F.row_number().over(in_order).cast("long")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    levels = (
        ranked.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0))) / F.sum("weight").over(after))
        # The first source that is not at its cap sets the level for itself and all after it.
        .withColumn("open", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(everything))
    )
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("open.level") * F.col("weight"))
    return levels.select("source", "source_rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, source, size).

    doc_id may be of any type that sorts; other columns are ignored.

    A null source is a source of its own, the last; null ids sort first; documents without a
    word add nothing and may be taken or not; repeated rows are sampled each for itself; no
    rows give no rows. Ranks come from a range partitioning by (source, size, doc_id): no
    source, however large, meets in one task.
    """
    spark = docs.sparkSession
    held = ["doc_id", "source", "size"]
    docs = materialise(docs.select(*held), "mix-sizes")  # words are counted once
    goals = materialise(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    goals = goals.withColumnsRenamed({c: f"_{c}" for c in goals.columns})
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        docs.repartitionByRange(partitions, F.col("source").asc_nulls_last(), "size", "doc_id")
        .sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_index", F.col("_id").bitwiseAND(_INDEX)),
        "mix-ranged",
    )
    # A row per partition and source that meet: partitions + sources at most.
    runs = ranged.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.min("_index").alias("_first"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    runs = (
        runs.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", F.floor(rate))
        .withColumn("_share", F.floor((rate - F.floor(rate)) * (1 << BITS)).cast("long"))
        .withColumn("_offset", F.pmod(F.col("_source_rank") * 40503 + 12345, F.lit(65536)) * (1 << (BITS - 16)))
        .select(F.col("_part").alias("_p"), F.col("source").alias("_s"), "_first", "_before", "_source_size", "_target", "_whole", "_share", "_offset")
    )
    # Joined on the partition first, which bounds every key by one partition's rows.
    joined = ranged.join(runs, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rank = F.col("_before") + F.col("_index") - F.col("_first") + 1
    crossed = F.shiftright(F.col("_offset") + rank * F.col("_share"), BITS) - F.shiftright(F.col("_offset") + (rank - 1) * F.col("_share"), BITS)
    return joined.select(*held, F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_whole") + crossed).alias("copies"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and others) as often as their source's target asks for; those not taken go.

    Rows are numbered and written once, so that every row is a key of its own, however many are
    alike; only numbers, sources and sizes are ranked. Rows of one doc_id are ranked by a hash of
    their columns (map columns left out), and rows alike in all of them by their number. Columns
    keep their names, whatever they are.
    """
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    n, one, total = (f"mix_{x}{'_' * max(map(len, docs.columns))}" for x in ("row", "of", "copies"))
    marked = materialise(docs.withColumn(n, F.monotonically_increasing_id()), "mix-rows")
    alike = F.xxhash64(*[name(c) for c, t in docs.dtypes if "map<" not in t])
    thin = marked.select(F.struct(F.col("doc_id").alias("id"), alike.alias("h"), F.col(n).alias("n")).alias("doc_id"), "source", size_of(F.col("text")).alias("size"))
    taken = mix_sources(thin).where("copies > 0").select(F.col("doc_id.n").alias(one), F.col("copies").alias(total))
    dealt = marked.join(taken, F.col(n) == F.col(one)).withColumn(total, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))))
    return dealt.select(*[name(c) for c in docs.columns])


def op2_sql() -> str:
    """The same mix in DuckDB."""
    return r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source is null, encode(source)) as source_rank from s),
w as (select *, case (source_rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from r),
l as (select *, cast(3 * source_size as double) / weight as ratio from w),
v as (select *, cast(cast(sum(source_size) over () as bigint) - coalesce(cast(sum(3 * source_size) over (order by ratio, source_rank rows between unbounded preceding and 1 preceding) as bigint), 0) as double)
             / cast(sum(weight) over (order by ratio, source_rank rows between current row and unbounded following) as bigint) as level from l),
o as (select level from v where level <= ratio order by ratio, source_rank limit 1),
t as (select source, source_rank, source_size, coalesce(least(cast(3 * source_size as double), (select level from o) * weight), 0.0) as target from v),
g as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate, (source_rank * 40503 + 12345) % 65536 * 4096 as u from t),
f as (select *, cast(floor(rate) as bigint) as whole, cast(floor((rate - floor(rate)) * 268435456) as bigint) as share from g),
k as (select d.doc_id, d.size, d.source, row_number() over (partition by d.source order by d.size, d.doc_id nulls first) as i from d)
select k.doc_id, k.size, f.source_size, f.target, k.size * (whole + ((u + i * share) >> 28) - ((u + (i - 1) * share) >> 28)) as taken
from k join f on k.source is not distinct from f.source
"""
