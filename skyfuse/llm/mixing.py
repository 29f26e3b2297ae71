"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight; in
ascending order of the keys each source is a weighted sample without
replacement. A source whose target is e + f times its size gives e complete
epochs, then the documents whose prefix sum of words stays within f of it.

Prefix sums need no source in one task: keys fall into buckets, bucket totals are
summed per source, and the bucket that the budget ends in is parted again until it
is small; only that one is sorted, equal places as one. DataFrame operations
throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2.0
BUCKETS = 4096
SORTED = 1 << 20  # rows of a source that are sorted at most, but for rows of equal keys


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from 0.1 to 1: highest for texts of some length whose words are of usual length."""
    mean = F.coalesce(F.length(text), F.lit(0)).cast("double") / F.greatest(size, F.lit(1))
    usual = F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 4.0)
    return F.greatest(F.lit(0.1), usual * (size + 1.0) / (size + 20.0))


def _keyed(docs: DataFrame, weight: Column | None) -> DataFrame:
    """docs with __mix_size and __mix_key."""
    sized = docs.withColumn("__mix_size", size_of(F.col("text")))
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(2.0**52)
    return sized.withColumn("__mix_key", -F.log(u) / (quality(F.col("text"), F.col("__mix_size")) if weight is None else weight))


def _narrow(keyed: DataFrame) -> DataFrame:
    return materialize(keyed.select(F.col("doc_id").alias("id"), "source", F.col("__mix_size").alias("size"), F.col("__mix_key").alias("key")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds target: the sources
    share budget times all words by weight; a share stops at `most` times its
    source and the excess goes to the others by weight.

    Filled in ascending order of most * size / weight, the level common to the
    sources that are not full is the highest of those reached on the way."""
    everything = Window.partitionBy()
    n = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    full = sizes.withColumn("__weight", weight).withColumn("__full", most * F.col("source_size"))
    order = Window.orderBy(F.col("__full") / F.col("__weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("__weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = full.withColumn("__level", (budget * F.sum("source_size").over(everything) - before) / after)
    target = F.least(F.col("__full"), F.max("__level").over(everything) * F.col("__weight"))
    return level.select("source", "source_size", target.alias("target"))


def _thresholds(narrow: DataFrame, weights, budget, most) -> DataFrame:
    """A row per source: __mix_source, source_size, target, __mix_epochs, and where the
    part taken once more ends: before or at the place __mix_cut (key, id, size), of
    whose __mix_copies equal rows __mix_room are taken."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    goal = targets(sizes, weights, budget, most).withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal.withColumnRenamed("source", "of"))
    inside = narrow.join(goal.select("of", "rest").where("rest > 0"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("offset", F.lit(0).cast("long"))
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BUCKETS)
    while True:
        # of each source the first bucket that the budget does not cover, else its last
        sums = inside.withColumn("bucket", F.least(bucket, F.lit(BUCKETS - 1))).groupBy("source", "rest", "offset", "bucket")
        sums = sums.agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        by_key = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("offset") + F.sum("n").over(by_key)).withColumn("last", F.lead("bucket").over(by_key).isNull())
        ends = sums.where((F.col("upto") > F.col("rest")) | F.col("last")).groupBy("source", "rest")
        ends = ends.agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("offset"), "rows", "low", "high")).alias("x"))
        ends = materialize(ends.select(F.col("source").alias("of"), "rest", "x.offset", "x.rows", "x.low", "x.high"))
        held = F.col("source").eqNullSafe(F.col("of")) & F.col("key").between(F.col("low"), F.col("high"))
        inside = narrow.join(ends, held).select("id", "source", "size", "key", "rest", "offset", "low", "high")
        if not ends.where((F.col("rows") > SORTED) & (F.col("low") < F.col("high"))).head(1):
            break
        bucket = F.when(F.col("low") < F.col("high"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)).otherwise(0).cast("long")
    places = inside.groupBy("source", "rest", "offset", "key", "id", "size").agg(F.count("*").alias("copies"))
    before = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    places = places.withColumn("before", before)
    fits = lambda j: F.col("before") + j * F.col("size") - F.col("size") / 2.0 <= F.col("rest")
    about = F.floor((F.col("rest") - F.col("before")) / F.greatest("size", F.lit(1)) + 0.5)
    room = F.when(F.col("size") == 0, F.when(fits(F.lit(1)), F.col("copies")).otherwise(0)).otherwise(F.when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1))
    places = places.withColumn("room", F.least(F.greatest(room, F.lit(0)), F.col("copies"))).where("room > 0")
    cut = places.groupBy("source").agg(F.max(F.struct(F.struct("key", "id", "size").alias("place"), "room", "copies")).alias("x"))
    # where even the first place of the last bucket does not fit, all before that bucket is taken
    cut = ends.select(F.col("of").alias("to"), "low").join(cut, F.col("to").eqNullSafe(F.col("source")), "left").select("to", "low", "x")
    joined = goal.join(cut, F.col("of").eqNullSafe(F.col("to")), "left")
    return materialize(joined.select(F.col("of").alias("__mix_source"), "source_size", "target", F.col("epochs").alias("__mix_epochs"), F.col("low").alias("__mix_low"), F.col("x.place").alias("__mix_cut"), F.col("x.room").alias("__mix_room"), F.col("x.copies").alias("__mix_copies")))


def _taken(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    """keyed with limits' columns and __mix_taken, how often each row is taken."""
    named = limits.select(*[F.col(c).alias(c if c.startswith("__mix_") else f"__mix_{c}") for c in limits.columns])
    place = F.struct(F.col("__mix_key").alias("key"), F.col("doc_id").alias("id"), F.col("__mix_size").alias("size"))
    cut = F.col("__mix_cut")
    joined = keyed.join(named, F.col("source").eqNullSafe(F.col("__mix_source")))
    first = F.when(F.col("__mix_low").isNull(), False).when(cut.isNull(), F.col("__mix_key") < F.col("__mix_low")).otherwise(place <= cut)
    if not limits.where("__mix_room < __mix_copies").head(1):
        return joined.withColumn("__mix_taken", F.col("__mix_epochs") + first.cast("int"))
    # the budget ends between equal rows: these, of one place a source, are numbered in shares of bounded size
    edge = F.coalesce((F.col("__mix_room") < F.col("__mix_copies")) & place.eqNullSafe(cut), F.lit(False))
    rest = joined.where(~edge).withColumn("__mix_taken", F.col("__mix_epochs") + first.cast("int"))
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int")
    equal = materialize(joined.where(edge).withColumn("__mix_share", share).withColumn("__mix_row", F.monotonically_increasing_id()))
    counts = equal.groupBy("__mix_source", "__mix_share").count()
    counts = counts.withColumn("__mix_before", F.sum("count").over(Window.partitionBy("__mix_source").orderBy("__mix_share")) - F.col("count"))
    counts = counts.select(F.col("__mix_source").alias("__mix_of"), F.col("__mix_share").alias("__mix_in"), "__mix_before")
    number = F.col("__mix_before") + F.row_number().over(Window.partitionBy("__mix_source", "__mix_share").orderBy("__mix_row"))
    numbered = equal.join(counts, F.col("__mix_source").eqNullSafe(F.col("__mix_of")) & (F.col("__mix_share") == F.col("__mix_in")))
    numbered = numbered.withColumn("__mix_taken", F.col("__mix_epochs") + (number <= F.col("__mix_room")).cast("int"))
    return rest.union(numbered.select(*rest.columns))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """docs with a column copies: how often the mix takes each document (0 to `most`).

    docs needs doc_id, text and source; further columns stay, but one named copies
    gives way, and names that begin with __mix_ are reserved. weight: quality of a
    document, over 0; by default from its words' number and length. Null texts have no
    words; null is a source of its own, the last; equal keys go by doc_id and size,
    and of equal rows as many are taken as the budget has room for. The choice depends
    on doc_id, text and source alone and so does not change between runs; an empty
    table gives an empty one. Very long texts cost one pass each: only their sizes
    and keys are shuffled."""
    keyed = _keyed(docs.drop("copies"), weight)
    own = [F.col(c) for c in docs.columns if c != "copies"]
    return _taken(keyed, _thresholds(_narrow(keyed), weights, budget, most)).select(*own, F.col("__mix_taken").alias("copies"))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """The same choice without the texts: doc_id, source, size, source_size, target, copies."""
    narrow = _narrow(_keyed(docs, weight))
    again = narrow.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("__mix_size"), F.col("key").alias("__mix_key"))
    out = _taken(again, _thresholds(narrow, weights, budget, most))
    return out.select("doc_id", "source", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("copies"))


def op5_mixing(spark, sf_dir):
    out = mix_plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / greatest(0.1::DOUBLE, (1::DOUBLE / (1::DOUBLE + abs(length(coalesce(text, ''))::DOUBLE / greatest(size, 1) - 6::DOUBLE) / 4::DOUBLE)) * (size + 1::DOUBLE) / (size + 20::DOUBLE)) AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2::DOUBLE * source_size AS full_size FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), goals AS (
  SELECT source, source_size, least(full_size, max(level) OVER () * weight) AS target FROM levels
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goals
), placed AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS run
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND run - size / 2::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
