"""Operator 6: mixing sources to target weights; DataFrame functions only.

Targets: the sources, in code point order with null last, weigh 3, 1, 2 repeating, and share `ratio` times all
sizes; no target passes `most` times its source's size, and the excess goes to the others by weight. Sorted by
cap / weight, the capped sources come first, so one running sum gives the level at which none is above its cap.

Selection: each document is taken once for every complete epoch of its target; the rest of the target is filled in
the order of Efraimidis-Spirakis keys -ln(u) / weight. Whole documents are taken: up to the one whose middle passes
the rest, so a source misses its target by half a document at most. Keys fall into buckets on a log scale; sums by
(source, bucket) show in which single bucket a source's cut lies, sums of its 4,096 parts in which part, and only that
part's rows are sorted: less than a millionth of a source. A hot source is thus never sorted or gathered whole.

Defined results: null texts have size 0; a null source is a source of its own, the last; sources without words get
target 0; rows with equal doc_id and size share a key and are taken or left together, null doc_ids too; an empty
table gives an empty result; other columns are carried only by mixed(), under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words_count

PATTERN = (3, 1, 2)
SEED = "epoch-0"


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: 1 where words are 6 characters long with their blank, less the further from that."""
    mean = F.char_length(text) / F.when(size > 0, size)
    return F.coalesce(1 / (1 + F.abs(F.ln(mean / 6))), F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential with rate `weight`; u is 52 bits of a digest of the seed and the id, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def targets(sizes: DataFrame, ratio: float = 1.5, most: int = 2, pattern: tuple[int, ...] = PATTERN) -> DataFrame:
    """source, source_size -> with target added; a row per source."""
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(pattern)))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, pattern)), turn.cast("int") + 1)).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (ratio * F.sum("source_size").over(everything) - before) / weight
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def _keyed(df: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    sized = df.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), words_count(F.col(text)).alias("size"), F.col(text).alias("text"))
    keyed = sized.withColumn("k", sampling_key(F.col("doc_id"), quality(F.col("text"), F.col("size")), seed)).drop("text")
    fine = F.floor((1 << 20) * F.log2("k")).cast("long")
    return keyed.withColumn("fine", fine).withColumn("bucket", F.shiftright("fine", 12).cast("int"))


def _plan(scratch: Scratch, keyed: DataFrame, ratio: float, most: int) -> DataFrame:
    """Per source: size, target, complete epochs, and the last key, id and size of the fractional part."""
    sums = scratch.keep(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("s")), "buckets")
    sizes = scratch.keep(sums.groupBy("source").agg(F.sum("s").alias("source_size")), "sizes")
    wanted = targets(sizes, ratio, most).withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long"))
    wanted = scratch.keep(wanted.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    upto = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
    cuts = sums.withColumn("upto", upto).join(wanted.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    cuts = cuts.where("rest > 0 AND upto >= rest AND upto - s < rest").select(F.col("name").alias("cut_source"), F.col("bucket").alias("cut_bucket"), (F.col("upto") - F.col("s")).alias("before"), "rest")
    cuts = scratch.keep(cuts, "cuts")
    inside = keyed.select("source", "bucket", "fine", "k", "doc_id", "size").join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bucket") == F.col("cut_bucket")))
    fines = inside.groupBy("cut_source", "cut_bucket", "fine", "before", "rest").agg(F.sum("size").alias("s"))  # at most 4,096 for a source
    fines = fines.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("cut_source").orderBy("fine")))
    cuts = fines.where("upto >= rest AND upto - s < rest").select(F.col("cut_source").alias("c_source"), F.col("cut_bucket").alias("c_bucket"), F.col("fine").alias("cut_fine"), (F.col("upto") - F.col("s")).alias("base"))
    cuts = scratch.keep(cuts, "fine_cuts")
    inside = inside.join(cuts, F.col("cut_source").eqNullSafe(F.col("c_source")) & (F.col("fine") == F.col("cut_fine")))
    peers = inside.groupBy("cut_source", "base", "rest", "k", "doc_id", "size").agg(F.sum("size").alias("tied"))
    run = F.col("base") + F.sum("tied").over(Window.partitionBy("cut_source").orderBy("k", "doc_id", "size"))
    taken = peers.withColumn("run", run).where("2 * run - tied <= 2 * rest").groupBy("cut_source").agg(F.max(F.struct("k", "doc_id", "size")).alias("last"))
    ends = cuts.join(taken.withColumnRenamed("cut_source", "taken_source"), F.col("c_source").eqNullSafe(F.col("taken_source")), "left").select("c_source", F.lit(True).alias("is_cut"), "cut_fine", "last")
    plan = wanted.join(ends, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return scratch.keep(plan.select(F.col("source").alias("name"), "source_size", "target", "epochs", "rest", "is_cut", "cut_fine", "last"), "plan")


def _times(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """keyed with source_size, target and how often each row is taken; the plan has a row per source and is
    broadcast only where its files are below spark.sql.autoBroadcastJoinThreshold."""
    below = F.coalesce(F.struct("k", "doc_id", "size") <= F.col("last"), F.lit(False)) & (F.col("fine") == F.col("cut_fine"))
    part = F.when(F.col("is_cut"), (F.col("fine") < F.col("cut_fine")) | below).otherwise(F.lit(False))
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("name")))
    return joined.withColumn("times", F.col("epochs") + part.cast("long"))


def mix(df: DataFrame, ratio: float = 1.5, most: int = 2, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken (words, repeats counted) for every row; texts are read once."""
    scratch = Scratch(df.sparkSession, "mix")
    keyed = scratch.keep(_keyed(df, key, text, source, seed).drop("row"), "keyed")
    out = _times(keyed, _plan(scratch, keyed, ratio, most))
    return out.select(F.col("doc_id").alias(key), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, ratio: float = 1.5, most: int = 2, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns of the input."""
    keyed = _keyed(df, key, text, source, seed)
    slim = Scratch(df.sparkSession, "mixed")
    plan = _plan(slim, slim.keep(keyed.drop("row"), "keyed"), ratio, most)
    rows = _times(keyed, plan).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("epoch"))
    return rows.select("row.*")


#: DuckDB: the same sums with plain windows over whole sources.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('epoch-0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN size > 0 THEN 1 / (1 + abs(ln(CAST(length(text) AS DOUBLE) / size / 6))) ELSE 1.0 END AS k
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources
), leveled AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT max(level) FROM leveled)) AS target FROM leveled
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
), runs AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size) AS run,
    sum(k.size) OVER (PARTITION BY k.source, k.k, k.doc_id, k.size) AS tied
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * run - tied <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM runs
"""
