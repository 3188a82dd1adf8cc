"""Mixing sources to target weights by entropy balancing.

Each document gets the rate exp(lambda * size / scale), with one lambda for each source and at most MOST;
of all rates that meet the source's token constraint (the sum of rate * size is its target) and stay
below MOST, these have the least relative entropy to one copy of every document, and so are tilted
exponentially in the size: a source that must shrink gives up its long documents first, one that must
grow repeats them first. The lambdas minimise the convex dual
  sum over documents of d(lambda * size / scale) - lambda * target / scale,
with d(x) = exp(x) up to MOST and linear beyond. A Newton iteration is one distributed aggregate of
tilted sums over (source, size) with its counts; each source keeps a bracket around its root, and a
step that would leave it halves it. Iterations end when every source meets its target to within
CLOSE of its size. Only the number of sources that are still open reaches the driver.

Rates become copies by systematic rounding: documents of a source are ordered by size, and one gets a
further copy where the running sum of the fractions passes a whole number, so a source's words
miss the target by about one document.

Targets: weights 5, 2, 1, repeating over the sources by code point (null last); no target is above
three times its source's size, the excess going to the others by weight.

Defined cases: a null text has size 0 and stays with taken 0; a null source is a source, ordered
last; a source without words has target 0; repeated rows count one by one; an empty table gives no
rows; a very long text is one number; other columns are kept by ``mixed``, whatever their names, and
ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import n_words, private, stable, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of one source and size that one task may rank, on average; the salts that deal them follow from the count.
SALT_ROWS, LEAST_SALTS = 1 << 16, 64
#: Rates are rounded to so many parts before the copies are counted, so that reruns agree.
PARTS = 1_000_000
#: Share of a source's size to which its target is met, most iterations, largest size of a multiplier.
CLOSE, NEWTON_STEPS, LARGEST = 1e-12, 100, 1e4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: water filling with caps. One row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = sizes.withColumn("k", F.row_number().over(order) - 1)
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("k") % len(weights) + 1).cast("double"))
    w = w.withColumn("cap", F.lit(most) * F.col("source_size"))
    rise = Window.orderBy(F.col("cap") / F.col("w"), "k")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumn("level", (F.sum("source_size").over(everything) - before) / F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(rise).alias("at"), "level"))
    w = w.withColumn("fits", fits).withColumn("level", F.min("fits").over(everything)["level"])
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce("level", F.lit(0.0)))).select("source", "source_size", "target")


def multipliers(cells: DataFrame) -> DataFrame:
    """source, size, n (documents) -> source, source_size, target, scale, lambda: a row for each source.

    lambda is null where every document takes MOST copies (the target is all the source can give) or
    none (it has no words).
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"))
    scale = (F.col("source_size") / F.col("filled")).alias("scale")
    per = targets(sums).withColumnRenamed("source", "t_source")
    state = sums.select("source", scale).join(per, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    solvable = (F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - CLOSE))
    state = stable(state.select("*", solvable.alias("open"), *[F.lit(x).alias(c) for c, x in (("lambda", 0.0), ("low", -LARGEST), ("high", LARGEST))]))
    fixed, state = state.filter("NOT open"), state.filter("open")
    tilted = cells.filter("size > 0").select(F.col("source").alias("c_source"), "size", "n")
    for step_no in range(NEWTON_STEPS + 1):
        if not (left := state.filter("open").count()):
            break
        if step_no == NEWTON_STEPS:
            raise ArithmeticError(f"{left} sources miss their target after {NEWTON_STEPS} Newton steps")
        x = F.col("lambda") * F.col("size") / F.col("scale")
        rate, words = F.least(F.exp(F.least(x, F.lit(5.0))), F.lit(float(MOST))), F.col("size") * F.col("n")
        met = tilted.join(state.filter("open").select("source", "lambda", "scale"), F.col("c_source").eqNullSafe(F.col("source"))).groupBy("c_source").agg(
            F.sum(words * rate).alias("taken"), F.sum(F.when(rate < MOST, words * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("slope")
        )
        both = state.join(met, F.col("source").eqNullSafe(F.col("c_source")), "left")
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("lambda")).otherwise(F.col("low")), F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        # the middle of a bracket that spans magnitudes is taken near zero first
        step, middle = F.col("lambda") - F.try_divide(gap, F.col("slope")), (low + high) / 2
        fits = F.coalesce((step > low) & (step < high) & (F.abs(step - F.col("lambda")) < 4), F.lit(False))
        near = F.when(gap < 0, F.least(middle, F.col("lambda") + 4)).otherwise(F.greatest(middle, F.col("lambda") - 4))
        going = F.col("open") & (F.abs(gap) > CLOSE * F.col("source_size")) & (high - low > 1e-15 * F.greatest(F.abs(low), F.abs(high)))
        moved = F.when(going, F.when(fits, step).otherwise(near)).otherwise(F.col("lambda")).alias("lambda")
        kept = [F.when(F.col("open"), c).otherwise(F.col(n)).alias(n) for n, c in (("low", low), ("high", high))]
        state = stable(both.select("source", "scale", "source_size", "target", F.coalesce(going, F.lit(False)).alias("open"), moved, *kept))
    done = state.select("source", "source_size", "target", "scale", "lambda")
    return done.unionByName(fixed.select("source", "source_size", "target", "scale", F.lit(None).cast("double").alias("lambda")))


def copies(docs: DataFrame) -> DataFrame:
    """docs with source, size, doc_id, tie -> also source_size, target, rate, copies.

    Running sums come from counts of (source, size, salt) and the place inside such a part, so no task
    gathers a source: its running sums hold one row for each distinct size, those of the salts run
    within one size. Parts hold about SALT_ROWS rows at most, as the salts follow from the count.
    """
    salts = max(LEAST_SALTS, -(-docs.count() // SALT_ROWS))
    parts = docs.withColumn("salt", F.pmod(F.coalesce("doc_id", "tie"), F.lit(salts)).cast("int"))
    cells = stable(parts.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per = multipliers(sizes).withColumnRenamed("source", "s_source")
    # a share of PARTS for each document: exp differs in its last digit between machines, this does not
    rate = F.least(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(5.0))), F.lit(float(MOST)))
    parts_of = F.when(F.col("size") == 0, 0).when(F.col("lambda").isNotNull(), F.round(rate * PARTS)).when(F.col("source_size") > 0, MOST * PARTS).otherwise(0)
    sizes = sizes.join(per, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("parts", parts_of.cast("long")).withColumn("share", F.col("parts") % PARTS)
    larger = Window.partitionBy("z_source").orderBy(F.desc("z_size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("source").alias("z_source"), F.col("size").alias("z_size"), "n", "source_size", "target", "parts", "share")
    sizes = sizes.withColumn("larger", F.coalesce(F.sum((F.col("n") * F.col("share")).cast("decimal(38,0)")).over(larger), F.lit(0).cast("decimal(38,0)"))).withColumn("larger", (F.col("larger") % PARTS).cast("long")).drop("n")
    beside = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("beside", F.coalesce(F.sum("n").over(beside), F.lit(0)))
    cells = cells.join(sizes, F.col("source").eqNullSafe(F.col("z_source")) & (F.col("size") == F.col("z_size")))
    cells = cells.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("salt").alias("c_salt"), "larger", "beside", "source_size", "target", "parts", "share")
    placed = parts.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", "tie")))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("salt") == F.col("c_salt"))
    out = placed.join(cells, same).withColumn("at", F.col("beside") + F.col("rank"))
    more = F.expr(f"(larger + at * share + {PARTS // 2}) div {PARTS} - (larger + (at - 1) * share + {PARTS // 2}) div {PARTS}")
    return out.withColumns({"copies": F.expr(f"parts div {PARTS}") + more, "rate": F.col("parts") / PARTS}).drop("c_source", "c_size", "c_salt", "salt", "rank", "larger", "beside", "at", "share", "parts")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie (a hash of the text): written once, as the texts are read three times else."""
    return stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken."""
    return copies(_sized(docs)).withColumn("taken", F.col("copies") * F.col("size")).drop("tie")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it; a row may be left out.

    Rows of one doc_id, source and text share their copies: one of them stands for all. The texts
    are shuffled once, to meet their copies.
    """
    names = private(docs, "mix_id", "mix_source", "mix_tie", "mix_copies", "mix_copy")
    i, s, tie, n, copy = names
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(i), F.coalesce("source", F.lit("\0")).alias(s))
    per = copies(_sized(docs)).select(*keys, F.col("tie").alias(tie), "copies").groupBy(i, s, tie).agg(F.sum("copies").alias(n))
    keyed = docs.select("*", *keys, F.xxhash64("text").alias(tie))
    one = keyed.join(per.filter(F.col(n) > 0), [i, s, tie]).dropDuplicates([i, s, tie])
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_RATE = f"least({MOST}.0, exp(least(l * size / scale, 5.0)))"
#: The multipliers by bisection of the constraint, where the sum of rate * size grows with the multiplier.
ORACLE_OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, text FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / nullif(count(*) FILTER (size > 0), 0) AS scale, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][(k % {len(WEIGHTS)} + 1)::INT] AS w, {MOST} * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, k) AS pos FROM w
), t AS (
  SELECT k, source, source_size, scale, least(cap::DOUBLE, w * (arg_min(level, pos) FILTER (level * w <= cap) OVER ())) AS target FROM l
), cell AS (
  SELECT t.k, t.target, t.scale, d.size, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WHERE d.size > 0 AND t.target < {MOST} * t.source_size * (1 - {CLOSE}) GROUP BY ALL
), b AS (
  SELECT k, -{LARGEST}::DOUBLE AS low, {LARGEST}::DOUBLE AS high, 0.0::DOUBLE AS l, 0 AS round FROM (SELECT DISTINCT k FROM cell)
  UNION ALL
  SELECT k, low, high, (low + high) / 2, round FROM (
    SELECT b.k, CASE WHEN sum(size * n * {_RATE}) < any_value(target) THEN any_value(l) ELSE any_value(low) END AS low,
      CASE WHEN sum(size * n * {_RATE}) < any_value(target) THEN any_value(high) ELSE any_value(l) END AS high, any_value(round) + 1 AS round
    FROM b JOIN cell ON b.k = cell.k WHERE round < 80 GROUP BY b.k)
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN d.size = 0 THEN 0 WHEN b.l IS NOT NULL THEN round({_RATE} * {PARTS})::BIGINT WHEN t.source_size > 0 THEN {MOST * PARTS} ELSE 0 END AS parts
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.k = t.k AND b.round = 80
), p AS (
  SELECT *, parts % {PARTS} AS share,
    sum(parts % {PARTS}) OVER (PARTITION BY source ORDER BY size DESC, doc_id % (SELECT greatest({LEAST_SALTS}, (count(*) + {SALT_ROWS - 1}) // {SALT_ROWS}) FROM d), doc_id) AS run FROM r
)
SELECT doc_id, size, source_size, target, (size * (parts // {PARTS} + (run + {PARTS // 2}) // {PARTS} - (run - share + {PARTS // 2}) // {PARTS}))::BIGINT AS taken FROM p
"""
