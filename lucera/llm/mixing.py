"""Operator 4: mix sources to target weights along a time-varying curriculum.

Targets: sources weigh 5, 2, 1, repeating by code point order (null last), and share the whole
size; a target stops at MAX_EPOCHS times its source's size and the excess is shared again.
A source's documents, in a fixed pseudo-random order, are laid on its token line again and
again up to the target; the document at the end is cut, so the taken words meet the target.
A source's schedule is a piecewise linear weight over training time; its integral is the
cumulative demand, whose inverse gives each copy's position. Copies are range-sorted by it.

The running sum within a source runs in range partitions of (source, order), with offsets from
per-partition sums, so a source with a third of all rows spreads over many tasks. The number
of sources is not collected: shares come from aggregates of a few rows.

Defined results: null text has size 0; null source is a source, ranked last; sources of size 0
have target 0; repeated rows are separate documents, of which those of equal doc_id and text are
told apart by source; empty tables give empty results; columns of any name stay as they
are. Runs agree: order depends on doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucera.llm.common import Work, table, whole_rows, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: (time, weight) knots of each weight class: heavy sources early, light ones late.
SCHEDULES = {5: ((0.0, 1.25), (1.0, 0.75)), 2: ((0.0, 0.8), (0.5, 1.2), (1.0, 0.8)), 1: ((0.0, 0.5), (1.0, 1.5))}


def source_targets(sized: DataFrame, work: Work) -> DataFrame:
    """One row per source: source, source_size, weight, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(rank, F.lit(len(WEIGHTS))))
    per = work.save(per.withColumn("weight", weight.cast("long")), "sources")
    total = per.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    limit = F.col("source_size") * MAX_EPOCHS
    level, last = 0.0, None
    while last != level:  # each turn caps more sources; it ends when none is added
        last = level
        r = per.agg(
            F.sum(F.when(limit <= F.lit(level) * F.col("weight"), limit)).alias("capped"),
            F.sum(F.when(limit > F.lit(level) * F.col("weight"), F.col("weight"))).alias("open"),
        ).first()
        if not r["open"]:
            break
        level = (total - (r["capped"] or 0)) / r["open"]
    target = F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight"))
    return per.withColumn("target", target)


def _place(frac: Column, knots) -> Column:
    """Inverse of the cumulative, normalised weight: the time at which a share of demand is met."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, start, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        need = F.greatest(frac * whole - start, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        step = need / w0 if slope == 0 else (F.sqrt(F.lit(w0 * w0) + need * (2 * slope)) - w0) / slope
        here = F.lit(t0) + step
        out = here if out is None else F.when(frac * whole < start, out).otherwise(here)
        start += area
    return F.least(F.lit(1.0), out)


def position(frac: Column, weight: Column) -> Column:
    out = F.lit(None).cast("double")
    for w, knots in SCHEDULES.items():
        out = F.when(weight == w, _place(frac, knots)).otherwise(out)
    return out


def laid_out(docs: DataFrame, work: Work, keep: list[str]) -> DataFrame:
    """keep columns, size, source_size, weight, target, _start (words before it in its source) and taken."""
    sized = docs.withColumn("size", F.size(words_of(F.col("text"))).cast("long"))
    order = order_hash()
    cols = list(dict.fromkeys([*keep, "doc_id", "source", "size"]))
    # written first: the range shuffle samples its input, and must not split every text again for it
    ranged = work.save(sized.withColumn("_order", order).select(*cols, "_order"), "sized")
    ranged = ranged.repartitionByRange(F.col("source").asc_nulls_last(), "_order", "doc_id")
    ranged = work.save(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    by_part = ranged.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = by_part.select(F.col("source").alias("_s"), F.col("_part").alias("_q"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    targets = source_targets(ranged, work).withColumnRenamed("source", "_src")
    heads = heads.join(targets, heads["_s"].eqNullSafe(targets["_src"])).drop("_src")
    inside = Window.partitionBy("_part", "source").orderBy("_order", "doc_id", "size")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranged.withColumn("_run", run)
    placed = placed.join(heads, (placed["_part"] == heads["_q"]) & placed["source"].eqNullSafe(heads["_s"])).drop("_s", "_q")
    placed = placed.withColumn("_start", F.col("_ahead") + F.col("_run"))
    goal = F.floor(F.col("target")).cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - turns * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return placed.withColumn("_turns", turns).withColumn("taken", (turns * F.col("size") + cut).cast("long"))


def positions(df: DataFrame) -> DataFrame:
    """Adds copies (the cut one included), and the training positions of the first and the last copy."""
    whole = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    df = df.withColumn("copies", F.ceil(whole).cast("long"))
    place = lambda k: position(F.least(F.try_divide((k * F.col("source_size") + F.col("_start")).cast("double"), F.col("target")), F.lit(1.0)), F.col("weight"))
    taken = F.col("taken") > 0
    return df.withColumns({"position": F.when(taken, place(F.lit(0))), "last_position": F.when(taken, place(F.col("copies") - 1))})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = positions(laid_out(docs, Work(spark, "op4"), ["doc_id", "source"]))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "source", "weight", "copies", F.round("position", 9).alias("position"), F.round("last_position", 9).alias("last_position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed corpus, a row per copy in training order: _row (the document, the cut copy's text
    shortened to its taken words, joined by one space), position and copy.

    Positions are worked out without the texts; texts move twice, to their row's plan (by the
    order hash; equal rows pair off by number) and to their place."""
    laid = laid_out(docs.select("doc_id", "source", "text"), Work(spark, "mix"), ["doc_id", "source"])
    plan = numbered(laid).filter("taken > 0").select("_order", "_no", "_start", "taken", "size", "source_size", "target", "weight").withColumnRenamed("_order", "_o").withColumnRenamed("_no", "_m")
    rows = whole_rows(docs).withColumns({"_order": order_hash("_row."), "source": F.col("_row.source")})
    rows = numbered(rows)
    rows = rows.join(plan, (F.col("_order") == F.col("_o")) & (F.col("_no") - F.col("_m") == 0))
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = whole + (part > 0).cast("int")
    rows = rows.withColumn("_whole", whole).withColumn("_cut", part).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    short = F.array_join(F.slice(words_of(F.col("_row.text")), 1, F.col("_cut")), " ")
    text = F.when(F.col("copy") < F.col("_whole"), F.col("_row.text")).otherwise(short)
    rows = rows.withColumn("_row", F.col("_row").withField("text", text))
    frac = F.try_divide((F.col("copy") * F.col("source_size") + F.col("_start")).cast("double"), F.col("target"))
    rows = rows.withColumn("position", position(F.least(frac, F.lit(1.0)), F.col("weight")))
    rows = rows.select("_row", "position", "copy")
    order = ["position", F.col("_row.doc_id"), "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def order_hash(row: str = "") -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(f"{row}doc_id").cast("string"), F.lit("-")), F.col(f"{row}text")))


def numbered(df: DataFrame) -> DataFrame:
    """Numbers rows of equal doc_id and text, by source (those of one source are alike)."""
    return df.withColumn("_no", F.row_number().over(Window.partitionBy("_order").orderBy("source")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the mixed corpus in training order; heavy sources' documents repeat, light ones' may go.
    Columns stay as they are but for text and n_chars, which tell the copy's; null texts go (they have no words)."""
    row = F.col("_row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_row.text").cast("long"))
    return mix(spark, docs).select(row.alias("_row")).select("_row.*")


def _place_sql(frac: str, knots) -> str:
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, start, out = sum(areas), 0.0, ""
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope = (w1 - w0) / (t1 - t0)
        here = f"{t0} + (sqrt({w0 * w0}::DOUBLE + greatest({frac} * {whole}::DOUBLE - {start}::DOUBLE, 0.0) * {2 * slope}::DOUBLE) - {w0}::DOUBLE) / {slope}::DOUBLE"
        out = f"CASE WHEN {frac} * {whole}::DOUBLE < {start}::DOUBLE THEN {out} ELSE {here} END" if out else here
        start += area
    return f"least(1.0, {out})"


ORACLE = f"""WITH
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), text)) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight::DOUBLE AS ratio FROM s),
c AS (SELECT a.ratio, ((SELECT sum(source_size) FROM r) - coalesce(sum(b.lim) FILTER (WHERE b.ratio < a.ratio), 0))::DOUBLE
             / sum(b.weight) FILTER (WHERE b.ratio >= a.ratio) AS level FROM r a, r b GROUP BY a.ratio),
lev AS (SELECT arg_min(level, ratio) AS level FROM c WHERE level <= ratio),
t AS (SELECT r.*, least(lim::DOUBLE, level * weight) AS target FROM r, lev),
p AS (SELECT d.*, source_size, weight, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS st,
             floor(target)::BIGINT AS goal FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS turns FROM p),
x AS (SELECT *, (turns * size + greatest(0, least(size, goal - turns * source_size - st)))::BIGINT AS taken FROM k),
y AS (SELECT *, CAST(ceil(taken / greatest(size, 1)::DOUBLE) AS BIGINT) AS copies FROM x),
f AS (SELECT *, least(1.0, st::DOUBLE / nullif(target, 0)) AS frac, least(1.0, ((copies - 1) * source_size + st)::DOUBLE / nullif(target, 0)) AS lfrac FROM y)
SELECT doc_id, size, source_size, target, taken, source, weight, copies,
       round(CASE WHEN taken > 0 THEN CASE {" ".join(f"WHEN weight = {w} THEN {_place_sql('frac', k)}" for w, k in SCHEDULES.items())} END END, 9) AS position,
       round(CASE WHEN taken > 0 THEN CASE {" ".join(f"WHEN weight = {w} THEN {_place_sql('lfrac', k)}" for w, k in SCHEDULES.items())} END END, 9) AS last_position
FROM f"""
