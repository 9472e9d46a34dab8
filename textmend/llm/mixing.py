"""Mixing sources to target weights by capped water-filling.

Sources are ranked by code point (null last) and given the weights of a repeating
cycle.  Each gets that share of all words, but no more than ``max_epochs`` times its
own size; what a clamped source leaves over is shared again by weight until no
target is above its cap.  That fixed point has a closed form: with sources in order
of cap/weight, one running sum finds the water level.

A document is then taken ``floor(target / source_size)`` whole times, and once more if
it falls in the seeded fraction: documents of a source are ordered by
``md5(seed:doc_id)``, and those whose midpoint lies below the remaining words are
taken.  The running sum that needs is not taken over a whole source: sizes are first
summed per hash bin, and only the one bin that holds the boundary is ordered.

Edge cases: a null text has size 0 and is taken 0 times its size; a null source is a
source of its own, the last; a source without words gets target 0 and no repetition;
equal rows get equal hashes and are ordered by id and size; an empty table gives an
empty result.  Extra columns of the input are ignored by ``mix`` and kept by
``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, prefix, stage, table

WEIGHTS, MAX_EPOCHS, SEED, BIN_DIGITS = (1, 2, 3), 3, "mix-1", 3
#: Per-source tables up to this many rows are broadcast, larger ones are joined by shuffle.
MAX_SOURCES = 20_000


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, remain) from rows (source, size).

    One row per source: the windows below run over that small table only.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = src.withColumn("rk", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(cycle, ((F.col("rk") - 1) % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", "rk", w.alias("w"), (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    )
    # The level holds from the first source on that does not reach its cap under it.
    filled = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    # min_by over the open sources alone; all are clamped only where there are no words.
    water = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("rk")))).over(every)
    t = F.least(F.col("cap").cast("double"), F.coalesce(water * F.col("w"), F.col("cap").cast("double")))
    out = filled.withColumn("target", t)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("remain"))


#: Documents of boundary bins up to this many are broadcast, more are joined by shuffle.
MAX_EDGE = 500_000


def _order_hash(id_col: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _plan(docs: DataFrame, id_col, text_col, source_col, weights, max_epochs, seed, bin_digits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, source, size, h; sources: src, target and boundary bin; documents of boundary bins with extra)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # The text is read once: what follows works on a few bytes per document.
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _order_hash(id_col, seed).alias("h"), F.xxhash64(text_col).alias("th")), "mix")
    per = stage(targets(sized, weights, max_epochs), "targets")
    bins = sized.groupBy("source", F.substring("h", 1, bin_digits).alias("bin")).agg(F.sum("size").alias("in_bin"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("cum", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    edge = (
        bins.withColumnRenamed("source", "s")
        .join(bounded_broadcast(per, MAX_SOURCES).select(F.col("source").alias("s2"), "remain"), F.col("s").eqNullSafe(F.col("s2")))
        .filter((F.col("cum") < F.col("remain")) & (F.col("cum") + F.col("in_bin") >= F.col("remain")))
        .select("s", F.col("bin").alias("edge_bin"), F.col("cum").alias("edge_cum"))
    )
    plan = stage(per.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "src"), "plan")
    run = Window.partitionBy("source").orderBy("h", "id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(bounded_broadcast(plan, MAX_SOURCES), F.col("source").eqNullSafe(F.col("src")))
    inside = rows.filter(F.substring("h", 1, bin_digits) == F.col("edge_bin")).withColumn("c", F.col("edge_cum") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    inside = inside.withColumn("extra", (2 * F.col("c") + F.col("size") <= 2 * F.col("remain")).cast("long"))
    return sized, plan, inside


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED, bin_digits=BIN_DIGITS) -> DataFrame:
    """Per document: id, source, size, source_size, target, repeats, taken (= repeats * size)."""
    sized, plan, inside = _plan(docs, id_col, text_col, source_col, weights, max_epochs, seed, bin_digits)
    rows = sized.join(bounded_broadcast(plan, MAX_SOURCES), F.col("source").eqNullSafe(F.col("src")))
    bin_ = F.substring("h", 1, bin_digits)
    outside = rows.filter(~F.coalesce(bin_ == F.col("edge_bin"), F.lit(False)))
    outside = outside.withColumn("extra", F.coalesce(bin_ < F.col("edge_bin"), F.lit(False)).cast("long"))
    n = F.col("whole") + F.col("extra")
    return inside.drop("c").unionByName(outside).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", n.alias("repeats"), (n * F.col("size")).alias("taken"))


def op8_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED, bin_digits=BIN_DIGITS, wordless: bool = True) -> DataFrame:
    """The mixed documents themselves: each as many rows as it is repeated.

    A document that is taken 0 times goes.  A text without words carries no weight in a
    mix: it stays once (``wordless`` False: it goes).  A decision is a row's own by source,
    id and text: equal or null ids do not share one, rows equal in all three do.  Texts
    are not shuffled: each row finds its source's plan, and only those of a boundary bin are looked up.
    """
    _, plan, inside = _plan(docs, id_col, text_col, source_col, weights, max_epochs, seed, bin_digits)
    own = prefix(docs.columns, "_mix")
    n = {k: f"{own}_{k}" for k in ("src", "whole", "edge", "h", "th", "es", "eh", "et", "extra", "n", "r")}
    edge = inside.filter("size > 0").groupBy(F.col("source").alias(n["es"]), F.col("h").alias(n["eh"]), F.col("th").alias(n["et"])).agg(F.max("extra").alias(n["extra"]))
    edge = stage(edge, "edge")
    plan = plan.select(F.col("src").alias(n["src"]), F.col("whole").alias(n["whole"]), F.col("edge_bin").alias(n["edge"]))
    has = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = docs.filter(has).withColumn(n["h"], _order_hash(id_col, seed)).withColumn(n["th"], F.xxhash64(text_col))
    rows = rows.join(bounded_broadcast(plan, MAX_SOURCES), F.col(source_col).eqNullSafe(F.col(n["src"])))
    same = (F.col(n["h"]) == F.col(n["eh"])) & (F.col(n["th"]) == F.col(n["et"])) & F.col(source_col).eqNullSafe(F.col(n["es"]))
    rows = rows.join(bounded_broadcast(edge, MAX_EDGE), same, "left")
    extra = F.coalesce(n["extra"], (F.substring(n["h"], 1, bin_digits) < F.col(n["edge"])).cast("long"), F.lit(0))
    times = (F.col(n["whole"]) + extra).cast("int")
    out = rows.withColumn(n["n"], times).filter(F.col(n["n"]) > 0).withColumn(n["r"], F.explode(F.sequence(F.lit(1), F.col(n["n"])))).select(*docs.columns)
    return out.unionByName(docs.filter(~has)) if wordless else out


SQL = rf"""
WITH sized AS (SELECT doc_id AS id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src),
caps AS (SELECT source, source_size, rk, (((rk - 1) % 3) + 1)::DOUBLE AS w, {MAX_EPOCHS} * source_size AS cap FROM ranked),
lev AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM caps
    WINDOW o AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (cap / w, rk)) AS water FROM lev WHERE level * w < cap),
tg AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(water * w, cap::DOUBLE)) AS target FROM lev, water),
per AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tg),
run AS (SELECT s.id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS remain,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.id, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
    FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source)
SELECT id AS doc_id, size, source_size, target,
    ((whole + CASE WHEN 2 * c + size <= 2 * remain THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM run
"""
