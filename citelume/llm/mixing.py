"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

#: Weights by the source's rank, repeating, and the most epochs of any source.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Hash bins of a source's documents. Only one bin of each source, 1/4096 of its rows, is put in order.
BINS = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of rows with source and size.

    A source is clamped where its share would pass epochs times its size; the rest shares what remains by weight. That is
    solved in one pass: in the order of capacity per weight, the first k sources are clamped for the smallest k that puts
    none of the others above its capacity. The windows see a row for each source, of aggregated sizes.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("room", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("room") * F.col("weight") / F.col("heft") <= F.col("cap"))
    )
    first = Window.orderBy(F.col("fits").desc(), F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = filled.withColumn("room", F.first(F.when(F.col("fits"), F.col("room")), ignorenulls=True).over(first)).withColumn("heft", F.first(F.when(F.col("fits"), F.col("heft")), ignorenulls=True).over(first))
    return level.select("source", "source_size", F.when(F.col("fits"), F.col("weight") * F.col("room") / F.col("heft")).otherwise(F.col("cap")).cast("double").alias("target"))


def n_words() -> F.Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, bins: int = BINS, size: F.Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes a document.

    Each document of a source is taken floor(target / source_size) times; the rest of the target is filled by one more
    copy of the source's first documents in a seeded order (MD5 of seed and doc_id), as far as half of a document fits.
    The order's running sizes come from sums of hash bins, and only the bin in which a source's target ends is sorted, so
    no source is held in one task. The result depends on the rows alone. size: the size if it isn't to be counted from text.

    Nulls: a null text has size 0, a null source is a source (ranked last), a null doc_id is ordered as the empty string.
    Empty texts are taken as often as whole repetitions say. Repeated rows are documents of their own, put in order by
    size. Sources without words have target 0. No rows give no rows. Other columns stay, but for the names given here,
    which are replaced.
    """
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    kept = [F.col(f"_row.`{c}`").alias(c) for c in columns]
    return _taken(docs, columns, seed, weights, epochs, bins, size).select(*kept, "size", "source_size", "target", "copies")


def _taken(docs: DataFrame, columns: list[str], seed: int, weights: tuple[int, ...], epochs: int, bins: int, size: F.Column | None) -> DataFrame:
    """(_row, size, source_size, target, copies): the columns as a struct beside what the mix says of the document."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "source", (n_words() if size is None else size).cast("long").alias("size"))
    sized = sized.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = sized.withColumn("_bin", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * bins / 2**32).cast("int"))
    binned = sized.groupBy("source", "_bin").agg(F.sum("size").alias("size"))
    targets = source_targets(binned, weights, epochs)
    # the null source joins as itself
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    want = targets.withColumn("reps", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    want = want.withColumn("want", F.col("target") - F.col("reps") * F.col("source_size"))
    want = want.select(key.alias("_key"), "source_size", "target", "reps", "want")
    running = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = binned.withColumn("_key", key).join(want.select("_key", "want"), "_key").withColumn("start", F.coalesce(F.sum("size").over(running), F.lit(0)))
    # a bin is taken whole if it ends before the target does; the bins at the target's end are put in order
    ends = ends.filter("start <= want").groupBy("_key").agg(F.max(F.struct("_bin", "start")).alias("end")).select("_key", F.col("end._bin").alias("last_bin"), F.col("end.start").alias("last_start"))
    plan = stored(want.join(ends, "_key", "left"), "mix-plan")
    out = sized.withColumn("_key", key).join(_small(plan), "_key")
    inside = out.filter("_bin = last_bin")
    order = Window.partitionBy("_key").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("last_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.withColumn("more", F.when(F.col("start") + F.col("size") / 2 <= F.col("want"), 1).otherwise(0))
    others = out.filter("_bin <> last_bin or last_bin is null").withColumn("start", F.lit(0).cast("long"))
    others = others.withColumn("more", F.when(F.col("_bin") < F.col("last_bin"), 1).otherwise(0))
    both = reduce(DataFrame.unionByName, (inside, others))
    more = F.when((F.col("more") == 1) & (F.col("want") > 0), 1).otherwise(0)
    return both.select("_row", "size", "source_size", "target", (F.col("reps") + more).cast("long").alias("copies"))


def mixture(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, bins: int = BINS) -> DataFrame:
    """docs as often as the mix takes them, in the columns they came with, whatever their names."""
    return repeated(_taken(docs, docs.columns, seed, weights, epochs, bins, None).select("_row", "copies")).select("_row.*")


def _small(plan: DataFrame, most: int = 100_000) -> DataFrame:
    """The plan of the sources: broadcast where they are few, else joined as any table (hot sources by a skew join)."""
    return F.broadcast(plan) if plan.count() <= most else plan


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")


def query(docs: DataFrame) -> DataFrame:
    sized = stored(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")  # texts are read once
    mixed = mix(sized, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in SQL: one running sum over a source's documents in the seeded order.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, 3 * source_size AS cap FROM s),
-- each k: the sources with the k smallest capacities per weight are clamped
f AS (SELECT a.source, a.source_size, a.weight, a.cap,
             (SELECT sum(source_size) FROM r) - coalesce((SELECT sum(b.cap) FROM r b WHERE (CAST(b.cap AS DOUBLE) / b.weight, b.source IS NULL, coalesce(b.source, '')) < (CAST(a.cap AS DOUBLE) / a.weight, a.source IS NULL, coalesce(a.source, ''))), 0) AS room,
             (SELECT sum(weight) FROM r) - coalesce((SELECT sum(b.weight) FROM r b WHERE (CAST(b.cap AS DOUBLE) / b.weight, b.source IS NULL, coalesce(b.source, '')) < (CAST(a.cap AS DOUBLE) / a.weight, a.source IS NULL, coalesce(a.source, ''))), 0) AS heft FROM r a),
l AS (SELECT room, heft FROM f WHERE CAST(room * weight AS DOUBLE) / heft <= cap ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN CAST(f.room * f.weight AS DOUBLE) / f.heft <= f.cap THEN CAST(f.weight * l.room AS DOUBLE) / CAST(l.heft AS DOUBLE) ELSE CAST(f.cap AS DOUBLE) END AS target FROM f LEFT JOIN l ON true),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS reps FROM t),
o AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.reps, w.target - w.reps * w.source_size AS want,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (reps + CASE WHEN want > 0 AND start + size / 2.0 <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
