"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a random key from a hash of its id.  Within a source the rows stand in key order,
dealt over ranges of keys: about the square root of the source's rows, so neither the ranges of a
hot source nor the rows of a range are many.  Word counts are summed by range before any shuffle,
prefix sums over the ranges find the range in which a source's budget ends, and only the rows of
that range are sorted to find the row.  Texts are never shuffled and no row but those of the last
ranges moves.

A source's target is its weight's share of ``share`` of all words, at most ``epochs`` times its
words, with the excess given to the others by weight.  Whole repeats come first; the rest is cut at the
exact word of the last row in key order.

Defined results: a null text has no words and is never taken.  A null source is a source, after
all others.  Null ids take their key from the text.  Repeated rows (same id and size) stand
together; if the budget ends among them each takes an equal part, rounded down.  A source without
words takes nothing.  An empty table gives an empty result.  Existing columns of the same name are
replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, apart, free_name
from graphloom.storage import materialize

WEIGHTS = (3, 1, 2)
OUTPUTS = ("size", "source_size", "target", "taken")
_KEY_BITS = 32


def sizes(docs: DataFrame, text_col: str, id_col: str, seed: str) -> DataFrame:
    """Add size, key and the id as text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"),
            "_key": F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, _KEY_BITS // 4), 16, 10).cast("bigint"),
            "_name": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        }
    )


def ranked(table: DataFrame, order: list[Column]) -> DataFrame:
    """Number the rows from 0 in a global order without bringing them to one task: ranges are
    sorted apart and the few counts by range give the offsets."""
    parts = materialize(table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    offsets, upto = [], 0
    for r in sorted(parts.groupBy("_part").count().collect()):  # a row per partition
        offsets.append((r[0], upto))
        upto += r[1]
    frame = parts.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset bigint")
    return (
        parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
        .join(F.broadcast(frame), "_part")  # a row per partition
        .withColumn("rank", F.col("_offset") + F.col("_row") - 1)
        .drop("_part", "_offset", "_row")
    )


def water_level(sources: DataFrame, total: float, epochs: int) -> float:
    """Words per weight at which the targets, each at most ``epochs`` times its source, sum to
    ``total``.  Each pass caps at least one more source or ends."""
    capped, level = -1, 0.0
    while True:
        full = F.col("source_size") * epochs <= F.col("weight") * level
        got = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, F.col("source_size") * epochs).otherwise(0)).alias("held"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("free"),
        ).first()
        if got.n is None or got.n == capped or not got.free:
            return level
        capped, level = got.n, (total - got.held) / got.free


def plan(sized: DataFrame, source_col: str, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """A row per source: its size and target, whole repeats, and the place of the cut."""
    by_source = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    numbered = ranked(by_source, [F.col("_source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(numbered.withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources.where("source_size > 0"), share * total, epochs)
    target = F.least(F.col("source_size") * F.lit(float(epochs)), F.col("weight") * F.lit(float(level)))
    words = F.floor("target").cast("bigint")
    return materialize(
        sources.withColumn("target", F.round(target, 6)).withColumns(
            {
                "_epochs": F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("bigint")),
                "_rest": F.when(F.col("source_size") > 0, F.pmod(words, F.col("source_size"))).otherwise(F.lit(0).cast("bigint")),
                "_ranges": F.greatest(F.lit(1), F.ceil(F.sqrt("_rows"))).cast("bigint"),
            }
        ),
        "targets",
    )


def cuts(sized: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """Where each source's rest ends: key, name and size of the row, and the words it still takes."""
    dealt = sized.select(F.col(source_col).alias("_s"), "size", "_key", "_name")
    dealt = dealt.join(targets.select("_source", "rank", "_rest", "_ranges"), F.col("_s").eqNullSafe(F.col("_source")))
    dealt = dealt.withColumn("_range", F.shiftright(F.col("_key") * F.col("_ranges"), _KEY_BITS))
    sums = dealt.groupBy("rank", "_rest", "_range").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("_range"))
    last = sums.withColumn("upto", upto).where("upto - n <= _rest and _rest < upto").select("rank", "_range", (F.col("upto") - F.col("n")).alias("_before"))
    same = dealt.join(last, ["rank", "_range"]).groupBy("rank", "_rest", "_before", "_key", "_name", "size").agg(F.count("*").alias("m"))
    run = F.sum(F.col("size") * F.col("m")).over(Window.partitionBy("rank").orderBy("_key", "_name", "size")) + F.col("_before")
    return (
        same.withColumn("upto", run)
        .where("upto - size * m <= _rest and _rest < upto")
        .select(
            F.col("rank").alias("_cut_rank"),
            F.struct("_key", "_name", "size").alias("_cut"),
            F.expr("(_rest - (upto - size * m)) div m").alias("_part"),
        )
    )


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix:",
    keep_text: bool = True,
) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes, repeats counted) to each row."""
    columns = [c for c in docs.columns if c.lower() not in OUTPUTS]
    name = apart(columns)
    text, source, own_id = name[text_col], name[source_col], name[id_col]
    clear = docs.select(*[F.col(f"`{c}`").alias(name[c]) for c in columns])
    narrow = materialize(sizes(clear, text, own_id, seed).drop(text), "sizes")
    targets = plan(narrow, source, weights, share, epochs)
    cut = cuts(narrow, targets, source)
    rows = sizes(clear, text, own_id, seed) if keep_text else narrow
    # a written row per source, so that the optimizer knows its size and need not shuffle the texts
    ends = materialize(targets.join(cut, F.col("rank") == F.col("_cut_rank"), "left").select("_source", "source_size", "target", "_epochs", "_cut", "_part"), "ends")
    out = rows.join(ends, F.col(source).eqNullSafe(F.col("_source")))
    at = F.struct("_key", "_name", "size")
    part = F.when(at < F.col("_cut"), F.col("size")).when(at == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    out = out.withColumn("taken", (F.col("size") * F.col("_epochs") + part).cast("bigint"))
    return out.select(*[F.col(name[c]).alias(c) for c in columns if keep_text or c != text_col], *OUTPUTS)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, wholly or in part."""
    time = free_name(mixed, "_time")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return mixed.withColumn(time, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times >= F.col(time)).drop(time, *OUTPUTS)
