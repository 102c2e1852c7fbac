"""Adaptive state, patterns, telemetry and goals: small scalars on the driver, tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Modulators:
    """Five levels around a baseline that scale weights and widths."""

    drive: float = 0.5
    calm: float = 0.5
    focus: float = 0.5
    novelty: float = 0.5
    stress: float = 0.5
    baseline: float = 0.5
    rate: float = 0.1

    def step(self) -> Modulators:
        move = lambda x: x + self.rate * (self.baseline - x)
        return replace(self, drive=move(self.drive), calm=move(self.calm), focus=move(self.focus), novelty=move(self.novelty), stress=move(self.stress))

    def weights(self, base: dict[str, float]) -> dict[str, float]:
        out = dict(base)
        out["sim"] = base["sim"] * (0.5 + self.focus)
        out["cs"] = base["cs"] * (0.5 + self.calm)
        out["etw"] = base["etw"] * (0.5 + self.drive)
        return out

    def width(self, base: int) -> int:
        return max(1, round(base * (0.5 + self.novelty)))

    def learning_rate(self, base: float) -> float:
        return base * (0.5 + self.drive) * (1.5 - self.stress)


def prediction_error(rels: Column, patterns: list[str]) -> Column:
    """0 if the relations (joined by ``>``) are a known pattern, 0.5 if only the first one is, else 1."""
    first = sorted({p.split(">")[0] for p in patterns})
    joined = F.concat_ws(">", rels)
    return F.when(joined.isin(*patterns), 0.0).when(rels[0].isin(*first), 0.5).otherwise(1.0)


def top_pattern(sequences: DataFrame, k: int = 1) -> DataFrame:
    """The sequences (rels, success) with the greatest summed success."""
    return sequences.groupBy("rels").agg(F.sum("success").alias("weight"), F.count("*").alias("n")).orderBy(F.desc("weight"), "rels").limit(k)


def promote(patterns: DataFrame, least_rate: float, least: int = 1) -> DataFrame:
    """Patterns (rels, weight, n) that succeed often enough."""
    return patterns.where((F.col("n") >= least) & (F.col("weight") / F.col("n") >= least_rate))


def transfer(patterns: DataFrame, codes: DataFrame, decay: float, most: int) -> DataFrame:
    """Patterns of another graph in this one's relation codes (value, code), weakened.  Patterns with
    a relation that this graph lacks stay behind."""
    steps = patterns.select("rels", "weight", F.posexplode(F.split("rels", ">")).alias("pos", "value"))
    coded = steps.join(codes.select("value", "code"), "value").groupBy("rels", "weight").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    whole = coded.where(F.size("c") == F.size(F.split("rels", ">")))
    return whole.select("rels", F.concat_ws("-", F.transform("c", lambda x: x.code.cast("string"))).alias("code"), (F.col("weight") * decay).alias("weight")).orderBy(F.desc("weight"), "rels").limit(most)


def one_shot(affinity: Column, score: Column, high: float = 0.8, low: float = 0.1, bonus: float = 5.0) -> Column:
    return F.when((score >= high) & (F.coalesce(affinity, F.lit(0.0)) <= low), F.lit(bonus)).otherwise(F.lit(1.0))


def with_prefix(patterns: DataFrame, prefix: str) -> DataFrame:
    return patterns.where((F.col("rels") == prefix) | F.startswith("rels", F.lit(prefix + ">")))


def usage(log: DataFrame) -> DataFrame:
    """Calls and latency per key (key_id, elapsed_ms)."""
    return log.groupBy("key_id").agg(F.count("*").alias("calls"), F.avg("elapsed_ms").alias("mean_ms"), F.max("elapsed_ms").alias("max_ms"))


def log_entries(log: DataFrame, level: str | None = None, since=None, search: str | None = None, limit: int = 100) -> DataFrame:
    """The latest entries (ts, id, level, message) that match."""
    out = log
    if level:
        out = out.where(F.col("level") == level)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if search:
        out = out.where(F.contains(F.lower("message"), F.lit(search.lower())))
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def top_signals(signals: DataFrame, limit: int) -> DataFrame:
    return signals.orderBy(F.desc("strength"), "id").limit(limit)


def temporal_grid(examples: DataFrame, etas: list[float], iotas: list[float], k: int) -> DataFrame:
    """Recall at k of each (eta, iota) over examples (query_id, id, score, decay, recency, correct).

    The grid is a handful of literal pairs."""
    grid = F.explode(F.array(*[F.struct(F.lit(e).alias("eta"), F.lit(i).alias("iota")) for e in etas for i in iotas]))
    scored = examples.withColumn("g", grid).withColumn("s", F.round(F.col("score") + F.col("g.eta") * F.col("decay") + F.col("g.iota") * F.col("recency"), 9))
    order = Window.partitionBy("g", "query_id").orderBy(F.desc("s"), "id")
    hit = scored.withColumn("rank", F.row_number().over(order)).groupBy("g", "query_id").agg(F.max(((F.col("rank") <= k) & F.col("correct")).cast("int")).alias("hit"))
    return hit.groupBy("g").agg(F.avg(F.col("hit").cast("double")).alias("recall")).select("g.eta", "g.iota", "recall")


def learn_weights(pairs: DataFrame, features: int, rounds: int = 10, rate: float = 0.1, margin: float = 0.1) -> list[float]:
    """Pairwise ranking weights: of (good, bad) feature arrays, each round sums the hinge gradient in
    Spark and moves the weights on the driver."""
    w = [0.1] * features
    for _ in range(rounds):
        diff = F.zip_with("good", "bad", lambda a, b: a - b)
        gap = F.aggregate(F.zip_with(diff, F.array(*map(F.lit, w)), lambda d, x: d * x), F.lit(0.0), lambda s, x: s + x)
        lost = pairs.select(diff.alias("d"), gap.alias("g")).where(F.col("g") < margin)
        sums = lost.agg(*[F.avg(F.col("d")[i]).alias(f"g{i}") for i in range(features)]).first()
        if sums[0] is None:
            break
        w = [max(0.0, x + rate * sums[i]) for i, x in enumerate(w)]
    return w
