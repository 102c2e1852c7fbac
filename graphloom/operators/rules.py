"""Completion rules, contradictions and constraints, as joins with rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import EDGE_COLUMNS
from graphloom.storage import materialize_parts, plan_slices

KEY = ["src", "rel", "dst"]

# Relations and the relations that oppose them.
OPPOSING = {
    "ACTIVATES": ["INHIBITS", "SUPPRESSES", "BLOCKS", "DOWNREGULATES"],
    "INHIBITS": ["ACTIVATES", "PROMOTES", "STIMULATES", "UPREGULATES"],
    "CAUSES": ["PREVENTS", "TREATS", "CURES"],
    "PREVENTS": ["CAUSES", "INDUCES", "PROMOTES"],
    "TREATS": ["WORSENS", "EXACERBATES", "CAUSES"],
    "WORSENS": ["TREATS", "IMPROVES", "CURES"],
    "IMPROVES": ["WORSENS", "EXACERBATES"],
    "UPREGULATES": ["DOWNREGULATES"],
    "DOWNREGULATES": ["UPREGULATES"],
    "INCREASES": ["DECREASES", "REDUCES"],
    "DECREASES": ["INCREASES", "AMPLIFIES"],
    "AMPLIFIES": ["DECREASES", "REDUCES"],
    "PROMOTES": ["INHIBITS", "SUPPRESSES", "PREVENTS"],
    "SUPPRESSES": ["ACTIVATES", "PROMOTES", "STIMULATES"],
    "STIMULATES": ["INHIBITS", "SUPPRESSES", "BLOCKS"],
    "BLOCKS": ["ACTIVATES", "STIMULATES"],
    "INDUCES": ["PREVENTS"],
    "CURES": ["CAUSES", "WORSENS"],
    "SUPPORTS": ["REFUTES", "CONTRADICTS", "DISPROVES"],
    "REFUTES": ["SUPPORTS", "CONFIRMS", "PROVES"],
    "CONFIRMS": ["REFUTES", "DISPROVES"],
    "PROVES": ["DISPROVES"],
    "DISPROVES": ["PROVES", "CONFIRMS"],
    "CONTRADICTS": ["SUPPORTS"],
    "IS_A": ["IS_NOT_A"],
    "IS_NOT_A": ["IS_A"],
    "PRECEDES": ["FOLLOWS"],
    "FOLLOWS": ["PRECEDES"],
    "BEFORE": ["AFTER"],
    "AFTER": ["BEFORE"],
}

# First relation, second relation, composed relation, confidence factor.
COMPOSITIONS = """
CAUSES CAUSES INDIRECTLY_CAUSES 0.80
CAUSES TREATS MAY_TREAT 0.55
CAUSES PREVENTS MAY_PREVENT 0.55
PREVENTS CAUSES INDIRECTLY_REDUCES_RISK 0.60
ACTIVATES CAUSES INDIRECTLY_CAUSES 0.70
ACTIVATES PREVENTS INDIRECTLY_PREVENTS 0.65
INHIBITS CAUSES MAY_PREVENT 0.65
INHIBITS PREVENTS INDIRECTLY_CAUSES 0.55
INHIBITS PROMOTES INDIRECTLY_REDUCES 0.70
PROMOTES INHIBITS INDIRECTLY_REDUCES 0.70
ACTIVATES ACTIVATES INDIRECTLY_ACTIVATES 0.70
INHIBITS INHIBITS INDIRECTLY_ACTIVATES 0.60
PROMOTES PROMOTES INDIRECTLY_PROMOTES 0.70
UPREGULATES UPREGULATES INDIRECTLY_UPREGULATES 0.70
DOWNREGULATES DOWNREGULATES INDIRECTLY_DOWNREGULATES 0.70
UPREGULATES DOWNREGULATES INDIRECTLY_DOWNREGULATES 0.60
DOWNREGULATES UPREGULATES INDIRECTLY_DOWNREGULATES 0.60
ENCODES BINDS GENE_PRODUCT_BINDS 0.80
ENCODES INHIBITS GENE_INHIBITS 0.80
ENCODES ACTIVATES GENE_ACTIVATES 0.80
ENCODES PROMOTES GENE_PROMOTES 0.80
BINDS INHIBITS BLOCKS_VIA_BINDING 0.75
TREATS CAUSES MAY_CAUSE_SIDE_EFFECT 0.45
EXPRESSED_IN CAUSES TISSUE_IMPLICATED_IN 0.65
INTERACTS_WITH CAUSES IMPLICATED_IN 0.60
INTERACTS_WITH INHIBITS INDIRECT_INHIBITION 0.60
INFLUENCED INFLUENCED INDIRECTLY_INFLUENCED 0.80
INFLUENCED INVENTED INSPIRED_INVENTION_OF 0.70
INFLUENCED DISCOVERED INSPIRED_DISCOVERY_OF 0.70
INFLUENCED PROVED INSPIRED_PROOF_OF 0.70
STUDENT_OF STUDENT_OF ACADEMIC_DESCENDANT_OF 0.90
STUDENT_OF INVENTED TRAINED_IN_TRADITION_OF 0.70
STUDENT_OF DISCOVERED TRAINED_IN_TRADITION_OF 0.70
STUDENT_OF INFLUENCED INDIRECTLY_INFLUENCED_BY 0.75
MENTORED MENTORED ACADEMIC_GRANDCHILD_OF 0.90
MENTORED INVENTED MENTORSHIP_LED_TO 0.70
AUTHORED CITED WORK_CITED_BY 0.85
CITED INFLUENCED ACADEMIC_INFLUENCE_VIA 0.70
STUDIED DISCOVERED CONTRIBUTED_TO 0.70
WROTE INFLUENCED INTELLECTUAL_INFLUENCE_ON 0.75
INVENTED INFLUENCED INVENTION_INFLUENCED 0.75
KNOWS KNOWS CONNECTED_VIA 0.55
WORKED_WITH FOUNDED INVOLVED_IN_FOUNDING 0.70
WORKED_WITH INVENTED CONTRIBUTED_TO 0.70
WORKED_WITH DISCOVERED CONTRIBUTED_TO 0.70
EMPLOYED_BY FOUNDED ASSOCIATED_WITH_FOUNDING 0.65
MEMBER_OF FOUNDED LINKED_TO_FOUNDING 0.65
COLLABORATED_WITH INVENTED CONTRIBUTED_TO 0.70
COLLABORATED_WITH DISCOVERED CONTRIBUTED_TO 0.70
COLLABORATED_WITH COLLABORATED_WITH NETWORK_PEER 0.60
OPPOSED SUPPORTED INDIRECT_CONFLICT 0.60
PART_OF PART_OF PART_OF 0.90
LOCATED_IN LOCATED_IN LOCATED_IN 0.90
PART_OF LOCATED_IN LOCATED_IN 0.85
MEMBER_OF MEMBER_OF TRANSITIVELY_MEMBER_OF 0.80
PRECEDES PRECEDES LONG_BEFORE 0.90
FOLLOWS FOLLOWS LONG_AFTER 0.90
PRECEDES CAUSED HISTORICALLY_LED_TO 0.70
STARRED_IN DIRECTED WORKED_UNDER 0.80
STARRED_IN HAS_GENRE KNOWN_FOR_GENRE 0.70
DIRECTED HAS_GENRE KNOWN_FOR_GENRE 0.80
DIRECTED STARRED_IN REGULAR_COLLABORATOR 0.75
PRODUCED_BY DIRECTED PRODUCER_DIRECTOR_PAIR 0.75
PRODUCED_BY STARRED_IN PRODUCER_ACTOR_PAIR 0.70
"""


def opposing_table(spark: SparkSession, pairs: dict[str, list[str]] = OPPOSING) -> DataFrame:
    """Opposing relations in both directions, upper case: a, b."""
    rows = {(a, b) for a, others in pairs.items() for b in others}
    return spark.createDataFrame(sorted(rows | {(b, a) for a, b in rows}), "a string, b string")


def composition_table(spark: SparkSession, rules: str = COMPOSITIONS) -> DataFrame:
    """Composition rules: r1, r2, rc, factor, priority (order of text)."""
    rows = [(*line.split()[:3], float(line.split()[3]), i) for i, line in enumerate(rules.strip().splitlines())]
    return spark.createDataFrame(rows, "r1 string, r2 string, rc string, factor double, priority int")


def contradict(a: Column, b: Column, pairs: dict[str, list[str]] = OPPOSING) -> Column:
    """Whether two relations oppose each other, without regard to case or order."""
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    holds = lambda x, y: F.coalesce(F.array_contains(F.try_element_at(table, F.upper(x)), F.upper(y)), F.lit(False))
    return holds(a, b) | holds(b, a)


def inverse_rule(edges: DataFrame, rel: str, inverse: str, confidence: float = 1.0) -> DataFrame:
    """Reverse edges of a relation that are not there yet."""
    new = edges.where(F.col("rel") == rel).select(F.col("dst").alias("src"), F.lit(inverse).alias("rel"), F.col("src").alias("dst"), (F.col("confidence") * confidence).alias("confidence"))
    return new.groupBy(*KEY).agg(F.max("confidence").alias("confidence")).join(edges, KEY, "left_anti")


def _two_steps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = edges.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    left = one.select(F.col("src").alias("a"), F.col("rel").alias("r1"), F.col("dst").alias("mid"), F.col("confidence").alias("ca"))
    right = one.select(F.col("src").alias("mid"), F.col("rel").alias("r2"), F.col("dst").alias("c"), F.col("confidence").alias("cb"))
    return left, right


def composition_rule(edges: DataFrame, r1: str, r2: str, rc: str, min_support: int = 1) -> DataFrame:
    """Compose two relations: support (distinct mid nodes), confidence of the best mid node (lesser
    of both edges'); pairs that are linked so already are left out."""
    left, right = _two_steps(edges.where(F.col("rel").isin(r1, r2)))
    joined = left.where(F.col("r1") == r1).join(right.where(F.col("r2") == r2), "mid").where("a <> c")
    # both sides are distinct, so each mid node joins a pair once
    best = joined.groupBy("a", "c").agg(F.count("*").alias("support"), F.min(F.struct((-F.least("ca", "cb")).alias("k"), "mid")).alias("b"))
    new = best.where(F.col("support") >= min_support).select(F.col("a").alias("src"), F.lit(rc).alias("rel"), F.col("c").alias("dst"), (-F.col("b.k")).alias("confidence"), "support", F.col("b.mid").alias("mid"))
    return new.join(edges, KEY, "left_anti")


def generalised_composition(edges: DataFrame, min_support: int, most: int | None = None) -> DataFrame:
    """Compose every pair of relations that enough paths join; the new relation names both."""
    left, right = _two_steps(edges)
    joined = left.join(right, "mid").where("a <> c")
    pairs = joined.groupBy("r1", "r2").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    new = joined.join(pairs, ["r1", "r2"]).groupBy(F.col("a").alias("src"), F.concat_ws("__", "r1", "r2").alias("rel"), F.col("c").alias("dst")).agg(F.max(F.least("ca", "cb")).alias("confidence"))
    new = new.join(edges, KEY, "left_anti")
    return new.orderBy(F.desc("confidence"), *KEY).limit(most) if most else new


def transitive_inference(edges: DataFrame, rules: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges that the rule table derives over two steps: the best confidence (product of both edges'
    and the factor) of each new edge, ties to the rule's priority and the lesser mid node."""
    left, right = _two_steps(edges)
    joined = left.join(F.broadcast(rules), "r1").join(right, ["mid", "r2"]).where("a <> c")  # a rule table of a few dozen rows
    confidence = F.round(F.col("ca") * F.col("cb") * F.col("factor"), 9)
    best = joined.withColumn("confidence", confidence).groupBy(F.col("a").alias("src"), F.col("rc").alias("rel"), F.col("c").alias("dst")).agg(F.min(F.struct((-F.col("confidence")).alias("k"), "priority", "mid")).alias("b"))
    new = best.select(*KEY, (-F.col("b.k")).alias("confidence"), F.col("b.mid").alias("mid"))
    return new.where(F.col("confidence") >= min_confidence).join(edges, KEY, "left_anti")


def rollback(edges: DataFrame, run: DataFrame) -> DataFrame:
    """Take back the edges that a run added."""
    return edges.join(run, KEY, "left_anti")


def holdout_validation(edges: DataFrame, rules: DataFrame, percent: int = 20) -> DataFrame:
    """Hide a share of edges (by hash), infer, and compare per relation: precision, recall, f1.

    Hidden edges count when the same pair is inferred with the same relation."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *KEY)), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    marked = edges.withColumn("_b", bucket)
    hidden = marked.where(F.col("_b") < percent).select(*KEY).distinct()
    shown = marked.where(F.col("_b") >= percent).drop("_b")
    n = plan_slices(edges)

    def counts(i: int) -> DataFrame:
        """Of the sources of a slice; no row per inferred edge outlives it."""
        mine = lambda df: df.where(F.pmod(F.xxhash64("src"), F.lit(n)) == i) if n > 1 else df
        found = mine(transitive_inference(shown, rules)).select(*KEY, F.lit(1).alias("f"), F.lit(0).alias("h"))
        both = found.unionByName(mine(hidden).select(*KEY, F.lit(0).alias("f"), F.lit(1).alias("h"))).groupBy(*KEY).agg(F.max("f").alias("f"), F.max("h").alias("h"))
        return both.groupBy("rel").agg(F.sum("f").alias("inferred"), F.sum("h").alias("hidden"), F.sum(F.col("f") * F.col("h")).alias("hits"))

    out = materialize_parts(map(counts, range(n)), edges.sparkSession, "holdout").groupBy("rel").agg(*[F.sum(c).alias(c) for c in ("inferred", "hidden", "hits")])
    precision, recall = F.try_divide("hits", "inferred"), F.try_divide("hits", "hidden")
    return out.select("rel", "inferred", "hidden", "hits", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def direct_contradictions(edges: DataFrame, opposing: DataFrame) -> DataFrame:
    """Opposing relations between the same two nodes, in the same or the opposite direction."""
    one = edges.groupBy(*KEY).agg(F.max("confidence").alias("confidence")).withColumn("up", F.upper("rel"))
    left = one.select("src", "dst", F.col("rel").alias("r1"), F.col("up").alias("a"), F.col("confidence").alias("c1")).join(opposing, "a")
    same = one.select("src", "dst", F.col("rel").alias("r2"), F.col("up").alias("b"), F.col("confidence").alias("c2"))
    swapped = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rel").alias("r2"), F.col("up").alias("b"), F.col("confidence").alias("c2"))
    parallel = left.join(same, ["src", "dst", "b"]).where("a < b").withColumn("kind", F.lit("parallel"))
    opposite = left.join(swapped, ["src", "dst", "b"]).where("src < dst").withColumn("kind", F.lit("opposite"))
    return parallel.unionByName(opposite).select("src", "dst", "r1", "r2", "kind", F.least("c1", "c2").alias("severity"))


def temporal_contradictions(edges: DataFrame, opposing: DataFrame) -> DataFrame:
    """Opposing relations of one source to the same target whose validity does not overlap: the view
    changed.  Per (source, target, relation) the whole span of validity is compared."""
    span = edges.where("valid_from is not null").groupBy(*KEY).agg(F.min("valid_from").alias("f"), F.max(F.coalesce("valid_to", "valid_from")).alias("t")).withColumn("up", F.upper("rel"))
    left = span.select("src", "dst", F.col("rel").alias("r1"), F.col("up").alias("a"), F.col("t").alias("t1")).join(opposing, "a")
    right = span.select("src", "dst", F.col("rel").alias("r2"), F.col("up").alias("b"), F.col("f").alias("f2"))
    return left.join(right, ["src", "dst", "b"]).where("t1 < f2").select("src", "dst", "r1", "r2", (F.col("f2") - F.col("t1")).alias("gap"))


def provenance_contradictions(edges: DataFrame, spread: float = 0.1) -> DataFrame:
    """Edges that several sources give with confidences further apart than ``spread``."""
    g = edges.groupBy(*KEY).agg(F.countDistinct("provenance").alias("sources"), (F.max("confidence") - F.min("confidence")).alias("spread"))
    return g.where((F.col("sources") >= 2) & (F.col("spread") > spread))


def materialise_contradictions(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Add a ``CONTRADICTS`` edge per contradiction."""
    new = records.select("src", F.lit("CONTRADICTS").alias("rel"), "dst", F.lit(1.0).alias("weight"), F.col("severity").alias("confidence"), F.lit("contradiction").alias("provenance"), F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to")).distinct()
    return edges.select(*EDGE_COLUMNS).unionByName(new)


def cross_path_contradictions(a: DataFrame, b: DataFrame, opposing: DataFrame) -> DataFrame:
    """Paths (path, tail) of two sets that end in one node and hold opposing relations."""
    rels = lambda df, r: df.select("tail", F.explode(F.array_distinct(F.filter("path", lambda _, i: i % 2 == 1))).alias(r)).distinct()
    return rels(a, "a").join(opposing, "a").join(rels(b, "b"), ["tail", "b"]).select("tail", "a", "b")


def path_contradicts(path: Column, pairs: dict[str, list[str]] = OPPOSING) -> Column:
    """Whether a path holds two opposing relations."""
    rels = F.filter(path, lambda _, i: i % 2 == 1)
    return F.exists(rels, lambda x: F.exists(rels, lambda y: contradict(x, y, pairs)))


def noisy_or(values: Column) -> Column:
    return F.lit(1.0) - F.aggregate(values, F.lit(1.0), lambda s, x: s * (1 - x))


def resolution(confidences: Column, contradictions: Column, clean: float = 0.3, revise: float = 0.2, discard: float = -0.2) -> Column:
    """What to do with a finding, from the evidence for it less the strongest contradiction."""
    worst = F.coalesce(F.array_max(contradictions), F.lit(0.0))
    net = noisy_or(confidences) - worst
    return F.when((F.size(confidences) == 0) | (worst < clean), "clean").when(net > revise, "revision_candidate").when(net < discard, "discardable").otherwise("contested")


def violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps whose relation is restricted to other types: ``allowed`` has rel, src_type, dst_type."""
    kind = lambda c: F.split(c, ":")[0]
    restricted = edges.join(allowed.select("rel").distinct(), "rel", "left_semi").withColumns({"src_type": kind("src"), "dst_type": kind("dst")})
    return restricted.join(allowed, ["rel", "src_type", "dst_type"], "left_anti")


def repair_dead_ends(ends: DataFrame, vectors: DataFrame, edges: DataFrame, top_k: int = 3) -> DataFrame:
    """Candidates for dead ends (id): nodes of the same community by cosine, not linked yet."""
    from graphloom.functions.vectors import cosine

    stuck = ends.join(vectors, "id").select("id", "community", F.col("v").alias("ev"))
    pairs = stuck.join(vectors.select(F.col("id").alias("other"), "community", "v"), "community").where("id <> other")
    linked = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    scored = pairs.join(linked, ["id", "other"], "left_anti").select("id", "other", F.round(cosine(F.col("ev"), F.col("v")), 9).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
