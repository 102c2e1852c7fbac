"""What keeps the queries small on large tables: shuffle files, slices, blocks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import access as A
from graphloom.operators import answers as N
from graphloom.operators import discovery as J
from graphloom.operators import nearest
from graphloom.operators import traversal as T

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


def paths(spark):
    from graphloom.plans.traversal_queries import _beam

    return _beam(spark, SF, 2)


def test_written_tables_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    got = storage.materialize(df, "counts")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert got.agg(F.sum("n").alias("n")).collect()[0].n == 1000


def test_slices_hold_all_rows(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), "id")
    step = lambda part: part.groupBy("k").agg(F.sum("id").alias("s"))
    assert sorted_rows(storage.materialize_slices(df, "k", 7, "sums", step)) == sorted_rows(step(df))
    assert storage.slices(0) == 1 and storage.slices(2 * storage.SLICE_ROWS) == 3


def test_beam_in_slices_is_the_same(spark, monkeypatch):
    from graphloom.plans.traversal_queries import _answers, _beam

    columns = ("score", "consensus", "branches", "paths", "path")
    one, whole = sorted_rows(_answers(spark, SF, *columns)), sorted_rows(_beam(spark, SF))
    monkeypatch.setattr(storage, "SLICE_ROWS", 3000)
    assert sorted_rows(_beam(spark, SF)) == whole
    assert sorted_rows(_answers(spark, SF, *columns)) == one


def test_answers_take_one_shuffle(spark):
    got = N.extract(paths(spark), 5, branch_bonus=0.25).select("query_id", "rank", "entity", "score")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "concat_ws" not in plan  # no text of paths where only scores are asked for


def vectors(spark, n=400, d=6, seed=1):
    """Vectors with many equal ones, opposite ones and zeros."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-1, 2, (n, d)).astype("float32") * rng.choice([1.0, 3.0], (n, 1)).astype("float32")
    return spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(n)], "id bigint, cid int, v array<float>").repartition(3)


def plain(monkeypatch, run):
    """The result by the plain expression, pair by pair."""
    with monkeypatch.context() as m:
        m.setattr(nearest, "regular", lambda *_: False)
        return sorted_rows(run())


@pytest.mark.parametrize("part", [1 << 25, 1 << 10])
def test_blocks_find_what_pairs_find(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART_BYTES", part)
    v = vectors(spark)
    links = v.select(F.col("id").alias("src"), ((F.col("id") * 7) % 400).alias("dst"))
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "cu int, cv int")
    columns = ["cu", "cv", "a", "b", "score", "potential", "rank"]
    runs = [
        lambda: A.vector_search(v, v.where("id % 20 = 0"), 10, "id", "v").select("query_id", "id", "score", "rank"),
        lambda: J.unlinked_similar(v, v.where("id % 20 = 0").select("id"), links, 0.2, 0.95).select("a", "b", "score", "rank"),
        lambda: J.boundary_scan(v, pairs, 0.0).select(columns),
        lambda: A.similarities(v.withColumnRenamed("cid", "group"), "id % 20 = 0"),
    ]
    for run in runs:
        assert sorted_rows(run()) == plain(monkeypatch, run)


def test_no_join_of_all_pairs(spark, monkeypatch):
    """The pairs are matrix products: no row per pair passes through a join."""
    monkeypatch.setattr(A, "cosine", None)
    monkeypatch.setattr(J, "cosine", None)
    v = vectors(spark)
    assert A.vector_search(v, v.where("id % 20 = 0"), 3, "id", "v").count() == 60
    assert J.boundary_scan(v, spark.createDataFrame([(0, 1)], "cu int, cv int"), 0.0).count() == 3
    assert A.similarities(v.withColumnRenamed("cid", "group"), "id % 20 = 0").count() == 20 * 399
    assert J.unlinked_similar(v, v.where("id % 20 = 0").select("id"), spark.createDataFrame([], "src bigint, dst bigint"), 0.2, 0.95).count() > 0


def test_places_of_few():
    rng = np.random.default_rng(5)
    for shape, share in (((64, 32), 0.001), ((64, 32), 0.5), ((7, 9), 0.1), ((16, 8), 0.0)):
        mask = rng.random(shape) < share
        assert set(zip(*nearest.places(mask))) == set(zip(*np.nonzero(mask)))


def test_sample_gives_first_bars(spark, monkeypatch):
    """With a sample of the vectors, results are those of pairs, and few pairs leave a task."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 8)).astype("float32")
    x[1500:1504] = x[20]  # a query's copies
    v = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], "id bigint, cid int, v array<float>").repartition(16)
    q = v.where("id % 20 = 0")
    links = v.select(F.col("id").alias("src"), ((F.col("id") * 7) % 400).alias("dst"))
    runs = [
        lambda: A.vector_search(v, q, 5, "id", "v").select("query_id", "id", "score", "rank"),
        lambda: J.unlinked_similar(v, q.select("id").where("id > 400"), links, 0.2, 0.9).select("a", "b", "score", "rank"),
    ]
    expected = [sorted_rows(run()) for run in runs]
    asked = q.select("id", "v", F.lit(5).alias("k"))
    left = sum(part.count() for part in nearest.nearest(v, asked))
    monkeypatch.setattr(nearest, "SAMPLED", 1000)
    monkeypatch.setattr(nearest, "GROUPS", 64)
    assert [sorted_rows(run()) for run in runs] == expected == [plain(monkeypatch, run) for run in runs]
    assert sum(part.count() for part in nearest.nearest(v, asked)) < 0.75 * left


def test_copies_beyond_the_best_are_left_out(spark):
    """Of many equal vectors only those of the least ids are compared, and a query that is one of them finds the others."""
    v = spark.createDataFrame([(i, [1.0, 2.0] if i % 4 else [float(i), 1.0]) for i in range(400)], "id bigint, v array<float>").repartition(3)
    kept, _ = nearest.thinned(v, 3)
    assert kept.count() == 104 and {r.id for r in kept.where("v[1] = 2").collect()} == {1, 2, 3, 5}
    got = A.vector_search(v, v.where("id in (1, 7)"), 3, "id", "v").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 2), (1, 3), (1, 5), (7, 1), (7, 2), (7, 3)]


def test_clustering_reads_its_edges_once(spark):
    from graphloom.operators import analytics as G

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src bigint, dst bigint").mapInArrow(counted, "src bigint, dst bigint")
    got = {r.id: (r.degree, r.triangles) for r in G.clustering(edges).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (3, 1), 3: (1, 0)} and read.value == 4


def test_irregular_vectors_are_still_compared(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], "id bigint, v array<float>")
    assert A.vector_search(v, v.where("id = 0"), 5, "id", "v").count() == 3


def test_schemas_in_slices(spark, monkeypatch):
    from graphloom.plans.traversal_queries import execute_schemas

    whole = sorted_rows(execute_schemas(spark, SF))
    made = []
    monkeypatch.setattr(T, "SCHEMA_SEEDS", 500)
    monkeypatch.setattr(T, "materialize_slices", lambda df, by, n, *rest: made.append(n) or storage.materialize_slices(df, by, n, *rest))
    assert sorted_rows(execute_schemas(spark, SF)) == whole
    assert made == [4]


def test_rounds_in_slices(spark, monkeypatch):
    """Labels, held-out edges and confounders are the same in one slice and in several."""
    from graphloom.graph import edge_view
    from graphloom.operators import analytics as G
    from graphloom.operators import causal as C
    from graphloom.operators import rules as R

    e = edge_view(spark, SF, ["CONTAINS", "SUPPLIED_BY", "FULFILLED_BY"]).where("src < 'order:3' or src >= 'part'")
    pairs = e.where("rel = 'SUPPLIED_BY'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    paths = pairs.select("source", "target", F.array("source", F.lit("SUPPLIED_BY"), "target").alias("path"))
    start = e.select(F.col("src").alias("id"), F.col("rel").alias("label")).distinct().unionByName(spark.createDataFrame([("alone", "x")], "id string, label string"))
    start = start.groupBy("id").agg(F.min("label").alias("label"))
    rules = R.composition_table(spark, "CONTAINS SUPPLIED_BY FULFILLED_BY 0.9")
    runs = [
        lambda: G.label_propagation(e, 2),
        lambda: G.label_propagation(e, 1, initial=start),
        lambda: R.holdout_validation(e, rules),
        lambda: C.confounders(pairs, paths, e, 1, ("CONTAINS", "SUPPLIED_BY", "FULFILLED_BY")),
    ]
    one = [sorted_rows(run()) for run in runs]
    assert any("'alone'" in row for row in one[1])
    monkeypatch.setattr(storage, "SLICE_ROWS", 4000)
    monkeypatch.setattr(storage, "SLICE_BYTES", 200_000)
    monkeypatch.setattr(G, "VOTES", 8000)
    parts = []
    keep = storage.materialize_parts
    counted = lambda frames, *rest: keep((parts.append(1) or f for f in frames), *rest)
    monkeypatch.setattr(storage, "materialize_parts", counted)
    monkeypatch.setattr(R, "materialize_parts", counted)
    for run, rows in zip(runs, one):
        parts.clear()
        assert sorted_rows(run()) == rows
        assert len(parts) > 1


def test_slices_of_a_plan_with_joins(spark):
    from graphloom.graph import edge_view

    e = edge_view(spark, SF)
    keys = e.select("src").distinct()
    assert storage.plan_slices(e.join(keys, "src").join(keys, "src").join(spark.createDataFrame([("a",)], "dst string"), "dst")) == 1


def test_communities_on_numbers(spark):
    """Numbers follow the order of the ids, links hold every edge in both directions, and a level's graph is contracted from links."""
    from graphloom.operators import analytics as G

    e = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("é", "c"), ("a", None)], "src string, dst string")
    nodes, links = G.coded(e)
    number = {r.id: r.n for r in nodes.collect()}
    assert sorted(number, key=number.get) == ["a", "b", "c", "é"]
    name = {n: i for i, n in number.items()}
    got = {(name[r.src], name[r.dst], r.w) for r in links.collect()}
    assert got == {("a", "b", 2.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "é", 1.0), ("é", "c", 1.0)}
    halves = nodes.select(F.col("n").alias("id"), F.when(F.col("id") < "c", number["a"]).otherwise(number["c"]).alias("cid"))
    assert {(name[r.src], name[r.dst], r.w) for r in G.contract(links, halves).collect()} == {("a", "c", 1.0), ("c", "a", 1.0)}
    assert {(r.id, r.cid) for r in G.decoded(nodes, halves).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("é", "c")}


def test_hierarchical_reads_the_edges_once(spark, monkeypatch):
    from graphloom.graph import edge_view
    from graphloom.operators import analytics as G

    e = edge_view(spark, SF)
    labels = {r.id: r.label for r in G.label_propagation(e, 2).collect()}
    monkeypatch.setattr(G, "label_propagation", None)  # on texts, with links built anew for each level
    assert {r.id: r.cid for r in G.hierarchical(e, 10**9, 2).collect()} == labels
    assert G.hierarchical(e, 1, 2, 2).select("cid").distinct().count() < len(set(labels.values()))


def test_consensus_in_slices(spark, monkeypatch):
    from graphloom.graph import edge_view
    from graphloom.operators import analytics as G

    e = edge_view(spark, SF, ["SUPPLIED_BY", "LOCATED_IN"])
    one = sorted_rows(G.consensus_communities(e, 2))
    monkeypatch.setattr(G, "VOTES", 500)
    monkeypatch.setattr(G, "CODED_BYTES", 5000)
    assert sorted_rows(G.consensus_communities(e, 2)) == one
