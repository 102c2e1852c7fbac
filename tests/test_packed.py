"""Answers on numbered nodes against the plan on texts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import packed as P
from graphloom.plans import traversal_queries as Q

TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem")
COLUMNS = ("score", "path_score", "consensus", "branches", "paths", "path", "confidence", "uncertainty")


@pytest.fixture(scope="module")
def hubs(tmp_path_factory):
    """Tables with more than twenty edges of an order, repeated lines and orders, ids of one to five digits, equal scores, lines of no order."""
    path = tmp_path_factory.mktemp("hubs")
    at = pd.Timestamp("2024-01-01")
    keys = [1, 2, 10, 12, 19999, 0]
    save = lambda name, rows, columns: pd.DataFrame(rows, columns=columns).to_parquet(f"{path}/{name}.parquet", coerce_timestamps="us")
    save("region", [(i,) for i in range(3)], ["r_regionkey"])
    save("nation", [(i, i % 3) for i in range(12)], ["n_nationkey", "n_regionkey"])
    save("customer", [(k, i) for i, k in enumerate(keys)], ["c_custkey", "c_nationkey"])
    save("supplier", [(k, (7 * k) % 12) for k in range(40)], ["s_suppkey", "s_nationkey"])
    save("part", [(k,) for k in range(130)], ["p_partkey"])
    save("orders", [(k, keys[-i - 1], at) for i, k in enumerate(keys)] + [(2, 1, at), (77, 12, at)], ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = [(k, (i * 17 + k) % 130, (i * i + k) % 40, float(i % 5), 0.01 * (i % 3), at + pd.Timedelta(days=i % 4)) for k in [*keys, 500] for i in range(45 if k == 10 else 9)]
    lines += [*lines[:20], (1, 5, 6, 1.0, 0.0, at), (1, 5, 6, 1.0, 0.0, at), (1, 12, 6, 1.0, 0.0, at), (1, 1, 6, 1.0, 0.0, at)]
    save("lineitem", lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate"])
    return str(path)


def table(df):
    numbers = [F.round(c, 7).alias(c) for c in ("score", "path_score", "consensus", "confidence", "uncertainty")]
    rows = df.select("query_id", "rank", "entity", *numbers, F.col("branches").cast("int"), F.col("paths").cast("int"), F.concat_ws("|", "path").alias("path"))
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_answers_on_numbers_are_those_on_texts(spark, hubs, monkeypatch, small):
    want = table(Q._text_answers(spark, hubs, *COLUMNS))
    if small:  # blocks of two queries, several files, tasks and slices
        for name, value in (("BLOCK", 2), ("TASK_ROWS", 20), ("FILE_ROWS", 30)):
            monkeypatch.setattr(P, name, value)
        monkeypatch.setattr(storage, "SLICE_ROWS", 20)
    monkeypatch.setattr(Q, "_text_answers", lambda *_: pytest.fail("the plan on texts was taken"))
    assert want and table(Q._answers(spark, hubs, *COLUMNS)) == want


def test_missing_or_negative_keys_take_the_plan_on_texts(spark, hubs, tmp_path, monkeypatch):
    for name in TABLES:
        df = pd.read_parquet(f"{hubs}/{name}.parquet")
        if name == "orders":
            df = pd.concat([df, pd.DataFrame({"o_orderkey": [-5], "o_custkey": [1], "o_orderdate": df.o_orderdate[:1]})])
        df.to_parquet(f"{tmp_path}/{name}.parquet", coerce_timestamps="us")
    want = table(Q._text_answers(spark, str(tmp_path), *COLUMNS))
    assert any(r[0] == -5 for r in want) and table(Q._answers(spark, str(tmp_path), *COLUMNS)) == want


def test_text_keys_have_the_order_of_texts():
    names = P.Names([P.Part(None, "a", (P.Edge("R", "b"),))], {})
    numbers = [0, 1, 2, 9, 10, 12, 19, 100, 199, 1999, 19999999999, 99999999999, 12345678901]
    codes = P.np.array([n * 16 + names.code["a"] for n in numbers])
    ends = [(f"{n}", k) for n, k in zip(numbers, P.text_key(codes, True))] + [(f"{n}|", k) for n, k in zip(numbers, P.text_key(codes, False))]
    assert [t for t, _ in sorted(ends)] == [t for t, _ in sorted(ends, key=lambda x: x[1])]


def test_kinds_that_come_back_are_left_to_texts():
    part = P.Part(None, "a", (P.Edge("R", "b"),))
    assert P.layers([part], "a", 2) == [[0], []]
    assert P.layers([part, P.Part(None, "b", (P.Edge("S", "a"),))], "a", 2) is None


def test_causes_and_relations_on_numbers_are_those_on_texts(spark, hubs, monkeypatch):
    """The causal edges are not capped, the beam's are."""
    causes = ("FULFILLED_BY", "LOCATED_IN", "IN_REGION")
    got = Q._number_answers(spark, hubs, "reached", "rels", causes=causes)
    seeds = Q._seeds(spark, hubs)
    reached = Q.T.reachable(seeds, Q.edge_view(spark, hubs, list(causes)), 3).where("depth > 0").select("query_id", F.col("id").alias("entity"), F.lit(True).alias("ok")).distinct()
    want = Q._text_answers(spark, hubs, "rels").join(reached, ["query_id", "entity"], "left").select("query_id", "rank", "entity", F.coalesce("ok", F.lit(False)), F.concat_ws(">", "rels"))
    rows = sorted(map(tuple, got.select("query_id", "rank", "entity", "reached", F.concat_ws(">", "rels")).collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[3] for r in rows} == {True, False}


def test_conflicts_take_one_shuffle(spark):
    rows = [(1, 1, "a", ["x", "R", "a"]), (1, 2, "b", ["x", "S", "y", "R", "b"]), (1, 3, "c", ["x", "T", "c"]), (2, 1, "a", ["x", "S", "a"]), (2, 2, "c", ["x", "T", "R", "S", "c"])]
    answers = spark.createDataFrame(rows, "query_id int, rank int, entity string, path array<string>").repartition(3)
    opposing = spark.createDataFrame([("R", "S"), ("S", "R"), ("R", "S"), (None, "R")], "a string, b string")
    got = Q.N.answer_conflicts(answers, opposing)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "b", "R", "S")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(query_id") == 1
