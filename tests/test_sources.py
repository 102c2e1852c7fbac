"""Loaders and sinks on small files."""

import json

import pytest

from graphloom.sources import files, sinks

EDGES = {("a", "KNOWS", "b"), ("b", "LIKES", "c")}


def keys(df):
    return {(r.src, r.rel, r.dst) for r in df.collect()}


def both(edges):
    return edges | {(d, r, s) for s, r, d in edges}


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    "name, text",
    [
        ("g.csv", "source,target,relation\n a ,b,KNOWS\n#x,y,Z\nb,c,LIKES\n,c,LIKES\n"),
        ("g.tsv", "source\ttarget\trelation\na\tb\tKNOWS\nb\tc\tLIKES\n"),
        ("g.json", json.dumps([{"source": "a", "target": "b", "relation": "KNOWS"}, {"source": "b", "target": "c", "relation": "LIKES"}])),
        ("o.json", json.dumps({"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b", "relation": "KNOWS"}, {"source": "b", "target": "c", "relation": "LIKES"}]})),
        ("t.json", json.dumps([["a", "KNOWS", "b"], ["b", "LIKES", "c"]])),
        ("g.jsonl", '{"source": "a", "target": "b", "relation": "KNOWS"}\n{"source": "b", "target": "c", "relation": "LIKES"}\n'),
        ("g.graphml", '<graphml><graph><node id="a"/><edge source="a" target="b"><data key="r">KNOWS</data></edge><edge source="b" target="c"><data key="r">LIKES</data></edge></graph></graphml>'),
        ("g.gexf", '<gexf><graph><edges><edge id="0" source="a" target="b" label="KNOWS"/><edge id="1" source="b" target="c" label="LIKES"/></edges></graph></gexf>'),
        ("g.gml", 'graph [ node [ id 1 label "a" ] node [ id 2 label "b" ] node [ id 3 label "c" ] edge [ source 1 target 2 relation "KNOWS" ] edge [ source 2 target 3 relation "LIKES" ] ]'),
    ],
)
def test_loaders_by_suffix(spark, tmp_path, name, text):
    path = write(tmp_path, name, text)
    assert keys(files.load(spark, path, directed=True)) == EDGES
    assert keys(files.load(spark, path)) == both(EDGES)


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="no loader"):
        files.load(spark, "x.unknown")


def test_missing_relation_becomes_related(spark, tmp_path):
    path = write(tmp_path, "g.csv", "source,target\na,b\n")
    assert keys(files.from_csv(spark, path, directed=True)) == {("a", "RELATED_TO", "b")}


def test_kb_lines(spark, tmp_path):
    path = write(tmp_path, "kb.txt", "# note\nhead|relation|tail\na|KNOWS|b\nb,LIKES,c\n\n")
    assert keys(files.from_kb(spark, path)) == EDGES


def test_conceptnet(spark, tmp_path):
    rows = [
        ("/a/1", "/r/IsA", "/c/en/big_cat/n", "/c/en/animal", '{"weight": 2.0}'),
        ("/a/2", "/r/IsA", "/c/fr/chat", "/c/en/animal", '{"weight": 2.0}'),
        ("/a/3", "/r/IsA", "/c/en/dog", "/c/en/animal", '{"weight": 0.5}'),
        ("/a/4", "/r/ExternalURL", "/c/en/dog", "/c/en/x", '{"weight": 9.0}'),
    ]
    path = write(tmp_path, "c.tsv", "# comment\n" + "\n".join("\t".join(r) for r in rows) + "\n")
    got = files.from_conceptnet(spark, path).collect()
    assert [(r.src, r.rel, r.dst, r.weight, r.confidence) for r in got] == [("big cat", "IsA", "animal", 2.0, 0.2)]


def test_triples_keep_attributes_and_last_wins(spark):
    t = [("a", "KNOWS", "b", {"confidence": 0.4, "valid_from": 5.0}), ("a", "LIKES", "b")]
    assert {(r.rel, r.confidence, r.valid_from) for r in files.from_triples(spark, t).collect()} == {("KNOWS", 0.4, 5.0), ("LIKES", 1.0, None)}
    assert keys(files.from_triples(spark, t, last_wins=True)) == {("a", "LIKES", "b")}


def test_rdf_lines(spark, tmp_path):
    path = write(tmp_path, "g.nt", '<x:a> <x:knows> <x:b> .\n<x:a> <x:name> "A" .\n')
    assert keys(files.from_rdf(spark, path)) == {("x:a", "x:knows", "x:b")}


def test_sql_names_match_without_case(spark):
    assert keys(files.from_sql(spark, "SELECT 'a' AS Source, 'b' AS TARGET, 'KNOWS' AS Relation")) == {("a", "KNOWS", "b")}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) source", "'x' target", "id w", "'pad' extra").write.parquet(str(tmp_path / "p.parquet"))
    df = files.from_parquet(spark, str(tmp_path / "p.parquet"), where="w > 90")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(w,90)" in plan and "extra" not in plan.split("ReadSchema")[1]


def test_state_snapshots_and_logs(spark, tmp_path):
    e = files.from_triples(spark, [("a", "KNOWS", "b"), ("b", "LIKES", "c")])
    sinks.save_state(str(tmp_path / "state"), {"version": 1}, edges=e)
    manifest, tables = sinks.load_state(spark, str(tmp_path / "state"))
    assert manifest["version"] == 1 and keys(tables["edges"]) == EDGES
    sinks.save_snapshot(e, str(tmp_path / "snap"))
    snap = spark.read.schema(e.schema).json(str(tmp_path / "snap"))
    less = e.where("src = 'a'")
    assert keys(sinks.restore_snapshot(snap, less)) == EDGES
    assert {(r.src, r.change) for r in sinks.diff_snapshots(less, snap).collect()} == {("b", "added")}
    sinks.append_log(less.select("src", "rel", "dst"), str(tmp_path / "wal"))
    assert [(r.src, r.confidence, r.provenance) for r in sinks.replay_log(spark.read.json(str(tmp_path / "wal"))).collect()] == [("a", 1.0, "wal")]
    ledger = less.select("src", "rel", "dst").selectExpr("*", "1 as cycle")
    assert keys(sinks.rollback(e, ledger, "cycle = 1")) == {("b", "LIKES", "c")}
    sinks.write_sorted_by_source(e, str(tmp_path / "sorted"))
    assert keys(spark.read.parquet(str(tmp_path / "sorted"))) == EDGES
