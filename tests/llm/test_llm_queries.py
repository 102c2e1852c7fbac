"""The registered queries run over their whole tables; those with SQL equal it."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_links, brute_targets

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import queries, tokens
from graphloom.storage import materialize

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows(columns, [tuple(r) for r in got.select(*columns).collect()]) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op7_best_fit_packing"}))
def test_query_gives_a_row_per_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def brute_times(rows):
    """How often the mix takes each (doc_id, text), for rows of (doc_id, text, source)."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    targets = brute_targets({s: sum(size[r] for r in by[s]) for s in by}, (3, 1, 2), 1.5, 2)
    out = Counter()
    for s, members in by.items():
        total = sum(size[r] for r in members)
        if not total:
            continue
        epochs, rest = divmod(math.floor(targets[s]), total)
        for r in sorted(members, key=lambda r: (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:8], 16), str(r[0]), size[r])):
            taken = size[r] * epochs + min(max(rest, 0), size[r])
            rest -= size[r]
            out[r[0]] += math.ceil(taken / size[r]) if size[r] else 0
    return Counter({k: v for k, v in out.items() if v})


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == names
        kept.append(sorted((r.doc_id, r.text, r.source) for r in docs.collect()))
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(whole[i] == t for rows in kept for i, t, _ in rows)  # texts pass through unchanged
    language, quality, distinct, mixed = kept
    assert {r[0] for r in language} == {i for i, t in whole.items() if re.search(r"[^\W\d_]", t or "")}
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r[0] for r in quality}
    judged = [labels[r[0]] == (r[0] in stay) for r in language if r[0] in labels]
    assert sum(judged) >= 0.95 * len(judged)
    _, group = brute_links([r[:2] for r in quality])
    assert [r[0] for r in distinct] == sorted({quality[g][0] for g in group})
    assert Counter(r[0] for r in mixed) == brute_times(distinct)
    enc = tokens.encoding(tokens.default_path())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in out) == sum(len(enc.encode_ordinary(t)) + 1 for _, t, _ in mixed)
    ends = Counter()
    for r in out:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert "pipeline" in entry.queries()


def test_pipeline_with_clashing_columns_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({"size": F.lit("own"), "score": F.col("doc_id") * 2, "kept": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.schema.simpleString() == odd.schema.simpleString()
        assert not out.where("size <> 'own' or score <> doc_id * 2 or kept is not null").count()
        assert stage(spark, odd.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), SF).count() == 0
