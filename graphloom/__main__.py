"""Command line: ``python -m graphloom COMMAND EDGES …`` on a file that ``sources.files.load`` reads.

Commands: stats, query SEED [HOPS], ask QUESTION, communities, infer, contradictions.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.api import Graph
from graphloom.operators import analytics


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, path, *rest = args
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    graph = Graph.load(spark, path)
    if command == "stats":
        out = graph.stats()
    elif command == "query":
        seeds = spark.createDataFrame([(0, rest[0])], "query_id int, id string")
        out = graph.build().query(seeds, max_hop=int(rest[1]) if len(rest) > 1 else None).select("rank", "entity", "score", F.concat_ws(" ", "path").alias("path"))
    elif command == "ask":
        out = graph.build().ask(" ".join(rest)).select("rank", "entity", "score", "said")
    elif command == "communities":
        out = analytics.label_propagation(graph.edges).groupBy("label").count().orderBy(F.desc("count"), "label")
    elif command == "infer":
        out = graph.infer()
    elif command == "contradictions":
        out = graph.contradictions()
    else:
        print(__doc__)
        return 2
    out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
