"""Multi-step requests as graphs: the chain notation, execution levels, nearest results up the links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_NODES = 24


def chain_steps(messages: DataFrame, tags: list[str], key: str = "message_id", text: str = "text") -> DataFrame:
    """(key, step, kind, body, input): `[TAG] a -> [TAG] b` cut at arrows; a step takes the one before it.

    Only messages with a tag count; a part without one is text.
    """
    tag = r"(?i)\[(" + "|".join(map(re.escape, tags)) + r")\]"
    parts = F.filter(F.transform(F.split(F.trim(F.col(text)), r"\s*(?:->|→)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    rows = messages.filter(F.col(text).rlike(tag)).select(key, F.posexplode(parts).alias("_p", "part"))
    kind = F.nullif(F.lower(F.regexp_extract("part", tag, 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("part", tag, ""), r"^[\s:—-]+|[\s:—-]+$", "")
    return rows.select(key, (F.col("_p") + 1).alias("step"), F.coalesce(kind, F.lit("text")).alias("kind"), body.alias("body"), F.when(F.col("_p") > 0, F.col("_p")).alias("input"))


class GraphError(ValueError):
    """The graph cannot run: too large, an unknown link, or a cycle."""


def execution_order(spark: SparkSession, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, level, position) in rounds of ready nodes, each in the order given (TOP-06).

    nodes (node_id, ord), links (src, dst): src runs first. A node's level is its longest path
    from a start, which one recursive query gives; a path longer than the node count is a cycle.
    """
    n = nodes.count()
    if n == 0 or n > MOST_NODES:
        raise GraphError(f"{n} nodes; 1 to {MOST_NODES} can run")
    ends = links.select("src").union(links.select("dst")).distinct()
    unknown = ends.join(nodes.select(F.col("node_id").alias("src")), "src", "left_anti").first()
    if unknown:
        raise GraphError(f"a link names {unknown[0]}, which is no node")
    nodes.createOrReplaceTempView("_graph_nodes")
    links.distinct().createOrReplaceTempView("_graph_links")
    levels = spark.sql(f"""
        WITH RECURSIVE walk AS (
          SELECT node_id, 0 AS level FROM _graph_nodes
          UNION ALL SELECT DISTINCT l.dst, w.level + 1 FROM walk w JOIN _graph_links l ON l.src = w.node_id WHERE w.level <= {n}
        ) SELECT node_id, max(level) AS level FROM walk GROUP BY node_id""")
    rows = [tuple(r) for r in levels.join(nodes, "node_id").orderBy("level", "ord").select("node_id", "level").collect()]
    if any(level >= n for _, level in rows):
        raise GraphError("the links form a cycle")
    return spark.createDataFrame([(i, level, p) for p, (i, level) in enumerate(rows)], f"node_id {dict(nodes.dtypes)['node_id']}, level int, position int")


def nearest_above(nodes: DataFrame, links: DataFrame, kind: str, rounds: int = MOST_NODES) -> DataFrame:
    """(node_id, found): for each node, the closest node of `kind` up its links, the first id among equals (TOP-07)."""
    wanted = nodes.filter(F.col("kind") == kind).select(F.col("node_id").alias("above"))
    front = nodes.select("node_id", F.col("node_id").alias("above"))
    up = links.select(F.col("dst").alias("above"), F.col("src").alias("_next"))
    reached, found = front, None
    for depth in range(1, rounds + 1):
        front = front.join(up, "above").select("node_id", F.col("_next").alias("above")).distinct().join(reached, ["node_id", "above"], "left_anti")
        hit = front.join(wanted, "above", "left_semi").select("node_id", F.struct(F.lit(depth).alias("d"), F.col("above").alias("id")).alias("at"))
        found = hit if found is None else found.unionByName(hit)
        front = front.cache()
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return found.groupBy("node_id").agg(F.min("at").alias("at")).select("node_id", F.col("at.id").alias("found"))
