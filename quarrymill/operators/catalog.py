"""Catalog relations: state differences, analytics views, the read-only SQL tool."""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import TABLE_FUNCTIONS

ERROR_NAME = r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Interrupt|Exit))\b"


def state_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, change): new, changed, unchanged or deleted, from one full outer join (JOIN-10, SET-02/06)."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def replace_files(current: DataFrame, update: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows of the update in place of all rows of the same files (SNK-01, SNK-04)."""
    return current.join(update.select(key).distinct(), key, "left_anti").unionByName(update)


def remove_files(current: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")


def mark_error(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed files become error rows; failures (path, error) (SNK-02)."""
    f = failures.select("path", F.col("error").alias("_error"))
    joined = files.join(f, "path", "full_outer")
    failed = F.col("_error").isNotNull()
    return joined.select("path", *(F.when(failed, F.lit("error")).otherwise(F.col(c)).alias(c) if c == "status" else F.coalesce("_error", c).alias(c) if c == "error" else F.col(c) for c in files.columns if c != "path"))


def extraction_todo(notebooks: DataFrame, state: DataFrame, model: str) -> DataFrame:
    """ok notebooks whose (hash, model) has no extraction yet (JOIN-11)."""
    s = state.select(F.col("file_path").alias("path"), F.col("content_hash").alias("_hash"), F.col("model").alias("_model"))
    fresh = F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_model").eqNullSafe(F.lit(model))
    return notebooks.filter("status = 'ok'").join(s, "path", "left").filter(~fresh).select(*notebooks.columns)


def experiment_ids(experiments: DataFrame) -> DataFrame:
    """Dense ids in (file, index) order (JOIN-02). The offsets of files are summed once over one row per file."""
    sizes = experiments.groupBy("file_path").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("file_path").orderBy("idx"))
    return experiments.join(offsets.select("file_path", "_before"), "file_path").withColumn("id", F.col("_before") + within).drop("_before")


def analytics_views(nodes: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The `files`, `notebooks` and `cells` relations that SQL may see (SNK-07, AGG-03/04).

    nodes (file_path, node_type, ord, cell, cell_type, text, execution_count); outputs are nodes
    of type `output` with the cell's number.
    """
    n = nodes.groupBy("file_path").agg(F.count_if(F.col("node_type") != "file").cast("int").alias("n_fragments"))
    file_view = files.join(n.withColumnRenamed("file_path", "path"), "path", "left").select("path", "file_type", F.col("size").alias("size_bytes"), F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"), "status")
    text_of = lambda cond, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text")))), lambda x: x["text"]), sep)
    is_out = F.col("node_type") == "output"
    cells = nodes.filter(F.col("cell").isNotNull()).groupBy(F.col("file_path").alias("path"), "cell").agg(
        F.max(F.when(~is_out, F.col("cell_type"))).alias("cell_type"),
        text_of(~is_out, "\n").alias("source"),
        text_of(is_out, "").alias("output"),
        F.max(F.when(~is_out, F.col("execution_count"))).alias("execution_count"),
    )
    name = F.regexp_extract(F.coalesce("output", F.lit("")), ERROR_NAME, 1)
    cells = cells.withColumn("output", F.nullif("output", F.lit(""))).withColumn("error_name", F.nullif(name, F.lit(""))).withColumn("has_error", (F.col("error_name").isNotNull()).cast("int"))
    first_line = F.trim(F.regexp_replace(F.regexp_extract("source", r"^\s*([^\n]*)", 1), "^#+", ""))
    w = Window.partitionBy("path").orderBy("cell")
    fell = F.lag("_ec").over(w) > F.col("_ec")
    carried = cells.withColumn("_ec", F.last("execution_count", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    notebooks = carried.withColumn("_fell", F.coalesce(fell, F.lit(False)).cast("int")).groupBy("path").agg(
        F.min_by(first_line, F.when(F.col("cell_type") == "markdown", F.col("cell"))).alias("title"),
        F.count("*").cast("int").alias("n_cells"),
        F.count_if(F.col("cell_type") == "code").cast("int").alias("n_code_cells"),
        F.max("_fell").alias("out_of_order"),
    )
    return {"files": file_view, "notebooks": notebooks, "cells": cells.select("path", "cell", "cell_type", "source", "output", "has_error", "error_name")}


class SQLRejected(ValueError):
    """A statement that the tool does not run, with the reason."""


#: Plan nodes that only read (fixed values of the parser's own class names).
_READS = frozenset(
    "Project Filter Sort Aggregate Join Union Intersect Except Distinct Deduplicate SubqueryAlias UnresolvedRelation GlobalLimit LocalLimit Offset Limit UnresolvedWith With CTERelationDef CTERelationRef WithCTE UnresolvedHaving Window Generate UnresolvedInlineTable LocalRelation OneRowRelation LateralJoin Pivot UnresolvedPivot Tail Sample UnresolvedSubqueryColumnAliases UnionLoop UnionLoopRef UnresolvedOrdinal UnresolvedTableValuedFunction FunctionTableSubqueryArgumentExpression ParameterizedQuery WithWindowDefinition Expand Unpivot".split()
)
_UNSAFE_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name read_files".split())


def _plans(plan):
    """All logical plans of a parsed statement: children, inner children (CTE bodies), subqueries in expressions."""
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        for seq in (p.children(), p.innerChildren(), p.subqueries()):
            it = seq.iterator()
            while it.hasNext():
                x = it.next()
                if hasattr(x, "children") and "plans.logical" in x.getClass().getName() or "analysis" in x.getClass().getName():
                    stack.append(x)


def validate_sql(spark: SparkSession, sql: str, tables: set[str], max_rows: int = 50) -> str:
    """The statement wrapped with a forced limit; SQLRejected if it is not one read of the allowed tables (FLT-21, SQL-03, SET-04).

    Spark's own parser gives the unresolved plan; every node must be a reading one, every
    relation an allowed table or a common table expression of the statement.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise SQLRejected("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise SQLRejected(f"not one SELECT statement: {str(e).splitlines()[0][:200]}") from None
    allowed = {t.lower() for t in tables}
    ctes, used = set(), set()
    for p in _plans(plan):
        name = p.getClass().getSimpleName()
        if name not in _READS:
            raise SQLRejected(f"only SELECT is allowed, not {name}")
        if name == "UnresolvedWith":
            it = p.cteRelations().iterator()
            while it.hasNext():
                ctes.add(it.next()._1().lower())
        elif name == "UnresolvedTableValuedFunction":
            function = p.name().mkString(".").lower()
            if function not in TABLE_FUNCTIONS:
                raise SQLRejected(f"table function {function} is not allowed")
        elif name == "UnresolvedRelation":
            used.add(p.tableName().replace("`", "").lower())
    unknown = used - ctes - allowed
    if unknown:
        raise SQLRejected(f"unknown tables: {', '.join(sorted(unknown))}")
    for f in re.findall(r"([A-Za-z_]\w*)\s*\(", text):
        if f.lower() in _UNSAFE_FUNCTIONS:
            raise SQLRejected(f"function {f} is not allowed")
    return f"SELECT * FROM (\n{text}\n) LIMIT {max_rows + 1}"


#: What a statement is made of: comments, quoted texts and names, words, anything else.
_TOKENS = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_]\w*|\s+|.", re.S)
_OF_SEVERAL = {"max": "greatest", "min": "least"}


def translate_dialect(sql: str) -> str:
    """Where the source dialect gives other results: LIKE ignores case there; max and min of several arguments are greatest and least.

    Quoted texts, quoted names and comments stay as they are.
    """
    tokens = _TOKENS.findall(sql)
    opened: list[tuple[int, int]] = []  # of each open bracket: its function's place and how many commas it holds
    for i, t in enumerate(tokens):
        if t.lower() == "like":
            tokens[i] = "ILIKE"
        elif t == "(":
            before = next((k for k in range(i - 1, -1, -1) if not tokens[k].isspace()), -1)
            opened.append((before, 0))
        elif t == "," and opened:
            opened[-1] = (opened[-1][0], opened[-1][1] + 1)
        elif t == ")" and opened:
            name, commas = opened.pop()
            if commas and name >= 0 and tokens[name].lower() in _OF_SEVERAL:
                tokens[name] = _OF_SEVERAL[tokens[name].lower()]
    return "".join(tokens)


@dataclass
class SQLResult:
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None

    def markdown(self) -> str:
        """A table with bars escaped, six significant digits and cells cut at 200 characters (SNK-12)."""
        cell = lambda v: "" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")[:200]
        lines = ["| " + " | ".join(self.columns) + " |", "|" + "---|" * len(self.columns)]
        return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in self.rows)])

    def provenance(self) -> list[tuple]:
        """Distinct (path, cell) in order of first appearance (SQL-08)."""
        path = next((i for i, c in enumerate(self.columns) if c.lower() in ("path", "file", "file_path", "notebook")), None)
        cell = next((i for i, c in enumerate(self.columns) if c.lower() == "cell"), None)
        return [] if path is None else list(dict.fromkeys((r[path], r[cell] if cell is not None else None) for r in self.rows))


def run_sql(spark: SparkSession, sql: str, tables: set[str], max_rows: int = 50, timeout_s: float = 5.0) -> SQLResult:
    """Validate and run; the job group is cancelled at the timeout (FLT-22)."""
    try:
        wrapped = validate_sql(spark, sql, tables, max_rows)
    except SQLRejected as e:
        return SQLResult(sql, error=str(e))
    group = f"sql-{threading.get_ident()}-{id(wrapped)}"
    spark.sparkContext.setJobGroup(group, "read-only SQL", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        df = spark.sql(wrapped)
        rows = [tuple(r) for r in df.collect()]
    except Exception as e:
        return SQLResult(sql, error=str(e).splitlines()[0])
    finally:
        timer.cancel()
    return SQLResult(sql, df.columns, rows[:max_rows], len(rows) > max_rows)


def answer_with_sql(spark: SparkSession, question: str, writer, tables: set[str], attempts: int = 3, **limits) -> SQLResult:
    """Write, validate, run; an error or an empty result goes back to the writer (SQL-07)."""
    feedback, result = None, SQLResult("")
    for _ in range(attempts):
        result = run_sql(spark, translate_dialect(writer(question, feedback)), tables, **limits)
        if not result.error and result.rows:
            break
        feedback = result.error or "the query returned no rows"
    return result


def stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, status, n): counts by file type and status, node type and edge type (AGG-01)."""
    a = files.groupBy("file_type", "status").count().select(F.lit("file").alias("kind"), F.col("file_type").alias("name"), "status", F.col("count").alias("n"))
    b = nodes.groupBy("node_type").count().select(F.lit("node").alias("kind"), F.col("node_type").alias("name"), F.lit(None).cast("string").alias("status"), F.col("count").alias("n"))
    c = edges.groupBy("type").count().select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.lit(None).cast("string").alias("status"), F.col("count").alias("n"))
    return a.unionByName(b).unionByName(c)


def touching_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among `nodes` (JOIN-22): two equi-joins, since an OR would be a nested loop."""
    ids = nodes.select(F.col("node_id").alias("_id")).distinct()
    return edges.join(ids, F.col("src") == F.col("_id"), "left_semi").union(edges.join(ids, F.col("dst") == F.col("_id"), "left_semi")).distinct()


def update_nodes(nodes: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of `changes` replace those of the same rows where they are not null (SNK-05)."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    joined = nodes.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in nodes.columns))


def problems(files: DataFrame) -> DataFrame:
    """Files with an error or warnings, by status descending and path (FLT-17)."""
    return files.filter((F.col("status") != "ok") | (F.size("warnings") > 0)).orderBy(F.desc("status"), "path")


def experiment_summary(experiments: DataFrame, metrics: DataFrame, hyperparameters: DataFrame) -> DataFrame:
    """Each experiment with its metrics and hyperparameters as sorted arrays (AGG-22, JOIN-01)."""
    m = metrics.groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("name", "split", "value"))).alias("metrics"))
    h = hyperparameters.groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("hyperparameters"))
    return experiments.join(m, experiments["id"] == m["experiment_id"], "left").drop("experiment_id").join(h, experiments["id"] == h["experiment_id"], "left").drop("experiment_id")


def nodes_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Fragments at places (place_id, file_path, cell, line_start, line_end) (FLT-03): with a cell, its fragments that are no
    output, within the lines if given; without one, only fragments that have no cell."""
    n, p = nodes.alias("n"), places.alias("p")
    lines = F.col("p.line_start").isNull() | ((F.col("n.line_start") <= F.coalesce("p.line_end", "p.line_start")) & (F.col("n.line_end") >= F.col("p.line_start")))
    in_cell = F.col("p.cell").isNotNull() & (F.col("n.cell") == F.col("p.cell")) & (F.col("n.node_type") != "output") & (lines | F.col("n.line_start").isNull())
    plain = F.col("p.cell").isNull() & F.col("n.cell").isNull() & lines
    return p.join(n, (F.col("n.file_path") == F.col("p.file_path")) & F.coalesce(in_cell | plain, F.lit(False))).select("p.place_id", "n.node_id", "n.ord")
