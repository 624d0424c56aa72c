"""Data-flow policy over the tool calls of runs: what has been seen, what it is trusted, what a call may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distinctive_tokens, normal_url, policy_words, urls_in
from .documents import private_in

#: Each tool's effect, the trust of what it gives (inherit: the lowest so far) and the mode that it needs (fixed values).
TOOLS = {
    "search": ("none", "private", "read"),
    "exact_search": ("none", "private", "read"),
    "sql_query": ("none", "private", "read"),
    "read_file": ("none", "private", "read"),
    "list_dir": ("none", "private", "read"),
    "read_upload": ("none", "untrusted", "read"),
    "web_search": ("external", "untrusted", "web"),
    "fetch_page": ("external", "untrusted", "web"),
    "run_code": ("none", "inherit", "code"),
    "apply_changes": ("write", "trusted", "code"),
    "install_package": ("external", "untrusted", "code"),
}
CONTROL, ALWAYS_CONFIRM = ("answer", "refuse"), ("apply_changes", "install_package")
TRUST = {"untrusted": 0, "private": 1, "trusted": 2}


def _of_tool(tool: Column, place: int) -> Column:
    """A property of a tool, null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in TOOLS.items() for x in (k, v[place]))), tool)


def private_entities(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names that mark private data: stems of files and symbols of six characters or more that look invented (POL-01).

    Stems hold an underscore, hyphen or digit and don't begin with two underscores; symbols hold an
    underscore or an inner capital.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    stems = files.select(stem.alias("name")).filter((F.length("name") >= 6) & F.col("name").rlike(r"[_\-\d]") & ~F.startswith("name", F.lit("__")))
    named = symbols.filter((F.length("name") >= 6) & (F.contains("name", F.lit("_")) | F.col("name").rlike("[a-z][A-Z]"))).select("name")
    return stems.union(named).distinct()


def labels(steps: DataFrame) -> DataFrame:
    """Steps (run_id, step, tool) with `trust`, what the tool's result is trusted, and `tainted`, whether anything untrusted came before (POL-03, AGG-24).

    A tool that inherits, or an unknown one, takes the lowest trust before it, a question being
    trusted; it never lowers that, so one running minimum over the other tools gives all labels.
    """
    rank = F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))
    own = F.try_element_at(rank, _of_tool(F.col("tool"), 1))  # null: inherits
    before = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    lowest = F.least(F.coalesce(F.min(own).over(before), F.lit(TRUST["trusted"])), F.lit(TRUST["trusted"]))
    name = F.create_map(*(F.lit(x) for k, v in TRUST.items() for x in (v, k)))
    return steps.withColumn("_lowest", lowest).withColumn("trust", name[F.coalesce(own, "_lowest")]).withColumn("tainted", F.col("_lowest") == TRUST["untrusted"]).drop("_lowest")


def sightings(runs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(run_id, kind, value, since): addresses that may be fetched and private tokens, with the step that first showed each (POL-03).

    runs (run_id, question); labelled steps with their `output`. A question shows at step -1, so that a
    call is checked by joins on what it holds, whatever a run has seen: no list grows along a run.
    """
    asked = runs.select("run_id", F.lit("url").alias("kind"), F.explode(F.transform(urls_in(F.col("question")), normal_url)).alias("value"), F.lit(-1).cast("long").alias("step"))
    step = F.col("step").cast("long").alias("step")
    found = labelled.filter("tool = 'web_search'").select("run_id", F.lit("url").alias("kind"), F.explode(F.transform(urls_in(F.col("output")), normal_url)).alias("value"), step)
    private = labelled.filter("trust = 'private'").select("run_id", F.lit("token").alias("kind"), F.explode(distinctive_tokens(F.col("output"))).alias("value"), step)
    return asked.unionByName(found).unionByName(private).groupBy("run_id", "kind", "value").agg(F.min("step").alias("since"))


def verdicts(runs: DataFrame, steps: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, step, action, rule, held): allow, confirm or deny for each call, given what its run had seen by then (POL-02, FLT-16, SET-03).

    runs (run_id, question, web, code, enabled), steps (run_id, step, tool, query, url, output), names
    (name) of private entities. `held` lists what speaks against a search: private names in its query,
    else tokens of private results that the question does not hold.

    The rules in their order: unknown tools and those of a mode that is off are denied; a policy that
    is off allows the rest; searches with private names or leaked tokens, writes and installations,
    and any outward effect after untrusted content want a confirmation; pages are read only by an
    address that was seen.
    """
    labelled = labels(steps)
    seen = sightings(runs, labelled)
    at = ["run_id", "step"]
    searches = labelled.filter("tool = 'web_search'").withColumn("_key", F.struct(*at))
    named = private_in(searches.select("_key", F.col("query").alias("text")), names.filter(F.length("name") >= 4), "_key")
    named = named.groupBy("_key").agg(F.array_sort(F.collect_set("name")).alias("names")).select("_key.*", "names")
    tokens = searches.select(*at, F.explode(distinctive_tokens(F.col("query"))).alias("value"))
    asked = runs.select("run_id", F.explode(policy_words(F.col("question"))).alias("value")).distinct()
    private = seen.filter("kind = 'token'").select("run_id", "value", "since")
    leaked = tokens.join(private, ["run_id", "value"]).filter(F.col("since") < F.col("step")).join(asked, ["run_id", "value"], "left_anti")
    leaked = leaked.groupBy(*at).agg(F.array_sort(F.collect_set("value")).alias("leaked"))
    pages = labelled.filter("tool = 'fetch_page'").select(*at, normal_url(F.col("url")).alias("value"))
    known = pages.join(seen.filter("kind = 'url'").select("run_id", "value", "since"), ["run_id", "value"]).filter(F.col("since") < F.col("step")).select(*at, F.lit(True).alias("known"))
    rows = labelled.join(runs.select("run_id", "web", "code", "enabled"), "run_id").join(named, at, "left").join(leaked, at, "left").join(known, at, "left")
    tool, mode, effect = F.col("tool"), _of_tool(F.col("tool"), 2), _of_tool(F.col("tool"), 0)
    off = ((mode == "web") & ~F.col("web")) | ((mode == "code") & ~F.col("code"))
    rule = (
        F.when(tool.isin(*CONTROL), "")
        .when(effect.isNull(), "tools")
        .when(off, "S21")
        .when(~F.col("enabled"), "off")
        .when(F.col("names").isNotNull() | F.col("leaked").isNotNull(), "rule 1")
        .when(tool == "fetch_page", F.when(F.col("known"), "").otherwise("rule 3"))
        .when(tool.isin(*ALWAYS_CONFIRM), "FR14")
        .when((effect != "none") & F.col("tainted"), "rule 2")
        .otherwise("")
    )
    actions = {"tools": "deny", "S21": "deny", "off": "allow", "rule 1": "confirm", "rule 2": "confirm", "rule 3": "deny", "FR14": "confirm", "": "allow"}
    action = F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))[F.col("rule")]
    held = F.when(F.col("rule") == "rule 1", F.coalesce("names", F.slice("leaked", 1, 5))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("rule", rule).select(*at, action.alias("action"), "rule", held.alias("held"))
