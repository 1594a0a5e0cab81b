"""Batch evaluation of recorded tool-calling conversations.

``turns`` holds transcripts (case_id, turn, role, content, tool_calls), ``cases``
what is expected of them.  Every assistant turn of a transcript counts; a case's
lists are as long as its recorded conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.text import category, contains_any
from sceneframe.operators.scale import rank_in_group
from sceneframe.schema import CONTENT_BLOCKS

#: conversations with more assistant turns are numbered in slices
GROUP_TURNS = 1_000_000


def conversation_history(turns: DataFrame, prepended: DataFrame | None = None) -> DataFrame:
    """Turns in reading order: system first, then prepended ones, then the rest.

    Order by (case_id, part, turn); rows are not gathered per conversation.
    """
    part = F.when(F.col("role") == "system", 0).otherwise(2)
    out = turns.select("case_id", part.alias("part"), "turn", "role", "content")
    if prepended is not None:
        out = out.unionByName(prepended.select("case_id", F.lit(1).alias("part"), "turn", "role", "content"))
    return out


def content_blocks(messages: DataFrame, column: str = "content") -> DataFrame:
    """Split assistant content blocks into text and tool calls.

    Adds ``text`` (text blocks joined by newlines), ``tool_calls`` and
    ``has_text``; other block types are dropped.
    """
    blocks = F.from_json(column, CONTENT_BLOCKS)
    texts = F.transform(F.filter("_blocks", lambda b: b["type"] == "text"), lambda b: b["text"])
    calls = F.transform(F.filter("_blocks", lambda b: b["type"] == "tool_use"), lambda b: F.struct(
        b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("arguments")))
    return (messages.withColumn("_blocks", blocks)
            .withColumn("text", F.array_join(texts, "\n")).withColumn("has_text", F.size(texts) > 0)
            .withColumn("tool_calls", calls).drop("_blocks"))


def assistant_rounds(turns: DataFrame) -> DataFrame:
    """All assistant turns, numbered 1.. per case."""
    return rank_in_group(turns.where(F.col("role") == "assistant"), ["case_id"], [F.asc("turn")],
                         F.col("turn"), "round", GROUP_TURNS)


def extract_tool_calls(turns: DataFrame) -> DataFrame:
    """(case_id, turn, round, call_no, id, name, arguments), one row per call."""
    return (assistant_rounds(turns)
            .select("case_id", "turn", "round", F.posexplode("tool_calls").alias("call_no", "c"))
            .select("case_id", "turn", "round", "call_no", "c.id", "c.name", "c.arguments"))


def attach_tool_results(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """The recorded result of each call, or a default naming the tool."""
    default = F.to_json(F.struct(F.concat(F.lit("Mock result for "), F.col("name")).alias("info")))
    return (calls.join(cases.select("case_id", "mock_results"), "case_id", "left")
            .withColumn("result", F.coalesce(F.try_element_at("mock_results", F.col("name")), default))
            .drop("mock_results"))


def case_transcripts(turns: DataFrame) -> DataFrame:
    """(case_id, final_text, calls): all assistant text and calls, in order.

    The result holds a case's whole text, so a group is as large as its own answer.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"),
                                                   "tool_calls")))
    return (turns.where(F.col("role") == "assistant").groupBy("case_id").agg(ordered.alias("_r"))
            .select("case_id", F.array_join(F.transform("_r", lambda r: r["content"]), "").alias("final_text"),
                    F.flatten(F.transform("_r", lambda r: F.coalesce(
                        r["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
                    )).alias("calls")))


def final_text(turns: DataFrame) -> DataFrame:
    return case_transcripts(turns).select("case_id", "final_text")


def _quoted(names) -> "F.Column":
    """A list of strings as it prints in an issue text."""
    return F.concat(F.lit("["), F.array_join(F.transform(
        names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def score_cases(turns: DataFrame, cases: DataFrame) -> DataFrame:
    """cases with final_text, called, issues (in checking order) and passed."""
    none = F.array().cast("array<string>")
    calls = F.coalesce("calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    df = (cases.join(case_transcripts(turns), "case_id", "left")
          .withColumn("calls", calls).withColumn("final_text", F.coalesce("final_text", F.lit("")))
          .withColumn("called", F.transform("calls", lambda c: c["name"])))
    for c in ("expected_tools", "reject_tools", "should_contain", "should_not_contain"):
        df = df.withColumn(c, F.coalesce(c, none))
    df = df.withColumn("arg_check", F.coalesce("arg_check", F.create_map().cast("map<string,string>")))
    called, expected = F.col("called"), F.col("expected_tools")
    any_call = F.size("calls") > 0

    rejected = F.transform(F.filter("reject_tools", lambda t: F.array_contains(called, t)),
                           lambda t: F.concat(F.lit("Called rejected tool: "), t))

    named = F.filter(expected, lambda t: t.isNotNull())
    no_call_ok = F.exists(expected, lambda t: t.isNull())
    matched = F.coalesce(F.arrays_overlap(named, called), F.lit(False)) | (no_call_ok & ~any_call)
    wrong = F.when((F.size(expected) > 0) & ~matched, F.array(F.concat(
        F.lit("Expected one of "), _quoted(named), F.lit(", got "), _quoted(called)))).otherwise(none)

    def arguments(call):
        return F.from_json(call["arguments"], "map<string,string>")
    first_expected = F.get(F.filter("calls", lambda c: F.coalesce(F.array_contains(named, c["name"]),
                                                                  F.lit(False))), F.lit(0))
    empty_map = F.create_map().cast("map<string,string>")
    df = (df.withColumn("_a1", F.coalesce(arguments(first_expected), empty_map))
          .withColumn("_a0", F.coalesce(arguments(F.get("calls", F.lit(0))), empty_map))
          .withColumn("_args", F.when(F.size("_a1") > 0, F.col("_a1")).otherwise(F.col("_a0"))))

    def missing(entry):
        value = F.try_element_at(F.col("_args"), entry["key"])
        return ~F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lower(entry["value"]))

    def report(entry):
        value = F.try_element_at(F.col("_args"), entry["key"])
        shown = F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))
        return F.concat(F.lit("Arg "), entry["key"], F.lit("="), shown, F.lit(", expected '"),
                        entry["value"], F.lit("'"))
    entries = F.map_entries("arg_check")
    bad_args = F.when(any_call & (F.size("arg_check") > 0),
                      F.transform(F.filter(entries, missing), report)).otherwise(none)

    text = F.col("final_text")
    absent = F.when((F.size("should_contain") > 0) & ~contains_any(text, F.col("should_contain")),
                    F.array(F.concat(F.lit("Response missing all of: "), _quoted(F.col("should_contain"))))
                    ).otherwise(none)
    low = F.lower(text)
    forbidden = F.transform(
        F.filter("should_not_contain", lambda k: F.contains(low, F.lower(k))),
        lambda k: F.concat(F.lit("Response contains forbidden: '"), k, F.lit("'")))
    return (df.withColumn("issues", F.concat(rejected, wrong, bad_args, absent, forbidden))
            .withColumn("passed", F.size("issues") == 0)
            .withColumn("category", category(F.col("description")))
            .drop("_a0", "_a1", "_args"))


def eval_rollup(scored: DataFrame) -> DataFrame:
    """Passed, failed, total and percent per category and overall (category null)."""
    return (scored.rollup("category")
            .agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
                 F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_g"))
            .withColumn("scope", F.when(F.col("_g") == 1, "overall").otherwise("category"))
            .withColumn("percent", F.col("passed") / F.col("total") * 100.0).drop("_g"))


def eval_report(turns: DataFrame, cases: DataFrame) -> DataFrame:
    return eval_rollup(score_cases(turns, cases))
