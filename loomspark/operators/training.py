"""Training examples from the graph, as DataFrames and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.functions.scores import cleared
from loomspark.operators.graph import coherent


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chatml(nodes: DataFrame, clearance: int = 0, system: str | None = None) -> DataFrame:
    """agent_id, label, line, in the order of agent and label: a question about each cleared node with a text, and its answer.

    The answer is the description, the source text unless it repeats that, and the aliases, all where there are any.
    Rows without clearance count as 0. With a system text (a format with one %s for the agent) that comes first.
    """
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("array<string>" if c == "aliases" else "string")
    about, said = F.nullif(have("description"), F.lit("")), F.nullif(have("source_text"), F.lit(""))
    also = F.when(F.size(have("aliases")) > 0, F.concat(F.lit("Also known as: "), F.array_join(have("aliases"), ", "), F.lit(".")))
    answer = F.concat_ws(" ", about, F.when(said != F.coalesce(about, F.lit("")), said), also)
    rows = nodes.withColumn("_answer", answer).where((F.coalesce("clearance", F.lit(0)) <= clearance) & (F.trim("_answer") != ""))
    topic = F.concat(F.lit("What do you know about "), F.coalesce("label", F.lit("Unknown")), F.lit("?"))
    turns = [message("user", topic), message("assistant", F.col("_answer"))]
    if system:
        turns.insert(0, message("system", F.format_string(system, F.coalesce("agent_id", F.lit("unknown")))))
    return rows.select("agent_id", "label", F.to_json(F.struct(F.array(*turns).alias("messages"))).alias("line")).orderBy("agent_id", "label")


def fact_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, line: 'A (T) --[R]--> B (T)' for edges of nodes with two or more edge ends."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2")
    shown = nodes.select("id", F.concat("label", F.lit(" ("), "type", F.lit(")")).alias("shown"))
    a, b = shown.select(F.col("id").alias("source_id"), F.col("shown").alias("a")), shown.select(F.col("id").alias("target_id"), F.col("shown").alias("b"))
    lines = edges.join(a, "source_id").join(b, "target_id").select("source_id", "target_id", F.concat("a", F.lit(" --["), "relation", F.lit("]--> "), "b").alias("line"))
    by_end = lines.select(F.col("source_id").alias("id"), "line").unionByName(lines.select(F.col("target_id").alias("id"), "line"))
    return by_end.join(ends.select("id"), "id", "left_semi")


def cleared_edges(edges: DataFrame, nodes: DataFrame, caller: int) -> DataFrame:
    """Edges of which both ends are for the caller to see (no clearance counts as 0): all nodes of a path over them are."""
    return coherent(edges, nodes.where(cleared(F.col("clearance"), caller, 0)))


def dpo_pairs(paths: DataFrame, nodes: DataFrame, high: float = 0.8, low: float = 0.2, good: float = 0.7, bad: float = 0.3) -> DataFrame:
    """start, chosen, rejected: of the paths from a retrieved start, the best to an end of high energy and the worst to one of low energy or, where nodes have the column, one that needs_human.

    paths (path, weights); a path is good if its mean weight is at least `good`, bad if at most `bad`. Starts with
    only one kind are left out.
    """
    doubt = F.coalesce(F.col("needs_human"), F.lit(False)) if "needs_human" in nodes.columns else F.lit(False)
    ends = nodes.select(F.col("id").alias("end"), F.col("energy").alias("end_energy"), doubt.alias("doubt"))
    starts = nodes.where("retrieval_count > 0").select(F.col("id").alias("start"))
    mean = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w) / F.size("weights")
    rows = paths.select(F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"), "path", mean.alias("w")).join(starts, "start", "left_semi").join(ends, "end")
    best = W.partitionBy("start").orderBy(F.desc("end_energy"), F.desc("w"), "path")
    worst = W.partitionBy("start").orderBy("end_energy", "w", "path")
    chosen = rows.where((F.col("end_energy") > high) & (F.col("w") >= good)).withColumn("r", F.row_number().over(best)).where("r = 1")
    rejected = rows.where(((F.col("end_energy") < low) | F.col("doubt")) & (F.col("w") <= bad)).withColumn("r", F.row_number().over(worst)).where("r = 1")
    shown = lambda df, name: df.select("start", F.array_join("path", " -> ").alias(name))
    return shown(chosen, "chosen").join(shown(rejected, "rejected"), "start").where("chosen <> rejected")


def validated_lines(lines: DataFrame) -> DataFrame:
    """line_no, problem of JSON lines (line_no, value) that are not an object; blank lines are no problem."""
    rows = lines.where(F.trim("value") != "").withColumn("parsed", F.try_parse_json("value"))
    kind = F.schema_of_variant("parsed")
    problem = F.when(F.col("parsed").isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
    return rows.select("line_no", problem.alias("problem")).where(F.col("problem").isNotNull())


def chain_lines(paths: DataFrame, nodes: DataFrame, left: str = " --[", right: str = "]--> ") -> DataFrame:
    """path, line: the labels of a path (node ids) with its relations between them, 'A --[R]--> B ...'."""
    steps = paths.withColumn("_p", F.array_join("path", "\x01")).select("_p", "path", "relations", F.posexplode("path").alias("_i", "id"))
    named = steps.join(nodes.select("id", "label"), "id").select("_p", "path", "relations", F.struct("_i", F.coalesce("label", F.lit("?")).alias("label")).alias("_n"))
    whole = named.groupBy("_p").agg(F.first("path").alias("path"), F.first("relations").alias("relations"), F.array_sort(F.collect_list("_n")).alias("_n"))
    labels = F.transform("_n", lambda x: x["label"])
    tail = F.zip_with("relations", F.slice(labels, 2, F.size("path")), lambda r, to: F.concat(F.lit(left), r, F.lit(right), to))
    return whole.select("path", F.concat(labels[0], F.array_join(tail, "")).alias("line"))


def reasoning_responses(chain: Column, text: Column, label: Column) -> tuple[Column, Column]:
    """The chosen response, with its chain of thought, and the rejected one, without."""
    answer = F.coalesce(F.nullif(text, F.lit("")), F.nullif(label, F.lit("")))
    chosen = F.concat(F.lit("THOUGHT: "), F.coalesce(chain, F.lit("?")), F.lit("\nANSWER: "), F.coalesce(answer, F.lit("")))
    missing = F.concat(F.lit("I couldn't find reliable information about "), F.coalesce(label, F.lit("")), F.lit("."))
    return chosen, F.concat(F.lit("ANSWER: "), F.coalesce(answer, missing))


# A fixed value.
RELATION_TASK = "Extract the relationship between entities mentioned in the following text."


def relation_examples(nodes: DataFrame, edges: DataFrame, most: int = 300, first: int = 100) -> DataFrame:
    """ordinal, instruction, context, response for the first edges by id whose ends are known, a third of `most` at most."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("_a"), F.col("type").alias("_at"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("_b"), F.col("type").alias("_bt"))
    rows = edges.orderBy("id").limit(first).join(a, "source_id").join(b, "target_id")
    ordinal = F.row_number().over(W.orderBy("id"))  # of at most `first` rows
    context = F.concat("_a", F.lit(" ("), "_at", F.lit(") is related to "), "_b", F.lit(" ("), "_bt", F.lit(") via '"), "relation", F.lit("'."))
    response = F.to_json(F.struct(F.col("_a").alias("subject"), "relation", F.col("_b").alias("object")))
    return rows.withColumn("ordinal", ordinal).where(F.col("ordinal") <= most // 3).select("ordinal", F.lit(RELATION_TASK).alias("instruction"), context.alias("context"), response.alias("response"))


def distinct_examples(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """examples (strategy, ordinal, instruction, response ...) without later repeats of instruction and response; and counts by strategy.

    The counts (strategy, n, n_duplicates) are of all examples and of those that repeat one.
    """
    first = W.partitionBy("instruction", "response").orderBy("strategy", "ordinal")
    ranked = examples.withColumn("_r", F.row_number().over(first))
    counts = ranked.groupBy("strategy").agg(F.count("*").alias("n"), F.sum((F.col("_r") > 1).cast("long")).alias("n_duplicates"))
    return ranked.where("_r = 1").drop("_r"), counts


# Names of strategies and formats.
STRATEGIES = {"factual": "factual_qa", "reasoning": "reasoning_chains", "relations": "relation_extraction"}
FORMATS = {"both": "openai", "openai": "openai", "alpaca": "alpaca"}


def strategies(names: Column) -> Column:
    """The strategies of the names (an array), each once; all of them if none is known."""
    table = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    known = F.array_distinct(F.array_compact(F.transform(names, lambda n: F.when(n.isin(*STRATEGIES.values()), n).otherwise(F.try_element_at(table, n)))))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*[F.lit(v) for v in STRATEGIES.values()]))


def output_format(name: Column) -> Column:
    """The format of a name, openai if it is not known."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), name), F.lit("openai"))


def has_usage_signal(nodes: DataFrame) -> bool:
    """Whether any node was retrieved, without which there are no preference pairs."""
    return not nodes.where("retrieval_count > 0").limit(1).isEmpty()


REQUIRED = ("user_question", "tool_query", "simulated_result", "final_answer")


def trajectories(answers: DataFrame, tool: str, system: str) -> DataFrame:
    """worker, value: a record of a tool call from a teacher's JSON (worker, n_facts, answer), or why it is skipped."""
    get = lambda k: F.get_json_object("answer", f"$.{k}")
    missing = F.filter(F.array(*[F.when(get(k).isNull(), F.lit(k)) for k in REQUIRED]), lambda x: x.isNotNull())
    asked = F.to_json(F.struct(get("tool_query").alias("question"), F.nullif(get("tool_agent_id"), F.lit("")).alias("agent_id")))
    call = F.concat(F.lit("call_"), F.substring(F.sha2(F.concat_ws(":", F.col("worker").cast("string"), "answer").cast("binary"), 256), 1, 16))
    text = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    calls = F.array(F.struct(call.alias("id"), F.lit("function").alias("type"), F.struct(F.lit(tool).alias("name"), asked.alias("arguments")).alias("function")))
    parts = [
        F.to_json(text("system", F.lit(system))), F.to_json(text("user", get("user_question"))),
        F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), calls.alias("tool_calls")), {"ignoreNullFields": "false"}),
        F.to_json(F.struct(F.lit("tool").alias("role"), call.alias("tool_call_id"), get("simulated_result").alias("content"))), F.to_json(text("assistant", get("final_answer"))),
    ]
    record = F.concat(F.lit('{"messages":['), F.concat_ws(",", *parts), F.lit("]}"))
    skip = lambda why: F.to_json(F.struct(F.concat(F.lit("worker_"), F.col("worker").cast("string"), F.lit(f"_{why}")).alias("__skipped__")))
    value = F.when(F.col("n_facts") == 0, skip("no_facts")).when(F.try_parse_json("answer").isNull(), skip("failed")).when(F.size(missing) > 0, skip("missing_keys")).otherwise(record)
    return answers.select("worker", value.alias("value"))


def sampled_facts(nodes: DataFrame, links: DataFrame, seed: int, most: int = 8) -> DataFrame:
    """Some nodes of the two agents that one random link (source, target) joins, or of all agents without links; the same for a seed."""
    order = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *c).cast("binary"))
    link = links.orderBy(order(F.col("source"), F.col("target"))).limit(1)
    agents = link.select(F.explode(F.array("source", "target")).alias("agent_id")).distinct()
    mine = nodes if links.isEmpty() else nodes.join(agents, "agent_id", "left_semi")
    return mine.orderBy(order(F.col("id")), "id").limit(most)


def first_of_each(examples: DataFrame, keys: list[str], order: str) -> DataFrame:
    return examples.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def alpaca(examples: DataFrame) -> DataFrame:
    """value: a JSON line of instruction, input, output."""
    return examples.select(F.to_json(F.struct("instruction", F.coalesce("context", F.lit("")).alias("input"), F.col("response").alias("output"))).alias("value"))


def openai(examples: DataFrame) -> DataFrame:
    asked = F.concat_ws("\n\n", "instruction", F.nullif("context", F.lit("")))
    return examples.select(F.to_json(F.struct(F.array(message("user", asked), message("assistant", F.col("response"))).alias("messages"))).alias("value"))
