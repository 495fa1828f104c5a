"""Property bags: JSON objects in a text column, and the texts that are made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.texts import cut

# Keys that a context line does not show among the others.
SKIPPED = (
    "description", "source_text", "temporal", "aliases", "confidence", "source", "energy_level", "retrieval_count", "last_activation", "utility_weight",
    "synaptic_score", "avg_weight", "embedding",
)
BLANK = r"^\s*$"


def field(properties: Column, name: str) -> Column:
    """A text of the bag; null if it is missing or blank."""
    value = F.get_json_object(properties, f"$.{name}")
    return F.when(~value.rlike(BLANK), value)


def bag(properties: Column) -> Column:
    """The bag as a map of texts, in its order; lists and objects stay JSON. Null for what is no object."""
    return F.from_json(properties, "map<string,string>")


def flattened(properties: Column) -> Column:
    """The bag without its nulls, nested values as JSON texts; an empty map for what is no object."""
    return F.coalesce(F.map_filter(bag(properties), lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def merged(old: Column, new: Column) -> Column:
    """One bag of both as JSON text, the values of new first in rank; numbers, booleans, lists, objects and nulls stay what they are.

    What is no object counts as an empty one.
    """
    of = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    a, b = of(old), of(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def shown(properties: Column, most: int = 6, chars: int = 120) -> Column:
    """'key: value' of the first scalars that are not skipped, each value cut."""
    entries = F.filter(F.map_entries(flattened(properties)), lambda e: ~e["key"].isin(*SKIPPED) & ~e["value"].rlike(BLANK) & ~e["value"].rlike(r"^\s*[\[{]"))
    return F.transform(F.slice(entries, 1, most), lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, chars)))


def promoted(description: Column, source_text: Column, properties: Column) -> tuple[Column, Column]:
    """The columns description and source_text, from the bag where they are missing or empty."""
    own = lambda c, name: F.coalesce(F.nullif(c, F.lit("")), F.nullif(F.get_json_object(properties, f"$.{name}"), F.lit("")))
    return own(description, "description"), own(source_text, "source_text")


def best_text(properties: Column, most: int = 500) -> Column:
    """The description, source text, summary or first text of the bag that is not blank, trimmed and cut; of no JSON the first 300 characters."""
    values = F.map_values(F.map_filter(flattened(properties), lambda k, v: ~v.rlike(BLANK) & ~v.rlike(r"^\s*([\[{]|-?[0-9.]+\s*$|true\s*$|false\s*$)")))
    found = F.coalesce(*[F.trim(field(properties, n)) for n in ("description", "source_text", "summary")], F.trim(F.try_element_at(values, F.lit(1))))
    return F.coalesce(F.when(F.try_parse_json(properties).isNull(), F.substring(properties, 1, 300)).otherwise(F.substring(found, 1, most)), F.lit(""))


def embedding_text(type_: Column, label: Column, description: Column, source_text: Column) -> Column:
    """What is embedded of a node: a fact's description; else label, description and source text, unless that repeats it."""
    label, about = F.coalesce(label, F.lit("")), F.nullif(description, F.lit(""))
    said = F.when((source_text != "") & (about.isNull() | (source_text != about)), F.concat(F.lit(" — "), F.substring(source_text, 1, 300)))
    whole = F.concat(label, F.coalesce(F.concat(F.lit(": "), about), F.lit("")), F.coalesce(said, F.lit("")))
    return F.when((type_ == "FACT") & about.isNotNull(), about).otherwise(whole)


def context_line(agent: Column, label: Column, type_: Column, description: Column, source_text: Column, properties: Column, weight: Column | None = None) -> Column:
    """A line of context for a record; with a weight, records of 1.5 or more say so in front."""
    about, said = promoted(description, source_text, properties)
    said = F.when(said != F.coalesce(about, F.lit("")), cut(said))
    when = F.concat(F.lit("date: "), F.trim(field(properties, "temporal")))
    parts = F.concat(F.array_compact(F.array(about, said, when)), shown(properties))
    body = F.concat(F.coalesce(label, F.lit("")), F.lit(" ("), F.coalesce(type_, F.lit("")), F.lit(")"), F.when(F.size(parts) > 0, F.concat(F.lit(": "), F.array_join(parts, "; "))).otherwise(F.lit("")))
    line = F.concat(F.lit("[Source: Agent "), F.coalesce(agent, F.lit("unknown")), F.lit("] - "), body)
    return line if weight is None else F.when(weight >= 1.5, F.concat(F.format_string("[Strength: %.1f] ", weight), line)).otherwise(line)


def swarm_line(agent: Column, label: Column, type_: Column, description: Column, properties: Column) -> Column:
    """A line of context for a record of several tenants: description, or one of the bag's texts, cut to 300 characters."""
    values = F.map_values(F.map_filter(flattened(properties), lambda k, v: (F.length(v) > 5) & ~v.rlike(r"^\s*([\[{]|-?[0-9.]+\s*$)")))
    about = F.coalesce(F.nullif(description, F.lit("")), *[F.nullif(F.get_json_object(properties, f"$.{n}"), F.lit("")) for n in ("description", "summary")], F.substring(F.try_element_at(values, F.lit(1)), 1, 200))
    head = F.concat(F.lit("[Agent: "), F.coalesce(agent, F.lit("unknown")), F.lit("] "), F.coalesce(label, F.lit("")), F.lit(" ("), F.coalesce(type_, F.lit("")), F.lit(")"))
    return F.concat(head, F.coalesce(F.concat(F.lit(": "), F.substring(about, 1, 300)), F.lit("")))
