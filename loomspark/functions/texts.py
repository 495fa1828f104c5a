"""Text expressions: keyword queries, normalisation, answer metrics, redaction, field extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^\p{L}\p{N}_]+"

# Node types and their aliases.
NODE_TYPES = (
    "PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "PRODUCT", "TECHNOLOGY", "DATE", "METRIC", "DOCUMENT", "TEAM", "ROLE", "PROJECT", "OTHER",
)
TYPE_ALIASES = {
    "COMPANY": "ORGANIZATION", "STARTUP": "ORGANIZATION", "CORPORATION": "ORGANIZATION", "FIRM": "ORGANIZATION", "ENTERPRISE": "ORGANIZATION",
    "INSTITUTION": "ORGANIZATION", "UNIVERSITY": "ORGANIZATION", "SCHOOL": "ORGANIZATION", "GOVERNMENT": "ORGANIZATION", "AGENCY": "ORGANIZATION",
    "NGO": "ORGANIZATION", "GROUP": "ORGANIZATION",
    "COUNTRY": "LOCATION", "CITY": "LOCATION", "PLACE": "LOCATION", "REGION": "LOCATION", "STATE": "LOCATION", "CONTINENT": "LOCATION",
    "BUILDING": "LOCATION", "VENUE": "LOCATION",
    "TOOL": "TECHNOLOGY", "FRAMEWORK": "TECHNOLOGY", "SOFTWARE": "TECHNOLOGY", "LIBRARY": "TECHNOLOGY", "PLATFORM": "TECHNOLOGY",
    "LANGUAGE": "TECHNOLOGY", "PROTOCOL": "TECHNOLOGY", "ALGORITHM": "TECHNOLOGY", "MODEL": "TECHNOLOGY", "SYSTEM": "TECHNOLOGY",
    "AWARD": "CONCEPT", "THEORY": "CONCEPT", "IDEA": "CONCEPT", "FIELD": "CONCEPT", "DOMAIN": "CONCEPT", "DISCIPLINE": "CONCEPT",
    "TOPIC": "CONCEPT", "SUBJECT": "CONCEPT",
    "YEAR": "DATE", "MONTH": "DATE", "TIME": "DATE", "PERIOD": "DATE", "ERA": "DATE", "DECADE": "DATE",
    "AMOUNT": "METRIC", "PERCENTAGE": "METRIC", "REVENUE": "METRIC", "FUNDING": "METRIC", "VALUATION": "METRIC", "NUMBER": "METRIC",
    "QUANTITY": "METRIC", "STATISTIC": "METRIC",
    "REPORT": "DOCUMENT", "PAPER": "DOCUMENT", "PUBLICATION": "DOCUMENT", "BOOK": "DOCUMENT", "ARTICLE": "DOCUMENT", "STUDY": "DOCUMENT",
    "RESEARCH": "DOCUMENT", "PATENT": "DOCUMENT",
}
# Relations and their aliases.
RELATION_TYPES = (
    "WORKS_AT", "IS_CEO_OF", "LEADS", "PART_OF", "LOCATED_IN", "CAUSED_BY", "DEPENDS_ON", "CREATED", "APPROVED", "BLOCKED_BY", "REPORTS_TO",
    "COLLABORATES_WITH", "USES", "FUNDED_BY", "ACQUIRED", "COMPETING_WITH", "PRECEDED_BY", "FOLLOWED_BY", "CONTAINS", "RELATED_TO", "FOUNDED_BY",
    "FOUNDED", "CEO_OF",
)
RELATION_ALIASES = {
    "WORKED_AT": "WORKS_AT", "EMPLOYED_BY": "WORKS_AT", "EMPLOYEE_OF": "WORKS_AT", "WORKS_FOR": "WORKS_AT", "JOINED": "WORKS_AT",
    "LED": "LEADS", "LEADING": "LEADS", "HEADS": "LEADS", "HEADED": "LEADS", "MANAGES": "LEADS", "MANAGED": "LEADS",
    "REPORTS": "REPORTS_TO", "REPORTED_TO": "REPORTS_TO",
    "IS_CEO_OF": "CEO_OF", "WAS_CEO_OF": "CEO_OF", "CHIEF_EXECUTIVE_OF": "CEO_OF",
    "WAS_FOUNDED_BY": "FOUNDED_BY", "CO_FOUNDED_BY": "FOUNDED_BY", "FOUNDS": "FOUNDED", "CO_FOUNDED": "FOUNDED", "ESTABLISHED": "FOUNDED",
    "BUILT": "CREATED", "DEVELOPED": "CREATED", "INVENTED": "CREATED", "DESIGNED": "CREATED", "WROTE": "CREATED", "AUTHORED": "CREATED",
    "MADE": "CREATED", "PRODUCED": "CREATED", "RELEASED": "CREATED",
    "COLLABORATED_WITH": "COLLABORATES_WITH", "PARTNERED_WITH": "COLLABORATES_WITH", "WORKED_WITH": "COLLABORATES_WITH", "ALLIED_WITH": "COLLABORATES_WITH",
    "USED": "USES", "USING": "USES", "UTILIZES": "USES",
    "RELIES_ON": "DEPENDS_ON", "DEPENDS": "DEPENDS_ON", "REQUIRES": "DEPENDS_ON",
    "HAS": "CONTAINS", "INCLUDES": "CONTAINS", "INCLUDED": "CONTAINS", "COMPRISES": "CONTAINS",
    "MEMBER_OF": "PART_OF", "BELONGS_TO": "PART_OF", "BRANCH_OF": "PART_OF", "DIVISION_OF": "PART_OF",
    "LOCATED": "LOCATED_IN", "BASED_IN": "LOCATED_IN", "HEADQUARTERED_IN": "LOCATED_IN", "SITUATED_IN": "LOCATED_IN", "IS_IN": "LOCATED_IN",
    "CAUSED": "CAUSED_BY", "RESULTED_FROM": "CAUSED_BY", "DUE_TO": "CAUSED_BY",
    "BLOCKED": "BLOCKED_BY", "BLOCKS": "BLOCKED_BY", "PREVENTED_BY": "BLOCKED_BY",
    "APPROVED_BY": "APPROVED", "ENDORSED": "APPROVED", "RATIFIED": "APPROVED",
    "FUNDED": "FUNDED_BY", "INVESTED_IN": "FUNDED_BY", "BACKED_BY": "FUNDED_BY",
    "ACQUIRED_BY": "ACQUIRED", "BOUGHT": "ACQUIRED", "PURCHASED": "ACQUIRED",
    "COMPETES_WITH": "COMPETING_WITH", "COMPETED_WITH": "COMPETING_WITH", "RIVAL_OF": "COMPETING_WITH",
    "SUCCEEDED": "PRECEDED_BY", "REPLACED": "PRECEDED_BY", "CAME_AFTER": "PRECEDED_BY",
    "FOLLOWED": "FOLLOWED_BY", "CAME_BEFORE": "FOLLOWED_BY", "SUCCEEDED_BY": "FOLLOWED_BY",
    "RELATED": "RELATED_TO", "LINKED_TO": "RELATED_TO", "CONNECTED_TO": "RELATED_TO", "ASSOCIATED_WITH": "RELATED_TO", "TIED_TO": "RELATED_TO",
    "REFERENCES": "RELATED_TO", "MENTIONS": "RELATED_TO",
}
COPULAS = r"^(IS|WAS|ARE|WERE|BEEN|BE)_"
# Words that a text search leaves out, and phrases of pages that only scripts fill.
STOP_WORDS = (
    "the", "and", "for", "with", "what", "where", "when", "which", "who", "does", "did", "that", "this", "from", "into", "are", "was", "were", "has", "have", "had",
    "about", "between", "their", "there",
)
SHELL_MARKS = (
    "your browser does not support", "please enable javascript", "javascript is required", "javascript must be enabled", "please use a modern browser",
    "does not support es modules", "you need to enable javascript to run this app",
)
# How a question for a short span begins, and how a refusal does.
FACTOID = r"^\s*(who|whom|whose|when|where|which|what|how (much|many|long|old|fast|big)|name the|list the)\b"
REFUSALS = ("i don't", "the data", "no information", "not ", "unknown")


def keywords(text: Column, most: int = 10) -> Column:
    """The first words of three letters or more, in lower case, as often as they stand there."""
    return F.slice(F.filter(F.split(F.lower(text), NOT_WORD), lambda w: F.length(w) >= 3), 1, most)


def prefix_query(text: Column, most: int = 10) -> Column:
    """'word* OR word* ...' of the keywords; null without any."""
    return F.nullif(F.array_join(F.transform(keywords(text, most), lambda w: F.concat(w, F.lit("*"))), " OR "), F.lit(""))


def search_words(text: Column, most: int = 10) -> Column:
    """Words of a question without stop words, short ones and punctuation around them; the first 40 characters if none is left."""
    low = F.lower(text)
    kept = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    bare = F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$""", "")), lambda w: w != "")
    return F.when(F.size(bare) > 0, F.slice(bare, 1, most)).otherwise(F.array(F.substring(low, 1, 40)))


def _looked_up(value: Column, valid: tuple[str, ...], aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(value.isin(*valid), value).otherwise(F.element_at(table, value))


def node_type(raw: Column) -> Column:
    """A known type, by name or alias; else OTHER."""
    return F.coalesce(_looked_up(F.upper(F.trim(raw)), NODE_TYPES, TYPE_ALIASES), F.lit("OTHER"))


def relation_type(raw: Column) -> Column:
    """A known relation, by name or alias, if need be without a leading copula; else RELATED_TO."""
    name = F.upper(F.trim(raw))
    bare = F.regexp_replace(name, COPULAS, "")
    return F.coalesce(_looked_up(name, RELATION_TYPES, RELATION_ALIASES), _looked_up(bare, RELATION_TYPES, RELATION_ALIASES), F.lit("RELATED_TO"))


def answer_text(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, white space squeezed."""
    bare = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(answer_text(text), " "), lambda w: w != "")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of predicted tokens that gold has, each as often as it is predicted; two empty answers are equal."""
    p, g = answer_tokens(predicted), answer_tokens(gold)
    common = F.size(F.filter(p, lambda t: F.array_contains(g, t)))
    precision, recall = common / F.size(p), common / F.size(g)
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).when(common == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def redacted(text: Column, most: int = 2048, shown: str = "[REDACTED]") -> Column:
    """An error text without credentials: bearer tokens, keys, named secrets up to the next white space, and logins in addresses."""
    for pattern in (  # fixed values: what is taken for a credential
        r"(?i)Bearer\s+\S+", r"\bsk-[A-Za-z0-9_\-]{8,}\b",
        r"(?i)(password|passwd|secret|token|api[_-]?key|access[_-]?key|refresh[_-]?token|client[_-]?secret)\s*[=:]\s*\S+", r"://[^:/\s]+:[^@\s]+@",
    ):
        text = F.regexp_replace(text, pattern, shown)
    return F.substring(text, 1, most)


def json_object_text(text: Column) -> Column:
    """The outermost {...} of a model's answer, without code fences; null if there is none."""
    bare = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def json_array_text(text: Column) -> Column:
    """The outermost [...], or an empty array."""
    bare = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")), F.lit("[]"))


def json_objects(text: Column) -> Column:
    """The objects of the outermost [...], as JSON texts; other members are left out, and a text that is no array has none."""
    found = F.try_parse_json(json_array_text(text))
    members = F.try_variant_get(found, "$", "array<variant>")
    objects = F.filter(members, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.coalesce(F.transform(objects, lambda v: F.to_json(v)), F.array().cast("array<string>"))


def sub_questions(answer: Column, question: Column, most: int = 5) -> Column:
    """The strings of a JSON array, trimmed, each once in any case, the first `most`; the question itself if there are none."""
    found = F.try_parse_json(F.regexp_replace(F.trim(answer), r"^```(json)?|```$", ""))
    members = F.try_variant_get(found, "$", "array<variant>")
    strings = F.transform(F.filter(members, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.trim(F.variant_get(v, "$", "string")))
    strings = F.filter(strings, lambda s: s != "")
    low = F.transform(strings, F.lower)
    once = F.filter(strings, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    return F.when(F.size(once) > 0, F.slice(once, 1, most)).otherwise(F.array(question))


def is_script_shell(text: Column, marks: tuple[str, ...] = SHELL_MARKS) -> Column:
    """Short text of a page that only scripts would fill."""
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(F.lower(text), F.lit(m))
    return (F.length(text) > 0) & (F.length(text) <= 400) & found


def wants_span(question: Column, answer: Column) -> Column:
    """Whether a short span is to be cut out of the answer: it is longer than four words, no refusal, and the question asks for a fact."""
    a = F.trim(answer)
    refused = F.lit(False)
    for r in REFUSALS:
        refused = refused | F.startswith(F.lower(a), F.lit(r))
    return (a != "") & (F.size(F.split(a, r"\s+")) > 4) & F.lower(F.trim(question)).rlike(FACTOID) & ~refused


def accepted_span(span: Column, most: int = 200) -> Column:
    """The span, or null if it is empty, NONE or too long."""
    s = F.trim(span)
    return F.when((s != "") & (F.upper(s) != "NONE") & (F.length(s) <= most), s)


def holds_all(text: Column, needles: Column) -> Column:
    """Whether a text that is not blank holds every needle, in any case."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & F.forall(needles, lambda n: F.contains(F.lower(text), F.lower(n)))


def retrieval_hit(retrieved: Column, expected: Column, titles: Column) -> Column:
    """1 if the retrieved text holds the answer, else 0. For a yes, a no or an answer of under three letters the share of titles that it holds, null without titles."""
    low, answer = F.lower(F.coalesce(retrieved, F.lit(""))), F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    named = F.size(F.filter(titles, lambda t: (F.trim(t) != "") & F.contains(low, F.lower(t))))
    subject = F.when(F.size(titles) > 0, F.when(low == "", F.lit(0.0)).otherwise(named / F.size(titles)))
    return F.when((F.length(answer) >= 3) & ~answer.isin("yes", "no"), (F.contains(low, answer) & (low != "")).cast("double")).otherwise(subject)


def cut(text: Column, most: int = 300, mark: str = "...") -> Column:
    """A text of at most so many characters, with a mark if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def common_run(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, every = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _common_runs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_run(list(x), list(y)) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int64")


def lcs_f(predicted: Column, gold: Column, beta: float = 1.0) -> Column:
    """ROUGE-L: F of the longest common subsequence of tokens."""
    p, g = answer_tokens(predicted), answer_tokens(gold)
    longest = _common_runs(p, g)
    precision, recall = longest / F.size(p), longest / F.size(g)
    both = F.when(longest > 0, (1 + beta**2) * precision * recall / (recall + beta**2 * precision)).otherwise(F.lit(0.0))
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).otherwise(both)
