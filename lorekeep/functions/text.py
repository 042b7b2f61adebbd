"""Scalar functions over text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning for skill search.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about "
    "like through after over between out against during without before under around among and but or nor not so yet both either neither each every all any few "
    "more most other some such no only own same than too very just because if when how what which who whom this that these those i me my we our you your he him "
    "his she her it its they them their"
).split()

#: Sentence ends, in the order in which they are tried, and what marks a cut.
SENTENCE_ENDS = [". ", "! ", "? ", ".\n", "!\n", "?\n"]
CUT_MARK = " [...truncated]"


def tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def trim_to_budget(text: Column, budget: Column, suffix: str = "...") -> Column:
    keep = F.greatest(F.lit(0), budget * 4 - len(suffix)).cast("int")
    return F.when(tokens(text) <= budget, text).otherwise(F.concat(F.substring(text, F.lit(1), keep), F.lit(suffix)))


def compress(text: Column, budget: Column) -> Column:
    """Text cut to a token budget, at the last sentence end where one lies in its second half."""
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), budget * 4 - len(CUT_MARK)).cast("int"))
    size = F.length(head)
    ends = []
    for end in SENTENCE_ENDS:
        back = F.locate(end[::-1], F.reverse(head))
        at = F.when(back > 0, size - back - len(end) + 1)  # from 0
        ends.append(F.when(at > F.floor(size / 2), F.substring(head, F.lit(1), at + 1)))
    return F.when(text.isNull() | (text == "") | (tokens(text) <= budget), text).otherwise(F.concat(F.coalesce(*ends, head), F.lit(CUT_MARK)))


def safe_name(name: Column, empty: str | None = None) -> Column:
    """Lower case, other than word characters and hyphens to single underscores, none at the ends."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\-]", "_")
    plain = F.btrim(F.regexp_replace(plain, "_+", "_"), F.lit("_"))
    return F.when(plain == "", F.lit(empty)).otherwise(plain)


def query_terms(text: Column) -> Column:
    """Whitespace-separated terms without double quotes; all must match."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, '"', "")), r"\s+"), lambda t: t != "")


def keywords(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 2))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def citations(text: Column, ids: Column) -> Column:
    """The ids that [n] in text names, n from 1 to the number of ids, each once, in order of n."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("long"))
    fit = F.array_sort(F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= F.size(ids)))))
    return F.transform(fit, lambda x: F.element_at(ids, x.cast("int")))


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), lambda w: w != "")


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlaps."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("long")


def derive_salience(health: Column, message: Column, response: Column) -> Column:
    size = F.length(message) + F.length(response)
    scaled = F.when(size < 50, health * 0.7).when(size > 2000, F.least(F.lit(1.0), health * 1.15)).otherwise(health)
    return clamp(scaled, 0.05, 1.0)


def parse_facets(reply: Column) -> Column:
    """Four facets from a reply that holds a flat JSON object, fenced or not; anything else gives null. Missing ones are 0.5."""
    body = F.regexp_extract(reply, r"(\{[^{}]*\})", 1)
    value = lambda k: clamp(F.coalesce(F.try_variant_get(F.try_parse_json(body), f"$.{k}", "double"), F.lit(0.5)))
    return F.when(F.try_parse_json(body).isNotNull(), F.struct(*[value(k).alias(k) for k in ("alignment", "embodiment", "clarity", "vitality")]))


def ladder(*rungs: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first rung whose condition holds."""
    start = F.when(rungs[0][0], rungs[0][1])
    return reduce(lambda c, r: c.when(*r), rungs[1:], start).otherwise(otherwise)


def within_bytes(text: Column, most: int = 100_000) -> Column:
    """Whether a text is no longer than most bytes; null is."""
    return F.coalesce(F.octet_length(text), F.lit(0)) <= most


def parse_time(text: Column, now: Column) -> Column:
    """A timestamp from ISO text; a date alone is its midnight, an empty text or null is now, and what is no time is null."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", now).otherwise(F.try_to_timestamp(F.trim(text)))


def flat_value(value: Column, is_list: bool = False) -> Column:
    """A metadata value as text: a list's members joined, null empty."""
    return F.coalesce(F.array_join(value, ", ") if is_list else value.cast("string"), F.lit(""))


#: Levels of trust as the semantic store counts them, 0 for a name that it does not know.
TRUST_LEVELS = {"core": 5, "inner_circle": 4, "friend": 3, "acquaintance": 2, "stranger": 1}


def trust_level(name: Column) -> Column:
    return ladder(*[(name == k, v) for k, v in TRUST_LEVELS.items()], otherwise=0)


#: Kinds of updates that an extraction may hold, and the fields of each.
EXTRACTED = {"relationship_updates": ["person", "fact", "section"], "preference_updates": ["item", "type", "reason"], "trust_changes": ["person", "direction", "reason"], "skills_learned": ["skill", "content"]}


def _fields(names: list[str]):
    return lambda x: F.struct(*[F.try_variant_get(x, f"$.{n}", "string").alias(n) for n in names])


def parse_extraction(reply: Column) -> Column:
    """A struct with nothing_new and an array of structs for each kind of update, from a reply that holds a JSON object, fenced or not.

    The object reaches from the first brace to the last. What is no list counts as empty, members that are no objects are
    left out, and a field that is not there is null. Without an object, or without any update, there is nothing new.
    """
    value = F.try_parse_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    lists = {}
    for kind, fields in EXTRACTED.items():
        rows = F.coalesce(F.try_variant_get(value, f"$.{kind}", "array<variant>"), F.array().cast("array<variant>"))
        objects = F.filter(rows, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        lists[kind] = F.transform(objects, _fields(fields))
    none = reduce(lambda a, b: a & b, [F.size(v) == 0 for v in lists.values()])
    nothing = none | F.coalesce(F.try_variant_get(value, "$.nothing_new", "boolean"), F.lit(False))
    return F.struct(nothing.alias("nothing_new"), *[v.alias(k) for k, v in lists.items()])


def extracted_updates(replies: DataFrame) -> DataFrame:
    """(person, type, target, value, note) for each update that the replies (person, reply) ask for and that is complete.

    A fact needs a text and is about the person spoken with where none is named; a preference needs an item and is a like
    without a type; a trust signal needs direction and reason; a skill needs a name and a content.
    """
    rows = replies.select("person", parse_extraction(F.col("reply")).alias("x")).where("not x.nothing_new")
    line = lambda kind, target, value, note: F.struct(F.lit(kind).alias("type"), target.alias("target"), value.alias("value"), note.alias("note"))
    text = lambda c: F.coalesce(c, F.lit(""))
    own = F.col("person")
    found = F.concat(
        F.transform("x.relationship_updates", lambda u: line("relationship", F.coalesce(u["person"], own), text(u["fact"]), F.coalesce(u["section"], F.lit("What I Know")))),
        F.transform("x.preference_updates", lambda u: line("preference", F.coalesce(u["type"], F.lit("like")), text(u["item"]), text(u["reason"]))),
        F.transform("x.trust_changes", lambda u: line("trust_signal", F.coalesce(u["person"], own), text(u["direction"]), text(u["reason"]))),
        F.transform("x.skills_learned", lambda u: line("skill", text(u["skill"]), text(u["content"]), F.lit(""))),
    )
    rows = rows.select("person", F.explode(found).alias("u")).select("person", "u.*")
    complete = (F.col("value") != "") & ((F.col("type") != "trust_signal") | (F.col("note") != "")) & ((F.col("type") != "skill") | (F.col("target") != ""))
    return rows.where(complete)
