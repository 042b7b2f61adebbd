"""Trust tiers, access policies and the checks that depend on them, as joins with small dimensions and CASE ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import ladder

# Tiers from most to least trusted, sources that are local, tools by what they need, and what each tier may do.
TIERS = ["core", "inner_circle", "friend", "acquaintance", "stranger"]
LOCAL_SOURCES = ["direct", "opencode", "cli"]
LOCAL_ONLY_TOOLS = ["trust_promote", "influence_log", "injury_log", "injury_status", "boundary_add", "reindex", "personality_update", "mode_set"]
FRIEND_TOOLS = [
    "add_fact", "add_skill", "log_event", "journal_write", "contradiction_add", "preferences_add", "remember", "forget", "correct", "emotional_update",
    "workspace_add", "introspect",
]
RIGHTS = [
    "can_see_soul", "can_see_own_relationship", "can_see_others_relationships", "can_see_preferences", "can_see_boundaries", "can_see_contradictions", "can_see_injuries",
    "can_see_journal", "can_see_influence_log", "memory_persistent", "relationship_file_created", "personal_topics", "share_opinions", "can_modify_soul", "can_modify_trust",
]
#: The lowest tier (0 core to 4 stranger) that has each right.
LOWEST = [1, 3, 1, 2, 2, 1, 1, 1, 0, 3, 3, 2, 2, 0, 0]


def tier_of(name: Column) -> Column:
    """Number of a tier's name, whatever the case, spaces for underscores; unknown and null are strangers."""
    plain = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return ladder(*[(plain == t, i) for i, t in enumerate(TIERS)], otherwise=len(TIERS) - 1).cast("int")


def is_local(source: Column) -> Column:
    return F.lower(source).isin(LOCAL_SOURCES)


def effective_tier(name: Column, source: Column) -> Column:
    """From other sources everyone but core counts one tier less."""
    t = tier_of(name)
    return F.when(~is_local(source) & (t != 0), F.least(t + 1, F.lit(len(TIERS) - 1))).otherwise(t).cast("int")


def tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), tier + 1)


def policies(spark: SparkSession) -> DataFrame:
    """tier, tier_name and the rights of each tier: five rows."""
    rows = [(t, name, *[t <= low for low in LOWEST]) for t, name in enumerate(TIERS)]
    return spark.createDataFrame(rows, "tier int, tier_name string, " + ", ".join(f"{r} boolean" for r in RIGHTS))


def with_policy(people: DataFrame) -> DataFrame:
    """people (tier_name, source) with tier and the rights that go with it; the dimension has five rows."""
    tiers = people.withColumn("tier", effective_tier(F.col("tier_name"), F.col("source")))
    return tiers.join(F.broadcast(policies(people.sparkSession).drop("tier_name")), "tier")


# The sentences of the denials below.
def tool_denial(tool: Column, tier: Column, source: Column) -> Column:
    """Why a tool may not be called; null where it may."""
    return ladder(
        (is_local(source), None),
        (tool.isin(LOCAL_ONLY_TOOLS), F.concat(F.lit("Tool '"), tool, F.lit("' is not available from external sources (source: "), source, F.lit("). Use a local session for this operation."))),
        (tool.isin(FRIEND_TOOLS) & (tier > 2), F.concat(F.lit("Tool '"), tool, F.lit("' requires at least friend trust level (you are "), tier_name(tier), F.lit(")."))),
        otherwise=None,
    )


def promotion_denial(person: Column, current: Column, wanted: Column, by: Column, by_tier: Column, source: Column, core_person: str) -> Column:
    """Why a promotion is not valid; null where it is. by_tier is a stranger's for "auto"."""
    target = tier_of(wanted)
    other = (F.lower(by) != core_person) & (by_tier != 0)
    return ladder(
        (~is_local(source), "Trust promotions are not allowed from external sources."),
        (target >= current, F.concat(person, F.lit(" is already at "), tier_name(current), F.lit(" (tier "), current.cast("string"), F.lit("), cannot promote to "), wanted)),
        ((target == 0) & F.lit(not core_person), "No core person configured — core promotions are disabled"),
        ((target == 0) & other, "Only the core person can promote someone to core tier"),
        ((target == 1) & F.lit(not core_person), "No core person configured — inner_circle promotions are disabled"),
        ((target == 1) & other, "Promotion to inner_circle requires explicit approval from core tier"),
        ((target == 2) & (by == "auto") & ~current.isin(3, 4), F.concat(F.lit("Auto-promotion only works from acquaintance/stranger to friend, not from "), tier_name(current))),
        otherwise=None,
    )


def recall_denial(person: Column, what: Column, target: Column) -> Column:
    """Why a recall is not allowed, over rows that carry the rights; null where it is."""
    other = (F.coalesce(target, F.lit("")) != "") & (F.lower(target) != F.lower(person))
    no = lambda right: ~F.col(right)
    return ladder(
        ((what == "identity") & no("can_see_soul"), "Identity details are not available at your trust level."),
        ((what == "relationship") & other & no("can_see_others_relationships"), F.concat(F.lit("You don't have access to "), target, F.lit("'s relationship file."))),
        ((what == "relationship") & ~other & no("can_see_own_relationship"), "Relationship details are not available at your trust level."),
        ((what == "preferences") & no("can_see_preferences"), "Preferences are not shared at your trust level."),
        ((what == "boundaries") & no("can_see_boundaries"), "Boundary details are not available at your trust level."),
        ((what == "contradictions") & no("can_see_contradictions"), "Internal contradictions are not shared at your trust level."),
        ((what == "messages") & other & no("can_see_others_relationships"), F.concat(F.lit("You don't have access to "), target, F.lit("'s messages."))),
        otherwise=None,
    )


def visible(sections: DataFrame, people: DataFrame) -> DataFrame:
    """Each person with the sections (section, right) that their policy lets them see."""
    rights = with_policy(people).select("person", "tier", F.explode(F.create_map(*[x for r in RIGHTS for x in (F.lit(r), F.col(r))])).alias("right", "allowed"))
    return rights.where("allowed").join(sections, "right").select("person", "tier", "section")


def keeps_memory(messages: DataFrame, people: DataFrame) -> DataFrame:
    """Messages of people whose memory persists; a stranger's are not kept."""
    kept = with_policy(people).where("memory_persistent").select("person")
    return messages.join(kept, "person", "left_semi")
