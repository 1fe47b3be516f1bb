"""The policy table: validation, upserts, removals, versions, hit rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dialect import to_java
from ..functions.matching import exploded
from ..functions.policy import hit_places, policy_masks, policy_records
from ..functions.rules import ACTIONS, POLICIES, POLICY_NEEDS, Policy
from .config import next_start
from .intervals import interval_join
from .rule_index import pattern_hits

SCHEMA = "ord long, name string, pattern string, action string, description string"


def policy(name: str, pattern: str, action: str = "block", description: str = "") -> Policy:
    """A checked policy; the pattern is looked at before the action."""
    to_java(pattern)
    if action not in ACTIONS:
        raise ValueError(f"invalid action: {action} (use block/warn/redact)")
    return Policy(name, pattern, action, description, POLICY_NEEDS.get(pattern, ()))


def add_policy(policies: Sequence[Policy], new: Policy) -> list[Policy]:
    """Replaces a policy of the same name and puts the new one at the end."""
    return [p for p in policies if p.name != new.name] + [policy(new.name, new.pattern, new.action, new.description)]


def remove_policy(policies: Sequence[Policy], name: str) -> tuple[list[Policy], bool]:
    left = [p for p in policies if p.name != name]
    return left, len(left) < len(policies)


def policy_table(spark: SparkSession, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The policies as rows, the defaults numbered below every later change."""
    return spark.createDataFrame(
        [(i - len(policies), p.name, p.pattern, p.action, p.description) for i, p in enumerate(policies)], SCHEMA)


@F.pandas_udf(T.StringType())
def java_pattern(patterns: pd.Series) -> pd.Series:
    """Java form of each pattern, null where it is not a valid pattern."""
    def form(pattern):
        try:
            return None if pattern is None else to_java(pattern)
        except ValueError:
            return None
    known = {p: form(p) for p in patterns.unique()}
    return patterns.map(known)


def change_effect(changes: DataFrame) -> DataFrame:
    """Changes (seq, op, name, pattern, action, description) that take effect:
    removals, and additions with a valid pattern and action."""
    filled = changes.select(
        "seq", "op", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("action", F.lit("block")).alias("action"),
        F.coalesce("description", F.lit("")).alias("description"))
    additions = filled.where((F.col("op") == "add") & F.col("action").isin(*ACTIONS))
    return (filled.where(F.col("op") == "remove").withColumn("java", F.lit(None).cast("string"))
            .unionByName(additions.withColumn("java", java_pattern("pattern")).where(F.col("java").isNotNull())))


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The policy table after all changes, as one aggregation by name: the last
    effective change of a name decides, and an addition is ordered by it."""
    latest = (
        table.withColumn("seq", F.col("ord")).withColumn("op", F.lit("add"))
        .select("seq", "op", "name", "pattern", "action", "description")
        .unionByName(change_effect(changes).drop("java"))
        .groupBy("name").agg(F.max_by(F.struct("seq", "op", "pattern", "action", "description"), "seq").alias("c"))
    )
    return latest.where("c.op = 'add'").select(
        F.col("c.seq").alias("ord"), "name", "c.pattern", "c.action", "c.description")


def policy_versions(table: DataFrame, changes: DataFrame) -> DataFrame:
    """(from_seq, to_seq, name, pattern, java, action, description) of every
    policy version; a change holds for later calls, until the next effective
    change of its name.  Order by ``from_seq`` is policy order."""
    defaults = (table.withColumn("java", java_pattern("pattern")).withColumn("op", F.lit("add"))
                .withColumnRenamed("ord", "seq"))
    steps = defaults.unionByName(change_effect(changes)).withColumn("from_seq", F.col("seq") + 1)
    return (next_start(steps, keys=("name",)).where("op = 'add'")
            .select("from_seq", "to_seq", "name", "pattern", "java", "action", "description"))


def load_policies(table: DataFrame) -> list[Policy]:
    """The table's policies in order, to be written into the plan."""
    return [policy(r["name"], r["pattern"], r["action"], r["description"]) for r in table.orderBy("ord").collect()]


def as_literals(table: DataFrame) -> list[Policy]:
    """Every distinct valid pattern of a rule table as a policy of that name.
    Rules are control data, read by the driver however many texts there are."""
    valid = table.select("pattern").distinct().where(java_pattern("pattern").isNotNull())
    return [Policy(p, p, "block", "", POLICY_NEEDS.get(p, ())) for p in sorted(r["pattern"] for r in valid.collect())]


def policy_hits(df: DataFrame, *ids: str, text: str = "text", policies: Sequence[Policy] = POLICIES,
                names: Column | None = None) -> DataFrame:
    """One row (ids, position, policy, action, description) per policy that
    fires.  Patterns are literals of the plan: one scan, no join, no shuffle."""
    masks = df.withColumn("_masks", policy_masks(F.col(text), policies, names))
    rows = exploded(masks, [*ids], policy_records(F.col("_masks"), policies), "p", "position")
    return rows.select(*ids, "position", "p.policy", "p.action", "p.description")


def policy_hits_from_table(df: DataFrame, table: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """The same hits (ids, policy, action, description) with the policies kept
    as data, however many there are: texts meet patterns through an index of
    literals, and what joins the table, by pattern, is hits."""
    rules = table.select("pattern", F.col("name").alias("policy"), "action", "description")
    return pattern_hits(df, table, *ids, text=text).join(rules, "pattern").select(*ids, "policy", "action", "description")


def hits_in_force(rows: DataFrame, versions: DataFrame, known: Sequence[Policy], *, seq: str = "seq", masks: str = "_masks",
                  names: str = "_names") -> DataFrame:
    """(seq, hits): for every row with a hit, the policies that were in force at
    its unique *seq* and fire, in policy order.

    *masks* are the hits of the patterns *known*, *names* the policies asked for
    (null: all).  Hits meet the versions of their pattern, so what is joined
    grows with hits and changes; no set of policies is copied per change.
    """
    places = versions.sparkSession.createDataFrame([(p.pattern, i) for i, p in enumerate(known)], "pattern string, _at int")
    dated = versions.join(F.broadcast(places), "pattern").select(       # patterns are literals of the plan anyway
        "from_seq", "to_seq", "_at", F.col("from_seq").alias("version"), "name", "action", "description")
    fired = rows.select(F.col(seq).alias("seq"), F.col(names).alias("_asked"), F.explode(hit_places(F.col(masks), len(known))).alias("_at"))
    held = interval_join(fired, "seq", dated, how="inner", on=("_at",)).where(F.col("_asked").isNull() | F.array_contains("_asked", F.col("name")))
    record = F.struct("version", F.col("name").alias("policy"), "action", "description")
    return held.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(record)), lambda r: r.dropFields("version")).alias("hits"))


def version_hits(df: DataFrame, versions: DataFrame, *ids: str, seq: str = "seq", text: str = "text",
                 names: str | None = None) -> DataFrame:
    """Hits of policy versions in force at each row's *seq*, the versions kept
    as data: (ids, from_seq, policy, action, description).  Patterns meet the
    texts once each, and only hits meet the versions."""
    rows = df.withColumn("_seq_of", F.col(seq)).withColumn("_names", F.lit(None).cast("array<string>") if names is None else F.col(names))
    hits = pattern_hits(rows, versions, *ids, "_seq_of", "_names", text=text)
    kept = versions.select("from_seq", "to_seq", F.col("from_seq").alias("_version"), "pattern", F.col("name").alias("_policy"),
                           F.col("action").alias("_action"), F.col("description").alias("_description"))
    held = interval_join(hits, "_seq_of", kept, how="inner", on=("pattern",))
    return held.where(F.col("_names").isNull() | F.array_contains("_names", F.col("_policy"))).select(
        *ids, F.col("_version").alias("from_seq"), F.col("_policy").alias("policy"), F.col("_action").alias("action"),
        F.col("_description").alias("description"))
