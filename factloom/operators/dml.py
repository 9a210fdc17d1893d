"""Merges and updates as pure functions of before and change; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.facts import first_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key; `keep_if_null` columns keep the old value where the new one is null."""
    changed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(changed, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        if c in keep_if_null:
            return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
        return F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one for each key."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def guarded_update(old: DataFrame, change: DataFrame, keys: list[str], guard: Column, sets: dict[str, Column]) -> DataFrame:
    """Rows whose key is in change and for which guard holds get new values; sets may use change's columns."""
    extra = [c for c in change.columns if c not in keys]
    both = old.join(change.dropDuplicates(keys).withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    return both.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in old.columns if c not in extra])


def replaced_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """new's rows in place of all of old's in the scopes that new names."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new.select(*old.columns))


def pruned(old: DataFrame, condition: Column) -> DataFrame:
    return old.filter(~F.coalesce(condition, F.lit(False)))


def planned_changes(old: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What applying would do: the keys with insert, update or delete. Empty when nothing would change."""
    row = lambda df, name: df.select(*keys, F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias(name))
    both = row(old, "_before").join(row(after, "_after"), keys, "full_outer")
    action = F.when(F.col("_before").isNull(), "insert").when(F.col("_after").isNull(), "delete").when(F.col("_before") != F.col("_after"), "update")
    return both.withColumn("action", action).filter("action is not null").select(*keys, "action")


def latest_events(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key."""
    return first_per(events, keys, order)


def accepted_names(ledger: DataFrame, keys: list[str], event: str = "id") -> DataFrame:
    """The standing name of each key in a ledger of propose, accept and clear events: the last accepted one since the last clear."""
    decided = ledger.filter(F.col("status").isin("accepted", "cleared"))
    return latest_events(decided, keys, [F.col(event).desc()]).filter("status = 'accepted'")
