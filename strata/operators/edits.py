"""Optimistic row edits and keyed change feeds.

Edits come in long form, one row per changed cell: ``edit_id``, the key columns, ``column``,
``old_value`` and ``new_value`` as text. All cells of one ``edit_id`` apply or none does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.values import value_text
from strata.operators.spread import sized_parts
from strata.session import StrataError, cut, is_empty


def edit_normalize(edits: DataFrame, editable: list[str], keys: list[str] | None = None) -> DataFrame:
    """Keep changes on editable columns whose old and new value differ.

    Names count without regard to case, and key columns are never editable.
    """
    barred = {k.lower() for k in keys or []}
    names = [e.lower() for e in editable if e.lower() not in barred]
    return edits.where(
        F.lower("column").isin(names) & ~F.col("old_value").eqNullSafe(F.col("new_value"))
    )


def resolve_names(wanted: list[str], columns: list[str], required: bool) -> list[str]:
    """Column names as the table spells them; a missing required one is an error."""
    by_lower = {c.lower(): c for c in columns}
    found = []
    for name in wanted:
        if name.lower() in by_lower:
            found.append(by_lower[name.lower()])
        elif required:
            raise StrataError(f"key column missing from the table: {name}")
    return list(dict.fromkeys(found))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _checked_edits(edits: DataFrame, schema: T.StructType, keys: list[str], editable: list[str]) -> DataFrame:
    """Normalized edits with ``_bad``: null key, unreadable value, or a cell edited twice.

    `edits` must already spell the key columns as the table does. They are kept in the shared
    folder, since the steps that follow read them several times.
    """
    norm = cut(edit_normalize(edits, editable, keys).withColumn("column", F.lower("column")), "edits")
    types = {c.lower(): schema[c].dataType for c in editable}

    def unreadable(name: str, value: str) -> Column:
        v = F.col(value)
        return (F.col("column") == name) & v.isNotNull() & v.try_cast(types[name]).isNull()

    broken = _any([F.col(k).isNull() for k in keys])
    broken = broken | _any([unreadable(n, v) for n in types for v in ("old_value", "new_value")])
    twice = norm.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    flagged = norm.join(twice.withColumn("_twice", F.lit(True)), [*keys, "column"], "left")
    return cut(flagged.withColumn("_bad", broken | F.coalesce("_twice", F.lit(False))).drop("_twice"), "edits")


def _bad_edits(checked: DataFrame) -> DataFrame:
    return checked.groupBy("edit_id").agg(F.max("_bad").alias("_bad"))


def _wide_edits(checked: DataFrame, schema: T.StructType, keys: list[str], editable: list[str]) -> DataFrame:
    """One row per key with, for each editable column, the edit of that cell or null.

    A cell has one edit at most here, so the state of the aggregation is one struct per column.
    """
    good = checked.join(_bad_edits(checked).where(~F.col("_bad")).select("edit_id"), "edit_id", "left_semi")

    def cell(name: str) -> Column:
        dtype = schema[name].dataType
        entry = F.struct(
            F.col("edit_id").alias("edit_id"),
            F.col("old_value").try_cast(dtype).alias("old"),
            F.col("new_value").try_cast(dtype).alias("new"),
        )
        return F.max(F.when(F.col("column") == name.lower(), entry)).alias(f"_e_{name}")

    return good.groupBy(*keys).agg(*[cell(c) for c in editable])


def _missed(editable: list[str]) -> Column:
    """Ids of the edits that do not fit a base row, because the row is gone or a cell has changed since."""
    misses = [
        F.when(
            F.col(f"_e_{c}").isNotNull() & (F.col("_there").isNull() | ~F.col(f"`{c}`").eqNullSafe(F.col(f"_e_{c}.old"))),
            F.col(f"_e_{c}.edit_id"),
        )
        for c in editable
    ]
    return F.array_compact(F.array(*misses))


def _prepare(base: DataFrame, edits: DataFrame, keys: list[str], editable: list[str]):
    keys = resolve_names(keys, base.columns, True)
    editable = [c for c in resolve_names(editable, base.columns, False) if c not in keys]
    named = {c.lower(): c for c in edits.columns}
    for k in keys:
        if k.lower() not in named:
            raise StrataError(f"key column missing from the edits: {k}")
        edits = edits.withColumnRenamed(named[k.lower()], k)
    checked = _checked_edits(edits, base.schema, keys, editable)
    return keys, editable, checked


def _refused(base: DataFrame, wide: DataFrame, keys: list[str], editable: list[str]) -> DataFrame:
    """``edit_id`` of the edits that miss under some key, whatever their other keys say.

    Where a key has several rows, an edit of it hits if one of them fits.
    """
    probe = wide.join(base.select(*keys, *editable, F.lit(True).alias("_there")), keys, "left")
    ids = F.array_distinct(F.array_compact(F.array(*[F.col(f"_e_{c}.edit_id") for c in editable])))
    each = probe.select(*keys, F.explode(ids).alias("edit_id"), _missed(editable).alias("_missed"))
    hits = each.groupBy(*keys, "edit_id").agg(F.max(~F.array_contains("_missed", F.col("edit_id"))).alias("_hit"))
    return cut(hits.where("NOT _hit").select("edit_id").distinct(), "refused")


def apply_edits(base: DataFrame, edits: DataFrame, keys: list[str], editable: list[str]) -> DataFrame:
    """The table after the edits.

    All cells of an edit apply, over all its rows, or none does: every key must be there and every
    cell must still have its old value. Edits that touch the same cell twice are refused as a whole.
    """
    keys, editable, checked = _prepare(base, edits, keys, editable)
    refused = _refused(base, _wide_edits(checked, base.schema, keys, editable), keys, editable)
    wide = _wide_edits(checked.join(refused, "edit_id", "left_anti"), base.schema, keys, editable)
    joined = base.withColumn("_there", F.lit(True)).join(wide, keys, "left").withColumn("_missed", _missed(editable))

    def value(name: str) -> Column:
        if name not in editable:
            return F.col(f"`{name}`")
        entry = F.col(f"_e_{name}")
        fits = entry.isNotNull() & ~F.array_contains("_missed", entry["edit_id"])
        return F.when(fits, entry["new"]).otherwise(F.col(f"`{name}`")).alias(name)

    return joined.select(*[value(c) for c in base.columns])


def edit_status(base: DataFrame, edits: DataFrame, keys: list[str], editable: list[str]) -> DataFrame:
    """Per edit: ``applied``, ``conflict`` (some row changed or gone) or ``error``."""
    keys, editable, checked = _prepare(base, edits, keys, editable)
    refused = _refused(base, _wide_edits(checked, base.schema, keys, editable), keys, editable)
    return (
        _bad_edits(checked)
        .join(refused.withColumn("_refused", F.lit(True)), "edit_id", "left")
        .select(
            "edit_id",
            F.when(F.col("_bad"), "error").when(F.col("_refused"), "conflict").otherwise("applied").alias("status"),
        )
    )


def edit_summary(status: DataFrame) -> DataFrame:
    """Counts of applied, conflicted and failed edits, and whether all went well."""
    count = lambda s: F.count_if(F.col("status") == s)
    counts = status.agg(
        count("applied").alias("applied"), count("conflict").alias("conflicted"), count("error").alias("failed")
    )
    return counts.withColumn("ok", (F.col("conflicted") == 0) & (F.col("failed") == 0))


def edit_diff(baseline: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that differ between two states of a table, in the long form of edits."""
    barred = {k.lower() for k in keys}
    theirs = {c.lower() for c in edited.columns}
    cells = [c for c in baseline.columns if c.lower() not in barred and c.lower() in theirs]

    def as_text(df: DataFrame) -> DataFrame:
        types = {f.name.lower(): f.dataType for f in df.schema.fields}
        return df.select(
            *keys, *[value_text(F.col(f"`{c}`"), types[c.lower()]).alias(c) for c in cells]
        )

    old = as_text(baseline).select(*keys, F.struct(*cells).alias("_old"))
    new = as_text(edited).select(*keys, F.struct(*cells).alias("_new"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("_old")[c].alias("old_value"),
                F.col("_new")[c].alias("new_value"),
            )
            for c in cells
        ]
    )
    changed = F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    return old.join(new, keys).select(*keys, F.explode(changed).alias("_c")).select(*keys, "_c.*")


# -- keyed change feed ---------------------------------------------------------------------------



def _moment() -> Column:
    """Order of the events of a key: an entry that no event has touched comes first."""
    return F.struct(F.col("seq").isNotNull(), F.col("seq"))


def _with_previous(events: DataFrame) -> DataFrame:
    """Each event of a key with the event before it (columns ``prev_*``), also for hot keys.

    The events are ranged by key and order over partitions of even size, so a hot key is cut into as
    many parts as its events fill. Inside a part a window finds the neighbour; the first event of a
    part takes the last event of the key's nearest earlier part.
    """
    fields = [c for c in events.columns if c != "key"]
    entry = F.struct(*fields)
    order = [F.col("key"), F.col("seq").asc_nulls_first()]
    ranged = cut(events.repartitionByRange(sized_parts(events), *order).withColumn("_part", F.spark_partition_id()), "events")
    inside = Window.partitionBy("key", "_part").orderBy(F.col("seq").asc_nulls_first())
    near = ranged.withColumn("_prev", F.lag(entry).over(inside))
    last = ranged.groupBy("key", "_part").agg(F.max_by(entry, _moment()).alias("_last"))
    before = Window.partitionBy("key").orderBy("_part")
    carried = last.select("key", "_part", F.lag("_last").over(before).alias("_carry"))
    joined = near.join(carried, ["key", "_part"], "left")
    prev = F.coalesce("_prev", "_carry")
    return joined.select(*events.columns, *[prev[f].alias(f"prev_{f}") for f in fields])


def _settle_links(links: DataFrame) -> DataFrame:
    """Follow chains of renames to their origin by pointer doubling.

    A link says what a key held just before it was renamed away at ``at``: ``set`` (its fields are
    in ``found``), nothing, or ``from`` when that state itself came from the rename of
    ``next_source`` at ``next_at``. (``source``, ``at``) is unique, so the joins cannot multiply,
    and a chain of n renames takes about log2(n) rounds.
    """
    target = links.select(
        F.col("source").alias("next_source"), F.col("at").alias("next_at"), F.col("act").alias("_act"),
        F.col("next_source").alias("_source"), F.col("next_at").alias("_at"), F.col("found").alias("_found"),
    )
    is_open = F.col("act") == "from"
    if is_empty(links.where(is_open)):
        return links
    joined = links.where(is_open).join(target, ["next_source", "next_at"], "left")
    still = F.col("_act") == "from"
    known = still | (F.col("_act") == "set")
    moved = joined.select(
        "source",
        "at",
        F.when(still, "from").otherwise("set").alias("act"),
        F.col("_source").alias("next_source"),
        F.col("_at").alias("next_at"),
        F.when(known, F.col("_found")).otherwise(F.col("found")).alias("found"),
    )
    rest = links.where(~is_open | F.col("act").isNull())
    return _settle_links(cut(rest.unionByName(moved), "links"))


def apply_change_feed(index: DataFrame, feed: DataFrame, fields: list[str], tombstones: bool = False) -> DataFrame:
    """A keyed index after a feed of changes.

    With `tombstones` the keys that are gone stay, marked in a column ``deleted`` with the order
    number that ended them; an index that has that column counts them as gone. So a result that is
    stored and goes on as the next index still refuses older events.

    `index`: ``key``, `fields`, ``seq`` (the order number of its last change, null for none).
    `feed`: ``seq`` (unique), ``op`` (upsert, delete, rename), ``key``, ``new_key`` and `fields`.
    The latest change of a key wins, wherever older ones arrive. A rename moves the entry as it
    was at that moment and keeps its fields; renaming what is not there adds the new key with the
    fields the event carries.
    """
    no_source = F.lit(None).cast(feed.schema["key"].dataType)
    value = F.struct(*fields)

    def event(key: str, act: Column, source: Column) -> list[Column]:
        return [F.col(key).alias("key"), F.col("seq").cast("bigint").alias("seq"), act.alias("act"), source.alias("source"), value.alias("value")]

    renames = feed.where((F.col("op") == "rename") & ~F.col("key").eqNullSafe(F.col("new_key")))
    held = F.when(F.col("deleted"), "gone").otherwise("set") if "deleted" in index.columns else F.lit("set")
    # A rename ends one key and starts another at the same moment.
    events = (
        index.select(*event("key", held, no_source))
        .unionByName(
            feed.where(F.col("op") != "rename").select(
                *event("key", F.when(F.col("op") == "delete", "gone").otherwise("set"), no_source)
            )
        )
        .unionByName(renames.select(*event("key", F.lit("away"), no_source)))
        .unionByName(renames.select(*event("new_key", F.lit("from"), F.col("key"))))
    )
    entry = F.struct("seq", "act", "source", "value")
    final = events.groupBy("key").agg(F.max_by(entry, _moment()).alias("_e")).select("key", "_e.*")
    plain = final.where(F.col("act") == "set").select("key", "value", "seq")
    if not is_empty(renames):
        links = _with_previous(events).where(F.col("act") == "away").select(
            F.col("key").alias("source"),
            F.col("seq").alias("at"),
            F.col("prev_act").alias("act"),
            F.col("prev_source").alias("next_source"),
            F.col("prev_seq").alias("next_at"),
            F.col("prev_value").alias("found"),
        )
        links = _settle_links(cut(links, "links")).select(
            "source", F.col("at").alias("seq"), F.col("act").alias("_act"), "found"
        )
        arrived = final.where(F.col("act") == "from").join(links, ["source", "seq"], "left")
        plain = plain.unionByName(
            arrived.select(
                "key", F.when(F.col("_act") == "set", F.col("found")).otherwise(F.col("value")).alias("value"), "seq"
            )
        )
    entries = plain.select("key", *[F.col("value")[f].alias(f) for f in fields], "seq")
    if not tombstones:
        return entries
    gone = final.where(F.col("act").isin("gone", "away")).select(
        "key", *[F.lit(None).cast(entries.schema[f].dataType).alias(f) for f in fields], "seq", F.lit(True).alias("deleted")
    )
    return entries.withColumn("deleted", F.lit(False)).unionByName(gone)
