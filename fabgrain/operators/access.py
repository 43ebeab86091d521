"""Users, groups and menus: lookups, grants, updates and integrity checks on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabgrain.functions.skew import attach, keep

# Group of users without one, sort position of menus without one, and the roles that
# see each navigation item.
DEFAULT_GROUP = "user"
LAST_POSITION = 2147483647
NAVIGATION = {
    "yield-report": ["admin", "demo01", "user"],
    "lot-overview": ["admin", "demo01", "user"],
    "statistical-analysis": ["admin", "demo01"],
    "data-report": ["admin", "demo01"],
    "user-management": ["admin"],
    "system-status": ["admin"],
}


def visible_items(users: DataFrame, navigation: Mapping[str, Sequence[str]] = NAVIGATION) -> DataFrame:
    """Navigation items each user sees, ``(id, item)``; a user without group counts as "user"."""
    seen = {}
    for item, roles in navigation.items():
        for role in roles:
            seen.setdefault(role, []).append(item)
    group = F.coalesce(F.when(F.col("user_group") != "", F.col("user_group")), F.lit(DEFAULT_GROUP))
    lists = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in seen.items() for v in pair])
    return users.select("id", F.explode(F.try_element_at(lists, group)).alias("item"))


def user_list(users: DataFrame) -> DataFrame:
    """All users, each row with the total number of users; the password hash is left out."""
    total = users.agg(F.count("*").alias("total")).scalar()
    return users.drop("password_hash").withColumn("total", total)


def with_group_name(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Users with ``group_name``; a missing or unknown group is named "user"."""
    named = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    return attach(users, named, ["group_id"]).withColumn("group_name", F.coalesce("group_name", F.lit(DEFAULT_GROUP)))


def menu_position() -> Column:
    """Sort position of a menu; menus without one come last."""
    return F.coalesce(F.col("sort_order"), F.lit(LAST_POSITION))


def group_menus(groups: DataFrame, menus: DataFrame, grants: DataFrame) -> DataFrame:
    """Menus of each group in menu order: ``(group_id, group_name, menu_id, code, sort_order)``."""
    named = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    listed = menus.select(F.col("id").alias("menu_id"), "code", "sort_order")
    granted = attach(attach(grants, listed, ["menu_id"], "inner"), named, ["group_id"], "inner")
    return granted.select("group_id", "group_name", "menu_id", "code", "sort_order").orderBy(
        "group_id", menu_position(), "code"
    )


def user_menus(users: DataFrame, menus: DataFrame, grants: DataFrame) -> DataFrame:
    """Users with the codes of their group's menus in menu order, an empty list without group.

    Lists are built once per group, never per user; a list is bounded by the menu table.
    """
    listed = menus.select(F.col("id").alias("menu_id"), "code", menu_position().alias("position"))
    entries = F.array_sort(F.collect_set(F.struct("position", "code")))
    per_group = attach(grants, listed, ["menu_id"], "inner").groupBy("group_id").agg(entries["code"].alias("menus"))
    none = F.array().cast("array<string>")
    return attach(users, keep(per_group), ["group_id"]).withColumn("menus", F.coalesce("menus", none))


def grant(menus: DataFrame, groups: DataFrame, grants: DataFrame, rules: DataFrame | None = None, group_names: Sequence[str] = ()) -> DataFrame:
    """Grants after adding the missing ones, ``(group_id, menu_id)``.

    ``rules`` holds wanted (``group_name``, ``menu_code``) pairs and joins both tables by equality.
    ``group_names`` lists groups that get every menu: each menu row is repeated per listed name.
    Grants that exist already are not added again.
    """
    ids = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    wanted = []
    if rules is not None:
        codes = menus.select(F.col("id").alias("menu_id"), F.col("code").alias("menu_code"))
        wanted.append(attach(attach(rules, ids, ["group_name"], "inner"), codes, ["menu_code"], "inner"))
    if group_names:
        names = F.array(*[F.lit(n) for n in group_names])
        every = menus.select(F.col("id").alias("menu_id"), F.explode(names).alias("group_name"))
        wanted.append(attach(every, ids, ["group_name"], "inner"))
    pairs = reduce(DataFrame.unionByName, [w.select("group_id", "menu_id") for w in wanted]).distinct()
    current = grants.select("group_id", "menu_id")
    return current.unionByName(pairs.join(current, ["group_id", "menu_id"], "left_anti"))


def insert_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Target plus the rows whose key it lacks; a key repeated in ``rows`` is added once.

    Of repeated rows the smallest by the remaining columns is taken.
    """
    rest = [c for c in rows.columns if c != key]
    absent = rows.join(target.select(key), key, "left_anti")
    once = absent.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return target.unionByName(once, allowMissingColumns=True)


def merge_changes(changes: DataFrame, key: str, columns: Sequence[str], version: str | None = None) -> DataFrame:
    """One row per key with the last non-null value of each column by ``version``.

    Equal versions, or none, leave the largest value. A NULL key names no row. An often repeated key is merged before
    the shuffle.
    """
    def last(c: str) -> Column:
        if version is None:
            return F.max(c).alias(c)
        return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(version).alias("v"), F.col(c).alias("c"))))["c"].alias(c)

    return changes.dropna(subset=[key]).groupBy(key).agg(*map(last, columns))


def update_by_key(df: DataFrame, key: str, column: str, updates: DataFrame, version: str | None = None) -> DataFrame:
    """Set ``column`` where ``updates`` (``key``, ``new_value``) names the key; other rows stay.

    Of several updates of one key the last by ``version`` counts, see :func:`merge_changes`.
    """
    joined = attach(df, merge_changes(updates, key, ["new_value"], version), [key])
    return joined.withColumn(column, F.coalesce("new_value", column)).select(*df.columns)


def add_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """A new column with a default on existing rows."""
    return df if name in df.columns else df.withColumn(name, default)


def copy_and_blank(df: DataFrame, source: str, target: str) -> DataFrame:
    """Move a text column: ``target`` takes its values, ``source`` becomes empty text."""
    return df.withColumn(target, F.col(source)).withColumn(source, F.lit(""))


def expect_rows(checks: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """One row per named check: rows found, rows expected, and whether they agree."""
    def row(name: str, df: DataFrame, expected: int) -> DataFrame:
        return df.agg(F.count("*").alias("observed")).select(
            F.lit(name).alias("check_name"), "observed", F.lit(expected).cast("long").alias("expected"),
            (F.col("observed") == expected).alias("passed"),
        )

    return reduce(DataFrame.unionByName, [row(n, df, e) for n, (df, e) in checks.items()])


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count; NULL keys never collide."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def blank_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text column is NULL or blank."""
    return df.where(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referencing values without a parent row, with their row counts; NULL refers to nothing.

    References are counted per value before the join, so a frequent value travels once.
    """
    used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(parent_key)).agg(F.count("*").alias("rows"))
    return used.join(parent.select(parent_key), parent_key, "left_anti").withColumnRenamed(parent_key, column)


def audit(
    unique: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None,
    filled: Mapping[str, tuple[DataFrame, str]] | None = None,
    references: Mapping[str, tuple[DataFrame, str, DataFrame, str]] | None = None,
) -> DataFrame:
    """Violations per named constraint, ``(constraint_name, kind, violations)``.

    ``unique`` counts surplus rows of repeated keys, ``filled`` blank values, ``references`` rows
    whose value has no parent.
    """
    def row(name: str, kind: str, df: DataFrame, count: Column) -> DataFrame:
        return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(
            F.lit(name).alias("constraint_name"), F.lit(kind).alias("kind"), "violations"
        )

    rows = [row(n, "unique", repeated_keys(df, key), F.sum(F.col("rows") - 1)) for n, (df, key) in (unique or {}).items()]
    rows += [row(n, "filled", blank_values(df, c), F.count("*")) for n, (df, c) in (filled or {}).items()]
    rows += [row(n, "reference", orphans(df, c, p, k), F.sum("rows")) for n, (df, c, p, k) in (references or {}).items()]
    return reduce(DataFrame.unionByName, rows)


def keys_exist(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each distinct wanted key with ``found``: whether the table has a row for it."""
    present = table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("found", F.lit(True))
    return wanted.select(key).distinct().join(present, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def apply_changes(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], version: str | None = None) -> DataFrame:
    """Overwrite ``columns`` with the non-null values of the changes of the same key, see :func:`merge_changes`."""
    merged = merge_changes(changes, key, columns, version)
    renamed = merged.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*df.columns)


def delete_keys(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not to be deleted."""
    return df.join(doomed.select(key), key, "left_anti")


def unmatched_changes(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Change rows whose key the table lacks."""
    return changes.join(df.select(key), key, "left_anti")
