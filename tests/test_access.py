"""Users, groups and menus, with the menu table that the migrations leave behind."""

import pytest
from pyspark.sql import functions as F

from fabgrain.operators import access


@pytest.fixture(scope="module")
def seed(spark):
    users = spark.createDataFrame(
        [(1, "admin", "a@x", 1), (2, "demo01", "d@x", 1), (3, "guest", None, None), (4, "plain", "p@x", 2), (5, "lost", "l@x", 9)],
        "id int, username string, email string, group_id int",
    )
    groups = spark.createDataFrame([(1, "admin"), (2, "user")], "id int, name string")
    menus = spark.createDataFrame(
        [(1, "lot-overview", 10), (2, "wafer-detail", 20), (3, "statistical-analysis", 30), (4, "ai-assistant", 99), (5, "user-management", None), (6, "system-status", None)],
        "id int, code string, sort_order int",
    )
    grants = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 4)], "group_id int, menu_id int")
    return users, groups, menus, grants


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_group_names(seed):
    users, groups, *_ = seed
    named = {r.id: r.group_name for r in access.with_group_name(users, groups).collect()}
    assert named == {1: "admin", 2: "admin", 3: "user", 4: "user", 5: "user"}


def test_menus_come_in_order_and_missing_positions_last(seed, spark):
    users, groups, menus, grants = seed
    lists = {r.id: r.menus for r in access.user_menus(users, menus, grants).collect()}
    assert lists[1] == ["lot-overview", "wafer-detail", "statistical-analysis", "ai-assistant"]
    assert lists[4] == ["ai-assistant"] and lists[3] == [] and lists[5] == []
    more = grants.union(spark.createDataFrame([(1, 5), (1, 77)], grants.schema))
    assert {r.id: r.menus for r in access.user_menus(users, menus, more).collect()}[2][-2:] == ["ai-assistant", "user-management"]
    codes = [r.code for r in access.group_menus(groups, menus, more).where("group_id = 1").collect()]
    assert codes == ["lot-overview", "wafer-detail", "statistical-analysis", "ai-assistant", "user-management"]


def test_granting_twice_adds_nothing(seed, spark):
    _, groups, menus, grants = seed
    rules = spark.createDataFrame([("admin", "ai-assistant"), ("user", "ai-assistant"), ("nobody", "ai-assistant")], "group_name string, menu_code string")
    once = access.grant(menus, groups, grants, rules, group_names=["admin"])
    assert rows_of(once) == rows_of(grants.union(spark.createDataFrame([(1, 5), (1, 6)], grants.schema)))
    assert rows_of(access.grant(menus, groups, once, rules, group_names=["admin"])) == rows_of(once)


def test_visible_items(spark):
    users = spark.createDataFrame([(1, "admin"), (2, None), (3, ""), (4, "demo01"), (5, "other")], "id int, user_group string")
    seen = {}
    for user, item in access.visible_items(users).collect():
        seen.setdefault(user, set()).add(item)
    assert len(seen[1]) == 6 and 5 not in seen
    assert seen[2] == seen[3] == {"yield-report", "lot-overview"}
    assert seen[4] == {"yield-report", "lot-overview", "statistical-analysis", "data-report"}


def test_user_list_hides_hashes(spark):
    users = spark.createDataFrame([(1, "h"), (2, "h")], "id int, password_hash string")
    assert rows_of(access.user_list(users)) == [(1, 2), (2, 2)]


def test_insert_absent_takes_each_key_once(spark):
    stored = spark.createDataFrame([("a", "old")], "code string, name string")
    seeds = spark.createDataFrame([("a", "new"), ("b", "y"), ("b", "x")], stored.schema)
    assert rows_of(access.insert_absent(stored, seeds, "code")) == [("a", "old"), ("b", "x")]


def test_updates_and_schema_changes(seed, spark):
    _, _, menus, _ = seed
    updates = spark.createDataFrame([("user-management", 40), ("system-status", 100), ("gone", 1)], "code string, new_value int")
    changed = {r.code: r.sort_order for r in access.update_by_key(menus, "code", "sort_order", updates).collect()}
    assert changed["user-management"] == 40 and changed["system-status"] == 100 and changed["lot-overview"] == 10 and len(changed) == 6
    users = spark.createDataFrame([(1, "a@x")], "id int, email string")
    moved = access.add_column(access.copy_and_blank(users, "email", "username"), "sort_order", F.lit(99))
    assert rows_of(moved.select("id", "email", "username", "sort_order")) == [(1, "", "a@x", 99)]
    assert access.add_column(moved, "sort_order", F.lit(1)).first().sort_order == 99


def test_checks_and_audit(seed, spark):
    users, groups, menus, grants = seed
    checks = access.expect_rows({"admin": (groups.where("name = 'admin'"), 0), "none": (groups.where("name = 'x'"), 0)})
    assert rows_of(checks) == [("admin", 1, 0, False), ("none", 0, 0, True)]
    doubled = users.union(users.where("id = 1"))
    got = {r.constraint_name: r.violations for r in access.audit(
        unique={"username": (doubled, ["username"]), "email": (users, ["email"])},
        filled={"email given": (users, "email")},
        references={"group": (users, "group_id", groups, "id"), "menu": (grants, "menu_id", menus, "id")},
    ).collect()}
    assert got == {"username": 1, "email": 0, "email given": 1, "group": 1, "menu": 0}
    assert rows_of(access.repeated_keys(doubled, ["username"])) == [("admin", 2)]
    assert rows_of(access.orphans(users, "group_id", groups, "id")) == [(9, 1)]


def test_lookups_and_changes(seed, spark):
    users, *_ = seed
    wanted = spark.createDataFrame([(1,), (1,), (42,)], "id int")
    assert rows_of(access.keys_exist(wanted, users, "id")) == [(1, True), (42, False)]
    changes = spark.createDataFrame([(1, None), (4, "new@x"), (42, "no@x")], "id int, email string")
    emails = {r.id: r.email for r in access.apply_changes(users, changes, "id", ["email"]).collect()}
    assert emails == {1: "a@x", 2: "d@x", 3: None, 4: "new@x", 5: "l@x"}
    assert rows_of(access.unmatched_changes(users, changes, "id")) == [(42, "no@x")]
    several = spark.createDataFrame([(1, 2, None), (1, 1, "old@x"), (4, 1, "z@x"), (4, 2, "b@x"), (None, 1, "n@x")], "id int, v int, email string")
    emails = rows_of(access.apply_changes(users, several, "id", ["email"], "v").select("id", "email"))
    assert emails == [(1, "old@x"), (2, "d@x"), (3, None), (4, "b@x"), (5, "l@x")]
    twice = several.select("id", "v", F.col("email").alias("new_value"))
    assert rows_of(access.update_by_key(users, "id", "email", twice, "v").select("id", "email")) == emails
    assert {r.id for r in access.delete_keys(users, changes, "id").collect()} == {2, 3, 5}
