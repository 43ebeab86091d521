"""Queries over users, groups and menus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabgrain.operators import access
from fabgrain.plans.driver_tables import ACCESS, USERS, groups, menu_grants, menus, shown, table, users
from fabgrain.plans.registry import query


@query("p8_visible_items", f"""
WITH {USERS},
nav(item, roles) AS (VALUES
  ('yield-report', ['admin', 'demo01', 'user']), ('lot-overview', ['admin', 'demo01', 'user']),
  ('statistical-analysis', ['admin', 'demo01']), ('data-report', ['admin', 'demo01']),
  ('user-management', ['admin']), ('system-status', ['admin']))
SELECT id, item FROM users, nav WHERE list_contains(roles, coalesce(user_group, 'user'))""")
def _(spark, sf):
    return access.visible_items(users(spark, sf))


@query("a12_user_list", f"WITH {USERS} SELECT * REPLACE (coalesce(group_id, -1) AS group_id), (SELECT count(*) FROM users) AS total FROM users")
def _(spark, sf):
    return shown(access.user_list(users(spark, sf)), "group_id")


@query("j1_group_name", f"""
WITH {ACCESS}
SELECT u.* REPLACE (coalesce(group_id, -1) AS group_id), coalesce(g.name, 'user') AS group_name FROM users u LEFT JOIN groups g ON u.group_id = g.id""")
def _(spark, sf):
    return shown(access.with_group_name(users(spark, sf), groups(spark, sf)), "group_id")


@query("j2_group_menus", f"""
WITH {ACCESS}
SELECT group_id, g.name AS group_name, menu_id, code, coalesce(sort_order, -1) AS sort_order
FROM grants JOIN groups g ON group_id = g.id JOIN menus m ON menu_id = m.id""")
def _(spark, sf):
    return shown(access.group_menus(groups(spark, sf), menus(spark, sf), menu_grants(spark, sf)), "sort_order")


@query("j3_user_menus", f"""
WITH {ACCESS},
l AS (SELECT group_id, string_agg(code, ',' ORDER BY coalesce(sort_order, 2147483647), code) AS menus
      FROM grants JOIN menus m ON menu_id = m.id GROUP BY group_id)
SELECT u.id, u.username, coalesce(l.menus, '') AS menus FROM users u LEFT JOIN l USING (group_id)""")
def _(spark, sf):
    listed = access.user_menus(users(spark, sf), menus(spark, sf), menu_grants(spark, sf))
    return listed.select("id", "username", F.array_join("menus", ",").alias("menus"))


@query("j4_grant", f"""
WITH {ACCESS}
SELECT group_id, menu_id FROM grants
UNION SELECT g.id, m.id FROM groups g, menus m WHERE g.name IN ('NATION_1', 'NATION_7')
UNION SELECT g.id, m.id FROM groups g JOIN customer ON c_nationkey = g.id JOIN menus m ON m.id = c_nationkey % 5 + 1 WHERE c_mktsegment = 'BUILDING'""")
def _(spark, sf):
    code = F.concat(F.lit("brand#"), (F.col("id") % 5 + 1).cast("string"))
    rules = (
        table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("id")).distinct()
        .join(groups(spark, sf), "id").select(F.col("name").alias("group_name"), code.alias("menu_code"))
    )
    return access.grant(
        menus(spark, sf), groups(spark, sf), menu_grants(spark, sf), rules, group_names=["NATION_1", "NATION_7"]
    )


@query("j5_insert_absent", f"""
WITH {ACCESS}
SELECT code, name, coalesce(sort_order, -1) AS sort_order FROM menus WHERE sort_order IS NOT NULL
UNION ALL
SELECT lower(p_brand), min(p_type), -1 FROM part WHERE lower(p_brand) NOT IN (SELECT code FROM menus WHERE sort_order IS NOT NULL) GROUP BY p_brand""")
def _(spark, sf):
    stored = menus(spark, sf).where("sort_order IS NOT NULL").select("code", "name", "sort_order")
    seeds = table(spark, sf, "part").select(F.lower("p_brand").alias("code"), F.col("p_type").alias("name"))
    return shown(access.insert_absent(stored, seeds, "code"), "sort_order")


@query("j6_update_by_key", """
SELECT c_custkey, c_name, CASE WHEN n_regionkey = 2 THEN 'moved-' || n_name ELSE c_mktsegment END AS c_mktsegment, c_nationkey
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    updates = table(spark, sf, "nation").where("n_regionkey = 2").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("moved-"), "n_name").alias("new_value")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return access.update_by_key(customer, "c_nationkey", "c_mktsegment", updates)


@query("j7_add_columns", f"""
WITH {USERS} SELECT id, '' AS email, email AS login, name, coalesce(user_group, 'user') AS user_group, 99 AS sort_order FROM users""")
def _(spark, sf):
    stored = users(spark, sf).select("id", "email", "name", F.coalesce("user_group", F.lit("user")).alias("user_group"))
    moved = access.copy_and_blank(stored, "email", "login")
    return access.add_column(access.add_column(moved, "sort_order", F.lit(99)), "user_group", F.lit("other"))


@query("j8_expect_rows", f"""
WITH {USERS}, c(check_name, observed, expected) AS (
  SELECT 'no admins yet', count(*), 0::BIGINT FROM users WHERE user_group = 'admin'
  UNION ALL SELECT 'no blank names', count(*), 0 FROM users WHERE name IS NULL OR trim(name) = ''
  UNION ALL SELECT 'all in a group', count(*), 0 FROM users WHERE group_id IS NULL)
SELECT *, observed = expected AS passed FROM c""")
def _(spark, sf):
    u = users(spark, sf)
    return access.expect_rows({
        "no admins yet": (u.where("user_group = 'admin'"), 0),
        "no blank names": (access.blank_values(u, "name"), 0),
        "all in a group": (u.where("group_id IS NULL"), 0),
    })


@query("j9_audit", f"""
WITH {USERS}
SELECT 'username' AS constraint_name, 'unique' AS kind, (count(*) - count(DISTINCT username))::BIGINT AS violations FROM users
UNION ALL SELECT 'order line', 'unique', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT FROM lineitem
UNION ALL SELECT 'user group', 'filled', count(*) FROM users WHERE user_group IS NULL OR trim(user_group) = ''
UNION ALL SELECT 'order customer', 'reference', count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM users WHERE user_group IS NOT NULL)
UNION ALL SELECT 'line order', 'reference', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def _(spark, sf):
    u, lines, orders = users(spark, sf), table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return access.audit(
        unique={"username": (u, ["username"]), "order line": (lines, ["l_orderkey", "l_linenumber"])},
        filled={"user group": (u, "user_group")},
        references={
            "order customer": (orders, "o_custkey", u.where("user_group IS NOT NULL"), "id"),
            "line order": (lines, "l_orderkey", orders, "o_orderkey"),
        },
    )


@query("j10_keys_exist", f"""
WITH {USERS}
SELECT DISTINCT o_custkey * 2 AS id, o_custkey * 2 IN (SELECT id FROM users) AS found FROM orders""")
def _(spark, sf):
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"))
    return access.keys_exist(wanted, users(spark, sf), "id")


CHANGES = """
changes AS (
  SELECT o_custkey * 2 AS id, CASE WHEN count(*) % 2 = 0 THEN 'new-' || o_custkey || '@example.com' END AS email,
         CASE WHEN max(o_orderpriority) < '5' THEN max(o_orderpriority) END AS name
  FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey
)"""


def _changes(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey")
    found = pending.agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("top"))
    return found.select(
        (F.col("o_custkey") * 2).alias("id"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("new-"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("top") < "5", F.col("top")).alias("name"),
    )


@query("j11_apply_changes", f"""
WITH {USERS}, {CHANGES}
SELECT u.id, username, coalesce(c.email, u.email) AS email, coalesce(c.name, u.name) AS name, user_group, coalesce(group_id, -1) AS group_id
FROM users u LEFT JOIN changes c USING (id)""")
def _(spark, sf):
    return shown(access.apply_changes(users(spark, sf), _changes(spark, sf), "id", ["email", "name"]), "group_id")


@query("j11_repeated_changes", f"""
WITH {USERS},
raw AS (SELECT o_custkey * 2 AS id, o_orderkey AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'new-' || o_orderkey || '@example.com' END AS email,
               CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS name FROM orders),
c AS (SELECT id, arg_max(email, version) FILTER (email IS NOT NULL) AS email, arg_max(name, version) FILTER (name IS NOT NULL) AS name FROM raw GROUP BY id)
SELECT u.id, username, coalesce(c.email, u.email) AS email, coalesce(c.name, u.name) AS name, user_group, coalesce(group_id, -1) AS group_id
FROM users u LEFT JOIN c USING (id)""")
def _(spark, sf):
    order = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), order.alias("version"),
        F.when(order % 2 == 0, F.concat(F.lit("new-"), order.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("name"),
    )
    return shown(access.apply_changes(users(spark, sf), raw, "id", ["email", "name"], "version"), "group_id")


@query("j11_unmatched", f"WITH {USERS}, {CHANGES} SELECT * FROM changes WHERE id NOT IN (SELECT id FROM users)")
def _(spark, sf):
    return access.unmatched_changes(users(spark, sf), _changes(spark, sf), "id")


@query("j11_delete", f"WITH {USERS}, {CHANGES} SELECT * REPLACE (coalesce(group_id, -1) AS group_id) FROM users WHERE id NOT IN (SELECT id FROM changes)")
def _(spark, sf):
    return shown(access.delete_keys(users(spark, sf), _changes(spark, sf), "id"), "group_id")
