"""Registered queries: tenants, roles and permissions."""

from pyspark.sql import functions as F

from passagework import skew
from passagework.operators import tenancy as N
from passagework.plans import dims
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import values

# Requests are the events; the user dimension gives them a role and a tenant. Grants
# are the (role, code) pairs seen among the events of even users.
ROLE_NAMES = dims.ROLE_NAMES
ROLES = [(i + 1, name) for i, name in enumerate([*ROLE_NAMES, "guest"])]
CODES = [(i + 1, c) for i, c in enumerate(["view", "click", "error", "purchase", "signup", "*"])]
DIMS = (
    f"{dims.SQL_USERS}, {dims.SQL_TENANTS}, roles AS (SELECT * FROM {values(ROLES, 'id', 'name')}), "
    f"codes AS (SELECT * FROM {values(CODES, 'id', 'code')})"
)
REQUESTS = """requests AS (SELECT event_id, u.role, u.tenant_id, event_type AS code, e.user_id
  FROM events e LEFT JOIN users u ON u.id = e.user_id)"""
GRANTS = """grants AS (SELECT DISTINCT role, CASE WHEN role = 'super_admin' THEN '*' ELSE code END AS code FROM requests JOIN events USING (event_id)
  WHERE role IS NOT NULL AND value > 40 * (length(role) - length(code)))"""


def roles(t: Tables):
    return t.spark.createDataFrame(ROLES, "id int, name string")


def codes(t: Tables):
    return t.spark.createDataFrame(CODES, "id int, code string")


def requests(t: Tables):
    people = dims.users(t.spark).select(F.col("id").alias("user_id"), "role", "tenant_id")
    rows = t.events.select("event_id", "user_id", F.col("event_type").alias("code"), "value")
    return skew.join_small(rows, people, ["user_id"], "left")


def grants(t: Tables):
    """Grants earned by large enough events: the longer the role name, the rarer."""
    enough = F.col("value") > 40 * (F.length("role") - F.length("code"))
    code = F.when(F.col("role") == N.SUPER, F.lit("*")).otherwise(F.col("code"))
    return requests(t).where(F.col("role").isNotNull() & enough).select("role", code.alias("code")).distinct()


def permissions(t: Tables):
    pairs = N.grant_pairs(grants(t), roles(t), codes(t))
    return N.role_permissions(roles(t), codes(t), pairs)


@query("role_permissions", f"""
WITH {DIMS}, {REQUESTS}, {GRANTS}
SELECT name AS role, coalesce(string_agg(g.code, ',' ORDER BY g.code), '') AS codes FROM roles LEFT JOIN grants g ON g.role = name GROUP BY 1
""")
def role_permissions(t: Tables):
    return permissions(t).withColumn("codes", F.array_join("codes", ","))


@query("permission_check", f"""
WITH {DIMS}, {REQUESTS}, {GRANTS}
SELECT event_id, EXISTS (SELECT 1 FROM grants g WHERE g.role = requests.role AND g.code IN ('*', requests.code)) AS allowed FROM requests
""")
def permission_check(t: Tables):
    return N.check_permissions(requests(t), permissions(t)).select("event_id", "allowed")


@query("tenant_scope", f"""
WITH {DIMS}, {REQUESTS}, d AS (SELECT substr(source, 4)::bigint AS tenant_id, count(*) AS n FROM documents GROUP BY 1)
SELECT event_id, coalesce(CASE WHEN role = 'super_admin' THEN (SELECT sum(n)::bigint FROM d) ELSE n END, 0) AS rows
FROM requests LEFT JOIN d USING (tenant_id)
""")
def tenant_scope(t: Tables):
    data = t.documents.select(F.substring("source", 4, 9).cast("long").alias("tenant_id"))
    return N.tenant_scope(requests(t), data).select("event_id", "rows")


def known_users(t: Tables):
    """Users that appear in the events."""
    seen = t.events.select(F.col("user_id").alias("id")).distinct()
    return dims.users(t.spark).join(seen, "id", "left_semi")


@query("user_listing", f"""
WITH {DIMS}, seen AS (SELECT * FROM users WHERE id IN (SELECT user_id FROM events))
SELECT 'super' AS viewer, s.id, s.username, s.role, coalesce(t.name, '') AS tenant_name FROM seen s LEFT JOIN tenants t ON t.id = s.tenant_id
UNION ALL SELECT 'admin', s.id, s.username, s.role, coalesce(t.name, '') FROM seen s LEFT JOIN tenants t ON t.id = s.tenant_id
WHERE s.tenant_id = 3 AND s.role <> 'super_admin'
""")
def user_listing(t: Tables):
    people, tenants = known_users(t), dims.tenants(t.spark)
    columns = ["viewer", "id", "username", "role", "tenant_name"]
    every = N.user_listing(people, tenants, True).withColumn("viewer", F.lit("super")).select(*columns)
    own = N.user_listing(people, tenants, False, 3).withColumn("viewer", F.lit("admin")).select(*columns)
    return every.unionByName(own)


@query("tenant_listing", f"""
WITH {DIMS}, {REQUESTS}
SELECT DISTINCT false AS all_tenants, tenant_id, name AS tenant_name FROM requests JOIN tenants ON id = tenant_id WHERE role IS DISTINCT FROM 'super_admin'
UNION ALL SELECT true, id, name FROM tenants WHERE EXISTS (SELECT 1 FROM requests WHERE role = 'super_admin')
""")
def tenant_listing(t: Tables):
    return N.tenant_listing(requests(t), dims.tenants(t.spark))


LEVEL = "coalesce(map {'viewer': 0, 'editor': 1, 'tenant_admin': 2, 'super_admin': 3}[coalesce(%s, '')], -1)"


@query("role_change_audit", f"""
WITH {DIMS}, {REQUESTS}, c AS (SELECT event_id, coalesce(r.role, 'viewer') AS op, r.tenant_id AS op_tenant, event_id % 70 AS target_id,
    ['viewer', 'editor', 'tenant_admin', 'super_admin', 'owner'][event_id % 5 + 1] AS new_role FROM requests r),
j AS (SELECT c.*, u.id, u.role AS cur, u.tenant_id AS cur_tenant FROM c LEFT JOIN users u ON u.id = target_id)
SELECT event_id, reason, reason IS NULL AS allowed FROM (SELECT event_id, CASE WHEN new_role = 'owner' THEN 'invalid role'
  WHEN new_role = 'super_admin' AND op <> 'super_admin' THEN 'may not grant super admin' WHEN id IS NULL THEN 'unknown user'
  WHEN cur = 'super_admin' AND op <> 'super_admin' THEN 'may not change a super admin'
  WHEN op <> 'super_admin' AND {LEVEL % 'cur'} >= {LEVEL % 'op'} THEN 'target not below operator'
  WHEN op <> 'super_admin' AND {LEVEL % 'new_role'} >= {LEVEL % 'op'} THEN 'role not below operator'
  WHEN op <> 'super_admin' AND cur_tenant IS DISTINCT FROM op_tenant THEN 'other tenant' END AS reason FROM j)
""")
def role_change_audit(t: Tables):
    names = F.array(*[F.lit(n) for n in [*ROLE_NAMES, "owner"]])
    changes = requests(t).select(
        "event_id",
        F.col("role").alias("operator_role"),
        F.col("tenant_id").alias("operator_tenant"),
        (F.col("event_id") % 70).alias("target_id"),
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("new_role"),
    )
    return N.audit_role_changes(changes, dims.users(t.spark)).select("event_id", "reason", "allowed")


@query("partial_update", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE lang END AS lang, CASE WHEN quality = 0 THEN 'low' ELSE source END AS source
FROM documents LEFT JOIN labels USING (doc_id)
""")
def partial_update(t: Tables):
    updates = t.labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.lit("flagged")).alias("lang"),
        F.when(F.col("quality") == 0, F.lit("low")).alias("source"),
    )
    return N.partial_update(t.documents.select("doc_id", "lang", "source"), updates, "doc_id")


@query("grant_expand", f"""
WITH {DIMS}, {REQUESTS}, {GRANTS}, old AS (SELECT DISTINCT role, 'view' AS code FROM grants WHERE code = 'view')
SELECT r.id AS role_id, c.id AS permission_id FROM grants g JOIN roles r ON r.name = g.role JOIN codes c USING (code)
WHERE (g.role, g.code) NOT IN (SELECT role, code FROM old)
""")
def grant_expand(t: Tables):
    every = grants(t)
    old = N.grant_pairs(every.where("code = 'view'"), roles(t), codes(t))
    return N.grant_pairs(every, roles(t), codes(t), old)


@query("active_principals", f"""
WITH {DIMS}
SELECT DISTINCT u.id, u.username, u.role, u.tenant_id FROM users u JOIN events e ON e.user_id = u.id LEFT JOIN tenants t ON t.id = u.tenant_id
WHERE u.is_active AND u.role IS NOT NULL AND coalesce(t.is_active, true)
""")
def active_principals(t: Tables):
    return N.active_principals(known_users(t), dims.tenants(t.spark)).select("id", "username", "role", "tenant_id")


@query("login_outcome", f"""
WITH {DIMS}
SELECT event_id, CASE WHEN u.id IS NOT NULL THEN coalesce(u.role, 'viewer') END AS role, CASE WHEN u.id IS NULL THEN 'unknown user'
  WHEN NOT u.is_active THEN 'user disabled' WHEN value < 5 THEN 'wrong password'
  WHEN u.tenant_id IS NOT NULL AND NOT coalesce(t.is_active, false) THEN 'tenant disabled' END AS reason
FROM events e LEFT JOIN users u ON u.username = 'user' || e.user_id LEFT JOIN tenants t ON t.id = u.tenant_id
""")
def login_outcome(t: Tables):
    attempts = t.events.select(
        "event_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        (F.col("value") >= 5).alias("password_ok"),
    )
    out = N.login_outcome(attempts, dims.users(t.spark), dims.tenants(t.spark))
    return out.select("event_id", "role", "reason")
