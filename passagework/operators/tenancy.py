"""Tenants, roles and permissions over whole tables of requests.

Users, roles and tenants are small dimensions; requests and documents are the big
sides and keep their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.session import materialize

SUPER = "super_admin"
EVERYTHING = "*"


def grant_pairs(grants: DataFrame, roles: DataFrame, permissions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Expand (role, code) grants to (role_id, permission_id), leaving out existing pairs."""
    pairs = skew.join_small(
        skew.join_small(grants, roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), ["role"]),
        permissions.select(F.col("id").alias("permission_id"), "code"),
        ["code"],
    )
    found = pairs.select("role_id", "permission_id").distinct()
    return found if existing is None else found.join(existing, ["role_id", "permission_id"], "left_anti")


def role_permissions(roles: DataFrame, permissions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Role name and its sorted permission codes; roles without any get an empty list.

    The list holds distinct codes, of which there are as many as permissions.
    """
    codes = skew.join_small(pairs, permissions.select(F.col("id").alias("permission_id"), "code"), ["permission_id"])
    lists = codes.groupBy("role_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return named.join(lists, "role_id", "left").select(
        "role", F.coalesce("codes", F.array().cast("array<string>")).alias("codes")
    )


def check_permissions(requests: DataFrame, granted: DataFrame) -> DataFrame:
    """Requests (role, code) with ``allowed``: the role holds the code or ``*``."""
    joined = skew.join_small(requests, granted.select("role", "codes"), ["role"], "left")
    allowed = F.array_contains("codes", "*") | F.array_contains(F.col("codes"), F.col("code"))
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("codes")


def effective_tenant(role: Column, tenant: Column) -> Column:
    """Null for super administrators, who see everything."""
    return F.when(role != SUPER, tenant)


def scope_key(role: Column, tenant: Column) -> Column:
    """What a principal may see: everything, or its tenant; null matches nothing."""
    return F.when(role == SUPER, F.lit(EVERYTHING)).otherwise(tenant.cast("string"))


def tenant_scope(requests: DataFrame, data: DataFrame, tenant: str = "tenant_id", size: str = "rows") -> DataFrame:
    """Visible rows and the sum of ``rows`` per request.

    ``data`` is first reduced to one row per tenant, so a request never meets the
    data rows themselves. A null tenant matches nothing.
    """
    # One row per tenant and one for all of them, keyed alike.
    scopes = F.explode(F.array(F.lit(EVERYTHING), F.col(tenant).cast("string"))).alias("_scope")
    per_tenant = data.groupBy(tenant).agg(F.count("*").alias(size))
    per_scope = per_tenant.select(scopes, size).where("_scope is not null").groupBy("_scope").agg(F.sum(size).alias(size))
    visible = materialize(per_scope, "tenant-rows")
    asked = requests.withColumn("_scope", scope_key(F.col("role"), F.col(tenant)))
    joined = skew.join_small(asked, visible, ["_scope"], "left").drop("_scope")
    return joined.withColumn(size, F.coalesce(size, F.lit(0)))


def visible_rows(data: DataFrame, role: str, tenant_id: object, tenant: str = "tenant_id") -> DataFrame:
    """Rows one principal may see; the tenant filter reaches the scan."""
    if role == SUPER:
        return data
    if tenant_id is None:
        return data.limit(0)
    return data.where(F.col(tenant) == F.lit(tenant_id))


def user_listing(users: DataFrame, tenants: DataFrame, viewer_is_super: bool, tenant_id: object = None) -> DataFrame:
    """Users with their tenant name. Others than super administrators see their own
    tenant only, without super administrators and without users that have no role."""
    names = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    joined = skew.join_small(users, names, ["tenant_id"], "left")
    if not viewer_is_super:
        joined = joined.where((F.col("tenant_id") == F.lit(tenant_id)) & (F.col("role") != SUPER))
    return joined.withColumn("tenant_name", F.coalesce("tenant_name", F.lit("")))


def tenant_listing(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants each request may see: all, or its own.

    Requests are first reduced to their distinct (role, tenant) scopes.
    """
    scopes = requests.select(scope_key(F.col("role"), F.col("tenant_id")).alias("scope")).distinct()
    keys = F.explode(F.array(F.lit(EVERYTHING), F.col("id").cast("string"))).alias("scope")
    named = tenants.select(keys, F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    return scopes.join(named, "scope").select(
        (F.col("scope") == EVERYTHING).alias("all_tenants"), "tenant_id", "tenant_name"
    )


def audit_role_changes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """First rule a role change breaks, or none.

    ``requests``: operator_role, operator_tenant, target_id, new_role; ``users``: id,
    role, tenant_id.
    """
    targets = users.select(
        F.col("id").alias("target_id"), F.col("role").alias("_role"), F.col("tenant_id").alias("_tenant"),
        F.lit(True).alias("_found"),
    )
    joined = skew.join_small(requests, targets, ["target_id"], "left")
    levels = F.create_map(*[F.lit(x) for pair in K.ROLE_LEVELS.items() for x in pair])

    def level(role: Column) -> Column:
        return F.coalesce(F.try_element_at(levels, F.coalesce(role, F.lit(""))), F.lit(-1))

    operator = F.coalesce("operator_role", F.lit("viewer"))
    wanted, current = F.col("new_role"), F.col("_role")
    boss = operator == SUPER
    reason = (
        F.when(~F.coalesce(wanted.isin(list(K.ROLE_LEVELS)), F.lit(False)), "invalid role")
        .when((wanted == SUPER) & ~boss, "may not grant super admin")
        .when(F.col("_found").isNull(), "unknown user")
        .when(F.coalesce(current == SUPER, F.lit(False)) & ~boss, "may not change a super admin")
        .when(~boss & (level(current) >= level(operator)), "target not below operator")
        .when(~boss & (level(wanted) >= level(operator)), "role not below operator")
        .when(~boss & ~F.col("_tenant").eqNullSafe(F.col("operator_tenant")), "other tenant")
    )
    return joined.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop(
        "_role", "_tenant", "_found"
    )


def partial_update(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace only the columns an update provides (null means: leave as is)."""
    changed = [c for c in updates.columns if c != key]
    side = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = skew.join_small(table, side, [key], "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns]
    )


def active_principals(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active users that have a role and whose tenant is active or absent."""
    state = tenants.select(F.col("id").alias("tenant_id"), F.col("is_active").alias("_tenant_active"))
    joined = skew.join_small(users.where("is_active and role is not null"), state, ["tenant_id"], "left")
    return joined.where(F.coalesce("_tenant_active", F.lit(True))).drop("_tenant_active")


def login_outcome(attempts: DataFrame, users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Role and reason of refusal per login attempt (username, password_ok)."""
    state = tenants.select(F.col("id").alias("tenant_id"), F.col("is_active").alias("_tenant_active"))
    people = users.select("username", "role", "tenant_id", F.col("is_active").alias("_active"), F.lit(True).alias("_found"))
    people = skew.join_small(people, state, ["tenant_id"], "left")
    joined = skew.join_small(attempts, people, ["username"], "left")
    reason = (
        F.when(F.col("_found").isNull(), "unknown user")
        .when(~F.col("_active"), "user disabled")
        .when(~F.col("password_ok"), "wrong password")
        .when(F.col("tenant_id").isNotNull() & ~F.coalesce("_tenant_active", F.lit(False)), "tenant disabled")
    )
    return joined.withColumn("reason", reason).withColumn(
        "role", F.when(F.col("_found"), F.coalesce("role", F.lit("viewer")))
    ).drop("_active", "_found", "_tenant_active")
