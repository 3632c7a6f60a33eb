"""Small dimension tables used by the registered queries, with their SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.plans.sqltext import values

# id, name, code, active
TENANTS = [(i, f"tenant {i}", f"src{i}", i % 6 != 5) for i in range(18)]
# id, username, display name, role, tenant, active; some without role, name or tenant
ROLE_NAMES = ["viewer", "editor", "tenant_admin", "super_admin"]
USERS = [
    (
        i,
        f"user{i}",
        None if i % 4 == 0 else f"User {i}",
        None if i % 11 == 10 else ROLE_NAMES[3] if i % 17 == 0 else ROLE_NAMES[i % 3],
        None if i % 13 == 12 else i % 20,
        i % 9 != 8,
    )
    for i in range(60)
]
TENANT_COLS = ("id", "name", "code", "is_active")
USER_COLS = ("id", "username", "display_name", "role", "tenant_id", "is_active")
ROLES = list(zip([3, 2, 1, 0], ROLE_NAMES[::-1], strict=True))


def tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANTS, "id long, name string, code string, is_active boolean")


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        USERS,
        "id long, username string, display_name string, role string, tenant_id long, is_active boolean",
    )


SQL_TENANTS = "tenants AS (SELECT * FROM " + values(TENANTS, *TENANT_COLS) + ")"
SQL_USERS = "users AS (SELECT * FROM " + values(USERS, *USER_COLS) + ")"
