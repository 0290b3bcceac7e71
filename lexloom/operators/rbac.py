"""Role and permission queries over users, roles, permissions and their link tables.

Existence semantics throughout: several matching links count once. Superusers have every permission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def granted(user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, code, module) by roles."""
    grants = role_permissions.join(permissions.select(F.col("id").alias("permission_id"), "code", "module"), "permission_id")
    return user_roles.select("user_id", "role_id").join(grants.select("role_id", "code", "module"), "role_id").select("user_id", "code", "module").distinct()


def effective_permissions(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    every = users.where("is_superuser").select(F.col("id").alias("user_id")).crossJoin(permissions.select("code", "module"))
    return granted(user_roles, role_permissions, permissions).union(every).distinct()


def has_permission(users: DataFrame, grants: DataFrame, codes: list[str], all_of: bool = False) -> DataFrame:
    """(id, allowed): any of ``codes``, or all of them; no codes: all holds, any doesn't."""
    wanted = set(codes)
    held = grants.where(F.col("code").isin(list(wanted))).groupBy("user_id").agg(F.count_distinct("code").alias("held"))
    needed = len(wanted) if all_of else 1
    return users.join(held, users.id == held.user_id, "left").select(users.id, (F.col("is_superuser") | (F.coalesce("held", F.lit(0)) >= needed)).alias("allowed"))


def visible_rows(viewers: DataFrame, rows: DataFrame) -> DataFrame:
    """(viewer_id, row_id, sees_all) of what each viewer (id, can_view_all) may see: a line for each of their own rows, or
    one line without a row that says all. Rows times viewers are never written out."""
    own = viewers.where(~F.col("can_view_all")).join(rows, viewers.id == rows.user_id).select(viewers.id.alias("viewer_id"), rows.id.alias("row_id"), F.lit(False).alias("sees_all"))
    every = viewers.where("can_view_all").select(F.col("id").alias("viewer_id"), F.lit(None).cast(rows.schema["id"].dataType).alias("row_id"), F.lit(True).alias("sees_all"))
    return own.unionByName(every)


def visible_counts(viewers: DataFrame, rows: DataFrame) -> DataFrame:
    """(viewer_id, visible): how many rows each viewer may see; those who see none are left out."""
    seen = visible_rows(viewers, rows).groupBy("viewer_id").agg(F.bool_or("sees_all").alias("all"), F.count("row_id").alias("own"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return seen.crossJoin(F.broadcast(total)).select("viewer_id", F.when(F.col("all"), F.col("total")).otherwise(F.col("own")).alias("visible")).where("visible > 0")


def users_with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, username, roles, total): every user with sorted role codes; ``total`` counts the users."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), F.col("code").alias("role")), "role_id")
    nested = named.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    total = users.agg(F.count("*").alias("total"))
    return users.join(nested, users.id == nested.user_id, "left").crossJoin(total).select(users.id, "username", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "total")


def role_user_counts(roles: DataFrame, user_roles: DataFrame, include_system: bool = True) -> DataFrame:
    shown = roles if include_system else roles.where(~F.col("is_system"))
    n = user_roles.groupBy("role_id").agg(F.count_distinct("user_id").alias("n"))
    return shown.join(n, shown.id == n.role_id, "left").select(shown.id, "code", F.coalesce("n", F.lit(0)).alias("user_count"))


def role_details(roles: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame, include_system: bool = True) -> DataFrame:
    """(id, code, user_count, permissions): roles with how many users they have and their sorted permission codes."""
    coded = role_permissions.join(permissions.select(F.col("id").alias("permission_id"), F.col("code").alias("permission")), "permission_id")
    nested = coded.groupBy("role_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    counted = role_user_counts(roles, user_roles, include_system)
    return counted.join(nested, counted.id == nested.role_id, "left").select(counted.id, "code", "user_count", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))


def roles_in_use(roles: DataFrame, user_roles: DataFrame) -> DataFrame:
    return roles.join(user_roles.select(F.col("role_id").alias("id")), "id", "left_semi")


def permission_roles(permissions: DataFrame, role_permissions: DataFrame, roles: DataFrame, module: str | None = None) -> DataFrame:
    shown = permissions if module is None else permissions.where(F.col("module") == module)
    named = role_permissions.join(roles.select(F.col("id").alias("role_id"), F.col("code").alias("role")), "role_id")
    nested = named.groupBy("permission_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    r = F.coalesce("roles", F.array().cast("array<string>"))
    return shown.join(nested, shown.id == nested.permission_id, "left").select("module", "code", r.alias("roles"), F.size(r).alias("role_count"))


def permission_stats(permissions: DataFrame, roles: DataFrame) -> DataFrame:
    p = permissions.agg(F.count("*").alias("permissions"), F.count_distinct("module").alias("modules"), F.array_sort(F.collect_set("module")).alias("module_list"))
    return p.crossJoin(roles.agg(F.count("*").alias("roles")))


def expand_grants(roles: DataFrame, permissions: DataFrame, role: str, codes: list[str] | None = None) -> DataFrame:
    """(role_id, permission_id): all permissions to a role, or those of a list."""
    chosen = permissions if codes is None else permissions.where(F.col("code").isin(codes))
    return roles.where(F.col("code") == role).select(F.col("id").alias("role_id")).crossJoin(chosen.select(F.col("id").alias("permission_id")))
