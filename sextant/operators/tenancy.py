"""Tenants, memberships, knowledge bases, model configurations and document tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.metadata import normalize_status
from sextant.operators.ranking import best_per_key, top_per_group
from sextant.session import dealt

# --- fixed values: roles and permissions ---
PLATFORM_ADMIN = "admin"
TENANT_OWNER, TENANT_ADMIN, EMPLOYEE = "tenant_owner", "tenant_admin", "employee"
LEGACY_ROLES = {"admin": TENANT_OWNER, "user": EMPLOYEE}
PLATFORM_PERMISSIONS = ("tenant:platform", "model:switch")
OWNER_PERMISSIONS = (
    "document:upload", "document:read", "chat:ask", "tenant:employees:read", "tenant:employees:write", "tenant:admin",
)
ADMIN_PERMISSIONS = ("document:upload", "document:read", "chat:ask")
EMPLOYEE_PERMISSIONS = ("document:read", "chat:ask")
PROGRESS = {"success": 100, "failed": 100, "running": 50}
# --- end of fixed values ---


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return rows.filter(F.col("deleted") == 0)


def active_memberships(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active memberships in active tenants."""
    active = live(tenants).filter("status = 1").select("tenant_id")
    return live(memberships).filter("status = 1").join(active, "tenant_id", "left_semi")


def default_memberships(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's home membership, else the one with the lowest tenant id."""
    homes = users.select("user_id", F.col("tenant_id").alias("home_tenant"))
    ranked = memberships.join(homes, "user_id", "left").withColumn(
        "away", (~F.coalesce(F.col("tenant_id") == F.col("home_tenant"), F.lit(False))).cast("int")
    )
    return best_per_key(ranked, ["user_id"], [F.col("away"), F.col("tenant_id")]).drop("away", "home_tenant")


def employees(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Active members that are active users; order by joined_at for display."""
    people = live(users).filter("status = 1").select("user_id", "username", "display_name")
    return (
        live(memberships).filter("status = 1")
        .join(people, "user_id")
        .select("tenant_id", "user_id", "username", "display_name", normalize_role("role").alias("role"),
                F.col("created_at").alias("joined_at"))
    )


def companies(tenants: DataFrame) -> DataFrame:
    """All tenants that are not deleted; order by created_at descending for display."""
    return live(tenants).select("tenant_id", "name", "code", "status", "created_at")


def own_tenants(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants of each user with the user's role there."""
    return active_memberships(memberships, tenants).select("user_id", "tenant_id", "role").join(
        tenants.select("tenant_id", "name", "code"), "tenant_id"
    ).withColumn("role", normalize_role("role"))


def normalize_role(role) -> Column:
    value = F.lower(F.col(role) if isinstance(role, str) else role)
    out = value
    for old, new in LEGACY_ROLES.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def permissions(global_role: Column, tenant_role: Column) -> Column:
    """Distinct permissions of a user; a null tenant role gives the platform part only."""
    def listed(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    none = F.array().cast("array<string>")
    platform = F.when(F.lower(global_role) == PLATFORM_ADMIN, listed(PLATFORM_PERMISSIONS)).otherwise(none)
    role = normalize_role(tenant_role)
    tenant = (
        F.when(tenant_role.isNull(), none)
        .when(role == TENANT_OWNER, listed(OWNER_PERMISSIONS))
        .when(role == TENANT_ADMIN, listed(ADMIN_PERMISSIONS))
        .otherwise(listed(EMPLOYEE_PERMISSIONS))
    )
    return F.array_distinct(F.concat(platform, tenant))


def check_access(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests (user_id, tenant_id, group_id) with the decision and the group used."""
    member = memberships.select("user_id", "tenant_id", F.col("group_id").alias("member_group"), F.lit(True).alias("member"))
    joined = requests.join(member, ["user_id", "tenant_id"], "left")
    clash = F.col("group_id").isNotNull() & F.col("member_group").isNotNull() & (F.col("group_id") != F.col("member_group"))
    decision = (
        F.when(F.col("tenant_id").isNull(), F.lit("missing_tenant"))
        .when(F.col("member").isNull(), F.lit("no_membership"))
        .when(clash, F.lit("wrong_group"))
        .otherwise(F.lit("allowed"))
    )
    return joined.withColumn("decision", decision).withColumn(
        "effective_group", F.when(F.col("decision") == "allowed", F.coalesce("group_id", "member_group"))
    ).drop("member", "member_group")


# --- knowledge bases ---

#: Requests for all bases of a tenant that one block holds.
ALL_BLOCK = 512


def resolve_knowledge_bases(requests: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, tenant_id, kb_ref, kb_ids) to their knowledge bases.

    Explicit ids come first and must all exist; else ``all`` or blank means every base of
    the tenant, else a number is an id, else (or when no such id exists) a name. Returns
    (request_id, tenant_id, kb_id) and the unresolved request ids.
    """
    known = live(bases).select("tenant_id", F.col("kb_id").cast("string").alias("kb_id"), "name")
    cleaned = requests.select(
        "request_id",
        "tenant_id",
        F.array_distinct(
            F.filter(F.transform(F.coalesce("kb_ids", F.array().cast("array<string>")), lambda k: F.trim(k)),
                     lambda k: k.isNotNull() & (k != ""))
        ).alias("ids"),
        F.when(F.trim(F.coalesce("kb_ref", F.lit(""))) == "", F.lit("all")).otherwise(F.trim("kb_ref")).alias("ref"),
    )
    explicit = cleaned.filter(F.size("ids") > 0)
    asked = explicit.select("request_id", "tenant_id", F.size("ids").alias("need"), F.explode("ids").alias("kb_id"))
    found = asked.join(known.select("tenant_id", "kb_id"), ["tenant_id", "kb_id"])
    complete = found.groupBy("request_id", "need").agg(F.count("*").alias("got")).filter("got = need").select("request_id")
    by_list = found.join(complete, "request_id", "left_semi").select("request_id", "tenant_id", "kb_id")

    single = cleaned.filter(F.size("ids") == 0)
    # a tenant's requests are cut into blocks, each of which meets its bases: the rows of a large tenant are made by many tasks
    whole = single.filter(F.lower("ref") == "all").select("request_id", "tenant_id")
    blocks = whole.groupBy("tenant_id").agg(F.ceil(F.count("*") / ALL_BLOCK).cast("int").alias("__n"))
    asking = whole.join(blocks, "tenant_id").withColumn("__b", F.pmod(F.xxhash64("request_id"), F.col("__n")).cast("int"))
    offered = known.join(blocks, "tenant_id").select("tenant_id", "kb_id", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__b"))
    block = ["tenant_id", "__b"]
    everything = dealt(asking, block).join(dealt(offered, block), block).select("request_id", "tenant_id", "kb_id")
    one = single.filter(F.lower("ref") != "all")
    by_id = one.withColumnRenamed("ref", "kb_id").join(known, ["tenant_id", "kb_id"]).select(
        "request_id", "tenant_id", "kb_id"
    )
    unmatched = one.join(by_id.select("request_id"), "request_id", "left_anti")
    # a name stands for its first base, so a request meets one row of it
    names = known.groupBy("tenant_id", "name").agg(F.min(F.struct(F.length("kb_id").alias("n"), "kb_id")).alias("k"))
    named = unmatched.withColumnRenamed("ref", "name").join(names, ["tenant_id", "name"])
    by_name = named.groupBy("request_id", "tenant_id").agg(F.min("k").alias("k")).select(
        "request_id", "tenant_id", F.col("k.kb_id").alias("kb_id")
    )
    resolved = by_list.unionByName(everything).unionByName(by_id).unionByName(by_name)
    # an `all` request of a tenant without bases is an empty answer, not an error
    open_requests = cleaned.filter((F.size("ids") > 0) | (F.lower("ref") != "all"))
    missing = open_requests.join(resolved.select("request_id"), "request_id", "left_anti").select("request_id")
    return resolved, missing


def find_or_create_bases(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """The bases table with a row for each wanted (tenant, name) it lacked."""
    wanted = requests.select(
        "tenant_id", "group_id",
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("default")).otherwise(F.col("name")).alias("name"),
    )
    firsts = wanted.groupBy("tenant_id", "name").agg(F.min("group_id").alias("group_id"))
    new = firsts.join(bases.select("tenant_id", "name"), ["tenant_id", "name"], "left_anti")
    created = new.select(
        F.concat(F.lit("new-"), F.substring(F.sha1(F.concat_ws(":", F.col("tenant_id").cast("string"), "name")), 1, 12)).alias("kb_id"),
        "tenant_id", "group_id", "name", F.lit(0).alias("deleted"),
    )
    return bases.select(F.col("kb_id").cast("string").alias("kb_id"), "tenant_id", "group_id", "name", "deleted").unionByName(created)


# --- model configurations ---


def resolve_model_configs(requests: DataFrame, configs: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, tenant_id, model_name) to a configuration.

    The tenant's own row wins (by name, or the enabled one when no name is given), then
    the same choice among the rows of the platform administrator's tenant.
    """
    usable = live(configs)
    admin = (
        live(users).filter((F.col("role") == PLATFORM_ADMIN) & (F.col("status") == 1))
        .agg(F.min(F.struct("user_id", "tenant_id")).alias("a"))
        .select(F.col("a.tenant_id").alias("tenant_id"))
    )

    def choices(rows: DataFrame) -> DataFrame:
        by_name = rows.select("tenant_id", F.col("model_name").alias("wanted"), "config_id", "model_name")
        enabled = rows.filter("enabled = 1").select("tenant_id", F.lit("").alias("wanted"), "config_id", "model_name")
        return best_per_key(by_name.unionByName(enabled), ["tenant_id", "wanted"], [F.col("config_id")])

    options = choices(usable)
    platform = options.join(admin, "tenant_id", "left_semi").select(
        "wanted", F.col("config_id").alias("p_id"), F.col("model_name").alias("p_model")
    )
    asked = requests.withColumn("wanted", F.coalesce(F.trim("model_name"), F.lit(""))).drop("model_name")
    joined = asked.join(options, ["tenant_id", "wanted"], "left").join(platform, "wanted", "left")
    return joined.select(
        "request_id",
        "tenant_id",
        F.coalesce("config_id", "p_id").alias("config_id"),
        F.coalesce("model_name", "p_model").alias("model_name"),
        F.when(F.col("config_id").isNotNull(), F.lit("tenant"))
        .when(F.col("p_id").isNotNull(), F.lit("platform"))
        .otherwise(F.lit("default"))
        .alias("origin"),
    )


def activate_models(configs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Enable the chosen (tenant_id, model_name) and disable the tenant's other rows.

    A choice that names no live row changes nothing.
    """
    names = live(configs).select("tenant_id", "model_name").distinct()
    valid = chosen.select("tenant_id", "model_name").join(names, ["tenant_id", "model_name"], "left_semi").select(
        "tenant_id", F.col("model_name").alias("chosen")
    )
    enabled = F.when(
        F.col("chosen").isNull() | (F.col("deleted") != 0), F.col("enabled")
    ).otherwise((F.col("model_name") == F.col("chosen")).cast("int"))
    return configs.join(valid, "tenant_id", "left").withColumn("enabled", enabled).drop("chosen")


def rename_models(configs: DataFrame, provider: str, old: str, new: str) -> DataFrame:
    """Rename a provider's old model where the tenant has no other live row of the new name."""
    holders = live(configs).filter(F.col("model_name") == new).select("tenant_id").distinct().withColumn("__has", F.lit(1))
    due = (
        (F.col("deleted") == 0) & (F.lower("provider") == provider) & (F.col("model_name") == old) & F.col("__has").isNull()
    )
    return (
        configs.join(holders, "tenant_id", "left")
        .withColumn("model_name", F.when(due, F.lit(new)).otherwise(F.col("model_name")))
        .drop("__has")
    )


def map_aliases(rows: DataFrame, column: str, aliases, value: str, condition: Column) -> DataFrame:
    """Set a column to one value where it holds an alias of it (case ignored)."""
    due = condition & F.lower(column).isin(*aliases)
    return rows.withColumn(column, F.when(due, F.lit(value)).otherwise(F.col(column)))


# --- document tasks ---


def task_list(documents: DataFrame, bases: DataFrame, limit: int = 100) -> DataFrame:
    """The newest tasks of each tenant with base name and progress."""
    newest = top_per_group(live(documents), ["tenant_id"], [F.col("created_at").desc(), F.col("doc_id")], limit)
    names = bases.select("kb_id", F.col("name").alias("kb_name"))
    progress = F.lit(0)
    for status, value in PROGRESS.items():
        progress = F.when(F.col("status") == status, F.lit(value)).otherwise(progress)
    return newest.join(names, "kb_id", "left").select(
        "tenant_id",
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("task_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "file_name",
        F.coalesce("kb_name", F.col("kb_id").cast("string")).alias("knowledge_base"),
        "status",
        progress.cast("long").alias("progress"),
        F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
    )


def running_tasks(documents: DataFrame) -> DataFrame:
    return live(documents).groupBy("tenant_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("running"))


def newly_failed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tasks that failed between two snapshots."""
    open_before = before.filter(F.col("status").isin("queued", "running")).select("doc_id")
    return after.filter("status = 'failed'").join(open_before, "doc_id", "left_semi")


def apply_status_updates(documents: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest valid status per document onto the live documents; the rest is rejected.

    ``updates``: tenant_id, doc_id, status, chunk_count, error_message, updated_at.
    """
    checked = updates.withColumn("new_status", normalize_status("status"))
    latest = best_per_key(
        checked.filter(F.col("new_status").isNotNull()).withColumn("order", F.col("updated_at").cast("timestamp")),
        ["tenant_id", "doc_id"],
        [-F.unix_micros("order"), F.when(F.col("new_status").isin("success", "failed"), 0).otherwise(1)],
    ).select(
        "tenant_id", "doc_id", "new_status",
        F.col("chunk_count").alias("new_count"),
        F.substring(F.nullif("error_message", F.lit("")), 1, 1024).alias("new_error"),
        F.col("updated_at").alias("new_time"),
    )
    hit = F.col("new_status").isNotNull() & (F.col("deleted") == 0)
    applied = documents.join(latest, ["tenant_id", "doc_id"], "left").select(
        *[
            c for c in documents.columns if c not in ("status", "chunk_count", "error_message", "updated_at")
        ],
        F.when(hit, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.coalesce("new_count", "chunk_count")).otherwise(F.col("chunk_count")).alias("chunk_count"),
        F.when(hit, F.col("new_error")).otherwise(F.col("error_message")).alias("error_message"),
        F.when(hit, F.col("new_time")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return applied, checked.filter(F.col("new_status").isNull()).drop("new_status")
