"""Conversations, tenants, knowledge bases, model configurations and document tasks.

Customers stand for users, nations for tenants, suppliers for knowledge bases and model
configurations, orders for document files, conversations for chat messages.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sextant.catalog.base import table, with_ctes
from sextant.catalog.registry import query
from sextant.functions import metadata as MD
from sextant.functions.tokens import ASTRAL, TOKEN_UNIT, message_cost, estimate_tokens
from sextant.operators import conversations as C
from sextant.operators import tenancy as T
from sextant.settings import DEFAULTS

# --- conversations ---


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"),
        F.when(F.col("conv_id") % 9 == 4, 1).otherwise(0).alias("deleted"),
    )


def _est(x: str) -> str:
    unit = r"[A-Za-z0-9]{1,4}|[\x00-\x08\x0E-\x1B\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|[^\x00-\x7F]"
    return (
        f"CASE WHEN regexp_replace({x}, '\\s+', '', 'g') = '' THEN 0 ELSE len(regexp_extract_all({x}, '{unit}', 0)) "
        f"+ len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]', 0)) END"
    )


_MSGS = f"""msgs AS (
  SELECT conv_id AS session_id, turn AS position, role, text AS content, CASE WHEN conv_id % 9 = 4 THEN 1 ELSE 0 END AS deleted,
    CAST({_est('role')} + {_est('text')} + 8 AS BIGINT) AS cost FROM conversations)"""


@query("estimate_tokens", "CNV3", f"SELECT conv_id, turn, CAST({_est('text')} AS BIGINT) AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", estimate_tokens("text").cast("long").alias("tokens"))


@query(
    "session_tokens", "CNV4",
    with_ctes(_MSGS, select="SELECT session_id, CAST(sum(cost) AS BIGINT) AS history_tokens, count(*) AS n_messages FROM msgs GROUP BY session_id"),
)
def session_tokens(spark, sf_dir):
    return C.session_tokens(messages(spark, sf_dir))


@query(
    "message_history_page", "CNV1",
    with_ctes(
        _MSGS,
        select="""SELECT session_id, position, role, (SELECT count(*) FROM msgs WHERE deleted = 0) AS total FROM msgs
      WHERE deleted = 0 ORDER BY session_id DESC, position DESC LIMIT 50 OFFSET 50""",
    ),
)
def message_history_page(spark, sf_dir):
    rows = messages(spark, sf_dir).filter("deleted = 0").select("session_id", "position", "role")
    return C.history_page(rows, [F.col("session_id").desc(), F.col("position").desc()], 2, 50, 200)


@query(
    "live_session_messages", "CNV2 FLT5",
    with_ctes(_MSGS, select="SELECT session_id, position, role, content FROM msgs WHERE deleted = 0"),
)
def live_session_messages(spark, sf_dir):
    return T.live(messages(spark, sf_dir)).select("session_id", "position", "role", "content")


# a narrow context window, so that most sessions need packing
_NARROW = replace(
    DEFAULTS, compression_trigger_tokens=0, retrieval_reserve_tokens=1000, summary_reserve_tokens=1100, token_safety_margin=400
)


def plans(spark, sf_dir):
    asked = messages(spark, sf_dir).groupBy("session_id").agg(F.max_by("content", "position").alias("question"))
    sessions = C.session_tokens(messages(spark, sf_dir)).join(asked, "session_id").withColumn(
        "context_window", F.lit(1400) + F.col("session_id") % 5 * 300
    )
    return C.context_plan(sessions, _NARROW)


_PLANS = f"""totals AS (
  SELECT session_id, CAST(sum(cost) AS BIGINT) AS history_tokens, arg_max(content, position) AS question, 1400 + session_id % 5 * 300 AS win
  FROM msgs GROUP BY session_id),
sized AS (
  SELECT *, greatest(1024, win - 1000) AS token_budget, greatest(1024, CAST(floor(win * 0.8) AS BIGINT)) AS trigger_at FROM totals),
decided AS (
  SELECT *, history_tokens >= trigger_at AS compressed,
    CASE WHEN history_tokens >= trigger_at THEN least(1100, greatest(1024, token_budget // 5)) ELSE 0 END AS reserve FROM sized),
plans AS (
  SELECT session_id, history_tokens, token_budget, compressed, reserve AS summary_reserve,
    CASE WHEN compressed THEN least(greatest(0, token_budget - reserve - ({_est('question')}) - 400), greatest(1024, trigger_at - reserve))
      ELSE greatest(0, token_budget - reserve - ({_est('question')}) - 400) END AS raw_budget FROM decided)"""


@query(
    "context_plans", "CNV6",
    with_ctes(
        _MSGS, _PLANS,
        select="""SELECT session_id, history_tokens, CAST(token_budget AS BIGINT) AS token_budget, compressed,
      CAST(summary_reserve AS BIGINT) AS summary_reserve, CAST(raw_budget AS BIGINT) AS raw_budget FROM plans""",
    ),
)
def context_plans(spark, sf_dir):
    return plans(spark, sf_dir)


_BUDGETS = "budgets AS (SELECT session_id, CAST(session_id % 7 * 60 AS BIGINT) AS raw_budget FROM (SELECT DISTINCT session_id FROM msgs))"
_SELECTED = """running AS (
  SELECT m.*, b.raw_budget, sum(cost) OVER (PARTITION BY m.session_id ORDER BY position DESC) AS through,
    position = max(position) OVER (PARTITION BY m.session_id) AS newest FROM msgs m JOIN budgets b ON b.session_id = m.session_id),
chosen AS (
  SELECT session_id, position, role, CASE WHEN newest AND through > raw_budget THEN left(content, CAST(raw_budget AS INT)) ELSE content END AS content
  FROM running WHERE raw_budget > 0 AND (through <= raw_budget OR newest))"""


def _budgets(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id").distinct().withColumn(
        "raw_budget", (F.col("session_id") % 7 * 60).cast("long")
    )


@query("select_history", "CNV5", with_ctes(_MSGS, _BUDGETS, _SELECTED, select="SELECT * FROM chosen"))
def select_history(spark, sf_dir):
    return C.select_history(messages(spark, sf_dir).drop("deleted"), _budgets(spark, sf_dir))


_HEAD = (
    "'Earlier conversation summary: compressed ' || n_omitted || ' historical messages.' || chr(10) || "
    "'Retained facts, user goals, constraints, decisions, and pending tasks in chronological order:' || chr(10)"
)


@query(
    "summarize_omitted", "CNV7",
    with_ctes(
        _MSGS, _BUDGETS, _SELECTED,
        "firsts AS (SELECT session_id, min(position) AS first_kept FROM chosen GROUP BY session_id)",
        r"""omitted AS (
      SELECT m.session_id, m.position, role || ': ' || trim(regexp_replace(content, '\s+', ' ', 'g')) || chr(10) AS line
      FROM msgs m LEFT JOIN firsts f ON f.session_id = m.session_id WHERE f.first_kept IS NULL OR m.position < f.first_kept)""",
        f"costed AS (SELECT *, sum({_est('line')}) OVER (PARTITION BY session_id ORDER BY position) AS through, count(*) OVER (PARTITION BY session_id) AS n_omitted FROM omitted)",
        f"framed AS (SELECT *, {_HEAD} AS head FROM costed)",
        select=f"""SELECT session_id, n_omitted, regexp_replace(head || coalesce(string_agg(line, '' ORDER BY position) FILTER (({_est('head')}) + through <= 150), ''), '\\s+$', '') AS summary
      FROM framed GROUP BY session_id, n_omitted, head""",
    ),
)
def summarize_omitted(spark, sf_dir):
    rows = messages(spark, sf_dir).drop("deleted")
    chosen = C.select_history(rows, _budgets(spark, sf_dir))
    reserves = rows.select("session_id").distinct().withColumn("compressed", F.lit(True)).withColumn("summary_reserve", F.lit(150))
    return C.summarize_omitted(rows, chosen, reserves)


@query(
    "session_records", "CNV8",
    with_ctes(
        _MSGS,
        select="""SELECT session_id, left(arg_min(content, position) FILTER (role = 'user'), 40) AS title, max(position) AS last_position,
      count(*) AS n_messages FROM msgs GROUP BY session_id""",
    ),
)
def session_records(spark, sf_dir):
    return C.session_records(messages(spark, sf_dir))


@query(
    "delete_sessions", "CNV9",
    with_ctes(
        _MSGS,
        select="SELECT session_id, position, CASE WHEN session_id % 3 = 0 THEN 1 ELSE deleted END AS deleted FROM msgs",
    ),
)
def delete_sessions(spark, sf_dir):
    rows = messages(spark, sf_dir)
    sessions = rows.select("session_id", "deleted").distinct()
    doomed = sessions.filter("session_id % 3 = 0")
    _, marked = C.delete_sessions(sessions, rows, doomed)
    return marked.select("session_id", "position", "deleted")


# --- tenants ---


def users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("c_name").alias("username"),
        F.concat(F.lit("User "), F.col("c_custkey").cast("string")).alias("display_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("admin")).otherwise(F.lit("user")).alias("role"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("status"),
        F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0).alias("deleted"),
    )


def tenants(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.cast("long").alias("tenant_id"), F.col("n_name").alias("name"), F.concat(F.lit("T"), key.cast("string")).alias("code"),
        F.when(key % 6 == 5, 0).otherwise(1).alias("status"), F.when(key % 9 == 8, 1).otherwise(0).alias("deleted"),
        (key * 10).cast("long").alias("created_at"),
    )


def memberships(spark, sf_dir):
    """Each user in the home tenant and two more."""
    home = F.col("c_nationkey").cast("long")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array(home, (home + 7) % 25, (home + 12) % 25)).alias("tenant_id"),
        "c_mktsegment",
    )
    segment, mix = F.col("c_mktsegment"), F.col("user_id") + F.col("tenant_id")
    return rows.select(
        "user_id", "tenant_id",
        F.when(mix % 4 == 0, F.lit(None).cast("long")).otherwise(mix % 3).alias("group_id"),
        F.when(segment == "AUTOMOBILE", F.lit("Admin")).when(segment == "BUILDING", F.lit("user"))
        .when(segment == "MACHINERY", F.lit("TENANT_ADMIN")).otherwise(F.lit("employee")).alias("role"),
        F.when(mix % 5 == 0, 0).otherwise(1).alias("status"),
        F.when(mix % 13 == 0, 1).otherwise(0).alias("deleted"),
        (mix * 3).alias("created_at"),
    )


_PEOPLE = """users AS (
  SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS tenant_id, c_name AS username, 'User ' || c_custkey AS display_name,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'admin' ELSE 'user' END AS role,
    CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS status, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS deleted FROM customer),
tenants AS (
  SELECT CAST(n_nationkey AS BIGINT) AS tenant_id, n_name AS name, 'T' || n_nationkey AS code, CASE WHEN n_nationkey % 6 = 5 THEN 0 ELSE 1 END AS status,
    CASE WHEN n_nationkey % 9 = 8 THEN 1 ELSE 0 END AS deleted, CAST(n_nationkey * 10 AS BIGINT) AS created_at FROM nation),
pairs AS (
  SELECT c_custkey AS user_id, c_mktsegment, unnest([CAST(c_nationkey AS BIGINT), (c_nationkey + 7) % 25, (c_nationkey + 12) % 25]) AS tenant_id FROM customer),
memberships AS (
  SELECT user_id, tenant_id, CASE WHEN (user_id + tenant_id) % 4 = 0 THEN NULL ELSE (user_id + tenant_id) % 3 END AS group_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Admin' WHEN 'BUILDING' THEN 'user' WHEN 'MACHINERY' THEN 'TENANT_ADMIN' ELSE 'employee' END AS role,
    CASE WHEN (user_id + tenant_id) % 5 = 0 THEN 0 ELSE 1 END AS status, CASE WHEN (user_id + tenant_id) % 13 = 0 THEN 1 ELSE 0 END AS deleted,
    (user_id + tenant_id) * 3 AS created_at FROM pairs),
active AS (
  SELECT m.* FROM memberships m JOIN tenants t ON t.tenant_id = m.tenant_id
  WHERE m.status = 1 AND m.deleted = 0 AND t.status = 1 AND t.deleted = 0)"""
_ROLE = "CASE lower({0}) WHEN 'admin' THEN 'tenant_owner' WHEN 'user' THEN 'employee' ELSE lower({0}) END"


def active(spark, sf_dir):
    return T.active_memberships(memberships(spark, sf_dir), tenants(spark, sf_dir))


@query("active_memberships", "TEN1", with_ctes(_PEOPLE, select="SELECT user_id, tenant_id, role FROM active"))
def active_memberships(spark, sf_dir):
    return active(spark, sf_dir).select("user_id", "tenant_id", "role")


@query(
    "default_memberships", "TEN2",
    with_ctes(
        _PEOPLE,
        select="""SELECT user_id, tenant_id FROM (SELECT a.*, row_number() OVER (PARTITION BY a.user_id
      ORDER BY CASE WHEN a.tenant_id = u.tenant_id THEN 0 ELSE 1 END, a.tenant_id) AS rn FROM active a JOIN users u ON u.user_id = a.user_id) WHERE rn = 1""",
    ),
)
def default_memberships(spark, sf_dir):
    return T.default_memberships(active(spark, sf_dir), users(spark, sf_dir)).select("user_id", "tenant_id")


@query(
    "employee_list", "TEN3",
    with_ctes(
        _PEOPLE,
        select=f"""SELECT m.tenant_id, m.user_id, username, display_name, {_ROLE.format('m.role')} AS role, m.created_at AS joined_at
      FROM memberships m JOIN users u ON u.user_id = m.user_id WHERE m.status = 1 AND m.deleted = 0 AND u.status = 1 AND u.deleted = 0""",
    ),
)
def employee_list(spark, sf_dir):
    return T.employees(memberships(spark, sf_dir), users(spark, sf_dir))


@query(
    "user_permissions", "TEN4",
    with_ctes(
        _PEOPLE,
        select=f"""SELECT u.user_id, m.tenant_id, array_to_string(list_sort(list_concat(
      CASE WHEN u.role = 'admin' THEN ['tenant:platform', 'model:switch'] ELSE [] END,
      CASE {_ROLE.format('m.role')} WHEN 'tenant_owner' THEN ['document:upload','document:read','chat:ask','tenant:employees:read','tenant:employees:write','tenant:admin']
        WHEN 'tenant_admin' THEN ['document:upload','document:read','chat:ask'] ELSE ['document:read','chat:ask'] END)), ',') AS permissions
      FROM active m JOIN users u ON u.user_id = m.user_id""",
    ),
)
def user_permissions(spark, sf_dir):
    roles = users(spark, sf_dir).select("user_id", F.col("role").alias("global_role"))
    rows = active(spark, sf_dir).join(roles, "user_id")
    granted = T.permissions(F.col("global_role"), F.col("role"))
    return rows.select("user_id", "tenant_id", F.array_join(F.sort_array(granted), ",").alias("permissions"))


@query(
    "access_checks", "TEN5",
    with_ctes(
        _PEOPLE,
        """asks AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 25 END AS tenant_id,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 END AS group_id FROM orders)""",
        select="""SELECT request_id, CASE WHEN a.tenant_id IS NULL THEN 'missing_tenant' WHEN m.user_id IS NULL THEN 'no_membership'
      WHEN a.group_id <> m.group_id THEN 'wrong_group' ELSE 'allowed' END AS decision,
      coalesce(CASE WHEN a.tenant_id IS NOT NULL AND m.user_id IS NOT NULL AND (a.group_id = m.group_id) IS NOT FALSE THEN coalesce(a.group_id, m.group_id) END, -1) AS effective_group
      FROM asks a LEFT JOIN active m ON m.user_id = a.user_id AND m.tenant_id = a.tenant_id""",
    ),
)
def access_checks(spark, sf_dir):
    key = F.col("o_orderkey")
    asks = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), F.col("o_custkey").alias("user_id"), F.when(key % 17 != 0, key % 25).alias("tenant_id"),
        F.when(key % 3 != 0, key % 4).alias("group_id"),
    )
    return T.check_access(asks, active(spark, sf_dir)).select(
        "request_id", "decision", F.coalesce("effective_group", F.lit(-1)).alias("effective_group")
    )


@query(
    "company_list", "TEN6",
    with_ctes(_PEOPLE, select="SELECT tenant_id, name, code, status, created_at FROM tenants WHERE deleted = 0"),
)
def company_list(spark, sf_dir):
    return T.companies(tenants(spark, sf_dir))


@query(
    "own_tenants", "TEN6",
    with_ctes(
        _PEOPLE,
        select=f"SELECT a.tenant_id, a.user_id, {_ROLE.format('a.role')} AS role, t.name, t.code FROM active a JOIN tenants t ON t.tenant_id = a.tenant_id",
    ),
)
def own_tenants(spark, sf_dir):
    return T.own_tenants(memberships(spark, sf_dir), tenants(spark, sf_dir))


# --- knowledge bases and models ---


def bases(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("kb_id"), F.col("s_nationkey").cast("long").alias("tenant_id"), (key % 3).alias("group_id"),
        F.concat(F.lit("kb-"), (key % 7).cast("string")).alias("name"), F.when(key % 10 == 9, 1).otherwise(0).alias("deleted"),
    )


_BASES = """bases AS (
  SELECT s_suppkey AS kb_id, CAST(s_nationkey AS BIGINT) AS tenant_id, s_suppkey % 3 AS group_id, 'kb-' || (s_suppkey % 7) AS name,
    CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS deleted FROM supplier)"""
_REFS = """refs AS (
  SELECT c_custkey AS request_id, CAST(c_nationkey AS BIGINT) AS tenant_id,
    CASE c_custkey % 5 WHEN 0 THEN ' ALL ' WHEN 1 THEN CAST(c_custkey % 60 AS VARCHAR) WHEN 2 THEN ' kb-' || (c_custkey % 8) WHEN 3 THEN NULL ELSE 'all' END AS kb_ref,
    CASE WHEN c_custkey % 5 = 4 THEN [' ' || (c_custkey % 50), CAST(c_custkey % 50 AS VARCHAR), '', CASE WHEN c_custkey % 3 = 0 THEN CAST((c_custkey + 1) % 50 AS VARCHAR) END] ELSE [] END AS kb_ids
  FROM customer),
cleaned AS (
  SELECT request_id, tenant_id, list_distinct(list_filter(list_transform(kb_ids, lambda k: trim(k)), lambda k: k IS NOT NULL AND k <> '')) AS ids,
    CASE WHEN trim(coalesce(kb_ref, '')) = '' THEN 'all' ELSE trim(kb_ref) END AS ref FROM refs),
known AS (SELECT tenant_id, CAST(kb_id AS VARCHAR) AS kb_id, name FROM bases WHERE deleted = 0),
listed AS (SELECT c.request_id, c.tenant_id, k.kb_id, len(ids) AS need, count(*) OVER (PARTITION BY c.request_id) AS got
  FROM cleaned c JOIN known k ON k.tenant_id = c.tenant_id AND list_contains(c.ids, k.kb_id) WHERE len(ids) > 0),
resolved AS (
  SELECT request_id, kb_id FROM listed WHERE need = got
  UNION ALL SELECT c.request_id, k.kb_id FROM cleaned c JOIN known k ON k.tenant_id = c.tenant_id WHERE len(ids) = 0 AND lower(ref) = 'all'
  UNION ALL SELECT c.request_id, coalesce(
      (SELECT k.kb_id FROM known k WHERE k.tenant_id = c.tenant_id AND k.kb_id = c.ref),
      (SELECT k.kb_id FROM known k WHERE k.tenant_id = c.tenant_id AND k.name = c.ref ORDER BY length(k.kb_id), k.kb_id LIMIT 1)) AS kb_id
    FROM cleaned c WHERE len(ids) = 0 AND lower(ref) <> 'all')"""


def _refs(spark, sf_dir):
    key = F.col("c_custkey")
    text = key.cast("string")
    ref = (
        F.when(key % 5 == 0, F.lit(" ALL ")).when(key % 5 == 1, (key % 60).cast("string"))
        .when(key % 5 == 2, F.concat(F.lit(" kb-"), (key % 8).cast("string"))).when(key % 5 == 4, F.lit("all"))
    )
    listed = F.array(
        F.concat(F.lit(" "), (key % 50).cast("string")), (key % 50).cast("string"), F.lit(""),
        F.when(key % 3 == 0, ((key + 1) % 50).cast("string")),
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), ref.alias("kb_ref"),
        F.when(key % 5 == 4, listed).otherwise(F.array().cast("array<string>")).alias("kb_ids"),
    )


@query(
    "resolve_knowledge_bases", "KBR1",
    with_ctes(_BASES, _REFS, select="SELECT request_id, kb_id FROM resolved WHERE kb_id IS NOT NULL"),
)
def resolve_knowledge_bases(spark, sf_dir):
    return T.resolve_knowledge_bases(_refs(spark, sf_dir), bases(spark, sf_dir))[0].select("request_id", "kb_id")


@query(
    "unresolved_knowledge_bases", "KBR1",
    with_ctes(
        _BASES, _REFS,
        select="""SELECT request_id FROM cleaned c WHERE (len(ids) > 0 OR lower(ref) <> 'all')
      AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.request_id = c.request_id AND r.kb_id IS NOT NULL)""",
    ),
)
def unresolved_knowledge_bases(spark, sf_dir):
    return T.resolve_knowledge_bases(_refs(spark, sf_dir), bases(spark, sf_dir))[1]


@query(
    "find_or_create_bases", "KBR2",
    with_ctes(
        _BASES,
        """wanted AS (SELECT CAST(c_nationkey AS BIGINT) AS tenant_id, min(c_custkey % 3) AS group_id,
      CASE WHEN c_custkey % 9 = 0 THEN 'default' ELSE 'kb-' || (c_custkey % 9) END AS name FROM customer GROUP BY ALL)""",
        select="""SELECT CAST(kb_id AS VARCHAR) AS kb_id, tenant_id, group_id, name, deleted FROM bases
      UNION ALL SELECT 'new-' || left(sha1(w.tenant_id || ':' || w.name), 12), w.tenant_id, w.group_id, w.name, 0 FROM wanted w
      WHERE NOT EXISTS (SELECT 1 FROM bases b WHERE b.tenant_id = w.tenant_id AND b.name = w.name)""".replace("w.group_id, w.name, 0", "w.group_id, w.name, 0"),
    ).replace("GROUP BY ALL)", "GROUP BY 1, 3)"),
)
def find_or_create_bases(spark, sf_dir):
    key = F.col("c_custkey")
    asks = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("tenant_id"), (key % 3).alias("group_id"),
        F.when(key % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("kb-"), (key % 9).cast("string"))).alias("name"),
    )
    return T.find_or_create_bases(asks, bases(spark, sf_dir))


def configs(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("config_id"), F.col("s_nationkey").cast("long").alias("tenant_id"),
        F.when(key % 2 == 0, F.lit("Alpha")).otherwise(F.lit("beta")).alias("provider"),
        F.concat(F.lit("model-"), (key % 4).cast("string")).alias("model_name"),
        F.when(key % 5 == 0, 1).otherwise(0).alias("enabled"), F.when(key % 8 == 7, 1).otherwise(0).alias("deleted"),
    )


_CONFIGS = """configs AS (
  SELECT s_suppkey AS config_id, CAST(s_nationkey AS BIGINT) AS tenant_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Alpha' ELSE 'beta' END AS provider,
    'model-' || (s_suppkey % 4) AS model_name, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS enabled,
    CASE WHEN s_suppkey % 8 = 7 THEN 1 ELSE 0 END AS deleted FROM supplier)"""


@query(
    "resolve_model_configs", "CFG1",
    with_ctes(
        _PEOPLE, _CONFIGS,
        """usable AS (SELECT * FROM configs WHERE deleted = 0),
    options AS (
      SELECT tenant_id, model_name AS wanted, min(config_id) AS config_id FROM usable GROUP BY ALL
      UNION ALL SELECT tenant_id, '', min(config_id) FROM usable WHERE enabled = 1 GROUP BY ALL),
    admin AS (SELECT tenant_id FROM users WHERE role = 'admin' AND status = 1 AND deleted = 0 ORDER BY user_id LIMIT 1),
    asks AS (SELECT o_orderkey AS request_id, o_custkey % 25 AS tenant_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'model-' || (o_orderkey % 5) END AS wanted FROM orders)""",
        select="""SELECT a.request_id, coalesce(o.config_id, p.config_id, -1) AS config_id,
      CASE WHEN o.config_id IS NOT NULL THEN 'tenant' WHEN p.config_id IS NOT NULL THEN 'platform' ELSE 'default' END AS origin
      FROM asks a LEFT JOIN options o ON o.tenant_id = a.tenant_id AND o.wanted = a.wanted
      LEFT JOIN (SELECT * FROM options WHERE tenant_id = (SELECT tenant_id FROM admin)) p ON p.wanted = a.wanted""",
    ),
)
def resolve_model_configs(spark, sf_dir):
    key = F.col("o_orderkey")
    asks = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), (F.col("o_custkey") % 25).alias("tenant_id"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("model-"), (key % 5).cast("string"))).alias("model_name"),
    )
    found = T.resolve_model_configs(asks, configs(spark, sf_dir), users(spark, sf_dir))
    return found.select("request_id", F.coalesce("config_id", F.lit(-1)).alias("config_id"), "origin")


@query(
    "activate_models", "CFG2",
    with_ctes(
        _CONFIGS,
        "chosen AS (SELECT CAST(n_nationkey AS BIGINT) AS tenant_id, 'model-' || (n_nationkey % 6) AS name FROM nation)",
        select="""SELECT c.config_id, CASE WHEN c.deleted = 0 AND EXISTS (SELECT 1 FROM configs x WHERE x.deleted = 0 AND x.tenant_id = c.tenant_id AND x.model_name = h.name)
      THEN CASE WHEN c.model_name = h.name THEN 1 ELSE 0 END ELSE c.enabled END AS enabled FROM configs c JOIN chosen h ON h.tenant_id = c.tenant_id""",
    ),
)
def activate_models(spark, sf_dir):
    key = F.col("n_nationkey")
    chosen = table(spark, sf_dir, "nation").select(
        key.cast("long").alias("tenant_id"), F.concat(F.lit("model-"), (key % 6).cast("string")).alias("model_name")
    )
    return T.activate_models(configs(spark, sf_dir), chosen).select("config_id", "enabled")


@query(
    "rename_models", "CFG3",
    with_ctes(
        _CONFIGS,
        select="""SELECT c.config_id, CASE WHEN c.deleted = 0 AND lower(c.provider) = 'alpha' AND c.model_name = 'model-2' AND NOT EXISTS (
        SELECT 1 FROM configs x WHERE x.tenant_id = c.tenant_id AND x.model_name = 'model-3' AND x.deleted = 0) THEN 'model-3' ELSE c.model_name END AS model_name,
      CASE WHEN c.deleted = 0 AND lower(c.provider) IN ('beta', 'gamma') THEN 'alpha' ELSE c.provider END AS provider FROM configs c""",
    ),
)
def rename_models(spark, sf_dir):
    renamed = T.rename_models(configs(spark, sf_dir), "alpha", "model-2", "model-3")
    return T.map_aliases(renamed, "provider", ("beta", "gamma"), "alpha", F.col("deleted") == 0).select(
        "config_id", "model_name", "provider"
    )


# --- document tasks ---


def files(spark, sf_dir):
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    ends = F.array(*[F.lit(e) for e in (".pdf", ".DOCX", ".exe", ".csv", "", ".xls", ".html")])
    return table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), (F.col("o_custkey") % 25).alias("tenant_id"), (key % 120).alias("kb_id"),
        F.concat(F.lit("file"), key.cast("string"), F.element_at(ends, (key % 7 + 1).cast("int"))).alias("file_name"),
        F.when(state == "F", F.lit("success")).when(state == "O", F.lit("running"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("failed")).otherwise(F.lit("queued")).alias("status"),
        F.when(state == "F", key % 40).alias("chunk_count"), F.lit(None).cast("string").alias("error_message"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(key % 12 == 5, 1).otherwise(0).alias("deleted"),
    )


_FILES = """files AS (
  SELECT o_orderkey AS doc_id, o_custkey % 25 AS tenant_id, o_orderkey % 120 AS kb_id,
    'file' || o_orderkey || ['.pdf', '.DOCX', '.exe', '.csv', '', '.xls', '.html'][CAST(o_orderkey % 7 + 1 AS INT)] AS file_name,
    CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'queued' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 40 END AS chunk_count, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 12 = 5 THEN 1 ELSE 0 END AS deleted FROM orders)"""


@query(
    "task_list", "DOC1",
    with_ctes(
        _FILES, _BASES,
        select="""SELECT f.tenant_id, 'job-' || doc_id AS task_id, CAST(f.doc_id AS VARCHAR) AS doc_id, file_name, coalesce(b.name, CAST(f.kb_id AS VARCHAR)) AS knowledge_base, status,
      CAST(CASE status WHEN 'success' THEN 100 WHEN 'failed' THEN 100 WHEN 'running' THEN 50 ELSE 0 END AS BIGINT) AS progress,
      coalesce(chunk_count, 0) AS chunk_count
      FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, doc_id) AS newest FROM files WHERE deleted = 0) f LEFT JOIN bases b ON b.kb_id = f.kb_id WHERE newest <= 100""",
    ),
)
def task_list(spark, sf_dir):
    return T.task_list(files(spark, sf_dir), bases(spark, sf_dir))


@query(
    "running_tasks", "DOC2",
    with_ctes(_FILES, select="SELECT tenant_id, count(CASE WHEN status IN ('queued', 'running') THEN 1 END) AS running FROM files WHERE deleted = 0 GROUP BY tenant_id"),
)
def running_tasks(spark, sf_dir):
    return T.running_tasks(files(spark, sf_dir))


@query(
    "newly_failed_tasks", "DOC3",
    with_ctes(_FILES, select="SELECT doc_id FROM files WHERE status IN ('queued', 'running') AND doc_id % 5 = 1"),
)
def newly_failed_tasks(spark, sf_dir):
    before = files(spark, sf_dir)
    after = before.withColumn("status", F.when(F.col("doc_id") % 5 == 1, F.lit("failed")).otherwise(F.col("status")))
    return T.newly_failed(before, after).select("doc_id")


@query(
    "supported_files", "FLT7",
    with_ctes(_FILES, select="SELECT doc_id, file_name FROM files WHERE regexp_matches(lower(file_name), '(\\.pdf|\\.doc|\\.docx|\\.txt|\\.md|\\.csv|\\.xls|\\.xlsx)$')"),
)
def supported_files(spark, sf_dir):
    return files(spark, sf_dir).filter(MD.is_supported_file("file_name")).select("doc_id", "file_name")


_UPDATES = """raised AS (
  SELECT event_id, user_id * 7 % 1000 AS doc_id, ts, CASE event_type WHEN 'view' THEN ' Running ' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'failed'
    WHEN 'click' THEN 'queued' ELSE 'done' END AS status, CASE WHEN event_type = 'error' THEN 'reason ' || event_id ELSE '' END AS reason FROM events),
updates AS (SELECT r.*, f.tenant_id FROM raised r JOIN files f ON f.doc_id = r.doc_id)"""


def _updates(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", F.lit(" Running ")).when(kind == "purchase", F.lit("SUCCESS")).when(kind == "error", F.lit("failed"))
        .when(kind == "click", F.lit("queued")).otherwise(F.lit("done"))
    )
    raised = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") * 7 % 1000).alias("doc_id"), F.col("ts").alias("updated_at"), status.alias("status"),
        F.lit(None).cast("long").alias("chunk_count"),
        F.when(kind == "error", F.concat(F.lit("reason "), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("error_message"),
    )
    return raised.join(files(spark, sf_dir).select("doc_id", "tenant_id"), "doc_id")


@query(
    "status_updates", "STR7 FLT8",
    with_ctes(
        _FILES, _UPDATES,
        """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, doc_id ORDER BY ts DESC) AS rn FROM updates
      WHERE lower(trim(status)) IN ('queued', 'running', 'success', 'failed')) WHERE rn = 1)""",
        select="""SELECT f.doc_id, CASE WHEN l.doc_id IS NOT NULL AND f.deleted = 0 THEN lower(trim(l.status)) ELSE f.status END AS status,
      coalesce(CASE WHEN l.doc_id IS NOT NULL AND f.deleted = 0 THEN nullif(l.reason, '') END, '') AS error_message
      FROM files f LEFT JOIN latest l ON l.doc_id = f.doc_id AND l.tenant_id = f.tenant_id""",
    ),
)
def status_updates(spark, sf_dir):
    applied, _ = T.apply_status_updates(files(spark, sf_dir), _updates(spark, sf_dir))
    return applied.select("doc_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query(
    "rejected_statuses", "FLT8",
    with_ctes(_FILES, _UPDATES, select="SELECT event_id, status FROM updates WHERE lower(trim(status)) NOT IN ('queued', 'running', 'success', 'failed')"),
)
def rejected_statuses(spark, sf_dir):
    return T.apply_status_updates(files(spark, sf_dir), _updates(spark, sf_dir))[1].select("event_id", "status")
