"""The same results in SQL for DuckDB, written from the raw tables.

Apart from a few JSON texts, no query here builds a payload: presence, nulls and defects are
restated as conditions on the source columns.
"""

from __future__ import annotations

import re

from workload.derive import NAMESPACE, SECRET

# Fixed values, written out here once more so that a wrong one in the library shows.
PII_KEYWORDS = (
    ("PERSONAL", ("email", "e_mail")),
    ("PERSONAL", ("phone", "mobile", "cell_number")),
    ("PERSONAL", ("first_name", "last_name", "full_name", "display_name")),
    ("FINANCIAL", ("card_number", "card_num", "pan", "credit_card")),
    ("FINANCIAL", ("account_id", "account_number", "iban", "routing_number")),
    ("IDENTIFIER", ("ssn", "social_security", "national_id", "passport")),
    ("HEALTH", ("diagnosis", "condition", "medication", "patient_id")),
    ("PERSONAL", ("ip_address", "device_id", "user_agent")),
)
VALIDATION_MS = (1, 2, 5, 10, 25, 50, 100, 250)

# The pads of HMAC-SHA256 (RFC 2104) for a secret shorter than a block.
_BLOCK = SECRET.encode() + bytes(64 - len(SECRET.encode()))
_INNER_PAD = bytes(b ^ 0x36 for b in _BLOCK)
_OUTER_PAD = bytes(b ^ 0x5C for b in _BLOCK)

# ---------------------------------------------------------------------------------------------
# shared parts


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


MESSAGES = """
m AS (
  SELECT event_id, ts, event_type, 'events.' || event_type AS topic, value, user_id, props,
    CASE WHEN value >= 2 AND value < 2.5 THEN '' ELSE 'svc-' || user_id END AS producer_id,
    CAST(user_id AS VARCHAR) AS key,
    CASE WHEN value < 20 THEN '' WHEN value < 50 THEN '1.0.0' ELSE '0.9.0' END AS declared,
    (value >= 30 AND value < 31.5) AS malformed,
    CASE WHEN value < 5 THEN 'absent' WHEN value >= 60 THEN 'null' ELSE 'number' END AS amount
  FROM events)
"""

# violations in rule order: v1 then v2, as 'TYPE:field' and 'field: message'
VALIDATED = MESSAGES + """,
r AS (
  SELECT *,
    CASE WHEN producer_id = '' THEN 'topic, contract_id, and producer_id are required'
         WHEN event_type <> 'error' AND malformed THEN 'validation failed' END AS error
  FROM m),
a AS (
  SELECT *,
    CASE WHEN error IS NOT NULL THEN NULL
         WHEN event_type = 'error' THEN 'NO_CONTRACT_FOR_TOPIC'
         WHEN event_type = 'purchase' THEN 'POLICY_BREACH'
         WHEN event_type = 'click' AND amount = 'absent' THEN 'MISSING_REQUIRED_FIELD'
         WHEN event_type = 'click' AND amount = 'null' THEN 'TYPE_MISMATCH'
         WHEN event_type = 'view' AND amount = 'absent' THEN 'MISSING_REQUIRED_FIELD'
         WHEN event_type = 'view' AND amount = 'null' THEN 'TYPE_MISMATCH'
    END AS t0,
    CASE WHEN error IS NULL AND event_type = 'purchase' AND amount = 'absent'
           THEN 'MISSING_REQUIRED_FIELD'
         WHEN error IS NULL AND event_type = 'purchase' AND amount = 'null'
           THEN 'TYPE_MISMATCH' END AS t_amount
  FROM r),
v AS (
  SELECT *,
    -- the schema's own rule on amount comes before the policy on user.email
    CASE WHEN event_type = 'purchase' AND t_amount IS NOT NULL THEN t_amount ELSE t0 END AS t1,
    CASE WHEN event_type = 'purchase' AND t_amount IS NOT NULL THEN t0 END AS t2,
    CASE WHEN t0 IS NULL THEN NULL
         WHEN event_type = 'error' THEN NULL
         WHEN event_type = 'purchase' AND t_amount IS NULL THEN 'user.email'
         ELSE 'amount' END AS f1,
    CASE WHEN event_type = 'purchase' AND t_amount IS NOT NULL THEN 'user.email' END AS f2
  FROM a),
w AS (
  SELECT *,
    CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN t1 IS NOT NULL THEN 'REJECTED'
         ELSE 'ACCEPTED' END AS status,
    CASE t1 WHEN 'NO_CONTRACT_FOR_TOPIC' THEN 'no active contract found for topic'
            WHEN 'POLICY_BREACH' THEN 'field "' || f1 || '" is classified PERSONAL but has no masking_op in contract'
            WHEN 'MISSING_REQUIRED_FIELD' THEN 'required field "' || f1 || '" is absent'
            WHEN 'TYPE_MISMATCH' THEN 'field "' || f1 || '" is required but null' END AS m1,
    CASE WHEN t2 IS NOT NULL THEN 'field "user.email" is classified PERSONAL but has no masking_op in contract' END AS m2,
    (event_type <> 'error' AND declared <> '' AND declared <> '1.0.0') AS version_mismatch
  FROM v)
"""

DETAIL = """CASE WHEN t1 IS NULL THEN '' ELSE coalesce(f1, 'message') || ': ' || m1
  || CASE WHEN t2 IS NULL THEN '' ELSE '; ' || f2 || ': ' || m2 END END"""


def hmac(message: str) -> str:
    """HMAC-SHA256 as hex of a BLOB expression."""
    lit = lambda raw: f"unhex('{raw.hex()}')"
    inner = f"unhex(sha256({lit(_INNER_PAD)} || {message}))"
    return f"sha256({lit(_OUTER_PAD)} || {inner})"


def token(namespace: str, value: str) -> str:
    message = f"(encode({namespace}) || unhex('00') || encode({value}))"
    return f"('tok_' || left({hmac(message)}, 32))"


def pii(text: str) -> str:
    groups = [
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in PII_KEYWORDS
    ]
    return "CASE " + " ".join(groups) + " END"


# every object path of a payload: path, kind
FIELDS = """
f AS (
  SELECT event_id, topic, event_type, ts, amount, path, kind FROM good, (VALUES
    ('event_id', 'number'), ('user', 'object'), ('user.id', 'string'), ('user.email', 'string'),
    ('tags', 'array'), ('props', 'object'), ('props.k', 'number'), ('amount', '?')) p(path, kind0),
    LATERAL (SELECT CASE WHEN path = 'amount' THEN amount ELSE kind0 END AS kind) k
  WHERE kind <> 'absent')
"""
GOOD = "good AS (SELECT * FROM m WHERE NOT malformed)"

# consumed messages: audit copies and violation reports
AUDIT = """
good AS (SELECT * FROM m WHERE event_type <> 'error' AND NOT malformed
         AND NOT (value >= 50 AND value < 55)),
audit AS (SELECT * FROM m WHERE event_type <> 'error' AND NOT (value >= 50 AND value < 55)),
producers AS (SELECT event_id, CASE WHEN value < 3 THEN 'unknown' ELSE 'svc-' || user_id END
              AS producer FROM m),
reports AS (SELECT * FROM m WHERE event_type = 'error' AND NOT (value >= 40 AND value < 50))
"""

VERSIONS = """
versions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS contract_id,
    concat_ws('.', CAST(year(o_orderdate) - 1990 AS VARCHAR),
      CAST(CAST(left(o_orderpriority, 1) AS INT) - 1 AS VARCHAR),
      CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END) AS version,
    CASE o_orderstatus WHEN 'F' THEN 'DEPRECATED' WHEN 'O' THEN 'ACTIVE' ELSE 'DRAFT' END AS status,
    o_orderdate AS created_at, o_orderstatus, o_totalprice,
    CAST(left(o_orderpriority, 1) AS INT) AS level,
    ['BACKWARD', 'FORWARD', 'FULL', 'BACKWARD_TRANSITIVE', 'NONE']
      [CAST(left(o_orderpriority, 1) AS INT)] AS mode,
    year(o_orderdate) - 1990 AS major, CAST(left(o_orderpriority, 1) AS INT) - 1 AS minor,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS patch
  FROM orders)
"""
LATEST = """
latest AS (
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY created_at DESC, id) = 1)
"""
# field lists of stored versions, one row per field
VERSION_FIELDS = """
version_fields AS (
  SELECT id, 'order_id' AS name, '"long"' AS type, false AS has_default, true AS required FROM versions
  UNION ALL
  SELECT id, 'total', CASE WHEN o_totalprice < 300000 THEN '"double"' ELSE '["null","double"]' END,
    o_orderstatus = 'O', o_totalprice >= 200000 FROM versions
  UNION ALL
  SELECT id, 'priority', '"string"', o_orderstatus = 'F', false FROM versions WHERE level <= 3)
"""
PROPOSALS = """
proposals AS (
  SELECT 'chg-' || c_custkey AS change_id, CAST(c_custkey AS VARCHAR) AS contract_id,
    (c_mktsegment = 'HOUSEHOLD' AND c_acctbal >= 9000) AS unknown,
    (c_acctbal >= 3000 AND c_acctbal < 3200) AS malformed,
    CASE WHEN c_acctbal >= 2000 THEN 'AVRO' WHEN c_acctbal >= 0 THEN 'JSON_SCHEMA'
         WHEN c_nationkey < 10 THEN 'PROTOBUF' ELSE 'THRIFT' END AS format,
    c_acctbal, c_nationkey, c_mktsegment FROM customer),
avro_new AS (
  SELECT change_id, 'order_id' AS name,
    CASE WHEN c_nationkey < 20 THEN '"long"' ELSE '"string"' END AS type, false AS has_default
  FROM proposals
  UNION ALL
  SELECT change_id, 'total', '"double"', c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
  FROM proposals WHERE c_acctbal < 8000
  UNION ALL SELECT change_id, 'priority', '"string"', false FROM proposals WHERE c_nationkey >= 5
  UNION ALL SELECT change_id, 'note', '"string"', c_acctbal < 5000 FROM proposals),
json_new AS (
  SELECT change_id, 'order_id' AS name, true AS required FROM proposals
  UNION ALL SELECT change_id, 'priority', c_mktsegment = 'MACHINERY' FROM proposals
    WHERE c_nationkey >= 5
  UNION ALL SELECT change_id, 'total', c_mktsegment = 'MACHINERY' FROM proposals
    WHERE c_mktsegment <> 'FURNITURE'
  UNION ALL SELECT change_id, 'note', c_acctbal < 500 FROM proposals)
"""
PAIRS = """
pairs AS (
  SELECT p.*, l.id AS version_id, l.mode FROM proposals p
  LEFT JOIN latest l ON NOT p.unknown AND l.contract_id = p.contract_id),
avro_pairs AS (
  SELECT coalesce(o.change_id, n.change_id) AS change_id, coalesce(o.name, n.name) AS name,
    o.type AS old_type, n.type AS new_type, o.has_default AS old_default,
    n.has_default AS new_default, o.name IS NULL AS added, n.name IS NULL AS removed
  FROM (SELECT p.change_id, f.* FROM pairs p JOIN version_fields f ON f.id = p.version_id
        WHERE format = 'AVRO' AND NOT malformed) o
  FULL JOIN (SELECT n.* FROM avro_new n JOIN pairs p USING (change_id)
        WHERE format = 'AVRO' AND NOT malformed AND version_id IS NOT NULL) n
    ON o.change_id = n.change_id AND o.name = n.name),
json_pairs AS (
  SELECT coalesce(o.change_id, n.change_id) AS change_id, coalesce(o.name, n.name) AS name,
    o.required AS was, n.required AS now, o.name IS NULL AS added, n.name IS NULL AS removed
  FROM (SELECT p.change_id, f.* FROM pairs p JOIN version_fields f ON f.id = p.version_id
        WHERE format = 'JSON_SCHEMA') o
  FULL JOIN (SELECT n.* FROM json_new n JOIN pairs p USING (change_id)
        WHERE format = 'JSON_SCHEMA' AND version_id IS NOT NULL) n
    ON o.change_id = n.change_id AND o.name = n.name)
"""


def avro_changes(pairs: str, mode: str, key: str) -> str:
    """Change rows of Avro field pairs."""
    return f"""
  SELECT {key}, name AS field, 'FIELD_REMOVED' AS change_type,
    'field "' || name || '" removed from schema' AS description,
    CASE WHEN old_default THEN 'COMPATIBLE' ELSE 'BREAKING' END AS severity
  FROM {pairs} WHERE removed
  UNION ALL SELECT {key}, name, 'FIELD_ADDED', 'field "' || name || '" added to schema',
    CASE WHEN NOT new_default AND {mode} = 'BACKWARD' THEN 'BREAKING' ELSE 'COMPATIBLE' END
  FROM {pairs} WHERE added
  UNION ALL SELECT {key}, name, 'TYPE_CHANGED',
    'field "' || name || '" type changed from ' || old_type || ' to ' || new_type, 'BREAKING'
  FROM {pairs} WHERE NOT added AND NOT removed AND old_type <> new_type
  UNION ALL SELECT {key}, name, 'DEFAULT_REMOVED',
    'field "' || name || '" default value removed', 'COMPATIBLE'
  FROM {pairs} WHERE NOT added AND NOT removed AND old_default AND NOT new_default"""


CHANGES = f"""
avro_moded AS (SELECT a.*, p.mode FROM avro_pairs a JOIN pairs p USING (change_id)),
changes AS ({avro_changes("avro_moded", "mode", "change_id")}
  UNION ALL SELECT change_id, name, 'FIELD_REMOVED', 'property "' || name || '" removed',
    CASE WHEN was THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM json_pairs WHERE removed
  UNION ALL SELECT change_id, name, 'FIELD_ADDED', 'property "' || name || '" added',
    CASE WHEN now THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM json_pairs WHERE added
  UNION ALL SELECT change_id, name, 'REQUIRED_ADDED',
    'property "' || name || '" is now required (was optional)', 'BREAKING'
  FROM json_pairs WHERE NOT added AND NOT removed AND now AND NOT was)
"""
OBSERVED = """
observed AS (
  SELECT 'orders.' || o_custkey AS source_topic, s_name AS consumer_name,
    CASE l_returnflag WHEN 'A' THEN 'FLINK_JOB' WHEN 'N' THEN 'ICEBERG_TABLE'
      ELSE 'KAFKA_CONSUMER' END AS consumer_type,
    CASE WHEN s_nationkey < 5 THEN NULL WHEN s_nationkey < 8 THEN ''
      ELSE 'team-' || s_nationkey END AS consumer_team,
    l_shipdate AS seen_at, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
edges AS (
  SELECT source_topic, consumer_name, min(consumer_type) AS consumer_type,
    max(consumer_team) AS consumer_team, max(seen_at) AS last_seen_at
  FROM observed GROUP BY ALL)
"""
DECISIONS = """
classes AS (
  SELECT p.change_id, p.contract_id, p.format,
    CASE WHEN version_id IS NULL THEN NULL
         WHEN format = 'AVRO' AND malformed
           THEN 'schema analysis failed: parsing proposed avro schema'
         WHEN format = 'THRIFT'
           THEN 'schema analysis failed: unsupported schema format: THRIFT' END AS error,
    count(c.field) AS n_changes, count(c.field) FILTER (severity = 'BREAKING') AS n_breaking
  FROM pairs p LEFT JOIN changes c USING (change_id) GROUP BY ALL),
decided AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN n_breaking > 0 THEN 'BREAKING'
    WHEN n_changes > 0 THEN 'COMPATIBLE' ELSE 'SAFE' END AS classification FROM classes),
per_topic AS (
  SELECT source_topic, count(*) AS n,
    coalesce(string_agg(DISTINCT nullif(consumer_team, ''), ',' ORDER BY nullif(consumer_team, '')), '')
      AS teams
  FROM edges GROUP BY source_topic),
decisions AS (
  SELECT d.*, coalesce(t.n, 0) AS n, coalesce(t.teams, '') AS all_teams
  FROM decided d LEFT JOIN per_topic t ON t.source_topic = 'orders.' || d.contract_id)
"""
GATE = (VERSIONS, LATEST, VERSION_FIELDS, PROPOSALS, PAIRS, CHANGES, OBSERVED, DECISIONS)

HISTORY = f"""
ordered AS (
  SELECT *, lag(id) OVER o AS prev_id, lag(version) OVER o AS previous_version,
    lag(mode) OVER o AS old_mode, lag(major) OVER o AS pma, lag(minor) OVER o AS pmi,
    lag(patch) OVER o AS ppa
  FROM versions WINDOW o AS (PARTITION BY contract_id ORDER BY created_at, id)),
both_fields AS (
  SELECT h.id AS change_of, h.old_mode, o.name AS old_name, o.type AS old_type,
    o.has_default AS old_default
  FROM ordered h JOIN version_fields o ON o.id = h.prev_id),
new_fields AS (
  SELECT h.id AS change_of, h.old_mode, n.name AS new_name, n.type AS new_type,
    n.has_default AS new_default
  FROM ordered h JOIN version_fields n ON n.id = h.id WHERE h.prev_id IS NOT NULL),
history_pairs AS (
  SELECT coalesce(o.change_of, n.change_of) AS id, coalesce(o.old_mode, n.old_mode) AS old_mode,
    coalesce(old_name, new_name) AS name, old_type, new_type, old_default, new_default,
    old_name IS NULL AS added, new_name IS NULL AS removed
  FROM both_fields o FULL JOIN new_fields n ON o.change_of = n.change_of AND old_name = new_name),
history_changes AS ({avro_changes("history_pairs", "old_mode", "id")})
"""

REF = lambda kind, prefix, key: f"'{kind}:{NAMESPACE}:{prefix}.' || {key}"
LINE = "l_orderkey || '-' || l_linenumber"
NODES = f"""
nodes AS (
  SELECT {REF('dataset', 'region', 'r_name')} AS id, 'DATASET' AS node_type,
    'region.' || r_name AS name, 'geo' AS owner_team, ['name'] AS fields FROM region
  UNION ALL SELECT {REF('job', 'nation', 'n_name')}, 'JOB', 'nation.' || n_name, 'geo', []
  FROM nation
  UNION ALL SELECT {REF('job', 'customer', 'c_custkey')}, 'JOB', 'customer.' || c_custkey,
    c_mktsegment, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN [] WHEN 'BUILDING'
      THEN ['name', 'acctbal'] ELSE ['name'] END FROM customer
  UNION ALL SELECT {REF('job', 'supplier', 's_suppkey')}, 'JOB', 'supplier.' || s_suppkey,
    CASE WHEN s_nationkey < 5 THEN NULL WHEN s_nationkey < 8 THEN ''
      ELSE 'team-' || s_nationkey END, ['acctbal'] FROM supplier
  UNION ALL SELECT {REF('dataset', 'order', 'o_orderkey')}, 'DATASET', 'order.' || o_orderkey,
    o_orderpriority, CASE o_orderstatus WHEN 'F' THEN ['totalprice', 'status']
      ELSE ['status'] END FROM orders
  UNION ALL SELECT {REF('dataset', 'line', LINE)}, 'DATASET', 'line.' || {LINE},
    max(l_linestatus), max(CASE l_returnflag WHEN 'R' THEN ['quantity', 'tax'] ELSE [] END)
  FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
GRAPH = f"""
graph AS (
  SELECT {REF('dataset', 'region', 'r_name')} AS src, {REF('job', 'nation', 'n_name')} AS dst
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {REF('job', 'nation', 'n_name')}, {REF('job', 'customer', 'c_custkey')}
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {REF('job', 'nation', 'n_name')}, {REF('job', 'supplier', 's_suppkey')}
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT {REF('job', 'customer', 'o_custkey')}, {REF('dataset', 'order', 'o_orderkey')}
  FROM orders
  UNION ALL SELECT {REF('dataset', 'order', 'l_orderkey')}, {REF('dataset', 'line', LINE)}
  FROM lineitem
  UNION ALL SELECT {REF('job', 'supplier', 'l_suppkey')}, {REF('dataset', 'line', LINE)}
  FROM lineitem)
"""
REQUESTS = f"""
requests AS (
  SELECT 'region-' || r_regionkey AS change_id, 'region.' || r_name AS topic,
    CASE r_regionkey WHEN 0 THEN ['totalprice'] WHEN 1 THEN ['acctbal', 'quantity']
      WHEN 2 THEN ['tax'] WHEN 3 THEN ['name'] ELSE ['missing_field'] END AS changed,
    {REF('dataset', 'region', 'r_name')} AS source FROM region
  UNION ALL
  SELECT 'nation-' || n_nationkey,
    CASE WHEN n_nationkey = 24 THEN 'nation.nowhere' ELSE 'nation.' || n_name END,
    ['acctbal', 'status'],
    CASE WHEN n_nationkey <> 24 THEN {REF('job', 'nation', 'n_name')} END FROM nation)
"""
WALK = """
walk AS (
  SELECT DISTINCT source, source AS node, 0 AS depth, [source] AS path FROM requests
  WHERE source IS NOT NULL
  UNION ALL
  SELECT w.source, g.dst, w.depth + 1, list_append(w.path, g.dst)
  FROM walk w JOIN graph g ON g.src = w.node WHERE w.depth < 5),
nearest AS (SELECT source, node, min(depth) AS depth FROM walk GROUP BY ALL),
reached AS (
  SELECT w.source, w.node, w.depth, min(w.path) AS path
  FROM walk w JOIN nearest n USING (source, node, depth) WHERE w.depth > 0 GROUP BY ALL)
"""
SCORED = """
touched AS (
  SELECT r.change_id, n.name, n.node_type, n.owner_team, x.depth, n.fields,
    list_sort(list_intersect(n.fields, r.changed)) AS affected
  FROM requests r JOIN reached x USING (source) JOIN nodes n ON n.id = x.node),
scored AS (
  SELECT *, CASE WHEN len(fields) = 0 THEN CASE WHEN depth = 1 THEN 'MEDIUM' ELSE 'NONE' END
    WHEN len(affected) > 0 THEN 'CRITICAL' WHEN depth = 1 THEN 'HIGH' ELSE 'NONE' END AS impact
  FROM touched)
"""
IMPACT = (REQUESTS, NODES, GRAPH, WALK, SCORED)

ORACLES: dict[str, str] = {}


def oracle(name: str, *parts: str) -> None:
    *ctes, select = parts
    ORACLES[name] = (with_(*ctes) if ctes else "") + select.strip()


# --- validation -------------------------------------------------------------------------------

oracle("validate_events", VALIDATED, f"""
SELECT event_id, topic, status, error, version_mismatch,
  CASE WHEN t1 IS NULL THEN '' ELSE concat_ws(':', t1, f1) END
    || CASE WHEN t2 IS NULL THEN '' ELSE ',' || concat_ws(':', t2, f2) END AS violations,
  {DETAIL} AS detail
FROM w""")
oracle("contract_check_summary", VALIDATED, """
SELECT topic, status, t1 AS first_violation, count(*) AS n FROM w GROUP BY ALL""")
oracle("first_violation", VALIDATED, """
SELECT event_id, t1 AS type, f1 AS field, m1 AS message FROM w""")
oracle("accepted_by_topic", VALIDATED, """
SELECT topic, count(*) AS n FROM w WHERE status = 'ACCEPTED' GROUP BY topic""")
oracle("rejected_by_topic", VALIDATED, """
SELECT topic, t1 AS violation_type, count(*) AS n FROM w WHERE status = 'REJECTED' GROUP BY ALL""")
oracle("version_mismatch", VALIDATED, """
SELECT topic, count(*) FILTER (version_mismatch) AS n FROM w GROUP BY topic""")
oracle("processing_errors", VALIDATED, """
SELECT error, count(*) AS n,
  count(*) FILTER (error IS NULL AND event_type = 'error') AS lookup_errors
FROM w GROUP BY error""")
oracle("attach_contract", """
SELECT 'events.' || event_type AS topic, count(*) AS messages,
  count(*) FILTER (event_type <> 'error') AS with_contract,
  CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
    WHEN 'view' THEN 4 ELSE 0 END AS rules,
  CASE WHEN event_type <> 'error' THEN '1.0.0' END AS version
FROM events GROUP BY event_type""")
oracle("freshness", VALIDATED, """,
seen AS (SELECT event_type, max(ts) AS fetched FROM m GROUP BY ALL),
kept AS (
  SELECT event_type, stale, NOT stale OR event_type IN ('click', 'view') AS usable
  FROM (SELECT event_type,
      epoch((SELECT max(ts) FROM m)) - epoch(fetched) >= 600 AS stale FROM seen)
  WHERE event_type <> 'error')
SELECT topic,
  count(*) FILTER (coalesce(usable, false)) AS with_contract,
  count(*) FILTER (coalesce(usable AND stale, false)) AS stale,
  count(*) FILTER (producer_id <> '' AND CASE WHEN coalesce(usable, false)
    THEN status = 'REJECTED' ELSE true END) AS rejected
FROM w LEFT JOIN kept USING (event_type) GROUP BY topic""")
oracle("parse_envelope", MESSAGES, """,
n AS (
  SELECT *, value >= 31 AND value < 31.5 AS doubled, value >= 30 AND value < 31 AS broken
  FROM m)
SELECT event_id, CASE WHEN broken OR doubled THEN '' ELSE topic END AS topic,
  CASE WHEN broken OR doubled THEN '' ELSE producer_id END AS producer_id,
  CASE WHEN broken OR doubled THEN '' ELSE key END AS key,
  CASE WHEN broken OR doubled THEN 'invalid request body'
       WHEN producer_id = '' THEN 'topic, contract_id, and producer_id are required' END
    AS envelope_error,
  CASE WHEN NOT (broken OR doubled) THEN event_id END AS inner_id,
  CASE WHEN NOT (broken OR doubled) AND amount = 'number' THEN value END AS amount
FROM n""")

# --- documents --------------------------------------------------------------------------------

oracle("json_presence", MESSAGES, """
SELECT event_id, path,
  CASE WHEN malformed THEN false WHEN path = 'amount' THEN amount <> 'absent'
    ELSE kind IS NOT NULL END AS present,
  NOT malformed AND path = 'amount' AND amount = 'null' AS is_null,
  CASE WHEN malformed THEN NULL WHEN path = 'amount' THEN nullif(amount, 'absent')
    ELSE kind END AS kind
FROM m, (VALUES ('amount', NULL), ('user.email', 'string'), ('user.none', NULL),
  ('tags', 'array'), ('tags.pan', NULL), ('event_id.x', NULL), ('props.k', 'number')) p(path, kind)""")
oracle("path_set", MESSAGES, """
SELECT event_id, CASE WHEN NOT malformed THEN 'hidden' END AS email,
  CASE WHEN NOT malformed THEN 'u' || user_id END AS user_id,
  CASE WHEN NOT malformed THEN event_id END AS inner_id
FROM m""")
oracle("collect_paths", MESSAGES, GOOD, FIELDS, "SELECT event_id, path FROM f")
oracle("extract_fields", MESSAGES, GOOD, FIELDS, """
SELECT event_id, path, kind AS value_type, kind = 'null' AS nullable, true AS present FROM f""")
oracle("deep_fields", """
SELECT event_id, event_id % 8 + 2 AS n, 'd' || repeat('.d', CAST(event_id % 8 AS INT)) AS deepest,
  false AS whole_cut, least(event_id % 8 + 1, 5) + 1 AS n_at_five, event_id % 8 > 4 AS truncated
FROM events""")
oracle("top_level_keys", MESSAGES, """
SELECT event_id, CASE WHEN malformed THEN NULL WHEN amount = 'absent'
  THEN 'event_id,props,tags,user' ELSE 'amount,event_id,props,tags,user' END AS keys FROM m""")
oracle("canonical_compare",
       "SELECT 'chg-' || c_custkey AS change_id, "
       "c_custkey % 3 <> 0 OR (c_acctbal >= 3000 AND c_acctbal < 3200) AS same FROM customer")

# --- masking ----------------------------------------------------------------------------------

oracle("value_masks", f"""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '[REDACTED]' END AS redacted,
  repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked,
  repeat('*', length(CAST(c_nationkey AS VARCHAR))) AS short,
  {token('c_mktsegment', 'c_name')} AS token
FROM customer""")

# view: amount must be text to be tokenized, so a number blocks the message; absence and null
# reject it. Nothing else of that topic is accepted.
MASKED = """
k AS (
  SELECT *,
    CASE WHEN status = 'ACCEPTED' AND event_type = 'view'
      THEN 'masking field "amount": TOKENIZE needs a string, got number' END AS masking_error,
    length('u' || user_id || '@example.com') AS email_size
  FROM w),
o AS (
  SELECT *, CASE WHEN masking_error IS NOT NULL THEN 'ERROR' ELSE status END AS outcome FROM k)
"""
oracle("contract_outcomes_rows", VALIDATED, MASKED, f"""
SELECT event_id, outcome, coalesce(error, masking_error) AS error,
  CASE WHEN status = 'REJECTED' THEN {DETAIL} END AS detail,
  CASE WHEN outcome <> 'ACCEPTED' THEN NULL WHEN event_type = 'signup' THEN 'user.email,user.id'
       ELSE '' END AS transformed,
  CASE WHEN outcome <> 'ACCEPTED' THEN NULL
       WHEN event_type = 'signup' THEN repeat('*', email_size - 4) || '.com'
       ELSE 'u' || user_id || '@example.com' END AS email,
  CASE WHEN outcome <> 'ACCEPTED' THEN NULL
       WHEN event_type = 'signup' THEN {token("'FINANCIAL'", "'u' || user_id")}
       ELSE 'u' || user_id END AS user_id,
  CAST(NULL AS VARCHAR) AS "user"
FROM o""")
oracle("outcome_split", VALIDATED, MASKED, """
SELECT topic, CASE outcome WHEN 'ACCEPTED' THEN 'forwarded' ELSE 'rejected' END AS sink,
  count(*) AS n
FROM o WHERE outcome <> 'ERROR' GROUP BY ALL""")
ORACLES["written_outcomes"] = ORACLES["outcome_split"]
oracle("masking_totals", VALIDATED, MASKED, """
SELECT topic,
  coalesce(sum(CASE WHEN status = 'ACCEPTED' AND event_type = 'signup' THEN 2 END), 0)
    AS fields_transformed,
  count(*) FILTER (masking_error IS NOT NULL) AS failures,
  count(*) FILTER (outcome = 'ACCEPTED' AND event_type <> 'signup') AS pattern_warnings
FROM o GROUP BY topic""")
oracle("scan_pii", VALIDATED, MASKED, """
SELECT event_id, 'user.email' AS path, 'PERSONAL' AS pii_class, true AS from_pattern
FROM o WHERE outcome = 'ACCEPTED' AND event_type <> 'signup'""")
oracle("detect_pii", f"SELECT doc_id, {pii('text')} AS pii_class FROM documents")

# --- registry ---------------------------------------------------------------------------------

oracle("active_version", VERSIONS, """
SELECT 'orders.' || contract_id AS topic, id, version, status FROM versions
WHERE status = 'ACTIVE' AND contract_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY created_at DESC, id) = 1""")
oracle("list_active_versions", VERSIONS, """
SELECT id, contract_id, version FROM versions WHERE status = 'ACTIVE'""")
oracle("ranked_active_versions", VERSIONS, """
SELECT id, contract_id,
  row_number() OVER (PARTITION BY contract_id ORDER BY created_at DESC, id) AS place
FROM versions WHERE status = 'ACTIVE'""")
oracle("indexed_fields", """
SELECT c_custkey, 'a' AS name, CASE WHEN c_nationkey < 12 THEN 'long' ELSE 'string' END AS type,
  c_acctbal > 0 AS has_default FROM customer
UNION ALL SELECT c_custkey, 'b', 'string', true FROM customer""")
oracle("latest_version", VERSIONS, LATEST, "SELECT contract_id, id, version, status FROM latest")
oracle("contract_by_name", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'orders.' || c_custkey AS topic,
  c_mktsegment AS owner_team
FROM customer WHERE NOT (c_mktsegment = 'HOUSEHOLD' AND c_acctbal >= 9000)""")
oracle("downstream_edges", OBSERVED, """
SELECT consumer_name, consumer_type, consumer_team FROM edges WHERE source_topic = 'orders.1'""")
oracle("field_policies", """
SELECT CAST(s_nationkey AS VARCHAR) AS contract_id, lower(s_name) AS field_path,
  CASE WHEN s_acctbal > 0 THEN 'MASK' ELSE 'REDACT' END AS policy_type
FROM supplier WHERE s_nationkey = 7""")
oracle("enforcement_rules", VERSIONS, """,
active AS (
  SELECT * FROM versions WHERE status = 'ACTIVE'
    AND contract_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
  QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY created_at DESC, id) = 1),
policies AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS contract_id,
    lower(substr(o_orderpriority, 3, 20)) AS path,
    CASE WHEN left(o_orderpriority, 1) < '3' THEN 'MASK' ELSE '' END AS masking_op FROM orders)
SELECT 'orders.' || contract_id AS topic, version, false AS fail_open, path, true AS required,
  'PERSONAL' AS pii_class, masking_op
FROM active JOIN policies USING (contract_id)""")
oracle("activate_version", VERSIONS, LATEST, """
SELECT v.id, v.contract_id, CASE WHEN v.id = l.id THEN 'ACTIVE'
  WHEN v.status = 'ACTIVE' THEN 'DEPRECATED' ELSE v.status END AS status
FROM versions v JOIN latest l USING (contract_id)""")
oracle("insert_version", VERSIONS, """
SELECT id, contract_id, version FROM versions v
WHERE o_totalprice < 250000 AND NOT EXISTS (SELECT 1 FROM versions s
  WHERE s.o_totalprice >= 250000 AND s.contract_id = v.contract_id AND s.version = v.version)
QUALIFY row_number() OVER (PARTITION BY contract_id, version ORDER BY id) = 1""")

oracle("registry_round_trip", """
SELECT 'orders.' || o_custkey AS topic, count(*) AS n,
  count(*) FILTER (o_totalprice >= 100000) AS approved,
  count(*) FILTER (o_totalprice < 100000) AS rejected
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")

# --- semantic versions and evolution ------------------------------------------------------------

oracle("semver_parts", VERSIONS, """
SELECT id, CASE WHEN status <> 'DRAFT' THEN major END AS major,
  CASE WHEN status <> 'DRAFT' THEN minor END AS minor,
  CASE WHEN status <> 'DRAFT' THEN patch END AS patch,
  CASE WHEN status <> 'DRAFT' THEN version END AS formatted
FROM versions""")
oracle("version_steps", VERSIONS, VERSION_FIELDS, HISTORY, """,
steps AS (
  SELECT *, CASE WHEN major = pma + 1 AND minor = 0 AND patch = 0 THEN 'MAJOR'
    WHEN major = pma AND minor = pmi + 1 AND patch = 0 THEN 'MINOR'
    WHEN major = pma AND minor = pmi AND patch = ppa + 1 THEN 'PATCH' END AS bump FROM ordered)
SELECT id, previous_version, version, bump,
  CASE WHEN previous_version IS NOT NULL AND bump IS NULL THEN 'version ' || version
    || ' is not a valid single-level increment from ' || previous_version END AS bump_error
FROM steps""")
oracle("history_changes", VERSIONS, VERSION_FIELDS, HISTORY, "SELECT * FROM history_changes")
oracle("history_classes", VERSIONS, VERSION_FIELDS, HISTORY, """,
worst AS (
  SELECT o.id, CASE WHEN count(*) FILTER (severity = 'BREAKING') > 0 THEN 'BREAKING'
    WHEN count(c.id) > 0 THEN 'COMPATIBLE' ELSE 'SAFE' END AS classification
  FROM ordered o LEFT JOIN history_changes c ON c.id = o.id
  WHERE previous_version IS NOT NULL GROUP BY o.id)
SELECT classification, count(*) AS n FROM worst GROUP BY ALL""")
oracle("gate_decisions", *GATE, """
SELECT change_id, classification, error, n_changes,
  CASE WHEN classification = 'BREAKING' THEN n ELSE 0 END AS n_consumers,
  coalesce(classification = 'BREAKING' AND n > 0, false) AS requires_approval,
  CASE WHEN classification = 'BREAKING' THEN all_teams ELSE '' END AS teams
FROM decisions""")
oracle("gate_changes", *GATE, "SELECT * FROM changes")
oracle("gate_changes_strict", *GATE, """
SELECT * FROM changes""")
oracle("gate_consumers", *GATE, """
SELECT change_id, source_topic, consumer_name, consumer_type, consumer_team
FROM decisions d JOIN edges e ON e.source_topic = 'orders.' || d.contract_id
WHERE classification = 'BREAKING'""")
oracle("gate_outcomes", *GATE, """
SELECT classification, count(*) AS n FROM decisions WHERE classification IS NOT NULL
GROUP BY ALL""")
oracle("missing_approvals", *GATE, """,
needed AS (
  SELECT DISTINCT change_id, consumer_team AS team
  FROM decisions d JOIN edges e ON e.source_topic = 'orders.' || d.contract_id
  WHERE classification = 'BREAKING' AND coalesce(consumer_team, '') <> ''),
given AS (
  SELECT 'chg-' || c_custkey AS change_id, 'team-' || s_nationkey AS team
  FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)
  WHERE c_acctbal > 4000 AND s_nationkey >= 8)
SELECT change_id AS contract_version_id, team FROM needed
WHERE (change_id, team) NOT IN (SELECT change_id, team FROM given)""")

# --- lineage ----------------------------------------------------------------------------------

_uuid = lambda text: (
    f"regexp_replace(left(sha256({text}), 32), "
    "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
)
oracle("run_events", MESSAGES, AUDIT, f"""
SELECT event_id AS "offset", 'COMPLETE' AS event_type, producer AS job,
  'Producer writing to ' || topic AS description, topic AS dataset,
  CASE WHEN malformed THEN 0 WHEN amount = 'absent' THEN 7 ELSE 8 END AS n_fields,
  {_uuid("'governance.audit:0:' || event_id")} AS run_id
FROM audit JOIN producers USING (event_id)""")
oracle("fail_events", MESSAGES, AUDIT, """
SELECT event_id AS "offset", 'FAIL' AS event_type, 'svc-' || user_id AS job,
  CASE WHEN value >= 5 THEN 'events.error' ELSE 'unknown' END AS dataset,
  'Contract violation: ' || CASE WHEN value >= 10 THEN 'TYPE_MISMATCH' ELSE 'UNKNOWN' END AS message
FROM reports""")
oracle("message_header", MESSAGES, """
SELECT event_id AS "offset", CASE WHEN value < 3 THEN 'unknown' ELSE 'svc-' || user_id END
  AS producer, '' AS contract FROM m""")
oracle("schema_facet", MESSAGES, AUDIT, FIELDS, """
SELECT event_id AS "offset", path AS name, kind AS type FROM f""")
oracle("column_lineage", MESSAGES, AUDIT, FIELDS, """
SELECT event_id AS "offset", topic AS output_dataset, path AS output_field,
  'producer.' || topic AS input_dataset, path AS input_field, 'IDENTITY' AS transformation_type
FROM f""")
oracle("column_lineage_emitted", MESSAGES, AUDIT, FIELDS, f"""
SELECT event_id AS "offset", path AS output_field, '{NAMESPACE}' AS namespace,
  'producer.' || topic AS dataset, path AS field, 'direct' AS description, 'IDENTITY' AS kind
FROM f""")
oracle("processed_and_failed", """
SELECT CASE event_type WHEN 'error' THEN 'governance.violations' ELSE 'governance.audit' END
    AS topic,
  CASE WHEN event_type = 'error' AND value >= 40 AND value < 45 THEN 'AttributeError'
       WHEN event_type <> 'error' AND value >= 50 AND value < 55 THEN 'TypeError' END AS failure,
  count(*) AS n
FROM events GROUP BY ALL""")
oracle("run_events_by_type", MESSAGES, AUDIT, """
SELECT 'COMPLETE' AS event_type, count(*) AS n FROM audit
UNION ALL SELECT 'FAIL', count(*) FROM reports""")
oracle("stream_deliveries", MESSAGES, AUDIT, """
SELECT true AS delivered,
  CAST((SELECT count(*) FROM audit) + (SELECT count(*) FROM reports) AS BIGINT) AS n""")
oracle("outbox_deliveries", MESSAGES, AUDIT, """
SELECT 'COMPLETE' AS event_type, count(*) AS n, count(*) AS runs FROM audit
UNION ALL SELECT 'FAIL', count(*), count(*) FROM reports""")
oracle("message_ids", """
SELECT event_id AS "offset", CASE event_type WHEN 'error' THEN 'governance.violations'
  ELSE 'governance.audit' END || ':0:' || event_id AS id FROM events""")

# --- consumer edges ---------------------------------------------------------------------------

oracle("upsert_edges", OBSERVED, """
SELECT max(CASE WHEN e.consumer_type = 'FLINK_JOB'
    THEN o.source_topic || '/' || o.consumer_name END) AS known_id,
  o.source_topic, o.consumer_name,
  arg_max_null(o.consumer_type, (o.seen_at, o.seq)) AS consumer_type,
  arg_max_null(o.consumer_team, (o.seen_at, o.seq)) AS consumer_team,
  strftime(max(o.seen_at), '%Y-%m-%d') AS last_seen
FROM observed o JOIN edges e USING (source_topic, consumer_name)
GROUP BY o.source_topic, o.consumer_name""")
oracle("stale_edges", OBSERVED, """
SELECT source_topic, consumer_name, strftime(last_seen_at, '%Y-%m-%d') AS last_seen
FROM edges WHERE last_seen_at < TIMESTAMP '1998-01-01'""")
oracle("edge_upserts_by_type", OBSERVED, """
SELECT consumer_type, count(*) AS n FROM observed GROUP BY ALL""")

# --- impact -----------------------------------------------------------------------------------

oracle("find_source_node", REQUESTS, "SELECT change_id, source FROM requests")
oracle("bfs_reachable", REQUESTS, GRAPH, WALK, """
SELECT source, node, depth, array_to_string(path, '>') AS path FROM reached""")
oracle("truncated_walks", REQUESTS, GRAPH, """,
steps AS (
  SELECT source, source AS node, 0 AS depth FROM requests WHERE source IS NOT NULL
  UNION SELECT source, a.dst, 1 FROM requests JOIN graph a ON a.src = source
  UNION SELECT source, b.dst, 2 FROM requests JOIN graph a ON a.src = source
  JOIN graph b ON b.src = a.dst)
SELECT DISTINCT source, EXISTS (
    SELECT 1 FROM steps s JOIN graph c ON c.src = s.node WHERE s.source = r.source AND s.depth = 2
      AND NOT EXISTS (SELECT 1 FROM steps t WHERE t.source = r.source AND t.node = c.dst))
  AS truncated
FROM requests r WHERE source IS NOT NULL""")
oracle("declared_impact", """
SELECT 'customer-' || c_custkey AS change_id, 'order.' || o_orderkey AS name,
  'DATASET' AS node_type, o_orderpriority AS owner_team, 'CRITICAL' AS impact,
  'observed' AS provenance,
  CASE o_orderstatus WHEN 'F' THEN 'status,totalprice' ELSE 'status' END AS affected_fields,
  1 AS depth
FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL
SELECT 'customer-' || c_custkey, 'line.' || o_orderkey || '-1', 'DATASET',
  coalesce(max(l_linestatus), 'billing'), 'CRITICAL',
  CASE WHEN max(l_orderkey) IS NULL THEN 'declared' ELSE 'both' END, 'status', 2
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
WHERE o_orderstatus = 'F' GROUP BY c_custkey, o_orderkey
UNION ALL
SELECT DISTINCT 'customer-' || c_custkey, 'audit.' || c_custkey, 'JOB', 'audit', 'CRITICAL',
  'declared', 'totalprice', 2
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""")
oracle("empty_graph_report", """
SELECT 'customer-' || c_custkey AS change_id,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 0 ELSE count(o_orderkey) END
    AS total_consumers_affected,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') OR count(o_orderkey) = 0 THEN 'NONE'
    ELSE 'CRITICAL' END AS worst_impact,
  CASE c_mktsegment WHEN 'BUILDING'
    THEN 'Topic ''old.customer.' || c_custkey || ''' not found in lineage graph' END AS error,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No lineage found for topic customer.' || c_custkey
      || '. This may indicate the topic has no recorded consumers yet.'
    WHEN c_mktsegment <> 'BUILDING' AND count(o_orderkey) = 0
    THEN 'No downstream consumers are impacted by changes to totalprice, status in customer.'
      || c_custkey || '.' END AS summary
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
oracle("bare_nodes", f"""
SELECT {REF('job', 'customer', 'c_custkey')} AS source,
  {REF('dataset', 'order', 'o_orderkey')} AS node, 1 AS depth, 'order.' || o_orderkey AS name,
  'DATASET' AS node_type, o_orderpriority AS owner_team,
  CASE o_orderstatus WHEN 'F' THEN 'totalprice,status' ELSE 'status' END AS fields
FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL
SELECT DISTINCT {REF('job', 'customer', 'c_custkey')}, {REF('dataset', 'line', LINE)}, 2,
  {REF('dataset', 'line', LINE)}, 'DATASET', NULL, ''
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""")
oracle("scored_consumers", *IMPACT, """
SELECT change_id, name, node_type, owner_team, impact,
  array_to_string(affected, ',') AS affected_fields, depth, depth = 1 AS is_direct
FROM scored WHERE impact <> 'NONE'""")
oracle("ranked_consumers", *IMPACT, """
SELECT change_id, name, impact, row_number() OVER (PARTITION BY change_id ORDER BY
  list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], impact), depth, name) AS place
FROM scored WHERE impact <> 'NONE'""")
oracle("approvals", *IMPACT, """
SELECT DISTINCT change_id, owner_team FROM scored
WHERE impact IN ('CRITICAL', 'HIGH') AND coalesce(owner_team, '') <> ''""")
oracle("consumer_buckets", *IMPACT, """
SELECT change_id, CASE WHEN impact = 'MEDIUM' THEN 'OTHER' ELSE impact END AS bucket,
  count(*) AS n
FROM scored WHERE impact <> 'NONE' GROUP BY ALL""")
TOP = """
firsts AS (
  SELECT change_id, string_agg(name, ',' ORDER BY depth, name) AS names,
    string_agg(name, ', ' ORDER BY depth, name) AS shown
  FROM (SELECT * FROM scored WHERE impact = 'CRITICAL'
    QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY depth, name) <= 3)
  GROUP BY change_id)
"""
oracle("top_critical", *IMPACT, TOP, "SELECT change_id, names FROM firsts")
oracle("blast_radius_report", *IMPACT, TOP, """,
counted AS (
  SELECT change_id, count(*) AS total, count(*) FILTER (impact = 'CRITICAL') AS critical,
    count(*) FILTER (impact = 'HIGH') AS high, count(*) FILTER (depth = 1) AS direct,
    max(CASE impact WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 ELSE 2 END) AS worst,
    coalesce(string_agg(DISTINCT owner_team, ',' ORDER BY owner_team)
      FILTER (impact IN ('CRITICAL', 'HIGH') AND owner_team <> ''), '') AS approvals
  FROM scored WHERE impact <> 'NONE' GROUP BY change_id),
full_ AS (
  SELECT r.*, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical,
    coalesce(high, 0) AS high, coalesce(direct, 0) AS direct, coalesce(worst, 1) AS worst,
    coalesce(approvals, '') AS approvals, shown, array_to_string(changed, ', ') AS what
  FROM requests r LEFT JOIN counted USING (change_id) LEFT JOIN firsts USING (change_id))
SELECT change_id, total AS total_consumers_affected, critical AS n_critical, high AS n_high,
  direct AS n_direct, ['NONE', 'MEDIUM', 'HIGH', 'CRITICAL'][worst] AS worst_impact, approvals,
  CASE WHEN source IS NULL THEN NULL
    WHEN total = 0 THEN 'No downstream consumers are impacted by changes to ' || what || ' in '
      || topic || '.'
    ELSE concat_ws(' ',
      'Changing ' || what || ' in ' || topic || ' affects ' || total || ' downstream consumer(s).',
      CASE WHEN critical > 0 THEN critical || ' CRITICAL: ' || shown
        || CASE WHEN critical > 3 THEN ' and ' || (critical - 3) || ' more' ELSE '' END
        || ' will break.' END,
      CASE WHEN high > 0 THEN high || ' HIGH impact consumer(s) require notification.' END,
      CASE WHEN direct > 0 THEN direct || ' consumer(s) read this topic directly.' END)
  END AS summary,
  CASE WHEN source IS NULL THEN 'Topic ''' || topic || ''' not found in lineage graph' END AS error
FROM full_""")
oracle("classify_dataset", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'ICEBERG_TABLE'
  WHEN p_type = 'SMALL' THEN 'ICEBERG_TABLE' WHEN p_size < 10 THEN 'KAFKA_TOPIC'
  ELSE 'UNKNOWN' END AS dataset_type
FROM part""")
oracle("lineage_graph_nodes", """
SELECT 'job:' || c_name AS id, 'JOB' AS node_type, c_name AS name, NULL AS dataset_type,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS owner_team, '' AS fields FROM customer
UNION ALL SELECT 'dataset:' || s_name, 'DATASET', 's.' || s_name, 'KAFKA_TOPIC', NULL,
  'acctbal,key' FROM supplier
UNION ALL SELECT DISTINCT n, 'DATASET', n, NULL, NULL, '' FROM (
  SELECT 'n' || c_nationkey AS n FROM customer UNION SELECT 'sink.' || c_nationkey FROM customer
  UNION SELECT 'n' || s_nationkey FROM supplier)""")
oracle("lineage_graph_edges", """
SELECT DISTINCT 'n' || c_nationkey AS src, 'job:' || c_name AS dst FROM customer
UNION SELECT 'job:' || c_name, 'sink.' || c_nationkey FROM customer
UNION SELECT 'dataset:' || s_name, 'n' || s_nationkey FROM supplier""")

# --- histograms, quality, drift ---------------------------------------------------------------

_bounds = ", ".join(f"('{b}', {b})" for b in VALIDATION_MS)
oracle("histogram", f"""
SELECT event_type, le, count(*) FILTER (v <= bound) AS n, count(*) AS count,
  CAST(sum(v) AS DOUBLE) AS sum
FROM (SELECT event_type, CAST(value AS DECIMAL(18, 4)) AS v FROM events),
  (VALUES {_bounds}, ('+Inf', 1e300)) b(le, bound)
GROUP BY event_type, le""")
_RULES = """
(VALUES ('quantity_range'), ('flag_enum'), ('partner_not_null'), ('id_uuid')) r(rule)"""
_FAILS = """CASE rule WHEN 'quantity_range' THEN l_quantity NOT BETWEEN 5 AND 45
  WHEN 'flag_enum' THEN l_returnflag NOT IN ('A', 'N')
  WHEN 'partner_not_null' THEN l_discount <= 0.02 ELSE l_tax > 0.05 END"""
oracle("quality_rules", f"""
SELECT l_linestatus, rule, count(*) FILTER ({_FAILS}) AS failed, count(*) AS checked
FROM lineitem, {_RULES} GROUP BY ALL""")
oracle("quality_failures", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
  CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'quantity_range' END,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_enum' END,
  CASE WHEN l_discount <= 0.02 THEN 'partner_not_null' END,
  CASE WHEN l_tax > 0.05 THEN 'id_uuid' END) AS failed_rules
FROM lineitem""")
oracle("sampled_quality", """
SELECT o_orderstatus, 'price_range' AS rule,
  count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000) AS failed, count(*) AS checked
FROM orders WHERE CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) % 10 = 0
GROUP BY ALL""")
_LOG = """
log AS (
  SELECT topic, producer_id, ts, t AS violation FROM (
    SELECT topic, producer_id, ts, t1 AS t FROM w WHERE status = 'REJECTED'
    UNION ALL SELECT topic, producer_id, ts, t2 FROM w WHERE t2 IS NOT NULL)),
named AS (
  SELECT *, CASE violation WHEN 'MISSING_REQUIRED_FIELD' THEN 'MISSING_FIELD'
    WHEN 'TYPE_MISMATCH' THEN 'TYPE_ERROR' WHEN 'POLICY_BREACH' THEN 'POLICY_VIOLATION'
    ELSE 'SCHEMA_MISMATCH' END AS violation_type FROM log)
"""
oracle("violation_log", VALIDATED, _LOG, """
SELECT topic, producer_id, violation_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at
FROM named""")
oracle("violation_rate", VALIDATED, _LOG, """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, topic, violation_type,
  count(*) AS n
FROM named GROUP BY ALL""")
oracle("schema_drift", MESSAGES, AUDIT, FIELDS, """
SELECT topic, path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n,
  round(count(*) FILTER (kind = 'null') / count(*), 6) AS null_rate,
  CASE event_type WHEN 'click' THEN path IN ('event_id', 'amount')
    WHEN 'purchase' THEN path IN ('user.email', 'amount')
    WHEN 'signup' THEN path IN ('user.email', 'user.id', 'user.phone')
    ELSE path IN ('props.k', 'amount', 'user', 'event_id') END AS declared
FROM f GROUP BY topic, event_type, path""")
oracle("declared_consumers", OBSERVED, f""",
named AS (
  SELECT source_topic, consumer_type, min(consumer_name) AS name, min(consumer_team) AS team
  FROM edges GROUP BY ALL),
ids AS (
  SELECT *, CASE consumer_type WHEN 'ICEBERG_TABLE' THEN 'dataset' ELSE 'job' END
    || ':{NAMESPACE}:' || name AS dst FROM named),
owners AS (SELECT dst, max(team) AS owner_team FROM ids GROUP BY dst)
SELECT DISTINCT 'dataset:{NAMESPACE}:' || source_topic AS src, dst,
  CASE WHEN dst LIKE 'dataset:%' THEN 'DATASET' ELSE 'JOB' END AS node_type, owner_team,
  'note,total' AS fields
FROM ids JOIN owners USING (dst)""")
oracle("audit_log", VALIDATED, """
SELECT topic, producer_id, key, CASE event_type WHEN 'view' THEN 'event_id' ELSE 'user.email' END
  AS audited_fields
FROM w WHERE status = 'ACCEPTED' AND event_type IN ('view', 'purchase')""")

# --- streams ----------------------------------------------------------------------------------

oracle("stream_validate", VALIDATED, MASKED, f"""
SELECT event_id, outcome, coalesce(error, masking_error) AS error,
  CASE WHEN status = 'REJECTED' THEN {DETAIL} END AS detail,
  CASE WHEN outcome <> 'ACCEPTED' THEN NULL WHEN event_type = 'signup' THEN 'user.email,user.id'
       ELSE '' END AS transformed
FROM o""")
# Odd events come after the contract of signups has gone: they fare like those of an unknown topic.
oracle("stream_contract_change", VALIDATED.replace(
    "SELECT event_id, ts, event_type,",
    "SELECT event_id, ts, CASE WHEN event_id % 2 = 1 AND event_type = 'signup' THEN 'error' "
    "ELSE event_type END AS event_type,", 1), MASKED, f"""
SELECT event_id, outcome, coalesce(error, masking_error) AS error,
  CASE WHEN status = 'REJECTED' THEN {DETAIL} END AS detail, event_id % 2 AS half
FROM o""")
oracle("stream_lineage", MESSAGES, AUDIT, """
SELECT 'governance.audit' AS topic, 'COMPLETE' AS event_type, count(*) AS n, count(*) AS runs
FROM audit
UNION ALL SELECT 'governance.violations', 'FAIL', count(*), count(*) FROM reports""")
oracle("stream_upsert", """
SELECT 'events.' || event_type AS source_topic, CAST(user_id AS VARCHAR) AS consumer_name,
  'UNKNOWN' AS consumer_type,
  arg_max_null(CASE WHEN value > 10 THEN 'heavy' END, (ts, event_id)) AS consumer_team,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM events GROUP BY event_type, user_id""")

# A select that starts with a comma continues the list of named subqueries.
ORACLES = {name: re.sub(r"\n\s*\n?,", ",", sql) for name, sql in ORACLES.items()}
