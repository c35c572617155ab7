"""Views that give the synthetic tables the shapes of lineage, requests, objects, audit and so on.

The text runs unchanged in Spark SQL and in DuckDB.  Every view covers the whole of its table.
"""

from __future__ import annotations

TODAY = "1998-06-15"
NOW = "1998-06-15 12:00:00"


def txt(n: str) -> str:
    return f"CAST({n} AS STRING)"


def table_name(n: str) -> str:
    """Name of production table number ``n``."""
    return f"concat('prod_c', {txt(f'({n}) % 3')}, '.s', {txt(f'({n}) % 7')}, '.t', {txt(n)})"


def user(n: str) -> str:
    return f"concat('user', {txt(n)}, '@co.com')"


DR = f"concat('DR-', {txt('o_orderkey')})"
SOURCE = "l_suppkey * 20 + l_linenumber"
DAY = f"{txt('CAST(o_orderdate AS DATE)')}"

VIEWS: dict[str, str] = {}

# Lineage: job <part> reads tables of its suppliers and writes table <part>.
VIEWS["fx_edges"] = f"""
SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE {table_name(SOURCE)} END AS source_table_full_name,
       CASE WHEN l_linestatus = 'F' OR l_partkey % 10 = 3 THEN NULL ELSE {table_name('l_partkey')} END AS target_table_full_name,
       CASE WHEN l_suppkey % 4 = 0 THEN 'VIEW' WHEN l_suppkey % 4 = 1 THEN NULL ELSE 'TABLE' END AS source_type,
       CASE WHEN l_partkey % 5 = 0 THEN 'view' WHEN l_partkey % 5 = 1 THEN NULL ELSE 'TABLE' END AS target_type,
       concat('job-', {txt('l_partkey')}) AS entity_id,
       l_orderkey * 8 + l_linenumber AS edge_seq
FROM lineitem"""

VIEWS["fx_enrichment"] = f"""
SELECT concat(CASE WHEN p_size % 3 = 0 THEN 'stream-' ELSE 'job-' END, {txt('p_partkey')}) AS stream_key,
       CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 9 THEN '' ELSE {table_name('(p_partkey + 5)')} END AS object_fqn,
       CASE WHEN p_size % 5 = 0 THEN 'write' WHEN p_size % 5 = 1 THEN 'READ_WRITE' WHEN p_size % 5 = 2 THEN NULL
            WHEN p_size % 5 = 3 THEN '' ELSE 'READ' END AS access_hint
FROM part"""

VIEWS["fx_sizes"] = f"""
SELECT CASE WHEN p_size = 50 THEN '9bad' ELSE concat('prod_c', {txt('p_partkey % 3')}) END AS table_catalog,
       concat('s', {txt('p_partkey % 7')}) AS table_schema,
       concat('t', {txt('p_partkey')}) AS table_name,
       CASE WHEN p_size = 1 THEN NULL ELSE p_partkey * 1000003 END AS data_size_in_bytes
FROM part"""

VIEWS["fx_inventory"] = f"""
SELECT CASE WHEN p_size > 10 THEN 'job' ELSE 'pipeline' END AS kind,
       concat('stream-', {txt('CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey - p_partkey % 4 END')}) AS name,
       concat(CASE WHEN p_size > 10 THEN 'job-' ELSE 'pipe-' END, {txt('p_partkey')}) AS resource_id
FROM part"""

VIEWS["fx_request_streams"] = f"""
SELECT {DR} AS dr_id, concat('stream-', {txt('o_custkey')}) AS name FROM orders
UNION ALL
SELECT {DR} AS dr_id, concat('stream-', {txt('o_custkey + 1 + o_orderkey % 3')}) AS name FROM orders"""

VIEWS["fx_additional"] = f"""
SELECT {DR} AS dr_id,
       concat('prod_c', {txt('o_custkey % 4')}, '.s', {txt('o_custkey % 7')}, '.t', {txt('o_custkey')}) AS fqn
FROM orders"""

# Requests.
VIEWS["fx_requests"] = f"""
SELECT {DR} AS dr_id, o_orderpriority AS description,
       CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' WHEN o_orderstatus = 'P' THEN 'CLEANUP_IN_PROGRESS'
            WHEN o_orderkey % 4 = 0 THEN 'EXPIRING_SOON' WHEN o_orderkey % 4 = 1 THEN 'PENDING_REVIEW'
            WHEN o_orderkey % 4 = 2 THEN 'PROVISIONING' ELSE 'CLEANED_UP' END AS status,
       o_orderdate - INTERVAL 60 DAY AS created_at,
       {user('o_custkey')} AS created_by,
       CAST(o_orderdate AS DATE) AS expiration_date,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE NULL END AS notification_sent_at
FROM orders"""

# Settings of the requests: users, environments, revision.
VIEWS["fx_settings"] = f"""
SELECT {DR} AS dr_id, o_orderkey % 2 = 0 AS qa_enabled,
       CASE WHEN o_orderkey % 9 = 0 THEN 'sandbox' WHEN o_orderkey % 9 = 1 THEN ' ' ELSE NULL END AS target_catalog,
       CASE WHEN o_orderkey % 4 = 1 THEN 'version' WHEN o_orderkey % 4 = 2 THEN 'timestamp' ELSE 'latest' END AS rev_mode,
       o_orderkey AS rev_version, {DAY} AS rev_timestamp,
       concat({user('o_custkey')}, ',', {user('o_custkey % 7')}) AS developers,
       concat({user('o_custkey + 3')}, CASE WHEN o_orderkey % 10 = 0 THEN ',not safe' ELSE '' END) AS qa_users
FROM orders"""

VIEWS["fx_objects"] = f"""
SELECT DISTINCT concat('DR-', {txt('l_orderkey')}) AS dr_id, {table_name('l_partkey')} AS source_fqn,
       concat('dev_c', {txt('l_partkey % 3')}, CASE WHEN l_linestatus = 'O' THEN '.dr_' ELSE '.qa_' END, {txt('l_orderkey')},
              '_s', {txt('l_partkey % 7')}, '.t', {txt('l_partkey')}) AS target_fqn,
       CASE WHEN l_linestatus = 'O' THEN 'dev' ELSE 'qa' END AS target_environment,
       CASE WHEN l_partkey % 5 = 0 THEN 'view' ELSE 'table' END AS object_type,
       CASE WHEN l_partkey % 3 = 0 THEN 'READ_WRITE' ELSE 'READ_ONLY' END AS access_mode,
       CASE WHEN l_partkey % 5 = 0 THEN 'view' WHEN l_partkey % 5 = 1 THEN 'deep_clone'
            WHEN l_partkey % 5 = 2 THEN 'schema_only' ELSE 'shallow_clone' END AS clone_strategy,
       CASE WHEN l_partkey % 11 = 0 THEN 'DROPPED' WHEN l_partkey % 11 = 1 THEN 'FAILED'
            WHEN l_partkey % 11 = 2 THEN 'REFRESH_PENDING' WHEN l_partkey % 11 = 3 THEN NULL ELSE 'PROVISIONED' END AS status
FROM lineitem"""

# Objects of a manifest, before planning.
VIEWS["fx_manifest_objects"] = f"""
SELECT DISTINCT concat('DR-', {txt('l_orderkey')}) AS dr_id,
       CASE WHEN l_partkey % 13 = 0 THEN concat('short.t', {txt('l_partkey')})
            WHEN l_partkey % 13 = 1 THEN concat('production.s.t', {txt('l_partkey')})
            WHEN l_partkey % 13 = 2 THEN concat('raw.s.t', {txt('l_partkey')})
            ELSE {table_name('l_partkey')} END AS fqn,
       CASE WHEN l_partkey % 5 = 0 THEN 'view' WHEN l_partkey % 5 = 4 THEN NULL ELSE 'table' END AS object_type,
       CASE WHEN l_partkey % 3 = 0 THEN 'READ_WRITE' WHEN l_partkey % 3 = 1 THEN NULL ELSE 'READ_ONLY' END AS access_mode,
       CASE WHEN l_partkey % 17 = 0 THEN 'deep_clone' WHEN l_partkey % 17 = 1 THEN '' ELSE NULL END AS clone_strategy,
       CAST(l_partkey AS DOUBLE) AS estimated_size_gb
FROM lineitem"""

VIEWS["fx_access"] = f"""
SELECT {DR} AS dr_id, {user('o_custkey')} AS user_email, 'dev' AS environment FROM orders
UNION ALL
SELECT {DR} AS dr_id, CASE WHEN o_orderkey % 8 = 0 THEN 'bad name' ELSE {user('o_custkey + 3')} END AS user_email, 'qa' AS environment FROM orders"""

VIEWS["fx_principals"] = f"""
SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('group-', {txt('c_custkey')}) ELSE {user('c_custkey')} END AS principal
FROM customer"""

# Audit rows; the id of a pending edit is built from the number in the JSON field.
VIEWS["fx_audit"] = f"""
SELECT concat('log-', {txt('event_id')}) AS log_id, concat('DR-', {txt('user_id')}) AS dr_id,
       CASE event_type WHEN 'signup' THEN 'CONFIG_EDIT_PENDING' WHEN 'purchase' THEN 'CONFIG_EDIT_APPROVED'
                       WHEN 'error' THEN 'CONFIG_EDIT_REJECTED' WHEN 'click' THEN 'REFRESH' ELSE 'PROVISION' END AS action,
       CASE WHEN event_id % 50 = 0 THEN 'no json'
            ELSE concat('{{"pending_edit_id": "pe-', {txt('user_id')}, '-', regexp_extract(props, '([0-9]+)', 1), '"}}') END AS action_detail,
       {user('user_id % 20')} AS performed_by, ts AS performed_at,
       CASE WHEN value < 5 THEN 'FAILED' WHEN value < 10 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status
FROM events"""

# A commit-stamped table with key k, and the commit history of many tables.
VIEWS["fx_commits"] = """
SELECT user_id AS k, event_id AS commit_version, ts AS commit_ts,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value AS payload
FROM events"""

VIEWS["fx_history"] = f"SELECT {table_name('user_id')} AS fqn, event_id AS version, ts FROM events"

VIEWS["fx_revisions"] = f"""
SELECT concat('DR-', {txt('event_id')}) AS dr_id, {table_name('(user_id + 1)')} AS fqn,
       CASE event_type WHEN 'click' THEN 'latest' WHEN 'view' THEN 'timestamp' WHEN 'error' THEN 'timestamp' ELSE 'version' END AS rev_mode,
       event_id AS rev_version, ts AS rev_ts
FROM events"""

# Status changes of objects in time order, as a log.
VIEWS["fx_status_log"] = """
SELECT user_id AS k, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'PENDING_REVIEW' WHEN 'purchase' THEN 'PROVISIONING' WHEN 'click' THEN 'ACTIVE'
                       WHEN 'view' THEN 'EXPIRING_SOON' ELSE 'CLEANUP_IN_PROGRESS' END AS status
FROM events"""

# Batches of changes to requests and objects.
_CHANGE_SEQ = "(l_partkey * 1000000 + l_suppkey) * 8 + l_linenumber"
VIEWS["fx_request_moves"] = f"""
SELECT concat('DR-', {txt('l_orderkey')}) AS dr_id,
       CASE l_partkey % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'EXPIRING_SOON' WHEN 2 THEN 'PROVISIONING' WHEN 3 THEN 'ACTIVE' ELSE 'CLEANUP_IN_PROGRESS' END AS current_status,
       CASE l_suppkey % 5 WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'CLEANED_UP' WHEN 3 THEN 'EXPIRING_SOON' ELSE 'FAILED' END AS new_status,
       {_CHANGE_SEQ} AS seq, l_shipdate AS at
FROM lineitem"""

VIEWS["fx_object_moves"] = f"""
SELECT concat('DR-', {txt('l_orderkey')}) AS dr_id, {table_name('l_partkey')} AS source_fqn,
       CASE WHEN l_linestatus = 'O' THEN 'dev' ELSE 'qa' END AS target_environment,
       CASE l_suppkey % 3 WHEN 0 THEN 'PROVISIONED' WHEN 1 THEN 'REFRESH_PENDING' ELSE 'FAILED' END AS current_status,
       CASE l_quantity % 4 WHEN 0 THEN 'PROVISIONED' WHEN 1 THEN 'REFRESH_PENDING' WHEN 2 THEN 'FAILED' ELSE 'DROPPED' END AS new_status,
       {_CHANGE_SEQ} AS seq, l_shipdate AS at
FROM lineitem"""

# Later changes to orders, commit-stamped.
VIEWS["fx_order_changes"] = f"""
SELECT l_orderkey AS o_orderkey, l_extendedprice AS o_totalprice, l_linestatus AS o_orderpriority,
       {_CHANGE_SEQ} AS commit_version, l_shipdate AS commit_ts,
       CASE WHEN l_returnflag = 'A' THEN 'delete' ELSE 'upsert' END AS op
FROM lineitem"""

# Outcomes of runs.
VIEWS["fx_outcomes"] = f"""
SELECT concat('DR-', {txt('l_orderkey')}) AS dr_id, CASE WHEN l_linestatus = 'O' THEN 'dev' ELSE 'qa' END AS target_environment,
       {table_name('l_partkey')} AS source_fqn,
       CASE WHEN l_returnflag = 'A' THEN 'clone' WHEN l_returnflag = 'N' THEN 'drop' ELSE 'skip' END AS action,
       l_quantity > 20 AS success
FROM lineitem"""

# Configs and edits of configs.
_OLD_USERS = f"concat('[\"', {user('o_custkey')}, '\", \"', {user('o_custkey % 7')}, '\"]')"
_NEW_USERS = f"concat('[\"', {user('o_custkey % 7')}, '\", \"', {user('CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END')}, '\"]')"
_QA = "CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN '[]' ELSE '[\"q@co.com\"]' END"


def _config(users: str, qa: str, description: str, day: str) -> str:
    return (
        f"concat('{{\"dr_id\": \"', {DR}, '\", \"streams\": [\"s\"], \"developers\": ', {users}, ', \"qa_users\": ', {qa}, "
        f"', \"description\": \"', {description}, '\", \"expiration_date\": \"', {day}, '\"}}')"
    )


VIEWS["fx_configs"] = f"""
SELECT {DR} AS dr_id, {_config(_OLD_USERS, _QA, 'o_orderpriority', DAY)} AS config_json,
       CASE WHEN o_orderstatus = 'O' THEN 'provisioned' WHEN o_orderstatus = 'P' THEN 'scanned' ELSE 'valid' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE '["e"]' END AS validation_errors,
       {DAY} AS created_at, {user('o_custkey')} AS created_by, CAST(NULL AS STRING) AS updated_at,
       {DAY} AS expiration_date, o_orderpriority AS description,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN '{{broken'
            WHEN o_orderkey % 6 = 2 THEN concat('{{"total_objects": ', {txt('o_custkey')}, ', "objects": []}}')
            ELSE concat('{{"scan_result": {{"total_objects": ', {txt('o_custkey')}, ', "review_required": ',
                        CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END,
                        ', "schemas_required": ["prod_c0.s1", "prod_c1.s2"], "non_prod_additional_objects": ["x.y.z"], ',
                        '"objects": [{{"fqn": "prod_c0.s1.t', {txt('o_custkey')}, '", "type": "table", "access_mode": "READ_ONLY"}}, ',
                        '{{"fqn": "prod_c1.s2.t', {txt('o_orderkey')}, '", "type": "view", "access_mode": "READ_WRITE"}}]}}}}') END AS manifest_json,
       {DAY} AS scanned_at
FROM orders"""

VIEWS["fx_edits"] = f"""
SELECT {DR} AS dr_id, {_config(_OLD_USERS, _QA, 'o_orderpriority', DAY)} AS old_json,
       {_config(_NEW_USERS, "CASE WHEN o_orderkey % 5 = 0 THEN '[]' ELSE '[\"q@co.com\"]' END", "CASE WHEN o_orderkey % 7 = 0 THEN 'new text' WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderpriority END", DAY)} AS new_json,
       CASE WHEN o_orderkey % 2 = 0 THEN 'provisioned' ELSE 'scanned' END AS config_status,
       {user('o_custkey')} AS created_by, {user('o_custkey % 11')} AS requester,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'someone@co.com' ELSE {user('o_custkey')} END AS original_created_by
FROM orders"""

# The same edits as comma text: what the SQL side works on.
VIEWS["fx_user_edits"] = f"""
SELECT {DR} AS dr_id, concat({user('o_custkey')}, ',', {user('o_custkey % 7')}) AS old_users,
       concat({user('o_custkey % 7')}, ',', {user('CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END')}) AS new_users
FROM orders"""

# Request documents; some do not parse, many break a rule.
VIEWS["fx_documents"] = f"""
SELECT o_orderkey AS doc_no,
       CASE WHEN o_orderkey % 20 = 7 THEN '{{"version": "1.0", "development_request": '
            WHEN o_orderkey % 20 = 8 THEN '{{"version": "1.0"}}'
            ELSE concat('{{"version": "', CASE WHEN o_orderkey % 31 = 0 THEN '2.0' ELSE '1.0' END,
                 '", "development_request": {{"dr_id": "', CASE WHEN o_orderkey % 29 = 0 THEN 'DR_' ELSE 'DR-' END, {txt('o_orderkey')},
                 '", "description": "', o_orderpriority, '", "streams": [',
                 CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 23 = 1 THEN '{{"name": ""}}' ELSE '{{"name": "s1"}}, {{"name": "s2"}}' END,
                 '], "additional_objects": ["', CASE WHEN o_orderkey % 19 = 0 THEN 'a.b' WHEN o_orderkey % 19 = 1 THEN 'a..c' ELSE 'a.b.c' END,
                 '"], "environments": {{"dev": {{"enabled": ', CASE WHEN o_orderkey % 37 = 0 THEN 'false' ELSE 'true' END,
                 '}}, "qa": {{"enabled": ', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END,
                 '}}}}, "data_revision": {{"mode": "', CASE WHEN o_orderkey % 17 < 2 THEN 'version' WHEN o_orderkey % 17 < 6 THEN 'timestamp' WHEN o_orderkey % 17 = 6 THEN 'newest' ELSE 'latest' END,
                 '", "version": ', CASE WHEN o_orderkey % 17 = 1 THEN 'null' WHEN o_orderkey % 41 = 0 THEN '-1' ELSE {txt('o_orderkey')} END,
                 ', "timestamp": ', CASE WHEN o_orderkey % 17 = 2 THEN 'null' WHEN o_orderkey % 17 = 3 THEN '"yesterday"' WHEN o_orderkey % 17 = 4 THEN '"1998-02-30T00:00:00Z"' ELSE '"1998-04-01T00:00:00Z"' END,
                 '}}, "access": {{"developers": [', CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN '"a@co.com", " "' ELSE '"a@co.com"' END,
                 '], "qa_users": ', CASE WHEN o_orderkey % 2 = 0 THEN '["q@co.com"]' ELSE 'null' END,
                 '}}, "lifecycle": {{"expiration_date": "', CASE WHEN o_orderkey % 43 = 0 THEN '1998-02-30' WHEN o_orderkey % 43 = 1 THEN 'soon' ELSE {DAY} END,
                 '", "notification_days_before": ', CASE WHEN o_orderkey % 47 = 0 THEN '-3' ELSE '5' END,
                 ', "notification_recipients": ', CASE WHEN o_orderkey % 5 = 0 THEN '["n@co.com", "no good"]' ELSE 'null' END,
                 '}}}}}}') END AS document
FROM orders"""

# Names, principals and ids, good and bad.
VIEWS["fx_names"] = f"""
SELECT c_custkey AS no,
       CASE WHEN c_custkey % 6 = 0 THEN concat('a.b.', c_name) WHEN c_custkey % 6 = 1 THEN concat('a.b.t', {txt('c_custkey')})
            WHEN c_custkey % 6 = 2 THEN concat('a.t', {txt('c_custkey')}) WHEN c_custkey % 6 = 3 THEN concat('9a.b;.', {txt('c_custkey')})
            WHEN c_custkey % 6 = 4 THEN concat('prod.b.c.', {txt('c_custkey')}) ELSE '' END AS fqn,
       CASE WHEN c_custkey % 4 = 0 THEN {user('c_custkey')} WHEN c_custkey % 4 = 1 THEN concat('group-', {txt('c_custkey')})
            WHEN c_custkey % 4 = 2 THEN concat(c_name, ' x') ELSE concat('a''b', {txt('c_custkey')}) END AS principal,
       CASE WHEN c_custkey % 7 = 0 THEN concat('DR-', {txt('c_custkey')}) WHEN c_custkey % 7 = 1 THEN concat('DR', {txt('c_custkey + 100')})
            WHEN c_custkey % 7 = 2 THEN concat('DR', {txt('c_custkey % 100')}) WHEN c_custkey % 7 = 3 THEN concat('TEAMNAMES', {txt('c_custkey')})
            WHEN c_custkey % 7 = 4 THEN concat('9R', {txt('c_custkey')}) WHEN c_custkey % 7 = 5 THEN concat('dr-', {txt('c_custkey')})
            ELSE concat('T1', {txt('c_custkey + 10000')}) END AS dr_id
FROM customer"""

# Bulk runs: a request for the filled orders and one for the open ones, whose settings and objects follow from the orders.
VIEWS["fx_run_requests"] = f"""
SELECT CASE WHEN o_orderstatus = 'F' THEN concat('DR-', {txt('max(o_orderkey)')}) ELSE concat('AB', lpad({txt('max(o_orderkey)')}, 8, '0')) END AS dr_id,
       CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS description, count(*) AS orders, count(*) % 3 <> 0 AS qa_enabled,
       {user('min(o_custkey)')} AS developer, {user('max(o_custkey)')} AS second_developer, {user('max(o_custkey) + 1')} AS tester
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus"""

RUN_TABLES = ("customer", "lineitem", "orders", "part")
VIEWS["fx_run_objects"] = " UNION ALL ".join(
    f"""SELECT dr_id, '{table}' AS table_name, CASE (orders + {place}) % 4 WHEN 0 THEN 'shallow_clone' WHEN 1 THEN 'deep_clone' WHEN 2 THEN 'view'
       ELSE 'schema_only' END AS clone_strategy FROM fx_run_requests"""
    for place, table in enumerate(RUN_TABLES)
)

# Lineage of the stream that is added to a request: a table it has, and one it does not have yet.
VIEWS["fx_run_edges"] = " UNION ALL ".join(
    f"""SELECT 'prod_main.sales.{table}' AS source_table_full_name, CAST(NULL AS STRING) AS target_table_full_name, 'TABLE' AS source_type,
       CAST(NULL AS STRING) AS target_type, {txt('orders')} AS entity_id, CAST({place} AS BIGINT) AS edge_seq FROM fx_run_requests"""
    for place, table in enumerate(("supplier", "orders"))
)

# The same rows for Spark.  All columns of these two follow from a few narrow ones, which follow from them in turn, so the
# narrow ones are made distinct before names are built of them.
SPARK_VIEWS: dict[str, str] = {
    name: VIEWS[name].replace("SELECT DISTINCT", "SELECT").replace("FROM lineitem", f"FROM (SELECT DISTINCT {columns} FROM lineitem)")
    for name, columns in (
        ("fx_objects", "l_orderkey, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'O' END AS l_linestatus"),
        ("fx_manifest_objects", "l_orderkey, l_partkey"),
    )
}
