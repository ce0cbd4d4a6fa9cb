"""Oracle SQL (DuckDB dialect) for each registered query.

Written from the stated rules: windows, rule tables, set operations over keys and
grouped counts. Tables are the driver's pre-registered views.
"""

from __future__ import annotations

_MESSAGES = """
  SELECT event_id AS msg_seq,
         CAST(user_id AS VARCHAR) AS client_id,
         CAST(CAST(props->>'k' AS INTEGER) AS VARCHAR) AS message_id,
         CAST(CAST(props->>'k' AS INTEGER) % 2 AS VARCHAR) AS checksum,
         CASE WHEN upper(t) IN ('BOOTSTRAP','INSTALLATION','CHECK_DATABASE','UPDATE_AGENT','UPDATE_COOKBOOKS',
                                'CHECK_AGENT_VERSION','CHECK_COOKBOOK_VERSION','DATABASE_AUDIT_INFORMATION',
                                'UNKNOWN')
              THEN upper(t) ELSE 'UNKNOWN' END AS type_message,
         ts AS arrival_ts
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'installation' WHEN 'signup' THEN 'bootstrap'
                                  WHEN 'click' THEN 'check_database' WHEN 'view' THEN 'database_audit_information'
                                  WHEN 'error' THEN 'error' END AS t FROM events) e
"""

_ACCEPTED = f"""
  SELECT m.* FROM ({_MESSAGES}) m
  JOIN (SELECT CAST(c_custkey AS VARCHAR) AS client_id, CAST(c_nationkey % 2 AS VARCHAR) AS env_hash
        FROM customer) c ON m.client_id = c.client_id
  WHERE m.client_id IS NOT NULL
    AND (m.type_message NOT IN ('BOOTSTRAP', 'INSTALLATION') OR m.checksum IS NOT DISTINCT FROM c.env_hash)
"""

ORACLE: dict[str, str] = {}

ORACLE["msg_accept"] = f"""
SELECT msg_seq, client_id, message_id, type_message, checksum FROM ({_ACCEPTED}) a
"""

ORACLE["msg_dedup"] = f"""
SELECT msg_seq, client_id, message_id, type_message, arrival_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id, message_id, type_message
                               ORDER BY arrival_ts NULLS FIRST, msg_seq) AS rn
  FROM ({_MESSAGES}) m) WHERE rn = 1
"""

ORACLE["msg_route"] = f"""
SELECT CASE WHEN type_message IN ('BOOTSTRAP','INSTALLATION','CHECK_DATABASE','UPDATE_AGENT','UPDATE_COOKBOOKS',
                                  'CHECK_AGENT_VERSION','CHECK_COOKBOOK_VERSION','DATABASE_AUDIT_INFORMATION')
            THEN type_message ELSE 'UNKNOWN' END AS route,
       count(*) AS n_messages
FROM (SELECT *, row_number() OVER (PARTITION BY client_id, message_id, type_message
                                   ORDER BY arrival_ts NULLS FIRST, msg_seq) AS rn
      FROM ({_ACCEPTED}) a) d
WHERE rn = 1
GROUP BY 1
"""

_LINE_ORDER = ("l_linenumber NULLS FIRST, l_shipdate NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, "
               "l_quantity NULLS FIRST, l_extendedprice NULLS FIRST")

ORACLE["products_first"] = f"""
SELECT msg_id, productname, version, itemVersion, l_linenumber FROM (
  SELECT l.l_orderkey AS msg_id, p.p_brand AS productname, p.p_name AS version,
         CAST(l.l_partkey AS VARCHAR) AS itemVersion, l.l_linenumber,
         row_number() OVER (PARTITION BY l.l_orderkey, p.p_brand ORDER BY {_LINE_ORDER}) AS rn
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) WHERE rn = 1
"""

ORACLE["group_expand"] = """
WITH apps AS (
  SELECT l.l_orderkey AS msg_id, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_type AS productname,
         CASE WHEN l.l_returnflag = 'R' THEN 'reports' ELSE 'web' END AS type,
         p.p_name AS version, CAST(l.l_partkey AS VARCHAR) AS itemVersion
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
grp(group_key, item_pos, item) AS (VALUES ('PROMO', 0, 'PROMO-BOX'), ('PROMO', 1, 'PROMO-BAG'),
     ('PROMO_REPORTS', 0, 'PROMO-REPORT'),
     ('SMALL', 0, 'SMALL-CASE'), ('SMALL', 1, 'SMALL-PACK'), ('SMALL', 2, 'SMALL-JAR')),
ctx(context_key, context) AS (VALUES ('PROMO_BOX', 'promo-box'), ('PROMO_BAG', 'promo-bag'),
     ('PROMO_REPORT', 'promo-report'), ('SMALL_CASE', 'small-case'), ('SMALL_PACK', 'small-pack')),
k AS (SELECT *, replace(productname, '-', '_') || CASE WHEN type = 'reports' THEN '_REPORTS' ELSE '' END AS gkey,
             productname IN ('PROMO', 'SMALL') AS is_group FROM apps)
SELECT msg_id, l_linenumber, l_partkey, l_suppkey, productname, type, CAST(NULL AS VARCHAR) AS context,
       version, itemVersion, CAST(NULL AS INTEGER) AS item_pos, CAST(NULL AS VARCHAR) AS _error
FROM k WHERE NOT is_group
UNION ALL
SELECT msg_id, l_linenumber, l_partkey, l_suppkey, productname, type, NULL, version, itemVersion, NULL,
       'no product group ' || gkey
FROM k WHERE is_group AND gkey NOT IN (SELECT group_key FROM grp)
UNION ALL
SELECT k.msg_id, k.l_linenumber, k.l_partkey, k.l_suppkey, g.item, 'forms', c.context, k.version, k.itemVersion,
       g.item_pos, CASE WHEN c.context IS NULL THEN 'no product context ' || replace(g.item, '-', '_') END
FROM k JOIN grp g ON k.gkey = g.group_key
LEFT JOIN ctx c ON c.context_key = replace(g.item, '-', '_')
WHERE k.is_group
"""

ORACLE["phase_plan"] = """
SELECT CAST(o.o_orderkey AS VARCHAR) AS phase_id,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'AGENT' ELSE 'CHEF' END AS phase_type,
       count(l.l_orderkey) AS n_servers
FROM orders o LEFT JOIN lineitem l
     ON CAST(o.o_orderkey AS VARCHAR) = l.l_orderkey || CASE l.l_returnflag WHEN 'R' THEN '' ELSE l.l_returnflag END
GROUP BY o.o_orderkey, o.o_orderpriority
HAVING count(l.l_orderkey) > 0 OR o.o_orderpriority = '5-LOW'
"""

ORACLE["fail_stop"] = f"""
SELECT msg_id, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, exit_status,
       exit_status <> 0 AS failed_here
FROM (
  SELECT l_orderkey AS msg_id, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_status,
         coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (
             PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed_before
  FROM lineitem) WHERE failed_before = 0
"""

ORACLE["phase_outcome"] = f"""
SELECT msg_id, l_linenumber, l_partkey, l_suppkey, exit_status, effective_exit,
       CASE WHEN exit_status IS NOT NULL THEN 'own' WHEN effective_exit IS NOT NULL THEN 'carried'
            ELSE 'none' END AS exit_source,
       CASE WHEN effective_exit IS NULL THEN NULL WHEN effective_exit <> 0 THEN 'error' ELSE 'complete' END
           AS phase_status,
       CASE WHEN effective_exit IS NULL THEN 'no earlier response to reuse' END AS _error
FROM (
  SELECT l_orderkey AS msg_id, l_linenumber, l_partkey, l_suppkey, exit_status,
         last_value(exit_status IGNORE NULLS) OVER (
             PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_exit
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS exit_status FROM lineitem))
"""

ORACLE["status_events"] = f"""
WITH prod AS (
  SELECT msg_id, name, itemVersion, environment FROM (
    SELECT l.l_orderkey AS msg_id, p.p_brand AS name, CAST(l.l_partkey AS VARCHAR) AS itemVersion,
           l.l_linestatus AS environment,
           row_number() OVER (PARTITION BY l.l_orderkey, p.p_brand ORDER BY {_LINE_ORDER}) AS rn
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) WHERE rn = 1),
ph AS (SELECT o_orderkey AS msg_id, CAST(o_orderkey AS VARCHAR) AS phase_id, o_orderpriority,
              CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS exit_status,
              CAST(o_custkey AS VARCHAR) AS client_id FROM orders),
pairs AS (SELECT * FROM ph JOIN prod USING (msg_id))
SELECT msg_id, phase_id, itemVersion AS cd_item, client_id AS cd_cliente, environment AS cd_ambiente,
       o_orderpriority AS cd_plano_execucao, TIMESTAMP '2024-02-01 00:00:00' AS dh_criacao,
       'start' AS event_kind, 'start' AS cd_item_status, '0' AS nr_progresso, o_orderpriority AS ds_progresso
FROM pairs
UNION ALL
SELECT msg_id, phase_id, itemVersion, client_id, environment, o_orderpriority, TIMESTAMP '2024-02-01 00:00:00',
       'result', CASE WHEN exit_status <> 0 THEN 'fail' ELSE 'done' END, '100',
       CASE WHEN exit_status <> 0 THEN 'Erro - ' || o_orderpriority ELSE 'finished' END
FROM pairs
"""

ORACLE["script_index"] = """
SELECT name, package, pos FROM (
  SELECT p_name AS name, p_brand AS package, p_partkey AS pos,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1
"""

# ---------------------------------------------------------------------------
# Catalog stand-ins (same fixed mappings as plans.standins)
# ---------------------------------------------------------------------------


def _owner(col: str) -> str:
    return (f"CASE {col} % 5 WHEN 0 THEN 'DBAMV' WHEN 1 THEN 'DBASGU' WHEN 2 THEN 'DBAPS' "
            f"WHEN 3 THEN 'MVINTEGRA' ELSE 'SYSTEM' END")


_CUST_OBJECTS = f"""
  SELECT {_owner('c_custkey')} AS owner, 'C' || c_custkey AS object_name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'VIEW' WHEN 'BUILDING' THEN 'SEQUENCE' WHEN 'FURNITURE' THEN 'FUNCTION'
                           WHEN 'HOUSEHOLD' THEN 'PACKAGE' WHEN 'MACHINERY' THEN 'TABLE' END AS object_type
  FROM customer
"""

_ORDER_GRANTS = f"""
  SELECT {_owner('o_custkey')} AS owner, 'C' || o_custkey AS table_name,
         CASE o_orderkey % 5 WHEN 0 THEN 'DBAMV' WHEN 1 THEN 'DBASGU' WHEN 2 THEN 'DBAPS' WHEN 3 THEN 'MVINTEGRA'
                            ELSE 'MV2000' END AS grantee,
         CASE o_orderstatus WHEN 'F' THEN 'EXECUTE' WHEN 'O' THEN 'SELECT' WHEN 'P' THEN 'INSERT' END AS privilege
  FROM orders
"""

# One rule per object type: how often its statement appears, the grant's privileges, who is
# counted, which privileges are counted (or which one is left out) and the least count.
ORACLE["grant_gap"] = f"""
WITH rule(object_type, times, privileges, fifth_counts, counted, left_out, least) AS (VALUES
       ('VIEW', 2, 'SELECT,UPDATE,DELETE,INSERT', false, NULL, 'EXECUTE', 12),
       ('SEQUENCE', 1, 'SELECT', true, 'SELECT', NULL, 4),
       ('FUNCTION', 1, 'EXECUTE', true, 'EXECUTE', NULL, 4),
       ('PROCEDURE', 1, 'EXECUTE', true, 'EXECUTE', NULL, 4),
       ('PACKAGE', 1, 'EXECUTE', true, 'EXECUTE', NULL, 4)),
member(name, pos) AS (VALUES ('DBAMV', 1), ('DBAPS', 2), ('DBASGU', 3), ('MVINTEGRA', 4), ('MV2000', 5)),
receivers AS (SELECT a.name AS owner, string_agg(b.name, ',' ORDER BY b.pos) AS names
              FROM member a JOIN member b ON a.name <> b.name WHERE a.pos < 5 GROUP BY a.name),
obj AS ({_CUST_OBJECTS}), given AS ({_ORDER_GRANTS}),
tally AS (SELECT owner, table_name, privilege, grantee = 'MV2000' AS fifth, count(*) AS n
          FROM given JOIN member ON member.name = given.grantee GROUP BY ALL),
scored AS (
  SELECT obj.owner, obj.object_name, obj.object_type, rule.times, rule.privileges, rule.least,
         coalesce(sum(tally.n) FILTER (WHERE (rule.fifth_counts OR NOT tally.fifth)
                    AND coalesce(tally.privilege = rule.counted, tally.privilege <> rule.left_out)), 0) AS found
  FROM obj JOIN rule USING (object_type)
  LEFT JOIN tally ON tally.table_name = obj.object_name AND tally.owner = obj.owner
  WHERE NOT contains(obj.object_name, 'BIN$')
  GROUP BY ALL)
SELECT owner, object_name, object_type,
       'GRANT ' || privileges || ' ON ' || owner || '.' || object_name || ' TO ' || names AS command
FROM (SELECT *, unnest(range(times)) FROM scored WHERE found < least) JOIN receivers USING (owner)
"""


def _synonym_gap(objects: str, types: str, owners: str, public: str) -> str:
    """Keys of candidate objects EXCEPT the keys that have a public synonym."""
    return f"""
WITH missing AS (
  SELECT owner, object_name FROM ({objects}) WHERE object_type IN ({types}) AND owner IN ({owners})
    AND NOT contains(object_name, 'BIN$')
  EXCEPT
  SELECT table_owner, table_name FROM ({public}) WHERE owner = 'PUBLIC')
SELECT owner, object_name, format('CREATE PUBLIC SYNONYM {{0}} FOR {{1}}.{{0}}', object_name, owner) AS command
FROM missing
"""


# No key is NULL here and names are unique, so the NULL-aware list test is a difference of keys.
ORACLE["not_in"] = _synonym_gap(
    f"SELECT * FROM ({_CUST_OBJECTS}) WHERE object_name <> 'PLAN_TABLE'", "'TABLE', 'VIEW'", "'DBAMV'",
    f"""SELECT CASE o_orderstatus WHEN 'P' THEN 'PUBLIC' ELSE 'DBAMV' END AS owner, 'C' || o_custkey AS table_name,
              {_owner('o_custkey')} AS table_owner FROM orders""")

ORACLE["not_exists"] = _synonym_gap(
    f"""SELECT {_owner('p_partkey')} AS owner, 'P' || p_partkey AS object_name,
              CASE p_type WHEN 'PROMO' THEN 'FUNCTION' WHEN 'SMALL' THEN 'PROCEDURE' WHEN 'MEDIUM' THEN 'PACKAGE'
                          WHEN 'LARGE' THEN 'SEQUENCE' WHEN 'STANDARD' THEN 'TABLE' WHEN 'ECONOMY' THEN 'VIEW' END
                AS object_type FROM part""",
    "'FUNCTION', 'PROCEDURE', 'PACKAGE', 'SEQUENCE'", "'DBAMV', 'DBASGU', 'DBAPS', 'MVINTEGRA'",
    f"""SELECT CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'PUBLIC' ELSE 'DBAMV' END AS owner,
              'P' || l_partkey AS table_name, {_owner('l_partkey')} AS table_owner FROM lineitem""")

# Per (owner, table, columns): is it a foreign key's, is it an index's; then the foreign keys of
# the table and columns, of whichever of the two owners.
ORACLE["fk_gap"] = """
WITH line AS (
  SELECT CASE l_orderkey % 3 WHEN 0 THEN 'DBAMV' WHEN 1 THEN 'DBASGU' ELSE 'DBAPS' END AS owner,
         'T' || l_suppkey AS table_name, 'C' || l_partkey AS colunas, l_returnflag AS flag,
         concat_ws('_', 'T' || l_suppkey, l_orderkey, l_linenumber) AS stem
  FROM lineitem),
two AS (SELECT * FROM line WHERE owner <> 'DBAPS'),
uncovered AS (SELECT owner, table_name, colunas FROM two GROUP BY ALL
              HAVING bool_or(flag = 'R') AND NOT bool_or(flag = 'A'))
SELECT u.owner, u.table_name, u.colunas, k.stem || '_FK' AS constraint_name,
       format('create index {}.{}_IX' || chr(10) || ' ON {}.{}({}) TABLESPACE MV2000_I COMPUTE STATISTICS',
              u.owner, k.stem, u.owner, u.table_name, u.colunas) AS command
FROM uncovered u JOIN two k USING (table_name, colunas) WHERE k.flag = 'R'
"""

ORACLE["column_list"] = """
SELECT l_orderkey AS constraint_name,
       string_agg('C' || l_partkey, ',' ORDER BY l_linenumber, 'C' || l_partkey) AS colunas
FROM lineitem GROUP BY l_orderkey
"""

# Every file counts its MB: a data file once if it is in the view, a temp file once per header
# that names it (once without any) if it is in the view.
_TABLESPACE = """
WITH headers AS (SELECT l_suppkey AS file_id, count(*) AS n FROM lineitem GROUP BY l_suppkey),
counted AS (
  SELECT p_type AS tablespace_name, p_size::DOUBLE AS mb FROM part WHERE p_size % 5 <> 0
  UNION ALL
  SELECT (['PROMO', 'SMALL', 'TEMP'])[s_nationkey % 3 + 1], (s_suppkey % 7 + 1)::DOUBLE * greatest(coalesce(n, 1), 1)
  FROM supplier LEFT JOIN headers ON file_id = s_suppkey WHERE s_suppkey % 4 <> 0)
SELECT tablespace_name, sum(mb) AS value FROM counted
GROUP BY tablespace_name HAVING tablespace_name IN ('PROMO', 'SMALL', 'TEMP')
"""

ORACLE["tablespace"] = _TABLESPACE

ORACLE["tablespace_check"] = f"""
WITH cap AS ({_TABLESPACE}),
r(rule_pos, tablespace_name, required_mb) AS (VALUES (0, 'PROMO', 3000), (1, 'SMALL', 2000000000), (2, 'ABSENT', 1))
SELECT r.rule_pos, r.tablespace_name, r.required_mb, c.value,
       CASE WHEN c.tablespace_name IS NULL THEN 'missing'
            WHEN coalesce(c.value < r.required_mb, true) THEN 'undersized' ELSE 'ok' END AS status
FROM r LEFT JOIN cap c ON c.tablespace_name = r.tablespace_name
"""

_K = "CAST(props->>'k' AS INTEGER)"

ORACLE["privileges"] = f"""
WITH users AS (SELECT DISTINCT user_id FROM events),
tab AS (SELECT user_id, CASE WHEN event_type = 'purchase' AND {_K} = 7 THEN 'UTL_RECOMP' ELSE 'PKG' || {_K} END AS table_name,
               'EXECUTE' AS privilege FROM events),
role AS (SELECT user_id, CASE WHEN event_type = 'signup' AND {_K} < 10 THEN 'DBA' ELSE 'ROLE' || {_K} END AS granted_role
         FROM events),
p AS (SELECT user_id, 'PACKAGE' AS "NAME", privilege AS "VALUE" FROM tab WHERE table_name = 'UTL_RECOMP'
      UNION ALL
      SELECT user_id, 'ROLE', granted_role FROM role WHERE granted_role = 'DBA'),
req AS (SELECT u.user_id, r."NAME", r.value, r.rule_pos FROM users u,
        (VALUES ('PACKAGE', 'UTL_RECOMP', 0), ('ROLE', 'DBA', 1)) r("NAME", value, rule_pos)),
m AS (SELECT * FROM req WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = req.user_id AND p."NAME" = req."NAME"))
SELECT user_id, "NAME", value, rule_pos, rule_pos = min(rule_pos) OVER (PARTITION BY user_id) AS reported FROM m
"""

ORACLE["audit_tail"] = """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC NULLS FIRST, event_id LIMIT 200
"""

ORACLE["audit_tail_client"] = """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id) AS rn FROM events)
WHERE rn <= 20
"""

ORACLE["registry_exists"] = f"""
WITH objs AS (SELECT user_id, CASE WHEN event_type = 'view' AND k < 20 THEN 'GCM_VERSAO' ELSE 'OBJ' || k END AS object_name,
                     CASE WHEN k % 2 = 0 THEN 'DBAMV' ELSE 'DBAPS' END AS owner
              FROM (SELECT *, {_K} AS k FROM events))
SELECT u.user_id,
       (SELECT count(*) FROM objs o WHERE o.user_id = u.user_id AND o.object_name = 'GCM_VERSAO'
          AND o.owner = 'DBAMV') > 0 AS registry_exists
FROM (SELECT DISTINCT user_id FROM events) u
"""

ORACLE["registry"] = f"""
WITH r AS (SELECT concat_ws(':', user_id, event_type) AS cd_produto, concat_ws('.', event_type, {_K}) AS ds_versao,
                  ts AS dh_atualizacao, event_id FROM events),
old AS (SELECT * FROM r WHERE dh_atualizacao < TIMESTAMP '2024-01-16 00:00:00'),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cd_produto
                                                    ORDER BY dh_atualizacao DESC, event_id DESC) AS rn
                       FROM r WHERE dh_atualizacao >= TIMESTAMP '2024-01-16 00:00:00') WHERE rn = 1)
SELECT cd_produto, ds_versao, dh_atualizacao, 'kept' AS origin FROM old
WHERE cd_produto NOT IN (SELECT cd_produto FROM new)
UNION ALL
SELECT cd_produto, ds_versao, dh_atualizacao, 'new' FROM new
"""

ORACLE["disk"] = f"""
WITH dev AS (SELECT user_id AS node, event_id AS device, CAST({_K} AS VARCHAR) AS kb_size,
                    CAST(CAST(trunc(value * 1000) AS BIGINT) AS VARCHAR) AS kb_available FROM events),
big AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY node ORDER BY CAST(kb_size AS BIGINT) DESC, device) AS rn
          FROM dev WHERE kb_size IS NOT NULL AND kb_size <> '') WHERE rn = 1)
SELECT node, device, kb_size, kb_available, CAST(kb_available AS BIGINT) // 1000 AS free_mb,
       coalesce(CAST(kb_available AS BIGINT) // 1000 >= 150, false) AS passed
FROM big
"""

ORACLE["verdict"] = """
WITH r AS (SELECT user_id AS msg_id, bool_and(coalesce(value < 150, false)) AS a, count(*) AS n,
                  count(*) FILTER (WHERE NOT coalesce(value < 150, false)) AS f
           FROM events GROUP BY user_id)
SELECT c.c_custkey AS msg_id, coalesce(r.a, true) AS verdict, coalesce(r.n, 0) AS n_rules,
       coalesce(r.f, 0) AS n_failed
FROM customer c LEFT JOIN r ON r.msg_id = c.c_custkey
"""

ORACLE["version_check"] = f"""
SELECT e.event_id, e.user_id AS client_id, 'v' || ({_K} % 3) AS metric, 'v' || (c.c_nationkey % 3) AS agent_version,
       ('v' || (c.c_nationkey % 3)) IS NOT DISTINCT FROM ('v' || ({_K} % 3)) AS passed
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
"""

# Statement splitting, line by line: a "/" line terminates only when the buffer is
# not empty. Among the non-empty lines, a run of "/" lines after other text ends a
# statement at its 1st, 3rd, ... line; a run at the start of the script at its 2nd,
# 4th, ... line. Empty lines at the start of a statement vanish; text after the
# last terminator is dropped unless there is no terminator at all.
_STATEMENTS_TMPL = """
WITH s AS ({scripts}),
s1 AS (SELECT script_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM s),
sp AS (SELECT script_id, text, string_split(text, chr(10)) AS parts FROM s1),
l AS (SELECT script_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS ln,
             len(parts) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS n_lines
      FROM sp),
f AS (SELECT script_id, ln, line, line = '' AS is_empty,
             regexp_full_match(line, '[ \\t]*/[ \\t]*') AS is_slash
      FROM l WHERE ln <= n_lines),
g AS (SELECT *, sum(CASE WHEN NOT is_empty AND NOT is_slash THEN 1 ELSE 0 END)
                  OVER (PARTITION BY script_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS run_id FROM f),
h AS (SELECT *, CASE WHEN is_slash THEN row_number() OVER (PARTITION BY script_id, run_id, is_slash ORDER BY ln)
                END AS idx FROM g),
t AS (SELECT *, coalesce(is_slash AND ((run_id > 0 AND idx % 2 = 1) OR (run_id = 0 AND idx % 2 = 0)), false)
                  AS is_term FROM h),
u AS (SELECT *, coalesce(sum(CASE WHEN is_term THEN 1 ELSE 0 END) OVER (
                  PARTITION BY script_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt_id,
             sum(CASE WHEN is_term THEN 1 ELSE 0 END) OVER (PARTITION BY script_id) AS n_terms FROM t),
v AS (SELECT *, min(CASE WHEN NOT is_empty AND NOT is_term THEN ln END)
                  OVER (PARTITION BY script_id, stmt_id) AS first_ln FROM u),
stm AS (SELECT script_id, stmt_id, string_agg(line, chr(10) ORDER BY ln) AS statement
        FROM v WHERE NOT is_term AND ln >= first_ln AND (stmt_id < n_terms OR n_terms = 0)
        GROUP BY script_id, stmt_id)
SELECT script_id, CAST(stmt_id AS INTEGER) AS stmt_pos, statement FROM stm
UNION ALL
SELECT script_id, 0, '' FROM s WHERE script_id NOT IN (SELECT script_id FROM stm)
"""

ORACLE["statements"] = _STATEMENTS_TMPL.format(scripts="""
  SELECT conv_id || '-' || turn AS script_id,
         regexp_replace(regexp_replace(text, ' (the|de) ', chr(10) || '/' || chr(10), 'g'), '\\. ', chr(10) || chr(10), 'g')
           AS text
  FROM conversations""")

ORACLE["statements_docs"] = _STATEMENTS_TMPL.format(scripts="""
  SELECT doc_id AS script_id,
         regexp_replace(regexp_replace(text, '(?m)^[^ \\n]+\\.$', '/', 'g'), '(?m)^[^\\n]*!$', '', 'g') AS text
  FROM documents""")

ORACLE["fingerprint"] = """
WITH art AS (SELECT doc_id AS name, text AS content FROM documents),
exp AS (SELECT d.doc_id AS name,
               CASE WHEN l.quality = 1 THEN md5(d.text) ELSE md5(d.text || '#') END || chr(10) || 'doc' || d.doc_id || chr(10)
                 AS md5_text
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT coalesce(a.name, e.name) AS name, e.md5_text IS NOT NULL AS has_expected,
       a.content IS NOT NULL AS has_artifact,
       coalesce(md5(a.content) = split_part(e.md5_text, chr(10), 1), false) AS ok
FROM art a FULL OUTER JOIN exp e ON a.name = e.name
"""


# ---------------------------------------------------------------------------
# Topology
# ---------------------------------------------------------------------------

def _topology_ctes(p: str, where: str) -> str:
    """CTEs ``{p}bal``, ``{p}m``, ``{p}surv`` and ``{p}topo`` for lines matching ``where``."""
    return f"""
{p}li AS (SELECT * FROM lineitem WHERE {where}),
{p}lines AS (SELECT l.*, n.n_name, n.n_nationkey, pt.p_brand, pt.p_type
             FROM {p}li l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
             JOIN part pt ON l.l_partkey = pt.p_partkey),
{p}bal AS (SELECT DISTINCT n_name AS balancer_host, l_returnflag AS balancer_port,
                  n_nationkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bal_pos
           FROM {p}lines),
{p}ports AS (SELECT DISTINCT l_suppkey AS srv_pos, CAST(l_linenumber AS VARCHAR) AS port
             FROM {p}li WHERE l_linestatus = 'O'),
{p}apps AS (SELECT l_suppkey AS srv_pos, l_orderkey, l_linenumber, l_partkey, p_brand AS productname,
                   CASE WHEN p_type = 'PROMO' THEN 'soul-product-reports' ELSE 'soul-product-forms' END AS context,
                   'forms' AS type, CAST(l_linenumber AS VARCHAR) AS port, n_name AS balancer_host,
                   l_returnflag AS balancer_port FROM {p}lines),
{p}m AS (SELECT a.*, b.bal_pos, 'h' || (a.srv_pos // 50) AS server_host,
                EXISTS (SELECT 1 FROM {p}ports q WHERE q.srv_pos = a.srv_pos AND q.port = a.port) AS hit
         FROM {p}apps a JOIN {p}bal b ON a.balancer_host = b.balancer_host AND a.balancer_port = b.balancer_port
         JOIN supplier s ON s.s_suppkey = a.srv_pos),
{p}surv AS (SELECT bal_pos, balancer_host, balancer_port, server_host, min(srv_pos) AS srv_pos
            FROM {p}m GROUP BY bal_pos, balancer_host, balancer_port, server_host),
{p}topo AS (
  SELECT m.bal_pos, m.balancer_host, m.balancer_port, m.server_host, m.srv_pos, m.port,
         m.productname AS product_name,
         CASE WHEN m.context = 'soul-product-reports' THEN 'reports' ELSE m.type END AS product_type,
         m.l_orderkey, m.l_linenumber, m.l_partkey
  FROM {p}m m JOIN {p}surv v ON m.bal_pos = v.bal_pos AND m.balancer_host = v.balancer_host
       AND m.balancer_port = v.balancer_port AND m.server_host = v.server_host AND m.srv_pos = v.srv_pos
  WHERE m.hit
  UNION ALL
  SELECT v.bal_pos, v.balancer_host, v.balancer_port, v.server_host, v.srv_pos, NULL, NULL, NULL, NULL, NULL, NULL
  FROM {p}surv v WHERE NOT EXISTS (SELECT 1 FROM {p}m m WHERE m.hit AND m.bal_pos = v.bal_pos
       AND m.balancer_host = v.balancer_host AND m.balancer_port = v.balancer_port AND m.srv_pos = v.srv_pos)
  UNION ALL
  SELECT b.bal_pos, b.balancer_host, b.balancer_port, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM {p}bal b WHERE NOT EXISTS (SELECT 1 FROM {p}surv v WHERE v.bal_pos = b.bal_pos
       AND v.balancer_host = b.balancer_host AND v.balancer_port = b.balancer_port))"""


_TOPO_COLS = ("balancer_host, balancer_port, server_host, srv_pos, port, product_name, product_type, "
              "l_orderkey, l_linenumber, l_partkey")

ORACLE["topology"] = f"""
WITH {_topology_ctes('a_', 'true')}
SELECT {_TOPO_COLS} FROM a_topo
"""

ORACLE["topology_merge"] = f"""
WITH {_topology_ctes('n_', "l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'")},
{_topology_ctes('o_', "l_shipdate < TIMESTAMP '1998-01-01 00:00:00'")},
nb AS (SELECT balancer_host, balancer_port, min(bal_pos) AS bal_pos FROM n_topo GROUP BY 1, 2),
old_in AS (SELECT o.* EXCLUDE (bal_pos), nb.bal_pos FROM o_topo o
           JOIN nb ON o.balancer_host = nb.balancer_host AND o.balancer_port = nb.balancer_port),
add_prod AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.balancer_host, o.balancer_port, o.server_host, o.port,
                                                o.product_name, o.product_type
                                   ORDER BY o.srv_pos, o.l_orderkey, o.l_linenumber, o.l_partkey) AS rn
    FROM old_in o
    WHERE o.product_name IS NOT NULL
      AND EXISTS (SELECT 1 FROM n_topo n WHERE n.balancer_host = o.balancer_host AND n.balancer_port = o.balancer_port
                    AND n.server_host = o.server_host AND n.port = o.port)
      AND NOT EXISTS (SELECT 1 FROM n_topo n WHERE n.balancer_host = o.balancer_host
                        AND n.balancer_port = o.balancer_port AND n.server_host = o.server_host AND n.port = o.port
                        AND n.product_name = o.product_name AND n.product_type IS NOT DISTINCT FROM o.product_type))
  WHERE rn = 1),
add_port AS (
  SELECT o.* FROM old_in o
  WHERE o.port IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM n_topo n WHERE n.balancer_host = o.balancer_host AND n.balancer_port = o.balancer_port
                      AND n.server_host = o.server_host AND n.port = o.port)
    AND EXISTS (SELECT 1 FROM n_topo n WHERE n.balancer_host = o.balancer_host AND n.balancer_port = o.balancer_port
                  AND n.server_host = o.server_host)),
add_srv AS (
  SELECT o.* FROM old_in o
  WHERE o.server_host IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM n_topo n WHERE n.balancer_host = o.balancer_host AND n.balancer_port = o.balancer_port
                      AND n.server_host = o.server_host)),
kept AS (
  SELECT n.* FROM n_topo n
  WHERE NOT (n.server_host IS NOT NULL AND n.port IS NULL AND EXISTS (
               SELECT 1 FROM add_port a WHERE a.balancer_host = n.balancer_host AND a.balancer_port = n.balancer_port
                 AND a.server_host = n.server_host))
    AND NOT (n.server_host IS NULL AND EXISTS (
               SELECT 1 FROM add_srv a WHERE a.balancer_host = n.balancer_host AND a.balancer_port = n.balancer_port)))
SELECT {_TOPO_COLS}, 'new' AS origin, server_host IS NOT NULL AS returned FROM kept
UNION ALL
SELECT {_TOPO_COLS}, 'old', server_host IS NOT NULL FROM add_prod
UNION ALL
SELECT {_TOPO_COLS}, 'old', server_host IS NOT NULL FROM add_port
UNION ALL
SELECT {_TOPO_COLS}, 'old', server_host IS NOT NULL FROM add_srv
"""

ORACLE["step_logs"] = f"""
SELECT CAST(msg_id AS VARCHAR) AS cd_cliente, 'plano.execucao' AS cd_tipo_log, 'lines' AS ds_identificador,
       'S' AS sn_sincronizado, CASE WHEN exit_status <> 0 THEN 'ERROR' ELSE 'INFO' END AS ds_nivel,
       TIMESTAMP '2024-02-01 00:00:00' AS dh_log, 'line ' || l_linenumber || ' part ' || l_partkey AS lo_conteudo
FROM (
  SELECT l_orderkey AS msg_id, l_linenumber, l_partkey,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_status,
         coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (
             PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed_before
  FROM lineitem) WHERE failed_before = 0
"""

ORACLE["balancer_for_server"] = """
WITH bal AS (SELECT DISTINCT n.n_name AS balancer_host, l.l_returnflag AS balancer_port
             FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
             JOIN part p ON l.l_partkey = p.p_partkey)
SELECT c.c_custkey AS srv_pos, n.n_name AS server_host, b.balancer_port
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN bal b ON b.balancer_host = n.n_name
"""

# ---------------------------------------------------------------------------
# Installation flow over the orders (see standins.order_installations)
# ---------------------------------------------------------------------------

_FLOW = f"""
WITH line AS (
  SELECT l.*, s.s_name, p.p_name, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {_LINE_ORDER}) - 1 AS rec_pos,
         dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS srv_pos,
         CASE WHEN l_linenumber = 1 AND l_orderkey % 17 = 3 THEN 'SOULMV-H5'
              WHEN l_linenumber = 1 AND l_orderkey % 17 = 7 THEN 'CLASRISCO' ELSE p.p_brand END AS product
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN orders o ON o.o_orderkey = l.l_orderkey),
msg AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS msg_id, CAST(o_custkey AS VARCHAR) AS client_id,
         o_orderpriority AS execution_plan, o_orderstatus <> 'P' AS installs,
         CASE WHEN o_orderkey % 11 = 3 THEN 'corrupt body'
              WHEN o_orderkey % 19 = 0 THEN 'unknown validation rule'
              WHEN o_orderkey % 4 = 0 OR c_custkey IS NULL THEN 'rejected'
              WHEN EXISTS (SELECT 1 FROM line WHERE l_orderkey = o_orderkey AND product = 'CLASRISCO')
                THEN 'no product group CLASRISCO_REPORTS' END AS stop
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM line)),
todo AS (
  SELECT k, '10' AS phase_id, srv_pos, 1 AS pos, rec_pos, s_name AS host,
         'recipe[line::' || l_linenumber || '_' || l_partkey || ']' AS recipe,
         CASE WHEN k % 13 = 5 THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS code
  FROM msg JOIN line ON l_orderkey = k WHERE stop IS NULL
  UNION ALL
  SELECT DISTINCT k, '2', srv_pos, 0, 0, s_name, 'recipe[app::deploy]', 0 FROM msg JOIN line ON l_orderkey = k WHERE stop IS NULL
  UNION ALL
  SELECT k, '3', -2, -2, -2, NULL, NULL, 0 FROM msg WHERE stop IS NULL),
step AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN coalesce(code, 1) <> 0 THEN 1 ELSE 0 END) OVER (
                     PARTITION BY k ORDER BY phase_id, srv_pos, pos, rec_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS halts FROM todo)
  WHERE coalesce(halts, 0) = 0),
ended AS (SELECT k, bool_or(code IS NULL) AS silent, bool_or(code = 1) AS failed FROM step GROUP BY k),
phase AS (SELECT k, phase_id, max(code) AS code FROM step GROUP BY k, phase_id HAVING bool_and(code IS NOT NULL)),
prod AS (
  SELECT k, product, p_name, CAST(l_partkey AS VARCHAR) AS item
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, product ORDER BY srv_pos, rec_pos) AS rn FROM line)
  JOIN msg ON k = l_orderkey WHERE rn = 1 AND stop IS NULL),
told(phase_id, stem, n) AS (VALUES ('2', 'deploy', 1), ('10', 'lines', 2), ('3', 'agent', 3))
"""

ORACLE["parse_body"] = _FLOW + """
SELECT msg_id, CASE WHEN installs THEN 'INSTALL' ELSE 'DOWNLOAD' END AS command, k % 11 = 3 AS corrupt,
       CASE WHEN k % 11 <> 3 THEN count(DISTINCT l_suppkey)::INTEGER END AS n_servers,
       CASE WHEN k % 11 <> 3 THEN count(*)::INTEGER END AS n_apps,
       CASE WHEN k % 11 <> 3 THEN 3 END AS n_phases,
       CASE WHEN k % 11 <> 3 THEN CASE WHEN k % 19 = 0 THEN 2 ELSE 1 END END AS n_rules, false AS shows_password
FROM msg JOIN line ON l_orderkey = k GROUP BY msg_id, installs, k
"""

ORACLE["flow_errors"] = _FLOW + """
SELECT msg_id, stop AS error FROM msg WHERE stop <> 'rejected'
UNION ALL
SELECT msg_id, 'no outcome reported' FROM ended JOIN msg USING (k) WHERE silent
"""

ORACLE["flow_steps"] = _FLOW + """
SELECT msg_id, phase_id, srv_pos::INTEGER AS srv_pos, pos AS visit_pos, pos AS entry_pos, rec_pos::INTEGER AS rec_pos, recipe,
       code AS exit_status, coalesce(code <> 0, false) AS failed_here,
       recipe IN ('recipe[mv_balancer::create_jk]', 'recipe[mv_balancer::create_vhost]') AS is_balancer,
       CASE WHEN code IS NULL THEN 'no outcome reported' END AS _error
FROM step JOIN msg USING (k)
"""

ORACLE["flow_status"] = _FLOW + """
, pair AS (SELECT * FROM phase JOIN msg USING (k) JOIN prod USING (k) JOIN told USING (phase_id))
SELECT msg_id, phase_id, item AS cd_item, client_id AS cd_cliente, 'prod' AS cd_ambiente, execution_plan AS cd_plano_execucao,
       TIMESTAMP '2024-02-01 00:00:00' AS dh_criacao, 'start' AS event_kind, stem || '.started' AS cd_item_status,
       '0' AS nr_progresso, 'phase ' || phase_id AS ds_progresso
FROM pair
UNION ALL
SELECT msg_id, phase_id, item, client_id, 'prod', execution_plan, TIMESTAMP '2024-02-01 00:00:00', 'result',
       stem || CASE code WHEN 0 THEN '.done' ELSE '.failed' END, '100',
       CASE code WHEN 0 THEN 'phase ' || phase_id || ' done' ELSE 'Erro - phase ' || phase_id END
FROM pair
"""

ORACLE["flow_server_events"] = _FLOW + """
, visit AS (SELECT k, phase_id, srv_pos, max(code) AS code FROM step WHERE srv_pos >= 0 GROUP BY ALL
            HAVING bool_and(code IS NOT NULL))
SELECT msg_id, phase_id, visit.srv_pos::INTEGER AS srv_pos, product || '.' || p_name AS cd_item,
       stem || CASE code WHEN 0 THEN '.done' ELSE '.failed' END AS cd_item_status, client_id AS cd_cliente,
       'prod' AS cd_ambiente, execution_plan AS cd_plano_execucao, CAST(l_suppkey AS VARCHAR) AS cd_servidor
FROM visit JOIN msg USING (k) JOIN told USING (phase_id) JOIN line ON l_orderkey = k AND line.srv_pos = visit.srv_pos
"""

ORACLE["flow_logs"] = _FLOW + """
, said AS (
  SELECT k, unnest([{'lvl': 'INFO', 'txt': 'Executando ' || recipe || '!'},
                    CASE code WHEN 0 THEN {'lvl': 'INFO', 'txt': recipe || ' finalizado no servidor com sucesso!'}
                              WHEN 1 THEN {'lvl': 'ERROR', 'txt': recipe || ' finalizado no servidor com falha!'} END]) AS e,
         host || ' | Prod | ' || CASE WHEN installs THEN 'install' ELSE 'download' END || ' | ' AS head
  FROM step JOIN msg USING (k) WHERE recipe IS NOT NULL),
row AS (
  SELECT k, e.lvl AS lvl, head || e.txt AS txt FROM said WHERE e IS NOT NULL
  UNION ALL SELECT k, 'INFO', 'Processo concluido!' FROM ended WHERE NOT coalesce(silent, false) AND NOT coalesce(failed, false)
  UNION ALL SELECT k, 'ERROR', 'no outcome reported' FROM ended WHERE silent
  UNION ALL SELECT k, 'ERROR', CASE stop WHEN 'rejected'
                     THEN 'Requisitos para procedimentos no ambiente não atendidos, processo abortado!' ELSE stop END
            FROM msg WHERE stop IS NOT NULL)
SELECT client_id AS cd_cliente, 'plano.execucao' AS cd_tipo_log, execution_plan AS ds_identificador, 'S' AS sn_sincronizado,
       lvl AS ds_nivel, TIMESTAMP '2024-02-01 00:00:00' AS dh_log, txt AS lo_conteudo
FROM row JOIN msg USING (k)
"""

ORACLE["flow_registry"] = _FLOW + """
SELECT msg_id, client_id, 'Prod' AS environment, product AS cd_produto, product || '.' || p_name AS ds_versao,
       TIMESTAMP '2024-02-01 00:00:00' AS dh_atualizacao
FROM ended JOIN msg USING (k) JOIN prod USING (k)
WHERE installs AND NOT coalesce(silent, false) AND NOT coalesce(failed, false)
"""

# The chain of snapshots: numbered messages, islands by place less rank, and for each row the next place of its key.
_CHAIN = _FLOW + """,
chain AS (
  SELECT k, msg_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY o_orderdate, msg_id) - 1 AS seq
  FROM msg JOIN orders ON o_orderkey = k WHERE stop IS NULL AND installs),
item(product, context, item_pos) AS (
  VALUES ('SOUL-PRODUCT-WORKSPACE', 'soul-product-workspace', 0), ('SOUL-PRODUCT-FORMS', 'soul-product-forms', 1)),
app AS (
  SELECT c.client_id, c.k, c.msg_id, c.seq, n_name AS balancer_host, l_returnflag AS balancer_port, l.s_name AS server_host, srv_pos,
         CAST(l_linenumber AS VARCHAR) AS port, coalesce(i.product, l.product) AS product_name, i.context AS product_context,
         CASE WHEN i.product IS NULL THEN 'web' ELSE 'forms' END AS product_type, rec_pos AS app_pos, coalesce(i.item_pos, 0) AS item_pos
  FROM chain c JOIN line l ON l_orderkey = c.k JOIN supplier s ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN item i ON l.product = 'SOULMV-H5'),
held AS (SELECT client_id, balancer_host, balancer_port, seq,
           seq - row_number() OVER (PARTITION BY client_id, balancer_host, balancer_port ORDER BY seq) AS island
         FROM (SELECT DISTINCT client_id, balancer_host, balancer_port, seq FROM app)),
ends AS (SELECT client_id, balancer_host, balancer_port, island, max(seq) + 1 AS stop_seq FROM held GROUP BY ALL),
placed AS (
  SELECT a.*, island, stop_seq, row_number() OVER (
      PARTITION BY client_id, balancer_host, balancer_port, seq, server_host, port, product_name, product_type
      ORDER BY srv_pos, app_pos, item_pos) AS copy
  FROM app a JOIN held USING (client_id, balancer_host, balancer_port, seq) JOIN ends USING (client_id, balancer_host, balancer_port, island)),
history AS (
  SELECT p.*, coalesce((
      SELECT min(q.seq) FROM placed q
      WHERE q.client_id = p.client_id AND q.balancer_host = p.balancer_host AND q.balancer_port = p.balancer_port AND q.island = p.island
        AND q.server_host = p.server_host AND q.port = p.port AND q.seq > p.seq
        AND (p.copy > 1 OR (q.product_name = p.product_name AND q.product_type = p.product_type))), stop_seq) AS until_seq
  FROM placed p)
"""
_FLOW_TOPO = ("client_id, 'prod' AS environment, balancer_host, balancer_port, server_host, srv_pos::INTEGER AS srv_pos, port, product_name, "
              "product_context, product_type, app_pos::INTEGER AS app_pos, item_pos::INTEGER AS item_pos")

ORACLE["flow_topology"] = _CHAIN + f"""
SELECT {_FLOW_TOPO}, seq::INTEGER AS from_seq, until_seq::INTEGER AS until_seq FROM history
"""

ORACLE["flow_snapshots"] = _CHAIN + f""",
places AS (
  SELECT k, msg_id, client_id, seq AS now_seq, balancer_host, balancer_port,
         row_number() OVER (PARTITION BY k ORDER BY balancer_host, balancer_port) - 1 AS bal_pos
  FROM (SELECT DISTINCT k, msg_id, client_id, seq, balancer_host, balancer_port FROM app))
SELECT places.msg_id, bal_pos::INTEGER AS bal_pos, {_FLOW_TOPO}, CASE WHEN seq = now_seq THEN 'new' ELSE 'old' END AS origin, true AS returned
FROM history JOIN places USING (client_id, balancer_host, balancer_port) WHERE seq <= now_seq AND now_seq < until_seq
"""

ORACLE["disk_nodes"] = f"""
WITH dev AS (
  SELECT l_orderkey AS host, l_orderkey % 10 AS rest, l_orderkey % 3 = 0 AS win,
         CASE WHEN l_orderkey % 3 = 0 THEN chr(l_linenumber + 66) || ':' ELSE '/dev/l' || l_linenumber || '_' || l_partkey END AS device,
         trunc(l_quantity)::BIGINT AS size, trunc(l_extendedprice)::BIGINT // 1000 AS free,
         CASE WHEN l_orderkey % 2 = 0 THEN 'D:' ELSE 'C:' END AS drive,
         row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE l_partkey END, l_linenumber
                            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
best AS (
  SELECT host, device, free FROM (
    SELECT *, row_number() OVER (PARTITION BY host ORDER BY size DESC, device) AS pick
    FROM dev WHERE rn = 1 AND rest NOT IN (3, 5) AND CASE WHEN win THEN device = drive ELSE rest <> 7 END) WHERE pick = 1),
node AS (SELECT DISTINCT host, win, CASE WHEN rest IN (3, 5) THEN 'C:' ELSE drive END AS drive FROM dev),
judged AS (
  SELECT node.host, win, drive, device, free, coalesce(free >= 40, false) AS passed,
         CASE WHEN device IS NULL AND win THEN 'home drive not found: ' || drive
              WHEN device IS NULL THEN 'no usable device' END AS err
  FROM node LEFT JOIN best ON best.host = node.host)
SELECT host AS server_host, CASE WHEN win THEN 'WINDOWS' ELSE 'LINUX' END AS server_type, device, free AS free_mb, passed, err AS _error,
       CASE WHEN NOT passed THEN 'Falha ao checar espaço em disco livre do servidor ' || host || ' / Causa '
            || CASE WHEN device IS NULL AND win THEN 'MV_HOME [' || drive || '] não encontrada nos atributos do chef!'
                    WHEN device IS NULL THEN err
                    ELSE 'Servidor sem espaço em disco suficiente! Livre: ' || free || ' MB / Necessário: 40 MB' END END AS message
FROM judged
"""

ORACLE["client_registry"] = f"""
WITH news AS (SELECT CAST(user_id AS VARCHAR) AS client_id, 'v' || ({_K} % 3) AS agent_version,
                     CAST({_K} % 2 AS VARCHAR) AS env_hash, 'new' AS origin
              FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
FROM news
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 'v' || (c_custkey % 3), CAST(c_nationkey % 2 AS VARCHAR), 'kept'
FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT client_id FROM news)
"""

ORACLE["stream_route"] = ORACLE["msg_route"]

# ---------------------------------------------------------------------------
# The registry as of message time
# ---------------------------------------------------------------------------

_CHANGES = """
  SELECT client_id, changed_ts, arg_max(env_hash, change_id) AS env_hash FROM (
    SELECT CAST(c_custkey AS VARCHAR) AS client_id, TIMESTAMP '2023-12-31' AS changed_ts, CAST(c_nationkey % 2 AS VARCHAR) AS env_hash, -1 AS change_id
    FROM customer WHERE c_custkey % 2 = 1
    UNION ALL
    SELECT CAST(user_id AS VARCHAR), ts, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR), event_id
    FROM events WHERE event_type = 'click') GROUP BY client_id, changed_ts
"""
_GATED = f"""
  SELECT m.*, c.client_id IS NOT NULL AS known, type_message NOT IN ('BOOTSTRAP', 'INSTALLATION') OR m.checksum IS NOT DISTINCT FROM c.env_hash AS passes
  FROM ({_MESSAGES}) m ASOF LEFT JOIN ({_CHANGES}) c ON m.client_id = c.client_id AND m.arrival_ts >= c.changed_ts
"""

ORACLE["msg_accept_asof"] = f"""
SELECT msg_seq, client_id, message_id, type_message, checksum FROM ({_GATED}) WHERE known AND passes
"""

ORACLE["stream_gate"] = f"""
WITH RECURSIVE gated AS (SELECT *, datediff('day', DATE '2024-01-01', CAST(arrival_ts AS DATE)) AS day FROM ({_GATED})),
sent AS (SELECT *, CASE WHEN day < 10 THEN 0 WHEN day < 20 THEN 1 WHEN day < 40 THEN 2 ELSE 3 END
           + CASE WHEN CAST(message_id AS INTEGER) % 10 = 7 THEN 1 ELSE 0 END AS part FROM gated),
marks AS (SELECT p.part, (SELECT date_trunc('milliseconds', max(arrival_ts)) - INTERVAL 1 DAY FROM sent s WHERE s.part < p.part) AS mark
          FROM (SELECT DISTINCT part FROM sent) p),
timed AS (SELECT s.*, coalesce(arrival_ts < mark, false) AS late, client_id || '/' || message_id || '/' || type_message AS copy
          FROM sent s JOIN marks USING (part)),
passing AS (SELECT copy, arrival_ts, min(CAST(msg_seq AS VARCHAR)) AS tie FROM timed WHERE NOT late AND known AND passes GROUP BY ALL),
kept AS (
  SELECT copy, min(arrival_ts) AS arrival_ts FROM passing GROUP BY copy
  UNION ALL
  SELECT k.copy, min(p.arrival_ts) FROM kept k JOIN passing p ON p.copy = k.copy AND p.arrival_ts >= k.arrival_ts + INTERVAL 3 DAY
  GROUP BY k.copy, k.arrival_ts),
first_copy AS (SELECT copy, arrival_ts, tie FROM kept JOIN passing USING (copy, arrival_ts))
SELECT msg_seq, client_id, CASE WHEN late THEN 'late' WHEN NOT known THEN 'unknown' WHEN NOT passes THEN 'rejected'
  WHEN f.copy IS NOT NULL THEN 'accepted' ELSE 'repeat' END AS status
FROM timed t LEFT JOIN first_copy f ON f.copy = t.copy AND f.arrival_ts = t.arrival_ts AND f.tie = CAST(t.msg_seq AS VARCHAR)
"""

ORACLE["script_packages"] = """
WITH entry AS (
  SELECT doc_id % 40 AS p, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) - 1 AS entry_pos, doc_id % 7 <> 3 AS pre,
         (doc_id // 40 % 25)::VARCHAR || '.sql' AS name, strlen(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS md5
  FROM documents WHERE doc_id IS NOT NULL),
found AS (SELECT *, row_number() OVER (PARTITION BY p, name ORDER BY entry_pos DESC) AS back, count(*) OVER (PARTITION BY p) AS n_scripts
          FROM entry WHERE pre AND p <> 13)
SELECT 'p' || p || '.zip' AS filename, 'prod' || (p % 3) AS "productName", name, row_number() OVER (PARTITION BY p ORDER BY name) - 1 AS name_pos,
       entry_pos, n_chars::INTEGER AS n_chars, md5, n_scripts, false AS broken
FROM found WHERE back = 1
UNION ALL
SELECT 'p13.zip', 'prod1', NULL, NULL, NULL, NULL, NULL, 0, true WHERE EXISTS (SELECT 1 FROM entry WHERE p = 13)
"""

ORACLE["registry_store"] = """
WITH ev AS (SELECT *, user_id || ':' || event_type AS cd_produto, event_type || '.' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS ds_versao,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
have AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'view' AND k < 20 AND k % 2 = 0)
SELECT cd_produto, arg_max(ds_versao, (ts, event_id)) AS ds_versao, max(ts) AS dh_atualizacao
FROM ev WHERE ts < TIMESTAMP '2024-01-08' OR user_id IN (SELECT user_id FROM have) GROUP BY cd_produto
"""

ORACLE["snapshot_roundtrip"] = """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, lower(o_orderpriority) AS environment, o_orderkey AS srv_pos,
             CASE WHEN year(o_orderdate) < 1997 THEN 1 ELSE 2 END AS generation FROM orders WHERE year(o_orderdate) <= 1998)
SELECT client_id, environment, srv_pos, generation::BIGINT AS generation
FROM o QUALIFY generation = max(generation) OVER (PARTITION BY client_id, environment)
"""

ORACLE["run_durations"] = """
WITH e AS (
  SELECT user_id, ts, event_type = 'signup' AS stop, lead(event_type = 'signup') OVER w AS next_stop, lead(ts) OVER w AS next_ts,
         lag(event_type = 'signup') OVER w AS prev_stop
  FROM events WHERE event_type IN ('purchase', 'signup')
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'signup', event_id)),
r AS (
  SELECT user_id, ts AS start_ts, CASE WHEN next_stop THEN next_ts END AS end_ts FROM e WHERE NOT stop
  UNION ALL SELECT user_id, NULL, ts FROM e WHERE stop AND coalesce(prev_stop, true)),
u AS (SELECT *, epoch_us(end_ts) - epoch_us(start_ts) AS us FROM r)
SELECT user_id, start_ts, end_ts, (us // 3600000000 % 24)::INTEGER AS hours, (us // 60000000 % 60)::INTEGER AS minutes,
       (us // 1000000 % 60)::INTEGER AS seconds FROM u
"""

ORACLE["event_sink"] = ORACLE["step_logs"]
