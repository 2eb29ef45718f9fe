"""SQL text of the fixture views, used by the DuckDB oracle.

Each query's oracle SQL is ``WITH <needed views> <body>`` over the base
tables; the Spark side builds the same views with the DataFrame API
(``sources/fixtures.py``).
"""

VIEWS = {
    "readings": """
SELECT event_id AS offset_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'mqtt' ELSE 'opcua' END AS source_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'asset_' || CAST(user_id AS STRING) END AS asset_id,
  CAST(ts AS STRING) AS timestamp,
  CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN NULL ELSE 'good' END AS quality,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'READY'
       WHEN event_id % 13 = 0 THEN 'true' ELSE CAST(value AS STRING) END AS value,
  CASE WHEN event_type = 'view' THEN 'deg' ELSE NULL END AS unit
FROM events
""",
    "shells": """
SELECT 'https://example.com/ids/aas/0000_0000_0000_' || lpad(CAST(s_suppkey AS STRING), CAST(greatest(4, length(CAST(s_suppkey AS STRING))) AS INT), '0') AS shell_id,
  s_name AS id_short, s_suppkey FROM supplier
""",
    "submodel_refs": """
SELECT DISTINCT 'https://example.com/ids/aas/0000_0000_0000_' || lpad(CAST(l_suppkey AS STRING), CAST(greatest(4, length(CAST(l_suppkey AS STRING))) AS INT), '0') AS shell_id,
  'https://example.com/ids/sm/0000_0000_' || lpad(CAST(k AS STRING), CAST(greatest(8, length(CAST(k AS STRING))) AS INT), '0') AS submodel_id
FROM (SELECT l_suppkey, CASE WHEN l_partkey % 10 = 3 THEN l_partkey + 50000000 ELSE l_partkey END AS k FROM lineitem)
""",
    "submodels": """
SELECT 'https://example.com/ids/sm/0000_0000_' || lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '0') AS submodel_id,
  p_type AS id_short, p_brand AS semantic_group, p_retailprice AS price FROM part
""",
    "nodes": """
SELECT CAST(NULL AS STRING) AS parent_id, 'ns=2;s=R' || CAST(r_regionkey AS STRING) AS node_id, r_name AS name, 'Object' AS node_class, CAST(NULL AS STRING) AS value FROM region
UNION ALL SELECT 'ns=2;s=R' || CAST(n_regionkey AS STRING), 'ns=2;s=N' || CAST(n_nationkey AS STRING), n_name, 'Object', CAST(NULL AS STRING) FROM nation
UNION ALL SELECT 'ns=2;s=N' || CAST(c_nationkey AS STRING), 'ns=2;s=C' || CAST(c_custkey AS STRING), c_name, 'Variable', CAST(c_acctbal AS STRING) FROM customer
""",
    "tool_calls": """
SELECT user_id AS run_id, event_id AS seq, event_type AS tool FROM events
""",
    "rpc_requests": """
SELECT o_orderkey AS id, o_orderstatus AS method, o_orderdate AS sent_at FROM orders
""",
    "rpc_responses": """
SELECT l_orderkey AS id, min(l_shipdate) AS recv_at, CASE WHEN max(l_returnflag) = 'R' THEN -32601 ELSE NULL END AS error_code FROM lineitem GROUP BY l_orderkey
""",
    "topics": """
SELECT 'opcua.s' || CAST(s_suppkey AS STRING) || '.raw' AS topic, 1 AS partitions FROM supplier
UNION ALL SELECT 'opcua.s' || CAST(s_suppkey AS STRING) || '.processed', 1 FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT '__consumer_offsets', 50 UNION ALL SELECT 'agentic_ksql_log', 1
""",
    "sinks": """
SELECT 'mongo-sink-opcua-s' || CAST(s_suppkey AS STRING) || '-processed' AS connector,
  CASE s_suppkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PAUSED' ELSE 'RUNNING' END AS state FROM supplier WHERE s_suppkey % 3 <> 0
""",
    "reviews": """
SELECT doc_id AS review_id, CASE WHEN doc_id % 13 = 0 THEN 'no review' WHEN doc_id % 17 = 0 THEN '{"approved":true,"issues":[]}'
  ELSE '{"approved":' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || ',"summary":"s","issues":['
  || CASE WHEN doc_id % 9 = 0 THEN '{"severity":"blocker","criterion":"security","description":"d","fix":"f"}' WHEN doc_id % 6 = 0 THEN ''
       ELSE '{"severity":"warning","criterion":"code_quality","description":"d","fix":"f"}' END
  || CASE WHEN toxic = 1 AND (doc_id % 9 = 0 OR doc_id % 6 <> 0) THEN ',{"severity":"critical","criterion":"security","description":"d","fix":"f"}' ELSE '' END
  || ']}' END AS body FROM labels
""",
    "raw_messages": """
SELECT offset_id, CASE WHEN offset_id % 19 = 0 THEN '{"asset_id": broken'
  ELSE '{"source_type":' || coalesce('"' || source_type || '"', 'null') || ',"asset_id":' || coalesce('"' || asset_id || '"', 'null')
    || ',"timestamp":"' || timestamp || '","quality":' || coalesce('"' || quality || '"', 'null')
    || ',"value":' || CASE WHEN value IS NULL THEN 'null' WHEN value = 'READY' THEN '"READY"' ELSE value END || ',"unit":' || coalesce('"' || unit || '"', 'null') || '}' END AS value
FROM readings
""",
    "pipeline_flags": """
SELECT DISTINCT asset_id, CAST(substr(asset_id, 7) AS INT) % 2 = 0 AS cleansing, CAST(substr(asset_id, 7) AS INT) % 3 = 0 AS imputation,
  CAST(substr(asset_id, 7) AS INT) % 5 <> 0 AS normalize, CAST(substr(asset_id, 7) AS INT) % 7 = 0 AS transformation FROM readings WHERE asset_id IS NOT NULL
""",
    "stages": """
SELECT s_suppkey AS pipeline_id, k.rank AS rank, k.stage AS stage, k.stage || '_' || CAST(s_suppkey AS STRING) AS component,
  CASE WHEN k.rank = 3 AND s_suppkey % 4 = 1 THEN 'mqtt' ELSE 'opcua' END AS protocol,
  CASE WHEN s_suppkey % 6 = 0 AND k.rank = 3 THEN 'Utilization_' || CAST(s_suppkey AS STRING)
       WHEN k.rank = 6 THEN NULL ELSE k.next || '_' || CAST(s_suppkey AS STRING) END AS aas_destination
FROM supplier CROSS JOIN (SELECT 1 AS rank, 'Collection' AS stage, 'PreProcess' AS next UNION ALL SELECT 3, 'PreProcess', 'Storage'
  UNION ALL SELECT 4, 'Storage', 'Utilization' UNION ALL SELECT 6, 'Utilization', CAST(NULL AS STRING)) k
""",
    "change_log": """
SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'replace' WHEN 2 THEN 'patch' ELSE 'delete' END AS op, o_orderpriority AS body FROM orders
""",
    "element_trees": """
SELECT 'https://example.com/ids/sm/0000_0000_' || lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '0') AS submodel_id,
  '[{"modelType":"SubmodelElementCollection","idShort":"Cleansing","value":[{"modelType":"Property","idShort":"Enabled","valueType":"xs:boolean","value":"'
  || CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END || '"}]},{"modelType":"Range","idShort":"Size","valueType":"xs:int","min":"0","max":"' || CAST(p_size AS STRING)
  || '"},{"modelType":"Property","idShort":"Brand","valueType":"xs:string","value":"' || p_brand || '"}]' AS elements_json FROM part
""",
    "modbus_polls": """
SELECT event_id, ts, event_id % 100 AS r0, event_id % 91 AS r1, event_id % 82 AS r2, event_id % 73 AS r3, event_id % 64 AS r4, event_id % 55 AS r5, event_id % 46 AS r6,
  event_id % 37 AS r7, event_id % 28 AS r8, event_id % 19 AS r9 FROM events
""",
    "plans": """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not json' ELSE '{"technology_lower":' || CASE WHEN doc_id % 17 = 0 THEN 'null' ELSE '"t' || CAST(doc_id AS STRING) || '"' END
  || ',"technology_pascal":"T' || CAST(doc_id AS STRING) || '","default_port":' || CASE WHEN doc_id % 11 = 0 THEN '"abc"' ELSE '8000' END
  || ',"server_instructions":"s"' || CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 13 = 0 THEN ',"tools":"read"' ELSE ',"tools":[{"name":"read"}]' END
  || ',"clarification_questions":[' || CASE WHEN quality = 0 THEN '"q"' ELSE '' END || ']}' END AS body FROM labels
""",
    "token_deltas": """
SELECT conv_id * 1000000 + turn AS message_id, unnest(range(len(w))) AS seq, unnest(w) || ' ' AS delta
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
""",
    "hits": """
SELECT page_id // 20 AS query_id, page_id AS pos, CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS snippet, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ftp:' || url ELSE url END AS url, CAST(CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(page_id AS DOUBLE) / 1024 END AS DOUBLE) AS score FROM pages
""",
    "audit_calls": """
SELECT o_custkey AS request_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'generate_mcp_server' WHEN 1 THEN 'review_code' ELSE 'clarify' END AS tool,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus = 'F' ELSE NULL END AS approved FROM orders
""",
}


DEPENDS = {"raw_messages": ["readings"], "pipeline_flags": ["readings"]}


def with_views(names, body: str) -> str:
    """Prefix ``body`` with CTEs for ``names`` (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    head = body.lstrip()
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{head[15:]}"
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{body}"
