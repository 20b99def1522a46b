"""The same results in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from spanflow.plans.fixtures import CATALOG, CUSTOMER_ATTRIBUTES, CYCLIC_SPANS, EVENT_SPANS, F1, HOT_SPANS, ORDER_SPANS

_E, _O, _K, _A = f"WITH {EVENT_SPANS}", f"WITH {ORDER_SPANS}", f"WITH RECURSIVE {CATALOG}", f"WITH {CUSTOMER_ATTRIBUTES}"

_TIME = """,
I AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, ordinal) idx FROM E),
T AS (SELECT DISTINCT trace_id FROM E),
M0 AS (SELECT trace_id, min(idx) FILTER (service = 'signup') m, 0 since FROM I GROUP BY 1),
M1 AS (SELECT I.trace_id, min(idx) FILTER (service = 'view' AND idx > coalesce(m, since)) m, any_value(coalesce(m, since)) since FROM I JOIN M0 USING (trace_id) GROUP BY 1),
M2 AS (SELECT I.trace_id, min(idx) FILTER (service = 'purchase' AND idx > coalesce(m, since)) m, any_value(coalesce(m, since)) since FROM I JOIN M1 USING (trace_id) GROUP BY 1),
S0 AS (SELECT trace_id, 0 pos, 's1' step, 'signup.evt' AS call, m, since FROM M0 UNION ALL SELECT trace_id, 1, 's2', 'view.evt', m, since FROM M1 UNION ALL SELECT trace_id, 2, 's3', 'purchase.evt', m, since FROM M2),
S AS (SELECT S0.trace_id, pos, step, call, m, since, span_id, k, I.status code, CASE WHEN m IS NULL THEN 'FAIL' ELSE 'PASS' END status FROM S0 LEFT JOIN I ON S0.trace_id = I.trace_id AND S0.m = I.idx)"""

_CONDITIONS = """
  SELECT *, unnest([{'condition': 'ghost', 'result': 'SKIP'}, {'condition': 'hasK', 'result': 'PASS'}, {'condition': 'smallK', 'result': CASE WHEN k < 50 THEN 'PASS' ELSE 'FAIL' END},
                    {'condition': 'statusOk', 'result': CASE WHEN coalesce(code, 0) = 200 THEN 'PASS' ELSE 'FAIL' END}]) u"""
# Without a status, response.status is 0.

_RUN = (
    _TIME
    + f""",
C AS (SELECT trace_id, pos, step, 'post' kind, u.condition AS condition, u.result AS result FROM ({_CONDITIONS} FROM S WHERE m IS NOT NULL)),
R AS (SELECT trace_id, pos, step, call, m IS NOT NULL found, CASE WHEN m IS NOT NULL AND k < 50 AND code = 200 THEN 'PASS' ELSE 'FAIL' END status FROM S),
CS AS (SELECT trace_id, count(*) steps_total, count(*) FILTER (status = 'PASS') steps_pass, count(*) FILTER (status = 'FAIL') steps_fail, count(*) FILTER (status = 'SKIP') steps_skip FROM R GROUP BY 1),
CC AS (SELECT trace_id, count(*) t, count(*) FILTER (result = 'PASS') p, count(*) FILTER (result = 'FAIL') f, count(*) FILTER (result = 'SKIP') s FROM C GROUP BY 1),
COV AS (SELECT CS.*, coalesce(t, 0) conditions_total, coalesce(p, 0) conditions_pass, coalesce(f, 0) conditions_fail, coalesce(s, 0) conditions_skip FROM CS LEFT JOIN CC USING (trace_id)),
G AS (SELECT *, steps_pass / steps_total sr, coalesce(conditions_pass / nullif(conditions_pass + conditions_fail, 0), 0) cr FROM COV)"""
)

_FIRST = """,
P AS (SELECT a.*, b.span_id parent FROM E a LEFT JOIN E b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id),
F2 AS (SELECT * FROM (VALUES (0, NULL, 'p1', 'signup'), (1, 'par', 'p2', 'view'), (2, 'par', 'p3', 'click'), (3, NULL, 'p4', 'purchase')) t(pos, grp, step, service)),
FS AS (SELECT t.trace_id, F2.pos, F2.grp, F2.step, x.span_id, x.start_ns, x.end_ns, x.parent, x.k, x.status code FROM (SELECT DISTINCT trace_id FROM E) t CROSS JOIN F2
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY start_ns, ordinal) r FROM P) x ON x.trace_id = t.trace_id AND x.service = F2.service AND r = 1)"""

_PARALLEL = (
    _FIRST
    + """,
PG AS (SELECT a.trace_id, a.grp, CAST((count(DISTINCT a.pos) FILTER (a.span_id IS NOT NULL)) AS INT) n_matched,
              NOT coalesce(bool_or(a.pos < b.pos AND a.span_id IS NOT NULL AND b.span_id IS NOT NULL AND NOT (a.start_ns < b.end_ns AND b.start_ns < a.end_ns OR a.parent IS NOT DISTINCT FROM b.parent)), false) concurrent
       FROM FS a JOIN FS b ON a.trace_id = b.trace_id AND a.grp = b.grp GROUP BY 1, 2)"""
)

_EDGES = """,
PE AS (SELECT a.trace_id, b.span_id from_id, a.span_id to_id, 'parent' relationship FROM E a JOIN E b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id AND a.span_id <> b.span_id),
NP AS (SELECT E.*, from_id parent FROM E LEFT JOIN PE ON E.trace_id = PE.trace_id AND E.span_id = PE.to_id),
TL AS (SELECT trace_id, span_id, start_ns, end_ns, parent, lead(span_id) OVER w n_id, lead(start_ns) OVER w n_start, lead(end_ns) OVER w n_end, lead(parent) OVER w n_parent FROM NP WINDOW w AS (PARTITION BY trace_id ORDER BY start_ns, span_id)),
TE AS (SELECT trace_id, span_id from_id, n_id to_id, CASE WHEN end_ns <= n_start THEN 'follows' WHEN start_ns < n_end AND n_start < end_ns THEN 'concurrent' END relationship
       FROM TL WHERE n_id IS NOT NULL AND parent IS NOT DISTINCT FROM n_parent),
CE AS (SELECT * FROM PE UNION ALL SELECT * FROM TE WHERE relationship IS NOT NULL),
V AS (SELECT c.trace_id, from_id, to_id, CASE WHEN relationship = 'follows' AND f.end_ns > t.start_ns + 50000000 THEN 'causality'
             WHEN relationship = 'parent' AND (t.start_ns < f.start_ns - 50000000 OR t.end_ns > f.end_ns + 50000000) THEN 'parent-child'
             WHEN relationship = 'concurrent' AND NOT (f.start_ns < t.end_ns AND t.start_ns < f.end_ns) THEN 'overlap' END "type"
      FROM CE c JOIN E f ON c.trace_id = f.trace_id AND c.from_id = f.span_id JOIN E t ON c.trace_id = t.trace_id AND c.to_id = t.span_id)"""

_DAG_ROW = "SELECT trace_id, -1 pos, 'DAG Validation' step, 'FAIL' status, 'Detected ' || count(*) || ' DAG constraint violations' note FROM V WHERE \"type\" IS NOT NULL GROUP BY 1"

_GRAPH = """,
GN AS (SELECT * FROM (VALUES (0, 'n1', 'signup', 1), (1, 'n2', 'view', 1), (2, 'n3', 'click', 1), (3, 'n4', 'purchase', 1), (4, 'n5', 'view', 2)) t(pos, node, service, rnk)),
GE AS (SELECT * FROM (VALUES ('n2', 'n1', 'signup', 0), ('n3', 'n1', 'signup', 0), ('n4', 'n2', 'view', 0), ('n4', 'n3', 'click', 1), ('n5', 'n4', 'purchase', 0)) t(node, pred, p_service, edge)),
GR AS (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY ordinal) r FROM E),
GM AS (SELECT t.trace_id, GN.pos, GN.node, GN.service || '.evt' AS call, GN.rnk, x.span_id, x.start_ns, x.k, x.status code, x.parent_span_id FROM (SELECT DISTINCT trace_id FROM E) t CROSS JOIN GN
       LEFT JOIN GR x ON x.trace_id = t.trace_id AND x.service = GN.service AND x.r = GN.rnk),
GP AS (SELECT m.trace_id, m.node, m.pos, e.pred, e.edge, m.start_ns < p.start_ns late, m.parent_span_id IS DISTINCT FROM p.span_id stranger
       FROM GM m JOIN GE e USING (node) JOIN GR p ON p.trace_id = m.trace_id AND p.service = e.p_service AND p.r = 1 WHERE m.span_id IS NOT NULL),
GL AS (SELECT trace_id, node, arg_min(pred, edge) first_bad FROM GP WHERE late GROUP BY 1, 2)"""

_LEVELS = """,
D AS (SELECT DISTINCT {key}, from_id, to_id FROM {edges}),
RL AS (SELECT {nodes}, 0 level FROM {table} UNION SELECT D.{key}, D.to_id, level + 1 FROM RL JOIN D ON RL.{key} = D.{key} AND RL.id = D.from_id)"""

_NAMED = """,
NX AS (SELECT flow_id, 'n' || a from_id, 'n' || b to_id FROM X), NI AS (SELECT flow_id, 'n' || a from_id, 'n' || b to_id FROM XI), NA AS (SELECT flow_id, 'n' || a from_id, 'n' || b to_id FROM XA)"""

_IO = """,
R0 AS (SELECT flow_id, 'n' || a node, unnest(['v_' || b || '.x', 'userId']) variable FROM XA UNION ALL SELECT flow_id, 'n' || b, 'v_' || a FROM XA),
RF AS (SELECT DISTINCT * FROM R0), ROOT AS (SELECT *, split_part(variable, '.', 1) root FROM RF WHERE split_part(variable, '.', 1) <> 'userId'),
OUTS AS (SELECT flow_id, node, 'v_' || n variable FROM N)"""

_UNDECLARED = "SELECT flow_id, node subject, split_part(call, '.', 1) service FROM N WHERE split_part(call, '.', 1) = 'svc2' AND flow_id % 2 = 1"
_DANGLING = "SELECT NX.flow_id, from_id, to_id FROM NX LEFT JOIN N ON NX.flow_id = N.flow_id AND NX.to_id = N.node WHERE N.node IS NULL"
_TWICE = "SELECT CAST(l_orderkey AS BIGINT) flow_id, 'n' || l_linenumber AS name, count(*) uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"

_URL = """CASE WHEN coalesce(url, '') = '' THEN '' WHEN url LIKE '/%' THEN url WHEN contains(url, '://') THEN
  CASE WHEN contains(substr(url, strpos(url, '://') + 3), '/') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(/[^?#]*)', 1) ELSE '/' END ELSE url END"""
_PASCAL = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace({0}, '[-_.]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '')"
_KEEP = "array_to_string(list_transform(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '')"
_CAMEL = "lower(({0})[1]) || ({0})[2:]"
_SEGMENTS = _PASCAL.format("seg")


def _masked(expression: str) -> str:
    return f"{_A} SELECT ordinal, key, {expression} AS masked FROM A"


_PREFIX2 = "CASE WHEN NOT is_string OR length(value) <= 2 THEN value ELSE value[:2] || repeat('*', length(value) - 2) END"
_ID = "CASE WHEN is_string THEN sha256(value || 'tenant-xyz') ELSE value END"
_TOKEN = "CASE WHEN is_string THEN 'pii_' || sha256(value || 'global-salt')[:8] ELSE value END"
_RULE = "CASE WHEN key = 'customerId' THEN 0 WHEN regexp_matches(key, '(?i)email') THEN 1 WHEN regexp_matches(key, '(?i)phone') OR regexp_matches(key, '(?i)tel') THEN 2 ELSE 3 END"
_POLICY = f"CASE {_RULE} WHEN 0 THEN {_ID} WHEN 1 THEN {_PREFIX2} WHEN 2 THEN '***REDACTED***' ELSE {_TOKEN} END"

# The three contracts: what each trace's steps find, by its route, and what conditions say of it.
_CONTRACTS = (
    _TIME
    + """,
RT AS (SELECT trace_id, bool_or(parent_span_id IS NOT NULL) p FROM E GROUP BY 1),
P AS (SELECT a.*, b.span_id parent FROM E a LEFT JOIN E b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id),
FI AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY start_ns, ordinal) r FROM P) WHERE r = 1),
SE AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY ordinal) r FROM E) WHERE r = 1),
ST AS (SELECT * FROM (VALUES ('linear', 0, NULL, 's1', 'signup'), ('linear', 1, NULL, 's2', 'view'), ('linear', 2, NULL, 's3', 'purchase'), ('parallel', 0, NULL, 'p1', 'signup'),
  ('parallel', 1, 0, 'p2', 'view'), ('parallel', 1, 1, 'p3', 'click'), ('parallel', 2, NULL, 'p4', 'purchase')) t(flow_id, pos, gp, step, service)),
CA AS (SELECT RT.trace_id, ST.*, f.span_id, f.start_ns, f.end_ns, f.parent, e.k, e.status code FROM RT JOIN ST ON RT.p OR ST.flow_id = 'parallel'
       LEFT JOIN FI f ON f.trace_id = RT.trace_id AND f.service = ST.service LEFT JOIN SE e ON e.trace_id = RT.trace_id AND e.service = ST.service),
AP AS (SELECT a.trace_id, a.flow_id, a.pos FROM CA a JOIN CA b ON a.trace_id = b.trace_id AND a.flow_id = b.flow_id AND a.pos = b.pos AND a.gp < b.gp
       WHERE a.span_id IS NOT NULL AND b.span_id IS NOT NULL AND NOT (a.start_ns < b.end_ns AND b.start_ns < a.end_ns OR a.parent IS NOT DISTINCT FROM b.parent)),
MT AS (SELECT S.trace_id, 'linear' flow_id, pos, step, split_part(call, '.', 1) service, span_id, k, code, m IS NOT NULL found,
              CASE WHEN m IS NULL THEN 'no matching span found in trace' WHEN m > since + 1 THEN 'matched span #' || m || ' by time sequence (intermediate spans exist)' ELSE '' END note
       FROM S JOIN RT ON S.trace_id = RT.trace_id WHERE NOT p
       UNION ALL SELECT trace_id, flow_id, pos, step, service, span_id, k, code, span_id IS NOT NULL AND NOT coalesce(apart, false),
              CASE WHEN span_id IS NULL THEN 'no matching span found in trace' ELSE '' END FROM CA LEFT JOIN (SELECT DISTINCT trace_id, flow_id, pos, true apart FROM AP) a USING (trace_id, flow_id, pos)
       UNION ALL SELECT GM.trace_id, 'graph', pos, GM.node, split_part(call, '.', 1), span_id, k, code, span_id IS NOT NULL AND first_bad IS NULL,
              CASE WHEN span_id IS NULL THEN 'no matching span found in trace' WHEN first_bad IS NOT NULL THEN 'starts before ' || first_bad ELSE '' END
       FROM GM LEFT JOIN GL ON GM.trace_id = GL.trace_id AND GM.node = GL.node),
CD AS (SELECT * FROM (VALUES ('signup', 'post', 'statusOk'), ('view', 'post', 'hasK'), ('view', 'post', 'smallK'), ('purchase', 'pre', 'ghost'), ('purchase', 'post', 'statusOk'), ('purchase', 'post', 'typed')) t(service, kind, condition), (VALUES ('linear'), ('parallel'), ('graph')) f(flow_id)
  UNION ALL SELECT * FROM (VALUES ('click', 'post', 'pattern', 'graph'), ('click', 'post', 'sized', 'graph'), ('view', 'post', 'broken', 'linear'), ('view', 'post', 'decided', 'linear'), ('view', 'post', 'both', 'parallel'),
  ('click', 'post', 'either', 'parallel'), ('click', 'post', 'named', 'graph')) t(service, kind, condition, flow_id)),
CRS AS (SELECT trace_id, flow_id, pos, step, kind, condition, CASE condition WHEN 'statusOk' THEN CASE WHEN coalesce(code, 0) = 200 THEN 'PASS' ELSE 'FAIL' END WHEN 'smallK' THEN CASE WHEN k < 50 THEN 'PASS' ELSE 'FAIL' END
          WHEN 'both' THEN CASE WHEN k < 70 AND coalesce(code, 0) <> 200 THEN 'PASS' ELSE 'FAIL' END WHEN 'either' THEN CASE WHEN k < 10 OR coalesce(code, 0) = 404 THEN 'PASS' ELSE 'FAIL' END
          WHEN 'hasK' THEN 'PASS' WHEN 'typed' THEN 'PASS' WHEN 'decided' THEN 'PASS' WHEN 'named' THEN 'PASS' ELSE 'SKIP' END result FROM MT JOIN CD USING (service, flow_id) WHERE MT.found),
BD AS (SELECT DISTINCT trace_id, flow_id, pos, step FROM CRS WHERE result = 'FAIL')"""
)

_CYCLE_ROWS = """,
PE AS (SELECT a.trace_id, b.span_id from_id, a.span_id to_id, 'parent' relationship FROM EC a JOIN EC b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id AND a.span_id <> b.span_id),
UPC AS (SELECT trace_id, to_id id, from_id parent FROM PE),
WC AS (SELECT trace_id, id start_id, parent here, [id] path FROM UPC
      UNION ALL SELECT WC.trace_id, start_id, parent, list_append(path, here) FROM WC JOIN UPC ON WC.trace_id = UPC.trace_id AND WC.here = UPC.id WHERE here <> start_id AND NOT list_contains(path[2:], here)),
CYC AS (SELECT DISTINCT trace_id FROM WC WHERE here = start_id)"""

ORACLES: dict[str, str] = {
    "contract_validation": f"""{_E}{_EDGES}{_GRAPH}{_CONTRACTS}
SELECT V.trace_id, f.flow_id, -1 pos, 'DAG Validation' step, 'FAIL' status, 'Detected ' || count(*) || ' DAG constraint violations' note, CAST(NULL AS VARCHAR) span_id, false found
FROM V JOIN RT ON V.trace_id = RT.trace_id JOIN (VALUES ('linear'), ('parallel'), ('graph')) f(flow_id) ON RT.p OR f.flow_id <> 'linear' WHERE "type" IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT m.trace_id, m.flow_id, m.pos, m.step, CASE WHEN BD.step IS NOT NULL OR NOT found THEN 'FAIL' ELSE 'PASS' END, CASE WHEN BD.step IS NOT NULL THEN 'Semantic validation failed' ELSE note END, span_id, found
FROM MT m LEFT JOIN BD ON m.trace_id = BD.trace_id AND m.flow_id = BD.flow_id AND m.step = BD.step""",
    "contract_conditions": f"{_E}{_EDGES}{_GRAPH}{_CONTRACTS} SELECT * FROM CRS",
    "edge_violations_cyclic": f"""WITH RECURSIVE {CYCLIC_SPANS}{_CYCLE_ROWS}{_EDGES[_EDGES.index("NP AS") - 2:].replace("FROM E ", "FROM EC ").replace("JOIN E ", "JOIN EC ").replace("SELECT E.*", "SELECT EC.*").replace("ON E.", "ON EC.").replace("AND E.", "AND EC.")}
SELECT trace_id, "type", count(*) n FROM V WHERE "type" IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT trace_id, 'cycle', 1 FROM CYC""",
    "call_graph_services": f"{_E} SELECT trace_id, service, count(*) nodes FROM E GROUP BY 1, 2",
    "call_graph_depth": f"WITH RECURSIVE {EVENT_SPANS}{_EDGES}, NC AS (SELECT * FROM CE WHERE relationship <> 'concurrent'){_LEVELS.format(key='trace_id', edges='NC', nodes='trace_id, span_id id', table='E')} SELECT trace_id, max(level) depth FROM RL GROUP BY 1",
    "report_totals": f"{_E}{_RUN} SELECT trace_id, count(*) total, count(*) FILTER (status = 'PASS') passed, count(*) FILTER (status = 'FAIL') failed, count(*) FILTER (status = 'FAIL') = 0 success FROM R GROUP BY 1",
    "baseline_record": f"""{_E}{_RUN}, OK AS (SELECT trace_id FROM R GROUP BY 1 HAVING bool_and(status = 'PASS')),
Q AS (SELECT trace_id, step, string_agg(kind || ':' || condition || '=' || CASE WHEN result = 'PASS' THEN 'true' ELSE 'false' END, ',' ORDER BY condition) t FROM C GROUP BY 1, 2),
Q2 AS (SELECT trace_id, string_agg(step || '/' || t, ';' ORDER BY step) conditions FROM Q GROUP BY 1)
SELECT trace_id, '1' schema_version, 'sha256:' || sha256('{str(F1).replace("'", "''")}') flow_hash, 3 steps_total, 's1,s2,s3' covered, coalesce(conditions, '') conditions FROM OK LEFT JOIN Q2 USING (trace_id)""",
    "gate_recorded": f"""{_E}{_RUN}, OK AS (SELECT trace_id FROM R GROUP BY 1 HAVING bool_and(status = 'PASS')),
BS AS (SELECT split_part(trace_id, '-', 1) "user", count(*) FILTER (result = 'PASS') / count(*) base_c FROM C JOIN OK USING (trace_id) GROUP BY 1),
NW AS (SELECT split_part(trace_id, '-', 1) "user", sum(steps_pass) / sum(steps_total) now_s, coalesce(sum(conditions_pass) / nullif(sum(conditions_pass + conditions_fail), 0), 0) now_c FROM COV GROUP BY 1),
Z AS (SELECT *, 1.0::DOUBLE base_s, now_s - 1 d_s, now_c - base_c d_c FROM NW JOIN BS USING ("user"))
SELECT "user", round(base_s, 6) base_steps, round(now_s, 6) steps, round(d_s, 6) steps_delta, round(d_s / base_s, 6) steps_delta_pct, round(base_c, 6) base_conditions, round(now_c, 6) conditions, round(d_c, 6) conditions_delta,
  round(CASE WHEN base_c > 0 THEN d_c / base_c ELSE 0 END, 6) conditions_delta_pct, d_s / base_s >= -0.3 AND CASE WHEN base_c > 0 THEN d_c / base_c ELSE 0 END >= -0.3 passed FROM Z""",
    "span_totals": f"{_O} SELECT count(*) spans, count(DISTINCT trace_id) traces, count(DISTINCT service) services, count(DISTINCT name) operations FROM O",
    "discover_lint_gate_dotted": f"{_O} SELECT trace_id, count(*) steps, count(*) FILTER (ordinal % 5 = 0) errors, count(*) FILTER (ordinal % 5 = 0) = 0 passed FROM O GROUP BY 1",
    "discover_http_operations": f"{_E} SELECT service, CASE k % 3 WHEN 0 THEN 'get' || upper(service[1]) || service[2:] || 'ListByItemId' WHEN 1 THEN 'do' || upper(service[1]) || service[2:] ELSE 'evt' END operation, count(*) spans FROM E GROUP BY 1, 2",
    "mask_totals": f"{_A} SELECT count(DISTINCT ordinal) spans, count(*) AS attributes, count(*) masked FROM A",
    "lint_issues": f"""{_K}{_NAMED},
REACH AS (SELECT flow_id, from_id, to_id FROM NI UNION SELECT REACH.flow_id, REACH.from_id, NI.to_id FROM REACH JOIN NI ON REACH.flow_id = NI.flow_id AND REACH.to_id = NI.from_id),
EN AS (SELECT N.flow_id, node FROM N WHERE NOT EXISTS (SELECT 1 FROM NI WHERE NI.flow_id = N.flow_id AND NI.to_id = N.node)),
SEEN AS (SELECT flow_id, node FROM EN UNION SELECT r.flow_id, r.to_id FROM REACH r JOIN EN ON r.flow_id = EN.flow_id AND r.from_id = EN.node),
ISS AS (SELECT -flow_id - 1 flow_id, 'ERROR' "level", 'call format' rule FROM N WHERE n <= 2
  UNION ALL SELECT flow_id, 'ERROR', 'undeclared service' FROM ({_UNDECLARED})
  UNION ALL SELECT flow_id, 'ERROR', 'missing operation' FROM N WHERE (split_part(call, '.', 1) <> 'svc2' OR flow_id % 2 = 0) AND call NOT IN (SELECT call FROM N WHERE n <= 5)
  UNION ALL SELECT flow_id, 'ERROR', 'dangling edge' FROM ({_DANGLING})
  UNION ALL SELECT -flow_id - 1, 'ERROR', 'step name' FROM N WHERE n <= 2 GROUP BY flow_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT flow_id, 'ERROR', 'cycle' FROM REACH WHERE from_id = to_id
  UNION ALL SELECT N.flow_id, 'ERROR', 'unreachable nodes' FROM N LEFT JOIN SEEN ON N.flow_id = SEEN.flow_id AND N.node = SEEN.node WHERE N.flow_id IN (SELECT flow_id FROM EN) GROUP BY 1 HAVING count(*) FILTER (SEEN.node IS NULL) > 0
  UNION ALL SELECT DISTINCT -flow_id - 1, 'WARN', 'legacy format' FROM N WHERE n <= 2)
SELECT flow_id, "level", rule, count(*) issues FROM ISS GROUP BY ALL""",
    "time_sequence_steps": f"{_E}{_TIME} SELECT trace_id, pos, step, status, span_id, CASE WHEN m IS NULL THEN 'no matching span found in trace' WHEN m > since + 1 THEN 'matched span #' || m || ' by time sequence (intermediate spans exist)' ELSE '' END note FROM S",
    "time_sequence_verdict": f"{_E}{_TIME} SELECT trace_id, count(*) steps, count(*) FILTER (status = 'PASS') passed, bool_and(status = 'PASS') ok FROM S GROUP BY 1",
    "step_presence": f"{_E}{_FIRST} SELECT trace_id, pos, step, CASE WHEN span_id IS NULL THEN 'FAIL' ELSE 'PASS' END status, span_id FROM FS",
    "parallel_group_check": f"{_E}{_PARALLEL} SELECT * FROM PG",
    "causality_validation": f"""{_E}{_PARALLEL}{_EDGES},
B AS (SELECT FS.*, CASE WHEN span_id IS NULL OR grp IS NOT NULL AND NOT concurrent THEN 'FAIL' ELSE 'PASS' END s0 FROM FS LEFT JOIN PG USING (trace_id, grp)),
B2 AS (SELECT *, s0 = 'PASS' AND NOT (k < 50 AND coalesce(code, 0) = 200) semantic FROM B)
{_DAG_ROW} UNION ALL SELECT trace_id, pos, step, CASE WHEN semantic THEN 'FAIL' ELSE s0 END, CASE WHEN semantic THEN 'Semantic validation failed' ELSE '' END FROM B2""",
    "validation_route": f"{_E} SELECT trace_id, CASE WHEN bool_or(parent_span_id IS NOT NULL) THEN 'causality' ELSE 'time' END route FROM E GROUP BY 1",
    "parent_edges": f"{_E}{_EDGES} SELECT * FROM PE",
    "temporal_edges": f"{_E}{_EDGES} SELECT * FROM TE WHERE relationship IS NOT NULL",
    "call_edges": f"{_E}{_EDGES} SELECT * FROM CE",
    "edge_violations": f'{_E}{_EDGES} SELECT * FROM V WHERE "type" IS NOT NULL',
    "call_graph_stats": f"""{_E}{_EDGES},
QN AS (SELECT trace_id, count(*) nodes, count(*) FILTER (parent IS NULL) roots, count(DISTINCT service) services FROM NP GROUP BY 1),
QE AS (SELECT trace_id, count(*) edges, count(*) FILTER (relationship = 'concurrent') concurrent_pairs FROM CE GROUP BY 1)
SELECT trace_id, nodes, coalesce(edges, 0) edges, roots, coalesce(concurrent_pairs, 0) concurrent_pairs, services FROM QN LEFT JOIN QE USING (trace_id)""",
    "call_graph_cycles": f"""WITH RECURSIVE {CYCLIC_SPANS},
UPL AS (SELECT a.trace_id, a.span_id id, b.span_id parent FROM EC a JOIN EC b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id AND a.span_id <> b.span_id),
W AS (SELECT trace_id, id start_id, parent here, [id, parent] path FROM UPL
      UNION ALL SELECT W.trace_id, start_id, parent, list_append(path, parent) FROM W JOIN UPL ON W.trace_id = UPL.trace_id AND W.here = UPL.id WHERE here <> start_id AND NOT list_contains(path[2:-2], here)),
CY AS (SELECT trace_id, min(start_id) start_id FROM W WHERE here = start_id GROUP BY 1)
SELECT W.trace_id, W.start_id, CAST(len(path) AS INT) length, array_to_string(list_reverse(path), '>') path FROM W JOIN CY ON W.trace_id = CY.trace_id AND W.start_id = CY.start_id WHERE W.here = W.start_id""",
    "call_graph_topo_levels": f"WITH RECURSIVE {EVENT_SPANS}{_EDGES}, NC AS (SELECT * FROM CE WHERE relationship <> 'concurrent'){_LEVELS.format(key='trace_id', edges='NC', nodes='trace_id, span_id id', table='E')} SELECT trace_id, id span_id, max(level) level FROM RL GROUP BY 1, 2",
    "graph_node_match": f"{_E}{_GRAPH} SELECT trace_id, node, call, span_id FROM GM",
    "graph_causality_temporal": f"{_E}{_GRAPH} SELECT * FROM GL",
    "graph_causality_strict": f"{_E}{_GRAPH} SELECT trace_id, node, arg_min(pred, edge) first_bad FROM GP WHERE stranger GROUP BY 1, 2",
    "graph_validation": f"""{_E}{_EDGES}{_GRAPH},
B AS (SELECT GM.trace_id, pos, GM.node step, CASE WHEN span_id IS NULL THEN 'no matching span found in trace' WHEN first_bad IS NOT NULL THEN 'starts before ' || first_bad
        WHEN NOT (k < 50 AND coalesce(code, 0) = 200) THEN 'Semantic validation failed' ELSE '' END note FROM GM LEFT JOIN GL ON GM.trace_id = GL.trace_id AND GM.node = GL.node)
{_DAG_ROW} UNION ALL SELECT trace_id, pos, step, CASE WHEN note = '' THEN 'PASS' ELSE 'FAIL' END, note FROM B""",
    "condition_results": f"{_E}{_RUN} SELECT * FROM C",
    "coverage_summary": f"{_E}{_RUN} SELECT * EXCLUDE (sr, cr), round(sr * 100, 6) coverage_pct, round(sr, 6) coverage_rate, round(cr, 6) conditions_rate FROM G",
    "service_coverage": f"{_E}{_RUN} SELECT trace_id, split_part(call, '.', 1) service, count(*) steps FROM R GROUP BY 1, 2",
    "uncovered_steps": f"{_E}{_RUN} SELECT trace_id, string_agg(step, ',' ORDER BY pos) uncovered FROM R WHERE status = 'FAIL' GROUP BY 1",
    "gate_absolute": f"""{_E}{_RUN}, L AS (SELECT *, CAST(sr < 0.9 AS INT) + CAST(cr < 0.95 AS INT) v FROM G)
SELECT trace_id, round(sr, 6) steps_rate, round(cr, 6) conditions_rate, v = 0 passed, v violations, concat_ws('; ', CASE WHEN sr < 0.9 THEN printf('Steps coverage %.1f%% < required 90.0%%', sr * 100) END,
  CASE WHEN cr < 0.95 THEN printf('Conditions pass rate %.1f%% < required 95.0%%', cr * 100) END) messages FROM L""",
    "gate_relative": f"""{_E}{_RUN},
PS AS (SELECT step, CAST(split_part(trace_id, '-', 2) AS BIGINT) < 5 base, status FROM R), PC AS (SELECT step, CAST(split_part(trace_id, '-', 2) AS BIGINT) < 5 base, result FROM C),
SS AS (SELECT step, count(*) FILTER (status = 'PASS') / count(*) now_s, count(*) FILTER (base AND status = 'PASS') / nullif(count(*) FILTER (base), 0) base_s FROM PS GROUP BY 1),
SC AS (SELECT step, count(*) FILTER (result = 'PASS') / count(*) FILTER (result <> 'SKIP') now_c, count(*) FILTER (base AND result = 'PASS') / count(*) FILTER (base AND result <> 'SKIP') base_c FROM PC GROUP BY 1),
Z AS (SELECT *, now_s - base_s d_s, now_c - base_c d_c FROM SS JOIN SC USING (step))
SELECT step, round(base_s, 6) base_steps, round(now_s, 6) steps, round(d_s, 6) steps_delta, round(CASE WHEN base_s > 0 THEN d_s / base_s ELSE 0 END, 6) steps_delta_pct, round(base_c, 6) base_conditions, round(now_c, 6) conditions,
  round(d_c, 6) conditions_delta, round(CASE WHEN base_c > 0 THEN d_c / base_c ELSE 0 END, 6) conditions_delta_pct,
  CASE WHEN base_s > 0 THEN d_s / base_s ELSE 0 END >= -0.9 AND CASE WHEN base_c > 0 THEN d_c / base_c ELSE 0 END >= -0.95 passed FROM Z""",
    "baseline_steps": f"""{_E}{_RUN}, OK AS (SELECT trace_id FROM R GROUP BY 1 HAVING bool_and(status = 'PASS')), Q AS (SELECT trace_id, step, count(*) n, count(*) FILTER (result = 'PASS') p FROM C GROUP BY 1, 2)
SELECT R.trace_id, pos, R.step, coalesce(n, 0) conditions, coalesce(p, 0) conditions_passed FROM R JOIN OK USING (trace_id) LEFT JOIN Q ON R.trace_id = Q.trace_id AND R.step = Q.step""",
    "trace_verdict": f"""{_E}{_RUN}, F AS (SELECT trace_id, bool_and(found) ok FROM R GROUP BY 1)
SELECT trace_id, ok, sr >= 0.6 AND cr >= 0.5 gate_passed, CASE WHEN NOT ok THEN 3 WHEN NOT (sr >= 0.6 AND cr >= 0.5) THEN 4 ELSE 0 END verdict FROM F JOIN G USING (trace_id)""",
    "trace_duration": f"{_O} SELECT trace_id, count(*) spans, max(end_ns) - min(start_ns) duration_ns FROM O GROUP BY 1",
    "trace_timeline": f"""{_E}, T AS (SELECT *, min(start_ns) OVER w t0, max(end_ns) OVER w t1 FROM E WINDOW w AS (PARTITION BY trace_id))
SELECT trace_id, span_id, round(CAST(start_ns - t0 AS DOUBLE) * 100 / CAST(t1 - t0 AS DOUBLE), 6) left_pct, greatest(round(CAST(end_ns - start_ns AS DOUBLE) * 100 / CAST(t1 - t0 AS DOUBLE), 6), 0.5) width_pct FROM T WHERE t1 > t0""",
    "span_stats_by_service": f"{_O} SELECT coalesce(nullif(service, ''), 'unknown-service') service, count(*) spans FROM O GROUP BY 1",
    "span_stats_by_operation": f"{_O} SELECT name operation, count(*) spans FROM O GROUP BY 1",
    "discover_operations": f"{_O} SELECT service, lower(name) operation, count(*) spans FROM O WHERE service <> '' AND name <> '' GROUP BY 1, 2",
    "discover_flow_steps": f"{_O}, T AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, ordinal) pos FROM O) SELECT trace_id, CAST(pos AS INT) pos, 'Step' || pos || '-' || name step, service || '.' || lower(name) AS call, lower(service) || 'Response' AS output FROM T",
    "discover_conditions": f"""{_E}, A AS (SELECT service, start_ns, unnest([{{'n': 'req_method', 'kind': 'pre', 'path': 'http.method', 'op': 'eq', 'v': CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END}},
  {{'n': 'req_route', 'kind': 'pre', 'path': 'http.route', 'op': 'eq', 'v': '/' || service}}, {{'n': 'resp_status', 'kind': 'post', 'path': 'response.status', 'op': 'eq', 'v': CAST(status AS VARCHAR)}},
  {{'n': 'req_authorization', 'kind': 'pre', 'path': 'request.headers.authorization', 'op': 'matches', 'v': 'Bearer .+'}}, {{'n': 'req_id', 'kind': 'pre', 'path': 'request.body.id', 'op': 'ne', 'v': ''}},
  {{'n': 'resp_name', 'kind': 'post', 'path': 'request.body.name', 'op': 'ne', 'v': ''}}]) u FROM E)
SELECT service, 'evt' operation, u.kind kind, u.n AS condition, arg_max(u.path, start_ns) path, arg_max(u.op, start_ns) op, arg_max(u.v, start_ns) literal FROM A WHERE u.v IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "discover_lint_gate": f"{_O} SELECT trace_id, count(*) steps, CAST(0 AS BIGINT) errors, true passed FROM O GROUP BY 1",
    "graph_edges_from_depends": f"{_K}{_NAMED} SELECT * FROM NA",
    "graph_cycles": f"""{_K}{_NAMED},
REACH AS (SELECT flow_id, from_id, to_id FROM NI UNION SELECT REACH.flow_id, REACH.from_id, NI.to_id FROM REACH JOIN NI ON REACH.flow_id = NI.flow_id AND REACH.to_id = NI.from_id),
ON_CYCLE AS (SELECT flow_id, from_id id FROM REACH WHERE from_id = to_id), BLOCKED AS (SELECT flow_id, id FROM ON_CYCLE UNION SELECT r.flow_id, r.to_id FROM REACH r JOIN ON_CYCLE c ON r.flow_id = c.flow_id AND r.from_id = c.id),
Q AS (SELECT flow_id, count(*) n FROM BLOCKED GROUP BY 1)
SELECT f.flow_id, coalesce(n, 0) blocked, n IS NOT NULL has_cycle FROM (SELECT DISTINCT flow_id FROM N) f LEFT JOIN Q USING (flow_id)""",
    "graph_entry_nodes": f"WITH {CATALOG}{_NAMED} SELECT N.flow_id, N.node FROM N LEFT JOIN (SELECT DISTINCT flow_id, to_id FROM NI) t ON t.flow_id = N.flow_id AND t.to_id = N.node WHERE t.to_id IS NULL",
    "graph_reachability": f"""{_K}{_NAMED}, EN AS (SELECT N.flow_id, node FROM N WHERE NOT EXISTS (SELECT 1 FROM NI WHERE NI.flow_id = N.flow_id AND NI.to_id = N.node)),
REACH AS (SELECT flow_id, node FROM EN UNION SELECT NI.flow_id, NI.to_id FROM REACH JOIN NI ON REACH.flow_id = NI.flow_id AND REACH.node = NI.from_id),
Q AS (SELECT N.flow_id, count(*) nodes, count(EN.node) entries, count(*) FILTER (REACH.node IS NULL) unreachable FROM N LEFT JOIN EN ON N.flow_id = EN.flow_id AND N.node = EN.node
      LEFT JOIN REACH ON N.flow_id = REACH.flow_id AND N.node = REACH.node GROUP BY 1)
SELECT *, entries > 0 AND unreachable = 0 ok FROM Q""",
    "graph_topo_levels": f"{_K}{_NAMED}{_LEVELS.format(key='flow_id', edges='NA', nodes='flow_id, node id', table='N')} SELECT flow_id, id node, max(level) level FROM RL GROUP BY 1, 2",
    # The queue, all that is ready at a time: what has no open predecessors is emitted, and with it, as a group, its successors that have no other.
    "fold_parallel_groups": f"""WITH RECURSIVE {CATALOG}{_NAMED},
PR AS (SELECT flow_id, to_id, list(from_id) preds FROM NA GROUP BY 1, 2),
GG AS (SELECT N.flow_id, list({{'n': n, 'node': node, 'preds': coalesce(preds, CAST([] AS VARCHAR[]))}}) g FROM N LEFT JOIN PR ON PR.flow_id = N.flow_id AND PR.to_id = N.node GROUP BY 1),
QU AS (SELECT flow_id, g, -1 r, CAST([] AS VARCHAR[]) done, CAST([] AS VARCHAR[]) now_, CAST([] AS VARCHAR[]) kids FROM GG
  UNION ALL SELECT flow_id, g, r, done, now_, list_transform(list_filter(g, lambda x: len(x.preds) = 1 AND list_contains(now_, x.preds[1])
      AND len(list_filter(g, lambda y: len(y.preds) = 1 AND y.preds[1] = x.preds[1])) > 1), lambda x: x.node)
    FROM (SELECT flow_id, g, r + 1 r, list_concat(list_concat(done, now_), kids) done,
                 list_transform(list_filter(g, lambda x: NOT list_contains(list_concat(list_concat(done, now_), kids), x.node) AND list_has_all(list_concat(list_concat(done, now_), kids), x.preds)), lambda x: x.node) now_ FROM QU)
    WHERE len(now_) > 0),
EM AS (SELECT flow_id, r, unnest(now_) node, false kid FROM QU UNION ALL SELECT flow_id, r, unnest(kids), true FROM QU),
EP AS (SELECT EM.flow_id, EM.node, r, kid, N.n, CASE WHEN kid THEN preds[1] END par FROM EM JOIN N ON EM.flow_id = N.flow_id AND EM.node = N.node LEFT JOIN PR ON EM.flow_id = PR.flow_id AND EM.node = PR.to_id)
SELECT EP.flow_id, CAST(dense_rank() OVER (PARTITION BY EP.flow_id ORDER BY r, coalesce(N.n, EP.n), kid) - 1 AS INT) pos,
       CASE WHEN kid THEN CAST(row_number() OVER (PARTITION BY EP.flow_id, par ORDER BY EP.n) - 1 AS INT) END group_pos, EP.node
FROM EP LEFT JOIN N ON EP.flow_id = N.flow_id AND EP.par = N.node""",
    "flow_step_counts": f"{_K} SELECT flow_id, count(*) steps, string_agg(node, ',' ORDER BY n) AS names FROM N GROUP BY 1",
    "lint_call_format": f"{_K} SELECT flow_id, node subject FROM N WHERE n = 4",
    "lint_undeclared_service": f"{_K} {_UNDECLARED}",
    "lint_missing_operation": f"""WITH {CATALOG} SELECT flow_id, node subject, split_part(N.call, '.', 1) service, split_part(N.call, '.', 2) operation FROM N LEFT JOIN (SELECT DISTINCT call FROM N WHERE n <= 5) k ON k.call = N.call
WHERE (split_part(N.call, '.', 1) <> 'svc2' OR flow_id % 2 = 0) AND k.call IS NULL""",
    "lint_dangling_edges": f"{_K}{_NAMED} {_DANGLING}",
    "lint_duplicate_nodes": _TWICE,
    "lint_duplicate_steps": "SELECT CAST(l_orderkey AS BIGINT) flow_id, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 's' || (l_partkey % 9) END AS name, count(*) uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR name = ''",
    "variable_references": f"{_K}{_IO} SELECT * FROM RF",
    "lint_graph_variables": f"""{_K}{_NAMED}{_IO},
ANC AS (SELECT flow_id, to_id node, from_id anc FROM NA UNION SELECT ANC.flow_id, ANC.node, NA.from_id FROM ANC JOIN NA ON ANC.flow_id = NA.flow_id AND ANC.anc = NA.to_id),
HAVE AS (SELECT DISTINCT ANC.flow_id, ANC.node, variable FROM ANC JOIN OUTS ON ANC.flow_id = OUTS.flow_id AND ANC.anc = OUTS.node)
SELECT flow_id, node, variable FROM ROOT WHERE NOT EXISTS (SELECT 1 FROM HAVE h WHERE h.flow_id = ROOT.flow_id AND h.node = ROOT.node AND h.variable = ROOT.root)""",
    "lint_flow_variables": f"""{_K}{_IO}, PO AS (SELECT flow_id, node, n // 2 pos FROM N)
SELECT r.flow_id, r.node, r.variable FROM ROOT r JOIN PO p ON r.flow_id = p.flow_id AND r.node = p.node
WHERE NOT EXISTS (SELECT 1 FROM OUTS o JOIN PO q ON o.flow_id = q.flow_id AND o.node = q.node WHERE o.flow_id = r.flow_id AND o.variable = r.root AND q.pos < p.pos)""",
    "lint_telemetry_keys": """SELECT DISTINCT CAST(l_orderkey AS BIGINT) flow_id, 'n' || l_linenumber node, CASE l_partkey % 5 WHEN 0 THEN 'http.method' WHEN 1 THEN 'body.otel.id' ELSE 'Span.kind' END AS key
FROM lineitem WHERE l_partkey % 5 < 3""",
    "lint_rollup": f"""{_K}{_NAMED}, ISS AS (SELECT flow_id, 1 e, 0 w FROM ({_DANGLING}) UNION ALL SELECT flow_id, 1, 0 FROM ({_UNDECLARED}) UNION ALL SELECT flow_id, 0, 1 FROM ({_TWICE})),
Q AS (SELECT flow_id, CAST(sum(e) AS BIGINT) e, CAST(sum(w) AS BIGINT) w FROM ISS GROUP BY 1)
SELECT f.flow_id, coalesce(e, 0) errors, coalesce(w, 0) warnings, coalesce(e, 0) = 0 passed FROM (SELECT DISTINCT flow_id FROM N) f LEFT JOIN Q USING (flow_id)""",
    "url_paths": f"SELECT page_id, {_URL} path FROM pages",
    "operation_ids_pages": f"""WITH P AS (SELECT page_id, {_URL} path FROM pages),
S AS (SELECT page_id, list_filter(string_split(path, '/'), lambda s: s <> '') segs FROM P),
H AS (SELECT page_id, CASE WHEN len(segs) = 0 THEN 'Root' ELSE array_to_string(list_transform(segs, lambda seg: {_SEGMENTS}), '') END plain FROM S)
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'getV1Items' || (page_id % 7) || 'ListAllByItemIdBySub' WHEN page_id % 3 = 2 THEN regexp_replace('get' || plain, '[^a-zA-Z0-9_]', '', 'g')
  WHEN page_id % 6 = 3 THEN 'putX' || (page_id % 11) ELSE 'getAllItemsNow' END operation FROM H""",
    "service_aliases": f"""WITH R AS (SELECT p_partkey id, p_type || '-' || p_name raw FROM part UNION ALL SELECT -s_suppkey - 1, ' ' || s_name || '.Service ' FROM supplier),
W AS (SELECT id, {_KEEP.format("regexp_replace(raw, '[^a-zA-Z0-9]+', ' ', 'g')")} w FROM R) SELECT id, CASE WHEN w = '' THEN 'service' ELSE {_CAMEL.format('w')} END AS alias FROM W""",
    "operation_ids_raw": f"""WITH R AS (SELECT p_partkey, p_partkey % 5 kind, p_brand, p_size, {_KEEP.format("p_brand")} b, {_KEEP.format("regexp_replace(p_brand, '[^a-zA-Z0-9]+', ' ', 'g')")} bw,
  {_KEEP.format("regexp_replace(replace(p_type, ' ', ''), '[^a-zA-Z0-9]+', ' ', 'g')")} tw, {_KEEP.format("regexp_replace(p_name || ' op 42', '[^a-zA-Z0-9]+', ' ', 'g')")} nw FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN 'getV1PartsByPart_id' || b WHEN 1 THEN 'patchPartsBySku' || p_size WHEN 2 THEN {_CAMEL.format('bw')} WHEN 3 THEN {_CAMEL.format('tw')} ELSE {_CAMEL.format('nw')} END operation FROM R""",
    "infer_response_status": """SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 500 + p_size WHEN p_size % 3 = 1 THEN CASE WHEN p_partkey % 6 IN (1, 5) THEN 200 ELSE 201 END END AS BIGINT) response_status FROM part""",
    "content_hash": "SELECT page_id, 'sha256:' || sha256(html) hash FROM pages",
    "mask_redact": _masked("'***REDACTED***'"),
    "mask_null": _masked("CAST(NULL AS VARCHAR)"),
    "mask_keep_prefix": _masked("CASE WHEN NOT is_string OR length(value) <= 4 THEN value ELSE value[:4] || repeat('*', length(value) - 4) END"),
    "mask_hash": _masked(_ID),
    "mask_tokenize": _masked(_TOKEN),
    "mask_rule_match": f"{_A} SELECT ordinal, key, {_RULE} AS rule FROM A",
    "mask_apply": _masked(_POLICY),
    "mask_default_policy": _masked("CASE WHEN regexp_matches(key, '(?i)email') THEN " + _PREFIX2 + " WHEN regexp_matches(key, '(?i)phone') THEN '***REDACTED***' WHEN regexp_matches(key, '(?i)id$') THEN sha256(value || 'default-salt') ELSE value END"),
    "mask_stats": f"{_A} SELECT {_RULE} AS rule, CASE {_RULE} WHEN 0 THEN 'service-hash' WHEN 1 THEN 'global-keep-prefix' WHEN 2 THEN 'global-redact' ELSE 'global-tokenize' END AS \"type\", count(*) masked FROM A GROUP BY ALL",
    "mask_preview": f"{_A} SELECT ordinal, key, value AS before, {_POLICY} AS after FROM A ORDER BY ordinal, key LIMIT 20",
}
ORACLES["stored_graph_validation"] = ORACLES["graph_validation"]
ORACLES["stored_causality_validation"] = ORACLES["causality_validation"]

_H, _CALLS = f"WITH {HOT_SPANS}", [("1-URGENT", "F"), ("2-HIGH", "O"), ("3-MEDIUM", "nowhere"), ("1-URGENT", "P"), ("5-LOW", "F")]
ORACLES["large_trace_timeline"] = ORACLES["trace_timeline"].replace(_E, _H)
ORACLES["large_trace_edges"] = ORACLES["temporal_edges"].replace(_E, _H)
ORACLES["large_trace_steps"] = (
    _H + ", I AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, ordinal) idx FROM E), M0 AS (SELECT DISTINCT trace_id, CAST(NULL AS BIGINT) m, 0 since FROM E)"
    + "".join(f", M{k + 1} AS (SELECT I.trace_id, min(idx) FILTER (service = '{s}' AND name = '{o}' AND idx > coalesce(m, since)) m, any_value(coalesce(m, since)) since FROM I JOIN M{k} USING (trace_id) GROUP BY 1)" for k, (s, o) in enumerate(_CALLS))
    + ", S AS (" + " UNION ALL ".join(f"SELECT trace_id, {k} pos, 's{k}' step, m, since FROM M{k + 1}" for k in range(len(_CALLS)))
    + """) SELECT S.trace_id, pos, step, CASE WHEN m IS NULL THEN 'FAIL' ELSE 'PASS' END status, span_id, CASE WHEN m IS NULL THEN 'no matching span found in trace' WHEN m > since + 1
  THEN 'matched span #' || m || ' by time sequence (intermediate spans exist)' ELSE '' END note FROM S LEFT JOIN I ON S.trace_id = I.trace_id AND S.m = I.idx"""
)

_DEFAULT = "CASE WHEN regexp_matches(key, '(?i)email') THEN 0 WHEN regexp_matches(key, '(?i)phone|(?i)mobile|(?i)tel') THEN 1 WHEN regexp_matches(key, '(?i)id$') THEN 2 ELSE -1 END"
_MASKS = f"CASE {_DEFAULT} WHEN 0 THEN {_PREFIX2} WHEN 1 THEN '***REDACTED***' WHEN 2 THEN sha256(value || 'default-salt') ELSE value END"
ORACLES["mask_apply_rules"] = f"{_A} SELECT ordinal, key, CASE WHEN ordinal % 2 = 0 THEN {_RULE} ELSE {_DEFAULT} END AS rule, CASE WHEN ordinal % 2 = 0 THEN {_POLICY} ELSE {_MASKS} END AS masked FROM A"

# What is written as files and read again.
_MEANT = "coalesce(nullif(CASE WHEN k % 4 = 0 THEN 'own-' || service WHEN part < 4 THEN 'shop' ELSE '' END, ''), 'unknown-service')"
_TRACES = f"{_E}, TP AS (SELECT trace_id, min(ordinal) % 6 part FROM E GROUP BY 1), EO AS (SELECT E.*, part, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, ordinal) - 1 AS BIGINT) place FROM E JOIN TP USING (trace_id))"
ORACLES |= {
    "span_files_read": f"""{_E} SELECT CAST(ordinal % 8 AS INT) part, CAST(row_number() OVER (PARTITION BY ordinal % 8 ORDER BY start_ns, ordinal) - 1 AS BIGINT) ordinal,
  CASE WHEN k % 3 = 0 THEN span_id ELSE service || ':' || name || ':' || start_ns END span_id, CASE WHEN k % 3 <> 1 THEN parent_span_id END parent_span_id, name, service, start_ns, CASE WHEN k < 90 THEN end_ns ELSE 0 END end_ns, CAST(k AS VARCHAR) k FROM E""",
    "otlp_spans_read": f"""{_TRACES} SELECT trace_id, place ordinal, span_id, parent_span_id, CASE WHEN k % 2 = 0 THEN 'create ' ELSE 'get ' END || service AS name, {_MEANT} service, start_ns, end_ns,
  CAST(k / 4 AS VARCHAR) n, CASE WHEN k % 2 = 0 THEN 'true' ELSE '' END flag, '' AS empty, CASE WHEN k % 5 = 0 THEN '4xx' WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN '201' ELSE '200' END END status, span_id own_id
  FROM EO WHERE part <> 5 AND k % 25 <> 3 AND k <> 7""",
    "otlp_spans_rejected": f"""{_TRACES} SELECT reason, place, count(*) rejects FROM (SELECT 'no OTLP JSON' reason, CAST(NULL AS INT) place FROM TP WHERE part = 5
  UNION ALL SELECT CASE WHEN k % 25 = 3 THEN 'start_ns: soon' ELSE 'end_ns: none' END, CAST(place AS INT) FROM EO WHERE part <> 5 AND (k % 25 = 3 OR k = 7)) GROUP BY 1, 2""",
    "otlp_file_checks": f"""{_TRACES} SELECT CAST(part AS INT) part, CASE WHEN part = 2 THEN 0 ELSE 1 END resource_spans, CAST(CASE WHEN part = 2 THEN 0 ELSE count(*) END AS INT) total_spans, part <> 2 ok, CASE WHEN part = 2 THEN 'no resourceSpans' ELSE '' END reason
  FROM EO WHERE (part, trace_id) IN (SELECT (part, min(trace_id)) FROM TP GROUP BY part) GROUP BY part""",
    "contract_files_read": """SELECT CAST(s_nationkey AS INT) part, CAST(row_number() OVER w - 1 AS INT) n, 'n' || s_suppkey node, 'shop.op' || (s_suppkey % 5) AS call, 'n' || lag(s_suppkey) OVER w from_id FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""",
    "sanitized_names": """SELECT p_partkey, regexp_replace(raw, '[^a-zA-Z0-9_-]', '_', 'g') AS file, regexp_replace(lower(raw), '[^a-zA-Z0-9_]', '_', 'g') identifier, lower(o[1]) || o[2:] operation
  FROM (SELECT p_partkey, raw, regexp_replace(raw, '[^a-zA-Z0-9]', '', 'g') o FROM (SELECT p_partkey, p_type || ' / ' || p_name || ' / ' || p_brand raw FROM part))""",
    "masked_spans_read": f"""{_E} SELECT span_id, service, CASE WHEN service = 'signup' THEN sha256('u' || span_id || 's') ELSE 'u' || repeat('x', length(span_id)) END who, '***REDACTED***' k, CAST(k AS VARCHAR) n FROM E""",
    "baseline_files_read": ORACLES["baseline_record"],
    "trace_verdict_linted": f"""{_E}{_RUN}, {CATALOG.strip()}{_NAMED}, F AS (SELECT trace_id, bool_and(found) ok FROM R GROUP BY 1), DE AS (SELECT DISTINCT flow_id FROM ({_DANGLING}))
SELECT trace_id, ok, sr >= 0.6 AND cr >= 0.5 gate_passed, CASE WHEN DE.flow_id IS NOT NULL THEN 2 WHEN NOT ok THEN 3 WHEN NOT (sr >= 0.6 AND cr >= 0.5) THEN 4 ELSE 0 END verdict
FROM F JOIN G USING (trace_id) LEFT JOIN DE ON DE.flow_id = CAST(split_part(trace_id, '-', 1) AS BIGINT)""",
    "json_report_read": f"""{_E}{_RUN} SELECT R.trace_id, steps_pass, sr >= 0.9 AND cr >= 0.95 passed, R.step, R.status, CAST(CASE WHEN found THEN 4 ELSE 0 END AS INT) conditions FROM R JOIN G ON R.trace_id = G.trace_id""",
    "junit_report_read": f"""{_E}{_RUN} SELECT R.trace_id, steps_total tests, steps_fail failures, step, R.status = 'FAIL' failed, CASE WHEN R.status = 'FAIL' THEN call END AS call FROM R JOIN CS ON R.trace_id = CS.trace_id""",
}
ORACLES["stream_matching"] = ORACLES["time_sequence_steps"]
