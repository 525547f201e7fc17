"""DuckDB SQL for the queries of ``service_corpus``: facts, risks and answers stated from the customer and order columns."""

from __future__ import annotations

# every file with what its customer's number says; size counts the bytes of the same text
SERVICES = """
c AS (SELECT c_custkey AS k, c_custkey // 40 AS g, c_custkey % 40 AS p, c_custkey % 4 AS m, (c_custkey // 4) % 8 AS r,
             'svc' || (c_custkey // 40) AS repo_id, (SELECT max(c_custkey) FROM customer) AS n FROM customer),
own AS (SELECT *, CASE m WHEN 0 THEN 'views_' || k || '.py' WHEN 1 THEN 'logic_' || k || '.py' WHEN 2 THEN 'db_store_' || k || '.py'
                  ELSE 'run_' || k || '/main.py' END AS path,
  CASE m WHEN 0 THEN 'import db_store_' || (k + 2) || chr(10) || CASE WHEN k % 3 = 0 THEN 'import db_store_' || (k + 6) || chr(10) ELSE '' END
      || 'import logic_' || (k + 1) || chr(10) || 'class V' || k || ':' || chr(10) || '    def ' || CASE WHEN k % 5 = 0 THEN 'execute_' ELSE 'show_' END || k
      || '(self):' || chr(10) || '        pass' || chr(10)
      || array_to_string(list_transform(range(r), lambda j: '@app.get(''/v' || k || '/' || j || ''')' || chr(10) || 'def h' || j || '(x):' || chr(10) || '    pass' || chr(10)), '')
    WHEN 1 THEN CASE WHEN p < 36 THEN 'import logic_' || (k + 4) || chr(10) WHEN g % 2 = 0 THEN 'import logic_' || (k - 36) || chr(10) ELSE '' END
      || 'def run_' || k || '(x):' || chr(10) || '    pass' || chr(10)
    WHEN 2 THEN 'class S' || k || ':' || chr(10) || '    x = Column(1)' || chr(10)
    ELSE 'import views_' || (k - 3) || chr(10) || 'import logic_' || (k - 2) || chr(10) || 'if True:' || chr(10) || '    pass' || chr(10) END AS body FROM c),
inv AS (
  SELECT repo_id, k, m, r, path, '.py' AS extension, strlen(body) + CASE WHEN m = 3 THEN 0 ELSE 2 + (k % 7) * 7000 END AS size FROM own
  UNION ALL SELECT repo_id, k, 9, 0, 'tests/test_logic_' || k || '.py', '.py', strlen('import logic_' || k) + 1 FROM c WHERE k % 16 = 5
  UNION ALL SELECT repo_id, k, 10, 0, 'data/s_' || k || '.sqlite', '.sqlite', 1 FROM c WHERE k % 16 = 6),
cand AS (
  SELECT repo_id, path AS src, 'db_store_' || (k + 2) || '.py' AS dst FROM inv WHERE m = 0
  UNION ALL SELECT repo_id, path, 'db_store_' || (k + 6) || '.py' FROM inv WHERE m = 0 AND k % 3 = 0
  UNION ALL SELECT repo_id, path, 'logic_' || (k + 1) || '.py' FROM inv WHERE m = 0
  UNION ALL SELECT repo_id, path, 'logic_' || CASE WHEN p < 36 THEN k + 4 ELSE k - 36 END || '.py' FROM own WHERE m = 1 AND (p < 36 OR g % 2 = 0)
  UNION ALL SELECT repo_id, path, 'views_' || (k - 3) || '.py' FROM inv WHERE m = 3
  UNION ALL SELECT repo_id, path, 'logic_' || (k - 2) || '.py' FROM inv WHERE m = 3
  UNION ALL SELECT repo_id, path, 'logic_' || k || '.py' FROM inv WHERE m = 9),
e AS (SELECT DISTINCT x.repo_id, x.src, x.dst FROM cand x JOIN inv i ON i.repo_id = x.repo_id AND i.path = x.dst),
lay AS (SELECT *, CASE m WHEN 0 THEN 'API Layer' WHEN 1 THEN 'Logic Layer' WHEN 2 THEN 'Data Layer' ELSE 'Runtime Layer' END AS layer FROM inv),
routes AS (SELECT repo_id, path, '/v' || k || '/' || j AS route, 'GET' AS method, path || ':h' || j AS handler FROM (
  SELECT *, unnest(range(r)) AS j FROM inv WHERE m = 0))"""

# chains follow from the numbers: a ring weighs its ten modules, a chain one for each module after it
RISKS = """,
ring AS (SELECT repo_id, g FROM c WHERE m = 1 AND g % 2 = 0 AND p = 37),
logic AS (SELECT o.repo_id, o.path, CASE WHEN q.g IS NOT NULL THEN 10 ELSE 1 + (least(39, o.n - 40 * o.g) - 1) // 4 - (o.p - 1) // 4 END AS depth
  FROM own o LEFT JOIN ring q ON q.repo_id = o.repo_id WHERE o.m = 1),
d1 AS (SELECT * FROM logic UNION ALL SELECT repo_id, path, 1 FROM inv WHERE m = 2),
d2 AS (SELECT * FROM d1 UNION ALL SELECT e.repo_id, e.src, 1 + max(d.depth) FROM e JOIN d1 d ON d.repo_id = e.repo_id AND d.path = e.dst
  WHERE starts_with(e.src, 'views_') OR starts_with(e.src, 'tests/') GROUP BY ALL),
d3 AS (SELECT * FROM d2 UNION ALL SELECT e.repo_id, e.src, 1 + max(coalesce(d.depth, 1)) FROM e LEFT JOIN d2 d ON d.repo_id = e.repo_id AND d.path = e.dst
  WHERE starts_with(e.src, 'run_') GROUP BY ALL),
untested AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS rank FROM inv i
  WHERE extension = '.py' AND m <> 9 AND size > 1000 AND NOT EXISTS (SELECT 1 FROM inv t WHERE t.repo_id = i.repo_id AND t.m = 9
    AND contains(t.path, replace(string_split(i.path, '/')[-1], '.py', '')))),
risks AS (
  SELECT repo_id, 1::BIGINT AS detector, 'Oversized Module / God Object' AS title, path AS file, 'High' AS severity, 0.95::DOUBLE AS confidence,
    'complexity' AS evidence_type FROM inv WHERE extension = '.py' AND size > 30720
  UNION ALL SELECT o.repo_id, 2, 'Circular Dependency Loop', min(o.path), 'High', 0.99, 'dependency' FROM own o JOIN ring q ON q.repo_id = o.repo_id WHERE o.m = 1 GROUP BY o.repo_id
  UNION ALL SELECT repo_id, 3, 'Deep Dependency Chain', path, 'Medium', 0.90, 'dependency' FROM d3 WHERE depth > 4
  UNION ALL SELECT repo_id, 4, 'Route Concentration Bottleneck', path, 'High', 0.95, 'route' FROM inv WHERE r > 5 AND m = 0
  UNION ALL SELECT repo_id, 5, 'Direct Database Access in Views', path, 'High', 0.88, 'database' FROM inv i WHERE m = 0 AND r > 0
    AND (k % 5 = 0 OR (SELECT count(*) FROM e WHERE e.repo_id = i.repo_id AND e.src = i.path AND contains(e.dst, 'db')) > 1)
  UNION ALL SELECT repo_id, 6, 'Missing Unit Test Coverage', path, 'Medium', 0.90, 'test' FROM untested WHERE rank <= 4)"""

CONNECTED = """,
entries AS (SELECT repo_id, path AS entry, layer FROM lay WHERE m = 3),
conn AS (SELECT repo_id, layer, entry FROM entries
  UNION SELECT e.repo_id, l.layer, e.src FROM e JOIN entries n ON n.repo_id = e.repo_id AND n.entry = e.src JOIN lay l ON l.repo_id = e.repo_id AND l.path = e.dst)"""

COCHANGE = """,
cf AS (SELECT DISTINCT o.repo_id, o.path, strftime(r.o_orderdate, '%Y-%m') AS commit_id FROM orders r JOIN own o ON o.k = r.o_custkey),
tot AS (SELECT repo_id, path, count(*) AS t FROM cf GROUP BY ALL),
joint AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS j FROM cf x JOIN cf y ON x.repo_id = y.repo_id AND x.commit_id = y.commit_id AND x.path <> y.path GROUP BY ALL),
cc AS (SELECT j.repo_id, j.a AS path, count(*) AS n FROM joint j JOIN tot t ON t.repo_id = j.repo_id AND t.path = j.a
  WHERE t.t >= 2 AND (200 * j.j + t.t) // (2 * t.t) > 10 GROUP BY ALL)"""

AFFECTED = """,
aff AS (
  SELECT repo_id, path AS target, path AS file FROM inv WHERE m = 0
  UNION SELECT e.repo_id, e.src, e.dst FROM e WHERE starts_with(e.src, 'views_')
  UNION SELECT e.repo_id, e.dst, e.src FROM e WHERE starts_with(e.dst, 'views_'))"""

_PLANS = [  # condition on the wording's number, complexity, steps, checks; %t the file, %o the others
    (0, "Medium", ["Review authentication structure inside `%t`.", "Verify token signatures and signature keys in config files.",
                   "Update dependent controllers: %o to intercept request credentials."],
     ["Assert password hashes are salted and not exposed in `%t`.", "Verify JWT middleware intercepts unauthorized requests."]),
    (1, "High", ["Identify connection settings and queries in `%t`.", "Re-point connection contexts to new Cosmos/NoSQL document collections.",
                 "Update schemas and ORM mapping imports in %o."],
     ["Verify database connection pool initializes successfully from `%t`.", "Bench-test partitioned document query latency."]),
    (2, "Medium", ["De-reference cache dependencies in `%t`.", "Implement safe thread-locked fallback storage dictionary."],
     ["Verify application starts with zero active Redis servers required.", "Assert thread-locked cache eviction runs successfully."]),
    (3, "Low", ["Identify logical targets in `%t`.", "Verify static import trees before applying structural changes."],
     ["Verify script builds cleanly on dev environment."]),
]
_PLANS.append((4, *_PLANS[1][1:]))


def _plan_rows() -> str:
    out = []
    for number, level, *parts in _PLANS:
        for part, texts in zip(("step", "check"), parts):
            for i, text in enumerate(texts):
                where = f"w = {number}" + (" AND others IS NOT NULL" if "%o" in text else "")
                out.append(f"SELECT goal_id, repo_id, '{level}' AS complexity, '{part}' AS part, {i}::BIGINT AS ord, "
                           f"replace(replace('{text}', '%t', target), '%o', coalesce(others, '')) AS text FROM goals WHERE {where}")
    return "\nUNION ALL ".join(out)


ORACLES = {name: f"WITH {SERVICES}{more}\n{sql}" for name, (more, sql) in {
    "service_risks": (RISKS, "SELECT * FROM risks"),
    "service_ownership": (CONNECTED, """
SELECT l.repo_id, l.path, l.layer, (count(*) OVER (PARTITION BY l.repo_id, l.layer) - 1)::BIGINT AS related_files,
  (SELECT count(*) FROM conn q WHERE q.repo_id = l.repo_id AND q.layer = l.layer)::BIGINT AS entry_points,
  CASE WHEN l.layer = 'API Layer' THEN (SELECT count(*) FROM routes q WHERE q.repo_id = l.repo_id) ELSE 0 END::BIGINT AS routes FROM lay l"""),
    "service_entry_points": (CONNECTED, "SELECT repo_id, layer, entry FROM conn"),
    "service_layer_routes": ("", "SELECT repo_id, 'API Layer' AS layer, route, method, handler FROM routes"),
    "service_change_risk": (RISKS + COCHANGE, """
SELECT repo_id, path, layer, direct_count, reverse_count, cochange_count, n_risks, least(greatest(
    (1024 * (4 * direct_count + 6 * reverse_count + 2 * fn + 20 * n_risks) + size) // 1024, 10), 100)::BIGINT AS risk_score FROM (
  SELECT l.repo_id, l.path, l.layer, l.size, CASE WHEN m IN (0, 1) THEN 1 ELSE 0 END AS fn,
    (SELECT count(*) FROM e WHERE e.repo_id = l.repo_id AND e.src = l.path)::BIGINT AS direct_count,
    (SELECT count(*) FROM e WHERE e.repo_id = l.repo_id AND e.dst = l.path)::BIGINT AS reverse_count,
    coalesce(cc.n, 0)::BIGINT AS cochange_count,
    (SELECT count(*) FROM risks q WHERE q.repo_id = l.repo_id AND q.file = l.path)::BIGINT AS n_risks
  FROM lay l LEFT JOIN cc ON cc.repo_id = l.repo_id AND cc.path = l.path)"""),
    "service_brief": (RISKS, """
SELECT repo_id, 'project type' AS section, CASE WHEN ends_with(repo_id, '1') THEN 'FastAPI' ELSE 'Python' END AS item, NULL::VARCHAR AS value FROM (SELECT DISTINCT repo_id FROM inv)
UNION ALL SELECT repo_id, 'entry point', path, NULL FROM inv WHERE m = 3
UNION ALL SELECT repo_id, 'subsystem', layer, CAST(count(*) AS VARCHAR) FROM lay GROUP BY repo_id, layer
UNION ALL SELECT repo_id, 'database', path, NULL FROM inv WHERE m = 10
UNION ALL SELECT repo_id, 'risk', title, file FROM risks
UNION ALL SELECT repo_id, 'confidence', '80', NULL FROM (SELECT DISTINCT repo_id FROM inv)
UNION ALL SELECT repo_id, 'evidence', unnest(['ast available', 'dependency available']), '100' FROM (SELECT DISTINCT repo_id FROM inv)
UNION ALL SELECT repo_id, 'evidence', 'git unavailable', NULL FROM (SELECT DISTINCT repo_id FROM inv)
UNION ALL SELECT repo_id, 'evidence', CASE WHEN sum(r) > 0 THEN 'route available' ELSE 'route unavailable' END, CASE WHEN sum(r) > 0 THEN '100' END
  FROM (SELECT repo_id, CASE WHEN m = 0 THEN r ELSE 0 END AS r FROM inv) GROUP BY repo_id"""),
    "service_affected": (RISKS + AFFECTED, """
SELECT a.repo_id, target, a.file, 'risk' AS kind, title AS item, severity AS detail FROM aff a JOIN risks q ON q.repo_id = a.repo_id AND q.file = a.file
UNION ALL SELECT a.repo_id, target, a.file, 'route', route, method FROM aff a JOIN routes q ON q.repo_id = a.repo_id AND q.path = a.file"""),
    "service_plans": (AFFECTED + """,
goals AS (SELECT 'goal ' || k AS goal_id, i.repo_id, path AS target, (k // 4) % 5 AS w,
  (SELECT array_to_string(list_sort(list(a.file))[1:2], ', ') FROM aff a WHERE a.repo_id = i.repo_id AND a.target = i.path AND a.file <> a.target) AS others
  FROM inv i WHERE m = 0)""", _plan_rows()),
}.items()}
