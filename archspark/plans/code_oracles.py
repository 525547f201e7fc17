"""DuckDB SQL for the queries of ``code_corpus``: facts stated from the part columns."""

from __future__ import annotations

# size counts the bytes of the rendered source, fact by fact; everything else comes straight from the columns
CORPUS = """
p AS (SELECT p_brand AS repo_id, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS ks, string_split(p_name, ' ') AS ws, p_name, lower(p_type) AS ty,
             CAST(p_size AS BIGINT) AS z, p_partkey % 10 AS kind FROM part),
q AS (SELECT *, CASE kind WHEN 0 THEN 'tests/test_' || ws[1] || '_' || ks || '.py' WHEN 1 THEN 'README_' || ks || '.md'
                     WHEN 2 THEN 'k' || ks || '/main.py' WHEN 3 THEN 'k' || ks || '/store.sqlite'
                     WHEN 4 THEN 'node_modules/k' || ks || '/lib.py' WHEN 5 THEN 'win/k' || ks || '/mod_' || ks || '.py'
                     WHEN 6 THEN 'web/k' || ks || '.js' ELSE ty || '/' || replace(p_name, ' ', '_') || '_' || ks || '.py' END AS path FROM p),
f AS (
  SELECT repo_id, path, k, ws, z, ends_with(path, '.py') AS py, k % 11 <> 0 AS ok, ty,
    CASE WHEN ends_with(path, '.py') THEN
      length(array_to_string(ws, '')) + 8 * length(ws) + 7 + length(ks) + CASE z % 3 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 14 END + 19
      + CASE WHEN z % 2 = 0 THEN 18 ELSE 0 END + 31 * (z % 4) + 20 * (k % 3)
      + CASE WHEN z % 2 = 1 THEN 37 + length(ty) ELSE 0 END + CASE WHEN k % 4 = 0 THEN 59 ELSE 0 END
      + CASE WHEN k % 11 = 0 THEN 13 ELSE 0 END + 2 + 14 * z * z
    ELSE 6 + length(ks) END AS size,
    length(ws) AS imports, z % 4 AS methods, k % 3 AS functions, z % 2 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS endpoints,
    CASE WHEN z % 3 <> 1 OR z % 2 = 0 THEN 1 ELSE 0 END AS models
  FROM q
  UNION ALL
  SELECT DISTINCT p_brand, w || '.py', NULL, [], 0, true, true, '', 0, 0, 0, 0, 0, 0 FROM (
    SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)),
inv AS (SELECT *, regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) AS extension FROM f WHERE NOT starts_with(path, 'node_modules/')),
imp AS (SELECT DISTINCT repo_id, path AS src, unnest(ws) || '.py' AS dst FROM inv WHERE py AND ok AND k IS NOT NULL),
ff AS (
  SELECT i.repo_id, i.path, i.extension, CAST(i.size AS BIGINT) AS size,
    CAST(CASE WHEN py AND ok THEN functions + methods ELSE 0 END AS BIGINT) AS function_count,
    CAST(CASE WHEN py AND ok AND k IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS class_count,
    CAST(CASE WHEN py AND ok THEN endpoints ELSE 0 END AS BIGINT) AS route_count,
    CAST((SELECT count(*) FROM imp e WHERE e.repo_id = i.repo_id AND e.src = i.path) AS BIGINT) AS import_count,
    CAST((SELECT count(*) FROM imp e WHERE e.repo_id = i.repo_id AND e.dst = i.path) AS BIGINT) AS imported_by_count
  FROM inv i),
cov0 AS (
  SELECT repo_id, count(*) AS n_files, count(*) FILTER (extension = '.py') AS py_files, count(*) FILTER (extension = '.py' AND ok) AS parsed,
         count(*) FILTER (k IS NOT NULL AND z > 20) AS tracked, sum(CASE WHEN py AND ok THEN endpoints ELSE 0 END) AS n_routes
  FROM inv GROUP BY repo_id),
cov1 AS (
  SELECT repo_id, n_files, CAST((200 * parsed + py_files) // (2 * py_files) AS BIGINT) AS ast_pct, CAST(100 AS BIGINT) AS dep_pct,
         CAST(CASE WHEN tracked > 0 THEN (200 * tracked + n_files) // (2 * n_files) END AS BIGINT) AS git_pct,
         CAST(CASE WHEN n_routes > 0 THEN 100 END AS BIGINT) AS route_pct FROM cov0),
cov AS (
  SELECT *, CAST((2 * s + c) // (2 * c) AS BIGINT) AS overall_pct,
         CAST((45 * ast_pct + 35 * dep_pct + 20 * coalesce(git_pct, 0) + 50) // 100 AS BIGINT) AS confidence_pct
  FROM (SELECT *, ast_pct + dep_pct + coalesce(git_pct, 0) + coalesce(route_pct, 0) AS s,
               2 + (git_pct IS NOT NULL)::INT + (route_pct IS NOT NULL)::INT AS c FROM cov1)),
st AS (SELECT repo_id, path, extension, size, CASE WHEN length(extension) > 0
         THEN regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) ELSE string_split(path, '/')[-1] END AS stem FROM inv),
tests AS (SELECT repo_id, path FROM inv WHERE contains(lower(path), 'test'))"""

_PARTS = """
SELECT repo_id, path, string_split(path, '/')[-1] AS basename, regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) AS extension,
  regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) AS stem,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] END AS first_segment,
  py OR ends_with(path, '.js') AS is_code, ends_with(path, '.sqlite') AS is_database, ends_with(path, '/main.py') AS is_entry_point,
  contains(lower(path), 'test') AS is_test, starts_with(path, 'node_modules/') AS is_ignored FROM f"""

ORACLES = {name: f"WITH {CORPUS}\n{sql}" for name, sql in {
    "corpus_code_facts": """
SELECT repo_id, path, ok AS parsed, CAST(CASE WHEN ok THEN imports ELSE 0 END AS BIGINT) AS n_imports,
  CAST(CASE WHEN ok AND k IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_classes, CAST(CASE WHEN ok THEN functions ELSE 0 END AS BIGINT) AS n_functions,
  CAST(CASE WHEN ok THEN endpoints ELSE 0 END AS BIGINT) AS n_endpoints, CAST(CASE WHEN ok THEN models ELSE 0 END AS BIGINT) AS n_models,
  CASE WHEN NOT ok OR models = 0 THEN '' WHEN z % 2 = 0 THEN 'tag,f' ELSE 'tag' END AS fields0
FROM inv WHERE py""",
    # lines: imports, class, tag, a field if the size is even, two for each method and function, three for each endpoint
    "corpus_fact_rows": """, src AS (SELECT *, len(ws) AS n, len(ws) + 2 + CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END + 2 * (z % 4) AS b FROM inv WHERE py AND ok AND k IS NOT NULL),
spot AS (SELECT *, b + 2 * (k % 3) AS h, b + 2 * (k % 3) + 3 * (z % 2) AS g FROM src)
SELECT repo_id, path, 'import' AS kind, ws[i] AS name, CAST(i AS BIGINT) AS line, ws[i] AS items FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM spot)
UNION ALL SELECT repo_id, path, 'class', 'C' || k, n + 1, CASE z % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'object' ELSE 'Model' END FROM spot
UNION ALL SELECT repo_id, path, 'model', 'C' || k, n + 1, CASE WHEN z % 2 = 0 THEN 'tag,f' ELSE 'tag' END FROM spot WHERE z % 3 <> 1 OR z % 2 = 0
UNION ALL SELECT repo_id, path, 'function', 'f' || j, b + 1 + 2 * j, 'x' FROM (SELECT *, unnest(range(k % 3)) AS j FROM spot)
UNION ALL SELECT repo_id, path, 'endpoint', 'h', h + 2, '/' || ty || ',POST' FROM spot WHERE z % 2 = 1
UNION ALL SELECT repo_id, path, 'endpoint', 'g', g + 2, '/r,GET,PUT' FROM spot WHERE k % 4 = 0""",
    "corpus_path_parts": _PARTS,
    "corpus_imports": "SELECT repo_id, src, dst FROM imp WHERE src <> dst",
    "corpus_routes": """
SELECT repo_id, path, '/' || ty AS route, 'POST' AS method, path || ':h' AS handler FROM inv WHERE py AND ok AND z % 2 = 1
UNION ALL SELECT repo_id, path, '/r', 'GET,PUT', path || ':g' FROM inv WHERE py AND ok AND k % 4 = 0""",
    "corpus_file_facts": "SELECT * FROM ff",
    "corpus_coverage": "SELECT repo_id, n_files, ast_pct, dep_pct, coalesce(git_pct, -1) AS git_pct, coalesce(route_pct, -1) AS route_pct, overall_pct, confidence_pct FROM cov",
    "corpus_evidence": """
SELECT repo_id, 'ast' AS evidence_type, 'available' AS status, ast_pct AS coverage_pct, confidence_pct FROM cov
UNION ALL SELECT repo_id, 'dependency', 'available', dep_pct, confidence_pct FROM cov
UNION ALL SELECT repo_id, 'git', CASE WHEN git_pct IS NULL THEN 'unavailable' ELSE 'available' END, coalesce(git_pct, -1), confidence_pct FROM cov
UNION ALL SELECT repo_id, 'route', CASE WHEN route_pct IS NULL THEN 'unavailable' ELSE 'available' END, coalesce(route_pct, -1), confidence_pct FROM cov""",
    "corpus_health": """
SELECT repo_id, count(*) AS n_files,
  CAST(least(greatest((300000 - least(600 * sum(function_count + 2 * class_count), 60000) - least(1000 * sum(import_count), 45000)
    - least(sum(CASE WHEN size > 15360 THEN least(3 * (size - 15360), 45000) ELSE 0 END), 45000)) // 3000, 10), 100) AS BIGINT) AS maintainability,
  CAST(CASE WHEN bool_or(ends_with(path, '.sqlite')) THEN 100 ELSE 95 END AS BIGINT) AS structural_integrity,
  CAST(CASE WHEN least((400 * count(*) FILTER (contains(lower(path), 'test'))) // count(*), 100) < 10 THEN 15
       ELSE least((400 * count(*) FILTER (contains(lower(path), 'test'))) // count(*), 100) END AS BIGINT) AS test_density,
  CAST(CASE WHEN bool_or(starts_with(path, 'README')) THEN 85 ELSE 40 END AS BIGINT) AS documentation
FROM ff GROUP BY repo_id""",
    "corpus_oversized": """
SELECT repo_id, CAST(1 AS BIGINT) AS detector, 'Oversized Module / God Object' AS title, path AS file, 'High' AS severity,
  CAST(0.95 AS DOUBLE) AS confidence, 'complexity' AS evidence_type FROM ff WHERE extension = '.py' AND (size > 30720 OR function_count > 20)""",
    "corpus_missing_tests": """
SELECT repo_id, file, size, rank FROM (
  SELECT repo_id, path AS file, size, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS rank FROM st s
  WHERE extension = '.py' AND NOT contains(lower(path), 'test') AND NOT contains(lower(path), 'setup') AND size > 1000
    AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.repo_id = s.repo_id AND contains(lower(t.path), s.stem))) WHERE rank <= 4""",
    "corpus_impact_lists": """
SELECT repo_id, src AS path, 'direct' AS relation, dst AS other, CAST(0 AS BIGINT) AS pct FROM imp WHERE src <> dst
UNION ALL SELECT repo_id, dst, 'reverse', src, 0 FROM imp WHERE src <> dst""",
    "corpus_risk_evidence": """
SELECT repo_id, CAST(1 AS BIGINT) AS detector, path AS file, 'size' AS measure, size AS value FROM ff WHERE extension = '.py' AND (size > 30720 OR function_count > 20)
UNION ALL SELECT repo_id, 1, path, 'functions', function_count FROM ff WHERE extension = '.py' AND (size > 30720 OR function_count > 20)
UNION ALL SELECT repo_id, 6, file, 'size', size FROM (
  SELECT repo_id, path AS file, CAST(size AS BIGINT) AS size, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) AS rank FROM st s
  WHERE extension = '.py' AND NOT contains(lower(path), 'test') AND NOT contains(lower(path), 'setup') AND size > 1000
    AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.repo_id = s.repo_id AND contains(lower(t.path), s.stem))) WHERE rank <= 4""",
    "corpus_affected_tests": """
SELECT DISTINCT s.repo_id, s.path AS file, t.path AS test FROM st s JOIN tests t ON t.repo_id = s.repo_id AND contains(lower(t.path), s.stem)""",
}.items()}
