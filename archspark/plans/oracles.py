"""DuckDB oracle SQL for each registered query (same bindings, same column names).

Shared fragments are plain CTE strings; integers are used for every ratio so the
two engines cannot disagree on rounding.
"""

from __future__ import annotations

from archspark.plans.code_oracles import ORACLES as _CODE_ORACLES
from archspark.plans.service_oracles import ORACLES as _SERVICE_ORACLES
from archspark.plans.service_oracles import SERVICES as _SERVICES

ORACLES: dict[str, str] = _CODE_ORACLES | _SERVICE_ORACLES

COMMITS = """commits AS (
  SELECT o_orderpriority AS repo_id, o_orderkey AS commit_id, o_orderdate AS commit_ts,
         o_custkey AS author FROM orders)"""

PART_CF = COMMITS + """,
cf AS (
  SELECT c.repo_id, c.commit_id, c.commit_ts, c.author, l.l_partkey AS path
  FROM lineitem l JOIN commits c ON l.l_orderkey = c.commit_id)"""

SUPP_CF = COMMITS + """,
cf AS (
  SELECT c.repo_id, c.commit_id, c.commit_ts, c.author, l.l_suppkey AS path
  FROM lineitem l JOIN commits c ON l.l_orderkey = c.commit_id)"""

RATIOS = """
fs AS (SELECT DISTINCT repo_id, commit_id, path FROM cf),
freq AS (SELECT repo_id, path, count(*) AS total FROM fs GROUP BY repo_id, path),
j AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS joint
      FROM fs x JOIN fs y ON x.repo_id = y.repo_id AND x.commit_id = y.commit_id AND x.path < y.path
      GROUP BY x.repo_id, x.path, y.path),
sym AS (SELECT repo_id, a, b, joint FROM j UNION ALL SELECT repo_id, b, a, joint FROM j),
ratios AS (
  SELECT s.repo_id, s.a, s.b, s.joint, f.total AS total_a,
         (200 * s.joint + f.total) // (2 * f.total) AS pct
  FROM sym s JOIN freq f ON s.repo_id = f.repo_id AND s.a = f.path)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


oracle("commit_frequency", f"""
WITH {PART_CF}
SELECT repo_id, path, count(DISTINCT commit_id) AS commits FROM cf GROUP BY repo_id, path
""")

oracle("author_count", f"""
WITH {PART_CF}
SELECT repo_id, path, count(DISTINCT author) AS authors FROM cf GROUP BY repo_id, path
""")

oracle("file_history", f"""
WITH {SUPP_CF}
SELECT repo_id, path, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors,
       CASE WHEN count(DISTINCT commit_id) > 20 THEN 'High'
            WHEN count(DISTINCT commit_id) > 5 THEN 'Medium' ELSE 'Low' END AS density
FROM cf GROUP BY repo_id, path
""")

oracle("latest_commits", f"""
WITH {COMMITS}
SELECT repo_id, commit_id, commit_ts, rank FROM (
  SELECT repo_id, commit_id, commit_ts,
         row_number() OVER (PARTITION BY repo_id ORDER BY commit_ts DESC, commit_id DESC) AS rank
  FROM commits) WHERE rank <= 150
""")

oracle("cochange_raw", f"""
WITH {SUPP_CF},{RATIOS}
SELECT * FROM ratios
""")

oracle("temporal_matrix", f"""
WITH {PART_CF},{RATIOS}
SELECT * FROM ratios WHERE total_a >= 2 AND pct > 10
""")

oracle("windowed_temporal_matrix", f"""
WITH {COMMITS},
win AS (SELECT repo_id, commit_id FROM (
  SELECT repo_id, commit_id,
         row_number() OVER (PARTITION BY repo_id ORDER BY commit_ts DESC, commit_id DESC) AS rk
  FROM commits) WHERE rk <= 150),
cf AS (
  SELECT c.repo_id, c.commit_id, l.l_partkey AS path
  FROM lineitem l JOIN commits c ON l.l_orderkey = c.commit_id
  JOIN win w ON w.repo_id = c.repo_id AND w.commit_id = c.commit_id),{RATIOS}
SELECT * FROM ratios WHERE total_a >= 2 AND pct > 10
""")

NATION_EDGES = """nl AS (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE c.c_nationkey <> s.s_nationkey GROUP BY c.c_nationkey, s.s_nationkey),
e AS (SELECT 'nations' AS repo_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (
  SELECT src, dst, n, count(*) OVER (PARTITION BY src) AS c, sum(n) OVER (PARTITION BY src) AS s FROM nl)
  WHERE 2 * n * c >= 3 * s)"""

SUPP_EDGES = SUPP_CF + "," + RATIOS + """,
e AS (SELECT repo_id, a AS src, b AS dst FROM (
  SELECT repo_id, a, b, joint, count(*) OVER (PARTITION BY repo_id, a) AS c,
         sum(joint) OVER (PARTITION BY repo_id, a) AS s
  FROM ratios) WHERE joint * c > s AND (joint * c - s) * (joint * c - s) > 4 * s * c)"""

PART_EDGES = PART_CF + "," + RATIOS + """,
e AS (SELECT repo_id, a AS src, b AS dst FROM ratios WHERE joint >= 2)"""

CLOSURE = """reach(repo_id, src, dst) AS (
  SELECT repo_id, src, dst FROM e
  UNION
  SELECT r.repo_id, r.src, e.dst FROM reach r JOIN e ON r.repo_id = e.repo_id AND r.dst = e.src),
comp AS (
  SELECT r.repo_id, r.src AS node, min(r.dst) AS component FROM reach r
  WHERE EXISTS (SELECT 1 FROM reach b WHERE b.repo_id = r.repo_id AND b.src = r.dst AND b.dst = r.src)
  GROUP BY r.repo_id, r.src)"""

CYCLES_SELECT = """
SELECT c.repo_id, c.node, c.component, s.component_size
FROM comp c JOIN (SELECT repo_id, component, count(*) AS component_size FROM comp GROUP BY ALL) s
  ON c.repo_id = s.repo_id AND c.component = s.component"""

DEPTH = """nodes AS (SELECT repo_id, src AS node FROM e UNION SELECT repo_id, dst AS node FROM e),
nc AS (SELECT n.repo_id, n.node, coalesce(c.component, n.node) AS c
       FROM nodes n LEFT JOIN comp c ON c.repo_id = n.repo_id AND c.node = n.node),
w AS (SELECT repo_id, c, count(*) AS w FROM nc GROUP BY repo_id, c),
dag AS (SELECT DISTINCT e.repo_id, a.c AS cs, b.c AS cd FROM e
        JOIN nc a ON a.repo_id = e.repo_id AND a.node = e.src
        JOIN nc b ON b.repo_id = e.repo_id AND b.node = e.dst WHERE a.c <> b.c),
paths(repo_id, start, cur, acc) AS (
  SELECT repo_id, c, c, w FROM w
  UNION
  SELECT p.repo_id, p.start, d.cd, p.acc + w.w FROM paths p
  JOIN dag d ON d.repo_id = p.repo_id AND d.cs = p.cur
  JOIN w ON w.repo_id = d.repo_id AND w.c = d.cd),
depth AS (SELECT repo_id, start AS c, max(acc) AS depth FROM paths GROUP BY repo_id, start)
SELECT nc.repo_id, nc.node, CAST(d.depth AS BIGINT) AS depth
FROM nc JOIN depth d ON d.repo_id = nc.repo_id AND d.c = nc.c"""

oracle("import_resolution", """
WITH pf AS (
  SELECT 'parts' AS repo_id,
         lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS src,
         list_concat(string_split(p_name, ' '), [lower(p_type)]) AS mods FROM part),
raw AS (SELECT repo_id, src, unnest(mods) AS module FROM pf),
modules AS (SELECT DISTINCT 'parts' AS repo_id, w AS module, w || '.py' AS file
            FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT DISTINCT r.repo_id, r.src, m.file AS dst FROM raw r
JOIN modules m ON m.repo_id = r.repo_id AND m.module = r.module WHERE r.src <> m.file
""")

oracle("fan_in_out", f"""
WITH {NATION_EDGES},
o AS (SELECT repo_id, src AS node, count(*) AS fan_out FROM (SELECT DISTINCT * FROM e) GROUP BY ALL),
i AS (SELECT repo_id, dst AS node, count(*) AS fan_in FROM (SELECT DISTINCT * FROM e) GROUP BY ALL)
SELECT coalesce(o.repo_id, i.repo_id) AS repo_id, coalesce(o.node, i.node) AS node,
       coalesce(o.fan_out, 0) AS fan_out, coalesce(i.fan_in, 0) AS fan_in
FROM o FULL OUTER JOIN i ON o.repo_id = i.repo_id AND o.node = i.node
""")

oracle("reverse_deps", f"""
WITH {NATION_EDGES}
SELECT DISTINCT repo_id, dst AS file, src AS importer FROM e
""")

oracle("import_cycles", f"WITH RECURSIVE {NATION_EDGES}, {CLOSURE} {CYCLES_SELECT}")
oracle("supplier_cycles", f"WITH RECURSIVE {SUPP_EDGES}, {CLOSURE} {CYCLES_SELECT}")
oracle("dependency_depth", f"WITH RECURSIVE {NATION_EDGES}, {CLOSURE}, {DEPTH}")
oracle("supplier_depth", f"WITH RECURSIVE {SUPP_EDGES}, {CLOSURE}, {DEPTH}")



def _simple_cycles(edges: str, longest: int) -> str:
    """Walks from each node over larger ones, without repeats, closed by an edge back."""
    return f"""WITH RECURSIVE {edges}, de AS (SELECT DISTINCT repo_id, src, dst FROM e),
walk(repo_id, start, cur, nodes) AS (
  SELECT repo_id, src, dst, [src, dst] FROM de WHERE dst > src
  UNION ALL
  SELECT w.repo_id, w.start, d.dst, list_append(w.nodes, d.dst) FROM walk w JOIN de d ON d.repo_id = w.repo_id AND d.src = w.cur
  WHERE d.dst > w.start AND NOT list_contains(w.nodes, d.dst) AND len(w.nodes) < {longest}),
cyc AS (
  SELECT w.repo_id, w.start, w.nodes FROM walk w JOIN de d ON d.repo_id = w.repo_id AND d.src = w.cur AND d.dst = w.start
  UNION ALL SELECT repo_id, src, [src] FROM de WHERE src = dst),
paths AS (SELECT repo_id, CAST(start AS VARCHAR) AS file, CAST(len(nodes) AS BIGINT) AS length,
    array_to_string(list_append(nodes, start), ' -> ') AS path FROM cyc)
"""


oracle("nation_simple_cycles", _simple_cycles(NATION_EDGES, 6) + "SELECT repo_id, path, length FROM paths")
oracle("supplier_simple_cycles", _simple_cycles(SUPP_EDGES, 4) + "SELECT repo_id, path, length FROM paths")
oracle("cycle_risks", _simple_cycles(NATION_EDGES, 5) + """
SELECT repo_id, CAST(2 AS BIGINT) AS detector, 'Circular Dependency Loop' AS title, file, 'High' AS severity,
  CAST(0.99 AS DOUBLE) AS confidence, 'dependency' AS evidence_type, path, length FROM paths""")
oracle("cycle_risk_evidence", _simple_cycles(NATION_EDGES, 5) + """
SELECT repo_id, file, path, CAST(0 AS BIGINT) AS ord, 'AST import path forms a dependency loop: ' || path AS evidence FROM paths
UNION ALL SELECT repo_id, file, path, 1, 'Causes class loader coupling and initialization order fragility' FROM paths""")

_HOPS = """hop(repo_id, src, dst, hops) AS (
  SELECT DISTINCT repo_id, src, dst, 1 FROM e WHERE src <> dst
  UNION SELECT h.repo_id, h.src, e.dst, h.hops + 1 FROM hop h JOIN e ON e.repo_id = h.repo_id AND e.src = h.dst WHERE h.hops < {n} AND e.dst <> h.src),
near AS (SELECT repo_id, src, dst, CAST(min(hops) AS BIGINT) AS hops FROM hop GROUP BY ALL)"""

oracle("supplier_hops", f"WITH RECURSIVE {SUPP_EDGES}, {_HOPS.format(n=3)} SELECT * FROM near")
oracle("blast_radius_two_hops", f"""WITH RECURSIVE {SUPP_EDGES}, {_HOPS.format(n=2)},
tm AS (SELECT repo_id, a, b, pct FROM ratios WHERE total_a >= 2 AND pct > 10)
SELECT repo_id, target, file, static, pct, CAST(least((4000 * static + 60 * pct) // 100, 100) AS BIGINT) AS impact_weight,
  CASE WHEN static = 1 AND pct > 70 THEN 'Tight Coupler (Import & Git)' WHEN static = 1 THEN 'Direct Import' ELSE 'Shadow Coupling (Git History)' END AS relationship
FROM (SELECT coalesce(s.repo_id, t.repo_id) AS repo_id, coalesce(s.src, t.a) AS target, coalesce(s.dst, t.b) AS file,
    CAST(CASE WHEN s.src IS NULL THEN 0 ELSE 1 END AS BIGINT) AS static, CAST(coalesce(t.pct, 0) AS BIGINT) AS pct
  FROM near s FULL OUTER JOIN tm t ON s.repo_id = t.repo_id AND s.src = t.a AND s.dst = t.b)""")

BLAST = PART_EDGES.replace("\ne AS (", "\nse AS (") + """,
tm AS (SELECT repo_id, a, b, pct FROM ratios WHERE total_a >= 2 AND pct > 10),
fused AS (
  SELECT coalesce(s.repo_id, t.repo_id) AS repo_id, coalesce(s.src, t.a) AS target,
         coalesce(s.dst, t.b) AS file, CAST(CASE WHEN s.src IS NULL THEN 0 ELSE 1 END AS BIGINT) AS static,
         CAST(coalesce(t.pct, 0) AS BIGINT) AS pct
  FROM (SELECT DISTINCT * FROM se) s FULL OUTER JOIN tm t
    ON s.repo_id = t.repo_id AND s.src = t.a AND s.dst = t.b),
radius AS (
  SELECT repo_id, target, file, static, pct,
         CAST(least((4000 * static + 60 * pct) // 100, 100) AS BIGINT) AS impact_weight,
         CASE WHEN static = 1 AND pct > 70 THEN 'Tight Coupler (Import & Git)'
              WHEN static = 1 THEN 'Direct Import' ELSE 'Shadow Coupling (Git History)' END AS relationship
  FROM fused)"""

oracle("blast_radius", f"WITH {BLAST} SELECT * FROM radius")
oracle("blast_radius_ranked", f"""
WITH {BLAST} SELECT *, row_number() OVER (PARTITION BY repo_id, target ORDER BY impact_weight DESC, file) AS rank FROM radius
""")
oracle("impact_lists", f"""
WITH {SUPP_EDGES}
SELECT DISTINCT repo_id, src AS path, 'direct' AS relation, dst AS other, CAST(0 AS BIGINT) AS pct FROM e
UNION ALL SELECT DISTINCT repo_id, dst, 'reverse', src, 0 FROM e
UNION ALL SELECT repo_id, a, 'cochange', b, CAST(pct AS BIGINT) FROM ratios WHERE total_a >= 2 AND pct > 10
""")
oracle("global_impact", f"""
WITH {BLAST},
g AS (SELECT repo_id, target, sum(impact_weight) AS s, count(*) AS modules_affected FROM radius GROUP BY ALL)
SELECT repo_id, target, CAST(least((s * (20 + modules_affected)) // (20 * modules_affected), 100) AS BIGINT)
         AS global_impact_score, modules_affected,
       CASE WHEN least((s * (20 + modules_affected)) // (20 * modules_affected), 100) > 70 THEN 'CRITICAL'
            WHEN least((s * (20 + modules_affected)) // (20 * modules_affected), 100) > 40 THEN 'HIGH'
            ELSE 'MEDIUM' END AS risk_level
FROM g
""")

COMPANIONS = SUPP_EDGES + """,
files AS (SELECT DISTINCT repo_id, path FROM cf),
models AS (SELECT f.repo_id, f.path, 'nation_' || CAST(s.s_nationkey AS VARCHAR) AS model
           FROM files f JOIN supplier s ON s.s_suppkey = f.path),
tc AS (SELECT l.l_suppkey AS path, p.p_type, count(*) AS n FROM lineitem l
       JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL),
troute AS (SELECT path, '/' || lower(p_type) AS route FROM (
  SELECT path, p_type, n, count(*) OVER (PARTITION BY path) AS c, sum(n) OVER (PARTITION BY path) AS s FROM tc)
  WHERE n * c > s),
routes AS (SELECT f.repo_id, f.path, r.route FROM files f JOIN troute r ON r.path = f.path),
pairs AS (
  SELECT t.repo_id, t.path AS target, f.path AS file FROM files t JOIN files f
    ON t.repo_id = f.repo_id AND t.path <> f.path),
sc AS (
  SELECT p.repo_id, p.target, p.file,
    EXISTS (SELECT 1 FROM e WHERE e.repo_id = p.repo_id AND e.src = p.file AND e.dst = p.target) AS imp_in,
    EXISTS (SELECT 1 FROM e WHERE e.repo_id = p.repo_id AND e.src = p.target AND e.dst = p.file) AS imp_out,
    (SELECT string_agg(DISTINCT a.model, ', ' ORDER BY a.model) FROM models a JOIN models b
       ON a.repo_id = b.repo_id AND a.model = b.model
     WHERE a.repo_id = p.repo_id AND a.path = p.target AND b.path = p.file) AS sm,
    (SELECT string_agg(DISTINCT a.route, ', ' ORDER BY a.route) FROM routes a JOIN routes b
       ON a.repo_id = b.repo_id AND a.route = b.route
     WHERE a.repo_id = p.repo_id AND a.path = p.target AND b.path = p.file) AS sr,
    coalesce((SELECT r.pct FROM ratios r WHERE r.repo_id = p.repo_id AND r.a = p.target AND r.b = p.file), 0) AS pct
  FROM pairs p),
scored AS (
  SELECT *, CAST(CASE WHEN imp_in THEN 500 ELSE 0 END + CASE WHEN imp_out THEN 400 ELSE 0 END
         + CASE WHEN sm IS NOT NULL THEN 300 ELSE 0 END + CASE WHEN sr IS NOT NULL THEN 200 ELSE 0 END
         + 5 * pct AS BIGINT) AS score FROM sc),
conf AS (
  SELECT *, CAST(least(50 + (score + 10) // 20, 99) AS BIGINT) AS confidence_pct FROM scored WHERE score > 0),
ranked AS (
  SELECT repo_id, target, file, score, confidence_pct, confidence_pct / 100.0 AS confidence,
    concat_ws(' and ',
      CASE WHEN imp_in THEN 'Explicitly imports ' || CAST(target AS VARCHAR) END,
      CASE WHEN imp_out THEN 'Imported by ' || CAST(target AS VARCHAR) END,
      CASE WHEN sm IS NOT NULL THEN 'Shares DB model: ' || sm END,
      CASE WHEN sr IS NOT NULL THEN 'Shares API endpoint paths: ' || sr END,
      CASE WHEN pct > 0 THEN 'Co-changed in ' || CAST(pct AS VARCHAR) || '% of commit history' END) AS reason,
    row_number() OVER (PARTITION BY repo_id, target ORDER BY confidence_pct DESC, file) AS rank
  FROM conf)"""

oracle("companion_files", f"""
WITH {COMPANIONS}
SELECT repo_id, target, file, score, confidence_pct, CAST(confidence AS DOUBLE) AS confidence, reason,
       CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 8
""")

oracle("simulated_impact", f"""
WITH {COMPANIONS}
SELECT f.repo_id, f.path AS target, CAST(coalesce(floor(avg(r.confidence_pct)), 10) AS BIGINT) AS impact_score
FROM files f LEFT JOIN (SELECT * FROM ranked WHERE rank <= 8) r ON r.repo_id = f.repo_id AND r.target = f.path
GROUP BY f.repo_id, f.path
""")

PART_LAYER_CTES = """pf AS (
  SELECT 'parts' AS repo_id, p_partkey AS key,
         lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS path
  FROM part),
tax(layer, priority, keyword) AS (VALUES
  ('Fastener Layer', 1, 'bolt'), ('Fastener Layer', 1, 'rod'), ('Fastener Layer', 1, 'ring'),
  ('Tooling Layer', 2, 'gear'), ('Tooling Layer', 2, 'anvil'), ('Tooling Layer', 2, 'plate'),
  ('Gadget Layer', 3, 'gizmo'), ('Gadget Layer', 3, 'widget'),
  ('Climate Layer', 4, 'hot'), ('Climate Layer', 4, 'cold')),
lyr(layer, priority) AS (VALUES ('Fastener Layer', 1), ('Tooling Layer', 2), ('Gadget Layer', 3),
  ('Climate Layer', 4), ('Core Runtime Layer', 5)),
rules(grp, ord, layer, pattern, points) AS (VALUES
  ('path', 1, 'Tooling Layer', '^large/', 8), ('path', 2, 'Gadget Layer', '^(promo|small)/', 8)),
contrib AS (
  SELECT f.repo_id, f.path, t.layer,
         CASE WHEN contains(lower(string_split(f.path, '/')[-1]), t.keyword) THEN 6 ELSE 3 END AS points
  FROM pf f JOIN tax t ON contains(lower(f.path), t.keyword)
  UNION ALL
  SELECT repo_id, path, layer, points FROM (
    SELECT f.repo_id, f.path, r.layer, r.points,
           row_number() OVER (PARTITION BY f.repo_id, f.path, r.grp ORDER BY r.ord) AS rk
    FROM pf f JOIN rules r ON regexp_matches(lower(f.path), r.pattern)) WHERE rk = 1),
scores AS (SELECT repo_id, path, layer, CAST(sum(points) AS BIGINT) AS score FROM contrib GROUP BY ALL),
best AS (SELECT repo_id, path, layer, score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.repo_id, s.path ORDER BY s.score DESC, l.priority) AS rk
  FROM scores s JOIN lyr l ON l.layer = s.layer WHERE s.score > 0) WHERE rk = 1),
assign AS (
  SELECT f.repo_id, f.path, coalesce(b.layer, 'Core Runtime Layer') AS layer, CAST(coalesce(b.score, 0) AS BIGINT) AS score
  FROM pf f LEFT JOIN best b ON b.repo_id = f.repo_id AND b.path = f.path)"""

oracle("layer_score", f"WITH {PART_LAYER_CTES} SELECT * FROM scores")
oracle("layer_argmax", f"WITH {PART_LAYER_CTES} SELECT * FROM assign")
oracle("layer_rollup", f"""
WITH {PART_LAYER_CTES},
g AS (SELECT repo_id, layer, count(*) AS n_files, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS scored
      FROM assign GROUP BY ALL)
SELECT g.repo_id, g.layer, g.n_files,
       CAST(least(greatest((200 * scored + n_files) // (2 * n_files), 60), 98) AS BIGINT) AS confidence_pct,
       row_number() OVER (PARTITION BY g.repo_id ORDER BY n_files DESC, l.priority) AS rank
FROM g JOIN lyr l ON l.layer = g.layer
""")

PART_GRAPH = """pcf AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem),
pfreq AS (SELECT path, count(*) AS total FROM pcf GROUP BY path),
pj AS (SELECT x.path AS a, y.path AS b, count(*) AS joint FROM pcf x JOIN pcf y
       ON x.commit_id = y.commit_id AND x.path < y.path GROUP BY ALL),
psym AS (SELECT a, b, joint FROM pj UNION ALL SELECT b, a, joint FROM pj),
ptop AS (SELECT a, b FROM psym WHERE joint >= 2),
ge AS (SELECT 'parts' AS repo_id, s.path AS src, d.path AS dst FROM ptop
       JOIN pf s ON s.key = ptop.a JOIN pf d ON d.key = ptop.b),
nb AS (SELECT repo_id, src AS path, dst AS nb FROM ge UNION ALL SELECT repo_id, dst AS path, src AS nb FROM ge),
nnb AS (SELECT repo_id, path, count(*) AS n_nb FROM nb GROUP BY ALL)"""

ROUND = """{out} AS (
  SELECT c.repo_id, c.path,
    CASE WHEN (c.layer = 'Core Runtime Layer' OR c.score < 4) AND t.layer IS NOT NULL THEN t.layer ELSE c.layer END AS layer,
    CAST(CASE WHEN (c.layer = 'Core Runtime Layer' OR c.score < 4) AND t.layer IS NOT NULL THEN 4 ELSE c.score END AS BIGINT) AS score
  FROM {src} c LEFT JOIN (
    SELECT v.repo_id, v.path, v.layer FROM (
      SELECT n.repo_id, n.path, a.layer, count(*) AS votes,
             row_number() OVER (PARTITION BY n.repo_id, n.path ORDER BY count(*) DESC, min(l.priority)) AS rk
      FROM nb n JOIN {src} a ON a.repo_id = n.repo_id AND a.path = n.nb JOIN lyr l ON l.layer = a.layer
      WHERE a.layer <> 'Core Runtime Layer' GROUP BY n.repo_id, n.path, a.layer) v
    JOIN nnb ON nnb.repo_id = v.repo_id AND nnb.path = v.path
    WHERE v.rk = 1 AND (v.votes >= 2 OR nnb.n_nb = 1)) t ON t.repo_id = c.repo_id AND t.path = c.path)"""

oracle("label_propagation", f"""
WITH {PART_LAYER_CTES}, {PART_GRAPH}, {ROUND.format(out='r1', src='assign')}, {ROUND.format(out='r2', src='r1')}
SELECT * FROM r2
""")

DOC_FF = """ff AS (
  SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) || '.py' AS path, '.py' AS extension,
         CAST(n_chars AS BIGINT) AS size, CAST(0 AS BIGINT) AS function_count, CAST(0 AS BIGINT) AS class_count,
         CAST(0 AS BIGINT) AS route_count, CAST(0 AS BIGINT) AS import_count, CAST(0 AS BIGINT) AS imported_by_count
  FROM documents)"""

R1 = """r1 AS (
  SELECT repo_id, CAST(1 AS BIGINT) AS detector,
         CASE WHEN contains(lower(path), 'controller') OR contains(lower(path), 'window')
              THEN 'Monolithic Controller' ELSE 'Oversized Module / God Object' END AS title,
         path AS file, CASE WHEN size > 80000 THEN 'Critical' ELSE 'High' END AS severity,
         CAST(0.95 AS DOUBLE) AS confidence, 'complexity' AS evidence_type
  FROM ff WHERE extension = '.py' AND (size > 30720 OR function_count > 20))"""

TESTS = """tests AS (SELECT lower('tests/test_' || CAST(item_id AS VARCHAR) || '.py') AS tpath,
                    'tests/test_' || CAST(item_id AS VARCHAR) || '.py' AS test FROM benchmark)"""

MISSING = """src AS (
  SELECT repo_id, path AS file, size, regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) AS stem
  FROM ff WHERE extension = '.py' AND NOT contains(lower(path), 'test')
    AND NOT contains(lower(path), 'setup') AND size > 1000),
miss AS (SELECT repo_id, file, size, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, file) AS rank
  FROM src s WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE contains(t.tpath, s.stem)))"""

oracle("file_fact_enrichment", f"WITH {DOC_FF} SELECT * FROM ff")

oracle("health_scores", f"""
WITH {DOC_FF},
g AS (SELECT repo_id, count(*) AS n_files, sum(function_count + 2 * class_count) AS complexity,
             sum(import_count) AS dependencies,
             sum(CASE WHEN size > 15360 THEN least(3 * (size - 15360), 45000) ELSE 0 END) AS bloat3000,
             sum(CASE WHEN contains(lower(path), 'test') THEN 1 ELSE 0 END) AS test_files,
             max(CASE WHEN starts_with(lower(path), 'readme') THEN 1 ELSE 0 END) AS has_readme
      FROM ff GROUP BY repo_id)
SELECT repo_id, n_files,
  CAST(least(greatest((300000 - least(600 * complexity, 60000) - least(1000 * dependencies, 45000)
       - least(bloat3000, 45000)) // 3000, 10), 100) AS BIGINT) AS maintainability,
  CAST(95 AS BIGINT) AS structural_integrity,
  CAST(CASE WHEN least((400 * test_files) // n_files, 100) < 10 THEN 15
       ELSE least((400 * test_files) // n_files, 100) END AS BIGINT) AS test_density,
  CAST(CASE WHEN has_readme = 1 THEN 85 ELSE 40 END AS BIGINT) AS documentation
FROM g
""")

oracle("risk_oversized", f"WITH {DOC_FF}, {R1} SELECT * FROM r1")
oracle("missing_tests", f"WITH {DOC_FF}, {TESTS}, {MISSING} SELECT * FROM miss WHERE rank <= 4")
oracle("affected_tests", f"""
WITH {DOC_FF}, {TESTS},
f AS (SELECT repo_id, path AS file, regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) AS stem FROM ff)
SELECT DISTINCT f.repo_id, f.file, t.test FROM f JOIN tests t ON contains(t.tpath, f.stem)
""")

PAGE_ROUTES = """pr AS (SELECT DISTINCT 'pages' AS repo_id, url AS path,
      unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS route FROM pages),
routes AS (SELECT repo_id, path, route, 'GET' AS method, path || ':page' AS handler FROM pr)"""

oracle("route_extract", f"WITH {PAGE_ROUTES} SELECT * FROM routes")

oracle("risk_union", f"""
WITH RECURSIVE {DOC_FF}, {R1}, {TESTS}, {MISSING}, {PAGE_ROUTES}, {NATION_EDGES}, {CLOSURE}, {DEPTH.split('SELECT nc.repo_id')[0].rstrip().rstrip(',')},
nd AS (SELECT nc.repo_id, nc.node, d.depth FROM nc JOIN depth d ON d.repo_id = nc.repo_id AND d.c = nc.c)
SELECT * FROM r1
UNION ALL
SELECT repo_id, 2, 'Circular Dependency Loop', CAST(node AS VARCHAR), 'High', CAST(0.99 AS DOUBLE), 'dependency'
FROM comp WHERE node = component
UNION ALL
SELECT repo_id, 3, 'Deep Dependency Chain', CAST(node AS VARCHAR), 'Medium', CAST(0.90 AS DOUBLE), 'dependency'
FROM nd WHERE depth > 4
UNION ALL
SELECT repo_id, 4, 'Route Concentration Bottleneck', path, 'High', CAST(0.95 AS DOUBLE), 'route'
FROM routes GROUP BY repo_id, path HAVING count(*) > 5
UNION ALL
SELECT repo_id, 6, 'Missing Unit Test Coverage', file, 'Medium', CAST(0.90 AS DOUBLE), 'test' FROM miss WHERE rank <= 4
""")


def _values_from_vocab():
    from archspark.functions import vocab
    from archspark.plans.bindings import PART_LAYERS
    concept_rows = ", ".join(f"('{kw}', '{c}')" for kw, cs in vocab.CONCEPT_MAP for c in cs)
    stop_rows = ", ".join(f"('{w}')" for w in vocab.STOP_WORDS)
    cm_rows = ", ".join(f"('{kw}', {i}, '{t}')" for i, (kw, t) in enumerate(vocab.CHANGE_MAP, start=1))
    lv_rows = ", ".join(f"('{layer}', '{kw}')" for layer, kws in PART_LAYERS for kw in kws)
    return concept_rows, stop_rows, cm_rows, lv_rows


_CONCEPT_ROWS, _STOP_ROWS, _CM_ROWS, _LV_ROWS = _values_from_vocab()

GOALS = f"""goals AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS goal_id, text AS goal
  FROM conversations WHERE role = 'user'),
cmap(keyword, concept) AS (VALUES {_CONCEPT_ROWS}),
stopw(word) AS (VALUES {_STOP_ROWS}),
hits AS (SELECT DISTINCT g.goal_id, k.keyword FROM goals g
         JOIN (SELECT DISTINCT keyword FROM cmap) k ON contains(lower(g.goal), k.keyword)),
words AS (SELECT goal_id, unnest(regexp_extract_all(lower(goal), '[\\p{{L}}\\p{{N}}_]+')) AS concept FROM goals),
gc AS (SELECT h.goal_id, c.concept FROM hits h JOIN cmap c ON c.keyword = h.keyword
       UNION
       SELECT goal_id, concept FROM words WHERE length(concept) > 1 AND concept NOT IN (SELECT word FROM stopw)),
lvocab(layer, concept) AS (VALUES {_LV_ROWS}),
tl AS (SELECT DISTINCT gc.goal_id, v.layer FROM gc JOIN lvocab v ON v.concept = gc.concept
       UNION
       SELECT DISTINCT goal_id, 'Core Runtime Layer' FROM gc
       WHERE goal_id NOT IN (SELECT gc.goal_id FROM gc JOIN lvocab v ON v.concept = gc.concept))"""

oracle("intent_concepts", f"WITH {GOALS} SELECT goal_id, concept FROM gc")
oracle("target_layers", f"WITH {GOALS} SELECT goal_id, layer FROM tl")
oracle("intent_summary", f"""
WITH {GOALS}
SELECT n.goal_id, n.n_concepts, CAST(coalesce(h.direct_hits, 0) AS BIGINT) AS direct_hits,
       CAST(least(70 + 8 * coalesce(h.direct_hits, 0), 98) AS BIGINT) AS confidence_pct
FROM (SELECT goal_id, count(*) AS n_concepts FROM gc GROUP BY goal_id) n
LEFT JOIN (SELECT goal_id, count(*) AS direct_hits FROM hits GROUP BY goal_id) h ON h.goal_id = n.goal_id
""")

oracle("candidate_topk", f"""
WITH {GOALS}, {PART_LAYER_CTES},
pe AS (SELECT DISTINCT 'parts' AS repo_id, r.src, r.module || '.py' AS dst FROM (
         SELECT lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS src,
                unnest(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS module FROM part) r
       WHERE r.module IN (SELECT unnest(string_split(p_name, ' ')) FROM part)),
fo AS (SELECT src AS path, count(*) AS n FROM pe GROUP BY src),
fi AS (SELECT dst AS path, count(*) AS n FROM pe GROUP BY dst),
f AS (SELECT a.repo_id, a.path, a.layer,
             coalesce(fo.n, 0) + coalesce(fi.n, 0) > 0 AS dep,
             coalesce(fi.n, 0) AS resp_x, coalesce(fi.n, 0) AS fan_in,
             regexp_matches(lower(a.path), 'max_ide|void-main') AS special
      FROM assign a LEFT JOIN fo ON fo.path = a.path LEFT JOIN fi ON fi.path = a.path),
gm AS (SELECT goal_id, count(*) AS m, bool_or(concept IN ('ui', 'editor', 'ide', 'sidebar')) AS has_ui
       FROM gc GROUP BY goal_id),
pq AS (SELECT gc.goal_id, f.path, count(*) AS p,
              sum(CASE WHEN contains(lower(string_split(f.path, '/')[-1]), gc.concept) THEN 1 ELSE 0 END) AS q,
              list_slice(list_sort(list(gc.concept)), 1, 3) AS matched
       FROM gc JOIN f ON contains(lower(f.path), gc.concept) GROUP BY gc.goal_id, f.path),
sc AS (
  SELECT gm.goal_id, f.repo_id, f.path, f.layer, f.fan_in,
         CASE WHEN tl.layer IS NULL THEN 0 ELSE 1 END AS t, f.dep, f.resp_x, gm.m,
         coalesce(pq.p, 0) AS p, coalesce(pq.q, 0) AS q, coalesce(pq.matched, []) AS matched,
         greatest(1, gm.m - 2) AS d1, greatest(1, gm.m - 4) AS d2, f.special AND gm.has_ui AS floor22
  FROM gm CROSS JOIN f
  LEFT JOIN pq ON pq.goal_id = gm.goal_id AND pq.path = f.path
  LEFT JOIN tl ON tl.goal_id = gm.goal_id AND tl.layer = f.layer),
scored AS (
  SELECT *, CAST(CASE WHEN m = 0 THEN 5 ELSE least(greatest((
          greatest(75 * least(p, d1) * d2, CASE WHEN floor22 THEN 66 * d1 * d2 ELSE 0 END)
        + 75 * least(q, d2) * d1
        + (20 * t + CASE WHEN dep THEN 15 + 5 * t ELSE 0 END) * 3 * d1 * d2
        + 2 * least(resp_x, 15) * d1 * d2) // (3 * d1 * d2), 5), 100) END AS BIGINT) AS score
  FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY goal_id, repo_id ORDER BY score DESC, path) AS rank FROM scored)
SELECT goal_id, repo_id, path, layer, score, CAST(rank AS BIGINT) AS rank,
  array_to_string(CASE WHEN len(list_filter([
      CASE WHEN t = 1 THEN 'Located inside ' || layer END,
      CASE WHEN regexp_matches(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$')
                AND regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) IN ('.tsx', '.jsx')
           THEN 'React TSX component'
           WHEN regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) = '.py' THEN 'Python module' END,
      CASE WHEN regexp_matches(lower(string_split(path, '/')[-1]), 'ui|panel|window|view|sidebar|widget')
           THEN 'Contains UI rendering logic' END,
      CASE WHEN fan_in > 2 THEN 'Referenced by core system components' END,
      CASE WHEN len(matched) > 0 THEN 'Matches intent concepts: ' || array_to_string(matched, ', ') END],
      lambda x: x IS NOT NULL)) = 0 THEN ['File path matched concepts in goal request.']
    ELSE list_filter([
      CASE WHEN t = 1 THEN 'Located inside ' || layer END,
      CASE WHEN regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) IN ('.tsx', '.jsx')
           THEN 'React TSX component'
           WHEN regexp_extract(string_split(path, '/')[-1], '^.*[^.](\\.[^.]*)$', 1) = '.py' THEN 'Python module' END,
      CASE WHEN regexp_matches(lower(string_split(path, '/')[-1]), 'ui|panel|window|view|sidebar|widget')
           THEN 'Contains UI rendering logic' END,
      CASE WHEN fan_in > 2 THEN 'Referenced by core system components' END,
      CASE WHEN len(matched) > 0 THEN 'Matches intent concepts: ' || array_to_string(matched, ', ') END],
      lambda x: x IS NOT NULL) END, ' | ') AS reasons
FROM ranked WHERE rank <= 10
""")

oracle("first_keyword_match", f"""
WITH goals AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS prompt_id, text AS prompt
  FROM conversations WHERE role = 'user'),
cm(keyword, ord, target) AS (VALUES {_CM_ROWS}),
p AS (SELECT prompt_id, regexp_replace(lower(prompt), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS norm FROM goals),
w AS (SELECT prompt_id, unnest(string_split_regex(trim(norm, ' '), '\\s+')) AS keyword,
             unnest(range(len(string_split_regex(trim(norm, ' '), '\\s+')))) AS pos FROM p),
t1 AS (SELECT w.prompt_id, arg_min(cm.target, w.pos) AS t1 FROM w JOIN cm ON cm.keyword = w.keyword GROUP BY w.prompt_id),
t2 AS (SELECT p.prompt_id, arg_min(cm.target, cm.ord) AS t2 FROM p JOIN cm ON contains(p.norm, cm.keyword) GROUP BY p.prompt_id)
SELECT p.prompt_id, coalesce(t1.t1, t2.t2) AS target FROM p
LEFT JOIN t1 ON t1.prompt_id = p.prompt_id LEFT JOIN t2 ON t2.prompt_id = p.prompt_id
""")

oracle("path_parts", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, string_split(path, '/')[-1] AS basename FROM p),
r AS (SELECT *, regexp_extract(basename, '^.*[^.](\.[^.]*)$', 1) AS extension FROM q)
SELECT page_id, path, basename, extension,
  CASE WHEN length(extension) > 0 THEN regexp_extract(basename, '^(.*)\.[^.]*$', 1) ELSE basename END AS stem,
  CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] END AS first_segment,
  regexp_matches(path, '(\.py|\.js|\.ts|\.go|\.java|\.cpp|\.cs)$') AS is_code,
  regexp_matches(basename, '(\.db|\.sqlite|\.sqlite3)$') AS is_database,
  basename IN ('main.py', 'app.py', 'wsgi.py', 'run.py', 'server.py', 'asgi.py', 'index.js', 'server.js',
               'app.js', 'main.js', 'index.tsx', 'index.jsx', 'main.tsx') AS is_entry_point,
  contains(lower(path), 'test') AS is_test,
  len(list_intersect(string_split(path, '/'), ['.git', '.venv', 'venv', 'env', 'node_modules', 'build', 'dist',
      '__pycache__', '.idea', '.vscode', '.pytest_cache'])) > 0 AS is_ignored
FROM r
""")

oracle("dir_counts", """
SELECT source AS repo_id, lang AS dir, count(*) AS n_files FROM documents GROUP BY ALL
""")

REQ = r"""lines AS (
  SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) || '.py' AS path,
         unnest(string_split(text, chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
l2 AS (SELECT repo_id, path, line_no, regexp_replace(raw, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS line FROM lines),
req AS (SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no,
          lower(regexp_replace(split_part(split_part(split_part(split_part(line, '==', 1), '>=', 1), '<=', 1), '~=', 1),
                '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')) AS dep
        FROM l2 WHERE length(line) > 0 AND NOT starts_with(line, '#') AND NOT starts_with(line, '-r'))"""

oracle("manifest_lines", f"WITH {REQ} SELECT * FROM req WHERE length(dep) > 0")

oracle("manifest_json", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo_id, unnest(list_distinct(list_concat(
    json_keys(props), [event_type]))) AS dep
FROM events
""")

oracle("manifest_variants", """
WITH m AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, CAST(event_id AS VARCHAR) AS path, event_id % 5 AS n, event_type, props FROM events)
SELECT repo_id, path, 'dependencies' AS section, k AS dep, json_extract_string(props, '$."' || k || '"') AS version, NULL::VARCHAR AS reason
FROM (SELECT *, unnest(json_keys(props)) AS k FROM m WHERE n = 0)
UNION ALL SELECT repo_id, path, 'devDependencies', event_type, '*', NULL FROM m WHERE n = 0
UNION ALL SELECT repo_id, path, NULL, NULL, NULL, 'malformed JSON' FROM m WHERE n = 1
UNION ALL SELECT repo_id, path, 'dependencies', NULL, NULL, 'dependencies is not an object' FROM m WHERE n = 2
UNION ALL SELECT repo_id, path, 'devDependencies', 'k', '{"v":1}', NULL FROM m WHERE n = 2
UNION ALL SELECT repo_id, path, NULL, NULL, NULL, 'not an object' FROM m WHERE n = 3
UNION ALL SELECT repo_id, path, NULL, NULL, NULL, 'empty' FROM m WHERE n = 4""")

oracle("project_type", f"""
WITH {REQ},
deps AS (SELECT DISTINCT repo_id, dep FROM req WHERE length(dep) > 0),
fl AS (SELECT repo_id, max(contains(dep, 'fastapi')::INT) AS fa, max(contains(dep, 'flask')::INT) AS fl,
              max(contains(dep, 'react')::INT) AS re, max(contains(dep, 'vue')::INT) AS vu,
              max(contains(dep, 'django')::INT) AS dj FROM deps GROUP BY repo_id),
g AS (SELECT source AS repo_id, count(*) AS n_files, count(*) AS py, 0 AS js FROM documents GROUP BY source),
t AS (SELECT g.*, CASE WHEN fl.fa = 1 THEN 'FastAPI' WHEN fl.fl = 1 THEN 'Flask' WHEN fl.re = 1 THEN 'React'
                      WHEN fl.vu = 1 THEN 'Vue' WHEN fl.dj = 1 THEN 'Django'
                      WHEN g.py > 0 THEN 'Python' WHEN g.js > 0 THEN 'JavaScript' ELSE 'Unknown' END AS project_type
      FROM g LEFT JOIN fl ON fl.repo_id = g.repo_id)
SELECT repo_id, project_type, CAST(n_files AS BIGINT) AS n_files, CAST(py AS BIGINT) AS py_files,
       CAST(js AS BIGINT) AS js_files,
       project_type || ' (' || CAST(n_files AS VARCHAR) || ' files'
         || CASE WHEN py > 0 OR js > 0 THEN ': ' || CAST(py AS VARCHAR) || ' py, ' || CAST(js AS VARCHAR) || ' js' ELSE '' END
         || ')' AS layout
FROM t
""")

PART_FF = PART_LAYER_CTES + """,
pe AS (SELECT DISTINCT 'parts' AS repo_id, r.src, r.module || '.py' AS dst FROM (
         SELECT lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS src,
                unnest(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS module FROM part) r
       WHERE r.module IN (SELECT unnest(string_split(p_name, ' ')) FROM part)),
pff AS (SELECT f.repo_id, f.path, CAST(p.p_size AS BIGINT) * 100 AS size,
          CAST(coalesce(fo.n, 0) AS BIGINT) AS import_count, CAST(coalesce(fi.n, 0) AS BIGINT) AS imported_by_count
        FROM pf f JOIN part p ON p.p_partkey = f.key
        LEFT JOIN (SELECT src AS path, count(*) AS n FROM pe GROUP BY src) fo ON fo.path = f.path
        LEFT JOIN (SELECT dst AS path, count(*) AS n FROM pe GROUP BY dst) fi ON fi.path = f.path)"""

oracle("change_risk_score", f"""
WITH {PART_FF}
SELECT f.repo_id, f.path, a.layer, f.import_count AS direct_count, f.imported_by_count AS reverse_count,
       CAST(0 AS BIGINT) AS cochange_count, CAST(0 AS BIGINT) AS n_risks,
       CAST(least(greatest((1024 * (4 * f.import_count + 6 * f.imported_by_count)
            + f.size) // 1024, 10), 100) AS BIGINT) AS risk_score
FROM pff f JOIN assign a ON a.repo_id = f.repo_id AND a.path = f.path
""")

oracle("ownership", f"""
WITH {PART_LAYER_CTES}
SELECT repo_id, path, layer, CAST(count(*) OVER (PARTITION BY repo_id, layer) - 1 AS BIGINT) AS related_files,
       CAST(0 AS BIGINT) AS entry_points, CAST(0 AS BIGINT) AS routes
FROM assign
""")

oracle("plan_complexity", """
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS goal_id,
  CASE WHEN contains(lower(text), 'auth') OR contains(lower(text), 'jwt') OR contains(lower(text), 'login') THEN 'Medium'
       WHEN contains(lower(text), 'postgres') OR contains(lower(text), 'cosmos') OR contains(lower(text), 'database')
            OR contains(lower(text), 'db') THEN 'High'
       WHEN contains(lower(text), 'redis') OR contains(lower(text), 'cache') THEN 'Medium' ELSE 'Low' END AS complexity
FROM conversations WHERE role = 'user'
""")

oracle("impact_graph", f"""
WITH {COMPANIONS}
SELECT repo_id, target, file,
       CASE WHEN regexp_matches(lower(reason), 'imports|imported') THEN 'static' ELSE 'shadow' END AS edge_type,
       reason AS label, confidence_pct
FROM ranked WHERE rank <= 8
""")

oracle("impact_nodes", f"""
WITH {COMPANIONS}
SELECT repo_id, path AS target, path AS node, 'center' AS kind, CAST(100 AS BIGINT) AS confidence_pct FROM files
UNION ALL SELECT repo_id, target, file, 'companion', confidence_pct FROM ranked WHERE rank <= 8
""")

oracle("adjacency_sink", f"WITH {NATION_EDGES} SELECT DISTINCT repo_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e")
oracle("commit_logs", """
SELECT DISTINCT o_orderpriority AS repo_id, CAST(o_orderkey AS VARCHAR) AS commit_id, CAST(o_custkey AS VARCHAR) AS author, CAST(l_partkey AS VARCHAR) AS path
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
oracle("analysis_store", f"""WITH {_SERVICES}, v AS (SELECT *, CAST(substr(repo_id, 4) AS INT) % 3 = 0 AS later FROM inv)
SELECT repo_id, path, CAST(size AS BIGINT) AS size, CASE WHEN later THEN 2 ELSE 1 END::BIGINT AS analysis FROM v WHERE NOT (later AND starts_with(path, 'tests/'))""")

oracle("adjacency_json", f"""
WITH {NATION_EDGES}
SELECT DISTINCT repo_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e
""")


def _cascade_values():
    from archspark.functions import vocab
    kw = ", ".join(f"('{k}', {i}, '{f}')" for i, (k, f) in enumerate(vocab.FILE_KEYWORD_MAP, start=1))
    dk = ", ".join(f"('{k}', {i})" for i, k in enumerate(vocab.DEFAULT_TARGET_KEYS, start=1))
    return kw, dk


_KW_ROWS, _DK_ROWS = _cascade_values()

oracle("prompt_file_cascade", f"""
WITH p AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS prompt_id, 'parts' AS repo_id,
                  lower(text) AS norm FROM conversations WHERE role = 'user'),
f AS (SELECT 'parts' AS repo_id,
             lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS path
      FROM part),
km(keyword, ord, filename) AS (VALUES {_KW_ROWS}),
dk(dkey, ord) AS (VALUES {_DK_ROWS}),
kws AS (SELECT p.prompt_id, p.repo_id, km.* FROM p JOIN km ON contains(p.norm, km.keyword)),
exact AS (SELECT k.prompt_id, k.repo_id, f.path, 1 AS tier, 2 * k.ord AS sub FROM kws k
          JOIN f ON f.repo_id = k.repo_id AND f.path = k.filename),
loose AS (SELECT k.prompt_id, k.repo_id, f.path, 1 AS tier, 2 * k.ord + 1 AS sub FROM kws k
          JOIN f ON f.repo_id = k.repo_id AND (contains(f.path, k.filename) OR contains(f.path, k.keyword))),
parts AS (SELECT DISTINCT repo_id, path, part FROM (
            SELECT repo_id, path, unnest(list_concat([lower(path)], string_split(lower(path), '.'))) AS part FROM f)
          WHERE length(part) > 0),
t2 AS (SELECT p.prompt_id, p.repo_id, x.path, 2 AS tier, 0 AS sub FROM p JOIN parts x
       ON x.repo_id = p.repo_id AND contains(p.norm, x.part)),
t3 AS (SELECT f.repo_id, f.path, 3 AS tier, dk.ord AS sub FROM f JOIN dk ON contains(f.path, dk.dkey)),
t4 AS (SELECT repo_id, min(path) AS path, 4 AS tier, 0 AS sub FROM f GROUP BY repo_id),
fb AS (SELECT repo_id, path, tier, sub FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tier, sub, path) AS rk
         FROM (SELECT * FROM t3 UNION ALL SELECT * FROM t4)) WHERE rk = 1),
allc AS (SELECT * FROM exact UNION ALL SELECT * FROM loose UNION ALL SELECT * FROM t2
         UNION ALL SELECT p.prompt_id, p.repo_id, fb.path, fb.tier, fb.sub FROM p JOIN fb ON fb.repo_id = p.repo_id)
SELECT prompt_id, repo_id, path AS target, CAST(tier AS BIGINT) AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id, repo_id ORDER BY tier, sub, path) AS rk FROM allc)
WHERE rk = 1
""")


def _advice_values():
    from archspark.functions import vocab
    return ", ".join(f"({o}, '{t}', '{a}')" for o, t, a in vocab.ADVICE)


oracle("recommendations", f"""
WITH RECURSIVE {DOC_FF}, {R1}, {NATION_EDGES}, {CLOSURE},
adv(ord, title, advice) AS (VALUES {_advice_values()}),
r AS (SELECT repo_id, title, file FROM r1
      UNION ALL
      SELECT repo_id, 'Circular Dependency Loop', CAST(node AS VARCHAR) FROM comp WHERE node = component)
SELECT r.repo_id, r.file, r.title, a.ord, a.advice FROM r JOIN adv a ON a.title = r.title
""")

oracle("what_if", f"""
WITH p AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS prompt_id,
                  regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS norm
           FROM conversations WHERE role = 'user'),
cm(keyword, ord, target) AS (VALUES {_CM_ROWS}),
w AS (SELECT prompt_id, unnest(string_split_regex(trim(norm, ' '), '\\s+')) AS keyword,
             unnest(range(len(string_split_regex(trim(norm, ' '), '\\s+')))) AS pos FROM p),
t1 AS (SELECT w.prompt_id, arg_min(cm.target, w.pos) AS t1 FROM w JOIN cm ON cm.keyword = w.keyword GROUP BY w.prompt_id),
t2 AS (SELECT p.prompt_id, arg_min(cm.target, cm.ord) AS t2 FROM p JOIN cm ON contains(p.norm, cm.keyword) GROUP BY p.prompt_id),
mapped AS (SELECT p.prompt_id, 'parts' AS repo_id, coalesce(t1.t1, t2.t2) AS target FROM p
           LEFT JOIN t1 ON t1.prompt_id = p.prompt_id LEFT JOIN t2 ON t2.prompt_id = p.prompt_id),
pe AS (SELECT DISTINCT 'parts' AS repo_id, r.src, r.module || '.py' AS dst FROM (
         SELECT lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS src,
                unnest(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS module FROM part) r
       WHERE r.module IN (SELECT unnest(string_split(p_name, ' ')) FROM part) AND r.src <> r.module || '.py'),
g AS (SELECT repo_id, src AS target, sum(40) AS s, count(*) AS n FROM pe GROUP BY repo_id, src),
imp AS (SELECT repo_id, target, least((s * (20 + n)) // (20 * n), 100) AS score, n FROM g)
SELECT m.prompt_id, m.repo_id, m.target, CAST(coalesce(i.score, 0) AS BIGINT) AS global_impact_score,
       CAST(coalesce(i.n, 0) AS BIGINT) AS modules_affected,
       CASE WHEN m.target IS NULL THEN NULL WHEN coalesce(i.score, 0) > 70 THEN 'CRITICAL'
            WHEN coalesce(i.score, 0) > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
       CASE WHEN m.target IS NULL THEN
         'auth.py, billing.py, database.py, jwt.py, redis_cache.py, session.py, user_repo.py, utils.py' END AS suggestions
FROM mapped m LEFT JOIN imp i ON i.repo_id = m.repo_id AND i.target = m.target
""")
