"""Unit tests on re-typed inputs (a small application, hand-made graphs)."""

from pyspark.sql import functions as F

from archspark.operators import companions, extract, graph, history, layers, risks
from archspark.sources import dims

MAIN = "import auth\nimport database\n\ndef run():\n    return auth.login('a', 'b')\n"
AUTH = ("import database\nimport os\n\nclass AuthService:\n    def __init__(self):\n        pass\n"
        "    def login(self, u, p):\n        pass\n    def logout(self):\n        pass\n")
ROUTES = ("from fastapi import APIRouter\nfrom auth import AuthService\nrouter = APIRouter()\n\n"
          "@router.post('/login')\ndef login():\n    pass\n\n@router.get('/health')\ndef health():\n    pass\n\n"
          "@app.route('/items', methods=['GET', 'POST'])\ndef items():\n    pass\n\n"
          "@router.get\ndef bare():\n    pass\n\nasync def ignored():\n    pass\n")
USER = ("from sqlalchemy import Column\nclass User(Base):\n    id = Column(int)\n    name: str\n"
        "    @staticmethod\n    def make():\n        pass\n")


def _facts(spark, text, **how):
    one = spark.createDataFrame([("r", "x.py", text.encode())], "repo_id string, path string, content binary")
    return extract.code_facts(one, **how).first()


def test_source_facts(spark):
    f = _facts(spark, MAIN)
    assert f["parsed"] and [i["module"] for i in f["imports"]] == ["auth", "database"]
    assert [x["name"] for x in f["functions"]] == ["run"]
    a = _facts(spark, AUTH)
    assert a["classes"][0]["methods"] == ["__init__", "login", "logout"] and a["functions"] == []
    r = _facts(spark, ROUTES)
    eps = {(e["path"], e["method"], e["handler"]) for e in r["endpoints"]}
    assert eps == {("/login", "POST", "login"), ("/health", "GET", "health"), ("/items", "GET,POST", "items")}
    assert [x["name"] for x in r["functions"]] == ["bare"]  # bare decorator is no endpoint; async ignored
    u = _facts(spark, USER)
    assert u["models"][0]["name"] == "User" and u["models"][0]["fields"] == ["id", "name"]
    # static method without self counts as a function and as a method
    assert [x["name"] for x in u["functions"]] == ["make"]
    assert _facts(spark, "def broken(:\n")["parsed"] is False
    n = _facts(spark, "class A(x.y.B, f().C, 1):\n    if 1:\n        def hidden(self):\n            import a.b\n    def seen(self):\n"
                      "        class In(SQLModel): z: int = 1\n    q = db.Column(1)\nfrom . import c\nfrom .d import e\n"
                      "@app.get(x, methods=['put'])\n@app.route(methods=['a', 'b'])\n@get\ndef h(): pass\n")
    assert [(c["name"], c["bases"], c["methods"]) for c in n["classes"]] == [("A", ["B", "C"], ["seen"]), ("In", ["SQLModel"], [])]
    assert [(m["name"], m["fields"]) for m in n["models"]] == [("A", ["q"]), ("In", ["z"])]
    assert sorted(i["module"] for i in n["imports"]) == ["a", "d"]
    assert [(e["path"], e["method"]) for e in n["endpoints"]] == [("/", "GET"), ("/", "A,B")] and n["functions"] == []


def test_code_facts_job(spark):
    corpus = spark.createDataFrame(
        [("r", "main.py", MAIN.encode()), ("r", "auth.py", AUTH.encode()), ("r", "bad.py", b"\xff\xfe def (:"),
         ("r", "README.md", b"# hi")], "repo_id string, path string, content binary")
    f = extract.code_facts(corpus).orderBy("path").collect()
    assert [(r.path, r.parsed) for r in f] == [("auth.py", True), ("bad.py", False), ("main.py", True)]


def test_pairs_do_not_depend_on_blocks(spark):
    from itertools import combinations
    rows = [("r", 1, f"f{i:03d}") for i in range(60)] + [("r", 2, "f001"), ("r", 2, "f002"), ("r", 2, "f001"), ("s", 3, "f001"), ("s", 3, "x"), ("s", 4, "x")]
    cf = spark.createDataFrame(rows, "repo_id string, commit_id int, path string")
    want = {}
    for c in {(r, c) for r, c, _ in rows}:
        for a, b in combinations(sorted({p for r, k, p in rows if (r, k) == c}), 2):
            want[c[0], a, b] = want.get((c[0], a, b), 0) + 1
    for block in (256, 7, 1):
        assert {(r.repo_id, r.a, r.b): r.joint for r in history.cooccurrence(cf, block_files=block).collect()} == want
    totals = {(r.repo_id, r.a): r.total_a for r in history.cochange_ratios(cf, block_files=7).collect()}
    assert totals["r", "f001"] == 2 and totals["r", "f003"] == 1 and totals["s", "x"] == 2


def test_cochange_of_targets(spark):
    import random
    rnd = random.Random(2)
    rows = [("r" if c % 3 else "s", c, f"f{rnd.randrange(30)}") for c in range(80) for _ in range(rnd.randrange(1, 8))]
    cf = spark.createDataFrame(rows, "repo_id string, commit_id int, path string")
    targets = spark.createDataFrame([("r", "f1"), ("r", "f7"), ("s", "f2"), ("s", "none"), ("r", "f1")], "repo_id string, path string")
    want = [tuple(r) for r in history.cochange_ratios(cf).collect() if (r.repo_id, r.a) in {("r", "f1"), ("r", "f7"), ("s", "f2")}]
    assert want and sorted(map(tuple, history.cochange_of(cf, targets).collect())) == sorted(want)


def test_thresholds_prune_giant_commits(spark):
    """The matrix is that of all pairs; of a giant commit of files that are never touched again no pair is generated."""
    import random
    rnd = random.Random(9)
    rows = [("r", 0, f"f{i:03d}.py") for i in range(150)]  # first commit: everything
    rows += [("r", c, f"f{rnd.randrange(40) if c % 3 else rnd.randrange(12):03d}.py") for c in range(1, 60) for _ in range(rnd.randrange(1, 5))]
    rows += [("s", 0, f"g{i}.py") for i in range(50)] + [("r", 3, f"n{i}.md") for i in range(20)]
    cf = spark.createDataFrame(rows, "repo_id string, commit_id int, path string")
    for support, percent in ((2, 10), (3, 10), (2, 45), (1, 0), (4, 60)):
        plain = history.thresholded(history.cochange_ratios(cf, code_only=True), support, percent)
        want = sorted(map(tuple, plain.collect()))
        for block in (256, 8):
            got = history.temporal_matrix(cf, min_support=support, min_pct_exclusive=percent, block_files=block)
            assert sorted(map(tuple, got.collect())) == want
    made = lambda th: history._block_pairs(history._blocks(cf, "repo_id", "commit_id", "path", True, 8, th), "repo_id").count()
    everything, kept = made(None), made((2, 10))
    # 110 files of the first commit are touched once: they only meet files of at most nine commits
    assert everything > 11_000 and kept < 0.45 * everything


def test_dictionaries_of_any_size(spark):
    """Nested loop, automaton and substring join give the same pairs; 100,000 patterns pass in one scan."""
    import random

    from archspark.operators import joins
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcdé/_.", k=n))
    texts = [(i, word(rnd.randrange(0, 40))) for i in range(120)] + [(500, None), (501, "")]
    t = spark.createDataFrame(texts, "id int, text string")
    for n in (20, 300):
        needles = sorted({word(rnd.randrange(1, 5)) for _ in range(n)} | {"", "abcd"})
        d = spark.createDataFrame([(x, i) for i, x in enumerate(needles)] + [("abcd", -1)], "needle string, ord int")
        want = sorted((i, x, o) for i, s in texts for o, x in [*enumerate(needles), (-1, "abcd")] if s and x and x in s)
        for bound in (joins.MAX_BROADCAST_ROWS, 0):
            got = joins.contains_join(t, "text", d, "needle", max_broadcast_rows=bound).select("id", "needle", "ord")
            assert sorted(map(tuple, got.collect())) == want
    many = [f"w{i:05d}x" for i in range(100_000)]
    d = spark.createDataFrame([(x,) for x in many], "needle string")
    t = spark.createDataFrame([(i, f"src/w{i % 100_000:05d}x/w{(7 * i) % 100_000:05d}x.py") for i in range(3000)], "id int, text string")
    assert joins.contains_join(t, "text", d, "needle").count() == sum(1 if i == (7 * i) % 100_000 else 2 for i in range(3000))


def test_temporal_matrix_golden(spark):
    commits = [(1, ["main.py", "database.py", "models/user.py"]), (2, ["auth.py"]),
               (3, ["api/routes.py", "services/payment.py"]), (4, ["auth.py", "database.py"])]
    cf = spark.createDataFrame([("r", c, p) for c, ps in commits for p in ps], "repo_id string, commit_id int, path string")
    tm = {(r.a, r.b): r.pct for r in history.temporal_matrix(cf).collect()}
    assert tm == {("database.py", "main.py"): 50, ("database.py", "models/user.py"): 50,
                  ("database.py", "auth.py"): 50, ("auth.py", "database.py"): 50}


def test_cycles_and_depth(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "c"),
                               ("r", "x", "y"), ("r", "y", "z"), ("r", "z", "x"), ("r", "z", "w")],
                              "repo_id string, src string, dst string")
    comp = {r.node: (r.component, r.component_size) for r in graph.cycle_components(e).collect()}
    assert comp == {"a": ("a", 2), "b": ("a", 2), "x": ("x", 3), "y": ("x", 3), "z": ("x", 3)}
    depth = {r.node: r.depth for r in graph.dependency_depth(e).collect()}
    assert depth == {"a": 2, "b": 2, "c": 3, "d": 4, "x": 4, "y": 4, "z": 4, "w": 1}


def test_gram_join_equals_brute_force(spark):
    from archspark.operators.joins import gram_join
    needles = [(r, n) for r in "ab" for n in ("auth", "db", "z", "", "aaa", "test_auth", "é文")]
    texts = [("a", "tests/test_auth.py"), ("a", "tests/db_test.py"), ("a", ""), ("b", "xaaay"), ("b", "z"), ("b", "aé文"), ("c", "auth")]
    left, right = spark.createDataFrame(needles, "r string, n string"), spark.createDataFrame(texts, "r string, t string")
    got = {tuple(x) for x in gram_join(left, "n", right, "t", ["r"]).collect()}
    assert got == {(r, n, t) for r, n in needles for s, t in texts if r == s and n and n in t}
    got = {tuple(x) for x in gram_join(left, "n", right, "t", []).collect()}
    assert got == {(n, t) for _, n in needles for _, t in texts if n and n in t}


def test_agent_context_keeps_repositories_apart(spark):
    from archspark.plans import reports
    goals = spark.createDataFrame([("g", "add login"), ("h", "nothing")], "goal_id string, goal string")
    cands = spark.createDataFrame([("g", r, "auth.py", "L", 50 if r != "r3" else 3, 1) for r in ("r1", "r2", "r3")],
                                  "goal_id string, repo_id string, path string, layer string, score int, rank int")
    found = spark.createDataFrame([("r1", "auth.py", t) for t in ("A", "B", "C")], "repo_id string, file string, title string")
    tests = spark.createDataFrame([("r2", "tests/test_auth.py")], "repo_id string, path string")
    routes = spark.createDataFrame([("r2", "auth.py:login")], "repo_id string, handler string")
    none = cands.select("repo_id", F.col("path").alias("target"), F.col("path").alias("file")).where("false")
    rows = reports.agent_context(cands, goals, lambda targets: none, found, routes, tests).collect()
    got = {(r.goal_id, r.repo_id): (r.status, r.n_risks, r.n_routes, r.n_tests, r.n_checks, r.level) for r in rows}
    assert got == {("g", "r1"): ("available", 3, 0, 0, 3, "CRITICAL"), ("g", "r2"): ("available", 0, 1, 1, 3, "HIGH"),
                   ("g", "r3"): ("unavailable", None, None, None, None, None), ("h", None): ("unavailable", None, None, None, None, None)}


def test_rules_in_blocks(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/x.py", "b/x.py", "c.py")], "repo_id string, path string")
    rules = spark.createDataFrame([("g", i, "L", p, 1) for i, p in enumerate(["^a/", "x", "^c", "zzz", "py$"])],
                                  "grp string, ord int, layer string, pattern string, points int")
    got = [sorted(tuple(r) for r in layers.rule_hits(files, F.lower(F.col("path")), rules, n).collect()) for n in (100, 2, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1 + 2 + 1 + 0 + 3


def test_layers_on_app(spark):
    files = spark.createDataFrame([("r", p) for p in ["auth.py", "database.py", "models/user.py", "api/routes.py",
                                                      "main.py", "static/app.css"]], "repo_id string, path string")
    routes_df = spark.createDataFrame([("r", "api/routes.py")], "repo_id string, path string")
    a = layers.classify(files, dims.taxonomy(spark), dims.layers(spark), dims.path_rules(spark),
                        route_files=routes_df)
    got = {r.path: (r.layer, r.score) for r in a.collect()}
    assert got["auth.py"] == ("Authentication Layer", 6)
    assert got["database.py"] == ("Database Layer", 6)
    assert got["models/user.py"] == ("Database Layer", 3)
    assert got["api/routes.py"] == ("UI Layer", 3)
    assert got["main.py"] == ("Core Runtime Layer", 0)
    e = spark.createDataFrame([("r", "api/routes.py", "auth.py")], "repo_id string, src string, dst string")
    p = {r.path: (r.layer, r.score) for r in layers.propagate(a, e, dims.layers(spark)).collect()}
    assert p["api/routes.py"] == ("Authentication Layer", 4)


def test_companion_topk_bound_is_exact(spark):
    # one hot model group of 40 files; every file also in a route group of 10
    files = spark.createDataFrame([("r", f"f{i:02d}") for i in range(40)], "repo_id string, path string")
    models = spark.createDataFrame([("r", f"f{i:02d}", "Base") for i in range(40)], "repo_id string, path string, model string")
    routes = spark.createDataFrame([("r", f"f{i:02d}", f"/g{i % 4}") for i in range(40)], "repo_id string, path string, route string")
    edges = spark.createDataFrame([("r", "f39", "f00")], "repo_id string, src string, dst string")
    cc = spark.createDataFrame([("r", "f00", "f38", 60)], "repo_id string, a string, b string, pct bigint")
    k = 3
    got = companions.companions(files, edges, models, routes, cc, k=k).collect()
    # brute force: every pair scored
    import itertools
    score = {}
    for t, f in itertools.permutations(range(40), 2):
        s = 300 + (200 if t % 4 == f % 4 else 0)
        if (t, f) == (0, 39):
            s += 400
        if (t, f) == (39, 0):
            s += 500
        if (t, f) == (0, 38):
            s += 300
        score[(t, f)] = s
    want = set()
    for t in range(40):
        ranked = sorted(((min(50 + (s + 10) // 20, 99), f) for (tt, f), s in score.items() if tt == t),
                        key=lambda x: (-x[0], x[1]))[:k]
        want |= {(f"f{t:02d}", f"f{f:02d}") for _, f in ranked}
    assert {(r.target, r.file) for r in got} == want


def test_candidates_out_of_reach_are_dropped_before_names_meet(spark, monkeypatch):
    pairs = [("r", "t", f"g{i}", False, False, 0, True, True) for i in range(3)] + [
        ("r", "t", "low", False, False, 1, False, False), ("r", "t", "model", False, False, 1, True, False),
        ("r", "t", "high", True, False, 1, False, False), ("r", "u", "only", False, False, 1, False, False)]
    cands = spark.createDataFrame(pairs, "repo_id string, target string, file string, imp_in boolean, imp_out boolean, pct bigint, has_m boolean, has_r boolean")
    kept = {(r.target, r.file) for r in companions._reaching(cands, 3, "repo_id").collect()}
    assert kept == {("t", "g0"), ("t", "g1"), ("t", "g2"), ("t", "low"), ("t", "model"), ("t", "high"), ("u", "only")}
    kept = {(r.target, r.file) for r in companions._reaching(cands.withColumn("pct", F.when(F.col("has_r"), 20).otherwise(F.col("pct"))), 3, "repo_id").collect()}
    assert kept == {("t", "g0"), ("t", "g1"), ("t", "g2"), ("t", "high"), ("u", "only")}  # 600 sure points, the others at most 505


def test_group_heads_outside_the_inventory_do_not_count(spark):
    files = spark.createDataFrame([("r", f"f{i}") for i in range(6)], "repo_id string, path string")
    members = [("r", f"f{i}") for i in range(6)] + [("r", f"a{i}") for i in range(9)]  # a..: named, but no files
    models = spark.createDataFrame([(*m, "M") for m in members], "repo_id string, path string, model string")
    routes = spark.createDataFrame([(*m, "/r") for m in members], "repo_id string, path string, route string")
    none = spark.createDataFrame([], "repo_id string, src string, dst string")
    cc = spark.createDataFrame([], "repo_id string, a string, b string, pct bigint")
    got = {(r.target, r.file, r.score) for r in companions.companions(files, none, models, routes, cc, k=2).collect()}
    want = {(f"f{t}", f"f{x}", 500) for t in range(6) for x in [x for x in range(6) if x != t][:2]}
    assert got == want


def test_dealt_ratios_equal_plain_ones(spark):
    rows = [("r", f"c{c}", f"f{(c * c + j * (c % 5 + 1)) % 23}") for c in range(30) for j in range(1 + c % 18)]
    rows += [("s", "c1", "f1"), ("s", "c1", "f1"), ("s", "c2", None), ("s", "c2", "f2"), ("t", "c3", None), (None, "c4", "f1"), (None, "c4", "f2")]
    cf = spark.createDataFrame(rows, "repo_id string, commit_id string, path string")
    for block_files in (3, 256):
        blocks = history.commit_blocks(cf, block_files=block_files)
        dealt = history.dealt_ratios(blocks, 5)
        assert dealt.columns == (plain := history.cochange_ratios(cf).where("repo_id IS NOT NULL")).columns
        assert sorted(map(tuple, dealt.where("repo_id IS NOT NULL").collect())) == sorted(map(tuple, plain.collect()))
        assert {tuple(r) for r in history.blocks_files(blocks).collect()} == {(k, p) for k, _, p in rows}


def test_companions_are_the_best_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    for names, dealt in ((2, None), (40, 6)):  # hot groups; many names, so that masks meet without a shared name
        n, k = 26, 3
        path = lambda i: f"f{i:02d}"
        ms = {i: {f"m{rng.randrange(names)}" for _ in range(rng.randrange(3))} for i in range(n)}
        rs = {i: {f"/r{rng.randrange(4 * names)}" for _ in range(rng.randrange(4))} for i in range(n)}
        e = {(rng.randrange(n), rng.randrange(n + 2)) for _ in range(25)}
        cc = {(rng.randrange(n), rng.randrange(n)): rng.choice([0, 1, 2, 5, 30, 90]) for _ in range(300)}
        make = lambda rows, cols: spark.createDataFrame([("r", *x) for x in rows], f"repo_id string, {cols}")
        files = make([(path(i),) for i in range(n)] * 2, "path string")
        models = make([(path(i), m) for i in ms for m in ms[i]], "path string, model string")
        routes = make([(path(i), r) for i in rs for r in rs[i]], "path string, route string")
        edges = make([(path(a), path(b)) for a, b in e], "src string, dst string")
        ratios = make([(path(a), path(b), p, (a, b) in e) for (a, b), p in cc.items()], "a string, b string, pct bigint, edge boolean")
        if dealt:
            ratios = ratios.unionByName(make([(path(a), path(b), 0, True) for a, b in e - set(cc)], "a string, b string, pct bigint, edge boolean")).repartition(dealt, "repo_id", "a")
        else:
            ratios = ratios.drop("edge")
        want = set()
        for t in range(n):
            found = []
            for f in range(n):
                s = 500 * ((f, t) in e) + 400 * ((t, f) in e) + 300 * bool(ms[t] & ms[f]) + 200 * bool(rs[t] & rs[f]) + 5 * cc.get((t, f), 0)
                if s and f != t:
                    found.append((-min(50 + (s + 10) // 20, 99), path(f), s))
            want |= {(path(t), f, s, i) for i, (_, f, s) in enumerate(sorted(found)[:k], 1)}
        got = companions.companions(files, edges, models, routes, ratios, k=k, dealt=dealt).collect()
        assert {(r.target, r.file, r.score, r.rank) for r in got} == want and len(got) == len(want)
        shared = {(r.target, r.file): r.reason for r in got}
        for (t, f), reason in shared.items():
            for m in ms[int(t[1:])] & ms[int(f[1:])]:
                assert m in reason


def test_layers_are_not_shuffled_by_layer(spark):
    a = spark.createDataFrame([("r", f"f{i}", "A" if i % 2 else "B", 5) for i in range(8)], "repo_id string, path string, layer string, score bigint")
    pri = spark.createDataFrame([("A", 1), ("B", 2)], "layer string, priority int")
    plan = layers.assign_layers(a.select("repo_id", "path"), a, pri)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [layer" in plan


def test_contains_join_fallback_equals_broadcast(spark):
    from archspark.operators.joins import contains_join
    texts = spark.createDataFrame([(1, "add jwt auth to login"), (2, "tune the database"), (3, "")],
                                  "id int, txt string")
    needles = spark.createDataFrame([("auth",), ("db",), ("data",), ("login",), ("",)], "kw string")
    a = contains_join(texts, "txt", needles, "kw").select("id", "kw").collect()
    b = contains_join(texts, "txt", needles, "kw", max_broadcast_rows=0).select("id", "kw").collect()
    assert sorted(a) == sorted(b) == sorted([(1, "auth"), (1, "login"), (2, "data")])


def test_options_async_foldcase_dotted(spark):
    src_async = "@router.get('/a')\nasync def a():\n    pass\n"
    assert _facts(spark, src_async)["endpoints"] == []
    assert [e["path"] for e in _facts(spark, src_async, include_async=True)["endpoints"]] == ["/a"]
    files = spark.createDataFrame([("r", p) for p in ["pkg/__init__.py", "pkg/mod.py", "pkg/sub/deep.py", "top.py",
                                                      "x.py"]], "repo_id string, path string")
    raw = spark.createDataFrame([("r", "x.py", "pkg.mod.func"), ("r", "x.py", "pkg.other"),
                                 ("r", "x.py", "pkg.sub.deep"), ("r", "x.py", "top"), ("r", "x.py", "numpy.linalg")],
                                "repo_id string, src string, name string")
    got = sorted(r.dst for r in graph.resolve_imports_dotted(raw, files).collect())
    assert got == ["pkg/__init__.py", "pkg/mod.py", "pkg/sub/deep.py", "top.py"]
    ff = spark.createDataFrame([("r", "src/AuthService.py", ".py", 5000)], "repo_id string, path string, extension string, size bigint")
    tests = spark.createDataFrame([("r", "tests/test_authservice.py")], "repo_id string, path string")
    assert risks.missing_tests(ff, tests).count() == 1              # CamelCase stem never matches (as the tool)
    assert risks.missing_tests(ff, tests, fold_case=True).count() == 0


import pytest  # noqa: E402


@pytest.mark.parametrize("n_nodes,n_edges,seed", [(30, 45, 7), (40, 110, 3)])
def test_cycle_components_random_graph_vs_brute_force(spark, n_nodes, n_edges, seed):
    import random
    rnd = random.Random(seed)
    edges = {(rnd.randrange(n_nodes), rnd.randrange(n_nodes)) for _ in range(n_edges)} | {(5, 5)}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo_id string, src int, dst int")
    # brute force: reachability by repeated relaxation in Python
    nodes = {x for e in edges for x in e}
    reach = {v: {b for a, b in edges if a == v} for v in nodes}
    changed = True
    while changed:
        changed = False
        for v in nodes:
            new = set().union(*(reach[u] for u in reach[v])) | reach[v]
            if new != reach[v]:
                reach[v], changed = new, True
    want = {}
    for v in nodes:
        if v in reach[v]:
            comp = {u for u in nodes if u in reach[v] and v in reach[u]} | {v}
            want[v] = (min(comp), len(comp))
    got = {r.node: (r.component, r.component_size) for r in graph.cycle_components(df).collect()}
    assert got == want


def test_dependency_depth_random_dag_vs_dp(spark):
    import random
    rnd = random.Random(11)
    edges = {(a, b) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(90)) if a < b}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo_id string, src int, dst int")
    nodes = sorted({x for e in edges for x in e})
    memo = {}
    for v in sorted(nodes, reverse=True):  # edges go from smaller to larger ids: reverse order is topological
        memo[v] = 1 + max((memo[b] for a, b in edges if a == v), default=0)
    got = {r.node: r.depth for r in graph.dependency_depth(df).collect()}
    assert got == memo


def test_blast_radius_hops(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a")], "repo_id string, src string, dst string")
    tm = spark.createDataFrame([("r", "a", "d", 80)], "repo_id string, a string, b string, pct bigint")
    one = {(r.target, r.file): (r.impact_weight, r.relationship) for r in graph.blast_radius(e, tm).collect()}
    assert one[("a", "b")] == (40, "Direct Import") and one[("a", "d")] == (48, "Shadow Coupling (Git History)")
    assert ("a", "c") not in one
    two = {(r.target, r.file) for r in graph.blast_radius(e, tm, hops=2).collect()}
    assert ("a", "c") in two and ("a", "a") not in two
