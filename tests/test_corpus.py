"""Corpus path: log parsing, JSON adjacency, the analysis on a re-typed application, streaming."""

import os
import tempfile

from pyspark.sql import functions as F

from archspark.plans.analysis import build_analysis
from archspark.sources import corpus as src
from archspark.streaming import commits as st

APP = {
    "main.py": "import auth\nimport database\n\ndef main():\n    auth.AuthService()\n",
    "auth.py": ("import database\n\nclass AuthService:\n    def login(self, u, p):\n        pass\n"
                "    def logout(self):\n        pass\n    def check(self):\n        pass\n"
                "    def hash(self, p):\n        pass\n    def verify(self, t):\n        pass\n" + "#" * 1100 + "\n"),
    "database.py": "class Database:\n" + "".join(f"    def m{i}(self):\n        pass\n" for i in range(13)) + "#" * 1100 + "\n",
    "api/routes.py": ("from auth import AuthService\n\n@router.post('/login')\ndef login():\n    pass\n\n"
                      "@router.post('/register')\ndef register():\n    pass\n\n@router.get('/health')\ndef health():\n    pass\n"
                      "\ndef helper():\n    pass\n"),
    "models/user.py": "class User:\n    def a(self):\n        pass\n    def b(self):\n        pass\n",
    "services/payment.py": ("import auth\nimport database\n\nclass Payment:\n    def pay(self):\n        pass\n"
                            "    def refund(self):\n        pass\n"),
    "README.md": "# app\n",
}
COMMITS = [["main.py", "database.py", "models/user.py"], ["auth.py"], ["api/routes.py", "services/payment.py"],
           ["auth.py", "database.py"]]


def _corpus(spark):
    rows = [("app", p, len(c.encode()), c.encode()) for p, c in APP.items()]
    return spark.createDataFrame(rows, src.CORPUS_SCHEMA)


def _log(spark):
    text = "".join(f"commit:h{4 - i}|dev\n" + "\n".join(fs) + "\n\n" for i, fs in enumerate(reversed(COMMITS)))
    return spark.createDataFrame([("app", r) for r in text.split("\ncommit:")], "repo_id string, value string")


def test_parse_commit_log(spark):
    cf = src.parse_commit_log(_log(spark))
    got = {(r.commit_id, r.path) for r in cf.collect()}
    assert ("h4", "auth.py") in got and ("h1", "models/user.py") in got and len(got) == 8
    assert {r.author for r in cf.collect()} == {"dev"}


def test_adjacency_json_roundtrip(spark):
    df = spark.createDataFrame([("app", '{"main.py": ["auth.py", "database.py"], "auth.py": []}'), ("app", "{bad")],
                               "repo_id string, value string")
    e = src.adjacency_from_json(df)
    assert sorted((r.src, r.dst) for r in e.collect()) == [("main.py", "auth.py"), ("main.py", "database.py")]
    out = tempfile.mkdtemp(prefix="adj-", dir="/tmp")
    src.write_adjacency_json(e, os.path.join(out, "adj"))
    back = src.adjacency_from_json(spark.read.text(os.path.join(out, "adj")))
    assert back.count() == 2


def test_graph_without_edges_is_read_back(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="adj-", dir="/tmp"), "adj")
    src.write_adjacency_json(spark.createDataFrame([], "repo_id string, src string, dst string"), out)
    assert src.adjacency_from_json(src.read_repositories(spark, out)).collect() == []
    src.write_commit_log(spark.createDataFrame([], "repo_id string, commit_id string, author string, files array<string>"), out)
    assert src.read_commit_logs(spark, out).collect() == []


def test_a_repository_is_written_by_one_task(spark):
    root = tempfile.mkdtemp(prefix="store-", dir="/tmp")
    df = spark.range(0, 300, 1, 6).selectExpr("concat('r', id % 3) AS repo_id", "id")
    src.save_analysis({"t": df}, root)
    src.update_analysis({"t": df.where("repo_id = 'r1'")}, root)
    files = [f for folder, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    assert len(files) == 3 and spark.read.parquet(os.path.join(root, "t")).count() == 300


def test_analysis_goldens(spark):
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)))
    edges = sorted((r.src, r.dst) for r in a["imports"].collect())
    assert edges == [("api/routes.py", "auth.py"), ("auth.py", "database.py"), ("main.py", "auth.py"),
                     ("main.py", "database.py"), ("services/payment.py", "auth.py"),
                     ("services/payment.py", "database.py")]
    ff = {r.path: r for r in a["file_facts"].collect()}
    assert ff["auth.py"].imported_by_count == 3 and ff["database.py"].imported_by_count == 3
    assert ff["database.py"].function_count == 13 and ff["auth.py"].function_count == 5
    assert ff["api/routes.py"].route_count == 3
    tm = {(r.a, r.b): r.pct for r in a["temporal_matrix"].collect()}
    assert tm == {("database.py", "main.py"): 50, ("database.py", "models/user.py"): 50,
                  ("database.py", "auth.py"): 50, ("auth.py", "database.py"): 50}
    cov = a["coverage"].collect()[0]
    assert (cov.ast_pct, cov.dep_pct, cov.git_pct, cov.route_pct) == (100, 100, 86, 100)
    assert cov.confidence_pct == 97
    h = a["health"].collect()[0]
    assert (h.maintainability, h.structural_integrity, h.test_density, h.documentation) == (91, 95, 15, 85)
    r = sorted((x.title, x.file) for x in a["risks"].collect())
    assert r == [("Missing Unit Test Coverage", "auth.py"), ("Missing Unit Test Coverage", "database.py")]
    depth = {x.node: x.depth for x in __import__("archspark.operators.graph", fromlist=["g"])
             .dependency_depth(a["imports"]).collect()}
    assert depth["main.py"] == 3 and depth["auth.py"] == 2 and depth["database.py"] == 1
    lay = {x.path: (x.layer, x.score) for x in a["layer_assignments"].collect()}
    assert lay["auth.py"] == ("Authentication Layer", 6) and lay["database.py"] == ("Database Layer", 6)
    assert lay["api/routes.py"] == ("Authentication Layer", 4) and lay["main.py"][0] == "Core Runtime Layer"
    comp = {x.file: x.confidence_pct for x in a["companions"].where(F.col("target") == "auth.py").collect()}
    assert comp == {"database.py": 83, "main.py": 75, "api/routes.py": 75, "services/payment.py": 75}
    ci = {x.path: x.risk_score for x in a["change_impact"].collect()}
    assert ci["auth.py"] >= 50


def test_streaming_commit_frequency(spark):
    d = tempfile.mkdtemp(prefix="stream-in-", dir="/tmp")
    rows = [("app", f"c{i}", p) for i, fs in enumerate(COMMITS) for p in fs]
    df = spark.createDataFrame(rows, "repo_id string, commit_id string, path string") \
        .withColumn("commit_ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.unionByName(df).write.mode("overwrite").parquet(os.path.join(d, "part1"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "part1"))
    out = tempfile.mkdtemp(prefix="stream-out-", dir="/tmp")
    st.run_available_now(st.commit_frequency_stream(stream), os.path.join(out, "t"), name=os.path.basename(out))
    got = {r.path: r.commits for r in st.current_counts(spark, os.path.join(out, "t")).collect()}
    assert got["auth.py"] == 2 and got["database.py"] == 2 and got["main.py"] == 1
    compact = spark.read.parquet(st.compact_counts(spark, os.path.join(out, "t"), os.path.join(out, "c")))
    assert {r.path: r.commits for r in compact.collect()} == got and compact.count() == len(got)


def test_analysis_store(spark):
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)))
    root = tempfile.mkdtemp(prefix="store-", dir="/tmp")
    src.save_analysis({"imports": a["imports"], "file_facts": a["file_facts"]}, root)
    back = src.load_analysis(spark, root, ["imports", "file_facts"], repo_id="app")
    assert back["imports"].count() == 6 and back["file_facts"].count() == 7


def test_goal_goldens_on_app(spark):
    from archspark.operators import intent
    from archspark.plans.analysis import answer_goals
    from archspark.sources import dims
    goals = spark.createDataFrame([("g1", "Add JWT authentication to protect routes"),
                                   ("g2", "Add JWT authentication to the login flow"),
                                   ("g3", "Improve database query performance in user lookups")],
                                  "goal_id string, goal string")
    summ = {r.goal_id: (r.n_concepts, r.direct_hits, r.confidence_pct)
            for r in intent.goal_summary(goals, dims.concepts(spark), dims.stop_words(spark)).collect()}
    assert summ["g1"] == (11, 3, 94)
    assert summ["g2"][1:] == (4, 98)
    assert summ["g3"][1:] == (1, 78)
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)))
    out = answer_goals(spark, a, goals.where("goal_id = 'g1'"))
    top = sorted((r.rank, r.path, r.score) for r in out["candidates"].collect())
    assert top[0] == (1, "auth.py", 53) and top[1] == (2, "api/routes.py", 47)
    ctx = out["agent_context"].collect()[0]
    assert ctx.status == "available" and ctx.target == "auth.py" and ctx.complexity == "Medium"
    assert ctx.n_companions == 4 and ctx.n_routes == 3


def test_reports_on_app(spark):
    from archspark.operators import facts as fx
    from archspark.plans import reports
    from archspark.sources import dims
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)))
    ev = {r.evidence_type: (r.status, r.coverage_pct) for r in fx.evidence_records(a["coverage"]).collect()}
    assert ev == {"ast": ("available", 100), "dependency": ("available", 100), "git": ("available", 86),
                  "route": ("available", 100)}
    brief = a["brief"].collect()[0]
    assert brief.project_type == "Python" and brief.n_files == 7 and brief.n_risks == 2
    rv = reports.review(a["files"], a["profile"], a["coverage"], a["risks"], a["dependencies"], dims.advice(spark))
    sections = {}
    for r in rv.collect():
        sections.setdefault(r.section, []).append((r.item, r.value))
    assert ("main.py", None) in sections["entry_points"]
    assert sorted(sections["layers"]) == [("api", "1"), ("models", "1"), ("services", "1")]
    assert [v for _, v in sorted(sections["risks"], key=lambda x: x[1])] == ["auth.py", "database.py"]
    assert ("Modular Design", None) not in sections.get("strengths", [])       # 7 files, not more than 10
    assert ("Explicit Entrypoints", None) in sections["strengths"]


def test_directory_loader_keeps_underscore_files(spark):
    root = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    os.makedirs(os.path.join(root, "pkg"))
    os.makedirs(os.path.join(root, "node_modules", "dep"))
    for rel, text in [("pkg/__init__.py", ""), ("pkg/_x.py", "import os\n"), ("main.py", "import pkg\n"),
                      ("node_modules/dep/index.js", "x"), ("bad.py", "\\xff")]:
        with open(os.path.join(root, rel), "w") as fh:
            fh.write(text)
    corpus = src.load_directories(spark, {"r": root}, partitions=4)
    paths = sorted(r.path for r in src.inventory(corpus).collect())
    assert paths == ["bad.py", "main.py", "pkg/__init__.py", "pkg/_x.py"]   # ignored dir pruned, '_' names kept


def test_ownership_on_app(spark):
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)))
    own = {r.path: (r.layer, r.related_files, r.entry_points, r.routes) for r in a["ownership"].collect()}
    assert own["auth.py"] == ("Authentication Layer", 1, 1, 3)       # routes.py shares the layer; main.py imports auth
    assert own["database.py"][0] == "Database Layer" and own["database.py"][2] == 1   # main.py imports database
    assert own["main.py"][0] == "Core Runtime Layer" and own["main.py"][2] == 1       # an entry point in its own layer


def test_read_commit_log_file_and_temporal_json(spark):
    d = tempfile.mkdtemp(prefix="log-", dir="/tmp")
    text = "commit:h2|ann\nauth.py\ndatabase.py\n\ncommit:h1|bob\nmain.py\n"
    with open(os.path.join(d, "log.txt"), "w") as fh:
        fh.write(text)
    cf = src.read_commit_log(spark, os.path.join(d, "log.txt"), "app")
    rows = sorted((r.commit_id, r.author, r.path) for r in cf.collect())
    assert rows == [("h1", "bob", "main.py"), ("h2", "ann", "auth.py"), ("h2", "ann", "database.py")]
    seq = {r.commit_id: r.seq for r in cf.collect()}
    assert seq["h2"] < seq["h1"]                      # file order: newer first, as the log prints
    tj = spark.createDataFrame([("app", '{"auth.py": {"database.py": 0.5}}')], "repo_id string, value string")
    assert [(r.a, r.b, r.ratio) for r in src.temporal_from_json(tj).collect()] == [("auth.py", "database.py", 0.5)]


def test_analyze_cli(spark):
    from importlib.util import module_from_spec, spec_from_file_location
    d = tempfile.mkdtemp(prefix="cli-", dir="/tmp")
    app = os.path.join(d, "app")
    os.makedirs(os.path.join(app, "api"))
    for rel, text in APP.items():
        os.makedirs(os.path.dirname(os.path.join(app, rel)), exist_ok=True)
        with open(os.path.join(app, rel), "w") as fh:
            fh.write(text)
    with open(os.path.join(d, "log.txt"), "w") as fh:
        fh.write("".join(f"commit:h{4 - i}|dev\n" + "\n".join(fs) + "\n\n" for i, fs in enumerate(reversed(COMMITS))))
    script = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "analyze.py")
    spec = spec_from_file_location("analyze_script", script)
    module = module_from_spec(spec)
    spec.loader.exec_module(module)
    module.main(["--repo", f"app={app}", "--log", f"app={d}/log.txt", "--goal", "Add JWT authentication to protect routes",
                 "--out", f"{d}/out"], spark)
    ctx = spark.read.parquet(f"{d}/out/agent_context").collect()
    assert ctx[0].target == "auth.py" and ctx[0].n_companions == 4


def test_log_header_without_author_and_line_ends(spark):
    df = spark.createDataFrame([("r", 0, "commit:aa\r\n a.py\r\nb\\c\\d.py \r\n\r\n"), ("r", 1, "bb|ann \r\nx.py"), ("r", 2, "cc|bob")],
                               "repo_id string, seq int, value string")
    rows = sorted((r.commit_id, r.author, r.path) for r in src.parse_commit_log(df).collect())
    assert rows == [("aa", None, "a.py"), ("aa", None, "b/c/d.py"), ("bb", "ann", "x.py")]
    assert sorted((r.commit_id, len(r.files)) for r in src.commit_records(df).collect()) == [("aa", 2), ("bb", 1), ("cc", 0)]


def test_several_log_files_keep_their_order_and_empty_commits_count(spark):
    d = tempfile.mkdtemp(prefix="logs-", dir="/tmp")
    for name, first in (("2024.log", 6), ("2025.log", 3)):  # sizes would put the second file first
        with open(os.path.join(d, name), "w") as fh:
            fh.write("".join(f"commit:h{i}\n" + ("" if i % 2 else f"f{i}.py\n") + "x" * (0 if i > 3 else 0) for i in range(first, first - 3, -1)))
    log = src.read_log_records(spark, d, "r")
    records = src.commit_records(log)
    assert [r.commit_id for r in records.orderBy("seq").collect()] == ["h6", "h5", "h4", "h3", "h2", "h1"]
    corpus = spark.createDataFrame([("r", "f6.py", 1, b"")], src.CORPUS_SCHEMA)
    a = build_analysis(spark, corpus, src.parse_commit_log(log), latest_n=4, commits=records.select("repo_id", "commit_id", "seq"))
    assert sorted(r.path for r in a["file_history"].collect()) == ["f4.py", "f6.py"]  # h6 h5 h4 h3, two of them empty
    everything = build_analysis(spark, corpus, src.parse_commit_log(log))
    assert everything["file_history"].count() == 3


def test_normalise_single_back_slashes(spark):
    from archspark.functions.paths import path_parts
    r = path_parts(spark.createDataFrame([("a\\b\\test_c.py",)], "path string")).first()
    assert (r.path, r.basename, r.first_segment, r.is_test) == ("a/b/test_c.py", "test_c.py", "a", True)


def test_store_parses_each_source_once(spark, monkeypatch):
    from archspark.operators import extract
    counter = spark.sparkContext.accumulator(0)
    batches = extract._syntax_batches

    def counting(it):
        for pdf in batches(it):
            counter.add(len(pdf))
            yield pdf

    monkeypatch.setattr(extract, "_syntax_batches", counting)
    a = build_analysis(spark, _corpus(spark), src.parse_commit_log(_log(spark)), store=tempfile.mkdtemp(prefix="kept-", dir="/tmp"))
    for name in ("file_facts", "coverage", "risks", "change_impact", "companions"):
        a[name].collect()
    assert counter.value == sum(p.endswith(".py") for p in APP)


def test_broken_manifests_are_rows(spark):
    from archspark.sources import manifests
    rows = [("r", "a", '{"dependencies": {"x": "1", "y": {"z": [1]}, "n": null}, "devDependencies": null}'), ("r", "b", None), ("r", "c", "{"),
            ("r", "d", '"text"'), ("r", "e", '{"devDependencies": 5}'), ("r", "f", "{}"), ("r", "g", '{"dependencies": {}}'),
            ("r", "h", '{"dependencies": {"x": "1"}, "dependencies": {"y": "2"}}')]
    got = manifests.package_manifests(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()
    assert sorted((r.path, r.section, r.dep, r.version, r.reason) for r in got if r.path in "bcdefh") == [
        ("b", None, None, None, "empty"), ("c", None, None, None, "malformed JSON"), ("d", None, None, None, "not an object"),
        ("e", "devDependencies", None, None, "devDependencies is not an object"), ("h", None, None, None, "malformed JSON")]
    assert {r.dep: r.version for r in got if r.path == "a"} == {"n": None, "x": "1", "y": '{"z":[1]}'}
    assert not [r for r in got if r.path == "f"]


def test_facts_of_a_huge_file_take_linear_time(spark):
    import time

    from archspark.operators import extract
    text = "".join(f"class C{i}(Base):\n    x = Column(1)\n    def a(self): pass\n    async def b(self): pass\n" for i in range(10_000))
    df = spark.createDataFrame([("r", "a.py", text.encode()), ("r", "b.py", b"def (")], "repo_id string, path string, content binary")
    start = time.time()
    facts = {r.path: r for r in extract.code_facts(df).collect()}
    assert len(facts["a.py"].classes) == 10_000 and {tuple(c.methods) for c in facts["a.py"].classes} == {("a",)} and not facts["b.py"].parsed
    rows = extract.fact_rows(df).groupBy("path", "kind").count().collect()
    assert {(r.path, r.kind): r["count"] for r in rows} == {("a.py", "class"): 10_000, ("a.py", "model"): 10_000}
    assert time.time() - start < 60
