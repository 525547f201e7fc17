"""Steps that grew faster than their input: what they broadcast, keep and compare, on rows of their own."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from archspark.operators import companions, facts, history, intent, joins
from archspark.plans import bindings, queries
from archspark.plans.code_corpus import Code
from archspark.sources.tables import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gram_join_broadcasts_nothing(spark):
    needles = spark.createDataFrame([("r", n) for n in ("alpha", "be", "gamma", "zeta")], "k string, n string")
    texts = spark.createDataFrame([("r", "xalphax"), ("r", "maybe"), ("r", "gam ma"), ("r", None), ("s", "zeta")], "k string, t string")
    found = joins.gram_join(needles, "n", texts, "t", ["k"])
    assert "Broadcast" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("r", "alpha", "xalphax"), ("r", "be", "maybe")]


def test_file_facts_do_not_broadcast_the_facts(spark):
    inventory = spark.createDataFrame([("r", "a.py", ".py", 3)], "repo_id string, path string, extension string, size long")
    found = "array<struct<name:string,methods:array<string>>>"
    parsed = spark.createDataFrame([("r", "a.py", [("C", ["m"])], [("f", [])], [])],
                                   f"repo_id string, path string, classes {found}, functions {found}, endpoints {found}")
    ff = facts.file_facts(inventory, parsed, None)
    assert "Broadcast" not in _plan(ff)
    assert ff.first()["function_count"] == 2


def test_long_dictionary_meets_texts_on_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_NEEDLES", 1)
    monkeypatch.setattr(joins, "MAX_PATTERN_CHARS", 3)
    texts = spark.createDataFrame([(1, "copy the file"), (2, "copy the file"), (3, "no"), (4, None), (5, "")], "id int, t string")
    needles = spark.createDataFrame([("py", 1), ("py", 2), ("the file", 3), ("o", 4), ("", 5), ("files", 6), (None, 7)], "n string, ord int")
    got = joins.contains_join(texts, "t", needles, "n")
    assert "substring(_txt" not in got._jdf.queryExecution().analyzed().toString()
    want = [(i, o) for i in (1, 2) for o in (1, 2, 3, 4)] + [(3, 4)]
    assert sorted(map(tuple, got.select("id", "ord").collect())) == sorted(want)


def test_cascade_meets_one_file_a_part(spark, monkeypatch):
    sizes = []

    def counted(texts, text_col, needles, needle_col, **how):
        found = joins.contains_join(texts, text_col, needles, needle_col, **how)
        if needle_col == "part":
            sizes.append(found.count())
        return found

    monkeypatch.setattr(intent, "contains_join", counted)
    prompts = spark.createDataFrame([("p1", "r", "copy it"), ("p2", "r", "nothing")], "prompt_id string, repo_id string, prompt string")
    files = spark.createDataFrame([("r", f"f{i:03}.py") for i in range(200)], "repo_id string, path string")
    words = spark.createDataFrame([("login", 0, "auth.py")], "keyword string, ord int, filename string")
    keys = spark.createDataFrame([("main", 0)], "dkey string, ord int")
    got = {r["prompt_id"]: (r["target"], r["tier"]) for r in intent.prompt_file_cascade(prompts, files, words, keys).collect()}
    assert got == {"p1": ("f000.py", 2), "p2": ("f000.py", 4)}
    assert sizes == [1]  # not every file that ends with .py


def test_inventory_is_kept_in_few_partitions(spark, tmp_path):
    rows = spark.range(1, 20_001, 1, 1).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"), F.lit("ivory bolt").alias("p_name"),
                                               F.lit("PROMO").alias("p_type"), F.lit(1).alias("p_size"))
    rows.write.parquet(str(tmp_path / "part.parquet"))
    kept = Code(Tables(spark, str(tmp_path))).inventory
    assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert kept.count() == 18_002  # every tenth is in an ignored folder; two modules


def test_supplier_pairs_are_counted_once(spark, tmp_path):
    rows = [(o, (o * o + j * (o % 7 + 1)) % 11 + 1) for o in range(60) for j in range(1 + o % 4)]
    rows += [(o, s) for o in range(60, 75) for s in (1, 2)] + [(3, None), (3, 1), (3, 1)]
    spark.createDataFrame([(o, f"p{o % 2}", "2020-01-01", 1) for o in range(75)], "o_orderkey long, o_orderpriority string, o_orderdate string, o_custkey long"
                          ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    joint, total = Counter(), Counter()
    for o in range(75):
        mine = {s for x, s in rows if x == o and s is not None}
        total.update((f"p{o % 2}", s) for s in mine)
        joint.update((f"p{o % 2}", a, b) for a, b in permutations(mine, 2))
    ratios = history.cochange_ratios(bindings.supplier_commits(t))
    assert sorted(map(tuple, ratios.collect())) == sorted(
        (k, a, b, n, total[k, a], (200 * n + total[k, a]) // (2 * total[k, a])) for (k, a, b), n in joint.items())
    want = set()
    for k, a in total:
        found = {b: n for (r, x, b), n in joint.items() if (r, x) == (k, a)}
        c, s = len(found), sum(found.values())
        want |= {(k, a, b) for b, n in found.items() if n * c > s and (n * c - s) ** 2 > 4 * s * c}
    edges = bindings.supplier_edges(t)
    assert want and {tuple(r) for r in edges.collect()} == want
    counted = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("flatten(")
    assert counted(edges) == counted(ratios) > 0
    assert counted(queries.impact_lists(spark, str(tmp_path))) == counted(queries.blast_radius_two_hops(spark, str(tmp_path))) == 0


def test_layer_heads_are_cut_before_a_layer_meets_in_one_task(spark):
    rows = [("r", f"f{i:03}.py", f"L{i % 3}", i % 7 == 0, 3 * (i * i % 41), 3 * (i * i % 41) + 60) for i in range(200)]
    rows += [("s", "a.py", None, None, 0, 0), ("s", "b.py", None, True, 0, 0)]
    f = spark.createDataFrame(rows, "repo_id string, path string, layer string, special boolean, b3_0 int, b3_1 int").repartition(4)
    heads = intent.layer_heads(f, 4)
    assert _plan(heads).count("WindowGroupLimit") == 8  # each of four variants, before and after the shuffle
    want = set()
    for at in (4, 5):
        for u in (0, 66):
            points = lambda x: min(max((x[at] + (u if x[3] else 0)) // 3, 5), 100)  # noqa: E731, B023
            for g in {(x[0], x[2]) for x in rows}:
                want |= {(x[0], x[1], x[2]) for x in sorted((x for x in rows if (x[0], x[2]) == g), key=lambda x: (-points(x), x[1]))[:4]}
    found = list(map(tuple, heads.collect()))
    assert len(found) == len(want) and set(found) == want


def _supplier_tables(spark, folder):
    rows = [(o, 1 + (o * o + j * (o % 7 + 1)) % 13, 1 + (o * 3 + j) % 9) for o in range(80) for j in range(1 + o % 5)]
    rows += [(o, s, 2) for o in range(80, 95) for s in (1, 2)] + [(3, None, 1), (3, 1, 4), (3, 1, 4)]
    spark.createDataFrame([(o, f"p{o % 2}", "2020-01-01", 1) for o in range(95)], "o_orderkey long, o_orderpriority string, o_orderdate string, o_custkey long"
                          ).write.parquet(str(folder / "orders.parquet"))
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(folder / "lineitem.parquet"))
    spark.createDataFrame([(s, s % 3) for s in range(1, 14)], "s_suppkey long, s_nationkey int").write.parquet(str(folder / "supplier.parquet"))
    spark.createDataFrame([(p, f"T{p % 4}") for p in range(1, 10)], "p_partkey long, p_type string").write.parquet(str(folder / "part.parquet"))
    return str(folder)


def _first_branch(plan: str, node: str) -> list[str]:
    """The first lines of each operator below ``node``, down its first branch."""
    lines = [x.rstrip() for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if node in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out, last = [], depth(lines[at])
    for x in lines[at + 1:]:
        if depth(x) <= last:
            break
        out.append(x.lstrip(" :+-"))
        last = depth(x)
    return out


def test_cochange_rows_are_not_shuffled_before_most_are_dropped(spark, tmp_path):
    plan = _plan(queries.companion_files(spark, _supplier_tables(spark, tmp_path)))
    below = _first_branch(plan, "Window [nth_value")
    first = next(i for i, x in enumerate(below) if x.startswith("Exchange"))
    assert "REPARTITION_BY_NUM" in below[first] and any(x.startswith("Union") for x in below[:first])
    assert any(x.startswith("Generate explode") for x in below[:first])  # the pairs arise after their only shuffle


def test_supplier_queries_agree_with_pairs_of_plain_ratios(spark, tmp_path):
    d = _supplier_tables(spark, tmp_path)
    t = Tables(spark, d)
    ratios = history.cochange_ratios(bindings.supplier_commits(t))
    files = bindings.supplier_files(t)
    want = companions.companions(files, bindings.supplier_edges(t, ratios), bindings.supplier_models(t), bindings.supplier_routes(t), ratios).collect()
    assert want and sorted(queries.companion_files(spark, d).collect()) == sorted(want)


def test_impact_graph_sends_names_for_what_is_left_only(spark, tmp_path):
    plan = _plan(queries.impact_graph(spark, _supplier_tables(spark, tmp_path)))
    below = _first_branch(plan, "Window [row_number() windowspecdefinition(repo_id")
    sent = [x for x in below if x.startswith(("Exchange", "Window [nth_value", "SortMergeJoin"))]
    assert [x.split()[0] for x in sent] == ["SortMergeJoin", "Exchange", "SortMergeJoin", "Exchange", "SortMergeJoin", "Window", "Exchange"]
    short = below[below.index(sent[3]) + 1]  # what goes to the other end before names are compared
    assert "need#" in short and "ms#" not in short and "rs#" not in short


def test_impact_nodes_take_their_files_from_the_stored_commits(spark, tmp_path):
    d = _supplier_tables(spark, tmp_path)
    found = queries.impact_nodes(spark, d)
    assert "lineitem" not in _plan(found)
    want = {tuple(r) for r in bindings.supplier_files(Tables(spark, d)).collect()}
    assert {(r.repo_id, r.target) for r in found.where("kind = 'center'").collect()} == want and ("p1", None) in want


def test_simulated_impact_takes_its_files_from_the_stored_commits(spark, tmp_path):
    d = _supplier_tables(spark, tmp_path)
    found = queries.simulated_impact(spark, d)
    assert "lineitem" not in _plan(found)
    assert {(r.repo_id, r.target) for r in found.collect()} == {tuple(r) for r in bindings.supplier_files(Tables(spark, d)).collect()}
