"""Components and longest chains of large graphs by contraction, so that rounds follow the logarithm of what is contracted.

Edges are long tables ``(key, src, dst)``; a key is a graph of its own. Three contractions shrink a graph
before anything is propagated along it:

* **mutual edges**: two nodes that point at each other are in one component; connected components over such pairs
  (star contraction) become one node each;
* **rake**: a node without an edge in or without one out is on no cycle and goes;
* **compress**: a run of nodes with one edge in and one out becomes one edge by pointer jumping, which takes as many
  rounds as the logarithm of its length.

What is left is split by forward and backward reachability from many pivots at once: every node takes the
least pivot that reaches it and the least it reaches, in an order drawn anew each time. Nodes whose two pivots are
the same one form its component; edges between nodes of different pairs lead from one component to another and go.

State is checkpointed once a round; nothing but counts reaches the driver. A graph of at most ``small`` edges, counted,
is finished in one task instead, all such graphs side by side: most repositories are small from the start, and
the others as soon as contraction has brought them under the bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators.frames import fresh as _fresh
from archspark.session import cut_lineage, cut_round


#: edges of a graph that one task may finish (about 100 MB in the worker)
SMALL = 500_000


def _sizes(e: DataFrame, key: str, small: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges of the graphs of at most ``small`` edges and of the larger ones; None for no edges."""
    n = e.groupBy(key).agg(F.count("*").alias("__n"))
    kinds = n.agg(F.count_if(F.col("__n") <= small).alias("few"), F.count_if(F.col("__n") > small).alias("many")).first()
    if not kinds["few"] or not kinds["many"]:
        return (e if kinds["few"] else None), (e if kinds["many"] else None)
    few = _fresh(n.where(F.col("__n") <= small).select(key))
    return e.join(few, key, "left_semi"), cut_lineage(e.join(few, key, "left_anti"))


def _tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """Component number of each of n nodes; a component's number is greater than those it points to."""
    order = np.argsort(src, kind="stable")
    heads, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    number, low, comp, stack, at, count, groups = [0] * n, [0] * n, [-1] * n, [], first[:n], 0, 0
    for root in range(n):
        if number[root]:
            continue
        todo = [root]
        while todo:
            v = todo[-1]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                stack.append(v)
            if at[v] < first[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not number[w]:
                    todo.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            todo.pop()
            if todo:
                low[todo[-1]] = min(low[todo[-1]], low[v])
            if low[v] == number[v]:
                while True:
                    w = stack.pop()
                    comp[w] = groups
                    if w == v:
                        break
                groups += 1
    return comp


def _numbered(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, src, dst): nodes as numbers in ascending order of their names."""
    names, codes = np.unique(pd.concat([edges["src"], edges["dst"]]).to_numpy(), return_inverse=True)
    return names, codes[: len(edges)], codes[len(edges):]


def _in_tasks(e: DataFrame, key: str) -> DataFrame:
    """(key, node, rep) of all nodes of small graphs, each graph in one task."""
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        names, src, dst = _numbered(edges)
        comp = np.array(_tarjan(len(names), src, dst))
        least = np.full(comp.max() + 1, len(names))
        np.minimum.at(least, comp, np.arange(len(names)))
        return pd.DataFrame({key: edges[key].iloc[0], "node": names, "rep": names[least[comp]]})

    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    return e.select(key, "src", "dst").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, node {kinds['src']}, rep {kinds['src']}")


def _count(stats: dict | None, what: str) -> None:
    if stats is not None:
        stats[what] = stats.get(what, 0) + 1


def connected(pairs: DataFrame, key: str, stats: dict | None = None) -> DataFrame:
    """(key, node, rep) of every node of ``pairs`` (key, u, v), direction aside; rep is the smallest node reachable.

    Large and small stars in turn: every node's larger neighbours move to the smallest node it knows, then its
    smaller ones do. A round leaves at most as many edges as it found.
    """
    e = cut_lineage(pairs.where("u <> v").select(key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = mark(e)
    while now[0]:
        _count(stats, "rounds")
        both = e.select(key, "u", "v").unionAll(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key, "u").agg(F.min("v").alias("w")).select(key, "u", F.least("u", "w").alias("m"))
        large = (both.join(_fresh(least), [key, "u"]).where("v > u").select(key, F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        near = _fresh(large).join(least, [key, "u"])
        e = cut_round(near.select(key, F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionAll(least.select(key, "u", F.col("m").alias("v"))).where("u > v").distinct())
        was, now = now, mark(e)
        if was == now:
            break
    return e.select(key, F.col("u").alias("node"), F.col("v").alias("rep")).unionAll(
        e.select(key, F.col("v").alias("node"), F.col("v").alias("rep")).distinct())


def jump(steps: DataFrame, key: str, stats: dict | None = None) -> DataFrame:
    """Pointer jumping. ``steps`` (key, node, nxt): one successor for each node; a run ends at a node without a row.

    -> (key, node, nxt, tail, low, ring): the node after the run, the run's last node, its smallest node, and
    whether the run closes in a ring (nxt and tail then mean nothing).
    """
    on = [key, "node"]
    inside = steps.select(key, F.col("node").alias("nxt"), F.lit(True).alias("more"))
    now = cut_lineage(_fresh(steps).join(inside, [key, "nxt"], "left")
                      .select(key, "node", "nxt", F.col("node").alias("tail"), F.col("node").alias("low"), F.coalesce("more", F.lit(False)).alias("more"),
                              F.lit(False).alias("chg")))
    while not now.where("more").isEmpty():
        _count(stats, "rounds")
        ahead = now.select(key, F.col("node").alias("nxt"), F.col("nxt").alias("n2"), F.col("tail").alias("t2"), F.col("low").alias("l2"), F.col("more").alias("m2"))
        moved = _fresh(now.where("more")).join(ahead, [key, "nxt"])
        # a run's row changes until it is done, a ring's until all of the ring is seen
        moved = moved.select(*on, F.col("n2").alias("nxt"), F.col("t2").alias("tail"), F.least("low", "l2").alias("low"), F.col("m2").alias("more"),
                             (~F.col("m2") | (F.col("l2") < F.col("low"))).alias("chg"))
        now = cut_round(now.where("NOT more").withColumn("chg", F.lit(False)).unionByName(moved))
        if now.where("chg").isEmpty():
            break
    return now.select(*on, "nxt", "tail", "low", F.col("more").alias("ring"))


def _pivots(e: DataFrame, key: str, salt: int, stats: dict | None) -> DataFrame:
    """(key, node, f, b): the least pivot that reaches each node and the least it reaches, in a random order."""
    nodes = e.select(key, F.col("src").alias("node")).unionAll(e.select(key, F.col("dst").alias("node"))).distinct()
    own = F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), F.col("node").alias("node"))
    now = cut_lineage(nodes.select(key, "node", own.alias("f"), own.alias("b"), F.lit(True).alias("cf"), F.lit(True).alias("cb")))
    while True:
        changed = now.where("cf OR cb")
        if changed.isEmpty():
            return now.select(key, "node", "f", "b")
        _count(stats, "rounds")
        ahead = _fresh(now.where("cf").select(key, F.col("node").alias("src"), F.col("f").alias("p")))
        back = _fresh(now.where("cb").select(key, F.col("node").alias("dst"), F.col("b").alias("p")))
        none = F.lit(None).cast(now.schema["f"].dataType)
        sent = (e.join(ahead, [key, "src"]).select(key, F.col("dst").alias("node"), F.col("p").alias("pf"), none.alias("pb"))
                .unionAll(e.join(back, [key, "dst"]).select(key, F.col("src").alias("node"), none, "p"))
                .groupBy(key, "node").agg(F.min("pf").alias("pf"), F.min("pb").alias("pb")))
        now = cut_round(_fresh(now).join(sent, [key, "node"], "left").select(
            key, "node", F.least("f", "pf").alias("f"), F.least("b", "pb").alias("b"),
            F.coalesce(F.col("pf") < F.col("f"), F.lit(False)).alias("cf"), F.coalesce(F.col("pb") < F.col("b"), F.lit(False)).alias("cb")))


def _without(e: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends stay."""
    g = _fresh(gone.select(key, "node"))
    return (e.join(g.select(key, F.col("node").alias("src")), [key, "src"], "left_anti")
            .join(g.select(key, F.col("node").alias("dst")), [key, "dst"], "left_anti"))


def strongly_connected(edges: DataFrame, key: str = "repo_id", stats: dict | None = None, small: int = SMALL) -> DataFrame:
    """Strongly connected components of two or more nodes -> (key, node, component), component being the
    smallest node. Repeated edges and loops don't matter; an empty graph gives an empty result; a null
    key is a graph of its own. ``stats`` counts the rounds."""
    e = cut_lineage(edges.where("src <> dst").select(key, "src", "dst").distinct())
    first, undo, salt, fresh_pairs = e, [], 0, True

    def finish(e):
        """Small graphs are done; the edges of the others."""
        few, many = _sizes(e, key, small)
        if few is not None:
            undo.append(("done", cut_lineage(_in_tasks(few, key))))
        return many

    e = finish(e)
    if e is None:
        e = first.limit(0)

    def merge(reps):
        """Nodes become their representatives; edges within one go."""
        r = _fresh(reps.where("node <> rep"))
        undo.append(("rep", reps.where("node <> rep")))
        return cut_round(
            e.join(r.select(key, F.col("node").alias("src"), F.col("rep").alias("rs")), [key, "src"], "left")
            .join(_fresh(r).select(key, F.col("node").alias("dst"), F.col("rep").alias("rd")), [key, "dst"], "left")
            .select(key, F.coalesce("rs", "src").alias("src"), F.coalesce("rd", "dst").alias("dst")).where("src <> dst").distinct())

    while not e.isEmpty():
        if fresh_pairs:  # only new edges make new pairs
            back = _fresh(e).select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))
            mutual = cut_lineage(e.where("src < dst").join(back, [key, "src", "dst"], "left_semi"))
            fresh_pairs = not mutual.isEmpty()
            if fresh_pairs:
                e = merge(cut_lineage(connected(mutual.select(key, F.col("src").alias("u"), F.col("dst").alias("v")), key, stats)))
                if small and (e := finish(e)) is None:
                    break
                continue
        ends = (e.select(key, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("nxt"))
                .unionAll(e.select(key, F.col("dst").alias("node"), F.lit(0), F.lit(1), F.lit(None).cast(e.schema["dst"].dataType))))
        degree = cut_lineage(ends.groupBy(key, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("nxt").alias("nxt")))
        loose, runs = degree.where("o = 0 OR i = 0"), degree.where("o = 1 AND i = 1")
        n = degree.agg(F.count_if((F.col("o") == 0) | (F.col("i") == 0)).alias("loose"), F.count_if((F.col("o") == 1) & (F.col("i") == 1)).alias("runs")).first()
        if n["loose"] or n["runs"]:
            _count(stats, "rounds")
        if n["runs"]:
            run = jump(runs.select(key, "node", "nxt"), key, stats)
            rings = run.where("ring")
            # a run that is no ring stands for the edge from the node before it to the one after it
            inside = _fresh(run.where("NOT ring").select(key, "node", "nxt", "tail"))
            outer = e.join(_fresh(run.select(key, F.col("node").alias("src"))), [key, "src"], "left_anti")
            into = outer.join(inside.select(key, F.col("node").alias("dst"), F.col("nxt").alias("after"), "tail"), [key, "dst"])
            into = cut_lineage(into.select(key, F.col("src").alias("before"), "tail", "after"))
            member = inside.select(key, "node", "tail").join(_fresh(into), [key, "tail"]).select(key, "node", "before", "after")
            # a node before or after that goes in this round takes the run's nodes off every cycle as well
            undo.append(("between", cut_lineage(member)))
            undo.append(("done", cut_lineage(rings.select(key, "node", F.col("low").alias("rep")))))
            # before = after closes a cycle through that one node, which the loop then stands for
            kept = outer.join(_fresh(run.select(key, F.col("node").alias("dst"))), [key, "dst"], "left_anti").select(key, "src", "dst")
            kept = kept.unionAll(into.select(key, F.col("before").alias("src"), F.col("after").alias("dst"))).where("src <> dst").distinct()
            e, fresh_pairs = cut_round(_without(kept, loose, key)), True
            if small and (e := finish(e)) is None:
                break
        elif n["loose"]:
            e = cut_lineage(_without(e, loose, key))
        else:
            salt += 1
            found = _pivots(e, key, salt, stats)
            undo.append(("done", cut_lineage(found.where("f = b").select(key, "node", F.col("f.node").alias("rep")))))
            left = _fresh(found.where("f <> b").select(key, "node", "f", "b"))
            e = cut_round(e.join(left.select(key, F.col("node").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs")), [key, "src"])
                            .join(_fresh(left).select(key, F.col("node").alias("dst"), F.col("f").alias("fd"), F.col("b").alias("bd")), [key, "dst"])
                            .where("fs = fd AND bs = bd").select(key, "src", "dst"))
    # components of nodes that were put together, from the last contraction to the first
    comp = None
    for kind, rows in reversed(undo):
        if kind == "done":
            new = rows
        elif kind == "rep":
            # nodes without a row of their own are alone so far
            known = rows.select(key, F.col("node"), F.col("rep").alias("at"))
            new = (known if comp is None else known.join(_fresh(comp).select(key, F.col("node").alias("at"), F.col("rep")), [key, "at"], "left"))
            new = (known.select(key, "node", F.col("at").alias("rep")) if comp is None
                   else new.select(key, "node", F.coalesce("rep", "at").alias("rep")))
            alone = rows.select(key, F.col("rep").alias("node"), F.col("rep").alias("rep")).distinct()
            new = new.unionByName(alone if comp is None else alone.join(_fresh(comp.select(key, "node")), [key, "node"], "left_anti"))
        else:
            ends = rows
            if comp is None:
                new = ends.where("before = after").select(key, "node", F.col("before").alias("rep"))
            else:
                c = _fresh(comp)
                ends = (ends.join(c.select(key, F.col("node").alias("before"), F.col("rep").alias("cb")), [key, "before"], "left")
                        .join(_fresh(c).select(key, F.col("node").alias("after"), F.col("rep").alias("ca")), [key, "after"], "left"))
                new = (ends.where(F.coalesce("cb", "before") == F.coalesce("ca", "after"))
                       .select(key, "node", F.coalesce("cb", "before").alias("rep")))
            # the node before may have been alone until now
            heads = _fresh(new).join(rows.select(key, "node", "before"), [key, "node"]).where(F.col("rep") == F.col("before"))
            alone = heads.select(key, F.col("before").alias("node"), F.col("before").alias("rep")).distinct()
            new = new.unionByName(alone if comp is None else alone.join(_fresh(comp.select(key, "node")), [key, "node"], "left_anti"))
        comp = cut_round(new if comp is None else comp.unionByName(new))
    if comp is None:
        return first.select(key, F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    sizes = _fresh(comp).groupBy(key, "rep").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return comp.join(sizes, [key, "rep"]).select(key, "node", "component")


def _depths(key: str):
    """Of one small graph: nodes on the longest chain from each node, a component weighing its nodes."""
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        names, src, dst = _numbered(edges)
        comp = np.array(_tarjan(len(names), src, dst))
        weight = np.bincount(comp)
        a, b = comp[src], comp[dst]
        order = np.argsort(a, kind="stable")
        depth = weight.tolist()
        for x, y in zip(a[order].tolist(), b[order].tolist()):  # a component points to lower numbers only
            if x != y:
                depth[x] = max(depth[x], int(weight[x]) + depth[y])
        return pd.DataFrame({key: edges[key].iloc[0], "node": names, "depth": np.array(depth, np.int64)[comp]})
    return run


def chain_depths(edges: DataFrame, key: str = "repo_id", stats: dict | None = None, small: int = SMALL) -> DataFrame:
    """(key, node, depth) for every node of ``edges``: nodes on the longest chain from it, where a component
    weighs its node count."""
    e = cut_lineage(edges.select(key, "src", "dst").distinct())
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    few, many = _sizes(e, key, small)
    out = None
    if few is not None:
        out = few.groupBy(key).applyInPandas(_depths(key), f"{key} {kinds[key]}, node {kinds['src']}, depth long")
    if many is not None:
        nodes = many.select(key, F.col("src").alias("node")).unionAll(many.select(key, F.col("dst").alias("node"))).distinct()
        comps = strongly_connected(many, key, stats, small)
        of = cut_lineage(nodes.join(_fresh(comps), [key, "node"], "left").select(key, "node", F.coalesce("component", "node").alias("c")))
        weight = of.groupBy(key, F.col("c").alias("node")).agg(F.count(F.lit(1)).alias("w"))
        src = _fresh(of.select(key, F.col("node").alias("src"), F.col("c").alias("cs")))
        dst = _fresh(of.select(key, F.col("node").alias("dst"), F.col("c").alias("cd")))
        dag = many.join(src, [key, "src"]).join(dst, [key, "dst"]).where("cs <> cd").select(key, F.col("cs").alias("src"), F.col("cd").alias("dst"))
        depth = longest(dag, cut_lineage(weight), key, stats)
        deep = _fresh(of).join(_fresh(depth.select(key, F.col("node").alias("c"), "depth")), [key, "c"]).select(key, "node", "depth")
        out = deep if out is None else out.unionByName(deep)
    return out if out is not None else e.select(key, F.col("src").alias("node"), F.lit(1).cast("long").alias("depth")).limit(0)


def longest(edges: DataFrame, weights: DataFrame, key: str = "repo_id", stats: dict | None = None) -> DataFrame:
    """Weight of the heaviest chain from each node of an acyclic graph, its own weight included.

    ``edges`` (key, src, dst) without cycles, ``weights`` (key, node, w) for every node -> (key, node, depth).
    An edge holds what it makes of its end's depth d, max(c, w + d); such steps compose, so a run
    of nodes with one open edge each shrinks to one step by pointer jumping (compress), and edges to nodes whose
    depth is known become constants (rake). Both are done in every round.
    """
    base = _fresh(weights.select(key, F.col("node").alias("src"), F.col("w").cast("long").alias("w")))
    # open edges, and for each node that still has one the best constant so far
    e = cut_lineage(edges.select(key, "src", "dst").distinct().join(base, [key, "src"]).select(key, "src", "dst", "w", F.col("w").alias("c")))
    open_ = _fresh(e.select(key, F.col("src").alias("node")).distinct())
    known = cut_lineage(weights.select(key, "node", F.col("w").cast("long").alias("depth")).join(open_, [key, "node"], "left_anti"))
    undo = []
    while not e.isEmpty():
        _count(stats, "rounds")
        # rake: constants of nodes all of whose edges end in known depths
        now = e.join(_fresh(known).select(key, F.col("node").alias("dst"), "depth"), [key, "dst"], "left")
        now = now.select(key, "src", F.when(F.col("depth").isNull(), F.col("dst")).alias("dst"), "w",
                         F.when(F.col("depth").isNotNull(), F.greatest("c", F.col("w") + F.col("depth"))).otherwise(F.col("c")).alias("c"))
        # parallel edges are one: the greater constant and the greater weight
        now = now.groupBy(key, "src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c"))
        per = now.groupBy(key, "src").agg(F.count("dst").alias("n"), F.max("c").alias("best"), F.max("dst").alias("only"),
                                          F.max(F.when(F.col("dst").isNotNull(), F.col("w"))).alias("w"))
        per = cut_lineage(per)
        known = cut_round(known.unionByName(per.where("n = 0").select(key, F.col("src").alias("node"), F.col("best").alias("depth"))))
        rest = cut_round(now.where("dst IS NOT NULL").join(_fresh(per).select(key, "src", "best"), [key, "src"])
                           .select(key, "src", "dst", "w", F.col("best").alias("c")))
        # compress: runs of nodes with one open edge, composed by pointer jumping
        one = per.where("n = 1").select(key, F.col("src").alias("node"), F.col("only").alias("nxt"), "w", F.col("best").alias("c"))
        inside = _fresh(one).select(key, F.col("node").alias("nxt"), F.lit(True).alias("more"))
        run = cut_lineage(one.join(inside, [key, "nxt"], "left").select(key, "node", "nxt", "w", "c", F.coalesce("more", F.lit(False)).alias("more")))
        if run.where("more").isEmpty():
            e = rest
            continue
        while not run.where("more").isEmpty():
            _count(stats, "rounds")
            ahead = run.select(key, F.col("node").alias("nxt"), F.col("nxt").alias("n2"), F.col("w").alias("w2"), F.col("c").alias("c2"), F.col("more").alias("m2"))
            moved = _fresh(run.where("more")).join(ahead, [key, "nxt"]).select(
                key, "node", F.col("n2").alias("nxt"), (F.col("w") + F.col("w2")).alias("w"),
                F.greatest("c", F.col("w") + F.col("c2")).alias("c"), F.col("m2").alias("more"))
            run = cut_round(run.where("NOT more").unionByName(moved))
        undo.append(run)
        gone = _fresh(run).select(key, F.col("node").alias("dst"), F.col("nxt").alias("n2"), F.col("w").alias("w2"), F.col("c").alias("c2"))
        e = cut_round(rest.join(_fresh(run.select(key, F.col("node").alias("src"))), [key, "src"], "left_anti")
                        .join(gone, [key, "dst"], "left")
                        .select(key, "src", F.coalesce("n2", "dst").alias("dst"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
                                F.greatest("c", F.col("w") + F.col("c2")).alias("c"))
                        .groupBy(key, "src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c")))
    for run in reversed(undo):
        ends = run.join(_fresh(known).select(key, F.col("node").alias("nxt"), "depth"), [key, "nxt"])
        known = cut_round(known.unionByName(ends.select(key, "node", F.greatest("c", F.col("w") + F.col("depth")).alias("depth"))))
    return known
