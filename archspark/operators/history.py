"""Commit history: windows, frequencies, authors and co-change.

Input shape (``commit_files``): one row per (repo, commit, file), columns named by
arguments. A commit is a *set* of files, so rows are de-duplicated first.

Scale notes
-----------
* E1/E2 are single aggregations with a distinct inside; Spark plans them with one
  shuffle on the grouping key after a map-side partial aggregate.
* D8 (pairs within a commit) is quadratic in the commit size by definition. The files of a
  giant commit are dealt into blocks of about ``block_files``; each pair of blocks is one row with two
  bounded arrays, whose pairs are generated in place. An ordinary commit is a single row, a giant
  one spreads over many tasks. Nothing is dropped or capped; where thresholds follow (C12), pairs of
  giant commits that cannot reach them are not generated.
* Pairs are generated once (``a < b``), counted with a partial aggregate, and
  mirrored afterwards (G5), which halves the shuffled pair volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import scores, vocab
from archspark.functions.paths import is_code_file
from archspark.operators.frames import fresh as _fresh


def latest_commits(commits: DataFrame, n: int | None = vocab.LATEST_COMMITS, key: str = "repo_id",
                   commit: str = "commit_id", ts: str = "commit_ts") -> DataFrame:
    """the latest ``n`` commits per repository (ties by commit id, descending).

    ``row_number() <= n`` is planned as a partial ``WindowGroupLimit`` before the
    shuffle, so at most ``n`` rows per repository and input partition move.
    """
    c = commits.select(key, commit, ts)
    if n is None:
        return c.withColumn("rank", F.lit(None).cast("int"))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(commit).desc())
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def restrict_to_window(commit_files: DataFrame, window: DataFrame, key: str = "repo_id",
                       commit: str = "commit_id") -> DataFrame:
    """Keep the files of windowed commits (left semi join; the window is at most n rows per repo)."""
    return commit_files.join(window.select(key, commit), [key, commit], "left_semi")


def commit_frequency(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id",
                     path: str = "path", code_only: bool = False) -> DataFrame:
    """Number of distinct commits per file -> (key, path, commits)."""
    cf = commit_files.select(key, commit, path)
    if code_only:
        cf = cf.where(is_code_file(path))
    return cf.groupBy(key, path).agg(F.countDistinct(commit).alias("commits"))


def author_count(commit_files: DataFrame, key: str = "repo_id", path: str = "path",
                 author: str = "author") -> DataFrame:
    """Distinct non-empty authors per file -> (key, path, authors)."""
    a = F.col(author)
    a = F.nullif(a, F.lit("")) if dict(commit_files.dtypes)[author] == "string" else a
    return commit_files.groupBy(key, path).agg(F.countDistinct(a).alias("authors"))


def file_history(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id",
                 path: str = "path", author: str = "author") -> DataFrame:
    """E1 + E2 + C11 in one aggregation -> (key, path, commits, authors, density)."""
    a = F.col(author)
    a = F.nullif(a, F.lit("")) if dict(commit_files.dtypes)[author] == "string" else a
    return (commit_files.groupBy(key, path)
            .agg(F.countDistinct(commit).alias("commits"), F.countDistinct(a).alias("authors"))
            .withColumn("density", scores.density_bucket("commits")))


def _commit_table(commit_files: DataFrame, key: str, commit: str, path: str, code_only: bool) -> DataFrame:
    cf = commit_files.select(key, commit, path)
    return cf.where(is_code_file(path)) if code_only else cf


def _blocks(commit_files: DataFrame, key: str, commit: str, path: str, code_only: bool, block_files: int,
            thresholds: tuple[int, int] | None = None) -> DataFrame:
    """One row for each pair of blocks (i <= j) of a commit, with the files of both as bounded arrays.

    A commit of at most ``block_files`` rows is one block. The others (found by a partially aggregated
    count, so no commit meets in one task) deal their files into blocks by a hash, and each pair of blocks is
    a row of its own: a giant commit spreads over many tasks. The arrays are sets, so repeated rows count once.

    With ``thresholds`` (least support, percentage to exceed), giant commits are pruned by count: a file below the
    support (rare) has one chance only, as the other end of a file with so few commits that the joint ones exceed
    the percentage (lifted). Rare files meet blocks of lifted files (``kind`` rare) and nothing else: a first
    commit that adds a million files, most of them never touched again, costs what its few living files cost.
    """
    cf = _commit_table(commit_files, key, commit, path, code_only)
    n_blocks = lambda n: F.ceil(n / F.lit(block_files)).cast("int")
    giants = cf.groupBy(key, commit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_files)
    own = cf.join(_fresh(giants), [key, commit], "left")
    dealt = lambda k: F.pmod(F.xxhash64(path), k).cast("int")
    row = lambda kind, i, j, left: F.struct(F.lit(kind).alias("_kind"), i.alias("_i"), j.alias("_j"), left.alias("_left"))
    zero, yes = F.lit(0), F.lit(True)
    plain = own.where("_n IS NULL").select(key, commit, path, F.array(row("all", zero, zero, yes)).alias("_to"))
    big = own.where("_n IS NOT NULL")

    def meets(k):
        """The block pairs of a file among the ``k`` blocks of its commit."""
        mine = dealt(k)
        return F.transform(F.sequence(zero, k - 1), lambda o: row("all", F.least(mine, o), F.greatest(mine, o), mine <= o))

    if thresholds is None:
        spread = big.select(key, commit, path, meets(n_blocks(F.col("_n"))).alias("_to"))
    else:
        support, percent = thresholds
        chance = max(support - 1, 0)  # joint commits of a rare file at most; the most commits of which they exceed the percentage
        once = max((t for t in range(1, 200 * chance + 1) if (200 * chance + t) // (2 * t) > percent), default=0)
        totals = _fresh(cf.groupBy(key, path).agg(F.countDistinct(commit).alias("_t")))
        big = big.join(totals, [key, path]).select(key, commit, path, (F.col("_t") < support).alias("_rare"),
                                                   F.col("_t").between(support, once).alias("_lifted"))
        counts = _fresh(big).groupBy(key, commit).agg(
            n_blocks(F.count_if(~F.col("_rare"))).alias("_ka"), n_blocks(F.count_if("_lifted")).alias("_kl"), n_blocks(F.count_if("_rare")).alias("_kr"))
        none = F.array().cast("array<struct<_kind:string,_i:int,_j:int,_left:boolean>>")
        upto = lambda k: F.when(k > 0, F.sequence(zero, k - 1)).otherwise(F.array().cast("array<int>"))
        ka, kl, kr = F.col("_ka"), F.col("_kl"), F.col("_kr")
        lifted = F.transform(upto(kr), lambda o: row("rare", dealt(kl), o, yes))
        rare = F.transform(upto(kl), lambda o: row("rare", o, dealt(kr), F.lit(False)))
        spread = big.join(counts, [key, commit]).select(key, commit, path, F.when(F.col("_rare"), rare).otherwise(
            F.concat(meets(ka), F.when(F.col("_lifted"), lifted).otherwise(none))).alias("_to"))
    met = plain.unionByName(spread).select(key, commit, path, F.explode("_to").alias("_to")).select(key, commit, path, "_to.*")
    return (met.groupBy(key, commit, "_kind", "_i", "_j")
            .agg(F.array_sort(F.collect_set(F.when(F.col("_left"), F.col(path)))).alias("_x"),
                 F.array_sort(F.collect_set(F.when(~F.col("_left"), F.col(path)))).alias("_y")))


def _block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a < b) generated in place: within a block, or across two blocks (JVM-side, no join)."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    within = F.transform("_x", lambda a, i: F.transform(F.slice("_x", i + 2, F.size("_x")), lambda b: pair(a, b)))
    across = F.transform("_x", lambda a: F.transform("_y", lambda b: pair(a, b)))
    pairs = F.flatten(F.when((F.col("_kind") == "all") & (F.col("_i") == F.col("_j")), within).otherwise(across))
    return rows.select(key, F.explode(pairs).alias("_p")).select(key, "_p.a", "_p.b")


def commit_blocks(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id", path: str = "path", block_files: int = 256) -> DataFrame:
    """The rows of ``_blocks`` for a table that several readers share: (key, _i, _j, _x, _y, _none).

    The files of a commit are counted where they lie, not by a join with a second reading, so the commit table is shuffled
    once. ``_none`` tells whether a commit holds a row without a path.
    """
    n = F.count(path).over(Window.partitionBy(key, commit))
    own = (commit_files.select(key, commit, path, F.greatest(F.ceil(n / F.lit(block_files)), F.lit(1)).cast("int").alias("_k"))
           .withColumn("_at", F.pmod(F.xxhash64(path), F.col("_k")).cast("int")))
    row = lambda o: F.struct(F.least("_at", o).alias("_i"), F.greatest("_at", o).alias("_j"), (F.col("_at") <= o).alias("_left"))
    met = own.select(key, commit, path, F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), row)).alias("_to")).select(key, commit, path, "_to.*")
    return (met.groupBy(key, commit, "_i", "_j")
            .agg(F.array_sort(F.collect_set(F.when(F.col("_left"), F.col(path)))).alias("_x"),
                 F.array_sort(F.collect_set(F.when(~F.col("_left"), F.col(path)))).alias("_y"), F.bool_or(F.col(path).isNull()).alias("_none"))
            .drop(commit))


def _absent(blocks: DataFrame):
    """An array with one null, of the type of the block's files."""
    return F.array(F.lit(None).cast(blocks.schema["_x"].dataType.elementType))


def blocks_files(blocks: DataFrame, key: str = "repo_id") -> DataFrame:
    """Distinct (key, path) of ``commit_blocks``; path is null for rows without one."""
    return blocks.select(key, F.explode(F.when(F.col("_none"), F.concat("_x", "_y", _absent(blocks))).otherwise(F.concat("_x", "_y"))).alias("path")).distinct()


def dealt_ratios(blocks: DataFrame, parts: int, key: str = "repo_id") -> DataFrame:
    """``cochange_ratios`` of ``commit_blocks``, all rows of a file in one of ``parts`` partitions, by (key, a).

    What is shuffled is not each pair but a row for each file of a commit, with the others as one array; the pairs
    arise where they are counted. The row of a file in its own block ends with a null: the count of these is its number of commits.
    """
    star = lambda a, others, own: F.struct(a.alias("a"), others.alias("_to"), F.lit(own).alias("_own"))
    within = F.transform("_x", lambda a: star(a, F.array_remove("_x", a), True))
    across = F.concat(F.transform("_x", lambda a: star(a, F.col("_y"), False)), F.transform("_y", lambda b: star(b, F.col("_x"), False)))
    stars = blocks.select(key, F.explode(F.when(F.col("_i") == F.col("_j"), within).otherwise(across)).alias("_s")).select(key, "_s.*").repartition(parts, key, "a")
    met = stars.select(key, "a", F.explode(F.when(F.col("_own"), F.concat("_to", _absent(blocks))).otherwise(F.col("_to"))).alias("b"))
    total = F.max(F.when(F.col("b").isNull(), F.col("joint"))).over(Window.partitionBy(key, "a")).alias("total_a")
    return (met.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("joint")).select(key, "a", "b", "joint", total).where("b IS NOT NULL")
            .withColumn("pct", scores.pct("joint", "total_a")))


def cooccurrence(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id",
                 path: str = "path", code_only: bool = False, block_files: int = 256) -> DataFrame:
    """Joint commit count of each unordered file pair -> (key, a, b, joint) with a < b.

    Exact for every commit size; nothing is dropped.
    """
    rows = _blocks(commit_files, key, commit, path, code_only, block_files)
    return _block_pairs(rows, key).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("joint"))


def cochange_ratios(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id",
                    path: str = "path", code_only: bool = False, block_files: int = 256,
                    thresholds: tuple[int, int] | None = None) -> DataFrame:
    """E3 + G5: directional ratio joint(a,b)/commits(a) for every co-changed pair.

    The blocks are built for the pairs only; the commits of a file come from the commit table itself. With
    ``thresholds`` only the rows that reach them are sure to be there, with right numbers (``_blocks``).
    -> (key, a, b, joint, total_a, pct) with ``pct`` the half-up integer percentage.
    """
    rows = _blocks(commit_files, key, commit, path, code_only, block_files, thresholds)
    joint = _block_pairs(rows, key).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("joint"))
    both = joint.unionByName(joint.select(key, F.col("b").alias("a"), F.col("a").alias("b"), "joint"))
    # counted from the commit table, not from the blocks, which would have to be built a second time
    files = _commit_table(commit_files, key, commit, path, code_only).distinct()
    freq = _fresh(files).groupBy(key, F.col(path).alias("a")).agg(F.count(F.lit(1)).alias("total_a"))
    return (both.join(freq, [key, "a"])
            .withColumn("pct", scores.pct("joint", "total_a"))
            .select(key, "a", "b", "joint", "total_a", "pct"))


def cochange_of(commit_files: DataFrame, targets: DataFrame, key: str = "repo_id", commit: str = "commit_id", path: str = "path") -> DataFrame:
    """The rows of ``cochange_ratios`` whose ``a`` is a target (key, path): pairs of other files are never formed.

    Only the targets' own commits are met again with the commit table, so the work follows what the targets touched.
    """
    cf = commit_files.select(key, commit, path).distinct()
    mine = cf.join(_fresh(targets.select(key, path).distinct()), [key, path], "left_semi").select(key, commit, F.col(path).alias("a"))
    joint = (mine.join(_fresh(cf).select(key, commit, F.col(path).alias("b")), [key, commit]).where("a <> b")
             .groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("joint")))
    total = _fresh(mine).groupBy(key, "a").agg(F.count(F.lit(1)).alias("total_a"))
    return joint.join(total, [key, "a"]).withColumn("pct", scores.pct("joint", "total_a")).select(key, "a", "b", "joint", "total_a", "pct")


def reaches(min_support: int = vocab.MIN_COMMIT_SUPPORT, min_pct_exclusive: int = vocab.MIN_RATIO_PCT):
    """True for a ratio of a file with enough commits that exceeds the percentage."""
    return (F.col("total_a") >= min_support) & (F.col("pct") > min_pct_exclusive)


def thresholded(ratios: DataFrame, min_support: int = vocab.MIN_COMMIT_SUPPORT, min_pct_exclusive: int = vocab.MIN_RATIO_PCT) -> DataFrame:
    """The ratios of files with enough commits that exceed the percentage."""
    return ratios.where(reaches(min_support, min_pct_exclusive))


def temporal_matrix(commit_files: DataFrame, key: str = "repo_id", commit: str = "commit_id",
                    path: str = "path", code_only: bool = True,
                    min_support: int = vocab.MIN_COMMIT_SUPPORT,
                    min_pct_exclusive: int = vocab.MIN_RATIO_PCT, **pair_opts) -> DataFrame:
    """E4 + C12: code files only, support >= ``min_support``, rounded ratio > 10 %.

    A file with no surviving partner simply has no rows. Pairs of giant commits that cannot reach the
    thresholds are not generated. (A prefix filter, as set-similarity joins have it, would have to keep nine
    tenths of each file's commits at a ratio of 10 %, so counts decide alone.)
    """
    r = cochange_ratios(commit_files, key, commit, path, code_only, thresholds=(min_support, min_pct_exclusive), **pair_opts)
    return thresholded(r, min_support, min_pct_exclusive)


def windowed_history(commits: DataFrame, commit_files: DataFrame, n: int | None = vocab.LATEST_COMMITS,
                     key: str = "repo_id", commit: str = "commit_id", ts: str = "commit_ts") -> DataFrame:
    """F1 applied before everything else (also before the code-file filter)."""
    if n is None:
        return commit_files
    return restrict_to_window(commit_files, latest_commits(commits, n, key, commit, ts), key, commit)


