"""Corpus sources and sinks.

The canonical corpus is a Parquet table ``(repo_id, path, size, content BINARY)``;
reading only ``(repo_id, path, size)`` prunes the content column at the scan.
"""

from __future__ import annotations

import os
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import extension, is_ignored, normalise

CORPUS_SCHEMA = "repo_id string, path string, size bigint, content binary"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2 canonical: a Parquet corpus (partitioned by repo_id for pruning)."""
    return spark.read.parquet(path)


def inventory(corpus: DataFrame, ignore: bool = True) -> DataFrame:
    """A1: (repo_id, path, size, extension) with slash-normalised paths; no content read."""
    inv = corpus.select("repo_id", normalise("path").alias("path"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    if ignore:
        inv = inv.where(~is_ignored("path"))
    return inv.withColumn("extension", extension("path"))


def _read_files(batches):
    for pdf in batches:
        contents, sizes = [], []
        for root, rel in zip(pdf["root"], pdf["path"]):
            full = os.path.join(root, rel)
            try:
                with open(full, "rb") as fh:
                    data = fh.read()
                contents.append(data)
                sizes.append(len(data))
            except OSError:
                contents.append(b"")
                sizes.append(0)
        yield pd.DataFrame({"repo_id": pdf["repo_id"], "path": pdf["path"], "size": sizes, "content": contents})


#: files listed in one frame; a larger folder gives several
LISTED_AT_ONCE = 5000


def _files_under(root: str, entry: str):
    """Relative paths of the files under one top-level entry; ignored folders are never entered."""
    full = os.path.join(root, entry)
    if not os.path.isdir(full):
        yield entry
    elif entry not in vocab.IGNORED_DIRS:
        for folder, inner, files in os.walk(full):
            inner[:] = [d for d in inner if d not in vocab.IGNORED_DIRS]
            for name in files:
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


def _walk_entries(batches):
    """List every file under each (repo, root, entry) in the task that holds it."""
    for pdf in batches:
        for repo, root, entry in zip(pdf["repo_id"], pdf["root"], pdf["entry"]):
            files = _files_under(root, entry)
            while some := list(islice(files, LISTED_AT_ONCE)):
                yield pd.DataFrame({"repo_id": repo, "root": root, "path": some})


def load_directories(spark: SparkSession, roots: dict[str, str], partitions: int | None = None) -> DataFrame:
    """A1 directory loader over a file system every executor can see.

    The driver lists only the first level of each root; each top-level entry is walked
    in a task, the listing is repartitioned, and contents are read in tasks, so no full
    file list passes through the driver and one large folder does not make one large task
    read. Spark's file sources skip names starting with '_' or '.', which would drop
    ``__init__.py``; this loader keeps every file outside ignored folders, which the walk
    never enters. ``partitions`` defaults to the session's shuffle partitions.
    """
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = [(repo, root, name) for repo, root in roots.items() for name in sorted(os.listdir(root))]
    top = spark.createDataFrame(entries, "repo_id string, root string, entry string")
    listing = top.repartition(max(1, min(partitions, len(entries)))).mapInPandas(
        _walk_entries, "repo_id string, root string, path string")
    return listing.repartition(partitions).mapInPandas(_read_files, CORPUS_SCHEMA)


def commit_records(log: DataFrame) -> DataFrame:
    """A3/A4: one row per commit record ``commit:<hash>[|<author>]`` followed by one path per line.

    ``log`` has one row per record (``repo_id, value``, optionally ``seq``, the record's position;
    smaller = newer, as ``git log`` prints). -> (repo_id, commit_id, seq, author, files). A header
    without an author gives a null author; line ends and blanks around names are dropped.
    """
    if "seq" not in log.columns:
        log = log.withColumn("seq", F.monotonically_increasing_id())
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.regexp_replace("value", r"^\s*(commit:)?", ""), "\n"), clean)
    header = F.split(lines[0], r"\|")
    files = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), normalise), lambda p: F.length(p) > 0)
    return log.select("repo_id", clean(header[0]).alias("commit_id"), "seq", clean(F.get(header, F.lit(1))).alias("author"),
                      files.alias("files"))


def parse_commit_log(log: DataFrame) -> DataFrame:
    """A3/A4: (repo_id, commit_id, seq, author, path), a row per file; see ``commit_records`` for
    commits without files, which count for a window of commits."""
    return commit_records(log).select("repo_id", "commit_id", "seq", "author", F.explode("files").alias("path"))


def read_log_records(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Records (repo_id, value, seq) of an exported log file or a folder of them.

    Records are split at ``\\ncommit:`` by the reader. ``seq`` orders them by file name, then by
    place in the file, so several files (newest first by name) keep the order of the log.
    """
    raw = spark.read.option("lineSep", "\ncommit:").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return raw.select(F.lit(repo_id).alias("repo_id"), "value", place.alias("seq"))


def read_commit_log(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """A3/A4 from exported log files, a row per file of a commit."""
    return parse_commit_log(read_log_records(spark, path, repo_id))


def write_commit_log(commits: DataFrame, path: str) -> None:
    """A3/A4 the other way: records ``commit:<id>|<author>`` with one path per line, a folder for each repository.

    commits (repo_id, commit_id, author, files) with ``files`` an array; names must not hold line ends.
    """
    author = F.when(F.col("author").isNull(), "").otherwise(F.concat(F.lit("|"), F.col("author").cast("string")))
    header = F.concat(F.lit("commit:"), F.col("commit_id").cast("string"), author)
    record = F.array_join(F.concat(F.array(header), F.col("files").cast("array<string>")), "\n")
    commits.select("repo_id", record.alias("value")).write.mode("overwrite").partitionBy("repo_id").text(path)


def read_repositories(spark: SparkSession, root: str, line_sep: str = "\n") -> DataFrame:
    """(value, repo_id) of the text files in ``repo_id=...`` folders; none if nothing was written, as then Spark finds no such folder."""
    reader = spark.read.option("lineSep", line_sep)
    if "repo_id" not in reader.text(root).columns:
        return spark.createDataFrame([], "value string, repo_id string")
    return reader.schema("value string, repo_id string").text(root)


def read_commit_logs(spark: SparkSession, root: str) -> DataFrame:
    """A3/A4 from a folder with one ``repo_id=...`` folder of log files each: a row per file of a commit.

    Spark plans the splits and prunes repositories by a filter on ``repo_id``; no file is opened by the driver.
    """
    raw = read_repositories(spark, root, "\ncommit:")
    return parse_commit_log(raw.select("repo_id", F.regexp_replace("value", r"\n$", "").alias("value")))


def adjacency_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """``{"src": ["dst", ...]}`` documents -> edges (repo_id, src, dst); bad JSON -> none."""
    m = F.from_json(F.col(value), "map<string,array<string>>")
    return (df.select("repo_id", F.explode(m).alias("src", "dsts"))
            .select("repo_id", "src", F.explode("dsts").alias("dst")))


def temporal_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """``{"a": {"b": 0.5}}`` -> (repo_id, a, b, ratio)."""
    m = F.from_json(F.col(value), "map<string,map<string,double>>")
    return (df.select("repo_id", F.explode(m).alias("a", "row"))
            .select("repo_id", "a", F.explode("row").alias("b", "ratio")))


def write_adjacency_json(edges: DataFrame, path: str) -> None:
    """One JSON object per (repo, source file): ``{"src": [sorted dsts]}``; the list is one
    file's imports (bounded by the file), never a whole repository."""
    per_src = edges.groupBy("repo_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))
    (per_src.select("repo_id", F.to_json(F.create_map("src", "dsts")).alias("value"))
     .write.mode("overwrite").partitionBy("repo_id").text(path))


def save_analysis(tables: dict[str, DataFrame], root: str) -> None:
    """Persist every derived table partitioned by repo_id (readers prune on it), one task for each repository: as many
    files as repositories, not as repositories times the tasks that hold rows of them."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if "repo_id" in df.columns:
            w = df.repartition("repo_id").write.mode("overwrite").partitionBy("repo_id")
        w.parquet(os.path.join(root, name))


def update_analysis(tables: dict[str, DataFrame], root: str) -> None:
    """A9, one analysis after another: only the repositories that ``tables`` hold are replaced.

    Dynamic partition overwrite: the writer stages the new files and swaps the folders of these repositories on
    commit; those of all others are not touched. A table without ``repo_id`` is replaced as a whole.
    """
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if "repo_id" in df.columns:
            w = df.repartition("repo_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id")
        w.parquet(os.path.join(root, name))


def load_analysis(spark: SparkSession, root: str, names: list[str], repo_id: str | None = None) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        df = spark.read.parquet(os.path.join(root, name))
        if repo_id is not None and "repo_id" in df.columns:
            df = df.where(F.col("repo_id") == repo_id)  # partition pruning
        out[name] = df
    return out
