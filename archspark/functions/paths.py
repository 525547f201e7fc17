"""Path parts and path predicates (C1-C7) as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archspark.functions import vocab


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(path) -> Column:
    """Back slashes to forward slashes."""
    return F.translate(_c(path), "\\", "/")


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    """Like ``os.path.splitext``: '' for dot-files such as '.env', else from the last dot."""
    return F.regexp_extract(basename(path), r"^.*[^.](\.[^.]*)$", 1)


def stem(path) -> Column:
    """Basename without its extension (``splitext(basename)[0]``)."""
    b = basename(path)
    return F.when(F.length(extension(path)) > 0,
                  F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)


def first_segment(path) -> Column:
    """First folder of a path, null for a root-level file."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1))


def is_ignored(path, ignored=None) -> Column:
    """Any path segment is an ignored directory."""
    ignored = ignored or vocab.IGNORED_DIRS
    return F.arrays_overlap(F.split(_c(path), "/"), F.array(*[F.lit(x) for x in ignored]))


def _suffix_rx(suffixes) -> str:
    return "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"


def is_code_file(path, suffixes=None) -> Column:
    """Path ends with one of the code suffixes (case-sensitive, as ``endswith``)."""
    return _c(path).rlike(_suffix_rx(suffixes or vocab.CODE_SUFFIXES))


def is_database_file(path) -> Column:
    """C4."""
    return basename(path).rlike(_suffix_rx(vocab.DATABASE_SUFFIXES))


def is_entry_point(path, names=None) -> Column:
    """C5."""
    return basename(path).isin(names or vocab.ENTRY_POINT_NAMES)


def is_test_path(path) -> Column:
    """C6: 'test' anywhere in the lower-cased path."""
    return F.lower(_c(path)).contains("test")


def is_readme(path) -> Column:
    """The whole path starts with 'readme' (so only a root readme)."""
    return F.lower(_c(path)).startswith("readme")


def url_path(url) -> Column:
    """Path part of a URL without the leading slash, query and fragment."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)


def path_parts(df, path: str = "path"):
    """C1-C7 as columns of one projection, on the slash-normalised path."""
    df = df.withColumn(path, normalise(path))
    return df.select("*", basename(path).alias("basename"), extension(path).alias("extension"),
                     stem(path).alias("stem"), first_segment(path).alias("first_segment"),
                     is_code_file(path).alias("is_code"), is_database_file(path).alias("is_database"),
                     is_entry_point(path).alias("is_entry_point"), is_test_path(path).alias("is_test"),
                     is_ignored(path).alias("is_ignored"))
