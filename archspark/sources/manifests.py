"""Dependency manifests (A5, A6, E18) and the project profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.functions import vocab

_WS = r"^\s+|\s+$"


def requirement_lines(files: DataFrame, content: str = "content", key: str = "repo_id") -> DataFrame:
    """A5: requirement names from requirements-style text, one row per line kept.

    strip; skip blank, '#' and '-r' lines; cut at the first '==', '>=', '<=', '~='
    (in that order, like chained splits); strip; lower-case; drop empty names.
    -> (key, path, line_no, dep)
    """
    lines = files.select(key, "path", F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "line"))
    line = F.regexp_replace("line", _WS, "")
    dep = line
    for sep in vocab.REQUIREMENT_SEPARATORS:
        dep = F.substring_index(dep, sep, 1)
    dep = F.lower(F.regexp_replace(dep, _WS, ""))
    keep = (F.length(line) > 0) & ~line.startswith("#") & ~line.startswith("-r")
    return (lines.where(keep).select(key, "path", F.col("line_no").cast("bigint").alias("line_no"), dep.alias("dep"))
            .where(F.length("dep") > 0))


def package_json_deps(files: DataFrame, content: str = "content", key: str = "repo_id") -> DataFrame:
    """Keys of ``dependencies`` and ``devDependencies`` (case kept); malformed JSON -> no rows."""
    js = F.from_json(F.col(content), "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.array_union(F.coalesce(F.map_keys(js["dependencies"]), F.array().cast("array<string>")),
                         F.coalesce(F.map_keys(js["devDependencies"]), F.array().cast("array<string>")))
    return files.select(key, "path", F.explode(keys).alias("dep"))


def package_manifests(files: DataFrame, content: str = "content", key: str = "repo_id") -> DataFrame:
    """A6 with what went wrong: (key, path, section, dep, version, reason), one row for each dependency of any kind of
    value, and one row with a reason for each manifest or section that yields none.

    Manifests are parsed once into VARIANT; the two sections are taken by path and their entries exploded, so versions
    that are objects or numbers are kept (as JSON text). Reasons: empty, malformed JSON (repeated keys too),
    not an object, and <section> is not an object. A section that is absent or null has no row.
    """
    spark = files.sparkSession
    text = F.regexp_replace(F.coalesce(F.col(content).cast("string"), F.lit("")), _WS, "")
    m = files.select(key, "path", text.alias("_t")).withColumn("_v", F.try_parse_json("_t"))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    bad = F.when(F.col("_t") == "", "empty").when(F.col("_v").isNull(), "malformed JSON").when(~is_object(F.col("_v")), "not an object")
    m = m.withColumn("_bad", bad)
    none = F.lit(None).cast("string")
    whole = m.where("_bad IS NOT NULL").select(key, "path", none.alias("section"), none.alias("dep"), none.alias("version"), F.col("_bad").alias("reason"))
    out = whole
    for name in ("dependencies", "devDependencies"):
        s = m.where("_bad IS NULL").select(key, "path", F.try_variant_get("_v", f"$.{name}", "variant").alias("_s"))
        s = s.where(F.col("_s").isNotNull() & ~F.is_variant_null("_s"))
        entry = s.where(is_object(F.col("_s"))).lateralJoin(spark.tvf.variant_explode(F.col("_s").outer()))
        out = out.unionByName(entry.select(key, "path", F.lit(name).alias("section"), F.col("key").alias("dep"), F.col("value").cast("string").alias("version"), none.alias("reason")))
        out = out.unionByName(s.where(~is_object(F.col("_s"))).select(key, "path", F.lit(name).alias("section"), none.alias("dep"), none.alias("version"),
                                                                     F.lit(f"{name} is not an object").alias("reason")))
    return out


def dependency_set(deps: DataFrame, key: str = "repo_id") -> DataFrame:
    """Distinct dependencies per repository, long form."""
    return deps.select(key, "dep").distinct()


def project_profile(inventory: DataFrame, deps: DataFrame | None, key: str = "repo_id") -> DataFrame:
    """C9 + C10: project type (first framework found as a substring of the joined dependency
    names, else Python / JavaScript / Unknown by extension) and the layout label."""
    inv = inventory.select(key, "extension")
    g = inv.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"),
                             F.sum(F.when(F.col("extension") == ".py", 1).otherwise(0)).alias("py"),
                             F.sum(F.when(F.col("extension").isin(*vocab.JS_EXTENSIONS), 1).otherwise(0)).alias("js"))
    if deps is not None:
        # "name in ' '.join(deps)" equals "name in some dep" for names without spaces
        flags = deps.select(key, "dep").distinct().groupBy(key).agg(
            *[F.max(F.col("dep").contains(n).cast("int")).alias(f"_{n}") for n, _ in vocab.FRAMEWORKS])
        g = g.join(flags, key, "left")
    else:
        g = g.select("*", *[F.lit(0).alias(f"_{n}") for n, _ in vocab.FRAMEWORKS])
    ptype = reduce(lambda acc, nl: acc.when(F.col(f"_{nl[0]}") == 1, nl[1]), vocab.FRAMEWORKS[1:],
                   F.when(F.col(f"_{vocab.FRAMEWORKS[0][0]}") == 1, vocab.FRAMEWORKS[0][1]))
    ptype = ptype.when(F.col("py") > 0, "Python").when(F.col("js") > 0, "JavaScript").otherwise("Unknown")
    label = F.concat(F.col("project_type"), F.lit(" ("), F.col("n_files").cast("string"), F.lit(" files"),
                     F.when((F.col("py") > 0) | (F.col("js") > 0),
                            F.concat(F.lit(": "), F.col("py").cast("string"), F.lit(" py, "),
                                     F.col("js").cast("string"), F.lit(" js"))).otherwise(F.lit("")),
                     F.lit(")"))
    return (g.withColumn("project_type", ptype)
            .select(key, "project_type", F.col("n_files").cast("bigint").alias("n_files"),
                    F.col("py").cast("bigint").alias("py_files"), F.col("js").cast("bigint").alias("js_files"),
                    label.alias("layout")))
