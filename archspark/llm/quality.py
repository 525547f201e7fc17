"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Statistics of each text are computed inside its own row (split, hashes of word windows, sorts of
arrays), so texts are never exploded or shuffled. Their transformed vectors are judged within
(language, source): a minimum-covariance-determinant estimate is reached by concentration steps
(distance quantile, then mean and covariance of the closest part), each step two partial
aggregations; a row is rejected if its Mahalanobis distance, scaled so that the group's median
is the chi-squared median, exceeds the cut. Variances get a floor, since many statistics are zero
in ordinary text.

Groups with fewer than ``min_rows`` rows to learn from are pooled by language, then all together;
if that is still too few, only the base rules decide.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.session import cut_lineage

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: (name, transformed statistic, smallest standard deviation)
FEATURES = [
    ("x0", "log1p(n_words)", 0.5),
    ("x1", "ln(word_chars / n_words)", 0.05),
    ("x2", "sqrt(n_symbols / word_chars)", 0.04),
    ("x3", "sqrt(n_dup_lines / n_lines)", 0.15),
    ("x4", "sqrt(n_repeat_words / n_words)", 0.15),
    ("x5", "ln(n_distinct / n_words)", 0.08),
]
D = len(FEATURES)
#: above this many groups their estimates (about 0.5 kB each) are joined by a shuffle instead of a broadcast
BROADCAST_GROUPS = 20_000


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def _let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; windows are hashes in text order."""
    def spans(s):
        same = lambda x, i: F.get(s, i)["h"].eqNullSafe(x["h"])
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b))

    def body(d):
        placed = F.array_sort(F.transform(d, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(d)) == F.size(d), F.lit(0)).otherwise(_let(placed, spans))

    return _let(windows, body)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, lang, source and the text's counts (long)."""
    text = F.coalesce(F.col("__t"), F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    chars = F.length(F.translate(text, SPACE, ""))
    long = lambda c, name: c.cast("long").alias(name)

    def counts(h):
        windows = F.when(F.size(h) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(long(F.size(h), "n_words"), long(F.size(F.array_distinct(h)), "n_distinct"),
                        long(_covered(windows), "n_repeat_words"))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("__t"))
    return rows.select(
        "doc_id", "lang", "source", _let(hashes, counts).alias("c"), long(chars, "word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
        _let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))).alias("d"),
    ).select("doc_id", "lang", "source", "c.*", "word_chars", "n_symbols", "d.*")


def _joined(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their cell's columns; null-safe; the cells are broadcast only if they are few."""
    side = cells.withColumnsRenamed({c: f"__{c}" for c in on})
    side = F.broadcast(side) if cells.count() <= BROADCAST_GROUPS else side
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = one if cond is None else cond & one
    return rows.join(side, cond, "left").drop(*(f"__{c}" for c in on))


CELL = ["level", "cell_lang", "cell_source"]


def with_cells(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds the cell each row is judged in; level 3: too few rows anywhere."""
    n = cut_lineage(rows.groupBy("lang", "source").agg(F.sum(F.col("learn").cast("long")).alias("n")))
    small = n.filter(F.col("n") < min_rows)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("n1"))
    rest = by_lang.filter(F.col("n1") < min_rows).agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n2"))
    named = (n.join(by_lang.withColumnRenamed("lang", "l1"), F.col("lang").eqNullSafe(F.col("l1")), "left").crossJoin(F.broadcast(rest))  # one row
             .withColumn("level", F.when(F.col("n") >= min_rows, 0).when(F.col("n1") >= min_rows, 1).when(F.col("n2") >= min_rows, 2).otherwise(3))
             .select("lang", "source", "level", F.when(F.col("level") <= 1, F.col("lang")).alias("cell_lang"),
                     F.when(F.col("level") == 0, F.col("source")).alias("cell_source")))
    return _joined(rows, cut_lineage(named), ["lang", "source"])


def _factored(cells: DataFrame) -> DataFrame:
    """Adds the Cholesky factor (l_i_j) of each cell's covariance (c_i_j, i >= j)."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            cells = cells.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return cells.select(*CELL, *(f"m_{i}" for i in range(D)), *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1)))


def _distances(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``dist``, the squared Mahalanobis distance to the row's cell; null where there is no estimate."""
    keep = rows.columns
    out = _joined(rows, cells, CELL)
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l_{i}_{i}"))
    return out.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)), F.lit(0.0)).alias("dist"))


def _floor(value: Column, i: int) -> Column:
    return F.greatest(value, F.lit(FEATURES[i][2] ** 2))


def robust_cells(rows: DataFrame, *, part: float = 0.75, steps: int = 3) -> DataFrame:
    """Estimates of each cell from the rows marked ``learn``: start at medians, then concentrate."""
    learn = rows.filter(F.col("learn") & (F.col("level") < 3))
    mid = learn.groupBy(*CELL).agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m_{i}") for i in range(D)))
    dev = _joined(learn, cut_lineage(mid), CELL)
    mad = dev.groupBy(*CELL, *(f"m_{i}" for i in range(D))).agg(
        *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i in range(D)))
    cells = mad.select(*CELL, *(f"m_{i}" for i in range(D)), *(
        (_floor((F.col(f"s_{i}") * 1.4826) ** 2, i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(D) for j in range(i + 1)))
    cells = cut_lineage(_factored(cells))
    for _ in range(steps):
        near = _distances(learn, cells)
        cut = cut_lineage(near.groupBy(*CELL).agg(F.percentile_approx("dist", part, 1000).alias("cut")))
        best = _joined(near, cut, CELL).filter("dist <= cut")
        # sums about the step's own centre would need another join; the statistics are small numbers
        cells = best.groupBy(*CELL).agg(
            *(F.avg(f"x{i}").alias(f"m_{i}") for i in range(D)),
            *((_floor(F.var_pop(f"x{i}"), i) if i == j else F.covar_pop(f"x{i}", f"x{j}")).alias(f"c_{i}_{j}")
              for i in range(D) for j in range(i + 1)))
        cells = cut_lineage(_factored(cells))
    return cells


def quality(docs: DataFrame, *, min_rows: int = 60, tail: float = 1e-10, part: float = 0.75, steps: int = 3,
            id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the counts, base_failed and kept for every row of ``docs``.

    Null and empty texts have no words and fail the base rules; null languages and sources are
    groups like any other; repeated rows each get their row; an empty table gives an empty
    result. Other columns are not read.
    """
    stats = statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    vector = [F.when(F.col("n_words") > 0, F.greatest(F.expr(f), F.lit(-20.0))).otherwise(F.lit(0.0)).alias(n) for n, f, _ in FEATURES]
    rows = cut_lineage(stats.select("*", *vector, (~F.col("base_failed")).alias("learn")))
    rows = with_cells(rows, min_rows)
    scored = _distances(rows, robust_cells(rows, part=part, steps=steps))
    half = chi2_quantile(0.5, D)
    scale = cut_lineage(scored.filter("learn AND dist IS NOT NULL").groupBy(*CELL)
                        .agg((F.greatest(F.percentile_approx("dist", 0.5, 1000), F.lit(half)) / half).alias("scale")))
    judged = _joined(scored, scale, CELL)
    outlier = F.coalesce(F.col("dist") / F.col("scale") > chi2_quantile(1 - tail, D), F.lit(False))
    return judged.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), (F.col("dist") / F.col("scale")).alias("distance"))
