"""Quality rules: counts of a text, then robust multivariate outliers per language and source.

For each (lang, source) the minimum-covariance-determinant estimate of location and scatter of four transformed
counts is found by concentration steps: keep the share of rows nearest to the present estimate, estimate again from
them, until the determinant falls no more. The steps run from two starts, medians with their deviations and the plain mean with
the plain scatter; of each group the estimate with the smaller determinant stays. Rows far from it (Mahalanobis distance) are
rejected. Only DataFrame functions are used: one scan makes the counts; each step is a histogram of distances by
group and a table of sums by group, both partial aggregates, so a source with a third of all rows is still summed in every task.

Transformed counts are integers, so sums don't depend on the order of rows: 1/256 of the natural logarithm of word length and of the rate of
symbols, 1/1024 of the shares of repeated lines and words. Fixed variances are added to the scatter's diagonal, as in the regularised
estimate, which keeps it invertible where a count is the same in all rows. For the shares they follow from what one repeated line
does: in a text of seven lines it is 1/7 of the lines and repeats 2/7 of the words, which must not be odd by itself,
while a share of LINES or WORDS is, however alike all other rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free, same, saved, table, words

D = 4
FEATURES = [f"f{i}" for i in range(D)]
#: Squared distance from which a row is an outlier; chi-square with four degrees of freedom passes it once in 200,000 rows.
CUT = 30.0
#: Shares of repeated lines and of repeated words that are odd by themselves.
LINES, WORDS = 0.45, 0.40
UNIT = 1024
#: Variances added to the scatter's diagonal: what a count may vary by before a row can be called odd, however alike the others are. That of word
#: length, 2 %, is below what texts of one source vary by, so a group's own scatter decides there; the other counts are zero in most rows of a group.
FLOOR = (5.0**2, 100.0**2, (LINES * UNIT) ** 2 / CUT, (WORDS * UNIT) ** 2 / CUT)
#: The share of a group that an estimate rests on, and the factor that makes its scatter that of normal rows: 1 / (1 - 2 z phi(z) / SHARE), z being the
#: normal quantile of (1 + SHARE) / 2. It is that of one dimension, as most groups vary along word length alone, which then takes all the trimming.
SHARE = 0.6
CONSISTENCY = 4.66
#: Concentration steps at most; they end when no group's determinant falls by more than one part in FALL.
STEPS = 10
FALL = 1e9
STARTS = 2
MIN_WORDS = 50
BINS = 64


def windows(w: F.Column) -> F.Column:
    """The three-word windows of the words ``w``, as texts: words hold no space, so equal texts are equal words."""
    at = lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), at)).otherwise(F.array().cast("array<string>"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; null and blank texts count nothing.

    Most texts have no window twice and stop there; in others, sorted (window, place) pairs show the windows with an
    equal neighbour, and each such place adds the words up to the next one, three at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("w", words(F.col("text"))).withColumn("h", windows(F.col("w")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    t = t.select(
        "doc_id", "lang", "source", "h",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        (F.size(F.array_distinct("h")) < F.size("h")).alias("again"),
    )
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("p", F.when(F.col("again"), pairs))
    twice = F.filter("p", lambda x, i: (F.get("p", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("p", i + 1)["h"].eqNullSafe(x["h"])))
    t = t.withColumn("at", F.when(F.col("again"), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    gaps = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return t.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("again"), gaps), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_base(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda a, b: UNIT * F.col(a) / F.col(b)
    moved = (256 * F.log(F.col("word_chars") / F.col("n_words")), 256 * F.log1p(100.0 * F.col("n_symbols") / F.col("n_words")), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return stats.withColumn("base_failed", failed).withColumns({f: F.when(~F.col("base_failed"), F.round(x).cast("long")) for f, x in zip(FEATURES, moved, strict=True)})


def _medians(values: DataFrame) -> DataFrame:
    """(lang, source, k, v) to the lower median of v for each (lang, source, k), from a histogram."""
    hist = values.groupBy("lang", "source", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("lang", "source", "k")
    run = F.sum("n").over(by.orderBy("v"))
    half = hist.withColumn("half", run * 2 >= F.sum("n").over(by)).filter("half")
    return half.groupBy("lang", "source", "k").agg(F.min("v").alias("v"))


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(g, same((F.col("lang"), F.col("_lang")), (F.col("source"), F.col("_source")))).drop("_lang", "_source")


def _estimated(rows: DataFrame, *by: str) -> DataFrame:
    """Mean and scatter of ``rows`` by group."""
    sums = [F.count(F.lit(1)).alias("h")] + [F.sum(f).alias(f"t{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum((F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(20,0)")).alias(f"q{i}{j}") for i in range(D) for j in range(i + 1)]
    got = rows.groupBy("lang", "source", *by).agg(*sums)
    h = F.col("h").cast("double")
    mean = lambda i: F.col(f"t{i}") / h
    cols = [mean(i).alias(f"m{i}") for i in range(D)]
    for i in range(D):
        for j in range(i + 1):
            cov = F.col(f"q{i}{j}").cast("double") / h - mean(i) * mean(j)
            cols.append((CONSISTENCY * cov + (FLOOR[i] if i == j else 0.0)).alias(f"s{i}{j}"))
    return got.select("lang", "source", *by, *cols)


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates: medians with squared scaled median deviations as a diagonal scatter (start 0), mean and scatter of all (start 1)."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)])).alias("x")).select("lang", "source", "x.k", "x.v")
    med = saved(_medians(long), "mcd-medians")
    m = med.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("k").alias("_k"), F.col("v").alias("m"))
    off = long.join(m, same((F.col("lang"), F.col("_lang")), (F.col("source"), F.col("_source")), (F.col("k"), F.col("_k"))))
    mad = _medians(off.select("lang", "source", "k", F.abs(F.col("v") - F.col("m")).alias("v")))
    both = med.unionByName(mad.withColumn("k", F.col("k") + D)).groupBy("lang", "source")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    cols = [pick(i).cast("double").alias(f"m{i}") for i in range(D)]
    cols += [(F.greatest(F.pow(1.4826 * pick(i + D), F.lit(2.0)), F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)]
    first = both.agg(*cols).withColumn("start", F.lit(0))
    return first.unionByName(_estimated(rows).withColumn("start", F.lit(1))).withColumn("det", F.lit(float("inf")))


PIVOTS = [f"e{i}" for i in range(D)] + [f"l{i}{j}" for i in range(D) for j in range(i)]


def _split(estimate: DataFrame) -> DataFrame:
    """The scatter as L E L': adds the pivots e and the lower triangle l, by group."""
    e = estimate
    for j in range(D):
        e = e.withColumn(f"e{j}", F.col(f"s{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") * F.col(f"e{k}") for k in range(j)), F.lit(0.0)))
        for i in range(j + 1, D):
            e = e.withColumn(f"l{i}{j}", (F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"e{k}") for k in range(j)), F.lit(0.0))) / F.col(f"e{j}"))
    return e


def _distance(rows: DataFrame, estimate: DataFrame, *more: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance: rows are solved forward; ``more`` columns of the estimate stay."""
    keep = [f"m{i}" for i in range(D)] + PIVOTS
    r = _joined(rows, _split(estimate).select("lang", "source", *keep, *more))
    for i, f in enumerate(FEATURES):
        r = r.withColumn(f"y{i}", F.col(f) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0)))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") / F.col(f"e{i}") for i in range(D)), F.lit(0.0))
    return r.withColumn("d2", d2).drop(*keep, *[f"y{i}" for i in range(D)])


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the rows nearest to the present one, where its determinant is smaller."""
    near = _distance(rows, estimate, "start").withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))))
    hist = near.groupBy("lang", "source", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("lang", "source", "start")
    enough = hist.withColumn("ok", F.sum("n").over(by.orderBy("bin")) >= SHARE * F.sum("n").over(by)).filter("ok")
    cut = enough.groupBy("lang", "source", "start").agg(F.min("bin").alias("cut")).withColumnRenamed("start", "_start")
    got = _estimated(_joined(near, cut).filter("start = _start and bin <= cut"), "start")
    det = F.col("e0")
    for i in range(1, D):
        det = det * F.col(f"e{i}")
    names = [f"m{i}" for i in range(D)] + [f"s{i}{j}" for i in range(D) for j in range(i + 1)]
    fresh = _split(got).withColumn("det", det).select(F.col("start").alias("_start"), "lang", "source", *[F.col(c).alias(f"_{c}") for c in (*names, "det")])
    both = _joined(estimate, fresh).filter("start = _start")
    falls = F.col("_det") < F.col("det") * (1 - 1 / FALL)
    return saved(both.select("lang", "source", "start", falls.alias("moved"), *[F.when(falls, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (*names, "det")]), "mcd-estimate")


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each (lang, source), a group a row."""
    now = saved(_starts(rows), "mcd-estimate")
    for _ in range(STEPS):
        now = _concentrated(rows, now)
        if now.filter("moved").isEmpty():
            break
    best = F.row_number().over(W.partitionBy("lang", "source").orderBy("det", "start"))
    return now.withColumn("_best", best).filter("_best = 1").drop("_best", "start", "det", "moved")


def judged(docs: DataFrame) -> DataFrame:
    """The counts of each row with base_failed, d2 (null where the base rules fail) and kept.

    Estimates rest on all rows that pass the base rules. A null language or source is a group of its own; a group of
    one row is its own centre and is kept. Null and blank texts fail the base rules. Repeated rows are judged
    alike; other columns don't matter; an empty table gives an empty result.
    """
    stats = saved(with_base(counts(docs)), "quality-counts")
    rows = stats.filter(~F.col("base_failed"))
    estimate = saved(estimates(rows), "mcd-estimate")
    good = _distance(rows, estimate).withColumn("kept", F.col("d2") <= CUT)
    bad = stats.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return good.unionByName(bad).drop("n_lines", *FEATURES)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected, whatever columns it has. Rows that share a doc_id stay if one of them does."""
    own = free(docs, "_tarn_id")
    keep = judged(docs).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
