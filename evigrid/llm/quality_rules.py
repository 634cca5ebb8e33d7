"""Quality rules: base limits and robust multivariate outliers (operator 5), in DataFrame operations alone.

``statistics`` counts words, symbols, repeated lines and words in repeated 5-word
windows of every whole text.  ``verdicts`` turns the counts into a vector of
transformed rates and rejects it where its squared Mahalanobis distance from the
minimum-covariance-determinant estimate of its language and source passes
``CUTOFF``.

The estimate: from two deterministic starts (medians with median deviations, and
plain mean with covariance) concentration steps keep the ``CORE`` share of a
group that lies nearest and estimate anew, until no determinant falls any more (at most
``STEPS`` times); of both ends the lower determinant stays.  A step is one aggregation by
group, with partial sums before the exchange, so a group with a third of all rows is no
task of its own.  Medians and limits are exact quantiles of values in thousandths, so
runs agree on them and their state is bounded by the range of the values.

A group's own covariance decides wherever it is regular.  ``FLOORS`` are least deviations
for statistics that (nearly) all documents of a group share, such as no symbols at all:
what counting noise of a clean document amounts to.  Groups under ``LEAST`` rows use the
estimate of their language, languages under ``LEAST`` rows reject nothing.

Results for odd input: null and empty texts have zero counts and fail the base;
null languages or sources count as empty ones; very long texts count whole; repeated rows
count each; columns of other names are ignored, whatever they are; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import stored

#: White space that parts words, and signs counted as symbols.
SPACE, SYMBOLS, WINDOW = r"[\x20\x09-\x0D]+", "#*$%&|<>", 5
CORE, STEPS, LEAST = 0.75, 12, 50
#: Makes the covariance of the nearest three quarters of a five-dimensional normal sample one of all: 0.75 / P(chi2_7 < 6.6257).
CONSISTENT = 1.41
#: The 0.999 quantile of chi-square with five degrees of freedom.
CUTOFF = 20.515
FEATURES = ("x0", "x1", "x2", "x3", "x4")
FLOORS = (0.5, 0.35, 0.1, 0.1, 0.08)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words under any 5-word window that occurs twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
        places = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1)), lambda e: e["i"])))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(found)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, language and source, and the five counts of each row; one pass without an exchange."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = lambda: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        F.array_remove(F.split(t, SPACE), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    dup = let(lines(), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return docs.select(F.col(key), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source"), counts.alias("_c"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector(stats: DataFrame) -> DataFrame:
    """Transformed rates; the added constants draw the rates of short texts to the middle."""
    n = F.col("n_words") + 20.0
    return stats.withColumns({
        "x0": F.log1p("n_words"), "x1": (F.col("word_chars") + 20 * 5.5) / n, "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.sqrt(F.col("n_dup_lines") / n), "x4": F.sqrt(F.col("n_repeat_words") / n),
    })


def _pairs():
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _factor(moments: DataFrame) -> DataFrame:
    """Cholesky factor of each group's covariance, with floors: columns l_i_j, and the log determinant."""
    out = moments
    for i, j in _pairs():
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        # what is left of a variance beside the statistics before it is at least its floor
        out = out.withColumn(f"l_{i}_{j}", F.greatest(F.sqrt(F.greatest(rest, F.lit(0.0))), F.lit(FLOORS[i])) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.withColumn("logdet", sum((2 * F.log(f"l_{i}_{i}") for i in range(len(FEATURES))), F.lit(0.0))).drop(*(f"c_{i}_{j}" for i, j in _pairs()))


def _distance(rows: DataFrame, into: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution; rows carry m_i and l_i_j."""
    out = rows
    for i in range(len(FEATURES)):
        rest = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
    return out.withColumn(into, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(FEATURES))), F.lit(0.0))).drop(*(f"_y{i}" for i in range(len(FEATURES))))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    means = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(FEATURES)]
    return rows.groupBy(*by).agg(*means, *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i, j in _pairs()))


def _quantile(value: Column, share: float) -> Column:
    """Exact over thousandths, so partial results merge alike in any order."""
    return F.percentile(F.round(value, 3), F.lit(share))


def estimates(vectors: DataFrame) -> DataFrame:
    """(grp, m_i, l_i_j) of each group of rows (grp, x0..x4)."""
    middle = stored(vectors.groupBy("grp").agg(*(_quantile(F.col(x), 0.5).alias(f"m_{i}") for i, x in enumerate(FEATURES))))
    off = vectors.join(middle, "grp").groupBy("grp").agg(*(_quantile(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"_s{i}") for i, x in enumerate(FEATURES)))
    robust = middle.join(off, "grp").select("grp", F.lit(0).alias("start"), *(f"m_{i}" for i in range(len(FEATURES))), *((F.pow(1.4826 * F.col(f"_s{i}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _pairs()))
    plain = _moments(vectors, "grp").withColumn("start", F.lit(1))
    now = stored(_factor(robust.unionByName(plain)))
    far = F.round(F.log1p("d2"), 3)
    for step in range(STEPS):
        near = _distance(vectors.join(now, "grp")).select("grp", "start", far.alias("far"), *FEATURES)
        limit = near.groupBy("grp", "start").agg(F.percentile("far", F.lit(CORE)).alias("limit"))
        after = stored(_factor(_moments(near.join(limit, ["grp", "start"]).where("far <= limit"), "grp", "start")))
        falls = after.join(now.select("grp", "start", F.col("logdet").alias("_before")), ["grp", "start"]).where(F.col("logdet") < F.col("_before") - 1e-3)
        now = after
        if step and falls.isEmpty():
            break
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    return now.join(best, ["grp", "start"]).drop("start", "logdet")


def verdicts(docs: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """key, counts, base_failed, distance, kept."""
    stats = stored(statistics(docs, key, **names)).select(key, "_lang", "_source", "_c.*", "n_symbols", "n_dup_lines")
    rows = _vector(stats.withColumn("base_failed", base_failed()))
    good = rows.where("not base_failed").select("_lang", "_source", *FEATURES)
    size = stored(good.groupBy("_lang", "_source").count())
    own = size.where(F.col("count") >= LEAST).select("_lang", "_source", F.concat_ws("\x1f", "_lang", "_source").alias("grp"))
    whole = size.groupBy("_lang").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST).select("_lang", F.concat_ws("\x1f", "_lang", F.lit("\x1fall")).alias("_all"))
    named = rows.join(own, ["_lang", "_source"], "left").join(whole, "_lang", "left")
    few = named.where("grp is null").select("_lang").distinct()  # languages with small groups need an estimate of their own
    each = named.where("not base_failed")
    pool = each.where("grp is not null").select("grp", *FEATURES).unionByName(each.join(few, "_lang", "left_semi").where("_all is not null").select(F.col("_all").alias("grp"), *FEATURES))
    model = estimates(stored(pool))
    scored = _distance(named.withColumn("grp", F.coalesce("grp", "_all")).join(model, "grp", "left"))
    distance = F.col("d2") / CONSISTENT
    return scored.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & ~F.coalesce(distance > CUTOFF, F.lit(False))).alias("kept"))
