"""Quality rules and robust multivariate outliers (DataFrame functions only).

Base rules come first; of the documents that pass them, each (language, source) gets a
minimum-covariance-determinant estimate of its transformed statistics, and documents far from it by
Mahalanobis distance are rejected.  Each language and the whole corpus have such estimates too: a cell's own one is drawn
towards its language's, and that towards the corpus's, by as many documents as ``PRIOR``, so a small cell has a verdict of its own
without a switch at some size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, small, stored, text_or_empty, words

#: Transformed statistics, in this order; each has a least spread (added in square to its variance), so that
#: a statistic that is the same in nearly all documents doesn't make the covariance singular.
FEATURES = ["f_words", "f_length", "f_symbols", "f_lines", "f_repeats"]
FLOORS = [0.10, 0.15, 0.03, 0.08, 0.08]
#: The share of a cell's documents that the determinant is minimised over.
CORE = 0.75
#: Concentration steps from every start, then from the best one at most; each is one pass over five numbers a document.  They
#: end when no log-determinant moves by MOVES.
FIRST, STEPS, MOVES = 2, 10, 1e-3
#: Documents that the estimate above a cell's own counts as.
PRIOR = 50
#: Squared distances are binned by this many steps to a doubling.
FINE = 32
#: Chi-square quantiles for 5 degrees of freedom: 0.975, and the one beyond which a document goes (1 - 1e-13).
CHI_GOOD, CHI_CUT = 12.832502, 70.051105
#: Factors that make the covariance of the inner 0.75 (0.975) consistent at a normal: share / F7(quantile).
FIX_CORE, FIX_GOOD = 0.75 / 0.531135, 0.975 / 0.923704


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text (null: no words)."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       text_or_empty().alias("__text"))
    rows = rows.withColumn("__words", words(F.col("__text")))

    def let(value: Column, f) -> Column:
        return F.transform(F.array(value), f)[0]

    def repeats(w: Column) -> Column:
        """Words inside 3-word windows that the text holds twice or more: sort the windows, mark those with
        an equal neighbour, and add up what each marked window covers beyond the one before."""
        n = F.size(w)
        at = F.sequence(F.lit(0), n - 3)
        window = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = lambda x, j: same(x, j - 1) | same(x, j + 1)
            return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                               F.lit(0), lambda a, b: a + b)

        return F.when(n < 4, F.lit(0)).otherwise(let(F.array_sort(window), lambda s: let(marked(s), covered)))

    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return (rows.select(
        "doc_id", "lang", "source",
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("__text", GAP, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
        repeats(F.col("__words")).cast("bigint").alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _features(stats: DataFrame) -> DataFrame:
    """The transformed statistics, rounded to 1/4096 so that their sums are exact in any order."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = [
        F.log(n),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return stats.withColumns({f: F.round(x * 4096).cast("bigint") / F.lit(4096.0) for f, x in zip(FEATURES, made, strict=True)})


TRIES = 2


def _cells(rows: DataFrame) -> DataFrame:
    """Adds ``cell`` (language and source) and ``lang_cell``.  Null names count as values of their own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return rows.withColumns({"cell": F.to_json(F.struct(name("lang").alias("l"), name("source").alias("s"))), "lang_cell": F.to_json(F.struct(name("lang").alias("l")))})


def _members(rows: DataFrame, tries: int = 1) -> DataFrame:
    """Each row once for its cell, its language and the whole corpus, and each of these for every start."""
    every = F.array("cell", "lang_cell", F.lit("all"))
    out = rows.select(F.explode(every).alias("cell"), *FEATURES)
    return out if tries == 1 else out.select(F.explode(F.array(*[F.concat("cell", F.lit(f"#{i}")) for i in range(tries)])).alias("cell"), *FEATURES)


def _moments() -> list[Column]:
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
            + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in pairs])


PARTS = [f"m{i}" for i in range(5)] + [f"c{i}{j}" for i in range(5) for j in range(i + 1)]


def _scatter(sums: DataFrame, fix: float) -> DataFrame:
    """Per cell: n, means m_i and covariances c_ij, from sums of moments."""
    p = len(FEATURES)
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    cov = {f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(fix) for i in range(p) for j in range(i + 1)}
    return out.withColumns(cov).select("cell", "n", *PARTS)


def _factor(scatter: DataFrame) -> DataFrame:
    """Per cell: mean m_i, the Cholesky factor l_ij of the floored covariance, and the logarithm of its determinant."""
    p, out = len(FEATURES), scatter
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest + F.lit(FLOORS[i] ** 2), F.lit(FLOORS[i] ** 2 / 4))))
            else:
                out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, p)), 2 * F.log(F.col("l00")))
    return out.select("cell", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _estimate(sums: DataFrame, fix: float) -> DataFrame:
    return _factor(_scatter(sums, fix))


def mcd(rows: DataFrame) -> DataFrame:
    """Per cell, language and the whole: the estimate of least determinant that concentration steps reach from two starts,
    medians with interquartile spreads and medians with the least spreads."""
    start = stored(_start(_members(rows)), "mcd-start")
    plain = {f"l{i}{i}": F.lit(x) for i, x in enumerate(FLOORS)}
    tries = [start.withColumns({"cell": F.concat("cell", F.lit(f"#{i}")), **(plain if i else {})}) for i in range(TRIES)]
    now = stored(tries[0].unionByName(tries[1]), "mcd-estimate")
    every = _members(rows, TRIES)
    for _ in range(FIRST):
        now = stored(_estimate(_nearest(_distance(every, now), CORE, None), FIX_CORE), "mcd-estimate")
    names = [c for c in now.columns if c not in ("cell", "logdet")]
    best = now.groupBy(F.regexp_replace("cell", r"#\d+$", "").alias("cell")).agg(F.min(F.struct("logdet", *names)).alias("x"))
    now, every = stored(best.select("cell", *[F.col(f"x.{c}").alias(c) for c in [*names, "logdet"]]), "mcd-best"), _members(rows)
    for _ in range(STEPS):
        before, now = now, stored(_estimate(_nearest(_distance(every, now), CORE, None), FIX_CORE), "mcd-estimate")
        moved = now.join(before.select("cell", F.col("logdet").alias("was")), "cell").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < MOVES:
            break
    return now


def _drawn(own: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Means and covariances drawn towards those above, which count as PRIOR documents.  ``key``: the column of own that names these."""
    up = above.select(F.col("cell").alias("_up"), *[F.col(x).alias(f"_{x}") for x in PARTS])
    mixed = {x: (F.col("n") * F.col(x) + F.lit(PRIOR) * F.col(f"_{x}")) / (F.col("n") + F.lit(PRIOR)) for x in PARTS}
    return own.join(small(stored(up, "mcd-above")), F.col(key) == F.col("_up")).withColumns(mixed).select(*own.columns)


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the cell's estimate, by forward substitution.  There is an estimate for each cell."""
    p = len(FEATURES)
    out = rows.join(small(estimates), "cell", "left")
    for i in range(p):
        y = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = F.col("y0") * F.col("y0")
    for i in range(1, p):
        d2 = d2 + F.col(f"y{i}") * F.col(f"y{i}")
    return out.withColumn("d2", d2).drop(*[c for c in out.columns if c not in rows.columns])


def _start(rows: DataFrame) -> DataFrame:
    """Per cell: medians and interquartile spreads as a first estimate (no covariance), from counts of
    values in bins of 1/64."""
    p = len(FEATURES)
    long = rows.select("cell", F.posexplode(F.array(*FEATURES)).alias("f", "x"))
    bins = long.groupBy("cell", "f", F.floor(F.col("x") * 64).alias("b")).count()
    by = Window.partitionBy("cell", "f").orderBy("b")
    bins = bins.withColumn("upto", F.sum("count").over(by)).withColumn("all", F.sum("count").over(Window.partitionBy("cell", "f")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("b") + 0.5) / 64))
    q = bins.groupBy("cell").pivot("f", list(range(p))).agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("c"))
    spread = lambda i: F.greatest((F.col(f"{i}_c") - F.col(f"{i}_a")) / 1.349, F.lit(FLOORS[i]))
    return q.select("cell", *[F.col(f"{i}_m").alias(f"m{i}") for i in range(p)],
                    *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)])


def _nearest(rows: DataFrame, share: float | None, most: float | None) -> DataFrame:
    """Moment sums of each cell's nearest ``share`` of documents (by bins of d2, the last bin whole), or of
    those within ``most``."""
    p = len(FEATURES)
    names = ["n", *[f"s{i}" for i in range(p)], *[f"q{i}{j}" for i in range(p) for j in range(i + 1)]]
    if most is not None:
        return rows.filter(F.col("d2") <= most).groupBy("cell").agg(*_moments())
    bins = rows.groupBy("cell", F.floor(F.log2(F.col("d2") + 1) * FINE).alias("b")).agg(*_moments())
    before = Window.partitionBy("cell").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bins = (bins.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("__all", F.sum("n").over(Window.partitionBy("cell")))
            .filter(F.col("__before") < F.col("__all") * share))
    return bins.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names])


def quality_rules(docs: DataFrame, cut: float = CHI_CUT) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, distance (squared Mahalanobis distance, null
    if the base rules fail), kept.

    Documents that fail the base rules aren't kept and don't enter the estimates.  Null or empty texts have
    no words and fail.  Null languages and sources are names of their own.  Every cell has an estimate, whatever its size; that of
    a single document is all but its language's.  Equal rows get equal verdicts.  An empty table gives an empty result."""
    stats = stored(statistics(docs).withColumn("base_failed", base_failed()), "quality-stats")
    rows = _cells(_features(stats.filter(~F.col("base_failed"))))
    rows = stored(rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "cell", "lang_cell", *FEATURES), "mcd-rows")
    good = stored(_scatter(_nearest(_distance(_members(rows), mcd(rows)), None, CHI_GOOD), FIX_GOOD), "mcd-good")
    names = rows.select("cell", "lang_cell").distinct()
    all_ = good.filter(F.col("cell") == "all")
    langs = good.join(small(stored(names.select(F.col("lang_cell").alias("cell")).distinct(), "mcd-languages")), "cell").withColumn("up", F.lit("all"))
    langs = _drawn(langs, all_, "up").drop("up")
    cells = good.join(small(stored(names, "mcd-cells")), "cell")
    now = stored(_factor(_drawn(cells, langs, "lang_cell").drop("lang_cell")), "mcd-estimate")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _distance(rows, now).select(*base, F.col("d2").alias("distance"),
                                         F.coalesce(F.col("d2") <= cut, F.lit(True)).alias("kept"))
    failed = stats.filter("base_failed").select(*base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)
