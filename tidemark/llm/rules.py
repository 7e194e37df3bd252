"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SYMBOL = r"[#*$%&|<>]"
#: A character of a word.
INSIDE = r"[^\x20\x09-\x0D]"
#: The transformed statistics whose outliers are rejected.
VECTOR = ("word_length", "symbol_share", "line_repeats", "word_repeats")


def _covered(grams: Column, n: int) -> Column:
    """Words in n-word windows that occur twice or more: windows are sorted with their places, equal neighbours are
    kept, and each kept place adds the words up to the next one, n at most."""
    placed = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(s: Column) -> Column:
        size = F.size(s)
        same = lambda j, k: F.get(s, j)["x"] == F.get(s, k)["x"]
        at = F.filter(F.sequence(F.lit(0), size - 1), lambda j: ((j > 0) & same(j, j - 1)) | ((j < size - 1) & same(j, j + 1)))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    def words(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.coalesce(F.least(F.lit(n), F.get(p, j + 1) - F.get(p, j)), F.lit(n)))

    # a one-element array binds a value once for the expressions over it
    return F.element_at(F.transform(F.array(placed), lambda s: F.element_at(F.transform(F.array(twice(s)), words), 1)), 1)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", window: int = 3) -> DataFrame:
    """id, lang, source and the counts of each whole text; the heavy path is taken only by texts with a repeated window.
    Windows of a text are compared by 64-bit hashes."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(id_col, F.col("lang"), F.col("source"), text.alias("t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    words = F.col("words")
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, window)]))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(INSIDE))
    stats = split.select(
        id_col, "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"), grams.alias("grams"),
    )
    return stats.select(
        id_col, "lang", "source", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _covered(F.col("grams"), window)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _vector(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return stats.withColumns({"word_length": F.log1p(share("word_chars", "n_words")), "symbol_share": F.log1p(100 * share("n_symbols", "word_chars")), "line_repeats": F.sqrt(share("n_dup_lines", "n_lines")), "word_repeats": F.sqrt(share("n_repeat_words", "n_words"))})


GROUP = ("lang", "source")


def chi2_cdf(x: float, p: int) -> float:
    """P(X <= x) of a chi-squared variable with p degrees of freedom, by the series of the incomplete gamma function."""
    half, term, total, k = p / 2, (x / 2) ** (p / 2) * math.exp(-x / 2) / math.gamma(p / 2 + 1), 0.0, 1
    while term > 1e-18 * total and term > 0:
        total, term, k = total + term, term * (x / 2) / (half + k), k + 1
    return min(1.0, total)


def chi2_quantile(share: float, p: int) -> float:
    """The x below which the share of a chi-squared variable lies, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < share else (low, mid)
    return high


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be the covariance of all."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _on(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _moments(rows: DataFrame, keys: Sequence[str], names: Sequence[str] = VECTOR) -> DataFrame:
    """n, means m_i and covariances c_ij (j <= i) per key, in one aggregation."""
    p = len(names)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(names)], *[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)])
    return sums.select(*keys, "n", *[f"m{i}" for i in range(p)], *[(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])


def _factors(moments: DataFrame, keys: Sequence[str], floor: float, factor: float) -> DataFrame:
    """keys, n, m_i, the inverse Cholesky factor w_ij of factor * covariance + floor on the diagonal, and logdet, the
    logarithm of that matrix's determinant."""
    p = len(VECTOR)
    out = moments.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor + (floor if i == j else 0.0) for i in range(p) for j in range(i + 1)})
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floor * 0.5))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                out = out.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}"))
            else:
                dot = F.lit(0.0)
                for k in range(j, i):
                    dot = dot + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                out = out.withColumn(f"w{i}{j}", -dot / F.col(f"l{i}{i}"))
    logdet = 2 * reduce(lambda x, y: x + y, [F.log(F.col(f"l{i}{i}")) for i in range(p)])
    return out.select(*keys, "n", *[f"m{i}" for i in range(p)], *[f"w{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _distance(rows: DataFrame, estimates: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's estimate (null without one), and more columns of
    the estimate; a row per estimate of its group."""
    p = len(VECTOR)
    squares = F.lit(0.0)
    for i in range(p):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"e.w{i}{j}") * (F.col(f"r.{VECTOR[j]}") - F.col(f"e.m{j}"))
        squares = squares + z * z
    joined = rows.alias("r").join(estimates.alias("e"), _on("r", "e", GROUP), "left")
    return joined.select("r.*", squares.alias("d2"), *[f"e.{c}" for c in more])


def _starts(fitted: DataFrame, floor: float, factor: float) -> DataFrame:
    """Four estimates per group to start from, told apart by `start`: medians and scaled quartile ranges alone (0); mean
    and covariance (1); covariance of hyperbolic tangents of standardised rows (2); of their directions (3)."""
    p = len(VECTOR)
    pairs_ = [(i, j) for i in range(p) for j in range(i + 1)]
    quart = fitted.groupBy(*GROUP).agg(F.count("*").alias("n"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, v in enumerate(VECTOR)])
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
    scales = written(quart.select(*GROUP, "n", *[F.col(f"q{i}")[1].alias(f"o{i}") for i in range(p)], *[spread(i).alias(f"r{i}") for i in range(p)], *[F.sqrt(spread(i) * spread(i) + floor).alias(f"u{i}") for i in range(p)]))
    z = fitted.alias("f").join(scales.alias("s"), _on("f", "s", GROUP)).select("f.lang", "f.source", *[((F.col(f"f.{v}") - F.col(f"s.o{i}")) / F.col(f"s.u{i}")).alias(f"z{i}") for i, v in enumerate(VECTOR)])
    norm = F.sqrt(reduce(lambda x, y: x + y, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)]))
    forms = {1: lambda i: F.col(f"z{i}"), 2: lambda i: F.tanh(F.col(f"z{i}")), 3: lambda i: F.when(norm > 0, F.col(f"z{i}") / norm).otherwise(0.0)}
    shaped = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[f(i).alias(f"y{i}") for i in range(p)]) for k, f in forms.items()])).alias("x")
    moments = _moments(z.select(*GROUP, shaped).select(*GROUP, "x.*"), (*GROUP, "start"), [f"y{i}" for i in range(p)])
    back = moments.alias("m").join(scales.alias("s"), _on("m", "s", GROUP)).select(
        "m.lang", "m.source", "m.start", "m.n",
        *[(F.col(f"s.o{i}") + F.when(F.col("m.start") == 1, F.col(f"s.u{i}") * F.col(f"m.m{i}")).otherwise(0.0)).alias(f"m{i}") for i in range(p)],
        *[(F.col(f"m.c{i}{j}") * F.col(f"s.u{i}") * F.col(f"s.u{j}")).alias(f"c{i}{j}") for i, j in pairs_],
    )
    plain = scales.select(*GROUP, F.lit(0).alias("start"), "n", *[F.col(f"o{i}").alias(f"m{i}") for i in range(p)], *[(F.col(f"r{i}") * F.col(f"r{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs_])
    return written(_factors(back.unionByName(plain), (*GROUP, "start"), floor, factor))


def _concentrated(fitted: DataFrame, estimates: DataFrame, share: float, floor: float, factor: float) -> DataFrame:
    """Each estimate made anew from the share of its group's rows that are nearest to it."""
    keys = (*GROUP, "start")
    near = _distance(fitted, estimates, ["start"])
    limit = near.groupBy(*keys).agg(F.percentile_approx("d2", share, 1000).alias("limit"))
    inner = near.alias("n").join(limit.alias("l"), _on("n", "l", keys)).where("d2 <= limit").select("n.*")
    return written(_factors(_moments(inner, keys), keys, floor, factor))


def determinant_estimates(fitted: DataFrame, share: float = 0.75, most: int = 8, floor: float = 0.02) -> DataFrame:
    """lang, source, start, n, m_i, w_ij, logdet: the minimum-covariance-determinant estimate per group of rows with
    VECTOR's columns.

    Four starts are concentrated twice; of each group's, the one of the least determinant goes on until no group's
    determinant falls, `most` steps at most. A concentration step takes the share of rows nearest to an estimate and their
    mean and covariance, made consistent with normal rows, plus floor on its diagonal, and never raises that matrix's
    determinant (but for rows that tie at the limit, which are all taken, and for limits of large groups, which are
    percentiles within a thousandth). Equal determinants go to the first start."""
    factor = consistency(share, len(VECTOR))
    estimates = _starts(fitted, floor, factor)
    for _ in range(2):
        estimates = _concentrated(fitted, estimates, share, floor, factor)
    kept = [c for c in estimates.columns if c not in GROUP]
    best = written(estimates.groupBy(*GROUP).agg(F.min_by(F.struct(*kept), F.struct(F.round("logdet", 9), "start")).alias("b")).select(*GROUP, "b.*"))
    for _ in range(most):
        closer = _concentrated(fitted, best, share, floor, factor)
        gain = closer.alias("c").join(best.alias("b"), _on("c", "b", GROUP)).agg(F.max(F.col("b.logdet") - F.col("c.logdet"))).first()[0]
        best = closer
        if gain is None or gain < 1e-6:
            break
    return best


def robust_outliers(stats: DataFrame, use: Column, share: float = 0.75, rate: float = 1e-7, inside: float = 0.975, most: int = 8, floor: float = 0.02) -> DataFrame:
    """stats with d2 and inlier, by the minimum-covariance-determinant estimate per (lang, source) over rows where use holds.

    The estimate is reweighted: rows within the `inside` quantile of the chi-squared distribution give mean and
    covariance once more. A row is an outlier beyond that distribution's quantile 1 - rate, so of normal rows `rate` are
    rejected; floor keeps a statistic that hardly varies from rejecting small deviations. A row whose group has no
    usable row is an inlier."""
    p = len(VECTOR)
    rows = _vector(stats)
    fitted = rows.where(use).select(*GROUP, *VECTOR)
    first = determinant_estimates(fitted, share, most, floor)
    near = _distance(fitted, first).where(F.col("d2") <= chi2_quantile(inside, p))
    last = written(_factors(_moments(near, GROUP), GROUP, floor, consistency(inside, p)))
    return _distance(rows, last).withColumn("inlier", F.coalesce(F.col("d2") <= chi2_quantile(1 - rate, p), F.lit(True))).drop(*VECTOR)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """id, n_words, the base counts, base_failed and kept of every whole text.

    Defined results: null and empty texts have zero counts and fail the base; null lang or source form groups of
    their own; repeated rows are judged alike; an empty table gives no rows; other columns are ignored."""
    stats = written(base_statistics(docs, id_col).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))))
    judged = robust_outliers(stats, ~F.col("base_failed"))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("inlier")).alias("kept"))
