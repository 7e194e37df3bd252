"""The determinant estimates against the best of all subsets of small groups, and the verdicts that follow from them."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rules

FLOOR, SHARE, INSIDE, RATE = 0.02, 0.75, 0.975, 1e-7
STATS = "doc_id int, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def vector(row):
    _, _, _, words, chars, symbols, lines, dup, repeat = row
    return [math.log1p(chars / words), math.log1p(100 * symbols / chars), math.sqrt(dup / lines), math.sqrt(repeat / words)]


def moments(x, factor):
    return x.mean(0), factor * np.cov(x.T, bias=True).reshape(4, 4) + FLOOR * np.eye(4)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def best_subset(x):
    """The least log determinant over all subsets of the share, and its mean and matrix."""
    size, factor = math.ceil(SHARE * len(x)), rules.consistency(SHARE, 4)
    found = [moments(x[list(s)], factor) for s in itertools.combinations(range(len(x)), size)]
    return min(((np.linalg.slogdet(c)[1], m, c) for m, c in found), key=lambda f: f[0])


def group(rng, n, outliers, lang, at):
    out = []
    for i in range(n):
        words = rng.randrange(400, 600)
        far = i < outliers
        chars = words * (30 if far else 5) + rng.randrange(400)
        out.append((at + i, lang, "s", words, chars, chars // 3 if far else rng.randrange(30), 40, 30 if far else rng.randrange(3), 200 if far else rng.randrange(40)))
    return out


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    return {f"l{g}": group(rng, 12, 3, f"l{g}", 100 * g) for g in range(6)} | {None: group(rng, 9, 2, None, 900)}


def test_chi_squared():
    assert rules.chi2_cdf(9.487729, 4) == pytest.approx(0.95, abs=1e-7)
    assert rules.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert rules.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    x = rules.chi2_quantile(1 - RATE, 4)
    assert math.exp(-x / 2) * (1 + x / 2) == pytest.approx(RATE, rel=1e-6)
    assert rules.consistency(1.0, 4) == 1.0


def test_consistency_on_normal_rows():
    x = np.random.default_rng(3).normal(size=(400_000, 4))
    near = x[np.sum(x**2, 1) <= np.quantile(np.sum(x**2, 1), SHARE)]
    assert np.allclose(rules.consistency(SHARE, 4) * near.var(0), 1, atol=0.02)


def test_least_determinant_of_all_subsets(spark, groups):
    rows = [r for g in groups.values() for r in g]
    fitted = rules._vector(spark.createDataFrame(rows, STATS)).select("lang", "source", *rules.VECTOR)
    got = {r["lang"]: r for r in rules.determinant_estimates(fitted).collect()}
    assert set(got) == set(groups)
    for lang, members in groups.items():
        logdet, mean, _ = best_subset(np.array([vector(r) for r in members]))
        assert got[lang]["logdet"] == pytest.approx(logdet, abs=1e-6)
        assert [got[lang][f"m{i}"] for i in range(4)] == pytest.approx(mean.tolist(), abs=1e-9)


def test_verdicts_equal_brute_force(spark, groups):
    rows = [r for g in groups.values() for r in g]
    got = {r["doc_id"]: r for r in rules.robust_outliers(spark.createDataFrame(rows, STATS), F.lit(True)).collect()}
    for members in groups.values():
        x = np.array([vector(r) for r in members])
        _, mean, cov = best_subset(x)
        inside = x[distances(x, mean, cov) <= rules.chi2_quantile(INSIDE, 4)]
        d2 = distances(x, *moments(inside, rules.consistency(INSIDE, 4)))
        assert [got[r[0]]["d2"] for r in members] == pytest.approx(d2.tolist(), rel=1e-6)
        assert [got[r[0]]["inlier"] for r in members] == (d2 <= rules.chi2_quantile(1 - RATE, 4)).tolist()
    assert sum(not r["inlier"] for r in got.values()) == 20


def test_steps_never_raise_the_determinant(spark, groups):
    rows = [r for g in groups.values() for r in g]
    fitted = rules._vector(spark.createDataFrame(rows, STATS)).select("lang", "source", *rules.VECTOR)
    factor = rules.consistency(SHARE, 4)
    state = rules._concentrated(fitted, rules._starts(fitted, FLOOR, factor), SHARE, FLOOR, factor)
    for _ in range(3):
        before = {(r["lang"], r["start"]): r["logdet"] for r in state.collect()}
        state = rules._concentrated(fitted, state, SHARE, FLOOR, factor)
        after = {(r["lang"], r["start"]): r["logdet"] for r in state.collect()}
        assert set(before) == set(after) == {(g, s) for g in groups for s in range(4)}
        assert all(after[k] <= before[k] + 1e-9 for k in before)


def test_equal_rows_and_lone_rows(spark):
    rows = [(i, "a", None, 100, 500, 0, 10, 0, 0) for i in range(20)] + [(99, "b", None, 100, 500, 0, 10, 0, 0), (100, "c", None, 100, 900, 90, 10, 5, 9)]
    stats = spark.createDataFrame(rows, STATS)
    got = {r["doc_id"]: (r["d2"], r["inlier"]) for r in rules.robust_outliers(stats, F.col("lang") != "c").collect()}
    assert all(got[i] == (pytest.approx(0, abs=1e-9), True) for i in [*range(20), 99])
    assert got[100] == (None, True)
    assert rules.robust_outliers(stats.limit(0), F.lit(True)).count() == 0
