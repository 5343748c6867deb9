"""Tails and quantiles against tabulated values."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import distributions as ds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("z, p", [(0.0, 1.0), (1.959964, 0.05), (2.575829, 0.01), (-1.644854, 0.1)])
def test_normal(spark, z, p):
    assert one(spark, ds.normal_two_sided(F.lit(z))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (3.169273, 10, 0.01), (1.983972, 100, 0.05), (0.0, 5, 1.0)])
def test_t(spark, t, df, p):
    assert one(spark, ds.t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("f, a, b, p", [(4.964603, 1, 10, 0.05), (3.098391, 3, 20, 0.05), (4.938193, 3, 20, 0.01)])
def test_f(spark, f, a, b, p):
    assert one(spark, ds.f_upper(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (0.0, 3, 1.0)])
def test_chi_square(spark, x, df, p):
    assert one(spark, ds.chi2_upper(F.lit(x), F.lit(df))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("p, df, t", [(0.975, 10, 2.228139), (0.975, 1, 12.7062), (0.025, 10, -2.228139), (0.95, 30, 1.697261)])
def test_t_quantile(spark, p, df, t):
    assert one(spark, ds.t_quantile(F.lit(p), F.lit(df))) == pytest.approx(t, abs=1e-4)


def test_nulls_stay_null(spark):
    assert one(spark, ds.t_two_sided(F.lit(None).cast("double"), F.lit(3))) is None
