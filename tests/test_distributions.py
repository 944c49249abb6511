"""p-value functions against published values."""

import numpy as np
import pytest

from kestrel.functions import distributions as d


def test_normal():
    assert d.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-9)
    assert d.norm_ppf(1e-10) == pytest.approx(-6.361340902, abs=1e-7)
    assert d.norm_sf(1.96) == pytest.approx(0.0249979, abs=1e-7)


def test_t_f_chi2():
    assert d.t_sf_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert d.t_sf_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert d.f_sf(3.0, 2, 20) == pytest.approx((20 / 26) ** 10, rel=1e-10)
    assert d.f_sf(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert d.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert d.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert d.corr_pvalue(0.0, 50) == pytest.approx(1.0)


def test_studentized_range():
    assert d.studentized_range_ppf(0.95, 3, 20) == pytest.approx(3.578, abs=2e-3)
    assert d.studentized_range_ppf(0.95, 10, 60) == pytest.approx(4.646, abs=5e-3)


def test_shapiro_wilk_properties():
    rng = np.random.default_rng(0)
    w, p = d.shapiro_wilk(rng.normal(size=500))
    assert 0.98 < w <= 1.0 and p > 0.01
    w2, p2 = d.shapiro_wilk(rng.exponential(size=500))
    assert p2 < 1e-6
    assert np.isnan(d.shapiro_wilk([1.0, 2.0])[0])
