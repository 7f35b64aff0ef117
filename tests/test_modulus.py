"""The modulus steps exchange observations by line once, and rounds of reweighting work on sums."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.operators import flexure
from echofold.plans import catalog, compare_queries, registry

SF = "/root/testdata/sf0.001"


def exchanges(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue().count("Exchange hashpartitioning")


def test_misfit_profiles_need_one_exchange(spark):
    prof = compare_queries._profile(registry.Tables(spark, SF))
    assert exchanges(prof) == 1
    assert exchanges(flexure.modulus_interval(prof, ["line_id"])) == 1


@pytest.mark.parametrize("kw", [{}, {"fit_offset": True, "strain_offset": True}, {"scale": {"strain": 2.0}}])
def test_reweighting_by_sums_with_and_without_observations_joined(spark, kw):
    t = registry.Tables(spark, SF)
    pred, obs = compare_queries.analytic_predictions(t).where("line_id <= 3"), compare_queries.flex_obs(t).where("line_id <= 3")
    get = lambda o: {(r.line_id, r.kind): r.factor for r in flexure.reweighted_fit(pred, o, ["line_id"], max_rounds=1, **kw)[1].collect()}
    one, two = get(None), get(obs)
    rows = pred.toPandas()
    s = rows["sigma"] * np.where(rows["kind"] == "strain", kw.get("scale", {}).get("strain", 1.0), 1.0)
    assert set(one) == set(two) == {(k, d) for k, d in zip(rows["line_id"], rows["kind"])}
    for line in set(rows["line_id"]):
        best = None
        for (ie, ix), c in rows[rows["line_id"] == line].groupby(["ie", "ix"]):
            mm = my = yy = 0.0
            for kind, k in c.groupby("kind"):
                u, m, y = 1 / s[k.index] ** 2, k["pred"], k["y"]
                off = kw.get("fit_offset" if kind == "shape" else "strain_offset")
                m, y = (m - (u * m).sum() / u.sum(), y - (u * y).sum() / u.sum()) if off else (m, y)
                mm, my, yy = mm + (u * m * m).sum(), my + (u * m * y).sum(), yy + (u * y * y).sum()
            J = yy - my * my / mm
            if best is None or J < best[0]:
                best = J, my / mm, c
        for kind, k in best[2].groupby("kind"):
            chi2 = (((k["y"] - best[1] * k["pred"]) / k["sigma"]) ** 2).sum() / max(len(k) - (3 if kind == "shape" else 1), 1)
            want = np.sqrt(max(1.0, chi2))
            np.testing.assert_allclose([one[line, kind], two[line, kind]], want, rtol=1e-6)
