"""Minimum covariance determinants against many random starts in numpy, and verdicts that follow from them."""

from __future__ import annotations

import numpy as np
import pytest

from tuplewise.llm import quality_rules as quality


def concentrated(x, floors, h, factor, rng, starts):
    """The least determinant that concentration steps from random starts lead to: (log determinant, mean, scatter)."""
    n, p = x.shape
    best = None
    for _ in range(starts):
        own = x[rng.choice(n, p + 1, replace=False)]
        mean, scatter = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floors**2)
        for _ in range(60):
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            near = x[np.argsort(far, kind="stable")[: int(np.ceil(h * n))]]
            new = factor * np.cov(near.T, bias=True) + np.diag(floors**2)
            if np.array_equal(near.mean(axis=0), mean):
                break
            mean, scatter = near.mean(axis=0), new
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[0]:
            best = det, mean, scatter
    return best


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_verdicts_equal_those_of_many_starts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", broadcast)
    rng, features = np.random.default_rng(7), {"x": 0.05, "y": 0.05, "z": 0.05}
    floors, h, tables = np.array(list(features.values())), quality.H, {}
    for k, lang in enumerate(("en", "de")):
        a = rng.normal(size=(3, 3)) + 2 * np.eye(3)
        good = rng.normal(size=(500, 3)) @ a + k
        tables[lang] = np.r_[good, rng.normal(size=(90 - 30 * k, 3)) * 0.3 + [14, -9, 11], rng.normal(size=(30, 3)) * 8]
    rows = [(i, lang, None, *map(float, v)) for lang, x in tables.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, lang string, source string, x double, y double, z double")
    got = {(r.lang, r.id): r.distance2 for r in quality.mcd_distances(frame, features, min_group=50).collect()}
    p = len(features)
    factor = h / quality.chi2_share(quality.chi2_point(h, p), p + 2)
    kept = quality.cut(quality._grouped(frame, 50))
    dets = {r["_grp"]: r["_det"] for r in quality.mcd_estimates(kept, features).collect()}
    for lang, x in tables.items():
        det, mean, scatter = concentrated(x, floors, h, factor, rng, 300)
        own = next(v for g, v in dets.items() if lang in g)
        assert own <= det + 0.05  # no worse than the best of 300 starts, but for the grid of the quantile
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
        limit = quality.chi2_point(1 - 1e-4, p)
        same = [(got[lang, i] > limit) == (far[i] > limit) for i in range(len(x))]
        assert sum(same) >= len(x) - 3 and abs(np.log(np.mean(far[:500])) - np.log(np.mean([got[lang, i] for i in range(500)]))) < 0.1
        assert all(got[lang, i] > limit for i in range(500, len(x) - 30))


def test_kept_follows_from_distance_and_base_rules(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(700):
        w = [f"w{rng.integers(5000)}" for _ in range(60 + int(rng.integers(40)))]
        text = " ".join(w) if i % 50 else " ".join(x.upper() + "#$%" for x in w)
        rows.append((None if i % 7 == 0 else i, text, "en", "s" if i % 2 else None, "clash", 1.0))
    rows += rows[:3] + [(1, None, None, None, "clash", 2.0), (2, "x" * 200_000, "en", "s", "clash", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _grp string, distance2 double")
    got = quality.quality_rules(frame).collect()
    assert len(got) == len(rows)
    limit = quality.chi2_point(1 - quality.TAIL, len(quality.FEATURES))
    assert all(r.kept == (not r.base_failed and r.distance2 <= limit) for r in got)
    odd = [r for r in got if r.n_symbols > r.n_words]
    assert len(odd) >= 14 and not any(r.kept for r in odd) and sum(r.kept for r in got) >= 680
