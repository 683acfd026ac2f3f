"""The tiles of the second matching stage against a loop over all pairs."""

import numpy as np
import pandas as pd
import pytest

from sightledger.functions.vectors import local_match_ratio, unit_matrix, unit_rows
from sightledger.operators import matching as M
from sightledger.params import Params


def _rows(rng, n, key):
    """Vectors and zero to four patches each; every third row is a copy of an earlier one."""
    vectors = [rng.normal(size=6).round(1) for _ in range(n)]
    local = [[list(x) for x in rng.normal(size=(k, 3)).round(1)] for k in rng.integers(0, 5, n)]
    for i in range(0, n, 3):
        vectors[i], local[i] = vectors[i // 2], local[i // 2]
    return pd.DataFrame({key: [f"{key[0]}{i:03d}" for i in rng.permutation(n)], "vector": vectors, "local": local})


def _loop(q, h, p):
    best = {}
    qv, hv = unit_rows(q["vector"]), unit_rows(h["vector"])
    near = M.similarities(qv, hv)
    for i, a in enumerate(q.itertuples()):
        for j, b in enumerate(h.itertuples()):
            if b.object_id not in a.wanted or ("since" in h and b.since >= a.until):
                continue
            r = local_match_ratio(unit_matrix(a.local), unit_matrix(b.local), p.local_patch_similarity)
            s = round(min(1.0, max(-1.0, p.global_weight * near[i, j] + p.local_weight * r)), 12)
            best[a.query_id, b.object_id] = max(best.get((a.query_id, b.object_id), (-2.0,)), (s, b.observation_id, near[i, j], r))
    return best


@pytest.mark.parametrize("cells", [4_000_000, 50])
@pytest.mark.parametrize("numbered", [False, True])
def test_tile_equals_loop(monkeypatch, cells, numbered):
    monkeypatch.setattr(M, "_STRIP_CELLS", cells, raising=False)
    rng, p = np.random.default_rng(5), Params(local_patch_similarity=0.4)
    q, h = _rows(rng, 40, "query_id"), _rows(rng, 60, "observation_id")
    h["object_id"] = [f"obj_{x}" for x in rng.integers(0, 5, 60)]
    q["wanted"] = [[f"obj_{x}" for x in rng.choice(6, 3, replace=False)] for _ in range(40)]
    if numbered:
        h["since"], q["until"] = rng.integers(0, 9, 60), rng.integers(0, 9, 40)
    got = {(r.query_id, r.object_id): (r.visual_score, r.observation_id, r.global_similarity, r.local_match_ratio)
           for r in M._local_tile(q, h, p).itertuples()}
    want = _loop(q, h, p)
    assert want and got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][1] == w[1] and got[k][::2] == pytest.approx(w[::2], abs=1e-12) and got[k][3] == pytest.approx(w[3])


def test_pairs_are_not_compared_one_by_one(monkeypatch):
    """Before, each of 300 x 400 pairs was a matrix product of its own; now one per strip and query patch."""
    calls = []
    ratios = M._local_ratios
    monkeypatch.setattr(M, "_local_ratios", lambda *a: calls.append(1) or ratios(*a))
    rng = np.random.default_rng(6)
    q, h = _rows(rng, 300, "query_id"), _rows(rng, 400, "observation_id")
    h["object_id"], q["wanted"] = "obj_0", [["obj_0"]] * 300
    assert len(M._local_tile(q, h, Params())) == 300 and len(calls) == 1
