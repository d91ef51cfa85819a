"""The joint positivity correction against numpy."""

import numpy as np
import pytest

from rankloom.operators import positivity as P


def built(rng, n, k, noise, signal):
    x = rng.multivariate_normal(np.zeros(k), signal + noise, n)
    return x, rng.uniform(0.5, 2, n)


def frame(spark, cells):
    """Specifications with their entities, noise columns and fall-backs."""
    k = next(iter(cells.values()))[0].shape[1]
    own = P.cells(k)
    rows = []
    for name, (x, w, noise) in cells.items():
        for a, b in zip(x, w):
            rows.append((name, *map(float, a), float(b), *(None if noise is None else float(noise[i, j]) for i, j in own), *(9.0 + i + j for i, j in own)))
    schema = ", ".join(["spec string", *(f"x{i} double" for i in range(k)), "w double", *(f"raw{i}{j} double" for i, j in own), *(f"one{i}{j} double" for i, j in own)])
    raw, one = ({(f"x{i}", f"x{j}"): f"{n}{i}{j}" for i, j in own} for n in ("raw", "one"))
    return spark.createDataFrame(rows, schema), [f"x{i}" for i in range(k)], raw, one


def moments(x, w, noise):
    q = w / w.sum()
    c = x - q @ x
    observed = (c * q[:, None]).T @ c
    centring = np.diag(q) - np.outer(q, q)
    grads = []
    for i, j in P.cells(x.shape[1]):
        g = np.zeros_like(c)
        g[:, i] += centring @ c[:, j]
        g[:, j] += centring @ c[:, i]
        grads.append(g)
    return observed, np.array([[((a @ noise) * b).sum() for b in grads] for a in grads])


@pytest.mark.parametrize("k", [2, 3])
def test_joint_noise(spark, k):
    rng = np.random.default_rng(k)
    noise = np.eye(k) * 0.2 + 0.05
    easy = (*built(rng, 60, k, noise, np.eye(k) + 0.2), noise)
    hard = (*built(rng, 40, k, noise, np.eye(k) * 0.02), noise * 1.1)
    never = (*built(rng, 4000, k, noise, np.eye(k) * 0.001), noise * 9)
    exact = np.diag([0.0] + [0.2] * (k - 1))
    cells = {"easy": easy, "hard": hard, "never": never, "exact": (*easy[:2], exact), "unknown": (*easy[:2], None)}
    df, xs, raw, one = frame(spark, cells)
    out, names = P.joint_noise(df, ["spec"], xs, "w", raw, one)
    assert out.count() == df.count()
    got = {r.spec: r for r in out.dropDuplicates(["spec"]).collect()}
    matrix = lambda r: P._square([r[names[xs[i], xs[j]]] for i, j in P.cells(k)], k)
    for name in ("exact", "unknown"):
        assert not got[name].corrected and np.allclose(matrix(got[name]), [[9 + i + j for j in range(k)] for i in range(k)])
    assert got["easy"].draws == P.BATCH and got["easy"].accepted >= P.QUOTA
    assert got["never"].draws == P.DRAWS and got["never"].accepted == 0
    for name in ("easy", "hard", "never"):
        x, w, raw_noise = cells[name]
        observed, v = moments(x, w, raw_noise)
        signal = observed - raw_noise
        z = np.random.default_rng(9).standard_normal((400_000, len(v)))
        values, vectors = np.linalg.eigh(v)
        draws = z @ (vectors * np.sqrt(np.maximum(values, 0))).T + [signal[i, j] for i, j in P.cells(k)]
        mats = np.zeros((len(draws), k, k))
        for a, (i, j) in enumerate(P.cells(k)):
            mats[:, i, j] = mats[:, j, i] = draws[:, a]
        kept = mats[np.linalg.eigvalsh(mats)[:, 0] > 1e-10]
        share = len(kept) / len(mats)
        assert got[name].accepted / got[name].draws == pytest.approx(share, abs=4 * np.sqrt(max(share * (1 - share), 1e-5) / got[name].draws) + 1e-4)
        if name == "hard":
            assert 0 < share < 0.9
        mean = kept.mean(axis=0) if len(kept) else P.lifted(signal, P.LEAST)
        want = observed - P.inside(mean, observed)
        assert got[name].corrected and np.allclose(matrix(got[name]), want, atol=0.02 * np.abs(observed).max())
        assert np.linalg.eigvalsh(matrix(got[name])).min() > -1e-8 and np.linalg.eigvalsh(observed - matrix(got[name])).min() > -1e-8


def test_moments_of_the_aggregate(spark):
    rng = np.random.default_rng(6)
    noise = np.array([[0.3, 0.1], [0.1, 0.2]])
    x, w = built(rng, 30, 2, noise, np.eye(2))
    df, xs, raw, _ = frame(spark, {"s": (x, w, noise)})
    r = P.prepared_signals(df, ["spec"], xs, "w", raw).first()
    observed, v = moments(x, w, noise)
    assert np.allclose(r.observed, [observed[i, j] for i, j in P.cells(2)]) and np.allclose(r.signal, [(observed - noise)[i, j] for i, j in P.cells(2)])
    root = np.array(r.root).reshape(3, 3)
    assert np.allclose(root @ root.T, v)
