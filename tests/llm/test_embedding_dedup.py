import numpy as np
import pytest

from graphloom.llm.embedding_dedup import COSINE, MARGIN, codewords, decode, near_vectors


def brute(rows, cosine=0.98):
    sound = {i: (x, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    links = {i: set() for i, _, _ in rows}
    for a, (x, u) in sound.items():
        for b, (y, w) in sound.items():
            if a != b and x == y and len(u) == len(w) and u @ w >= cosine:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen))
    return out


def recall(spark, rows, **more):
    got = {r.id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **more).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] and got[i].kept == (got[i].component_id == i) for i in want)
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.98 * len(want)
    return (1 + sum(r.n_links for r in got.values())) / (1 + sum(n for n, _ in want.values()))


def near_copies(rng, centres, copies, size, lo=0.975, hi=0.99):
    """Random directions, and vectors beside them at cosines around the threshold."""
    centre = rng.normal(size=(centres, size))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    near = [centre]
    for _ in range(copies):
        aside = rng.normal(size=centre.shape)
        aside -= (aside * centre).sum(1, keepdims=True) * centre
        cosine = rng.uniform(lo, hi, (centres, 1))
        near.append(cosine * centre + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True))
    return np.vstack(near)


def test_recall_on_near_copies(spark):
    """Against all cosines: thousands of links at and about the threshold, one label with half of all rows."""
    rng = np.random.default_rng(5)
    vectors = near_copies(rng, 1200, 3, 64).astype(np.float32)
    label = np.where(rng.random(len(vectors)) < 0.5, 1, rng.integers(2, 5, len(vectors)))
    label[1200:] = label[np.arange(len(vectors) - 1200) % 1200]
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (((unit @ unit.T) >= 0.98) & (label[:, None] == label)).sum(1) - 1
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, label))]
    got = {r.id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found, there = sum(got.values()), int(want.sum())
    print("links found", found, "of", there)
    assert there > 3000 and all(got[i] <= want[i] for i in got) and found >= 0.97 * there


@pytest.mark.parametrize("size, counts", [(64, (2_000, 20_000, 50_000)), (768, (2_000, 20_000))])
def test_pairs_compared_against_all(size, counts):
    """Pairs that meet in a filter are few beside all pairs and grow little faster than the vectors; pairs at the least cosine meet."""
    compared = []
    for n in counts:
        unit = near_copies(np.random.default_rng(n), n // 2, 1, size, 0.98, 0.985)
        parts = [decode(unit[at : at + 512], codewords(n), MARGIN, COSINE) for at in range(0, n, 512)]
        row = np.concatenate([r + 512 * k for k, (r, _) in enumerate(parts)])
        filt = np.concatenate([f for _, f in parts])
        in_filter = np.unique(filt, return_counts=True)[1].astype(float)
        compared.append((in_filter * (in_filter - 1) / 2).sum())
        lists = np.split(filt, np.cumsum(np.bincount(row, minlength=n))[:-1])
        met = np.mean([len(np.intersect1d(lists[i], lists[i + n // 2])) > 0 for i in range(n // 2)])
        print(size, n, "filters a vector", len(row) / n, "compared share", compared[-1] / (n * (n - 1) / 2), "recall", met)
        assert compared[-1] < 0.1 * n * (n - 1) / 2 and met >= 0.95
    assert np.log(compared[-1] / compared[0]) / np.log(counts[-1] / counts[0]) < 1.5


def test_cells_and_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 32))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 4] + rng.normal(size=32) * 0.08], 1 + i % 2) for i in range(300)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    assert recall(spark, rows, cell=16) >= 0.97


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, -0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [3.0, 0.1], 1), (12, [1.0, 0.0], 2)]
    assert recall(spark, rows) == 1
    twice = spark.createDataFrame([*rows, rows[6], (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as rep", "1 as filter")
    got = near_vectors(twice).collect()
    assert len(got) == 14 and [r.n_links for r in got if r.id == 7] == [2, 2] and [(r.component_id, r.kept) for r in got if r.id is None] == [(None, True)]
    assert near_vectors(twice.limit(0)).count() == 0
