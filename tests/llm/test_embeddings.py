import numpy as np
import pytest

from docloom.llm import embeddings


def brute(rows, threshold=0.9):
    usable = [k for k, (_, v, *_) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in usable:
        for b in usable:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    return links


@pytest.mark.parametrize(("cell", "blocks"), [(5000, 1), (2, 2), (0.01, 3)])
def test_near_duplicates(spark, monkeypatch, cell, blocks):
    """At each layout: recall against brute force, cell blocks, and rows that can't link."""
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "CELL", cell)
    assert embeddings.layout(300, 32) == blocks
    rng = np.random.default_rng(3)
    d = 32
    base = rng.normal(size=(20, d))
    rows = []
    for i in range(300):
        v = base[i % 20] * rng.uniform(0.1, 9) + rng.normal(size=d) * (0.1 if i % 3 else 0.25)
        rows.append((i, [float(np.float32(x)) for x in v], "c"))
    rows += [(400, None, ""), (401, [], ""), (402, [0.0] * d, ""), (403, [float("nan")] * d, ""), (404, [1.0] * (d - 1) + [float("inf")], ""), (405, [None] * d, ""), (406, rows[0][1][:7], ""), rows[5], (None, rows[6][1], "")]
    rows += [(500 + i, rows[7][1], "") for i in range(60)]  # a common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _row string").repartition(3)
    links = brute(rows)
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    found, there = sum(r.n_links for r in got), sum(map(len, links.values()))
    assert 0.97 * there <= found <= there
    linked = {rows[k][0] for k, v in links.items() if v}
    single = {i for i, *_ in rows} - linked
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id in single)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_pairs_of_the_threshold_meet(blocks):
    rng = np.random.default_rng(blocks)
    d, n = 64, 4000
    x, y = pairs_of_cosine(rng, d, n)
    met = np.zeros(n, bool)
    for t in range(embeddings.TABLES[blocks]):
        cx, cy = (embeddings._cells(v @ embeddings._rotation(d, t + 1), blocks, embeddings.VISITS[blocks]) for v in (x, y))
        met |= (cx == cy[:, :1]).any(axis=1) | (cy == cx[:, :1]).any(axis=1)
    assert met.mean() >= 0.985


def pairs_of_cosine(rng, d, n, cosine=0.9):
    x, z = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    for d in (24, 64, 100):
        x, y = pairs_of_cosine(rng, d, 600)
        q = embeddings.encode(x)
        q, c = embeddings._all(q, 1), embeddings._all(embeddings.encode(y), 0)
        both, true = embeddings.estimate(q, c, d), x @ y.T
        assert abs((both - true).mean()) < 0.005 and abs(np.diag(both).mean() - 0.9) < 0.015
        assert (embeddings.upper(q, c, d, 4.0) >= true).mean() > 0.9998 and (np.diag(embeddings.upper(q, c, d, 4.0)) >= 0.9).all()
        r = y @ embeddings._rotation(d, 0)
        assert np.allclose(c["f"][0], (r * np.where(r < 0, -1, 1)).sum(axis=1) / np.sqrt(d)) and c["code"].shape[-1] == -(-d // 64)
