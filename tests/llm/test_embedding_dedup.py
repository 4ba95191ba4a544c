"""Near vectors by spherical caps against all pairs, with the awkward rows."""

import duckdb
import numpy as np
import pytest

from lodeframe.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, Kept int"


def plain(ids, vectors, least=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    units = []
    for v in vectors:
        x = None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float64)
        units.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    n = len(units)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [j for k in [todo.pop()] for j in near[k] if j not in seen]
            seen.update(new)
            todo += new
        root[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return sorted(((ids[i], len(near[i]), root[i], ids[i] is not None and ids[i] == root[i]) for i in range(n)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def around(rng, centre, n, angle):
    """n vectors at about `angle` from the centre."""
    e = rng.standard_normal((n, len(centre)))
    e -= (e @ centre)[:, None] * centre
    e /= np.linalg.norm(e, axis=1)[:, None]
    return np.cos(angle) * centre + np.sin(angle) * e


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24)).astype(np.float32)
    vectors = [v.tolist() for v in base]
    vectors += [(base[0] * 3).tolist(), (base[0] * 1e30).tolist(), (base[1] * 1e-30).tolist(), base[2].tolist(), base[2].tolist(), (-base[3]).tolist()]
    vectors += [None, [], [0.0] * 24, [None, *base[4][1:].tolist()], [float("nan"), *base[5][1:].tolist()], [float("inf"), *base[6][1:].tolist()]]
    vectors += [[1.0], [2.0], [-1.0], [1.0, 0.0], [0.99, 0.1], [1.0] * 24 + [0.0]]
    vectors += around(rng, base[7] / np.linalg.norm(base[7]), 40, 0.12).astype(np.float32).tolist()
    ids = [*range(len(vectors))]
    ids[10], ids[61], ids[63] = None, None, 12
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    assert result(ed.near_vectors(df)) == plain(ids, vectors)
    assert ed.near_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ed.near_vectors(df, least=1.0)


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_at_all_distances(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    limit = np.arccos(0.95)
    groups = [around(rng, c, 120, a) for c, a in zip(centres, (0.001, 0.1, limit / 2, limit * 0.75, limit, 1.2 * limit), strict=True)]
    vectors = np.concatenate([*groups, rng.standard_normal((300, 32))]).astype(np.float32)
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in zip(ids, vectors.tolist(), strict=True)], SCHEMA)
    got, want = result(ed.near_vectors(df)), plain(ids, vectors.tolist())
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # none below the bound
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


@pytest.mark.parametrize("dim,n", [(64, 50_000), (64, 10_000_000), (16, 50_000), (3, 1000)])
def test_pairs_at_the_bound_share_a_filter(dim, n):
    caps = ed.Caps(dim, n, 0.95, ed.HELD, ed.SHARED, ed.CODES)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.concatenate([around(rng, v, 1, np.arccos(0.95)) for v in x])
    (a, f, score), (b, g, _) = caps.decode(x), caps.decode(y)
    assert np.mean([bool(set(f[a == k]) & set(g[b == k])) for k in range(400)]) >= 0.9
    assert score.min() >= caps.alpha - 1e-9 and len(f) < 400 * 200
    # Every filter that exceeds alpha is listed: tried for the first vector by going through all names.
    if caps.blocks == 2:
        found = 0
        for turn, words in caps.codes:
            turned = (x[:1] @ turn).reshape(1, caps.blocks, -1)
            s = np.einsum("nbd,bwd->bnw", turned, words)[:, 0]
            found += int((s[0][:, None] + s[1][None, :] >= caps.alpha).sum())
        assert abs(found - int((a == 0).sum())) <= 1


def test_op11_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = plain([r[0] for r in rows], [list(r[1]) for r in rows])
    assert sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ed.OP11_SQL})").fetchall(), key=repr) == want
    assert result(ed.op11_near_vectors(spark, sf)) == want
