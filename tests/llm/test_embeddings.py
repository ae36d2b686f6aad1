"""E8 lattice hashing against brute force over all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import types as T

from scoreloom.llm import embedding_dedup as ed

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        # Names that the operator uses itself.
        *[T.StructField(name, T.StringType()) for name in ("label", "cls", "t", "cell", "n", "part", "kept", "component_id")],
    ]
)


@pytest.fixture(scope="session")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, x, *["extra"] * (len(VECTORS) - 2)) for i, x in rows], VECTORS).repartition(3)

    return make


def at_cosine(generator, vector, cosine):
    """A unit vector at exactly this cosine of a unit vector."""
    other = generator.normal(size=len(vector))
    other -= (other @ vector) * vector
    return cosine * vector + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def unit(generator, width=64):
    x = generator.normal(size=width)
    return x / np.linalg.norm(x)


def by_hand(rows):
    """``{place: (n_links, component_id)}`` from the cosines of all pairs."""
    usable = {}
    for k, (_, x) in enumerate(rows):
        if x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, dtype=np.float32).astype(float)
            usable[k] = v / np.linalg.norm(v)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(usable, 2):
        if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= ed.COSINE:
            links[a] += 1
            links[b] += 1
            parent[find(b)] = find(a)
    least = {}
    for k in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least[k] = min(ids, default=None)
    return [(rows[k][0], links[k], least[k], rows[k][0] == least[k]) for k in range(len(rows))]


def found(df, **options):
    return sorted(map(tuple, ed.near_duplicate_vectors(df, **options).collect()), key=repr)


def planted(count=250, seed=5):
    """Singles, groups of near copies, and chains whose ends are not linked themselves."""
    generator = np.random.default_rng(seed)
    vectors = [unit(generator) for _ in range(count)]
    for _ in range(count):
        vectors.append(at_cosine(generator, vectors[generator.integers(len(vectors))], generator.uniform(0.93, 1.0)))
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(vectors)]


def test_against_all_pairs(make_vectors):
    rows = planted()
    want = sorted(by_hand(rows), key=repr)
    assert sum(r[1] for r in want) > 500
    assert found(make_vectors(rows)) == want


def test_hot_cells_in_blocks(make_vectors, monkeypatch):
    """One vector's near copies fill cells beyond both bounds; copies of one vector are a class; nothing is lost."""
    generator = np.random.default_rng(2)
    base = unit(generator)
    rows = [(i, at_cosine(generator, base, 0.985).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, unit(generator).astype(np.float32).tolist()) for i in range(50)]
    monkeypatch.setattr(ed, "BLOCK_ROWS", 70)
    assert found(make_vectors(rows)) == sorted(by_hand(rows), key=repr)


def test_edges(make_vectors):
    generator = np.random.default_rng(3)
    one, other = unit(generator).tolist(), unit(generator).tolist()
    rows = [
        (1, None), (2, []), (3, [0.0] * 64), (4, [None, 1.0]), (5, [float("nan")] * 64), (6, [float("inf"), 1.0]),
        # Twice the length is the same direction; another width is another space.
        (7, one), (8, [2 * v for v in one]), (9, [1.0]), (10, [3.0]), (11, [1e38, 1e38]), (12, [1e-38, 1e-38]), (13, [-1.0]),
        # Repeated ids with different vectors, repeated rows and rows without an id.
        (20, one), (20, other), (21, other), (21, other), (None, other), (None, None), (None, [0.5, -0.5]),
    ]
    assert found(make_vectors(rows)) == sorted(by_hand(rows), key=repr)
    assert found(make_vectors([])) == []


def test_drop_keeps_columns(make_vectors):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, None)]
    kept = ed.drop_near_duplicate_vectors(make_vectors(rows))
    assert kept.columns == VECTORS.names
    assert sorted(r.vec_id for r in kept.collect()) == [1, 3, 4]


def test_decoding_is_nearest():
    """No lattice point within two shells of the decoded one is nearer, and the roots are the 240 shortest."""
    roots = ed.lattice_roots()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    further = np.unique((roots[:, None] + roots[None]).reshape(-1, 8), axis=0)
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    point = ed.decode(x)
    least = ((x - point) ** 2).sum(axis=1)
    doubled = np.rint(point * 2)
    assert np.allclose(point * 2, doubled) and ((doubled % 2).ptp(axis=1) == 0 if hasattr(doubled, "ptp") else (np.ptp(doubled % 2, axis=1) == 0)).all()
    assert (np.rint(point.sum(axis=1)) % 2 == 0).all() and np.allclose(point.sum(axis=1), np.rint(point.sum(axis=1)))
    for moved in (roots, further):
        assert ((((x - point)[:, None] - moved[None]) ** 2).sum(axis=2) >= least[:, None] - 1e-9).all()


@pytest.mark.parametrize("cosine, least", [(0.9001, 0.98), (0.93, 0.997), (0.95, 0.999)])
def test_recall_by_cosine(cosine, least):
    """Share of pairs at a given cosine that meet in some cell."""
    generator = np.random.default_rng(7)
    one = np.stack([unit(generator) for _ in range(3000)])
    other = np.stack([at_cosine(generator, x, cosine) for x in one])
    hasher = ed.Hasher(64, ed.TABLES, ed.BLOCKS, ed.PROBES, ed.SCALE)
    a, b = hasher.cells(one), hasher.cells(other)
    met = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
    sketches = hasher.sketches(one) ^ hasher.sketches(other)
    near = np.bitwise_count(sketches.view(np.uint64)) <= ed.SKETCH_NEAR
    assert (met & near).mean() >= least
