"""Exact and near dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import exact_dedup, near_dedup
from scoreloom.llm.components import components

from rows import EDGE

STRIP = {ord(c): None for c in exact_dedup.SPACE}


def exact_by_hand(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(STRIP)].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for i, text in rows:
        norm = (text or "").translate(STRIP)
        keep = min(groups[norm], key=lambda x: x[:3])[3]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run_rows", [1, 2, 1_000_000])
def test_exact_edges(edge, run_rows):
    got = exact_dedup.exact_duplicates(edge, run_rows=run_rows).collect()
    assert sorted(map(tuple, got), key=repr) == exact_by_hand([(r[0], r[1]) for r in EDGE])


def test_exact_small(small):
    got = exact_dedup.exact_duplicates(small, run_rows=37, owners=5).collect()
    assert sorted(map(tuple, got), key=repr) == exact_by_hand([(r.doc_id, r.text) for r in small.collect()])


def test_exact_drop_keeps_columns(edge):
    kept = exact_dedup.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns
    # 2 repeats the text of 1; 3 differs in case; 5 and 6 are both empty, and the longer original stays.
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 7, 8, 9, 10]


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**56 - 1), min_size=1, max_size=200), st.integers(0, 50))
def test_golomb_round_trip(values, low_bits):
    values = np.unique(np.array(values, dtype=np.uint64))
    low_bits = max(low_bits, exact_dedup.rice_bits(len(values), 1 << 56) - 2)
    payload = exact_dedup.golomb_encode(values, low_bits)
    assert (exact_dedup.golomb_decode(payload, len(values), low_bits) == values).all()


def near_by_hand(rows, size):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_family(make_docs, size):
    """Copies of copies with changed words, so that many pairs of a bucket are not linked."""
    source = random.Random(7)
    base = [f"word{i}" for i in range(60)]
    rows, texts = [], [base]
    for i in range(120):
        words = list(source.choice(texts))
        for _ in range(source.randrange(0, 3)):
            words[source.randrange(len(words))] = f"new{source.randrange(10_000)}"
        texts.append(words)
        rows.append((i, " ".join(words)))
    rows += [(500, "a b"), (501, "A  b"), (502, None), (503, " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make_docs(rows), size).collect()}
    assert got == near_by_hand(rows, size)


def test_near_edges(edge):
    got = near_dedup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == by_id[3].component_id == 1 and not by_id[2].kept
    assert by_id[9].component_id == 8
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept and by_id[i].component_id == i for i in (4, 5, 6))
    assert near_dedup.drop_near_duplicates(edge).where("doc_id IS NULL").count() == 2


def test_blocks_of_buckets(make_docs, monkeypatch):
    """Buckets cut into many blocks give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 150)
    test_near_family(make_docs, 4)


def test_pigeonhole():
    """Signatures within the distance have a key in common."""
    signer, source = near_dedup.Signer(), np.random.default_rng(3)
    limit = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(50):
        one = source.integers(0, 1 << near_dedup.BITS, near_dedup.CHUNKS * near_dedup.CHUNK, dtype=np.uint64)
        other = one.copy()
        at = source.choice(len(one), limit, replace=False)
        other[at] ^= np.uint64(1)
        assert set(signer.keys(one)) & set(signer.keys(other))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in [*range(41), 100]) and all(got[i] == 200 for i in (200, 201, 202))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_an_id_with_several_texts(make_docs, flip):
    """Every text of an id takes part in links, in whatever order its rows come."""
    one, other = ([f"{c}{i}" for i in range(50)] for c in "ab")
    rows = [(5, " ".join(one)), (5, " ".join(other)), (7, " ".join([*other, "z"])), (9, " ".join([*one, "z"])), (11, "quite another text of some words")]
    docs = make_docs(rows[::-1] if flip else rows)
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()})
    assert got == [(5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)]
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()) == [5, 11]


def test_repeated_ids_leave_one_row(make_docs):
    rows = [(1, "x y"), (1, "x y"), (1, "x  y"), (0, "q"), (1, "q"), (2, None), (2, ""), (None, "x y"), (None, "w"), (None, "w")]
    kept = exact_dedup.drop_exact_duplicates(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(0, "q"), (1, "x  y"), (2, kept_text(kept, 2)), (None, "w")], key=repr)
    near = near_dedup.drop_near_duplicates(make_docs(rows)).collect()
    # Rows without an id are left alone, as are texts that are no near-copies.
    assert sorted((r.doc_id for r in near), key=repr) == sorted([0, 2, None, None, None], key=repr)


def kept_text(rows, doc_id):
    return next(r.text for r in rows if r.doc_id == doc_id)


def test_recall_near_the_threshold(make_docs):
    """Thousands of pairs of a similarity of 0.80 to 0.85, every one of them found."""
    source = random.Random(11)
    rows, want = [], 0
    for k in range(2500):
        words = [f"k{k}w{i}" for i in range(80)]
        changed = list(words)
        at = source.randrange(4, 70)
        for i in range(source.choice([2, 3, 4])):
            changed[at + i] = f"new{k}x{i}"
        one, other = ({tuple(w[i : i + 5]) for i in range(76)} for w in (words, changed))
        similarity = len(one & other) / len(one | other)
        assert 0.8 <= similarity <= 0.86, similarity
        want += 1
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    got = near_dedup.near_duplicates(make_docs(rows))
    assert got.where("component_id = doc_id - 1 AND doc_id % 2 = 1").count() == want
    assert got.where("kept").count() == want
