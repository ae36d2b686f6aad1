"""Spelling variants against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import spelling as sp


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, damage=sp.DAMAGE, letters=sp.LETTERS, least=sp.OCCURRENCES):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def by_hand(rows, **options):
    words = counted(rows, **options)
    form, n_near = {}, {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        n_near[w] = len(near)
        form[w] = best if best and words[best] >= sp.RATIO * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed, families=25):
    """Words with variants of variants, each rarer than what it came from."""
    source = random.Random(seed)
    letters = "abcdeéßÿ"
    texts, doc = [], 0
    for _ in range(families):
        word, n = "".join(source.choice(letters) for _ in range(source.randrange(6, 14))), 700
        while n >= 3:
            texts += [(doc + k % 7, " ".join([word.title() if k % 3 else word] * (n // 7 + 1))) for k in range(7)]
            for _ in range(2):
                at = source.randrange(len(word) + 1)
                kind = source.randrange(3)
                other = word[:at] + (source.choice(letters) if kind else "") + word[at + (kind != 1) :]
                texts.append((doc, f"{other}, " * source.randrange(3, 9)))
            word, n, doc = other, n // source.choice([3, 6]), doc + 10
    return texts


@pytest.mark.parametrize("limit", [2, 5, sp.LIST_WORDS])
def test_against_all_pairs(make_docs, limit):
    """The same whether lists are scanned at once or cut again and again."""
    rows = corpus(limit)
    got = sorted(map(tuple, sp.spelling_variants(make_docs(rows), limit=limit).collect()))
    want = by_hand(rows)
    assert got == want
    assert any(root != form for _, form, root, *_ in want if form)


def test_long_lists_are_cut(make_docs):
    """Hundreds of words that share their first and last letters."""
    source = random.Random(1)
    words = {"".join(["common", *(source.choice("abcd") for _ in range(5)), "ending"]) for _ in range(400)}
    rows = [(i, " ".join([w] * 5)) for i, w in enumerate(sorted(words))]
    got = sorted(map(tuple, sp.spelling_variants(make_docs(rows), limit=20).collect()))
    assert got == by_hand(rows)


def test_edges(make_docs, edge, empty):
    rows = [
        (1, "letters " * 5 + "lettres! " * 2), (1, "letters " * 5), (2, None), (3, ""), (4, "\n\t "), (None, "lettrs " * 9),
        (5, "ÀÉÎÕÜß àéîõüß " * 5), (6, "short " * 50), (7, "x" * 50_000 + " "), (7, ("x" * 50_000 + " ") * 6), (8, "×÷×÷×÷ " * 6), (9, "ﬁnally Ἀλφα " * 6),
    ]
    assert sorted(map(tuple, sp.spelling_variants(make_docs(rows)).collect())) == by_hand(rows)
    again = [(r[0], r[1]) for r in edge.collect()]
    assert sorted(map(tuple, sp.spelling_variants(edge).collect())) == by_hand(again)
    assert sp.spelling_variants(empty).count() == 0
    assert sp.spelling_variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_every_run_damaged(make_docs):
    rows = [(i, "abcdefg abcdefgh abcdefghi " * 6) for i in range(12)]
    got = sorted(map(tuple, sp.spelling_variants(make_docs(rows), damage=1).collect()))
    assert got == by_hand(rows, damage=1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", max_size=6), min_size=1, max_size=40, unique=True), st.text("abé", max_size=6))
def test_scan_of_a_list(words, query):
    words = sorted(words)
    shared = [0] + [sp._shared(a, b) for a, b in zip(words, words[1:])]
    assert [words[i] for i in sp.near_words(query, words, shared)] == [w for w in words if one_edit(query, w)]
