"""Winnowing against a search for every window."""

import hashlib
import random
import re

import pytest

from rows import EDGE
from scoreloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(10, len(found))
        for at in range(len(found) - size + 1 if size else 0):
            windows.setdefault(tuple(found[at : at + size]), set()).add(item)
    out = []
    for i, text in docs:
        found, hit, names = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(found) - size + 1):
                match = windows.get(tuple(found[at : at + size]))
                if match is not None:
                    hit.update(range(at, at + size))
                    names |= {str(m) for m in match if m is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(found), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    source = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(source.choices(vocabulary, k=source.randrange(1, 30)))) for i in range(30)]
    items += [(3, "another text, of Item three, with more than ten words in it I hope"), (None, "an item without any id but with a good ten words in it"), (50, None), (51, "..."), (52, "same same same same same same same same same same same same")]
    docs = [(i, " ".join(source.choices(vocabulary, k=200))) for i in range(40)]
    docs += [(100 + i, "say " + text.upper().replace(" ", ", ") + " end") for i, (_, text) in enumerate(items) if text]
    docs += [(200, "same " * 500), (201, " ".join(items[0][1].split()[:9])), *[(r[0], r[1]) for r in EDGE]]
    return docs, items


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_against_all_windows(spark, make_docs, case, block_bytes):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(make_docs(docs), benchmark, block_bytes).drop("hit", "items")
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items)


def test_drop_keeps_rows_whole(spark, make_docs, case, empty):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(make_docs(docs), benchmark)
    assert kept.columns == empty.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in by_hand(docs, items) if not r[5]), key=repr)


def test_empty_sides(spark, edge, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(edge, nothing).collect()
    assert len(got) == len(EDGE) and not any(r.contaminated or r.n_items for r in got)
    assert decontaminate.contamination(empty, nothing).count() == 0


def test_every_window_of_ten_has_a_common_fingerprint():
    import numpy as np

    source = random.Random(1)
    for _ in range(300):
        shared = [b"%d" % source.randrange(4) for _ in range(10)]
        one, other = ([b"%d" % source.randrange(4) for _ in range(7)] + shared + [b"%d" % source.randrange(4) for _ in range(5)] for _ in range(2))
        marks = []
        for text in (one, other):
            grams = decontaminate.gram_hashes(decontaminate.word_hashes(text), decontaminate.GRAM)
            places = decontaminate.winnow(grams, decontaminate.WINDOW - decontaminate.GRAM + 1)
            marks.append({(int(p), int(grams[p])) for p in places if 7 <= p <= 11})
            assert (np.diff(places) > 0).all()
        assert marks[0] & marks[1]
