"""BPE and token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from rows import EDGE
from scoreloom.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b1", " ", "  ", "\n", "\t", "é", "　", "\x1c", "\xa0", "'s", ".", "😀", "the", "1", "▁", "ing", " t", "́"]


def random_texts(n, seed):
    source = random.Random(seed)
    return ["".join(source.choice(PARTS) for _ in range(source.randrange(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(open(PIECES, "rb").read())


def test_bpe_as_library(coder, library):
    for text in [*random_texts(4000, 1), "<|endoftext|>", "x" * 5000, *(chr(c) + "a " + chr(c) for c in range(0, 0x3000, 7))]:
        ids = coder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
        assert "".join(coder.decode_text(ids.tolist())) == text


def test_table_is_bounded(coder, library, monkeypatch):
    """Words and pieces together stay within the bound, also within one text; long words are not kept."""
    monkeypatch.setattr(bpe, "TABLE_WORDS", 1000)
    monkeypatch.setattr(coder, "table", {})
    monkeypatch.setattr(coder, "pieces", {})
    long = "y" * 3000
    texts = [" ".join(f"w{i}, v{chr(97 + i % 26) * (i % 30)}.{i}" for i in range(n, n + 2000)) + f" {long} {long}é-{long}" for n in (0, 700)]
    for text in texts:
        assert coder.encode(text).tolist() == library.encode_ordinary(text)
        assert len(coder.table) + len(coder.pieces) <= 1000
        assert max(map(len, [*coder.table, *coder.pieces])) <= bpe.WORD_LENGTH


def test_offsets_and_split_characters(coder):
    ids = coder.encode("aé😀x")
    assert coder.offsets("aé😀x", ids).tolist() == [[0, 1], [1, 2], [2, 3], [2, 3], [3, 4]]
    assert coder.decode_text(ids.tolist()) == ["a", "é", "", "😀", "x"]
    assert coder.decode_text(ids.tolist()[:3]) == ["a", "é", "�"]
    assert coder.split_count("aé😀x", ids) == 1 and coder.split_count("", ids[:0]) == 0


def test_offsets_and_splits_of_whole_texts(coder):
    """Offsets follow each other, and tokens between which a character is split share it."""
    for text in random_texts(500, 5):
        ids = coder.encode(text)
        offsets, split = coder.offsets(text, ids), 0
        for (_, end), (start, _) in zip(offsets.tolist(), offsets.tolist()[1:]):
            assert start in (end, end - 1)
            split += start < end
        assert coder.split_count(text, ids) == split
        assert not len(ids) or (offsets[0, 0], offsets[-1, 1]) == (0, len(text))


def test_every_byte_is_read_back(coder):
    every = bytes(range(256))
    ids = np.array([rank for token, rank in bpe.read_ranks(RANKS).items() if len(token) == 1])
    assert sorted(coder.decode(ids)) == list(every)


def test_bpe_edges(edge, library):
    got = bpe.encode_and_decode(edge, RANKS, public_tokenizers.PATTERN, extra=("ids", "decoded")).collect()
    want = []
    for i, text, _ in EDGE:
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        raw = (text or "").encode()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), ids, raw))
    plain = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got]
    assert sorted(plain, key=repr) == sorted(want, key=repr)


def test_every_prefix(counter):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*random_texts(1500, 2), " " * 60 + "a", "a" + " " * 45, "</s><s> <0x41>"]
    for text, changes in zip(texts, counter.prefixes(texts)):
        counts = token_counts.counts_of(changes)
        assert counts.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text
        for budget in (0, 1, 3):
            assert token_counts.longest_within(changes, budget) == max(i for i, n in enumerate(counts) if n <= budget)
        assert token_counts.count_at(changes, len(text) // 2) == counts[len(text) // 2]


def test_counts_edges(edge):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(edge, PIECES, budgets=(5,)).collect()
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in EDGE), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_empty_tables(empty):
    assert bpe.encode_and_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, PIECES).count() == 0
