"""Held-out accuracy of language identification, and its defined cases."""

import zlib

import pytest
import zstandard

from rows import EDGE
from scoreloom.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.93 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"} for r in got)


def test_edges(edge, small):
    content = language.learn(small)
    found = language.identify(edge, content)
    rows = found.select("row.*", "lang_found.*").collect()
    assert len(rows) == len(EDGE) and found.select("row.*").columns == edge.columns
    by_id = {r.doc_id: r for r in rows}
    for i in (4, 5, 6):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected
    assert by_id[1].lang_pred == "en" and not by_id[1].rejected


def test_sample_is_bounded_and_counts_copies_once(make_docs):
    docs = make_docs([(i, "the same text " * 20, "en") for i in range(50)] + [(100 + i, f"otro texto {i} " * 20, "es") for i in range(50)])
    content = language.learn(docs, texts=5)
    assert len(content["en"]) == len("the same text " * 20)
    assert content["es"].count(b"\n") == 4


def test_one_language_and_none(make_docs, empty):
    content = language.learn(make_docs([(1, "just one language here " * 20, "en")]))
    assert language.Classifier(content).classify(b"whatever") == ("en", 1.0)
    assert language.identify(empty, content).count() == 0
    with pytest.raises(ValueError):
        language.learn(empty)


def test_any_text_lengths(make_docs):
    """Languages that have only short, only few or only very long texts are learned, within the bound on bytes."""
    words = {"a": "amber lantern meadow quiet winter", "b": "zorgt vlieger kamer huisje molen", "c": "puente ventana ciudad camino verano", "d": "xqo"}
    short = [(i, f"{w} {i}", lang) for lang, n in (("a", 40), ("d", 1)) for i, w in enumerate([words[lang]] * n)]
    long = [(1000 + i, f"{words['b']} {i} " * 3000, "b") for i in range(3)]
    some = [(2000 + i, f"{words['c']} {i} " * n, "c") for i, n in enumerate([10, 1, 1000])]
    content = language.learn(make_docs([*short, *long, *some, (3000, "12 34", "e")]), texts=5)
    assert set(content) == {"a", "b", "c", "d"} and all(0 < len(c) <= 5 * language.SAMPLE_BYTES[1] for c in content.values())
    assert content["a"].count(b"\n") == 39 and len(content["b"]) > 19_000 and content["c"].endswith(f"{words['c']} 0 ".encode())
    judge = language.Classifier(content)
    assert [judge.classify(words[lang].encode())[0] for lang in "abc"] == ["a", "b", "c"]


def test_many_short_texts_are_drawn(make_docs):
    content = language.learn(make_docs([(i, f"brief text {i}", "en") for i in range(3000)]), texts=2)
    assert 7_900 <= len(content["en"]) <= 8_000


def test_no_labels(make_docs, empty):
    content = language.learn(empty, required=False)
    rows = language.identify(make_docs([(1, "some words to read"), (2, None)]), content).select("lang_found.*").collect()
    assert content == {} and [tuple(r) for r in rows] == [("und", 0.0, True)] * 2


def test_query_without_labels(spark, make_docs, tmp_path):
    make_docs([(1, "short title", None), (2, "another one", None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_language_id(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got) == [(1, "und", 0.0), (2, "und", 0.0)]


def test_predictions_by_plain_library_calls(small):
    """The smallest size of every text, by a new compressor for each block, gives the query's answer."""
    content = language.learn(small)
    rows = language.identify(small, content).select("row.text", "lang_found.*").collect()
    assert len(content) > 1

    def size(text, lang):
        sample, total = language.letters_of(content[lang]), 0
        for at in range(0, len(text), language.BLOCK):
            words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                language.LEVEL, dict_size=len(sample), source_size=language.BLOCK, min_match=4, write_content_size=False, write_checksum=False,
                write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            total += len(zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress(text[at : at + language.BLOCK]))
        return total

    for r in rows[:80]:
        text = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        (least, lang), (second, _) = sorted((size(language.letters_of(text), lang), lang) for lang in content)[:2]
        assert r.lang_pred == lang and r.score == pytest.approx(1 - least / second)
