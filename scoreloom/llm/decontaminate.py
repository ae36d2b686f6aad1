"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive k-gram hashes the smallest is a
fingerprint (the last of equals). A passage of ``WINDOW`` words that a document
shares with a benchmark item has a fingerprint of both at the same place, so
joining fingerprints misses none. Each joined fingerprint is extended to the
windows around it, which are compared word by word. Items of fewer words are one
window; a fingerprint of their own length is kept at every place.

The benchmark is split into blocks of ``BLOCK_BYTES`` of text. One block at a
time is broadcast and all documents pass by it, so no document is shuffled and
what a task holds does not grow with the benchmark.

Defined cases: null and wordless texts have no words and no windows. Items with
the same ``item_id`` are one item; windows of an item whose id is null hit
words, but it is not counted. Repeated document rows each get their own result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import gram_hashes, release, stored, text_bytes, word_hashes

WINDOW = 10
GRAM = 6
# A block's text is broadcast; its tables in a task take some 40 times as much.
BLOCK_BYTES = 4_000_000

# Fixed value: bytes that are no word bytes become blanks, A-Z become a-z.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of every ``span`` consecutive ones, the last of equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for k in range(1, span):
        later = grams[k : n + k]
        better = np.flatnonzero(later <= least)
        least[better] = later[better]
        place[better] = better + k
    return place[np.diff(place, prepend=-1) != 0]  # they ascend


class Block:
    """Windows of some benchmark items, by length, with the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.windows: dict[bytes, set] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(window, len(words))
            for at in range(len(words) - size + 1):
                self.windows.setdefault(b" ".join(words[at : at + size]), set()).add(item)
            short = size < window
            grams = gram_hashes(word_hashes(words), size if short else gram)
            prints.setdefault(size, []).append(grams[winnow(grams, 1 if short else window - gram + 1)])
        self.prints = {size: np.unique(np.concatenate(parts)) for size, parts in prints.items()}

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[int], set]]:
        """For each text, given as its words: starts and ends of the runs of hit words, and the items they are from.

        The texts are laid end to end. A gram over the end of one may become a
        fingerprint, but windows are only looked for inside a text.
        """
        ends = np.cumsum([len(words) for words in texts]).tolist()
        words = [word for text in texts for word in text]
        hit, items = np.zeros(len(words), dtype=bool), [set() for _ in texts]
        hashes = word_hashes(words)
        for size, wanted in self.prints.items():
            gram = min(size, self.gram) if size == self.window else size
            grams = gram_hashes(hashes, gram)
            places = winnow(grams, size - gram + 1)
            slot = np.minimum(np.searchsorted(wanted, grams[places]), len(wanted) - 1)
            places = places[wanted[slot] == grams[places]].tolist()
            starts = {at for place in places for at in range(place + gram - size, place + 1)}
            for at in starts:
                text = bisect.bisect_right(ends, at)
                begin = ends[text - 1] if text else 0
                if at < begin or text == len(ends) or at + size > ends[text]:
                    continue
                found = self.windows.get(b" ".join(words[at : at + size]))
                if found:
                    hit[at : at + size] = True
                    items[text] |= found
        out, begin = [], 0
        for end, found in zip(ends, items):
            runs = np.flatnonzero(np.diff(hit[begin:end].astype(np.int8), prepend=0, append=0)).tolist() if found else []
            out.append((runs, found))
            begin = end
        return out


def union_runs(one: list[int], other: list[int]) -> list[int]:
    """Runs ``[start, end, ...]`` covered by either list."""
    if not one or not other:
        return one or other
    merged: list[int] = []
    for start, end in sorted(zip(one[::2] + other[::2], one[1::2] + other[1::2])):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _matcher(shared):
    """``(n_words, hit, items)`` of ``(text, hit, items)``, the last two with what was found before; hit words are starts and ends of runs of words."""
    built = []
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    @F.arrow_udf("struct<n_words:long,hit:array<int>,items:array<string>>")
    def match(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        if not built:
            built.append(Block(shared.value))
        for whole in batches:
            found = []
            for at in range(0, len(whole[0]), 100):
                text, hit, items = (column.slice(at, 100) for column in whole)
                texts = [words_of(t) for t in text_bytes(text)]
                for words, (runs, names), old_runs, old_names in zip(texts, built[0].hits(texts), hit.to_pylist(), items.to_pylist()):
                    named = sorted(set(old_names) | {str(i) for i in names if i is not None})
                    found.append({"n_words": len(words), "hit": union_runs(old_runs, runs), "items": named})
            yield pa.array(found, kind)
            release()

    return match


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's items, distinct, in blocks dealt by hash; an empty benchmark is one empty block."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r["item_id"], r["text"].encode()) for r in items.where(place == k).collect()]


def _matched(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """``docs`` with columns ``n_words``, ``hit`` and ``items`` added; only texts and hits go to Python."""
    state = docs.select("*", F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    passes = 0
    for items in _blocks(benchmark, block_bytes):
        state = stored(state, "decontamination") if passes else state
        match = _matcher(docs.sparkSession.sparkContext.broadcast(items))
        state = state.withColumn("found", match("text", "hit", "items")).select(*docs.columns, "found.*")
        passes += 1
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit, items)`` for each row of ``docs(doc_id, text)``.

    ``hit`` lists starts and ends (exclusive) of the runs of hit words, ``items`` the items.
    """
    found = _matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, block_bytes)
    runs = F.expr("filter(hit, (x, i) -> i % 2 = 1)"), F.expr("filter(hit, (x, i) -> i % 2 = 0)")
    total = [F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x) for r in runs]
    n_hit = total[0] - total[1]
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hit",
        "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without a word hit; no row is moved."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return _matched(packed, benchmark, block_bytes).where(F.size("hit") == 0).select("row.*")
