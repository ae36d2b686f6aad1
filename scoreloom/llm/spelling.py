"""Spelling variants: words one edit apart, found by dynamic programming along sorted lists.

A list of words is sorted. For each of its words the edit matrix against the list's
words is filled row by row within a band of one around the diagonal; the next word
keeps the rows of the prefix it shares with the one before (their longest common
prefix), and once a row holds no value below two, all words with that prefix are skipped.

The vocabulary is cut into lists by pigeonhole: a word is split in three parts, and an edit leaves two of them as they are.
So each word goes into a list for each pair of parts (and once more as the longer
word of its pair, by the parts that a word with one letter less would have), and only the
third part, one edit apart, is compared along the list. A list of more than ``LIST_WORDS``
words is cut again in the same way, by the parts of its third parts, until it is short enough or the shorter of its
parts have one letter: with 90 different letters such a list has at most 90 + 90 * 90 words. No word is left out and no list is spelled out as pairs.

Words are counted per task before they are shuffled. Forms are followed to their
last by pointer doubling; every form is at least ``RATIO`` times as frequent, so this ends.

Defined cases: a null text has no words; a null id counts as the empty string; rows that repeat
are counted as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored, text_bytes, whole_groups

RUNS = re.compile("[a-zÀ-ÿ]+")
DAMAGE, LETTERS, OCCURRENCES, RATIO = 199, 6, 5, 5
# Words of a list that is scanned at once, and letters of the shorter parts from which on it is not cut again.
LIST_WORDS = 4096
LAST_PART = 1
# Different words that a task counts before it hands them on.
COUNTED = 200_000
_FAR = 2


def _damaged(word: str, start: int, every: int) -> str:
    """``word`` without one letter, if its checksum says so."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(letters: int, every: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def body(batches):
        total = Counter()

        def given():
            out = pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=schema)
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Only A-Z change in bytes.
                for word, n in Counter(RUNS.findall(text.lower().decode())).items():
                    word = _damaged(word, start, every)
                    if len(word) >= letters:
                        total[word] += n
                if len(total) > COUNTED:
                    yield given()
        if total:
            yield given()

    return body


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, damage: int = DAMAGE) -> DataFrame:
    """``(word, n)``: words of at least ``letters`` letters that occur at least ``occurrences`` times in ``docs(doc_id, text)``."""
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = slim.mapInArrow(_counts(letters, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _lists(words: DataFrame, shorter: list[Column]) -> DataFrame:
    """Rows ``(list, m, rest, word, n)``: the lists of ``words(list, rest, word, n)`` whose shorter words have ``shorter`` letters."""
    parts = F.explode(F.array(*shorter)).alias("m")
    cut = words.select("list", "rest", "word", "n", parts).withColumns(
        {"a": F.floor(F.col("m") / 3).cast("int"), "b": F.floor(F.col("m") * 2 / 3).cast("int"), "size": F.length("rest")}
    )

    def piece(start, length) -> Column:
        return F.substring("rest", start + 1, F.greatest(length, F.lit(0)))

    a, b, m, size = (F.col(c) for c in ("a", "b", "m", "size"))
    zero = F.lit(0)
    # What is equal, and what is left of the word: its first, middle or last part.
    choices = [
        (F.concat(F.lit("1"), piece(size - m + a, m - a)), piece(zero, size - m + a)),
        (F.concat(F.lit("2"), piece(zero, a), F.lit("/"), piece(size - m + b, m - b)), piece(a, size - m + b - a)),
        (F.concat(F.lit("3"), piece(zero, b)), piece(b, size - b)),
    ]
    lefts = [a, b - a, m - b]
    rows = F.inline(
        F.array(
            *[
                F.struct(F.concat_ws("/", "list", m.cast("string"), key).alias("list"), left.alias("m"), rest.alias("rest"))
                for (key, rest), left in zip(choices, lefts)
            ]
        )
    )
    return cut.select(rows, "word", "n")


def _shared(one: str, other: str) -> int:
    for i, (x, y) in enumerate(zip(one, other)):
        if x != y:
            return i
    return min(len(one), len(other))


def near_words(query: str, words: list[str], shared: list[int]) -> list[int]:
    """Places of the sorted ``words`` that are exactly one edit from ``query``; ``shared[i]`` letters begin both word i - 1 and word i.

    Row d of the matrix holds the distances of a prefix of d letters to the query's
    prefixes of d - 1, d and d + 1 letters; ``_FAR`` stands for all above one.
    """
    size, found = len(query), []
    rows = [(_FAR, 0, 1 if size else _FAR)]
    i, count = 0, len(words)
    while i < count:
        word = words[i]
        keep = shared[i] if i else 0
        if keep + 1 < len(rows):
            del rows[keep + 1 :]
        dead = False
        length = len(word)
        # A word with two letters more has no cell of the last column in its band.
        for d in range(len(rows), min(length, size + 1) + 1):
            before, same, after = rows[-1]
            letter = word[d - 1]
            x = min(before + (d < 2 or query[d - 2] != letter), same + 1) if d > 0 else _FAR
            y = min(same + (query[d - 1] != letter), after + 1, x + 1) if d <= size else _FAR
            z = min(after + (query[d] != letter), y + 1) if d < size else _FAR
            rows.append((x if x < _FAR else _FAR, y if y < _FAR else _FAR, z if z < _FAR else _FAR))
            if x >= _FAR and y >= _FAR and z >= _FAR:
                dead = True
                break
        if dead:
            depth = len(rows) - 1
            rows.pop()
            i += 1
            while i < count and shared[i] >= depth:
                i += 1
            continue
        if -1 <= size - length <= 1 and rows[length][size - length + 1] == 1:
            found.append(i)
        i += 1
    return found


def _scan(limit: int):
    """Of lists sorted by their rests: ``(word, other, n)`` for near words, and the rows of lists that are too long as they came."""
    schema = pa.schema(
        [("word", pa.string()), ("other", pa.string()), ("n", pa.int64()), ("list", pa.string()), ("m", pa.int32()), ("rest", pa.string())]
    )

    def body(batches):
        for batch, bounds in whole_groups(batches, ["list"], limit, lambda rows, start: rows.column("m")[start].as_py() <= LAST_PART):
            out = {c: [] for c in schema.names}
            every = {c: batch.column(c).to_pylist() for c in ("list", "m", "rest", "word", "n")}
            for start, end, whole in bounds:
                if not whole:
                    out["other"] += [None] * (end - start)
                    for c, values in every.items():
                        out[c] += values[start:end]
                    continue
                if end - start < 2:
                    continue
                m, rests = every["m"][start], every["rest"][start:end]
                shared = [0] + [_shared(x, y) for x, y in zip(rests, rests[1:])]
                pairs = []
                for q, query in enumerate(rests):
                    if len(query) == m:
                        # Words of one length are found from both sides, a longer one from the shorter only.
                        for k in near_words(query, rests, shared):
                            pairs.append((start + q, start + k))
                            if len(rests[k]) > m:
                                pairs.append((start + k, start + q))
                words, n = every["word"], every["n"]
                out["word"] += [words[q] for q, _ in pairs]
                out["other"] += [words[k] for _, k in pairs]
                out["n"] += [n[k] for _, k in pairs]
                for c in ("list", "m", "rest"):
                    out[c] += [None] * len(pairs)
            if out["word"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return body


def near_pairs(words: DataFrame, limit: int = LIST_WORDS) -> DataFrame:
    """``(word, other, n)`` for each ordered pair of ``words(word, n)`` one edit apart, with the ``n`` of the other; pairs may repeat."""
    now = _lists(words.select(F.lit("").alias("list"), F.col("word").alias("rest"), "word", "n"), [F.length("word"), F.length("word") - 1])
    schema = "word string, other string, n long, list string, m int, rest string"
    found = None
    while True:
        scanned = now.repartition("list").sortWithinPartitions("list", "rest").mapInArrow(_scan(limit), schema)
        scanned = stored(scanned, "near_words")
        pairs = scanned.where("other IS NOT NULL").select("word", "other", "n")
        found = pairs if found is None else found.unionByName(pairs)
        long = scanned.where("other IS NULL")
        if long.isEmpty():
            return found
        now = _lists(long.select("list", "rest", "word", "n", "m"), [F.col("m")])


def spelling_variants(
    docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, damage: int = DAMAGE, limit: int = LIST_WORDS
) -> DataFrame:
    """``(word, n, form, form_n, n_near, root)`` for each word of the vocabulary of ``docs(doc_id, text)``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (the
    least in code-point order of several), if it is ``ratio`` times as frequent as the word; ``root`` follows forms to the last.
    """
    words = stored(vocabulary(docs, letters, occurrences, damage), "vocabulary")
    pairs = near_pairs(words, limit).groupBy("word", "other").agg(F.first("n").alias("n"))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    near = best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.n")).alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    named = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        ),
        "forms",
    )
    steps = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # Twice as far in each round; a form without a form is a root.
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("word", "root")
    return named.join(steps.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
