"""Token counts at every prefix of a text, by dynamic programming over a sentencepiece BPE vocabulary.

The encoding of a prefix is the encoding of a shorter prefix and one last token:
the one token whose pair with the token before it the merges leave apart. So one
pass over the characters gives the count of every prefix, and no prefix is
encoded anew. Pieces begin at a blank or lie between blanks, so the pass runs
word by word and a task keeps what it found for the words it met.

The counts are stored as one signed byte per character, the change of the count.
``count_at`` and ``longest_within`` answer questions about truncation and budgets
from these bytes alone.

Defined cases: a null text counts as empty, and an empty text has no tokens.
Texts of any length are read whole. Repeated rows and null ids are kept. Other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import map_rows

# Fixed value: how the model spells a blank.
BLANK = "▁"
TOKEN_LIMIT = 4096
# A task's table of words starts anew at this size.
TABLE_WORDS = 600_000
_RUNS = re.compile(f"({BLANK}+)([^{BLANK}]*)")
_UNKNOWN = ""


class PrefixCounter:
    """Prefix counts for one vocabulary. The model may not join pieces over a blank nor rewrite texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        usable = [
            i for i in range(lib.get_piece_size())
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))
        ]
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in usable}
        if any(BLANK in piece.lstrip(BLANK) or piece.startswith(BLANK * 2) and piece.strip(BLANK) for piece in self.scores):
            raise ValueError("a piece of this model goes on after a blank")
        if lib.encode("Ａ  a", out_type=str)[-2:] != [BLANK, "a"] and lib.encode(" Ａ")[-1:] == lib.encode("A")[-1:]:
            raise ValueError("this model rewrites texts")
        self.longest = max(map(len, self.scores))
        # A token that its own merges do not give is never the outcome of merges.
        self.tokens = {piece for piece in self.scores if len(piece) == 1 or self._merge(piece) == [piece]}
        self.apart: dict[tuple[str, str], bool] = {}
        # Lengths of the tokens that end in given three characters, longest first.
        self.lengths: dict[str, list[int]] = {}
        for token in sorted(self.tokens, key=len, reverse=True):
            if len(token) >= 3:
                self.lengths.setdefault(token[-3:], []).append(len(token))
        self.lengths = {suffix: list(dict.fromkeys(found)) + [2, 1] for suffix, found in self.lengths.items()}
        self.table: dict[str, bytes] = {}
        self.blanks = [0, 1]

    def _merge(self, text: str) -> list[str]:
        """Merge the best-scored pair, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best = None
            for i, (a, b) in enumerate(zip(parts, parts[1:])):
                score = self.scores.get(a + b)
                if score is not None and (best is None or score > best[0]):
                    best = score, i
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _stay_apart(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            found = self.apart[left, right] = self._merge(left + right) == [left, right]
        return found

    def _words(self, words: list[str]):
        """For each word, in order: counts for every prefix of a blank and the word, and whether the blank is a token of its own there.

        What a word has in common with the beginning of the one before is not gone through again.
        """
        done, counts, last, alone = "", [0], [_UNKNOWN], [False]
        tokens, apart, short = self.tokens, self.apart, [2, 1]
        for word in words:
            text = BLANK + word
            same = 0
            for a, b in zip(done, text):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :], alone[same + 1 :]
            done = text
            for end in range(same + 1, len(text) + 1):
                if text[end - 1] not in self.scores:
                    counts.append(counts[-1] + len(text[end - 1].encode()))
                    last.append(_UNKNOWN)
                    alone.append(alone[-1])
                    continue
                for length in self.lengths.get(text[end - 3 : end], short) if end >= 3 else short:
                    begin = end - length
                    if begin < 0:
                        continue
                    token = text[begin:end]
                    if token not in tokens:
                        continue
                    before = last[begin]
                    if before is not _UNKNOWN:
                        fits = apart.get((before, token))
                        if not (self._stay_apart(before, token) if fits is None else fits):
                            continue
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    alone.append(alone[begin] if begin else token == BLANK)
                    break
                else:
                    raise ValueError(f"no token ends {text[:end]!r}")
            yield word, counts, alone

    def _blank_tokens(self, n: int) -> int:
        """Tokens of a run of ``n`` blanks."""
        while len(self.blanks) <= n:
            self.blanks.append(len(self.library.encode(" " * (len(self.blanks) - 1))))
        return self.blanks[n]

    def _after_run(self, blanks: int, word: str) -> bytes:
        """Changes over a run of blanks and a word."""
        (_, counts, alone), = self._words([word])
        # The last blank is merged with the word first; the others among themselves.
        total = [self._blank_tokens(n) for n in range(blanks)]
        before, run = total[-1], self._blank_tokens(blanks)
        total += [run] + [run + n - 1 if own else before + n for n, own in zip(counts[2:], alone[2:])]
        return bytes([(b - a) & 0xFF for a, b in zip(total, total[1:])])

    def prefixes(self, texts: list[str]) -> list[bytes]:
        """Changes of the count for each text, one signed byte per character."""
        if len(self.table) > TABLE_WORDS:
            self.table = {}
        table, split = self.table, []
        for text in texts:
            spelled = BLANK + text.replace(" ", BLANK)
            if BLANK * 2 in spelled:
                split.append([(len(run), word) for run, word in _RUNS.findall(spelled)])
            else:
                split.append(spelled[1:].split(BLANK))
        new = {w if isinstance(w, str) else w[1] for words in split for w in words}
        for word, counts, _ in self._words(sorted(w for w in new if w not in table)):
            # Of one blank and the word.
            table[word] = bytes([(b - a) & 0xFF for a, b in zip(counts, counts[1:])])
        return [self._joined(words) if text else b"" for text, words in zip(texts, split)]

    def _joined(self, words: list) -> bytes:
        if isinstance(words[0], str):
            changes = b"".join(map(self.table.__getitem__, words))
        else:
            changes = b"".join([self.table[word] if n == 1 else self._after_run(n, word) for n, word in words])
        # The blank put before every text is no character of it.
        return bytes([(changes[0] + changes[1]) & 0xFF]) + changes[2:]


def counts_of(changes: bytes) -> np.ndarray:
    """Token count of every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, dtype=np.int8), dtype=np.int64)])


def count_at(changes: bytes, characters: int) -> int:
    return int(counts_of(changes[:characters])[-1])


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(changes) <= budget)[-1])


def count_tokens(
    docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT, budgets: tuple[int, ...] = (), keep_prefixes: bool = True
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, cuts[, prefixes])`` for each row of ``docs(doc_id, text)``.

    ``prefixes`` are the stored changes, ``cuts`` the longest prefix, in characters,
    for each of ``budgets``.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("cuts", pa.list_(pa.int64())), ("prefixes", pa.binary())]
    schema = pa.schema(fields if keep_prefixes else fields[:-1])
    made = []

    def count(batch):
        if not made:
            made.append(PrefixCounter(shared.value))
        out = {name: [] for name in schema.names}
        texts = [text or "" for text in batch.column("text").to_pylist()]
        for text, changes in zip(texts, made[0].prefixes(texts)):
            out["n_bytes"].append(len(text.encode()))
            out["n_tokens"].append(int(np.frombuffer(changes, dtype=np.int8).sum(dtype=np.int64)))
            out["cuts"].append([longest_within(changes, budget) for budget in budgets])
            if keep_prefixes:
                out["prefixes"].append(changes)
        return out | {"doc_id": batch.column("doc_id")}

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, n_bytes long, n_tokens long, cuts array<long>" + ", prefixes binary" * keep_prefixes
    over: Column = F.col("n_tokens") > limit
    return slim.mapInArrow(map_rows(count, schema, 500), columns).withColumn("over_limit", over)
