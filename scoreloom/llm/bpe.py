"""Byte-level BPE: texts to token ids and back, with the tokenizers library over Arrow batches.

The rank file is turned into a ``tokenizers`` model: every byte becomes a
printable character (the usual byte-to-character table) and the merge of a token
is the pair its bytes fall into when only lower ranks are merged. A text is cut
before every lone blank between other characters, where the pattern always
splits; words met before come from the task's table, new ones are split by the
pattern and merged by the library. Token lengths give byte offsets, and byte
offsets give character offsets.

Decoding spells the tokens in the characters of the vocabulary and turns each back into its byte by the
reversed table. ``decode_text`` keeps the bytes of a
character whose end is in a later token until it is complete; bytes that are no
UTF-8 become U+FFFD. A token that ends within a character is counted as split.

Defined cases: a null text is encoded as the empty text, which has no tokens.
Very long texts are encoded whole, piece by piece. Repeated rows are encoded
again. Null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import array
import base64
import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import map_rows

# A task's table of words and pieces starts anew beyond this size, of which longer ones are not kept.
TABLE_WORDS = 300_000
WORD_LENGTH = 40
# Lone blanks next to other white space are no place to cut.
_MORE_SPACE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge makes ``token``, None if its bytes don't come down to a pair."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe:
    """Encoder and decoder of one vocabulary, with its table of pieces met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Tokenizer, models

        shown = byte_characters()
        spell = lambda token: "".join([shown[b] for b in token])
        pairs = [(rank, merge_of(token, ranks)) for token, rank in ranks.items() if len(token) > 1]
        merges = [(spell(a), spell(b)) for _, (a, b) in sorted(p for p in pairs if p[1])]
        vocabulary = {spell(token): rank for token, rank in ranks.items()}
        # A piece that is a token as a whole is that token, merges or not.
        self.model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)).model
        self.shown = shown
        self.pieces_of = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        # The vocabulary's spelling of all tokens, and the byte that each of its characters stands for.
        self.spelled = np.array([ord(shown[b]) for b in b"".join(tokens)], dtype=np.uint16)
        self.byte_of = np.zeros(0x200, dtype=np.uint8)
        self.byte_of[[ord(c) for c in shown]] = np.arange(256)
        self.table: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode_word(self, word: str) -> bytes:
        """``word`` is what lies between two cuts, its leading blank included."""
        letters = word[1:].isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isascii() and word[0].isalpha())
        return self._encode_piece(word) if letters else b"".join([self._encode_piece(piece) for piece in self.pieces_of(word)])

    def _encode_piece(self, piece: str) -> bytes:
        # A piece of letters after a blank is a word, and is kept as such.
        word = piece[1:]
        table, key = (self.table, word) if piece[0] == " " and word.isascii() and word.isalpha() else (self.pieces, piece)
        found = table.get(key)
        if found is None:
            tokens = self.model.tokenize("".join([self.shown[b] for b in piece.encode()]))
            found = array.array("I", [token.id for token in tokens]).tobytes()
            if len(key) <= WORD_LENGTH:
                table[key] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Token ids as 32-bit integers."""
        if _MORE_SPACE.search(text):
            first, *words = _CUT.split(text)
            words = [word[1:] for word in words]
        else:
            first, *words = text.split(" ")
        parts = list(map(self.table.get, words))
        if None in parts:
            for i, word in enumerate(words):
                if parts[i] is None:
                    parts[i] = self.table.get(word)
                    if parts[i] is None:
                        parts[i] = self._encode_word(" " + word)
                        if len(word) <= WORD_LENGTH:
                            self.table[word] = parts[i]
                        if len(self.table) + len(self.pieces) > TABLE_WORDS:
                            self.table, self.pieces = {}, {}
        return np.frombuffer(self._encode_word(first) + b"".join(parts), dtype="<u4")

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """``(tokens, 2)`` start and end of every token in characters; a split character belongs to all its tokens."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return np.stack([character[starts], character[ends - 1] + 1], axis=1)

    def split_count(self, text: str, ids: np.ndarray) -> int:
        """How many tokens end within a character."""
        if text.isascii():
            return 0
        raw = np.frombuffer(text.encode() + b" ", dtype=np.uint8)
        return int(np.count_nonzero((raw[np.cumsum(self.lengths[ids])] & 0xC0) == 0x80))

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        if not len(ids):
            return b""
        # Character k of a token lies k places after the token's first one, in the text as in the table.
        shift = np.repeat(self.begins[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.byte_of[self.spelled[shift + np.arange(len(shift))]].tobytes()

    def decode_text(self, ids: list[int]) -> list[str]:
        """What each token adds to the text; a character appears with the token that completes it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        added = [decoder.decode(self.decode(np.array([i]))) for i in ids]
        rest = decoder.decode(b"", final=True)
        if rest:
            added[-1] += rest
        return added


def _coder(shared, pattern: str, extra: list[str]):
    kinds = {
        "ids": pa.binary(), "offsets": pa.list_(pa.list_(pa.int32())), "decoded": pa.binary(),
        "n_tokens": pa.int64(), "n_split": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
    }
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *extra]
    schema = pa.schema([("doc_id", pa.int64()), *((n, kinds[n]) for n in names)])
    made = []

    def code(batch):
        if not made:
            made.append(ByteBpe(shared.value, pattern))
        coder, out = made[0], {n: [] for n in names}
        for text in batch.column("text").to_pylist():
            text = text or ""
            ids = coder.encode(text)
            decoded = coder.decode(ids)
            row = {
                "ids": ids.tobytes, "decoded": lambda: decoded, "n_tokens": lambda: len(ids),
                "offsets": lambda: coder.offsets(text, ids).tolist(), "n_split": lambda: coder.split_count(text, ids),
                "ids_sha256": lambda: hashlib.sha256(ids.tobytes()).hexdigest(),
                "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
            }
            for n in names:
                out[n].append(row[n]())
        return {"doc_id": batch.column("doc_id"), **out}

    return map_rows(code, schema, 500)


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, extra: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and ``extra`` columns for each row of ``docs(doc_id, text)``.

    ``ids`` is binary, little-endian 32-bit integers; ``decoded`` the bytes decoded
    from the ids; ``offsets`` start and end of every token in characters; ``n_split`` the tokens that end within a character.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sql = {"ids": "binary", "decoded": "binary", "offsets": "array<array<int>>", "n_split": "long"}
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(_coder(shared, pattern, list(extra)), ", ".join([columns, *(f"{n} {sql[n]}" for n in extra)]))
