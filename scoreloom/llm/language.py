"""Language by compression: the dictionary under which a text gets smallest names its language.

Every language has a zstandard raw-content dictionary of sample texts. A text is
cut into blocks, so that all of it is judged against the dictionary and not
against its own beginning; the compressed sizes of its blocks are added up.

Defined cases: a text that is null or has no letter is ``und`` with score 0. A
margin between the best and the second language below ``min_margin`` rejects the
text. Ties go to the language first in the alphabet. Without a usable labelled
row there is nothing to learn from, which is an error unless it is allowed; then
every text is ``und`` with score 0. With one language the margin is 1. Only
``text`` is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import release, text_bytes

UNDETERMINED = "und"
# What is learned from: texts a language, and bytes of such a text; their product bounds a language's bytes.
SAMPLE_TEXTS = 60
SAMPLE_BYTES = (200, 4000)
BLOCK = 2048
LEVEL = 3
MIN_MARGIN = 0.002
# Other texts to draw from at least, if there are as many.
DRAWN_TEXTS = 200
# Fixed value: ASCII bytes that are no letter become blanks.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def learn(labelled: DataFrame, texts: int = SAMPLE_TEXTS, sizes: tuple[int, int] = SAMPLE_BYTES, required: bool = True) -> dict[str, bytes]:
    """Dictionary content per language from ``labelled(text, lang)``: the texts of least hash, copies counted once.

    Texts of ``sizes`` bytes come first, at most ``texts`` of them. A language with
    fewer is filled up from its other texts, shorter ones together and the
    beginnings of longer ones, to ``texts * sizes[1]`` bytes. Per language some
    multiple of these bytes reaches the driver. Without any text to learn from the
    result is empty, or an error if it is ``required``.
    """
    named = labelled.select("lang", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = named.where(F.col("size").between(*sizes))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = rows.groupBy("lang", "hash").agg(F.lit(0)).select("lang", "hash").withColumn("place", place).where(F.col("place") <= texts)
    wanted = [r["hash"] for r in chosen.collect()]
    parts: dict[str, list] = {}
    if wanted:
        found = rows.where(F.col("hash").isin(wanted)).groupBy("lang", "hash").agg(F.min("text").alias("text"))
        for r in found.orderBy("lang", F.desc("hash")).collect():
            parts.setdefault(r["lang"], []).append(r["text"].encode())
    filled = [lang for lang, content in parts.items() if len(content) >= texts]
    for lang, content in _others(named.where(~F.col("size").between(*sizes) & ~F.col("lang").isin(filled)), texts * sizes[1], sizes[1]).items():
        # What is nearest to the text counts most in a dictionary: texts of the usual size stay last.
        room = texts * sizes[1] - sum(len(text) + 1 for text in parts.get(lang, []))
        taken = []
        for text in content:
            if room <= 0:
                break
            taken.append(text[:room].decode(errors="ignore").encode())
            room -= len(taken[-1]) + 1
        parts[lang] = taken[::-1] + parts.get(lang, [])
    if required and not parts:
        raise ValueError("no labelled text to learn from")
    return {lang: b"\n".join(content) for lang, content in parts.items()}


def _others(rows: DataFrame, limit: int, piece: int) -> dict[str, list[bytes]]:
    """Texts with a letter by language, in order of their hashes, long ones cut; at least ``limit`` bytes are likely, if there are as many.

    A long text gives ``piece`` bytes, or its share of ``limit`` if there are few of them.
    """
    usable = rows.where(F.col("text").rlike(r"\p{L}"))
    known = usable.groupBy("lang", "hash").agg(F.min("size").alias("size"))
    per_lang = known.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.least("size", F.lit(piece))).alias("bytes"), F.count_if(F.col("size") > piece).alias("long")
    )
    # One row a language; a hash below the share is drawn.
    share = F.least(F.lit(1.0), F.greatest(2.0 * limit / F.col("bytes"), DRAWN_TEXTS / F.col("n")))
    cut = F.greatest(F.lit(piece), F.ceil(limit / F.greatest("long", F.lit(1))))
    bounds = per_lang.select("lang", share.alias("share"), cut.cast("int").alias("cut"))
    drawn = usable.join(F.broadcast(bounds), "lang").where(F.col("hash") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    drawn = drawn.groupBy("lang", "hash").agg(F.min(F.substring("text", F.lit(1), F.col("cut"))).alias("text"), F.min("cut").alias("cut"))
    out: dict[str, list] = {}
    for r in drawn.orderBy("lang", "hash").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode()[: r["cut"]].decode(errors="ignore").encode())
    return out


def letters_of(text: bytes) -> bytes:
    """Lower case, with one blank for whatever lies between letters."""
    return b" ".join(text.decode().lower().encode().translate(_LETTERS).split())


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL, block: int = BLOCK, min_match: int = 4):
        self.block, self.coders = block, {}
        for lang in sorted(content):
            # A language without a letter has nothing to compare with.
            sample = letters_of(content[lang])
            if not sample:
                continue
            words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(sample), source_size=block, min_match=min_match, write_content_size=False,
                write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            words.precompute_compress(compression_params=settings)
            self.coders[lang] = zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress

    def sizes(self, text: bytes) -> dict[str, int]:
        text = letters_of(text)
        blocks = [text[at : at + self.block] for at in range(0, len(text), self.block)]
        return {lang: sum(map(len, map(code, blocks))) for lang, code in self.coders.items()}

    def classify(self, text: bytes | None) -> tuple[str, float]:
        """``(language, margin)``; the margin is the share that the second smallest size is larger by."""
        if not self.coders or not text or not any(map(str.isalpha, text.decode())):
            return UNDETERMINED, 0.0
        order = sorted((size, lang) for lang, size in self.sizes(text).items())
        return order[0][1], 1 - order[0][0] / order[1][0] if len(order) > 1 else 1.0


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(row, lang_found)``: a row of ``docs``, all columns, and ``(lang_pred, score, rejected)``; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    arrow = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    made = []

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(Classifier(shared.value))
        for batch in texts:
            found = [made[0].classify(text) for text in text_bytes(batch)]
            yield pa.array([{"lang_pred": lang, "score": m, "rejected": lang == UNDETERMINED or m < min_margin} for lang, m in found], arrow)
            release()

    # Only texts go to Python; the rows stay where they are.
    return docs.select(F.struct("*").alias("row"), classify(F.col("text").cast("string")).alias("lang_found"))
