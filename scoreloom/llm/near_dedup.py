"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds the hashes of its shingles of words. Of each of ``CHUNKS *
CHUNK`` random orders of all hashes the signature keeps ``BITS`` bits of the
least one. The signature is split into ``CHUNKS`` chunks; signatures that differ
in at most ``CHUNKS * (ERRORS + 1) - 1`` places have a chunk with at most
``ERRORS`` differences (pigeonhole). Every choice of ``ERRORS`` places of a chunk
is left out in turn and the rest of the chunk is a key, so such documents have a
key in common. With the values below all pairs within distance 23 of 60 are
found; of pairs just at the similarity 0.8 one in ten million is not.

Documents with the same set are one class, known by a 128-bit hash of the set, whatever
their ids, and numbered when the classes are stored. The sorted shingle hashes of the classes that share a bucket with another are stored once. In a bucket (the classes with one key)
no pairs are formed: each class is compared with the least and the greatest of
the bucket, on full sets. What these links join is one component. Buckets whose
classes are then still in several components are compared once more, in blocks of bounded size within tasks: each
class against those of other components that have one of its first shingles (a prefix filter: linked sets share one of
their least fifth) and a size that allows a link, on full sets. Only links come out, so
no link is lost and no bucket is ever spelled out as pairs.

Defined cases: a text that is null or has no words has an empty set, is linked
with nothing and is kept. Fewer words than a shingle are one shingle. Documents
with a null id are kept, each a component of its own without an id. Rows that repeat an id are one
document: all their sets are of one component, and one of the rows stays where the id does. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import gram_hashes, map_rows, one_row, same_id, stored, text_bytes, word_hashes
from scoreloom.llm.components import components

CHUNKS, CHUNK, ERRORS, BITS = 12, 5, 1, 16
SHINGLE = 5
SIMILARITY = 80
# Hashes of sets that a block of a bucket may hold, on either side of a comparison.
BLOCK_HASHES = 500_000
# Fixed value: seed of the random orders.
SEED = 20

_KEPT = [[c * CHUNK + i for i in range(CHUNK) if i not in left] for c in range(CHUNKS) for left in combinations(range(CHUNK), ERRORS)]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(size, len(words))))


def set_name(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Stored shingle hashes as they were."""
    return [x.values.to_numpy().view(np.uint64) for x in column]


def linked(one: np.ndarray, other: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Is the Jaccard similarity at least ``similarity`` percent."""
    few, many = sorted((len(one), len(other)))
    if not few or 100 * few < similarity * many:
        return False
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= similarity * (few + many - shared)


class Signer:
    def __init__(self):
        generator = np.random.default_rng(SEED)
        self.factors = generator.integers(1, 2**62, CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = generator.integers(1, 2**62, len(_KEPT), dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 4096):
            mixed = hashes[at : at + 4096] * self.factors[:, None]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            least = np.minimum(least, mixed.min(axis=1))
        least ^= least >> np.uint64(29)
        return least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)

    def keys(self, signature: np.ndarray) -> list[int]:
        """One key for each chunk and each choice of places left out; equal values make equal keys."""
        parts = signature[_KEPT]
        key = np.zeros(len(_KEPT), dtype=np.uint64)
        for i in range(parts.shape[1]):
            key = key * np.uint64(1 << BITS) + parts[:, i] if BITS * parts.shape[1] <= 64 else key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i]
        return ((key ^ self.salts) * np.uint64(0x9E3779B97F4A7C15) + self.salts).view(np.int64).tolist()


def _signed(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64()))])
    signer = []

    def sign(batch):
        if not signer:
            signer.append(Signer())
        out = {"doc_id": batch.column("doc_id"), "n_shingles": [], "set_hash": [], "keys": []}
        for text in text_bytes(batch.column("text")):
            hashes = shingles(text, size)
            out["n_shingles"].append(len(hashes))
            out["set_hash"].append(set_name(hashes))
            out["keys"].append(signer[0].keys(signer[0].signature(hashes)) if len(hashes) else [])
        return out

    return map_rows(sign, schema)


def _sets(size: int):
    """``(cls, shingles)`` of the rows ``(text, set_hash, cls)`` whose text has that set: an id may have other texts too."""
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def body(batch):
        out = {"cls": [], "shingles": []}
        for text, wanted, cls in zip(text_bytes(batch.column("text")), batch.column("set_hash").to_pylist(), batch.column("cls").to_pylist()):
            hashes = shingles(text, size)
            if set_name(hashes) == wanted:
                out["cls"].append(cls)
                out["shingles"].append(hashes.view(np.int64))
        return out

    return map_rows(body, schema, rows=200)


def _verified(similarity: int):
    """Keeps ``(u, v)`` of the rows ``(u, v, one, other)`` whose sets are linked."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batch):
        pairs = zip(sets_of(batch.column("one")), sets_of(batch.column("other")))
        mask = pa.array([linked(one, other, similarity) for one, other in pairs], pa.bool_())
        return {"u": batch.column("u").filter(mask), "v": batch.column("v").filter(mask)}

    return map_rows(verify, schema)


def _block_links(similarity: int):
    """Links between the rows of a pair of blocks that are in different components, enough to join what is linked.

    Linked sets of sizes x and y share at least similarity percent of the greater, so one of the least
    x - ceil(similarity * x) + 1 hashes of the one is among those of the other.
    """

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, sides = rows.column("cls").to_pylist(), rows.column("side").to_pylist()
        parts = np.unique(rows.column("part").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        sets = sets_of(rows.column("shingles").chunk(0))
        sizes = np.array([len(s) for s in sets])
        firsts = sizes - -(-similarity * sizes // 100) + 1
        owner = np.repeat(np.arange(len(sets)), firsts)
        every = np.concatenate([s[:k] for s, k in zip(sets, firsts.tolist())])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        same = key[1].as_py() == key[2].as_py()
        # Queries: all rows of one side but those of the component with most rows, which need no comparing with each other.
        most = np.bincount(parts).argmax()
        group, links = parts.copy(), []
        for q in range(len(sets)):
            if (parts[q] == most) if same else sides[q]:
                continue
            prefix = sets[q][: firsts[q]]
            begin, end = np.searchsorted(every, prefix, "left"), np.searchsorted(every, prefix, "right")
            wide = np.flatnonzero(end > begin)
            near = np.unique(np.concatenate([owner[begin[k] : end[k]] for k in wide])) if len(wide) else ()
            for other in near:
                other = int(other)
                if group[other] != group[q] and (same or sides[other]) and linked(sets[q], sets[other], similarity):
                    links.append((ids[q], ids[other]))
                    group[group == group[other]] = group[q]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Documents whose sets of ``shingle``-word shingles have a Jaccard similarity of at
    least ``similarity`` percent are linked; ``component_id`` is the least id reachable.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(slim.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, set_hash binary, keys array<long>"), "signatures")
    members = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_hash")
    least = members.groupBy("set_hash").agg(F.min("doc_id").alias("least"))
    # The keys of one row of each class: rows of one set have the same, so of rows that repeat its id any will do.
    named = signed.join(least, "set_hash").where("doc_id = least").select("set_hash", "least", "n_shingles", "keys")
    # Numbers that last, as they are stored.
    classes = stored(named.dropDuplicates(["set_hash"]).withColumn("cls", F.monotonically_increasing_id()), "classes")
    keys = classes.select(F.explode("keys").alias("key"), "cls", "n_shingles")
    buckets = keys.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n")).where("low < high")
    filled = stored(keys.join(buckets, "key"), "buckets")

    # Sets of the classes that share a bucket with another.
    wanted = filled.select("cls").distinct().join(classes.select("cls", "set_hash", "least"), "cls")
    texts = slim.join(wanted.hint("merge"), slim["doc_id"] == wanted["least"]).select("text", "set_hash", "cls")
    sets = stored(texts.mapInArrow(_sets(shingle), "cls long, shingles array<long>").dropDuplicates(["cls"]), "sets")
    hubs = filled.select("cls", F.explode(F.array("low", "high")).alias("hub")).where("cls != hub").distinct()
    set_of = lambda cls, shingles_: sets.select(F.col("cls").alias(cls), F.col("shingles").alias(shingles_)).hint("merge")
    pairs = hubs.select(F.col("cls").alias("u"), F.col("hub").alias("v")).join(set_of("u", "one"), "u").join(set_of("v", "other"), "v")
    star = stored(pairs.mapInArrow(_verified(similarity), "u long, v long"), "links")
    # Rows that repeat an id with different texts.
    several = members.groupBy("doc_id").agg(F.min("set_hash").alias("v"), F.max("set_hash").alias("w")).where("v < w")
    number = lambda name: classes.select(F.col("set_hash").alias(name), F.col("cls").alias(f"{name}_cls"))
    repeats = members.join(several, "doc_id").where("set_hash != v").select(F.col("set_hash").alias("u"), "v").distinct()
    repeats = repeats.join(number("u"), "u").join(number("v"), "v").select(F.col("u_cls").alias("u"), F.col("v_cls").alias("v"))
    first = components(star.unionByName(repeats))

    # Buckets of four and more: in smaller ones every pair has been compared.
    part = first.select(F.col("id").alias("cls"), F.col("component_id").alias("part"))
    placed = stored(
        filled.where("n > 3").join(part, "cls", "left").select("key", "cls", "n_shingles", F.coalesce("part", "cls").alias("part")), "buckets"
    )
    split = (
        placed.groupBy("key")
        .agg(F.min("part").alias("a"), F.max("part").alias("b"), F.ceil(F.sum("n_shingles") / BLOCK_HASHES).alias("blocks"))
        .where("a < b")
        .select("key", "blocks")
    )
    dealt = placed.join(split, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("long"))
    # Each pair of blocks of a bucket is one group: the rows of the first as queries, those of the second besides.
    both = "transform(sequence(0L, blocks - 1), o -> named_struct('low', least(o, block), 'high', greatest(o, block), 'side', o < block))"
    compared = (
        dealt.select("key", "cls", "part", F.inline(F.expr(both)))
        .join(set_of("cls", "shingles"), "cls")
        .groupBy("key", "low", "high")
        .applyInArrow(_block_links(similarity), "u long, v long")
    )
    rest = stored(compared.distinct(), "links")
    last = components(first.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(rest))
    of_class = classes.select("set_hash", "cls", "least").join(last.withColumnRenamed("id", "cls"), "cls", "left")
    of_class = of_class.select("set_hash", "least", F.coalesce("component_id", "cls").alias("part"))
    ids = of_class.groupBy("part").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(ids, "part").select("set_hash", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), same_id(F.col("doc_id"), component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one row of each component, and every row without an id."""
    return one_row(docs, near_duplicates(docs, **options).where("kept").select("doc_id").distinct())
