"""Near-duplicate embeddings by E8 lattice hashing, every link verified by its cosine.

Unit vectors are projected by ``TABLES`` random maps to ``BLOCKS`` times eight
coordinates, and each eight are decoded to the nearest point of the E8 lattice:
the points of a table are a vector's home cell. The vector also visits ``PROBES``
neighbouring cells, those next to its home (one block moved by one of the 240
shortest lattice vectors) that it lies nearest to. Two vectors meet in a table
if one is at home where the other is at home or visits.

Cells are compared in three steps. Rows of a cell carry a sketch of ``SKETCH`` sign
bits; a row without any row nearby, by sketch, is alone there and goes no further.
What is left is joined with its vectors and compared by cosine, in pairs of blocks of
at most about ``BLOCK_ROWS`` rows within tasks. A pair that meets in several cells is counted in the
first of them only, which both vectors' cells tell, so that a task returns counts
per vector and a spanning forest of its links, never pairs.

Vectors with equal unit vectors are one class, whatever their number. The work on
a cell grows with the square of its different vectors, its output does not.

Of pairs at a cosine of exactly 0.9 about 99 in 100 are found with the values below, of pairs at
0.95 all but one in 10,000 (``tests`` measure it against brute force).
Unrelated vectors share a home with a probability of about 3e-6 a table; beyond some ten million vectors
``blocks=3, tables=24`` keeps the work per vector the same.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components
links with nothing. Vectors of different widths are never linked. Every row is a vector, also where ids repeat; rows with a null id
take part in links, and a component without any id has none. Other columns are not read.
"""

from __future__ import annotations

import functools
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import mix, same_id, stored, whole_groups
from scoreloom.llm.components import components

TABLES, BLOCKS, PROBES, SCALE = 12, 2, 8, 0.65
COSINE = 0.9
SKETCH, SKETCH_NEAR = 64, 24
# Rows of a cell whose sketches are compared; of larger cells every row goes on.
CELL_ROWS = 256
BLOCK_ROWS = 2000
# Fixed value: seed of the random maps.
SEED = 11


@functools.cache
def lattice_roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [(i, j, s, t) for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    roots = np.zeros((len(whole), 8))
    for row, (i, j, s, t) in zip(roots, whole):
        row[[i, j]] = s, t
    halves = np.array([h for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0])
    return np.concatenate([roots, halves])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight: of the even points, and of those moved by one half."""
    even, moved = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - even) ** 2).sum(axis=1) <= ((x - moved) ** 2).sum(axis=1))[:, None], even, moved)


class Hasher:
    """Home cells, visited cells and sketches of unit vectors of one width."""

    def __init__(self, width: int, tables: int, blocks: int, probes: int, scale: float):
        self.tables, self.blocks, self.probes = tables, blocks, probes
        generator = np.random.default_rng([SEED, width])
        maps = []
        for _ in range(tables):
            one = generator.normal(size=(width, 8 * blocks))
            # Orthogonal maps keep distances more evenly; narrow vectors have no room for them.
            maps.append(np.linalg.qr(one)[0] * np.sqrt(width / 8) if width >= 8 * blocks else one / np.sqrt(8))
        self.maps = np.concatenate(maps, axis=1) / scale
        self.signs = generator.normal(size=(width, SKETCH))
        odd = generator.integers(1, 2**62, (tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = odd
        self.root_sums = np.einsum("rc,tbc->tbr", (lattice_roots() * 2).astype(np.int64).astype(np.uint64), odd)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Cell numbers by row, table and place: the home first, then the visited ones."""
        rows = len(units)
        x = (units @ self.maps).reshape(-1, 8)
        home = decode(x)
        rest = ((x - home) @ lattice_roots().T).reshape(rows, self.tables, -1)
        # A sum of odd multiples, so that a neighbour's sum is the home's plus the root's.
        ints = np.rint(home * 2).astype(np.int64).astype(np.uint64).reshape(rows, self.tables, self.blocks, 8)
        sums = (ints * self.factors).sum(axis=(2, 3), dtype=np.uint64)
        near = np.argpartition(-rest, self.probes, axis=2)[:, :, : self.probes]
        moves = np.take_along_axis(np.broadcast_to(self.root_sums.reshape(1, self.tables, -1), rest.shape), near, axis=2)
        return mix(np.concatenate([sums[:, :, None], sums[:, :, None] + moves], axis=2)).view(np.int64)

    def sketches(self, units: np.ndarray) -> np.ndarray:
        bits = (units @ self.signs >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(np.int64)[:, 0]


@functools.lru_cache(maxsize=8)
def _hasher(*shape) -> Hasher:
    return Hasher(*shape)


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for vectors that have no direction."""
    out = []
    for value in column:
        if not value.is_valid or value.values.null_count:
            out.append(None)
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        largest = np.abs(x).max(initial=0.0)
        if not largest or not np.isfinite(largest):
            out.append(None)
            continue
        x = x / largest
        # Adding zero makes one zero of two.
        out.append(x / np.sqrt((x * x).sum()) + 0.0)
    return out


def _digests(batches):
    for batch in batches:
        keys = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in unit_vectors(batch.column("vec"))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("vec")], ["vec_id", "cls", "vec"])


def _by_width(units: list[np.ndarray]):
    """Row numbers and stacked vectors of each width."""
    widths = np.array([len(x) for x in units])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, np.stack([units[i] for i in at])


def _cells(shape: tuple):
    """Rows ``(t, cell, cls, sketch, home)`` of every cell that a class is at home in or visits."""

    def body(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for width, at, units in _by_width(unit_vectors(part.column("vec"))):
                    hasher = _hasher(width, *shape)
                    cells = hasher.cells(units)
                    rows, tables, places = cells.shape
                    yield pa.RecordBatch.from_pydict(
                        {
                            "t": pa.array(np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], cells.shape).ravel()),
                            "cell": pa.array((cells ^ width).ravel()),
                            "cls": part.column("cls").take(pa.array(np.repeat(at, tables * places))),
                            "sketch": pa.array(np.repeat(hasher.sketches(units), tables * places)),
                            "home": pa.array(np.broadcast_to(np.arange(places) == 0, cells.shape).ravel()),
                        }
                    )

    return body


def _together(batches):
    """Of the sorted rows of cells those that have another row nearby by sketch, one of the two at home."""
    for batch, bounds in whole_groups(batches, ["t", "cell"], CELL_ROWS):
        sketch, home = batch.column("sketch").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for start, end, whole in bounds:
            if not whole:
                keep[start:end] = True
            elif end - start > 1 and home[start:end].any():
                one, at_home = sketch[start:end], home[start:end]
                far = np.bitwise_count(one[:, None] ^ one[None, :]) > SKETCH_NEAR
                far |= ~(at_home[:, None] | at_home[None, :])
                np.fill_diagonal(far, True)
                keep[start:end] = ~far.all(axis=1)
        if keep.any():
            yield batch.filter(pa.array(keep)).select(["t", "cell", "cls", "home"])


def _met_before(cells: np.ndarray, low: np.ndarray, high: np.ndarray, event: np.ndarray) -> np.ndarray:
    """Whether rows ``low`` and ``high`` meet at an earlier event: 3 t both at home, 3 t + 1 the lower one, 3 t + 2 the higher one."""
    out = np.zeros(len(low), dtype=bool)
    for start in range(0, len(low), 20_000):
        one, other, now = cells[low[start : start + 20_000]], cells[high[start : start + 20_000]], event[start : start + 20_000]
        both = one[:, :, 0] == other[:, :, 0]
        lower = (one[:, :, :1] == other[:, :, 1:]).any(axis=2)
        higher = (other[:, :, :1] == one[:, :, 1:]).any(axis=2)
        met = np.stack([both, lower, higher], axis=2).reshape(len(one), -1)
        out[start : start + 20_000] = met.argmax(axis=1) < now
    return out


def _links(shape: tuple, cosine: float):
    """``(cls, n_links, other)``: vectors linked with a class that were first met here, and a class of the same component."""
    schema = pa.schema([("cls", pa.binary()), ("n_links", pa.int64()), ("other", pa.binary())])

    def body(batches):
        for batch, bounds in whole_groups(batches, ["t", "cell", "low", "high"]):
            t, home, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "home", "side"))
            same = batch.column("low").to_numpy() == batch.column("high").to_numpy()
            sizes, names = batch.column("n").to_numpy(), batch.column("cls").to_pylist()
            out = {"cls": [], "n_links": [], "other": []}
            for start, end, _ in bounds:
                if end - start < 2:
                    continue
                units = np.stack(unit_vectors(batch.column("vec").slice(start, end - start)))
                close = units @ units.T >= cosine
                close &= home[start:end, None] | home[None, start:end]
                if not same[start]:
                    close &= side[start:end, None] != side[None, start:end]
                i, j = np.nonzero(np.triu(close, 1))
                if not len(i):
                    continue
                key = names[start:end]
                order = np.argsort(np.argsort(np.array(key, dtype="S16")))
                swap = order[i] > order[j]
                low, high = np.where(swap, j, i), np.where(swap, i, j)
                at_home = home[start:end]
                event = 3 * t[start] + np.where(at_home[low], np.where(at_home[high], 0, 1), 2)
                cells = _hasher(units.shape[1], *shape).cells(units)
                fresh = ~_met_before(cells, low, high, event)
                weight = sizes[start:end]
                count = np.bincount(low[fresh], weight[high[fresh]], len(key)) + np.bincount(high[fresh], weight[low[fresh]], len(key))
                root = list(range(len(key)))

                def find(k):
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                # Enough of the links to join what they join: of every row the one with its first partner, then what is still apart.
                for a, b in zip(i.tolist(), j.tolist()):
                    a, b = find(a), find(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                linked = np.unique(np.concatenate([i, j])).tolist()
                out["cls"] += [key[k] for k in linked]
                out["n_links"] += [int(count[k]) for k in linked]
                out["other"] += [key[find(k)] for k in linked]
            if out["cls"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return body


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding)``."""
    shape = (tables, blocks, probes, scale)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    kind = slim.schema["vec"].dataType.simpleString()
    named = slim.mapInArrow(_digests, f"vec_id long, cls binary, vec {kind}")
    members = stored(named.select("vec_id", "cls"), "vectors")
    classes = stored(
        named.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")), "classes"
    )

    cells = classes.select("cls", "vec").mapInArrow(_cells(shape), "t int, cell long, cls binary, sketch long, home boolean")
    together = (
        cells.repartition("t", "cell").sortWithinPartitions("t", "cell").mapInArrow(_together, "t int, cell long, cls binary, home boolean")
    )
    together = stored(together, "cells")
    counts = together.groupBy("t", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = together.join(counts, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks"))
    pair = "transform(sequence(0L, blocks - 1), o -> named_struct('low', least(o, block), 'high', greatest(o, block), 'side', o < block))"
    twice = dealt.select("t", "cell", "cls", "home", F.inline(F.expr(pair)))
    group = ["t", "cell", "low", "high"]
    rows = twice.join(classes.select("cls", "n", "vec").hint("merge"), "cls").repartition(*group).sortWithinPartitions(*group)
    links = stored(rows.mapInArrow(_links(shape, cosine), "cls binary, n_links long, other binary"), "links")

    found = links.groupBy("cls").agg(F.sum("n_links").alias("others"))
    part = components(links.select(F.col("cls").alias("u"), F.col("other").alias("v")).where("u != v"))
    part = part.select(F.col("id").alias("cls"), F.col("component_id").alias("part"))
    of_class = classes.select("cls", "n", "least").join(found, "cls", "left").join(part, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    least = of_class.groupBy("part").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "part").select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = F.col("cls").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return members.join(of_class, "cls", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        same_id(F.col("vec_id"), component).alias("kept"),
    )


def drop_near_duplicate_vectors(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``vectors``, all columns, whose id stays: one id of each component."""
    kept = near_duplicate_vectors(vectors, **options).where("kept").select(F.col("vec_id").alias("_wanted")).distinct().hint("merge")
    return vectors.join(kept, same_id(vectors["vec_id"].cast("long"), kept["_wanted"]), "left_semi")
