"""Product quantisation in integers: codebooks per part of a vector, found by slicing and intersecting bit masks.

The nearest entry of a part is searched exactly. In every dimension the coordinates of all entries are sorted, and
position i carries a mask of the entries before i. The distance to some entry is the initial radius: the nearest
entries lie within it in every dimension, a range of the sorted coordinates whose entries are the difference of two prefix masks. The masks
of all dimensions, as words of 64 bits, are ANDed; only the entries that are left are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 512
"""vectors that are searched at a time"""
LARGEST = 1 << 25
"""integers must be smaller than this in size, so that distances and their sums are exact in 64 bits"""


class Masks:
    """One part's codebook, an array entries x dimensions of integers, as sorted coordinates with prefix masks."""

    def __init__(self, book: np.ndarray):
        self.book = book.astype(np.int64)
        entries, dims = book.shape
        words = -(-entries // 64)
        self.sorted = np.sort(self.book, axis=0)
        order = np.argsort(self.book, axis=0, kind="stable")
        bit = np.zeros((entries, words), np.uint64)
        bit[np.arange(entries), np.arange(entries) // 64] = np.uint64(1) << (np.arange(entries) % 64).astype(np.uint64)
        self.prefix = np.zeros((dims, entries + 1, words), np.uint64)
        for d in range(dims):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Rows x entries: true where every coordinate of the entry is within the row's radius."""
        both = None
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            between = self.prefix[d, high] ^ self.prefix[d, low]
            both = between if both is None else both & between
        spread = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return spread[:, : len(self.book)].astype(bool)

    def start(self, x: np.ndarray) -> np.ndarray:
        """Distance, rounded up, to an entry that is close in the dimension in which the entries differ most."""
        d = int(np.argmax(self.sorted[-1] - self.sorted[0])) if x.shape[1] else 0
        order = np.argsort(self.book[:, d], kind="stable")
        at = np.clip(np.searchsorted(self.sorted[:, d], x[:, d]), 0, len(order) - 1)
        best = None
        for step in (-2, -1, 0, 1):
            apart = ((x - self.book[order[np.clip(at + step, 0, len(order) - 1)]]) ** 2).sum(axis=1)
            best = apart if best is None else np.minimum(best, apart)
        root = np.sqrt(best.astype(np.float64)).astype(np.int64)
        return root + (root * root < best)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row; of equally near entries the one with the lower index."""
        row, entry = np.nonzero(self.candidates(x, self.start(x)))
        difference = x[row] - self.book[entry]
        apart = np.einsum("ij,ij->i", difference, difference)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(apart, first) if len(first) else apart
        tied = np.where(apart == np.repeat(least, np.diff([*first, len(row)])), entry, len(self.book))
        return (np.minimum.reduceat(tied, first) if len(first) else entry), least


def integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components must be smaller than {LARGEST // SCALE} in size")
    return scaled.astype(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], vec: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            yield part, _vectors(part.column(vec))


def _sums(books: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, dims = books.shape
        masks = [Masks(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
        for _, x in _blocks(batches, "vec"):
            for p, mask in enumerate(masks):
                own = x[:, p * dims : (p + 1) * dims]
                found, _ = mask.nearest(own)
                count[p] += np.bincount(found, minlength=entries)
                np.add.at(total[p], found, own)
        part, entry = np.nonzero(count)
        lists = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        names = ["part", "entry", "n", "total"]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), lists], names=names)

    return sums


def _codes(books: np.ndarray, names: list[str]):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = books.shape[2]
        masks = [Masks(b) for b in books]
        for batch, x in _blocks(batches, "vec"):
            found = [mask.nearest(x[:, p * dims : (p + 1) * dims]) for p, mask in enumerate(masks)]
            entries = np.stack([f[0] for f in found], axis=1)
            error = sum(f[1] for f in found)
            width = 2 if books.shape[1] <= 256 else 4
            code = ["".join(f"{e:0{width}x}" for e in row) for row in entries.tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(code), pa.array(error)], names=[*names, "code", "error"])

    return codes


def usable(vectors: DataFrame, id_col: str, vec_col: str, parts: int = PARTS) -> DataFrame:
    """(id, vec, and all other columns): rows whose vector is whole and finite, and as long as that of the smallest id."""
    names = [c for c in vectors.columns if c not in (id_col, vec_col)]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *[F.col(f"`{c}`") for c in names])
    fine = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    first = fine.where(F.size("vec") >= parts).orderBy("id", "vec").select(F.size("vec")).first()
    size = first[0] if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    return fine.where(F.size("vec") == size)


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Parts x entries x components, after ``rounds`` of assigning all rows of ``usable`` and taking means.

    ``entries`` vectors and as many sums per part reach the driver; a task sends one sum per part and entry.
    """
    first = vectors.orderBy("id", "vec").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 1), np.int64)
    books = np.stack(np.split(integers(np.array([r["vec"] for r in first], np.float64)), parts, axis=1))
    for _ in range(rounds):
        found = vectors.select("vec").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        sums = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(books.shape[2])]
        for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[row["part"], row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(books.shape[2])]
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``id_col``, ``label_col``, code, error, label_error and codebooks_sha256 of every usable row.

    Null vectors, and vectors with null, infinite or NaN components, are dropped, and so are those of another length than the vector of the
    smallest id. With fewer rows than ``entries`` each row starts an entry. Equal entries stay; the one with the lower
    index is used. Ids decide the start only: null ids come first, repeated ids in the order of their vectors, and every row
    has a result. Null labels are one label. An empty table gives an empty result. Other columns do not matter. Components
    of 32768 and more are refused, since sums would not be exact.
    """
    rows = usable(vectors.select(id_col, vec_col, F.col(label_col).alias("__label")), id_col, vec_col, parts)
    books = codebooks(rows, parts, entries, rounds)
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, __label {kinds['__label']}, code string, error long"
    found = stored(rows.mapInArrow(_codes(books, ["id", "__label"]), schema), "codes")
    sums = found.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of")
    both = found.join(sums, F.col("__label").eqNullSafe(F.col("__of")))
    names = [F.col("id").alias(id_col), F.col("__label").alias(label_col)]
    return both.select(*names, "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def restore(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """``codes`` with ``restored``: the components that a code stands for, by look-up in the codebooks."""
    parts, entries, dims = books.shape
    width = 2 if entries <= 256 else 4
    book = [F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books]
    at = [F.conv(F.substring(code_col, p * width + 1, width), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("restored", F.transform(F.concat(*[b[a] for b, a in zip(book, at)]), lambda v: v / F.lit(float(SCALE))))
