"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A task takes its texts together in blocks: a text becomes the numbers of its words, by position,
and every different word of a block is one row. Words of all blocks meet by value, each different one is encoded once, and
the ids are joined back to the blocks, where texts are put together by position. As a block has a word once, the most
frequent word is one row in the hundred thousand or so of a block. Decoding joins ids with the table of token bytes, which every task holds.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinal.llm.rows import KEY, keyed

#: Bytes of text that a block holds at least before it is closed; larger blocks send fewer words, but need more memory.
BLOCK_BYTES = 32 << 20
#: Ids of words, and texts, that a task packs together.
PACK_ROWS, PACK_TEXTS = 1 << 20, 256
#: Bytes of different stretches that are Python strings at a time.
STRETCH_BYTES = 1 << 18
#: White space that does not stand alone between two other characters.
GAPS = regex.compile(r"\s\s|^\s|\s$")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank file: a token in base 64 and its id in each line. A vocabulary is bounded, so it is held by every task."""
    if "://" not in path:
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lines = spark.read.text(path).collect()
    return {base64.b64decode(a): int(b) for a, b in (line[0].split() for line in lines if line[0].strip())}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed byte by byte of equal weight: most are small, so most of their bytes are zero."""
    return zlib.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _different(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different codes below ``most`` in order, and the place of each code among them."""
    seen = np.zeros(most, bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[codes]


class _Words:
    """Words of a block and their numbers. Texts are cut at single spaces, and each different stretch by the pattern once.

    Stretches and words are made distinct as Arrow columns; only different ones are Python strings, so many at a time.
    """

    def __init__(self, cut: regex.Pattern):
        self.cut, self.number = cut, {}

    def numbers(self, text: str) -> np.ndarray:
        _, numbers, _, words = self.block(pa.array([text], pa.string()))
        self.number = {word: i for i, word in enumerate(words.to_pylist())}
        return numbers

    def block(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
        """(order, numbers, ends, words): texts in the given order, the numbers of their words, where each text ends, and words by number.

        Frequent words have small numbers.
        """
        # a space before a stretch that neither begins nor ends with white space belongs to its first pre-token
        gaps = np.array([GAPS.search(text.as_py()) is not None for text in texts], bool)
        plain, odd = np.flatnonzero(~gaps), np.flatnonzero(gaps)
        sizes, coded = [np.zeros(1, np.int64)], []
        for i in range(0, len(plain), PACK_TEXTS):
            lists = pc.split_pattern(texts.take(pa.array(plain[i : i + PACK_TEXTS])), " ")
            sizes.append(np.diff(lists.offsets.to_numpy()))
            coded.append(lists.flatten().dictionary_encode())
        coded = pa.chunked_array(coded, pa.dictionary(pa.int32(), texts.type)).unify_dictionaries()
        names = coded.chunk(0).dictionary if coded.num_chunks else texts.slice(0, 0)
        at = np.cumsum(np.concatenate(sizes))  # where plain texts begin and end
        # stretches: those behind a space, those that begin a text, whole texts with gaps
        stretch = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks], np.zeros(len(odd), np.int32)])
        del coded
        first, first_at = _different(stretch[at[:-1]], len(names))
        stretch[at[:-1]] = len(names)
        later, later_at = _different(stretch[: at[-1]], len(names) + 1)
        later = later[later < len(names)]
        stretch[: at[-1]] = later_at
        stretch[at[:-1]] = len(later) + first_at
        stretch[at[-1] :] = len(later) + len(first) + np.arange(len(odd))
        upto = np.concatenate((at, at[-1] + 1 + np.arange(len(odd))))
        del later_at
        behind = ((" ", names, later), ("", names, first), ("", texts, odd))
        counts, pieces = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
        for space, strings, which in behind:
            strings = strings.take(pa.array(which))
            held = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False) + 8) // STRETCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(strings)]
            for i, j in zip(cuts, cuts[1:]):
                found = [self.cut.findall(space + s) for s in strings.slice(i, j - i).to_pylist()]
                counts.append(np.array([len(f) for f in found], np.int64))
                pieces.append(pa.array([piece for f in found for piece in f], pa.string()))
        n = np.concatenate(counts)
        words = pa.concat_arrays(pieces).dictionary_encode()
        piece, ends = words.indices.to_numpy(), np.cumsum(n)
        often = np.bincount(piece, np.repeat(np.bincount(stretch, minlength=len(n)), n), len(words.dictionary))
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        flat, tokens = place[piece].tobytes(), np.zeros(len(upto), np.int64)
        numbers = np.empty(int(often.sum()), "<u4")
        for i in range(0, len(upto) - 1, PACK_TEXTS):
            cuts = upto[i : i + PACK_TEXTS + 1]
            found, sized = _gather(flat, ends * 4, stretch[cuts[0] : cuts[-1]], 4)
            tokens[i : i + len(cuts)] = tokens[i] + np.concatenate(([0], np.cumsum(sized)))[cuts - cuts[0]]
            numbers[tokens[i] : tokens[i + len(cuts) - 1]] = found
        return np.concatenate((plain, odd)), numbers, tokens, words.dictionary.take(pa.array(order))


def _explode(pattern: str, block_bytes: int):
    """Rows of texts (id, __fp, numbers) and rows of words (number, word), each with its block.

    A block is named by its task and its place in the task's output.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(regex.compile(pattern))
        name, rows, held = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            ids, texts, keys = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("id", "text", "__fp"))
            order, numbers, ends, found = words.block(texts)
            n, many = len(order), len(found)
            columns = [
                pa.array(np.full(n + many, name, np.int64)),
                pa.concat_arrays([ids.take(pa.array(order)), pa.nulls(many, ids.type)]),
                pa.concat_arrays([keys.take(pa.array(order)), pa.nulls(many, keys.type)]),
                pa.ListArray.from_arrays(pa.array(np.concatenate((ends, np.full(many, ends[-1]))).astype(np.int32)), pa.array(numbers.view(np.int32))),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(many, dtype=np.int32))]),
                pa.concat_arrays([pa.nulls(n, pa.string()), found]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "id", "__fp", "numbers", "number", "word"])

        for batch in batches:
            begin = 0
            for i, size in enumerate(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).tolist()):
                held += size
                if held >= block_bytes:
                    rows.append(batch.slice(begin, i + 1 - begin))
                    yield close()
                    name, rows, held, begin = name + 1, [], 0, i + 1
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if rows:
            yield close()

    return explode


def _cut(pattern: str, block_bytes: int, texts_type: pa.DataType):
    """Rows (word, block, number, texts) of ``_explode``: words, and the texts of a block in rows of ``PACK_TEXTS`` under the block's name.

    ``texts`` is a list of one: ids and keys, packed sizes and numbers.
    """
    explode = _explode(pattern, block_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in explode(batches):
            block = batch.column("block")[0].as_py()
            n = batch.column("word").null_count  # texts come first
            words, texts = batch.slice(n), batch.slice(0, n)
            lists = texts.column("numbers")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            edges = [*range(0, n, PACK_TEXTS), n]
            rows = len(edges) - 1
            columns = [
                *[pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.concat_arrays([texts.column(c)])) for c in ("id", "__fp")],
                pa.array([_pack(np.diff(ends[i : j + 1])) for i, j in zip(edges, edges[1:])], pa.binary()),
                pa.array([_pack(flat[ends[i] : ends[j]]) for i, j in zip(edges, edges[1:])], pa.binary()),
            ]
            packs = pa.StructArray.from_arrays(columns, names=["id", "__fp", "sizes", "numbers"])
            packs = pa.ListArray.from_arrays(pa.array(range(rows + 1), pa.int32()), packs).cast(texts_type)
            named = pa.array([str(block)] * rows, pa.string())
            for word, number, packed in (
                (named, pa.nulls(rows, pa.int32()), packs),
                (words.column("word"), words.column("number"), pa.nulls(len(words), texts_type)),
            ):
                columns = [word, pa.array(np.full(len(word), block, np.int64)), number, packed]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "block", "number", "texts"])
            del batch, words, texts, lists, flat, packs, columns, word, number, packed
            pa.default_memory_pool().release_unused()  # the worker is kept for later tasks

    return cut


def _encode_words(ranks: dict[bytes, int], pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            # a pre-token is matched whole by the pattern, so this encodes it as it would be inside a text
            ids = [coder.encode_ordinary(word) for word in batch.column("word").to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return encode


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by ``word``: the one shuffle that makes words distinct, meets their ids and brings the texts of a block together."""
    return rows.where("word IS NOT NULL").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def vocabulary(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(word, rows, last, ids): every different ``word`` once, with the number of its rows and the last of its blocks.

    Rows without a number are no words. Other columns are counted.
    """
    others = [c for c in words.columns if c not in ("word", "block", "number")]
    counts = [F.count(c).alias(c) for c in others]
    different = words.groupBy("word").agg(F.count("number").alias("rows"), F.max("block").alias("last"), *counts).where("rows > 0")
    schema = T.StructType([*different.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return different.mapInArrow(_encode_words(ranks, pattern), schema)


def _joined(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``words``, which are dealt, with their ids. The vocabulary asks for the same columns, so that both read one exchange."""
    return words.join(vocabulary(words, ranks, pattern).select("word", "ids"), "word")


def words_with_ids(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(block, number, ids) for all rows (block, number, word)."""
    return _joined(dealt(words), ranks, pattern).select("block", "number", "ids")


def _gather(values: bytes, ends: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings picked by number, joined; and the size of each."""
    flat = np.frombuffer(values, f"<u{width}")
    size = np.diff(ends, prepend=0) // width
    n = size[order]
    last = np.cumsum(n)
    at = np.arange(int(last[-1]) if len(last) else 0) - np.repeat(last - n, n) + np.repeat((ends // width - size)[order], n)
    return flat[at], n


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, number, ids) as one packed row per block of what a task holds at a time. A word may be spelt like the name of a block, whose texts are left out."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        block, number, lists = rows["block"].to_numpy(), rows["number"].to_numpy(), rows["ids"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(sizes)
        order = np.argsort(block, kind="stable")
        names, begins = np.unique(block[order], return_index=True)
        ids, n = _gather(flat.tobytes(), ends * 4, order, 4)
        upto = np.concatenate(([0], np.cumsum(n)))
        columns = (number[order], begins), (n, begins), (ids, upto[begins])
        packs = [pa.array([_pack(v) for v in np.split(values, cuts[1:])], pa.binary()) for values, cuts in columns]
        return pa.RecordBatch.from_arrays([pa.array(names), *packs], names=["block", "numbers", "sizes", "ids"])

    for batch in batches:
        if "is_word" in batch.schema.names:
            batch = batch.filter(batch.column("is_word"))
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield close()
            held = []
    if held:
        yield close()


def _assemble(schema: pa.Schema):
    """Texts of one block from the ids of its words, by position. A block is bounded, so is its group."""

    def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        columns = [[_unpack(v) for v in words[c].to_pylist()] for c in ("numbers", "sizes", "ids")]
        number, sizes, values = (np.concatenate([np.zeros(0, "<u4"), *c]) for c in columns)
        at, ends = np.zeros(len(number), np.int64), np.cumsum(sizes, dtype=np.int64) * 4
        at[number] = np.arange(len(number))  # every number of a block is there once
        packs = {f.name: pa.chunked_array([c.field(f.name) for c in texts["pack"].chunks], type=f.type) for f in texts["pack"].type}
        ids_of, keys = (pa.chunked_array([c.flatten() for c in packs[name].chunks], type=packs[name].type.value_type) for name in ("id", "__fp"))
        parts, flat = [], values.tobytes()
        for sizes_of, numbers in zip(packs["sizes"].to_pylist(), packs["numbers"].to_pylist()):
            ids, n = _gather(flat, ends, at[_unpack(numbers)], 4)
            tokens = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(_unpack(sizes_of), dtype=np.int64)))]
            parts.append((np.diff(tokens), ids, tokens))
        counts = np.concatenate([p[0] for p in parts])
        done = pa.chunked_array(
            [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(t * 4), pa.py_buffer(i)]).cast(pa.binary()) for c, i, t in parts]
        )
        columns = [ids_of, keys, pa.array(counts.astype(np.int64)), done]
        return pa.table(columns, names=["id", "__fp", "n_tokens", "ids"]).cast(schema)

    return assemble


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, __fp, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row per row of ``docs``.

    Special tokens are ordinary text. A null text is an empty text and has no ids; so has a text without a match. Rows
    that repeat an id come back as often as they came. An empty table gives an empty result. Other columns are not needed.
    """
    # a task that is run again must cut the same blocks, also if its rows come in another order
    rows = keyed(docs, id_col, text_col).sortWithinPartitions("id", KEY)
    pack = T.StructType(
        [T.StructField("id", T.ArrayType(rows.schema["id"].dataType)), T.StructField(KEY, T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("sizes", "numbers")]
    )
    schema = T.StructType.fromDDL("word string, block bigint, number int").add("texts", T.ArrayType(pack))
    cut = dealt(rows.mapInArrow(_cut(pattern, block_bytes, to_arrow_schema(schema).field("texts").type), schema))
    found = _joined(cut, ranks, pattern).select("block", "number", "ids", F.col("texts").isNull().alias("is_word"))
    ids = found.mapInArrow(_by_block, "block bigint, numbers binary, sizes binary, ids binary")
    ids = ids.select(F.col("block").cast("string").alias("of"), "numbers", "sizes", "ids")
    # explode_outer and no filter before it: with the same columns and rows the texts are read from the exchange of the words
    texts = cut.select("word", "block", "number", F.explode_outer("texts").alias("pack")).where("pack IS NOT NULL")
    out = T.StructType([rows.schema["id"], rows.schema["__fp"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return texts.groupBy("word").cogroup(ids.groupBy("of")).applyInArrow(_assemble(to_arrow_schema(out)), out)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of a row's ids. The table of token bytes is as large as the vocabulary and goes to every task.

    Null ids give null; an unknown id is an error. Bytes need not be valid UTF-8, as ids may end inside a character.
    """
    table = token_bytes(ranks)
    joined, ends = b"".join(table), np.cumsum([len(t) for t in table]).astype(np.int64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PACK_TEXTS):
                batch, done = whole.slice(i, PACK_TEXTS), []
                for raw in batch.column(ids):
                    raw = raw.as_py()
                    done.append(None if raw is None else _gather(joined, ends, np.frombuffer(raw, "<u4"), 1)[0].tobytes())
                yield batch.append_column(out, pa.array(done, pa.binary()))

    kept = encoded.drop(out)
    return kept.mapInArrow(expand, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))
