"""Word-piece counts by a longest-match automaton: one step per character, no pieces are built."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vicinal.llm import words as W
from vicinal.llm.rows import KEY, keyed, slices

#: Stands before every word, as in the vocabulary.
MARK = "▁"
#: Bytes of text whose different words are counted at once.
SLICE_BYTES = 16 << 20


class Automaton:
    """Trie of the vocabulary. A node's failure link is where matching goes on when the longest piece on the way to it, and
    those after it, are taken off the front; ``popped`` is how many tokens that makes.

    A character without a piece of its own costs one token per UTF-8 byte, as with byte fallback.
    """

    def __init__(self, pieces: Iterable[str]):
        costs = dict.fromkeys((p for p in pieces if p), 1)
        for c in {c for p in costs for c in p}:
            costs.setdefault(c, len(c.encode()))
        self.next: list[dict[str, int]] = [{}]
        ends = [0]
        for piece, cost in costs.items():
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(0)
                node = self.next[node][c]
            ends[node] = cost
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = [0]
        for node in queue:
            for c, child in self.next[node].items():
                queue.append(child)
                if ends[child]:
                    self.popped[child] = ends[child]
                    continue
                # single characters are pieces, so the root, which is reached at last, has an arc for c
                back, popped = self.fail[node], self.popped[node]
                while c not in self.next[back]:
                    popped += self.popped[back]
                    back = self.fail[back]
                self.fail[child], self.popped[child] = self.next[back][c], popped

    def count(self, word: str) -> int:
        arcs, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for c in word:
            while (to := arcs[node].get(c)) is None:
                if not node:
                    total += len(c.encode())
                    to = 0
                    break
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


def greedy_pieces(word: str, pieces: set[str]) -> int:
    """The definition the automaton must agree with: the longest piece first, a byte each where there is none."""
    n = at = 0
    longest = max(map(len, pieces), default=1)
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        n += 1 if size else len(word[at].encode())
        at += size or 1
    return n


def sentencepiece_vocabulary(path: str) -> list[str]:
    """Pieces of a model file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)))
    return [model.id_to_piece(i) for i in plain]


def _count(pieces: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(pieces)
        for batch in slices(batches, "text", SLICE_BYTES):
            column = batch.column("text")
            raw, at = W.buffers(column)
            opens, closes = W.bounds(raw, at)
            numbers, first = W.words(column)
            _, where, which = np.unique(numbers, return_index=True, return_inverse=True)
            data = raw.tobytes()
            spans = zip(opens[where].tolist(), closes[where].tolist())
            costs = np.fromiter((automaton.count(MARK + data[a:b].decode()) for a, b in spans), np.int64, len(where))
            sums = np.concatenate(([0], np.cumsum(costs[which])))
            columns = [batch.column("id"), batch.column(KEY), pa.array(np.diff(first)), pa.array(np.diff(sums[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", KEY, "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __fp, n_words, n_tokens), one row per row of ``docs``.

    Words end at white space; each counts as MARK + word, cut greedily into the longest pieces. The vocabulary goes to every
    task, which checks each different word of a stretch of text once. Null and empty texts have neither words nor tokens;
    an empty vocabulary costs one token per byte. Repeated rows come back as often as they came; other columns are not
    needed. Nothing is shuffled.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    pieces = list(pieces)
    return rows.mapInArrow(_count(pieces), f"id {id_type}, {KEY} bigint, n_words bigint, n_tokens bigint")
