"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word stand in a doubly linked list; a heap holds the adjacent pairs
that the vocabulary can merge, lowest rank first and leftmost among equals. Popping and
merging until the heap is empty leaves ``initial symbols - merges`` tokens; identifiers
are never looked up. A character that the vocabulary lacks stands as its UTF-8 bytes,
which never merge.

Words are counted once per worker and kept in a bounded table: no piece of the
vocabulary holds a space mark after another character (checked when it is loaded), so
no merge crosses the start of a word, nor one of the characters that it lacks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Words kept by a worker; the table is emptied when it is full.
#: Words longer than this are counted each time.
CACHE_WORDS, CACHE_CHARS = 800_000, 64


def count_symbols(word: str, ranks: dict[str, float], known: set[str]) -> int:
    """Tokens of one word: initial symbols minus merges."""
    n = len(word)
    total = n + sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in word if c not in known)
    if n < 2:
        return total
    piece, left, right = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not piece[i] or j < 0 or len(piece[i]) + len(piece[j]) != size:
            continue  # one of the two was merged meanwhile
        piece[i] += piece[j]
        piece[j] = ""
        merges += 1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            pair = piece[i] + piece[k]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))
        k = left[i]
        if k >= 0:
            pair = piece[k] + piece[i]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, k, len(pair)))
    return total - merges


class Counter(dict):
    """word -> tokens; a missing word is counted by merging."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_file)
        self.ranks = {m.id_to_piece(i): -m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.known = {p for p in self.ranks if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ranks) or any(not self.known.issuperset(p) for p in self.ranks):
            raise ValueError("this vocabulary has pieces that cross the start of a word")
        if "\n" in self.known:
            raise ValueError("this vocabulary merges line ends")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = count_symbols(word, self.ranks, self.known)
        if len(word) <= CACHE_CHARS:  # else a text without blanks would be held whole
            self[word] = n
        return n

    _runs = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def text(self, text: str) -> int:
        """Tokens of a whole text, which gets a space mark in front if it isn't empty."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or f"{MARK}\n" in marked:
            return sum(map(self.__getitem__, self._runs.findall(marked)))
        words = marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ")
        return sum(map(self.__getitem__, words))


_counters: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    if model_file not in _counters:
        _counters[model_file] = Counter(model_file)
        _counters[model_file][""] = 0
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results,
    a null doc_id stays null, an empty table gives an empty result; other columns are
    not read, whatever their names. One pass, no shuffle: a worker's memory is the
    vocabulary, its word table and one Arrow batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((c.text(t) if t else 0 for t in map(pa.StringScalar.as_py, texts)), np.int64, len(texts))
            size = texts.cast(pa.binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())
            import pyarrow.compute as pc

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.fill_null(pc.binary_length(size), 0), pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
