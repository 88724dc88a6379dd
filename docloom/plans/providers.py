"""Remote models behind interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Fixed limits of one call to an embedding service.
CALL_TEXTS, CALL_TOKENS = 30, 6500


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Unit vectors of signed word hashes."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def calls(texts: list[str], most: int = CALL_TEXTS, tokens: int = CALL_TOKENS) -> Iterator[list[str]]:
    """Texts in order, in calls of bounded number and estimated tokens."""
    call: list[str] = []
    size = 0
    for t in texts:
        n = max(1, len(t) // 4)
        if call and (len(call) == most or size + n > tokens):
            yield call
            call, size = [], 0
        call.append(t)
        size += n
    if call:
        yield call


def with_embeddings(chunks: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """chunks (with content) and their embedding; put deduplication before it."""
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            texts = [t or "" for t in batch.column("content").to_pylist()]
            found = [v for call in calls(texts) for v in model.embed(call)]
            flat = np.concatenate([*found, np.zeros(0, np.float32)]).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * model.dims), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


# -- calls that may fail ---------------------------------------------------------------

#: Tries of one provider, and the base of the wait before the next try.
TRIES, WAIT_BASE = 3, 2.0
#: Calls that one task has open at a time.
AT_ONCE = 4


class Passing(Exception):
    """A failure that may pass by itself: a limit reached, a server or network down."""


class Provider(Protocol):
    name: str

    def answer(self, text: str) -> str: ...


class StandIn:
    """A provider without a network: it fails in passing for the first `passing` calls of a
    text, for good where `never` is in it, and names itself in its answers else."""

    def __init__(self, name: str, passing: int = 0, never: str = "") -> None:
        self.name, self.passing, self.never = name, passing, never
        self.seen: dict[str, int] = {}

    def answer(self, text: str) -> str:
        self.seen[text] = self.seen.get(text, 0) + 1
        if self.never and self.never in text:
            raise ValueError("bad request")
        if self.seen[text] <= self.passing:
            raise Passing("429")
        return f"{self.name} says {text}"


def ask(text: str, chain: Sequence[Provider], tries: int = TRIES, base: float = WAIT_BASE, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int, str | None]:
    """Answer, who gave it, calls made and what went wrong, of the first provider that
    answers. A passing failure is tried again, base ** n seconds after the n-th try; any
    other, and the last try's, leaves the text to the next provider."""
    wrong, made = [], 0
    for provider in chain:
        for n in range(1, tries + 1):
            made += 1
            try:
                return provider.answer(text), provider.name, made, "; ".join(wrong) or None
            except Passing as e:
                wrong.append(f"{provider.name}: {e}")
                if n < tries:
                    sleep(base**n)
            except Exception as e:  # noqa: BLE001  whatever a provider throws is the row's, not the task's
                wrong.append(f"{provider.name}: {e}")
                break
    return None, None, made, "; ".join(wrong)


def answered(rows: DataFrame, chain: Callable[[], Sequence[Provider]], text: str = "text", tries: int = TRIES, base: float = WAIT_BASE, at_once: int = AT_ONCE) -> DataFrame:
    """rows with answer, provider, calls and error (all that went wrong on the way) of
    their column text. chain makes the providers, in their order, once per task. A row
    that none answers stays, without answer; a null text is asked as an empty one.

    A task keeps at_once calls open over one Arrow batch, so calls to a service are bounded
    by the number of tasks; a task that is lost asks again for its rows. Write the result
    before more than one reader uses it."""
    from pyspark.sql import types as T

    taken = {c.lower() for c in rows.columns} & {"answer", "provider", "calls", "error"}
    if taken:
        raise ValueError(f"rows has columns {sorted(taken)} already")
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("calls", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        providers = chain()
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(lambda t: ask(t or "", providers, tries, base), batch.column(text).to_pylist()))
                more = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)] if found else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)
