"""Embedding and language-model slots, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class TransientError(RuntimeError):
    """An error after which a request may be tried again."""


@dataclass(frozen=True)
class Decoding:
    """How a model is to answer."""

    temperature: float
    most_tokens: int | None


# Decoding of each kind of call.
DECODING = {
    "chat": Decoding(0.2, 2048), "evaluation": Decoding(0.2, 1024), "context": Decoding(0.1, 256), "rerank": Decoding(0.0, 120),
    "extract": Decoding(0.0, 512), "judge": Decoding(0.0, 12), "risk": Decoding(0.1, None),
}


def doubling(i: int) -> float:
    """Seconds before try i + 2: 1, 2, 4 and so on."""
    return 2.0**i


def in_steps(i: int) -> float:
    """Seconds before try i + 2: 3, 6, 9 and so on."""
    return 3.0 * (i + 1)


def md5_embedding(text: str, width: int = 64) -> list[float]:
    """Numbers from -1 to 1 from the bytes of the MD5 sums of the text and a counter; the same everywhere."""
    raw = b"".join(hashlib.md5(f"{i}:{text}".encode()).digest() for i in range(-(-width // 16)))
    return [float(x) for x in (np.frombuffer(raw, np.uint8)[:width].astype(np.float32) - 128) / 128]


def md5_provider(texts: list[str], width: int = 64) -> list[list[float]]:
    return [md5_embedding(t, width) for t in texts]


def with_retry(call: Callable, attempts: int = 3, wait: Callable[[int], float] = doubling, sleep: Callable[[float], None] = time.sleep, retryable: type = TransientError) -> Callable:
    """Tries again after transient errors, waiting in between; the last error is raised at once."""

    def run(*args, **kwargs):
        for i in range(attempts):
            try:
                return call(*args, **kwargs)
            except retryable:
                if i == attempts - 1:
                    raise
                sleep(wait(i))

    return run


def for_evaluation(call: Callable, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """A call with four tries after any error, in growing steps; it waits after the last, too."""

    def run(*args, **kwargs):
        error: Exception | None = None
        for i in range(4):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                error = e
                sleep(in_steps(i))
        raise error

    return run


def configured(chain: dict[str, Callable | None]) -> list[Callable]:
    """The providers that are set up, in order."""
    return [call for call in chain.values() if call is not None]


def first_that_works(chain: list[Callable]) -> Callable:
    """Calls providers in order until one answers; the last error is raised if none does."""

    def run(*args, **kwargs):
        error: Exception | None = None
        for call in chain:
            try:
                return call(*args, **kwargs)
            except Exception as e:  # any failure moves on to the next
                error = e
        raise error or RuntimeError("no provider is configured")

    return run


def first_that_starts(chain: list[Callable[[str], Iterator[str]]]) -> Callable[[str], Iterator[str]]:
    """A stream of pieces from the first provider that yields one; later errors of that one are raised."""

    def run(prompt: str) -> Iterator[str]:
        error: Exception | None = None
        for call in chain:
            try:
                pieces = iter(call(prompt))
                first = next(pieces)
            except StopIteration:
                return
            except Exception as e:  # nothing was sent yet
                error = e
                continue
            yield first
            yield from pieces
            return
        raise error or RuntimeError("no provider is configured")

    return run


def embedded(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]] = md5_provider, batch: int = 64, width: int = 64, most: int | None = None, attempts: int = 3, wait: Callable[[int], float] = doubling) -> DataFrame:
    """key and embedding of each row; requests hold at most `batch` texts, or `most`, what the provider takes, if that is less.

    Transient errors are tried again. A reply of another size or width is an error. Null texts count as empty.
    """
    kind = rows.schema[key].dataType.simpleString()
    size = min(batch, most or batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(provider, attempts, wait)
        for b in batches:
            texts, out = [t or "" for t in b["_text"]], []
            for i in range(0, len(texts), size):
                got = call(texts[i : i + size])
                if len(got) != len(texts[i : i + size]) or any(len(v) != width for v in got):
                    raise ValueError("the provider's reply does not fit the request")
                out += got
            if out:
                yield pd.DataFrame({key: b[key].to_numpy(), "embedding": out})

    return rows.selectExpr(f"`{key}`", f"`{text}` AS _text").mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def called(rows: DataFrame, key: str, text: str, call: Callable[[str], str], at_once: int = 4, failed: str | None = None) -> DataFrame:
    """key and reply of a slow call for each row, `at_once` of them at a time in each worker. Null texts count as empty.

    Where `failed` is given, a call that raises has it as its reply; else the error ends the query.
    """
    kind = rows.schema[key].dataType.simpleString()

    def softly(prompt: str) -> str:
        try:
            return call(prompt)
        except Exception:
            if failed is None:
                raise
            return failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({key: b[key].to_numpy(), "reply": list(pool.map(softly, [t or "" for t in b["_text"]]))})

    return rows.selectExpr(f"`{key}`", f"`{text}` AS _text").mapInPandas(run, f"`{key}` {kind}, reply string")
