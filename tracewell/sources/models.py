"""Models behind plain functions of batches; deterministic stand-ins where none is given."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class TextModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OcrReader(Protocol):
    def read(self, image: bytes) -> list[tuple[str, float, float, float, float, float]]: ...


class ContextOverflow(RuntimeError):
    """A prompt that the model can't hold: the run must end, the row must not be skipped."""


class Cancelled(BaseException):
    """The run was called off: no handler of failures may take this for one."""


class Retry:
    """A model whose calls are tried again after failures that may pass (by default lost connections), `times` times in all, waiting
    longer each time. What is asked too long, called off or timed out while it was read is not tried again. Vectors that come with
    their places, as pairs, are put in order."""

    def __init__(self, model, times: int = 3, wait: float = 0.5, passing: tuple[type[Exception], ...] = (ConnectionError,)) -> None:
        self.model, self.times, self.wait, self.passing = model, times, wait, passing

    def call(self, f: Callable[[list[str]], list], values: list[str]) -> list:
        for k in range(1, self.times + 1):
            try:
                return f(values)
            except ContextOverflow:
                raise
            except self.passing:
                if k == self.times:
                    raise
                time.sleep(self.wait * 2 ** (k - 1))
        return []

    def generate(self, prompts: list[str]) -> list[str]:
        return self.call(self.model.generate, prompts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = self.call(self.model.embed, texts)
        if found and isinstance(found[0], tuple):
            found = [v for _, v in sorted(found, key=lambda x: x[0])]
        return found


class EchoModel:
    """Answers with the last line of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.strip().rpartition("\n")[2] for p in prompts]


class HashEmbedder:
    """Unit vectors from hashed words."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def apply_model(df: DataFrame, column: str, call: Callable[[list[str]], list], out: str, kind: str, batch: int = 64) -> DataFrame:
    """df with out, the model's answer to column, and out_error: one row's failure is that row's, an overflow is the run's."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            values = frame[column].fillna("").tolist()
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                try:
                    answers += call(part)
                    errors += [None] * len(part)
                except ContextOverflow:
                    raise
                except Exception:  # noqa: BLE001  one by one, to tell which
                    for v in part:
                        try:
                            answers += call([v])
                            errors.append(None)
                        except ContextOverflow:
                            raise
                        except Exception as e:  # noqa: BLE001
                            answers.append(None)
                            errors.append(str(e))
            yield frame.assign(**{out: answers, f"{out}_error": errors})

    return df.mapInPandas(run, f"{columns}, {out} {kind}, {out}_error string")


def embed_chunks(chunks: DataFrame, model: Embedder, name: str) -> DataFrame:
    """chunks with embedding, dims and model."""
    from pyspark.sql import functions as F

    rows = apply_model(chunks.drop("embedding", "dims", "model"), "text", model.embed, "embedding", "array<float>")
    return rows.withColumns({"dims": F.size("embedding"), "model": F.lit(name)})
