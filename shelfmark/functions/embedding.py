"""Embedding models as Arrow stages: a protocol, and a deterministic default that needs no weights."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TextModel(Protocol):
    """Loaded once per task; ``encode`` gives one unit vector per text. ``query`` tells queries from passages."""

    dims: int

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray: ...


class HashingModel:
    """Words and their letter trigrams hashed into signed dimensions, then scaled to length 1."""

    def __init__(self, dims: int = 64):
        if dims < 1:
            raise ValueError("a vector needs at least one dimension")
        self.dims = dims

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            if not text or not text.strip():
                raise ValueError("an empty text has no vector")
            for word in re.findall(r"\w+", text.casefold()) or [text.casefold()]:
                for feature in [word, *(f"#{word}#"[k : k + 3] for k in range(len(word)))]:
                    code = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                    row[code % self.dims] += 1.0 if code >> 63 else -1.0
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


class ImageModel(Protocol):
    """Vectors of image files, and of texts in the same space."""

    dims: int

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray: ...

    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


class AudioModel(Protocol):
    """Vectors of mono samples at ``sampling_rate`` of at most ``max_seconds``, and of texts in the same space."""

    dims: int
    sampling_rate: int
    max_seconds: float
    batch_size: int

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray: ...

    def encode_audio(self, samples: list[np.ndarray]) -> np.ndarray: ...


class ByteImageModel(HashingModel):
    """Pairs of neighbouring bytes hashed into dimensions: files of like content are alike. No pixels are decoded."""

    def encode_images(self, images: list[bytes]) -> np.ndarray:
        out = np.zeros((len(images), self.dims))
        for row, raw in zip(out, images):
            codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
            if not len(codes):
                raise ValueError("an empty image has no vector")
            pairs = (codes[:-1] << 8 | codes[1:]) * np.uint32(2654435761) if len(codes) > 1 else codes
            np.add.at(row, pairs % self.dims, np.where(pairs >> 31, 1.0, -1.0))
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


class SpectrumAudioModel(HashingModel):
    """Energy of as many frequency bands as there are dimensions, compressed and scaled to length 1."""

    def __init__(self, dims: int = 64, sampling_rate: int = 8000, max_seconds: float = 10.0, batch_size: int = 32):
        super().__init__(dims)
        if sampling_rate < 1 or max_seconds <= 0 or batch_size < 1:
            raise ValueError("rate, length and batch size must be positive")
        self.sampling_rate, self.max_seconds, self.batch_size = sampling_rate, max_seconds, batch_size

    def encode_audio(self, samples: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(samples), self.dims))
        for row, mono in zip(out, samples):
            if mono.ndim != 1 or not len(mono):
                raise ValueError("a range needs mono samples")
            power = np.abs(np.fft.rfft(mono, max(len(mono), 2 * self.dims)))
            row += np.log1p([band.mean() for band in np.array_split(power, self.dims)])
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def checked_vectors(found: np.ndarray, count: int, dims: int) -> np.ndarray:
    """Vectors of a model as 32-bit numbers; another count, size or a number that isn't finite is an error."""
    out = np.asarray(found, dtype=np.float32)
    if out.shape != (count, dims) or not np.isfinite(out).all():
        raise ValueError(f"a model must give {count} finite vectors of {dims} numbers")
    return out


def vector_name(model: str, version: int = 1) -> str:
    """Name of a model's vectors: lower case, every run of other signs one underscore, and a version."""
    slug = re.sub(r"[^a-z0-9]+", "_", model.casefold()).strip("_")
    if not slug:
        raise ValueError("a model needs a name with letters or digits")
    return f"{slug}_v{version}"


class ModelSlot:
    """Holds at most one loaded model: asking for another one closes it first."""

    def __init__(self, factories: dict[str, Callable[[], object]]):
        self._factories, self._name, self._model = factories, None, None

    def use(self, name: str) -> object:
        if name not in self._factories:
            raise KeyError(f"no model for {name!r}")
        if name != self._name:
            self.close()
            self._model, self._name = self._factories[name](), name
        return self._model

    def close(self) -> None:
        if self._model is not None and hasattr(self._model, "close"):
            self._model.close()
        self._name = self._model = None


def embed(text: Column, model: TextModel) -> Column:
    """Vectors of a text column; null and blank texts give null. The model is pickled to the tasks and used batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if isinstance(t, str) and t.strip() else None for t in batch]
            vectors = iter(())
            if any(texts):
                asked = [t for t in texts if t]
                vectors = iter(checked_vectors(model.encode(asked), len(asked), model.dims))
            yield pd.Series([next(vectors) if t else None for t in texts], dtype=object)

    return run(text)
