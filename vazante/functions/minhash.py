"""MinHash of character runs, vectorised over Arrow batches, in 32-bit arithmetic that any engine can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MASK = 0xFFFFFFFF
BASE, STIR = 0x9E3779B1, 0x2C1B3C6D
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def permutation(coordinate: int) -> tuple[int, int]:
    """What a coordinate xors a run's hash with, and the odd factor it multiplies the outcome by."""
    one = mix(np.array([2 * coordinate + 1, 2 * coordinate + 2], np.uint64) * _G)
    return int(one[0]) & MASK, int(one[1]) & MASK | 1


@lru_cache
def _permutations(coordinates: int) -> np.ndarray:
    return np.array([permutation(k) for k in range(coordinates)], np.uint32)


def run_hashes(text: str, width: int) -> np.ndarray:
    """32-bit hashes of all runs of ``width`` characters (of the whole text if it is shorter)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    number = max(1, len(points) - width + 1)
    out = np.zeros(number, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(points))):
            out = out * np.uint32(BASE) + points[k : k + number] + np.uint32(1)
        return (out ^ (out >> np.uint32(15))) * np.uint32(STIR)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each coordinate's permutation; long texts go block by block."""
    params = _permutations(coordinates)
    low = np.full(coordinates, MASK, np.uint32)
    for at in range(0, len(hashes), 8192):
        with np.errstate(over="ignore"):
            low = np.minimum(low, ((hashes[None, at : at + 8192] ^ params[:, :1]) * params[:, 1:]).min(1))
    return low


SEEN_LIMIT = 1_000_000


def signatures(texts: DataFrame, coordinates: int = 128, width: int = 5) -> DataFrame:
    """``id, digest, sig`` of ``texts(id, text)``; null and empty texts are skipped.

    ``digest`` tells texts apart. ``sig`` is null where a task has already given it for the same text, so
    copies cost no signature and carry none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, digests, sigs = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                ids.append(i)
                digests.append(digest)
                sigs.append(None if digest in seen else signature(run_hashes(text, width), coordinates).tobytes())
                if len(seen) >= SEEN_LIMIT:
                    seen.clear()
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "digest", "sig"])

    return texts.select("id", "text").mapInArrow(run, "id long, digest binary, sig binary")


def banded(sigs: DataFrame, bands: int = 16) -> DataFrame:
    """``id, bands array<long>, sk0, sk1`` of ``sigs(id, sig)``.

    The sketches hold one bit of each of the first 128 coordinates: two signatures that agree in all but d
    coordinates differ in at most d bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            rows = wide.shape[1] // bands
            keys = np.zeros((len(wide), bands), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    keys = mix(keys * _G + wide[:, r::rows][:, :bands])
                keys = mix(keys + np.arange(bands, dtype=np.uint64) * _G)
            bit = np.zeros((len(wide), 128), np.uint8)
            bit[:, : min(wide.shape[1], 128)] = (mix(wide[:, :128]) & np.uint64(1)).astype(np.uint8)
            sketch = np.packbits(bit, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(keys.view(np.int64))), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in (0, 1))],
                ["id", "bands", "sk0", "sk1"],
            )

    return sigs.select("id", "sig").mapInArrow(run, "id long, bands array<long>, sk0 long, sk1 long")
