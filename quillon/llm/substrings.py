"""Removal of byte strings that occur twice (operator 6). The method and where it departs from the suffix sort: README."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .windows import U, Scheme, mix, repeated_units

SIZE = 200
GRAM = 100
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
VALUES = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


def byte_values(text: bytes) -> np.ndarray:
    return VALUES[np.frombuffer(text, np.uint8)]


def kept_bytes(text: bytes, gone: np.ndarray) -> tuple[int, int, int, str]:
    n = int(gone.sum())
    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
    return len(text), n, spans, hashlib.sha256(kept).hexdigest()


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: its bytes, those covered by a string of `size` bytes that starts elsewhere too, their runs, the hash of the rest.

    Null or empty text, and texts shorter than `size`, lose nothing; repeated rows count as other places, so both lose
    all; strings never cross documents; a null id gets its row; an empty table gives none; extra columns are ignored.
    """
    return repeated_units(docs, Scheme(byte_values, size, max(1, size // 2)), kept_bytes, SCHEMA, id_col, text_col)
