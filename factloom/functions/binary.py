"""Sizes of programs embedded in longer payloads, told by their headers (little-endian ELF, WebAssembly)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the ELF format: by class, offsets of the fields that bound a file, up to the last one read.
_HEADER = {
    1: np.dtype({"names": ["phoff", "shoff", "ehsize", "phentsize", "phnum", "shentsize", "shnum"], "formats": ["<u4", "<u4"] + ["<u2"] * 5, "offsets": [28, 32, 40, 42, 44, 46, 48]}),
    2: np.dtype({"names": ["phoff", "shoff", "ehsize", "phentsize", "phnum", "shentsize", "shnum"], "formats": ["<u8", "<u8"] + ["<u2"] * 5, "offsets": [32, 40, 52, 54, 56, 58, 60]}),
}
_SEGMENT = {1: np.dtype({"names": ["offset", "filesz"], "formats": ["<u4", "<u4"], "offsets": [4, 16]}), 2: np.dtype({"names": ["offset", "filesz"], "formats": ["<u8", "<u8"], "offsets": [8, 32]})}
_ELF_LEAST, _WASM_LAST_SECTION, _LEB_BYTES = 64, 12, 10


def elf_size(data: bytes) -> int | None:
    """The furthest end of header, tables and segments; null if data is no whole ELF header or a segment entry lies outside."""
    if len(data) < _ELF_LEAST or data[:4] != b"\x7fELF" or data[5] != 1 or data[4] not in _HEADER:
        return None
    head = dict(zip(_HEADER[data[4]].names, map(int, np.frombuffer(data, _HEADER[data[4]], 1)[0]), strict=True))
    ends = [head["ehsize"]]
    ends += [head[at] + head[each] * head[n] for at, each, n in (("phoff", "phentsize", "phnum"), ("shoff", "shentsize", "shnum")) if head[at] and head[each] and head[n]]
    entry = _SEGMENT[data[4]]
    for at in range(head["phoff"], head["phoff"] + head["phentsize"] * head["phnum"], head["phentsize"] or 1):
        if at + entry.itemsize > len(data):
            return None
        ends.append(sum(map(int, np.frombuffer(data, entry, 1, at)[0])))
    return max(ends)


def leb128(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, place after it) of an unsigned LEB128 number of at most 64 bits; null if it is cut off or longer."""
    value = 0
    for k, byte in enumerate(data[at : at + _LEB_BYTES]):
        value |= (byte & 127) << (7 * k)
        if byte < 128:
            return value & (2**64 - 1), at + k + 1
    return None


def wasm_size(data: bytes) -> int | None:
    """The end of the last sound section: known ids, all but custom ones (0) in rising order, contents within data."""
    if len(data) < 8 or data[:4] != b"\0asm":
        return None
    end, last = 8, 0
    while end < len(data):
        kind, size = data[end], leb128(data, end + 1)
        if kind > _WASM_LAST_SECTION or size is None or 0 < kind <= last or sum(size) > len(data):
            break
        last, end = kind or last, sum(size)
    return end


def embedded_size(data: bytes | None) -> int | None:
    """Bytes of the program that data begins with; null if there is none or it would not fit."""
    if data is None:
        return None
    size = elf_size(data)
    size = wasm_size(data) if size is None else size
    return size if size and size <= len(data) else None


@F.pandas_udf(LongType())
def payload_size(content: pd.Series) -> pd.Series:
    """embedded_size of a binary column, in Arrow batches."""
    return content.map(embedded_size).astype("Int64")
