"""Posting lists as bytes: deltas of ids and frequencies as variable-length integers. For exchange; tables store rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _put(out: bytearray, x: int) -> None:
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)


def encode_postings(postings: list[tuple[int, int]]) -> bytes:
    """Bytes of (doc_id, tf) pairs, by doc_id."""
    out, last = bytearray(), 0
    for doc, tf in sorted(postings):
        _put(out, doc - last)
        _put(out, tf)
        last = doc
    return bytes(out)


def decode_postings(data: bytes) -> list[tuple[int, int]]:
    numbers, x, shift = [], 0, 0
    for byte in data:
        x |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            numbers.append(x)
            x = shift = 0
    if shift or len(numbers) % 2:
        raise ValueError("the bytes end within a posting")
    found, doc = [], 0
    for delta, tf in zip(numbers[::2], numbers[1::2]):
        doc += delta
        found.append((doc, tf))
    return found


def merge_postings(a: bytes, b: bytes) -> bytes:
    """Both lists; a document in both stays twice."""
    return encode_postings(decode_postings(a) + decode_postings(b))


def encode_lists(lists: pa.ListArray) -> pa.BinaryArray:
    """``encode_postings`` of each list of (doc_id, tf), by doc_id already, by array arithmetic. No list is null."""
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    doc, tf = (flat.field(c).to_numpy() for c in (0, 1))
    numbers = np.empty(2 * len(doc), dtype=np.int64)
    numbers[::2] = np.diff(doc, prepend=0)
    first = ends[:-1][ends[:-1] < ends[1:]]
    numbers[2 * first], numbers[1::2] = doc[first], tf
    size = np.ones(len(numbers), dtype=np.int64)
    for k in range(7, 63, 7):
        size += numbers >> k > 0
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[begin[some] + k] = numbers[some] >> 7 * k & 0x7F | np.where(size[some] > k + 1, 0x80, 0)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(begin[2 * ends].astype(np.int32)), pa.py_buffer(out)])


def decode_lists(data: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the lists, doc_ids, frequencies): ``decode_postings`` of each value. No value is null."""
    bounds = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
    some = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    last = np.flatnonzero(some < 0x80)
    at = np.searchsorted(last, bounds - bounds[0])  # numbers that end before each value
    open_ = np.diff(bounds, prepend=bounds[0]) > 0
    if np.any(some[(bounds - bounds[0])[open_] - 1] >= 0x80) or np.any(at % 2):
        raise ValueError("the bytes end within a posting")
    begin = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    length, numbers = last - begin + 1, np.zeros(len(last), dtype=np.int64)
    for k in range(int(length.max(initial=0))):
        own = np.flatnonzero(length > k)
        numbers[own] |= (some[begin[own] + k] & 0x7F).astype(np.int64) << 7 * k
    ends, doc = at // 2, np.cumsum(numbers[::2])
    before = np.concatenate([[0], doc])[ends[:-1]]
    return ends, doc - np.repeat(before, np.diff(ends)), numbers[1::2]
