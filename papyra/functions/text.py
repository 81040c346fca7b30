"""Text analysis as columns: white space, transliteration, tokens, stems, chunks, keys."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.stemmer import stem

MIN_TOKEN, MAX_TOKEN = 2, 25
LOOK_BACK = 100


def _latin() -> tuple[str, str, list[tuple[str, str]]]:
    plain, letters = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFKD", c)[0]
        if c == c.lower() and base.isascii() and base.isalpha() and base != c:
            letters.append(c)
            plain.append(base)
    for c, base in zip("øđłħŧıŋ", "odlhtin"):
        if c not in letters:
            letters.append(c)
            plain.append(base)
    return "".join(letters), "".join(plain), [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")]


#: Lower-case letters, what each becomes, and the letters that become several.
ACCENTED, PLAIN, PAIRS = _latin()


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space, of any script, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def transliterate(lower: Column) -> Column:
    """ASCII letters for the Latin ones with marks. Letters of other scripts stay, and so separate tokens."""
    for a, b in PAIRS:
        lower = F.replace(lower, F.lit(a), F.lit(b))
    return F.translate(lower, ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Array of runs of a-z of 2 to 25 letters, in order, with repeats; null for null."""
    parts = F.split(transliterate(F.lower(text)), "[^a-z]+")
    return F.filter(parts, lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))


_TABLE = str.maketrans(dict(zip(ACCENTED, PLAIN)) | dict(PAIRS))


def python_tokens(text: str) -> list[str]:
    """What ``tokens`` gives for one text."""
    return [t for t in re.split("[^a-z]+", text.lower().translate(_TABLE)) if MIN_TOKEN <= len(t) <= MAX_TOKEN]


#: What Java's (?U)\s matches, but for the space.
_WHITE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}][ {_WHITE}]*| [ {_WHITE}]+")
_MARKED = re.compile("[^\x00-\x7f]")
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def squeezed(text: str) -> str:
    """What ``normalize_whitespace`` gives for one text."""
    return _RUN.sub(" ", text).strip(" ")


def _letters(text: str) -> bytes:
    low = text.lower()
    return (low if low.isascii() else _MARKED.sub(lambda m: _TABLE.get(ord(m[0]), " "), low)).encode().translate(_LETTERS)


def token_lists(texts: list[str]) -> pa.ListArray:
    """``tokens`` of each text, by array arithmetic over the bytes of all of them."""
    parts = [_letters(t) for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(data != 32)) + 1
    begin, n = edge[::2], edge[1::2] - edge[::2]
    own = (n >= MIN_TOKEN) & (n <= MAX_TOKEN)
    begin, n = begin[own], n[own]
    step = np.zeros(len(data), dtype=np.int8)
    step[begin], step[begin + n] = 1, -1
    letters = data[np.cumsum(step, dtype=np.int8).astype(bool)]
    words = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(letters.tobytes()))
    at = np.searchsorted(begin, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words)


def stemmed(words: pa.Array) -> pa.Array:
    """Stem of each word; each distinct one is stemmed once."""
    coded = words.dictionary_encode()
    return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def offsets_from_zero(lists: pa.Array) -> pa.Array:
    """Offsets of a list array into its ``flatten()``; null where a list is null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))


def stems(words: Column) -> Column:
    """Stems of an array of tokens."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(offsets_from_zero(rows), stemmed(rows.flatten()))

    return F.arrow_udf(run, "array<string>")(words)


def analyze(text: Column, profile: str = "pt") -> Column:
    """Tokens of ``text``: stemmed (profile ``pt``) or as they are (``none``)."""
    if profile not in ("pt", "none"):
        raise ValueError(f"unknown profile {profile}")
    return stems(tokens(text)) if profile == "pt" else tokens(text)


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``text``: each ends at the last space of its last 100 characters, if there is one, and begins ``overlap`` before the last's end."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    spans, s = [], 0
    while True:
        e = min(s + size, n)
        if e < n:
            at = text.rfind(" ", max(e - LOOK_BACK, s), e)
            if at > s:
                e = at
        spans.append((s, e))
        if e >= n:
            return spans
        ahead = e - overlap if e > overlap else e
        s = ahead if ahead > s else e


def chunk_text(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Array of trimmed, non-empty chunks of a normalised text, in order.

    An Arrow UDF: with built-in functions each chunk would search the UTF-8 text from its start, in quadratic time on books.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap from 0 to below size")

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [c for a, b in chunk_spans(t, size, overlap) if (c := t[a:b].strip())] for t in texts], dtype=object)

    return F.pandas_udf(cut, "array<string>")(text)


def title_key(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only: equal for editions of one title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " "))


def shard_key(book_id: Column) -> Column:
    """First two characters, zeros before a shorter one."""
    return F.lpad(F.substring(book_id, 1, 2), 2, "0")


def known(value: Column) -> Column:
    """``Unknown`` for null and empty strings."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("Unknown"))


def phrase_tokens(query: Column) -> Column:
    """What a phrase query looks for: letters, digits and spaces of ``query``, lower case, by word."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N} ]", ""), " +", " "))
    return F.filter(F.split(clean, " "), lambda t: t != "")


def json_field(text: str, name: str) -> str | None:
    """First string value of ``name`` in JSON text, found without parsing it."""
    m = re.search(rf'"{re.escape(name)}"\s*:\s*"([^"]*)"', text)
    return m[1] if m else None
