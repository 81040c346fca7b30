"""Secret scan: guess cost of values in credential contexts.

A context is a credential word (password, token, api key, ...) with ``:``, ``=``, ``:=`` or ``=>`` and a value, quoted or up to
white space less delimiters at its end, or the word ``bearer`` with a value. The cost of a value is the least log10 number of guesses over all ways to cut it
into spans of five kinds:

* word: a listed word or one of the corpus's frequent ones, its rank, times 2 for each look-alike sign, times the number of capital patterns;
* date: 4 to 8 digits, or three numbers with one separator, that read as a date: 365 x max(years from 2025, 20), x 4 with separators;
* repeat: a unit at least twice: guesses of the unit x count;
* walk: at least 3 neighbouring keys of a row-based keyboard: 47 x length x 4.6 to the number of turns;
* brute force: any characters, 10 guesses each.

Each span after the first doubles the guesses. Dynamic programming over end positions finds the minimum. A repeat or walk span may be as long as the value:
its cost is a constant of its start plus the logarithm of its length plus a constant of its end, and two such curves cross once at most, so each
run keeps a stack of starts of which the last is the best. Repeats are looked for in runs: longest stretches of one period. A caller may bound
such spans by ``longest``; a longer run is then several spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import discard, materialize, trimmed

_WORDS = """password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou master sunshine ashley bailey passw0rd
shadow superman michael football welcome jesus ninja mustang jordan hunter buster soccer harley batman andrew tigger charlie robert
thomas hockey ranger daniel starwars klaster george computer michelle jessica pepper freedom maggie ginger princess joshua cheese
amanda summer love hello secret admin root test guest user login pass token key changeme change default example sample dummy
placeholder replace insert your here this none null true false value string public private access client server api auth bearer
demo temp temporary foo bar baz fake mock todo undefined empty enter type my the is not for and with from that have what when where
database mysql postgres redis oracle docker kubernetes amazon google github gitlab service account system manager production staging
development local host localhost internal office company business school home family friend mother father brother sister black white
green yellow orange purple silver golden diamond flower garden winter spring autumn january february march april june july august
september october november december monday tuesday wednesday thursday friday saturday sunday matrix phoenix thunder lightning
hammer knight wizard cookie banana apple cherry chocolate coffee pizza happy lucky angel devil heaven magic power killer money
dollar rocket player winner trustno1 zaq12wsx hunter2 correct horse battery staple""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(dict.fromkeys(_WORDS))))}
#: Letters of the longest word of a corpus that is looked up.
LONGEST_WORD = 25
_LOOK = {"0": "o", "1": "l", "3": "e", "4": "a", "@": "a", "$": "s", "5": "s", "7": "t", "!": "i", "|": "l"}
_PLAIN = str.maketrans(_LOOK)
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_KEYS = {c: (x, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row) if c != " "}
_DIGITS = re.compile(r"\d{4,8}\Z")
_PARTS = re.compile(r"(\d{1,4})([-/._ ])(\d{1,2})\2(\d{1,4})\Z")
LIMIT = 64
JOIN = math.log10(2)
_TURN = math.log10(4.6)

_CREDENTIAL = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ \-]?key|access[_ \-]?key|private[_ \-]?key|auth[_ \-]?key|credentials?|bearer", re.IGNORECASE)
_OPERATOR = re.compile(r":=|=>|[:=]")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
_VALUE = re.compile(r"\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'`]+))")
_BEARER = re.compile(r"\b(bearer)[ \t]+([a-z0-9._~+/=\-]{8,})", re.IGNORECASE)
#: What may follow an unquoted value and is no part of it.
_TAIL = ",;.)]}>"
#: A text without any of these has no context.
GATE = "pass|pwd|secret|token|key|credential|bearer"


def _word(span: str, ranks: Mapping[str, int] = RANK) -> float | None:
    low = span.lower()
    rank, swaps = ranks.get(low), 0
    if rank is None:
        plain = low.translate(_PLAIN)
        if plain == low:
            return None
        rank, swaps = ranks.get(plain), sum(c in _LOOK for c in low)
        if rank is None:
            return None
    upper = sum(c.isupper() for c in span)
    if not upper:
        capitals = 1
    elif upper == len(span) or (upper == 1 and span[0].isupper()):
        capitals = 2
    else:
        lower = sum(c.islower() for c in span)
        capitals = max(2, sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))
    return math.log10(rank * capitals) + swaps * JOIN


def _is_day(d: int, m: int) -> bool:
    return 1 <= d <= 31 and 1 <= m <= 12


def _date(span: str) -> float | None:
    years: list[int] = []

    def year(t: str) -> int | None:
        if len(t) == 4:
            return int(t) if 1900 <= int(t) <= 2099 else None
        return 2000 + int(t) if len(t) == 2 and int(t) < 50 else 1900 + int(t) if len(t) == 2 else None

    def add(a: str, b: str, c: str) -> None:
        for y, p, q in ((a, b, c), (c, a, b)):
            if (v := year(y)) is not None and 1 <= len(p) <= 2 and 1 <= len(q) <= 2 and (_is_day(int(p), int(q)) or _is_day(int(q), int(p))):
                years.append(v)

    apart = _PARTS.match(span)
    if apart:
        add(apart[1], apart[3], apart[4])
    elif _DIGITS.match(span) and span.isascii():
        for i in range(1, len(span) - 1):
            for j in range(i + 1, len(span)):
                add(span[:i], span[i:j], span[j:])
    if not years:
        return None
    return math.log10(365 * max(20, min(abs(y - 2025) for y in years)) * (4 if apart else 1))


def _step(a: str, b: str) -> tuple[int, int] | None:
    p, q = (_KEYS.get(c.lower().translate(_SHIFTED)) for c in (a, b))
    if p is None or q is None:
        return None
    d = (q[0] - p[0], q[1] - p[1])
    return d if d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) else None


def _walk(span: str) -> float | None:
    if len(span) < 3:
        return None
    steps = [_step(a, b) for a, b in zip(span, span[1:])]
    if None in steps:
        return None
    turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
    return math.log10(47 * len(span)) + turns * _TURN


@lru_cache(maxsize=1 << 14)
def _repeat(span: str) -> float | None:
    costs = []
    for u in range(1, len(span) // 2 + 1):
        if len(span) % u == 0 and span[:u] * (len(span) // u) == span:
            costs.append(guess_cost(span[:u])[0] + math.log10(len(span) // u))
    return min(costs, default=None)


KINDS = {"word": _word, "date": _date, "repeat": _repeat, "walk": _walk}


def span_cost(kind: str, span: str, longest: int | None = LIMIT) -> float | None:
    """log10 guesses of a span of one kind; None where it is not of that kind, or a repeat or walk of more than ``longest`` characters."""
    if kind in ("repeat", "walk") and longest is not None and len(span) > longest:
        return None
    return float(len(span)) if kind == "brute" else KINDS[kind](span)


class _Starts:
    """Starts of spans of one run, of which the one with the least value + log10(end - start) is asked for, with ends that rise.

    An earlier start gains on a later one as the end rises: on the stack each start is better than the one below it, until it is not for good.
    """

    def __init__(self) -> None:
        self.held: list[tuple[float, int, float]] = []  # value, start, the end up to which it is better than the one below

    def put(self, value: float, start: int, end: int) -> None:
        held = self.held
        while held:
            v, i, until = held[-1]
            if value <= v:  # as cheap and later: better at every end
                held.pop()
                continue
            if value - v > 300:
                return
            r = 10 ** (value - v)
            own = (r * start - i) / (r - 1)
            if own < end:
                return
            if until > own or len(held) == 1:
                held.append((value, start, own))
                return
            held.pop()
        held.append((value, start, math.inf))

    def best(self, end: int) -> tuple[float, int]:
        held = self.held
        while len(held) > 1 and held[-1][2] < end:
            held.pop()
        value, start, _ = held[-1]
        return value + math.log10(end - start), start


def _runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period): longest stretches of each least period, at least two periods long."""
    n = len(value)
    a = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found: list[tuple[int, int, int]] = []
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[False], a[:-p] == a[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + p).tolist()):
            if e - s >= 2 * p and not any(p % q == 0 and c <= s and e <= d for c, d, q in found):
                found.append((s, e, p))
    return found


def _walks(value: str) -> list[tuple[int, int, list[int]]]:
    """(start, end, turns up to each step) of longest walks of at least 3 keys."""
    steps = [_step(a, b) for a, b in zip(value, value[1:])] + [None]
    found, s = [], 0
    for t, step in enumerate(steps):
        if step is None:
            if t - s >= 2:
                turns = [0]
                for u in range(s + 1, t):
                    turns.append(turns[-1] + (steps[u] != steps[u - 1]))
                found.append((s, t + 1, turns))
            s = t + 1
    return found


def _fixed(value: str, ranks: Mapping[str, int]) -> list[list[tuple[int, str, float]]]:
    """By end: (start, kind, cost) of word and date spans."""
    n = len(value)
    ends: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    longest = max(LONGEST_WORD, _LONGEST_LISTED)
    for a in range(n):
        for b in range(a + 1, min(n, a + longest) + 1):
            if (c := _word(value[a:b], ranks)) is not None:
                ends[b].append((a, "word", c))
        if value[a].isdigit():
            for b in range(a + 4, min(n, a + 10) + 1):
                if (c := _date(value[a:b])) is not None:
                    ends[b].append((a, "date", c))
    return ends


def _bounded(value: str, longest: int, ranks: Mapping[str, int], ends: list[list[tuple[int, str, float]]]) -> None:
    """Adds walk and repeat spans of at most ``longest`` characters."""
    for s, e, turns in _walks(value):
        for a in range(s, e - 2):
            for b in range(a + 3, min(e, a + longest) + 1):
                ends[b].append((a, "walk", math.log10(47 * (b - a)) + (1 + turns[b - 2 - s] - turns[a - s]) * _TURN))
    for s, e, p in _runs(value):
        units = {}
        for a in range(s, e - 2 * p + 1):
            unit = value[a : a + p]
            for b in range(a + 2 * p, min(e, a + longest) + 1, p):
                if unit not in units:
                    units[unit] = guess_cost(unit, longest, ranks)[0]
                ends[b].append((a, "repeat", units[unit] + math.log10((b - a) // p)))


def guess_cost(value: str, longest: int | None = LIMIT, ranks: Mapping[str, int] = RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses of ``value`` and the spans (start, end, kind) that reach it; of equals the first found.

    ``longest`` bounds repeat and walk spans (None: no bound); ``ranks``: words and their ranks.
    """
    n = len(value)
    if not n:
        return 0.0, []
    ends = _fixed(value, ranks)
    active: list[list[tuple]] = [[] for _ in range(n + 1)]  # runs and walks by the ends that they offer
    if longest is not None:
        _bounded(value, longest, ranks, ends)
    else:
        for s, e, turns in _walks(value):
            own = (s, turns, _Starts())
            for j in range(s + 3, e + 1):
                active[j].append(own)
        for s, e, p in _runs(value):
            own = (s, p, {}, {})
            for j in range(s + 2 * p, e + 1):
                active[j].append(own)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    brute, since = [math.inf] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        join = JOIN if j > 1 else 0.0
        if brute[j - 1] <= best[j - 1] + join:
            brute[j], since[j] = brute[j - 1] + 1, since[j - 1]
        else:
            brute[j], since[j] = best[j - 1] + join + 1, j - 1
        best[j], back[j] = brute[j], (since[j], "brute")
        for i, kind, cost in ends[j]:
            c = best[i] + cost + (JOIN if i else 0.0)
            if c < best[j]:
                best[j], back[j] = c, (i, kind)
        for own in active[j]:
            if len(own) == 3:
                s, turns, starts = own
                i = j - 3
                starts.put(best[i] + (JOIN if i else 0.0) - _TURN * turns[i - s], i, j)
                c, i = starts.best(j)
                c, kind = c + math.log10(47) + _TURN * (1 + turns[j - 2 - s]), "walk"
            else:
                s, p, classes, units = own
                i, unit = j - 2 * p, value[j - p : j]
                if unit not in units:
                    units[unit] = guess_cost(unit, None, ranks)[0]
                starts = classes.setdefault((j - s) % p, _Starts())
                starts.put(best[i] + (JOIN if i else 0.0), i, j)
                c, i = starts.best(j)
                c, kind = c - math.log10(p) + units[unit], "repeat"
            if c < best[j]:
                best[j], back[j] = c, (i, kind)
    spans: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = back[j]
        spans.append((i, j, kind))
        j = i
    return best[n], spans[::-1]


_LONGEST_LISTED = max(map(len, RANK))


def _named(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start of the credential word, start of the value, word, value) at each operator that a credential name precedes; in time linear in the text."""
    at = 0
    while m := _OPERATOR.search(text, at):
        at = m.end()
        hi = m.start()
        while hi and text[hi - 1].isspace():
            hi -= 1
        if hi and text[hi - 1] in "\"'":
            hi -= 1
        lo = hi
        while lo and text[lo - 1] in _NAME:
            lo -= 1
        if text[max(0, lo - 8) : lo].lower().endswith(("api ", "access ", "private ", "auth ")):
            lo = max(0, lo - 8)
        word = _CREDENTIAL.search(text, lo, hi) if lo < hi else None
        if word and all(c in _NAME for c in text[word.end() : hi]) and (v := _VALUE.match(text, at)):
            value = v[v.lastindex].rstrip(_TAIL) if v.lastindex == 3 else v[v.lastindex]
            at = v.end()
            if value:
                yield word.start(), v.start(v.lastindex), word[0].lower(), value


def contexts(text: str) -> Iterator[tuple[int, str, str]]:
    """(start of the value, credential word, value) of each context; of two that overlap, the first."""
    bearers = ((m.start(), m.start(2), "bearer", v) for m in _BEARER.finditer(text) if (v := m[2].rstrip(_TAIL)))
    done = 0
    for start, at, word, value in sorted([*_named(text), *bearers]):
        if start >= done:
            done = at + len(value)
            yield at, word, value


_OUT = "doc_id long, start int, word string, length int, sha256 string, log10_guesses double, spans string, secret boolean"


def _scan(batches: Iterator[pa.RecordBatch], least: float, longest: int | None, ranks: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at, word, value in contexts(t):
                if value not in known:
                    if len(known) > 100_000:
                        known.clear()
                    cost, spans = guess_cost(value, longest, ranks)
                    known[value] = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(), round(cost, 6), " ".join(f"{k}:{b - a}" for a, b, k in spans), cost >= least
                rows.append((i, at, word, len(value), *known[value]))
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "word", "length", "sha256", "log10_guesses", "spans", "secret"])


_ENGLISH = re.compile(rf"(?<![^\W_])[a-z]{{3,{LONGEST_WORD}}}(?![^\W_])")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of texts without the values of their contexts."""
    count: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if _GATE.search(t):
                for at, _, value in reversed(list(contexts(t))):
                    t = t[:at] + t[at + len(value) :]
            count.update(_ENGLISH.findall(t.lower()))
            if len(count) > 500_000:
                yield out()
                count.clear()
    yield out()


_GATE = re.compile(GATE, re.IGNORECASE)


def corpus_ranks(docs: DataFrame, words: int = 20_000, min_count: int = 5) -> dict[str, int]:
    """Ranks of the listed words, then of the ``words`` most frequent other ones of the texts that occur ``min_count`` times outside values: a bounded table."""
    text = docs["text"].cast("string")
    counts = docs.select(text.alias("t")).where(F.length("t") > 0).mapInArrow(lambda it: trimmed(_counted(it)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where((F.col("n") >= min_count) & ~F.col("word").isin(*RANK)), "counts")
    # The count that the last of the words has, from how many words have each count: tasks then send the driver little more than the words asked for.
    least, left = min_count, words
    for n, k in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        least, left = n, left - k
        if left <= 0:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    discard(counts)
    return RANK | {r.word: len(RANK) + i for i, r in enumerate(top, 1)}


def scan_secrets(docs: DataFrame, least: float = 10.0, longest: int | None = LIMIT, words: int = 20_000) -> DataFrame:
    """(doc_id, start, word, length, sha256, log10_guesses, spans, secret): one row a value in a credential context.

    ``secret``: the value takes 10**least guesses at least. The value itself is not in the result, only its place (a character
    offset), length and digest; ``spans`` are the kinds and lengths of the cheapest cut, of equal ones the first found. ``longest`` bounds repeat and walk spans
    (None: no bound), ``words`` the corpus's own words that count as words. Null and empty texts, and empty
    values, give no rows. Repeated rows are reported each by itself; other columns are not read. Texts and values are
    read whole. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, words))  # at most ``words`` and the listed ones
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return some.where(F.lower("text").rlike(GATE)).mapInArrow(lambda it: _scan(it, least, longest, shared.value), _OUT)
