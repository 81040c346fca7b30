"""License scan: ordered signature rules, gated by a keyword automaton, overlaps resolved by priority and containment.

An automaton finds all keywords of all rules in one pass over the lower-cased text; only the rules whose keywords are all
there (of keywords joined by a slash, one) run their pattern, over the whole text. Detections are then taken by priority, then length, then place, then rule order; one that
lies within a detection taken before, or overlaps one of higher priority, is suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import merge
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.license_rules import RULES

_GAP = r"(?:\s[\s*#;/]*)"


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


def parse_rules(text: str = RULES) -> list[Rule]:
    """The rules of a table in the form of ``license_rules``."""
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, priority, keywords, pattern = line.split("|", 3)
        # A space that a quantifier follows is one optional gap; spaces in character classes stay.
        parts = re.split(r"(\[(?:\\.|[^\]\\])*\])", pattern)
        source = "".join(p if i % 2 else p.replace(" ", _GAP) for i, p in enumerate(parts))
        rules.append(Rule(len(rules), name, int(priority), tuple(keywords.lower().split(",")), re.compile(source, re.IGNORECASE | re.ASCII | re.DOTALL)))
    return rules


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Of detections (start, end, rule) those that stay, by place: none that overlaps one of higher priority or lies in one of its own.

    Kept ones of one priority do not contain each other, so only the last that starts no later can contain a detection; those of higher
    priorities are joined to intervals that do not touch. Both are looked up by bisection.
    """
    kept: list[tuple[int, int, Rule]] = []
    high: list[tuple[int, int]] = []
    for _, group in groupby(sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number)), key=lambda x: x[2].priority):
        own: list[tuple[int, int]] = []
        for a, b, rule in group:
            i = bisect_left(high, (b,))
            if i and high[i - 1][1] > a:
                continue
            i = bisect_right(own, (a, math.inf))
            if i and own[i - 1][1] >= b:
                continue
            own.insert(i, (a, b))
            kept.append((a, b, rule))
        joined: list[tuple[int, int]] = []
        for a, b in merge(high, own):
            if joined and a <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(b, joined[-1][1])
            else:
                joined.append((a, b))
        high = joined
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        words = sorted({a for r in rules for k in r.keywords for a in k.split("/")})
        number = {w: i for i, w in enumerate(words)}
        for w, i in number.items():
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.needs = [(r, [frozenset(number[a] for a in k.split("/")) for k in r.keywords]) for r in rules]
        self.tried = lru_cache(maxsize=4096)(lambda seen: tuple(r for r, need in self.needs if all(k & seen for k in need)))

    def candidates(self, text: str) -> tuple[Rule, ...]:
        """The rules that the keywords of ``text`` let run."""
        seen = frozenset(i for _, i in self.automaton.iter(text.lower()))
        return self.tried(seen) if seen else ()

    def scan(self, text: str) -> list[tuple[int, int, Rule]]:
        found = [(m.start(), m.end(), r) for r in self.candidates(text) for m in r.pattern.finditer(text) if m.end() > m.start()]
        return resolve(found) if found else found


@lru_cache(maxsize=2)
def scanner(rules: str = RULES) -> Scanner:
    return Scanner(parse_rules(rules))


def scan_licenses(docs: DataFrame, rules: str = RULES) -> DataFrame:
    """(doc_id, start, length, license, rule, priority): one row a detection that stays; start and length in characters.

    Null and empty texts give no rows. Repeated rows are scanned each by itself. Equal detections of two rules of one priority: the first
    rule. Other columns are not read; texts are scanned whole. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b, r in own.scan(t) if t else ():
                    rows.append((i, a, b - a, r.license, r.number, r.priority))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "license", "rule", "priority"])

    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("length(text) > 0")
    return some.mapInArrow(run, "doc_id long, start int, length int, license string, rule int, priority int")
