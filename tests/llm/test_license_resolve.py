"""Overlaps resolved as by comparing each detection with all kept ones, and in little time."""

import random
import time

from papyra.llm import license_scan


def compared(found):
    kept = []
    for a, b, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number)):
        if not any((c <= a and b <= d) or (a < d and c < b and other.priority > rule.priority) for c, d, other in kept):
            kept.append((a, b, rule))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


def test_resolve():
    rules = license_scan.scanner().rules[:40]
    rng = random.Random(22)
    for _ in range(3000):
        found = [(a, a + rng.randint(1, 10), rng.choice(rules)) for a in (rng.randrange(30) for _ in range(rng.randint(0, 14)))]
        assert license_scan.resolve(found) == compared(found)


def test_many_detections():
    begun = time.time()
    text = "Copyright (c) 2001 Some Body\n" * 20_000
    assert len(license_scan.scanner().scan(text)) == 20_000 and time.time() - begun < 20
