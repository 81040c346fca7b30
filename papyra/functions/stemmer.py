"""The published Snowball algorithm for Portuguese on ASCII words: the analyzer transliterates first, so suffixes with accents match nothing and are not here."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = set("aeiou")
_STANDARD = sorted(
    "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes".split(),
    key=len,
    reverse=True,
)
_VERBS = sorted(
    """ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem
    irem assem essem issem ado ido ando endo indo ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses
    esses isses astes estes istes is ais eis areis ereis ireis ados idos amos emos imos armos ermos irmos aremos eremos iremos eu iu ou ira iras""".split(),
    key=len,
    reverse=True,
)


def _after(word: str, start: int) -> int:
    """Place behind the first consonant that follows a vowel from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _standard(w: str, r1: int, r2: int, rv: int) -> str:
    def ends(suffix: str, region: int) -> bool:
        return w.endswith(suffix) and len(w) - len(suffix) >= region

    def drop(word: str, suffixes: tuple[str, ...], region: int) -> str:
        for s in suffixes:
            if word.endswith(s):
                return word[: -len(s)] if len(word) - len(s) >= region else word
        return word

    for s, new in (("logias", "log"), ("logia", "log")):
        if w.endswith(s):
            return w[: -len(s)] + new if ends(s, r2) else w
    if w.endswith("amente"):
        if not ends("amente", r1):
            return w
        x = w[:-6]
        if x.endswith("iv") and len(x) - 2 >= r2:
            return drop(x[:-2], ("at",), r2)
        return drop(x, ("os", "ic", "ad"), r2)
    if w.endswith("mente"):
        return drop(w[:-5], ("ante", "avel"), r2) if ends("mente", r2) else w
    for s in ("idades", "idade"):
        if w.endswith(s):
            return drop(w[: -len(s)], ("abil", "ic", "iv"), r2) if ends(s, r2) else w
    for s in ("ivas", "ivos", "iva", "ivo"):
        if w.endswith(s):
            return drop(w[: -len(s)], ("at",), r2) if ends(s, r2) else w
    for s in _STANDARD:
        if w.endswith(s):
            return w[: -len(s)] if ends(s, r2) else w
    for s in ("iras", "ira"):
        if w.endswith(s):
            return w[: -len(s)] + "ir" if ends(s, rv) and w[: -len(s)].endswith("e") else w
    return w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Stem of one lower-case ASCII word."""
    r1 = _after(word, 0)
    r2, rv = _after(word, r1), _rv(word)
    w = _standard(word, r1, r2, rv)
    if w == word:
        w = next((word[: -len(s)] for s in _VERBS if word.endswith(s) and len(word) - len(s) >= rv), word)
    if w != word:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        w = next((w[: -len(s)] for s in ("os", "a", "i", "o") if w.endswith(s) and len(w) - len(s) >= rv), w)
    if w.endswith("e") and len(w) - 1 >= rv:
        w = w[:-1]
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w
