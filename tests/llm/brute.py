"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    often = Counter(windows)
    marked = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(3)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    found = WORD.findall(lower(text or ""))
    if not found:
        return set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} or {tuple(found)}


def near_components(docs: dict[int, str | None], size: int) -> dict[int, int]:
    """The smallest id each document is linked with, over all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in having[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in docs}


def covered(texts: list, length: int) -> list[list[bool]]:
    """Of sequences (bytes or lists of words): which units lie in a window that occurs more than once."""
    often = Counter(tuple(t[s : s + length]) if isinstance(t, list) else t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = [False] * len(t)
        for s in range(len(t) - length + 1):
            w = tuple(t[s : s + length]) if isinstance(t, list) else t[s : s + length]
            if often[w] > 1:
                flags[s : s + length] = [True] * length
        out.append(flags)
    return out


def runs(flags: list[bool]) -> int:
    return sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
