"""Manifest, decontamination and spelling variants against plain versions, odd rows included."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import lower, sha
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, merkle, variants

CLASH = {"tree": 1, "index": "x", "row": 0, "n": 2, "words": "w", "k1": 1.5, "pos": "p", "total": 7, "leaf": "l", "root": "r", "item": 3, "word": "v", "parent": 9, "item_id": 4}


def with_clashes(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items() if c not in df.columns})


# manifest

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode())


def plain_tree(nodes):
    """Root, and for every leaf what stands left and right of it on each level."""
    sides = [[] for _ in nodes]
    level = [(d, [k]) for k, d in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            for k, (_, members) in enumerate(run):
                step = ("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :]))
                for m in members:
                    sides[m].append(step)
            above.append((sha("".join(d for d, _ in run).encode()), [m for _, members in run for m in members]))
        level = above
    return level[0][0], sides


def plain_manifest(rows):
    by_source = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in by_source[s]]) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, sides in zip(by_source[s], trees[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            path = sides + above
            digest = plain_leaf((*r[:4], None if r[4] is None else lower(r[4]))) if tampered else plain_leaf(r)
            for left, right in path:
                digest = sha((left + digest + right).encode())
            out.append((r[0], plain_leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path).encode()), digest, digest == root))
    return out


def manifest_of(spark, rows):
    return [tuple(r) for r in merkle.manifest(with_clashes(spark.createDataFrame(rows, DOCS))).collect()]


def key(rows):
    return sorted(rows, key=repr)


def many_rows():
    rng = random.Random(3)
    rows = [(k, "hot", "en", k, f"Text {rng.randrange(50)} É") for k in range(300)]
    rows += [(1000 + k, f"s{k}", None, None, "One") for k in range(20)]
    rows += [(2000 + k, "sixteen", "de", 1, "X") for k in range(16)] + [(3000 + k, "more", "de", 1, "Y" * 70_000) for k in range(17)]
    rows += [(4000, "z", "de", 1, None), (4001, None, "de", 1, ""), (None, "z", None, None, None), (None, None, None, None, "A")]
    return rows + [(5000, "z", "en", 3, "Same")] * 20 + [(5000, "z", "en", 3, "Other"), (2**62, "é", "en", 3, "ß"), (-7, "E", "en", 3, "Q")]


def test_manifest_equals_plain(spark):
    rows = many_rows()
    assert key(manifest_of(spark, rows)) == key(plain_manifest(rows))


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, "T")], [(20, None, "x", 1, "T")], [(k, "a", "x", 1, "T") for k in range(2)], [(5, "a", "x", 1, "T"), (5, "b", "x", 1, "T")]])
def test_small_manifests(spark, rows):
    assert key(manifest_of(spark, rows)) == key(plain_manifest(rows))


# decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def plain_leaks(docs, items):
    windows = {}
    for item, text in items:
        own = plain_words(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own = plain_words(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[w]
        named = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(own), len(hit), len(named), sha(",".join(named).encode()), bool(hit)))
    return out


def leaks_of(spark, docs, items):
    table = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    benchmark = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))
    found = decontaminate.decontaminate(table, benchmark)
    return [tuple(r) for r in found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]


def mixed_texts(vocabulary, seed):
    """Items and documents that share passages of 7 to 14 words, some with one word changed."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(vocabulary)}"
    items = [(k, [word() for _ in range(rng.randint(10, 40))]) for k in range(30)]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(items)[1]
            start = rng.randrange(len(source))
            part = source[start : start + rng.randint(7, 14)]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "zz"
            place = rng.randrange(len(own) + 1)
            own[place:place] = part
        docs.append((k, rng.choice([" ", ", ", "-"]).join(own).lower() if k % 2 else " ".join(own)))
    return docs, [(k, " ".join(w)) for k, w in items]


@pytest.mark.parametrize("vocabulary", [2, 40, 5000])
def test_leaks_equal_plain(spark, vocabulary):
    docs, items = mixed_texts(vocabulary, vocabulary)
    assert key(leaks_of(spark, docs, items)) == key(plain_leaks(docs, items))


def test_odd_leaks(spark):
    items = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (None, "only here"), (3, None), (4, "…"), (5, ""), (6, "É x"), (7, "!?")]
    long = " ".join(f"v{k}" for k in range(120_000))
    items.append((8, " ".join(f"v{k}" for k in range(70_000, 70_030))))
    docs = [(None, "A-B c D e f g h i j K"), (9, "only here"), (9, "only here"), (10, None), (11, ""), (12, "é X"), (13, "É x"), (14, long), (15, "a b c d e f g h i"), (16, "…")]
    assert key(leaks_of(spark, docs, items)) == key(plain_leaks(docs, items))


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(None, None)])])
def test_empty_leaks(spark, docs, items):
    assert key(leaks_of(spark, docs, items)) == key(plain_leaks(docs, items))


def test_leaks_by_shuffle(spark, monkeypatch):
    """Nothing is broadcast if the bytes do not allow it; same rows."""
    docs, items = mixed_texts(40, 1)
    items += [(90, "w1 w2")]
    monkeypatch.setattr(decontaminate, "small_bytes", lambda df, size: df)
    monkeypatch.setattr(decontaminate, "small_side", lambda df, rows: df)
    assert key(leaks_of(spark, docs, items)) == key(plain_leaks(docs, items))


def test_fingerprints_are_few_and_shared(spark):
    """Random texts keep about two of seven grams, and every window of ten words one at least."""
    rng = random.Random(5)
    words = [str(rng.random()) for _ in range(4000)]
    rows = spark.createDataFrame([(1, words)], "id int, words array<string>")
    places = sorted(r.pos for r in decontaminate.fingerprints(rows, "id").collect())
    assert 0.25 < len(places) / len(words) < 0.32
    assert places[0] <= 5 and places[-1] >= len(words) - 10
    assert max(np.diff(places)) <= 6


def test_decontamination_uses_no_python(spark):
    docs, items = mixed_texts(40, 2)
    plan = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert "Python" not in (text := plan._jdf.queryExecution().toString()) and "Arrow" not in text


# spelling variants


def plain_words_of(docs):
    counted = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    words = plain_words_of(docs)
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def variants_of(spark, docs):
    return [tuple(r) for r in variants.spelling_variants(with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()]


def misspelt(seed, bases=40):
    rng = random.Random(seed)
    letters = "abcdefgéÀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(bases)]
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    texts = []
    for k in range(200):
        texts.append((k, rng.choice([" ", "1", "\n"]).join(rng.choice(words[: rng.choice([10, len(words)])]).title() if rng.random() < 0.2 else rng.choice(words[: rng.choice([3, 10, len(words)])]) for _ in range(60))))
    return texts


def test_variants_equal_plain(spark):
    docs = misspelt(1)
    docs += [(500 + k, "w" * 3000 + " " + "w" * 2999 + "x " + "w" * 2999) for k in range(5)]
    got = variants_of(spark, docs)
    assert key(got) == key(plain_variants(docs))
    assert any(r[1] and r[2] != r[1] for r in got) or sum(r[1] is not None for r in got) > 10


def test_variants_in_small_blocks(spark, monkeypatch):
    """The same words, whatever the blocks; many words of one cell are cut into several."""
    docs = misspelt(2)
    docs += [(900, " ".join(["abcdef abcdfe abcefd abdcef bacdef fedcba"] * 6))]
    want = key(plain_variants(docs))
    for words, entries in ((1, 1), (3, 50), (1024, 1 << 21)):
        monkeypatch.setattr(variants, "BLOCK_WORDS", words)
        monkeypatch.setattr(variants, "ENTRIES", entries)
        assert key(variants_of(spark, docs)) == want


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "")], [(None, "abcdefg abcdefg abcdefh"), (None, "abcdefg " * 30 + "abcdefh " * 5), (3, "abcdefg")], [(4, "Planetx planet planet planet planet planet " * 6)] * 3])
def test_odd_variants(spark, docs):
    assert key(variants_of(spark, docs)) == key(plain_variants(docs))


def test_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(100)], "word string, form string")
    got = {r.word: r.root for r in variants.roots(forms, 100).collect()}
    assert got == {f"w{k:03}": "w100" for k in range(100)}


@pytest.mark.parametrize("length", [6, 11])
def test_near_words(length):
    rng = random.Random(length)
    a = list({"".join(rng.choice("abc") for _ in range(length)) for _ in range(150)})
    for b in (None, list({"".join(rng.choice("abc") for _ in range(length)) for _ in range(90)}), list({"".join(rng.choice("abc") for _ in range(length + 1)) for _ in range(150)})):
        got = set(zip(*(x.tolist() for x in variants.near_words(a, b)), strict=True))
        other = a if b is None else b
        assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(other) if (b is not None or i < j) and one_edit(x, y)}
