"""Quality rules, line dedup, near-dedup, mixing and encoding."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from brute import base_counts, near_components, sha, shingles
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketlens.llm import bpe, line_dedup, mixing, near_dedup, outliers, storage
from basketlens.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, LONG, None, "a", len(LONG)),
    (4, LONG, None, "a", len(LONG)),
    (None, "One Two three", "en", "a", 13),
    (None, "one two Three", "en", "b", 13),
    (5, "one two three", "de", "b", 13),
    (6, "solo", "de", "b", 4),
    (7, "SOLO", "de", "b", 4),
    (8, "ÉTÉ ÉTÉ été \U0001f600 á 'S don't <|endoftext|>x<|startoftext|> İ Σας\x1c\x85\xa0y", "fr", "b", 40),
    (8, "another text under the same id", "fr", "b", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"n_words": F.lit("clash"), "key": F.lit(1), "row": F.lit(2.0), "id": F.lit("x"), "kept": F.lit(None).cast("string"), "class": F.lit(0), "copy": F.lit("c")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# quality rules


def test_counts_equal_plain_ones(spark, sf_dir, texts):
    for r in QUERIES["op1_quality_outliers"](spark, sf_dir).collect():
        n, chars, symbols, lines, repeats = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_counts_of_odd_texts(odd):
    for r in outliers.quality_counts(odd).select("row.text", *outliers.COUNTS).collect():
        assert tuple(r[n] for n in outliers.COUNTS[:5]) == base_counts(r.text)


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op1_quality_outliers"](spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


def test_estimate_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 300, (400, 4)).round(), rng.normal(9000, 300, (200, 4)).round()
    rows = [("en", "s", False, *map(float, z)) for z in [*good, *bad]]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, z0 double, z1 double, z2 double, z3 double")
    df = df.select(outliers._levels().alias("levels"), "base_failed", "z0", "z1", "z2", "z3")
    center = {r.level: r.center for r in outliers.fit(df).collect()}
    assert len(center) == 3
    for c in center.values():
        assert np.abs(np.array(c)).max() < 100


def plain_estimate(points):
    """Minimum covariance determinant over documents, from two starts."""
    floors = (np.array(outliers.FLOORS) * outliers.UNIT) ** 2
    raised = lambda cov: cov + np.diag(np.maximum(floors - np.diag(cov), 0))
    half = math.ceil(outliers.COVER * len(points))
    middle = np.median(points, axis=0)
    wide = np.cov(points.T, bias=True)
    starts = [(middle, raised(np.diag((1.4826 * np.median(np.abs(points - middle), axis=0)) ** 2))), (points.mean(0), raised(wide))]
    best = None
    share = half / len(points)
    factor = share / outliers.chi2_share(outliers.chi2_quantile(share, 4), 6)
    for center, cov in starts:
        chosen = None
        for _ in range(100):
            away = points - center
            near = np.sort(np.argsort(np.einsum("ki,ij,kj->k", away, np.linalg.inv(cov), away), kind="stable")[:half])
            if chosen is not None and np.array_equal(near, chosen):
                break
            chosen = near
            center, cov = points[near].mean(0), raised(np.cov(points[near].T, bias=True) * factor)
        if best is None or np.linalg.slogdet(cov)[1] < np.linalg.slogdet(best[1])[1]:
            best = center, cov
    return best


def plain_vector(text):
    n, chars, symbols, dup, repeats = base_counts(text)
    lines = max(1, sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n")))
    raw = [math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(chars, 1)), math.asin(math.sqrt(min(1, repeats / max(n, 1)))), math.sqrt(dup / lines)]
    return np.array([round(x * outliers.UNIT) for x in raw], float)


def test_verdicts_equal_an_estimate_over_documents(spark, sf_dir, docs, texts):
    """The operator's estimates run on cells of a grid; these on the documents themselves."""
    rows = {r.doc_id: r for r in QUERIES["op1_quality_outliers"](spark, sf_dir).collect()}
    meta = {r.doc_id: (r.lang, r.source) for r in docs.select("doc_id", "lang", "source").collect()}
    fine = {i: plain_vector(texts[i]) for i, r in rows.items() if not r.base_failed}
    levels = {}
    for i, z in fine.items():
        for level in (meta[i], meta[i][:1], ()):
            levels.setdefault(level, []).append(z)
    estimates = {level: plain_estimate(np.array(zs)) for level, zs in levels.items() if len(zs) >= outliers.MIN_ROWS}
    cutoff = outliers.chi2_quantile(1 - outliers.TAIL, 4)
    for i, z in fine.items():
        center, cov = next(estimates[level] for level in (meta[i], meta[i][:1], ()) if level in estimates)
        assert rows[i].kept == ((z - center) @ np.linalg.inv(cov) @ (z - center) <= cutoff)
    assert 0 < sum(not rows[i].kept for i in fine) < len(fine) / 4


def test_each_statistic_can_reject(spark):
    """In a spotless group one bad statistic is enough, within the base rule."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    fresh = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(fresh(200))) for i in range(120)]
    rows.append((900, " ".join(fresh(110) + fresh(3) * 30)))  # 45 % in repeated windows
    rows.append((901, "\n".join([" ".join(fresh(120)), *[" ".join(fresh(1))] * 9])))  # eight of ten lines repeated
    rows.append((902, " ".join(w + "##" for w in fresh(200))))
    rows.append((903, " ".join("".join(fresh(4)) for _ in range(200))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in outliers.quality_filter(docs).collect()} == set(range(120))


def test_columns_follow_the_contract(spark, sf_dir):
    columns = QUERIES["op1_quality_outliers"](spark, sf_dir).columns
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_chi_square():
    x = outliers.chi2_quantile(0.95, 4)
    assert math.isclose(x, 9.487729, rel_tol=1e-6)
    assert math.isclose(outliers.chi2_share(x, 4), 0.95)


def test_small_tables_lose_nothing_by_distance(odd, none):
    assert outliers.quality_filter(odd).columns == odd.columns
    assert [r.doc_id for r in outliers.quality_filter(odd).collect()] == [4, 4]
    assert outliers.quality_filter(none).count() == 0


# line dedup


def plain_chunks(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    _, start, end, lines = line_dedup.cut(raw, np.array([0, len(raw)]))
    return [(a, raw[a:b].tobytes(), n) for a, b, n in zip(start.tolist(), end.tolist(), lines.tolist(), strict=True)]


def plain_line_dedup(rows):
    """Texts by (id, text), with every repeated chunk but the first gone."""
    distinct, seen, out = sorted(set(rows)), set(), {}
    for i, text in distinct:
        kept = b""
        for _, chunk, lines in plain_chunks(text):
            bare = chunk.removesuffix(b"\n")
            if lines >= 2 and bare in seen:
                continue
            if lines >= 2:
                seen.add(bare)
            kept += chunk
        out[i, text] = kept.decode()
    return out


def test_chunks_make_up_the_text(texts):
    for text in texts.values():
        parts = plain_chunks(text)
        assert b"".join(c for _, c, _ in parts).decode() == text
        assert all(c.endswith(b"\n") for _, c, _ in parts[:-1])


def test_line_dedup_equals_plain_one(docs, texts):
    expected = plain_line_dedup(list(texts.items()))
    found = line_dedup.removed_lines(docs).select("row.doc_id", "text", "n_bytes").collect()
    assert {r.doc_id: r.text for r in found} == {i: t for (i, _), t in expected.items()}
    assert any(r.n_bytes for r in found)
    for r in found:
        assert r.n_bytes == len(texts[r.doc_id].encode()) - len(r.text.encode())


def test_shifted_passage_is_found(spark):
    passage = "".join(f"line number {k} of the passage\n" for k in range(60))
    rows = [(1, "first\n" + passage + "end one"), (2, "something else\nand more\n" + passage + "end two")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1]
    assert len(got[2]) < 0.4 * len(rows[1][1]) and got[2].startswith("something else\n") and got[2].endswith("end two")


def plain_passage_dedup(rows):
    """Texts by (id, text), without the lines of windows of two that stand further up or in an earlier text."""
    seen, out = set(), {}
    for i, text in sorted(set(rows)):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone, before = set(), None
        for a, b in zip(full, full[1:], strict=False):
            window = "".join(lines[a : b + 1]).removesuffix("\n")
            if window in seen:
                gone.update(range(a + (window == before), b + 1))
            seen.add(window)
            before = window
        out[i, text] = "" if gone.issuperset(full) and full else "".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_short_passages_go(spark):
    """Passages of 2 to 6 lines inside other texts, at every shift; nothing of them is left."""
    rng = np.random.default_rng(11)
    fresh = iter(f"line {k} {rng.integers(1 << 40)}\n" for k in range(10_000))
    take = lambda n: "".join(next(fresh) for _ in range(n))
    rows, expected = [], {}
    for i in range(40):
        passage, one, two = take(2 + i % 5), [take(1 + i % 3), take(2)], [take(2 + i % 4), take(1)]
        rows += [(i, one[0] + passage + one[1]), (1000 + i, two[0] + passage + two[1])]
        expected |= {i: rows[-2][1], 1000 + i: two[0] + two[1]}
    found = line_dedup.removed_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "text", "n_chunks").collect()
    assert {r.doc_id: r.text for r in found} == expected
    assert [r.n_chunks for r in sorted(found, key=lambda r: r.doc_id)] == [0] * 40 + [1] * 40


def test_passages_equal_plain_ones(spark, sf_dir, texts):
    odd = ["a\nb\n", "a\n\nb\n", "x\na\nb", "a\na\na\na\n", "y\na\na\na\n", "\n\x0c\nx\na\nb\n\n", "one", "one", "", "a\nb\na\nb\na\nz"]
    rows = {**texts, **{10**6 + k: t for k, t in enumerate(odd)}}
    found = line_dedup.removed_passages(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).select("row.doc_id", "text").collect()
    expected = plain_passage_dedup(list(rows.items()))
    assert {r.doc_id: r.text for r in found} == {i: t for (i, _), t in expected.items()}
    for r in QUERIES["op9_line_chunk_dedup"](spark, sf_dir).collect():
        assert r.kept_sha256 == sha(expected[r.doc_id, texts[r.doc_id]].encode())


def test_chunks_have_two_lines():
    rng = np.random.default_rng(2)
    for n in range(2, 40):
        text = "".join(f"line {rng.integers(4 if n % 2 else 1 << 40)}\n" + "\n" * int(rng.integers(2)) for _ in range(n))
        assert all(lines >= 2 for _, _, lines in plain_chunks(text))


def test_copies_leave_nothing_behind(spark, sf_dir):
    rng = np.random.default_rng(4)
    texts = ["".join(f"line {rng.integers(1 << 40)} of {i}\n" for _ in range(10 + i % 11)) for i in range(30)]
    rows = [(100 * c + i, t, "en", "a", len(t)) for c in range(3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.line_deduplication(spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == list(enumerate(texts))
    near = corpus_pipeline.near_deduplication(spark, left, sf_dir)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == list(enumerate(texts))


def test_line_dedup_odd_rows(odd, none):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == odd.columns
    assert found.count() == len(ODD)
    assert line_dedup.dedup_lines(none).count() == 0


# near duplicates


def test_near_duplicates_equal_all_pairs(spark, sf_dir, texts):
    expected = near_components(texts, 2)
    for r in QUERIES["op4_odd_sketch_near_dedup"](spark, sf_dir).collect():
        assert r.n_shingles == len(shingles(texts[r.doc_id], 2))
        assert r.component_id == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_chains_and_borderline_groups(spark):
    """Edits of one text, each a little further: links hold between neighbours only."""
    rng = np.random.default_rng(1)
    base = [f"word{k}" for k in range(120)]
    rows = {}
    for i in range(150):
        if i % 3 == 0:
            base = [w if rng.random() > 0.02 else f"new{i}x{k}" for k, w in enumerate(base)]
        rows[i] = " ".join(w if rng.random() > 0.03 else f"own{i}x{k}" for k, w in enumerate(base))
    expected = near_components(rows, 2)
    found = near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 1 < len(set(expected.values())) < 150


def _smallest_reachable(edges):
    smallest = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(smallest[a], smallest[b])
            changed |= smallest[a] != least or smallest[b] != least
            smallest[a] = smallest[b] = least
    return smallest


def test_components(spark):
    """Sparse random links, a path against the order of its ids, two stars around their largest and smallest id, a loop, a repeated link, and none."""
    rng = np.random.default_rng(6)
    edges = [tuple(int(x) for x in rng.integers(0, 300, 2)) for _ in range(170)]
    path = [int(x) for x in rng.permutation(np.arange(1000, 1060))]
    edges += list(zip(path, path[1:])) + [(2050, 2000 + k) for k in range(50)] + [(3000, 3001 + k) for k in range(50)] + [(-5, -5), (3000, 3001)]
    smallest = _smallest_reachable(edges)
    found = storage.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len({r.id for r in found}) == len(found)
    assert {r.id: r.component for r in found} == {n: least for n, least in smallest.items() if n != least}
    assert storage.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_trees_take_few_jobs(spark):
    """Links to one smaller node each need no rounds beyond the first."""
    edges = spark.createDataFrame([(10 * k + j, 10 * k + j // 2) for k in range(30) for j in range(1, 10)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("trees", "trees")
    found = storage.components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 26
    assert sorted(map(tuple, found.collect())) == sorted((10 * k + j, 10 * k) for k in range(30) for j in range(1, 10))


def test_sketch_estimates(spark):
    """Linked sets of any size pass the limit; sets well below the threshold do not."""
    rng = np.random.default_rng(3)
    sizes = [10, 60, 150, 600, 2000, 9000, 40_000]
    frame = spark.createDataFrame([(k,) for k in sizes], "n long")
    limits = {r.n: r.top for r in frame.select("n", near_dedup.sketch_limit(F.col("n"), F.col("n")).alias("top")).collect()}
    for size in sizes:
        for similarity in (0.65, 0.8):
            inside = math.ceil(2 * size * similarity / (1 + similarity))
            for _ in range(40 if size < 5000 else 5):
                pool = rng.integers(1, 2**64, 2 * size - inside, np.uint64)
                sketch = near_dedup.odd_sketch(np.concatenate((pool[:size], pool[size - inside :])), np.array([size, size]))
                differing = np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum()
                if similarity == 0.8:
                    assert differing <= limits[size]
                elif 60 <= size <= 9000:
                    assert differing > limits[size]


def test_near_duplicates_odd_rows(odd, none):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r.doc_id: r for r in found if r.doc_id not in (None, 8)}
    assert (by_id[1].n_shingles, by_id[1].component_id, by_id[1].kept) == (0, 1, True)
    assert [r.component_id for r in found if r.doc_id is None] == [5, 5]
    assert by_id[5].kept and not any(r.kept for r in found if r.doc_id is None)
    assert by_id[7].component_id == 6
    assert all(r.component_id == 8 for r in found if r.doc_id == 8)
    kept = near_dedup.dedup_near(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 5, 6, 8, 8]
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.dedup_near(none).count() == 0


def test_one_document_of_each_group_stays(spark):
    """Groups without ids, with repeated rows without ids, and near duplicates under one id."""
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "else"]), " ".join(f"v{k}" for k in range(60))
    rows = [(None, text, "a"), (None, text, "b"), (None, near, "a"), (7, other, "a"), (7, other + " end", "b"), (8, other, "c"), (None, "", "a"), (None, "", "a"), (None, None, "a")]
    found = near_dedup.dedup_near(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), size=5).collect()
    assert len([r for r in found if r.text in (text, near)]) == 1
    assert [r.doc_id for r in found if (r.text or "").startswith(other)] == [7]
    assert len(found) == 5


# mixing


def test_weights_are_met(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else "small") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.source: r["count"] for r in mixing.mix_sources(df, {"big": 1, "small": 3}).groupBy("source").count().collect()}
    assert abs(got["big"] - 5000) < 6 * 5000**0.5
    assert abs(got["small"] - 15000) < 6 * (15000 * 1) ** 0.5
    assert mixing.mix_sources(df, {"big": 1, "small": 3}).rdd.getNumPartitions() == 8


def test_large_means_are_sums(spark):
    rows = [(i, "y" * (1000 if i else 1), "one" if i == 0 else "rest") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = mixing.mix_sources(df, {"one": 1, "rest": 1}).where("doc_id = 0").count()
    assert abs(n - 99_500) < 6 * 99_500**0.5


def test_mixing_is_in_order_and_repeatable(docs):
    one = mixing.shuffled(mixing.replicate(docs, mixing.rates(docs))).select("row.doc_id", "copy", "order").collect()
    two = mixing.shuffled(mixing.replicate(docs.repartition(5), mixing.rates(docs))).select("row.doc_id", "copy", "order").collect()
    assert one == two
    assert [r.order for r in one] == sorted(r.order for r in one)


def test_mixing_odd_rows(odd, none):
    found = mixing.mix_sources(odd)
    assert found.columns == odd.columns
    assert {r.source for r in found.select("source").distinct().collect()} <= {"a", "b", None}
    assert mixing.mix_sources(none).count() == 0


# encoding


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_encoding_equals_the_library(spark, sf_dir, texts, library):
    for r in QUERIES["op5_distinct_word_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(decoded.encode()))


def test_encoding_odd_rows(odd, none, library):
    found = bpe.tokenize(odd, tokenizer_path())
    assert found.columns == [c for c in odd.columns if c != "text"] + ["ids", "decoded"]
    rows = bpe.tokenize(odd, tokenizer_path(), ["doc_id", "text"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.tokenize(none, tokenizer_path()).count() == 0


def test_every_character_is_split_as_the_library_does(library):
    for low in range(1, 0x600, 32):
        for before in ("a", "'", "1", " "):
            text = "".join(f"{before}{chr(c)}s " for c in range(low, low + 32) if not 0xD800 <= c < 0xE000)
            ids = [i for w in bpe.encode_words(bpe.split_words(text, tokenizer_path()), tokenizer_path()) for i in w]
            assert ids == library.encode(text, add_special_tokens=False).ids


# pipeline


def test_pipeline_equals_plain_version(spark, sf_dir, docs, texts, library):
    verdicts = {r.doc_id: r.kept for r in QUERIES["op1_quality_outliers"](spark, sf_dir).collect()}
    lines = plain_passage_dedup([(i, t) for i, t in texts.items() if verdicts[i]])
    left = {i: t for (i, before), t in lines.items() if t == before or t.strip(" \t\r\n")}
    groups = near_components(left, 5)
    left = {i: t for i, t in left.items() if groups[i] == i}
    kept = docs.where(F.col("doc_id").isin(list(left))).drop("text").join(spark.createDataFrame(list(left.items()), "doc_id bigint, text string"), "doc_id")
    mixed = [r.doc_id for r in mixing.mix_sources(kept).select("doc_id").collect()]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(mixed)
    for r in found:
        assert r.ids == library.encode(left[r.doc_id], add_special_tokens=False).ids


def test_stages_take_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    """Every stage on all its predecessor kept, with nulls, repeated rows and clashing columns, or on nothing."""
    for table in (odd, none, odd.drop("n_chars")):
        left = table
        for name, function in corpus_pipeline.STAGES[1:]:
            # The quality rules leave none of these short texts.
            left = function(spark, left, str(tmp_path))
        assert {"ids", "decoded"} <= set(left.columns)
        ids = {r.doc_id for r in left.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in table.select("doc_id").collect()}
        assert table is none or len(ids) > 3
    assert outliers.quality_filter(none).count() == 0


def test_stages_keep_the_columns(spark, sf_dir, docs):
    assert len(corpus_pipeline.STAGES) == 5
    part = docs.limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, part, sf_dir).dtypes == docs.dtypes


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Files of ids are small however many rows they hold, and more come out of ``explode``: the driver must not build them as one table."""
    from basketlens.llm import storage

    plans = []

    def recorded(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, label)

    plain = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", recorded)
    monkeypatch.setattr(storage, "stage", recorded)
    monkeypatch.setattr(near_dedup, "WANTED", 0)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k:])) for k in range(20)] + [(50, "alone here")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert {r.component_id for r in found.collect()} == {0, 50}
    assert {"buckets", "stars", "linked", "links"} <= {label for label, _ in plans}
    # The ids that several texts bear are counted, and there are none.
    assert {label for label, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan} <= {"class-ids"}


def test_windows_travel_without_their_bytes(spark, monkeypatch):
    """Windows of two lines hold a text twice; only those that are found again are cut out."""
    stored = {}
    plain = line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, label: stored.setdefault(label, plain(df, label)))
    rows = [(1, "a b\né d\nown one"), (2, "own two\na b\né d"), (2, "own two\na b\né d"), (None, "a b\né d")]
    found = line_dedup.removed_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "text").collect()
    assert sorted(map(repr, found)) == sorted(map(repr, [type(found[0])(doc_id=i, text=t) for i, t in [(1, "own one"), (2, "own two\n"), (2, "own two\n"), (None, "a b\né d")]]))
    assert "bytes" not in stored["chunk-places"].columns and "bytes" not in line_dedup.windows(spark.createDataFrame(rows, "doc_id bigint, text string")).columns
    assert {bytes(r.bytes).decode() for r in stored["chunk-copies"].collect()} == {"a b\né d"}
