"""BPE by a table of distinct words.

Tasks split their texts into words and write blocks: every text as numbers of the block's distinct words,
and these words by buckets of their hash. Buckets are brought together from all blocks, and in its bucket each
distinct word is encoded once. The ids go back to the block and are joined there by bucket and position. The block's
distinct ids are joined with the vocabulary for their pieces; ids and pieces of a text are then read off its numbers.
Only distinct words of a block are shuffled, never texts; a word in every text is one entry a block.

The vocabulary has a fixed size and is broadcast. Its file is read from a path all machines have.
Null texts count as empty and have no ids. Every row of the input gives one row. A text of any
length is one entry of a block, which ends after ``BLOCK_BYTES`` of text or with the partition.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch_path
from .text import prepare

BLOCK_BYTES = 16 << 20
WORDS_AT_ONCE = 4096
WORDS_OUT = 100_000
#: The tokenizer's word pattern, with white space written out for texts below U+0250.
_PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


@lru_cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache
def _specials(path: str):
    contents = [t["content"] for t in json.load(open(path))["added_tokens"]]
    return regex.compile("|".join(regex.escape(c) for c in sorted(contents, key=len, reverse=True))) if contents else None


@lru_cache
def _letters() -> dict[str, str]:
    """From the characters that byte-level pieces are written in, back to bytes as Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return str.maketrans({chr(256 + k): chr(b) for k, b in enumerate(other)})


def split_words(text: str, path: str) -> list[str]:
    """The words that the tokenizer would merge separately; special tokens are words too."""
    specials = _specials(path)
    if specials is None or "<" not in text or not (found := list(specials.finditer(text))):
        return _ordinary_words(text, path)
    out, at = [], 0
    for match in found:
        out += _ordinary_words(text[at : match.start()], path)
        out.append(match.group())
        at = match.end()
    return out + _ordinary_words(text[at:], path)


def _ordinary_words(text: str, path: str) -> list[str]:
    # Up to U+0240 the library's steps are lower() and the plain pattern; beyond, it is asked itself.
    if text.isascii() or max(text) < "ɀ":
        return _PLAIN.findall(text.lower())
    tokenizer = _tokenizer(path)
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
    return [p.translate(_letters()).encode("latin-1").decode() for p, _ in pieces]


def encode_words(found: list[str], path: str) -> list[list[int]]:
    """The ids of each word."""
    tokenizer, specials = _tokenizer(path), _specials(path)
    out: list[list[int]] = [[] for _ in found]
    special = {k for k, w in enumerate(found) if specials is not None and specials.fullmatch(w)}
    plain = [k for k in range(len(found)) if k not in special]
    for k in special:
        out[k] = [tokenizer.token_to_id(found[k])]
    encoding = tokenizer.encode([found[k] for k in plain], is_pretokenized=True, add_special_tokens=False)
    for word, token in zip(encoding.word_ids, encoding.ids, strict=True):
        out[plain[word]].append(token)
    return out


def _blocks_schema(docs: DataFrame, names: list[str]) -> T.StructType:
    row = T.StructType([docs.schema[n] for n in names])
    bucket = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.StringType())])
    return T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("rows", T.ArrayType(row)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(bucket)),
    ])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up, all their first bytes, all their second bytes and so on: small ones compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_bucket(found: list[str], n: int) -> tuple[np.ndarray, pa.Array]:
    """The place of each word when they are ordered by bucket, and the buckets that have words."""
    bucket = np.fromiter((crc32(w.encode()) % n for w in found), np.int32, len(found))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(found), dtype=np.int32)
    some, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(found)]
    listed = order.tolist()
    lines = ["\n".join([found[k] for k in listed[a:b]]) for a, b in zip(first.tolist(), ends)]  # no words: no buckets
    return place, pa.StructArray.from_arrays([pa.array(some, pa.int32()), pa.array(lines, pa.string())], names=["bucket", "words"])


def blocks(docs: DataFrame, path: str, names: list[str], n_buckets: int) -> DataFrame:
    """A row per block: ``names`` of its rows, words per row, word numbers, distinct words by bucket.

    Words are numbered by how often the block has them; places says where each number is in the
    order of buckets. No word has white space in it: lines separate them.
    """
    schema = _blocks_schema(docs, names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        base, made = TaskContext.get().partitionId() << 32, 0
        table: defaultdict[str, int] = defaultdict()
        table.default_factory = table.__len__
        rows, sizes, numbers, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            whole = pa.concat_arrays(rows).cast(types.field("rows").type.value_type)
            place, buckets = _by_bucket(list(table), n_buckets)
            flat = np.concatenate(numbers)
            by_count = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")
            rank = np.empty(len(table), np.int32)
            rank[by_count] = np.arange(len(table), dtype=np.int32)
            listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns = [pa.array([base + made]), listed(whole), listed(pa.array(sizes, pa.int32()))]
            columns += [pa.array([packed(rank[flat])], pa.binary()), pa.array([packed(place[by_count])], pa.binary()), listed(buckets)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types, strict=True)], schema=types)

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            begun = 0
            for k, text in enumerate(texts):
                text = text.as_py() or ""
                found = split_words(text, path)
                numbers.append(np.fromiter(map(table.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
                held += len(text)
                if held >= BLOCK_BYTES:
                    rows.append(_rows(batch, begun, k + 1, names))
                    yield block()
                    table.clear()
                    rows, sizes, numbers, held, begun, made = [], [], [], 0, k + 1, made + 1
            if begun < batch.num_rows:
                rows.append(_rows(batch, begun, batch.num_rows, names))
        if sizes:
            yield block()

    columns = list(dict.fromkeys([*names, "text"]))
    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(split, schema)


def _rows(batch: pa.RecordBatch, start: int, end: int, names: list[str]) -> pa.StructArray:
    part = batch.slice(start, end - start)
    return pa.StructArray.from_arrays([part.column(part.schema.get_field_index(n)) for n in names], names=names)


def _encoded(buckets: DataFrame, path: str) -> DataFrame:
    """(block, bucket, counts, ids, used), from (bucket, block, words) with a bucket's rows next to each other.

    used are the distinct ids.
    """
    schema = "block bigint, bucket int, counts binary, ids binary, used array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, {}  # the distinct words of this bucket, and their ids
        for batch in batches:
            for bucket, block, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, table = bucket, {}
                found = lines.split("\n")
                fresh = [w for w in found if w not in table]
                for k in range(0, len(fresh), WORDS_AT_ONCE):
                    part = fresh[k : k + WORDS_AT_ONCE]
                    table.update(zip(part, (np.array(i, np.int32) for i in encode_words(part, path)), strict=True))
                ids = [table[w] for w in found]
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([bucket], pa.int32()),
                        pa.array([packed(np.fromiter(map(len, ids), np.int32, len(ids)))], pa.binary()),
                        pa.array([packed(flat)], pa.binary()),
                        pa.array([np.unique(flat)], pa.list_(pa.int32())),
                    ],
                    names=["block", "bucket", "counts", "ids", "used"],
                )

    return buckets.mapInArrow(encode, schema)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the tokenizer; a table of fixed size."""
    pieces = _tokenizer(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in pieces.items()], "id int, piece string")


def _stored(df: DataFrame, label: str, n_buckets: int = 0) -> DataFrame:
    """``df`` written to the shared folder; in buckets by block, a join by block does not move it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if not n_buckets:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"{label}_{uuid.uuid4().hex}"
    writer.option("path", path).bucketBy(n_buckets, "block").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, path: str, names: list[str], finish, schema: str) -> DataFrame:
    """``names`` of every row and what ``finish`` makes of its ids and pieces.

    ``finish(ids, pieces)`` gets the array of a text's ids and the list of all pieces by id, and
    returns a tuple with the values of ``schema``.
    """
    spark = prepare(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = _stored(blocks(docs, path, names, n), "blocks", n)
    buckets = stored.select("block", F.inline("buckets")).select("bucket", "block", "words")
    encoded = _encoded(buckets.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket"), path)
    tables = encoded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts", "ids", "used"))).alias("entries"))
    tables = _stored(tables, "word_ids")
    used = tables.select("block", F.explode(F.array_distinct(F.flatten(F.col("entries.used")))).alias("id"))
    pieces = used.join(F.broadcast(vocabulary(spark, path)), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    tables = tables.select("block", F.col("entries.counts").alias("counts"), F.col("entries.ids").alias("ids")).join(pieces, "block")
    whole = stored.select("block", "rows", "sizes", "numbers", "places").join(tables, "block", "left")
    row = T.StructType([docs.schema[c] for c in names])
    result = T.StructType([*row.fields, *T.StructType.fromDDL(schema).fields])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(result)
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, k=k, batch=batch: batch.column(batch.schema.get_field_index(name))[k]
                rows, sizes = get("rows").values, get("sizes").values.to_numpy()
                joined = lambda name, get=get: np.concatenate([np.zeros(0, np.uint32), *map(unpacked, get(name).as_py() or [])])
                flat, counts = joined("ids"), joined("counts").astype(np.int64)
                numbers = unpacked(get("places").as_py())[unpacked(get("numbers").as_py())]
                known = get("pieces").values
                piece = dict(zip(known.field("id").to_pylist(), known.field("piece").to_pylist(), strict=True)) if known is not None else {}
                starts = np.cumsum(counts) - counts
                ends = np.cumsum(sizes, dtype=np.int64)
                for low, high in _shares(sizes):
                    made = []
                    for r in range(low, high):
                        own = numbers[ends[r] - sizes[r] : ends[r]]
                        n = counts[own]
                        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own], n)
                        made.append(finish(flat[inside], piece))
                    values = [pa.array([m[c] for m in made], types.field(len(names) + c).type) for c in range(len(types) - len(names))]
                    fields = rows.slice(low, high - low).flatten()
                    yield pa.RecordBatch.from_arrays([*(f.cast(t.type) for f, t in zip(fields, types, strict=False)), *values], schema=types)

    return whole.mapInArrow(assemble, result)


def _shares(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some ``WORDS_OUT`` words."""
    low = total = 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= WORDS_OUT:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def tokens(ids: np.ndarray, piece: dict[int, str]) -> tuple[list[int], str]:
    """The ids, and the text that the tokenizer decodes them to: its pieces joined by spaces."""
    listed = ids.tolist()
    return listed, " ".join([piece[i] for i in listed])


def digests(ids: np.ndarray, piece: dict[int, str]) -> tuple[int, str, str]:
    """How many ids, and the SHA-256 of the ids and of the decoded text."""
    listed, text = tokens(ids, piece)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(listed), sha(" ".join(map(str, listed))), sha(text)


def tokenize(docs: DataFrame, path: str, names: list[str] | None = None) -> DataFrame:
    """``names`` (all columns but text by default), ids and decoded of every document."""
    names = names if names is not None else [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    return encode(docs, path, names, tokens, "ids array<int>, decoded string")
