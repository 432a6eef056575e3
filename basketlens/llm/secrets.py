"""Secret scans with multipart credential linking.

Patterns run over whole texts in the tasks. What they are sure of (assignments of passwords and tokens,
access keys, long hexadecimal runs) is reported as it is. Weak candidates, a user or client name, a short or
oddly named secret, an address of a service, are parts: each has a scope of ``SCOPE`` characters around
it, and it is reported only if its scope holds what it lacks: a name needs a secret, a weak secret a
name, access key or address, an address a name and a secret. Scopes and parts meet in an interval join: both are
cut into cells of the text, joined by cell, and compared exactly; it is a semi join, so no pairs are made.

Offsets count code points; ends are exclusive. Null texts are empty. Equal texts are linked once and get
equal results. Extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import small_bytes
from .text import prepare

SCOPE = 200
CELL = 512

#: All kinds, in the order that ties are listed in.
KINDS = ["assign", "access", "hex", "name", "weak", "address"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.ASCII | re.IGNORECASE)
_WEAK = re.compile(r"""\b(?:pwd|pass|passphrase|auth|bearer|credentials?|private_?key|secret_?key)["']?(?:\x20*[:=]\x20*["']?|\x20+)[A-Za-z0-9+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*""", re.ASCII | re.IGNORECASE)
_ADDRESS = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", re.ASCII | re.IGNORECASE)
#: Lower-case strings of which a text must have one for a pattern to match.
_HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "name": ("user", "login", "client", "account", "access"),
    "weak": ("pwd", "pass", "auth", "bearer", "credential", "private", "secret"),
    "address": ("://",),
}


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kinds as places in ``KINDS``, by start and kind; weak ones included."""
    # Longer than the text, lower() may be; the hints are ASCII and do not depend on it.
    lowered = text.lower()
    hinted = {kind for kind, hints in _HINTS.items() if any(h in lowered for h in hints)}
    # Letters that lower() turns into ASCII ones, such as the Kelvin sign, only add hints.
    found = []
    if "assign" in hinted:
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    for number, (kind, pattern) in enumerate((("name", _NAME), ("weak", _WEAK), ("address", _ADDRESS)), start=3):
        if kind in hinted:
            found += [(number, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


_SPAN = "struct<kind:int,start:bigint,end:bigint>"
#: Three numbers in a row's format.
_SPAN_BYTES = 40


def scan(text: Column) -> Column:
    """A struct of n_assign, n_access, n_hex, base_sha256 and spans (base and weak) for each text."""

    def find(texts: pa.Array) -> pa.Array:
        spans = [find_spans(t.as_py() or "") for t in texts]
        base = [[s for s in row if s[0] < 3] for row in spans]
        counts = [pa.array([sum(s[0] == kind for s in row) for row in base], pa.int64()) for kind in range(3)]
        digests = pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string())
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        listed = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in spans], pa.list_(span))
        return pa.StructArray.from_arrays([*counts, digests, listed], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return F.arrow_udf(find, f"struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:array<{_SPAN}>>")(text)


def scanned(docs: DataFrame, *names: str) -> DataFrame:
    """``names``, k1 and k2 (which stand for the text) and the fields of ``scan``."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"))
    rows = rows.select("row", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("2"), "text").alias("k2"), scan(F.col("text")).alias("s"))
    return rows.select(*names, "k1", "k2", "s.*")


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / CELL), F.floor(high / CELL)))


def linked(found: DataFrame) -> DataFrame:
    """(k1, k2, linked): the weak spans whose scope has the parts they lack, by text. ``found`` is stored."""
    of_text = found.where(F.exists("spans", lambda s: s["kind"] >= 3))
    spans = of_text.select("k1", "k2", F.explode("spans").alias("s")).select("k1", "k2", "s.*").distinct()
    parts = spans.withColumn("cell", _cells(F.col("start"), F.col("end")))
    scopes = spans.where("kind >= 3").withColumn("cell", _cells(F.col("start") - SCOPE, F.col("end") + SCOPE))

    def having(candidates: DataFrame, kinds: list[str]) -> DataFrame:
        others = parts.where(F.col("kind").isin([KINDS.index(k) for k in kinds])).alias("p")
        c = candidates.alias("c")
        near = (F.col("p.start") < F.col("c.end") + SCOPE) & (F.col("p.end") > F.col("c.start") - SCOPE)
        same = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in ("k1", "k2", "cell")]
        return c.join(others, same[0] & same[1] & same[2] & near, "left_semi").select("k1", "k2", "kind", "start", "end").distinct()

    secrets, names = ["assign", "hex", "weak"], ["name", "access"]
    # An address needs both, which may lie in different cells of its scope.
    addresses = scopes.where(F.col("kind") == 5)
    addresses = having(addresses, secrets).intersect(having(addresses, names))
    kept = having(scopes.where(F.col("kind") == 3), secrets).union(having(scopes.where(F.col("kind") == 4), [*names, "address"])).union(addresses)
    return kept.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def _reported(rows: DataFrame, *names: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < 3)
    extra = F.coalesce("linked", F.array().cast(f"array<{_SPAN}>"))
    by_start = F.array_sort(F.transform(F.concat(base, extra), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(by_start, lambda s: F.struct(kinds[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*names, "n_assign", "n_access", "n_hex", "base_sha256", named.alias("spans"))


def report(found: DataFrame, *names: str) -> DataFrame:
    """``names`` of a stored result of ``scanned``, the base columns, and all spans that are reported."""
    return _reported(found.join(small_bytes(stage(linked(found), "linked"), _SPAN_BYTES * F.size("linked")), ["k1", "k2"], "left"), *names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), counts and spans (kind, start, end) of what is reported in every document."""
    found = scanned(docs, "row")
    weak = linked(stage(found.select("k1", "k2", "spans"), "secret-spans"))
    return _reported(found.join(small_bytes(stage(weak, "linked"), _SPAN_BYTES * F.size("linked")), ["k1", "k2"], "left"), "row")
