"""Secrets in texts, and how widely each is owned across the corpus."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import settle, slices, text_of

KINDS = ["assign", "access", "hex", "live"]
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# At these lengths the runs of the contract's patterns are exactly these matches: a run is never cut by a shorter one.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
# A value that occurs with this many owners or fewer is specific to them.
OWNERS = 1
# Bits per character below which a value is a placeholder rather than a credential, and words that say so.
LEAST_ENTROPY = 2.5
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|1234567|abcdef0|deadbeef|test")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind as a number, end, secret value) of every base match, by start and kind."""
    out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    """Bits per character of the characters of ``value``."""
    from math import log2

    return -sum(n / len(value) * log2(n / len(value)) for n in map(value.count, set(value)))


def looks_live(value: str) -> bool:
    """Whether a value may be a credential: mixed enough, no placeholder, not a plain number."""
    return entropy(value) >= LEAST_ENTROPY and not value.isdigit() and not _PLACEHOLDER.search(value)


CANDIDATE = "struct<start:int,kind:int,end:int,value_start:int,value:binary,live:boolean>"


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str) -> DataFrame:
    """One row per document, written once: row, doc_id, owner, repository, found (array of ``CANDIDATE``).

    Values are kept as SHA-256 only. ``row`` is unique: task and place in it."""
    def named(column):
        return F.coalesce(docs[column].cast("string"), F.lit("")) if column in docs.columns else F.lit("")

    plain = docs.select(docs[doc_id].alias("doc_id"), named(owner).alias("owner"), named(repository).alias("repository"),
                        text_of(docs, text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    types = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()),
                                ("value", pa.binary()), ("live", pa.bool_())]))

    def scan(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[(start, k, end, end - len(value), hashlib.sha256(value.encode()).digest(), looks_live(value))
                          for start, k, end, value in base_spans(t)] for t in part.column("text").to_pylist()]
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, *[part.column(c) for c in ("doc_id", "owner", "repository")], pa.array(
                        [[dict(zip(("start", "kind", "end", "value_start", "value", "live"), c)) for c in f] for f in found], types)],
                    ["row", "doc_id", "owner", "repository", "found"])

    return settle(plain.mapInArrow(
        scan, f"row long, doc_id {kind}, owner string, repository string, found array<{CANDIDATE}>"), "secrets")


def ownership(rows: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, n_occurrences of every candidate value.

    First one row per value, owner and repository, then per value and owner, then per value: each step adds up within
    its tasks before the exchange, so a value that is in a third of all documents leaves a task as one row per owner.
    """
    each = rows.select("row", "owner", "repository", F.explode("found").alias("c")).select(
        "row", "owner", "repository", F.col("c.value").alias("value")).where("value is not null")
    each = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"),
                                     F.sum("n").alias("n_occurrences"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", owners: int = OWNERS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, found (array of struct: kind, start, end, value as SHA-256, n_owners,
    n_repositories, live), by start and kind.

    Base kinds are assignments of password-like names (12 characters or more), access keys (18 or more) and runs of hex
    digits (16 or more). A value with at most ``owners`` distinct owners in the whole corpus that looks like a credential
    (mixed characters, no placeholder word, not only digits) is live: its place is added as a span of kind ``live``,
    once per value and place. Values that more owners share are widely copied examples and get no such span.

    Null texts count as empty. Null owners and repositories count as one of their own, missing columns as well. A
    repository is named within its owner. Repeated rows are separate documents of the same owner; null ids are kept; an
    empty table gives no rows.
    """
    rows = candidates(docs, doc_id, text, owner, repository)
    some = rows.where(F.size("found") > 0)
    widths = ownership(some)
    each = some.select("row", "doc_id", F.explode("found").alias("c")).withColumn("value", F.col("c.value"))
    # All places of a value meet one row; adaptive execution may split the places of a hot value.
    known = each.join(widths, "value").withColumn("live", F.col("c.live") & (F.col("n_owners") <= owners))

    def span(kind, start, live):
        return F.struct(start.alias("start"), kind.alias("kind"), F.col("c.end").alias("end"), F.col("value"), F.col("n_owners"),
                        F.col("n_repositories"), live.alias("live"))

    base = span(F.col("c.kind"), F.col("c.start"), F.col("live"))
    own = span(F.lit(KINDS.index("live")), F.col("c.value_start"), F.lit(True))
    spans = known.select("row", F.explode(F.when(F.col("live"), F.array(base, own)).otherwise(F.array(base))).alias("s"))
    # What one document holds is bounded by its length.
    grouped = spans.groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("_spans"))
    joined = rows.select("row", "doc_id").join(grouped, "row", "left")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    empty = F.array().cast(grouped.schema["_spans"].dataType)
    return joined.select("doc_id", F.transform(F.coalesce("_spans", empty), lambda s: F.struct(
        F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        s["n_owners"].alias("n_owners"), s["n_repositories"].alias("n_repositories"), s["live"].alias("live"))).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_live, base_sha256, spans of ``find_secrets``."""
    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"] != "live")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))
