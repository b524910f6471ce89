"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content (SHA-256). The ledger holds, for each pair of blob and
rule version already scanned, the spans found; only pairs that it lacks are scanned, each content once, and
the findings are joined back to all paths by the content's address. Rules come in sets, each with a version of its
own (VERSIONS): a set that changes is scanned anew, the others' findings stay. Blobs travel compressed, one copy for
each task that saw the content, so a content that a third of all paths share is never gathered in one task.

Null texts are the empty content. Repeated rows and copies share one scan and are answered each. An empty
table gives an empty result; extra columns are ignored. Spans are code points, end exclusive; ties of start
go by kind as listed in KINDS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, written

BASE = ("assign", "access", "hex")
#: Kinds in their order; those after BASE are the additional rules.
KINDS = (*BASE, "pem", "jwt", "hub", "slack")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MORE = {
    "pem": (re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), "PRIVATE KEY"),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), "eyJ"),
    "hub": (re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}"), "gh"),
    "slack": (re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
}
#: Rule sets by version: what a version stands for never changes.
VERSIONS = {"base-1": BASE, "more-1": tuple(KINDS[len(BASE):])}
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """Spans (kind, start, stop) of one content, by start, then kind."""
    found = []
    if "assign" in kinds:
        low = text.lower()
        if any(h in low for h in HINTS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds and "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for i, (kind, (rule, hint)) in enumerate(MORE.items(), len(BASE)):
        if kind in kinds and hint in text:
            found += [(m.start(), i, m.end()) for m in rule.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        keys, blobs = [], []
        for data in batch.column(0).cast(pa.binary()).to_pylist():
            data = data or b""
            key = hashlib.sha256(data).digest()
            if key not in seen:
                seen.add(key)
                keys.append(key)
                blobs.append(pack.compress(data))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["blob", "data"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, seen = zstandard.ZstdDecompressor(), set()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        keys, rules, spans = [], [], []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            text = unpack.decompress(batch.column(1)[i].as_py()).decode("utf-8", "replace")
            for version in batch.column(2)[i].as_py():
                keys.append(key)
                rules.append(version)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in scan(text, VERSIONS[version])])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rules, pa.string()), pa.array(spans, kind)], names=["blob", "rules", "spans"])


def address(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def update(texts: DataFrame, ledger: DataFrame | None = None, versions: tuple[str, ...] = tuple(VERSIONS)) -> DataFrame:
    """The ledger (blob, rules, spans) after scanning what pairs of texts (a column `text`) and versions it lacks. A blob's
    versions that the ledger has are at most as many as there are versions; its text is read once for all that are missing."""
    blobs = small_batches(texts).select("text").mapInArrow(_blobs, "blob binary, data binary")
    wanted = F.array(*(F.lit(v) for v in versions))
    if ledger is None:
        missing = blobs.withColumn("versions", wanted)
    else:
        known = ledger.where(F.col("rules").isin(*versions)).groupBy("blob").agg(F.collect_set("rules").alias("known"))
        missing = blobs.join(known, "blob", "left").select("blob", "data", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))).alias("versions"))
        missing = missing.where(F.size("versions") > 0)
    fresh = missing.repartition("blob").mapInArrow(_scan, f"blob binary, rules string, spans {SPANS}")
    fresh = written(fresh, "secret-ledger")
    return fresh if ledger is None else ledger.select("blob", "rules", "spans").unionByName(fresh)


def _by_blob(ledger: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """One row a blob: the spans of all versions asked for, by start, then kind."""
    spans = ledger.where(F.col("rules").isin(*versions)).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("s"))
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.array_sort(F.transform("s", lambda x: F.struct(x["start"].alias("a"), F.array_position(order, x["kind"]).alias("b"), x["stop"].alias("c"), x.alias("x"))))
    return spans.select(F.col("blob").alias("__blob"), F.transform(keyed, lambda y: y["x"]).alias("__spans"))


def _joined(paths: DataFrame, ledger: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """paths with the spans of their content. Only blobs that hold a secret take part, so that what a third of all paths
    share doesn't gather them in one task unless it holds one; those few hot contents are left to adaptive joins."""
    found = _by_blob(ledger, versions).where(F.size("__spans") > 0)
    return paths.withColumn("__blob", address(F.col("text"))).join(found, "__blob", "left").drop("__blob")


def findings(paths: DataFrame, ledger: DataFrame, versions: tuple[str, ...] = tuple(VERSIONS)) -> DataFrame:
    """paths, every column kept but one named spans, with their content's spans."""
    spans = F.coalesce("__spans", F.array().cast(SPANS)).alias("spans")
    kept = [c for c in paths.columns if c != "spans"]
    return _joined(paths, ledger, versions).select(*kept, spans)


def found(docs: DataFrame, ledger: DataFrame | None = None, versions: tuple[str, ...] = tuple(VERSIONS)) -> DataFrame:
    """doc_id and spans of every document; only pairs of blob and version that the ledger lacks are scanned."""
    rows = docs.select("doc_id", "text")
    keys = rows.select("doc_id", address(F.col("text")).alias("__blob"))
    spans = _by_blob(update(rows, ledger, versions), versions)
    return keys.join(spans, "__blob").select("doc_id", F.col("__spans").alias("spans"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("__spans")).to_pylist(), strict=True):
            parts, last = [], 0
            for s in spans or ():
                if s["start"] >= last:
                    parts += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
                last = max(last, s["stop"])
            out.append(text if not spans else "".join(parts) + text[last:])
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__spans"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in keep], names=[batch.schema.names[i] for i in keep])


def redacted(docs: DataFrame) -> DataFrame:
    """docs, every column kept, each secret in the text replaced by its kind in brackets."""
    return small_batches(_joined(docs, update(docs), tuple(VERSIONS))).mapInArrow(_redact, docs.schema)
