"""Secret scans with multipart credential linking.

Strong findings (assignments, access identifiers, long hex strings) stand on their own.
Weak parts (bare 40-character keys, endpoints) mean something only beside their
complements, so they are reported only where a scope around them holds those: a key needs
an access identifier within ``SCOPE`` characters, an endpoint an access identifier and a
secret. The link is an interval join within a document, done as range windows over the
parts' positions, so no pairs are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.llm.common import written

SCOPE = 400
KINDS = ("assign", "access", "hex", "key", "endpoint")
MARKS = {"assign": "[SECRET]", "access": "[ACCESS-ID]", "hex": "[HEX]", "key": "[KEY]", "endpoint": "[ENDPOINT]"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
#: A host begins where a run of host characters does, so each run is read once.
_ENDPOINT = re.compile(r"(?:https?://|(?<![A-Za-z0-9.-])\.*[A-Za-z0-9-]+\.)[A-Za-z0-9.-]+\.[a-z]{2,}(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
SPANS = T.ArrayType(SPAN)


def find_parts(text: str) -> list[tuple[int, int, str]]:
    """All parts of a text as (start, end, kind); weak ones only beside an access identifier."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    access = [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    out += access
    out += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    if access:
        out += [(m.start(), m.end(), "key") for m in _KEY.finditer(text)]
        out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    return out


@F.pandas_udf(SPANS)
def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([find_parts(t) if t else [] for t in texts])


def link_parts(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """``parts(*keys, start, end, kind)`` -> those to report: strong ones always, weak ones
    where the scope holds their complements."""
    near = W.partitionBy(*keys).orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    seen = parts.withColumns({"__id": has("access"), "__secret": has("assign", "key", "hex")})
    keep = F.when(F.col("kind") == "key", F.col("__id")).when(F.col("kind") == "endpoint", F.col("__id") & F.col("__secret")).otherwise(True)
    return seen.where(keep).drop("__id", "__secret")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, __text_hash, spans array<struct<start, end, kind>>``,
    one row per input row, spans by start, then kind as listed in ``KINDS``.

    Offsets count code points, end exclusive. Null or empty text has no spans. Rows with
    equal ids and texts have equal spans; equal ids with different texts are kept apart by
    a hash of the text. Other columns are ignored; no rows give no rows.
    """
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("__text_hash"), _parts(F.coalesce("text", F.lit(""))).alias("spans")), "secret-parts")
    weak = F.exists("spans", lambda s: s["kind"].isin("key", "endpoint"))
    keys = ["__k", "__text_hash"]
    open_ = rows.where(weak).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__k"), "__text_hash", "spans").dropDuplicates(keys)
    linked = link_parts(open_.select(*keys, F.inline("spans")), keys, scope)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    linked = linked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("__linked"))
    linked = written(linked.withColumnsRenamed({"__k": "__lk", "__text_hash": "__lh"}), "secret-links")
    in_order = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), s["kind"]).alias("rank"), s["end"], s["kind"]))),
        lambda s: F.struct(s["start"], s["end"], s["kind"]),
    )
    chosen = F.transform("__linked", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    strong = F.filter("spans", lambda s: ~s["kind"].isin("key", "endpoint"))
    joined = rows.join(linked, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("__lk")) & (F.col("__text_hash") == F.col("__lh")), "left").withColumn("spans", strong)
    return joined.select("doc_id", "__text_hash", F.coalesce(chosen, in_order).alias("spans"))


def spans_text(spans) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text, found):
        if text is None or found is None or not len(found):
            return text
        out, at = [], 0
        for s in found:
            if s["start"] >= at:
                out += [text[at : s["start"]], MARKS[s["kind"]]]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def redact_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every row and column of ``docs``, with the text's secrets replaced by marks.
    Texts without findings, null and empty ones are unchanged; repeated rows stay; no rows
    give no rows. Columns may not begin with two underscores."""
    found = scan_secrets(docs, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "__text_hash"])
    found = written(found.withColumnsRenamed({"doc_id": "__rid", "__text_hash": "__rh", "spans": "__spans"}), "secret-spans")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__rid")) & (F.xxhash64("text") == F.col("__rh")), "left")
    # Only texts with findings go to the Python workers; the others are null there.
    hit = F.coalesce(F.size("__spans") > 0, F.lit(False))
    masked = F.when(hit, _redacted(F.when(hit, F.col("text")), "__spans")).otherwise(F.col("text"))
    return joined.withColumn("text", masked).select(docs.columns)
