"""Secret scans by an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its bytes; a row is a version of a path that points at a blob. The ledger
holds, for each blob and version of the rules, what a scan found. Only pairs of blob and rule version that the ledger
lacks are scanned, each blob once however many paths and versions hold it, and findings are joined back to all rows.

One copy of each unseen blob is chosen by an aggregate, which merges copies before the shuffle; what is joined back is
narrow (digest and findings).

Defined results: a null text is the empty blob, without findings; repeated rows each get the findings; offsets are
code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices

RULES_VERSION = "3"
BASE_KINDS = ["assign", "access", "hex"]
# The base rules of the query, then what this operator adds.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
# What belongs to a key without an END line: armour headers and base64 lines, with line breaks that may be escaped or
# quoted, then a short last line and a checksum.
_GAP = r"""(?:\s|\\[rnt]|["'`+,>|#*])*+"""
KEY_LINES = re.compile(
    rf"(?>{_GAP}(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}))++"
    rf"""(?>{_GAP}(?:[A-Za-z0-9+/]{{1,15}}+={{1,2}}|(?:[A-Za-z0-9+/]{{4}}){{1,3}}(?=["'`,;]*(?:\s*?[\r\n]|\\[rn]|\Z))))?"""
    rf"(?>{_GAP}=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/]))?"
)
# A run of scheme characters is looked at from its beginning only, which keeps the search linear.
URL_LOGIN = re.compile(r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s/:@]++:[^\s/@]{4,}+@")
SCHEME = re.compile(r"\b[a-z][a-z0-9+.-]+://")


def _each(pattern: re.Pattern, check: Callable[[re.Match], bool] | None = None) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if check is None or check(m))


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """From BEGIN through END, if that comes before another BEGIN, and else through the lines of the key."""
    for begin in KEY_BEGIN.finditer(text):
        after = text.find("-----BEGIN ", begin.end())
        end = KEY_END.search(text, begin.end(), after if after >= 0 else len(text))
        end = end or KEY_LINES.match(text, begin.end(), after if after >= 0 else len(text)) or begin
        yield begin.start(), end.end()


def _url_logins(text: str) -> Iterator[tuple[int, int]]:
    for m in URL_LOGIN.finditer(text):
        if scheme := SCHEME.search(text, m.start(), m.end()):
            yield scheme.start(), m.end()


RULES = [
    ("assign", _each(re.compile(ASSIGN), lambda m: m.end(2) - m.start(2) >= 6)),
    ("access", _each(re.compile(r"AKIA[A-Z0-9]{16,}"))),
    ("hex", _each(re.compile(r"[0-9a-f]{24,}"))),
    ("private_key", _private_keys),
    ("web_token", _each(re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"))),
    ("url_login", _url_logins),
]
FOUND_IN = ["kinds", "starts", "ends"]
KINDS = [kind for kind, _ in RULES]


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """Findings as (start, place of the kind in KINDS, end), in order; leftmost and not overlapping per kind."""
    found = []
    for k, (_, spans) in enumerate(RULES):
        found.extend((start, k, end) for start, end in spans(text))
    found.sort()
    return found


LEDGER = "blob binary, rules string, kinds array<string>, starts array<long>, ends array<long>"
_LEDGER_ARROW = pa.schema([
    ("blob", pa.binary()), ("rules", pa.string()), ("kinds", pa.list_(pa.string())),
    ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
])


def _scan(batches: Iterable[pa.RecordBatch], rules: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [scan_text(t or "") for t in batch.column("text").to_pylist()]
        yield batch_of(
            _LEDGER_ARROW, batch.column("blob"), [rules] * len(found), [[KINDS[k] for _, k, _ in f] for f in found],
            [[s for s, _, _ in f] for f in found], [[e for _, _, e in f] for f in found],
        )


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """Ledger rows for the blobs that the ledger lacks under this version of the rules; append them to the ledger."""
    blobs = versions.select(blob_of().alias("blob"), F.col("text").cast("string").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return once.mapInArrow(lambda batches: _scan(batches, rules), LEDGER)


def findings(versions: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """Every row's id with what its blob holds: doc_id, kinds, starts, ends."""
    rows = versions.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of().alias("blob"))
    known = ledger.filter(F.col("rules") == rules).drop("rules")
    known = known.filter(F.size("kinds") > 0)  # a blob without findings needs no partner
    return rows.join(known, "blob", "left").select("doc_id", "kinds", "starts", "ends")


def secret_spans(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans and all spans.

    Unseen blobs are scanned; a given ledger answers for the others.
    """
    known = scan_unseen(versions, ledger, rules)
    if ledger is not None:
        known = known.unionByName(ledger.select(*known.columns))
    found = findings(versions, known, rules)
    spans = F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")),
    )
    spans = F.coalesce(spans, F.array().cast("array<string>"))
    base = F.filter(spans, lambda s: F.substring_index(s, ":", 1).isin(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: k == kind)).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", spans).alias("spans"),
    )


def mask(text: str, kinds: list[str], starts: list[int], ends: list[int]) -> str:
    """Each run of overlapping findings becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in zip(kinds, starts, ends):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, findings masked and ``n_chars``, if there is such a column, brought up to date."""
    known = scan_unseen(docs).filter(F.size("kinds") > 0)
    known = known.select(F.col("blob").alias("_secret_blob"), *[F.col(c).alias(f"_secret_{c}") for c in FOUND_IN])
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            rows = zip(*(batch.column(f"_secret_{c}").to_pylist() for c in FOUND_IN))
            found = [(i, row) for i, row in enumerate(rows) if row[0]]
            columns = {name: batch.column(name) for name in names}
            if found:
                text = columns["text"].to_pylist()
                for i, row in found:
                    text[i] = mask(text[i], *row)
                columns["text"] = pa.array(text, columns["text"].type)
                if "n_chars" in columns:
                    chars = columns["n_chars"].to_pylist()
                    for i, _ in found:
                        chars[i] = len(text[i])
                    columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.join(known, blob_of() == F.col("_secret_blob"), "left").mapInArrow(run, docs.schema)
