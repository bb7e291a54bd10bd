"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Lines are paragraphs. A blank line ends a section, and so does a paragraph whose hash is 0 modulo 8, so that a text
without blank lines has sections too and an edit moves no section border far away. A paragraph is cut into pieces
where the hash of its last characters says so (at about every fifth space), so that an edit inside a long paragraph
leaves the hashes of its other pieces alone. Leaves hash pieces; inner nodes hash their children's hashes.

A fingerprint is the tree as text: ``root|section:paragraph,paragraph;section:...`` where a paragraph is
``hash(length.hash length.hash ...)`` with its pieces. Equal texts have equal fingerprints, and equal roots mean equal
texts. ``likeness`` descends only where hashes differ and gives the share of characters below equal nodes;
``differing_spans`` gives the places of the rest.

Defined results: a null or empty text has a root over no sections; two such texts have likeness 1, and one beside a
text with characters has 0. Rows of equal id are ordered by a hash of their text; rows without an id come last in
descending order. A table of one row is its own next document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices

LEAF_HASH, NODE_HASH, ROOT_HASH = 4, 5, 16
LONGEST_PIECE = 512
_BELOW_ALL = 1 << 62


def _hash(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def _piece_ends(text: str) -> np.ndarray:
    """Ends of pieces: after a space that hashes to 0 mod 5 with the six characters before it, and after a line break."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = codes.astype(np.uint64)
    hashed = mixed.copy()
    for back, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x1B873593), 1):
        hashed[back:] += mixed[:-back] * np.uint64(factor)
    hashed = (hashed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)
    cut = (codes == 32) & (hashed % 5 == 0) | (codes == 10) | (hashed % 256 == 0)
    ends = np.flatnonzero(cut) + 1
    if not len(ends) or ends[-1] != len(codes):
        ends = np.append(ends, len(codes))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST_PIECE:  # no cut in sight: cut at fixed lengths from the last one
        ends = np.concatenate([np.append(np.arange(e - g, e, LONGEST_PIECE)[1:], e) for e, g in zip(ends, gaps)])
    return ends


def tree_of(text: str) -> tuple[str, list]:
    """(root, [(section, [(paragraph, [(length, leaf)])])])."""
    sections, section, paragraph, at = [], [], [], 0

    def close_section():
        nonlocal section
        if section:
            sections.append((_hash("".join(h for h, _ in section).encode(), NODE_HASH), section))
            section = []

    def close_paragraph():
        nonlocal paragraph
        name = _hash("".join(f"{n}.{h}" for n, h in paragraph).encode(), NODE_HASH)
        section.append((name, paragraph))
        blank = sum(n for n, _ in paragraph) == 1
        paragraph = []
        if blank or int(name[-2:], 16) % 8 == 0:
            close_section()

    if text:
        for end in _piece_ends(text).tolist():
            piece = text[at:end]
            paragraph.append((end - at, _hash(piece.encode("utf-8", "surrogatepass"), LEAF_HASH)))
            at = end
            if piece[-1] == "\n":
                close_paragraph()
        if paragraph:
            close_paragraph()
        close_section()
    # The root also covers the text itself, so that short leaf hashes cannot make unequal texts equal.
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=ROOT_HASH)
    whole.update("".join(h for h, _ in sections).encode())
    return whole.hexdigest(), sections


def write_tree(tree: tuple[str, list]) -> str:
    root, sections = tree
    body = ";".join(
        name + ":" + ",".join(f"{p}({' '.join(f'{n}.{h}' for n, h in pieces)})" for p, pieces in paragraphs)
        for name, paragraphs in sections
    )
    return f"{root}|{body}"


def read_tree(fingerprint: str) -> tuple[str, list]:
    root, _, body = fingerprint.partition("|")
    sections = []
    for part in filter(None, body.split(";")):
        name, _, rest = part.partition(":")
        paragraphs = []
        for item in rest.split(","):
            p, _, pieces = item[:-1].partition("(")
            paragraphs.append((p, [(int(n), h) for n, h in (x.split(".") for x in pieces.split(" "))]))
        sections.append((name, paragraphs))
    return root, sections


def _size(node: list) -> int:
    """Characters below a list of sections, paragraphs or pieces."""
    if not node:
        return 0
    if isinstance(node[0][0], int):
        return sum(n for n, _ in node)
    return sum(_size(children) for _, children in node)


def _unmatched(a: list, b: list) -> tuple[list, list, int]:
    """Nodes of each side without an equal partner on the other, and the characters below the pairs."""
    left, same = Counter(x[0] if not isinstance(x[0], int) else x for x in b), 0
    key = (lambda x: x) if a and isinstance(a[0][0], int) or b and isinstance(b[0][0], int) else (lambda x: x[0])
    rest_a, used = [], Counter()
    for x in a:
        if left[key(x)] > 0:
            left[key(x)] -= 1
            used[key(x)] += 1
            same += _size([x])
        else:
            rest_a.append(x)
    rest_b = []
    for x in b:
        if used[key(x)] > 0:
            used[key(x)] -= 1
        else:
            rest_b.append(x)
    return rest_a, rest_b, same


def likeness_of(a: tuple[str, list], b: tuple[str, list]) -> float:
    """Share of the characters of both texts that lie below equal nodes: 1 for equal texts."""
    if a[0] == b[0]:
        return 1.0
    total = _size(a[1]) + _size(b[1])
    same, left, right = 0, a[1], b[1]
    for level in range(3):
        left, right, equal = _unmatched(left, right)
        same += equal
        if level < 2:
            left = [child for _, children in left for child in children]
            right = [child for _, children in right for child in children]
    # The root says that the texts differ, whatever the short hashes of leaves say.
    return min(2 * same / total, 1 - 1 / (1 + total)) if total else 1.0


def likeness(a: str, b: str) -> float:
    return likeness_of(read_tree(a), read_tree(b))


def differing_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Places of the first text (code points, end exclusive) whose pieces the second lacks."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    left, right = ([x for _, ps in read_tree(f)[1] for _, pieces in ps for x in pieces] for f in (a, b))
    shorter = min(len(left), len(right))
    head = next((i for i in range(shorter) if left[i] != right[i]), shorter)
    tail = next((i for i in range(shorter - head) if left[-1 - i] != right[-1 - i]), shorter - head)
    have = Counter(right[head : len(right) - tail])
    spans, at = [], sum(n for n, _ in left[:head])
    for piece in left[head : len(left) - tail]:
        if have[piece] > 0:
            have[piece] -= 1
        elif spans and spans[-1][1] == at:
            spans[-1] = (spans[-1][0], at + piece[0])
        else:
            spans.append((at, at + piece[0]))
        at += piece[0]
    return spans


def edited_text(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning, of equal length, of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROWS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ROWS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by part and ascending order; the next document in descending order is the row before."""
    before = None
    for batch in slices(batches):
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "text", "_donor")))
        for part, doc_id, text, donor in rows:
            text = text or ""
            tree = tree_of(text)
            if not donor:
                if before is None or before[0] != part:
                    raise RuntimeError("a part of the documents came without the document before it")
                following, next_tree = before[1:]
                edited = edited_text(text, following)
                new = tree_of(edited)
                out.append((
                    doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    write_tree(tree), write_tree(new), likeness_of(tree, new), likeness_of(tree, next_tree),
                ))
            before = part, text, tree
        if out:
            yield batch_of(_ROWS_ARROW, *zip(*out))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document, of its edited text, and their likeness.

    Texts are shuffled once. A pass over ids finds the bounds of parts of about equal numbers of documents; the last
    document of a part also goes to the following part, whose first row needs it, and that of the last part to the
    first one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_order", F.coalesce("doc_id", F.lit(-_BELOW_ALL)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("_order").repartitionByRange(parts, "_order")
    # Two numbers per part of the range partitioning come to the driver.
    last = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("_order").alias("last")).collect()
    bounds = sorted({r["last"] for r in last})
    if not bounds:
        return spark.createDataFrame([], ROWS)

    # A row at its part's bound is also given to the next part, before that part's own rows; of several rows with
    # that id the last one in order counts.
    part = _part_of(bounds)
    own = F.struct(part.alias("part"), F.lit(False).alias("donor"))
    given = F.struct(F.pmod(part + 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("donor"))
    ends_part = F.get(F.array(*[F.lit(b) for b in bounds]), part) == F.col("_order")
    rows = rows.withColumn("_copy", F.explode(F.when(ends_part, F.array(own, given)).otherwise(F.array(own))))
    rows = rows.select(
        F.col("_copy.part").alias("_part"), F.col("_copy.donor").alias("_donor"), "_order",
        F.xxhash64("text").alias("_digest"), "doc_id", "text",
    )
    rows = rows.repartitionById(len(bounds), F.col("_part"))
    rows = rows.sortWithinPartitions("_part", F.desc("_donor"), "_order", "_digest")
    return rows.select("_part", "doc_id", "text", "_donor").mapInArrow(_compare, ROWS)


def _part_of(bounds: list[int]) -> Column:
    """How many bounds lie below the order of a row, counted in two steps of about the square root of their number."""
    step = math.isqrt(len(bounds)) or 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b < F.col("_order")))

    group = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inner = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group)
    return (group * step + below(inner)).cast("int")
