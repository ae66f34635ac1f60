"""Document fingerprints: a Merkle tree over leaves (runs of words), paragraphs and sections.

Every character lies in exactly one leaf, so equal roots mean equal texts, and where two trees differ the branches that
differ tell which sections and paragraphs do. Paragraphs end at line feeds. Leaves and sections end where the hash of
a word or a paragraph says so, so an edit moves no other boundary.
"""

from __future__ import annotations

import hashlib
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING
from zlib import crc32

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_sized

if TYPE_CHECKING:
    import pyarrow as pa

#: Characters of a leaf's code in a fingerprint; the hashes above the leaves are made from whole hashes.
CODE = 4
#: Words in a leaf and paragraphs in a section, on average.
LEAF_WORDS, SECTION_PARAGRAPHS = 4, 4
#: Documents between two cuts of the sorted ids, about, and the most cuts.
BLOCK_ROWS, BLOCKS = 2000, 10_000


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


@dataclass
class Tree:
    """Hash of the root, and for each section the codes of its paragraphs' leaves: all of it is in the fingerprint."""

    root: str
    sections: list[list[str]]

    @property
    def fingerprint(self) -> str:
        """root:section|section..., a section's paragraphs set apart by commas, a paragraph being its leaves' codes, CODE characters each."""
        return f"{self.root}:{'|'.join(map(','.join, self.sections))}"

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        root, _, body = fingerprint.partition(":")
        return cls(root, [x.split(",") for x in body.split("|")] if body else [])

    @cached_property
    def leaves(self) -> Counter:
        return Counter(p[k : k + CODE] for s in self.sections for p in s for k in range(0, len(p), CODE))


def tree(text: str) -> Tree:
    sections: list[bytes] = []
    codes: list[list[str]] = []
    paragraphs: list[bytes] = []
    *whole, last = text.encode().split(b"\n")
    for line in [*(x + b"\n" for x in whole), *([last] if last else [])]:
        own, start, at = [], 0, 0
        for word in line.split(b" "):
            at += len(word) + 1
            if crc32(word) % LEAF_WORDS == 0 and at < len(line):
                own.append(_hash(line[start:at]))
                start = at
        if start < len(line):
            own.append(_hash(line[start:]))
        if not paragraphs:
            codes.append([])
        paragraphs.append(_hash(b"p" + b"".join(own)))
        codes[-1].append(urlsafe_b64encode(b"".join(x[: CODE * 3 // 4] for x in own)).decode())
        if paragraphs[-1][0] % SECTION_PARAGRAPHS == 0:
            sections.append(_hash(b"s" + b"".join(paragraphs)))
            paragraphs = []
    if paragraphs:
        sections.append(_hash(b"s" + b"".join(paragraphs)))
    return Tree(_hash(b"r" + b"".join(sections), 16).hex(), codes)


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots; else the share of both trees' leaves that are found in the other, from 0 to less than 1."""
    if a.root == b.root:
        return 1.0
    few, many = (a.leaves, b.leaves) if len(a.leaves) <= len(b.leaves) else (b.leaves, a.leaves)
    size = few.total() + many.total()
    return min(1 - 1 / size, 2 * sum(min(n, many[h]) for h, n in few.items() if h in many) / size)


def differences(a: Tree, b: Tree) -> list[int]:
    """Paragraphs of a (from 0) whose branches b lacks; sections found whole in b are passed over."""
    have, lines = set(map(tuple, b.sections)), {x for some in b.sections for x in some}
    out, at = [], 0
    for some in a.sections:
        if tuple(some) not in have:
            out += [at + k for k, x in enumerate(some) if x not in lines]
        at += len(some)
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, block, edge) where each block, sorted by edge and doc_id, ends with an edge row: the document after it.

    The ids are cut into blocks at quantiles; a block's first document is also sent to the block before it, the very
    first to the last block. So every document meets the next one with one shuffle of the texts and no global window.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("at"))
    n = ids.count()
    k = min(BLOCKS, max(1, n // BLOCK_ROWS))
    cuts = sorted(set(ids.na.drop().approxQuantile("at", [i / k for i in range(1, k)], min(0.01, 0.2 / k)))) if k > 1 else []
    rows = rows.withColumn("at", F.col("doc_id").cast("double"))
    if cuts:
        bounds = [float("-inf"), *cuts, float("inf")]
        rows = Bucketizer(splits=bounds, inputCol="at", outputCol="slot", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("slot", F.lit(0.0))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.col("slot").cast("int")).alias("block"))
    heads = cut(rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("head")))
    line = Window.orderBy("block")  # one row for each block
    before = F.coalesce(F.lag("block").over(line), F.max("block").over(Window.partitionBy()))
    heads = heads.select(before.alias("to"), F.col("head.doc_id").alias("_d"), F.col("head.tie").alias("_t"))
    edges = join_sized(rows, heads, rows["doc_id"].eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")), "inner", heads.count())
    both = rows.withColumn("edge", F.lit(0)).select("block", "edge", "doc_id", "tie", "text")
    both = both.union(edges.select("to", F.lit(1), "doc_id", "tie", "text"))
    return both.repartition("block").sortWithinPartitions("block", "edge", F.col("doc_id").asc_nulls_last(), "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text), whole, as (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending doc_id, after the last the first. edited_paragraphs is how many of the text's paragraphs the
    edited tree lacks. Null counts as empty. Rows with equal doc_id follow each other by hash, rows without one come
    last; a single row is its own next. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        block = held = None
        for batch in batches:
            out = []
            for at, edge, doc, text in zip(*(batch.column(x).to_pylist() for x in ("block", "edge", "doc_id", "text")), strict=True):
                if at == block and held is None:
                    continue  # another copy of the row at the edge
                own = tree(text)
                if at == block:
                    doc_was, was, tree_was = held
                    n = len(was)
                    edited = was[: n - n // 2] + text[: n // 2]
                    other = tree(edited)
                    out.append((doc_was, n, hashlib.sha256(edited.encode()).hexdigest(), tree_was.fingerprint, other.fingerprint, likeness(tree_was, other), likeness(tree_was, own), len(differences(tree_was, other))))
                block, held = at, None if edge else (doc, text, own)
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs long"
    return in_order(docs).mapInArrow(run, schema)
