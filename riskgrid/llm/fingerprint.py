"""Document fingerprints (4): a Merkle tree over paragraphs and sections.

A text is cut into sections (at empty lines), sections into paragraphs (at line ends) and paragraphs
into pieces (sentences, at most 96 characters).  A piece is hashed, a paragraph hashes its pieces, a
section its paragraphs and the root its sections.  Equal roots mean equal texts; where roots
differ, the branches that differ locate the edit.  A fingerprint is the tree as text::

    root(32 hex) [ "/" section(8) [ "|" paragraph(8) [ ":" piece(8)length(2) ... ] ... ] ... ]

Likeness is the share of the characters of both texts that lie in common pieces.

The query needs each text's successor by ``doc_id``: the texts are dealt once into runs of ids and
sorted there; the first text of a run is dealt to the run before it too.

Defined results: a null text is empty; null doc_ids come first; rows of one doc_id are ordered by
text; a table of one row is its own successor; an empty table gives no rows.  Two equal
fingerprints have likeness 1 (two empty texts too).  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskgrid.llm.common import documents, id_splits, in_runs

PIECE = re.compile(r"[^.!?]{1,96}[.!?]{0,32}|[.!?]{1,32}")
RUN_BYTES = 16 << 20
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [{"long": pa.int64(), "double": pa.float64()}.get(c.split()[1], pa.string()) for c in SCHEMA.split(", ")]


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """The tree of one text: ``sections`` is a list of (hash, paragraphs), a paragraph a (hash, pieces)."""

    def __init__(self, root: str, sections: list):
        self.root, self.sections = root, sections
        self.pieces = Counter(p for _, paragraphs in sections for _, pieces in paragraphs for p in pieces)
        self.length = sum(int(p[8:], 16) * n for p, n in self.pieces.items())

    @classmethod
    def of(cls, text: str) -> Tree:
        sections, hashes = [], []
        for section in text.split("\n\n"):
            paragraphs, below = [], []
            for paragraph in section.split("\n"):
                found = PIECE.findall(paragraph)
                digests = [_hash(p.encode("utf-8", "surrogatepass")) for p in found]
                below.append(_hash(b"p" + b"".join(digests)))
                paragraphs.append((below[-1].hex()[:8],
                                   [f"{d.hex()[:8]}{len(p):02x}" for d, p in zip(digests, found, strict=True)]))
            hashes.append(_hash(b"s" + b"".join(below)))
            sections.append((hashes[-1].hex()[:8], paragraphs))
        return cls(_hash(b"r" + b"".join(hashes)).hex(), sections)

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, *sections = fingerprint.split("/")
        out = []
        for section in sections:
            name, *paragraphs = section.split("|")
            out.append((name, [(p[:8], [p[i:i + 10] for i in range(9, len(p), 10)]) for p in paragraphs]))
        return cls(root, out)

    def __str__(self) -> str:
        return self.root + "".join("/" + name + "".join("|" + p + (":" + "".join(pieces) if pieces else "")
                                                        for p, pieces in paragraphs)
                                   for name, paragraphs in self.sections)


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    total = a.length + b.length
    small, large = sorted((a.pieces, b.pieces), key=len)
    common = sum(min(n, large[p]) * int(p[8:], 16) for p, n in small.items() if p in large)
    # differing texts can have equal pieces in another order: only equal roots reach 1
    return min(2 * common / total, 1 - 1e-9) if total else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` that ``a`` doesn't have, descending only into differing branches."""
    if a.root == b.root:
        return []
    sections = Counter(name for name, _ in a.sections)
    paragraphs = Counter(p for _, ps in a.sections for p, _ in ps)
    return [(i, j) for i, (name, ps) in enumerate(b.sections) if not sections[name]
            for j, (p, _) in enumerate(ps) if not paragraphs[p]]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` by row of ``docs``."""
    runs = in_runs(docs.select("doc_id", "text"), id_splits(docs, RUN_BYTES), lead=True)

    def run(batches):
        last = None          # (run, lead, doc_id, text, tree) of the row before
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("run", "lead", "doc_id", "text")), strict=True)
            for at, lead, doc_id, text in rows:
                text = text or ""
                if last and last[0] == at and last[1] and lead:
                    continue            # one successor is enough
                tree = Tree.of(text)
                if last and last[0] == at and not last[1]:
                    changed = edited(last[3], text)
                    other = Tree.of(changed)
                    out.append((last[2], len(last[3]), hashlib.sha256(changed.encode()).hexdigest(), str(last[4]),
                                str(other), likeness(last[4], other), likeness(last[4], tree)))
                last = (at, lead, doc_id, text, tree)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    return runs.select("run", "lead", "doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints of every document, of its edited text, and their likeness."""
    return fingerprints(documents(spark, sf_dir))
