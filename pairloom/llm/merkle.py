"""Document fingerprints (12): a Merkle tree per document.

A text is a list of paragraphs (lines); a section is a run of paragraphs that
ends at a blank line or after a paragraph whose digest says so, so sections
exist in texts without blank lines too and meet again after an edit.  A
paragraph's leaves are pieces of 24 to 96 bytes that end at a stop or before
a word with a given initial: cuts follow the content and meet again as well.
A node's digest (128 bits) is taken over its children's; equal roots mean
equal texts, and a comparison goes down only into branches that differ.

The fingerprint is the root's digest followed by the tree: sections parted by
``/``, paragraphs by ``.``, six hexadecimal digits a leaf, about a seventh of
the text.  Likeness is computed from two fingerprints alone: twice the leaves
they share, over the leaves of both; 1 for equal roots and only for them.

Defined results: a null text is the empty text (its tree has one empty
paragraph; two empty texts are alike to 1, an empty and another text to 0).
Rows with null ids come first; rows with equal ids are ordered by a hash of
their text, equal rows follow each other.  The only row is followed by
itself.  Extra columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.common import ROWS_AT_ONCE, slim, stored

#: fixed values of the pieces: at least 24 and at most 96 bytes, up to a stop
#: (Latin with its blank, or CJK) or a blank before one of these initials
PIECE = re.compile(rb".{24,96}?(?:[.,;:!?] |\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f]| (?=[aeotAEOT]))|.{1,96}", re.S)

_CONTINUED = re.compile(rb"[\x80-\xbf]")

#: hexadecimal digits of a leaf in the fingerprint: two texts of 2,700 leaves
#: each share half a leaf by chance; equality is tested by the root alone
TAG = 6

#: one paragraph in so many ends its section by its digest
SECTION = 8

_digest = xxhash.xxh3_128_digest


class Tree:
    """The tree of one text: ``sections`` holds lists of paragraphs, a
    paragraph is the list of its pieces."""

    __slots__ = ("root", "sections", "_tags")

    def __init__(self, text: str):
        self.sections, self._tags, nodes = [], [], []
        paragraphs, tags, below = [], [], []
        lines = text.encode().split(b"\n")
        for at, line in enumerate(lines):
            pieces = PIECE.findall(line)
            leaves = [_digest(p) for p in pieces]
            node = _digest(b"p" + b"".join(leaves))
            paragraphs.append(pieces)
            tags.append(b"".join([d[:TAG // 2] for d in leaves]).hex())
            below.append(node)
            if at == len(lines) - 1 or not pieces or node[0] % SECTION == 0:
                nodes.append(_digest(b"s" + b"".join(below)))
                self.sections.append(paragraphs)
                self._tags.append(".".join(tags))
                paragraphs, tags, below = [], [], []
        self.root = _digest(b"r" + b"".join(nodes)).hex()

    def fingerprint(self) -> str:
        return f"{self.root}|{'/'.join(self._tags)}"


def fingerprint(text: str | None) -> str:
    return Tree(text or "").fingerprint()


def _leaves(tags: str) -> int:
    return (len(tags) - tags.count(".")) // TAG


def _apart(a: list, b: list) -> tuple[list, list, list]:
    """The common elements of two lists (as often as in both), and the rest of each."""
    both = Counter(a) & Counter(b)
    if not both:
        return [], a, b
    rest = []
    for own in (a, b):
        left = both.copy()
        out = []
        for x in own:
            if left[x] > 0:
                left[x] -= 1
            else:
                out.append(x)
        rest.append(out)
    return list(both.elements()), *rest


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, 0 to 1: equal
    sections count whole, then equal paragraphs of the others, then leaves."""
    root, _, a = a.partition("|")
    other, _, b = b.partition("|")
    if root == other:
        return 1.0
    total = sum(map(_leaves, a.split("/"))) + sum(map(_leaves, b.split("/")))
    if not total:
        return 0.0
    same, left, right = _apart(a.split("/"), b.split("/"))
    common = sum(map(_leaves, same))
    same, left, right = _apart([p for s in left for p in s.split(".")], [p for s in right for p in s.split(".")])
    common += sum(map(_leaves, same))
    same, _, _ = _apart([p[i:i + TAG] for p in left for i in range(0, len(p), TAG)], [p[i:i + TAG] for p in right for i in range(0, len(p), TAG)])
    common += len(same)
    return min(2 * common / total, 1 - 1 / (total + 1))  # texts that differ only in order or blank lines


def differing(a: Tree, b: Tree) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The span of code points of each text within which they differ, whole
    leaves: sections, paragraphs and leaves equal from the front and the back
    are passed over branch by branch.  None for equal roots."""
    if a.root == b.root:
        return None
    lead, tail, left, right = 0, 0, a.sections, b.sections
    for level in range(3):
        n = min(len(left), len(right))
        front = next((i for i in range(n) if left[i] != right[i]), n)
        back = next((i for i in range(n - front) if left[-1 - i] != right[-1 - i]), n - front)
        lead += sum(_chars(x, level) for x in left[:front])
        tail += sum(_chars(x, level) for x in left[len(left) - back:])
        left, right = left[front:len(left) - back], right[front:len(right) - back]
        if level == 0:
            left, right = [p for s in left for p in s], [p for s in right for p in s]
        elif level == 1:
            left, right = [x for p in left for x in (*p, b"\n")], [x for p in right for x in (*p, b"\n")]
    # every line counts with a line end; the last has none
    (m, n) = (sum(_chars(s, 0) for s in t.sections) - 1 for t in (a, b))
    lead = min(lead, m, n)
    return (lead, min(m, m + 1 - tail)), (lead, min(n, n + 1 - tail))


def _chars(part, level: int) -> int:
    """Code points of a section (0), of a paragraph with its line end (1) or
    of a leaf (2): bytes that do not continue a character."""
    if level == 0:
        return sum(_chars(p, 1) for p in part)
    text = part if level == 2 else b"".join(part) + b"\n"
    return len(text) - len(_CONTINUED.findall(text))


def _follow(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


#: the edited text's tree begins as the text's own does: its fingerprint is
#: kept as root, characters shared after the root, and the rest
_PAIR = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_root string, shared int, edited_rest string, "
         "near_edited double, near_next double, n_leaves long, edit_from long")
ROOT = 32
_OUT = f"{_PAIR}, kind int, part int, text string"
DONE, FIRST, LAST = 0, 1, 2


def _compared(doc_id, text: str, tree: Tree, after: str, next_print: str) -> tuple:
    """One row: a text, its edited text and the text after it."""
    edited = _follow(text, after)
    own, changed = tree.fingerprint(), Tree(edited)
    other = changed.fingerprint()
    span = differing(tree, changed)
    shared = _shared(own[ROOT:], other[ROOT:])
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed.root, shared, other[ROOT + shared:],
            likeness(own, other), likeness(own, next_print), sum(map(_leaves, tree._tags)), span and span[0][0])


def _shared(a: str, b: str) -> int:
    """Length of the common beginning of two ASCII strings."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a.encode(), np.uint8, n) != np.frombuffer(b.encode(), np.uint8, n))
    return int(differ[0]) if differ.size else n


def _whole(rows: DataFrame) -> DataFrame:
    edited = F.concat("edited_root", F.expr(f"substring(fingerprint, {ROOT + 1}, shared)"), "edited_rest")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited.alias("edited_fingerprint"), "near_edited", "near_next",
                       "n_leaves", "edit_from")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_leaves) of every text, in one pass without a shuffle."""
    from pairloom.llm.common import map_texts

    def make():
        def run(ids, texts):
            trees = [Tree(t) for t in texts]
            return ids, [t.fingerprint() for t in trees], [sum(map(_leaves, t._tags)) for t in trees]

        return run

    return map_texts(slim(df, id_col, text_col), make, "doc_id long, fingerprint string, n_leaves long")


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document, its edited text (its last half gives way to the start
    of the next document) and the next document, by fingerprint.

    One shuffle of the texts, by ranges of (id, hash of the text, row): no id,
    however often it occurs, has to lie in one range.  A task goes through its
    range row by row and holds two texts.  The first and the last row of each
    range are kept aside and meet those of the ranges around it."""
    rows = slim(df, id_col, text_col).withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    keys = ["doc_id", "h", "m"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = _arrow(df, _OUT)

    def run(batches):
        from pyspark import TaskContext

        part, last, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    tree = Tree(text)
                    if last is None:
                        out.append((*[None] * 11, FIRST, part, text))
                    else:
                        out.append((*_compared(*last, text, tree.fingerprint()), DONE, part, None))
                    last = (doc_id, text, tree)
                yield _batch(out, schema)
                out = []
        if last is not None:
            yield _batch([(last[0], *[None] * 10, LAST, part, last[1])], schema)

    def pairs(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, texts, after = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                yield _batch([_compared(i, t, Tree(t), a, fingerprint(a)) for i, t, a in zip(ids, texts, after)], pair_schema)

    pair_schema = _arrow(df, _PAIR)
    found = stored(rows.mapInArrow(run, _OUT), "fingerprints", "zstd")
    names = pair_schema.names
    done = found.where(F.col("kind") == DONE).select(*names)
    # one number per range of the shuffle
    parts = sorted(r[0] for r in found.where(F.col("kind") == LAST).select("part").collect())
    if not parts:
        return _whole(done)
    follows = df.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    first = found.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    last = found.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(follows, "part").join(first, "after")
    return _whole(done.unionByName(last.select("doc_id", "text", "next_text").mapInArrow(pairs, _PAIR)))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
