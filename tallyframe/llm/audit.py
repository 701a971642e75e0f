"""What each of five text filters removes, in every order they could be applied in.

Per document a mask says which filters it fails; all counts of all orders come
from the 32 masks of a part. Four filters look at one text. The fifth, being
identical to a text with a smaller id, is found with radix tries: each task
puts its texts into compressed tries whose terminals hold the least id, so a
text that fills a third of the table leaves a task once. What is left is
range-partitioned by text prefixes, and tries over each range settle which ids
are the least of the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from .shipping import ship
from .texts import PACK_LEVEL, Chunk, chunks, words

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")

#: Bytes of labels a trie may hold before its terminals are given out.
TRIE_BYTES = 8 << 20

#: Bytes of a text that order it among others; texts that share them all are ordered by a digest.
PREFIX_BYTES = 64

#: Packed bytes, and rows, of a batch that leaves a task.
OUT_BYTES, OUT_ROWS = 1 << 20, 4_096


@dataclass(frozen=True)
class AuditRules:
    """A: fewer words. B: distinct words under this share of all. C: capitals A-Z over this share of characters. D: any of the symbols."""

    min_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10
    symbols: str = "#$%&*|"


DEFAULT_RULES = AuditRules()


# --- masks of single texts ---------------------------------------------------------------------


def text_masks(chunk: Chunk, rules: AuditRules) -> np.ndarray:
    """Filters A to D of each row. Distinct words are told apart by a hash of 64 bits, less those that number the chunk's rows."""
    found = words(chunk)
    n_rows = len(chunk.offsets) - 1
    n_words = np.diff(found.first)
    row_bits = np.uint64(max(1, (n_rows - 1).bit_length()) if n_rows > 1 else 0)
    tagged = found.codes >> row_bits
    if row_bits:
        tagged |= found.row_of().astype(np.uint64) << (np.uint64(64) - row_bits)
    tagged.sort()
    fresh = np.ones(len(tagged), dtype=bool)
    fresh[1:] = tagged[1:] != tagged[:-1]
    n_distinct = _per_row(fresh, found.first)
    data = chunk.bytes
    n_upper = _per_row((data >= 0x41) & (data <= 0x5A), chunk.offsets)
    n_points = _per_row((data & 0xC0) != 0x80, chunk.offsets)
    marked = np.zeros(256, dtype=bool)
    marked[list(rules.symbols.encode("ascii"))] = True
    n_symbols = _per_row(marked[data], chunk.offsets)
    failed = (
        n_words < rules.min_words,
        100 * n_distinct < rules.distinct_percent * n_words,
        100 * n_upper > rules.upper_percent * n_points,
        n_symbols > 0,
    )
    return sum((f.astype(np.int32) << i for i, f in enumerate(failed)), np.zeros(n_rows, dtype=np.int32))


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


# --- compressed tries --------------------------------------------------------------------------


class Node:
    """An edge's bytes, what follows them, and what ends here."""

    __slots__ = ("label", "children", "held")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.held: Held | None = None


class Trie:
    """Texts by their bytes; runs without a branch are one edge."""

    def __init__(self):
        self.root = Node(b"")
        self.bytes = 0

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(child.label)
                return child
            label = child.label
            if not text.startswith(label, at):
                child = node.children[text[at]] = self._split(child, _shared(label, text, at))
            node, at = child, at + len(child.label)
        return node

    @staticmethod
    def _split(child: Node, length: int) -> Node:
        upper = Node(child.label[:length])
        child.label = child.label[length:]
        upper.children[child.label[0]] = child
        return upper

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """Every text that ends here, with its node, by a walk over all branches."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node.label
            if node.held is not None:
                yield text, node
            stack.extend((child, text) for child in node.children.values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes of ``label`` stand in ``text`` at ``at``; at least one does, not all do."""
    low, high = 1, len(label)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if text.startswith(label[:middle], at) else (low, middle)
    return low


class Held:
    """The least id of a text, the rows that have it by part, and how often the text was met."""

    __slots__ = ("doc_id", "mask", "parts", "met")

    def __init__(self, doc_id: int, mask: int):
        self.doc_id, self.mask, self.parts, self.met = doc_id, mask, {}, 0


class Minima:
    """Rows whose text has a smaller id go out as duplicates at once; those with the least id so far are held."""

    def __init__(self, duplicate: Callable[[int, str, int, int], None]):
        self.trie = Trie()
        self.duplicate = duplicate

    def add(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> None:
        node = self.trie.terminal(text)
        held = node.held
        if held is None:
            held = node.held = Held(doc_id, mask)
        held.met += 1
        if doc_id > held.doc_id:
            self.duplicate(doc_id, part, mask | DUPLICATE, n)
            return
        if doc_id < held.doc_id:
            for p, k in held.parts.items():
                self.duplicate(held.doc_id, p, mask | DUPLICATE, k)
            held.doc_id, held.parts = doc_id, {}
        held.parts[part] = held.parts.get(part, 0) + n

    def give_out(self, everything: bool) -> Iterator[tuple[bytes, Held]]:
        """All held texts, or those met once; the others stay if they fill at most half a trie."""
        kept = Trie()
        for text, node in self.trie.terminals():
            if everything or node.held.met == 1 or kept.bytes + len(text) > TRIE_BYTES // 2:
                yield text, node.held
            else:
                kept.terminal(text).held = node.held
        self.trie = kept


# --- the two passes ----------------------------------------------------------------------------

_TERMINALS = "doc_id long, part string, mask int, n long, held boolean, prefix binary, digest long, packed binary"
_MASKS = "doc_id long, part string, mask int, n long"


class _Out:
    """Rows on their way out of a task, as batches of bounded size."""

    def __init__(self, kinds: dict[str, pa.DataType]):
        self.kinds, self.rows, self.bytes = kinds, [], 0

    def put(self, *row) -> None:
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(self.kinds)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds.values(), strict=True)], names=list(self.kinds))
        self.rows, self.bytes = [], 0
        return out


def _local_minima(rules: AuditRules):
    """Tasks over documents: settled rows without a text, and the least row of each text with it."""
    kinds = {
        "doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64(), "held": pa.bool_(),
        "prefix": pa.binary(), "digest": pa.int64(), "packed": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(kinds)
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
        minima = Minima(lambda doc_id, part, mask, n: out.put(doc_id, part, mask, n, False, None, None, None))

        def given(everything: bool) -> Iterator[pa.RecordBatch]:
            for text, held in minima.give_out(everything):
                packed = pack(text)
                out.bytes += len(packed)
                digest = xxhash.xxh64_intdigest(text) - (1 << 63)
                for part, n in held.parts.items():
                    out.put(held.doc_id, part, held.mask, n, True, text[:PREFIX_BYTES], digest, packed)
                if out.full():
                    yield out.batch()

        for chunk in chunks(batches):
            masks = text_masks(chunk, rules).tolist()
            ids, parts = chunk.rows.column(0).to_pylist(), chunk.rows.column(1).to_pylist()
            for row, (doc_id, part, mask) in enumerate(zip(ids, parts, masks, strict=True)):
                if doc_id is None:
                    out.put(None, part, mask, 1, False, None, None, None)
                else:
                    minima.add(chunk.text(row), doc_id, part, mask, 1)
            if minima.trie.bytes > TRIE_BYTES:
                yield from given(False)
            if out.full():
                yield out.batch()
        yield from given(True)
        yield out.batch()

    return run


def _range_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks over one range of prefixes, sorted: a trie is given out between two different texts, once it is large."""
    out = _Out({"doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64()})
    unpack = zstandard.ZstdDecompressor().decompress
    minima, before = Minima(out.put), None

    def given() -> Iterator[pa.RecordBatch]:
        for _, held in minima.give_out(everything=True):
            for part, n in held.parts.items():
                out.put(held.doc_id, part, held.mask, n)
            if out.full():
                yield out.batch()

    for batch in batches:
        for doc_id, part, mask, n, prefix, digest, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (prefix, digest) != before and minima.trie.bytes > TRIE_BYTES:
                yield from given()
            before = prefix, digest
            minima.add(unpack(packed), doc_id, part, mask, n)
        if out.full():
            yield out.batch()
    yield from given()
    yield out.batch()


def document_masks(documents: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """``doc_id, part, mask, n``: how many rows with that id and part fail exactly the filters of the mask (A is 1, E is 16).

    A null text is an empty one and a null ``lang`` an empty part. A row is a
    duplicate if a smaller id has the identical text, wherever it stands, so
    the first of equal ids is none, and neither are repeated rows of it. A row
    without an id is neither a duplicate nor makes one. Whole texts are
    compared, of any length; other columns are not looked at.

    Terminals are written to the shared folder, since Spark looks at their
    prefixes first to choose the ranges and then deals them out.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    path = scratch_path(spark, "audit-terminals")
    rows.mapInArrow(_local_minima(rules), _TERMINALS).write.parquet(path)
    terminals = spark.read.schema(_TERMINALS).parquet(path)
    settled = terminals.where(~F.col("held")).select("doc_id", "part", "mask", "n")
    ranged = terminals.where("held").drop("held").repartitionByRange("prefix", "digest").sortWithinPartitions("prefix", "digest")
    return settled.unionByName(ranged.mapInArrow(_range_minima, _MASKS))


# --- counts ------------------------------------------------------------------------------------


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows per mask, those labelled quality 1 and those labelled toxic 1 by any label of their id."""
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = masks.join(known, masks["doc_id"] == known["_id"], "left")
    n = F.col("n")
    return marked.groupBy("part", "mask").agg(
        F.sum(n).alias("n"),
        F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def order_effects(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included, from the at most 32 cells of each part."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit_of = lambda letter: F.pow(F.lit(2), F.ascii(letter) - F.ascii(F.lit(FILTERS[0]))).cast("int")
    letters = F.split("filter_order", "")
    steps = (
        cells.groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
        .withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("bit", bit_of(F.element_at(letters, F.col("step"))))
        .withColumn("earlier", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc + bit_of(x)))
    )
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(of: Callable[[Column], Column], where: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c["mask"]), of(c)).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    # Of the orders in which a document fails k filters, an equal share has each of them first.
    share = lambda c: c["n"] * (len(orders) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: m.bitwiseAND(bit.bitwiseOR(earlier)) == 0).alias("kept"),
        total(lambda c: c["n"], lambda m: fails(m) & ~gone(m)).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total(lambda c: c["toxic"], lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame, rules: AuditRules = DEFAULT_RULES) -> DataFrame:
    """The effects of all orders; an empty table of documents gives an empty one."""
    return order_effects(mask_cells(document_masks(documents, rules), labels))
