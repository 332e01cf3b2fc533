"""Token counts (8) that follow edits: a segment tree over pre-tokens per document.

A byte-level BPE encodes what lies between two cuts on its own (see `tokens`). A tree's leaves are runs of `LEAF` such parts with
their code points and ids; inner nodes hold the sums. An edit finds its leaves by descending the code-point sums; the run of
leaves that it touches is encoded again, together with neighbours as long as an edge of the run is no cut any more (blanks that come or
go beside it), and the sums above the run are brought up to date. The rest of the text is not encoded.

Edits are rows (doc_id, at, remove, put): `remove` code points from place `at` on give way to `put`. Places are those of the stored
text, so the edits of a document do not depend on each other. They are taken in order of place, then of `put` and `remove`; an edit that begins
inside an earlier one's removed part, or at the same place as an earlier one, is refused and counted. So a document takes at most one edit per place, which bounds what a task gathers
by the length of the text.

Defined results: a null text is empty; null or negative `at` and `remove` count as 0, places behind the end as the end; a null `put`
inserts nothing; edits whose id is null or unknown change nothing; rows that repeat an id get the edits each; empty tables
give empty results. `docs` must be a stored table, as trees find their texts by file and place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, fresh, numbered, text_batches
from strata.llm.tokens import DEFAULT_TOKENIZER, Encoder, encoder

LEAF = 64


class Tree:
    """Sums of code points and ids over the leaves of one document, as an implicit binary tree with the root at 1."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums  # (2 x leaves, 2)
        self.leaves = len(sums) // 2

    @classmethod
    def build(cls, encode: Encoder, text: str) -> Tree:
        parts = np.array(encode.counts(text)).T
        runs = np.add.reduceat(parts, np.arange(0, len(parts), LEAF), axis=0)
        width = 1 << max(0, (len(runs) - 1).bit_length())
        sums = np.zeros((2 * width, 2), np.int64)
        sums[width : width + len(runs)] = runs
        while width > 1:
            sums[width // 2 : width] = sums[width : 2 * width : 2] + sums[width + 1 : 2 * width : 2]
            width //= 2
        return cls(sums)

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(np.frombuffer(data, "<i8").reshape(-1, 2).copy())

    def dump(self) -> bytes:
        return self.sums.astype("<i8").tobytes()

    @property
    def points(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds code point `place`, and where that leaf begins."""
        node, begin = 1, 0
        while node < self.leaves:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if place >= begin + left and self.sums[node + 1, 0]:
                begin, node = begin + left, node + 1
        return node - self.leaves, begin

    def put(self, leaf: int, points: int, tokens: int) -> None:
        node = leaf + self.leaves
        change = np.array([points, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def _is_cut(text: str, place: int) -> bool:
    """Whether the encoder cuts here: a single space between two visible characters."""
    return 0 < place < len(text) - 1 and text[place] == " " and not text[place - 1].isspace() and not text[place + 1].isspace()


def accepted(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """The edits that are taken, in order of place."""
    taken: list[tuple[int, int, str]] = []
    for at, remove, put in sorted((min(max(a or 0, 0), length), max(r or 0, 0), p or "") for a, r, p in edits):
        if not taken or at > taken[-1][0] and at >= taken[-1][0] + taken[-1][1]:
            taken.append((at, min(remove, length - at), put))
    return taken


def apply_edits(tree: Tree, text: str, edits: list[tuple[int, int, str]], encode: Encoder) -> tuple[str, int]:
    """Apply accepted edits, last place first, so that earlier places stay as they are; the new text and the code points encoded again."""
    again = 0
    for at, remove, put in reversed(edits):
        text = text[:at] + put + text[at + remove :]
        first, begin = tree.find(at)
        last, end = tree.find(at + remove)
        end += int(tree.sums[last + tree.leaves, 0])
        grown = len(put) - remove
        # Take in neighbours until both edges are cuts of the new text (or its ends).
        while first > 0 and begin > 0 and not (begin < at and _is_cut(text, begin)):
            first -= 1
            begin -= int(tree.sums[first + tree.leaves, 0])
        while last + 1 < tree.leaves and end + grown < len(text) and not (end > at + remove and _is_cut(text, end + grown)):
            last += 1
            end += int(tree.sums[last + tree.leaves, 0])
        region = text[begin : end + grown]
        again += len(region)
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
        tree.put(first, len(region), len(encode.encode(region)) // 4)
    return text, again


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    place = fresh(docs, "__row")
    return numbered(docs, place).select(F.col(id_col).cast("bigint").alias("doc_id"), text, F.col(place).alias("row"))


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, row, n_tokens, n_chars and tree of every document."""
    text_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            trees = [Tree.build(encode, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.points for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())],
                ["doc_id", "row", "n_tokens", "n_chars", "tree"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, row bigint, n_tokens bigint, n_chars bigint, tree binary")


def recount(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """Every document with its counts before and after its edits: doc_id, row, n_tokens_before, n_tokens, n_chars, n_edits,
    n_refused, chars_encoded, text and tree (both null where no edit was taken, as stored text and tree still hold).

    `trees` is a stored table of `build_trees`.
    """
    text_batches(docs.sparkSession)
    zero = F.lit(0).cast("bigint")
    given = edits.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("at").cast("bigint").alias("at"), F.col("remove").cast("bigint").alias("remove"), F.col("put").cast("string").alias("put"))
    known = trees.select("doc_id", "row", "n_chars").join(given, "doc_id")
    place = F.least(F.greatest(F.coalesce("at", zero), zero), F.col("n_chars")).alias("at")
    one = F.struct(F.greatest(F.coalesce("remove", zero), zero).alias("remove"), F.coalesce("put", F.lit("")).alias("put"))
    # Of the edits at a place only the first is ever taken; the others are counted before anything is gathered.
    first = known.groupBy("row", place).agg(F.min(one).alias("e"), F.count(F.lit(1)).alias("n"))
    listed = first.groupBy("row").agg(F.collect_list(F.struct("at", "e.remove", "e.put")).alias("edits"), F.sum("n").alias("given"))
    work_list = trees.join(listed, "row")
    texts = _rows(docs, id_col, text_col).select("row", "text")
    schema = (
        "doc_id bigint, row bigint, n_tokens_before bigint, n_tokens bigint, n_chars bigint, n_edits bigint, n_refused bigint, "
        "chars_encoded bigint, text string, tree binary"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out = []
            for row, text, doc, before, data, edits, given in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                tree = Tree.load(data)
                if tree.points != len(text):
                    raise ValueError("a tree does not belong to its text")
                taken = accepted([(e["at"], e["remove"], e["put"]) for e in edits], len(text))
                new, again = apply_edits(tree, text, taken, encode)
                out.append((doc, row, before, tree.tokens, tree.points, len(taken), given - len(taken), again, new, tree.dump()))
            if out:
                kinds = [*[pa.int64()] * 8, pa.string(), pa.binary()]
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    changed = texts.join(work_list, "row").select("row", "text", "doc_id", "n_tokens", "tree", "edits", "given").mapInArrow(work, schema)
    same = trees.join(listed.select("row"), "row", "left_anti").select(
        "doc_id", "row", F.col("n_tokens").alias("n_tokens_before"), "n_tokens", "n_chars", zero.alias("n_edits"), zero.alias("n_refused"),
        zero.alias("chars_encoded"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("tree"),
    )
    return changed.unionByName(same)


def stored_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    return cut(build_trees(docs, id_col, text_col, tokenizer), "trees")
