"""Edit-aware token counts over pre-token segment trees (operator 3).

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens. Each
document keeps a tree: leaves hold runs of pre-tokens (lengths in code points, token counts), inner nodes the sums.
An edit re-splits and re-encodes from the pre-token two characters before it until a boundary after it falls
on an old one; only the leaves in between change, and the sums above them. Splitting at a boundary
depends on nothing before it, and a pre-token looks at most two characters past its end, so this gives what
encoding the whole new text gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary; \\s is Unicode's White_Space, as its library has it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
LEAF, CACHE = 64, 400_000
EDITS = "array<struct<start: long, end: long, text: string>>"


class Counter:
    """Token counts of pre-tokens, remembered (the store is emptied when it is full)."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encoding.encode_ordinary(p))
            return [known[p] for p in pieces]


class Tree:
    """Leaves of pre-tokens, and sums of code points and tokens by a binary tree over them (node 1 is the root)."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        self.build(lengths, counts)

    def build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def pieces(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds this code point (the end: past the last one)."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i] and i + 1 - self.width < len(self.leaves) + self.width and self.chars[i + 1]:
                start, i = start + self.chars[i], i + 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        for k, n in enumerate(self.leaves[leaf][0]):
            if at < start + n:
                return leaf, k, start
            start += n
        return leaf, len(self.leaves[leaf][0]), start

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Puts pre-tokens in the place of those from first up to last; updates only their leaves and what is above."""
        (i, a), (j, b) = first, last
        head, tail = self.leaves[i], self.leaves[j]
        self.leaves[i] = (head[0][:a] + lengths + tail[0][b:], head[1][:a] + counts + tail[1][b:])
        for k in range(i + 1, j + 1):
            self.leaves[k] = ([], [])
        if len(self.leaves[i][0]) > 4 * LEAF:  # now and then, so that leaves stay short
            return self.build(*self.pieces())
        touched = set()
        for k in range(i, j + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.leaves[k][0]), sum(self.leaves[k][1])
            touched.add((self.width + k) // 2)
        while touched - {0}:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched if k > 1}


def edit(text: str, tree: Tree, counter: Counter, start: int, end: int, new: str) -> tuple[str, int]:
    """The text with start:end (code points, cut to the text) replaced, the tree brought up to date; how many characters were encoded."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    shift, stop = len(new) - (end - start), start + len(new)
    i, a, begin = tree.find(max(start - 2, 0))
    j, b, old = tree.find(end)  # the old boundary that is looked at, moving on as needed
    if old < end:
        old += tree.leaves[j][0][b]
        b += 1
    pieces, at = [], begin
    while True:
        if at >= stop:
            while old + shift < at:
                while b == len(tree.leaves[j][0]):
                    j, b = j + 1, 0
                old += tree.leaves[j][0][b]
                b += 1
            if old + shift == at:
                break
        m = PATTERN.match(after, at)
        pieces.append(m[0])
        at = m.end()
    tree.replace((i, a), (j, b), list(map(len, pieces)), counter.counts(pieces))
    return after, at - begin


def count_tokens(docs: DataFrame, edits: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep: bool = False, trees: str | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens, n_edits, n_tokens_after, encoded_chars), one row per row of docs.

    edits: a column of docs of type EDITS, applied in order, each to the text that the one before left; a null
    start or end counts as 0, a null text as empty; positions beyond the text are cut to it. keep adds text_after
    and tree_after (lengths and counts of pre-tokens). trees: a column with what keep returned for this text, which
    then isn't encoded again. Null and empty texts have no tokens. Repeated rows give repeated results.
    The file at vocabulary is read on the driver and sent to the executors.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    none = F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.col(edits) if edits else none).cast(EDITS).alias("edits"),
        (F.col(trees) if trees else none).cast("struct<lengths: array<int>, counts: array<int>>").alias("tree"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for part in slices(batches):
            out = []
            for i, text, changes, state in zip(*(part.column(c).to_pylist() for c in ("id", "text", "edits", "tree"))):
                encoded = 0
                if state is None:
                    pieces = PATTERN.findall(text)
                    state, encoded = {"lengths": list(map(len, pieces)), "counts": counter.counts(pieces)}, len(text)
                tree = Tree(state["lengths"], state["counts"])
                before = tree.tokens[1]
                for e in changes or ():
                    text, n = edit(text, tree, counter, e["start"] or 0, e["end"] or 0, e["text"] or "")
                    encoded += n
                row = (i, len(state["lengths"]), before, len(changes or ()), tree.tokens[1], encoded)
                out.append(row + (text, dict(zip(("lengths", "counts"), tree.pieces()))) if keep else row)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    whole = pa.list_(pa.int32())
    fields = [(n, pa.int64()) for n in ("id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "encoded_chars")]
    schema = pa.schema(fields + ([("text_after", pa.string()), ("tree_after", pa.struct([("lengths", whole), ("counts", whole)]))] if keep else []))
    ddl = ", ".join(f"{n} long" for n, _ in fields) + (", text_after string, tree_after struct<lengths: array<int>, counts: array<int>>" if keep else "")
    return rows.mapInArrow(run, ddl)
