"""Token counts that follow edits.

A document is a sequence of pre-tokens, LEAF of them to a leaf, and a segment tree over the leaves holds sums of
characters and tokens. An edit finds its place by the sums, goes back CONTEXT pre-tokens, splits and encodes the changed
text from there until a border of pre-tokens falls on an old border behind the edit, and then updates the sums of the
leaves it touched and of their ancestors; all the rest stays as it was counted.

Why that is enough: where a pre-token ends depends on at most two characters behind it, so borders two characters
before an edit hold; and splitting is memoryless, so once it meets an old border behind the edit, the old borders follow.

Trees are kept: `trees` writes them as rows (for each leaf its text, the lengths of its pre-tokens and its tokens), and
`edited` takes such a table and a table of edits, touches only the trees that have edits, encodes only what these change,
and gives the trees and counts that follow; its result is the input of the next edits.

Tokens are those of a byte-level BPE vocabulary file, with no special tokens.

Defined results: a null text counts as empty and stays so; edits beyond the end of a text are moved to its end; a null
replacement is empty; null or negative bounds are 0 and an end before its start is the start. Edits of a document apply
in turn, each to the text that those before it left. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm.common import table

LEAF, CONTEXT, REMEMBERED = 64, 3, 200_000
#: Pre-tokens of the vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counts(dict):
    """Tokens of each pre-token, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("recollex", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = len(self.encode(piece))
        return found


@functools.lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(path)


_PIECES = regex.compile(PATTERN)


class TokenTree:
    """A document whose number of tokens is known after every edit."""

    def __init__(self, text: str, counts: Counts):
        self.counts = counts
        self.encoded = 0
        self._build(_PIECES.findall(text))

    def _build(self, pieces: list[str]) -> None:
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._sum(leaves, [sum(map(self.counts.__getitem__, own)) for own in leaves])

    def _sum(self, leaves: list[list[str]], tokens: list[int]) -> None:
        """Leaves with their tokens, and the sums above them."""
        self.leaves, self.size = leaves, 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = [sum(map(len, own)) for own in leaves]
        self.tokens[self.size : self.size + len(leaves)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def dump(self) -> list[dict]:
        """The leaves, as rows of LEAVES."""
        return [{"text": "".join(own), "lengths": list(map(len, own)), "tokens": self.tokens[self.size + i]} for i, own in enumerate(self.leaves) if own]

    @classmethod
    def load(cls, leaves: list[dict], counts: Counts) -> TokenTree:
        """The tree of dumped leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counts, tree.encoded = counts, 0
        tree.leaves = []
        for leaf in leaves:
            ends = [0, *accumulate(leaf["lengths"])]
            tree.leaves.append([leaf["text"][a:b] for a, b in pairwise(ends)])
        tree._sum(tree.leaves or [[]], [leaf["tokens"] for leaf in leaves] or [0])
        return tree

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(x for own in self.leaves for x in own)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end of the text), and where it begins."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _after(self, leaf: int, place: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            own = self.leaves[leaf]
            for i in range(place, len(own)):
                yield leaf, i, own[i]
            leaf, place = leaf + 1, 0

    def _begin(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, character) of the pre-token to start from, for an edit at character `at`."""
        leaf, before = self._leaf(max(0, at - 2))
        place, own = 0, self.leaves[leaf]
        while place < len(own) and before + len(own[place]) <= max(0, at - 2):
            before += len(own[place])
            place += 1
        for _ in range(CONTEXT):
            while place == 0 and leaf:
                leaf -= 1
                place = len(self.leaves[leaf])
            if not place:
                break
            place -= 1
            before -= len(self.leaves[leaf][place])
        return leaf, place, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put replacement in the place of the characters from start to end."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        leaf, place, begin = self._begin(start)
        old, borders, reach = [], [], begin
        following, ended, more = self._after(leaf, place), False, 8
        while True:
            while not ended and (reach < end or more):
                if (step := next(following, None)) is None:
                    ended = True
                else:
                    more -= reach >= end
                    old.append(step[2])
                    reach += len(step[2])
                    borders.append((reach, step[0], step[1] + 1))
            whole = "".join(old)
            new = whole[: start - begin] + replacement + whole[end - begin :]
            shift, safe = len(replacement) - (end - start), len(new) if ended else len(new) - 3
            known = {at + shift: (a, b) for at, a, b in borders if at >= end}
            pieces, met = [], None
            for m in _PIECES.finditer(new):
                pieces.append(m[0])
                if m.end() <= safe and begin + m.end() >= start + len(replacement) and begin + m.end() in known:
                    met = known[begin + m.end()]
                    break
            if met or ended:
                break
            more = 2 * len(old)
        last, rest = met or (len(self.leaves) - 1, len(self.leaves[-1]))
        self.encoded += len(pieces)
        tail = self.leaves[last][rest:]
        own = self.leaves[leaf][:place] + pieces
        if last == leaf:
            self.leaves[leaf] = own + tail
        else:
            self.leaves[leaf], self.leaves[last] = own, tail
            self.leaves[leaf + 1 : last] = [[]] * (last - leaf - 1)
        if len(self.leaves[leaf]) > 8 * LEAF:  # grown too large: the leaves are dealt anew, no pre-token is encoded again
            self._build([x for own in self.leaves for x in own])
            return
        touched = set()
        for i in range(leaf, last + 1):
            own = self.leaves[i]
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, own)), sum(map(self.counts.__getitem__, own))
            touched.add((self.size + i) // 2)
        while touched - {0}:
            for i in touched:
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            touched = {i // 2 for i in touched} - {0}


def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = counts_of(path)
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            tree = TokenTree(batch.column(1)[i].as_py() or "", counts)
            before = (tree.n_chars, tree.n_pieces, tree.n_tokens)
            for e in batch.column(2)[i].as_py() or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
            rows.append((*before, tree.n_chars, tree.n_tokens, tree.encoded))
        values = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_chars_edited", "n_tokens_edited", "n_encoded"])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


EDITS = "array<struct<start:long,end:long,replacement:string>>"


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of each row before and after its edits: docs has doc_id, text and edits (start, end, replacement), in turn.

    n_encoded is the number of pre-tokens that the edits made anew.
    """
    path = path or default_path()
    schema = "doc_id long, n_chars long, n_pretokens long, n_tokens long, n_chars_edited long, n_tokens_edited long, n_encoded long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(EDITS))
    return rows.mapInArrow(lambda it: _counted(path, it), schema)


LEAVES = "array<struct<text:string,lengths:array<int>,tokens:long>>"
_LEAVES = pa.list_(pa.struct([("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("tokens", pa.int64())]))
TREES = f"doc_id long, n_chars long, n_tokens long, n_encoded long, leaves {LEAVES}"
#: Characters of trees that make one batch of rows.
TREE_CHARS = 4_000_000


def _trees(made: Iterator[tuple[int | None, TokenTree]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        ids, *numbers, leaves = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(leaves, _LEAVES)], ["doc_id", "n_chars", "n_tokens", "n_encoded", "leaves"])

    for doc, tree in made:
        rows.append((doc, tree.n_chars, tree.n_tokens, tree.encoded, tree.dump()))
        size += tree.n_chars
        if size >= TREE_CHARS:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The tree of each row of docs (doc_id, text), as a row that `edited` takes: doc_id, n_chars, n_tokens, n_encoded (0) and leaves."""
    path = path or default_path()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, TokenTree]]:
        counts = counts_of(path)
        for b in batches:
            for i in range(b.num_rows):
                yield b.column(0)[i].as_py(), TokenTree(b.column(1)[i].as_py() or "", counts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _trees(made(it)), TREES)


def edited(kept: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The trees that `kept`, trees with one row a doc_id, become by edits (doc_id, seq, start, end, replacement), applied in order of seq.

    Trees without edits are passed on as they are, with n_encoded 0; edits of documents that are not there, or of a null
    doc_id, change nothing.
    """
    path = path or default_path()
    step = F.struct("seq", *(F.col(c).cast("long").alias(c) for c in ("start", "end")), F.col("replacement").cast("string").alias("replacement"))
    of = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(step)).alias("edits"))
    of = of.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))))
    rows = kept.select("doc_id", "n_chars", "n_tokens", F.lit(0).cast("long").alias("n_encoded"), "leaves").join(of, "doc_id", "left")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, TokenTree]]:
        counts = counts_of(path)
        for b in batches:
            for r in b.to_pylist():
                tree = TokenTree.load(r["leaves"] or [], counts)
                for e in r["edits"]:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                yield r["doc_id"], tree

    same = rows.where("edits is null").drop("edits")
    return same.unionByName(rows.where("edits is not null").select("doc_id", "leaves", "edits").mapInArrow(lambda it: _trees(made(it)), TREES))


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits a row, at places that follow from doc_id: an insertion, a deletion and a replacement."""
    n = F.length(F.coalesce("text", F.lit("")))
    edits = []
    for i, (width, replacement) in enumerate(((0, " (revised 2024)"), (17, ""), (9, "don't stop\n\n "))):
        at = F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(n, F.lit(1)).cast("long"))
        edits.append(F.struct(at.alias("start"), (at + width).alias("end"), F.lit(replacement).alias("replacement")))
    return docs.withColumn("edits", F.array(*edits))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
