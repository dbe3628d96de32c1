"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding of a word is fixed by the last token of each of its prefixes: dropping the last token of a valid
encoding leaves the encoding of a shorter prefix, and a sequence of tokens is the encoding of its text if and only if
every two neighbours are the encoding of theirs. So the distinct words of a slice of texts are put in order, which is
the depth-first order of their trie, and the last-token state of every prefix is computed once and shared by all words
that begin with it. The word's end is a symbol of its own, as the merges have it.

Pre-tokens, normalisation, special tokens in texts and ids are those of the tokenizer file (BPE with word ends, lower
case, NFC); the decoded text is the tokens joined by one space, as that file has no decoder. Vocabulary files are read
from `path`, never trained.

Defined results: null and empty texts have no tokens, and their decoded text is empty. Repeated rows give repeated
rows. Other columns are ignored. A text is never cut: a word as long as the text is one pass over its letters.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import kernels
from recollex.llm.common import table

#: Texts (in characters) whose new words share one traversal, and bytes of what a task remembers of chunks (white-space-free
#: parts of texts): one generation of that size is in use, the one before it is looked up and then forgotten.
SLICE_CHARS = 1_000_000
REMEMBERED_BYTES = 24_000_000
#: Entries of what a task remembers of neighbours judged and of steps of the automaton; and of the edges of tokens, on each side.
JUDGED, EDGES = 200_000, 10_000
_END = 256
_SPACES = regex.compile(r"\p{White_Space}+")
_CONTROLS = regex.compile("[\x1c-\x1f]")
#: The pre-tokens of the file: fixed values.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Tokenizer:
    """The vocabulary and merges of a file, with the test of neighbours that the traversal asks for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        bpe = model["model"]
        self.end = bpe["end_of_word_suffix"] or ""
        vocab: dict[str, int] = bpe["vocab"]
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.byte_of = {x: b for b, x in enumerate(byte_letters())}
        top = max(text) + 1
        self.ranks: dict[int, int] = {}  # of a merge, by its two tokens
        self.parts = (array("i", [-1]) * top, array("i", [-1]) * top)  # of each token, -1 if no merge makes it
        self.rank = array("i", [-1]) * top  # of the merge that makes it
        for rank, pair in enumerate(bpe["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            self.ranks.setdefault(a << 20 | b, rank)
            if self.rank[whole] < 0:
                self.parts[0][whole], self.parts[1][whole], self.rank[whole] = a, b, rank
        self.length, self.shown, self.decimal = [0] * top, [text.get(i, "") for i in range(top)], [str(i) for i in range(top)]
        self.steps: dict[int, int] = {}
        self.token_at = [-1]
        self._fail = array("i", [0])
        above, depth = array("i", [0]), [0]
        if not self.end:
            raise ValueError("the vocabulary has no suffix for word ends")
        specials = set(self.specials.values())
        for t, i in vocab.items():
            if i not in specials:
                self._enter(t, i, above, depth)
        self.out = [-1] * len(depth)
        self._link(above, depth)
        self._next: dict[int, int] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._whole: dict[int, bool] = {}
        self._beside: dict[int, bool] = {}

    def forget(self) -> None:
        """Keep the vocabulary only; what is worked out again is the same."""
        for held in (self._next, self._right, self._left, self._whole, self._beside):
            held.clear()

    def _enter(self, token: str, i: int, above: array, depth: list[int]) -> None:
        """Into the trie of tokens, a word's end being a letter of its own; above: the step (node, letter) that leads to each node."""
        ends = token.endswith(self.end)
        raw = [self.byte_of[c] for c in (token.removesuffix(self.end) if ends else token)]
        self.length[i] = len(raw)
        node = 0
        for b in [*raw, _END] if ends else raw:
            key = node << 9 | b
            node = self.steps.setdefault(key, len(self.token_at))
            if node == len(self.token_at):
                self.token_at.append(-1)
                above.append(key)
                depth.append(depth[key >> 9] + 1)
        self.token_at[node] = i

    def _link(self, above: array, depth: list[int]) -> None:
        """For each node, the longest proper suffix that is a node, and the longest that is a token (out), -1 if none."""
        self._fail = array("i", bytes(4 * len(depth)))
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            key = above[node]
            fail = self._fail[node] = self.step(self._fail[key >> 9], key & 511) if key >> 9 else 0
            self.out[node] = fail if self.token_at[fail] >= 0 else self.out[fail]

    def step(self, node: int, letter: int) -> int:
        """The node of the longest suffix, within the trie, of a node's text and one more letter."""
        while (to := self.steps.get(node << 9 | letter)) is None:
            if not node:
                return 0
            node = self._fail[node]
        return to

    def _edge(self, token: int, side: int, held: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of token while it is put together, each with the rank that ends it."""
        found = held.get(token)
        if found is None:
            found, at, until = [], token, _NEVER
            while at >= 0:
                found.append((at, until))
                until, at = self.rank[at], self.parts[side][at]
            found.reverse()
            if len(held) >= EDGES:
                held.clear()
            held[token] = found
        return found

    def _untouched(self, a: int, b: int, until: int) -> bool:
        """Whether no merge below rank `until` reaches across the border of a and b while both are put together."""
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            rank = self.ranks.get(x << 20 | y)
            if rank is not None and rank < x_end and rank <= y_end and rank < until:
                return False
            if x_end <= y_end:
                if x_end == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def is_whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            a, b, rank = self.parts[0][token], self.parts[1][token], self.rank[token]
            known = rank < 0 or (self.is_whole(a) and self.is_whole(b) and self._untouched(a, b, rank))
            self._whole[token] = known
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether the text of a and b together is encoded as a, b."""
        return self.is_whole(b) and self._untouched(a, b, _NEVER)

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word: one walk over the trie of the words, depth first.

        A state is the last token of the encoding of a prefix, the word going on, and the node of the tokens' automaton
        that tells which tokens end there. A prefix that words share is walked once.
        """
        follow, token_at, out, length, beside = self._next, self.token_at, self.out, self.length, self._beside
        for held in (follow, beside):
            if len(held) > JUDGED:
                held.clear()
        found: dict[bytes, list[int]] = {b"": []}
        last, nodes, before = [0], [0], b""
        for word in sorted(set(words)):
            n = len(word)
            if not n:
                continue
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            at, node, token = shared, nodes[shared], 0
            while at < n:
                key = node << 9 | word[at]
                if (to := follow.get(key)) is None:
                    to = follow[key] = self.step(node, word[at])
                node = to
                at += 1
                if at == n:
                    key = node << 9 | _END
                    if (to := follow.get(key)) is None:
                        to = follow[key] = self.step(node, _END)
                place = to if token_at[to] >= 0 else out[to]
                while place >= 0:
                    token = token_at[place]
                    start = at - length[token]
                    if not start:
                        if self.is_whole(token):
                            break
                    else:
                        key = last[start] << 20 | token
                        if (good := beside.get(key)) is None:
                            good = beside[key] = self.beside(last[start], token)
                        if good:
                            break
                    place = out[place]
                else:
                    raise ValueError(f"the vocabulary has no token for the end of {word[:at]!r}")
                if at < n:
                    last.append(token)
                    nodes.append(node)
            ids, at = [token], n - length[token]
            while at:
                ids.append(last[at])
                at -= length[ids[-1]]
            ids.reverse()
            found[word] = ids
            before = word
        return found

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # a capital sigma has one small form here, wherever it stands

    def pieces(self, text: str) -> Iterator[str | int]:
        """Texts between special tokens, and the ids of these."""
        if self.special is None or not any(x in text for x in self.specials):
            yield text
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.specials[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.shown[i] for i in ids])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def chunks(text: str) -> Iterator[list[str]]:
    """The parts of a normal text that hold no white space, some at a time; no pre-token reaches over white space."""
    if len(text) <= SLICE_CHARS:
        yield [c for c in _SPACES.split(text) if c] if _CONTROLS.search(text) else text.split()
        return
    each = (m[0] for m in regex.finditer(r"\P{White_Space}+", text))
    while part := list(islice(each, 100_000)):
        yield part


#: What is known of a chunk: the bytes of its ids (32 bits each) and its decoded text; with digests, how many ids, these in decimal and its decoded text.
Known = tuple[bytes, str] | tuple[int, str, str]


class Encoder:
    """Encodes texts and remembers chunks; what it remembers is bounded in bytes and never changes a result."""

    def __init__(self, path: str, digests: bool = False):
        self.tokenizer, self.digests = tokenizer(path), digests
        self.young: dict[str, Known] = {}
        self.old: dict[str, Known] = {}
        self.size = 0

    def learn(self, some: Iterable[str]) -> None:
        """After it every one of the distinct chunks is in `young`."""
        if self.size > REMEMBERED_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        t, young, old, digests = self.tokenizer, self.young, self.old, self.digests
        split: dict[str, list[bytes]] = {}
        size = 0
        for c in some:
            if c in young:
                continue
            if (known := old.get(c)) is not None:
                young[c] = known
                size += 250 + len(c) + sum(map(len, known[1:]))
            else:
                split[c] = [c.encode()] if c.isalpha() and c.isascii() else [w.encode() for w in _WORDS.findall(c)]
        shown, decimal = t.shown, t.decimal
        ids = t.encode_words([w for words in split.values() for w in words])
        for c, words in split.items():
            own = ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]]
            text = " ".join([shown[i] for i in own])
            known = young[c] = (len(own), " ".join([decimal[i] for i in own]), text) if digests else (array("i", own).tobytes(), text)
            size += 250 + len(c) + len(text) + len(known[0 if not digests else 1])
        self.size += size

    def split(self, text: str) -> Iterator[list[str] | int]:
        """The chunks of a text, some at a time, and the ids of its special tokens."""
        for piece in self.tokenizer.pieces(text):
            if isinstance(piece, int):
                yield piece
            else:
                yield from chunks(self.tokenizer.normal(piece))

    def parts(self, split: Iterable[list[str] | int]) -> Iterator[list[Known]]:
        """What is known of the chunks and special tokens of a text that split() has made, some at a time, none of them empty."""
        t = self.tokenizer
        for some in split:
            if isinstance(some, int):
                yield [(1, str(some), t.shown[some]) if self.digests else (array("i", [some]).tobytes(), t.shown[some])]
            elif some:
                if not all(map(self.young.__contains__, some)):
                    self.learn(set(some))
                yield list(map(self.young.__getitem__, some))

    def digest(self, split: Iterable[list[str] | int]) -> tuple[int, str, str]:
        """How many ids a text has, and the digests of these and of its decoded text."""
        n, a, b = 0, hashlib.sha256(), hashlib.sha256()
        for parts in self.parts(split):
            counts, ids, shown = zip(*parts, strict=True)
            gap = " " if n else ""
            n += sum(counts)
            a.update((gap + " ".join(ids)).encode())
            b.update((gap + " ".join(shown)).encode())
        return n, a.hexdigest(), b.hexdigest()

    def whole(self, split: Iterable[list[str] | int]) -> tuple[bytes, str]:
        """The ids of a text, 32 bits each, and its decoded text."""
        ids, shown = [], []
        for parts in self.parts(split):
            own, text = zip(*parts, strict=True)
            ids.append(b"".join(own))
            shown.append(" ".join(text))
        return b"".join(ids), " ".join(shown)


def _rows(encoder: Encoder, ids: pa.Array, splits: list[Iterable[list[str] | int]]) -> pa.RecordBatch:
    names = ["doc_id", "n_tokens"]
    if encoder.digests:
        counts, a, b = zip(*map(encoder.digest, splits), strict=True)
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [*names, "ids_sha256", "decoded_sha256"])
    own, decoded = zip(*map(encoder.whole, splits), strict=True)
    counts = np.array([len(x) // 4 for x in own], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(own), np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())], [*names, "ids", "decoded"])


def _encoded(path: str, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, digests)  # ends with the task, as all that the tokenizer has remembered: a worker that waits for its next one holds only the vocabulary
    try:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                splits, size, to = [], 0, at
                while to < batch.num_rows and (to == at or size < SLICE_CHARS):
                    text = batch.column(1)[to].as_py() or ""
                    size += len(text)
                    splits.append(list(encoder.split(text)) if len(text) <= SLICE_CHARS else encoder.split(text))
                    to += 1
                encoder.learn({c for x in splits if isinstance(x, list) for some in x if isinstance(some, list) for c in some})  # one trie for the slice
                yield _rows(encoder, batch.column(0).slice(at, to - at), splits)
                at = to
    finally:
        encoder.tokenizer.forget()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded for each row; with digests, ids_sha256 and decoded_sha256 in their place."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: kernels.tidy(_encoded(path, digests, it)), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
