"""BPE encoding and decoding through a pair occurrence index.

The distinct words of a batch are laid out as one symbol array. An index maps
every mergeable pair to all its positions in the batch. Active ranks are
applied in ascending order, each to all its positions at once, and the lists
of the pairs that a merge creates are extended. So one merge rule costs a few
array operations however many words hold it.

Defined results: a null text counts as empty (no ids, empty decoded text);
repeated rows, null ids and extra columns change nothing; the text of a special
token is that token.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwave.llm.common import kept_in_worker, on_batches, pieces_of, slices

# Characters of one batch slice; bounds the memory of a task.
_SLICE = 12_000_000
# Below this code point Unicode classes and case mapping have been fixed for
# decades, and nothing composes. Pieces with later characters are normalised
# and cut by the tokenizer's own components.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairTable:
    """Merge rules as sorted arrays: pair -> rank, rank -> pair and new symbol."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.none = len(merges)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where no rule has it."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)


class PairIndex:
    """Positions of every mergeable pair of a symbol array."""

    def __init__(self, table: PairTable, symbols: np.ndarray, starts: np.ndarray):
        n = len(symbols)
        self.table, self.symbol = table, symbols.astype(np.int64)
        # The last slot stands for "no neighbour"; its symbol is in no pair.
        self.symbol = np.append(self.symbol, -1)
        self.next, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.next[-1] = self.before[0] = n
        ends = np.append(starts[1:], n) - 1
        self.next[ends], self.before[starts] = n, n
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._extend(np.flatnonzero(self.next[:-1] < n))

    def _extend(self, at: np.ndarray) -> None:
        """Enter the pairs that begin at ``at`` into the index."""
        rank = self.table.rank(self.symbol[at], self.symbol[self.next[at]])
        known = rank < self.table.none
        if not known.any():
            return
        at, rank = at[known], rank[known]
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(rank)]
        for value, begin, end in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
            held = self.lists.get(value)
            if held is None:
                self.lists[value] = [at[begin:end]]
                heapq.heappush(self.active, value)
            else:
                held.append(at[begin:end])

    def apply(self) -> np.ndarray:
        """Merge until no rank is active; returns a mask of the symbols that are left."""
        symbol, after, before, table = self.symbol, self.next, self.before, self.table
        nowhere = len(symbol) - 1
        while self.active:
            rank = heapq.heappop(self.active)
            held = self.lists.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            left, right, made = table.left[rank], table.right[rank], table.made[rank]
            second = after[at]
            # Entries whose symbols were merged meanwhile are stale.
            fresh = (symbol[at] == left) & (symbol[second] == right)
            if not fresh.all():
                at, second = at[fresh], second[fresh]
            if not len(at):
                continue
            if left == right and len(at) > 1:
                at = np.unique(at)
                at = _every_other(at, after)
                second = after[at]
            symbol[at], symbol[second] = made, -1
            third = after[second]
            after[at] = third
            before[third] = at
            before[nowhere] = nowhere
            first = before[at]
            self._extend(np.concatenate([first[first < nowhere], at[third < nowhere]]))
        return symbol[:-1] >= 0


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, keep the first, third, ... of each run."""
    follows = np.append(False, after[at[:-1]] == at[1:])
    begins = np.flatnonzero(~follows)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return at[place % 2 == 0]


class WordCoder:
    """Encodes and decodes with a vocabulary that marks word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.table = PairTable(spec)
        self.library = Tokenizer.from_str(text)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int64)
        size = max(max(vocab.values()), *[t["id"] for t in spec["added_tokens"]]) + 1
        self.token = [""] * size
        for token, i in vocab.items():
            self.token[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token[i] = token
        self.decimal = [str(i) for i in range(size)]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.standin = {c: b for b, c in enumerate(letters)}

    def cut(self, piece: str) -> list[bytes]:
        """The normalised words of a piece that holds no blank."""
        if piece.isascii() or _PLAIN(piece):
            if piece.isalpha():
                return [piece.lower().encode()]
            if piece[:-1].isalpha() and piece[-1] in ".,:;!?":
                return [piece[:-1].lower().encode(), piece[-1].encode()]
            return [w.encode() for w in self.words.findall(piece.lower())]
        normal = self.library.normalizer.normalize_str(piece)
        return [bytes(map(self.standin.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in one array, and where each word's ids begin (with the end)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        symbols = self.inner[raw]
        lasts = starts + sizes - 1
        symbols[lasts] = self.final[raw[lasts]]
        index = PairIndex(self.table, symbols, starts)
        left = index.apply()
        counts = np.add.reduceat(left.astype(np.int64), starts)
        return index.symbol[:-1][left], np.append(0, np.cumsum(counts))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Per text its ids (decimals joined by blanks), its tokens (the same way) and their number.

        Blanks are dropped by this kind of vocabulary, so a text is the
        concatenation of its pieces between blanks and each distinct piece is
        coded once. Special tokens are made pieces of their own.
        """
        for token in self.special:
            if pc.any(pc.match_substring(texts, token)).as_py():
                texts = pc.replace_substring(texts, token, f" {token} ")
        codes, bounds, distinct = pieces_of(texts)
        parts = distinct.to_pylist()
        words: dict[bytes, int] = {}
        place = words.setdefault
        cut = [[] if p in self.special else [place(w, len(words)) for w in self.cut(p)] for p in parts]
        ids, at = self.ids_of_words(list(words))
        sizes, at = np.diff(at).tolist(), at.tolist()
        counts = np.fromiter((sum([sizes[w] for w in held]) for held in cut), np.int64, len(cut))
        ids, spans = ids.tolist(), list(map(slice, at, at[1:]))
        coded = []
        for names in (self.decimal, self.token):
            shown = list(map(names.__getitem__, ids))
            word = list(map(" ".join, map(shown.__getitem__, spans)))
            coded.append([word[h[0]] if len(h) == 1 else " ".join([word[w] for w in h]) for h in cut])
        for i, piece in enumerate(parts):
            if piece in self.special:
                coded[0][i], coded[1][i], counts[i] = str(self.special[piece]), piece, 1
        # Pieces without ids (repeated blanks) must not leave a separator.
        kept = counts[codes] > 0
        codes, bounds = codes[kept], np.append(0, np.cumsum(kept))[bounds]
        totals = np.append(0, np.cumsum(counts[codes]))[bounds]
        joined = [
            pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, pa.string()).take(pa.array(codes))), " ")
            for c in coded
        ]
        return joined[0], joined[1], np.diff(totals)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode it again.

    Returns ``id_col``, ``ids`` (decimal ids joined by one blank), ``decoded``
    and ``n_tokens``. ``tokenizer`` is the path of a tokenizer file with word
    ends; it is read once by the driver and sent to the tasks (a few MB).
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        coder = kept_in_worker(("words", tokenizer), lambda: WordCoder(spec.value))
        texts = batch.column(1).cast(pa.string()).fill_null("")
        for rows in slices(texts, _SLICE):
            ids, decoded, n_tokens = coder.encode(texts[rows.start : rows.stop])
            yield [batch.column(0)[rows.start : rows.stop], ids, decoded, pa.array(n_tokens)]

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(picked.dtypes)["_id"]
    return on_batches(picked, run, f"_id {kind}, ids string, decoded string, n_tokens bigint").withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SHA-256 of ids and decoded text."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
