"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and backtracking.

The bytes of a piece become Latin-1 characters, over which pyahocorasick finds the longest token at a position.
A token sequence equals the result of the merges exactly if each pair of neighbours does, so encoding walks from
longest matches back to shorter ones until all neighbours are compatible; what merging makes of a pair is
memoised. No position is tried twice, which bounds the work by the length of the piece.

Defined results: null and empty texts have no ids, and decode to nothing; a document of any length is encoded whole;
repeated rows get equal results; other columns never matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees

#: Bounds on what a worker remembers: bytes of words and their ids in each of the two generations of a memo, and pairs
#: of tokens. What is forgotten is computed again, never wrong.
WORD_BYTES, PAIRS = 40 << 20, 300_000
#: Tokens of one batch of output, but for a single longer document; rows that are turned into Python strings at once.
BATCH_TOKENS, ROWS = 1 << 18, 256


class Codec:
    """Encoder and decoder for one file of ranks (token in base64, rank) and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.token = {rank: token for token, rank in ranks.items()}
        self.text = {str(rank): token for rank, token in self.token.items()}
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.find = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.find.add_word(token, (token, len(token) - 1))
        self.find.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.prefixes: dict[str, tuple[str, ...]] = {}
        self.split_of: dict[str, tuple[str, str] | None] = {}
        self.after_space, self.after_line, self.line = _Memo(self, " "), _Memo(self, ""), str(self.rank["\n"])

    def merge(self, piece: str) -> list[str]:
        """The merges themselves, lowest rank first and leftmost among equals; for short strings only."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes this one; the token twice if it is a single byte; None if merging never makes it."""
        if token not in self.split_of:
            if len(token) == 1:
                both = token, token
            else:
                own = self.rank.pop(token)
                parts = self.merge(token)
                self.rank[token] = own
                both = tuple(parts) if len(parts) == 2 else None
            self.split_of[token] = both
        return self.split_of[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves two tokens as they are when they stand side by side.

        It undoes their merges, the latest first, and asks each time whether what then touches would have been
        merged earlier; of two merges of one rank the left one comes first.
        """
        rank, limit = self.rank, 1 << 60
        while True:
            if rank.get(left + right, 1 << 60) < limit:
                return False
            a, b = rank[left], rank[right]
            if len(left) > 1 and (a > b or len(right) == 1):
                limit, left = a, self.halves(left)[1]
            elif len(right) > 1:
                limit, right = b + 1, self.halves(right)[0]
            else:
                return True

    def tries(self, token: str) -> tuple[str, ...]:
        """A token and the tokens that are prefixes of it, the longest first; only those that merging can make."""
        if token not in self.prefixes:
            self.prefixes[token] = tuple(t for n in range(len(token), 0, -1) if (t := token[:n]) in self.rank and self.halves(t))
        return self.prefixes[token]

    def compatible(self, left: str, token: str) -> bool:
        """fits(), memoised."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.pairs.setdefault(left, {})[token] = not left or self.fits(left, token)
        return ok

    def piece(self, piece: str) -> list[str]:
        """Tokens of one piece of Latin-1 characters."""
        if piece in self.rank:
            return [piece]
        tokens: list[str] = []
        open_, pairs, n = bytearray(b"\x01") * (len(piece) + 1), self.pairs, len(piece)
        longest = [""] * n  # token that begins there: of those the automaton reports, the last one ends last
        for end, (token, more) in self.find.iter(piece):
            longest[end - more] = token
        left, at = "", 0
        start = longest[0]
        while at < n:
            row = pairs.get(left) or _NONE
            for token in self.prefixes.get(start) or self.tries(start):
                if (ok := row.get(token)) is None:
                    ok = self.compatible(left, token)
                if ok and open_[at + len(token)]:
                    tokens.append(token)
                    at += len(token)
                    left = token
                    if at < n:
                        start = longest[at]
                    break
            else:
                if not tokens:
                    raise ValueError("a byte of the text is no token")
                open_[at] = 0
                start = tokens.pop()
                at -= len(start)
                left = tokens[-1] if tokens else ""
        return tokens

    def ids(self, text: str | None) -> str:
        """Decimal ids of a whole text, joined by commas.

        A piece never goes on over a boundary from something else to white space, so the text may be cut there
        first: at line ends and spaces, if no other white space is next to them, else the pattern runs over all of it.
        """
        if not text:
            return ""
        out, first, rest = [], self.after_line, self.after_space.__getitem__
        try:
            for line in text.split("\n"):
                word, *more = line.split(" ")
                out.append(",".join([first[word], *map(rest, more)]) if more else first[word])
        except _Space:
            return self.plain(text)
        return f",{self.line},".join(out)

    def plain(self, text: str) -> str:
        rank, piece = self.rank, self.piece
        return ",".join([str(rank[t]) for p in self.split(text) for t in piece(p.encode().decode("latin-1"))])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.split(","))) if ids else b""


#: Marks of one byte that are a piece of their own after letters.
_ENDS = frozenset(",.;:!?)")


_NONE: dict[str, bool] = {}


class _Space(Exception):
    """There is white space beside white space."""


class _Memo(dict):
    """Ids of what stands before a word and the word, by the word. A full generation takes the place of the older one,
    whose words move on when they are met again."""

    def __init__(self, codec: Codec, before: str):
        super().__init__()
        self.codec, self.before, self.older, self.bytes = codec, before, {}, 0

    def __missing__(self, word: str) -> str:
        if (ids := self.older.get(word)) is None:
            ids = self.ids(word)
        if len(word) < 64:
            self.bytes += 200 + len(word) + len(ids)
            if self.bytes > WORD_BYTES:
                self.older, self.bytes = dict(self), 0
                self.clear()
            self[word] = ids
        return ids

    def ids(self, word: str) -> str:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Space
        own = self.codec
        if word.isalpha():
            rank = own.rank
            return ",".join([str(rank[t]) for t in own.piece((self.before + word).encode().decode("latin-1"))])
        if word[-1] in _ENDS and word[:-1].isalpha():  # two pieces
            return f"{self[word[:-1]]},{own.rank[word[-1]]}"
        return own.plain(self.before + word)


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, kept between tasks."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(column: pa.Array):
    """The texts of a column, a few at a time as Python strings."""
    for i in range(0, len(column), ROWS):
        yield from column.slice(i, ROWS).to_pylist()


@frees
def _digests(path: str, pattern: str, batches):
    own = codec(path, pattern)
    for b in batches:
        n, of_ids, of_text = [], [], []
        for text in _texts(b.column("text")):
            ids = own.ids(text)
            n.append(ids.count(",") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
            of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        functools.partial(_digests, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


@frees
def _encoded(path: str, pattern: str, batches):
    own = codec(path, pattern)
    for b in batches:
        first, ids, n = 0, [], 0
        for i, text in enumerate(_texts(b.column("text")), 1):
            ids.append(np.fromstring(x, np.int32, sep=",") if (x := own.ids(text)) else np.zeros(0, np.int32))
            n += len(ids[-1])
            if n >= BATCH_TOKENS or i == b.num_rows:
                offsets = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(ids)), pa.array(np.diff(offsets).astype(np.int64)), lists], ["doc_id", "n_tokens", "ids"])
                first, ids, n = i, [], 0


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_encoded, path, pattern), "doc_id long, n_tokens long, ids array<int>")


@frees
def _decoded(path: str, pattern: str, batches):
    own = codec(path, pattern)
    for b in batches:
        data = [b"".join([own.token[i] for i in ids or []]) for ids in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of encode(): doc_id and the bytes of its ids."""
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decoded, path, pattern), "doc_id long, data binary")
