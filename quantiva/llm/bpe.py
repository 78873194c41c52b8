"""Byte-level BPE encoding and decoding by backtracking over an Aho-Corasick automaton.

Bytes are mapped to the 256 Latin-1 characters so that the automaton, which works on strings, holds the whole
vocabulary. For a pre-token all matches are read in one pass; the encoder takes the longest match at each
position and goes back to shorter ones while the token beside it is incompatible. Two adjacent tokens are
compatible if byte-pair merging of their concatenated bytes would keep the boundary between them, which is
decided by undoing their merges and memoised. The result equals that of merging by rank, in linear time.

The walk back from longest matches over adjacent-token compatibility is that of the published backtracking encoder of
the ``bpe`` crate (github.com/github/rust-gems, MIT licence).

Defined cases: nulls count as empty texts, which have no ids; repeated rows give repeated results; texts of any
length are encoded whole, one at a time; tokens of equal bytes don't exist, so nothing ties; an empty table gives an
empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: distinct pre-tokens kept with their ids in a worker's memo, and the longest that is kept (characters)
MEMO_WORDS, MEMO_CHARS = 300_000, 48
MEMO_PAIRS = 500_000


class BytePairCodec:
    """Encoder and decoder for one vocabulary of ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.size = [len(t) for t in self.vocab]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.known = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.pairs = _Pairs(self)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(len(self.vocab))]
        self.shorter = [-1] * len(self.vocab)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [k for k in range(len(token) - 1, 0, -1) if token[:k] in ranks]
            if cuts:
                self.shorter[rank] = ranks[token[: cuts[0]]]
            for k in cuts:
                left, right = ranks[token[:k]], ranks.get(token[k:], rank)
                if left < rank and right < rank and self._compatible(left, right):
                    self.parts[rank] = left, right
                    self.merged[left, right] = rank
                    break
        self.memo = _Memo(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the boundary between two adjacent tokens."""
        limit = len(self.vocab)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:  # the later merge is undone first
                limit, inner = left, self.parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    return True
                left = inner

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token whose bytes are written as Latin-1 characters."""
        whole = self.known.get(piece)
        if whole is not None:
            return [whole]
        n, size, fits = len(piece), self.size, self.pairs.__getitem__
        # Longest matches from left to right are the answer if all their neighbours are compatible.
        out = [rank for _, rank in self.automaton.iter_long(piece)]
        held = list(map(fits, pairwise(out)))
        if all(held):
            return out
        # Else go on by backtracking from the first pair that isn't.
        good = held.index(False) + 1
        token = self.shorter[out[good]]
        del out[good:]
        at = sum(map(size.__getitem__, out))
        longest = {}
        for end, rank in self.automaton.iter(piece):
            longest[end + 1 - size[rank]] = rank  # ends ascend: the last one written is the longest
        dead = bytearray(n + 1)  # positions from which no valid rest was found
        if token < 0:
            dead[at] = 1
            token = out.pop()
            at -= size[token]
        while at < n:
            while True:
                end = at + size[token]
                if not dead[end] and (not out or fits((out[-1], token))):
                    out.append(token)
                    at = end
                    token = longest[end] if end < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    dead[at] = 1
                    token = out.pop()
                    at -= size[token]
                    break
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, each match of the pattern encoded separately, as little-endian unsigned 32-bit."""
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, self.split(text))), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class _Pairs(dict):
    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= MEMO_PAIRS:
            self.clear()
        got = self[pair] = self.codec._compatible(*pair)
        return got


class _Memo(dict):
    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.codec.encode_piece(piece if piece.isascii() else piece.encode().decode("latin-1")))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[piece] = ids
        return ids


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a file, made once in each worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec.from_file(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids`` and digests of ids and of the decoded bytes.

    ``path`` is a vocabulary of base64 tokens and ranks that every worker can open (it is installed with the
    Python environment). A text that isn't reproduced by decoding its ids raises an error.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, 256):
                part = batch.slice(at, 256)
                ids, shas, backs = [], [], []
                for i in range(part.num_rows):
                    text = part.column(1)[i].as_py() or ""
                    got = c.encode(text)
                    back = c.decode(got.tolist())
                    if back != text.encode():
                        raise ValueError("decoding does not give back a text")
                    ids.append(got)
                    shas.append(hashlib.sha256(got.tobytes()).hexdigest())
                    backs.append(hashlib.sha256(back).hexdigest())
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
