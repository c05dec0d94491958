"""Byte-level BPE: encoding with a rank queue in bitmaps, and decoding."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pactline.llm.common import Batches, batch, mapped, slices, text_rows
from pactline.llm.encoding import BYTE_LEVEL_PATTERN, PieceEncoder

_LOADED: dict[tuple, RankEncoder] = {}
_TOKENS: dict[str, list[bytes | None]] = {}
_MEMO_PIECES, _KNOWN_PIECES, _PAIRS = 300_000, 30_000, 300_000  # what a worker remembers
_SLICE = 2 << 20  # bytes of text whose pieces a worker holds at once
_QUEUE_BYTES = 1 << 18  # about how many bytes of pre-tokens share a queue
_BITS = [1 << i for i in range(256)]
_END = b"\xff"  # in no UTF-8 text
_ID = struct.Struct("<I").pack


class PairRanks(dict):
    """The rank of a pair of adjacent tokens, or None; looked up in the rank table once."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: tuple[int, int]) -> int | None:
        if len(self) > _PAIRS:
            self.clear()
        first, second = pair
        ended = first < 0 or second < 0
        rank = self[pair] = None if ended else self.ranks.get(self.tokens[first] + self.tokens[second])
        return rank


class RankEncoder(PieceEncoder):
    """Encodes by a rank table: in each pre-token the adjacent pair of lowest rank is merged, the
    leftmost first, until no pair has a rank. Ids are the ranks. Texts are cut at white space only
    for the pattern that is known to allow it; with another one each text is split by the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(_MEMO_PIECES)
        self.pieced = pattern == BYTE_LEVEL_PATTERN
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: token for token, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(255)] + [-1]
        self.words_filled = [0] * ((max(ranks.values()) >> 8) + 1)
        self.known: dict[str, bytes] = {}  # pre-tokens of texts that are not cut into pieces
        self.pairs = PairRanks(ranks, self.tokens)

    def _piece(self, piece: str) -> bytes:
        (found,) = self.merged([piece.encode()])
        if len(piece) <= 40:
            if len(self.known) > _KNOWN_PIECES:
                self.known.clear()
            self.known[piece] = found
        return found

    def whole(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[p] if p in known else self._piece(p)
                         for p in self.pattern.findall(text)])

    def words(self, words: list[str], space: str) -> list[bytes]:
        return self.merged([(space + word).encode() for word in words])

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, some together, so that they share one queue."""
        whole = self.ranks.get
        found = [whole(piece) for piece in pieces]
        out = [b"" if rank is None else _ID(rank) for rank in found]
        some, held = [], 0
        for at, rank in enumerate(found):
            if rank is None:
                some.append(at)
                held += len(pieces[at])
                if held > _QUEUE_BYTES:
                    self._merge(pieces, some, out)
                    some, held = [], 0
        if some:
            self._merge(pieces, some, out)
        return out

    def _merge(self, pieces: list[bytes], places: list[int], out: list[bytes]) -> None:
        """Sets `out` at the places to the ids of the pieces there, with a constant number of queue
        entries for each byte.

        The queue has a bucket of positions for each merge rank. A bitmap in words of 256 ranks
        tells which buckets are filled, a second one which of those words are not zero; the lowest
        set bit of both gives the next rank. A position whose pair has changed meanwhile is not
        searched for in its bucket: it is skipped when its turn comes. The tokens are a doubly
        linked list over the positions. All pieces stand in one list, each with an end mark behind
        it, which no pair with a rank holds; pieces do not change one another, so the lowest rank of
        all is the lowest of its piece.
        """
        rank_of, words = self.pairs.__getitem__, self.words_filled
        data = _END.join([pieces[at] for at in places]) + _END
        ids: list[int | None] = list(map(self.single.__getitem__, data))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held = list(map(rank_of, zip(ids, ids[1:])))  # the rank of the pair that begins here
        held.append(None)
        buckets: dict[int, list[int]] = {}
        filled = 0
        for i, rank in enumerate(held):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= _BITS[rank & 255]
                    filled |= 1 << (rank >> 8)
        while filled:
            word = (filled & -filled).bit_length() - 1
            ranks = words[word]
            rank = word << 8 | (ranks & -ranks).bit_length() - 1
            words[word] = ranks = ranks & (ranks - 1)
            if not ranks:
                filled &= filled - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if held[i] != rank:
                    continue
                j = after[i]
                ids[i], ids[j], held[j] = rank, None, None
                k = after[i] = after[j]
                before[k] = i
                made = held[i] = rank_of((rank, ids[k]))
                if made is not None:
                    if made in buckets:
                        buckets[made].append(i)
                    else:
                        buckets[made] = [i]
                        words[made >> 8] |= _BITS[made & 255]
                        filled |= 1 << (made >> 8)
                h = before[i]
                if h >= 0:
                    made = held[h] = rank_of((ids[h], rank))
                    if made is not None:
                        if made in buckets:
                            buckets[made].append(h)
                        else:
                            buckets[made] = [h]
                            words[made >> 8] |= _BITS[made & 255]
                            filled |= 1 << (made >> 8)
        left = np.array([i for i in ids if i is not None], "<i4")
        ends = np.flatnonzero(left == -1) * 4
        raw = left.tobytes()
        for at, a, b in zip(places, [0, *(ends[:-1] + 4).tolist()], ends.tolist()):
            out[at] = raw[a:b]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_list(path: str) -> list[bytes | None]:
    """The bytes of each token, which is all that decoding needs, loaded once in each worker."""
    if path not in _TOKENS:
        ranks = read_ranks(path)
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _TOKENS[path] = tokens
    return _TOKENS[path]


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The encoder of a rank file, loaded once in each worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = RankEncoder(read_ranks(path), pattern)
    return _LOADED[key]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of the whole text (`ids`: little-endian unsigned 32-bit integers).

    Null texts count as empty and have no ids; doc_id is passed through, also null or repeated; an
    empty table gives an empty one. The rank file must be a path that the executors can read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def task(batches: Batches) -> Batches:
        tool = rank_encoder(path, pattern)
        for some in slices(batches, _SLICE):
            yield batch(schema, some.column(0), tool.encode(some.column(1).to_pylist()))

    return mapped(text_rows(docs), task, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the text's bytes (`decoded`) of encoded rows; null ids give null. Decoding
    needs the tokens only, whatever the `pattern` was."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def task(batches: Batches) -> Batches:
        token = token_list(path).__getitem__
        for some in slices(batches):
            ids = some.column(1).to_pylist()
            yield batch(schema, some.column(0), some.column(1),
                        [None if i is None else b"".join(map(token, memoryview(i).cast("I"))) for i in ids])

    return mapped(encoded.select("doc_id", "ids"), task, "doc_id long, ids binary, decoded binary")
