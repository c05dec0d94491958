"""Whole texts to token ids with the tokenizers library, remembering the ids of words."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pactline.llm.common import MEMORIES

_LOADED: dict[tuple, TextEncoder] = {}
MEMORIES["tokens"] = _LOADED.clear
# What a worker remembers; less for word tokenizers, which share their workers with other stages.
_MEMO_PIECES, _MEMO_FOLDED = 500_000, 200_000
# White space beside white space: what `\s` means in Python, written out for Arrow.
_WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
_BLANKS = " \t\n\r"
_BETWEEN = "."  # stands between words of letters where many are encoded at once
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
_ALPHANUMERIC = np.array([b < 128 and chr(b).isalnum() for b in range(256)])  # by byte
# Byte-level tokenizers show a byte as the character of that number if it is printable, and the
# others, in order, as the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
# The letters of _LETTERS, and Ⱥ and Ⱦ in lower case.
_VISIBLE = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in [*range(0xC0, 0x250), 0x2C65, 0x2C66]}


# How a tokenizer must cut a text into pre-tokens so that cuts at white space are safe.
# The pattern of byte-level tokenizers, their settings, and those of the lower-casing word tokenizer.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                     {"type": "Lowercase"}]
_WORD_PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {**_BYTE_LEVEL, "use_regex": False}]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, at least one, and where each text begins and the last one ends."""
    _, ends, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return raw, np.frombuffer(ends, np.int64)[:len(texts) + 1]


def _parted(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Pieces without the ASCII marks that end them, if these follow a letter or digit, and the marks."""
    stems = pc.utf8_rtrim(pieces, string.punctuation)
    (raw, ends), (held, stops) = _bytes(pieces), _bytes(stems)
    sizes, stops = np.diff(stops), stops[1:]
    last, second = (held[np.maximum(stops - back, 0)] for back in (1, 2))
    # U+00C0 to U+023F are two bytes each, and letters but for the signs of times and division. İ is
    # left out: in lower case it ends with a combining dot, which goes with the marks.
    latin = (sizes > 1) & (second >= 0xC3) & (second <= 0xC8) & (last >> 6 == 2)
    latin &= (second != 0xC3) | (last != 0x97) & (last != 0xB7)
    latin &= (second != 0xC4) | (last != 0xB0)
    cut = (sizes > 0) & (_ALPHANUMERIC[last] | latin)
    lengths = np.where(cut, np.diff(ends) - sizes, 0)
    starts = np.append(0, np.cumsum(lengths))
    marks = raw[np.repeat(ends[1:] - starts[1:], lengths) + np.arange(starts[-1])]
    return (pc.if_else(pa.array(cut), stems, pieces),
            pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(starts), pa.py_buffer(marks)))


class PieceEncoder:
    """Ids of whole texts, put together from those of pieces between spaces.

    A text is cut in front of spaces and line ends where byte-level tokenizers end a pre-token as
    well: at white space between two characters that are none. So the ids of a text are those of
    its pieces, one after the other. A piece is named by what follows the space, or by its line end
    and what follows; ASCII marks at its end, after a letter or digit, are a pre-token of their own and
    go by themselves. Arrow splits the texts of a call, numbers their distinct pieces, cuts the marks off,
    numbers what is left and puts the ids together, so Python handles each distinct piece once. The
    ids of pieces are remembered; when there are `limit` of them, a new memory is begun and what is
    still used moves over from the old one. Latin letters are one pre-token, so `words` alone encodes
    most pieces; `together` encodes the others, and `whole` texts with white space beside white space.
    The same goes for all texts of a tokenizer that is not known to end pre-tokens there (`pieced` is
    false).

    Memory: at most `limit` pieces a generation, and pieces and ids of about `held_bytes`.
    """

    line = " \n"  # what a line end becomes before the text is cut at spaces
    pieced = True
    held_bytes = 32 << 20

    def __init__(self, limit: int = _MEMO_PIECES):
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.held = limit, 0
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The ids of any text."""
        raise NotImplementedError

    def words(self, words: list[str], space: str) -> list[bytes]:
        """The ids of each word of Latin letters with a space (or nothing) in front."""
        raise NotImplementedError

    def together(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        return [self.whole(piece if piece[0] == "\n" else " " + piece) for piece in pieces]

    def odd(self, texts: list[str]) -> list[bool]:
        """Which texts may not be cut."""
        return pc.match_substring_regex(pa.array(texts, pa.large_string()), _WHITE).to_pylist()

    def folded(self, text: str) -> str:
        return text

    def mark(self, mark: str) -> bytes:
        """The ids of a text that may come often: punctuation, line ends, first words."""
        ids = self.marks.get(mark)
        if ids is None:
            ids = self.whole(mark)
            if len(mark) <= 40 and len(self.marks) < self.limit // 4:
                self.marks[mark] = ids
        return ids

    def _learn(self, pieces: list[str]) -> None:
        memo, old, others = self.memo, self.old, []
        fresh: dict[str, list[str]] = {"": [], "\n": []}  # words after a space, after a line end
        self.held += 2 * sum(map(len, pieces))  # ids take about as much as their piece
        for piece in pieces:
            ids = old.get(piece)
            if ids is not None:
                memo[piece] = ids
            elif piece.isascii() and piece.isalpha():
                fresh[""].append(piece)
            elif _LETTERS(piece):
                fresh[""].append(piece)
            elif piece[0] == "\n" and _LETTERS(piece, 1):
                fresh["\n"].append(piece[1:])
            else:
                others.append(piece)
        for first, words in fresh.items():
            lead = self.mark(first) if first and words else b""
            for word, ids in zip(words, self.words(words, "" if first else " ")):
                memo[first + word] = lead + ids
        memo.update(zip(others, self.together(others)))

    def _joined(self, bodies: list[str]) -> Iterator[bytes | memoryview]:
        """The ids of each text, which is cut at its spaces (an empty one has none)."""
        if not bodies:
            return iter(())
        cut = pc.split_pattern(pa.array(bodies, pa.large_string()), " ")
        numbered = cut.flatten().dictionary_encode()
        stems, marks = _parted(numbered.dictionary)
        names, marks = stems.dictionary_encode(), marks.dictionary_encode()
        pieces = names.dictionary.to_numpy(zero_copy_only=False).tolist()
        memo = self.memo
        found = [b"" if piece == "" else memo.get(piece) for piece in pieces]
        new = [piece for piece, ids in zip(pieces, found) if ids is None]
        if new:
            self._learn(new)
            found = [memo[piece] if ids is None else ids for piece, ids in zip(pieces, found)]
        ids = pa.array(found, pa.large_binary()).take(names.indices)
        endings = [self.mark(mark) if mark else b"" for mark in marks.dictionary.to_pylist()]
        if any(endings):
            endings = pa.array(endings, pa.large_binary()).take(marks.indices)
            ids = pc.binary_join_element_wise(ids, endings, pa.scalar(b"", pa.large_binary()))
        ids = ids.take(numbered.indices)
        _, ends, data = ids.buffers()
        if data is None:
            return iter([b""] * len(bodies))
        places = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data)
        return (data[a:b] for a, b in zip(places, places[1:]))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; of null: none."""
        if not self.pieced:
            return [self.whole(text) if text else b"" for text in texts]
        if len(self.memo) > self.limit or self.held > self.held_bytes:
            # A generation that one set of very long pieces has filled is not worth keeping.
            self.old = self.memo if self.held <= 2 * self.held_bytes else {}
            self.memo, self.held = {}, 0
            self.marks.clear()
        texts = [self.folded(text) if text else text for text in texts]
        stripped = [text.strip(_BLANKS) if text else "" for text in texts]
        # A text begins like a line, whose line end is left out again. White space in front may belong
        # to the first word, so both are encoded together, unless line ends have no ids at all.
        begin = self.line.strip(" ")
        skipped = len(self.mark(begin)) if begin else 0
        cuts, bodies = [], []
        for text, body, odd in zip(texts, stripped, self.odd(stripped)):
            tail = text[len(text.rstrip(_BLANKS)):] if body else ""
            if not body or odd or tail and body[-1].isspace():
                cuts.append(None)
                continue
            if not begin or text[0] == body[0] and not body[0].isspace():
                cuts.append((b"", skipped, tail))
                bodies.append(begin + body.replace("\n", self.line))
            else:
                first, _, rest = body.replace("\n", self.line).partition(" ")
                cuts.append((self.mark(text[:text.index(body[0])] + first), 0, tail))
                bodies.append(rest)
        joined, out = self._joined(bodies), []
        for text, cut in zip(texts, cuts):
            if not text:
                out.append(b"")
            elif cut is None:
                out.append(self.whole(text))
            else:
                first, start, tail = cut
                out.append(b"".join((first, next(joined)[start:], self.mark(tail) if tail else b"")))
        return out


class TextEncoder(PieceEncoder):
    """Ids equal to `Tokenizer.encode(text, add_special_tokens=False).ids` of the tokenizers library.

    Texts are cut only if the file's settings are the known ones (see above). Words of Latin letters
    are encoded by the tokenizer's model, many in one call, and told apart by the lengths of their
    tokens. Other new pieces are encoded in one text and told apart by `separator`, or, without one,
    by the space that begins a piece's first token. A separator is for tokenizers that ignore case
    and white space.
    """

    def __init__(self, path: str, separator: str | None):
        super().__init__(_MEMO_PIECES if separator is None else _MEMO_FOLDED)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = separator
        settings = json.loads(self.tokenizer.to_str())
        cuts = settings["normalizer"], settings["pre_tokenizer"]
        self.pieced = cuts == ((None, _BYTE_LEVEL) if separator is None else (
            {"type": "Sequence", "normalizers": _WORD_NORMALIZERS},
            {"type": "Sequence", "pretokenizers": _WORD_PRETOKENIZERS}))
        self.cutter = Tokenizer(self.tokenizer.model)  # the same model for words between marks
        self.cutter.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BETWEEN)
        suffix = settings["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)  # characters of each token
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lead = "Ġ" if separator is None else ""
        self.line = super().line if separator is None else " "
        if separator is None:
            self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.starts[i] = token.startswith("Ġ")
        else:
            ids = self._ids(separator)
            if len(ids) != 1:
                raise ValueError("the separator must be one token")
            self.cut = ids[0]

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def folded(self, text: str) -> str:
        """In lower case, for a tokenizer that does the same, where the order of folding and
        normalising cannot matter; more pieces are then the same."""
        if self.separator is None:
            return text
        lower = text.lower()
        same = "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", lower)
        return lower if same else text

    def odd(self, texts: list[str]) -> list[bool]:
        return [odd or any(s in text for s in self.special) for text, odd in zip(texts, super().odd(texts))]

    def words(self, words: list[str], space: str) -> list[bytes]:
        lead, out = self.lead if space else "", []
        for start in range(0, len(words), 2000):
            part = words[start:start + 2000]
            shown = [lead + (word if word.isascii() else word.translate(_VISIBLE))
                     for word in (part if self.separator is None else map(str.lower, part))]
            (found,) = self.cutter.encode_batch_fast([_BETWEEN.join(shown)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            stops, wanted = np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, shown)))
            ends = np.searchsorted(stops, wanted)
            if not len(ids) or stops[-1] != wanted[-1] or (stops[ends] != wanted).any():
                out += [self.whole(space + word) for word in part]  # a token of other characters
                continue
            ends, raw = ((ends + 1) * 4).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def together(self, pieces: list[str]) -> list[bytes]:
        lines = [p for p in pieces if p[0] == "\n"]
        if lines:
            known = dict(zip(lines, super().together(lines)))
            known.update(zip(rest := [p for p in pieces if p not in known], self.together(rest)))
            return [known[p] for p in pieces]
        out = []
        for start in range(0, len(pieces), 2000):
            part = pieces[start:start + 2000]
            if self.separator is None:
                ids = self._ids(" " + " ".join(part))
                cuts = np.flatnonzero(self.starts[ids])
                ends = np.append(cuts[1:], len(ids))
            else:
                ids = self._ids(f" {self.separator} ".join(part) + f" {self.separator}")
                ends = np.flatnonzero(ids == self.cut)
                cuts = np.append(0, ends[:-1] + 1)
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[4 * a:4 * b] for a, b in zip(cuts.tolist(), ends.tolist())]
            elif len(part) == 1:
                out.append(self.whole(" " + part[0]))
            else:  # the separator is in a piece
                half = len(part) // 2
                out += self.together(part[:half]) + self.together(part[half:])
        return out


def encoder(path: str, separator: str | None = None) -> TextEncoder:
    """The encoder of a file, loaded once in each worker process."""
    key = (path, separator)
    if key not in _LOADED:
        _LOADED[key] = TextEncoder(path, separator)
    return _LOADED[key]
