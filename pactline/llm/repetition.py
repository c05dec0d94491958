"""Quality rules on repeated passages, found with a suffix array of each text's words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactline.llm.common import WORD_HASHES, Batches, batch, mapped, mixed, slices, text_bytes, text_rows

# The separators and symbols of the rules.
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

_BATCH_WORDS = 300_000


@dataclass(frozen=True)
class RepetitionRules:
    """A text fails the base rules with fewer than `min_words` words or with more than
    `max_repeat_words` percent of its words in repeats of `window` words or more. It fails the
    repetition rules if such repeats cover more than `max_covered` percent of its words' characters,
    or if one repeat alone is longer than `max_longest` percent of its words."""

    min_words: int = 20
    window: int = 8
    max_repeat_words: int = 30
    max_covered: int = 30
    max_longest: int = 25


def longest_repeats(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run from there that starts elsewhere as well.

    `keys` are the words of several texts one after the other, different for different texts;
    `ends` is where each position's text ends. The suffix array is sorted by prefix doubling; only
    suffixes that still equal another one are sorted again. The ranks of each step are kept: from
    the longest to the shortest they give the common prefix of neighbours in the array.
    """
    n = len(keys)
    longest = np.zeros(n, np.int32)
    if n < 2:
        return longest
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    places = np.arange(n, dtype=np.int64)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    levels, step, again = [rank], 1, ~new
    again[:-1] |= ~new[1:]
    active = order[again]
    while len(active):
        following = active + step
        second = np.where(following < ends[active], rank[np.minimum(following, n - 1)] + 1, 0)
        first = rank[active].astype(np.int64)
        key = first * (n + 1) + second
        order = np.argsort(key)
        key, first, active = key[order], first[order], active[order]
        count = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(key), bool)
        group[1:] = first[1:] != first[:-1]
        inside = np.maximum.accumulate(np.where(new, count, 0))
        inside -= np.maximum.accumulate(np.where(group, count, 0))
        rank = rank.copy()
        rank[active] = first + inside
        levels.append(rank)
        again = ~new
        again[:-1] |= ~new[1:]
        active = active[again]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = places
    left, right = suffixes[:-1], suffixes[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        equal = levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        common += (inside & equal).astype(np.int64) << level
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` positions lie in a run of the given starts and lengths."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


class _Measures:
    """The measures of texts, some at a time."""

    def __init__(self, rules: RepetitionRules):
        self.rules = rules

    def _repeats(self, words: list[list[bytes]]) -> np.ndarray:
        """For each text: words and characters in repeats, and the longest repeat."""
        counts = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), 3), np.int64)
        n = int(counts.sum())
        if not n:
            return out
        flat = [x for w in words for x in w]
        text = np.repeat(np.arange(len(words)), counts)
        stops = np.cumsum(counts)
        keys = mixed(WORD_HASHES.of(flat) + mixed(text.astype(np.uint64) + np.uint64(1)))
        longest = longest_repeats(keys, stops[text])
        starts = np.flatnonzero(longest >= self.rules.window)
        if len(starts):
            inside = np.flatnonzero(_covered(starts, longest[starts], n))
            chars = np.array([len(flat[i].decode()) for i in inside.tolist()], np.int64)
            out[:, 0] = np.bincount(text[inside], minlength=len(words))
            out[:, 1] = np.bincount(text[inside], weights=chars, minlength=len(words)).astype(np.int64)
            np.maximum.at(out[:, 2], text[starts], longest[starts])
        return out

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat,
        base_failed, kept."""
        rules, base, words, found, held = self.rules, [], [], [], 0
        for data in texts:
            data = data or b""
            split = data.split()
            lines = [line for line in data.split(b"\n") if line and not line.isspace()]
            base.append((len(split), len(data.translate(None, _BLANKS).decode()),
                         len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines))))
            if held and held + len(split) > _BATCH_WORDS:
                found.append(self._repeats(words))
                words, held = [], 0
            words.append(split)
            held += len(split)
        found.append(self._repeats(words))
        n_words, word_chars, n_symbols, n_dup_lines = np.array(base, np.int64).reshape(-1, 4).T
        repeat_words, repeat_chars, longest = np.concatenate(found).T
        failed = (n_words < rules.min_words) | (100 * repeat_words > rules.max_repeat_words * n_words)
        kept = (~failed & (100 * repeat_chars <= rules.max_covered * word_chars)
                & (100 * longest <= rules.max_longest * n_words))
        return [n_words, word_chars, n_symbols, n_dup_lines, repeat_words, repeat_chars, longest,
                failed, kept]


def quality_measures(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """One row per document with the measures and the verdict of the rules.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier one), n_repeat_words (words in runs of `window` words or more that the
    text has twice or more), repeat_chars, longest_repeat (words), base_failed, kept.

    A null text has no words, so it fails like an empty one. doc_id may be null or repeated; other
    columns are not read; an empty table gives an empty one. Nothing is shuffled.
    """
    rules = rules or RepetitionRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars",
             "longest_repeat"]
    flags = ["base_failed", "kept"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names),
                        *((n, pa.bool_()) for n in flags)])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            yield batch(schema, some.column(0), *_Measures(rules).of(text_bytes(some.column(1))))

    columns = ", ".join(["doc_id long", *(f"{n} long" for n in names), *(f"{n} boolean" for n in flags)])
    return mapped(text_rows(docs), task, columns, "words")


def quality_filter(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns as they are."""
    rules = rules or RepetitionRules()
    at = docs.columns.index("text")

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            yield some.filter(pa.array(_Measures(rules).of(text_bytes(some.column(at)))[-1]))

    return mapped(docs, task, docs.schema, "words")
