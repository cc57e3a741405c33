"""Counts over the words and lines of whole texts, vectorised over a slice of documents."""

from __future__ import annotations

import numpy as np

from siftwell.llm.textcodes import _WORD, Words, mix64, occurrence, span_hashes, windows

REPEAT_WIDTH = 5


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _mask(b"#*$%&|<>")
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER | _mask(bytes(range(97, 123))) | (np.arange(256) >= 0xC0)
_DIGIT = _mask(b"0123456789")
_STOP = _mask(b".!?")
_COMMA = _mask(b",;:")
_BANG = _mask(b"!")


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a mask (or of numbers) over each document's bytes."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the lines that splitting each text at \\n gives."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    doc = np.concatenate([np.arange(len(offsets) - 1), doc_of_break])
    starts = starts[np.lexsort((starts, doc))]
    ends = ends[np.lexsort((ends, doc))]
    return starts, ends, np.sort(doc)


class DocStats:
    """Base counts of each text of a slice. See the names in ``__init__``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_docs = len(offsets) - 1
        self.words = words = Words(data, offsets)
        self.n_bytes = np.diff(offsets)
        self.n_words = np.diff(words.bounds)
        in_word = _WORD[data]
        self.word_chars = per_doc(_LEAD[data] & in_word, offsets)
        self.n_symbols = per_doc(_SYMBOL[data], offsets)

        starts, ends, doc = line_spans(data, offsets)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(in_word, out=seen[1:])
        full = seen[ends] > seen[starts]
        starts, ends, doc = starts[full], ends[full], doc[full]
        lines = span_hashes(data, starts, ends)
        self.n_lines = np.bincount(doc, minlength=n_docs)
        self.n_dup_lines = np.bincount(doc[occurrence(lines, doc) > 0], minlength=n_docs)

        self.codes = words.hashes()
        wins, wb = windows(self.codes, words.bounds, REPEAT_WIDTH)
        wdoc = np.repeat(np.arange(n_docs), np.diff(wb))
        again = occurrence(wins, wdoc) > 0
        first = np.zeros(len(wins), bool)
        if again.any():
            # a first occurrence is repeated when a later equal window of its document is
            key = mix64(wins + wdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            first = np.isin(key, np.unique(key[again]))
        at = (np.repeat(words.bounds[:-1] - wb[:-1], np.diff(wb)) + np.arange(len(wins)))[first]
        covered = np.zeros(len(self.codes) + REPEAT_WIDTH, bool)
        for k in range(REPEAT_WIDTH):
            covered[at + k] = True
        covered = covered[: len(self.codes)]
        self.n_repeat_words = per_doc(covered, words.bounds)
        self.data, self.offsets = data, offsets

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def features(self) -> np.ndarray:
        """Transformed statistics of each text, one row per document (see FEATURES)."""
        data, offsets = self.data, self.offsets
        chars = np.maximum(per_doc(_LEAD[data], offsets), 1)
        words = np.maximum(self.n_words, 1)
        lines = np.maximum(self.n_lines, 1)
        letters = per_doc(_LETTER[data], offsets)
        distinct = self.n_words - np.bincount(
            self.words.doc[occurrence(self.codes, self.words.doc) > 0], minlength=len(offsets) - 1
        )
        share = lambda a, b: np.sqrt(a / b)
        return np.column_stack(
            [
                np.log1p(self.n_words),
                np.log1p(self.word_chars / words),
                share(self.n_symbols, words),
                share(self.n_dup_lines, lines),
                share(self.n_repeat_words, words),
                share(per_doc(_UPPER[data], offsets), np.maximum(letters, 1)),
                share(letters, chars),
                share(per_doc(_DIGIT[data], offsets), chars),
                share(per_doc(_STOP[data], offsets), words),
                share(per_doc(_COMMA[data], offsets), words),
                share(per_doc(_BANG[data], offsets), words),
                share(distinct, words),
                np.log1p(words / lines),
            ]
        ).astype(np.float64)


FEATURES = (
    "log words", "log word length", "symbols per word", "duplicate lines", "repeated words", "upper case",
    "letters", "digits", "sentence ends per word", "commas per word", "exclamations per word",
    "distinct words", "log words per line",
)
