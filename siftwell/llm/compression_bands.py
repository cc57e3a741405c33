"""Quality rules by compression bands.

The zstandard ratio (compressed bytes / UTF-8 bytes) of a whole document must lie between two limits
that depend on its length, and at most ``MAX_ODD_CHUNKS`` of its fixed chunks may have a ratio outside
the chunk limits. What is left after the last full chunk is judged by the text's last ``CHUNK_BYTES``; a shorter text is
one chunk, judged as a whole by its band. Repetitive text falls below the lower limits, random-looking text above the upper ones.

Defined results for odd input: a null or blank text has no words, so its base fails and it isn't kept;
texts of any length are compressed whole; repeated rows are judged row by row; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from siftwell.llm.common import map_slices
from siftwell.llm.docstats import DocStats
from siftwell.llm.textcodes import column_bytes

LEVEL = 3
#: (bytes from, lowest ratio, highest ratio): short frames carry overhead, so limits widen there.
BANDS = (
    (0, 0.55, 9.0),
    (128, 0.53, 1.0),
    (256, 0.53, 0.82),
    (512, 0.49, 0.76),
    (1024, 0.455, 0.70),
    (2048, 0.435, 0.66),
    (4096, 0.415, 0.64),
    (8192, 0.39, 0.62),
    (16384, 0.375, 0.62),
    (65536, 0.35, 0.62),
)
CHUNK_BYTES = 2048
CHUNK_LIMITS = (0.40, 0.72)
MAX_ODD_CHUNKS = 0.25

_FROM = np.array([b[0] for b in BANDS])
_LOW = np.array([b[1] for b in BANDS])
_HIGH = np.array([b[2] for b in BANDS])

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, odd_chunks double, kept boolean"
)


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The ratio of the whole text and the share of its chunks outside the chunk limits."""
    if not text:
        return 0.0, 0.0
    odd = n = 0
    starts = list(range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES))
    if starts and len(text) % CHUNK_BYTES:
        starts.append(len(text) - CHUNK_BYTES)
    for at in starts:
        r = len(packer.compress(text[at : at + CHUNK_BYTES])) / CHUNK_BYTES
        odd += not CHUNK_LIMITS[0] <= r <= CHUNK_LIMITS[1]
        n += 1
    return len(packer.compress(text)) / len(text), odd / n if n else 0.0


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base counts, ratios and the verdict."""

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        data, offsets = column_bytes(part.column(1))
        stats = DocStats(data, offsets)
        raw = data.tobytes()
        pairs = [ratios(raw[a:b], packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ratio, odd = (np.array(x, np.float64) for x in zip(*pairs, strict=True))
        band = np.searchsorted(_FROM, stats.n_bytes, "right") - 1
        inside = (ratio >= _LOW[band]) & (ratio <= _HIGH[band]) & (odd <= MAX_ODD_CHUNKS)
        failed = stats.base_failed
        return pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64())]
            + [pa.array(x.astype(np.int64)) for x in (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words)]
            + [pa.array(failed), pa.array(ratio), pa.array(odd), pa.array(inside & ~failed)],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "odd_chunks", "kept"],
        )

    return map_slices(docs.select("doc_id", "text"), judge, SCHEMA)
