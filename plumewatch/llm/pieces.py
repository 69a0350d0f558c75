"""Texts of an Arrow slice cut at spaces, every distinct word handled once.

A slice is split and dictionary-encoded in Arrow. What a word yields (token ids, alignments) is looked up in a
bounded memory, and gathered for the whole slice by offsets in numpy, so Python runs once for each distinct
word and not for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of a slice, unless one text is longer.
ROWS, BYTES = 4_000, 16_000_000


def slices(batch: pa.RecordBatch, text: int, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes of its text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, base + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of each text between single spaces.

    `words` are the distinct ones, `index` names the word at each place, `offsets` where texts begin. With
    `lines` a line feed opens a word as well. A text has at least one word, which may be empty.
    """

    def __init__(self, texts: pa.Array, lines: bool = False):
        texts = pc.fill_null(texts, "")
        if lines:
            texts = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        self.offsets = offsets - offsets[0]
        self.index = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.to_pylist()

    @property
    def firsts(self) -> np.ndarray:
        return self.offsets[:-1]

    def holding(self, marked: np.ndarray, but_first: bool = False) -> np.ndarray:
        """Which texts hold a marked word, with `but_first` at another place than the first."""
        hit = marked[self.index]
        if but_first:
            hit = hit.copy()
            hit[self.firsts] = False
        return np.logical_or.reduceat(hit, self.firsts) if len(self.firsts) else np.zeros(0, bool)


def gather(flat: np.ndarray, lengths: np.ndarray, order: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The runs of `flat` (of the given lengths) in the given order; `counts` replaces lengths[order]."""
    starts = np.cumsum(lengths) - lengths
    counts = lengths[order] if counts is None else counts
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[order] - ends + counts, counts) + np.arange(total)]
