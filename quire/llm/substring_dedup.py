"""Removal of words whose window of 20 words has occurred before, by super-k-mer partitioning (see repeats)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.repeats import Kind, remove_repeats


def by_sorting(strings: list[bytes], owner: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each window of the strings its string, its offset, and the first (owner, start) of an equal window.

    Windows get exact ranks by sorting pairs of the ranks of their halves, from single words upward.
    """
    split = [s.split(b" ") for s in strings]
    size = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, int(size.sum()))
    end = np.cumsum(size)
    string = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(rank))
    offset = place - (end - size)[string]
    have = 1
    while have < k:
        step = min(have, k - have)
        pair = rank[: len(rank) - step] * (len(place) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    whole = np.flatnonzero(place[: len(rank)] + k <= end[string[: len(rank)]])
    rank, string, offset = rank[whole], string[whole], offset[whole]
    at = begin[string] + offset
    order = np.lexsort((at, owner[string], rank))
    rank, string, offset, at = rank[order], string[order], offset[order], at[order]
    head = np.append(True, rank[1:] != rank[:-1])[: len(rank)]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(rank) else order
    return string, offset, owner[string[first]], at[first]


def remove_repeated_words(docs: DataFrame, k: int = 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept_text): one row for each row of docs.

    Words are runs of bytes other than ASCII white space. A word goes if a window of k words that covers it also
    starts earlier: in a row with a smaller doc_id, or at a smaller word of the same doc_id. A null text is empty; a
    null doc_id counts as the largest. Texts under k words stay whole. An empty table gives no rows.
    """
    return remove_repeats(docs, Kind(True, k, 6, True, by_sorting), keep_text).withColumnRenamed("n_tokens", "n_words")
