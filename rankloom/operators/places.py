"""The places of given documents in whole ranked lists, without the lists.

A document's place is one more than the number of documents that rank before it. Counting those takes one pass
over what is searched, in which a task passes on one number per given document; lists, however long, are never
formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Asked:
    """Given documents of numbered queries, in the order of a list: by single precision, ties by the smaller id."""

    def __init__(self, query: np.ndarray, ids: pa.Array, scores: np.ndarray, queries: int):
        ranked = -scores.astype(np.float32)
        table = pa.table({"query": query, "ranked": ranked, "id": ids, "row": np.arange(len(query))})
        table = table.sort_by([("query", "ascending"), ("ranked", "ascending"), ("id", "ascending")])
        self.row = table["row"].to_numpy()
        self.ranked = table["ranked"].to_numpy()
        self.ids = plain_ids(table["id"])
        self.starts = np.searchsorted(table["query"].to_numpy(), np.arange(queries + 1))
        self.counts = np.zeros(len(query), np.int64)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Count some documents of a query's list; scores that are no finite numbers are in no list."""
        own = slice(self.starts[query], self.starts[query + 1])
        given, names = self.ranked[own], self.ids[own]
        if not len(given):
            return
        good = np.isfinite(scores)
        ranked, ids = -scores[good].astype(np.float32), ids[good]
        first, last = np.searchsorted(given, ranked, "left"), np.searchsorted(given, ranked, "right")
        # The first given document that ranks after each; among equal scores the ids decide.
        behind = first.copy()
        tied = np.flatnonzero(first < last)
        for start in np.unique(first[tied]):
            among = tied[first[tied] == start]
            behind[among] = start + np.searchsorted(names[start : last[among[0]]], ids[among], "right")
        self.counts[own] += np.cumsum(np.bincount(behind, minlength=len(given) + 1)[: len(given)])

    def before(self) -> np.ndarray:
        """For every given document, in the order given, how many counted ones rank before it."""
        found = np.empty(len(self.counts), np.int64)
        found[self.row] = self.counts
        return found


def plain_ids(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that sorts as Spark does: whole numbers as they are, texts by code point."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    plain = np.empty(len(ids), object)
    plain[:] = ids.to_pylist()
    return plain
