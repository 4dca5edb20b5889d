"""The best rows of each question that a task has seen, whatever the number of its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of a batch that are held at a time.
CELLS = 1 << 18


class Best:
    """The best ``k`` documents of each of ``n`` questions by score rounded to four digits, then by id."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.rows = k, []
        self.top = np.full((n, k), -np.inf) if least is None else np.repeat(np.floor(least * 1e4)[:, None], k, axis=1)

    def add(self, docs: pa.Array, places: np.ndarray, found: np.ndarray) -> None:
        """``found``: scores of ``docs`` (rows, in the order of ids) for the questions at ``places`` (columns); -inf is no score."""
        k = self.k
        with np.errstate(invalid="ignore"):
            shown = np.copysign(np.floor(np.abs(found) * 1e4 + 0.5), found)  # as it will be rounded
        hit = np.flatnonzero(((shown >= self.top[places, 0]) & (shown > -np.inf)).any(0))
        if not len(hit):
            return
        found, shown, places = found[:, hit], shown[:, hit], places[hit]
        new = np.partition(shown, -k, axis=0)[-k:] if len(shown) > k else shown
        top = np.sort(np.concatenate([self.top[places], new.T], axis=1), axis=1)[:, -k:]
        self.top[places] = top
        good = (shown >= top[:, 0]) & (shown > -np.inf)
        many = np.flatnonzero(good.sum(0) > k)  # of equal ones those with the smallest ids stay
        if len(many):
            first = np.argsort(-shown[:, many], axis=0, kind="stable")[:k]
            good[:, many] = False
            good[first, many[None, :]] = True
        row, q = np.nonzero(good)
        self.rows.append((places[q].astype(np.int32), docs.take(pa.array(row)), found[row, q], shown[row, q]))
        if len(self.rows) >= 256:
            self._compact()

    def _compact(self) -> None:
        """Leave out all but the first ``k`` of each question."""
        q, docs, score, shown = (pa.concat_arrays(c) if i == 1 else np.concatenate(c) for i, c in enumerate(zip(*self.rows, strict=True)))
        at = pc.sort_indices(pa.table({"q": q, "shown": shown, "id": docs}), [("q", "ascending"), ("shown", "descending"), ("id", "ascending")]).to_numpy()
        own = q[at]
        first = np.searchsorted(own, own)  # where its question begins
        at = at[np.arange(len(at)) - first < self.k]
        self.rows = [(q[at], docs.take(pa.array(at)), score[at], shown[at])]

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        """_q (place of the question), doc_id and the score as ``name``."""
        if self.rows:
            self._compact()
            q, docs, score, _ = self.rows[0]
            whole = pa.RecordBatch.from_arrays([pa.array(q), docs, pa.array(score)], ["_q", "doc_id", name])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)
