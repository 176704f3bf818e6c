"""Exact nearest documents for a block of requests, one Arrow batch at a time.

Runs inside Spark tasks. A batch of document vectors is multiplied with the
request vectors of the same project; only each request's best rows so far are
kept, so a task returns at most k rows per request however many it read.

The matrix product only preselects. Its last bits depend on where a row sits in
the batch, so rows near a cut-off are scored again one by one in a fixed order:
copies of a document always tie, and ties go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkseek.functions import filters
from sparkseek.functions.vectors import matrix

FILTER_COLUMNS = ("kind", "namespace", "type_name")
SLACK = 1e-9
UNDEFINED = 3.0  # stands for NaN, above every real distance (at most 2)
EXCLUDED = np.inf
NO_PAIRS = pa.schema(
    [("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("k", pa.int64())]
).empty_table()
CELLS = 1 << 19  # largest distance matrix and largest gather held at a time


@dataclass
class RequestBlock:
    query_id: np.ndarray
    project_id: np.ndarray
    vectors: np.ndarray
    squared_norm: np.ndarray
    k: np.ndarray
    floor: np.ndarray
    filter_sets: list[tuple]
    filter_set: np.ndarray

    @staticmethod
    def from_arrow(table: pa.Table, dimensions: int) -> RequestBlock:
        n = table.num_rows
        vectors = matrix(table["query_vector"], dimensions)
        names = set(table.column_names)
        floor = np.full(n, -np.inf)
        if "min_similarity" in names:
            given = table["min_similarity"].combine_chunks()
            floor = given.fill_null(-np.inf).to_numpy(zero_copy_only=False)
            floor = np.where(np.isnan(floor), np.inf, floor)  # only NaN reaches NaN
        conditions = []
        for column in FILTER_COLUMNS:
            if f"{column}_operator" in names:
                pairs = zip(table[f"{column}_operator"].to_pylist(), table[f"{column}_value"].to_pylist())
                given = [p if None not in p else None for p in pairs]
                for operator in {p[0] for p in given if p}:
                    filters.check_operator(operator, filters.FILTER_OPERATORS[column])
                conditions.append(given)
            else:
                conditions.append([None] * n)
        sets: dict[tuple, int] = {}
        which = np.array([sets.setdefault(c, len(sets)) for c in zip(*conditions)], dtype=np.int64)
        return RequestBlock(
            query_id=table["query_id"].to_numpy().astype(np.int64),
            project_id=table["project_id"].to_numpy().astype(np.int64),
            vectors=vectors,
            squared_norm=np.einsum("nd,nd->n", vectors, vectors),
            k=table["k"].to_numpy().astype(np.int64),
            floor=floor,
            filter_sets=list(sets),
            filter_set=which,
        )


def like(values: pa.Array, pattern: str) -> pa.Array:
    """LIKE by Arrow's own kernels; a pattern with escapes goes through its regular expressions."""
    if "\\" not in pattern:
        return pc.match_like(values, pattern)
    pieces = re.findall(r"\\.|%|_|[^%_\\]+", pattern, re.DOTALL)
    special = {"%": ".*", "_": "."}
    regex = "".join(special.get(p) or re.escape(p[1:] if p[0] == "\\" else p) for p in pieces)
    return pc.match_substring_regex(values, rf"(?s)\A{regex}\z")


class TextColumn:
    """One batch's values of a filtered column: distinct values, lowered once, and the codes of the rows."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, keep_null: bool):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        coded = column.dictionary_encode()
        self.words = coded.dictionary
        self.lowered = pc.utf8_lower(self.words)
        self.codes = coded.indices.fill_null(len(self.words)).to_numpy(zero_copy_only=False)
        self.keep_null = keep_null

    def passes(self, operator: str, value: str) -> np.ndarray:
        """Which rows pass one condition, tried once per distinct value."""
        if operator in (filters.EQUALS, filters.NOT_EQUALS):
            hit = pc.equal(self.words, value)
        else:
            hit = like(self.lowered, filters.wildcard(value).lower())
        negative = operator in (filters.NOT_CONTAINS, filters.NOT_EQUALS)
        table = np.append(hit.to_numpy(zero_copy_only=False) != negative, self.keep_null and negative)
        return table[self.codes]


class TopK:
    """Running best rows of every request in a block."""

    def __init__(self, requests: RequestBlock):
        self.requests = requests
        self.bound = np.full(len(requests.query_id), np.inf)
        self.best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending_rows = 0
        self.by_project = {p: np.flatnonzero(requests.project_id == p) for p in np.unique(requests.project_id)}

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        """Take in documents: id, project_id, embedding and any filtered columns."""
        if not batch.num_rows:
            return
        projects = np.asarray(batch["project_id"])
        present = np.unique(projects)
        for project in present:
            asked = self.by_project.get(project)
            if asked is None:
                continue
            rows = batch if len(present) == 1 else batch.take(pa.array(np.flatnonzero(projects == project)))
            self.add_for(asked, rows)

    def add_for(self, asked: np.ndarray, rows: pa.RecordBatch | pa.Table) -> None:
        """Take in documents for some of the requests, given by their places: id, embedding and any filtered columns."""
        step = max(1, CELLS // len(asked))
        for at in range(0, rows.num_rows, step):
            self._add_project(asked, rows.slice(at, step))

    def _add_project(self, asked: np.ndarray, batch: pa.RecordBatch | pa.Table) -> None:
        r = self.requests
        ids = np.asarray(batch["id"])
        docs = matrix(batch["embedding"], r.vectors.shape[1])
        doc_norm = np.einsum("nd,nd->n", docs, docs)
        floor = r.floor[asked][:, None]

        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = r.vectors[asked] @ docs.T
            cosine /= np.sqrt(r.squared_norm[asked][:, None] * doc_norm[None, :])
        distance = 1.0 - np.clip(cosine, -1.0, 1.0)
        distance[np.isnan(distance)] = UNDEFINED
        if (floor > -np.inf).any():
            # The threshold is on one minus the distance, which is not always the cosine to the last bit.
            with np.errstate(invalid="ignore"):
                low = cosine < floor
                close = np.abs(cosine - floor) < SLACK
            a, n = np.nonzero(close)
            low[a, n] = 1.0 - (1.0 - self._exact_similarity(asked[a], n, docs, doc_norm)) < floor[a, 0]
            distance[low] = EXCLUDED
        if any(any(s) for s in r.filter_sets):
            distance[~self._filter_mask(asked, batch)] = EXCLUDED

        k = int(r.k[asked].max())
        cut = self.bound[asked]
        if len(ids) > k:
            cut = np.minimum(cut, np.partition(distance, k - 1, axis=1)[:, k - 1])
        a, n = np.nonzero((distance <= cut[:, None] + SLACK) & (distance < EXCLUDED))
        if not len(a):
            return
        exact = 1.0 - self._exact_similarity(asked[a], n, docs, doc_norm)
        exact[np.isnan(exact)] = UNDEFINED
        self.pending.append((asked[a], exact, ids[n]))
        self.pending_rows += len(a)
        if self.pending_rows > max(len(self.best[0]), 100_000):
            self._merge()

    def _exact_similarity(self, request: np.ndarray, row: np.ndarray, docs: np.ndarray, doc_norm: np.ndarray) -> np.ndarray:
        r = self.requests
        product = np.empty(len(request))
        step = max(1, CELLS // max(1, docs.shape[1]))
        for at in range(0, len(request), step):
            part = slice(at, at + step)
            product[part] = np.einsum("pd,pd->p", r.vectors[request[part]], docs[row[part]])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.clip(product / np.sqrt(r.squared_norm[request] * doc_norm[row]), -1.0, 1.0)

    def _filter_mask(self, asked: np.ndarray, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        r = self.requests
        used, position = np.unique(r.filter_set[asked], return_inverse=True)
        masks = np.ones((len(used), batch.num_rows), dtype=bool)
        columns: dict[str, TextColumn] = {}
        done: dict[tuple, np.ndarray] = {}
        for i, s in enumerate(used):
            for column, condition in zip(FILTER_COLUMNS, r.filter_sets[s]):
                if condition is None:
                    continue
                key = (column, *condition)
                if column not in columns:
                    columns[column] = TextColumn(batch[column], keep_null=column != "kind")
                if key not in done:
                    done[key] = columns[column].passes(*condition)
                masks[i] &= done[key]
        return masks[position]

    def _merge(self) -> None:
        parts = [self.best, *self.pending]
        request, distance, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ids, distance, request))
        request, distance, ids = request[order], distance[order], ids[order]
        starts = np.flatnonzero(np.r_[True, request[1:] != request[:-1]]) if len(request) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(request)])
        rank = np.arange(len(request)) - np.repeat(starts, sizes)
        keep = rank < self.requests.k[request]
        last = rank == self.requests.k[request] - 1
        self.bound[request[last]] = distance[last]
        self.best = request[keep], distance[keep], ids[keep]
        self.pending, self.pending_rows = [], 0

    def result(self) -> pa.RecordBatch:
        self._merge()
        request, distance, ids = self.best
        distance = np.where(distance == UNDEFINED, np.nan, distance)
        return pa.record_batch(
            {
                "query_id": pa.array(self.requests.query_id[request], pa.int64()),
                "id": pa.array(ids, pa.int64()),
                "distance": pa.array(distance, pa.float64()),
                "k": pa.array(self.requests.k[request], pa.int64()),
            }
        )


def best_rows(batches: Iterable[pa.RecordBatch], requests: RequestBlock) -> Iterator[pa.RecordBatch]:
    """At most k rows per request out of all the batches of one task."""
    top = TopK(requests)
    for batch in batches:
        top.add(batch)
    yield top.result()
