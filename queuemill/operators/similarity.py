"""Exact top-k by dot product between two tables of vectors.

No pair table is ever built. The corpus is grouped into cells around a bounded set of pivots; for
every query, q.p + |q| * radius bounds what a cell can offer and q.p - |q| * distance bounds what
it must contain (Cauchy-Schwarz, any norms), so cells that cannot reach the k-th best are skipped.
Cells are packed into chunks of bounded bytes, and a cell of copies holding a third of the corpus is
simply several chunks; queries are cut into blocks of bounded bytes. Blocks and chunks are written once, one
row each, and met by a Cartesian product that reads them where they lie: no vector is shuffled for a pair, so
disk grows with the rows and not with their square. A task multiplies blocks and chunks that have to meet,
slice by slice, and returns at most k rows per query and chunk. The partial results meet in one ranked merge. Term vectors lie too far apart for pivots to prune; for them a cell is
a scope, or the whole corpus.

Queries: query_id, variant, exclude_id, scope, idx, val.  Corpus: candidate_id, scope, idx, val.
`idx` is NULL for dense vectors. `scope` restricts a query to one part of the corpus (NULL: all).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.runtime import materialise

DIGITS = 9          # scores are compared after rounding, so engines agree on ties
SLACK = 1e-7        # above rounding and floating-point error of the bounds
MAX_CELLS = 16_384  # cells whose bounds every task holds
BLOCK_BYTES = 16 << 20  # of a query block, and of a chunk: larger ones are read less often
BLOCKS_HELD = 4         # query blocks that a task holds while it goes through its chunks
LEAST_BLOCK = 512       # rows that are worth a task
MAX_FILES = 2048    # that packed chunks are written to
ENTRY_BYTES = 12    # of a place and its number
SLICE = 256         # queries multiplied at a time
STEP = 8192         # corpus rows multiplied at a time
OFTEN = 0.15        # share of rows from which a term is worth a column of a matrix
MOST = 4_000_000    # numbers in one intermediate matrix
SPARSE = 4          # work of a pair of meeting entries, in multiplications of a matrix
EVERY = "every"     # the cell of the whole corpus; scopes are named "in ..."


def dense_queries(df: DataFrame, key: str, vector: str, exclude: str | None = None,
                  scope: str | None = None, variant=None) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("query_id"), (variant if variant is not None else F.lit(0)).cast("long").alias("variant"),
        (F.col(exclude) if exclude else F.lit(None)).cast("long").alias("exclude_id"),
        (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"),
        F.lit(None).cast("array<int>").alias("idx"), F.col(vector).cast("array<double>").alias("val"))


def dense_corpus(df: DataFrame, key: str, vector: str, scope: str | None = None) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("candidate_id"), (F.col(scope) if scope else F.lit("")).alias("scope"),
        F.lit(None).cast("array<int>").alias("idx"), F.col(vector).cast("array<double>").alias("val"))


# ---------------------------------------------------------------- numpy helpers inside tasks

def list_values(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], values[offsets[0]:offsets[-1]]


class _Rows:
    """Vectors of one Arrow table: flat values with offsets, and term indices when sparse."""

    def __init__(self, table):
        val, idx = (next(table.column(n) for n in table.schema.names if n.removeprefix("q_").removeprefix("c_") == name) for name in ("val", "idx"))
        self.offsets, self.values = list_values(val)
        self.sparse = idx.null_count < table.num_rows
        self.index = list_values(idx)[1] if self.sparse else None
        self.n = table.num_rows

    def norms(self):
        squares = np.concatenate([[0.0], np.cumsum(self.values * self.values)])
        return np.sqrt(np.maximum(squares[self.offsets[1:]] - squares[self.offsets[:-1]], 0.0))

    def matrix(self, columns=None):
        if not self.sparse:
            return self.values.reshape(self.n, -1)
        out = np.zeros((self.n, len(columns)))
        rows = np.repeat(np.arange(self.n), np.diff(self.offsets))
        place = np.minimum(np.searchsorted(columns, self.index), max(len(columns) - 1, 0))
        known = columns[place] == self.index if len(columns) else np.zeros(len(rows), bool)
        out[rows[known], place[known]] = self.values[known]
        return out


    def part(self, low: int, high: int) -> "_Rows":
        """Rows low to high as views."""
        out = object.__new__(_Rows)
        first, last = self.offsets[low], self.offsets[high]
        out.offsets, out.values, out.sparse, out.n = self.offsets[low:high + 1] - first, self.values[first:last], self.sparse, high - low
        out.index = self.index[first:last] if self.sparse else None
        return out


def sparse_rows(offsets: np.ndarray, index: np.ndarray, values: np.ndarray) -> _Rows:
    out = object.__new__(_Rows)
    out.offsets, out.index, out.values, out.sparse, out.n = offsets, index, values, True, len(offsets) - 1
    return out


def _products(left: _Rows, right: _Rows) -> np.ndarray:
    """left @ right.T; of term vectors only the terms of `right` that `left` has are touched."""
    if not left.sparse and not right.sparse:
        return left.matrix() @ right.matrix().T
    out = np.zeros((right.n, left.n))
    columns = np.unique(left.index) if left.sparse else np.zeros(0, int)
    if not len(columns) or not right.sparse:
        return out.T
    place = np.minimum(np.searchsorted(columns, right.index), len(columns) - 1)
    known = np.flatnonzero(columns[place] == right.index)
    row = np.repeat(np.arange(right.n), np.diff(right.offsets))[known]
    if left.sparse:
        # Where two rows share few terms, entry by entry is less work than row by row.
        order = np.argsort(left.index, kind="stable")
        starts = np.searchsorted(left.index[order], columns)
        sizes = np.diff(np.append(starts, len(order)))[place[known]]
        if SPARSE * sizes.sum() < left.n * len(known):
            return _meeting_entries(left, order, starts[place[known]], sizes, row, right.values[known], right.n)
    by_term = np.ascontiguousarray(left.matrix(columns).T)
    step = max(1, MOST // max(1, left.n))
    for at in range(0, len(known), step):
        some = known[at:at + step]
        weighted = by_term[place[some]] * right.values[some][:, None]
        starts = np.flatnonzero(np.diff(row[at:at + step], prepend=-1))
        # A row that goes on in the next step adds up.
        out[row[at:at + step][starts]] += np.add.reduceat(weighted, starts, axis=0)
    return out.T


def _meeting_entries(left: _Rows, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, row: np.ndarray, values: np.ndarray, n_right: int) -> np.ndarray:
    """Products summed over pairs of entries with one term: an entry of `right` meets `sizes` entries of `left` from `starts` on, which
    `order` sorts by term."""
    left_row, left_values = np.repeat(np.arange(left.n), np.diff(left.offsets))[order], left.values[order]
    out, ends = np.zeros(left.n * n_right), np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + MOST, "right")))
        some = slice(low, high)
        mine = np.repeat(np.arange(low, high), sizes[some])
        at = np.arange(len(mine)) - (ends[some] - sizes[some] - base)[mine - low] + starts[mine]
        out += np.bincount(left_row[at] * n_right + row[mine], left_values[at] * values[mine], len(out))
        low = high
    return out.reshape(left.n, n_right)


def _ids(table, name):
    return table.column(name).to_numpy() if isinstance(table.column(name), pa.ChunkedArray) \
        else table.column(name).to_numpy(zero_copy_only=False)


OUT = pa.schema([("query_id", pa.int64()), ("variant", pa.int64()), ("candidate_id", pa.int64()), ("score", pa.float64())])
OUT_DDL = "query_id long, variant long, candidate_id long, score double"


def _best(scores: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each row, ties by the lower id."""
    if k < scores.shape[1]:
        least = np.partition(scores, -k, axis=1)[:, -k]
        rows, cols = np.nonzero(scores >= least[:, None])
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    found = scores[rows, cols]
    order = np.lexsort((candidates[cols], -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (place < k) & np.isfinite(found)
    return rows[keep], cols[keep], found[keep]


class Best:
    """The k best of some queries over parts of the corpus that come one after the other; ties by the lower id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k, self.floors = k, np.full(n, -np.inf) if floors is None else floors.copy()
        self.row, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries `at` and the rows `ids`; -inf is no row. Only what reaches a query's k-th best so far is looked at."""
        floors = self.floors[at]
        if self.k < scores.shape[1] and np.isneginf(floors).any():
            floors = np.fmax(floors, np.partition(scores, -self.k, axis=1)[:, -self.k])
        rows, cols = np.nonzero(scores >= floors[:, None] - SLACK)
        found = np.round(scores[rows, cols], DIGITS) + 0.0
        real = np.isfinite(found)
        if not real.any():
            return
        row, held, found = (np.concatenate(x) for x in ((self.row, at[rows[real]]), (self.ids, ids[cols[real]]), (self.scores, found[real])))
        order = np.lexsort((held, -found, row))
        row, held, found = row[order], held[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floors[row[last]] = np.maximum(self.floors[row[last]], found[last])
        keep = place < self.k
        self.row, self.ids, self.scores = row[keep], held[keep], found[keep]


class Postings:
    """Term vectors of some rows, ordered by term: products with queries touch only entries that meet. Terms that many rows have are
    columns of a matrix, as that is less work than their entries."""

    def __init__(self, rows: _Rows):
        self.n = rows.n
        order = np.argsort(rows.index, kind="stable")
        self.row = np.repeat(np.arange(rows.n), np.diff(rows.offsets))[order]
        self.values, index = rows.values[order], rows.index[order]
        self.terms, starts = np.unique(index, return_index=True)
        self.starts = np.append(starts, len(index))
        often = np.flatnonzero(np.diff(self.starts) >= max(1, OFTEN * rows.n))
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), rows.n))
        for i, term in enumerate(often):
            some = slice(self.starts[term], self.starts[term + 1])
            self.matrix[i, self.row[some]] = self.values[some]

    def products(self, asked: _Rows) -> np.ndarray:
        """asked @ rows.T"""
        if not len(self.terms):
            return np.zeros((asked.n, self.n))
        place = np.minimum(np.searchsorted(self.terms, asked.index), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == asked.index)
        row, place, weight = np.repeat(np.arange(asked.n), np.diff(asked.offsets))[known], place[known], asked.values[known]
        column = self.column[place]
        dense, rare = column >= 0, column < 0
        left = np.zeros((asked.n, len(self.matrix)))
        left[row[dense], column[dense]] = weight[dense]
        out = left @ self.matrix
        row, place, weight = row[rare], place[rare], weight[rare].tolist()
        lows, highs = self.starts[place].tolist(), self.starts[place + 1].tolist()
        ends = np.searchsorted(row, np.arange(asked.n + 1)).tolist()
        for q in range(asked.n):
            mine = range(ends[q], ends[q + 1])
            if mine:
                met = np.concatenate([self.row[lows[e]:highs[e]] for e in mine])
                out[q] += np.bincount(met, np.concatenate([self.values[lows[e]:highs[e]] * weight[e] for e in mine]), self.n)
        return out


def _without(scores: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A query never finds itself."""
    if (own >= 0).any():
        scores[own[:, None] == ids[None, :]] = -np.inf
    return scores


def _own(queries: pa.Table) -> np.ndarray:
    return queries.column("q_exclude_id").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)


def _same_scope(wanted: np.ndarray, scopes: np.ndarray):
    """For each scope its rows, and the queries that look into it: their own scope's, or all."""
    order = np.argsort(scopes, kind="stable")
    for name in np.unique(scopes):
        low, high = np.searchsorted(scopes[order], [name, name + 1])
        yield np.flatnonzero((wanted == name) | (wanted == -1)), order[low:high]


def _block_topk(k: int):
    def of(corpus: pa.Table):
        held, candidates = _Rows(corpus), _ids(corpus, "c_candidate_id")
        terms = Postings(held) if held.sparse else None
        scopes = _ids(corpus, "c_scope") if "c_scope" in corpus.column_names else np.zeros(held.n, int)

        def run(queries: pa.Table) -> pa.Table:
            asked, own = _Rows(queries), _own(queries)
            wanted = _ids(queries, "q_wanted") if "q_wanted" in queries.column_names else np.full(asked.n, -1)
            best = Best(asked.n, k)
            if asked.sparse or held.sparse:
                if asked.sparse and held.sparse:
                    step = max(1, MOST // max(1, held.n))
                    for low in range(0, asked.n, step):
                        at = np.arange(low, min(low + step, asked.n))
                        best.add(at, _without(terms.products(asked.part(low, at[-1] + 1)), own[at], candidates), candidates)
                else:
                    best.add(np.arange(asked.n), _without(np.zeros((asked.n, held.n)), own, candidates), candidates)
            else:
                left, right = asked.matrix(), held.matrix()
                for looks, mine in _same_scope(wanted, scopes):
                    for first in range(0, len(mine), STEP):
                        some = mine[first:first + STEP]
                        columns, ids = np.ascontiguousarray(right[some].T), candidates[some]
                        for low in range(0, len(looks), SLICE):
                            at = looks[low:low + SLICE]
                            best.add(at, _without(left[at] @ columns, own[at], ids), ids)
            query, variant = _ids(queries, "q_query_id"), _ids(queries, "q_variant")
            return pa.table([query[best.row], variant[best.row], best.ids, best.scores], schema=OUT)
        return run
    return of


def _sides(rows: _Rows, dims: int) -> tuple[np.ndarray, _Rows]:
    """The dense part, which is the first `dims` entries of every row, and the rest."""
    first = rows.offsets[:-1, None] + np.arange(dims)
    rest = np.ones(len(rows.values), bool)
    rest[first] = False
    return rows.values[first], sparse_rows(rows.offsets - dims * np.arange(rows.n + 1), rows.index[rest], rows.values[rest])


def _block_blends(k: int, weights: list[float], dims: int):
    """Like `_block_topk`, over rows of a dense and a sparse part: both products are taken once and blended with every weight, which is
    the variant."""
    def of(corpus: pa.Table):
        candidates = _ids(corpus, "c_candidate_id")
        held_dense, held = _sides(_Rows(corpus), dims)
        terms, columns = Postings(held), np.ascontiguousarray(held_dense.T)

        def run(queries: pa.Table) -> pa.Table:
            asked, query, own, parts = _Rows(queries), _ids(queries, "q_query_id"), _own(queries), []
            step = max(1, MOST // max(1, held.n))
            for low in range(0, asked.n, step):
                high = min(low + step, asked.n)
                dense, rest = _sides(asked.part(low, high), dims)
                near, shared = dense @ columns, terms.products(rest)
                for variant, weight in enumerate(weights):
                    best = Best(high - low, k)
                    best.add(np.arange(high - low), _without(weight * near + (1 - weight) * shared, own[low:high], candidates), candidates)
                    parts.append(pa.table([query[low + best.row], np.full(len(best.row), variant), best.ids, best.scores], schema=OUT))
            return pa.concat_tables(parts)
        return run
    return of


def blend_topk(queries: DataFrame, corpus: DataFrame, k: int, weights: list[float], dims: int, block_rows: int | None = None) -> DataFrame:
    """(query_id, variant, candidate_id, score, rank) for rows whose first `dims` entries are dense: the k best for every weight w of
    w * dense + (1 - w) * sparse. A dense part says nothing about terms and the other way round, so no cell is left out."""
    asked, placed = _by_scope(queries, corpus)
    return ranked(_partial(asked, placed, k, block_rows or rows_of_block(corpus), _block_blends(k, list(weights), dims)), k)


def rows_of_block(corpus: DataFrame) -> int:
    """Rows of average size that fill a block, or less if cores would be left idle."""
    n, mean = corpus.agg(F.count(F.lit(1)), F.avg(F.size("val"))).first()
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return max(1, min(int(BLOCK_BYTES / (ENTRY_BYTES * max(1.0, mean or 1.0) + 64)), max(LEAST_BLOCK, math.ceil(n / cores))))


# ---------------------------------------------------------------- pivots, cells, bounds

def _pivot_rows(corpus: DataFrame, count: int) -> pa.Table:
    """A bounded, repeatable sample of the corpus."""
    picked = corpus.select("candidate_id", "idx", "val").orderBy(F.xxhash64("candidate_id")).limit(count)
    return picked.select("idx", "val").toArrow()


def _slices(batch: pa.RecordBatch, width: int):
    """Rows of a batch, as many at a time as a matrix of `width` columns may have."""
    step = max(1, MOST // max(1, width))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def _with_cells(corpus: DataFrame, pivots: pa.Table, scopes: list[str]) -> DataFrame:
    """Adds the cell (scope and nearest pivot) and the distance to its pivot."""
    width, number = pivots.num_rows, {name: i for i, name in enumerate(scopes)}

    def run(batches):
        centre = _Rows(pivots)
        lengths = centre.norms() ** 2
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for part in _slices(batch, width):
                table = pa.Table.from_batches([part])
                rows = _Rows(table)
                dots = _products(rows, centre)
                squared = np.maximum(rows.norms()[:, None] ** 2 - 2 * dots + lengths[None, :], 0.0)
                best = squared.argmin(axis=1)
                scope = np.array([number[s] for s in table.column("scope").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array((scope * width + best).astype(np.int32)),
                     pa.array(np.sqrt(squared[np.arange(rows.n), best]))],
                    names=[*part.schema.names, "cell", "distance"])

    ddl = "candidate_id long, scope string, idx array<int>, val array<double>, cell int, distance double"
    return corpus.select("candidate_id", "scope", "idx", "val").mapInArrow(run, ddl)


def _visits(queries: DataFrame, pivots: pa.Table, scopes: list[str], cells: dict, need: int, seats: "Seats") -> DataFrame:
    """Adds the cells a query must look into with their chunks (`codes`), its home pivot and the number of its scope."""
    width = pivots.num_rows
    cell_ids = np.array(sorted(cells))
    radius = np.array([cells[c]["radius"] for c in cell_ids])
    near = [cells[c]["near"] for c in cell_ids]
    near_cell = np.repeat(np.arange(len(cell_ids)), [len(x) for x in near])
    near_distance = np.concatenate([np.asarray(x) for x in near])
    number = {name: i for i, name in enumerate(scopes)}

    def run(batches):
        centre = _Rows(pivots)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # The bounds take one number for each row and near member: some rows at a time.
            for part in _slices(batch, len(near_cell)):
                table = pa.Table.from_batches([part])
                rows = _Rows(table)
                dots, norms = _products(rows, centre), rows.norms()
                wanted = np.array([-1 if s is None else number.get(s, -2) for s in table.column("scope").to_pylist()])
                allowed = (wanted[:, None] == -1) | (wanted[:, None] == (cell_ids // width)[None, :])
                reach = dots[:, cell_ids % width]
                upper = np.where(allowed, reach + norms[:, None] * radius[None, :], -np.inf)
                sure = np.where(allowed[:, near_cell], reach[:, near_cell] - norms[:, None] * near_distance[None, :], -np.inf)
                if sure.shape[1] >= need:
                    threshold = np.partition(sure, -need, axis=1)[:, -need]
                else:
                    threshold = np.full(rows.n, -np.inf)
                visit = allowed & (upper >= threshold[:, None] - SLACK)
                chosen = [seats.codes(cell_ids[v]) for v in visit]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(chosen, pa.list_(pa.int64())), pa.array(dots.argmax(axis=1).astype(np.int32)), pa.array(wanted, pa.int64())],
                    names=[*part.schema.names, "codes", "home", "wanted"])

    ddl = ("query_id long, variant long, exclude_id long, scope string, idx array<int>, val array<double>, "
           "codes array<long>, home int, wanted long")
    return queries.select("query_id", "variant", "exclude_id", "scope", "idx", "val").mapInArrow(run, ddl)


def topk(queries: DataFrame, corpus: DataFrame, k: int, pivots: int | None = None,
         sparse: bool = False, block_rows: int | None = None) -> DataFrame:
    """(query_id, variant, candidate_id, score, rank): the k best, ties by the lower id."""
    block = block_rows or rows_of_block(corpus)
    asked, placed = _placed(queries, corpus, k, pivots, sparse, block)
    return ranked(_partial(asked, placed, k, block) if "seat" not in placed.columns else _seated(asked, placed, k, block), k)


def _placed(queries: DataFrame, corpus: DataFrame, k: int, pivots: int | None, sparse: bool, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries with their home and a row for each cell they look into; corpus rows with their cell, and where cells are packed their seat."""
    if not sparse:
        scopes = _scopes(corpus)
        n_corpus = corpus.count()
        if n_corpus and scopes is not None:
            width = min(pivots or math.ceil(math.sqrt(n_corpus)), MAX_CELLS // len(scopes))
            return _by_pivot(queries, corpus, scopes, k, width, block)
    return _by_scope(queries, corpus)


def query_blocks(asked: DataFrame, block: int) -> DataFrame:
    """Adds `qblock`: the queries of a home in as few blocks as they fill."""
    homes = asked.select("query_id", "variant", "home").distinct().groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    return (asked.drop("scope").join(homes, "home")
            .withColumn("qblock", F.struct("home", F.pmod(F.xxhash64("query_id", "variant"), F.col("blocks")).alias("part"))))


def _partial(asked: DataFrame, placed: DataFrame, k: int, block: int, run=None) -> DataFrame:
    """The k best of every query in every chunk of its cell."""
    asked = query_blocks(asked, block).withColumn("looks", F.when(F.col("val").isNotNull(), F.array("cell")))
    sizes = materialise(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("chunks")), "sizes")
    held = placed.join(sizes.withColumnRenamed("cell", "ccell"), F.col("cell") == F.col("ccell")).select(
        F.col("cell").alias("key"), F.pmod(F.xxhash64("candidate_id"), F.col("chunks")).cast("int").alias("part"), "candidate_id", "idx", "val")
    return meeting(asked, held, block, run or _block_topk(k), ["query_id", "variant", "exclude_id", "idx", "val"], ["candidate_id", "idx", "val"],
                   ["cell", "qblock"], sizes.agg(F.sum("chunks")).first()[0] or 1)


def _fresh(prefix: str, *names: str) -> list:
    """Both sides may come from one table; new names keep their columns apart."""
    return [F.col(name).alias(prefix + name) for name in names]


def _scopes(corpus: DataFrame) -> list[str] | None:
    """The scopes, or None if there are too many for every task to hold cells in each."""
    rows = corpus.select("scope").distinct().limit(MAX_CELLS + 1).collect()
    return sorted(r.scope for r in rows) if len(rows) <= MAX_CELLS else None


def _by_scope(queries, corpus):
    """One cell per scope, and one that is the whole corpus for queries without a scope."""
    name = lambda scope: F.concat(F.lit("in "), scope)
    asked = queries.withColumns({"cell": F.coalesce(name(F.col("scope")), F.lit(EVERY)), "home": F.lit(0)})
    placed = corpus.withColumn("cell", F.explode(F.array(name(F.col("scope")), F.lit(EVERY))))
    # Cells nobody looks into go before they are counted.
    return asked, placed.join(asked.select("cell").distinct(), "cell", "left_semi")


class Seats:
    """Chunks of `block` rows that cells are packed into one after the other: the first and the last chunk of every cell."""

    def __init__(self, sizes: dict[int, int], block: int):
        self.cells = np.array(sorted(sizes), np.int64)
        self.sizes = np.array([sizes[c] for c in self.cells], np.int64)
        self.starts, self.block = np.cumsum(self.sizes) - self.sizes, block
        self.first, self.last = self.starts // block, (self.starts + self.sizes - 1) // block
        self.radix = int(self.cells.max(initial=0)) + 1

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """chunk * radix + cell, in order, for every chunk of some cells."""
        at = np.searchsorted(self.cells, cells)
        spans = self.last[at] - self.first[at] + 1
        chunk = np.arange(spans.sum()) + np.repeat(self.first[at] - np.cumsum(spans) + spans, spans)
        return np.sort(chunk * self.radix + np.repeat(cells, spans))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Adds `seat`, the chunk of a row: rows of a cell are dealt by their id."""
        known = rows.sparkSession.createDataFrame(
            [tuple(map(int, x)) for x in zip(self.cells, self.starts, self.sizes)], "k_cell int, k_start long, k_size long")
        seat = F.floor((F.col("k_start") + F.pmod(F.xxhash64("candidate_id"), F.col("k_size"))) / F.lit(self.block)).cast("long")
        return (rows.join(F.broadcast(known), F.col("cell") == F.col("k_cell")).withColumn("seat", seat).drop("k_cell", "k_start", "k_size"))


def visited(asked: DataFrame, codes: str, seats: Seats) -> DataFrame:
    """A row for each cell and chunk a query looks into (`cell`, `seat`). The vector is on the first row of a chunk only, and the list of
    all chunks (`looks`) on the first row of a query that has a vector."""
    chunk = lambda code: F.floor(code / F.lit(seats.radix)).cast("long")
    looks = F.array_distinct(F.transform(codes, chunk))
    marked = F.transform(codes, lambda c, i: F.struct(
        c.alias("code"), ((i == 0) | (chunk(c) != chunk(F.get(F.col(codes), i - 1)))).alias("head"),
        F.when((i == 0) & F.col("val").isNotNull(), looks).alias("looks")))
    rows = asked.withColumn("_at", F.explode(marked))
    return (rows.withColumns({"cell": (F.col("_at.code") % F.lit(seats.radix)).cast("int"), "seat": chunk(F.col("_at.code")), "looks": F.col("_at.looks"),
                              "idx": F.when(F.col("_at.head"), F.col("idx")), "val": F.when(F.col("_at.head"), F.col("val"))})
            .drop("_at", codes))


#: A file of packed rows may hold few large ones: its size is looked at after each.
PACKED = {"parquet.block.size": str(BLOCK_BYTES), "parquet.enable.dictionary": "false",
          **{f"parquet.{what}.size.row.check.{end}": "1" for what in ("block", "page") for end in ("min", "max")}}


def _packed(table: pa.Table) -> pa.Array:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def _pack_chunk(table: pa.Table) -> pa.Table:
    return pa.table({"c_key": table.column("c_key")[:1], "c_part": table.column("c_part")[:1], "c_rows": _packed(table.drop_columns(["c_key", "c_part"]))})


def _pack_blocks(block: int):
    """Rows as they come to blocks, each with what any of its queries looks into."""
    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - sum(b.num_rows for b in waiting))
                waiting.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in waiting) == block:
                    yield of(waiting)
                    waiting = []
        if waiting:
            yield of(waiting)

    def of(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        looks = pc.unique(pc.list_flatten(table.column("q_looks").combine_chunks()))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(looks)], looks), _packed(table)], names=["q_looks", "q_rows"])
    return run


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _met(run, schema: pa.Schema):
    """`run` for the chunk of every pair, and what it returns for the queries of the block that look into the chunk."""
    def go(batches):
        last, of = None, None
        for batch in batches:
            for key, part, held, asked in zip(*batch.columns):
                at = (key.as_py(), part.as_py())
                if at != last:
                    last, of = at, run(_unpacked(held))
                queries = _unpacked(asked)
                looks = queries.column("q_looks").combine_chunks()
                mine = pc.list_parent_indices(looks).filter(pc.equal(pc.list_flatten(looks), key))
                if len(mine):
                    yield from of(queries.drop_columns(["q_looks"]).take(mine)).cast(schema).to_batches()
    return go


def meeting(asked: DataFrame, placed: DataFrame, block: int, run, asked_columns: list[str], held_columns: list[str], order: list,
            chunks: int, schema: pa.Schema = OUT, ddl: str = OUT_DDL) -> DataFrame:
    """`run` for every chunk (`key` and `part` of `placed`) and every block of the queries whose `looks` name its key. Both sides are
    packed and written once, and every task of the product reads its own files of them."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    q = asked.where(F.col("looks").isNotNull()).select(*_fresh("q_", *asked_columns, "looks"), F.struct(*order).alias("q_order"))
    kind = q.schema["q_looks"].dataType
    n_blocks = max(1, math.ceil(q.select("q_order").count() / block))
    blocks = materialise(q.repartitionByRange(n_blocks, "q_order", F.xxhash64("q_query_id", "q_variant")).drop("q_order")
                         .mapInArrow(_pack_blocks(block), f"q_looks {kind.simpleString()}, q_rows binary"), "blocks", **PACKED)
    c = placed.select(F.col("key").cast(kind.elementType).alias("c_key"), F.col("part").cast("long").alias("c_part"), *_fresh("c_", *held_columns))
    held = materialise(c.repartition(max(cores, min(chunks, MAX_FILES)), "c_key", "c_part").groupBy("c_key", "c_part")
                       .applyInArrow(_pack_chunk, f"c_key {kind.elementType.simpleString()}, c_part long, c_rows binary"), "chunks", **PACKED)
    pairs = held.hint("shuffle_replicate_nl").join(blocks.coalesce(max(BLOCKS_HELD, math.ceil(n_blocks / BLOCKS_HELD))), F.array_contains("q_looks", F.col("c_key")))
    return pairs.select("c_key", "c_part", "c_rows", "q_rows").mapInArrow(_met(run, schema), ddl)


def _seated(asked: DataFrame, placed: DataFrame, k: int, block: int) -> DataFrame:
    """The k best of every query in every chunk that holds a cell it looks into."""
    return meeting(asked, in_seats(placed), block, _block_topk(k), ["query_id", "variant", "exclude_id", "idx", "val", "wanted"],
                   ["candidate_id", "idx", "val", "scope"], ["home"], placed.agg(F.max("seat")).first()[0] + 1)


def in_seats(placed: DataFrame) -> DataFrame:
    return placed.withColumns({"key": F.col("seat"), "part": F.lit(0)})


def _by_pivot(queries, corpus, scopes, k, width, block=None):
    """Cells around pivots; every query looks only where its bounds say it must. A scope is its number from here on, no scope is -1 and
    an unknown one -2."""
    centre = _pivot_rows(corpus, max(1, width))
    held = materialise(_with_cells(corpus, centre, scopes), "cells")
    cells = _cell_bounds(held, k + 1)
    seats = Seats({c: x["size"] for c, x in cells.items()}, block or rows_of_block(corpus))
    asked = materialise(_visits(queries, centre, scopes, cells, k + 1, seats), "visits")
    placed = seats.placed(held).withColumn("scope", F.floor(F.col("cell") / F.lit(centre.num_rows)).cast("long"))
    return visited(asked, "codes", seats), placed


def _cell_bounds(placed: DataFrame, need: int) -> dict:
    """Per cell: size, radius and the distances of its closest members (bounded model data)."""
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("distance").alias("radius"))
    closest = F.row_number().over(W.partitionBy("cell").orderBy("distance", "candidate_id"))
    near = (placed.select("cell", "distance", "candidate_id").withColumn("place", closest)
            .where(F.col("place") <= need).groupBy("cell").agg(F.collect_list("distance").alias("near")))
    return {r.cell: {"size": r.size, "radius": r.radius, "near": r.near}
            for r in sizes.join(near, "cell").collect()}


def ranked(scored: DataFrame, k: int, keys: tuple = ("query_id", "variant")) -> DataFrame:
    """Best k per query; the limit is applied before the shuffle, then once more after it."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "candidate_id"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
