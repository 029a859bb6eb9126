"""TF-IDF over words and word pairs, as tables and as sparse vectors.

Texts are cleaned and split once (`tokens`). A document is one row, so its terms are counted where it lies (Arrow batches, NumPy): no
text and no term of a single document is ever shuffled, only the counts per term that the vocabulary is made of.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import text as X
from queuemill.runtime import materialise

ROWS = 500      # documents counted at a time


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Some documents, and for each of their words its row, its code and what the codes stand for."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            words = part.column(column)
            sizes = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            yield part, np.repeat(np.arange(part.num_rows), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())


def _terms(row: np.ndarray, code: np.ndarray, names: pa.Array, known: np.ndarray | None = None):
    """Row, term and count of every distinct term of a document; terms are numbers below len(names) for words
    and len(names) * (first + 1) + second for pairs. `known` tells which words may be part of a pair."""
    width = max(1, len(names))
    beside = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, np.int64)
    if known is not None:
        beside = beside[known[code[beside]] & known[code[beside + 1]]]
    rows = np.concatenate([row, row[beside]])
    terms = np.concatenate([code, width * (code[beside] + 1) + code[beside + 1]])
    key = np.sort(rows * (width * (width + 1)) + terms)      # below 2 ** 63 for ROWS documents
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[:len(key)]
    return *np.divmod(key[first], width * (width + 1)), np.diff(np.append(first, len(key)))


def _named(terms: np.ndarray, names: pa.Array) -> pa.Array:
    """The words and pairs that term numbers stand for."""
    pair = terms >= max(1, len(names))
    left = names.take(pa.array(np.where(pair, terms // max(1, len(names)) - 1, terms)))
    both = pc.binary_join_element_wise(left.filter(pa.array(pair)), names.take(pa.array(terms[pair] % max(1, len(names)))), " ")
    return pc.replace_with_mask(left, pa.array(pair), both)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words) to (term, df, cf) over some documents."""
    for _, row, code, names in _slices(batches, 0):
        _, terms, tf = _terms(row, code, names)
        distinct, place = np.unique(terms, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [_named(distinct, names), pa.array(np.bincount(place, minlength=len(distinct))),
             pa.array(np.bincount(place, tf, minlength=len(distinct)).astype(np.int64))], names=["term", "df", "cf"])


def tokens(docs: DataFrame, key: str, cleaned: Column, *columns: str) -> DataFrame:
    """(key, columns, words), written once: the vocabulary and the vectors both start from it."""
    return materialise(docs.select(key, *columns, F.coalesce(X.clean_words(cleaned), F.array().cast("array<string>")).alias("words")), "tokens")


@dataclass
class Vocabulary:
    """At most MAX_TERMS rows (term, term_id, idf): small enough to send to every task."""

    terms: DataFrame
    n_docs: int

    @classmethod
    def fit(cls, docs: DataFrame, max_terms: int = fixed.MAX_TERMS) -> "Vocabulary":
        """From rows of `tokens`."""
        n_docs = docs.count()
        per_term = (docs.select("words").mapInArrow(_document_counts, "term string, df long, cf long")
                    .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
        kept = (per_term.where((F.col("df") >= fixed.MIN_DF) & (F.col("df") <= fixed.MAX_DF * n_docs))
                .orderBy(F.desc("cf"), "term").limit(max_terms))
        term_id = F.row_number().over(W.orderBy("term")) - 1
        idf = F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
        return cls(materialise(kept.select("term", term_id.alias("term_id"), idf.alias("idf"), "df"), "vocabulary"), n_docs)


def vectors(docs: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, idx, val) of rows of `tokens`: unit-norm sparse vectors; a text without known terms has empty arrays."""
    rows = vocabulary.terms.select("term", "term_id", "idf").collect()      # at most MAX_TERMS
    shared = docs.sparkSession.sparkContext.broadcast(([r.term for r in rows], np.array([r.term_id for r in rows], np.int64), np.array([r.idf for r in rows], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ids, idfs = shared.value
        in_pairs = pa.array(sorted({w for term in kept if " " in term for w in term.split(" ")}), pa.string())
        kept = pa.array(kept, pa.string())
        for part, row, code, names in _slices(batches, 1):
            known = pc.is_in(names, in_pairs).to_numpy(zero_copy_only=False)
            row, terms, tf = _terms(row, code, names, known)
            distinct, place = np.unique(terms, return_inverse=True)
            found = pc.fill_null(pc.index_in(_named(distinct, names), kept), -1).to_numpy(zero_copy_only=False)[place]
            term_id = np.append(ids, -1)[found]
            idf = np.append(idfs, 0.0)[found]
            keep = np.flatnonzero(term_id >= 0)
            keep = keep[np.lexsort((term_id[keep], row[keep]))]
            row, term_id, weight = row[keep], term_id[keep], (1 + np.log(tf[keep])) * idf[keep]
            norm = np.maximum(np.sqrt(np.bincount(row, weight * weight, part.num_rows)), 1e-12)
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(term_id.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(weight / norm[row]))],
                names=[key, "idx", "val"])

    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, idx array<int>, val array<double>"
    return docs.select(key, "words").mapInArrow(run, ddl)


def long_vectors(sparse: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, term, weight) rows."""
    entries = sparse.select(key, F.inline(F.arrays_zip("idx", "val")))
    return entries.join(F.broadcast(vocabulary.terms), F.col("idx") == F.col("term_id")).select(
        key, "term", F.col("val").alias("weight"))
