"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiloom.llm.fm import CACHED_WORDS, FactorizationMachine, FitLimits, bucket, fit, score

#: Lengths of the word beginnings that are terms beside the word, so that inflected forms are met.
BEGINNINGS = (4, 5, 6)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class ToxicTerms:
    """Distinct hashed terms of a whole text: its lower-cased words without punctuation at their ends, and their beginnings."""

    def __init__(self) -> None:
        self._words: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> tuple[int, ...]:
        bare = _EDGES.sub("", word)
        return (bucket("w:" + bare), *(bucket(f"b{k}:{bare[:k]}") for k in BEGINNINGS if len(bare) > k)) if bare else ()

    def __call__(self, text: str) -> np.ndarray:
        known = self._words
        if len(known) > CACHED_WORDS:
            known.clear()
        found: set[int] = set()
        for word in set(text.lower().split()):
            terms = known.get(word)
            if terms is None:
                terms = self._terms(word)
                if len(word) <= 60:
                    known[word] = terms
            found.update(terms)
        return np.fromiter(found, np.int64, len(found))

    def alone(self, text: str) -> np.ndarray:
        """The terms of whole words."""
        return np.unique(np.array([bucket("w:" + bare) for bare in {_EDGES.sub("", w) for w in set(text.lower().split())} if bare], np.int64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, limits: FitLimits = FitLimits()) -> FactorizationMachine:
    """A model of ``labels.toxic``, from at most ``limits.max_rows`` labelled rows of those ``train`` (over doc_id) holds for.

    Pairwise factors weigh terms that are toxic together, such as an insult with a group's name. Rows with a null id,
    text or label teach nothing. Without such rows the model gives every text the same score.
    """
    return fit(docs, labels, "toxic", train, ToxicTerms, limits)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) for every row: null and empty texts get the score of no term. Repeated rows and null ids are kept."""
    return score(docs, model, ToxicTerms)


def held_out(mod: int, equals: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``equals``; a null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == equals, F.lit(False))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are; scored and filtered in the scan's own tasks."""
    return score(docs, model, ToxicTerms, docs.columns, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
