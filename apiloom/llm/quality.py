"""Quality scores from a factorization machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame

from apiloom.llm.fm import CACHED_WORDS, FactorizationMachine, FitLimits, bucket, fit, score

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_DIGITS = bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256), 32, 10, 13, 9])
#: Steps of a ratio between 0 and 1: finer at both ends.
_STEPS = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])


def structure(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """Statistics of a whole text, each a ratio, or a length on a log scale (named log_...)."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(1, len(raw)), max(1, len(words))
    lines = text.split("\n")
    shouted = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    odd_end = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    return {
        "log_chars": math.log2(len(text) + 1),
        "log_lines": math.log2(len(lines) + 1),
        "log_line": math.log2(len(text) / len(lines) + 1),
        "distinct": len(counts) / n,
        "commonest": max(counts.values(), default=0) / n,
        "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "lines_again": 1 - len(set(lines)) / len(lines),
        "shouted": shouted / n,
        "odd_end": odd_end / n,
        "digits": (size - len(raw.translate(None, _DIGITS))) / size,
        "signs": len(raw.translate(None, _LETTERS)) / size,
        "short": sum(k for w, k in counts.items() if len(w) < 3) / n,
        "long": sum(k for w, k in counts.items() if len(w) > 20) / n,
    }


class QualityFeatures:
    """Distinct hashed words, and a step of each statistic; the text's length is the only metadata."""

    def __init__(self) -> None:
        self._words: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, words = self._words, text.split()
        if len(known) > CACHED_WORDS:
            known.clear()
        counts = Counter(words)
        found: set[int] = set()
        for word in counts:
            term = known.get(word)
            if term is None:
                term = bucket("w:" + _EDGES.sub("", word.lower()))
                if len(word) <= 60:
                    known[word] = term
            found.add(term)
        for name, x in structure(text, words, counts).items():
            step = round(x) if name.startswith("log_") else int(np.searchsorted(_STEPS, x, "right"))
            found.add(bucket(f"s:{name}:{step}"))
        return np.fromiter(found, np.int64, len(found))

    alone = __call__


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, limits: FitLimits = FitLimits()) -> FactorizationMachine:
    """A model of ``labels.quality``, from at most ``limits.max_rows`` labelled rows of those ``train`` (over doc_id) holds for.

    Rows with a null id, text or label teach nothing. Without such rows the model gives every text the same score.
    """
    return fit(docs, labels, "quality", train, QualityFeatures, limits)


def quality_scores(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) for every row; a null text is scored as an empty one. Repeated rows and null ids are kept."""
    return score(docs, model, QualityFeatures)
