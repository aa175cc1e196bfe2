"""Ordinal classifiers as distributed Spark ML jobs (M1-M4).

Every model follows one contract: ``fit(df) -> fitted``; the fitted object
has ``predict(df) -> df + prediction (int class 1..K)`` and
``importance() -> list[(feature, value)]``. Training data never leaves the
cluster: each model is a small set of stock Spark ML estimators on derived
binary problems.

* M1 ``OrdinalLogistic`` - immediate-threshold logistic model as one
  logistic regression on an expanded table (two rows per observation).
* M2 ``OrderedForest`` - K-1 random-forest regressions of 1(y <= m),
  class probabilities as differences (Lechner & Okasa, 2019).
* M3 ``ConditionalOrdinalNet`` - CORN: task k learns P(y > k | y >= k) with
  a multilayer perceptron; chained by the cumulative product.
* M4 ``BoostedOrdinal`` - K-1 gradient-boosted binary classifiers of
  1(y > k) with balanced class weights.
"""

from .ordinal import (BoostedOrdinal, ConditionalOrdinalNet, OrderedForest, OrdinalLogistic,
                      OrdinalModel)

__all__ = ["BoostedOrdinal", "ConditionalOrdinalNet", "OrderedForest", "OrdinalLogistic",
           "OrdinalModel"]
