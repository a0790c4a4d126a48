"""The library's registered queries, by name."""

from quarry.plans import collections, corpora, experiments, feeds, runs, statistics, texts  # noqa: F401
from quarry.plans.registry import QUERIES, SQL  # noqa: F401
