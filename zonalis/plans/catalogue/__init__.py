"""The registered queries: one per operator, each with its SQL where SQL can say it."""

from zonalis.plans.catalogue import (arriving, cells, diagnostics, events, sampling, stored,  # noqa: F401
                                     storage, views)
from zonalis.plans.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
