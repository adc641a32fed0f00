"""Queries of the dense-array operators, by name, and the SQL that checks them."""

from __future__ import annotations

from .queries import common, driver, folds, joins, maps, programs, regions

MODULES = (maps, joins, folds, regions, programs, driver)
QUERIES = common.QUERIES
ORACLES = common.ORACLES
