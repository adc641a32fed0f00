"""Queries of the dense-array operators over the driver's tables, with the SQL that checks them."""
