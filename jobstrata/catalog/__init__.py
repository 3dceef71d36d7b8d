"""Named queries over the test tables, with equivalent SQL."""

from importlib import import_module

_MODULES = ("report_queries", "cleaning_queries", "search_queries", "page_queries", "stream_queries", "io_queries", "dataset_queries")


def _merged(attribute):
    out = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"jobstrata.catalog.{name}"), attribute))
    return out


def queries():
    return _merged("QUERIES")


def oracle_sql():
    return _merged("ORACLES")
