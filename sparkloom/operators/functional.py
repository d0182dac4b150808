"""The results facade as plain functions, one for each thing that can be done with a query or with results.

A query is a class with a predicate that isn't run; results are what it gives, with an order of their own.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..plans.catalog import Catalog
from ..plans.tree import And
from . import edits
from .collections import List, Set
from .results import Results, _query


def query_parse(catalog: Catalog, cls: str, text: str, *args: Any) -> Results:
    return Results(catalog, cls, text, args=args)


def query_append_query(query: Results, text: str, *args: Any) -> Results:
    """A query with more of a predicate and more of an ordering."""
    more = _query(text, args)
    return Results(query.catalog, query.cls.name, And((query.where, more.where)), (*query.order, *more.order))


def query_parse_for_list(own: List, text: str, *args: Any) -> DataFrame:
    return own.query(text, *args)


def query_parse_for_set(own: Set, test) -> DataFrame:
    return own.filter(test)


def query_parse_for_results(results: Results, text: str, *args: Any) -> Results:
    return results.query(text, *args)


def query_get_description(query: Results) -> str:
    return str(query)


def query_count(query: Results) -> int:
    """Objects that the query gives, its ordering included."""
    return query.count()


def query_find_first(query: Results):
    return query.first()


def query_find_all(query: Results) -> Results:
    return query


def query_delete_all(query: Results) -> DataFrame:
    """The class's frame without the query's objects."""
    return edits.remove(query.catalog, query.cls.name, str(query))


results_delete_all = query_delete_all


def results_count(results: Results) -> int:
    return results.count()


def results_filter(results: Results, text: str, *args: Any) -> Results:
    return results.filter(text, *args)


def results_sort(results: Results, *keys: Any) -> Results:
    return results.sort(*keys)


def results_distinct(results: Results, *paths: str) -> Results:
    return results.distinct(*paths)


def results_limit(results: Results, n: int) -> Results:
    return results.limit(n)


def results_get(results: Results, n: int):
    return results.get(n)


results_get_object = results_get


def results_get_list(results: Results, n: int, prop: str) -> List:
    """The list of the object at position ``n``."""
    return List(results.catalog, results.cls.name, results.get(n)[results.cls.key], prop)


def results_get_query(results: Results) -> Results:
    return results._with()


def results_find(results: Results, key: Any) -> int:
    """Position of an object by its key, or -1."""
    return results.index_of(key)


def results_min(results: Results, prop: str):
    return results.min(prop)


def results_max(results: Results, prop: str):
    return results.max(prop)


def results_sum(results: Results, prop: str):
    return results.sum(prop)


def results_average(results: Results, prop: str):
    return results.average(prop)


def results_snapshot(results: Results, path: str) -> Results:
    return results.snapshot(path)
