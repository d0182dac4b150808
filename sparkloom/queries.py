"""Named queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lists, sets, text
from .operators import edits, functional
from .operators.collections import Dictionary, List, Set
from .operators.results import Results
from .plans.builder import Prop, Where
from .plans.catalog import Catalog, Property
from .plans.tree import Instant, Shape
from .sources import extended_json, tables, text_files
from .sources.store import Store
from .sources.store import folder as _folder
from .streaming import changes, instructions, notify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def rql(name: str, cls: str, with_: str, where: str, columns: str, sql: str, *args) -> None:
    """A predicate over ``cls`` (with linked tables ``with_``) that returns ``columns``."""
    names = tuple(dict.fromkeys([cls, *with_.split()]))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Results(tables.star(spark, sf_dir, *names), cls, where, args=args).df().select(*columns.split())

    add(name, sql)(run)


ORD = "o_orderkey o_custkey o_totalprice"
ITEM = "l_orderkey l_linenumber l_partkey l_quantity"
PART = "p_partkey p_name p_size"
DEEP = "orders customer nation region"

# -- scans and lookups
rql("scan_all", "nation", "", "TRUEPREDICATE", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
rql("scan_none", "nation", "", "FALSEPREDICATE", "n_nationkey", "SELECT n_nationkey FROM nation WHERE false")
rql("primary_key_lookup", "orders", "", "o_orderkey == 77", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
rql("find_first", "orders", "", "o_orderstatus == 'F' LIMIT(1)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
rql("find_all_equal", "part", "", "p_brand == 'Brand#11'", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#11'")
# -- predicates
rql("filter_compare", "lineitem", "", "l_quantity >= 30 && l_discount < 0.05", ITEM, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05")
rql("filter_or_group", "orders", "", "(o_totalprice > 200000 or o_orderstatus = 'O') and o_custkey < 500", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_totalprice > 200000 OR o_orderstatus = 'O') AND o_custkey < 500")
rql("filter_not", "orders", "", "NOT (o_totalprice > 100000 OR o_orderpriority BEGINSWITH '1')", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 100000 OR starts_with(o_orderpriority, '1'))")
rql("filter_not_equal", "orders", "", "o_orderstatus != 'F'", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
rql("filter_between", "part", "", "p_size BETWEEN {5, 15}", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 15")
rql("filter_between_dates", "orders", "", "o_orderdate BETWEEN {1995-01-01@00:00:00, 1995-12-31@00:00:00}", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
rql("filter_date_argument", "events", "", "ts > $0", "event_id user_id value", "SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'", Instant(1705276800))
rql("filter_in", "part", "", "p_size IN {1, 5, 9}", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9)")
rql("filter_in_argument", "part", "", "p_size IN $0", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (2, 3, 4)", [2, 3, 4])
rql("filter_none_of_list", "part", "", "p_size != ALL {1, 2, 3}", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size NOT IN (1, 2, 3)")
rql("filter_or_chain", "part", "", " || ".join(f"p_partkey == {3 * i}" for i in range(1000)), PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 3000")
rql("filter_or_chain_5000", "orders", "", " || ".join(f"o_orderkey == {7 * i}" for i in range(5000)), ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey < 35000")
rql("filter_in_5000", "orders", "", "o_orderkey IN $0", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey < 25000", [5 * i for i in range(5000)])
rql("string_begins", "customer", "", "c_name BEGINSWITH 'Customer#0000001'", "c_custkey c_name", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
rql("string_ends", "part", "", "p_brand ENDSWITH '2'", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE ends_with(p_brand, '2')")
rql("string_contains", "documents", "", "text CONTAINS 'worthless'", "doc_id source", "SELECT doc_id, source FROM documents WHERE contains(text, 'worthless')")
rql("string_contains_fold", "documents", "", "text CONTAINS[c] 'IDIOT'", "doc_id source", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'idiot')")
rql("string_like", "part", "", "p_brand LIKE '*#?2'", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE regexp_full_match(p_brand, '.*#.2', 's')")
rql("string_like_fold", "part", "", "p_type LIKE[c] '*a*e*'", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE regexp_full_match(lower(p_type), '.*a.*e.*', 's')")
rql("string_equal_fold", "orders", "", "o_orderstatus ==[c] 'f'", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE lower(o_orderstatus) = 'f'")
rql("string_size", "documents", "", "text.@size > 3000", "doc_id n_chars", "SELECT doc_id, n_chars FROM documents WHERE strlen(text) > 3000")
rql("null_tests", "orders", "", "o_orderstatus != NULL and not o_orderpriority == nil", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL")
rql("column_to_column", "orders", "", "o_orderkey > o_custkey", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > o_custkey")
rql("arithmetic", "lineitem", "", "l_extendedprice * l_discount > 1000 + 500", ITEM, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_extendedprice * l_discount > 1500")
rql("arithmetic_whole", "orders", "", "(o_orderkey - 10) / 7 == 3", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE trunc((o_orderkey - 10) / 7.0) = 3")
rql("literal_coercion", "part", "", "p_size == 7.0 or p_size == '9' or p_size == 1.5", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (7, 9)")
# -- links
rql("link_path", "lineitem", f"{DEEP}", "order.customer.nation.region.r_name == 'ASIA'", ITEM, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
rql("link_equals_object", "orders", "customer", "customer == obj('customer', 42)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42 AND o_custkey IN (SELECT c_custkey FROM customer)")
rql("link_null", "orders", "customer", "customer == NULL or customer.c_acctbal < 0", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_acctbal < 0")
rql("link_null_value", "documents", "labels", "labels.@count == 0", "doc_id source", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
rql("any_of_links", "orders", "lineitem", "ANY items.l_quantity > 48", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
rql("all_of_links", "orders", "lineitem", "ALL items.l_quantity > 10", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity > 10)")
rql("none_of_links", "orders", "lineitem", "NONE items.l_returnflag == 'R'", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
rql("any_or_own", "orders", "lineitem", "ANY items.l_quantity > 49 or o_totalprice > 300000", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
rql("links_against_own", "orders", "lineitem", "items.l_extendedprice > o_totalprice", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)")
rql("deep_links", "customer", "orders lineitem part", "ANY orders.items.part.p_size == 50", "c_custkey c_name", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND p_size = 50)")
rql("backlink_path", "nation", "customer", "@links.customer.nation.c_acctbal > 9900", "n_nationkey n_name", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
rql("backlink_count", "customer", "orders", "@links.orders.customer.@count == 0 or orders.@count > 15", "c_custkey c_name", "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) = 0 OR n > 15")
rql("backlink_count_all", "nation", "customer supplier", "@links.@count > 5", "n_nationkey n_name", "SELECT n_nationkey, n_name FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 5")
rql("links_sum", "orders", "lineitem", "items.@sum.l_extendedprice > 200000", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) > 200000")
rql("links_min_max", "orders", "lineitem", "items.@min.l_quantity >= 10 and items.@max.l_quantity < 40", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (SELECT min(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) >= 10 AND (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) < 40")
rql("links_average", "orders", "lineitem", "items.@avg.l_quantity > 40", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) > 40")
rql("subquery_count", "orders", "lineitem", "SUBQUERY(items, $i, $i.l_returnflag == 'R' && $i.l_quantity > 20).@count >= 2", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 20) >= 2")
rql("subquery_all", "orders", "lineitem", "SUBQUERY(items, $i, $i.l_quantity > 5).@count == items.@count", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5) = (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)")
# -- full text
WORDS_SQL = "list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäçèéêëìíîïñòóôõöùúûüý×÷', 'aaaaaceeeeiiiinooooouuuuy'), '[^0-9a-zåæðøþß]+'), lambda x: x <> '')"
rql("fulltext_and", "documents", "", "text TEXT 'idiot clown'", "doc_id source", f"SELECT doc_id, source FROM documents WHERE list_contains({WORDS_SQL}, 'idiot') AND list_contains({WORDS_SQL}, 'clown')")
rql("fulltext_exclude", "documents", "", "text TEXT 'idiot -moron'", "doc_id source", f"SELECT doc_id, source FROM documents WHERE list_contains({WORDS_SQL}, 'idiot') AND NOT list_contains({WORDS_SQL}, 'moron')")
rql("fulltext_prefix", "documents", "", "text TEXT 'disgust*'", "doc_id source", f"SELECT doc_id, source FROM documents WHERE len(list_filter({WORDS_SQL}, lambda x: starts_with(x, 'disgust'))) > 0")
# -- lists, dynamic values
rql("list_any", "embeddings", "", "ANY embedding > 0.45", "vec_id label", "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > CAST(0.45 AS FLOAT))) > 0")
rql("list_all", "embeddings", "", "ALL embedding BETWEEN {-0.3, 0.3}", "vec_id label", "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT x BETWEEN CAST(-0.3 AS FLOAT) AND CAST(0.3 AS FLOAT))) = 0")
rql("list_index", "embeddings", "", "embedding[0] > 0.1 and embedding[LAST] < 0", "vec_id label", "SELECT vec_id, label FROM embeddings WHERE embedding[1] > CAST(0.1 AS FLOAT) AND embedding[-1] < 0")
rql("list_size", "embeddings", "", "embedding.@size == 64", "vec_id label", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
rql("list_aggregate", "embeddings", "", "embedding.@max > 0.4 and embedding.@min < -0.3", "vec_id label", "SELECT vec_id, label FROM embeddings WHERE list_max(embedding) > CAST(0.4 AS FLOAT) AND list_min(embedding) < CAST(-0.3 AS FLOAT)")
rql("mixed_path", "events", "", "props.k > 50", "event_id user_id", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
rql("mixed_type", "events", "", "props.k.@type == 'int' and props.@type == 'object'", "event_id user_id", "SELECT event_id, user_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND json_type(props) = 'OBJECT'")
# -- orderings
rql("sort_limit", "orders", "", "TRUEPREDICATE SORT(o_totalprice DESC, o_orderkey ASC) LIMIT(50)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
rql("sort_merged", "orders", "", "TRUEPREDICATE SORT(o_totalprice DESC) SORT(o_orderstatus ASC) LIMIT(40)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40")
rql("sort_by_link", "orders", "customer nation", "TRUEPREDICATE SORT(customer.nation.n_name ASC, o_orderkey DESC) LIMIT(30)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name NULLS LAST, o_orderkey DESC LIMIT 30")
rql("distinct_first", "orders", "", "TRUEPREDICATE SORT(o_totalprice DESC) DISTINCT(o_custkey)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
rql("distinct_over_link", "orders", "customer", "o_totalprice > 100000 DISTINCT(customer.c_mktsegment, o_orderstatus)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY c_mktsegment, o_orderstatus ORDER BY o_orderkey) = 1")
rql("limit_then_sort", "orders", "", "TRUEPREDICATE SORT(o_orderdate ASC) LIMIT(100) SORT(o_totalprice DESC) LIMIT(10)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100) ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 10")
rql("flagship", "orders", DEEP, "o_totalprice > 100000 AND customer.nation.n_name BEGINSWITH 'NATION_1' SORT(o_totalprice DESC, o_orderkey ASC) LIMIT(100)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 AND starts_with(n_name, 'NATION_1') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")


@add("filter_by_function", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey > 100 AND o_orderkey % 100 = 0")
def filter_by_function(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "orders"), "orders", "o_custkey > 100").keep(lambda df: F.col("o_orderkey") % 100 == 0).df().select(*ORD.split())


@add("results_refined", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def results_refined(spark, sf_dir):
    """A filter after a distinct joins the predicate below it."""
    return Results(tables.star(spark, sf_dir, "orders"), "orders", "o_orderstatus == 'F'").sort("o_orderdate").distinct("o_custkey").filter("o_totalprice > $0", 50000).df().select(*ORD.split())


# -- aggregates


@add("aggregates", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS least, max(l_shipdate) AS latest, round(avg(l_discount), 9) AS mean, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_returnflag = 'R'")
def aggregates(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "lineitem"), "lineitem", "l_returnflag == 'R'")
    got = r.aggregates(n=("count", ""), total=("sum", "l_extendedprice"), least=("min", "l_quantity"), latest=("max", "l_shipdate"), mean=("avg", "l_discount"), lines=("sum", "l_linenumber"))
    return got.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 9)})


@add("aggregates_over_link", "SELECT round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def aggregates_over_link(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "orders", "customer"), "orders", "o_totalprice > 200000")
    got = r.aggregates(total=("sum", "customer.c_acctbal"), mean=("avg", "customer.c_acctbal"))
    return got.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@add("aggregates_of_limit", "SELECT count(*) AS n, min(o_totalprice) AS least FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def aggregates_of_limit(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "orders"), "orders", "TRUEPREDICATE SORT(o_totalprice DESC) LIMIT(25)").aggregates(n=("count", ""), least=("min", "o_totalprice"))


@add("aggregates_of_none", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total, max(o_totalprice) AS most FROM orders WHERE o_orderkey < 0")
def aggregates_of_none(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "orders"), "orders", "o_orderkey < 0").aggregates(n=("count", ""), total=("sum", "o_totalprice"), most=("max", "o_totalprice"))


@add("argmax", "SELECT o_orderkey, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def argmax(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "orders"), "orders").at_extreme("o_totalprice")


@add("unique_values", "SELECT count(DISTINCT p_brand) AS unique_values FROM part")
def unique_values(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "part"), "part").unique_values("p_brand")


@add("sections", "SELECT section, (dense_rank() OVER (ORDER BY first_row) - 1)::INT AS section_no, (row_number() OVER (PARTITION BY section ORDER BY pos) - 1)::INT AS row_no, o_orderkey FROM (SELECT *, min(pos) OVER (PARTITION BY section) AS first_row FROM (SELECT left(o_orderpriority, 1) AS section, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F'))")
def sections(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "orders"), "orders", "o_orderstatus == 'F'").sort("o_totalprice")
    return r.sections("first_letter", "o_orderpriority").select("section", "section_no", "row_no", "o_orderkey")


# -- sets, lists, dictionaries


def _sizes(spark, sf_dir):
    """Line numbers and quantities of each order as sets."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.collect_set(F.col("l_quantity").cast("bigint"))
    return items.groupBy("l_orderkey").agg(sets.make(F.collect_set(F.col("l_linenumber").cast("bigint"))).alias("a"), sets.make(q).alias("b"))


_SETS = "(SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS BIGINT)))) AS a, list_sort(list_distinct(list(CAST(l_quantity AS BIGINT)))) AS b FROM lineitem GROUP BY 1)"


@add("set_algebra", f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS uni, array_to_string(list_sort(list_intersect(a, b)), ',') AS inter, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS minus, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS sym FROM {_SETS}")
def set_algebra(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    ops = {"uni": sets.union, "inter": sets.intersection, "minus": sets.difference, "sym": sets.symmetric_difference}
    return _sizes(spark, sf_dir).select("l_orderkey", *[F.array_join(fn(a, b), ",").alias(n) for n, fn in ops.items()])


@add("set_tests", f"SELECT l_orderkey, list_has_all(b, a) AS sub, list_has_all(b, a) AND len(b) > len(a) AS strict_sub, list_has_all(a, b) AS super, list_has_all(a, b) AND len(a) > len(b) AS strict_super, list_has_any(a, b) AS meets, list_has_all(b, a) AND list_has_all(a, b) AS same FROM {_SETS}")
def set_tests(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    ops = {"sub": sets.is_subset, "strict_sub": sets.is_strict_subset, "super": sets.is_superset, "strict_super": sets.is_strict_superset, "meets": sets.intersects, "same": sets.equals}
    return _sizes(spark, sf_dir).select("l_orderkey", *[fn(a, b).alias(n) for n, fn in ops.items()])


@add("list_edits", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, CAST(list_position(embedding, embedding[5]) - 1 AS INT) AS at, CAST(embedding[3] AS DOUBLE) AS removed, CAST(embedding[1] AS DOUBLE) AS swapped, CAST(list_sort(embedding)[1] AS DOUBLE) AS least FROM embeddings")
def list_edits(spark, sf_dir):
    e = F.col("embedding")
    d = lambda c, n: c.cast("double").alias(n)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", d(lists.first(e), "first"), d(lists.last(e), "last"), lists.find(e, F.get(e, F.lit(4))).cast("int").alias("at"), d(lists.get(lists.remove(e, 1), 1), "removed"), d(lists.get(lists.swap(e, 0, 9), 9), "swapped"), d(lists.get(lists.ordered(e), 0), "least")
    )


@add("dictionary_keys", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS keys, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f FROM orders GROUP BY 1")
def dictionary_keys(spark, sf_dir):
    by = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    d = by.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("d"))
    return d.select("o_custkey", F.array_join(lists.sorted_keys(F.col("d")), ",").alias("keys"), F.round(F.try_element_at("d", F.lit("F")), 2).alias("f"))


# -- places: each customer at a point made of its key
_POINT = "SELECT c_custkey, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 13 % 180 - 90 AS DOUBLE) AS lat FROM customer"


def _places(spark, sf_dir, where: str, *args):
    cat = tables.star(spark, sf_dir, "customer")
    c = cat.get("customer").frame
    point = F.struct(F.lit("Point").alias("type"), F.array((F.col("c_custkey") * 7 % 360 - 180).cast("double"), (F.col("c_custkey") * 13 % 180 - 90).cast("double")).alias("coordinates"))
    cat.add("place", c.select("c_custkey", point.alias("location")), "c_custkey", [Property("location", "point")])
    return Results(cat, "place", where, args=args).df().select("c_custkey")


@add("geo_circle", f"SELECT c_custkey FROM ({_POINT}) WHERE 2 * asin(sqrt(sin(radians(lat - 20.5) / 2) ** 2 + cos(radians(lat)) * cos(radians(20.5)) * sin(radians(lon - 10.5) / 2) ** 2)) <= 0.4")
def geo_circle(spark, sf_dir):
    return _places(spark, sf_dir, "location GEOWITHIN geoCircle([10.5, 20.5], 0.4)")


def _crossings(*rings) -> str:
    """Points inside rings by counting the great circles above them: another way than the operator's."""
    edges = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for r in rings for a, b in zip(r, r[1:]))
    arc = "degrees(atan((tan(radians(y1)) * sin(radians(x2 - lon)) + tan(radians(y2)) * sin(radians(lon - x1))) / sin(radians(x2 - x1))))"
    return f"SELECT c_custkey FROM ({_POINT}) JOIN (VALUES {edges}) e(x1, y1, x2, y2) ON (x1 <= lon) <> (x2 <= lon) AND lat < {arc} GROUP BY 1 HAVING count(*) % 2 = 1"


_BOX = ((-30.5, -20.5), (40.5, -20.5), (40.5, 35.5), (-30.5, 35.5), (-30.5, -20.5))
_RING = ((-60.5, -30.5), (60.5, -30.5), (0.5, 60.5), (-60.5, -30.5))
_HOLE = ((-10.5, -10.5), (10.5, -10.5), (0.5, 10.5), (-10.5, -10.5))


@add("geo_box", _crossings(_BOX))
def geo_box(spark, sf_dir):
    return _places(spark, sf_dir, "location GEOWITHIN geoBox([-30.5, -20.5], [40.5, 35.5])")


@add("geo_polygon", _crossings(_RING, _HOLE))
def geo_polygon(spark, sf_dir):
    return _places(spark, sf_dir, "location GEOWITHIN $0", Shape("polygon", (_RING, _HOLE)))


# -- text


@add("fulltext_terms", f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) GROUP BY 1")
def fulltext_terms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(text.terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# -- writes


@add("update_where", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(spark, sf_dir):
    return edits.update(tables.star(spark, sf_dir, "customer"), "customer", "c_mktsegment == 'BUILDING'", {"c_acctbal": F.col("c_acctbal") + 100}).select("c_custkey", "c_acctbal")


@add("remove_where", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT o_totalprice < 100000")
def remove_where(spark, sf_dir):
    return edits.remove(tables.star(spark, sf_dir, "orders"), "orders", "o_totalprice < 100000").select(*ORD.split())


@add("create_with_key", "SELECT coalesce(n.k, s_suppkey) AS s_suppkey, CASE WHEN n.k IS NOT NULL THEN n.b ELSE s_acctbal END AS s_acctbal FROM supplier FULL JOIN (SELECT p_partkey AS k, p_retailprice AS b FROM part) n ON n.k = s_suppkey")
def create_with_key(spark, sf_dir):
    new = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("s_suppkey"), F.col("p_retailprice").alias("s_acctbal"))
    return edits.create(spark.read.parquet(f"{sf_dir}/supplier.parquet"), new, "s_suppkey", "all").select("s_suppkey", "s_acctbal")


@add("nullify_links", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE coalesce(c_custkey, -1) END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nullify_links(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders", "customer")
    return edits.cascade(cat, "customer", edits.remove(cat, "customer", "c_mktsegment == 'BUILDING'"))["orders"].select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


# -- changes


@add("change_set", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insertion' WHEN b.o_orderkey IS NULL THEN 'deletion' ELSE 'modification' END AS change FROM (SELECT * FROM orders WHERE o_totalprice > 100000) a FULL JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 3 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus")
def change_set(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    new = o.where("o_custkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changes.diff(o.where("o_totalprice > 100000"), new, "o_orderkey").select("o_orderkey", "change")


@add("last_writer_wins", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_writer_wins(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    base = lambda op, field, value, time: e.select(F.lit("user").alias("table"), F.col("user_id").cast("string").alias("key"), F.lit(op).alias("op"), F.lit(field).alias("field"), value.alias("value"), F.lit(0).cast("bigint").alias("delta"), time.alias("time"), F.col("event_id").alias("origin"), F.lit(False).alias("default"))
    log = base("create", "", F.lit(None).cast("string"), F.lit(0).cast("bigint")).union(base("update", "last", F.col("event_type"), at))
    return instructions.registers(log).select("key", "value")


@add("set_merge", "SELECT CAST(user_id AS VARCHAR) AS key, array_to_string(list_sort(list(event_type)), ',') AS elements FROM (SELECT user_id, event_type, arg_max(value > 50, (ts, event_id)) AS there FROM events GROUP BY 1, 2) WHERE there GROUP BY 1")
def set_merge(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = [F.lit("user").alias("table"), F.col("user_id").cast("string").alias("key")]
    end = [F.lit(0).cast("bigint").alias("delta"), at.alias("time"), F.col("event_id").alias("origin"), F.lit(False).alias("default")]
    made = e.select(*own, F.lit("create").alias("op"), F.lit("").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("delta"), F.lit(-(1 << 62)).alias("time"), F.col("event_id").alias("origin"), F.lit(False).alias("default"))
    log = made.union(e.select(*own, F.when(F.col("value") > 50, "set_insert").otherwise("set_erase").alias("op"), F.lit("types").alias("field"), F.col("event_type").alias("value"), *end))
    return instructions.sets(log).select("key", F.array_join("elements", ",").alias("elements"))


# -- JSON


@add("json_export", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def json_export(spark, sf_dir):
    return text_files.to_json(spark.read.parquet(f"{sf_dir}/nation.parquet"))


@add("xjson_export", "SELECT '{\"n_nationkey\":{\"$numberLong\":\"' || n_nationkey || '\"},\"n_name\":\"' || n_name || '\",\"n_regionkey\":{\"$link\":{\"table\":\"region\",\"key\":{\"$numberLong\":\"' || n_regionkey || '\"}}}}' AS json FROM nation")
def xjson_export(spark, sf_dir):
    return text_files.to_json(spark.read.parquet(f"{sf_dir}/nation.parquet"), "xjson_plus", {"n_regionkey": "region"})


# -- other names, lists of links, views, dictionaries in orderings


@add("alias_path", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 150000")
def alias_path(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders", "customer")
    cat.alias("orders", "segment", "customer.c_mktsegment")
    cat.alias("orders", "price", "o_totalprice")
    return Results(cat, "orders", "segment == 'BUILDING' && price > 150000").df().select(*ORD.split())


def _baskets(spark, sf_dir):
    """Orders with the list of their parts, repeats included."""
    cat = tables.star(spark, sf_dir, "part", "lineitem")
    baskets = cat.get("lineitem").frame.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("part_keys"))
    cat.add("basket", baskets, "l_orderkey", [Property("parts", "links", "part_keys", "part")])
    return cat


@add("link_list_sum", "SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING sum(p_size) > 150")
def link_list_sum(spark, sf_dir):
    """A part that a list holds twice counts twice."""
    return Results(_baskets(spark, sf_dir), "basket", "parts.@sum.p_size > 150").df().select("l_orderkey")


@add("link_list_backlinks", "SELECT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > 38")
def link_list_backlinks(spark, sf_dir):
    return Results(_baskets(spark, sf_dir), "part", "@links.basket.parts.@count > 38").df().select("p_partkey")


@add("collection_as_source", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 3) AND p_size > 10")
def collection_as_source(spark, sf_dir):
    return Results(_baskets(spark, sf_dir), "part", "@links.basket.parts.l_orderkey == 3 && p_size > 10").df().select(*PART.split())


@add("view_and_view", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000")
def view_and_view(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders")
    return (Results(cat, "orders", "o_orderstatus == 'O'") & Results(cat, "orders", "o_totalprice < 50000")).df().select(*ORD.split())


@add("sort_by_dictionary_key", "SELECT o_custkey, round(f, 2) AS f FROM (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f FROM orders GROUP BY 1) ORDER BY f DESC NULLS LAST, o_custkey LIMIT 20")
def sort_by_dictionary_key(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders")
    by = cat.get("orders").frame.groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    cat.add("spent", by.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("d")), "o_custkey")
    return Results(cat, "spent", "TRUEPREDICATE SORT(d.F DESC) LIMIT(20)").df().select("o_custkey", F.round(F.try_element_at("d", F.lit("F")), 2).alias("f"))


@add("description_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_totalprice BETWEEN 1000 AND 90000 OR NOT starts_with(lower(o_orderpriority), '1')) AND o_custkey IN (1, 2, 3, 5, 8, 13, 21)")
def description_round_trip(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders")
    first = Results(cat, "orders", "(o_totalprice BETWEEN {1000, 90000} || !(o_orderpriority BEGINSWITH[c] '1')) && o_custkey IN $0", args=[[1, 2, 3, 5, 8, 13, 21]])
    return Results(cat, "orders", str(first)).df().select(*ORD.split())


@add("fluent_chain", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25 AND p_size < 20 AND l_returnflag <> 'N'")
def fluent_chain(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "lineitem", "part"), "lineitem").filter("l_quantity > $0", 25).filter("part.p_size < 20").filter("l_returnflag != 'N'")
    return r.aggregates(n=("count", ""), total=("sum", "l_extendedprice")).withColumn("total", F.round("total", 2))


#: Places in two orders of all orders: by price, and with every fiftieth order behind all others.
_PLACES = "SELECT o_orderkey, o_orderkey % 50 = 0 AS moved, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey % 50 = 0, o_totalprice, o_orderkey) AS b FROM orders"


@add("change_moves", f"SELECT o_orderkey, a AS \"from\", b AS \"to\" FROM ({_PLACES}) WHERE moved AND a < (SELECT max(a) FROM ({_PLACES}) WHERE NOT moved)")
def change_moves(spark, sf_dir):
    """The fewest moves: the orders that went to the end, but for those that stood there."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 50 == 0).alias("moved"))
    return changes.moves(*[changes.ranks(o, by, "at", ["o_orderkey"]) for by in (["x", "o_orderkey"], ["moved", "x", "o_orderkey"])], "o_orderkey", "at")


@add("rank_changes", "SELECT o_orderkey, a AS \"from\", b AS \"to\" FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice / 2 ELSE o_totalprice END, o_orderkey) AS b FROM orders) WHERE a <> b")
def rank_changes(spark, sf_dir):
    """Every order whose rank by price changes when some prices are halved."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rank = lambda x, at: changes.ranks(o.select("o_orderkey", x.alias("x")), ["x", "o_orderkey"], at, ["o_orderkey"])
    both = rank(F.col("o_totalprice"), "from").join(rank(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")), "to"), "o_orderkey")
    return both.where("`from` <> `to`")


@add("live_query_changes", "WITH a AS (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN o_totalprice + 20000 ELSE o_totalprice END AS p FROM orders) SELECT b.o_orderkey, CASE WHEN coalesce(a.p > 200000, false) THEN 'modification' ELSE 'insertion' END AS change FROM b LEFT JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.p > 200000 AND b.p IS DISTINCT FROM CASE WHEN a.p > 200000 THEN a.p END")
def live_query_changes(spark, sf_dir):
    """A live query over a stream of all orders, in two micro-batches that overlap; the change set that the second one makes."""
    root = _folder(spark, "live")
    live, o = changes.Live(spark, root), spark.read.parquet(f"{sf_dir}/orders.parquet")
    live.subscriptions.put(changes.LiveQuery("large", lambda t: Results(_one(spark, t["orders"]), "orders", "o_totalprice > 200000").df().select(*ORD.split()), "o_orderkey", frozenset({"orders"})))
    for part, rows in enumerate((o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0 OR o_orderkey % 2 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 20000))):
        rows.withColumn("seq", F.lit(part)).write.mode("overwrite").parquet(f"{root}/in/{part}")
        stream = spark.readStream.schema(rows.withColumn("seq", F.lit(part)).schema).parquet(f"{root}/in/{part}")
        stream.writeStream.foreachBatch(live.apply("orders", "o_orderkey", "seq")).option("checkpointLocation", f"{root}/cp/{part}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(live.path("changes_large", live.versions["query_large"])).select("o_orderkey", "change")


def _one(spark, frame):
    cat = Catalog(spark)
    cat.add("orders", frame, "o_orderkey")
    return cat


# -- views, positions, objects in the order of their class


def _top(spark, sf_dir) -> Results:
    return Results(tables.star(spark, sf_dir, "orders"), "orders", "TRUEPREDICATE SORT(o_totalprice DESC) LIMIT(300)")


_TOP = "(SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300)"


@add("view_of_limited_view", f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_TOP} WHERE o_orderstatus = 'F'")
def view_of_limited_view(spark, sf_dir):
    """A query over a view sees only what the view's limit leaves."""
    return _top(spark, sf_dir).query("o_orderstatus == 'F'").df().select(*ORD.split())


@add("view_within_view", f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_TOP} WHERE o_orderkey IN (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)")
def view_within_view(spark, sf_dir):
    top = _top(spark, sf_dir)
    return (top & Results(top.catalog, "orders").distinct("o_custkey")).df().select(*ORD.split())


@add("view_or_view", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM {_TOP}) OR o_totalprice < 5000")
def view_or_view(spark, sf_dir):
    top = _top(spark, sf_dir)
    return (top | Results(top.catalog, "orders", "o_totalprice < 5000")).df().select(*ORD.split())


@add("object_at_position", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 300")
def object_at_position(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "orders"), "orders", "o_orderstatus == 'O'").sort("o_totalprice")
    return spark.createDataFrame([r.get(300)], r.cls.frame.schema).select(*ORD.split())


@add("last_and_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS at FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) = count(*) OVER ()")
def last_and_index(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "orders"), "orders").sort(("o_orderdate", False))
    last = r.last()
    return spark.createDataFrame([(last.o_orderkey, r.index_of(last.o_orderkey))], "o_orderkey long, at long")


rql("keyless_distinct", "lineitem", "", "l_quantity > 20 DISTINCT(l_partkey)", ITEM, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 20 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
rql("keyless_limit", "lineitem", "", "l_quantity > 20 LIMIT(500)", ITEM, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 500")
rql("filter_not_in", "part", "", "!(p_size IN {1, 5, 9} || p_brand == 'Brand#11' || p_size > 40)", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size NOT IN (1, 5, 9) AND p_brand <> 'Brand#11' AND p_size <= 40")
rql("literals", "part", "", "(p_size == 0x10 || p_size == +7 || p_retailprice > 1.5e3f) && p_retailprice < +infinity && p_size != NaN", PART, "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (16, 7) OR p_retailprice > 1500")
rql("literal_dates", "orders", "", "o_orderdate >= T820454400:0 && o_orderdate < 1997-02-03T00:00:00:500", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-02-03'")
rql("find_first_null", "orders", "", "o_orderstatus == NULL LIMIT(1)", ORD, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IS NULL ORDER BY o_orderkey LIMIT 1")


@add("argument_path", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def argument_path(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "orders", "customer"), "orders", "$K0 == $1 && $K2 == 'F'", args=["customer.c_mktsegment", "BUILDING", "o_orderstatus"]).df().select(*ORD.split())


@add("query_counts", "SELECT count(*) AS query, least(count(*), 25) AS results, count(*) FILTER (o_custkey = 7) AS equal FROM orders WHERE o_totalprice > 100000")
def query_counts(spark, sf_dir):
    """What a query counts ignores its limit, what results count doesn't."""
    r = Results(tables.star(spark, sf_dir, "orders"), "orders", "o_totalprice > 100000 LIMIT(25)")
    return spark.createDataFrame([(r.query_count(), r.count(), Results(r.catalog, "orders", r.where).count_equal("o_custkey", 7))], "query long, results long, equal long")


@add("backlink_view", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 50000")
def backlink_view(spark, sf_dir):
    return Results(tables.star(spark, sf_dir, "customer", "orders"), "customer").backlinks(7, "orders", "customer").filter("o_totalprice > 50000").df().select(*ORD.split())


@add("backlink_view_of_lists", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 5")
def backlink_view_of_lists(spark, sf_dir):
    return Results(_baskets(spark, sf_dir), "part").backlinks(5, "basket", "parts").df().select("l_orderkey")


@add("schema_merge", "SELECT 'log' AS \"table\", event_type AS field, CAST(max_by(user_id, (ts, event_id)) AS VARCHAR) AS type FROM events GROUP BY 2 HAVING max_by(value > 10, (ts, event_id))")
def schema_merge(spark, sf_dir):
    """Columns that writers added and erased: the last instruction on each decides."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = e.select(F.lit("log").alias("table"), F.lit("").alias("key"), F.when(F.col("value") > 10, "add_column").otherwise("erase_column").alias("op"), F.col("event_type").alias("field"), F.col("user_id").cast("string").alias("value"), F.lit(0).cast("bigint").alias("delta"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("origin"), F.lit(False).alias("default"))
    made = own.limit(1).withColumns({"op": F.lit("add_table"), "field": F.lit(""), "time": F.lit(0).cast("bigint")})
    return instructions.schema(made.union(own))


# -- predicates without text


@add("fluent_builder", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 25 AND (p_brand = 'Brand#11' OR starts_with(p_type, 'S') OR p_retailprice > 1500) AND NOT ends_with(p_name, '3') AND strlen(p_type) < 10")
def fluent_builder(spark, sf_dir):
    w = Where().between("p_size", 5, 25).group().equal("p_brand", "Brand#11").Or().begins_with("p_type", "S").Or().greater("p_retailprice", 1500.0).end_group().Not().ends_with("p_name", "3").size_less("p_type", 10)
    return Results(tables.star(spark, sf_dir, "part"), "part", w).df().select(*PART.split())


@add("expression_operators", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_totalprice * 2 > 300000 OR c_mktsegment = 'BUILDING') AND NOT o_orderstatus = 'F' AND (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) >= 2")
def expression_operators(spark, sf_dir):
    many = Prop("items").where(Prop("l_quantity") > 30)
    test = ((Prop("o_totalprice") * 2 > 300000) | (Prop("customer.c_mktsegment") == "BUILDING")) & ~(Prop("o_orderstatus") == "F") & (many >= 2) & Prop("customer").is_not_null()
    return Results(tables.star(spark, sf_dir, "orders", "customer", "lineitem"), "orders", test).df().select(*ORD.split())


@add("functional_facade", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS most FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 50")
def functional_facade(spark, sf_dir):
    query = functional.query_append_query(functional.query_parse(tables.star(spark, sf_dir, "orders"), "orders", "o_orderstatus == $0", "O"), "o_custkey > 50")
    return spark.createDataFrame([(functional.query_count(query), round(functional.results_sum(query, "o_totalprice"), 2), functional.results_max(query, "o_totalprice"))], "n long, total double, most double")


# -- collections of an object


@add("list_as_source", "SELECT p_partkey, p_name, p_size, CAST(pos - 1 AS INT) AS position FROM (SELECT unnest(parts) AS part_key, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT list_sort(list(l_partkey)) AS parts FROM lineitem WHERE l_orderkey = 3)) JOIN part ON p_partkey = part_key WHERE p_size > 10")
def list_as_source(spark, sf_dir):
    """The objects of one order's list with their positions, repeats included."""
    return List(_baskets(spark, sf_dir), "basket", 3, "parts").query("p_size > 10").select(*PART.split(), "position")


@add("list_facade", "SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey = 3 THEN list_concat([parts[len(parts)]], parts[1:len(parts) - 1]) ELSE parts END, ',') AS parts FROM (SELECT l_orderkey, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1)")
def list_facade(spark, sf_dir):
    """The last part of one order's list moved to its front."""
    own = List(_baskets(spark, sf_dir), "basket", 3, "parts")
    return own.move(own.size() - 1, 0).select("l_orderkey", F.array_join("part_keys", ",").alias("parts"))


@add("set_facade", f"SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey = 3 THEN list_sort(list_distinct(list_concat(a, [2, 99]))) ELSE a END, ',') AS a FROM {_SETS}")
def set_facade(spark, sf_dir):
    cat = Catalog(spark)
    cat.add("sizes", _sizes(spark, sf_dir), "l_orderkey")
    return Set(cat, "sizes", 3, "a").assign_union([2, 99]).select("l_orderkey", F.array_join("a", ",").alias("a"))


def _spent(spark, sf_dir) -> Catalog:
    cat = tables.star(spark, sf_dir, "orders")
    by = cat.get("orders").frame.groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    cat.add("spent", by.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("d")), "o_custkey")
    return cat


@add("dictionary_facade", "SELECT key, round(v, 2) AS value FROM (SELECT o_orderstatus AS key, sum(o_totalprice) AS v FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'new', 1.5)")
def dictionary_facade(spark, sf_dir):
    cat = _spent(spark, sf_dir)
    for edit in (lambda d: d.insert("new", 1.5), lambda d: d.erase("P")):
        cat.add("spent", edit(Dictionary(cat, "spent", 7, "d")), "o_custkey")
    return Dictionary(cat, "spent", 7, "d").values().select("key", F.round("value", 2).alias("value"))


@add("keys_and_values", "SELECT o_custkey FROM (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING bool_or(o_orderstatus = 'P') AND bool_or(v > 900000)")
def keys_and_values(spark, sf_dir):
    return Results(_spent(spark, sf_dir), "spent", "d.@keys == 'P' && d.@values > 900000").df().select("o_custkey")


@add("length_of_elements", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: strlen(x) > 6)) > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: strlen(x) <= 3)) = 0")
def length_of_elements(spark, sf_dir):
    cat = Catalog(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cat.add("words", part.select("p_partkey", F.split("p_type", " ").alias("kinds"), F.split("p_name", " ").alias("names")), "p_partkey")
    return Results(cat, "words", "kinds.length > 6 && ALL names.length > 3").df().select("p_partkey")


@add("order_of_elements", "SELECT vec_id, CAST(list_grade_up(embedding)[1] - 1 AS INT) AS least, CAST(list_grade_up(embedding)[-1] - 1 AS INT) AS most, CAST(len(list_distinct(list_transform(embedding, lambda x: round(x * 10)))) AS INT) AS kinds FROM embeddings")
def order_of_elements(spark, sf_dir):
    e = F.col("embedding")
    at = lists.sorted_positions(e)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", lists.first(at).alias("least"), lists.last(at).alias("most"), F.size(lists.distinct_positions(F.transform(e, lambda x: F.round(x * 10)))).alias("kinds"))


# -- stored terms


@add("fulltext_stored", f"SELECT doc_id, source FROM documents WHERE list_contains({WORDS_SQL}, 'idiot') AND list_contains({WORDS_SQL}, 'clown')")
def fulltext_stored(spark, sf_dir):
    """As ``fulltext_and``, over terms stored once."""
    cat = tables.index_text(tables.star(spark, sf_dir, "documents"), "documents", "text", _folder(spark, "terms"))
    return Results(cat, "documents", "text TEXT 'idiot clown'").df().select("doc_id", "source")


@add("term_weights", f"SELECT doc_id, count(*) AS terms, round(sum((2 - 2 ** (1 - n)) * (0.5 * n / total + 0.5)), 6) AS weight FROM (SELECT doc_id, word, count(*) AS n, any_value(total) AS total FROM (SELECT doc_id, unnest(ws) AS word, len(ws) AS total FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents)) GROUP BY 1, 2) GROUP BY 1")
def term_weights(spark, sf_dir):
    d, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), _folder(spark, "again")
    # Where an id has one text, that is all there is to count. The ids of several are written first, so that joins know how few they are and don't shuffle texts.
    d.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again")).write.parquet(path)
    again, same = spark.read.schema(d.select(F.col("doc_id").alias("again")).schema).parquet(path), F.col("doc_id").eqNullSafe(F.col("again"))
    once = d.join(again, same, "left_anti").select("doc_id", F.inline_outer(F.array(text.term_weights(F.col("text"))))).where("terms IS NOT NULL")
    words = d.join(again, same, "left_semi").select("doc_id", text.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("total"), F.explode_outer("t").alias("w")).where("w IS NOT NULL")
    n = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    weight = (2 - F.pow(F.lit(2.0), 1 - F.col("n"))) * (0.5 * F.col("n") / F.col("total") + 0.5)
    return once.union(n.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum(weight).alias("weight"))).withColumn("weight", F.round("weight", 6))


# -- changes inside of objects


def _orders_after(o):
    return o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))


@add("object_changes", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deletion' ELSE 'modification' END AS change, CASE WHEN o_orderkey % 11 <> 0 THEN 'o_orderstatus' END AS property, CASE WHEN o_orderkey % 11 <> 0 THEN '{\"v\":\"' || o_orderstatus || '\"}' END AS before, CASE WHEN o_orderkey % 11 <> 0 THEN '{\"v\":\"X\"}' END AS after FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 10 = 0")
def object_changes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return notify.object_changes(o, _orders_after(o), "o_orderkey")


@add("list_changes", "SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN '0' ELSE '' END AS deletions, CASE WHEN l_orderkey % 3 = 0 THEN CAST(n - CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) ELSE '' END AS insertions FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) WHERE (l_orderkey % 5 = 0 OR l_orderkey % 3 = 0) AND n > 1")
def list_changes(spark, sf_dir):
    """Lists of parts of which some lose the first part and some get another one at the end."""
    old = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts")).where("size(parts) > 1")
    new = old.withColumn("parts", F.when(F.col("l_orderkey") % 5 == 0, F.slice("parts", F.lit(2), F.size("parts"))).otherwise(F.col("parts")))
    new = new.withColumn("parts", F.when(F.col("l_orderkey") % 3 == 0, F.concat("parts", F.array(F.lit(-1).cast("long")))).otherwise(F.col("parts")))
    got = notify.list_changes(old, new, "l_orderkey", "parts")
    # A position that is deleted and inserted counts as modified: here none is, but for lists of one part that is left.
    both = lambda c: F.array_join(F.array_sort(F.concat(c, "modifications")), ",").alias(c)
    return got.select("l_orderkey", both("deletions"), both("insertions"))


@add("dictionary_changes", "SELECT o_custkey, coalesce(string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (o_orderstatus = 'O' AND o_custkey % 5 = 0), '') AS deletions, coalesce(string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (o_orderstatus = 'F' AND o_custkey % 3 = 0), '') AS modifications FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1 HAVING deletions <> '' OR modifications <> ''")
def dictionary_changes(spark, sf_dir):
    old = _spent(spark, sf_dir).get("spent").frame
    less = F.map_filter("d", lambda k, _: ~((k == "O") & (F.col("o_custkey") % 5 == 0)))
    new = old.withColumn("d", F.transform_values(less, lambda k, v: F.when((k == "F") & (F.col("o_custkey") % 3 == 0), v + 1).otherwise(v)))
    return notify.dictionary_changes(old, new, "o_custkey", "d").select("o_custkey", F.array_join("deletions", ",").alias("deletions"), F.array_join("modifications", ",").alias("modifications"))


@add("section_changes", "SELECT left(o_orderpriority, 1) AS section, CASE WHEN left(o_orderpriority, 1) = '5' THEN 'deletion' ELSE 'modification' END AS change, count(*) FILTER (left(o_orderpriority, 1) = '5' OR o_orderkey % 11 = 0) AS deletions, CAST(0 AS BIGINT) AS insertions, count(*) FILTER (left(o_orderpriority, 1) <> '5' AND o_orderkey % 11 <> 0 AND o_orderkey % 10 = 0) AS modifications FROM orders GROUP BY 1")
def section_changes(spark, sf_dir):
    cat = tables.star(spark, sf_dir, "orders")
    old = Results(cat, "orders").sections("first_letter", "o_orderpriority")
    cat.add("orders", _orders_after(cat.get("orders").frame), "o_orderkey")
    return notify.section_changes(old, Results(cat, "orders", "!(o_orderpriority BEGINSWITH '5')").sections("first_letter", "o_orderpriority"), "o_orderkey")


@add("deep_changes", "SELECT c_custkey, 'modification' AS change, CASE WHEN c_nationkey = 3 AND hit THEN 'nation.n_name,orders.o_totalprice' WHEN hit THEN 'orders.o_totalprice' ELSE 'nation.n_name' END AS columns FROM (SELECT c_custkey, c_nationkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 40 = 0) AS hit FROM customer) WHERE hit OR c_nationkey = 3")
def deep_changes(spark, sf_dir):
    """Customers whose nation's name or whose orders' prices changed, though no customer did."""
    names = ("customer", "nation", "orders")
    old, new = tables.star(spark, sf_dir, *names), tables.star(spark, sf_dir, *names)
    for name, col, hit, value in (("nation", "n_name", F.col("n_nationkey") == 3, F.lit("ELSEWHERE")), ("orders", "o_totalprice", F.col("o_orderkey") % 40 == 0, F.col("o_totalprice") + 1)):
        c = new.get(name)
        new.add(name, c.frame.withColumn(col, F.when(hit, value).otherwise(F.col(col))), c.key, list(c.properties.values()))
    got = notify.deep_changes(Results(old, "customer"), Results(new, "customer"), "nation.n_name", "orders.o_totalprice")
    return got.select("c_custkey", "change", F.array_join(F.array_sort("columns"), ",").alias("columns"))


@add("list_merge", "SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type, ',' ORDER BY ts, event_id) AS elements FROM events GROUP BY 1")
def list_merge(spark, sf_dir):
    """Events appended to their user's list by writers that had seen all before them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    row = lambda op, field, value, delta, time: e.select(F.lit("user").alias("table"), F.col("user_id").cast("string").alias("key"), F.lit(op).alias("op"), F.lit(field).alias("field"), value.alias("value"), F.lit(delta).cast("bigint").alias("delta"), time.alias("time"), F.col("event_id").alias("origin"), F.lit(False).alias("default"))
    log = row("create", "", F.lit(None).cast("string"), 0, F.lit(-(1 << 62))).union(row("list_insert", "types", F.col("event_type"), 1 << 40, at))
    return instructions.lists(log).select("key", F.array_join("elements", ",").alias("elements"))


# -- stores


@add("transactions", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def transactions(spark, sf_dir):
    """A committed write, and one that was rolled back."""
    store, rows = Store(spark, _folder(spark, "store")), spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_acctbal")
    with store.begin() as t:
        t.write("supplier", rows)
        t.commit_and_continue()
        t.write("supplier", t.frame("supplier").withColumn("s_acctbal", F.col("s_acctbal") + 1))
    lost = store.begin()
    lost.write("supplier", rows.limit(0))
    lost.rollback()
    return store.read().frame("supplier")


@add("compact_copy", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def compact_copy(spark, sf_dir):
    store = Store(spark, _folder(spark, "store"))
    with store.begin() as t:
        t.write("nation", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").repartition(7))
    store.compact()
    return store.write_copy(_folder(spark, "copy")).read().frame("nation")


@add("object_copy", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000) AS customers, (SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000) AS nations")
def object_copy(spark, sf_dir):
    """Orders copied to an empty store with the customers and nations that they lead to."""
    names = ("orders", "customer", "nation")
    source, target = tables.star(spark, sf_dir, *names), tables.star(spark, sf_dir, *names)
    for name in names:
        c = target.get(name)
        target.add(name, c.frame.limit(0), c.key, list(c.properties.values()))
    out = edits.copy_into(source, "orders", target, "o_totalprice > 250000")
    n = {name: df.agg(F.count("*").alias("n")) for name, df in out.items()}
    return n["orders"].withColumnRenamed("n", "orders").crossJoin(n["customer"].withColumnRenamed("n", "customers")).crossJoin(n["nation"].withColumnRenamed("n", "nations"))  # three single rows


@add("asymmetric_ingest", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def asymmetric_ingest(spark, sf_dir):
    cat, path = Catalog(spark), _folder(spark, "ingest")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    cat.add("event", rows.limit(0), "event_id", asymmetric=True)
    for _ in range(2):
        edits.ingest(cat, "event", rows, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@add("snapshot", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 700")
def snapshot(spark, sf_dir):
    r = Results(tables.star(spark, sf_dir, "orders"), "orders", "o_orderstatus == 'F'").snapshot(_folder(spark, "snapshot"))
    return r.filter("o_custkey < 700").df().select(*ORD.split())


@add("csv_import", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_import(spark, sf_dir):
    path = _folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.option("header", True).csv(path)
    return text_files.import_csv(spark, path)


@add("json_import", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_import(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return text_files.from_json(e, "props").select("event_id", F.try_variant_get("value", "$.k", "bigint").alias("k"))


@add("bson_round_trip", "SELECT n_nationkey, '{\"n_nationkey\":{\"$numberLong\":\"' || n_nationkey || '\"},\"n_name\":\"' || n_name || '\",\"n_regionkey\":{\"$numberLong\":\"' || n_regionkey || '\"}}' AS json FROM nation")
def bson_round_trip(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text_ = text_files.to_json(n, "xjson").withColumn("n_nationkey", F.regexp_extract("json", r'numberLong":"(\d+)', 1).cast("long"))
    return extended_json.decode(extended_json.encode(text_, "json").drop("json"), "bson").select("n_nationkey", "json")
