"""The driver's tables as linked classes; saving and loading a catalog as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.catalog import Catalog, Property

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations pages benchmark".split()
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}
#: What orders the rows of tables without a key; line numbers repeat within an order.
NATURAL = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "conversations": ("conv_id", "turn")}
LINKS = [
    ("nation", "region", "n_regionkey", "region", "nations"), ("customer", "nation", "c_nationkey", "nation", "customers"), ("supplier", "nation", "s_nationkey", "nation", "suppliers"),
    ("orders", "customer", "o_custkey", "customer", "orders"), ("lineitem", "order", "l_orderkey", "orders", "items"), ("lineitem", "part", "l_partkey", "part", "items"),
    ("lineitem", "supplier", "l_suppkey", "supplier", "items"), ("labels", "document", "doc_id", "documents", "labels"),
]


class Lazy(dict):
    """Tables that are opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def star(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """A catalog of the named tables (all by default) with the links among them, each with its inverse."""
    out, tables = Catalog(spark), Lazy(spark, sf_dir)
    names = names or TABLES
    for name in names:
        props = [Property(p, "link", c, t) for n, p, c, t, _ in LINKS if n == name and t in names]
        props += [Property(back, "backlinks", target=n, origin=p) for n, p, _, t, back in LINKS if t == name and n in names]
        if name == "events":
            props.append(Property("props", "mixed"))
        out.add(name, tables[name], KEYS.get(name), props, fulltext=frozenset({"text"} if name == "documents" else ()), natural=NATURAL.get(name, ()))
    return out


def save(catalog: Catalog, path: str) -> None:
    for name, c in catalog.classes.items():
        c.frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, like: Catalog) -> Catalog:
    """A saved catalog, with the properties of ``like``."""
    out = Catalog(spark)
    for name, c in like.classes.items():
        out.add(name, spark.read.parquet(f"{path}/{name}"), c.key, list(c.properties.values()), fulltext=c.fulltext, embedded=c.embedded, asymmetric=c.asymmetric, natural=c.natural, terms=c.terms)
    out.property_alias, out.class_alias = like.property_alias, like.class_alias
    return out


def index_text(catalog: Catalog, cls: str, prop: str, path: str) -> Catalog:
    """``catalog`` with the full-text terms of a property stored beside its class, so that ``TEXT`` reads terms instead of taking texts apart.

    The class is written to ``path`` once with a column of distinct terms; only searches read that column.
    """
    c = catalog.get(cls)
    name = f"__terms_{prop}"
    own = c.frame.withColumn(name, F.array_distinct(text.terms(F.col(f"`{c.find(prop).col}`"))))
    own.write.mode("overwrite").parquet(path)
    out = Catalog(catalog.spark)
    out.classes = dict(catalog.classes)
    out.property_alias, out.class_alias = catalog.property_alias, catalog.class_alias
    stored = catalog.spark.read.parquet(path)
    out.add(cls, stored, c.key, list(c.properties.values()), fulltext=c.fulltext | {prop}, embedded=c.embedded, natural=c.natural, terms=c.terms | {prop: name})
    return out
