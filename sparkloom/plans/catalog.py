"""Classes over DataFrames: properties, links between classes, lists, and other names for both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .tree import QueryError


@dataclass(frozen=True)
class Property:
    """A named property. kind: value, mixed (dynamic, VARIANT or JSON text), point, set, link (to one), links (array of keys) or backlinks."""

    name: str
    kind: str = "value"
    column: str | None = None
    target: str | None = None
    origin: str | None = None  # backlinks: the link property of the target that leads here

    @property
    def col(self) -> str:
        return self.column or self.name


@dataclass
class Class:
    """A class: its rows, the column that tells objects apart (if there is one) and its properties."""

    name: str
    frame: DataFrame
    key: str | None = None
    properties: dict[str, Property] = field(default_factory=dict)
    fulltext: frozenset[str] = frozenset()
    embedded: bool = False
    asymmetric: bool = False  # only ever appended to, and never queried
    natural: tuple[str, ...] = ()  # columns that order the rows of a class without a key
    terms: dict[str, str] = field(default_factory=dict)  # full-text properties whose terms are stored, and the column that has them

    def __post_init__(self):
        for c in self.frame.columns:
            self.properties.setdefault(c, Property(c))
        self.kinds = dict(self.frame.dtypes)

    def find(self, name: str) -> Property:
        if name not in self.properties:
            raise QueryError(f"'{self.name}' has no property '{name}'")
        return self.properties[name]

    @property
    def order(self) -> tuple[str, ...]:
        """Columns that order the rows where nothing else does."""
        return (self.key,) if self.key else self.natural

    def type_of(self, p: Property) -> str:
        return self.kinds[p.col]


class Catalog:
    """All classes. Aliases map a caller's names to (class and) property names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.classes, self.property_alias, self.class_alias = spark, {}, {}, {}

    def add(self, name: str, frame: DataFrame, key: str | None = None, properties: list[Property] = (), **more) -> Class:
        self.classes[name] = c = Class(name, frame, key, {p.name: p for p in properties}, **more)
        return c

    def alias(self, cls: str, alias: str, path: str) -> None:
        self.property_alias[cls, alias] = path.split(".")

    def get(self, name: str) -> Class:
        name = self.class_alias.get(name, name)
        if name not in self.classes:
            raise QueryError(f"No class '{name}'")
        return self.classes[name]

    def expand(self, cls: str, steps: list) -> list:
        """Steps with the first one's aliases resolved, each at most once."""
        seen = set()
        while steps and isinstance(steps[0], str) and (cls, steps[0]) in self.property_alias:
            if steps[0] in seen:
                raise QueryError(f"Substitution loop detected for '{steps[0]}'")
            seen.add(steps[0])
            steps = [*self.property_alias[cls, steps[0]], *steps[1:]]
        return steps

    def backlinks_to(self, cls: str) -> list[tuple[Class, Property]]:
        return [(c, p) for c in self.classes.values() for p in c.properties.values() if p.kind in ("link", "links") and p.target == cls]

    def schema_json(self) -> list[dict]:
        """Classes with their properties, types and links."""
        out = []
        for c in self.classes.values():
            props = []
            for p in c.properties.values():
                kind = c.kinds.get(p.col, "")
                props.append({"name": p.name, "type": p.kind if p.kind != "value" else kind} | ({"target": p.target} if p.target else {}) | ({"origin": p.origin} if p.origin else {}))
            out.append({"name": c.name, "properties": props} | ({"primaryKey": c.key} if c.key else {}) | ({"embedded": True} if c.embedded else {}) | ({"asymmetric": True} if c.asymmetric else {}))
        return out


def compare(old: list[dict], new: list[dict]) -> list[dict]:
    """Changes from one ``schema_json`` to another."""
    a, b, out = {c["name"]: c for c in old}, {c["name"]: c for c in new}, []
    out += [{"change": "add_class", "class": n} for n in b if n not in a]
    out += [{"change": "remove_class", "class": n} for n in a if n not in b]
    for n in a.keys() & b.keys():
        p, q = ({x["name"]: x for x in c[n]["properties"]} for c in (a, b))
        out += [{"change": "add_property", "class": n, "property": x} for x in q if x not in p]
        out += [{"change": "remove_property", "class": n, "property": x} for x in p if x not in q]
        out += [{"change": "change_type", "class": n, "property": x} for x in p.keys() & q.keys() if p[x] != q[x]]
        if a[n].get("primaryKey") != b[n].get("primaryKey"):
            out.append({"change": "change_primary_key", "class": n})
    return sorted(out, key=str)
