"""SQL views over patterns of tables, registered factories, and a catalog of dynamic tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import joins, transforms
from strandline.plans import reduce
from strandline.plans.scratch import Store


class FactoryRegistry:
    """Builders of derived tables by name; their configuration has no unknown keys."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, frozenset[str]]] = {}

    def register(self, name: str, keys: str):
        def keep(f):
            self.known[name] = (f, frozenset(keys.split()))
            return f

        return keep

    def create(self, name: str, catalog: Catalog, config: dict) -> DataFrame:
        if name not in self.known:
            raise ValueError(f"unknown factory {name!r}")
        build, keys = self.known[name]
        if unknown := set(config) - keys:
            raise ValueError(f"{name} doesn't know {sorted(unknown)}")
        return build(catalog, config)


FACTORIES = FactoryRegistry()


class Catalog:
    """Named tables and dynamic tables, which are built when first asked for; directories are names with slashes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.dynamic: dict[str, tuple[str, dict]] = {}

    def add(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def define(self, name: str, factory: str, config: dict) -> None:
        """A dynamic table, or with dynamic-dir a directory of them: entries of a name, a factory and its configuration, which may be directories again."""
        if factory == "dynamic-dir":
            if set(config) != {"entries"}:
                raise ValueError(f"{factory} knows entries alone")
            names = [e["name"] for e in config["entries"]]
            if len(set(names)) < len(names) or any("/" in n or not n for n in names):
                raise ValueError(f"entries of {name!r} need names of their own, without slashes")
            for entry in config["entries"]:
                self.define(f"{name}/{entry['name']}", entry["factory"], entry.get("config", {}))
            return
        if factory not in FACTORIES.known:
            raise ValueError(f"unknown factory {factory!r}")
        self.dynamic[name] = (factory, config)

    def mount(self, prefix: str, folder: str, schemes: dict[str, str] | None = None) -> None:
        """Tables of a folder of any of Spark's stores under a prefix, by file name without its ending; later mounts lie over earlier ones.

        schemes: the format of each ending (parquet without a word).  Nothing is read before it is asked for.
        """
        known = {"parquet": "file"} | (schemes or {})
        for entry in Store(self.spark, folder).entries():
            stem, _, ending = entry.rpartition(".")
            if stem and ending in known:
                self.tables.pop(f"{prefix}/{stem}", None)
                self.dynamic[f"{prefix}/{stem}"] = ("file", {"format": known[ending], "path": f"{folder.rstrip('/')}/{entry}"})

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.dynamic})

    def match(self, pattern: str) -> dict[str, DataFrame]:
        from strandline.sources.urls import glob_match

        found = [n for n in self.names() if (glob_match(pattern, n) is not None if "*" in pattern else n == pattern)]
        return {n: self.get(n) for n in found}

    def get(self, name: str) -> DataFrame:
        if name not in self.tables:
            factory, config = self.dynamic[name]
            self.tables[name] = FACTORIES.create(factory, self, config)
        return self.tables[name]


#: What steps of a mode may do to a catalog: transforms and readers only read, writers add tables.
MODES = {"reader": ("read",), "writer": ("read", "write"), "transform": ("read",)}


class _Limited:
    def __init__(self, catalog: Catalog, may: tuple[str, ...]):
        self._catalog, self._may = catalog, may

    def __getattr__(self, name: str):
        if name in ("add", "define") and "write" not in self._may:
            raise PermissionError(f"{name} is for writers")
        return getattr(self._catalog, name)


def limited(catalog: Catalog, mode: str):
    """The catalog as a step of this mode may use it."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return _Limited(catalog, MODES[mode])


def sql_view(spark: SparkSession, tables: dict[str, DataFrame], query: str | None = None) -> DataFrame:
    """The query over these tables by name, in a session of its own names; without a query the only table itself."""
    if query is None:
        if len(tables) != 1:
            raise ValueError("several tables need a query")
        return next(iter(tables.values()))
    # Each table has a view of a name that no one else uses, for as long as the query is analysed; the query's own names stand before it.
    views = {name: f"strandline_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        return spark.sql(_named(query, views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _named(query: str, views: dict[str, str]) -> str:
    """The query with its names for views, as far as text goes nothing else is touched."""
    if not views:
        return query
    names = ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in views.items())
    body = query.strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    return f"WITH {own[1] or ''}{names}, {body[own.end():]}" if own else f"WITH {names} {body}"


def query_source(df: DataFrame, query: str = "SELECT * FROM source") -> DataFrame:
    return sql_view(df.sparkSession, {"source": df}, query)


def describe(df: DataFrame) -> DataFrame:
    """Columns of a table, as rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def explain(df: DataFrame, query: str) -> DataFrame:
    """what, name, type: columns of a query's source and result, columns that the scan reads, and columns of comparisons that reach it."""
    out = query_source(df, query)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = [(what, f.name, f.dataType.simpleString()) for what, d in (("source", df), ("result", out)) for f in d.schema]
    read = re.search(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan)
    rows += [("read", *c.split(":", 1)) for c in (read[1].split(",") if read and read[1] else ())]
    signs = {"GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "EqualTo": "="}
    pushed = re.search(r"PushedFilters: \[(.*?)\](?:,|\n|$)", plan)
    rows += [("pushed", name, signs[kind]) for kind, name in re.findall(r"(\w+)\(([^,()]+),", pushed[1] if pushed else "") if kind in signs]
    return df.sparkSession.createDataFrame(rows, "what string, name string, type string")


def _patterns(catalog: Catalog, config: dict, many: bool) -> dict[str, DataFrame]:
    out = {}
    for name, pattern in config["patterns"].items():
        found = catalog.match(pattern)
        if not found:
            raise ValueError(f"nothing matches {pattern!r}")
        if len(found) > 1 and not many:
            raise ValueError(f"{pattern!r} matches several tables")
        out[name] = transforms.union_by_name(list(found.values()))
    return out


@FACTORIES.register("sql-derived-table", "patterns query")
def _sql_table(catalog: Catalog, config: dict) -> DataFrame:
    return sql_view(catalog.spark, _patterns(catalog, config, False), config.get("query"))


@FACTORIES.register("sql-derived-series", "patterns query")
def _sql_series(catalog: Catalog, config: dict) -> DataFrame:
    return sql_view(catalog.spark, _patterns(catalog, config, True), config.get("query"))


@FACTORIES.register("timeseries-join", "inputs time_column align")
def _join(catalog: Catalog, config: dict) -> DataFrame:
    inputs = []
    for spec in config["inputs"]:
        found = catalog.match(spec["pattern"])
        steps = [lambda df, r=r: transforms.rename(df, r) for r in spec.get("transforms", [])]
        # A pattern without a match adds nothing; its scope's other inputs still count.
        inputs += [{"df": df, "scope": spec.get("scope"), "begin": spec.get("begin"), "end": spec.get("end"), "transforms": steps} for df in found.values()]
    return joins.series_join(inputs, config.get("time_column", "timestamp"), config.get("align", "first"))


@FACTORIES.register("timeseries-pivot", "pattern columns time_column")
def _pivot(catalog: Catalog, config: dict) -> DataFrame:
    sites = {n.rsplit("/", 1)[-1]: df for n, df in catalog.match(config["pattern"]).items()}
    return joins.series_pivot(sites, config["columns"], config.get("time_column", "timestamp"))


@FACTORIES.register("temporal-reduce", "in resolution aggregations time_column")
def _reduce(catalog: Catalog, config: dict) -> DataFrame:
    return reduce.single_pass(transforms.union_by_name(list(catalog.match(config["in"]).values())), config.get("time_column", "timestamp"), config["resolution"], config["aggregations"])


@FACTORIES.register("column-rename", "in rules")
def _rename(catalog: Catalog, config: dict) -> DataFrame:
    return transforms.rename(catalog.get(config["in"]), config["rules"])


@FACTORIES.register("file", "format path")
def _file(catalog: Catalog, config: dict) -> DataFrame:
    from strandline.sources import formats, urls

    return formats.read(catalog.spark, urls.Url(config["format"], config["path"]))


@FACTORIES.register("synthetic-timeseries", "start end interval points time_column")
def _synthetic(catalog: Catalog, config: dict) -> DataFrame:
    from strandline.sources import synthetic

    return synthetic.series(catalog.spark, config["start"], config["end"], config["interval"], config["points"], config.get("time_column", "timestamp"))


def empty_like(spark: SparkSession, sibling: DataFrame | None = None) -> DataFrame:
    """What a pattern without a match reads as: no rows, with a sibling's columns or a time column alone."""
    return spark.createDataFrame([], sibling.schema if sibling is not None else "timestamp timestamp")
