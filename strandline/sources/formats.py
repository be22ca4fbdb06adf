"""Readers of text formats, as DataFrame expressions over lines of text.

Parsers take a DataFrame of lines, so the same plan serves files, streams and
columns of other tables.  Bad lines are left out, as a log reader must.
"""

from __future__ import annotations

import html.parser
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.transforms import union_by_name
from strandline.plans import scratch
from strandline.sources.urls import COMPRESSIONS, FORMATS, Url, glob_host


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines without NUL characters and outer white space; blank ones go."""
    return lines.withColumn(column, F.trim(F.regexp_replace(column, "\\x00", ""))).where(F.col(column) != "")


def json_columns(lines: DataFrame, names: list[str] | None = None, column: str = "value") -> DataFrame:
    """A nullable text column for each key of the lines' JSON objects, by name; other lines go.

    Strings lose their quotes, numbers and booleans are their text, objects and
    arrays compact JSON.  Keys come from all lines unless names are given, which
    saves a pass.
    """
    parsed = clean_lines(lines, column).withColumn("_m", F.from_json(column, "map<string,string>")).where(F.col("_m").isNotNull() & F.col(column).startswith("{"))
    if names is None:
        names = [r[0] for r in parsed.select(F.explode(F.map_keys("_m")).alias("k")).distinct().orderBy("k").collect()]
    keep = [c for c in lines.columns if c != column]
    return parsed.select(*keep, *[F.col("_m").getItem(n).alias(n) for n in sorted(names)])


GAUGES = "struct<resourceMetrics:array<struct<scopeMetrics:array<struct<metrics:array<struct<name:string,gauge:struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double,asInt:string>>>>>>>>>>"


def gauges(lines: DataFrame, metrics: list[str] | None = None, column: str = "value", order: str | None = None) -> DataFrame:
    """Telemetry lines to one row a time with a double for each gauge, by name; of repeated points the last read wins.

    order: a column that lines are read in the order of, where files don't give it.
    """
    points = (
        clean_lines(lines, column).withColumn("_line", F.col(order).cast("long") if order else F.monotonically_increasing_id())
        .select("_line", F.from_json(column, GAUGES).alias("j"))
        .select("_line", F.posexplode("j.resourceMetrics").alias("a", "r"))
        .select("_line", "a", F.posexplode("r.scopeMetrics").alias("b", "s"))
        .select("_line", "a", "b", F.posexplode("s.metrics").alias("c", "m"))
        .select("_line", "a", "b", "c", "m.name", F.posexplode("m.gauge.dataPoints").alias("d", "p"))
        .select(F.struct("_line", "a", "b", "c", "d").alias("at"), "name", F.col("p.timeUnixNano").try_cast("long").alias("nano"), F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double")).alias("v"))
        .where("nano is not null")
        .withColumn("timestamp", F.timestamp_add("MICROSECOND", F.expr("nano div 1000"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")))
    )
    last = points.groupBy("timestamp", "name").agg(F.max_by("v", "at").alias("v"))
    if metrics is None:
        metrics = [r[0] for r in points.select("name").distinct().orderBy("name").collect()]
    return last.groupBy("timestamp").pivot("name", sorted(metrics)).agg(F.first("v"))


#: The fields of a line in the common log format, as a server's format string lists them, and two that the combined one adds.
_LOG_FIELDS = ("host", "identity", "user", "day", "zone", "request", "status", "bytes", "referer", "agent", "more")


def web_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Access logs in the common or combined format; a dash is null, or no bytes.

    A line is fields between spaces, some in quotes, the time in brackets: it is
    parsed once, and lines with other fields go.
    """
    keep = [c for c in lines.columns if c != column]
    parsed = F.from_csv(F.col(column), ", ".join(f"{f} string" for f in _LOG_FIELDS), {"sep": " ", "quote": '"', "escape": "\\", "mode": "PERMISSIVE"})
    known = lambda c: F.nullif(F.nullif(c, F.lit("-")), F.lit(""))
    f = {name: F.col("_log").getField(name) for name in _LOG_FIELDS}
    request = F.split(f["request"], " ")
    piece = lambda i: F.when(F.size(request) > i, known(request[i]))
    timed = f["day"].startswith("[") & f["zone"].endswith("]")
    sized = (f["bytes"] == "-") | f["bytes"].try_cast("long").isNotNull()
    good = timed & (F.length(f["status"]) == 3) & f["status"].try_cast("int").isNotNull() & sized & f["request"].isNotNull() & f["more"].isNull()
    return lines.withColumn("_log", parsed).where(good).select(
        *keep,
        F.try_to_timestamp(F.concat_ws(" ", F.substring(f["day"], F.lit(2), F.length(f["day"])), F.rtrim(f["zone"], F.lit("]"))), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("timestamp"),
        f["host"].alias("remote_addr"), known(f["user"]).alias("remote_user"), piece(0).alias("method"), piece(1).alias("path"), piece(2).alias("protocol"), f["status"].cast("int").alias("status"),
        F.coalesce(f["bytes"].try_cast("long"), F.lit(0).cast("long")).alias("body_bytes_sent"), known(f["referer"]).alias("http_referer"), known(f["agent"]).alias("http_user_agent"),
    )


class _Rows(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.header, self.rows, self._row, self._cell = [], [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag == "tr":
            self._row = ("header" if "dataHeader" in names or "isi-data-table" in a else "data" if "data" in names or "isi-data-row" in a else None, [])
        elif tag in ("td", "th") and self._row:
            self._cell = []

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None and self._row:
            self._row[1].append("".join(self._cell).strip())
            self._cell = None
        elif tag == "tr" and self._row:
            kind, cells = self._row
            if kind == "header":
                self.header = cells
            elif kind == "data":
                self.rows.append(cells)
            self._row = None


def html_rows(page: str) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of a table export: short rows are filled up, empty cells are null."""
    p = _Rows()
    p.feed(page or "")
    n = len(p.header)
    return p.header, [[c or None for c in (r + [""] * n)[:n]] for r in p.rows]


def html_headers(pages: DataFrame, column: str = "value") -> list[str]:
    """The columns of all pages, each once: those of the first header, then what others have more (one row for each different header)."""

    def run(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen.add(tuple(html_rows(page)[0]))
        yield pa.RecordBatch.from_arrays([pa.array([list(h) for h in sorted(seen)], pa.list_(pa.string()))], names=["header"])

    headers = pages.select(column).mapInArrow(run, "header array<string>").distinct().collect()
    return list(dict.fromkeys(name for h in sorted((r.header for r in headers), key=lambda h: (-len(h), h)) for name in h))


def html_table(pages: DataFrame, header: list[str], column: str = "value", text_columns: tuple[str, ...] = ("Date Time",)) -> DataFrame:
    """Rows of HTML table exports with a known header; all columns are doubles but the text columns."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for page in frame[column]:
                names, found = html_rows(page)
                rows += [[dict(zip(names, r, strict=True)).get(h) for h in header] for r in found]
            yield pd.DataFrame(rows, columns=[f"c{i}" for i in range(len(header))], dtype=object)

    raw = pages.select(column).mapInPandas(run, ", ".join(f"c{i} string" for i in range(len(header))))
    return raw.select(*[(F.col(f"c{i}") if h in text_columns else F.col(f"c{i}").try_cast("double")).alias(h) for i, h in enumerate(header)])


def _paths(url: Url) -> list[str]:
    if not url.is_pattern:
        return [url.path]
    found = [p for p, _ in glob_host(url.path)]
    if not found:
        raise FileNotFoundError(f"nothing matches {url.path}")
    return found


_DECODERS = {"gzip": "gzip", "bzip2": "bz2", "zstd": "zstandard"}


def _suffix_says(path: str) -> str | None:
    return next((name for name, suffix in COMPRESSIONS.items() if path.endswith(f".{suffix}")), None)


def _decoded(spark: SparkSession, url: Url, whole: bool = False) -> DataFrame:
    """Column value: the lines (whole: the text) of files that are decoded as the address says, whatever their names say."""
    module, kind = _DECODERS[url.compression], url.compression

    def run(batches):
        import importlib
        import io

        import pyarrow as pa

        codec = importlib.import_module(module)
        for batch in batches:
            for data in batch.column(0):
                raw = io.BytesIO(data.as_py())
                stream = codec.ZstdDecompressor().stream_reader(raw, read_across_frames=True) if kind == "zstd" else codec.open(raw)
                text = io.TextIOWrapper(io.BufferedReader(stream) if kind == "zstd" else stream, "utf-8", "replace", newline="\n")
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array([text.read()])], names=["value"])
                    continue
                while part := text.readlines(1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n").removesuffix("\r") for x in part])], names=["value"])

    return spark.read.format("binaryFile").load(_paths(url)).select("content").mapInArrow(run, "value string")


def _named_otherwise(url: Url) -> bool:
    """Whether the address names a compression that Spark's readers, which go by file names, would not undo."""
    return url.compression is not None and any(_suffix_says(p) != url.compression for p in _paths(url))


def _lines(spark: SparkSession, url: Url, whole: bool = False) -> DataFrame:
    if _named_otherwise(url):
        return _decoded(spark, url, whole)
    return spark.read.text(_paths(url), wholetext=whole)


@FORMATS.register("csv")
def read_csv(spark: SparkSession, url: Url) -> DataFrame:
    """Types are taken from a sample of the rows unless `schema` is given."""
    o = url.options
    reader = spark.read.option("sep", o.get("delimiter", ",")).option("header", o.get("has_header", "true")).option("quote", o.get("quote", '"'))
    if "escape" in o:
        reader = reader.option("escape", o["escape"])
    reader = reader.schema(o["schema"]) if "schema" in o else reader.option("inferSchema", True).option("samplingRatio", float(o.get("sample", 1.0)))
    if _named_otherwise(url):
        folders = []
        for path in _paths(url):  # a folder a file, so that each keeps its header
            folders.append(scratch.folder(spark, "decoded"))
            _lines(spark, replace(url, path=path)).coalesce(1).write.text(folders[-1])
        return union_by_name([reader.csv(p) for p in folders])
    return union_by_name([reader.csv(p) for p in _paths(url)]) if len(_paths(url)) > 1 else reader.csv(_paths(url))


@FORMATS.register("jsonlogs")
def read_json_lines(spark: SparkSession, url: Url) -> DataFrame:
    return json_columns(_lines(spark, url))


@FORMATS.register("oteljson")
def read_gauges(spark: SparkSession, url: Url) -> DataFrame:
    return gauges(_lines(spark, url))


@FORMATS.register("weblog")
def read_web_log(spark: SparkSession, url: Url) -> DataFrame:
    return web_log(_lines(spark, url))


@FORMATS.register("excelhtml")
def read_html_table(spark: SparkSession, url: Url) -> DataFrame:
    """All files' columns by name, in the order in which they come up; what a file lacks is null."""
    pages = _lines(spark, url, whole=True)
    return html_table(pages, html_headers(pages))


def read(spark: SparkSession, address: str | Url, one: bool = False) -> DataFrame:
    """The table at an address; of a pattern, all matches by name (refused where `one` table is asked for).

    Compressed text is decoded as the address says, and without a word there by the
    file's extension.
    """
    url = address if isinstance(address, Url) else Url.parse(address)
    if one and url.is_pattern:
        raise ValueError("one table is asked for, not a pattern")
    if FORMATS.classify(url.format) == "format":
        return FORMATS.reader(url.format)(spark, url)
    return spark.read.option("mergeSchema", True).parquet(*_paths(url))


def latest_time(df: DataFrame, time: Column) -> DataFrame:
    return df.agg(F.max(time).alias("youngest"))
