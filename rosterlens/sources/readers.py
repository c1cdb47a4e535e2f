"""Readers: rosters, results, caches, and a check of the input."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.arrays import as_list, split_values
from ..functions.text import blank_to_null, safe_text, strip
from ..operators.rank import file_order, positions
from ..operators.roster import clean_roster, company_column

CSV_COLUMNS = (
    "company_name", "website", "score", "category", "industry", "products", "services", "technologies", "use_cases",
    "product_specifications", "price_range", "contact_email", "phone", "address", "description", "summary", "breakdown",
    "confidence", "recommended_products", "reason",
)
#: Bytes of input for each core up to which a table is dealt anew.
SMALL = 128 << 20
REQUIRED = ("company_name", "website", "score")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files give fewer scan tasks than that; for costly expressions over texts.

    A small file of one row group is one task. Tables beyond ``SMALL`` bytes a core have
    enough tasks of their own and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > cores * SMALL or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in the first file by name; lines like it at the head of other files are no rows."""
    raw = spark.read.csv(path, header=False, escape='"', multiLine=True)
    names: list[str] = []
    for file in sorted(raw.inputFiles()):
        names = spark.read.csv(file, header=True, escape='"', multiLine=True).columns
        if names:
            break
    if not names:
        raise ValueError(f"{path} has no header")
    title = spark.read.csv(file, header=False, escape='"', multiLine=True).first()
    same = F.lit(True)
    for c, v in zip(raw.columns, title, strict=False):
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return raw.filter(~same).withColumnsRenamed(dict(zip(raw.columns, names, strict=False)))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A roster file as it is: Excel, CSV or Parquet by its ending."""
    if path.endswith((".xlsx", ".xlsm")):
        spark.dataSource.register(XlsxSource)
        return spark.read.format("xlsx").load(path)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, website) of a roster file; ord is the row's place in the file, from 0."""
    sheet = read_sheet(spark, path)
    company_column(sheet.columns)
    # An Excel file is read by one task, whose ids are places.
    at = F.monotonically_increasing_id() if path.endswith((".xlsx", ".xlsm")) else file_order()
    return clean_roster(positions(sheet.withColumn("__file", at), ["__file"], "__ord", 0), "__ord")


def health(spark: SparkSession, path: str, online: bool | None = None) -> DataFrame:
    """One row: whether the input exists and can be read, its raw rows, and whether there is a network."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    readable, rows = False, 0
    if exists:
        try:
            rows = read_sheet(spark, path).count()
            readable = True
        except Exception:  # noqa: BLE001 - an unreadable input is what is reported
            readable = False
    return spark.createDataFrame([(exists, readable, rows, bool(online))], "file_exists boolean, file_readable boolean, row_count long, internet boolean")


def results_from_csv(table: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ranked results as the service gives them: known columns, blanks filled, scores as numbers. Others go, but for ``keep``."""
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in table.columns]
    table = table.toDF(*names)
    missing = required(names, REQUIRED)
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    cols = [F.col(c) for c in keep]
    for c in CSV_COLUMNS:
        if c not in names:
            continue
        if c == "score":
            cols.append(F.round(F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)), 2).alias(c))
        elif c == "company_name":
            cols.append(safe_text(F.col(c), "Unknown Company").alias(c))
        else:
            cols.append(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c))
    return table.select(*cols)


JSON_DEFAULTS = {"name": "Unknown", "category": "Low Potential", "industry": "Other", "summary": "No summary available."}
_LISTS = ("products", "services", "technologies", "use_cases", "recommended_products")
_TEXTS = ("product_specifications", "price_range", "contact_email", "phone")


def results_from_json(table: DataFrame) -> DataFrame:
    """Ranked results of the JSON form with defaults; blanks and empty lists count as missing."""
    have = set(table.columns)
    text = lambda c: blank_to_null(strip(F.col(c).cast("string"))) if c in have else F.lit(None).cast("string")
    number = lambda c, n: F.round(F.coalesce(F.col(c).cast("double") if c in have else F.lit(None).cast("double"), F.lit(0.0)), n)
    kinds = dict(table.dtypes)
    items = lambda c: as_list(F.col(c), kinds[c]) if c in have else F.array().cast("array<string>")
    cols = [F.coalesce(text(c), F.lit(d)).alias("company_name" if c == "name" else c) for c, d in JSON_DEFAULTS.items()]
    cols += [F.coalesce(text(c), F.lit("")).alias(c) for c in ("website", "reason")] + [number("score", 2).alias("score"), number("confidence", 4).alias("confidence")]
    cols += [items(c).alias(c) for c in _LISTS]
    cols += [text(c).alias(c) for c in _TEXTS]
    if "breakdown" in have:
        cols.append(F.col("breakdown"))
    return table.select(*cols)


#: How an indented array's elements begin; nested objects stand further in, and texts hold no bare line ends.
_ELEMENT = "\n  {"


def _begin(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines with anything in them, by the files' names: Spark itself reads large files first."""
    lines: list[str] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        lines += [r["value"] for r in spark.read.text(file).filter("trim(value) <> ''").limit(n - len(lines)).collect()]
        if len(lines) == n:
            break
    return lines


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(at, record): the objects of JSON lines or of a JSON array as variants, null where one can't be parsed, in file order.

    An array that is indented as ``write_json_parts`` does is read in parts like lines are; in another layout
    each file is one task's work.
    """
    begin = _begin(spark, path, 2)
    if begin and begin[0].strip() == "[" and begin[1:] and begin[1].startswith("  {"):
        parts = spark.read.text(path, lineSep=_ELEMENT).select(file_order().alias("at"), F.trim("value").alias("value"))
        parts = parts.filter(~F.trim(F.regexp_replace("value", r"[\[\]\s]", "")).isin("", ","))
        # At the head of a file no line end stands before the brace; an object's inside never begins with one.
        inside = F.regexp_replace("value", r"^\{", "")
        body = F.regexp_replace(F.concat(F.lit("{"), inside), r"\}\s*[,\]]?\s*\]?\s*$", "}")
        return parts.select("at", F.try_parse_json(body).alias("record"))
    if begin and begin[0].lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True).select(file_order().alias("at"), F.try_parse_json("value").alias("array"))
        whole.createOrReplaceTempView(view := f"arrays_{uuid.uuid4().hex}")
        return spark.sql(f"SELECT struct(at.path, at.start, e.pos AS row) AS at, e.value AS record FROM {view}, LATERAL variant_explode(array) AS e")
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.select(file_order().alias("at"), F.try_parse_json("value").alias("record"))


def results_from_records(records: DataFrame) -> DataFrame:
    """``results_from_json`` over variants: a list may come as one text, a number as text."""
    get = lambda c, kind: F.try_variant_get("record", f"$.{c}", kind)
    text = lambda c: blank_to_null(strip(get(c, "string")))
    lists = lambda c: F.when(get(c, "array<variant>").isNotNull(), as_list(get(c, "array<string>"), "array")).otherwise(split_values(F.coalesce(get(c, "string"), F.lit(""))))
    number = lambda c, n: F.round(F.coalesce(get(c, "double"), F.lit(0.0)), n)
    cols = [F.coalesce(text(c), *([text("company_name")] if c == "name" else []), F.lit(d)).alias("company_name" if c == "name" else c) for c, d in JSON_DEFAULTS.items()]
    cols += [F.coalesce(text(c), F.lit("")).alias(c) for c in ("website", "reason")] + [number("score", 2).alias("score"), number("confidence", 4).alias("confidence")]
    cols += [lists(c).alias(c) for c in _LISTS] + [text(c).alias(c) for c in _TEXTS] + [get("breakdown", "map<string, double>").alias("breakdown")]
    return records.select("at", *cols)


def json_list(text: Column, field: str) -> Column:
    """One field of the objects in a JSON list; null where the text isn't one."""
    return F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), lambda v: F.try_variant_get(v, f"$.{field}", "string"))


def load_results(spark: SparkSession, json_path: str | None, csv_path: str | None) -> DataFrame:
    """The JSON results, or the CSV ones where those can't be read, with ``position`` from 1: by score, in file order at ties.

    JSON with a record that can't be parsed, or without any object, counts as unreadable as a whole; an empty list is one without rows.
    """
    table = None
    if json_path:
        try:
            records = json_records(spark, json_path)
            state = records.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))).alias("objects")).first()
            if state["n"] == state["objects"] and (state["n"] or "".join(_begin(spark, json_path, 2)).replace(" ", "") == "[]"):
                table = results_from_records(records)
        except AnalysisException:  # no such path
            table = None
    if table is None:
        if not csv_path:
            raise FileNotFoundError("no results")
        raw = read_csv(spark, csv_path)
        table = results_from_csv(raw.withColumn("at", file_order()), keep=("at",))
    return positions(table, [F.desc("score"), "at"]).drop("at").orderBy("position")


def stale(modified: Column, as_of: Column, seconds: int = 3600) -> Column:
    """Missing, or older than the limit."""
    return modified.isNull() | (as_of.cast("timestamp") > modified.cast("timestamp") + F.make_interval(secs=F.lit(seconds)))


def embedding_cache(table: DataFrame) -> DataFrame:
    """(key, embedding) rows with a vector; text that is no list is dropped."""
    vector = F.from_json("embedding", "array<double>") if dict(table.dtypes)["embedding"] == "string" else F.col("embedding").cast("array<double>")
    return table.select("key", vector.alias("embedding")).filter("embedding is not null")


# -------------------------------------------------------------------------------- xlsx


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The first sheet's rows; cells as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        name = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", ns):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters.group():
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = c.findtext("m:v", None, ns)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells[at] = value
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


class _Sheet(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in _content(partition.path)[1:]:
            if any(v not in (None, "") for v in row):
                yield tuple((row + [None] * self.width)[: self.width])


def _content(path: str) -> list[list[str | None]]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    with store.open_input_stream(place) as f:
        return sheet_rows(f.read())


class XlsxSource(DataSource):
    """The first sheet of an Excel file; the first row names the columns."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        head = _content(self.options["path"])[:1] or [[]]
        return StructType([StructField(h or f"column_{i}", StringType()) for i, h in enumerate(head[0])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], len(schema.fields))


def required(columns: Sequence[str], needed: Sequence[str]) -> list[str]:
    """The needed columns that aren't there, in alphabetical order."""
    return sorted(set(needed) - set(columns))
