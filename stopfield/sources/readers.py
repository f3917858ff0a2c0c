"""Readers of landed files. Keys stay text, missing values are null, and absent columns are filled on request."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopfield.functions.numeric import nan_to_null
from stopfield.operators.gtfs import fingerprint, trim_table
from stopfield.operators.skew import first_row
from stopfield.operators.spatial import within

# Fixed value: census figures at or below this are "no data" codes.
CENSUS_SENTINEL = -1000.0

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Register a source under a name, so a study can be pointed at it."""

    def add(fn):
        LOADERS[name] = fn
        return fn

    return add


def load_first(names: Sequence[str], **options) -> DataFrame:
    """The first registered source that has rows; later ones are fallbacks."""
    for name in names:
        df = LOADERS[name](**options)
        if not df.isEmpty():
            return df
    raise LookupError(f"no source of {list(names)} has rows")


_FEED_OF_PATH = r"([^/]+)/[^/]+$"


def feed_table(spark: SparkSession, folder: str, table: str, feeds: Sequence[str] = ("*",)) -> DataFrame:
    """One text table of many feeds laid out as ``folder/<feed>/<table>.txt``, every column text and by name, with ``feed`` from the path.

    Byte-order marks, padded headers and ragged rows are tolerated. Headers differ between feeds in order and content: files are grouped by their
    header line, each distinct header is one read, and the reads are united by name; what a feed lacks is null. The driver sees one row per
    distinct header with its files, as it does when it lists them. Finding the headers takes one pass over the lines.
    """
    paths = [f"{folder}/{f}/{table}.txt" for f in feeds]
    first = spark.read.format("text").option("wholetext", False).load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    # the header is the first line of a file's first block
    header = first.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    clean = F.regexp_replace("header", "^\ufeff|\\r$", "")
    out = None
    for row in header.groupBy(clean.alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect():
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(row["files"])
        one = trim_table(raw.select("*", F.regexp_extract(F.col("_metadata.file_path"), _FEED_OF_PATH, 1).alias("feed")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {table}.txt under {folder}")
    return out


def feed_tables(spark: SparkSession, folder: str, table: str, feeds: Sequence[str]) -> DataFrame:
    """``feed_table`` of named feeds."""
    return feed_table(spark, folder, table, feeds)


def parquet_columns(spark: SparkSession, path: str, wanted: Mapping[str, str]) -> DataFrame:
    """The wanted columns (name -> type) of a parquet table; a column the files lack is null. NaN becomes null."""
    df = spark.read.parquet(path)
    have = {f.name for f in df.schema.fields}
    out = []
    for name, kind in wanted.items():
        c = F.col(name) if name in have else F.lit(None)
        c = c.cast(kind)
        out.append((nan_to_null(c) if kind in ("double", "float") else c).alias(name))
    return df.select(*out)


def region_folders(spark: SparkSession, pattern: str, level: int = 1) -> DataFrame:
    """Parquet files of many region folders with ``region``, the folder ``level`` steps above the file."""
    steps = "".join(r"/[^/]+" for _ in range(level))
    region = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+){steps}$", 1)
    return spark.read.option("mergeSchema", True).parquet(pattern).select("*", region.alias("region"))


def od_flows(spark: SparkSession, path: str, digits: int = 12) -> DataFrame:
    """Commuters between units from compressed CSV files with a header, summed per pair: (h, w, n). Columns are taken by name."""
    raw = spark.read.option("header", True).csv(path).select(F.col("w_geocode"), F.col("h_geocode"), F.col("S000").cast("long").alias("S000"))
    return raw.groupBy(F.substring("h_geocode", 1, digits).alias("h"), F.substring("w_geocode", 1, digits).alias("w")).agg(F.sum("S000").alias("n"))


def census_arrays(texts: DataFrame, column: str, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Landed census answers (a JSON array of arrays whose first row is the header) to (GEOID, variables as numbers).

    The code is the key columns joined; "no data" codes become null. Several answers for the same units are put side by side.
    """
    rows = texts.select(F.from_json(column, "array<array<string>>").alias("_a")).select(F.col("_a")[0].alias("_h"), F.explode(F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0)))).alias("_r"))
    get = lambda name: F.when(F.array_position("_h", name) > 0, F.element_at("_r", F.greatest(F.array_position("_h", name), F.lit(1)).cast("int")))
    number = lambda name: get(name).try_cast("double")
    geoid = F.concat(*[get(k) for k in keys])
    clean = lambda c: F.when(c > CENSUS_SENTINEL, c)
    return rows.groupBy(geoid.alias("GEOID")).agg(*[F.max(clean(number(v))).alias(v) for v in variables])


_AMOUNT, _DECIMAL = r"([-\d,.]+)", r"([-\d.]+)"
# Fixed wording of the log: county (5 digits), what is scaled, lost of total (share), factor, columns.
LOG_LINE = " ".join((
    r"\[rescale\] county", r"(\d{5})", r"(\S+):", _AMOUNT, "of", _AMOUNT, rf"\({_DECIMAL}%\)",
    "not on an active cell -- factor", _DECIMAL, "on", r"(\d+)", "columns",
))


def log_factors(lines: DataFrame, text: str, order: Sequence[Column]) -> DataFrame:
    """Rescale factors out of run logs, the last line per county and group winning: (county, group, anchor, total, kept, factor)."""
    hit = lines.filter(F.col(text).rlike(LOG_LINE))
    part = lambda i: F.regexp_extract(text, LOG_LINE, i)
    number = lambda i: F.regexp_replace(part(i), ",", "").try_cast("double")
    rows = hit.select(
        part(1).alias("county"), F.when(F.lower(part(2)).contains("jobs"), "non").otherwise("res").alias("group"), part(2).alias("anchor"),
        number(4).alias("total"), (number(4) - number(3)).alias("kept"), part(6).cast("double").alias("factor"), *[o.alias(f"_o{i}") for i, o in enumerate(order)],
    )
    return first_row(rows, ["county", "group"], [-F.col(f"_o{i}") for i in range(len(order))], ["anchor", "total", "kept", "factor"])


def html_rows(pages: DataFrame, key: str, html: str, row_tag: str = "tr", cell_tag: str = "t[dh]") -> DataFrame:
    """Cells of every table row of a page: (key, row, cells). Scripts, styles and notes are dropped, tags stripped, blanks joined."""
    clean = F.regexp_replace(html, r"(?is)<(script|style|sup)\b.*?</\1>", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))).alias("row", "_r"))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"<[^>]+>", ""), r"\s+", " "))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(rf"(?is)<{cell_tag}\b[^>]*>(.*?)</{cell_tag}>"), F.lit(1)), text)
    return rows.select(key, "row", F.filter(cells, lambda c: F.length(c) > 0).alias("cells")).filter(F.size("cells") > 0)


def metro_members(sheet: DataFrame, kind: str, name: str, parts: Sequence[str], prefix: str = "Metro") -> DataFrame:
    """Membership lookup from a landed sheet: rows of one kind, their code parts joined: (code, metro)."""
    return sheet.filter(F.col(kind).startswith(prefix)).select(F.concat(*[F.col(p) for p in parts]).alias("code"), F.col(name).alias("metro")).dropDuplicates(["code"])


def feed_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Content mark per feed folder from its text files: (feed, files, mark). Files are hashed one by one, marks added up."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/*/")
    feed, name = F.regexp_extract("path", _FEED_OF_PATH, 1), F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(feed.alias("feed"), name.alias("name"), F.sha2("content", 256).alias("sha")).groupBy("feed").agg(F.count("*").alias("files"), fingerprint(F.col("name"), F.col("sha")).alias("mark"))


def index_version(spark: SparkSession, folder: str) -> DataFrame:
    """One row: a version that changes when any output file's name or size does. Only names and sizes are read, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.agg(F.sha1(fingerprint(name, F.col("length"))).alias("version"), F.count("*").alias("files"))


def mask_pixels(pixels: DataFrame, areas: DataFrame, key: str, res: int) -> DataFrame:
    """Raster pixels (lon, lat, value) inside an area."""
    return within(pixels.filter("value is not null and value <> 0"), areas, key, res)


def join_batches(batches: Sequence[DataFrame], key: str) -> DataFrame:
    """Column batches of the same units side by side."""
    out = batches[0]
    for b in batches[1:]:
        out = out.join(b, key, "left")
    return out
