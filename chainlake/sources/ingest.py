"""Bronze ingestion: landing CSV files -> append-only Bronze tables.

Batch form (``read_landing`` + ``new_files_only``) and the streaming form in
``chainlake.streaming.ingest`` share the same column logic.  The file path of
every row comes from Spark's hidden ``_metadata.file_path`` column, so the
dedupe key is the absolute path Spark resolved.

Files are read as lines, so a large file is split over many tasks.  A line is
told its columns by the header table: one row per file, taken from the line
that opens the file's first block, and joined on the path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.util import as_col, lit_ts
from chainlake.sources import schemas

# Accepted spellings of the in-the-money flag (case-insensitive).
ITM_TRUE = ("true", "1", "1.0")
ITM_FALSE = ("false", "0", "0.0")


def normalize_itm(c) -> Column:
    """``true/1/1.0`` -> TRUE, ``false/0/0.0`` -> FALSE, anything else NULL."""
    s = F.lower(F.trim(as_col(c).cast("string")))
    return (F.when(s.isin(*ITM_TRUE), F.lit(True))
            .when(s.isin(*ITM_FALSE), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


def to_long(c) -> Column:
    """DOUBLE read from CSV -> BIGINT, rounding half-to-even like the
    reference's implicit cast (``12.0`` -> 12, ``2.5`` -> 2)."""
    return F.bround(as_col(c), 0).cast("long")


def add_metadata(df: DataFrame, snapshot_time, ticker) -> DataFrame:
    """Stamp a run: snapshot_time, its ``YYYYMMDD_HHMMSS`` id, ticker.  Values
    may be literals (one run) or Columns (a run clock per row)."""
    ts = lit_ts(snapshot_time)
    tk = ticker if isinstance(ticker, Column) else F.lit(ticker)
    return (df.withColumn("snapshot_time", ts)
            .withColumn("snapshot_str", F.date_format(ts, "yyyyMMdd_HHmmss"))
            .withColumn("ticker", tk))


def chain_union(calls: list[DataFrame], puts: list[DataFrame]) -> DataFrame | None:
    """Tag calls/puts, stack them and all expiries; empty inputs are
    skipped, missing columns become NULL."""
    parts = [d.withColumn("option_type", F.lit("call")) for d in calls if d is not None] + \
            [d.withColumn("option_type", F.lit("put")) for d in puts if d is not None]
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _options_columns() -> list[Column]:
    return [*map(F.col, ("contractSymbol", "expiry", "option_type", "strike", "bid", "ask", "lastPrice")),
            to_long("volume").alias("volume"), to_long("openInterest").alias("openInterest"),
            *map(F.col, ("impliedVolatility", "delta", "gamma", "theta", "vega")),
            normalize_itm("inTheMoney").alias("inTheMoney"),
            *map(F.col, ("snapshot_time", "snapshot_str", "ticker", "_source_file"))]


def _price_columns() -> list[Column]:
    return [*map(F.col, ("Date", "Open", "High", "Low", "Close")), to_long("Volume").alias("Volume"),
            *map(F.col, ("HV_20", "HV_252", "snapshot_time", "snapshot_str", "ticker", "_source_file"))]


# Closes a line, so that its number of fields shows; and a byte-order mark.
END, BOM = "\u0002", "\ufeff"
# Most bytes of a header table that is broadcast.
HEADER_BYTES = 32 * 1024 * 1024


def with_lines(files: DataFrame) -> DataFrame:
    """Lines of text files (batch or stream) with what tells their file."""
    m = "_metadata.file_"
    return files.select("value", F.col(m + "path").alias("_source_file"), F.col(m + "block_start").alias("_start"),
                        F.col(m + "size").alias("_length"), F.col(m + "modification_time").alias("_modified"))


def _fields(line: Column, n: int) -> Column:
    """The fields of a CSV line as one array, its end marked by ``END``; empty
    ones may be NULL or empty.  A line without quotes is split at its commas;
    the parser reads the first ``n`` fields of others, once per line."""
    closed = F.concat(line, F.lit("," + END))
    names = [f"f{i}" for i in range(n)]
    parsed = F.array(F.from_csv(closed, ", ".join(f"{c} string" for c in names)))
    by_parser = F.get(F.transform(parsed, lambda s: F.array(*[s[c] for c in names])), F.lit(0))
    return F.when(line.contains('"') | line.contains("\0"), by_parser).otherwise(F.split(closed, ","))


def _as_array(d: DataFrame, line: Column, n: int, name: str) -> DataFrame:
    """The fields of a line as an array; a generator, so that no filter above
    is pushed below it with a copy of the array for each field it looks at."""
    return d.select("*", F.explode(F.array(_fields(line, n))).alias(name))


def headers(lines: DataFrame, kind: str) -> DataFrame:
    """One row per file: path, header text, names, and the place of every
    landing column (NULL: the file lacks it).  A header that lacks a required
    column, or names a column twice, is an error that names file and column.

    The first line is the one that opens the first block; each task sends one
    row per file that it began."""
    first = (lines.where((F.col("_start") == 0) & (F.col("value") != "")).withColumn("_i", F.monotonically_increasing_id())
             .groupBy("_source_file").agg(F.min_by("value", "_i").alias("_header"),
                                          F.first("_length").alias("_length"), F.first("_modified").alias("_modified"))
             .checkpoint(eager=True))
    text = F.when(F.col("_header").startswith(BOM), F.substring("_header", 2, 1 << 30)).otherwise(F.col("_header"))
    # A header has at most one more field than it has commas.
    most = first.agg(F.max(F.length("_header") - F.length(F.replace("_header", F.lit(","))))).first()[0]
    named = _as_array(first, text, (most or 0) + 2, "_all")
    names = F.transform(F.slice("_all", 1, F.array_position("_all", F.lit(END)).cast("int") - 1), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    named = named.select("_source_file", "_header", "_length", "_modified", names.alias("_names"))
    known = (schemas.PRICE_CSV if kind == "price" else schemas.OPTIONS_CSV).names
    lacks = F.array_except(F.array(*map(F.lit, schemas.REQUIRED[kind])), "_names")
    twice = F.filter(F.array(*map(F.lit, known)), lambda k: F.size(F.filter("_names", lambda c: c == k)) > 1)

    def fail(what: str, cols: Column) -> Column:
        return F.raise_error(F.concat("_source_file", F.lit(what), F.array_join(cols, ", "))).cast("array<int>")
    at = F.array(*[F.nullif(F.array_position("_names", F.lit(k)).cast("int"), F.lit(0)) for k in known])
    return named.select("_source_file", "_header", "_length", "_modified", F.size("_names").alias("_n"),
                        F.when(F.size(lacks) > 0, fail(" lacks required columns: ", lacks))
                        .when(F.size(twice) > 0, fail(" names columns twice: ", twice)).otherwise(at).alias("_at"))


def by_header(lines: DataFrame, heads: DataFrame, kind: str) -> DataFrame:
    """Every data line with its fields by name and type, ``_source_file``,
    ``line``, ``reasons`` and ``loaded``.

    Files may order their columns differently, lack optional ones (NULL) or
    have more, however many.  A line with fewer or more fields than its header,
    or with an open quote, cannot be told apart into columns: it is not
    ``loaded``.  A field that does not parse as its type is NULL; a required
    one keeps the row out.  ``reasons`` says so in either case.  Lines equal to
    the file's header (joined files) and empty lines are no data."""
    schema = schemas.PRICE_CSV if kind == "price" else schemas.OPTIONS_CSV
    sized = heads.agg(F.max("_n"), F.sum(F.length("_header") + F.length("_source_file") + 100)).first()
    width = (sized[0] or 0) + 2
    heads = heads.select("_source_file", "_header", "_n", "_at")
    if (sized[1] or 0) <= HEADER_BYTES:  # else the two meet in a shuffle
        heads = F.broadcast(heads)
    d = (lines.where(F.col("value") != "").select("value", "_source_file")
         .join(heads, "_source_file").where(F.col("value") != F.col("_header")))
    d = _as_array(d, F.col("value"), width, "_row").withColumn("_end", F.array_position("_row", F.lit(END)).cast("int"))
    size = F.concat(F.lit("fields, header has "), F.col("_n").cast("string"))
    n_quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    shape = (F.when(F.col("_end") == F.col("_n") + 1, None)
             .when(F.col("_end").between(1, F.col("_n")), F.concat((F.col("_end") - 1).cast("string"), F.lit(" "), size))
             .when((F.col("_end") == 0) & (n_quotes % 2 == 1), "open quote").otherwise(F.concat(F.lit("more "), size)))
    d = d.withColumn("_shape", shape)
    def field(i: int) -> Column:
        return F.nullif(F.get("_row", F.get("_at", F.lit(i)) - 1), F.lit(""))
    raw = [F.when(F.col("_shape").isNull(), field(i)).alias(f"_raw_{f.name}") for i, f in enumerate(schema.fields)]
    d = d.select("_source_file", F.col("value").alias("line"), F.inline(F.array(F.struct("_shape", *raw))))  # once, as above
    d = d.select("*", *[F.col(f"_raw_{f.name}").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    bad = {f.name: F.col(f"_raw_{f.name}").isNotNull() & F.col(f.name).isNull() for f in schema.fields if f.dataType != T.StringType()}
    said = [F.when(b, F.concat(F.lit(f"{n}: "), F.col(f"_raw_{n}"))) for n, b in bad.items()]
    stops = [F.col("_shape").isNotNull(), *[bad[n] for n in schemas.REQUIRED[kind] if n in bad]]
    return d.select("_source_file", "line", *schema.names, F.array_compact(F.array("_shape", *said)).alias("reasons"),
                    (~reduce(lambda a, b: a | b, stops)).alias("loaded"))


def typed_bronze(parsed: DataFrame, kind: str) -> DataFrame:
    """The rows of ``by_header`` that Bronze takes, in its types."""
    return parsed.where("loaded").select(*(_price_columns() if kind == "price" else _options_columns()))


def quarantine(parsed: DataFrame) -> DataFrame:
    """The lines of ``by_header`` that could not be taken as they were:
    _source_file, reasons, loaded (FALSE: not in Bronze at all), line."""
    return parsed.where(F.size("reasons") > 0).select(*schemas.QUARANTINE.names)


def _parsed_landing(spark: SparkSession, path: str, kind: str, manifest: DataFrame | None = None) -> DataFrame:
    lines = with_lines(spark.read.option("recursiveFileLookup", True).text(path))
    return by_header(lines, new_files_only(headers(lines, kind), manifest), kind)


def read_landing(spark: SparkSession, path: str, kind: str, manifest: DataFrame | None = None) -> DataFrame:
    """Batch read of a landing folder of CSV snapshots (``kind`` is
    ``'price'`` or ``'options'``), by header name, typed as Bronze.  With a
    ``manifest``, of the ``new_files_only``: the header table is told apart,
    a row per file, and the lines of other files are not parsed."""
    return typed_bronze(_parsed_landing(spark, path, kind, manifest), kind)


def read_quarantine(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What ``read_landing`` leaves out or reads with NULLs, with reasons."""
    return quarantine(_parsed_landing(spark, path, kind))


def normal_path(path: Column, base: str = "/") -> Column:
    """One spelling per file: without a ``file:`` scheme, relative paths
    below ``base``, without ``.`` steps and repeated slashes."""
    p = F.regexp_replace(path, r"^file:/+", "/")
    p = F.when(p.rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*://)"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))
    return F.regexp_replace(F.regexp_replace(p, r"(?<!:)/(\./)+", "/"), r"(?<!:)/{2,}", "/")


def new_files_only(incoming: DataFrame, manifest: DataFrame | None, base: str = "/") -> DataFrame:
    """Drop rows of files that were read before.  ``manifest`` has a row per
    file (``path``), also of files without rows, so no Bronze is scanned; a
    table with ``_source_file`` does as well."""
    if manifest is None:
        return incoming
    known = F.col("path" if "path" in manifest.columns else "_source_file")
    loaded = manifest.select(normal_path(known, base).alias("_path")).distinct()
    return incoming.join(loaded, normal_path(F.col("_source_file"), base) == F.col("_path"), "left_anti")


def csv_snapshot_sink(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write snapshots partitioned by snapshot date and run, rows of a ticker
    together inside the files.  A run's partitions are overwritten, so a
    retried run leaves its rows once."""
    (df.withColumns({"snapshot_date": F.to_date("snapshot_time"), "run": F.col("snapshot_str")})
     .sortWithinPartitions("snapshot_date", "run", "ticker")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date", "run").format(fmt).save(path))


WATCHLIST_TYPE = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def watchlist_explode(json_lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON object ``{ticker: [symbol, ...]}`` per row -> distinct
    (ticker, contractSymbol) rows."""
    m = F.from_json(F.col(col), WATCHLIST_TYPE)
    return (json_lines.select(F.explode(m).alias("ticker", "symbols"))
            .select("ticker", F.explode("symbols").alias("contractSymbol"))
            .dropDuplicates(["ticker", "contractSymbol"]))


def bronze_sample(bronze: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` rows by snapshot_time (a top-k report; Spark plans it
    as TakeOrderedAndProject, a per-partition top-n then one merge of
    n x partitions rows).  Ties on time are broken by source file."""
    order = [F.col("snapshot_time").desc_nulls_last()]
    if "_source_file" in bronze.columns:
        order.append(F.col("_source_file").desc_nulls_last())
    return bronze.orderBy(*order).limit(n)


def bronze_count(bronze: DataFrame, name: str) -> DataFrame:
    """Row count and loaded-file count of a Bronze table."""
    return bronze.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.countDistinct("_source_file").alias("n_files")) \
        .select(F.lit(name).alias("tbl"), "n_rows", "n_files")
