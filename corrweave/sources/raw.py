"""Raw vendor exports as tidy tables: prices, constituents, coarse data, fundamentals."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators.membership import first_rows, union_all_by_name

# Names under which vendors ship each column, in order of preference.
DATE_NAMES = ("date", "time", "timestamp", "datetime", "end", "period_end")
MEMBER_TICKER_NAMES = ("constituent", "holding", "member", "component", "constituent_symbol")
TICKER_NAMES = ("ticker", "symbol")
LAST_TICKER_NAMES = ("sid",)
PRICE_NAMES = {"open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "adj_close": ("adj_close", "adjclose", "adjusted_close"), "volume": ("volume",)}
MEMBER_NAMES = ("is_member", "member", "included")
WEIGHT_NAMES = ("weight", "percentage", "value")
SECTOR_NAMES = ("sector", "industry", "gics_sector")
MARKET_CAP_NAMES = ("market_cap", "marketcap", "mktcap")


def _files(spark: SparkSession, root: str, name: str, recursive: bool) -> list[str]:
    """Paths by name, listed by Spark's own reader, so that any store will do. A listing of files, not of rows."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", recursive).load(root)
    return sorted(r[0] for r in found.select("path").collect())


def _header(spark: SparkSession, path: str) -> str | None:
    """A file's first line: one open each, in place of a job each, and nothing else of the file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where), "UTF-8"))
    try:
        return lines.readLine()
    finally:
        lines.close()


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with one header, all columns as strings, with `_file` and `_line` to tell the order of rows."""
    return spark.read.csv(path, header=True).withColumns({"_file": F.input_file_name(), "_line": F.monotonically_increasing_id()})


def scan_dir(spark: SparkSession, root: str, name: str = "*.csv", exclude: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """All matching files, columns matched by name and not by place: one scan for each distinct header, however many files."""
    files = [f for f in _files(spark, root, name, recursive) if f.rsplit("/", 1)[-1] not in exclude]
    if not files:
        raise FileNotFoundError(f"no file {name} in {root}")
    return scan_files(spark, files)


def scan_files(spark: SparkSession, files: list[str]) -> DataFrame:
    by_header: dict[str | None, list[str]] = {}
    for f in files:
        by_header.setdefault(_header(spark, f), []).append(f)
    return union_all_by_name([read_csv(spark, f) for f in by_header.values()])


def _names(df: DataFrame) -> dict[str, str]:
    return {cleaning.normalized(c): c for c in df.columns if not c.startswith("_")}


def pick(df: DataFrame, candidates: tuple[str, ...], override: str | None = None) -> Column:
    """The first candidate that the table has under a normalised name; null where it has none."""
    names = _names(df)
    for c in (cleaning.normalized(override),) if override else candidates:
        if c in names:
            return F.col(f"`{names[c]}`")
    return F.lit(None).cast("string")


def infer_ticker(df: DataFrame, override: str | None = None) -> str:
    """The ticker's column: a member's name if there is one, else of ticker and symbol the one with more distinct values, else a security id."""
    names = _names(df)
    if override:
        return override
    for c in MEMBER_TICKER_NAMES:
        if c in names:
            return names[c]
    found = [names[c] for c in TICKER_NAMES if c in names] or [names[c] for c in LAST_TICKER_NAMES if c in names]
    if not found:
        raise ValueError("no ticker column")
    if len(found) == 1:
        return found[0]
    counts = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in found]).first()
    return max(found, key=lambda c: counts[c])


def _keyed(df: DataFrame, overrides: dict[str, str]) -> list[Column]:
    date = F.col(f"`{overrides['date']}`") if "date" in overrides else pick(df, DATE_NAMES)
    return [cleaning.coerce_date(date).alias("date"), cleaning.clean_ticker(F.col(f"`{infer_ticker(df, overrides.get('ticker'))}`").cast("string")).alias("ticker")]


def standardize_prices(df: DataFrame, overrides: dict[str, str] = {}) -> DataFrame:
    """(date, ticker, open .. volume): distinct rows with both keys. If no row at all has an adjusted close, the close stands for it."""
    values = [cleaning.number(pick(df, names, overrides.get(c))).alias(c) for c, names in PRICE_NAMES.items()]
    # Decided on all rows, those without keys too; that scan reads one column and gives one row.
    adjusted = values[list(PRICE_NAMES).index("adj_close")]
    has = df.select(adjusted).agg(F.count("adj_close").alias("__n"))
    rows = df.select(*_keyed(df, overrides), *values).dropna(subset=["date", "ticker"]).crossJoin(F.broadcast(has))
    return rows.withColumn("adj_close", F.when(F.col("__n") > 0, F.col("adj_close")).otherwise(F.col("close"))).drop("__n").distinct()


def standardize_constituents(df: DataFrame, overrides: dict[str, str] = {}) -> DataFrame:
    """(date, ticker, is_member, weight, sector): the flag is 1 unless a number says otherwise; fractions are cut off."""
    flag = F.coalesce(cleaning.number(pick(df, MEMBER_NAMES, overrides.get("member"))), F.lit(1.0)).cast("int")
    weight = cleaning.number(pick(df, WEIGHT_NAMES, overrides.get("weight")))
    rows = df.select(*_keyed(df, overrides), flag.alias("is_member"), weight.alias("weight"), pick(df, SECTOR_NAMES, overrides.get("sector")).cast("string").alias("sector"))
    return rows.dropna(subset=["date", "ticker"]).distinct()


def standardize_coarse(df: DataFrame, overrides: dict[str, str] = {}) -> DataFrame:
    """(date, ticker, market_cap); empty if the table has no market cap."""
    rows = df.select(*_keyed(df, overrides), cleaning.number(pick(df, MARKET_CAP_NAMES, overrides.get("market_cap"))).alias("market_cap"))
    known = any(c in _names(df) for c in MARKET_CAP_NAMES) or "market_cap" in overrides
    return rows.dropna(subset=["date", "ticker"]).distinct() if known else rows.limit(0)


def merge_market_cap(constituents: DataFrame, coarse: DataFrame, dedupe: bool = False) -> DataFrame:
    """Constituents with the market cap of their date and ticker; several caps repeat the row unless `dedupe` takes the largest."""
    if dedupe:
        coarse = coarse.groupBy("date", "ticker").agg(F.max("market_cap").alias("market_cap"))
    return constituents.join(coarse.select("date", "ticker", "market_cap"), ["date", "ticker"], "left")


def load_prices(df: DataFrame, order: list[str] = ["_file", "_line"]) -> DataFrame:
    """(date, ticker, price, volume) from a tidy table: adjusted close if there is such a column, else close; the first row of a key counts."""
    column = next((c for c in ("adj_close", "close") if c in df.columns), None)
    if column is None:
        raise ValueError("prices need adj_close or close")
    volume = cleaning.number(F.col("volume")) if "volume" in df.columns else F.lit(None).cast("double")
    rows = df.select(cleaning.coerce_date(F.col("date")).alias("date"), cleaning.simple_ticker(F.col("ticker")).alias("ticker"), cleaning.number(F.col(column)).alias("price"), volume.alias("volume"), *order)
    return first_rows(rows.dropna(subset=["date", "ticker"]), ["date", "ticker"], order).drop(*order)


def scan_ticker(spark: SparkSession, root: str, ticker: str, name: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(date, price) of one ticker from price files, in order of nothing: of equal dates the first by file and line counts.

    Lines without the ticker's letters are dropped as text, before anything of them is parsed; the rest are read by their
    file's own header. Adjusted close stands before close. Rows whose price is blank or no number, or whose date or
    ticker doesn't read, are left out. A row is one line: line ends within quotes are not looked for.
    """
    files = _files(spark, root, name, recursive)
    if not files:
        raise FileNotFoundError(f"no file {name} in {root}")
    by_header: dict[str | None, list[str]] = {}
    for f in files:
        by_header.setdefault(_header(spark, f), []).append(f)
    found = []
    for header, mine in by_header.items():
        if not header:
            continue
        columns = next(csv.reader([header]))
        lines = spark.read.text(mine).where(F.upper("value").contains(ticker.upper()) & (F.col("value") != header))
        lines = lines.select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
        schema = ", ".join(f"`{c}` string" for c in columns)
        rows = lines.select(F.from_csv("value", schema).alias("row"), "_file", "_line").select("row.*", "_file", "_line")
        names = _names(rows)
        price = next((names[c] for c in (*PRICE_NAMES["adj_close"], "close") if c in names), None)
        date = next((names[c] for c in DATE_NAMES if c in names), None)
        who = next((names[c] for c in (*TICKER_NAMES, *LAST_TICKER_NAMES) if c in names), None)
        if price is None or date is None or who is None:
            raise ValueError(f"{mine[0]} has no date, ticker or price")
        own = [cleaning.coerce_date(F.col(f"`{date}`")).alias("date"), cleaning.simple_ticker(F.col(f"`{who}`")).alias("ticker"), cleaning.number(F.col(f"`{price}`")).alias("price")]
        found.append(rows.select(*own, "_file", "_line"))
    if not found:
        raise ValueError(f"the files {name} in {root} are empty")
    rows = functools.reduce(DataFrame.unionByName, found).where((F.col("ticker") == ticker.upper()) & F.col("date").isNotNull() & F.col("price").isNotNull())
    return first_rows(rows, ["date", "ticker"], ["_file", "_line"]).select("date", "price")


def load_constituents(df: DataFrame) -> DataFrame:
    """(date, ticker, ..) of the rows that are members; without a flag all are."""
    missing = {"date", "ticker"} - set(df.columns)
    if missing:
        raise ValueError(f"constituents lack {sorted(missing)}")
    rows = df.withColumns({"date": cleaning.coerce_date(F.col("date")), "ticker": cleaning.simple_ticker(F.col("ticker"))}).dropna(subset=["date", "ticker"])
    return rows.where(cleaning.number(F.col("is_member")) == 1) if "is_member" in df.columns else rows


def load_fundamentals(df: DataFrame) -> DataFrame:
    """Numbers as numbers, the packed debt ratio unpacked; only the columns that are there."""
    rows = df.withColumns({"date": cleaning.coerce_date(F.col("date")), "ticker": cleaning.simple_ticker(F.col("ticker"))}).dropna(subset=["date", "ticker"])
    rows = rows.withColumns({c: cleaning.number(F.col(c)) for c in ("sector_code", "market_cap", "pe_ratio", "pb_ratio") if c in df.columns})
    return rows.withColumn("debt_equity", cleaning.packed_ratio(F.col("debt_equity"))) if "debt_equity" in df.columns else rows


def merge_years(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The yearly folders' prices, constituents, fundamentals and macro prices, each as one table of distinct rows.

    A year's part is a file of that name, or a folder of that name with files, as Spark writes it.
    """
    out, files = {}, _files(spark, root, "*.csv", True)
    for name, key in (("prices", "date"), ("constituents", "date"), ("fundamentals", "date"), ("macro_prices", "time")):
        mine = [f for f in files if f"{name}.csv" in f.split("/")[-2:]]
        if not mine:
            raise FileNotFoundError(f"no {name}.csv in {root}")
        df = scan_files(spark, mine).drop("_file", "_line")
        if "ticker" not in df.columns and "constituent_symbol" in df.columns:
            df = df.withColumnRenamed("constituent_symbol", "ticker")
        out[name] = df.withColumns({key: cleaning.coerce_date(F.col(key)), "ticker": cleaning.clean_ticker(F.col("ticker"))}).dropna(subset=[key, "ticker"]).distinct()
    return out
