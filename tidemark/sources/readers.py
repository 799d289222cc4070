"""Readers and sinks with the checks that the panel operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines with ``row`` (null where unreadable), ``empty`` and ``invalid``."""
    lines = spark.read.text(paths)
    blank = F.trim("value") == ""
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
    return lines.select(F.when(~blank & is_object, row).alias("row"), blank.alias("empty"), (~blank & ~is_object).alias("invalid"))


def json_counters(rows: DataFrame) -> DataFrame:
    """One row: lines, empty lines, invalid lines."""
    return rows.agg(F.count("*").alias("lines"), F.count_if("empty").alias("empty_lines"), F.count_if("invalid").alias("invalid_lines"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in their order, wherever they lie."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def json_lines_of(spark: SparkSession, paths: list[str], schema: StructType | str, field: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counters): each different line of the paths that exist whose ``field`` is in ``members`` (its one column), once; and one row of counters.

    counters: lines, empty_lines, invalid_lines, outside (readable, of no member), repeated. Lines are equal by their canonical JSON."""
    found = existing(spark, paths)
    empty = spark.createDataFrame([], "value string")
    lines = spark.read.text(found) if found else empty
    blank = F.trim("value") == ""
    is_object = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
    m = members.select(F.col(members.columns[0]).cast("string").alias("_m")).distinct().withColumn("_in", F.lit(True))
    read = lines.select(F.from_json("value", schema).alias("row"), F.get_json_object("value", f"$.{field}").alias("_m"), F.when(~blank & ~is_object, "invalid").when(blank, "empty").alias("_bad"))
    j = read.join(m, "_m", "left").withColumn("_kind", F.coalesce("_bad", F.when(F.col("_in"), "kept").otherwise("outside")))
    kept = j.where("_kind = 'kept'").withColumn("_key", F.to_json("row")).dropDuplicates(["_key"]).select("row.*")
    count = lambda kind: F.count_if(F.col("_kind") == kind)
    counters = j.withColumn("_key", F.when(F.col("_kind") == "kept", F.to_json("row"))).agg(
        F.count("*").alias("lines"), count("empty").alias("empty_lines"), count("invalid").alias("invalid_lines"), count("outside").alias("outside"), (count("kept") - F.count_distinct("_key")).alias("repeated")
    )
    return kept, counters


def _fault(ok: Column, what: str, name: Column) -> Column:
    return F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit(what + ": "), name)).cast("boolean"))


CHART = "chart struct<error:string,result:array<struct<meta:struct<symbol:string,exchangeTimezoneName:string>,timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"


def chart_json(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """symbol, date, open, high, low, close, adjusted_close, volume and adjustment_factor from files of one chart each, whose values are parallel arrays.

    A file with an error, another zone, arrays of different lengths, a missing value or a repeated date ends the job. Dates are those of the zone. A chart without timestamps has no rows."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", CHART).alias("c"), F.input_file_name().alias("_file"))
    r = t.select("_file", (F.col("c.chart.error").isNull() & (F.size("c.chart.result") == 1)).alias("_one"), F.get("c.chart.result", F.lit(0)).alias("r"))
    r = r.where(_fault(F.coalesce(F.col("_one"), F.lit(False)), "no single chart", F.col("_file"))).where(_fault(F.coalesce(F.col("r.meta.exchangeTimezoneName") == zone, F.lit(False)), "another zone", F.col("_file")))
    q, times = F.get("r.indicators.quote", F.lit(0)), F.coalesce("r.timestamp", F.array().cast("array<long>"))
    arrays = {c: q[c] for c in ("open", "high", "low", "close", "volume")} | {"adjusted_close": F.get("r.indicators.adjclose", F.lit(0))["adjclose"]}
    r = r.select("_file", F.col("r.meta.symbol").alias("symbol"), times.alias("_t"), *[a.alias(c) for c, a in arrays.items()])
    whole = F.lit(True)
    for c in arrays:
        whole = whole & F.coalesce((F.size(c) == F.size("_t")) & ~F.exists(c, lambda x: x.isNull()), F.size("_t") == 0)
    r = r.where(_fault(whole, "missing values", F.col("_file")))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds("t").cast("timestamp_ntz")).cast("date")
    x = r.select("_file", "symbol", F.explode(F.arrays_zip(F.col("_t").alias("t"), *[F.col(c) for c in arrays])).alias("x")).select("_file", "symbol", "x.*").withColumn("date", local)
    n = x.groupBy("_file", "date").agg(F.count("*").alias("_n"))
    x = x.join(n, ["_file", "date"]).where(_fault(F.col("_n") == 1, "repeated date", F.col("_file")))
    return x.select("symbol", "date", "open", "high", "low", "close", "adjusted_close", "volume", (F.col("adjusted_close") / F.nullif("close", F.lit(0.0))).alias("adjustment_factor"))


def chart_xml(spark: SparkSession, path: str, encoding: str = "euc-kr") -> DataFrame:
    """symbol, name, date, open, high, low, close, volume and change from files of one chart each, whose items are six values between bars.

    A file that cannot be decoded, without chart or items, with an item of another width or of no whole numbers, with a repeated date, of another
    timeframe than day, or whose declared count differs ends the job. change is against the date before, null on the first."""
    decode = F.pandas_udf(lambda x: x.map(lambda b: bytes(b).decode(encoding)), "string")
    b = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), decode("content").alias("x"))
    b = b.withColumn("x", F.regexp_replace("x", r"^\s*<\?xml[^>]*\?>", ""))
    at = lambda name: F.get(F.xpath("x", F.lit(f"//chartdata/@{name}")), F.lit(0))
    c = b.select("_file", F.lpad(F.coalesce(at("symbol"), F.lit("")), 6, "0").alias("symbol"), at("name").alias("name"), at("count").try_cast("int").alias("_count"), at("timeframe").alias("_frame"), F.xpath("x", F.lit("//chartdata/item/@data")).alias("items"))
    days = F.size(F.array_distinct(F.transform("items", lambda i: F.substring_index(i, "|", 1))))
    ok = (F.size("items") > 0) & (F.coalesce(F.col("_count"), F.size("items")) == F.size("items")) & (F.col("_frame") == "day") & (days == F.size("items")) & F.forall("items", lambda i: i.rlike(r"^[0-9]{8}(\|-?[0-9]+){5}$"))
    x = c.where(_fault(F.coalesce(ok, F.lit(False)), "broken chart", F.col("_file"))).select("_file", "symbol", "name", F.explode("items").alias("i")).withColumn("f", F.split("i", r"\|"))
    x = x.select("_file", "symbol", "name", F.to_date(F.col("f")[0], "yyyyMMdd").alias("date"), *[F.col("f")[k].cast("long").alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)])
    w = Window.partitionBy("_file").orderBy("date")
    return x.withColumn("change", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).drop("_file")


def ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of one file for each entity: the entity is the file's name up to the first underscore."""
    schema = "date date, open double, high double, low double, close double, volume double"
    name = F.regexp_extract(F.input_file_name(), r"([^/_]+)(?:_[^/]*)?\.csv", 1)
    return spark.read.csv(path, schema=schema, header=True).withColumn("ticker", name)


def write_once(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table that is never revised: an existing one is an error."""
    w = df.withColumn("record_sha256", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def merge_releases(base: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Both releases; rows with equal key must be equal, or the job fails."""
    u = base.unionByName(added).distinct()
    n = u.groupBy(*key).agg(F.count("*").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("conflicting rows for "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))
    return u.join(n, key).where(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(True)).drop("_n")
