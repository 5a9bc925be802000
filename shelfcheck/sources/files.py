"""Text inputs: mapping files, parsed-price files, URL lists, captures. Each parser takes lines or bodies as a
DataFrame, so the same code serves `spark.read.text` and any table that holds such text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructType

from ..functions import patterns as P
from ..functions import text as T
from ..schemas import PARSED_ROW
from ..session import kept_table, shared_folder


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _content(lines: DataFrame) -> DataFrame:
    line = T.clean_edges(F.col("value"))
    return lines.withColumn("value", line).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def parse_mappings(lines: DataFrame, header: str = "product_key") -> tuple[DataFrame, DataFrame]:
    """Lines `key,retailer,url,match,note` to (mappings, rejected lines). Match defaults to exact; commas in a note stay."""
    rows = _content(lines).where(~F.startswith(F.lower("value"), F.lit(header)))
    parts = F.transform(F.split("value", ","), T.clean_edges)
    cell = lambda i: F.nullif(F.get("p", F.lit(i)), F.lit(""))
    fields = rows.withColumn("p", parts).select(
        "value",
        cell(0).alias("key"),
        cell(1).alias("retailer"),
        cell(2).alias("url"),
        F.coalesce(cell(3), F.lit("exact")).alias("match"),
        F.nullif(F.array_join(F.slice("p", F.lit(5), F.greatest(F.size("p") - 4, F.lit(0))), ","), F.lit("")).alias("match_note"),
    )
    complete = F.col("key").isNotNull() & F.col("retailer").isNotNull() & F.col("url").isNotNull()
    sound = complete & F.col("match").isin(P.MATCHES)
    return fields.where(sound).drop("value"), fields.where(~sound).select("value")


def parse_url_list(lines: DataFrame) -> DataFrame:
    return _content(lines).select(F.col("value").alias("url"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as `value`, with their `path`; nothing in them has to be readable."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def stream_bodies(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same of files as they arrive, up to `files` of them a micro-batch."""
    read = spark.readStream.option("maxFilesPerTrigger", files)
    return read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def read_parsed_prices(spark: SparkSession, path: str) -> DataFrame:
    """Parsed-price files, one JSON object each: `parsed_rows` of them."""
    return parsed_rows(read_bodies(spark, path))


# The type contract of a parsed row: field, kinds of JSON value it may have.
_NUMBER, _TEXT = ("BIGINT", "DECIMAL", "DOUBLE"), ("STRING",)
CONTRACT = {
    "product_title": _TEXT, "price": (*_NUMBER, "VOID"), "price_evidence": (*_TEXT, "VOID"), "was_price": (*_NUMBER, "VOID"),
    "delivery_cost": (*_NUMBER, "VOID"), "delivery_note": (*_TEXT, "VOID"), "stock": _TEXT, "match": _TEXT,
    "match_note": (*_TEXT, "VOID"), "confidence": _NUMBER, "ignored": ("ARRAY<STRING>", "ARRAY<VOID>"),
}
ALLOWED = {"stock": P.AVAILABILITIES, "match": P.MATCHES}


#: What an import asks of a row beside that: a page may have no product title, but a row must say what it is about.
IMPORT_CONTRACT = CONTRACT | {"product_title": (*_TEXT, "VOID"), "page_title": (*_TEXT, "VOID"), "stock_note": (*_TEXT, "VOID"), "sku": _TEXT, "retailer": _TEXT, "url": _TEXT}
OPTIONAL = {"page_title", "stock_note"}  # may be left out as well


def parsed_rows(bodies: DataFrame, column: str = "value", contract: dict[str, tuple[str, ...]] = CONTRACT, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of every parsed-price document, none left out: the columns of `bodies`, `parser`, `row_number`, `row` (typed;
    a value of another type is NULL there) and `violations`, the fields that are missing, of another type or out of range.

    A body that is no JSON object, or has no list of rows, is one row without `row_number` and with the violation
    `document`. Values are read as VARIANT, so that a wrong type shows instead of becoming NULL unseen. With `fields` given,
    `row` holds these alone, and the others aren't read for it; violations are those of the whole row.
    """
    # Step by step in columns of their own, so that a body is parsed once and each kind is worked out once. A row is taken
    # apart in one pass, into a struct of its fields as VARIANT, which is NULL for a row that is no object.
    own = bodies.columns
    wanted = StructType([f for f in DataType.fromDDL(PARSED_ROW).fields if fields is None or f.name in fields])
    asked = dict.fromkeys([*contract, *wanted.names])
    read = bodies.select(*own, F.try_parse_json(column).alias("document"))
    read = read.select(*own, F.try_variant_get("document", "$.parser", "string").alias("parser"), F.try_variant_get("document", "$.rows", "array<variant>").alias("listed"))
    read = read.select(*own, "parser", "listed", F.col("listed").isNull().alias("unread"))
    read = read.select(*own, "parser", "unread", F.posexplode_outer("listed").alias("row_number", "raw")).where(F.col("unread") | F.col("raw").isNotNull())
    read = read.select(*own, "parser", "row_number", "unread", "raw", F.try_variant_get("raw", "$", f"struct<{','.join(f'{f}:variant' for f in asked)}>").alias("parts"))
    read = read.select(*own, "parser", "row_number", "unread", "raw", "parts", *[_kind_of(F.col("parts")[f]).alias(f"kind_of_{f}") for f in asked])
    kind = lambda f: F.col(f"kind_of_{f}")
    broken = [F.when(~F.coalesce(kind(f).isin(list(allowed)), F.lit(f in OPTIONAL)), F.lit(f)) for f, allowed in contract.items()]
    value = lambda f, t: F.try_variant_get(F.col("parts")[f], "$", t)
    broken += [F.when((kind(f) == "STRING") & ~value(f, "string").isin(allowed), F.lit(f)) for f, allowed in ALLOWED.items()]
    broken += [F.when(kind("confidence").isin(list(_NUMBER)) & ~value("confidence", "double").between(0, 1), F.lit("confidence"))]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*broken))))
    return read.select(
        *own, "parser", "row_number", F.when(F.col("raw").isNotNull(), _typed_row(wanted)).alias("row"),
        F.when(F.col("unread"), F.array(F.lit("document"))).otherwise(found).alias("violations"),
    )


def _kind_of(value: Column) -> Column:
    """Kind of a field's value, decimals without their size; NULL when it is missing."""
    return F.substring_index(F.schema_of_variant(value), "(", 1)


_UNCOMMON = {"NaN": "NaN", "+INF": "Infinity", "+Infinity": "Infinity", "Infinity": "Infinity", "-INF": "-Infinity", "-Infinity": "-Infinity"}


def _typed_row(wanted: StructType) -> Column:
    """`from_json` of the `wanted` fields of a row, read from the columns that `parsed_rows` has of it: `raw`, its `parts` and their
    kinds. A row that is a list or null, which `from_json` has rules of its own for, is left to it."""

    def field(name: str, kind: DataType) -> Column:
        value, shape = F.col("parts")[name], F.col(f"kind_of_{name}")
        if isinstance(kind, DoubleType):
            # `from_json` takes numbers and the names of those that JSON can't write.
            text = F.try_variant_get(value, "$", "string")
            named = F.coalesce(*[F.when(text == n, F.lit(float(v))) for n, v in _UNCOMMON.items()])
            return F.when(shape == "STRING", named).when(shape.isin(list(_NUMBER)), F.try_variant_get(value, "$", "double"))
        if isinstance(kind, IntegerType):
            whole = F.try_variant_get(value, "$", "int")
            return F.when(shape.isin("BIGINT", "DECIMAL") & (F.try_variant_get(value, "$", "double") == whole), whole)
        return F.try_variant_get(value, "$", kind.simpleString())

    raw = F.col("raw")
    own_rules = F.col("parts").isNull() & (F.is_variant_null(raw) | F.try_variant_get(raw, "$", "array<variant>").isNotNull())
    return F.when(own_rules, F.from_json(F.to_json(raw), wanted)).otherwise(F.struct(*[field(f.name, f.dataType).alias(f.name) for f in wanted.fields]))


def accepted(rows: DataFrame) -> DataFrame:
    """(parser, row) of the rows of `parsed_rows` that keep the contract."""
    return rows.where(F.size("violations") == 0).select("parser", "row")


def rejected(rows: DataFrame) -> DataFrame:
    """What breaks it: the body's columns, the row's number and its violations."""
    return rows.where(F.size("violations") > 0).drop("parser", "row")


def capture_key(url: Column) -> Column:
    """Content address of a capture: first 24 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 24)


def captures_for(urls: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures of the given urls, found by their content address."""
    keyed = urls.select("url", capture_key(F.col("url")).alias("capture_key")).distinct()
    return keyed.join(captures.drop("url"), "capture_key")


def capture_files(spark: SparkSession, folder: str) -> DataFrame:
    """The capture files `<content address>.json` of a folder. Their contents are read only where `content` is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)


def contents_of(files: DataFrame, names: list[str]) -> DataFrame:
    """(file, content) of the files of these names; the others are left out of the scan and not opened."""
    name = F.col("_metadata.file_name")
    return files.where(name.isin(names)).select(name.alias("file"), "content")


def parsed_captures(contents: DataFrame) -> DataFrame:
    """(file, content) to (file, fetched_at, extract_id, title, published, excerpts, text, error_type, http_status, unread).

    `unread` marks a file that holds no JSON object; all else is NULL there, as is a field that is missing or of another type.
    """
    raw = F.try_parse_json(F.make_valid_utf8(F.col("content").cast("string")))
    read = contents.select("file", F.when(F.schema_of_variant(raw).startswith("OBJECT"), raw).alias("doc"))
    # A number would become text unseen: only what is text in the file is taken as such.
    kind = lambda p: F.schema_of_variant(F.try_variant_get("doc", p, "variant"))
    string = lambda p: F.when(kind(p) == "STRING", F.try_variant_get("doc", p, "string"))
    status = "$.error.http_status_code"
    return read.select(
        "file",
        T.instant(string("$.fetchedAt")).alias("fetched_at"),
        string("$.extractId").alias("extract_id"),
        string("$.result.title").alias("title"),
        string("$.result.publish_date").alias("published"),
        F.when(kind("$.result.excerpts") == "ARRAY<STRING>", F.try_variant_get("doc", "$.result.excerpts", "array<string>")).alias("excerpts"),
        string("$.result.full_content").alias("text"),
        string("$.error.error_type").alias("error_type"),
        F.when(kind(status) == "BIGINT", F.try_variant_get("doc", status, "int")).alias("http_status"),
        F.col("doc").isNull().alias("unread"),
    )


#: Names that one read of capture files is given, on average at most half of it.
CAPTURE_BLOCK = 10_000


def read_captures(urls: DataFrame, folder: str, block: int = CAPTURE_BLOCK) -> DataFrame:
    """The captures of the given urls from a folder of files: url and the columns of `parsed_captures`, one row per distinct url
    that has a file. NULL urls have none, and an empty file counts as none: Spark's file sources pass over it.

    The listing meets the urls' content addresses first; then only the files that were hit are opened, named to Spark's file
    source in blocks, so that the driver holds the names of one block. Each block's rows are appended to a table in the
    shared folder.
    """
    spark = urls.sparkSession
    files = capture_files(spark, folder)
    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.concat(capture_key(F.col("url")), F.lit(".json")).alias("file"))
    hits = kept_table(wanted.join(files.select(F.col("_metadata.file_name").alias("file")), "file"), "capture-hits")
    slots = -(-2 * hits.count() // block)
    placed = kept_table(hits.select("file", F.pmod(F.xxhash64("file"), F.lit(max(slots, 1))).alias("slot")), "capture-slots")
    path = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    parsed_captures(contents_of(files, [])).write.parquet(path)
    for slot in range(slots):
        names = [r["file"] for r in placed.where(F.col("slot") == slot).select("file").distinct().collect()]
        if names:
            parsed_captures(contents_of(files, names)).write.mode("append").parquet(path)
    return hits.join(spark.read.parquet(path), "file").drop("file")


def read_sitemaps(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """Blocks `url` (or `sitemap`) of sitemap files, read by Spark's XML source, which splits large files: file, entry (sorts
    as the blocks stand in their file), url, lastmod (an unreadable one is NULL), unread. A block that is no sound XML is
    kept whole in `unread`; one without a location has neither."""
    rows = spark.read.format("xml").schema("loc string, lastmod string, unread string").option("rowTag", tag).option("columnNameOfCorruptRecord", "unread")
    rows = rows.option("useLegacyXMLParser", True).load(path)  # block by block: the other one gives up a file at its first broken block
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    location = F.when(F.col("unread").isNull(), F.nullif(T.clean_edges(F.col("loc")), F.lit("")))
    return rows.select(F.col("_metadata.file_path").alias("file"), place.alias("entry"), location.alias("url"), T.instant(T.clean_edges(F.col("lastmod"))).alias("lastmod"), "unread")
