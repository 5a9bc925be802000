"""WARC archives written and read by Spark.

Writing: one record per page, payload the page's HTML in UTF-8. Of records with equal payloads, that with the largest
id is the response and the others are revisits that refer to it; payloads below `least_bytes` are always responses. A
record is a string, so archives go through Spark's text writer: any storage, and failed tasks leave nothing behind.

Reading by boundary chains: archives are split by Spark's text reader at the magic line, wherever it stands, and every
piece is a candidate record with a successor: its own place plus the length that its header declares. Whether a piece
is a record is only known from the file's start. A file's places are cut into stretches of `STRETCH` bytes, however Spark
splits the file (compressed ones aren't split), and chains are first followed inside a stretch; then pointer jumping over
the stretches' entry places, from each file's first byte, finds where the true chain enters every stretch, and what can't
be reached from there is not a record but part of one: magic lines inside payloads are rejected, and the payload they cut
is put together again. The number of rounds is the logarithm of the stretches of a file.

Null HTML is an empty payload. A null id writes an empty one and reads back as null; it may revisit others but is
never referred to, so equal payloads that all lack an id are all responses. Rows repeating the response's id are
responses as well. Line ends in a URL are percent-encoded; a null URL writes no target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

MAGIC = "WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STRETCH = 1 << 22
_END = "\r\n\r\n"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every five hex digits are four base32 digits."""
    hexadecimal = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _record(page_id: Column, url: Column, payload: Column, refers_to: Column, date: str) -> Column:
    """The record without its last line feed, which the writer adds. Every part is text and none is null."""
    size = F.octet_length(payload).cast("string")
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(_END))
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "),
        urn(page_id),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        digest(payload),
        F.when(refers_to.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), urn(refers_to), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"))),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_END),
        block,
        F.lit(_END[:-1]),
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip", id_column: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one archive per task to `folder`. Which pages are copies is decided on their SHA-256 and length; only keys
    with copies are joined back. Other columns are not read."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    keyed = pages.select(
        F.col(f"`{id_column}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key")
    )
    long_enough = F.octet_length("payload") >= least_bytes
    copies = keyed.filter(long_enough).groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("key", "response")
    copies = written(copies, "warc-copies")
    joined = keyed.join(copies, "key", "left")
    refers_to = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    record = joined.withColumn("refers_to", refers_to).select(_record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("refers_to"), date).alias("value"))
    record.write.option("lineSep", "\n").option("compression", compression).text(folder)


_PIECE = "file string, block bigint, inside bigint, size bigint, reach bigint, value string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order in which the reader yields them, with the place of each in its split."""
    now, total = None, 0
    for batch in batches:
        files, blocks, sizes = (batch.column(i).to_pylist() for i in range(3))
        inside = np.zeros(batch.num_rows, np.int64)
        for i, (here, size) in enumerate(zip(zip(files, blocks), sizes)):
            if here != now:
                now, total = here, 0
            inside[i] = total
            total += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inside), *[batch.column(i) for i in range(2, 5)]], [x.split()[0] for x in _PIECE.split(", ")])


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece between magic lines: its split, place in the split, bytes after its magic line, and, if it reads as a
    record's header, the bytes that the record takes with its magic line."""
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    head = F.substring_index("value", _END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1)
    is_head = F.contains(F.col("value"), F.lit(_END)) & head.rlike(r"(?im)^WARC-Type:") & (length != "")
    reach = F.when(is_head, F.lit(len(MAGIC) + 2 * len(_END)) + F.octet_length(head) + length.cast("bigint"))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("bigint").alias("size"), reach.alias("reach"), "value")
    return rows.mapInArrow(_placed, _PIECE)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a stretch, the first place outside the stretch's candidates that its chain leads to."""
    rows = rows.sort_values("at", ascending=False, kind="stable")
    to: dict[int, int] = {}
    for at, end in zip(rows["at"].tolist(), rows["to"].tolist()):
        to[at] = to.get(end, end)
    return rows.assign(leaves=[to[a] for a in rows["at"].tolist()])


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a stretch that its entries lead to."""
    rows = rows.sort_values("at", kind="stable")
    reached: set[int] = set()
    keep = []
    for at, end, entry in zip(rows["at"].tolist(), rows["to"].tolist(), rows["entry"].tolist()):
        keep.append(entry or at in reached)
        if keep[-1]:
            reached.add(end)
    return rows[keep][["file", "stretch", "at", "to"]]


def _jumped(candidates: DataFrame) -> DataFrame:
    """(file, at): the places at which the chain from each file's start enters a stretch, by pointer jumping.

    `candidates`: file, stretch, at, to. Only candidates that another stretch's chain leads to can be entries."""
    exits = written(candidates.groupBy("file", "stretch").applyInPandas(_exits, "file string, stretch bigint, at bigint, to bigint, leaves bigint"), "warc-exits")
    starts = exits.filter("at = 0").select("file", "at")
    targets = exits.select("file", F.col("leaves").alias("at")).unionByName(starts).distinct()
    jump = written(exits.join(targets, ["file", "at"], "left_semi").select("file", "at", F.col("leaves").alias("to")), "warc-jumps")
    stretches = exits.groupBy("file").agg(F.countDistinct("stretch").alias("n")).agg(F.max("n")).first()[0] or 1
    reached = starts
    for _ in range((stretches - 1).bit_length()):
        reached = written(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "warc-jumps")
    return reached


def read(spark: SparkSession, folder: str, stretch: int = STRETCH) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of every record of the archives.
    A revisit's payload is null; its size and digest are those of the payload it stands for, from its headers."""
    found = written(pieces(spark, folder), "warc-pieces")
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"))
    # A piece's record would begin with the magic line before it; the piece ahead of a file's first magic line has none.
    at = F.col("base") + F.col("inside") - len(MAGIC)
    light = found.select("file", "block", "inside", "size", "reach").join(base, ["file", "block"]).withColumn("at", at)
    light = written(light.select("file", "block", "inside", "size", "at", (F.col("at") + F.col("reach")).alias("to")), "warc-places")
    candidates = light.filter("to is not null and at >= 0").select("file", F.floor(F.col("at") / stretch).alias("stretch"), "at", "to")
    entries = _jumped(candidates).withColumn("entry", F.lit(True))
    flagged = candidates.join(entries, ["file", "at"], "left").select("file", "stretch", "at", "to", F.coalesce("entry", F.lit(False)).alias("entry"))
    true = flagged.groupBy("file", "stretch").applyInPandas(_walked, "file string, stretch bigint, at bigint, to bigint").select("file", "at", F.lit(True).alias("true"))
    # Pieces that aren't one whole record: what precedes the first, records cut by a magic line in them, and their parts.
    whole = F.col("true").isNotNull() & (F.col("to") - F.col("at") == F.col("size") + len(MAGIC))
    owner = F.last(F.when(F.col("true"), F.struct("at", "to")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    parts = light.join(true, ["file", "at"], "left").select("file", "block", "inside", "at", whole.alias("whole"), owner.alias("owner")).filter("not whole")
    parts = written(parts.select("file", "block", "inside", "at", F.when(F.col("at") < F.col("owner.to"), F.col("owner.at")).alias("owner")), "warc-parts")
    place = ["file", "block", "inside"]
    wholes = found.join(parts.select(place), place, "left_anti").select("value")
    cut = found.join(parts.filter("owner is not null"), place).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
    return _fields(wholes.unionByName(cut.select(F.array_join(F.col("all.value"), MAGIC).alias("value"))))


def _fields(records: DataFrame) -> DataFrame:
    """Headers and payload of whole records."""
    head, rest = F.substring_index("value", _END, 1), lambda c, h: F.substr(c, F.length(h) + 5)
    named = lambda h, name: F.nullif(F.regexp_extract(h, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint")
    df = records.select(head.alias("head"), rest(F.col("value"), head).alias("block"))
    df = df.withColumn("block", F.substr("block", F.lit(1), F.length("block") - len(_END)))
    http = F.substring_index("block", _END, 1)
    df = df.select("head", http.alias("http"), rest(F.col("block"), http).alias("payload"))
    kind = named(F.col("head"), "WARC-Type")
    revisit = kind == "revisit"
    size = F.when(revisit, named(F.col("http"), "Content-Length").cast("bigint")).otherwise(F.octet_length("payload").cast("bigint"))
    return df.select(
        page(named(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        named(F.col("head"), "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        page(named(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        size.alias("payload_bytes"),
        F.when(revisit, F.substring(named(F.col("head"), "WARC-Payload-Digest"), 6, 32)).otherwise(digest(F.col("payload"))).alias("payload_digest"),
    )
