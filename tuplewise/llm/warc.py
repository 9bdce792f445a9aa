"""WARC archives: writing pages as records, and reading with boundary-chain verification.

Writing.  A row becomes a record: ``response`` with an HTTP head and the payload, or,
for a payload of at least ``MIN_REVISIT`` bytes that a page of smaller id has too,
``revisit`` with the HTTP head alone, which refers to that page.  Equal payloads are
found by SHA-256 in a narrow table; the smallest id of a digest combines map-side.
Records are written by Spark's text writer with the record separator as line
separator, which puts bytes out as they are, so any store that Spark writes to will
do and a file is exactly a WARC file (uncompressed, so that it can be split).

Reading.  The text reader cuts files at the magic ``WARC/1.1`` CR LF, in tasks over
blocks of a file.  Lengths of the pieces add up to offsets: within a block, and over
the blocks of a file.  Each piece is a candidate record; its header gives the offset
of its successor.  Within a block, a task follows each candidate's chain to the offset
at which it leaves the block.  Between blocks, pointer jumping from the start of each
file keeps the candidates at which the file's own chain enters a block: offsets and jump
pointers double their stride each round, so rounds follow the logarithm of the blocks
of a file, over a row or a few for each block.  From these entries a task marks the
records of its block.  A magic within a payload starts a piece that no chain reaches,
whatever its header claims.

A payload that holds no magic lies in one piece, and is digested where it is read.
Files with records of several pieces are read once more and stored by piece, and these
records put together, each bounded by its record.  Everything else moves numbers
only: files are known by a 64-bit hash of their path, and no table of candidates is
broadcast.

Defined results: a null html is an empty payload; a null page_id is always a
response and refers to nothing; repeated rows are one page (all responses, if the
first); a null url has no target header, and line ends in a url are escaped; extra
columns are ignored; empty tables and folders give empty results; a file that
doesn't start with a record has none, and a chain ends where no record starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuplewise.llm.common import cut, small_batches

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
MIN_REVISIT = 100
#: digests with more than one page that are broadcast (of some 100 bytes each); more are joined by shuffle
BROADCAST_ROWS = 200_000
#: a record that claims more bytes isn't one
LONGEST = 1 << 50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.filter(f"payload_bytes >= {MIN_REVISIT} AND page_id IS NOT NULL").select("page_id", "payload_digest")
    first = cut(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    few = first.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(first) if few else first, "payload_digest", "left")
    again = F.coalesce((F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= MIN_REVISIT), F.lit(False))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as WARC files to ``folder``."""
    rows = with_revisits(pages)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uri(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Refers-To", F.when(revisit, _uri(F.col("refers_to")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(GAP),
    )
    rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", GAP).text(folder)


def _field(head: Column, name: str) -> Column:
    """A header's value; null where it is missing."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between magics: file, fid, block, seq (order within a block; a piece's number), value, raw, size."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    raw = F.col("value").cast("binary")
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"), raw.alias("raw"), F.octet_length("value").cast("long").alias("size"),
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the candidate's header fields, and its payload if the piece holds the whole record."""
    head = F.substring_index("value", GAP, 1)
    out = pieces.withColumns({"head": head, "head_bytes": F.octet_length(head).cast("long")})
    length = F.when(F.col("head_bytes") < F.col("size"), F.expr(r"try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1) AS BIGINT)"))
    out = out.withColumn("length", F.when(length <= LONGEST, length))
    out = out.withColumn("total", F.col("head_bytes") + 4 + F.col("length") + 4)
    return out.withColumn("whole", F.coalesce(F.col("total") == F.col("size"), F.lit(False)))


def _opened(records: DataFrame) -> DataFrame:
    """Digest, length and references of records with ``head`` and ``body`` (binary block)."""
    http = F.substring_index(F.col("body").cast("string"), GAP, 1)
    kind = _field(F.col("head"), "WARC-Type")
    out = records.withColumns({"record_type": kind, "http": http})
    payload = F.expr("substring(body, octet_length(http) + 5)")
    page = lambda name: F.expr("try_cast(" + "regexp_extract(_x, '<urn:page:([^>]*)>', 1) AS BIGINT)".replace("_x", name))
    out = out.withColumns({"_id": _field(F.col("head"), "WARC-Record-ID"), "_ref": _field(F.col("head"), "WARC-Refers-To"), "payload": payload})
    again = F.col("record_type") == "revisit"
    return out.select(
        *[c for c in records.columns if c not in ("head", "body")], "record_type", page("_id").alias("page_id"), page("_ref").alias("refers_to"), _field(F.col("head"), "WARC-Target-URI").alias("url"),
        F.when(again, F.expr(r"try_cast(regexp_extract(http, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1) AS BIGINT)")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), "([0-9a-fA-F]+)$", 1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
    )


def _inside(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each ``to``, its place among the sorted offsets ``at``; -1 if it isn't there."""
    place = np.minimum(np.searchsorted(at, to), len(at) - 1)
    return np.where(at[place] == to, place, -1)


def _chained(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    """Offsets of the pieces of one block, their successors' (-1: no candidate), and where their chains leave the block."""
    pieces = pieces.sort_by("seq")
    step = pieces["size"].to_numpy() + len(MAGIC)
    at = pieces["base"].to_numpy() + np.cumsum(step) - step - len(MAGIC)
    total = pieces["total"].fill_null(-1).to_numpy()
    after = np.where((total >= 0) & (at >= 0), at + len(MAGIC) + total, -1)
    leaves, place = after.tolist(), np.where(after >= 0, _inside(at, after), -1).tolist()
    for i in range(len(leaves) - 1, -1, -1):
        if place[i] > i and after[place[i]] >= 0:
            leaves[i] = leaves[place[i]]
    columns = {"fid": pieces["fid"], "block": pieces["block"], "seq": pieces["seq"], "whole": pieces["whole"], "at": pa.array(at, pa.int64()), "next": pa.array(after, pa.int64())}
    return pa.table(columns | {"leaves": pa.array(leaves, pa.int64())})


def _marked(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    """The pieces of one block with ``real`` (a record starts) and the record of this block that they belong to, or follow (own, own_next, own_whole)."""
    pieces = pieces.sort_by("at")
    at, after, whole = (pieces[c].to_numpy() for c in ("at", "next", "whole"))
    real = pieces["entry"].fill_null(False).to_numpy().copy()
    place = np.where(after >= 0, _inside(at, after), -1).tolist()
    for i in range(len(place)):
        if real[i] and place[i] > i and after[place[i]] >= 0:
            real[place[i]] = True
    own = np.maximum.accumulate(np.where(real, np.arange(len(real)), -1))
    none = own < 0
    columns = {"fid": pieces["fid"], "block": pieces["block"], "seq": pieces["seq"], "at": pieces["at"], "real": pa.array(real), "whole": pieces["whole"]}
    return pa.table(columns | {"own": pa.array(at[own], mask=none), "own_next": pa.array(after[own], mask=none), "own_whole": pa.array(whole[own], mask=none)})


def _chains(table: DataFrame) -> DataFrame:
    """Of each piece of ``table``: fid, block, seq, whole, at, next, leaves."""
    blocks = table.groupBy("fid", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    before = F.sum("span").over(Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    blocks = blocks.select("fid", "block", F.coalesce(before, F.lit(0)).alias("base"))
    placed = table.select("fid", "block", "seq", "whole", "size", "total").join(blocks.hint("merge"), ["fid", "block"])
    return placed.groupBy("fid", "block").applyInArrow(_chained, "fid long, block long, seq long, whole boolean, at long, next long, leaves long")


def _marks(chains: DataFrame, entries: DataFrame) -> DataFrame:
    marks = chains.join(entries.hint("merge"), ["fid", "at"], "left").groupBy("fid", "block")
    return marks.applyInArrow(_marked, "fid long, block long, seq long, at long, real boolean, whole boolean, own long, own_next long, own_whole boolean")


def reachable(candidates: DataFrame) -> DataFrame:
    """The (fid, at) on the chains of ``candidates`` (fid, at, next) from offset 0 of each file, by pointer jumping."""
    jumps = cut(candidates.select("fid", "at", "next"))
    reached = jumps.filter("at = 0").select("fid", "at")
    while True:
        further = jumps.join(reached.hint("merge"), ["fid", "at"]).select("fid", F.col("next").alias("at"))
        alive = jumps.select("fid", F.col("at").alias("next"), F.col("next").alias("after"))
        jumps = cut(jumps.join(alive.hint("merge"), ["fid", "next"]).select("fid", "at", F.col("after").alias("next")))
        further = further.join(candidates.select("fid", "at").hint("merge"), ["fid", "at"], "left_semi")
        reached = cut(reached.union(further))
        if not jumps.limit(1).count():
            return reached


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files in ``folder``: file, at, record_type, page_id, refers_to, url, payload_bytes, payload_digest."""
    small_batches(spark)
    parsed = _parsed(_pieces(spark, folder))
    body = F.when(F.col("whole"), F.expr("substring(raw, cast(head_bytes + 5 AS INT), cast(length AS INT))"))
    first = parsed.select(
        "file", "fid", "block", "seq", "size", "total", "whole",
        F.when(F.col("whole"), F.col("head")).alias("head"), body.alias("body"),
    )
    table = cut(_opened(first))
    fields = [c for c in table.columns if c not in ("file", "fid", "block", "seq", "size", "total", "whole")]
    chains = cut(_chains(table))
    candidates = chains.filter("next >= 0")
    # a file's chain enters a block at the file's start, or where another chain has left a block
    doors = candidates.select("fid", F.col("leaves").alias("at")).union(candidates.filter("at = 0").select("fid", "at")).distinct()
    doors = cut(candidates.select("fid", "at", F.col("leaves").alias("next")).join(doors.hint("merge"), ["fid", "at"], "left_semi"))
    entries = reachable(doors).distinct().withColumn("entry", F.lit(True))
    marks = cut(_marks(chains, entries))
    records = table.filter("whole").join(marks.filter("real AND whole").select("seq", "at").hint("merge"), "seq").select("file", "at", *fields)
    spread = marks.filter("real AND NOT whole")
    if not spread.limit(1).count():
        return records
    # the blocks of this reading may be others, but offsets in files are the same
    again = _parsed(_pieces(spark, folder)).join(spread.select("fid").distinct().hint("merge"), "fid", "left_semi")
    again = cut(again.select("file", "fid", "block", "seq", "size", "total", "whole", "raw"))
    starts = marks.filter("real").select("fid", "at", F.lit(True).alias("entry"))
    pieces = cut(_marks(_chains(again), starts))
    # a block in which no record starts, or what precedes the first one, belongs to the last record before
    lasts = pieces.groupBy("fid", "block").agg(F.max(F.when(F.col("real"), F.struct("at", F.col("own_next").alias("next"), "whole"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    owned = pieces.join(lasts.select("fid", "block", before.alias("last")).hint("merge"), ["fid", "block"])
    own = lambda name, last: F.when(F.col("own").isNull(), F.col(f"last.{last}")).otherwise(F.col(name))
    owned = owned.select("seq", "at", own("own", "at").alias("own"), own("own_next", "next").alias("own_next"), own("own_whole", "whole").alias("own_whole"))
    owned = owned.filter("own IS NOT NULL AND NOT own_whole AND at < own_next").select("seq", "at", "own")
    parts = again.select("file", "seq", "raw").join(owned.hint("merge"), "seq").groupBy("file", F.col("own").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    value = F.array_join(F.transform("parts", lambda part: part["raw"].cast("string")), MAGIC)
    whole = _parsed(parts.select("file", "at", value.alias("value")).withColumn("size", F.octet_length("value").cast("long")))
    body = F.expr("substring(cast(value AS BINARY), cast(head_bytes + 5 AS INT), cast(length AS INT))")
    return records.unionByName(_opened(whole.select("file", "at", "head", body.alias("body"))))
