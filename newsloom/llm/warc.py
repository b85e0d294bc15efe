"""WARC archives written and read by Spark, with record boundaries proved by a chain.

Writing: one record per page, through Spark's own text writer (the record separator is the line separator), so files
land by the job's committer in any file system Spark can reach.  Equal payloads are stored once: the smallest page_id
is the response, the others are revisits that refer to it.

Reading: every split is cut at the version line.  A task cannot tell a record start from the same bytes inside a
payload, so it emits candidates: their offset, and the offset where the next record must start.  Pointer jumping from
the start of each file, O(log records) rounds of joins, keeps the candidates that the chain reaches; all others are
payload bytes and are given back to the record around them.

Defined results: a null html is an empty payload; rows that repeat a page_id and a payload are all responses (or all
revisits of the same record); null ids rank last, and are responses only where no id is known; control characters in a
URL are percent-encoded; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut, release, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 4096
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from built-ins: 20 bits of the hex form give four letters."""
    bits = [F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(_BASE32), 1, 32).substr(F.shiftright(b, s).bitwiseAND(31) + 1, F.lit(1)) for b in bits for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _clean_url(url: Column) -> Column:
    out = F.coalesce(url, F.lit(""))
    for code in (13, 10, 0, 9, 32):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n (bytes), digest, refers_to (null for responses)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("n"), F.sha1(body).alias("sha1"))
    first = rows.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("sha1", "first")
    # Written first: while few payloads repeat, the planner sees a small table and leaves the payloads where they are.
    first = cut(first, "payloads")
    joined = rows.join(first, "sha1", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", "n", refers.alias("refers_to"))


def _record(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block_bytes = F.when(revisit, F.lit(0)).otherwise(F.col("n") + len(_HTTP))
    lines = [
        F.concat(F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean_url(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"), F.lit(f"\r\nWARC-Profile: {_PROFILE}"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string")),
    ]
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2026-01-01T00:00:00Z", min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``path`` as a folder of WARC/1.1 files of at most ``records_per_file`` records."""
    records = plan_records(pages, page_id, url, html, min_bytes).select(_record(date).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = "file string, block long, at long, size long, header long, jump long, kind string, page_id long, refers_to long, digest string, payload_bytes long, found string, whole boolean"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_NUMBER = re.compile(rb"<urn:page:(-?\d*)>")


def _base32(digest: bytes) -> str:
    n = int.from_bytes(digest, "big")
    return "".join(_BASE32[n >> s & 31] for s in range(155, -1, -5))


def parse(piece: bytes) -> dict:
    """Header values of a candidate: the bytes after a version line.  Without a length it has no successor."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return {}
    fields = dict(line.split(b": ", 1) for line in piece[:stop].split(b"\r\n") if b": " in line)
    length = fields.get(b"Content-Length", b"")
    if not length.isdigit():
        return {}
    number = lambda k: int(m[1]) if (m := _NUMBER.match(fields.get(k, b""))) and m[1] else None
    said = fields.get(b"X-Payload-Length", b"")
    return {
        "header": stop + 4,
        "length": int(length),
        "kind": fields.get(b"WARC-Type", b"").decode("ascii", "replace"),
        "page_id": number(b"WARC-Record-ID"),
        "refers_to": number(b"WARC-Refers-To"),
        "digest": fields.get(b"WARC-Payload-Digest", b"").decode("ascii", "replace").removeprefix("sha1:"),
        "payload_bytes": int(said) if said.isdigit() else None,
    }


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a response block."""
    stop = block.find(b"\r\n\r\n")
    return block[stop + 4 :] if stop >= 0 else b""


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets inside the split run on from batch to batch; a split's rows come in file order."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    schema = pa.schema([(n, _KINDS[x.split()[1]]) for n, x in zip(names, _FIELDS.split(", "), strict=True)])
    where, at = None, 0
    for batch in batches:
        rows = []
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            piece = value.as_py()
            if where != (file, block):
                where, at = (file, block), 0
            row = {"file": file, "block": block, "at": at, "size": len(piece)}
            got = parse(piece)
            if got:
                length = got.pop("length")
                own = len(MAGIC) + got["header"] + length + len(END)
                row |= got | {"jump": own, "whole": len(piece) == got["header"] + length + len(END)}
                if row["whole"] and got["kind"] == "response":
                    row["found"] = _base32(hashlib.sha1(payload_of(piece[got["header"] : got["header"] + length])).digest())
            rows.append(row)
            at += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(rows, schema)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, at = None, 0
    for batch in batches:
        places = []
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if where != (file, block):
                where, at = (file, block), 0
            places.append(at)
            at += len(value.as_buffer()) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.int64()), batch.column(0)], names=["file", "block", "at", "value"])


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place that may start a record, with its absolute offset ``start`` (of the version line) and ``next``.

    A split does not know its own offset among the records; the sizes of the splits before it in the file, one row
    each, say it.  What stands before a file's first version line counts as a piece without a record.
    """
    local = cut(_pieces(spark, path).mapInArrow(_candidates, _FIELDS), "warc")
    splits = local.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("at") - len(MAGIC)
    return local.join(bases, ["file", "block"]).select(*local.columns, start.alias("start"), (start + F.col("jump")).alias("next"))


def reachable(found: DataFrame, rounds: int = 62) -> DataFrame:
    """(file, start) of the candidates that the chain from offset 0 of their file reaches, by pointer jumping.

    Each round a node's pointer leaps over its target's pointer and reached nodes mark their target, so after k rounds
    the first 2**k records of every file are marked.  The loop ends when no reached node has a pointer left.
    """
    state = cut(found.filter(F.col("start") >= 0).select("file", "start", "next", (F.col("start") == 0).alias("reached")), "chain")
    for _ in range(rounds):
        target = state.select(F.col("file").alias("_f"), F.col("start").alias("_s"), F.col("next").alias("_n"))
        marks = state.filter("reached AND next IS NOT NULL").select(F.col("file").alias("_mf"), F.col("next").alias("_m")).distinct()
        leap = state.join(target, (F.col("file") == F.col("_f")) & (F.col("next") == F.col("_s")), "left")
        leap = leap.join(marks, (F.col("file") == F.col("_mf")) & (F.col("start") == F.col("_m")), "left")
        new = cut(leap.select("file", "start", F.col("_n").alias("next"), (F.col("reached") | F.col("_m").isNotNull()).alias("reached")), "chain")
        release(state)
        state = new
        if state.filter("reached AND next IS NOT NULL").isEmpty():
            break
    return state.filter("reached").select("file", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record on the chain: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    ``verified`` says that a response's stored payload has the digest and size of its header.
    """
    found = cut(candidates(spark, path), "warc")
    chain = reachable(found).withColumn("on_chain", F.lit(True))
    marked = cut(found.join(chain, ["file", "start"], "left"), "warc")
    records = marked.filter("on_chain")
    entire = records.filter("whole OR kind <> 'response'").select("page_id", "payload_bytes", "digest", "kind", "refers_to", "found")
    # Pieces that a version line inside a payload has cut off belong to the last chained record before them.
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", "block", "at", "start", F.max(F.when(F.col("on_chain"), F.col("start"))).over(order).alias("owner"))
    broken = records.filter("NOT whole AND kind = 'response'").select(F.col("file"), F.col("start").alias("owner"), "header", "jump", "page_id", "payload_bytes", "digest", "kind", "refers_to")
    wanted = cut(owned.join(broken, ["file", "owner"]), "warc")  # written, so that a small one needs no shuffle of bodies
    parts = _pieces(spark, path).mapInArrow(_bodies, "file string, block long, at long, value binary").join(wanted, ["file", "block", "at"])
    fields = ["file", "owner", "header", "jump", "page_id", "payload_bytes", "digest", "kind", "refers_to"]
    # The parts of one record: as many bytes as its own payload.
    joined = parts.groupBy(*fields).agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    restore = F.udf(_restore, "string")
    mended = joined.select("page_id", "payload_bytes", "digest", "kind", "refers_to", restore("p", "header", "jump").alias("found"))
    every = entire.unionByName(mended)
    verified = (F.col("kind") != "response") | F.col("found").eqNullSafe(F.col("digest"))
    return every.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", verified.alias("verified"))


def _restore(parts, header: int, jump: int) -> str:
    body = MAGIC.encode().join(bytes(p["value"]) for p in parts)
    block = body[header : jump - len(MAGIC) - len(END)]
    return _base32(hashlib.sha1(payload_of(block)).digest())


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to a folder of the shared directory and reads them back."""
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
