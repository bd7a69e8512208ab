"""WARC archives with revisit resolution.

Headers (id, url, digests, length) are written down without payloads. They alone are shuffled by payload digest, pre-aggregated, to find for
equal payloads the record that keeps the payload; the others become revisit records, made from their headers. The pages that are left
are written as responses where they lie: a bitmap of the revisits' row hashes tells most of them that they are none, and the
few others meet the list of those whose bit is set by chance. Every record is written with fresh headers and is byte-exact WARC/1.1: a
row of Spark's text writer is a record without its last two line ends, which are the writer's line separator. Files hold
FILE_BYTES on average and MOST_FILE_BYTES at most, unless one record is larger; they are read back record by record, and revisits are joined to their
original responses, by record id; a revisit without one is an error.

Defined results: null html is an empty payload; payloads below `least` bytes are always written; among rows that share the largest id
and the payload all are responses; a null id gives a record without an id, read back as null, and is the smallest; line ends in a
url are percent-encoded; an empty table gives an empty archive and no rows. Payloads are equal if SHA-1, SHA-256 and length are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import folder, may_hold, released, stored

LEAST_BYTES = 1000
FILE_BYTES, MOST_FILE_BYTES = 32 << 20, 1 << 30  # of records before compression
LARGE_BYTES = 1 << 20  # payloads in files of their own
HEADER_BYTES = 600  # of a record, about
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _record(rows: DataFrame, revisit: bool, date: str) -> DataFrame:
    """Records of rows (page_id, url, sha1, and html, or keeper for revisits) as text."""
    body = F.lit(HTTP) if revisit else F.concat(F.lit(HTTP), F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    nothing = F.lit("")
    refers = [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("keeper.page_id"), F.col("keeper.url"), F.col("sha1")))] if revisit else []
    record = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.lit("revisit" if revisit else "response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("sha1"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), nothing), F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), nothing),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), *refers,
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")), F.lit(END), body)
    return rows.select(record.alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, date: str | None = None) -> None:
    """One record per row under `path`, gzip-compressed."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    own = [F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"), F.col("html")]
    rows = rows.select("*", F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("second"), *own).alias("b"), F.octet_length("html").cast("bigint").alias("n"))
    binary = F.col("html").cast("binary")
    headers = stored(rows.select("page_id", "url", "a", "b", "n", F.sha1(binary).alias("sha1"), F.when(F.col("n") >= least, F.sha2(binary, 256)).alias("strong")), "warc-headers")
    total = headers.agg(F.count("*").alias("rows"), F.sum(F.col("n") + HEADER_BYTES).alias("bytes"), F.max("n").alias("most")).first()
    keeps = headers.where(F.col("n") >= least).groupBy("sha1", "strong", "n").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    keeps = stored(keeps, "warc-keepers")  # by itself, so that the join of a payload on many pages can be split
    linked = headers.join(keeps, ["sha1", "strong", "n"]).where(~F.col("keeper.page_id").eqNullSafe(F.col("page_id")))
    revisits = stored(linked.select("page_id", "url", "a", "b", "sha1", "keeper"), "warc-revisits")
    # Headers whose bit is set although they are no revisit's; next to none while there are fewer revisits than bits.
    chance = may_hold(headers.select("a", "b"), F.col("a"), revisits, F.col("a")).where("maybe").select("a", "b").distinct()
    chance = stored(chance.join(revisits.select("a", "b"), ["a", "b"], "left_anti"), "warc-chance")
    marked = may_hold(rows, F.col("a"), revisits, F.col("a"))
    responses = marked.where("not maybe").drop("maybe")
    if not chance.isEmpty():
        doubtful = may_hold(marked.where("maybe").drop("maybe"), F.col("b"), chance, F.col("b")).where("maybe").drop("maybe")
        responses = responses.unionByName(doubtful.join(chance, ["a", "b"]).select(responses.columns))
    responses = responses.withColumn("sha1", F.sha1(binary))

    def write(part: DataFrame, per_file: int) -> None:
        part.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file)).text(path)

    usual = FILE_BYTES * total["rows"] // max(1, total["bytes"] or 1)
    small = _record(responses.where(F.col("n") <= LARGE_BYTES), False, date).unionByName(_record(revisits, True, date))
    write(small, min(usual, MOST_FILE_BYTES // (LARGE_BYTES + HEADER_BYTES)))
    if (total["most"] or 0) > LARGE_BYTES:
        write(_record(responses.where(F.col("n") > LARGE_BYTES), False, date), MOST_FILE_BYTES // (total["most"] + HEADER_BYTES))


def records(content: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; compressed content is unpacked as it is read."""
    end = END.encode()

    def parts() -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        rest, at = zlib.decompressobj(31), 0
        while at < len(content):
            yield rest.decompress(content[at:at + step])
            at += step
            while rest.eof:  # members may follow one another
                left, rest = rest.unused_data, zlib.decompressobj(31)
                if not left:
                    break
                yield rest.decompress(left)

    source, buffer = parts(), bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            part = next(source, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        looked = 0
        while (at := buffer.find(end, max(0, looked - 3))) < 0:
            looked = len(buffer)
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
        lines = buffer[:at].decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size, first = int(fields["Content-Length"]), at + len(end)
        if not lines[0].startswith("WARC/") or not fill(first + size + len(end)) or buffer[first + size:first + size + len(end)] != end:
            raise ValueError("an archive's record doesn't have the length that its headers say")
        yield fields, bytes(buffer[first:first + size])
        del buffer[:first + size + len(end)]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to; those of a revisit come from its response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "record", "response", "digest", "n"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[] for _ in names]
                for fields, block in records(content.as_py()):
                    payload = block[block.index(END.encode()) + 4:]
                    own = fields["WARC-Type"] != "revisit"
                    page = fields.get("X-Page-ID")
                    row = (None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), hashlib.sha1(payload).hexdigest() if own else None, len(payload) if own else None)
                    for column, value in zip(out, row):
                        column.append(value)
                    if len(out[0]) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                        out = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = stored(files.mapInArrow(released(run), "page_id long, url string, record_type string, record string, response string, digest string, n long"), "warc-read")
    responses = found.where("record_type = 'response'")
    kept = responses.groupBy(F.col("record").alias("response")).agg(F.max("page_id").alias("refers_to"), F.first("digest").alias("payload_digest"), F.first("n").alias("payload_bytes"))
    named = stored(found.where("record_type = 'revisit'").select("response").distinct().join(kept, "response"), "warc-named")  # by itself, so that a hot response's join can be split
    revisits = found.where("record_type = 'revisit'").drop("digest", "n").join(named, "response", "left")
    missing = F.raise_error(F.concat(F.lit("no response in the archives for the revisit record "), F.col("record"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("payload_bytes").isNull(), missing).otherwise(F.col("payload_bytes")))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select("page_id", "url", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*columns))


def op7(spark, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).drop("url")


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d FROM p),
g AS (SELECT d, n, max(page_id) AS m FROM d WHERE n >= {LEAST_BYTES} GROUP BY d, n)
SELECT page_id, d.n AS payload_bytes, d.d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM d LEFT JOIN g ON g.d = d.d AND g.n = d.n
"""
