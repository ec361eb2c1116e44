"""WARC archives written from and read back as a chunked record table.

A payload travels as rows of one record identifier, a chunk number and at most ``CHUNK`` bytes; each row
carries the digest of the payload up to its end, so a reader can check every chunk as it comes.
In the archive each chunk is a record of its own: the first is a ``response`` (or ``revisit``), the
others are ``continuation`` segments that name the record they belong to. Archives are gzip files of at
most ``FILE_RECORDS`` records, written by Spark's own committer with the record separator as line
separator. They are read as streams: a file is inflated piece by piece, records of one segment are
digested while they pass, and segments of longer ones become chunk rows again, which are
dealt by record, sorted by number and digested one after the other. Nothing but a chunk is ever held.

Of equal payloads of ``LEAST`` bytes or more, the record with the least id holds the payload, the
others revisit it. Which one that is comes from an aggregation over slim (digest, id) rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_schema, map_arrow, shuffle_partitions, sliced_rows, utf8
from orderlens.session import Scratch

CHUNK, FILE_RECORDS, LEAST = 64 << 10, 4096, 100
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"

CHUNKS = "row long, page_id long, url string, chunk int, chunks int, data binary, bytes long, digest string, prefix_digest string"
READ = "row long, page_id long, kind string, refers_to long, segment int, data binary, bytes long, digest string, prefix_digest string"


def chunk_table(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                payload_column: str = "html", chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of each page's payload, at least one; null payloads are empty."""
    def work(batches):
        def rows(b):
            for row, page, url, payload in zip(*(b.column(i) for i in range(4))):
                view = memoryview(payload.as_buffer()) if payload.as_buffer() is not None else memoryview(b"")
                cuts = range(0, max(1, len(view)), chunk)
                running, prefixes = hashlib.sha256(), []
                for at in cuts:
                    running.update(view[at:at + chunk])
                    prefixes.append(running.hexdigest())
                for k, at in enumerate(cuts):
                    yield (row.as_py(), page.as_py(), url.as_py(), k, len(cuts), bytes(view[at:at + chunk]),
                           len(view), prefixes[-1], prefixes[k])
        for b in batches:
            yield from sliced_rows(rows(b), arrow_schema(CHUNKS))

    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("page_id"),
                          F.col(url_column).cast("string").alias("url"), utf8(payload_column).alias("payload"))
    return map_arrow(source, work, CHUNKS)


def revisits(chunks: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of payloads that a smaller id has too. Null ids refer to the least id, if any."""
    payloads = scratch.keep(chunks.where(F.col("chunk") == 0).where(F.col("bytes") >= least)
                            .select("page_id", "digest"), "payloads")
    first = scratch.keep(payloads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
                         .where("n > 1").drop("n"), "first")
    return scratch.keep(payloads.join(first, "digest").where("NOT page_id <=> refers_to AND refers_to IS NOT NULL")
                        .distinct(), "revisits")


def _clean(value: Column) -> Column:
    """Header values without control characters and blanks."""
    return F.regexp_replace(F.coalesce(value, F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")


def write_archives(chunks: DataFrame, decided: DataFrame, path: str) -> None:
    """Write the chunk table as WARC files below ``path``."""
    again = decided.withColumnRenamed("page_id", "id")
    joined = chunks.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (chunks.digest == again.digest), "left") \
        .drop(again.digest).where("refers_to IS NULL OR chunk = 0")
    revisit = F.col("refers_to").isNotNull()
    data = F.when(~revisit, F.col("data")).otherwise(F.lit(b""))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("row"))
    # concat_ws leaves out headers that do not apply.
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").when(F.col("chunk") > 0, "continuation").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name, F.when(F.col("chunk") > 0, F.concat(F.lit(":"), "chunk")).otherwise(""), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.when((F.col("chunks") > 1) & ~revisit, F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk") + 1)),
        F.when(F.col("chunk") > 0, F.concat(F.lit("WARC-Segment-Origin-ID: "), name, F.lit(">"))),
        F.when((F.col("chunk") > 0) & (F.col("chunk") == F.col("chunks") - 1),
               F.concat(F.lit("WARC-Segment-Total-Length: "), "bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), "refers_to", F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(data, 256)),
        F.concat(F.lit("X-Payload-Length: "), "bytes"), F.concat(F.lit("X-Prefix-Digest: sha256:"), "prefix_digest"),
        F.concat(F.lit("Content-Length: "), F.octet_length(data)))
    record = F.concat(F.concat(header, F.lit(CRLF * 2)).cast("binary"), data).cast("string")
    joined.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(packed, piece: int = 1 << 16) -> Iterator[bytes]:
    """Inflate gzip members one after the other, piece by piece."""
    engine, at = zlib.decompressobj(31), 0
    while at < len(packed):
        data, at = bytes(packed[at:at + piece]), at + piece
        while data:
            yield engine.decompress(data, piece)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and block pieces of each record of a stream; a block must be read before the next record."""
    held = b""

    def more() -> bool:
        nonlocal held
        got = next(pieces, None)
        held += got or b""
        return got is not None

    while True:
        while held[:2] == b"\r\n" or len(held) < 2:  # the end of the record before
            if held[:2] == b"\r\n":
                held = held[2:]
            elif not more():
                if held:
                    raise ValueError("archive ends within a record")
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("archive ends within a header")
        lines = held[:end].decode("utf-8").split(CRLF)
        held = held[end + 4:]
        fields = dict(x.split(": ", 1) for x in lines[1:])
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")

        def block(left: int):
            nonlocal held
            while left:
                if not held and not more():
                    raise ValueError("archive ends within a block")
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part

        body = block(int(fields["Content-Length"]))
        yield fields, body
        for _ in body:
            pass


def _number(urn: str, place: int) -> int | None:
    text = urn.strip("<>").split(":")[place]
    return None if text == "null" else int(text)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below ``path``.

    Digests and lengths of responses are those of the bytes read, and must be the stated ones; those
    of revisits are the stated ones of the payload they refer to.
    """
    def parse(batches):
        def rows(packed):
            for fields, body in records(inflated(packed)):
                kind, urn = fields["WARC-Type"], fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                segment = int(fields.get("WARC-Segment-Number", 0))
                stated, prefix = fields["WARC-Payload-Digest"][7:], fields["X-Prefix-Digest"][7:]
                size, data = int(fields["X-Payload-Length"]), None
                if segment:
                    data = b"".join(body)
                elif kind == "response":
                    running, count = hashlib.sha256(), 0
                    for part in body:
                        running.update(part)
                        count += len(part)
                    if (running.hexdigest(), count) != (stated, size):
                        raise ValueError(f"payload of {urn} is not what its header says")
                refers = fields.get("WARC-Refers-To")
                yield (_number(urn, 3), _number(urn, 2), kind, refers and _number(refers, 2), segment, data, size, stated, prefix)
        for b in batches:
            for content in b.column("content"):
                yield from sliced_rows(rows(memoryview(content.as_buffer())), arrow_schema(READ))

    def digest(batches):
        out = arrow_schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

        def rows():
            row, expected, running, count = None, 1, hashlib.sha256(), 0
            for b in batches:
                for r in b.to_pylist():
                    if not r["segment"]:
                        yield r["page_id"], r["bytes"], r["digest"], r["kind"], r["refers_to"]
                        continue
                    if r["row"] != row:
                        row, expected, running, count = r["row"], 1, hashlib.sha256(), 0
                    running.update(r["data"])
                    count += len(r["data"])
                    if r["segment"] != expected or running.hexdigest() != r["prefix_digest"]:
                        raise ValueError(f"segment {r['segment']} of page {r['page_id']} is damaged or out of place")
                    expected += 1
                    if count == r["bytes"]:
                        yield r["page_id"], count, running.hexdigest(), "response", None
        yield from sliced_rows(rows(), out)

    files = spark.read.format("binaryFile").load(path).select("content")
    dealt = map_arrow(files, parse, READ).repartition(shuffle_partitions(spark), "row").sortWithinPartitions("row", "segment")
    return map_arrow(dealt, digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` as archives in the scratch folder and read them back.

    A row gives a record, repeated rows too; of repeated ids with equal payloads all with the least
    id are responses. Null ids stay null; null urls are ``about:blank``, null payloads empty. An
    empty table gives an empty result. Other columns are not read.
    """
    chunks = chunk_table(pages, chunk=chunk)
    path = f"{scratch.path}/archives"
    write_archives(chunks, revisits(chunks, scratch), path)
    return read_archives(pages.sparkSession, path)
