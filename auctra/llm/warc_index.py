"""Operator 10, WARC archives: index first, then coalesced range reads.

Every task writes its records to one archive after another in the shared folder, each record a gzip
member of its own, and returns one index row per record: file, offset, length, URL, digest. The index
table is the commit: files of failed attempts are in no index row and are never read. Reading sorts the
selected index rows of a file by offset, joins ranges that lie close into one read, and parses the
records back.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is the
response and the others are revisits that refer to it; all other records are responses.

Defined results: a null payload is empty. A null URL leaves out the target header. Rows with a null id
are responses of their own, and never referred to. If several rows have the id of the response, all of them are
responses. Repeated rows are written each. Extra columns are ignored. An empty table gives no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctra.llm.common import materialise, shared_dir

MIN_BYTES = 1000
#: An archive is closed after so many bytes.
FILE_BYTES = 64 << 20
#: Ranges with a smaller gap are read together, up to so many bytes at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

_DATE = "1970-01-01T00:00:00Z"  # records carry no fetch time
_ID = "<urn:page:{}>"

INDEX = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()),
])
_READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.StringType()),
])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit if ``refers_to`` is given, as one gzip member."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _ID.format("" if page_id is None else page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()))
    if revisit:
        fields += [("WARC-Refers-To", _ID.format(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; digest and size of a response are taken from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if kind == "response" else size,
        "payload_digest": hashlib.sha1(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    }


def _writer(folder: str, limit: int):
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for pdf in batches:
            rows = []
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"]):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed already
                page_id = None if pd.isna(page_id) else int(page_id)
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = record(page_id, url, payload, None if pd.isna(refers_to) else int(refers_to))
                out.write(data)
                rows.append((name, at, len(data), page_id, url, hashlib.sha1(payload).hexdigest()))
                at += len(data)
                if at >= limit:
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=INDEX.names).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes page_id, url, html to archives under ``folder`` (a URI); returns the written index."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = materialise(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")), "warc-digests")
    # Payloads that occur twice or more; the aggregate is pre-combined and written, so that both
    # sides of the join are plain exchanges, which adaptive execution can split at a hot payload.
    twice = small.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    twice = materialise(twice.select("digest", "refers_to"), "warc-copies")
    revisits = materialise(small.join(twice, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    rows = pages.withColumn("digest", F.sha1(payload)).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return materialise(rows.mapInPandas(_writer(folder, file_bytes), INDEX), "warc-index")


def _reader(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        spans = sorted(zip(pdf["offset"].tolist(), pdf["length"].tolist()))
        found = []
        with store.open_input_file(f"{base}/{pdf['file'].iloc[0]}") as f:
            i = 0
            while i < len(spans):
                j, start, end = i, spans[i][0], sum(spans[i])
                while j + 1 < len(spans) and spans[j + 1][0] - end <= GAP_BYTES and sum(spans[j + 1]) - start <= READ_BYTES:
                    j += 1
                    end = max(end, sum(spans[j]))
                data = f.read_at(end - start, start)
                found += [parse(data[o - start : o - start + n]) for o, n in spans[i : j + 1]]
                i = j + 1
        return pd.DataFrame(found, columns=_READ.names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of the selected index rows; a group holds the index rows of one archive of bounded size."""
    run = _reader(folder)
    if payload:
        return selected.groupBy("file").applyInPandas(run, _READ)
    slim = T.StructType([f for f in _READ if f.name != "payload"])
    return selected.groupBy("file").applyInPandas(lambda pdf: run(pdf).drop(columns="payload"), slim)


def new_folder(spark) -> str:
    """A fresh folder in the shared one, as a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: DuckDB form of the query over pages (unique page_ids).
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT d.*, CASE WHEN m.last != d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m.last != d.page_id THEN m.last END AS refers_to
FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest AND d.payload_bytes >= {MIN_BYTES}
"""
