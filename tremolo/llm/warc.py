r"""Legacy archives to WARC, WARC files through Spark's writers, and back.

An ARC file starts with a version block whose second line gives the version and whose third
names the fields of the header lines; each record is one header line, as many bytes as its
last field declares, and a newline. Versions 1 (URL IP-address Archive-date Content-type
Archive-length) and 2 (with Result-code Checksum Location Offset Filename before the length)
are read by the fields their own block names; a URL with blanks keeps them, as the other
fields are counted from the line's end. Records are cut by declared length alone, so
a payload may hold anything, header lines included.

Each ARC record becomes a WARC record: a name-based UUID as identifier (of page_id and payload digest
where there is a page_id, so rows that repeat both are one record written twice; of the archive's digest
and the place in it otherwise), the archive date as WARC-Date, 8 to 13 digits filled up with zeros, the server's address, SHA-1 digests of payload and block, and the type: warcinfo
for the version block, resource for blocks that aren't HTTP, response for the rest. Of
responses with equal payloads of at least 1000 bytes the one with the largest page_id is the
response and the others revisit it.
An HTTP block ends its head at the first blank line, of CR LF or of LF alone, and is kept byte by byte. The page_id
is read from the head only in archives that this module wrote, and goes on in a header field of its own.
On the way back every block and payload is hashed again and held against its digest; revisits take size
and digest of the record that they refer to.
WARC files are written as text files whose row separator is the blank line that ends a
record, so the archive is written and retried by Spark itself, wherever its store is.

Defined cases: null html is an empty payload; null and empty urls are written as `-`, control
characters of urls percent-encoded; empty and short payloads are always responses; rows that
repeat page_id and payload are each written, and all with the largest page_id are responses;
extra columns are ignored; an empty table gives no rows. A record that can't be taken (a date that is
none, fields missing from its header line, a digest that doesn't fit) becomes a row with the reason in
error, and reading goes on behind its declared length. Where an archive can't be read on (a record cut
short, a length that is no number), what came before is kept and such a row stands for the rest.
Very long payloads are held whole, one record at a time: a file of
RECORDS_PER_FILE records must stay below the 2 GB that a row can hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm._store import checkpoint_dir, cut

LEAST_BYTES = 1000
ARC_BYTES = 4 << 20
RECORDS_PER_FILE = 1000
#: Payloads that occur more than once, up to which their list is broadcast; beyond, the join shuffles.
SMALL = 100_000
#: When the pages are taken to have been fetched; the table has no date.
FETCHED = "20240101000000"

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
#: The line of a WARC header that carries the page_id.
PAGE = "X-Page-Id"
#: Who wrote an archive, in its version block.
AUTHOR = b"tremolo"
_HEAD_END = re.compile(rb"\r?\n\r?\n")
#: What a header line can't hold.
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def arc_file(records: list[tuple], version: int, name: str = "pages.arc") -> bytes:
    """records: (url, content type, date, block as bytes)."""
    about = f"{version} 0 {AUTHOR.decode()}\n{ARC_FIELDS[version]}\n".encode()
    out, at = [], 0

    def add(url: str, kind: str, date: str, block: bytes) -> None:
        nonlocal at
        more = "" if version == 1 else f" 200 - - {at} {name}"
        x = f"{url} 0.0.0.0 {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"
        at += len(x)
        out.append(x)

    add(f"filedesc://{name}", "text/plain", FETCHED, about)
    for r in records:
        add(*r)
    return b"".join(out)


def read_arc(content: bytes, about: bool = False) -> Iterator[dict]:
    """Fields of each header line, by the names in the file's version block, and the block.

    about: the version block comes first. A header line with fields missing gives only an error.
    ValueError where the archive can't be read on.
    """
    names, at = None, 0
    while at < len(content):
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace")
        n = int(line.rpartition(" ")[2])
        block = content[end + 1 : end + 1 + n]
        if n < 0 or len(block) < n:
            raise ValueError(f"record at {at} declares {n} bytes, {len(block)} are there")
        first = names is None
        if first:
            lines = block.split(b"\n")
            names = lines[1].decode().split(" ") if len(lines) > 1 else []
            if int(block.split(b" ", 1)[0]) not in ARC_FIELDS or len(names) < 5:
                raise ValueError("unknown archive version")
        values = line.rsplit(" ", len(names) - 1)
        bad = None if len(values) == len(names) else f"header line at {at} has {len(values)} fields, the version block names {len(names)}"
        here, at = at, end + 1 + n
        if content[at : at + 1] == b"\n":
            at += 1
        if bad:
            yield {"error": bad}
        elif about or not first:
            yield dict(zip(names, values)) | {"block": block, "at": here}


def _pages_to_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of about 4 MB, of both versions in turn."""
    version, held, size = 1, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([arc_file(held, version)], pa.binary())], ["arc"])

    for batch in batches:
        for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
            held.append((_CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "-"), "text/html", FETCHED, head + (html or b"")))
            size += len(held[-1][3])
            if size >= ARC_BYTES:
                yield flush()
                version, held, size = 3 - version, [], 0
    if held:
        yield flush()


_CONVERTED = "page_id long, type string, key string, uri string, ip string, mime string, date string, head binary, payload binary, error string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with the blank line that ends it, and payload; without one all is head."""
    end = _HEAD_END.search(block)
    return (block, b"") if end is None else (block[: end.end()], block[end.end() :])


def _number(text: str) -> int | None:
    """A 64-bit whole number, or None."""
    return int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def _as_warc(r: dict, is_about: bool, ours: bool) -> dict:
    """One ARC record as a row; head is null where the block isn't HTTP."""
    d = r["Archive-date"]
    if not re.fullmatch(r"[0-9]{8,}", d):
        raise ValueError(f"{d} is no date")
    d = d[:14].ljust(14, "0")
    out = {"page_id": None, "uri": r["URL"], "ip": r.get("IP-address"), "mime": r["Content-type"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "head": None, "payload": r["block"], "error": None}
    if is_about:
        version = r["block"].split(b" ", 1)[0].decode()
        return out | {"type": "warcinfo", "mime": "application/warc-fields", "payload": f"format: WARC File Format 1.1\r\nisPartOf: {r['URL']}\r\ndescription: converted from ARC version {version}\r\n".encode()}
    if not r["block"].startswith(b"HTTP/"):
        return out | {"type": "resource"}
    head, payload = _split_http(r["block"])
    page = re.search(rb"^X-Page-Id: *(.*?) *\r?$", head, re.M) if ours else None
    return out | {"type": "response", "page_id": _number(page[1].decode("latin-1")) if page else None, "mime": "application/http; msgtype=response", "head": head, "payload": payload}


def _rows_of_arc(arc: bytes) -> list[dict]:
    rows, name, ours = [], hashlib.sha1(arc).hexdigest(), False
    try:
        for k, r in enumerate(read_arc(arc, about=True)):
            if k == 0:
                ours = r.get("block", b"").split(b"\n", 1)[0].split(b" ")[2:3] == [AUTHOR]
            try:
                rows.append(r if "error" in r else _as_warc(r, k == 0, ours) | {"key": f"{name}:{r['at']}"})
            except (ValueError, KeyError) as e:
                rows.append({"error": f"{type(e).__name__}: {e}"})
    except (ValueError, KeyError) as e:
        rows.append({"error": f"{type(e).__name__}: {e}"})
    return rows


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_CONVERTED)
    for batch in batches:
        for arc in batch.column(0):
            yield pa.RecordBatch.from_pylist(_rows_of_arc(arc.as_py()), schema)


def convert_arcs(arcs: DataFrame) -> DataFrame:
    """arcs(arc binary) as rows page_id, type, key, uri, ip, mime, date, head, payload, error, digest (hex), n."""
    rows = arcs.select("arc").mapInArrow(_convert, _CONVERTED)
    return rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))


def with_revisits(records: DataFrame, payloads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds refers_to: the largest page_id with the same payload, where that is another row's.

    payloads(page_id, digest, n): the same rows without what is large, aggregated before they meet.
    """
    best = payloads.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies"))
    best = cut(best.where("copies > 1").select("digest", "best"))
    if best.count() <= SMALL:  # then the payloads needn't move
        best = F.broadcast(best)
    rows = records.join(best, "digest", "left")
    differs = (F.col("type") == "response") & F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best")))
    return rows.withColumn("refers_to", F.when(differs & (F.col("n") >= least), F.col("best"))).drop("best")


def _urn(*named):
    h = F.sha1(F.concat_ws("|", *named).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _page_urn(page):
    return _urn(F.lit("page"), page.cast("string"), F.col("digest"))


def render(records: DataFrame) -> DataFrame:
    """One column, value (bytes as they are, UTF-8 or not): WARC records without the blank line that ends them."""
    c = F.col
    revisit = c("refers_to").isNotNull()
    none = F.lit(b"")
    block = F.concat(F.coalesce(c("head"), none), F.when(revisit, none).otherwise(c("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(c("type"))),
        line("WARC-Record-ID", F.when(c("page_id").isNotNull(), _page_urn(c("page_id"))).otherwise(_urn(c("key")))),
        line(PAGE, c("page_id").cast("string")),
        F.when(revisit, line("WARC-Refers-To", _page_urn(c("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(c("type") != "warcinfo", line("WARC-Target-URI", c("uri"))),
        F.when(~c("ip").isin("0.0.0.0", "-"), line("WARC-IP-Address", c("ip"))),
        line("WARC-Date", c("date")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        line("Content-Type", c("mime")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return records.select(F.concat(F.concat(header, F.lit(END)).cast("binary"), block).cast("string").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Rows with an error are left out."""
    render(records.where("error is null")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_warc(content: bytes) -> Iterator[dict]:
    """Header fields of each record, and its block, cut by declared length. ValueError or KeyError where it can't be read on."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {name: value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        block = content[end + 4 : end + 4 + n]
        if n < 0 or len(block) < n:
            raise ValueError(f"record at {at} declares {n} bytes, {len(block)} are there")
        yield fields | {"block": block}
        at = end + 4 + n + 4


def _sha1_hex(digest: str | None) -> str | None:
    """Hex of a labelled SHA-1 in hex or base 32; None of other digests."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


_BACK = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, url string, error string"


def _back(r: dict) -> dict:
    block, kind = r["block"], r["WARC-Type"]
    payload = _split_http(block)[1] if block.startswith(b"HTTP/") else block
    out = {"record_id": r["WARC-Record-ID"], "page_id": _number(r.get(PAGE, "")), "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(),
           "record_type": kind, "refers_to_id": r.get("WARC-Refers-To"), "url": r.get("WARC-Target-URI")}
    payload_digest = _sha1_hex(r.get("WARC-Payload-Digest"))
    if kind == "revisit":  # its payload is elsewhere: what is declared is held against that
        out["payload_digest"] = payload_digest
    elif payload_digest not in (None, out["payload_digest"]):
        raise ValueError(f"payload of {out['record_id']} doesn't have the digest declared")
    if _sha1_hex(r.get("WARC-Block-Digest")) not in (None, hashlib.sha1(block).hexdigest()):
        raise ValueError(f"block of {out['record_id']} doesn't have the digest declared")
    return out


def _rows_of_warc(content: bytes) -> list[dict]:
    rows = []
    try:
        for r in read_warc(content):
            try:
                if r["WARC-Type"] != "warcinfo":
                    rows.append(_back(r))
            except (ValueError, KeyError) as e:
                rows.append({"error": f"{type(e).__name__}: {e}"})
    except (ValueError, KeyError) as e:
        rows.append({"error": f"{type(e).__name__}: {e}"})
    return rows


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_BACK)
    for batch in batches:
        for content in batch.column(0):
            yield pa.RecordBatch.from_pylist(_rows_of_warc(content.as_buffer().to_pybytes()), schema)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record but warcinfo, error rows included.

    Revisits get size, digest and page_id of the record that they refer to, and an error where
    that isn't there or has another digest; foreign ones without a WARC-Refers-To stay as they are.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = cut(files.mapInArrow(_read_back, _BACK))  # the files are read and hashed once
    of = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("of_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"), F.max("payload_digest").alias("full_digest"))
    # rows that refer to nothing meet their own id, so that nulls don't gather in one task
    rows = rows.join(of, F.coalesce("refers_to_id", "record_id") == F.col("of_id"), "left")
    c = F.col
    revisit = (c("record_type") == "revisit") & c("refers_to_id").isNotNull()
    lost = F.when(revisit & c("full_digest").isNull(), F.lit("the record referred to isn't here"))
    other = F.when(revisit & (c("full_digest") != c("payload_digest")), F.lit("the record referred to has another digest"))
    return rows.select("page_id", F.when(revisit, c("full_bytes")).otherwise(c("payload_bytes")).alias("payload_bytes"), F.when(revisit, c("full_digest")).otherwise(c("payload_digest")).alias("payload_digest"),
                       "record_type", F.when(revisit, c("refers_to")).alias("refers_to"), "url", F.coalesce("error", lost, other).alias("error"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """pages(page_id, url, html) as ARC files, converted, written as WARC at path, read back."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    payloads = pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n"))
    records = convert_arcs(pages.mapInArrow(_pages_to_arcs, "arc binary"))
    write_warc(with_revisits(records, payloads), path)
    return read_warcs(spark, path)
