"""WARC archives: one gzip member per record, written by executors and read sequentially.

The reader inflates a stream a bounded block at a time, finds member ends by zlib, frames
each record by its Content-Length and verifies block and payload digests as the bytes
pass; it holds a payload only where the caller wants it. The writer gives each task one
archive in a shared folder. A revisit carries no payload, only the digest and the
standard headers that name the response (``WARC-Refers-To``, ``-Target-URI``, ``-Date``);
``resolve`` follows them to the response that was read, and takes length and digest there.

Scale: ids, digests and lengths shuffle, html does not, but for the false positives of a
bounded Bloom filter. A digest that many pages share is a hot key of plain equi-joins,
which adaptive execution splits.

Recovery: a task writes under a name of its own and renames when it is done, and only the
archives named in the written manifest are read, so a repeated task leaves nothing that
is read twice.

Defined results: null html is an empty payload; a null id writes a record without one; of
equal payloads of at least ``min_bytes`` bytes the smallest id is the response and all
others revisit it, null ids too; rows that repeat that id and payload are all responses; a
row that repeats an id with another payload is a record of its own; an empty table gives
no archive and no record; other columns are ignored. A record that is cut short, fails its
digest or revisits nothing that was read comes out with ``ok`` false, and where framing is
lost its archive ends.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import checkpoint_dir, cut, delete, discard

BLOCK = 1 << 18
MAX_HEAD = 1 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# ---------------------------------------------------------------- files


def open_read(path: str):
    """A local path or file: URI is opened directly, any other through Arrow's filesystems."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return open(unquote(u.path) if u.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def open_write(folder: str, name: str):
    """(stream, finish): ``finish()`` closes, publishes under ``name`` and returns the path."""
    u = urlparse(folder)
    if u.scheme in ("", "file"):
        local = unquote(u.path) if u.scheme else folder
        os.makedirs(local, exist_ok=True)
        tmp, final = os.path.join(local, "_" + name), os.path.join(local, name)
        f = open(tmp, "wb")

        def finish() -> str:
            f.close()
            os.replace(tmp, final)
            return f"{folder}/{name}"

        return f, finish
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    f = system.open_output_stream(f"{inner}/_{name}")

    def finish_remote() -> str:
        f.close()
        system.move(f"{inner}/_{name}", f"{inner}/{name}")
        return f"{folder}/{name}"

    return f, finish_remote


# ---------------------------------------------------------------- records


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member; ``fields`` may hold an id of its own."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", **fields, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def record_id(page_id: int | None, sha: str) -> str:
    """The id of a page's response, the same for its writer and for those that refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"


def inflate(stream) -> Iterator[bytes | bool]:
    """The inflated bytes in pieces of at most ``BLOCK``; True where a member ends, False where one breaks off."""
    z, rest, begun = zlib.decompressobj(31), b"", False
    while True:
        data = rest or stream.read(BLOCK)
        if not data:
            break
        try:
            piece = z.decompress(data, BLOCK)
        except zlib.error:
            yield False
            return
        begun = True
        if piece:
            yield piece
        rest = z.unconsumed_tail
        if z.eof:
            yield True
            rest, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        yield False


class _Body:
    """Takes the block of one record piece by piece: length, digests, and the payload where it is wanted."""

    def __init__(self, fields: dict[str, str], keep: bool) -> None:
        length = fields.get("content-length", "")
        self.left = int(length) if length.isdigit() else -1
        self.http = b"" if fields.get("content-type", "").startswith("application/http") else None
        self.block, self.inner = _hasher(fields.get("warc-block-digest")), _hasher(fields.get("warc-payload-digest"))
        self.sha, self.size, self.kept = hashlib.sha256(), 0, bytearray() if keep else None

    def take(self, piece: bytes) -> None:
        self.left -= len(piece)
        if self.block:
            self.block.update(piece)
        if self.http is not None:  # the payload begins after the header of the response
            self.http += piece
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                self.http = self.http[-3:]
                return
            piece, self.http = self.http[end + 4 :], None
        self.size += len(piece)
        self.sha.update(piece)
        if self.inner:
            self.inner.update(piece)
        if self.kept is not None:
            self.kept += piece


def records(stream, keep: bool = True) -> Iterator[tuple[dict[str, str], _Body, bool]]:
    """(fields, body, ok) of each record, framed by Content-Length, whatever members it is spread over."""
    buf, fields, body, done = bytearray(), None, None, None
    for piece in inflate(stream):
        if isinstance(piece, bool):
            if done:  # a record counts once its member has ended whole
                yield *done[:2], done[2] and piece
                done = None
            if not piece or buf or fields is not None:
                if buf or fields is not None:
                    yield fields or {}, body or _Body({}, keep), False
                return
            continue
        buf += piece
        while True:
            if fields is None:
                end = buf.find(b"\r\n\r\n")
                if not buf.startswith(b"WARC/"[: len(buf)]) or end < 0 and len(buf) > MAX_HEAD:
                    if done:
                        yield done
                    yield {}, _Body({}, keep), False
                    return
                if end < 0:
                    break
                lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")[1:]
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                body = _Body(fields, keep)
                del buf[: end + 4]
                if done:
                    yield done
                    done = None
            if body.left > 0 and buf:
                n = min(body.left, len(buf))
                body.take(bytes(buf[:n]))
                del buf[:n]
            if body.left > 0 or body.left == 0 and len(buf) < 4:
                break
            if body.left < 0 or buf[:4] != b"\r\n\r\n":
                yield fields, body, False
                return
            del buf[:4]
            done = fields, body, _agrees(fields.get("warc-block-digest"), body.block)
            fields = body = None
            if not buf:
                break


def _hasher(want: str | None):
    """A hash object for a labelled digest; none for an algorithm that is unknown here, which proves nothing."""
    try:
        return hashlib.new(want.partition(":")[0].lower().replace("-", "")) if want else None
    except ValueError:
        return None


def _agrees(want: str | None, h) -> bool:
    """Whether a labelled digest (hex or base 32) is that of the bytes that ``h`` took."""
    if not want or h is None:
        return True
    value = want.partition(":")[2]
    return value.lower() == h.hexdigest() or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=")


_OUT = pa.schema([
    ("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("ok", pa.bool_()),
])
SCHEMA = "path string, record_id string, record_type string, target_uri string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to_id string, ok boolean"


def _number(s: str | None) -> int | None:
    s = (s or "").rsplit(":", 1)[-1].rstrip(">")
    return int(s) if s.lstrip("-").isdigit() else None


def _row(path: str, fields: dict[str, str], body: _Body, ok: bool) -> tuple:
    kind, want = fields.get("warc-type", ""), fields.get("warc-payload-digest")
    head = path, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), _number(fields.get("weft-page-id"))
    if kind == "revisit":  # the payload is elsewhere: only its digest is here
        return *head, None, None, (want or "").partition(":")[2] or None, fields.get("warc-refers-to"), ok
    payload = None if body.kept is None else bytes(body.kept)
    return *head, payload, body.size, body.sha.hexdigest(), None, ok and _agrees(want, body.inner)


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        for b in batches:
            for path in b.column("path").to_pylist():
                with open_read(path) as stream:
                    for fields, body, ok in records(stream, keep):
                        rows.append(_row(path, fields, body, ok))
                        held += body.size if keep else 0
                        if held > 16 << 20 or len(rows) >= 10_000:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return run


def read_warc(paths: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of the archives in the column ``path``, one row each, in ``SCHEMA``.

    Archives are read one after the other within a task; deal ``paths`` out for more tasks.
    """
    return paths.select("path").mapInArrow(_read(keep_payload), SCHEMA)


def read_warc_files(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The same over files on disk: only their names pass through Spark's reader."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return read_warc(names.repartition(max(1, spark.sparkContext.defaultParallelism), "path"), keep_payload)


def resolve(records: DataFrame) -> DataFrame:
    """The records with ``refers_to``: revisits with the page, length and digest of the response they name.

    A revisit whose response was not read, or has another digest, is not ok.
    """
    there = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    wanted = cut(revisits.select(F.col("refers_to_id").alias("record_id")).distinct())
    named = bloom.semi_by_id(there, wanted, wanted.count(), "record_id").join(wanted, "record_id", "left_semi")
    # copies of one response share its id and are equal
    named = named.groupBy(F.col("record_id").alias("named")).agg(*(F.first(c).alias(f"there_{c}") for c in ("page_id", "payload_bytes", "payload_digest", "ok")))
    met = revisits.join(named, F.col("refers_to_id") == F.col("named"), "left")
    fine = F.col("ok") & F.coalesce(F.col("there_ok") & (F.col("there_payload_digest") == F.col("payload_digest")), F.lit(False))
    columns = [c for c in records.columns if c not in ("payload_bytes", "payload_digest", "ok")]
    met = met.select(*columns, F.col("there_payload_bytes").alias("payload_bytes"), F.coalesce("there_payload_digest", "payload_digest").alias("payload_digest"), fine.alias("ok"), F.col("there_page_id").alias("refers_to"))
    rest = records.where("record_type <> 'revisit'").select(*columns, "payload_bytes", "payload_digest", "ok", F.lit(None).cast("long").alias("refers_to"))
    return rest.unionByName(met)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finish = None
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            if f is None:
                f, finish = open_write(folder, f"{uuid.uuid4().hex}.warc.gz")
                f.write(record("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: weftline\r\nformat: WARC File Format 1.1\r\n"))
            cols = [b.column(c) if c == "html" else b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit", "there_url")]
            for i, url, html, sha, ref, revisit, there in zip(*cols, strict=True):
                fields = {"WARC-Date": DATE, "WARC-Payload-Digest": f"sha256:{sha}", "Content-Type": "application/http; msgtype=response"}
                if _plain(url):
                    fields["WARC-Target-URI"] = url
                if i is not None:
                    fields["Weft-Page-Id"] = f"<urn:page:{i}>"
                if revisit:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(ref, sha), "WARC-Refers-To-Date": DATE}
                    if _plain(there):
                        fields["WARC-Refers-To-Target-URI"] = there
                    f.write(record("revisit", fields, _HTTP))
                else:
                    body = html.as_buffer().to_pybytes() if html.is_valid else b""
                    f.write(record("response", {"WARC-Record-ID": record_id(i, sha), **fields}, _HTTP + body))
                n += 1
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([finish()]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def _plain(url: str | None) -> bool:
    return bool(url) and not any(c in url for c in "\r\n")


def plan_revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, refers_to, there_url of the pages that revisit another, each once."""
    key = F.xxhash64("digest")
    big = rows.where(F.col("size") >= min_bytes)
    bits = bloom.bits_for(rows.count())
    maybe = bloom.split(big, key, bits, bloom.of_repeats(big, key, bits), one=True)[0]
    firsts = maybe.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("there_url"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.where("n > 1 and refers_to is not null").drop("n"))
    return maybe.join(firsts, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to", "there_url").distinct()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 100) -> DataFrame:
    """Writes an archive a task under ``folder``; returns the manifest (path, records), already written."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    light = cut(own.select("page_id", "url", "digest", F.length("html").cast("long").alias("size")))
    revisits = cut(plan_revisits(light, min_bytes))
    discard(light)
    key = F.xxhash64("page_id", "digest")
    same = lambda a, b: F.col(f"{a}.page_id").eqNullSafe(F.col(f"{b}.page_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    bits = bloom.bits_for(revisits.count())
    maybe, sure = bloom.split(own, key, bits, bloom.of_keys(revisits, key, bits))
    # revisits leave their html behind before they move
    met = maybe.drop("html").alias("p").join(revisits.alias("r"), same("p", "r"), "left").select("p.*", "r.refers_to", "r.there_url")
    met = cut(met)
    wrong = cut(met.where("refers_to is null").select("page_id", "digest").distinct())  # what the filter let through
    n = wrong.count()
    none = {"refers_to": F.lit(None).cast("long"), "there_url": F.lit(None).cast("string"), "revisit": F.lit(False)}
    ready = sure.withColumns(none).unionByName(met.where("refers_to is not null").withColumns({"html": F.lit(None).cast("binary"), "revisit": F.lit(True)}))
    if n:
        bits = bloom.bits_for(n)
        back = bloom.split(maybe, key, bits, bloom.of_keys(wrong, key, bits))[0]
        back = back.alias("p").join(wrong.alias("r"), same("p", "r"), "left_semi").withColumns(none)
        ready = ready.unionByName(back.select(*ready.columns))
    manifest = cut(ready.mapInArrow(_write(folder), "path string, records long"))
    discard(revisits, met, wrong)
    return manifest


def archive_round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns the records read back, revisits resolved."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(pages, folder, min_bytes)
    back = read_warc(manifest.repartition(max(2, spark.sparkContext.defaultParallelism), "path"), keep_payload=False)
    back = cut(back.where("record_type <> 'warcinfo'").drop("payload", "path"))
    delete(spark, folder)
    return resolve(back)
