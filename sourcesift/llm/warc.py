"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame with the seek table of the
seekable format ends each bundle, so any frame can be read alone and any Zstandard reader can read the
whole. The index maps a record to its bundle, frame and offset within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcesift.functions.lineage import shared_folder

# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()
INDEX = "page_id long, bundle string, frame int, offset long, length long, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record with its payload."""
    visit = refers_to is not None
    target = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or f"page:{page_id}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if visit else 'response'}", f"WARC-Record-ID: <{record_urn(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-ID: {page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if visit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    block = b"" if visit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if block else b""


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, plain) sizes of the frames."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3) -> DataFrame:
    """Write (page_id, url, html, refers_to) as bundles under ``folder``; return the stored index.

    A task writes its bundles under names of their own and the index, written by Spark, lists only those
    of the attempts that count, so lost executors and repeated tasks do no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        store, base = _store(folder)
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        out, plain, frames, size, rows, name = None, [], [], 0, [], ""

        def close_frame() -> None:
            nonlocal plain, size
            raw = b"".join(plain)
            packed = pack.compress(raw)
            out.write(packed)
            frames.append((len(packed), len(raw)))
            plain, size = [], 0

        def close_bundle() -> pd.DataFrame:
            nonlocal out, frames, rows
            if plain:
                close_frame()
            out.write(seek_table(frames))
            out.close()
            done, out, frames, rows = rows, None, [], []
            return pd.DataFrame(done, columns=["page_id", "bundle", "frame", "offset", "length", "record_type", "refers_to"]).astype({"refers_to": "Int64"})

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4()}.warc.zst"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                refers = None if pd.isna(refers_to) else int(refers_to)
                raw = record(int(page_id), url, (html or "").encode(), refers)
                rows.append((int(page_id), name, len(frames), size, len(raw), "response" if refers is None else "revisit", refers))
                plain.append(raw)
                size += len(raw)
                if size >= frame_bytes:
                    close_frame()
                    if sum(f[0] for f in frames) >= bundle_bytes:
                        yield close_bundle()
        if out is not None:
            yield close_bundle()

    index = pages.select("page_id", "url", "html", "refers_to").mapInPandas(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Read every indexed record back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null of a revisit).

    Frames are the unit of work: each is fetched alone by the bundle's seek table and decoded once.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "offset", "length")).alias("records"))
    # by number, as the index is too small for its size to say how much work it stands for
    frames = frames.repartition(max(1, -(-frames.count() // 16)), "bundle", "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tables: dict[str, list[int]] = {}
        for batch in batches:
            for bundle, frame, records in zip(batch["bundle"], batch["frame"], batch["records"], strict=True):
                store, path = _store(bundle)
                with store.open_input_file(path) as file:
                    if bundle not in tables:
                        end = file.size()
                        n = struct.unpack("<IBI", file.read_at(9, end - 9))[0]
                        sizes = read_seek_table(file.read_at(9 + 8 * n, end - 9 - 8 * n))
                        tables[bundle] = [0]
                        for packed, _ in sizes:
                            tables[bundle].append(tables[bundle][-1] + packed)
                    starts = tables[bundle]
                    raw = zstandard.ZstdDecompressor().decompress(file.read_at(starts[frame + 1] - starts[frame], starts[frame]))
                out = []
                for r in records:
                    headers, payload = parse(raw[r["offset"] : r["offset"] + r["length"]])
                    said, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if int(headers["X-Page-ID"]) != r["page_id"] or kind == "response" and digest(payload) != said:
                        raise ValueError(f"record {r['page_id']} of {bundle} is damaged")
                    refers = headers.get("X-Refers-To-Page-ID")
                    out.append((r["page_id"], int(headers["X-Payload-Length"]), said, kind, int(refers) if refers else None, payload.decode() if kind == "response" else None))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"refers_to": "Int64"})

    return frames.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` plus ``refers_to``: the smallest page_id of an equal payload, null where the row is that page.

    A null html is an empty payload. Payloads under ``least_bytes`` are never revisits. Rows that share the
    smallest page_id are all responses.
    """
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    rows = pages.select("page_id", "url", "html", key.alias("_key"))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    copies = pages.filter(long_enough).groupBy(key.alias("_key")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    refers = F.when(F.col("_first") < F.col("page_id"), F.col("_first"))
    return rows.join(copies, "_key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **sizes) -> DataFrame:
    """Write a record per page with a non-null page_id to bundles, read them back and return what they hold."""
    folder = folder or shared_folder(pages.sparkSession) + "/warc"
    pages = pages.filter("page_id IS NOT NULL")
    return read_bundles(write_bundles(mark_revisits(pages, least_bytes), folder, **sizes))
