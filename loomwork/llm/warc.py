"""WARC archives: write records with revisits, index them first, then read selected records by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_store, slices, spread, work_dir

#: Payloads below this size are never replaced by a revisit.
LEAST_REVISIT = 1000
#: Ranges of one archive are read together if the gap between them is at most this, and up to this many bytes at a time.
GAP, READ_BYTES = 64 << 10, 8 << 20

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX = f"{RECORD}, archive string, at long, length long"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """What to write per row: ``(page_id, url, payload, payload_digest, record_type, refers_to)``.

    Rows with equal payloads of at least 1000 bytes: the one with the largest page_id is the response, the others revisit
    it. Shorter ones are responses. A null payload is empty. Rows without a page_id are responses and nothing refers to
    them; rows that repeat the largest page_id of their payload are responses, each of them. Payloads are compared by
    SHA-1 and length. Only digests that occur twice are joined, by rows that carry no payload; where one payload is in a
    third of all rows, ``max`` is combined before the shuffle and the join splits the key.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    slim = own.where(f"octet_length(payload) >= {LEAST_REVISIT} and page_id is not null").select("page_id", "payload_digest")
    shared = slim.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least")).where("last > least").select("payload_digest", "last")
    revisits = slim.join(shared, "payload_digest").where("page_id <> last").select("page_id", "payload_digest", F.col("last").alias("refers_to")).distinct()
    joined = own.join(revisits, ["page_id", "payload_digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), "refers_to")


def _header(**fields: object) -> bytes:
    """A WARC header block; line breaks in values become blanks."""
    lines = [f"{k.replace('_', '-')}: {' '.join(str(v).splitlines())}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def member(raw: bytes) -> bytes:
    """The bytes as a gzip member of their own, without a time stamp: a record can be read alone, and a task's second run writes the same."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, gzipped: header block, payload (a revisit has none), two line ends."""
    content = payload if kind == "response" else b""
    head = _header(
        WARC_Type=kind,
        WARC_Record_ID=None if page_id is None else f"<urn:page:{page_id}>",
        WARC_Target_URI=url,
        WARC_Payload_Digest=f"sha1:{digest}",
        WARC_Refers_To=None if refers_to is None else f"<urn:page:{refers_to}>",
        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        X_Payload_Length=len(payload),
        Content_Type="text/html; charset=utf-8",
        Content_Length=len(content),
    )
    return member(head + content + b"\r\n\r\n")


def parse(raw: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and content of one gzipped record."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def write(found: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` to archives in ``folder``, one per partition; returns the index, a row per record, itself written to the shared folder.

    An archive's name is its attempt's own and stands in the index, so a task can run again and no index row points into
    the archive of another attempt, whose records may lie in another order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        archive = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, place = None, 0
        for part in slices(batches):
            out = out or store.open_output_stream(f"{base}/{archive}", compression=None)  # by its name the library would compress it
            rows = part.to_pydict()
            at, length, sizes = [], [], []
            for page_id, url, text, digest, kind, refers_to in zip(*(rows[c] for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                payload = text.encode("utf-8", "surrogatepass")
                raw = record(page_id, url, payload, digest, kind, refers_to)
                out.write(raw)
                at.append(place)
                length.append(len(raw))
                sizes.append(len(payload))
                place += len(raw)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in ("page_id", "url")), pa.array(sizes, pa.int64()), *(part.column(part.schema.get_field_index(c)) for c in ("payload_digest", "record_type", "refers_to")), pa.array([archive] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "at", "length"],
            )
        if out:
            out.close()

    return materialize(found.mapInArrow(run, INDEX), "warc-index")


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted ``(at, length)`` -> ``(first, at, length)`` of the reads that cover them; ``first`` is the index of a read's first range."""
    reads: list[list[int]] = []
    for i, (at, length) in enumerate(ranges):
        if reads and at - (reads[-1][1] + reads[-1][2]) <= gap and at + length - reads[-1][1] <= most:
            reads[-1][2] = max(reads[-1][2], at + length - reads[-1][1])
        else:
            reads.append([i, at, length])
    return [tuple(r) for r in reads]


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that ``index`` rows select, parsed from the archives: the columns of RECORD, and the content if ``payload``.

    Rows are dealt by archive and stretch of it, sorted by place, and read in coalesced ranges. Sizes and digests of
    responses are taken from their content; a revisit has them in its header.
    """
    stretch = F.floor(F.col("at") / (64 << 20)).alias("stretch")
    chosen = index.select("archive", "at", "length", stretch).repartition(spread(index.sparkSession), "archive", "stretch").sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for part in slices(batches, 1024):
            rows, out = part.to_pydict(), []
            archives, spans = rows["archive"], list(zip(rows["at"], rows["length"], strict=True))
            bounds = [0, *(i for i in range(1, len(archives)) if archives[i] != archives[i - 1]), len(archives)]
            for low, high in zip(bounds, bounds[1:]):
                with store.open_input_file(f"{base}/{archives[low]}") as f:
                    reads = coalesce(spans[low:high])
                    for (first, at, length), end in zip(reads, [*(r[0] for r in reads[1:]), high - low], strict=True):
                        raw = memoryview(f.read_at(length, at))
                        for place, size in spans[low + first : low + end]:
                            head, content = parse(raw[place - at : place - at + size])
                            kind = head["warc-type"]
                            digest = hashlib.sha1(content).hexdigest() if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
                            n = len(content) if kind == "response" else int(head["x-payload-length"])
                            out.append((_page(head.get("warc-record-id")), head.get("warc-target-uri"), n, digest, kind, _page(head.get("warc-refers-to")), content if payload else None))
                if payload and out:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    names = RECORD + (", content binary" if payload else "")

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payload]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types)], [x.split(" ")[0] for x in names.split(", ")])

    return chosen.mapInArrow(run, names)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder, then read every record back through the index."""
    folder = work_dir(pages.sparkSession, "warc")
    return read(write(records(pages, id_col, url_col, payload_col), folder), folder)
