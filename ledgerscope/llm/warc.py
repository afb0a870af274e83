"""WARC archives of pages, and their capture index by external merge with loser trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, shared_path, ship

#: An archive file holds at most so many records and, but for one that is larger alone, about so many
#: bytes: it is read back whole by one task.
FILE_RECORDS, FILE_BYTES = 500, 64 << 20
#: The profile of revisits that share a payload digest with the record they refer to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture time of page 0; later pages follow by the second, where the pages have no time of their own.
EPOCH = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"

RECORD = (
    "page_id long, url string, capture_time string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, record_offset long"
)
CAPTURE = f"url_key string, {RECORD}"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, port or ``www``, lower case."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages(page_id, url, html)`` with payload figures and record types.

    Of records with equal payloads of at least ``min_bytes``, those with the largest page_id are
    responses and the others revisit it; smaller payloads are all responses. The largest ids come
    from a count per digest, which Spark combines before its shuffle.
    """
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = sized.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
    copied = materialize(groups.where("copies > 1").select("digest", "newest"), "warc-copied")
    joined = sized.join(copied, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    original = F.coalesce(F.col("page_id") == F.col("newest"), F.lit(False)).alias("original")
    return joined.select("page_id", "url", "payload", "n", "digest", F.when(revisit, F.col("newest")).alias("refers_to"), original)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write a WARC/1.1 record for each page to files in folders under ``path``.

    Spark's text writer puts the record end between records, so archives go to any file system
    that Spark writes to. They are not compressed, so a record can be sought by its offset. Pages
    go to folders by size, in steps of eight, so that files stay near FILE_BYTES. A block is an HTTP
    response, of a revisit its headers alone. Header values keep no line breaks; those of null
    columns are left out. A record's id is a UUID from the page's id, digest and url if others may
    refer to it, else a random one; the page's id has a header of its own.
    """
    rows = records(pages, min_bytes)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH), "yyyy-MM-dd'T'HH:mm:ssX") + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 32))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = lambda page: F.regexp_replace(F.md5(F.concat_ws(":", page.cast("string"), F.col("digest"))), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    uri = lambda u: F.concat(F.lit("<urn:uuid:"), u, F.lit(">"))
    text = lambda: F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.when(F.col("original"), named(F.col("page_id"))).otherwise(F.uuid()))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, uri(named(F.col("refers_to"))))),
        line("Page-ID", F.col("page_id")),
        line("Page-Refers-To", F.col("refers_to")),
        line("Page-Length", F.col("n")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    size, low = FILE_BYTES // FILE_RECORDS, 0
    while True:
        some = rows.where((F.col("n") >= low) & (F.col("n") < size))
        many = max(1, FILE_BYTES // size)
        some.select(text().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", many).text(f"{path}/below-{size}")
        if largest < size:
            break
        size, low = 8 * size, size


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of one archive; damaged archives raise ValueError."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = content[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(headers["content-length"])
        block = content[end + 4 : end + 4 + n]
        if len(block) < n or content[end + 4 + n : end + 8 + n] != END.encode():
            raise ValueError(f"record at byte {at} is cut off")
        yield at, headers, block
        at = end + 8 + n


def _page(value: str | None) -> int | None:
    return int(value) if value else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records, in RECORD's columns; a response's length and digest are those of the payload read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                out = []
                for at, h, block in parse(file["content"]):
                    digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["page-length"])
                    payload = block.partition(b"\r\n\r\n")[2]
                    if h["warc-type"] == "response" and (n != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{file['path']}: payload of {h.get('warc-record-id')} is damaged")
                    name = "/".join(file["path"].rsplit("/", 2)[1:])
                    out.append((_page(h.get("page-id")), h.get("warc-target-uri"), h["warc-date"], n, digest, h["warc-type"], _page(h.get("page-refers-to")), name, at))
                yield _batch(out, RECORD)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a schema of longs and strings."""
    columns = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    values = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, columns)], [n for n, _ in columns])


class LoserTree:
    """K-way merge of sorted runs: each match's loser stays in its node, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[self.winner]) is not None:
            yield row
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.size) // 2
            while node:
                if self._first(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def _sort_key(row: tuple) -> tuple:
    """URL key, time, page; a null page comes first."""
    return row[0], row[3], row[1] is not None, row[1] or 0, row[8] or "", row[9]


def capture_index(found: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """The captures in one global order by (url_key, capture_time, page_id), in CAPTURE's columns.

    Each task sorts the captures it has read into a run and writes it with its run number. The key
    space is cut into ranges of about ``rows_per_range`` captures, bounds from a sample of the
    keys; each range's task gets its part of every run and merges those sorted parts with a loser
    tree. Captures alike in all keys keep the order of archive and offset.
    """
    marked = f"{CAPTURE}, place long, run string"

    def sort_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def run() -> pa.RecordBatch:
            rows.sort(key=_sort_key)
            name = f"{rows[0][8]}:{rows[0][9]}:{len(rows)}"
            out = _batch([(*r, k, name) for k, r in enumerate(rows)], marked)
            rows.clear()
            return out

        for batch in batches:
            rows.extend((url_key(r["url"]), *r.values()) for r in batch.to_pylist())
            if len(rows) >= rows_per_range:
                yield run()
        if rows:
            yield run()

    runs = materialize(found.mapInArrow(sort_run, marked), "warc-runs")
    ranges = max(1, -(-runs.count() // rows_per_range))
    # the rows of a run arrive together and in its order
    dealt = runs.repartitionByRange(ranges, "url_key", "capture_time", "page_id").sortWithinPartitions("run", "place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                *row, _, run = r.values()
                parts.setdefault(run, []).append((_sort_key(row), tuple(row)))
        out: list[tuple] = []
        for _, row in LoserTree([iter(p) for p in parts.values()]):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, CAPTURE)
                out.clear()
        yield _batch(out, CAPTURE)

    return dealt.mapInArrow(merge, CAPTURE)


def archive(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to WARC files in the shared folder, read them back and index them.

    ``archive`` and ``record_offset`` name the file below the archives' folder and the record's first
    byte in it. Result: CAPTURE's columns, globally ordered by URL key, capture time and page. A null html is
    an empty payload; a null url has an empty key; a null page_id has no record id and, among equal
    payloads, revisits the largest id unless all are null (then all are responses). Rows that repeat
    the largest page_id of a payload are all responses. An empty table gives no rows.
    """
    ship(pages.sparkSession)
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return capture_index(read_archives(spark, path))
