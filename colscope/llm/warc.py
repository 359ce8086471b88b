"""WARC archives with deduplicated payloads, and capture histories merged from the archives' sorted indexes.

Records are written by Spark as text files whose line end is the blank lines after a record, so any store that Spark
reaches will do and a failed task leaves no half archive.  Reading an archive back gives one run of captures, sorted
by URL key and time; runs are dealt out by ranges of that key and merged, k at a time, by a tree of losers.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .common import named, on_workers, written

# The alphabet of base32, and the record separator and profile of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("urlkey string, date string, id string, type string, refers_to string, payload_bytes long, "
           "payload_digest string, archive string, offset long")


def base32(hexadecimal: Column) -> Column:
    """Base32 of a hexadecimal digest whose length is a multiple of five."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _date(id: Column) -> Column:
    """A capture time for tables without one: a second per id from the start of 2024."""
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce(F.try_to_number(id.cast("string"), F.lit("S999999999999999999")),
                                                       F.lit(0)).cast("long"), F.lit(300_000_000))
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def deduplicated(pages: DataFrame, id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """(name, sha, refers_to) of the distinct pairs of id, as text, and payload; refers_to is null for a response.

    Copies find their response by digest with rows of a few bytes, so a payload that a third of all pages share is no
    large group of texts.
    """
    text = F.coalesce(named(payload).cast("string"), F.lit(""))
    heads = pages.select(named(id).alias("id"), F.sha1(text).alias("sha"), F.octet_length(text).alias("bytes")).distinct()
    refs = heads.filter(F.col("bytes") >= least).groupBy("sha").agg(F.max("id").alias("ref"))
    own = heads.join(refs.hint("merge"), "sha", "left")
    return own.select(_name("id"), "sha", F.when(F.col("ref") != F.col("id"), F.col("ref"))
                      .when(F.col("id").isNull(), F.col("ref")).alias("refers_to"))


def _name(id: str) -> Column:
    return F.coalesce(named(id).cast("string"), F.lit("")).alias("name")


def records(pages: DataFrame, parts: int, id: str = "page_id", url: str = "url", payload: str = "html",
            least: int = 0) -> DataFrame:
    """(record) of every row, without the blank lines that end it; a revisit has the head of its response only.

    Payloads are shuffled once, into ``parts`` partitions by id and digest, which is where they meet their response.
    """
    text = F.coalesce(named(payload).cast("string"), F.lit(""))
    address = F.translate(named(url).cast("string"), "\r\n", "")
    full = pages.select(_name(id), named(id).alias("id"), address.alias("url"), text.alias("body"), F.sha1(text).alias("sha"))
    refs = deduplicated(pages, id, payload, least)
    joined = full.repartition(parts, "name", "sha").join(refs.hint("merge"), ["name", "sha"])
    size = F.octet_length("body").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size,
                    F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, "body"))
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("name"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), _date(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(revisit, F.lit("WARC-Profile: " + REVISIT)),
        F.concat(F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
                 F.octet_length(block).cast("string"), F.lit("\r\n\r\n")),
    ]
    return joined.select(F.concat(F.concat_ws("\r\n", *lines), block).alias("record"))


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
                   least: int = 0, archive_bytes: int = 32 << 20) -> None:
    """Write a record per row into gzip archives of about ``archive_bytes`` before compression.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others
    revisit them; smaller payloads are all responses.  A null payload is empty, a null URL is left out, a null id has
    the smallest rank.  Rows repeated as a whole are alike, and an empty table gives an archive without records.
    """
    total = pages.agg(F.sum(F.octet_length(named(payload).cast("string")) + F.lit(600))).first()[0] or 0
    # No fewer than the session's shuffles have, or the join would deal the payloads out again.
    parts = max(math.ceil(total / archive_bytes), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    records(pages, parts, id, url, payload, least).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


def url_key(url: str) -> str:
    """Host labels in reverse, then the rest of the URL: captures of one site sort together."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        block = data[stop + 4:stop + 4 + int(fields["Content-Length"])]
        yield at, fields, block
        at = stop + 4 + len(block) + len(RECORD_END)


def _capture(archive: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    head, _, body = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        size = len(body)
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"{archive}: payload at {offset} does not have its digest")
    else:
        size = int(head.rpartition(b"Content-Length: ")[2])

    def page(field: str) -> str | None:
        return fields[field][len("<urn:page:"):-1] or None if field in fields else None

    return (url_key(fields.get("WARC-Target-URI", "")), fields["WARC-Date"], page("WARC-Record-ID"), fields["WARC-Type"],
            page("WARC-Refers-To"), size, digest, archive, offset)


def _arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("payload_bytes", "offset") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def _order(row: tuple) -> tuple:
    """URL key, time, then id (null first), archive and offset."""
    return row[0], row[1], row[2] is not None, row[2] or "", row[7], row[8]


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures in the archives, each archive's in order: one sorted run per archive."""
    names = [f.name for f in T._parse_datatype_string(CAPTURE).fields]

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = zlib.decompress(content.as_py(), 31)
                run = sorted((_capture(path.rpartition("/")[2], *r) for r in parse(data)), key=_order)
                for i in range(0, len(run), 10_000):
                    yield _arrow(run[i:i + 10_000], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return on_workers(files.filter(F.col("length") > 0).select("path", "content")).mapInArrow(read, CAPTURE)


def merge_runs(runs: list[Iterator], key) -> Iterator:
    """One sorted stream of many, by a tree of losers.

    Inner nodes hold the run that lost there and node 0 the winner; after the winner's next item arrives, only the
    nodes on its way to the root are played again.
    """
    k = len(runs)
    if not k:
        return
    last = (1,)
    items: list = [next(r, None) for r in runs]
    keys = [last if x is None else (0, key(x), i) for i, x in enumerate(items)]
    losers = [-1] * k

    def play(run: int) -> None:
        node = (run + k) // 2
        while node > 0:
            other = losers[node]
            if other < 0:  # the first to come waits for its opponent
                losers[node] = run
                return
            if keys[other] < keys[run]:
                losers[node], run = run, other
            node //= 2
        losers[0] = run

    for run in range(k):
        play(run)
    while True:
        winner = losers[0]
        if items[winner] is None:
            return
        yield items[winner]
        items[winner] = next(runs[winner], None)
        keys[winner] = last if items[winner] is None else (0, key(items[winner]), winner)
        play(winner)


def capture_histories(runs: DataFrame, per_range: int = 50_000) -> DataFrame:
    """All captures in global order of URL key, time, id, archive and offset, partition after partition.

    Runs are dealt out by ranges of the whole key, so captures of one hot URL spread too, and a task merges its parts
    of all runs: about ``per_range`` captures.
    """
    names = runs.columns
    ranges = max(1, math.ceil(runs.count() / per_range))

    def merge(batches):
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                parts.setdefault(row[7], []).append(row)
        for part in parts.values():
            part.sort(key=_order)  # costs one pass where the run's order has been kept on the way
        out = []
        for row in merge_runs([iter(p) for p in parts.values()], _order):
            out.append(row)
            if len(out) == 10_000:
                yield _arrow(out, names)
                out = []
        if out:
            yield _arrow(out, names)

    dealt = runs.repartitionByRange(ranges, "urlkey", "date", F.asc_nulls_first("id"), "archive", "offset")
    return on_workers(dealt).mapInArrow(merge, CAPTURE)


def archived_pages(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return the capture histories read back from them.

    Archives are read once: their runs are kept as a table, which is counted, cut into ranges and merged.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, id, url, payload, least)
    return capture_histories(written(capture_runs(spark, folder), "capture-runs"))
