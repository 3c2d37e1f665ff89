"""WARC records, and revisits that stand for an earlier response."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written
from .urls import LOWER, UPPER

CRLF = "\r\n"
SPAN_SECONDS = 86_400  # captures of a url are sorted in spans of a day
VERSION = "WARC/1."  # begins a record; the digit that follows, 0 or 1, is part of its first line
HEADER_BYTES = 1 << 16  # a longer record header raises
FIRST_LINE = re.compile(r"[01]\r\n")
LENGTH = re.compile(r"^Content-Length:[ \t]*(\d+)", re.I | re.M)

#: Header fields of a 304 that don't replace those of the stored response: fields of the message itself and of the
#: connection, and those that describe a body that the 304 doesn't have. Fixed values.
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"  # query fields that don't name another page


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(file, header, block, whole)`` of uncompressed or gzip WARC files of the versions 1.0 and 1.1.

    Files are read in pieces between version marks, so that an uncompressed file is read by many tasks. Which marks begin
    a record is told by the Content-Length of the record before: a task walks over the headers and sizes of a file's
    pieces, not over its blocks, and pieces of a record that holds a mark itself are joined. ``whole`` is false where a
    file ends inside its last record. A file whose records don't add up to it raises.
    """
    lines = spark.read.option("lineSep", VERSION).text(path)
    pieces = lines.select(
        F.input_file_name().alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").cast("binary").alias("raw"),
    )
    pieces = written(pieces, "pieces")  # ids must be the same when the pieces are read again
    text = F.decode(F.substring("raw", 1, HEADER_BYTES), "ISO-8859-1")  # a character for each byte
    end = F.locate(CRLF * 2, text)
    heads = pieces.select("file", "split", "id", F.octet_length("raw").cast("long").alias("size"), F.when(end > 0, F.substring(text, F.lit(1), end + 3)).otherwise(text).alias("head"))
    shape = "file string, id long, first long, n long, head string, start long, length long"
    found = pieces.join(heads.groupBy("file").applyInArrow(_walk, shape), ["file", "id"])
    told = ("head", "start", "length")
    one = found.where("n = 1").select("file", "raw", *told)
    parts = F.sort_array(F.collect_list(F.struct("split", "id", F.hex("raw").alias("raw"))))
    many = found.where("n > 1").groupBy("file", "first").agg(parts.alias("parts"), *[F.max(c).alias(c) for c in told])
    raw = F.unhex(F.array_join(F.transform("parts", lambda x: x["raw"]), VERSION.encode().hex()))
    some = one.unionByName(many.select("file", raw.alias("raw"), *told))
    block = F.substring(F.col("raw"), F.col("start").cast("int") + 1, F.coalesce(F.col("length").cast("int"), F.lit(0)))
    return some.select("file", header_map(F.col("head")).alias("header"), block.alias("block"), F.coalesce(F.octet_length(block) == F.col("length"), F.lit(False)).alias("whole"))


def _walk(table: pa.Table) -> pa.Table:
    """For each piece of a file the first piece of its record; for those the record's header and its block's place."""
    table = table.sort_by([("split", "ascending"), ("id", "ascending")])
    file, ids, sizes, heads = (table[c].to_pylist() for c in ("file", "id", "size", "head"))
    out: list[tuple] = []

    def wrong(why: str) -> ValueError:
        return ValueError(f"{file[0]}: {why} at byte {sum(sizes[:first]) + len(VERSION) * (first - 1)}")

    first, last = 1, len(ids)
    if sizes[0]:
        raise ValueError(f"{file[0]}: does not begin with {VERSION}")
    while first < last:
        k, head, size, length = first, heads[first], sizes[first], None
        if not FIRST_LINE.match(head) and first + 1 < last:
            raise wrong("no version line")
        while CRLF * 2 not in head and k + 1 < last:  # the header itself holds a mark
            if len(head) < size:
                raise wrong(f"header of more than {HEADER_BYTES} bytes")
            k += 1
            head, size = head + VERSION + heads[k], size + len(VERSION) + sizes[k]
        head, mark, _ = head.partition(CRLF * 2)
        start = len(head) + len(mark)
        if mark:
            if not (m := LENGTH.search(head)):
                raise wrong("no Content-Length")
            length = int(m[1])
            while size < start + length and k + 1 < last:
                k += 1
                size += len(VERSION) + sizes[k]
            rest = size - start - length
            if rest > len(CRLF * 2) or rest != len(CRLF * 2) and k + 1 < last:
                raise wrong(f"Content-Length {length} does not end at the next record")
        n = k + 1 - first
        out += [(file[0], ids[first + j], ids[first], n, *((head, start, length) if not j else (None,) * 3)) for j in range(n)]
        first = k + 1
    types = {"file": pa.string(), "id": pa.int64(), "first": pa.int64(), "n": pa.int64(), "head": pa.string(), "start": pa.int64(), "length": pa.int64()}
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(types.items())})


def header_map(block: Column) -> Column:
    """Header lines as a map with lowercase names; values of a repeated field are joined by a comma, as HTTP allows."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.locate(":", x) > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


def http_status(block: Column) -> Column:
    """The status of an HTTP message's first line; null if there is none."""
    return F.regexp_extract(F.coalesce(block, F.lit("")), r"^HTTP/\S+\s+(\d{3})", 1).try_cast("int")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and a default port, path without a last slash or default page, query fields
    sorted without those for tracking; no scheme and no fragment. A null is null."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?]*", 0), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/(index\.html?)?$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _validator(headers: Column, name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(headers, F.lit(name))), F.lit(""))


def _etag(headers: Column) -> Column:
    """The entity tag for a weak comparison, which is the one that 304 answers use."""
    return F.regexp_replace(_validator(headers, "etag"), r"^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, with those of the 304 in place of fields that it may replace."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_MERGED))
    rest = F.map_filter(stored, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(allowed), k), F.lit(False)))
    return F.map_concat(rest, allowed)


def _latest(rows: DataFrame) -> DataFrame:
    """Every revisit with its url's latest earlier full response.

    An as-of join by spans: each url's captures are dealt by span of time. The last response of the earlier spans comes
    from a window over a url's spans, the one inside the span from a window over the span. So no window holds all
    captures of a url that is captured very often. Payloads aren't part of this.
    """
    order = F.struct("date", "record_id", "row")
    full = F.when(F.col("full"), F.struct(F.col("date"), F.col("record_id"), F.col("row"), F.col("etag"), F.col("modified"), F.col("digest"), F.col("headers")))
    rows = rows.withColumns({"span": F.floor(F.unix_timestamp("date") / SPAN_SECONDS), "response": full})
    spans = rows.groupBy("url_key", "span").agg(F.max_by("response", F.when(F.col("full"), order)).alias("last"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("url_key", "span", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    # a revisit ranks after the responses of its very moment
    inside = Window.partitionBy("url_key", "span").orderBy("date", F.col("full").desc(), "record_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.last("response", ignorenulls=True).over(inside)).where("revisit")
    return rows.join(spans, ["url_key", "span"]).withColumn("found", F.coalesce("here", "earlier")).drop("here", "earlier", "response")


def resolve_revisits(records: DataFrame, payload: str = "payload") -> DataFrame:
    """What each not-modified revisit of ``records`` stands for.

    ``records``: ``record_id, warc_type, target_uri, date, http`` (status line and headers as text), ``payload_digest``
    and the payload. A full response is a ``response`` record with status 200; a revisit is a ``revisit`` record with
    status 304 or none. Each revisit is joined to the latest full response of the same canonical url that is not later;
    one of the same moment counts as earlier, and of several the greatest record id.

    Returns ``record_id, url_key, date, verdict, response_id, response_date, headers`` and the payload. Verdicts:
    ``resolved`` (a validator that both carry agrees: the entity tag, else the modification date, else the payload
    digest), ``mismatch`` (it differs), ``unverified`` (they share none), ``no_response`` (there is no earlier one).
    Only a resolved revisit gets a payload and headers: those of the response, with the 304's fields where HTTP lets a 304
    replace them. Payloads are shuffled once, by record, and only those that a resolved revisit names.

    A revisit with a null url or date has no response; a response with one answers none. Null headers are no headers, a
    response without payload keeps its null. Repeated revisits each get a row; records are told apart by row where ids
    repeat. An empty table gives an empty table. Other columns aren't used, whatever their names.
    """
    kind = F.lower(F.coalesce(F.col("warc_type"), F.lit("")))
    status = http_status(F.col("http"))
    headers = header_map(F.regexp_replace(F.coalesce("http", F.lit("")), r"^HTTP/[^\n]*\n", ""))
    full, revisit = (kind == "response") & F.coalesce(status == 200, F.lit(False)), (kind == "revisit") & F.coalesce(status == 304, F.lit(True))
    row = F.xxhash64("record_id", "target_uri", "date", "payload_digest", "http")
    marked = records.withColumns({"row": row, "full": full, "revisit": revisit})
    known = marked.where("full or revisit").select(
        "record_id",
        canonical_url(F.col("target_uri")).alias("url_key"),
        "date",
        headers.alias("headers"),
        F.col("payload_digest").alias("digest"),
        "full",
        "revisit",
        "row",
    )
    # read for the spans, for the windows and for the rest; payloads stay where they are
    known = written(known.withColumns({"etag": _etag(F.col("headers")), "modified": _validator(F.col("headers"), "last-modified")}), "records")
    dated = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    joined = _latest(known.where(dated))
    agree = F.coalesce(F.col("found.etag") == F.col("etag"), F.col("found.modified") == F.col("modified"), F.col("found.digest") == F.col("digest"))
    verdict = F.when(F.col("found").isNull(), "no_response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    judged = joined.withColumn("verdict", verdict)
    resolved = F.col("verdict") == "resolved"
    judged = judged.select(
        "record_id",
        "url_key",
        "date",
        "verdict",
        F.when(resolved, F.col("found.record_id")).alias("response_id"),
        F.when(resolved, F.col("found.row")).alias("response_row"),
        F.when(resolved, F.col("found.date")).alias("response_date"),
        F.when(resolved, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )
    answers = marked.where("full").select(F.col("record_id").alias("response_id"), F.col("row").alias("response_row"), F.col(payload).alias("payload"))
    if known.where("full").groupBy("record_id", "row").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        answers = answers.dropDuplicates(["response_id", "response_row"])
    kind_of_payload = records.schema[payload].dataType
    taken = judged.where("verdict = 'resolved'").join(answers, ["response_id", "response_row"], "left")
    rest = judged.where("verdict <> 'resolved'").withColumn("payload", F.lit(None).cast(kind_of_payload))
    undated = known.where(F.col("revisit") & ~dated).select(
        "record_id",
        "url_key",
        "date",
        F.lit("no_response").alias("verdict"),
        F.lit(None).cast(known.schema["record_id"].dataType).alias("response_id"),
        F.lit(None).cast("long").alias("response_row"),
        F.lit(None).cast(known.schema["date"].dataType).alias("response_date"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast(kind_of_payload).alias("payload"),
    )
    return taken.unionByName(rest).unionByName(undated).drop("response_row")
