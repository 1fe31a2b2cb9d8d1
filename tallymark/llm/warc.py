"""WARC: archives written as text files, and read back by verified chains of record boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import remove
from .common import cut, shared_folder

# What the format calls its parts.
LINE, END, MAGIC = "\r\n", "\r\n\r\n", "WARC/1."
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Files are cut where a line starts with the magic. The bytes do not overlap
#: themselves, so no reader can miss one, and no header line can start so.
CUT = "\n" + MAGIC
#: Payloads with copies up to which their keys (about 80 bytes each) are broadcast; beyond, rows are shuffled.
BROADCAST_KEYS = 200_000
#: Names of records: an id, percent-encoded, in a URN.
URN = "urn:x-page:"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them are four letters."""
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per page into archives in ``folder``, one per task.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
    smallest id is a ``response`` with the payload; the others are ``revisit``
    records that name it and keep only its HTTP header. Payloads are compared by
    SHA-1, another hash and length, counted per task before the shuffle; only keys
    of payloads with copies meet the pages again, so payloads stay where they
    are read unless there are more than ``BROADCAST_KEYS`` of those.

    A null payload is empty. A null id is never the smallest: it revisits a page
    with an id, and pages that only null ids hold are all responses. Rows that
    repeat the smallest id and payload are all responses. A null URL is left
    out; line breaks in one are percent-encoded. An empty table gives no records.
    """
    key = F.col(f"`{id_col}`")
    body = F.coalesce(F.col(f"`{body_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        key.alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"),
        F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("size"), F.xxhash64(body).alias("other"),
    )
    same = ["sha", "size", "other"]
    held = rows.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    copied = cut(held.where("n > 1 and first is not null").select(*same, "first"))
    small = copied.count() <= BROADCAST_KEYS
    rows = rows.join(F.broadcast(copied) if small else copied, same, "left")

    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def urn(of: Column) -> Column:
        return F.concat(F.lit(f"<{URN}"), F.coalesce(F.url_encode(of.cast("string")), F.lit("")), F.lit(">"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=UTF-8{LINE}Content-Length: "),
        F.col("size").cast("string"), F.lit(END),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"{VERSION}{LINE}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        _line("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(LINE),
    )
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("body"))
    record = F.concat(header.cast("binary"), http.cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)


def _field(header: Column, name: str) -> Column:
    """Value of a header line; null if there is none."""
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.nullif(found, F.lit(""))


def _described(block: Column) -> list[Column]:
    """Payload of a record's ``block`` (raw bytes as a string), and the length its HTTP header gives."""
    http = F.lower(F.coalesce("content_type", F.lit(""))).startswith("application/http")
    head = F.substring_index(block, END, 1)
    split = http & (F.octet_length(head) < F.octet_length(block))
    raw = block.cast("binary")
    payload = F.when(split, F.substring(raw, F.octet_length(head) + 5, F.octet_length(raw))).otherwise(raw)
    return [payload.alias("payload"), F.when(split, _field(head, "Content-Length")).try_cast("long").alias("said")]


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The archives cut at each line that starts with the magic; one row per piece, as read.

    ``value`` holds the raw bytes; ``block`` is where the task's part of the
    file starts, and ``pos`` rises with the place in it.
    """
    lines = spark.read.schema("value string").option("lineSep", CUT).text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


#: Two hashes and the length of a piece find its contents again in another scan.
SAME = ["hash1", "hash2", "n"]


def _identity(value: Column) -> list[Column]:
    """The columns ``SAME`` of a piece."""
    return [
        F.xxhash64(value).alias("hash1"), F.xxhash64(F.lit(1), value).alias("hash2"),
        F.octet_length(value).cast("long").alias("n"),
    ]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its offset, and for those that may be records where the next one would start.

    Tasks parse headers and digest payloads where they read them; only these
    figures are shuffled. A piece's offset is the sum of lengths before it: in
    its part of the file, and of the parts before that.
    """
    at = F.octet_length("head")
    pieces = (
        _pieces(spark, folder)
        .withColumn("leads", F.col("value").startswith(MAGIC))
        .withColumn("head", F.substring_index("value", END, 1))
        .select(
            "file", "block", "pos", "leads", "value", "head", *_identity(F.col("value")),
            F.col("head").rlike(r"^(WARC/1\.)?[0-9]+\r\n").alias("version"),
            _field(F.col("head"), "Content-Length").try_cast("long").alias("length"),
            *[_field(F.col("head"), name).alias(column) for name, column in FIELDS.items()],
            at.cast("long").alias("at"),
        )
    )
    fits = F.col("version") & F.col("length").isNotNull() & (F.col("at") < F.col("n"))
    whole = fits & (F.col("at") + 4 + F.col("length") <= F.col("n"))
    block = F.when(whole, F.substring(F.col("value").cast("binary"), (F.col("at") + 5).cast("int"), F.col("length").cast("int")))
    pieces = pieces.withColumn("fits", fits).withColumn("whole", whole).withColumn("block_bytes", block.cast("string"))
    slim = pieces.select(
        "file", "block", "pos", "leads", "n", "hash1", "hash2", "at", "fits", "whole", "length", *FIELDS.values(),
        *_described(F.col("block_bytes")),
    )
    slim = slim.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    slim = cut(slim.withColumn("payload_digest", base32(F.sha1("payload"))).drop("payload"))

    size = F.col("n") + len(CUT)
    parts = slim.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    # A file has as many rows here as tasks that read it.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = placed.join(parts, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside"))
    first = F.col("offset") == 0
    start = F.when(first, 0).otherwise(F.col("offset") - len(MAGIC))
    valid = F.col("fits") & (first == F.col("leads"))
    following = F.when(valid, F.col("offset") + F.col("at") + 4 + F.col("length") + 4)
    return placed.withColumn("start", start).withColumn("next", following).drop("base", "inside", "leads", "fits")


# Names of header fields, and what their columns are called.
FIELDS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
    "WARC-Date": "date", "WARC-Target-URI": "uri", "WARC-Payload-Digest": "declared", "Content-Type": "content_type",
}


def reachable(chain: DataFrame) -> DataFrame:
    """Rows (``file``, ``start``, ``next``) that a walk from each file's start meets, by pointer jumping.

    Each round doubles how far a candidate's pointer reaches and marks what the
    marked ones point to, so a file of n records needs log2(n) rounds of two joins
    on place, whatever its size. Starts rise along a chain, so no place is
    reached twice. Only a count per round reaches the driver.

    A round is kept as Parquet, so the next one starts from the size of its files.
    A checkpoint keeps the size Spark guessed of the plan it was made by, here the
    product of three tables, so its digits would grow threefold a round: a chain of
    300 links gave a number of 1.1 million digits, a copy in each plan on the driver.
    """
    spark = chain.sparkSession
    folder = f"{shared_folder(spark)}/reached-{uuid.uuid4().hex}"
    state = chain.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("reached"))
    state, known, rounds = cut(state, f"{folder}/0"), 0, 0
    while True:
        found = state.where("reached").count()
        if found == known:
            break
        known = found
        met = state.where("reached and jump is not null").select("file", F.col("jump").alias("start"), F.lit(True).alias("met"))
        ahead = state.select("file", F.col("start").alias("jump"), F.col("jump").alias("further"))
        state = state.join(met, ["file", "start"], "left").join(ahead, ["file", "jump"], "left")
        state = state.select("file", "start", F.col("further").alias("jump"), (F.col("reached") | F.col("met").isNotNull()).alias("reached"))
        state, rounds = cut(state, f"{folder}/{rounds + 1}"), rounds + 1
        remove(spark, f"{folder}/{rounds - 1}")
    kept = cut(state.where("reached").select("file", "start"))
    remove(spark, folder)
    return kept


def _contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The contents of pieces known by ``SAME``, each once."""
    scan = _pieces(spark, folder).select("value", *_identity(F.col("value")))
    return scan.join(wanted, SAME, "left_semi").groupBy(*SAME).agg(F.first("value").alias("value"))


def _spanning(spark: SparkSession, folder: str, pieces: DataFrame, records: DataFrame) -> DataFrame:
    """Text of records whose payload holds the magic: their pieces put together again.

    A piece belongs to the last record that starts before it: the last in its
    part of the file, or else the last of the parts before.
    """
    marked = pieces.select("file", "block", "start", "offset", *SAME).join(
        records.select("file", "start", F.struct("start", "next", "whole").alias("record")), ["file", "start"], "left"
    )
    sofar = Window.partitionBy("file", "block").orderBy("offset")
    marked = cut(marked.withColumn("owner", F.last("record", ignorenulls=True).over(sofar)))
    ends = marked.groupBy("file", "block").agg(F.max_by("owner", "offset").alias("end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    owned = marked.join(ends, ["file", "block"]).withColumn("owner", F.coalesce("owner", "before"))
    owned = owned.where("not owner.whole and start < owner.next")
    owned = cut(owned.select("file", F.col("owner.start").alias("start"), "offset", *SAME))
    met = owned.join(_contents(spark, folder, owned.select(*SAME).distinct()), SAME)
    parts = met.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    return parts.select("file", "start", F.array_join("parts.value", CUT).alias("text"))


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of all archives in ``folder``, by verified chains of boundaries.

    Tasks cut their parts of the files at every line that starts with the magic
    and give for each candidate where its successor would start. Only those that
    a chain from the file's start meets are records, so a magic inside a
    payload makes none; a payload that holds one is put together again.

    Returns per record ``file``, ``start``, ``record_type``, ``record_id``,
    ``refers_to``, ``date``, ``uri``, ``declared`` (payload digest of the header),
    ``content_type``, ``length`` (of the block), ``payload_digest`` (bare base32
    SHA-1 of the payload as read), ``payload_bytes``, ``said`` (the payload's length
    in its HTTP header), ``complete`` (whether the block is all there) and, if asked
    for, the ``payload``. Without it, payloads never leave the task that reads them.

    A chain ends at the end of its file, or at a place where no record starts: a
    record cut off there is not complete and has no payload figures, and what
    follows a broken place is not read. Archives may be compressed as a whole.
    Fields a header lacks are null. An empty folder gives an empty result.
    """
    pieces = candidates(spark, folder)
    kept = reachable(pieces.where("next is not null").select("file", "start", "next"))
    records = pieces.join(kept, ["file", "start"], "left_semi")
    columns = ["file", "start", *FIELDS.values(), "length", "payload_digest", "payload_bytes", "said", "complete"]
    columns += ["payload"] * payloads
    plain = records.where("whole").withColumn("complete", F.lit(True))
    if payloads:
        plain = plain.join(_contents(spark, folder, plain.select(*SAME).distinct()), SAME)
        block = F.substring(F.col("value").cast("binary"), (F.col("at") + 5).cast("int"), F.col("length").cast("int"))
        plain = plain.withColumn("payload", _described(block.cast("string"))[0])
    plain = plain.select(*columns)
    broken = cut(records.where("not whole").select("file", "start", "next", *FIELDS.values(), "length", "at"))
    if broken.isEmpty():
        return plain
    met = broken.join(_spanning(spark, folder, pieces, records.select("file", "start", "next", "whole")), ["file", "start"])
    raw = F.col("text").cast("binary")
    complete = F.octet_length(raw) >= F.col("at") + 4 + F.col("length")
    block = F.when(complete, F.substring(raw, (F.col("at") + 5).cast("int"), F.col("length").cast("int"))).cast("string")
    met = met.withColumn("complete", complete).select("*", *_described(block))
    met = met.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    return plain.unionByName(met.withColumn("payload_digest", base32(F.sha1("payload"))).select(*columns))


def record_key(record: Column) -> Column:
    """The id in the name of a record that ``write_warc`` has written, as text; null if there is none."""
    return F.url_decode(F.nullif(F.regexp_extract(record, f"^<{URN}(.*)>$", 1), F.lit("")))
