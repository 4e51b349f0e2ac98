"""WARC archives and their Merkle fixity audit.

Records: ``warc_records`` renders rows as WARC/1.1 resource records, ``write_warc`` writes them in
order as gzipped volumes through Spark's text sink, ``read_warc`` parses volumes back into records
with their place, length and hash.

Audit: the ordered records of a replica, with their offsets, are the leaves of a tree; each parent
hashes an ordered range of ``FANOUT`` children (one group-by per level, groups of at most
``FANOUT`` rows), up to one root.  ``audit`` compares the roots of two replicas and joins only the
children of nodes that differ, level by level, down to the records that differ.

Cases: nulls in url or html are empty strings, a null id sorts first; repeated rows are records of
their own, ordered by id, url and hash; empty pages are records with an empty block; empty tables
are archives without records (root null); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.llm.common import number_rows, places, running_total, shared_path, shuffle_partitions, stage

FANOUT = 16
VOLUME_RECORDS = 2048
WARC_DATE = "1970-01-01T00:00:00Z"  # the tables hold no crawl time
CRLF = "\r\n"


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows (record_id, url, record): the record's text, ready to be written or hashed."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(body_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # a line break in a URL would end its header line
    safe_url = F.regexp_replace(url, r"[\r\n]", " ")
    record = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: resource" + CRLF + "WARC-Record-ID: <urn:page:"), ident,
        F.lit(">" + CRLF + "WARC-Date: " + WARC_DATE + CRLF + "WARC-Target-URI: "), safe_url,
        F.lit(CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF), body, F.lit(CRLF + CRLF),
    )
    return pages.select(F.col(id_col).alias("record_id"), url.alias("url"), record.alias("record"))


def _hashed(records: DataFrame) -> DataFrame:
    data = F.col("record").cast("binary")
    name = F.concat(F.coalesce(F.col("record_id").cast("string"), F.lit("null")), F.lit(" "), F.ltrim(F.regexp_replace("url", r"[\r\n]", " ")))
    return records.select("record_id", "url", name.alias("name"), F.octet_length("record").cast("long").alias("length"), F.sha2(data, 256).alias("sha256"))


ORDER = ["record_id", "url", "sha256"]


def write_warc(records: DataFrame, path: str, volume_records: int = VOLUME_RECORDS) -> None:
    """Write records in order of id, url and hash as gzipped WARC volumes below ``path``; each task
    writes the volumes of one range, at most ``volume_records`` records each."""
    keyed = records.withColumn("sha256", F.sha2(F.col("record").cast("binary"), 256))
    ranged = keyed.repartitionByRange(shuffle_partitions(records.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    # the sink ends each value with its line separator, which is the record's last line break
    value = F.expr(f"left(record, char_length(record) - {len(CRLF)})")
    ranged.select(value.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", volume_records).text(path)


_START = re.compile(rb"WARC/1\.[01]\r\n")


def parse_volume(data: bytes):
    """(offset, record bytes) of each record of an uncompressed volume.  Where a record does not
    end as its header says, it ends at the next version line, or with the volume."""
    at, end = 0, len(data)
    while at < end:
        head = data.find(b"\r\n\r\n", at)
        stop = -1
        if head >= 0:
            m = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r$", data[at : head + 2])
            if m:
                stop = head + 4 + int(m[1]) + 4
        if stop < 0 or stop > end or data[stop - 4 : stop] != b"\r\n\r\n" or (stop < end and not _START.match(data, stop)):
            nxt = _START.search(data, at + 1)
            stop = nxt.start() if nxt else end
        yield at, data[at:stop]
        at = stop


def _inflate(data: bytes) -> bytes:
    """All gzip members of ``data``; what a damaged end still yields is kept."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


def read_warc(spark: SparkSession, path: str, with_record: bool = False) -> DataFrame:
    """One row per record: file, part and volume (from the file's name), seq, offset (in the
    volume), length, sha256, target_uri, name (its id and URL, empty where its header is lost) and, on
    request, the record's bytes."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = re.search(r"part-(\d+)-.*-c(\d+)\.", name)
                part, volume = (int(m[1]), int(m[2])) if m else (0, 0)
                rows = []
                for seq, (offset, rec) in enumerate(parse_volume(_inflate(content.as_py()))):
                    head = rec[: rec.find(b"\r\n\r\n") + 2]
                    uri, ident = re.search(rb"(?im)^WARC-Target-URI:[ \t]*(.*?)\r$", head), re.search(rb"(?im)^WARC-Record-ID:[ \t]*<urn:page:(.*?)>\r$", head)
                    target = uri[1].decode("utf-8", "replace") if uri else None
                    called = f"{ident[1].decode('utf-8', 'replace')} {target}" if ident and uri else ""
                    rows.append((name, part, volume, seq, offset, len(rec), hashlib.sha256(rec).hexdigest(), target, called, rec if with_record else None))
                for s in range(0, len(rows), 1000):
                    cols = list(zip(*rows[s : s + 1000]))
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "part", "volume", "seq", "offset", "length", "sha256", "target_uri", "name", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, part int, volume int, seq int, offset long, length long, sha256 string, target_uri string, name string, record binary")


def leaves(records: DataFrame, order: list[str | Column], label: str) -> DataFrame:
    """``records`` (with length and sha256) with idx, offset in the ordered archive, and hash, the
    leaf over both and the record's hash."""
    numbered = number_rows(records, order, f"{label}-order").withColumn("_all", F.lit(0))
    laid = running_total(numbered, "_all", ["idx"], "length", f"{label}-offsets", "_end").withColumn("offset", F.col("_end") - F.col("length"))
    return stage(laid.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "sha256"), 256)).drop("_all", "_end"), f"{label}-leaves")


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def merkle_levels(leaf: DataFrame, levels: int, label: str, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (idx, hash) from the leaves to the root."""
    out = [leaf.select("idx", "hash")]
    for n in range(levels):
        children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda c: c["hash"])  # at most ``fanout``
        up = out[-1].groupBy(F.expr(f"idx div {fanout}").alias("up")).agg(F.sha2(F.concat_ws("", children), 256).alias("hash"))
        out.append(stage(up.select(F.col("up").alias("idx"), "hash"), f"{label}-level{n + 1}"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """idx of the leaves that differ, found from the roots downwards along differing nodes only."""
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:
            under = F.expr(f"idx div {fanout}")
            x, y = (t.withColumn("up", under).join(suspects, "up", "left_semi").drop("up") for t in (x, y))
        pair = x.withColumnRenamed("hash", "hash_a").join(y.withColumnRenamed("hash", "hash_b"), "idx", "full_outer")
        suspects = stage(pair.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(F.col("idx").alias("up")), "differing")
        if suspects.isEmpty():
            break
    return suspects.select(F.col("up").alias("idx"))


def matched(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """(idx, idx_b): records of two replicas with equal ``key``, the first with the first, the second with
    the second and so on.  Copies are numbered over range partitions, so a key may have any number."""
    first, second = (places(t.select("idx", key), key, ["idx"], "_occ", f"{label}-{n}") for n, t in (("a", a), ("b", b)))
    return stage(first.join(second.withColumnRenamed("idx", "idx_b"), [key, "_occ"]).select("idx", "idx_b"), f"{label}-pairs")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, str | None, str | None]:
    """Audit replica ``b`` against ``a``, both from ``leaves``.  Returns every record of ``a`` and the
    extra ones of ``b`` with ``status`` and ``replica_sha256``, and the two roots.

    Differing leaves are matched by what the records are: those with the same bytes at another place are
    moved; of the rest, those with the same id and URL are changed; of the rest, those at the same
    place (a lost header) are changed; what is left is missing or extra."""
    levels = height(max(a.count(), b.count(), 1), fanout)
    ta, tb = merkle_levels(a, levels, "a", fanout), merkle_levels(b, levels, "b", fanout)
    bad = differing(ta, tb, fanout)
    (ra, rb) = ((t[-1].first() or {"hash": None})["hash"] for t in (ta, tb))  # one row each
    columns = ["record_id", "url", "idx", "offset", "length", "sha256", "status", "replica_sha256"]
    fine = a.join(bad, "idx", "left_anti").select("record_id", "url", "idx", "offset", "length", "sha256", F.lit("intact").alias("status"), F.col("sha256").alias("replica_sha256"))
    if ra == rb:
        return fine, ra, rb
    rest_a, rest_b = (stage(t.join(bad, "idx", "left_semi"), "differing-records") for t in (a, b))
    out = fine
    replica = rest_b.select(F.col("idx").alias("idx_b"), F.col("sha256").alias("replica_sha256"))
    for key, status in (("sha256", "moved"), ("name", "changed"), ("idx", "changed")):
        pairs = rest_a.select("idx", F.col("idx").alias("idx_b")).join(rest_b.select(F.col("idx").alias("idx_b")), "idx_b", "left_semi") if key == "idx" else matched(rest_a.filter(F.col(key) != ""), rest_b.filter(F.col(key) != ""), key, status)
        out = out.unionByName(rest_a.join(pairs, "idx").join(replica, "idx_b").withColumn("status", F.lit(status)).select(*columns))
        rest_a, rest_b = (stage(t.join(pairs.select(F.col(c).alias("idx")), "idx", "left_anti"), "differing-records") for t, c in ((rest_a, "idx"), (rest_b, "idx_b")))
    missing = rest_a.withColumn("status", F.lit("missing")).withColumn("replica_sha256", F.lit(None).cast("string")).select(*columns)
    kinds = {f.name: f.dataType for f in a.schema.fields}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    extra = rest_b.select(none("record_id"), none("url"), "idx", "offset", "length", none("sha256"), F.lit("extra").alias("status"), F.col("sha256").alias("replica_sha256"))
    return out.unionByName(missing).unionByName(extra), ra, rb


def audited_archive(pages: DataFrame, stored: DataFrame | None = None, volume_records: int = VOLUME_RECORDS) -> DataFrame:
    """Write ``stored`` (default: ``pages``) as WARC volumes to the shared folder, read them back and
    audit what the volumes hold against the records of ``pages``.  ``root`` and ``replica_root`` are
    columns of the result."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(warc_records(stored if stored is not None else pages), path, volume_records)
    back = read_warc(spark, path).select("part", "volume", "seq", "length", "sha256", "name")
    a = leaves(_hashed(warc_records(pages)), ORDER, "a")
    b = leaves(back, ["part", "volume", "seq"], "b")
    rows, ra, rb = audit(a, b)
    return rows.withColumn("root", F.lit(ra)).withColumn("replica_root", F.lit(rb))
