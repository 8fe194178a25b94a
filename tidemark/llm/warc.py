"""WARC archives written by Spark's text sink and read back by boundary-chain verification.

Writing: a record is one row of a text file whose line separator is the record end, so Spark commits
the files to shared storage itself. Equal payloads are stored once; the others revisit them.

Reading: archives are split by bytes like any text. Each task finds every place in its block that
looks like a record and emits candidate -> successor offsets; what looks like a record inside a
payload is a candidate too. Pointer jumping from each file's start over the candidates (a task has
already followed the chain to the end of its block) leaves the records that the file really has.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.session import checkpoint_root, staging_path

#: Payloads shorter than this are never replaced by a revisit.
LEAST_SHARED = 100
#: First bytes of each block that are kept to complete what the block before it began.
PREFIX = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_MAGIC = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"[!-9;-~]+:")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html; others unused) under ``path``.

    Payload: html in UTF-8 (null: empty). Of records with equal payloads of at least LEAST_SHARED bytes
    those of the smallest page_id are responses and the others revisit it; all shorter ones are
    responses. Rows that repeat the smallest page_id are all responses. A null page_id counts as the
    largest; its record id has no number. Line ends in a url are percent-encoded.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = stage(rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest")
                   .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
                   .select("digest", "first"), "warc-shared")
    # the written size of ``shared`` is known, so Spark sends it whole only below its broadcast limit
    rows = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    safe = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", name),
            ("WARC-Date", F.lit(date)), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            ("WARC-Profile", F.when(again, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.when(again, F.lit("0")).otherwise(F.octet_length("html").cast("string")))]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise(F.lit("")) for k, v in head]
    record = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.when(again, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(buf: bytes, at: int):
    """(fields, payload start, record end) of a candidate; None if it is none; () if the header goes on after buf."""
    stop = buf.find(b"\r\n\r\n", at)
    lines = buf[at:stop if stop >= 0 else len(buf)].split(b"\r\n")[1:]
    if stop < 0:
        whole = lines[:-1]  # the last one may be cut
        return () if all(_FIELD.match(x) or x[:1] in b" \t" for x in whole if x) else None
    if not all(_FIELD.match(x) or x[:1] in (b" ", b"\t") for x in lines):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in fields:
        return None
    return fields, stop + 4, stop + 8 + int(size)


_COLUMNS = [("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("next", pa.int64()),
            ("jump", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
            ("digest", pa.string()), ("refers_to", pa.string()), ("payload_at", pa.int64()), ("size", pa.int64()),
            ("sha256", pa.string()), ("body", pa.binary())]
_SCHEMA = pa.schema(_COLUMNS)
_SPARK = ("file string, block long, kind string, at long, next long, jump long, type string, record_id string, uri string, "
          "digest string, refers_to string, payload_at long, size long, sha256 string, body binary")


def _fields(fields: dict[bytes, bytes]) -> dict:
    text = {k: fields[k].decode("utf-8", "replace") for k in fields}
    return {"type": text[b"warc-type"], "record_id": text.get(b"warc-record-id"), "uri": text.get(b"warc-target-uri"),
            "digest": text.get(b"warc-payload-digest"), "refers_to": text.get(b"warc-refers-to")}


def _scan_block(file: str, block: int, buf: bytes, prefix: int, payloads: bool):
    """Rows of one block: itself with its first bytes, complete and cut candidates, each with where its chain leaves."""
    rows = [{"kind": "block", "at": 0, "size": len(buf), "body": buf[:prefix]}]
    found, carried = [], 0
    for m in _MAGIC.finditer(buf):
        at = m.start()
        head = _header(buf, at)
        if head is None:
            continue
        if not head:
            found.append({"kind": "cut", "at": at, "next": None, "body": buf[at:]})
            continue
        fields, begin, end = head
        row = {"kind": "record", "at": at, "next": end, "payload_at": begin, "size": end - 4 - begin, **_fields(fields)}
        if end <= len(buf):
            if buf[end - 4:end] != b"\r\n\r\n":
                continue
            row["sha256"] = hashlib.sha256(memoryview(buf)[begin:end - 4]).hexdigest()
            row["body"] = buf[begin:end - 4] if payloads else None
        elif carried + len(buf) - begin <= len(buf):
            carried += len(buf) - begin
            row["body"] = buf[begin:]  # the rest is in the blocks after this one
        found.append(row)
    leave: dict[int, int | None] = {}
    for row in reversed(found):
        end = row["next"]
        if end is None:  # its own node; the completed header says where it goes on
            leave[row["at"]] = row["at"]
        elif end >= len(buf):
            leave[row["at"]] = row["jump"] = end
        else:
            leave[row["at"]] = row["jump"] = leave.get(end)
    return [{"file": file, "block": block, **r} for r in rows + found]


def _scan(prefix: int, payloads: bool):
    def run(batches):
        now, held = None, []

        def flush():
            if now is not None:
                rows = _scan_block(*now, b"".join(held), prefix, payloads)
                for lo in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[lo:lo + 500], schema=_SCHEMA)

        for b in batches:
            files, blocks, lines = (b.column(i) for i in range(3))
            starts = blocks.to_numpy()
            names = files.to_pylist()
            lo = 0
            while lo < b.num_rows:
                hi = lo + 1
                while hi < b.num_rows and starts[hi] == starts[lo] and names[hi] == names[lo]:
                    hi += 1
                if now != (names[lo], int(starts[lo])):
                    yield from flush()
                    now, held = (names[lo], int(starts[lo])), []
                held.append(b"\n".join(lines.slice(lo, hi - lo).to_pylist()) + b"\n")
                lo = hi
        yield from flush()

    return run


def _complete_headers(batches):
    """Cut candidates with the bytes after their block: full rows of those that are records after all, and rows
    of kind ``open``, with the size of those bytes, of those whose header goes on after them."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            ahead = r["ahead"] or b""
            head = _header((r["body"] or b"") + ahead, 0)
            if head == ():
                rows.append({k: r[k] for k in ("file", "block", "at")} | {"kind": "open", "size": len(ahead)})
            elif head:
                fields, begin, end = head
                rows.append({k: r[k] for k in ("file", "block", "at")}
                            | {"kind": "record", "next": r["at"] + end, "jump": r["at"] + end, "payload_at": r["at"] + begin,
                               "size": end - 4 - begin, **_fields(fields)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("line")))


def reachable(nodes: DataFrame, rounds: int) -> DataFrame:
    """(file, at) reached from offset 0 of each file over nodes (file, at, jump), by pointer jumping.

    Round k adds what lies up to 2**k jumps ahead and squares the pointers.
    """
    checkpoint_root(nodes.sparkSession)
    jump = nodes.where("jump IS NOT NULL").select("file", "at", "jump")
    seen = nodes.where("at = 0").select("file", "at").distinct()
    for _ in range(rounds):
        ahead = seen.join(jump, ["file", "at"]).select("file", F.col("jump").alias("at"))
        seen = seen.unionByName(ahead).distinct().checkpoint()
        jump = (jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file AND a.jump = b.at"))
                .select("a.file", "a.at", "b.jump").checkpoint())
    return seen


def _walk(keys, rows):
    """Records of one block on the chain from the place where the true chain enters it."""
    import pandas as pd

    after = dict(zip(rows["at"], rows["next"], strict=True))
    keep = set()
    for at in rows.loc[rows["entry"], "at"]:
        while at in after and at not in keep:
            keep.add(at)
            at = after[at]
    return pd.DataFrame({"file": keys[0], "at": sorted(keep)}).astype({"at": "int64"})


def read_warc(spark: SparkSession, path: str, payloads: bool = True, prefix: int = PREFIX, reach: int = 4) -> DataFrame:
    """Records of all archives under ``path``: file, offset, type, record_id, uri, digest, refers_to (as in
    the header), size, sha256 (of the stored payload) and, if asked for, payload (binary).

    A record that its file cuts short is left out, as is all that no chain from the file's start
    reaches. A folder without records gives none.

    What a block end cuts is completed from the first ``prefix`` bytes of the ``reach`` blocks that follow.
    Where the header of a record goes on after these, all is read again with four times of both.
    """
    cut = [c for c, _ in _COLUMNS]
    rows = stage(_lines(spark, path).mapInArrow(_scan(prefix, payloads), _SPARK), "warc-candidates")
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = rows.where("kind = 'block'").select("file", "block", "size", "body")
    base = (blocks.withColumn("base", F.sum("size").over(in_file) - F.col("size"))
            .withColumn("ahead", F.array_join(F.transform(F.collect_list("body").over(in_file.rowsBetween(1, reach)), F.hex), ""))
            .select("file", "block", "base", "size", F.unhex(F.substring("ahead", 1, 2 * prefix)).alias("ahead")))
    base = stage(base, "warc-blocks")
    late = stage(rows.where("kind = 'cut'").join(base.select("file", "block", "ahead"), ["file", "block"])
                 .mapInArrow(_complete_headers, _SPARK), "warc-late")
    place = base.select("file", "block", "base", F.col("size").alias("block_size"))
    found = rows.where("kind = 'record'").unionByName(late.where("kind = 'record'")).select(*cut).join(place, ["file", "block"])
    found = stage(found.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "jump", "payload_at")}), "warc-found")
    # each block is left by at most two jumps: to its last, cut candidate and on
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    entered = reachable(found.select("file", "at", "jump"), math.ceil(math.log2(2 * most + 1))) if most else \
        found.select("file", "at").limit(0)
    total = base.groupBy("file").agg(F.sum("size").alias("total"))
    still = late.where("kind = 'open'")
    if not still.isEmpty():  # what looks like a header inside a payload is on no chain, one at the file's end is cut for good
        still = (still.join(place, ["file", "block"]).select("file", F.expr("at + base").alias("at"), F.expr("base + block_size + size").alias("seen"))
                 .join(entered, ["file", "at"]).join(total, "file").where("seen < total"))
        if not still.isEmpty():
            return read_warc(spark, path, payloads, 4 * prefix, 4 * reach)
    marked = (found.select("file", "block", "at", "next")
              .join(entered.withColumn("entry", F.lit(True)), ["file", "at"], "left").fillna(False, ["entry"]))
    true = marked.groupBy("file", "block").applyInPandas(_walk, "file string, at long")
    records = found.join(true, ["file", "at"])
    records = records.join(total, "file").where("next <= total")
    return _payloads(spark, path, records, base, payloads)


def _payloads(spark, path, records: DataFrame, base: DataFrame, payloads: bool) -> DataFrame:
    """Payloads and digests of records that go on after their block, from the bytes ahead or a second read."""
    out = ["file", F.col("at").alias("offset"), "type", "record_id", "uri", "digest", "refers_to", "size", "sha256"]
    out += [F.col("body").alias("payload")] if payloads else []
    records = stage(records, "warc-records")
    whole = records.where("sha256 IS NOT NULL")
    over = records.where("sha256 IS NULL").join(base.select("file", "block", "ahead"), ["file", "block"])
    held = F.greatest(F.lit(0), F.col("payload_at") - F.col("base") - F.col("block_size"))  # header ends in the bytes ahead
    body = F.when(F.col("body").isNull(), F.substring("ahead", (held + 1).cast("int"), F.col("size").cast("int"))).otherwise(
        F.substring(F.concat("body", "ahead"), F.lit(1), F.col("size").cast("int")))
    over = over.withColumn("body", F.when((F.col("payload_at") >= F.col("base") + F.col("block_size")) | F.col("body").isNotNull(), body))
    near = over.where("length(body) = size").withColumn("sha256", F.sha2("body", 256))
    far = over.where("body IS NULL OR length(body) <> size").select("file", "at", "payload_at", "size")
    # the rare long rest: the blocks that such a record lies on are read again
    need = (far.join(base.select("file", "block", "base", F.col("size").alias("block_size")), "file")
            .where("base < payload_at + size AND base + block_size > payload_at"))
    need = stage(need, "warc-long")
    if not need.isEmpty():
        again = (_lines(spark, path).withColumn("line_no", F.monotonically_increasing_id())
                 .join(need.select("file", "block").distinct(), ["file", "block"]))
        part = again.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
        hexed = F.concat(F.array_join(F.transform("lines", lambda x: F.hex(x["line"])), "0A"), F.lit("0A"))
        cut_from = F.greatest(F.lit(0), F.col("payload_at") - F.col("base"))
        cut_to = F.least(F.col("block_size"), F.col("payload_at") + F.col("size") - F.col("base"))
        part = (part.withColumn("bytes", F.unhex(hexed)).drop("lines").join(need, ["file", "block"])
                .withColumn("bytes", F.substring("bytes", (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int"))))
        body = (part.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("block", "bytes"))).alias("parts"))
                .select("file", "at", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["bytes"])), "")).alias("body")))
        far = records.drop("body", "sha256").join(body, ["file", "at"]).withColumn("sha256", F.sha2("body", 256))
        near = near.select(*records.columns).unionByName(far.select(*records.columns))
    return whole.unionByName(near.select(*records.columns)).select(*out)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes size and digest from the response that it names; its digest field must agree.
    """
    spark = pages.sparkSession
    path = path or staging_path(spark, "warc")
    write_warc(pages, path)
    page = F.expr("try_cast(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
    refers = F.expr("try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
    rows = stage(read_warc(spark, path, payloads=False)
                 .select(page.alias("page_id"), F.col("type").alias("record_type"), refers.alias("refers_to"),
                         F.regexp_extract("digest", "sha256:(.*)", 1).alias("named"), "size", "sha256"), "warc-read")
    stored = (rows.where("record_type = 'response'").groupBy(F.col("sha256").alias("named"), F.col("page_id").alias("refers_to"))
              .agg(F.min("size").alias("full")))
    again = rows.where("record_type = 'revisit'").join(stored, ["named", "refers_to"])
    return (rows.where("record_type = 'response'")
            .select("page_id", F.col("size").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "record_type",
                    F.lit(None).cast("long").alias("refers_to"))
            .unionByName(again.select("page_id", F.col("full").alias("payload_bytes"), F.col("named").alias("payload_digest"),
                                      "record_type", "refers_to")))


def op2(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN first END AS refers_to FROM f"""
