"""WARC archives: deduplicating writer, and a reader that verifies record boundaries as a chain."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._store import cut, fresh_path, pick, small_or_shuffled

MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: eight groups of five hex digits, each four base-32 digits in the RFC 4648 letters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _target(url: Column, page_id: Column) -> Column:
    """The URI of a page: its url without control characters and with blanks as %20, or one made of its number where there is none."""
    plain = F.replace(F.regexp_replace(url, "[\\x00-\\x1f\\x7f]", ""), F.lit(" "), F.lit("%20"))
    return F.when(F.length(plain) > 0, plain).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def write(pages: DataFrame, path: str, date: datetime | None = None) -> None:
    """Write one record per row of pages (page_id, html, and url if there is one) into uncompressed WARC files under path.

    Of records with equal payloads the one with the largest page_id is a response
    that carries the payload; the others are revisits that name its record and
    carry the payload's digest and, in the extension field X-Payload-Bytes, its
    length.  Every record has the fields that the format demands; its date is
    ``date``, or now.  Spark's text writer commits the files: its separator is the
    end of a WARC record.

    Null html is an empty payload; a null url names the page by its number.  A null page_id counts as smaller than any.
    Rows that repeat a page_id and a payload are all responses or all revisits.
    Extra columns are ignored; no rows give an archive without records.
    """
    with_url = any(c.lower() == "url" for c in pages.columns)
    rows = pick(pages, "page_id", "html", "url") if with_url else pick(pages, "page_id", "html").withColumn("url", F.lit(None).cast("string"))
    rows = rows.select("page_id", F.coalesce("html", F.lit("")).alias("html"), _target(F.col("url").cast("string"), F.col("page_id")).alias("target"))
    at = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    narrow = rows.select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("of").isNotNull()).drop("n")
    shared = small_or_shuffled(cut(shared, "warc-shared"), 48)
    revisits = narrow.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("of"))).distinct()
    revisits = revisits.select(F.struct("page_id", "digest").alias("row"), "of")
    revisits = small_or_shuffled(cut(revisits, "warc-revisits"), 72)
    rows = rows.withColumn("row", F.struct("page_id", "digest")).join(revisits, "row", "left").drop("row")
    again = F.col("of").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: "),
        named(F.col("page_id")),
        F.lit(f"WARC-Date: {at}\r\nWARC-Target-URI: "),
        F.col("target"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Bytes: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), named(F.col("of")), F.lit(f"WARC-Profile: {_PROFILE}\r\n"))).otherwise(F.lit("Content-Type: application/http; msgtype=response\r\n")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _END).text(path)


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of one block, where the chain that starts there leaves the block: from the last to the first, each takes over its successor's exit."""
    group = group.sort_values("at", ascending=False)
    out: dict[int, int | None] = {}
    last = int(group["block_end"].iloc[0])
    for at, to in zip(group["at"], group["to"]):
        out[at] = None if pd.isna(to) else int(to) if to >= last else out.get(int(to))
    return pd.DataFrame({"file": group["file"], "block": group["block"], "at": group["at"], "exit": pd.array([out[a] for a in group["at"]], "Int64")})


def _reached(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one block (left) that the chain reaches from the block's entries (right)."""
    succ = dict(zip(left["at"], left["to"]))
    seen: list[int] = []
    for at in sorted(right["at"]):
        while at in succ and (not seen or at > seen[-1]):
            seen.append(at)
            if pd.isna(succ[at]):
                break
            at = int(succ[at])
    return left[left["at"].isin(seen)][["file", "block", "at", "to"]]


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every occurrence of the magic, in order: file, block (a split's first byte), n (order), value (what follows the magic).

    file is the hash of the path: a column of paths would compress so well in
    Parquet that the planner would take large tables for small ones.
    """
    df = spark.read.option("lineSep", MAGIC).text(path)
    meta = F.col("_metadata")
    return df.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def _header(value: Column, name: str) -> Column:
    return F.regexp_extract(F.substring_index(value, _END, 1), f"(?:^|\r\n){name}: ([^\r]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every occurrence of the magic with its byte offset (at), and the offset that its declared length leads to (to; null without one).

    A task parses what its split holds.  Offsets are sums of segment lengths:
    first within a split, then over the splits' totals.
    """
    seg = _segments(spark, path)
    value = F.col("value")
    head = F.substring_index(value, _END, 1)
    head_bytes = F.octet_length(head)
    size = F.octet_length(value)
    length = F.try_to_number(_header(value, "Content-Length"), F.lit("999999999999")).cast("long")
    whole = size >= head_bytes + 4 + length
    # the block starts at byte head_bytes + 5 of the segment, and header and block are valid text, so binary substrings are exact
    block = F.substring(F.encode(value, "UTF-8"), head_bytes + 5, length.cast("int"))
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    seg = seg.select(
        "file", "block", "n", (size + len(MAGIC)).cast("long").alias("seg_bytes"), (F.lit(len(MAGIC)) + head_bytes + 4 + length + 4).alias("step"), length.alias("length"),
        _header(value, "WARC-Type").alias("type"), page(_header(value, "WARC-Record-ID")).alias("page_id"), page(_header(value, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_header(value, "WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1).alias("digest"), _header(value, "X-Payload-Bytes").try_cast("long").alias("declared"),
        whole.alias("whole"), F.when(whole & (length > 0), _payload(block)).alias("payload"),
    )
    seg = seg.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload")))}).drop("payload")
    seg = cut(seg, "warc-segments")
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = seg.groupBy("file", "block").agg(F.sum("seg_bytes").alias("bytes")).withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    seg = seg.withColumn("inside", F.coalesce(F.sum("seg_bytes").over(inside), F.lit(0))).join(starts, ["file", "block"])
    at = F.col("start") + F.col("inside") - len(MAGIC)
    # the text before a file's first magic is a segment too, but no candidate
    return seg.withColumns({"at": at, "block_end": F.col("start") + F.col("bytes") - len(MAGIC)}).withColumn("to", F.when(F.col("at") >= 0, F.col("at") + F.col("step"))).drop("start", "bytes", "step")


def _payload(block: Column) -> Column:
    """The bytes after the HTTP header of a response block."""
    return F.substring(block, len(_HTTP) + 1, 2147483647)


def reachable(cand: DataFrame) -> DataFrame:
    """(file, block, at, to) of the candidates that the chain of successors reaches from offset 0 of their file.

    Chains are first shortened inside each block to their exit from it, in one
    pass over narrow rows; pointer jumping then doubles the stride from block to
    block, starting at the files' first records, and a last pass over each block
    marks what its entries reach.  Occurrences of the magic inside payloads have
    no such chain and fall out.
    """
    narrow = cand.where(F.col("at") >= 0).select("file", "block", "at", "to", "block_end")
    where = narrow.groupBy("file", "block").applyInPandas(_exits, "file long, block long, at long, exit long")
    jump = cut(where, "warc-exits")
    seen = cut(jump.where(F.col("at") == 0), "warc-entries")
    n = seen.count()
    while n:
        stride = jump.select("file", F.col("at").alias("exit"), F.col("block").alias("b2"), F.col("exit").alias("e2"))
        more = seen.join(stride, ["file", "exit"]).select("file", F.col("b2").alias("block"), F.col("exit").alias("at"), F.col("e2").alias("exit"))
        both = cut(seen.union(more).distinct(), "warc-entries")
        found = both.count()
        if found == n:
            break
        seen, n = both, found
        jump = cut(jump.join(stride, ["file", "exit"], "left").select("file", "block", "at", F.col("e2").alias("exit")), "warc-exits")
        seen = seen.drop("exit").join(jump.select("file", "at", "exit"), ["file", "at"], "left").select("file", "block", "at", "exit")
    return narrow.groupBy("file", "block").cogroup(seen.groupBy("file", "block")).applyInPandas(_reached, "file long, block long, at long, to long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to.

    For a response, size and digest are computed from the payload that was read;
    for a revisit they are the ones that its header states.  Payloads that hold
    the magic come in several segments and are joined up again.
    """
    cand = cut(candidates(spark, path), "warc-candidates")
    good = cut(reachable(cand), "warc-chain").select("file", "at", F.lit(True).alias("ok"))
    marked = cand.join(good, ["file", "at"], "left")
    plain = marked.where("ok and (whole or type = 'revisit')").select(
        "page_id",
        F.when(F.col("type") == "revisit", F.col("declared")).otherwise(F.coalesce("payload_bytes", F.lit(0))).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.coalesce("payload_digest", base32_sha1(F.lit(b"")))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
    if marked.where("ok and not whole and type != 'revisit'").isEmpty():
        return plain
    owner = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", "block", "inside", "at", "whole", "type", "page_id", "length", F.last(F.when(F.col("ok"), F.col("at")), ignorenulls=True).over(owner).alias("of"))
    split = owned.where("at = of and not whole and type != 'revisit'").select("file", "of", F.col("page_id").alias("owner"), F.col("length").alias("owner_length"))
    pieces = cut(owned.select("file", "block", "inside", "at", "of").join(split, ["file", "of"]), "warc-pieces")
    # the splits that hold such payloads are read once more; a segment is known by its split and its byte offset in it
    where = small_or_shuffled(cut(pieces.select("file", "block").distinct(), "warc-split-blocks"), 24)
    again = _segments(spark, path).join(where, ["file", "block"], "left_semi")
    again = again.withColumn("inside", F.coalesce(F.sum(F.octet_length("value") + len(MAGIC)).over(Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = again.join(pieces, ["file", "block", "inside"]).groupBy("file", "of", "owner", "owner_length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    full = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    head_bytes = F.octet_length(F.substring_index(full, _END, 1))
    payload = _payload(F.substring(F.encode(full, "UTF-8"), head_bytes + 5, F.col("owner_length").cast("int")))
    parted = text.select(F.col("owner").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(parted)


def query(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back from them."""
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)" for i in range(8) for shift in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""
