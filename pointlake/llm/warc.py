"""WARC files with Merkle fixity audit.

Pages are written as gzip members of WARC files, one record each, with an index of offsets. Files are
written where the rows are, without a shuffle, and roll over by size. A file's Merkle tree has the
SHA-256 of each stored record as leaves, in offset order, and above them the SHA-256 of every 16
consecutive children's digests, up to one root. An audit hashes a replica over the same offset ranges,
compares roots, and goes down only where digests differ.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing
from pointlake.session import materialise, scratch_path

FANOUT = 16
#: Records of a file in one row: as many as a whole subtree of this height has leaves.
HEIGHT = 3
LOT = FANOUT**HEIGHT
#: A file ends with the record that reaches so many bytes.
ROLL = 128_000_000
_INDEX = "shard long, file string, record long, page_id long, url string, offset long, length long, payload_sha256 binary"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
_TREE = "shard long, level int, node long, digest binary"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.1 resource record as one gzip member; the same page gives the same bytes."""
    body = (html or "").encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    target = "" if url is None else f"WARC-Target-URI: {url}\r\n"
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{target}{page}WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[int | None, str | None, bytes]:
    """page_id, url and payload of a stored record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = fields.get("X-Page-Id")
    return (None if page is None else int(page)), fields.get("WARC-Target-URI"), rest[: int(fields["Content-Length"])]


def is_damaged(page_id: int | None, url: str | None, seed: int, one_in: int) -> bool:
    """Whether the seeded damage hits a record: one in about ``one_in``, by a hash of the page's id and url."""
    return xxhash.xxh64_intdigest(f"{page_id}|{url}".encode("utf-8", "surrogatepass"), seed) % one_in == 0


def flipped(raw: bytes) -> bytes:
    """A stored record with the lowest bit of its middle byte changed."""
    at = len(raw) // 2
    return raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]


class _Files:
    """The files of one task, one after the other, in every copy."""

    def __init__(self, folder: str, copies: tuple[str, ...], roll: int):
        self.stores, self.roll = [_store(f"{folder}/{c}") for c in copies], roll
        self.number, self.outs, self.name, self.at, self.count = -1, [], "", 0, 0

    def place(self, raws: list[bytes]) -> tuple[int, str, int, int]:
        """Adds a record, as each copy has it; shard, file, number and offset."""
        if not self.outs or self.at >= self.roll:
            self.close()
            self.number, self.name, self.at, self.count = self.number + 1, f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.outs = [store.open_output_stream(f"{base}/{self.name}", compression=None) for store, base in self.stores]
        for out, raw in zip(self.outs, raws, strict=True):
            out.write(raw)
        got = ((TaskContext.get().partitionId() << 24) + self.number, self.name, self.count, self.at)
        self.at, self.count = self.at + len(raws[0]), self.count + 1
        return got

    def close(self) -> None:
        for out in self.outs:
            out.close()
        self.outs = []


def write_warc(pages: DataFrame, folder: str, copies: tuple[str, ...] = ("a",), damage: dict[str, tuple[int, int]] | None = None, roll: int = ROLL) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) to WARC files under ``folder``/<copy>/, and returns the index.

    Each task writes the rows it reads, in their order, and begins a new file (``shard``) after
    ``roll`` bytes. Null ids, urls and texts are stored as absent or empty, repeated rows as repeated
    records. Files get new names, so a task that is run again leaves only unlisted files. Every copy
    gets the same bytes, but for a copy that ``damage`` names with (seed, one_in): there a bit of one
    record in about one_in is changed, as a disk would.
    """
    for copy in copies:
        store, base = _store(f"{folder}/{copy}")
        store.create_dir(base, recursive=True)
    spoilt = damage or {}

    @freeing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, copies, roll)
        names = [x.split()[0] for x in _INDEX.split(", ")]
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*batch.columns, strict=True):
                page_id, url, html = page_id.as_py(), url.as_py(), html.as_py()
                raw = record_bytes(page_id, url, html)
                raws = [flipped(raw) if c in spoilt and is_damaged(page_id, url, *spoilt[c]) else raw for c in copies]
                shard, name, count, at = files.place(raws)
                rows.append((shard, name, count, page_id, url, at, len(raw), hashlib.sha256((html or "").encode("utf-8", "surrogatepass")).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)
        files.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialise(rows.mapInArrow(write, _INDEX), "warc-index")


def read_warc(index: DataFrame, folder: str, copy: str = "a") -> DataFrame:
    """page_id, url, html of all records that an index lists, read back from the files."""

    @freeing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(f"{folder}/{copy}")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    for lo in range(0, len(row["offsets"]), 256):
                        rows = [parse_record(f.read_at(length, offset)) for offset, length in zip(row["offsets"][lo : lo + 256], row["lengths"][lo : lo + 256], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].decode("utf-8", "surrogatepass") for r in rows], pa.string())], ["page_id", "url", "html"])

    return _ranges(index).mapInArrow(read, "page_id long, url string, html string")


def _ranges(index: DataFrame) -> DataFrame:
    """Ordered offset ranges: at most ``LOT`` consecutive records of a file in one row, so rows are bounded and a large file is many tasks' work."""
    lots = index.groupBy("shard", "file", F.expr(f"record div {LOT}").alias("lot")).agg(F.sort_array(F.collect_list(F.struct("record", "offset", "length"))).alias("r"))
    return lots.select("shard", "file", (F.col("lot") * LOT).alias("first"), F.col("r.offset").alias("offsets"), F.col("r.length").alias("lengths"))


def parent(children: list[bytes]) -> bytes:
    """The digest of a node: SHA-256 of its at most 16 children's digests as lowercase hex, in order."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def subtrees(index: DataFrame, folder: str, copy: str) -> DataFrame:
    """shard, level 0 to HEIGHT, node, digest of every range. Leaves (node: record) are the SHA-256 of what a copy stores in a record's range.

    A missing file or a range past its end has the digest of what is there.
    """

    @freeing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(f"{folder}/{copy}")
        for batch in batches:
            for row in batch.to_pylist():
                path, level = f"{base}/{row['file']}", []
                if store.get_file_info(path).type == fs.FileType.NotFound:
                    level = [hashlib.sha256(b"").digest()] * len(row["offsets"])
                else:
                    with store.open_input_file(path) as f:
                        size = f.size()
                        for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                            have = max(0, min(length, size - offset))
                            level.append(hashlib.sha256(f.read_at(have, offset) if have else b"").digest())
                first = row["first"]
                for height in range(HEIGHT + 1):
                    n = len(level)
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int64()), pa.array([height] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(level, pa.binary())], ["shard", "level", "node", "digest"])
                    level, first = [parent(level[i : i + FANOUT]) for i in range(0, n, FANOUT)], first // FANOUT

    return _ranges(index).mapInArrow(read, _TREE)


def tree(index: DataFrame, folder: str, copy: str) -> list[DataFrame]:
    """The levels of all files' trees, leaves first. All trees have the height of the highest, HEIGHT at least: a node without siblings has a parent too.

    The lowest HEIGHT are made where the ranges are read, and written together."""
    below = materialise(subtrees(index, folder, copy), "merkle")
    levels = [below.where(F.col("level") == k) for k in range(HEIGHT + 1)]
    most = (index.agg(F.max("record")).first()[0] or 0) // LOT
    while most:
        most //= FANOUT
        up = levels[-1].groupBy("shard", (F.col("level") + 1).alias("level"), F.expr(f"node div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"))
        hexed = F.array_join(F.transform("c", lambda c: F.lower(F.hex(c["digest"]))), "")
        levels.append(materialise(up.select("shard", "level", F.col("up").alias("node"), F.unhex(F.sha2(hexed, 256)).alias("digest")), "merkle"))
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """shard, record of the leaves that differ between two trees over the same ranges.

    Starts at the roots; each level down compares only children of nodes that differ.
    """
    suspects: DataFrame | None = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        if suspects is not None:
            up = suspects.select("shard", F.col("node").alias("up"))
            a = a.join(up, (a["shard"] == up["shard"]) & (F.expr(f"node div {FANOUT}") == up["up"]), "left_semi")
        other = b.select("shard", "node", F.col("digest").alias("other"))
        suspects = a.join(other, ["shard", "node"], "left").where(~F.col("digest").eqNullSafe(F.col("other"))).select("shard", "node")
    return suspects.select("shard", F.col("node").alias("record"))


def audited_pages(pages: DataFrame, folder: str | None = None, damage: tuple[int, int] | None = None) -> DataFrame:
    """Archives ``pages`` in two replicas and audits the second against the first.

    Returns page_id, url, shard, record, offset, length, payload_sha256, leaf_sha256 (of the first
    replica's stored record), intact (whether the second replica has the same), for every row of
    ``pages``. ``damage``, (seed, one_in), spoils the second replica in known places. Other columns
    are not read; an empty table gives no rows.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_warc(pages, folder, ("a", "b"), {"b": damage} if damage else None)
    first, second = tree(index, folder, "a"), tree(index, folder, "b")
    damaged = audit(first, second).withColumn("damaged", F.lit(True))
    digests = first[0].select("shard", F.col("node").alias("record"), F.lower(F.hex("digest")).alias("leaf_sha256"))
    listed = index.join(digests, ["shard", "record"]).join(damaged, ["shard", "record"], "left")
    return listed.select("page_id", "url", "shard", "record", "offset", "length", F.lower(F.hex("payload_sha256")).alias("payload_sha256"), "leaf_sha256", F.col("damaged").isNull().alias("intact"))
