"""Token-ID files: flat unsigned ids, 64-bit document offsets, read back by memory map.

Format of a folder. Shard ``k`` covers a range of the document order; shards are in that order:

* ``k.ids``      little-endian unsigned ids, 2 bytes each if the tokenizer's ids, added ones too, are below 65,536, else 4
* ``k.offsets``  n + 1 little-endian unsigned 64-bit numbers: where each document's ids begin in this shard
* ``k.docs``     n little-endian signed 64-bit document ids (null: the least value)
* ``manifest.json``  id width and, for each shard, documents, tokens and its base: the ids of all shards before it
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing, text_batches
from pointlake.llm.tokens import encoder
from pointlake.operators.partitioning import cut_points, deal, range_index
from pointlake.session import scratch_path, shuffle_partitions

NULL_ID = -(1 << 63)
#: Bytes of a generation of the encoder's caches. A worker's tasks share them, so they hold the words of several partitions.
CACHES = {"pieces": 160_000_000, "parts": 60_000_000}
_SHARD = "shard long, part string, n_docs long, n_tokens long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, width: int, end_id: int):
    @freeing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        encode = encoder(tokenizer, **CACHES).encode
        end = np.array([end_id], "<u4").tobytes()
        name, shard, ids_out, sizes, docs = uuid.uuid4().hex, None, None, [], []
        for batch in batches:
            at = batch.schema.get_field_index
            keys, texts, shards = (batch.column(at(c)) for c in ("doc_id", "text", "shard"))
            for doc, text, own in zip(keys.to_pylist(), texts, shards.to_pylist(), strict=True):
                if shard is None:
                    shard, ids_out = own, store.open_output_stream(f"{base}/{name}.ids")
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if width == 2 and ids.max() >> 16:
                    raise ValueError(f"document {doc}: id {ids.max()} does not fit {width} bytes")
                ids_out.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(len(ids))
                docs.append(NULL_ID if doc is None else doc)
        if shard is None:
            return
        ids_out.close()
        with store.open_output_stream(f"{base}/{name}.offsets") as out:
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
        with store.open_output_stream(f"{base}/{name}.docs") as out:
            out.write(np.array(docs, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "part": [name], "n_docs": [len(docs)], "n_tokens": [int(sum(sizes))]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[dict]:
    """Encodes whole ``text`` values and writes the files above to ``folder``, ordered by ``doc_id``.

    Null texts count as empty and hold the end id alone. Null ids come first; rows of one id are
    ordered by their text. Repeated rows each get their place. Other columns are not read. An empty
    table writes a manifest without shards.

    One shuffle deals ranges of ids to tasks, each of which writes one shard under a new name, so a
    task that is run again leaves only unlisted files. The base of each shard is a prefix sum over
    one row a shard. Returns the manifest's shards.
    """
    spark = docs.sparkSession
    text_batches(spark)
    n, width = shuffle_partitions(spark), 2 if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    cuts = cut_points(rows, "doc_id", n)
    index = range_index(F.col("doc_id"), cuts)
    dealt = deal(rows.withColumn("shard", index.cast("long")), F.col("shard").cast("int"), n).sortWithinPartitions("doc_id", "text")
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    found = dealt.select("doc_id", "text", "shard").mapInArrow(_writer(folder, tokenizer, width, end_id), _SHARD).collect()
    found = sorted(found, key=lambda r: r["shard"])
    bases = accumulate((r["n_tokens"] for r in found), initial=0)
    shards = [r.asDict() | {"base": b} for r, b in zip(found, bases, strict=False)]
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"width": width, "end_id": end_id, "shards": shards}).encode())
    return shards


def _map(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the store is a local folder, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reads a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    ids_crc32 is over the document's ids as little-endian unsigned 32-bit numbers. Each shard is one
    task's work, opened by memory map and read document by document.
    """
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    width, shards = manifest["width"], manifest["shards"]
    listed = spark.createDataFrame([(s["shard"], s["part"], s["base"]) for s in shards], "shard long, part string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['part']}"
                ids, offsets, docs = (_map(store, f"{name}.{x}", k) for x, k in (("ids", f"<u{width}"), ("offsets", "<u8"), ("docs", "<i8")))
                offsets = np.asarray(offsets).astype(np.int64)
                for lo in range(0, len(docs), 10_000):
                    hi = min(lo + 10_000, len(docs))
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    own = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(offsets[lo:hi] + row["base"]), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(crc, pa.int64()), pa.array(np.full(hi - lo, row["shard"]))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    return listed.repartition(max(1, len(shards))).mapInArrow(read, _DOCS)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the files (to a new shared folder unless one is named) and returns what a reader finds in them."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer)
    return read_token_files(spark, folder)
