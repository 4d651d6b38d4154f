"""Token ids in content-addressed files.

A rolling hash over the ids of a document cuts them into chunks, so that equal passages give equal chunks wherever they
stand.  A store is a folder with

  chunks/    chunk_id (BLAKE2b-128 of the payload), n_ids, payload (little-endian ids, 2 bytes each where the vocabulary
             fits, else 4); every distinct chunk once
  recipes/   doc_id, row, start, n_tokens, width, chunk_ids in order, root; sorted by doc_id, files in that order too; start
             counts the ids of all documents before, row the documents up to this one
  manifest/  one row for each range of recipes: number, documents, ids, and the Merkle root over the documents' roots

The root of a document is the Merkle root over its chunk ids.  Reading checks every payload against its chunk id and
every recipe against its root.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small
from .common import bounded, cache, checked, dropped, lean, new_dir, running_totals, staged, written
from .wordids import WordEncoder

#: Chunks that a task knows it has sent already; this bounds memory and spares rows only.
REMEMBERED = 100_000
#: Ids that the rolling hash looks back on.
WINDOW = 16


def cuts(ids: np.ndarray, least: int, usual: int, most: int) -> list[int]:
    """Where chunks end: after an id at which a hash of the last WINDOW ids hits one of about `usual` values, at least `least` and at most `most` ids after the last end."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, step = 0xD1342543DE82EF95, 1
    while step < WINDOW:  # doubles the ids that h covers
        longer = h.copy()
        longer[step:] += h[:-step] * np.uint64(base)
        h, base, step = longer, base * base & 0xFFFFFFFFFFFFFFFF, step * 2
    hits = np.flatnonzero((h >> np.uint64(40)) % np.uint64(max(1, usual - least)) == 0) + 1
    ends, at = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - at > most:
            at += most
            ends.append(at)
        if hit - at >= least or (hit == n and hit > at):
            ends.append(hit)
            at = hit
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd leaf goes up as it is; no leaves give the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_encoders: dict[str, WordEncoder] = cache("wordids")


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 128, usual: int = 512, most: int = 2048) -> None:
    """Encodes every whole text and writes a store at path.

    Null texts count as empty.  end_id, where given, follows each document's ids.  Rows with equal ids are kept, in the
    order of their contents; null ids come first.  Other columns are not read.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = _encoder(tokenizer), set()
        place = TaskContext.get().partitionId() << 32
        width, code = encoder.width, encoder.code
        end = np.array([] if end_id is None else [end_id], dtype=code)
        for whole in batches:
            for batch in small(whole, 1000):
                ends, keys, counts, places, payloads, lengths, roots = array("i", [0]), [], [], [], [], [], []
                flat, bounds = encoder.encode(batch.column(1))
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.concatenate([flat[lo:hi], end])
                    packed, at, own = ids.tobytes(), 0, []
                    for stop in cuts(ids, least, usual, most):
                        payload = packed[at * width : stop * width]
                        key = digest(payload)
                        own.append(key)
                        counts.append(stop - at)
                        new = key not in sent
                        places.append(place if new else None)
                        payloads.append(payload if new else None)
                        place += new
                        sent.add(key)
                        at = stop
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    keys += own
                    lengths.append(at)
                    roots.append(merkle(own))
                    ends.append(len(keys))
                chunks = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(places, pa.int64()), pa.array(payloads, pa.binary())], names=["chunk_id", "n_ids", "place", "payload"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array([width] * len(lengths), pa.int32()), lists, pa.array(roots, pa.binary())], names=["doc_id", "n_tokens", "width", "chunks", "root"])

    schema = f"doc_id {id_type}, n_tokens long, width int, chunks array<struct<chunk_id:binary,n_ids:int,place:bigint,payload:binary>>, root binary"
    cut = staged(bounded(docs).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run, "wordids"), schema), "cut")
    light = staged(cut.select("doc_id", "n_tokens", "width", F.col("chunks.chunk_id").alias("chunk_ids"), "root"), "light")
    # only chunks that several tasks cut are dealt anew, by their ids; of these the first place stays
    each = cut.select(F.explode("chunks").alias("c")).where("c.place is not null")
    again = each.select("c.chunk_id", "c.place").groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("place").alias("kept")).where("n > 1").select("chunk_id", "kept")
    again = checked(staged(again, "again"))
    unique = each.select("c.*").join(again, "chunk_id", "left").where("kept is null or kept = place").select("chunk_id", "n_ids", "payload")
    written(unique, f"{path}/chunks")
    dropped(cut)
    ordered = running_totals(light, [F.col("doc_id").asc_nulls_first(), F.col("root")], {"end": F.col("n_tokens"), "row": F.lit(1).cast("long")}, "recipes")
    numbered = ordered.withColumn("start", F.col("end") - F.col("n_tokens"))
    recipes = numbered.select("doc_id", "row", "start", "n_tokens", "width", "chunk_ids", "root", "_range")
    written(recipes.repartitionByRange("row").sortWithinPartitions("row"), f"{path}/recipes")

    def seal(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        return pa.table({"number": [key[0].as_py()], "documents": [rows.num_rows], "ids": [sum(rows["n_tokens"].to_pylist())], "root": pa.array([merkle(rows["root"].to_pylist())], pa.binary())})

    sealed = read_recipes(spark, path).select("_range", "row", "n_tokens", "root").groupBy("_range").applyInArrow(seal, "number long, documents long, ids long, root binary")
    written(sealed, f"{path}/manifest")
    dropped(light)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store with crc, the CRC-32 of their ids as little-endian unsigned 32-bit integers; raises where a payload does not fit its chunk id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for key, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(payload, dtype=f"<u{len(payload) // n}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())], names=["chunk_id", "n_ids", "payload", "crc"])

    return bounded(spark.read.parquet(f"{path}/chunks")).select("chunk_id", "n_ids", "payload").mapInArrow(lean(run), "chunk_id binary, n_ids int, payload binary, crc long")


def _joined(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """For each document its recipe and, in order, what chunks has on each of its chunks."""
    recipes = read_recipes(spark, path)
    parts = recipes.select("row", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(chunks, "chunk_id", "left")
    found = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in chunks.columns)))).alias("parts"))
    return recipes.join(found, "row", "left")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of long) of every document, put together from chunks that fit their ids and recipes that fit their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                payloads = [p["payload"] for p in row["parts"] or []]
                if merkle([p["chunk_id"] for p in row["parts"] or []]) != row["root"] or None in payloads:
                    raise ValueError(f"document {row['doc_id']} cannot be put together")
                rows.append(np.frombuffer(b"".join(payloads), dtype=f"<u{row['width']}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    joined = _joined(spark, path, read_chunks(spark, path).drop("crc"))
    schema = f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, start long, ids array<long>"
    return joined.select("doc_id", "start", "width", "root", "parts").mapInArrow(lean(run), schema)


#: CRC-32 as in zlib: the reflected polynomial.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two reflected polynomials modulo that of the CRC."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=64)
def _doubling(k: int) -> np.ndarray:
    """What multiplying by x to the power of 8 * 2**k does to each value of each of the four bytes of a CRC."""
    power = 1 << 23
    for _ in range(k):
        power = _times(power, power)
    return np.array([[_times(power, value << 8 * byte) for value in range(256)] for byte in range(4)], dtype=np.uint32)


def followed(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC as it enters that of its data followed by so many more bytes; what follows then adds its own."""
    out, k = crcs.astype(np.uint32), 0
    while len(n_bytes) and int(n_bytes.max()) >> k:
        rows = np.flatnonzero(n_bytes >> k & 1)
        table, own = _doubling(k), out[rows]
        out[rows] = table[0][own & 255] ^ table[1][own >> 8 & 255] ^ table[2][own >> 16 & 255] ^ table[3][own >> 24]
        k += 1
    return out


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Every payload is read, checked against its chunk id and summed where it lies; documents then join the sums of their
    chunks, in the recipe's order, which gives the CRC of their whole id sequence without moving payloads.  Raises where
    a chunk is damaged or missing, or chunks do not fit their document's root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4).fill_null([])
            parts, counts = lists.flatten(), np.array([len(x) for x in lists], dtype=np.int64)
            keys, roots = parts.field("chunk_id").to_pylist(), batch.column(3).to_pylist()
            if parts.field("crc").null_count:
                raise ValueError("a chunk is missing")
            sizes, crcs = parts.field("n_ids").to_numpy().astype(np.int64), parts.field("crc").to_numpy()
            ends = np.cumsum(counts)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            if not np.array_equal(upto[ends] - upto[ends - counts], batch.column(2).to_numpy()):
                raise ValueError("a document has another number of ids than its recipe says")
            for root, a, b in zip(roots, (ends - counts).tolist(), ends.tolist(), strict=True):
                if merkle(keys[a:b]) != root:
                    raise ValueError("a document cannot be put together")
            after = np.repeat(upto[ends], counts) - upto[1:]
            moved = np.concatenate([followed(crcs, 4 * after), np.zeros(1, dtype=np.uint32)])
            total = np.where(counts > 0, np.bitwise_xor.reduceat(moved, np.minimum(ends - counts, len(moved) - 1)), 0) if len(counts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    sums = staged(read_chunks(spark, path).drop("payload"), "sums")
    joined = _joined(spark, path, sums)
    schema = f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long"
    return joined.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(lean(run), schema)


def new_store(spark: SparkSession) -> str:
    """A place for a store in the shared folder."""
    return new_dir(spark, "store")
