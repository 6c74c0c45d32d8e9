"""Operator 12: line dedup by a sharded minimal perfect hash over line hashes.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; keys
of at least ``min_chars`` code points count. ``repeated_lines`` hashes every document's distinct keys to
128 bits, combined per task and then by hash, and keeps the hashes found in ``min_docs`` documents
or more. ``build`` deals them to shards of about ``SHARD_KEYS`` by their first half and lays over each
a minimal perfect hash (``perfect``): the slot holds the second half as fingerprint, the document count
and the largest document. No line and no text is ever joined.

``drop_lines`` probes the arrays from the documents. Shards of up to ``IN_PLACE_BYTES`` in all (a sum
that is checked) are broadcast and every document is cut where it lies. More shards stay where they
are: documents send their line hashes, 24 bytes each, to the shards, in which a shard's array comes
before the hashes that probe it, so a task holds one shard at a time; busy shards are dealt to several
tasks, as the hashes were counted per shard. Hits return to their document in a join by its key. Both
ways give the same rows.

A foreign line is taken for a repeated one if 64 bits of its hash lead to a slot and the other 64 agree
by chance: below 1e-6 for 10**12 lines.

Defined results: a null or empty text is one empty line. Every row is a document, also where doc_id
repeats; a null doc_id is smaller than all others, and rows that share the largest keep their lines. A
last line feed gives an empty last line, as splitting does. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .perfect import PerfectIndex

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 17
IN_PLACE_BYTES = 48 << 20
#: Line hashes that a task counts before it hands its sums on.
COUNT_KEYS = 1 << 19
#: Line hashes a task probes when shards stay where they are.
PROBES = 8 << 20
SMALLEST = -(2**63)  # stands for a null document key, which no other may be smaller than


def line_keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The key of every line, None where it is too short to count."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()  # of bytes, both know ASCII only
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key if long else None)
    return out


def hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits of every key as two 64-bit halves."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``a, b, docs, largest``: both halves of the hash, documents, and the largest document's key."""

    def flush(count: dict[bytes, list[int]]) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(count), ">u8").astype(np.uint64).reshape(-1, 2)
        sums = np.array(list(count.values()), np.int64).reshape(-1, 2)
        cells = [_signed(both[:, 0].copy()), _signed(both[:, 1].copy()), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        return pa.RecordBatch.from_arrays(cells, ["a", "b", "docs", "largest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, list[int]] = {}
        for batch in batches:
            for doc, value in zip(batch.column("k").to_pylist(), _texts(batch.column("t"))):
                for k in set(line_keys(value.split(b"\n"), min_chars)) - {None}:
                    seen = count.setdefault(xxhash.xxh3_128_digest(k), [0, SMALLEST])
                    seen[0] += 1
                    seen[1] = max(seen[1], doc)
                if len(count) >= COUNT_KEYS:
                    yield flush(count)
                    count = {}
        yield flush(count)

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(SMALLEST)).alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(run, "a long, b long, docs long, largest long")
    return found.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest")).where(F.col("docs") >= min_docs)


def build(repeated: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """``shard, cell``, one perfect hash per shard, written once; and the number of shards."""
    repeated = settle(repeated)
    shards = max(1, math.ceil(repeated.count() / shard_keys))

    def one(key: tuple, part: pa.Table) -> pa.Table:
        column = lambda c: part.column(c).to_numpy()
        counts = np.minimum(column("docs"), 2**32 - 1).astype(np.uint32)
        index = PerfectIndex.build(column("a").view(np.uint64), column("b").view(np.uint64), {"docs": counts, "largest": column("largest")})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([index.to_bytes()], pa.binary())})

    dealt = repeated.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return settle(dealt.groupBy("shard").applyInArrow(one, "shard int, cell binary")), shards


def cut(text: bytes, gone: set[int] | list[int], lines: list[bytes]) -> tuple[int, int, str]:
    kept = text if not gone else b"\n".join([v for i, v in enumerate(lines) if i not in gone])
    return len(lines), len(gone), hashlib.sha256(kept).hexdigest()


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each first half, as ``pmod`` of the signed value gives it."""
    return np.mod(a.view(np.int64), shards)


def in_place(docs: DataFrame, cells: list[tuple[int, bytes]], shards: int, key: str, text: str, min_chars: int) -> DataFrame:
    """Every document cut where it lies, with all shards broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: PerfectIndex.from_bytes(cell) for s, cell in shared.value}
        for batch in batches:
            split = [t.split(b"\n") for t in _texts(batch.column("t"))]
            own = np.array([SMALLEST if v is None else v for v in batch.column("k").to_pylist()], np.int64)
            places, keys = [], []
            for i, lines in enumerate(split):
                for j, k in enumerate(line_keys(lines, min_chars)):
                    if k is not None:
                        places.append((i, j))
                        keys.append(k)
            gone: list[set[int]] = [set() for _ in split]
            if keys:
                h, at = hashes(keys), np.array(places)
                of = shard_of(h[:, 0].copy(), shards)
                for s in np.unique(of).tolist():
                    mine = np.flatnonzero(of == s)
                    if s in index:
                        slot = index[s].find(h[mine, 0], h[mine, 1])
                        hit = slot >= 0
                        hit[hit] = index[s].payload["largest"][slot[hit]] > own[at[mine[hit], 0]]
                        for i, j in at[mine[hit]].tolist():
                            gone[i].add(j)
            out = [cut(b"\n".join(lines), g, lines) for lines, g in zip(split, gone)]
            yield _result(batch.column("k"), out)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, _schema(kind)).withColumnRenamed("k", key)


def _schema(kind: str) -> str:
    return f"k {kind}, n_lines long, n_dropped long, kept_sha256 string"


def _result(keys: pa.Array, out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays([keys, *columns], ["k", "n_lines", "n_dropped", "kept_sha256"])


def routed(docs: DataFrame, index: DataFrame, shards: int, key: str, text: str, min_chars: int, probes: int = PROBES) -> DataFrame:
    """The same with shards that stay where they are: line hashes go to them and hits come back."""
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(key).cast("long"), F.lit(SMALLEST)).alias("_own"))
    # rows that share the largest document and lines share their fate, so the key and the text's hash name a row
    keyed = keyed.withColumn("_row", F.xxhash64("t"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, row = batch.column("_own").to_numpy(), batch.column("_row").to_numpy()
            who, keys = [], []
            for i, t in enumerate(_texts(batch.column("t"))):
                mine = set(line_keys(t.split(b"\n"), min_chars)) - {None}
                who += [i] * len(mine)
                keys += mine
            h, who = hashes(keys), np.array(who, np.int64)
            of = shard_of(h[:, 0].copy(), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of), _signed(h[:, 0].copy()), _signed(h[:, 1].copy()), pa.array(own[who]), pa.array(row[who])],
                ["shard", "a", "b", "_own", "_row"],
            )

    sent = settle(keyed.select("_own", "_row", "t").mapInArrow(send, "shard int, a long, b long, _own long, _row long"))
    load = sent.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.coalesce("_n", F.lit(0)) / probes).cast("int")
    cells = index.join(load, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    wide = load.agg(F.max(salts)).first()[0] or 1
    loads = F.greatest(salts, F.lit(1))
    asked = sent.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("_own", "_row", "a"), loads).cast("int"))
    blank = F.lit(None)
    both = cells.select("shard", "salt", "cell", *[blank.cast("long").alias(c) for c in ("a", "b", "_own", "_row")]).unionByName(
        asked.select("shard", "salt", blank.cast("binary").alias("cell"), "a", "b", "_own", "_row")
    )
    spread = both.repartition(max(1, min(shards * wide, 100_000)), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("cell").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                if low == high:
                    continue
                if (shard[low], salt[low]) != at:
                    at, now = (shard[low], salt[low]), None
                if batch.column("cell")[low].is_valid:
                    now, low = PerfectIndex.from_bytes(batch.column("cell")[low].as_py()), low + 1
                if now is None or low == high:
                    continue
                part = batch.slice(low, high - low)
                a, b, own = (part.column(c).to_numpy() for c in ("a", "b", "_own"))
                slot = now.find(a.view(np.uint64), b.view(np.uint64))
                hit = slot >= 0
                hit[hit] = now.payload["largest"][slot[hit]] > own[hit]
                keep = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(own[keep]), part.column("_row").take(pa.array(keep))], ["a", "b", "_own", "_row"])

    hits = spread.mapInArrow(probe, "a long, b long, _own long, _row long")
    gone = hits.groupBy("_own", "_row").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    whole = keyed.join(gone, ["_own", "_row"], "left").select("k", "t", F.col("gone.a").alias("ga"), F.col("gone.b").alias("gb"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, ga, gb in zip(_texts(batch.column("t")), batch.column("ga").to_pylist(), batch.column("gb").to_pylist()):
                lines, bad = t.split(b"\n"), set(zip(ga or (), gb or ()))
                gone: set[int] = set()
                if bad:
                    keys = line_keys(lines, min_chars)
                    at = [i for i, k in enumerate(keys) if k is not None]
                    h = hashes([keys[i] for i in at]).view(np.int64)
                    gone = {i for i, (a, b) in zip(at, h.tolist()) if (a, b) in bad}
                out.append(cut(t, gone, lines))
            yield _result(batch.column("k"), out)

    return whole.mapInArrow(finish, _schema(kind)).withColumnRenamed("k", key)


def drop_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD_KEYS,
    in_place_bytes: int = IN_PLACE_BYTES,
) -> DataFrame:
    """``key, n_lines, n_dropped, kept_sha256`` of every document."""
    index, shards = build(repeated_lines(docs, key, text, min_chars=min_chars, min_docs=min_docs), shard_keys)
    size = index.agg(F.sum(F.length("cell"))).first()[0] or 0
    if size > in_place_bytes:
        return routed(docs, index, shards, key, text, min_chars)
    cells = [(r["shard"], bytes(r["cell"])) for r in index.toLocalIterator()]
    return in_place(docs, cells, shards, key, text, min_chars)
