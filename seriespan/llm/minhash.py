"""Operator 5: near-duplicates by MinHash and a multi-index Hamming join.

Documents whose sets of distinct five-word shingles have a Jaccard similarity of 0.75 or more are
linked; the classes are the connected components of the links.

1. ``sketch``: one pass over the texts gives the set's size, a 128-bit hash of the whole set and a
   signature of ``SYMBOLS`` minima, of which ``SYMBOL_BITS`` bits are kept each.
2. Documents with equal sets collapse to the smallest ``doc_id``; only these go on.
3. Multi-index Hamming join: the signature is split into ``CHUNKS`` chunks of ``WIDTH`` symbols. Two
   signatures that differ in at most ``RADIUS`` = 2 * CHUNKS - 1 symbols have, by the pigeonhole
   principle, a chunk with at most one differing symbol. Each chunk is therefore indexed with every
   choice of the one symbol that may differ left out, and all pairs within the radius share a key.
   At the threshold similarity the number of differing symbols is binomial(64, 0.25): it exceeds the
   radius of 31 with a probability below 2e-5, for higher similarities far less.
4. In a key's bucket the pairs within the radius are joined into families; only spanning links leave
   the task, never all pairs. Families are an outer bound of the classes.
5. Inside a family the links are confirmed on the full sets, read anew from the whole texts: every
   pair within a family that confirmed links do not already connect is compared. A family larger
   than ``BLOCK_SHINGLES`` is cut into blocks, a task for each pair of blocks.

Case: A-Z is lower-cased; words are split as in ``text``. A text of fewer than five words has its
whole word sequence as one shingle; texts without words have none and are linked with nothing.

Defined results: null texts count as empty; a null ``doc_id`` is a document without links and gets a
null ``component_id`` and ``kept`` true; rows that share a ``doc_id`` fall in one class; an empty
table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import settle
from .common import components
from .text import Block, blocks, mix, text_shingles

SHINGLE = 5
SIMILAR_NUM, SIMILAR_DEN = 75, 100
SYMBOLS, SYMBOL_BITS, WIDTH = 64, 8, 4
CHUNKS = SYMBOLS // WIDTH
RADIUS = 2 * CHUNKS - 1
BLOCK_SHINGLES = 1 << 20
#: The members of a bucket larger than this form one family without being compared, and are never
#: brought together: families are only an outer bound, and the full sets decide.
BUCKET_COMPARED = 20_000

_rng = np.random.Generator(np.random.PCG64(11))
_XOR = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHUNK_SEED = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64)).reshape(CHUNKS, WIDTH)
_SYMBOL_SEED = _rng.integers(1, 2**63, (WIDTH,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, first, _ = text_shingles(Block(texts, lower=True), SHINGLE)
    for i in range(len(texts)):
        yield np.unique(flat[first[i] : first[i + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The kept bits of the minimum of every hash function over a set of shingles."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, ((low[None, at : at + 4096] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(32 - SYMBOL_BITS)).astype(np.uint8)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """``CHUNKS * WIDTH`` keys per signature: each chunk with each one symbol left out."""
    parts = (signatures.astype(np.uint64) + np.uint64(1)).reshape(-1, CHUNKS, WIDTH) * _SYMBOL_SEED
    parts = mix(parts)
    whole = parts.sum(axis=2, dtype=np.uint64)
    return mix((whole[:, :, None] - parts) ^ _CHUNK_SEED[None]).reshape(len(signatures), -1)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, signature`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, signs = [], [], []
            for _, texts in blocks(batch, "_t"):
                for one in distinct_shingles(texts):
                    sizes.append(len(one))
                    if len(one):
                        a = np.bitwise_xor.reduce(mix(one))
                        b = mix(one ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
                        sets.append(b"%016x%016x" % (int(a), int(b)))
                        signs.append(signature(one).tobytes())
                    else:
                        sets.append(None)
                        signs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()).cast(pa.string()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key string, signature binary")


def near_links(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the graph of all pairs within ``RADIUS`` of each other."""
    n = len(signatures)
    group, links = np.arange(n), []
    for i in range(n - 1):
        other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(other):
            continue
        near = other[np.count_nonzero(signatures[other] != signatures[i], axis=1) <= RADIUS]
        for g in np.unique(group[near]):
            j = int(near[group[near] == g][0])
            links.append((i, j))
            group[group == g] = group[i]
    return links


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by key; a few batches at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(key)[batch.num_rows - 1]
        if batch.column(key)[0] == last and held[0].column(key)[0] == last:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != last.as_py())[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def families(signed: DataFrame) -> DataFrame:
    """``node, component`` over ``doc_id, signature``: outer bounds of the near-duplicate classes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
                keys = chunk_keys(found)
                ids = np.repeat(part.column("doc_id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "doc_id"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            keys, ids = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
            signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            a, b = [], []
            begin = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            size = np.diff(begin)
            pairs = begin[:-1][size == 2]
            pairs = pairs[np.count_nonzero(signs[pairs] != signs[pairs + 1], axis=1) <= RADIUS]
            a.extend(ids[pairs].tolist())
            b.extend(ids[pairs + 1].tolist())
            for g in np.flatnonzero(size > 2):
                part = slice(begin[g], begin[g + 1])
                for i, j in near_links(signs[part]):
                    a.append(int(ids[part][i]))
                    b.append(int(ids[part][j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keyed = signed.select("doc_id", "signature").mapInArrow(index, "key long, doc_id long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return components(_links(keyed, shared, signed, link))


def _links(keyed: DataFrame, shared: DataFrame, signed: DataFrame, link) -> DataFrame:
    """Signature links of the keys that two documents at least have."""
    kept = settle(shared.where("n > 1").select("key", "n", "low", "high"))
    pairs = kept.where("n = 2").select("low", "high")
    larger = kept.where(f"n > 2 AND n <= {BUCKET_COMPARED}").select("key")
    members = keyed.join(larger, "key", "left_semi")
    huge = kept.where(f"n > {BUCKET_COMPARED}").select("key", "n", "low")
    sign = signed.select("doc_id", "signature")
    a = sign.select(F.col("doc_id").alias("low"), F.col("signature").alias("_a"))
    b = sign.select(F.col("doc_id").alias("high"), F.col("signature").alias("_b"))
    distinct = settle(pairs.distinct())
    few = distinct.join(a, "low").join(b, "high").select("low", "high", "_a", "_b").mapInArrow(_near_pairs, "a long, b long")
    dealt = members.join(sign, "doc_id").repartition("key").sortWithinPartitions("key", "doc_id")
    links = few.unionByName(dealt.mapInArrow(link, "a long, b long").distinct())
    if huge.isEmpty():
        return links
    total = huge.agg(F.sum("n")).first()[0]
    star = attach(keyed, huge, "key", count="n", total=total, spread=F.col("doc_id")).where("low IS NOT NULL")
    return links.unionByName(star.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct())


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for c in ("_a", "_b"))
        near = np.flatnonzero(np.count_nonzero(a != b, axis=1) <= RADIUS)
        yield pa.RecordBatch.from_arrays([batch.column("low").take(pa.array(near)), batch.column("high").take(pa.array(near))], ["a", "b"])


def confirmed_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of the graph of pairs whose full sets are similar enough.

    Each set in turn is marked in a table of the group's shingles; sums over the marks of the later
    sets, which lie in one array, count the common shingles. Sets already connected are passed over.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")  # a set's candidates are then the next larger ones
    sizes = sizes[order]
    known, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    group, links = np.arange(n), []
    for i in range(n - 1):
        upto = int(np.searchsorted(sizes, sizes[i] * SIMILAR_DEN // SIMILAR_NUM, "right"))
        mark[flat[begin[i] : begin[i + 1]]] = 1
        for at in range(i + 1, upto, 512):  # some at a time: links found first spare comparisons
            stop = min(upto, at + 512)
            part = np.flatnonzero(group[at:stop] != group[i]) + at
            if not len(part):
                continue
            low = int(part[0])
            found = mark[flat[begin[low] : begin[stop]]]
            common = np.add.reduceat(found, begin[low:stop] - begin[low])[part - low]
            alike = part[SIMILAR_DEN * common >= SIMILAR_NUM * (sizes[i] + sizes[part] - common)]
            for g in np.unique(group[alike]):
                j = int(alike[group[alike] == g][0])
                links.append((int(order[i]), int(order[j])))
                group[group == g] = group[i]
        mark[flat[begin[i] : begin[i + 1]]] = 0
    return links


def confirm(docs: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Confirmed links ``a, b`` between documents of one family; ``members(doc_id, family, n_shingles)``."""

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch, "_t"):
                part = batch.slice(begin, len(texts))
                sets = [s.tobytes() for s in distinct_shingles(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("family"), part.column("blocks"), pa.array(sets, pa.binary())],
                    ["doc_id", "family", "blocks", "set"],
                )

    def link(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("set")]
        found = confirmed_links(sets)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    totals = members.groupBy("family").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    totals = totals.select("family", "n", F.ceil(F.col("s") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    many = settle(totals.where("blocks > 1"))
    total = members.count()
    placed = attach(members.select("doc_id", "family"), many, "family", count="n", total=total, spread=F.col("doc_id"))
    placed = settle(placed.select("doc_id", "family", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_t")).join(placed, "doc_id")
    sets = rows.mapInArrow(read_sets, "doc_id long, family long, blocks int, set binary")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = sets.withColumn("_own", own).withColumn("_other", other)
    sets = sets.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    return sets.groupBy("family", "_lo", "_hi").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``."""
    sketched = settle(sketch(docs, key, text))
    sets = settle(
        sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    )
    # rows of one doc_id with different texts share a class: their sets' representatives are linked
    repeated = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    signed = settle(
        sketched.join(sets.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
        .select("doc_id", "n_shingles", "signature").dropDuplicates(["doc_id", "n_shingles", "signature"])
    )
    family = families(signed)
    members = settle(
        signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
        .join(family.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family"), "doc_id")
    )
    links = settle(confirm(docs, members, key, text))
    total = sets.agg(F.sum("n")).first()[0] or 0
    multi = sets.where("n > 1").select("set_key", "n", "rep")
    placed = attach(
        sketched.select("doc_id", "n_shingles", "set_key"), multi, "set_key", count="n", total=total,
        spread=F.coalesce("doc_id", F.lit(0)),
    )
    placed = placed.withColumn("rep", F.coalesce("rep", "doc_id"))
    twice = placed.join(repeated.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = settle(components(links.unionByName(twice)))
    sized = found.join(sets.groupBy("rep").agg(F.sum("n").alias("n")), found["node"] == F.col("rep")).select("rep", "n", "component")
    out = attach(placed, settle(sized), "rep", count="n", total=total, spread=F.coalesce("doc_id", F.lit(0)))
    own = F.coalesce("component", "rep")
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
