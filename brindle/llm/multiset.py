"""Document fingerprints by a homomorphic multiset hash of paragraphs.

The fingerprint of a text is the sum, lane by lane modulo 2^32, of a wide vector for each of its paragraphs (the
lines that aren't empty). Sums don't depend on order; a paragraph is inserted by adding its vector and deleted by
subtracting it. The vector has two parts:

- ``EQUAL`` lanes hold 512 bits of the paragraph's hash. Texts with different multisets of paragraphs differ here with near certainty.
- ``LIKE`` lanes hold the sum, over the paragraph's sentences, of a vector of signs (1 or -1) from the sentence's hash. The
  product of two texts' lanes is, on average, the product of their sentence counts, so lanes tell how alike texts are.

``likeness`` is 1 for equal fingerprints, else twice the product of the LIKE lanes by the sum of their squares (the Dice coefficient of
the counts of sentences), with an error of about 1 / sqrt(``LIKE``). What lies below two such errors can't be told from texts that have nothing in
common, and is 0. A text of one changed sentence has likeness 0 to the text before.

The printed form is the lanes as hexadecimal digits, so printed fingerprints can be added and compared.

``with_edited`` fingerprints each document and its edited text, which takes code points from the next document.
The documents are dealt once, whole, into ranges of doc_id of about ``RANGE_ROWS`` rows (more where that would make over
``RANGES`` ranges, so that the driver's list of them is bounded), whose bounds are quantiles; an id of many rows is a range of its own, dealt further by the hash of the text. Each range is
sorted and read as a stream that holds two documents. The first document of a range is dealt to the range
before as well (the first of all to the last range), a number of rows bounded by the ranges.

Defined results: a null text counts as empty, with the zero fingerprint; likeness of two zero fingerprints is 1. Rows of
equal doc_id follow each other in the order of their text's hash. Null doc_ids come first. The next of a single document is itself. Repeated rows are
each other's next. An empty table gives an empty result. A very long text is held whole, with the next one. ``with_edited`` ignores other columns;
in ``fingerprints`` a kept column named fingerprint is replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import slices, with_fields

EQUAL, LIKE = 16, 128
LANES = EQUAL + LIKE
#: Documents in a range, and ranges at most.
RANGE_ROWS, RANGES = 256, 65_536
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def fingerprint(text: str | None) -> np.ndarray:
    """The lanes of a text, unsigned words of 32 bits."""
    import xxhash

    digest = xxhash.xxh128_digest
    equal, like = np.zeros(EQUAL, "uint64"), np.zeros(LIKE, "int64")
    paragraphs = list(filter(None, (text or "").split("\n")))
    for i in range(0, len(paragraphs), 4096):
        some = paragraphs[i : i + 4096]
        raw = b"".join([hashlib.blake2b(p.encode(), digest_size=4 * EQUAL).digest() for p in some])
        equal += np.frombuffer(raw, "<u4").reshape(-1, EQUAL).sum(0, dtype="uint64")
        signs = b"".join([digest(s.encode()) for p in some for s in _SENTENCE.split(p)])
        bits = np.unpackbits(np.frombuffer(signs, "u1").reshape(-1, LIKE // 8), axis=1)
        like += 2 * bits.sum(0, dtype="int64") - len(bits)
    return np.concatenate([equal, like.view("uint64")]).astype("uint32")


def insert(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return fp + fingerprint(paragraph)


def delete(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return fp - fingerprint(paragraph)


def text_form(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def from_text(form: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(form), ">u4").astype("uint32")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the estimated Dice coefficient of the sentences."""
    if (a == b).all():
        return 1.0
    x, y = (f[EQUAL:].view("int32").astype("float64") for f in (a, b))
    size = float(x @ x + y @ y)
    found = 2 * float(x @ y) / size if size else 0.0
    return min(found, 1.0) if found >= 2 / LIKE**0.5 else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many, or all, of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with the fingerprint of the text, in its printed form."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    schema, through = with_fields(df, keep, [T.StructField("fingerprint", T.StringType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                forms = [text_form(fingerprint(t)) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(forms)], names=schema.names)

    return df.select(*through, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """First ids of the ranges, by quantiles; at most ``ranges`` of them."""
    if ranges < 2:
        return []
    marks = ids.agg(F.percentile_approx("__id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    return sorted(set(marks))


def with_edited(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    lowest, text = -(1 << 63), F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    total = source.count()
    ranges = ranges or max(1, min(RANGES, total // RANGE_ROWS))
    rows_each = max(1, -(-total // ranges))
    # Ids of more rows than two ranges: fewer than ``ranges``.
    heavy = {r[0]: -(-r[1] // rows_each) for r in source.groupBy("__id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_each).collect()}
    bounds = sorted({*_bounds(source.select("__id"), ranges), *heavy, *(x + 1 for x in heavy if x < -lowest - 1)})

    def places(batch: pa.RecordBatch) -> np.ndarray:
        """The range of each row, rising with (__id, __hash)."""
        ids, hashes = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("__id", "__hash"))
        place = np.searchsorted(np.array(bounds, "int64"), ids, side="right").astype("int64") << 32
        for x, parts in heavy.items():
            own = ids == x
            if own.any():
                place[own] += np.minimum((hashes[own] / 2.0**64 + 0.5) * parts, parts - 1).astype("int64")
        return place

    def deal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch)), *batch.columns], names=["__range", *batch.schema.names])

    def firsts(batches):
        """The least (id, hash) of each range among a task's rows."""
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            place, ids, hashes = places(batch), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((hashes, ids))
            at = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
            for p, x in zip(place[at].tolist(), zip(ids[at].tolist(), hashes[at].tolist(), strict=True), strict=True):
                least[p] = min(x, least.get(p, x))
        arrays = [pa.array(list(least), pa.int64()), *(pa.array([x[k] for x in least.values()], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(arrays, names=["__range", "__id", "__hash"])

    placed = source.mapInArrow(deal, T.StructType([T.StructField("__range", T.LongType()), *source.schema])).withColumn("__copy", F.lit(0))
    per_range = source.select("__id", "__hash").mapInArrow(firsts, "__range long, __id long, __hash long").groupBy("__range").agg(F.min(F.struct("__id", "__hash")).alias("x"))
    heads = sorted((r[0], r[1][0], r[1][1]) for r in per_range.collect())
    # A range's first document also goes, marked 1, to the range before; the very first, marked 2, to the last range.
    if heads:
        copies = df.sparkSession.createDataFrame([(x, h, heads[k - 1][0], 1 if k else 2) for k, (_, x, h) in enumerate(heads)], "__x long, __h long, __to long, __copy int")
        # At most about twice ``ranges`` rows are broadcast.
        extra = source.join(F.broadcast(copies), (source["__id"] == copies["__x"]) & (source["__hash"] == copies["__h"]))
        placed = placed.unionByName(extra.select(F.col("__to").alias("__range"), id_col, "__id", "__hash", "__text", "__copy"))
    ordered = placed.repartition("__range").sortWithinPartitions("__range", "__copy", "__id", "__hash")
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pair(batches):
        held = None  # range, id, text, fingerprint of a document that waits for the next
        for batch in batches:
            for part in slices(batch, "__text"):
                out = []
                for place, key, text, copy in zip(*(part.column(c).to_pylist() for c in ("__range", id_col, "__text", "__copy")), strict=True):
                    if held and held[0] != place:
                        raise RuntimeError("a range has no document after its last")
                    if copy and not held:
                        continue
                    fp = fingerprint(text)
                    if held:
                        _, own_key, own, own_fp = held
                        new = edited(own, text)
                        new_fp = fingerprint(new)
                        out.append((own_key, len(own), hashlib.sha256(new.encode()).hexdigest(), text_form(own_fp), text_form(new_fp), likeness(own_fp, new_fp), likeness(own_fp, fp)))
                    held = None if copy else (place, key, text, fp)
                if out:
                    i, s, d = pa.int64(), pa.string(), pa.float64()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (i, i, s, s, s, d, d), strict=True)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if held:
            raise RuntimeError("a range has no document after its last")

    return ordered.mapInArrow(pair, schema)
