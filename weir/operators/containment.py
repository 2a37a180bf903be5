"""Which needles lie in which texts: an inverted index of each needle's rarest gram, an equality join, then verification.

A needle's anchor is, of its runs of `GRAM` bytes (of all its bytes, if it is
shorter), the one that fewest needles have, by a table of counts. The anchors are an index of rows; no
needle is ever in the driver or in a task's closure. What the readers of the
texts get is a table of one byte a bucket, of bounded size and put together in
blocks by Spark: it says whether an anchor may have that hash, and how much text
around it its needles need.

Each text is read once, for any number of needles: all its grams are numbers (eight
bytes each), so the table is asked for all of them at once. Where two buckets both
say yes, the gram and the text around it go on as a row, equal ones once a batch.
Rows meet the index on (label, length, gram), which gives the ways their needles
lie around an anchor (offset and length, not the needles themselves), and each way
gives one piece of text. Distinct pieces meet the needles by equality. A gram that
very many texts hold meets its ways by a broadcast of the hot grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.places import hot_join, materialise

#: Bytes of a gram, fitting one 64-bit number; buckets of the table for each needle, and its least and greatest size (64 MB).
GRAM, SPARSE, LEAST, MOST = 8, 128, 1 << 16, 1 << 26
#: The greatest size of the table that counts the needles' grams (4 MB).
COUNTED = 1 << 22
#: Buckets of one block of a table.
BLOCK = 1 << 16
#: Bytes of texts that are searched at once, and of surroundings that are held before they go on.
READ, HELD = 1 << 20, 1 << 22
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The number of the `size` bytes at each place of a buffer."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * i)
    return out


def buckets(values: np.ndarray, size: int, of: int) -> list[np.ndarray]:
    """The two buckets of each gram in a table of `of` (a power of two)."""
    shift = np.uint64(64 - (of.bit_length() - 1))
    x = values ^ np.uint64(size * 0x0101010101010101)
    return [((x ^ (x >> np.uint64(29))) * m) >> shift for m in _MIX]


def reach(n: np.ndarray) -> np.ndarray:
    """A class of at most 16 that bounds n bytes: 0, then those up to 2^(k - 1) * 16, the last without bound."""
    out = np.zeros(len(n), np.int64)
    for k in range(1, 15):
        out[n > (0 if k == 1 else 16 << (k - 2))] = k
    return out


def bound(k: int) -> int:
    return 0 if k == 0 else 16 << (k - 1) if k < 14 else 1 << 40


def assembled(codes: DataFrame, of: int) -> np.ndarray:
    """A table of one byte a bucket, from rows (bucket, code), each bucket once: Spark packs blocks, the driver puts them side by side."""

    def block(t: pa.Table) -> pa.Table:
        out, at = np.zeros(BLOCK, np.uint8), t["bucket"].to_numpy()
        out[at % BLOCK] = t["code"].to_numpy()
        return pa.table({"block": pa.array(at[:1] // BLOCK), "codes": pa.array([out.tobytes()], pa.binary())})

    blocks = codes.withColumn("block", F.floor(F.col("bucket") / BLOCK)).groupBy("block").applyInArrow(block, "block bigint, codes binary")
    table = np.zeros(of, np.uint8)
    for r in blocks.toLocalIterator():  # blocks of 64 KB, 64 MB at most
        table[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.codes, np.uint8)
    return table


def table_size(wanted: int) -> int:
    of = LEAST
    while of < min(MOST, wanted):
        of *= 2
    return of


def needle_grams(needles: list[bytes]):
    """For each length of grams that needles have: it, the grams, and of each its needle and its place there."""
    lengths = np.array([len(n) for n in needles], np.int64)
    data = np.frombuffer(b"".join(needles), np.uint8)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    sizes = np.minimum(lengths, GRAM)
    for s in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == s)
        count = lengths[mine] - s + 1
        of = np.repeat(mine, count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        yield s, grams(data, s)[starts[of] + at], of, at


def anchors(needles: DataFrame) -> DataFrame:
    """label, needle, size, gram, at, bytes: of each distinct needle the gram that fewest needles have, the first of equals.

    How often a gram is had is counted in a table of buckets; grams that share
    one may be taken for more frequent than they are, which changes no result.
    """
    spark = needles.sparkSession
    of = min(COUNTED, table_size(4 * (needles.agg(F.sum(F.octet_length("needle"))).first()[0] or 0)))

    def count(batches):
        for b in batches:
            for s, values, _, _ in needle_grams(b.column(1).cast(pa.binary()).to_pylist()):
                at, n = np.unique(buckets(values, s, of)[0].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["bucket", "n"])

    # sixteen classes for each doubling
    counted = needles.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.least(F.lit(255), F.round(16 * F.log2(F.sum("n"))) + 1).cast("int").alias("code"))
    often = spark.sparkContext.broadcast(assembled(counted, of))

    def choose(batches):
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for s, values, needle, at in needle_grams(texts):
                codes = often.value[buckets(values, s, of)[0]]
                order = np.lexsort((at, codes, needle))
                best = order[np.flatnonzero(np.diff(needle[order], prepend=-1))]
                which = needle[best].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in which], pa.string()), pa.array([texts[i] for i in which], pa.binary()), pa.array(np.full(len(best), s, np.int32)), pa.array(values[best].view(np.int64)),
                    pa.array(at[best].astype(np.int32)), pa.array([len(texts[i]) for i in which], pa.int32()),
                ], names=["label", "needle", "size", "gram", "at", "bytes"])

    return needles.mapInArrow(choose, "label string, needle binary, size int, gram bigint, at int, bytes int")


def bucket_table(index: DataFrame, of: int) -> np.ndarray:
    """One byte a bucket: 0, or 1 more than the classes of reach before and (times 15) behind an anchor, the greatest of all in it."""

    def run(batches):
        for b in batches:
            gram, size = b.column("gram").to_numpy().view(np.uint64), b.column("size").to_numpy()
            before, behind = reach(b.column("before").to_numpy()), reach(b.column("behind").to_numpy())
            for s in np.unique(size).tolist():
                mine = size == s
                for at in buckets(gram[mine], s, of):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(before[mine]), pa.array(behind[mine])], names=["bucket", "before", "behind"])

    ways = index.groupBy("size", "gram").agg(F.max(F.col("at").cast("bigint")).alias("before"), F.max((F.col("bytes") - F.col("at") - F.col("size")).cast("bigint")).alias("behind"))
    each = ways.mapInArrow(run, "bucket bigint, before bigint, behind bigint").groupBy("bucket").agg((1 + F.max("before") + 15 * F.max("behind")).cast("int").alias("code"))
    return assembled(each, of)


def surroundings(texts: DataFrame, keys: tuple[str, ...], table, sizes: list[int]) -> DataFrame:
    """keys, label, size, gram, before, behind: each place of a text that the table lets pass, with the text around it."""
    fields = [texts.schema[k] for k in keys]
    reach_of = np.array([bound(k) for k in range(15)], np.int64)

    def found(data: bytes, starts: np.ndarray):
        """Text, size, gram and both sides of all places that pass in joined texts."""
        codes, of = table.value, len(table.value)
        bytes_ = np.frombuffer(data, np.uint8)
        ends = np.append(starts[1:], len(data))
        # a long text is searched a part at a time
        for s, part in ((s, p) for s in sizes for p in range(0, len(data), READ)):
            values = grams(bytes_[part : part + READ + s - 1], s)
            a, b = buckets(values, s, of)
            first, second = codes[a], codes[b]
            place = np.flatnonzero((first > 0) & (second > 0))
            if not len(place):
                continue
            at = place + part
            text = np.searchsorted(starts, at, side="right") - 1
            # not across the end of a text
            inside = at + s <= ends[text]
            place, at, text = place[inside], at[inside], text[inside]
            x, y = first[place].astype(np.int64) - 1, second[place].astype(np.int64) - 1
            low = np.maximum(starts[text], at - np.minimum(reach_of[x % 15], reach_of[y % 15]))
            high = np.minimum(ends[text], at + s + np.minimum(reach_of[x // 15], reach_of[y // 15]))
            for t, v, i, p, q in zip(text.tolist(), values[place].view(np.int64).tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True):
                yield t, s, v, data[p:i], data[i:q]

    def sent(seen, types) -> pa.RecordBatch:
        kinds = [*types, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(zip(*seen, strict=True), kinds, strict=True)], names=[*keys, "label", "size", "gram", "before", "behind"])

    def run(batches):
        for b in batches:
            types, seen, held = b.schema.types[:-1], set(), 0
            sizes_ = pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(sizes_)
            first = 0
            while first < b.num_rows:
                # only the texts that are searched at once are taken out of the batch
                last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes_[first] + READ)) + 1)
                part = b.slice(first, last - first)
                columns = [c.to_pylist() for c in part.columns[:-1]]
                texts_ = part.column(b.num_columns - 1).cast(pa.large_binary()).to_pylist()
                starts = np.append(0, np.cumsum([len(t) for t in texts_[:-1]])).astype(np.int64)
                for t, s, v, x, y in found(b"".join(texts_), starts):
                    # equal surroundings of equal keys once
                    row = (*(c[t] for c in columns), s, v, x, y)
                    if row not in seen:
                        seen.add(row)
                        held += len(x) + len(y) + 256
                    if held > HELD:
                        yield sent(seen, types)
                        seen, held = set(), 0
                first = last
            if seen:
                yield sent(seen, types)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "label string, size int, gram bigint, before binary, behind binary"])
    return texts.mapInArrow(run, schema)


def contained(rows: DataFrame, needles: DataFrame, *, label: str = "label", fields: tuple[str, ...], keys: tuple[str, ...] = (), sparse: int = SPARSE) -> DataFrame:
    """keys, label, needle: the needles (label, needle) that lie in a field of some row of their label; exact.

    Null and empty texts, needles and labels take no part; needles listed twice
    are one. Bytes are compared, so letters must be equal in case and accent.
    Key columns may be null.
    """
    spark = rows.sparkSession
    wanted = needles.select(F.col(label).cast("string").alias("label"), F.col("needle").cast("string").alias("needle")).where("label is not null and length(needle) > 0").distinct()
    index = materialise(anchors(wanted))
    figures = index.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # at most GRAM sizes
    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "label string, needle string"])
    if not figures.n:
        return spark.createDataFrame([], schema)
    of = table_size(sparse * figures.n)
    table = spark.sparkContext.broadcast(bucket_table(index, of))
    texts = rows.select(*keys, F.col(label).cast("string").alias("label"), F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text")).where("label is not null and length(text) > 0")
    places = materialise(surroundings(texts, keys, table, list(figures.sizes)).withColumn("_key", F.struct("label", "size", "gram")).drop("label", "size", "gram"))
    often = places.groupBy("_key").agg(F.count("*").alias("_n"))
    total = places.count()
    # how needles lie around an anchor: as many rows as lengths and offsets differ, however many needles there are
    ways = index.groupBy(F.struct("label", "size", "gram").alias("_key")).agg(F.collect_set(F.struct("at", "bytes")).alias("_ways"))
    met = hot_join(places, ways.join(often, "_key"), "_key", "_n", total).select(*keys, F.col("_key.label").alias("label"), "before", "behind", F.explode("_ways").alias("_w"))
    fits = (F.octet_length("before") >= F.col("_w.at")) & (F.octet_length("behind") >= F.col("_w.bytes") - F.col("_w.at"))
    start = F.octet_length("before") - F.col("_w.at") + 1
    piece = F.substr(F.concat("before", "behind"), start, F.col("_w.bytes"))
    pieces = met.where(fits).select(*keys, "label", piece.alias("needle")).distinct()
    found = pieces.join(index.select("label", "needle"), ["label", "needle"], "left_semi")
    return found.select(*keys, "label", F.col("needle").cast("string").alias("needle"))
