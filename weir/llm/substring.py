"""Substring dedup (operator 7): Rabin-Karp hashes of all fixed-length word windows.

Each document's words are hashed, and a rolling polynomial over the word hashes
gives every window's hash from prefix sums. The hashes are dealt to parts by a
second, independent polynomial and counted there; a window that also starts in
a document with a smaller id is sent back to its own document, where removed
windows merge into maximal intervals of words.

Entries cross the shuffles as packed arrays, eight bytes a window. Parts and
buckets follow the bytes of the input, so the memory of a task does not grow
with it. Copies within a task's chunk of texts are recognised there, and only the
first is sent to be counted, so that a window found in a third of all documents
comes to its part once a chunk and not once a document. Two windows are taken for
equal if 64 bits and their part agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import chunks, dealt, id_bucket, id_bucket_column, joined, mix, powers, table, text_bytes, word_hashes, words_sql

WINDOW = 50
#: Bytes of text whose windows meet in one part, and that one bucket of documents holds.
PART_BYTES = 8 << 20

_ROLL = np.uint64(0xA24BAED4963EE407 | 1)
_OTHER = np.uint64(0x9FB21C651E98DF25 | 1)
_INVERSES = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_ROLL, _OTHER)}


def rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `width` word hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(_INVERSES[int(base)], n)[: n - width + 1])


def document_windows(data: bytes, offsets: np.ndarray, width: int):
    """Of joined texts: each window's document, its hash, and the number of words of each document."""
    starts, _, hashes = word_hashes(np.frombuffer(data, np.uint8))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    inside = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
    return hashes, doc, inside, counts


def repeated(docs: DataFrame, *, width: int, parts: int, buckets: int) -> DataFrame:
    """Windows to remove: bucket, and packed ids and hashes of the documents in it."""

    def windows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(1)):
                hashes, doc, inside, _ = document_windows(data, offsets, width)
                if len(inside):
                    part = (rolling(hashes, width, _OTHER)[inside] % np.uint64(parts)).astype(np.int32)
                    h, own = rolling(hashes, width, _ROLL)[inside], ids[first + doc[inside]].astype(np.int64)
                    # what has a smaller document here needs no counting: it is spread by its own document
                    order = np.lexsort((own, h))
                    head = np.append(True, h[order][1:] != h[order][:-1])
                    least = np.empty(len(h), np.int64)
                    least[order] = own[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
                    known = own != least
                    part[known] = parts + id_bucket(own[known], parts)
                    yield dealt(part, h, runs=own, names=("part", "hashes", "ids", "lengths"))

    def count(group: pa.Table) -> pa.Table:
        hashes = joined(group["hashes"], np.uint64)
        ids = np.repeat(joined(group["ids"], np.int64), joined(group["lengths"], np.uint32))
        if group["part"][0].as_py() >= parts:
            return pa.Table.from_batches([dealt(id_bucket(ids, buckets), hashes, ids, names=("bucket", "hashes", "ids"))])
        order = np.argsort(hashes)
        hashes, ids = hashes[order], ids[order]
        cut = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        least = np.minimum.reduceat(ids, cut)
        again = ids != np.repeat(least, np.diff(np.append(cut, len(ids))))
        out = dealt(id_bucket(ids[again], buckets), hashes[again], ids[again], names=("bucket", "hashes", "ids"))
        return pa.Table.from_batches([out])

    d = docs.where("id is not null").select("id", "text")
    dealt_out = d.mapInArrow(windows, "part int, hashes binary, ids binary, lengths binary")
    return dealt_out.groupBy("part").applyInArrow(count, "bucket int, hashes binary, ids binary")


def remove_repeats(docs: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text, and the columns named in `carry`.

    A word goes if a window of `width` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. `spans` are the
    maximal runs of removed words as (start, end) word numbers, `kept_text` is
    the rest joined by one blank. Ids are integers. Null and empty texts have no
    words. Rows with a null id neither lose words nor cost others theirs; rows
    that share an id count as one document. Extra columns are left alone. A text
    of any length is read as a whole, within one task. An empty table gives an
    empty table.
    """
    size = text_bytes(docs, text_col)
    parts = max(16, size // part_bytes)
    buckets = parts | 1
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in carry])
    more = [d.schema[f"_keep_{c}"].dataType.simpleString() for c in carry]

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        gone_ids, gone = joined(right["ids"], np.int64), joined(right["hashes"], np.uint64)
        order = np.lexsort((gone, gone_ids))
        gone_ids, gone = gone_ids[order], gone[order]
        n_words, n_removed, spans, kept = [], [], [], []
        for batch in left.combine_chunks().to_batches():
            ids = batch.column("id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(gone_ids, ids), np.searchsorted(gone_ids, ids, side="right")
            high = np.where(known, high, low)
            for first, data, offsets in chunks(batch.column("text")):
                some = (high > low)[first : first + len(offsets) - 1]
                if some.any():
                    hashes, doc, inside, counts = document_windows(data, offsets, width)
                    roll = rolling(hashes, width, _ROLL)[inside]
                    where = np.searchsorted(doc, np.arange(len(offsets)))
                    bound = np.searchsorted(inside, where)
                for i in range(len(offsets) - 1):
                    words = data[offsets[i] : offsets[i + 1]].split()
                    n, runs = len(words), []
                    if some[i]:
                        a, b = bound[i], bound[i + 1]
                        mine = gone[low[first + i] : high[first + i]]
                        at = np.minimum(np.searchsorted(mine, roll[a:b]), len(mine) - 1)
                        edge = np.zeros(n + 1, np.int64)
                        hit = inside[a:b][mine[at] == roll[a:b]] - where[i]
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + width, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).view(np.int8)))
                        runs = [{"start": int(x), "end": int(y)} for x, y in zip(turn[0::2], turn[1::2], strict=True)]
                        words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    spans.append(runs)
                    kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = [left["id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string()), *[left[f"_keep_{c}"] for c in carry]]
        return pa.Table.from_arrays(out, names=["doc_id", "n_words", "n_removed", "spans", "kept_text", *[f"_keep_{c}" for c in carry]])

    marks = repeated(d, width=width, parts=parts, buckets=buckets)
    homes = d.withColumn("bucket", id_bucket_column(F.col("id"), buckets))
    schema = ", ".join(["doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string", *[f"`_keep_{c}` {t}" for c, t in zip(carry, more, strict=True)]])
    out = homes.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(strip, schema)
    return out.select("doc_id", "n_words", "n_removed", "spans", "kept_text", *[F.col(f"_keep_{c}").alias(c) for c in carry])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, {words_sql()} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d),
x AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM x),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + {WINDOW})))) AS gone FROM m WHERE least < doc_id GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
r AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM k),
o AS (SELECT r.doc_id, string_agg(word, ' ' ORDER BY r.i) AS kept FROM r
      LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM g) y ON r.doc_id = y.doc_id AND r.i = y.i WHERE y.i IS NULL GROUP BY r.doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM k LEFT JOIN o ON k.doc_id = o.doc_id
"""
