"""Ranked lexical search (operator 12): Fagin's threshold algorithm over shards of documents.

One reading of the documents makes the index: a row for each shard (a run of
documents of about `SHARD` bytes) holds, for the terms that are asked for, their
postings. Document and term counts over all shards then give every posting its
integer impact. In a shard, a query reads the impact-sorted lists of its terms in
turn, looks each new document up in the forward index for its whole score, and
stops when the threshold (the sum of the last impacts read) lies strictly below
the k-th best score, so documents of equal score are all seen.

A k-th score of any part of the documents is a bound for the whole. One shard of
`FIRST` is searched first; the others start with the bounds found there, so they
stop early and return little. Shards are independent rows of the written index: a
lost task is one shard's search again.

Queries are searched in blocks of at most `ASKED` bytes of text (or one longer
query), each block with an index of its own terms, so what tasks hold of the
queries is bounded at any number of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm.common import materialise, table, word_hashes
from weir.operators.places import running

K = 50
#: Bytes of text, and documents, of one shard; bytes of text of one block of queries.
SHARD, DOCUMENTS, ASKED = 1 << 24, 1 << 16, 1 << 20
#: One shard of so many is searched first.
FIRST = 16
#: Entries of each list that are read in the first turn; every turn reads twice as many.
TURN = 16
#: Term weights are whole thousandths; impacts saturate with the term count and grow with short documents.
WEIGHT, IMPACT, LENGTH_PERCENT, SATURATION = 1000, 1_000_000_000, 50, 20

#: Bytes that end a term (all ASCII but digits and letters), and A-Z as a-z.
_BETWEEN = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def term_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hashes of all terms of a text, in order."""
    return word_hashes(_LOWER[np.frombuffer(text, np.uint8)], _BETWEEN)[2]


def postings(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in terms of all texts, and term (place in the sorted vocabulary), text and count of all postings, by term and text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, _, h = word_hashes(data, _BETWEEN)
    of = np.searchsorted(ends, starts, side="right")
    lengths = np.bincount(of, minlength=len(texts))
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    pairs, n = np.unique(at[known].astype(np.int64) * len(texts) + of[known], return_counts=True)
    return lengths, pairs // len(texts), pairs % len(texts), n


INDEX = "first bigint, docs bigint, length bigint, ids binary, lengths binary, terms binary, places binary, counts binary, terms_of array<int>, df array<bigint>"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def build_index(docs: DataFrame, vocabulary, shard: int = SHARD) -> DataFrame:
    """A row a shard: ids, lengths and postings of its documents as packed arrays, and the counts that add up over shards."""

    def row(ids, texts):
        lengths, terms, places, counts = postings(texts, vocabulary.value)
        of, df = np.unique(terms, return_counts=True)
        values = [ids[0], int((lengths > 0).sum()), int(lengths.sum()), np.array(ids, np.int64).tobytes(), lengths.astype(np.int64).tobytes(), terms.astype(np.int32).tobytes(), places.astype(np.uint16).tobytes(), counts.astype(np.int32).tobytes(), of.astype(np.int32).tolist(), df.tolist()]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=_NAMES)

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= shard or len(ids) == DOCUMENTS:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return docs.mapInArrow(run, INDEX)


def term_weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2.0 * n + 2.0) / (2.0 * df + 1.0)))


class Shard:
    """Impact-sorted lists of each term, and the forward index by document."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, length: int):
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        terms, docs, tf = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["places"], np.uint16), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n) // max(length, 1)
        impact = weights[terms] * ((IMPACT * tf) // (1000 * tf + SATURATION * m[docs]))
        by_impact = np.lexsort((-impact, terms))
        self.lists = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.sorted_docs, self.sorted_impacts = docs[by_impact], impact[by_impact]
        forward = np.argsort(docs, kind="stable")
        self.forward = np.searchsorted(docs[forward], np.arange(len(self.ids) + 1))
        self.forward_terms, self.forward_impacts = terms[forward], impact[forward]
        self.asked = np.zeros(len(weights), bool)
        self.read = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random lookups: the sums of impacts of the terms asked for, of each document."""
        low, size = self.forward[docs], self.forward[docs + 1] - self.forward[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)
        hit = np.where(self.asked[self.forward_terms[at]], self.forward_impacts[at], 0)
        total = np.append(0, np.cumsum(hit))
        return total[ends] - total[ends - size]

    def search(self, terms: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best places and scores above 0, ties to the smaller id; none below `bound`, the k-th best score known so far."""
        low, high = self.lists[terms], self.lists[terms + 1]
        some = high > low
        low, high, terms = low[some], high[some], terms[some]
        self.asked[terms] = True
        seen, depth, turn = np.zeros(len(self.ids), bool), 0, TURN
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(low):
            found = [self.sorted_docs[a + depth : min(a + depth + turn, b)] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a + depth < b]
            depth, turn = depth + turn, turn * 2
            self.read += sum(map(len, found))
            new = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint16)
            new = new[~seen[new]].astype(np.int64)
            seen[new] = True
            got = self.scores(new)
            fine = got >= max(bound, 1)
            best, score = np.concatenate((best, new[fine])), np.concatenate((score, got[fine]))
            order = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[order], score[order]
            left = low + depth < high
            threshold = int(self.sorted_impacts[low[left] + depth - 1].sum())
            kth = max(bound, int(score[-1]) if len(score) == k else 0)
            if not left.any() or threshold < kth:
                break
        self.asked[terms] = False
        return best, score


def searched(index: DataFrame, shared, k: int) -> DataFrame:
    """item, doc_id, score: the best of each shard for every query of the block."""

    def run(batches):
        queries, weights, n, length, bounds = shared.value
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row, weights, n, length)
                items, ids, scores = [], [], []
                for i, terms in enumerate(queries):
                    best, score = shard.search(terms, k, bounds.get(i, 0))
                    items.append(np.full(len(best), i, np.int32))
                    ids.append(shard.ids[best])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (items, ids, scores)], names=["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "places", "counts").mapInArrow(run, "item int, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list, k: int, shard: int) -> DataFrame:
    """item_id, rank, doc_id, score of one block of queries (item_id, list of texts)."""
    spark = docs.sparkSession
    hashes = [np.unique(np.concatenate([term_hashes(t.encode()) for t in texts])) for _, texts in items]
    vocabulary = np.unique(np.concatenate(hashes))
    index = materialise(build_index(docs, spark.sparkContext.broadcast(vocabulary), shard))
    n, length = (v or 0 for v in index.agg(F.sum("docs"), F.sum("length")).first())
    pair = F.explode(F.arrays_zip("terms_of", "df")).alias("p")
    # at most a row for each term of the block
    df = {r.t: r.n for r in index.select(pair).groupBy(F.col("p.terms_of").alias("t")).agg(F.sum("p.df").alias("n")).collect()}
    weights = np.array([term_weight(n, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    queries = [np.searchsorted(vocabulary, h) for h in hashes]
    early = F.pmod(F.xxhash64("first"), F.lit(FIRST)) == 0
    share = lambda bounds: spark.sparkContext.broadcast((queries, weights, n, length, bounds))
    first = materialise(ranked(searched(index.where(early), share({}), k), k))
    bounds = {r.item: r.score for r in first.where(F.col("rank") == k).select("item", "score").collect()}
    rest = searched(index.where(~early), share(bounds), k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id bigint")
    best = ranked(first.drop("rank").unionByName(rest), k)
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item, ties to the smaller id.

    Terms are runs of digits, letters and all characters beyond ASCII, with only
    A-Z lower-cased. Documents with a null id take no part at all; a null or
    empty text has no terms. Documents that share an id are ranked each. Items
    that share an id are one query of all their terms; null items take no part;
    an item without terms or matches has no row. Terms are told apart by 64-bit
    hashes. Whole texts of any length, extra columns are left alone, empty tables
    give an empty table.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    q = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item_id is not null").distinct()
    if (q.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > asked:
        # an item's texts lie side by side: those of one id are in one block, or the id is the first of the next
        size = q.groupBy("item_id").agg(F.sum(F.octet_length("text") + 16).alias("bytes"))
        q = q.join(running(size, "item_id", upto="bytes").select("item_id", F.floor((F.col("upto") - F.col("bytes")) / asked).alias("block")), "item_id")
        q = materialise(q)
        blocks = [r.block for r in q.select("block").distinct().orderBy("block").collect()]
    else:
        q, blocks = q.withColumn("block", F.lit(0)), [0]
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in blocks:
        texts: dict = {}
        for r in q.where(F.col("block") == b).orderBy("item_id", "text").collect():  # about `asked` bytes
            texts.setdefault(r.item_id, []).append(r.text)
        if texts:
            out = out.unionByName(search_block(d, list(texts.items()), k, shard))
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS.replace("list_distinct", "")} AS terms FROM documents WHERE doc_id IS NOT NULL),
figures AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM t),
lengths AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS size FROM t),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor({WEIGHT} * ln((2.0 * n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
         * (({IMPACT} * tf) // (1000 * tf + {SATURATION} * (100 - {LENGTH_PERCENT} + ({LENGTH_PERCENT} * size * n) // l)))) AS BIGINT) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), figures GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
