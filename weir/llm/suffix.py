"""Suffix-array dedup (operator 8): linear construction by grouping.

`suffix_array` sorts suffixes in two linear steps (Baier 2016). Suffixes are
grouped by their longest Lyndon prefix: groups are processed in descending
order, and each member tells its previous smaller position, which so learns the
next factor of its own prefix and moves to a new group. Then the suffixes are
emitted in ascending order: each gives their place in their group to those whose
Lyndon prefix it follows. No renaming, no recursion.

No machine can sort the suffixes of a whole corpus, so texts are first cut where
equal strings are cut alike. Each string of `length` bytes has an anchor, the
k-gram of least hash in it (the leftmost of those); equal strings have equal
anchors at equal places. A run of strings with the same anchor is a segment.

1. Anchors are dealt by hash, packed, with a hash of their segment. An anchor
   that occurs once repeats nothing. Equal segments repeat all but the first;
   of those in one chunk of texts only the first is dealt by its anchor, the
   others by their documents, so a segment in a third of all documents comes to
   its anchor's part once a chunk (1 MB of text).
2. Where an anchor has several different segments, the bytes of one of each are
   sent to the anchor's part and their suffixes are sorted; neighbours that agree
   in `length` bytes are one string, and all but its first occurrence go.
   Anchors with very many different segments (a passage that thousands of
   documents quote in different surroundings) are dealt more finely, by the
   bytes common to eight neighbouring strings.
3. The intervals return to their documents, which are hashed into buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import _BASE, _INVERSE, chunks, dealt, id_bucket, id_bucket_column, joined, materialise, mix, powers, table, text_bytes

LENGTH = 100
GRAM = 32
PART_BYTES = 8 << 20
#: An anchor with more different segments is dealt by finer keys, of so many strings each.
HOT, FINE = 512, 8
#: Bytes of segments whose suffixes are sorted together.
SORTED = 1 << 15
#: Up to so many document ids are sent to every executor (8 MB).
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 20
#: Parts of segments to be sorted, for each part of anchors.
FINER = 8


def suffix_array(text) -> list[int]:
    """The order of all suffixes of a sequence of comparable symbols; a suffix sorts after its prefixes."""
    n = len(text)
    start: dict = {}
    for i, c in enumerate(text):
        start.setdefault(c, []).append(i)
    members, length, below, above, group = [], [], [], [], [0] * n
    for g, c in enumerate(sorted(start)):
        members.append(start[c])
        length.append(1)
        below.append(g - 1)
        above.append(g + 1)
        for i in start[c]:
            group[i] = g
    g = len(members) - 1
    if g >= 0:
        above[g] = -1
    left, done, final = list(range(-1, n - 1)), bytearray(n), []
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            final.append(g)
            if len(own) == 1:
                # the common case: one member tells one position once
                i = own[0]
                done[i] = 1
                p = left[i]
                while p >= 0 and done[p]:
                    p = left[p]
                left[i] = p
                if p >= 0:
                    h = group[p]
                    new, after = len(members), above[h]
                    members.append([p])
                    length.append(length[h] + length[g])
                    below.append(h)
                    above.append(after)
                    above[h] = new
                    if after >= 0:
                        below[after] = new
                    group[p] = new
                g = below[g]
                continue
            for i in own:
                done[i] = 1
            told: dict = {}
            for i in own:
                p = left[i]
                while p >= 0 and done[p]:
                    p = left[p]
                left[i] = p
                if p >= 0:
                    told[p] = told.get(p, 0) + 1
            if told:
                moved: dict = {}
                for p, times in told.items():
                    moved.setdefault((group[p], times), []).append(p)
                for h, times in sorted(moved, reverse=True):
                    # directly above h; the next to come of h, with fewer times, goes below this one
                    new, after = len(members), above[h]
                    members.append(moved[h, times])
                    length.append(length[h] + times * length[g])
                    below.append(h)
                    above.append(after)
                    above[h] = new
                    if after >= 0:
                        below[after] = new
                    for p in moved[h, times]:
                        group[p] = new
        g = below[g]
    place, at = {}, 1
    for g in reversed(final):
        place[g] = at
        at += len(members[g])
    follows: list = [None] * (n + 1)
    for j in range(n):
        k = j + length[group[j]]
        if follows[k] is None:
            follows[k] = [j]
        else:
            follows[k].append(j)
    order = [n] * (n + 1)
    for r in range(n + 1):
        for j in follows[order[r]] or ():
            g = group[j]
            order[place[g]] = j
            place[g] += 1
    return order[1:]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Of joined texts, the runs of strings with one anchor.

    doc: the text's number; first, last: where the run's first and last string
    start; anchor: where its anchor starts; hash: of the anchor; segment: of all
    the run's bytes and the anchor's place in them; nth: its number among the
    runs of the same text with the same hash.
    """
    x = np.frombuffer(data, np.uint8)
    lengths = np.diff(offsets) - 1
    counts = np.maximum(lengths - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return {k: np.zeros(0, np.uint64 if k in ("hash", "segment") else np.int64) for k in ("doc", "first", "last", "anchor", "hash", "segment", "nth")}
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(x) + 1)[:-1], out=total[1:])
    back = powers(_INVERSE, len(x) + 1)
    h = mix((total[gram:] - total[:-gram]) * back[: len(x) - gram + 1])
    # hash and place share a word; the place takes as many bits as this chunk needs
    bits = np.uint64(max(28, int(len(h)).bit_length()))
    least = sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[doc]
    anchor = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    end = np.append(new[1:], len(anchor)) - 1
    first, last, anchor, doc = starts[new], starts[end], anchor[new], doc[new]
    hashes = h[anchor]
    place = (anchor - first).astype(np.uint64) + ((last - first).astype(np.uint64) << np.uint64(20))
    segment = mix((total[last + length] - total[first]) * back[first] + mix(place + np.uint64(1)))
    order = np.lexsort((hashes, doc))
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
    at = np.flatnonzero(fresh)
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    return {"doc": doc, "first": first, "last": last, "anchor": anchor, "hash": hashes, "segment": segment, "nth": nth}


def address(ids: np.ndarray, hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def marks(docs: DataFrame, length: int, gram: int, parts: int, buckets: int, hot: int = HOT) -> DataFrame:
    """Step 1: bucket, packed ids, addresses and kinds of runs.

    Kind 0: the run's strings all occur earlier; 1: its bytes are wanted; 2: its
    bytes are wanted, dealt finely.
    """

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(1), CHUNK):
                s = segments(data, offsets, length, gram)
                if not len(s["doc"]):
                    continue
                own = ids[first + s["doc"]].astype(np.int64)
                # only the first of equal segments here needs to be counted: the others go to parts of their own documents
                order = np.lexsort((s["nth"], own, s["segment"], s["hash"]))
                h, g, i, n = s["hash"][order], s["segment"][order], own[order], s["nth"][order]
                head = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
                of = np.flatnonzero(head)[np.cumsum(head) - 1]
                same = ~head & (i == i[of]) & (n == n[of])
                part = ((h >> np.uint64(7)) % np.uint64(parts)).astype(np.int32)
                part = np.where(head, part, parts + id_bucket(i, parts))
                # in the order of the documents, so that ids come in runs
                at = np.lexsort((n, i))
                at = at[~same[at]]
                yield dealt(part[at], h[at], g[at], n[at].astype(np.uint32), runs=i[at], names=("part", "hashes", "segments", "nths", "ids", "lengths"))

    def told(ids, where, kind):
        return pa.Table.from_batches([dealt(id_bucket(ids, buckets), ids, where, kind, names=("bucket", "ids", "places", "kinds"))])

    def count(t: pa.Table) -> pa.Table:
        hashes, segment, nth = joined(t["hashes"], np.uint64), joined(t["segments"], np.uint64), joined(t["nths"], np.uint32).astype(np.int64)
        ids = np.repeat(joined(t["ids"], np.int64), joined(t["lengths"], np.uint32))
        if t["part"][0].as_py() >= parts:
            return told(ids, address(ids, hashes, nth), np.zeros(len(ids), np.uint8))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order]
        cut = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        many = np.diff(np.append(cut, len(same)))
        order = order[np.repeat(many > 1, many)]
        # rows that share an id are one document: what agrees in all four is one run
        order = order[np.lexsort((nth[order], ids[order], segment[order], hashes[order]))]
        hashes, segment, ids, nth = hashes[order], segment[order], ids[order], nth[order]
        head = np.append(True, (hashes[1:] != hashes[:-1]) | (segment[1:] != segment[:-1]))[: len(ids)]
        again = np.append(True, head[1:] | (ids[1:] != ids[:-1]) | (nth[1:] != nth[:-1]))[: len(ids)]
        cut = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(ids)])
        different = np.repeat(np.add.reduceat(head.astype(np.int64), cut), np.diff(np.append(cut, len(ids)))) if len(ids) else np.zeros(0, np.int64)
        kind = np.where(head, np.where(different > hot, 2, 1), 0).astype(np.uint8)
        some = again & (~head | (different > 1))
        return told(ids[some], address(ids[some], hashes[some], nth[some]), kind[some])

    found = docs.where("id is not null").select("id", "text").mapInArrow(scan, "part int, hashes binary, segments binary, nths binary, ids binary, lengths binary")
    return found.groupBy("part").applyInArrow(count, "bucket int, ids binary, places binary, kinds binary")


_RUNS = "kind int, key int, ids binary, starts binary, ends binary, lefts binary, keys binary, sizes binary, bytes binary"


def runs_of(homes: DataFrame, marked: DataFrame, length: int, gram: int, parts: int, buckets: int) -> DataFrame:
    """Step 2, at the documents: rows of kind 0 with removed intervals by bucket, and of kind 1 with segments by part.

    starts and ends are byte numbers in the document; of a segment they bound its
    strings' starts, and `lefts` is the place of the anchor in its bytes.
    """

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        place, kind = joined(right["places"], np.uint64), joined(right["kinds"], np.uint8)
        order = np.argsort(place)
        place, kind = place[order], kind[order]
        out = []
        if len(place):
            for batch in left.combine_chunks().to_batches():
                ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for first, data, offsets in chunks(batch.column("text"), CHUNK):
                    s = segments(data, offsets, length, gram)
                    own = ids[first + s["doc"]]
                    where = address(own, s["hash"], s["nth"])
                    at = np.minimum(np.searchsorted(place, where), len(place) - 1)
                    hit = place[at] == where
                    what = np.where(hit, kind[at], 255)
                    base = offsets[s["doc"]]
                    gone = what == 0
                    if gone.any():
                        out.append(intervals(own[gone], (s["first"] - base)[gone], (s["last"] - base)[gone] + length, buckets))
                    wanted = np.flatnonzero((what == 1) | (what == 2))
                    if len(wanted):
                        rows = []
                        for i in wanted.tolist():
                            a, b, p, o, h = int(s["first"][i]), int(s["last"][i]), int(s["anchor"][i]), int(base[i]), int(s["hash"][i])
                            if what[i] == 1:
                                rows.append((h, int(own[i]), a - o, b - o, data[a : b + length], p - a))
                                continue
                            # the strings that start FINE j .. FINE j + FINE - 1 before the anchor share these bytes
                            for j in range((p - b) // FINE, (p - a) // FINE + 1):
                                low, high = max(a, p - FINE * j - FINE + 1), min(b, p - FINE * j)
                                core = data[p - FINE * j : p - FINE * j - FINE + 1 + length]
                                rows.append((int(mix(np.uint64([h ^ (hash_bytes(core) + j & (1 << 64) - 1)]))[0]), int(own[i]), low - o, high - o, data[low : high + length], p - low))
                        out.append(packed(rows, parts))
        return pa.Table.from_batches(out, schema=schema) if out else schema.empty_table()

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int32()), *[(n, pa.binary()) for n in ("ids", "starts", "ends", "lefts", "keys", "sizes", "bytes")]])

    def packed(rows, parts):
        h = np.array([r[0] for r in rows], np.uint64)
        part = ((h >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True):
            some = [rows[i] for i in order[a:b]]
            out.append({
                "kind": 1, "key": int(part[order[a]]), "ids": np.array([r[1] for r in some], np.int64).tobytes(), "starts": np.array([r[2] for r in some], np.int64).tobytes(),
                "ends": np.array([r[3] for r in some], np.int64).tobytes(), "lefts": np.array([r[5] for r in some], np.int64).tobytes(), "keys": np.array([r[0] for r in some], np.uint64).tobytes(),
                "sizes": np.array([len(r[4]) for r in some], np.int64).tobytes(), "bytes": b"".join(r[4] for r in some),
            })
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def intervals(ids, starts, ends, buckets):
        # runs of one text follow each other: those that touch become one
        new = np.append(True, (ids[1:] != ids[:-1]) | (starts[1:] > ends[:-1]))
        at = np.flatnonzero(new)
        ids, starts, ends = ids[at], starts[at], ends[np.append(at[1:], len(ends)) - 1]
        b = dealt(id_bucket(ids, buckets), ids, starts, ends, names=("key", "ids", "starts", "ends"))
        n = b.num_rows
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *b.columns, *[pa.nulls(n, pa.binary())] * 4], schema=schema)

    return homes.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(take, _RUNS)


def hash_bytes(data: bytes) -> int:
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(mix((x * powers(_BASE, len(x))).sum(keepdims=True))[0])


def shared(group: list[tuple[int, int, int, bytes, int]], length: int) -> list[tuple[int, int, int, bytes]]:
    """The parts of an anchor's segments (id, first, last, bytes, anchor) that can hold equal strings.

    FINE neighbouring strings have common bytes; where no other segment has the
    same there, none of these strings occurs twice and its suffixes need no sorting.
    """
    seen: dict = {}
    for k, (_, first, last, data, place) in enumerate(group):
        for j in range((place - (last - first)) // FINE, place // FINE + 1):
            core = (j, data[place - FINE * j : place - FINE * j - FINE + 1 + length])
            seen[core] = -1 if core in seen else k
    alone = {(k, j) for (j, _), k in seen.items() if k >= 0}
    out = []
    for k, (i, first, last, data, place) in enumerate(group):
        low = high = None
        for j in range(place // FINE, (place - (last - first)) // FINE - 1, -1):
            if (k, j) in alone:
                if low is not None:
                    out.append((i, first + low, first + high, data[low : high + length]))
                    low = None
                continue
            if low is None:
                low = max(0, place - FINE * j - FINE + 1)
            high = min(last - first, place - FINE * j)
        if low is not None:
            out.append((i, first + low, first + high, data[low : high + length]))
    return out


def repeats(ids, starts: np.ndarray, ends: np.ndarray, pieces, length: int) -> list[tuple[int, int]]:
    """(segment, string) numbers of the strings of segments that occur earlier, in one batch of suffixes."""
    text, origin = [], []
    for k, piece in enumerate(pieces):
        origin.append(len(text))
        text.extend(piece)
        text.append(256 + k)
    owner = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
    inside = np.arange(len(text)) - np.array(origin)[owner]
    order = np.array(suffix_array(text))
    order = order[inside[order] <= (ends - starts)[owner[order]]]
    flat = b"".join(p + b"\0" for p in pieces)
    out, run = [], [int(order[0])] if len(order) else []
    value = flat[run[0] : run[0] + length] if run else b""

    def close():
        if len(run) > 1:
            best = min(run, key=lambda i: (ids[owner[i]], starts[owner[i]] + inside[i]))
            out.extend((int(owner[i]), int(inside[i])) for i in run if i != best)

    for i in order[1:].tolist():
        now = flat[i : i + length]
        if now == value:
            run.append(i)
        else:
            close()
            run, value = [i], now
    close()
    return out


def sorted_parts(found: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 2, at the anchors: bucket, ids, starts, ends of the intervals that suffix sorting removes."""

    def run(t: pa.Table) -> pa.Table:
        ids, starts, ends, lefts = (joined(t[c], np.int64) for c in ("ids", "starts", "ends", "lefts"))
        keys, sizes = joined(t["keys"], np.uint64), joined(t["sizes"], np.int64)
        data = b"".join(t["bytes"].to_pylist())
        at = np.cumsum(sizes) - sizes
        order = np.lexsort((starts, ids, keys))
        gone, batch, held = [], [], 0

        def flush():
            columns = list(zip(*batch, strict=True))
            for k, s in repeats(columns[0], np.array(columns[1]), np.array(columns[2]), columns[3], length):
                gone.append((columns[0][k], columns[1][k] + s))

        cut = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else []
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True) if len(order) else ():
            if b - a > 1:
                some = shared([(int(ids[i]), int(starts[i]), int(ends[i]), data[at[i] : at[i] + sizes[i]], int(lefts[i])) for i in order[a:b]], length)
                batch += some
                held += sum(len(x[3]) for x in some)
            if held >= SORTED:
                flush()
                batch, held = [], 0
        if batch:
            flush()
        gone.sort()
        x = np.array([g[0] for g in gone], np.int64)
        y = np.array([g[1] for g in gone], np.int64)
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1] + 1))[: len(x)]
        head = np.flatnonzero(new)
        last = y[np.append(head[1:], len(y)) - 1] if len(y) else y
        b = dealt(id_bucket(x[head], buckets), x[head], y[head], last + length, names=("bucket", "ids", "starts", "ends"))
        return pa.Table.from_batches([b])

    return found.where("kind = 1").groupBy("key").applyInArrow(run, "bucket int, ids binary, starts binary, ends binary")


def divided(homes: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with an id among the packed ones, and the others; all and None where the ids are too many to broadcast.

    Only documents that have something to be compared or removed need to move.
    """

    def unique(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(joined(batch.column(0), np.int64)))], names=["id"])

    ids = materialise(packed.where("ids is not null").select("ids").mapInArrow(unique, "id bigint").distinct())
    if ids.count() > BROADCAST_IDS:
        return homes, None
    ids = F.broadcast(ids)
    return homes.join(ids, "id", "left_semi"), homes.join(ids, "id", "left_anti")


def remove_repeated_bytes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept (binary).

    A byte of the UTF-8 text goes if a string of `length` bytes that covers it
    also starts earlier: in a document with a smaller id, or earlier in the same
    one. `spans` are the maximal removed runs as (start, end) byte numbers. Ids
    are integers; null and empty texts have no bytes. Rows with a null id
    neither lose bytes nor cost others theirs; rows that share an id are judged
    alike, as one document. Extra columns are left alone. A text of any length
    is read as a whole, within one task. An empty table gives an empty table.
    """
    if not 0 < gram <= length:
        raise ValueError("an anchor must fit into a string")
    parts = max(16, text_bytes(docs, text_col) // part_bytes)
    buckets = parts | 1
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    homes = d.withColumn("bucket", id_bucket_column(F.col("id"), buckets))
    marked = materialise(marks(d, length, gram, parts, buckets, hot))
    concerned, _ = divided(homes.where("id is not null"), marked)
    # several small parts a task, so that tasks are even
    found = materialise(runs_of(concerned, marked, length, gram, FINER * parts, buckets))
    gone = materialise(found.where("kind = 0").select(F.col("key").alias("bucket"), "ids", "starts", "ends").unionByName(sorted_parts(found, length, buckets)))
    cut, whole = divided(homes, gone)

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, a, b = (joined(right[c], np.int64) for c in ("ids", "starts", "ends"))
        order = np.lexsort((a, ids))
        ids, a, b = ids[order], a[order], b[order]
        own = left["id"].to_pylist()
        n_bytes, n_removed, spans, kept = [], [], [], []
        for i, text in zip(own, left["text"].cast(pa.large_binary()).to_pylist(), strict=True):
            text = text or b""
            low, high = (np.searchsorted(ids, i), np.searchsorted(ids, i, side="right")) if i is not None else (0, 0)
            runs: list = []
            for x, y in zip(a[low:high].tolist(), b[low:high].tolist(), strict=True):
                x, y = min(x, len(text)), min(y, len(text))
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                elif x < y:
                    runs.append([x, y])
            at, rest = 0, []
            for x, y in runs:
                rest.append(text[at:x])
                at = y
            rest.append(text[at:])
            n_bytes.append(len(text))
            n_removed.append(sum(y - x for x, y in runs))
            spans.append([{"start": x, "end": y} for x, y in runs])
            kept.append(b"".join(rest))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays([left["id"].combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    out = cut.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(strip, schema)
    if whole is None:
        return out
    none = F.lit(0).cast("bigint")
    text = F.coalesce("text", F.lit(""))
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.unionByName(whole.select(F.col("id").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), none.alias("n_removed"), spans.alias("spans"), text.cast("binary").alias("kept")))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
