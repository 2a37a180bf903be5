"""Packing (operator 9): sum-of-squares online packing of tokenised documents.

Every document is tokenised where it lies, ended with one end id and cut into
full windows of `capacity` tokens and one rest. A full window is a sequence of
its own. The rests are placed online: each goes to the fill level for which the
sum over levels of squared counts of partially filled windows grows least
(Csirik et al., the sum-of-squares algorithm); counts live in one level array.

When a group's documents are placed, its emptiest open windows are dissolved:
their pieces fill the gaps of the fullest ones, and a piece too large for a gap is
cut at a multiple of `grain` tokens. So about one window a group stays open, and
others lack less than `grain` tokens.

Scale: texts are never shuffled; a piece is a few numbers. A rest carries the
checksums of its beginnings at every `grain` tokens, from which those of any cut
part follow without its tokens. Pieces are dealt to groups of about
`group_documents` documents by a hash, and each group is packed on its own, so
nothing depends on one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
GROUP_DOCUMENTS = 32768
#: Rests are cut at multiples of this.
GRAIN = 64

#: The pre-tokenisation of the vocabulary with possessive quantifiers: the same
#: pieces as its published pattern, found without backtracking.
FAST_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict = {}


def encoder(path: str, ranks_path: str | None):
    """text -> numpy uint32 ids, as `tokenizers` gives them for the file `path`.

    With `ranks_path` (the same vocabulary as ranks) the ids come from tiktoken,
    which is several times faster; a text that its regular expressions refuse
    or that contains an added token goes to `tokenizers`. Tests hold both
    against each other.
    """
    key = (path, ranks_path)
    if key in _encoders:
        return _encoders[key]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    encode = by_tokenizers
    if ranks_path:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("packing", pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(t in text for t in added):
                return by_tokenizers(text)
            try:
                return np.array(fast.encode_ordinary(text), dtype="<u4")
            except (ValueError, RuntimeError):
                return by_tokenizers(text)

    _encoders[key] = encode
    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


_ZEROS = bytes(4 * 65536)


def checksums(raw: bytes, grain: int, capacity: int) -> tuple[int, list[int]]:
    """crc32 of a piece's packed ids, and those of its beginnings at every `grain` ids; none of a full window, which is never cut."""
    if len(raw) == 4 * capacity:
        return zlib.crc32(raw), []
    crc, marks = 0, []
    for at in range(0, len(raw), 4 * grain):
        if at:
            marks.append(crc)
        crc = zlib.crc32(raw[at : at + 4 * grain], crc)
    return crc, marks


def crc_after(whole: int, beginning: int, n: int) -> int:
    """crc32 of the last n ids of a piece, from those of the piece and of what comes before: crc32 is linear."""
    shifted = 0
    while n > 0:
        zeros = _ZEROS[: 4 * n]
        shifted = zlib.crc32(zeros, beginning) ^ zlib.crc32(zeros)
        beginning, n = shifted, n - len(zeros) // 4
    return whole ^ shifted


def token_pieces(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    ranks: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    grain: int = GRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, start, length, ids_crc32, doc_tokens, marks (and ids).

    `marks` are the checksums of a rest's first grain, 2 grain, ... tokens. Null
    texts are empty: one piece with the end id alone. Equal rows give equal
    pieces, each of them kept. A text of any length is tokenised as a whole.
    """
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, marks array<bigint>" + ", ids array<bigint>" * keep_ids

    def run(batches):
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows, start, length, crc, total, marks, kept = [], [], [], [], [], [], []
            same: dict = {}
            for i, text in enumerate(texts):
                text = text or ""
                cut = same.get(text)
                if cut is None:
                    tokens = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    raw = tokens.tobytes()
                    cut = same[text] = [
                        (s, min(capacity, len(tokens) - s), *checksums(raw[4 * s : 4 * (s + capacity)], grain, capacity), len(tokens), tokens[s : s + capacity].tolist() if keep_ids else None)
                        for s in range(0, len(tokens), capacity)
                    ]
                for s, n, c, m, t, k in cut:
                    rows.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(c)
                    total.append(t)
                    marks.append(m)
                    kept.append(k)
            out = [ids.take(pa.array(rows, pa.int32())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)], pa.array(marks, pa.list_(pa.int64()))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"]
            if keep_ids:
                out.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, in order, and the number of bins.

    counts[h] is the number of open bins filled to h. Moving one from h to h + s
    changes the sum of squares by 2 (counts[h + s] - counts[h]) + 2, one less
    where a bin closes or opens. Ties go to the fullest level.
    """
    counts = np.zeros(capacity + 1)
    counts[capacity] = -0.5  # a closed bin is not counted: its square costs nothing
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        level, best = 0, counts[s] + 0.5 if s < capacity else -1e18
        if s < capacity:
            here = counts[1 : capacity - s + 1]
            cost = np.where(here > 0, counts[s + 1 : capacity + 1] - here + 1, np.inf)
            at = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[at] <= best:
                level = at + 1
        if level:
            b = levels[level].pop()
            counts[level] -= 1
        else:
            b, bins = bins, bins + 1
        where[i], offset[i] = b, level
        if level + s < capacity:
            counts[level + s] += 1
            levels[level + s].append(b)
    return where, offset, bins


def dissolved(sizes: np.ndarray, where: np.ndarray, offset: np.ndarray, bins: int, capacity: int, grain: int) -> list[tuple[int, int, int, int, int]]:
    """(item, first, length, bin, offset) of every part, after the emptiest open bins have filled the gaps of the fullest.

    Parts of an item start at multiples of `grain`. Bins that are dissolved have
    no parts; the numbers of the others stay.
    """
    fill = np.bincount(where, weights=sizes, minlength=bins).astype(np.int64)
    order = np.flatnonzero(fill < capacity)
    order = order[np.argsort(-fill[order], kind="stable")].tolist()
    moved: dict[int, list] = {b: [] for b in order}
    for i in np.flatnonzero(fill[where] < capacity).tolist():
        moved[int(where[i])].append((i, 0, int(sizes[i])))
    out = [(i, 0, int(sizes[i]), int(where[i]), int(offset[i])) for i in np.flatnonzero(fill[where] == capacity).tolist()]
    kept: dict[int, list] = {}
    low, high = 0, len(order) - 1
    source: list = []  # parts of the bin that is being dissolved, the smallest last
    while low <= high:
        b = order[low]
        kept[b] = kept.get(b) or moved[b]
        gap = capacity - sum(n for _, _, n in kept[b])
        while gap > 0 and (source or low < high):
            if not source:
                source = sorted(moved[order[high]], key=lambda x: (-x[2], x[0]))
                high -= 1
                continue
            i, first, n = source[-1]
            take = n if n <= gap else gap // grain * grain
            if not take:
                break
            source.pop()
            kept[b].append((i, first, take))
            if take < n:
                source.append((i, first + take, n - take))
            gap -= take
        low += 1
    if source:
        # what is left of the last one stays where it was, or in a bin of its own
        kept[order[high + 1]] = source
    for b, parts in kept.items():
        at = 0
        for i, first, n in parts:
            out.append((i, first, n, b, at))
            at += n
    return out


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS, grain: int = GRAIN, n_documents: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset, gapless in each sequence; `marks` is dropped.

    Extra columns stay. Groups are dealt by a hash of the piece's document and
    content; rows in a group are ordered, so reruns agree. An empty table gives
    an empty table; a group of any size is packed in memory linear in its pieces.
    """
    n = pieces.count() if n_documents is None else n_documents
    groups = max(1, math.ceil(n / group_documents))
    fields = [f for f in pieces.schema.fields if f.name != "marks"]
    columns = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["_order", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        rest = np.flatnonzero((pdf["length"] < capacity).to_numpy())
        full = np.flatnonzero((pdf["length"] >= capacity).to_numpy())
        sizes = pdf["length"].to_numpy()[rest]
        where, offset, bins = sum_of_squares(sizes, capacity)
        parts = np.array(dissolved(sizes, where, offset, bins, capacity, grain), np.int64).reshape(-1, 5)
        none = np.zeros(len(full), np.int64)
        row = np.concatenate((rest[parts[:, 0]], full))
        first, length = np.concatenate((parts[:, 1], none)), np.concatenate((parts[:, 2], none + capacity))
        sequence, at = np.concatenate((parts[:, 3], bins + np.arange(len(full)))), np.concatenate((parts[:, 4], none))
        out = pdf.iloc[row].reset_index(drop=True)
        crc = out["ids_crc32"].to_numpy().copy()
        for j in np.flatnonzero(length < out["length"].to_numpy()).tolist():
            marks, a, b = out["marks"].iat[j], int(first[j]), int(first[j] + length[j])
            upto = int(crc[j]) if b == out["length"].iat[j] else int(marks[b // grain - 1])
            crc[j] = crc_after(upto, int(marks[a // grain - 1]) if a else 0, b - a)
            if "ids" in columns:
                out.at[j, "ids"] = out["ids"].iat[j][a:b]
        out["start"], out["length"], out["ids_crc32"] = out["start"].to_numpy() + first, length, crc
        out["sequence_id"], out["offset"] = (group << 32) + sequence, at
        return out[[*columns, "sequence_id", "offset"]]

    order = F.xxhash64(F.lit("order"), "doc_id", "doc_tokens")
    dealt = pieces.withColumns({"_order": order, "_group": F.pmod(F.xxhash64(F.lit("group"), "doc_id", "doc_tokens"), F.lit(groups)).cast("int")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS, grain: int = GRAIN, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; see `token_pieces` and `pack`.

    Null ids are kept as ids; repeated rows are packed each on its own. Columns
    of the documents other than id and text are left out.
    """
    return pack(token_pieces(docs, capacity=capacity, grain=grain, **options), capacity=capacity, group_documents=group_documents, grain=grain, n_documents=docs.count())
