"""Helpers shared by the corpus operators: table access, words, checkpoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.places import hot_join, materialise  # noqa: F401  the operators take them from here

#: A word is a run of anything but ASCII white space. bytes.split() without
#: arguments splits on exactly these six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words in a uint8 buffer; `spaces` marks the bytes between words."""
    space = spaces[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(data) + 1
    total = np.zeros(n, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * powers(_INVERSE, n)[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: pa.Array, most: int = 1 << 21):
    """Cut an Arrow string column into runs of rows of about `most` bytes.

    Yields (first row, joined bytes, offset of each row and the end). A text is
    never cut; rows are separated by one space so that no word spans two rows.
    Null texts are empty.
    """
    values = [v or b"" for v in texts.cast(pa.large_binary()).to_pylist()]
    first, size, held = 0, 0, []
    for i, v in enumerate(values):
        held.append(v)
        size += len(v) + 1
        if size >= most or i + 1 == len(values):
            offsets = np.zeros(len(held) + 1, dtype=np.int64)
            np.cumsum([len(x) + 1 for x in held], out=offsets[1:])
            yield first, b" ".join(held) + b" ", offsets
            first, size, held = i + 1, 0, []


def words_sql(text: str = "text") -> str:
    """DuckDB: the list of words of a text column (null: none)."""
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def seeded(column, seed: int):
    """A reproducible order that Spark and DuckDB both compute: hex md5 of 'seed:id'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))


def dealt(part: np.ndarray, *columns: np.ndarray, runs: np.ndarray | None = None, names: tuple[str, ...] = ()) -> pa.RecordBatch:
    """One row for each part that occurs: its entries of every column as packed binary.

    Millions of fixed-width entries so cross a shuffle as a few blobs instead of
    as rows. Entries of a part keep their order. `runs` is a column that repeats
    in runs: it is stored once for each run, with the run's length.
    """
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part, prepend=part[0] - 1 if len(part) else 0))
    ends = np.append(cut[1:], len(part))[: len(cut)]
    columns = [c[order] for c in columns]
    out = [pa.array(part[cut].astype(np.int32))]
    out += [pa.array([c[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for c in columns]
    if runs is not None:
        runs = runs[order]
        new = np.flatnonzero((np.diff(runs, prepend=0) != 0) | (np.diff(part, prepend=-1) != 0))
        if len(runs) and (not len(new) or new[0]):
            new = np.append(0, new)
        lengths = np.diff(np.append(new, len(runs))).astype(np.uint32)
        at = np.searchsorted(new, np.append(cut, len(runs))[: len(cut) + 1])
        heads = runs[new]
        out += [pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (heads, lengths)]
    return pa.RecordBatch.from_arrays(out, names=list(names))


def joined(column, kind) -> np.ndarray:
    """All blobs of a binary column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The numpy twin of `id_bucket_column`."""
    u = ids.view(np.uint64)
    return np.mod((u ^ (u >> np.uint64(16)) ^ (u >> np.uint64(32))).view(np.int64), buckets).astype(np.int32)


def id_bucket_column(column, buckets: int):
    """A bucket of a bigint id by shifts alone, so that numpy finds the same one."""
    x = column.bitwiseXOR(F.shiftrightunsigned(column, 16)).bitwiseXOR(F.shiftrightunsigned(column, 32))
    return F.coalesce(F.pmod(x, F.lit(buckets)), F.lit(0)).cast("int")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
