"""Vectorised work on the UTF-8 bytes of many texts at once, for the Arrow-fed operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import FOLD, find_code

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n-1, mod 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, U)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def mixed(n: int) -> int:
    return int(mix(np.array([n], U))[0])


class Block:
    """Some texts, one after another: bytes, and where each begins and ends. gap spaces stand before, between and after."""

    def __init__(self, lo: int, raw: list[bytes], gap: int):
        self.lo, self.n = lo, len(raw)
        fill = b" " * gap
        self.bytes = np.frombuffer(fill + fill.join(raw) + fill, np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.end = np.cumsum(self.size + gap)
        self.begin = self.end - self.size

    def sums(self) -> np.ndarray:
        """Prefix sums of a polynomial over the bytes; span() takes hashes of substrings from them."""
        out = np.zeros(len(self.bytes) + 1, U)
        np.cumsum((self.bytes.astype(U) + U(1)) * powers(BASE, len(self.bytes)), out=out[1:])
        return out

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes for which the table inside holds, and the first word of each text (one more at the end)."""
        m = inside[self.bytes]
        edge = np.flatnonzero(m[1:] != m[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, np.append(self.begin, len(self.bytes)))


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(U) * U(BASE))


def blocks(texts, gap: int = 1, fold: bool = True, limit: int = 1 << 20) -> Iterator[Block]:
    """The texts in blocks of about limit bytes; a longer text is a block of its own. None counts as empty."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if held and size + len(raw) > limit:
            yield Block(lo, held, gap)
            lo, held, size = i, [], 0
        held.append(raw.translate(FOLD) if fold else raw)
        size += len(raw)
    if held:
        yield Block(lo, held, gap)


def rolling(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hashes of n successive values each."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, U)
    for j in range(n):
        out *= U(base)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def table(allowed) -> np.ndarray:
    """256 booleans."""
    return np.array([bool(allowed(b)) for b in range(256)])


#: Words of the shingle and language-model contracts: everything but ASCII white space.
NOT_SPACE = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of the benchmark contract: digits, letters and all beyond ASCII.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def scanned(df: DataFrame, text: str, keep: list[str], run, schema: str, gap: int = 1, fold: bool = True) -> DataFrame:
    """The columns keep of df, unchanged, and those of schema, which run(block) returns as a dict of arrays or lists.

    One row out for each row in. Arrow batches pass through without pandas, so integers with nulls stay exact. Within a
    batch, texts are worked on in blocks of about 1 MB."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    # inside, names are unique; clashing ones come back only at the end
    out = StructType([*[StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], *[StructField(f"_a{i}", f.dataType) for i, f in enumerate(added.fields)]])
    types = to_arrow_schema(added)

    def work(batches):
        for b in batches:
            for block in blocks(b.column(b.schema.get_field_index("_text")).to_pylist(), gap, fold):
                got, part = run(block), b.slice(block.lo, block.n)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *[pa.array(got[f.name], f.type) for f in types]], names=out.names)

    find_code(df.sparkSession)
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text")).mapInArrow(work, out).toDF(*keep, *added.names)
