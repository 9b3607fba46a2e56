"""General coders and the choice among them by measured size. Coders that are not installed are left out."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes on which coders are compared before the best few code all.
SCREEN = 256 << 10
#: Bytes up to which lzma's dearest preset is tried.
EXTREME = 64 << 10


def _raw(data: bytes) -> bytes:
    return data


def _zlib(data: bytes) -> bytes:
    return zlib.compress(data, 9)


def _bz2(data: bytes) -> bytes:
    return bz2.compress(data, 9)


def _lzma(data: bytes) -> bytes:
    return lzma.compress(data, preset=6)


def _lzma_extreme(data: bytes) -> bytes:
    return lzma.compress(data, preset=9 | lzma.PRESET_EXTREME)


def _strict(decompressor: Callable) -> Callable[[bytes], bytes]:
    """A decoder of one stream that refuses a cut one and bytes after its end."""

    def run(data: bytes) -> bytes:
        d = decompressor()
        try:
            out = d.decompress(data)
        except (OSError, EOFError, lzma.LZMAError, zlib.error) as e:
            raise ValueError(str(e)) from e
        if d.unused_data or not d.eof:
            raise ValueError("bytes after the end, or a cut stream")
        return out

    return run


CODERS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "raw": (_raw, _raw),
    "zlib": (_zlib, _strict(zlib.decompressobj)),
    "bz2": (_bz2, _strict(bz2.BZ2Decompressor)),
    "lzma": (_lzma, _strict(lzma.LZMADecompressor)),
}
try:
    import zstandard

    def _unzstd(data: bytes) -> bytes:
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            out = d.decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
        if d.unused_data or not d.eof:
            raise ValueError("bytes after the end, or a cut stream")
        return out

    CODERS["zstd"] = (lambda x: zstandard.ZstdCompressor(level=19).compress(x), _unzstd)
except ImportError:
    pass
try:
    import brotli

    CODERS["brotli"] = (lambda x: brotli.compress(x, quality=9), brotli.decompress)
except ImportError:
    pass


def encode(coder: str, data: bytes) -> bytes:
    return CODERS[coder][0](data)


def decode(coder: str, data: bytes) -> bytes:
    if coder not in CODERS:
        raise ValueError(f"coder {coder!r} is not installed")
    return CODERS[coder][1](data)


def best(data: bytes, names: list[str] | None = None, screen: int = SCREEN, finalists: int = 2) -> tuple[str, bytes]:
    """(coder, coded) of the smallest; of equals the first. Never larger than the data.

    Long data are screened on their start, and only the best few and bz2, which gains most by length,
    code all of them. Where lzma wins on data of up to EXTREME bytes, its dearest preset is tried too; its
    payload reads the same.
    """
    names = list(CODERS) if names is None else names
    if len(data) > screen:
        ranked = sorted(names, key=lambda n: len(encode(n, data[:screen])))
        names = ["raw", *[n for n in ranked if n != "raw"][:finalists], *(["bz2"] if "bz2" in names else [])]
    coded = [(n, encode(n, data)) for n in dict.fromkeys(names)]
    found = min(coded, key=lambda c: len(c[1]))
    return min([found, ("lzma", _lzma_extreme(data))], key=lambda c: len(c[1])) if found[0] == "lzma" and len(data) <= EXTREME else found


#: Qualities of the coders that have them.
QUALITIES: dict[str, dict[int, Callable[[bytes], bytes]]] = {
    "zlib": {q: lambda x, q=q: zlib.compress(x, q) for q in (1, 6, 9)},
    "bz2": {q: lambda x, q=q: bz2.compress(x, q) for q in (1, 5, 9)},
    "lzma": {q: lambda x, q=q: lzma.compress(x, preset=q) for q in (0, 3, 6)},
}
if "zstd" in CODERS:
    QUALITIES["zstd"] = {q: lambda x, q=q: zstandard.ZstdCompressor(level=q).compress(x) for q in (1, 9, 19)}
if "brotli" in CODERS:
    QUALITIES["brotli"] = {q: lambda x, q=q: brotli.compress(x, quality=q) for q in (1, 5, 9, 11)}


def coded_size(coder: str) -> Callable[[Column], Column]:
    """A column function: bytes of a binary value after the coder."""

    @F.pandas_udf("long")
    def size(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else len(encode(coder, bytes(v))))

    return size


def best_coder(values: Column) -> Column:
    """The smallest coding of each binary value: struct<coder, payload>."""

    @F.pandas_udf("struct<coder:string,payload:binary>")
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(bytes(x)) if x is not None else (None, None) for x in v], columns=["coder", "payload"])

    return run(values)


def decoded(coders: Column, payloads: Column) -> Column:
    """The binary values again."""

    @F.pandas_udf("binary")
    def run(c: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(x, bytes(y)) for x, y in zip(c, p)], dtype=object)

    return run(coders, payloads)
