"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Its ratio (compressed by plain bytes) has to lie
within limits that depend on its length: below them it is repetitive, above them it looks like noise. Chunks have
their own limits, and a text goes if chunks outside them hold more than `bad_share` of its chunked bytes.

Defined results: a null, empty or wordless text has no words, fails the base rule (too few words) and is not kept;
equal rows get equal results; very long texts are read whole, chunk by chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Plain bytes from which a band holds, least and greatest ratio. Set from the extremes of texts labelled good and of
#: licences and manuals, with a margin of a tenth above and a fifth below; texts under 256 bytes tell too little.
WHOLE_BANDS = ((0, 0.0, 9.0), (256, 0.40, 0.82), (512, 0.37, 0.75), (1024, 0.34, 0.66), (2048, 0.32, 0.585), (4096, 0.30, 0.56), (8192, 0.28, 0.53), (16384, 0.25, 0.50))
CHUNK_BANDS = ((0, 0.0, 9.0), (1024, 0.28, 0.70), (2048, 0.28, 0.64), (4096, 0.28, 0.60))
#: Texts with more than half of their bytes beyond ASCII (scripts of two or three bytes a letter) may have this much higher ratios.
DENSE = 1.3
SYMBOLS = b"#*$%&|<>"
ASCII = bytes(range(128))
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, least_chunk double, most_chunk double, bad_share double, in_band boolean"


@dataclass
class Bands:
    whole: tuple = WHOLE_BANDS
    chunks: tuple = CHUNK_BANDS
    chunk_bytes: int = 4096
    bad_share: float = 0.25
    level: int = 3
    zstd: zstandard.ZstdCompressor | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "zstd"} | {"zstd": None}

    def ratio(self, data: bytes) -> float:
        if self.zstd is None:
            self.zstd = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(self.zstd.compress(data)) / len(data)

    def verdict(self, data: bytes) -> tuple[float, float, float, float, bool]:
        """ratio, least and greatest chunk ratio, share of bytes in chunks outside their band, and whether all is within limits."""
        if not data:
            return 1.0, 1.0, 1.0, 0.0, True
        ratio = self.ratio(data)
        scale = DENSE if 2 * len(data.translate(None, ASCII)) > len(data) else 1.0
        least, most, bad, seen = 9.0, 0.0, 0, 0
        for at in range(0, len(data), self.chunk_bytes):
            chunk = data[at : at + self.chunk_bytes]
            value = ratio if len(chunk) == len(data) else self.ratio(chunk)
            low, high = band(self.chunks, len(chunk))
            least, most, seen = min(least, value), max(most, value), seen + len(chunk)
            bad += len(chunk) * (not low <= value <= high * scale)
        low, high = band(self.whole, len(data))
        return ratio, least, most, bad / seen, low <= ratio <= high * scale and bad <= self.bad_share * seen


def band(bands: tuple, size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that are found twice or more, the first finds included."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Numbers of word pairs, then of windows: no product exceeds the square of the number of words.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def repeated_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def measure(text: str | None, bands: Bands) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text or "") - blanks, symbols, repeated_lines(data), repeated_words(words), *bands.verdict(data)


def measures(bands: Bands):
    names = [x.split()[0] for x in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, bands) for t in texts], columns=names)

    return run


def with_quality(docs: DataFrame, name: str, *, text: str = "text", bands: Bands | None = None, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with one more column `name` of all measures, base_failed and kept; the name must be new."""
    if fresh(docs.columns, name)[0] != name:
        raise ValueError(f"there is a column {name} already")
    found = docs.withColumn(name, measures(bands or Bands())(F.col(f"`{text}`")))
    m = F.col(name)
    failed = (m["n_words"] < least_words) | (m["n_repeat_words"] * 100 > m["n_words"] * most_repeated)
    return found.withColumn(name, F.struct(f"`{name}`.*", failed.alias("base_failed"), (~failed & m["in_band"]).alias("kept")))


def report(docs: DataFrame, **options) -> DataFrame:
    found = with_quality(docs.select("doc_id", "text"), "m", **options)
    return found.select("doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_chunk", "most_chunk", "bad_share")])


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that the base rules and the bands let pass."""
    name = fresh(docs.columns, "quality")[0]
    return with_quality(docs, name, **options).where(F.col(name)["kept"]).drop(name)
