"""Benchmark decontamination by n-gram windows.

A broadcast hash set holds the windows of the benchmark items (`n` consecutive words; an item with fewer words, but
not none, is one window) as sorted 64-bit hashes in an array, with the place of each window in the items' normalised
text. Training texts are scanned window by window: a rolling hash over word hashes finds candidates, each is verified
byte by byte against that text, and the words inside verified windows are hit.

A benchmark whose index would exceed INDEX_BYTES is not broadcast. Its windows become a table, and a Bloom filter of their
hashes, of BLOOM_BITS at most, is broadcast instead. Texts are scanned once, whatever the benchmark's size: windows that
pass the filter meet the table of windows by their words, and what is hit meets the texts by two hashes of the text. A
fuller filter lets more windows pass and loses none.

Defined results: a null or wordless text has no words and no hits; a null, wordless or missing item has no window; an
item without an id marks words but is not listed; equal item ids count once; repeated documents each get a row; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bytes outside 0-9, a-z, A-Z and non-ASCII become blanks; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
SEED = 7
#: Size of the index of one broadcast; an index takes about INDEX_RATIO times its items' text.
INDEX_BYTES, INDEX_RATIO = 128 << 20, 6
#: Bits of the filter: BLOOM_RATIO for each window, each of which sets one by every multiplier, and BLOOM_BITS (128 MB) at most.
BLOOM_BITS, BLOOM_RATIO = 1 << 30, 12
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Bits of the pieces in which the filter is built, rows of the batches of windows, and parts that a hot window or text is split into.
PIECE, BATCH, SALTS = 1 << 20, 20_000, 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of n word hashes."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + ids[k : k + len(out)]
    return out


@dataclass
class WindowIndex:
    """Windows of some items: by number of words, sorted hashes and the first word of each window; words are places in text."""

    n: int
    ids: list
    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, rows: list[tuple], n: int) -> WindowIndex:
        ids, texts, counts, sized = [], [], [0], {}
        for item_id, value in rows:
            words = words_of(value)
            size = min(n, len(words))
            if size:
                first = counts[-1]
                sized.setdefault(size, []).append((_rolling(_hashes(words), size), first))
                ids.append(item_id)
                texts.append(b" ".join(words))
                counts.append(first + len(words))
        text = b" ".join(texts)
        blanks = np.nonzero(np.frombuffer(text, np.uint8) == 32)[0] if text else np.zeros(0, np.int64)
        starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(text))
        windows = {}
        for size, found in sized.items():
            value = np.concatenate([h for h, _ in found])
            at = np.concatenate([first + np.arange(len(h)) for h, first in found])
            order = np.argsort(value, kind="stable")
            windows[size] = (value[order], at[order].astype(np.int32))
        return cls(n, ids, text, starts.astype(np.int32), ends.astype(np.int32), np.array(counts[:-1], np.int64), windows)

    @property
    def nbytes(self) -> int:
        return len(self.text) + sum(a.nbytes for a in (self.starts, self.ends, self.first_word)) + sum(a.nbytes + b.nbytes for a, b in self.windows.values())

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [from, to) spans of hit words, and the ids of the items whose windows occur."""
        spans, items, hashes = [], set(), _hashes(words)
        for size, (known, place) in self.windows.items():
            if len(words) < size:
                continue
            value = _rolling(hashes, size)
            low = np.searchsorted(known, value)
            low[low == len(known)] = 0
            for k in np.nonzero(known[low] == value)[0].tolist():
                window, a, found = b" ".join(words[k : k + size]), int(low[k]), False
                while a < len(known) and known[a] == value[k]:
                    first = int(place[a])
                    if self.text[self.starts[first] : self.ends[first + size - 1]] == window:
                        items.add(self.ids[int(np.searchsorted(self.first_word, first, side="right")) - 1])
                        found = True
                    a += 1
                if found:
                    spans.append((k, k + size))
        return merge(spans), items


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _index(items: DataFrame, n: int, index_bytes: int) -> WindowIndex | None:
    """The index of all items, or None where it is too large to broadcast. Their size is summed before any is fetched."""
    size = items.select(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    if size * INDEX_RATIO > index_bytes:
        return None
    index = WindowIndex.build([(r["item"], r["text"]) for r in items.toLocalIterator()], n)
    return index if index.nbytes <= index_bytes else None


def _windows(items: DataFrame, n: int) -> DataFrame:
    """size, hash, words and item of the distinct windows of the items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = words_of(text)
                size = min(n, len(words))
                if size:
                    value = _rolling(_hashes(words), size).view(np.int64)
                    for a in range(0, len(value), BATCH):
                        part = value[a : a + BATCH]
                        yield pd.DataFrame({"size": np.int32(size), "hash": part, "words": [b" ".join(words[k : k + size]) for k in range(a, a + len(part))], "item": item})

    return items.mapInPandas(run, "size int, hash bigint, words binary, item string").distinct()


def _places(value: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the filter that each hash sets."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [((value ^ (value >> np.uint64(29))) * m) >> shift for m in MULTIPLIERS]


def _bloom(windows: DataFrame, most_bits: int) -> np.ndarray:
    """The filter of the windows' hashes, as bytes. Its bits are made distinct and packed in pieces by tasks."""
    wanted = max(64, windows.count() * BLOOM_RATIO)
    bits = min(most_bits, 1 << (wanted - 1).bit_length())

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.unique(np.concatenate(_places(frame["hash"].to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pd.DataFrame({"piece": at // PIECE, "at": at % PIECE})

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(min(bits, PIECE), np.uint8)
        held[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    # A piece is one group of at most PIECE distinct rows.
    packed = windows.select("hash").mapInPandas(places, "piece bigint, at bigint").distinct().groupBy("piece").applyInPandas(pack, "piece bigint, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in packed.toLocalIterator():
        a = r["piece"] * PIECE // 8
        out[a : a + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(texts: DataFrame, bloom, sizes: list[int]) -> DataFrame:
    """k1, k2, first, size, hash and words of the windows of texts (k1, k2, text) that pass the filter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bloom.value
        for frame in frames:
            for k1, k2, text in zip(frame["k1"], frame["k2"], frame["text"], strict=True):
                words = words_of(text)
                hashes = _hashes(words)
                for size in sizes:
                    if size > len(words):
                        continue
                    value = _rolling(hashes, size)
                    passed = np.ones(len(value), bool)
                    for at in _places(value, 8 * len(held)):
                        passed &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    first = np.nonzero(passed)[0]
                    for a in range(0, len(first), BATCH):
                        part = first[a : a + BATCH]
                        yield pd.DataFrame({"k1": k1, "k2": k2, "first": part, "size": np.int32(size), "hash": value[part].view(np.int64), "words": [b" ".join(words[k : k + size]) for k in part.tolist()]})

    return texts.mapInPandas(run, "k1 bigint, k2 bigint, first bigint, size int, hash bigint, words binary")


def _found(docs: DataFrame, text: Column, items: DataFrame, n: int, most_bits: int) -> DataFrame | None:
    """k1, k2, spans and items of the texts that are hit, by the filter and the table of windows; None if there is no window."""
    windows = cut(_windows(items, n))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # n of them at most
    if not sizes:
        return None
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(windows, most_bits))
    texts = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text")).where("text IS NOT NULL")
    # Copies of a text give equal rows, which are one before anything is shuffled.
    passed = cut(_candidates(texts, bloom, sizes).distinct())
    bloom.unpersist()
    key = ["size", "hash", "words"]
    met = windows.join(passed.select(key).distinct(), key)
    # A window may be in a third of all texts: texts are dealt to SALTS copies of the windows that are met.
    salted = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = passed.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"])
    spans = F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("size")).alias("b")))
    merged = hits.groupBy("k1", "k2").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return cut(merged.select("k1", "k2", _merged(F.col("spans")).alias("spans"), "items"))


def _scanner(index):
    """A column function text -> n_words, spans and items for one broadcast block."""

    @F.pandas_udf("n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        counts, spans, items = [], [], []
        for value in texts:
            words = words_of(value)
            hit, found = index.value.scan(words)
            counts.append(len(words))
            spans.append([{"a": a, "b": b} for a, b in hit])
            items.append(sorted(x for x in found if x is not None))
        return pd.DataFrame({"n_words": counts, "spans": pd.Series(spans, dtype=object), "items": pd.Series(items, dtype=object)})

    return scan


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, index_bytes: int = INDEX_BYTES, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """docs with one more column: n_words, spans (merged word ranges that are hit) and items (sorted ids). The name must be new;
    bloom_bits is a power of two from 64 on."""
    if fresh(docs.columns, name)[0] != name:
        raise ValueError(f"there is a column {name} already")
    spark, column = docs.sparkSession, F.col(f"`{text}`")
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    index = _index(items, n, index_bytes)
    merged = None if index else _found(docs, column, items, n, bloom_bits)
    if merged is None:
        index = index or WindowIndex.build([], n)
        return docs.withColumn(name, _scanner(spark.sparkContext.broadcast(index))(column))
    k1, k2, salt, words, spans, items = fresh([*docs.columns, name], "k1", "k2", "salt", "n_words", "spans", "items")
    # Copies of one text are dealt to SALTS copies of its hits, by the partition that they come from.
    keyed = docs.withColumns({k1: F.xxhash64(column), k2: F.xxhash64(column, F.lit(1)), salt: F.spark_partition_id() % SALTS, words: _counter(column)})
    salted = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(salted.withColumnsRenamed({"k1": k1, "k2": k2, "salt": salt, "spans": spans, "items": items}), [k1, k2, salt], "left")
    none = F.struct(F.col(words).alias("n_words"), F.coalesce(spans, F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], none.alias(name))


def _counter(text: Column) -> Column:
    """Number of words, as words_of() has them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined, as a column."""
    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= x["a"]), joined).otherwise(F.concat(done, F.array(x)))

    ordered = F.array_sort(spans)
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), step)


def n_hit(spans: Column) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"]), F.lit(0).cast("bigint"))


def contaminated(n_words: Column, hit: Column) -> Column:
    return (hit > 0) & (hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, "hits", **options)
    found = found.select("doc_id", "hits.n_words", n_hit(F.col("hits.spans")).alias("n_hit"), F.col("hits.items").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without the contaminated ones; the others are left as they are."""
    name = fresh(docs.columns, "hits")[0]
    seen = with_hits(docs, benchmark, name, **options)
    return seen.where(~contaminated(F.col(name)["n_words"], n_hit(F.col(name)["spans"]))).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words in the spans; what stands between two words of a span goes too."""
    if not text or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(FOLD)
    starts, ends, at = [], [], 0
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")


def strip_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with their hit passages cut out of the text, those of all blocks of the benchmark at once."""
    name = fresh(docs.columns, "hits")[0]

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(t, [(x["a"], x["b"]) for x in found]) for t, found in zip(texts, spans, strict=True)], dtype=object)

    seen = with_hits(docs, benchmark, name, text=text, **options)
    return seen.withColumn(text, clean(F.col(f"`{text}`"), F.col(name)["spans"])).drop(name)
