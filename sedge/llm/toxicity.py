"""Toxicity by compression distance.

zstandard's trainer makes BAGS pairs of dictionaries of equal size, each from a random half of the whole ordinary texts and
a random half of the whole toxic texts. Every window of a text (a word, or 32 bytes of a longer one) is compressed with
each of them, followed by a carrier that ends all dictionaries: zstandard does not search the last bytes of its input.
The window's distance is the mean difference of the two lengths over the pairs; a single pair gives whole bytes only, and
which rare pieces the trainer happens to pick weighs as much as what tells the labels apart. How many windows lie beyond
each of several distances is weighed by a logistic model, whose weights are the calibrated thresholds.

Calibration is cross-fitted: sampled rows are dealt into FOLDS by a hash of the id; the windows of each fold are
measured with dictionaries trained on the other folds, the weights are fitted on all of them, and the final
dictionaries are trained on all folds. So no row is measured with a dictionary that has seen it, at any number of rows.

The sample is bounded: at most about MOST_ROWS labelled rows and, for the trainer, about MOST_BYTES of texts per label,
both chosen by hashes. Longer texts enter as several samples of SAMPLE_CHARS. The samples are broadcast and every
dictionary is trained in a task of its own.

Defined results: null, empty and wordless texts are scored by the model like any other (no window at any distance);
without labels of both kinds the score is the share of label 1 (0 without any label); equal rows get equal scores; a
null id is not held out. Where the trainer finds its samples too few or too short, their last bytes are the dictionary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, held_out, uniform
from .labelled import training_rows

MOST_ROWS = 16_000
MOST_BYTES = 6 << 20
SAMPLE_CHARS = 64 << 10
FOLDS, BAGS = 4, 5
#: Bytes of a dictionary at most, and bytes of the smaller label's samples per byte of dictionary.
DICTIONARY_BYTES, SAMPLES_PER_BYTE = 128 << 10, 16
#: Lengths of the pieces that the trainer picks and compares.
SEGMENT, PART = 20, 8
WINDOW_BYTES = 32
CARRIER = b"0123456789,;:!?()[]{}<>=+*/#0123456789,;"
#: Distances are counted in parts of a byte, up to FAR bytes in either direction; distances from which on windows are weighed.
PARTS, FAR = 6, 8
STEPS, AGAINST = (0.5, 1, 1.5, 2, 2.5, 3, 4), (0.5, 1.5, 2.5)
#: Windows whose distance a worker remembers. When so many are new, those not met since the last time are forgotten.
REMEMBERED = 500_000
#: Distinct windows of texts that are held until the new ones among them are compressed together.
AT_ONCE = 50_000


def windows(text: str | None) -> list[bytes]:
    out = []
    for word in text.encode("utf-8", "surrogatepass").split() if text else ():
        out += [word] if len(word) <= WINDOW_BYTES else [word[k : k + WINDOW_BYTES] for k in range(0, len(word), WINDOW_BYTES)]
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART, level=3).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(content + b" " + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    raw.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=how)


class Distances:
    """Windows of a text by their distance from ordinary to toxic text, for pairs (ordinary, toxic) of dictionaries."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs, self.known = [(_compressor(a), _compressor(b)) for a, b in pairs], {}
        self.older: dict[bytes, int] = {}

    def measured(self, found: list[bytes]) -> list[int]:
        """Bytes that toxic dictionaries save over ordinary ones, the mean over all pairs, in PARTS of a byte from -FAR on."""
        data = [b" " + window + b" " + CARRIER for window in found]

        def lengths(compressor: zstandard.ZstdCompressor) -> np.ndarray:
            made = compressor.multi_compress_to_buffer(data)
            return np.array([len(made[k]) for k in range(len(made))], int)

        saved = sum(lengths(ordinary) - lengths(toxic) for ordinary, toxic in self.pairs)
        return (PARTS * FAR + np.clip(np.rint(PARTS * saved / len(self.pairs)).astype(int), -PARTS * FAR, PARTS * FAR)).tolist()

    def window(self, window: bytes) -> int:
        return self.measured([window])[0]

    def counts(self, text: str | None) -> list[float]:
        return self.counts_of_all([text])[0]

    def counts_of_all(self, texts: Iterable[str | None]) -> list[list[float]]:
        """Numbers of windows by distance, of each text. Windows not met before are compressed many at a time."""
        out, held, size = [], [], 0
        new: dict[bytes, None] = {}

        def flush() -> None:
            if new:
                self.known.update(zip(new, self.measured(list(new)), strict=True))
            for found in held:
                row = [0.0] * (2 * PARTS * FAR + 1)
                for window, n in found.items():
                    row[self.known[window]] += n
                out.append(row)
            new.clear()
            held.clear()
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}

        for text in texts:
            found = Counter(windows(text))
            for window in found:
                if window not in self.known:
                    d = self.older.get(window)
                    if d is None:
                        new[window] = None
                    else:
                        self.known[window] = d
            held.append(found)
            size += len(found)
            if size >= AT_ONCE:
                flush()
                size = 0
        flush()
        return out


#: The distances that this worker process measured last, by the digest of their dictionaries: tasks that follow each other
#: in a worker share what it remembers.
_LATEST: dict[str, Distances] = {}


def distances_of(pairs: list[tuple[bytes, bytes]]) -> Distances:
    digest = hashlib.sha256()
    for content in (x for pair in pairs for x in pair):
        digest.update(len(content).to_bytes(8, "big") + content)
    key = digest.hexdigest()
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = Distances(pairs)
    return _LATEST[key]


def features(counts: np.ndarray) -> np.ndarray:
    """For distances in favour of toxic text, numbers (logarithms) and shares of windows beyond; shares of those against; the mean."""
    total, middle = np.maximum(counts.sum(axis=1), 1), PARTS * FAR
    beyond = [counts[:, middle + round(PARTS * t) :].sum(axis=1) for t in STEPS]
    against = [counts[:, : middle - round(PARTS * t) + 1].sum(axis=1) for t in AGAINST]
    mean = counts @ np.arange(-middle, middle + 1) / PARTS / total
    return np.stack([np.log1p(x) for x in beyond] + [4 * np.sqrt(x / total) for x in beyond + against] + [mean, np.log(total)], axis=1)


@dataclass
class ToxicityModel:
    pairs: list[tuple[bytes, bytes]]
    weights: np.ndarray
    intercept: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(counts) @ self.weights + self.intercept, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps. All rows count alike, so that scores are the labels' probabilities."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * len(y) / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def dictionaries(rows: DataFrame, folds: int = FOLDS, bags: int = BAGS, most_bytes: int = MOST_BYTES) -> dict[int, list[tuple[bytes, bytes]]]:
    """Pairs of dictionaries by left-out fold (-1 leaves out none); empty without texts of both labels. rows: label, fold, text."""
    spark = rows.sparkSession
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SAMPLE_CHARS).cast("int"))
    parts = F.transform(parts, lambda k: F.substring(F.col("text"), k * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)))
    pieces = rows.where("length(text) > 0").select("label", "fold", F.xxhash64("text").alias("h"), F.posexplode(parts).alias("at", "sample"))
    total = {r["label"]: r["n"] for r in pieces.groupBy("label").agg(F.sum(F.octet_length("sample")).alias("n")).collect()}
    if len(total) < 2:
        return {}
    size = int(min(DICTIONARY_BYTES, max(256, min(*total.values(), most_bytes) // SAMPLES_PER_BYTE)))
    share = F.when(F.col("label") == 1, F.lit(most_bytes / total[1.0])).otherwise(F.lit(most_bytes / total[0.0]))
    found = pieces.where(uniform("h", "at", F.lit(9)) < share).select("label", "fold", F.xxhash64("h", "at", "fold").alias("h"), "sample").orderBy("h", "sample").toPandas()
    samples = {y: [(r.fold, r.h, r.sample.encode("utf-8", "surrogatepass")) for r in found[found["label"] == y].itertuples()] for y in (0.0, 1.0)}
    held = spark.sparkContext.broadcast(samples)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, without, bag in batch.itertuples(index=False):
                # A bit of the hash deals a sample to the bag or not; where a bag gets none, it is made of all.
                rest = [(h, x) for k, h, x in held.value[label] if k != without]
                half = [x for h, x in rest if h >> bag & 1] or [x for _, x in rest]
                yield pd.DataFrame({"label": [label], "without": [without], "bag": [bag], "content": [dictionary(half, size) if half else b""]})

    keys = [(y, k, b) for y in (0.0, 1.0) for k in range(-1, folds) for b in range(bags)]
    asked = spark.createDataFrame(keys, "label double, without int, bag int").repartition(len(keys))
    made = {(r["label"], r["without"], r["bag"]): bytes(r["content"]) for r in asked.mapInPandas(one, "label double, without int, bag int, content binary").collect()}
    return {k: [(made[0.0, k, b], made[1.0, k, b]) for b in range(bags)] for k in range(-1, folds)}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, text: str = "text", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, folds: int = FOLDS, bags: int = BAGS) -> ToxicityModel | float:
    """A model, or the share of label 1 where texts of both labels are missing."""
    source = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(folds)).cast("int").alias("fold")
    rows = cut(training_rows(source, labels, label, most_rows=most_rows, columns=["text", fold]).drop("label_id"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    made = dictionaries(rows, folds, bags, most_bytes) if len(n) == 2 else {}
    if not made:
        return n.get(1.0, 0) / max(1, sum(n.values()))
    held = rows.sparkSession.sparkContext.broadcast(made)

    def count(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        distances = Distances(held.value[key[0]])
        return pd.DataFrame({"label": found["label"], "c": distances.counts_of_all(found["text"])})

    part = F.pmod(F.xxhash64("text"), F.lit(4))
    got = rows.groupBy("fold", part).applyInPandas(lambda key, found: count(key, found), "label double, c array<double>").toPandas()
    weights, intercept = logistic(features(np.stack(got["c"].to_numpy())), got["label"].to_numpy())
    return ToxicityModel(made[-1], weights, intercept)


def scorer(spark: SparkSession, model: ToxicityModel | float):
    """A column function text -> score. What is broadcast are the dictionaries and the weights."""
    if isinstance(model, float):
        return lambda text: F.lit(model)
    held = spark.sparkContext.broadcast(model)
    made: list[Distances] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(distances_of(held.value.pairs))
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(held.value.scores(np.array(made[0].counts_of_all(texts))))

    return lambda text: score(text)


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    score = scorer(docs.sparkSession, train(docs, labels, **options))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    name = fresh(docs.columns, "score")[0]
    score = scorer(docs.sparkSession, train(docs, labels, text=text, **options))
    return docs.withColumn(name, score(F.col(f"`{text}`"))).where(F.col(name) < threshold).drop(name)
