"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary; no tokenizer is trained. Each language has a probability for every
piece. The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm; words are
independent, and a text belongs to the language under which its words are likeliest. Piece probabilities are learned by
expectation maximisation with the forward-backward algorithm, one Spark task per language.

The learning sample is bounded: at most about MOST_DOCS whole documents per language, chosen by a hash of the id.

Defined results: null texts and texts without a letter get `und` with score 0; without any learned language every
text gets `und`; equal rows get equal results; a language needs at least one word to be learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, held_out, uniform

#: A public vocabulary file; a parameter, never copied.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_DOCS = 1500
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words whose scores a worker remembers; the memory is emptied when full, so that it stays bounded.
REMEMBERED = 400_000
UNKNOWN = 1e-9
#: Letters up to which words are scored together.
SHORT = 24


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece vocabulary that are made of letters (and the word start)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(p for p in found if (q := p.removeprefix(START)) == "" or LETTERS.fullmatch(q))


def prefixes(pieces: Iterable[str]) -> dict[str, int]:
    """Piece number by string; -1 for strings that only begin a piece."""
    out: dict[str, int] = {}
    for k, piece in enumerate(pieces):
        for n in range(1, len(piece)):
            out.setdefault(piece[:n], -1)
        out[piece] = k
    return out


def edges(word: str, tree: dict[str, int]) -> list[list[tuple[int, int]]]:
    """For every place in the word: (end, piece) of the pieces that start there; a lone character without a piece is (end, -1)."""
    out, n, get = [], len(word), tree.get
    for a in range(n):
        here = []
        for b in range(a + 1, n + 1):
            k = get(word[a:b])
            if k is None:
                break
            if k >= 0:
                here.append((b, k))
        if not here or here[0][0] != a + 1:
            here.append((a + 1, -1))
        out.append(here)
    return out


def expected(words: Counter, tree: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of the words, by forward and backward sums."""
    total, prob = np.zeros(len(p)), p.tolist()
    for word, times in words.items():
        spelled = START + word
        graph = edges(spelled, tree)
        n = len(spelled)
        ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for a in range(n):
            if ahead[a]:
                for b, k in graph[a]:
                    ahead[b] += ahead[a] * (prob[k] if k >= 0 else UNKNOWN)
        for a in range(n - 1, -1, -1):
            behind[a] = sum((prob[k] if k >= 0 else UNKNOWN) * behind[b] for b, k in graph[a])
        if not ahead[n]:
            continue
        scale = times / ahead[n]
        for a in range(n):
            for b, k in graph[a]:
                if k >= 0:
                    total[k] += scale * ahead[a] * prob[k] * behind[b]
    return total


def learn(words: Counter, tree: dict[str, int], size: int, rounds: int = 3, floor: float = 0.05) -> np.ndarray:
    """Piece probabilities by expectation maximisation from equal starts; `floor` is added to every count."""
    p = np.full(size, 1.0 / size)
    for _ in range(rounds):
        counts = expected(words, tree, p) + floor
        p = counts / counts.sum()
    return p


class Scorer:
    """Log probabilities of words under all languages at once, summed over segmentations.

    Words that are not remembered are scored together: the forward sums of all of them advance place by place.
    """

    def __init__(self, pieces: list[str], languages: list[str], probabilities: np.ndarray, prior: np.ndarray):
        self.tree, self.languages, self.prior = prefixes(pieces), languages, np.log(prior)
        # The last row is that of a character without a piece (number -1).
        self.rows = np.vstack([probabilities.T, np.full((1, len(languages)), UNKNOWN)]) if languages else np.zeros((0, 0))
        self.longest = max(map(len, pieces), default=1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))

    def long_word(self, word: str) -> np.ndarray:
        """A word of any length, with sums kept in range on the way."""
        spelled = START + word
        n, shift = len(spelled), 0.0
        ahead = np.zeros((n + 1, len(self.languages)))
        ahead[0] = 1.0
        for a, here in enumerate(edges(spelled, self.tree)):
            if ahead[a].max() < 1e-150:
                ahead[a : a + self.longest + 1] *= 1e150
                shift += math.log(1e150)
            for b, k in here:
                ahead[b] += ahead[a] * self.rows[k]
        return np.log(np.maximum(ahead[n], 1e-300)) - shift

    def short_words(self, words: list[str]) -> np.ndarray:
        """Words of at most SHORT letters, all at once: edges of equal place and length are one step."""
        steps: dict[tuple[int, int], tuple[list, list]] = {}
        for w, word in enumerate(words):
            for a, here in enumerate(edges(START + word, self.tree)):
                for b, k in here:
                    step = steps.get((a, b))
                    if step is None:
                        step = steps[a, b] = ([], [])
                    step[0].append(w)
                    step[1].append(k)
        ahead = np.zeros((len(words), SHORT + 2, len(self.languages)))
        ahead[:, 0] = 1.0
        for a, b in sorted(steps):
            at, k = (np.array(x) for x in steps[a, b])
            ahead[at, b] += ahead[at, a] * self.rows[k]
        ends = np.array([len(w) + 1 for w in words])
        return np.log(np.maximum(ahead[np.arange(len(words)), ends], 1e-300))

    def remember(self, words: list[str]) -> None:
        step = max(256, 400_000 // ((SHORT + 2) * max(1, len(self.languages))) * 4)
        for at in range(0, len(words), step):
            some = words[at : at + step]
            short = [w for w in some if len(w) <= SHORT]
            values = [self.short_words(short)] if short else []
            values += [self.long_word(w)[None] for w in some if len(w) > SHORT]
            size = len(self.known)
            if size + len(some) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(len(self.table), len(some)), len(self.languages)))])
            self.table[size : size + len(some)] = np.vstack(values)
            self.known.update(zip([*short, *(w for w in some if len(w) > SHORT)], range(size, size + len(some)), strict=True))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text."""
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), 200):
            counts = [Counter(LETTERS.findall(t.lower())) if t and self.languages else {} for t in texts[at : at + 200]]
            if len(self.known) > REMEMBERED:
                self.forget()
            self.remember(list({w for c in counts for w in c if w not in self.known}))
            for c in counts:
                if not c:
                    out.append(("und", 0.0))
                    continue
                rows = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
                total = self.prior + np.fromiter(c.values(), float, len(c)) @ self.table[rows]
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_column: str = "doc_id", path: str = VOCABULARY, most_docs: int = MOST_DOCS, rounds: int = 3, seed: int = 3) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """pieces, languages, piece probabilities (language by piece) and language shares, from documents that are not held out."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces = vocabulary(path)
    if not counts:
        return pieces, [], np.zeros((0, len(pieces))), np.zeros(0)
    part, limit = uniform("id", F.lit(seed)), F.lit(0.0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(most_docs / n)).otherwise(limit)

    def one(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        for value in found["text"]:
            words.update(LETTERS.findall(value.lower()))
        if not words:
            return pd.DataFrame({"lang": [], "p": []})
        return pd.DataFrame({"lang": [key[0]], "p": [learn(words, prefixes(pieces), len(pieces), rounds)]})

    learned = rows.where(part < limit).groupBy("lang").applyInPandas(one, "lang string, p array<double>").collect()
    learned = sorted(learned, key=lambda r: r["lang"])
    names = [r["lang"] for r in learned]
    share = np.array([counts[n] for n in names], float)
    return pieces, names, np.array([r["p"] for r in learned]).reshape(len(names), len(pieces)), share / max(1.0, share.sum())


def predictor(spark: SparkSession, model: tuple):
    """A column function text -> lang_pred, score. What is broadcast is a number per piece and language."""
    held = spark.sparkContext.broadcast(model)
    made: list[Scorer] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Scorer(*held.value))
        return pd.DataFrame(made[0].texts(list(texts)), columns=["lang_pred", "score"])

    return predict


def report(docs: DataFrame, **options) -> DataFrame:
    predict = predictor(docs.sparkSession, train(docs, **options))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, *, least_score: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, whose language is told with at least that score; `und` goes."""
    name = fresh(docs.columns, "predicted")[0]
    predict = predictor(docs.sparkSession, train(docs, text=text, **options))
    seen = docs.withColumn(name, predict(F.col(f"`{text}`")))
    return seen.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= least_score)).drop(name)
