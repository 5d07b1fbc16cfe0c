"""License scans by conditional compression.

Candidate blocks are paragraphs of a text, between blank lines, that have a cue word. A block's words, case and punctuation
aside, are compressed alone and with each template as a zstandard raw dictionary, and the templates are ranked by the
bytes that they save. Only those that save a good part of what they take themselves (`least_gain`) are winners. The best
winner is confirmed by exact wording: its words have to occur in the block in order, with at most `most_share` of them
missing, added or changed in the aligned stretch; the telling words (names of licences and their versions) have to be
there unchanged, in order, and no others among them. What it explains is taken out, the rest is compressed and ranked
again, and so on until no winner is confirmed. So of templates that fit the same words the one that saves most counts.

What a dictionary saves drowns in a text many times its length. So templates are classed by length (up to 4, 8, 16 ...
words), and each class reads a block in windows of twice that many words, half overlapping: every stretch lies whole in
a window. Windows without a cue word are passed over, as every template has one. Of confirmed stretches of different
windows or classes that overlap, the one that saves most counts.

Defined results: null and empty texts have no blocks and no licences; a notice found several times is listed once per
place; equal rows get equal results; of equally ranked templates the earlier one comes first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .license_texts import TEMPLATES

#: Words by which a block becomes a candidate.
CUES = re.compile(r"licen[cs]|permission|redistribut|free software|copyright|warrant|public domain|creative commons|free to copy", re.IGNORECASE)
#: Words that tell one licence from another: in a long notice they may not differ, be missing or be added.
TELLING = frozenset("gnu general lesser affero gpl lgpl agpl mit apache mozilla bsd isc mpl cc cc0 by sa nc nd version v".split())
SPACES = re.compile(r"\s+")
TOKEN = re.compile(r"\w+(?:\.\d+)*")
CONTINUED = re.compile(r"-\w")
FIELDS = "n_blocks bigint, notices array<struct<license:string,block:int,char_from:bigint,char_to:bigint,saved:bigint,differences:int>>"


@dataclass
class Template:
    license: str
    text: str
    words: list[str]
    #: Bytes that the words take themselves, compressed alone.
    own: int
    compressor: zstandard.ZstdCompressor

    @property
    def tag(self) -> bool:
        """A machine-readable identifier, which a hyphen would continue."""
        return self.words[:1] == ["spdx"]


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


class Scanner:
    def __init__(self, templates: tuple = TEMPLATES, *, most_share: float = 0.08, least_gain: float = 0.2, level: int = 12):
        self.options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**self.options)
        self.frame = self.size(b"")
        self.templates = [self.template(name, text) for name, text in templates]
        self.most_share, self.least_gain = most_share, least_gain
        #: Templates by the size of class: the power of two that holds the longest stretch that can be confirmed.
        self.classes: dict[int, list[int]] = {}
        for i, t in enumerate(self.templates):
            reach = len(t.words) + int(most_share * len(t.words))
            self.classes.setdefault(1 << max(2, (reach - 1).bit_length()), []).append(i)

    def template(self, name: str, text: str) -> Template:
        words = [w for w, _, _ in words_of(text)]
        data = " ".join(words).encode()
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return Template(name, text, words, self.size(data) - self.frame, zstandard.ZstdCompressor(dict_data=held, **self.options))

    def size(self, data: bytes) -> int:
        return len(self.alone.compress(data))

    def ranked(self, data: bytes, among: list[int]) -> list[tuple[int, int]]:
        """(bytes saved, template) of the winners, best first."""
        base = self.size(data)
        gains = [(base - len(self.templates[i].compressor.compress(data)), i) for i in among]
        return sorted(((g, i) for g, i in gains if g > 0 and g >= self.least_gain * self.templates[i].own), key=lambda x: (-x[0], x[1]))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """[from, to) of the candidate blocks: paragraphs (runs of lines that aren't blank) with a cue."""
        if not CUES.search(text) and not CUES.search(SPACES.sub(" ", text)):
            return []
        out, start, at, end = [], None, 0, 0
        for line in [*text.split("\n"), ""]:
            if line.strip():
                start, end = at if start is None else start, at + len(line)
            elif start is not None:
                # A cue may be wrapped as well, as "free\nsoftware".
                if CUES.search(SPACES.sub(" ", text[start:end])):
                    out.append((start, end))
                start = None
            at += len(line) + 1
        return out

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        found, blocks = [], self.blocks(text or "")
        for k, (a, b) in enumerate(blocks):
            block = text[a:b]
            words = words_of(block)
            for x, y, i, saved, differences in self.explain(block, words):
                found.append({"license": self.templates[i].license, "block": k, "char_from": a + words[x][1], "char_to": a + words[y - 1][2], "saved": saved, "differences": differences})
        return len(blocks), sorted(found, key=lambda n: (n["char_from"], n["license"]))

    def explain(self, block: str, words: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Stretches [x, y) of words with their template, its bytes saved and differing words."""
        found = set()
        for reach, among in self.classes.items():
            for a in range(0, max(1, len(words) - reach), reach):
                window = words[a : a + 2 * reach]
                if CUES.search(" ".join(w for w, _, _ in window)):
                    found |= {(x + a, y + a, *rest) for x, y, *rest in self.read(block, window, among)}
        out: list[tuple[int, int, int, int, int]] = []
        # Windows overlap; the view that saved more had the whole notice before it.
        for one in sorted(found, key=lambda f: (-f[3], f[2], f[0])):
            if all(one[1] <= f[0] or one[0] >= f[1] for f in out):
                out.append(one)
        return out

    def read(self, block: str, words: list[tuple[str, int, int]], among: list[int]) -> list[tuple[int, int, int, int, int]]:
        """Rounds over one window: rank, confirm the best, take out what it explains, compress the rest again."""
        parts, failed, out = [(0, len(words))], set(), []
        while parts:
            data = "\n".join(" ".join(w for w, _, _ in words[p:q]) for p, q in parts).encode("utf-8", "surrogatepass")
            for saved, i in self.ranked(data, among):
                # What did not fit before does not fit into less.
                places = [] if i in failed else self.places(block, words, parts, self.templates[i])
                if places:
                    break
                failed.add(i)
            else:
                return out
            out += [(x, y, i, saved, d) for x, y, d in places]
            failed.add(i)
            edges = [0, *(e for x, y, *_ in sorted(out) for e in (x, y)), len(words)]
            parts = [(p, q) for p, q in zip(edges[::2], edges[1::2]) if p < q]
        return out

    def places(self, block: str, words: list[tuple[str, int, int]], parts: list[tuple[int, int]], template: Template) -> list[tuple[int, int, int]]:
        found = [(p + x, p + y, d) for p, q in parts for x, y, d in self.confirm(words[p:q], template.words)]
        return [f for f in found if not (template.tag and CONTINUED.match(block, words[f[1] - 1][2]))]

    def confirm(self, words: list[tuple[str, int, int]], wanted: list[str]) -> list[tuple[int, int, int]]:
        """Stretches [x, y) of words that differ from the wanted ones in few enough words: those with the fewest
        differences first, then from left to right, then the shortest; of overlapping ones the first."""
        have, n, found = [w for w, _, _ in words], len(wanted), []
        slack = int(self.most_share * n)  # none for short notices, whose every word counts
        if len(have) < n - slack:
            return []
        # A stretch holds all but `slack` of the wanted words, and has n + slack words at most.
        pool, starts, told = set(wanted), set(wanted[: slack + 1]), telling(wanted)
        sums = np.concatenate(([0], np.cumsum([w in pool for w in have], dtype=np.int64)))
        ends = np.minimum(np.arange(len(have)) + n + slack, len(have))
        for k in np.nonzero(sums[ends] - sums[:-1] >= n - slack)[0].tolist():
            if have[k] in starts:
                for m, d in enumerate(word_distances(wanted, have[k : k + n + slack], slack)):
                    if m and d <= slack and telling(have[k : k + m]) == told:
                        found.append((d, k, k + m))
        out: list[tuple[int, int, int]] = []
        for d, x, y in sorted(found):
            if all(y <= p or x >= q for p, q, _ in out):
                out.append((x, y, d))
        return sorted(out)


def telling(words: list[str]) -> list[str]:
    """The words in order that tell the licence and its version."""
    return [w for before, w in zip(["", *words], words) if w in TELLING or w[0].isdigit() or (before, w) == ("gnu", "library")]


def word_distances(wanted: list[str], have: list[str], most: int) -> list[int]:
    """For every m, the least number of missing, added or changed words between wanted and the first m of have; more than most
    everywhere where that is certain early."""
    row = list(range(len(have) + 1))
    for i, x in enumerate(wanted, 1):
        new = [i]
        for j, y in enumerate(have, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return [most + 1] * len(row)
    return row


def scans(**options):
    made: list[Scanner] = []

    @F.pandas_udf(FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Scanner(**options))
        out = [made[0].scan(t) for t in texts]
        return pd.DataFrame({"n_blocks": [x[0] for x in out], "notices": pd.Series([x[1] for x in out], dtype=object)})

    return run


def with_notices(docs: DataFrame, name: str, *, text: str = "text", **options) -> DataFrame:
    """docs with one more column, of n_blocks and notices (licence, block, place in the text, bytes saved, differing
    words). The name must be new: no column is replaced."""
    if fresh(docs.columns, name)[0] != name:
        raise ValueError(f"there is a column {name} already")
    return docs.select("*", scans(**options)(F.col(f"`{text}`")).alias(name))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_blocks, n_notices, licenses (distinct, sorted, comma-joined; empty if none) and n_chars (in notices)."""
    found = with_notices(docs.select("doc_id", "text"), "found", **options).select("doc_id", "found.*")
    chars = F.aggregate("notices", F.lit(0).cast("bigint"), lambda s, x: s + x["char_to"] - x["char_from"])
    return found.select("doc_id", "n_blocks", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license"]))), ",").alias("licenses"), chars.alias("n_chars"))
