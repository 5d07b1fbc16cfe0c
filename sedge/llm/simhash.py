"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Two fingerprints link at `radius` or
fewer differing bits; linked texts form components. The search works on distinct fingerprints:

1. correlated bits are grouped into partitions, from a 64 x 64 table of bit co-occurrences. The number of partitions is
   that with the fewest probes and expected candidates for the number of fingerprints: three of some 21 bits up to about
   22 million, two of 32 beyond (34 probes with 2.3 candidates each at 10 billion);
2. every fingerprint gets its own thresholds t_i >= -1, one per partition, with sum(t_i) = radius - parts + 1. Any
   fingerprint within `radius` then differs by at most t_i in at least one partition. A dynamic program picks those
   with the fewest candidates, estimated from bounded tables of how many fingerprints share a hashed partition value: a cell
   that stands out from the mean of all cells holds a frequent value, any other value counts as one of evenly spread ones;
3. a partition with threshold t is probed with all values that differ by t bits or fewer; hits are verified;
4. where every choice would meet more than HUB_COST candidates beyond twice those of evenly spread values (a dense group
   of near copies), the fingerprint instead
   joins the 65 values within one bit of it. Two fingerprints differ by at most two bits exactly if they share such a
   value, so no link is lost and nothing is paired within a dense group. The share of such fingerprints does not grow with
   the table: what every fingerprint meets by chance is not taken for density.

Components come from alternating large-star and small-star steps on the links.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal texts share a
fingerprint, so copies never multiply; repeated rows each get a row; component_id is the smallest non-null id of the
component (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, fresh

RADIUS = 2
SEED = 42
#: Cells per partition in the tables of estimated counts; their size does not depend on the data.
CELLS = 1 << 18
#: Estimated candidates beyond which a fingerprint joins its one-bit neighbours instead of probing.
HUB_COST = 64
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[k : k + 4096], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(BITS[2 * counts > len(hashes)].sum(dtype=np.uint64))


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values.astype(np.uint64), "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(prints: DataFrame, parts: int) -> list[list[int]]:
    """Bits 0 to 63 in `parts` groups of nearly equal size, correlated bits together. Only a 64 x 64 table reaches the driver."""

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bit_matrix(batch["fp"].to_numpy()).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"cell": np.append(np.arange(4096), 4096), "n": np.append(total.reshape(-1), n)})

    got = {r["cell"]: r["n"] for r in prints.select("fp").mapInPandas(table, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = got.get(4096, 0) or 1
    both = np.array([got.get(k, 0) for k in range(4096)]).reshape(64, 64) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, -1)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        seed = max(left, key=lambda b: (sum(close[b][o] for o in left if o != b), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (sum(close[b][o] for o in group), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def chance_cost(n: int, parts: int, radius: int = RADIUS) -> float:
    """Probes and candidates of a fingerprint among n evenly spread ones, with the thresholds that allocate() would choose."""
    width, top = 64 // parts, radius - parts + 1
    if top <= 0:
        return (parts + top) * (1 + n / 2**width)
    probes = sum(math.comb(width, k) for k in range(top + 1)) + parts - 1
    return probes * (1 + n / 2**width)


def best_parts(n: int, radius: int = RADIUS) -> int:
    return min(range(2, radius + 2), key=lambda parts: (chance_cost(n, parts, radius), parts))


def _mask(group: list[int]) -> np.uint64:
    return BITS[group].sum(dtype=np.uint64)


def _cell(part: np.ndarray) -> np.ndarray:
    """Cell of a partition value; two multiplications, as the bits of a partition are sparse."""
    x = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(33)) % np.uint64(CELLS)


def part_counts(prints: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Fingerprints by hashed partition value: an upper estimate of how many share a value, of bounded size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().astype(np.uint64)
            for k, group in enumerate(groups):
                cells, n = np.unique(_cell(values & _mask(group)), return_counts=True)
                yield pd.DataFrame({"part": np.full(len(n), k, np.int32), "cell": cells.astype(np.int32), "n": n.astype(np.int64)})

    got = prints.select("fp").mapInPandas(count, "part int, cell int, n bigint").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    out = [np.zeros(CELLS, np.int64) for _ in groups]
    # A row per partition with a packed table, so that what reaches the driver has a fixed size.
    for row in got.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells")).toLocalIterator():
        cells = np.array([(c["cell"], c["n"]) for c in row["cells"]], np.int64)
        out[row["part"]][cells[:, 0]] = cells[:, 1]
    return out


def estimates(counts: list[np.ndarray], groups: list[list[int]], n: int) -> list[np.ndarray]:
    """Fingerprints expected to share a value of each cell: what stands out from the mean by six deviations, and chance."""
    mean, out = n / CELLS, []
    for c, g in zip(counts, groups, strict=True):
        chance = n / 2.0 ** len(g)
        # Cells differ by how many values they hold as well as by how often each occurs.
        out.append((np.where(c > mean + 6 * math.sqrt(mean * (1 + chance)) + 0.5, c - mean, 0) + chance).astype(np.float32))
    return out


def variants(values: np.ndarray, group: list[int], t: int) -> list[np.ndarray]:
    """The partition values within t differing bits of the given ones (all of them, by distance)."""
    base = values & _mask(group)
    out = [base]
    level: list[tuple[np.ndarray, int]] = [(base, -1)]
    for _ in range(t):
        level = [(v ^ BITS[group[k]], k) for v, last in level for k in range(last + 1, len(group))]
        out += [v for v, _ in level]
    return out


def allocate(values: np.ndarray, groups: list[list[int]], counts: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (rows by partition) with the least estimated candidates, and that estimate, for every fingerprint."""
    m, top = len(groups), radius - len(groups) + 1
    most = max(0, radius)
    cost = np.zeros((m, most + 2, len(values)))  # index t + 1
    for i, group in enumerate(groups):
        # Thresholds beyond 1 cost width^2 probes; they are only priced where fewer partitions need them.
        for t in range(most + 1):
            cost[i, t + 1] = np.inf if t > max(1, top) else sum(counts[i][_cell(v)] for v in variants(values, group, t)) + len(variants(values[:1], group, t)) - 1
    # best[s]: least cost over the partitions so far whose thresholds sum to s - m.
    sums = range(-m, top + 1)
    best = {0: np.zeros(len(values))}
    choice: list[dict[int, np.ndarray]] = []
    for i in range(m):
        now: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s, before in best.items():
            for t in range(-1, most + 1):
                if s + t > top + (m - 1 - i):
                    continue
                value = before + cost[i, t + 1]
                if s + t not in now:
                    now[s + t], pick[s + t] = value.copy(), np.full(len(values), t)
                else:
                    better = value < now[s + t]
                    now[s + t][better], pick[s + t][better] = value[better], t
        best, _ = now, choice.append(pick)
    assert top in sums
    at, out = np.full(len(values), top), np.zeros((len(values), m), np.int64)
    for i in reversed(range(m)):
        for s in np.unique(at):
            rows = at == s
            out[rows, i] = choice[i][s][rows]
        at = at - out[:, i]
    return out, best[top]


def links(prints: DataFrame, *, radius: int = RADIUS, parts: int | None = None, hub_cost: int = HUB_COST) -> DataFrame:
    """Links (a < b) that connect the fingerprints of column fp exactly as all pairs within the radius would.

    parts: number of partitions, by default the cheapest for the number of fingerprints.
    """
    if radius != 2:
        raise ValueError("the dense-group fallback is exact for a radius of 2")
    spark, n = prints.sparkSession, prints.count()
    parts = parts or best_parts(n, radius)
    groups, most = group_bits(prints, parts), hub_cost + 2 * chance_cost(n, parts, radius)
    counts = spark.sparkContext.broadcast(estimates(part_counts(prints, groups), groups, n))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            values = batch["fp"].to_numpy().astype(np.uint64)
            thresholds, estimate = allocate(values, groups, counts.value, radius)
            dense = estimate > most
            rows = []
            for i, group in enumerate(groups):
                for t in range(radius + 1):
                    chosen = values[(thresholds[:, i] == t) & ~dense]
                    if len(chosen):
                        rows += [(i, v, chosen) for v in variants(chosen, group, t)]
            chosen = values[dense]
            if len(chosen):
                rows.append((-1, chosen, chosen))
                rows += [(-1, chosen ^ bit, chosen) for bit in BITS]
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pd.DataFrame({"part": np.concatenate([np.full(len(f), i, np.int32) for i, _, f in some]), "key": np.concatenate([k for _, k, _ in some]).astype(np.int64), "a": np.concatenate([f for _, _, f in some]).astype(np.int64)})

    probes = cut(prints.select("fp").mapInPandas(plan, "part int, key bigint, a bigint"))
    home = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(int(np.int64(_mask(g).astype(np.int64))))).alias("key")) for i, g in enumerate(groups)])).alias("h"), F.col("fp").alias("b"))
    home = home.select("h.part", "h.key", "b")
    met = probes.where("part >= 0").join(home, ["part", "key"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A hub value has at most 65 fingerprints within one bit, so its list is short.
    hubs = probes.where("part < 0").groupBy("key").agg(F.array_sort(F.collect_set("a")).alias("near")).where(F.size("near") > 1)
    star = hubs.select(F.element_at("near", 1).alias("a"), F.explode(F.slice("near", 2, 64)).alias("b"))
    return met.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of the edges (a, b), by large-star and small-star steps."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: of each node's smaller neighbours, the least becomes the root of the others and of the node.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def classify(prints: DataFrame, **options) -> DataFrame:
    """fp, root for the linked fingerprints of column fp."""
    return components(links(prints, **options)).select(F.col("node").alias("fp"), "root")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = cut(docs.select("doc_id", fingerprint_udf("text").alias("fp")))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = prints.join(classify(prints, **options), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = found.join(found.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """One document of every component: that with the smallest id (nulls last), ties by a hash of the row; equal rows leave one."""
    fp, row = fresh(docs.columns, "fp", "row_hash")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    known = docs.withColumn(row, F.xxhash64(*hashed))
    marked = cut(known.select(F.col(f"`{id_column}`").alias("id"), F.col(row).alias("row"), fingerprint_udf(F.col(f"`{text}`")).alias("fp")))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    prints = cut(marked.groupBy("fp").agg(F.min(rank).alias("first")))
    found = prints.join(classify(prints, **options), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = found.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.row")
    # Rows meet by their hash alone, so that the last step needs no second shuffle of the texts; ids are compared besides.
    left, right = known.alias("l"), kept.alias("r")
    own, other = F.col(f"l.`{id_column}`"), F.col("r.id")
    same_id = F.coalesce(own == other, own.isNull() & other.isNull())
    return left.join(right, (F.col(f"l.`{row}`") == F.col("r.row")) & same_id, "left_semi").dropDuplicates([row, id_column]).drop(row)
