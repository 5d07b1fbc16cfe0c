"""Operators with exact contracts against plain versions, on small tables with nulls, repeats, ties and clashing names."""

import base64
import hashlib
import random
import re
from dataclasses import dataclass

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.llm import compression_bands, decontaminate, license_scan, license_texts, mixing, simhash, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2, 3, 8, 30, 90]))) for _ in range(n)]
    return [*out, None, "", " \n\t ", out[5], out[6] + " tail", "Ünïcode Wörter nicht getrennt" * 3, "A" * 5000, "x " * 4000]


def documents(spark, rows=None, extra=""):
    rows = texts() if rows is None else rows
    data = [(k if k % 13 else 7, t, "en", None if k % 5 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(rows)]
    data += data[-3:]
    df = spark.createDataFrame(data, DOCS)
    for name in ("fp", "hits", "score", "root", "id", "text_hash", "row_hash", "size", "bucket", "s"):
        df = df.selectExpr("*", f"'{extra}' AS {name}") if extra else df
    return df


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in keys}


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(3)
    long = [rng.choices(WORDS, k=200) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.01 else rng.choice(WORDS) for w in base) for base in long for _ in range(12)]
    df = documents(spark, texts() + near)
    rows = [r.asDict() for r in df.collect()]
    want = {id(r): plain_fingerprint(r["text"]) for r in rows}
    roots = plain_components(set(want.values()))
    least = {}
    for r in rows:
        root = roots[want[id(r)]]
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    expected = sorted((r["doc_id"], f"{want[id(r)]:016x}", least[roots[want[id(r)]]]) for r in rows)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(df).collect()) == expected


@pytest.mark.parametrize("hub_cost", [-1, 3, 10**9])
def test_simhash_links_lose_nothing(spark, hub_cost):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for f in list(prints)[:8]:
        prints |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(20)}
    as_signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(as_signed(f),) for f in prints], "fp bigint")
    got = {r["fp"]: r["root"] for r in simhash.classify(df, hub_cost=hub_cost).collect()}
    want = plain_components(prints)
    mine = {f: got.get(as_signed(f), as_signed(f)) for f in prints}
    assert len({(want[f], mine[f]) for f in prints}) == len(set(want.values())) == len(set(mine.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_keep_one_leaves_a_row_per_component(spark):
    df = documents(spark, extra="clash")
    kept = simhash.keep_one(df)
    comps = set(plain_components({plain_fingerprint(r["text"]) for r in df.collect()}).values())
    assert kept.columns == df.columns and kept.count() == len(comps)
    assert set(kept.collect()) <= set(df.collect())


# Decontamination


def plain_hits(text, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for item, value in items:
        w = split(value)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("index_bytes, bloom_bits", [(1 << 20, 64), (600, 1 << 20), (600, 256), (0, 64)])
def test_decontamination(spark, index_bytes, bloom_bits):
    """By the broadcast index, and by the filter and the table of windows, whether or not the filter tells anything."""
    limits = {"index_bytes": index_bytes, "bloom_bits": bloom_bits}
    rng = random.Random(2)
    base = texts()
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([2, 12, 13, 20])))) for k in range(6)] + [(9, None), (None, "alpha beta gamma"), (10, "!!"), (3, "omi pi rho sig")]
    base += [f"{items[k][1].upper()}-{base[k + 3]}" for k in range(6)] + [" ".join(rng.choices(WORDS, k=400)) + " omi, pi rho SIG"]
    df, bench = documents(spark, base), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((r["doc_id"], *plain_hits(r["text"], items)) for r in df.collect())
    assert sorted(tuple(r) for r in decontaminate.report(df, bench, **limits).collect()) == want
    kept = decontaminate.drop_contaminated(documents(spark, base, "clash"), bench, **limits)
    assert kept.count() == sum(not x[-1] for x in want)
    items_table = bench.selectExpr("CAST(item_id AS STRING) AS item", "text").where("text IS NOT NULL")
    assert (decontaminate._index(items_table, 13, index_bytes) is None) == (index_bytes < 1 << 20)
    cleaned = decontaminate.strip_contamination(df, bench, **limits)
    left = sorted((r["doc_id"], len(decontaminate.words_of(r["text"]))) for r in cleaned.collect())
    assert left == sorted((x[0], x[1] - x[2]) for x in want)


def test_empty_benchmark_and_empty_documents(spark):
    df, bench = documents(spark), spark.createDataFrame([], "item_id bigint, text string")
    wordless = spark.createDataFrame([(1, "!!"), (2, None), (3, "")], "item_id bigint, text string")
    for empty in (bench, wordless):
        for index_bytes in (decontaminate.INDEX_BYTES, -1):
            assert decontaminate.report(df, empty, index_bytes=index_bytes).where("n_hit > 0 OR contaminated").isEmpty()
    none = spark.createDataFrame([], DOCS)
    assert decontaminate.report(none, bench).isEmpty() and simhash.report(none).isEmpty() and mixing.report(none).isEmpty() and compression_bands.report(none).isEmpty() and license_scan.report(none).isEmpty()
    assert simhash.keep_one(none).isEmpty()


# Compression bands


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


SAMPLES = [*texts(), "a\nb\na\n\n\na ", "#*$ %&|<> ok\r\n" * 3, "one two three four one two three", "\n".join(["same line"] * 5 + ["  "] * 3)]


def test_measures_equal_plain_ones(spark):
    small = [t for t in SAMPLES if len(t or "") < 3000]
    got = compression_bands.report(documents(spark, small)).collect()
    want = sorted((r["doc_id"], *plain_measures(r["text"])) for r in documents(spark, small).collect())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[n] for n in names) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#é", max_size=60))
def test_measures_of_any_text(text):
    found = compression_bands.measure(text, compression_bands.Bands())
    assert found[:5] == plain_measures(text)[:5]


def test_kept_is_base_and_bands_recomputed(spark):
    import zstandard

    rng = random.Random(12)
    junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(900))
    many = [*SAMPLES[:40], junk, base64.b64encode(rng.randbytes(3000)).decode().replace("/", " ").replace("a", " "), "日本語の文章です。" * 3 + "".join(chr(0x4E00 + rng.randrange(3000)) + (" " if k % 9 == 0 else "") for k in range(2500))]
    c = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    limits = lambda bands, n: [b for b in bands if n >= b[0]][-1][1:]

    def plain(text):
        data = (text or "").encode()
        if plain_measures(text)[-1]:
            return False
        scale = compression_bands.DENSE if sum(b > 127 for b in data) * 2 > len(data) else 1
        inside = lambda part, bands: limits(bands, len(part))[0] <= len(c.compress(part)) / len(part) <= limits(bands, len(part))[1] * scale
        parts = [data[k : k + 4096] for k in range(0, len(data), 4096)]
        return inside(data, compression_bands.WHOLE_BANDS) and 4 * sum(len(p) for p in parts if not inside(p, compression_bands.CHUNK_BANDS)) <= len(data)

    df = documents(spark, many, "clash")
    want = sorted((r["doc_id"], plain(r["text"])) for r in df.collect())
    assert sorted((r["doc_id"], r["kept"]) for r in compression_bands.report(df).collect()) == want
    assert compression_bands.keep_good(df).columns == df.columns and not plain(junk) and plain(many[-1])
    with pytest.raises(ValueError):
        compression_bands.with_quality(df, "SCORE")


def test_bands_reject_repetition_and_noise():
    bands, rng = compression_bands.Bands(), random.Random(1)
    prose = " ".join("".join(rng.choices(["th", "an", "er", "ing", "on", "ed", "re", "ly", "es", "ha"], k=rng.randint(1, 5))) for _ in range(900))
    noise = base64.b85encode(rng.randbytes(6000)).decode()
    verdict = lambda t: bands.verdict(t.encode())[-1]
    assert verdict(prose) and not verdict("again and " * 600) and not verdict(noise) and verdict("") and verdict("short one")
    assert not verdict(prose + "again and " * 900)


# Mixing


@dataclass
class Target:
    source: str | None
    size: int
    target: float


def plain_targets(sizes, weights=mixing.WEIGHTS, share=1.5, most=2.0):
    """Targets of the sources (by code point, null last): shares of `share` times all sizes by repeating weights, none above `most` times its size."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(ordered))]
    limit = [most * n for _, n in ordered]
    left, open_, out = share * sum(n for _, n in ordered), set(range(len(ordered))), [0.0] * len(ordered)
    while open_:
        total = sum(weight[k] for k in sorted(open_))
        over = {k for k in open_ if left * weight[k] / total > limit[k]}
        if not over:
            for k in open_:
                out[k] = left * weight[k] / total
            break
        for k in sorted(over):
            out[k] = float(limit[k])
            left -= limit[k]
        open_ -= over
    return [Target(s, n, t) for (s, n), t in zip(ordered, out, strict=True)]


def test_targets_share_by_weight_up_to_the_limit():
    found = plain_targets([("b", 10), (None, 100), ("a", 50), ("c", 40)])
    assert [t.source for t in found] == ["a", "b", "c", None]
    assert [t.target for t in found] == [100.0, 20.0, 72.0, 108.0]
    assert sum(t.target for t in found) == 1.5 * 200
    assert plain_targets([]) == [] and plain_targets([("a", 0)])[0].target == 0


def test_mix_is_whole_near_target_and_repeatable(spark):
    df = documents(spark, texts(n=300), "clash")
    rows = mixing.report(df).collect()
    again = mixing.report(df.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    plain = sorted((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect())
    assert sorted((r["doc_id"], r["size"]) for r in rows) == plain
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size
        assert abs(sum(r["taken"] for r in own) - target) <= max(0.05 * target, 130)


def test_sources_of_any_number_get_the_same_targets(spark, monkeypatch):
    rng = random.Random(8)
    sizes = [(f"s{k}", rng.choice([0, 1, 5, 60, 4000])) for k in range(200)] + [(None, 70)]
    rows = mixing.source_table(spark.createDataFrame([(x, n, 3) for x, n in sizes], "source string, n bigint, docs bigint")).orderBy("s").collect()
    want = plain_targets(sizes)
    assert [(r["source"], r["s"], r["source_size"]) for r in rows] == [(t.source, k, t.size) for k, t in enumerate(want)]
    assert [r["target"] for r in rows] == pytest.approx([t.target for t in want])
    assert rows[0]["slot_from"] == 0 and all(a["slot_to"] == b["slot_from"] for a, b in zip(rows, rows[1:]))
    assert all(abs(r["slot_to"] - r["slot_from"] - t.target * r["n_blocks"] / max(1, t.size)) <= 1 for r, t in zip(rows, want))
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts(n=40))], DOCS)
    broadcast = sorted(map(tuple, mixing.report(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.report(df).collect())) == broadcast


def test_more_sources_than_fit_a_driver_table(spark):
    df = spark.range(20_100).selectExpr("id AS doc_id", "'one two three' AS text", "'en' AS lang", "concat('site', id, '.example') AS source", "13L AS n_chars")
    found = mixing.report(df).selectExpr("count(*) AS n", "sum(size) AS size", "sum(target) AS target", "max(taken) AS most", "count_if(taken > 0) AS some", "count(DISTINCT source_size) AS sizes").first()
    assert found["n"] == 20_100 and found["size"] == 60_300 and found["sizes"] == 1
    assert found["target"] == pytest.approx(1.5 * 60_300)
    # Sources of a single block: slots are drawn by chance, and none is taken more than twice.
    assert found["most"] == 6 and found["some"] > 12_000


def test_shard_counts_are_multinomial_and_slots_are_a_permutation(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(20 + id % 60 as int)) AS text", "'en' AS lang", "concat('s', id % 7) AS source", "0L AS n_chars")
    mix = mixing.plan(df, block_words=4, shard_slots=512)
    slots, sources = mix.slots.collect(), mix.sources.collect()
    total = max(r["slot_to"] for r in sources)
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == total > 40 * 512
    for r in sources:
        mine = [x["block"] for x in slots if x["s"] == r["s"]]
        times = [mine.count(b) for b in set(mine)]
        assert len(mine) == r["slot_to"] - r["slot_from"] and max(times) - min(times) <= 1 and (max(times) == 1 or len(times) == r["n_blocks"])
    full, chi = total // 512, 0.0
    for r in sources:
        p = (r["slot_to"] - r["slot_from"]) / total
        counts = [0] * full
        for x in slots:
            if x["s"] == r["s"] and x["shard"] < full:
                counts[x["shard"]] += 1
        chi += sum((c - 512 * p) ** 2 / (512 * p) for c in counts)
    # Chi-square over its degrees of freedom: 1 for multinomial counts, near 0 for systematic ones.
    assert 0.75 < chi / ((len(sources) - 1) * (full - 1)) < 1.3


def test_mixed_blocks_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "en", "x", 0), (1, "d e", "en", "x", 0), (None, "f g h i", "en", "y", 0), (None, None, "en", "y", 0), (1, "a b c", "en", "x", 0)]
    df = spark.createDataFrame(rows, DOCS)
    taken = sum(r["taken"] for r in mixing.report(df, block_words=2).collect())
    assert sum(len(b["text"].split()) for b in mixing.mixed_blocks(df, block_words=2).collect()) == taken > 0


def test_permutations_are_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1023):
        got = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3), F.lit(n)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != list(range(n))


def test_mixed_blocks_hold_the_words_taken(spark):
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts(n=40))], DOCS)
    taken = sum(r["taken"] for r in mixing.report(df).collect())
    blocks = mixing.mixed_blocks(df).collect()
    assert sum(len(b["text"].split(" ")) for b in blocks) == taken
    assert len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks)


# WARC


def page_rows():
    return [(3, "http://a/1", "<p>ä same</p>"), (1, "http://a/2", "<p>ä same</p>"), (2, "http://a/3", None), (8, "http://a/4", ""), (5, None, "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "long " * 5000), (1, "http://a/2", "<p>ä same</p>")]


def test_warc_report(spark):
    df = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    first = {}
    for k, _, h in page_rows():
        first[h or ""] = min(first.get(h or "", k), k)
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = sorted((k, len((h or "").encode()), sha(h or ""), "response" if first[h or ""] == k else "revisit", None if first[h or ""] == k else first[h or ""]) for k, _, h in page_rows())
    assert sorted(map(tuple, warc.report(df).collect()), key=lambda r: r[:4]) == want


def test_warc_payloads_filters_and_partitions(spark, tmp_path):
    df = spark.createDataFrame(page_rows()[:5], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.with_revisits(df), path)
    (tmp_path / "w" / "lost-attempt.warc.gz").write_bytes(b"never committed")
    back = warc.read_archive(spark, path, partition_bytes=1)
    page = warc.page_of(F.col("record_id")).cast("bigint").alias("page")
    got = {r["page"]: r["payload"] for r in back.select(page, "payload").collect()}
    assert got[5] == page_rows()[4][2] and got[1] == "<p>ä same</p>" and got[3] == ""
    kept = back.where("record_type = 'revisit'")
    assert sorted(r["page"] for r in kept.select(page).collect()) == [3, 8]
    assert back.where("target_uri IN ('http://a/2', 'x')").count() == 1
    # The predicate is left to the source: no filter runs after the scan.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "record_type" in plan
    assert all(r["payload"] is None for r in warc.read_archive(spark, path, payload=False).collect())


def test_warc_members_are_plain_gzip(tmp_path):
    import gzip

    data = b"WARC/1.1\r\n" * 1000
    assert gzip.decompress(warc.member(data) + warc.member(b"x")) == data + b"x"


RECORD = "WARC/1.1\r\nWARC-Type: {0}\r\nWARC-Record-ID: <urn:x:{1}>\r\nWARC-Target-URI: http://h/{1}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {2}\r\n\r\n{3}\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "member per record", "one member"])
def test_foreign_archives_read(spark, tmp_path, form):
    import gzip

    bodies = ["first\r\n\r\nbody", "", "third " * 30000]
    data = [RECORD.format("response" if k != 1 else "metadata", k, len(b), b).encode() for k, b in enumerate(bodies)]
    content = b"".join(data) if form == "plain" else gzip.compress(b"".join(data)) if form == "one member" else b"".join(map(gzip.compress, data))
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(content)
    (tmp_path / "other.txt").write_text("no archive")
    back = warc.read_archive(spark, f"file://{tmp_path}")
    assert [(r["record_id"], r["payload"]) for r in back.orderBy("record_id").collect()] == [(f"<urn:x:{k}>", b) for k, b in enumerate(bodies)]
    assert [r["target_uri"] for r in back.where("record_type = 'response'").orderBy("target_uri").collect()] == ["http://h/0", "http://h/2"]
    assert [r["payload"] for r in warc.read_archive(spark, f"file://{tmp_path}", payload=False).collect()] == [None] * 3


def test_written_records_have_all_headers_and_ids_of_their_own(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(5, "http://a/5", "one"), (5, "http://a/5", "two"), (None, None, "three")], "page_id bigint, url string, html string")
    warc.write_archive(warc.with_revisits(df), f"file://{tmp_path}/w")
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in (tmp_path / "w").glob("*.warc.gz"))
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        assert len(re.findall(rf"^{name}: \S", text, re.M)) == 3
    assert len(set(re.findall(r"^WARC-Record-ID: (\S+)", text, re.M))) == 3


def test_damaged_archives_stop_the_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/1", "text of a page " * 50)], "page_id bigint, url string, html string")
    warc.write_archive(warc.with_revisits(df), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data = bytearray(file.read_bytes())
    data[-20] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception):
        warc.verified(warc.read_archive(spark, f"file://{tmp_path}/w")).collect()


def test_many_revisits_meet_pages_by_a_bit_set(spark, monkeypatch):
    rows = [(k, f"http://a/{k}", f"text {k % 40 if k % 3 else k}") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    few = sorted(map(tuple, warc.report(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    assert sorted(map(tuple, warc.report(df).collect())) == few and len(few) == 300


def test_warc_ids_of_any_text_come_back(spark):
    ids = ["", None, " a ", "a\nb", "a\r\nb", "100%", "%0A", "%250A", "x:y>", "ü"]
    df = spark.createDataFrame([(x, "http://h/", f"page {k}") for k, x in enumerate(ids)] + [("z", "http://h/", "page 3")], "page_id string, url string, html string")
    got = warc.report(df).collect()
    assert sorted((r["page_id"] for r in got), key=repr) == sorted([*ids, "z"], key=repr)
    assert [r["refers_to"] for r in got if r["record_type"] == "revisit"] == ["a\nb"]


def test_warc_of_no_pages(spark):
    assert warc.report(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()


def test_warc_keeps_both_payloads_of_a_recrawled_page(spark, tmp_path):
    rows = [(1, "http://a/1", "one"), (2, "http://a/2", "two"), (5, "http://a/5", "one"), (5, "http://a/5", "only here"), (6, "http://a/6", "one"), (6, "http://a/6", "two")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.report(df).collect())
    assert [x[:2] for x in got] == [(1, 3), (2, 3), (5, 3), (5, 9), (6, 3), (6, 3)]
    assert [x[2] for x in got] == ["response", "response", "revisit", "response", "revisit", "revisit"]
    assert [x[3] for x in got if x[3]] == [1, 1, 2]
    warc.write_archive(warc.with_revisits(df), f"file://{tmp_path}/w")
    assert sorted(r["payload"] for r in warc.read_archive(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()) == ["one", "only here", "two"]


@pytest.mark.parametrize("digest, size", [(None, 4), ("A" * 32, 4), ("right", 5)])
def test_warc_payloads_are_verified(spark, tmp_path, digest, size):
    right = base64.b32encode(hashlib.sha1(b"page").digest()).decode()
    rows = [("<urn:page:1>", "response", "http://a/", None, right if digest == "right" else digest, size, "page")]
    warc.write_archive(spark.createDataFrame(rows, warc.SCHEMA), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="payload differs from its headers"):
        warc.verified(warc.read_archive(spark, f"file://{tmp_path}/w")).collect()


# Licences


def test_license_scan_finds_exact_wording(spark):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."),
        (2, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 4."),
        (4, "We had a license to drive."), (5, None), (6, ""),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
        (8, "licensed   UNDER the apache license, version 2.0"),
    ]
    got = {r["doc_id"]: (r["n_blocks"], r["licenses"]) for r in license_scan.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "CC-BY-NC-4.0,GPL-3.0"), 3: (1, ""), 4: (1, ""), 5: (0, ""), 6: (0, ""), 7: (1, "MIT"), 8: (1, "Apache-2.0")}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_stretches(have, wanted, share=0.08):
    """All places and lengths, without any shortcut."""
    slack, found, out = int(share * len(wanted)), [], []
    for x in range(len(have)):
        for y in range(x + 1, min(len(have), x + len(wanted) + slack) + 1):
            part = have[x:y]
            if part[0] in wanted[: slack + 1] and license_scan.telling(part) == license_scan.telling(wanted) and (d := plain_distance(part, wanted)) <= slack:
                found.append((d, x, y))
    for d, x, y in sorted(found):
        if all(y <= p or x >= q for p, q, _ in out):
            out.append((x, y, d))
    return sorted(out)


def test_confirmed_stretches_equal_brute_force():
    rng, scanner = random.Random(3), license_scan.Scanner()
    for k in range(30):
        words = []
        for _, text in rng.sample(license_scan.TEMPLATES, 3):
            own = [w for w, _, _ in license_scan.words_of(text)][:26]
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(["other", "license", "the", "gnu"])
            words += own + ["between"] * rng.randint(0, 2)
        wanted = [w for w, _, _ in license_scan.words_of(rng.choice(license_scan.TEMPLATES)[1])][:26]
        assert scanner.confirm([(w, 0, 0) for w in words], wanted) == plain_stretches(words, wanted)


def test_every_notice_of_a_block_is_found():
    scanner = license_scan.Scanner()
    for more in (0, 60):
        block = "\n".join([text for _, text in license_scan.TEMPLATES] + [f"one more license cue, number {k}" for k in range(more)])
        n, found = scanner.scan(block)
        assert n == 1 and [x["license"] for x in found] == [name for name, _ in license_scan.TEMPLATES]
    assert {x["license"] for x in scanner.scan("The contents of this file are subject to the Mozilla Public License Version 1.1")[1]} == {"MPL-1.1"}


def test_license_scan_of_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, "x " * 40000 + "\n\n" + notice + "\n" + notice), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS found", "2 AS notices", "3 AS n_blocks")
    got = sorted((r["doc_id"] or 0, r["n_notices"], r["licenses"]) for r in license_scan.report(df).collect())
    assert got == [(0, 0, ""), (1, 1, "MIT"), (1, 1, "MIT"), (2, 2, "MIT"), (3, 0, "")]
    assert license_scan.with_notices(df, "seen").columns == [*df.columns, "seen"]


MIT_WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom it is furnished to do so."""
GNU = """This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2} as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("text, license", [
    (MIT_WRAPPED, "MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. More.", "MPL-2.0"),
    ("To the extent possible under law, the author has\nwaived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("To the extent possible under law, the author has waived all\ncopyright and related or neighboring rights to this work.", "CC0-1.0"),
    (GNU.format("program", ":", "General Public License", ",", "3"), "GPL-3.0"),
    (GNU.format("program", ";", "General Public License", ";", "2"), "GPL-2.0"),
    (GNU.format("library", ";", "Lesser General Public License", ";", "2.1"), "LGPL-2.1"),
    (GNU.format("program", ":", "Lesser General Public License", ",", "3"), "LGPL-3.0"),
    (GNU.format("program", ":", "Affero General Public License", ",", "3"), "AGPL-3.0"),
    (GNU.format("library", ":", "General Public License", ",", "3"), "GPL-3.0"),
    (GNU.format("program", ":", "General Public License", ",", "4"), ""),
    (GNU.format("library", ";", "Library General Public License", ";", "2"), ""),
])
def test_wrapped_notices_and_their_versions(text, license):
    scanner = license_scan.Scanner()
    n, found = scanner.scan(f"Before it.\n\n{text}\n\nAfter it.")
    assert n == 1 and {x["license"] for x in found} == ({license} if license else set())


@pytest.mark.parametrize("text, license", [
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("SPDX-License-Identifier: MIT-Modern-Variant", ""),
    ("Licensed under Creative Commons Attribution 4.0 International.", "CC-BY-4.0"),
    ("Licensed under Creative Commons Attribution-ShareAlike 4.0 International.", "CC-BY-SA-4.0"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at", "EPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
])
def test_tags_and_notices_of_whole_texts(text, license):
    filler = " ".join(random.Random(1).choices(WORDS, k=300))
    for around in ("{}", "before it\n{}\nafter it", f"{filler}\n{{}}\n{filler}"):
        n, found = license_scan.Scanner().scan(around.format(text))
        assert n == 1 and [x["license"] for x in found] == ([license] if license else [])


def test_whole_texts_are_found_by_paragraphs():
    scanner = license_scan.Scanner()
    for name, text in license_texts.TEXTS:
        found = scanner.scan(text)[1]
        assert {x["license"] for x in found} == {name} and len(found) == len(text.strip().split("\n\n"))
    assert all(license_scan.CUES.search(" ".join(t.words)) for t in scanner.templates)


def test_ranking_by_compression_decides():
    """Of templates that fit the same words the one that saves most counts; templates that save too little are never confirmed."""

    class Reversed(license_scan.Scanner):
        def ranked(self, data, among):
            return super().ranked(data, among)[::-1]

    # Both templates fit within the allowed differences; the words between decide which one saves more.
    one = "This tool may be copied, sold and changed under the house license by all who keep this notice of the first maker in it and name the place"
    two = one.replace("first maker", "second maker")
    pair, texts = (("One", one), ("Two", two)), {"One": one, "Two": two}
    for name, text in texts.items():
        assert [x["license"] for x in license_scan.Scanner(pair).scan(text)[1]] == [name]
        assert [x["license"] for x in license_scan.Scanner(pair[::-1]).scan(text)[1]] == [name]
        assert [x["license"] for x in Reversed(pair).scan(text)[1]] != [name]
        assert license_scan.Scanner(pair, least_gain=9.0).scan(text)[1] == []


def test_license_scan_equals_all_templates_at_all_places():
    """Without ranking, classes and windows: every template is tried at every place of the whole block."""
    rng, scanner = random.Random(8), license_scan.Scanner()
    for _ in range(12):
        pieces = [" ".join(rng.choices(WORDS, k=rng.randint(0, 90)))]
        for _ in range(rng.randint(1, 6)):
            own = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(["other", "the", "gnu"])
            pieces += [" ".join(own), " ".join(rng.choices(WORDS, k=rng.randint(1, 90)))]
        block = "\n".join(pieces)
        words = license_scan.words_of(block)
        every = {(words[x][1], words[y - 1][2], t.license) for t in scanner.templates for x, y, _ in scanner.places(block, words, [(0, len(words))], t)}
        found = {(f["char_from"], f["char_to"], f["license"]) for f in scanner.scan(block)[1]}
        assert found <= every
        for a, b, name in every - found:  # what is left out shares words with what is found
            assert any(a < q and b > p for p, q, _ in found), name


def test_short_articles_beside_long_ones_stay():
    from sedge.llm import site_style

    long, short = " ".join(f"word{k}" for k in range(300)), "A short second piece."
    page = f"<html><body><nav>menu</nav><main><article><p>{long}</p></article><article><p>{short}</p></article></main><footer>foot</footer></body></html>"
    assert site_style.extract(site_style.blocks(page), {}) == f"{long}\n{short}"
