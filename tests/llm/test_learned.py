"""Operators that learn: held-out accuracy, plain versions of their sums, odd input, and whole-page extraction."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import language_id, rule_ensemble, site_style, toxicity
from sedge.session import table

SMALL = "/root/testdata/sf0.01"
ODD = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, " 12 !! ", None), (4, "word " * 20000, "en"), (4, "word " * 20000, "en"), (5, "a" * 30000, "en"), (6, "ordinary words in a row", "en")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(1))


def auc(y, x):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(x, y) if p == 1 for b, q in zip(x, y) if q == 0]
    return sum(pairs) / len(pairs)


def test_held_out_is_crc32_mod_5(spark):
    from sedge.llm.common import held_out

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


# Language


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SMALL, "documents")
    rows = docs.select("doc_id", "lang").join(language_id.report(docs), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_documents_have_a_language_or_none(spark):
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.report(odd(spark)).collect())
    assert got == Counter([(None, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en"), (6, "en")])
    kept = language_id.keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6]
    assert language_id.report(spark.createDataFrame([], "doc_id bigint, text string, lang string")).isEmpty()
    nobody = spark.createDataFrame([(1, "words here", None)], "doc_id bigint, text string, lang string")
    assert language_id.report(nobody).first()["lang_pred"] == "und"


def test_forward_sums_are_sums_over_all_segmentations():
    rng = random.Random(1)
    pieces = sorted({language_id.START, "a", "b", "ab", "ba", "aba", language_id.START + "a", language_id.START + "ab", "bb"})
    p = np.array([[rng.random() for _ in pieces] for _ in range(2)])
    p /= p.sum(axis=1, keepdims=True)
    scorer = language_id.Scorer(pieces, ["x", "y"], p, np.array([0.5, 0.5]))

    def plain(word, lang):
        spelled, total = language_id.START + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(spelled) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(spelled)]
            parts = [spelled[a:b] for a, b in zip([0, *ends], ends)]
            total += math.prod(p[lang][pieces.index(x)] if x in pieces else language_id.UNKNOWN if len(x) == 1 else 0.0 for x in parts)
        return math.log(total)

    words = ["a", "ab", "abab", "bbaba", "cab", "ababbaab"]
    found = scorer.short_words(words)
    for w, row in zip(words, found):
        assert row == pytest.approx([plain(w, 0), plain(w, 1)])
        assert scorer.long_word(w) == pytest.approx(row)
    assert np.isfinite(scorer.long_word("ab" * 20000)).all()


def test_expected_counts_match_enumeration():
    pieces = [language_id.START, "a", "b", "ab"]
    tree, p = language_id.prefixes(pieces), np.array([0.1, 0.2, 0.3, 0.4])
    got = language_id.expected(Counter({"ab": 2}), tree, p)
    whole, split = 0.1 * 0.4, 0.1 * 0.2 * 0.3
    assert got == pytest.approx(2 * np.array([1.0, split / (whole + split), split / (whole + split), whole / (whole + split)]))


# Toxicity


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.report(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 700 and sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95
    assert auc([r["toxic"] for r in rows], [r["score"] for r in rows]) > 0.94


def test_toxicity_without_labels_and_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    rows = toxicity.report(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    some = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (6, 1)], "doc_id bigint, toxic int")
    rows = toxicity.report(odd(spark), some).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.keep_ordinary(odd(spark), labels)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_distances_are_means_of_length_differences():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(400)]
    ordinary, toxic = [" ".join(words[k : k + 40]).encode() for k in (0, 40, 80)], [" ".join(words[k : k + 40]).encode() for k in (200, 240, 280)]
    pairs = list(zip(ordinary, toxic))
    d = toxicity.Distances(pairs)
    for w in (words[45], words[205], words[290], "never", "x"):
        data = b" " + w.encode() + b" " + toxicity.CARRIER
        saved = [len(toxicity._compressor(a).compress(data)) - len(toxicity._compressor(b).compress(data)) for a, b in pairs]
        assert d.window(w.encode()) == toxicity.PARTS * toxicity.FAR + max(-48, min(48, round(6 * sum(saved) / len(pairs))))
    counts = np.array([d.counts(" ".join(words[200:220])), d.counts(" ".join(words[0:20]))])
    middle = toxicity.PARTS * toxicity.FAR
    assert counts.sum(axis=1).tolist() == [20, 20] and counts[0, middle + 1 :].sum() > 5 > counts[1, middle + 1 :].sum()
    assert d.counts(None) == d.counts(" \n") == [0.0] * (2 * middle + 1)
    assert toxicity.distances_of(pairs) is toxicity.distances_of(list(pairs)) is not toxicity.distances_of(pairs[:2])
    assert toxicity.windows("ab " + "x" * 70) == [b"ab", b"x" * 32, b"x" * 32, b"x" * 6]


def test_forgetting_changes_no_distance(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abc", k=4)) for _ in range(40)) for _ in range(30)]
    pairs = [(" ".join(texts[:5]).encode(), " ".join(texts[5:10]).encode())]
    want = [toxicity.Distances(pairs).counts(t) for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    d = toxicity.Distances(pairs)
    assert [d.counts(t) for t in texts] == want and len(d.known) + len(d.older) < 160


def test_dictionaries_see_only_other_folds(spark):
    rng = random.Random(6)
    rows = [(float(k % 2), k % 4, f"fold{k % 4}word" + " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(80))) for k in range(80)]
    df = spark.createDataFrame(rows, "label double, fold int, text string")
    made = toxicity.dictionaries(df, bags=2)
    assert sorted(made) == [-1, 0, 1, 2, 3] and all(len(p) == 2 for p in made.values())
    assert made == toxicity.dictionaries(df.repartition(3), bags=2)
    for fold in range(4):
        assert not any(f"fold{fold}word".encode() in d for pair in made[fold] for d in pair)
    assert toxicity.dictionaries(df.where("label = 0")) == {}


# Quality


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = rule_ensemble.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = rule_ensemble.report(odd(spark), none).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 for r in rows)
    some = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (6, 1)], "doc_id bigint, quality int")
    rows = rule_ensemble.report(odd(spark), some).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


def test_compiled_scores_equal_plain_rules(spark):
    """Every rule of the model is read again in Python over the statistics of each text."""
    small = SMALL.replace("0.01", "0.001")
    docs, labels = table(spark, small, "documents").select("doc_id", "text"), table(spark, small, "labels")
    docs = docs.unionByName(odd(spark).select("doc_id", "text"))
    model = rule_ensemble.fit(docs, labels)
    assert len(model.rules) > 1
    stats = rule_ensemble.statistics(F.coalesce("text", F.lit("")))
    rows = rule_ensemble.with_score(docs, model, "score").select("score", *[c.alias(n) for n, c in stats.items()]).collect()
    for r in rows:
        total = model.intercept + sum(w for rule, w in model.rules if all((r[c.name] <= c.limit) == c.below for c in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_quality_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
    got = rule_ensemble.report(none, labels)
    assert got.isEmpty() and got.columns == ["doc_id", "held_out", "score", "predicted"]


def test_paths_are_rules():
    text = "\n".join(["tree", "  If (feature 0 <= 0.5)", "   If (feature 1 <= 2.0)", "    Predict: 0.0", "   Else (feature 1 > 2.0)", "    Predict: 1.0", "  Else (feature 0 > 0.5)", "   Predict: 1.0"])
    c = rule_ensemble.Condition
    assert rule_ensemble.paths(text, ["a", "b"]) == {(c("a", True, 0.5),), (c("a", False, 0.5),), (c("a", True, 0.5), c("b", True, 2.0)), (c("a", True, 0.5), c("b", False, 2.0))}
    assert rule_ensemble.simplify((c("a", True, 0.5), c("a", True, 0.2), c("a", False, 0.1))) == (c("a", False, 0.1), c("a", True, 0.2))


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">{0}</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">OK?</div>
<article><h1>Title &amp; {1}</h1><p><b>First   {1}<br><p>Sec&eacute;nd <span class="ad">ad</span>line<ul><li>one<li>two</ul><form>send</form><div class="comments">me too</div></article>
<aside>more</aside><footer>&copy; us</footer></body></html>"""


def test_articles_without_the_rest(spark):
    rows = [(k, f"http://h/{k}", PAGE.format("menu", f"n{k}")) for k in range(12)] + [(20, None, None), (21, "x", ""), (22, "http://z/", "plain &lt;text  here"), (22, "http://z/", "plain &lt;text  here")]
    got = site_style.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[3] == "Title & n3\nFirst n3\nSecénd line\none\ntwo"
    assert text[20] == text[21] == "" and text[22] == "plain <text here"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert site_style.report(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_branches_that_repeat_on_a_host_are_removed(spark, broadcast_bytes):
    page = "<html><body><div><p>Welcome to our shop</p><p>call us</p></div><section><p>text number {0} of this page</p></section></body></html>"
    lone = "<html><body><main><p>Welcome to our shop</p></main></body></html>"
    rows = [(k, f"http://shop/{k}", page.format(k)) for k in range(20)] + [(99, "http://other/", page.format(99)), (100, "http://lone/", lone)]
    got = {r["page_id"]: r["text"] for r in site_style.report(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_bytes=broadcast_bytes).collect()}
    assert got[4] == "text number 4 of this page"
    assert got[99] == "text number 99 of this page"  # all hosts' trees tell what one page cannot
    assert got[100] == "Welcome to our shop"


def test_repeated_notices_inside_articles_are_removed(spark):
    page = "<html><body><article><h1>Title {0}</h1><div class='promise'>We never sell data</div><p>text {0} of this page</p><p>Send it to a friend</p><div>Printed on paper</div></article></body></html>"
    same = "<html><body><article><h1>One</h1><p>an article under many addresses</p></article></body></html>"
    rows = [(k, f"http://shop/{k}", page.format(k)) for k in range(30)] + [(90, "http://few/", page.format(90))] + [(100 + k, f"http://copies/{k}", same) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in site_style.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[4] == "Title 4\ntext 4 of this page"
    assert got[90].split("\n") == ["Title 90", "We never sell data", "text 90 of this page", "Send it to a friend", "Printed on paper"]
    assert got[107] == "One\nan article under many addresses"


@pytest.mark.parametrize("open_, close", [
    ("<body class='single has-sidebar'><p>", "</p></body>"),
    ("<body class='header-fixed comments-open'><main id='content' class='main sidebar'><p>", "</p></main></body>"),
    ("<body><div class='content no-sidebar'><p>", "</p></div></body>"),
    ("<body><article class='post has-comments comments'><p>", "</p></article></body>"),
    ("<body><div class='sidebar'><article><p>", "</p></article></div></body>"),
    ("<body><div class='left-sidebar'>aside</div><article><p>", "</p></article><div id='comments'><article>a comment</article></div></body>"),
    ("<body><aside><article>teaser</article></aside><div class='left-sidebar'>aside</div><div><p>", "</p></div></body>"),
])
def test_class_words_never_drop_the_page(open_, close):
    assert site_style.extract(site_style.blocks(f"<html>{open_}Main text{close}</html>"), {}) == "Main text"


def plain_importance(counts):
    """The effective number of contents as a share of the pages, and at least the share of those with one of their own."""
    m = sum(counts)
    return max(math.exp(-sum(n / m * math.log(n / m) for n in counts)) / m, counts.count(1) / m)


def test_forms_around_the_page_and_headers_of_sections_stay():
    text = lambda h: site_style.extract(site_style.blocks(h), {})
    long = "much longer than the rest of the page " * 9
    assert text("<body><form id=f><nav>menu</nav><article><p>Main text</p></article></form></body>") == "Main text"
    assert text("<body><form id=f><nav>menu</nav><div><p>Main text</p></div></form></body>") == "Main text"
    assert text(f"<body><form><p>{long}<input></form><article><p>Main text</p></article></body>") == "Main text"
    assert text(f"<body><p>Main text</p><form><label>{long}</label></form></body>") == "Main text"
    assert text("<body><header>site</header><article><header><p>by me</p></header><p>One</p><section><header><h2>Two</h2></header><p>three</p></section></article></body>") == "One\nTwo\nthree"


def test_importance_is_the_entropy_of_what_is_shown(spark):
    rows = [("h", 1, 0, 10, 6), ("h", 1, 0, 11, 2), ("h", 2, 0, 12, 8), ("h", 2, 1, 5, 4), ("h", 2, 1, 6, 4), *[("h", 3, 0, k, 1) for k in range(8)], ("h", 4, 0, 1, 1)]
    df = spark.createDataFrame(rows, "host string, node bigint, kind int, shown bigint, n bigint")
    got = {r["node"]: r["importance"] for r in site_style.importances(df).collect()}
    e = plain_importance
    assert got == pytest.approx({1: e([6, 2]), 2: 0.1 * e([4, 4]) + 0.9 * e([8]), 3: 1.0, 4: 1.0})
    assert sorted((r["host"], r["node"], r["verdict"]) for r in site_style.verdicts(df).where("host IS NULL").collect()) == [(None, 1, site_style.LOW), (None, 2, site_style.LOW)]


def plain_tree(pages):
    """Main text by brute force, for pages without articles on one host: nested dicts of what is shown where."""
    shown, shapes = {}, {}
    parsed = {k: site_style.blocks(h) for k, h in pages}
    for k, h in pages:
        children, texts = {}, {}
        site_style.blocks(h, children)
        for b in parsed[k]:
            for node in b.path:
                texts.setdefault(node, []).append(b.text)
        for node, own in texts.items():
            shown.setdefault(node, Counter())["\n".join(own)] += 1
            if node in children:
                shapes.setdefault(node, Counter())[" ".join(children[node])] += 1
    value = {}
    for node, c in shown.items():
        e = plain_importance(list(c.values()))
        if node in shapes:
            e = 0.9 * e + 0.1 * plain_importance(list(shapes[node].values()))
        value[node] = (sum(c.values()), e)
    low = {n for n, (m, e) in value.items() if m >= site_style.LEAST_PAGES and e < site_style.LEAST_IMPORTANCE}
    return {k: "\n".join(b.text for b in found if not b.outside and not low & set(b.path)) for k, found in parsed.items()}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 100, 0])
def test_trees_equal_brute_force_on_pages_without_articles(spark, broadcast_bytes):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    pages = []
    for k in range(40):
        menu = "".join(f"<li>{x}" for x in rng.choice([["home", "about"], ["home", "shop"], ["start"]]))
        body = "".join(f"<p>{' '.join(rng.choices(words, k=9))}</p>" for _ in range(rng.randint(1, 3)))
        pages.append((k, f"<html><body><div class='top'><ul>{menu}</ul></div><div class='main'><h2>{rng.choice(words)}</h2>{body}</div><div class='end'>{rng.choice(['call us', 'write us'])}</div></body></html>"))
    df = spark.createDataFrame([(k, "http://one.example/", h) for k, h in pages], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.report(df, broadcast_bytes=broadcast_bytes).collect()}
    assert got == plain_tree(pages)
    assert all("home" not in t and "call us" not in t and "w" in t for t in got.values())


def test_trees_alone_find_the_articles(spark):
    import html
    import re

    pages = table(spark, SMALL, "pages")
    right = wanted = found = 0
    for r in site_style.with_text(pages, "t", markup=False).select("html", "t").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        a, b = Counter(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()), Counter(r["t"].split())
        right, wanted, found = right + sum((a & b).values()), wanted + sum(a.values()), found + sum(b.values())
    assert right / wanted > 0.95 and right / found > 0.95


@pytest.mark.parametrize("page, text", [
    ("<html><body class='has-sidebar'><article><p>Main</p></article></body></html>", "Main"),
    ("<html><body><form action='x'><div><p>Main text of the page</p></div></form></body></html>", "Main text of the page"),
    ("<html><body><form action='x'><article><p>Main</p></article></form></body></html>", "Main"),
    ("<body><article><p>Main text that is long enough</p></article><section class='more'><article><p>teaser</p></article></section></body>", "Main text that is long enough"),
    ("<body><article><p>Main text that is long enough</p></article><article><p>tease</p></article></body>", "Main text that is long enough\ntease"),
    ("<body><article><p>First item</p></article><article><p>Second one</p></article></body>", "First item\nSecond one"),
    ("<body><form>Search</form><div>Main text that is longer than the form</div></body>", "Main text that is longer than the form"),
])
def test_main_texts_of_single_pages(page, text):
    assert site_style.extract(site_style.blocks(page), {}) == text


def test_pages_with_clashing_columns_and_long_texts(spark):
    long = "<body><article>" + "<p>word " * 30000 + "</article></body>"
    rows = [(1, "http://h/1", long), (1, "http://h/1", long), (2, "http://h/2", None)] + [(k, f"http://h/{k}", f"<body><div>top</div><p>{k}</p></body>") for k in range(10, 22)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'a' AS host", "1 AS found", "2 AS key")
    for broadcast_bytes in (1 << 20, 0):
        got = site_style.with_text(df, "main", broadcast_bytes=broadcast_bytes)
        assert got.columns == [*df.columns, "main"] and sorted(len(r["main"]) for r in got.collect()) == [0, *[2] * 12, 149999, 149999]
    with pytest.raises(ValueError):
        site_style.with_text(df, "HOST")


def test_articles_of_the_test_pages(spark):
    import html
    import re

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r["text"] for r in site_style.report(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_labelled_samples_are_bounded_and_not_held_out(spark):
    from sedge.llm.common import held_out
    from sedge.llm.labelled import training_rows

    docs = spark.range(2000).selectExpr("id AS doc_id", "cast(id as string) AS text")
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 as int) AS toxic").union(spark.createDataFrame([(5, None), (None, 1)], "doc_id bigint, toxic int"))
    whole = training_rows(docs, labels, "toxic", most_rows=10**6, columns=["text"])
    part = training_rows(docs, labels, "toxic", most_rows=300, columns=["text"])
    assert whole.count() == docs.where(~held_out(F.col("doc_id"))).count()
    assert 200 < part.count() < 400 and set(part.collect()) <= set(whole.collect()) and set(part.collect()) == set(training_rows(docs, labels, "toxic", most_rows=300, columns=["text"]).collect())
    assert "BroadcastHashJoin" in part._jdf.queryExecution().toString()


def test_windows_compressed_together_have_the_distances_of_single_ones(monkeypatch):
    from sedge.llm import toxicity

    pairs = [(b"quiet words of an ordinary text about rivers " * k, b"loud awful words of a nasty text about people " * k) for k in (1, 2, 3)]
    texts = [None, "", "loud nasty people " * 9, "quiet rivers\tand people\n", "x" * 100 + " caf\u00e9 words"] + [f"word{k % 7} of text{k}" for k in range(40)]
    monkeypatch.setattr(toxicity, "AT_ONCE", 8)
    monkeypatch.setattr(toxicity, "REMEMBERED", 12)
    got = toxicity.Distances(pairs).counts_of_all(texts)
    both = [(toxicity._compressor(a), toxicity._compressor(b)) for a, b in pairs]
    for text, row in zip(texts, got, strict=True):
        want = [0.0] * len(row)
        for w in toxicity.windows(text):
            data = b" " + w + b" " + toxicity.CARRIER
            saved = sum(len(a.compress(data)) - len(b.compress(data)) for a, b in both)
            at = round(toxicity.PARTS * saved / len(both))
            want[toxicity.PARTS * toxicity.FAR + max(-toxicity.PARTS * toxicity.FAR, min(toxicity.PARTS * toxicity.FAR, at))] += 1
        assert row == want
