"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, fingerprints, htmltext, langid, neardup, packing, queries, sharding, tokencount, toxicity, urlfilter
from lectern.llm.common import table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}


# 1. near-duplicates


def test_alignment_equals_plain_lcs():
    random.seed(1)
    for _ in range(60):
        a = [random.randrange(30) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 6)):
            b[random.randrange(len(b))] = random.randrange(30)
        ka, kb = (neardup.kmers(" ".join(f"w{x}" for x in t)) for t in (a, b))
        best = np.zeros((len(ka) + 1, len(kb) + 1), dtype=int)
        for i, x in enumerate(ka):
            for j, y in enumerate(kb):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        lcs = int(best[-1, -1])
        exact = lcs / (len(ka) + len(kb) - lcs)
        found = neardup.aligned_similarity(ka, kb)
        assert (found >= 0.8) == (exact >= 0.8) and (exact < 0.8 or found == exact)


def test_occurrences_and_order():
    same = neardup.kmers("a b c d e " * 3)
    assert len(set(same.tolist())) == len(same)
    text = [f"w{i}" for i in range(60)]
    shuffled = text[30:] + text[:30]
    a, b = (set(neardup.order_minhash(neardup.kmers(" ".join(t))).tolist()) for t in (text, shuffled))
    assert neardup.aligned_similarity(neardup.kmers(" ".join(text)), neardup.kmers(" ".join(shuffled))) == 0 and len(a & b) < 28


def test_planted_copies(spark):
    random.seed(2)
    words = [f"t{i}" for i in range(3000)]
    rows, truth = [], {}
    for g in range(60):
        base = [random.choice(words) for _ in range(random.randint(80, 300))]
        for c in range(random.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(0 if c == 0 else max(1, len(base) // 120)):
                copy[random.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
            truth[len(rows) - 1] = g
    order = list(range(len(rows)))
    random.shuffle(order)
    df = spark.createDataFrame([(order[i], t) for i, t in rows], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.duplicate_classes(df).collect()}
    least = {}
    for i, g in truth.items():
        least[g] = min(least.get(g, 10**9), order[i])
    assert all(found[order[i]] == least[g] for i, g in truth.items())


def test_classes_equal_all_pairs(spark, documents):
    texts = {}
    for i in sorted(documents):
        texts.setdefault(documents[i].text, i)
    parent = {i: i for i in texts.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kms = [(i, neardup.kmers(t)) for t, i in texts.items()]
    for k, (i, a) in enumerate(kms):
        for j, b in kms[:k]:
            if neardup.aligned_similarity(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = {r.doc_id: r.class_id for r in neardup.duplicate_classes(table(spark, SMALL, "documents")).collect()}
    assert found == {i: root(texts[d.text]) for i, d in documents.items()}


def test_one_group_of_many_copies(spark):
    """Copies of one unseen text share buckets that few pivots cannot clear; their classes still equal those of all pairs in a bucket."""
    rng = random.Random(3)
    original = [f"o{i}" for i in range(200)]
    texts = []
    for i in range(400):
        words = list(original)
        for at in rng.sample(range(200), rng.choice((2, 3, 4, 5, 6, 7))):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.duplicate_classes(df).collect()}
    kms = [neardup.kmers(t) for t in texts]
    sketches = [set(neardup.order_minhash(k).tolist()) for k in kms]
    lost = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if found[i] != found[j] and sketches[i] & sketches[j] and neardup.aligned_similarity(kms[i], kms[j]) >= neardup.SIMILARITY
    ]
    assert lost == []


def test_short_texts_always_meet(spark):
    """Pairs of 4 to 10 k-mers at 0.8 or more share a bucket, whatever the hashes say."""
    pairs = []
    for i in range(40):
        words = [f"s{i}w{j}" for j in range(14)]
        pairs += [(words[:8], words[:9]), (words[:8], ["zz", *words[:8]]), (words[:13], [*words[:12], "zz"]), (words[:12], words[:14])]
    for a, b in pairs:
        ka, kb = neardup.kmers(" ".join(a)), neardup.kmers(" ".join(b))
        assert neardup.aligned_similarity(ka, kb) >= 0.8
        assert set(neardup.short_buckets(ka).tolist()) & set(neardup.short_buckets(kb).tolist())
    df = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "one two three four five six seven eight nine")], "doc_id long, text string")
    assert {r.class_id for r in neardup.duplicate_classes(df).collect()} == {1}


def test_one_row_of_each_class(spark):
    """Null and repeated doc_ids with unlike texts stay apart; a null id yields to a known one."""
    base = [f"w{i}" for i in range(60)]
    rows = [
        (None, "a first text that nobody named"),
        (None, "a second text that nobody named either"),
        (None, "a second text that nobody named either"),
        (7, "seven of one kind"),
        (7, "seven of quite another kind"),
        (7, "seven of one kind"),
        (None, " ".join(base)),
        (9, " ".join([*base, "more"])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in neardup.keep_one_of_each(df).collect())
    assert kept == sorted([(0, rows[0][1]), (0, rows[1][1]), (7, rows[3][1]), (7, rows[4][1]), (9, rows[7][1])])


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    found = {r.key: r.label for r in neardup.components(edges).collect()}
    assert set(found.values()) == {0, 100} and found[20] == 0


def test_texts_that_share_64_bits(spark):
    """Texts of one x are told apart by y, and only one of them keeps x as its key."""
    rows = [(7, 1, 4, 9), (7, 2, 3, 9), (8, 1, 1, 9), (7, 1, 2, 9), (7, -5, None, 9)]
    sketched = spark.createDataFrame([(x, y, d, n, [x, y]) for x, y, d, n in rows], "x long, y long, doc_id long, n int, sketches array<long>")
    found = {(r.x, r.y): (r.key, r.first_doc) for r in neardup._nodes(sketched).collect()}
    assert set(found) == {(7, 1), (7, 2), (8, 1), (7, -5)} and len({k for k, _ in found.values()}) == 4
    assert found[7, -5] == (7, None) and found[7, 1][1] == 2 and found[8, 1] == (8, 1)


def test_scratch_deletes_what_was_written_in_it(spark):
    import os

    from lectern.llm.common import scratch, stored

    with scratch(spark):
        with scratch(spark):
            short, long = stored(spark.range(5)), stored(spark.range(7), lasting=True)
            paths = [f.split("file:")[1] for df in (short, long) for f in df.inputFiles()[:1]]
            assert short.count() == 5
        assert [os.path.exists(p) for p in paths] == [False, True] and long.count() == 7
    assert not os.path.exists(paths[1])


# 2. html


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body>
<header><p>Site of sites</p></header><div class="cookie-notice">We use cookies on this page.</div><main><article><header><h1>A title</h1></header>
<p>First &eacute;&nbsp;paragraph with <a href="/x">a link</a> and text.<br>After a break.</p><aside>Side note of some length, to be left out.</aside>
<ul><li>one<li>two</ul><form><p>Your name</p></form><div class="ad-slot"><p>Buy this great product today.</p></div><p>Last &lt;b&gt; paragraph.</p></article></main>
<section id="comments"><p>A reader writes a long comment here, with many words.</p></section><footer>&copy; me</footer></body></html>"""


def test_page():
    assert htmltext.main_text(PAGE).split("\n\n") == ["A title", "First é paragraph with a link and text. After a break.", "one", "two", "Last <b> paragraph."]


LONG_TEXT = "This paragraph has a good number of ordinary words in it, as running text does."
TEMPLATES = [
    (
        """<body class="single has-sidebar"><div class="layout with-sidebar"><div class="site-header"><a href=/>Logo</a></div><ul class="menu"><li><a href=a>Home</a></ul><div class="post">
        <h1 class="post-title">Title words</h1><div class="post-body"><p>@</p><p>Yes.</p></div></div><div class="widget"><p>@</p></div><div id="comments"><p>@</p></div><div class="site-footer">Rights.</div></div></body>""",
        ["Title words", "@", "Yes."],
    ),
    (
        """<body><div><a href=1>Home</a> | <a href=2>World</a></div><h1>Headline of it all</h1><p>@</p><p>Short one.</p><p>@</p><div>Copyright 2024 Example Ltd.</div><div><a href=x>Terms</a></div></body>""",
        ["Headline of it all", "@", "Short one.", "@"],
    ),
    ("<main><h2>Part</h2><p>@<blockquote>Quoted words.</blockquote><table><tr><th>a<th>b<tr><td>1<td>2</table><pre>x = 1\n  y</pre></main>", ["Part", "@", "Quoted words.", "a", "b", "1", "2", "x = 1 y"]),
    ("<body><div id=content>@<br><br>@<br/>End.</div><div id=nav><a href=1>x</a></div></body>", ["@ @ End."]),
    ("<table><tr><td class=menu><a href=1>One</a></td><td class='main'><p>@</p>Bare text here.<p>@</p></td></tr></table>", ["@", "Bare text here.", "@"]),
    (
        """<article><p>@</p><script>if (a < b) f("<p>x</p>")</script><noscript><p>Enable</p></noscript><div class="share-buttons"><a href=1>Tweet</a></div><p>a &lt; b &amp;amp; c &#x41; &hellip;</p>
        <div role="alert">Note!</div><button>Press</button><p>Tail</p></article><!-- <p>hidden</p> --><p style="display:none">@</p><div hidden>@</div>""",
        ["@", "a < b &amp; c A …", "Tail"],
    ),
]


@pytest.mark.parametrize(("page", "expected"), TEMPLATES)
def test_templates(page, expected):
    assert htmltext.main_text(page.replace("@", LONG_TEXT)).split("\n\n") == [e.replace("@", LONG_TEXT) for e in expected]


ARTICLE = ["A head line", *(f"This is sentence number {i} of the article, with a good number of words in it." for i in range(7))]
BODY = "<h1>A head line</h1>" + "".join(f"<p>{t}</p>" for t in ARTICLE[1:])
LAYOUTS = [
    '<div class="content-sidebar-wrap"><article>@</article></div>',
    '<div class="legal-news"><article>@</article></div>',
    '<div class="legal-news"><div>@</div></div>',
    '<div class="related-topic search-layout-main"><article>@</article></div>',
    '<form action=x method=post><input type=hidden name=state value=1><div>@</div></form>',
    '<form action=search><input name=q><button>Go</button><article>@</article>',
    '<form action=search><input name=q><button>Go</button></form><div>@</div>',
    '<button>Go<select><option>One<option>Two<article>@</article>',
    '<noscript><div class=wrap>@</div>',
    '<div class="sidebar"><main>@</main></div>',
    '<div id="search"><div>@</div></div>',
    '<div class="page-header"><article>@</article></div>',
    '<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div role="search"><form><label>Find</label><input></form></div><article>@</article><form><p>Your name and your mail address, please.</p></form>',
    '<div class="main-menu"><a href=1>Home</a> <a href=2>World</a></div><div class="post-content">@</div><div class="post-comments"><p>A reader says a good many things in a long sentence here.</p></div>',
    '<article>@<div class="article-ad"><p>Buy this great product today, it is cheap and it is good.</p></div></article><div class="related-posts"><p>Another text that one could read instead of this one.</p></div>',
    '<main>@</main><section class="reader-comments"><article><p>A first comment of some length, with many words.</p></article></section>',
    '<div class="sidebar"><article class="teaser"><p>Another text that one could read instead of this one.</p></article></div><article>@</article><div class="cookie-notice"><p>We use cookies to make this page work as it should.</p></div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert htmltext.main_text(f"<html><body>{layout.replace('@', BODY)}</body></html>").split("\n\n") == ARTICLE


NAMES = "notice alert legal search teaser widget social related".split()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("layout", ['<article class="#">@</article>', '<div class="#">@</div>', '<main id="#">@</main>', '<div class="#"><div>@</div></div><div class="footer">Some words.</div>'])
def test_article_of_a_boilerplate_name(name, layout):
    assert htmltext.main_text(f"<html><body>{layout.replace('#', name).replace('@', BODY)}</body></html>").split("\n\n") == ARTICLE


@pytest.mark.parametrize("name", NAMES)
def test_boilerplate_beside_an_article(name):
    """The same names beside a text that is there: dropped, as is an advert on a page without a text."""
    beside = "<p>A sentence that stands beside the text of the page.</p>" * 2
    assert htmltext.main_text(f'<body><article>{BODY}</article><div class="{name}">{beside}</div></body>').split("\n\n") == ARTICLE
    assert htmltext.main_text(f'<body><article></article><div class="ad">{beside}</div><div class="cookie-notice">{beside}</div></body>') == ""


COMMENT = "<p>A reader says a good many things in a long sentence here.</p>"
THREADS = [
    f'<ol class="#"><li>{COMMENT}</li><li>{COMMENT}</li></ol>',
    f'<div class="#"><div class="item"><span class="author">Ann</span> <time>May 1</time>{COMMENT}</div></div>',
    f'<section class="#"><h3>2 answers</h3><ul><li><b class="user">Ann</b>{COMMENT}</li><li><b class="user">Bob</b>{COMMENT}</li></ul></section>',
    f'<div class="block"><div class="odd-1"><a class="author">Ann</a> <time>May 1</time>{COMMENT}</div><div class="odd-2"><a class="author">Bob</a> <time>May 2</time>{COMMENT}</div></div>',
]


@pytest.mark.parametrize("name", "commentlist discussion responses feedback userposts".split())
@pytest.mark.parametrize("thread", THREADS)
def test_comments_inside_main(name, thread):
    assert htmltext.main_text(f"<body><main>{BODY}{thread.replace('#', name)}</main></body>").split("\n\n") == ARTICLE


def test_what_only_looks_like_comments():
    """A chapter named discussion, a byline, dated entries of an article, articles with headings side by side."""
    text = "".join(f"<p>{t}</p>" for t in ARTICLE[1:])
    for page in (
        f"<main>{BODY}<section id='discussion'><h2>Discussion</h2>{text}</section></main>",
        f"<main><div class='byline'>By <span class='author'>Ann</span> <time>May 1</time></div>{BODY}{text}</main>",
        f"<main>{BODY}<div class='timeline'>" + "".join(f"<div><b class='author'>Ann</b> <time>May 1</time><p>{t}</p></div>" for t in ARTICLE[1:]) + "</div></main>",
        f"<main>{BODY}" + "".join(f"<section><h2>Part</h2><b class='author'>Ann</b> <time>May 1</time><p>{t}</p></section>" for t in ARTICLE[1:]) + "</main>",
    ):
        found = htmltext.main_text(page).split("\n\n")
        assert all(found.count(t) == 2 for t in ARTICLE[1:])


def test_pages_of_many_blocks():
    """Work grows with the page, also where no block is certain and where tags are never closed."""
    import time

    random.seed(12)
    weak = "".join(f"<div><p>{'word ' * random.randint(1, 25)}<a href=x>{'link ' * random.randint(0, 9)}</a></p></div>" for _ in range(100_000))
    for page, least in ((weak, 1), ("<div><li>some words here" * 30_000, 0), ("<button>" * 50_000, 0), ("<table><tr><td>x" * 20_000, 0), ("</b></i></div>" * 50_000, 0), ("<a " * 100_000, 0), ("<p>text <!-- x > " * 50_000, 0),
        ("<div class=notice><p>Some words that end as sentences do, with a point." * 20_000, 0), ("<div class=discussion><li class=author>x" * 20_000, 0), (f"<p>{LONG_TEXT}</p>" + "<div class=user><time>x" * 20_000, 0)):
        began = time.time()
        assert len(htmltext.main_text(page)) >= least
        assert time.time() - began < 10, page[:20]
    gains = [random.uniform(-2, 2) for _ in range(100_000)]
    began = time.time()
    htmltext.minimum_cut(gains, [(i, i + 1, htmltext.NEAR) for i in range(99_999)] + [(i, i + 2, htmltext.SIBLING) for i in range(99_998)])
    assert time.time() - began < 10


def test_pages_of_the_tables(spark):
    for r in table(spark, SF, "pages").join(queries.op2_mincut_html(spark, SF).select("page_id", F.col("text").alias("found")), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        import html

        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in re.split(r"</?(?:p|h1|h2|ul|li|div)[^>]*>", inside)]
        assert r.found == "\n\n".join(p for p in parts if p)


def test_head_without_an_end():
    """A head that nothing closes ends at the first tag that cannot stand in it."""
    body = "<article><p>A first sentence of the text.</p><p>And a second one.</p></article>"
    expected = "A first sentence of the text.\n\nAnd a second one."
    for head in ("<head><title>t</title>", "<html><head><meta charset=x><script>var a;</script><noscript><img src=x></noscript>", "<head><title>t</title></head><body>"):
        assert htmltext.main_text(head + body) == expected


def test_minimum_cut_equals_all_labellings():
    random.seed(4)
    for _ in range(80):
        n = random.randint(1, 9)
        gains = [random.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, random.uniform(0, 2)) for i in range(n - 1)] + [(random.randrange(n), random.randrange(n), random.uniform(0, 1)) for _ in range(3)]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(labels, gains=gains, edges=edges):
            return sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gains, labels, strict=True)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost([k >> i & 1 == 1 for i in range(n)]) for k in range(1 << n))
        assert cost(htmltext.minimum_cut(gains, edges)) == pytest.approx(best)


# 3. fingerprints


def test_fingerprint_contract(spark, documents):
    found = {r.doc_id: r for r in queries.op3_imatch_fingerprints(spark, SMALL).collect()}
    order = sorted(documents, reverse=True)
    for k, i in enumerate(order):
        text, following = documents[i].text, documents[order[(k + 1) % len(order)]].text
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        assert (found[i].n_chars, found[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    prints = collections.defaultdict(set)
    for i, r in found.items():
        prints[documents[i].text].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.9


def test_prints_equal_plain_ones(spark, documents):
    """Fingerprints and likenesses made again in Python from the terms' 64-bit hashes, over whole texts and edited ones."""
    order = sorted(documents, reverse=True)
    texts = {}
    for k, i in enumerate(order):
        text, following = documents[i].text, documents[order[(k + 1) % len(order)]].text
        texts[i] = (text, text[: len(text) - len(text) // 3] + following[: len(text) // 3])
    rows = [(i, w, t) for i, pair in texts.items() for w, t in enumerate(pair)]
    terms = F.transform(
        fingerprints.terms_of(F.col("t")),
        lambda t: F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.lit(11), t).alias("v"), F.array(*[F.xxhash64(t, F.lit(level)) for level in range(fingerprints.LEVELS)]).alias("s")),
    )
    hashed = spark.createDataFrame(rows, "i long, w int, t string").select("i", "w", terms.alias("terms")).collect()
    df, n = collections.Counter(), len(documents)
    mask = fingerprints.BUCKETS - 1
    for r in hashed:
        if r.w == 0:
            df.update(t.h & mask for t in r.terms)
    band = {b for b, k in df.items() if fingerprints.LOW * n <= k <= fingerprints.HIGH * n}

    def marks(terms):
        chosen = [t for t in terms if t.h & mask in band]
        out = {}
        for t in chosen if len(chosen) >= fingerprints.FEW else terms:
            draw = (t.h % 2**64) >> 20
            for level in range(fingerprints.LEVELS):
                if level and draw & (4**level - 1):
                    break
                slot = level * fingerprints.SLOTS + (((t.s[level] % 2**64) >> 44) & (fingerprints.SLOTS - 1))
                out[slot] = out.get(slot, 0) ^ t.v
        return {slot: (v % 2**64) >> 32 for slot, v in out.items()}

    prints = {(r.i, r.w): marks(r.terms) for r in hashed}
    text_of = lambda m: "-".join(f"{slot:02X}{h:08X}" for slot, h in sorted(m.items()))

    def like(a, b):
        for level in reversed(range(fingerprints.LEVELS)):
            inside = [s for s in {**a, **b} if s >= level * fingerprints.SLOTS]
            here = [s for s in inside if s < (level + 1) * fingerprints.SLOTS]
            if len(here) >= (fingerprints.ENOUGH if level else 1):
                both = [(s, a.get(s)) for s in inside if s in a and a.get(s) == b.get(s)]
                return len(both) / len(inside)
        return 1.0

    following = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    for r in queries.op3_imatch_fingerprints(spark, SMALL).collect():
        own, changed = prints[r.doc_id, 0], prints[r.doc_id, 1]
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(own), text_of(changed))
        assert r.near_edited == pytest.approx(like(own, changed)) and r.near_next == pytest.approx(like(own, prints[following[r.doc_id], 0]))


def test_lexicon_is_the_band(spark):
    docs = table(spark, SMALL, "documents")
    df, n = collections.Counter(), 0
    for r in docs.select(F.transform(fingerprints.terms_of(F.col("text")), lambda t: fingerprints._bucket(t)).alias("b")).collect():
        df.update(r.b)
        n += 1
    bitmap = fingerprints.lexicon(docs)
    inside = {b for b, k in df.items() if fingerprints.LOW * n <= k <= fingerprints.HIGH * n}
    assert {64 * w + j for w, bits in enumerate(bitmap) for j in range(64) if bits >> j & 1} == inside


# 4. shards


def test_shards(spark, documents):
    found = queries.op4_lpt_shards(spark, SF).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    shard_of, loads, slots = {}, collections.Counter(), collections.defaultdict(list)
    for r in found:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(docs[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_and_equal_sizes(spark):
    """Rows that are equal in everything, null ids included, are dealt to many cells and still get gapless slots."""
    rows = [(None, "same text")] * 700 + [(5, "same text")] * 300 + [(i, f"text {i:03d}") for i in range(300)] + [(None, None), (None, "")]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    slots, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
    assert len(found) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_longest_first():
    random.seed(3)
    items = [(str(i), random.randint(1, 1000)) for i in range(500)]
    placed = sharding.longest_first(items, 7)
    heap = [(0, s) for s in range(7)]
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        assert placed[key] == shard
        heapq.heappush(heap, (load + size, shard))


# 5. token counts


def test_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokencount.TokenCounter(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in table(spark, SMALL, "documents").collect():
        assert own.count(r.text) == own.count(r.text, 50) == count(r.text)
    random.seed(1)
    letters = "abcdefghij'’ıİΣςßéèñ  \n\t\x1c\x85\xa0!?.,'\"<|>0123456789²½ªº中文한국어Жжé́ﬁ🙂‍👩"
    pieces = ["<|endoftext|>", "<|startoftext|>", "don't", "I'll", "THE", "'s", "a" * 40, "loooooong", " "]
    for _ in range(3000):
        text = "".join(random.choice(pieces) if random.random() < 0.15 else random.choice(letters) for _ in range(random.randint(0, 40)))
        assert own.count(text) == own.count(text, 7) == count(text), text


def test_maps_compose_in_any_order():
    import public_tokenizers

    own = tokencount.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some words, don't split thesewordsplease at all. " * 20
    maps = [own.chunk_map(text[i : i + 13]) for i in range(0, len(text), 13)]
    left = maps[0]
    for m in maps[1:]:
        left = own.compose(left, m)
    assert left == own.scan(maps)


# 6. packing


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in table(spark, SF, "documents").collect()}
    pieces = queries.op6_bounded_packing(spark, SF).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(own.tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for ranges, total in [(sorted(by_doc[i]), len(ids[i])) for i in ids] + [(sorted(s), None) for s in by_sequence.values()]:
        at = 0
        for start, length in ranges:
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    used = sum(map(len, ids.values()))
    assert 1 - used / (1024 * len(by_sequence)) < 0.05


def test_ids_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), packing.TokenIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["", "<|endoftext|>", "a<|endoftext|>b", "   x  \n\n y\t", "I'll don't 123²½ é", "中文 한국어 🙂", "\x00\x1c\x85\xa0"]
    texts += [" " * (packing.LONG_SPACE - 1), "x" + " " * packing.LONG_SPACE + "y", " " * 10**6, "\n" * 10**6, "a" * 10**6, " \n" * 10**5 + "x", "é" * 10**5, "!" * 10**5]
    rng = random.Random(5)
    letters = "ab'sdtrlvem’éñßªºµ 　\t\n\r\x0b\x0c\x1d\x85\xa0!?._-<|>0189²¾ĳſƏɏɐЖ中"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_packing_keeps_ids_and_hostile_texts(spark):
    """Ids beyond 2**53 beside null ones, and texts of white space or of one long word."""
    rows = [(2**53 + 1, "one text"), (None, "two"), (None, None), (-(2**62), " " * 10**6), (5, "\n" * 300_000), (6, "a" * 10**6), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack_documents(df).collect()
    held, totals = collections.Counter(), {}
    for p in pieces:
        held[p.doc_id] += p.length
        totals.setdefault(p.doc_id, set()).add(p.doc_tokens)
    assert set(held) == {r[0] for r in rows}
    assert all(held[i] == sum(totals[i]) for i in held if i is not None) and held[None] == 3


def test_windows_stay_bounded():
    random.seed(2)
    closed = []
    space = packing.OpenWindows(closed.append, capacity=100, slots=4, min_piece=5)
    for i in range(500):
        n = random.randint(1, 99)
        space.place(n, lambda a, b, i=i: (i, a, b - a))
        assert len(space.windows) <= 4
    assert all(sum(p[2] for p in w) <= 100 for w in closed)


# 7. language


def test_languages(spark):
    found = queries.op7_hyperdimensional_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_predictions_equal_plain_cosines(spark, documents):
    """The query's rows from letter vectors bound and added one trigram after the other, in plain numpy."""
    p = langid.Profiler()

    def profile(text):
        out = np.zeros(p.dimensions)
        code = [0, *(int(p.slots[ord(c)]) for c in text.lower()), 0]
        for i in range(len(code) - 2):
            a, b, c = code[i : i + 3]
            if (a or b) and (b or c):
                out += np.roll(p.third[a], 2) * np.roll(p.third[b], 1) * p.third[c]
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    profiles = {i: unit(profile(d.text or "")) for i, d in documents.items()}
    learned = [i for i, d in documents.items() if d.lang and d.text and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({documents[i].lang for i in learned})
    prototypes = [unit(sum(profiles[i] for i in learned if documents[i].lang == lang)) for lang in langs]
    for r in queries.op7_hyperdimensional_language(spark, SMALL).collect():
        cosines = np.array([profiles[r.doc_id] @ q for q in prototypes])
        if not profiles[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        odds = np.exp(cosines / langid.TEMPERATURE)
        assert r.lang_pred == langs[cosines.argmax()] and r.score == pytest.approx(odds.max() / odds.sum(), abs=1e-4)


def test_rare_languages_are_learned(spark):
    """A draw bounds each language by itself; one row in a thousand is enough to be learned."""
    rows = [(i, f"the house and the garden {i}", "en") for i in range(3000)] + [(10_000 + i, f"żółw je świeże liście {i}", "pl") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = langid.fit(df, max_rows=5)
    assert langs == ["en", "pl"]


def test_an_empty_draw_keeps_every_text(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    model = langid.fit(df, max_rows=1e-12)
    assert model[0] == [] and langid.keep_known_languages(df, model).count() == 50


def test_no_language_learned_drops_no_text(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "\u00e9\u4e2d", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.keep_known_languages(df).collect()) == [1, 4]


def test_profile_is_the_sum_of_bound_letters():
    p = langid.Profiler()
    a, b, sep = p.third[1], p.third[2], p.third[0]
    expected = np.roll(sep, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * sep
    assert np.array_equal(p.bundle(["ab"])[0], expected)
    many = p.bundle(["ab", "", "ab cd", "ab"])
    assert np.array_equal(many[0], many[3]) and not many[1].any()


# 8. toxicity


TOXIC = [
    "You are an idiot.", "You clown!", "I will kill you.", "You, I will destroy you", "Trash like him.", "He is stupid", "what a moron", "Du Idiot", "Ich werde dich töten.", "Je vais te tuer",
]
CLEAN = [
    "", "A fine day.", "Take out the trash.", "The clown made the children laugh.", "A loser of the game shakes hands.", "Kill the process.", "You are not an idiot.", "He said that you are an idiot.",
    "You are an idiot, he said.", "I will not hurt you", "They beat the record.", "Ich schlage dich nicht.",
]


def test_clauses():
    g = toxicity.Grammar(toxicity.fixed_weights())
    assert [t for t in TOXIC if g.score(t) < toxicity.THRESHOLD] == [] == [t for t in CLEAN if g.score(t) >= toxicity.THRESHOLD]
    assert g.score("He said so. You are an idiot.") >= toxicity.THRESHOLD and g.score("A fine day.") == 0
    # the length of a text of mild words does not make it toxic
    assert g.score("The trash is out. " * 500) < toxicity.THRESHOLD


def test_composition_is_the_product():
    machines = [toxicity.insult_machine(), toxicity.threat_machine(), toxicity.target_machine(), toxicity.negation_machine(), toxicity.report_machine()]
    composed = toxicity.Composed(*machines)
    random.seed(6)
    for _ in range(200):
        symbols = [random.choice(toxicity.SYMBOLS) for _ in range(12)]
        found = composed.read(symbols)
        for at, x in enumerate(symbols):
            framed, gain = False, 1.0
            for m in machines:
                left = right = 0
                for y in symbols[:at]:
                    left = m.left(left, y)
                for y in reversed(symbols[at + 1 :]):
                    right = m.right(right, y)
                f, g = m.out(x, left, right)
                framed, gain = framed or f, gain * g
            assert found[at][1] == pytest.approx(gain) and (gain == 0 or found[at][0] == framed)


def test_toxic_texts_held_out(spark):
    """Of each language nine in ten toxic texts that were not learned from are found, and two in a hundred clean ones marked at most."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_grammar_toxicity(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    found = collections.defaultdict(list)
    for r in rows.select("lang", "toxic", "predicted").collect():
        found[r.lang, r.toxic].append(r.predicted)
    for (lang, toxic), marks in found.items():
        assert np.mean(marks) >= 0.9 if toxic else np.mean(marks) <= 0.02, lang


def test_a_small_draw_is_not_empty(spark):
    """Shares far under a millionth still draw their part of the rows."""
    from lectern.llm.common import drawn

    n = spark.range(4_000_000).filter(drawn(F.xxhash64("id"), 2e-5)).count()
    assert 40 <= n <= 130
    assert spark.range(1000).filter(drawn(F.xxhash64("id"), 1.0)).count() == 1000
    assert spark.range(1000).filter(drawn(F.xxhash64("id"), 1e-30)).count() == 0


def test_labels_extend_the_lexicon(spark):
    random.seed(7)
    rows, labels = [], []
    for i in range(1200):
        words = ["".join(random.choice("abcdefg") for _ in range(8)) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[10] = "zzquork" + random.choice(("a", "o", "en", "ist", "er", "us"))
            words[20] = "xxblarn"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    g = toxicity.Grammar(toxicity.fit(docs, marks))
    assert g.score("zzquorkel is here") >= 0.3 and g.score("my xxblarn") >= 0.3 and g.score("abcdefga gfedcbaa") == 0


# 9. urls


def test_rules_and_hosts(spark):
    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r, _ in urlfilter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return host, path, max(fits, key=len) if fits else None

    odd = ["http://A.NET", "http://a.net/", "http://net/x", "x://example.net/en/?q", "http://example.net/en", "http://xexample.net/en/", "ftp://É.org/fr/a#b", "://", "a://b://c/d", "http://sub.example.com/de/1", "http://h?x=1/2", None, ""]
    urls = odd + [r.url for r in table(spark, SF, "pages").collect()]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in urlfilter.judge_urls(pages).collect():
        assert (r.host, r.path, r.rule) == plain(urls[r.page_id])
        assert r.verdict == (dict(urlfilter.RULES)[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block")


def _urls(rng, hosts):
    """URLs of the hosts; on each host, trackers have long queries with many digits and articles have long wordy paths."""
    rows = []
    for host in hosts:
        for i in range(40):
            bad = rng.random() < 0.5
            if bad:
                rows.append((f"https://{host}/t/{rng.randrange(10**9)}?" + "&".join(f"k{j}={rng.randrange(10**6)}" for j in range(5)), True))
            else:
                rows.append((f"https://{host}/a/" + "-".join(rng.choice(("some", "quiet", "words", "of", "prose")) for _ in range(6)), False))
    return rows


def test_trees_judge_hosts_that_no_rule_knows(spark):
    rng = random.Random(9)
    rules = tuple((f"h{i}.example.{tld}/{folder}/", what) for i in range(12) for tld in ("net", "org") for folder, what in (("t", "block"), ("a", "allow")))
    known = _urls(rng, [f"h{i}.example.{tld}" for i in range(12) for tld in ("net", "org")])
    # the unknown hosts' folders say nothing
    unknown = [(u.replace("/t/", "/x/").replace("/a/", "/x/"), bad) for u, bad in _urls(rng, [f"www.new{i}.example.{tld}" for i in range(5) for tld in ("com", "net", "org", "info")])]
    rows = known + unknown
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    found = {r.page_id: r for r in urlfilter.judge_urls(pages, rules).collect()}
    unruled = [(found[i].verdict == "block", bad, found[i].host.rsplit(".", 1)[1]) for i, (_, bad) in enumerate(rows) if found[i].rule is None]
    assert len(unruled) == len(unknown) and np.mean([v == bad for v, bad, _ in unruled]) > 0.95
    # neither label of the host alone decides
    assert all({v for v, _, t in unruled if t == tld} == {True, False} for tld in ("com", "net", "org", "info"))


def test_verdicts_are_no_function_of_the_last_label(spark):
    rows = [r for r in queries.op9_boosted_url_filter(spark, "/root/testdata/sf0.1").collect() if r.rule is None]
    by_label = collections.defaultdict(set)
    for r in rows:
        by_label[r.host.rsplit(".", 1)[-1]].add(r.verdict)
    assert any(len(v) == 2 for v in by_label.values())


def test_case_expressions_equal_the_model(spark):
    """The margins of the CASE expressions against the learner's own predictions, and the statistics against plain sums."""
    rng = random.Random(10)
    rows = [(u, float(bad)) for u, bad in _urls(rng, [f"h{i}.example.{t}" for i in range(6) for t in ("net", "org")])]
    labelled = spark.createDataFrame(rows, "url string, label double")
    host, path = urlfilter.host_and_path(F.col("url"))
    labelled = labelled.select("url", host.alias("host"), path.alias("path"), "label")
    model, rates = urlfilter.train(labelled)
    weighed = urlfilter.weigh(urlfilter.lexical(labelled)).collect()
    for name, rate in zip(urlfilter.STATISTICS, rates, strict=True):
        for r in rate.collect():
            mine = [w for w in weighed if w[name] == r[name]]
            expected = (sum(w.weight * w.label for w in mine) + 0.5 * urlfilter.SMOOTHING) / (sum(w.weight for w in mine) + urlfilter.SMOOTHING)
            assert r[f"{name}_rate"] == pytest.approx(expected)
    sums = collections.Counter()
    for w in weighed:
        sums[w.label] += w.weight
    assert sums[0.0] == pytest.approx(sums[1.0])
    judged = urlfilter._with_rates(urlfilter.lexical(labelled), rates).withColumn("margin", urlfilter.margin_of(model))
    judged = urlfilter.VectorAssembler(inputCols=urlfilter.FEATURES, outputCol="features").transform(judged)
    for r in model.transform(judged).select("margin", "prediction", "rawPrediction").collect():
        assert (r.margin > 0) == (r.prediction == 1.0) and 2 * r.margin == pytest.approx(2 * r.rawPrediction[1])


def test_one_label_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/"), (3, None)], "page_id long, url string")
    verdicts = lambda rules: {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert verdicts((("net/", "block"),)) == {1: "block", 2: "block", 3: "block"}
    assert verdicts((("net/", "allow"),)) == {1: "allow", 2: "allow", 3: "allow"} == verdicts((("gov/", "block"),))


# 10. benchmark leaks


@pytest.mark.parametrize("name", ["op10_positional_decontamination", "proximity_matches"])
def test_leaks_equal_sql(spark, name):
    con = duckdb.connect()
    for source in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {source} AS FROM '{SMALL}/{source}.parquet'")
    twin = con.sql(queries.ORACLE_SQL[name])
    rows = queries.QUERIES[name](spark, SMALL)
    assert sorted(twin.columns) == sorted(rows.columns)
    found = sorted(map(tuple, rows.select(*twin.columns).collect()))
    assert found and found == sorted(twin.fetchall())


def test_long_items_of_few_words(spark):
    """An item of 20,000 words over 500 different ones, four copies of it, and rows that are repeated."""
    rng = random.Random(11)
    item = " ".join(f"w{rng.randrange(500)}" for _ in range(20_000))
    docs = [(i, "before " + item) for i in range(4)] + [(3, "before " + item)] * 3 + [(9, " ".join(f"w{rng.randrange(500)}" for _ in range(20_000))), (None, "w1 w2"), (None, None)]
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "w7"), (3, "nowhere"), (4, "")], "item_id long, text string")
    found = sorted(map(tuple, decontamination.contamination(spark_docs, items).select("n_words", "n_hit", "n_items").collect()))
    alone = sum(w == "w7" for w in docs[-3][1].split())
    assert found == sorted([(20_001, 20_000, 2)] * 7 + [(20_000, alone, 1), (2, 0, 0), (0, 0, 0)])
    kept = decontamination.drop_contaminated(spark_docs.withColumn("x", F.lit(1)).withColumn("row", F.lit(2)), items)
    assert kept.columns == ["doc_id", "text", "x", "row"] and sorted(r.text or "" for r in kept.collect()) == ["", "w1 w2"]


def test_one_window_of_many_items_many_times(spark):
    """A window that stands 20,000 times in a text and in 200 items is looked up in them once."""
    import time

    window = " ".join(f"v{i}" for i in range(10))
    docs = spark.createDataFrame([(1, " ".join([window] * 20_000)), (2, "x " + window), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{window} own{i}") for i in range(200)], "item_id long, text string")
    began = time.time()
    found = sorted(map(tuple, decontamination.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items").collect()))
    assert found == [(1, 200_000, 200_000, 200), (2, 11, 10, 200), (3, 1, 0, 0)]
    assert time.time() - began < 30
    _, matches = decontamination.exact_matches(docs.filter("doc_id = 2"), items)
    assert sorted(map(tuple, matches.select("start", "width", "item_id").collect())) == [(1, 10, i) for i in range(200)]


def test_leaks_equal_plain_search(spark):
    random.seed(8)
    words = "a b c d e f g".split()
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice((1, 2, 3, 5, 10, 11, 14))))) for i in range(25)]
    for i, (_, text) in enumerate(items):
        docs.append((100 + i, "x y " + text + " z a"))
    found = {r.doc_id: r for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        ws, hits, ids = text.split(), set(), set()
        for j, item in items:
            iw = item.split()
            k = min(10, len(iw))
            for s in range(len(iw) - k + 1):
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[s : s + k]:
                        hits.update(range(p, p + k))
                        ids.add(str(j))
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(ws), len(hits), len(ids), bool(hits))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma z delta"), (2, "alpha " + "x " * 40 + "beta gamma delta"), (3, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha beta gamma delta")], "item_id long, text string")
    found = decontamination.proximity_matches(docs, items, terms=4, span=10).collect()
    assert [(r.doc_id, r.item_id, r["at"]) for r in found] == [(1, 7, 6)]
