"""Page text and benchmark decontamination."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vocaframe.llm import decontamination as D
from vocaframe.llm import html_text
from vocaframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("page", F.lit(2))


def texts(spark, rows, **options):
    return {r.page_id: r.main_text for r in html_text.extract(pages(spark, rows), **options).collect()}


def test_article_without_the_other_parts(spark):
    body = ("<body><nav><a>menu</a></nav><header>top</header><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>One  <b>tw</b>o\n three<p>four<br>five"
            "<script>var t='</p>';</script><aside>side</aside><div id='comments'><p>nice</p></div><form>x<input></form></article><footer>end</footer></body>")
    assert texts(spark, [(1, "http://a.b/c", f"<html><head><title>t</title><style>p{{}}</style></head>{body}</html>")]) == {1: "A & B One two three four five"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "::bad", "a < b &lt; c &#x41;&nbsp;d <!-- x -- > y"), (4, "u", "<p>never <b>closed"), (5, "u", "<div><p>x</div></p></div>y<a href='>'>z</a>"), (5, "u", "<div><p>x</div></p></div>y<a href='>'>z</a>"), (6, "u", "<p>" * 3000 + "deep" + "<div>" * 3000)]
    got = texts(spark, rows)
    assert got == {1: "", 2: "", 3: "a < b < c A d", 4: "never closed", 5: "x yz", 6: "deep"}
    assert html_text.extract(pages(spark, rows).limit(0)).count() == 0


def test_style_tree_removes_what_the_pages_of_a_host_share(spark):
    page = "<body><div class=box>Welcome to this site</div><div class=body><p>text number {0} of {0}</p></div><div class=end>Best viewed in any size</div></body>"
    rows = [(i, f"http://same.host/{i}", page.format(i)) for i in range(12)] + [(99, "http://other.host/1", page.format(99))]
    got = texts(spark, rows)
    assert got[3] == "text number 3 of 3"
    assert got[99] == "Welcome to this site text number 99 of 99 Best viewed in any size"


def test_style_tree_removes_what_marked_articles_share(spark):
    page = "<body><{1}><div class=box>Read this first, dear visitor</div><h1>Title {0}</h1><p>text number {0} of {0}<div class=end>Best viewed in any size</div></{1}></body>"
    rows = [(i, f"http://{tag}.host/{i}", page.format(i, tag)) for n, tag in enumerate(("article", "main")) for i in range(100 * n, 100 * n + 12)]
    rows += [(999, "http://other.host/1", page.format(999, "article"))]
    got = texts(spark, rows)
    assert {i: t for i, t in got.items() if i != 999} == {i: f"Title {i} text number {i} of {i}" for i in got if i != 999}
    assert got[999] == "Read this first, dear visitor Title 999 text number 999 of 999 Best viewed in any size"


def test_copies_of_one_page_are_no_shared_branches(spark):
    rows = [(i, "http://copies.host/1", "<article><h1>A title</h1><p>the only text</p></article>") for i in range(9)]
    assert set(texts(spark, rows).values()) == {"A title the only text"}


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class=has-sidebar", "div id=page-with-comments", "section class=search-results", "div class=sidebar"])
def test_layout_wrappers_around_the_article(wrapper):
    tag = wrapper.split()[0]
    rest = "<div class=sidebar>side</div><div class=comments><article class=comment>nice</article></div>"
    read = lambda html: [t for t, _ in html_text.parse(html).kept()]
    for mark in ("main", "article", "div itemprop=articleBody"):
        article = f"<{mark}><p>the text</p></{mark.split()[0]}>"
        assert read(f"<body><{wrapper}>{article}{rest}</{tag}></body>") == ["the text"]
        assert read(f"<body><main><{wrapper}>{article}{rest}</{tag}></main></body>")[0] == "the text"
    if wrapper != "div class=sidebar":
        assert read(f"<body><{wrapper}><p>a text without any mark</p>{rest}</{tag}></body>") == ["a text without any mark"]


def test_parts_stay_out_beside_the_article():
    read = lambda html: [t for t, _ in html_text.parse(html).kept()]
    assert read("<body><article>text<div class=comments><article>nice</article></div></article><div class=related><article>more</article></div></body>") == ["text"]
    assert read("<body><p>text of a page<div class=comments-box><p>nice</div></body>") == ["text of a page"]
    assert read("<body><main></main><p>text outside</body>") == []


@with_data
def test_pages_of_the_table(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op6_html_text"](spark, SF).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = " ".join("".join(html_text.entities.unescape(p) for p in _strip(article)).split())
        assert r.text == plain and r.n_chars == len(plain)


def _strip(markup):
    import re

    return [re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", markup))]


# benchmark

WORD = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
                  "|[^\\x00-/:-@\\[-`{-\x7f\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u3004\u3008-\u3020\u3030\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f\U00020000-\U0003ffff]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def exact(docs, items, threshold=0.6, overlap=0.5):
    """All passages of all documents scored against all items: strings and
    dictionaries, nothing of the operator."""
    known = [(i, t, plain_words(t)) for i, t in items if t is not None]
    df = Counter(w for _, _, ws in known for w in set(ws))
    mean = sum(len(ws) for _, _, ws in known) / max(len(known), 1)
    out = set()
    for item, text, ws in known:
        if not ws:
            continue
        weight = {w: math.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / max(mean, 1))) for w, n in Counter(ws).items()}
        ends = [m.end() for m in re.finditer(r"[.!?]+(?:\s+|$)|[。！？]+\s*", text)]
        cuts = [e for e in ends if text[e:].strip() and text[:e].strip()]
        border = len(plain_words(text[:cuts[-1]])) if cuts else len(ws) // 2
        pairs = list(zip(ws, ws[1:]))
        parts = [set(pairs[:max(border - 1, 0)]), set(pairs[max(border - 1, 0):])]
        half = 32
        while half < len(ws):
            half *= 2
        for doc, body in docs:
            own = plain_words(body)
            for s in range(0, len(own), half):
                here = own[s:s + 2 * half]
                got = set(zip(here, here[1:]))
                score = sum(x for w, x in weight.items() if w in set(here)) / sum(weight.values())
                if score >= threshold and (len(ws) > 1 or len(own) == 1) and all(len(p & got) >= overlap * len(p) for p in parts):
                    out.add((doc, item))
    return out


def found(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}


def test_items_in_scripts_without_spaces_and_of_one_word(spark):
    items = [(1, "东京是日本的首都。它有多少人口？"), (2, "ประเทศไทยอยู่ที่ไหน"), (3, "yes"), (4, "的"), (5, "The Capital of Peru is Lima.")]
    docs = [(1, "昨天他说，东京是日本的首都。它有多少人口？没有人知道。"), (2, "ฉันถามว่าประเทศไทยอยู่ที่ไหนครับ"), (3, "yes, the answer is yes of course"), (4, " Yes! "),
            (5, "大阪也是日本的城市。"), (6, "的"), (7, "We learn：the capital of Peru is Lima，he said"), (8, "日本的x首都"), (9, ""), (10, None)]
    got = found(spark, docs, items)
    assert got == exact(docs, items) == {(1, 1), (2, 2), (4, 3), (6, 4), (7, 5)}


def test_other_items_do_not_change_what_is_found(spark):
    rng = random.Random(3)
    filler = [f"f{rng.randrange(400)}" for _ in range(4000)]
    item = [f"w{i}" for i in range(12)]
    scattered = filler[:]
    for i, w in enumerate(item):  # the item's words, hundreds of words apart
        scattered[i * 300] = w
    docs = [(1, " ".join(scattered)), (2, " ".join(filler[:500] + item + filler[500:])), (3, " ".join(item))]
    alone = found(spark, docs, [(1, " ".join(item))])
    long = " ".join(f"x{i}" for i in range(3000))
    with_long = found(spark, docs + [(4, "pre " + long)], [(1, " ".join(item)), (2, long)])
    assert alone == {(2, 1), (3, 1)} and with_long == alone | {(4, 2)}


def test_pruned_search_finds_what_a_full_search_finds(spark):
    draw = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"] + ["the", "of"] * 10
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, prose(draw.randint(4, 30)).capitalize() + ". " + prose(6) + ".") for i in range(30)] + [(30, None), (31, ""), (32, "?!"), (0, "The same id again here now.")]
    docs = []
    for i in range(120):
        text = prose(draw.randint(0, 200))
        if i % 3 == 0:
            parts = draw.choice([t for _, t in items if t]).split()
            if parts and i % 2:
                parts[draw.randrange(len(parts))] = "changed"
            text += " " + " ".join(parts) + " " + prose(draw.randint(0, 90))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("hits", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    assert got == exact(docs, items) and len(got) > 10
    left = D.clean(df, bench)
    assert left.columns == df.drop("hits").columns or left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.clean(df.limit(0), bench).count() == 0


def test_a_large_benchmark_is_matched_in_slices(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i}. Epsilon{i} zeta{i}.") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"xx yy alpha{i} beta{i} gamma{i} delta{i}. Epsilon{i} zeta{i}. zz") for i in range(20)], "doc_id long, text string")
    whole = {(r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect()}
    monkeypatch.setattr(D, "INDEX_BYTES", 200)
    assert {(r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect()} == whole and len(whole) == 20


@with_data
def test_every_planted_item_is_found_and_little_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert planted and planted <= got
    assert len(got - planted) <= 0.1 * len(planted)
