import hashlib
import html as html_lib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_text as ht
from corpusloom.llm import url_filter as uf
from corpusloom.llm import winnowing as wn


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("<p>a<p>b</b></i>c", "a bc"), ("<div class='ad-box'>x</div><p>y &amp;&nbsp; z</p>", "y & z"), ("<script>var a='</p>';", ""),
    ("<article>a<div class=comments>b</div><b>c</article>d", "a c"), ("<body><nav>n</nav><div>q<br>r</div><ul><li>1<li>2</ul>", "q r 1 2"),
    ("<p a='>'>k</p>", "k"), ("</br>x<!--", "x"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<article><h1>T</h1>\n<p>a\n b</p></article><footer>f</footer>", "T a b"),
    ("<aside>s</aside><form><p>f</p></form><header>h</header><main>m<section id=respond>r</section></main>", "m"), ("<p>a</p><div role=navigation>n</div><div hidden>h</div>", "a"),
    ("<article><p>x</p></article><article class='comment'>y</article>", "x"), ("<article>a<p>b" + "<b>" * 3000 + "c", "a bc"),
])
def test_page_text(source, want):
    assert ht.Page(source).text() == want


@pytest.mark.parametrize(("source", "want"), [
    ("<div class='site has-sidebar'><article>a</article><div class=sidebar>s</div></div>", "a"), ("<article class='post category-social no-comments'>a</article>", "a"),
    ("<div class='site sidebar'><p>o</p><article class='post social'>a<div class=share>s</div></article></div>", "a"), ("<main><div class=widget><article>a</article></div></main>", "a"),
    ("<main><article>a</article><div id=comments class=comments-area><article class=comment-body>c</article></div></main>", "a"), ("<main>t<div class=comments><article class=comment>c</article></div></main>", "t"),
    ("<div class='no-comments'><p>t</p></div><div class='site-header'>h</div><div class='comment-list'>c</div>", "t"), ("<nav><article>x</article></nav><p>t</p>", "t"),
])
def test_class_words_leave_articles(source, want):
    assert ht.Page(source).text() == want


@pytest.mark.parametrize(("source", "want"), [
    ("<p title='>'>a</p><p title=\"x>y\">b</p>", "a b"), ("<a href=\"x>c</a><p>d", "c d"), ("it's <b it's>e</b>", "it's e"), ("a <b", "a"), ("a </", "a"), ("<p>a</></p>b", "a</> b"),
    ("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", "1 2 3 4"), ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2 3"), ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"), ("<b><article>x</b>y</article>z", "xy"), ("x<!doctype html><?xml y?>z", "xz"),
])
def test_broken_markup(source, want):
    assert ht.Page(source).text() == want


@pytest.mark.parametrize("part", ["<b ", "</p>", "<div>", "<p>", "<li>", "<b><article>", "</b>", "<a x=\"", "<a x='>' ", "<a<", "< ", "<!-", "&amp", "<td>", "a=b \"c' "])
def test_long_pages_take_time_in_proportion(part):
    """300,000 pieces, also within 8,000 open elements: seconds, whatever the markup."""
    began = time.perf_counter()
    for source in (part * 300_000, "<b>" + "<div>" * 8000 + part * 60_000 + "</b></p>" * 8000):
        ht.Page(source).text()
    assert time.perf_counter() - began < 30


def plain_templates(rows, min_pages, min_share):
    """Template blocks per host, by writing out each block's source: pages here are well-formed, without p or li to close."""
    import re

    found = {}
    total = {}
    for url, html in rows:
        host = url.split("/")[2]
        total[host] = total.get(host, 0) + 1
        here, stack = {}, []
        for m in re.finditer(r"<(/?)(\w+)>", html):
            if m[1]:
                name, at, inside = stack.pop()
                if name not in ("body", "article"):
                    block = html[at : m.end()]
                    here[block] = here.get(block, False) or not inside
            else:
                stack.append((m[2], m.start(), any(x[0] == "article" for x in stack)))
        for block, outside in here.items():
            n = found.setdefault((host, block), [0, 0])
            n[0] += 1
            n[1] += outside
    return {k for k, (n, out) in found.items() if n >= min_pages and n >= min_share * total[k[0]] and 2 * out >= n}


def test_templates_equal_a_plain_count(spark):
    """Pages without article and without telling names: what recurs goes, and nothing but the template decides it."""
    import random
    import re

    rng = random.Random(4)
    blocks = [f"<div><h2>box {i}</h2><section>always {i} the same</section></div>" for i in range(6)]
    rows = []
    for i in range(120):
        host = f"h{i % 4}.org"
        parts = [b for j, b in enumerate(blocks) if rng.random() < (0.9, 0.5, 0.25, 0.15, 0.1, 0.02)[j]]
        parts.append(f"<div><section>own {i}</section></div>")
        rng.shuffle(parts)
        body = "".join(parts)
        rows.append((f"http://{host}/{i}", f"<body>{'<article>' + body + '</article>' if i % 4 == 3 and i % 3 else body}</body>"))
    template = plain_templates(rows, 8, 0.2)
    assert {h for h, _ in template} == {f"h{i}.org" for i in range(3)} | ({"h3.org"} & {h for h, _ in template})
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in ht.extract(df).collect()}
    changed = 0
    for i, (url, html) in enumerate(rows):
        left = html
        for host, block in template:
            if host == url.split("/")[2]:
                left = left.replace(block, " ")
        want = " ".join(re.sub(r"<[^>]*>", " ", left).split())
        assert got[i] == want
        changed += want != " ".join(re.sub(r"<[^>]*>", " ", html).split())
    assert changed > 60


def test_copies_keep_their_article(spark):
    rows = [(i, f"http://a.org/{i}", "<body><div id=page><p>top</p><article>one text</article></div></body>", 1) for i in range(12)]
    assert {r.text for r in ht.extract(pages(spark, rows)).collect()} == {"one text"}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")


def test_template_is_removed_per_host(spark):
    box = "<div><p>Welcome to our place</p><p>read on</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{box}<div><p>story {i}</p></div></body>", 1) for i in range(12)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body>{box if i == 0 else ''}<div>tale {i}</div></body>", 1) for i in range(12)]
    rows += [(200 + i, f"http://c.org/{i}", f"<article>{box}<p>piece {i}</p></article>", 1) for i in range(12)]
    rows += [(300, None, None, 1), (301, "odd", "<p>x", 1), (None, "http://a.org/", "<p>y</p>", 1), (302, "http://a.org/z", "", 1)]
    got = {r.page_id: (r.text, r.n_chars) for r in ht.extract(pages(spark, rows).repartition(3)).collect()}
    assert all(got[i][0] == f"story {i}" for i in range(12))
    assert got[100][0] == "Welcome to our place read on tale 0"  # once on its host
    assert all(got[200 + i][0] == f"Welcome to our place read on piece {i}" for i in range(12))  # content
    assert (got[300], got[301], got[None], got[302]) == (("", 0), ("x", 1), ("y", 1), ("", 0))
    assert ht.extract(pages(spark, rows).where("false")).collect() == []


def test_template_goes_from_articles_too(spark):
    box = "<div><p>Welcome to our place</p><p>read on</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{box}<div>story {i}</div></body>", 1) for i in range(12)]
    rows += [(100 + i, f"http://a.org/p{i}", f"<body><article>{box}<p>piece {i}</p></article></body>", 1) for i in range(6)]
    rows += [(200 + i, f"http://a.org/c{i}", "<body><article><p>one text in copies</p></article></body>", 1) for i in range(12)]
    got = {r.page_id: r.text for r in ht.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"story {i}" for i in range(12))
    assert all(got[100 + i] == f"piece {i}" for i in range(6))
    assert all(got[200 + i] == "one text in copies" for i in range(12))


def test_made_pages_give_their_articles(spark):
    """The test tables' pages: exactly the article's text."""
    import os
    import re

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    got = {r.page_id: r.text for r in ht.extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "Bad.net/"), ("allow", "bad.net/"), ("block", "x.com/"), ("block", "É.Org/Ü"), ("allow", "é.org/")]
URLS = [
    "http://example.com/en/1", "http://www.EXAMPLE.com/en/1", "http://a.www.example.com/en/", "http://example.com/de/", "http://notexample.com/en/", "https://a.net/es/x?y", "https://a.net/es", "https://bad.net/q",
    "https://x.com/", "ftp://x.com?/a", "http://x.com#a/b", "no scheme", "", None, "://", "http://u.example.com", "http://example.com/en", "http://é.com/ü", "a://b://com/x", "http://É.ORG/Ü1", "http://É.org/ü", "http://é.org/Ü", "http://a.É.org/Üx",
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail.split("?")[0].split("#")[0] if tail.startswith("/") else ""
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        h = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            key = (len(rule), len(h), verdict == "block", f"{h}/{p}", verdict)
            best = max(best or key, key)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("listed", [False, True])
def test_urls_equal_brute_force(spark, listed):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "verdict string, rule string") if listed else RULES
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, rules).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(URLS)}
    assert uf.judge(df.where("false"), rules).collect() == []
    named = df.withColumnRenamed("url", "link").select("page_id", "link", "host")
    again = uf.judge(named, rules, keep=("page_id", "host"), url_col="link").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in again} == got


def test_long_lists_come_from_a_table(spark):
    """The file that Spark's sorted rules are streamed into is the one built from a list; workers map it."""
    many = [("block" if i % 3 else "allow", f"host{i % 5000}.org/{'p' * (i % 7)}/é{i}") for i in range(20_000)] + RULES
    table = spark.createDataFrame(many, "verdict string, rule string").repartition(5)
    block = b"".join(uf.SortedDigests.stream(table))
    assert block == uf.SortedDigests.build(many)
    df = spark.createDataFrame([(i, f"http://a.host{i}.org/{'p' * (i % 7)}/é{i}/x") for i in range(500)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in uf.judge(df, table, default="none").collect()}
    assert got == {i: "block" if i % 3 else "allow" for i in range(500)}


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id bigint, url string")
    assert [r.verdict for r in uf.judge(df, [], default="block").collect()] == ["block"]


def test_collisions_are_told_apart():
    block = uf.SortedDigests.build([("block", "a.org/"), ("block", "b.org/")])
    keys = uf.SortedDigests(block).keys
    same = block[:24] + keys[:1].tobytes() * 2 + block[40:]  # both rules under one key
    d = uf.SortedDigests(same)
    names = {d.rule(0), d.rule(1)}
    assert names == {b"a.org/", b"b.org/"}
    first = next(n for n in names if uf.key_of(n) == int(keys[0]))
    assert d.rule(int(d.probe([first])[0])) == first and d.probe([b"c.org/"])[0] == -1


def gram_hash(gram):
    """The hash of a gram, one code point after the other."""
    word, base, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    h = 0
    for ch in gram:
        h = (h * base + (ord(ch) + 1) * mix) & word
    h ^= h >> 29
    return (h * mix & word) >> 32


def brute_winnow(text, k, w):
    """Positions that the windows select, by looking at each window."""
    n = len(text)
    k = min(k, n)
    if not n:
        return []
    grams = [text[i : i + k] for i in range(n - k + 1)]
    h = {g: gram_hash(g) for g in set(grams)}
    w = min(w, len(grams))
    out = []
    for i in range(len(grams) - w + 1):
        best = min(range(i, i + w), key=lambda j: (h[grams[j]], -j))
        if not out or out[-1] != best:
            out.append(best)
    return out


@pytest.mark.parametrize("text", ["", "a", "ab" * 40, "a" * 100, "the cat sat on the mat and the cat ran", "é😀x" * 30, "".join(chr(97 + (i * i) % 26) for i in range(300))])
@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 4), (5, 7), (12, 20)])
def test_winnowing_equals_brute_force(text, k, w):
    at, hashes = wn.winnow(text, k, w)
    assert at.tolist() == brute_winnow(text, k, w)
    assert hashes.tolist() == [gram_hash(text[i : i + min(k, len(text))]) for i in at.tolist()]


def test_match_guarantee():
    rng = np.random.default_rng(0)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    for _ in range(50):
        common = word(wn.WINDOW + wn.K - 1)
        a, b = (wn.winnow(word(200) + common + word(150)) for _ in range(2))
        shared = np.intersect1d(a[1], b[1])
        assert len(shared) and all(200 <= p <= 200 + wn.WINDOW for p in a[0][np.isin(a[1], shared)])


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_compare_with_next(spark, docs, corpus, empty, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, t) for i, t in corpus if i is not None]
        rows = rows[:-2]  # the repeated rows
        df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit(1).alias("fingerprint"))
        got = {r.doc_id: r for r in wn.compare_with_next(df).collect()}
        every = wn.compare_with_next(docs).count()
        one = wn.compare_with_next(df.where("doc_id = 1")).collect()
        nothing = wn.compare_with_next(empty).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert every == len(corpus) and nothing == []
    assert len(one) == 1 and one[0].near_next == 1.0
    rows.sort(key=lambda r: r[0])
    assert set(got) == {i for i, _ in rows}
    by_text = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        fp, fe, fn = (set(wn.winnow(x)[1].tolist()) for x in (t, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a and b else float(bool(a) == bool(b))
        assert r.near_edited == pytest.approx(like(fp, fe)) and r.near_next == pytest.approx(like(fp, fn))
        assert r.edited_fingerprint == wn.digest(wn.winnow(edited)[1])
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_fingerprints_keep_positions(spark, docs):
    for r in wn.fingerprints(docs).collect():
        assert len(r.positions) == len(r.hashes) and r.positions == sorted(set(r.positions))


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,2)", "double", "timestamp"])
def test_ids_of_any_orderable_type(spark, kind):
    texts = [f"text number {i} " * (i % 5) for i in range(40)]
    made = {"string": "concat('k', lpad(i, 3, '0'))", "date": "date_add(date'2020-01-01', i)", "decimal(20,2)": "cast(i / 4.0 as decimal(20,2))", "double": "i / 8.0", "timestamp": "timestamp_seconds(i)"}[kind]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr(f"cast({made} as {kind}) as doc_id", "text", "i as __text", "i as __extra").repartition(4)
    got = [r for r in wn.compare_with_next(df.unionByName(df.limit(1).selectExpr(f"cast(null as {kind}) as doc_id", "'' as text", "0 as __text", "0 as __extra"))).collect()]
    assert len(got) == 41
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id))
    order = ["", *texts]
    for r, t, after in zip(got, order, order[1:] + order[:1], strict=True):
        n = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert list(r.positions) == wn.winnow(t)[0].tolist()


def test_rows_without_an_id_are_dealt_to_tasks(spark):
    rows = [(None, f"text {i} " * 9) for i in range(60)] + [(i, f"word {i} " * 9) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt = wn.by_range(df.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("tie")), 8)
    per_range = [r["count"] for r in dealt.where("extra = 0 AND id IS NULL").groupBy("range").count().collect()]
    assert sum(per_range) == 60 and len(per_range) > 3 and dealt.where("extra = 1").count() == dealt.select("range").distinct().count()
    order = df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(r.text) // 4
        want.append((str(r.doc_id), hashlib.sha256((r.text[: len(r.text) - n] + after.text[:n]).encode()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert sorted((str(r.doc_id), r.edited_sha256) for r in wn.compare_with_next(df).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
