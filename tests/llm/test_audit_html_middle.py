"""Filter audit, HTML extraction and fill-in-middle against brute force, and on awkward tables."""

import collections
import hashlib
import html
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import fill_middle, filter_audit, queries, site_template

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def rows_of(spark):
    rng = random.Random(3)
    words = ["The", "of", "and", "café", "WORD", "x#1", "a|b"]
    text = lambda n, k=7: " ".join(rng.choice(words[:k]) + str(rng.randrange(9)) for _ in range(n))
    long, same = text(30_000), text(250, 3)
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (None, same, "fr"), (4, long, "en"), (5, same, "fr"), (5, same, "fr"), (6, same, "de"), (7, same, "fr"), (None, same, "fr"), (None, None, None)]
    rows += [(k, text(rng.randrange(150, 260), rng.randrange(3, 8)), rng.choice(["en", "fr", None, ""])) for k in range(10, 80)]
    rows += [(80, " ".join(f"w{k % 100}" for k in range(200)), "en"), (81, "AAA" + "b" * 97, "en"), (82, "AAAA" + "b" * 96, "en")]
    rows += [(83, "one\n<P> two\n", "en"), (84, "<P\n>x<S", "en"), (85, "\n\n\n", "en"), (86, "no end", "en"), (87, "é\U0001f600\n" * 50 + "\x00\r\n<", "en")]
    df = spark.createDataFrame([(i, t, g, "a", 1) for i, t, g in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("mask", "digest", "part", "n", "form", "output", "deal", "good")})


def labels_of(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(10, 60)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def oracle(sql, tables):
    """DuckDB's rows over Spark's tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if hasattr(df, "toPandas") else df)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    return names, sorted(r.fetchall(), key=repr)


# 11


def brute_audit(docs, labels):
    good, toxic = collections.defaultdict(bool), collections.defaultdict(bool)
    for r in labels:
        if r.doc_id is not None:
            good[r.doc_id] |= r.quality == 1
            toxic[r.doc_id] |= r.toxic == 1
    least = {}
    for r in docs:
        if r.doc_id is not None:
            t = r.text or ""
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    fails = []
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)),
            r.doc_id is not None and r.doc_id > least[t],
        )) if bad}
        fails.append((r.lang or "", f, good[r.doc_id], toxic[r.doc_id]))
    out, shapley = {}, collections.Counter()
    for part in {x[0] for x in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x[1:] for x in fails if x[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                lost, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[part, f] += len(lost)
                out[part, order, step] = [len(kept), len(lost), sum(f in x[0] for x in every) - len(lost), sum(x[0] == {f} for x in every), sum(x[1] for x in lost), sum(x[2] for x in lost)]
                left = kept
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit(spark):
    docs, labels = rows_of(spark).drop("part"), labels_of(spark)
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(docs.collect(), labels.collect())
    assert len(got) == 4 * 600


def test_audit_sql(spark):
    got = queries.op11_filter_audit(spark, SF)
    names, want = oracle(filter_audit.ORACLE, {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")})
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("n", range(1, 6))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), set()
    for k in filter_audit.swaps(n):
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == len(list(filter_audit.swaps(n))) == len(list(itertools.permutations(range(n))))


def test_audit_of_other_filters(spark):
    docs = rows_of(spark)
    got = filter_audit.audit(docs, labels_of(spark), {"X": filter_audit.few_words}).collect()
    assert {r.filter_order for r in got} == {"XE", "EX"}
    assert filter_audit.audit(docs.limit(0), labels_of(spark)).count() == 0


# 12

PROSE = "It was a bright day in {k} and the clocks of town {k} struck thirteen times, as {k} people say."


def site(k, body):
    return f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body class='has-sidebar'>{body}</body></html>"


def test_pages_of_the_driver(spark):
    got = {r.page_id: r.text for r in queries.op12_site_template(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(x for x in want if x)


def test_templates_of_a_host_go(spark):
    """Divisions without a name that recur on a host go there, and stay where they don't recur."""
    strip = "<div><span>Most read</span> <i>this week</i></div>"
    rows = [(k, f"http://a.org/{k}", site(k, f"<div>Home | News</div><div><p>{PROSE.format(k=k)}</p>{strip}<p>End {k}.</p></div>")) for k in range(20)]
    rows += [(100 + k, f"http://b{k}.org/", site(k, f"<div>Home | News</div><p>{PROSE.format(k=k)}</p>")) for k in range(20)]
    got = {r.page_id: r for r in site_template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(20):
        assert got[k].text == f"{PROSE.format(k=k)}\nEnd {k}." and got[k].n_templates == 2
        assert got[100 + k].text == f"Home | News\n{PROSE.format(k=k)}" and got[100 + k].n_templates == 0


def test_copies_are_no_template(spark):
    """An article on many pages of a host, and its near copies, stay; so does a passage that many articles have."""
    article = "<div class=body>" + "".join(f"<p>{PROSE.format(k=k)} {'x' * k}</p>" for k in range(9)) + "</div>"
    near = "<section><p>Same section.</p></section>" + article
    rows = [(k, "http://a.org/", site(0, f"<nav><a>Home</a></nav>{article}")) for k in range(40)]
    rows += [(100 + k, "http://a.org/x", site(0, f"<article>{near}<p>{'longest ' * 40 if k % 10 else str(k) + ' longest ' * 45}</p></article>")) for k in range(60)]
    shared = f"<p>{PROSE.format(k='every')}</p>"
    rows += [(200 + k, f"http://c.org/{k}", site(k, f"{shared}<p>{PROSE.format(k=k)} {'y' * 50}</p>")) for k in range(30)]
    got = {r.page_id: r.text for r in site_template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].count("\n") == 8 for k in range(40))
    assert all(got[100 + k].count("\n") == 10 for k in range(60))
    assert all(got[200 + k].startswith(PROSE.format(k="every") + "\n") for k in range(30))


OTHERS = {
    "header and aside": ("<header><h1>Site</h1></header><main><h1>Head</h1><p>One</p></main><aside>Side</aside><footer>f</footer>", "Head\nOne"),
    "names": ("<div id=cookie-notice>Cookies?</div><div class='content'><p>One</p><p>Two &amp; three</p><div class='ad-banner'>Buy</div></div><div class=siteFooter>f</div><section id='comments'><article><p>" + "I liked it much. " * 9 + "</p></article></section>", "One\nTwo & three"),
    "article head": ("<article><header><h1>Head</h1></header><p>A<b>b</b>\n c&nbsp;d</p><form><input>Mail<button>Send</button></form><footer>by me</footer></article>", "Head\nAb c d"),
    "form round all": ("<form id=aspnet><div role=navigation>Nav</div><article><p>" + "Long text. " * 9 + "</p></article><div role=search>s</div></form>", ("Long text. " * 9).strip()),
    "unclosed": ("<nav><ul><li>a<li>b</ul></nav><article><p><b>One<br><p>Two<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "One\nTwo\nx\ny\n12\n3"),
    "script text": ("<script>if (a<b) document.write('<p>no</p>')</script><article>x < y<!-- <p>c</p> -->z &lt;p&gt; &am</article><p>t", "x < yz <p> &am"),
    "cut tag": ("<article><p>One</p><p>Two</p><a href=\"x", "One\nTwo"),
    "quotes": ("<article><p title='a>b' data-x=it's>One \"q\"</p><p>Two</p></article>", "One \"q\"\nTwo"),
    "comment article": ("<main><p>" + PROSE + "</p><div class='comment-list'><p>" + PROSE * 3 + "</p></div></main>", PROSE),
    "no text": ("<nav>Home</nav>", ""),
}


@pytest.mark.parametrize("name", OTHERS)
def test_markup(name):
    body, want = OTHERS[name]
    assert site_template.Page(f"<html><body>{body}").main_text(1, set()) == (want, 0)


def test_awkward_pages(spark):
    deep, long = "<div>" * 3000 + "x" + "</div>" * 10, "<article>" + "<p>word &lt; 'q\" </p>" * 20_000 + "</article>"
    rows = [(1, None, None), (None, "http://A.org/", ""), (2, "x", "<<<>>"), (3, None, deep), (4, "http://a.org", long), (4, "http://a.org", long), (5, "", "<b " * 50_000), (6, "u", "<p a='" * 20_000), (7, "u", "</" * 20_000)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(7) for c in ("k1", "host", "marks", "text", "mark")})
    got = site_template.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text.count("\n") for r in got)[-2:] == [19_999, 19_999]
    assert site_template.extract(df.limit(0)).count() == 0


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(site_template, "BROADCAST_TEMPLATES", -1)
    test_templates_of_a_host_go(spark)


# 13


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_middle(spark):
    docs = rows_of(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = fill_middle.transformed(docs).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back"), "mask").collect()
    want = sorted(((r.doc_id, r.text, *brute_middle(r.doc_id, r.text), r.text or "", 7) for r in docs.collect()), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert fill_middle.transformed(docs.limit(0)).count() == 0
    assert {r.form for r in fill_middle.transformed(docs, rate=0).collect()} == {"plain"}
    assert "psm" not in {r.form for r in fill_middle.transformed(docs, spm_rate=100).collect()}


def test_middle_sql(spark):
    got = queries.op13_fill_middle(spark, SF)
    names, want = oracle(fill_middle.ORACLE, {"documents": spark.read.parquet(f"{SF}/documents.parquet")})
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


def test_lanes_see_what_one_walk_sees(monkeypatch):
    """The scan in lanes emits what the automaton emits byte by byte, wherever the lanes begin."""
    rng = random.Random(2)
    for size in (0, 1, 2, 3, 5, 700, 5000):
        data = "".join(rng.choice(["a", "\n", "é", "€", "\U0001f600", "<P>", "<S", "<", ">", "M", "\0"]) for _ in range(size)).encode()
        data = data.replace(b"\0", b"\xff")
        state, want = 0, []
        for byte in data:
            want.append(int(fill_middle.EMITS[state << 8 | byte]))
            state = int(fill_middle.TO[state << 8 | byte])
        for lanes in (1, 7, 8192):
            monkeypatch.setattr(fill_middle, "LANES", lanes)
            assert fill_middle.scan(data).tolist() == want
        whole = data.replace(b"\xff", b"").decode()
        events = fill_middle.scan(data.replace(b"\xff", b""))
        assert int((events & fill_middle.CHAR > 0).sum()) == len(whole)
        assert int((events & fill_middle.SENTINEL > 0).sum()) == len(re.findall("<[PSM]>", whole))
