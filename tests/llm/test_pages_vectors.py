"""URL rules, HTML rendering and vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import htmltext, subspace, urlfilter
from quarry.llm.queries import URL_RULES

URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.NET/en/1?x=1",
    "https://example.net/fr/",
    "http://x.net",
    "http://notnet/",
    "ftp://é.ORG/fr/a#b",
    "http://example.com/de/9",
    "http://a.example.com/de/://z",
    "http://org/fr/",
]


def rule_of(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judge(pages, labels, URL_RULES).collect()}
    for k, u in enumerate(URLS):
        host, path, rule, verdict = rule_of(u)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow")
    assert urlfilter.judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_mined_rules_match_by_index(spark):
    rows = [(k, f"http://{'spam' if k % 3 == 0 else 'fine'}.example.com/{'pills' if k % 2 else 'news'}/{k}?ref=x") for k in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    blocked = lambda k: k % 3 == 0 and k % 2 == 1
    labels = spark.createDataFrame([(k, 0 if blocked(k) else 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels, [], confidence=0.9).collect()}
    assert got == {k: "block" if blocked(k) else "allow" for k in range(240)}


def test_prune_and_index():
    rules = [(("a",), 0.9), (("a", "b"), 0.8), (("b", "c"), 0.7), (("a", "c"), 0.95)]
    kept = urlfilter.prune(rules)
    assert kept == [(("a",), 0.9), (("a", "c"), 0.95), (("b", "c"), 0.7)]
    index = urlfilter.inverted_index(kept)
    for own in ({"a"}, {"b"}, {"b", "c"}, {"c"}, set()):
        by_index = any(r <= own for t in own for r in index.get(t, ()))
        assert by_index == any(set(t) <= own for t, _ in kept)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, None),
        ("", ""),
        ("<p>One<p>Two &amp; three", "One\n\nTwo & three"),
        ("<title>t</title><script>var a='<p>';</script>a<style>p{}</style>b<!-- c --> d", "ab d"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>H<th>Long head<tr><td>1<td>2<td>3</table>", "H  Long head\n1  2          3"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>aaaa<td>b<td>y</table>", "wide     x\naaaa  b  y"),
        ("a<span hidden>no</span><p style='color:red; display : none'>no</p><b>c</b>", "ac"),
        ("<pre> x\n   y</pre>z", "x\n   y\n\nz"),
        ("<p>a</b></i>b</div>c", "abc"),
        ("x <!-- never closed <p>y", "x"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a &lt;b&gt; 1 < 2", "a <b> 1 < 2"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<p title=it's>one</p><p>don't</p>", "one\n\ndon't"),
        ("<a title='x > y' href=z>t</a>", "t"),
        ("<table><tr><td>a<td>bb<tr><td>x<br>y<td>z<tr><td>ccc<td>d</table>", "a    bb\nx\ny\nz\nccc  d"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td>long<td>c</table>", "r     a\n      b\nlong  c"),
        ("<math><mi>x</mi><mo>+</mo><annotation>TeX</annotation></math>", "x+"),
        ("a<svg><title>t</title><desc>d</desc>no<text>drawn</text></svg>b", "a\ndrawn\nb"),
        ("<dialog>shut</dialog><dialog open>open</dialog>", "open"),
        ("<object data=x>no</object><object>yes</object>", "yes"),
        ("<input type=submit value='Go on'><input type=hidden value=h><input type=text>", "Go on"),
    ],
)
def test_rendering(page, text):
    got = htmltext.render(page)
    assert (got and got.lstrip("\n")) == text if not (text or "").startswith("x\n   ") else got.strip() == text


def test_deep_nesting():
    page = "<div>" * 30000 + "deep" + "</div>" * 30000 + "<p>after"
    assert htmltext.render(page).split("\n") == ["deep", "", "after"]
    for kind in ("hidden", "style='display:none'"):
        assert htmltext.render("<div>" * 3000 + f"<span {kind}>secret<b>too</b></span>seen") == "seen"
    assert htmltext.render("<b>" * 20000 + "x" + "</i>" * 20000 + "y") == "xy"


def test_random_trees_against_a_plain_renderer():
    rng = random.Random(3)
    names, word = ["div", "p", "span", "b", "section", "h2", "em", "article"], iter(range(10**9))

    def tree(depth):
        """(tag or None for text, hidden, children)"""
        if depth == 0 or rng.random() < 0.3:
            return (None, False, f"w{next(word)}" + rng.choice(["", " ", "\n "]))
        return (rng.choice(names), rng.random() < 0.15, [tree(depth - 1) for _ in range(rng.randint(0, 4))])

    def source(node):
        tag, hidden, inner = node
        if tag is None:
            return inner
        if tag in ("p", "h2"):  # hold no blocks
            inner = [x for x in inner if x[0] in (None, "span", "b", "em")]
        off = rng.choice([" hidden", " style='display:none'", ' style="color:red;visibility : hidden"']) if hidden else ""
        return f"<{tag}{off}>{''.join(map(source, inner))}</{tag}>"

    def plain(page):
        """Lines of visible words, by the standard library's parser."""
        from html.parser import HTMLParser

        text, shut = [], []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attributes):
                a = dict(attributes)
                shut.append("hidden" in a or "none" in (a.get("style") or "") or "hidden" in (a.get("style") or ""))
                if tag not in ("span", "b", "em") and not any(shut):
                    text.append("\x00")

            def handle_endtag(self, tag):
                if tag not in ("span", "b", "em") and not any(shut):
                    text.append("\x00")
                shut.pop()

            def handle_data(self, data):
                if not any(shut):
                    text.append(data)

        Reader().feed(page)
        return [" ".join(x.split()) for x in "".join(text).split("\x00") if x.strip()]

    def nests_paragraphs(node, inside=False):
        tag, _, inner = node
        return tag is not None and (inside and tag not in ("span", "b", "em") or any(nests_paragraphs(x, inside or tag in ("p", "h2")) for x in inner))

    seen = 0
    for _ in range(400):
        node = tree(5)
        if nests_paragraphs(node):
            continue
        page = source(node)
        assert [x for x in htmltext.render(page).split("\n") if x] == plain(page)
        seen += 1
    assert seen > 100


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (3, "", "old"), (3, "", "old")], "page_id long, html string, text string")
    out = htmltext.extract(pages)
    assert out.columns == ["page_id", "text"] and sorted(map(tuple, out.collect()), key=str) == [(1, "a"), (2, None), (3, ""), (3, "")]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(subspace, "TILE", 8)
    rng, rows = np.random.default_rng(4), []
    for label in (0, 1):
        for c in rng.normal(size=(6, 64)):
            rows += [(label, c + rng.normal(size=64) * s) for s in (0.0, 0.0, 0.1, 0.25, 0.3, 0.35, 0.4)]
        rows += [(label, rng.normal(size=64)) for _ in range(40)]
    rows += [(None, rows[0][1]), (1, np.zeros(64)), (0, rows[0][1] * 3.0), (1, np.full(64, np.nan)), (1, np.ones(3)), (1, np.ones(3) * 2)]
    data = [(k, [float(x) for x in v], label, "clash") for k, (label, v) in enumerate(rows)] + [(len(rows), None, 1, "clash"), (len(rows) + 1, [], 1, "clash"), (len(rows) + 2, [None, 1.0], 1, "clash")]
    n = len(data)
    links, root = Counter(), list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            (la, a), (lb, b) = rows[i], rows[j]
            if la is None or la != lb or len(a) != len(b) or not np.isfinite([*a, *b]).all() or not a.any() or not b.any():
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert len(links) > 40
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in subspace.near_vectors(df).collect()}
    assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in range(n)] == [(links[k], find(k), find(k) == k) for k in range(n)]
    assert subspace.near_vectors(df.limit(0)).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 64))
    rows = [(1, a), (1, b), (None, a * 1.01 + 0.001), (2, b + 0.01 * a), (None, -a), (None, None), (3, a)]
    df = spark.createDataFrame([(k, None if v is None else v.tolist(), 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in subspace.near_vectors(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 2, 1, False)])


def test_pairs_near_the_bound_are_verified_exactly(spark):
    rng = np.random.default_rng(12)
    a = rng.normal(size=64)
    a /= np.linalg.norm(a)
    rows = [a]
    for k, eps in enumerate((1e-12, 1e-9, 1e-7, 1e-5, -1e-12, -1e-9, -1e-7, -1e-5)):
        o = rng.normal(size=64)
        o -= (o @ a) * a
        o /= np.linalg.norm(o)
        c = 0.93 + eps
        rows.append(c * a + (1 - c * c) ** 0.5 * o)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    x = np.array(rows)
    exact = [(x[i] @ x[j]) / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93 for i in range(9) for j in range(9)]
    links = (np.array(exact).reshape(9, 9).sum(1) - 1).tolist()
    assert links[0] >= 4
    got = {r.vec_id: r.n_links for r in subspace.near_vectors(df).collect()}
    assert [got[k] for k in range(9)] == links


def test_mining_against_all_combinations(spark):
    from itertools import combinations

    rng = random.Random(10)
    rows = []
    for k in range(400):
        tokens = sorted(rng.sample("abcdefgh", rng.randint(1, 5)))
        tokens += ["twin"] * ("a" in tokens)  # always beside a
        bad = rng.random() < (0.9 if {"a", "c"} <= set(tokens) else 0.85 if {"b", "d", "e"} <= set(tokens) else 0.2)
        rows.append((tokens, bad))
    found, item = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), longest=3)
    index, share = urlfilter.inverted_index(found), sum(b for _, b in rows) / len(rows)
    good = set()
    for size in (1, 2, 3):
        for c in combinations([*"abcdefgh", "twin"], size):
            held = [b for t, b in rows if set(c) <= set(t)]
            if sum(held) >= 8 and sum(held) >= 0.5 * len(held) and urlfilter.least_share(sum(held), len(held)) >= 0.5 and sum(held) / len(held) >= 1.5 * share:
                good.add(frozenset(c))
    assert good
    for size in range(5):
        for c in combinations([*"abcdefgh", "twin"], size):
            assert bool(urlfilter.fitting(index, {item[t] for t in c if t in item})) == any(g <= set(c) for g in good), c


@pytest.mark.parametrize("widest", [12, 3, 40])
def test_mining_keeps_all_items_of_wide_urls(spark, widest):
    fill = [f"f{k:02d}" for k in range(14)]
    rows = [(fill + ["x", "y"], True)] * 40 + [([f for k, f in enumerate(fill) if k != j % 14], False) for j in range(70)]
    rows += [(["x"], False)] * 100 + [(["y"], False)] * 100
    found, item = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), longest=3, widest=widest)
    # The fillers lift the label more than x and y do, but no combination of them is a rule.
    assert sorted(r for r, _ in found) == sorted([("x", "y"), *((f, z) for f in fill for z in "xy")])
    assert all(share == 1.0 for _, share in found) and set(item) == {*fill, "x", "y"}


def test_long_shared_paths_are_one_item(spark):
    long = "/".join(f"seg{chr(97 + k)}" for k in range(24))
    rows = [(k, f"http://x{k}.example.org/{long}/{k}") for k in range(30)] + [(100 + k, f"http://y{k}.example.net/ok") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 100), 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels, []).collect()}
    assert got == {k: "block" if k < 100 else "allow" for k, _ in rows}


def test_lower_bound_of_a_share():
    assert urlfilter.least_share(8, 8) == pytest.approx(8 / (8 + 1.645**2))
    assert urlfilter.least_share(0, 5) == pytest.approx(0) and urlfilter.least_share(50, 100) < 0.5
