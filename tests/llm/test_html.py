import random
import re
import time

import pytest

from voxmere.llm import html as H

PAGES = [
    ("<html><body><nav><ul><li>Home</ul></nav><article><h1>T &amp;  U&nbsp;</h1><p>one<br>two <i>x</i>y<p>three<div class='ad'>no</div><script>var a='</p>';</script></article><footer>f</footer></body>", "T & U\none two xy\nthree"),
    ("<body><div id=menu>m</div><div class='post'><p>first</p><ul><li>a<li>b</ul><div class=comments><p>bad</div></div><aside>s</aside>", "first\na\nb"),
    ("plain &lt;text&gt; only", "plain <text> only"),
    ("<article><p>cut in the mid", "cut in the mid"),
    ("", ""),
    (None, ""),
    ("<nav>menu</nav>", ""),
    ("<article>a</article><p>between</p><article>b</article>", "a\nb"),
    ("<body class='has-sidebar ad'><div class='with-menu'><article class='post search'><p>kept</p><section id='comment-list'><article>bad</article></section><article class=comment>bad</article></article></div>", "kept"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.example.com/x", page, "clash") for k, (page, _) in enumerate(PAGES)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, PAGES[0][0], "")], "page_id long, url string, html string, text string")
    found = H.extract_text(docs).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        want = PAGES[r["page_id"] or 0][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert H.extract_text(docs.filter("page_id < 0")).count() == 0


def test_template_of_a_host_goes(spark):
    notice = "<p>All about our terms on each page</p>"
    rows = [(k, "http://one.example.com/", f"<body><div class=box>{notice}<p>Story number {k} is told here at some length.</p></div></body>") for k in range(6)]
    found = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {f"Story number {k} is told here at some length." for k in range(6)}


def run(spark, pages):
    """Texts of pages (url, html) in their order."""
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [found[k] for k in range(len(rows))]


def story(k):
    return [f"Story {k} begins in town number {k * 7}.", f"It goes on for {k + 3} days in all."]


def test_only_the_wrapper_can_tell(spark):
    """No article or main elements and no telling names: what is the same on each page goes, what varies stays."""
    page = lambda k: f"<body><div><p>The Daily Example</p><p>Open each day</p></div><h1>Title {k}</h1><div class=x1><p>{story(k)[0]}</p><div><p>{story(k)[1]}</p></div></div><div class=x2>" + "".join(f"<p><a href=/{j}>Other story number {j * k + j}</a></p>" for j in range(4)) + "</div><div>All rights with us</div></body>"
    found = run(spark, [("http://plain.example/", page(k)) for k in range(1, 9)])
    assert found == ["\n".join([f"Title {k}", *story(k)]) for k in range(1, 9)]


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><div><p>The only story of this host</p><p>has two parts</p></div></body>"
    other = "<body><div><p>Another one</p></div></body>"
    found = run(spark, [("http://copies.example/", page)] * 7 + [("http://copies.example/", other)])
    assert found == ["The only story of this host\nhas two parts"] * 7 + ["Another one"]


def test_mixed_layouts_and_roots(spark):
    """Pages of one host with and without article elements; a story in main with a teaser as an article in it."""
    pages = [("http://mixed.example/", f"<body><p>Fixed line</p><article><h1>A{k}</h1><p>{story(k)[0]}</p></article></body>") for k in range(5)]
    pages += [("http://mixed.example/", f"<body><p>Fixed line</p><div><h1>D{k}</h1><p>{story(k)[1]}</p></div></body>") for k in range(5)]
    want = [f"A{k}\n{story(k)[0]}" for k in range(5)] + [f"D{k}\n{story(k)[1]}" for k in range(5)]
    pages += [("http://teaser.example/", f"<main><h1>M{k}</h1><p>{story(k)[0]}</p><p>{story(k)[1]}</p><article><p>Teaser {k}</p></article></main>") for k in range(4)]
    want += [f"M{k}\n{story(k)[0]}\n{story(k)[1]}\nTeaser {k}" for k in range(4)]
    pages += [("http://inner.example/", f"<main><p>Bread / crumbs</p><article><p>{story(k)[0]}</p></article><article><p>{story(k)[1]}</p></article></main>") for k in range(4)]
    want += ["\n".join(story(k)) for k in range(4)]
    assert run(spark, pages) == want


def matches(node, part):
    """Whether an element is in the language of an expression, by its parts' numbers and names, part by part."""
    within = [x for x in H._flat(node) if not isinstance(x, str) or x.strip()] if not node.key.startswith("!") else []
    keys = ["#" if isinstance(x, str) else x.key for x in within]
    keys = [k for n, k in enumerate(keys) if k != "#" or not n or keys[n - 1] != "#"]
    pattern, k, parts = "", 0, part[4]
    while k < len(parts):
        size = 1
        while parts[k][3] and k + size < len(parts) and parts[k + size][3] == parts[k][3]:
            size += 1
        items = [f"<{re.escape(x[0])}>" for x in parts[k : k + size]]
        pattern += f"(?:{''.join(f'(?:{x})?' for x in items)})*" if parts[k][3] else f"(?:{items[0]}){ {(0, 1): '?', (1, 1): '', (0, 2): '*', (1, 2): '+'}[parts[k][1], parts[k][2]] }"
        k += size
    by_key = {x[0]: x for x in parts}
    assert len(by_key) == len(parts)
    return bool(re.fullmatch(pattern, "".join(f"<{k}>" for k in keys))) and all(matches(x, by_key[x.key]) for x in within if not isinstance(x, str))


def random_page(r, depth=0):
    if depth > 3 or r.random() < 0.2:
        return r.choice(["text", " ", "<i>t</i>", ""])
    return "".join(f"<{t}>{random_page(r, depth + 1)}</{t}>" for t in r.choices(["div", "ul", "h2", "section", "b"], k=r.randint(0, 5)))


def test_the_wrapper_matches_every_page_it_comes_from():
    r = random.Random(3)
    for _ in range(60):
        tops = [H.parse(f"<body>{random_page(r)}</body>") for _ in range(6)]
        whole = H.expression(tops[0])
        assert matches(tops[0], whole)
        for top in tops[1:]:
            whole = H.merge(whole, H.expression(top))
        assert all(matches(top, whole) for top in tops)
        assert H.load(H.dump(whole)) == whole


def test_alignment_is_longest():
    """What stays in order is as long as the table of common subsequences says."""
    r = random.Random(4)
    for _ in range(200):
        places = r.sample(range(12), r.randint(0, 12))
        best = [0] * len(places)
        for k, p in enumerate(places):
            best[k] = 1 + max((best[j] for j in range(k) if places[j] < p), default=0)
        found = [places[k] for k in H._rising(places)]
        assert found == sorted(found) and len(found) == max(best, default=0)


def test_wrapper_alignment():
    a = H.expression(H.parse("<ul><li>x</li><li>y</li></ul><p>t</p>"))
    b = H.expression(H.parse("<ul><li>x</li></ul><div>d</div><p>t</p>"))
    text = ["#", 1, 1, 0, []]
    assert H.merge(a, b) == ["#", 1, 1, 0, [["ul", 1, 1, 0, [["li", 1, 2, 0, [text]]]], ["div", 0, 1, 0, [text]], ["p", 1, 1, 0, [text]]]]
    c = H.expression(H.parse("<p>t</p><ul><li>x</li></ul><p>t</p>"))
    assert [x[:4] for x in c[4]] == [["p", 0, 2, 1], ["ul", 0, 1, 1]]


@pytest.mark.parametrize("depth", [5, 2000, 20_000])
def test_deep_pages(depth):
    page = "<div>" * depth + "in" + "</div>" * depth
    began = time.time()
    assert [b[0] for b in H.blocks(H.parse(page))] == ["in"]
    H._deep()
    whole = H.expression(H.parse(page))
    merged = H.merge(whole, H.expression(H.parse("<div>" * (depth // 2) + "<p>x")))
    levels = 0
    while merged[4]:
        merged, levels = merged[4][0], levels + 1
    assert levels == depth + 1 and time.time() - began < 10


def test_pages_that_are_hard_to_read():
    """Work follows the length for quotes that don't close, tags that close nothing, and many children."""
    began = time.time()
    for page in ("<a title=\"" * 20_000, "<b x='" * 20_001 + ">", "<div>" * 5000 + "</span>" * 50_000, "<p>a<ul><li>b</ul>" * 10_000, "<!--" * 20_000, "<" * 100_000):
        top = H.parse(page)
        H.expression(top)
        H.blocks(top)
    assert time.time() - began < 30
    assert [b[0] for b in H.blocks(H.parse("<p title='a > b \"<i>'>x</p><p data-x=it's>y</p><p title=\"open>z</p>"))] == ["x", "y", "z"]


def test_wrappers_of_many_expressions(spark):
    """More expressions of one host than a group holds give a wrapper with all their names."""
    pages = [f"<body><div class='c{'abcdefghi'[k % 9]}'>{'<p>t</p><hr>' * (k % 3)}<i>x</i></div><ul id='u{chr(97 + k % 26)}{chr(97 + k // 26)}'>{'<li>z</li><dl></dl>' * (k % 5)}</ul></body>" + f"<h{k % 6 + 1}>" * (k % 31) for k in range(400)]
    shapes = {H.dump(H.expression(H.parse(p))) for p in pages}
    assert len(shapes) > 2 * H.FOLD
    found = H.infer_wrappers(spark.createDataFrame([("http://a.example/", p) for p in pages], "url string, html string")).collect()
    assert [(r["host"], r["pages"]) for r in found] == [("a.example", 400)]
    whole = H.load(found[0]["wrapper"])
    names = lambda e: {e[0]}.union(*map(names, e[4]))
    assert names(whole) == set().union(*(names(H.expression(H.parse(p))) for p in pages))
    assert all(matches(H.parse(p), whole) for p in pages)


def test_joined_infos_give_the_same(spark, monkeypatch):
    pages = [("http://plain.example/", f"<div><p>Fixed</p><p>{story(k)[0]}</p></div>") for k in range(6)] + [(None, None)]
    want = run(spark, pages)
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert run(spark, pages) == want == [story(k)[0] for k in range(6)] + [""]


def test_very_long_pages(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}.</p>" for k in range(60_000)) + "</article>"
    (found,) = run(spark, [("http://long.example/", page)])
    assert found == "\n".join(f"Paragraph {k}." for k in range(60_000))


def grown(r, n):
    return " ".join("".join(r.choices("aeioubcdrst", k=r.randint(2, 8))) for _ in range(n))


def test_template_inside_articles(spark):
    """Boxes without telling names, between, around and among the paragraphs of articles, at several hosts: precision and recall by block."""
    r = random.Random(12)
    pages, wants, boxed = [], [], set()
    for host in range(6):
        boxes = [f"Join our club {host} {grown(r, 6)}", f"Read this {grown(r, 9)}"]
        boxed |= set(boxes)
        for k in range(8):
            story_ = [grown(r, r.randint(5, 40)) for _ in range(r.randint(2, 7))]
            parts = [f"<p>{x}</p>" for x in story_]
            parts.insert(r.randint(0, len(parts)), f"<div class=x1><span>{boxes[0]}</span></div>" if host % 2 else f"<p>{boxes[0]}</p>")
            if k % 4:
                parts.append(f"<section><p>{boxes[1]}</p></section>")
            root = ("article", "main", "article")[host % 3]
            pages.append((f"http://h{host}.example/", f"<body><ul><li>top</ul><{root}>{''.join(parts)}</{root}></body>"))
            wants.append(story_)
    found = [t.split("\n") for t in run(spark, pages)]
    hits = sum(len(set(f) & set(w)) for f, w in zip(found, wants))
    assert hits >= 0.95 * sum(map(len, found)) and hits >= 0.95 * sum(map(len, wants))
    assert not boxed & {x for f in found for x in f}


def test_copies_of_a_story_are_no_template(spark):
    """Pages of one host that share most of their article, with other headers or a changed line, keep it."""
    r = random.Random(13)
    shared = [grown(r, 20) for _ in range(6)]
    pages = [("http://copies.example/", f"<body><i>{k}</i><article>{''.join(f'<p>{x}</p>' for x in shared)}<p>{grown(r, 12)}</p></article></body>") for k in range(9)]
    found = run(spark, pages)
    assert all(f.split("\n")[:6] == shared and len(f.split("\n")) == 7 for f in found)


def slow_extract(pages):
    """extract_text by loops over whole lists: one fold for each host, then counts of texts by slot."""
    hosts = {}
    for url, page in pages:
        hosts.setdefault(re.sub("^.*//|/.*$", "", url), []).append(page)
    out = {}
    for host, texts in hosts.items():
        shapes = {}
        for t in texts:
            shape = H.dump(H.expression(H.parse(t)))
            shapes[shape] = shapes.get(shape, 0) + 1
        whole = None
        for shape in sorted(shapes, key=lambda x: (-shapes[x], x)):
            whole = H.load(shape) if whole is None else H.merge(whole, H.load(shape))
        import json

        slots = H.Slots(json.dumps({"wrapper": H.dump(whole)}))
        filled = {t: H.blocks(H.parse(t), slots.tree) for t in set(texts)}

        def fixed(pages):
            held, has = {}, {}
            for t in pages:
                for text, _, slot, area in filled[t]:
                    held.setdefault((slot, area, text), set()).add(t)
                    has.setdefault((slot, area), set()).add(t)
            return {k for k, v in held.items() if len(v) >= 3 and 2 * len(v) > len(has[k[:2]])}

        first = fixed(set(texts))
        shown = set()
        for t in set(texts):
            inside = [(slot, area, text) for text, _, slot, area in filled[t] if area]
            n, same = sum(len(x[2]) for x in inside), sum(len(x[2]) for x in inside if x in first)
            if inside and (n - same) * 3 >= n:
                shown.add(t)
        template = {x for x in first if not x[1]} | {x for x in fixed(shown) if x[1]}
        chars = {}
        for t in set(texts):
            for text, links, slot, area in filled[t]:
                if (slot, area, text) not in template:
                    a = chars.setdefault((slot, area), [0, 0])
                    a[0], a[1] = a[0] + len(text), a[1] + min(links, len(text))
        main = sum(v[0] for k, v in chars.items() if k[1] == H.MAIN) > sum(v[0] for k, v in chars.items() if k[1] == H.ARTICLE)
        linky = {k[0] for k, v in chars.items() if k[1] == 0 and 2 * v[1] > v[0]}
        for t in set(texts):
            told = [b for b in filled[t] if b[1] * 2 <= len(b[0]) and not (b[1] and b[2] in linky)]
            for area in (H.MAIN, H.ARTICLE) if main else (H.ARTICLE, H.MAIN):
                within = [b for b in filled[t] if b[3] >= area]
                if within:
                    told = within
                    break
            out[host, t] = "\n".join(b[0] for b in told if all((b[2], a, b[0]) not in template for a in (0, 1, 2)))
    return [out[re.sub("^.*//|/.*$", "", url), page] for url, page in pages]


def test_extraction_against_a_slow_twin(spark):
    r = random.Random(14)
    lines = ["fixed one", "fixed two", "ad <a href=x>link here</a>", "<a href=y>go</a>"]
    pages = []
    for host in range(5):
        for _ in range(9):
            blocks_ = [r.choice(lines) if r.random() < 0.4 else grown(r, r.randint(1, 15)) for _ in range(r.randint(1, 7))]
            tags = [r.choice(["p", "div", "section"]) for _ in blocks_]
            body = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks_))
            cut = r.randint(0, len(body)) if r.random() < 0.2 else 0
            inner = r.choice(["{}", "<article>{}</article>", "<main>{}</main>", "<main><p>fixed three</p><article>{}</article></main>"]).format(body)
            pages.append((f"http://s{host}.example/", f"<body><p>fixed one</p>{inner}<p>foot</p></body>" if not cut else body[:cut]))
    assert run(spark, pages) == slow_extract(pages)
