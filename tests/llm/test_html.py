"""HTML extraction: single pages by hand, templates against plain vectors, whole tables against what the pages were made of."""

import random
from collections import Counter, defaultdict
from html import escape

import pytest

from plaitwork.llm import html_extract as H
from plaitwork.llm import registry

SCHEMA = "page_id long, url string, html string, text string, token long, host string, n_chars int"


def one(html):
    return H.main_text(html, set(), None)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain words  only", "plain words only"),
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("<article><h1>T &amp; U</h1><p><b>one<br><p>two&nbsp; x</p></article><footer>f</footer>", "T & U\none\ntwo x"),
        ("<ARTICLE><P CLASS=x>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>line one<br>line two</p><ul><li>i<li>j</ul></article>", "line one line two\ni\nj"),
        ("<nav><a href=/>Home</a></nav><main><p>body</p></main><aside>side</aside>", "body"),
        ("<article><header><h1>Title</h1><p>By someone</p></header><p>Text <em>in</em>line</p><footer>tags</footer></article>", "Title\nText inline"),
        ("<article><p>x</p><section id='comments'><p>first!</p></section><div class='ad'>buy</div><form>f<input value=v></form></article>", "x"),
        ("<article>a &lt;p&gt; &#233;&#x1d11e; &copy &bogus; &am</article>", "a <p> é\U0001d11e © &bogus; &am"),
        ("<article><!-- no --><script>var t='</p>'</script><style>p{}</style>yes<svg><text>no</text></svg></article>", "yes"),
        ("<article>text <button>Share</button> more<p title='a>b'>q</p></article>", "text more\nq"),
        ("<article>cut off <b>here</b><p", "cut off here"),
        ("<aside><article>teaser that is long</article></aside><article>real</article>", "real"),
        ("<div class='cookie-notice'>We use cookies</div><div class='siteMenu nav'>a b</div><div><div><p>long text of the page itself</p><p>and more</p></div><div>x</div></div>", "long text of the page itself\nand more"),
        ("<body class='has-sidebar'><article class='post with-comments'><p>kept</p></article>", "kept"),
        ("<div class=sidebar><p>nothing else is here</p></div>", "nothing else is here"),
        ("<article hidden>no</article><article>1 < 2 and a<b c</article>", "1 < 2 and a"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article>a b\tc\n\n d</article>", "a b c d"),
        ("<body><header><h1>Site</h1></header><div id=c><h1>Title</h1><div class=body><p>long text of it all</p><p>and more of it</p></div></div><div>x</div>", "Title\nlong text of it all\nand more of it"),
        ("<article><div class='entry-header'><h2>T</h2><p>by me</p></div><p>body</p></article>", "T\nbody"),
        ("<article><p>so <span class='ad'>buy</span> it <ins class='adsbygoogle'>now</ins> is</p><div class=elementor-widget><p>kept</p></div></article>", "so it is\nkept"),
        ("<article>" + "<div>" * 3000 + "deep" + "</article>", "deep"),
    ],
)
def test_single_pages(html, text):
    assert one(html) == text


def soup(rng, host, k):
    """A page without telling elements or classes, its lines, and its template's texts."""
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(4, 12))) + f" {k} {j}" for j in range(rng.randint(1, 6))]
    body = "".join(f"<p>{escape(x)}</p>" for x in lines)
    top, end = f"<div class=c1><span>Welcome to {host}</span></div>", f"<div class=c4><p>All rights {host}</p></div>"
    return f"<html><body>{top}<div class=c2><div class=c3><p>Read this on {host}</p>{body}<p>Tell a friend</p></div></div>{end}</body></html>", lines


def test_templates_without_telling_names(spark):
    rng, rows, want = random.Random(3), [], {}
    for h in range(3):
        for k in range(12):
            html, lines = soup(rng, f"h{h}.example", k)
            rows.append((len(rows), f"http://h{h}.example/{k}", html))
            want[len(rows) - 1] = "\n".join(lines)
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


def plain_classes(pages):
    """Valid classes of one host as sets of tokens, by whole vectors; the frame is the class that is once everywhere."""
    lines = [[t for t, _ in H.parse(p)[1]] for p in sorted(set(pages))]
    counts = [Counter(x) for x in lines]
    groups = defaultdict(list)
    for t in {t for c in counts for t in c}:
        vector = tuple(c[t] for c in counts)
        if sum(n > 0 for n in vector) >= max(H.MIN_PAGES, H.SUPPORT * len(lines)):
            groups[vector].append(t)
    ordered = lambda own: sorted(own, key=lambda t: (sum(x.index(t) for x in lines if t in x) / sum(t in x for x in lines), t))
    rounds = {v: ordered(own) for v, own in groups.items() if len(own) > 1}
    once = (1,) * len(lines)
    while once in rounds:
        rank = {t: k for k, t in enumerate(rounds[once])}
        astray = set()
        for x in lines:
            own = [t for t in x if t in rank]
            astray |= {t for a, b in zip(own, own[1:]) if rank[a] > rank[b] for t in (a, b)}
        if not astray:
            break
        rounds[once] = [t for t in rounds[once] if t not in astray]
    frame, out = set(rounds.get(once, ())), {}
    for v, order in rounds.items():
        fine = True
        for x in lines:
            at = [k for k, t in enumerate(x) if t in set(order)]
            fine &= [x[k] for k in at] == order * (len(at) // len(order))
            if v != once:
                gaps = [sum(t in frame for t in x[:k]) for k in at]
                fine &= all(len(set(gaps[c : c + len(order)])) == 1 for c in range(0, len(gaps), len(order)))
        if fine:
            out[v] = set(order)
    return out


def test_classes_against_plain_vectors(spark):
    rng = random.Random(8)
    pages = []
    for k in range(20):
        items = "".join(f"<li><a href=/{j}>{rng.choice('xyz')}</a></li>" for j in range(rng.randint(1, 4)))
        swap = ["<i>one</i>", "<u>two</u>"]
        rng.shuffle(swap)
        body = "".join(f"<p>{rng.random()}</p>" for _ in range(rng.randint(1, 3)))
        pages.append(f"<body><ul>{items}</ul><h1>{k}</h1>{''.join(swap)}<div>Fixed words</div>{body}<div class=z><em>end</em></div></body>")
    pages += pages[:3]
    df = spark.createDataFrame([(k, "https://user@One.Example:80/x", p, "", 1, "", 2) for k, p in enumerate(pages)] + [(90, "http://two.example", pages[0], "", 1, "", 2)], SCHEMA)
    got = H.template_tokens(H.page_tokens(df)).collect()
    classes = plain_classes(pages)
    assert len(classes) >= 2
    assert {(r.host, r.token) for r in got} == {("one.example", t) for own in classes.values() for t in own}
    assert {r.text for r in got} == {True, False}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x</p>"), (None, "http://a.example/", "<article>y</article>"), (4, "http://a.example/", "<article>" + "word " * 200_000 + "</article>")]
    rows += rows[:3] + [(5, f"http://same.example/{k}", "<article><p>the same text</p></article>") for k in range(8)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {1: "", 2: "", 3: "x", None: "y", 4: ("word " * 200_000).strip(), 5: "the same text"}
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == sorted((r[0] or 0, r[1] or "", texts[r[0]], len(texts[r[0]])) for r in rows)
    assert H.extract(df.limit(0)).collect() == []


def test_query_on_made_pages(spark, tmp_path):
    """Pages of several layouts, made of known lines."""
    rng, rows, want = random.Random(6), [], {}
    text = lambda n: " ".join("".join(rng.choices("aeiou&<é", k=rng.randint(1, 6))) for _ in range(n))
    for k in range(60):
        lines = [text(rng.randint(3, 30)) for _ in range(rng.randint(1, 8))]
        body = "".join(f"<p>{escape(x)}</p>" if rng.random() < 0.8 else f"<p><b>{escape(x)}<br>" for x in lines)
        junk = f"<nav><ul>{''.join(f'<li><a href=#>{escape(text(1))}</a></li>' for _ in range(5))}</ul></nav><div class='ad'>{escape(text(6))}</div>"
        after = f"<aside class=sidebar>{escape(text(9))}</aside><section class=comments><p>{escape(text(7))}</p></section><footer>&copy; {escape(text(4))}</footer>"
        inner = {0: f"<article>{body}</article>", 1: f"<main><div id='post-{k}'>{body}</div></main>", 2: f"<div class='entry'>{body}</div>"}[k % 3]
        rows.append((k, f"http://h{k % 3}.example/{k}", f"<!DOCTYPE html><html><head><title>t</title></head><body><header>{escape(text(3))}</header>{junk}{inner}{after}" + ("</body></html>" if k % 4 else "")))
        want[k] = "\n".join(" ".join(x.split()) for x in lines)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.text, r.n_chars) for r in registry.op13_html_extraction(spark, str(tmp_path)).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
