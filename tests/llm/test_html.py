import random

import pytest

from servista.llm import html

P = "The story of the town is that it was built on the river and it has grown with the trade of the people who live in it for many years."
PAGES = {
    "plain": (f"<html><head><title>t</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Short head</h1><p>{P}<p>Tiny.</p><p>{P}</article><footer>the end of the page and of all that is on it for now, with the address</footer></body>", ["Short head", P, "Tiny.", P]),
    "divs": (f'<div class="menu">the menu of all the things that are on this site and more for you to see in it</div><div id="content"><div>{P}</div><div>ok</div><div>{P}</div></div><div class="side sidebar">{P}</div><div class="comments"><p>{P}</p></div>', [P, "ok", P]),
    "references": (f"<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9;&nbsp; x\n\t y</p><p>{P}</p></article>", ["a & b <c> ééé x y", P]),
    "scripts": (f"<article><script>var t='</p><p>the of and to in a is that it';</script><p>{P}</p><style>p{{}}</style><!-- the of and {P} --><noscript>{P}</noscript></article>", [P]),
    "links": (f'<article><p>{P}</p><ul><li><a href="/x">the first of the links that are here</a></li><li><a href="/y">and the second of them</a></li></ul></article>', [P]),
    "forms": (f'<body><div class="cookie-notice">{P}</div><form><p>{P}</p></form><main><p>{P}</p></main><aside>{P}</aside><div class="ad">{P}</div></body>', [P]),
    "broken": (f"<article><p><b>{P}<br><p>and <i>so</i> on</b></div></p></article></body>", [P, "and so on"]),
    "unclosed script": (f"<article><p>{P}</p></article><script>{P}", [P]),
    "attributes": (f'<article><p title="a > b" data-x=\'>\'>{P}</p></article>', [P]),
    "hidden": (f'<article><p>{P}</p><div style="display: none">{P}</div><div hidden>{P}</div></article>', [P]),
    "void tag in an advert": (f'<article><p>{P}</p><p class="advert">{P} <img src=x> {P}</p><p>{P}</p></article>', [P, P]),
    "names of two parts": (f'<article class="post has-comments"><p>{P}</p><div class="main-sidebar">{P}</div><div class="post-footer">{P}</div><div id="articleAd">{P}</div><div class="story-related">{P}</div><header class="entry-header"><h1>Head</h1></header><p>{P}</p></article>', [P, "Head", P]),
    "inline advert": (f'<article><p>{P} <span class="ad">Buy <b>now</b></span>{P}</p><p>a <span class="name">b</span> <em>c</em></p></article>', [f"{P} {P}", "a b c"]),
    "paragraph of links": (f'<article><p>{P}</p><p><a href=/x>{P}</a> it is.</p><p><a href=/y>See that</a></p></article>', [P, f"{P} it is.", "See that"]),
    "another language": ("<body><div><a href=/>Etusivu</a> <a href=/b>Uutiset</a></div><div>" + "Kissa istuu ikkunalla ja katselee satavaa lunta koko pitkän iltapäivän ajan hiljaa. " * 2 + "</div><div>Lyhyt.</div></body>", [("Kissa istuu ikkunalla ja katselee satavaa lunta koko pitkän iltapäivän ajan hiljaa. " * 2).strip(), "Lyhyt."]),
    "nested articles": (f"<article><p>{P}</p><article class=comment><p>{P}</p></article><article><p>ok</p></article></article><p>out</p>", [P, "ok"]),
    "only short": ("<nav><a href=/>x</a></nav><article><h1>Head</h1><p>Tiny.</p></article>", ["Head", "Tiny."]),
    "layout names": (f'<body class="no-sidebar hidden"><div class="with-sidebar"><p>{P}</p></div></body>', [P]),
    "nothing": ("<html><nav><a href=/>x</a></nav></html>", []),
    "empty": ("", []),
    "text": (P, [P]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html.main_text(page).split("\n") == (want or [""])


@pytest.mark.parametrize("wrapper", ["elementor-widget-container", "hero-banner", "social-history", "related-post", "comments-open", "page-header overlay"])
def test_no_wrapper_loses_an_article(wrapper):
    article = f"<article><h1>Head</h1><p>{P}</p><p>Tiny.</p></article>"
    around = f'<nav><a href=/>x</a></nav>%s<div class="cookie-notice">{P}</div><footer>{P}</footer>'
    want = html.main_text(around % article)
    assert want.split("\n") == ["Head", P, "Tiny."]
    for inner in (article, f"<div><section>{article}</section></div>", article.replace("<article>", f'<article><div class="{wrapper}">').replace("</article>", "</div></article>")):
        assert html.main_text(around % f'<div class="{wrapper}">{inner}</div>') == want
    no_article = article.replace("article", "section")
    assert html.main_text(around % f'<div class="{wrapper}">{no_article * 3}</div>').count(P) == 3


@pytest.mark.parametrize("name", ["cc-window", "thread", "discussion", "x"])
def test_place_tells_unnamed_notices_and_comments(name):
    article = f"<article><h1>Head</h1><p>{P}</p><p>{P}</p></article>"
    extra = f'<div class="{name}"><p>{P}</p><p>short</p></div>'
    assert html.main_text(article + extra) == html.main_text(extra + article) == html.main_text(article)
    assert html.main_text(article + extra + article.replace("Head", "Part 2")).count(P) == 5  # what stands between parts isn't told apart


def plain_two_passes(specs):
    """Labels of blocks (place, text, share of links, list item, suspect group), place 0: elsewhere, -1: boilerplate, k: k-th article."""
    share = lambda t: sum(w.strip(".").lower() in html.STOP_WORDS for w in t.split()) / len(t.split())
    long_ = [t for k, t, *_ in specs if k >= 0 and len(t) >= 70]
    known = sum(share(t) * len(t.split()) for t in long_) >= 0.05 * sum(len(t.split()) for t in long_)
    wordy = [not known or share(t) >= 0.15 for _, t, *_ in specs]
    prose = [len(t) if len(t) >= 70 and links <= 0.33 and w else 0 for (_, t, links, *_), w in zip(specs, wordy, strict=True)]

    def decided(off):
        first = []
        for (k, t, links, item, group), w in zip(specs, wordy, strict=True):
            if k < 0 or group in off or (links > 0.33 and (item or k == 0)):
                first.append(False)
            elif k > 0:
                first.append(True if len(t) >= 25 and w else None)
            else:
                first.append(w if len(t) >= 70 else None)
        good = {k for (k, *_), x in zip(specs, first, strict=True) if x and k > 0}
        first = [True if x is None and k > 0 and k not in good else x for (k, *_), x in zip(specs, first, strict=True)]
        inside = [i for i, x in enumerate(first) if x and specs[i][0] in good]
        if inside:
            before = sum(prose[i] for i in range(inside[0]) if first[i] and specs[i][0] == 0)
            for i, (k, *_) in enumerate(specs):
                if k == 0 and (i > inside[-1] or (i < inside[0] and before <= sum(prose[i] for i in inside))):
                    first[i] = False
        return first

    off = {g for *_, g in specs if g}
    first = decided(off)
    articles = any(x and k > 0 for (k, *_), x in zip(specs, first, strict=True))
    have = {g: sum(n for (k, *_, h), n in zip(specs, prose, strict=True) if h == g and (k > 0 or (k == 0 and not articles))) for g in dict.fromkeys(g for *_, g in specs if g)}
    best = max(have, key=have.get, default=None)
    if best and have[best] > 2 * sum(len(t) for (_, t, *_), x in zip(specs, first, strict=True) if x):
        off = off - {best}
        first = decided(off)
    out = []
    for i, (k, *_, group) in enumerate(specs):
        near = [(abs(i - j), not x, x) for j, x in enumerate(first) if x is not None and (k == 0 or (specs[j][0] == k and specs[j][4] not in off))]
        out.append(first[i] if first[i] is not None else bool(near) and min(near)[2])
    return out


def test_random_pages_equal_plain_two_passes():
    rng = random.Random(3)
    stop, rare = ["the", "of", "and", "to", "in", "is"], ["river", "stone", "market", "winter", "signal", "harbour"]
    changed = forgiven = 0
    for _ in range(500):
        specs, page, of_rare, articles = [], [], rng.choice([0.3, 0.7, 0.95, 1.0]), 0
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(["plain", "bad", "article", "named", "named article", "article named"])
            name = rng.choice(["widget", "hero-banner", "ads"])
            articles += "article" in kind
            place = -1 if kind == "bad" else articles if "article" in kind else 0
            group = (f"article {articles}" if place else f'class="{name}"') if "named" in kind else None
            inner = []
            for _ in range(rng.randrange(1, 6)):
                words = [rng.choice(rare if rng.random() < of_rare else stop) for _ in range(rng.choice([2, 3, 5, 9, 20]))]
                n = rng.choice([0, 0, 0, len(words), len(words) // 2])
                item = rng.random() < 0.3
                chars = len("".join(words))
                specs.append((place, " ".join(words), len("".join(words[:n])) / chars, item, group))
                body = f"<a href=x>{' '.join(words[:n])}</a> {' '.join(words[n:])}" if n else " ".join(words)
                inner.append(f"<li>{body}</li>" if item else f"<p>{body}</p>")
            own = f'<div class="{name}">%s</div>'
            shape = {"plain": "<div>%s</div>", "bad": "<nav>%s</nav>", "article": "<article>%s</article>", "named": own, "named article": own % "<article>%s</article>", "article named": f"<article>{own}</article>"}[kind]
            page.append(shape % "".join(inner))
        found = html.blocks("".join(page))
        assert [(b.text, b.suspect) for b in found] == [(s[1], s[4]) for s in specs]
        known = html.is_known(found)
        html.first_pass(found, known)
        changed += any(b.label is None for b in found)
        forgiven += html.misled(found, known) is not None
        assert html.main_text("".join(page)).split("\n") == ([s[1] for s, x in zip(specs, plain_two_passes(specs), strict=True) if x] or [""])
    assert changed > 100 and forgiven > 40


def test_very_long_page():
    page = "<article>" + f"<p>{P}</p>" * 20_000 + "<p>" + P * 5_000 + "</article>"
    assert html.main_text(page).count("\n") == 20_000 and len(html.main_text(page)) == 20_000 * (len(P) + 1) + 5_000 * len(P)


def test_hostile_pages_end():
    for page in ("<a " * 50_000, '<a href="' * 30_000, "<div>" * 50_000 + "x" + "</p>" * 10_000, "<!--" * 20_000, "<" * 100_000, "&#" * 50_000):
        html.main_text(page)


def test_table(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES.values())] + [(99, None, None, None), (0, "u0", PAGES["plain"][0], "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "\n".join([w for _, w in PAGES.values()][r.page_id]) if r.page_id < 99 else ""
        assert (r.text, r.n_chars) == (want, len(want))
    assert html.extract(pages.limit(0)).count() == 0
