import hashlib
import random
import re

import pytest
import zstandard

from tesserae.llm import html, warc


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, lines string").repartition(3)

    return make


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c --><div class="ad">Buy</div><article><h1>Head &amp; more</h1>'
    "<p><b>First  line<br>\n goes on.<p>Second&nbsp;&eacute;.</p><aside>Side</aside><form>Name <input></form><div class='comments'>"
    "<article><p>I agree</p></article></div><p>Last &lt;one&gt;.</article><footer>&copy; x</footer></body></html>"
)


def alone(text):
    return html.differenced(html.parse(text), [])


def test_article():
    assert alone(PAGE) == "Head & more\nFirst line goes on.\nSecond é.\nLast <one>."


@pytest.mark.parametrize(
    "text, want",
    [
        ('<div class="layout has-sidebar"><p>story</p></div>', "story"),
        ('<div class="with-sidebar"><main><p>a</p></main></div>', "a"),
        ('<article><p class="share-price">1</p><p class="notice">2</p><p class="related">3</p><p class="comment">4</p></article>', "1\n2\n3\n4"),
        ("<nav><ul><li>x</li></ul><article><p>in nav</p></article>", "in nav"),
        ("<button>Menu<article><p>after button</p></article>", "after button"),
        ("<head><title>t</title><p>no body", "no body"),
        ('<div class="sidebar"><main>wrapped</main></div>', "wrapped"),
        ('<section class="comments"><article>c</article></section><p>r</p>', "r"),
        ('<div role="banner">b</div><div role="main"><header>h</header>m</div>', "h\nm"),
        ("<article>card</article><article>card</article><div><p>The long story beside the cards</p></div>", "card\ncard\nThe long story beside the cards"),
        ('<p hidden>no</p><p style="display: none">no</p><p>yes</p>', "yes"),
    ],
)
def test_wrappers_and_open_elements(text, want):
    assert alone(text) == want


def plain_model(rows):
    """Nearest-URL pairing and deletion over (id, url, lines, html), where no page repeats a line and html tells copies."""

    def place(url):
        rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "")
        host, _, _ = rest.partition("/") if "://" in (url or "") else ("", "", "")
        path = rest[len(host) :].split("?")[0].split("#")[0]
        return host.split("?")[0].lower(), path

    order = sorted(rows, key=lambda r: (*place(r[1]), r[1] is not None, r[1] or "", r[0]))
    out = []
    for n, (i, url, lines, page) in enumerate(order):
        host, path = place(url)
        sides = []
        for step in (-1, 1):
            at = n + step
            while 0 <= at < len(order) and order[at][3] == page and place(order[at][1])[0] == host:
                at += step
            if 0 <= at < len(order) and place(order[at][1])[0] == host:
                a, b = path.split("/"), place(order[at][1])[1].split("/")
                alike = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                sides.append((-alike, len(sides), order[at][2]))
        text = lines
        for _, _, other in sorted(sides):
            left = [x for x in lines if x not in other]
            if left:
                text = left
                break
        out.append((i, url, "\n".join(text)))
    return sorted(out, key=str)


def test_pairing_and_deletion_against_a_plain_model(pages):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        host = rng.choice(["a.com", "A.com", "b.org", "c.net"])
        url = f"http://{host}/" + "/".join(rng.choice(["x", "y", "z"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "?q", "#f"])
        if i and rng.random() < 0.2:
            lines = rows[-1][2]  # a copy
        else:
            lines = [x for x in ("Menu", "Top", "Login") if rng.random() < 0.8] + [f"Story {i} {rng.random()}"] * (rng.random() < 0.9) + ["Legal"]
        rows.append((i, rng.choice([url, url, url, None]), lines, "<body>" + "".join(f"<div>{x}</div>" for x in lines)))
    got = html.digest(pages([(i, u, h) for i, u, _, h in rows])).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == plain_model(rows)


def test_differencing_by_nearest_url(pages):
    page = lambda *x: "<body>" + "".join(f"<p>{t}</p>" for t in x) + "</body>"
    marked = lambda *x: "<body><p>Join us</p><article>" + "".join(f"<p>{t}</p>" for t in x) + '<p><a href="/s">Share</a></p><p>Join us</p></article>'
    menu = [f"Entry {j} of a long menu with many words" for j in range(40)]
    rows = [
        (1, "http://a.com/news/1", page("Menu", "Unique story one with many words", "Legal")),
        (2, "http://a.com/news/2?x=1", page("Menu", "Another story two with many words", "Legal")),
        (3, "http://a.com/zoo/3", page("Menu", "Third story of animals and words", "Legal")),
        (4, "http://b.com/news/1", page("Menu", "Unique story one with many words", "Legal")),
        (5, "http://c.com/p", page("Same text here")), (6, "http://c.com/p#top", page("Same text here")),
        (7, None, None), (8, "nonsense", ""), (9, "http://d.com/", PAGE), (9, "http://d.com/", PAGE),
        (10, "http://e.com/1", page(*menu, "Short")), (11, "http://e.com/2", page(*menu, "Brief")),
        (12, "http://f.com/1", marked("Shared sentence", "one")), (13, "http://f.com/2", marked("Shared sentence", "two")),
        (14, "http://g.com/1", "<p>" + "long " * 200_000),
    ]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.digest(pages(rows)).collect()}
    assert got[1, rows[0][1]][0] == "Unique story one with many words" and got[2, rows[1][1]][0].startswith("Another")
    assert got[3, rows[2][1]][0].startswith("Third") and got[4, rows[3][1]][0] == "Menu\nUnique story one with many words\nLegal"
    assert got[5, rows[4][1]][0] == got[6, rows[5][1]][0] == "Same text here" and got[7, None] == ("", 0)
    assert got[9, "http://d.com/"][0] == "Head & more\nFirst line goes on.\nSecond é.\nLast <one>."
    assert got[10, "http://e.com/1"][0] == "Short" and got[11, "http://e.com/2"][0] == "Brief"
    assert got[12, "http://f.com/1"][0] == "Shared sentence\none" and got[14, "http://g.com/1"][1] == 999_999
    assert html.digest(pages(rows)).count() == len(rows) and html.digest(pages(rows).filter("page_id < 0")).count() == 0


def test_common_lines_against_a_plain_model():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = html.common_lines(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(got) == table[-1][-1] and got == sorted(set(got))
        at = 0
        for i in got:
            at = b.index(a[i], at) + 1


def test_html_of_any_kind():
    for text in (None, "", "plain", "<p", "<div>" * 5000 + "x", "</div>" * 10, "<!--", "&#0;&bogus;&amp", "<script>never closed", "<p>a</p>" * 3000):
        alone(text)


def test_warc_query(pages):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "u r l\n", "small"), (5, "", "small"), (6, "z", None), (8, "q", other), (None, "n", other), (8, "q", other)]
    got = sorted((tuple(r) for r in warc.digest(pages(rows)).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [k for k, _, x in rows if x == h and k is not None]
        revisit = len(raw) >= 1000 and i != max(same)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.digest(pages(rows).filter("page_id < 0")).count() == 0


def record(body=b"hello"):
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2020-01-01T00:00:00Z")]
    return warc.format_record(head, body)


def test_round_trip_and_dictionary():
    records = [record(f"<html><body><p>page {i} of the same site</p>{'word ' * i}</body></html>".encode()) for i in range(120)]
    raw = warc.write_archive(records)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(raw[4:8], "little") > 0
    assert [warc.format_record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in warc.read_archive(raw)] and len(list(warc.read_archive(raw))) == 120
    plain = zstandard.train_dictionary(4096, records).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    raw = (0x184D2A5D).to_bytes(4, "little") + len(plain).to_bytes(4, "little") + plain + b"".join(map(packer.compress, records))
    assert len(list(warc.read_archive(raw))) == 120
    assert list(warc.read_archive(b"")) == [] and len(list(warc.read_archive(warc.write_archive([record(b"")])))) == 1


def test_malformed_archives():
    raw = warc.write_archive([record(), record()])
    bad = [raw[:-3], raw[:20], b"junk" + raw, raw + b"junk!"]
    pack = zstandard.ZstdCompressor().compress
    bad += [pack(x) for x in (record()[:-1], record() + b"x", record().replace(b"WARC/1.1", b"HTTP/1.1"), record().replace(b"Content-Length: 5", b"Content-Length: 6"), record().replace(b"WARC-Date", b"Other"), b"")]
    bad += [pack(record().replace(b"WARC-Date", x)) for x in (b"Content-Length: 5\r\nWARC-Date", b"\xff\xfe: x\r\nWARC-Date")]
    for x in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(x))
