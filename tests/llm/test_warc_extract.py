"""Exact round trip of WARC bundles; extraction against hand-made pages and held-out regions."""

import base64
import hashlib

import pyarrow.fs
import zstandard

from predaudit.llm import warc
from predaudit.llm.dom import parse
from predaudit.llm.extract import Model, extract, labels_of, main_text, marginals, train


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, size long, payload string")


def test_round_trip_and_lookup(spark, monkeypatch, rng):
    bodies = {i: "<p>" + "x" * rng.randrange(4000) + str(i % 40) + "</p>é" for i in range(300)} | {900: "", 901: None, 902: "y" * 3_000_000, 903: ""}
    bodies |= {i: "the hot page" for i in range(1000, 1100)}
    pages = _pages(spark, [(i, None if i == 5 else f"http://x/{i}\r\nX: y", b, 1, "p") for i, b in bodies.items()]).repartition(3)
    folder = warc.new_folder(spark)
    index = warc.write(pages, folder)
    rows = {r["page_id"]: r for r in warc.read(index).collect()}
    assert rows.keys() == bodies.keys() and index.count() == len(bodies)
    first = {}
    for i in sorted(bodies):
        first.setdefault(bodies[i] or "", i)
    for i, body in bodies.items():
        data, r = (body or "").encode(), rows[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        target = first[body or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if target == i else ("revisit", target))
        assert r["payload"] is None if target != i else bytes(r["payload"]) == data
    wanted = spark.createDataFrame([(7,), (902,), (1050,), (12345,)], "page_id long")
    assert {r["page_id"] for r in warc.lookup(index, wanted).collect()} == {7, 902, 1050}
    bundle = index.first()["bundle"]
    system, path = pyarrow.fs.FileSystem.from_uri(bundle)
    with system.open_input_file(path) as f:
        frames = warc.read_seek_table(f)
        f.seek(0)
        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(f.read())
    assert len(whole) == sum(x[2] for x in frames) and whole.startswith(b"WARC/1.1\r\n")


def test_warc_odd_rows(spark):
    rows = [(None, "u", "a"), (4, "u", "a"), (4, "u", "a"), (2, None, "b")]
    index = warc.write(_pages(spark, [(*r, 0, "") for r in rows]), warc.new_folder(spark))
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read(index).collect())
    assert got == [(0, "revisit", 4), (2, "response", None), (4, "response", None), (4, "response", None)]
    empty = warc.write(_pages(spark, []), warc.new_folder(spark))
    assert warc.read(empty).collect() == [] and warc.lookup(empty, spark.range(3).withColumnRenamed("id", "page_id")).collect() == []


def _page(i, paragraphs):
    inner = "".join(f"<p>{p}</p>" if n % 3 else f"<p><b>{p}<br>" for n, p in enumerate(paragraphs))
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a>'
        f'</li></ul></nav><div class="ad">Buy {i} now.</div><article><h1>Head {i}</h1>{inner}</article><footer>&copy; Me</footer></body></html>'
    )


def test_held_out_pages_and_other_templates(spark):
    paragraphs = {i: [f"Some &amp; words  of\npage {i}", "Go.", "A longer paragraph, with a clause."] * (i % 5 + 1) for i in range(60)}
    pages = _pages(spark, [(i, f"u{i}", _page(i, p), 0, "") for i, p in paragraphs.items()] + [(98, None, None, 0, ""), (99, "u", "", 0, "")])
    rows = {r["page_id"]: r for r in main_text(pages).collect()}
    for i, p in paragraphs.items():
        want = "\n\n".join([f"Head {i}", *[" ".join(x.replace("&amp;", "&").split()) for x in p]])
        assert rows[i]["text"] == want and rows[i]["n_chars"] == len(want)
    assert rows[98]["text"] == rows[99]["text"] == ""
    model = Model(train(pages.where("page_id < 30")))
    assert extract('<div id="content"><h1>A</h1><p>One.<p>Two<div class="comments"><p>Hi!</p></div></div><div class="sidebar">S</div>', model) == "A\n\nOne.\n\nTwo"
    assert extract("<body><header>H</header><main><p>a</p><ul><li>b<li>c</ul><form>f</form></main><aside>z</aside></body>", model) == "a\n\nb\n\nc"
    assert extract("plain &lt;text&gt;", model) == "plain <text>" and extract("<p>" * 30_000 + "deep", model) == "deep"
    wild = parse(_page(1, ["x"]))
    assert all(0 <= p <= 1 for p in marginals(wild, model)) and labels_of(wild, True) is not None
    assert main_text(_pages(spark, [])).collect() == []


def test_messages_give_the_exact_marginals(spark):
    """Against the sum over all labellings of a small page."""
    from itertools import product

    from predaudit.llm.extract import TEXTS_WEIGHT, edge_kinds, observations

    import math

    model = Model(train(_pages(spark, [(i, "u", _page(i, ["Some words."]), 0, "") for i in range(5)])))
    page = parse('<div class="content"><p>Words <a href="x">l</a></p><ul class="nav"><li>M</li></ul></div>')
    n, kinds = len(page.kind), edge_kinds(page)
    weight = min(1.0, TEXTS_WEIGHT / max(1, page.kind.count("#text")))
    own = [model.own(f) * (weight if k == "#text" else 1) for k, f in zip(page.kind, observations(page))]
    mass = [[0.0, 0.0] for _ in range(n)]
    for labels in product((0, 1), repeat=n - 1):
        labels = (1, *labels)
        p = math.exp(sum(x for x, y in zip(own[1:], labels[1:]) if y))
        for i in range(1, n):
            p *= model.edge(kinds[i])[2 * labels[page.parent[i]] + labels[i]]
        for i in range(n):
            mass[i][labels[i]] += p
    got = marginals(page, model)
    assert all(abs(got[i] - mass[i][1] / sum(mass[i])) < 1e-9 for i in range(1, n))


def test_stray_quotes_end_with_their_tag():
    for tag in ('<p class="a"">', "<p data-x=it's>", '<p data-x=a="b>', "<p 'x>", '<p class = "a>b" ">'):
        assert [t for t in parse(f"{tag}one</p><p>two</p><p>it's \"three\"</p>").text if t] == ["one", "two", "it's \"three\""], tag
