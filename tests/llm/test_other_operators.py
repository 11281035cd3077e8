"""HTML extraction, sharding, top-k search and tool calls."""

import json
import math
import random
import zlib

import pytest

from pavilion.llm import chat_tools, html_extract, sharding, topk_search

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home, news.</a><li><a href="/b">More.</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, really. Accept them all, please, now.</p></div>
<div id="content"><h2>A title &amp; more</h2><p><b>First  paragraph, with
text.<br>Second line of it, which is long enough.<p>Unclosed <i>one</i>, still&nbsp;fine &lt;tag&gt;.</p>
<form><input name=q><button>Search, now.</button></form><p>Er.</p><ul><li>An item, of a list.<li>Another one.</ul></div>
<aside><p>Related things, many of them. And more, and more.</p></aside>
<section class="comments"><article><p>Great article, I liked it. Really, a lot, more than others.</p></article></section>
<footer>&copy; 2024, somebody. All rights, reserved.</footer></body></html>"""


def test_main_text():
    want = ["A title & more", "First paragraph, with text. Second line of it, which is long enough.", "Unclosed one, still fine <tag>.", "Er.", "An item, of a list.", "Another one."]
    assert html_extract.main_text(PAGE) == "\n\n".join(want)


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<nav>Home</nav>", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b", "a\n\nb"), ("<div><p>x < y, and z.</p></div>", "x < y, and z."), ("<!-- <p>no</p> --><p>yes, it is.</p><!-- open", "yes, it is."), ("<script>never closed <p>no</p>", "")])
def test_main_text_of_odd_pages(page, text):
    assert html_extract.main_text(page) == text


LONG = [f"Paragraph {k} of the body, with words, commas, and more. It ends here, at last." for k in range(12)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (f"<body><div id=content>{BODY}</div><article><h3>Teaser</h3><p>A teaser, of another text.</p></article></body>", LONG),
        ("<body><div>" + "".join(f"<article><p>{t}</p></article>" for t in LONG) + "</div></body>", LONG),
        (f"<body><div class=top><h1>The title</h1><span>3 May</span></div><div class=lead><section><p>{LONG[0]}</p></section></div><div class=rest><div>{BODY}</div></div></body>", ["The title", "3 May", LONG[0], *LONG]),
        (f"<body><article>{BODY}</article><div class=more><p>The end, in a box of its own, with words. It counts, too.</p></div></body>", [*LONG, "The end, in a box of its own, with words. It counts, too."]),
    ],
)
def test_main_text_of_several_containers(page, texts):
    got = html_extract.main_text(page).split("\n\n")
    assert [t for t in texts if t not in got] == []
    assert len(got) >= len(texts)


@pytest.mark.parametrize("mark", ["content has-sidebar", "with-sidebar", "elementor-widget elementor-widget-text-editor", "post has-banner", "no-comments", "search-result", "form-page", "widget", "form", "search"])
def test_main_text_in_wrappers_named_like_boilerplate(mark):
    assert html_extract.main_text(f"<body><div class='{mark}'>{BODY}</div><div class=sidebar><p>Other, things. Many.</p></div></body>") == "\n\n".join(LONG)


@pytest.mark.parametrize("header", ["<header class='entry-header'>", "<header class='header'>", "<div class='article-header'>", "<div class='header'>", "<header><div class='share'>"])
def test_main_text_keeps_an_articles_header_and_captions(header):
    page = f"<body><article>{header}<h1>The title</h1></div></header>{BODY}<figure><img src=x><figcaption>A caption, of a picture.</figcaption></figure><div class='social-share'><p>Share, this.</p></div></article></body>"
    assert html_extract.main_text(page) == "\n\n".join(["The title", *LONG, "A caption, of a picture."])


@pytest.mark.parametrize("mark", ["comments", "comment-list", "cookie-notice", "ad", "ads right"])
def test_main_text_without_what_never_belongs(mark):
    more = "".join(f"<p>{t}</p>" for t in ["It is long, this one. Very long, and more."] * 40)
    assert html_extract.main_text(f"<body><div>{BODY}</div><div class='{mark}'>{more}</div></body>") == "\n\n".join(LONG)


@pytest.mark.parametrize(
    ("more", "kept"),
    [
        ('<div class="box7"><a>Buy now</a> <a>cheap</a></div>', ""),
        ('<div title="a hidden gem">It shines, they say. It does.</div>', "It shines, they say. It does."),
        ('<p data-id="reply-1">An answer, of a kind. It is one.</p>', "An answer, of a kind. It is one."),
        ('<section class="related-work"><p>Others, too, have tried. In vain.</p></section>', "Others, too, have tried. In vain."),
        ("<figure><figcaption>A caption, here.</figcaption></figure>", "A caption, here."),
        ("<p>A sum, <math><mi>x</mi><mo>+</mo><mn>1</mn></math>, it is.</p>", "A sum, x+1, it is."),
        ('<p>Before it, <span class="advert">buy <span>this</span> now</span>after it.</p>', "Before it, after it."),
        ('<p>Before it, <span hidden>not shown, </span>after it.</p>', "Before it, after it."),
        ("<p title='open>A quote, never closed. So it is.</p>", "A quote, never closed. So it is."),
    ],
)
def test_main_text_inside_an_article(more, kept):
    page = f"<body><article>{BODY}{more}</article></body>"
    assert html_extract.main_text(page) == "\n\n".join([*LONG, *[kept] * bool(kept)])


@pytest.mark.parametrize("page", ["<p>a</p>" + "<title" * 170000, "<p>a</p>" + "<title>" * 140000, "<div>" * 100000 + "a, b.", "<div>a, b." * 50000, "<p>a</p>" + "<i title='" * 100000, "<div>" + "<x-a>a" * 50000 + "<p>b" * 50000, "<td>" + "<x-b>" * 50000 + "</section></p>" * 50000, '<p class="' * 100000, "<!--" * 250000])
def test_broken_pages_take_no_longer(page):
    """Pages of about a megabyte; the longest is read in a second or so."""
    import time
    import tracemalloc

    began = time.process_time()
    text = html_extract.main_text(page)
    assert time.process_time() - began < 4
    tracemalloc.start()
    assert html_extract.main_text(page) == text
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_path_scores():
    """The fused scores against a plain calculation of the ratios of each path."""
    found, _ = html_extract.blocks(f"<body><ul><li><a>One</a><li><a>Two</a></ul><article><h1>Head</h1>{BODY}<ul><li>An item, of two.<li>Another.</ul></article><div>Foot.</div></body>")
    scores, links = html_extract._scores(found)
    names, by = [], {}
    for text, element, linked in found:
        path, own = "", element
        while own.parent:
            path, own = f"{own.name}/{path}", own.parent
        names += [path] * (path not in names)
        by.setdefault(path, []).append((len(text), sum(text.count(c) for c in ".,;:!?"), linked, element.path))
    mean = [(sum(b[0] for b in by[p]) / len(by[p]), sum(b[1] for b in by[p]) / len(by[p])) for p in names]
    for i, p in enumerate(names):
        weights = {j: math.exp(-((i - j) ** 2) / (2 * html_extract.WIDTH**2)) for j in range(len(names)) if abs(i - j) <= 2}
        length, marks = (sum(w * mean[j][k] for j, w in weights.items()) / sum(weights.values()) for k in (0, 1))
        share = sum(b[2] for b in by[p]) / sum(b[0] for b in by[p])
        assert scores[by[p][0][3]] == pytest.approx((length * (marks + 0.1)) ** 0.5 * min(1, mean[i][0] / length) * (1 - share))
        assert (by[p][0][3] in links) == (share >= 0.5)
    assert len(names) == len(scores) == 5


def test_long_page_is_whole():
    words = [f"word{k}, and more." for k in range(30000)]
    page = "<article>" + "".join(f"<p>{w}</p>" for w in words) + "</article>"
    assert html_extract.main_text(page) == "\n\n".join(words)


def test_extracted(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "<p>é, ü.</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extracted(pages).collect()), key=str)
    assert got == sorted(((i, u, html_extract.main_text(h), len(html_extract.main_text(h))) for i, u, h, _ in rows), key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def shard_rows(seed=3):
    rng = random.Random(seed)
    rows = [(k, "x" * rng.randint(1, 400) + str(k)) for k in range(900)]
    rows += [(1000 + k, "the same text of many rows, é") for k in range(500)]  # a third of all rows
    rows += [(3000, None), (3001, ""), (None, "no id"), (3002, "y" * 9000), (7, rows[7][1])]
    return rows


def test_sharding(spark):
    rows = shard_rows()
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int").repartition(6)
    got = sharding.assigned(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(24)) and len(got) == len(rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in own) for own in by.values()]
    ideal, longest = sum(sizes) / 24, 9008
    assert max(sizes) <= ideal + longest and sorted(sizes)[1] >= ideal - longest
    texts = {i: t for i, t in rows}
    groups: dict[str, set] = {}
    for r in got:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 24
    assert len(groups["the same text of many rows, é"]) > 1


def test_sharded_rows(spark):
    """Rows without an id, of equal ids and of columns that clash all come back, with the shard of their own text."""
    rows = [*shard_rows(), (None, "another"), (7, "seven again"), (7, "and again")]
    docs = spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], "doc_id long, text string, shard string, _k int, k1 string").repartition(3)
    got = sharding.sharded(docs, 5).collect()
    assert sorted((r.doc_id, r.text, r._k, r.k1) for r in got if r.doc_id and r.text) == sorted((i, t, 1, "k") for i, t in rows if i and t)
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    digest = sharding.assigned(docs, 5).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((r.doc_id or -1, crc(r.text), r.shard) for r in got) == sorted((r.doc_id or -1, r.text_crc32, r.shard) for r in digest)
    for shard in range(5):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_sharding_of_little(spark):
    schema = "doc_id long, text string"
    assert sharding.assigned(spark.createDataFrame([], schema)).count() == 0
    one = sharding.assigned(spark.createDataFrame([(5, "a")], schema)).collect()
    assert [(r.slot, 0 <= r.shard < 24) for r in one] == [(0, True)]
    docs = spark.createDataFrame(shard_rows()[:40], schema)
    assert sharding.sharded(docs, 3).count() == 40


def test_sharding_is_native(spark):
    docs = spark.createDataFrame(shard_rows()[:40], "doc_id long, text string")
    plan = sharding.assigned(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_top_k(spark):
    rng = random.Random(8)
    vectors = [(k, [rng.gauss(0, 0.3) for _ in range(12)]) for k in range(400)]
    vectors += [(401, None), (402, [0.1, None]), (500, [float("nan")] * 12), (600, []), (700, [0.5, -0.5]), (800, [float("inf")] * 12), (None, [0.1] * 12), (17, vectors[17][1]), (900, vectors[3][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int").repartition(3)
    got: dict[int, list] = {}
    for r in topk_search.digest(frame, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    import math

    import numpy as np

    clean = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q, v in clean.items():
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in clean.items() if i != q))[:10]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk_search.digest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("nudge", [0.0, 0.001])
def test_top_k_of_repeated_rows(spark, nudge):
    """Ten rows of the best id, equal or not, leave room for nine others."""
    rng = random.Random(4)
    vectors = [(k, [rng.gauss(0, 0.1) for _ in range(24)]) for k in range(1, 120)]
    query = [1.0] * 24
    vectors += [(500, [3.0 + nudge * n] * 24) for n in range(10)]
    frame = spark.createDataFrame([(0, query), *vectors], "vec_id long, embedding array<double>").coalesce(1)
    best: dict[int, int] = {}
    for i, v in vectors:
        best[i] = max(best.get(i, -(1 << 62)), sum(1024 * math.floor(1024 * x) for x in v))
    want = sorted(((-s, i) for i, s in best.items()))[:10]
    got = sorted((r.rank, r.vec_id, r.score) for r in topk_search.top_k(frame.where("vec_id = 0"), frame).collect())
    assert got == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_top_k_over_many_shards(spark, monkeypatch):
    """Thresholds pass from shard to shard; one id has a third of all rows; no join without a key."""
    monkeypatch.setattr(topk_search, "SHARD", 60)
    monkeypatch.setattr(topk_search, "BLOCK", 3)
    rng = random.Random(12)
    vectors = [(k, [rng.gauss(0, 0.2) * (9 if j < 4 else 1) for j in range(32)]) for k in range(700)]
    vectors += [(7, vectors[7][1])] * 350
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    found = topk_search.digest(frame)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got: dict[int, list] = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 700, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:10]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_top_k_sends_nothing_to_the_driver(spark):
    """Repeated vectors compress to files far below the broadcast threshold; their blocks times shards don't fit the driver."""
    frame = spark.createDataFrame([(k, [float(k % 20)] * 64) for k in range(2000)], "vec_id long, embedding array<float>")
    plan = topk_search.digest(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_top_k_of_huge_values(spark):
    rows = [(0, [3.0e9, 1.0]), (1, [2.0e3, 5.0]), (2, [1.0e3, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.rank, r.vec_id, r.score) for r in topk_search.digest(frame).collect()}
    assert got == {(1, 1, int(1024 * 3e9) * 2048000 + 1024 * 5120), (2, 2, int(1024 * 3e9) * 1024000 + 1024 * 9216)}


SCHEMAS = {"find": {"city": ("string", True), "days": ("integer", False)}, "add": {"x": ("number", True)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("c", "a", 1, "find", '{"days": 2, "city": "Rome"}', None, 0),
            ("c", "b", 2, "add", '{"x": 1.5}', "a", 0),
            ("c", "d", 3, "add", '{"x": "no", "y": 1}', "b", 0),
            ("c", "e", 4, "nothing", "[1]", "z", 0),
            ("c", "f", 5, "find", "{}", "g", 0),
            ("c", "g", 6, "find", None, "f", 0),
            ("c", "a", 9, "find", '{"city": "later"}', None, 0),
            (None, "x", 1, "find", "{}", None, 0),
            ("k", "a", 1, "add", '{"x": 3}', None, 0),
        ],
        "conv_id string, call_id string, position long, name string, arguments string, depends_on string, rank int",
    )
    results = spark.createDataFrame([("c", "a", 2, "sunny"), ("c", "a", 8, "late"), ("c", "q", 3, "lost"), ("c", "b", 3, "2")], "conv_id string, call_id string, position long, content string")
    got = {(r.conv_id, r.call_id): r for r in chat_tools.linked(calls, results, SCHEMAS).collect()}
    assert len(got) == 7
    order = [c for _, c in sorted((r.rank, r.call_id) for (conv, _), r in got.items() if conv == "c")]
    assert order == ["a", "e", "b", "d", "f", "g"]
    assert [got["c", c].level for c in order] == [0, 0, 1, 2, None, None]
    assert [got["c", c].status for c in order] == ["complete", "invalid", "complete", "invalid", "invalid", "invalid"]
    assert got["c", "a"].record == '{"arguments":{"city":"Rome","days":2},"call_id":"a","conv_id":"c","errors":[],"level":0,"name":"find","result":"sunny"}'
    assert json.loads(got["c", "b"].record)["depends_on"] == "a"
    assert got["c", "d"].errors == ["x: not of type number", "y: unknown"]
    assert set(got["c", "e"].errors) == {"arguments: not an object", "name: no such tool", "depends_on: unknown call"}
    assert "city: missing" in got["c", "f"].errors and "depends_on: cycle" in got["c", "f"].errors
    assert got["k", "a"].status == "pending"
    assert chat_tools.linked(calls.limit(0), results, SCHEMAS).count() == 0


def plain_linked(calls, results):
    """Order, level, status of each call, by following chains one by one."""
    first, found = {}, {(r[0], r[1]) for r in results if None not in r[:2]}
    for c in sorted((c for c in calls if None not in c[:2]), key=lambda c: (c[2], c[4])):
        first.setdefault(c[:2], c)

    def level(c, seen=()):
        to = (c[0], c[5])
        if c[5] is None or to not in first:
            return 0
        if to in seen:
            return None
        below = level(first[to], (*seen, to))
        return None if below is None else below + 1

    rows = {key: level(c, (key,)) for key, c in first.items()}
    out = {}
    for conv in {c for c, _ in first}:
        own = sorted((k for k in first if k[0] == conv), key=lambda k: (rows[k] is None, rows[k] or 0, first[k][2], k[1]))
        for rank, key in enumerate(own):
            c = first[key]
            try:
                arguments = json.loads(c[4])
                bad = not isinstance(arguments, dict) or any(p != "x" for p in arguments) or "x" not in arguments or type(arguments["x"]) not in (int, float)
            except ValueError:
                bad = True
            bad |= c[3] != "add" or rows[key] is None or c[5] is not None and (conv, c[5]) not in first
            out[key] = (rows[key], rank, "invalid" if bad else "complete" if key in found else "pending")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tool_calls_against_following_chains(spark, monkeypatch, seed):
    """Chains, trees, cycles and repeated calls; one conversation holds more than a third of all rows."""
    monkeypatch.setattr(chat_tools, "SLICE", 3)
    monkeypatch.setattr(chat_tools, "LEVELS", 4)
    rng, calls, results = random.Random(seed), [], []
    for k in range(160):
        conv = "hot" if k % 2 else f"c{rng.randrange(6)}"
        to = rng.choice([None, f"a{k - 2}", f"a{k - 2}", f"a{rng.randrange(200)}"])
        calls.append((conv, f"a{k}", rng.randrange(60), rng.choice(["add", "add", "add", "sub"]), rng.choice(['{"x": 1}', '{"x":2.5}', '{"x":"s"}', "{}", "[", '{"x":1,"y":2}']), to))
        results += [(conv, f"a{k}", 1, "r")] * rng.randrange(3)
    calls += [calls[3], calls[5], (None, "a1", 1, "add", "{}", None)]
    got = chat_tools.linked(spark.createDataFrame(calls, "conv_id string, call_id string, position long, name string, arguments string, depends_on string"), spark.createDataFrame(results, "conv_id string, call_id string, position long, content string"), SCHEMAS)
    assert {(r.conv_id, r.call_id): (r.level, r.rank, r.status) for r in got.collect()} == plain_linked(calls, results)


def test_tool_calls_of_odd_conversations(spark):
    """A turn after a gap, one after another user's turn, and repeated turns."""
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 4, "user", "d"), (1, 5, "assistant", "e"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    got = {r.call_id: (r.status, r.errors) for r in chat_tools.digest(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {"1:0": ("pending", []), "1:1": ("invalid", ["name: no such tool"]), "1:4": ("invalid", ["after: missing", "depends_on: unknown call"]), "2:0": ("complete", [])}


def test_tool_calls_of_conversations(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "more"), (2, 0, "user", None), (2, 1, "assistant", "?"), (None, 0, "user", "x"), (3, None, "user", "x")]
    got = {r.call_id: r for r in chat_tools.digest(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"1:1", "1:3", "2:0"}
    assert (got["1:1"].status, got["1:3"].status, got["2:0"].status) == ("complete", "pending", "invalid")
    assert got["1:3"].level == 1 and got["1:3"].rank == 1
