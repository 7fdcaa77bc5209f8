"""Operators on pages and vectors, and the pipeline, against plain versions."""

from __future__ import annotations

import base64
import glob
import hashlib
import html
import random
import re
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm import quality, tag_paths, topk, warc
from shelfwise.llm.queries import QUERIES
from shelfwise.llm.sql import ORACLES

from .test_documents import PII, WORD, plain_components, plain_quality, plain_removed

SMALL = "/root/testdata/sf0.001"

# --------------------------------------------------------------------- pages


def plain_text(page):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = [re.sub(r"<[^>]*>?", "", x) for x in re.split(r"</?(?:p|h1|br)>", article)]
    parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts]
    return "\n".join(x for x in parts if x)


def test_article_of_each_page(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for row in tag_paths.extract(pages).collect():
        assert row["text"] == plain_text(row["row"]["html"])


def test_pages_that_lack_something(spark):
    values = [
        None,
        "",
        "<html><body></body></html>",
        "just text &amp; more &#228;",
        "<article><h1>T</h1><p>One  two\n three &lt;b&gt;<p>Four<aside>no</aside><!-- no --><script>no</script></article>",
        "<article><p>Text of the article.</p><div class='comments'><p>No, a comment.</p></div><form>no</form></article>",
        "<nav><a>Menu</a></nav><div id=content><h2>Head</h2><p>A long paragraph, with words; and more words.</p>"
        "<p>Another paragraph, as long as the first one.</p></div><div class='sidebar'>Links, links.</div>"
        "<footer>Legal, etc.</footer>",
        "<article><p>cut off in the mid",
        "<p>" * 300 + "deep",
    ]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "page_id long, html string, text string")
    got = [r["text"] for r in tag_paths.extract(rows).orderBy("row.page_id").collect()]
    assert got == [
        "",
        "",
        "",
        "just text & more ä",
        "T\nOne two three <b>\nFour",
        "Text of the article.",
        "Head\nA long paragraph, with words; and more words.\nAnother paragraph, as long as the first one.",
        "cut off in the mid",
        "deep",
    ]
    assert tag_paths.extract(rows.limit(0)).count() == 0


LONG = "A long paragraph, with many words; and then some more of them, up to the end."


def test_ratios_decide_whatever_is_marked():
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    kept = [LONG, LONG]
    assert tag_paths.content(f"<div>{text}</div><article><b>More</b></article>") == kept
    assert tag_paths.content(f"<article>{text}</article><article>{text}</article>") == kept * 2
    assert tag_paths.content(f"<body><h1>Head</h1><p>{LONG}</p><article>{text}</article>") == ["Head", LONG, *kept]
    links = "<ul><li><a>One</a></li><li><a>Two</a></li></ul>"
    assert tag_paths.content(f"<main>{text}<h2>On</h2>{text}{links}<p>{LONG}</p></main>") == [*kept, "On", *kept, LONG]


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ("<ul><li>Two eggs</li><li>Milk</li></ul>", ["Two eggs", "Milk"]),
        ("<table><tr><td>Year</td><td>2020</td></tr></table>", ["Year", "2020"]),
        ("<blockquote><p>Never again!</p></blockquote>", ["Never again!"]),
        ("<pre>x = 1</pre>", ["x = 1"]),
        ("<div>Short closing line</div>", ["Short closing line"]),
        ("<p title=it's>Odd value</p>", ["Odd value"]),
        ("<section class='comments'>%s</section>", []),
        ("<div class=sidebar>%s</div>", []),
        ("<div class='cookie-consent'>%s</div>", []),
        ("<div id='comments-container'>%s</div>", []),
    ],
)
def test_short_blocks_stay_and_long_marked_ones_go(inner, kept):
    inner = inner.replace("%s", f"<p>{LONG * 20}</p>" * 6)
    text = f"<p>{LONG}</p>" * 3
    three = [LONG] * 3
    for around in ("<article>%s</article>", "<main><div>%s</div></main>", "<div id=x>%s</div>"):
        assert tag_paths.content(around % (text + inner + text)) == [*three, *kept, *three], around
        if kept:
            assert tag_paths.content(around % (text + inner)) == [*three, *kept], around
        else:
            assert tag_paths.content(around % text + inner) == three, around


def test_made_layouts():
    """Pages of random layouts, against the blocks that were put into their articles."""
    rng = random.Random(7)

    def sentence():
        return " ".join(rng.choices("one two three four five six".split(), k=rng.randint(6, 30))) + rng.choice(".!?;")

    for _ in range(300):
        truth, article = [], []
        for _ in range(rng.randint(3, 12)):
            kind = rng.choice(["p", "p", "p", "li", "td", "h2", "pre", "blockquote", "inline"])
            value = sentence() if kind in ("p", "inline") else rng.choice(["Two eggs", "2020", "Never again", sentence()])
            truth.append(value)
            first, _, others = value.partition(" ")
            article.append({
                "li": f"<ul><li>{value}</ul>",
                "td": f"<table><tr><td>{value}</table>",
                "inline": f"<p><b>{first}</b> <a href=x>{others}</a></p>" if others else f"<p>{first}",
            }.get(kind, f"<{kind}>{value}</{kind}>"))
            if rng.random() < 0.2:
                article.append(f"<div class={rng.choice(['ad', 'comments', 'share-box'])}><p>{sentence()}</p></div>")
        truth.append(LONG)
        article.append(f"<p>{LONG}</p>")
        open_, close = rng.choice([
            ("<article>", "</article>"), ("<main><div class=text>", "</div></main>"),
            ("<div class='wrap has-sidebar'><article class=post>", "</article></div>"),
        ])
        boilerplate = [
            f"<nav><a href=/>{sentence()}</a></nav>", f"<div class=sidebar><p>{sentence() * 5}</p></div>",
            f"<header><p>{sentence()}</p></header>", "<script>if (a < b) { x('<p>') }</script>",
            "<ul><li><a href=a>One</a></li><li><a href=b>Two, three.</a></li></ul>", f"<footer>{sentence()}</footer>",
            f"<section id=comments><p>{sentence() * 9}</p><p>{sentence() * 9}</p></section>", f"<!-- {sentence()} -->",
        ]
        rng.shuffle(boilerplate)
        cut = rng.randint(0, len(boilerplate))
        page = "".join([*boilerplate[:cut], open_, *article, close, *boilerplate[cut:]])
        assert tag_paths.content(page) == truth, page


def test_long_and_deep_pages_take_linear_time():
    start = time.process_time()
    assert tag_paths.content("<div>" * 20000 + LONG) == [LONG]
    assert len(tag_paths.content("<div>x" * 20000)) == 20000
    assert tag_paths.content("<p><b>" * 20000 + "y") == ["y"]
    assert tag_paths.content("</b><i>" * 20000 + "z") == ["z"]
    assert tag_paths.content("<a b=\"" * 20001) == []
    assert len(tag_paths.content("x" * 1_000_000)[0]) == 1_000_000
    assert time.process_time() - start < 15


def test_outside_words_only_weigh():
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    kept = [LONG, LONG]
    for around in (
        "<body class='has-sidebar'>%s</body>",
        "<div id='content-sidebar-wrap'>%s</div>",
        "<div class='page-with-sidebar'><article>%s</article></div>",
        "<article class='post has-comments'>%s</article>",
        "<main class='search'>%s</main>",
        "<div class='sidebar-left'><main>%s</main></div>",
    ):
        assert tag_paths.content(around % text) == kept, around
        beside = f"{text}<div class='comments'><p>No, a comment.</p></div><p class='share'>Share, share.</p>"
        assert tag_paths.content(around % beside) == kept, around
    comments = "<div class='comments'><p>No, a comment.</p><p>And one more.</p></div>" * 4
    assert tag_paths.content(f"<article>{text}</article>{comments}") == kept
    beside = f"<article><p>A teaser, a short one.</p></article><div class='post has-sidebar'>{text}</div>"
    assert tag_paths.content(beside)[-2:] == kept
    assert tag_paths.content(f"<p><a class='social'>x</a> {LONG}</p><p>{LONG} <a class='social'>x</a></p>") == kept


def read_warc(data):
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield fields, rest[:size]
        data = rest[size + 4 :]


def test_archive_round_trip(spark, tmp_path):
    values = [(3, "u3", "same ä"), (1, "u1", "same ä"), (1, "u1", "same ä"), (2, None, None), (None, "u", "same ä"),
              (5, "u\r\n5", "x" * 50000), (4, "u4", "")]
    pages = spark.createDataFrame([(*v, "clash") for v in values], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / uuid.uuid4().hex)
    warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder)
    got = sorted(
        ((r["page_id"] or 0, r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in records.collect())
        , key=str,
    )
    assert got == sorted(
        [(1, "response", None, "same ä"), (1, "revisit", 1, "same ä"), (3, "revisit", 1, "same ä"),
         (0, "revisit", 1, "same ä"), (2, "response", None, ""), (4, "revisit", 2, ""), (5, "response", None, "x" * 50000)],
        key=str,
    )
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    warc.export_warc(records, f"{folder}/files")
    found = [x for f in glob.glob(f"{folder}/files/part-*") for x in read_warc(open(f, "rb").read())]
    assert len(found) == len(values)
    for fields, block in found:
        if fields["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
        else:
            assert not block and fields["WARC-Refers-To"] in {f["WARC-Record-ID"] for f, _ in found}


def test_small_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long"), (4, "d", "long")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a", least_bytes=3)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_archive(pages.limit(0), f"{tmp_path}/b")
    assert warc.read_archive(spark, f"{tmp_path}/b").count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("digest", "cast('other' as binary) payload").write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


# ------------------------------------------------------------------- vectors


def plain_top(rows, k):
    fine = {(i, tuple(np.floor(64 * np.array(v, float)).tolist())) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in fine:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i)
            out += [(i, rank, j, int(-s)) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.BLOCK, 16])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(8)
    same = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 9) for _ in range(6)]) for i in range(90)]
    rows += [(200, None), (220, [None] * 6), (240, [float("nan")] * 6), (260, [float("inf")] + [0.0] * 5), (None, same)]
    rows += rows[:5]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=7)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 7)
    assert sorted(map(tuple, topk.top_k(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), 7).collect())) == plain_top(
        [r for r in rows if r[0] is not None and r[0] < 3], 7
    )
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# ----------------------------------------------------------- queries, pipeline


def comparable(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    for table in ("documents", "pages", "embeddings", "conversations"):
        duck.execute(f"create or replace view {table} as select * from '{SMALL}/{table}.parquet'")
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert comparable(got.select(*columns).collect()) == comparable([tuple(r[i] for i in order) for r in want.fetchall()])


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    stages = list(corpus_pipeline.STAGES)
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(stages) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= before
            before = docs.count()
            assert docs.where("n_chars != length(text)").count() == 0
    assert docs.select("sequence_id", "offset").distinct().count() == docs.count()
    assert docs.select("doc_id").distinct().count() == before


def plainly_good(text):
    n, chars, symbols, doubled, _, failed = plain_quality(text)
    if failed:
        return False
    words = WORD.findall(text)
    lines = sum(1 for x in text.split("\n") if WORD.search(x))
    return (
        2 <= chars / n <= 15
        and symbols / n <= 0.2
        and len(re.findall("[A-Z]", text)) / chars <= 0.5
        and sum(w.lower().strip(quality.MARKS) in quality.STOP_WORDS for w in words) / n >= 0.02
        and doubled / lines <= 0.5
        and sum(a == b for a, b in zip(words, words[1:])) / n <= 0.3
    )


def plainly_redacted(values):
    """Known kinds, and what stands behind two words that mostly come before known instances."""
    base, mentions = [], []
    for text in values:
        known = [
            (m.start(), k, m.end(), m[0])
            for k, (regex, holds) in enumerate(PII.values()) for m in re.finditer(regex, text) if holds(m[0])
        ]
        found = [
            (m.start(), 4, m.end(), m[0])
            for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z/_-]{0,8}+[0-9][A-Za-z0-9/_-]{5,}", text)
            if not any(s < m.end() and m.start() < e for s, _, e, _ in known)
        ]
        base.append(known)
        both = [(x, re.search(r"(\S+\s+\S+)\s*$", text[max(0, x[0] - 48) : x[0]], re.A)) for x in known + found]
        mentions.append([(x, m[1].lower()) for x, m in both if m])
    edges = {(pattern, x[3]) for own in mentions for x, pattern in own}
    seeds = {x[3] for own in mentions for x, _ in own if x[1] < 4}
    score = {x: float(x in seeds) for _, x in edges}
    for _ in range(3):
        behind = {p: [score[x] for q, x in edges if q == p] for p, _ in edges}
        share = {p: sum(v) / len(v) for p, v in behind.items() if sum(x >= 0.8 for x in v) >= 3}
        for x in score.keys() - seeds:
            score[x] = 1 - float(np.prod([max(1 - share[p], 1e-9) for p, y in edges if y == x and p in share]))
    out = []
    for text, known, own in zip(values, base, mentions, strict=True):
        spans = known + [x for x, pattern in own if x[1] == 4 and share.get(pattern, 0) >= 0.8]
        parts, at = [], 0
        for s, k, e, _ in sorted(spans):
            if s >= at:
                parts += [text[at:s], "[" + [*PII, "found"][k].upper() + "]"]
            at = max(at, e)
        out.append("".join(parts) + text[at:])
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(4)
    words = "the of and river mill wheel market village stone bridge winter garden paper window letter road".split()

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))

    passage, twin = prose(60), "the " + prose(80)
    planted = [f"{prose(30)} customer contact user{i}@mail.example.org and {prose(40)} the {passage}" for i in range(8)]
    planted += [f"the {prose(70)} customer contact X-48213-77 today", f"of {prose(70)} shop 48213-77777"]
    planted += [twin, twin + " and", "the # " * 40, f"7{passage} of the", f"8{passage} of the"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [{**given.first().asDict(), "doc_id": 10**6 + i, "text": t, "n_chars": len(t)} for i, t in enumerate(planted)]
    given.union(spark.createDataFrame(rows, given.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]

    good = [(i, t) for i, t in docs if plainly_good(t or "")]
    ids, values = map(list, zip(*good, strict=True))
    stands = plain_components(values, ids, 5, 80, 100)
    single = [(i, t) for (i, t), (_, first) in zip(good, stands, strict=True) if first == i]
    removed = plain_removed([t for _, t in single], 200)
    cut = [kept.decode("utf-8", "ignore") for *_, kept in removed]
    clean = plainly_redacted(cut)
    assert len(docs) > len(good) > len(single) and any(gone for _, gone, _, _ in removed)
    assert clean != cut and any("[FOUND]" in t for t in clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for (i, _), text in zip(single, clean, strict=True):
        tokens = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(tokens), 2048):
            part = tokens[at : at + 2048]
            want.append((i, at, len(part), zlib.crc32(part.tobytes()), len(tokens)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
