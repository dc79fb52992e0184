"""Each operator against brute force on small rows, with nulls, empties, repeats and extra columns."""

import gzip
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import chat, common, decontaminate, html_text, licenses, mixing, ngram_join, oracles, queries, token_ids, topk, toxicity, warc

DOC = "doc_id long, text string, source string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash")).withColumn("component_id", F.lit(1))


def test_ranks_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7, 3], np.uint32)
    control, data = token_ids.encode_ranks(x)
    assert (token_ids.decode_ranks(control, data, len(x)) == x).all()


def test_encoder_against_the_tokenizer():
    from tokenizers import Tokenizer

    rng, plain = random.Random(3), Tokenizer.from_file(queries.tokenizer_path())
    parts = [*"ab'é1,.!?\n \n  \t\xa0\u3000 \0|-", "'s", "<|endoftext|>", "<|", "endoftext", "|>", "the ", "\r\n", "日本", "\x1c", " \n", "don't"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(8000)]
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    encoder = token_ids.MemoEncoder(queries.tokenizer_path(), end_id=0, limit=300)  # emptied many times
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, n = encoder.encode_many(some)
        want = [x.ids + [0] for x in plain.encode_batch(some, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert encoder.encode_many([])[0].tolist() == [] and encoder.encode("").tolist() == []


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = ["Hello, world's  end\n\n x", None, "", "a\nb c. d! <|endoftext|>", prose(1, 5000), " lead", "tail ", "a\n b, (c)", "Hello, world's  end\n\n x", "a<|endoftext|>b c", prose(2, 200_000)]
    rows = [(i if i != 3 else None, s, "s") for i, s in enumerate(texts)] + [(4, "other", "s"), (4, "other", "s"), (None, "more", "s")]
    want = sorted((r[0] is not None, r[0] or 0, t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows)
    tagged = docs(spark, rows).selectExpr("*", "1 AS ids", "2 AS h", "3 AS start")
    out = common.scratch_path(spark, "t")
    token_ids.write_token_files(tagged, out, path, block_ids=50)
    got = token_ids.read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += len(r.ids)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    empty = common.scratch_path(spark, "t")
    token_ids.write_token_files(tagged.limit(0), empty, path)
    assert token_ids.read_token_files(spark, empty).count() == 0
    tagged.where("doc_id <> 4").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.ids_crc32 for r in queries.op1_token_ids(spark, str(tmp_path)).collect()) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for a, b, x in want if a and b != 4)


def test_chat_round_trip(spark):
    said = [("user", r"\### </turn> ok\ "), ("user", "<part>"), ("assistant", r"x\</turn>" + "\n</turn>\n"), ("assistant", ""), ("tool call\n", "<turn a>"), ("assistant", None)]
    rows = [(1, i, a, b) for i, (a, b) in enumerate(said)] + [(2, 0, None, None)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(a, b or "") for a, b in said]
    assert list(got[1].loss_texts) == [b or "" for a, b in said if a == "assistant"]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a b/", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", "x\r\n\r\nWARC/1.1\r\n"), (4, "v", "é"), (5, "w", "")], "page_id long, url string, html string")
    p = common.scratch_path(spark, "warc")
    warc.write_arc(pages.where("page_id <= 2"), f"{p}/1", 1)
    warc.write_arc(pages.where("page_id > 2"), f"{p}/2", 2)
    warc.convert_arc(spark, f"{p}/w", f"{p}/1", f"{p}/2")
    got = {r.key: r for r in warc.read_warc(spark, f"{p}/w", with_payload=True).collect()}
    assert {k: r.payload for k, r in got.items()} == {1: "x\r\n\r\nWARC/1.1\r\n", 2: "", 3: "x\r\n\r\nWARC/1.1\r\n", 4: "é", 5: ""}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 5), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert all(r.payload_digest == r.declared_digest for r in got.values())


def test_warc_of_odd_rows(spark):
    rows = [(None, "u", "same"), (7, "u", "same"), (7, "u", "same"), (8, "u b\n", "long " * 300_000), (9, "u", None), (10, "", "WARC/1.1\nARC\n\n\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS place", "3 AS k", "4 AS path")
    p = common.scratch_path(spark, "warc")
    warc.write_arc(pages, f"{p}/2", 2)
    warc.convert_arc(spark, f"{p}/w", f"{p}/2")
    got = warc.read_warc(spark, f"{p}/w", with_payload=True).collect()
    assert sorted((r.key or 0, r.payload, r.record_type, r.refers_to) for r in got) == sorted([(0, "same", "revisit", 7), (7, "same", "response", None), (7, "same", "response", None), (8, "long " * 300_000, "response", None), (9, "", "response", None), (10, rows[5][2], "response", None)])
    assert all(r.payload_digest == r.declared_digest and r.payload_bytes == len(r.payload) for r in got)
    warc.write_arc(pages.limit(0), f"{p}/none", 1)
    warc.convert_arc(spark, f"{p}/none-warc", f"{p}/none")
    assert warc.read_warc(spark, f"{p}/none-warc").count() == 0


def test_warc_deals_rows_of_one_key(spark, monkeypatch):
    """Rows without a key, and equal ones, lie in many files of about the wanted size."""
    monkeypatch.setattr(warc, "FILE_MB", 1)
    unlike = spark.range(600).selectExpr("CAST(NULL AS LONG) AS page_id", "'u' AS url", "repeat(concat('unlike ', id), 600) AS html")
    equal = spark.range(0, 600, 1, 12).selectExpr("7L AS page_id", "'u' AS url", "repeat('equal ', 700) AS html")
    for pages in (unlike, equal):
        p = common.scratch_path(spark, "warc")
        warc.write_arc(pages, f"{p}/arc", 2)
        sizes = warc.read_arc(spark, f"{p}/arc").groupBy("path").count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) <= 450 and sum(r["count"] for r in sizes) == 600
        warc.convert_arc(spark, f"{p}/warc", f"{p}/arc")
        got = warc.read_warc(spark, f"{p}/warc", with_payload=True)
        assert got.groupBy("key", "payload").count().exceptAll(pages.groupBy("page_id", "html").count()).isEmpty() and got.count() == 600


def test_warc_copies_bytes(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\n\xff\xfe\x00\n\x80" + bytes(range(256)) * 9000
    block = b"1 0 Archive\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    raw = b"filedesc://x 0.0.0.0 2001 text/plain %d\n%s\n" % (len(block), block) + b"http://x/ 0.0.0.0 20010203 text/html %d\n%s\n" % (len(body), body) * 2
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(raw)
    for piece in (1 << 20, 3, 1000):
        stream = warc.Stream(gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :]))
        stream.PIECE = piece
        assert b"".join(iter(stream.line, None)) == raw
    warc.convert_arc(spark, f"{tmp_path}/warc", f"{tmp_path}/arc")
    got = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    want = warc.base32_sha1(body.split(b"\r\n\r\n", 1)[1])
    assert [(r.key, r.date, r.payload_digest, r.declared_digest) for r in got] == [(3, "2001-02-03T00:00:00Z", want, want)] * 2


def test_leaks(spark):
    item = prose(7, 40).split()
    edited = [w if i % 8 else "changed" for i, w in enumerate(item)]
    rows = [(1, prose(2, 300) + " " + " ".join(item), "s"), (2, " ".join(edited) + " " + prose(3, 200), "s"), (3, prose(4, 500), "s"), (4, None, "s"), (5, "", "s")]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None)], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 10)}
    full = next(r for r in got if r.doc_id == 1)
    assert (full.score, full.start_word, full.end_word) == (1.0, 300, 340)
    assert [r.doc_id for r in decontaminate.drop_leaks(docs(spark, rows), bench).orderBy("doc_id").collect()] == [3, 4, 5]


@pytest.mark.parametrize("kind", [4, 6, "half"])
def test_leaks_of_frequent_copies(spark, kind):
    item = prose(7, 40).split()
    copy = " ".join(item[:20] if kind == "half" else [w if i % kind else f"changed{i}" for i, w in enumerate(item)])
    rows = [(i, f"{prose(100 + i, 60)} {copy} {prose(200 + i, 60)}", "s") for i in range(50)] + [(50, prose(6, 300), "s")]
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()) == list(range(50))


def test_leaks_side_by_side(spark):
    item = prose(7, 40)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [(1, f"{item} {prose(5, 300)} {item} {item}", "s")]), bench).collect()
    assert sorted(r.start_word for r in got) == [0, 340, 380]


def brute_smith_waterman(item, words):
    best, prev = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, prev[j] + (2 if a == b else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_leaks_against_smith_waterman(spark):
    r = random.Random(9)
    items = [(i % 10 if i < 12 else None, prose(500 + i, r.choice([4, 9, 25, 40]))) for i in range(14)]
    rows = []
    for i in range(120):
        text = prose(900 + i, 60).split()
        words = r.choice(items)[1].split()
        rate = r.random() / 2
        copy = [x for w in words if (d := r.random()) > rate / 3 for x in ([w] if d > rate else [f"edit{r.randrange(99)}"] if d > rate / 2 else [w, "more"])]
        if r.random() < 0.3:
            copy[len(copy) // 2 : len(copy) // 2] = prose(i, r.randrange(len(words) + 3)).split()
        rows.append((i if i % 9 else None if i else 5, " ".join(text[:30] + copy + text[30:]), f"key{i}"))
    rows += [(None, None, "none"), (3, "", "empty")]
    bench = spark.createDataFrame(items + [(77, None), (78, "a b")], "item_id long, text string").selectExpr("*", "1 AS score", "2 AS doc_id")
    want, leaking = set(), set()
    for key, text, name in rows:
        words = (text or "").split()
        for item_id, said in items:
            item = said.split()
            if item_id is not None and brute_smith_waterman(item, words) >= len(item):
                want.add((key, item_id))
                leaking.add(name)
    tagged = docs(spark, rows).selectExpr("*", "5 AS score", "6 AS words", "7 AS item_id")
    for block in (10**6, 60):  # one block, and many
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(tagged, bench, block_words=block).collect()} == want
        kept = decontaminate.drop_leaks(tagged, bench, block_words=block)
        assert kept.columns == tagged.columns and {x.source for x in kept.collect()} == {x[2] for x in rows} - leaking
    assert 20 < len(leaking) < 110
    assert decontaminate.find_leaks(tagged.limit(0), bench).count() == decontaminate.find_leaks(tagged, bench.limit(0)).count() == decontaminate.drop_leaks(tagged.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(tagged, bench.limit(0)).count() == len(rows)


def test_leaks_of_large_blocks():
    words = [f"x{i}" for i in range(2_200_000)]
    items = decontaminate.Items([(1, words), (2, words[5:25])], 0.5)
    ids = items.numbers("y " * 50 + " ".join(words[5:25]) + " z" * 50)
    assert set(items.hits(ids)[0].tolist()) == set(range(50, 69))
    items.keep_rare((np.arange(len(items.codes)) >= 25).astype(np.int64))
    [(a, b)] = decontaminate.Items([(2, words[5:25])], 0.5).passages(np.where(ids >= 5, ids - 5, -1))
    assert a <= 50 and b >= 70
    assert any(x[0] == 2 and x[1] == 1.0 for x in items.leaks(ids))


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.7])
def test_rare_seeds_lose_no_leak(threshold):
    """Copies with words changed, lost and put in, at every rate; seeds of random frequency. Few words, so chance matches too."""
    r, found = random.Random(4), 0
    for _ in range(400):
        item = [f"w{r.randrange(40)}" for _ in range(r.randrange(3, 31))]
        rate = r.random() * 0.6
        copy = [x for w in item for x in ([w] if r.random() > rate else r.choice([[], ["new"], [w, "more"], ["more", w]]))]
        words = [f"w{r.randrange(60)}" for _ in range(20)] + copy + [f"w{r.randrange(60)}" for _ in range(20)]
        items = decontaminate.Items([(1, item)], threshold)
        items.keep_rare(np.array([r.randrange(5) for _ in items.codes]))
        ids = items.numbers(" ".join(words))
        got = [x for a, b in items.passages(ids) for x in items.leaks(ids[a:b])]
        want = brute_smith_waterman(item, words)
        assert bool(got) == (want >= threshold * 2 * len(item))
        if got:
            found += 1
            assert max(x[1] for x in got) == want / (2 * len(item))
    assert found > 60


def test_seeds_are_rare(spark):
    """A phrase that all documents have opens no passage, and the item is found by its other words."""
    phrase = "which of the following is true of the one below"
    item = f"{phrase} " + " ".join(f"answer{i}" for i in range(12))
    rows = [(i, f"{prose(100 + i, 30)} {phrase} {prose(200 + i, 30)}", "s") for i in range(40)] + [(40, f"{prose(3, 30)} {item}", "s")]
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    [shared] = decontaminate.item_blocks(docs(spark, rows), bench, 3, 0.5, 10**6, "text", "item_id", "text")
    opened = decontaminate.passages(docs(spark, rows), shared, "doc_id", "text")
    assert {x.doc_id for x in opened.collect()} == {40}
    assert [x.doc_id for x in decontaminate.find_leaks(docs(spark, rows), bench).collect()] == [40]


def test_leaks_of_edited_copies(spark):
    """Each third word changed: no three neighbours are whole."""
    item = prose(7, 30).split()
    copy = " ".join(w if i % 3 != 2 else f"changed{i}" for i, w in enumerate(item))
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [(1, f"{prose(5, 90)} {copy} {prose(6, 90)}", "s"), (2, prose(8, 90), "s")]), bench).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(1, 10)] and got[0].score >= 0.5


def test_html():
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b> text<br>goes on.<p>Second,  with
    space &eacute;.</p><aside>side</aside><div class="comments"><p>Nice!</p></div></article><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst bold text goes on.\nSecond, with space é."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    plain = "<body><div id=menu><a>x</a></div><div>" + "".join(f"<p>{prose(i, 40)}</p>" for i in range(3)) + "<p>Yes.</p></div></body>"
    assert html_text.main_text(plain).split("\n")[-1] == "Yes." and len(html_text.main_text(plain).split("\n")) == 4


def test_html_articles_and_depth():
    said = [prose(i, 60) for i in range(6)]
    p = "".join(f"<p>{x}</p>" for x in said[:3]), "".join(f"<p>{x}</p>" for x in said[3:])
    menu = "<nav><a href=x>Home</a></nav>"
    for page in (
        f"<body>{menu}<div class=all><article>{p[0]}</article><article>{p[1]}</article></div></body>",
        f"<body>{menu}<main><article>{p[0]}</article><article>{p[1]}</article></main></body>",
        f"<body>{menu}<div class='page has-sidebar'>{p[0]}{p[1]}</div><div class=sidebar>x</div></body>",
        f"<body>{menu}<div class='no-sidebar'>{p[0]}{p[1]}</div></body>",
        f"<body>{menu}{'<div>' * 20000}{p[0]}{p[1]}{'</div>' * 20000}</body>",
    ):
        assert html_text.main_text(page).split("\n") == said


def test_html_scan():
    text = html_text.main_text
    assert text('<p title="a>b">x</p>') == "x" and text('<p title="open>x</p><p>y</p>') == "x\ny" and text("<p a'b>x</p>") == "x"
    assert text("a < b <c") == "a < b" and text("<p>x<!-- <p>y") == "x" and text("<![CDATA[a<b]]>") == "a<b"
    assert text("<p>a <label>n <input></label>b</p>") == "a b" and text("<p>x<span hidden>y<p>z</p>") == "x\nz"
    assert text('<p><a href="?id=nav" data-id="ad">x</a></p></body><p>y</p>') == "x\ny"
    assert text("&#" + "9" * 9000 + ";&#x0000000041;&#66;") == "\ufffdAB"
    assert text("<head><title>t</title><p>x</p>") == "x" and text("<p>x<script>y</script") == "x"
    assert text("<article><header class='entry-header'><h1>T</h1></header><div class=entry-header>S</div><p>x</p></article>") == "T\nS\nx"
    assert text("<table><tr><td>a<td>b<tr><td><p>c<p>d</table>") == "a b\nc\nd"


@pytest.mark.parametrize("piece", ['<a href="', "<a '", "<p x='", "<b", "</script", "<!--", "<![CDATA[", "<a \"\"", "<i>", "<p>", "<span hidden>x", "<li>", "&#1", "<div>", "<table><tr><td>", "<script>"])
def test_html_takes_linear_time(piece):
    began = time.time()
    html_text.main_text("<p>x</p>" + piece * (300_000 // len(piece)))
    html_text.main_text("<p>x</p><div id=" + piece * (300_000 // len(piece)) + ">")
    assert time.time() - began < 20


def without_menus(n):
    """A tree of (text, link text, children) without the subtrees that are mostly links, deepest first."""

    def counts(m):
        return np.array([len((m[0] + m[1]).replace(" ", "")), len(m[1].replace(" ", "")), bool(m[1])]) + sum(map(counts, m[2]), np.zeros(3))

    children = [c for c in map(without_menus, n[2]) if not (counts(c)[2] > 2 and counts(c)[1] > 0.7 * counts(c)[0])]
    return n[0], n[1], children


def brute_density_text(tree):
    """The operator's definition on a tree of (text, link text, children), written without regard to time."""
    nodes, tree = [], without_menus(tree)

    def walk(n, up):
        at = len(nodes)
        nodes.append([n, up])
        for c in n[2]:
            walk(c, at)

    walk(tree, None)
    below = lambda k: [j for j in range(len(nodes)) if k in path(j)]

    def path(j):
        out = []
        while j is not None:
            out.append(j)
            j = nodes[j][1]
        return out

    size = lambda s: len(s.replace(" ", ""))
    count = lambda k: (sum(size(nodes[j][0][0]) + size(nodes[j][0][1]) for j in below(k)), sum(size(nodes[j][0][1]) for j in below(k)), len(below(k)) - 1 + sum(bool(nodes[j][0][1]) for j in below(k)), sum(bool(nodes[j][0][1]) for j in below(k)))
    cb, lb = count(0)[:2]

    def density(k):
        c, lc, t, lt = count(k)
        if not c or not lb:
            return c / max(1, t)
        base = math.log(c / max(1, c - lc) * lc + lb / cb * c + math.e)
        return c / max(1, t) * math.log(c * max(1, t) / max(1, lc) / max(1, lt)) / math.log(base)

    d = [density(k) for k in range(len(nodes))]
    sums = [sum(d[j] for j in range(len(nodes)) if nodes[j][1] == k) for k in range(len(nodes))]
    best = lambda k: max(below(k), key=lambda j: (sums[j], -j))
    core = best(0) if sums[best(0)] else max(range(len(nodes)), key=lambda j: (d[j], -j))
    least = min(d[j] for j in path(core))
    marks = {core} | {best(k) if sums[best(k)] else k for k in range(1, len(nodes)) if d[k] >= least}
    top = next(j for j in path(core) if marks <= set(below(j)))
    return "\n".join(s for j in below(top) if (s := " ".join((nodes[j][0][0] + " " + nodes[j][0][1]).split())))


def test_html_densities(spark):
    r = random.Random(11)

    def tree(depth):
        text = " ".join(r.choice(WORDS) for _ in range(r.choice([0, 0, 3, 40, 120])))
        link = " ".join(r.choice(WORDS) for _ in range(r.choice([0, 0, 0, 2, 20])))
        return text, link, [tree(depth - 1) for _ in range(r.randrange(4))] if depth else []

    def page(n, tag="div"):
        return f"<{tag}>{n[0]} {'<a href=x>' + n[1] + '</a>' if n[1] else ''}{''.join(page(c) for c in n[2])}</{tag}>"

    trees = [("", "", [tree(3) for _ in range(3)]) for _ in range(150)]
    rows = [(i, None, page(t, "body"), "clash") for i, t in enumerate(trees)] + [(None, None, None, "clash"), (7, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 152 and html_text.extract_text(pages.limit(0)).count() == 0
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id is None or r.url] == [(None, None, "", 0), (7, "u", "", 0)]
    want = {i: brute_density_text(t) for i, t in enumerate(trees)}
    assert {r.page_id: r.text for r in got if r.page_id is not None and not r.url} == want
    whole = [len("".join(re.sub("<[^>]*>", " ", page(t, "body")).split())) for t in trees]
    assert sum(len("".join(w.split())) < whole[i] for i, w in want.items()) > 20  # the densities leave something out


def test_html_densities_decide(monkeypatch):
    links = "".join(f"<p><a href=x>{prose(i, 4)}</a> and {prose(50 + i, 2)}</p>" for i in range(12))
    said = [prose(i, 80) for i in range(4)]
    body = f"<body><div>{links}</div><div><div>{''.join(f'<p>{x}</p>' for x in said)}</div></div><div>{links}</div></body>"
    articles = f"<body><article>{links}</article><article>{''.join(f'<p>{x}</p>' for x in said)}</article></body>"
    assert html_text.main_text(body).split("\n") == html_text.main_text(articles).split("\n") == said
    monkeypatch.setattr(html_text, "density", lambda n, body: 0.0)
    assert html_text.main_text(body).split("\n") != said and html_text.main_text(articles).split("\n") != said


def test_top_k(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(300, 6)), 2)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), k=20, shard_rows=64, block_queries=4)
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:20]
        want += [(i, n + 1, j, -sc) for n, (sc, j) in enumerate(s)]
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_of_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(int(r.integers(0, 60)), np.round(r.normal(size=int(d)) + 9 * (i % 3), 2).tolist()) for i, d in enumerate(r.choice([3, 5], 200))]
    rows += [rows[0]] * 3 + [(0, [0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5]), (20, [9.0] * 7), (None, [1.0] * 3), (40, [])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS cell", "3 AS dim"))
    usable = [(i, [math.floor(64 * c) for c in x]) for i, x in rows if i is not None and x]
    want = []
    for a, (i, x) in enumerate(usable):
        if i % 20 == 0:
            found = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(usable) if b != a and len(x) == len(y))[:7]
            want += [(i, n + 1, j, -score) for n, (score, j) in enumerate(found)]
    for shard, block in ((4096, 512), (16, 3)):
        got = topk.top_k(v, v.where("vec_id % 20 = 0"), k=7, shard_rows=shard, block_queries=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    with pytest.raises(Exception, match="would not be exact"):
        big = spark.createDataFrame([(1, [2**22])], "vec_id long, x array<long>")
        topk.top_k(big, big).collect()


def test_toxicity(spark):
    bad = ["scum", "idiot", "loser"]
    rows = [(i, prose(i, 60) + (" " + bad[i % 3] + " " + bad[(i + 1) % 3] if i % 4 == 0 else ""), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.rejected(docs(spark, rows), labels).collect()}
    truth = {i for i in range(400) if i % 4 == 0}
    assert len(got & truth) >= 95 and len(got - truth) <= 3
    assert toxicity.rejected(docs(spark, rows), labels.limit(0)).count() == 0
    few = labels.where("doc_id IN (0, 1, 2)")  # no feature tells so few labels apart
    assert toxicity.rejected(docs(spark, rows), few).count() == 0


def test_toxic_rows(spark):
    bad = ["scum idiot", "idiot loser", "loser scum"]
    rows = [(i, prose(i, 60) + (" " + bad[i % 3] if i % 4 == 0 else ""), "s") for i in range(300)]
    more = [(None, prose(900, 60) + " scum idiot", "toxic"), (0, prose(901, 60), "clean"), (1, prose(902, 50) + " loser idiot scum", "toxic"), (None, None, "null"), (7, "", "empty"), (8, "word " * 200_000 + "idiot loser", "toxic"), (9, prose(903, 10), "same"), (9, prose(903, 10), "same")]
    tagged = docs(spark, rows + more).selectExpr("*", "1 AS toxic", "2 AS grade", "3 AS p_toxic", "4 AS features")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(10, 300)], "doc_id long, toxic int").selectExpr("*", "'x' AS text", "9 AS feature")
    kept = toxicity.drop_toxic(tagged, labels)
    assert kept.columns == tagged.columns
    assert sorted(r.source for r in kept.collect() if r.source != "s") == ["clean", "empty", "null", "same", "same"]
    assert toxicity.score(tagged, toxicity.train(tagged, labels)).count() == 308
    for no_docs, no_labels in ((tagged.limit(0), labels), (tagged, labels.limit(0)), (tagged, labels.where("toxic = 1"))):
        assert toxicity.rejected(no_docs, no_labels).count() == 0 and toxicity.drop_toxic(no_docs, no_labels).count() == no_docs.count()
    model = toxicity.train(tagged, labels)
    assert (np.diff(model.thresholds) >= 0).all() and model.grades(np.array([-50.0, 50.0])).sum(axis=1).round().tolist() == [0, len(model.thresholds)]


def ordinal_loss(grade, rows, w, theta):
    """The plain likelihood of a cumulative-link model, both classes weighing alike."""
    toxic, loss = sum(g > 0 for g in grade), 0.0
    for g, features in zip(grade, rows):
        score = sum(w[k] for k in features)
        reached = [1.0] + [1 / (1 + math.exp(t - score)) for t in theta] + [0.0]
        loss -= math.log(max(reached[g] - reached[g + 1], 1e-9)) * 0.5 / (toxic if g else len(grade) - toxic)
    return loss + 5e-7 * sum(x * x for x in w)


def test_ordinal_fit_against_plain_likelihood():
    r = random.Random(8)
    rows = [sorted(k for k in range(4) if r.random() < 0.5) for _ in range(150)]
    grade = [min(3, max(0, sum(k < 2 for k in x) + r.choice([-1, 0, 0, 1]))) for x in rows]
    w, theta = toxicity.fit(np.array(grade), [np.array(x, np.int64) for x in rows], 4, rounds=3000, rate=0.02)
    assert sorted(theta) == theta.tolist()
    best, step, at = ordinal_loss(grade, rows, [0.0] * 4, [0.1, 1.0, 2.0]), 0.5, [0.0] * 4 + [0.1, 1.0, 2.0]
    while step > 1e-3:  # a search by steps of each number in turn, with the same bound on thresholds
        moved = False
        for k in range(7):
            for sign in (step, -step):
                to = at[:k] + [at[k] + sign] + at[k + 1 :]
                if 1e-3 <= to[4] <= to[5] <= to[6] and (loss := ordinal_loss(grade, rows, to[:4], to[4:])) < best:
                    at, best, moved = to, loss, True
        step = step if moved else step / 2
    assert abs(ordinal_loss(grade, rows, w, theta) - best) < 1e-3
    assert np.abs(np.array(at) - np.concatenate([w, theta])).max() < 0.1


def test_grades_are_held_out():
    """Toxic documents with the stronger feature have the higher grades, and no document's own label counts for its grade."""
    r = random.Random(3)
    toxic = np.array([i % 2 == 0 for i in range(400)])
    rows = [np.array([0] if t and i % 4 == 0 and r.random() < 0.95 else [1] if r.random() < (0.7 if t else 0.3) else [], np.int64) for i, t in enumerate(toxic)]
    grade = toxicity.held_out_grades(toxic, rows, 2)
    assert set(grade[~toxic]) == {0} and sorted(set(grade[toxic])) == [1, 2, 3]
    strong = np.array([0 in x for x in rows])
    assert grade[toxic & strong].mean() > grade[toxic & ~strong].mean() + 0.5
    # A feature that one toxic document alone has is unknown to the other half's model and adds nothing.
    alone = rows[:-2] + [np.array([2], np.int64)] + rows[-1:]
    assert toxicity.held_out_grades(toxic, alone, 3)[-2] == 1
    assert toxicity.held_out_grades(np.array([True, False]), [np.array([0]), np.array([1])], 2).tolist() == [1, 0]


def test_licenses(spark):
    rows = [(1, "a\nReleased under the MIT License.\nb MIT\nlicense", "s"), (2, None, "s"), (3, "License the Apache License", "s"), (4, "Licensed under the Apache License, Version 2.0!", "s"), (None, "x", "s")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 4, 7, "mit", "mit,mit-notice")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert (got[3].base_labels, got[3].labels) == ("apache", "apache") and got[4].labels == "apache,apache-2.0"
    assert got[None].n_words == 1


def test_license_join_against_brute_force(spark):
    r = random.Random(5)
    some = [f"k{i}" for i in range(14)]
    templates = tuple((f"t{i % 5}", " ".join(r.choice(some) for _ in range(r.choice([1, 3, 8, 12, 20])))) for i in range(9))
    rows = []
    for i in range(300):
        words = [r.choice(some) if r.random() < 0.9 else "other" for _ in range(r.randrange(40))]
        if i % 3:
            said = r.choice(templates)[1].split()
            words[3:3] = [w if r.random() < 0.93 else "changed" for w in said]
        rows.append((i, "".join(w + r.choice(" \n    ") for w in words), "s"))
    rows += [(5, rows[5][1], "s"), (400, None, "s"), (401, ("x " * 100 + "\n") * 3000 + templates[4][1], "s")]
    for threshold in (0.7, 0.9):
        got = sorted(licenses.scan(docs(spark, rows).withColumn("labels", F.lit(3)), templates, {}, threshold).collect(), key=lambda x: x.doc_id)
        assert len(got) == len(rows)
        held = 0
        for x, (key, text, _) in zip(got, sorted(rows, key=lambda y: y[0])):
            words, labels, score = (text or "").split(), set(), 0.0
            for label, t in templates:
                wanted, width = set(t.split()), math.ceil(len(t.split()) / threshold)
                blocks = [set(line.split()) for line in (text or "").split("\n")] + [set(words[k : k + width]) for k in range(len(words) if key != 401 else 0)]
                share = max(len(wanted & b) / len(wanted) for b in blocks)
                if share >= threshold - 1e-9:
                    labels.add(label)
                    score = max(score, share)
            assert (x.doc_id, x.labels, x.score, x.n_words, x.n_blocks > 0) == (key, ",".join(sorted(labels)), score, len(words), bool(labels))
            held += bool(labels)
        assert 50 < held < 300
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want


def test_wrapped_licenses(spark):
    import textwrap

    rows, far = [], f"\n{prose(1, 80)}\n"
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        for k, width in enumerate((20, 72)):
            wrapped = "\n".join("# " + x for x in textwrap.wrap(text, width))
            rows += [(100 * i + 2 * k, far + wrapped + far, "s"), (100 * i + 2 * k + 1, wrapped + far + wrapped + "\n" + wrapped, "s")]
        rows.append((100 * i + 50, far.join(text.split()), "s"))  # the words, but no notice
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[100 * i + k].labels.split(",") and got[100 * i + k].score == 1 and got[100 * i + k].n_blocks == 1 + 2 * (k % 2) for k in range(4)), label
        assert got[100 * i + 50].labels == got[100 * i + 50].base_labels == "", label


def brute_components(rows, size, num, den):
    sets, root = [], {}
    for key, text, _ in rows:
        w = (text or "").lower().split()
        sets.append((key, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    at = list(range(len(sets)))
    find = lambda i: i if at[i] == i else find(at[i])
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                at[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(sets)):
        root.setdefault(find(i), []).append(sets[i][0])
    return {(sets[i][0], len(sets[i][1]), min(root[find(i)])) for i in range(len(sets))}


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_jaccard_classes(spark, size, num):
    r = random.Random(num)
    rows, k = [], 0
    for g in range(6):
        base = prose(100 + g, r.choice([4, 30, 150, 400])).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 20) + 1)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(w), "s"))
            k += 1
    rows += [(k, None, "s"), (k + 1, "", "s"), (k + 2, "one two", "s"), (k + 3, "ONE  two", "s")]
    got = {tuple(x) for x in ngram_join.jaccard_classes(docs(spark, rows), size, num, 100).collect()}
    assert got == brute_components(rows, size, num, 100)


def test_jaccard_of_odd_rows(spark):
    long = prose(8, 30_000)
    rows = [(1, prose(1, 50), "s"), (None, prose(1, 50), "s"), (1, prose(2, 50), "s"), (1, prose(1, 50), "s"), (None, "x y z", "s"), (None, "x y z", "s"), (3, None, "s"), (3, None, "s"), (5, long, "s"), (4, long + " end", "s")]
    got = sorted(map(tuple, ngram_join.jaccard_classes(docs(spark, rows), 3, 90, 100).collect()), key=repr)
    assert got == sorted([(1, 48, 1), (None, 48, 1), (1, 48, 1), (1, 48, 1), (None, 1, None), (None, 1, None), (3, 0, 3), (3, 0, 3), (5, len({tuple(long.split()[i : i + 3]) for i in range(29_998)}), 4), (4, len({tuple((long + " end").split()[i : i + 3]) for i in range(29_999)}), 4)], key=repr)
    assert ngram_join.jaccard_classes(docs(spark, rows).limit(0)).count() == 0
    kept = ngram_join.drop_near_duplicates(docs(spark, rows).selectExpr("*", "9 AS h", "8 AS cls"))
    assert kept.columns == ["doc_id", "text", "source", "n_tokens", "component_id", "h", "cls"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, prose(1, 50)), (1, prose(2, 50)), (None, "x y z"), (3, None), (3, None), (4, long + " end")], key=repr)


def test_near_copies_cost_pairs_in_proportion(spark, monkeypatch):
    base, rows = prose(77, 200).split(), []
    for i in range(1000):
        w, r = list(base), random.Random(i)
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "s"))
    compared, sent = ngram_join.compared, []

    def counting(pairs, *more):
        sent.append(pairs.count())
        return compared(pairs, *more)

    monkeypatch.setattr(ngram_join, "compared", counting)
    got = ngram_join.jaccard_classes(docs(spark, rows), 3, 90, 100).collect()
    assert len(got) == 1000 and {r.component_id for r in got} == {0}
    assert sum(sent) < 10_000, sent


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a limit is shared again among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * share > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * share for s in free}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= above


def test_mixing_targets(spark):
    r = random.Random(2)
    for n in (1, 2, 7, 300):
        sizes = {None if k == 3 else f"s{k}\u00e9"[: 1 + k % 5] + str(k): r.choice([0, 1, 10, 1000, 10**6]) for k in range(n)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert len(got) == n and all(abs(x.target - want[x.source]) <= 1e-9 * (1 + want[x.source]) for x in got)


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(0, 60)) if i % 50 else None, ["a", "b", "c", None][min(3, i % 7)]) for i in range(1500)]
    rows += [(None, prose(5, 30), "a")] + [(3, prose(6, 30), "b")] * 40 + [(4, "x " * 5000, "c")]
    tagged = docs(spark, rows).selectExpr("*", "1 AS h", "2 AS copies", "3 AS size", "4 AS _copy")
    got = mixing.mixed(tagged, chunk=64).collect()
    again = mixing.mixed(tagged.repartition(7), chunk=64).collect()
    assert sorted((repr(x.doc_id), x.taken) for x in got) == sorted((repr(x.doc_id), x.taken) for x in again) and len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    want = brute_targets(sizes)
    for source in sizes:
        own = [x for x in got if x.source == source]
        assert sorted(x.size for x in own) == sorted(size(t) for _, t, x in rows if x == source)
        assert all(x.source_size == sizes[source] and abs(x.target - want[source]) < 1e-6 and x.taken == x.copies * x.size <= 3 * x.size for x in own)
        assert abs(sum(x.taken for x in own) - want[source]) <= (5000 if source == "c" else 60)
    taken = mixing.mix(tagged, chunk=64)
    assert taken.columns == tagged.columns
    count = lambda xs: {k: xs.count(k) for k in set(xs)}
    copies = {}
    for x in got:
        copies[repr((x.doc_id, x.source, x.size))] = copies.get(repr((x.doc_id, x.source, x.size)), 0) + x.copies
    assert count([repr((x.doc_id, x.source, size(x.text))) for x in taken.collect()]) == {k: v for k, v in copies.items() if v}
    assert mixing.mixed(tagged.limit(0)).count() == mixing.mix(tagged.limit(0)).count() == 0


def test_chat_of_odd_rows(spark):
    r = random.Random(4)
    bits = [r"\### Assistant: ", "</turn>", "<turn ", "<part>", "\\", "\n", "text ", "<turn user>", ">\n"]
    rows = [(i % 7 if i % 5 else None, r.choice([None, 0, 1, 2, 2]), r.choice(["user", "assistant", None, "sys tem>\n"]), r.choice([None, "", "".join(r.choices(bits, k=6))])) for i in range(200)]
    rows += [(9, 1, "assistant", "same")] * 3 + [(10, k, "assistant" if k % 2 else "user", "long " * 20) for k in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS starts", "4 AS marked")
    got = {x.conv_id: x for x in chat.read_chats(chat.format_chats(turns)).collect()}
    assert got.keys() == {x[0] for x in rows}
    for key, x in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == key))
        assert [(t.role, t.text) for t in x.turns] == [(y[2], y[3]) for y in own]
        assert list(x.loss_texts) == [y[3] for y in own if y[2] == "assistant"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted toxic, copied and leaked rows, null and repeated ids, against the same decisions made without Spark's help."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None
    bad, items = ["scum idiot", "idiot loser", "loser scum"], [prose(3000 + i, 30) for i in range(4)]
    kinds, rows = {}, []

    def add(key, text, kind, source="a"):
        rows.append((key, text, "en", source, len(text or "")))
        kinds.setdefault(kind, []).append(text)

    for i in range(200):
        add(i, prose(i, 60), "clean", "abc"[i % 3])
        if i % 4 == 0:
            add(1000 + i, f"{prose(4000 + i, 60)} {bad[i // 4 % 3]}", "toxic")
    add(None, f"{prose(4999, 60)} scum idiot", "toxic")
    add(5, f"{prose(4998, 60)} loser idiot", "toxic")  # the clean row of this id stays
    for i in range(10):
        base = prose(5000 + i, 100)
        add(2000 + 2 * i, base, "clean")
        add(2001 + 2 * i, base if i % 2 else base + " end", "copy")
    add(None, prose(5000, 100), "copy")
    add(2000, prose(5000, 100), "copy")  # repeated row
    for i, item in enumerate(items):
        add(3000 + i if i else None, f"{prose(6000 + i, 40)} {item} {prose(7000 + i, 40)}", "leaked")
    add(4000, None, "empty")
    add(4001, "", "empty")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[1] in kinds["toxic"])) for r in rows if r[0] is not None and r[0] != 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        seen.append(docs.collect())
    assert all(x.__fields__ == ["doc_id", "text", "lang", "source", "n_chars"] for kept in seen[:4] for x in kept)
    texts = lambda kept: sorted(x.text or "" for x in kept)
    want = sorted(r[1] or "" for r in rows if r[1] not in kinds["toxic"])
    assert texts(seen[0]) == want
    brute = brute_components([(k, r[1], r[3]) for k, r in enumerate(rows) if r[1] not in kinds["toxic"]], 5, 80, 100)
    assert len(seen[1]) == len({c for _, n, c in brute if n}) + sum(n == 0 for _, n, _ in brute)
    assert texts(seen[1]) == sorted(kinds["clean"] + kinds["leaked"] + ["", ""])
    assert texts(seen[2]) == sorted(kinds["clean"] + ["", ""])
    sizes = {s: sum(len((x.text or "").split()) for x in seen[2] if x.source == s) for s in "abc"}
    for s, target in brute_targets(sizes).items():
        copies = [x.text for x in seen[3] if x.source == s]
        assert abs(sum(len(t.split()) for t in copies) - target) <= 100 and all(copies.count(t) <= 3 for t in set(copies))
    plain = Tokenizer.from_file(queries.tokenizer_path())
    crc = lambda t: zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted((x.doc_id, x.ids_crc32) for x in seen[4]) == sorted((x.doc_id, crc(x.text)) for x in seen[3])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, seen[4]), key=repr)
