"""Operators on embeddings, pages and conversations against brute force, and their behaviour on odd rows."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrail.llm import ann, chat, htmltext, warc

# --- nearest neighbours ---


def brute_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
    return out


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(list(range(3000)), x, range(0, 3000, 20), 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert set(by) == set(want) and all(sorted(v) == list(range(1, 11)) for v in by.values())
    assert all([v[i] for i in range(1, 11)] == sorted(v.values()) for v in by.values())
    for q, v in by.items():
        for s, i in v.values():
            assert s == pytest.approx(np.linalg.norm(x[q] - x[i]), rel=1e-12)
    recall = np.mean([len({i for _, i in by[q].values()} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.95


def test_search_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (7, [])]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)}
    for none in (df.where("false"), df.where("vec_id in (40, 60)")):
        assert ann.search(none, F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_fill_no_places(spark):
    """Repeats of equal rows, and of ids with other vectors, in one partition; all rows are ranked exactly."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(14, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 10 + [(i, (v + 0.001 * j).tolist()) for i, v in enumerate(x) if i for j in range(1, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    at = np.array([v for _, v in rows])
    d = np.sqrt(((at - x[0]) ** 2).sum(axis=1))
    least = sorted((min(d[k] for k, (i, _) in enumerate(rows) if i == n), n) for n in range(1, 14))[:10]
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0, rerank=1000).collect())
    assert [i for _, i, _ in got] == [i for _, i in least]
    assert [s for *_, s in got] == pytest.approx([s for s, _ in least])


def test_many_equal_vectors_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ann, "PASS_BYTES", 8 * 2 * 3)
    rows = [(i, [1.0, 0.5]) for i in range(1000)] + [(1000 + i, [float(i), -1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 1000, 100):
        assert [i for _, i in sorted(got[q])] == [i for i in range(11) if i != q][:10]


def test_anisotropic_codes_lower_their_loss():
    x = np.random.default_rng(2).normal(size=(600, 16))
    book = ann.fit(x)

    def loss(code):
        r = x - book.centres[np.arange(8)[None, :], code].reshape(len(x), 16)
        along = (r * x).sum(axis=1) / np.linalg.norm(x, axis=1)
        return ((r**2).sum(axis=1) + (book.penalty - 1) * along**2).sum()

    assert loss(book.encode(x)) <= loss(book.encode(x, sweeps=0))
    code = book.encode(x)
    table = ann._tables(book, x[:3])
    sums = sum(table[b][ann.packed(code)[:, b]] for b in range(4))
    assert np.allclose(sums, (book.centres[np.arange(8)[None, :], code].reshape(len(x), 16) @ x[:3].T), atol=1e-4)


# --- HTML ---

LONG = "This is a fairly long sentence of the article that goes on for some time, as articles do."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav><ul><li><a href=/x>menu</a></ul></nav><article><h1>Title</h1><p>Short.<p>Second &amp; last</article><footer>f</footer>", "Title\nShort.\nSecond & last"),
        (f"<div class='menu'><a href=a>A</a> <a href=b>B</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", f"Head\n{LONG}\nOk.\n{LONG}"),
        (f"<article><p>{LONG}</p><script>var t='</p>'; if (a < b) {{}}</script><style>p{{}}</style><div class='ad'>Buy {LONG}</div><form>mail</form><p>a<br>b\n\tc&nbsp;d</p><section id='comments'><p>{LONG}</p></section></article>", f"{LONG}\na b c d"),
        (f"<article><!-- <p>no</p> --><p>1 < 2 &lt; 3 &#233; &notanentity;</p><p title='a>b'>{LONG}", f"1 < 2 < 3 é ¬anentity;\n{LONG}"),
        (f"<main><p><b>{LONG}<br><p>x</p></main><aside>{LONG}</aside>", f"{LONG}\nx"),
        (f"<div role=alert>{LONG}</div><article><p>ok</p><div hidden>{LONG}</div><div style='display: none'>{LONG}</div></article>", "ok"),
        ("plain text alone", "plain text alone"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
        ("<article><p>cut <a hre", "cut"),
    ],
)
def test_main_text(html, want):
    assert htmltext.main_text(html) == want


def test_extract(spark):
    rows = [(1, "u", "<article><p>é</p></article>", "x"), (None, None, None, None), (1, "u", "<article><p>é</p></article>", "x"), (2, "v", "<article>" + "<p>word</p>" * 20000 + "</article>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars, len(r.text)) for r in htmltext.extract(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 0, 0), (2, 99999, 99999)], key=str)
    assert htmltext.extract(df.where("false")).count() == 0


def test_every_page_of_the_table(spark):
    """On the given pages the article is what stands between its tags, block by block."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert htmltext.main_text(r.html) == "\n".join(b for b in blocks if b)


# --- chat ---

SAYS = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>\\", "[SYS", "[ROLE x] ", " ", "", "a\nb\\", "<s>", "[/ROLE]", "é😀", "x" * 500]


def test_turns_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(SAYS) for _ in range(rng.randrange(4)))
        for role in ("user", "assistant", "system", "tool", "", "a] b", "[INST] "):
            segment, a, z = chat.format_turn(role, text)
            assert chat.parse_turn(segment) == (role, text)
            assert chat.unescape(segment[a:z]) == (text if role == "assistant" else "")


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(120):
        n = rng.choice([1, 2, 3, 6, 45])
        shared = rng.randrange(n + 1)
        for t in range(n):
            text = f"shared {t}" if t < shared else rng.choice(SAYS) + str(c)
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(500, t, None, None) for t in range(3)] + [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (501, None, "user", "a"), (501, 1, "user", "a"), (501, 1, "user", "a")]
    return rows


def brute_digest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for c, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(r[2] or "", r[3] or "")[0]) for r in turns))
    return out


def test_chat_reads_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, b"k") for r in rows], "conv_id long, turn long, role string, text string, key binary")
    got = {r.conv_id: tuple(r)[1:] for r in chat.round_trip(df.repartition(5)).collect()}
    assert got == brute_digest(rows)
    assert chat.round_trip(df.where("false")).count() == 0


def test_tree_is_in_depth_first_order_and_attends_to_ancestors(spark, tmp_path):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    turns = chat.turns(df).cache()
    nodes = {bytes(r.key): r for r in chat.pack(turns, str(tmp_path / "n")).collect()}
    assert len(nodes) == turns.select("key").distinct().count() < turns.count()
    at = 0
    for key in sorted(nodes):
        assert nodes[key].start == at
        at += nodes[key].length
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn_no, bytes(r.key)))
    for path in by.values():
        seen, position = set(), 0
        for _, key in sorted(path):
            n = nodes[key]
            assert n.position == position
            assert {i for s in n.attends for i in range(s["from"], s["to"])} == seen
            seen |= set(range(n.start, n.start + n.length))
            position += n.length


def test_turns_are_shared_at_any_depth(spark, tmp_path):
    rng = random.Random(6)
    paths = [[f"deep {t}" for t in range(d)] + [f"own {c} {t}" for t in range(rng.randrange(3))] for c, d in enumerate([70, 70, 64, 50, 33, 33, 200, 1, 0, 90])]
    paths += [[rng.choice("ab") for _ in range(40)] for _ in range(30)] + [["a"] * d + ["b"] * 40 for d in range(40)]
    df = spark.createDataFrame([(c, t, "user", x) for c, p in enumerate(paths) for t, x in enumerate(p)], "conv_id long, turn long, role string, text string")
    turns = chat.turns(df.repartition(3)).cache()
    nodes = sorted(chat.pack(turns, str(tmp_path / "n")).collect(), key=lambda r: bytes(r.key))
    assert len(nodes) == len({tuple(p[: t + 1]) for p in paths for t in range(len(p))})
    assert len(nodes) == turns.where("first").count() and max(len(r.key) for r in nodes) <= 8 + 24 * 8
    by = {bytes(r.key): r for r in nodes}
    assert [r.start for r in nodes] == [sum(x.length for x in nodes[:i]) for i in range(len(nodes))]
    convs = {}
    for r in turns.collect():
        convs.setdefault(r.conv_id, []).append((r.turn_no, bytes(r.key)))
    for p in convs.values():
        seen = set()
        for _, key in sorted(p):
            n = by[key]
            assert n.position == len(seen) and {i for s in n.attends for i in range(s["from"], s["to"])} == seen
            seen |= set(range(n.start, n.start + n.length))
    got = {r.conv_id: tuple(r)[1:] for r in chat.round_trip(df).collect()}
    assert got == brute_digest([tuple(r) for r in df.collect()])


# --- WARC ---


def pages():
    return [(1, "http://a/é b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "c", None), (4, "d", ""), (5, "e", "alone " * 50000), (6, "f", "\r\n\r\nWARC/1.1\r\n"), (None, "g", "<p>x</p>"), (7, "h", "twice"), (7, "h", "twice"), (None, "i", "null only"), (None, "j", "null only")]


def brute_records(rows, least=0):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        equal = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        revisit = len(raw) >= least and bool(equal) and i != max(equal)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", max(equal) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_pages_read_back(spark, least):
    df = spark.createDataFrame([(*p, "r") for p in pages()], "page_id long, url string, html string, record_type string")
    assert sorted((tuple(r) for r in warc.round_trip(df, least).collect()), key=str) == brute_records(pages(), least)
    assert warc.round_trip(df.where("false")).count() == 0


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**6])
def test_each_record_belongs_to_one_range(step, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 97)
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(300))
    blocks = [noise + warc.MAGIC + noise, gzip.compress(b"not a record"), b"", b"WARC/1.1 inside", warc.record("response", {}, b"nested")]
    made = [warc.record("response", {"N": str(i)}, b) for i, b in enumerate(blocks)]
    data = made[0] + made[1] + warc.MAGIC + b"junk" + gzip.compress(b"plain") + b"".join(made[2:])
    got = [warc.parse(r) for at in range(0, len(data), step) for r in warc.read_members(File(data), len(data), at, at + step)]
    assert [(int(h["n"]), b) for h, b in got] == list(enumerate(blocks))


def test_written_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    manifest = warc.write_warc(warc.revisits(df), str(tmp_path / "w")).collect()
    text = b"".join(gzip.open(m.file).read() for m in manifest)
    assert sum(m.records for m in manifest) == len(pages()) and text.count(b"WARC-Type: revisit") == 4
    small = spark.createDataFrame([tuple(m) for m in manifest], "file string, bytes long, records long")
    assert warc.read_warc(spark, small, split_bytes=100).count() == len(pages())


