"""Chat formatting, licences, neighbours, WARC, HTML and the pipeline on small fixtures."""

import base64
import glob
import hashlib
import json
import math
import os
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftline.llm import ann, chat, html_text, licenses, mixing, packing, quality, simhash, warc
from driftline.llm import queries
from driftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

SAID = "</s>[INST] ok [/INST]"


def test_chat_round_trip(spark):
    texts = [None, "", "plain", SAID, "\\", "\\<s>", "<\\s>", "<<s>></s", "a\nb\\\nc", "[[INST]] [/INST", "x" * 20_000, "é😀"]
    rows = [(1, i, ["user", "assistant", "a\nb", None, "<s>"][i % 5], t, i) for i, t in enumerate(texts)] + [(2, 1, "assistant", "second", 0), (2, 0, "user", "first", 0), (2, 1, "assistant", "second", 0), (None, 0, "assistant", None, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.format_rows(df).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].back_turns] == [(r[2] or "", r[3] or "") for r in own]
        assert list(got[conv].loss_texts) == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat.format_rows(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"strange": 1}, {"prompt": None, "response": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, j string").withColumn("record", F.parse_json("j"))
    got = sorted(chat.canonical_turns(df, "record").collect(), key=lambda r: r.id)
    assert [r.layout for r in got] == ["messages", "shared", "prompt", "completion", "instruction", "instruction_input", None, "prompt"]
    for r in got[:6]:
        assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    assert got[6].turns is None and got[7].turns[0].text is None


def test_chat_keeps_records_with_further_fields_and_counts_unknown_ones(spark):
    pair = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "weight": 1}]
    records = [{"messages": []}, {"messages": pair, "id": 1}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 2}, {"instruction": "q", "input": "", "output": "a", "text": "t"}, {"prompt": "q", "response": "a", "turn": 7}]
    odd = [{"strange": 1}, 5, None, {"messages": "text"}, {"messages": [1]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, json.dumps(r)) for r in odd], "conv_id long, j string").withColumn("record", F.parse_json("j"))
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    assert [len(got[i].back_turns) for i in range(5)] == [0, 2, 2, 2, 2] and [got[i].unmapped for i in range(5)] == [0] * 5
    assert all([(t.role, t.text) for t in got[i].back_turns] == [("user", "q"), ("assistant", "a")] for i in range(1, 5))
    assert got[9].unmapped == 5 and len(got[9].back_turns) == 0 and [t.turn for t in got[4].turns] == [7, 8]


def test_chat_query_uses_several_layouts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    some = rows.unionByName(spark.createDataFrame([(i, t, r, f"text {i}") for i in (4000, 4001) for t, r in ((0, "user"), (1, "assistant"))], rows.schema))
    used = chat.canonical_turns(queries.chat_records(some), "record").groupBy("layout").count().collect()
    assert {r.layout for r in used} >= {"messages", "shared", "turn_row", "prompt", "instruction_input"}


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 50)) for i in range(3000)] + [(2, 0, "user", "y" * 10**6)]
    got = {r.conv_id: r for r in chat.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [t.text for t in got[1].back_turns] == [r[3] for r in rows[:3000]] and got[2].back_turns[0].text == rows[-1][3]


@pytest.mark.parametrize("name", ["op3_chat", "op8_warc", "op10_quality"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    said = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(names).collect()), key=repr) == sorted(said.fetchall(), key=repr)


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    long = "word " * 100
    rows = [(1, f"{long}\n{mit}\nmore", "a/b/1"), (2, long, "a/b/c/2"), (3, apache, "a/b/LICENSE"), (4, "nothing", "z/4"), (5, None, "a/5"), (6, "the license of the hall was lost in many other places last year", "a/b/c/d/6"), (7, mit, None), (8, long, None), (9, "Licensed under CC BY-NC 4.0.", "q"), (2, long, "a/b/c/2")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, path string, score double")
    got = sorted((r.doc_id, r.license, r.found) for r in licenses.scan(df, "doc_id", "path").collect())
    want = [(1, "MIT", "header"), (2, "Apache-2.0", "inherited"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "header"), (4, None, "none"), (5, None, "none"), (6, "Apache-2.0", "inherited"), (7, "MIT", "header"), (8, None, "none"), (9, "CC-BY-NC-4.0", "header")]
    assert got == want
    assert licenses.scan(df.limit(0), "doc_id", "path").count() == 0


def test_templates_match_themselves(spark):
    rows = [(i, t, f"d{i}/f") for i, t in enumerate(t for texts in licenses.TEMPLATES.values() for t in texts)]
    names = [n for n, texts in licenses.TEMPLATES.items() for _ in texts]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "doc_id", "path").collect()}
    assert all(got[i].license == n and got[i].score == pytest.approx(1, abs=1e-6) for i, n in enumerate(names))


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_long_license_files_pass_their_license_on(spark):
    long, gpl = "word " * 100, "\n".join(" ".join([t] * int(n)) for n, ts in (g.split(":") for g in licenses.FULL["GPL-2.0"].split(";")) for t in ts.split(" "))
    notice = f"{long}\nLicensed under the Apache License, Version 2.0.\n{long}"
    rows = [(1, "The MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT_TEXT, "m/LICENSE"), (2, long, "m/src/a.py"), (3, gpl, "g/17"), (4, long, "g/a/b"), (5, notice, "n/COPYING.txt"), (6, long, "n/x"), (7, notice, "o/license_check.py"), (8, long, "o/x")]
    got = {r.doc_id: (r.license, r.found) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "doc_id", "path").collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: ("GPL-2.0", "header"), 4: ("GPL-2.0", "inherited"), 5: ("Apache-2.0", "header"), 6: ("Apache-2.0", "inherited"), 7: ("Apache-2.0", "header"), 8: (None, "none")}


def test_wrapped_license_headers(spark):
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at http://mozilla.org/MPL/2.0/."]
    gpl = ["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation; either version {} of the License, or", "(at your option) any later version."]
    head = lambda lines, mark, v="": "\n".join(f"{mark} {x.format(v)}" for x in lines)
    code = "\n\n" + "alpha beta gamma\n" * 200
    rows = [(1, head(mpl, "//") + code, "a/1"), (2, code + head(gpl, " *", 2) + code, "b/2"), (3, head(gpl, "#", 3) + code, "c/3"), (4, head(["alpha beta gamma", *gpl, "alpha beta gamma"], "#", 2), "d/4")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "doc_id", "path").collect()}
    assert got == {1: "MPL-2.0", 2: "GPL-2.0", 3: "GPL-3.0", 4: "GPL-2.0"}


def brute_licenses(rows):
    """(license, rounded score, found) of (id, text, path) rows: every run of lines of every block, whole texts, and a
    walk up the directories, with plain dicts."""
    terms = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (t or "").lower())
    templates = [(name, full, dict(counts)) for name, full, counts in licenses._COUNTED]
    total = len(rows) + len(templates)
    held = lambda t: sum(t in terms(x) for _, x, _ in rows) + sum(t in c for *_, c in templates)
    idf = {t: math.log((1 + total) / (1 + held(t))) + 1 for t in {t for *_, c in templates for t in c}}
    weigh = lambda counts: {t: (1 + math.log(n)) * idf.get(t, math.log(1 + total) + 1) for t, n in counts.items()}
    weighed = [(name, full, weigh(c)) for name, full, c in templates]

    def best(words, whole):
        own = weigh(Counter(words))
        length = math.sqrt(sum(x * x for x in own.values()))
        cosine = lambda w: sum(x * w[t] for t, x in own.items() if t in w) / length / math.sqrt(sum(x * x for x in w.values()))
        return max([(round(cosine(w), 9), name) for name, full, w in weighed if full == whole and own], default=None)

    own = {}
    for i, text, _ in rows:
        lines, blocks, found = [terms(x) for x in (text or "").split("\n")], [[]], []
        for line in lines:
            blocks[-1].append(line) if line else blocks.append([])
        for block in blocks:
            for a in range(len(block)):
                for b in range(a + 1, len(block) + 1):
                    words = [t for line in block[a:b] for t in line]
                    if b == a + 1 or len(words) <= licenses.RUN_WORDS or (a, b) == (0, len(block)):
                        found.append(best(words, False))
        whole = best(terms(text), True)
        top = max([x for x in [*found, whole] if x and x[0] >= licenses.LEAST_COSINE], default=None)
        own[i] = top and (*top, whole is not None and whole[0] >= licenses.LEAST_COSINE and top[1] == whole[1])
    folders = {}
    for i, text, path in rows:
        named = path and re.search(licenses.FILE_NAME, path) and not re.search(licenses.CODE_NAME, path)
        if own[i] and path and "/" in path and (own[i][2] or named or len((text or "").split()) <= licenses.FILE_WORDS):
            folder = path.rsplit("/", 1)[0]
            folders[folder] = max(folders.get(folder, (0, "")), own[i][:2])
    out = []
    for i, _, path in rows:
        if own[i]:
            out.append((i, own[i][1], round(own[i][0], 6), "header"))
            continue
        parts = (path or "").split("/")
        above = next((folders[p] for n in range(len(parts) - 1, 0, -1) if (p := "/".join(parts[:n])) in folders), None)
        out.append((i, above and above[1], above and round(above[0], 6), "inherited" if above else "none"))
    return out


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(11)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(["alpha", "beta", "the", "software", "license", "of", "x1"], rng.integers(1, 9))) for _ in range(rng.integers(0, 12))]
        if rng.random() < 0.5:
            said = str(rng.choice(notices)).split(" ")
            cut = int(rng.integers(1, len(said) + 1))
            lines[len(lines) // 2 : len(lines) // 2] = [*rng.choice(["", "gamma delta"], 1).tolist(), " ".join(said[:cut]), *([" ".join(said[cut:])] if cut < len(said) else []), ""]
        path = "/".join(rng.choice(["a", "b", "c"], rng.integers(0, 4)).tolist() + [str(rng.choice(["LICENSE", f"f{i}.py", "notes", "COPYING.txt"]))])
        rows.append((i, "\n".join(lines), path))
    rows += [(60, MIT_TEXT, "a/LICENSE"), (61, MIT_TEXT, "a/b/LICENSE"), (62, None, "a/b/c/x"), (63, "alpha", None), (64, "beta " * 60_000, "c/long"), (65, notices[0], "tie/1"), (66, notices[0], "tie/2"), (67, "", "tie/3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    got = sorted((r.doc_id, r.license, r.score, r.found) for r in licenses.scan(df, "doc_id", "path").collect())
    want = brute_licenses(rows)
    assert [x[::3] for x in got] == [x[::3] for x in want] and [x[1] for x in got] == [x[1] for x in want]
    assert all(a[2] == b[2] or a[2] == pytest.approx(b[2], abs=2e-6) for a, b in zip(got, want, strict=True)) and {x[3] for x in got} == {"header", "inherited", "none"}


def test_license_candidates_hold_every_match():
    scorer = licenses.Scorer({"the": 900, "of": 800, "license": 20}, 1000)
    rng = np.random.default_rng(1)
    every = np.arange(len(scorer.names))
    for _ in range(300):
        name, _, counts = licenses._COUNTED[rng.integers(len(licenses._COUNTED))]
        terms = [t for t in counts if rng.random() < 0.6] + [f"w{i}" for i in range(rng.integers(4))]
        if terms:
            found = scorer.cosines(terms, np.ones((1, len(terms))), every)[0]
            assert not (found >= licenses.LEAST_COSINE)[~scorer.possible(set(terms))].any()


def brute_nearest(rows, every, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i, tuple(v)] = None
    out = {}
    for q, v in fine:
        if q % every == 0:
            score = {}
            for i, u in fine:
                if i != q and len(u) == len(v):
                    score[i] = max(score.get(i, -math.inf), float(np.dot(u, v)))
            for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1):
                out[q, n] = (i, score[i])
    return out


def test_nearest_small_and_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 160)] + [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] + [0.0] * 5), (3005, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (5000, [1.0, 2.0]), (5001, [2.0, 1.0]), rows[20], rows[21]]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, 20, 20).collect()}
    want = brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    same = sum(got[x][0] == want[x][0] for x in want)
    assert same >= 0.97 * len(want) and all(got[x][1] <= want[x][1] + 1e-9 for x in want)
    assert {x: v for x, v in got.items() if x[0] == 5000} == {(5000, 1): (5001, 4.0)}
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_extreme_lengths(spark):
    v = np.random.default_rng(3).normal(size=(100, 8))
    want = {q: np.lexsort((np.arange(100), -np.where(np.arange(100) == q, -np.inf, v @ v[q])))[:20].tolist() for q in range(0, 100, 20)}
    for scale in (1e120, 1e-120):
        df = spark.createDataFrame([(i, (x * scale).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 97


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, size=(3000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype(np.float32).astype(float)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & got[q].keys())
        assert all(s[i] == pytest.approx(x, abs=1e-12) for i, x in got[q].items())
    assert hit >= 0.9 * 20 * 150


def test_nearest_with_a_few_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_SHARDS", 1)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(20_000, 32))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    v[[11, 222, 3333]] *= [[1e4], [1e6], [1e9]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, 500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 20_000, 500):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hit >= 0.9 * 20 * 40


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/%\r\n", "same"), (1, "u1", "same"), (2, None, "é" * 9000), (4, "u4", None), (5, "u5", ""), (None, "u6", "same"), (None, "u7", "alone"), (1, "u8", "same"), (9, "u9", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(index, payloads=True).collect()
    assert len(got) == len(rows) and index.count() == len(rows)
    for r in got:
        body = next((h or "").encode() for i, u, h in rows if i == r.page_id and (u or "") == r.url)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        least = min((i for i, _, h in rows if (h or "").encode() == body and i is not None), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == least else ("revisit", least))
        assert r.payload == (body if r.record_type == "response" else None)
    some = warc.read_archives(index.filter("page_id = 2"), payloads=True).collect()
    assert [r.page_id for r in some] == [2]
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_of_long_texts_and_clashing_names(spark, tmp_path):
    rows = [(1, "u", "é" * 3_000_000, "x", 1, "f"), (2, "u", "é" * 3_000_000, None, 2, "g"), (3, "u", "é" * 2_999_999 + "e", "x", 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, offset int, file string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, str(tmp_path / "w")), payloads=True).collect()}
    assert [got[i].record_type for i in (1, 2, 3)] == ["response", "revisit", "response"] and got[1].payload.decode() == rows[0][2] and got[2].refers_to == 1 and got[3].payload.decode() == rows[2][2]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a href="x"">text</a><a href="y">more</a><p>rest of page</p>', "textmore\n\nrest of page"), ("<a title=Bob's>text</a><p>rest of page</p>", "text\n\nrest of page"), ('<a "b>x</a>y <p style="display:none">n</p>', "xy"), ("<a title=\"a>b\" href = 'c>d'>x</a>", "x"),
        ("<p class=it's>Hello</p><p>Don't stop</p><p>tail</p>", "Hello\n\nDon't stop\n\ntail"), ('<img alt="5" tall"><p>lost text here</p><a href="x">link</a>', "5\n\nlost text here\n\nlink"),
        ("<head><title>T</title><span>Hi<p>text", "Hi\n\ntext"), ("<head><title>T</title>Hi<p>text", "Hi\n\ntext"), ("<head> <meta x><style>s</style></head>Hi", "Hi"),
    ],
)
def test_stray_quotes_and_open_heads_hide_nothing(page, want):
    assert html_text.render(page) == want


def test_html_rendering():
    page = """<!DOCTYPE html><title>t</title><style>x</style><h1>Head</h1><p>one<p>two <b>bold</b>  text<br>next
    <ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><script>var t="</p>";</script><p hidden>no</p><div style="display: none">no</div>
    <table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>22</table><pre>  keep
   this</pre>&lt;tag&gt; &amp; caf&eacute;<!-- gone --> end</div></section>"""
    want = "Head\n\none\n\ntwo bold text\nnext\n\n* a\n* b\n  3. c\n  4. d\n\nName   N\napple  1\nfig    22\n\n  keep\n   this\n\n<tag> & café end"
    assert html_text.render(page) == want
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("<div>" * 5000 + "deep") == "deep"
    assert html_text.render("a < b <3 <unclosed") == "a < b <3"
    assert html_text.render("x" * 10**6) == "x" * 10**6
    nested = html_text.render("<table><tr><td>cell" * 2000).split()
    assert nested == ["cell"] * 2000


def written(rng, depth, inline=False):
    """A random tree as (html, visible words): tags are left open where the standard implies their end."""
    out, said = [], []
    for _ in range(int(rng.integers(1, 5))):
        word = f"w{rng.integers(1000)}"
        kind = rng.choice(["text", "inline", "hidden", "void"] if inline or depth == 0 else ["text", "inline", "hidden", "void", "block", "list", "table", "p"])
        if kind == "text":
            out.append(f" {word} &amp; ")
            said += [word, "&"]
        elif kind == "inline":
            tag = rng.choice(["b", "i", "span", "a", "em"])
            inner, words = written(rng, 0, True)
            out.append(f"<{tag} title='x > y' data-k=\"<p>\">{inner}</{tag}>")
            said += words
        elif kind == "hidden":
            out.append(str(rng.choice(["<script>if (a < b) x = '<p>no</p>'</script>", "<style>p > b {}</style>", "<span hidden>no</span>", "<!-- no <p> -->", "<div style='display: none'>no<p>no</div>" if not inline else "<i aria-hidden=true>no</i>"])))
        elif kind == "void":
            out.append(str(rng.choice(["<br>", "<img alt=''>", "<wbr>", "<input value=no>"])))
        elif kind == "p":
            inner, words = written(rng, 0, True)
            out.append(f"<p>{inner}" + str(rng.choice(["</p>", "<p>"])))
            said += words
        elif kind == "list":
            out.append("<ul>")
            for _ in range(int(rng.integers(1, 4))):
                inner, words = written(rng, depth - 1)
                out.append(f"<li>{inner}" + str(rng.choice(["</li>", ""])))
                said += ["*", *words]
            out.append("</ul>")
        elif kind == "table":
            out.append("<table>")
            for _ in range(int(rng.integers(1, 4))):
                out.append("<tr>")
                for _ in range(int(rng.integers(1, 4))):
                    inner, words = written(rng, 0, True)
                    out.append(f"<td>{inner}" + str(rng.choice(["</td>", ""])))
                    said += words
            out.append("</table>")
        else:
            inner, words = written(rng, depth - 1)
            out.append(f"<div>{inner}</div>")
            said += words
    return "".join(out), said


def test_html_words_of_random_pages():
    """Every visible word comes out once and in order, and nothing else but list marks."""
    rng = np.random.default_rng(12)
    for _ in range(400):
        page, said = written(rng, 3)
        got = [w for w in html_text.render(page).split() if w != "*"]
        assert got == [w for w in said if w != "*"], page


def test_html_in_linear_time():
    for page in ("<div>" * 30_000 + "</p>" * 30_000, "<p><button>" + "<b>" * 30_000 + "</p>" * 30_000, "<table>" + "<tr><td rowspan=99999 colspan=99999>a" * 3000, "<table><tr><td>" + "a" * 300_000 + "<td>x" + "<tr><td>a<td>b" * 5000):
        start = time.perf_counter()
        assert len(html_text.render(page)) < 2 * len(page)
        assert time.perf_counter() - start < 20


def test_html_spans():
    page = "<table><tr><th colspan=2>Head of two<th>x<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td colspan=2>g</table>"
    assert html_text.render(page) == "Head of two  x\na  b         c\n   d         e\nf  g"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "t"), (None, None, "t"), (1, "<p>a</p><p>b</p>", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=repr) == [(1, "a\n\nb", 3), (1, "a\n\nb", 3), (None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_pipeline_against_stages(spark):
    import corpus_pipeline

    rows = []
    for i in range(120):
        rows.append((i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(20 + i)), "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], "en", "s1", 0) for i in range(30)] + [(300 + i, "too short", "en", "s2", 0) for i in range(5)] + [(400, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = [r for r in rows if len((r[1] or "").split()) >= 10]
    stage = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(r[0] for r in good) and stage.columns == docs.columns
    one = corpus_pipeline.near_dedup(spark, stage, "")
    kept = {r.doc_id for r in one.collect()}
    assert kept <= set(range(120)) and len(kept) >= 100 and one.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, one, "")
    total = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(total - 1.5 * sum(len(r[1].split()) for r in rows if r[0] in kept)) <= 4 and mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """run() over a table against plain versions of its stages: rules, pairs of fingerprints, sources' words, tokens."""
    import corpus_pipeline
    from test_text_operators import brute_components, brute_print, brute_quality, brute_targets, words
    from tokenizers import Tokenizer

    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(12, 200))) for _ in range(60)] + [None, "", "short text", "again and " * 40]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)] + [(100 + i, texts[i].upper(), "en", "s1", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    good = [r for r in rows if not brute_quality(r[1])[-1]]
    prints = [brute_print(r[1]) for r in good]
    kept = [r for r, c in zip(good, brute_components([r[0] for r in good], prints), strict=True) if r[0] == c]
    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    assert {r.doc_id for r in got} <= {r[0] for r in kept} and len(kept) == 60
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    per_word = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) / len(words(r[1])) for r in kept}
    source = {r[0]: r[3] for r in kept}
    taken, ends = Counter(), 0
    for r in got:
        last = r.start + r.length == r.doc_tokens  # the end token of a part
        ends += last
        taken[source[r.doc_id]] += (r.length - last) / per_word[r.doc_id]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 3 for s in sizes) and ends >= len(kept) / 2
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), "").count() == 0
    odd = docs.withColumn("h1", F.lit(1)).withColumn("parts", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, odd.limit(0), "").columns == odd.columns
        odd = stage(spark, odd, "")
        assert odd.columns[-2:] == ["h1", "parts"] and odd.count()


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert all(m is not None for m in (ann, chat, html_text, licenses, mixing, packing, quality, simhash, warc))
