"""Licences, token counts, mixing, toxicity, web responses and pages."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections import Counter
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclust.llm import html_extract, license_scan, mixing, token_counts, toxicity, warc

from ..conftest import SF


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "words and words\nand words"), (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d/y.py", None), (5, "a/z.py", "Some words that stand before it, and more and more of them so that they outnumber it. This work is licensed under the GNU General Public License, version 3.\nMore of the words that follow here."),
        (6, "top.py", ""), (7, None, "x " * 100_000), (8, "a/b/c/COPYING2", "Licensed under CC BY-NC 4.0."), (2, "a/b/x.py", "words and words\nand words"), (9, "ab/x.py", "no licence of its own"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("dir", F.lit("clash")).withColumn("ancestor", F.lit(1))
    got = {r["id"]: (r["licence"], r["via"], r["from_dir"]) for r in license_scan.licences(df).collect()}
    assert got == {
        1: ("MIT", "licence file", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "licence file", None), 4: ("Apache-2.0", "inherited", "a/b/c"), 5: ("GPL-3.0", "header", None),
        6: (None, "none", None), 7: (None, "none", None), 8: ("CC-BY-NC-4.0", "licence file", None), 9: (None, "none", None),
    }
    assert license_scan.licences(df).count() == len(rows)
    assert license_scan.licences(df.where("id < 0")).count() == 0


MIT_TEXT = "MIT License\n\nCopyright (c) 2021 A. Person\n\n" + license_scan.WHOLE[0][1].removeprefix("MIT License Copyright (c) ").replace(". ", ".\n\n")
GPL_3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
HEADERS = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "Licensed under the GNU Lesser GPL, version 2.1.": "LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Licensed under CC BY 3.0.": "CC-BY-3.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under the Apache License.": "Apache-2.0",
    "Licensed under the MPL, version 2.0.": "MPL-2.0", "SPDX: LGPL-2.1-or-later": "LGPL-2.1", "License: MIT": "MIT", "The MIT License (MIT)": "MIT", "GPL v2": "GPL-2.0", "Released under the BSD 2-Clause License.": "BSD-2-Clause", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    GPL_3: "GPL-3.0", GPL_3.replace("\n", "\n * "): "GPL-3.0", GPL_3.replace("General", "Affero General"): "AGPL-3.0", "Licensed under the Foobar License, version 9.": "unknown", "Licensed under the Mozilla Public License, version 1.1.": "unknown", "mit der und die mit": None,
}


def test_headers_name_their_licence_and_version(spark):
    prose = "some prose of a file that has nothing to do with it and goes on for a while"
    filler = [(1000 + i, f"z/{i}", prose + f" number{i} the license of under software general public this is") for i in range(60)]
    df = spark.createDataFrame([(i, f"a{i}/f.c", f"{prose}\n\n{h}\n\n{prose}") for i, h in enumerate(HEADERS)] + filler, "id long, path string, text string")
    got = {r["id"]: r["licence"] for r in license_scan.licences(df).collect()}
    assert {h: got[i] for i, h in enumerate(HEADERS)} == HEADERS


def test_only_licence_files_speak_for_their_directory(spark):
    rows = [(i, f"d{i}/{name}", text) for i, (name, text) in enumerate([
        ("x.txt", MIT_TEXT), ("README", "Licensed under CC BY 4.0."), ("LICENSE.md", "Licensed under CC BY 4.0."), ("x.txt", license_scan.WHOLE[1][1]), ("x.txt", license_scan.WHOLE[2][1]), ("x.txt", license_scan.WHOLE[3][1]), ("COPYING", GPL_3), ("licensed.py", "License: MIT"),
    ])]
    files = rows + [(100 + i, f"d{i}/sub/y.py", "words of a file") for i in range(len(rows))]
    got = {r["id"]: r["licence"] for r in license_scan.licences(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert [got[100 + i] for i in range(len(rows))] == ["MIT", None, "CC-BY-4.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-3.0", None]


def test_length_histogram_answers_every_limit(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "tokens", "x1y2"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "", "long " * 30_000]
    encoder = token_counts._encoder("byte_bpe_50k.tiktoken")
    lengths = sorted(len(encoder.encode_ordinary(t or "")) for t in texts)
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int"))).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(x <= n for x in lengths))
        assert r["tokens_cut_here"] == sum(min(x, n) for x in lengths) and r["all_docs"] == len(lengths) and r["all_tokens"] == sum(lengths)
    for limit in (0, 5, 1000, 10**6):
        assert token_counts.truncated_total(sums, limit).first()["tokens"] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    none = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([], "text string")))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first()[0] == 0


def reference_rates(a, target, steps=4000):
    """Plain projected gradient descent in the same metric, for long."""
    inverse, r = np.linalg.inv(a @ a.T + 1e-9 * np.trace(a @ a.T) / len(a) * np.eye(len(a))), np.ones(a.shape[1])
    for _ in range(steps):
        r = np.maximum(0, r - a.T @ (inverse @ (a @ r - target)))
    return r


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 60)
    n = rng.integers(0, 200, 60)
    rows = [(i, i, int(n[i]), p[i].tolist()) for i in range(60)]
    soft = spark.createDataFrame(rows, "doc_id long, row long, n long, p array<double>")
    got = {r["doc_id"]: r["rate"] for r in mixing.rates(soft, [0.6, 0.3, 0.1]).collect()}
    rate, a = np.array([got[i] for i in range(60)]), (p * n[:, None]).T
    target = np.array([0.6, 0.3, 0.1]) * n.sum()
    assert (rate >= 0).all() and np.abs(a @ rate - target).max() <= 1e-3 * target.max()
    assert np.abs(a @ reference_rates(a, target) - target).max() <= 1e-3 * target.max()
    assert all(got[i] == 1 for i in range(60) if n[i] == 0)


def test_mixing_tables(spark):
    rng = random.Random(2)
    good, bad = [f"fine{k}" for k in range(30)], [f"junk{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=50))) for i in range(90)] + [(200, None), (201, ""), (202, "fine1 " * 60_000), (3, rows_text := "fine1 junk2"), (3, rows_text)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, word string, rate double")
    labelled = spark.createDataFrame([(i, "high" if i % 3 else "low") for i in range(0, 60)] + [(None, "high")], "doc_id long, domain string")
    out = mixing.mix(docs, labelled, {"high": 0.8, "low": 0.2}).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 3}
    assert all((by[i]["p_high"] > 0.5) == bool(i % 3) for i in range(60, 90))
    assert by[200]["n_tokens"] == by[201]["n_tokens"] == 0 and by[200]["rate"] == 1.0
    tokens = sum(r["n_tokens"] for r in out)
    assert sum(r["rate"] * r["n_tokens"] * r["p_high"] for r in out) == pytest.approx(0.8 * tokens, rel=1e-3)
    assert mixing.mix(docs.where("doc_id < 0"), labelled, {"high": 0.8, "low": 0.2}).count() == 0
    again = mixing.mix(docs, labelled, {"high": 0.8, "low": 0.2})
    plan = again._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = ["idiot", "moron", "worthless", "scum", "clowns", "aaaaa", "ababab"]
    scorer = toxicity.Scorer(terms, [])
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "o", "x", "b"])
        w = "".join(w)
        best = min([levenshtein(w, t) for t in terms if len(t) >= toxicity.SHORT or w == t], default=9)
        assert scorer.trie.nearest(w) == (best if best <= 1 else None)
        assert scorer.distance(w) == scorer.trie.nearest(w)  # the filter by halves loses nothing


def test_quotes_and_misspellings_change_the_score(spark):
    rows = []
    rng = random.Random(4)
    for i in range(400):
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        if i % 4 == 0:
            w[5] = rng.choice(["idiot", "moron", "worthless"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert {"idiot", "moron", "worthless"} <= set(model["words"])
    texts = ["you are an idiot and a moron", "you are an id1ot and a mroon idiott", 'he said "idiot" in a report', "some clean words here", "", None, "clean " * 50_000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    s = [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert s[0] > s[1] > s[3] and s[0] > s[2] and s[3] == s[4] == s[5] == s[6] < 0.5 < s[0]
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0
    empty = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(docs, empty).collect())


def test_held_out_accuracy(spark):
    from duoclust.llm.queries import op7_toxicity

    sf = "/root/testdata/sf0.1"
    got = op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, toxic, found, wrong = got.selectExpr("avg(int(predicted = toxic))", "sum(toxic)", "sum(toxic * predicted)", "sum((1 - toxic) * predicted)").first()
    assert right > 0.97 and found > 0.8 * toxic and wrong < 0.02 * toxic + 5


def test_web_derivatives(spark):
    html = "<html><head><title>A &amp; B</title><script>var x='</p>'</script></head><body><p>One\n two</p><a href='/x'>link</a><!-- no --></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a", html, 5), (2, None, None, 5), (3, "u", "", 5), (None, "v", "<p>x" * 30_000, 5), (1, "http://h/a", html, 5)], "page_id long, url string, html string, record_id int")
    rows = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 10
    of = {(r["page_id"], r["record_type"]): r for r in rows}
    text, meta = of[1, "conversion"], of[1, "metadata"]
    assert text["block"] == "A & B\nOne two\nlink" or text["block"].split("\n") == ["A & B", "One", "two", "link"]
    assert text["refers_to"] == meta["refers_to"] != text["record_id"] != meta["record_id"]
    said = json.loads(meta["block"])
    assert said["title"] == "A & B" and said["links"] == [{"path": "a@href", "url": "/x"}]
    payload = "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert text["payload_digest"] == meta["payload_digest"] == said["payload_digest"] == payload
    for r in rows:
        data = r["block"].encode()
        assert r["content_length"] == len(data) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert of[2, "conversion"]["content_length"] == 0
    assert warc.derive(warc.responses_of_pages(pages.where("page_id < 0"))).count() == 0


def test_records_are_whole_on_disk(spark, tmp_path):
    rows = warc.derive(warc.responses_of_pages(spark.createDataFrame([(1, "http://h/a", "<p>Größe\n\nx")], "page_id long, url string, html string")))
    warc.write(rows, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert fields["WARC-Block-Digest"] == warc.digest(rest[:n]) and rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == 2


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_main_text_of_articles(spark):
    rows = []
    for i in range(12):
        extra = "<div class='notice'>We use cookies</div>" if i % 3 == 0 else ""
        rows.append((i, f"http://h.example/{i}", page(
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy {i}</div>{extra}<article><h1>Title {i}</h1><p>First &eacute; <b>bold</b>\n {i}<br>line<p>Second {i}"
            f"<script>x</script><div class='comments'><p>A reader says {i}</p></div></article><aside>Side</aside><form><p>Mail?</p></form><footer>&copy; h {i}</footer>")))  # fmt: skip
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i}\n\nFirst é bold {i} line\n\nSecond {i}"
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == rows[i][1]


def test_main_text_without_article_elements(spark):
    rows = [(i, f"http://g.example/{i}", page(f"<div class='top'><a href=/>Home</a> <a href=/b>B</a></div><div id='wrap'><h2>Head {i}</h2><p>Body of page {i} with quite some words.</p><p>Always the same line</p></div><div class='foot'><p>All rights</p></div>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"Head {i}\n\nBody of page {i} with quite some words.") and "rights" not in got[i] and "Home" not in got[i] for i in range(8))


def test_pages_at_the_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "http://x/", "just text &lt;3  and\n more"), (4, "http://x/", page("<nav>only</nav>")), (5, "http://y/", page("<article>" + "<p>w" * 20_000)), (5, "http://y/", page("<article>" + "<p>w" * 20_000)), (None, "http://z", "<article>z")]
    df = spark.createDataFrame([(*r, "c", ["d"]) for r in rows], "page_id long, url string, html string, host string, main array<string>")
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[4]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"] == "just text <3 and more" and by[5]["text"].count("w") == 20_000 and by[None]["text"] == "z"
    assert html_extract.main_text(df.where("page_id < 0")).count() == 0


def test_expressions_fold_and_align():
    a = html_extract.fold(["n", "p", "p", "p", "f"])
    assert a == [(("n",), False, False), (("p",), True, False), (("f",), False, False)]
    b = html_extract.fold(["n", "x", "p", "f"])
    assert html_extract.align(a, b) == [(("n",), False, False), (("x",), False, True), (("p",), True, False), (("f",), False, False)]
    assert html_extract.fold(["h", "p", "h", "p"]) == [(("h", "p"), True, False)]
    assert html_extract.read_items(html_extract.write_items(a)) == a


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    from duoclust.llm.common import table

    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns, name
        docs = kept.cache()
        assert 0.6 * n < docs.count() <= n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("rate < 0 or rate is null").count() == 0


def records_of(data: bytes):
    """A plain reader of a file of records: (fields, block) of each."""
    at = 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        at += len(head) + 4 + n + 4


def test_records_keep_what_the_response_says(spark, tmp_path):
    """Two responses of one url with ids of their own, one without, and line ends where none may stand."""
    schema = "page_id long, record_id string, target_uri string, warc_date string, headers map<string,string>, payload string, url string, block string"
    rows = [
        (1, "<urn:uuid:a>", "http://h/x", "2020-01-01T00:00:00Z", {"Server": "one", "X Y": "b\r\nWARC-Type: fake"}, "<p>first", "u", "b"),
        (1, "<urn:uuid:b>", "http://h/x", "2020-01-02T00:00:00Z", {"Server": "two"}, "<p>second", "u", "b"),
        (1, None, "http://h/\nx", None, None, "<p>third", "u", "b"),
        (1, "", "http://h/\nx", None, None, None, None, None),
    ]
    got = warc.derive(spark.createDataFrame(rows, schema))
    assert len({r["record_id"] for r in got.collect()}) == 8 and len({r["refers_to"] for r in got.collect()}) == 4
    warc.write(got.coalesce(1), str(tmp_path / "out"))
    found = [x for f in (tmp_path / "out").glob("part-*") for x in records_of(f.read_bytes())]
    assert len(found) == 8 and {f["WARC-Type"] for f, _ in found} == {"metadata", "conversion"}
    by_source = {(f["WARC-Refers-To"], f["WARC-Type"]): (f, b) for f, b in found}
    fields, block = by_source["<urn:uuid:a>", "conversion"]
    assert block == b"first" and fields["WARC-Date"] == rows[0][3] and fields["X-Source-Server"] == "one" and fields["X-Source-X-Y"] == "b%0D%0AWARC-Type: fake"
    assert fields["WARC-Payload-Digest"] == warc.digest(b"<p>first") and fields["WARC-Block-Digest"] == warc.digest(b"first")
    assert by_source["<urn:uuid:b>", "conversion"][1] == b"second" and json.loads(by_source["<urn:uuid:b>", "metadata"][1])["headers"] == {"Server": "two"}
    assert sum(f["WARC-Target-URI"] == "http://h/%0Ax" for f, _ in found) == 4


def plain_cosine(texts, piece, template):
    """TF-IDF cosine with the weights of the corpus, by its definition."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    n, sets = len(texts), [set(split(t)) for t in texts]
    weight = lambda w: math.log((1 + n) / (1 + sum(w in s for s in sets))) + 1
    a, b = ({w: c * weight(w) for w, c in Counter(split(t)).items()} for t in (piece, template))
    return sum(x * b.get(w, 0.0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


@pytest.mark.parametrize("size", [40, 400])
def test_licences_by_the_weights_of_the_corpus(spark, size):
    """Common words weigh little at every size of the corpus; licences without a template block inheritance."""
    said = {
        "a/1": "The project is licensed under the Apache License, Version 2.0.", "a/2": "This file is released under the terms of the MIT license by Jane Doe.", "a/3": "Licensed under the Frobnication Licence 7.",
        "a/4": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "a/5": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "a/6": "// SPDX-License-Identifier: ISC\nint x;", "a/LICENSE": "Licensed under the EPL 2.0.", "a/7": "nothing to see", "a/8": "We released the ship under way.",
    }
    rows = [(k, p, t) for k, (p, t) in enumerate(said.items())] + [(100 + k, f"b/{k}", "the project is here" if k % 3 else f"w{k} and more") for k in range(size)]
    got = {r["path"]: r for r in license_scan.licences(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {p: got[p]["licence"] for p in said} == {"a/1": "Apache-2.0", "a/2": "MIT", "a/3": "unknown", "a/4": "BSD-2-Clause", "a/5": "BSD-3-Clause", "a/6": "ISC", "a/LICENSE": "EPL-2.0", "a/7": got["a/7"]["licence"], "a/8": got["a/8"]["licence"]}
    assert got["a/7"]["via"] == got["a/8"]["via"] == "inherited" and got["a/3"]["via"] == "header" and got["b/1"]["licence"] is None
    texts = [t for _, _, t in rows]
    assert got["a/1"]["cosine"] == pytest.approx(max(plain_cosine(texts, said["a/1"], t) for _, t in license_scan.TEMPLATES), abs=2e-6)
    assert got["a/2"]["cosine"] == pytest.approx(max(plain_cosine(texts, said["a/2"][: -len(" Jane Doe.")], t) for _, t in license_scan.TEMPLATES), abs=2e-6)
