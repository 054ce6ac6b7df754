"""Urls, decontamination and licences: twins on the given tables, odd rows, plain versions."""

import random

import pytest
import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, licenses, registry, url_filter, url_queries
from tools.check import compare, connect

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sf_dir, name):
    verdict, _ = compare(spark, connect(sf_dir), sf_dir, registry.queries()[name], ORACLES[name])
    assert verdict == "ok", verdict


def test_url_parts(spark):
    rows = [
        (1, "http://WWW.Example.com/en/a?x#y"), (2, "https://a.net/es/"), (3, "https://b.net?q=/fr/"), (4, None), (5, "no scheme/x"),
        (6, "://h#f"), (7, ""), (8, "http://x.example.com/en/"), (9, "http://notexample.com/en/"), (10, "a://b.c/d://e/f"),
        (11, "http://example.com:80/en/"), (None, "http://É.NET/fr/é"), (8, "http://x.example.com/en/"),
    ]
    df = spark.createDataFrame([(k, u, None, "n") for k, u in rows], "page_id long, url string, bad boolean, n string")
    got = sorted(
        (str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_queries.RULES).collect()
    )
    assert got == sorted([
        ("1", "www.example.com", "/en/a", "www.example.com/en/", "allow"), ("2", "a.net", "/es/", "net/es/", "block"),
        ("3", "b.net", "", None, "allow"), ("4", "", "", None, "allow"), ("5", "", "", None, "allow"), ("6", "h", "", None, "allow"),
        ("7", "", "", None, "allow"), ("8", "x.example.com", "/en/", "example.com/en/", "block"),
        ("8", "x.example.com", "/en/", "example.com/en/", "block"), ("9", "notexample.com", "/en/", "com/", "allow"),
        ("10", "b.c", "/d://e/f", None, "allow"), ("11", "example.com:80", "/en/", None, "allow"),
        ("None", "É.net", "/fr/é", "net/fr/", "block"),
    ])
    assert url_filter.judge(df.limit(0), url_queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    """Many bad pages block a host, a few do not, and a host without labels follows its domain."""
    rows = [("bad.x.org", True)] * 60 + [("bad.x.org", False)] * 2 + [("few.y.org", True)] * 2
    rows += [(f"h{i}.y.org", j % 10 == 0) for i in range(20) for j in range(20)]
    rows += [(f"s{i}.z.org", True) for i in range(80)] + [("new.z.org", None), ("new.y.org", None)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.x.org"].doubt < url_filter.TAIL < got["few.y.org"].doubt
    assert got["new.z.org"].n == 0 and got["new.z.org"].bad_rate > 0.5 > got["new.y.org"].bad_rate
    assert got["few.y.org"].bad_rate < 1


def test_domain_parts(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.example.co.uk": ("example.co.uk", "co.uk"), "com": ("com", "com"),
             "": ("", ""), "h.org:81": ("h.org", "org"), "co.uk": ("co.uk", "co.uk"),
             "192.168.1.1": ("192.168.1.1", "#ip"), "10.20.1.1:80": ("10.20.1.1", "#ip"), "[::1]:80": ("[::1]", "#ip"),
             "me:x@www.h.org.": ("h.org", "org"), "a.b.github.io": ("github.io", "io")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = df.select("host", *url_filter.domain_parts(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts
    listed = df.select("host", *url_filter.domain_parts(F.col("host"), ("io", "github.io"))).collect()
    assert {r[0]: (r[1], r[2]) for r in listed} == hosts | {"a.b.github.io": ("b.github.io", "github.io")}


def test_bound_is_the_quantile_of_the_posterior(spark):
    """Against closed forms (a or b is one) and sums over a fine grid of angles."""
    pairs = [(a, 1.0) for a in (0.02, 0.5, 3.0, 900.0)] + [(1.0, b) for b in (0.02, 7.0, 40.0)]
    want = [0.5**a for a, b in pairs if b == 1] + [1 - 0.5**b for a, b in pairs if a == 1]
    for a, b in ((2.5, 0.5), (3.3, 0.7), (0.5, 2.5), (60.0, 41.0), (5200.0, 5000.0), (30.0, 900.0)):
        angle = (np.arange(1 << 20) + 0.5) / (1 << 20) * np.pi / 2
        dense = (2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle))
        dense = np.exp(dense - dense.max())
        pairs.append((a, b))
        want.append(dense[: 1 << 19].sum() / dense.sum())
    df = spark.createDataFrame(pairs, "a double, b double").coalesce(1)
    got = [r[0] for r in df.select(url_filter.beta_below(F.col("a"), F.col("b"), 0.5)).collect()]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-9)
    assert got[7] > url_filter.TAIL  # two bad labels of two, a weak even prior: no block


def test_overlaps_tolerate_changed_tokens(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([12, 20, 40])))) for i in range(40)]
    docs, planted = [], set()
    for d in range(200):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if d % 4 == 0:
            i, item = rng.choice(items)
            leak = item.upper().split()
            for _ in range(len(leak) // 10):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
            planted.add((d, i))
        docs.append((d, " ".join(text), d))
    docs += [(500, None, 0), (501, "", 0), (None, items[3][1], 0), (0, docs[0][1], 0), (502, "w1 " * 5000, 0)]
    items += [(900, None), (901, ""), (902, "w1 w2"), (3, items[3][1]), (None, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    test = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.overlaps(df, test).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found) == len(rows)
    own = {p for p in found if p[1] is not None}
    assert own - planted == {(None, 3)} and len(planted - own) <= 0.02 * len(planted)
    kept = decontaminate.decontaminate(df, test)
    assert kept.columns == df.columns
    leaks = {d for d, _ in found}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, *_ in docs if d not in leaks)
    assert decontaminate.overlaps(df.limit(0), test).count() == 0
    assert decontaminate.overlaps(df, test.limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    monkeypatch.setattr("corpusloom.operators.joins.SMALL_ROWS", 0)
    assert sorted(map(tuple, decontaminate.overlaps(docs, items).collect())) == want and want


def test_licences(spark):
    mit = [s for s, n in licenses.SENTENCES.items() if n in ("mit-grant", "mit-notice")]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore"), (2, "MIT License\n\nCopyright (c) 2020 X\n\n" + "\n".join(mit)),
        (3, "MIT License. " + "Noise here. " * 9 + " ".join(mit)), (4, None), (5, ""), (6, "The MIT license is nice."),
        (7, "licensed under the apache licence, version 2.0! Licensed under CC BY-NC 4.0."), (7, "nothing"),
        (None, "All rights\nreserved."), (8, "x " * 50_000 + ". Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: r.licences for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 7: "Apache-2.0,CC-BY-NC-4.0", None: "", 8: "MIT"}
    assert got[1].first_known == 1 and got[2].n_known == 4 and got[7].n_known == 2
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_listed_sentence_and_rule_is_recognised(spark):
    texts = {}
    for sentence in licenses.SENTENCES:
        texts[sentence] = (f"Unknown words.\n{sentence}\nUnknown words.", None)
    for licence, sequence in licenses.RULES:
        spelled = [[s for s, n in licenses.SENTENCES.items() if n == name] for name in sequence]
        for i in range(max(map(len, spelled))):
            text = "\n\n".join(s[min(i, len(s) - 1)] for s in spelled)
            texts[f"{licence} {sequence} {i}"] = (f"Unknown words.\n{text}\nUnknown words.", licence)
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert set(got) == set(texts)
    assert all(got[s].n_known == 1 and got[s].first_known == 1 for s in licenses.SENTENCES)
    assert {k: got[k].licences for k, (_, licence) in texts.items() if licence} == {k: v for k, (_, v) in texts.items() if v}


def test_cut_sentences(spark):
    rows = [
        ("mit", "// SPDX-License-Identifier: MIT"), ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later\n\nSome text."),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"),
        ("none", "SPDX-License-Identifier: Other-1.0"), ("part", "It has version: 2.0."), ("alone", "Choose: MIT"),
        ("apart", "SPDX-License-Identifier: Other-1.0\nMIT\n"),
        ("two", "SPDX-License-Identifier: BSD-3-Clause\nMIT\n"),
    ]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"mit": "MIT", "gpl": "GPL-3.0-or-later", "mpl": "MPL-2.0", "two": "BSD-3-Clause"}


def test_tags_as_they_are_written(spark):
    rows = {
        "c": ("// SPDX-License-Identifier: MIT\n// Copyright 2020 X\nint x;", "MIT"),
        "py": ("import os\n# SPDX-License-Identifier: Apache-2.0\nimport sys", "Apache-2.0"),
        "or": ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        "and": ("/* spdx-license-identifier: (BSD-3-Clause AND ISC) OR MPL-2.0 */\nx", "MPL-2.0,BSD-3-Clause,ISC"),
        "with": ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nnext", "GPL-2.0-only"),
        "crlf": ("#!/bin/sh\r\n# SPDX-License-Identifier: CC0-1.0\r\nset -e", "CC0-1.0"),
        "two": ("SPDX-License-Identifier: ISC\nSPDX-License-Identifier: Zlib\n", "ISC,Zlib"),
        "wrapped": ("// Permission to use, copy, modify, and/or distribute this software for any purpose with or\n// without fee is hereby granted, provided that the above\n// copyright notice and this permission notice appear in all copies.", "ISC"),
        "end": ("SPDX-License-Identifier:", None), "blank": ("SPDX-License-Identifier: \nMIT", None),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id string, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert got == {k: want for k, (_, want) in rows.items() if want}
