"""License scan, URL filter and top-k search against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens.llm import license_scan, license_texts, topk, url_filter
from pactlens.llm.common import reach_package


def shingles(text, width=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[n : n + width]) for n in range(len(words) - width + 1)}


def test_licenses(make_documents, corpus):
    long_notice = " ".join(f"term{n}" for n in range(120))
    notices = license_texts.NOTICES | {"LONG": long_notice, "SHORT": "All rights reserved", "NONE": " .. "}
    cut = long_notice.split()
    rows = corpus + [
        (900, None), (901, ""), (902, "licensed UNDER the apache license; version 2.0"), (903, long_notice), (903, long_notice), (904, "x " + " ".join(cut[:110]) + " y"),
        (905, " ".join(cut[:60])), (906, " ".join(cut[:70] + ["changed"] + cut[71:])), (907, "all rights reserved"), (None, "Released under the MIT License."),
        (908, "Released under the MIT License. " * 3000), (909, "Licensed under the Apache License, Version 3.0."),
    ]
    got = sorted((str(r.doc_id), r.license, round(r.containment, 6)) for r in license_scan.scan(make_documents(rows, h=1, row="x", t=2), notices).collect())
    want = []
    for doc_id, text in rows:
        for name, notice in notices.items():
            width = min(5, len([w for w in re.split(r"[\W_]+", notice.lower()) if w]))
            if width:
                mine = shingles(notice, width)
                share = len(mine & shingles(text, width)) / len(mine)
                if share >= 0.8:
                    want.append((str(doc_id), name, round(share, 6)))
    assert got == sorted(want)
    assert license_scan.scan(make_documents([])).count() == 0


def test_altered_bodies(make_documents):
    """Whole and altered bodies inside other text, around the threshold, against plain containment."""
    draw = random.Random(12)
    rows = [(n, "plain prose without any terms " * 3) for n in range(3)]
    for name, body in license_texts.BODIES.items():
        tokens = body.split()
        for changes in (0, 1, 2, len(tokens) // 40, len(tokens) // 25):
            altered = list(tokens)
            for _ in range(changes):
                at = draw.randrange(len(altered))
                altered[at : at + draw.randrange(2)] = [f"w{draw.randrange(100)}"] * draw.randrange(2)
            filler = [f"q{draw.randrange(5000)}" for _ in range(draw.randrange(400))]
            at = draw.randrange(len(filler) + 1)
            rows.append((len(rows), " ".join([*filler[:at], "/*", *altered, "*/", *filler[at:]])))
        rows.append((len(rows), " ".join(tokens[: len(tokens) // 2])))
    got = sorted((r.doc_id, r.license, round(r.containment, 6)) for r in license_scan.scan(make_documents(rows)).collect())
    want = []
    for doc_id, text in rows:
        held = shingles(text)
        for name, notice in license_texts.TEMPLATES.items():
            mine = shingles(notice)
            if len(mine & held) >= 0.8 * len(mine):
                want.append((doc_id, name, round(len(mine & held) / len(mine), 6)))
    assert got == sorted(want) and len(want) > 2 * len(license_texts.BODIES)
    assert {name for _, name, _ in want} >= set(license_texts.BODIES)


def plain_verdict(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [r for r in rules if (r.host == "" or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: r.weight, default=None)
    return host, path, best and best.pattern, best.verdict if best else "allow"


def test_urls(spark):
    reach_package(spark)
    rules = [url_filter.Rule.parse(*r) for r in [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.example.net"), ("block", "b.org/x"), ("allow", "b.org/x/y"), ("block", "c.b.org/x/y")]]
    draw = random.Random(4)
    urls = [None, "", "no scheme", "http://", "://net/", "HTTP://A.Example.NET", "http://net", "http://xnet/", "http://n\net/a\nb?c", "a://b://c/d", "http://example.net./en/", "http://b.org#/x"]
    urls += [f"http{draw.choice(['', 's'])}://{draw.choice(['', 'a.', 'c.', 'z-.'])}{draw.choice(['example.net', 'b.org', 'Net', 'c.b.org'])}{draw.choice(['', '/', '/en/', '/x', '/x/y?z', '/xy#x'])}" for _ in range(400)]
    frame = spark.createDataFrame([(n % 300, url) for n, url in enumerate(urls)], "page_id long, url string").withColumn("key", F.lit(1)).withColumn("rule", F.lit("x"))
    got = sorted(map(str, [tuple(r) for r in url_filter.decide(frame, rules).collect()]))
    assert got == sorted(str((n % 300, *plain_verdict(url, rules))) for n, url in enumerate(urls))
    assert url_filter.decide(frame.limit(0), rules).count() == 0


@pytest.mark.parametrize("block, scale", [(7, 64), (4096, 64), (16, 2**40)])
def test_top_k(spark, block, scale):
    reach_package(spark)
    draw = np.random.default_rng(2)
    table = draw.normal(size=(150, 6)).astype(np.float32).tolist()
    rows = [(n, v) for n, v in enumerate(table)] + [(200 + n, table[3]) for n in range(40)] + [(3, table[5])]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf"), 0.0]), (404, [0.5]), (405, []), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5, block=block, scale=scale, pivots=4).collect())
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for query_id, q in whole:
        if query_id % 20 == 0:
            clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != query_id)[:5]
            want += [(query_id, n + 1, i, clip(-s)) for n, (s, i) in enumerate(scored)]
    if scale == 64:
        assert got == sorted(want)
    else:
        assert [(q, n, s) for q, n, _, s in got] == [(q, n, s) for q, n, _, s in sorted(want)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
