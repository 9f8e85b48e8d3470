"""Fill-in-middle, URL filters and hard negatives against plain versions, with nulls, ties, repeats, long texts and empty tables."""

import re
from collections import Counter
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.llm import fill_in_middle, hard_negatives, license_scan, quality_rules, url_filter

SPICE = "ab Z.é日<>PSM\n1\x00"


def plain_cut(text, doc_id):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list(SPICE), rng.integers(0, 40))) for _ in range(400)]
    return [*made, None, "", "é" * 50_000 + "word " * 200_000, "x" * 300_000, "a <P> b", "<<P>", "word", made[0]]


def test_fill_in_middle_equals_a_plain_version(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "one two, three", "clash", 1), (0, texts[0], "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    want = Counter((d, *plain_cut(t or "", d)) for d, t, *_ in rows)
    assert Counter(map(tuple, fill_in_middle.transform(spark, docs).collect())) == want
    digests = Counter(map(tuple, fill_in_middle.transform(spark, docs, digests=True).collect()))
    sha = lambda t: sha256((t or "").encode()).hexdigest()
    assert digests == Counter((*x[:5], sha(x[5]), sha(rows[x[0]][1] if x[0] is not None else "one two, three")) for x in want.elements())
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark, docs.filter("false")).count() == 0


def test_units_are_counted_and_found_by_events_alone():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        text = "".join(rng.choice(list(SPICE), rng.integers(0, 25)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        found = fill_in_middle.Units(text)
        assert found.n == len(units) and found.marked == bool(re.search("<[PSM]>", text))
        assert [found.end_of(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_bytes_that_are_no_utf8_come_back(spark):
    docs = spark.sql("select id as doc_id, cast(unhex('61ff62206320c328') as string) as text from range(30)")
    made = fill_in_middle.transform(spark, docs).selectExpr("form", "cast(output as binary) as output").collect()
    assert {fill_in_middle.encoded(fill_in_middle.restore(fill_in_middle.decoded(bytes(r["output"])), r["form"])) for r in made} == {bytes.fromhex("61ff62206320c328")}


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/2", "http://a.example.com/en", "http://com", "http://com/", "http://xcom/", "http://a.net/es/x?y=/fr/",
    "http://a.net?x=/es/", "http://a.net/fr/#t", "http://a.org://b/c", "https://ÄB.net/es/", "x://user@h.net:80/es/", "http://a.com/x\ny", "http://a.b.c.d.e.org/p/q/r.html?b=1&a=2&b=3#t9", "://x.net/es/",
]


def plain_rule(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in url_filter.GIVEN if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_given_rules_decide(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(0, None, "clash"), (None, URLS[5], None)], "page_id long, url string, verdict string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark, pages, []).collect()}
    rows = [(k, *plain_rule(u)) for k, u in enumerate(URLS)] + [(None, *plain_rule(URLS[5]))]
    assert got == {(*r[:4], r[4] or "allow") for r in rows}
    assert url_filter.judge(spark, pages, []).count() == len(URLS) + 2
    assert url_filter.judge(spark, pages.filter("false"), []).count() == 0


def test_mined_rules_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(5)
    urls = {f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b', 'casino'])}.{rng.choice(['org', 'net'])}/{rng.choice(['en', 'x', 'win'])}/{k % 40}{rng.choice(['', '?ref=1', '#top'])}" for k in range(900)}
    rows = [(u, int(("casino" in u and "/win/" in u and rng.random() < 0.95) or rng.random() < 0.15)) for u in sorted(urls)]
    examples = spark.createDataFrame(rows, "url string, blocked int")
    host, path = url_filter.parts(F.col("url"))
    baskets = [(sorted(r["t"]), r["blocked"]) for r in examples.select(url_filter.tokens(F.col("url"), host, path).alias("t"), "blocked").collect()]
    n, blocked, every, bad = len(baskets), sum(b for _, b in baskets), Counter(), Counter()
    for tokens, b in baskets:
        for size in range(1, len(tokens) + 1):
            for c in combinations(tokens, size):
                every[c] += 1
                bad[c] += b
    least = -(-max(0.005, 25 / n) * n // 1)
    want = sorted(((c, bad[c] / every[c], bad[c] / n) for c in every if bad[c] >= least and bad[c] / every[c] >= 0.5 and bad[c] / every[c] / (blocked / n) >= 1.5), key=lambda r: (-r[1], -r[2], len(r[0]), r[0]))
    kept = []
    for rule in want:
        if not any(set(k[0]) <= set(rule[0]) for k in kept):
            kept.append(rule)
    got = url_filter.mine(spark, examples)
    assert [r[0] for r in got] == [r[0] for r in kept] and np.allclose([r[1:] for r in got], [r[1:] for r in kept])
    assert any(set(r[0]) <= {"host1 casino", "path0 win", "host0 org", "host0 net"} for r in got)
    judged = {r["url"]: r for r in url_filter.judge(spark, examples.select("url"), got, ()).collect()}
    sets = {r["url"]: set(r["t"]) for r in examples.select("url", url_filter.tokens(F.col("url"), host, path).alias("t")).collect()}
    for url, tokens in sets.items():
        first = next((k for k in kept if set(k[0]) <= tokens), None)
        assert judged[url]["verdict"] == ("block" if first else "allow") and judged[url]["mined"] == (" & ".join(first[0]) if first else None)


def test_parts_beyond_the_slots_make_rules(spark):
    """All labels and directories count: rules of one deep part, of two, and of a deep part with a slot, as a plain search over all tokens finds them."""
    rng = np.random.default_rng(6)
    pick = lambda *of: rng.choice(of)
    urls = sorted({f"http://{pick('spam', 'good')}.z.y.{pick('a', 'b')}.org/u/v{k % 9}/{pick('ads', 'doc')}/w/{pick('win', 'info')}/{k}x" for k in range(700)} | {f"http://c.org/{k}" for k in range(60)})
    sure = lambda u: ("spam." in u and ".a.org" in u) or ("/ads/" in u and "/win/" in u)
    rows = [(u, int((sure(u) and rng.random() < 0.97) or rng.random() < 0.04)) for u in urls]
    examples = spark.createDataFrame(rows, "url string, blocked int")
    host, path = url_filter.parts(F.col("url"))
    sets = {r["url"]: (frozenset(r["t"]), r["blocked"]) for r in examples.select("url", url_filter.tokens(F.col("url"), host, path).alias("t"), "blocked").collect()}
    assert {"host4 spam", "path2 ads", "path4 win"} <= set().union(*(t for t, _ in sets.values()))
    n, blocked, every, bad = len(sets), sum(b for _, b in sets.values()), Counter(), Counter()
    for tokens, b in sets.values():
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                every[c] += 1
                bad[c] += b
    want = [(c, bad[c] / every[c], bad[c] / n) for c in every if bad[c] >= 25 and bad[c] / every[c] >= 0.5 and bad[c] / every[c] / (blocked / n) >= 1.5]
    kept = url_filter.pruned(sorted(want, key=lambda r: (-r[1], -r[2], len(r[0]), r[0])))
    got = url_filter.mine(spark, examples)
    assert [r[0] for r in got] == [r[0] for r in kept] and np.allclose([r[1:] for r in got], [r[1:] for r in kept])
    assert ("path2 ads", "path4 win") in {r[0] for r in got} and any("host4 spam" in r[0] for r in got)
    judged = {r["url"]: r["verdict"] for r in url_filter.judge(spark, examples.select("url"), got, ()).collect()}
    assert all(judged[u] == "block" for u in urls if sure(u)) and all(judged[u] == "allow" for u in urls if "//c.org" in u)


def test_long_shared_paths_make_few_rules(spark):
    """Forty directories that the same URLs share have 2^40 combinations, and those of one part tell them all."""
    deep = "/".join(f"d{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(f"http://a.org/{deep}/{k}", 1) for k in range(30)] + [(f"http://a.org/en/{k}", 0) for k in range(120)]
    got = url_filter.mine(spark, spark.createDataFrame(rows, "url string, blocked int"))
    assert {r[0] for r in got} == {(f"path{k} d{chr(97 + k // 26)}{chr(97 + k % 26)}",) for k in range(40)} | {("path40 0",)} and all(r[1:] == (1.0, 0.2) for r in got)


def test_labels_without_a_pattern_make_no_rules(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/{'ab'[k % 2]}/{k}") for k in range(300)] + [(None, "http://a.org/"), (5, None)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 3 and 1, 0) for k in range(300)] + [(None, 0, 1), (4, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert url_filter.mine(spark, url_filter.labelled(pages, labels)) == []
    assert url_filter.mine(spark, url_filter.labelled(pages.filter("false"), labels)) == []
    assert url_filter.mine(spark, url_filter.labelled(pages, labels.filter("quality = 1"))) == []


def plain_negatives(rows):
    sound = [(v, (l + 1) % 10 if v % 7 == 0 else l, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for v, l, e, *_ in rows
             if v is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and all(abs(x) < 2**17 for x in e)]
    out = []
    for a, (anchor, label, code) in enumerate(sound):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(code, c, strict=True)), v, k, lab) for k, (v, lab, c) in enumerate(sound) if k != a and len(c) == len(code))
        for s, positive, _, _ in [x for x in scored if x[3] == label][:5]:
            fitting = [x for x in scored if x[3] != label and -80 * s <= -100 * x[0] <= -100 * s][:5]
            out += [(anchor, positive, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fitting)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 3)), rng.normal(0, 0.2, 6).tolist(), 1) for k in range(0, 900, 3)]
    shared = rows[4][2]
    rows += [(k, k % 3, shared, 1) for k in range(1000, 1400, 5)]  # a hot vector of several labels, anchors among it
    rows += [(1, None, shared, 1), (2, 1, None, 1), (4, 1, [None, *shared[1:]], 1), (5, 1, [float("nan"), *shared[1:]], 1), (7, 1, [float("inf"), *shared[1:]], 1), (None, 1, shared, 1), (8, 1, [1e30] * 6, 1)]
    rows += [(1500, 0, [0.0] * 6, 1), (1600, 1, [0.1, 0.2], 1), (1601, 2, [0.1, 0.2], 1), (1602, 1, [0.1, 0.2], 1), (1700, 4, [], 1), (1701, 4, [], 1), (1702, 5, [], 1), rows[0], (1100, 2, shared, 1)]
    return rows


@pytest.mark.parametrize(("part", "block"), [(1 << 22, 1 << 22), (300, 40)])
def test_hard_negatives_equal_a_plain_version(spark, vectors, part, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_CELLS", part)
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", block)
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>, score int")
    got = sorted(map(tuple, hard_negatives.mine(spark, df).collect()))
    want = plain_negatives(vectors)
    assert got == want and len(want) > 50
    assert hard_negatives.mine(spark, df.filter("false")).count() == 0


def test_planes_drop_no_candidate_that_counts():
    rng = np.random.default_rng(7)
    for trial in range(150):
        size = (3, 300, 1 << 20)[trial % 3]
        d, m, k = rng.integers(1, 9), rng.integers(1, 60), 3
        codes, queries = rng.integers(-size, size, (m, d)), rng.integers(-size, size, (4, d))
        allowed, scores = rng.random((4, m)) < 0.8, queries @ codes.T
        windows = [[(hard_negatives.NONE, 1 << 62, hard_negatives.NONE), (int(np.quantile(s, 0.2)), int(np.quantile(s, 0.8)), hard_negatives.NONE), (0, 1 << 62, int(np.quantile(s, 0.5)))] for s in scores]
        for r, (at, found) in enumerate(hard_negatives.Sliced(codes).search(queries, windows, allowed, k)):
            assert (found == scores[r][at]).all() and allowed[r][at].all()
            for low, high, limit in windows[r]:
                inside = lambda xs: sorted((int(x) for x in xs if max(low, limit) <= x <= high), reverse=True)[:k]
                assert inside(found) == inside(scores[r][allowed[r]])


def test_few_candidates_are_left_after_the_first_planes():
    rng = np.random.default_rng(8)
    codes = np.floor(256 * (x := rng.normal(size=(5000, 64))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    whole = [[(hard_negatives.NONE, 1 << 62, hard_negatives.NONE)]]
    [(at, _)] = hard_negatives.Sliced(codes).search(codes[:1], whole, np.ones((1, 5000), bool), 6)
    assert len(at) < 20


NOTICED = [
    ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("/* SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND BSD-3-Clause */", ["GPL-2.0", "MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\nMIT", ["GPL-2.0"]), ("SPDX-License-Identifier: LGPL-2.1+ or ISC", ["LGPL-2.1", "ISC"]), ("SPDX-License-Identifier: BSD-3-Clause-Clear", []),
    ("This project is licensed under the MIT License, see LICENSE for details.", ["MIT"]), ("It is licensed under the terms of the\nGNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0"]),
    ("Licensed under GPL-3.0-or-later", ["GPL-3.0"]), ("License: MIT", ["MIT"]), ("Code is MIT licensed.", ["MIT"]), ("This library is Apache-2.0 licensed, and more.", ["Apache-2.0"]),
    ("We like MIT, ISC license, and others.", []), ("The license of MIT students", []), ("mit or isc", []),
]


def test_licences_of_identifier_lines_and_short_notices(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NOTICED)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs).collect()} == {k: found for k, (_, found) in enumerate(NOTICED)}


def test_sql_of_licences_agrees_on_them(spark, tmp_path):
    import duckdb
    import pandas as pd

    from loomtab.llm import queries

    pd.DataFrame({"doc_id": range(len(NOTICED)), "text": [t for t, _ in NOTICED]}).to_parquet(tmp_path / "documents.parquet")
    got = queries.op8_license_scan(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_license_scan"]).df().sort_values("doc_id")
    assert got.values.tolist() == want[got.columns].values.tolist() and want["licenses"].tolist() == [",".join(x) for _, x in NOTICED]


def test_stop_words_of_another_language_reach_the_verdict(spark):
    czech = "Tento text byl napsán proto aby bylo jasné kdy pravidla kvality zamítnou dokument bez známých slov ".split()
    docs = spark.createDataFrame([(1, "\n".join(" ".join(czech[k:] + czech[:k]) for k in range(0, 15, 2)) + " konec jedna dvě tři")], "doc_id long, text string")
    given = ["aby", "bez", "kdy", "proto"]
    assert "stop_word_share" in quality_rules.judge(docs).first()["failed_rules"]
    assert "stop_word_share" not in quality_rules.judge(docs, stop_words=given).first()["failed_rules"]
    rules = [r for r in quality_rules.RULES if r.name == "stop_word_share"]
    long = docs.withColumn("text", F.concat(*(F.concat(F.lit(f"{k} x{k} y{k} z{k} "), F.lit(w + " ")) for k, w in enumerate(czech))))
    assert (quality_rules.keep(long, rules).count(), quality_rules.keep(long, rules, given).count()) == (0, 1)


def test_line_dedup_of_a_very_long_text(spark):
    from loomtab.llm import line_dedup

    passage = "\n".join(f"shared line {k} with some seven words" for k in range(9)) + "\n"
    filler = ["".join(f"own {p} line number {k} stands here\n" for k in range(20_000)) for p in ("first", "second", "third")]
    texts = [filler[0] + passage + filler[1] + passage + filler[2], "x" * 2_000_000 + "\n" + passage, passage * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_runs(spark, docs).collect()}
    assert got[0] == filler[0] + passage + filler[1] + filler[2]
    assert got[1] == "x" * 2_000_000 + "\n" and not got[2].strip()


def test_line_dedup_selects_long_units(spark):
    """Texts that share short lines only have no fingerprint in common, so nothing of them is compared."""
    from loomtab.llm import line_dedup

    own = lambda k, i: " ".join(f"own{k}x{i}y{j}" for j in range(12))
    texts = ["\n".join(line for i in range(12) for line in (own(k, i), "see also", "read more here", "all rights reserved")) for k in range(20)]
    found = line_dedup.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("hash").collect()
    assert found and len(found) == len({r["hash"] for r in found})


@pytest.mark.parametrize("kind, ids", [("long", [-(2**63), -5, 0, 7, 2**63 - 1]), ("string", ["", "10", "9", "a", "b"])])
def test_line_dedup_keeps_the_first_by_any_doc_id(spark, kind, ids):
    from loomtab.llm import line_dedup

    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    passage = "\n".join(line(f"p{i}", 8) for i in range(6))
    texts = [f"{line('q', 9)}\n{passage}", f"{line('r', 9)}\n{passage}\n{line('s', 9)}", passage, f"{passage}\n{line('t', 40)}", "\n".join([line("u", 10)] * 5)]
    # Two texts share an id; equal rows are one document.
    rows = [*zip(ids, texts, strict=True), (ids[3], f"{line('v', 3)}\n{line('w', 40)}"), (ids[4], line("w", 40)), (ids[0], texts[0])]
    docs = spark.createDataFrame(rows[::-1], f"doc_id {kind}, text string")
    got = sorted((r["doc_id"], r["text"].split()) for r in line_dedup.drop_runs(spark, docs).collect())
    want = [texts[0], f"{line('r', 9)} {line('s', 9)}", "", line("t", 40), line("u", 10), rows[5][1], "", texts[0]]
    assert got == sorted((k, text.split()) for (k, _), text in zip(rows, want, strict=True))
