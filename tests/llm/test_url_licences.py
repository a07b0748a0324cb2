import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rastercat.llm import licences, url_filter
from tests.compare import DATA
from tests.llm.helpers import odd_rows

URLS = [
    (1, "http://A.Example.org/es/1?x=/fr/", "<p>cheap pills cheap pills farm</p>"), (2, "https://example.org/en/12#a", None), (3, "x://com", ""), (4, None, "spam farm"), (5, "no scheme", ""),
    (6, "http://badexample.org/es/2", ""), (7, "http://b.com/fr/x", ""), (8, "http://b.com/de/", ""), (9, "http://h?q://x/y", ""), (10, "a://b://c/d", ""), (1, "http://A.Example.org/es/1?x=/fr/", ""), (11, "http://cheappills.net/farm7", ""),
]


def judged(spark, rows):
    return url_filter.judged(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string"))


def test_parts_and_rules(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judged(spark, URLS).collect()}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("com", "", None), 4: ("", "", None), 5: ("", "", None), 6: ("badexample.org", "/es/2", "org/"),
        7: ("b.com", "/fr/x", "com/fr/"), 8: ("b.com", "/de/", "com/de/"), 9: ("h", "", None), 10: ("b:", "//c/d", None), 11: ("cheappills.net", "/farm7", None),
    }


def test_rules_decide_and_the_model_judges_the_rest(spark):
    good = [(i, f"http://flower{i}.org/garden/{i}", "flower garden flower garden") for i in range(50)]
    bad = [(100 + i, f"http://x{i}.com/de/cheappills", "cheap pills cheap pills") for i in range(50)]
    rest = [(200, "http://gardenflower.net/", ""), (201, "http://n.net/cheappills", "")]
    rows = judged(spark, good + bad + rest).collect()
    got = {r["page_id"]: r["verdict"] for r in rows}
    assert len(rows) == 102 and got[200] == "allow" and got[201] == "block" and got[0] == "allow" and got[100] == "block"


def test_segments():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "pill": 30, "s": 5, "spam": 20, "farm": 20})
    assert s.split("cheappills") == ("cheap", "pills") and s.split("spamfarm") == ("spam", "farm")
    assert "".join(s.split("q" * 1000)) == "q" * 1000
    assert s.tokens("spamfarm.net", "/A12") == ["h:spam", "h:farm", *(f"h:{w}" for w in s.split("net")), "p:a", "p:#2"]


HTML = [
    ("<p>Cheap <b>pills</b> &amp; farm</p>", "Cheap pills farm"), ("<script>var hidden='<p>';</script>seen<style>p{x}</style >", "seen"), ("a <!-- not <b> this --> b", "a b"), ("text <!-- open", "text"),
    ("see http://www.host.org/x?y and www.other.net. End", "see and . End"), ("1 < 2 and <a href='http://x.y/z'>link</a>", "1 < 2 and link"), (None, ""), ("<" * 50_000, "<" * 50_000), ("a" * 50_000 + "." * 10, "a" * 50_000 + "." * 10),
    ("<script " * 20_000, ""), ("http://" * 1000, ""),
]


def test_visible_text(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)], "i int, html string").select("i", url_filter.visible(F.col("html")).alias("x"))
    assert [" ".join(r["x"].split()) for r in rows.orderBy("i").collect()] == [x for _, x in HTML]


@pytest.mark.parametrize("run", ["cheappills", "therinfarm", "pillspam", "xspamq", "therein"])
def test_viterbi_equals_trying_all_splits(run):
    counts = {"cheap": 50, "pills": 40, "pill": 30, "spam": 20, "farm": 20, "the": 900, "there": 70, "in": 500, "rein": 3, "her": 10, "s": 5}
    total = sum(counts.values()) + 1
    cost = lambda words: sum(math.log(total / counts[w]) if w in counts else math.log(total) + 2.3 * len(w) for w in words)
    every = ([run[i:j] for i, j in itertools.pairwise([0, *cuts, len(run)])] for k in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), k))
    words = url_filter.Segmenter(counts).split(run)
    assert "".join(words) == run and cost(words) == pytest.approx(min(map(cost, every)))


def test_rules_equal_trying_each(spark):
    rules = [("org/", "allow"), ("a.org/x", "block"), ("b.a.org/", "allow"), ("b/xx", "block"), ("a.b/", "allow"), ("/", "block"), ("c.d.e.f/y/", "allow")]
    urls = [f"s://{h}{p}" for h in ("org", "a.org", "b.a.org", "z.b.a.org", "a.b", "b", "xorg", "", "c.d.e.f", "1.c.d.e.f", "a.", "org.") for p in ("", "/", "/x", "/xx", "/y/", "/y/z")]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"))

    def fitting(host, path):
        own = {".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)}
        fits = [(len(r), r.index("/"), r) for r, _ in rules if r[: r.index("/")] in own and path.startswith(r[r.index("/") :])]
        return max(fits)[2] if fits else None

    got = url_filter.with_rules(rows, rules).collect()
    assert len(got) == len(urls) and [(r["i"], r["rule"]) for r in got if r["rule"] != fitting(r["host"], r["path"])] == []
    assert url_filter.with_rules(rows, []).filter("rule is not null").count() == 0


def test_lexicon_of_the_tables(spark):
    """No word of it comes from markup, and no host name is a word only because it is linked."""
    counts = {r["word"]: r["n"] for r in url_filter.lexicon(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    assert not {"href", "amp", "charset", "example"} & set(counts)
    hosts = {r["h"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select(F.regexp_extract("url", r"//(?:www\.|blog\.|m\.)?([a-z]+)\.example", 1).alias("h")).collect()}
    split = {h: url_filter.Segmenter(counts).split(h) for h in hosts if h and h not in counts}
    assert split and sum(len(x) > 1 for x in split.values()) >= 0.9 * len(split)


def brute(rows, got):
    """Scores of judged rows by whole counts of words and tokens, in plain Python."""
    shown = re.compile(r"<[^<>]*>|&[a-z]+;|\w+(?:\.\w+)+")
    counts = Counter(w for _, _, html in rows for w in re.split(r"[^a-zé]+", shown.sub(" ", html or "").lower()) if len(w) >= 2)
    segmenter, rules = url_filter.Segmenter(counts), dict(url_filter.RULES)
    pages, tokens = Counter(), {"allow": Counter(), "block": Counter()}
    for r in got:
        if r["rule"]:
            pages[rules[r["rule"]]] += 1
            tokens[rules[r["rule"]]].update(segmenter.tokens(r["host"], r["path"]))
    known = set(tokens["allow"]) | set(tokens["block"])
    a, b = (sum(tokens[v].values()) + len(known) + 1 for v in ("allow", "block"))
    odds = {t: math.log((tokens["allow"][t] + 1) / a) - math.log((tokens["block"][t] + 1) / b) for t in known}
    prior = math.log((pages["allow"] + 1) / (pages["block"] + 1)) if pages["block"] else 1.0
    return [1 / (1 + math.exp(-prior - sum(odds.get(t, 0.0) for t in segmenter.tokens(r["host"], r["path"])))) for r in got]


def test_rare_words_and_tokens_count(spark):
    """Over 50,000 words are more frequent than those of the url, and over 50,000 tokens come first."""
    often = ["q" + "".join(x) for x in itertools.islice(itertools.product("abcdefghij", repeat=5), 50_001)]
    rows = [(0, "http://a.org/" + "/".join(often), " ".join(often + often)), *((i, "http://x.com/de/zcheap/zpills", "zcheap zpills" if i == 1 else "") for i in (1, 2)), (3, "http://n.net/zcheapzpills", "")]
    got = judged(spark, rows).collect()
    assert len(got) == 4 and [r["score"] for r in got] == pytest.approx(brute(rows, got), rel=1e-9)


@pytest.mark.parametrize("hot", [1, 3, 50_000])
def test_scores_equal_brute_force(spark, hot):
    """However many keys are joined by a broadcast."""
    rows = [*URLS, (12, "http://cheapfarm.com/de/pillscheap/" + "cheappills" * 60, "cheap farm"), (13, None, "")]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), hot=hot).collect()
    assert len(got) == len(rows) and [r["score"] for r in got] == pytest.approx(brute(rows, got), rel=1e-9)


def test_long_runs_are_split_whole():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40})
    assert s.split("cheappills" * 100) == ("cheap", "pills") * 100
    assert set(url_filter.substrings("abc" * 3000, list(range(2, 25)))) == {("abc" * 10)[i : i + k] for i in range(3) for k in range(2, 25)}
    assert list(url_filter.substrings("abc", [2, 5])) in (["ab", "bc"], ["bc", "ab"]) and not list(url_filter.substrings("abc", []))
    long = "rindfleischetikettierungsueberwachungsaufgabe"
    s = url_filter.Segmenter({"cheap": 50, long: 2})
    assert s.split("cheap" + long + "cheap") == ("cheap", long, "cheap") and s.split("q" * 100 + "cheap") == ("q" * 100, "cheap")


@pytest.mark.parametrize("screened", [0, 1 << 21])
def test_long_words_of_the_lexicon_are_found(spark, monkeypatch, screened):
    """With a filter of the lexicon and without one."""
    monkeypatch.setattr(url_filter, "SCREENED", screened)
    long = "rindfleischetikettierungsueberwachungsaufgabe"
    words = spark.createDataFrame([("cheap", 50), ("pills", 40), (long, 2), ("x" * 300, 1)], "word string, n long")
    runs = [f"cheap{long}pills", "pills", "q", long * 3, "cheappills" * 50]
    got = {r["run"]: tuple(r["words"]) for r in url_filter.splits(spark.createDataFrame(list(enumerate(runs)), "run_id long, run string"), words).collect()}
    whole = url_filter.Segmenter({"cheap": 50, "pills": 40, long: 2, "x" * 300: 1})
    assert got == {run: whole.split(run) for run in runs} and got[runs[0]] == ("cheap", long, "pills")


def test_splits_without_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert [tuple(r["words"]) for r in url_filter.splits(spark.createDataFrame([(1, "abc")], "run_id long, run string"), none).collect()] == [("abc",)]


def test_no_pages(spark):
    assert judged(spark, []).count() == 0


FILES = [
    ("src/LICENSE", "Released under the MIT License."), ("src/a/b/code.txt", "plain words"), ("src/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("src/x.txt", "long text " * 50 + "\nLicensed under CC BY-NC 4.0.\nmore"),
    ("other/y.txt", "nothing"), ("src/deep/er/z.txt", None), (None, "Licensed under the Apache License, Version 2.0."), ("top.txt", ""), ("src/a/b/code.txt", "plain words"),
    ("w/long.txt", "word " * 500 + "license: under the Apache License, Version 2.0 licensed " + "word " * 500),
]


def scanned(spark, rows):
    return licences.with_inherited(licences.own_licences(spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, licence_of string")))


def test_own_and_inherited(spark):
    rows = scanned(spark, FILES).collect()
    assert len(rows) == len(FILES)
    got = {r["path"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in rows}
    assert got["src/LICENSE"] == ("MIT", "MIT", None)
    assert got["src/a/b/code.txt"] == (None, "GPL-3.0", "src/a")
    assert got["src/x.txt"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert got["src/deep/er/z.txt"] == (None, "MIT", "src")
    assert got["other/y.txt"] == (None, None, None) and got["top.txt"] == (None, None, None)
    assert got[None] == ("Apache-2.0", "Apache-2.0", None)


def test_every_template_finds_itself(spark):
    known = licences.Templates(licences.TEMPLATES, {}, 0)
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            assert known.best(licences.terms(text.upper()))[0] == name


GNU = """
 * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
WRAPPED = {
    "MPL-2.0": """
/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
""",
    "Apache-2.0": """
# Licensed under the Apache
# License, Version 2.0 (the "License"); you may not use this
# file except in compliance with the License. You may obtain a copy of
# the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
""",
    "GPL-2.0": GNU.format(";", 2),
    "GPL-3.0": GNU.format(":", 3),
    "LGPL-3.0": GNU.format(":", 3).replace("GNU General", "GNU Lesser General").replace("program", "library"),
    "MIT": """
Permission is
hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
""",
}


def test_wrapped_headers(spark):
    code = "int main(void) { return value + other; }\n" * 40
    rows = [(f"{name}/x.c", code + text + code) for name, text in WRAPPED.items()]
    rows += [(f"{name}/LICENSE", "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + "\n".join(re.findall(r"(?:\S+\s+){1,9}", licences.TEXTS[name][0] + " "))) for name in ("BSD-2-Clause", "BSD-3-Clause")]
    got = {r["path"]: r["own_licence"] for r in scanned(spark, rows).collect()}
    assert got == {path: path.split("/")[0] for path, _ in rows}


def test_wrapped_name_and_version(spark):
    rows = [(f"GPL-{v}.0/x", f"This work is licensed under the GNU General Public License,\nversion {v}\n" + "plain words " * 90) for v in (2, 3)]
    assert {r["path"]: r["own_licence"] for r in scanned(spark, rows).collect()} == {f"GPL-{v}.0/x": f"GPL-{v}.0" for v in (2, 3)}


def test_every_text_finds_itself():
    known = licences.Templates(licences.TEMPLATES, {}, 0, licences.TEXTS)
    for name, texts in licences.TEXTS.items():
        for text in texts:
            got, score, inside, n = known.judged(text.replace(" ", "\n// "), licences.SURE)
            assert got == name and score > 0.99 and 2 * inside >= n


def test_odd_texts_and_no_files(spark):
    rows = [(f"d/{i}", r[1]) for i, r in enumerate(odd_rows())]
    assert scanned(spark, rows).filter("licence is not null").count() == 0
    assert scanned(spark, []).count() == 0
