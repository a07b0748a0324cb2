import random
import re

import pytest
from pyspark.sql import functions as F

from rastercat.llm import pii as op
from tests.compare import DATA
from tests.llm.helpers import documents, odd_rows

# The base patterns as they are defined.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c-d%x@e.f and a@b.c@d.e, @x.y, q@r, é@b.cc z.@a.b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9.", "4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 41 1",
    "+1 (212) 555-0100 +12 +1-2 +123456789012345678 ++4 5 6 7 8 9 0 1 2+", "ünï +49 30 123456 card 5500-0000-0000-0004é", "x" * 300 + "@" + "y.z" * 50, "12 34--56 78", "tel 212-555-0199 or (415) 555-0123",
]


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    texts = TEXTS + [r[1] for r in odd_rows()]
    docs = documents(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])
    got = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in op.spans(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_long_texts_and_many_spans(spark):
    """Strict and loose spans, 20,000 of either: positions and overlaps take linear time."""
    text = "a@b.c 1.2.3.4 x at y dot org, " * 20_000 + "9" * 5_000 + "a." * 2_000
    docs = documents(spark, [(1, text, *[None] * 6)])
    got = op.spans(docs, sure=0.0).first()
    assert [tuple(x) for x in got["base"]] == brute(text)
    assert [tuple(x) for x in got["added"] if x["kind"] == "email"] == [("email", m.start(), m.end()) for m in re.finditer("x at y dot org", text)]


def planted(seed=4):
    """(text, its true spans, spans that look like some): labelers err on both sides."""
    rng, rows = random.Random(seed), []
    words = lambda n: " ".join(rng.choice(["the", "house", "goes", "over", "green", "water"]) for _ in range(n))
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    other = lambda n: "".join(rng.choice("0123456789ghijkLMNOP") for _ in range(n)) + "7k"
    for _ in range(500):
        before, after, kind = words(rng.randrange(4, 9)) + " ", " " + words(3), rng.randrange(9)
        cue, value, good = {
            0: ('token = "', token(40), True), 1: ("secret: ", other(28), True), 2: ("bearer ", token(64), True), 3: ("api_key=", token(32), True),
            4: ("commit ", token(40), False), 5: ("sha256: ", token(64), False), 6: ("", other(22), False), 7: ("md5 ", token(32), False), 8: ('k = "', token(40), True),
        }[kind]
        start = len(before + cue)
        rows.append((before + cue + value + after, {("secret", start, start + len(value))} if good else set()))
    return rows


def measured(got, rows):
    """(precision, recall)"""
    hits = sum(len(g & true) for g, (_, true) in zip(got, rows, strict=True))
    return hits / max(sum(map(len, got)), 1), hits / sum(len(true) for _, true in rows)


def test_added_secrets_and_what_expectation_maximisation_gives(spark):
    """Against the majority of the labelers' votes, each vote counting alike."""
    rows = planted()
    docs = documents(spark, [(i, t, *[None] * 6) for i, (t, _) in enumerate(rows)])
    spans = {r["doc_id"]: {tuple(x) for x in r["added"]} for r in op.spans(docs).collect()}
    precision, recall = measured([spans[i] for i in range(len(rows))], rows)
    votes = op.candidates(op.stored(op._pieces(docs.select("doc_id", "text"), ["doc_id"]), "pieces").withColumn("row", F.col("doc_id")))
    plain = {i: set() for i in range(len(rows))}
    for r in votes.filter("kind = 'secret' and form + if(gazetteer = 1, 1, 0) + if(context = 1, 1, 0) >= 2").collect():
        plain[r["row"]].add(("secret", r["start"], r["end"]))
    plain_precision, plain_recall = measured([plain[i] for i in range(len(rows))], rows)
    print(f"EM {precision:.3f} {recall:.3f}, majority {plain_precision:.3f} {plain_recall:.3f}")
    assert precision >= 0.95 and recall >= 0.9, (precision, recall, plain_precision, plain_recall)
    assert precision + recall >= plain_precision + plain_recall


def test_added_spans_of_the_tables(spark):
    """Every token that the driver planted, and no other long run."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    true = {(i, m.start(1), m.end(1)) for i, t in docs.select("doc_id", "text").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    got = {(r["doc_id"], x["start"], x["end"]) for r in op.spans(docs).collect() for x in r["added"] if x["kind"] == "secret"}
    assert got == true


def test_marks_inside_a_text(spark):
    text = "a\x01b@c.de\x01\x01 1.2.3.4"
    assert [tuple(x) for x in op.spans(documents(spark, [(1, text, *[None] * 6)])).first()["base"]] == brute(text)


def test_reliable_labelers_are_told_from_guessing_ones(spark):
    """800 true spans and 800 false ones; labeler 0 errs in 5 %, labeler 1 in 20 %, labeler 2 guesses."""
    rows = []
    for truth in (0, 1):
        for v0 in (0, 1):
            for v1 in (0, 1):
                for v2 in (0, 1, -1):
                    p = (0.95 if v0 == truth else 0.05) * (0.8 if v1 == truth else 0.2) * (1 / 3)
                    rows.append(("card", v0, v1, v2, 800 * p))
    table = spark.createDataFrame(rows, "kind string, v0 int, v1 int, v2 int, n double").groupBy("kind", "v0", "v1", "v2").sum("n").withColumnRenamed("sum(n)", "n")
    r = op.reliabilities(table, rounds=60).first()
    assert r["a0"] > 0.85 and r["b0"] < 0.15 and abs(r["a2"] - r["b2"]) < 0.1 and 0.4 < r["p"] < 0.6


def test_added_spans_touch_no_base_span(spark):
    rows = [(i, f"call my phone 212-555-01{i:02d} or +1 212 555 01{i:02d}", *[None] * 6) for i in range(40)]
    for r in op.spans(documents(spark, rows), sure=0.0).collect():
        assert [x["kind"] for x in r["base"]] == ["phone"] and [x["kind"] for x in r["added"]] == ["phone"]
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r["added"] for b in r["base"])


def test_masked(spark):
    """Also rows of one id with different texts, and columns with names that are used inside."""
    rows = [(1, "é write a@b.cd or 1.2.3.4!"), (1, "+49 30 123456x"), (2, None), (3, "plain"), (4, "𝄞 a@b.cd" * 3000), (1, "+49 30 123456x")]
    docs = spark.createDataFrame([(*r, *"12345") for r in rows], "doc_id long, text string, base string, added string, row string, t1 string, __cuts string")
    out = op.masked(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "", r["base"], r["__cuts"]) for r in out.collect()) == sorted(
        (i, t, "1", "5") for i, t in [(1, "é write [email] or [ip]!"), (1, "[phone]x"), (2, ""), (3, "plain"), (4, "𝄞 [email]" * 3000), (1, "[phone]x")]
    )


@pytest.mark.parametrize("rows", [[], [(1, None, *[None] * 6)]])
def test_nothing_to_find(spark, rows):
    assert [r["base"] for r in op.spans(documents(spark, rows)).collect()] == [[]] * len(rows)
