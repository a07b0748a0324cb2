"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are the spans of strict patterns (the base, always kept) and of looser ones: spelled-out
and spaced addresses, local telephone numbers, card numbers of other lengths, and long mixed tokens
that may be secrets. Three labelers vote on each: a rule of form, a gazetteer, and cue words before
the span; a labeler may abstain. Votes are counted by pattern over the whole corpus (at most 12
patterns a kind), and expectation-maximisation on those counts estimates each labeler's reliability
and each pattern's probability. With these as soft labels a naive Bayes span classifier is trained
on the votes, the span's shape and the word before it (hashed), so it also judges spans on which
labelers abstain. Looser spans that the classifier gives at least ``SURE`` and that touch no base
span are added.

A text is cut at the matches of a pattern; the pieces are rows, and positions are running totals of
their lengths, so the work is linear in the text and in its spans. Positions are code points, end
exclusive. Patterns run in time linear in the text: runs are entered at their start only and taken
whole. A U+0001 in a text, which no pattern can match, is read as U+0002: it marks the cuts.

Defined cases: null and empty texts have no spans; repeated rows and null ids are rows like any
others; with no candidates nothing is learned and nothing is added; empty tables give empty results.
Only doc_id and text are used; ``masked`` carries all other columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.llm.storage import column, dropped, stored, unused

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those of the base, and tokens that are secrets.
ALL_KINDS = (*KINDS, "secret")
SURE = 0.9
ROUNDS = 20
#: Values that a hashed word may have.
WORD_VALUES = 64
#: Code points before a span that hold its cue words.
REACH = 32

# The strict patterns. Possessive runs and run starts only keep them linear.
_STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser patterns, rules of form, cue words and gazetteers.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?: ?(?:\[at\]|\(at\)) ?| @ )[A-Za-z0-9-]++(?:(?:\.| \. | ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: What a text must hold for a pattern to be tried: parts of it, or a pattern.
_MARK = {"email": ("@", "[at]", "(at)", " dot "), "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:", "card": "[0-9]", "phone": r"\+[0-9]|[0-9][0-9]", "secret": "[0-9]"}
_FORM = {
    "email": r"[A-Za-z]{2,}$",
    "ip": r"[1-9A-Fa-f]",
    "card": "",
    "phone": r"^(?:\([2-9]|[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1|0[1-9])",
    "secret": r"(?:(?<!(?:sha[0-9-]{0,4}|md5|checksum|digest|etag|commit|integrity|hash)[\"']{0,1}\s{0,3})[=:]\s{0,3}[\"']?|bearer\s{1,3})$",
}
_CUES = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|ipv6|host|server|address|client|login",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|contact|whatsapp",
    "secret": r"token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|authorization|credential",
}
_DENIALS = {
    "email": "file|path|version",
    "ip": "version|release|section|chapter|build",
    "card": "isbn|serial|order|invoice|tracking|hash|token",
    "phone": "isbn|serial|order|invoice|version|page",
    "secret": r"sha-?[0-9]|md5|commit|checksum|digest|integrity|uuid|hash|etag|revision|https?:|www",
}
_KNOWN = {
    "email": r"(?i)(?:[.]|dot[\])]? ?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|255\.|0{1,4}:)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(?:\+(?:1|33|34|44|49)[^0-9]|\(?[2-9][0-9]{2}|0[1-9])",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{17,})$",
}
# Shapes of long runs that are no secrets. Other runs, such as hexadecimal ones, may be digests: the gazetteer abstains.
_PLAIN = r"^(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[A-Za-z]+(?:[/_-][A-Za-z0-9]+){2,})$"
#: (kind, whether its matches may be base spans, pattern); a match carries the place in this list.
_PATTERNS = [(kind, strict, p[kind]) for kind in ALL_KINDS for strict, p in ((True, _STRICT), (False, _LOOSE)) if kind in p]
_CUT = "\x01"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _by_kind(kind: Column, of) -> Column:
    """The expression of each kind, by the value of a column."""
    out = F.lit(None)
    for name in ALL_KINDS:
        out = F.when(kind == name, of(name)).otherwise(out)
    return out


def _passes(kind: str, m: Column) -> Column:
    """Whether a match of the strict pattern passes the kind's check."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(kind == "email")


def _has_mark(kind: str) -> Column:
    mark, text = _MARK[kind], F.col("text")
    return text.rlike(mark) if isinstance(mark, str) else reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in mark))


def _pieces(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and row of every row of texts(keys, text), and for each pattern that matches the text's pieces: at, pattern, i, n (code points), x.

    Odd pieces are matches, with their text in x; the others are what lies between, with its end. A
    row has the piece of at 0, or, if nothing matches, a row of nulls.
    """
    text = F.when(F.contains("text", F.lit(_CUT)), F.translate("text", _CUT, "\x02")).otherwise(F.coalesce("text", F.lit("")))
    rows = texts.select(*keys, F.monotonically_increasing_id().alias("row"), text.alias("text"))
    cut = {f"p{k}": F.when(_has_mark(kind), F.split(F.regexp_replace("text", pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)) for k, (kind, _, pattern) in enumerate(_PATTERNS)}

    def named(k: int) -> Column:
        piece = lambda x, i: F.struct(F.lit(k).alias("pattern"), i.alias("i"), F.length(x).alias("n"), F.when(i % 2 == 1, x).otherwise(F.right(x, F.lit(REACH))).alias("x"))
        return F.when(F.size(f"p{k}") > 1, F.transform(f"p{k}", piece)).otherwise(F.array())

    pieces = rows.withColumns(cut).select(*keys, "row", F.posexplode_outer(F.concat(*map(named, range(len(_PATTERNS))))).alias("at", "piece"))
    return pieces.select(*keys, "row", "at", "piece.*")


def candidates(pieces: DataFrame) -> DataFrame:
    """row, kind, start, end, base, the three votes (form, gazetteer, context), shape and word of each candidate."""
    along = Window.partitionBy("row", "pattern").orderBy("i")
    table = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict")) for kind, strict, _ in _PATTERNS))
    rows = pieces.filter("pattern is not null").select("row", "pattern", "i", "n", "x", F.sum("n").over(along).alias("end"), F.lag("x", 1, "").over(along).alias("gap"), F.lag("x", 2, "").over(along).alias("prior"))
    # The last word before a span may reach back over an earlier one.
    before = F.lower(F.right(F.concat(F.right("prior", F.lit(REACH)), "gap"), F.lit(REACH)))
    rows = rows.filter("i % 2 = 1").select("row", F.get(table, F.col("pattern")).alias("p"), (F.col("end") - F.col("n")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("x").alias("m"), before.alias("before"))
    rows = rows.select("row", "p.kind", "p.strict", "start", "end", "m", "before", F.length(_digits(F.col("m"))).alias("digits"))
    kind, m = F.col("kind"), F.col("m")
    rows = rows.withColumn("base", F.col("strict") & F.coalesce(_by_kind(kind, lambda k: _passes(k, m)), F.lit(False)))
    mixed = (F.col("digits") > 0) & m.rlike("[A-Za-z]")
    maybe = F.when(kind == "card", F.col("digits").between(13, 19)).when(kind == "secret", mixed).otherwise(~F.col("strict"))
    form = _by_kind(kind, lambda k: _luhn(_digits(m)) if k == "card" else (F.col("before") if k == "secret" else m).rlike(_FORM[k]))
    context = F.when(_by_kind(kind, lambda k: F.col("before").rlike(_CUES[k])), 1).when(_by_kind(kind, lambda k: F.col("before").rlike(_DENIALS[k])), 0).otherwise(-1)
    shape = F.concat(F.least("digits", F.lit(20)).cast("string"), F.lit("/"), F.least(F.length("m") - F.col("digits"), F.lit(40)).cast("string"))
    word = F.regexp_extract("before", r"([\p{L}]+)[^\p{L}]*$", 1)
    return rows.filter(F.col("base") | maybe).select(
        "row", "kind", "start", "end", "base",
        F.when(F.col("base") | form, 1).otherwise(0).alias("form"),
        F.when(_by_kind(kind, lambda k: m.rlike(_KNOWN[k])), 1).when((kind == "secret") & ~m.rlike(_PLAIN), -1).otherwise(0).alias("gazetteer"),
        context.alias("context"),
        shape.alias("shape"),
        F.pmod(F.xxhash64(word), F.lit(WORD_VALUES)).cast("string").alias("word"),
    )


_VOTES = (("form", "v0"), ("gazetteer", "v1"), ("context", "v2"))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per kind: p (share of true spans), a0..a2 and b0..b2 (a labeler's chance to say yes to a true, a false span) by EM.

    patterns(kind, v0, v1, v2, n): votes 1 yes, 0 no, -1 abstains. Counts are smoothed by one span.
    """
    one = lambda q, j: f"CASE WHEN x.v{j} = 1 THEN s.{q}{j} WHEN x.v{j} = 0 THEN 1 - s.{q}{j} ELSE 1D END"
    yes, no = ("s.p * " + " * ".join(one("a", j) for j in range(3))), ("(1 - s.p) * " + " * ".join(one("b", j) for j in range(3)))
    weighed = f"transform(xs, x -> named_struct('v0', x.v0, 'v1', x.v1, 'v2', x.v2, 'n', x.n, 'w', ({yes}) / ({yes} + {no})))"
    total = lambda what: f"aggregate(ws, 0D, (t, y) -> t + {what})"
    share = lambda j, w: f"({total(f'CASE WHEN y.v{j} = 1 THEN y.n * {w} ELSE 0D END')} + 0.8 * {{}} + 0.1) / ({total(f'CASE WHEN y.v{j} >= 0 THEN y.n * {w} ELSE 0D END')} + 1)"
    fields = [f"'p', ({total('y.n * y.w')} + 0.5) / ({total('y.n')} + 1)"]
    fields += [f"'a{j}', {share(j, 'y.w').format(1)}" for j in range(3)] + [f"'b{j}', {share(j, '(1 - y.w)').format(0)}" for j in range(3)]
    step = f"aggregate(array({weighed}), s, (old, ws) -> named_struct({', '.join(fields)}))"
    start = "named_struct('p', 0.7D, 'a0', 0.9D, 'a1', 0.8D, 'a2', 0.8D, 'b0', 0.2D, 'b1', 0.4D, 'b2', 0.3D)"
    kinds = patterns.groupBy("kind").agg(F.collect_list(F.struct("v0", "v1", "v2", "n")).alias("xs"))  # 27 patterns a kind at most
    step = step.replace("y.n * ", "CAST(y.n AS DOUBLE) * ")
    return kinds.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("s")).select("kind", "s.*")


_FEATURES = ("form", "gazetteer", "context", "shape", "word")


def classifier(found: DataFrame, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """Per kind the log odds of '' (the prior), and of each 'feature=value' against the prior; a table of bounded size.

    A value's counts are smoothed by one span that is true with the prior's chance, so that rare values say little.
    """
    counted = stored(found.groupBy("kind", *_FEATURES).agg(F.count("*").cast("double").alias("n")), "votes")
    patterns = counted.groupBy("kind", *(F.col(name).alias(v) for name, v in _VOTES)).agg(F.sum("n").alias("n"))
    one = lambda q, j, name: F.when(F.col(name) == 1, F.col(f"{q}{j}")).when(F.col(name) == 0, 1 - F.col(f"{q}{j}")).otherwise(1.0)
    joined = counted.join(F.broadcast(reliabilities(patterns, rounds)), "kind")  # one row a kind
    yes, no = F.col("p"), 1 - F.col("p")
    for j, (name, _) in enumerate(_VOTES):
        yes, no = yes * one("a", j, name), no * one("b", j, name)
    soft = joined.select("kind", "n", *_FEATURES, (yes / (yes + no)).alias("w"))
    names = F.array(*(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in _FEATURES), F.lit(""))
    sums = soft.select("kind", "n", "w", F.explode(names).alias("feature")).groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("w")).alias("yes"), F.sum(F.col("n") * (1 - F.col("w"))).alias("no"))
    out: dict[str, dict[str, float]] = {}
    total = lambda c: F.max(F.when(F.col("feature") == "", F.col(c))).over(Window.partitionBy("kind"))
    share = (total("yes") + 0.5) / (total("yes") + total("no") + 1)
    prior = F.log(share) - F.log(1 - share)
    odds = F.when(F.col("feature") == "", prior).otherwise(F.log(F.col("yes") + share) - F.log(F.col("no") + 1 - share) - prior)
    rows = sums.select("kind", "feature", odds.alias("odds")).orderBy("kind", "feature").collect()  # bounded by the features' values
    for r in rows:
        out.setdefault(r["kind"], {})[r["feature"]] = r["odds"]
    dropped(counted)
    return out


def _judged(model: dict[str, dict[str, float]]) -> Column:
    """The classifier's probability of a candidate: the prior's odds and those that its features add."""
    score = F.lit(None).cast("double")
    for kind, odds in model.items():
        prior = odds.get("", 0.0)
        table = F.create_map(*(F.lit(v) for f, o in odds.items() if f for v in (f, o)))
        total = sum((F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{f}="), F.col(f).cast("string"))), F.lit(0.0)) for f in _FEATURES), F.lit(prior))
        score = F.when(F.col("kind") == kind, total).otherwise(score)
    return 1 / (1 + F.exp(-F.coalesce(score, F.lit(-50.0))))


def _apart(found: DataFrame) -> DataFrame:
    """found with apart: whether a candidate touches no base span of its row."""
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier, later = F.max(F.when(F.col("base"), F.col("end"))).over(upto), F.min(F.when(F.col("base"), F.col("start"))).over(onward)
    return found.withColumns({"__end": earlier, "__start": later}).withColumn("apart", F.coalesce(F.col("__end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__start") >= F.col("end"), F.lit(True))).drop("__end", "__start")


def _found(texts: DataFrame, keys: list[str], sure: float) -> tuple[DataFrame, DataFrame]:
    """(every row's keys and row; row, base, kind, number of the kind, start and end of each span of texts(keys, text))."""
    pieces = stored(_pieces(texts, keys), "pieces")
    found = stored(candidates(pieces), "candidates")
    rows = stored(pieces.filter("coalesce(at, 0) = 0").select(*keys, "row"), "rows")
    dropped(pieces)
    model = classifier(found)
    taken = F.col("base") | (F.col("apart") & (_judged(model) >= sure)) if model else F.col("base")
    number = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).alias("number")
    return rows, _apart(found).filter(taken).select("row", "base", "kind", number, "start", "end")


def spans(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, base and added of every row of docs: arrays of (kind, start, end) in order of kind and start."""
    rows, found = _found(docs.select("doc_id", "text"), ["doc_id"], sure)
    one = F.struct("number", "start", "end", "kind")
    some = found.groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(which, one))).alias(name) for name, which in (("base", F.col("base")), ("added", ~F.col("base")))))
    short = lambda xs: F.coalesce(F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.array())
    return rows.join(some, "row", "left").select("doc_id", short("base").alias("base"), short("added").alias("added"))


def masked(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """docs(text, more) with every span replaced by [kind]; spans that overlap an earlier one are joined to it."""
    t1, t2, cuts, raw = unused(docs, "t1", "t2", "cuts", "raw")
    tags = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]
    rows, found = _found(docs.select(*tags, "text"), ["t1", "t2"], sure)
    one = rows.groupBy("t1", "t2").agg(F.min("row").alias("row"))  # equal texts have equal spans
    along = Window.partitionBy("row").orderBy("start", "number", "end")
    prior = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = found.join(one, "row").withColumn("fresh", (F.col("start") >= prior).cast("int")).withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = islands.groupBy("t1", "t2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "number", "kind"))["kind"].alias("kind"))
    lists = islands.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(cuts)).withColumnsRenamed({"t1": t1, "t2": t2})

    # Four bytes a code point, so that a piece is found in its place at once.
    joined = docs.withColumns({t1: tags[0], t2: tags[1]}).join(lists, [t1, t2], "left")
    wide = joined.withColumn(raw, F.when(F.size(column(cuts)) > 0, F.encode("text", "UTF-32")))
    at, code = F.col(column(cuts)), F.col(column(raw))
    piece = lambda a, b: F.decode(F.substring(code, a * 4 + 1, (b - a) * 4), "UTF-32")
    ended = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"])
    clean = F.concat(F.array_join(F.transform(at, lambda x, i: F.concat(piece(ended(i), x["start"]), F.lit("["), x["kind"], F.lit("]"))), ""), piece(F.get(at, F.size(at) - 1)["end"], F.octet_length(code) / 4))
    text = F.when(code.isNotNull(), clean).otherwise(F.col("text"))
    return wide.select(*(text.alias("text") if c == "text" else F.col(column(c)) for c in docs.columns))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal-data spans; the added ones may also be secrets."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda x: F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(number(x).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [(F.size("base") + F.size("added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"), *more)
