"""URL filters: rules by host and path; where none fits, naive Bayes over words that hosts are split into.

A unigram model of words is counted over the visible text of all pages: not their tags, scripts,
comments and entities, nor urls and host names, which would make words of the very names that are to
be split. Viterbi splits the letter runs of host labels and path parts ('cheappills') into the most
likely words; multinomial naive Bayes, trained on the pages that a rule judges, scores the words of
the others.

Both models are whole and stay tables: every word and every token counts, whatever its rank and length. The
substrings of each distinct run of letters that have the length of a word, and that a filter of the
lexicon lets through, are joined with the words' counts, so a run's row carries the words that it needs; the odds of tokens are summed by part (a run in its place) and joined to
pages by part. Keys that are frequent on the larger side of a join - the first ``HOT`` - are joined
by a broadcast, all others by a shuffle; the results are the same for every ``HOT``. A run of any
length is split whole. Rules are a small table, joined by each of a host's parent domains that is as
deep as a rule's can be; Python runs in the split of distinct runs only.

Defined cases: a null url, or one without '://', has empty host and path, fits no rule and is judged
by the prior; without pages that a rule judges the verdict is allow; repeated rows are judged each;
a null html adds no words; of fitting rules of one length that of the longer host wins; empty tables
give empty results. Only page_id, url and html are used, so that other columns may have any names.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastercat.llm.exact_dedup import BinaryFuse, build_filters
from rastercat.llm.storage import stored

#: Frequent keys that a join broadcasts; the others are joined by a shuffle.
HOT = 50_000
#: Rows of substrings in a batch, about.
BATCH = 50_000
#: Words of a lexicon that a filter of 1.2 bytes each is made for, which tasks hold; of a larger one all substrings are joined.
SCREENED = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a page does not show, and names that are no words; each alternative is entered once and runs in linear time.
HIDDEN = r"(?is)<script\b.*?(?:</script[^<>]*+>|\z)|<style\b.*?(?:</style[^<>]*+>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&#?[A-Za-z0-9]{1,31}+;"
NAMES = r"[A-Za-z][A-Za-z0-9+.-]{0,31}+://[^\s<>\"']*+|(?<![\p{L}\p{N}.-])[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
# The rules of the registered query, (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def with_rules(rows: DataFrame, rules) -> DataFrame:
    """rows(host, path, more) with rule and ruled: the longest rule that fits a host or one of its parent domains, and the start of a path."""
    given = [(r[: r.index("/")], r[r.index("/") :], r, v) for r, v in rules]
    table = rows.sparkSession.createDataFrame(given, "at string, start string, rule string, verdict string")
    fit = F.struct(F.length("rule").alias("n"), F.length("at").alias("m"), "rule", "start", "verdict")
    table = table.groupBy("at").agg(F.collect_list(fit).alias("fits"))
    depth = max((x[0].count(".") + 1 for x in given), default=0)
    for k in range(1, depth + 1):
        domain = F.substring_index("host", ".", -k)
        fewer = F.size(F.split("host", r"\.", k)) < k  # a host of fewer labels was looked up before
        rows = rows.withColumn("__at", F.when(~fewer, domain)).join(table.select(F.col("at").alias("__at"), F.col("fits").alias(f"__{k}")), "__at", "left").drop("__at")
    fitting = lambda k: F.coalesce(F.filter(f"__{k}", lambda r: F.startswith(F.col("path"), r["start"])), F.array())
    best = F.array_max(F.concat(*map(fitting, range(1, depth + 1)))) if depth else F.lit(None).cast("struct<rule: string, verdict: string>")
    return rows.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "ruled": F.col("__best.verdict")}).drop("__best", *(f"__{k}" for k in range(1, depth + 1)))


class Segmenter:
    """Unigram Viterbi: the split of a run of letters with the greatest product of word probabilities.

    ``counts`` may leave out words that no run holds, if ``total`` is the count of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.lengths = sorted(set(map(len, counts)))
        self.split = functools.lru_cache(1 << 16)(self._split)

    def _split(self, run: str) -> tuple[str, ...]:
        """Known words of any length, and between them unknown ones, which cost as much as a word that never occurs and more for each letter.

        The best start of an unknown word that ends here is the best one for every end, so one is kept.
        """
        unknown, letter = math.log(self.total), 2.3
        best, free = [(0.0, 0)], (0.0, 0)
        for end in range(1, len(run) + 1):
            option = (free[0] + unknown + letter * end, free[1])
            for n in self.lengths:
                if n > end:
                    break
                if (cost := self.cost.get(run[end - n : end])) is not None:
                    option = min(option, (best[end - n][0] + cost, end - n))
            best.append(option)
            free = min(free, (option[0] - letter * end, end))
        words, end = [], len(run)
        while end:
            words.append(run[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(words))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host as h:word, of the path as p:word; numbers as their length."""
        return [t for part in parts(host, path) for t in ([part] if part[2] == "#" else [part[:2] + w for w in self.split(part[2:])])]


def parts(host: str, path: str) -> list[str]:
    """Runs of letters of the host as h:run, of the path as p:run; numbers as their length, h:#4."""
    found = ((place, x) for place, text in (("h", host), ("p", path.lower())) for x in regex.findall(r"[0-9]+|\p{L}+", text))
    return [f"{place}:#{min(len(x), 9)}" if x.isdigit() else f"{place}:{x}" for place, x in found]


def with_parts(rows: DataFrame) -> DataFrame:
    """rows(host, path, more) with parts, as ``parts`` has them."""
    for place, text in (("h", F.col("host")), ("p", F.lower("path"))):
        rows = rows.withColumn(f"__{place}", F.regexp_extract_all(text, F.lit(r"[0-9]+|\p{L}+"), F.lit(0)))
    number = lambda x: F.concat(F.lit("#"), F.least(F.length(x), F.lit(9)).cast("string"))
    named = lambda place: F.transform(f"__{place}", lambda x: F.concat(F.lit(f"{place}:"), F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)))
    return rows.withColumn("parts", F.concat(named("h"), named("p"))).drop("__h", "__p")


def substrings(run: str, lengths: list[int]) -> Iterator[str]:
    """Every part of a run that has the length of a word; one that is repeated may come again."""
    step = max(1, BATCH // max(1, len(lengths)))
    for first in range(0, len(run), step):
        starts = range(first, min(first + step, len(run)))
        yield from {run[i : i + k] for i in starts for k in lengths if i + k <= len(run)}


def visible(html: Column) -> Column:
    """The text that a page shows: html without scripts, styles, comments, tags and entities, and without urls and host names."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return F.regexp_replace(shown, NAMES, " ")


def lexicon(pages: DataFrame) -> DataFrame:
    """word, n: every word of all pages' visible text with its count."""
    words = pages.select(F.explode(F.split(F.translate(visible(F.col("html")), UPPER, LOWER), r"[^\p{L}]+")).alias("word"))
    return stored(words.filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n")), "lexicon")


def looked_up(many: DataFrame, table: DataFrame, key: str, hot: int) -> DataFrame:
    """The inner join with a table of distinct keys; the keys most frequent in ``many`` are joined by a broadcast, so none gathers in a task."""
    top = stored(many.groupBy(key).agg(F.count("*").alias("__n")).orderBy(F.col("__n").desc(), key).limit(hot).select(key), "hot")
    few = stored(table.join(F.broadcast(top), key, "left_semi"), "hot")
    rest = many.join(F.broadcast(top), key, "left_anti").join(table, key)
    return many.join(F.broadcast(few), key).unionByName(rest)


def _screen(words: DataFrame) -> tuple | None:
    """A binary-fuse filter of the words, which lets few other substrings through; None if there are too many words to hold one, or none."""
    n = words.count()
    if not 0 < n <= SCREENED:
        return None
    made = build_filters(words.select(F.xxhash64("word").alias("key")), 1).first()
    return made["seed"], made["segment"], made["segments"], bytes(made["prints"])


def splits(runs: DataFrame, words: DataFrame, hot: int = HOT) -> DataFrame:
    """run, words of each row of runs(run_id, run), split by the counts of words(word, n)."""

    longest = runs.agg(F.max(F.length("run"))).first()[0] or 0
    fitting = words.filter(F.length("word") <= longest)
    lengths = sorted(r[0] for r in fitting.select(F.length("word")).distinct().collect())  # no more than the longest run has letters
    screen = _screen(fitting)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = screen and BinaryFuse(*screen[:3], np.frombuffer(screen[3], np.uint8)).has
        pairs = ((i, w) for batch in batches for i, run in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in substrings(run, lengths))
        while some := list(itertools.islice(pairs, BATCH)):
            if has:
                keys = np.array([xxhash.xxh64_intdigest(w, 42) for _, w in some], np.uint64)
                some = [x for x, hit in zip(some, has(keys).tolist(), strict=True) if hit]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.string())], names=["run_id", "word"])

    total = words.agg(F.sum("n")).first()[0] or 0
    many = stored(runs.select("run_id", "run").mapInArrow(cut, "run_id long, word string"), "substrings")
    known = looked_up(many, fitting, "word", hot)
    known = known.groupBy("run_id").agg(F.collect_set(F.struct("word", "n")).alias("counts"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [list(Segmenter({x["word"]: x["n"] for x in counts or ()}, total)._split(run)) for run, counts in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return stored(runs.join(known, "run_id", "left").select("run", "counts").mapInArrow(split, "run string, words array<string>"), "splits")


def part_odds(rows: DataFrame, words: DataFrame, hot: int = HOT) -> tuple[DataFrame, float]:
    """(part, odds of every part; the prior): multinomial naive Bayes of allow against block, with add-one smoothing.

    ``rows`` has ruled and parts; tokens that no ruled page has add nothing.
    """
    allow, block = (F.count_if(F.col("ruled") == v) for v in ("allow", "block"))
    each = stored(rows.select("ruled", F.explode("parts").alias("part")).groupBy("part").agg(allow.alias("a"), block.alias("b")), "parts")
    run = F.expr("substring(part, 3)")
    letters = each.filter(~F.startswith(run, F.lit("#")))
    runs = stored(letters.select(run.alias("run")).distinct().withColumn("run_id", F.monotonically_increasing_id()), "runs")
    place = F.substring("part", 1, 2)
    named = letters.withColumn("run", run).join(splits(runs, words, hot), "run").select("part", "a", "b", F.transform("words", lambda w: F.concat(place, w)).alias("tokens"))
    named = stored(named.unionByName(each.filter(F.startswith(run, F.lit("#"))).withColumn("tokens", F.array("part"))), "named")
    tokens = stored(named.filter("a + b > 0").select("a", "b", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "tokens")
    pages, all_ = rows.agg(allow.alias("a"), block.alias("b")).first(), tokens.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    a, b = (all_["n"] + 1 + (all_[x] or 0) for x in "ab")
    odds = tokens.select("token", (F.log((F.col("a") + 1) / a) - F.log((F.col("b") + 1) / b)).alias("odds"))
    found = looked_up(named.select("part", F.posexplode("tokens").alias("at", "token")), odds, "token", hot)
    return stored(found.groupBy("part").agg(_sum().alias("odds")), "odds"), math.log((pages["a"] + 1) / (pages["b"] + 1)) if pages["b"] else 1.0


def _sum() -> Column:
    """The group's odds added in the order of ``at``, so that equal inputs give equal sums."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct("at", "odds"))), F.lit(0.0), lambda s, x: s + x["odds"])


def judged(pages: DataFrame, rules=RULES, hot: int = HOT) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, of allow) of every row of pages(page_id, url, html)."""
    placed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = stored(with_parts(with_rules(placed, rules)).withColumn("row", F.monotonically_increasing_id()), "urls")
    odds, prior = part_odds(rows, lexicon(pages), hot)
    sums = looked_up(rows.select("row", F.posexplode("parts").alias("at", "part")), odds, "part", hot).groupBy("row").agg(_sum().alias("x"))
    x = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(prior) + F.coalesce("x", F.lit(0.0))))
    score = 1 / (1 + F.exp(-x))
    verdict = F.coalesce("ruled", F.when(score >= 0.5, "allow").otherwise("block"))
    return rows.join(sums, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
