"""URL filters: rules first, then host word segmentation and naive Bayes.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
its path what follows up to ``?``, ``#`` or the end. A rule fits its host and all subdomains, if the
path starts with the rule's; the longest that fits decides. Where none fits, the runs of letters in the
host are split into words by unigram Viterbi, and a multinomial naive Bayes model scores the words of
host and path. It learns from the urls that a rule decides: what those that are blocked have in common
against those that are allowed. Both verdicts count as equally likely beforehand, as the rules' share says
nothing about other urls.

The unigram model counts the words of all titles, and of each different host the runs of letters once. A run
can't vouch for itself: where it is split, its own occurrences in hosts don't count, only those in titles.
Counts stay in tables: Viterbi is given the words that occur within a run of letters, found by a join,
and scores are sums of weights found by a join, so no vocabulary is cut and none goes to the driver. The join sees
every substring of a run that is as long as some word: of a run of n letters at most n * (n + 1) / 2.
Weights are whole multiples of 2 ** -20, so that sums don't depend on their order.

Null urls and urls without ``://`` have an empty host and path and no words, so they are allowed, as all
ties. Without urls that a rule decides all others are allowed. Urls and words of any length are taken
whole. Rows stay one for one, those without page_id and repeated ones too. Other columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stored

#: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of digits or of letters.
TOKEN = r"(\p{Nd}+|\p{L}+)"
#: Weights are whole numbers of this part.
PART = 1 << 20
#: Rows that a step hands on at a time.
ROWS = 1 << 16


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    parts = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return df.withColumns({"host": F.translate(parts[0], UPPER, LOWER), "path": parts[1]})


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and rule_verdict from host and path; null where no rule fits."""
    found = {"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")}
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        found = {"rule": F.when(fits, host + path).otherwise(found["rule"]), "rule_verdict": F.when(fits, verdict).otherwise(found["rule_verdict"])}
    return df.withColumns(found)


class Segmenter:
    """Splits a run of letters into its most probable words; an unknown word of n letters has probability 1 / (total * 10 ** n). Of equally probable splits the one whose last words are shortest is taken."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.score = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def __call__(self, letters: str) -> list[str]:
        each = math.log(10)
        begin = -math.log(self.total) - each
        best, from_ = [0.0], [0]
        unknown, since = -math.inf, 0  # the best split whose last word is unknown, and where that word begins
        for j in range(1, len(letters) + 1):
            unknown, since = max((unknown - each, since), (best[j - 1] + begin, j - 1))
            found = (unknown, since)
            for n in self.lengths:
                if n <= j and (known := self.score.get(letters[j - n : j])) is not None:
                    found = max(found, (best[j - n] + known, j - n))
            best.append(found[0])
            from_.append(found[1])
        out, j = [], len(letters)
        while j:
            out.append(letters[from_[j] : j])
            j = from_[j]
        return out[::-1]


def tokens(column: str) -> Column:
    return F.regexp_extract_all(column, F.lit(TOKEN), F.lit(1))


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}")


def path_words(path: str = "path") -> Column:
    """Runs of letters, lower-cased; of numbers their length and first digit."""
    number = lambda t: F.array(F.concat(F.lit("p:#"), F.length(t).cast("string")), F.concat(F.lit("p:#"), F.substring(t, 1, 1), F.lit("..")))
    return F.flatten(F.transform(tokens(path), lambda t: F.when(is_number(t), number(t)).otherwise(F.array(F.concat(F.lit("p:"), F.lower(t))))))


def host_tokens(hosts: DataFrame) -> DataFrame:
    """(host, pos, token) of different hosts."""
    return hosts.select("host").distinct().select("host", F.posexplode(F.transform(tokens("host"), F.lower)).alias("pos", "token"))


def unigrams(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, n, own): how often a word occurs in titles and as a run of letters of different hosts, and of these the latter."""
    title = F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    titles = pages.select(F.explode(F.split(title, r"[^\p{L}]+")).alias("word")).where("word <> ''")
    runs = parts.where(~is_number(F.col("token"))).select(F.col("token").alias("word"), F.lit(1).alias("own"))
    return titles.select("word", F.lit(0).alias("own")).union(runs).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"))


def segments(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, words) of each different run of letters in hosts."""
    runs = parts.where(~is_number(F.col("token"))).select("token").distinct()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_set(F.length("word")).alias("lengths")).first()  # some dozen lengths
    total, lengths = row.total, sorted(row.lengths)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, word = [], []
        for batch in batches:
            for t in batch.column("token").to_pylist():
                for n in lengths:
                    if n > len(t):
                        break
                    found = {t[i : i + n] for i in range(len(t) - n + 1)}
                    token += [t] * len(found)
                    word += found
                    if len(word) > ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(word, pa.string())], names=["token", "word"])
                        token, word = [], []
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(word, pa.string())], names=["token", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Segmenter({k["word"]: k["n"] for k in known or ()}, total)(t) for t, known in zip(batch.column("token").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(out, pa.list_(pa.string()))], names=["token", "words"])

    known = runs.mapInArrow(within, "token string, word string").join(counts, "word")
    known = known.withColumn("n", F.when(F.col("word") == F.col("token"), F.col("n") - F.col("own")).otherwise(F.col("n"))).where("n > 0")
    known = known.groupBy("token").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return runs.join(known, "token", "left").mapInArrow(split, "token string, words array<string>")


def host_words(parts: DataFrame, split: DataFrame) -> DataFrame:
    """(host, words) of hosts with tokens; of numbers their length."""
    each = parts.join(split, "token", "left").withColumn("words", F.coalesce("words", F.array(F.concat(F.lit("#"), F.length("token").cast("string")))))
    listed = each.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("all"))
    return listed.select("host", F.flatten(F.transform("all", lambda x: x["words"])).alias("words"))


def weights(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(word, weight) of urls (host, path, rule_verdict) that a rule decides: the log odds of block against allow, with add-one smoothing."""
    decided = urls.where("rule_verdict is not null")
    count = lambda key: decided.groupBy(key).agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    of_host = count("host").join(words, "host").select(F.explode("words").alias("word"), "allowed", "blocked").withColumn("word", F.concat(F.lit("h:"), "word"))
    of_path = count("path").select(F.explode(path_words()).alias("word"), "allowed", "blocked")
    table = stored(of_host.union(of_path).groupBy("word").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "url-words")
    row = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    share = lambda c, total: F.log((F.col(c) + 1) / F.lit(float(total + row[0] + 1)))
    return table.select("word", F.round((share("blocked", row[2]) - share("allowed", row[1])) * PART).cast("long").alias("weight"))


def sums(words: DataFrame, key: str, weight: DataFrame) -> DataFrame:
    """(key, sum) of (key, word); words without weight say nothing."""
    return words.join(weight, "word").groupBy(key).agg(F.sum("weight").alias(f"{key}_sum"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block) and host_words of every page (page_id, url, html)."""
    urls = with_rule(split_url(pages.select("page_id", "url")), rules).select("page_id", "host", "path", "rule", "rule_verdict")
    parts = stored(host_tokens(urls), "host-tokens")
    counts = stored(unigrams(pages, parts), "unigrams")
    words = stored(host_words(parts, segments(parts, counts)), "host-words")
    weight = weights(urls, words)
    of_host = sums(words.select("host", F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("word")), "host", weight)
    of_path = sums(urls.select("path").distinct().select("path", F.explode(path_words()).alias("word")), "path", weight)
    # tables of their own, so that adaptive execution can split the pages of a hot host or path in these joins
    of_host, of_path = stored(words.join(of_host, "host", "left"), "host-scores"), stored(of_path, "path-scores")
    score = (F.coalesce("host_sum", F.lit(0)) + F.coalesce("path_sum", F.lit(0))) / F.lit(float(PART))
    scored = urls.join(of_host, "host", "left").join(of_path, "path", "left").withColumn("score", score)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.array_join(F.coalesce("words", F.array().cast("array<string>")), " ").alias("host_words"))
