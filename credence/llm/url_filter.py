"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.html_extract import host_of

HASHES = 1 << 16
LENGTHS = (3, 4, 5)
ALLOW, BLOCK = "allow", "block"

# Rules of the contract as (verdict, host and path).
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]

# Words of hosts and paths for the built-in labelled table.
UNWANTED = ("adult ads adserver track tracker casino slots poker bets betting jackpot pills pharmacy viagra spam spam-farm link-farm porn xxx "
            "escort warez torrent crack keygen payday-loan free-win cheap-meds malware phish popunder clickbait").split()
ORDINARY = ("garden history kitchen museum science library school village music letters travel weather sports health journal gazette "
            "university council theatre forest river bicycle railway astronomy pottery chess poetry law economy nature press archive "
            "cinema football harbour market church bakery orchard mountain literature physics").split()


def labelled_urls() -> list[tuple[str, int]]:
    """A small table of invented URLs: (url, 1 for block).

    Unwanted and ordinary words stand in the same shapes of hosts and paths, so that only the words tell
    the classes apart, and ordinary ones are several times as many, so that unknown words are allowed.
    """
    shapes = list(product(("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net"), ("en", "de", "fr", "es"),
                          ("", ".html", "/", "?page=2&ref=x", "#top", "/view")))
    rows: list[tuple[str, int]] = []

    def add(words: Sequence[str], each: int, label: int) -> None:
        for i, word in enumerate(words):
            for j in range(each):
                start, domain, lang, tail = shapes[(i * each + j) * 5 % len(shapes)]
                rows.append((f"https://{start}{word}.{domain}/{lang}/{100 + 37 * i + j}{tail}", label))

    add(UNWANTED, 6, 1)
    add([f"{w}-{x}" for w, x in zip(UNWANTED, ("win", "x", "top", "free", "best", "hot") * len(UNWANTED))], 3, 1)
    add(ORDINARY, 24, 0)
    add([f"{w}-{x}" for w, x in zip(ORDINARY, reversed(ORDINARY))], 6, 0)
    letters = random.Random(5)      # words of no meaning, for what is neither
    add(["".join(letters.choice("etaoinshrdlucmfwypvbgkqjxz"[:k]) for k in [letters.choice((8, 14, 26))] * letters.randint(2, 12)) for _ in range(150)], 4, 0)
    rows += [("", 0)] * 20
    for i, word in enumerate(UNWANTED):
        rows.append((f"https://{ORDINARY[i % len(ORDINARY)]}.example.org/{word}/{i}", 1))
    return rows


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. Of equally long rules that fit the alphabetically first."""
    ordered = sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]]))
    none = F.lit(None).cast("string")
    rule = reduce(lambda rest, r: F.when(rule_fits(r[1], host, path), F.lit(r[1])).otherwise(rest), ordered, none)
    verdict = reduce(lambda rest, r: F.when(rule_fits(r[1], host, path), F.lit(r[0])).otherwise(rest), ordered, none)
    return rule, verdict


def character_ngrams(mark: str, c: Column, lengths: Iterable[int] = LENGTHS) -> Column:
    """N-grams of ``^text$``, each behind ``mark``; digits count as one character."""
    text = F.concat(F.lit("^"), F.regexp_replace(F.lower(c), "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[of(n) for n in lengths])


def with_terms(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    return df.withColumn("terms", F.concat(character_ngrams("h", F.col(host)), character_ngrams("p", F.col(path))))


def learn(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None, hashes: int = HASHES, strength: float = 0.003, threshold: float = 0.4) -> PipelineModel:
    """Fits on a small table of (url, 1 for block), the built-in one by default."""
    rows = spark.createDataFrame(list(labelled_urls() if labelled is None else labelled), "url string, label int")
    table = with_terms(rows.select(host_of("url").alias("host"), path_of("url").alias("path"), F.col("label").cast("double").alias("label")))
    stages = [HashingTF(numFeatures=hashes, binary=True, inputCol="terms", outputCol="features"),
              LogisticRegression(regParam=strength, maxIter=100, standardization=False, threshold=threshold)]
    return Pipeline(stages=stages).fit(table.coalesce(1))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = tuple(RULES),
          model: PipelineModel | None = None) -> DataFrame:
    """Per row: key, host, path, rule, verdict (the rule's, else the model's).

    Everything runs in the JVM and row by row, so nothing is shuffled. A null url, or one without ``://``, has
    an empty host and path, no rule, and the model's verdict on them. Null and repeated keys are rows of
    their own; an empty table gives no rows; other columns are not read.
    """
    fitted = model or learn(pages.sparkSession)
    parts = pages.select(F.col(key).alias("k"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = fitted.transform(with_terms(parts))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    by_model = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    return scored.select(F.col("k").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"))
