"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation finds how far each is right.

Every rule looks at one figure of a text and votes good (1), bad (-1) or nothing (0). Without any label, EM
estimates for each rule how often its vote is right on good and on bad texts, and the share of good texts. The
posterior probability of being good then replaces "all rules must pass". Rows are reduced to counts per pattern
of votes first (at most 3 ** rules rows), so EM costs the same at any size of the input.

Defined results: a null text, an empty text and one of blanks only have no words and zero for every figure; they
fail the base rule. Repeated rows each get a row and count each in EM. An empty table gives an empty table; EM
then keeps its starting values. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, narrow
from plumbline.session import materialise

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BARE_WORD = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"  # a word without letter or digit
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if body names it often or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, other_than: str) -> Column:
    """How many code points are left when runs of ``other_than`` (a character class) are taken out."""
    return F.length(F.regexp_replace(text, f"{other_than}+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs at least twice, its first place included."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(rows: Column) -> Column:
        found = F.filter(rows, lambda r, k: (r.h == F.get(rows, k - 1).h) | (r.h == F.get(rows, k + 1).h))
        return F.sort_array(F.transform(found, lambda r: r.p))

    def count(h: Column) -> Column:
        slow = let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twice), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow)

    return let(words, lambda w: let(windows(w), count))


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The figures of every text that the rules look at, by built-in functions only."""
    read = narrow(docs, F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split("body", BLANKS), lambda w: w != "")
    return read.select(
        key,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        count_of(F.col("body"), r"[\x20\x09-\x0D]").alias("word_chars"),
        count_of(F.col("body"), f"[^{SYMBOLS}]").alias("n_symbols"),
        count_of(F.col("body"), r"\P{Lu}").alias("n_upper"),
        count_of(F.col("body"), "[^!]").alias("n_shouts"),
        F.regexp_count("body", F.lit(BARE_WORD)).cast("long").alias("n_bare_words"),
    ).select(
        key, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_shouts", "n_bare_words",
    )


@dataclass(frozen=True)
class Rule:
    """Bad above ``bad``, good up to ``good``, no vote between; ``share`` is null where the rule can't judge."""

    name: str
    share: Column
    good: float
    bad: float

    def vote(self) -> Column:
        return F.when(self.share.isNull(), 0).when(self.share > self.bad, -1).when(self.share <= self.good, 1).otherwise(0).cast("int")


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def default_rules() -> list[Rule]:
    length = share("word_chars", "n_words")
    long_enough = F.col("n_words") >= 20
    return [
        Rule("symbols", share("n_symbols", "word_chars"), 0.01, 0.05),
        Rule("symbols_per_word", share("n_symbols", "n_words"), 0.05, 0.2),
        Rule("bare_words", F.when(long_enough, share("n_bare_words", "n_words")), 0.05, 0.15),
        Rule("capitals", F.when(long_enough, share("n_upper", "word_chars")), 0.12, 0.3),
        Rule("shouts", share("n_shouts", "n_words"), 0.05, 0.3),
        Rule("same_lines", F.when(F.col("n_lines") > 1, share("n_dup_lines", "n_lines")), 0.1, 0.3),
        Rule("same_words", F.when(long_enough, share("n_repeat_words", "n_words")), 0.1, 0.3),
        Rule("word_length", F.when(long_enough, F.abs(length - 5.25)), 1.0, 1.6),
    ]


@dataclass(frozen=True)
class Fit:
    """Share of good texts, and for each rule how often its vote is right on good and on bad texts."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def weight(self, rule: int, vote: int) -> float:
        a, b = self.right_on_good[rule], self.right_on_bad[rule]
        return math.log(a / (1 - b)) if vote > 0 else math.log((1 - a) / b) if vote < 0 else 0.0

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for i, vote in enumerate(votes):
            odds = odds + F.when(vote > 0, self.weight(i, 1)).when(vote < 0, self.weight(i, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 60) -> Fit:
    """EM over counts of vote patterns. Pseudo-votes keep every estimate between 0 and 1."""
    now = Fit(0.9, (0.98,) * rules, (0.4,) * rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good_of = []
        for votes, _ in patterns:
            odds = math.log(now.prior / (1 - now.prior)) + sum(now.weight(i, v) for i, v in enumerate(votes))
            good_of.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        prior = (sum(g * n for g, (_, n) in zip(good_of, patterns)) + 9) / (total + 10)
        on_good, on_bad = [], []
        for i in range(rules):
            voted = [(g, n, v[i]) for g, (v, n) in zip(good_of, patterns) if v[i]]
            on_good.append((sum(g * n for g, n, v in voted if v > 0) + 9.8) / (sum(g * n for g, n, _ in voted) + 10))
            on_bad.append((sum((1 - g) * n for g, n, v in voted if v < 0) + 4) / (sum((1 - g) * n for g, n, _ in voted) + 10))
        now = Fit(prior, tuple(on_good), tuple(on_bad))
    return now


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, keep_from: float = 0.5) -> DataFrame:
    """``key``, the figures, ``base_failed``, the votes, ``quality`` (posterior probability) and ``kept``.

    ``kept`` is false where the base rule fails (fewer than 50 words, or more than half of them repeated), else
    whether ``quality`` is at least ``keep_from``. The figures are stored once; the fit and the result read them.
    """
    rules = default_rules() if rules is None else rules
    stored = materialise(figures(docs, key, text), "figures")
    names = [f"vote_{r.name}" for r in rules]
    voted = stored.withColumns({n: r.vote() for n, r in zip(names, rules)})
    counts = voted.groupBy(*names).count().collect()  # at most 3 ** rules rows
    model = fit([(tuple(row[:-1]), row[-1]) for row in counts], len(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumns({"base_failed": failed, "quality": model.posterior([F.col(n) for n in names])})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns.

    Rows are stored with their figures, so that each is judged by its own text: ids may repeat or be null, and no
    verdict is joined back.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))
    return quality(rows, "row", "body", rules, keep_from).where("kept").select("row.*")
