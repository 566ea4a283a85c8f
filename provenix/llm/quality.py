"""Quality rules as weak supervision, in native DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. No rule is trusted outright:
expectation-maximisation over the counts of vote patterns estimates how often each rule gives each vote on good documents and on each
kind of junk, and a document is kept when its posterior probability of being good reaches a threshold.
There are at most 3**rules patterns however many documents, so the counts fit on the driver, and they cover all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import Store, settle

BLANK = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _bare(text: Column) -> Column:
    return F.translate(text, " " + BLANK, "")


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need; a null text counts as empty.

    Windows of three words are compared by 64-bit hashes of their words and, only if a hash occurs twice in a text,
    sorted with their positions; both steps are linear or n log n in the text's length.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.withColumn("_t", text)
    words = F.filter(F.split(F.translate("_t", BLANK, " " * len(BLANK)), " "), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: _bare(x) != "")
    one = one.select(
        "*", words.alias("_w"), lines.alias("_l"),
        F.length(_bare(F.col("_t"))).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "|", ""))).cast("long").alias("_pipes"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("_bangs"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("_upper"),
        (F.length("_t") - F.length(F.translate("_t", ".,;:?", ""))).cast("long").alias("_stops"),
    )
    two = one.select(
        "*", F.size("_w").cast("long").alias("n_words"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("_lines"),
        F.expr("case when size(_w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end").alias("_h"),
        F.size(F.array_distinct("_w")).cast("long").alias("_kinds"),
    )
    # hashes that occur twice or more, then the positions of their windows, in order
    three = two.select(
        "*",
        F.expr("""case when size(_h) < 2 or size(array_distinct(_h)) = size(_h) then cast(array() as array<struct<h: bigint, i: int>>)
                  else array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) end""").alias("_s"),
    )
    four = three.select(
        "*",
        F.expr("""case when size(_s) = 0 then cast(array() as array<int>) else array_sort(transform(
                  filter(_s, (x, i) -> (i > 0 and _s[i - 1].h = x.h) or (i < size(_s) - 1 and _s[i + 1].h = x.h)), x -> x.i)) end""").alias("_p"),
    )
    return four.withColumn("n_repeat_words", F.expr("case when size(_p) = 0 then 0L else aggregate(transform(_p, (x, i) -> case when i < size(_p) - 1 then cast(least(3, _p[i + 1] - x) as bigint) else 3L end), 0L, (a, b) -> a + b) end")).drop(
        "_t", "_w", "_l", "_h", "_s", "_p"
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def rules() -> dict[str, Column]:
    """Votes by measure, in whole numbers: bad (-1), good (1), or abstaining between the two. No rule is trusted by itself."""

    def vote(bad: str, good: str) -> Column:
        return F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end")

    return {
        "symbols": vote("5 * (n_symbols - _pipes) > n_words", "25 * (n_symbols - _pipes) <= n_words"),
        "bars": vote("10 * _pipes > n_words", "50 * _pipes <= n_words"),
        "marks": vote("100 * n_symbols > 5 * word_chars", "100 * n_symbols <= word_chars"),
        "shouting": vote("10 * _bangs > n_words", "50 * _bangs <= n_words"),
        "capitals": vote("10 * _upper > 3 * word_chars", "20 * _upper <= 3 * word_chars"),
        "repeats": vote("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
        "lines": vote("_lines > 3 and 10 * n_dup_lines > 3 * _lines", "10 * n_dup_lines <= _lines"),
        # the words of prose grow at least with the root of its length; both bounds meet at 4000 words, so none of them switches the rule off
        "variety": vote("20 * _kinds < n_words and _kinds * _kinds < 10 * n_words", "5 * _kinds >= n_words"),
        "punctuation": vote("500 * _stops < n_words", "40 * _stops >= n_words"),
        "length": vote("2 * word_chars < 5 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    }


#: Prior belief, the same for all rules, by vote (bad, abstaining, good): on good documents, of a kind of junk's own rule, of the other rules on it. It
#: counts as many documents as WEIGHT of the corpus, so that estimates do not depend on the corpus's size.
ON_GOOD, ON_OWN, ON_OTHER = (0.05, 0.15, 0.8), (0.8, 0.1, 0.1), (1 / 3, 1 / 3, 1 / 3)
WEIGHT = 0.001


def fit(counts: list[tuple[tuple[int, ...], int]], prior: float = 0.9, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """counts: (votes, documents). Returns the share of each class and, by class, rule and vote (-1, 0, 1), its probability. Class 0 is good.

    Junk is of several kinds that share no signs, which one bad class can't hold: there is a class for each rule, that of the documents its rule mostly
    calls bad (in half of them at least; that is what the class means). How reliable a rule is, how its votes go with those of others, and how common each
    kind of junk is, is all estimated. A bad vote that its kind's other votes don't bear out is outweighed by good ones. Deterministic: patterns are
    taken in order, and the first round begins from how many bad votes a pattern has.
    """
    counts = sorted(counts)
    votes = np.array([v for v, _ in counts], np.int64).reshape(len(counts), -1)
    n = np.array([c for _, c in counts], float)
    rules = votes.shape[1]
    seen = np.stack([votes == k for k in (-1, 0, 1)], 2).astype(float)
    base = np.full((rules + 1, rules, 3), ON_OTHER)
    base[0] = ON_GOOD
    base[np.arange(1, rules + 1), np.arange(rules)] = ON_OWN
    weight = max(1.0, WEIGHT * n.sum())
    shares = np.r_[prior, np.full(rules, (1 - prior) / max(1, rules))]
    bad = (votes < 0).astype(float)
    n_bad = bad.sum(1, keepdims=True)
    good = np.where(n_bad > 0, 1 - prior, prior)
    belief = np.hstack([good, np.where(n_bad > 0, bad / np.maximum(n_bad, 1), 1 / max(1, rules)) * (1 - good)])
    mix, table = shares, base
    for _ in range(rounds):
        w = belief * n[:, None]
        mix = (w.sum(0) + weight * shares) / (n.sum() + weight)
        table = np.einsum("pk,pjv->kjv", w, seen) + weight * base
        table /= table.sum(2, keepdims=True)
        for j in range(rules):
            own = table[j + 1, j]
            if own[0] < 0.5:
                own[1:] *= 0.5 / own[1:].sum()
                own[0] = 0.5
        x = np.einsum("pjv,kjv->pk", seen, np.log(table)) + np.log(mix)
        x = np.exp(x - x.max(1, keepdims=True))
        belief = x / x.sum(1, keepdims=True)
    return mix, table


def posterior(mix: np.ndarray, table: np.ndarray, names: list[str]) -> Column:
    """The probability of the good class given a row's votes."""

    def fits(k: int) -> Column:
        x = F.lit(float(np.log(mix[k])))
        for name, p in zip(names, np.log(table[k]).tolist(), strict=True):
            x = x + F.when(F.col(name) == -1, F.lit(p[0])).when(F.col(name) == 1, F.lit(p[2])).otherwise(F.lit(p[1]))
        return x

    good = fits(0)
    return 1 / (1 + sum((F.exp(F.least(fits(k) - good, F.lit(700.0))) for k in range(1, len(mix))), F.lit(0.0)))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) of every row.

    kept is false if the base fails, else whether the posterior probability reaches the threshold. An empty or null text
    fails the base. Documents that fail the base vote in the estimation like the rest. Repeated rows are judged alike.
    """
    votes = rules()
    names = [f"_v_{k}" for k in votes]
    read = with_measures(docs.select("doc_id", "text"))
    read = read.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *(c.alias(f"_v_{k}") for k, c in votes.items()))
    read = settle(read)
    p = posterior(*_estimated(read, names), names)
    return read.withColumn("probability", p).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept")
    )


def _estimated(votes: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    seen = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3**10 rows, whatever the corpus
    return fit([(tuple(r[k] for k in names), r["n"]) for r in seen] or [((0,) * len(names), 1)])


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their own columns. They are measured once: rows and votes are stored, then filtered by what the votes of all rows tell."""
    votes = rules()
    names = [f"_v_{k}" for k in votes]
    own = docs.columns
    boxed = docs.select(F.struct(*own).alias("_row"), F.col("text"))
    read = Store(docs.sparkSession, "quality").keep(with_measures(boxed).select("_row", base_failed().alias("_failed"), *(c.alias(f"_v_{k}") for k, c in votes.items())))
    return read.where(~F.col("_failed") & (posterior(*_estimated(read, names), names) >= threshold)).select("_row.*")
