"""Quality rules as a ledger of bits: evaluate once, then apply and compare policies.

``ledger`` measures each text once and stores measurements and one failure bit for each rule.
A policy is a versioned mask of rules; a document goes if any rule of the mask failed.
``ablations`` counts, over the ledger and labels, what each rule of a policy decides.

Everything is column expressions, for the ledger over one row: no shuffle, no Python. Windows of words are
compared by 64-bit hashes within their text.

Defined results: null and empty texts have no words and fail ``few_words``. Repeated rows are
judged one by one. An empty table gives an empty ledger. Columns other than ``doc_id`` and
``text`` are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import SPACES, let, stored, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule names by bit, and what makes a rule fail.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_full_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: Versions of the policy; a document stays if none of the version's rules failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols"),
    "v3": (*BASE, "symbols", "repeated_lines"),
    "v4": tuple(RULES),
}
#: Ablations over labelled rows (``quality_ablations``): what ``repeated_lines`` alone rejects is mostly labelled good, and
#: later stages drop the lines themselves; the rules of word lengths reject nothing more.
CURRENT = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(BIT[r] for r in rules)


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of eight words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda e, j: e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"]),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        widths = let(
            starts,
            lambda p: F.transform(
                p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))
            ),
        )
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: one bit for each rule that the text fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    per_word = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeats")),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")),
    )
    measured = docs.select(
        "doc_id",
        per_word.alias("w"),
        lines.alias("l"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    ).select(
        "doc_id",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.col("l.n") - F.col("l.distinct")).cast("long").alias("n_dup_lines"),
        F.col("w.repeats").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_full_lines"),
    )
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(judged: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    failed = F.col("failed")
    return judged.withColumns(
        {
            "base_failed": failed.bitwiseAND(mask_of(BASE)) != 0,
            "kept": failed.bitwiseAND(mask_of(POLICIES[version])) == 0,
        }
    )


def store_ledger(docs: DataFrame) -> DataFrame:
    """The ledger written once in the shared folder; policies and ablations read it from there."""
    return stored(ledger(docs), "quality-ledger")


def ablations(judged: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """For each policy and rule: documents, those rejected, failed by the rule, rescued without it.

    With ``labels`` (doc_id, quality) also how many of the rescued are labelled good, and poor; of
    several labels of a document the best counts. The ledger is first reduced to one row for each
    pattern of bits, of which there are at most two to the number of rules.
    """
    tests = F.array(
        *[
            F.struct(
                F.lit(version).alias("policy"),
                F.lit(rule).alias("rule"),
                F.lit(mask_of(rules)).alias("mask"),
                F.lit(BIT[rule]).alias("bit"),
            )
            for version, rules in POLICIES.items()
            for rule in rules
        ]
    )
    sizes = {"n": F.count("*")}
    if labels is not None:
        best = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        judged = judged.join(best, "doc_id", "left")
        sizes |= {name: F.count_if(F.col("_quality") == mark) for name, mark in (("good", 1), ("poor", 0))}
    patterns = judged.groupBy("failed").agg(*[size.alias(name) for name, size in sizes.items()])
    hit = F.col("failed").bitwiseAND(F.col("t.mask"))
    count = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0))
    rescued = hit == F.col("t.bit")
    return (
        patterns.select("failed", *sizes, F.explode(tests).alias("t"))
        .groupBy(F.col("t.policy").alias("policy"), F.col("t.rule").alias("rule"))
        .agg(
            F.sum("n").alias("n_docs"),
            count(hit != 0).alias("n_rejected"),
            count(hit.bitwiseAND(F.col("t.bit")) != 0).alias("n_failed"),
            count(rescued).alias("n_rescued"),
            *[count(rescued, of).alias(f"n_rescued_{of}") for of in sizes if of != "n"],
        )
    )


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    kept = apply_policy(ledger(inner), version).filter("kept")
    return kept.select("doc_id.*")
