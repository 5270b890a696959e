"""Toxicity scores from a learned lexicon, fuzzy matching and the context of each match.

``fit`` learns from a bounded sample of labelled rows: whole words and beginnings of words that
stand in toxic texts far more often than chance allows, once or repeatedly, weighted by the
log-odds of each count; how much a misspelling of each term is worth; and how much a quoted
match is worth. ``score`` walks
every word of a text through the lexicon's trie intersected with Levenshtein automata of
distance one: states are sets of (trie node, edits), determinised as they are met, so that a
word costs one step for each letter and most words die after two. A match is worth less inside
quotation marks of the window around it.

Defined results: null and empty texts have no match and get the score of texts without one.
Repeated rows get equal scores. Without any toxic training row all scores are low. An empty table
gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import stored

#: Labelled rows that are learned from, chosen by a hash of their id.
FIT_ROWS = 12_000
PREFIXES = range(3, 9)
#: Counts of a term in a text that are told apart; the last is "or more".
LEVELS = 3
#: Least length of a term that may be misspelled.
FUZZY = 5
#: Characters before and after a match that are searched for quotation marks.
CONTEXT = 160
THRESHOLD = 0.7

_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>«»“”„‚‘’…*_-#%&|$/\\"
_OPEN = {"“": "”", "„": "“", "«": "»", "‘": "’", "‚": "‘"}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def folded(token: str) -> str:
    return token.lower().strip(_EDGE)


class Lexicon:
    """Terms in a trie, walked by a lazily determinised automaton of at most one edit.

    An edit is a letter more, less or other, or two neighbours that have changed places: for these a state
    remembers, beside the node behind both letters, the one that is still to come.

    ``behind`` has whole words with the number of the beginning that stands for them: a misspelt one
    counts as that beginning misspelt.
    """

    def __init__(self, terms: list[tuple[str, bool]], behind: list[tuple[str, int]] = ()):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.begin: dict[int, int] = {}
        for k, (term, prefix) in enumerate(terms):
            (self.begin if prefix else self.whole)[self._planted(term)] = k
        self.behind = {self._planted(word): k for word, k in behind if len(word) >= FUZZY}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[tuple[int, int], ...]] = []
        self.misspelt: list[tuple[tuple[int, int], ...]] = []
        self.begins: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({(0, 0)})

    def _planted(self, term: str) -> int:
        node = 0
        for letter in term:
            if letter not in self.child[node]:
                self.child[node][letter] = len(self.child)
                self.child.append({})
            node = self.child[node][letter]
        return node

    def _state(self, pairs: set[tuple[int, int | str]]) -> int:
        """The number of a set of (node, edits), closed under skipping a letter of the term."""
        swaps = {p for p in pairs if isinstance(p[1], str)}
        closed = pairs - swaps
        for node, edits in pairs:
            if edits == 0:
                closed.update((c, 1) for c in self.child[node].values())
        least: dict[int, int] = {}
        for node, edits in closed:
            least[node] = min(edits, least.get(node, 9))
        key = frozenset(least.items()) | swaps
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(self.whole[n], e) for n, e in key if n in self.whole and not isinstance(e, str)]
            self.accepts.append(tuple(sorted((k, e) for k, e in ends if e == 0 or len(self.terms[k][0]) >= FUZZY)))
            self.misspelt.append(tuple(sorted({(self.behind[n], 1) for n, e in key if e == 1 and n in self.behind})))
            self.begins.append(tuple(sorted((self.begin[n], 0) for n, e in key if e == 0 and n in self.begin)))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        pairs: set[tuple[int, int | str]] = set()
        for node, edits in self.sets[state]:
            if isinstance(edits, str):
                if letter == edits:
                    pairs.add((node, 1))
                continue
            if letter in self.child[node]:
                pairs.add((self.child[node][letter], edits))
            if edits == 0:
                for first, between in self.child[node].items():
                    if first != letter and letter in self.child[between]:
                        pairs.add((self.child[between][letter], first))
                pairs.add((node, 1))
                pairs.update((c, 1) for c in self.child[node].values())
        self.next[state][letter] = made = self._state(pairs) if pairs else -1
        return made

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms that are the word, or begin it, with at most one edit."""
        state, found, steps = self.start, (), self.next
        for letter in word:
            to = steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return found
            if self.begins[state]:
                found += self.begins[state]
        if self.misspelt[state]:
            found += tuple(m for m in self.misspelt[state] if (m[0], 0) not in found)
        return found + self.accepts[state]


def quoted(text: str, start: int, end: int) -> bool:
    """The match stands between quotation marks of its line, within the context window."""
    before = text[max(0, start - CONTEXT) : start].rpartition("\n")[2]
    after = text[end : end + CONTEXT].partition("\n")[0]
    if before.count('"') % 2 and '"' in after:
        return True
    return any(before.rfind(a) > before.rfind(b) and b in after for a, b in _OPEN.items())


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    #: For each term what one, two, and three or more matches are worth.
    exact: list[list[float]] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    quote: float = 1 / 3
    prior: float = -3.0
    none: float = -6.0
    #: Whole words that a chosen beginning explains, with the number of that beginning.
    behind: list[tuple[str, int]] = field(default_factory=list)


class Matcher:
    """Matches of texts; remembers what each distinct token matches."""

    def __init__(self, terms: list[tuple[str, bool]], behind: list[tuple[str, int]] = ()):
        self.lexicon, self.known = Lexicon(terms, behind), {}

    def matches(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(term, edits, quoted) of each match."""
        tokens = _TOKEN.findall(text or "")
        distinct = set(tokens)
        known = self.known
        if len(known) > 400_000:
            known.clear()
        hits = {}
        for token in distinct:
            found = known.get(token)
            if found is None:
                known[token] = found = self.lexicon.match(folded(token))
            if found:
                hits[token] = found
        if not hits:
            return []
        out = []
        for place in _TOKEN.finditer(text):
            if place.group() in hits:
                inside = quoted(text, place.start(), place.end())
                out += [(k, e, inside) for k, e in hits[place.group()]]
        return out


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of at most ``rows`` labelled rows, one of each group of copies.

    Of copies with different labels a toxic one stays, then the one of the smallest id.
    """
    train = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    # at most `rows` ids: small enough to send to all tasks
    chosen = train.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("doc_id")).limit(rows)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")

    def least(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = (text or "").split()
            hashes = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
            out.append((min(hashes), min(h * 0x9E3779B1 % 2**32 for h in hashes)))
        return pd.DataFrame(out, columns=["a", "b"])

    marked = joined.withColumn("_least", F.pandas_udf(least, "a long, b long")("_text"))
    place = F.struct(-F.col("_toxic"), "doc_id", F.xxhash64("_text"))
    kept = marked.select(F.col("_least.a").alias("_a"), F.col("_least.b").alias("_b"), "doc_id", "_text", "_toxic")
    for key in ("_a", "_b"):
        row = F.struct("_a", "_b", "doc_id", "_text", "_toxic")
        kept = kept.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, place).alias("_row")).select("_row.*")
    return kept.select("_text", "_toxic")


def _features(text: str | None) -> set[str]:
    """Words and beginnings of words (with a star), after the count that they reach in the text."""
    counts: Counter = Counter()
    for token, n in Counter(_TOKEN.findall(text or "")).items():
        word = folded(token)
        if len(word) > 2:
            counts[word] += n
        for size in PREFIXES:
            if len(word) > size:
                counts[word[:size] + "*"] += n
    return {f"{k}{term}" for term, n in counts.items() for k in range(1, min(n, LEVELS) + 1)}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's rows: how many toxic and other texts have each feature. Bounded by the sample."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flushed() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in reversed(counts))]
        counts[0].clear()
        counts[1].clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "other"])

    for batch in batches:
        for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
            counts[toxic == 1].update(_features(text))
            counts[toxic == 1][""] += 1
            if len(counts[0]) > 200_000:
                yield flushed()
    yield flushed()


def _evidence(toxic: int, other: int, share: float) -> float:
    """Log-likelihood ratio of a feature's rows being toxic more often than all rows are."""
    n = toxic + other
    part = lambda k, p: k * math.log(k / (n * p)) if k else 0.0
    return part(toxic, share) + part(other, 1 - share)


def _stem(feature: str) -> str:
    return feature[1:].rstrip("*")


def _chosen(rows: list[tuple[int, list[str]]], strong: dict[str, float], need: float, share: float) -> list[tuple[str, bool]]:
    """Terms whose evidence does not rest on texts that a related, stronger term has explained.

    Terms are related if one begins with the other.
    """
    having: dict[str, set[int]] = {}
    for k, (_, features) in enumerate(rows):
        for feature in features:
            having.setdefault(feature, set()).add(k)
    terms: list[tuple[str, bool]] = []
    explained: list[tuple[str, set[int]]] = []
    by_strength = sorted(strong, key=lambda f: (-strong[f], f.endswith("*"), -len(f), f))
    for feature in by_strength:
        stem, left = _stem(feature), having.get(feature, set())
        for other, texts in explained:
            if stem.startswith(other) or other.startswith(stem):
                left = left - texts
        toxic = sum(rows[k][0] for k in left)
        if toxic * 2 > len(left) and _evidence(toxic, len(left) - toxic, share) >= need:
            explained.append((stem, having[feature]))
            term = (stem, feature.endswith("*"))
            if term not in terms:
                terms.append(term)
    return terms


def _behind(terms: list[tuple[str, bool]], strong: dict[str, float]) -> list[tuple[str, int]]:
    """Strong whole words that are no terms because a beginning has explained them, with its number."""
    begins = sorted(((stem, k) for k, (stem, prefix) in enumerate(terms) if prefix), key=lambda b: -len(b[0]))
    out = []
    for word in sorted(_stem(f) for f in strong if f[0] == "1" and not f.endswith("*")):
        number = next((k for stem, k in begins if word.startswith(stem)), None)
        if number is not None and (word, False) not in terms:
            out.append((word, number))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn terms and weights from at most ``rows`` labelled rows that are not held out.

    What reaches the driver are the features of these rows whose evidence is strong enough, however many,
    and for each row which of them it has.
    """
    sample = stored(_sample(docs, labels, rows), "toxicity-sample")
    counts = sample.mapInArrow(_count_features, "feature string, toxic long, other long")
    summed = stored(counts.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")), "toxicity-counts")
    total = summed.filter("feature = ''").first()
    model = Model()
    if total is None or not total["t"] or not total["o"]:
        return model
    n_toxic, n_other = total["t"], total["o"]
    share = n_toxic / (n_toxic + n_other)
    model.prior = math.log(share / (1 - share))
    need = math.log(max(2, summed.count())) + 1
    n = F.col("t") + F.col("o")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    near = part(F.col("t"), share) + part(F.col("o"), 1 - share) >= need - 0.001
    strong = {
        feature: evidence
        for feature, t, o in summed.filter((F.col("feature") != "") & (F.col("t") >= 3) & (F.col("t") > F.col("o")) & near).collect()
        if (evidence := _evidence(t, o, share)) >= need
    }

    def find_strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(f for f in _features(t) if f in strong) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    having = sample.mapInArrow(find_strong, "toxic int, found array<string>").filter(F.size("found") > 0).collect()
    terms = model.terms = _chosen([(int(r[0] == 1), r[1]) for r in having], strong, need, share)
    behind = model.behind = _behind(terms, strong)

    def count_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by term and count of matches; misspelled ones have count 0, quoted ones term -1, none at all term -2."""
        matcher, seen = Matcher(terms, behind), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                found = matcher.matches(text)
                exact = Counter(k for k, e, _ in found if e == 0)
                which = {(k, min(n, LEVELS)) for k, n in exact.items()}
                if not exact:
                    which |= {(k, 0) for k, e, _ in found if e}
                if any(q for *_, q in found):
                    which.add((-1, 0))
                seen[toxic == 1].update(which or {(-2, 0)})
        keys = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        columns += [pa.array([c[k] for k in keys], pa.int64()) for c in reversed(seen)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "toxic", "other"])

    found = sample.mapInArrow(count_matches, "term long, n long, toxic long, other long")
    summed_by = found.groupBy("term", "n").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).collect()
    by_term = {(r["term"], r["n"]): (r["t"], r["o"]) for r in summed_by}
    odds = lambda t, o: math.log((t + 0.5) / (n_toxic + 1)) - math.log((o + 0.5) / (n_other + 1))
    for k in range(len(terms)):
        weights = [odds(*by_term.get((k, n), (0, 0))) for n in range(1, LEVELS + 1)]
        # more matches are never worth less
        model.exact.append([max(weights[: n + 1]) for n in range(LEVELS)])
        t, o = by_term.get((k, 0), (0, 0))
        # without evidence a misspelling is worth half the term; texts that have it count against it
        model.fuzzy.append(weights[0] / 2 if t + o == 0 else min(weights[0], odds(t, o)))
    t, o = by_term.get((-1, 0), (0, 0))
    model.quote = (t + 1) / (t + o + 3)
    t, o = by_term.get((-2, 0), (0, 0))
    model.none = min(model.prior, math.log((t + 0.5) / (o + 1)))
    return model


def score_of(model: Model, found: list[tuple[int, int, bool]]) -> float:
    plain = Counter(k for k, edits, inside in found if not edits and not inside)
    worth = {k: model.exact[k][min(n, LEVELS) - 1] for k, n in plain.items()}
    for k, edits, inside in found:
        if edits or inside:
            weight = model.fuzzy[k] if edits else model.exact[k][0]
            weight *= model.quote if inside and weight > 0 else 1
            worth[k] = max(weight, worth.get(k, -math.inf))
    best = sorted((w for w in worth.values() if w > 0), reverse=True)[:3]
    logit = model.prior + sum(w / (1 << k) for k, w in enumerate(best)) if best else model.none
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.behind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = [score_of(model, matcher.matches(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
