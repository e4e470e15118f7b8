"""Toxicity by a lexicon, Levenshtein automata and context windows.

A word is matched by running the Levenshtein automata of two lexicon tries: of fixed terms, and of terms that labelled
texts show as toxic. States are sets of (trie node, edits so far), made deterministic as words are read, so misspelled
terms are found in one pass over a word's characters. A learned term may be misspelled as far as the words near it
stay toxic in the labelled texts. Every hit is scored in its window of words: quotation marks and reporting words mark
mention, second persons mark abuse. The few numbers that hits leave of a text go into a logistic model around fixed
prior weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, remove, table, text_of, written
from .linear import fit, logits, sigmoid

#: Abusive words, and the words of a window that mark mention or address.
LEXICON = "bastard clown cretin disgusting dumbass fool garbage idiot imbecile jerk loser lowlife moron pathetic scum stupid trash ugly vermin worthless".split()
REPORTING = set("said says say wrote writes called calls quoted quote quotes word words term according reported sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = set("you your yours yourself ya u du dich dir dein deine ihr euch sie tu toi ton ta vous votre tú te ti usted ustedes vosotros".split())
#: Quotation marks by their closing ones; a quotation ends with its line.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
MARK = re.compile(f"[{''.join(QUOTES)}”»’\n]")
WORD = re.compile(r"[^\W_]+")
#: Words on each side of a hit that are its context.
WINDOW = 6
#: Edits allowed in a term, by least length; the first letters of a learned term that must be right.
EDITS, LEARNED_PREFIX = ((9, 2), (5, 1), (0, 0)), 3
#: Most labelled rows that the model is fitted on, most learned terms, and a predicted 1 from this score.
TRAIN_ROWS, LEARNED_TERMS, THRESHOLD = 20_000, 500, 0.7
#: Words near a term that several harmless labelled texts hold, and no fewer toxic ones, are no misspellings; at most so many are kept.
HARMLESS_WORDS = 5000
#: Least share of toxic texts among those that hold a learned term, or a word near it; least letters of such a term.
STRONG, LEAST_LETTERS = 0.8, 4
#: Words that a worker remembers as harmless, and states of an automaton that it keeps.
KNOWN_WORDS, KNOWN_STATES = 400_000, 100_000
FEATURES = ("direct_exact", "direct_misspelled", "direct_learned", "direct_learned_misspelled", "mentioned", "addressed", "terms", "density")
#: Weights before any label is seen, the bias last.
PRIOR = (3.0, 1.5, 2.5, 1.0, 0.2, 0.5, 0.5, 0.2, -3.0)
PRIOR_STRENGTH = 0.5


def edits_for(term: str) -> int:
    return next(k for least, k in EDITS if len(term) >= least)


class LevenshteinTrie:
    """Terms with the edits that each allows; the first `prefix` letters of a word must be the term's."""

    def __init__(self, terms: dict[str, int], prefix: int = 0):
        self.allowed, self.prefix = terms, prefix
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.term, self.depth = [0], [None], [0]
        for text, allowed in terms.items():
            node = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.term.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.term[node] = text
        self.letters = {c for kids in self.children for c in kids}
        self._reset()

    def _reset(self) -> None:
        self.number, self.states, self.steps, self.accepts = {}, [], [], []
        self._state(self._closure({0: 0}))

    def _closure(self, state: dict[int, int]) -> dict[int, int]:
        """Adds nodes reached by leaving out letters of terms."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if self.depth[node] < self.prefix:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.accepts.append(sorted((e, self.term[n]) for n, e in state.items() if self.term[n] and e <= self.allowed[self.term[n]]))
        return self.number[key]

    def _step(self, at: int, c: str) -> int:
        """The state after one more character of the word; -1 when nothing can match any more."""
        following: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.budget[node] and following.get(node, 99) > e:
                following[node] = e

        for node, e in self.states[at].items():
            kids = self.children[node]
            if c in kids and following.get(kids[c], 99) > e:
                following[kids[c]] = e
            if self.depth[node] >= self.prefix:
                for child in kids.values():
                    reach(child, e + 1)
                reach(node, e + 1)
        out = self._state(self._closure(following)) if following else -1
        self.steps[at][c] = out
        return out

    def matches(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) of every term within its allowed edits, nearest first."""
        if len(self.states) > KNOWN_STATES:
            self._reset()
        at, steps, letters = 0, self.steps, self.letters
        for c in word:
            c = c if c in letters else ""
            following = steps[at].get(c)
            at = self._step(at, c) if following is None else following
            if at < 0:
                return []
        return self.accepts[at]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term."""
        found = self.matches(word)
        return (found[0][1], found[0][0]) if found else None


@dataclass
class Model:
    """learned: (term, edits) from labelled texts; harmless: words near a term; weights: of FEATURES, the bias last."""

    learned: list[tuple[str, int]] = field(default_factory=list)
    harmless: list[str] = field(default_factory=list)
    weights: tuple[float, ...] = PRIOR


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of quotations, in one pass over the marks of a text."""
    spans, opened = [], None
    for m in MARK.finditer(text):
        c = m[0]
        if c == "\n":
            opened = None
        elif opened is None:
            if c in QUOTES:
                opened = (m.start(), QUOTES[c])
        elif c in opened[1]:
            spans.append((opened[0], m.end()))
            opened = None
    return spans


class Scanner:
    """Features of texts. A worker makes one for a model and keeps what it learns about words."""

    def __init__(self, model: Model):
        self.tries = (LevenshteinTrie({t: edits_for(t) for t in LEXICON}), LevenshteinTrie(dict(model.learned), LEARNED_PREFIX))
        self.never = frozenset(model.harmless)
        self.harmless: set[str] = set(self.never)
        self.found: dict[str, tuple[str, int, int]] = {}

    def look_up(self, word: str) -> tuple[str, int, int] | None:
        """(term, edits, trie) of the nearest term; of equals the fixed one."""
        options = [(found[1], n, found[0]) for n, trie in enumerate(self.tries) if (found := trie.match(word))]
        if not options:
            return None
        edits, n, term = min(options)
        return term, edits, n

    def hits(self, words: set[str]) -> dict[str, tuple[str, int, int]]:
        """Of the words those that match, with term, edits and trie."""
        out = {}
        for w in words - self.harmless:
            known = self.found.get(w) or self.look_up(w)
            if known is None:
                self.harmless.add(w)
            else:
                self.found[w] = out[w] = known
        if len(self.harmless) > KNOWN_WORDS:
            self.harmless = set(self.never)
        if len(self.found) > KNOWN_WORDS:
            self.found.clear()
        return out

    def features(self, text: str) -> tuple[float, ...]:
        low = text.lower()
        matched = self.hits(set(WORD.findall(low)))
        if not matched:
            return (0.0,) * len(FEATURES)
        spans = quoted_spans(low)
        tokens = [(m[0], m.start()) for m in WORD.finditer(low)]
        kind, mention, address, terms, k = [0.0] * 4, 0.0, 0.0, set(), 0
        for i, (word, start) in enumerate(tokens):
            hit = matched.get(word)
            if hit is None:
                continue
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            near = {t for t, _ in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
            addressed = not ADDRESS.isdisjoint(near)
            share = self.directness(k < len(spans) and spans[k][0] <= start, not REPORTING.isdisjoint(near), addressed)
            term, edits, n = hit
            kind[2 * n + (edits > 0)] += share / (1 + edits)
            mention += 1 - share
            address += share * addressed
            terms.add(term)
        direct = sum(kind)
        return (*map(lambda x: float(np.log1p(x)), (*kind, mention, address, len(terms) if direct >= 0.5 else 0, 100 * direct / len(tokens))),)

    @staticmethod
    def directness(inside_quotes: bool, reporting: bool, addressed: bool) -> float:
        """1: abuse; towards 0: somebody's words are mentioned."""
        out = 0.15 if inside_quotes and reporting else 0.4 if inside_quotes else 0.8 if reporting else 1.0
        return min(1.0, out * 1.5) if addressed else out


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(model: Model) -> Scanner:
    key = (tuple(model.learned), tuple(model.harmless))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(model)
    return _SCANNERS[key]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y): at most `rows` labelled documents of the training folds, by the order of a hash of the id.

    Of rows that share an id the least text counts, of equal texts one; an id or a text with both labels is toxic.
    """
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y"))
    ids = ids.filter("doc_id is not null and y is not null").filter(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    once = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # at most `rows` pairs are broadcast
    return once.groupBy(F.sha2("text", 256)).agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _counted(sample: DataFrame, count, columns: str) -> DataFrame:
    """(columns, t, n): what count(text) gives for each text of a sample, with the numbers of toxic and of all such
    texts, added up in every task before the shuffle."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"]):
                found = count(text)
                every.update(found)
                if y:
                    toxic.update(found)
            yield pd.DataFrame([(*k, toxic[k], n) for k, n in every.items()], columns=[*names, "t", "n"])

    return sample.mapInPandas(run, f"{columns}, t long, n long").groupBy(*names).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def learn_terms(sample: DataFrame, most: int = LEARNED_TERMS) -> Model:
    """Terms that a labelled sample shows as toxic, how far they may be misspelled, and the harmless words near terms.

    Of the words that STRONG of at least three texts show as toxic at most `most`, those in most toxic texts, are
    tried. A term's edits are the most, within what its length allows, at which STRONG of the texts with a word that
    near are toxic and so many are that chance among all words would hardly give them; without such a number it goes.
    """
    base = sample.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    if not base["n"] or not base["t"] or base["t"] == base["n"]:
        return Model()
    fixed = LevenshteinTrie({t: edits_for(t) for t in LEXICON})
    words = written(_counted(sample, lambda text: {(w,) for w in WORD.findall(text.lower()) if len(w) >= LEAST_LETTERS}, "word string"), "words")
    every = words.agg(F.sum("n")).first()[0] or 0
    least = max(3, int(np.ceil(np.log(max(every, 10) / 0.01) / np.log(base["n"] / base["t"]))))
    good = words.filter((F.col("t") >= 3) & (F.col("t") >= STRONG * F.col("n"))).orderBy(F.desc(F.col("t") * F.col("t") / F.col("n")), "word")
    terms = [r["word"] for r in good.limit(most + len(LEXICON)).collect()]
    terms = [t for t in terms if not fixed.match(t)][:most]
    trie = LevenshteinTrie({t: edits_for(t) for t in terms}, LEARNED_PREFIX)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bool(fixed.match(w) or trie.match(w)) and w not in trie.allowed and w not in fixed.allowed for w in batch["word"]]
            yield batch[np.array(found, dtype=bool)]

    clean = words.filter((F.col("n") - F.col("t") > 1) & (2 * F.col("t") < F.col("n"))).mapInPandas(near, words.schema)
    harmless = [r["word"] for r in clean.orderBy(F.desc("n"), "word").limit(HARMLESS_WORDS).collect()]
    remove(sample.sparkSession, words)
    known = frozenset(harmless)

    def nearest(text: str) -> set[tuple[str, int]]:
        best: dict[str, int] = {}
        for w in set(WORD.findall(text.lower())) - known:
            for edits, term in trie.matches(w):
                best[term] = min(edits, best.get(term, 99))
        return set(best.items())

    at = {(r["term"], r["edits"]): (r["t"], r["n"]) for r in _counted(sample, nearest, "term string, edits long").collect()} if terms else {}  # three rows a term
    learned = []
    for term in sorted(terms):
        edits, t, n = None, 0, 0
        for e in range(edits_for(term) + 1):
            more = at.get((term, e), (0, 0))
            t, n = t + more[0], n + more[1]
            if t >= max(least, STRONG * n):
                edits = e
        if edits is not None:
            learned.append((term, edits))
    return Model(learned, harmless)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most `rows` labelled documents; without labels of both kinds the prior weights."""
    bounded_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, rows), "toxicity-sample")
    model = learn_terms(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(model)
        for batch in batches:
            yield pd.DataFrame([(y, *scanner.features(t)) for y, t in zip(batch["y"], batch["text"])], columns=["y", *FEATURES])

    schema = "y double, " + ", ".join(f"{f} double" for f in FEATURES)
    found = sample.mapInPandas(measure, schema).toPandas().to_numpy(dtype=float)  # at most `rows` rows of numbers
    remove(docs.sparkSession, sample)
    if len(found):
        model.weights = tuple(fit(found[:, 1:], found[:, 0], np.array(PRIOR), PRIOR_STRENGTH).tolist())
    return model


def score_column(text: Column, model: Model) -> Column:
    """0 to 1: the probability of label 1; a text without hits, or empty, has the score of the bias alone."""
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _scanner(model)
        for texts in parts:
            found = np.array([scanner.features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(np.round(sigmoid(logits(found, weights)), 6))

    return run(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row.

    Null texts count as empty; repeated rows score alike; a null doc_id is scored and isn't held out; an empty table
    gives an empty table; extra columns are ignored; long texts are scored whole.
    """
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score_column(text_of(docs), train(docs, labels)).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; all columns stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    scored = docs.select(*names, score_column(text_of(docs), train(docs, labels)).alias("__toxicity"))
    return scored.filter(F.col("__toxicity") < threshold).select(*names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
