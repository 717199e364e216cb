"""Toxicity: a learned lexicon, matched with Levenshtein automata, weighed by context.

A bounded sample of labelled texts gives the lexicon: whole words, and stems that start words, which occur in toxic
texts and hardly in others. Its trie is intersected with Levenshtein automata, one error for terms of `one_error`
letters or more, two from `two_errors`, in words and in stems alike; the product is determinised lazily, so that a token costs a table lookup a
letter and most tokens die within a few letters. Each hit is scored by its window of words: quotation marks and words of
report lower it, direct address raises it. A logistic model of the document's hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices
from .labelled import apply_logistic, fit_logistic, labelled_sample, remainder, shifted

WORD = re.compile(r"\w+")
#: A word as it is matched: @ and $ may stand for letters of it.
TOKEN = re.compile(r"[@$]*\w[\w@$]*|[@$]{3,}")
# Digits and signs that stand for letters, marks of quotation, words of report, words of address.
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”„«»‘’"
REPORT = frozenset("said says called calls wrote word words term quote quoted quotes means meaning defined translated dit mot wort sagte palabra dijo".split())
ADDRESS = frozenset("you your youre u ur du dich ihr tu toi vous te tú vos usted".split())


@dataclass(frozen=True)
class Params:
    per_class: int = 2000  #: most labelled texts of each class that the model is fitted on
    least_toxic: int = 6  #: toxic texts of the sample that hold a term, and the least share of them
    least_share: float = 0.005
    precision: float = 0.9  #: toxic share, at equal class sizes, of the texts that hold a term
    most_terms: int = 2000
    stems: tuple[int, int] = (4, 7)
    one_error: int = 5
    two_errors: int = 9
    window: int = 5


class Automaton:
    """The lexicon's trie times its Levenshtein automata, determinised as tokens need it.

    terms: name to True for a stem (what starts with it matches), False for a whole word.
    """

    def __init__(self, terms: dict[str, bool], one_error: int = 5, two_errors: int = 9, most_states: int = 200_000):
        self.terms, self.most_states = list(terms), most_states
        self.stem = [terms[t] for t in self.terms]
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        for k, t in enumerate(self.terms):
            node, errors = 0, 2 if len(t) >= two_errors else 1 if len(t) >= one_error else 0
            self.allowed[0] = max(self.allowed[0], errors)
            for c in t:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.kids[node][c]
                self.allowed[node] = max(self.allowed[node], errors)
            self.ends[node].append(k)
        self.errors = [2 if len(t) >= two_errors else 1 if len(t) >= one_error else 0 for t in self.terms]
        self.reset()

    def reset(self) -> None:
        self.ids: dict = {}
        self.sets: list = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({0: 0}, {})

    def _state(self, nodes: dict[int, int], stems: dict[int, int]) -> int:
        stack = list(nodes)
        while stack:  # letters of the term that the token leaves out
            n = stack.pop()
            for kid in self.kids[n].values():
                if nodes[n] < self.allowed[kid] and nodes.get(kid, 9) > nodes[n] + 1:
                    nodes[kid] = nodes[n] + 1
                    stack.append(kid)
        stems = dict(stems)
        for n, e in nodes.items():
            for k in self.ends[n]:
                if self.stem[k] and e <= self.errors[k] and stems.get(k, 9) > e:
                    stems[k] = e
        key = (frozenset(nodes.items()), frozenset(stems.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append((nodes, stems))
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stems = self.sets[state]
        out: dict[int, int] = {}
        for n, e in nodes.items():
            if e < self.allowed[n] and out.get(n, 9) > e + 1:
                out[n] = e + 1
            for letter, kid in self.kids[n].items():
                cost = e + (letter != c)
                if cost <= self.allowed[kid] and out.get(kid, 9) > cost:
                    out[kid] = cost
        to = -1 if not out and not stems else self._state(out, stems)
        self.next[state][c] = to
        return to

    def match(self, token: str) -> tuple[int, int] | None:
        """The nearest term and its distance; among equals the longest, then the first term."""
        if len(self.sets) > self.most_states:
            self.reset()
        state, table = self.start, self.next
        for c in token:
            to = table[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return None
            state = to
        nodes, stems = self.sets[state]
        found = list(stems.items()) + [(k, e) for n, e in nodes.items() for k in self.ends[n] if e <= self.errors[k]]
        return min(found, key=lambda x: (x[1], -len(self.terms[x[0]]), x[0]), default=None)


@dataclass
class Model:
    terms: dict[str, bool]
    weights: dict[str, float]
    params: Params
    near_weights: dict[tuple[str, int], float] = field(default_factory=dict)
    logistic: tuple = ()
    automaton: Automaton | None = field(default=None, repr=False)
    seen: set = field(default_factory=set, repr=False)
    hits: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "seen": set(), "hits": {}}

    def look(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that match; what a token matches is remembered."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms, self.params.one_error, self.params.two_errors)
        if len(self.seen) > 800_000:
            self.seen.clear()
        new = tokens.difference(self.seen)
        for t in new:
            folded = t.translate(LEET) if not t.isalpha() and not t.strip("@$").isdigit() else t
            # The words beside an @ or $ are matched too: a mention or an address is no misspelling.
            for way in {folded: None} | ({x: None for w in WORD.findall(t) for x in (w, w.translate(LEET) if not w.isdigit() else w)} if "@" in t or "$" in t else {}):
                got = self.automaton.match(way)
                errors = got and got[1] + (way not in t)
                if got and (t not in self.hits or errors < self.hits[t][1]):
                    self.hits[t] = (self.automaton.terms[got[0]], errors)
        self.seen |= new
        return tokens & self.hits.keys()

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Of a document; and its number of hits."""
        low = (text or "").lower()
        found = self.look(set(TOKEN.findall(low)))
        n = exact = near = quoted = best = 0.0
        if found:
            words = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(low)]
            for i, (w, a, b) in enumerate(words):
                if w not in found:
                    continue
                term, errors = self.hits[w]
                weight = self.weights[term] * 0.7**errors * self.near_weights.get((term, errors), 1.0)
                around = {x.strip("@$") for x, _, _ in words[max(0, i - self.params.window) : i + self.params.window + 1]}
                before, after = low[max(0, a - 2) : a], low[b : b + 2]
                is_quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or bool(around & REPORT)
                context = (0.5 if is_quoted else 1.0) * (1.25 if around & ADDRESS and not is_quoted else 1.0)
                n += 1
                exact += weight * context * (errors == 0)
                near += weight * context * (errors > 0)
                quoted += is_quoted
                best = max(best, weight * context)
        return [np.log1p(exact), np.log1p(near), best, np.log1p(quoted)], int(n)


def fit(sample: list[tuple[str, int]], params: Params, prior_shift: float = 0.0) -> Model:
    """Lexicon, weights and logistic model of labelled texts. """
    size = [max(1, sum(y == k for _, y in sample)) for k in (0, 1)]
    lo, hi = params.stems
    clean_words, clean_stems, in_toxic = Counter(), Counter(), Counter()
    toxic_words, toxic_stems, grown = defaultdict(set), defaultdict(set), defaultdict(set)
    for text, y in sample:
        words = WORD.findall(text.lower())
        if not y:
            clean_words.update(set(words))
            clean_stems.update({w[:k] for w in set(words) for k in range(lo, hi + 1) if len(w) > k})
            continue
        in_toxic.update(set(words))
        in_toxic.update({"^" + w[:k] for w in set(words) for k in range(lo, hi + 1) if len(w) > k})
        for before, w in zip(["", *words], words):  # noqa: B905
            toxic_words[w].add(before)
            for k in range(lo, min(hi, len(w) - 1) + 1):
                toxic_stems[w[:k]].add(before)
                grown[w[:k]].add(w)

    def precision(n: int, clean: int) -> float:
        p, q = n / size[1], (clean + 1) / size[0]
        return p / (p + q)

    # Support is counted in different words before the term: copies of one text count once.
    def good(found: dict[str, set], clean: Counter, least_len: int, mark: str) -> dict[str, float]:
        enough = {t: min(len(f), in_toxic[mark + t]) for t, f in found.items() if len(t) >= least_len}
        return {t: p for t, n in enough.items() if n >= max(params.least_toxic, params.least_share * size[1]) and (p := precision(n, clean[t])) >= params.precision}

    good_words, good_stems = good(toxic_words, clean_words, 3, ""), good(toxic_stems, clean_stems, lo, "^")
    terms: dict[str, bool] = {}
    weights: dict[str, float] = {}
    covered = lambda t: any(t[:k] in terms and terms[t[:k]] for k in range(lo, len(t)))
    # A stem is one only if several words grow from it; else the word itself says it.
    for t in sorted(good_stems, key=lambda t: (len(t), -len(toxic_stems[t]), t)):
        if len(grown[t]) >= 3 and not covered(t) and len(terms) < params.most_terms:
            terms[t], weights[t] = True, 2 * good_stems[t] - 1
    for t in sorted(good_words, key=lambda t: (-good_words[t], t)):
        if not covered(t) and t not in terms and len(terms) < params.most_terms:
            terms[t], weights[t] = False, 2 * good_words[t] - 1
    model = Model(terms, weights, params)
    # What clean texts hold within the errors of a term takes that term's weight at this distance away.
    near = [Counter(), Counter()]
    for text, y in sample:
        near[y].update({model.hits[w] for w in model.look(set(TOKEN.findall(text.lower()))) if model.hits[w][1]})
    for (t, e), n in near[0].items():
        p, q = (near[1][t, e] + 2) / size[1], (n + 0.5) / size[0]
        model.near_weights[t, e] = max(0.0, 2 * p / (p + q) - 1)
    x = np.array([model.features(t)[0] for t, _ in sample], float).reshape(len(sample), 4)
    model.logistic = shifted(fit_logistic(x, np.array([y for _, y in sample])), prior_shift)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, score (0 to 1), predicted, n_hits. Null and empty texts have no hits and get the score of such texts.

    Repeated rows and rows without an id are scored each by itself.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, "text"):
            got = [model.features(t) for t in b.column(1).to_pylist()]
            s = apply_logistic(model.logistic, np.array([f for f, _ in got], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([n for _, n in got], pa.int32())], ["id", "score", "predicted", "n_hits"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, score double, predicted int, n_hits int").withColumnRenamed("id", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    params = Params()
    sample, shift = labelled_sample(docs, labels, "toxic", 4, [2], params.per_class)
    model = fit(sample, params, shift)
    return score(docs, model).select("doc_id", (remainder("doc_id", 4) == F.lit(2)).alias("held_out"), "score", "predicted", "n_hits")
