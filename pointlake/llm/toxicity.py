"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as a string of word classes: insult, threat, intent (will, going to), target (a person or
group spoken of or to), negation, reported speech, other. Small machines are composed into one: is a
target named, is an intent stated (which announces a threat), is a negation in force, is the clause
reported. Two transducers run over the composed state: the insult transducer emits each insult, the
threat transducer each threat, with the state it was read in and, when the clause ends, whether a
target was named before or after. Reported speech goes on over quotes, colons and commas to the end of
the sentence. A clause scores the lexical weight of what it emits on an arc that depends on that
state, so a negated or quoted word, an unannounced threat and a word without a target have arcs of
their own, whose weights are learned.

Lexical weights and arc weights are learned from labelled rows. Terms are found as word beginnings and
whole words that labelled toxic documents have and others lack, beside fixed seed lists; a term is a
threat if most of its clauses announce it and name a target, else an insult. Labels, languages, sources
and ids are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing, text_batches
from pointlake.llm.text import words_of
from pointlake.session import materialise

#: Bounds of the fit: labelled rows looked at, features counted from each, features kept.
FIT_ROWS, LEXICON = 20_000, 4_096
THRESHOLD = 0.7
# Seed classes in English, German, French and Spanish. A trailing * takes any ending.
INSULTS = "idiot* moron* stupid* loser* scum trash pathetic worthless disgusting dumb* filth* vermin bastard* arschloch* dummkopf* abschaum connard* salaud* imbécile* idiota* imbécil* basura".split()
THREATS = "kill* murder* hang burn shoot strangle* töte* umbringen erschieße* tuer tuerai matar mataré".split()
TARGETS = "you your yours yourself u they them their he him his she her those these people everyone du dich dir ihr euch sie ihn tu te toi vous ils elles lui usted ustedes tú ti ellos ellas él ella".split()
INTENTS = "will shall gonna i'll we'll werde werden vais allons voy vamos".split()
NEGATIONS = "not no never nobody none without isn't aren't don't nicht kein keine keiner niemals nie ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say told wrote writes called quoted quote reported claimed according sagte sagt schrieb laut dit disait selon dijo dice según".split()

_WORD, _CLAUSE = re.compile(r"[^\W_]+(?:'[^\W_]+)?"), re.compile(r"[.!?;:,\n|()\"]+")
I, H, A, T, N, R, W = "insult", "threat", "intent", "target", "negation", "report", "other"
CLASSES = (I, H, A, T, N, R, W)
#: Cuts of these characters alone end a clause but not its sentence.
WITHIN = frozenset('",:')
SCOPE = 4  # words that a negation reaches


class Machine:
    """A deterministic machine over word classes: states 0.., a transition for each state and class."""

    def __init__(self, states: int, step):
        self.states = states
        self.table = {(s, c): step(s, c) for s in range(states) for c in CLASSES}


def compose(*machines: Machine) -> tuple[dict[tuple[int, str], int], list[tuple[int, ...]]]:
    """One machine that runs all of them: transitions, and for each state the states of its parts. State 0 is the start."""
    states = list(product(*(range(m.states) for m in machines)))
    at = {s: i for i, s in enumerate(states)}
    return {(at[s], c): at[tuple(m.table[x, c] for m, x in zip(machines, s, strict=True))] for s in states for c in CLASSES}, states


TARGETED = Machine(2, lambda s, c: 1 if c == T else s)
NEGATED = Machine(SCOPE + 1, lambda s, c: SCOPE if c == N else max(s - 1, 0))
REPORTED = Machine(2, lambda s, c: 1 if c == R else s)
ANNOUNCED = Machine(2, lambda s, c: 1 if c == A else s)
STEP, STATES = compose(TARGETED, NEGATED, REPORTED, ANNOUNCED)
#: The start of a clause in a sentence that has no report so far, and in one that has.
START = (STATES.index((0, 0, 0, 0)), STATES.index((0, 0, 1, 0)))
#: What the transducers emit: an insult, a threat or an announced threat, whether negated and reported. At the end of the clause: whether it names a target.
ANNOUNCES = "announced threat"
ARCS = [(k, n, r, t) for k in (I, H, ANNOUNCES) for n in (False, True) for r in (False, True) for t in (False, True)]
_ARC = {a: i for i, a in enumerate(ARCS)}
#: Prior arc weights per unit of lexical weight: the ones the fit is pulled to.
PRIOR = np.array([(0.8 if k == H else 1.0) * (0.3 if n else 1) * (0.5 if r else 1) * (1.2 if t else 1) for k, n, r, t in ARCS])


def emits(state: int, kind: str) -> tuple[str, bool, bool]:
    """The output of the insult or threat transducer that reads its word in ``state``."""
    _, negated, reported, announced = STATES[state]
    return (ANNOUNCES if kind == H and announced else kind), negated > 0, reported > 0


@dataclass
class Grammar:
    """Word beginnings and whole words (ending in $) of the insult and threat classes with lexical weights, weights of ``ARCS`` and a bias."""

    lexicon: dict[str, tuple[str, float]]
    arcs: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0

    def compiled(self) -> _Reader:
        return _reader(tuple(sorted(self.lexicon.items())))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.arcs + self.bias, -30, 30)))


class _Reader:
    """Finds lexicon words with one automaton pass and reads only the clauses that hold one."""

    def __init__(self, lexicon: tuple):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for term, (kind, weight) in lexicon:
            entries.setdefault(term.rstrip("$"), []).append((term[-1] == "$", kind, weight, term))
        for text, own in entries.items():
            self.automaton.add_word(text, (len(text), own))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()
        self.classes = {w: c for c, ws in ((T, TARGETS), (N, NEGATIONS), (R, REPORTS), (A, INTENTS)) for w in ws}

    def hits(self, text: str) -> dict[int, tuple[str, float, str]]:
        """Word start -> class, lexical weight and name of the longest term there."""
        found: dict[int, tuple[int, str, float, str]] = {}
        for end, (size, own) in self.automaton.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalnum()):
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalnum()
            for exact, kind, weight, term in own:
                if (whole or not exact) and (start not in found or size + exact > found[start][0]):
                    found[start] = (size + exact, kind, weight, term)
        return {s: tuple(rest) for s, (_, *rest) in found.items()}

    def features(self, text: str | None) -> np.ndarray:
        """For each arc the lexical weight emitted over all clauses, a clause at most 8 and an arc at most 16."""
        out = np.zeros(len(ARCS))
        for emitted, targeted in self.clauses(text):
            room = 8.0
            for output, weight, _, _ in emitted:
                weight = min(weight, room)
                out[_ARC[*output, targeted]] += weight
                room -= weight
        return np.minimum(out, 16.0)

    def threatening(self, text: str | None) -> Iterator[tuple[str, bool]]:
        """Each term's name as often as it is read, and whether its clause announces it and names a target."""
        for emitted, targeted in self.clauses(text):
            for _, _, term, announced in emitted:
                yield term, announced and targeted

    def clauses(self, text: str | None) -> Iterator[tuple[list, bool]]:
        """For each clause that emits: (output, lexical weight, term, announced) of each emission, and whether the clause names a target."""
        if not text or self.empty:
            return
        text = text.lower()
        hits = self.hits(text)
        if not hits:
            return
        begin, done = 0, 0
        seen, reported = 0, False  # up to where this sentence was searched for a report
        starts = sorted(hits)
        while done < len(starts):
            cut = _CLAUSE.search(text, begin)
            end = cut.start() if cut else len(text)
            if starts[done] < end or not cut:
                n = done
                while n < len(starts) and starts[n] < end:
                    n += 1
                reported = reported or self._reports(text, seen, begin, hits)
                emitted, targeted, reported = self._clause(text, begin, end, hits, reported)
                yield emitted, targeted
                seen = end
                done = n if cut else len(starts)
            begin = cut.end() if cut else end
            if cut and not WITHIN.issuperset(cut[0]):
                seen, reported = begin, False

    def _reports(self, text: str, begin: int, end: int, hits: dict) -> bool:
        return any(self.classes.get(m[0]) == R and m.start() not in hits for m in _WORD.finditer(text, begin, end))

    def _clause(self, text: str, begin: int, end: int, hits: dict, told: bool) -> tuple[list, bool, bool]:
        """What the clause emits, whether it names a target, and whether its sentence has a report by its end."""
        state, emitted = START[told], []
        for m in _WORD.finditer(text, begin, end):
            at = m[0].find("'") + 1  # the part after an elision is a word as well
            found = [hits[i] for i in ((m.start(), m.start() + at) if at else (m.start(),)) if i in hits]
            for kind, weight, term in found:
                emitted.append((emits(state, kind), weight, term, STATES[state][3] > 0))
                state = STEP[state, kind]
            if not found:
                state = STEP[state, self.classes.get(m[0], W)]
        return emitted, STATES[state][0] > 0, STATES[state][2] > 0


@lru_cache(maxsize=4)
def _reader(lexicon: tuple) -> _Reader:
    return _Reader(lexicon)


def _seeds() -> dict[str, tuple[str, float]]:
    return {(w[:-1] if w[-1] == "*" else w + "$"): (k, 2.0 if k == I else 1.5) for k, ws in ((I, INSULTS), (H, THREATS)) for w in ws}


def _term_features(text: str | None) -> set[str]:
    """Word beginnings of 3 to 7 characters and whole words with a $."""
    out = set()
    for w in set(_WORD.findall(text.lower())) if text else ():
        out.update(w[:k] for k in range(3, min(len(w), 7) + 1))
        out.add(w + "$")
    return out


def _odds(a: float, b: float, toxic: int, clean: int) -> float:
    return float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))


def _induce(counts: list, toxic: int, clean: int) -> dict[str, tuple[str, float]]:
    """The terms that tell toxic rows: well supported, with log odds of at least 1.5, and not because of one longer term alone.

    A term's weight is its log odds less one standard error. Longer terms that say no more than a
    shorter one are left out.
    """
    scored = {}
    for term, a, b in counts:
        expected = (a + b) * toxic / (toxic + clean)
        if _odds(a, b, toxic, clean) >= 1.5 and a >= max(5, toxic / 100) and (a - expected) / np.sqrt(expected + 1) >= 4:
            scored[term] = (a, b)
    longest: dict[str, tuple[int, int]] = {}  # beginning -> counts of the longer term with most toxic rows
    beginnings = lambda t: (t.rstrip("$")[:k] for k in range(3, len(t.rstrip("$")) + (t[-1] == "$")))
    for t, (a, b) in scored.items():
        for stem in beginnings(t):
            if stem in scored and stem != t:
                longest[stem] = max(longest.get(stem, (0, 0)), (a, b))
    out: dict[str, tuple[str, float]] = {}
    for t, (a, b) in sorted(scored.items(), key=lambda x: (len(x[0].rstrip("$")), x[0][-1] == "$", x[0])):
        more_a, more_b = longest.get(t, (0, 0))
        if t in longest and (a - more_a < max(5, toxic / 100) or _odds(a - more_a, max(0, b - more_b), toxic, clean) < 1.5):
            continue
        weight = _odds(a, b, toxic, clean) - np.sqrt(1 / (a + 0.5) + 1 / (b + 1))
        shorter = [out[s][1] for s in beginnings(t) if s in out]
        if not shorter or weight > max(shorter) + 0.7:
            out[t] = (I, float(weight))
    best = sorted(out.items(), key=lambda x: (-x[1][1], x[0]))[:LEXICON]
    return dict(best)


def _fit_arcs(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps, pulled to the prior arc weights, so that it ends where the classes separate too."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, -3.0)
    pull = np.append(np.full(len(PRIOR), ridge), 0.5)

    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float(np.logaddexp(0, margin).sum() - y @ margin + (pull * (w - prior) ** 2).sum() / 2)

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def _sketched(rows: DataFrame) -> DataFrame:
    """Adds ``sketch``, the least hash of the five-word shingles of a text (fewer words: of all of them)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                shingles = map(b" ".join, zip(*(words[i : len(words) - 4 + i] for i in range(5)), strict=True)) if len(words) > 5 else [b" ".join(words)]
                own.append(min(xxhash.xxh64_intdigest(s) for s in shingles) >> 1)
            yield batch.append_column("sketch", pa.array(own, pa.int64()))

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, sketch long")


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: the CRC32 of its id as text leaves 1 when divided by 3. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """Learns a grammar from at most about ``fit_rows`` labelled rows that are not held out, chosen by a hash of the id.

    Null labels and ids teach nothing; of repeated labels the highest counts. Without rows of both
    kinds the grammar is the seed lexicon with prior weights.
    """
    text_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return Grammar(_seeds())
    share = min(1.0, fit_rows / n)
    chosen = materialise(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))), "toxic-ids")
    few = chosen.count() <= 2 * fit_rows  # two numbers a row
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen) if few else chosen, "doc_id")
    # near copies teach once: rows of one label with the same least shingle hash are one row
    raw = materialise(texts.select("doc_id", "text", "toxic"), "toxic-sample")
    sample = materialise(_sketched(raw).groupBy("sketch", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic"), "toxic-rows")
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sum(c for t, c in kinds.items() if t), kinds.get(0, 0)
    if not toxic or not clean:
        return Grammar(_seeds())

    @freeing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        flush = lambda: pa.RecordBatch.from_pydict({"term": pa.array(terms := list(counts[0].keys() | counts[1].keys()), pa.string()), "a": pa.array([counts[1][t] for t in terms], pa.int64()), "b": pa.array([counts[0][t] for t in terms], pa.int64())})
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[bool(label)].update(_term_features(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield flush()
                counts[0].clear(), counts[1].clear()
        yield flush()

    terms = sample.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 5 AND a * 8 > b")
    ranked = terms.orderBy(F.desc(F.expr("(a + 0.5) / (b + 0.5) * sqrt(a)")), "term").limit(16 * LEXICON).collect()
    induced = _induce([tuple(r) for r in ranked], toxic, clean)

    @freeing
    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Grammar(induced).compiled(), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(reader.threatening(text.as_py()))
        keys = list(seen)  # at most LEXICON terms, twice
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "threat", "n"])

    used = sample.where("toxic > 0").mapInArrow(uses, "term string, threat boolean, n long").groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("threat"), F.col("n")).otherwise(0)).alias("t"))
    threats = {r["term"] for r in used.where("2 * t > n AND n >= 5").collect()}
    induced = {t: (H if t in threats else k, w) for t, (k, w) in induced.items()}
    grammar = Grammar(_seeds() | induced)

    @freeing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar.compiled()
        for batch in batches:
            found = [reader.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["features", "toxic"])

    rows = sample.mapInArrow(read, "features array<double>, toxic int").groupBy("features", "toxic").count().collect()  # at most fit_rows
    x = np.array([r["features"] for r in rows for _ in range(r["count"])])
    y = np.array([float(r["toxic"] > 0) for r in rows for _ in range(r["count"])])
    grammar.arcs, grammar.bias = _fit_arcs(x, y)
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (arcs that fired) for every row, where the rows are.

    Null and empty texts, and all texts without a lexicon word, get the score of the bias. Repeated
    rows each get a row; other columns are not read.
    """

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar.compiled()
        for batch in batches:
            features = np.array([reader.features(t.as_py()) for t in batch.column(1)]).reshape(len(batch), len(ARCS))
            score = grammar.score(features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array((features > 0).sum(1))], ["doc_id", "score", "predicted", "n_arcs"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, n_arcs long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_arcs")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    names = docs.columns
    at = names.index("text")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar.compiled()
        for batch in batches:
            features = np.array([reader.features(t.as_py()) for t in batch.column(at)]).reshape(len(batch), len(ARCS))
            yield batch.filter(pa.array(grammar.score(features) < threshold)).rename_columns(names)

    # columns are looked up by name on the way in, so names with dots and backticks stay outside
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)
