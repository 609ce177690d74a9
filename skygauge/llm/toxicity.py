"""Toxicity by a weighted finite-state grammar of clauses.

Words are mapped to classes (insult, harm, target, negation, reporting, intent, quote, clause end, other) by a
weighted lexicon: exact words, and beginnings of words, of which the longest that fits counts. Five transducers read the classes and pass them on with marks:
an insult is a match; so is harm soon after an intent (a threat); a match is directed if its clause has named a target; negated if a negation
stands shortly before; reported if its clause has a reporting verb before it or it stands in quotes. Composed they are one
transducer, compiled to a table of transitions that is applied clause by clause.
A clause scores the weights of its matches under their pattern; a document's score is a logistic function of
the clause scores of each pattern for a hundred words, and of their logarithmic sum.

The lexicon is learned from labelled texts: the log ratio of a term's frequency among the words of toxic and
of other texts, less `caution` standard errors, counted by executors; a beginning is a term only if words go on from it
in several ways, so that it is a stem and not part of one word; few general words of each language are
in it from the start and keep that weight where labels say nothing of them. The factors of the patterns come from labelled texts
that the lexicon wasn't learned from, as the most likely ones under a prior that they keep where no text shows
a pattern. No more than `max_docs` texts of either label are learned from, of near copies (by three least hashes of shingles) one; all counts
of texts that are scored cover the whole text.

A null or empty text, or one without words, has the score of a text without matches. Very long texts are read
in pieces that end at white space or between characters. Repeated rows and null ids are rows like others; of several labels of a document the largest
counts, null ones don't; without labels of both kinds the grammar's own weights score alone. An empty table
gives no rows. Columns other than the named ones aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import exact_id, give_back, materialize, schema, text_batches
from skygauge.llm.simhash import shingle_hashes

#: END ends a clause; BREAK, a line's end, quotes too.
OTHER, END, BREAK, QUOTE, TARGET, NEGATION, REPORT, INTENT, HARM, INSULT = range(10)
CLASSES, ENDS = 10, (END, BREAK)
#: Bits of a mark: what a match is, and what its clause makes of it.
MATCH_INSULT, MATCH_THREAT, DIRECTED, NEGATED, REPORTED = 1, 2, 4, 8, 16
MATCH = MATCH_INSULT | MATCH_THREAT
PATTERNS = ("bare", "directed", "negated", "reported", "threat")
#: Words that a negation or an intent reaches ahead.
REACH = 4
PIECE = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:|\n]|[\"“”„«»]")
#: General words of each class, in English, German, French and Spanish.
WORDS = {
    TARGET: "you your you're u he she they them him her du dich dir ihr euch tu toi vous il elle ils elles tú ti usted ustedes vosotros ella ellos",
    NEGATION: "not no never isn't aren't don't doesn't wasn't nicht kein keine keinen nie ne pas jamais nunca jamás",
    REPORT: "said says saying called calls wrote claimed told quoted sagte nannte schrieb dit disait appelé traité écrit dijo llamó escribió",
    INTENT: "will i'll gonna going shall should must werde werden wirst sollst vais va vas devrais voy vamos deberías",
    HARM: "kill hurt destroy beat shoot stab burn die töten umbringen schlagen verbrennen sterben tuer frapper brûler mourir matar golpear quemar morir",
    INSULT: "idiot moron stupid fool loser scum dummkopf trottel abschaum versager imbécile crétin ordure minable idiota imbécil estúpido escoria",
}
SEED_WEIGHT = 3.0
#: Factors of the patterns, of the logarithmic sum, and the constant, where labels don't say otherwise.
PRIOR = np.array([1.0, 1.3, 0.3, 0.4, 1.2, 0.5, -3.0])


@dataclass(frozen=True)
class ToxicityConfig:
    #: The most texts of each label that are learned from.
    max_docs: int = 5000
    #: Documents with a term, its least weight, standard errors taken off, and the most terms.
    min_docs: int = 3
    least_weight: float = 1.5
    caution: float = 2.0
    max_terms: int = 5000
    #: Lengths of beginnings of words, and the most that one way to go on may have of a beginning's toxic tokens.
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    branching: float = 0.6
    #: Words that a short text counts as having beyond its own.
    smoothing: float = 50.0
    #: Deviation of the pattern factors from PRIOR that is taken as usual.
    spread: float = 1.0
    seed: int = 7


# Transducers: a step takes a state, a class and the marks so far, and gives the next state and the marks passed on.

Step = Callable[[int, int, int], tuple[int, int]]


def insult_step(state: int, kind: int, marks: int) -> tuple[int, int]:
    return 0, marks | MATCH_INSULT if kind == INSULT else marks


def threat_step(state: int, kind: int, marks: int) -> tuple[int, int]:
    """state: words that the last intent still reaches."""
    if kind == INTENT:
        return REACH, marks
    if kind == HARM and state:
        marks |= MATCH_THREAT
    return (0 if kind in ENDS else max(0, state - 1)), marks


def target_step(state: int, kind: int, marks: int) -> tuple[int, int]:
    """state: whether the clause has named a target."""
    if state and marks & MATCH:
        marks |= DIRECTED
    return (0 if kind in ENDS else 1 if kind == TARGET else state), marks


def negation_step(state: int, kind: int, marks: int) -> tuple[int, int]:
    """state: words that the last negation still reaches."""
    if state and marks & MATCH:
        marks |= NEGATED
    return (REACH if kind == NEGATION else 0 if kind in ENDS else max(0, state - 1)), marks


def report_step(state: int, kind: int, marks: int) -> tuple[int, int]:
    """state: 1 after a reporting verb in the clause, 2 in quotes."""
    if state and marks & MATCH:
        marks |= REPORTED
    if kind == QUOTE:
        return 0 if state == 2 else 2, marks
    if state == 2 and kind != BREAK:
        return 2, marks
    return (0 if kind in ENDS else 1 if kind == REPORT else state), marks


@dataclass(frozen=True)
class Grammar:
    """A transducer as a table: by state and class the next state and the marks; ahead: by state and number of other words, up to some, the state after them."""

    step: list[list[int]]
    marks: list[list[int]]
    ahead: list[list[int]]


def compose(steps: tuple[Step, ...]) -> Grammar:
    """The transducers one after another: each reads the class and the marks that those before it have passed on. Only states that can be reached are made."""
    numbers, todo, step, marks = {(0,) * len(steps): 0}, [(0,) * len(steps)], [], []
    while todo:
        states = todo.pop(0)
        row, made = [], []
        for kind in range(CLASSES):
            mark, after = 0, []
            for one, state in zip(steps, states, strict=True):
                following, mark = one(state, kind, mark)
                after.append(following)
            if tuple(after) not in numbers:
                numbers[tuple(after)] = len(numbers)
                todo.append(tuple(after))
            row.append(numbers[tuple(after)])
            made.append(mark)
        step.append(row)
        marks.append(made)
    ahead = [list(range(len(step)))]
    for _ in range(REACH + 1):
        ahead.append([step[s][OTHER] for s in ahead[-1]])
    return Grammar(step, marks, [list(x) for x in zip(*ahead, strict=True)])


GRAMMAR = compose((insult_step, threat_step, target_step, negation_step, report_step))


def pattern(marks: int) -> int:
    """The pattern a match counts under: what is reported or negated isn't meant."""
    if marks & REPORTED:
        return 3
    if marks & NEGATED:
        return 2
    return 4 if marks & MATCH_THREAT else 1 if marks & DIRECTED else 0


class Lexicon(dict):
    """Codes of words: a class, or from CLASSES on an entry with a weight of its own. Words that were met are kept, up to a number."""

    KEPT = 50_000

    def __init__(self, terms: dict[str, float]) -> None:
        super().__init__()
        self.fixed = {w: kind for kind, words in WORDS.items() for w in words.split() if kind != INSULT}
        self.fixed |= dict.fromkeys(".!?;:|", END) | {"\n": BREAK} | dict.fromkeys('"“”„«»', QUOTE)
        self.weights = [0.0] * HARM + [SEED_WEIGHT] * 2
        self.beginnings: dict[str, int] = {}
        for term, weight in terms.items():
            (self.beginnings if term.endswith("*") else self.fixed)[term.rstrip("*")] = len(self.weights)
            self.weights.append(weight)
        self.lengths = sorted({len(x) for x in self.beginnings}, reverse=True)

    def __missing__(self, word: str) -> int:
        code = self.fixed.get(word)
        if code is None:
            code = next((self.beginnings[word[:n]] for n in self.lengths if word[:n] in self.beginnings), OTHER)
        if len(self) >= self.KEPT:
            self.clear()
        self[word] = code
        return code


def pieces(text: str) -> Iterator[str]:
    """A text in lower case, in pieces of about PIECE characters that end before white space, if there is any within as many more."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = re.compile(r"\s").search(text, end, end + PIECE)
            end = space.start() if space else end
        yield text[at:end].lower()
        at = end


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Clause scores by pattern, then the number of matched clauses and of words."""
    sums, clauses, words, state, hit = [0.0] * len(PATTERNS), 0, 0, 0, False
    for piece in pieces(text or ""):
        tokens = TOKEN.findall(piece)
        codes = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
        at = np.flatnonzero(codes)
        found = codes[at]
        words += len(codes) - int((found <= QUOTE).sum())
        if len(text) <= PIECE and not (found >= HARM).any():
            break
        last = -1
        for i, code in zip(at.tolist(), found.tolist(), strict=True):
            state = GRAMMAR.ahead[state][min(i - last - 1, REACH + 1)]
            last, kind = i, min(code, INSULT)
            marks, state = GRAMMAR.marks[state][kind], GRAMMAR.step[state][kind]
            if marks & MATCH:
                sums[pattern(marks)] += lexicon.weights[code]
                clauses += not hit
                hit = True
            elif kind in ENDS:
                hit = False
        state = GRAMMAR.ahead[state][min(len(codes) - last - 1, REACH + 1)]
    return np.array([*sums, clauses, words])


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    factors: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    smoothing: float = 50.0

    def rates(self, found: np.ndarray) -> np.ndarray:
        """What the factors apply to, for rows of features."""
        sums = found[:, : len(PATTERNS)]
        return np.column_stack([100 * sums / (found[:, -1:] + self.smoothing), np.log1p(sums @ PRIOR[: len(PATTERNS)]), np.ones(len(found))])

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rates(found) @ self.factors, -500, 500)))


def seeds() -> dict[str, float]:
    return dict.fromkeys(WORDS[INSULT].split(), SEED_WEIGHT)


KEYED = schema("toxic int, place long, text string, k0 long, k1 long, k2 long")


def _near_copy_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with three least hashes of their five-word shingles under three mappings; near copies agree in most."""
    for batch in batches:
        out = []
        for text in batch["text"]:
            h = np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, 5)])
            out.append([int((h * np.uint64(m)).min().astype(np.int64)) if len(h) else 0 for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)])
        keys = np.array(out, np.int64).reshape(-1, 3)
        yield batch.assign(k0=keys[:, 0], k1=keys[:, 1], k2=keys[:, 2])
    give_back()


COUNTED = schema("term string, toxic int, tokens long, texts long")
#: Terms that a task counts at a time.
TERMS = 50_000


def _counted(batches: Iterator[pd.DataFrame], lengths: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    """By term and label the tokens and texts it has, in parts of about TERMS terms; the empty term has all tokens."""
    tokens, texts = (Counter(), Counter()), (Counter(), Counter())

    def flush() -> pd.DataFrame:
        rows = [(t, toxic, n, texts[toxic][t]) for toxic in (0, 1) for t, n in tokens[toxic].items()]
        for counter in (*tokens, *texts):
            counter.clear()
        return pd.DataFrame(rows, columns=COUNTED.names)

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].tolist(), strict=True):
            found: Counter[str] = Counter()
            for piece in pieces(text):
                found.update(w for w in TOKEN.findall(piece) if w[0].isalpha())
            terms: Counter[str] = Counter({"": sum(found.values())})
            for word, n in found.items():
                terms[word] += n
                for k in lengths:
                    if len(word) >= k:
                        terms[f"{word[:k]}*"] += n
            tokens[toxic].update(terms)
            texts[toxic].update(terms.keys())
            if len(tokens[0]) + len(tokens[1]) >= TERMS:
                yield flush()
    yield flush()
    give_back()


def learn_terms(sample: DataFrame, config: ToxicityConfig) -> dict[str, float]:
    """Weights of the terms of labelled texts, seeds among them; no more than max_terms reach the driver."""
    lengths = (*config.beginnings, max(config.beginnings, default=0) + 1)  # the longest ones' ways to go on too
    counts = sample.mapInPandas(lambda it: _counted(it, lengths), COUNTED)
    part = lambda x, toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col(x))), F.lit(0)).cast("double")
    counts = materialize(counts.groupBy("term").agg(part("tokens", 1).alias("p"), part("tokens", 0).alias("q"), part("texts", 1).alias("d"), part("texts", 0).alias("e")))
    whole = counts.where("term = ''").first()  # of one row
    if whole is None or not whole["p"] or not whole["q"]:
        return seeds()
    beginning = F.endswith("term", F.lit("*"))
    stem = F.when(beginning, F.expr("left(term, length(term) - 2)")).otherwise(F.col("term"))
    ways = counts.where("term <> ''").groupBy(F.concat(stem, F.lit("*")).alias("stem")).agg(F.max("p").alias("way"))
    counts = counts.join(ways, F.col("term") == F.col("stem"), "left").where(~beginning | ((F.length("term") <= max(config.beginnings, default=0) + 1) & (F.col("way") <= config.branching * F.col("p"))))
    ratio = F.log((F.col("p") + 0.5) / (F.col("q") + 0.5)) - math.log((whole["p"] + 1) / (whole["q"] + 1))
    weighed = counts.where("term <> ''").withColumn("weight", ratio - config.caution * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5)))
    good = weighed.where((F.col("d") >= config.min_docs) & (F.col("weight") >= config.least_weight)).orderBy(F.desc(F.col("weight") * F.col("p")), "term").limit(config.max_terms)
    terms = {r["term"]: r["weight"] for r in good.collect()}
    fixed = {w for kind, words in WORDS.items() if kind != INSULT for w in words.split()}
    known = {r["term"] for r in weighed.where(F.col("term").isin(*seeds()) & (F.col("d") + F.col("e") >= config.min_docs)).select("term").collect()}
    return {t: w for t, w in seeds().items() if t not in known} | {t: w for t, w in terms.items() if t not in fixed}


def fit_factors(x: np.ndarray, y: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Most likely factors of a logistic model under a normal prior around PRIOR, by Newton steps."""
    factors, precision = PRIOR.copy(), np.full(len(PRIOR), 1 / config.spread**2)
    precision[-1] = 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ factors, -500, 500)))
        gradient = x.T @ (p - y) + precision * (factors - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), gradient)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        factors = factors - step
        if np.abs(step).max() < 1e-9:
            break
    return factors


def _featured(batches: Iterator[pd.DataFrame], terms: dict[str, float]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon(terms)
    for batch in batches:
        yield pd.DataFrame({"toxic": batch["toxic"], "place": batch["place"], "x": [features(x, lexicon) for x in batch["text"]]})
    give_back()


def _share(rows: DataFrame, config: ToxicityConfig) -> Column:
    """Whether a row (toxic, place: a hash) is among about max_docs of its label."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, config.max_docs / counts.get(1, 1))).otherwise(min(1.0, config.max_docs / counts.get(0, 1)))
    return F.col("place").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31) < share


def fit(rows: DataFrame, config: ToxicityConfig | None = None) -> ToxicityModel:
    """A model from rows id, toxic (0 or 1) and text: two thirds of a bounded sample for the terms, the rest for the factors."""
    config = config or ToxicityConfig()
    rows = rows.where(F.col("toxic").isin(0, 1) & F.col("text").isNotNull())
    rows = rows.select(F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit(config.seed), "text").alias("place"), "text")
    taken = rows.where(_share(rows, config)).mapInPandas(_near_copy_keys, KEYED)
    for key in ("k0", "k1", "k2"):  # which of the copies stays depends on hashes alone
        taken = taken.groupBy(key).agg(F.min_by(F.struct(*taken.columns), F.struct("place", "toxic")).alias("r")).select("r.*")
    sample = materialize(taken.select("toxic", "place", "text", (F.pmod("place", F.lit(3)) == 0).alias("for_factors")))
    terms = learn_terms(sample.where("NOT for_factors"), config)
    model = ToxicityModel(terms, smoothing=config.smoothing)
    found = sample.where("for_factors").select("toxic", "place", "text").mapInPandas(lambda it: _featured(it, terms), schema("toxic int, place long, x double[]"))
    found = found.orderBy("place", "toxic").limit(2 * config.max_docs).collect()
    if len({r["toxic"] for r in found}) == 2:
        model.factors = fit_factors(model.rates(np.array([r["x"] for r in found])), np.array([float(r["toxic"]) for r in found]), config)
    return model


SCORED = schema("id long, no_id boolean, score double, n_matched_clauses long, bare double, directed double, negated double, reported double, threat double")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, number of clauses with a match, and the clause scores by pattern of each document."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.terms)
        for batch in batches:
            found = np.array([features(x, lexicon) for x in batch["text"]]).reshape(-1, len(PATTERNS) + 2)
            sums = {name: found[:, i] for i, name in enumerate(PATTERNS)}
            yield pd.DataFrame({"id": batch["id"], "no_id": batch["no_id"], "score": model.scores(found), "n_matched_clauses": found[:, -2].astype(np.int64)} | sums)
        give_back()

    scored = docs.select(*exact_id(id_col), F.col(text_col).alias("text")).mapInPandas(run, SCORED)
    return scored.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *SCORED.names[2:])


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned: a fifth, by the CRC-32 of their id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """labelled (a document's id) and toxic of the documents to learn from: by hash, about max_docs of each label and never more than twice that of both
    together, so that the texts are looked up without being dealt."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known.withColumn("place", F.xxhash64(F.lit(config.seed), "labelled")))
    return known.where(_share(known, config)).orderBy("place", "labelled").limit(2 * config.max_docs).select("labelled", "toxic")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ToxicityConfig | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) and the columns of score(), learned from the labels (doc_id, toxic) of documents that aren't held out."""
    text_batches(docs.sparkSession)
    config = config or ToxicityConfig()
    rows = docs.select(F.col(id_col).cast("long").alias("labelled"), F.col(text_col).alias("text")).join(F.broadcast(drawn(labels, config)), "labelled").select("toxic", "text")
    found = score(docs, fit(materialize(rows), config), id_col, text_col)
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *SCORED.names[3:])
