"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are composed into two machines.  Lexicon transducers (insult, threat, target, negation,
report) each read words, write their symbol and pass on what they don't know.  A backward machine then
reads a clause from its end and marks harm that a target follows within a few words ("kill you", "idiots
like you").  The forward machine marks what follows a negation within a few words, marks what follows a
verb of saying, and writes weights, more where a target is near on either side.  A clause runs between
full stops, semicolons, colons and line ends; commas and words of contrast end a negation within it.  A
clause scores what the machines pay for it; a logistic function of the document's clause scores gives its
toxicity.

Fixed lists hold function words and threats.  Insults are learned: stems and words that labelled toxic
documents hold far more often than others.  Labels come from a sample of at most ``most_labelled`` rows;
the model keeps at most ``most_stems`` stems, the most telling ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import local_schema, put_back, set_aside

MOST_LABELLED, MOST_STEMS = 12_000, 2_000
STEMS, LEAST_DOCS, LEAST_Z = (5, 6, 7), 4, 3.0
LEAST_RATE = 0.7
NEGATED_FOR, NEAR = 3, 5
#: Function words of the grammar, and verbs of violence in their common forms.
TARGETS = frozenset("you your yours they them their he she him her these those people du dich dir euch ihr sie tu toi vous ils elles tú usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody without isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say saying told called calls claimed claims wrote writes quoted quote reported reports sagte sagt schrieb dit disait écrit dijo dice escribió".split())
CONTRASTS = frozenset("but yet although though aber sondern doch obwohl mais pourtant quoique pero sino aunque".split())
THREATS = frozenset("kill kills killing hurt hurts hurting destroy destroys beat beats stab stabs shoot shoots burn burns attack attacks hunt hunts töten töte tötet umbringen verletzen tuer tue tuerai frapper frapperai matar mato mataré golpear golpearé".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]")
_END = frozenset(".!?;:\n")
_MARKS = _END | {","}
FEATURES = 5
MOST_REMEMBERED = 300_000


class Machine(NamedTuple):
    """A deterministic transducer: (state, symbol) -> (state, written symbol or weight); others stay and copy."""

    start: tuple
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Machine, second: Machine, symbols) -> Machine:
    """The machine that feeds what ``first`` writes to ``second``, over reachable states only."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for s in symbols:
            a, mid = first.step(state[0], s)
            b, out = second.step(state[1], mid)
            arcs[(state, s)] = (a, b), out
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Machine(start, arcs)


SYMBOLS = ("insult", "threat", "target", "negation", "report", "contrast", "other", "end")
HARM = ("insult", "threat")
MARKS = tuple(h + a for h in HARM for a in ("", "-at"))


def words_to(symbol: str, words) -> Machine:
    """A lexicon transducer: writes ``symbol`` for each of its words and copies all else.

    Words carry a ``$``, which no symbol has, so what one transducer writes is no word to the next.
    """
    return Machine(0, {(0, f"{w}$"): (0, symbol) for w in words})


def lexicon_machine(insults) -> Machine:
    """The lexicon transducers in a row; the first that knows a word decides."""
    fixed = (words_to("end", _END), words_to("contrast", {",", *CONTRASTS}), words_to("negation", NEGATIONS), words_to("report", REPORTS), words_to("target", TARGETS), words_to("threat", THREATS))
    known = {w for m in fixed for _, w in m.arcs} | {f"{w}$" for w in insults}
    out = fixed[0]
    for m in (*fixed[1:], words_to("insult", insults)):
        out = compose(out, m, known)
    return out


def ahead() -> Machine:
    """Read from a clause's end: marks harm ``-at`` within NEAR words before a target."""
    arcs = {}
    for k in range(NEAR + 1):
        for s in SYMBOLS:
            arcs[(k, s)] = (NEAR if s == "target" else 0 if s == "end" else max(0, k - 1), s + "-at" if k and s in HARM else s)
    return Machine(0, arcs)


def negation() -> Machine:
    """Marks harm ``-neg`` within NEGATED_FOR words of a negation, up to a comma or a word of contrast."""
    arcs = {}
    for k in range(NEGATED_FOR + 1):
        for s in (*SYMBOLS, *MARKS):
            mark = s + "-neg" if k and s in MARKS else s
            arcs[(k, s)] = (NEGATED_FOR if s == "negation" else 0 if s in ("end", "contrast") else max(0, k - 1), mark)
    return Machine(0, arcs)


def reported() -> Machine:
    """Marks harm ``-rep`` from a verb of saying to the end of the clause."""
    arcs = {}
    for s in (*SYMBOLS, *MARKS, *(m + "-neg" for m in MARKS)):
        harm = s.startswith(HARM)
        arcs[("told", s)] = ("own" if s == "end" else "told", s + "-rep" if harm else s)
        arcs[("own", s)] = ("told" if s == "report" else "own", s)
    return Machine("own", arcs)


def scorer() -> Machine:
    """Writes multipliers: harm counts 1, near a target 1.5, negated 0.3, reported 0.5 (and their products)."""
    arcs = {}
    for near in range(NEAR + 1):
        for s in SYMBOLS:
            arcs[(near, s)] = (NEAR if s == "target" else 0 if s == "end" else max(0, near - 1), 0.0)
        for kind in MARKS:
            for neg in ("", "-neg"):
                for rep in ("", "-rep"):
                    aimed = near or kind.endswith("-at")
                    weight = (1.5 if aimed else 1.0) * (0.3 if neg else 1.0) * (0.5 if rep else 1.0) * (2.0 if kind.startswith("threat") else 1.0)
                    arcs[(near, kind + neg + rep)] = max(0, near - 1), weight
    return Machine(0, arcs)


def grammar() -> Machine:
    """The forward machine, over symbols that the backward one has marked."""
    symbols = (*SYMBOLS, *MARKS)
    return compose(compose(negation(), reported(), symbols), scorer(), symbols)


class Lexicon:
    """Words to (symbol, weight) by the lexicon machine; a word it doesn't know goes by its longest learned stem."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.memo, self.back = stems, {}, ahead()
        self.weights = {s.removesuffix("$"): w for s, w in stems.items() if s.endswith("$")}
        self.machine = lexicon_machine(self.weights)

    def __call__(self, word: str) -> tuple[str, float] | None:
        found = self.memo.get(word, 0)
        if found == 0:
            if len(self.memo) > MOST_REMEMBERED:
                self.memo.clear()
            found = self.memo[word] = self.look(word)
        return found

    def look(self, word: str) -> tuple[str, float] | None:
        symbol = self.machine.step(self.machine.start, f"{word}$")[1]
        if not symbol.endswith("$"):
            return symbol, self.weights.get(word, 0.0) if symbol == "insult" else 1.0
        for s in (word[:n] for n in sorted(STEMS, reverse=True) if len(word) >= n):
            if s in self.stems:
                return "insult", self.stems[s]
        return None


def clause_scores(text: str | None, lexicon: Lexicon, machine: Machine) -> tuple[list[float], int, int, int]:
    """(scores of clauses with harm, harmful words, distinct harmful words, words).

    The backward machine reads a clause first, then the forward one reads what it wrote.
    """
    words = _TOKEN.findall(text.lower()) if text else []
    kinds = list(map(lexicon, words))
    harm = [i for i, k in enumerate(kinds) if k is not None and k[0] in HARM]
    scores, done = [], -1
    for i in harm:
        if i <= done:
            continue
        a = i
        while a and not (kinds[a - 1] and kinds[a - 1][0] == "end"):
            a -= 1
        z = i + 1
        while z < len(words) and not (kinds[z] and kinds[z][0] == "end"):
            z += 1
        clause, back, state, total = [k or ("other", 0.0) for k in kinds[a : z + 1]], lexicon.back.start, machine.start, 0.0
        for k in range(len(clause) - 1, -1, -1):
            back, symbol = lexicon.back.step(back, clause[k][0])
            clause[k] = symbol, clause[k][1]
        for symbol, weight in clause:
            state, paid = machine.step(state, symbol)
            total += paid * weight
        scores.append(total)
        done = z
    return scores, len(harm), len({words[i] for i in harm}), sum(w not in _MARKS for w in words)


def features(text: str | None, lexicon: Lexicon, machine: Machine) -> list[float]:
    """Of a document: all clauses' score, the worst clause, harmful clauses, distinct harm, score per word."""
    scores, _, distinct, n = clause_scores(text, lexicon, machine)
    total = sum(scores)
    return [math.log1p(total), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(distinct), math.log1p(100 * total / max(n, 1))]


class Model(NamedTuple):
    stems: dict[str, float]
    weights: list[float]  # FEATURES weights and the bias

    def score(self, x: list[float]) -> float:
        z = sum(w * v for w, v in zip(self.weights, x, strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def words_and_stems(text: str | None) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w not in _MARKS} if text else set()
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, toxic, fold) of at most ``most`` labelled rows that aren't held out, the first by a hash of their id."""
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    return rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(10)) < 3).alias("fold"))


def learn_stems(train: DataFrame, most: int = MOST_STEMS) -> dict[str, float]:
    """The ``most`` most telling words (``word$``) and stems with the log odds they lend to toxicity.

    A few documents are enough (LEAST_DOCS, LEAST_Z), so that a language with few labels counts too; nearly
    all of them must be toxic (LEAST_RATE).
    """

    def count(batches) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        n, p = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words_and_stems(text)
                n.update(own)
                if toxic:
                    p.update(own)
            if len(n) > 500_000:
                yield _pairs(pa, n, p)
                n, p = Counter(), Counter()
        yield _pairs(pa, n, p)

    all_n, all_p = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not all_p or all_p == all_n:
        return {}
    base = all_p / all_n
    counted = train.select("text", "toxic").mapInArrow(count, "stem string, n long, p long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(F.col("n") >= LEAST_DOCS)
    z = (F.col("p") - F.col("n") * F.lit(base)) / F.sqrt(F.col("n") * F.lit(base * (1 - base)) + 1)
    odds = F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5)) - F.lit(math.log(base / (1 - base)))
    best = counted.select("stem", z.alias("z"), odds.alias("w"), (F.col("p") / F.col("n")).alias("rate")).where((F.col("z") >= LEAST_Z) & (F.col("rate") >= LEAST_RATE)).orderBy(F.desc("z"), "stem").limit(most)
    return {r["stem"]: round(r["w"], 6) for r in best.collect()}


def _pairs(pa, n, p):
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([p[k] for k in n], pa.int64())], names=["stem", "n", "p"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, most_stems: int = MOST_STEMS) -> Model:
    """Logistic weights from three tenths of the sample with stems from the rest, then stems from all of it.

    Only the stems (at most ``most_stems``) and FEATURES numbers a sampled row come to the driver.  Without
    labels of both kinds every text scores 0.  Of several labels of a document the largest counts; null
    labels and labels without a document teach nothing; documents that share an id all do.
    """
    import numpy as np

    from .storage import store

    rows = store(sample(docs, labels, id_col=id_col, text_col=text_col, most=most_labelled), "toxicity-sample")
    stems = learn_stems(rows.where("not fold"), most_stems)
    machine = grammar()

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        lexicon = Lexicon(stems)
        return pd.Series([features(t, lexicon, machine) for t in texts], dtype=object)

    got = rows.where("fold").select(measured("text").alias("x"), "toxic").collect()
    if not stems or len({r["toxic"] for r in got}) < 2:
        return Model(stems, [0.0] * FEATURES + [-30.0])
    x = np.array([[*r["x"], 1.0] for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    w, ridge = np.zeros(FEATURES + 1), np.diag([1.0] * FEATURES + [1e-3])
    for _ in range(50):  # Newton steps with a light ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(learn_stems(rows, most_stems), [round(float(v), 9) for v in w])


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Docs with score, predicted, harm_clauses and worst_clause, from the whole text alone.

    Null and empty texts score as texts without harm.  Input columns of those names are replaced; equal
    texts get equal scores; an empty table stays empty; long texts are read whole, clause by clause.
    """
    machine = grammar()

    @F.pandas_udf("score double, harm_clauses int, worst_clause double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lexicon, out = Lexicon(model.stems), []
        for t in texts:
            x = features(t, lexicon, machine)
            out.append((model.score(x), round(math.expm1(x[2])), x[1]))
        return pd.DataFrame(out, columns=["score", "harm_clauses", "worst_clause"])

    docs, moved = set_aside(docs, "_score")
    rows = docs.select(*local_schema(docs, "score", "predicted", "harm_clauses", "worst_clause"), of(F.col(text_col)).alias("_score"))
    out = rows.select(*[c for c in rows.columns if c != "_score"], "_score.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return put_back(out, moved)
