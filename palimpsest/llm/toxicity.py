"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses; a clause's tokens become symbols: INSULT, HARM (a verb of violence), WILL (intent), TARGET
(a person addressed or spoken of), NEGATE, REPORT (a verb of speech), QUOTE, WORD, and END. The machines are

- insult: an acceptor over letters (a trie of whole words and of stems that take any ending), with a weight per entry;
- negation: a scope of SCOPE symbols after a negating word;
- reported speech: from a verb of speech to the clause's end, or within quotation marks, which clauses don't end;
- target: a person within REACH symbols, before or after;
- threat: intent, then harm within SCOPE symbols.

They are composed: a transducer that reads a clause from its end rewrites an insult with a target ahead of it, and the
product of all others (`GRAMMAR`, a table of its reachable states) reads the rewritten clause and says what each match
is. The clause is what scores: it counts once, as the gravest of its matches by GRAVITY, with the largest weight among
those; a word that a clause repeats adds nothing. A document's features are log(1 + the summed weights of its clauses)
by class, and a logistic model over these few features gives the score.

What is learned, from rows whose id isn't held out: the insult entries and their weights (log-odds of a word's or stem's
document counts) and the logistic weights, which a prior keeps near sensible values where the data say nothing, e.g. for
negated insults. Both are fitted on a bounded sample of labelled rows, at most about `rows_per_class` of each label, of
near copies one. The sample's ids are broadcast to the scan (12 bytes a row), so no text is shuffled. Labels, lang,
source and doc_id never enter a score. Learning and scoring cut words by the same function.

Defined cases: null and empty texts have no clauses and get the model's base score. Labels that are null are not used;
of several labels of a doc_id the highest counts. With no labelled rows of both kinds the lexicon is empty and the prior's
weights hold. Very long texts are read whole. Rows that repeat a doc_id are scored each by itself and learned from each;
of near copies in the sample the smallest text stands for all, so reruns agree. Words of equal odds have equal weights.
Empty tables give no rows. Other columns pass by under any name; one named `to` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkernel import Words, run_hashes
from palimpsest.runtime import save, ship

ROWS_PER_CLASS = 12_000
#: An entry needs so many documents of the sample, and such odds (as a logarithm).
MIN_DOCS, MIN_ODDS, STEM_ODDS = 6, 2.5, 2.0
STEM = 4
SCOPE, REACH = 3, 4

CLASSES = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_negated", "threat_reported")
#: Bias first, then a weight for each of CLASSES.
PRIOR = np.array([-4.0, 5.0, 6.0, 1.0, 1.0, 4.0, 0.5, 0.5])

TARGETS = frozenset("you your yours yourself u ur he she they them him her his their these those people everyone du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos ils elle ellos ellas usted ustedes tú ti tus él".split())
NEGATIONS = frozenset("not no never none nobody without isn't aren't wasn't weren't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais sin nunca ni".split())
REPORTS = frozenset("said says say called calls wrote writes claimed claims quoted quotes tweeted sagte sagt schrieb dit écrit disait dijo dice escribió".split())
WILL = frozenset("will gonna going shall i'll we'll want werde werden wird vais va allons voy vamos".split())
HARM = frozenset("kill hurt destroy murder stab shoot burn beat strangle töten umbringen schlagen tuer frapper matar golpear".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")
_END = frozenset(".!?;:\n")
_QUOTE = frozenset('"“”«»')
_CLOSED = TARGETS | NEGATIONS | REPORTS | WILL
#: What stands before or after an apostrophe without being a word of its own.
_BEFORE = frozenset("l d j m t s c n qu jusqu lorsqu puisqu".split())
_AFTER = frozenset("s re ve ll d m t".split())


def words_of(token: str) -> list[str]:
    """A token's words: articles and endings at an apostrophe go (l'idiot, idiot's), contracted negations and the closed
    lists' entries stay whole."""
    if "'" not in token and "’" not in token:
        return [token]
    token = token.replace("’", "'")
    if token in _CLOSED or token.endswith("n't"):
        return [token]
    parts = token.split("'")
    while len(parts) > 1 and parts[0] in _BEFORE:
        parts = parts[1:]
    while len(parts) > 1 and parts[-1] in _AFTER:
        parts = parts[:-1]
    return parts


class Lexicon:
    """The insult acceptor: entry -> weight; an entry that ends in * accepts every word that begins so."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.whole = {k: v for k, v in entries.items() if not k.endswith("*")}
        self.stems: dict[str, float] = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
        self.sizes = sorted({len(k) for k in self.stems}, reverse=True)
        self.heads = frozenset(k[:3] for k in (*self.whole, *self.stems, *HARM))

    def weight(self, word: str) -> float:
        """A whole word's entry goes before stems (it may be 0: a harmless word that begins like a stem), a longer stem
        before a shorter one."""
        if (w := self.whole.get(word)) is not None:
            return w
        for n in self.sizes:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0


def _clauses(text: str, lexicon: Lexicon) -> Iterator[list[tuple[str, float]]]:
    """Clauses as (symbol, weight) lists."""
    clause: list[tuple[str, float]] = []
    for token in _TOKEN.findall(text):
        if token in _END:
            if clause:
                yield clause
            clause = []
            continue
        if token in _QUOTE:
            clause.append(("QUOTE", 0.0))
            continue
        for t in words_of(token):
            if (w := lexicon.weight(t)) > 0:
                clause.append(("INSULT", w))
            elif t in HARM:
                clause.append(("HARM", 1.0))
            elif t in TARGETS:
                clause.append(("TARGET", 0.0))
            elif t in NEGATIONS or t.endswith("n't"):
                clause.append(("NEGATE", 0.0))
            elif t in REPORTS:
                clause.append(("REPORT", 0.0))
            elif t in WILL:
                clause.append(("WILL", 0.0))
            else:
                clause.append(("WORD", 0.0))
    if clause:
        yield clause


#: AIMED is an insult that a target follows within reach.
SYMBOLS = ("WORD", "INSULT", "AIMED", "HARM", "WILL", "TARGET", "NEGATE", "REPORT", "QUOTE", "END")


def _scope(symbol: str, length: int) -> dict:
    """A machine that holds for `length` symbols after one; the state counts what is left."""
    return {s: {symbol: length, "END": 0, "*": max(s - 1, 0)} for s in range(length + 1)}


#: Machines as state x symbol -> state. Symbols that a state doesn't list take its entry "*".
NEGATION, INTENT, TARGETED = _scope("NEGATE", SCOPE), _scope("WILL", SCOPE), _scope("TARGET", REACH)
REPORTED = {0: {"REPORT": 1, "*": 0}, 1: {"END": 0, "*": 1}}
QUOTED = {0: {"QUOTE": 1, "*": 0}, 1: {"QUOTE": 0, "*": 1}}


def _class(state: tuple[int, ...], symbol: str) -> str | None:
    """What a match is, by the states that precede it."""
    negated, reported, quoted, intent, target = state
    if symbol not in ("INSULT", "AIMED", "HARM") or (symbol == "HARM" and not intent):
        return None
    kind = "threat" if symbol == "HARM" else "insult"
    if reported or quoted:
        return f"{kind}_reported"
    if negated:
        return f"{kind}_negated"
    return "insult_target" if kind == "insult" and (symbol == "AIMED" or target) else kind


def compose(machines: tuple[dict, ...], output) -> tuple[list[dict[str, int]], list[dict[str, str | None]]]:
    """The product of machines as a table of its reachable states: next state and output, by symbol. State 0 starts."""
    start = tuple(0 for _ in machines)
    number, queue = {start: 0}, deque([start])
    step: list[dict[str, int]] = []
    out: list[dict[str, str | None]] = []
    while queue:
        state = queue.popleft()
        row = {}
        for symbol in SYMBOLS:
            after = tuple(m[s].get(symbol, m[s]["*"]) for m, s in zip(machines, state, strict=True))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row[symbol] = number[after]
        step.append(row)
        out.append({symbol: output(state, symbol) for symbol in SYMBOLS})
    return step, out


GRAMMAR = compose((NEGATION, REPORTED, QUOTED, INTENT, TARGETED), _class)
#: Of a clause's matches the first of these decides what the clause is.
GRAVITY = ("insult_target", "threat", "insult", "insult_negated", "insult_reported", "threat_negated", "threat_reported")


def aim(clause: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The clause with insults that a target follows within reach rewritten, read from its end."""
    out, state = [], 0
    for symbol, w in reversed(clause):
        out.append(("AIMED" if symbol == "INSULT" and state else symbol, w))
        row = TARGETED[state]
        state = row.get(symbol, row["*"])
    return out[::-1]


def matches(text: str, lexicon: Lexicon) -> Iterable[tuple[str, float]]:
    """(class, weight) of each clause that matches."""
    step, output = GRAMMAR
    state = 0
    for clause in _clauses(text, lexicon):
        found: dict[str, float] = {}
        for symbol, w in aim(clause) if any(w for _, w in clause) else clause:
            if (c := output[state][symbol]) is not None:
                found[c] = max(found.get(c, 0.0), w)
            state = step[state][symbol]
        state = step[state]["END"]
        if found:
            c = next(c for c in GRAVITY if c in found)
            yield c, found[c]


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(CLASSES)))
    heads = lexicon.heads
    for i, t in enumerate(texts):
        if not t:
            continue
        low = t.lower()
        # Words that no acceptor can begin with make no match; most texts end here.
        if any(w[:3] in heads for w in _WORD.findall(low)):
            for c, w in matches(low, lexicon):
                out[i, CLASSES.index(c)] += w
    return np.log1p(out)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))


def _first_of_copies(batches):
    """Adds a key that near copies mostly share: the smallest hash of five words in a row."""
    for pdf in batches:
        keys = []
        for t in pdf["text"]:
            h = Words([t]).hashes
            r = run_hashes(h, min(5, len(h))) if len(h) else h
            keys.append(int(r.min()) >> 1 if len(r) else 0)
        yield pdf.assign(copy_key=np.array(keys, np.int64))


def _word_counts(batches):
    seen: dict[str, list[int]] = {}
    for pdf in batches:
        for t, y in zip(pdf["text"], pdf["y"], strict=True):
            for w in {w for token in _TOKEN.findall((t or "").lower()) if token[0].isalpha() for w in words_of(token)}:
                seen.setdefault(w, [0, 0])[int(y)] += 1
    yield pd.DataFrame([(w, a, b) for w, (a, b) in seen.items()], columns=["word", "n0", "n1"])


def _odds(n0, n1, all0: float, all1: float):
    return np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))


def sample(docs: DataFrame, labels: DataFrame, held_out: str, rows_per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y, one of near copies) as a saved table; rows a sampled row of each class stands for."""
    spark = docs.sparkSession
    usable = labels.where(f"toxic IN (0, 1) AND doc_id IS NOT NULL AND NOT {held_out}").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    usable = save(usable, "toxic-labels")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    share = F.when(F.col("y") == 1, min(scale, scale * rows_per_class // max(1, counts.get(1, 0)))).otherwise(min(scale, scale * rows_per_class // max(1, counts.get(0, 0))))
    ids = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).select("doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    keyed = rows.select("text", "y").mapInPandas(_first_of_copies, "text string, y int, copy_key long")
    return save(keyed.groupBy("copy_key", "y").agg(F.min("text").alias("text")).select("text", "y"), "toxic-sample"), {y: max(1.0, n / rows_per_class) for y, n in counts.items()}


def learn_lexicon(rows: DataFrame, min_docs: int = MIN_DOCS, min_odds: float = MIN_ODDS) -> Lexicon:
    words = save(rows.mapInPandas(_word_counts, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-words")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all0, all1 = n.get(0, 0), n.get(1, 0)
    if not all0 or not all1:
        return Lexicon({})
    # Words that toxic rows hold far more often; the sample bounds their number.
    odds = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))
    strong = words.where((F.col("n1") >= 2) & (odds >= 1.0)).toPandas()
    # A stem is a beginning shared by words of the toxic rows; its counts are those of all words that begin so.
    prefixes = sorted({w[:k] for w in strong["word"] for k in range(STEM, min(len(w), 10) + 1)})
    entries: dict[str, float] = {}
    if not prefixes:
        return Lexicon({})
    wanted = rows.sparkSession.createDataFrame(pd.DataFrame({"prefix": prefixes}), "prefix string")
    spread = words.select(F.explode(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(10)))).alias("k"), "word", "n0", "n1").where(F.length("word") >= STEM)
    stems = spread.select(F.substring("word", F.lit(1), F.col("k")).alias("prefix"), "n0", "n1").groupBy("prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("kinds"), F.max("n1").alias("top"))
    found = stems.join(wanted, "prefix").toPandas()
    good = found[(found.n1 >= 2 * min_docs) & (_odds(found.n0, found.n1, all0, all1) >= STEM_ODDS) & (found.kinds >= 4)]
    table = {r.prefix: (r.n0, r.n1, r.kinds, r.top) for r in good.itertuples()}
    for p in sorted(table, key=len):
        if p[:-1] in table and len(p) > STEM:
            continue
        # Go down to the longest beginning that all but a few of these words share.
        while True:
            below = [q for q in table if len(q) == len(p) + 1 and q.startswith(p) and table[q][1] >= 0.9 * table[p][1]]
            if not below:
                break
            p = below[0]
        n0, n1, _, top = table[p]
        # Many endings: a stem. One main word: that word is an entry by itself, below.
        if top < 0.8 * n1:
            entries[p + "*"] = float(_odds(n0, n1, all0, all1))
    heads = tuple(k[:-1] for k in entries)
    known = F.lit(False)
    for h in heads:
        known = known | F.col("word").startswith(h)
    # Words of their own standing, and words under a stem whose own counts say something else than the stem's.
    own = words.where((F.col("n0") + F.col("n1") >= min_docs) & (known | (odds >= min_odds)) & (F.length("word") >= 3)).toPandas()
    for r in own.itertuples():
        o = float(_odds(r.n0, r.n1, all0, all1))
        if heads and r.word.startswith(heads):
            entries[r.word] = o if o >= 1 else 0.0
        elif r.n1 >= min_docs:
            entries[r.word] = o
    # Scaled so that a clear entry counts about 1.
    return Lexicon({k: min(1.5, v / 5) for k, v in entries.items()})


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a normal prior around PRIOR."""
    a, b = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (y - p)) - strength * (b - PRIOR)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + strength * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, held_out: str = "false", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    ship(docs.sparkSession)
    rows, stands_for = sample(docs, labels, held_out, rows_per_class)
    lexicon = learn_lexicon(rows)

    def featurise(batches):
        for pdf in batches:
            x = features(pdf["text"].tolist(), lexicon)
            yield pd.DataFrame(x, columns=list(CLASSES)).assign(y=pdf["y"].to_numpy())

    schema = ", ".join(f"{c} double" for c in CLASSES) + ", y int"
    # Equal rows fold into one with a count: at most rows_per_class of each label come to the driver.
    got = rows.mapInPandas(featurise, schema).groupBy(*CLASSES, "y").agg(F.count("*").alias("n")).toPandas()
    if not len(got):
        return Model(lexicon, PRIOR.copy())
    w = got["n"].to_numpy(float) * got["y"].map(lambda v: stands_for.get(v, 1.0)).to_numpy(float)
    return Model(lexicon, fit_weights(got[list(CLASSES)].to_numpy(float), got["y"].to_numpy(float), w))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", to: str = "toxicity") -> DataFrame:
    """docs and a column `to`, 0 to 1. No shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.entries, model.weights))
    held: list[Model] = []

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        if not held:
            held.append(Model(Lexicon(shared.value[0]), shared.value[1]))
        return pd.Series(held[0].score(s.tolist()))

    return docs.withColumn(to, score(F.col(text)))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, false)"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = with_toxicity(docs, fit(docs, labels, HELD_OUT), to="score")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
