"""Toxicity: a weighted finite-state grammar over clauses.

The lexicon of insults is learned from labelled rows: words and word beginnings (4 to 8 bytes) that are far more
frequent in toxic texts, by the likelihood ratio.  Threats, targets, negations and words of reported speech are
fixed lists.  Each text becomes a tape of symbols, one for each word; a clause goes from one of ``. ! ? ; \\n`` to the
next.  Three transducers, each a table of states, rewrite the tape:

* *report*: an insult or threat after a word of reported speech in the clause is a reported one;
* *negation*: an insult or threat within ``reach`` words after a negation is a negated one;
* *target*: an insult or threat within ``reach`` words after a target is a targeted one.

``compose`` makes one machine of them.  It reads each clause from left to right, and the target transducer then reads
what it wrote from right to left, for targets that follow.  Matches weigh what their word weighs in the lexicon; the
symbol that a match ends as decides the channels that this weight goes to.

A logistic model over the channel sums turns matches into a score from 0 to 1.  Language, source and ids are never
inputs.  The lexicon and the model are fitted on at most ``max_sample`` labelled rows (lowest xxhash64 of the id);
texts scored are never cut.

Nulls and empty texts get the score of a text without matches.  Labels with nulls are ignored; of ties and repeated
rows each is scored.  Without labelled rows of both kinds, the fixed lists and fixed weights score.  Empty tables
give empty results.  Only ``doc_id`` and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import textkit as tk

#: Word lists of the grammar's closed classes.
THREATS = "kill hurt destroy shoot burn beat strangle tuer töten matar"
TARGETS = "you your yours he she they them him her du dich dein ihr euch vous tu toi ton usted tú ustedes ellos"
NEGATIONS = "not never neither nor nicht kein keine nie jamais aucun nunca tampoco"
REPORTS = "said says wrote quoted quote claimed sagte schrieb zitierte disait écrit citait dijo escribió citó"
SEED_INSULTS = "idiot moron stupid loser scum"
PREFIXES = (4, 5, 6, 7, 8)
#: Symbols of the tape, and those that the transducers write for a match.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, REPORTED, NEGATED, TARGETED = range(9)
CORES = (INSULT, THREAT)
N_FEATURES = 8


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes of the insult lexicon
    weights: np.ndarray
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0, 0.5, -0.5, -0.5, 0.0, 0.5, 0.5]))
    means: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scales: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    reach: int = 5


def _hashes(words: str) -> np.ndarray:
    return np.array(sorted(tk.hash_word(w) for w in words.split()), dtype=np.uint64)


def _level(h: np.ndarray, k: int) -> np.ndarray:
    """Features of beginnings live apart from those of whole words."""
    return h ^ tk.U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))


def _features(w: tk.Words):
    """(level, word index, feature hash) for whole words (level 0) and their beginnings."""
    yield 0, np.arange(len(w.hashes)), w.hashes
    length = w.ends - w.starts
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        yield k, at, _level(w.span_hash(w.starts[at], w.starts[at] + k), k)


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where h is a key, the key's index)."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(keys >> tk.U64(48)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(h >> tk.U64(48)).astype(np.int64)])
    pos = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[pos] == h[at]
    return at[ok], pos[ok]


_CLOSED = [(THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)]
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;\n"]] = True


@dataclass(frozen=True)
class Transducer:
    """Tables of the next state and of the symbol written, by state and symbol read; it begins in state 0."""

    step: np.ndarray
    write: np.ndarray


def scope(trigger: int, marked: int, reach: int | None) -> Transducer:
    """Cores within ``reach`` words after a trigger (None: anywhere after it) are written as ``marked``.

    A state is the number of words for which the last trigger still holds.
    """
    states = (1 if reach is None else reach) + 1
    step = np.empty((states, TARGETED + 1), np.int64)
    write = np.tile(np.arange(TARGETED + 1), (states, 1))
    for s in range(states):
        step[s] = s if reach is None else max(0, s - 1)
        step[s, trigger] = states - 1
        if s:
            write[s, list(CORES)] = marked
    return Transducer(step, write)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads what ``first`` reads and writes what ``second`` makes of its output."""
    a, b = np.divmod(np.arange(len(first.step) * len(second.step)), len(second.step))
    middle = first.write[a]
    return Transducer(first.step[a] * len(second.step) + second.step[b[:, None], middle], second.write[b[:, None], middle])


@cache
def grammar(reach: int) -> tuple[Transducer, Transducer]:
    """The composed machine for reading forwards, and the one for reading its output backwards."""
    target = scope(TARGET, TARGETED, reach)
    return compose(compose(scope(REPORT, REPORTED, None), scope(NEGATION, NEGATED, reach)), target), target


def run(machine: Transducer, clause: np.ndarray, at: np.ndarray, symbols: np.ndarray, reach: int) -> np.ndarray:
    """What a machine writes for the symbols at word positions ``at``, of many clauses in a row; other words are ``WORD``."""
    if not len(at):
        return symbols
    skip = [np.arange(len(machine.step))]
    for _ in range(reach):  # after as many plain words, every scope has ended
        skip.append(machine.step[skip[-1], WORD])
    skip = np.array(skip)
    head = np.flatnonzero(np.append(True, clause[1:] != clause[:-1]))
    length = np.diff(np.append(head, len(at)))
    gap = np.zeros(len(at), np.int64)
    gap[1:] = np.clip(np.abs(at[1:] - at[:-1]) - 1, 0, reach)
    out, state = symbols.copy(), np.zeros(len(head), np.int64)
    live = np.arange(len(head))
    for k in range(int(length.max())):
        live = live[length[live] > k]
        x = head[live] + k
        now = skip[gap[x], state[live]] if k else state[live]
        out[x] = machine.write[now, symbols[x]]
        state[live] = machine.step[now, symbols[x]]
    return out


def rewrite(clause: np.ndarray, at: np.ndarray, symbols: np.ndarray, reach: int) -> np.ndarray:
    """The symbols as the grammar writes them, both ways."""
    forwards, backwards = grammar(reach)
    out = run(forwards, clause, at, symbols, reach)
    return run(backwards, clause[::-1], at[::-1], out[::-1], reach)[::-1]


def channels(data: np.ndarray, offsets: np.ndarray, i: int, j: int, model: Model) -> np.ndarray:
    """One row of channel values per text i..j."""
    w = tk.Words(data, offsets, i, j, tk.ALNUM)
    weight = np.zeros(len(w.hashes))
    kind = np.zeros(len(w.hashes), np.int8)
    for cls, words in _CLOSED:
        at, _ = _lookup(_hashes(words), w.hashes)
        kind[at] = cls
    weight[kind == THREAT] = 2.0
    for _, at, h in _features(w):
        hit, pos = _lookup(model.keys, h)
        np.maximum.at(weight, at[hit], model.weights[pos])
        kind[at[hit]] = INSULT
    tape = np.flatnonzero(kind)
    n_words = w.counts().astype(float)
    out = np.zeros((j - i, 6))
    if np.isin(kind[tape], CORES).any():
        ends = np.flatnonzero(_ENDS[data[w.base : int(offsets[j])]])
        clause = np.searchsorted(ends, w.starts[tape]) + w.doc[tape]
        full = np.isin(clause, np.unique(clause[np.isin(kind[tape], CORES)]))
        tape, clause = tape[full], clause[full]
        symbols = kind[tape].astype(np.int64)
        core = np.isin(symbols, CORES)
        written = rewrite(clause, tape, symbols, model.reach)[core]
        doc, value = w.doc[tape][core], weight[tape][core]
        for c, own in enumerate((np.isin(written, (*CORES, TARGETED)), written == TARGETED, written == NEGATED, written == REPORTED)):
            out[:, c] = np.bincount(doc[own], weights=value[own], minlength=j - i)
        out[:, 4] = np.bincount(doc, minlength=j - i)
        out[:, 5] = np.bincount(doc[np.append(True, clause[core][1:] != clause[core][:-1])], minlength=j - i)
    total = out[:, :4].sum(axis=1)
    rate = total / np.maximum(n_words, 1)
    return np.column_stack([np.log1p(out), np.log1p(100 * rate), np.sqrt(rate)])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_lexicon(sample: DataFrame, max_entries: int, min_docs: int, min_g2: float) -> tuple[np.ndarray, np.ndarray]:
    """Insult features from (text, toxic), by counts over the sample; the lexicon has ``max_entries`` at most."""

    def count(batches):
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(0))
            toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            for i, j in tk.slices(offsets, 1 << 22):
                w = tk.Words(data, offsets, i, j, tk.ALNUM)
                keys, docs = [], []
                for _, at, h in _features(w):
                    keys.append(h)
                    docs.append(w.doc[at])
                keys, docs = np.concatenate(keys), np.concatenate(docs)
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                y = toxic[i:j][docs]
                new_key = np.ones(len(keys), bool)
                new_key[1:] = keys[1:] != keys[:-1]
                new_doc = new_key.copy()
                new_doc[1:] |= docs[1:] != docs[:-1]
                at = np.flatnonzero(new_key)
                if not len(at):
                    continue
                add = lambda v: np.add.reduceat(v, at)
                cols = [keys[at].view(np.int64), add(y), add(1 - y), add(y * new_doc), add((1 - y) * new_doc)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "n1", "n0", "d1", "d0"])
                n1, n0 = int((w.doc.size and toxic[i:j][w.doc].sum()) or 0), 0
                n0 = len(w.doc) - n1
                t = int(toxic[i:j].sum())
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n1]), pa.array([n0]), pa.array([t]), pa.array([j - i - t])], names=["key", "n1", "n0", "d1", "d0"])

    counts = sample.mapInArrow(count, "key long, n1 long, n0 long, d1 long, d0 long")
    sums = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "d1", "d0")]).filter((F.col("key") == 0) | (F.col("d1") >= min_docs))
    total = F.broadcast(sums.filter("key = 0").select(*[F.col(c).alias(f"t_{c}") for c in ("n1", "n0", "d1", "d0")]))
    e1 = (F.col("n1") + F.col("n0")) * F.col("t_n1") / (F.col("t_n1") + F.col("t_n0"))
    e0 = (F.col("n1") + F.col("n0")) * F.col("t_n0") / (F.col("t_n1") + F.col("t_n0"))
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    d1e = (F.col("d1") + F.col("d0")) * F.col("t_d1") / (F.col("t_d1") + F.col("t_d0"))
    d0e = (F.col("d1") + F.col("d0")) * F.col("t_d0") / (F.col("t_d1") + F.col("t_d0"))
    scored = sums.filter("key != 0").join(total).filter("t_n1 > 0 and t_n0 > 0").select(
        "key",
        F.log(((F.col("n1") + 0.5) / (F.col("t_n1") + 1)) / ((F.col("n0") + 0.5) / (F.col("t_n0") + 1))).alias("weight"),
        F.least(2 * (part(F.col("n1"), e1) + part(F.col("n0"), e0)), 2 * (part(F.col("d1"), d1e) + part(F.col("d0"), d0e))).alias("g2"),
    )
    rows = scored.filter((F.col("weight") > 1.0) & (F.col("g2") > min_g2)).orderBy(F.desc("g2"), "key").limit(max_entries).collect()
    keys = np.array([r.key for r in rows], dtype=np.int64).view(np.uint64)
    weights = np.array([min(r.weight, 6.0) for r in rows])
    order = np.argsort(keys)
    return keys[order], weights[order]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the first coefficient is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (p - y) + ridge * b
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = 20_000, max_entries: int = 20_000, min_docs: int = 4, min_g2: float = 22.0) -> Model:
    """Fit on labelled rows of ``docs`` that are not held out, at most ``max_sample`` of them."""
    seeds = _hashes(SEED_INSULTS)
    default = Model(seeds, np.full(len(seeds), 3.0))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    # at most max_sample small rows
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    keys, weights = learn_lexicon(sample, max_entries, min_docs, min_g2)
    if not len(keys):
        return default
    model = Model(keys, weights)

    def measure(batches):
        names = ["toxic", *[f"x{k}" for k in range(N_FEATURES)]]
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(0))
            for i, j in tk.slices(offsets):
                x = channels(data, offsets, i, j, model)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), *[pa.array(x[:, k]) for k in range(N_FEATURES)]], names=names)

    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(N_FEATURES))
    rows = sample.mapInArrow(measure, schema).toPandas().to_numpy(dtype=float)
    y, x = rows[:, 0], rows[:, 1:]
    model.means, model.scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.coefficients = fit_logistic((x - model.means) / model.scales, y)
    return model


def predict(x: np.ndarray, model: Model) -> np.ndarray:
    z = model.coefficients[0] + (x - model.means) / model.scales @ model.coefficients[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def score(batches):
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets):
                p = predict(channels(data, offsets, i, j, model), model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns stay as they are."""

    def keep(batches):
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column("text"))
            ok = [predict(channels(data, offsets, i, j, model), model) < threshold for i, j in tk.slices(offsets)]
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(keep, docs.schema)
