"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two segments (words, or letters that stand apart) counts the subsequences of three letters they share,
each worth less for every letter it skips, so an insult with inserted or separated letters stays near the plain one.
A sentence is worth its highest segment. The machine learns from labelled sentences; as only documents have labels, all
sentences of documents without toxicity are negative, and of a toxic document those sentences are positive that hold a
segment which hardly any other document holds, or else the one whose segment scores highest (chosen anew each round).
Landmarks give every segment a short vector; as the decision is linear in shared subsequences, it folds into one
weight for each subsequence, and scoring needs no landmark any more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Words, affordable, documents, held_by, held_out, labelled_sample, learnt, per_text, released, slices

#: Documented bounds of what is learnt from: labelled documents of each label, characters of all of them (half for
#: each label) and of one of them. A longer document teaches nothing, and the others as if it weren't there.
TRAIN_DOCS, TRAIN_CHARS, ROW_CHARS = 3000, 24_000_000, 240_000
#: Landmarks; negative segments of those documents that every round learns from, and the worst placed of all that join them.
LANDMARKS, NEGATIVES, HARD = 384, 9000, 3000
SPAN, DECAY, ROUNDS, CALIBRATION = 6, 0.65, 3, 0.25
RIDGE, VARIED, LONGEST, FLOOR = 20.0, 3.0, 24, -3.0
#: Segments whose subsequences are laid out at once.
PART = 4000

#: Marked fixed values: signs that stand for letters inside a word.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[0134579@$!]+(?=[^\W\d_])")
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(token: str) -> str:
    """A token's letters in lower case; signs between letters count as the letters they look like."""
    token = token.lower()
    if token.isalpha():
        return token
    return _NO_LETTER.sub("", _SIGN_INSIDE.sub(lambda m: m[0].translate(STAND_INS), token))


def windows(segment: str) -> list[str]:
    """A segment, or if it is long, overlapping parts that cover all of it."""
    if len(segment) <= LONGEST:
        return [segment] if segment else []
    return [segment[k : k + LONGEST] for k in range(0, len(segment) - LONGEST // 2, LONGEST // 2)]


def apart(tokens: list[str]) -> list[str]:
    """Runs of three or more single letters that follow each other, joined; tokens of signs only may lie between them."""
    found, run = [], []
    for t in tokens:
        if len(t) == 1 or len(t) <= 3 and not t.isalpha():
            one = letters(t)
            if len(one) == 1:
                run.append(one)
                continue
        if run and any(map(str.isalnum, t)):
            if len(run) >= 3:
                found.append("".join(run))
            run = []
    if len(run) >= 3:
        found.append("".join(run))
    return found


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence: one ends with a token of two letters or more that . ! ? or an ellipsis closes."""
    out, now = [], []
    for t in text.split():
        now.append(t)
        if t[-1] in ".!?\N{HORIZONTAL ELLIPSIS}" and len(letters(t)) > 1:
            out.append(now)
            now = []
    return [*out, now] if now else out


def segments(tokens: list[str]) -> set[str]:
    """What a sentence's (or a text's) tokens are compared by: their letters, and spelt-out letters joined."""
    found = {w for t in set(tokens) for w in windows(letters(t))}
    for s in apart(tokens):
        found.update(windows(s))
    return found


def _codes(joined: str) -> np.ndarray:
    """Letters as numbers below 64: a-z are 1 to 26, others share 27 to 61; 62 and 63 begin and end a segment."""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((c >= 97) & (c <= 122), c - 96, np.where(c == 2, 62, np.where(c == 3, 63, 27 + (c * 40503 >> 4) % 35)))


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, subsequence, weight), sorted by the two; every segment has some."""
    codes = _codes("".join(f"\x02{s}\x03" for s in found))
    lengths = np.array([len(s) + 2 for s in found])
    of = np.repeat(np.arange(len(found)), lengths)
    keys, weights = [], []
    n = len(codes)
    for a in range(1, SPAN - 1):
        for b in range(a + 1, SPAN):
            if n <= b:
                continue
            here = np.flatnonzero(of[: n - b] == of[b:])
            keys.append(of[here] << 18 | codes[here] << 12 | codes[here + a] << 6 | codes[here + b])
            weights.append(np.full(len(here), DECAY ** (b - 2)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, weight = key[first], np.add.reduceat(weight, first)
    return key >> 18, key & 0x3FFFF, weight


@dataclass
class Machine:
    """weight: for each subsequence; bias; platt: slope and offset of the probability over a text's highest decision value."""

    weight: np.ndarray
    bias: float
    platt: tuple[float, float]

    def _known(self) -> Words:
        """Values of tokens seen before, of this machine."""
        return held_by(("toxicity", hash((self.weight.tobytes(), self.bias))), Words)

    def decide(self, found: list[str]) -> np.ndarray:
        """Decision values of segments."""
        out = np.empty(len(found))
        for at in range(0, len(found), PART):
            part = found[at : at + PART]
            of, sub, w = features(part)
            n = len(part)
            out[at : at + n] = np.bincount(of, w * self.weight[sub], n) / np.sqrt(np.bincount(of, w * w, n)) + self.bias
        return out

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest decision value among each text's segments; FLOOR if it has none."""
        return np.concatenate([np.zeros(0), *map(self._highest, slices(texts))])

    def _highest(self, texts: list[str | None]) -> np.ndarray:
        docs, missing = [], set()
        known = self._known()
        known.turn()  # not in between: this slice reads all it adds
        for t in texts:
            tokens = (t or "").split()
            keys = {*tokens, *apart(tokens)}
            missing.update(k for k in keys if k not in known and known.recall(k) is None)
            docs.append(keys)
        todo = [(k, w) for k in missing for w in windows(letters(k))]
        values = self.decide([w for _, w in todo]) if todo else []
        known.update(dict.fromkeys(missing, FLOOR))
        for (k, _), v in zip(todo, values):
            if v > known[k]:
                known[k] = float(v)
        return np.array([max(map(known.__getitem__, keys), default=FLOOR) for keys in docs])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.highest(texts) * self.platt[0] + self.platt[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _kernel(rows: list[str], columns: list[str]) -> np.ndarray:
    """Normalised kernel between segments."""
    of, sub, w = features(columns)
    used, place = np.unique(sub, return_inverse=True)
    norm = np.sqrt(np.bincount(of, w * w, len(columns)))
    table = np.zeros((len(used), len(columns)), np.float32)
    table[place, of] = w / norm[of]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, len(rows), 100):  # a row has some hundred subsequences, each with a value for every column
        part = rows[at : at + 100]
        of, sub, w = features(part)
        norm = np.sqrt(np.bincount(of, w * w, len(part)))
        k = np.minimum(np.searchsorted(used, sub), len(used) - 1)
        hit = used[k] == sub
        of, k, w = of[hit], k[hit], w[hit].astype(np.float32)
        if len(of):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[at + of[first]] = np.add.reduceat(table[k] * w[:, None], first, axis=0)
        out[at : at + len(part)] /= norm[:, None].astype(np.float32)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Primal squared-hinge support vector machine by Newton's method; the last weight is the bias."""
    reg = np.r_[np.full(x.shape[1], RIDGE), 1e-3]
    w = np.zeros(x.shape[1] + 1)
    for _ in range(40):
        g, h = reg * w, np.diag(reg)
        for at in range(0, len(x), PART):  # sums over parts of the rows: no second copy of x
            part = np.c_[x[at : at + PART].astype(np.float64), np.ones(len(x[at : at + PART]))]
            gap = 1 - y[at : at + PART] * (part @ w)
            on = gap > 0
            xs, c = part[on], cost[at : at + PART][on]
            g -= 2 * xs.T @ (c * y[at : at + PART][on] * gap[on])
            h += 2 * (xs * c[:, None]).T @ xs
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _varied(found: list[str], rng: np.random.Generator) -> list[str]:
    """Each segment with one and with two letters inserted inside it."""
    out = []
    for s in found:
        if len(s) < 4:
            continue
        for times in (1, 2):
            v = s
            for _ in range(times):
                k = int(rng.integers(1, len(v)))
                v = v[:k] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + v[k:]
            out.extend(windows(v))
    return out


def _signature(bag: list[str]) -> tuple[int, ...]:
    """The same for most near copies of a document."""
    return tuple(sorted(zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in bag)[:2])


def _spread_counts(bags: list[list[str]]) -> tuple[Counter, int]:
    """In how many bags each segment is, near copies counted once; and how many bags there are so."""
    alike: dict[tuple[int, ...], set[str]] = {}
    for b in bags:
        alike.setdefault(_signature(b), set()).update(b)
    return Counter(s for same in alike.values() for s in same), len(alike)


def fit(bags: list[tuple[int, list[list[str]]]], held: list[tuple[int, float, str]]) -> Machine:
    """The machine of labelled documents, each a list of sentences of segments; held: (label, weight, text) of documents that calibrate."""
    pos = [[s for s in d if s] for y, d in bags if y and any(d)]
    neg = [list(set().union(*d)) for y, d in bags if not y and any(d)]
    if not pos or not neg:
        return constant()
    rng = np.random.default_rng(8)
    (in_pos, docs_pos), (in_neg, docs_neg) = _spread_counts([list(set().union(*d)) for d in pos]), _spread_counts(neg)
    odds = {s: np.log((c + 0.5) / (docs_pos + 1)) - np.log((in_neg[s] + 0.5) / (docs_neg + 1)) for s, c in in_pos.items()}
    telling = {s for s, c in in_pos.items() if c >= max(5, 0.002 * docs_pos) and odds[s] > 3}

    def positive(value: dict[str, float]) -> Counter:
        """The segments for which sentences of toxic documents count as positive."""
        found: Counter = Counter()
        for d in pos:
            for s in [t for t in d if not telling.isdisjoint(t)] or [max(d, key=lambda t: max(map(value.__getitem__, t)))]:
                found.update([x for x in s if x in telling] or [max(sorted(s), key=value.__getitem__)])
        return found

    witness = positive(odds)
    all_neg = sorted(in_neg)
    share = np.array([in_neg[s] for s in all_neg], float) ** 0.5
    chosen = [all_neg[k] for k in rng.choice(len(all_neg), min(len(all_neg), NEGATIVES), replace=False, p=share / share.sum())]
    hard: list[str] = []
    machine = constant()
    for round_ in range(ROUNDS):
        good = [s for s, _ in witness.most_common()]
        varied = _varied([s for s in good if witness[s] > 1] or good, rng)
        bad = list(dict.fromkeys([*hard, *chosen]))
        marks = list(dict.fromkeys([*good[: LANDMARKS // 2], *bad[: LANDMARKS // 2]]))
        kmm = _kernel(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])  # the Nystroem map: kernel rows times this
        y = np.r_[np.ones(len(good) + len(varied)), -np.ones(len(bad))]
        cost = np.r_[np.sqrt([witness[s] for s in good]), np.full(len(varied), VARIED), np.ones(len(bad))]
        cost[y > 0] *= len(bad) / cost[y > 0].sum()
        w = _svm(_kernel([*good, *varied, *bad], marks) @ root.astype(np.float32), y, cost)
        alpha = root @ w[:-1]
        of, sub, u = features(marks)
        weight = np.bincount(sub, u * (alpha / np.sqrt(np.bincount(of, u * u, len(marks))))[of], 1 << 18)
        machine = Machine(weight, float(w[-1]), (1.0, 0.0))
        if round_ < ROUNDS - 1:
            witness = positive(dict(zip(in_pos, machine.decide(list(in_pos)))))
            scores = machine.decide(all_neg)
            hard = [all_neg[k] for k in np.argsort(-scores, kind="stable")[:HARD]]
    if held:
        top = machine.highest([t for _, _, t in held])[:, None]
        label, weight = np.array([y for y, _, _ in held], float), np.array([w for _, w, _ in held])
        if 0 < label.mean() < 1:
            a, b = logistic(top, label, weight, ridge=1e-2)
            machine.platt = (max(float(a), 0.0), float(b))
    return machine


def constant() -> Machine:
    """The machine that has nothing to learn from: every score is low and the same."""
    return Machine(np.zeros(1 << 18), 0.0, (0.0, -4.0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, row_chars: int = ROW_CHARS) -> Machine:
    """Learns from labelled documents that are not held out: at most train_docs of each label, the first by a hash of the key.

    All of it runs in one task, whose input the two bounds limit; the driver gets the machine alone. A key with several
    labels has the highest, one with several texts the least; null labels and texts are left out, as is a text of more than
    row_chars or than what is left of its label's half of train_chars; of a label without any other text the shortest is
    thinned to that. Without documents of both labels every score is low and the same. Other columns are ignored, whatever their names.
    """
    sample = labelled_sample(docs, labels, key, label, {"t": text}, train_docs, "toxicity", F.max)

    def learn(rows: Iterator[tuple]) -> dict:
        import sys

        bags, held = [], []
        for y, weight, calibrates, t in affordable((r for r in rows if r[3] is not None), 3, lambda r: r[0], train_chars // 2, row_chars):
            if calibrates < CALIBRATION:
                held.append((y, weight, t))
            else:  # a segment comes in many documents, but once in memory
                bags.append((y, [[sys.intern(s) for s in sorted(segments(x))] for x in sentences(t)]))
        m = fit(bags, held)
        return {"weight": m.weight.astype("<f4").tobytes(), "bias": m.bias, "slope": m.platt[0], "offset": m.platt[1]}

    got = learnt(sample, learn, "weight binary, bias double, slope double, offset double")
    return Machine(np.frombuffer(got.weight, "<f4").astype(np.float64), got.bias, (got.slope, got.offset)) if got else constant()


def classify(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for every row, from the whole text alone.

    A null or empty text has the lowest score. Rows are independent: repeated rows and null keys are as any other.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return per_text(docs, key, text, lambda texts: [(float(s), int(s >= 0.5)) for s in sent.value.score(texts)], "score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text)

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(sent.value.score(b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(lambda batches: released(clean(batches)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
