"""Language identification by interpolated Kneser-Ney character models, one for each language.

Each model keeps, for every order, the hashes of its character n-grams in a sorted array beside their interpolated
log-probabilities, and the hashes of its contexts beside the log of the mass they leave to the lower order. A text
goes to the language of lowest cross-entropy per character; the posterior that the score comes from is calibrated on
held-back documents, and so is the score below which a text can be rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import affordable, arrow_schema, cut, documents, held_out, per_text, released, small

if TYPE_CHECKING:
    import pandas as pd

ORDER, DISCOUNT = 4, 0.75
#: Documented bounds of what a language's model is learnt from: documents, characters of all of them and of one; and the share of the documents that calibrates.
TRAIN_DOCS, TRAIN_CHARS, ROW_CHARS, CALIBRATION = 500, 6_000_000, 240_000, 0.2
UNDETERMINED = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, letters only, runs of anything else as one space, a space before and after."""
    return f" {_NO_LETTER.sub(' ', text.lower()).strip()} "


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    """A hash for each row of characters."""
    k = codes.shape[1]
    h = np.full(len(codes), (k * 0x9E3779B97F4A7C15) % 2**64, np.uint64)
    for j in range(k):
        h = (h ^ codes[:, j]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that end at each place from k - 1 on."""
    return _hash_rows(np.lib.stride_tricks.sliding_window_view(codes, k))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


@dataclass
class Model:
    """grams[k], probs[k]: of order k + 1; contexts[k], left[k]: contexts of k + 1 characters and what they leave."""

    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]
    unseen: float

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """codes: rows of ORDER characters; log-probability of the last one of each after those before it."""
        order = codes.shape[1]
        out = np.full(len(codes), self.unseen, np.float64)
        for k in range(order):
            at, found = _find(self.grams[k], _hash_rows(codes[:, order - 1 - k :]))
            if k:
                c, had = _find(self.contexts[k - 1], _hash_rows(codes[:, order - 1 - k : -1]))
                out = np.where(had, out + self.left[k - 1][c], out)
            out = np.where(found, self.probs[k][at], out)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def fit(counts: dict[str, int], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The model of a language's counts of n-grams of the highest order."""
    by_order: list[dict[str, float]] = [dict(counts)]
    for k in range(order - 1, 0, -1):  # below the highest: in how many contexts a gram goes on
        by_order.insert(0, Counter(g[1:] for g in by_order[0]))
    grams, probs, contexts, left = [], [], [], []
    lower: dict[str, float] = {}
    symbols = len(by_order[0]) + 1
    unseen = 0.0
    for k, table in enumerate(by_order):
        total, kinds = defaultdict(float), defaultdict(int)
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        here = {}
        for g, c in table.items():
            h = g[:-1]
            base = lower[g[1:]] if k else 1.0 / symbols
            here[g] = max(c - discount, 0.0) / total[h] + discount * kinds[h] / total[h] * base
        if k:
            rows = {h: discount * kinds[h] / total[h] for h in total}
            hashed = _hash_rows(_rows(list(rows), k))
            order_ = np.argsort(hashed)
            contexts.append(hashed[order_])
            left.append(np.log(np.array(list(rows.values())))[order_])
        else:
            unseen = math.log(discount * kinds[""] / total[""] / symbols)
        hashed = _hash_rows(_rows(list(here), k + 1))
        order_ = np.argsort(hashed)
        grams.append(hashed[order_])
        probs.append(np.log(np.array(list(here.values())))[order_])
        lower = here
    return Model(grams, probs, contexts, left, unseen)


def _rows(grams: list[str], k: int) -> np.ndarray:
    return _codes("".join(grams)).reshape(-1, k) if grams else np.zeros((0, k), np.uint64)


@dataclass
class Identifier:
    languages: list[str]
    models: list[Model]
    order: int
    sharpness: float = 1.0
    threshold: float = 0.0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of plain texts (rows) under each language (columns), and their lengths."""
        pad = " " * (self.order - 1)
        lengths = np.array([len(t) - 1 for t in texts])
        sums = np.zeros((len(texts), len(self.models)))
        piece, at = 4_000_000, 0
        while at < len(texts):  # bounded memory, whole texts
            upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), piece)))
            # a text's first space is context only
            codes = _codes("".join(pad + t for t in texts[at:upto])) if upto - at > 1 or lengths[at] <= piece else None
            if codes is None:
                sums[at] = sum((self._sums(_codes((pad + texts[at])[max(0, k) : k + piece + self.order - 1])[None, :].ravel(), [0]) for k in range(1, lengths[at] + 1, piece)), np.zeros((1, len(self.models))))
            else:
                starts = np.r_[0, np.cumsum(lengths[at:upto] + self.order)[:-1]]
                sums[at:upto] = self._sums(codes, starts, lengths[at:upto])
            at = upto
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def _sums(self, codes: np.ndarray, starts: list[int] | np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Sum of log-probabilities for each text of codes; a text's first order characters are context and its first place."""
        import pandas as pd

        n = self.order
        ids, first = pd.factorize(_hash(codes, n))
        where = np.zeros(len(first), np.int64)
        where[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
        rows = np.stack([codes[where + j] for j in range(n)], axis=1)
        table = np.stack([m.log_probs(rows) for m in self.models], axis=1)
        if lengths is None:
            return np.stack([table[:, m][ids].sum(keepdims=True) for m in range(len(self.models))], axis=1)
        # the gram that ends at place p of a text starts at its start + p - n + 1; grams across texts are left out
        begin = np.asarray(starts) + 1
        out = np.zeros((len(begin), len(self.models)))
        for m in range(len(self.models)):
            run = np.r_[0.0, np.cumsum(table[:, m][ids])]
            out[:, m] = run[np.minimum(begin + lengths, len(run) - 1)] - run[np.minimum(begin, len(run) - 1)]
        return out

    def predict(self, texts: list[str | None], reject: bool = False) -> list[tuple[str, float]]:
        """(language, score) of each text; UNDETERMINED with score 0 if it has no letter or is rejected."""
        cleaned = [plain(t) if t and any(map(str.isalpha, t)) else "" for t in texts]
        use = [k for k, t in enumerate(cleaned) if t.strip()]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for k, t in enumerate(cleaned):  # letters that the pattern takes for none (there are hardly any)
            if texts[k] and not t.strip() and any(map(str.isalpha, texts[k])):
                use.append(k)
                cleaned[k] = f" {texts[k].lower().strip()} "
        if not use or not self.models:
            return out
        h, n = self.entropies([cleaned[k] for k in use])
        best = h.argmin(axis=1)
        score = 1 / np.exp(-self.sharpness * np.sqrt(np.maximum(n, 1))[:, None] * (h - h.min(axis=1, keepdims=True))).sum(axis=1)
        for k, b, s in zip(use, best, score):
            if not reject or s >= self.threshold:
                out[k] = (self.languages[b], float(s))
        return out


def sample_of(docs: DataFrame, key: str, text: str, lang: str, train_docs: int) -> DataFrame:
    """Rows (lang, k, at, text) of train_docs documents of each language at most, the first by a hash of the key; nothing held out.

    Of a key's several documents of one language the least counts, so a key that repeats takes one place however many rows it has.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("k"))
    at = F.xxhash64(F.col("k").cast("string"), F.lit("language"))
    keys = rows.select("k", "lang")
    # a little more than needed by the hash (the count is about right), then exactly the first ones
    rates, _ = small(cut(keys.groupBy("lang").agg(F.approx_count_distinct("k").alias("n")).select("lang", (1.3 * train_docs / F.col("n") + 50 / F.col("n")).alias("rate"))))
    near = keys.join(rates, "lang").where(F.pmod(at, F.lit(1_000_000)) / 1e6 < F.col("rate")).select("k", "lang").distinct()
    first = near.withColumn("at", at).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("at", "k"))).where(F.col("place") <= train_docs)
    chosen, _ = small(cut(first.select("k", "lang", "at")))
    return rows.join(chosen, ["k", "lang"]).groupBy("lang", "k", "at").agg(F.min("text").alias("text"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, row_chars: int = ROW_CHARS) -> Identifier:
    """Learns from at most train_docs documents of each language that are not held out, the first by a hash of the key.

    Each language's model is fitted in a task of its own, from at most train_chars characters; a text of more than
    row_chars or than what is left of them is passed over, and of a language without any other text the shortest is
    thinned. The driver gets the models (which are what prediction broadcasts: some megabytes a language) and a few numbers for
    each document that calibrates. Null languages and texts are left out; other columns are ignored, whatever their names.
    """
    sample = cut(sample_of(docs, key, text, lang, train_docs))
    sample = sample.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibration"), F.col("k").cast("string")), F.lit(1000)) < int(1000 * CALIBRATION))
    arrays = "grams", "probs", "contexts", "left"

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = rows.sort_values(["at", "k"], kind="stable")
        table: Counter = Counter()
        for _, t in affordable(zip(rows["lang"], rows["text"]), 1, lambda r: r[0], train_chars, row_chars):
            t = " " * (order - 1) + plain(t)
            table.update(t[k : k + order] for k in range(1, len(t) - order + 1))
        if not table:
            return pd.DataFrame({"lang": [], **{a: [] for a in arrays}, "unseen": []})
        m = fit(dict(sorted(table.items())), order)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], **{a: [[x.tobytes() for x in getattr(m, a)]] for a in arrays}, "unseen": [m.unseen]})

    schema = f"lang string, {', '.join(f'{a} array<binary>' for a in arrays)}, unseen double"
    fitted = sample.where("NOT calibrates").select("lang", F.col("k").cast("string").alias("k"), "at", "text").groupBy("lang").applyInPandas(learn, schema)
    models = {r.lang: Model(*([np.frombuffer(x, np.uint64 if a in ("grams", "contexts") else np.float64) for x in r[a]] for a in arrays), r.unseen) for r in fitted.collect()}  # one row a language
    languages = sorted(models)
    found = Identifier(languages, [models[x] for x in languages], order)
    if len(languages) > 1:
        sent, kinds = docs.sparkSession.sparkContext.broadcast(found), arrow_schema("k string, lang string, n long, h array<double>")

        def measure(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
                rows = [(k, lang_, p) for k, t, lang_ in zip(*(c.to_pylist() for c in b.columns)) if (p := plain(t)).strip() and lang_ in sent.value.languages]
                if rows:
                    h, n = sent.value.entropies([p for _, _, p in rows])
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(n), pa.array(h.tolist(), kinds.field(3).type)], schema=kinds)

        measured = sample.where("calibrates").select(F.col("k").cast("string").alias("k"), "text", "lang").mapInArrow(lambda batches: released(measure(batches)), "k string, lang string, n long, h array<double>")
        _calibrate(found, [(r.lang, r.n, r.h) for r in measured.orderBy("k", "lang", "n").collect()])
    return found


def _calibrate(found: Identifier, measured: list[tuple[str, int, list[float]]]) -> None:
    """Sharpness of the posterior by least log-loss; threshold that 99 of 100 right answers exceed, at most 0.5.

    measured: language, length and cross-entropies of documents that the models were not learnt from.
    """
    if not measured:
        return
    h, n = np.array([m[2] for m in measured]), np.array([m[1] for m in measured])
    truth = np.array([found.languages.index(m[0]) for m in measured])
    gap = np.sqrt(np.maximum(n, 1))[:, None] * (h - h.min(axis=1, keepdims=True))

    def posterior(sharpness: float) -> np.ndarray:
        p = np.exp(-sharpness * gap)
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 40)
    found.sharpness = float(grid[np.argmin([-np.log(np.maximum(posterior(s)[np.arange(len(truth)), truth], 1e-12)).mean() for s in grid])])
    p = posterior(found.sharpness)
    right = p.argmax(axis=1) == truth
    found.threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], 0.01))) if right.any() else 0.0


def identify(docs: DataFrame, model: Identifier, key: str = "doc_id", text: str = "text", reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row; a null text or one without letters is `und` with score 0.

    Only the text counts. With reject, texts that score below the calibrated threshold are `und` too. Rows are
    independent: repeated rows and null keys are as any other. With nothing to learn from, every text is `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, key, text, lambda texts: sent.value.predict(texts, reject), "lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
