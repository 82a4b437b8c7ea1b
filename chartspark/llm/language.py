"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

A text is lower-cased; every run of other characters than letters is one space.  A 4-gram of
characters is one 64-bit key (16 bits each).  For every key of any language the log
probabilities under all languages stand in one row, so a text is scored with one binary search
per character; only keys never seen fall back to the arrays of the lower orders.

The models are fitted on a bounded sample: about ``per_language`` labelled documents of each
language, drawn by a hash of the id.  Every whole text is then predicted in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import unit_hash

ORDER = 4
CHARS_AT_ONCE = 1 << 20
PER_LANGUAGE = 2000
DEVIATIONS = 12
UNKNOWN = 0xFFFF
UNDETERMINED = "und"
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of others than letters is one zero."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = np.where(letters()[found], found, 0)
    if len(found) > 1:
        found = found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]
    return found


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol; three spaces come before the first."""
    x = np.concatenate((np.zeros(ORDER - 1, np.uint64), symbols.astype(np.uint64)))
    n = len(symbols)
    return (x[:n] << np.uint64(48)) | (x[1 : n + 1] << np.uint64(32)) | (x[2 : n + 2] << np.uint64(16)) | x[3 : n + 3]


def symbols_of(found: np.ndarray) -> np.ndarray:
    """Code points as 16-bit symbols; those beyond share the one for unknown letters."""
    return np.where(found < UNKNOWN, found, UNKNOWN)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted array, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Arrays of all languages: per order the sorted keys with log probabilities, and contexts with log back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None

    def logs(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each key's last symbol under each language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(wanted), len(self.languages)))
        keys, values = self.grams[order - 1]
        at, there = _at(keys, wanted)
        if len(keys):
            out = values[at]
        else:
            out = np.zeros((len(wanted), len(self.languages)), np.float32)
        lost = np.flatnonzero(~there)
        if len(lost):
            missed = wanted[lost]
            lower = self.logs(missed & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
            keys, values = self.contexts[order - 1]
            at, there = _at(keys, missed >> np.uint64(16))
            out[lost] = lower + (np.where(there[:, None], values[at], 0) if len(keys) else 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: nats per symbol under each language, number of symbols, whether it has a letter."""
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def settle() -> None:
            if waiting:
                starts = np.cumsum([0, *(len(w) for w in waiting[:-1])])
                np.add.at(total, owners, -np.add.reduceat(self.logs(np.concatenate(waiting)), starts, axis=0, dtype=np.float64))
                waiting.clear()
                owners.clear()

        for i, text in enumerate(texts):
            found = points(text)
            lettered[i] = bool(found.any())
            if not lettered[i]:
                continue
            keys = keys_of(symbols_of(found))
            n[i] = len(keys)
            for at in range(0, len(keys), CHARS_AT_ONCE):
                part = keys[at : at + CHARS_AT_ONCE]
                waiting.append(part)
                owners.append(i)
                size += len(part)
                if size >= CHARS_AT_ONCE:
                    settle()
                    size = 0
        settle()
        return total / np.maximum(n, 1)[:, None], n, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text.

        The score is the share of the best language when each weighs ``exp(-20 x nats per symbol)``.  A text is
        rejected that has no letter, or whose cross-entropy lies
        ``DEVIATIONS`` or more beyond that of labelled texts of its length: other scripts and noise, not unusual prose.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        nats, n, lettered = self.entropies(texts)
        best = nats.argmin(axis=1)
        lowest = nats[np.arange(len(texts)), best]
        score = 1 / np.exp(-20 * (nats - lowest[:, None])).sum(axis=1)
        limit = self.centre[best] + DEVIATIONS * (self.spread[best] + self.per_char[best] / np.sqrt(np.maximum(n, 1)))
        names = [self.languages[b] if there else UNDETERMINED for b, there in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), ~lettered | (lowest > limit)


def _order(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one language's order: discounted share of each key, its contexts, and their back-off weights."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
    total = np.bincount(at, weights=n)
    kinds = np.bincount(at)
    return (n - discount) / total[at], contexts, discount * kinds / total


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney models from each language's sorted 4-gram keys and their counts."""
    model = Model(sorted(counts))
    size = len(model.languages)
    if not size:
        return model
    levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [counts]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: kinds of keys that end alike
        mask = np.uint64((1 << (16 * order)) - 1)
        levels.insert(0, {k: np.unique(keys & mask, return_counts=True) for k, (keys, _) in levels[0].items()})
    symbols = np.unique(np.concatenate([keys for keys, _ in levels[0].values()]))
    model.floor = np.full(size, -np.log(len(symbols) + 1.0), np.float32)
    for order, level in enumerate(levels, 1):
        keys = np.unique(np.concatenate([k for k, _ in level.values()]))
        share = np.zeros((len(keys), size))
        parts = {name: _order(*level[name]) for name in model.languages}
        contexts = np.unique(np.concatenate([p[1] for p in parts.values()]))
        weight = np.ones((len(contexts), size))
        for j, name in enumerate(model.languages):
            share[np.searchsorted(keys, level[name][0]), j] = parts[name][0]
            weight[np.searchsorted(contexts, parts[name][1]), j] = parts[name][2]
        lower = model.logs(keys & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
        held = weight[np.searchsorted(contexts, keys >> np.uint64(16))] if order > 1 else weight[np.zeros(len(keys), np.int64)]
        model.grams.append((keys, np.log(share + held * np.exp(lower.astype(np.float64))).astype(np.float32)))
        model.contexts.append((contexts, np.log(weight).astype(np.float32)))
    return model


def calibrate(model: Model, texts: dict[str, list[tuple[float, int]]]) -> Model:
    """Centre and deviations of cross-entropy from texts the counts did not see, as ``(nats per symbol, symbols)``."""
    size = len(model.languages)
    model.centre, model.spread, model.per_char = np.full(size, 3.0), np.full(size, 0.2), np.full(size, 3.0)
    for j, name in enumerate(model.languages):
        if len(held := np.array(texts.get(name, []), dtype=float).reshape(-1, 2)) >= 10:
            model.centre[j] = np.average(held[:, 0], weights=held[:, 1])
            off = held[:, 0] - model.centre[j]
            model.spread[j] = max(0.05, np.sqrt(np.average(off**2, weights=held[:, 1])))
            model.per_char[j] = max(1.0, np.sqrt(np.mean(off**2 * held[:, 1])))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether ``crc32`` of the id as text leaves 1 by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language that are labelled, have an id and are not held out.

    A fifth of the sample calibrates the rejection.  What reaches the driver is the sample's 4-gram counts, bounded by
    the sample.  Without labelled rows the model knows no language.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))))
    sample = rows.where(unit_hash(F.lit("language"), F.col("doc_id")) < share[F.col("lang")])
    sample = sample.select("lang", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = keys_of(symbols_of(points(text)))
                seen.setdefault(lang, []).append(keys)
                size += len(keys)
                if size > 4 * CHARS_AT_ONCE:
                    yield from flush(seen)
                    size = 0
        yield from flush(seen)

    def flush(seen: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in seen.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])
        seen.clear()

    counted = sample.where("not held").select("lang", "text").mapInArrow(count, "lang string, key long, n long")
    table = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = {}
    for lang, part in table.groupby("lang"):
        keys, n = part["key"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        counts[lang] = (keys[order], n[order].astype(float))
    model = fit(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            nats, n, lettered = known.entropies(batch.column(1).to_pylist())
            kept = [(lang, float(nats[i, known.languages.index(lang)]), int(n[i])) for i, lang in enumerate(names) if lettered[i] and lang in known.languages]
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["lang", "nats", "n"])

    held: dict[str, list[tuple[float, int]]] = {}
    if model.languages:
        for row in sample.where("held").select("lang", "text").mapInArrow(measure, "lang string, nats double, n long").collect():
            held.setdefault(row["lang"], []).append((row["nats"], row["n"]))
    return calibrate(model, held)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``: one row per row of ``docs``, in one pass.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text when the model knows no
    language.  Ties go to the smaller language name.  Rows with null or repeated ids are predicted like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = shared.value.predict([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
