"""Operator 9: language by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import forget, mix, pieces, probe, release, remainder

ORDER = 4
# Text that the models learn from, per language: rows are drawn by hash so that about this many bytes are expected.
SAMPLE_BYTES = 3 << 20
# Of the drawn rows, one in CALIBRATE is kept aside, so that languages drawn whole have rows for their limit too.
CALIBRATE = 5
# Short texts are pulled to the typical entropy of their language as if they had so many characters more.
PRIOR_CHARS = 60
# A text is rejected beyond the median plus STRETCH times the distance to this quantile of all rows not fitted on. The
# quantile leaves room for rows with a wrong label, whatever their number of bits.
TOP = 0.95
STRETCH = 3.0
SHARPNESS = 20.0
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(16)], np.uint64)
_CHUNK = 1 << 20
# Words that are scored at once, and bytes of text: both bound a worker's memory only.
_WORDS = 1 << 14
_PIECE = 1 << 23


def letter_runs(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, in lists of bounded size; a run beyond a chunk is cut at blanks if it has any."""
    low = 0
    while low < len(text):
        high = min(len(text), low + _CHUNK)
        if high < len(text):
            gap = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
            high = gap + 1 if gap >= low else high
        yield LETTERS.findall(text[low:high].lower())
        low = high


def _laid_out(runs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all runs, the places that are scored, and how many each run has.

    A run is followed by one blank, and preceded by as many as the longest context needs.
    """
    pad = order - 1
    text = "".join(" " * pad + r + " " for r in runs)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(r) + order for r in runs], np.int64)
    scored = np.ones(len(codes), bool)
    for k in range(pad):
        scored[np.cumsum(sizes) - sizes + k] = False
    return codes, np.flatnonzero(scored), sizes - pad


def grams(runs: list[str], order: int = ORDER, before: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 0..order characters that end ``before`` characters before each character, and characters per run."""
    codes, place, sizes = _laid_out(runs, order)
    out, total = [np.zeros(len(place), np.uint64)], np.zeros(len(place), np.uint64)
    for k in range(order - before):
        total = total + codes[place - k - before] * _WEIGHTS[k]
        out.append(mix(total + np.uint64(k + 1)))
    return out, sizes


def contexts(runs: list[str], order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the 0..order-1 characters before each character."""
    return grams(runs, order, before=1)[0]


@dataclass
class Models:
    """Per order the sorted hashes of grams and of contexts; rows of values hold one column per language."""

    languages: list[str]
    order: int = ORDER
    gram_keys: list[np.ndarray] = field(default_factory=list)
    ratios: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    rests: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    median: np.ndarray | None = None
    limit: np.ndarray | None = None

    def bits(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each run under each language, and its characters."""
        if not runs:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        hashed, sizes = grams(runs, self.order)
        before = contexts(runs, self.order)
        p = np.broadcast_to(self.floor, (len(hashed[0]), len(self.languages)))
        for k in range(self.order):
            at, seen = probe(self.gram_keys[k], hashed[k + 1]), probe(self.context_keys[k], before[k])
            p = self.ratios[k][at] + self.rests[k][seen] * p
        starts = np.cumsum(sizes) - sizes
        return -np.add.reduceat(np.log2(p), starts, axis=0), sizes

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the characters that were scored."""
        seen: dict[str, int] = {}
        spots, sizes = [], []
        for text in texts:
            spot = [seen.setdefault(w, len(seen)) for w in chain.from_iterable(letter_runs(text or ""))]
            spots.append(np.array(spot, np.int32))
            sizes.append(len(spot))
        vocabulary = list(seen)
        bits, chars = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for low in range(0, len(vocabulary), _WORDS):
            b, c = self.bits(vocabulary[low : low + _WORDS])
            # A run of numerals such as a superscript two is no word: it has no letter.
            lettered = np.array([any(map(str.isalpha, w)) for w in vocabulary[low : low + _WORDS]])
            bits.append(b * lettered[:, None])
            chars.append(c * lettered)
        bits, chars = np.concatenate(bits), np.concatenate(chars)
        out, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, spot in enumerate(spots):
            if len(spot):
                words, times = np.unique(spot, return_counts=True)
                out[i] = times @ bits[words]
                count[i] = times @ chars[words]
        return out / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, confidence, rejected) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        entropy, chars = self.entropy(texts)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp2(SHARPNESS * (least[:, None] - entropy)).sum(1)
        pulled = (least * chars + self.median[best] * PRIOR_CHARS) / (chars + PRIOR_CHARS)
        rejected = pulled > self.limit[best]
        return [
            (UNKNOWN, 0.0, True) if not c else (self.languages[b], float(s), bool(r))
            for b, s, r, c in zip(best, score, rejected, chars, strict=True)
        ]


def kneser_ney(languages: list[str], tables: list[list[np.ndarray]], alphabet: list[int], order: int = ORDER) -> Models:
    """Models from per-language gram tables.

    ``tables[l][k]`` has the columns gram, context, gram without its oldest character, count, of the grams of k + 1
    characters. The longest grams keep their counts, shorter ones count the distinct characters seen before them; every order
    gives up its own absolute discount to the next shorter one, down to a uniform choice among the alphabet.
    """
    models = Models(languages, order)
    models.floor = np.array([1.0 / (n + 1) for n in alphabet])
    keys: list[list[np.ndarray]] = [[] for _ in range(order)]
    values: list[list] = [[] for _ in range(order)]
    for table in tables:
        for k in range(order):
            gram, context, _, count = table[k]
            if k < order - 1:
                shorter = np.sort(table[k + 1][2])
                count = (np.searchsorted(shorter, gram, "right") - np.searchsorted(shorter, gram, "left")).astype(np.float64)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            heads, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, count), np.bincount(inverse)
            keys[k].append(gram)
            values[k].append((gram, np.maximum(count - discount, 0) / total[inverse], heads, discount * kinds / total))
    for k in range(order):
        gram_keys = np.unique(np.concatenate(keys[k]))
        context_keys = np.unique(np.concatenate([v[2] for v in values[k]]))
        # One row more, reached by the place -1 of what was never seen: nothing of its own, all from the shorter order.
        ratios, rests = np.zeros((len(gram_keys) + 1, len(languages))), np.ones((len(context_keys) + 1, len(languages)))
        for number, (gram, ratio, heads, rest) in enumerate(values[k]):
            ratios[np.searchsorted(gram_keys, gram), number] = ratio
            rests[np.searchsorted(context_keys, heads), number] = rest
        models.gram_keys.append(gram_keys)
        models.ratios.append(ratios)
        models.context_keys.append(context_keys)
        models.rests.append(rests)
    return models


def _counts(texts: Iterator[tuple[str, str]]) -> dict[str, Counter]:
    found: dict[str, Counter] = {}
    for language, text in texts:
        found.setdefault(language, Counter()).update(chain.from_iterable(letter_runs(text)))
    return found


def usable_rows(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text, fitted) of all rows that may be learned from.

    The models are fitted on rows drawn by hash, about ``sample_bytes`` per language with one in CALIBRATE left out, and on the
    row of each language that comes first by hash, so that none goes without. All others are for the limits.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    aside = F.pmod(F.xxhash64("text", "doc_id"), F.lit(CALIBRATE)) == 0
    lettered = F.when(F.col("text").rlike(r"\p{L}"), drawn)
    sizes = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(lettered).alias("first"))
    share = sizes.select("lang", "first", F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest("bytes", F.lit(1))).alias("share"))
    # The table of languages is one row per label.
    joined = usable.join(F.broadcast(share), "lang")
    fitted = ((drawn < F.col("share")) & ~aside) | F.coalesce(drawn == F.col("first"), F.lit(False))
    return joined.select("lang", "text", fitted.alias("fitted"))


def train(docs: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Models of every label, from words that Spark counts over the drawn rows; the bounded sample limits what arrives here."""
    rows_of = usable_rows(docs, sample_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for language, found in _counts(pairs).items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "word", "n"],
                )
            release()

    counted = rows_of.filter("fitted").select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    # Arrow columns and not rows: the driver holds all words of the sample at once.
    rows = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    languages = sorted(rows["lang"].unique().to_pylist())
    tables, alphabet = [], []
    for language in languages:
        own = rows.filter(pc.equal(rows["lang"], language))
        words, times = own["word"].to_pylist(), own["n"].to_numpy().astype(np.float64)
        hashed, sizes = grams(words, order)
        before, weight = contexts(words, order), np.repeat(times, sizes)
        table = []
        for k in range(order):
            gram, first, inverse = np.unique(hashed[k + 1], return_index=True, return_inverse=True)
            table.append([gram, before[k][first], hashed[k][first], np.bincount(inverse, weight)])
        tables.append(table)
        alphabet.append(len(table[0][0]))
    if not languages:
        return Models([], order)
    models = kneser_ney(languages, tables, alphabet, order)
    del rows, own, words, times, hashed, sizes, before, weight, tables, table, gram, first, inverse
    release()
    return _calibrated(models, rows_of.filter("NOT fitted"))


def _calibrated(models: Models, aside: DataFrame) -> Models:
    """Rejection limits from the entropies of all rows that the models were not fitted on, measured on the executors."""
    held = aside.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = {name: i for i, name in enumerate(held.value.languages)}
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                entropy, chars = held.value.entropy(part.column(1).to_pylist())
                keep = [(name, float(e[known[name]])) for name, e, c in zip(part.column(0).to_pylist(), entropy, chars, strict=True) if c >= PRIOR_CHARS and name in known]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.float64())], ["lang", "bits"])
                release()

    rows = aside.select("lang", "text").mapInArrow(measure, "lang string, bits double")
    spread = {r["lang"]: r["q"] for r in rows.groupBy("lang").agg(F.percentile_approx("bits", [0.5, TOP], 10000).alias("q")).collect()}
    middle = [spread[name][0] if name in spread else np.inf for name in models.languages]
    top = [spread[name][1] if name in spread else np.inf for name in models.languages]
    models.median = np.array([m if np.isfinite(m) else 0.0 for m in middle])
    models.limit = np.array([m + max(1.0, STRETCH * (t - m)) if np.isfinite(m) else np.inf for m, t in zip(middle, top, strict=True)])
    return models


def identify(docs: DataFrame, models: Models, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    The language with the fewest bits per character wins, ties by name; the score compares it with the others. A text
    that is null or has no letter is ``und`` with score 0 and rejected; any other keeps its prediction, and is rejected if
    it costs more than its language's limit. Columns with these names are replaced. Without training rows all are ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch, text_column, _PIECE):
                lang, score, rejected = zip(*held.value.predict(part.column(at).to_pylist()), strict=True)
                columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*names, "lang_pred", "score", "rejected"])
                release()

    source = docs.select(*names)
    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    for name in ("lang_pred", "score", "rejected"):
        schema[name].nullable = True
    return source.mapInArrow(run, schema)


def language_report(docs: DataFrame, **options) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), train(docs, **options))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Rows whose language is not rejected, with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_kept"), F.col("text").alias("_text"))
    found = identify(packed, train(docs, **options), "_text")
    return found.filter(~F.col("rejected")).select("_kept.*")
