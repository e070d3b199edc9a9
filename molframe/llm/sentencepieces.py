"""Operator 7: SentencePiece encoding and decoding, words of one length advancing together in numpy."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from molframe.llm.common import kept, mix, pieces, probe, release

SPACE = "▁"
# Words up to this length advance in numpy; merges of longer ones go through a heap.
LONGEST_WORD = 96
STEP_CELLS = 1 << 21
CACHED_WORDS = 400_000
MEMO_SLOTS = 1 << 21
# Ids whose bytes are gathered at once.
DECODED_AT_ONCE = 1 << 16
# Kinds of model and of piece in the model format, and what an unknown character costs a unigram path.
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_COST = 10.0

_ODD = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_ODD, k, 1 << 64) for k in range(LONGEST_WORD + 1)], np.uint64)
# Spaces begin a word; a run of them belongs to the word that it precedes.
_UNITS = re.compile(r" +[^ ]*")


def split_words(text: str) -> list[str]:
    """Words of a text behind a leading blank, each without its first blank."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    return [u[1:] for u in _UNITS.findall(" " + text)] if "" in parts else parts


@dataclass
class Vocabulary:
    """Pieces of a model: sorted keys and scores; of one with merges also their priority and what each was merged from."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    mergeable: dict[str, int]
    keys: np.ndarray
    key_ids: np.ndarray
    sizes: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    unknown: int
    kind: int = MERGES

    @property
    def longest(self) -> int:
        return int(self.sizes.max())


def _codes(texts: list[str], width: int) -> np.ndarray:
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).astype(np.uint64).reshape(len(texts), width) + np.uint64(1)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        sums[:, i + 1] = sums[:, i] * np.uint64(_ODD) + codes[:, i]
    return sums


def _span_hash(sums: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hash of the characters low..high of every row."""
    return mix(sums[:, high] - sums[:, low] * _POWERS[high - low])


def _kind(model_file: str) -> int:
    """The model's kind; a model that these encoders would not follow is refused."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    kind, rules = proto.trainer_spec.model_type, proto.normalizer_spec
    texts = [p.piece for p in proto.pieces if p.type == NORMAL]
    problems = {
        "neither a unigram model nor one with merges": kind not in (UNIGRAM, MERGES),
        "characters are normalised": bool(rules.precompiled_charsmap),
        "no blank is put before the text": not rules.add_dummy_prefix,
        "blanks are removed": rules.remove_extra_whitespaces,
        "blanks are not escaped": not rules.escape_whitespaces,
        "blanks end words": proto.trainer_spec.treat_whitespace_as_suffix,
        "no byte fallback": not proto.trainer_spec.byte_fallback or sum(p.type == BYTE for p in proto.pieces) != 256,
        "user-defined or unused pieces": any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces),
        "pieces over several words": any(SPACE in t.lstrip(SPACE) for t in texts),
        "overlong pieces": any(len(t) > LONGEST_WORD for t in texts),
    }
    found = [text for text, wrong in problems.items() if wrong]
    if found:
        raise ValueError(f"{model_file} is not supported: {', '.join(found)}")
    return kind


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a unigram model or one with merges, with byte fallback and no normaliser; others are refused with a ValueError.

    This runs once on the driver, the tables are broadcast (some MB).
    """
    kind = _kind(model_file)
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    count = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(count)]
    scores = np.array([model.get_score(i) for i in range(count)])
    special = np.array([model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)])
    byte_ids = np.full(256, model.unk_id())
    for i in range(count):
        if model.is_byte(i):
            byte_ids[int(texts[i][1:-1], 16)] = i
    mergeable = {texts[i]: i for i in range(count) if not special[i]}
    sizes = np.array([0 if special[i] else len(texts[i]) for i in range(count)])
    hashed = np.zeros(count, np.uint64)
    for width in np.unique(sizes[sizes > 0]).tolist():
        ids = np.flatnonzero(sizes == width)
        hashed[ids] = _span_hash(_prefixes(_codes([texts[i] for i in ids], width)), 0, width)
    real = np.flatnonzero(sizes > 0)
    order = real[np.argsort(hashed[real])]
    rank = np.empty(count, np.int64)
    rank[np.lexsort((np.arange(count), -scores))] = np.arange(count)
    left, right = np.full(count, -1), np.full(count, -1)
    pairs = []
    for i in real.tolist() if kind == MERGES else []:
        text = texts[i]
        pairs += [
            (mergeable[text[:k]] * count + mergeable[text[k:]], rank[i])
            for k in range(1, len(text))
            if text[:k] in mergeable and text[k:] in mergeable
        ]
        if len(text) > 1:
            *_, last = _merged(text, mergeable, scores)
            left[i], right[i] = last if last else (-1, -1)
    pairs.sort()
    pair_keys, pair_rank = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return Vocabulary(texts, scores, byte_ids, mergeable, hashed[order], order, sizes, rank, left, right, pair_keys, pair_rank, model.unk_id(), kind)


def _merged(text: str, mergeable: dict[str, int], scores: np.ndarray) -> tuple[list[str], tuple[int, int] | None]:
    """Merge neighbours by score, then place, as long as a pair is a piece; also the last pair that was merged."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(parts) and (both := parts[a] + parts[b]) in mergeable:
            heapq.heappush(queue, (-scores[mergeable[both]], a, b, both))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    last = None
    while queue:
        _, a, b, both = heapq.heappop(queue)
        if parts[a] is None or parts[b] is None or parts[a] + parts[b] != both or after[a] != b:
            continue
        last = (mergeable.get(parts[a], -1), mergeable.get(parts[b], -1))
        parts[a], parts[b], after[a] = both, None, after[b]
        if after[b] < len(parts):
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [p for p in parts if p is not None], last


class Encoder:
    """Encodes words against one vocabulary; keeps what it has seen in two bounded tables."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.characters = {t for t in vocabulary.mergeable if len(t) == 1}
        self.memo_keys = np.full(MEMO_SLOTS, -1, np.int64)
        self.memo_fits = np.zeros(MEMO_SLOTS, bool)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(vocabulary.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, or -1."""
        out = np.full(len(hashed), -1)
        maybe = np.flatnonzero(self.sieve[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = probe(self.v.keys, hashed[maybe])
        out[maybe] = np.where(place >= 0, self.v.key_ids[place], -1)
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would merging leave piece a next to piece b?  Answers are kept in a direct-mapped table."""
        key = a * len(self.v.texts) + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(MEMO_SLOTS - 1)).astype(np.int64)
        fits, ask = self.memo_fits[slot], np.flatnonzero(self.memo_keys[slot] != key)
        if len(ask):
            fresh, back = np.unique(key[ask], return_inverse=True)
            answer = self._undo(fresh // len(self.v.texts), fresh % len(self.v.texts))[back]
            fits[ask] = answer
            self.memo_keys[slot[ask]] = key[ask]
            # A slot may have been asked for two keys at once: what stands there decides.
            kept = self.memo_keys[slot[ask]] == key[ask]
            self.memo_fits[slot[ask][kept]] = answer[kept]
        return fits

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Take the merges of both pieces back, latest first; a pair across the border that merges earlier decides."""
        v = self.v
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, bound = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            place = probe(v.pair_keys, a[live] * len(v.texts) + b[live])
            sooner = (place >= 0) & (v.pair_rank[place] < bound[live]) if len(v.pair_rank) else np.zeros(len(live), bool)
            out[live[sooner]] = False
            live = live[~sooner]
            can_a, can_b = v.right[a[live]] >= 0, v.left[b[live]] >= 0
            live, can_a, can_b = live[can_a | can_b], can_a[can_a | can_b], can_b[can_a | can_b]
            undo_a = can_a & (~can_b | (v.rank[a[live]] > v.rank[b[live]]))
            # At an equal rank the left pair merges first, so the border pair must beat b strictly or tie with it.
            one, two = live[undo_a], live[~undo_a]
            bound[one] = v.rank[a[one]]
            a[one] = v.right[a[one]]
            bound[two] = v.rank[b[two]] + 1
            b[two] = v.left[b[two]]
        return out

    def _advance(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of words of one length that hold only known characters and no run of spaces, joined, and where each ends.

        The lattice runs over character places. A piece may end a prefix if merging leaves it next to the piece that ends
        the shorter prefix; exactly one does, and it is the backpointer.
        """
        v, width = self.v, len(texts[0])
        sums = _prefixes(_codes(texts, width))
        last = np.full((len(texts), width + 1), -1)
        for i in range(1, width + 1):
            open_rows = np.arange(len(texts))
            for size in range(min(i, v.longest), 0, -1):
                found = self._find(_span_hash(sums[open_rows], i - size, i))
                rows, ids = open_rows[found >= 0], found[found >= 0]
                if size < i:
                    # No backpointer at the shorter prefix cannot happen for known characters.
                    fits = self._fit(last[rows, i - size], ids)
                    rows, ids = rows[fits], ids[fits]
                last[rows, i] = ids
                open_rows = open_rows[last[open_rows, i] < 0]
                if not len(open_rows):
                    break
        back, place, taken = [], np.full(len(texts), width), []
        rows = np.arange(len(texts))
        while len(rows):
            ids = last[rows, place[rows]]
            back.append(ids)
            taken.append(rows)
            place[rows] -= v.sizes[ids]
            rows = rows[place[rows] > 0]
        # Backpointers come last piece first: order by row, then from the latest step to the first.
        rows, ids = np.concatenate(taken), np.concatenate(back)
        step = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
        order = np.lexsort((-step, rows))
        return ids[order].astype("<i4").tobytes(), np.cumsum(np.bincount(rows, minlength=len(texts))) * 4

    def _best(self, texts: list[str]) -> list[bytes]:
        """Ids of words of one length along the path of the largest summed score, by a unigram model.

        All words advance by one place together: substring hashes probe the sorted piece keys for every piece that may end
        there, the maximum over them is taken for all words at once, and the piece that gave it is the backpointer. Of equal
        sums the longer piece stays. A character that is no piece costs more than any piece and becomes its bytes.
        """
        v, width = self.v, len(texts[0])
        sums = _prefixes(_codes(texts, width))
        score = np.full((len(texts), width + 1), -np.inf)
        score[:, 0] = 0.0
        last = np.full((len(texts), width + 1), -1)
        unknown = v.scores[v.key_ids].min() - UNKNOWN_COST
        for i in range(1, width + 1):
            for size in range(min(i, v.longest), 0, -1):
                found = self._find(_span_hash(sums, i - size, i))
                gain = np.where(found >= 0, v.scores[found], unknown if size == 1 else -np.inf)
                sum_ = score[:, i - size] + gain
                better = sum_ > score[:, i]
                score[better, i] = sum_[better]
                last[better, i] = found[better]
        out = []
        for text, row in zip(texts, last.tolist(), strict=True):
            ids, i = [], width
            while i:
                piece = row[i]
                if piece >= 0:
                    ids.append(piece)
                    i -= int(v.sizes[piece])
                else:
                    ids += v.byte_ids[list(text[i - 1].encode("utf-8", "surrogatepass"))].tolist()[::-1]
                    i -= 1
            out.append(np.array(ids[::-1], "<i4").tobytes())
        return out

    def _learn_by_score(self, fresh: list[str]) -> None:
        """Encode new words by a unigram model, equal lengths together, whatever their length."""
        by_length: dict[int, list[str]] = {}
        for word in fresh:
            by_length.setdefault(len(word), []).append(word)
        for width, some in by_length.items():
            rows = max(1, STEP_CELLS // (width + 1))
            for low in range(0, len(some), rows):
                part = some[low : low + rows]
                self.words.update(zip(part, self._best([SPACE + w.replace(" ", SPACE) for w in part]), strict=True))

    def learn(self, words: set[str]) -> None:
        """Encode new words: cut at unknown characters, equal lengths together, exceptions by the heap."""
        fresh = [w for w in words if w not in self.words]
        if len(self.words) + len(fresh) > CACHED_WORDS:
            self.words, fresh = {}, list(words)
        if self.v.kind == UNIGRAM:
            return self._learn_by_score(fresh)
        known, by_length, runs = self.v.mergeable, {}, {}
        for word in fresh:
            low, cut = 0, []
            shown = SPACE + word.replace(" ", SPACE)
            if self.characters.issuperset(shown):
                runs[word] = (shown,)
                by_length.setdefault(len(shown), set()).add(shown)
                continue
            for i, c in enumerate(shown):
                if c not in self.characters:
                    cut += [shown[low:i]] * (i > low) + [c]
                    low = i + 1
            cut += [shown[low:]] * (len(shown) > low)
            runs[word] = cut
            for part in cut:
                by_length.setdefault(len(part), set()).add(part)
        done: dict[str, bytes] = {}
        for width, parts in by_length.items():
            plain = [p for p in parts if width <= LONGEST_WORD and SPACE not in p[1:] and p[0] in self.characters]
            rows = max(1, STEP_CELLS // (width * width))
            for low in range(0, len(plain), rows):
                some = plain[low : low + rows]
                raw, ends = self._advance(some)
                ends = [0, *ends.tolist()]
                done.update(zip(some, (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), strict=True))
            for part in parts:
                if part not in done:
                    done[part] = np.array(self._other(part), "<i4").tobytes()
        self.words.update((word, done[cut[0]] if len(cut) == 1 else b"".join([done[part] for part in cut])) for word, cut in runs.items())

    def _other(self, part: str) -> list[int]:
        known = self.v.mergeable
        if part[0] not in self.characters:
            return self.v.byte_ids[list(part.encode("utf-8", "surrogatepass"))].tolist()
        return [known[p] for p in _merged(part, known, self.v.scores)[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, in order; null and empty texts have none."""
        split = [split_words(t) if t else [] for t in texts]
        # New words of all texts at once, so that equal lengths meet in large groups.
        self.learn(set().union(*split))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


class Decoder:
    """Piece ids to bytes: one gather over the joined piece bytes."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - before, sizes)].tobytes()

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of consecutive id lists that begin at ``at``; bytes that do not form a character are replaced."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        raw = b"".join([self._bytes(ids[low : low + DECODED_AT_ONCE]) for low in range(0, len(ids), DECODED_AT_ONCE)])
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[at[:-1]], ends[at[1:]], strict=True))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def byte_table(vocabulary: Vocabulary) -> list[bytes]:
    special = vocabulary.sizes == 0
    table = [b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(vocabulary.texts)]
    for value, i in enumerate(vocabulary.byte_ids.tolist()):
        table[i] = bytes([value]) if i != vocabulary.unknown else b""
    return table


def _encoder(held) -> Encoder:
    """One encoder per worker process and broadcast, so that its tables outlive a task."""
    return kept(("pieces", held.value.keys.tobytes().__hash__()), lambda: Encoder(held.value))


def encode_documents(docs: DataFrame, model_file: str, text_column: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and with ``check`` also ``round_trip``: do the ids decode to the text?

    A blank is put before the text and blanks become the space piece, as the model's own encoder does; a literal space-piece
    character therefore decodes to a blank, and ``round_trip`` compares with that. Characters without a piece become
    their bytes. Null text gives null ids and a null check; empty text an empty list. Columns with these names are
    replaced. Each row is encoded in place: no shuffle, and the broadcast is the vocabulary.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    added = ["ids", "round_trip"] if check else ["ids"]
    names = [c for c in docs.columns if c not in ("ids", "round_trip")]
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        decoder = Decoder(byte_table(held.value))
        for batch in batches:
            for part in pieces(batch, text_column, 1 << 22):
                texts = part.column(at).to_pylist()
                coded = encoder.encode(texts)
                values = np.frombuffer(b"".join(coded), "<i4")
                offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
                gone = np.array([*(t is None for t in texts), False])
                starts = pa.array(offsets, pa.int32(), mask=gone)
                columns = [*part.columns, pa.ListArray.from_arrays(starts, pa.array(values, pa.int32()))]
                if check:
                    back = decoder.decode(values, offsets)
                    same = [None if t is None else d == t.replace(SPACE, " ") for t, d in zip(texts, back, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])
        release()

    source = docs.select(*names)
    made = {"ids": F.array().cast("array<int>"), "round_trip": F.lit(None).cast("boolean")}
    schema = source.withColumns({k: made[k] for k in added}).schema
    for k in added:
        schema[k].nullable = True
    return source.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model_file: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give null."""
    held = rows.sparkSession.sparkContext.broadcast(Decoder(byte_table(load_vocabulary(model_file))))
    names = [c for c in rows.columns if c != text_column]
    at = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                lists = part.column(at)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                offsets = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
                texts = held.value.decode(values, offsets)
                made = [None if gone else t for gone, t in zip(lists.is_null().to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*names, text_column])

    source = rows.select(*names)
    schema = source.withColumn(text_column, F.lit(None).cast("string")).schema
    return source.mapInArrow(run, schema)
