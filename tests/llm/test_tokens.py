"""Encoding, chat formatting and packing: exact round trips and library results."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from molframe.llm import chat, packing, queries, sentencepieces
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.rows(), brute.DOCS).repartition(3).cache()


def test_pieces_equal_the_library():
    encoder = sentencepieces.Encoder(sentencepieces.load_vocabulary(queries.PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeeeattthhh   \n\t.,éçñß漢😀▁0123") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "a" * 3000, " " * 100 + "x", "\n", "x  ", "the" * 40, "▁", *(t for _, t, *_ in brute.rows() if t)]
    assert [np.frombuffer(c, "<i4").tolist() for c in encoder.encode(texts)] == library.encode(texts)


def test_bounded_tables_change_nothing(monkeypatch):
    vocabulary = sentencepieces.load_vocabulary(queries.PIECES)
    texts = [t for _, t, *_ in brute.rows(seed=9) if t]
    whole = sentencepieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(sentencepieces, "CACHED_WORDS", 5)
    monkeypatch.setattr(sentencepieces, "MEMO_SLOTS", 16)
    small = sentencepieces.Encoder(vocabulary)
    assert [small.encode([t])[0] for t in texts] == whole


def unigram_model(path, pieces, kind=1, **rules):
    """A model file written piece by piece; nothing is trained."""
    proto = sentencepiece_model_pb2.ModelProto()
    special = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))]
    for text, sort, score in [*((t, k, 0.0) for t, k in special), *((t, 1, s) for t, s in pieces)]:
        proto.pieces.add(piece=text, type=sort, score=score)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, True
    settings = {"name": "identity", "add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True}
    for name, value in (settings | rules).items():
        setattr(proto.normalizer_spec, name, value)
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_unigram_pieces(spark, tmp_path):
    rng = random.Random(12)
    texts = {"▁", "▁▁", "▁▁a", "qu", "é", "a" * 20, *"abcdez"}
    while len(texts) < 150:
        texts.add(rng.choice(["", "▁"]) + "".join(rng.choice("abcdeéz") for _ in range(rng.randint(1, 5))))
    # Sums of these scores are exact in either precision, so that equal paths are ties for the library too.
    pieces = [(t, -rng.randint(8, 120) / 8) for t in sorted(texts)]
    file = unigram_model(tmp_path / "unigram.model", pieces)
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    lines = ["", " ", "a", "  a  b ", "quiz q u", "ünknown 日本 \n\t", "ab" * 300 + " " + "a" * 500, "z" * 97, "▁a▁"]
    lines += ["".join(rng.choice("aaabcdeé z  qü") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(lines), (-1, None)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in sentencepieces.encode_documents(docs, file).collect()}
    assert found.pop(-1).ids is None
    for i, row in found.items():
        assert row.ids == library.encode(lines[i]) and row.round_trip, lines[i]


def test_other_models_are_refused(tmp_path):
    plain = [("a", -1.0), ("▁", -2.0)]
    for name, change in {
        "kind": {"kind": 3}, "prefix": {"add_dummy_prefix": False}, "removed": {"remove_extra_whitespaces": True},
        "normalised": {"precompiled_charsmap": b"x"}, "unescaped": {"escape_whitespaces": False},
    }.items():
        with pytest.raises(ValueError, match="not supported"):
            sentencepieces.load_vocabulary(unigram_model(tmp_path / name, plain, **change))
    with pytest.raises(ValueError, match="several words"):
        sentencepieces.load_vocabulary(unigram_model(tmp_path / "several", [*plain, ("a▁a", -3.0)]))
    assert sentencepieces.load_vocabulary(unigram_model(tmp_path / "good", plain)).kind == sentencepieces.UNIGRAM


def test_pieces_in_spark(spark, docs):
    clashing = docs.withColumns({"ids": F.lit("mine")})
    found = sentencepieces.encode_documents(clashing, queries.PIECES)
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in brute.rows())
    assert all((r.ids is None) == (r.text is None) and r.round_trip is (None if r.text is None else True) for r in rows)
    back = sentencepieces.decode_documents(found.withColumnRenamed("text", "was"), queries.PIECES).collect()
    assert all(r.text == r.was for r in back)
    assert sentencepieces.encode_documents(docs.limit(0), queries.PIECES).count() == 0


def turns():
    tricky = ["<|turn|>user<|says|>x<|end|>", "<\\|", "</s>[INST] ok [/INST]", "", None, "  lead\n", "漢😀é", "<<SYS>> [[INST] <</s>", "\\<|end|>\\"]
    made = [(1, k, ("user", "assistant", None, "<|end|>")[k % 4], t) for k, t in enumerate(tricky)]
    made += [(2, 0, "assistant", t) for t in tricky] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "q")]
    made += [(3, 0, "user", "only"), (None, 0, "assistant", "no id"), (None, 1, "assistant", None)]
    return made + [(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 9)) for k in range(300)]


def test_chat(spark):
    frame = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_conversations(frame.withColumn("texts", F.lit(1)), queries.BYTE_TOKENIZER)
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in turns():
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for conv, said in groups.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), brute.sha("".join(f"{a}\n{b}\n" for _, _, a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars == len(chat.render([(a, b) for _, _, a, b in said])[0])
    for r in formatted.collect():
        assert len(r.token_ids) == len(r.loss_tokens) == len(r.offsets) // 2
        assert r.text.count(chat.END) == len(r.turn_spans) // 2
    assert chat.format_conversations(frame.limit(0), queries.BYTE_TOKENIZER).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(20000):
        text = "".join(rng.choice(["<", "[", "|", "\\", "/", "s>", "INST]", "SYS>", "<|end|>", "</s>", "a"]) for _ in range(rng.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in (*chat.CONTROLS, "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def plain_best_fit(lengths, capacity):
    rooms, fills = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = [r for r in rooms if r >= lengths[i]]
        if fitting:
            rooms[rooms.index(min(fitting))] -= lengths[i]
        else:
            rooms.append(capacity - lengths[i])
        fills.append(i)
    return sorted(rooms)


def test_best_fit_decreasing():
    rng = random.Random(6)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        bins = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == plain_best_fit(lengths, capacity)
    assert packing.best_fit_decreasing([], 5) == []


@pytest.mark.parametrize("capacity,window", [(32, 500), (2048, 1 << 20)])
def test_packing_round_trip(spark, docs, capacity, window):
    with open(queries.BYTE_RANKS, "rb") as file:
        encoding = packing.load_encoding(file.read())
    packed = packing.pack_documents(docs, queries.BYTE_RANKS, capacity=capacity, window_tokens=window)
    bins = packed.collect()
    assert len({b.bin_id for b in bins}) == len(bins)
    for b in bins:
        ids, places = np.frombuffer(b.ids, "<u4"), np.frombuffer(b.position_ids, "<i4")
        assert len(ids) == len(places) == capacity and b.cu_seqlens[-1] == b.n_tokens <= capacity
        assert places[: b.n_tokens].tolist() == [k for a, z in zip(b.cu_seqlens, b.cu_seqlens[1:]) for k in range(z - a)]
        assert not ids[b.n_tokens :].any()
    parts = defaultdict(dict)
    for s in packing.segments(packed).collect():
        parts[s.row, s.doc_id][s.part] = s.ids
    back = Counter((doc, encoding.decode(sum((p[k] for k in range(len(p))), [])[:-1])) for (_, doc), p in parts.items())
    assert back == Counter((r[0], r[1] or "") for r in brute.rows())
    assert packing.pack_documents(docs.limit(0), queries.BYTE_RANKS).count() == 0


def test_long_texts_are_encoded_in_cuts(monkeypatch):
    with open(queries.BYTE_RANKS, "rb") as file:
        encoding = packing.load_encoding(file.read())
    monkeypatch.setattr(packing, "_LONG", 50)
    for text in (t for _, t, *_ in brute.rows() if t):
        assert packing._encode(encoding, text).tolist() == encoding.encode_ordinary(text)


def test_decoding_gathers_a_bounded_number_of_bytes_at_once():
    """The places of all bytes of a run of texts were three arrays of 64-bit numbers, 24 times the text."""
    table = [b"", "é".encode(), b" ab", b"cdef", b"x"]
    decoder = sentencepieces.Decoder(table)
    ids = np.random.default_rng(4).integers(0, 5, 400_000).astype("<i4")
    at = np.array([0, 3, 3, sentencepieces.DECODED_AT_ONCE + 5, len(ids)])
    tracemalloc.start()
    found = decoder.decode(ids, at)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    raw = [b"".join(table[i] for i in ids[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [t.removeprefix(" ") for t in raw]
    assert peak < 12 * 2**20
