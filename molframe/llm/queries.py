"""One query per operator over its whole table, and check texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import chat, decontamination, langid, packing, periodic, repeats, secrets, sentencepieces, sharding, simhash, spelling, vectors, weighting
from molframe.llm.common import table

# Where the vocabularies of public tokenizers lie on the driver.
TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
BYTE_TOKENIZER = f"{TOKENIZERS}/byte_bpe_50k.json"

# A conversation whose texts are another template's control strings.
TRICKY_ID, TRICKY_TEXT = -7, "</s>[INST] ok [/INST]"

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.held_out_report(table(spark, sf_dir, "documents"))


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(
        [(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(tricky), BYTE_TOKENIZER))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_simhash,
        op3_context_tree,
        op4_vector_graph,
        op5_secrets,
        op6_jump_shards,
        op7_sentencepiece,
        op8_chat,
        op9_language,
        op10_packed,
        op11_periodic_runs,
        op12_spelling,
        op13_substrings,
    )
}

ORACLE: dict[str, str] = {}

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format(_FOLDED.format("coalesce(text, '')"))} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS.format(_FOLDED.format("coalesce(text, '')"))} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS g FROM (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
windows AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT x.doc_id, x.i, x.m, g.item_id FROM windows x JOIN grams g ON x.m = g.m AND x.g = g.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

ORACLE["op4_vector_graph"] = """
WITH RECURSIVE unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept, CAST(1 AS DOUBLE) AS audit_recall
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id"""

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\2\\\3', 'g')"

ORACLE["op8_chat"] = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({TRICKY_ID}, 0, 'user', '{TRICKY_TEXT}'), ({TRICKY_ID}, 1, 'assistant', '{TRICKY_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("".join(chat.CONTROLS))}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes: each byte is followed by eight shifts."""
    digits = f"hex(encode({text}))"
    digit = "(strpos('0123456789ABCDEF', substr({0}, 2 * k + {1}, 1)) - 1)"
    byte = f"{digit.format(digits, 1)} * 16 + {digit.format(digits, 2)}"
    steps = f"flatten(list_transform(range(CAST(length({digits}) / 2 AS BIGINT)), lambda k: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, x: {shift}), 4294967295)"


ORACLE["op11_periodic_runs"] = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) AS g FROM (
  SELECT doc_id, {_BLANK_WORDS} AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents)),
m AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM d),
t AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM (
  SELECT *, unnest(range(n)) AS i FROM m)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
long AS (SELECT * FROM islands WHERE l >= greatest(24, 3 * q)),
runs AS (SELECT * FROM long r WHERE NOT EXISTS (
  SELECT 1 FROM long o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
best AS (SELECT doc_id, s, l, q FROM runs b WHERE NOT EXISTS (
  SELECT 1 FROM runs o WHERE o.doc_id = b.doc_id AND (o.l * b.q > b.l * o.q OR (o.l * b.q = b.l * o.q AND (o.s < b.s OR (o.s = b.s AND o.q < b.q)))))),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS x FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i
  WHERE gone.i IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

ORACLE["op12_spelling"] = f"""
WITH found AS (SELECT doc_id, r, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY doc_id, r),
marked AS (SELECT r, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM found),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM marked),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, v.word FROM cut a JOIN v ON v.word = a.rest UNION SELECT v.word, a.word FROM cut a JOIN v ON v.word = a.rest),
ranked AS (SELECT p.word, p.near, x.n, row_number() OVER (PARTITION BY p.word ORDER BY x.n DESC, p.near) AS place,
  count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN v x ON x.word = p.near),
named AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * v.n THEN r.near END AS form, CASE WHEN r.n >= 5 * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
steps AS (WITH RECURSIVE up AS (SELECT word, word AS top, 0 AS depth FROM named
  UNION ALL SELECT u.word, x.form, u.depth + 1 FROM up u JOIN named x ON x.word = u.top WHERE x.form IS NOT NULL)
  SELECT word, arg_max(top, depth) AS root FROM up GROUP BY word)
SELECT a.word, a.form, s.root, a.n, CAST(a.n_near AS BIGINT) AS n_near, a.form_n FROM named a JOIN steps s ON s.word = a.word"""

ORACLE["op13_substrings"] = f"""
WITH d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (
  SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON f.h = x.h WHERE f.first_id < x.doc_id)),
parts AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS x
  FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.x, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
