"""Plain definitions that the operators are held against, and small texts that hold every hard case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANKS = re.compile("[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Fixed values: (kind, pattern, group, fewest characters) of a secret, as the contract words them. Only A-Z and a-z fold, so
# the letters are written out: a case-blind match would also take the Kelvin sign and the long s.
WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = (
    ("assign", f"({WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def blank_words(text):
    return [w for w in BLANKS.split((text or "").translate(FOLD)) if w]


def shingles(text):
    w = blank_words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows(seed=3, count=160):
    """Texts with copies, near copies, nulls, blanks, junk, long words, and missing or repeated ids."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "ß", "é", "ti", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(90)]
    made = []
    for i in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        made.append((i, text.capitalize(), "en" if i % 3 else "de", f"src{i % 7}", len(text)))
    for k in range(30):
        made.append((1000 + k, made[5][1], "en", f"src{k % 9}", 0))
        made.append((2000 + k, made[9][1] + f" tail{k}", "en", "src1", 0))
    odd = [None, "", "  \n\t", "$$$ !!! ###", "A", "漢字 😀 é", "x" * 9000, "word " * 3000, "a\x00b c\x1fd", " lead  two   three "]
    made += [(3000 + k, t, None if k % 2 else "en", None, None) for k, t in enumerate(odd)]
    made += [(None, made[3][1], "en", "src1", 1), (None, made[3][1], "en", "src1", 1), (7, made[7][1], "en", "src0", 1), (7, made[8][1], "en", "src0", 1)]
    return made


def contamination(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[k : k + m])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, owners = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (found := grams.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    owners |= found - {None}
        out.append((doc_id, len(w), len(hit), len(owners), sha(",".join(sorted(map(str, owners)))), bool(hit)))
    return out


def fingerprint(text):
    w = blank_words(text)
    if not w:
        return 0
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(count, linked):
    label = list(range(count))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


class Tree:
    """Context-tree weighting by its recursive definition, on whole texts."""

    def __init__(self, streams, depth):
        self.depth = depth
        self.counts, self.longer, self.memo = defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for stream in streams:
            for context, node, bit in self.path(stream):
                for n in range(len(context) + 1):
                    c = context[len(context) - n :]
                    self.counts[c, node][bit] += 1
                    if n:
                        self.longer[c[1:], node].add(c)

    def path(self, stream):
        s = b"\n" * self.depth + stream
        for i in range(self.depth, len(s)):
            for k in range(8):
                yield s[i - self.depth : i], (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            own = self.kt(*self.counts[c, node])
            if children := self.longer.get((c, node)):
                below = sum(self.weighted(x, node) for x in children)
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            self.memo[c, node] = own
        return self.memo[c, node]

    def one(self, context, node):
        """The chance of a one: shares along the way, which ends at the longest context that was learned."""
        gained, left = 0.0, 1.0
        for n in range(len(context) + 1):
            c = context[len(context) - n :]
            if (c, node) not in self.counts:
                return 0.5
            a, b = self.counts[c, node]
            last = n == len(context) or (context[len(context) - n - 1 :], node) not in self.counts
            share = 1.0 if last else math.exp(self.kt(a, b) + math.log(0.5) - self.weighted(c, node))
            gained, left = gained + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)
            if last:
                return gained

    def log10(self, stream):
        chances = {}
        total = 0.0
        for context, node, bit in self.path(stream):
            if (context, node) not in chances:
                chances[context, node] = self.one(context, node)
            total += math.log10(chances[context, node] if bit else 1 - chances[context, node])
        return total


def scores(docs, depth):
    """(n_tokens, n_known, train_tokens, base, score) of each (doc_id, text)."""
    learned = [d for d in docs if remainder(d[0], 10)]
    tokens = lambda t: [*blank_words(t), ""]
    stream = lambda t: (" ".join(blank_words(t)) + "\n").encode()
    counts = Counter(w for d in learned for w in tokens(d[1]))
    total, kinds = sum(counts.values()), len(counts)
    tree = Tree([stream(d[1]) for d in learned], depth)
    out = []
    for d in docs:
        t = tokens(d[1])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        out.append((len(t), sum(counts[w] > 0 for w in t), total, base, tree.log10(stream(d[1]))))
    return out
