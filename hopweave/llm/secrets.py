"""Secrets: fixed patterns, and a linear-chain conditional random field on tokens.

The patterns (`assign`, `access`, `hex`) give the base spans. The field tags every
token as begin, inside or outside of a secret from its own shape, the words and shapes
around it and features of the file, and is decoded by Viterbi; what its runs have beyond
base spans is added as kind `crf`. Base spans are never changed.

Learning takes at most max_docs documents of any length, chosen by a hash, and of them
at most max_windows windows, chosen alike: around every base span, around secrets of
other forms that are written into the same texts for training (key blocks, bearer tokens,
provider keys, pass phrases), and around ordinary tokens, which teach what is no secret.
Windows are made on the executors, and only they come to the driver. The likelihood is
maximised by full forward-backward passes in numpy.

A token's features are looked up once per task and distinct token. Decoding looks only
at texts with a token that could lie in a secret: any run of tags other than outside
gains from transitions at most 2 * gain per token, so a text whose tokens all prefer
outside by more than that has no such run.

Defined cases: null and empty texts have no spans; a text of any length is searched
whole; equal rows give equal results; without training documents only base spans are
found; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import map_arrow, map_documents, pieces, texts_of
from hopweave.llm.shipping import Shipped

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "crf")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_assign_words = ("password", "passwd", "secret", "token", "api")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the runs of 24 or more

MAX_DOCS, MAX_WINDOWS = 1000, 8000
WINDOW = 12
#: Characters of a run beyond base spans that are a span of their own.
LEAST = 6
BUCKETS = 1 << 15
EPOCHS = 30
#: Windows that a word or a beginning must stand in to be known.
MIN_WINDOWS = 5
#: Tokens whose features a task keeps.
CACHE = 150_000
B, I, O = 0, 1, 2

_token = re.compile(r"[\w+/=-]+(?:\.[\w+/=-]+)*|[^\w\s]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by kind and start."""
    out = []
    lower = text.lower() if ":" in text or "=" in text else ""
    if any(w in lower for w in _assign_words):
        out += [("assign", *m.span()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in _hex.finditer(text)]


def value_spans(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: the value of an assignment, or the whole match."""
    out = [m.span(2) for m in _assign.finditer(text) if len(m[2]) >= 6]
    return out + [(s, e) for k, s, e in base_spans(text) if k != "assign"]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# ---- features


def shape(token: str) -> tuple[str, int]:
    """Runs of upper, other letter, digit and sign classes (at most six), and how often the class changes."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token]
    runs = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
    return "".join(runs[:6]) + ("~" if len(runs) > 6 else ""), len(runs) - 1


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


#: Where a token stands from the one that is tagged.
PLACES = (0, -1, -2, 1)


def signature(token: str, words: set[str]) -> tuple:
    """All that the features of a token depend on: its word or beginning if known (else whether it is of letters), shape, turns, length, digits, letters."""
    n = len(token)
    if token.isalpha() and token.islower():
        return (token if token in words else "?", "a", 0, min(n, 56) // 4 if n > 8 else -n, "?", False, True)
    sh, turns = shape(token)
    word = token.lower()
    head = token[:4] if n > 8 and token[:4] in words else "?"
    return (word if word in words else "?" if token.isalpha() else "#", sh, min(turns, 12) // 2, min(n, 56) // 4 if n > 8 else -n, head, any(c.isdigit() for c in token), any(c.isalpha() for c in token))


def features_of(sig: tuple) -> list[list[int]]:
    """Buckets of a signature's features for each of PLACES."""
    word, sh, turns, size, head, digit, alpha = sig
    mixed = f"{digit}{alpha}{turns}"
    near = [f"w{word}", f"s{sh[:3]}"]
    return [[_bucket(f"0{x}") for x in (f"w{word}", f"s{sh}", f"n{size}", f"m{mixed}{size}", f"p{head}", f"x{mixed}")], *([_bucket(f"{p}{x}") for x in near] for p in PLACES[1:])]


def file_features(text: str, n_tokens: int) -> list[int]:
    """Buckets of what the whole text is like."""
    return [_bucket(f"fsigns{sum(c in text for c in '=:{};()')}"), _bucket(f"fsize{n_tokens.bit_length()}"), _bucket("fbias")]


# ---- the field


class Field:
    """Weights of feature buckets by tag, and of transitions. Inside never follows outside."""

    def __init__(self, words: set[str] = frozenset()):
        self.words = words
        self.weight = np.zeros((BUCKETS, 3))
        self.trans = np.zeros((3, 3))
        self.trans[O, I] = -1e4
        self.start = np.array([0.0, -1e4, 0.0])

    def fit(self, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> Field:
        """ids (n, t, f) buckets, tags (n, t), mask (n, t) of tokens that count; padding is at the end."""
        n, t, f = ids.shape
        flat, real = ids.reshape(n * t, f), mask.reshape(-1)
        gw, gt = np.full_like(self.weight, 1e-6), np.full((3, 3), 1e-6)
        gold_pairs = np.zeros((3, 3))
        np.add.at(gold_pairs, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        onehot = np.eye(3)[tags] * mask[..., None]
        for _ in range(EPOCHS):
            e = self.weight[flat].sum(1).reshape(n, t, 3)
            a, b = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            a[:, 0] = e[:, 0] + self.start
            for k in range(1, t):
                a[:, k] = np.where(mask[:, k, None], np.logaddexp.reduce(a[:, k - 1, :, None] + self.trans, axis=1) + e[:, k], a[:, k - 1])
            for k in range(t - 2, -1, -1):
                b[:, k] = np.where(mask[:, k + 1, None], np.logaddexp.reduce(self.trans[None] + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            pairs = np.zeros((3, 3))
            for k in range(1, t):
                q = a[:, k - 1, :, None] + self.trans + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]
                pairs += np.exp(q[mask[:, k]]).sum(0)
            err = (onehot - p).reshape(n * t, 3)[real]
            used = flat[real].ravel()
            g = np.stack([np.bincount(used, np.repeat(err[:, y], f), BUCKETS) for y in range(3)], axis=1) - 0.02 * self.weight
            gw += g**2
            self.weight += 0.5 * g / np.sqrt(gw)
            d = gold_pairs - pairs
            d[O, I] = 0
            gt += d**2
            self.trans += 0.2 * d / np.sqrt(gt)
        return self

    @property
    def gain(self) -> float:
        """What a transition of a run can gain over staying outside."""
        allowed = [self.trans[a, b] for a in range(3) for b in range(3) if (a, b) != (O, I)]
        return max(0.0, max(allowed) - self.trans[O, O])

    def decode(self, e: np.ndarray) -> list[int]:
        """The best tags by Viterbi."""
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.trans.tolist()
        rows = e.tolist()
        b, i, o = rows[0][B], -1e9, rows[0][O]
        back = []
        for eb, ei, eo in rows[1:]:
            vb, fb = max((b + bb, B), (i + ib, I), (o + ob, O))
            vi, fi = max((b + bi, B), (i + ii, I))
            vo, fo = max((b + bo, B), (i + io, I), (o + oo, O))
            back.append((fb, fi, fo))
            b, i, o = vb + eb, vi + ei, vo + eo
        tag = max((b, B), (i, I), (o, O))[1]
        out = [tag]
        for f in reversed(back):
            tag = f[tag]
            out.append(tag)
        return out[::-1]


class Tagger:
    """Finds spans with a field; keeps what tokens add to the score of themselves and of their neighbours."""

    def __init__(self, field: Field):
        self.field, self.bound = field, -2 * field.gain
        self.known: dict[str, int] = {}  # row of a token
        self.number: dict[tuple, int] = {}  # row of a signature
        self.rows = np.zeros((1024, len(PLACES), 3))

    def _row(self, token: str) -> int:
        sig = signature(token, self.field.words)
        r = self.number.get(sig)
        if r is None:
            r = self.number[sig] = len(self.number)
            if r == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[r] = [self.field.weight[f].sum(0) for f in features_of(sig)]
        return r

    def _numbers(self, tokens: list[str]) -> list[int]:
        new = {t for t in tokens if t not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE or len(self.number) > CACHE:
                self.known, self.number, new = {}, {}, set(tokens)
            for t in new:
                self.known[t] = self._row(t)
        return list(map(self.known.__getitem__, tokens))

    def emissions(self, text: str, tokens: list[str]) -> np.ndarray:
        ids = np.array(self._numbers(tokens))
        e = self.rows[ids, 0] + self.field.weight[file_features(text, len(tokens))].sum(0)
        for at, place in enumerate(PLACES[1:], 1):
            own = self.rows[ids, at]
            if place < 0:
                e[-place:] += own[:place]
            else:
                e[:-place] += own[place:]
        return e

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the runs that the field tags."""
        tokens = _token.findall(text)
        if not tokens:
            return []
        e = self.emissions(text, tokens)
        if (np.maximum(e[:, B], e[:, I]) - e[:, O]).max() < self.bound:
            return []
        tags = self.field.decode(e)
        if all(t == O for t in tags):
            return []
        out: list[list[int]] = []
        for m, t in zip(_token.finditer(text), tags, strict=True):
            if t == B or t == I and not out:
                out.append([*m.span()])
            elif t == I:
                out[-1][1] = m.end()
        return [(a, b) for a, b in out]


# ---- learning


def planted(rnd: random.Random) -> tuple[str, str]:
    """A line with a secret of a form that the patterns don't have, and the secret."""
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_ = low + up + dig
    k = rnd.randrange(9)
    if k == 0:
        s = some(any_ + "-_", rnd.randint(24, 60))
        return f"Authorization: Bearer {s}", s
    if k == 1:
        s = rnd.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_live_", "npm_"]) + some(any_, rnd.randint(20, 40))
        return f"{rnd.choice(['export KEY=', 'auth ', 'key: ', 'use '])}{s}", s
    if k == 2:
        s = some(any_ + "+/", rnd.randint(30, 64)) + rnd.choice(["", "=", "=="])
        return f"{rnd.choice(['private_key', 'credential', 'client_key', 'signing_key'])} = {s}", s
    if k == 3:
        s = some(any_, rnd.randint(10, 20))
        return f"{rnd.choice(['pwd', 'pass', 'passphrase', 'pin'])}{rnd.choice([': ', '=', ' = '])}{s}", s
    if k == 4:
        s = some(up + dig, rnd.randint(16, 32))
        return f"{rnd.choice(['ASIA', 'AIza', 'SG.'])}{s}", ""
    if k == 5:
        s = ".".join(("eyJ" + some(any_, 18), "eyJ" + some(any_, 30), some(any_ + "-_", 30)))
        return f"jwt {s}", s
    # no known form: a word of any letters, a sign, and a long draw from any alphabet
    s = some(rnd.choice((up + dig, low + dig, any_, any_, any_ + "+/", any_ + "-_")), rnd.randint(18, 70))
    name = some(rnd.choice((low, up, low + up)), rnd.randint(2, 10))
    return f"{name}{rnd.choice((' ', ': ', '.', '-', '_', '=', ':', '/'))}{s}", s


def training_windows(text: str, seed: int) -> list[tuple[list[str], list[int], list[int]]]:
    """(tokens, tags, file features) around all base spans, around a planted line and at two ordinary places."""
    rnd = random.Random(seed)
    spans = value_spans(text)
    line, secret = planted(rnd)
    breaks = [m.start() for m in re.finditer(r"\s", text)]
    at = rnd.choice(breaks) if breaks else len(text)
    both = [(text, spans)]
    start = at + 1 + (line.index(secret) if secret else 0)
    grown = [(s + len(line) + 2, e + len(line) + 2) if s >= at else (s, e) for s, e in spans if not s < at < e]
    both.append((text[:at] + " " + line + " " + text[at:], [*grown, (start, start + len(secret or line))]))
    out = []
    for t, found in both:
        found_at = sorted(found)
        tokens, tags, hot, k = [], [], [], 0
        for m in _token.finditer(t):
            while k < len(found_at) and found_at[k][1] <= m.start():
                k += 1
            inside = k < len(found_at) and m.start() < found_at[k][1] and m.end() > found_at[k][0]
            again = inside and tags and tags[-1][1] == found_at[k]
            tags.append((I if again else B, found_at[k]) if inside else (O, None))
            tokens.append(m[0])
            if inside and not again:
                hot.append(len(tokens) - 1)
        file = file_features(t, len(tokens))
        for h in [*hot, *(rnd.randrange(len(tokens)) for _ in range(2 if tokens else 0))]:
            a, b = max(0, h - WINDOW), h + WINDOW
            labels = [x for x, _ in tags[a:b]]
            if labels and labels[0] == I:
                labels[0] = B
            out.append((tokens[a:b], labels, file))
    return out


Window = tuple[list[str], list[int], list[int]]


def fit(found: list[Window]) -> Field:
    """A field of windows."""
    often: Counter = Counter(x for tokens, _, _ in found for t in set(tokens) for x in {t.lower() if len(t) <= 16 else "", t[:4] if len(t) > 8 else ""} if x)
    field = Field({x for x, n in often.items() if n >= MIN_WINDOWS})
    if not found:
        field.weight[:, O] = 1.0
        return field
    long, width = 2 * WINDOW, 6 + 2 * 3 + 3
    none = _bucket("none")
    ids = np.full((len(found), long, width), none)
    tags, mask = np.full((len(found), long), O), np.zeros((len(found), long), bool)
    for n, (tokens, labels, file) in enumerate(found):
        own = [features_of(signature(t, field.words)) for t in tokens]
        for k in range(len(tokens)):
            at = own[k][0] + [x for p, place in enumerate(PLACES[1:], 1) if 0 <= k + place < len(tokens) for x in own[k + place][p]] + file
            ids[n, k, : len(at)] = at
        tags[n, : len(tokens)], mask[n, : len(tokens)] = labels, True
    field.fit(ids, tags, mask)
    field.weight[none] = 0
    return field


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field of windows of documents chosen by a hash.

    Half of the documents have a word of an assignment, so that the patterns label secrets.
    Only hashes are ranked; what is broadcast are at most max_docs of them.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("t")).where("length(t) > 0")
    hinted = F.lower("t").rlike("(password|passwd|secret|token|api_?key).{0,4}[:=]")
    first = lambda some: some.select("h").distinct().orderBy("h").limit(max_docs // 2)
    chosen = first(rows.where(hinted)).unionAll(first(rows)).distinct()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in pieces(b, 1):
                for h, t in zip(part.column(0).to_pylist(), texts_of(part, 1), strict=True):
                    made = training_windows(t, h)
                    columns = [[h] * len(made), range(len(made)), *zip(*made, strict=True)]
                    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "n", "tokens", "tags", "file"])

    made = map_arrow(rows.join(F.broadcast(chosen), "h").select("h", "t"), run, "h long, n int, tokens array<string>, tags array<int>, file array<int>")
    # repeated rows make the same windows
    some = made.orderBy(F.xxhash64("h", "n"), "h", "n").limit(max_windows).collect()
    return fit([x for _, x in sorted({(r.h, r.n): (r.tokens, r.tags, r.file) for r in some}.items())])


# ---- use


def beyond(text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What of a run lies outside base spans: from letter or digit to letter or digit, LEAST characters or more; a run that touches none as it is."""
    cuts = sorted((max(x, start), min(y, end)) for _, x, y in base if x < end and start < y)
    if not cuts:
        return [(start, end)]
    out, at = [], start
    for x, y in [*cuts, (end, end)]:
        some = [i for i in range(at, x) if text[i].isalnum()]
        if some and some[-1] + 1 - some[0] >= LEAST:
            out.append((some[0], some[-1] + 1))
        at = max(at, y)
    return out


def found_in(tagger: Tagger, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and what the field's runs have beyond them."""
    base = base_spans(text)
    more = [("crf", x, y) for s, e in tagger.spans(text) for x, y in beyond(text, s, e, base)]
    return base, more


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts by base kind, base_sha256, spans and n_crf, one row per row of docs."""
    shipped = Shipped(docs.sparkSession, field)

    def make():
        tagger = shipped.get(Tagger)

        def one(text):
            base, more = found_in(tagger, text)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            return *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return map_documents(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long", id_col, text_col)


def redacted(tagger: Tagger, text: str, mark: str = "[secret]") -> str:
    """The text with the mark in place of every span; overlapping spans give one mark."""
    base, more = found_in(tagger, text)
    out, at = [], 0
    for s, e in sorted((s, e) for _, s, e in base + more):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced by a mark, and the length column, if there is one, brought up to date."""
    import pyarrow as pa

    shipped = Shipped(docs.sparkSession, field)
    at = docs.columns.index(text_col)

    def run(batches):
        tagger = shipped.get(Tagger)
        for batch in batches:
            for part in pieces(batch, at):
                nulls = part.column(at).is_null().to_pylist()
                new = [None if n else redacted(tagger, t) for t, n in zip(texts_of(part, at), nulls, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    out = map_arrow(docs, run, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, learn(docs))
