"""Personal data: pattern matches plus spans of a linear-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers, leftmost and
non-overlapping for each kind.  The field labels words (runs without white space) by
word-shape features of a word and its neighbours; it is trained on the small labelled
table by penalised likelihood (forward-backward over padded numpy arrays) and decoded
by Viterbi over batches of word runs.  Its spans are added where no pattern matched, if
their signs are those of the kind.

A run is what lies within ``reach`` words of a word with a digit, ``@`` or ``+``.
Words without those share one feature set, and ``reach`` is chosen after training so
that the best path between any two labels is outside every entity in the middle of
2 * reach + 1 such words; so cutting there changes no label.

Cases: a null text is empty and has no span; an empty table gives no row; a null id
stays null; repeated rows each have their spans; other columns are kept by ``redact``
and ignored by ``find``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import gives_back, small_parts
from staylens.llm.pii_labels import LABELLED

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
ROUNDS, RATE, PENALTY = 150, 0.15, 0.02

# --- patterns ----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the pattern matches, by kind and start."""
    out = []
    if not _SIGN.search(text):
        return out
    at = text.find("@")
    free = 0                       # where the last match ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if octets(m.group())]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# --- word shapes --------------------------------------------------------------

_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_RUN = re.compile(r"(.)\1{4,}")
PLAIN = ("w",)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word; a word without digit, @ or + has the one feature ``w``."""
    if not _SIGN.search(word):
        return PLAIN
    core = word.strip(".,;:!?\"'")
    s = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in core)
    short = re.sub(r"A+", "A", re.sub(r"a+", "a", s))
    n = len(_digits(core))
    found = ["s=" + _RUN.sub(r"\1\1\1\1+", re.sub("9{20,}", "9*", short))[:200], "n=" + str(min(n, 20)),
             "k=" + re.sub(r"(.)\1+", r"\1", short)[:12]]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        found.append("ip=" + str(octets(core)))
    if re.fullmatch(r"[0-9 -]+", core) and 13 <= n <= 19:
        found.append("luhn=" + str(luhn(_digits(core))))
    if "@" in core[1:]:
        found.append("mail")
    return tuple(found)


def word_features(shapes: list[tuple], groups: list[str]) -> list[list[str]]:
    """Own and neighbouring features; four-digit groups also see whether they make a valid number."""
    out = []
    for i, own in enumerate(shapes):
        f = ["0:" + x for x in own]
        f += ["-:" + x for x in (shapes[i - 1] if i else ("start",))]
        f += ["+:" + x for x in (shapes[i + 1] if i + 1 < len(shapes) else ("end",))]
        if groups[i]:
            f.append("group=" + groups[i])
        out.append(f)
    return out


def digit_groups(words: list[str]) -> list[str]:
    """For words of 4 digits in a run of such words: whether the run is a valid number of 16 digits."""
    out = [""] * len(words)
    i = 0
    four = [bool(re.fullmatch(r"[0-9]{4}[.,;:!?]?", w)) for w in words]
    while i < len(words):
        j = i
        while j < len(words) and four[j]:
            j += 1
        if j - i >= 2:
            d = "".join(w[:4] for w in words[i:j])
            out[i:j] = [str(len(d) == 16 and luhn(d))] * (j - i)
        i = max(j, i + 1)
    return out


# --- the conditional random field ----------------------------------------------

def labelled_rows(lines=LABELLED):
    """Words and tags of the labelled sentences."""
    rows = []
    for line in lines:
        words, tags = [], []
        for m in re.finditer(r"\[(\w+):([^\]]+)\](\S*)|(\S+)", line):
            if m[1]:
                part = m[2].split()
                part[-1] += m[3]
                words += part
                tags += [TAGS.index(("B-" if i == 0 else "I-") + m[1]) for i in range(len(part))]
            else:
                words.append(m[4])
                tags.append(0)
        rows.append((words, tags))
    return rows


def plausible(kind: int, s: str) -> bool:
    """Whether words that the field labels can be of the kind at all."""
    n = len(_digits(s))
    if kind == 0:
        return re.fullmatch(r"[^@]+@[^@]+\.[^@]+", s) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None and octets(s)
    if kind == 2:
        return re.fullmatch(r"[0-9 -]+", s) is not None and 13 <= n <= 19
    return re.fullmatch(r"[0-9 ().+/-]+", s) is not None and 7 <= n <= 15


class Tagger:
    """Weights of features by tag and of tag pairs, and the reach at which runs may be cut."""

    def __init__(self, rows=None):
        rows = rows or labelled_rows()
        feats = [word_features([shape(w) for w in words], digit_groups(words)) for words, _ in rows]
        names = sorted({f for sent in feats for word in sent for f in word})
        self.index = {f: i for i, f in enumerate(names)}
        k, n, t = len(TAGS), len(rows), max(len(w) for w, _ in rows)
        x = np.zeros((n, t, len(names)))
        y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, sent in enumerate(feats):
            for j, word in enumerate(sent):
                x[i, j, [self.index[f] for f in word]] = 1
                y[i, j], mask[i, j] = rows[i][1][j], True
        w, tr = np.zeros((len(names), k)), np.zeros((k + 1, k))       # the last row of tr: from the start
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
        gold = np.eye(k)[y] * mask[..., None]
        gold_tr = np.zeros_like(tr)
        for i in range(n):
            prev = k
            for j in range(len(rows[i][1])):
                gold_tr[prev, y[i, j]] += 1
                prev = y[i, j]
        for step in range(1, ROUNDS + 1):
            node, pair = self._expect(x @ w, tr, mask)
            grads = [np.einsum("ntf,ntk->fk", x, gold - node) - PENALTY * w, gold_tr - pair - PENALTY * tr]
            for p, g, a in ((w, grads[0], 0), (tr, grads[1], 2)):
                moments[a] = 0.9 * moments[a] + 0.1 * g
                moments[a + 1] = 0.99 * moments[a + 1] + 0.01 * g * g
                p += RATE * (moments[a] / (1 - 0.9 ** step)) / (np.sqrt(moments[a + 1] / (1 - 0.99 ** step)) + 1e-8)
        for a, name in enumerate(TAGS):                               # I follows B or I of its kind only
            if name[0] == "I":
                ok = [b for b, other in enumerate(TAGS) if other[1:] == name[1:] and other != "O"]
                tr[[b for b in range(k + 1) if b not in ok], a] = -1e3
        self.w, self.tr = w, tr
        self.reach = self._reach()

    @staticmethod
    def _expect(emit, tr, mask):
        """Expected tags and tag pairs under the model (scaled forward-backward)."""
        n, t, k = emit.shape
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        m, start = np.exp(tr[:k]), np.exp(tr[k])
        f, b, c = np.zeros((n, t, k)), np.ones((n, t, k)), np.ones((n, t))
        for j in range(t):
            v = e[:, j] * (start if j == 0 else f[:, j - 1] @ m)
            s = v.sum(axis=1)
            f[:, j] = np.where(mask[:, j, None], v / s[:, None], f[:, j - 1] if j else 0)
            c[:, j] = np.where(mask[:, j], s, 1)
        for j in range(t - 2, -1, -1):
            v = (b[:, j + 1] * e[:, j + 1]) @ m.T / c[:, j + 1, None]
            b[:, j] = np.where(mask[:, j + 1, None], v, 1)
        node = f * b * mask[..., None]
        pair = np.zeros_like(tr)
        pair[k] = node[:, 0].sum(axis=0)
        for j in range(1, t):
            p = f[:, j - 1, :, None] * m * (e[:, j] * b[:, j] / c[:, j, None])[:, None, :]
            pair[:k] += (p * mask[:, j, None, None]).sum(axis=0)
        return node, pair

    def emission(self, features: list[str]) -> np.ndarray:
        at = [self.index[f] for f in features if f in self.index]
        return self.w[at].sum(axis=0) if at else np.zeros(len(TAGS))

    def _reach(self) -> int:
        """Least r (up to 16) so that O is best in the middle of 2r + 1 plain words whatever surrounds them."""
        k = len(TAGS)
        step = self.tr[:k] + self.emission(["0:w", "-:w", "+:w"])[None, :]
        for r in range(2, 17):
            way = step
            for _ in range(r):
                way = (way[:, :, None] + step[None]).max(axis=1)
            through_o = way[:, :1] + way[:1, :]
            best = (way[:, :, None] + way[None]).max(axis=1)
            if (through_o >= best - 1e-9).all():
                return r
        raise ValueError("the labelled table does not keep plain words outside entities")

    def viterbi(self, runs: list[np.ndarray], first: list[bool]) -> list[np.ndarray]:
        """Best tags of each run (emission rows); ``first`` marks runs that begin a text, others follow an O."""
        out: list = [None] * len(runs)
        k = len(TAGS)
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        for g in range(0, len(order), 512):
            group = order[g:g + 512]
            n = np.array([len(runs[i]) for i in group])
            emit = np.zeros((len(group), n[0], k))
            for a, i in enumerate(group):
                emit[a, :n[a]] = runs[i]
            v = emit[:, 0] + np.where(np.array([first[i] for i in group])[:, None], self.tr[k], self.tr[0])
            back = np.zeros((len(group), n[0], k), np.int8)
            for t in range(1, n[0]):
                live = int((n > t).sum())
                s = v[:live, :, None] + self.tr[None, :k]
                back[:live, t] = s.argmax(axis=1)
                v[:live] = s.max(axis=1) + emit[:live, t]
            for a, i in enumerate(group):
                tags = np.zeros(n[a], np.int64)
                tags[-1] = v[a].argmax()
                for t in range(n[a] - 1, 0, -1):
                    tags[t - 1] = back[a, t, tags[t]]
                out[i] = tags
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of the field in each text: (kind number, start, end)."""
        found: list[list] = [[] for _ in texts]
        runs, first, where = [], [], []
        for i, text in enumerate(texts):
            if not _SIGN.search(text):
                continue
            words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            near = np.zeros(len(words) + 1, np.int64)
            for j, (s, e) in enumerate(words):
                if _SIGN.search(text, s, e):
                    near[max(0, j - self.reach)] += 1
                    near[min(len(words), j + self.reach + 1)] -= 1
            inside = np.concatenate([[False], np.cumsum(near[:-1]) > 0, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                # one more word on either side lets the features of the outermost ones see their neighbours
                lo, hi = max(0, a - 1), min(len(words), b + 1)
                part = [text[s:e] for s, e in words[lo:hi]]
                feats = word_features([shape(w) for w in part], digit_groups(part))
                runs.append(np.array([self.emission(f) for f in feats[a - lo:len(feats) - (hi - b)]]))
                first.append(a == 0)
                where.append((i, words[a:b]))
        for (i, words), tags in zip(where, self.viterbi(runs, first) if runs else []):
            j = 0
            while j < len(tags):
                if not tags[j]:
                    j += 1
                    continue
                kind, e = (int(tags[j]) - 1) // 2, j + 1
                while e < len(tags) and tags[e] == 2 + 2 * kind:
                    e += 1
                start, end = words[j][0], words[e - 1][1]
                while start < end and texts[i][start] in ".,;:!?\"'":
                    start += 1
                while end > start and texts[i][end - 1] in ".,;:!?\"'":
                    end -= 1
                if end > start and plausible(kind, texts[i][start:end]):
                    found[i].append((kind, start, end))
                j = e
        return found


def all_spans(text: str, base, added):
    """The pattern spans and those of the field that touch none of them, by kind and start."""
    kept = list(base)
    for kind, s, e in added:
        if all(e <= a or b <= s for _, a, b in base):
            kept.append((kind, s, e))
    return sorted(kept)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _masked(text: str, spans) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the count of each kind among the pattern spans, base (pattern spans), spans (all), masked
    (the text without them)."""
    tagger = Tagger()
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, "
              "masked string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [all_spans(t, x, y) for t, x, y in zip(texts, base, tagger.spans(texts))]
                count = [[sum(1 for s in x if s[0] == j) for x in base] for j in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in count),
                     pa.array([joined(x) for x in base], pa.string()), pa.array([joined(x) for x in spans], pa.string()),
                     pa.array([_masked(t, x) if x else t for t, x in zip(texts, spans)], pa.string())],
                    names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema)


def redact(docs: DataFrame, text_col="text", length_col="n_chars") -> DataFrame:
    """The same rows and columns with every span in the text replaced by its kind; the length
    column, where there is one, follows.  Null texts stay null."""
    tagger = Tagger()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text_col)
            for part in small_parts(b, text_col):
                texts = part.column(at).to_pylist()
                out = []
                for t, x in zip(texts, tagger.spans([t or "" for t in texts])):
                    s = all_spans(t, base_spans(t), x) if t else []
                    out.append(_masked(t, s) if s else t)
                columns = list(part.columns)
                columns[at] = pa.array(out, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    # rows go through Python once, in small slices: a column function's batches and its pandas series stay in
    # the workers beside the rows that wait in the executor
    src = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out = src.mapInArrow(gives_back(run), src.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(
            F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
