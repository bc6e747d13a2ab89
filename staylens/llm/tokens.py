"""Token ids of whole texts by a tokenizers file, encoded word by word with bounded caches.

Texts of Latin letters, digits, signs, spaces and line ends are cut at once, slice by slice, into
the parts of the file's own split rule; each different part of a slice is looked up once, and
unknown ones go to the file's model.  Any other text is encoded by chunks:

A chunk is a word between single spaces and line ends (with its leading space for
byte-level vocabularies); no token crosses its borders, so the ids of a text are the ids
of its chunks in order.  A chunk of Latin letters and signs is split as the file's own
rule says and each part goes to the file's model; any other chunk goes through the whole
tokenizer.  Byte-level texts in which white space is doubled, stands at an end or is
neither space nor line end are encoded whole, as the split rule looks at neighbours there;
so are texts that hold the string of one of the file's added tokens.
"""

from __future__ import annotations

import os
import sys
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import regex

from staylens.llm.common import arrow_texts, ragged_take, small_parts

END_ID = 1
CACHE_CHUNKS = 100_000

# fixed values: the split rules of the two vocabularies
BYTE_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_LATIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u017e]*")


WHITE, LETTER, NUMBER, SIGN, OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each code point below U+0800 in the split rules; OTHER where a text is left to chunks."""
    out = np.full(0x800, OTHER, np.uint8)
    for i in range(0x21, 0x17F):
        c = chr(i)
        if _LATIN.fullmatch(c):
            out[i] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SIGN
    return out


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as uint32 arrays.  A byte-level file keeps white space as tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.byte_level = self.tok.normalizer is None
        self.rule = regex.compile(BYTE_RULE if self.byte_level else WORD_RULE)
        self.letters = _byte_letters()
        self.shown = "".join(map(self.letters.get, range(256)))
        self.classes = _classes()
        self.classes[[ord(c) for c in (" \n" if self.byte_level else " \n\t\r")]] = WHITE
        self.lower = np.array([ord(chr(i).lower()) if c != OTHER else i for i, c in enumerate(self.classes)])
        self._reset()

    def _reset(self):
        self.codes: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}          # of the chunks
        self.flat = np.zeros(1 << 20, np.uint32)       # ids of all chunks; the arrays double when full
        self.start = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.used_in = np.zeros(1 << 18, np.int32)     # by how many slices (chunks: texts)
        self.used = 0

    def _whole(self, texts):
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _shown(self, part: str) -> str:
        """A part of the split rule as the model reads it: each byte as a printable character."""
        return part.encode("utf-8").decode("latin-1").translate(self.letters)

    def _part(self, shown: str) -> list[int]:
        """Ids of one part by the file's model."""
        ids = self.parts.get(shown)
        if ids is None:
            ids = self.parts[shown] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def _add(self, chunks: list[str]) -> None:
        found: list = []
        late = []
        byte_level, part = self.byte_level, self._part
        space = self.letters[0x20] if byte_level else ""
        for i, c in enumerate(chunks):
            first = byte_level and c[:1] == "\0"
            word = c[1:] if first else c if byte_level else c.lower()
            lead = "" if first else space
            if word.isascii():
                if word.isalpha():                       # most words: letters, with one sign or none
                    found.append(part(lead + word))
                    continue
                if word[-1:] in (".", ",") and word[:-1].isalpha():
                    found.append(part(lead + word[:-1]) + part(word[-1]))
                    continue
            if c != "\n" and not _LATIN.fullmatch(c[1:] if first else c):
                found.append(None)
                late.append((i, word if first else " " + c if byte_level else c))
                continue
            text = word if first or not byte_level or c == "\n" else " " + word
            found.append([x for p in self.rule.findall(text) for x in part(self._shown(p))])
        for (i, _), ids in zip(late, self._whole([t for _, t in late]) if late else []):
            found[i] = ids
        self._keep(chunks, [len(x) for x in found], list(chain.from_iterable(found)))

    def _keep(self, chunks: list, size: list[int], ids: list[int]) -> np.ndarray:
        """Put chunks or parts with their ids in a row into the cache; returns their codes."""
        size = np.array(size, np.int64)
        base, total = len(self.codes), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(chunks) > len(self.start):
            self.start, self.length, self.used_in = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.used_in))
        self.start[base:base + len(chunks)] = self.used + np.cumsum(size) - size
        self.length[base:base + len(chunks)] = size
        self.flat[self.used:self.used + total] = ids
        self.used += total
        self.codes.update(zip(chunks, range(base, base + len(chunks))))
        return np.arange(base, base + len(chunks))

    def _trim(self) -> None:
        """Forget what fewest slices used, so that common parts stay and the cache is bounded."""
        n = len(self.codes)
        keep = np.sort(np.argsort(-self.used_in[:n], kind="stable")[:CACHE_CHUNKS // 2])
        keep = keep[self.used_in[keep] > 1]
        names = list(self.codes)                          # in the order of their codes
        start, length, used_in = self.start[keep], self.length[keep], self.used_in[keep]
        ids = ragged_take(self.flat, start, length)
        self._reset()
        self._keep([names[i] for i in keep.tolist()], length.tolist(), ids)
        self.used_in[:len(keep)] = used_in // 2

    def _chunks(self, text: str) -> list[str] | None:
        """Words; one that begins a line is marked by a zero character.  None: the text is encoded whole."""
        low = text.lower()
        if any(t in low for t in self.added):            # the library cuts texts there first
            return None
        if not self.byte_level:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if not text:
            return []
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text \
                or text[0].isspace() or text[-1].isspace() or any(c in text for c in _OTHER_SPACE):
            return None
        return ("\0" + text.replace("\n", " \n \0")).split(" ")

    def encode(self, texts) -> list[np.ndarray]:
        """``texts`` is a list of strings or an Arrow column of them (null: empty)."""
        import pyarrow as pa

        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if len(self.codes) > CACHE_CHUNKS:
            self._trim()
        data, off = arrow_texts(texts)
        data, off = data[off[0]:off[-1]], off - off[0]
        kind, wide = self._kinds(data)
        other = np.concatenate([[0], np.cumsum(kind == OTHER)])
        plain = other[off[1:]] == other[off[:-1]]
        low = data.tobytes().lower()
        if any(t.encode() in low for t in self.added):    # the library cuts texts there first
            plain &= [not any(t.encode() in low[i:j] for t in self.added) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        if plain.all():
            return self._encode_parts(data, off, kind, wide)
        out: list = [None] * len(texts)
        for at, encode in ((np.flatnonzero(plain), self.encode), (np.flatnonzero(~plain), self._encode_chunks)):
            found = texts.take(pa.array(at))
            for i, ids in zip(at.tolist(), encode(found if encode == self.encode else found.to_pylist()) if len(at) else []):
                out[i] = ids
        return out

    def _kinds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each byte (that of its character) and the places where characters of two bytes begin."""
        kind = self.classes[:256].copy()
        kind[0x80:] = OTHER
        kind = kind[data]
        wide = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        if len(wide):
            kind[wide] = kind[wide + 1] = self.classes[self._points(data, wide)]
        return kind, wide

    @staticmethod
    def _points(data: np.ndarray, wide: np.ndarray) -> np.ndarray:
        return (data[wide].astype(np.int64) & 0x1F) << 6 | (data[wide + 1] & 0x3F)

    def _encode_parts(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
        import pyarrow as pa

        if not self.byte_level:                           # lower case keeps the number of bytes here
            point = self.lower[self._points(data, wide)]
            data = self.lower[:256].astype(np.uint8)[data]
            data[wide], data[wide + 1] = 0xC0 | point >> 6, 0x80 | point & 0x3F
        begin = self._borders(data, off, kind, wide)
        parts = pa.Array.from_buffers(pa.binary(), len(begin), [
            None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        parts = parts.dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = self._add_parts([names[i] for i in new.tolist()])
        self.used_in[code] += 1
        code = code[np.asarray(parts.indices)]
        ids = ragged_take(self.flat, self.start[code], self.length[code])
        end = np.concatenate([[0], np.cumsum(self.length[code])])[np.searchsorted(begin, off)].tolist()
        return [ids[i:j] for i, j in zip(end[:-1], end[1:])]

    def _borders(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Where the parts of the split rule begin; a space belongs to what follows it."""
        n = len(data)
        first = np.zeros(n + 4, bool)                     # texts begin here
        first[off] = True
        new = first.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        if not self.byte_level:                           # numbers are cut into their characters
            new[:n] |= kind == NUMBER
            new[wide + 1] = False
        white = np.append(kind == WHITE, False)
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n + 1])      # of the white space before a word
        new[last] = True
        new[last[data[last] == 0x20] + 1] = False
        quote = np.flatnonzero(data == 0x27)
        if len(quote):                                    # 's 't 'm 'd 're 've 'll where a part begins
            before = np.append(kind, WHITE)[quote - 1]
            joined = (before == SIGN) | ((before == WHITE) & (np.append(data, 0)[quote - 1] == 0x20) & self.byte_level)
            quote = quote[(first[quote] | ~joined) & ~first[quote + 1]]
            a, b = (np.append(data, [0, 0, 0])[quote + k] for k in (1, 2))
            one = np.isin(a, list(b"stmd"))
            two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~first[quote + 2]
            new[quote[one | two] + 1] = False
            new[quote[one] + 2] = True
            new[quote[two] + 3] = True
        return np.flatnonzero(new[:n])

    def _add_parts(self, parts: list[bytes]) -> np.ndarray:
        read = b"\0".join(parts).decode("latin-1")
        if not self.byte_level:
            read = "\0".join([p.strip(" \n\t\r") for p in read.split("\0")])
        read = read.translate(self.shown).split(self.shown[0])
        size, ids = [], []
        for k in range(0, len(read), 4096):
            found = list(map(self.model.tokenize, read[k:k + 4096]))
            size += map(len, found)
            ids += map(attrgetter("id"), chain.from_iterable(found))
        return self._keep(parts, size, ids)

    def _encode_chunks(self, texts: list[str]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        chunked = [self._chunks(t) for t in texts]
        get = self.codes.get
        codes = [None if cs is None else list(map(get, cs)) for cs in chunked]
        missing = dict.fromkeys(c for cs, code in zip(chunked, codes) if cs and None in code
                                for c, k in zip(cs, code) if k is None)
        if missing:
            self._add(list(missing))
        out = []
        for t, cs, code in zip(texts, chunked, codes):
            if cs is None:
                out.append(np.asarray(self._whole([t])[0], np.uint32))
                continue
            if None in code:
                code = list(map(get, cs))
            code = np.array(code, np.int64)
            self.used_in[code] += 1
            out.append(ragged_take(self.flat, self.start[code], self.length[code]))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker.  It is kept on the tokenizers module, as
    this package's own modules travel with each task and hold nothing between tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_batches(batches, path: str, text_at: str = "text", size: int = 512):
    """Yield (slice of the Arrow batch, list of id arrays with the end id), at most ``size`` rows at once."""
    enc = encoder(path)
    end = np.array([END_ID], np.uint32)
    for batch in batches:
        for part in small_parts(batch, text_at, size):
            yield part, [np.concatenate([ids, end]) for ids in enc.encode(part.column(text_at))]
