"""Text decoded with a wrong character encoding: character n-gram models, encode-decode chains and the choice among them."""

from __future__ import annotations

import codecs
import html
import itertools
import math
import operator
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: The TCVN3 (ABC) code of each Vietnamese letter that it has; capital letters with a tone share the small ones' codes.
TCVN3 = {
    "Ă": 0xA1, "Â": 0xA2, "Ê": 0xA3, "Ô": 0xA4, "Ơ": 0xA5, "Ư": 0xA6, "Đ": 0xA7, "ă": 0xA8, "â": 0xA9, "ê": 0xAA, "ô": 0xAB, "ơ": 0xAC, "ư": 0xAD, "đ": 0xAE,
    "à": 0xB5, "ả": 0xB6, "ã": 0xB7, "á": 0xB8, "ạ": 0xB9, "ằ": 0xBB, "ẳ": 0xBC, "ẵ": 0xBD, "ắ": 0xBE, "ặ": 0xC6, "ầ": 0xC7, "ẩ": 0xC8, "ẫ": 0xC9, "ấ": 0xCA, "ậ": 0xCB,
    "è": 0xCC, "ẻ": 0xCE, "ẽ": 0xCF, "é": 0xD0, "ẹ": 0xD1, "ề": 0xD2, "ể": 0xD3, "ễ": 0xD4, "ế": 0xD5, "ệ": 0xD6, "ì": 0xD7, "ỉ": 0xD8, "ĩ": 0xDC, "í": 0xDD, "ị": 0xDE,
    "ò": 0xDF, "ỏ": 0xE1, "õ": 0xE2, "ó": 0xE3, "ọ": 0xE4, "ồ": 0xE5, "ổ": 0xE6, "ỗ": 0xE7, "ố": 0xE8, "ộ": 0xE9, "ờ": 0xEA, "ở": 0xEB, "ỡ": 0xEC, "ớ": 0xED, "ợ": 0xEE,
    "ù": 0xEF, "ủ": 0xF1, "ũ": 0xF2, "ú": 0xF3, "ụ": 0xF4, "ừ": 0xF5, "ử": 0xF6, "ữ": 0xF7, "ứ": 0xF8, "ự": 0xF9, "ỳ": 0xFA, "ỷ": 0xFB, "ỹ": 0xFC, "ý": 0xFD, "ỵ": 0xFE,
}
#: Encodings that text may have been read in by mistake, most usual first, and those that it may really have been in.
READ_AS = ("cp1252", "latin-1", "cp1258", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp1254", "cp1257", "mac_cyrillic", "gbk", "cp932", "big5", "euc_kr")
#: Pairs tried for texts that were not UTF-8: read as -> really.
LEGACY = [(w, t) for w, many in {
    "cp1252": ("tcvn3", "cp1251", "koi8_r", "euc_jp", "cp932", "mac_roman", "cp866", "gbk", "cp1258", "cp437", "cp850"),
    "cp1251": ("cp1252", "koi8_r", "cp866", "mac_cyrillic", "tcvn3"), "koi8_r": ("cp1251", "cp866", "cp1252"), "cp866": ("cp1251", "koi8_r", "cp1252"),
    "mac_roman": ("cp1252", "cp1251", "euc_jp", "cp932", "tcvn3"), "cp437": ("cp1252", "cp1251", "cp866", "tcvn3"), "cp850": ("cp1252", "euc_jp", "cp932", "tcvn3"),
}.items() for t in many]
#: What a stretch without neighbours that rarely meet must gain in log probability as a whole to be looked at: right text gains as
#: much with a probability of at most one in 10,000 (by Markov's inequality, a likelihood ratio of 10,000). And what its two ends
#: may make of it.
EVIDENCE, EDGES = float(np.log(10_000)), 4.0
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});")
_LOST = "�"

_SINGLE: dict[str, tuple] = {}


def _table(name: str) -> tuple[dict[int, int], str]:
    """(bytes by code point, decoding table) of a single-byte encoding. Bytes that it leaves out stand for the control of their
    number, and a control from 0x80 to 0x9F for its own byte wherever it appears, as lenient decoders have it."""
    if name not in _SINGLE:
        back = {code: letter for letter, code in TCVN3.items()} if name == "tcvn3" else {}
        chars = []
        for i in range(256):
            try:
                chars.append(back.get(i, chr(i)) if name == "tcvn3" else bytes([i]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(i))
        if name == "cp437":
            chars[:32] = map(chr, range(32))
        encoding = {i: i for i in range(0x80, 0xA0)} | {ord(c): i for i, c in enumerate(chars)}
        _SINGLE[name] = (encoding, "".join(chars))
    return _SINGLE[name]


_WIDE = {"gbk", "cp932", "big5", "euc_kr", "euc_jp"}
_NO_BREAK = re.compile(rb"(?<=[\xc2-\xc6\xd0\xd1]) |(?<=\xe1[\xba\xbb]) |(?<=\xe2\x80) |(?<=\xe3[\x80-\x83]) ")


def to_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that would have been read as text; None if there are none."""
    try:
        return text.encode(read_as) if read_as in _WIDE else codecs.charmap_encode(text, "strict", _table(read_as)[0])[0]
    except UnicodeError:
        return None


def from_bytes(data: bytes, really: str) -> str | None:
    """data decoded; None if it is not valid."""
    try:
        if really == "utf-8" or really in _WIDE:
            return data.decode(really)
        return codecs.charmap_decode(data, "strict", _table(really)[1])[0]
    except UnicodeError:
        return None


def utf8_again(text: str, read_as: str) -> str | None:
    """text's bytes as UTF-8; a blank where only a no-break space's byte fits (blanks are often normalized) counts as that."""
    data = to_bytes(text, read_as)
    if data is None or data.isascii():
        return None
    found = from_bytes(data, "utf-8")
    if found is None and b" " in data:
        found = from_bytes(_NO_BREAK.sub(b"\xa0", data), "utf-8")
    return found


def _taken() -> dict[str, int]:
    """For each character beyond ASCII: bits of the encodings of READ_AS that have it."""
    found: dict[str, int] = {}
    for bit, name in enumerate(READ_AS):
        if name in _WIDE:
            pairs = (bytes((a, b)).decode(name, "ignore") for a in range(0x80, 0x100) for b in range(0x40, 0x100))
            chars = {c for text in pairs for c in text if not c.isascii()} | {c for a in range(0x80, 0x100) for c in bytes((a,)).decode(name, "ignore")}
        else:
            chars = {chr(code) for code in _table(name)[0] if code >= 0x80}
        for c in chars:
            found[c] = found.get(c, 0) | 1 << bit
    return found


_TAKES = _taken()
_EVERY = (1 << len(READ_AS)) - 1
_NOT_ASCII = re.compile("[^\x00-\x7f]")


_MASKS: dict[str, int] = {}
_VALID: dict[str, int] = {}


def _taken_by(word: str) -> int:
    """Bits of the encodings of READ_AS that have all characters of the word. Kept, as words repeat."""
    known = _MASKS.get(word)
    if known is None:
        known = _EVERY
        for c in set(_NOT_ASCII.findall(word)):
            known &= _TAKES.get(c, 0)
        _keep(_MASKS, word, known)
    return known


def _valid_in(word: str) -> int:
    """Bits of the encodings of READ_AS in which the word's bytes are valid UTF-8, or are with a no-break space's byte after them. In
    the others no text with the word between blanks is valid, as no byte of a blank is part of another character. Kept, as words repeat."""
    known = _VALID.get(word)
    if known is None:
        known, mask, tried = 0, _taken_by(word), {}
        for i, name in enumerate(READ_AS):
            if not mask >> i & 1:
                continue
            data = to_bytes(word, name)
            if data is None:
                continue
            if data not in tried:
                tried[data] = from_bytes(data, "utf-8") is not None or from_bytes(_NO_BREAK.sub(b"\xa0", data + b" "), "utf-8") is not None
            known |= tried[data] << i
        _keep(_VALID, word, known)
    return known


_NAMES: dict[int, list[str]] = {}


def _names(mask: int) -> list[str]:
    """The encodings of READ_AS of the bits of mask."""
    known = _NAMES.get(mask)
    if known is None:
        known = [name for i, name in enumerate(READ_AS) if mask >> i & 1]
        _keep(_NAMES, mask, known)
    return known


def may_read_as(text: str) -> list[str]:
    """Encodings of READ_AS that text may have been read in: those that have all its characters."""
    return _names(_taken_by(text))


def _may_be_utf8(text: str) -> list[str]:
    """Those of may_read_as in which the bytes of text may be valid UTF-8."""
    mask, first = _EVERY, True
    for word in text.split(" "):
        if not word.isascii():
            mask &= _taken_by(word)
            if mask and first:
                mask &= _valid_in(word)
                first = False
            if not mask:
                break
    return _names(mask)


#: Classes of characters: each character of the alphabets below has its own, the rest share a few.
_OWN = [(0x0, 0x250), (0x300, 0x370), (0x400, 0x460), (0x1EA0, 0x1F00), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2140), (0x3000, 0x3100), (0xFF60, 0xFFA0)]


def class_table() -> tuple[np.ndarray, int]:
    """(class of each code point, number of classes)."""
    points = np.arange(0x110000)
    shared = 32
    classes = (points >> 8) % shared
    at = shared
    for begin, end in _OWN:
        classes[begin:end] = at + np.arange(end - begin)
        at += end - begin
    for begin, end, step in ((0x2200, 0x2300, 16), (0x2500, 0x2600, 16)):
        classes[begin:end] = at + np.arange(end - begin) // step
        at += (end - begin) // step
    classes[0x4E00:0xA000] = at + points[0x4E00:0xA000] % 128
    at += 128
    classes[0xFFFD] = at
    return classes.astype(np.uint16), at + 1


_CLASS, K = class_table()


def codes(text: str) -> np.ndarray:
    """The class of each character."""
    return _CLASS[points(text)]


def pair_codes(classes: np.ndarray) -> np.ndarray:
    """A number for each two neighbours."""
    return classes[:-1].astype(np.int32) * K + classes[1:]


#: Encodings by whose signs of UTF-8 a document is unfit for training, one bit each. Of mac_roman only the leads that running
#: text does not use (its others are quotation marks and dashes).
_SIGNED = ("cp1252", "cp1258", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")


def _sign_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: bits of encodings in which it shows the first byte of two, the first of three, a later byte; and kinds
    of characters (1 a symbol, 2 a Latin-1 letter, 4 a lost or control character, 8 Latin, 16 Cyrillic)."""
    two, three, later, kind = (np.zeros(0x110000, np.uint8) for _ in range(4))
    for bit, name in enumerate(_SIGNED):
        chars = _table(name)[1]
        for byte, c in enumerate(chars):
            if 0xC3 <= byte < 0xE0 and (name != "mac_roman" or byte in (0xC3, 0xC4, 0xC6)):
                two[ord(c)] |= 1 << bit
            if 0xE1 <= byte < 0xEB:
                three[ord(c)] |= 1 << bit
            if 0x80 <= byte < 0xC0 and c != " ":
                later[ord(c)] |= 1 << bit
    for c in range(0xA1, 0xC0):
        kind[c] |= 1
    for c in "‚„†‡‰‹›ƒˆ˜€×÷":
        kind[ord(c)] |= 1
    kind[0xC0:0x100] |= 2
    kind[0x80:0xA0] |= 4
    kind[0xFFFD] |= 4
    kind[ord("A") : ord("Z") + 1] |= 8
    kind[ord("a") : ord("z") + 1] |= 8
    kind[0x400:0x460] |= 16
    return two, three, later, kind


_TWO, _THREE, _LATER, _KIND = _sign_tables()


def _signed(text: str) -> bool:
    """Whether text shows a sign of UTF-8 read as something else."""
    at = points(text)
    later = _LATER[at]
    return bool(((_TWO[at[:-1]] & later[1:]) != 0).any() or ((_THREE[at[:-2]] & later[1:-1] & later[2:]) != 0).any())


def points(text: str) -> np.ndarray:
    """The code point of each character."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fit_for_training(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the texts that begin at starts in the code points at look clean enough to train on: no sign of UTF-8 read as
    something else, of lost characters, of controls or of entities, Latin and Cyrillic apart, and no more symbols and Latin-1
    letters than running text has."""
    later, kind = _LATER[at], _KIND[at]
    bad = (kind & 4) != 0
    bad[:-1] |= (_TWO[at[:-1]] & later[1:]) != 0
    bad[:-2] |= (_THREE[at[:-2]] & later[1:-1] & later[2:]) != 0
    bad[:-1] |= ((kind[:-1] & 24) | (kind[1:] & 24)) == 24
    bad[:-2] |= (at[:-2] == 38) & ((kind[1:-1] & 8) != 0) & ((kind[2:] & 8) != 0)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    sizes = np.diff(np.append(starts, len(at)))
    return (sums(bad) == 0) & (sums(kind & 1) <= 0.005 * sizes + 2) & (sums((kind & 2) != 0) <= 0.35 * sizes) & (sizes > 20)


@dataclass
class Counts:
    """How often each two classes of characters are neighbours: for each language (None: all text) the pairs that occur and their
    numbers. Small whatever the corpus: at most K * K pairs a language."""

    by_language: dict[str | None, tuple[np.ndarray, np.ndarray]]

    def less(self, other: Counts) -> Counts:
        """These counts without other's."""
        found = {}
        for language, (pairs, n) in self.by_language.items():
            gone = np.zeros(K * K, np.int64)
            if language in other.by_language:
                gone[other.by_language[language][0]] = other.by_language[language][1]
            found[language] = (pairs, n - gone[pairs])
        return Counts(found)

    @property
    def total(self) -> int:
        return int(self.by_language[None][1].sum()) if None in self.by_language else 0


#: Weight, in pairs, of the model of all text within a language's own, and of single characters within that.
OF_ALL, OF_SINGLE = 2.0, 2.0
#: Prior log probabilities: that a right stretch shows a garbled word as an example; that what is shown is nothing but lost
#: characters; that what is shown was garbled once more before; that the encoding changes from one word of a stretch to the next.
EXAMPLE, ALL_LOST, AGAIN, SWITCH = (float(np.log(p)) for p in (1e-2, 5e-2, 1e-4, 1e-3))
#: What the lost characters of a longer run weigh each beyond the first.
LOST_EACH = -2.5


class Model:
    """Smoothed n-gram models of clean text (n = 2, over classes of characters): one of all text and one for each language.

    A language's probabilities are interpolated with those of all text, these with single characters. A stretch has the
    probability of the mixture of the languages by their shares. margin and example_margin decide (see Verdict).
    """

    def __init__(self, counts: Counts) -> None:
        pairs = np.zeros(K * K, np.float32)
        if None in counts.by_language:
            at, n = counts.by_language[None]
            pairs[at] = n
        pairs = pairs.reshape(K, K)
        total = max(1.0, float(pairs.sum(dtype=np.float64)))
        single = ((pairs.sum(0) + 0.5) / (total + 0.5 * K)).astype(np.float32)
        row = pairs.sum(1, keepdims=True)
        base = np.log((pairs + OF_SINGLE * single) / (row + OF_SINGLE)).astype(np.float32)
        ascii_class = np.zeros(K, bool)
        ascii_class[_CLASS[:128]] = True
        self.rare = ((pairs <= 1e-7 * total + 1) & ~(ascii_class[:, None] & ascii_class[None, :])).ravel()
        own_counts = [x for language, x in counts.by_language.items() if language is not None and x[1].sum()]
        self.logp = base.ravel()
        self.tables = np.empty((K * K, 1 + len(own_counts)), np.float32)  # what a pair needs lies side by side
        self.tables[:, 0], shares = self.logp, [0.01]
        for column, (at, n) in enumerate(own_counts, 1):
            rows = np.bincount(at // K, weights=n, minlength=K)
            own = (base + np.log(OF_ALL / (rows + OF_ALL)).astype(np.float32)[:, None]).ravel()
            own[at] = np.log((n + OF_ALL * np.exp(self.logp[at])) / (rows[at // K] + OF_ALL))
            self.tables[:, column] = own
            shares.append(float(n.sum()) / total)
        self.priors = np.log(np.array(shares) / sum(shares))
        blank = _CLASS[32]
        blanks = float(pairs[blank].sum())
        self.word_mean = min(12.0, max(2.0, total / blanks - 1)) if blanks else 4.0
        self.typical = float((pairs.ravel() * self.logp).sum(dtype=np.float64)) / total
        self.margin, self.example_margin = EVIDENCE, 0.0
        self._lost: dict[tuple[int, int, int], np.ndarray] = {}
        self._at: dict[str, int] = {}
        self._vectors = np.empty((1024, self.tables.shape[1]))
        self._alone: list[float] = []
        self._edges: dict[tuple[str, str, str], np.ndarray] = {}
        self._texts: dict[str, float] = {}
        self._ruled_out: np.ndarray | None = None
        self._words: dict[str, float] = {}
        self._surprises: dict[str, float] = {}

    def by_language(self, text: str, ends: str = "\n") -> np.ndarray:
        """Log probability of text between two ends, by each table. A run of lost characters counts as all characters of as many bytes
        together."""
        if _LOST not in text:
            return self._of_words(text.split(" ")) + self._edge(text, ends)
        classes = codes(f"{ends}{text}{ends}")
        lost = classes == _LOST_CLASS
        whole = ~(lost[:-1] | lost[1:])
        found = self._sums(pair_codes(classes)[whole])
        edges = np.flatnonzero(np.diff(lost.astype(np.int8)))
        for begin, end in zip(edges[::2] + 1, edges[1::2] + 1, strict=True):
            found += self._through_lost(int(classes[begin - 1]), int(end - begin), int(classes[end]))
        return found

    def _sums(self, pairs: np.ndarray) -> np.ndarray:
        return np.add.reduce(self.tables.take(pairs, axis=0), axis=0, dtype=np.float64)

    def learn(self, words: Iterable[str]) -> None:
        """Score words between two blanks, those that are new all at once. At most KEPT are kept, or as many as are needed at a time;
        results do not depend on what is kept."""
        words = dict.fromkeys(words)
        new = [w for w in words if w not in self._at]
        if len(self._at) + len(new) > KEPT:
            self._at.clear()
            self._alone.clear()
            new = list(words)
        if len(self._at) + len(new) > len(self._vectors):
            grown = np.empty((2 * (len(self._at) + len(new)), self._vectors.shape[1]))
            grown[: len(self._at)] = self._vectors[: len(self._at)]
            self._vectors = grown
        for i in range(0, len(new), 10_000):
            part, first = new[i : i + 10_000], len(self._at)
            sizes = np.fromiter((len(w) + 1 for w in part), np.int64, len(part))
            pairs = pair_codes(codes(f" {' '.join(part)} "))
            found = np.add.reduceat(self.tables.take(pairs, axis=0), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            self._vectors[first : first + len(part)] = found
            self._alone += np.logaddexp.reduce(found + self.priors, axis=1).tolist()
            self._at.update(zip(part, range(first, first + len(part)), strict=True))

    def _of_words(self, words: list[str]) -> np.ndarray:
        """Log probability of words between blanks, by each table."""
        try:
            rows = [self._at[w] for w in words]
        except KeyError:
            self.learn(words)
            rows = [self._at[w] for w in words]
        return self._vectors[rows[0]].copy() if len(rows) == 1 else np.add.reduce(self._vectors.take(rows, axis=0), axis=0)

    def _edge(self, text: str, ends: str) -> np.ndarray:
        """What two ends give a text instead of blanks."""
        key = (text[:1], text[-1:], ends)
        known = self._edges.get(key)
        if known is None:
            two = lambda a, b: self._sums(pair_codes(codes(a + b)))
            if text:
                known = two(ends, key[0]) - two(" ", key[0]) + two(key[1], ends) - two(key[1], " ")
            else:
                known = two(ends, ends) - two(" ", " ")
            _keep(self._edges, key, known)
        return known

    def _through_lost(self, a: int, n: int, b: int) -> np.ndarray:
        key = (a, n, b)
        known = self._lost.get(key)
        if known is None:
            x = _OF_BYTES[n if 2 <= n <= 4 else 0]
            known = np.logaddexp.reduce(self.tables[a * K + x].astype(np.float64) + self.tables[x * K + b], axis=0)
            known = self._lost[key] = known + (LOST_EACH * (-(-n // 3) - 1) if n > 4 else 0.0)
        return known

    def score(self, text: str, ends: str = "\n") -> float:
        """Log probability of a stretch between two ends under the mixture of languages."""
        if ends == "\n" and text in self._texts:
            return self._texts[text]
        return float(np.logaddexp.reduce(self.by_language(text, ends) + self.priors))

    def prepare(self, texts: Iterable[str]) -> None:
        """Score stretches all at once. Only these are kept, until the next ones."""
        many = [t for t in dict.fromkeys(texts) if _LOST not in t]
        words = [t.split(" ") for t in many]
        self.learn(itertools.chain.from_iterable(words))
        self._texts = {}
        for i in range(0, len(many), 1000):
            part, of = many[i : i + 1000], words[i : i + 1000]
            rows = np.fromiter((self._at[w] for many in of for w in many), np.int64)
            sizes = np.fromiter(map(len, of), np.int64, len(of))
            found = np.add.reduceat(self._vectors.take(rows, axis=0), np.cumsum(sizes) - sizes, axis=0)
            found += np.array([self._edge(t, "\n") for t in part]) + self.priors
            self._texts.update(zip(part, np.logaddexp.reduce(found, axis=1).tolist(), strict=True))

    def changed(self, parts: _Parts, changed: dict[int, str]) -> float:
        """The score of words between blanks of which some, neither the first nor the last, are replaced by others."""
        if parts.by_language is None:
            parts.by_language = self.by_language(parts.text) + self.priors
        found = parts.by_language
        for i, p in changed.items():
            found = found + (self._of_words([p]) - self._of_words([parts.of[i]]))
        return float(np.logaddexp.reduce(found))

    def right(self, score: float, odd: list[str]) -> float:
        """Log probability of a stretch as it stands, from its score, of which the words odd may be garbled. Right words surprise more
        often than the mixture says (names, foreign words), so what these are less likely than typical text counts half; words
        without letters (ornaments, formulas) follow it even less, so theirs counts a quarter."""
        try:
            return score + sum(map(self._surprises.__getitem__, odd))
        except KeyError:
            return score + sum(map(self._surprise, odd))

    def _surprise(self, word: str) -> float:
        known = self._surprises.get(word)
        if known is None:
            at = self._at.get(word)
            known = max(0.0, self.typical * (len(word) + 1) - (self.score(word, " ") if at is None else self._alone[at])) * (0.5 if any(map(str.isalpha, word)) else 0.75)
            _keep(self._surprises, word, known)
        return known

    def word(self, word: str) -> float:
        """Log probability of one word on its own, of any language, as long as words are (a Poisson distribution)."""
        known = self._words.get(word)
        if known is None:
            known = float(self.by_language(word, " ")[0]) if word.strip(_LOST) else ALL_LOST
            known += self._length(len(word))
            _keep(self._words, word, known)
        return known

    def _length(self, n: int) -> float:
        mean = self.word_mean - 1
        return (n - 1) * math.log(mean) - mean - math.lgamma(n) if n else 0.0

    @property
    def ruled_out(self) -> np.ndarray:
        """logp with one class more, of characters that rule a chain out."""
        if self._ruled_out is None:
            found = np.full((K + 1, K + 1), _RULED_OUT, np.float32)
            found[:K, :K] = self.logp.reshape(K, K)
            self._ruled_out = found.ravel()
        return self._ruled_out

    def suspicious(self, classes: np.ndarray) -> np.ndarray:
        """Positions of characters that follow or precede another as they rarely do in clean text."""
        return np.flatnonzero(self.rare[pair_codes(classes)])


def _keep(cache: dict, word: object, value: object) -> None:
    """Remember a value for a word, of at most KEPT words at a time. Results do not depend on what is kept."""
    if len(cache) >= KEPT:
        cache.clear()
    cache[word] = value


#: Words of which values are remembered at a time.
KEPT = 100_000
_LOST_CLASS = int(_CLASS[0xFFFD])


def _of_bytes() -> dict[int, np.ndarray]:
    """Classes of characters of 2, 3 and 4 bytes in UTF-8; at 0 all that are not ASCII."""
    size = np.full(K, 3)
    size[_CLASS[np.arange(0x80, 0x800)]] = 2
    size[:32] = 4
    size[_CLASS[:128]] = 1
    size[_LOST_CLASS] = 1
    found = {n: np.flatnonzero(size == n) for n in (2, 3, 4)}
    return found | {0: np.flatnonzero(size > 1)}


_OF_BYTES = _of_bytes()


@dataclass
class Verdict:
    """The likeliest reading of a stretch as garbled text: the original (None where it is lost) and the chain.

    gain: by how much its log probability exceeds that of the stretch as it stands. fit: by how much it exceeds that of a
    right stretch in which the garbled words are only shown. The stretch counts as garbled when gain is at least the model's
    margin and fit at least its example_margin.
    """

    gain: float = 0.0
    fit: float = 0.0
    text: str | None = None
    chain: str = ""

    def accepted(self, model: Model) -> bool:
        return bool(self.chain) and self.gain >= model.margin and self.fit >= model.example_margin


NOTHING = Verdict()
#: The gain where no right text has such characters at all, and the largest value that a margin may have.
CERTAIN, SURE = 1e6, 50.0
_QUOTES = string.punctuation + "«»“”‘’„「」『』‹›"


def _fit(parts: list[tuple[str, bool]], likely: float, model: Model, strip: str = string.punctuation) -> float:
    """likely, the log probability of a garbled reading, against that of a right stretch in which each changed word (parts: words and
    whether they changed) is shown as an example: an ordinary word of any language, which its neighbours do not predict."""
    shown = model.score(" ".join(w for w, changed in parts if not changed))
    for w, changed in parts:
        if changed:
            shown += EXAMPLE + model.word(w.strip(strip) or w)
    return likely - shown


def judge(text: str, model: Model, hopes: Hopes) -> Verdict:
    """The likeliest garbled reading of a stretch: every chain back to UTF-8, up to DEPTH times over; every chain of LEGACY that its
    words' hopes do not rule out; where none gains by taking all of it, such chains for some of its words."""
    plain = html.unescape(text) if _ENTITY.search(text) else text
    if _LOST in plain:
        return _judge_lost(plain, model)
    if plain.isascii():
        return NOTHING
    score = model.score(plain)
    own = model.right(score, [w for w in plain.split() if not w.isascii()])
    best, likely = _layers(plain, own, model)
    words = blanks(plain)
    most = hopes.at_most(words)
    best = _legacy(plain, words, most, score, own, likely, model, hopes) or best or NOTHING
    if best.gain > 0:
        return best
    part = _in_part(plain, words, most, score, model, hopes)
    return part if part.gain > best.gain or not best.chain else best


#: How many wrong decodings may lie on top of each other.
DEPTH = 3


def _layers(plain: str, own: float, model: Model) -> tuple[Verdict | None, float]:
    """The likeliest chain that turns all of plain into valid UTF-8, once or several times over, and its log probability."""
    level, met, best, likely = [(plain, "", None)], {plain}, None, -np.inf
    for depth in range(DEPTH):
        after = []
        for t, chain, _ in level:
            for name in _may_be_utf8(t):
                again = utf8_again(t, name)
                if again is None or again in met:
                    continue
                met.add(again)
                score = model.score(again)
                after.append((again, f"{chain}{name}>utf-8 ", t))
                if score > likely + 1e-6:
                    likely, best = score, (again, after[-1][1], t, depth)
        level = [x for x in after if not x[0].isascii()]
        if not level:
            break
    if best is None:
        return None, likely
    again, chain, before, depth = best
    fit = _fit([(w, not w.isascii()) for w in again.split()], likely, model)
    if depth and fit < 0:  # a right stretch that shows a garbled word, garbled as a whole: only the last layer goes
        again, chain = before, chain.split()[0]
    return Verdict(likely - own, (max(fit, 0.0) if depth else fit) - AGAIN * depth, again, chain.strip()), likely


def _legacy(plain: str, words: list[str], most: float, score: float, own: float, least: float, model: Model, hopes: Hopes) -> Verdict | None:
    """The likeliest chain of LEGACY, if it is likelier than plain as it stands (own) and than least. Chains are tried in the order of
    what their words (at most: most) may gain, and no longer once none can be likelier."""
    best, least = None, max(least, own)
    if score + most + EDGES <= least:
        return None
    bound = hopes.by_chain_of(words).tolist()
    for c in sorted([c for c, x in enumerate(bound) if x > 0], key=bound.__getitem__, reverse=True):
        if score + bound[c] + EDGES <= least:
            break
        again = _through(plain, *HOPED[c])
        if again is None or again == plain:
            continue
        found = model.score(again)
        if found > least + _SAME:
            least, best = found, (again, c)
    if best is None:
        return None
    again, c = best
    kept = set(plain.split())
    fit = _fit([(w, w not in kept) for w in again.split()], least, model)
    return Verdict(least - own, fit, again, ">".join(HOPED[c]))


def _words(text: str) -> list[str]:
    return re.split(r"([ \t\n\r]+)", text)


_AGAIN: dict[str, tuple[tuple[str, str], ...]] = {}
_READS: dict[str, int] = {}


def _agains(word: str) -> tuple[tuple[str, str], ...]:
    """(encoding of READ_AS, the word's bytes in it as UTF-8) where these are valid and another word. Kept, as words repeat."""
    known = _AGAIN.get(word)
    if known is None:
        tried = ((name, utf8_again(word, name)) for name in may_read_as(word))
        known = tuple((name, again) for name, again in tried if again is not None and again != word)
        _keep(_AGAIN, word, known)
    return known


def _reads(word: str) -> int:
    """Bits of the encodings that LEGACY reads as and that have all characters of the word. Kept, as words repeat."""
    known = _READS.get(word)
    if known is None:
        known = sum(1 << bit for bit, r in enumerate(_LEGACY_BY_READ) if to_bytes(word, r) is not None)
        _keep(_READS, word, known)
    return known


#: What sums of hopes in another order may differ by.
_ROUNDING = 1e-2
#: What scores of readings that are equally likely may differ by, added up in another order; the first of them is taken.
_SAME = 1e-9


def _in_part(text: str, between: list[str], all_most: float, score: float, model: Model, hopes: Hopes) -> Verdict:
    """The likeliest reading in which a chain takes only runs of words; each run is a change of encoding more. between: the words of text
    between blanks, all_most: what they may gain."""
    parts, best = _Parts(_words(text)), NOTHING
    by_name: dict[str, dict[int, str]] = {}
    for i in parts.odd:
        for name, again in _agains(parts.of[i]):
            by_name.setdefault(name, {})[i] = again
    tried: list[dict[int, str]] = []
    for name, changed in by_name.items():
        if changed not in tried:  # several encodings often give the same; the first counts
            tried.append(changed)
            best = _better(parts, changed, f"{name}>utf-8 in part", score, model, best)
    if all_most <= best.gain - SWITCH - EDGES:
        return best
    most = hopes.by_chain_of(between).tolist()  # of a run at most as much, where its words are those between blanks
    if "\t" in text or "\r" in text:
        most = [math.inf] * len(HOPED)
    reads = None
    for bit, (read_as, many) in enumerate(_LEGACY_BY_READ.items()):
        if max(most[c] for c in _HOPED_OF[bit]) + _ROUNDING <= best.gain - SWITCH - EDGES:
            continue
        reads = reads or {i: _reads(parts.of[i]) for i in parts.odd}
        for begin, end in _runs(parts, reads, bit):
            before = "".join(parts.of[begin:end])
            bound = most if (begin, end) == (parts.first, parts.last + 1) and parts.only_blanks else hopes.by_chain_of(blanks(before)).tolist()
            for c, really in zip(_HOPED_OF[bit], many):
                if bound[c] <= best.gain - SWITCH - EDGES:
                    continue
                again = _through(before, read_as, really)
                pieces = None if again is None else _words(again)
                if pieces is not None and len(pieces) == end - begin and again != before:
                    changed = {begin + i: p for i, p in enumerate(pieces) if p != parts.of[begin + i]}
                    if changed in tried:
                        continue
                    tried.append(changed)
                    best = _better(parts, changed, f"{read_as}>{really} in part", score, model, best)
    return best


_LEGACY_BY_READ = {w: [t for v, t in LEGACY if v == w] for w, _ in LEGACY}


class _Parts:
    """Words and what is between them (of), which of them are not ASCII (odd), and the first and the last word."""

    def __init__(self, of: list[str]) -> None:
        self.of, self.odd = of, [i for i, p in enumerate(of) if not p.isascii()]
        self.first = next((i for i, p in enumerate(of) if p.strip()), -1)
        self.last = next((i for i in range(len(of) - 1, -1, -1) if of[i].strip()), -1)
        self.text = "".join(of)
        self.only_blanks = not ("\t" in self.text or "\n" in self.text or "\r" in self.text or _LOST in self.text)
        self.by_language: np.ndarray | None = None


def _runs(parts: _Parts, reads: dict[int, int], bit: int) -> Iterator[tuple[int, int]]:
    """(first part, end) of each longest run of words that an encoding may have been read as (bits of reads; ASCII words may always), if
    one of them is not ASCII."""
    begin, some, last = -1, False, -1
    for i in parts.odd:
        if not parts.of[i].strip():
            continue
        if reads[i] >> bit & 1:
            if not some:
                some, begin = True, _word_from(parts, last + 1)
        else:
            if some:
                yield begin, _word_before(parts, i) + 1
            some, last = False, i
    if some:
        yield begin, parts.last + 1


def _word_from(parts: _Parts, i: int) -> int:
    return next(j for j in range(i, len(parts.of)) if parts.of[j].strip())


def _word_before(parts: _Parts, i: int) -> int:
    return next(j for j in range(i - 1, -1, -1) if parts.of[j].strip())


def _changes(parts: _Parts, changed: dict[int, str]) -> int:
    """How often the encoding changes between the first and the last word, if ASCII words may be of either; before the first and after
    the last word it need not change."""
    odd = parts.odd
    kinds = [i in changed for i in (odd if changed.keys() <= set(odd) else sorted({*odd, *changed}))]
    if all(kinds):  # right words are ASCII here, so they may have come the same way
        return 0
    found = sum(map(operator.ne, kinds, kinds[1:]))
    return found + (kinds[0] and parts.first not in changed) + (kinds[-1] and parts.last not in changed)


def _better(parts: _Parts, changed: dict[int, str], chain: str, score: float, model: Model, best: Verdict) -> Verdict:
    """The likelier of best and the reading with the changed parts; score is that of all parts as they stand."""
    if not changed:
        return best
    again = parts.of.copy()
    for i, p in changed.items():
        again[i] = p
    likely, right = SWITCH * _changes(parts, changed), model.right(score, [parts.of[i] for i in changed])
    if len(changed) <= 3 and parts.first not in changed and parts.last not in changed and parts.only_blanks:
        likely += model.changed(parts, changed)
    else:
        likely += model.score("".join(again))
    gain = likely - right
    if gain <= best.gain + _SAME:
        return best
    return Verdict(gain, _fit([(p, i in changed) for i, p in enumerate(again) if p.strip()], likely, model), "".join(again), chain)


_BESIDE_LOST = re.compile("([^\x00-\x7f�«»“”‘’„「」『』‹›]+)")
#: The bytes that cp1252 has no character for, as controls.
_UNDEFINED = "\x81\x8d\x8f\x90\x9d"


def _judge_lost(text: str, model: Model) -> Verdict:
    """A stretch with replacement characters. Where they are bytes that cp1252 lacks, in UTF-8 read as cp1252, each word has few
    possible originals and the likeliest is taken; other lost characters do not come back. Words that are not ASCII and were not
    hit mean that the encoding changed within the stretch."""
    parts, changed = _words(text), []
    for i, w in enumerate(parts):
        changed.append(_LOST in w)
        if w.replace(_LOST, "").isascii():
            continue  # no first byte of a character is left
        n = w.count(_LOST)
        fillings = itertools.product(_UNDEFINED, repeat=n) if n <= 3 else ([c] * n for c in _UNDEFINED)
        found = []
        for filling in fillings:
            it = iter(filling)
            again = utf8_again("".join(next(it) if c == _LOST else c for c in w), "cp1252")
            if again is not None and again != w:
                found.append((float(model.by_language(again, " ")[0]), again))
        if found:
            parts[i], changed[i] = max(found)[1], True
    # Right characters that are not ASCII in a word that lost others: the encoding changed within it.
    pieces = [x for p, c in zip(parts, changed, strict=True) for x in (((q, _LOST in q) for q in _BESIDE_LOST.split(p) if q) if c and _LOST in p else ((p, c),))]
    parts, changed = [p for p, _ in pieces], [c for _, c in pieces]
    again = "".join(parts)
    hit = {i: p for i, (p, c) in enumerate(zip(parts, changed, strict=True)) if c}
    likely = model.score(again) + SWITCH * min(2, _changes(_Parts(parts), hit))
    fit = _fit([(p, c) for p, c in zip(parts, changed, strict=True) if p.strip()], likely, model, _QUOTES)
    return Verdict(CERTAIN, fit, None if _LOST in again else again, "lost" if _LOST in again else "cp1252>utf-8 lost bytes")


#: Points from here on are in no single-byte encoding of LEGACY.
_FAR = 0x2600
#: What a character that rules a chain out weighs, against log probabilities of some units.
_RULED_OUT = -50.0


def _chain_classes() -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each encoding that LEGACY reads as: which points it changes, and for each single-byte encoding that it may really have
    been the class of what each point becomes (K where the point rules the chain out)."""
    found = []
    for read_as in dict(LEGACY):
        encoding, tables = _table(read_as)[0], []
        changes = np.zeros(_FAR + 1, bool)
        changes[[c for c in encoding if 0x80 <= c < _FAR]] = True
        for really in (t for w, t in LEGACY if w == read_as and t not in _WIDE):
            classes = _CLASS[: _FAR + 1].astype(np.int32)
            classes[[c for c in _table(really)[0] if 0x80 <= c < _FAR]] = K
            for c, byte in encoding.items():
                if c < _FAR:
                    classes[c] = _CLASS[ord(_table(really)[1][byte])]
            tables.append(classes)
        found.append((changes, tables))
    return found


_CHAINS = _chain_classes()
_WIDE_CHAINS = [(w, t) for w, t in LEGACY if t in _WIDE]
#: LEGACY in the order of the columns of hopes.
HOPED = [(w, t) for w, t in LEGACY if t not in _WIDE] + _WIDE_CHAINS
#: For each encoding that LEGACY reads as the columns of its chains.
_HOPED_OF = [[HOPED.index((w, t)) for t in many] for w, many in _LEGACY_BY_READ.items()]


def hopes(words: list[str], model: Model) -> np.ndarray:
    """For each word (row) and chain of HOPED (column) what it gains in log probability between blanks, at least 0. A run of words
    gains no more through a chain than its words' hopes together."""
    text = " " + " ".join(words) + " "
    at = points(text)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    begins = np.append(0, ends[:-1])  # each word's pairs begin with the blank before it
    best, chain = np.zeros((len(words), len(LEGACY)), np.float32), -1
    classes, near = _CLASS[at].astype(np.int32), np.minimum(at, _FAR)
    logp = model.ruled_out
    for changes, tables in _CHAINS:
        touched, chain_before = changes[near], chain
        chain += len(tables)
        pair = np.flatnonzero(touched[:-1] | touched[1:])
        if not len(pair):
            continue
        word = np.searchsorted(begins, pair, "right") - 1
        first = np.flatnonzero(np.diff(word, prepend=-1))
        mine, a, b = word[first], near[pair], near[pair + 1]
        x, y = classes[pair], classes[pair + 1]
        was, far_a, far_b = logp[x * (K + 1) + y], np.flatnonzero(a == _FAR), np.flatnonzero(b == _FAR)
        x, y = x[far_a], y[far_b]
        for c, table in enumerate(tables, chain_before + 1):
            to_a, to_b = table[a], table[b]
            to_a[far_a], to_b[far_b] = x, y
            best[mine, c] = np.maximum(0, np.add.reduceat(logp[to_a * (K + 1) + to_b] - was, first))
    _wide_gains(words, model, best[:, -len(_WIDE_CHAINS) :])
    return best


_WIDE_AGAIN: dict[str, tuple[tuple[int, str], ...]] = {}


def _wide(word: str) -> tuple[tuple[int, str], ...]:
    """(chain of LEGACY to an encoding of two bytes a letter, what it makes of the word between blanks). Kept, as words repeat."""
    known = _WIDE_AGAIN.get(word)
    if known is None:
        text = f" {word} "
        read = ((first, many, to_bytes(text, read_as)) for read_as, first, many in _WIDE_BY_READ)
        tried = ((c, from_bytes(data, really)) for first, many, data in read if data is not None for c, really in enumerate(many, first))
        known = tuple((c, again) for c, again in tried if again is not None)
        _keep(_WIDE_AGAIN, word, known)
    return known


def _wide_gains(words: list[str], model: Model, gains: np.ndarray) -> None:
    """Put into gains (a row for each word, a column for each such chain) what each word between blanks gains through it, at least 0."""
    found = [(i, c, again) for i, w in enumerate(words) if not w.isascii() for c, again in _wide(w)]
    if not found:
        return
    row, column, again = (list(x) for x in zip(*found, strict=True))
    texts = [f" {words[i]} " for i in dict.fromkeys(row)]
    sizes = np.fromiter(map(len, itertools.chain(texts, again)), np.int64, len(texts) + len(again))
    begins = np.cumsum(sizes) - sizes
    logp = np.append(model.logp[pair_codes(codes("".join(itertools.chain(texts, again))))], np.float32(0))
    logp[begins[1:] - 1] = 0  # where one text meets the next
    sums = np.add.reduceat(logp, begins)
    own = dict(zip(dict.fromkeys(row), sums.tolist()))
    gains[row, column] = np.maximum(0, sums[len(texts) :] - np.array([own[i] for i in row], np.float32))


_WIDE_BY_READ = [(w, min(i for i, (v, _) in enumerate(_WIDE_CHAINS) if v == w), [t for v, t in _WIDE_CHAINS if v == w]) for w in dict(_WIDE_CHAINS)]


class Hopes(dict):
    """The largest hope of each word met so far, which is looked up as often as the word occurs and scored once, and by chain where
    there is any. At most so many words are kept; results do not depend on what is kept."""

    MOST = 200_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.by_chain: dict[str, int] = {}  # rows of what each chain may gain
        self.rows = np.empty((0, len(LEGACY)), np.float32)

    def _score(self, words: list[str]) -> None:
        found = hopes(words, self.model)
        largest = found.max(1)
        self.update(zip(words, largest.tolist(), strict=True))
        some, n = np.flatnonzero(largest), len(self.by_chain)
        if n + len(some) > len(self.rows):
            grown = np.empty((2 * (n + len(some)), len(LEGACY)), np.float32)
            grown[:n] = self.rows[:n]
            self.rows = grown
        self.rows[n : n + len(some)] = found[some]
        self.by_chain.update(zip((words[i] for i in some), range(n, n + len(some)), strict=True))

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of texts (lists of words) that are new."""
        if len(self) > self.MOST:
            self.clear()
            self.by_chain.clear()
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self)
        if new:
            self._score(list(new))

    def by_chain_of(self, words: list[str]) -> np.ndarray:
        """By chain of HOPED: what words may gain together."""
        if not self.keys() >= set(words):
            self.at_most(words)
        rows = [self.by_chain[w] for w in words if w in self.by_chain]
        return np.add.reduce(self.rows.take(rows, axis=0), axis=0) if rows else np.zeros(len(LEGACY), np.float32)

    def at_most(self, words: list[str]) -> float:
        """What words may gain together if each took its own chain."""
        try:
            return sum(map(self.__getitem__, words))
        except KeyError:
            self._score([w for w in set(words) if w not in self])
            return sum(map(self.__getitem__, words))

    def likelier(self, words: list[str]) -> bool:
        """Whether words may together gain EVIDENCE (less what a text's two ends may make of it) through one chain."""
        least = EVIDENCE - EDGES
        if self.by_chain.keys().isdisjoint(words) or self.at_most(words) < least:
            return False
        return bool(self.by_chain_of(words).max() >= least)


def blanks(text: str) -> list[str]:
    """The words of text between blanks."""
    return text.replace("\n", " ").split(" ")


#: Gains and fits are counted in bins of so much, from the first on; the last has all beyond.
STEP, LOWEST, BINS = 0.5, -100.0, 601


def bin_of(x: float) -> int:
    """The bin of a gain or fit."""
    return int(min(BINS - 1, max(0, math.floor((x - LOWEST) / STEP))))


#: Errors that differ by so much count as equal: a few documents that look clean are garbled.
NOISE = 5e-4


def threshold(right: np.ndarray, garbled: np.ndarray, default: float) -> tuple[float, float, float]:
    """(the value from which a reading is accepted, share of right cases at or above it, share of garbled ones below it), from how
    many cases fall into each bin. The sum of both errors is least there; of several such values (a difference of NOISE is none) it
    is the middle one. Without garbled cases, the default."""
    if not garbled.sum():
        return default, 0.0, 0.0
    above = 1 - np.concatenate(([0], np.cumsum(right)[:-1])) / max(1, right.sum())
    below = np.concatenate(([0], np.cumsum(garbled)[:-1])) / garbled.sum()
    if not right.sum():
        above[:] = 0
    both = above + below
    both = both[: bin_of(SURE) + 1]
    least = np.flatnonzero(both <= both.min() + NOISE)
    at = int(least[len(least) // 2])
    return LOWEST + at * STEP, float(above[at]), float(below[at])


def garble(text: str, really: str, read_as: str) -> str | None:
    """text, written in one encoding and read in another; None where that is not possible or changes nothing."""
    try:
        data = text.encode(really) if really == "utf-8" or really in _WIDE else codecs.charmap_encode(text, "strict", _table(really)[0])[0]
    except UnicodeError:
        return None
    found = from_bytes(data, read_as)
    return None if found is None or found == text else found


def _through(text: str, read_as: str, really: str) -> str | None:
    """text through a chain. A character that the first encoding lacks stays as it is if the second lacks it too (it
    could not be written in it); if the second has it, the text never came through this chain."""
    data = to_bytes(text, read_as)
    if data is not None:
        return from_bytes(data, really)
    blocks = _BLOCKS.setdefault((read_as, really), {})
    for c in set(_NOT_ASCII.findall(text)):
        known = blocks.get(c)
        if known is None:
            known = to_bytes(c, read_as) is None and to_bytes(c, really) is not None
            _keep(blocks, c, known)
        if known:
            return None
    table, out = _table(read_as)[0], []
    for part in _NOT_ASCII_RUNS.split(text) if really not in _WIDE else [text]:
        if really not in _WIDE and part.isascii():  # the same in all of one byte a letter
            out.append(part)
            continue
        run = bytearray()
        for c in part:
            byte = table.get(ord(c))
            if byte is not None:
                run.append(byte)
                continue
            done = from_bytes(bytes(run), really)
            if done is None:
                return None
            out += [done, c]
            run = bytearray()
        done = from_bytes(bytes(run), really)
        if done is None:
            return None
        out.append(done)
    return "".join(out)


#: Characters that the first encoding of a chain lacks and the second has.
_BLOCKS: dict[tuple[str, str], dict[str, bool]] = {}
_NOT_ASCII_RUNS = re.compile("([^\x00-\x7f]+)")

#: Stretches: sentences, by line ends and by ASCII blanks after a sentence's end (also after an ideographic full stop as
#: Shift-JIS, EUC-JP and UTF-8 read as Latin show it).
_STRETCH = re.compile("[ \\n\\r](?:(?<=[.!?。].)[ \\n\\r]*|(?<=\x81B )|(?<=¡£ )|(?<=ã€‚ )|(?<=ã\x80\x82 )|(?<=[\\n\\r])[\\n\\r]*)", re.S)


def stretches(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each stretch of text."""
    found, begin = [], 0
    for gap in _STRETCH.finditer(text):
        if gap.start() > begin:
            found.append((begin, gap.start()))
        begin = gap.end()
    if begin < len(text):
        found.append((begin, len(text)))
    return found
