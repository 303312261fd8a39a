"""Readable text of raw messages, and its letters as arrays.

``readable`` undoes what hides words in a raw message: encoded headers, transfer
encodings, markup, entities. ``Letters`` turns a batch of texts into one array of
folded letters cut into passages, without a Python step per character.
"""

from __future__ import annotations

import base64
import binascii
import functools
import html
import unicodedata

import numpy as np
import regex

_ENCODED_WORD = regex.compile(r"=\?([\w.-]{1,40})\?([bBqQ])\?([^?\s]*)\?=(?:\s+(?==\?))?")
_ENCODING = regex.compile(r"^content-transfer-encoding:[ \t]*(base64|quoted-printable)", regex.I | regex.M)
_TYPE = regex.compile(r"^content-type:[ \t]*([\w-]+)/", regex.I | regex.M)
_CHARSET = regex.compile(r"charset=[\"']?([\w.-]+)", regex.I)
_BLANK = regex.compile(r"\n[ \t]*\n")
_BOUNDARY = regex.compile(r"\n--[^\s-][^\n]*")
_SEPARATOR = regex.compile(r"^--=?[^\s=-][^\s]{9,}[ \t]*$|\bboundary=\"?[^\s\";]{6,}\"?", regex.M | regex.I)
_CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_QUOTED = regex.compile(r"(?:=[0-9A-F]{2})+")
_TAG = regex.compile(r"<(/?)(\w{1,10})\b[^<>]{0,2000}>")
_BLOCKS = frozenset("p br div li ul ol tr td th table h1 h2 h3 h4 h5 h6 hr blockquote body html title head".split())
#: Lines of addresses, dates and numbers, and addresses anywhere. They are scored like all
#: else, but hold mostly names and so make no examples.
_ROUTING = regex.compile(
    r"^(?:(?:from|to|cc|bcc|sender|reply-to|return-path|received|date|sent|message-id|in-reply-to|references|mime-version|content-[a-z-]+"
    r"|von|gesendet|an|de|para|enviado|à|envoyé)[ \t]*:.*|from \S+@.*)\n(?:[ \t]+\S.*\n)*|[^\s<>]{1,100}@[\w-]{1,60}\.[\w.-]{1,60}",
    regex.M | regex.I,
)
#: Private code points around such stretches.
OPEN, CLOSE = "\ue000", "\ue001"
_NOT_BASE64 = regex.compile(r"[^A-Za-z0-9+/]+")
_HEADER = regex.compile(r"^(?=[A-Za-z][A-Za-z-]{1,30}: ?\S)", regex.M)


def _decode(raw: bytes, charset: str = "") -> str:
    for name in ("utf-8", charset, "cp1252"):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _strict(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""
    return "" if _CONTROL.search(text) else text


def _base64(body: str) -> bytes:
    packed = "".join(body.split())
    try:
        return base64.b64decode(packed + "=" * (-len(packed) % 4))
    except (binascii.Error, ValueError):  # broken: all that its whole groups say
        parts = [_NOT_BASE64.sub("", p) for p in packed.split("=")]
        return b"".join(base64.b64decode(p[: len(p) - (len(p) % 4 == 1)] + "=" * (-len(p) % 4 % 3)) for p in parts)


def _unquote(text: str) -> str:
    return _QUOTED.sub(lambda m: _decode(bytes.fromhex(m.group().replace("=", ""))), text.replace("=\n", ""))


def _word(m) -> str:
    charset, kind, body = m.groups()
    if kind in "bB":
        return _decode(_base64(body), charset)
    return _unquote(body.replace("_", " "))


def _tag(m) -> str:
    return "\n\n" if m.group(2).lower() in _BLOCKS else ""


def readable(text: str) -> str:
    """The words of a raw message, wherever they stand; never raises."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "=?" in text:
        text = _ENCODED_WORD.sub(_word, text)
    out, done = [], 0
    for m in _ENCODING.finditer(text):
        if m.start() < done:
            continue
        blank = _BLANK.search(text, m.end())
        if not blank:
            break
        end = _BOUNDARY.search(text, blank.end() - 1)
        stop = end.start() if end else len(text)
        head = text[max(0, text.rfind("\n--", 0, m.start()), text.rfind("\n\n", 0, m.start())) : blank.start()]
        body = text[blank.end() : stop]
        if m.group(1).lower() == "base64":
            kind, charset = _TYPE.search(head), _CHARSET.search(head)
            raw = _base64(body)
            if kind is None or kind.group(1).lower() == "text":
                body = _decode(raw, charset.group(1) if charset else "")
            else:  # other parts count if their bytes are text
                body = _strict(raw)
        else:
            body = _unquote(body)
        out += [text[done : m.start()], "\n\n", body, "\n\n"]
        done = stop
    text = _SEPARATOR.sub("\n\n", "".join([*out, text[done:]]))
    if "=" in text and _QUOTED.search(text):
        text = _unquote(text)
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "&" in text:
        text = html.unescape(text)
    return text


#: Letters that look like Latin ones (fixed values).
ALIKE = dict(zip("аеорсухіѕјкмтнвԁοαεινρτυκß", "aeopcyxisjkmthbdoaeivptyks")) | {"æ": "a", "œ": "o", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}
#: Signs that stand for letters next to letters, and those that do only between them.
BESIDE = dict(zip("013456789$@", "oieasgtbgsa"))
BETWEEN = dict(zip("!|+", "ilt"))
SENTENCE_END = ".!?…。！？"
LETTERS, BLANK, LINE, END = 27, 28, 29, 30  # classes from 1 to 26 are letters
LONGEST, STRIDE = 120, 60
GRAM = 4
#: Shorter passages that no stop ends are fragments.
FRAGMENT = 10
#: Code points beyond have no letters that look like Latin ones.
POINTS = 0x20000
_NAMED = regex.compile(r"(?:LATIN \w+|REGIONAL INDICATOR SYMBOL) LETTER ([A-Z])$")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, and the letters that signs stand for."""
    kind, beside, between = (np.zeros(POINTS, np.uint8) for _ in range(3))
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp).lower()
        base = ALIKE.get(c) or unicodedata.normalize("NFKD", c)[:1].lower()
        if "a" <= base <= "z":
            kind[cp] = ord(base) - 96
        elif c == "\n":
            kind[cp] = LINE
        elif chr(cp).isspace():
            kind[cp] = BLANK
        elif chr(cp) in SENTENCE_END:
            kind[cp] = END
    for cp in range(0x10000, POINTS):  # mathematical, enclosed and the like
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        named = _NAMED.search(unicodedata.name(chr(cp), ""))
        base = ALIKE.get(base) or (named.group(1).lower() if named else base)
        if "a" <= base <= "z":
            kind[cp] = ord(base) - 96
        elif base in BESIDE:
            beside[cp] = ord(BESIDE[base]) - 96
    for sign, letter in BESIDE.items():
        beside[ord(sign)] = ord(letter) - 96
    for sign, letter in BETWEEN.items():
        between[ord(sign)] = ord(letter) - 96
    return kind, beside, between


def _prepared(text: str) -> str:
    if OPEN in text or CLOSE in text:
        text = text.replace(OPEN, " ").replace(CLOSE, " ")
    return _HEADER.sub("\n\n", _ROUTING.sub(lambda m: f"\n\n{OPEN}{m.group()}{CLOSE}\n\n", text))


def _linked(short: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which passages go together with the one behind them: short ones, and those before
    a short one that has no other behind it. ``same``: both are of one group."""
    return short[:-1] & same | short[1:] & same & ~np.append(same[1:], False)


class Letters:
    """Passages of a batch of texts.

    ``stream`` has the letters 1 … 26, doubled letters once, all else left out;
    passage ``i`` is ``stream[start[i]:end[i]]`` and belongs to text ``text[i]``.
    Sentences, lines of headers and paragraphs are passages; long ones are taken in
    overlapping windows. Sentences of fewer than ``GRAM`` letters, and fragments that no
    stop ends of fewer than ``FRAGMENT``, are joined to the next passage of their
    paragraph, or else to the one before; passages that are still shorter than ``GRAM`` to
    the next or the one before of their text. So every letter is in a passage, but for texts of
    fewer than ``GRAM`` in all. ``example`` tells which passages may serve as examples:
    not those of address lines, nor fragments, which are mostly names.
    """

    def __init__(self, texts: list[str]):
        prepared = [_prepared(t) if t else "" for t in texts]
        whole = "\n\n".join([*prepared, ""])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum(np.array([len(p) + 2 for p in prepared], np.int64))
        inside = np.cumsum((points == ord(OPEN)).astype(np.int8) - (points == ord(CLOSE)).astype(np.int8), dtype=np.int8) > 0
        table, beside, between = _tables()
        points = np.where(points < POINTS, points, 0)
        kind = table[points]

        def shifted(a: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(a)
            if by > 0:
                out[by:] = a[:-by]
            else:
                out[:by] = a[-by:]
            return out

        letter = (kind > 0) & (kind < LETTERS)
        at = np.flatnonzero(~letter & ((beside[points] > 0) | (between[points] > 0)))
        if len(at):
            n = len(points)
            for _ in range(2):  # twice, for two signs in a row
                before, after = letter[np.maximum(at - 1, 0)] & (at > 0), letter[np.minimum(at + 1, n - 1)] & (at < n - 1)
                as_beside, as_between = (before | after) & (beside[points[at]] > 0), before & after & (between[points[at]] > 0)
                kind[at] = np.where(as_beside, beside[points[at]], np.where(as_between, between[points[at]], kind[at]))
                letter[at] |= as_beside | as_between

        # Ends: a stop before white space; a line without letters; a line that ends in a colon.
        space = (kind == BLANK) | (kind == LINE)
        ends = (kind == END) & shifted(space, -1)
        lines = np.flatnonzero(kind == LINE)
        if len(lines):
            count = np.cumsum(letter, dtype=np.int64)[lines]
            empty = np.diff(count, prepend=0) == 0
            ends[lines[empty]] = True
            ends[lines] |= points[np.maximum(lines - 1, 0)] == ord(":")
        keep = np.flatnonzero(letter)
        code, passage = kind[keep], np.cumsum(ends)[keep]
        if len(code):
            single = np.ones(len(code), bool)
            single[1:] = (code[1:] != code[:-1]) | (passage[1:] != passage[:-1])
            keep, code, passage = keep[single], code[single], passage[single]
        self.stream = code
        first = np.flatnonzero(np.diff(passage, prepend=-1)) if len(passage) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(passage)) if len(first) else first
        close = np.append(np.flatnonzero(ends), len(kind))[passage[first]]  # where each passage ends
        stop = np.append(kind, 0)[close] == END

        def join(linked: np.ndarray) -> None:
            nonlocal first, last, stop
            begins, finishes = np.append(True, ~linked), np.append(~linked, True)
            first, last, stop = first[begins], last[finishes], stop[finishes]

        if len(first) > 1:
            hard = np.append(ends & (kind != END), False)
            join(_linked(last - first < np.where(stop, GRAM, FRAGMENT), np.diff(np.cumsum(hard)[close] - hard[close]) == 0))
        if len(first) > 1:
            join(_linked(last - first < GRAM, np.diff(np.searchsorted(bounds, keep[first], side="right")) == 0))
        example = (stop | (last - first >= FRAGMENT)) & ~inside[keep[first]]
        long = last - first > LONGEST
        if long.any():
            pieces = [(np.arange(a, max(b - STRIDE, a + 1), STRIDE), b) for a, b in zip(first[long], last[long])]
            more = np.concatenate([p for p, _ in pieces])
            more_last = np.concatenate([np.minimum(p + LONGEST, b) for p, b in pieces])
            example = np.concatenate([example[~long], np.repeat(example[long], [len(p) for p, _ in pieces])])
            first, last = np.concatenate([first[~long], more]), np.concatenate([last[~long], more_last])
        enough = last - first >= GRAM
        self.start, self.end, self.example = first[enough], last[enough], example[enough]
        self.text = np.searchsorted(bounds, keep[self.start], side="right") if len(self.start) else np.zeros(0, np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, passage) of all runs of ``GRAM`` letters within passages."""
        sizes = np.maximum(self.end - self.start - GRAM + 1, 0)
        passage = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(passage)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.start[passage]
        rolled = np.zeros(max(len(self.stream) - GRAM + 1, 0), np.int32)
        for i in range(GRAM):
            rolled = rolled * 26 + (self.stream[i : i + len(rolled)].astype(np.int32) - 1)
        return rolled[at], passage

    def passage(self, i: int) -> bytes:
        return (self.stream[self.start[i] : self.end[i]] + 96).tobytes()

    def passages(self) -> list[bytes]:
        letters = (self.stream + 96).tobytes()
        return [letters[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def grams_of(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``Letters.grams`` for passages as ``Letters.passages`` gives them."""
    if not passages:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in passages], np.int64)
    stream = np.frombuffer(b"".join(passages), np.uint8).astype(np.int32) - 97
    start = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - GRAM + 1, 0)
    which = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + start[which]
    rolled = np.zeros(max(len(stream) - GRAM + 1, 0), np.int32)
    for i in range(GRAM):
        rolled = rolled * 26 + stream[i : i + len(rolled)]
    return rolled[at], which
