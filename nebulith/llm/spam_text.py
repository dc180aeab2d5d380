"""Redundancy and list measures of one text, without Spark."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans({"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ι": "i", "ρ": "p", "κ": "k", "τ": "t"})
_HIDDEN = re.compile("[​‌‍⁠﻿­]")
_ODD = re.compile("[" + "".join(map(chr, LOOKALIKES)) + _HIDDEN.pattern[1:])
_URL = re.compile(r"(?:https?://|www\.)[^\s<>|\])\"']+", re.I)
_MARKUP = re.compile(r"<a\s+href=|</a>|[<>\[\]()\"]", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_LOG = re.compile(r"^\s*(?:\[[^\]]*\d[^\]]*\]|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|\d{4}-\d\d-\d\d[ T])")
_SETTING = re.compile(r"^\s*[\w.\-]+\s*[=:]\s*\S+(?:\s+\S+)?\s*$")
_NUMBER_ROW = re.compile(r"^\s*[+\-\d.eE]+(?:\s*[,;\t|]\s*|\s+)[+\-\d.eE,;\t |]+$")
_TAG = re.compile(r"^(?:#[^\s#]+|tag:\S+|[^\s>]+(?:>[^\s>]+){1,})$", re.I)
_PATH_ITEM = re.compile(r"\w[\w '\-]*>\s?\w[\w '\-]*>\s?\w+")
_SKU = re.compile(r"\bSKU-\d+\b|(?<![\w.])[$€£]?\d+[.,]\d\d(?![\w.])", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_ENDS = re.compile(r"[.!?][\"')\]]*$")
BLOCK_CHARS = 512  # characters compressed at once


def fold(text: str) -> str:
    """Without hidden characters, compatibility forms and look-alike letters."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _HIDDEN.sub("", text).translate(LOOKALIKES) if _ODD.search(text) else text


def is_data(line: str) -> bool:
    """Lines of logs, settings and tables of numbers."""
    return bool(_LOG.match(line) or _SETTING.match(line) and "://" not in line and not line.lower().startswith("tag:") or _NUMBER_ROW.match(line))


def _cut(part: str) -> Iterator[str]:
    if len(part) <= BLOCK_CHARS:
        yield part
        return
    words, n = [], 0
    for w in part.split():
        if words and n + len(w) > BLOCK_CHARS:
            yield " ".join(words)
            words, n = [], 0
        words.append(w)
        n += len(w) + 1
    if words:
        yield " ".join(words)


def page_blocks(text: str, sentences_only: bool = False) -> tuple[int, list[tuple[int, int, float, bool, float]]]:
    """(words in lines of data, blocks), a block being (bytes, words, compressed / raw, finished, share of digits).

    A block holds up to BLOCK_CHARS of successive sentences or, for itself, of successive text that ends without a full stop, question
    or exclamation mark after at least four words: its density of sentence ends is 0. Addresses are masked before compression,
    and digits in unfinished text, for they hide how alike the entries of a list are; numbers tell sentences of a report apart.
    ``sentences_only`` leaves out unfinished blocks.
    """
    data, out, held, chars, kind = 0, [], [], 0, None

    def close() -> None:
        nonlocal held, chars
        if held and (kind or not sentences_only):
            s = "\n".join(held)
            raw = s.lower().encode("utf-8", "replace")
            digits = 1 - len(raw.translate(None, b"0123456789")) / len(raw)
            if not kind:
                raw = raw.translate(_DIGITS)
            out.append((len(raw), len(s.split()), (len(zlib.compress(raw, 6)) - 11) / len(raw), kind, digits))
        held, chars = [], 0

    for line in fold(text).splitlines():
        if not line.strip():
            continue
        if is_data(line):
            data += len(line.split())
            continue
        for part in _SENTENCE_END.split(line):
            part = part.strip()
            if not part:
                continue
            finished = bool(_ENDS.search(part)) and len(part.split()) >= 4
            if "//" in part or "w." in part or "W." in part:
                part = _URL.sub("u://", part)
            for piece in _cut(part):
                if finished != kind or chars + len(piece) > BLOCK_CHARS:
                    close()
                kind = finished
                held.append(piece)
                chars += len(piece) + 1
    close()
    return data, out


def _segments(text: str):
    """(words of the segment, kind): sentences and runs of unfinished lines; kind is prose, list or data."""
    run: list[str] = []
    for line in text.splitlines():
        if not line.strip():
            if run:
                yield "\n".join(run), False
                run = []
            continue
        if is_data(line):
            if run:
                yield "\n".join(run), False
                run = []
            yield line, None
            continue
        for part in _SENTENCE_END.split(line):
            if not part.strip():
                continue
            ends = _ENDS.search(part.rstrip())
            if ends and (not _URL.search(part.rstrip().split()[-1]) or len(_URL.sub(" ", part).split()) >= 4):
                if run:
                    yield "\n".join(run), False
                    run = []
                yield part, True
            else:
                run.append(part)
    if run:
        yield "\n".join(run), False


def list_words(text: str, sentences: bool = True) -> tuple[int, int]:
    """(words in keyword, link, product or tag lists, all words). sentences: whether finished sentences can be keyword lists too."""
    text = fold(text)
    parts = [(s, ended, s.split()) for s, ended in _segments(text)]
    total = sum(len(w) for _, _, w in parts)
    if not total:
        return 0, 0
    low = {i: [x.lower() for x in _WORD.findall(_URL.sub(" ", s))] for i, (s, e, _) in enumerate(parts) if e is not None}
    # A keyword stands beside many different words, a word of a template beside the same ones. So a word counts as
    # often as it has different neighbours on its richer side.
    before, after, counts = defaultdict(set), defaultdict(set), Counter()
    for i, ws in low.items():
        counts.update(ws)
        for u, v in zip(["", *ws], [*ws, ""]):
            if u != v:
                before[v].add(u)
                after[u].add(v)
    often = max(3.0, 0.025 * sum(counts.values()))
    keyword = {w for w, n in counts.items() if n >= often and max(len(before[w]), len(after[w])) >= 3}
    listed = 0
    for i, (s, ended, words) in enumerate(parts):
        if ended is None:
            continue
        urls = _URL.findall(s)
        plain = _MARKUP.sub(" ", _URL.sub(" ", s)).split()
        tags = sum(1 for w in words if _TAG.match(w.strip(",;|")) and not _URL.search(w))
        priced = len(_SKU.findall(s))
        items = len(_PATH_ITEM.findall(s))
        ws = low[i]
        if urls and not (ended and len(plain) >= 4):
            text_words = [w for w in plain if _WORD.search(w)]
            if len(text_words) <= 5 * len(urls):
                listed += len(words)
                continue
        if tags >= 0.6 * len(words) or priced >= 0.3 * len(words) or items >= 2 and items * 3 >= 0.5 * len(words):
            listed += len(words)
            continue
        if not ws:
            continue
        unique = len(set(ws)) / len(ws)
        repeated = sum(1 for w in ws if w in keyword) / len(ws)
        if ended:
            if sentences and len(ws) >= 2 and (unique < 0.72 and repeated > 0.4 or repeated >= 0.45):
                listed += len(words)
        elif len(ws) >= 10 and unique < 0.62 or repeated >= 0.7 and len(ws) >= 2:
            listed += len(words)
    return listed, total
