"""Sentence boundaries across languages and scripts.

Two passes.  The first counts, per language and over all documents, how the words before periods behave:
what follows them (a lower-case word, a digit, a capitalised word that is otherwise written small, a
capitalised word that never is), which words stand before single letters and numbers with a period, and
before dots of suspension.  From these counts log-likelihood ratios tell abbreviations (followed by
something that does not begin a sentence more often than periods usually are), collocations (a word that
keeps the number or letter behind it and its period inside the sentence, or ends it there) and sentence starters
(words that stand after sure ends more often than words do, and are also written small; where the ratio does not
decide, words that are otherwise written small).  The second pass classifies every possible boundary with them.

Marks of scripts without spaces, dandas and Thai gaps need no statistics; quotations need the colon before
them, what follows them, and whether they span sentences.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, latest_per_id
from kelpline.runtime import materialize

#: Keys below this share of a language's tokens are left out of the model, so it has at most a million keys a kind.
LEAST_SHARE = 1e-6
#: Dunning's ratio at which a word is judged to begin sentences more or less often than words do: one in two hundred by chance.
STARTER_RATIO = 7.88
ANY = "*"


@lru_cache(maxsize=1)
def _re():
    import regex

    wide = "。！？｡︒﹒﹖﹗．"
    return {
        "paragraph": regex.compile("\\n[^\\S\\n]*(?:\\n[^\\S\\n]*)+|\u2029"),
        "list": regex.compile(r"[^\S\n]*(?:[-•*–‣◦]|\d{1,3}[.)])[^\S\n]+(?=\S)"),
        "mark": regex.compile(
            rf"(?:[.!?…‥]+|[{wide}]+|[।॥؟۔։።]+)+(?:[…‥{wide}!?.]*)"
            rf"(?P<close>(?:[\"'”’»“‘)\]）】」』〉》›］]|[^\S\n]?»)*)"
            r"|(?<=[\p{Thai}--[0-9๐-๙฿]])(?P<thai>\s+)(?=[\p{Thai}--[0-9๐-๙฿]])",
            regex.V1,
        ),
        "wide": regex.compile(rf"[{wide}]"),
        "cjk": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
        "token": regex.compile(r"\S+"),
        "word": regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}\p{Cf}'’.\-]*"),
        "letters": regex.compile(r"(?:\p{L}\.-?)*\p{L}"),
        "number": regex.compile(r"\d+(?:[.,:]\d+)*"),
        "upper": regex.compile(r"[\p{Lu}\p{Lt}]"),
        "lower": regex.compile(r"\p{Ll}"),
        "hidden": regex.compile(r"\p{Cf}"),
        "open": regex.compile(r"[\"'“‘„«‚¿¡(\[（【「『《〈<#*_~—–-]+"),
    }


# -- blocks -----------------------------------------------------------------------------------------


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a list line) of the parts that no sentence crosses."""
    r = _re()
    out: list[tuple[int, int, bool]] = []
    at = 0
    for a, b in [(m.start(), m.end()) for m in r["paragraph"].finditer(text)] + [(len(text), len(text))]:
        begin, line = at, at
        while line < a:
            stop = text.find("\n", line, a)
            stop = a if stop < 0 else stop
            if r["list"].match(text, line, stop):
                if begin < line:
                    out.append((begin, line, False))
                out.append((line, stop, True))
                begin = stop
            line = stop + 1
        if begin < a:
            out.append((begin, a, False))
        at = b
    return out


def letter_case(part: str) -> str:
    """``cased``, ``lower``, ``upper`` (all letters alike) or ``none`` for scripts without case.

    Small letters are counted only where the capitals leave it open.
    """
    r = _re()
    up = len(r["upper"].findall(part))
    if up > 8 and 3 * up > len(part):
        return "upper" if len(r["lower"].findall(part)) / up < 0.11 else "cased"
    if up > 0.005 * len(part):
        return "cased" if up >= 3 or r["lower"].search(part) else "none"
    low = len(r["lower"].findall(part))
    if up + low < 3:
        return "none"
    return "lower" if up / (up + low) < 0.004 else "cased"


def plain(token: str) -> str:
    if token.isascii():
        return token.lower()
    return unicodedata.normalize("NFC", _re()["hidden"].sub("", token).lower())


def kind_of(word: str) -> str:
    """``letter`` for initials, ``number``, or ``word``."""
    r = _re()
    if r["number"].fullmatch(word):
        return "number"
    return "letter" if r["letters"].fullmatch(word) else "word"


def word_before(text: str, end: int, least: int) -> tuple[str, int]:
    """The word that ends at ``end`` and its start; at most its last 200 characters."""
    least = max(least, end - 200)
    part = text[least:end]
    if not part or part[-1].isspace():
        return "", end
    raw = part.rsplit(None, 1)[-1]
    m = None
    for m in _re()["word"].finditer(raw):  # noqa: B007  the last one
        pass
    return (m.group(), end - len(raw) + m.start()) if m and m.end() == len(raw) else ("", end)


def word_after(text: str, at: int, end: int) -> tuple[str, bool]:
    """The next word from ``at`` and whether an opening mark stands before it."""
    r = _re()
    m = r["open"].match(text, at, end)
    start = m.end() if m else at
    w = r["word"].match(text, start, end)
    return (w.group() if w else "", bool(m))


def _initial(word: str) -> bool:
    """A single letter with a period: part of a name or of an abbreviation."""
    return word.endswith(".") and kind_of(word.rstrip(".")) == "letter"


# -- first pass: counts -----------------------------------------------------------------------------


def count_text(text: str, lang: str | None, out: Counter) -> None:
    """Add the counts of a text's cased blocks: (language, kind, key, what) -> n.

    Words of letters alone, which most are, only enter the lists of bare and small words.
    """
    r = _re()
    lang = lang or ""
    bare: list[str] = []
    small: list[str] = []
    size = 0
    for a, b, _ in blocks(text):
        part = text[a:b]
        if letter_case(part) != "cased":
            continue
        tokens = part.split()
        size += len(tokens)
        begins = True
        for k, raw in enumerate(tokens):
            if raw.isalpha() and raw.isascii():
                low = raw.lower()
                bare.append(low)
                if low == raw and not begins:
                    small.append(low)
                begins = False
                continue
            m = r["word"].search(raw)
            if not m:
                continue
            dotted = m.group().endswith(".")
            word = m.group().rstrip(".")
            low = plain(word)
            dots = len(m.group()) - len(word)
            rest = raw[m.end() :]
            if not dotted:
                bare.append(low)
                if not begins and r["lower"].match(word):
                    small.append(low)
            if dotted or rest[:1] == "…":
                last = k + 1 == len(tokens)
                nxt, opened = ("", False) if last else word_after(tokens[k + 1], 0, len(tokens[k + 1]))
                if last:
                    what = "end"
                elif opened or not nxt:
                    what = "open"
                elif r["lower"].match(nxt):
                    what = "lower"
                elif _initial(nxt):
                    what = "initial"
                elif r["upper"].match(nxt):
                    what = "U" + plain(nxt.rstrip("."))
                else:
                    what = "digit" if nxt[0].isdigit() else "other"
                if dots > 1 or rest[:1] == "…":
                    key = ("dots", low)
                elif (kind := kind_of(word)) == "word":
                    key = ("period", low)
                else:
                    p = r["word"].search(tokens[k - 1]) if k else None
                    key = (kind, plain(p.group()) if p else "")
                out[lang, key[0], key[1], what] += 1
            begins = dotted or bool(rest and r["mark"].search(rest))
    if size:
        out[lang, "size", "", ""] += size
    for kind, words in (("bare", bare), ("small", small)):
        for w, n in Counter(words).items():
            out[lang, kind, w, ""] += n


@dataclass
class Behaviour:
    """How often a period after something ends a sentence (``final``) and how often it does not."""

    final: int = 0
    inner: int = 0

    @property
    def share(self) -> float:
        return self.final / max(1, self.final + self.inner)


def log_likelihood(k: int, n: int, p: float) -> float:
    """Dunning's ratio for ``k`` of ``n`` against a rate of ``p``."""
    p = min(max(p, 1e-9), 1 - 1e-9)
    q = min(max(k / n, 1e-9), 1 - 1e-9)
    return 2 * (k * math.log(q / p) + (n - k) * math.log((1 - q) / (1 - p)))


@dataclass
class SentenceModel:
    """Per language: words written small, their commonest ones, abbreviations, collocations, and words that
    begin sentences more (True) or less (False) often than words do."""

    small: dict[str, frozenset] = field(default_factory=dict)
    common: dict[str, frozenset] = field(default_factory=dict)
    abbreviations: dict[str, dict[str, Behaviour]] = field(default_factory=dict)
    letters: dict[str, dict[str, Behaviour]] = field(default_factory=dict)
    numbers: dict[str, dict[str, Behaviour]] = field(default_factory=dict)
    dots: dict[str, dict[str, Behaviour]] = field(default_factory=dict)
    starters: dict[str, dict[str, bool]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.vote: dict[str, tuple] = {}
        self.dotted: frozenset = frozenset()

    def index(self) -> None:
        """Languages by common word, for :meth:`language`, and the abbreviations of any language."""
        votes: dict[str, list] = defaultdict(list)
        for lang, words in self.common.items():
            for w in words:
                votes[w].append(lang)
        self.vote = {w: tuple(langs) for w, langs in votes.items()}
        self.dotted = frozenset(w for found in self.abbreviations.values() for w in found)

    def begins(self, lang: str, word: str) -> bool:
        """Can a capitalised word begin a sentence?  The ratio decides; where it does not, being otherwise written small."""
        told = self.starters.get(lang, {}).get(word)
        return word in self.small.get(lang, ()) if told is None else told

    def language(self, part: str, label: str) -> str:
        """The language whose commonest words a part holds most of; the given one if that is undecided."""
        hits: Counter = Counter()
        vote = self.vote
        for w in part.lower().split():
            if w in vote:
                for lang in vote[w]:
                    hits[lang] += 1
        best, most = label, hits[label]
        for lang, n in sorted(hits.items()):
            if lang != label and n > most * 1.3 + 1:
                best, most = lang, n
        return best


def learn(rows: list[tuple[str, str, str, str, int]]) -> SentenceModel:
    """The model from the summed counts (language, kind, key, what, n); texts without a language have ''.

    What a language's words do is judged by its own small words; over all languages these judgements are
    summed.
    """
    counts: dict[str, dict[str, dict[str, Counter]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(Counter)))
    every: dict[str, Counter] = {"small": Counter(), "bare": Counter()}
    for lang, kind, key, what, n in rows:
        counts[lang][kind][key][what] += n
        if kind in every:
            every[kind][key] += n
    model = SentenceModel()
    model.small[ANY] = frozenset(w for w, n in every["small"].items() if n >= 2)
    kinds = ("period", "letter", "number", "dots")
    judged: dict[str, dict[str, dict[str, Behaviour]]] = {ANY: {k: defaultdict(Behaviour) for k in kinds}}
    for lang in sorted(counts):
        own = {w: c[""] for w, c in counts[lang]["small"].items() if c[""] >= 2}
        small = own if lang else model.small[ANY]
        if lang:
            model.small[lang] = frozenset(own)
            model.common[lang] = frozenset(sorted(own, key=lambda w: (-own[w], w))[:60])
        judged[lang] = {k: {} for k in kinds}
        for kind in kinds:
            for key, whats in counts[lang][kind].items():
                b = Behaviour()
                for what, n in whats.items():
                    if what in ("end", "open") or (what[0] == "U" and what[1:] in small):
                        b.final += n
                    elif what != "other":
                        b.inner += n
                judged[lang][kind][key] = b
                total = judged[ANY][kind][key]
                total.final += b.final
                total.inner += b.inner
    for lang in [ANY, *[x for x in sorted(counts) if x]]:
        bare = every["bare"] if lang == ANY else {w: c[""] for w, c in counts[lang]["bare"].items()}
        period = judged[lang]["period"]
        # ordinary words also stand without a period; their rate of inner followers is the base rate
        ordinary = [b for w, b in period.items() if bare.get(w, 0) > 2 * (b.final + b.inner)]
        inner, total = sum(b.inner for b in ordinary), sum(b.inner + b.final for b in ordinary)
        base = (inner + 1) / (total + 10)
        found = {}
        for w, b in period.items():
            n = b.final + b.inner
            if n >= 2 and b.inner / n > max(0.4, base) and log_likelihood(b.inner, n, base) >= 7.88 and bare.get(w, 0) <= 2 * n:
                # a rare one must be one over all languages, too: quoted passages in other languages mislead
                if lang == ANY or n >= 20 or w in model.abbreviations[ANY]:
                    found[w] = b
        model.abbreviations[lang] = found
        for table, kind, least in ((model.letters, "letter", 4), (model.numbers, "number", 4), (model.dots, "dots", 3)):
            table[lang] = {w: b for w, b in judged[lang][kind].items() if b.final + b.inner >= least}
    model.index()
    return model


# -- second pass: boundaries ------------------------------------------------------------------------

_PAIRS = {"”": "“", "’": "‘", "»": "«", "“": "„", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【", "›": "‹", "》": "《", "〉": "〈", "‘": "‚"}
_QUOTES = frozenset("\"'”’»“‘」』›")


def _closing(text: str, at: int, begin: int, close: str) -> str:
    """The leading part of ``close`` that closes something opened in the block; straight quotes by parity."""
    keep = 0
    for k, c in enumerate(close):
        if c.isspace():
            continue
        before = text[begin : at + k]
        if c in "\"'":
            if c == '"' and before.count(c) % 2 == 0:
                break
        elif c in _PAIRS:
            opener = _PAIRS[c]
            shut = before.count(c)
            if c == "”":  # some write both sides alike
                if before.count("“") + before.count("„") <= shut and shut % 2 == 0:
                    break
            elif before.count(opener) <= shut:
                break
        keep = k + 1
    return close[:keep]


def _opened(text: str, at: int, begin: int, closer: str) -> int:
    opener = closer if closer in "\"'" else _PAIRS.get(closer, closer)
    p = text.rfind(opener, begin, at)
    if p < 0 and closer == "”":
        p = max(text.rfind("„", begin, at), text.rfind("”", begin, at))
    return p


class _Language:
    """The language of a text, found when it is first asked for: most periods do not need it."""

    __slots__ = ("model", "text", "label", "found")

    def __init__(self, model: SentenceModel, text: str, label: str):
        self.model, self.text, self.label, self.found = model, text, label, None

    @property
    def name(self) -> str:
        if self.found is None:
            self.found = self.model.language(self.text, self.label)
        return self.found


class _Part:
    """The same for a block of a text; short ones have the text's."""

    __slots__ = ("whole", "a", "b", "found")

    def __init__(self, whole: _Language, a: int, b: int):
        self.whole, self.a, self.b, self.found = whole, a, b, None

    @property
    def name(self) -> str:
        if self.found is None:
            w = self.whole
            self.found = w.model.language(w.text[self.a : self.b], w.name) if self.b - self.a > 60 else w.name
        return self.found


class Splitter:
    def __init__(self, model: SentenceModel):
        self.model = model

    def spans(self, text: str | None, label: str | None) -> list[tuple[int, int]]:
        """(start, end) of every sentence of a text, in code points."""
        if not text or text.isspace():
            return []
        language = _Language(self.model, text, label if label in self.model.small else ANY)
        out: list[tuple[int, int]] = []
        for a, b, listed in blocks(text):
            cuts = [] if listed else self.cuts(text, a, b, language)
            start = a
            for c in [*cuts, b]:
                s, e = start, c
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if s < e:
                    out.append((s, e))
                start = c
        return out

    def cuts(self, text: str, a: int, b: int, language: _Language) -> list[int]:
        r = _re()
        case = letter_case(text[a:b])
        lang = _Part(language, a, b)
        out: list[int] = []
        start = a
        for m in r["mark"].finditer(text, a, b):
            if m.group("thai"):
                out.append(m.start())
                start = m.end()
                continue
            close = _closing(text, m.start("close"), a, m.group("close"))
            end = m.start("close") + len(close)
            marks = text[m.start() : m.start("close")]
            if not text[start : m.start()].strip():
                continue  # nothing but marks so far
            if self.ends(text, a, b, start, m.start(), end, marks, close, case, lang):
                out.append(end)
                start = end
        return out

    def _nearby(self, text: str, lo: int, hi: int, lang: str) -> str:
        return self.model.language(text[lo:hi], lang)

    @staticmethod
    def _lookup(table: dict, lang: str, key: str) -> Behaviour | None:
        """Behaviour in the language if it was seen often there, else over all languages."""
        own = table.get(lang, {}).get(key)
        return own if own and own.final + own.inner >= 20 else table.get(ANY, {}).get(key, own)

    def _abbreviation(self, lang: str, word: str) -> Behaviour | None:
        """A foreign abbreviation counts unless the word is an ordinary one of the language."""
        own = self.model.abbreviations.get(lang, {})
        if word in own:
            return own[word]
        return None if word in self.model.small.get(lang, ()) else self.model.abbreviations.get(ANY, {}).get(word)

    def ends(
        self, text: str, a: int, b: int, start: int, at: int, end: int, marks: str, close: str, case: str, lang: _Part
    ) -> bool:
        r = _re()
        n = end
        while n < b and text[n].isspace():
            n += 1
        if n >= b:
            return True
        gap, following = n - end, text[n]
        wide = bool(r["wide"].search(marks)) or (marks[0] in "…‥" and at > a and bool(r["cjk"].match(text[at - 1])))
        word, opened = word_after(text, n, b)
        small = bool(word) and bool(r["lower"].match(word))
        large = bool(word) and bool(r["upper"].match(word))
        quote = next((c for c in reversed(close) if c in _QUOTES), "")
        if quote:
            return self._after_quote(text, a, start, end - len(close), quote, gap, following, small, large, opened, case)
        if close and close[-1] in ")）]】":  # a parenthesis ends a sentence if it began one
            p = _opened(text, end - len(close), a, close[-1])
            if p >= 0 and text[start:p].strip() and p > start:
                return False
            return not (small and case == "cased")
        if wide or marks[0] in "।॥؟۔։።":
            return True
        if gap == 0 and not opened:
            return self._without_gap(text, a, at, word, marks, large, small, case, lang)
        if gap == 0 and marks == "." and following not in "«“„¿¡\"「（(":
            return False
        if set(marks) <= {".", "…", "‥"} and (len(marks) > 1 or marks in "…‥"):
            if small and case == "cased":
                return False
            if large and case == "cased" or opened:
                return True
            seen = self._lookup(self.model.dots, lang.name, plain(word_before(text, at, a)[0]))
            return seen is None or seen.share >= 0.5
        if marks != ".":
            return not (small and case == "cased" and marks[0] not in "!?")
        return self._after_period(text, a, at, word, opened, small, large, case, lang)

    def _after_quote(
        self, text: str, a: int, start: int, at: int, quote: str, gap: int, following: str, small: bool, large: bool, opened: bool, case: str
    ) -> bool:
        """Does the mark before a closing quotation mark end the sentence?"""
        r = _re()
        p = _opened(text, at, a, quote)
        if following in ",;:，、；：—–-)":
            return False
        if p >= 0 and p < start:
            return True  # the quotation began before this sentence
        introduced = p > a and text[a:p].rstrip()[-1:] in (":", "：")
        if small and case == "cased":
            return False
        if r["cjk"].match(following) and gap == 0:
            return introduced and quote != "」"
        if large and case == "cased" or opened:
            return True
        if r["cjk"].match(following):
            return True
        return introduced

    def _without_gap(self, text: str, a: int, at: int, word: str, marks: str, large: bool, small: bool, case: str, lang: _Part) -> bool:
        """A mark with the next word right behind it: a lost space, or the inside of a name or number."""
        r = _re()
        if not word:
            return marks[0] in "!?" and not text[at + len(marks)].isalnum()
        before, s = word_before(text, at, a)
        if r["cjk"].match(word) and (not before or not before[-1].isdigit()):
            return True
        if not before:
            return marks[0] in "!?" and (large or case != "cased")
        if marks[0] in "!?":
            return large or case != "cased"
        core = before.rstrip(".")
        if len(core) < 2 or "." in core or not core.isalpha():
            return large and case == "cased" and not core[-1:].isdigit() and len(marks) > 1
        nxt = word.split(".")[0]
        if case == "cased":
            if not large or not r["lower"].match(core[-1]):
                return False
            return not (nxt.isupper() and len(nxt) > 1)
        if len(marks) > 1:
            return True
        known, dotted = self.model.small.get(lang.name, frozenset()), self.model.abbreviations.get(lang.name, {})
        return len(core) > 2 and plain(core) in known and (plain(nxt) in known or plain(nxt) in dotted)

    def _after_period(
        self, text: str, a: int, at: int, word: str, opened: bool, small: bool, large: bool, case: str, part: _Part
    ) -> bool:
        before, s = word_before(text, at, a)
        if not before:
            return not (small and case == "cased")
        kind = kind_of(before)
        if kind == "word" and "." not in before and plain(before) not in self.model.dotted:
            return not (small and case == "cased")  # an abbreviation of no language
        lang = part.name
        if lang != ANY:
            lang = self._nearby(text, max(a, at - 90), at + 60, lang)
        follower = word.rstrip(".")
        known = self.model.begins(lang, plain(follower)) and not follower.isdigit() and not _initial(word)
        if kind == "word":
            seen = self._abbreviation(lang, plain(before))
            if seen is None and word[:1].isdigit() and plain(before) in self.model.abbreviations.get(ANY, {}):
                return False
            inside = "." in before
            if seen is None and not inside:
                if small and case == "cased":
                    return False
                return True
            share = seen.share if seen else 0.0
            if case == "cased":
                if small:
                    return False
                if opened:
                    return share >= 0.5
                return large and known
            return share >= 0.5
        previous, _ = word_before(text, _skip_back(text, s, a), a)
        table = self.model.numbers if kind == "number" else self.model.letters
        key = plain(previous if not _dot_follows(text, s, previous, a) else previous + ".")
        seen = self._lookup(table, lang, key)
        n = seen.final + seen.inner if seen else 0
        if n and seen.share < 0.1 and log_likelihood(seen.inner, n, 0.3) >= 7.88:
            return False  # a collocation: what stands before keeps the number or letter inside
        if case == "cased":
            if small:
                return False
            if known and large:
                return True
            if opened:
                return seen.share >= 0.5 if seen else kind == "number"
            if large:
                return seen.share >= 0.5 if seen else kind == "number"
            return kind == "number" and not word[:1].isdigit() or bool(seen and seen.share >= 0.5)
        if seen:
            return seen.share >= 0.5
        return kind == "number" or (known and case in ("lower", "upper")) or case == "none" and kind == "number"


def _skip_back(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    if at > least and text[at - 1] == ".":
        at -= 1
    return at


def _dot_follows(text: str, at: int, word: str, least: int) -> bool:
    while at > least and text[at - 1].isspace():
        at -= 1
    return bool(word) and at > least and text[at - 1] == "."


# -- the operator -----------------------------------------------------------------------------------


def learn_sentences(df: DataFrame, text_col: str, lang_col: str | None = None) -> SentenceModel:
    """Count over all texts and learn; the counts are summed per partition before they are shuffled."""
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)
    rows = df.select(F.col(text_col).alias("text"), lang.alias("lang")).where(F.length("text") > 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: Counter = Counter()
            for text, lang in zip(batch["text"], batch["lang"]):
                count_text(text, lang if isinstance(lang, str) and lang else None, out)
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["lang", "kind", "key", "what", "n"])

    counted = rows.mapInPandas(count, "lang string, kind string, key string, what string, n long")
    counted = materialize(counted.groupBy("lang", "kind", "key", "what").agg(F.sum("n").alias("n")), "counts")
    kept = judged_counts(counted)
    model = learn([tuple(r) for r in kept.toLocalIterator()])
    for lang, word, begins in starter_words(counted, model).toLocalIterator():
        model.starters.setdefault(lang, {})[word] = begins
    return model


def starter_words(counted: DataFrame, model: SentenceModel, least: float = STARTER_RATIO) -> DataFrame:
    """(lang, word, begins): words for which Dunning's ratio tells how often they stand after sure ends of sentences.

    A sure end is a period after a word that is no abbreviation of any language.  Of n occurrences of a word k
    stand there; among all words the share is that of the ends in the language's tokens.  begins is true for words whose share
    is greater and that are also written small, false for those whose share is smaller; words with a ratio below ``least``
    are not in the table.  Languages
    are summed as ANY.  Only words beyond ``LEAST_SHARE`` of their language's tokens can reach the ratio or are kept.
    """
    spark = counted.sparkSession
    dotted = spark.createDataFrame([(w,) for w in sorted(model.dotted)], "key string")
    sure = counted.where("kind = 'period'").join(F.broadcast(dotted), "key", "left_anti")
    after = sure.where(F.col("what").startswith("U")).select("lang", F.expr("substring(what, 2)").alias("word"), F.col("n").alias("k"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    seen = counted.where("kind IN ('bare', 'small')").select(
        "lang", F.col("key").alias("word"), F.lit(0).cast("long").alias("k"), F.when(F.col("kind") == "bare", F.col("n")).otherwise(0).alias("n"),
        F.when(F.col("kind") == "small", F.col("n")).otherwise(0).alias("s"),
    )
    both = after.unionByName(seen)
    both = both.where("lang <> ''").unionByName(both.withColumn("lang", F.lit(ANY)))
    words = both.groupBy("lang", "word").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n >= k AND n > 0")
    ends = sure.select("lang", F.col("n").alias("ends"), F.lit(0).cast("long").alias("size"))
    size = counted.where("kind = 'size'").select("lang", F.lit(0).cast("long").alias("ends"), F.col("n").alias("size"))
    base = ends.unionByName(size)
    base = base.where("lang <> ''").unionByName(base.withColumn("lang", F.lit(ANY)))
    base = base.groupBy("lang").agg((F.sum("ends") / F.nullif(F.sum("size"), F.lit(0))).alias("p"), (F.sum("size") * LEAST_SHARE).alias("least"))
    rows = words.join(F.broadcast(base), "lang").where("p > 0 AND p < 1 AND n >= least").withColumn("q", F.col("k") / F.nullif("n", F.lit(0)))
    part = "CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({q} / nullif({p}, 0)) END"
    ratio = F.expr("2 * (" + part.format(k="k", q="q", p="p") + " + " + part.format(k="(n - k)", q="(1 - q)", p="(1 - p)") + ")")
    # what is never written small may be a name, which begins sentences, too, and also follows titles
    return rows.where(ratio >= least).where("q < p OR s > 0").select("lang", "word", (F.col("q") > F.col("p")).alias("begins"))


def judged_counts(counted: DataFrame) -> DataFrame:
    """Counts (lang, kind, key, what, n) with capitalised followers judged: final if they are otherwise small.

    A follower U<word> counts as ``end`` if the word is written small at least twice in its language (over all
    languages for texts without one), else as ``initial``, that is, inside a sentence.  Only then is the model
    bounded: keys whose total is below ``LEAST_SHARE`` of the language's tokens are left out whole.
    """
    small = counted.where("kind = 'small'")
    own = small.where("lang <> '' AND n >= 2").select("lang", F.col("key").alias("_word"))
    every = small.groupBy(F.col("key").alias("_word")).agg(F.sum("n").alias("n")).where("n >= 2").select(F.lit("").alias("lang"), "_word")
    known = own.unionByName(every).withColumn("_small", F.lit(True))
    capital = F.col("what").startswith("U") & F.col("kind").isin("period", "letter", "number", "dots")
    upper = counted.where(capital).withColumn("_word", F.expr("substring(what, 2)"))
    upper = upper.join(known, ["lang", "_word"], "left").withColumn("what", F.when(F.col("_small"), "end").otherwise("initial"))
    rows = counted.where(~capital).unionByName(upper.select(*counted.columns))
    rows = rows.groupBy("lang", "kind", "key", "what").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "kind", "key"))
    size = counted.where("kind = 'size'").select("lang", (F.col("n") * LEAST_SHARE).alias("_least"))
    rows = rows.withColumn("_total", total).join(F.broadcast(size), "lang")
    return rows.where(F.col("_total") >= F.col("_least")).select(*counted.columns)


def split_sentences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str | None = None,
    model: SentenceModel | None = None,
    order: list[str] | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """(``id_col``, sentence_pos, start_pos, end_pos, sentence): every sentence of every text, in order.

    Positions count code points from 0; ``text[start_pos:end_pos]`` is the sentence, without white space
    around it, with its closing marks; between sentences there is nothing but white space.  Null, empty
    and blank texts have none; null languages are allowed.  Repeated ids count once (the greatest by
    ``order``, then text) unless ``unique_ids`` states that there are none; null ids are left out.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    check_columns(df, id_col, text_col, *([lang_col] if lang_col else []))
    model = learn_sentences(df, text_col, lang_col) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"), *(order or []))
    if unique_ids:
        rows = rows.where(F.col("_id").isNotNull())
    else:
        rows = latest_per_id(rows, "_id", ["_text", "_lang"], order)

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int>>")
    def spans(texts: pd.Series, langs: pd.Series) -> pd.Series:
        s = Splitter(sent.value)
        return pd.Series(
            [[{"start_pos": x, "end_pos": y} for x, y in s.spans(t, g if isinstance(g, str) else None)] for t, g in zip(texts, langs)],
            dtype=object,
        )

    found = rows.where(F.length("_text") > 0).select(
        "_id", "_text", F.posexplode(spans("_text", "_lang")).alias("sentence_pos", "s")
    )
    return found.select(
        F.col("_id").alias(id_col),
        "sentence_pos",
        "s.start_pos",
        "s.end_pos",
        F.expr("substring(_text, s.start_pos + 1, s.end_pos - s.start_pos)").alias("sentence"),
    )


__all__ = ["Behaviour", "SentenceModel", "Splitter", "learn", "learn_sentences", "split_sentences"]
