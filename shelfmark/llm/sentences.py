"""Sentences of texts in many languages and scripts.

A text is laid out in lines first: headings, list items, log and dump lines on lines of their own are units, and what
runs on over several lines is one block. In a block, quotations and brackets are paired, and every end mark outside
them (for Thai: every gap) is a candidate boundary. A maximum-entropy model over the neighbouring tokens, their case,
length, digits and script decides every candidate. It is trained on a bounded sample of the corpus itself: candidates
whose surroundings settle them (word lists and rules serve only there, as labels) and the ends of blocks before the
beginning of the next one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread
from .survivors import WHITE

#: Marks that end a sentence, by kind; opening and closing marks in pairs.
STOPS = ".!?"
FULL = "。！？｡．"
OTHERS = "…‥।॥؟۔!?！？՞։።፧"
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›", "〈": "〉", "‘": "’", "‚": "‘", "［": "］"}
CLOSERS = set(PAIRS.values()) | {'"', "”"}
QUOTE_CLOSERS = set('"”“»」』’‘›')
ENDS = set(STOPS + FULL + OTHERS)

#: Fixed values, for labels only: abbreviations that stand before something else, so never at an end (lower case, without the last period).
NEVER_LAST = set(
    # English
    "mr mrs ms dr prof st rev hon gen col capt lt sgt no nos vol vols fig figs sec secs ch pp p art approx e.g i.e vs cf min max incl excl dept est ed eds "
    # Italian
    "sig sig.ra sigg dott dott.ssa ing avv arch n nn pag pagg tav tavv ca es v cfr fasc "
    # German
    "hr fr frl nr bl bd abb abs kap s z.b d.h u.a bzw ca vgl evtl vermutl ggf ungef st dipl inkl exkl tel str zz zzt "
    # French
    "m mm mme mlle mlles mgr pl env ex chap t app av "
    # Spanish
    "sr sra srta dr dra dña d núm pág págs aprox ej lám cap avda "
    # Russian
    "г-н г-жа гр д-р проф рис стр ок см т.е напр ул им акад инж прим гл "
    # Greek
    "κ κα κος δρ π.χ σελ περ αρ κεφ εικ βλ "
    # Hindi, Arabic
    "डॉ श्री प्रो सं पृ د أ م ص ش"
    .split()
)
#: Fixed values, for labels only: German months after an ordinal number.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Fixed values, for labels only: German words before an ordinal number.
BEFORE_ORDINAL = set("am im vom zum zur beim ab bis seit der den dem des die das jeder jeden jedem".split())
#: Fixed values, for labels only: what goes on with the sentence after a quotation, where case can't tell.
GOES_ON = re.compile(r"(?:と|って|という|など|[她他我你它]们?[说問问道答写喊]|的|说道|라고|고 |하고)")

SPACE = re.compile(f"[{WHITE}]+")
NOT_SPACE = re.compile(f"[^{WHITE}]")
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
LOG_LINE = re.compile(r"\s*\[?\d{4}[-/.]\d\d?[-/.]\d\d?[T ,]+\d\d?:\d\d")
BULLET = re.compile(rf"[{WHITE}]*(?:[-*•–—·◦▪‣+]|\d{{1,3}}[.)]|[^\W\d_]\)|\(\w{{1,3}}\))[{WHITE}]+(?=[^{WHITE}])")
NUMBERED = re.compile(rf"[{WHITE}]*(\d{{1,3}})[.)]")
HEX = re.compile(r"[0-9A-Fa-f]+:?$")
HEX_FIRST = re.compile(r"[0-9A-Fa-f]+:?\s")
THAI = re.compile("[฀-๿]")
WORD = re.compile(r"[^\W\d_]+")
GAPS = " \u00a0\u202f\u2009"  # between words and the marks set off from them
GREEK_QUESTION = ";\u037e"
MARKS = re.compile(rf"[{re.escape(STOPS + FULL + OTHERS + GREEK_QUESTION)}]+")
MARKS_OR_SPACES = re.compile(rf"{MARKS.pattern}| +")
OTHER_SPACE = re.compile(rf"(?! )[{WHITE}]")
PAIRED = re.compile(r"[(\[{«“„「『（【《‹〈‘‚［)\]}»」』）】》›〉’］\"”]")
OPENERS = "([{«“„「『（【《‹〈‘‚［\"¿¡"
QUOTING = OPENERS + "".join(sorted(CLOSERS))
NO_END = STOPS + FULL + OTHERS + ",;:—–-"  # no gap after one of these ends a Thai sentence
NO_START = ",;:、，；：)]}）」』"  # what can't begin a sentence right after an end mark
BITS = 18


def dump_line(line: str) -> bool:
    """Bytes in hex, rules of one repeated mark, or one long token without anything a sentence has."""
    s = line.strip()
    if HEX_FIRST.match(s) and len(parts := s.split()) >= 6 and all(len(p.rstrip(":")) in (2, 4, 8) and HEX.match(p) for p in parts):
        return True
    if len(s) >= 8 and len(set(s[:3])) <= 2 and len(set(s)) <= 2:
        return True
    return len(s) >= 40 and not SPACE.search(s) and s.isascii() and not s.endswith((".", "!", "?")) or len(s) >= 40 and "\\" in s and s.count("\\") >= 4 and not re.search(rf"[.!?。！？][{WHITE}]|[。！？।]", s) and s.count(" ") * 12 < len(s)


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, runs): the lines that are units, and the stretches of running text between them."""
    out: list[tuple[int, int, bool]] = []
    start, last, before, number = -1, -1, "blank", 0

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, last, True))
            start = -1

    at = 0
    marks = [(m.start(), m.end()) for m in LINE.finditer(text)] + [(len(text), len(text))]
    for end, nxt in marks:
        line = text[at:end]
        if not NOT_SPACE.search(line):
            close()
            before = "blank"
        elif LOG_LINE.match(line) or dump_line(line):
            close()
            out.append((at, end, False))
            before = "unit"
        elif BULLET.match(line) and (before != "text" or _opens(text, start, last, line)):
            close()
            n = NUMBERED.match(line)
            # a numbered line in a list of its own that doesn't count on may be text that begins with a number
            if n and before == "blank" and int(n[1]) > 3 and not _list_follows(text, nxt, int(n[1])):
                start, last, before = at, end, "text"
            else:
                out.append((at, end, False))
                before = "item"
        else:
            if start < 0:
                start = at
            last, before = end, "text"
        at = nxt
    close()
    return out


def _opens(text: str, start: int, last: int, line: str) -> bool:
    """A marker after running text begins a list only if it is the first of its kind and the text before leads to it."""
    m = re.match(rf"[{WHITE}]*(.)", line)
    tail = text[start:last].rstrip() if start >= 0 else ""
    return bool(tail) and tail[-1] in ":：" and (m[1] in "-*•–1a·(" )


def _list_follows(text: str, at: int, n: int) -> bool:
    m = NUMBERED.match(text, at)
    return bool(m and int(m[1]) == n + 1)


def pairs(s: str) -> dict[int, int]:
    """Closing mark -> its opening mark, of the quotations and brackets that are complete."""
    stack: list[tuple[str, int]] = []
    wants: dict[str, int] = {}  # closing marks that the stack waits for, and how many times
    done: dict[int, int] = {}
    for m in PAIRED.finditer(s):
        c, i = m[0], m.start()
        if c in CLOSERS and wants.get(c) and not (c in "’‘" and s[i + 1 : i + 2].isalnum()):
            while True:
                close, j = stack.pop()
                wants[close] -= 1
                if close == c:
                    done[i] = j
                    break
        elif c == '"' or c in PAIRS and not (c == "‘" and s[i - 1 : i].isalnum()):
            close = PAIRS.get(c, '"')
            stack.append((close, i))
            wants[close] = wants.get(close, 0) + 1
    return done


@lru_cache(1 << 16)
def shape(t: str, follows: str = "") -> str:
    """Case, length, digits and script of a token; `follows`: initial, file or "" by what stands right after it."""
    if not t:
        return "none"
    c = t[0]
    if c.isdigit():
        return "digit"
    letters = WORD.findall(t)
    if not letters:
        return "mark"
    if "\\" in t or "/" in t:
        return "path"
    if not c.isalpha():
        return "file" if c == "." or follows == "file" else "mark"
    if not (c.isupper() or c.islower()):
        return "uncased"
    if follows == "file" or any(x.isdigit() or x == "_" for x in t):
        return "File" if c.isupper() else "file"
    word = letters[0]
    if c.islower():
        return "lower" if word.islower() else "mixed"
    if len(word) == 1:
        return "initial" if follows == "initial" else "single"
    return "caps" if word.isupper() else "cap"


def script(c: str) -> str:
    o = ord(c) if c else 0
    for hi, name in ((0x250, "latin"), (0x400, "greek"), (0x530, "cyrillic"), (0x700, "arabic"), (0x980, "devanagari"), (0xE80, "thai")):
        if o < hi:
            return name
    return "hangul" if 0xAC00 <= o < 0xD7B0 else "cjk" if 0x3000 <= o < 0xE000 or o >= 0xF900 else "other"


UNSPACED = {"cjk", "thai"}


@lru_cache(1 << 14)
def term_of(mark: str) -> str:
    if any(c in FULL or c in "！？" for c in mark):
        return "full"
    if any(c in "।॥؟۔։።፧" + GREEK_QUESTION for c in mark):
        return "danda"
    if any(c in "!?" for c in mark):
        return "mark"
    return "dots" if len(mark) > 1 or mark[0] in "…‥" else "stop"


class Candidate(NamedTuple):
    """A place where a sentence may end.

    `end` is the first position after it, `next` the start of what follows. A token is a run between spaces and end
    marks: `left` ends here, `before` is the one before it (`inner`: with nothing but a mark between them), `right`
    follows (`after`: whether it goes on like a file name or is an initial). `closed`: the kind of closing mark that
    ends with it, `first`: whether that quotation began a sentence.
    """

    end: int
    next: int
    term: str
    gap: str
    left: str
    inner: bool
    before: str
    right: str
    after: str
    closed: str = ""
    first: bool = False


def candidates(s: str, lo: int, hi: int) -> list[Candidate]:
    """The candidates of the running text s[lo:hi], outside quotations and brackets, in time linear in its length."""
    t = s[lo:hi]
    u = OTHER_SPACE.sub(" ", t)  # as long as t
    n = len(t)
    closers = pairs(t) if PAIRED.search(t) else {}
    opens, closes = sorted(closers.values()), sorted(closers)
    thai = THAI.search(t) is not None
    found = [m.span() for m in (MARKS_OR_SPACES if thai else MARKS).finditer(u)]
    if not found:
        return []
    last_visible = len(u.rstrip(" "))
    out: list[Candidate] = []
    left = ""
    past, follow = 0, 0
    for at, (i, j) in enumerate(found):
        # the token that ends here and the one before it, looked for no further back than the last mark
        e = i
        while e > past and u[e - 1] == " ":
            e -= 1
        a = u.rfind(" ", past, e) + 1 or past
        marked = past > 0 and u[past - 1] != " "
        inner = marked and a == past < e
        if inner:
            before = left
        else:
            b = a
            while b > past and u[b - 1] == " ":
                b -= 1
            before = u[u.rfind(" ", past, b) + 1 or past : b].strip(QUOTING) if b > past else left + "." * marked
        left = u[a:e].strip(QUOTING)
        past = j
        mark = u[i:j]
        space = mark[0] == " "
        if space:
            if not i or j >= n or not (THAI.match(t[i - 1]) or THAI.match(t[j])) or t[i - 1] in NO_END:
                continue
            if closers and bisect_right(opens, i - 1) > bisect_right(closes, i - 1):
                continue
            k, term, closed, first, depth = i, "thai", "", False, 0
        else:
            if mark[0] in GREEK_QUESTION and not (i and t[i - 1].isalpha() and script(t[i - 1]) == "greek"):
                continue
            if i == 0 or u[i - 1] == " " and mark[0] == ".":
                continue  # the period of a name such as .draft.tmp
            if mark[-1] == "." and mark[0] not in STOPS and u[j : j + 1].isalnum():
                j, mark = j - 1, mark[:-1]  # the period begins a name such as .draft.tmp
            # the marks that close with it, also after a space where a quotation is set with spaces
            k, closed, first, depth = j, "", False, 0
            if closers:
                depth = bisect_right(opens, i) - bisect_right(closes, i)
                while depth > 0:
                    p = k
                    while p < n and p - k < 2 and t[p] in GAPS:
                        p += 1
                    if p >= n or closers.get(p, i) >= i:
                        break
                    closed = "quote" if t[p] in QUOTE_CLOSERS else "bracket"
                    o = closers[p]
                    while o and u[o - 1] == " ":
                        o -= 1
                    first = not o or t[o - 1] in ENDS or t[o - 1] in CLOSERS
                    depth -= 1
                    k = p + 1
                    while k < n and t[k] in ENDS:
                        k += 1
                if depth > 0:
                    continue
            if k >= last_visible:
                continue
            term = term_of(mark)
            if term == "dots" and mark[0] in "…‥" and script(t[i - 1]) == "cjk":
                term = "full"
        g = k
        while u[g] == " ":
            g += 1
        if g == k:
            if t[k] in NO_START:
                continue
            gap = "none"
        else:
            gap = "line" if LINE.search(t, k, g) else "space"
        # what follows, up to the next space or mark
        p = g
        while p < n and (u[p] == " " or u[p] in OPENERS):
            p += 1
        follow = max(follow, at + 1)
        while follow < len(found) and found[follow][0] < p:
            follow += 1
        stop, over = found[follow] if follow < len(found) else (n, n)
        z = u.find(" ", p, stop)
        if z < 0:
            z = stop
        right, after = u[p:z].rstrip(QUOTING + ",;:"), ""
        if z == stop < n and u[z] == ".":
            goes = u[over : over + 1]
            if over - stop == 1 and goes.isalnum() and not (goes.isupper() and z - p > 1):
                after = "file"
            elif z - p == 1:
                after = "initial"
        out.append(Candidate(lo + k, lo + g, term, gap, left, inner, before, right, after, closed, first))
    return out


def reliable(c: Candidate) -> int | None:
    """The label of a candidate whose surroundings settle the case: 1 or 0; None where they don't. Only training asks for it."""
    r, w, left = shape(c.right, c.after), shape(c.left), c.left.lower()
    b = shape(c.before.rstrip("."))
    if c.inner:
        left = f"{c.before.lower()}.{left}"
        w = "initial" if len(c.left) == 1 and w in ("single", "lower") and b not in ("path", "file", "File") else "file" if w in ("lower", "digit") and len(left) > 6 else w
    never = left in NEVER_LAST and not (len(left) <= 3 and b == "digit")  # 20 s., 5 min.
    if c.term == "thai":
        if w in ("digit", "file", "File", "path") or r in ("digit", "file", "File", "path", "mark"):
            return 0
        return 1 if THAI.match(c.left[-1:]) and THAI.match(c.right[:1]) else None
    if c.closed == "quote" and (GOES_ON.match(c.right) or c.first and r == "uncased"):
        return 0  # who said it follows; without case, a quotation that nothing introduces needs that
    if c.term in ("full", "danda"):
        return 1
    if r == "lower":
        return 0
    if c.term == "mark":
        return 1 if r in ("cap", "uncased", "single", "initial", "mixed", "caps", "File", "path") or c.gap != "none" else 0
    if c.closed:
        return 1 if r in ("cap", "uncased", "single", "initial", "mixed") else None
    if c.gap == "none":
        # a period inside a number, a name of a file, or letters with periods
        if r in ("digit", "file", "mark", "none", "initial", "caps", "mixed", "File", "path"):
            return 0
        if r == "uncased":
            return None if c.term == "dots" else 0 if w != "uncased" else 1
        if w in ("initial", "single") or never:
            return 0
        return 1 if r == "cap" else None
    if c.term == "dots":
        return 1 if r in ("cap", "single", "uncased") else None
    if left == "no" and r != "digit":  # the word, not the abbreviation
        return 1 if c.left[0] == "N" and (not c.before or c.before[-1] in ENDS) else None
    if never:
        return 0
    if len(c.left) == 1 and w == "lower" and r == "initial" and b != "digit" and len(c.before.rstrip(".")) > 1:
        return 0  # z. B., d. h.
    if w == "digit" and len(c.left) <= 3 and c.left.isdigit() and c.before.lower() in BEFORE_ORDINAL:
        return 0
    if w == "digit" and c.right.lower() in MONTHS and len(c.left) <= 2:
        return 0
    if w in ("single", "initial") and r in ("cap", "single", "initial"):
        return None if b in ("cap", "caps", "File", "path") and not c.before.endswith(".") else 0
    return None


VAGUE = {"digit", "file", "File", "path"}  # tokens of which only the shape counts


@lru_cache(1 << 16)
def _ending(left: str) -> tuple[str, str, int, str]:
    """Of the token before a mark: the token as a feature, shape, length up to 6, script."""
    w, s, low = shape(left), script(left[-1:]), left.lower()
    if s in UNSPACED:
        low = low[-1:]  # without spaces the neighbouring tokens are characters
    elif w == "digit":
        low = "0" * min(len(low), 5) if low.isdigit() else "0.0"
    elif w in VAGUE:
        low = w
    return low, w, min(len(left), 6), s


@lru_cache(1 << 16)
def _beginning(right: str, after: str, closed: str) -> tuple[str, str, str]:
    """Of the token after a mark: the token as a feature, shape, script."""
    w, s, low = shape(right, after), script(right[:1]), right.lower()
    if s in UNSPACED:
        low = low[:3] if closed else low[:1]
    elif w in VAGUE:
        low = w
    return low, w, s


@lru_cache(1 << 16)
def _second(before: str) -> tuple[str, str, bool]:
    """Of the token before the last one: the token as a feature, shape, whether an end mark stands between."""
    w = shape(before.rstrip("."))
    return w if w in VAGUE else before.lower(), w, before.endswith(".")


def keys(c: Candidate) -> tuple[tuple, tuple, tuple, tuple]:
    """What the features of a candidate are made of, in four parts that recur: shapes, and the tokens themselves in their context."""
    _, _, term, gap, left, inner, before, right, after, closed, first = c
    low, wl, size, sl = _ending(left)
    nxt, wr, sr = _beginning(right, after, closed)
    prev, wb, stopped = _second(before)
    return (
        ("S", term, gap, closed, first, wl, size, inner, wr, wb, stopped, sl, sr),
        ("L", low, term, gap, wr, wb, prev if inner else None),
        ("R", nxt, term, wl, closed),
        ("B", "" if inner else prev, wl, min(size, 4)),
    )


def features(key: tuple) -> list[str]:
    """The features of one of the parts."""
    kind, x = key[0], key[1:]
    if kind == "S":
        term, gap, closed, first, wl, size, inner, wr, wb, stopped, sl, sr = x
        made = [
            (term,), (gap,), (term, gap), (wr,), (term, wr), (gap, wr), (term, gap, wr), (wl,), (wl, size), (wl, wr), (term, wl, wr), (term, gap, wl, wr),
            (closed, term), (closed, wr), (closed, first, wr), (wb, wl, wr), (wb, wl, size), (sl, sr), (term, sl), (term, sl, sr), (inner, wl, wr), (inner, wl, size), (inner, gap, wr), (inner, wb, wl), (inner, wb, wl, wr), (stopped, wl, wr), (term, gap, inner, wl, wr, closed),
        ]
    elif kind == "L":
        low, term, gap, wr, wb, joined = x
        made = [(low, term), (low, term, wr), (low, term, gap), (low, wb)] + ([(low, joined), (low, joined, wr)] if joined is not None else [])
    elif kind == "R":
        nxt, term, wl, closed = x
        made = [(nxt,), (nxt, term), (nxt, wl), (nxt, closed)]
    else:
        before, wl, size = x
        made = [(before, wl), (before, wl, size)]
    return [f"{kind}{n}{m}" for n, m in enumerate(made)]


def place(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


class MaxEnt:
    """A two-class maximum-entropy model over hashed features; without examples it takes every candidate."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 1.0):
        self.weights = np.zeros(1 << BITS) if weights is None else weights
        self.bias = bias
        self._known: dict[tuple, float] = {}

    def _part(self, key: tuple) -> float:
        """The weight of one part; parts recur, so they are remembered (200,000 at a time)."""
        if len(self._known) >= 200_000:
            self._known.clear()
        got = self._known[key] = float(self.weights[[place(f) for f in features(key)]].sum())
        return got

    def score(self, c: Candidate) -> float:
        total, known = self.bias, self._known
        for k in keys(c):
            w = known.get(k)
            total += self._part(k) if w is None else w
        return total

    def fit(self, x: list[list[int]], y: list[int], rounds: int = 8, rate: float = 0.2, ridge: float = 1e-6, batch: int = 64) -> "MaxEnt":
        """Adaptive gradient ascent on the log-likelihood, in small batches, with both classes weighted alike; x holds places of features."""
        if not len(x) or len(set(y)) < 2:
            return self
        sizes = np.array([len(r) for r in x])
        wide = np.zeros((len(x), sizes.max()), np.int64)
        real = np.arange(sizes.max()) < sizes[:, None]
        wide[real] = np.concatenate([np.asarray(r, np.int64) for r in x])
        truth = np.asarray(y, float)
        share = truth.mean()
        weigh = np.where(truth > 0, 0.5 / share, 0.5 / (1 - share))
        w, g2, order = self.weights, np.full(1 << BITS, 1e-2), np.random.default_rng(7)
        for _ in range(rounds):
            mixed = order.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = mixed[at : at + batch]
                f, m = wide[rows], real[rows]
                p = 1 / (1 + np.exp(-np.clip((w[f] * m).sum(1) + self.bias, -30, 30)))
                d = (truth[rows] - p) * weigh[rows]
                hit, back = np.unique(f[m], return_inverse=True)
                step = np.bincount(back, np.broadcast_to(d[:, None], f.shape)[m], len(hit))
                g2[hit] += step * step
                w[hit] += rate * (step / np.sqrt(g2[hit]) - ridge * w[hit])
                self.bias += 0.01 * d.sum()
        return self


def examples(text: str) -> list[tuple[Candidate, int]]:
    """The labelled candidates of one text: settled ones, and the ends of blocks before the beginning of the next block."""
    out = []
    bs = blocks(text)
    for n, (lo, hi, runs) in enumerate(bs):
        if not runs:
            continue
        for c in candidates(text, lo, hi):
            y = reliable(c)
            if y is not None:
                out.append((c, y))
        if n + 1 < len(bs) and bs[n + 1][2]:
            nlo, nhi, _ = bs[n + 1]
            head = text[lo:hi].rstrip()
            joined = head + " " + text[nlo:nhi].lstrip()
            out += [(c, 1) for c in candidates(joined, 0, len(joined)) if c.end == len(head) and shape(c.right, c.after) != "lower"]
    return out


@lru_cache(1 << 17)
def _places(key: tuple) -> tuple[int, ...]:
    return tuple(place(f) for f in features(key))


def places(c: Candidate) -> list[int]:
    return [p for k in keys(c) for p in _places(k)]


def split(text: str, model: MaxEnt) -> list[tuple[int, int]]:
    """Start and end (code points) of every sentence; the model decides every candidate."""
    out = []

    def put(a: int, b: int) -> None:
        m = NOT_SPACE.search(text, a, b)
        if m:
            e = b
            while SPACE.match(text[e - 1]):
                e -= 1
            out.append((m.start(), e))

    for lo, hi, runs in blocks(text):
        at = lo
        if runs:
            for c in candidates(text, lo, hi):
                if model.score(c) > 0:
                    put(at, c.end)
                    at = c.end
        put(at, hi)
    return out


def train(documents: DataFrame, id: str, text: str, sample: int = 3000, rows: int = 60_000) -> MaxEnt:
    """The model of a corpus, from at most `rows` labelled candidates of some `sample` documents, chosen by the hash of their id.

    The share of documents that gives the sample is known from their number, so each is chosen where it stands and no
    text moves to another task but to spread the sample itself.
    """
    there = documents.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.xxhash64(F.lit(41), id).alias("h"), F.col(text).alias("t"))
    share = min(1.0, sample / max(1, there.count()))
    picked = there.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, t in zip(b.column(b.schema.get_field_index("h")).to_pylist(), b.column(b.schema.get_field_index("t")).to_pylist()):
                ex = examples(t)
                if ex:
                    yield pa.RecordBatch.from_arrays([pa.array([places(c) for c, _ in ex], pa.list_(pa.int32())), pa.array([y for _, y in ex], pa.int32()), pa.array([h] * len(ex), pa.int64()), pa.array(range(len(ex)), pa.int32())], names=["f", "y", "h", "n"])

    # an even choice among the candidates, however many are alike
    got = spread(picked, "h").mapInArrow(run, "f array<int>, y int, h long, n int").orderBy(F.xxhash64("h", "n"), "h", "n", "y").limit(rows).select("f", "y").toArrow()
    return MaxEnt().fit(got["f"].to_pylist(), got["y"].to_pylist())


def sentences(documents: DataFrame, id: str = "doc_id", text: str = "text", sample: int = 3000, rows: int = 60_000, model: MaxEnt | None = None) -> DataFrame:
    """`id, start_at, end_at` (BIGINT, code points, end exclusive) of every sentence of every text.

    Texts that are null, empty or of white space only have no rows; rows with a null id are left out; the same id
    twice gives the sentences of both rows. `sample` and `rows` bound what the model is trained on (see train); an
    empty corpus trains none; a `model` given is used as it is. Other columns are not read.
    """
    model = model or train(documents, id, text, sample, rows)
    keep = np.flatnonzero(model.weights)
    shared = documents.sparkSession.sparkContext.broadcast((keep.astype(np.int32), model.weights[keep].astype(np.float32), model.bias))  # at most 2**BITS weights
    kind = documents.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        w = np.zeros(1 << BITS)
        w[at] = values
        m = MaxEnt(w, bias)
        for b in batches:
            for part in range(0, b.num_rows, 500):
                piece = b.slice(part, 500)
                ids, starts, ends = [], [], []
                for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    for a, e in split(t, m):
                        ids.append(d)
                        starts.append(a)
                        ends.append(e)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["d", "start_at", "end_at"])

    rows_ = documents.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("d"), F.col(text).alias("t"))
    return spread(rows_, "d").mapInArrow(run, f"d {kind}, start_at long, end_at long").withColumnRenamed("d", id)
