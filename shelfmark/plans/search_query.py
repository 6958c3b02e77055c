"""The search language: words and filters of one line of text, as a plan of column conditions.

A word must occur in the name. `size:`, `ext:`, `type:`, `modified:`, `disk:`, `path:`, `is:`, `online:` and `regex:`
filter; `d:` names a drive. Quotes keep blanks. A mistake raises QueryError with its code, value and place.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from ..functions.names import fold_text


@dataclass
class QueryError(Exception):
    code: str
    value: str
    start: int
    end: int


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    sizes: list[tuple[int | None, int | None]] = field(default_factory=list)
    exts: list[set[str]] = field(default_factory=list)
    types: list[set[str]] = field(default_factory=list)
    times: list[tuple[int | None, int | None]] = field(default_factory=list)
    disks: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)
    is_dir: bool | None = None
    online: list[bool] = field(default_factory=list)

    def empty(self) -> bool:
        return not any((self.terms, self.sizes, self.exts, self.types, self.times, self.disks, self.paths, self.regexes, self.is_dir is not None, self.online))


#: Spellings of filters, categories and units (English and Italian).
FILTERS = {"size": "size dim", "ext": "ext", "type": "type tipo", "modified": "modified mod modificato", "disk": "disk disco", "path": "path percorso", "is": "is", "online": "online", "regex": "regex"}
TYPES = {
    "images": "image images immagine immagini photo foto", "videos": "video videos", "audio": "audio music musica", "documents": "document documents documento documenti doc", "archives": "archive archives archivio archivi",
    "disk_images": "disk_image disk_images iso", "code": "code codice", "programs": "program programs programma programmi exe", "other": "other altro",
}
UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
DAY = 86_400_000
SPANS = {"h": 3_600_000, "d": DAY, "g": DAY, "w": 7 * DAY, "m": 30 * DAY, "y": 365 * DAY, "a": 365 * DAY}


def _spelled(table: dict[str, str], word: str) -> str | None:
    return next((k for k, v in table.items() if word in v.split()), None)


def parse_bytes(s: str) -> int | None:
    m = re.fullmatch(r"([\d.,]+)\s*([A-Za-z]*)", s.strip())
    if not m or m[2].lower() not in UNITS:
        return None
    try:
        v = float(m[1].replace(",", ".")) * UNITS[m[2].lower()]
    except ValueError:
        return None
    return int(v + 0.5) if v < 1.8e19 else None


def parse_size(s: str) -> tuple[int | None, int | None] | None:
    """Least and greatest size, both included."""
    if ".." in s:
        a, b = (parse_bytes(x) for x in s.split("..", 1))
        return None if a is None or b is None or a > b else (a, b)
    m = re.match(r"(>=|<=|>|<|)(.*)", s, re.S)
    n = parse_bytes(m[2])
    if n is None or m[1] == "<" and n == 0:
        return None
    return {">=": (n, None), "<=": (None, n), ">": (n + 1, None), "<": (None, n - 1), "": (n, None)}[m[1]]


def date_span(s: str, offset_min: int = 0) -> tuple[int, int] | None:
    """[start, end) in UTC milliseconds of a local year, month or day: 2024, 2024-03, 2024-03-15, 15/03/2024."""
    parts = s.split("/")[::-1] if "/" in s else s.split("-")
    try:
        n = [int(p) for p in parts]
        if not 1 <= len(n) <= 3 or not 1601 <= n[0] <= 9999:
            return None
        start = datetime.date(n[0], n[1] if len(n) > 1 else 1, n[2] if len(n) > 2 else 1)
    except ValueError:
        return None
    days = start.toordinal() - 719_163
    if len(n) == 3:
        end = days + 1
    else:
        y, m = (n[0] + 1, 1) if len(n) == 1 or n[1] == 12 else (n[0], n[1] + 1)
        end = datetime.date(y, m, 1).toordinal() - 719_163 if y <= 9999 else 2_932_897
    return days * DAY - offset_min * 60_000, end * DAY - offset_min * 60_000


def parse_modified(s: str, now_ms: int, offset_min: int) -> tuple[int | None, int | None] | None:
    """(after, before) in UTC milliseconds: after included, before excluded. `<30d` is newer than 30 days, `>30d` older."""
    if ".." in s:
        a, b = (date_span(x, offset_min) for x in s.split("..", 1))
        return (a[0], b[1]) if a and b else None
    m = re.match(r"(<=|>=|<|>|)(.*)", s, re.S)
    op, rest = m[1], m[2]
    if op and (d := re.fullmatch(r"(\d+)([A-Za-z])", rest)) and d[2].lower() in SPANS:
        when = now_ms - int(d[1]) * SPANS[d[2].lower()]
        return (when, None) if op[0] == "<" else (None, when)
    span = date_span(rest, offset_min)
    if span is None:
        return None
    return {">": (span[1], None), ">=": (span[0], None), "<": (None, span[0]), "<=": (None, span[1]), "": span}[op]


def tokens(text: str) -> list[tuple[str | None, str, int, int, int]]:
    """(key, value, start, end, start of value); quotes keep blanks together."""
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        start, key, value, value_at = i, None, "", i
        while i < len(text) and not text[i].isspace():
            if text[i] == '"':
                close = text.find('"', i + 1)
                if close < 0:
                    raise QueryError("unclosed_quote", text[i + 1 :], i, len(text))
                value += text[i + 1 : close]
                i = close + 1
            elif text[i] == ":" and key is None and value and text[start:i] == value and re.fullmatch(r"[^\W\d_]+", value):
                key, value, value_at = value, "", i + 1
                i += 1
            else:
                value += text[i]
                i += 1
        out.append((key, value, start, i, value_at))
    return out


def parse(text: str, now_ms: int = 0, offset_min: int = 0) -> Query:
    q = Query()
    for key, value, start, end, at in tokens(text):
        if key is None or len(key) == 1:
            if key is not None:
                q.disks.append(key.upper() + ":")
            if value:
                q.terms.append(fold_text(value))
            continue
        name = _spelled(FILTERS, key.lower())
        if not value:
            raise QueryError("empty_value", key, start, end)
        if name is None:
            raise QueryError("unknown_filter", key, start, at - 1)

        def need(x, code, bad=value):
            if x is None:
                raise QueryError(code, bad, at, end)  # noqa: B023
            return x

        if name == "size":
            q.sizes.append(need(parse_size(value), "bad_size"))
        elif name == "ext":
            q.exts.append({e.strip().lstrip(".").lower() for e in value.split(",")} - {""})
        elif name == "type":
            q.types.append({need(_spelled(TYPES, p.lower()), "bad_type", p) for p in re.split(r"[,|]", value) if p})
        elif name == "modified":
            q.times.append(need(parse_modified(value, now_ms, offset_min), "bad_date"))
        elif name == "disk":
            q.disks.append(value)
        elif name == "path":
            q.paths.append(fold_text(value))
        elif name == "is":
            q.is_dir = need({"dir": True, "folder": True, "cartella": True, "file": False}.get(value.lower()), "bad_is")
        elif name == "online":
            q.online.append(need({"yes": True, "true": True, "si": True, "sì": True, "no": False, "false": False}.get(value.lower()), "bad_online"))
        else:
            try:
                re.compile(value)
            except re.error as e:
                raise QueryError("bad_regex", str(e), at, end) from e
            q.regexes.append(value)
    return q


def get_filter(text: str, key: str) -> str | None:
    """The value of a filter in a search text, without quotes; None if it has none."""
    m = re.search(rf'(?:^|\s){re.escape(key)}:("[^"]*"|\S*)', text, re.I)
    return m[1].strip('"') if m else None


def set_filter(text: str, key: str, value: str | None) -> str:
    """The search text with one filter of that key, in quotes if it has spaces; without any for None or ''."""
    left = " ".join(re.sub(rf'(^|\s){re.escape(key)}:("[^"]*"|\S*)', " ", text, flags=re.I).split())
    if not value:
        return left
    shown = f'"{value}"' if re.search(r"\s", value) else value
    return f"{left} {key}:{shown}".strip()


def split_at(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The text around a mistake, cut where the range leaves the text."""
    a = max(0, min(start, len(text)))
    b = max(a, min(end, len(text)))
    return text[:a], text[a:b], text[b:]
