"""Number formats: a format code is parsed once, on the driver, and applied to whole columns.

``render`` states the semantics for one value. ``display`` is the operator: it groups a column's distinct codes, turns the
common ones (General, fixed decimals, percent, ISO-like dates) into Column expressions and leaves the others to one
Arrow batch function. Separators and names are en-US.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

# Built-in codes by id (23-36 are not defined), colour names, calendar names.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)",
    7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
    13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)',
    42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)',
    44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
COLOURS = ("black", "blue", "cyan", "green", "magenta", "red", "white", "yellow")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

_TOKEN = re.compile(r'"(?P<quote>[^"]*)"|\\(?P<esc>.)|_(?P<skip>.)|\*(?P<fill>.)|\[(?P<box>[^\]]*)\]|(?P<ampm>[Aa][Mm]/[Pp][Mm]|[Aa]/[Pp])|(?P<slot>[0#?])|(?P<one>.)', re.S)
_CONDITION = re.compile(r"(<=|>=|<>|<|>|=)\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\Z")


class Unsupported(ValueError):
    """The code holds something that is not rendered."""


@dataclass
class Section:
    """Tokens (kind, text): lit, slot (0 # ?), raw (any other character), at, pct, ampm, span (elapsed h, m or s)."""

    tokens: list[tuple[str, str]] = field(default_factory=list)
    condition: tuple[str, float] | None = None

    def raws(self) -> str:
        return "".join(t if k == "raw" else "\0" for k, t in self.tokens)

    @property
    def is_general(self) -> bool:
        return all(k == "raw" or (k == "lit" and not t.strip()) for k, t in self.tokens) and self.raws().replace("\0", "").strip().lower() == "general"

    @property
    def has_text(self) -> bool:
        return any(k == "at" for k, _ in self.tokens)

    @property
    def is_date(self) -> bool:
        if self.is_general or any(k in ("at", "pct") for k, _ in self.tokens):
            return False
        return any(k in ("ampm", "span") or (k == "raw" and t.lower() in "ymdhs") for k, t in self.tokens)


def split_sections(code: str) -> list[str]:
    """Parts between semicolons that stand outside quotes, escapes and brackets."""
    parts, at, start = [], 0, 0
    while at < len(code):
        ch = code[at]
        if ch == '"' or ch == "[":
            end = code.find('"' if ch == '"' else "]", at + 1)
            if end < 0:
                raise Unsupported("unterminated")
            at = end
        elif ch in "\\_*":
            if at + 1 >= len(code):
                raise Unsupported("unterminated")
            at += 1
        elif ch == ";":
            parts.append(code[start:at])
            start = at + 1
        at += 1
    parts.append(code[start:])
    if len(parts) > 4:
        raise Unsupported("more than four sections")
    return parts


def _box(section: Section, text: str) -> None:
    low = text.lower()
    if low in COLOURS or (m := re.fullmatch(r"color\s*([0-9]+)", low)) and 1 <= int(m[1]) <= 56:
        return
    if low and set(low) in ({"h"}, {"m"}, {"s"}):
        section.tokens.append(("span", low))
    elif text.startswith("$"):
        section.tokens.append(("lit", text[1:].split("-")[0]))
    elif m := _CONDITION.match(text):
        section.condition = (m[1], float(m[2]))
    else:
        raise Unsupported(f"[{text}]")


@lru_cache(maxsize=4096)
def parse(code: str) -> tuple[Section, ...]:
    """The sections of a code; raises Unsupported."""
    out = []
    for part in split_sections(code):
        section = Section()
        for m in _TOKEN.finditer(part):
            kind, text = m.lastgroup, m[m.lastgroup]
            if kind in ("quote", "esc"):
                section.tokens.append(("lit", text))
            elif kind == "skip":
                section.tokens.append(("lit", " "))
            elif kind == "box":
                _box(section, text)
            elif kind == "one":
                section.tokens.append(({"@": "at", "%": "pct"}.get(text, "raw"), text))
            elif kind != "fill":
                section.tokens.append((kind, text))
        out.append(section)
    return tuple(out)


def round_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x) if abs(x) < 2**52 else x


def _nearest(x: float) -> float:
    """Nearest integer, exact halves away from zero, without the error of adding a half."""
    low = math.floor(x)
    return low + 1.0 if x - low >= 0.5 else float(low)


def _fixed(x: float, places: int) -> str:
    """A number that is rounded already, with so many decimals."""
    return f"{x:.{places}f}"


def general(x: float) -> str | None:
    if not math.isfinite(x):
        return None
    if x == 0:
        return "0"
    power = math.floor(math.log10(abs(x)))
    if power >= 11 or power <= -10:
        m = x / 10.0**power
        m = math.copysign(_nearest(abs(m) * 1e10) / 1e10, m)
        if abs(m) >= 10:
            m, power = m / 10, power + 1
        return f"{m:.10f}".rstrip("0").rstrip(".") + f"E{power:+d}"
    text = f"{x:.{min(15, max(0, 10 - power))}f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def _group(digits: str) -> str:
    head = len(digits) % 3
    return ",".join(filter(None, [digits[:head], *(digits[k : k + 3] for k in range(head, len(digits), 3))]))


def _literal(tokens: list[tuple[str, str]], text: str = "") -> str:
    out = []
    for kind, t in tokens:
        if kind == "span":
            raise Unsupported("elapsed time among literals")
        out.append(text if kind == "at" else " " if kind == "slot" and t == "?" else "" if kind == "slot" else t)
    return "".join(out)


def _mask(value: int, slots: str, right: bool) -> str:
    if value == 0 and "0" not in slots:
        return " " * slots.count("?")
    text = str(value)
    missing = slots[: max(0, len(slots) - len(text))]
    pad = "0" if "0" in missing else " " if right and "?" in missing else ""
    return pad * len(missing) + text


def _slots(tokens) -> str:
    return "".join(t for k, t in tokens if k == "slot")


def _decimal(tokens, value: float) -> str:
    at = [k for k, (kind, _) in enumerate(tokens) if kind == "slot"]
    first, last = at[0], at[-1]
    points = [k for k in range(first, last + 1) if tokens[k] == ("raw", ".")]
    if len(points) > 1:
        raise Unsupported("two decimal points")
    point = points[0] if points else None
    commas = 0
    while last + 1 + commas < len(tokens) and tokens[last + 1 + commas] == ("raw", ","):
        commas += 1
    if point is None and last + 1 + commas < len(tokens) and tokens[last + 1 + commas] == ("raw", ".") and not commas:
        point = None
    sign = "-" if value < 0 else ""
    size = abs(value) / 1000.0**commas
    inner = tokens[first : last + 1]
    if point is None and any(kind not in ("slot", "pct") and t != (",") for kind, t in inner):
        return sign + _literal(tokens[:first]) + _embedded(inner, size) + _literal(tokens[last + 1 :])
    whole, part = tokens[first : last + 1 if point is None else point], tokens[point + 1 : last + 1] if point is not None else []
    ints, fracs = _slots(whole), _slots(part)
    if len(fracs) > 15 or not ints and not fracs:
        raise Unsupported("too many decimals")
    factor = 10.0 ** len(fracs)
    digits, _, decimals = _fixed(_nearest(size * factor) / factor, len(fracs)).partition(".")
    must = ints.count("0")
    if set(digits) == {"0"} and not must:
        shown = ""
    else:
        shown = digits.rjust(must, "0")
        if ("raw", ",") in whole:
            shown = _group(shown)
    missing = max(0, len(ints) - sum(ch.isdigit() for ch in shown))
    shown = " " * ints[:missing].count("?") + shown
    keep = max(len(decimals.rstrip("0")), fracs.rfind("0") + 1)
    tail = "".join(d if s == "0" or k < keep else " " if s == "?" else "" for k, (s, d) in enumerate(zip(fracs, decimals)))
    dot = "." if point is not None and (tail or set(fracs) & set("0?")) else ""
    return sign + _literal(tokens[:first]) + shown + dot + tail + _literal(tokens[last + 1 + commas :])


def _embedded(tokens, size: float) -> str:
    """Digits from the right into the slots, literals between them; what is left over stands in front."""
    digits, out = list(_fixed(_nearest(size), 0)), []
    for kind, t in reversed(tokens):
        if kind == "slot":
            out.append(digits.pop() if digits else {"0": "0", "?": " ", "#": ""}[t])
        else:
            out.append(t)
    return "".join(digits) + "".join(reversed(out))


def _find_exponent(tokens) -> tuple[int, int, int] | None:
    """(index of E, first and one past the last exponent slot)."""
    for k, (kind, t) in enumerate(tokens):
        if kind == "raw" and t in "eE" and any(x == "slot" for x, _ in tokens[:k]):
            a = k + 1 + (k + 1 < len(tokens) and tokens[k + 1] in (("raw", "+"), ("raw", "-")))
            b = a
            while b < len(tokens) and tokens[b][0] == "slot":
                b += 1
            if b > a:
                return k, a, b
    return None


def _scientific(tokens, value: float, where: tuple[int, int, int]) -> str:
    e, a, b = where
    first = next(k for k, (kind, _) in enumerate(tokens) if kind == "slot")
    mantissa = tokens[first:e]
    dot = mantissa.index(("raw", ".")) if ("raw", ".") in mantissa else len(mantissa)
    ints, places = len(_slots(mantissa[:dot])), len(_slots(mantissa[dot:]))
    if not ints or places > 15:
        raise Unsupported("mantissa")
    size = abs(value)
    power = math.floor(math.log10(size)) if size else 0
    if ints > 1:
        power = power // ints * ints
    m = size / 10.0**power if size else 0.0
    m = _nearest(m * 10.0**places) / 10.0**places
    if m >= 10.0**ints:
        m, power = m / 10.0**ints, power + ints
    mark = "-" if power < 0 else "+" if tokens[e + 1] == ("raw", "+") else ""
    width = _slots(tokens[a:b]).count("0")
    return ("-" if value < 0 else "") + _literal(tokens[:first]) + _fixed(m, places) + tokens[e][1] + mark + str(abs(power)).rjust(width, "0") + _literal(tokens[b:])


def _find_fraction(tokens) -> tuple[int, int, int, int, int, int] | None:
    """(first slot, numerator first and end, denominator first and end, fixed denominator or 0)."""
    for k, token in enumerate(tokens):
        if token != ("raw", "/"):
            continue
        a = k
        while a and tokens[a - 1][0] == "slot":
            a -= 1
        b = k + 1
        while b < len(tokens) and (tokens[b][0] == "slot" or tokens[b][0] == "raw" and tokens[b][1].isdigit()):
            b += 1
        if a == k or b == k + 1:
            continue
        text = "".join(t for _, t in tokens[k + 1 : b])
        first = next(i for i, (kind, _) in enumerate(tokens) if kind == "slot")
        fixed = int(text) if text.isdigit() and int(text) else 0
        return first, a, k, k + 1, b, fixed
    return None


def _fraction(tokens, value: float, where) -> str:
    first, a, slash, da, b, fixed = where
    size = abs(value)
    whole_tokens = tokens[first:a]
    mixed = any(kind == "slot" for kind, _ in whole_tokens)
    whole = math.floor(size) if mixed else 0
    rest = size - whole
    if fixed:
        num, den = int(_nearest(rest * fixed)), fixed
    elif rest - math.floor(rest) <= 2.220446049250313e-16:
        num, den = math.floor(rest), 1
    else:
        best = Fraction(rest).limit_denominator(10 ** min(18, b - da) - 1)
        num, den = best.numerator, best.denominator
    if mixed and num >= den:
        whole, num = whole + num // den, num % den
    out = ("-" if value < 0 else "") + _literal(tokens[:first])
    if mixed:
        last = max(k for k, (kind, _) in enumerate(whole_tokens) if kind == "slot")
        out += "0" if whole == 0 and num == 0 else _mask(whole, _slots(whole_tokens), False)
        out += _literal(whole_tokens[last + 1 :])
    masks = tokens[a:slash], tokens[da:b]
    if num == 0:
        out += " " * (len(masks[0]) + 1 + len(masks[1]))
    else:
        out += _mask(num, _slots(masks[0]), True) + "/" + str(den)
        if not fixed:
            out += " " * max(0, _slots(masks[1]).count("?") - len(str(den)))
    return out + _literal(tokens[b:])


def serial_date(day: int, epoch_1904: bool = False) -> tuple[int, int, int, int]:
    """(year, month, day, weekday from Sunday) of a serial day. In the 1900 epoch day 60 is 29 February 1900 and day 0 is
    "0 January"."""
    from datetime import date, timedelta

    if epoch_1904:
        d = date(1904, 1, 1) + timedelta(days=day)
        return d.year, d.month, d.day, (day + 5) % 7
    weekday = (day + 6) % 7
    if day == 0:
        return 1900, 1, 0, weekday
    if day == 60:
        return 1900, 2, 29, weekday
    d = date(1899, 12, 31 if day < 60 else 30) + timedelta(days=day)
    return d.year, d.month, d.day, weekday


def _date_fields(tokens) -> list[tuple[str, str, int]]:
    """(field, text, width): y, o (month), n (minute), d, h, s, f (fraction), ampm, span, lit."""
    out: list[list] = []
    k = 0
    while k < len(tokens):
        kind, t = tokens[k]
        if kind == "raw" and t.lower() in "ymdhs":
            end = k
            while end < len(tokens) and tokens[end][0] == "raw" and tokens[end][1].lower() == t.lower():
                end += 1
            out.append([t.lower(), t, end - k])
            k = end
            if t.lower() == "s" and k < len(tokens) and tokens[k] == ("raw", "."):
                end = k + 1
                while end < len(tokens) and tokens[end] == ("slot", "0"):
                    end += 1
                if end > k + 1:
                    out += [["lit", ".", 0], ["f", "", end - k - 1]]
                    k = end
            continue
        if kind in ("slot", "pct", "at"):
            raise Unsupported("a digit slot in a date")
        out.append([{"raw": "lit"}.get(kind, kind), t, len(t)])
        k += 1
    for i, x in enumerate(out):
        if x[0] == "m":
            before = next((y for y in reversed(out[:i]) if y[0] != "lit"), ["", "", 0])
            after = next((y for y in out[i + 1 :] if y[0] != "lit"), ["", "", 0])
            minute = before[0] == "h" or before[0] == "span" and before[1][0] == "h" or after[0] in "sf" and after[0] or after[0] == "span" and after[1][0] == "s"
            x[0] = "n" if minute else "o"
    return [tuple(x) for x in out]


def _date(tokens, serial: float, epoch_1904: bool) -> str | None:
    if serial < 0:
        return None
    fields = _date_fields(tokens)
    kinds = {f for f, _, _ in fields} | {t[0] for f, t, _ in fields if f == "span"}
    places = max((w for f, _, w in fields if f == "f"), default=0)
    if places > 9:
        raise Unsupported("more than nine decimals of a second")
    second = 10**places
    units = {"h": 3600 * second, "m": 60 * second, "s": second}
    day = 24 * units["h"]
    ticks = serial * float(day)
    if kinds & {"f", "s"}:
        quantum = 1 if places else second
    elif "n" in kinds or any(f == "span" and t[0] == "m" for f, t, _ in fields):
        quantum = units["m"]
    elif kinds & {"h", "ampm"}:
        quantum = units["h"]
    else:
        quantum = 0
    total = int(round_away(ticks / quantum)) * quantum if quantum else math.floor(serial) * day
    try:
        year, month, dom, weekday = serial_date(total // day, epoch_1904)
    except OverflowError:
        return None
    inner = total % day
    hour, minute, sec = inner // units["h"], inner % units["h"] // units["m"], inner % units["m"] // second
    twelve = "ampm" in kinds
    out = []
    for f, t, w in fields:
        if f == "y":
            out.append(str(year) if w == 1 else f"{year % 100:02d}" if w == 2 else str(year).rjust(w, "0"))
        elif f == "o":
            name = MONTHS[month - 1]
            out.append(str(month).rjust(w, "0") if w <= 2 else name[:3] if w == 3 else name[0] if w == 5 else name)
        elif f == "d":
            out.append(str(dom).rjust(w, "0") if w <= 2 else DAYS[weekday][:3] if w == 3 else DAYS[weekday])
        elif f == "h":
            out.append(str((hour % 12 or 12) if twelve else hour).rjust(w, "0"))
        elif f == "n":
            out.append(str(minute).rjust(w, "0"))
        elif f == "s":
            out.append(str(sec).rjust(w, "0"))
        elif f == "f":
            out.append(str(inner % second).rjust(w, "0"))
        elif f == "ampm":
            word = ("AM" if hour < 12 else "PM") if len(t) > 3 else ("A" if hour < 12 else "P")
            out.append(word.lower() if t == t.lower() else word)
        elif f == "span":
            out.append(str(total // units[t[0]]).rjust(w, "0"))
        else:
            out.append(t)
    return "".join(out)


def choose(sections: tuple[Section, ...], value: float) -> tuple[Section, bool] | None:
    """The section for a number, and whether it shows the magnitude alone."""
    numeric = sections[:3]
    if any(s.condition for s in numeric):
        test = {"<": value.__lt__, "<=": value.__le__, ">": value.__gt__, ">=": value.__ge__, "=": value.__eq__, "<>": value.__ne__}
        for s in numeric:
            if s.condition and test[s.condition[0]](s.condition[1]):
                return s, False
        plain = [s for s in numeric if not s.condition]
        return (plain[0], False) if plain else None
    if value < 0 and len(numeric) > 1:
        return numeric[1], True
    return numeric[2 if value == 0 and len(numeric) == 3 else 0], False


def _number(section: Section, value: float, epoch_1904: bool) -> str | None:
    tokens = section.tokens
    if section.is_date:
        return _date(tokens, value, epoch_1904)
    if section.is_general:
        word = "".join(t for k, t in tokens if k == "raw").strip()
        text = general(value)
        return None if text is None else "".join(t if k == "lit" else text if k == "raw" and i == min(j for j, x in enumerate(tokens) if x[0] == "raw") else "" for i, (k, t) in enumerate(tokens)) if word else None
    if section.has_text:
        text = general(value)
        return None if text is None else _literal(tokens, text)
    slots = [k for k, (kind, _) in enumerate(tokens) if kind == "slot"]
    raw = section.raws().lower()
    if not slots:
        if "general" in raw:
            at = raw.index("general")
            return _literal(tokens[:at]) + (general(value) or "") + _literal(tokens[at + 7 :])
        return ("-" if value < 0 else "") + _literal(tokens)
    if len(slots) > 30:
        raise Unsupported("more than thirty digit slots")
    value *= 100.0 ** sum(k == "pct" for k, _ in tokens)
    if not math.isfinite(value):
        return None
    if where := _find_exponent(tokens):
        return _scientific(tokens, value, where)
    if where := _find_fraction(tokens):
        return _fraction(tokens, value, where)
    return _decimal(tokens, value)


def render(code: str, value, epoch_1904: bool = False, error: bool = False) -> str | None:
    """The display of a value under a code: None where the code is unsupported or the value has no such display."""
    try:
        sections = parse(code)
        if error:
            return str(value)
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, str):
            return _literal(sections[3].tokens, value) if len(sections) == 4 else value
        if value is None or not math.isfinite(value):
            return None
        found = choose(sections, float(value))
        return None if found is None else _number(found[0], abs(value) if found[1] else float(value), epoch_1904)
    except Unsupported:
        return None


def is_supported(code: str) -> bool:
    """Whether every section can be rendered."""
    try:
        for s in parse(code):
            if s.is_date:
                _date_fields(s.tokens)
            elif s.tokens:
                _number(s, 1.0, False)
        return True
    except Unsupported:
        return False


def date_kind(code: str) -> str:
    """"date", "duration" (elapsed time) or "other", by the first section."""
    try:
        first = parse(code)[0]
    except Unsupported:
        return "other"
    if not first.is_date:
        return "other"
    return "duration" if any(k == "span" for k, _ in first.tokens) else "date"


def serial_to_iso(serial: float, epoch_1904: bool = False) -> str | None:
    """YYYY-MM-DD, with THH:MM:SS and .mmm only where they are not zero; None for negative serials."""
    if serial < 0 or not math.isfinite(serial):
        return None
    ms = int(round_away(serial * 86_400_000.0))
    day, rest = divmod(ms, 86_400_000)
    try:
        y, m, d, _ = serial_date(day, epoch_1904)
    except OverflowError:
        return None
    out = f"{y:04d}-{m:02d}-{d:02d}"
    if rest:
        s, milli = divmod(rest, 1000)
        out += f"T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" + (f".{milli:03d}" if milli else "")
    return out


def iso_to_serial(text: str, epoch_1904: bool = False) -> float | None:
    from datetime import date

    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?)?", text)
    if not m:
        return None
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    if not epoch_1904 and (y, mo, d) == (1900, 2, 29):
        day = 60
    elif not epoch_1904 and (y, mo, d) == (1900, 1, 0):
        day = 0
    else:
        try:
            day = (date(y, mo, d) - (date(1904, 1, 1) if epoch_1904 else date(1899, 12, 30))).days
        except ValueError:
            return None
        if not epoch_1904 and day < 61:
            day -= 1
    clock = (int(m[4] or 0) * 3600 + int(m[5] or 0) * 60 + int(m[6] or 0) + float(f"0.{m[7] or 0}")) / 86400
    return day + clock if day >= 0 else None


def shortest(x: float) -> str:
    """The shortest text that reads back as the number, never with an exponent, without a trailing .0."""
    text = repr(float(x))
    if "e" in text or "E" in text:
        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


def round_places(x: float, places: int) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)
