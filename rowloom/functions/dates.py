"""Dates: uniform draws, walked axes, offsets, and formats by tokens with names of a locale."""
from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = re.compile(r"(-?\d+)(?:\.\.(-?\d+))?\s*(ms|mo|[smhdwy])?")
SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "el": "Ιανουαρίου Φεβρουαρίου Μαρτίου Απριλίου Μαΐου Ιουνίου Ιουλίου Αυγούστου Σεπτεμβρίου Οκτωβρίου Νοεμβρίου Δεκεμβρίου",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "zh-cn": "一月 二月 三月 四月 五月 六月 七月 八月 九月 十月 十一月 十二月",
}
WEEKDAYS = {
    "en": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday",
    "de": "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag",
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche",
    "es": "lunes martes miércoles jueves viernes sábado domingo",
    "it": "lunedì martedì mercoledì giovedì venerdì sabato domenica",
    "pt": "segunda-feira terça-feira quarta-feira quinta-feira sexta-feira sábado domingo",
    "pl": "poniedziałek wtorek środa czwartek piątek sobota niedziela",
    "ru": "понедельник вторник среда четверг пятница суббота воскресенье",
    "el": "Δευτέρα Τρίτη Τετάρτη Πέμπτη Παρασκευή Σάββατο Κυριακή",
    "ar": "الإثنين الثلاثاء الأربعاء الخميس الجمعة السبت الأحد",
    "zh-cn": "星期一 星期二 星期三 星期四 星期五 星期六 星期日",
}
LONG = {
    "en": {"L": "MM/DD/YYYY", "LL": "MMMM D, YYYY"}, "de": {"L": "DD.MM.YYYY", "LL": "D. MMMM YYYY"}, "fr": {"L": "DD/MM/YYYY", "LL": "D MMMM YYYY"},
    "es": {"L": "DD/MM/YYYY", "LL": "D [de] MMMM [de] YYYY"}, "it": {"L": "DD/MM/YYYY", "LL": "D MMMM YYYY"}, "pt": {"L": "DD/MM/YYYY", "LL": "D [de] MMMM [de] YYYY"},
    "pl": {"L": "DD.MM.YYYY", "LL": "D MMMM YYYY"}, "ru": {"L": "DD.MM.YYYY", "LL": "D MMMM YYYY г."}, "el": {"L": "DD/MM/YYYY", "LL": "D MMMM YYYY"},
    "ar": {"L": "D/M/YYYY", "LL": "D MMMM YYYY"}, "zh-cn": {"L": "YYYY/MM/DD", "LL": "YYYY年M月D日"},
}
#: Short names that are no plain cut of the long ones.
SHORT_MONTHS = {
    "ru": "янв. февр. март апр. май июнь июль авг. сент. окт. нояб. дек.",
    "fr": "janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.",
    "de": "Jan. Feb. März Apr. Mai Juni Juli Aug. Sept. Okt. Nov. Dez.",
    "el": "Ιαν Φεβ Μαρ Απρ Μαΐ Ιουν Ιουλ Αυγ Σεπ Οκτ Νοε Δεκ",
}
SHORT_WEEKDAYS = {"ru": "пн вт ср чт пт сб вс", "pl": "pn wt śr cz pt sb nd"}


def short_months(locale: str) -> list[str]:
    names = MONTHS[locale].split()
    if locale in SHORT_MONTHS:
        return SHORT_MONTHS[locale].split()
    if locale == "zh-cn":
        return [f"{i}月" for i in range(1, 13)]
    return names if locale == "ar" else [n[:3] + "." * (locale in ("es", "pt")) for n in names]


def short_weekdays(locale: str) -> list[str]:
    names = WEEKDAYS[locale].split()
    if locale in SHORT_WEEKDAYS:
        return SHORT_WEEKDAYS[locale].split()
    if locale == "zh-cn":
        return ["周" + n[-1] for n in names]
    if locale == "ar":
        return [n[2:] for n in names]
    return [n[:2 if locale == "de" else 3] + "." * (locale == "fr") for n in names]


def long_format(token: str, locale: str) -> str:
    """LL with the time, and before it the weekday."""
    day = LONG[locale]["LL"]
    if token == "LLLL":
        day = day + "dddd" if locale == "zh-cn" else "dddd" + (" " if locale in ("fr", "it", "ar") else ", ") + day
    return day + " HH:mm"


_TOKEN = re.compile(r"\[([^\]]*)\]|(LLLL|LLL|LL|L|YYYY|YY|MMMM|MMM|MM|M|DD|D|dddd|ddd|HH|H|mm|m|ss|s|SSS|ZZ|Z)|(.)", re.S)
_JAVA = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "HH": "HH", "H": "H", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS"}


def formatted(ts: Column, pattern: str, locale: str = "en") -> Column:
    """A timestamp by tokens. Names come from tables, not from the machine's locale."""
    months, days = MONTHS[locale].split(), WEEKDAYS[locale].split()
    name = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int"))
    pattern = {"ISO": "YYYY-MM-DD", "ISO_TIME": "YYYY-MM-DD[T]HH:mm:ss"}.get(pattern, pattern)
    parts: list[Column] = []
    for literal, token, other in _TOKEN.findall(pattern):
        if token in ("L", "LL"):
            parts.append(formatted(ts, LONG[locale][token], locale))
        elif token in ("LLL", "LLLL"):
            parts.append(formatted(ts, long_format(token, locale), locale))
        elif token in ("MMMM", "MMM"):
            parts.append(name(months if token == "MMMM" else short_months(locale), F.month(ts)))
        elif token in ("dddd", "ddd"):
            parts.append(name(days if token == "dddd" else short_weekdays(locale), F.weekday(ts) + 1))
        elif token in ("Z", "ZZ"):
            parts.append(F.lit("+00:00" if token == "Z" else "+0000"))
        elif token:
            parts.append(F.date_format(ts, _JAVA[token]))
        else:
            parts.append(F.lit(literal or other))
    return F.concat(*parts) if parts else F.lit("")


def parse_instant(text: str) -> datetime:
    text = text.strip().replace("T", " ").removesuffix("Z")
    for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"):
        try:
            return datetime.strptime(text, f)
        except ValueError:
            continue
    raise ValueError(f"not a date: {text!r}")


def uniform_between(u: Column, low: datetime, high: datetime, precision: str = "day") -> Column:
    """A timestamp from low to high, both included, at whole steps of the precision; u in (0, 1)."""
    step = {"day": 86_400_000, "second": 1000, "millisecond": 1}[precision]
    first = int((low - datetime(1970, 1, 1)).total_seconds() * 1000)
    n = int((high - low).total_seconds() * 1000) // step + 1
    if n < 1:
        raise ValueError("the range ends before it begins")
    return F.timestamp_millis(F.lit(first) + F.least(F.floor(u * n).cast("long"), F.lit(n - 1)) * step)


def weekday_set(text: str) -> list[int]:
    """'mon..fri', 'sun,wed', 'fri..mon' to numbers from Monday = 0."""
    out = set()
    for part in text.lower().split(","):
        a, _, b = part.strip().partition("..")
        i, j = DAYS.index(a.strip()[:3]), DAYS.index((b or a).strip()[:3])
        out |= {(i + k) % 7 for k in range((j - i) % 7 + 1)}
    return sorted(out)


def span(text: str) -> tuple[int, float]:
    """A step such as 15m, 1h30m, 3mo, 2y: (months, seconds); a bare number means days."""
    months, seconds = 0, 0.0
    for n, _, unit in _UNIT.findall(text.replace(" ", "")):
        if unit in ("mo", "y"):
            months += int(n) * (12 if unit == "y" else 1)
        else:
            seconds += int(n) * SECONDS[unit or "d"]
    return months, seconds


def _later(ts: Column, months: Column | None, seconds: Column | None) -> Column:
    out = ts
    if months is not None:
        # months count from the start, so a clamped month end does not stick
        out = F.timestamp_millis(F.unix_millis(F.add_months(ts, months.cast("int")).cast("timestamp")) + F.pmod(F.unix_millis(ts), F.lit(86_400_000)))
    if seconds is not None:
        out = F.timestamp_millis(F.unix_millis(out) + (seconds * 1000).cast("long"))
    return out


def walked(start: datetime, step: str, k: Column, weekdays: str | None = None) -> Column:
    """start + k steps, each measured from the start; with weekdays, the k-th day of those, steps of whole days only."""
    base = F.lit(start).cast("timestamp")
    months, seconds = span(step)
    if weekdays:
        if months or seconds % 86400:
            raise ValueError("weekdays need a step of whole days")
        keep, stride = weekday_set(weekdays), int(seconds // 86400)
        # weekdays repeat after 7 steps at most
        offsets = [i for i in range(7) if (start.weekday() + i * stride) % 7 in keep]
        if not offsets:
            raise ValueError("the step never falls on the weekdays asked for")
        turn = F.floor(k / len(offsets)) * 7 + F.element_at(F.array(*[F.lit(o) for o in offsets]), (F.pmod(k, F.lit(len(offsets))) + 1).cast("int"))
        return _later(base, None, turn * stride * 86400)
    return _later(base, k * months if months else None, k * seconds if seconds else None)


def offset(ts: Column, plus: str, u: Column | None = None) -> Column:
    """ts moved by 7d, 3..10d, 1..3mo or -10..-3d; a range takes the draw u."""
    m = _UNIT.fullmatch(plus.strip())
    if not m:
        raise ValueError(f"not an interval: {plus!r}")
    low, high, unit = int(m[1]), int(m[2] or m[1]), m[3] or "d"
    if high < low:
        raise ValueError(f"the interval {plus!r} ends before it begins")
    n = F.lit(low) if low == high else F.lit(low) + F.least(F.floor(u * (high - low + 1)).cast("long"), F.lit(high - low))
    if unit in ("mo", "y"):
        return _later(ts, n * (12 if unit == "y" else 1), None)
    return _later(ts, None, n * SECONDS[unit])


def age_range(now: datetime, oldest: int, youngest: int) -> tuple[datetime, datetime]:
    """Birthdays of those who are at most `oldest` and at least `youngest` years old."""
    back = lambda y, d: datetime.combine(date(d.year - y, d.month, 28 if (d.month, d.day) == (2, 29) else d.day), datetime.min.time())
    return back(oldest, now), back(youngest, now)
