"""Personal data (5) in SQL functions only: patterns propose, checksums confirm, nearby words adjust the score.

Positions come without a row-wise loop: ``regexp_extract_all`` gives the matches of a pattern and ``split``
the gaps between them, so a span starts at the sum of all earlier gaps and matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Possessive forms of the stated patterns: same matches, linear time. A run of characters that cannot
#: match from its start cannot match from inside; ``\G`` lets a match begin right after the one before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country, so that a match ends with the number and not with the words or digits behind it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = f"(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[0-9]{{2}}"
#: A code without a known length takes what follows, but not the IBAN of a known country behind a space.
IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
        + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
        + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_LISTED})\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Code points before a span (since the span before) in which a context word raises its score.
CONTEXT = 48
CONTEXT_GAIN = 0.3
THRESHOLD = 0.6
_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def sums_before(xs: Column) -> Column:
    """For each element the sum of those before it; in chunks, so long arrays do not cost their square."""
    def by_chunk(v: Column) -> Column:
        n_chunks = F.ceil(F.size(v) / _CHUNK).cast("int")
        sums = F.transform(_range(n_chunks), lambda c: _sum(F.slice(v, c * _CHUNK + 1, _CHUNK)))
        starts = let(sums, lambda s: F.transform(s, lambda _, c: _sum(F.slice(s, 1, c))))
        return let(starts, lambda s: F.transform(v, lambda _, i: F.get(s, F.floor(i / _CHUNK).cast("int"))
                                                 + _sum(F.slice(v, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))
    return let(xs, by_chunk)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Checksum of payment cards over a string of digits."""
    each = F.transform(F.split(F.reverse(value), ""), lambda d, i: d.cast("int") * (i % 2 + 1))
    return _sum(F.transform(each, lambda x: x - F.when(x > 9, 9).otherwise(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064 check of an IBAN without spaces: first four characters to the end, letters as 10 to 35, rest 1 of 97."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _card_ok(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: let(digits(v), lambda d: F.length(d).between(low, high) & luhn(d))


def _ssn_ok(v: Column) -> Column:
    area = F.substr(v, F.lit(1), F.lit(3))
    return ~(area.isin("000", "666") | (area >= "900") | (F.substr(v, F.lit(5), F.lit(2)) == "00") | (F.substr(v, F.lit(8)) == "0000"))


# kind, pattern, cheap test that a text can hold one, checks of a base and of an added span (or None), score, context words
KINDS: list[tuple] = [
    ("email", EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True), None, 0.9, "mail|e-mail|email|contact|kontakt|correo|courriel"),
    ("ip", IP, lambda t: t.contains("."), _ip_ok, None, 0.7, "ip|host|server|address|adresse"),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _card_ok(16, 19), _card_ok(13, 15), 0.4, "card|visa|amex|credit|karte|kreditkarte|carte|tarjeta"),
    ("phone", PHONE, lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(8, 15), None, 0.7, "phone|tel|call|mobile|fax|telefon|telefono|anruf"),
    ("iban", IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), None, lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))), 0.7, "iban|account|konto|compte|cuenta"),
    ("ssn", SSN, lambda t: t.rlike(r"[0-9]-[0-9]"), None, _ssn_ok, 0.4, "ssn|social|security"),
]


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))


def _judged(value: Column, gap: Column, base, added, score: float, words: str) -> Column:
    """struct(base, score): score 0 where no check confirms the match."""
    near = F.right(gap, F.lit(CONTEXT)).rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")
    gained = F.lit(score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
    is_base = base(value) if base else F.lit(False)
    # A confirmed base span never falls below the threshold: it stays whatever stands around it.
    points = F.when(is_base, F.greatest(gained, F.lit(THRESHOLD)))
    if added:
        points = points.when(added(value), gained)
    return F.struct(is_base.alias("base"), F.least(points.otherwise(0.0), F.lit(1.0)).alias("score"))


def _spans(text: Column, kind: str, pattern: str, possible, base, added, score: float, words: str) -> Column:
    def place(p: Column) -> Column:
        sizes = F.transform(p["found"], lambda m, i: F.length(m) + F.length(F.get(p["gaps"], i)))

        def one(start: Column, i: Column) -> Column:
            value, gap = F.get(p["found"], i), F.get(p["gaps"], i)
            begin = start + F.length(gap)
            return let(_judged(value, gap, base, added, score, words), lambda j: F.struct(
                F.lit(kind).alias("kind"), begin.cast("long").alias("start"), (begin + F.length(value)).cast("long").alias("end"),
                j["score"].alias("score"), j["base"].alias("base"), value.alias("value")))
        return F.filter(F.transform(sums_before(sizes), one), lambda s: s["score"] >= THRESHOLD)

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean,value:string>>")
    return F.when(possible(text), let(_parts(text, pattern), place)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, score, base, value), by kind as in ``KINDS``, then start.

    Positions are code points, end exclusive. Null and empty texts give an empty array; spans of different kinds may
    overlap; repeated rows get the same spans. Other columns pass through; one named ``out`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*[_spans(body, *k) for k in KINDS]))


def _replaced(kind: str, base, added, score: float, words: str) -> Callable[[Column], Column]:
    def piece(found: Column, gap: Column) -> Column:
        keep = found.isNull() | (_judged(found, gap, base, added, score, words)["score"] < THRESHOLD)
        return F.coalesce(F.when(keep, found).otherwise(F.lit(f"<{kind.upper()}>")), F.lit(""))

    return lambda p: F.array_join(F.transform(p["gaps"], lambda gap, i: F.concat(gap, let(F.get(p["found"], i), lambda v: piece(v, gap)))), "")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind, as in ``<EMAIL>``; null stays null and all columns keep their names and order.

    Kinds are replaced one after another, so where two overlap the earlier kind of ``KINDS`` wins.
    """
    done = F.col(text)
    for kind, pattern, possible, base, added, score, words in KINDS:
        # A column of its own for each kind: the text so far is built once, not once per use.
        docs = docs.withColumn(text, F.when(possible(done), let(_parts(done, pattern), _replaced(kind, base, added, score, words))).otherwise(done))
    return docs
