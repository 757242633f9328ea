"""Personal data: base formats, and boosted trees over high-recall candidates; DataFrame functions only.

Generators propose spans: every token with a digit or an @, values assigned to credential names, groups of digits,
account numbers in groups, numbers after contact words, and e-mail addresses written out in words.
The candidates overlap. They are described by format (length, shares of digits, capitals and hex
digits, separators, checks) and context (words just before them), and scored by gradient-boosted trees,
emitted as CASE expressions.

No table says what is personal, so the truth is planted: generated values of known kinds, and look-alikes that are
none (hashes after "commit", versions, dates, order numbers, settings), are put into pieces of the corpus' own texts
(a bounded sample). A candidate is positive if it covers a planted value and little else. Candidates of the pieces
themselves count as negative, unless a base format, a credential name or a check makes them doubtful; those are left out.
A threshold is calibrated on the half of the plants that was not fitted, for the wanted precision.

Base spans always stay. Of overlapping selected candidates the one of the best score is added, the longest
at equal scores, where it overlaps no base span.

Positions: a text is split at the matches of a pattern, and the lengths of parts and matches add up in
one pass of ``aggregate``. Patterns have no nested repetition, so long texts neither backtrack nor recurse.

Spans are compared in order of their starts: running ends are searched by halving, and a sweep holds one candidate.
So the work of a text grows with its candidates (times the logarithm of their number), not with their pairs. A sweep is
repeated for what overlaps nothing it chose; there are as many sweeps as a chain of overlapping candidates has that each
beat the one before (few; the result does not depend on it).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import given, least_hashed, unit_hash
from .trees import BoostedTrees, boost

#: The base kinds, and those of added spans.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local_phone", "account", "spelled_email", "secret")
#: Documents whose pieces hold plants, characters of a piece, and plants, at most.
SAMPLE_DOCS, PIECE, PLANTS = 1500, 240, 4000
PRECISION = 0.98

_LOCAL = "A-Za-z0-9._%+-"
#: A match begins where a run of its characters begins, or where the last match ended (\\G).
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)(?=\S*?[0-9@])\S{6,}+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CREDENTIAL = r"(?i)(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|bearer|api[_-]?key|access[_-]?key|credentials?|auth)"
#: What assigns a value to a credential name.
_ASSIGNS = r"(?:[\"']?\s{0,3}[=:]\s{0,3}|\s{1,3}is:?\s{1,3})[\"']?"
_NUMBER_OF = r"(?i)(?<![A-Za-z])(?:call|phone|telephone|tel|mobile|cell|fax|account|acct|iban|ssn|card)(?:\W{1,3}(?:is|at|no|number|us|me|on))?\W{1,4}"
ASSIGNED = _CREDENTIAL + _ASSIGNS + r"[^\s\"']++"
GROUPS = r"(?<![A-Za-z0-9+])\(?[0-9]{2,6}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,6}\)?){1,5}+(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NUMBER = _NUMBER_OF + r"\(?[0-9][0-9A-Za-z]{0,33}+(?:[\x20().-]{1,3}[0-9][0-9A-Za-z]{0,33}+){0,8}+"
#: An address in words: at and dot, bare or in brackets.
_AT, _DOT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)", r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
SPELLED = rf"(?i)(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}}+{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z]{{2,24}}+"
_CONTACT = r"(?i)(?:call|phone|tel|mobile|mail|contact|write|reach|card|account|acct|iban|ssn|social|ip|address)"
#: Words before what only looks personal.
_INNOCENT = r"(?i)(?:commit|sha[0-9-]*|md5|hash|checksum|digest|revision|rev|blob|tree|version|release|build|isbn|issn|doi|order|chapter|page|figure|section|model|part|uuid|id)\W{1,3}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


_SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"
#: Items of a run, and runs of a greater run, in ``_gathered``.
_RUN = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _gathered(items: Column, first: Column, step, kind: str, last=None) -> Column:
    """The results of ``step(state, item) -> (state, result or null)`` in order, nulls left out; then ``last(state)``, an array.

    ``kind`` is the DDL type of the array of results. A state is copied at every step, so results are gathered in runs, these
    in greater runs, and those in one array: appending stays cheap where there are many.
    """
    empty = F.array().cast(kind)
    state = lambda at, found: F.struct(at.alias("at"), found.alias("found"))

    def one(acc, x):
        at, got = step(acc["at"], x)
        pair = F.struct(at.alias("at"), got.alias("got"))
        return _let(pair, lambda p: state(p["at"], F.when(p["got"].isNotNull(), F.concat(acc["found"], F.array(p["got"]))).otherwise(acc["found"])))

    def runs(every, at, length, inner, done=None):
        """The state after all items, from runs of ``length`` that ``inner`` folds."""
        def add(acc, b):
            return _let(inner(F.slice(every, b * length + 1, F.lit(length)), acc["at"]), lambda r: state(r["at"], F.concat(acc["found"], r["found"])))

        numbers = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.floor((F.size(every) - 1) / length).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(numbers, state(at, empty), add, done)

    folded = lambda some, at: F.aggregate(some, state(at, empty), one)
    greater = lambda some, at: _let(some, lambda s: runs(s, at, _RUN, folded))
    done = lambda acc: F.concat(acc["found"], last(acc["at"])) if last else acc["found"]
    return _let(items, lambda every: runs(every, first, _RUN * _RUN, greater, done))


def _below(values: Column, x: Column) -> Column:
    """How many of an array's rising values are less than ``x``, by halving."""
    n = F.size(values)
    bits = F.when(n > 0, F.floor(F.log2(n.cast("double"))).cast("int")).otherwise(F.lit(0))

    def step(at, k):
        to = at + F.pow(F.lit(2.0), k.cast("double")).cast("int")
        return F.when((to <= n) & (F.get(values, to - 1) < x), to).otherwise(at)

    return F.aggregate(F.sequence(bits, F.lit(0)), F.lit(0), step)


def _running_max(values: Column) -> Column:
    """The greatest of the values up to each place, over distances of 1, 2, 4 and so on."""
    n = F.size(values)
    distances = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2((n - 1).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2.0), k.cast("double")).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(distances, values, lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, F.greatest(v, F.get(acc, i - d))).otherwise(v)))


def _apart(spans: Column, from_: Column) -> Column:
    """Those of ``spans`` that overlap none of ``from_``, which is in order of its starts."""
    none_over = lambda starts, ends: F.filter(spans, lambda c: _let(_below(starts, c["end"]), lambda k: (k == 0) | (F.get(ends, k - 1) <= c["start"])))
    return _let(from_, lambda f: F.when(F.size(f) > 0, _let(F.transform(f, lambda b: b["start"]), lambda starts: _let(_running_max(F.transform(f, lambda b: b["end"])), lambda ends: none_over(starts, ends)))).otherwise(spans))


def _scan(text: Column, pattern: str, made, kind: str) -> Column:
    """An array (of the DDL type ``kind``) of ``made(hit, begin, part before)``, null results left out.

    ``made`` returns a struct, or null where a match is not valid. Positions are code points.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at, x):
        begin = at + F.length(x["part"])
        return (begin + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint"), made(x["hit"], begin, x["part"])

    return _gathered(pairs, F.lit(0).cast("bigint"), step, kind)


def _spans(text: Column, pattern: str, valid, order: int, trim: bool = False) -> Column:
    def made(hit, begin, _):
        length = F.length(F.rtrim(F.regexp_replace(hit, "[-]$", ""))) if trim else F.length(hit)
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(order).alias("ord"), (begin + length).cast("bigint").alias("end"))
        return F.when(hit.isNotNull() & valid(hit), span)

    return _scan(text, pattern, made, _SPAN)


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def _card_ok(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _ip_ok(hit: Column) -> Column:
    return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    none = F.array().cast(_SPAN)
    found = [
        F.when(F.contains(text, F.lit("@")), _spans(text, EMAIL, lambda m: F.lit(True), 0)).otherwise(none),
        F.when(_has_digit(text), _spans(text, IP, _ip_ok, 1)).otherwise(none),
        F.when(_has_digit(text), _spans(text, CARD, _card_ok, 2, trim=True)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _spans(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15), 3)).otherwise(none),
    ]
    return F.sort_array(F.concat(*found))


_CANDIDATE = "array<struct<start:bigint,end:bigint,value:string,before:string>>"


_ENDING = r"[\"')\]}>.,;:!?]+$"


def _proposed(text: Column, pattern: str, lead_pattern: str | None, least: int, ending: str | None = None) -> Column:
    """The matches of a pattern without their lead and ending, with up to 48 characters and the lead before them."""
    def made(hit, begin, part):
        lead = F.regexp_extract(hit, lead_pattern, 0) if lead_pattern else F.lit("")
        value = F.substring(hit, F.length(lead) + 1, F.length(hit))
        value = F.regexp_replace(value, ending, "") if ending else value
        start = begin + F.length(lead)
        span = F.struct(start.cast("bigint").alias("start"), (start + F.length(value)).cast("bigint").alias("end"), value.alias("value"), F.concat(F.substring(part, -48, 48), lead).alias("before"))
        return F.when(hit.isNotNull() & (F.length(value) >= least), span)

    return _scan(text, pattern, made, _CANDIDATE)


def _worth(text: Column) -> Column:
    """Whether a text can have candidates."""
    return text.rlike("[0-9@]") | text.rlike(ASSIGNED) | text.rlike(SPELLED)


def candidates(text: Column) -> Column:
    """The spans of all generators, which overlap; equal ones once.

    Tokens of six characters or more with a digit or an @, without what assigns, quotes or ends them; values of any
    characters and length assigned to a credential name; groups of digits over blanks, dots, hyphens and parentheses;
    account numbers, in groups or not; numbers after a word for a phone, an account or a card; and addresses in words.
    """
    none = F.array().cast(_CANDIDATE)
    found = [
        F.when(text.rlike("[0-9@]"), _proposed(text, TOKEN, r"^(?:[^=:]*+[=:])?[\"'(\[{<]*", 6, _ENDING)).otherwise(none),
        F.when(text.rlike(ASSIGNED), _proposed(text, ASSIGNED, "^" + _CREDENTIAL + _ASSIGNS, 1, _ENDING)).otherwise(none),
        F.when(text.rlike(SPELLED), _proposed(text, SPELLED, None, 6)).otherwise(none),
        *(F.when(_has_digit(text), _proposed(text, p, lead, 6)).otherwise(none) for p, lead in ((GROUPS, None), (IBAN, None), (NUMBER, "^" + _NUMBER_OF))),
    ]
    new = lambda every: F.filter(every, lambda c, i: (i == 0) | (c != F.get(every, i - 1)))
    return _let(F.sort_array(F.concat(*found)), new)


_KEY_PREFIX = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,})$"


_PHONE_FORMAT = r"^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$"


def _iban_ok(value: Column) -> Column:
    """Whether an account number passes its check, modulo 97."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(flat, 5, 34), F.substring(flat, 1, 4)), "")

    def add(acc, c):
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, acc * 100 + letter).otherwise(acc * 10 + F.ascii(c) - 48) % 97

    return F.when(value.rlike(f"^{IBAN}$"), F.aggregate(turned, F.lit(0), add) == 1).otherwise(False)


_SSN = r"^[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}$"
_JWT = r"^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$"


def features(value: Column, before: Column) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    n = F.length(value).cast("double")
    share = lambda kind: (n - F.length(F.regexp_replace(value, f"[{kind}]", ""))) / n
    digits = _digits(value)
    out = [
        n, share("0-9"), share("A-Z"), share("a-z"), share("0-9a-f"), share("."), share("@"), share("_/+:-"),
        F.size(F.split(value, "(?<=[A-Za-z])(?=[0-9])")),
        before.rlike(_CREDENTIAL + r"\W{0,6}$"), before.rlike(r"[=:]\s?[\"']?$"), before.rlike(_CONTACT),
        F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False), value.rlike(_KEY_PREFIX),
        share(r"\x20()"), before.rlike(_CREDENTIAL + _ASSIGNS + "$"), _iban_ok(value), before.rlike(_NUMBER_OF + r"\(?$"),
        F.length(digits), before.rlike(_INNOCENT), value.rlike(_SSN), value.rlike(_PHONE_FORMAT), value.rlike(_JWT), value.rlike(f"^{SPELLED}$"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
    ]
    return [f.cast("double") for f in out]


def _kind(value: Column) -> Column:
    """The kind of an added span (its place in ``KINDS``), by its format."""
    numeric = value.rlike(r"^[0-9\x20().-]+$")
    return (
        F.when(value.rlike(_SSN), 4).when(value.rlike(f"^{IBAN}$") & value.rlike("^[A-Z]{2}[0-9]{2}"), 5).when(value.rlike(f"^{SPELLED}$"), 8)
        .when(numeric & F.length(_digits(value)).between(7, 11) & value.rlike(r"[0-9][\x20().-]+[0-9]"), 6).when(numeric, 7).otherwise(9)
    )


def _doubtful(value: Column, before: Column) -> Column:
    """Candidates of the corpus' own texts that may be personal: no example of either kind."""
    based = value.rlike(f"^{EMAIL}$") | _ip_ok(value) | (value.rlike(f"^{CARD}$") & _card_ok(value)) | value.rlike(r"^\+?[0-9][\x20().0-9-]{7,}$")
    return based | before.rlike(_CREDENTIAL + r"\W{0,6}$") | value.rlike(_KEY_PREFIX) | value.rlike(_JWT) | _iban_ok(value) | value.rlike(f"^{SPELLED}$")


class _Plants:
    """Generated values: (lead, value) of personal data, and of what only looks like it."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def _of(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(n))

    def _digits(self, n: int) -> str:
        return self._of("0123456789", n)

    def _word(self) -> str:
        return "".join(self._of("bcdfghklmnprstvw", 1) + self._of("aeiou", 1) for _ in range(self.rng.randrange(2, 5)))

    _HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def personal(self) -> tuple[str, str]:
        r = self.rng
        pick = r.choice
        kind = r.randrange(10)
        if kind == 0:
            return pick(["SSN ", "ssn: ", "social security number ", "his social is ", "SSN is ", "", "", "id "]), f"{r.randrange(1, 900):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10_000):04d}"
        if kind == 1:
            country, size = pick([("DE", 18), ("GB", 18), ("FR", 23), ("ES", 20), ("NL", 14)])
            body = (self._of("ABCDEFGHIJ", 4) + self._digits(size - 4)) if country in ("GB", "NL") else self._digits(size)
            number = int("".join(str(int(c, 36)) for c in body + country + "00"))
            flat = f"{country}{98 - number % 97:02d}{body}"
            return pick(["IBAN ", "iban: ", "account ", "pay to ", "", "transfer it to "]), pick([flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))])
        if kind == 2:
            a, b, c = r.randrange(200, 990), r.randrange(200, 990), r.randrange(10_000)
            return pick(["call ", "phone: ", "tel ", "Tel. ", "reach me at ", "", "", "mobile ", "fax "]), pick([f"({a}) {b}-{c:04d}", f"{a}-{b}-{c:04d}", f"{a}.{b}.{c:04d}", f"{a} {b} {c:04d}"])
        if kind == 3:
            return pick(["account number ", "acct no. ", "account: ", "acct ", "phone number ", "tel: "]), self._digits(r.randrange(8, 13))
        if kind == 4:
            value = pick([self._word(), f"{self._word()}-{self._word()}-{self._word()}", self._word() + self._digits(r.randrange(1, 5)), "P@" + self._word() + self._digits(2) + "!", self._of(self._B64 + "!#%&", r.randrange(8, 16))])
            lead = pick(["password: ", "password = ", "passwd=", "pwd: ", "the password is ", "secret: ", 'password: "', "passphrase = "])
            return lead, value if not lead.endswith("is ") or any(c in "0123456789!@" for c in value) else value + self._digits(2)
        if kind == 5:
            value = pick(["AKIA" + self._of(self._B64[:26] + "0123456789", 16), "ghp_" + self._of(self._B64, 36), "sk-" + self._of(self._B64, 32), f"xoxb-{self._digits(11)}-{self._of(self._B64, 24)}"])
            return pick(["", "", "key ", "token: ", "api_key=", "use "]), value
        if kind == 6:
            return pick(["aws_secret_access_key = ", "access_key: ", "secret_key=", "api key: ", 'secret = "']), self._of(self._B64 + "/+", 40)
        if kind == 7:
            return pick(['token = "', "api-key: ", "auth token: ", "secret=", "API_KEY=", "access_token: ", "token: "]), self._of(self._HEX, pick([32, 40, 48, 64]))
        if kind == 8:
            return pick(["Bearer ", "token: ", "Authorization: Bearer ", "", "jwt "]), ".".join(["eyJ" + self._of(self._B64, r.randrange(15, 30)), "eyJ" + self._of(self._B64, r.randrange(20, 60)), self._of(self._B64 + "_-", 43)])
        at, dot = pick([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", ".")])
        return pick(["mail ", "contact ", "write to ", "", "reach me at "]), f"{pick([self._word(), self._word() + '.' + self._word(), self._word() + self._digits(2)])}{at}{self._word()}{dot}{pick(['com', 'org', 'net', 'de', 'io'])}"

    def innocent(self) -> tuple[str, str]:
        r = self.rng
        pick = r.choice
        kind = r.randrange(15)
        if kind == 14:
            return pick(["the secret is ", "the token is ", "auth is ", "the password is ", "a secret is "]), pick(["out", "that", "required", "invalid", "the", "safe", "never", "expired", "wrong", self._word()])
        if kind <= 1:
            return pick(["commit ", "sha ", "sha256: ", "revision ", "checksum ", "md5 ", "digest: ", "blob ", "hash ", "at commit ", ""]), self._of(self._HEX, pick([7, 8, 10, 12, 32, 40, 40, 64]))
        if kind == 2:
            return pick(["version ", "release ", "v", "", "build "]), pick([f"{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}", f"{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}-rc{r.randrange(9)}", f"20{self._digits(2)}-{self._digits(4)}", f"{r.randrange(20)}.{self._digits(4)}.{self._digits(3)}"])
        if kind == 3:
            return pick(["on ", "since ", "", "dated "]), pick([f"20{self._digits(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29):02d}/{r.randrange(1, 13):02d}/19{self._digits(2)}", f"{r.randrange(1800, 2000)}-{r.randrange(2000, 2030)}", f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.20{self._digits(2)}"])
        if kind == 4:
            return pick(["about ", "", "of ", "total "]), pick([f"{r.randrange(1, 99)},{self._digits(3)},{self._digits(3)}", f"{r.randrange(1, 99)} {self._digits(3)} {self._digits(3)}", f"{r.randrange(99)}.{self._digits(5)}", self._digits(r.randrange(6, 9)), f"${r.randrange(1, 999)}.{self._digits(2)}"])
        if kind == 5:
            return pick(["ISBN ", "isbn: ", ""]), f"978-{r.randrange(1, 9)}-{self._digits(2)}-{self._digits(6)}-{self._digits(1)}"
        if kind == 6:
            return pick(["order ", "invoice ", "part ", "model ", ""]), pick([f"ORD-{self._digits(5)}-{self._of('ABC', 1)}", f"{self._of('ABCDEF', 2)}{self._digits(2)}-{self._of('ABCDEF', 2)}{self._digits(2)}", f"{self._of('ABCDEF', 3)}-{self._digits(6)}"])
        if kind == 7:
            return pick(["", "in ", "see "]), pick([f"chapter-{self._digits(4)}", f"img_{self._digits(4)}.png", f"route{self._digits(2)}", f"figure{self._digits(1)}_{self._digits(2)}", f"report-20{self._digits(2)}.pdf"])
        if kind == 8:
            h = lambda n: self._of(self._HEX, n)
            return pick(["uuid ", "id ", ""]), f"{h(8)}-{h(4)}-4{h(3)}-a{h(3)}-{h(12)}"
        if kind == 9:
            return pick(["scores ", "", "steps "]), pick([" ".join(self._digits(2) for _ in range(r.randrange(4, 6))), f"{self._digits(1)}-{self._digits(1)} {self._digits(1)}-{self._digits(1)}", f"{self._digits(2)} - {self._digits(2)} {self._digits(2)}"])
        if kind == 10:
            return pick(["tokens = ", "token count: ", "max_tokens: ", "auth: ", "secret: ", "password: ", "token: "]), pick([str(r.randrange(1, 9999)), "required", "none", "true", "null", "yes"])
        if kind == 11:
            return pick(["at ", "see ", ""]), f"{self._word()}.example/20{self._digits(2)}/{r.randrange(1, 13):02d}/{self._word()}"
        if kind == 12:
            return "", pick([f"{self._digits(2)}x{self._digits(2)}mm", f"{self._digits(3)}kHz/{self._digits(2)}bit", f"#{self._of(self._HEX, 6)}", f"x{self._digits(3)}y{self._digits(3)}"])
        return pick(["they met at ", "looked at ", "arrived at "]), f"{self._word()} dot {self._word()}"


def planted(spark: SparkSession, pieces: list[str], n: int, seed: int = 3) -> DataFrame:
    """(row, text, start, end, personal): half of ``n`` rows have a personal value, the others one that only looks so."""
    rng = random.Random(seed)
    plants = _Plants(rng)
    rows = []
    for i in range(n):
        words = rng.choice(pieces).split(" ")
        at = rng.randrange(len(words) + 1)
        lead, value = plants.personal() if i % 2 else plants.innocent()
        left = " ".join([*words[:at], ""]) + lead
        quote = '"' if lead.endswith('"') else ""
        rows.append((i, left + value + rng.choice([quote, quote + "."]) + " " + " ".join(words[at:]), len(left), len(left) + len(value), bool(i % 2)))
    # Dealt out, so that their candidates are found in tasks.
    return given(spark, rows, "row int, text string, start long, end long, personal boolean").repartition(spark.sparkContext.defaultParallelism)


@dataclass
class PiiModel:
    trees: BoostedTrees
    threshold: float


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = SAMPLE_DOCS, plants: int = PLANTS, precision: float = PRECISION) -> PiiModel:
    """Fit on ``plants`` values in pieces of ``docs`` documents, by least hashed id.

    Null, empty and repeated texts do no harm; without any text the model selects nothing.
    """
    text = F.col(text_col).cast("string")
    some = df.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).where(F.length(F.trim("text")) > 0)
    begin = F.pmod(F.xxhash64("id", F.lit(5)), F.greatest(F.length("text") - PIECE, F.lit(1))) + 1
    piece = F.substring(F.col("text"), begin.cast("int"), F.lit(PIECE))
    pieces = [r.piece for r in least_hashed(some.select(piece.alias("piece"), unit_hash("id", "text").alias("h")), F.col("h"), docs, "piece").collect()]
    if not pieces:
        return PiiModel(BoostedTrees(-9.0, []), float("inf"))
    c = F.col("c")
    rows = planted(df.sparkSession, pieces, plants).withColumn("c", F.explode(candidates(F.col("text"))))
    shared = F.greatest(F.least(c["end"], F.col("end")) - F.greatest(c["start"], F.col("start")), F.lit(0))
    covers = shared / (F.greatest(c["end"], F.col("end")) - F.least(c["start"], F.col("start"))) >= 0.8
    label = F.when(shared > 0, (F.col("personal") & covers).cast("double")).when(~_doubtful(c["value"], c["before"]), 0.0)
    made = features(c["value"], c["before"])
    numbers = [F.col("row"), c["start"], c["end"], label.alias("y"), *made]
    got = rows.select(F.concat_ws(" ", *(n.cast("double").cast("string") for n in numbers)).alias("v"), label.alias("y")).where("y is not null").select("v")
    # A row of numbers as one string: candidates of PLANTS short texts, in as little memory as they need.
    table = np.array([np.fromstring(r.v, sep=" ") for r in got.toLocalIterator()]).reshape(-1, 4 + len(made))
    table = table[np.lexsort(table.T[::-1])]
    x, y = table[:, 4:], table[:, 3]
    # Pairs of rows take turns, so that either half has plants of both kinds.
    half = table[:, 0] // 2 % 2 == 0
    trees = boost(x[half], y[half], rounds=24, depth=4)
    score, truth = trees.score(x[~half]), y[~half]
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(hits >= precision)
    return PiiModel(trees, float(score[order[good[-1]]]) if len(good) else float("inf"))


_PICKED = "array<struct<start:bigint,end:bigint,rank:struct<loss:double,short:bigint,start:bigint>,ord:int>>"


def _chosen(picked: Column) -> Column:
    """Of ``_PICKED`` spans those that the least ``rank`` keeps: in order of ranks, each that overlaps none kept before it.

    A sweep in order of starts holds one span; one that overlaps it takes its place if its rank is less, else goes; one
    that does not lets it out. All spans that overlap an earlier one overlap what starts between the two, so what comes out
    has no better span left beside it. What overlaps nothing that came out is swept again.
    """
    item = _PICKED[len("array<") : -1]

    def step(held, x):
        free = held.isNull() | (held["end"] <= x["start"])
        return F.when(free | (x["rank"] < held["rank"]), x).otherwise(held), F.when(free, held)

    def sweep(left):
        return _gathered(left, F.lit(None).cast(item), step, _PICKED, lambda held: F.array(held))

    def again(acc, _):
        out = lambda best: F.struct(_apart(acc["left"], best).alias("left"), F.concat(acc["kept"], best).alias("kept"))
        return F.when(F.size(acc["left"]) > 0, _let(sweep(acc["left"]), out)).otherwise(acc)

    def grown(held, x):
        """(end, spans) of what hangs together, given out where the next span lies apart."""
        free = held.isNull() | (held["end"] <= x["start"])
        more = F.struct(F.greatest(held["end"], x["end"]).alias("end"), (held["n"] + 1).alias("n"))
        return F.when(free, F.struct(x["end"].alias("end"), F.lit(1).alias("n"))).otherwise(more), F.when(free, held["n"])

    def rounds(p):
        # A sweep settles one or more of each set of spans that hang together, so the largest bounds the sweeps. They go
        # by groups, which are passed over when nothing is left.
        largest = F.array_max(_gathered(p, F.lit(None).cast("struct<end:bigint,n:int>"), grown, "array<int>", lambda held: F.array(held["n"])))
        times = F.transform(F.array(largest), lambda n: F.sequence(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int")))[0]
        state = F.struct(p.alias("left"), F.array().cast(_PICKED).alias("kept"))
        return _let(times, lambda ts: F.aggregate(ts, state, lambda acc, _: F.when(F.size(acc["left"]) > 0, F.aggregate(ts, acc, again)).otherwise(acc), lambda acc: acc["kept"]))

    return _let(F.sort_array(picked), lambda p: F.when(F.size(p) > 1, rounds(p)).otherwise(p))


def _picked(text: Column, base: Column, model: PiiModel) -> Column:
    """The candidates that the trees select and no base span overlaps."""
    if not model.trees.trees or model.threshold == float("inf"):
        return F.array().cast(_PICKED)
    count = len(features(F.lit(""), F.lit("")))

    def scored(c):
        described = F.struct(*(f.alias(f"f{i}") for i, f in enumerate(features(c["value"], c["before"]))))
        score = _let(described, lambda d: model.trees.expression([d[f"f{i}"] for i in range(count)]))
        rank = F.struct((-score).alias("loss"), (c["start"] - c["end"]).alias("short"), c["start"].alias("start"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), rank.alias("rank"), c["value"].alias("value"))

    kept = F.filter(F.transform(_apart(candidates(text), base), scored), lambda c: c["rank"]["loss"] <= -model.threshold)
    return F.transform(kept, lambda c: F.struct(c["start"], c["end"], c["rank"], _kind(c["value"]).alias("ord"))).cast(_PICKED)


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["ord"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _spanned(df: DataFrame, text: Column, model: PiiModel) -> DataFrame:
    """The columns of ``df`` as c0, c1 and so on, the ``text``, its base spans as ``base`` and all spans as ``spans``."""
    own = (F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))
    found = df.select(*own, text.alias("text"))
    found = found.withColumn("base", F.when(F.col("text").isNotNull(), base_spans(F.col("text"))).otherwise(F.array().cast(_SPAN)))
    picked = F.when(F.col("text").isNotNull(), _picked(F.col("text"), F.col("base"), model)).otherwise(F.array().cast(_PICKED))
    added = F.transform(_chosen(F.col("picked")), lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end")))
    return found.withColumn("picked", picked).withColumn("spans", F.sort_array(F.concat("base", added))).drop("picked")


def find_pii(df: DataFrame, model: PiiModel, text_col: str = "text", base_col: str = "pii_base", spans_col: str = "pii_spans") -> DataFrame:
    """``df`` with two arrays of (start, ord, end), by start, then kind: base spans and all spans.

    ``ord`` is the place in ``KINDS``; code points, end exclusive. A null or empty text has empty arrays. Equal texts
    have equal spans; repeated rows stay; an empty table gives an empty one. A column that has one of the two names is an error.
    """
    for c in (base_col, spans_col):
        if c in df.columns:
            raise ValueError(f"the table has a column {c} of its own")
    found = _spanned(df, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), model)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)), F.col("base").alias(base_col), F.col("spans").alias(spans_col))


#: Code points of a part of a text in redaction.
_PART = 4096


def _joined_up(spans: Column) -> Column:
    """Spans that overlap as one, named by the first; so starts and ends rise."""
    item = _SPAN[len("array<") : -1]

    def join(held, s):
        free = held.isNull() | (held["end"] <= s["start"])
        longer = F.struct(held["start"].alias("start"), held["ord"].alias("ord"), F.greatest(held["end"], s["end"]).alias("end"))
        return F.when(free, s).otherwise(longer), F.when(free, held)

    return F.when(F.size(spans) > 1, _gathered(spans, F.lit(None).cast(item), join, _SPAN, lambda held: F.array(held))).otherwise(spans)


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans, which do not overlap, as kinds in brackets, part by part, so that no growing text is copied for each span.

    A part finds its own spans by halving.
    """
    sides = F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), F.transform(spans, lambda s: s["end"]).alias("ends"))
    return _let(sides, lambda e: _in_parts(text, spans, e["starts"], e["ends"]))


def _in_parts(text: Column, spans: Column, starts: Column, ends: Column) -> Column:
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def part(c, j):
        low = (j * _PART).cast("bigint")

        def step(acc, s):
            head = F.concat(acc["out"], F.substring(c, (acc["at"] - low + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")))
            # A span that began in an earlier part, or inside another one, has no name here.
            out = F.when(s["start"] >= acc["at"], F.concat(head, F.element_at(kinds, s["ord"] + 1))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        first = F.struct(low.alias("at"), F.lit("").alias("out"))
        masked = lambda own: F.aggregate(own, first, step, lambda acc: F.concat(acc["out"], F.substring(c, (acc["at"] - low + 1).cast("int"), F.lit(_PART))))
        before = _below(ends, low + 1)
        own = _let(before, lambda k: F.slice(spans, k + 1, _below(starts, low + _PART) - k))
        return _let(own, lambda o: F.when(F.size(o) > 0, masked(o)).otherwise(c))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), part), "")


def redact(df: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``df`` with every span of the text replaced by its kind in brackets; overlapping spans are one, named by the first.

    A text without spans, a null one included, is left as it is; so are all other columns, whatever their names. Equal texts
    are redacted alike; repeated rows stay; an empty table gives an empty one.
    """
    text = F.col(f"`{text_col}`").cast("string")
    worth = F.when(_worth(text) | F.contains(text, F.lit("@")), text)
    found = _spanned(df.withColumns({text_col: text}) if df.schema[text_col].dataType.simpleString() != "string" else df, worth, model)
    found = found.withColumn("spans", _joined_up(F.col("spans")))
    names = {c: F.col(f"c{i}") for i, c in enumerate(df.columns)}
    clean = F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans"))).otherwise(names[text_col])
    return found.select(*((clean if c == text_col else own).alias(c) for c, own in names.items()))


def pii_report(df: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of every row; other columns are ignored.

    A null text counts as empty: no spans, and the digest of an empty string. Repeated rows stay; an empty table gives an empty result.
    """
    found = find_pii(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        F.col("id").alias(id_col), *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"),
        (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_added"), F.size("pii_spans").cast("long").alias("n_spans"),
    )
