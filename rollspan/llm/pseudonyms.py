"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A found value is validated (check digits, ranges, calendar), read as a number in its
format's domain, permuted there by a keyed Feistel network with cycle walking and
written back in the same layout: cards stay valid cards, dates valid dates. The
permutation depends on key, kind and format only, so equal values get equal pseudonyms
in every document, whatever their separators, and different ones stay different.

Kinds: secret (named assignment; its value has a digit or eight signs), key (with an
issuer's prefix), email, iban, date, ip (both versions), phone (also with a country code,
or ten digits after a word such as tel), ssn, card. Candidates that fail validation are
left alone, dotted numbers after a word such as version too. Null and empty texts stay as they are; repeated
rows are treated alike; all other columns pass through.
"""

import datetime
import functools
import hashlib
import ipaddress
import re
import string

import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollspan.llm import worker
from rollspan.llm.tokens import slices

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"""
    (?P<secret>(?P<name>(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))
        (?P<eq>["']?\s*[=:]\s*["']?)
        (?P<value>(?=[^\s"',;<>()\[\]{}|]*\d)[^\s"',;<>()\[\]{}|]{5,}|[A-Za-z0-9_\-+/]{8,}))
  | (?P<key>(?:(?<![A-Z0-9])A[KS]IA|(?<![A-Za-z0-9])(?:ghp_|gho_|github_pat_|sk-|xox[abp]-))(?P<rest>[A-Za-z0-9_-]{16,}))
  | (?P<email>(?<![\w.+-])(?P<local>[A-Za-z0-9][\w.+-]{0,63})@(?P<host>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}))
  | (?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
  | (?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d))
  | (?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))
  | (?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:.]))
  | (?P<tel>\b(?i:tel|phone|mobile|cell|call|fax)[^\w\n]{0,3}(?P<line>\d{10})(?!\d))
  | (?P<abroad>(?<![\d+])\+(?!1\b)[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d))
  | (?P<phone>(?<![\d-])(?:\+?1[ .-]?)?(?:\(\d{3}\)\ ?\d{3}[-.]|\d{3}(?P<s3>[-. ])\d{3}(?:(?P=s3)|[-.]))\d{4}(?!\d))
  | (?P<ssn>(?<![\d-])\d{3}(?P<s2>[- ])\d{2}(?P=s2)\d{4}(?![\d-]))
  | (?P<card>(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\g<-1>\d{4}\g<-1>\d{4}|\d{4}([ -])\d{6}\g<-1>\d{5})(?!\d))
    """.replace(r"([ -])\d{4}\g<-1>\d{4}\g<-1>\d{4}", r"(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{4}")
    .replace(r"([ -])\d{6}\g<-1>\d{5}", r"(?P<s6>[ -])\d{6}(?P=s6)\d{5}"),
    re.VERBOSE,
)
_DIGIT = re.compile(r"[0-9@]")
# How issuers begin their access keys, as in the pattern above.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "xox")


def _may_hold(text):
    """Every kind has a digit or an at sign, or is an assignment or an issued key."""
    if "=" in text or ":" in text or _DIGIT.search(text) is not None:
        return True
    return any(prefix in text for prefix in PREFIXES)



def session_key(spark):
    """The key named by `spark.rollspan.pseudonym.key`; the default is no secret."""
    return spark.conf.get("spark.rollspan.pseudonym.key", "set spark.rollspan.pseudonym.key").encode()


class Permutation:
    """A keyed bijection of range(n) per kind and format."""

    def __init__(self, key):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak, turn, value, side):
        data = f"{tweak}|{turn}|{value}|{side}".encode()
        code = hashlib.blake2b(data, key=self.key, digest_size=32).digest()
        return int.from_bytes(code, "little") % side

    def __call__(self, kind, value, n):
        """The image of value; walks the cycle until it is in range(n)."""
        side = 1
        while side * side < n:
            side *= 2
        low, high = 1, side
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if mid * mid >= n else (mid + 1, high)
        side, tweak = low, f"{kind}:{n}"
        while True:
            left, right = divmod(value, side)
            for turn in range(ROUNDS):
                left, right = right, (left + self._round(tweak, turn, right, side)) % side
            value = left * side + right
            if value < n:
                return value


def _alphabet(c, hexadecimal):
    if hexadecimal:
        return "0123456789abcdef"
    for letters in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        if c in letters:
            return letters
    return None


def permute_text(permutation, kind, text):
    """Permute letters and digits within their own classes; other signs stay."""
    hexadecimal = kind == "secret" and re.fullmatch("[0-9a-f]+", text) and re.search("[a-f]", text)
    sets = [_alphabet(c, hexadecimal) for c in text]
    value, n = 0, 1
    for c, letters in zip(text, sets):
        if letters:
            value, n = value * len(letters) + letters.index(c), n * len(letters)
    shape = "".join(c if s is None else str(len(s)) for c, s in zip(text, sets))
    value = permutation(f"{kind}:{shape}", value, n)
    out = []
    for c, letters in zip(reversed(text), reversed(sets)):
        if letters:
            value, i = divmod(value, len(letters))
            c = letters[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_sum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total


def _spread(layout, digits):
    """Digits written into the digit places of a layout."""
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in layout)


def _card(p, text):
    digits = re.sub(r"\D", "", text)
    if luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = str(p(f"card:{n}", int(digits[:-1]), 10**n)).zfill(n)
    return _spread(text, body + str(-luhn_sum(body + "0") % 10))


def _phone(p, text):
    digits = re.sub(r"\D", "", text)
    country, digits = digits[:-10], digits[-10:]
    area, exchange = int(digits[:3]), int(digits[3:6])
    if area < 200 or exchange < 200:  # a domain of its own: assigned numbers stay assigned ones
        place = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
        value = p("phone", place * 10_000 + int(digits[6:]), (1000 * 1000 - 800 * 800) * 10_000)
        place, line = divmod(value, 10_000)
        area, exchange = divmod(place, 1000) if place < 200_000 else divmod(place - 160_000, 200)
        return _spread(text, f"{country}{area:03d}{exchange:03d}{line:04d}")
    value = ((area - 200) * 800 + exchange - 200) * 10_000 + int(digits[6:])
    value = p("phone", value, 800 * 800 * 10_000)
    rest, line = divmod(value, 10_000)
    area, exchange = divmod(rest, 800)
    return _spread(text, f"{country}{area + 200}{exchange + 200}{line:04d}")


def _ip(p, text):
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = p("ip", int.from_bytes(bytes(parts), "big"), 2**32)
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def _ip6(p, text):
    """An address with at least four groups or eight hexadecimal digits, else no address."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if len(text.replace(":", "")) < 8 and sum(map(bool, text.split(":"))) < 4:
        return None
    return ipaddress.IPv6Address(p("ip6", int(address), 2**128)).compressed


def _abroad(p, text):
    """A number with a country code: the first group stays, the other digits are permuted."""
    head = re.match(r"\+\d+", text)[0]
    if re.fullmatch(r"\+\d+", text):
        head = text[:3]
    rest = re.sub(r"\D", "", text[len(head) :])
    if not 8 <= len(rest) + len(head) - 1 <= 15 or len(rest) < 6:
        return None
    value = str(p(f"abroad:{head}:{len(rest)}", int(rest), 10 ** len(rest))).zfill(len(rest))
    return head + _spread(text[len(head) :], value)


def _ssn(p, text):
    area, group, serial = (int(x) for x in re.split("[- ]", text))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    place = area - 1 - (area > 666)
    value = p("ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    rest, serial = divmod(value, 9999)
    place, group = divmod(rest, 99)
    area = place + 1 + (place >= 665)
    return _spread(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _date(p, text):
    form = "%Y-%m-%d" if text[4] == "-" else "%d.%m.%Y" if text[2] == "." else None
    for pattern in [form] if form else ["%d/%m/%Y", "%m/%d/%Y"]:
        try:
            day = datetime.datetime.strptime(text, pattern).date().toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            day = p("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1)
            return datetime.date.fromordinal(day + FIRST_DAY).strftime(pattern)
    return None


def _iban(p, text):
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_text(p, "iban", plain[4:])
    check = 98 - number(body + plain[:2] + "00") % 97
    following = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(" " if c == " " else next(following) for c in text)


PART = {"secret": "value", "key": "rest", "tel": "line"}  # the part of a match that is replaced
SHOWN = {"tel": "phone", "abroad": "phone", "ip6": "ip"}
# Words before a dotted number that make it a version.
VERSION = ("version", "ver", "v", "release", "build")
VALIDATED = {"card": _card, "phone": _phone, "tel": _phone, "abroad": _abroad, "ip6": _ip6, "ip": _ip, "ssn": _ssn, "date": _date, "iban": _iban}


@functools.lru_cache(maxsize=4)
def replacer(key):
    """A function text -> (text with pseudonyms, kinds in order of their places)."""
    permutation = Permutation(key)

    @functools.lru_cache(maxsize=50_000)
    def pseudonym(kind, text):
        if kind == "email":
            local, _, host = text.partition("@")
            return permute_text(permutation, "email", local) + "@" + permute_text(permutation, "host", host.rpartition(".")[0]) + "." + host.rpartition(".")[2]
        if kind in ("secret", "key"):
            return permute_text(permutation, kind, text)
        return VALIDATED[kind](permutation, text)

    def replace(text):
        kinds = []
        if not text or not _may_hold(text):
            return text, kinds

        def one(match):
            kind = next(k for k in ("secret", "key", "email", *VALIDATED) if match[k])
            found = match[PART[kind]] if kind in PART else match[0]
            if kind == "ip" and match.string[max(0, match.start() - 10) : match.start()].lower().rstrip(" .:").endswith(VERSION):
                return match[0]
            out = pseudonym(kind, found)
            if out is None:
                return match[0]
            kinds.append(SHOWN.get(kind, kind))
            return match[0][: -len(found)] + out if kind in PART else out

        return PATTERN.sub(one, text), kinds

    return replace


def pseudonymise(docs, key, text="text", kinds="pii_kinds"):
    """All columns of docs, the text with pseudonyms, and the list of replaced kinds.

    A column of docs that is already called `kinds` is replaced.
    """
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != kinds]
    )
    names, place = [*rows.columns, kinds], rows.columns.index(text)

    def run(batches):
        worker.enter("pseudonyms")
        worker.keep("pseudonyms", replacer.cache_clear)
        replace = replacer(key)
        for batch in batches:
            for lo, hi in slices(batch, column=place):
                part = batch.slice(lo, hi - lo)
                done = [replace(t) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array([d[0] for d in done], pa.string())
                columns.append(pa.array([d[1] for d in done], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        worker.release()

    schema = T.StructType([*rows.schema.fields, T.StructField(kinds, T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, schema)
