"""Personal-data patterns as ordered passes, and the expressions that count and mask their matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.text import WORD

EMAIL_TAG = "[EMAIL_REDACTED]"
PHONE_TAG = "[PHONE_REDACTED]"
PII_TAG = "[PII_REDACTED]"
TAGS = (EMAIL_TAG, PHONE_TAG, PII_TAG)
TYPES = ("email", "phone", "credit_card", "ssn", "ip_address", "person")

# What each pass looks for.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
SSN = r"(?<![\d-])(?!000|666|9\d\d)\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
IPV6 = r"(?<![\w:])(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}(?![\w:])"
PHONE_NANP = r"(?<![\w.])(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-]?)\d{3}[\s.\-]?\d{4}(?![\w])"
PHONE_INTL = r"(?<![\w.])\+\d{1,3}(?:[\s.\-]?\(?\d{1,5}\)?){2,5}(?![\w])"
PHONE_FIVE = r"(?<![\w.])[6-9]\d{4}[\s\-]?\d{5}(?![\w])"
LENIENT_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
LENIENT_SSN = r"(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"
LENIENT_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"

_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _unicode_classes(pattern: str) -> str:
    """Word and space classes over all of Unicode; digits stay ASCII."""
    spelled = pattern.replace(r"\)\s?", rf"\)[{_SPACE}]?")
    return spelled.replace(r"[\s", "[" + _SPACE).replace(r"\w", WORD)


@dataclass(frozen=True)
class Pass:
    """One masking pass.

    ``gate`` is a cheap test that every match of ``pattern`` implies: a regular expression, or a plain
    substring when ``plain_gate`` is set. Rows that fail it skip the costly pattern.
    """

    kind: str
    tag: str
    pattern: str
    gate: str
    plain_gate: bool = False
    digits: tuple[int, int] | None = None
    luhn: bool = False

    @property
    def conditional(self) -> bool:
        return self.digits is not None or self.luhn

    @property
    def regex(self) -> str:
        return _unicode_classes(self.pattern)

    def may_match(self, text: Column) -> Column:
        return text.contains(self.gate) if self.plain_gate else text.rlike(self.gate)

    def accepts(self, match: Column) -> Column:
        if self.luhn:
            return luhn_ok(match)
        if self.digits is not None:
            n = F.length(F.regexp_replace(match, "[^0-9]", ""))
            return n.between(*self.digits)
        return F.lit(True)

    def matches(self, text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(self.regex), F.lit(0))
        return F.filter(found, self.accepts) if self.conditional else found

    def count(self, text: Column) -> Column:
        return F.when(self.may_match(text), F.size(self.matches(text))).otherwise(F.lit(0))

    def mask(self, text: Column) -> Column:
        if not self.conditional:
            masked = F.regexp_replace(text, self.regex, self.tag)
        else:
            # Text between matches and the matches themselves, sewn together again; only accepted ones change.
            between = F.split(text, self.regex, -1)
            found = F.regexp_extract_all(text, F.lit(self.regex), F.lit(0))
            sewn = F.zip_with(
                between,
                found,
                lambda gap, m: F.concat(
                    gap, F.when(m.isNull(), F.lit("")).when(self.accepts(m), F.lit(self.tag)).otherwise(m)
                ),
            )
            masked = F.array_join(sewn, "")
        return F.when(self.may_match(text), masked).otherwise(text)


def luhn_ok(number: Column) -> Column:
    """Luhn checksum over the ASCII digits of a 13 to 19 digit number."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    reversed_digits = F.split(F.reverse(digits), "")
    weighed = F.transform(
        reversed_digits,
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)
        ),
    )
    total = F.aggregate(weighed, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


_CARD_GATE = r"(?:\d[ -]?){13}"

STRICT = (
    Pass("email", EMAIL_TAG, EMAIL, "@", plain_gate=True),
    Pass("ssn", PII_TAG, SSN, r"\d{2}[- ]\d{4}"),
    Pass("credit_card", PII_TAG, CARD, _CARD_GATE, luhn=True),
    Pass("ip_address", PII_TAG, IPV4, r"\d\.\d"),
    Pass("ip_address", PII_TAG, IPV6, r"[A-Fa-f0-9]:[A-Fa-f0-9]{1,4}:[A-Fa-f0-9]"),
    Pass("phone", PHONE_TAG, PHONE_NANP, r"\d{4}", digits=(10, 13)),
    Pass("phone", PHONE_TAG, PHONE_INTL, r"\+\d", digits=(8, 15)),
    Pass("phone", PHONE_TAG, PHONE_FIVE, r"[6-9]\d{4}", digits=(10, 10)),
)

LENIENT = (
    Pass("email", EMAIL_TAG, LENIENT_EMAIL, "@", plain_gate=True),
    Pass("ssn", PII_TAG, LENIENT_SSN, r"\d{2}[- ]\d{4}"),
    Pass("credit_card", PII_TAG, CARD, _CARD_GATE),
    Pass("ip_address", PII_TAG, LENIENT_IP, r"\d\.\d"),
    Pass("phone", PHONE_TAG, PHONE_NANP, r"\d{4}"),
    Pass("phone", PHONE_TAG, PHONE_FIVE, r"[6-9]\d{4}"),
)

PROFILES = {"strict": STRICT, "lenient": LENIENT}
