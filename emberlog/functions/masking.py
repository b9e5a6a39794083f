"""Masking of secrets and personal data as chained regular expressions (JVM side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: the replacement, field names whose value is always masked, shapes of secrets --------------------------
REDACTED = "***REDACTED***"
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "token", "access_token", "refresh_token", "id_token", "api_key", "apikey", "api-key", "authorization", "auth",
    "proxy-authorization", "cookie", "set-cookie", "session", "session_id", "sessionid", "private_key", "client_secret", "credit_card", "card_number", "cvv", "ssn", "otp", "x-api-key",
)
_KEYS = "|".join(k.replace("-", "\\-") for k in sorted(SENSITIVE, key=lambda k: (-len(k), k)))
RULES = {
    "authorization_header": (r"(?i)\b(authorization\s*[:=]\s*)(bearer|basic|token)?\s*[A-Za-z0-9._\-+/=]{8,512}", r"$1"),
    "sensitive_kv": (rf"(?i)\b({_KEYS})(\"?\s*[:=]\s*\"?)([^\"'\s,;&}}\]]{{1,512}})", r"$1$2"),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{4,2048}\.[A-Za-z0-9_-]{4,4096}\.[A-Za-z0-9_-]{0,2048}\b", ""),
    "vendor_key": (r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|xox[baprs]-[A-Za-z0-9-]{10,255}|sk_(?:live|test)_[A-Za-z0-9]{16,255}|AIza[0-9A-Za-z_-]{35})\b", ""),
    "private_key_block": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]{0,8192}?-----END [A-Z ]{0,40}PRIVATE KEY-----", ""),
    "credit_card": (r"\b(?:\d[ -]?){13,19}\b", ""),
    "email": (r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}\b", ""),
    "phone": (r"(?<![\w.])\+?\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?![\w.])", ""),
}
DEFAULT_RULES = ("authorization_header", "sensitive_kv", "jwt", "vendor_key", "private_key_block", "email")
# ------------------------------------------------------------------------------------------------------------------------


USUAL = (":", "=")  # most structured lines hold one of these
#: what a text must hold for a rule to match: literal pieces, any of them (rules of digits alone have none)
HINTS = {
    "authorization_header": USUAL,
    "sensitive_kv": USUAL,
    "jwt": ("eyJ",),
    "vendor_key": ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_", "AIza"),
    "private_key_block": ("PRIVATE KEY-----",),
    "email": ("@",),
}


def _known(rules) -> list[str]:
    """The named rules in the order of RULES; an unknown name is an error."""
    if unknown := sorted(set(rules) - set(RULES)):
        raise ValueError(f"unknown masking rules: {', '.join(unknown)}")
    return [n for n in RULES if n in rules]


def _hinted(text: Column, names: list[str]) -> Column:
    """Whether any of the rules can match, by plain substring search."""
    if any(n not in HINTS for n in names):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in dict.fromkeys(h for n in names for h in HINTS[n])])


def mask_text(text: Column, rules=DEFAULT_RULES, most: int | None = None) -> Column:
    """Every rule's matches replaced, in the order of RULES, over the whole text.

    With ``most``, only so many characters are masked and shown, followed by a mark that counts the rest.
    """
    names = _known(rules)
    if not names:
        return text
    if most is not None:
        rest = F.length(text) - most
        return F.concat(mask_text(F.left(text, F.lit(most)), rules), F.when(rest > 0, F.concat(F.lit("...[truncated "), rest.cast("string"), F.lit(" chars]"))).otherwise(""))
    masked = lambda some: reduce(lambda t, name: F.regexp_replace(t, RULES[name][0], RULES[name][1] + REDACTED.replace("$", "\\$")), some, text)
    usual = [n for n in names if HINTS.get(n) == USUAL]
    rare = [n for n in names if n not in usual]
    if usual and rare:  # a replacement brings no hint of another rule, so the text as it came tells which rules can match
        return F.when(_hinted(text, rare), masked(names)).when(_hinted(text, usual), masked(usual)).otherwise(text)
    return F.when(_hinted(text, names), masked(names)).otherwise(text)


def contains_sensitive(text: Column, rules=DEFAULT_RULES) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [_hinted(text, [n]) & text.rlike(RULES[n][0]) for n in _known(rules)]), F.lit(False))


def mask_map(values: Column, rules=DEFAULT_RULES, extra: tuple[str, ...] = ()) -> Column:
    """A string map with sensitive keys' values replaced and other values masked as text."""
    names = [*SENSITIVE, *extra]
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*names), F.lit(REDACTED)).otherwise(mask_text(v, rules)))
