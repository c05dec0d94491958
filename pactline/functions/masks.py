"""Value transforms for sensitive fields and the name-based detector."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline import types as t

# The replacement text, and keyword groups of which the first hit decides.
REDACTED = "[REDACTED]"
TOKEN_PREFIX = "tok_"
TOKEN_HEX_DIGITS = 32
PII_KEYWORDS = (
    (t.PERSONAL, ("email", "e_mail")),
    (t.PERSONAL, ("phone", "mobile", "cell_number")),
    (t.PERSONAL, ("first_name", "last_name", "full_name", "display_name")),
    (t.FINANCIAL, ("card_number", "card_num", "pan", "credit_card")),
    (t.FINANCIAL, ("account_id", "account_number", "iban", "routing_number")),
    (t.IDENTIFIER, ("ssn", "social_security", "national_id", "passport")),
    (t.HEALTH, ("diagnosis", "condition", "medication", "patient_id")),
    (t.PERSONAL, ("ip_address", "device_id", "user_agent")),
)


def redact(value: Column) -> Column:
    """Any value becomes the fixed text; NULL stays NULL."""
    return F.when(value.isNotNull(), F.lit(REDACTED))


def mask(value: Column, ch: str = "*", keep: int = 4) -> Column:
    """Hide all but the last ``keep`` code points; short values are hidden completely."""
    size = F.length(value)
    hidden = F.repeat(F.lit(ch), size - F.lit(keep))
    tail = F.right(value, F.lit(keep))
    return F.when(size <= keep, F.repeat(F.lit(ch), size)).otherwise(F.concat(hidden, tail))


@dataclass(frozen=True)
class TokenKey:
    """The two HMAC-SHA256 pads of a secret; the secret itself is not kept."""

    ipad: bytes = field(repr=False)
    opad: bytes = field(repr=False)

    @classmethod
    def from_secret(cls, secret: str | bytes) -> TokenKey:
        raw = secret.encode() if isinstance(secret, str) else secret
        if len(raw) > 64:
            raw = hashlib.sha256(raw).digest()
        block = raw.ljust(64, b"\0")
        return cls(bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block))


def token_keys(spark: SparkSession, secrets: dict[str, str | bytes]) -> DataFrame:
    """(key_id, ipad, opad): key material as table rows, so that no plan shows it."""
    rows = []
    for key_id, secret in secrets.items():
        key = TokenKey.from_secret(secret)
        rows.append((key_id, bytearray(key.ipad), bytearray(key.opad)))
    return spark.createDataFrame(rows, "key_id string, ipad binary, opad binary")


def hmac_sha256(message: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 as hex, from the key's two pads: two passes of the built-in digest."""
    inner = F.unhex(F.sha2(F.concat(ipad, message), 256))
    return F.sha2(F.concat(opad, inner), 256)


def tokenize(
    value: Column,
    namespace: Column,
    key: TokenKey | None = None,
    *,
    pads: tuple[Column, Column] | None = None,
    prefix: str = TOKEN_PREFIX,
) -> Column:
    """A stable token of ``value`` within ``namespace``; equal inputs stay joinable."""
    if pads is None:
        if key is None:
            raise ValueError("tokenize needs a key or its pads")
        pads = (F.lit(bytearray(key.ipad)), F.lit(bytearray(key.opad)))
    message = F.concat(
        F.to_binary(namespace, F.lit("utf-8")),
        F.lit(bytearray(b"\0")),
        F.to_binary(value, F.lit("utf-8")),
    )
    digest = hmac_sha256(message, *pads)
    return F.concat(F.lit(prefix), F.left(digest, F.lit(TOKEN_HEX_DIGITS)))


_ANY_KEYWORD = "|".join(word for _, words in PII_KEYWORDS for word in words)


def looks_sensitive(path: Column) -> Column:
    """Does any keyword occur? A cheap first test where most names are harmless."""
    return F.lower(path).rlike(_ANY_KEYWORD)


def detect_pii(path: Column) -> Column:
    """Sensitivity class suggested by a field name, NULL when nothing matches."""
    lowered = F.lower(path)

    def extend(chain: Column | None, group: tuple[str, tuple[str, ...]]) -> Column:
        label, words = group
        hit = reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
        return F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))

    return reduce(extend, PII_KEYWORDS, None)
