"""Stable tokens that stand for values: salted SHA-256, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token looks like, and how many hex digits of the digest it has.
PREFIXES = {"address": ("ADDRESS_", 8), "city": ("CITY_", 8), "name": ("NAME_", 8), "org": ("ORG_", 8), "text": ("TEXT_", 10)}
KINDS = ("email", "phone", *sorted(PREFIXES))
#: E-mail addresses within a text; they begin where a run of such characters does, or the last one ended.
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
#: White space, and telephone numbers within a text.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
PHONE = rf"\+?[0-9][0-9{SPACES}().-]{{6,}}[0-9]"
#: The text up to its last sign or white space, and digits after it: a number counts only if such a character stands in
#: it or anywhere behind it.
SIGNED = rf"^([\s\S]*[+{SPACES}().-][0-9]*)"


class SaltError(ValueError):
    """Masking needs a salt that isn't blank."""


def salt_of(salt: str | None) -> str:
    if not (salt or "").strip():
        raise SaltError("ANON_HASH_SALT missing: deterministic anonymization requires an explicit stable secret.")
    return salt.strip()


def digest(salt: str, key: str, value: Column, length: int) -> Column:
    return F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}|{key}|"), value), 256), 1, length))


def phone(salt: str, key: str, value: Column) -> Column:
    return F.concat(F.lit("+39"), F.translate(digest(salt, key, value, 10), "ABCDEF", "012345"))


def email(salt: str, key: str, value: Column) -> Column:
    return F.concat(F.lit("user_"), F.lower(digest(salt, key, value, 10)), F.lit("@example.invalid"))


def masked(kind: str, salt: str, key: str, value: Column) -> Column:
    """The token of a value of a kind; null for null. key: the column's normalized name."""
    salt, value = salt_of(salt), value.cast("string")
    if kind == "email":
        return email(salt, key, value)
    if kind == "phone":
        return phone(salt, key, value)
    prefix, length = PREFIXES[kind]
    return F.concat(F.lit(prefix), digest(salt, key, value, length))


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced_inline(value: Column, pattern: str, token: Callable[[Column], Column], kept: Callable[[Column], Column] | None = None) -> Column:
    """The text with each match of the pattern replaced by token(match): the parts between matches, and tokens between
    them. kept(match): whether the last match stays, if it ends the text."""

    def joined(x: Column) -> Column:
        found, parts = x["found"], x["parts"]

        def one(match: Column, k: Column) -> Column:
            behind = F.get(parts, k + 1)
            stays = F.lit(False) if kept is None else (k == F.size(found) - 1) & (behind == "") & kept(match)
            return F.concat(F.when(stays, match).otherwise(token(match)), behind)

        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(found, one), ""))

    return with_value(F.struct(F.split(value, pattern, -1).alias("parts"), F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("found")), joined)


def inline(salt: str, value: Column) -> Column:
    """The text with e-mail addresses, then telephone numbers, replaced by tokens of their own. Time grows with the
    length of a text: no pattern looks farther than its match."""
    salt = salt_of(salt)

    def addresses(text: Column) -> Column:
        return F.when(text.contains("@"), replaced_inline(text, EMAIL, lambda m: email(salt, "inline_email", m))).otherwise(text)

    def bare(match: Column) -> Column:  # of bare digits only those at the very end have no sign behind them
        return match.rlike(r"^[0-9]+\z")

    def numbers(text: Column) -> Column:
        return with_value(F.regexp_extract(text, SIGNED, 1), lambda signed: F.concat(replaced_inline(signed, PHONE, lambda m: phone(salt, "inline_phone", m), bare), F.substring(text, F.length(signed) + 1, F.length(text))))

    return with_value(value, lambda v: with_value(addresses(v), numbers))
