"""Company-level contact data in text: addresses, phones, register and VAT numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col
from .text import clear_email, squash

#: Mailbox names that belong to a role, not to a person.
ROLE_MAILBOXES = "info office kontakt contact hello mail post service support sales team admin privacy datenschutz presse press jobs".split()
#: VAT number shapes that are certain by themselves.
VAT_SHAPES = {"DE": r"DE ?[0-9]{9}", "AT": r"ATU ?[0-9]{8}", "FR": r"FR ?[0-9A-Z]{2} ?[0-9]{9}", "CH": r"CHE-?[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}", "NL": r"NL ?[0-9]{9}B[0-9]{2}"}
#: Legal forms, longer ones first.
LEGAL_FORMS = [("GmbH & Co. KG", r"gmbh *& *co\.? *kg"), ("GmbH", r"\bgmbh\b"), ("UG (haftungsbeschränkt)", r"\bug\b"), ("AG", r"\bag\b"), ("SAS", r"\bs\.?a\.?s\b"), ("SARL", r"\bs\.?a\.?r\.?l\b"), ("Ltd", r"\b(ltd|limited)\b"), ("LLC", r"\bllc\b"), ("Inc", r"\binc\b")]


def emails(text) -> Column:
    """Addresses in the text, de-obfuscated, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(clear_email(text), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1), F.lower))


def is_role_email(email, site: str | None = None) -> Column:
    """A role mailbox, or one named after the site."""
    local = F.split_part(F.lower(col(email)), F.lit("@"), F.lit(1))
    tokens = F.split(local, "[._+-]")
    named = F.lit(False) if site is None else local == F.split_part(F.lower(F.lit(site)), F.lit("."), F.lit(1))
    return F.forall(tokens, lambda t: t.isin(ROLE_MAILBOXES)) | named


def company_email(text, site) -> Column:
    """The first role mailbox of the own domain, else the first role mailbox."""
    role = F.filter(emails(text), lambda e: is_role_email(e))
    own = lambda found: F.get(F.filter(found, lambda e: F.endswith(e, F.concat(F.lit("@"), col(site)))), F.lit(0))
    # as the only item of an array the addresses are looked for once, not in each of their uses
    return F.get(F.transform(F.array(role), lambda found: F.coalesce(own(found), F.get(found, F.lit(0)))), F.lit(0))


def vat_id(text) -> Column:
    """The first VAT number of a certain shape, blanks and points taken out."""
    out = F.lit(None).cast("string")
    for shape in reversed(VAT_SHAPES.values()):
        hit = F.regexp_extract(col(text), f"(?:^|[^A-Z0-9])({shape})(?:[^A-Z0-9]|$)", 1)
        out = F.when(hit != "", F.regexp_replace(hit, "[ .-]", "")).otherwise(out)
    return out


def register_number(text) -> Column:
    """struct(kind, number) of a German register entry such as 'HRB 12345'."""
    kind = F.regexp_extract(col(text), r"(?:^|[^A-Z])(HR ?[AB]|GnR|VR|PR) *([0-9]{1,6})", 1)
    number = F.regexp_extract(col(text), r"(?:^|[^A-Z])(HR ?[AB]|GnR|VR|PR) *([0-9]{1,6})", 2)
    return F.when(number != "", F.struct(F.replace(kind, F.lit(" "), F.lit("")).alias("kind"), number.alias("number")))


def register_court(text) -> Column:
    """The court behind a register entry: 'Amtsgericht X', 'Registergericht: X', 'Handelsgericht X'."""
    return squash(F.regexp_extract(col(text), r"(?:Amtsgericht|Registergericht|Handelsgericht|Firmenbuchgericht)(?: *:)? *(?:Amtsgericht )?([A-ZÄÖÜ][\p{L}.() /-]*?)(?= *(?:[,;\n]|HR|GnR|$))", 1))


def company_name(line) -> Column:
    """The part of a line up to its legal form, behind a label and without what follows; null without a legal form."""
    forms = "|".join(p for _, p in LEGAL_FORMS)
    bare = F.regexp_replace(col(line), r"^(?i)\s*(?:firma|company|name|anbieter|verantwortlich|©|copyright)[^:\n]{0,30}:\s*", "")
    return squash(F.regexp_extract(bare, rf"(?i)^\s*([^|•·\n]*?(?:{forms})\.?)", 1))


def legal_form(name) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(LEGAL_FORMS):
        out = F.when(F.lower(col(name)).rlike(pattern), label).otherwise(out)
    return out


def postal_address(text) -> Column:
    """struct(street, postal_code, city) of 'Street 1, 12345 City' or over two lines."""
    pattern = r"([^\n,]+ [0-9]+[a-zA-Z]?)[,\n] *(?:[A-Z]{1,2}-)?([0-9]{4,5}) +([^\n,]+)"
    part = lambda i: squash(F.regexp_extract(col(text), pattern, i))
    return F.when(part(2).isNotNull(), F.struct(part(1).alias("street"), part(2).alias("postal_code"), part(3).alias("city")))


def phone(text, label: str = r"(?:tel|telefon|phone|fon)") -> Column:
    """The number behind a label, 6 to 16 digits."""
    hit = F.regexp_extract(col(text), rf"(?i){label}[a-z.]*[: ]+(\+?[0-9][0-9 ()/.-]+[0-9])", 1)
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return F.when(digits.between(6, 16), hit)


def placeholder(text) -> Column:
    """Sample data of templates."""
    return F.lower(col(text)).rlike(r"lorem ipsum|max mustermann|musterstra(ss|ß)e|john doe|example (street|company)|12345 musterstadt")


def looks_like_imprint(text) -> Column:
    """A register or VAT number, or the word with a name or an address."""
    word = F.lower(col(text)).rlike("impressum|imprint|legal notice|mentions l[ée]gales")
    return register_number(text).isNotNull() | vat_id(text).isNotNull() | (word & (legal_form(text).isNotNull() | postal_address(text).isNotNull()))


def completeness(*columns) -> Column:
    """Number of known fields."""
    return sum((F.when(col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0)).cast("long")
