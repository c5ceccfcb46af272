"""Company fields out of the lines of a legal notice.

Every field has candidates, one for a line at most: a value behind its label, a value under a line that is
only the label, or a value that is certain by its own shape.  The candidate of the least (before the
heading, kind, line) counts.  All of it is column expressions over an array of lines, so rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import company_email
from ..types import col

#: Legal forms as they end a company's name, longer ones first.
FORMS = ["GmbH & Co. KGaA", "GmbH & Co. KG", "AG & Co. KG", "gGmbH", "GmbH", "UG (haftungsbeschränkt)", "UG", "KGaA", "KG", "OHG", "GbR", "eG", "e.V.", "e.K.", "SE", "AG", "SARL", "SAS", "SASU", "EURL", "SCI", "SA", "B.V.", "N.V.", "S.r.l.", "S.p.A.", "Ltd.", "Ltd", "LLP", "LLC", "Inc.", "Inc"]
#: Other spellings of these forms.
SPELLINGS = {"GmbH & Co KG": "GmbH & Co. KG", "Gesellschaft mit beschränkter Haftung": "GmbH", "Aktiengesellschaft": "AG", "S.A.R.L.": "SARL", "S.à r.l.": "SARL", "S.A.S.": "SAS", "S.A.": "SA", "Limited": "Ltd", "BV": "B.V.", "eV": "e.V.", "e. V.": "e.V.", "e. K.": "e.K."}
#: VAT number shapes that are certain by themselves, and those that need a label.
VAT_CERTAIN = r"DE ?\d{3} ?\d{3} ?\d{3}|ATU ?\d{8}|FR ?[0-9A-Z]{2} ?\d{3} ?\d{3} ?\d{3}|NL ?\d{9}B\d{2}|CHE[- ]?\d{3}[. ]?\d{3}[. ]?\d{3} ?(?:MWST|TVA|IVA)"
VAT_LABELLED = r"BE ?0?\d{3}[. ]?\d{3}[. ]?\d{3}|LU ?\d{8}|IT ?\d{11}|ES ?[A-Z0-9]\d{7}[A-Z0-9]|PL ?\d{10}|DK ?\d{8}|SE ?\d{12}|CZ ?\d{8,10}|IE ?\d{7}[A-Z]{1,2}|PT ?\d{9}|GB ?\d{9}|FI ?\d{8}|EL ?\d{9}|HU ?\d{8}|SI ?\d{8}|SK ?\d{10}|CHE[- ]?\d{3}[. ]?\d{3}[. ]?\d{3}"
VAT_LABEL = r"ust|umsatzsteuer|vat|tva|mwst|uid|btw|p(?:artita|\.) ?iva"
NUMBER = r"\+?[0-9(][0-9 ()/.-]{4,}[0-9]"
#: Words of lines that name people, offices or makers, not the company.
OTHERS = r"(?iu)gericht|register|geschäftsführ|vorstand|inhaber|vertreten|director|gérant|design|hosting|webdesign|umsetzung|realisierung|foto|haftung für|datenschutz|@|https?:"
#: Words of sentences, which no company's name has.
PROSE = r"(?iu)(?<!\p{L})(?:wir|sie|ist|sind|wird|eine?[rsmn]?|unsere?|nur|bei|nicht|oder|bitte|is|are|we|our|your|this|only|est|sont|une?|nous|notre|votre)(?!\p{L})"
CITY = r"\p{Lu}[\p{L}.'’-]*(?:[ -](?:am |an der |im )?\p{Lu}[\p{L}.'’-]*){0,2}"
COURT = rf"((?:Amts|Handels|Landes)gericht)(?:e?s)? +({CITY})"
STREET = r"^(?:\p{L}[\p{L}.'’ -]{1,50} \d{1,4} ?[a-zA-Z]?(?: ?[-–/] ?\d{1,4} ?[a-zA-Z]?)?|\d{1,4},? (?:rue|avenue|boulevard|place|chemin|route|allée|quai)\b.{2,60}|Postfach \d[\d ]*)$"
POSTAL = rf"^(?:(DE?|AT?|CH|FR?|LU?)[ -]+)?(\d{{4,5}}) ({CITY}(?: \d{{1,2}})?)$"
#: Countries by register kind, by address prefix, by dialling code.
BY_KIND = {"HRA": "DE", "HRB": "DE", "GnR": "DE", "PR": "DE", "VR": "DE", "FN": "AT", "CHE": "CH", "RCS": "FR", "SIREN": "FR"}
BY_PREFIX = {"D": "DE", "A": "AT", "F": "FR", "L": "LU"}
BY_CODE = {"+49": "DE", "+43": "AT", "+41": "CH", "+33": "FR", "+31": "NL", "+39": "IT", "+352": "LU"}


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern finds, or null; as the only item of an array it is looked for once (nullif writes its first argument twice)."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), F.lit(0))


def _label_only(line: Column, label: str) -> Column:
    return F.coalesce(line.rlike(rf"(?i)^[^0-9]{{0,60}}(?:{label})[^0-9]{{0,20}}$"), F.lit(False))


def _best(lines: Column, head: Column, kinds: Callable[[Column, Column], list[Column]]) -> Column:
    """struct(early, kind, at, value): the least candidate; kinds(line, line before) lists a value or null for each kind."""

    def of(line: Column, i: Column) -> Column:
        values = kinds(line, F.when(i > 0, F.get(lines, i - 1)))
        found = F.array(*[F.struct((i < head).alias("early"), F.lit(k).alias("kind"), i.cast("int").alias("at"), v.alias("value")) for k, v in enumerate(values)])
        return F.filter(found, lambda c: c["value"].isNotNull())

    return F.array_min(F.flatten(F.transform(lines, of)))


def _labelled(line: Column, before: Column, label: str, value: str) -> list[Column]:
    own = _part(line, rf"(?:^|[^\p{{L}}])(?i:{label})[\p{{L}}. -]{{0,40}}?[^\p{{L}}0-9+(]{{0,10}}({value})")
    return [own, F.when(_label_only(before, label), _part(line, rf"^[^\p{{L}}0-9+(]{{0,10}}({value})"))]


def _spelled(form: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, form), form)


def _name(line: Column) -> Column:
    """The segment of a line that ends in a legal form, if the line names no one else."""
    forms = "|".join(f"\\Q{f}\\E" for f in sorted([*FORMS, *SPELLINGS], key=len, reverse=True))
    bare = F.regexp_replace(line, r"(?i)^(?:impressum|imprint|legal notice|mentions l[ée]gales)\s*[:|–-]?\s+", "")
    bare = F.regexp_replace(bare, r"(?iu)^(?:angaben gemäß[^:]*|(?:dienste)?anbieter|herausgeber|betreiber|firm(?:a|enname)|unternehmen|name|company(?: name)?|publisher|raison sociale|dénomination|société|éditeur)\s*:\s*", "")
    bare = F.regexp_replace(bare, r"(?i)^(?:©|\(c\)|copyright)[\s©]*(?:\d{4}(?:\s*[-–]\s*\d{4})?\s*)?(?:by\s+)?", "")
    bare = F.regexp_replace(bare, r"(?i)(?<!\s)\s+au capital\b.*$", "")
    segments = F.split(bare, r"\s[|–·•]\s|[,;]\s|\s-\s")
    up_to = lambda i: F.array_join(F.slice(segments, 1, i + 1), " ")
    fits = F.filter(segments, lambda s, i: (F.length(s) <= 100) & s.rlike(rf"\p{{L}}.*\p{{L}}.* (?:{forms})$") & ~up_to(i).rlike(OTHERS) & ~s.rlike(PROSE))
    return F.get(fits, F.lit(0))


def _one_of(x: Column, mapping: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), x)


def company_fields(df: DataFrame, lines: str, site: str | None = None) -> DataFrame:
    """df with company_name, legal_form, street, postal_code, city, phone, fax, email, register_kind,
    register_number, register_court, vat_id and country from an array of lines; what is not found is null.

    The lines before the heading ('Impressum' and the like) count only where none behind it has a value.
    An address is looked for in the eight lines from the name on first, a court on the lines next to the
    register number, or above its label.  Null or no lines give nulls.  Columns of df with these names are replaced.
    """
    clean = F.filter(F.transform(F.coalesce(F.col(lines), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " "))), lambda x: x != "")
    own = df.withColumn("__l", clean)
    at = F.col("__l")
    heading = F.array_position(F.transform(at, lambda x: x.rlike(r"(?i)^(?:impressum|imprint|legal notice|site notice|mentions l[ée]gales)\b")), F.lit(True))
    own = own.withColumn("__h", F.greatest(heading - 1, F.lit(0)).cast("int"))
    head = F.col("__h")

    def name(line: Column, before: Column) -> list[Column]:
        found, old = _name(line), line.rlike(r"(?i)^(?:©|\(c\)|copyright)")
        return [F.when(~old, found), F.when(old, found)]

    def vat(line: Column, before: Column) -> list[Column]:
        return [_part(line, rf"(?<![A-Z0-9])({VAT_CERTAIN})(?![A-Z0-9])"), *_labelled(line, before, VAT_LABEL, rf"(?<![A-Z0-9])(?:{VAT_LABELLED})(?![A-Z0-9])")]

    def register(line: Column, before: Column) -> list[Column]:
        context = F.concat_ws(" ", before, line)
        short = rf"(?<![\p{{L}}])((?:PR|VR) ?(?:Nr\.? ?)?\d{{1,6}})(?!\d)"
        return [
            _part(line, r"(?<![\p{L}])((?:HR ?[AB]|GnR)[ .:-]*(?:Nr\.? ?)?\d{1,6}(?: ?[A-Z]{1,2}(?![\p{L}\d]))?)(?!\d)"),
            _part(line, r"(?<![\p{L}])(FN[ .:]*\d{1,6} ?[a-z])(?![\p{L}\d])"),
            _part(line, rf"(?<![\p{{L}}])(RCS +{CITY}\D{{0,20}}\d{{3}} ?\d{{3}} ?\d{{3}})(?!\d)"),
            F.when(context.rlike("(?i)register"), _part(line, short)),
            _part(line, r"(?<![A-Z0-9])(CHE[- ]?\d{3}[. ]?\d{3}[. ]?\d{3})(?!\d)"),
            _part(line, r"(?i:\bSIRE[NT])[^0-9]{0,10}(\d{3} ?\d{3} ?\d{3})"),
        ]

    sized = lambda v: F.get(F.filter(F.array(v), lambda x: F.exists(F.array(F.length(F.regexp_replace(x, r"\D", ""))), lambda n: n.between(6, 16))), F.lit(0))
    phone = lambda label: lambda line, before: [sized(v) for v in _labelled(line, before, label, NUMBER)]
    own = own.withColumns({"__name": _best(at, head, name), "__vat": _best(at, head, vat), "__reg": _best(at, head, register), "__phone": _best(at, head, phone(r"tel(?:efon|ephone)?|tél(?:éphone)?|phone|fon")), "__fax": _best(at, head, phone(r"(?:tele)?fax"))})

    # an address: a segment of postal code and city, the street in the segment before it
    segments = F.flatten(F.transform(at, lambda x, i: F.transform(F.split(x, r",\s|\s[|·•–]\s"), lambda s: F.struct(i.alias("at"), F.trim(s).alias("text")))))
    own = own.withColumn("__s", segments)
    near = F.coalesce(F.col("__name.at"), F.lit(-100))

    def address(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("__s", i - 1))["text"]
        place = F.when((s["at"] >= near) & (s["at"] < near + 8), 0).when(s["at"] >= head, 1).otherwise(2)
        return F.struct(place.alias("place"), i.alias("i"), _part(s["text"], POSTAL, 2).alias("code"), _part(s["text"], POSTAL, 3).alias("city"), _part(s["text"], POSTAL, 1).alias("land"), F.when(before.rlike(STREET), before).alias("street"))

    own = own.withColumn("__a", F.array_min(F.filter(F.transform("__s", address), lambda a: a["code"].isNotNull())))

    number = F.regexp_replace(F.col("__reg.value"), r"[ .:]+", " ")
    kind = F.element_at(F.array(*map(F.lit, ["HR", "FN", "RCS", "PR", "CHE", "SIREN"])), F.col("__reg.kind") + 1)
    kind = F.when(kind == "HR", F.replace(_part(number, "^(HR ?[AB]|GnR)"), F.lit(" "), F.lit(""))).when(kind == "PR", F.substring(number, 1, 2)).otherwise(kind)
    digits = F.regexp_replace(number, r"\D", "")
    threes = lambda d, sep: F.concat_ws(sep, F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3))
    shown = (
        F.when(kind == "RCS", F.concat(F.lit("RCS "), _part(number, rf"^RCS ({CITY})"), F.lit(" "), threes(digits, " ")))
        .when(kind == "CHE", F.concat(F.lit("CHE-"), threes(digits, ".")))
        .when(kind == "SIREN", threes(digits, " "))
        .when(kind == "FN", F.concat(F.lit("FN "), digits, F.lit(" "), F.substring(number, -1, 1)))
        .otherwise(F.concat_ws(" ", kind, _part(number, r"(\d{1,6}(?: ?[A-Z]{1,2})?)$")))
    )
    where = F.col("__reg.at")
    before = F.when(where > 0, F.get(at, where - 1))
    further = F.when((where > 1) & _label_only(before, "register|nummer|number|nr"), F.get(at, where - 2))
    around = F.array_compact(F.array(F.get(at, where), before, further, F.get(at, where + 1)))
    place = lambda x: F.regexp_replace(_part(x, COURT, 2), r"\s(?:HR ?[AB]?|FN|GnR|Nr|PR|VR|Register).*$", "")
    courts = F.filter(F.transform(around, lambda x: F.concat_ws(" ", _part(x, COURT, 1), place(x))), lambda x: x.contains(" "))
    court = F.when(kind == "RCS", _part(shown, rf"^(RCS {CITY}) \d")).otherwise(F.get(courts, F.lit(0)))
    vat_text = F.regexp_replace(F.col("__vat.value"), "[ .-]", "")
    vat_id = F.when(F.startswith(vat_text, F.lit("CHE")), F.concat(F.lit("CHE-"), threes(F.regexp_replace(vat_text, r"\D", ""), "."), F.lit(" MWST"))).otherwise(vat_text)
    forms = "|".join(f"\\Q{f}\\E" for f in sorted([*FORMS, *SPELLINGS], key=len, reverse=True))
    host = F.lit("").cast("string") if site is None else F.coalesce(col(site), F.lit(""))
    own = own.withColumns({"__kind": F.when(F.col("__reg.value").isNotNull(), kind), "__vat_id": vat_id})
    dialled = [F.when(F.startswith(F.col("__phone.value"), F.lit(code)), land) for code, land in sorted(BY_CODE.items(), key=lambda x: -len(x[0]))]
    land = F.coalesce(
        _part(F.col("__vat_id"), "^(CH|[A-Z]{2})"),
        _one_of(F.col("__kind"), BY_KIND),
        F.coalesce(_one_of(F.col("__a.land"), BY_PREFIX), F.col("__a.land")),
        *dialled,
        F.upper(_part(host, r"\.(de|at|ch|fr|nl|it|lu)$")),
    )
    fields = {
        "company_name": F.col("__name.value"),
        "legal_form": _spelled(_part(F.col("__name.value"), rf" ({forms})$")),
        "street": F.col("__a.street"),
        "postal_code": F.col("__a.code"),
        "city": F.col("__a.city"),
        "phone": F.trim(F.col("__phone.value")),
        "fax": F.trim(F.col("__fax.value")),
        "email": company_email(F.array_join(at, "\n"), host),
        "register_kind": F.col("__kind"),
        "register_number": F.when(F.col("__kind").isNotNull(), shown),
        "register_court": court,
        "vat_id": F.col("__vat_id"),
        "country": land,
    }
    return own.withColumns(fields).drop("__l", "__h", "__s", "__a", "__name", "__vat", "__reg", "__phone", "__fax", "__kind", "__vat_id")
