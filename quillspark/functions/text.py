"""Text, date and money normalisers as column expressions. Inputs that don't fit give null, not errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.geometry import col


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def ellipsis(c: Column | str, size: int = 80) -> Column:
    return F.when(F.length(col(c)) > size, F.concat(F.left(col(c), F.lit(size)), F.lit("..."))).otherwise(col(c))


def suffix(path: Column | str) -> Column:
    """The last suffix of a path with its dot, or the empty string."""
    return F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1)


def with_suffix(path: Column | str, new: str) -> Column:
    """The path with its last suffix, if any, replaced."""
    return F.concat(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]+$", ""), F.lit(new))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def fill(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace each {{key}}, in the order of values: a value that holds a later key's place is filled in turn."""
    out = template if isinstance(template, Column) else F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


def fill_once(template: Column | str, values: dict[str, Column]) -> Column:
    """As fill, but no value is read for places: each is guarded while the others are filled."""
    guarded = {k: F.replace(v, F.lit("{{"), F.lit("{\x00{")) for k, v in values.items()}
    return F.replace(fill(template, guarded), F.lit("{\x00{"), F.lit("{{"))


def invoice_number(c: Column | str) -> tuple[Column, Column]:
    """Point of sale and number of a text like 00001-00000031."""
    pattern = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*$"
    return tuple(F.regexp_extract(col(c), pattern, i).try_cast("bigint") for i in (1, 2))


def tax_id(c: Column | str) -> Column:
    """Leading digits and hyphens, cut at the first other character; null if there are none."""
    return F.nullif(F.regexp_extract(col(c), r"^[0-9-]+", 0), F.lit(""))


def full_tax_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9]{2}-[0-9]{8}-[0-9]$"), F.lit(False))


def count_tax_ids(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\b[0-9]{2}-[0-9]{8}-[0-9]\b"))


def repair_zero(c: Column | str) -> Column:
    """Zeros inside words of free text become the letter O, in the case of the word. A word is a run of letters and zeros
    with three letters or more, so identifiers, numbers and amounts, which hold other digits or too few letters, stay."""
    parts = F.regexp_extract_all(col(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    is_word = lambda t: t.rlike(r"^(?=(0*\p{L}){3})[\p{L}0]+$")
    letter = lambda t: F.when(t == F.upper(t), "O").otherwise("o")
    return F.array_join(F.transform(parts, lambda t: F.when(is_word(t), F.replace(t, F.lit("0"), letter(t))).otherwise(t)), "")


def snake_key(c: Column | str) -> Column:
    """A printed label as a key: lower case, no accents, other characters as one underscore."""
    plain = F.translate(F.lower(col(c)), "áéíóúüñàèìòùâêîôûç", "aeiouunaeiouaeiouc")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def product_list(items: Column | str) -> Column:
    """An array of (desc, qty, price) as one text: desc xqty - price, joined by |; null without items."""
    one = lambda i: F.concat(F.replace(F.coalesce(i["desc"], F.lit("")), F.lit("|"), F.lit("/")), F.when(i["qty"].isNotNull(), F.concat(F.lit(" x"), i["qty"].cast("string"))).otherwise(""), F.lit(" - "), i["price"].cast("string"))
    return F.nullif(F.array_join(F.transform(col(items), one), "|"), F.lit(""))


def header_letter(c: Column | str) -> Column:
    """The voucher letter that follows FACTURA or COMPROBANTE in a header."""
    pattern = r"FACTURA\s+([A-CME])|COMPROBANTE\s+([A-CME])"
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c), pattern, i), F.lit("")) for i in (1, 2)])


def document_kind(c: Column | str) -> Column:
    """Credit note or debit note by its keywords, otherwise invoice."""
    up = F.translate(F.upper(col(c)), "ÁÉÍÓÚ", "AEIOU")
    return (
        F.when(up.rlike(r"NOTA DE CREDITO|N\. CREDITO|\bNC\b"), "Nota de Crédito")
        .when(up.rlike(r"NOTA DE DEBITO|N\. DEBITO|\bND\b"), "Nota de Débito")
        .otherwise("Factura")
    )


def compact_date(c: Column | str) -> Column:
    """DD/MM/YYYY as YYYYMMDD by moving its parts; other texts as they are."""
    p = F.split(col(c), "/")
    return F.when(F.contains(col(c), F.lit("/")), F.concat(F.try_element_at(p, F.lit(3)), F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(1)))).otherwise(col(c))


def iso_date(c: Column | str) -> Column:
    """A date of the forms DD/MM/YYYY, YYYY-MM-DD or YYYYMMDD; null if it is none or no day of a calendar."""
    return F.coalesce(*[F.try_to_date(col(c), f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "yyyyMMdd")])


def amount(c: Column | str) -> Column:
    """A printed amount as decimal, without symbols and thousands; null if it is none.

    Of two kinds of marks the last one is decimal. A kind that repeats, or a single one before just three last digits and
    behind one to three digits that are not a lone 0, separates thousands; any other single one is decimal.
    """
    bare = F.regexp_replace(col(c), "[^0-9.,-]", "")
    commas, points = F.regexp_count(bare, F.lit(",")), F.regexp_count(bare, F.lit(r"\."))
    last = F.regexp_extract(bare, "([.,])[^.,]*$", 1)
    own = F.when(last == ",", commas).otherwise(points)
    other = F.when(last == ",", points).otherwise(commas)
    grouped = (own > 1) | ((own == 1) & (other == 0) & bare.rlike(r"^-?[1-9][0-9]{0,2}[.,][0-9]{3}$"))
    digits = F.regexp_replace(bare, "[.,]", "")
    after = F.length(F.regexp_extract(bare, "([^.,]*)$", 1))
    split = F.concat(F.left(digits, F.length(digits) - after), F.lit("."), F.right(digits, after))
    return F.when((last == "") | grouped, digits).otherwise(split).try_cast("decimal(18,2)")


def currency(c: Column | str) -> Column:
    """USD for U$S, US$ or USD, EUR for its sign or code, otherwise the default ARS."""
    up = F.upper(F.coalesce(col(c), F.lit("")))
    return F.when(up.rlike(r"U\$S|US\$|USD"), "USD").when(up.rlike("€|EUR"), "EUR").otherwise("ARS")
