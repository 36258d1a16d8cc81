"""Fields from document text: one job over (doc_id, page, text), native expressions only.

What is printed beside a value, by language, stands in the tables below; the patterns are made of them by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import iban_valid, normal_id
from ..functions.text import DATE, date_value, either, first_match, in_any_case, let, lowered, mentions, money_value, words_in
from .checks import VAT_FORMATS

# Cue words by language, in the order that settles ties, and currencies with their signs, in that of precedence.
LOCALE_CUES = {
    "NL": ["factuur", "btw", "totaal", "leverancier", "vervaldatum", "kvk"],
    "EN": ["invoice", "subtotal", "total due", "supplier", "tax", "due date"],
    "DE": ["rechnung", "gesamtbetrag", "mwst", "lieferant", "fällig"],
    "FR": ["facture", "sous-total", "fournisseur", "tva", "échéance"],
    "ES": ["factura", "subtotal", "proveedor", "iva", "vencimiento"],
}
CURRENCY_SIGNS = {"EUR": "€", "USD": "$", "GBP": "£", "CAD": "", "AUD": "", "CHF": "", "JPY": "¥"}

# Labels by what they stand for: Dutch, English, German, French, Spanish.
LABELS = {
    "vendor": ["leverancier", "supplier", "vendor", "lieferant", "fournisseur", "proveedor"],
    "invoice_number": [
        "factuurnummer", "factuur nr", "factuur no", "notanummer", "invoice number", "invoice no", "invoice nr", "invoice #", "bill number", "bill no",
        "rechnungsnummer", "rechnungs nr", "rechnung nr", "numéro de facture", "facture no", "facture n°", "número de factura", "factura no", "factura n.º", "factura nº",
    ],
    "order_number": ["ordernummer", "order nr", "order number", "order no", "bestelnummer", "bestellnummer", "purchase order"],
    "issue_date": ["factuurdatum", "invoice date", "rechnungsdatum", "date de facture", "fecha de factura"],
    "due_date": ["vervaldatum", "uiterste betaaldatum", "due date", "payable by", "fällig am", "fälligkeitsdatum", "échéance", "vencimiento"],
    "terms": ["betalingstermijn", "betaaltermijn", "betalingsconditie", "betaal binnen", "betalen binnen", "payment terms", "payment term", "payable within", "zahlbar innerhalb", "zahlbar binnen", "zahlbar", "paiement à", "pago a"],
    "subtotal": ["subtotaal", "subtotal", "sub-total", "zwischensumme", "sous-total"],
    "tax": ["btw bedrag", "btw", "vat", "mwst", "tva", "iva"],
    "total": ["te betalen", "totaal bedrag", "total due", "gesamtbetrag", "total à payer", "total a pagar", "totaal", "total"],
    "address": ["adres", "address", "adresse", "dirección"],
    "contact": ["contact", "e-mail", "email", "leverancier", "supplier", "vendor", "billing", "info"],
    "bank": ["iban", "bankrekening", "rekeningnummer", "bank account", "kontonummer", "compte bancaire", "cuenta"],
    "vat": ["btw-nummer", "btw nr", "vat number", "vat no", "vat id", "ust-idnr", "ust-id", "numéro de tva", "n° tva", "nif"],
    "balance": ["saldo", "balance", "openstaand", "amount due", "reste à payer"],
}
# Company registers: their labels, and the least and the greatest number of digits.
REGISTERS = [
    (["kvk", "kvk nr", "kvk nummer", "kvk number", "kamer van koophandel", "chamber of commerce", "coc", "coc number"], 7, 8),
    (["siren", "siret"], 9, 14),
    (["handelsregister", "handelsregisternummer", "hrb", "hra", "handelsregister hrb", "handelsregister hra"], 3, 8),
    (["company number", "company no", "company registration number", "crn"], 6, 10),
    (["kbo", "bce", "ondernemingsnummer"], 8, 10),
    (["y-tunnus", "business id"], 6, 8),
]
# Ways to say that an amount was paid.
PAID = [
    "al betaald", "reeds betaald", "reeds voldaan", "is voldaan", "voldaan op", "betaald op", "betaald via", "betaald per", "already paid", "paid in full", "payment received", "paid on", "paid by",
    "bereits bezahlt", "dankend erhalten", "déjà payé", "déjà réglé", "acquittée", "ya pagado", "pagado el",
]
# Units of quantities.
UNITS = ["x", "stuk", "stuks", "st", "uur", "uren", "dag", "dagen", "week", "weken", "maand", "maanden", "keer", "unit", "units", "pc", "pcs", "hour", "hours", "hr", "hrs", "day", "days", "set", "sets", "kg", "g", "l", "liter", "m", "km"]
STREETS = ["straat", "laan", "weg", "plein", "kade", "street", "road", "avenue", "lane", "strasse", "straße", "platz", "rue", "calle"]
POST_BOXES = ["postbus", "po box", "p.o. box", "postfach", "boîte postale", "apartado"]

GAP = r"[ \t:.#°º-]{0,6}"
TOKEN = r"((?=[A-Za-z/.-]*\d)[A-Za-z0-9]+(?:[-/.][A-Za-z0-9]+)*)"
# A number of a series without a label: letters or a year, a separator, and three digits or more.
SERIES = r"\b([A-Z]{1,6}[-/]\d{3,10}(?:[-/]\d{1,10})*|(?:19|20)\d{2}[-/]\d{3,8})\b"
AMOUNT = r"(-?(?:\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d{1,2})?)(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The same for a search of all: a run of its characters is tried from its beginning (or the last match's end) only, as all of it ends alike.
EACH_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"(?=[A-Z]{2}\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b"
DUTCH_IBAN = r"^NL\d{2}[A-Z]{4}\d{10}$"


def labelled(kind: str) -> str:
    return "(?iu)" + either(LABELS[kind])


def place(text: Column, part: Column) -> Column:
    """Where the part begins in the text, from 1; null without either."""
    return F.nullif(F.instr(text, part), F.lit(0))


# Most fields take the text in lower case too, where a caller has it: a pattern is tried where a part of its words is there.


def doc_locale(text: Column, lower: Column | None = None) -> Column:
    """Language by cue words, three more for the country of an IBAN; Dutch without any."""
    country = F.upper(F.regexp_extract(text, r"(?i)(?=[A-Z]{2}\d)\b([A-Z]{2})\d{2}", 1))

    def scored(cc: Column, low: Column) -> Column:
        scores = []
        for i, (loc, cues) in enumerate(LOCALE_CUES.items()):
            n = F.when(mentions(low, cues), F.regexp_count(text, F.lit("(?iu)" + either(cues, r"\s")))).otherwise(0)
            scores.append(F.struct((n + F.when(cc == loc, 3 if loc != "EN" else 0).otherwise(0)).alias("n"), F.lit(-i).alias("back"), F.lit(loc).alias("locale")))
        return F.array_max(F.array(*scores))

    best = lowered(text, lower, lambda low: let(country, lambda cc: scored(cc, low)))
    return let(best, lambda best: F.when(best.n > 0, best.locale).otherwise("NL"))


def doc_currency(text: Column, lower: Column | None = None) -> Column:
    """The first currency in order of precedence whose code or sign is there."""
    def there(low: Column, code: str, sign: str) -> Column:
        found = mentions(low, [code]) & text.rlike(rf"(?iu)(?={code})(?<![A-Z]){code}(?![A-Z])")
        return found | F.contains(text, F.lit(sign)) if sign else found

    return lowered(text, lower, lambda low: F.coalesce(*[F.when(there(low, code, sign), F.lit(code)) for code, sign in CURRENCY_SIGNS.items()]))


def doc_amount(text: Column, field: str, lower: Column | None = None) -> Column:
    """The amount on the line of the first label that has one, without a letter between but those of a currency."""
    between = r"[^\n\p{L}]{0,60}?(?:[A-Z]{2,3}\s*)?[€$£¥]?\s{0,3}"

    def raw(low: Column) -> Column:
        return F.coalesce(*[F.when(mentions(low, [label]), first_match(text, rf"(?iu){either([label])}{between}{AMOUNT}")) for label in LABELS[field]])

    return money_value(lowered(text, lower, raw))


def doc_date(text: Column, field: str, lower: Column | None = None) -> Column:
    """The date after a label; in English text, numbers with slashes begin with the month where they can."""
    raw = first_match(text, rf"{labelled(field)}[^0-9\p{{L}}\n]{{0,18}}({DATE})")
    found = lowered(text, lower, lambda low: F.when(mentions(low, LABELS[field]), raw))
    return let(found, lambda x: date_value(x, F.contains(x, F.lit("/")) & (doc_locale(text, lower) == "EN")))


def doc_due_from_terms(text: Column, issued: Column, lower: Column | None = None) -> Column:
    """Due date from payment terms: days after the end of the next month where the text says so, else after the issue date."""
    flat = F.regexp_replace(text, r"\s+", " ")
    days = lambda raw: F.when(raw.try_cast("int").between(1, 365), raw.try_cast("int"))
    eom = r"(?:einde (?:van de )?maand|(?<!\p{L})e\.?o\.?m(?!\p{L})\.?)"
    end_days = F.coalesce(days(first_match(flat, rf"(?i)(\d{{1,3}}) ?dagen? {eom}")), days(first_match(flat, rf"(?i){eom} ?(?:\+|en) ?(\d{{1,3}}) ?dagen?")), F.lit(14))
    unit = r"\s*(?:dagen|days|tagen?|jours|días)"
    net = days(first_match(text, r"(?i)(?<!\p{L})net\s*(\d{1,3})(?!\d)"))

    def due(low: Column) -> Column:
        end = mentions(low, ["einde", "eom", "e.o.m"]) & flat.rlike(f"(?i){eom}")
        plain = F.coalesce(F.when(mentions(low, ["net"]), net), F.when(mentions(low, LABELS["terms"]), days(first_match(text, rf"{labelled('terms')}[^\n\d]{{0,60}}(\d{{1,3}}){unit}"))))
        return F.when(end, F.date_add(F.last_day(F.add_months(issued, 1)), end_days)).otherwise(F.date_add(issued, plain))

    return lowered(text, lower, due)


def doc_invoice_number(text: Column, lower: Column | None = None) -> Column:
    """The token with a digit after a label of invoice numbers, else of order numbers, else one that looks like a number of a series."""
    def after(low: Column, kind: str) -> Column:
        return F.when(mentions(low, LABELS[kind]), first_match(text, f"{labelled(kind)}{GAP}{TOKEN}"))

    return lowered(text, lower, lambda low: F.coalesce(after(low, "invoice_number"), after(low, "order_number"), first_match(text, SERIES)))


def doc_emails(pages: DataFrame, own: str = "") -> DataFrame:
    """doc_id and its distinct addresses but our own, by score: how much of the vendor's name they hold, and 0.3 for a labelled one.

    The name is that of pages.vendor where there is such a column, else there is no likeness; ties go by name.
    """
    vendor = F.col("vendor") if "vendor" in pages.columns else F.lit("")

    def near(text: Column) -> Column:
        """Lines with an @ and the last ones above them that aren't blank: an address is on one line, white space alone is between it and a label further up."""
        solid = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
        holds = lambda x: F.coalesce(F.contains(x, F.lit("@")), F.lit(False))
        return let(solid, lambda rows: F.array_join(F.filter(rows, lambda x, i: holds(x) | holds(F.get(rows, i + 1))), "\n"))

    def label(lines: Column) -> Column:
        pattern = rf"{either(LABELS['contact'])}\s*[:-]?[^\n@]{{0,48}}?(?<![A-Za-z0-9._%+-])({EMAIL})"
        return F.lower(let(F.lower(lines), lambda low: in_any_case(lines, low, lambda t, flags: first_match(t, flags + pattern))))

    def scored(lines: Column) -> Column:
        every = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(lines, F.lit(EACH_EMAIL), F.lit(0)), F.lower)), lambda x: x != own.lower())
        name = F.filter(words_in(F.coalesce(vendor, F.lit(""))), lambda w: F.length(w) > 2)
        like = lambda x, words: let(F.regexp_replace(x, "[^a-z0-9]", ""), lambda plain: F.size(F.filter(words, lambda w: F.contains(plain, w))) / F.greatest(F.size(words), F.lit(1)))
        score = lambda x, words, at: F.round(like(x, words) + F.when(x == at, 0.3).otherwise(0.0), 6)
        each = lambda found, words, at: F.transform(found, lambda x: F.struct(x.alias("email"), score(x, words, at).alias("score")))
        return let(every, lambda found: F.when(F.size(found) > 0, let(name, lambda words: let(label(lines), lambda at: each(found, words, at)))))

    # A page's addresses are scored where they are; a document's come together once, counted and ranked there.
    rows = pages.select("doc_id", F.inline(F.when(F.contains("text", F.lit("@")), let(near(F.col("text")), scored))))
    best = rows.repartition("doc_id").groupBy("doc_id", "email").agg(F.max("score").alias("score"))
    return best.select("doc_id", "email", "score", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "email")).alias("rank"))


def doc_ibans(text: Column) -> Column:
    """Account numbers that pass the checksum or are shaped like Dutch ones."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IBAN), F.lit(0)), lambda x: F.regexp_replace(F.upper(x), " ", ""))
    return F.filter(F.array_distinct(found), lambda x: x.rlike(DUTCH_IBAN) | iban_valid(x))


def doc_iban(text: Column, own: str = "", vendor: Column | None = None, reach: int = 200) -> Column:
    """The first of them that isn't our own (unless no other is left): those near the vendor's name, then Dutch ones first."""
    plain = lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))

    def order(flat: Column, at: Column, x: Column, i: Column) -> Column:
        far = F.lit(0) if vendor is None else F.when(F.abs(place(flat, x) - at) <= reach, 0).otherwise(1)
        return F.struct(far.alias("far"), F.when(x.startswith("NL"), 0).otherwise(1).alias("foreign"), i.alias("i"), x.alias("v"))

    def ranked(found: Column, flat: Column, at: Column) -> Column:
        return F.array_min(F.transform(found, lambda x, i: order(flat, at, x, i))).v

    def chosen(found: Column) -> Column:
        if vendor is None:
            return ranked(found, text, text)
        return F.when(F.size(found) > 0, let(plain(text), lambda flat: let(place(flat, plain(vendor)), lambda at: ranked(found, flat, at))))

    def others(found: Column) -> Column:
        return let(F.filter(found, lambda x: x != own), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(found))

    return let(let(doc_ibans(text), others), chosen)


def doc_vat(text: Column, own: str = "", vendor: Column | None = None) -> Column:
    """The longest token with the structure of a VAT number, not our own; of equals the one nearest to the vendor's name, or else to a label."""
    pattern = r"\b(?:" + "|".join(f"{cc}{p}" for cc, p in VAT_FORMATS.items()) + r")\b"

    def chosen(upper: Column) -> Column:
        label = F.nullif(F.regexp_instr(upper, F.lit(labelled("vat"))), F.lit(0))
        anchor = label if vendor is None else F.coalesce(place(upper, F.upper(vendor)), label)
        found = F.filter(F.regexp_extract_all(upper, F.lit(pattern), F.lit(0)), lambda x: x != own)
        order = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), F.coalesce(F.abs(F.instr(upper, x) - anchor), F.lit(0)).alias("far"), i.alias("i"), x.alias("v")))
        return F.array_min(order).v

    return let(F.upper(text), chosen)


def doc_registration(text: Column, email: Column | None = None, lower: Column | None = None) -> Column:
    """The digits after a register's label: those nearest to the e-mail address where one is given and there, else by the order of registers."""
    def found(low: Column) -> Column:
        out = []
        for i, (labels, least, most) in enumerate(REGISTERS):
            pattern = rf"{either(labels)}(?:[\s-]*(?:nr|no|num|nummer|number)(?!\p{{L}}))?{GAP}(\d(?:[ .-]?\d){{{least - 1},{most - 1}}})(?!\d)"
            tried = in_any_case(text, low, lambda t, flags: F.regexp_extract_all(t, F.lit(flags + pattern), F.lit(1)))  # noqa: B023
            every = F.when(mentions(low, labels), tried).otherwise(F.array().cast("array<string>"))
            out.append(F.transform(every, lambda x, k: F.struct(F.lit(i).alias("i"), k.alias("k"), x.alias("v"))))  # noqa: B023
        return F.concat(*out)

    def nearest(low: Column) -> Column:
        anchor = F.lit(None).cast("int") if email is None else place(low, F.lower(email))
        ranked = lambda at: F.transform(found(low), lambda x: F.struct(F.coalesce(F.abs(F.instr(text, x.v) - at), F.lit(0)).alias("far"), x.i.alias("i"), x.k.alias("k"), x.v.alias("v")))
        return F.array_min(let(anchor, ranked)).v

    return F.regexp_replace(lowered(text, lower, nearest), "[ .-]", "")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def doc_address(text: Column, lower: Column | None = None) -> Column:
    """Labelled, else a PO box or a street with number, each with the postcode line below it, else a postcode line."""
    post = r"\b\d{4}\s?[A-Z]{2}\b|\b\d{5}\b"
    box = rf"(?iu)^{either(POST_BOXES)}\s+\d+$"
    street = rf"(?iu)^[\p{{L}}.' -]{{0,40}}(?:{'|'.join(STREETS)})(?:\s[\p{{L}} ]{{1,20}})?\s+\d{{1,5}}\s?[a-z]?$"

    def of_lines(rows: Column, low: Column) -> Column:
        def with_next(pattern: str) -> Column:
            def joined(at: Column) -> Column:
                below = F.get(rows, at)
                return F.when(at > 0, F.concat_ws(", ", F.get(rows, at - 1), F.when(below.rlike(post), below)))

            return let(F.array_position(F.transform(rows, lambda x: x.rlike(pattern)), True).cast("int"), joined)

        return F.coalesce(F.when(mentions(low, POST_BOXES), with_next(box)), F.when(mentions(low, STREETS), with_next(street)), F.get(F.filter(rows, lambda x: x.rlike(post)), 0))

    def found(low: Column) -> Column:
        after = first_match(text, rf"{labelled('address')}\s*[:-]\s*([^\n]{{5,120}})")
        return F.coalesce(F.when(mentions(low, LABELS["address"]), after), let(lines_of(text), lambda rows: of_lines(rows, low)))

    return lowered(text, lower, found)


LEGAL_FORM = r"(?i)\b(?:B\.?V\.?|N\.?V\.?|GmbH|AG|Ltd\.?|LLC|Inc\.?|S\.?A\.?|S\.?L\.?|V\.?O\.?F\.?)(?:\s|$|,)"


def doc_vendor(text: Column, own: str = "") -> Column:
    """Labelled, else the first line with a legal form, else the first plausible line; never our own name."""
    others = "(?iu)" + either([w for k in ("invoice_number", "issue_date", "due_date", "bank", "vat", "total", "tax") for w in LABELS[k]] + ["factuur", "invoice", "rechnung", "facture", "factura", "datum", "date"])

    def of_lines(rows: Column) -> Column:
        foreign = F.filter(rows, lambda x: ~F.contains(F.lower(x), F.lit(own.lower()))) if own else rows
        formed = F.get(F.filter(foreign, lambda x: x.rlike(LEGAL_FORM) & (F.length(x) <= 80)), 0)
        plain = F.get(F.filter(foreign, lambda x: x.rlike(r"^\p{L}") & (F.length(x) <= 60) & ~x.rlike(others)), 0)
        return F.coalesce(formed, plain)

    return F.coalesce(first_match(text, rf"{labelled('vendor')}\s*[:-]\s*([^\n]{{2,80}})"), let(lines_of(text), of_lines))


MONEY = r"-?\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b"
NOT_ITEMS = either([w for k in ("subtotal", "tax", "total", "balance", "terms", "bank", "vat", "issue_date", "due_date") for w in LABELS[k]] + ["datum", "date", "omzetbelasting", "betaling", "payment"])


def doc_line_items(pages: DataFrame, per_page: int = 8, per_document: int = 20) -> DataFrame:
    """doc_id, page, line, description, quantity and amount of lines with money that aren't totals or dates; the limits are part of what an item list is.

    In product blocks the amount stands on a line with no name of its own, below the product's: such a line
    takes the one above it as its description.
    """
    named, other = r"\p{L}{4}", lambda x: let(F.lower(x), lambda low: in_any_case(x, low, lambda t, flags: t.rlike(flags + NOT_ITEMS)))
    unit = rf"(?<![\d.,])(\d{{1,4}})\s?{either(UNITS)}"

    def quantity(text: Column) -> Column:
        found = let(F.lower(text), lambda low: in_any_case(text, low, lambda t, flags: first_match(t, flags + unit)))
        return F.coalesce(found.try_cast("double"), F.lit(1.0))

    def value(token: Column) -> Column:
        """As money_value reads a token of this form: its decimal mark is the third character from the end."""
        plain = F.when(F.substring(token, -3, 1) == ",", F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(token, F.lit(","), F.lit("")))
        return plain.try_cast("double")

    def described(line: Column, amount: Column, own: Column, description: Column) -> Column:
        good = (F.length(description) >= 4) & ((description == own) | ~other(description))
        row = F.struct(line.alias("line"), F.substring(description, 1, 80).alias("description"), quantity(F.concat_ws(" ", own, description)).alias("quantity"), amount.alias("amount"))
        return F.when(good, row)

    def item(x: Column, i: Column, above: Column) -> Column:
        """The item on a line with money, else null. Each step is taken once, and only where those before it leave something."""
        token = F.try_element_at(F.regexp_extract_all(x, F.lit(MONEY), F.lit(0)), F.lit(-1))
        rest = F.trim(F.regexp_replace(F.regexp_replace(x, MONEY, ""), r"\s{2,}", " "))

        def of(amount: Column, own: Column) -> Column:
            bare = ~own.rlike(named) & above.rlike(named) & ~above.rlike(MONEY)
            return F.when(amount >= 1, let(F.when(bare, above).otherwise(own), lambda description: described(i, amount, own, description)))

        return let(rest, lambda own: F.when(~other(own), let(let(token, value), lambda amount: of(amount, own))))

    # A line with money takes the one above it along, so that no other line is sent anywhere.
    of_lines = lambda lines: F.transform(lines, lambda x, i: F.when((F.contains(x, F.lit(",")) | F.contains(x, F.lit("."))) & x.rlike(MONEY), let(F.trim(F.get(lines, i - 1)), lambda above: item(x, i, above))))
    rows = pages.select("doc_id", "page", F.inline(F.array_compact(let(F.split("text", "\n"), of_lines))))
    rows = rows.repartition("doc_id").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line"))).filter(F.col("n") <= per_page)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line"))).filter(F.col("n") <= per_document).drop("n")


def doc_prepaid(text: Column, lower: Column | None = None) -> Column:
    """The phrase that says the amount was paid, with 40 characters before it and 80 in all; null without one."""
    def around(at: Column) -> Column:
        start = F.greatest(at - 40, F.lit(1))
        return F.when(at > 0, F.trim(F.regexp_replace(F.substring(text, start, at - start + 80), r"\s+", " ")))

    return lowered(text, lower, lambda low: let(F.when(mentions(low, PAID), F.regexp_instr(text, F.lit("(?iu)" + either(PAID, r"\s+")))), around))


# What makes a page worth reading: labels of the vendor, of money and of ways to pay.
SIGNAL_WORDS = [w for k in ("vendor", "address", "contact", "bank", "vat", "tax", "total", "terms", "balance") for w in LABELS[k]]


def doc_relevant_pages(pages: DataFrame) -> DataFrame:
    """All pages of documents with one or two, else the first, the last and those with a signal word."""
    of = Window.partitionBy("doc_id")
    rows = pages.withColumns({"n": F.count("*").over(of), "first": F.min("page").over(of), "last": F.max("page").over(of)})
    ends = (F.col("n") <= 2) | (F.col("page") == F.col("first")) | (F.col("page") == F.col("last"))
    return rows.filter(ends | F.col("text").rlike("(?iu)" + either(SIGNAL_WORDS, r"\s"))).select("doc_id", "page")


def doc_structured_kind(text: Column) -> Column:
    """ubl or cii by the root element and namespace at the head of an XML text, else null."""
    head = F.substring(text, 1, 4096)
    root = F.regexp_extract(head, r"(?s)^\s*(?:<\?xml.*?\?>)?(?:\s|<!--.*?-->)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    ubl, cii = "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2", "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100"
    return F.when((root == "Invoice") & F.contains(head, F.lit(ubl)), "ubl").when((root == "CrossIndustryInvoice") & F.contains(head, F.lit(cii)), "cii")


def document_fields(pages: DataFrame, own_iban: str = "", own_vat: str = "", own_name: str = "", fields: list[str] | None = None) -> DataFrame:
    """doc_id, page, field, value of every field (or of those asked for) that a page gives, as text, in one pass over the pages."""
    t, low, issued, vendor = F.col("text"), F.col("lower"), F.col("issued"), F.col("vendor")
    # The text in lower case, the issue date and the vendor serve other fields too: they are made first.
    pages = pages.select("doc_id", "page", "text", F.lower("text").alias("lower"))
    pages = pages.select("doc_id", "page", "text", "lower", doc_date(t, "issue_date", low).alias("issued"), doc_vendor(t, own_name).alias("vendor"))
    values = {
        "vendor": vendor, "invoice_number": doc_invoice_number(t, low), "issue_date": issued, "due_date": F.coalesce(doc_date(t, "due_date", low), doc_due_from_terms(t, issued, low)),
        "currency": doc_currency(t, low), "subtotal": doc_amount(t, "subtotal", low), "tax": doc_amount(t, "tax", low), "total": doc_amount(t, "total", low),
        "iban": doc_iban(t, own_iban, vendor), "vat_number": doc_vat(t, own_vat, vendor),
        "registration": doc_registration(t, lower=low), "address": doc_address(t, low), "locale": doc_locale(t, low), "prepaid": doc_prepaid(t, low),
    }
    values = {f: v for f, v in values.items() if fields is None or f in fields}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in values.items()]))
    return pages.select("doc_id", "page", pairs.alias("p")).select("doc_id", "page", "p.*").filter("value is not null")


def page_first_value(reads: DataFrame) -> DataFrame:
    """doc_id, field, value, page: the first filled value over the pages; a labelled read on any page comes first."""
    rows = reads.filter(F.coalesce("value", F.lit("")) != "")
    best = rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "page"), F.struct((~F.col("labelled")).alias("a"), "page", "value")).alias("b"))
    return best.select("doc_id", "field", "b.*")


HEADER = ["vendor", "invoice_number", "issue_date", "due_date", "currency", "subtotal", "tax", "total"]


def extraction_assemble(reads: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """A header row per document of files(doc_id, file_name, terms_days) from reads(doc_id, field, value) and line items(doc_id, amount).

    A total that is missing or 0 is subtotal plus tax, else the sum of the lines; total_from says which. A missing
    due date is the issue date and the terms, a missing vendor the file's name up to its last underscore or
    dot. original keeps the reads as they were, by field. Of several reads of a field the least stands; a
    document without any keeps a row with its file's name.
    """
    # Reads, items and files are dealt out by document once; all else happens where a document's rows are.
    known = reads.select("doc_id", "field", "value").filter(F.col("field").isin(HEADER) & (F.coalesce("value", F.lit("")) != ""))
    least = known.repartition("doc_id").groupBy("doc_id", "field").agg(F.min("value").alias("value"))
    wide = least.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("original"))
    sums = items.groupBy("doc_id").agg(F.count("*").alias("line_items"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("lines_sum"))
    rows = files.select("doc_id", "file_name", "terms_days").join(wide, "doc_id", "left").join(sums, "doc_id", "left")
    read = lambda f: F.try_element_at("original", F.lit(f))
    number = lambda f: F.nullif(read(f).try_cast("double"), F.lit(0.0))
    name = F.regexp_extract("file_name", r"([^/\\\\]+?)(?:[_.][^_/\\\\]*)?$", 1)
    issued = F.try_to_date(read("issue_date"), "yyyy-MM-dd")
    added = F.round(number("subtotal") + F.coalesce(number("tax"), F.lit(0.0)), 2)
    totals = [(number("total"), "read"), (added, "parts"), (F.nullif("lines_sum", F.lit(0.0)), "lines")]
    return rows.select(
        "doc_id", F.coalesce(read("vendor"), F.nullif(name, F.lit(""))).alias("vendor"), read("invoice_number").alias("invoice_number"), issued.alias("issue_date"),
        F.coalesce(F.try_to_date(read("due_date"), "yyyy-MM-dd"), F.date_add(issued, F.col("terms_days"))).alias("due_date"), read("currency").alias("currency"),
        number("subtotal").alias("subtotal"), number("tax").alias("tax"),
        F.coalesce(*[v for v, _ in totals]).alias("total"), F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for v, k in totals]).alias("total_from"),
        F.coalesce("line_items", F.lit(0)).alias("line_items"), "original",
    )


def fill_gaps(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """doc_id, field, value, page, provenance and source: the primary reader's value unless it is empty or 0, then the secondary's.

    Page and provenance are those of the reader whose value it is.
    """
    def read(df: DataFrame, name: str) -> DataFrame:
        useful = ~F.coalesce("value", F.lit("")).isin("", "0", "0.0", "0.00")
        return df.filter(useful).select("doc_id", "field", F.struct("value", "page", "provenance").alias(name))

    both = read(primary, "p").join(read(secondary, "s"), ["doc_id", "field"], "full_outer")
    chosen = both.select("doc_id", "field", F.coalesce("p", "s").alias("c"), F.when(F.col("p").isNotNull(), "primary").otherwise("secondary").alias("source"))
    return chosen.select("doc_id", "field", "c.*", "source")


def template_drift(expected: DataFrame, reads: DataFrame) -> DataFrame:
    """Template fields (doc_id, field) without a value."""
    return expected.join(reads.filter(F.coalesce("value", F.lit("")) != ""), ["doc_id", "field"], "left_anti")


def reader_crosscheck(a: DataFrame, b: DataFrame, money_fields: tuple[str, ...] = ("subtotal", "tax", "total"), date_fields: tuple[str, ...] = ("issue_date", "due_date")) -> DataFrame:
    """doc_id, field and verdict of two readers: agree, disagree, or unverified where only one read it.

    Amounts agree within 0.02, dates where they are one day, whatever their form, other texts where one holds the other.
    """
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["doc_id", "field"], "full_outer")
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]", "")
    money = F.abs(F.col("a").try_cast("double") - F.col("b").try_cast("double")) <= 0.02
    day = date_value(F.col("a")) == date_value(F.col("b"))
    text = F.contains(plain("a"), plain("b")) | F.contains(plain("b"), plain("a"))
    same = F.when(F.col("field").isin(list(money_fields)), F.coalesce(money, F.lit(False))).when(F.col("field").isin(list(date_fields)), F.coalesce(day, F.lit(False))).otherwise(text)
    lacking = (F.coalesce("a", F.lit("")) == "") | (F.coalesce("b", F.lit("")) == "")
    return both.select("doc_id", "field", F.when(lacking, "unverified").when(same, "agree").otherwise("disagree").alias("verdict"))


def field_triage(reads: DataFrame, order: tuple[str, ...] = ("vendor", "invoice_number", "issue_date", "due_date", "currency", "total", "iban")) -> DataFrame:
    """id, field, colour, reason and place of (id, field, value, provenance): what needs a look comes first."""
    empty = F.coalesce("value", F.lit("")) == ""
    reason = F.when(empty, "missing").when(F.col("provenance") == "derived", "derived").when(F.col("provenance") == "guess", "guess")
    rows = reads.withColumn("reason", reason).withColumn("colour", F.when(F.col("reason").isNull(), "green").otherwise("amber"))
    rank = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("field"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("colour", rank, "field"))
    return rows.select("id", "field", "colour", "reason", place.alias("place"))


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))


def producer_signals(pages: DataFrame, by: str = "source") -> DataFrame:
    """Documents by producer and class: text-layer, mixed or image-only, by the characters on their pages."""
    sizes = pages.groupBy(by, "doc_id").agg(F.sum(F.length("text")).alias("chars"))
    kind = F.when(F.col("chars") >= 400, "text-layer").when(F.col("chars") >= 100, "mixed").otherwise("image-only")
    return sizes.groupBy(by, kind.alias("kind")).agg(F.count("*").alias("n"))


def vendor_embedding(texts: DataFrame, buckets: int = 256) -> DataFrame:
    """doc_id, the fingerprint of a text's distinct words, and a unit vector of its hashed words; words have two letters or more.

    A text without such a word has a vector of zeros.
    """
    rows = texts.select("doc_id", F.filter(words_in(F.coalesce("text", F.lit(""))), lambda w: F.length(w) > 1).alias("words"))
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    rows = rows.select("doc_id", F.sha2(F.array_join(F.sort_array(F.array_distinct("words")), " "), 256).alias("fingerprint"), F.sort_array(F.transform("words", bucket)).alias("found"))

    def counted(found: Column) -> Column:
        """Zeros up to each bucket, its count, and zeros to the end: a step a word, not one a bucket."""
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        own = F.array_distinct(found)
        each = F.transform(own, lambda b: F.struct(b.alias("b"), (F.size(found) - F.size(F.array_remove(found, b))).cast("double").alias("n")))

        def laid(counts: Column) -> Column:
            norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.n * c.n))
            before = lambda i: F.coalesce(F.get(counts, i - 1).b, F.lit(-1))
            filled = let(norm, lambda length: F.flatten(F.transform(counts, lambda c, i: F.array_append(zeros(c.b - before(i) - 1), c.n / length))))
            return F.concat(filled, zeros(F.lit(buckets - 1) - F.coalesce(F.try_element_at(counts, F.lit(-1)).b, F.lit(-1))))

        return let(each, laid)

    return rows.select("doc_id", "fingerprint", counted(F.col("found")).alias("embedding"))
