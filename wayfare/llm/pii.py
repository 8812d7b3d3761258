"""Personal data: high-recall candidates, boosted trees, calibrated redaction.

The base forms (email, ip, card, phone) are exact. Beside them, generators with loose forms propose overlapping
candidates: card-like numbers (also with a wrong check digit, or side by side), phone numbers without a plus, masked
email addresses, personal and bank account numbers, dates of birth. Boosted trees score each by its format, its check
digits, what stands around it and how much of the text near it is numbers; for each kind a threshold is calibrated
for precision on rows that the trees have not seen, and selects the spans that are added. The trees are trained here,
on sentences made by a rule whose words are other than those that the features look for, though they share some;
they are applied as plain column expressions, so that a document is scanned, scored and resolved in one projection,
without shuffle, join or Python.

Positions come from the lengths of the text between matches. Expressions are possessive and anchored at the start
of a run, so that they neither recurse nor go back over long runs.

Defined results: null or empty texts have no spans; null ids and repeated rows each give their row; an empty table
gives no rows; other columns are ignored; texts are taken whole at any length. Spans are in code points, the end
exclusive; a base span stays, an added one never overlaps a base one, and of added ones that overlap the longer
stays (a number holds its parts), then the likelier, then the earlier.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: The kinds in the order of ties, and their forms. ``\\G`` is the end of the match before.
KINDS = ("email", "ip", "card", "phone", "id", "iban", "birth")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?![0-9])"
#: Loose forms of the generators.
LOOSE = {
    "card": r"(?<![0-9A-Za-z.,+-])(?:(?<![0-9]\x20)[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{12,19})(?![0-9A-Za-z]|[.,-][0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{2,5}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}|0[0-9]{2,4}[\x20/-][0-9]{5,8})(?![0-9A-Za-z]|[.-][0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?![0-9A-Za-z])",
    "birth": r"(?<![0-9A-Za-z./-])(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))(?![0-9A-Za-z]|[./-][0-9])",
}
#: What must occur in a text for a generator to be tried.
TRIED = {"card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9][\x20.)/-]{1,2}[0-9]", "email": r"[\[({]at[\])}]", "id": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "birth": r"[./-](?:19|20)[0-9]{2}|[0-9]{4}-[0-9]"}
CUES = r"(?i)call|phone|tel|mobile|cell|fax|contact|reach|ssn|social|security|mail|write|born|birth|personal|card|visa|pay|iban|account"
DOUBTS = r"(?i)order|invoice|isbn|version|ref|page|part|sku|price|total|serial|model|batch|item|ticket|chapter|track|code|hash|score|booking|ship|article|points|\b(?:lot|case|po|sku) "
CONTEXT = 28


def spans_of(text: Column, form: str, good: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, match) of all matches that are good, from left to right.

    A match that isn't good moves the position on and is not gathered: texts can be full of numbers.
    """
    found, between = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        more = F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.struct(end.alias("at"), (F.when(good(pair), more).otherwise(acc["out"]) if good else more).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)").alias("out"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n - F.when(n > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base forms by kind; a form is tried only where its marks occur at all."""

    def card(x: Column) -> Column:
        n = F.char_length(_digits(x["match"]))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(x["match"]))).otherwise(F.lit(False))

    def phone(x: Column) -> Column:
        n = F.char_length(_digits(x["match"]))
        return (n >= 9) & (n <= 15)

    byte = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
    tried = {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["match"].rlike(byte)),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, card),
        "phone": (F.contains(text, F.lit("+")), PHONE, phone),
    }
    return {k: F.when(can, spans_of(text, form, good)).otherwise(_none()) for k, (can, form, good) in tried.items()}


FEATURES = ["f_digits", "f_length", "f_separators", "f_brackets", "f_year", "f_cue", "f_doubt", "f_repeat", "f_kind", "f_luhn", "f_first", "f_mod97", "f_mark_before", "f_numbers_near", "f_colon"]


def mod97(match: Column) -> Column:
    """Whether an account number's check digits are right: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    left = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("A", "Z"), 100).otherwise(10) + value(c)) % 97)
    return left == 1


def candidates(text: Column) -> Column:
    """Array of (start, end, kind, f_...) that the generators propose; they may overlap."""
    parts = [F.transform(F.when(text.rlike(TRIED[kind]), spans_of(text, form)).otherwise(_none()), _described(text, kind)) for kind, form in LOOSE.items()]
    return F.concat(*parts)


def _described(text: Column, kind: str) -> Callable[[Column], Column]:
    return lambda x: _features(text, x, kind)


def _features(text: Column, x: Column, kind: str) -> Column:
    match, digits = x["match"], _digits(x["match"])
    left = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
    right = F.substring(text, x["end"] + 1, F.lit(CONTEXT))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    values = [
        number(F.char_length(digits)),
        number(F.char_length(match)),
        number(F.char_length(F.regexp_replace(match, r"[^\x20./-]", ""))),
        number(F.contains(match, F.lit("("))),
        number(digits.rlike("^(?:19|20)[0-9]{2}")),
        number(left.rlike(CUES)),
        number(left.rlike(DOUBTS)),
        number(digits.rlike(r"^([0-9])\1*$")),
        F.lit(float(KINDS.index(kind))),
        number(luhn(digits)) if kind == "card" else F.lit(0.0),
        F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        number(mod97(match)) if kind == "iban" else F.lit(0.0),
        number(left.rlike(r"[#$€£=/_]\x20?$")),
        number(F.char_length(F.regexp_replace(F.concat(left, right), "[^0-9]", ""))),
        number(left.rlike(r"[:=]\x20?$")),
    ]
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), *[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])


def training_rows(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """Sentences with one candidate or more and whether they are personal, by a fixed rule over 0..n-1.

    Half of the personal ones have no word that leads to them, as in real text. What is not personal looks alike:
    barcodes, times in digits, order and parcel numbers, rows of figures, dates of events.
    """
    pick = lambda salt, *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    part = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m))
    digits = lambda salt, k: F.lpad(part(salt, 10**k).cast("string"), k, "3")
    person = part("label", 2) == 0
    kind = part("kind", 6)
    filler = pick("filler", "the river was calm and", "il fait beau et", "no one knew why", "die Leute sagen", "we walked along while", "she smiled;", "todo va bien,", "Later on", "in 2021 the 3 of them said", "room 12 at 10:30,", "try 555-010-9988 or call", "10.5 and 2024-01-02")
    after = pick("after", " and so on.", " today", " before noon, they said", ".", " oder so", "; thanks", " en la casa", " or 555-010-7766 later", " before 2019, 3 times", " call 555-201-9933 call 555-201-9933")
    sep = pick("sep", "-", " ", "-", " ")
    # personal forms
    long16 = F.concat(pick("brand", "2", "3", "4", "5", "6", "4", "5", "9", "1", "7", "8"), digits("c1", 15))
    grouped = joined(sep, digits("c2", 4), digits("c3", 4), digits("c4", 4), digits("c5", 4))
    card = pick_column("form", long16, grouped, F.concat(long16, F.lit(" "), long16))
    phone = pick_column(
        "form",
        F.concat(F.lit("("), digits("a", 3), F.lit(") "), digits("b", 3), F.lit("-"), digits("c", 4)),
        F.concat(digits("a", 3), pick("psep", "-", ".", " "), digits("b", 3), pick("psep", "-", ".", " "), digits("c", 4)),
        F.concat(F.lit("0"), digits("a", 3), pick("slash", "/", " ", "-"), digits("b", 7)),
    )
    masked = F.concat(pick("name", "ann", "j.doe", "mo_li", "kim99"), pick("at", " [at] ", "(at)", " (at) "), pick("host", "mail", "home", "work-place"), pick("dot", ".", " [dot] ", "(dot)"), pick("tld", "org", "com", "net"))
    social = F.concat_ws("-", digits("g", 3), digits("h", 2), digits("i", 4))
    iban = valid_iban(F.concat(pick("land", "DE", "FR", "ES", "GB"), F.lit("00"), digits("k", 9), digits("l", 9)))
    spaced = F.regexp_replace(iban, "(.{4})(?=.)", "$1 ")
    iban = pick_column("spaced", iban, spaced)
    birth = joined(pick("dsep", ".", "/", "-"), F.lpad((part("day", 28) + 1).cast("string"), 2, "0"), F.lpad((part("month", 12) + 1).cast("string"), 2, "0"), (1930 + part("year", 80)).cast("string"))
    # forms that look alike
    barcode = F.concat(pick("gs1", "978", "979", "0", "500", "400"), digits("m", 10))
    moment = F.concat(F.lit("20"), digits("n", 2), F.lpad((part("mo2", 12) + 1).cast("string"), 2, "0"), digits("o", 8), F.when(part("ms", 2) == 0, digits("ms2", 3)).otherwise(F.lit("")))
    parcel = F.concat(pick("par", "1", "9", "0"), digits("p", 14))
    figures = F.concat_ws(" ", digits("q", 3), digits("r", 3), digits("s", 4), digits("t", 3), digits("u", 4), digits("v", 2))
    lot = F.concat(pick("lots", "AB", "XK", "ZZ", "LT", "DE", "FR"), joined(pick("lotsep", " ", ""), digits("w", 2), digits("x", 4), digits("y", 4), digits("z", 4)))
    lot = pick_column("lotlen", lot, F.concat(lot, F.lit(" "), digits("z2", 4), F.lit(" "), digits("z3", 4)))
    # words that lead to either; some of them are words that the features look for
    cue = {
        0: pick("cue", "card", "my visa", "Karte", "carta", "debit"), 1: pick("cue", "call", "phone", "ring me on", "dial", "mobile:", "Rufnummer", "whatsapp"), 2: pick("cue", "write to", "e-mail", "ping", "reach me at"),
        3: pick("cue", "my ssn is", "social security", "taxpayer id", "my number:"), 4: pick("cue", "IBAN", "account", "Konto", "transfer to"), 5: pick("cue", "born", "date of birth:", "geboren am", "née le", "DOB", "birthday"),
    }
    doubt = pick("doubt", "order", "invoice", "isbn", "parcel", "ref.", "barcode", "part no.", "sku", "total of", "serial", "ticket", "Sendung", "at", "log", "file", "key #")
    led = part("led", 2) == 0
    said = F.lit(None).cast("string")
    unlike = F.lit(None).cast("string")
    # numbers also stand in lists
    listed = pick_column("list", phone, F.concat(*[x for _ in range(3) for x in (phone, F.lit(" "), cue[1], F.lit(" "))], phone), phone)
    personal = [card, listed, masked, social, iban, birth]
    plain = [pick_column("form", barcode, moment, parcel), pick_column("form", figures, moment, figures), masked, social, lot, birth]
    for k in range(6):
        said = F.when(kind == k, F.concat(F.when(led | (kind == 5), F.concat(cue[k], F.lit(" "))).otherwise(F.lit("")), personal[k])).otherwise(said)
        unlike = F.when(kind == k, F.concat(F.when(led | kind.isin(3, 5), F.concat(F.when(kind == 5, pick("event", "on", "since", "the fair of", "updated", "due")).otherwise(doubt), F.lit(" "))).otherwise(F.lit("")), plain[k])).otherwise(unlike)
    # what is masked as an address is one, whatever stands before it
    label = F.when(kind == 2, True).otherwise(person)
    rows = spark.range(0, n, 1, 1).select("id", label.cast("double").alias("label"), F.concat(filler, F.lit(" "), F.when(label, said).otherwise(unlike), after).alias("text"))
    return rows.select("id", "label", F.inline(F.filter(candidates(F.col("text")), lambda x: ~F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]).rlike("^555-(?:010|201)-"))))


def planted_rows(spark: SparkSession, n: int = 8_000, *, first: int = 0) -> DataFrame:
    """Candidates (id, label, kind, f_...) of sentences by a second rule, whose words, order and shares are other than those of the training rows.

    They calibrate the thresholds, and others (from ``first`` on) measure precision and recall.
    """
    pick = lambda salt, *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit("planted"), F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    part = lambda salt, m: F.pmod(F.xxhash64(F.lit("planted"), F.lit(salt), "id"), F.lit(m))
    digits = lambda salt, k: F.lpad(part(salt, 10**k).cast("string"), k, "7")
    two = lambda salt, m, low=1: F.lpad((part(salt, m) + low).cast("string"), 2, "0")
    kind, person, led = part("kind", 6), part("label", 2) == 0, part("led", 5) < 3
    opener = pick("opener", "Hello team,", "On Tuesday", "Liebe Grüße,", "Buenos días.", "Merci d'avance,", "PS", "Re: your note,", "He wrote:", "12 of us heard that", "At 9:15")
    closer = pick("closer", "", ", thank you.", " please", " if need be.", " (see below)", "\nKind regards", " - bis bald", ", gracias")
    fours = [digits(f"four{i}", 4) for i in range(4)]
    card = pick_column("planted_card", F.concat(pick("brand", "3", "4", "5", "6"), digits("card", 15)), joined(pick("csep", " ", "-"), F.concat(pick("brand2", "3", "4", "5", "6"), digits("three", 3)), *fours[1:]))
    phone = pick_column("planted_phone", joined(pick("psep", "-", ".", " "), digits("area", 3), digits("mid", 3), digits("last", 4)), F.concat(F.lit("("), digits("area", 3), F.lit(") "), digits("mid", 3), F.lit(" "), digits("last", 4)), F.concat(F.lit("0"), digits("code", 3), F.lit("-"), digits("rest", 6)))
    address = F.concat(pick("who", "maria", "t.schmidt", "lee2", "info"), pick("at", " (at) ", " [at] ", "{at}"), pick("where", "post", "example", "city-net"), pick("dot", ".", " (dot) "), pick("end", "org", "fr", "de"))
    social = joined(F.lit("-"), digits("s1", 3), digits("s2", 2), digits("s3", 4))
    iban = valid_iban(F.concat(pick("land", "DE", "NL", "IT", "CH"), F.lit("00"), digits("i1", 8), digits("i2", 8)))
    iban = pick_column("planted_iban", iban, F.regexp_replace(iban, "(.{4})(?=.)", "$1 "))
    day = joined(pick("dsep", "/", ".", "-"), two("dd", 28), two("mm", 12), (1945 + part("yy", 60)).cast("string"))
    event = joined(pick("dsep", "/", ".", "-"), two("dd", 28), two("mm", 12), (2001 + part("yy", 24)).cast("string"))
    lead = [
        pick("lead", "charge it to my card", "Kreditkarte", "visa ending the list:", "pay from"), pick("lead", "text me on my cell", "Tel.", "fax", "phone me:", "call"), pick("lead", "mail", "send it to", "contact"),
        pick("lead", "SSN", "my social security no. is", "personal number"), pick("lead", "IBAN:", "wire to account", "Konto"), pick("lead", "born", "birth date", "she was born on", "birthday:"),
    ]
    doubt = pick("doubt", "Order", "shipment", "score", "booking", "tracking no.", "case", "SKU", "article", "Ticket", "PO", "serial no.", "invoice")
    lookalike = [
        pick_column("planted_like", F.concat(pick("zero", "0", "1", "8", "9", "7"), digits("order", 12)), card, F.concat(F.lit("20"), digits("t1", 2), two("t2", 12), two("t3", 28), digits("t4", 6))),
        phone, address, social, F.concat(pick("lot", "AB", "QX", "PT", "NO"), digits("l1", 2), F.lit(" "), digits("l2", 4), F.lit(" "), digits("l3", 4), F.lit(" "), digits("l4", 4)), event,
    ]
    said = unlike = F.lit(None).cast("string")
    personal = [card, phone, address, social, iban, day]
    for k in range(6):
        # dates and numbers of persons are told by what leads to them alone
        said = F.when(kind == k, F.concat(F.when(led | kind.isin(3, 5), F.concat(lead[k], F.lit(" "))).otherwise(F.lit("")), personal[k])).otherwise(said)
        unlike = F.when(kind == k, F.concat(F.when(kind == 5, pick("dated", "valid until", "the match of", "as of", "posted")).otherwise(doubt), F.lit(" "), lookalike[k])).otherwise(unlike)
    label = F.when(kind == 2, True).otherwise(person)
    rows = spark.range(first, first + n, 1, 1).select("id", label.cast("double").alias("label"), F.concat(opener, F.lit(" "), F.when(label, said).otherwise(unlike), closer).alias("text"))
    return rows.select("id", "label", F.inline(candidates(F.col("text"))))


def joined(separator: Column, *parts: Column) -> Column:
    return F.concat(parts[0], *[x for p in parts[1:] for x in (separator, p)])


def pick_column(salt: str, *columns: Column) -> Column:
    out = columns[-1]
    for i, c in enumerate(columns[:-1]):
        out = F.when(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(columns))) == i, c).otherwise(out)
    return out


def valid_iban(number: Column) -> Column:
    """The number with check digits that are right; it has 00 in their place."""
    moved = F.concat(F.substring(number, 5, 40), F.substring(number, 1, 4))
    left = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("A", "Z"), 100).otherwise(10) + F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.try_cast("int"))) % 97)
    return F.concat(F.substring(number, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), F.substring(number, 5, 40))


def _scored(model: GBTClassificationModel, rows: DataFrame) -> list:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "kind", "features")
    return model.transform(vectors).select("label", "kind", vector_to_array("probability")[1].alias("p")).collect()


def trained(spark: SparkSession, *, rounds: int = 20, depth: int = 4) -> GBTClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(training_rows(spark)).select("label", "features").persist()
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(rows)
    rows.unpersist()
    return model


@lru_cache(maxsize=1)
def fitted(app: str, spark: SparkSession, *, rounds: int = 20, depth: int = 4, precision: float = 0.95) -> tuple[Trees, dict[str, float]]:
    """(boosted trees, threshold of each kind): trained on the sentences of one rule, calibrated on those of another.

    A kind's threshold is the least above which the precision is reached there, lowered towards the next score below it,
    or one that nothing passes.
    """
    del app
    model = trained(spark, rounds=rounds, depth=depth)
    scored = _scored(model, planted_rows(spark))
    by_kind = {k: [(r["p"], r["label"]) for r in scored if r["kind"] == k] for k in LOOSE}
    return _trees(model), {k: lowered(rows, calibrated(rows, precision)) for k, rows in by_kind.items()}


def lowered(scored: list[tuple[float, float]], least: float) -> float:
    """A threshold lowered by three quarters of the way to the next score below it: no row there lies between, and what does elsewhere is rather taken than left."""
    below = max((p for p, _ in scored if p < least), default=least)
    return least if least > 1 else below + (least - below) / 4


def measured(spark: SparkSession, *, n: int = 8_000) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind's threshold on planted candidates that neither trained nor calibrated."""
    _, thresholds = fitted(spark.sparkContext.applicationId, spark)
    scored = _scored(trained(spark), planted_rows(spark, n, first=1_000_000))
    out = {}
    for k, least in thresholds.items():
        rows = [(r["p"] >= least, r["label"] == 1) for r in scored if r["kind"] == k]
        both = sum(a and b for a, b in rows)
        out[k] = (both / max(1, sum(a for a, _ in rows)), both / max(1, sum(b for _, b in rows)))
    return out


def calibrated(scored: list[tuple[float, float]], precision: float) -> float:
    """The least score from which on the share of positives is at least ``precision``."""
    best, hits = 2.0, 0.0
    ordered = sorted(scored, reverse=True)
    for i, (p, label) in enumerate(ordered, 1):
        hits += label
        if hits / i >= precision and (i == len(ordered) or ordered[i][0] < p):
            best = p
    return best


Trees = list[tuple[float, tuple]]


def _trees(model: GBTClassificationModel) -> Trees:
    """(weight, tree) of each tree; a tree is (feature, threshold, left, right) or (value,)."""

    def node(n) -> tuple:  # noqa: ANN001
        if n.subtreeDepth() == 0:
            return (n.prediction(),)
        return (n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

    return [(w, node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def boosted(trees: Trees, x: Column) -> Column:
    """Probability that a candidate is personal."""

    def value(t: tuple) -> Column:
        return F.lit(t[0]) if len(t) == 1 else F.when(x[FEATURES[t[0]]] <= t[1], value(t[2])).otherwise(value(t[3]))

    margin = sum((F.lit(w) * value(t) for w, t in trees), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-2 * margin))


def find(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and ``keep``), base and added: arrays of (start, kind rank, end) of the spans of each text."""
    spark = docs.sparkSession
    trees, thresholds = fitted(spark.sparkContext.applicationId, spark)
    least = F.map_from_arrays(F.array(*map(F.lit, thresholds)), F.array(*map(F.lit, thresholds.values())))
    ids = keep or ["doc_id"]
    text = F.col("text")
    ranked = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), x["end"].alias("end"))
    with_base = docs.select(*ids, text_or_empty().alias("text")).select(*ids, "text", *[v.alias(k) for k, v in base_spans(text).items()], candidates(text).alias("candidates"))
    base = F.array_sort(F.concat(*[F.transform(k, ranked(k)) for k in KINDS[:4]]))
    scored = F.transform("candidates", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), boosted(trees, x).alias("p"), F.lit(0).alias("base"), x["kind"].alias("kind")))
    found = with_base.select(*ids, "text", base.alias("base"), F.filter(scored, lambda x: x["p"] >= F.element_at(least, x["kind"])).alias("likely"))
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    added = F.transform(resolved(F.col("base"), F.col("likely")), lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end")))
    nothing = F.expr("cast(array() as array<struct<start: int, rank: int, end: int>>)")
    return found.select(*ids, "text", "base", F.when(F.size("likely") > 0, added).otherwise(nothing).alias("added"))


SPAN = "struct<start: int, end: int, p: double, base: int, kind: string>"


def resolved(base: Column, likely: Column) -> Column:
    """The candidates (start, end, p, base, kind) that overlap no base span, and of those that overlap the longest, then likeliest; in two sweeps by position."""
    none, nowhere = F.expr(f"cast(array() as array<{SPAN}>)"), F.expr(f"cast(null as {SPAN})")
    marked = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(2.0).alias("p"), F.lit(1).alias("base"), F.lit("").alias("kind")))
    every = F.array_sort(F.concat(marked, likely))

    def back(acc: Column, x: Column) -> Column:
        """From the right: without candidates that reach into the next base span."""
        free = (x["base"] == 1) | (x["end"] <= acc["next"])
        return F.struct(F.when(x["base"] == 1, x["start"]).otherwise(acc["next"]).alias("next"), F.when(free, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    def better(x: Column, y: Column) -> Column:
        order = lambda z: F.struct(z["end"] - z["start"], z["p"], -z["start"])
        return F.when(order(x) >= order(y), x).otherwise(y)

    def forth(acc: Column, x: Column) -> Column:
        """From the left: without candidates that an earlier base span reaches into; one stays of those that overlap."""
        is_base = x["base"] == 1
        covered = ~is_base & (x["start"] < acc["covered"])
        apart = acc["last"].isNull() | (x["start"] >= acc["last"]["end"])
        told = ~is_base & ~covered & apart & acc["last"].isNotNull()
        last = F.when(is_base | covered, acc["last"]).when(apart, x).otherwise(better(acc["last"], x))
        return F.struct(F.when(is_base, F.greatest(acc["covered"], x["end"])).otherwise(acc["covered"]).alias("covered"), last.alias("last"), F.when(told, F.array_append(acc["out"], acc["last"])).otherwise(acc["out"]).alias("out"))

    free = F.aggregate(F.reverse(every), F.struct(F.lit(2**31 - 1).alias("next"), none.alias("out")), back, lambda acc: F.reverse(acc["out"]))
    return F.aggregate(free, F.struct(F.lit(-1).alias("covered"), nowhere.alias("last"), none.alias("out")), forth, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added and n_spans of every row of ``docs`` (doc_id, text)."""
    found = find(docs)
    of = lambda k: lambda x: x["rank"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    sizes = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), *sizes)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    others = [c for c in docs.columns if c != "text"]
    found = find(docs.select(F.struct(*others).alias("others"), "text"), keep=["others"])
    spans = F.array_sort(F.concat("base", "added"))
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        piece = F.when(new, F.concat(gap, F.lit("<"), F.get(names, x["rank"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length(F.col("text")))))
    return found.select("others.*", done.alias("text")).select(*docs.columns)
