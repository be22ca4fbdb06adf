"""Personal data by proposed spans, checksums and context words, in DataFrame functions alone.

Expressions propose spans; card numbers must pass Luhn's checksum and account
numbers the mod-97 one.  Every span has a score that words close to it raise or
lower.  One pass over the texts, no shuffle.

Defined cases: a null or empty text has no spans; repeated rows are scanned
alike; other columns are not read.  The expressions are the contract's, written
so that no text makes them retry: a run of characters is taken whole, and a
search begins only where a run begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, spans

#: Kinds of the contract, then the added one, in the order of `kind`.
KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = 4
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?+[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"

#: Score of a confirmed span by kind, and what a context word within CONTEXT code points before or after adds or takes.
SCORES = [0.9, 0.5, 0.8, 0.6, 0.9]
CONTEXT = 40
RAISE = [
    "mail|contact|write to|kontakt|correo|courriel", "\\bip\\b|address|host|server|login|adresse|dirección",
    "card|visa|credit|debit|payment|karte|carte|tarjeta", "phone|call|tel|mobile|fax|ruf|llam|appel", "iban|account|bank|konto|compte|cuenta",
]
LOWER = ["example\\.|noreply|no-reply", "version|release|chapter|section", "order|invoice|serial|tracking|isbn", "order|invoice|serial|version", "example|sample"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum: every second one from the right counts double."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, leaves 1 mod 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97))
    return left == 1


def find_spans(text: Column) -> Column:
    """All spans of a text, by kind and then start."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    some_digits = text.rlike("[0-9]")
    email = spans.find(text, text.contains("@"), EMAIL, 0)
    part_ok = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    ip = F.filter(spans.find(text, some_digits & text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"), IP, 1), lambda s: F.forall(F.split(s["value"], "\\."), part_ok))
    card = spans.find(text, some_digits & text.rlike("[0-9](?:[\\x20-]?+[0-9]){15}"), CARD, 2)
    card = F.filter(card, lambda s: F.length(digits(s)).between(16, 19))
    card = F.filter(card, lambda s: luhn(digits(s)))
    phone = F.filter(spans.find(text, text.contains("+"), PHONE, 3), lambda s: F.length(digits(s)).between(8, 15))
    iban = F.filter(spans.find(text, some_digits & text.rlike("[A-Z]{2}[0-9]{2}[\\x20A-Z0-9]{11}"), IBAN, 4), lambda s: mod97(s["value"]))
    return F.concat(email, ip, card, phone, iban)


def score(text: Column, span: Column) -> Column:
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, (start + 1).cast("int"), (span["start"] - start).cast("int")))
    after = F.lower(F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT)))
    near = F.concat(before, F.lit(" "), F.lower(span["value"]), F.lit(" "), after)
    out = F.lit(0.0)
    for kind, base in enumerate(SCORES):
        own = F.lit(base) + F.when(F.concat(before, F.lit(" "), after).rlike(RAISE[kind]), 0.1).otherwise(0.0) - F.when(near.rlike(LOWER[kind]), 0.3).otherwise(0.0)
        out = F.when(span["kind"] == kind, own).otherwise(out)
    return F.round(out, 2)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, their scores in the same order, and the highest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), find_spans(text).alias("found"))
    scored = F.when(F.size("found") > 0, F.transform("found", lambda s: score(F.col("text"), s))).otherwise(F.array().cast("array<double>"))
    slim = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select("doc_id", slim.alias("found"), scored.alias("scores"))
    base = F.filter("found", lambda s: s["kind"] < BASE)
    return found.select(
        "doc_id", *[spans.count(F.col("found"), i).alias(f"n_{KINDS[i]}") for i in range(BASE)], F.sha2(spans.joined(base, KINDS), 256).alias("base_sha256"), spans.joined(F.col("found"), KINDS).alias("spans"),
        F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("top_score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
