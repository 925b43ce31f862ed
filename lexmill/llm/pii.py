"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

1. A kind's pattern (`KINDS`) proposes spans: leftmost, not overlapping within the kind.
   Patterns are written with possessive parts, so that long runs take linear time.
2. The kind's check confirms a span: Luhn for cards, mod 97 for IBANs, the size of parts
   or the number of digits for others, and what must not stand beside it.
3. A confirmed span has its kind's score; a context word before or after it adds
   `CONTEXT_BONUS`. Spans of `least_score` or more are reported. Emails, addresses, cards
   and phones pass with any context; social security numbers only with one.

All of it is column expressions over the row where the text is read: no shuffle, no Python.

Null texts count as empty and have no spans. Rows are answered each, repeated ones too.
Other columns are kept, but for one named like the result. An empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import located, matches_of

CONTEXT_BONUS = 0.3
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java's syntax
    plain: str  # the same matches without lookbehind and possessive parts, for SQL
    score: float
    context: str  # words, of which one before or after the span raises the score
    gate: str | None = None  # what any text with a match contains


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    # fixed patterns: email, ip, card, phone
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, "mail|contact|write|correo|courriel", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(?:\.[0-9]+){3}", 0.7, "ip|address|server|host|adresse|servidor", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", 0.7, "card|visa|credit|debit|mastercard|amex|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|telefon|móvil", "+"),
    # the method's own
    Kind("iban", "[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})", "[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})", 0.7, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social security|social-security", "-"),
    Kind("secret", *[f"(?:{'|'.join(map(_either_case, ('token', 'secret', 'api_key', 'api-key', 'apikey', 'password', 'passwd')))})[\"']? *[:=] *[\"']?[A-Za-z0-9_./+=-]{{16,128}}"] * 2, 0.8, "key|auth|login|credential"),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digits_mod(digits: Column, base: int) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 10 + d.try_cast("int")) % base))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: country and check digits go last, letters count from 10."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return _digits_mod(digits, 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    t, bare = m["text"], lambda: ~m["before"].rlike("[0-9A-Za-z-]$") & ~m["after"].rlike("^[0-9A-Za-z-]")
    if kind == "ip":
        return t.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.translate(t, " -", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(t, "+ ().-", "")).between(9, 15)
    if kind == "iban":
        return F.when(bare(), mod97(F.translate(t, " ", ""))).otherwise(F.lit(False))
    if kind == "ssn":
        return bare() & ~t.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _scored(kind: Kind, matches: Column, least_score: float) -> Column:
    near = lambda m: F.lower(F.concat(m["before"], F.lit(" "), m["after"])).rlike(rf"(?:^|[^a-z])(?:{kind.context})(?:[^a-z]|$)")
    sure = F.filter(matches, lambda m: _confirmed(kind.name, m))
    spans = F.transform(sure, lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.when(near(m), F.least(F.lit(1.0), F.lit(kind.score + CONTEXT_BONUS))).otherwise(F.lit(kind.score)).alias("score")))
    return F.filter(spans, lambda s: s["score"] >= least_score).cast(SPAN)


def find_pii(docs: DataFrame, least_score: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with pii: spans (kind, start, end, score) in the order of KINDS and of their starts."""
    out = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none")).alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    t = F.col("__t")
    df = df.select("__row", "__t", *[matches_of(t, k.pattern, F.contains(t, F.lit(k.gate)) if k.gate else None).alias(f"__m_{k.name}") for k in KINDS])
    df = df.select("__row", *[located(t, k.pattern, F.col(f"__m_{k.name}")).alias(f"__s_{k.name}") for k in KINDS])
    df = df.select("__row", F.concat(*[_scored(k, F.col(f"__s_{k.name}"), least_score) for k in KINDS]).alias("pii"))
    return df.select(*[F.col("__row")[c].alias(c) for c in out], "pii")


def op10(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(joined(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def _sql10(least_score: float = 0.5) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    part = lambda k, i: f"select doc_id, row_no, {i} o, {quote(k.name)} kind, t, regexp_extract_all(t, {quote(k.plain)}) ms, string_split_regex(t, {quote(k.plain)}) ps from d"
    digits = "translate(m, ' -', '')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 1 then 2 * cast(substr({digits}, i, 1) as int) - case when cast(substr({digits}, i, 1) as int) > 4 then 9 else 0 end else cast(substr({digits}, i, 1) as int) end)) % 10 = 0"
    turned = "string_split(substr(replace(m, ' ', ''), 5, 64) || substr(replace(m, ' ', ''), 1, 4), '')"
    mod = f"list_reduce(list_concat([0], list_transform(string_split(array_to_string(list_transform({turned}, lambda c: case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), ''), ''), lambda c: cast(c as int))), lambda a, x: (a * 10 + x) % 97) = 1"
    bare = "not regexp_matches(before, '[0-9A-Za-z-]$') and not regexp_matches(after, '^[0-9A-Za-z-]')"
    checks = {
        "ip": rf"regexp_matches(m, '^{_PART}(?:\.{_PART}){{3}}$')", "card": f"case when length({digits}) between 13 and 19 then {luhn_sql} else false end", "phone": "length(translate(m, '+ ().-', '')) between 9 and 15",
        "iban": f"case when {bare} then {mod} else false end", "ssn": f"{bare} and not regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    }
    check = "case kind " + " ".join(f"when '{k}' then {c}" for k, c in checks.items()) + " else true end"
    near = "case kind " + " ".join(f"when '{k.name}' then regexp_matches(lower(before || ' ' || after), '(?:^|[^a-z])(?:{k.context})(?:[^a-z]|$)')" for k in KINDS) + " end"
    base = "case kind " + " ".join(f"when '{k.name}' then {k.score}" for k in KINDS) + " end"
    return rf"""
with d as (select doc_id, row_number() over () row_no, coalesce(text, '') t from documents),
found as ({" union all ".join(part(k, i) for i, k in enumerate(KINDS))}),
placed as (
    select doc_id, row_no, o, kind, ms[i] m, right(ps[i], 48) before, left(ps[i + 1], 48) after,
    coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) s
    from (select *, unnest(range(1, len(ms) + 1)) i from found where len(ms) > 0)),
sure as (select doc_id, row_no, o, kind, cast(s as bigint) s, cast(s + length(m) as bigint) e, least(1.0, {base} + case when {near} then {CONTEXT_BONUS} else 0 end) score from placed where {check}),
agg as (
    select row_no, {", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < {len(BASE)}) base, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) spans
    from sure where score >= {least_score} group by row_no)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join agg using (row_no)
"""


SQL10 = _sql10()
