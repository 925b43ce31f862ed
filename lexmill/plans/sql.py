"""Fragments of DuckDB SQL that the catalogue's reference queries share."""

from __future__ import annotations

from lexmill.functions import clean, lists, split


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def among(x: str, items) -> str:
    return f"{x} in ({', '.join(map(quote, items))})"


def whole(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(f'^(?:{pattern})$')})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


TOK = f"tok as (select doc_id, unnest(w) token, unnest(range(len(w))) pos from (select doc_id, {words('text')} w from documents))"
TF = f"{TOK}, tf as (select doc_id, token, count(*) tf from tok group by all)"
DF = f"{TF}, df as (select token, count(*) df, cast(sum(tf) as bigint) cf from tf group by all), nd as (select count(*) n from documents)"
IDF = f"{DF}, idf as (select token, log2(n / df) weight from df, nd)"
TOPIC = f"""{TF}, lab as (select doc_id, source topic from documents), tw as (select topic, token, n / sum(n) over (partition by topic) p from (select topic, token, sum(tf) n from tf join lab using (doc_id) group by all)),
    tm as (select topic, mass / sum(mass) over () p, mass from (select topic, sum(tf) mass from tf join lab using (doc_id) group by all)), wm as (select token, sum(tw.p * tm.p) p from tw join tm using (topic) group by 1)"""
DISTINCT = f"""{TOPIC}, tg as (select token, topic, p / sum(p) over (partition by token) p from tw), dis as (select token, sum(tg.p * ln(tg.p / tm.p)) weight from tg join tm using (topic) group by 1),
    prom as (select token, (weight - min(weight) over ()) / (max(weight) over () - min(weight) over ()) weight from dis)"""


def step(name: str, x: str) -> str:
    if name == "tags":
        return f"regexp_replace({x}, {quote(clean.TAG)}, '', 'g')"
    if name == "entities":
        for entity, char in clean.ENTITIES.items():
            x = f"replace({x}, {quote(entity)}, {quote(char)})"
        return x
    if name == "odd":
        return f"regexp_replace({x}, {quote(clean.ODD)}, ' ', 'g')"
    if name == "width":
        return f"translate({x}, {quote(clean.FULL)}, {quote(clean.HALF)})"
    if name == "runs":
        for c in clean.RUNS:
            x = f"regexp_replace({x}, '\\x{{{ord(c):04X}}}{{2,}}', {'chr(10)' if c == chr(10) else 'chr(9)' if c == chr(9) else quote(c)}, 'g')"
        return x
    if name == "brackets":
        for _ in range(6):
            for pair in clean.PAIRS:
                a, b = (f"\\x{{{ord(c):04X}}}" for c in pair)
                x = f"regexp_replace({x}, '{a}[^{a}{b}]*{b}', '', 'g')"
        return x
    if name == "urls":
        return f"regexp_replace({x}, {quote(clean.URL)}, '', 'g')"
    if name == "emails":
        return f"regexp_replace({x}, {quote(clean.EMAIL)}, '', 'g')"
    x = f"{quote(clean.SENTINEL)} || {x} || {quote(clean.SENTINEL)}"
    for p in (clean.MOBILE, clean.MOBILE, clean.LANDLINE, clean.LANDLINE):
        x = f"regexp_replace({x}, {quote(p)}, '\\1\\2', 'g')"
    return f"(select y[2:-2] from (select {x} y))"


def cleaned(table: str, key: str, column: str, name: str = "cleaned", steps=tuple(clean.STEPS)) -> str:
    """CTEs that clean the column in the steps' order; the last one is `name` (key, text)."""
    out, source, x = [], table, column
    for i, s in enumerate(steps):
        to = name if i == len(steps) - 1 else f"{name}_{s}"
        out.append(f"{to} as materialized (select {key}, {step(s, x)} text from {source})")
        source, x = to, "text"
    return ", ".join(out)


def sentences(x: str, criterion: str) -> str:
    p = split.marks(criterion)
    every, plain = split.listed(p), split.listed(p.replace(split.FRONT, "").replace(split.BACK, ""))
    mark = lambda x, a, b: f"regexp_replace({x}, {quote(f'({a})({b})')}, '\\1' || chr(1) || '\\2', 'g')"
    x = mark(x, f"[{plain}]", f"[^{every}]")
    x = mark(x, f"[{every}]{split.BACK}", f"[^{every}]")
    for _ in range(2):
        x = mark(x, f"[{every}]", split.FRONT)
    return f"list_filter(string_split({x}, chr(1)), lambda s: s <> '')"


def tag(t: str) -> str:
    return (
        f"case when {among(t, lists.ALL_STOP_WORDS)} then 'u' when regexp_matches({t}, '^[0-9]') then 'm' when regexp_matches({t}, '(?:ly|mente|ment)$') then 'd' "
        f"when regexp_matches({t}, '(?:ing|ed|er|en|ar|ir)$') then 'v' when regexp_matches({t}, '(?:ble|ous|ive|lich|ig|isch|oso|osa|eux)$') then 'a' else 'n' end"
    )


def rounds(n: int, first: str, step: str) -> str:
    """CTEs s0 to sn: the first, and the step with {prev} for the one before."""
    return ", ".join([f"s0 as materialized ({first})", *[f"s{k} as materialized ({step.replace('{prev}', f's{k - 1}')})" for k in range(1, n + 1)]])
