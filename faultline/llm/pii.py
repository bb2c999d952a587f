"""Personal data, by DataFrame functions alone: regular expressions propose spans, checksums and ranges confirm them, and
context words nearby adjust the score.

Each pattern is matched leftmost and without overlap by regexp_extract_all; where it has matches, split by the same
pattern gives the stretches between, whose lengths place the matches.  Patterns are written so that Java's engine needs
time in proportion to the text and constant stack: a match starts at the first character of a run or where the last match
ended, and repetitions are possessive, which changes no match, as what follows a repetition is never part of it.  Sums and
maxima along the matches are taken in blocks (`_running`), and parts of a long text are read from pieces of it (`_part`),
so time stays close to proportion to the text however many matches it has.

Kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits) are the base; card_short (13
to 15 digits, Luhn), iban (mod 97 is 1), ssn and secret (keys and tokens of known forms, and values that are assigned to a
password or token and hold a digit) are added if their score reaches `LEAST`.  A
score starts at the kind's prior, a passed checksum adds 0.4, and a context word within 40 characters before or 20 behind
adds 0.3.

Defined results: null and empty texts have no spans (base_sha256 is that of the empty string); repeated rows get equal
values; other columns are ignored (`op8_pii`) or passed on (`redacted`).  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
LEAST = 0.5
# fixed values: characters of an IBAN by country
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# fixed values: the patterns, each with what must be in a text for it to match at all
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[ -]?+[0-9])++", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "iban": (r"(?=[A-Z][A-Z][0-9][0-9])(?:" + "|".join(rf"(?:{codes.replace(' ', '|')})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN.items()) + ")", ""),
    "ssn": (r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "-"),
    "secret": (
        r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_]{20,}|xox[abops]-[A-Za-z0-9-]{12,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
        r"|(?i:password|passwd|token|secret|api[_-]?key)[\x22']? ?[=:] ?[\x22']?[A-Za-z0-9+/_.-]{8,}", "",
    ),
}
#: What a text has at least for a match of the kind to pass its checks; most numbers are too short.
LEAST_OF = {"card": "[0-9](?:[ -]?+[0-9]){12}", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "phone": r"\+[0-9][ ().0-9-]{6}", "ssn": "[0-9]-[0-9][0-9]-[0-9]", "iban": "[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]"}
#: What a text with a secret has at least: one of these, or a sign of assignment and one of the words.
SECRET, ASSIGNED = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xox", "eyJ"), "(?i)passw|token|secret|api[_-]?key"
PRIOR = {"card_short": 0.2, "iban": 0.4, "ssn": 0.3, "secret": 0.9}
CHECKED = {"card_short", "iban"}
CONTEXT = {
    "email": "e-?mail|contact|write to", "ip": "address|host|server|ip", "card": "card|visa|credit|payment", "card_short": "card|amex|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "ssn": "ssn|social security", "secret": "key|secret|token|aws",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digit_sum(digits: Column) -> Column:
    """The Luhn sum: every second digit from the right doubled, nines cast out."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, at(i)).when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return _digit_sum(digits) % 10 == 0


def mod97(iban: Column) -> Column:
    """Remainder by 97 of an IBAN (letters and digits only), its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Of an array of numbers, what `combine` (associative) makes of each value and all before it: within blocks of about
    the square root of their number, then over the blocks."""
    none = F.array().cast("array<bigint>")
    grow = lambda part: F.aggregate(part, none, lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, combine(F.try_element_at(a, F.lit(-1)), x)).otherwise(x))))

    def blocks(every: Column) -> Column:
        n = F.size(every)
        block = F.greatest(F.lit(64), F.ceil(F.sqrt(n))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: grow(F.slice(every, b * block + 1, block)))

    def joined(parts: Column) -> Column:
        lasts = grow(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _once(lasts, lambda last: F.flatten(F.transform(parts, lambda p, b: F.when(b == 0, p).otherwise(F.transform(p, lambda x: combine(F.get(last, b - 1), x))))))

    return _once(values, lambda every: F.when(F.size(every) > 0, _once(blocks(every), joined)).otherwise(none))


def _place(text: Column, matches: Column, pattern: str) -> Column:
    """matches as array of (start, text), with the lengths of what lies between them summed up."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = _running(steps, lambda a, x: a + x)
    return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), m.alias("text")))


#: Code points of a piece of a long text.
PIECE = 4096


def _pieces(text: Column) -> Column:
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` (0 is the first) of the text that these are the pieces of."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    return F.when(length <= 0, "").otherwise(F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (start - first * PIECE + 1).cast("int"), length.cast("int")))


def _apart(text: Column, m: Column) -> Column:
    """Neither the character before nor the one behind is a letter or digit; `text` is in pieces."""
    before, behind = F.when(m["start"] > 0, _part(text, m["start"] - 1, F.lit(1))).otherwise(""), _part(text, m["start"] + F.length(m["text"]), F.lit(1))
    return ~before.rlike("[A-Za-z0-9]") & ~behind.rlike("[A-Za-z0-9]")


def _confirmed(kind: str, text: Column, m: Column) -> Column:
    digits = F.regexp_replace(m["text"], "[^0-9]", "")
    if kind == "ip":
        return m["text"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "card_short":
        return F.when(F.length(digits).between(13, 15), luhn(digits)).otherwise(False) & _apart(text, m)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return (mod97(F.translate(m["text"], " ", "")) == 1) & _apart(text, m)
    if kind == "secret":
        return m["text"].rlike("[0-9]|^A[KS]IA") & _apart(text, m)
    return _apart(text, m) if kind == "ssn" else F.lit(True)


def _scored(kind: str, text: Column, m: Column) -> Column:
    near = F.concat(_part(text, F.greatest(F.lit(0), m["start"] - 40), F.least(F.lit(40), m["start"])), F.lit(" "), _part(text, m["start"] + F.length(m["text"]), F.lit(20)))
    word = F.lower(near).rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:[^a-z]|$)")
    first = PRIOR.get(kind, 0.6) + (0.4 if kind in CHECKED else 0.0)
    score = F.least(F.lit(1.0), F.round(F.lit(first) + F.when(word, 0.3).otherwise(0.0), 3))
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).cast("long").alias("end"), score.alias("score"))


def _own(df: DataFrame) -> str:
    """What names of helping columns begin with, so that none is one of the table's."""
    stem = "_"
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the array of all spans (a column of that name is replaced): the base kinds in their order, then the added ones,
    each by start.  Other columns stay, whatever their names."""
    own = _own(df)
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    digit = t.rlike("[0-9]")
    secret = (t.contains("=") | t.contains(":")) & t.rlike(ASSIGNED)
    for form in SECRET:
        secret = secret | t.contains(form)
    # a level of columns at a time, as each level is analysed anew
    matches = {}
    for kind, (pattern, needed) in PATTERNS.items():
        able = secret if kind == "secret" else (digit & t.contains(needed)) if needed and kind != "email" else t.contains(needed) if needed else digit
        able = able & t.rlike(LEAST_OF[kind]) if kind in LEAST_OF else able
        matches[f"{own}m_{kind}"] = F.when(able, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
    placed = {f"{own}pieces": _pieces(t)}
    for kind, (pattern, _) in PATTERNS.items():
        m = F.col(f"{own}m_{kind}")
        placed[f"{own}p_{kind}"] = F.when(F.size(m) > 0, _place(t, m, pattern)).otherwise(F.array().cast("array<struct<start:bigint,text:string>>"))
    whole, found, some = F.col(f"{own}pieces"), [], F.lit(False)
    for kind in (*BASE, "card_short", "iban", "ssn", "secret"):
        source = F.col(f"{own}p_" + ("card" if kind == "card_short" else kind))
        spans = F.transform(F.filter(source, lambda m: _confirmed(kind, whole, m)), lambda m: _scored(kind, whole, m))
        found.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST))
    for kind in PATTERNS:
        some = some | (F.size(f"{own}p_{kind}") > 0)
    df = df.withColumns(matches).withColumns(placed).withColumn(out, F.when(some, F.concat(*found)).otherwise(F.array().cast(SPAN)))
    return df.drop(f"{own}pieces", *[f"{own}{x}_{kind}" for kind in PATTERNS for x in "mp"])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in brackets; overlapping spans become one, named by the first.
    A null text stays null; other columns stay, whatever their names."""
    own = _own(df)
    df = with_spans(df, text, own + "spans")
    by_start = F.array_sort(F.transform(own + "spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    df = df.withColumn(own + "order", by_start)
    df = df.withColumn(own + "reach", _running(F.transform(own + "order", lambda s: -s["back"]), lambda a, x: F.greatest(a, x)))
    first = F.filter(F.transform(own + "order", lambda s, i: F.when((i == 0) | (s["start"] >= F.get(own + "reach", i - 1)), i)), lambda i: i.isNotNull())
    df = df.withColumn(own + "first", first).withColumn(own + "pieces", _pieces(F.col(text)))
    at = lambda i: F.get(own + "order", i)
    end = lambda j: F.get(own + "reach", F.coalesce(F.get(own + "first", j + 1), F.size(own + "order")) - 1)  # noqa: E731  (of the j-th stretch)
    before = lambda j: F.when(j == 0, F.lit(0).cast("long")).otherwise(end(j - 1))
    pieces = F.transform(own + "first", lambda i, j: F.concat(_part(F.col(own + "pieces"), before(j), at(i)["start"] - before(j)), F.lit("["), F.upper(at(i)["kind"]), F.lit("]")))
    last = F.array_max(own + "reach")
    new = F.when(F.size(own + "order") > 0, F.concat(F.array_join(pieces, ""), _part(F.col(own + "pieces"), last, F.length(text) - last))).otherwise(F.col(text))
    return df.withColumn(text, new).drop(own + "spans", own + "order", own + "reach", own + "first", own + "pieces")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of every document."""
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return docs.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


def _sql() -> str:
    """The same for DuckDB, whose engine needs no possessive repetitions and has no look-around."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+",
        "iban": PATTERNS["iban"][0].replace("(?=[A-Z][A-Z][0-9][0-9])", ""), **{k: PATTERNS[k][0].replace("'", "''") for k in ("phone", "ssn", "secret")},
    }
    digits = "regexp_replace(m.x, '[^0-9]', '', 'g')"
    luhn_sql = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) WHEN CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) > 4 THEN 2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) - 9 ELSE 2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) END)) % 10 = 0)"
    apart = "NOT regexp_matches(CASE WHEN m.s > 0 THEN substr(t, m.s, 1) ELSE '' END, '[A-Za-z0-9]') AND NOT regexp_matches(substr(t, m.s + length(m.x) + 1, 1), '[A-Za-z0-9]')"
    moved = "(substr(replace(m.x, ' ', ''), 5) || substr(replace(m.x, ' ', ''), 1, 4))"
    number = f"list_reduce(list_prepend(0, list_transform(string_split(regexp_replace({moved}, '(.)', '\\1,', 'g'), ','), lambda c: CASE WHEN c = '' THEN -1 ELSE instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 END)), lambda a, v: CASE WHEN v < 0 THEN a ELSE (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97 END)"
    ok = {
        "email": "true", "ip": rf"regexp_matches(m.x, '^{PART}(?:\.{PART}){{3}}$')", "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn_sql} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15", "card_short": f"CASE WHEN length({digits}) BETWEEN 13 AND 15 AND {apart} THEN {luhn_sql} ELSE false END",
        "iban": f"{apart} AND {number} = 1", "ssn": apart, "secret": f"regexp_matches(m.x, '[0-9]|^A[KS]IA') AND {apart}",
    }
    near = "lower(substr(t, greatest(1, m.s - 39), least(40, m.s)) || ' ' || substr(t, m.s + length(m.x) + 1, 20))"
    lists = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in plain.items())
    placed = ", ".join(f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(g_{k}[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m_{k}[1:i-1], lambda z: length(z))), 0) AS BIGINT), 'x': m_{k}[i]}}) AS p_{k}" for k in plain)
    parts = []
    for k in (*BASE, "card_short", "iban", "ssn", "secret"):
        first = PRIOR.get(k, 0.6) + (0.4 if k in CHECKED else 0.0)
        test = ok[k] if k in BASE else f"({ok[k]}) AND round({first} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{CONTEXT[k]})(?:[^a-z]|$)') THEN 0.3 ELSE 0 END, 3) >= {LEAST}"
        parts.append(f"list_transform(list_filter(p_{'card' if k == 'card_short' else k}, lambda m: {test}), lambda m: '{k}:' || m.s || ':' || (m.s + length(m.x))) AS s_{k}")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, {lists} FROM d),
p AS (SELECT doc_id, t, {placed} FROM f), s AS (SELECT doc_id, {", ".join(parts)} FROM p)
SELECT doc_id, {", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k in BASE)},
sha256(array_to_string({" || ".join(f"s_{k}" for k in BASE)}, ',')) AS base_sha256,
array_to_string({" || ".join(f"s_{k}" for k in (*BASE, "card_short", "iban", "ssn", "secret"))}, ',') AS spans FROM s"""


OP8_SQL = _sql()
