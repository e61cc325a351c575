"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

A value is found by pattern, validated (Luhn for cards, mod 97 for IBANs, octets, calendar dates, lengths), and permuted by a
keyed Feistel network inside its own format, so that the same value gets the same pseudonym in every document and whatever
its separators, and another value another one:

* cards: all digits but the last, which is computed anew, so pseudonyms pass Luhn too
* IBANs: the digits of the account, with check digits computed anew; letters and country stay
* social-security-like numbers: the digits, walked on until the number is a valid one (area, group and serial)
* phone numbers: the digits (of international numbers those after the country code)
* IPv4 addresses: the 32 bits; a slash may stand before and after (URLs, prefix lengths)
* dates: the day's place among those of the 400 years from 1700 on whose day and month have as many digits, so 5/3/1990 keeps
  its width and 1990-03-05 the same pseudonym, walked on until it is in the calendar; a time may follow after a T. With slashes
  the day comes first; where that is no date, as in 12/25/1987, the month does, in the pseudonym too
* email addresses and long hex secrets have no bounded format: a keyed digest stands in for them

Text outside valid values isn't touched: sixteen digits that fail Luhn, versions or clause numbers stay.
Feistel: ROUNDS rounds over two halves, each adding a keyed SHA-256 of kind, length, round and the other half. Whoever has
the key can undo it (`restore_digits`). Walking on is applying the permutation again to what isn't valid, which ends on the orbit of
the valid value it began with; WALK steps are made at most, of which less than one value in 10^15 would need more (it stays as it is).
The key is read from a one-row table when the query runs, so it is in no plan, log or generated code.

Null texts stay null. Empty, very long and repeated texts and ties are handled each alike; an empty table gives an empty one.
Extra columns pass through, whatever their names; `text` is replaced, and a column named `n_pii` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 8
#: Steps of a walk to a valid value.
WALK = 16
#: Years of dates, and the first of them.
YEARS, FIRST_YEAR = 400, 1700
#: The column of the key while a text is worked on.
KEY = "__pii_key"

_NUM = r"(?<![\p{L}\p{N}_.+/-])"
_END = r"(?![\p{L}\p{N}_]|[.,/-]\p{N})"
_IP_NUM, _IP_END = _NUM.replace("/", ""), _END.replace("/", "")
_TIME = "(?=T[0-9]{2})"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![\p{L}\p{N}_])[0-9a-f]{32,}(?![\p{L}\p{N}_])",
    "iban": _NUM + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _NUM + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})" + _END,
    "ssn": _NUM + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})" + _END,
    "ip": _IP_NUM + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _IP_END,
    "date": _NUM + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _END + ")",
}
KINDS = tuple(PATTERNS)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any() -> str:
    """All kinds in one pattern, with groups numbered through."""
    out, seen = [], 0
    for p in PATTERNS.values():
        groups = p.replace("(?", "").count("(") - p.count(r"\(")
        for g in range(groups, 0, -1):
            p = p.replace(f"\\{g}", f"\\{g + seen}")
        out.append(p)
        seen += groups
    return "|".join(out)


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prf(key: str, kind: str, size: str, rnd: str, half: str) -> str:
    """60 keyed bits as a long. key: SQL of the key."""
    return f"CAST(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {size}, {rnd}, {half}), 256), 1, 15), 16, 10) AS BIGINT)"


def _feistel(key: str, kind: str, a: str, b: str, na: str, nb: str, size: str, undo: bool = False) -> str:
    """SQL of struct(a, b) permuted within na x nb."""
    f = lambda half: _prf(key, kind, size, "r", half)
    if undo:
        step = f"struct(pmod(s.b - pmod({f('s.a')}, IF(r % 2 = 1, {na}, {nb})), IF(r % 2 = 1, {na}, {nb})) AS a, s.a AS b)"
        rounds = f"sequence({ROUNDS}, 1, -1)"
    else:
        step = f"struct(s.b AS a, pmod(s.a + pmod({f('s.b')}, IF(r % 2 = 1, {na}, {nb})), IF(r % 2 = 1, {na}, {nb})) AS b)"
        rounds = f"sequence(1, {ROUNDS})"
    return f"aggregate({rounds}, struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b), (s, r) -> {step})"


def _digits(key: str, kind: str, d: str, undo: bool = False) -> str:
    """SQL of the permuted digit string d (a name) of 2 to 36 digits."""
    u, v = f"(length({d}) DIV 2)", f"(length({d}) - length({d}) DIV 2)"
    ten = lambda n: f"CAST(rpad('1', {n} + 1, '0') AS BIGINT)"
    half = _feistel(key, kind, f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", ten(u), ten(v), f"length({d})", undo)
    return _let("h", half, f"concat(lpad(CAST(h.a AS STRING), {u}, '0'), lpad(CAST(h.b AS STRING), {v}, '0'))")


def _fill(form: str, digits: str) -> str:
    """SQL of form (a name) with its digits replaced in turn by those of digits (a name)."""
    return f"aggregate(split({form}, ''), struct('' AS o, 1 AS k), (z, c) -> IF(c RLIKE '[0-9]', struct(concat(z.o, substr({digits}, z.k, 1)) AS o, z.k + 1 AS k), struct(concat(z.o, c) AS o, z.k AS k)), z -> z.o)"


def _luhn(d: str) -> str:
    """SQL of the Luhn sum of d's digits if a check digit followed."""
    double = "2 * CAST(substr({0}, i, 1) AS INT)"
    x = double.format(d)
    return f"aggregate(sequence(1, length({d})), 0, (z, i) -> z + IF((length({d}) - i) % 2 = 0, IF({x} > 9, {x} - 9, {x}), CAST(substr({d}, i, 1) AS INT)))"


def _mod97(text: str) -> str:
    """SQL of a letters-and-digits string's remainder by 97, letters as 10 to 35."""
    return f"aggregate(split({text}, ''), 0, (z, c) -> IF(c = '', z, IF(c RLIKE '[0-9]', (z * 10 + CAST(c AS INT)) % 97, (z * 100 + ascii(c) - 55) % 97)))"


def _walked(start: str, step: str, bad: str) -> str:
    """SQL of the first value that isn't bad after one step or more from start (a name); step and bad: SQL over v."""
    return f"aggregate(sequence(1, {WALK}), struct({start} AS v, true AS go), (s, r) -> IF(s.go, {_let('w', _let('v', 's.v', step), 'struct(w AS v, ' + _let('v', 'w', bad) + ' AS go)')}, s), s -> IF(s.go, {start}, s.v))"


def _date(key: str) -> str:
    """SQL of the pseudonym of a date m, or of m.

    A date is a number in years x months x days of its class (months of one digit or two, days of one or two): permuted as such, and
    walked on over those that the calendar lacks.
    """
    parts = _let("y", "split(m, '[-./]')", "IF(length(y[0]) = 4, array(y[0], y[1], y[2]), array(y[2], y[1], y[0]))")
    month_first = "IF(m LIKE '%/%', array(p[0], p[2], p[1]), p)"
    day_of = lambda q: f"TRY_CAST(concat_ws('-', {q}[0], lpad({q}[1], 2, '0'), lpad({q}[2], 2, '0')) AS DATE)"
    # c: first month, months, first day, days of the class
    of_class = "struct(IF(month(t) < 10, 1, 10) AS m0, IF(month(t) < 10, 9, 3) AS mn, IF(day(t) < 10, 1, 10) AS d0, IF(day(t) < 10, 9, 22) AS dn)"
    start = f"CAST(((year(t) - {FIRST_YEAR}) * c.mn + month(t) - c.m0) * c.dn + day(t) - c.d0 AS BIGINT)"
    kind = "concat_ws('.', c.m0, c.d0)"
    feistel = _feistel(key, "date", f"v DIV (20 * c.dn)", f"v % (20 * c.dn)", f"(20 * c.mn)", f"(20 * c.dn)", kind)
    step = _let("h", feistel, "h.a * (20 * c.dn) + h.b")
    shown = "concat_ws('-', lpad(CAST({0} DIV (c.mn * c.dn) + 1700 AS STRING), 4, '0'), lpad(CAST({0} DIV c.dn % c.mn + c.m0 AS STRING), 2, '0'), lpad(CAST({0} % c.dn + c.d0 AS STRING), 2, '0'))".format
    moved = _let("c", of_class, _let("k", start, _let("n", _walked("k", step, f"TRY_CAST({shown('v')} AS DATE) IS NULL"), f"IF(n = k, t, CAST({shown('n')} AS DATE))")))
    # A part of one digit in m is one of one digit in the pseudonym.
    bare = "m RLIKE '(^|[./])[0-9][./]'"
    pattern = f"CASE WHEN m LIKE '%-%' THEN 'yyyy-MM-dd' WHEN m LIKE '%/%' THEN IF(by_day IS NULL, IF({bare}, 'M/d/yyyy', 'MM/dd/yyyy'), IF({bare}, 'd/M/yyyy', 'dd/MM/yyyy')) ELSE IF({bare}, 'd.M.yyyy', 'dd.MM.yyyy') END"
    in_range = f"year(t) BETWEEN {FIRST_YEAR} AND {FIRST_YEAR + YEARS - 1}"
    done = _let("z", moved, f"date_format(z, {pattern})")
    whole = _let("t", f"coalesce(by_day, {_let('q', month_first, day_of('q'))})", f"IF(t IS NULL OR NOT ({in_range}), m, {done})")
    return _let("p", parts, _let("by_day", day_of("p"), whole))


def _replacement(key: str) -> str:
    """SQL of the pseudonym of a match m, or of m itself where it isn't valid."""
    only = "regexp_replace(m, '[^0-9]', '')"
    is_a = {k: f"m RLIKE {_sql('^(?:' + p.replace(_NUM, '').replace(_END, '').replace(_IP_NUM, '').replace(_IP_END, '').replace(_TIME, '').replace('(?<![' + chr(92) + 'p{L}' + chr(92) + 'p{N}._%+-])', '') + ')$')}" for k, p in PATTERNS.items()}
    digest = f"sha2(concat_ws('|', {key}, 'text', lower(m)), 256)"
    further = f"sha2(concat_ws('|', {key}, 'text', k, lower(m)), 256)"
    email = f"concat('user-', substr({digest}, 1, 16), '@mail.invalid')"
    secret = f"substr(concat({digest}, {digest}, IF(length(m) > 128, array_join(transform(sequence(2, length(m) DIV 64), k -> {further}), ''), '')), 1, length(m))"
    card_new = _let("p", _digits(key, "card", "b"), f"concat(p, CAST(pmod(10 - {_luhn('p')} % 10, 10) AS STRING))")
    card = _let("d", only, f"IF(pmod({_luhn('substr(d, 1, length(d) - 1)')} + CAST(right(d, 1) AS INT), 10) = 0, {_let('b', 'substr(d, 1, length(d) - 1)', _let('n', card_new, _fill('m', 'n')))}, m)")
    bad_ssn = "substr({0}, 1, 3) IN ('000', '666') OR {0} >= '900000000' OR substr({0}, 4, 2) = '00' OR right({0}, 4) = '0000'".format
    ssn = _let("d", only, f"IF({bad_ssn('d')}, m, {_let('n', _walked('d', _digits(key, 'ssn', 'v'), bad_ssn('v')), _fill('m', 'n'))})")
    # The country code stays: the digits after it are permuted.
    local = _let("c", "regexp_extract(m, '^(\\\\+[0-9]{1,3})?(.*)$', 1)", _let("l", "substr(m, length(c) + 1)", _let("d", "regexp_replace(l, '[^0-9]', '')", f"IF(length(d) BETWEEN 6 AND 14, concat(c, {_let('n', _digits(key, 'phone', 'd'), _fill('l', 'n'))}), m)")))
    octets = "transform(split(m, '[.]'), o -> CAST(o AS BIGINT))"
    ip_new = _let("h", _feistel(key, "ip", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "'32'"), "concat_ws('.', CAST(h.a DIV 256 AS STRING), CAST(h.a % 256 AS STRING), CAST(h.b DIV 256 AS STRING), CAST(h.b % 256 AS STRING))")
    ip = _let("o", octets, f"IF(forall(o, x -> x < 256), {ip_new}, m)")
    date = _date(key)
    compact = "replace(m, ' ', '')"
    account = _let("q", "regexp_replace(substr(w, 5), '[^0-9]', '')", f"IF(length(q) < 2, substr(w, 5), {_let('n', _digits(key, 'iban', 'q'), _let('g', 'substr(w, 5)', _fill('g', 'n')))})")
    iban_new = _let("x", account, f"concat(substr(w, 1, 2), lpad(CAST(98 - {_mod97('concat(x, substr(w, 1, 2), ' + chr(39) + '00' + chr(39) + ')')} AS STRING), 2, '0'), x)")
    spaced = "aggregate(split(m, ''), struct('' AS o, 1 AS k), (z, c) -> IF(c = ' ', struct(concat(z.o, c) AS o, z.k AS k), struct(concat(z.o, substr(n2, z.k, 1)) AS o, z.k + 1 AS k)), z -> z.o)"
    iban = _let("w", compact, f"IF(length(w) BETWEEN 15 AND 34 AND {_mod97('concat(substr(w, 5), substr(w, 1, 4))')} = 1, {_let('n2', iban_new, spaced)}, m)")
    forms = {"email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "phone": local, "ip": ip, "date": date}
    tests = is_a | {"email": "m LIKE '%@%'", "phone": "true"}
    order = ("email", "secret", "iban", "card", "ssn", "ip", "date", "phone")
    return "CASE " + " ".join(f"WHEN {tests[k]} THEN {forms[k]}" for k in order) + " ELSE m END"


def pseudonymised(text: str = "text", key: str = KEY) -> Column:
    """A struct of the text with pseudonyms and `n_pii`, the number of values replaced; text and key are columns.

    Texts without digits, @ and long runs of hex letters are returned as they are; in the others matches and the text between them are taken apart once,
    and only matches are worked on.
    """
    t = f"`{text}`"
    pattern = _sql(_any())
    found = f"struct(split({t}, {pattern}, -1) AS p, regexp_extract_all({t}, {pattern}, 0) AS m)"
    with_new = f"struct(a.p AS p, a.m AS m, transform(a.m, m -> {_replacement(f'`{key}`')}) AS n)"
    joined = "struct(array_join(flatten(zip_with(e.p, e.n, (x, y) -> array(x, coalesce(y, '')))), '') AS text, CAST(size(filter(zip_with(e.m, e.n, (x, y) -> x <> y), z -> z)) AS BIGINT) AS n_pii)"
    done = _let("e", _let("a", found, with_new), joined)
    return F.expr(f"CASE WHEN {t} RLIKE '[0-9@]|[a-f]{{32}}' THEN {done} ELSE struct({t} AS text, 0L AS n_pii) END")


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """The key as a table of one row, whose value no plan shows."""
    if not key:
        raise ValueError("a key is required")
    return spark.createDataFrame([(key,)], f"{KEY} string")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text replaced, and n_pii."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.toDF(*names.values()).select("*", key_table(docs.sparkSession, key).scalar().alias(KEY))
    out = keyed.withColumn("__pii", pseudonymised(names[text]))
    return out.select(*[F.col("__pii.text").alias(c) if c == text else F.col(n).alias(c) for c, n in names.items() if c != "n_pii"], F.col("__pii.n_pii").alias("n_pii"))


def permute_digits(digits: str, key: str, kind: str) -> Column:
    """The pseudonym of a column of digit strings, as for the kind's own values. For tests and for taking pseudonyms back: the key is in the plan."""
    return F.expr(_let("d", f"`{digits}`", _digits(_sql(key), kind, "d")))


def restore_digits(digits: str, key: str, kind: str) -> Column:
    """The digit strings that permute_digits made these of."""
    return F.expr(_let("d", f"`{digits}`", _digits(_sql(key), kind, "d", undo=True)))
