"""PII: format-preserving pseudonyms by keyed Feistel permutations. DataFrame functions only.

Found are e-mail addresses, access key ids, IBANs (check digits), IPv4 addresses (octets), dates of 1900 to 2099, social security
numbers (area, group and serial), telephone numbers (8 to 15 digits) and card numbers (13 to 19 digits, Luhn). What doesn't
validate stays. Neighbouring numbers don't count: cards and IBANs are looked for at every group of digits and only those with right
check digits are cut out, real groupings before others; telephone numbers end where their country's plan does, where a date or card
begins, or with the last group within 15 digits. A value is split into two halves; in each round one half is shifted by a keyed SHA-256 of the other, so the
whole is a permutation of all values of that format: no two values get one pseudonym, and a value has the same pseudonym in
every document, written with or without separators. Check digits are computed anew, dates stay dates, letters letters, digits
digits, and separators, country codes and mail domains stay.

Null texts stay null and empty ones empty. A text without matches stays as it is, white space included. Repeated rows get
equal results; all other columns are kept (`pseudonymise` only replaces `text`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 17 * 4297     # 1900-01-01 to 2099-12-31

#: The part before the @ repeats possessively and the domain is one run of characters: a group that repeats without bound and may
#: give back needs a stack as deep as the text is long.
EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?=[A-Za-z0-9-])[A-Za-z0-9.-]*"
         r"(?<=[A-Za-z0-9-]\.)[A-Za-z]{2,}")
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
#: Countries by length of their IBANs.
IBAN_SIZES = {15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
              23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|FR|GR|IT|MC|MR|SM",
              28: "AL|AZ|BY|CY|DO|GT|HU|LB|LC|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC"}
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
KNOWN_IBAN = "|".join(rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(size - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
                      for size, countries in IBAN_SIZES.items())
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9])(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])"
DMY_DATE = r"(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Cards in fours, 4-6-5, 4-6-4 or unbroken; and other groupings.
CARD = r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19}"
LONG_CARD, LOOSE_CARD = r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", r"[0-9](?:[ -]?[0-9]){12,18}"
#: Digits after the country code where a country has one length.
PHONE_SIZES = {9: "27|30|31|32|33|34|41|48|61", 10: "1|20|44|52|7|90|91", 11: "86"}
#: What begins at a group of digits and isn't part of a telephone number.
OTHER = rf"(?!(?<= )(?:{ISO_DATE}|{DMY_DATE}|{IP}|{SSN}|(?:{CARD})(?![0-9])))".replace("([-/.])", "[-/.]").replace(r"\1", "[-/.]").replace(r"\2", "[-/.]")
for _before in ("(?<![0-9])", "(?<![0-9.])", "(?<![0-9-])"):
    OTHER = OTHER.replace(_before, "")
NEXT = rf"(?:[ .-]{OTHER}(?=[0-9]{{2}})|[ .-]?\((?=[0-9]{{1,4}}\)[ .-]?[0-9]{{2}})|\)[ .-]?{OTHER})?[0-9]"
#: After the country code one digit may stand alone.
PHONE = ("(?:(?<![0-9+])\\+(?:" + "|".join(rf"(?:{codes})(?:[ .-]?\(0\))?(?:[ .-](?=[0-9][ .-][0-9]{{2}}))?(?:{NEXT}){{{n}}}(?![0-9])" for n, codes in PHONE_SIZES.items()) + rf"|[0-9](?:{NEXT}){{7,14}})"
         r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])")
#: All but those with check digits, which come before (IBAN) and behind them (cards).
FIRST, THEN = "|".join((EMAIL, ACCESS_KEY)), "|".join((IP, ISO_DATE, DMY_DATE, SSN, PHONE))


def _keyed(key: str, kind: str | Column, round_: Column, other: Column) -> Column:
    """64 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, round_.cast("string"), other.cast("string")), 256)


def let(value: Column, use) -> Column:
    """use(value), with `value` written into the plan, and computed, once."""
    return F.transform(F.array(value), use)[0]


def _rounds() -> Column:
    return F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel_numbers(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Struct (l, r): a permutation of all pairs with l < a and r < b. Halves change places each round, so that one step serves both."""
    def step(s: Column, i: Column) -> Column:
        number = F.conv(F.substring(_keyed(key, kind, i, s["r"]), 1, 12), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + number) % F.when(i % 2 == 0, a).otherwise(b)).alias("r"))

    return F.aggregate(_rounds(), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def feistel_text(text: Column, key: str, kind: str | Column) -> Column:
    """A permutation of all texts with digits, small and capital letters at the same places."""
    def shifted(half: Column, digest: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            turn = lambda base, size: F.char(base + (F.ascii(c) - base + by) % size)
            by = F.conv(F.substring(digest, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            base = F.when(c.between("0", "9"), 48).when(c.between("A", "Z"), 65).when(c.between("a", "z"), 97)
            return F.coalesce(turn(base, F.when(base == 48, 10).otherwise(26)), c)
        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), let(_keyed(key, kind, i, s["r"]), lambda digest: shifted(s["l"], digest)).alias("r"))

    middle = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), middle).alias("l"), F.substring(text, middle + 1, F.length(text)).alias("r"))
    return F.aggregate(_rounds(), halves, step, lambda s: F.concat(s["l"], s["r"]))


def _symbols(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _within(value: Column, symbols: Column) -> Column:
    """`symbols` at the places of the letters and digits of `value`."""
    def one(c: Column, j: Column) -> Column:
        place = F.length(_symbols(F.substring(value, F.lit(1), j))) + 1
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(symbols, place, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Of digits in which the last one is the check digit."""
    def add(total: Column, pair: Column) -> Column:
        digit, place = pair["d"], pair["j"]
        twice = digit * 2
        return total + F.when(place % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)
    marked = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, j: F.struct(c.cast("int").alias("d"), j.alias("j")))
    return F.aggregate(marked, F.lit(0), add)


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of letters and digits, letters being 10 to 35."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _text_parts(v: Column, kind: Column) -> Column:
    """Struct of what is permuted of a value of letters and digits (`body`), what stands before it (`head`), and its letters and digits
    (`own`). Mail domains, country codes, the first digit of a telephone or card number and check digits aren't permuted."""
    def parts(own: Column) -> Column:
        local = F.substring_index(v, "@", 1)
        # A country code and the first digit after it stay.
        code = F.regexp_extract(v, r"^\+(?:1|7|[0-9]{1,3})(?=[ .(-]|[0-9]{8,12}$)", 0)
        digits = F.length(_symbols(code))
        body = (F.when(kind == "email", local).when(kind == "access_key", F.substring(v, 5, 16)).when(kind == "iban", F.substring(own, F.lit(5), F.length(own)))
                .when(kind == "phone", F.substring(own, digits + 2, F.length(own))).otherwise(F.substring(own, F.lit(2), F.length(own) - 2)))
        head = (F.when(kind == "iban", F.substring(own, 1, 2)).when(kind == "phone", F.substring(own, F.lit(1), digits + 1)).otherwise(F.substring(own, 1, 1)))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"))
    return let(_symbols(v), parts)


def _text_pseudonym(v: Column, kind: Column, key: str) -> Column:
    """E-mail addresses, access keys, IBANs, telephone and card numbers: one permutation serves all."""
    def written(p: Column) -> Column:
        own, head, body, new = p["own"], p["head"], p["body"], p["new"]
        check = F.lpad((98 - iban_rest(F.concat(new, head, F.lit("00")))).cast("string"), 2, "0")
        iban = F.when(iban_rest(F.concat(body, head, F.substring(own, 3, 2))) == 1, F.concat(head, check, new))
        phone = F.when(F.length(own).between(8, 15), F.concat(head, new))
        last = (10 - luhn_sum(F.concat(head, new, F.lit("0"))) % 10) % 10
        card = F.when(luhn_sum(own) % 10 == 0, F.concat(head, new, last.cast("string")))
        symbols = F.when(kind == "iban", iban).when(kind == "phone", phone).otherwise(card)
        return (F.when(kind == "email", F.concat(new, F.substring(v, F.length(body) + 1, F.length(v)))).when(kind == "access_key", F.concat(F.lit("AKIA"), new))
                .otherwise(let(symbols, lambda s: F.coalesce(_within(v, s), v))))

    permuted = let(_text_parts(v, kind), lambda p: F.struct(p["own"].alias("own"), p["head"].alias("head"), p["body"].alias("body"),
                                                            feistel_text(p["body"], key, kind).alias("new")))
    return let(permuted, written)


def _ip(v: Column, key: str) -> Column:
    def written(octets: Column) -> Column:
        new = feistel_numbers(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip")
        joined = let(new, lambda n: F.concat_ws(".", F.floor(n["l"] / 256), n["l"] % 256, F.floor(n["r"] / 256), n["r"] % 256))
        return F.when(F.forall(octets, lambda o: o < 256), joined).otherwise(v)
    return let(F.transform(F.split(v, r"\."), lambda c: c.cast("int")), written)


def _date(v: Column, key: str) -> Column:
    """Year first, or day, month and year; month and day change places where only that is a date."""
    first_day = F.lit(FIRST_DAY).cast("date")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def read(parts: Column) -> Column:
        iso = F.length(F.regexp_extract(v, "^[0-9]+", 0)) == 4
        third = F.when(iso, parts[2]).otherwise(parts[0])
        turned = (parts[1] > 12) & (third <= 12)
        return F.struct(iso.alias("iso"), turned.alias("turned"), F.when(iso, parts[0]).otherwise(parts[2]).alias("year"),
                        F.when(turned, third).otherwise(parts[1]).alias("month"), F.when(turned, parts[1]).otherwise(third).alias("day"))

    def shifted(d: Column) -> Column:
        leap = (d["year"] % 4 == 0) & ((d["year"] % 100 != 0) | (d["year"] % 400 == 0))
        last = F.when(d["month"] == 2, F.when(leap, 29).otherwise(28)).when(d["month"].isin(4, 6, 9, 11), 30).otherwise(31)
        valid = d["month"].between(1, 12) & (d["day"] >= 1) & (d["day"] <= last) & d["year"].between(1900, 2099)
        number = F.date_diff(F.make_date(d["year"], d["month"], d["day"]), first_day)
        new = let(number, lambda n: feistel_numbers(n % 17, F.floor(n / 17), 17, DAYS // 17, key, "date"))
        then = let(new, lambda n: F.date_add(first_day, (n["r"] * 17 + n["l"]).cast("int")))
        return F.when(valid, let(then, lambda t: written(d, t))).otherwise(v)

    def written(d: Column, then: Column) -> Column:
        mark, month, day = F.regexp_extract(v, "[-/.]", 0), two(F.month(then)), two(F.dayofmonth(then))
        year = F.year(then).cast("string")
        before, behind = F.when(d["turned"] == d["iso"], day).otherwise(month), F.when(d["turned"] == d["iso"], month).otherwise(day)
        # Year first: month, then day. Year last: day, then month. The other way round where they have changed places.
        return F.when(d["iso"], F.concat(year, mark, before, mark, behind)).otherwise(F.concat(before, mark, behind, mark, year))

    return let(let(F.transform(F.split(v, "[-/.]"), lambda c: c.cast("int")), read), shifted)


def _ssn(v: Column, key: str) -> Column:
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")

    def written(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        # 898 areas, 99 groups, 9999 serials.
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        new = feistel_numbers(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        joined = let(new, lambda n: let(F.floor(n["l"] / 99), lambda at: F.concat_ws(
            "-", pad(F.when(at >= 665, at + 2).otherwise(at + 1), 3), pad(n["l"] % 99 + 1, 2), pad(n["r"] + 1, 4))))
        return F.when(valid, joined).otherwise(v)
    return let(F.transform(F.split(v, "-"), lambda c: c.cast("int")), written)


def kind_of(v: Column) -> Column:
    """Which pattern a match is of: the order of the patterns decides, as it does in the search."""
    whole = lambda pattern: v.rlike(rf"^(?:{pattern})$")
    return (F.when(F.instr(v, "@") > 0, "email").when(whole(ACCESS_KEY), "access_key").when(whole(IBAN), "iban").when(whole(IP), "ip")
            .when(whole(ISO_DATE) | whole(DMY_DATE.replace(r"\2", r"\1")), "date").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card"))


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    return (F.when(kind == "ip", _ip(v, key)).when(kind == "date", _date(v, key)).when(kind == "ssn", _ssn(v, key))
            .otherwise(_text_pseudonym(v, kind, key)))


def _literal(values: Column, before: str) -> Column:
    """A pattern of just these values, longest first; of nothing if there are none."""
    longest = lambda vs: F.array_sort(F.array_distinct(vs), lambda a, b: F.length(b) - F.length(a))
    some = lambda vs: F.concat(F.lit(f"(?<![{before}])(?:"), F.array_join(longest(vs), "|"), F.lit(f")(?![{before}])"))
    return let(values, lambda vs: F.when(F.size(vs) > 0, some(vs)).otherwise(F.lit("(?!)")))


def _pattern() -> Column:
    """What is to be found in `text`: IBANs and cards only where their check digits are right."""
    def starts(pattern: str, before: str) -> Column:
        return F.regexp_extract_all("text", F.lit(f"(?<![{before}])(?=({pattern})(?![{before}]))"), F.lit(1))

    def right_iban(v: Column) -> Column:
        own = _symbols(v)
        return iban_rest(F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))) == 1

    right_card = lambda v: luhn_sum(_symbols(v)) % 10 == 0
    # A value of another shape mustn't hold one of the usual shape.
    both = lambda usual, other: let(usual, lambda us: F.concat(us, F.filter(other, lambda v: ~F.exists(us, lambda u: F.instr(v, u) > 0))))
    iban = both(F.filter(starts(KNOWN_IBAN, "A-Za-z0-9"), right_iban), F.filter(starts(IBAN, "A-Za-z0-9"), right_iban))
    other = F.concat(starts(LONG_CARD, "0-9"), F.regexp_extract_all("text", F.lit(f"(?<![0-9])({LOOSE_CARD})(?![0-9])"), F.lit(1)))
    card = both(F.filter(starts(CARD, "0-9"), right_card), F.filter(other, right_card))
    return F.concat_ws("|", F.lit(FIRST), _literal(iban, "A-Za-z0-9"), F.lit(THEN), _literal(card, "0-9"))


def _matches(docs: DataFrame, key: str) -> DataFrame:
    """Adds _pieces, the text around the matches, and _found, for each match its kind, the value and the pseudonym."""
    maybe = F.col("text").rlike("[0-9@]")
    some = lambda c: F.when(maybe, c)
    found = F.transform(F.col("_values"), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    return (docs.withColumn("_pattern", some(_pattern()))
            .withColumn("_pieces", some(F.split("text", F.col("_pattern"), -1))).withColumn("_values", some(F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))))
            .withColumn("_kinds", found)
            .withColumn("_found", F.transform("_kinds", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("new"))))
            .drop("_values", "_kinds", "_pattern"))


def _rebuilt() -> Column:
    ends = F.concat(F.transform("_found", lambda x: x["new"]), F.array(F.lit("")))
    return F.when(F.size("_found") > 0, F.array_join(F.zip_with("_pieces", ends, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` with pseudonyms in `text`."""
    rows = _matches(docs.select("text", F.struct(*docs.columns).alias("_doc")), key)       # so that no name can clash
    return rows.select(*[_rebuilt().alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the new text, n_replaced, and `kinds`, the kind of every value replaced, in text order."""
    changed = F.filter(F.coalesce("_found", F.array().cast("array<struct<kind:string,value:string,new:string>>")), lambda x: x["new"] != x["value"])
    return _matches(docs.select("doc_id", "text"), key).select(
        "doc_id", _rebuilt().alias("text"), F.size(changed).cast("long").alias("n_replaced"),
        F.array_join(F.transform(changed, lambda x: x["kind"]), ",").alias("kinds"))
