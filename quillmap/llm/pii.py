"""Format-preserving pseudonyms by a keyed Feistel permutation, in SQL expressions only.

Validated numbers and dates are replaced by others of the same format, so
equal values stay linked across documents, and nobody without the key can tell
which was which: card numbers (Luhn digit checked before and set after), bank account
numbers (IBAN, check digits likewise), telephone numbers, numbers of the form
123-45-6789, IPv4 and IPv6 addresses, dates (year first, or day first), the local part of
e-mail addresses, access keys, and what follows the name of a secret, in any case: hexadecimal
secrets, and others of six characters or more with a digit.

Matches are exploded to rows that carry no text, changed there in flat columns,
and gathered for each document again; documents without a match are never
shuffled.

A date or address is a number below a size N. A Feistel network adds keyed digests
modulo m = ceil(sqrt(N)) to one half and the other in turn, which permutes
0..m*m-1; a value that lands at N or above walks on until it is below N, so the map
is a permutation of 0..N-1, and ``permute(..., back=True)`` inverts it. All others are
strings over an alphabet. There a Feistel network adds keyed digests of one half to
the other half's characters, so every character of the result depends on all.

What is no digit or letter to be permuted is format and stays: a mail's domain, a
telephone number's country code, a bank account's country, a card's first digit, which names its network, and
a key's prefix. A secret that is not hexadecimal keeps the place of its first such character and that
character, and what is before it stays hexadecimal, so inversion finds the same kind.
Not covered: names, streets, dates with the month first or in words, secrets without a name before them.

Defined results: a null text stays null with no matches, an empty one stays
empty; matches do not overlap (the leftmost wins, then the first kind listed);
a number of a card's length with a wrong check digit stays as it is, unless it
follows the name of a secret; a version (``v1.2.3.4``) is no address; repeated
rows and ties get equal results; extra columns pass through, but for ``found``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The key of calls that give none: an example, for tests. ``spark.corpus.pseudonym.key`` sets the registered query's.
KEY = "example key, to be replaced by a secret one"
ROUNDS, WALK = 6, 128
#: Matches that one task changes (about).
TASK_MATCHES = 2000
#: The names before a secret.
NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?"
#: The kinds, in order of precedence, as Java regular expressions.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": NAMED + r"[0-9a-fA-F]{12,64}(?![0-9A-Za-z])",
    "password": NAMED + r"(?=[A-Za-z_+/.=-]*[0-9])[A-Za-z0-9][A-Za-z0-9_+/.=-]{4,126}[A-Za-z0-9](?![A-Za-z0-9])",
    "date": r"(?<![\d.-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "day": r"(?<![\d./-])(?:0[1-9]|[12]\d|3[01])(?<sep>[./-])(?:0[1-9]|1[0-2])\k<sep>(?:19|20)\d\d(?![\d-])",
    "ip": r"(?<![\d.]|[vV]|[vV]ersion[ ]|[vV]ersion)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})(?: ?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z]|\d\.)\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Dates move within these two centuries.
FIRST_DAY, DAYS = "1900-01-01", 73049


def instr_of(alphabet: Column, c: Column) -> Column:
    """Place of a character in an alphabet, from 1; 0 if it has none."""
    return F.call_function("instr", alphabet, c).cast("long")


def permute(x: Column, size: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of 0..size-1, size at most 10**18."""
    m = F.ceil(F.sqrt(size.cast("double"))).cast("long")

    def digest(i: Column, half: Column) -> Column:
        said = F.concat(F.lit(f"{key}|"), tweak, F.lit("|"), i.cast("string"), F.lit("|"), half.cast("string"))
        return F.conv(F.substring(F.md5(said.cast("binary")), 1, 12), 16, 10).cast("long") % m

    def forth(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + digest(i, s["r"])) % m).alias("r"))

    def undo(s: Column, i: Column) -> Column:
        return F.struct(((s["r"] - digest(i, s["l"]) + m) % m).alias("l"), s["l"].alias("r"))

    def once(v: Column) -> Column:
        rounds = F.array(*map(F.lit, reversed(range(ROUNDS)) if back else range(ROUNDS)))
        return F.aggregate(rounds, F.struct(F.call_function("div", v, m).alias("l"), (v % m).alias("r")), undo if back else forth, lambda s: s["l"] * m + s["r"])

    # the first step is taken in any case, later ones only while outside
    walk = F.sequence(F.lit(0), F.lit(WALK))
    return F.aggregate(walk, x, lambda v, i: F.when((i > 0) & (v < size), v).otherwise(once(v)))


def permute_text(s: Column, alphabet: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Permute a string over an alphabet: a Feistel network whose halves are strings; an empty one stays.

    A round adds, to each character of one half, 16 bits of a digest of the other
    half, modulo the size of the alphabet. One character alone is a number, permuted as such.
    """
    base = F.length(alphabet)
    letter = lambda v: F.substr(alphabet, v.cast("int") + 1, F.lit(1))
    place = lambda c: instr_of(alphabet, c) - 1
    half = (F.length(s) / 2).cast("int")
    said = F.concat_ws("|", F.lit(key), tweak, base.cast("string"), F.length(s).cast("string"))

    def turn(target: Column, other: Column, i: Column) -> Column:
        # a digest of 64 hexadecimal digits serves 16 characters
        digest = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(target) / 16).cast("int")), lambda n: F.sha2(F.concat_ws("|", said, i.cast("string"), n.cast("string"), other).cast("binary"), 256)), "")
        shift = lambda at: F.conv(F.substr(digest, 4 * at + 1, F.lit(4)), 16, 10).cast("long")
        signed = (lambda at: -shift(at)) if back else shift
        return F.array_join(F.transform(F.split(target, ""), lambda c, at: letter(F.pmod(place(c) + signed(at), base))), "")

    def step(a: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, turn(a["l"], a["r"], i)).otherwise(a["l"]).alias("l"), F.when(even, a["r"]).otherwise(turn(a["r"], a["l"], i)).alias("r"))

    rounds = F.array(*map(F.lit, reversed(range(2 * ROUNDS)) if back else range(2 * ROUNDS)))
    halves = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s) - half).alias("r"))
    many = F.aggregate(rounds, halves, step, lambda a: F.concat(a["l"], a["r"]))
    one = letter(permute(place(s), base.cast("long"), key, tweak, back))
    return F.when(F.length(s) > 1, many).when(F.length(s) == 1, one).otherwise(F.lit(""))


def refill(shape: Column, alphabet: Column, chars: Column) -> Column:
    """Put ``chars``, in order, in the places of ``shape`` whose character is in the alphabet."""

    def step(a: Column, c: Column) -> Column:
        put = F.struct(F.concat(a["out"], F.substr(chars, a["i"] + 1, F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))
        return F.when(instr_of(alphabet, c) > 0, put).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda a: a["out"])


def of_alphabet(value: Column, alphabet: Column) -> Column:
    return F.array_join(F.filter(F.split(value, ""), lambda c: instr_of(alphabet, c) > 0), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (less 9 if above 9)."""

    def step(a: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.struct((a["sum"] + F.when(a["i"] % 2 == 0, d).otherwise(twice)).alias("sum"), (a["i"] + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), step, lambda a: a["sum"])


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account number: 98 less the remainder by 97 of account, country and 00, letters counting 10 to 35."""
    digits = F.split(F.concat(account, country, F.lit("00")), "")
    value = lambda c: instr_of(F.lit(DIGITS + UPPER), c) - 1
    rest = F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def as_date(value: Column) -> Column:
    """The date of a match with the year or the day first; null if there is none such."""
    year_first = F.substring(value, 5, 1) == "-"
    said = F.when(year_first, value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    return F.call_function("try_to_date", said, F.lit("yyyy-MM-dd"))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind(value: Column) -> Column:
    """The kind of a match that was found in its text; null for a number that fails validation."""
    whole = lambda name: value.rlike(f"^(?:{KINDS[name]})$")
    digits = F.length(only_digits(value))
    account = F.regexp_replace(value, " ", "")
    return (
        F.when(whole("secret"), "secret")
        .when(whole("password"), "password")
        .when(value.contains("@"), "email")
        .when(whole("access_key"), "access_key")
        .when(whole("date"), F.when(as_date(value).isNotNull(), "date"))
        .when(whole("day"), F.when(as_date(value).isNotNull(), "day"))
        .when(whole("iban"), F.when(iban_check(F.substring(account, 1, 2), F.substr(account, F.lit(5), F.length(account))) == F.substring(account, 3, 2), "iban"))
        .when(whole("ipv6"), "ipv6")
        .when(whole("ssn"), "ssn")
        .when(whole("ip"), "ip")
        .when(whole("card") & digits.between(13, 19), F.when(luhn_sum(only_digits(value)) % 10 == 0, "card"))
        .when(whole("phone"), "phone")
    )


def pseudonyms(matches: DataFrame, key: str = KEY, back: bool = False) -> DataFrame:
    """Add ``kind`` and ``pseudonym`` to rows with a ``value``; a value that fails validation keeps itself."""
    v, of = F.col("value"), F.col("kind")
    rows = matches.withColumn("kind", kind(v))
    # head and tail stay; the body is permuted
    rows = rows.withColumn("_head_", F.when(of == "access_key", F.substring(v, 1, 4)).when(of == "phone", F.regexp_extract(v, r"^(\+\d{1,3})(?=[ (-])", 1)).when(of == "card", F.substring(v, 1, 1)).when(of == "iban", F.substring(v, 1, 4)).when(of.isin("secret", "password"), F.regexp_extract(v, "^" + NAMED, 0)).otherwise(""))
    rows = rows.withColumn("_tail_", F.when(of == "email", F.regexp_extract(v, "(@.*)$", 1)).when(of == "card", F.substring(v, -1, 1)).when(of == "password", F.regexp_extract(v, f"^{NAMED}[0-9a-fA-F]*(.*)$", 1)).otherwise(""))
    rows = rows.withColumn("_body_", F.substr(v, F.length("_head_") + 1, F.length(v) - F.length("_head_") - F.length("_tail_")))
    # letters of each case and digits keep their places, so a secret's form stays and inversion finds it
    for step, (email, hexadecimal) in enumerate(((LOWER, "abcdef"), (UPPER, "ABCDEF"), (DIGITS, DIGITS))):
        alphabet = F.when(of == "email", email).when(of.isin("secret", "password", "ipv6"), hexadecimal)
        if not step:
            alphabet = alphabet.when(of == "access_key", UPPER + DIGITS).when(of.isin("phone", "card", "ssn"), DIGITS)
        else:
            alphabet = alphabet.when(of == "iban", email)
        rows = rows.withColumn("_abc_", alphabet)
        rows = rows.withColumn("_chars_", F.when(F.col("_abc_").isNotNull(), of_alphabet(F.col("_body_"), F.col("_abc_"))).otherwise(""))
        rows = rows.withColumn("_chars_", permute_text(F.col("_chars_"), F.col("_abc_"), key, of, back))
        rows = rows.withColumn("_body_", F.when(F.col("_abc_").isNotNull(), refill(F.col("_body_"), F.col("_abc_"), F.col("_chars_"))).otherwise(F.col("_body_")))
    # of a secret that is not hexadecimal, what follows its first such character
    rows = rows.withColumn("_rest_", F.when(of == "password", F.substr("_tail_", F.lit(2))).otherwise(""))
    for abc in (LOWER, UPPER, DIGITS):
        rows = rows.withColumn("_chars_", permute_text(of_alphabet(F.col("_rest_"), F.lit(abc)), F.lit(abc), key, of, back))
        rows = rows.withColumn("_rest_", F.when(of == "password", refill(F.col("_rest_"), F.lit(abc), F.col("_chars_"))).otherwise(""))
    rows = rows.withColumn("_tail_", F.when(of == "password", F.concat(F.substring("_tail_", 1, 1), "_rest_")).otherwise(F.col("_tail_")))
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    dated = of.isin("date", "day")
    day = F.datediff(as_date(v), F.lit(FIRST_DAY).cast("date")).cast("long")
    rows = rows.withColumn("_size_", F.when(of == "ip", F.lit(1 << 32)).when(dated, F.lit(DAYS).cast("long")))
    rows = rows.withColumn("_x_", F.when(of == "ip", F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)).when(dated, day))
    rows = rows.withColumn("_x_", F.when(F.col("_x_").isNotNull(), permute(F.col("_x_"), F.col("_size_"), key, F.when(of == "day", "date").otherwise(of), back)))  # a date is linked in both forms
    octet = lambda s: F.shiftright("_x_", s).bitwiseAND(F.lit(255)).cast("string")
    check = (10 - luhn_sum(F.concat(F.col("_head_"), only_digits(F.col("_body_")), F.lit("0"))) % 10) % 10
    whole = F.concat("_head_", "_body_", "_tail_")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("_x_").cast("int"))
    result = (
        F.when(of == "ip", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))
        .when(of == "date", moved.cast("string"))
        .when(of == "day", F.concat(F.date_format(moved, "dd"), F.substring(v, 3, 1), F.date_format(moved, "MM"), F.substring(v, 3, 1), F.date_format(moved, "yyyy")))
        .when(of == "iban", F.concat(F.substring("_head_", 1, 2), iban_check(F.substring("_head_", 1, 2), F.regexp_replace("_body_", " ", "")), "_body_"))
        .when(of == "card", F.concat(F.col("_head_"), F.col("_body_"), check.cast("string")))
        .when(of.isNotNull(), whole)
        .otherwise(v)
    )
    return rows.withColumn("pseudonym", result).select(*matches.columns, "kind", "pseudonym")


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", id_col: str = "doc_id", back: bool = False) -> DataFrame:
    """All columns, with ``text`` rewritten and an array ``found`` of (kind, value, pseudonym) in order of place."""
    kept = [c for c in docs.columns if c != "found"]
    columns = [F.col(f"`{c}`") for c in kept]
    kinds = "array<struct<kind:string,value:string,pseudonym:string>>"
    # a match holds a digit, an at-sign or a key's prefix: most texts have none, and no search is needed
    hint = F.coalesce(F.col(text).rlike(f"[0-9@]|AKIA|ASIA|{NAMED}"), F.lit(False))
    searched = F.when(hint, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    some = F.coalesce(F.size(searched) > 0, F.lit(False))
    without = docs.where(~some).select(*columns).withColumn("found", F.array().cast(kinds))
    hit = materialize(docs.where(some).select(*columns, searched.alias("_m_"), F.xxhash64(text).alias("_k_")), "matched")
    # rows that share doc_id and text have the same matches
    rows = hit.dropDuplicates([id_col, "_k_"]).select(F.col(id_col).alias("_id_"), F.col("_k_").alias("_tk_"), F.posexplode("_m_").alias("_pos_", "value"))
    # matches are short and dear to change, so they are dealt by their number and not by their bytes
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(hit.agg(F.sum(F.size("_m_"))).first()[0] or 0) // TASK_MATCHES))
    done = pseudonyms(rows.repartition(tasks), key, back).groupBy("_id_", "_tk_").agg(F.sort_array(F.collect_list(F.struct("_pos_", "kind", "value", "pseudonym"))).alias("_f_"))
    joined = hit.join(done, F.col(id_col).eqNullSafe(F.col("_id_")) & (F.col("_k_") == F.col("_tk_")))
    changed = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), F.col("_f_"), lambda g, f: F.concat(g, F.coalesce(f["pseudonym"], F.lit("")))), "")
    bare = lambda f, c: F.when(f["kind"].isin("secret", "password"), F.regexp_replace(f[c], "^" + NAMED, "")).otherwise(f[c]).alias(c)
    found = F.transform(F.filter("_f_", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), bare(f, "value"), bare(f, "pseudonym")))
    joined = joined.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in kept], found.cast(kinds).alias("found"))
    return joined.unionByName(without)


def report(done: DataFrame) -> DataFrame:
    """doc_id, the number of replacements of each kind and in all, and the rewritten text."""
    n = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *[n(k) for k in KINDS], F.size("found").cast("long").alias("n_found"), "text")
