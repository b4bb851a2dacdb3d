"""Surrogates for personal data and secrets, as DataFrame expressions.

Detected entities (addresses, numbers, keys, titled names) are replaced by
keyed surrogates of the same type and format.  Digits are permuted by a keyed
Feistel network over the digits of one format, which keeps different numbers
different; letters keep their script; a given name keeps the gender of its title;
card numbers and IBANs keep valid check digits.

An entity is compared in one form, its *value*: without case, spacing and
punctuation, of a phone number without country code and leading zeros, of a name
its given name and its family name, each a value of its own.  The surrogate is made
from the value alone and then written in the format of each occurrence, so every
way of writing an entity gets the same one: "Mr. John Smith", "Mr John Smith",
"Mr Smith" and, in the same text, "John Smith" and "Smith" without a title.

A check over all distinct values finds surrogates that two values share or that
are themselves real values; those values are keyed anew until no collision is left,
and the documents that hold them are written with the new choice.

Texts are searched once: a checkpoint keeps them with their entities marked, for
the check and for the writing.

Defined results: null texts stay null; texts without entities stay as they are,
empty ones and those with control characters too; repeated rows are rewritten
alike; names without any title in their text are not found; a very long text is
rewritten whole, in memory of some times its size; an empty table gives an empty
result; other columns pass through, replaced where they are named as a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import cut, if_small

_TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "": ["Dr", "Prof", "Professor", "Professora", "Доктор"],
}
_TITLE = "(?:" + "|".join(t for x in _TITLES.values() for t in x) + r")\.?"
_NAMES = {
    ("f", "latin"): ["Ada", "Bea", "Cora", "Dina", "Elsa", "Flora", "Greta", "Hilda", "Ines", "Julia", "Klara", "Lena", "Mara", "Nora", "Olga", "Petra"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Leo", "Max", "Nils", "Oskar", "Paul"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    ("f", "greek"): ["Άννα", "Βέρα", "Δάφνη", "Ειρήνη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κλειώ", "Λητώ", "Μαρία", "Νίκη", "Ξένια", "Όλγα", "Ρέα", "Σοφία"],
    ("m", "greek"): ["Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ερμής", "Ζήνων", "Ηλίας", "Θάνος", "Ιάσων", "Κώστας", "Λέων", "Μάρκος", "Νίκος", "Ορέστης", "Πέτρος", "Στέφανος"],
}
_SYLLABLES = {
    "latin": ["ba", "ber", "do", "fel", "ga", "hol", "ka", "lin", "ma", "nor", "pe", "rin", "sa", "tor", "va", "wen"],
    "cyrillic": ["ба", "бер", "до", "фел", "га", "хол", "ка", "лин", "ма", "нор", "пе", "рин", "са", "тор", "ва", "вен"],
    "greek": ["βα", "βερ", "δο", "φελ", "γα", "χολ", "κα", "λιν", "μα", "νορ", "πε", "ριν", "σα", "τορ", "ζα", "θεν"],
}

_KEYWORD = r"(?i:token|secret|password|passwd|pwd|api_?key|access_?key|auth)"
#: Patterns by type; where several match at one place, the first does.
PATTERNS = {
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": r"(?<![\p{L}])" + _TITLE + "(?: " + _TITLE + r")* \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?(?!\p{L})",
    "secret": r"(?<=" + _KEYWORD + r"\"? {0,2}[=:] {0,2}[\"'])[^\"'\s]++(?=[\"'])",
}
ANY = "|".join(PATTERNS.values())
#: A quick test that holds for every text with an entity.
_HINT = r"[0-9@]|AKIA[A-Z]{16}|[a-fA-F]{32}|" + _KEYWORD + r"\"? {0,2}[=:]|" + _TITLE + r" \p{Lu}"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def kind(e: Column) -> Column:
    """The type of an entity, from its own characters."""
    out = F.lit("secret")
    for name in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(e.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


#: Country codes at the start of a number that begins with '+'; those not listed have three digits.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def value_of(e: Column, k: Column) -> Column:
    """The form in which entities of all types but names are compared."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    national = F.regexp_replace(e, _COUNTRY, "")
    number = F.regexp_replace(national, "[^0-9]", "")
    short = F.regexp_replace(number, "^0+", "")
    return (
        F.when(k.isin("email", "hex_key"), F.lower(e))
        .when(k == "phone", F.when(F.length(short) >= 4, short).otherwise(number))
        .when(k.isin("card", "ssn"), digits)
        .when(k == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )


def _person(e: Column) -> Column:
    """Of a titled name: gender by the titles, given name (empty if there is none) and family name."""
    words = F.split(F.regexp_replace(e, "^(?:" + _TITLE + " )+", ""), " ")
    titled = lambda g: e.rlike(r"^(?:" + _TITLE + r" )*?(?:" + "|".join(_TITLES[g]) + r")\.? ")
    given = F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise("")
    # a title that tells no gender: by the name's ending
    gender = F.when(titled("f"), "f").when(titled("m"), "m").when(given.rlike("(?:[aаяαηώ]|[^aeiou]e)$"), "f").otherwise("m")
    return F.struct(gender.alias("gender"), given.alias("given"), F.element_at(words, -1).alias("family"))


def units(e: Column, k: Column) -> Column:
    """Array of (kind, value): what is compared of an entity, a name's given and family name apart."""
    part = lambda kind_, value: F.struct(kind_.alias("kind"), value.alias("value"))
    names = _let(_person(e), lambda p: F.filter(F.array(part(F.lit("family"), F.lower(p["family"])), part(F.concat(F.lit("given_"), p["gender"]), F.lower(p["given"]))), lambda u: u["value"] != ""))
    return F.when(k == "name", names).otherwise(F.array(part(k, value_of(e, k))))


def _number(seed: Column) -> Column:
    """A keyed number below 2**60."""
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _permuted(digits: Column, seed: Column) -> Column:
    """``digits`` (up to 30) permuted among the strings of so many digits: six rounds of a Feistel network."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("l"), F.substring(digits, half + 1, n).alias("r"))

    def turn(acc, k):
        size = F.length(acc["l"])
        mix = _number(F.concat_ws("|", seed, n.cast("string"), k.cast("string"), acc["r"]))
        new = F.pmod(acc["l"].cast("decimal(20,0)") + mix, F.pow(F.lit(10.0), size).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
        return F.struct(acc["r"].alias("l"), F.lpad(new, size, "0").alias("r"))

    whole = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))
    # a single digit is shifted
    return F.when(n >= 2, whole(digits)).when(n == 1, F.pmod(digits.cast("int") + _number(F.concat_ws("|", seed, F.lit("1"))), F.lit(10)).cast("string")).otherwise("")


def _refill(e: Column, chars: Column, kind_: str = "[0-9]") -> Column:
    """``e`` with its characters of a kind (digits) replaced by ``chars``, in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), kind_.replace("[", "[^"), ""))
    return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(f"^{kind_}$"), F.substring(chars, place(i), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check of ``digits``, modulo 10."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def _letters(e: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit of ``e`` replaced by a keyed one of the same case; hexadecimal digits by those in lower case."""
    stream = F.concat(*(F.sha2(F.concat_ws("|", seed, F.lit(str(b))).cast("binary"), 256) for b in range(4)))

    def one(s):
        def pick(c, i):
            r = F.conv(F.substring(s, (i % 63) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 63).cast("int")
            at = lambda alphabet: F.substring(F.lit(alphabet), r % len(alphabet) + 1, F.lit(1))
            if hexadecimal:
                return at("0123456789abcdef")
            return F.when(c.rlike("^[a-z]$"), at("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("^[0-9]$"), at("0123456789")).otherwise(c)

        return F.array_join(F.transform(F.split(e, ""), pick), "")

    return _let(stream, one)


def _email(e: Column, seed: Column, key: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    # short names are lengthened, or too few would be there for all; the top-level domain stays
    long = F.rpad(F.regexp_extract(local, "^[^._%+-]*", 0), 9, "x")
    local = F.concat(F.when(F.length(F.regexp_extract(local, "^[^._%+-]*", 0)) < 9, long).otherwise(F.regexp_extract(local, "^[^._%+-]*", 0)), F.regexp_extract(local, "[._%+-].*$", 0))
    top = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(_letters(local, seed), F.lit("@"), _letters(host, F.concat_ws("|", key, F.lit("domain"), F.lower(domain))), top)


def _pick(options: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), (n % len(options)).cast("int"))


def _secret(e: Column, seed: Column) -> Column:
    """Letters and digits replaced; secrets with few of them are lengthened, or too few would be there for all."""
    few = F.length(F.regexp_replace(e, "[^A-Za-z0-9]", "")) < 6
    return _letters(F.when(few, F.concat(e, F.lit("x" * 12))).otherwise(e), seed)


_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _iban(value: Column, seed: Column) -> Column:
    """Country kept, account replaced, check digits that are right (the number in base 97 leaves 1)."""

    def checked(account):
        digits = F.transform(F.split(F.concat(account, F.substring(value, 1, 2), F.lit("00")), ""), lambda c: F.instr(F.lit(_ALNUM), c) - 1)
        left = F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
        return F.concat(F.substring(value, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), account)

    return _let(_letters(F.substring(value, F.lit(5), F.length(value)), seed), checked)


def _name(value: Column, gender: str | None, seed: Column, tries: Column) -> Column:
    """A family name, or a given name of a gender, of the script of ``value``; at later tries there are more of them."""
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    r = lambda j: _number(F.concat_ws("|", seed, F.lit(j)))
    endings = {"f": {"latin": "na", "cyrillic": "на", "greek": "να"}, "m": {"latin": "nor", "cyrillic": "нор", "greek": "νορ"}}

    def made(s, least):
        count = F.lit(least) + F.least(tries, F.lit(8))
        return F.array_join(F.transform(F.sequence(F.lit(0), count), lambda i: _pick(_SYLLABLES[s], _number(F.concat_ws("|", seed, F.lit("s"), i.cast("string"))))), "")

    out = F.lit(None).cast("string")
    for s in _SYLLABLES:
        if gender is None:
            own = made(s, 2)
        else:
            names = _NAMES[gender, s]
            own = F.when(tries == 0, _pick(names, r("g"))).otherwise(F.concat(made(s, 0), F.lit(endings[gender][s])))
        out = F.when(script == s, own).otherwise(out)
    return F.lower(out)


def core(k: Column, value: Column, key: str, tries: Column) -> Column:
    """The surrogate of a value, itself a value, under ``key`` and at the given try."""
    seed = F.concat_ws("|", F.lit(key), k, value, tries.cast("string"))
    tweak = F.concat_ws("|", F.lit(key), k, tries.cast("string"))  # of permutations: the same for all of a type
    n = F.length(value)
    rest = F.substring(value, F.lit(2), n)
    # the first digit stays one from 1 to 9, whatever the others become
    first = lambda d: F.concat((F.pmod(F.substring(value, 1, 1).cast("int") - 1 + _number(F.concat_ws("|", tweak, d)), F.lit(9)) + 1).cast("string"), d)
    phone = F.when(value.startswith("0"), _permuted(value, tweak)).otherwise(_let(_permuted(rest, tweak), first))
    body = lambda last: F.concat(F.substring(value, 1, 1), _permuted(F.substring(value, F.lit(2), n - last), F.concat_ws("|", tweak, F.lit(str(last)))))
    valid = _let(body(2), lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    octet = lambda j: F.split(value, r"\.")[j].cast("int")
    ip = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        F.struct((octet(0) * 256 + octet(1)).cast("long").alias("l"), (octet(2) * 256 + octet(3)).cast("long").alias("r")),
        lambda acc, i: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + _number(F.concat_ws("|", tweak, i.cast("string"), acc["r"].cast("string"))), F.lit(65536)).alias("r")),
        lambda acc: F.concat_ws(".", F.floor(acc["l"] / 256).cast("string"), (acc["l"] % 256).cast("string"), F.floor(acc["r"] / 256).cast("string"), (acc["r"] % 256).cast("string")),
    )
    return (
        F.when(k == "email", F.lower(_email(value, seed, F.lit(key))))
        .when(k == "phone", phone)
        .when(k == "card", F.when(_luhn(value) == 0, valid).otherwise(body(1)))
        .when(k == "ssn", _permuted(value, tweak))
        .when(k == "ip", ip)
        .when(k == "access_key", F.concat(F.lit("AKIA"), _letters(F.substring(value, 5, 16), seed)))
        .when(k == "hex_key", _letters(value, seed, hexadecimal=True))
        .when(k == "iban", _iban(value, seed))
        .when(k == "family", _name(value, None, seed, tries))
        .when(k == "given_f", _name(value, "f", seed, tries))
        .when(k == "given_m", _name(value, "m", seed, tries))
        .otherwise(_secret(value, seed))
    )


def written(e: Column, k: Column, new: Column) -> Column:
    """``new``, the surrogates of the units of ``e``, in the format of ``e``."""
    one = F.get(new, F.lit(0))
    # what stands before the number of a phone: country code and leading zeros
    zeros = F.length(F.regexp_replace(F.regexp_replace(e, _COUNTRY, ""), "[^0-9]", "")) - F.length(one)
    country = F.regexp_replace(F.regexp_extract(e, _COUNTRY, 0), "[^0-9]", "")
    upper = (e == F.upper(e)) & (e != F.lower(e))
    titles = F.regexp_extract(e, "^(?:" + _TITLE + " )+", 0)
    return (
        F.when(k == "name", F.concat(titles, F.array_join(F.transform(F.reverse(new), F.initcap), " ")))
        .when(k == "phone", _refill(e, F.concat(country, F.repeat(F.lit("0"), zeros), one)))
        .when(k.isin("card", "ssn"), _refill(e, one))
        .when(k == "iban", _refill(e, one, "[0-9A-Z]"))
        .when(k.isin("email", "hex_key") & upper, F.upper(one))
        .otherwise(one)
    )


def surrogate(e: Column, key: str, tries: Column) -> Column:
    """The replacement of entity ``e`` under ``key``, all its values at the given try."""
    return _let(kind(e), lambda k: written(e, k, F.transform(units(e, k), lambda u: core(u["kind"], u["value"], key, tries))))


#: Stands on both sides of an entity in a marked text; a text that holds it has it, and the sign of that, written as two.
_MARK, _SIGN = "\u0001", "\u0002"


def marked(text: Column) -> Column:
    """``text`` with its entities between marks; null where there is none."""
    odd = text.contains(_MARK) | text.contains(_SIGN)
    plain = F.when(odd, F.replace(F.replace(text, F.lit(_SIGN), F.lit(_SIGN + "s")), F.lit(_MARK), F.lit(_SIGN + "m"))).otherwise(text)
    return F.when(text.rlike(_HINT), _let(F.regexp_replace(plain, ANY, _MARK + "$0" + _MARK), lambda m: F.when(m.contains(_MARK), m)))


def _plain(part: Column) -> Column:
    back = F.replace(F.replace(part, F.lit(_SIGN + "m"), F.lit(_MARK)), F.lit(_SIGN + "s"), F.lit(_SIGN))
    return F.when(part.contains(_SIGN), back).otherwise(part)


def _found(m: Column) -> Column:
    """Array of (e, kind, units) of the entities of a marked text, in order."""
    every = F.transform(F.filter(F.split(m, _MARK, -1), lambda x, i: i % 2 == 1), _plain)
    return F.transform(F.transform(every, lambda e: F.struct(e.alias("e"), kind(e).alias("kind"))), lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), units(x["e"], x["kind"]).alias("units")))


def _marked_rows(docs: DataFrame, text: str) -> DataFrame:
    """``__row``, a number of the row, ``__kept``, its other columns, ``__t``, its text, and ``__m``, that marked: searched once and kept."""
    t = F.col(f"`{text}`")
    kept = F.struct(F.lit(1).alias("__one"), *(F.col(f"`{c}`") for c in docs.columns if c != text))
    return cut(docs.select(F.monotonically_increasing_id().alias("__row"), kept.alias("__kept"), t.alias("__t"), marked(t).alias("__m")))


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, value, tries) of the values that need another try than 0, over all of ``docs``."""
    return _collisions(_marked_rows(docs, text), key)


def _collisions(rows: DataFrame, key: str, most: int = 50) -> DataFrame:
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but dear to compute
    found = rows.where("__m is not null").select(F.explode(F.array_distinct(F.flatten(_found(F.col("__m"))["units"]))).alias("u")).select("u.*")
    real = cut(found.distinct().repartition(spread, "kind", "value"))
    given = None
    waiting = real
    for tries in range(most):
        made = cut(waiting.select("kind", "value", core(F.col("kind"), F.col("value"), key, F.lit(tries)).alias("s")))
        taken = real.select("kind", F.col("value").alias("s"), F.lit(None).cast("string").alias("value"))
        if given is not None:
            taken = taken.unionByName(given.select("kind", "s", F.lit(None).cast("string").alias("value")))
        # one shuffle by surrogate: of those who share it the least value has it, unless it is taken
        winner = taken.unionByName(made).groupBy("kind", "s").agg(F.max(F.col("value").isNull()).alias("no"), F.min("value").alias("value")).where("value is not null and not no")
        won = made.join(winner.select("kind", "value", "s"), ["kind", "value", "s"], "left_semi").withColumn("tries", F.lit(tries))
        lost = cut(made.join(winner.select("kind", "value", "s"), ["kind", "value", "s"], "left_anti").select("kind", "value"))
        none_left = lost.isEmpty()
        if tries == 0 and none_left:
            return lost.withColumn("tries", F.lit(0))
        given = won if given is None else cut(given.unionByName(won))
        if none_left:
            return given.where("tries > 0").select("kind", "value", "tries")
        waiting = lost.repartition(spread, "kind", "value")
    raise ValueError(f"surrogates still collide after {most} tries")


def replace(docs: DataFrame, key: str, text: str = "text", small: int = 50_000) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities``, those found by a pattern.

    Documents with a value of another try get it by a join on a number of the row,
    broadcast if there are at most ``small`` of them.
    """
    keep = [c for c in docs.columns if c.lower() != "n_entities"]
    rows = _marked_rows(docs.select(*(F.col(f"`{c}`") for c in keep)), text)
    again = cut(_collisions(rows, key))
    df = rows.withColumn("__e", _found(F.col("__m")))
    tries = lambda u: F.lit(0)
    if not again.isEmpty():
        here = rows.where("__m is not null").select("__row", F.explode(F.array_distinct(F.flatten(_found(F.col("__m"))["units"]))).alias("u")).select("__row", "u.*")
        own = here.join(if_small(again, small), ["kind", "value"]).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "tries"))).alias("__tries"))
        df = df.join(if_small(cut(own), small), "__row", "left")
        tries = lambda u: F.coalesce(F.try_element_at(F.col("__tries"), F.concat_ws("|", u["kind"], u["value"])), F.lit(0))
    # the new values of each entity, then how it is written
    df = df.withColumn("__n", F.transform("__e", lambda x: F.transform(x["units"], lambda u: core(u["kind"], u["value"], key, tries(u)))))
    df = df.withColumn("__s", F.transform("__e", lambda x, i: written(x["e"], x["kind"], F.get(F.col("__n"), i))))
    # names of the text, family name first, with and without their new ones
    people = F.filter(F.transform("__e", lambda x, i: F.struct(x["kind"].alias("kind"), _person(x["e"]).alias("old"), F.transform(F.get(F.col("__n"), i), F.initcap).alias("new"))), lambda x: x["kind"] == "name")
    df = df.withColumn("__people", F.array_distinct(people))

    def bare(part):
        whole = lambda word: F.concat(F.lit(r"(?<!\p{L})"), word, F.lit(r"(?!\p{L})"))

        def one(acc, x):
            full = F.when(x["old"]["given"] != "", F.regexp_replace(acc, whole(F.concat_ws(" ", x["old"]["given"], x["old"]["family"])), F.concat_ws(" ", F.get(x["new"], F.lit(1)), F.get(x["new"], F.lit(0))))).otherwise(acc)
            return F.regexp_replace(full, whole(x["old"]["family"]), F.get(x["new"], F.lit(0)))

        return F.when(F.size("__people") > 0, F.aggregate("__people", part, one)).otherwise(part)

    parts = F.split(F.col("__m"), _MARK, -1)
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get(F.col("__s"), (i / 2).cast("int"))).otherwise(bare(_plain(p)))), "")
    new = F.when(F.col("__m").isNotNull(), whole).otherwise(F.col("__t"))
    return df.select(*(new.alias(c) if c == text else F.col(f"__kept.`{c}`") for c in keep), F.coalesce(F.when(F.col("__e").isNotNull(), F.size("__e")), F.lit(0)).cast("long").alias("n_entities"))
