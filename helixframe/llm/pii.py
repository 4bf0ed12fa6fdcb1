"""Personal data replaced by surrogates, in DataFrame functions only.

Mentions are found by patterns, brought to a canonical form (the digits of a number, an address in lower case, one word
of a name), and every distinct entity gets one surrogate drawn from a keyed hash: the same kind of thing, in the script
and and for the gender of the original, valid where the original is valid. A name is one entity whatever title or place it
stands with, and its gender is what most of its mentions in all texts say. Surrogates that meet each other or a real
entity, of whatever kind, are drawn again, so entities that differ stay different. A surrogate is then written in the
format of each mention, so all mentions of an entity, in all texts, agree.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.llm._common import written

#: Patterns of each kind, in the order in which they are tried. All but addresses hold a digit.
PATTERNS = {
    # Labels are counted: a loop over them without a bound can exhaust the matcher's stack.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,12}\p{L}{2,}(?![\p{L}\p{N}])",
    "secret": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<=\b(?:password|passwd|secret|token|api_key|apikey)=)(?=\S{0,99}\d)[\p{L}\p{N}_/+-]{8,100}+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: Titles that tell a name and its bearer's gender: f, m, or x for either.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "x": ("Dr", "Prof"),
}
#: Given names that tell a name without a title, and the bearer's gender.
GIVEN = {
    "f": "Alice Amanda Andrea Angela Anna Anne Barbara Caroline Catherine Charlotte Claudia Daniela Deborah Elena Elizabeth Emily Emma Fatima Hannah Helen"
    " Ingrid Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret Maria Marie Martha Mary Michelle Monika Nancy Natalia Olivia Patricia"
    " Rebecca Sabine Sandra Sarah Sofia Sophie Stephanie Susan Teresa Ursula Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    "m": "Ahmed Alexander Andrew Anthony Antonio Brian Carlos Charles Christopher Daniel David Dennis Diego Edward Fernando Francisco Gary George Giovanni"
    " Hans Henry James Jason Javier Jean Jeffrey Johannes John Jonathan Jorge Jose Joseph Joshua Juan Jürgen Kenneth Kevin Klaus Luca Luis Manuel Matthew"
    " Michael Miguel Mohammed Nicholas Pablo Patrick Paul Pedro Peter Pierre Richard Robert Ronald Stefan Stephen Steven Thomas Timothy William Wolfgang"
    " Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей",
}
#: Consonants and vowels that names are made of, and their endings by gender, for each script.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "a", "m": "n", "x": "l", "": "k"}),
    "cyrillic": ("бдгклмнпрств", "аеиоу", {"f": "а", "m": "н", "x": "л", "": "к"}),
    "greek": ("βδγκλμνπρστ", "αειου", {"f": "α", "m": "ς", "x": "ν", "": "κ"}),
}
#: Letters of further scripts, from which single letters are replaced.
LETTERS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{IsCyrillic}": "".join(map(chr, range(0x430, 0x450))),
    r"\p{IsGreek}": "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2),
    r"\p{IsArmenian}": "".join(map(chr, range(0x561, 0x587))),
    r"\p{IsHebrew}": "".join(map(chr, range(0x5D0, 0x5EB))),
    r"\p{IsArabic}": "".join(map(chr, range(0x628, 0x63B))),
    r"\p{IsDevanagari}": "".join(map(chr, range(0x915, 0x93A))),
    r"\p{IsThai}": "".join(map(chr, range(0xE01, 0xE2F))),
    r"\p{IsHiragana}|\p{IsKatakana}": "".join(map(chr, range(0x304B, 0x3063))),
    r"\p{IsHangul}": "".join(map(chr, range(0xAC00, 0xD7A4, 588))),
    r"\p{IsHan}": "".join(map(chr, range(0x5B50, 0x5B90))),
}
CAPITALS = "[A-ZÀ-ÞΆ-ΫА-ЯЁ]"
WORD = rf"(?={CAPITALS})(?<![\p{{L}}\p{{N}}])\p{{Lu}}\p{{L}}+"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(" ".join(GIVEN.values()).split())
#: A title and one or two words, or a known given name and another word.
NAMED = rf"(?={CAPITALS})(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?|(?:{_GIVEN}) \p{{Lu}}\p{{L}}+)"
_NUMBERS = "|".join(p for k, p in PATTERNS.items() if k != "email")
_ANY = "|".join(PATTERNS.values())


def session_key(spark: SparkSession) -> str:
    """The secret that ``spark.helixframe.surrogates.key`` names; where it is unset, one is drawn for this session."""
    name = "spark.helixframe.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def _by_need(of: Callable[[Column], Column], none: Column) -> Column:
    """``of`` the pattern that a text needs: in texts with a name every capitalised word too, as it may repeat the name.

    Most texts hold nothing that could begin a mention, which costs little to see. All patterns are literals, so each
    is compiled once.
    """
    text = F.col("text")
    return (
        F.when(text.rlike(NAMED), of(F.lit(f"{_ANY}|{WORD}")))
        .when(text.contains("@"), of(F.lit(_ANY)))
        .when(text.rlike("[0-9]"), of(F.lit(_NUMBERS)))
        .otherwise(none)
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _drawn(draw: Column, i: Column, among: int) -> Column:
    """The i-th number below ``among`` of a string of hexadecimal digits."""
    return F.conv(F.substring(draw, i * 3 % (F.length(draw) - 3) + 1, F.lit(3)), 16, 10).cast("int") % among


def _luhn_sum(digits: Column, n: Column) -> Column:
    """Sum of a number's digits where every second from the right, the last not counted, is doubled."""
    each = F.transform(digits, lambda d, j: F.when((n - j) % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _numbers(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda x: x != ""), lambda x: x.cast("int"))


def _is_card(value: Column) -> Column:
    n = F.length(value)
    return _luhn_sum(_numbers(value), n) % 10 == 0


def _kind() -> Column:
    return reduce(lambda c, k: c.when(F.col("value").rlike(f"^(?:{PATTERNS[k]})$"), k), PATTERNS, F.when(F.lit(False), "")).otherwise("word")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _mod97(text: Column) -> Column:
    """The remainder of a number in which A to Z stand for 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _is_iban(value: Column) -> Column:
    return _mod97(F.concat(F.expr("substring(canon, 5)"), F.substring(value, 1, 4))) == 1


def _letter(draw: Column, i: Column, like: Column) -> Column:
    """A letter of the script and case of ``like``."""
    pick = lambda of: F.substring(F.lit(of), _drawn(draw, i, len(of)) + 1, F.lit(1))
    return reduce(lambda c, k: c.when(like.rlike(k), pick(LETTERS[k])), LETTERS, F.when(F.lit(False), "")).otherwise(pick(LETTERS["[a-z]"]))


def _reshaped(text: Column, draw: Column) -> Column:
    """Letters for letters of the script and digits for digits, all else as it is; hyphens, where there is neither.

    With the number of draws letters are added, so that short texts don't run out.
    """
    bare = ~text.rlike(r"[\p{L}\p{N}]")
    more = F.floor(F.col("a") / 4).cast("int")
    swap = lambda c, i: F.when(c.rlike(r"\p{N}"), _drawn(draw, i, 10).cast("string")).when(c.rlike(r"\p{L}") | (bare & (c == "-")), _letter(draw, i, c)).otherwise(c)
    added = F.transform(F.slice(F.sequence(F.lit(0), more), F.lit(1), more), lambda i: _letter(draw, i + F.length(text), F.substring(text, 1, 1)))
    return F.array_join(F.concat(F.transform(F.split(text, ""), swap), added), "")


def _syllable(draw: Column, consonants: str, vowels: str) -> Callable[[Column], Column]:
    letter = lambda of, i: F.substring(F.lit(of), _drawn(draw, i, len(of)) + 1, F.lit(1))
    return lambda i: F.concat(letter(consonants, i * 2), letter(vowels, i * 2 + 1))


def _surrogate() -> Column:
    """What ``draw`` (hexadecimal) makes of ``canon``, by kind; a domain's part of an address is in ``domain``.

    No space of surrogates is ever used up: with the number of draws ``a`` they get longer, or leave their range.
    """
    canon, draw, n = F.col("canon"), F.col("draw"), F.length("canon")
    digit = lambda i: _drawn(draw, i, 10)
    old = lambda i: F.substring(canon, i + 1, F.lit(1)).cast("int")
    whole = n + F.floor(F.col("a") / 16).cast("int")
    # Country codes stay; area and exchange don't begin with 0 or 1.
    own = n - 10
    phone = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.when((own > 0) & (i < own), old(i)).when((i == own) | (i == own + 3), _drawn(draw, i, 8) + 2).otherwise(digit(i)))
    ssn = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.when(i == 0, _drawn(draw, i, 8) + 1).otherwise(digit(i)))
    # The first digit, which tells the issuer's network, stays; the last one makes the number valid.
    body = F.transform(F.sequence(F.lit(0), whole - 2), lambda i: F.when(i == 0, old(i)).otherwise(digit(i)))
    card = F.array_append(body, (10 - _luhn_sum(body, whole) % 10) % 10)
    rest = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (_drawn(draw, i, 254) + 1).cast("string"))
    # A private range that is used up gives way to a larger one, that to the public ones, and these to ports of theirs.
    ip = (
        F.when(canon.startswith("192.168.") & (F.col("a") < 8), F.concat_ws(".", F.lit("192"), F.lit("168"), F.slice(rest, 1, 2)))
        .when((canon.startswith("10.") | canon.startswith("192.168.")) & (F.col("a") < 24), F.concat_ws(".", F.lit("10"), rest))
        .otherwise(F.concat(F.concat_ws(".", (_drawn(draw, F.lit(0), 80) + 11).cast("string"), rest), F.when(F.col("a") < 80, "").otherwise(F.concat(F.lit(":"), F.col("a").cast("string")))))
    )
    hexa = lambda i: F.substring(F.lit("0123456789abcdef"), _drawn(draw, i, 16) + 1, F.lit(1))
    wide = F.concat(F.lit("fd"), F.array_join(F.transform(F.sequence(F.lit(2), F.lit(31)), lambda i: F.concat(F.when(i % 4 == 0, ":").otherwise(""), hexa(i))), ""))
    ip6 = F.when(F.col("a") < 8, F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when((i > 0) & c.rlike("[0-9a-f]"), hexa(i)).otherwise(c)), "")).otherwise(wide)
    account = F.upper(_reshaped(F.expr("substring(canon, 5)"), draw))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    local = _reshaped(F.substring_index(canon, "@", 1), draw)
    domain = F.concat(_reshaped(F.substring(canon, F.lit(1), n - F.length(F.substring_index(canon, ".", -1)) - 1), draw), F.lit("."), F.substring_index(canon, ".", -1))

    name = F.lit(None).cast("string")
    for script, (consonants, vowels, ends) in SYLLABLES.items():
        syllables = F.transform(F.sequence(F.lit(0), 2 + F.floor(F.col("a") / 4).cast("int")), _syllable(draw, consonants, vowels))
        end = reduce(lambda c, g: c.when(F.col("gender") == g, ends[g]), "fmx", F.when(F.lit(False), "")).otherwise(ends[""])  # noqa: B023
        name = F.when(_script(canon) == script, F.concat(F.array_join(syllables, ""), end)).otherwise(name)

    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    kind = F.col("kind")
    return (
        F.when(kind == "phone", joined(phone)).when(kind == "ssn", joined(ssn)).when(kind == "card", joined(card)).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "iban", iban)
        .when(kind == "email", F.concat(local, F.lit("@"), F.col("domain"))).when(kind == "domain", domain).when(kind == "secret", _reshaped(canon, draw)).otherwise(F.coalesce(name, _reshaped(canon, draw)))
    )


def _resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon, domain, gender): no two alike, none a real entity of any kind."""
    draw = F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", "a", F.lit(i)), 256) for i in range(4)))
    made = lambda df: df.withColumn("draw", draw).withColumn("surrogate", _surrogate()).drop("draw")
    now = written(made(entities.withColumn("a", F.lit(0))), "surrogates")
    while True:
        # Of those that meet, the one of the fewest draws stays, by kind and canon if there are several.
        first = now.groupBy("surrogate").agg(F.min(F.struct("a", "kind", "canon")).alias("first"))
        real = now.select(F.col("canon").alias("surrogate"), F.lit(True).alias("real")).distinct()
        marked = now.join(first, "surrogate").join(real, "surrogate", "left")
        again = F.col("real").isNotNull() | (F.col("first.canon") != F.col("canon")) | (F.col("first.kind") != F.col("kind"))
        marked = written(marked.select("kind", "canon", "domain", "gender", "a", "surrogate", again.alias("again")), "met")
        # All but few stay; only the others are drawn again.
        if marked.where("again").isEmpty():
            return now.select("kind", "canon", "surrogate")
        drawn = made(marked.where("again").select("kind", "canon", "domain", "gender", (F.col("a") + 1).alias("a")))
        now = written(marked.where("not again").drop("again").unionByName(drawn), "surrogates")


def _rendered() -> Column:
    """The surrogate in the format of the mention ``value``."""
    value, new = F.col("value"), F.col("surrogate")
    chars = F.filter(F.split(value, ""), lambda x: x != "")
    # Each digit of the mention (of an account, each letter too) gives way to the one of the same rank; longer ones go on at its end.
    rank = F.transform(chars, lambda c, i: F.length(_digits(F.substring(value, F.lit(1), i + 1))))
    digits = F.concat(F.array_join(F.zip_with(chars, rank, lambda c, k: F.when(c.rlike(r"\d"), F.substring(new, k, F.lit(1))).otherwise(c)), ""), F.substring(new, F.length(_digits(value)) + 1, F.lit(99)))
    packed = lambda c: F.regexp_replace(c, " ", "")
    place = F.transform(chars, lambda c, i: F.length(packed(F.substring(value, F.lit(1), i + 1))))
    account = F.concat(F.array_join(F.zip_with(chars, place, lambda c, k: F.when(c != " ", F.substring(new, k, F.lit(1))).otherwise(c)), ""), F.substring(new, F.length(packed(value)) + 1, F.lit(99)))
    cased = F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(new)).when(F.upper(F.substring(value, 1, 1)) == F.substring(value, 1, 1), F.concat(F.upper(F.substring(new, 1, 1)), F.expr("substring(surrogate, 2)"))).otherwise(new)
    kind = F.col("kind")
    upper = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(new)).otherwise(new)
    return F.when(new.isNull(), value).when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", account).when(kind.isin("ip", "secret"), new).when(kind.isin("email", "ip6"), upper).otherwise(cased)


def _named(base: DataFrame) -> DataFrame:
    """(__key, canon, gender) of the words that a text's names are made of; gender is f, m, x (a given name) or empty."""
    names = base.select("__key", F.explode(F.regexp_extract_all("text", F.lit(NAMED), F.lit(0))).alias("t"))
    first, all_words = F.regexp_replace(F.substring_index("t", " ", 1), r"\.$", ""), F.split("t", " ")
    titled = F.when(first.isin(*TITLES["f"]), "f").when(first.isin(*TITLES["m"]), "m").when(first.isin(*TITLES["x"]), "x")
    names = names.select("__key", titled.alias("titled"), F.when(titled.isNull(), all_words).otherwise(F.slice(all_words, F.lit(2), F.size(all_words) - 1)).alias("w"))
    given = F.col("w")[0]
    known = F.when(given.isin(*GIVEN["f"].split()), "f").when(given.isin(*GIVEN["m"].split()), "m").otherwise("x")
    gender = F.when(F.col("titled").isin("f", "m"), F.col("titled")).otherwise(known)
    one = lambda w, g: F.struct(F.lower(w).alias("canon"), g.alias("gender"))
    parts = F.when(F.size("w") == 2, F.array(one(given, gender), one(F.col("w")[1], F.lit("")))).otherwise(F.array(one(given, F.lit(""))))
    return names.select("__key", F.explode(parts).alias("p")).select("__key", "p.canon", "p.gender")


def pseudonymised(docs: DataFrame, key: str, *, counted: str = "n_entities") -> DataFrame:
    """``docs`` (any columns, among them text) with its mentions of personal data replaced, and ``counted``, how many were.

    Mentions are e-mail addresses, telephone, social security and card numbers, IBANs, IPv4 and IPv6 addresses, access
    keys and passwords, and names: after a title or beginning with a common given name, with all their later mentions in
    the text. ``key`` is the secret that the surrogates are drawn with; another key gives others.

    A null text stays null and an empty one empty, with no entities; a text of any length is read whole, once; null ids
    are no matter; a text that repeats is changed alike each time; no row gives no rows. All columns are passed on; a
    column with the name of ``counted`` is replaced. Surrogates of an entity that keeps meeting others get longer in the end.
    """
    columns = [c for c in docs.columns if c != counted]
    # Rows travel as one column each, so that no name of theirs meets another. The patterns are run once: what they
    # found is written, as three plans read it.
    nothing = F.lit(None).cast("array<string>")
    keyed = docs.select("text", F.struct(*columns).alias("row")).select("row", _by_need(lambda p: F.regexp_extract_all("text", p, F.lit(0)), nothing).alias("__found"))
    keyed = written(keyed, "found").withColumn("text", F.col("row")["text"])
    some = keyed.where(F.size("__found") > 0).withColumn("__key", F.md5("text"))
    base = written(some.groupBy("__key").agg(F.first("text").alias("text"), F.first("__found").alias("found")), "texts")

    names = written(_named(base), "names")
    mentions = base.select("__key", F.posexplode("found").alias("pos", "value")).withColumn("kind", _kind())
    compact = F.when(F.col("kind").isin("phone", "ssn", "card"), _digits(F.col("value"))).when(F.col("kind") == "iban", F.regexp_replace("value", " ", ""))
    mentions = mentions.withColumn("canon", compact.when(F.col("kind").isin("ip", "secret"), F.col("value")).otherwise(F.lower("value")))
    # A capitalised word is an entity if the text names somebody so; a long number or an account, if it is a valid one.
    mentions = mentions.join(names.select("__key", "canon", F.lit(True).alias("named")).distinct(), ["__key", "canon"], "left")
    real = F.when(F.col("kind") == "word", F.col("named")).when(F.col("kind") == "card", _is_card(F.col("canon"))).when(F.col("kind") == "iban", _is_iban(F.col("canon"))).otherwise(True)
    mentions = written(mentions.withColumn("kind", F.when(real, F.col("kind"))).drop("named"), "mentions")

    entities = mentions.where("kind is not null").select("kind", "canon").distinct()
    domains = entities.where("kind = 'email'").select(F.lit("domain").alias("kind"), F.substring_index("canon", "@", -1).alias("canon"), F.lit("").alias("domain"), F.lit("").alias("gender")).distinct()
    domains = _resolved(domains, key).select(F.col("canon").alias("at"), F.col("surrogate").alias("domain"))
    votes = names.groupBy("canon").agg(*(F.count_if(F.col("gender") == g).alias(g) for g in "fmx"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").when(F.col("f") + F.col("m") + F.col("x") > 0, "x").otherwise("")
    votes = votes.select(F.lit("word").alias("kind"), "canon", gender.alias("gender"))
    placed = entities.withColumn("at", F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1))).join(domains, "at", "left").join(votes, ["kind", "canon"], "left")
    surrogates = _resolved(placed.select("kind", "canon", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("gender", F.lit("")).alias("gender")), key)

    # An entity that very many texts mention makes a skewed join, which Spark splits, as both sides are read from tables.
    new = mentions.join(written(surrogates, "surrogates"), ["kind", "canon"], "left").select("__key", "pos", _rendered().alias("new"), F.col("surrogate").isNotNull().alias("hit"))
    lists = new.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("l"), F.sum(F.col("hit").cast("long")).alias("n_entities"))
    lists = lists.where("n_entities > 0").select("__key", F.col("l.new").alias("new"), "n_entities")
    between = _by_need(lambda p: F.split(F.col("text"), p, -1), F.array(F.col("text")))
    whole = F.array_join(F.flatten(F.zip_with(between, F.col("new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = some.join(lists, "__key", "left")
    changed = changed.select("row", F.when(F.col("new").isNull(), F.col("text")).otherwise(whole).alias("text"), F.coalesce("n_entities", F.lit(0).cast("long")).alias("n_entities"))
    clean = keyed.where(F.coalesce(F.size("__found"), F.lit(0)) <= 0).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    out = clean.unionByName(changed)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns), F.col("n_entities").alias(counted))
