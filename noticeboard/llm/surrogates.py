"""Personal data replaced by keyed surrogates, in SQL functions only.

Detected entities keep their type and format: letters become letters of the same script and case, digits digits, everything else
stays.  A given name of a known list becomes another of the list for its gender and script.  The replacement is a keyed permutation of
the strings of one shape (a balanced Feistel network whose rounds shift characters within their class), so different entities get
different surrogates and the same entity, however it is written, the same one everywhere, without a table of entities.  A check over
the distinct entities of the corpus finds collisions between lists and permuted strings; the key is then varied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import let
from .common import cut, unused

# fixed values: alphabets within which characters are shifted
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâäãåçèéêëìíîïñòóôöõøùúûüýÿœæß",
    "ÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝŒÆ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]

# fixed values: given names by script and gender
GIVEN = [
    ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Pierre", "Jacques", "Carlos", "Pablo", "Stefan"],
    ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Ursula", "Monika", "Camille", "Juliette", "Carmen", "Lucia", "Sophie"],
    ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей"],
    ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина"],
]

# fixed values: forms of address, which make the capitalised words after them a name
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "господин", "госпожа"]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME_WORD = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)?"
_GIVEN_WORDS = "|".join(name for names in GIVEN for name in names)
#: type -> pattern, in order of precedence
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<!\+)[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
    "name": rf"(?=[\p{{Lu}}г])(?:(?:{'|'.join(TITLES)})\.?[ ]{_NAME_WORD}(?:[ ]{_NAME_WORD}){{0,2}}|(?:{_GIVEN_WORDS})[ ]{_NAME_WORD})",
}
#: none of them begins inside a word, which is the first and cheapest thing to test
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _shift(part: Column, digest: Column) -> Column:
    """Every character moved within its alphabet by a byte of the digest; others stay."""

    def one(part: Column, digest: Column, i: Column) -> Column:
        c = F.substring(part, i, F.lit(1))
        by = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for letters in reversed(ALPHABETS):
            at = F.position(c, F.lit(letters))
            out = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    shifted = lambda p, d: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: one(p, d, i)), "")
    return F.when(F.length(part) == 0, F.lit("")).otherwise(let(part, lambda p: let(digest, lambda d: shifted(p, d))))


def permuted(value: Column, key: Column, rounds: int = 6) -> Column:
    """A keyed permutation of the strings of the shape of value."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    turn = lambda s, i: F.struct(s["r"].alias("l"), _shift(s["l"], F.sha2(F.concat_ws("|", key, i.cast("string"), s["r"]), 256)).alias("r"))
    # an even number of rounds ends with the halves where they began
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _in_format(mention: Column, plain: Column, kept: str) -> Column:
    """plain's characters in the places of mention's that match the class `kept`; the others stay."""
    places = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.substring(mention, i, F.lit(1)))
    step = lambda p: lambda s, c: F.when(
        c.rlike(kept), F.struct(F.concat(s["out"], F.substring(p, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return let(plain, lambda p: F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step(p), lambda s: s["out"]))


def _luhn(digits: Column) -> Column:
    """Check digit of a string of digits."""

    def add(total: Column, i: Column, ds: Column) -> Column:
        d = F.substring(ds, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(F.pmod(F.length(ds) - i, F.lit(2)) == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    places = lambda ds: F.sequence(F.lit(1), F.greatest(F.length(ds), F.lit(1)))
    return let(digits, lambda ds: F.pmod(-F.aggregate(places(ds), F.lit(0), lambda total, i: add(total, i, ds)), F.lit(10)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _given(word: Column, key: Column) -> Column:
    """A known given name's replacement in its own list, a keyed rotation by at least one place, or null."""
    out = F.lit(None).cast("string")
    for names in GIVEN:
        at = F.array_position(F.array(*[F.lit(n) for n in names]), word)
        by = F.pmod(F.xxhash64(key, F.lit(names[0])), F.lit(len(names) - 1)) + 1
        out = F.when(at > 0, F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(at - 1 + by, F.lit(len(names))) + 1).cast("int"))).otherwise(out)
    return out


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ssn", "iban", "ip", "email"):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(mention: Column, kind: Column) -> Column:
    """What all ways of writing an entity have in common."""
    digits = _digits(mention)
    bare = F.regexp_replace(mention, rf"^(?:{'|'.join(TITLES)})\.? ", "")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "name", bare).otherwise(mention)
    )


def surrogate(mention: Column, kind: Column, key: Column) -> Column:
    """The replacement of one mention."""
    digits = _digits(mention)
    of = lambda name, value: permuted(value, F.concat_ws("|", key, F.lit(name)))
    # the last ten digits are the number, whatever stands before them is kept
    tail = F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)
    phone = _in_format(mention, F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(tail)), of("phone", tail)), "[0-9]")
    # cards keep their first digit, and the check digit stays right (or wrong by as much)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new_body = F.concat(F.substring(body, 1, 1), of("card", F.substring(body, F.lit(2), F.length(body))))
    check = lambda b: F.pmod(_luhn(b) + F.substring(digits, -1, 1).cast("int") - _luhn(body), F.lit(10))
    card = let(new_body, lambda b: _in_format(mention, F.concat(b, check(b).cast("string")), "[0-9]"))
    plain_iban = F.regexp_replace(mention, " ", "")
    iban = _in_format(mention, F.concat(F.substring(plain_iban, 1, 2), of("iban", F.substring(plain_iban, F.lit(3), F.length(plain_iban)))), "[A-Z0-9]")
    # addresses: two 16-bit halves
    octets = F.split(mention, r"\.")
    number = lambda a, b: F.get(octets, F.lit(a)).cast("int") * 256 + F.get(octets, F.lit(b)).cast("int")
    turn = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit("ip"), i.cast("string"), s["r"].cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(65536)).cast("int").alias("r"))
    ip = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(number(0, 1).alias("l"), number(2, 3).alias("r")), turn, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("int"), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256).cast("int"), F.pmod(s["r"], F.lit(256))))
    # mail: the domain's last label stays
    low = F.lower(mention)
    at = F.position(F.lit("@"), low)
    top = F.regexp_extract(low, r"\.[^.]+$", 0)
    domain = F.substring(low, at + 1, F.length(low) - at - F.length(top))
    email = F.concat(of("local", F.substring(low, F.lit(1), at - 1)), F.lit("@"), of("domain", domain), top)
    # names: title and gender stay
    title = F.regexp_extract(mention, rf"^(?:{'|'.join(TITLES)})\.? ", 0)
    words = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    name = F.concat(title, F.array_join(F.transform(words, lambda w: F.coalesce(_given(w, key), of("name", w))), " "))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "ssn", _in_format(mention, of("ssn", digits), "[0-9]")).otherwise(name)
    )


MARK = "\ue000"  # a private-use character around mentions


def split_up(text: Column) -> Column:
    """The text as array<text before, mention, text between, mention, ..., text after>, in one pass of the patterns."""
    marked = F.split(F.regexp_replace(text, F.lit(ANY), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # a text that holds the mark itself is taken apart in two passes
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, ANY, -1), found, lambda t, m: F.when(m.isNull(), F.array(t)).otherwise(F.array(t, m))))
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)


def entities(docs: DataFrame, key: str) -> DataFrame:
    """Distinct kind, entity (in canonical form) and its surrogate (likewise) of all texts."""
    parts = docs.select(split_up(F.col("text").cast("string")).alias("p")).where("size(p) > 1")
    found = parts.select(F.explode(F.filter("p", lambda x, i: i % 2 == 1)).alias("m")).distinct().withColumn("kind", kind_of(F.col("m")))
    found = found.withColumn("s", surrogate(F.col("m"), F.col("kind"), F.lit(key)))
    return found.select("kind", canonical(F.col("m"), F.col("kind")).alias("entity"), canonical(F.col("s"), F.col("kind")).alias("surrogate")).distinct()


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """kind, surrogate, n of surrogates that stand for several entities, and kind, entity, n of entities with several surrogates."""
    found = cut(entities(docs, key))
    one = found.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n")).where("n > 1").withColumn("what", F.lit("not distinct"))
    two = found.groupBy("kind", F.col("entity").alias("surrogate")).agg(F.count_distinct("surrogate").alias("n")).where("n > 1").withColumn("what", F.lit("not coreferent"))
    return one.unionByName(two)


def free_key(docs: DataFrame, key: str, tries: int = 8) -> str:
    """The key, varied until no two entities of docs share a surrogate."""
    for i in range(tries):
        varied = key if i == 0 else f"{key}#{i}"
        if not collisions(docs, varied).limit(1).count():
            return varied
    raise ValueError("every key makes two entities share a surrogate")


def replaced(docs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """docs with text rewritten and _entities, array<kind, surrogate> in order of place; all other columns pass.

    Whole texts are rewritten, what is not an entity stays as it is.  Null texts stay null and empty ones empty, with no entities.
    Repeated rows get the same text.  An existing column _entities is replaced; other names do not matter.
    """
    key = free_key(docs, key) if check else key
    text, parts = F.col("text").cast("string"), unused("_parts", docs)
    split = docs.withColumn(parts, split_up(text))
    found = F.transform(F.filter(parts, lambda x, i: i % 2 == 1), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("mention")))
    new = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), surrogate(e["mention"], e["kind"], F.lit(key)).alias("surrogate")))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    marked = split.withColumn("_entities", F.when(F.size(parts) > 1, new).otherwise(none))
    between = F.filter(parts, lambda x, i: i % 2 == 0)
    whole = F.array_join(F.zip_with(between, F.transform(F.col("_entities"), lambda e: e["surrogate"]), lambda a, s: F.concat(a, F.coalesce(s, F.lit("")))), "")
    return marked.withColumn("text", F.when(F.size("_entities") > 0, whole).otherwise(text)).select(*[c for c in docs.columns if c != "_entities"], "_entities")
