"""Surrogate generation: detected personal data and secrets get keyed replacements of the same type and format.

Detection is by patterns: e-mail addresses, telephone numbers, card numbers, network addresses, bank
account numbers, secret tokens, and names after a form of address.  Entities are compared in a canonical
form (digits alone, lower case), so every mention of an entity gets the same surrogate, whatever its
spelling, in every document: a telephone number with and without its country code is one entity, and a name is
replaced word by word, so "Mr John Smith" and "Mr Smith" share their last word afterwards too.  In a document with
names, words in capitals that repeat a word of one of them without the form of address are replaced alike
(where forms of address of several genders precede it there, as the female, then the male, then the neutral one).

A surrogate is drawn by a keyed permutation of all texts of the entity's own format: digits become digits, vowels
vowels and consonants consonants of the same script, and what else there is stays.  It is a Feistel
network over the characters: in turn, those at even and at odd places move on within their alphabet by what a hash of
the others says.  A permutation gives no two entities one surrogate.  Names keep their gender: a last vowel that tells it stays,
and no other last letter becomes one.  Card numbers keep what their check digit says; telephone numbers keep their country code, accounts
their country, addresses their last part.  Each mention keeps its own punctuation, grouping and case.

No surrogate may equal an entity that occurs.  Who meets one, or a place that is taken, walks on by another step of the permutation;
all who still walk have taken the same number of steps, so no two of them meet.  After STEPS steps, which
only formats can need that are full of entities, letters of both kinds (in addresses digits as well) are mixed, and the walk starts again. Only an
entity that finds no place there either, where most of a whole format occurs, gets a surrogate that is 24 characters longer.

Only documents with entities are joined; the others are copied.  An entity may occur in a third of all
documents: entities are made distinct with a map-side step, and mentions stay on the side of the join that
can be split.  What comes back to a document is bounded by its own mentions.

Defined results: null and empty texts stay as they are; repeated rows are treated alike; an empty table
gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake.llm.columns import fresh, let
from sandboxlake.session import settle

STEPS = 8  # of the walk, in each of two permutations
TURNS = 6  # of the network
DEFAULT_KEY = "surrogates-1"

# Forms of address by gender, and what each type looks like. Order decides where patterns overlap.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A word in capitals that may repeat a name; never the beginning of an address.
WORD = r"(?<![\p{L}])\p{Lu}\p{L}+(?![\p{L}0-9])(?![A-Za-z0-9._%+\-]*@)"
ANY_OR_WORD = f"{ANY}|(?:{WORD})"
_TITLE = rf"^(?:{TITLES})\.? "
_COUNTRY = r"^\+[0-9]{1,3}(?=[ .\-(])"
_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = (("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"), ("αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ"))
GENDERED = "aoаяα"  # last letters that tell the gender of a name


def _type_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(F.regexp_like(entity, F.lit(f"^(?:{p})$")), F.lit(name)) for name, p in PATTERNS.items()])


def _gender(mention: Column) -> Column:
    def of(titles: tuple[str, ...]) -> Column:
        return F.regexp_like(mention, F.lit(rf"^(?:{'|'.join(titles)})\.? "))

    return F.when(of(FEMALE), "f").when(of(MALE), "m").otherwise("n")


def canonical(kind: Column, entity: Column) -> Column:
    """The forms in which mentions of one entity agree: one, or for a name one per word, behind the gender of its form of address."""
    digits = F.regexp_replace(F.regexp_replace(entity, _COUNTRY, ""), "[^0-9]", "")
    words = F.split(F.lower(F.regexp_replace(entity, _TITLE, "")), " ")
    one = F.when(kind.isin("card", "phone"), digits).when(kind == "iban", F.lower(F.regexp_replace(entity, " ", ""))).otherwise(F.lower(entity))
    return F.when(kind == "name", F.transform(words, lambda w: F.concat(_gender(entity), F.lit("/"), w))).otherwise(F.array(one))


def _alphabet(kind: Column, c: Column, last: Column, wide: bool) -> Column:
    """The letters among which a character moves; the same for all of them, so that the format stays. Empty for what stays."""
    out = F.when(kind == "secret", F.lit(_HEX))
    if wide:
        out = out.when((kind == "email") & F.contains(F.lit(_LATIN + _DIGITS), c), F.lit(_LATIN + _DIGITS))
    out = out.when(F.contains(F.lit(_DIGITS), c), F.lit(_DIGITS))
    for classes in SCRIPTS:
        for letters in ["".join(classes)] if wide else classes:
            inner = F.when(last & (kind == "name"), F.lit("".join(x for x in letters if x not in GENDERED))).otherwise(F.lit(letters))
            out = out.when(F.contains(F.lit(letters), c), inner)
    return out.otherwise(F.lit(""))


def _luhn_digit(body: Column) -> Column:
    """The check digit behind the digits of a card number."""
    values = F.transform(F.split(F.reverse(body), ""), lambda c, i: let(c.try_cast("int") * (2 - i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def permuted(key: str, kind: Column, at: Column, wide: bool = False) -> Column:
    """A keyed permutation of the canonical forms of one kind and format."""
    n = F.length(at)
    before_check = F.substr(at, F.lit(1), n - 1)
    parts = F.when(kind == "ip", F.split(at, r"\.")).when(kind == "card", F.split(before_check, "")).otherwise(F.split(at, ""))
    kept = F.when(kind.isin("name", "iban"), F.lit(2)).when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    end = F.when(kind == "email", n - F.length(F.substring_index(at, ".", -1))).otherwise(n)

    def turn(a: Column, r: Column) -> Column:
        def moves(i: Column) -> Column:
            return F.pmod(i + r, F.lit(2)) == 0

        others = F.array_join(F.transform(a, lambda c, i: F.when(moves(i), F.lit("")).otherwise(c)), "\u0001")
        seed = F.sha2(F.concat_ws("\u0000", F.lit(key), F.lit(str(wide)), kind, r.cast("string"), others), 512)

        def moved(c: Column, i: Column, h: Column) -> Column:
            by = F.conv(F.substr(h, F.pmod(2 * i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")

            def along(letters: Column) -> Column:
                place = F.instr(letters, c)
                return F.when(place == 0, c).otherwise(F.substr(letters, F.pmod(place - 1 + by, F.greatest(F.length(letters), F.lit(1))) + 1, F.lit(1)))

            octet = F.pmod(c.try_cast("int") + by, F.lit(256)).cast("string")
            return F.when(~moves(i), c).when(kind == "ip", octet).when((i < kept) | (i >= end), c).otherwise(let(_alphabet(kind, c, i == n - 1, wide), along))

        return let(seed, lambda h: F.transform(a, lambda c, i: moved(c, i, h)))

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), parts, turn)

    def checked(a: Column) -> Column:
        whole = F.array_join(a, "")
        digit = F.pmod(F.substr(at, n, F.lit(1)).try_cast("int") - _luhn_digit(before_check) + _luhn_digit(whole), F.lit(10)).cast("string")
        return F.when(kind == "card", F.concat(whole, digit)).when(kind == "ip", F.array_join(a, ".")).otherwise(whole)

    return let(drawn, checked)


def _filled(mention: Column, drawn: Column, kinds: str) -> Column:
    """``mention`` with its characters of a class replaced, one after the other, by those of ``drawn``, in its own case."""
    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), f"[^{kinds}]", ""))
        new = F.substr(drawn, before + 1, F.lit(1))
        return F.when(F.regexp_like(c, F.lit(f"[{kinds}]")), F.when(c != F.lower(c), F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(F.split(mention, ""), place), "")


def rendered(kind: Column, mention: Column, canon: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention; that of a word of a name is put into its mentions later."""
    country = F.regexp_extract(mention, _COUNTRY, 0)
    return (
        F.when((kind == "name") | (kind == "ip") | (F.length(canon) != F.length(surrogate)), surrogate)
        .when(kind == "card", _filled(mention, surrogate, "0-9"))
        .when(kind == "phone", F.concat(country, _filled(F.substr(mention, F.length(country) + 1), surrogate, "0-9")))
        .when(kind == "iban", _filled(mention, surrogate, "0-9A-Za-z"))
        .otherwise(_filled(mention, surrogate, r"\s\S"))
    )


def assign(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon); no two surrogates of a kind agree, and none is an entity."""
    pending, done = settle(entities.select("kind", "canon")), []
    real = pending.select(F.col("kind").alias("_k"), F.col("canon").alias("_s"))
    kind, names = F.col("kind"), ("kind", "canon", "surrogate")
    for wide in (False, True):
        walking = pending.withColumn("surrogate", F.col("canon"))
        for _ in range(STEPS):
            at = walking.select("kind", "canon", permuted(key, kind, F.col("surrogate"), wide).alias("surrogate"))
            taken = reduce(DataFrame.unionByName, [d.select(F.col("kind").alias("_k"), F.col("surrogate").alias("_s")) for d in done], real)
            known = taken.withColumn("_met", F.lit(True))
            met = settle(at.join(known, (kind == F.col("_k")) & (F.col("surrogate") == F.col("_s")), "left").select(*names, "_met"))
            done.append(met.filter("_met IS NULL").select(*names))
            walking = met.filter("_met").select(*names)
            if walking.isEmpty():
                return reduce(DataFrame.unionByName, done)
        pending = walking.select("kind", "canon")
    more = F.sha2(F.concat_ws("/", F.lit(key), kind, F.col("canon")), 256)
    letters = F.substring(F.translate(more, _HEX, "bcdfghjklmnprstv"), 1, 24)
    digits = F.substring(F.translate(more, "abcdef", "271809"), 1, 24)
    longer = F.when(kind == "name", F.concat(F.substring("canon", 1, 2), letters, F.substr(F.col("canon"), F.lit(3))))
    longer = longer.when(kind == "email", F.concat(letters, F.col("canon"))).otherwise(F.concat(F.col("canon"), digits))
    return reduce(DataFrame.unionByName, done, pending.withColumn("surrogate", longer))


def replace_entities(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; ``counted`` names a column for the number of mentions replaced."""
    names = {n: fresh(n, docs.columns) for n in ("row", "mentions", "table", "named", "of_row")}
    row, mentions, table, named = (F.col(names[n]) for n in ("row", "mentions", "table", "named"))
    content = F.col(f"`{text}`")
    found = docs.withColumn(names["mentions"], F.regexp_extract_all(content, F.lit(ANY), F.lit(0)))
    has = F.coalesce(F.regexp_like(content, F.lit(ANY)), F.lit(False))
    hits = settle(found.filter(has).withColumn(names["row"], F.monotonically_increasing_id()))
    spelled = hits.select(row.alias("of_row"), F.explode(F.array_distinct(mentions)).alias("mention")).withColumn("kind", _type_of(F.col("mention")))
    kind, mention, canon = F.col("kind"), F.col("mention"), F.col("canon")
    listed = spelled.filter(kind.isNotNull()).select("of_row", "mention", "kind", F.explode(canonical(kind, mention)).alias("canon"))
    listed = settle(listed.withColumn("mention", F.when(kind == "name", canon).otherwise(mention)).distinct())
    drawn = settle(assign(listed.select("kind", "canon").distinct(), key))
    known = listed.join(drawn, ["kind", "canon"])
    entry = F.struct(mention, rendered(kind, mention, canon, F.col("surrogate")))
    by_row = known.groupBy(F.col("of_row").alias(names["of_row"])).agg(
        F.map_from_entries(F.collect_list(entry)).alias(names["table"]), F.bool_or(kind == "name").alias(names["named"])
    )

    def of_word(word: Column, genders: Column) -> Column:
        """What a word of a name becomes, in its own case; null for other words."""
        low = F.lower(word)
        to = F.coalesce(*[F.when(F.contains(genders, F.lit(g)), F.try_element_at(table, F.concat(F.lit(f"{g}/"), low))) for g in "fmn"])
        return let(F.substr(to, F.lit(3)), lambda t: F.when(F.length(t) == F.length(word), _filled(word, t, r"\p{L}")).otherwise(F.initcap(t)))

    def of_mention(m: Column) -> Column:
        title = F.regexp_extract(m, _TITLE, 0)
        words = F.transform(F.split(F.substr(m, F.length(title) + 1), " "), lambda w: F.coalesce(of_word(w, _gender(m)), w))
        return F.coalesce(F.try_element_at(table, m), F.when(title != "", F.concat(title, F.array_join(words, " "))), F.when(named, of_word(m, F.lit("fmn"))))

    joined = hits.join(by_row, row == F.col(names["of_row"]), "left")
    whole_words = F.when(named, F.regexp_extract_all(content, F.lit(ANY_OR_WORD), F.lit(0))).otherwise(mentions)
    joined = joined.withColumn(names["mentions"], F.transform(whole_words, lambda m: F.struct(m.alias("old"), of_mention(m).alias("new"))))
    between = F.when(named, F.split(content, ANY_OR_WORD, -1)).otherwise(F.split(content, ANY, -1))
    new = F.transform(mentions, lambda m: F.coalesce(m["new"], m["old"]))
    whole = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    number = [F.size(F.filter(mentions, lambda m: m["new"].isNotNull())).cast("long").alias(counted)] if counted else []
    changed = joined.select(*[(whole if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns], *number)
    zero = [F.lit(0).cast("long").alias(counted)] if counted else []
    return changed.unionByName(docs.filter(~has).select(*[F.col(f"`{c}`") for c in docs.columns], *zero))
