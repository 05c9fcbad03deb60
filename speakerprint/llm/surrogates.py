"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

Native expressions only. Entities are e-mail addresses, IPv4 addresses, phone numbers, card and account
numbers, social security numbers, hexadecimal secrets, and names after a form of address. A canonical
form joins spellings of one entity (case, separators of digits, the surname after another given name);
its surrogate is drawn from a keyed hash, and each place gets the surrogate in its own format.

* Coreference: equal canonical forms have equal surrogates in all documents.
* Distinctness: surrogates are counted per type; all but the least owner of a shared one, and owners of
  one that is itself an entity of the corpus, draw again until none is shared. Formats with too few surrogates widen as
  draws go on: names by a syllable, numbers by a digit at their end, mailboxes by a letter, octets to three digits.
* Consistency: digits stay digits and letters letters of their case at their place; phones keep the country
  code, cards the issuer digit and a valid check digit if they had one, addresses the digits of each octet;
  given names keep their gender (by the form of address) and names their script.

A null text stays null and an empty one empty; texts without entities stay as they are. Repeated rows
are treated alike. Other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import content_key, materialised

#: Fixed forms of address by gender; longer ones first where one begins another.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н")
FEMALE = ("Mrs", "Miss", "Ms", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señorita", "Señora", "Srta", "Sra", "Signora", "госпожа", "г-жа")

#: Patterns by type in order of precedence, in Java's syntax and without groups.
PATTERNS: dict[str, str] = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)".replace("([ -])", "[ -]").replace(r"\1", "[ -]"),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "name": r"(?<!\p{L})(?:" + "|".join([*FEMALE, *MALE]) + r")\.? \p{Lu}(?:\p{Ll}+|\p{Lu}+)(?:[ -]\p{Lu}(?:\p{Ll}+|\p{Lu}+))?",
}
ENTITY = "|".join(PATTERNS.values())
KEY = "surrogate-key-1"
#: Draws in an entity's own format; every second one after that widens it. Names widen with every second draw.
NARROW = 3

#: Fixed syllables that made-up names are built of, by script, and endings by gender.
SYLLABLES = {
    "latin": ("ba", "del", "fi", "gor", "he", "jul", "ka", "len", "mi", "nor", "pe", "ral", "sti", "ten", "vo", "win"),
    "cyrillic": ("ба", "дел", "фи", "гор", "ве", "жул", "ка", "лен", "ми", "нор", "пе", "рал", "сти", "тен", "во", "зин"),
}
ENDINGS = {
    ("latin", "male"): ("ert", "on", "ard", "us"), ("latin", "female"): ("ina", "ella", "ia", "etta"), ("latin", "surname"): ("son", "er", "feld", "mont"),
    ("cyrillic", "male"): ("ий", "ан", "ор", "ил"), ("cyrillic", "female"): ("ина", "ия", "ела", "ана"), ("cyrillic", "surname"): ("енко", "ич", "ин", "ук"),
}


#: Some part of every form of address.
STEMS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Sr", "Signor", "господин", "госпожа", "г-н", "г-жа")


def likely(text: Column) -> Column:
    """Whether a text can hold an entity: cheap, and true wherever ``ENTITY`` matches."""
    out = text.rlike("[0-9@]")
    for stem in STEMS:
        out = out | text.contains(stem)
    return out


def matches(text: Column) -> Column:
    """All matched strings of a text in order."""
    none = F.expr("array()").cast("array<string>")
    return F.when(likely(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def entity_type(surface: Column) -> Column:
    """Type of a matched string: the first pattern that matches all of it."""
    out = None
    for name, pattern in PATTERNS.items():
        whole = surface.rlike(f"^(?:{pattern})$")
        out = F.when(whole, F.lit(name)) if out is None else out.when(whole, F.lit(name))
    return out.otherwise(F.lit("phone"))


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that only the key, the entity and the attempt decide."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _draw(stream: str, i: str) -> str:
    """SQL of a number in [0, 255] at a place of a stream."""
    return f"cast(conv(substring({stream}, 1 + 2 * pmod({i}, 64), 2), 16, 10) as int)"


def _pick(values, stream: str, i: int) -> Column:
    return F.element_at(_array(values), F.expr(f"1 + pmod({_draw(stream, str(i))}, {len(values)})"))


def _made_name(role: str, script: str) -> Column:
    """A name of two syllables and an ending; one more syllable every second attempt."""
    s = SYLLABLES[script]
    listed = ", ".join(f"'{x}'" for x in s)
    more = F.expr(
        f"CASE WHEN attempt < 2 THEN '' ELSE array_join(transform(sequence(1, attempt div 2), k -> element_at(array({listed}), 1 + pmod({_draw('stream', '(k + 2)')}, {len(s)}))), '') END"
    )
    return F.concat(_pick(s, "stream", 0), _pick(s, "stream", 1), more, _pick(ENDINGS[script, role], "stream", 2))


def _widening(characters: str) -> str:
    """SQL of what a format is widened by: nothing for the first attempts, then one character more every second attempt."""
    drawn = f"substring('{characters}', 1 + pmod({_draw('stream', '(k + 40)')}, {len(characters)}), 1)"
    return f"CASE WHEN attempt <= {NARROW} THEN '' ELSE array_join(transform(sequence(1, (attempt - {NARROW} + 1) div 2), k -> {drawn}), '') END"


#: Sum of a digit string by Luhn's rule, and the digit that makes it a multiple of ten.
_LUHN = """aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN pmod(length({d}) - i, 2) = 0 THEN cast(substring({d}, i, 1) AS int)
 ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substring({d}, i, 1) AS int)) END)"""


def _generated() -> Column:
    """Surrogate of (kind, canon, attempt) from the column ``stream``."""
    r = _draw("stream", "i")
    digits = f"transform(split(canon, ''), (c, i) -> CASE WHEN i < fixed THEN c WHEN c BETWEEN '0' AND '9' THEN cast(pmod({r}, 10) AS string)"
    letters = f" WHEN c BETWEEN 'a' AND 'z' THEN substring('abcdefghijklmnopqrstuvwxyz', 1 + pmod({r}, 26), 1) ELSE c END)"
    plain = F.expr(f"array_join({digits}{letters}, '')")
    hexed = F.expr(f"array_join(transform(split(canon, ''), (c, i) -> substring('0123456789abcdef', 1 + pmod({r}, 16), 1)), '')")
    octet = f"""array_join(transform(split(canon, '[.]'), (c, i) -> cast(CASE WHEN attempt > {NARROW} THEN 100 + pmod({r}, 155) WHEN length(c) = 1 THEN 1 + pmod({r}, 9)
     WHEN length(c) = 2 THEN 10 + pmod({r}, 90) ELSE 100 + pmod({r}, 155) END AS string)), '.')"""
    octet = f"concat({octet}, CASE WHEN attempt <= {NARROW + 16} THEN '' ELSE concat('.', cast(100 + pmod({_draw('stream', '40')}, 155) AS string), {_widening('0123456789')}) END)"
    luhn, body = _LUHN.format(d="canon"), "substring(plain, 1, length(canon) - 1)"
    zero = f"concat({body}, '0')"
    checked = F.expr(f"CASE WHEN pmod({luhn}, 10) = 0 THEN concat({body}, cast(pmod(10 - pmod({_LUHN.format(d=zero)}, 10), 10) AS string)) ELSE plain END".replace("plain", "plain_form"))
    local = F.expr(f"concat(substring_index(plain_form, '@', 1), {_widening('abcdefghijklmnopqrstuvwxyz')}, '@', domain)")
    out = F.when(F.col("kind") == "secret", hexed).when(F.col("kind") == "ip", F.expr(octet)).when(F.col("kind") == "card", checked).when(F.col("kind") == "email", local)
    for script in SYLLABLES:
        for role in ("male", "female", "surname"):
            out = out.when(F.col("kind") == f"{role} {script}", _made_name(role, script))
    return out.otherwise(F.expr(f"concat(plain_form, {_widening('0123456789')})")), plain


def _with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) of (kind, canon, attempt)."""
    generated, plain = _generated()
    # Kept at the start: the country code of a phone or account, the issuer of a card.
    fixed = F.when(F.col("kind").startswith("phone"), F.substring_index("kind", " ", -1).cast("int")).when(F.col("kind") == "card", F.lit(1)).when(F.col("kind") == "iban", F.lit(2)).otherwise(F.lit(0))
    df = entities.withColumn("stream", _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("fixed", fixed).withColumn("plain_form", plain)
    host = F.substring_index("canon", "@", -1)
    df = df.withColumn("host_stream", _stream(key, F.lit("host"), host, F.lit(0)))
    r = _draw("host_stream", "i")
    labels = f"""array_join(transform(split(substring_index(canon, '@', -1), ''), (c, i) -> CASE
     WHEN i >= length(substring_index(canon, '@', -1)) - length(substring_index(canon, '.', -1)) THEN c
     WHEN c BETWEEN '0' AND '9' THEN cast(pmod({r}, 10) AS string) WHEN c BETWEEN 'a' AND 'z' THEN substring('abcdefghijklmnopqrstuvwxyz', 1 + pmod({r}, 26), 1)
     ELSE c END), '')"""
    df = df.withColumn("domain", F.expr(labels))
    return df.withColumn("surrogate", generated).select("kind", "canon", "attempt", "surrogate")


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate): one surrogate per entity, none shared and none an entity itself.

    ``entities`` has (kind, canon). Rounds are written to the shared folder; in each, entities whose
    surrogate is taken draw again. Few are left after the first; as their formats widen, the free surrogates outgrow any number of
    entities and the rounds end.
    """
    known = materialised(entities.select("kind", "canon").distinct(), "surrogate-entities")
    table = materialised(_with_surrogate(known.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        owners = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count(F.lit(1)).alias("c"))
        taken = known.select(F.col("kind"), F.col("canon").alias("surrogate"), F.lit(True).alias("entity"))
        bad = owners.join(taken, ["kind", "surrogate"], "left").where("c > 1 OR entity")
        lost = table.join(bad, ["kind", "surrogate"]).where(F.col("entity") | (F.col("canon") != F.col("owner.canon")))
        again = materialised(lost.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "surrogate-again")
        if again.isEmpty():
            return table.select("kind", "canon", "surrogate")
        kept = table.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti")
        table = materialised(kept.select("kind", "canon", "attempt", "surrogate").unionByName(_with_surrogate(again, key)), "surrogates")


def mentions(surfaces: DataFrame) -> DataFrame:
    """(surface, type, part, kind, canon) of distinct matched strings: the entities in them.

    A name has up to two entities: the given name (part 1 of two words) and the surname.
    """
    found = surfaces.select("surface").distinct().withColumn("type", entity_type(F.col("surface")))
    words = F.split("surface", r"[ -](?=\p{Lu})")
    female = F.col("surface").rlike("^(?:" + "|".join(FEMALE) + r")\.? ")
    script = F.when(F.element_at(words, -1).rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    gender = F.when(female, F.lit("female")).otherwise(F.lit("male"))
    given = F.struct(F.lit(1).alias("part"), F.concat_ws(" ", gender, script).alias("kind"), F.lower(F.element_at(words, 2)).alias("canon"))
    surname = F.struct(F.lit(2).alias("part"), F.concat_ws(" ", F.lit("surname"), script).alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
    alnum = F.regexp_replace(F.lower("surface"), "[^a-z0-9]", "")
    code = F.length(F.regexp_replace(F.regexp_extract("surface", r"^\+\d{1,3}(?=[ (.-])", 0), "[^0-9]", ""))
    kind = F.when(F.col("type") == "phone", F.concat_ws(" ", F.lit("phone"), code.cast("string"))).otherwise(F.col("type"))
    canon = F.when(F.col("type").isin("email", "ip"), F.lower("surface")).otherwise(alnum)
    one = F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind"), canon.alias("canon")))
    names = F.when(F.size(words) > 2, F.array(given, surname)).otherwise(F.array(surname))
    return found.select("surface", "type", F.inline(F.when(F.col("type") == "name", names).otherwise(one)))


def _rendered() -> Column:
    """The surrogate in the format of its surface: separators, case and form of address stay."""
    ordinal = "length(regexp_replace(substring(surface, 1, i + 1), '[^A-Za-z0-9]', ''))"
    spaced = f"""array_join(transform(split(surface, ''), (c, i) -> CASE WHEN c RLIKE '[0-9a-z]' THEN substring(surrogate, {ordinal}, 1)
     WHEN c RLIKE '[A-Z]' THEN upper(substring(surrogate, {ordinal}, 1)) ELSE c END), '')"""
    placed = """array_join(transform(split(surface, ''), (c, i) -> CASE WHEN c RLIKE '[A-Z]' THEN upper(substring(surrogate, i + 1, 1))
     ELSE substring(surrogate, i + 1, 1) END), '')"""
    # What a widened surrogate has beyond its surface.
    beyond = "substring(surrogate, length(regexp_replace(surface, '[^A-Za-z0-9]', '')) + 1)"
    same = F.length("surrogate") == F.length("surface")
    return F.when(F.col("type").isin("email", "ip"), F.when(same, F.expr(placed)).otherwise(F.col("surrogate"))).otherwise(F.concat(F.expr(spaced), F.expr(beyond)))


def replacements(found: DataFrame, table: DataFrame) -> DataFrame:
    """(surface, type, entities, replacement) of every matched string."""
    both = found.join(table, ["kind", "canon"])
    single = both.where("part = 0").select("surface", "type", F.lit(1).alias("entities"), _rendered().alias("replacement"))
    words = F.split("surface", r"[ -](?=\p{Lu})")
    per_name = both.where("part > 0").groupBy("surface", "type").agg(
        F.max(F.when(F.col("part") == 1, F.col("surrogate"))).alias("given"), F.max(F.when(F.col("part") == 2, F.col("surrogate"))).alias("family"), F.count(F.lit(1)).cast("int").alias("entities")
    )

    def cased(name: Column, word: Column) -> Column:
        return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(name)).otherwise(F.initcap(name))

    joint = F.when(F.col("surface").rlike(r"\p{L}-\p{Lu}"), F.lit("-")).otherwise(F.lit(" "))
    title = F.regexp_extract("surface", r"^[^ ]+", 0)
    full = F.concat(title, F.lit(" "), F.coalesce(F.concat(cased(F.col("given"), F.element_at(words, 2)), joint), F.lit("")), cased(F.col("family"), F.element_at(words, -1)))
    return single.unionByName(per_name.select("surface", "type", "entities", full.alias("replacement")))


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts. ``count`` names a column for the entities replaced.

    Matches are found once per distinct string; each text then gets a map of its own matches.
    """
    matched = docs.where(likely(F.col(text))).select(F.col(text).alias("__text"), F.explode(F.array_distinct(matches(F.col(text)))).alias("surface"))
    pairs = materialised(matched.select(content_key(F.col("__text")).alias("__key"), "surface").distinct(), "surrogate-places")
    found = materialised(mentions(pairs), "surrogate-mentions")
    table = surrogate_table(found.select("kind", "canon"), key)
    known = replacements(found, table)
    maps = pairs.join(known, "surface").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias("__map"))
    joined = docs.withColumn("__key", content_key(F.col(text))).join(maps, "__key", "left")
    parts = F.split(F.col(text), ENTITY, -1)
    hits = matches(F.col(text))
    filled = F.zip_with(parts, F.transform(hits, lambda h: F.coalesce(F.element_at("__map", h), h)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.when(F.col("__map").isNull(), F.col(text)).otherwise(F.array_join(filled, ""))
    out = joined.withColumn("__text", changed)
    columns = [F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if count:
        columns.append(F.when(F.col("__map").isNull(), F.lit(0)).otherwise(F.size(hits)).cast("bigint").alias(count))
    return out.select(*columns)
