"""Surrogates for personal data, by DataFrame functions only.

Every entity found in a text gives way to another of its kind: letters stay letters of their
script and case, digits stay digits, a card that passes its check digit goes on to do so, a
name keeps the gender its title tells. A surrogate is a function of a key and the entity, so
the same entity has the same surrogate in every text and every run with that key, whatever
way it is punctuated. Where two entities would share a surrogate, or a surrogate is itself an
entity of the texts, another attempt is made for all but the first; the few entities that
needed one are looked up, the others need no join. Later attempts make longer values, so that a
format with few of them, such as a phone number of five digits, has enough for any corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KEY = "shelfcast"
# Titles by the gender they tell.
MALE = ["Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Hr", "Monsieur", "Señor", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra",
          "Señorita", "Srta", "г-жа", "госпожа"]
NEUTRAL = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Rev", "Mx", "доктор", "д-р", "профессор", "проф"]
# Syllables and endings that names are made of, by script.
LATIN = ["ba", "be", "da", "do", "fa", "ga", "ka", "la", "le", "li", "ma", "mi", "na", "ne", "no", "ra", "re", "ro",
         "sa", "se", "ta", "te", "va", "vi"]
CYRILLIC = ["ба", "бе", "ва", "во", "га", "да", "до", "за", "ка", "ла", "ле", "ли", "ма", "ми", "на", "не", "но", "ра",
            "ре", "ро", "са", "се", "та", "те"]
CYRILLIC_INITIALS = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
ENDINGS = {"f": {"latin": "lina", "cyrillic": "лина"}, "m": {"latin": "ton", "cyrillic": "тон"},
           "n": {"latin": "ris", "cyrillic": "рис"}}
SURNAME = {"latin": "mer", "cyrillic": "мер"}


def _titles(titles: list[str]) -> str:
    """The titles as written and in capitals; MS and DR are read as titles before a dot only."""
    found = {*titles, *[t[0].upper() + t[1:] for t in titles]}
    found |= {t.upper() + ("(?=\\.)" if t in ("Ms", "Dr") else "") for t in titles}
    return "|".join(sorted(found, key=lambda t: (-len(t), t)))


TITLE = _titles([*MALE, *FEMALE, *NEUTRAL])
TITLES = rf"(?:(?:{TITLE})(?:\.?[ \xa0]|\.(?=\p{{Lu}})))"
# Of two letters at least; the 's of a genitive is not part of it. Nothing here backtracks.
NAME_WORD = r"(?=\p{Lu}['’-]?\p{L})(?!\p{Lu}['’][sS](?!\p{L}))\p{Lu}\p{L}*+(?:['’-](?![sS](?!\p{L}))\p{L}++)*+"
INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.)*+|\p{Lu}(?= \p{Lu})"
PARTICLE = "(?:von|vom|van|der|den|zu|zur|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten)"
SUFFIX = r"(?:Jr|Sr|JR|SR|II|III|IV|Esq|PhD|MD)(?!\p{L})"
NAME_PART = rf"(?!{SUFFIX})(?:{PARTICLE} ){{0,3}}(?:{NAME_WORD}|{INITIAL})"
# The word after initials may follow their dot.
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLES}{{1,6}}{NAME_PART}(?:(?: |(?<=\.)){NAME_PART})*+"
UNTITLED = rf"(?<![\p{{L}}\p{{N}}]){NAME_WORD}"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
SECRET = r"(?<![A-Za-z])(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9/+_-]{16,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z])(?!\.[0-9])"
PHONE = (r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
# The country codes that numbers start with after a plus sign.
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
ENTITY = "|".join([EMAIL, SECRET, NAME, IPV4, SSN, PHONE, CARD, IBAN])
# Every entity holds one of these, and nearly no other text does.
STARTS = "".join(sorted({t[0] for t in TITLE.split("|")}))
HINT = rf"[@0-9=:]|(?=[{STARTS}])(?:{TITLE})"
# Attempts are held as one map up to so many entities; beyond that they are joined.
MAP_ROWS = 5_000
# Only IPv4 addresses cannot grow; a corpus that holds nearly half of them would need more rounds.
ROUNDS = 512
# Attempts at the entity's own length: with under so many free characters, and with more of them.
FEW_FREE, SHORT_TRIES, LONG_TRIES = 8, 2, 32


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(entity: Column) -> Column:
    """What an entity is, from its own text."""
    return bound(entity, lambda entity: (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike("[=:]"), "secret")
        .when(entity.rlike(rf"^{TITLES}"), "name")
        .when(entity.rlike(rf"^{IPV4}$"), "ip")
        .when(entity.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(entity.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(entity.rlike("^[A-Z]"), "iban").otherwise("card")))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def parts_of(entity: Column, kind: Column | None = None) -> Column:
    """The entity, which is of ``kind`` if that is given, as a list of (kind, value): what must stay apart and what refers to the same.

    A name has a part for each piece of ``_words``: its last whole word is the surname, those
    before are given names, initials and particles have kinds of their own; the value of a number is its
    digits, with a plus sign if a country code is among them. The title, the country code of an IBAN and the field of a secret are not part of it.
    """
    return bound(entity, lambda e: bound(kind_of(e) if kind is None else kind, lambda kind: F.when(
        kind == "name", bound(_words(e), lambda words: _name_parts(e, words))).otherwise(
        F.array(_part(kind, _value(e, kind))))))


def _part(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"))


def _words(entity: Column) -> Column:
    """What follows a name's titles, cut behind each space and between initials."""
    return F.split(F.regexp_replace(entity, rf"^{TITLES}{{1,6}}", ""), r"(?<= )|(?<=\.)(?=-?\p{Lu})")


def _name_parts(entity: Column, words: Column) -> Column:
    def told(titles: list[str]) -> Column:
        return entity.rlike(rf"^{TITLES}{{0,6}}?(?:{_titles(titles)})(?![\p{{L}}-])")

    given = F.when(told(MALE), "given:m").when(told(FEMALE), "given:f").otherwise("given:n")
    kinds = bound(given, lambda given: F.transform(words, lambda w: (
        F.when(w.rlike(r"^-?\p{Lu}\.?-? ?$"), "initial").when(w.rlike(r"^\p{Ll}"), "particle").otherwise(given))))

    def parts(kinds: Column, last: Column) -> Column:
        return F.transform(words, lambda w, at: _part(
            F.when(at == last, "surname").otherwise(F.get(kinds, at)), F.lower(F.rtrim(w))))

    return bound(kinds, lambda kinds: bound(F.array_max(F.transform(
        kinds, lambda k, at: F.when(k.startswith("given"), at))), lambda last: parts(kinds, last)))


def _value(entity: Column, kind: Column) -> Column:
    """A secret is told apart by case, a number by its digits and a plus sign alone."""
    return (
        F.when(kind == "secret", _secret(entity))
        .when(kind.isin("ssn", "phone", "card"), F.regexp_replace(entity, r"[^0-9+]", ""))
        .when(kind == "iban", F.lower(F.replace(entity, F.lit(" "), F.lit("")))).otherwise(F.lower(entity)))


def _secret(entity: Column) -> Column:
    return F.regexp_extract(entity, r"([A-Za-z0-9/+_-]{16,})$", 1)


def stream(part: Column, attempt: Column, key: str) -> Column:
    """256 hexadecimal digits that the key, the part and the attempt decide."""
    seed = F.concat_ws("\u0001", F.lit(key), part["kind"], part["value"], attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{k}")), 256) for k in range(4)])


def _number(hex_: Column, at: Column) -> Column:
    """The at-th number under 65536 of a stream, which is read round."""
    return F.conv(F.substring(hex_, 1 + 4 * (at % 64), F.lit(4)), 16, 10).cast("int")


def _grown(value: Column, skip: Column, attempt: Column) -> Column:
    """How many characters an attempt adds: none until those at the value's own length are used up."""
    free = F.length(F.regexp_replace(value, r"[^\p{L}0-9]", "")) - skip
    return F.greatest(F.lit(0), attempt - F.when(free < FEW_FREE, SHORT_TRIES).otherwise(LONG_TRIES))


def like(value: Column, hex_: Column, attempt: Column, skip: Column | int = 0, more: str = "digits") -> Column:
    """Each digit and letter after the first ``skip`` ones replaced by one of its class; the
    rest as it is. Letters in hexadecimal, in either case, stay so. Late attempts add digits or
    letters, as ``more`` says, at the end."""
    skip = F.lit(skip) if isinstance(skip, int) else skip

    def of_class(c: Column, v: Column, only_hex: Column) -> Column:
        return (
            F.when(only_hex, F.substring(
                F.when(c.rlike("[A-Z]"), "0123456789ABCDEF").otherwise("0123456789abcdef"), v % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike(r"\p{Ll}"), F.char(97 + v % 26)).otherwise(F.char(65 + v % 26)))

    def made(hex_: Column, skip: Column, only_hex: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            kept = ~c.rlike(r"[\p{L}0-9]")
            new = F.when(kept | (acc["n"] < skip), c).otherwise(
                bound(_number(hex_, acc["n"]), lambda v: of_class(c, v, only_hex)))
            return F.struct(F.concat(acc["s"], new).alias("s"), (acc["n"] + F.when(kept, 0).otherwise(1)).alias("n"))

        def ended(acc: Column, grown: Column) -> Column:
            added = F.transform(F.sequence(F.lit(1), grown), lambda k: bound(
                _number(hex_, acc["n"] + k - 1), lambda v: of_class(F.lit("0" if more == "digits" else "a"), v, only_hex)))
            return F.when(grown > 0, F.concat(acc["s"], F.array_join(added, ""))).otherwise(acc["s"])

        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
        return F.aggregate(F.split(value, ""), start, step, lambda acc: bound(
            _grown(value, skip, attempt), lambda grown: ended(acc, grown)))

    only_hex = F.lit(more == "letters") & value.rlike("^[0-9A-Fa-f]*[A-Fa-f][0-9A-Fa-f]*$")
    return bound(hex_, lambda h: bound(F.coalesce(skip, F.lit(0)), lambda k: bound(only_hex, lambda x: made(h, k, x))))


def _name_word(word: Column, kind: Column, hex_: Column, attempt: Column) -> Column:
    """A made-up name of the word's script, in its case, with the ending of its gender.

    Four syllables, and two more with each attempt up to twelve.
    """
    def made(h: Column, script: str, syllables: list[str]) -> Column:
        listed = F.array(*[F.lit(s) for s in syllables])
        places = F.sequence(F.lit(0), 3 + 2 * F.least(attempt, F.lit(4)))
        body = F.array_join(F.transform(places, lambda k: F.element_at(listed, _number(h, k) % len(syllables) + 1)), "")
        end = F.when(kind == "given:f", ENDINGS["f"][script]).when(kind == "given:m", ENDINGS["m"][script]).when(
            kind == "given:n", ENDINGS["n"][script])
        return F.concat(body, end.otherwise(SURNAME[script]))
    found = bound(hex_, lambda h: F.when(word.rlike(r"\p{IsCyrillic}"), made(h, "cyrillic", CYRILLIC)).otherwise(
        made(h, "latin", LATIN)))
    return bound(found, lambda name: F.when(word == F.upper(word), F.upper(name)).otherwise(F.initcap(name)))


def _name_piece(piece: Column, part: Column, hex_: Column, attempt: Column) -> Column:
    """A piece of ``_words`` with its name or initial replaced; particles stay."""
    def initial(h: Column) -> Column:
        letter = F.when(piece.rlike(r"\p{IsCyrillic}"), F.substring(
            F.lit(CYRILLIC_INITIALS), _number(h, F.lit(0)) % len(CYRILLIC_INITIALS) + 1, F.lit(1))).otherwise(
            F.char(65 + _number(h, F.lit(0)) % 26))
        return F.regexp_replace(piece, F.lit(r"\p{Lu}"), letter)

    def word(bare: Column) -> Column:
        tail = F.when(piece.endswith(" "), " ").otherwise("")
        return F.concat(_name_word(bare, part["kind"], hex_, attempt), tail)

    return F.when(part["kind"] == "particle", piece).when(part["kind"] == "initial", bound(hex_, initial)).otherwise(
        bound(F.rtrim(piece), word))


def _passes(card: Column) -> Column:
    return F.call_function("luhn_check", _digits(card))


def _checked(value: Column, of: Column) -> Column:
    """A card number's last digit set so that it passes its check, if the given one does."""
    def with_check(value: Column) -> Column:
        head = F.regexp_replace(value, "[0-9]$", "")
        return F.element_at(F.filter(F.transform(
            F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), _passes), 1)

    return bound(value, lambda v: F.when(_passes(of), with_check(v)).otherwise(v))


def _ip(hex_: Column) -> Column:
    def made(h: Column) -> Column:
        octets = [(223, 1), (256, 0), (256, 0), (254, 1)]
        return F.concat_ws(".", *[(_number(h, F.lit(k)) % n + low).cast("string") for k, (n, low) in enumerate(octets)])
    return bound(hex_, made)


def _email(entity: Column, hex_: Column, attempt: Column, key: str) -> Column:
    """Local part like the given one; the host follows from the given host alone."""
    def made(at: Column) -> Column:
        host = _part(F.lit("host"), F.lower(F.substring(entity, at + 1, F.length(entity))))
        name = bound(host, lambda h: F.substring(stream(h, F.lit(0), key), 1, 8))
        return F.concat(like(F.substring(entity, F.lit(1), at - 1), hex_, attempt, more="letters"), F.lit("@"),
                        F.translate(name, "0123456789", "ghijklmnop"), F.lit(".example"))
    return bound(F.instr(entity, "@"), made)


def surrogate(entity: Column, attempt: Callable[[Column], Column], key: str) -> Column:
    """An entity's surrogate in the entity's own format; ``attempt`` maps a part to its attempt."""
    def hex_of(part: Column) -> Column:
        return bound(part, lambda p: stream(p, attempt(p), key))

    def made(e: Column, kind: Column, parts: Column) -> Column:
        one, tried = hex_of(parts[0]), attempt(parts[0])
        names = F.zip_with(_words(e), parts, lambda w, p: _name_piece(w, p, hex_of(p), attempt(p)))
        title = F.regexp_extract(e, rf"^({TITLES}{{1,6}})", 1)
        secret = bound(_secret(e), lambda s: F.concat(
            F.substring(e, F.lit(1), F.length(e) - F.length(s)), like(s, one, tried, more="letters")))
        return (
            F.when(kind == "email", _email(e, one, tried, key)).when(kind == "secret", secret)
            .when(kind == "name", F.concat(title, F.array_join(names, ""))).when(kind == "ip", _ip(one))
            .when(kind == "phone", like(e, one, tried, F.length(
                F.regexp_extract(parts[0]["value"], COUNTRY_CODE, 1))))
            .when(kind == "iban", like(e, one, tried, 2)).when(kind == "card", _checked(like(e, one, tried), e))
            .otherwise(like(e, one, tried)))

    return bound(entity, lambda e: bound(kind_of(e), lambda kind: bound(parts_of(e), lambda parts: made(e, kind, parts))))


def _untitled(gap: Column, names: Column, attempt: Callable[[Column], Column], key: str) -> Column:
    """Text between entities with every word that is one of ``names``, as parts, replaced."""
    def new(w: Column) -> Column:
        return bound(F.get(F.filter(names, lambda p: p["value"] == F.lower(w)), 0), lambda p: F.when(
            p.isNull(), w).otherwise(_name_word(w, p["kind"], bound(p, lambda p: stream(p, attempt(p), key)), attempt(p))))

    words = F.transform(F.regexp_extract_all(gap, F.lit(UNTITLED), F.lit(0)), new)
    return F.array_join(F.zip_with(F.split(gap, UNTITLED, -1), F.concat(words, F.array(F.lit(""))),
                                   lambda between, w: F.concat(between, w)), "")


def _names_in(entities: Column) -> Column:
    """The name parts of a text's entities; a word that is a surname and a given name is first the surname."""
    parts = F.array_distinct(F.flatten(F.transform(F.filter(
        entities, lambda e: e.rlike(rf"^{TITLES}")), lambda e: parts_of(e, F.lit("name")))))
    return F.concat(F.filter(parts, lambda p: p["kind"] == "surname"),
                    F.filter(parts, lambda p: p["kind"].startswith("given")))


def entities_of(text: Column) -> Column:
    """All entities of a text in order; a text without any hint of one is searched no further."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


# --- entities that need another attempt ---------------------------------------------------


def attempts_needed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``kind``, ``value``, ``attempt`` of the entities whose first surrogate will not do.

    Entities are made distinct with map-side combine, so one that every text holds is a row
    per task. Each round looks for surrogates that another entity has, or that are entities
    themselves, and gives the later entity a new attempt; a round without any ends it.
    """
    found = docs.select(F.explode(entities_of(F.col(f"`{text}`"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)))
    # One spelling of each entity decides; its other spellings differ in punctuation or case.
    rows = found.select("entity", F.explode(parts_of(F.col("entity"))).alias("part")).groupBy("part").agg(
        F.min("entity").alias("entity")).select("part.kind", "part.value", "entity", F.lit(0).alias("attempt"))
    # Initials stand for many names and may be alike, particles stay.
    rows = rows.filter("kind NOT IN ('initial', 'particle')")
    rows = shared.written(rows, "entities")
    for _ in range(ROUNDS):
        new = surrogate(F.col("entity"), _own_attempt, key)
        # A longer value may not look like its kind any more, so the kind is the entity's.
        own = F.array_position(parts_of(F.col("entity")), _part(F.col("kind"), F.col("value"))).cast("int")
        made = rows.select("kind", "value", F.element_at(parts_of(new, kind_of(F.col("entity"))), own)["value"].alias("new"))
        made = shared.written(made, "surrogates")
        first = made.groupBy("kind", "new").agg(F.min("value").alias("first"))
        real = rows.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        bad = made.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left").filter(
            "first <> value OR coalesce(real, false)")
        bad = shared.written(bad.select("kind", "value", F.lit(1).alias("more")), "again")
        if bad.isEmpty():
            return rows.filter("attempt > 0").select("kind", "value", "attempt")
        rows = shared.written(rows.join(bad, ["kind", "value"], "left").select(
            "kind", "value", "entity", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    raise ValueError("surrogates stay alike after every attempt; there are too few IPv4 addresses")


def _own_attempt(part: Column) -> Column:
    own = (part["kind"] == F.col("kind")) & (part["value"] == F.col("value"))
    return F.when(own, F.col("attempt")).otherwise(0)


def _name(part: Column) -> Column:
    return F.concat(part["kind"], F.lit("\u0001"), part["value"])


def with_attempts(docs: DataFrame, text: str, attempts: DataFrame, out: str) -> DataFrame:
    """The documents with column ``out``: attempts by part name, null where no part needs one.

    Up to ``MAP_ROWS`` attempts are one value that every task has; more are joined to the
    documents that hold such entities, by the text's hash, which copies of a text share.
    """
    named = attempts.select(_name(F.struct("kind", "value")).alias("k"), F.col("attempt").alias("v"))
    pairs = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    if attempts.limit(MAP_ROWS + 1).count() <= MAP_ROWS:
        return docs.withColumn(out, named.agg(pairs).scalar())
    body = shared.free_name(docs.columns, "body")
    parts = F.explode(F.array_distinct(F.flatten(F.transform(entities_of(F.col(f"`{text}`")), lambda e: parts_of(e)))))
    held = docs.select(F.xxhash64(f"`{text}`").alias(body), parts.alias("part"))
    own = held.select(body, _name(F.col("part")).alias("k")).distinct().join(named, "k").groupBy(body).agg(pairs.alias(out))
    return docs.withColumn(body, F.xxhash64(f"`{text}`")).join(own, body, "left").drop(body)


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY, entities: str | None = None) -> DataFrame:
    """The documents with every entity of ``text`` replaced and all columns kept.

    ``entities`` names a further column for the list of entities found; it must be free.
    Words of a titled name are replaced wherever the same text repeats them without a title, in
    capitals or with a capital; the list has the titled name only.
    Texts without entities, null and empty ones come back as they are (their list is empty).
    Repeated rows get the same surrogates. ``n_chars``, if there is one, follows the text.
    """
    taken = [c for c in docs.columns if c != "n_chars"]
    if entities and shared.free_name(taken, entities) != entities:
        raise ValueError(f"{entities} is a column of the documents")
    tries, found, names, some = (shared.free_name(docs.columns, n) for n in ("attempts", "entities", "names", "some"))
    source = F.col(f"`{text}`")
    ready = with_attempts(docs, text, attempts_needed(docs, text, key), tries)

    def attempt(part: Column) -> Column:
        return F.coalesce(F.try_element_at(tries, _name(part)), F.lit(0))

    ready = ready.withColumn(found, F.coalesce(entities_of(source), F.array().cast("array<string>")))
    new = F.transform(found, lambda e: surrogate(e, attempt, key))
    ready = ready.withColumn(names, _names_in(F.col(found)))
    between = F.split(source, ENTITY, -1)
    between = F.when(F.size(names) > 0, F.transform(
        between, lambda gap: _untitled(gap, F.col(names), attempt, key))).otherwise(between)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda gap, e: F.concat(gap, e)), "")
    any_found = F.size(found) > 0
    columns = [F.when(any_found, joined).otherwise(source).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    out = ready.select(*columns, F.col(found), any_found.alias(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(some), F.char_length(source).cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(found).alias(entities)] if entities else []))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten text of every document with the kinds of its entities in order."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, entities="_entities").select(
        "doc_id", "text", F.size("_entities").alias("n_entities"),
        F.array_join(F.transform("_entities", kind_of), ",").alias("kinds"))
