"""Personal data replaced by surrogates of the same kind.

E-mail addresses, IPv4 addresses, telephone, card and social-security numbers, and names after a title are found by one pattern.  Each
distinct entity of the corpus gets one surrogate, made from a keyed SHA-512: digits stay digits in the same layout, a card
number which passes the Luhn check still does, the octets of an address stay below 255, an e-mail keeps the shape of its local
part, and a name takes one of the same gender and script.  So an entity is the same wherever it is mentioned, in any layout.
Given names and surnames are entities of their own, so whoever bears a surname has the same new one, with given names or without.

Surrogates are checked: of two entities with one surrogate, or where a surrogate is itself an entity of the corpus, the
later ones are drawn again until all differ.  Entities are reduced to distinct ones before they are shuffled, and only the texts which
have any are joined with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written, free_name, let

TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
}
#: Given names by gender and script.
GIVEN = {
    "m_latin": ("Adrian", "Bruno", "Colin", "Dario", "Edgar", "Felix", "Gilbert", "Hugo", "Ivo", "Jonas", "Konrad", "Lorenz", "Marco", "Nils", "Oscar", "Pascal"),
    "f_latin": ("Alma", "Bianca", "Clara", "Dora", "Elsa", "Fiona", "Greta", "Helena", "Irene", "Julia", "Katia", "Livia", "Marta", "Nora", "Olga", "Paula"),
    "m_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"),
    "f_cyrillic": ("Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"),
}
SYLLABLES = {
    "latin": tuple(c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "r", "s", "t", "v", "w", "br", "st", "tr") for v in "aeiou"),
    "cyrillic": tuple(c + v for c in "бвгдзклмнпрстфхш" for v in "аеиоу"),
}
_TITLE = "|".join(t for titles in TITLES.values() for t in sorted(titles, key=len, reverse=True))
#: A capitalised word, of several parts with hyphens or apostrophes.
_WORD = r"\p{Lu}\p{L}+(?:['’-]\p{L}+)*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERN = "|".join((
    r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    r"\+[0-9]{1,3} ?\([0-9]{1,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])",
    r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    r"(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![\p{L}0-9.])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\p{L}0-9])",
    r"(?<![\p{L}0-9.])[0-9]{13,19}(?![\p{L}0-9])",
    rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: (?!(?:{_TITLE})\.? ){_WORD})*",
))
KINDS = ("email", "ip", "phone", "ssn", "card", "name")
#: Draws for an entity.  Names and e-mail addresses have more to draw from at each of them; numbers have only as many digits as they have.
ROUNDS = 60


def kind_of(value: Column) -> Column:
    return (
        F.when(F.contains(value, F.lit("@")), "email").when(value.rlike(r"^\p{L}"), "name").when(value.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").otherwise("card")
    )


def entity_of(value: Column, kind: Column) -> Column:
    """What all layouts of one entity have in common; names are led by gender and script."""
    digits, bare = F.regexp_replace(value, "[^0-9]", ""), F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", "")
    gender = F.when(value.rlike(rf"^(?:{'|'.join(TITLES['m'])})\.? "), "m").otherwise("f")
    script = F.when(bare.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (
        F.when(kind == "email", F.lower(value)).when(kind == "ip", value)
        .when(kind == "name", F.concat(gender, F.lit("_"), script, F.lit(" "), F.lower(bare))).otherwise(digits)
    )


def _stream(key: str, parts: list[Column], length: Column) -> Column:
    """Hex digits, three for each of ``length`` places."""
    seed = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    block = lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 512)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 42).cast("int")), block), "")


def _draw(stream: Column, place: Column, of: int) -> Column:
    """A number below ``of`` for a place, from 0."""
    return F.pmod(F.conv(F.substring(stream, place * 3 + 1, F.lit(3)), 16, 10).cast("int"), F.lit(of))


def _pick(options: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), number)


def _shaped(value: Column, stream: Column) -> Column:
    """Letters and digits of a string replaced, everything else as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        letter = F.substring(F.lit(letters), _draw(stream, i, 26) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _digits(entity: Column, stream: Column, keep: int = 0) -> Column:
    """Other digits, as many; the first ``keep`` stay, and the second one drawn is not a leading zero."""
    place = F.sequence(F.lit(1), F.length(entity))
    one = lambda i: F.when(i <= keep, F.substring(entity, i, F.lit(1))).when(i == 1, (_draw(stream, i, 9) + 1).cast("string")).otherwise(_draw(stream, i, 10).cast("string"))
    return F.array_join(F.transform(place, one), "")


def _card(entity: Column, stream: Column) -> Column:
    def checked(drawn: Column) -> Column:
        body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        last = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
        return F.when(luhn_sum(entity) % 10 == 0, F.concat(body, last.cast("string"))).otherwise(drawn)

    return let(_digits(entity, stream), checked)


def surrogate_of(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    """The surrogate of an entity, in the form of ``entity_of`` and ``name_parts``, at the given attempt."""
    stream = _stream(key, [kind, entity, F.lit(attempt)], F.greatest(F.length(entity) + 1, F.lit(40)))

    def made(s: Column) -> Column:
        local = F.substring_index(entity, "@", 1)
        number = F.pmod(F.conv(F.substring(F.sha2(s, 256), 1, 12), 16, 10).cast("bigint"), F.lit(100 * 10 ** min(attempt, 9)))
        site = F.concat(F.lit("mail"), number.cast("string"), F.lit(".example.org"))
        octets = F.concat_ws(".", *[(_draw(s, F.lit(i), 254) + 1).cast("string") for i in range(4)])
        return (
            F.when(kind == "email", F.concat(_shaped(local, s), F.lit("@"), site)).when(kind == "ip", octets)
            .when(kind == "card", _card(entity, s)).when(kind == "phone", _digits(entity, s, 1))
            .when(kind == "given", _given(entity, s, attempt)).when(kind == "surname", _surname(entity, s, attempt)).otherwise(_digits(entity, s))
        )

    return let(stream, made)


def _given(entity: Column, stream: Column, attempt: int) -> Column:
    """Gender and script, then a given name of both; at later attempts one of several parts."""
    head, new = F.substring_index(entity, " ", 1), F.lit(None)
    for group, names in GIVEN.items():
        parts = F.array(*[_pick(names, _draw(stream, F.lit(i), len(names))) for i in range(min(attempt, 5) + 1)])
        new = F.when(head == group, F.lower(F.array_join(parts, "-"))).otherwise(new)
    return F.concat_ws(" ", head, new)


def _surname(entity: Column, stream: Column, attempt: int) -> Column:
    """A script, then a surname of its syllables; more of them at later attempts."""
    script, places = F.substring_index(entity, " ", 1), range(3 + min(attempt // 3, 5))
    built = {name: F.concat(*[_pick(options, _draw(stream, F.lit(i), len(options))) for i in places]) for name, options in SYLLABLES.items()}
    return F.concat_ws(" ", script, F.when(script == "cyrillic", built["cyrillic"]).otherwise(built["latin"]))


def name_parts(entity: Column) -> Column:
    """(kind, entity) of the words of a name: given names with gender and script, and the surname, the last one, with its script."""
    head, words = F.substring_index(entity, " ", 1), F.slice(F.split(entity, " "), F.lit(2), F.size(F.split(entity, " ")))
    last = F.size(words) - 1
    return F.transform(words, lambda w, i: F.struct(
        F.when(i == last, "surname").otherwise("given").alias("kind"),
        F.concat_ws(" ", F.when(i == last, F.substring_index(head, "_", -1)).otherwise(head), w).alias("entity"),
    ))


def _capital(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "-"), F.initcap), "-")


def written(value: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the layout of the value it stands for."""
    chars = F.sequence(F.lit(1), F.length(value))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        digit = c.rlike("[0-9]")
        put = F.when(digit, F.substring(surrogate, acc["used"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], put).alias("out"), (acc["used"] + F.when(digit, 1).otherwise(0)).alias("used"))

    laid = F.aggregate(chars, zero, step, lambda acc: acc["out"])
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    bare = F.substring(value, F.length(title) + 1, F.length(value))
    name = F.concat(title, F.when((bare == F.upper(bare)) & (F.length(bare) > 1), F.upper(surrogate)).otherwise(surrogate))
    upper = (value == F.upper(value)) & value.rlike(r"\p{L}")
    return F.when(kind == "name", name).when(kind == "email", F.when(upper, F.upper(surrogate)).otherwise(surrogate)).when(kind == "ip", surrogate).otherwise(laid)


def surrogates(entities: DataFrame, key: str, place: Written) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity); a name's is the words which stand for its own, capitalised.

    All surrogates of a kind are different and none is an entity itself; names are as different as their words.
    """
    names = place.table(entities.where("kind = 'name'").select("entity", F.posexplode(name_parts(F.col("entity"))).alias("at", "part")), "names")
    parts = names.select("part.kind", "part.entity").distinct()
    drawn = place.table(_drawn(entities.where("kind <> 'name'").select("kind", "entity").unionByName(parts), key, place), "all")
    word = names.join(drawn.select(F.struct("kind", "entity").alias("part"), F.substring_index("surrogate", " ", -1).alias("word")), "part")
    named = word.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", _capital(F.col("word")).alias("word")))), lambda w: w["word"]), " ").alias("surrogate"))
    return drawn.where("kind NOT IN ('given', 'surname')").unionByName(named.select(F.lit("name").alias("kind"), "entity", "surrogate"))


def _drawn(entities: DataFrame, key: str, place: Written) -> DataFrame:
    """(kind, entity, surrogate), drawn until all surrogates of a kind differ and none is an entity."""
    open_, done = place.table(entities, "entities"), None
    all_ = open_
    for attempt in range(ROUNDS):
        drawn = place.table(open_.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), attempt, key)), f"drawn-{attempt}")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        for taken in (all_.select("kind", F.col("entity").alias("surrogate")), None if done is None else done.select("kind", "surrogate")):
            if taken is not None:
                first = first.join(taken, ["kind", "surrogate"], "left_anti")
        won = place.table(first.select("kind", "entity", "surrogate"), f"won-{attempt}")
        done = won if done is None else done.unionByName(won)
        open_ = place.table(drawn.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity"), f"open-{attempt}")
        if open_.isEmpty():
            return done
    raise ValueError("nearly all numbers of one length occur in the texts: no distinct surrogates are left")


def pseudonymised(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with surrogates in the texts, and with ``n_<kind>`` columns if ``counts``.

    ``key`` is the secret: another one gives other surrogates.  Null texts stay null, texts without entities stay as they are;
    repeated rows change alike; an empty table gives an empty one; other columns pass unchanged, and a column which already has
    the name of a count is an error.
    """
    place = Written(docs.sparkSession)
    clash = {f"n_{k}" for k in KINDS} & {c.lower() for c in docs.columns}
    if counts and clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    body = F.col(f"`{text}`")
    version, ident, known, fresh, both = (free_name(docs, x) for x in ("_version", "_id", "_swaps", "_text", "_found"))
    has = F.coalesce(body.rlike(PATTERN), F.lit(False))
    value = F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))))
    found = docs.where(has).select(F.col(f"`{id_column}`").alias(ident), F.xxhash64(body).alias(version), value.alias("value"))
    found = found.withColumn("kind", kind_of(F.col("value"))).withColumn("entity", entity_of(F.col("value"), F.col("kind")))
    found = place.table(found, "found")
    table = place.table(surrogates(found.select("kind", "entity").distinct(), key, place), "surrogates")
    # One entity may be a large part of all mentions; the join splits it.
    mention = found.join(table, ["kind", "entity"]).select(ident, version, "value", "kind", written(F.col("value"), F.col("kind"), F.col("surrogate")).alias("new"))
    swaps = place.table(mention.groupBy(ident, version).agg(F.collect_set(F.struct("value", "kind", "new")).alias(known)), "swaps")
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(ident)) & (F.xxhash64(body) == F.col(version))
    dirty = docs.where(has).join(swaps, same)

    def rebuilt(found_: Column) -> Column:
        pieces = F.split(body, PATTERN, -1)
        new = lambda v: F.get(F.filter(F.col(known), lambda s: s["value"] == v), F.lit(0))["new"]
        return let(pieces, lambda p: F.concat(F.array_join(F.transform(found_, lambda v, i: F.concat(F.get(p, i), new(v))), ""), F.get(p, F.size(found_))))

    matches = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    dirty = dirty.select("*", F.explode(F.array(matches)).alias(both)).withColumn(fresh, rebuilt(F.col(both)))
    changed = [F.col(fresh if c == text else f"`{c}`").alias(c) for c in docs.columns]
    none = [F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS] if counts else []
    plain = docs.where(~has).select(*[F.col(f"`{c}`") for c in docs.columns], *none)
    return plain.unionByName(dirty.select(*changed, *_kind_counts(F.col(both), counts)))


def _kind_counts(found: Column, counts: bool) -> list[Column]:
    kinds = F.transform(found, kind_of)
    return [F.size(F.filter(kinds, _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS] if counts else []


def _is(kind: str):
    return lambda x: x == kind
