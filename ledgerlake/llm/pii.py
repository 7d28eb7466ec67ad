"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, phone numbers (with a country code, or national
ones of ten digits), payment cards (with a right check digit), hexadecimal secrets and names behind an
honorific.  Each entity is replaced by a surrogate of its type that depends on a secret key and the
entity's canonical form alone, so one entity has one surrogate in the whole corpus, in every spelling
of its case or punctuation.  A name's words are entities of their own, for each gender, so "Mr. John
Smith" and a later "Mr. Smith" keep their family name in common.  Formats stay: the
places of digits, letters and punctuation, the case, a phone's country code and 555 exchange, a
card's first digit and valid check digit, a valid address's four octets; a name keeps the honorific
(and so the gender), its words' number and separators and its script (Latin, Cyrillic, Greek).

Collision checks: the distinct entities of the corpus are a table; an entity whose surrogate equals
another's, or equals an entity that occurs, takes the next attempt number until all surrogates are
distinct (`resolve`).  From attempt WIDE_FROM on an e-mail address has a keyed host label more, a
name's words have four syllables more and a phone's exchange is keyed even if it is 555, so small
formats that fill do not end the run; the other formats hold billions and keep their width.  Entities with a number above 0 are the only ones that documents have to look
up; that table is broadcast only up to BROADCAST_ENTITIES rows and joined by shuffle beyond.

Defined cases: null texts stay null and empty ones empty; texts without entities are untouched; rows
that repeat are treated alike; other columns pass through, whatever their names, but for one named like
the count of entities, which that replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

EMAIL = r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
NATIONAL = r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
CARD = r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
SECRET = r"(?<![0-9A-Za-z])(?=[a-f]*+\d)(?:[0-9a-f]{32,128}+)(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[A-F]*+\d)(?:[0-9A-F]{32,128}+)(?![0-9A-Za-z])"
# Honorifics by gender; they stay in the text and choose the surrogate's gender.
MALE = ("Mr.", "Mr", "Herr", "Señor", "Sr.", "Monsieur", "M.", "г-н", "господин", "κύριος")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Sra.", "Madame", "Mme", "г-жа", "госпожа", "κυρία")
NEUTRAL = ("Dr.", "Prof.")
_HONORIFIC = "|".join(x.replace(".", r"\.") for x in sorted(MALE + FEMALE + NEUTRAL, key=lambda x: (-len(x), x)) if x != "M.")
NAME = rf"(?<![\w.])(?:{_HONORIFIC}) \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}(?![\w@])"
PATTERN = f"{EMAIL}|{IPV4}|{PHONE}|{CARD}|{NATIONAL}|{SECRET}|{NAME}"
# Syllables of surrogate names by script and, for the last one of a first name, by gender.
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so ta ve wi".split(), "cyrillic": "ба де фи го лу ма не ри со та ве ви".split(), "greek": "βα δε φι γο λου μα νε ρι σο τα βε θι".split()}
ENDINGS = {"latin": ("rn", "na"), "cyrillic": ("рн", "на"), "greek": ("ρος", "να")}
BROADCAST_ENTITIES = 50_000
MOST_ATTEMPTS = 64
WIDE_FROM = 8


def entity_type(m: Column) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{_HONORIFIC}) "), "name")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(m.startswith("+") | m.rlike(rf"^{NATIONAL}$"), "phone")
        .when(m.rlike(r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), "secret")
        .when((F.length(digits) >= 13) & (F.length(digits) <= 19) & (luhn_sum(digits) % 10 == 0), "card")
    )  # none: it only looks like one and stays


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def canonical(m: Column, kind: Column) -> Column:
    """What is the same for all spellings of one entity."""
    return F.when(kind.isin("email", "secret"), F.lower(m)).when(kind.isin("phone", "card"), F.regexp_replace(m, r"\D", "")).otherwise(m)


def _stream(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """128 keyed pairs of hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 512), F.lit(key)), 512) for i in range(2)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(stream: Column, i: Column, first: str, n: int) -> Column:
    return F.char((F.lit(ord(first)) + _byte(stream, i) % n).cast("int"))


def _signs(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _keyed_digits(digits: Column, stream: Column, fixed) -> Column:
    return _signs(digits, lambda c, i: F.when(fixed(c, i), c).otherwise((_byte(stream, i) % 10).cast("string")))


def surrogate(key: str, kind: Column, name: Column, gender: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate: a function of key, type, canonical form and attempt."""
    s, wide = F.col("__stream"), attempt >= WIDE_FROM
    local = F.substring_index(name, "@", 1)
    mailbox = _signs(local, lambda c, i: F.when(c.rlike("[0-9]"), (_byte(s, i) % 10).cast("string")).when(c.rlike(r"\p{L}"), _letters(s, i, "a", 26)).otherwise(c))
    host = F.substring_index(name, "@", -1)
    top = F.substring_index(host, ".", -2)
    below = F.expr("substring(substring_index(canon, '@', -1), 1, length(substring_index(canon, '@', -1)) - length(substring_index(substring_index(canon, '@', -1), '.', -2)))")
    # what stands below the registered name is keyed, the name itself becomes a reserved one of the same top level
    reserved = F.concat(F.lit("example."), F.substring_index(top, ".", -1))
    label = F.when(wide, F.concat(*(_letters(s, F.lit(i + 100), "a", 26) for i in range(8)), F.lit("."))).otherwise("")
    email = F.concat(mailbox, F.lit("@"), _signs(below, lambda c, i: F.when(c.rlike("[0-9]"), (_byte(s, i + 64) % 10).cast("string")).when(c.rlike("[a-z]"), _letters(s, i + 64, "a", 26)).otherwise(c)), label, reserved)
    ipv4 = F.concat_ws(".", *((_byte(s, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    secret = _signs(name, lambda c, i: F.lower(F.hex(_byte(s, i) % 16)))
    country = F.length(name) - 10
    phone = _keyed_digits(name, s, lambda c, i: (i < F.greatest(country, F.lit(1))) | (~wide & (i >= country + 3) & (i < country + 6) & (F.substr(name, country + 4, F.lit(3)) == "555")))
    body = F.substr(_keyed_digits(name, s, lambda c, i: i == 0), F.lit(1), F.length(name) - 1)
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def word(which: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[which]))
        male, female = ENDINGS[which]
        sound = lambda w, j: F.element_at(syllables, _byte(s, w * 4 + j) % len(SYLLABLES[which]) + 1)
        ending = lambda w: F.when(w > 0, "").when(gender == "male", male).when(gender == "female", female).otherwise("")
        return F.array_join(F.transform(F.split(name, " "), lambda _, w: F.initcap(F.concat(sound(w, 0), sound(w, 1), sound(w, 2), sound(w, 3), F.when(wide, F.concat(*(sound(w, 64 + j) for j in range(4)))).otherwise(""), ending(w)))), " ")

    named = F.when(script == "cyrillic", word("cyrillic")).when(script == "greek", word("greek")).otherwise(word("latin"))
    return F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "secret", secret).when(kind == "phone", phone).when(kind == "card", card).when(kind == "name", named)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, gender, attempt) with the column `surrogate`."""
    streamed = entities.withColumn("__stream", _stream(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    return streamed.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))).drop("__stream")


def gender_of(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_HONORIFIC}) ", 1)
    return F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female")


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, gender, attempt, surrogate of the distinct entities, all surrogates distinct.

    Names of both genders are one entity for each gender.  Of entities that meet, the smallest stays
    and the others take their next attempt; an entity that occurs in the corpus is no surrogate.
    """
    now = stored(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "pii-entities")
    real = entities.select("kind", F.col("canon").alias("surrogate")).distinct()
    for _ in range(MOST_ATTEMPTS):
        first = now.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon", "gender")).alias("first"))
        meets = first.filter("n > 1").select("kind", "surrogate", "first")
        taken = now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon", "gender")
        later = now.join(meets, ["kind", "surrogate"]).filter(F.struct("attempt", "canon", "gender") != F.col("first")).select("kind", "canon", "gender")
        again = stored(later.unionByName(taken).distinct(), "pii-again")
        if not again.limit(1).count():
            return now
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kind", "canon", "gender")]
        moved = now.alias("a").join(again.withColumn("hit", F.lit(1)).alias("b"), same, "left").select("a.kind", "a.canon", "a.gender", (F.col("a.attempt") + F.coalesce("b.hit", F.lit(0))).alias("attempt"))
        now = stored(with_surrogates(moved, key), "pii-entities")
    raise ValueError("surrogates still meet; the space of a format is too small for its entities")


def dress(m: Column, kind: Column, value: Column) -> Column:
    """The surrogate in the occurrence's own format."""
    digits_in = lambda: F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substr(value, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
        lambda a: a["out"],
    )
    cased = F.when(m == F.upper(m), F.upper(value)).otherwise(value)
    return F.when(kind.isin("phone", "card"), digits_in()).when(kind.isin("email", "secret"), cased).otherwise(value)


def parts(m: Column, kind: Column, at: Column) -> Column:
    """An occurrence as an array of (at, word, before, match, kind, canon, gender): one for each word of a name, else one."""
    title = F.regexp_extract(m, rf"^(?:{_HONORIFIC}) ", 0)
    words = F.regexp_replace(m, rf"^(?:{_HONORIFIC}) ", "")
    marks = F.regexp_extract_all(words, F.lit("[ -]"), F.lit(0))
    part = lambda word, before, text, canon, gender: F.struct(at.alias("at"), word.alias("word"), before.alias("before"), text.alias("match"), kind.alias("kind"), canon.alias("canon"), gender.alias("gender"))
    named = F.transform(F.split(words, "[ -]"), lambda w, j: part(j, F.when(j == 0, title).otherwise(F.get(marks, j - 1)), w, w, gender_of(m)))
    return F.when(kind == "name", named).otherwise(F.array(part(F.lit(0), F.lit(""), m, canonical(m, kind), F.lit(None).cast("string"))))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold an entity as the struct `doc`, with `between` (texts between matches) and `found` (the parts of all matches)."""
    hits = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    typed = F.transform(hits, lambda m: F.struct(m.alias("match"), entity_type(m).alias("kind")))
    found = F.flatten(F.transform(typed, lambda x, i: parts(x["match"], x["kind"], i)))
    return docs.filter(has_entity(text)).select(F.struct("*").alias("doc"), F.split(text, PATTERN).alias("between"), found.alias("found"))


def has_entity(text: str) -> Column:
    """False for null texts."""
    hint = F.col(text).rlike(rf"[0-9@]|(?<!\w)(?:{_HONORIFIC}) ")
    return F.coalesce(hint & F.col(text).rlike(PATTERN), F.lit(False))


def replace_entities(docs: DataFrame, key: str, text: str = "text", count: str = "__entities") -> DataFrame:
    """docs with every entity in `text` replaced, and the column `count`: how many."""
    docs = docs.drop(count)
    rows = stored(find(docs, text).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    entities = rows.select(F.explode("found").alias("e")).select("e.kind", "e.canon", "e.gender").filter(F.col("kind").isNotNull()).distinct()
    resolved = resolve(entities, key)
    moved = resolved.filter("attempt > 0").select("kind", "canon", "gender", "attempt")
    n = moved.count()
    if n:
        # only documents that hold an entity with another attempt look it up
        seen = rows.select("row", F.explode("found").alias("e")).select("row", "e.kind", "e.canon", "e.gender").distinct()
        table = F.broadcast(moved) if n <= BROADCAST_ENTITIES else moved
        same = [seen["kind"] == table["kind"], seen["canon"] == table["canon"], seen["gender"].eqNullSafe(table["gender"])]
        tried = seen.join(table, same).groupBy("row").agg(F.collect_list(F.struct(seen["kind"], seen["canon"], seen["gender"], "attempt")).alias("moved"))
        rows = rows.join(tried, "row", "left")
    else:
        rows = rows.withColumn("moved", F.lit(None).cast("array<struct<kind:string,canon:string,gender:string,attempt:int>>"))

    each = rows.select("row", "moved", F.explode("found").alias("e"))
    attempt = F.coalesce(F.get(F.filter("moved", lambda x: (x["kind"] == F.col("e.kind")) & (x["canon"] == F.col("e.canon")) & x["gender"].eqNullSafe(F.col("e.gender"))), F.lit(0))["attempt"], F.lit(0))
    value = F.when(F.col("kind").isNull(), F.col("match")).otherwise(dress(F.col("match"), F.col("kind"), F.col("surrogate")))
    dressed = with_surrogates(each.select("row", "e.*", attempt.alias("attempt")), key).select("row", "at", "word", F.concat("before", value).alias("new"), (F.col("kind").isNotNull() & (F.col("word") == 0)).alias("hit"))
    new = dressed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "word", "new"))).alias("new"), F.count_if("hit").alias("n"))
    between = F.col("between")
    written = F.transform("new", lambda x: F.concat(F.when(x["word"] == 0, F.get(between, x["at"])).otherwise(""), x["new"]))
    whole = F.concat(F.array_join(written, ""), F.element_at(between, -1))
    changed = rows.join(new, "row").select(F.col("doc").withField(f"`{text}`", whole).alias("doc"), "n").select("doc.*", F.col("n").alias(count))
    return changed.unionByName(docs.filter(~has_entity(text)).withColumn(count, F.lit(0).cast("long")))
