"""Replacement of personal data by keyed, type-consistent surrogates. Only DataFrame functions: no Python on the executors.

Detected mentions are reduced to entities (kind, canonical form): an e-mail address in lower case, the digits of a phone or card
number, an IPv4 address, a quoted secret, and for a name after a title its given name with the title's gender and its surname.
Each distinct entity of the corpus draws a surrogate of its kind, script and length from a hash of key, entity and attempt. Of
entities with one surrogate, one keeps it; the others, and those whose surrogate is itself an entity of the corpus, draw again.
So distinct entities stay distinct, and all mentions of an entity get the same replacement, written in the mention's format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import written

#: Titles by gender, and given names by script and gender.
TITLES = {"m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Господин", "господин"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "Госпожа", "госпожа"]}
GIVEN = {("latin", "m"): ["Adrian", "Bruno", "Conrad", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Leon", "Martin"],
         ("latin", "f"): ["Alba", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta"],
         ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Егор", "Илья", "Кирилл", "Максим"],
         ("cyrillic", "f"): ["Алина", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина"]}
SYLLABLES = {"latin": ["ba", "den", "fer", "gol", "han", "kar", "lin", "mor", "nel", "per", "ros", "sten", "tal", "ver", "win", "zan"],
             "cyrillic": ["ба", "ден", "фер", "гол", "кар", "лин", "мор", "нел", "пер", "рос", "стен", "тал", "вер", "зан", "дов", "лев"]}

#: Every pattern but that of secrets starts where no letter or digit stands before; that is tested once for all.
_MAIL = r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
_IP = r"(?<!\.)\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
_PHONE = (r"\+\d{8,15}(?!\d)|\+\d{1,3} ?\d(?:[ .]\d{2}){4}(?!\d)|\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{3,4}){1,2}(?!\d)"
          r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)")
_CARD = r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\p{L}\p{N}])|\d{13,19}(?![\p{L}\p{N}])"
_SECRET = r"(?<=[\x22'])(?<=(?i:token|secret|password|passwd|api_?key)[ ]{0,2}[=:][ ]{0,2}[\x22'])[^\x22'\s]{6,}(?=[\x22'])"
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.?"
_NAME = rf"{_TITLE} \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
DETECT = rf"(?<![\p{{L}}\p{{N}}])(?:{_MAIL}|(?=[+(0-9])(?:{_IP}|{_PHONE}|{_CARD})|{_NAME})|{_SECRET}"
_KEY = "\x1f"
_MENTION = "array<struct<kind:string,canon:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The check sum of a digit string; 0 modulo 10 for valid card numbers."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def parts_of(mention: Column) -> Column:
    """The entities of a mention, none if it only looks like one (octets over 255, a number of odd length with a wrong check digit)."""
    def one(kind: str, canon: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), canon.alias("canon"))).cast(_MENTION)

    none = F.array().cast(_MENTION)
    digits = _digits(mention)
    octets = F.transform(F.split(mention, "[.]"), lambda o: o.cast("int"))
    words = F.slice(F.split(mention, " "), 2, 2)
    gender = F.when(F.regexp_extract(mention, r"^(\p{L}+)", 1).isin(TITLES["m"]), F.lit("given_m")).otherwise(F.lit("given_f"))
    surname = F.struct(F.lit("surname").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
    name = F.when(F.size(words) == 2, F.array(F.struct(gender.alias("kind"), F.lower(words[0]).alias("canon")), surname)).otherwise(F.array(surname)).cast(_MENTION)
    return (F.when(mention.contains("@"), one("mail", F.lower(mention)))
            .when(mention.rlike(rf"^{_TITLE} \p{{Lu}}"), name)
            .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o < 256), one("ip", mention)).otherwise(none))
            .when(mention.rlike(r"^[+(]\d|^\d{3}[.-]\d{3}[.-]\d{4}$"), one("phone", F.regexp_replace(mention, "[^0-9+]", "")))
            .when(mention.rlike(r"^[0-9 -]{13,}$"), F.when((F.length(digits) == 16) | (luhn_sum(digits) % 10 == 0), one("card", digits)).otherwise(none))
            .otherwise(one("secret", mention)))


def may_have(text: Column) -> Column:
    """A cheap condition that every text with a mention meets: a digit, a sign or a title."""
    stems = sorted({t[1:] if t[0] in "Гг" else t for g in TITLES.values() for t in g})
    found = text.rlike("[0-9]") | text.contains("@") | text.contains('"') | text.contains("'")
    for stem in stems:
        if not any(stem != other and other in stem for other in stems):
            found = found | text.contains(stem)
    return found


def mentions_of(text: Column) -> Column:
    """All mentions of a text in order."""
    return F.regexp_extract_all(text, F.lit(DETECT), F.lit(0))


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(number, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _reshaped(canon: Column, seed: Column, fixed: Column, hexadecimal: Column) -> Column:
    """Each letter or digit replaced by one of its class and script; the positions for which ``fixed`` holds stay."""
    def put(i: Column) -> Column:
        c, r = F.substring(canon, i, F.lit(1)), F.xxhash64(seed, i)
        small = F.when(hexadecimal, _pick("abcdef", r)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", r))
        new = (F.when(c.rlike("[0-9]"), _pick("0123456789", r)).when(c.rlike("[a-z]"), small)
               .when(c.rlike("[A-Z]"), F.upper(small))
               .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), F.upper(_pick("абвгдежзиклмнопрстуфхцч", r)))
               .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцч", r))
               .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), F.upper(_pick("αβγδεζηθικλμνξοπρστυφχψω", r)))
               .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", r))
               .when(c.rlike(r"[\p{IsLatin}&&\p{Lu}]"), F.upper(_pick("àáâäèéêëìíîïòóôöùúûüñç", r)))
               .when(c.rlike(r"\p{IsLatin}"), _pick("àáâäèéêëìíîïòóôöùúûüñç", r))
               .when(c.rlike(r"\p{IsHan}"), _pick("一丁七万三上下不世中主久之九也二五井人今", r)).otherwise(c))
        return F.when(fixed(i), c).otherwise(new)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), put), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate at an attempt. Late attempts leave the length, so that some draw is always free."""
    seed = F.sha2(F.concat_ws(_KEY, F.lit(key), kind, canon, attempt.cast("string")), 256)
    number = F.xxhash64(seed)
    # late attempts append characters of the hash
    longer = F.when(attempt > 5, F.translate(F.substring(seed, F.lit(1), attempt - 4), "0123456789", "ghijklmnop")).otherwise(F.lit(""))
    domain_end = F.length(canon) - F.length(F.regexp_extract(canon, r"\.\p{L}+$", 0))
    at = F.instr(canon, "@")
    never = lambda i: F.lit(False)
    no_hex = F.lit(False)
    mail = _reshaped(canon, seed, lambda i: (i == at) | (i > domain_end), no_hex)
    phone = _reshaped(canon, seed, lambda i: canon.startswith("+") & (i == 2), no_hex)
    card = _reshaped(canon, seed, lambda i: i == 1, no_hex)
    stem = F.substring(card, F.lit(1), F.length(card) - 1)
    valid = F.concat(stem, F.pmod(-luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    greek = canon.rlike(r"\p{IsGreek}")

    def syllables(script: str, n: Column) -> Column:
        options = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(options, F.pmod(F.xxhash64(seed, F.lit("s"), i), F.lit(len(SYLLABLES[script]))).cast("int"))), "")

    def given(script: str, gender: str) -> Column:
        options = F.array(*(F.lit(x.lower()) for x in GIVEN[script, gender]))
        start = F.get(options, F.pmod(number, F.lit(len(GIVEN[script, gender]))).cast("int"))
        return F.when(attempt < 2, start).otherwise(F.concat(start, syllables(script, attempt - 1)))

    def by_script(make) -> Column:
        return F.when(cyrillic, make("cyrillic")).when(greek, _reshaped(canon, seed, never, no_hex)).otherwise(make("latin"))

    return (F.when(kind == "mail", F.concat(longer, mail)).when(kind == "phone", phone)
            .when(kind == "card", F.when(luhn_sum(canon) % 10 == 0, valid).otherwise(card)).when(kind == "ip", ip)
            .when(kind == "given_m", by_script(lambda s: given(s, "m"))).when(kind == "given_f", by_script(lambda s: given(s, "f")))
            .when(kind == "surname", by_script(lambda s: syllables(s, F.lit(2) + attempt)))
            .otherwise(F.concat(_reshaped(canon, seed, never, canon.rlike("^[0-9a-f]+$")), longer)))


def assign_surrogates(entities: DataFrame, key: str, max_attempts: int = 60) -> DataFrame:
    """(kind, canon, surrogate) of the distinct entities (kind, canon): one surrogate each, none twice within a kind, none an entity.

    Each round settles at least one entity of every contested surrogate. Entities left after ``max_attempts`` are an error.
    """
    entities = written(entities.select("kind", "canon").distinct(), "entities")
    open_ones, settled = entities, None
    originals = entities.select("kind", F.col("canon").alias("surrogate"))
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as a draw costs time, not bytes
    for attempt in range(max_attempts):
        drawn = open_ones.repartition(tasks, "kind", "canon").withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        firsts = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(originals, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            firsts = firsts.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(firsts.select("kind", "canon", "surrogate"), "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        open_ones = open_ones.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti")
        open_ones = written(open_ones, "open_entities")
        if open_ones.isEmpty():
            return settled
    raise ValueError(f"no free surrogates after {max_attempts} attempts")


def _rendered(mention: Column, parts: Column, found: Column) -> Column:
    """A mention in its own format with the surrogates of its parts; ``found`` maps kind and canonical form to surrogate."""
    def of(part: Column) -> Column:
        return F.try_element_at(found, F.concat_ws(_KEY, part["kind"], part["canon"]))

    first = parts[0]
    new = of(first)
    digits = _digits(new)
    n = F.length(mention)
    filled = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda acc, i: F.struct(
        F.concat(acc["out"], F.when(F.substring(mention, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, acc["at"], F.lit(1))).otherwise(F.substring(mention, i, F.lit(1)))).alias("out"),
        (acc["at"] + F.when(F.substring(mention, i, F.lit(1)).rlike("[0-9]"), 1).otherwise(0)).alias("at")))["out"]
    # upper case where the mention has it; only when positions agree
    cased = F.when(F.length(new) == n, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        F.substring(mention, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), "")).otherwise(new)
    words = F.slice(F.split(mention, " "), 2, 2)
    named = F.concat(F.split(mention, " ")[0], F.lit(" "), F.array_join(F.transform(parts, lambda p, i: F.when(
        F.get(words, i) == F.upper(F.get(words, i)), F.upper(of(p))).otherwise(F.initcap(of(p)))), " "))
    kind = first["kind"]
    return (F.when(F.size(parts) == 0, mention).when(kind.isin("given_m", "given_f", "surname"), named)
            .when(kind.isin("phone", "card"), filled).when(kind == "mail", cased).otherwise(new))


def pseudonymize(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all other columns stay as they are.

    ``count`` names a column to add with the number of mentions replaced. Null texts stay null, empty ones empty; texts without
    mentions come out unchanged. Repeated rows, null ids and extra columns do not matter. An empty table gives an empty result.
    Texts without mentions are not shuffled. The key must be kept secret; the same key gives the same surrogates on the same data.
    """
    hit = may_have(F.col("text")) & F.col("text").rlike(DETECT)
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")  # apart from what is added, so that no input name clashes
    text = F.col("row.text")
    hits = docs.where(hit).select(whole).select("row", F.sha2(text.cast("binary"), 256).alias("id"), mentions_of(text).alias("mentions"))
    wanted = hits.groupBy("id").agg(F.first("mentions").alias("mentions"))  # equal texts are looked up once
    asked = written(wanted.select("id", F.explode(F.array_distinct(F.flatten(F.transform("mentions", parts_of)))).alias("p")).select("id", "p.*"), "mentions")
    chosen = assign_surrogates(asked, key)
    found = (asked.join(chosen, ["kind", "canon"]).groupBy("id")
             .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(_KEY, "kind", "canon"), "surrogate"))).alias("found")))
    answered = hits.join(found, "id", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<string,string>")))
    gaps = F.split(text, DETECT, -1)
    new = F.transform("mentions", lambda m: _rendered(m, parts_of(m), F.col("found")))
    done = F.concat(gaps[0], F.array_join(F.zip_with(new, F.slice(gaps, F.lit(2), F.size(gaps)), lambda m, g: F.concat(m, g)), ""))
    replaced = F.size(F.filter("mentions", lambda m: F.size(parts_of(m)) > 0)).cast("long")
    answered = answered.select("row", done.alias("done"), replaced.alias("replaced"))
    first = answered.select(*((F.col("done") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns), *([F.col("replaced").alias(count)] if count else []))
    rest = docs.where(F.coalesce(~hit, F.lit(True))).select(*(F.col(f"`{c}`") for c in columns), *([F.lit(0).cast("long").alias(count)] if count else []))
    return rest.union(first)
