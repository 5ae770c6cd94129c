"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format, distinct and consistent.

All steps are DataFrame expressions. A mention is taken apart into components (the local part and the domain of an address, the
given names and the surname of a person, the digits of a number). Equal components get equal surrogates wherever they stand, so
mentions of one entity in different formats stay mentions of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import col
from millrace.llm.tables import fresh, settle

#: Fixed lists: forms of address by gender, and given names to begin with.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Sr г-н",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra г-жа",
    "n": "Dr Prof",
}
GIVEN = {
    "m": "Adam Brian Carl David Edgar Felix George Henry Ivan Jonas Kevin Lucas Martin Noah Oscar Peter Quentin Robert Simon Thomas",
    "f": "Alice Bella Clara Diana Emma Fiona Grace Helen Irene Julia Karen Laura Maria Nora Olivia Paula Quinn Rosa Sarah Teresa",
    "n": "Alex Ariel Blake Casey Charlie Dana Eden Finley Harper Jamie Jordan Kim Lee Morgan Noel Robin Sam Sasha Sidney Taylor",
}
GIVEN_CYRILLIC = {
    "m": "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Максим Николай",
    "f": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Мария Наталья",
    "n": "Саша Женя Валя Слава Шура",
}
_SYLLABLES = "ba be bo ca co da de do fa fe ga go ha he ja jo ka ke la le li lo ma me mi mo na ne no pa pe ra re ro sa se so ta te ti to va ve wa wi".split()
_SYLLABLES_CYRILLIC = "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split()

_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = {g: "|".join(sorted(words.split(), key=len, reverse=True)) for g, words in TITLES.items()}
#: What a pattern may begin with is looked at first, as most characters begin nothing.
_TITLE_STARTS = "(?=[" + "".join(sorted({w[0] for words in TITLES.values() for w in words.split()})) + "])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Loops over groups are bounded or possessive: others recurse, and a long text would end the executor.
_GAP = r"[ \t]*+\s{0,2}+[ \t]*+"
#: A label may be a part of a longer identifier, which is searched once, from its start or from the end of the match before.
_SECRET_HINT = r"(?:(?<![\w.-])|\G)(?>[\w.-]*?(?=[PSTApsta])(?i:password|passwd|pwd|secret|token|api[_-]?key))[\w.-]*+\\?[\"']?" + _GAP + "[=:]"
_SECRET_LABEL = _SECRET_HINT + r"[=:]?>?" + _GAP + r"\\?[\"']?"
#: A quoted value runs to its closing quote, in which a backslash takes the next character along, any other to white space.
_SECRET_VALUE = (
    r"(?:(?<=[^\\]\")(?!\")[^\"\\\r\n]*+(?:\\.[^\"\\\r\n]*+)*+\"|(?<=[^\\]')(?!')[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+'|[^\s\"']\S*+)"
)
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?=[A-Za-z0-9-])[A-Za-z0-9.-]*(?<!\.)\.[A-Za-z]{2,}",
    "secret": _SECRET_LABEL + _SECRET_VALUE,
    "cloud_key": r"(?=A)(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)",
    "person": rf"{_TITLE_STARTS}(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_TITLE.values())})\.?[ ]{_WORD}(?:[ ]{_WORD}){{0,2}}",
    "phone": r"(?=[+(\d])(?:(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w))",
    "national_id": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_ANY = "|".join(PATTERNS.values())
#: What hints at a person.
_HINT = rf"{_TITLE_STARTS}(?:{'|'.join(_TITLE.values())})\.?[ ]\p{{Lu}}"
#: After so many surrogates that were taken, longer ones are tried: short values may have used up their format.
SAME_LENGTH_TRIES = 6


def _hinted(text: Column) -> Column:
    """False only where ``_ANY`` finds nothing; cheap tests come first."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(_SECRET_HINT)
    return F.coalesce(text.rlike("[@0-9]") | text.rlike(_HINT) | secret, F.lit(False))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    back = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(back, F.lit(0), lambda s, x: s + x) % 10 == 0


def _only(s: Column, characters: str) -> Column:
    return F.regexp_replace(s, f"[^{characters}]", "")


def _part(kind, text) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(kind).alias("kind"), as_column(text).alias("part"))


def _components(mention: Column) -> Column:
    """What a mention consists of: components to replace (with a kind) and text to leave (kind '')."""
    is_a = lambda kind: mention.rlike(rf"^(?:{PATTERNS[kind]})$")
    cut = lambda pattern, group: F.regexp_extract(mention, pattern, group)
    email = rf"^(.*)@(.*)(\.[A-Za-z]+)$"
    secret = rf"(?s)^({_SECRET_LABEL})(.*)\z"
    title = r"^(\S+?\.?) (.*)$"
    gender = F.when(mention.rlike(rf"^(?:{_TITLE['m']})\b"), "m").when(mention.rlike(rf"^(?:{_TITLE['f']})\b"), "f").otherwise("n")
    script = F.when(mention.rlike(r"\p{IsCyrillic}{2}.*$"), "cyrillic").otherwise("latin")
    names = F.split(cut(title, 2), " ")
    # Latin surnames have no gender, so that "Mr. Smith" and "Dr. Smith" may be the same.
    surname = F.concat(F.lit("surname_"), F.when(script == "latin", "n").otherwise(gender), F.lit("_"), script)
    kind = lambda i: F.when(i == F.size(names) - 1, surname).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), script))
    named = F.flatten(F.transform(names, lambda x, i: F.array(_part("", " "), _part(kind(i), x))))
    card = _luhn(_only(mention, "0-9"))
    return (
        F.when(is_a("email"), F.array(_part("local", cut(email, 1)), _part("", "@"), _part("domain", cut(email, 2)), _part("", cut(email, 3))))
        .when(is_a("secret"), F.array(_part("", cut(secret, 1)), _part("secret", cut(secret, 2))))
        .when(is_a("cloud_key"), F.array(_part("", F.substring(mention, 1, 4)), _part("key", F.expr("substring(mention, 5)"))))
        .when(is_a("person"), F.concat(F.array(_part("", cut(title, 1))), named))
        .when(is_a("phone"), F.array(_part("phone", mention)))
        .when(is_a("national_id"), F.array(_part("national_id", mention)))
        .when(is_a("ip"), F.array(_part("ip", mention)))
        .when(is_a("card") & card, F.array(_part("card", mention)))
        .otherwise(F.array(_part("", mention)))
    )


def _canonical(kind: Column, part: Column) -> Column:
    """What mentions of one component have in common: no case, no punctuation, no country prefix."""
    digits = _only(part, "0-9")
    return (
        F.when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "national_id"), digits)
        .when(kind.isin("local", "domain"), F.lower(_only(part, "A-Za-z0-9_")))
        .when(kind.startswith("given") | kind.startswith("surname"), F.lower(part))
        .when(kind == "secret", _only(part, r"\p{L}\p{M}\p{N}_"))
        .when(kind == "key", _only(part, "A-Za-z0-9_"))
        .otherwise(part)
    )


def _surrogate() -> tuple[Column, Column, Column]:
    """The canonical surrogate of ``kind`` and ``canon`` at attempt ``nonce``, from its ``digest``.

    Lambdas compute what they mention anew for every element, so whatever depends on all of a value is a column before.
    """
    kind, canon, nonce, digest = F.col("kind"), F.col("canon"), F.col("nonce"), F.col("digest")
    longer = F.greatest(nonce - SAME_LENGTH_TRIES, F.lit(0))
    byte = lambda i: (F.conv(F.substring(digest, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int") + (i / 64).cast("int") * 7)
    letters = lambda s: F.array(*[F.lit(c) for c in s])
    pick = lambda pool, i: F.element_at(pool, byte(i) % F.size(pool) + 1)
    digits, lower, upper = letters("0123456789"), letters("abcdefghijklmnopqrstuvwxyz"), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    hexadecimal = (kind == "secret") & canon.rlike("^[0-9a-f]+$")

    def same_class(c, i, low):
        leading = (kind.isin("phone") & i.isin(0, 3)) | (kind.isin("national_id") & (i == 0))
        return (
            F.when(kind.isin("card") & (i == 0), c)
            .when(leading, F.element_at(digits, byte(i) % 8 + 2 + F.when(kind == "phone", 1).otherwise(0)))
            .when(c.rlike("[0-9]"), pick(digits, i))
            .when(c.rlike("[a-z]"), pick(low, i))
            .when(c.rlike("[A-Z]"), pick(upper, i))
            .when((kind == "secret") & c.rlike(r"[^\x00-\x7F]"), pick(lower, i))
            .otherwise(c)
        )

    added = F.when(longer > 0, F.transform(F.sequence(F.lit(1), longer), lambda i: pick(digits, i + 31))).otherwise(F.array().cast("array<string>"))
    of = lambda low: F.transform(_chars(canon), lambda c, i: same_class(c, i, low))
    mapped = F.array_join(F.concat(F.when(hexadecimal, of(letters("abcdef"))).otherwise(of(lower)), added), "")
    body = F.expr("left(mapped, length(mapped) - 1)")
    checked = F.when(kind == "card", F.filter(F.transform(digits, lambda d: F.concat(body, d)), lambda s: _luhn(s))[0])
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(i) % 254 + 1).cast("string")), ".")

    cyrillic, given = kind.endswith("cyrillic"), kind.startswith("given")
    gender = F.element_at(F.split(kind, "_"), 2)
    pool = lambda names: F.create_map(*[x for g, n in names.items() for x in (F.lit(g), letters(n.lower().split()))])[gender]
    first = F.when(cyrillic, pick(pool(GIVEN_CYRILLIC), F.lit(5))).otherwise(pick(pool(GIVEN), F.lit(5)))
    syllables = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), longer + 2), lambda i: pick(letters(s), i)), "")
    stem = F.when(cyrillic, syllables(_SYLLABLES_CYRILLIC)).otherwise(syllables(_SYLLABLES))
    ending = (
        F.when(given, F.when(gender == "f", F.when(cyrillic, "на").otherwise("na")).when(gender == "m", F.when(cyrillic, "н").otherwise("n")).otherwise(""))
        .when(cyrillic, F.when(gender == "f", "ова").otherwise("ов"))
        .otherwise("n")
    )
    name = F.when(given & (nonce == 0), first).otherwise(F.concat(stem, ending))
    return (
        F.when(kind == "ip", F.when(nonce > 50, F.concat(ip, F.lit(":"), nonce.cast("string"))).otherwise(ip))
        .when(given | kind.startswith("surname"), name)
        .when(kind == "card", F.expr("checked"))
        .otherwise(F.expr("mapped"))
    ), mapped, checked


def _with_surrogates(state: DataFrame, key: str) -> DataFrame:
    final, mapped, checked = _surrogate()
    digest = F.sha2(F.concat_ws("\0", F.lit(key), "kind", F.col("nonce").cast("string"), "canon"), 512)
    state = state.withColumn("digest", digest).withColumn("mapped", mapped).withColumn("checked", checked).withColumn("surrogate", final)
    return state.drop("mapped", "checked", "digest")


def _family(kind: Column) -> Column:
    """Kinds whose surrogates must differ from one another: surnames whatever the gender."""
    return F.regexp_replace(kind, "_[mfn]_", "_")


def _distinct_surrogates(components: DataFrame, key: str) -> DataFrame:
    """A surrogate for each (kind, canon) that no other component of its family has, nor is one that occurs itself."""
    settled, open_ = None, components.withColumn("nonce", F.lit(0))
    real = components.select(_family(F.col("kind")).alias("family"), F.col("canon").alias("surrogate")).distinct()
    while True:
        tried = _with_surrogates(open_, key).withColumn("family", _family(F.col("kind"))).withColumn("first", F.lit(1))
        if settled is not None:
            tried = tried.unionByName(settled.withColumn("first", F.lit(0)))
        # Those settled before keep theirs; of new ones the least component gets it.
        winner = tried.groupBy("family", "surrogate").agg(F.min(F.struct("first", "kind", "canon")).alias("winner"))
        taken = winner.join(real.withColumn("real", F.lit(True)), ["family", "surrogate"], "left")
        judged = tried.join(taken, ["family", "surrogate"]).withColumn(
            "good", F.col("real").isNull() & (F.col("winner.kind") == F.col("kind")) & (F.col("winner.canon") == F.col("canon"))
        )
        judged = settle(judged.select("kind", "canon", "nonce", "surrogate", "family", "good"), "surrogates")
        settled = judged.where("good").drop("good")
        open_ = judged.where("not good").select("kind", "canon", (F.col("nonce") + 1).alias("nonce"))
        if not open_.limit(1).count():
            return settled.select("kind", "canon", "surrogate")


def _in_format(kind: Column, part: Column, surrogate: Column) -> Column:
    """Put a surrogate into the case and punctuation of the component it replaces."""
    slot = F.when(kind.isin("phone", "card", "national_id"), F.lit("[0-9]")).when(kind == "secret", F.lit(r"[\p{L}\p{M}\p{N}_]")).otherwise(F.lit("[A-Za-z0-9_]"))
    taken, between, fresh_chars = F.regexp_extract_all(part, slot, F.lit(0)), F.split(part, slot, -1), _chars(surrogate)
    # The last places take the surrogate; earlier ones stay, or what is left of it goes in front.
    stay, more = F.greatest(F.size(taken) - F.length(surrogate), F.lit(0)), F.greatest(F.length(surrogate) - F.size(taken), F.lit(0))
    new = F.concat(F.slice(taken, F.lit(1), stay), F.slice(fresh_chars, more + 1, F.size(taken)))
    places = F.arrays_zip(taken.alias("old"), new.alias("new"), F.slice(between, F.lit(2), F.size(taken)).alias("next"))
    cased = lambda x: F.when(kind.isin("local", "domain") & x["old"].rlike("[A-Z]"), F.upper(x["new"])).otherwise(x["new"])
    body = F.array_join(F.transform(places, lambda x: F.concat(cased(x), x["next"])), "")
    placed = F.concat(F.substring(surrogate, F.lit(1), more), F.get(between, F.lit(0)), body)
    named = F.when((part == F.upper(part)) & (F.length(part) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    is_name = kind.startswith("given") | kind.startswith("surname")
    return F.when(kind == "ip", surrogate).when(is_name, named).otherwise(placed)


def _replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention``, ``replacement`` of different mentions, without those that stay."""
    parts = mentions.select("mention", F.posexplode(_components(F.col("mention"))).alias("at", "piece")).select("mention", "at", "piece.kind", "piece.part")
    parts = settle(parts.withColumn("canon", _canonical(F.col("kind"), F.col("part"))), "mention-parts")
    replaced = parts.where("kind != '' and canon != ''")
    surrogates = _distinct_surrogates(replaced.select("kind", "canon").distinct(), key)
    new = F.when(F.col("surrogate").isNull(), F.col("part")).otherwise(_in_format(F.col("kind"), F.col("part"), F.col("surrogate")))
    joined = parts.join(surrogates, ["kind", "canon"], "left").select("mention", "at", new.alias("new"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "new")))
    return joined.groupBy("mention").agg(F.array_join(F.transform(ordered, lambda x: x["new"]), "").alias("replacement")).where("mention != replacement")


def _mentions(texts: DataFrame) -> DataFrame:
    """``digest`` and ``mentions``, in order, of every different ``text`` that has some."""
    found = texts.where(_hinted(F.col("text"))).select(F.md5("text").alias("digest"), F.regexp_extract_all("text", F.lit(_ANY), 0).alias("mentions"))
    return found.where(F.size("mentions") > 0).dropDuplicates(["digest"])


def surrogate_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every different mention in ``docs`` and what replaces it: ``mention``, ``replacement``."""
    mentions = _mentions(docs.select(F.col(text).cast("string").alias("text")))
    return _replacements(mentions.select(F.explode(F.array_distinct("mentions")).alias("mention")).distinct(), key)


def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced by its surrogate; other columns and rows stay as they are.

    Detected: e-mail addresses, telephone numbers, card numbers (with a right check digit), national ids (3-2-4 digits), IPv4
    addresses, cloud access keys, values of passwords and tokens (of any length, up to the closing quote or to white space; their
    letters and digits), and persons named after a form of address. A surrogate
    depends on ``key`` and the entity alone, has the same type, length, letter case, punctuation and script, and for persons
    the gender of the form of address. No two entities share one and none is itself an entity of the input; both are checked
    against all entities, and those that clash are derived again.

    Null and empty texts stay. Equal rows are replaced alike. Work grows with a text's length, whatever is in it. Mentions
    are looked for once in each different text and joined with their replacements place by place; only texts that have some
    are taken apart.
    """
    digest, new, has = fresh(docs, "digest", "new", "has")
    value = F.col(text).cast("string")
    found = settle(_mentions(docs.select(value.alias("text"))), "mentions")
    places = found.select("digest", F.posexplode("mentions").alias("at", "mention"))
    table = settle(_replacements(places.select("mention").distinct(), key), "replacements")
    put = places.join(table, "mention", "left").select("digest", F.struct("at", F.coalesce("replacement", "mention").alias("text")).alias("put"))
    news = put.groupBy("digest").agg(F.array_sort(F.collect_list("put"))["text"].alias(new)).withColumnRenamed("digest", digest)
    marked = docs.withColumn(has, _hinted(value))
    hinted = marked.where(F.col(has)).withColumn(digest, F.md5(value)).join(news, digest, "left")
    between = F.split(value, _ANY, -1)
    swapped = F.array_join(F.transform(F.arrays_zip(F.col(new).alias("new"), F.slice(between, F.lit(2), F.size(new)).alias("next")), lambda x: F.concat(x["new"], x["next"])), "")
    whole = F.when(F.col(new).isNull(), value).otherwise(F.concat(F.get(between, F.lit(0)), swapped))
    columns = [col(c) if c.lower() != text.lower() else whole.cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return marked.where(~F.col(has)).select(*[col(c) for c in docs.columns]).union(hinted.select(columns))
