"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

Entities are found by pattern. Each kind has a canonical form (the digits of a number, the parts of a name), and each
canonical value one surrogate, drawn from a keyed hash: so the same person or number gets the same surrogate in all
documents, however it is written. A family name has its surrogate by itself and so has a given name, so "Mr John Smith",
"John Smith" and "Mr Smith" stay one person. A surrogate keeps its surface's shape: separators, lengths, letter case, a
phone's country code, the check digits of cards and IBANs, a name's title, gender and script. Surrogates that coincide
with one another, or with a value that occurs, are drawn again until all are distinct; so distinct values stay distinct.

Names are those behind a title, and those that begin with one of the given names listed here; a name with neither is
not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime

# Titles by gender (neither: _TITLE), given names by gender and script, syllables of family names.
_MALE = "Mr|Mister|Sir|Herrn|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος|Κύριο"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Госпожа|Κυρία"
_TITLE = "Dr|Prof|Doctor|Professor|Doktor|Docteur|Доктор"
_GIVEN = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Louis Martin Nolan Oscar Peter Quentin Robert Simon Thomas".split(),
    ("female", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Tania Vera".split(),
    ("male", "cyrillic"): "Иван Пётр Антон Борис Виктор Глеб Денис Егор Игорь Кирилл".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Инна Мария Нина Ольга Софья".split(),
    ("male", "greek"): "Νίκος Γιώργος Πέτρος Κώστας Ανδρέας Στέφανος".split(),
    ("female", "greek"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Δήμητρα".split(),
}
_MORE_GIVEN = {
    "male": "James John Michael William Richard Joseph Charles Daniel Paul Mark George Hans Klaus Jürgen Pierre Jean José Juan Carlos Miguel".split(),
    "female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jane Sarah Karen Alice Ursula Sabine Petra Marie Claire Carmen Ana Isabel Lucía".split(),
}
_FAMILY = {
    "latin": "bar ben dal den fer gan har kel lan mar nor pol ran sel tan tor val ver wen zan".split(),
    "cyrillic": "бар вел гор дан жар зин кол лар мир нов пол рин сан тор чер".split(),
    "greek": "βαλ γαρ δαν καλ λαμ μαρ νικ παν ρος σαρ ταλ χαρ".split(),
}
#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_OF_GENDER = {g: sorted({n for (h, _), names in _GIVEN.items() if h == g for n in names} | set(_MORE_GIVEN[g])) for g in ("male", "female")}
_TITLES = rf"(?:{_FEMALE}|{_MALE}|{_TITLE})"
_KNOWN = rf"(?:{'|'.join([*_OF_GENDER['male'], *_OF_GENDER['female']])})"
_WORD = r"\p{Lu}\p{Ll}+"
_NAME = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLES}\.? ){{1,3}}{_WORD}(?:[ -]{_WORD})?|{_KNOWN} {_WORD})"

#: Kind and pattern, in order of precedence where two begin at one place.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"\b(?:sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("name", _NAME),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What any entity has somewhere, so that every match of PATTERN holds one of HINT: texts without it are done with.
#: Numbers of any kind have two digits side by side or with one separator between them; a hexadecimal secret may have none.
HINT = rf"\d[ .-]?\d|@|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLES}|{_KNOWN})[. ]|sk-|AKIA|gh[pousr]_|[0-9a-f]{{32}}|[0-9A-F]{{32}}"
#: Draws from which on a value's surrogate may leave its shape: nearly all of the shape's values are taken.
CROWDED = 8
#: ... and after which a shape's values are taken for used up.
MOST_ATTEMPTS = 60


def _kind(value: Column) -> Column:
    out = F.lit(PATTERNS[-1][0])
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _canonical(kind: Column, value: Column) -> Column:
    """Of values that aren't names."""
    bare = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise("+1"), bare))
        .when(kind.isin("ssn", "card"), bare)
        .when(kind == "iban", F.upper(F.regexp_replace(value, " ", "")))
        .when(kind == "email", F.lower(value))
        .otherwise(value)
    )


def _title_of(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{_TITLES}\.? )*(?={_WORD})", 0)


def _parts(kind: Column, value: Column) -> Column:
    """(i, part, canonical) of a value: the words of a name, else the value. A name's only word, and both of words with
    a hyphen, are family names; a given name has the gender of the title, or what the list says, or any."""
    title = _title_of(value)
    words = F.split(F.substr(value, F.length(title) + 1), "[ -]")
    two = (F.size(words) == 2) & ~F.substr(value, F.length(title) + 1).contains("-")
    first = F.element_at(words, 1)
    listed = F.when(first.isin(_OF_GENDER["female"]), "female").when(first.isin(_OF_GENDER["male"]), "male").otherwise("any")
    gender = F.when(title.rlike(rf"(?:{_FEMALE})\.? "), "female").when(title.rlike(rf"(?:{_MALE})\.? "), "male").otherwise(listed)
    part = lambda i, w: F.struct(i.alias("i"), F.when(two & (i == 0), "given").otherwise("family").alias("part"), F.when(two & (i == 0), F.concat(gender, F.lit("|"), w)).otherwise(w).alias("canonical"))
    whole = F.array(F.struct(F.lit(0).alias("i"), kind.alias("part"), _canonical(kind, value).alias("canonical")))
    return F.when(kind == "name", F.transform(words, lambda w, i: part(i, w))).otherwise(whole)


def _plain(canonical: Column) -> Column:
    """A canonical value without the gender."""
    return F.regexp_replace(canonical, r"^(?:male|female|any)\|", "")


def _draw(seed: Column, i: Column, below: int) -> Column:
    """The i-th number below a small bound of a keyed hash (i from 0, a Column); 60 to each block of the hash."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 60).cast("string")), 256)
    return F.pmod(F.conv(F.substr(block, (i % 60 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"), F.lit(below))


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (number + 1).cast("int"))


def _syllables(items: list[str], seed: Column):
    return lambda i: _pick(items, _draw(seed, i, len(items)))


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over all digits; divisible by ten if the check digit is right."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _reshaped(value: Column, seed: Column, fixed: Column) -> Column:
    """Each letter or digit by another of its class; `fixed(c, i)` says which stay."""
    hexes = value.rlike("^[0-9a-fA-F]+$")

    def other(c: Column, i: Column) -> Column:
        letters = F.when(hexes, _pick(list("abcdef"), _draw(seed, i, 6))).otherwise(_pick(list("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i, 26)))
        return F.when(fixed(c, i), c).when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letters).when(c.rlike("[A-Z]"), F.upper(letters)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _mod_97(text: Column) -> Column:
    """Of a text of digits and capitals, which count from 10: the rest of the division by 97."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("long")) % 97).when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def _surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A canonical value's surrogate in canonical form; another for each attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    crowded = attempt >= CROWDED
    # a phone keeps its country code and the digit behind it, other numbers their first digit
    code = F.when(value.rlike(r"^\+[17]"), 1).when(value.rlike(rf"^\+(?:{_TWO_DIGITS})"), 2).otherwise(3)
    kept = F.when(kind == "phone", F.when(crowded, 1 + code).otherwise(2 + code)).when(crowded, 0).otherwise(1)
    digits = _reshaped(value, seed, lambda c, i: i < kept)
    body = F.substr(digits, F.lit(1), F.length(value) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    wrong = F.pmod(check + 1 + _draw(seed, F.lit(59), 9), F.lit(10))
    card = F.concat(body, F.when(_luhn(value) % 10 == 0, check).otherwise(wrong).cast("string"))
    ip = F.concat_ws(".", *((_draw(seed, F.lit(5 * k), 254) + 1).cast("string") for k in range(4)))
    # an address keeps its last label, an IBAN its country
    at_end = F.length(value) - F.length(F.regexp_extract(value, r"[^.]*$", 0))
    longer = F.array_join(F.transform(F.sequence(F.lit(CROWDED), F.greatest(attempt, F.lit(CROWDED))), lambda i: _pick(list("abcdefghijklmnopqrstuvwxyz"), _draw(seed, 50 + i % 9, 26))), "")
    email = F.concat(F.when(crowded, longer).otherwise(""), _reshaped(value, seed, lambda c, i: i >= at_end))
    account = _reshaped(F.substr(value, F.lit(5)), seed, lambda c, i: F.lit(False))
    country = F.substr(value, F.lit(1), F.lit(2))
    right = F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    is_right = _mod_97(F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))) == 1
    odd = F.lpad(F.pmod(right.cast("int") + 1 + _draw(seed, F.lit(59), 90), F.lit(97)).cast("string"), 2, "0")
    iban = F.concat(country, F.when(is_right, right).otherwise(odd), account)
    secret = _reshaped(value, seed, lambda c, i: i < F.length(F.regexp_extract(value, "^(?:sk-|AKIA|gh[pousr]_)?", 0)))
    name = _plain(value)
    gender = F.regexp_extract(value, r"^(\w+)\|", 1)
    gender = F.when(gender == "any", _pick(["male", "female"], _draw(seed, F.lit(40), 2))).otherwise(gender)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    given, family, end = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for (g, s), names in _GIVEN.items():
        given = F.when((gender == g) & (script == s), _pick(names, _draw(seed, F.lit(0), len(names)))).otherwise(given)
    for s, syllables in _FAMILY.items():  # more syllables at each attempt: room for all
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), _syllables(syllables, seed)), "")
        family = F.when(script == s, F.initcap(made)).otherwise(family)
        more = F.array_join(F.transform(F.sequence(F.lit(2), attempt + 1), _syllables(syllables, seed)), "")
        end = F.when(script == s, more).otherwise(end)
    # the given names of the list are few: from the second attempt on they grow
    given = F.when(attempt < 1, given).otherwise(F.concat(given, end))
    return F.when(kind == "card", card).when(kind.isin("phone", "ssn"), digits).when(kind == "ip", ip).when(kind == "email", email).when(kind == "iban", iban).when(kind == "family", family).when(kind == "given", given).otherwise(secret)


def _written_as(kind: Column, surface: Column, surrogates: Column) -> Column:
    """The surrogates of a surface's parts as the surface is written."""
    one = F.element_at(surrogates, 1)
    signs = F.regexp_replace(one, r"^\+", "")
    # a phone without its country code ends as the whole number does
    many = F.length(F.regexp_replace(surface, r"[^0-9A-Za-z]", ""))
    signs = F.substr(signs, F.greatest(F.length(signs) - many, F.lit(0)) + 1)
    step = F.aggregate(
        F.split(surface, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substr(signs, acc["i"], F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i"))),
    )["out"]
    cased = F.array_join(F.zip_with(F.split(one, ""), F.split(surface, ""), lambda s, c: F.when(F.coalesce(c, F.lit("")).rlike("[A-Z]"), F.upper(s)).otherwise(F.coalesce(s, F.lit("")))), "")
    title = _title_of(surface)
    between = F.regexp_extract(F.substr(surface, F.length(title) + 1), "[ -]", 0)
    return (
        F.when(kind.isin("phone", "ssn", "card", "iban"), step)
        .when(kind == "email", cased)
        .when(kind == "name", F.concat(title, F.array_join(surrogates, "\0")))
        .otherwise(one)
    ).alias("shaped"), between


def mapping(surfaces: DataFrame, key: str) -> DataFrame:
    """(surface, kind, canonical, surrogate, replacement) for distinct `surface` values; of a name's parts, canonical and
    surrogate are joined by a space.

    Each round draws anew for the values whose surrogate another (smaller) value has, or that occurs itself. A value's
    shape is left when CROWDED draws gave nothing; where MOST_ATTEMPTS give nothing, the values of a fixed shape (as of
    addresses of machines) are used up, which is an error: two values would become one."""
    known = surfaces.withColumn("kind", _kind(F.col("surface")))
    each = known.select("surface", "kind", F.explode(_parts(F.col("kind"), F.col("surface"))).alias("p")).select("surface", "kind", "p.*")
    each = runtime.written(each)
    values = each.select("part", "canonical").distinct()
    draw = lambda attempt: _surrogate(F.col("part"), F.col("canonical"), attempt, key)
    drawn = runtime.written(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(F.col("attempt"))))
    for _ in range(MOST_ATTEMPTS):
        owner = drawn.groupBy("part", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("owner"))
        real = drawn.select("part", _plain(F.col("canonical")).alias("surrogate"), F.lit(True).alias("occurs")).distinct()
        checked = drawn.join(owner, ["part", "surrogate"]).join(real, ["part", "surrogate"], "left")
        checked = checked.withColumn("clash", (F.col("owner.canonical") != F.col("canonical")) | F.col("occurs").isNotNull())
        if checked.filter("clash").isEmpty():
            break
        again = F.col("attempt") + F.when(F.col("clash"), 1).otherwise(0)
        redrawn = F.when(F.col("clash"), draw(again)).otherwise(F.col("surrogate"))
        before, drawn = drawn, runtime.written(checked.select("part", "canonical", again.alias("attempt"), redrawn.alias("surrogate")))
        runtime.dropped(before)
    else:
        raise RuntimeError("there are more distinct values of a shape than the shape has room for")
    whole = each.join(drawn.drop("attempt"), ["part", "canonical"]).groupBy("surface", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "canonical", "surrogate"))).alias("p"))
    shaped, between = _written_as(F.col("kind"), F.col("surface"), F.col("p.surrogate"))
    joined = lambda c: F.array_join(F.col(f"p.{c}"), " ").alias(c)
    out = whole.select("surface", "kind", joined("canonical"), joined("surrogate"), shaped, between.alias("between"))
    return out.withColumn("replacement", F.replace("shaped", F.lit("\0"), "between")).drop("shaped", "between")


def replaced(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with every entity in `text` replaced, and if named a column with their number.

    Null and empty texts stay as they are, with 0 entities; so does all text outside entities. Repeated rows get the
    same text. doc_id isn't needed to be set or unique. An empty table gives an empty result; texts are read whole.
    Texts without any hint of an entity aren't shuffled; values are summed up before they are, and a value that very many
    texts have is a skewed key of an inner join, which Spark splits as it runs."""
    text = F.col("text")
    source = docs.drop(count) if count else docs
    row, found, new = (runtime.fresh(source, n) for n in ("row", "found", "new"))
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    # a long text's hash is one value of the row, not a place in the table: repeated rows share it
    marked = source.withColumn(found, F.when(hinted, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    hits = marked.filter(F.size(found) > 0).withColumn(row, F.sha2(text, 256))
    each = hits.select(row, found).dropDuplicates([row]).select(F.col(row).alias("row"), F.posexplode(found).alias("pos", "surface"))
    each = runtime.written(each)
    known = runtime.written(mapping(each.select("surface").distinct(), key).select("surface", "replacement"))
    lists = each.join(known, "surface").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "replacement"))).alias("r"))
    lists = lists.select(F.col("row").alias(row), F.transform("r", lambda x: x["replacement"]).alias(new))
    between = F.split(text, PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    names = [F.col(f"`{c}`") for c in source.columns]
    done = hits.join(lists, row).withColumn("text", whole)
    more = lambda n: [n.cast("long").alias(count)] if count else []
    rest = marked.filter(F.size(found) == 0)
    return done.select(*names, *more(F.size(new))).unionByName(rest.select(*names, *more(F.lit(0))))


def cleaned(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_chars (if there is one) counted anew; same columns."""
    out = replaced(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
