"""Personal data replaced by keyed surrogates of the same type and form.

Entities are e-mail addresses, card numbers, IP addresses, phone numbers and names after titles or after words by which people name themselves. An entity is known by its
canonical form (lower case; digits only), so all its mentions in all documents, however written, get one surrogate. The surrogate is drawn from
SHA-256 of key, kind, canonical form and attempt:

* e-mail: letters and digits of the name and of the domain's first label are replaced by letters and digits, place by place; the rest stays.
  All addresses of a domain get the same surrogate domain;
* card: digits of the same number, with a valid check digit if the original has one; phone: digits, the country code stays;
* IP address: four numbers from 1 to 254;
* name: all parts, initials and particles after the title; a family name built from syllables of the original's script (Latin, Cyrillic, Greek, Arabic,
  Hebrew, Han, kana, Hangul), the same for all mentions of that family name, and for a full name a given name of the title's gender; titles
  such as Dr, and introductions, have no gender. In scripts without capitals a name is one word (Han, kana, Hangul: up to four characters) or two
  (Arabic, Hebrew).

Collision checks: two entities of a kind never share a surrogate, and no surrogate is an entity of the corpus. All but the first of those
that collide draw again with the next attempt, until none collide. Surrogates of e-mails, phone numbers and names grow longer with the attempts,
so there is always a free one; cards and IP addresses keep their form, in spaces of 10^12 and 254^4. A mention keeps its own punctuation, digit grouping
and capitals.

Everything is DataFrame expressions. The texts are searched once: they are written with a digest if they have an entity. Those without one pass
unchanged and are not shuffled. Others are cut into pieces at their
entities, once for each distinct text; mentions are replaced by a join with the surrogates and the pieces put together again.

The two control characters that mark matches become a third one in texts with entities. Null texts stay null and count no entities. Repeated rows are replaced alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel.llm.common import staged, start

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"

# Titles by gender (u: of either), words before one's own name, given names by gender and script, syllables of family names by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία", "السيدة", "גברת"),
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Господин", "Κύριος", "السيد", "מר"),
    "u": ("Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор", "Δρ"),
}
CUES = ("[Mm]y name is", "[Mm]ein Name ist", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]i chiamo", "[Мм]еня зовут", "[Мμ]ε λένε")
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Sofia"),
    ("latin", "m"): ("Adam", "Carlo", "David", "Erik", "Jonas", "Lucas", "Martin", "Oscar"),
    ("latin", "u"): ("Alex", "Charlie", "Dominique", "Kim", "Noa", "Robin", "Sascha", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία", "Δήμητρα", "Κατερίνα", "Βασιλική", "Ειρήνη"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Ανδρέας", "Πέτρος", "Μιχάλης", "Αλέξης"),
    ("arabic", "f"): ("فاطمة", "مريم", "ليلى", "زينب", "سارة", "نور", "هدى", "سلمى"),
    ("arabic", "m"): ("أحمد", "محمد", "علي", "حسن", "عمر", "يوسف", "خالد", "سعيد"),
    ("hebrew", "f"): ("שרה", "רחל", "לאה", "מרים", "חנה", "רות", "נעמי", "דינה"),
    ("hebrew", "m"): ("דוד", "משה", "יוסף", "אברהם", "יעקב", "שלמה", "דניאל", "אורי"),
    ("han", "f"): ("美玲", "秀英", "丽华", "静", "敏", "芳", "雪梅", "玉兰"),
    ("han", "m"): ("伟", "强", "建国", "志明", "军", "磊", "大明", "海涛"),
    ("kana", "f"): ("サクラ", "ユミ", "アイ", "ナオミ", "ケイコ", "マリ", "リエ", "ミホ"),
    ("kana", "m"): ("タロウ", "ケン", "ヒロシ", "ダイキ", "ショウ", "ユウタ", "マコト", "タケシ"),
    ("hangul", "f"): ("서연", "민지", "수진", "은주", "지영", "혜진", "유진", "미경"),
    ("hangul", "m"): ("민준", "지훈", "성호", "영수", "준호", "동현", "상우", "현우"),
}
SYLLABLES = {
    "latin": ("ba", "bel", "dor", "fen", "gar", "hol", "kem", "lan", "mar", "nor", "pel", "ros", "sten", "tal", "ver", "win"),
    "cyrillic": ("бар", "вол", "гор", "дан", "жук", "зим", "кар", "лан", "мор", "нов", "пав", "рад", "сар", "тор", "фед", "чер"),
    "greek": ("βα", "γορ", "δημ", "δρα", "ζαν", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "στα", "τσι", "φιλ", "χρι"),
    "arabic": ("با", "دو", "را", "زي", "سا", "شو", "طا", "عا", "فا", "قا", "كا", "لي", "ما", "نو", "ها", "يا"),
    "hebrew": ("בר", "גל", "דן", "הר", "זיו", "חן", "טל", "כר", "לב", "מן", "נר", "סל", "עמ", "פז", "צור", "רז"),
    "han": ("李", "王", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "徐", "孙", "胡", "朱", "高", "林"),
    "kana": ("ア", "カ", "キ", "サ", "シ", "タ", "ナ", "ニ", "ハ", "マ", "ミ", "ヤ", "ラ", "リ", "ワ", "モ"),
    "hangul": ("강", "고", "김", "남", "노", "문", "박", "배", "서", "송", "안", "오", "유", "이", "정", "최"),
}
# Unicode scripts by name, and those whose family names are drawn with two syllables instead of four.
SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "hebrew": "IsHebrew", "kana": "IsHiragana}\\p{IsKatakana", "hangul": "IsHangul", "han": "IsHan"}
SHORT = ("han", "kana", "hangul", "arabic", "hebrew")

# A name: parts, initials and particles up to a last part; or an initial alone.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "zu", "zur", "zum", "ten", "ter", "bin", "al", "y", "фон", "де")
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
_PART = r"\p{Lu}[\p{L}\p{M}'’-]+"
_CASELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsHangul}]{1,4}|[\p{IsArabic}\p{IsHebrew}&&[\p{L}\p{M}]]+(?: [\p{IsArabic}\p{IsHebrew}&&[\p{L}\p{M}]]+)?"
_NAME = rf"(?:(?:{_PART}|(?:\p{{Lu}}\.-?)+|\p{{Lu}}|{_PARTICLE}) |(?:\p{{Lu}}\.)+)*{_PART}|(?:\p{{Lu}}\.)+|\p{{Lu}}(?!\p{{L}})|{_CASELESS}"
_TITLES = "(?:" + "|".join(dict.fromkeys(form for g in TITLES.values() for t in g for form in (t, t.upper()))) + ")"
_LEAD = rf"(?:(?:(?:{'|'.join(CUES)}) )?(?:{_TITLES}\.? )+|(?:{'|'.join(CUES)}) )"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\(?(?<![0-9])[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_LEAD}(?:{_NAME})",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "card", "phone"))


def has_entity(text: Column) -> Column:
    """Whether any pattern is found. What each needs at least is looked for first, as the patterns are slow."""
    mail = F.contains(text, F.lit("@")) & text.rlike(PATTERNS["email"])
    number = text.rlike("[0-9][0-9 .()-]{5}") & text.rlike(_NUMBERS)
    return F.coalesce(mail | number | text.rlike(PATTERNS["name"]), F.lit(False))


def _kind(match: Column) -> Column:
    """Kind of a marked match, by the patterns' order."""
    out = F.when(F.contains(match, F.lit("@")), "email")
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        out.when(match.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), "ip")
        .when(match.rlike(r"\A\p{L}"), "name")
        .when(match.rlike(r"\A[0-9]") & (F.length(digits) >= 13), "card")
        .otherwise("phone")
    )


def canonical(kind: Column, match: Column) -> Column:
    """Equal for all ways to write an entity. A name carries gender and script."""
    title = F.regexp_extract(match, rf"\A(?:(?:{'|'.join(CUES)}) )?({_TITLES})\.? ", 1)
    titles = {g: [form for t in of for form in (t, t.upper())] for g, of in TITLES.items()}
    second = F.regexp_extract(match, rf"\A(?:{_TITLES}\.? )({'|'.join(titles['f'] + titles['m'])})\.? ", 1)
    gendered = F.when(second != "", second).otherwise(title)
    gender = F.when(gendered.isin(titles["f"]), "f").when(gendered.isin(titles["m"]), "m").otherwise("u")
    bare = F.regexp_replace(match, rf"\A{_LEAD}", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(bare), r"\.", ""), rf"(?<![^ ]){_PARTICLE} ", "")
    script = F.lit("latin")
    for name, block in reversed(SCRIPTS.items()):
        script = F.when(bare.rlike(rf"[\p{{{block}}}]"), name).otherwise(script)
    return (
        F.when(kind == "email", F.lower(match))
        .when(kind == "ip", match)
        .when(kind == "name", F.concat_ws("/", gender, script, plain))
        .when((kind == "phone") & match.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(match, "[^0-9]", "")))
        .otherwise(F.regexp_replace(match, "[^0-9]", ""))
    )


def _number(digest: Column, place: Column | int, base: Column | int) -> Column:
    """A number below ``base`` from the digest, another for each place; digests are 64 hex digits, read two at a time."""
    at = F.pmod(F.lit(place) if isinstance(place, int) else place, F.lit(31)) * 2 + 1
    pair = F.conv(F.substr(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int")
    return F.pmod(pair + F.lit(place) * 7 if isinstance(place, int) else pair + place * 7, F.lit(base)).cast("int")


def _letters_and_digits(text: Column, digest: Column) -> Column:
    """Each letter by a letter, each digit by a digit, the rest as it is."""
    chars = F.split(text, "")
    swap = lambda c, i: (
        F.when(c.rlike("[0-9]"), _number(digest, i, 10).cast("string"))
        .when(c.rlike("[a-z]"), F.char(_number(digest, i, 26) + 97))
        .otherwise(c)
    )
    return F.array_join(F.transform(chars, swap), "")


def _checksum(digits: Column) -> Column:
    """Sum of the card check: from the right, every second digit doubled, nines cast out."""
    chars = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(chars, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _later_syllable(syllables: Column, digest: Column) -> Callable[[Column], Column]:
    """The syllable that the k-th redraw adds; the first draw (0) adds none."""
    return lambda k: F.when(k > 0, F.element_at(syllables, _number(digest, k * 2 - 1, 16) + 1)).otherwise("")


def _syllables() -> Column:
    return _lookup(SYLLABLES)


def _given() -> Column:
    """Given names by gender and script; without a gender those of both, unless there are names of either."""
    return _lookup({f"{g}/{s}": GIVEN.get((s, g)) or GIVEN[s, "f"] + GIVEN[s, "m"] for s in SYLLABLES for g in TITLES})


def _lookup(lists: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[c for k, of in lists.items() for c in (F.lit(k), F.array(*map(F.lit, of)))])


def surrogate(kind: Column, entity: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate's canonical form. E-mails and phone numbers grow from the third redraw on, names from the first."""
    more = F.sha2(F.concat(F.lit("more"), digest), 256)
    grown = F.greatest(attempt - 2, F.lit(0))
    first = F.when(kind == "domain", F.substring_index(entity, ".", 1)).otherwise(F.substring_index(entity, "@", 1))
    letters = F.substr(F.translate(more, "0123456789", "ghijklmnop"), F.lit(1), grown + (~first.rlike("[a-z0-9]")).cast("int"))
    mail = F.concat(_letters_and_digits(first, digest), letters, F.substr(entity, F.length(first) + 1))
    body = _letters_and_digits(F.substr(entity, F.lit(1), F.length(entity) - 1), digest)
    check = F.pmod(F.lit(10) - F.pmod(_checksum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(_checksum(entity), F.lit(10)) == 0
    last = F.when(valid, check).otherwise(F.pmod(check + 1 + _number(digest, 20, 9), F.lit(10)))
    card = F.concat(body, last.cast("string"))
    country = F.when(entity.startswith("+"), F.substr(entity, F.lit(1), F.greatest(F.length(entity) - 10, F.lit(2)))).otherwise(F.lit(""))
    phone = F.concat(country, _letters_and_digits(F.substr(entity, F.length(country) + 1), digest), F.substr(F.translate(more, "abcdef", "012345"), F.lit(1), grown))
    ip = F.concat_ws(".", *[(_number(digest, i, 254) + 1).cast("string") for i in range(4)])
    script = F.split_part(entity, F.lit("/"), F.when(kind == "family", 1).otherwise(2))
    syllables = F.element_at(_syllables(), script)
    tail = F.array_join(F.transform(F.sequence(F.lit(0), attempt), _later_syllable(syllables, more)), "")
    stem = F.transform(F.sequence(F.lit(1), F.when(script.isin(*SHORT), 2).otherwise(4)), lambda k: F.element_at(syllables, _number(digest, k * 2 - 1, 16) + 1))
    family = F.concat(script, F.lit("/"), F.initcap(F.concat(F.array_join(stem, ""), tail)))
    sort = F.substring_index(entity, "/", 2)
    given = F.element_at(_given(), sort)
    name = F.concat(sort, F.lit("/"), F.element_at(given, _number(digest, 0, F.size(given)) + 1), tail, F.lit(" "), F.substring_index(entity, " ", -1))
    return F.when(kind.isin("email", "domain"), mail).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "family", family).when(kind == "name", name)


def _draw(entities: DataFrame, secret: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), "kind", "entity", F.col("attempt").cast("string")), 256)
    return entities.withColumn("digest", digest).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("digest"), F.col("attempt"))).drop("digest")


def _family(entity: Column) -> Column:
    """Script and family name, the last part, of a name."""
    return F.concat_ws("/", F.split_part(entity, F.lit("/"), F.lit(2)), F.substring_index(F.split_part(entity, F.lit("/"), F.lit(3)), " ", -1))


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """kind, entity, surrogate for distinct entities (kind, entity): keyed, distinct within a kind, none an entity itself.

    Family names are drawn as entities of their own. A full name draws a given name that no other one with its family name
    has, and both kinds of mention take the family name's surrogate, so what is printed is distinct. Domains of addresses are drawn
    in the same way; a domain whose first label has neither letter nor digit stays.
    """
    one = (F.col("kind") == "name") & ~F.contains("entity", F.lit(" "))
    families = entities.where(F.col("kind") == "name").select(F.lit("family").alias("kind"), _family(F.col("entity")).alias("entity")).distinct()
    domain = F.substring_index("entity", "@", -1)
    domains = entities.where((F.col("kind") == "email") & domain.rlike(r"\A[^.]*[a-z0-9]")).select(F.lit("domain").alias("kind"), domain.alias("entity")).distinct()
    drawn = _settled(entities.where(~one).unionByName(families).unionByName(domains), secret)
    family = drawn.where(F.col("kind") == "family").select(F.col("entity").alias("family"), F.split_part("surrogate", F.lit("/"), F.lit(2)).alias("last"))
    names = entities.where(one).withColumn("surrogate", F.col("entity")).unionByName(drawn.where(F.col("kind") == "name")).withColumn("family", _family(F.col("entity")))
    first = F.when(F.contains("entity", F.lit(" ")), F.concat(F.substring_index("surrogate", " ", 1), F.lit(" "))).otherwise(F.regexp_extract("entity", r"\A(./\w+/)", 1))
    named = names.join(family, "family").select("kind", "entity", F.concat(first, "last").alias("surrogate"))
    there = drawn.where(F.col("kind") == "domain").select(F.col("entity").alias("domain"), F.col("surrogate").alias("other"))
    mails = drawn.where(F.col("kind") == "email").withColumn("domain", domain).join(there, "domain", "left")
    mailed = mails.select("kind", "entity", F.concat(F.substring_index("surrogate", "@", 1), F.lit("@"), F.coalesce("other", "domain")).alias("surrogate"))
    return drawn.where(~F.col("kind").isin("family", "name", "domain", "email")).unionByName(named).unionByName(mailed)


def _settled(entities: DataFrame, secret: str) -> DataFrame:
    """Drawn again until none collide."""
    drawn = staged(_draw(entities.withColumn("attempt", F.lit(0)), secret), "pii-surrogates")
    while True:
        # The entity that keeps a surrogate is the one with the fewest attempts, then the first by name. A form
        # compared here is in lower case, as mentions are.
        # Genders do not count, as they are printed only in the title.
        form = F.regexp_replace(F.lower("surrogate"), r"\A[fmu]/", "")
        keeper = drawn.groupBy("kind", form.alias("form")).agg(F.min(F.struct("attempt", "entity")).alias("keeper"))
        real = drawn.select("kind", F.regexp_replace(F.lower("entity"), r"\A[fmu]/", "").alias("form"), F.lit(True).alias("real")).distinct()
        judged = drawn.withColumn("form", form).join(keeper, ["kind", "form"]).join(real, ["kind", "form"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.col("keeper.entity") != F.col("entity"))
        judged = staged(judged.select("kind", "entity", "attempt", "surrogate", again.alias("again")), "pii-judged")
        if not judged.where("again").limit(1).count():
            return judged.select("kind", "entity", "surrogate")
        kept = judged.where(~F.col("again")).drop("again")
        redrawn = _draw(judged.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), secret)
        drawn = staged(kept.unionByName(redrawn), "pii-surrogates")


def mention(kind: Column, match: Column, chosen: Column) -> Column:
    """A surrogate in the layout of a mention: its punctuation, grouping and capitals."""
    digits = F.split(F.regexp_replace(chosen, "[^0-9]", ""), "")
    chars = F.split(match, "")
    # The how-manieth digit each character is: digits up to it.
    upto = lambda i: F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), "[^0-9]", ""))
    extra = F.array_join(F.slice(digits, F.length(F.regexp_replace(match, "[^0-9]", "")) + 1, F.size(digits)), "")
    laid = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(digits, F.greatest(upto(i), F.lit(1)))).otherwise(c)), "")
    side = lambda n: F.array_join(F.zip_with(F.split(F.substring_index(match, "@", n), ""), F.split(F.substring_index(chosen, "@", n), ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    cased = F.concat(side(1), F.lit("@"), side(-1))
    lead = F.regexp_extract(match, rf"\A({_LEAD})", 1)
    bare = F.substr(match, F.length(lead) + 1)
    printed = F.regexp_extract(chosen, r"\A./\w+/(.*)\z", 1)
    capitals = bare.rlike(r"\p{Lu}{2}") & ~bare.rlike(r"\p{Ll}")
    named = F.concat(lead, F.when(capitals, F.upper(printed)).otherwise(printed))
    return F.when(kind == "email", cased).when(kind == "ip", chosen).when(kind == "name", named).otherwise(F.concat(laid, extra))


def replace(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with all entities replaced, and the number of mentions of each kind (n_email ...)."""
    start(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counts = [f"n_{k}" for k in KINDS]
    read = staged(narrow.withColumn("digest", F.when(has_entity(F.col("text")), F.sha2("text", 256))), "pii-texts")
    plain = read.where("digest is null").select("key", "text", *[F.lit(0).cast("long").alias(n) for n in counts])
    hit = read.where("digest is not null")
    once = hit.groupBy("digest").agg(F.first("text").alias("text"))
    clean = F.translate("text", _OPEN + _CLOSE, _OTHER + _OTHER)
    cut = once.select("digest", F.posexplode(F.split(F.regexp_replace(clean, f"({_ANY})", f"{_OPEN}$1{_CLOSE}"), _OPEN)).alias("nr", "piece"))
    match = F.when(F.col("nr") > 0, F.substring_index("piece", _CLOSE, 1))
    tail = F.when(F.col("nr") > 0, F.expr("substring(piece, length(match) + 2)")).otherwise(F.col("piece"))
    cut = cut.withColumn("match", match).withColumn("tail", tail).withColumn("kind", F.when(F.col("match").isNotNull(), _kind(F.col("match"))))
    cut = staged(cut.select("digest", "nr", "match", "tail", "kind", canonical(F.col("kind"), F.col("match")).alias("entity")), "pii-pieces")
    chosen = assign(cut.where("match is not null").select("kind", "entity").distinct(), secret)
    laid = cut.join(chosen, ["kind", "entity"], "left").select("digest", "nr", "kind", F.concat(F.coalesce(mention(F.col("kind"), F.col("match"), F.col("surrogate")), F.lit("")), "tail").alias("piece"))
    rebuilt = laid.groupBy("digest").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "piece"))), lambda p: p["piece"]), "").alias("text"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
    )
    out = hit.select("key", "digest").join(rebuilt, "digest").select("key", "text", *counts)
    return plain.unionByName(out).withColumnRenamed("key", key).withColumnRenamed("text", text)
