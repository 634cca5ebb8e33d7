"""Surrogates for personal data, in DataFrame operations alone (operator 8).

Detection is one regular expression over whole texts.  Documents without a find
go through as they are; the others are cut once into a list of literal pieces and
finds, and only the finds move:

1. a titled name (up to four parts, with initials, particles, hyphens and
   apostrophes) is cut into its parts, and later bare mentions of these parts in the
   same document are finds as well, so a person stays one person;
2. every distinct entity (kind, canonical form) gets a keyed surrogate of its own
   kind: digits for digits, letters for letters of the same script, hexadecimal
   for hexadecimal, octets for octets, names of the same gender and script; card numbers
   keep their check sum class, IBANs get valid check digits, e-mail addresses of one
   domain keep a common domain;
3. surrogates are checked against each other and against all entities found, over all
   kinds that could look alike; those that clash are keyed again until all are
   distinct (a bijection on the corpus);
4. a mention takes the surrogate in its own format: case, blanks and signs stay.

The canonical form ignores case and separators, so mentions of one entity stay
one entity in all documents.  The key is a parameter; equal keys give equal
surrogates unless a clash forces a new one.  Names without a title, postal addresses
and dates of birth are not looked for.

Results for odd input: null text stays null with no finds, empty text stays
empty, very long texts are read whole, repeated rows and null ids are rows like
others, an empty table gives no rows, columns of the table are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evigrid.session import stored

#: Titles that show a person's gender, and some that do not.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|Doña|Госпожа|госпожа|г-жа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|господин|г-н"
NEUTRAL = "Dr|Prof"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])"
GIVEN = r"(?<=\b(?:token|secret|password|passwd|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)(?<![\w/+.-])[\w/+.-]{8,}(?![\w/+.-])"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IPV6 = r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\w:])"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)|(?<![\d.,-] ?)\d{3} \d{3} \d{4}(?! ?\d)|(?<![\d.,-] ?)0\d{2,4}[ /]\d{6,8}(?! ?\d)"
)
CARD = r"(?<![\d.])\d{13,19}(?!\d)|(?<!\d)\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Part of a name behind a title: an initial, a capitalised word with inner hyphens or apostrophes, or capitals alone.
PART = r"(?:(?:[OD]['’])?\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}?\p{Ll}+)*|\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})*|\p{Lu}(?=\.))(?![\p{L}\p{N}])"
PARTICLE = r"(?:(?:van|von|der|den|de|del|della|di|da|du|la|le|zu|y)\b ){0,3}"
UPPER = f"{FEMALE}|{MALE}|{NEUTRAL}".upper()
UNIT = rf"{PARTICLE}{PART}(?:(?<=(?<!\p{{L}})\p{{Lu}})\.)?"
NAME = rf"\b(?:{FEMALE}|{MALE}|{NEUTRAL}|{UPPER})\b\.? {UNIT}(?: {UNIT}){{0,3}}|\b(?:mr|mrs)\b\.? \p{{Ll}}{{2,}}(?![\p{{L}}\p{{N}}])"
FIND = "|".join((EMAIL, SECRET, GIVEN, IP, IPV6, IBAN, PHONE, CARD, SSN, NAME))
#: Alphabets inside which letters are replaced.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
SYLLABLES = "ba|be|bo|da|de|do|fa|fe|ga|go|ka|ke|ko|la|le|lo|ma|me|mo|na|ne|no|pa|pe|ra|re|ro|sa|se|ta|te|to"
ENDINGS = {"f": "na|la|ra|sa|lia|nia|ria|tia", "m": "n|r|s|k|lf|rd|ns|rt"}
CYRILLIC = "ба|бо|ве|во|да|до|за|ка|ко|ла|ло|ма|ме|но|па|ра|ре|са|се|та|то"
CYRILLIC_ENDINGS = {"f": "на|ва|ла|ра|ева|ина", "m": "н|в|л|р|ев|ин"}
ATTEMPTS = 20


def hint(text: str) -> Column:
    """Whether a text can have a find at all: a digit, one of @ = : or a title; plain searches settle most texts."""
    titles = [F.contains(text, F.lit(t)) for t in (f"{FEMALE}|{MALE}|{NEUTRAL}|{UPPER}|mr |mr. |mrs ").split("|")]
    found = F.col(text).rlike("[0-9@=:]")
    for t in titles:
        found = found | t
    return found


def kind(mention: Column) -> Column:
    titled = lambda of: mention.rlike(rf"^(?:{of}|{of.upper()})\b\.? ")
    return (
        F.when(mention.contains("@"), "email").when(titled(f"{FEMALE}|mrs"), "name_f").when(titled(f"{MALE}|mr"), "name_m").when(titled(NEUTRAL), "name_n")
        .when(mention.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d[\d -]{12,}$"), "card").when(mention.rlike(r"^[+(\d][\d ()./-]+$"), "phone").when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), "hex")
        .when(mention.rlike("^[0-9a-fA-F:]+:[0-9a-fA-F:]+$"), "hex").when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$"), "iban").otherwise("secret")
    )


def canonical(mention: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("ssn", "card", "phone"), F.regexp_replace(mention, r"\D", "")).when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", mention).otherwise(F.lower(mention))
    )


#: Kinds whose surrogates could be taken for each other.
def _space(kind: Column) -> Column:
    return F.when(kind.isin("ssn", "card", "phone"), "digits").when(kind.startswith("name"), "name").otherwise(kind)


def _keyed(key: str, *of) -> Column:
    """128 keyed hexadecimal digits; the key stands on both sides of the input."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *of, F.lit(key)).cast("binary"), 512)


def _number(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i * 3) % 126 + 1, F.lit(3)), 16, 10).cast("int")


def _spell(text: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Each digit and letter replaced inside its own alphabet and case."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        out = F.when(c.between("0", "9"), (n % 10).cast("string"))
        low = F.lower(c)
        for a in ("abcdef",) if hexadecimal else ALPHABETS:
            put = F.substring(F.lit(a), n % len(a) + 1, F.lit(1))
            out = out.when(F.lit(a).contains(low), F.when((c == low) | (F.length(F.upper(put)) > 1), put).otherwise(F.upper(put)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _checksum(digits: Column) -> Column:
    """Sum of the card check modulo 10, counted from the right."""
    step = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int")), step), F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, a letter counting 10 to 35."""
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of a canonical entity."""
    h = _keyed(key, kind, entity, attempt.cast("string"))
    domain, local = F.substring_index(entity, "@", -1), F.regexp_replace(entity, "@[^@]*$", "")
    zone = F.regexp_extract(domain, r"\.[^.]*$", 0)
    name = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_spell(local, h), F.lit("@"), _spell(name, _keyed(key, F.lit("domain"), domain)), zone)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.when(i == 0, _number(h, i) % 223 + 1).otherwise(_number(h, i) % 256)).cast("string")), ".")
    digits = F.concat(F.substring(entity, 1, 1), _spell(F.regexp_replace(entity, "^.", ""), h))
    body = F.regexp_replace(digits, ".$", "0")
    card = F.concat(F.regexp_replace(digits, ".$", ""), ((_checksum(entity) - _checksum(body) + 10) % 10).cast("string"))
    pick = lambda of, i: F.element_at(F.split(F.lit(of), r"\|"), _number(h, F.lit(i)) % (of.count("|") + 1) + 1)
    female = (kind == "name_f") | ((kind == "name_n") & (_number(h, F.lit(5)) % 2 == 0))

    def built(syllables: str, endings: dict) -> Column:
        stem = F.concat(*(pick(syllables, i) for i in range(3)))
        return F.concat(stem, F.when(female, pick(endings["f"], 3)).otherwise(pick(endings["m"], 3)))

    name = (
        F.when(F.length(entity) == 1, _spell(entity, h)).when(entity.rlike(r"^[\p{IsLatin}'’-]+$"), built(SYLLABLES, ENDINGS))
        .when(entity.rlike(r"^[\p{IsCyrillic}'’-]+$"), built(CYRILLIC, CYRILLIC_ENDINGS)).otherwise(_spell(entity, h))
    )
    bban = _spell(F.regexp_replace(entity, "^....", ""), h)
    iban = F.concat(F.substring(entity, 1, 2), F.lpad((98 - _mod97(F.concat(bban, F.substring(entity, 1, 2), F.lit("00")))).cast("string"), 2, "0"), bban)
    made = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", digits).when(kind == "iban", iban).when(kind.startswith("name"), name)
        .when(kind == "hex", _spell(entity, h, hexadecimal=True)).otherwise(_spell(entity, h))
    )
    # a form with few values (such as one letter) grows once it is used up
    more = F.when(kind.isin("email", "name_f", "name_m", "name_n", "secret"), F.translate(F.substring(h, 1, 8), "0123456789", "ghijklmnop")).otherwise(F.translate(F.substring(h, 1, 8), "abcdef", "123456"))
    return F.when((attempt < ATTEMPTS) | (kind == "ip"), made).when(kind == "email", F.concat(more, made)).otherwise(F.concat(made, more))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity) -> surrogate, distinct among all kinds that look alike and no entity of the corpus.

    Each turn keys what still clashes anew; what is settled is not touched again.
    """
    entities = stored(entities.select("kind", "entity", _space(F.col("kind")).alias("space")).distinct())
    settled, pending = None, entities.withColumn("attempt", F.lit(0))
    while True:
        made = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        real = entities.select("space", F.col("entity").alias("surrogate"), F.lit(1).alias("_real")).distinct()
        made = made.join(real, ["space", "surrogate"], "left")
        if settled is not None:
            made = made.join(settled.select("space", "surrogate", F.lit(1).alias("_used")), ["space", "surrogate"], "left")
        else:
            made = made.withColumn("_used", F.lit(None).cast("int"))
        first = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("entity", "kind")) == 1
        made = stored(made.withColumn("good", first & F.col("_real").isNull() & F.col("_used").isNull()))
        good = made.where("good").select("kind", "entity", "space", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        pending = made.where("not good").select("kind", "entity", "space", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled.drop("space")


def _format(mention: Column, kind: Column, made: Column) -> Column:
    """A canonical surrogate in the format of a mention."""
    chars = F.split(mention, "")
    marks = F.when(kind == "iban", r"[^ ]").otherwise(F.lit(r"\d"))

    def digit(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), F.when(kind == "iban", " ").otherwise(r"\D"), ""))
        return F.when(F.regexp_like(c, marks), F.substring(made, at, F.lit(1))).otherwise(c)

    size = F.length(F.regexp_replace(mention, F.when(kind == "iban", " ").otherwise(r"\D"), ""))
    in_place = F.array_join(F.transform(chars, digit), "")
    grown = F.when(F.length(made) > size, F.substring(made, size + 1, F.length(made))).otherwise(F.lit(""))
    shout = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("ssn", "card", "phone", "iban"), F.concat(in_place, grown)).when(kind.startswith("name") & (F.length(mention) > 1) & shout, F.upper(made)).when(kind.startswith("name") & (mention != F.lower(mention)), F.initcap(made)).when(kind.startswith("name"), made)
        .when(kind.isin("email", "hex") & shout, F.upper(made)).when(kind == "email", F.when(F.length(made) == F.length(mention), F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(made, i + 1, F.lit(1)))).otherwise(F.substring(made, i + 1, F.lit(1)))), "")).otherwise(made))
        .otherwise(made)
    )


PIECES = "array<struct<k:string,v:string>>"


def _piece(kind, value: Column) -> Column:
    return F.struct((F.lit(kind).cast("string") if kind is None else kind).alias("k"), value.alias("v"))


def _cut(text: Column, pattern: Column, kind) -> Column:
    """Literal pieces (kind null) and finds of a text in turn; ``kind`` names a find."""
    finds, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    rest = F.zip_with(finds, F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda m, b: F.array(_piece(kind(m), m), _piece(None, b)))
    return F.concat(F.array(_piece(None, F.element_at(between, 1))), F.flatten(rest)).cast(PIECES)


def _parts(pieces: Column) -> Column:
    """Titled names cut into title, name parts and what stands between them."""
    part = F.lit(rf"(?<= )(?:{PART}|(?<=\b(?:mr|mrs)\.? )\p{{Ll}}{{2,}})")
    return F.flatten(F.transform(pieces, lambda p: F.when(p["k"].startswith("name"), _cut(p["v"], part, lambda m: p["k"])).otherwise(F.array(p).cast(PIECES))))


def _bare(pieces: Column, named: Column) -> Column:
    """Later mentions of the document's name parts (longer than an initial and begun with a capital) in its literal pieces."""
    words = F.array_distinct(F.transform(named, lambda p: F.lower(p["v"])))
    spelt = F.flatten(F.transform(words, lambda w: F.array(F.initcap(w), F.upper(w))))
    both = F.array_distinct(F.concat(F.transform(named, lambda p: p["v"]), spelt))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}@.])(?:"), F.array_join(F.filter(both, lambda w: w.rlike(r"^\p{Lu}.")), "|"), F.lit(r")(?![\p{L}\p{N}@]|['’]\p{Lu})"))
    owner = lambda m: F.element_at(F.filter(named, lambda p: F.lower(p["v"]) == F.lower(m)), 1)["k"]
    cut = F.flatten(F.transform(pieces, lambda p: F.when(p["k"].isNull(), _cut(p["v"], pattern, owner)).otherwise(F.array(p).cast(PIECES))))
    return F.when(F.size(F.filter(both, lambda w: w.rlike(r"^\p{Lu}."))) > 0, cut).otherwise(pieces)


def replace(docs: DataFrame, key: str = "surrogates", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``count`` names a column for the number of finds."""
    columns = docs.columns
    found = F.coalesce(hint(text) & F.col(text).rlike(FIND), F.lit(False))
    rest = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in columns if c != text)).alias("_doc")
    hit = docs.where(found).select(rest, F.monotonically_increasing_id().alias("_row"), _parts(_cut(F.col(text), F.lit(FIND), kind)).alias("_pieces"))
    named = F.filter("_pieces", lambda p: p["k"].startswith("name") & (F.length(p["v"]) > 1))
    hit = hit.withColumn("_named", named)
    hit = stored(hit.select("_doc", "_row", F.when(F.size("_named") > 0, _bare(F.col("_pieces"), F.col("_named"))).otherwise(F.col("_pieces")).alias("_pieces")))
    each = hit.select("_row", F.posexplode("_pieces").alias("_at", "p")).where("p.k is not null")
    mentions = each.select("_row", "_at", F.col("p.v").alias("mention"), F.col("p.k").alias("kind")).withColumn("entity", canonical(F.col("mention"), F.col("kind")))
    known = mapping(mentions, key)
    done = (
        mentions.join(known, ["kind", "entity"]).select("_row", F.struct("_at", _format(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("s")).alias("x"))
        .groupBy("_row").agg(F.map_from_entries(F.collect_list("x")).alias("_new"))
    )
    whole = F.array_join(F.transform("_pieces", lambda p, i: F.coalesce(F.element_at("_new", i), p["v"])), "")
    changed = hit.join(done, "_row").select(*(whole.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in columns), F.size("_new").cast("long").alias("_n"))
    same = docs.where(~found).withColumn("_n", F.lit(0).cast("long"))
    out = changed.unionByName(same)
    return out.withColumnRenamed("_n", count) if count else out.drop("_n")
