"""Personal data is replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerbeam.llm.common import column, stored

# Titles that tell a following name, and the gender that they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Dra", "Signora", "Г-жа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sig", "Г-н", "Κύριος")
NEUTRAL = ("Dr", "Prof")


def _in_cases(titles: tuple[str, ...]) -> str:
    """Also in lower case, but for the verb "miss"; in capitals, where MR and MS have other
    meanings, with a dot."""
    low = [t.lower() for t in titles if t != "Miss"]
    return "|".join([*titles, *low, *(rf"{t.upper()}(?=\.)" for t in titles)])


_TITLES = _in_cases(FEMALE + MALE + NEUTRAL)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_JOINED = rf"['’-](?![sS](?!\p{{L}}))(?!(?:{_TITLES})\.? \p{{Lu}})\p{{L}}++"
_TOKEN = rf"\p{{Lu}}(?:\p{{L}}++(?:{_JOINED})*+|(?:{_JOINED})++)"
_DOTTED = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_PART = rf"(?:{_DOTTED}|{_TOKEN}|\p{{Lu}}(?= \p{{Lu}}))"
_NAME = rf"(?:{_TITLES})\.? {_PART}(?: {_PART})*+"
_INITIAL = r"^\p{Lu}(?:\.(?:-?\p{Lu}\.)*)?$"
# A capitalised word, which in a document may be part of a name that it has with a title.
BARE = rf"(?<![\p{{L}}\p{{N}}]){_TOKEN}"

# Every kind that is looked for. Possessive runs behind a look-behind make each word be
# read once, whatever its length.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
SECRET = r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"
ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
PHONE = (
    r"(?<![\d+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}-\d{4})(?!\d)"
    r"|(?<![\d+])(?<!\d[.-])(?:(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|0\d{1,4}(?:[ /-]\d{2,8}){1,4})(?!\d|[.-]\d)"
)
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = (
    r"(?<![\d.-])(?:\d{13,19}|\d{4}(?<by>[ -])\d{4}\k<by>\d{4}\k<by>\d{1,7}"
    r"|3\d{3}(?<of>[ -])\d{6}\k<of>\d{4,5})(?![\d.-]?\d)"
)
_INITIALS = "".join(sorted({c for t in FEMALE + MALE + NEUTRAL for c in (t[0], t[0].lower())}))
NAME = rf"(?=[{_INITIALS}])(?<![\p{{L}}]){_NAME}"
# A look at the first character spares most positions the tests behind it.
PATTERN = f"{EMAIL}|{SECRET}|(?=[0-9+(])(?:{ADDRESS}|{CARD}|{PHONE}|{SOCIAL})|{NAME}"

_HEX, _CONSONANTS, _VOWELS = "0123456789abcdef", "bcdfghklmnprstvz", "aeiouaeiouaeioua"
# Latin letters of made-up names, and what stands for them in the other scripts.
_LATIN = "abcdefghiklmnoprstuvz"
_CYRILLIC = "абцдефгхиклмнопрстувз"
_GREEK = "αβκδεφγχικλμνοπρστυωζ"
_CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _initials(key: str, initials: Column) -> Column:
    """Each capital becomes another of its script, different ones different ones. These are
    too few to be spared where they occur."""
    for letters in _CAPITALS:
        mixed = sorted(letters, key=lambda c: sha256(f"{key}|initial|{c}".encode()).digest())
        initials = F.translate(initials, "".join(mixed), "".join(mixed[1:] + mixed[:1]))
    return initials


def kind_of(surface: Column) -> Column:
    """The kind of a match, or NULL for digits that only look like a card number."""
    digits = F.regexp_replace(surface, r"\D", "")
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(rf"^(?:{_TITLES})\.? "), "name")
        .when(
            surface.rlike(r"^[0-9a-fA-F]{32,}$") & surface.rlike(r"\d") & surface.rlike("[a-fA-F]"),
            "secret",
        )
        .when(surface.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "address")
        .when(surface.rlike(r"^[+(]"), "phone")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(surface.rlike(r"^(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
        .when(surface.rlike(r"^0\d{1,4}[ /-]") & F.length(digits).between(9, 12), "phone")
        .when(
            F.length(digits).between(13, 19)
            & F.call_function("luhn_check", digits)
            & ~digits.rlike("^0+$"),
            "card",
        )
    )


def _gender(surface: Column) -> Column:
    """What the title of a name tells, or NULL."""
    return (
        F.when(surface.rlike(rf"^(?:{_in_cases(FEMALE)})\.? "), "f")
        .when(surface.rlike(rf"^(?:{_in_cases(MALE)})\.? "), "m")
    )


def _script(token: Column) -> Column:
    return (
        F.when(token.rlike(r"\p{IsCyrillic}"), "cyrl")
        .when(token.rlike(r"\p{IsGreek}"), "grek")
        .otherwise("latn")
    )


def _name_parts(surface: Column) -> Column:
    """(kind, canon) of every token behind the title."""
    tokens = F.split(F.regexp_replace(surface, rf"^(?:{_TITLES})\.? ", ""), " ")
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            F.when(t.rlike(_INITIAL), F.lit("initial"))
            .when(i < F.size(tokens) - 1, F.concat_ws(":", F.lit("given"), _script(t)))
            .otherwise(F.concat_ws(":", F.lit("family"), _script(t)))
            .alias("kind"),
            F.when(t.rlike(_INITIAL), t).otherwise(F.lower(t)).alias("canon"),
        ),
    )


def _parts(kind: Column, surface: Column) -> Column:
    """What a match refers to: (kind, canon) pairs, equal for all ways to write one entity.

    Names are taken token by token, so that a surname alone and the full name keep
    pointing at one person. All tokens but the last are given names, under whatever title;
    a token alone is a surname. Initials stand for no entity of their own. A token that was
    found without its title has its kind already. A North American phone number is the same
    with and without its country code.
    """
    digits = F.regexp_replace(surface, r"\D", "")
    american = F.when(surface.startswith("+"), digits.rlike(r"^1[1-9]\d{9}$")).otherwise(
        ~digits.startswith("0")
    )
    phone = F.when(american, F.right(digits, F.lit(10))).otherwise(
        F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits)
    )

    def one(k: Column | str, canon: Column) -> Column:
        k = F.lit(k) if isinstance(k, str) else k
        return F.struct(k.alias("kind"), canon.alias("canon"))

    named = _name_parts(surface)
    return (
        F.when(kind == "name", named)
        .when(_is_name(kind), F.array(one(kind, F.lower(surface))))
        .when(kind == "phone", F.array(one("phone", phone)))
        .when(kind.isin("card", "social"), F.array(one(kind, digits)))
        .otherwise(F.array(one(kind, F.lower(surface))))
    )


# Endings of made-up given names by gender, and of surnames. What comes before one ends in
# a vowel, so that names that differ before it or in it differ as a whole.
_ENDINGS = {"f": "na", "m": "n", "n": "s", "family": "r"}


def _in_script(kind: Column, latin: Column) -> Column:
    return (
        F.when(kind.endswith("cyrl"), F.translate(latin, _LATIN, _CYRILLIC))
        .when(kind.endswith("grek"), F.translate(latin, _LATIN, _GREEK))
        .otherwise(latin)
    )


def _made_stem(kind: Column, digest: Column, attempt: int) -> Column:
    """Syllables from the digest, in the script; later attempts have more of them."""
    syllables = [
        F.concat(
            F.translate(F.substring(digest, 2 * i + 1, 1), _HEX, _CONSONANTS),
            F.translate(F.substring(digest, 2 * i + 2, 1), _HEX, _VOWELS),
        )
        for i in range(min(3 + attempt, 30))
    ]
    return _in_script(kind, F.concat(*syllables))


def _ended(kind: Column, stem: Column, gender: Column) -> Column:
    ending = F.lit(_ENDINGS["family"])
    for g in "fmn":
        ending = F.when(kind.startswith("given") & (gender == g), _ENDINGS[g]).otherwise(ending)
    return F.concat(stem, _in_script(kind, ending))


def _is_name(kind: Column) -> Column:
    return kind.rlike("^(?:given|family):")


def _refused(entities: DataFrame) -> DataFrame:
    """(kind, surrogate) that may not be proposed: what occurs, and before each ending that
    it could get, what would make a name that occurs."""
    kind, canon = F.col("kind"), F.col("canon")
    endings = F.transform(
        F.array(*map(F.lit, _ENDINGS.values())), lambda e: _in_script(kind, e)
    )
    stems = F.transform(
        F.filter(endings, lambda e: F.endswith(canon, e)),
        lambda e: F.substring(canon, F.lit(1), F.length(canon) - F.length(e)),
    )
    names = F.array_distinct(F.concat(F.array(canon), stems))
    return entities.select(
        "kind", F.explode(F.when(_is_name(kind), names).otherwise(F.array(canon))).alias("surrogate")
    )


def candidate(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """The surrogate that this attempt proposes, in canonical form; of a name, all but the
    ending."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(attempt))), 256)
    digits = F.translate(digest, "abcdef", "012345")
    size = F.length(canon)

    def number(at: int, below: int, first: int) -> Column:
        drawn = F.conv(F.substring(digest, at, 6), 16, 10).cast("long") % below + first
        return drawn.cast("string")

    def taken(n: Column, at: int = 1) -> Column:
        return F.substring(digits, F.lit(at), n)

    kept_head = F.greatest(F.length(canon) - 10, F.when(canon.rlike("^[+0]"), 1).otherwise(0))
    phone = F.concat(
        F.substring(canon, F.lit(1), kept_head),
        number(40, 8, 2),
        taken(size - kept_head - 1),
    )
    body = F.concat(F.substring(canon, 1, 1), taken(size - 2))
    check = F.filter(
        F.array(*(F.lit(str(d)) for d in range(10))),
        lambda d: F.call_function("luhn_check", F.concat(body, d)),
    )
    private = F.when(canon.startswith("10."), "10.").when(canon.startswith("192.168."), "192.168.")
    address = F.when(
        private == "10.", F.concat_ws(".", F.lit("10"), number(1, 256, 0), number(7, 256, 0), number(13, 254, 1))
    ).when(
        private == "192.168.", F.concat_ws(".", F.lit("192.168"), number(7, 256, 0), number(13, 254, 1))
    ).otherwise(
        F.concat_ws(".", number(1, 100, 11), number(7, 256, 0), number(13, 256, 0), number(19, 254, 1))
    )
    local = F.substring_index(canon, "@", 1)
    domain = F.substring_index(canon, "@", -1)
    host = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    letters = F.translate(digest, _HEX, _CONSONANTS)
    made = F.substring(letters, F.lit(1), F.greatest(F.lit(8), F.least(F.length(local), F.lit(24))))
    numbered = F.when(local.rlike(r"\d$"), F.concat(F.lit("."), F.substring(digits, 50, 2))).otherwise("")
    email = F.concat(
        made,
        numbered,
        F.lit("@"),
        F.substring(F.translate(host, _HEX, _CONSONANTS), 1, 8),
        F.lit("."),
        F.substring_index(domain, ".", -1),
    )
    blocks = F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(size / 64).cast("int")))
    chained = F.concat(
        digest,
        F.sha2(digest, 256),
        F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat(digest, i.cast("string")), 256)), ""),
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.substring(chained, F.lit(1), size))
        .when(kind == "address", address)
        .when(kind == "phone", phone)
        .when(kind == "social", F.concat(F.lit("9"), taken(size - 1)))
        .when(kind == "card", F.concat(body, F.get(check, F.lit(0))))
        .otherwise(_made_stem(kind, digest, attempt))
    )


# Formats with no more values than this are counted out when random proposals run short.
COUNTED_OUT = 2**24
PROPOSALS = 8  # random ones that an entity of such a format gets
_ROUNDS = 60  # random ones of all others, of which even a half-full format refuses none so often


def _format(kind: Column, canon: Column) -> Column:
    """What a value of this format starts with and how many values it has, for formats of
    at most ``COUNTED_OUT`` values; else NULL. Private addresses of 192.168 overflow into
    172.16 to 172.31."""
    head = F.when(canon.rlike("^[+0]"), F.substring(canon, 1, 1)).otherwise("")
    digits = F.length(canon) - F.length(head)

    def form(start: Column, size: Column) -> Column:
        return F.struct(start.alias("start"), size.cast("long").alias("size"))

    few = (kind == "phone") & (digits <= 7)
    return (
        F.when((kind == "address") & canon.startswith("192.168."), form(F.lit("192.168."), F.lit(17 * 65536)))
        .when((kind == "address") & canon.startswith("10."), form(F.lit("10."), F.lit(2**24)))
        .when(few, form(head, F.lit(8) * F.pow(F.lit(10), digits - 1)))
    )


def _value(start: Column, size: Column, n: Column) -> Column:
    """The ``n``-th value of a format."""
    last = F.concat_ws(".", F.shiftright(n, 8).bitwiseAND(255).cast("string"), n.bitwiseAND(255).cast("string"))
    block = F.shiftright(n, 16)
    return (
        F.when(start == "10.", F.concat(start, block.cast("string"), F.lit("."), last))
        .when((start == "192.168.") & (block == 0), F.concat(start, last))
        .when(start == "192.168.", F.concat(F.lit("172."), (block + 15).cast("string"), F.lit("."), last))
        .otherwise(F.concat(start, (n + F.floor(size / 4)).cast("string")))
    )


def _placed_by_rank(pending: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """A free value for each pending entity of a small format: both are ordered by keyed
    hashes, and the n-th gets the n-th. A format has at most ``COUNTED_OUT`` values, which
    bounds every window here. ``taken`` (kind, surrogate) is not free."""
    waiting = pending.withColumn("form", _format(F.col("kind"), F.col("canon"))).select(
        "kind", "canon", "form.start", "form.size"
    )
    forms = waiting.select("kind", "start", "size").distinct()
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") - 1, 12)))
    values = (
        forms.withColumn("block", block)
        .repartition("kind", "start", "block")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(4095))))
        .withColumn("n", F.shiftleft("block", 12) + F.col("step"))
        .filter(F.col("n") < F.col("size"))
        .withColumn("surrogate", _value(F.col("start"), F.col("size"), F.col("n")))
        .filter((F.col("kind") != "address") | ~F.col("surrogate").rlike(r"\.(?:0|255)$"))
    )

    def ranked(df: DataFrame, by: str) -> DataFrame:
        drawn = F.xxhash64(F.lit(f"{key}|rank"), F.col(by))
        # An overflow is used only when its format is full.
        rows = Window.partitionBy("kind", "start").orderBy(
            F.col(by).startswith("172.") & (F.col("start") == "192.168."), drawn, by
        )
        return df.select("kind", "start", by, F.row_number().over(rows).alias("rank"))

    free = values.join(taken, ["kind", "surrogate"], "left_anti")
    return (
        ranked(waiting, "canon")
        .join(ranked(free, "surrogate"), ["kind", "start", "rank"])
        .select("kind", "surrogate", "canon")
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon), distinct; returned with ``surrogate``, distinct by kind.

    Each round proposes a surrogate for every entity that has none. One that equals a
    real entity, or one given earlier, is refused; of entities with equal proposals one
    gets it. The rest try again, from a larger space for names. After some rounds, entities
    of a small format get the values still free by rank. Rounds end when none is left; only
    that question comes to the driver. Where a format has fewer free values than entities,
    which can only be once a large part of all its values occur, this is an error.
    """
    given, pending, full = None, entities, False
    refused = _refused(entities)
    for attempt in range(_ROUNDS):
        proposed = pending.withColumn(
            "surrogate", candidate(key, F.col("kind"), F.col("canon"), attempt)
        ).join(refused, ["kind", "surrogate"], "left_anti")
        if given is not None:
            proposed = proposed.join(given, ["kind", "surrogate"], "left_anti")
        won = stored(proposed.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")))
        given = won if given is None else given.unionByName(won)
        pending = stored(pending.join(won, ["kind", "canon"], "left_anti"))
        if attempt == PROPOSALS - 1:
            few = pending.filter(_format(F.col("kind"), F.col("canon")).isNotNull())
            if not few.isEmpty():
                taken = refused.unionByName(given.select("kind", "surrogate"))
                won = stored(_placed_by_rank(few, taken, key))
                given = given.unionByName(won)
                pending = stored(pending.join(won, ["kind", "canon"], "left_anti"))
                full = few.count() > won.count()
        if full:
            break
        if pending.isEmpty():
            return given
    kinds = [r[0] for r in pending.select("kind").distinct().collect()]
    raise ValueError(f"there are more entities than free values of their format: {kinds}")


def _written(kind: Column, surface: Column, made: Column) -> Column:
    """The surrogates ``made`` for a match's parts, in the match's own format."""
    first = F.get(made, F.lit(0))
    digits, made_digits = F.regexp_replace(surface, r"\D", ""), F.regexp_replace(first, r"\D", "")
    # A country code that the entity is known without stays.
    code = F.substring(digits, F.lit(1), F.length(digits) - F.length(made_digits))
    wanted = F.concat(code, made_digits)
    spots = F.transform(
        F.sequence(F.lit(1), F.length(surface)), lambda i: F.substring(surface, i, F.lit(1))
    )
    in_format = F.array_join(
        F.transform(
            spots,
            lambda c, i: F.when(
                c.rlike(r"\d"),
                F.substring(
                    wanted,
                    F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), r"\D", "")),
                    F.lit(1),
                ),
            ).otherwise(c),
        ),
        "",
    )
    title = F.regexp_extract(surface, rf"^(?:{_TITLES})\.? ", 0)
    # What is made of initials is in capitals already.
    cased = F.transform(made, lambda m: F.when(m == F.upper(m), m).otherwise(F.initcap(m)))
    name = F.concat(title, F.array_join(cased, " "))
    bare = F.when(surface == F.upper(surface), F.upper(first)).otherwise(F.initcap(first))
    return (
        F.when(kind == "name", F.when(surface == F.upper(surface), F.upper(name)).otherwise(name))
        .when(_is_name(kind), bare)
        .when(kind.isin("phone", "card", "social"), in_format)
        .when((kind == "secret") & (surface == F.upper(surface)), F.upper(first))
        .otherwise(first)
    )


def replace_entities(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with all columns, in ``text`` every entity replaced by its surrogate.

    Found are e-mail addresses, IPv4 addresses, phone numbers, card numbers with a right
    check digit, social security numbers, hexadecimal secrets and names behind a title.
    Equal entities, however written, get equal surrogates in the whole table; different
    ones get different ones, and none that occurs as an entity itself. A surrogate has its
    entity's type and format: grouping of digits, country code, issuer digit and check
    digit, private network, top-level domain; a name's gender and script. A given name has
    one surrogate under all titles, whose ending alone goes by gender: that of its own title;
    without one that tells it, what the document's other titles tell of that given name,
    then the table's; where these tell none or both, an ending of neither. It depends on
    ``key`` and on the collisions alone. A capitalised token of a name that a document has
    behind a title is replaced in that document wherever it stands.

    Texts without a match are passed on where they are read. The others are stored; only
    matches are shuffled, and meet their texts again by row number. A frequent entity is
    one row of the surrogate table, and joins on it are split by adaptive execution. All
    of this is expressions: no Python runs.

    A missing text stays missing, an empty one empty. Repeated rows stay repeated. Any
    other columns are passed on, whatever their names; ``count`` names an additional one
    with the number of entities replaced.
    """
    columns = docs.columns
    text = docs["text"]
    # All but names have a digit or an at sign, which most texts are quickly seen to lack.
    has_match = F.coalesce(
        F.when(text.rlike("[0-9@]"), text.rlike(PATTERN)).otherwise(text.rlike(NAME)), F.lit(False)
    )
    clean = docs.filter(~has_match)
    marked = stored(
        docs.filter(has_match).select(
            F.struct(*(column(docs, c) for c in columns)).alias("doc"),
            F.monotonically_increasing_id().alias("row"),
            text.rlike(NAME).alias("named"),
        )
    )
    body, named = F.col("doc")["text"], F.col("named")
    wide = f"{PATTERN}|{BARE}"
    matches = F.when(named, F.regexp_extract_all(body, F.lit(wide), F.lit(0))).otherwise(
        F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    )
    plain = (
        marked.filter(~named)
        .select("row", F.posexplode(matches).alias("at", "surface"))
        .withColumn("kind", kind_of(F.col("surface")))
        .withColumn("gender", F.lit(""))
    )
    # The tokens of a document's own names, with which its capitalised words are compared,
    # and what the titles there tell of them.
    titled = F.filter("all", lambda m: m.rlike(rf"^(?:{_TITLES})\.? "))
    told_here = F.flatten(
        F.transform(
            titled,
            lambda m: F.transform(
                _name_parts(m),
                lambda p: F.struct(p["kind"], p["canon"], F.coalesce(_gender(m), F.lit("")).alias("gender")),
            ),
        )
    )
    own = F.filter(F.array_distinct(told_here), lambda p: p["kind"] != "initial")
    surface, kind = F.col("surface"), F.col("kind")
    same = F.filter("own", lambda p: p["canon"] == F.lower(surface))
    bare_kind = F.get(F.sort_array(F.transform(same, lambda p: p["kind"]), False), F.lit(0))
    parts = F.when(kind == "name", _name_parts(surface)).when(
        kind.startswith("given:"), F.array(F.struct(kind.alias("kind"), F.lower(surface).alias("canon")))
    )
    spoken = F.array_distinct(
        F.transform(
            F.filter(
                "own",
                lambda p: (p["gender"] != "")
                & p["kind"].startswith("given:")
                & F.exists(
                    F.col("parts"), lambda q: (q["kind"] == p["kind"]) & (q["canon"] == p["canon"])
                ),
            ),
            lambda p: p["gender"],
        )
    )
    in_named = (
        marked.filter(named)
        .select("row", matches.alias("all"))
        .select("row", "all", own.alias("own"))
        .select("row", "own", F.posexplode("all").alias("at", "surface"))
        .withColumn("kind", F.coalesce(kind_of(surface), bare_kind))
        .filter("kind IS NOT NULL")
        .withColumn("parts", parts)
        .select(
            "row", "at", "surface", "kind",
            F.when(F.col("parts").isNull(), "")
            .otherwise(
                F.coalesce(
                    F.when(kind == "name", _gender(surface)),
                    F.when(F.size(spoken) == 1, F.get(spoken, F.lit(0))),
                    F.lit(""),
                )
            )
            .alias("gender"),
        )
    )
    found = plain.unionByName(in_named).filter("kind IS NOT NULL")
    surfaces = stored(
        found.select("kind", "surface", "gender")
        .distinct()
        .select("kind", "surface", "gender", _parts(kind, surface).alias("parts"))
    )
    pieces = surfaces.select(
        kind.alias("written_as"), "surface", "gender", F.posexplode("parts").alias("nth", "part")
    ).select("written_as", "surface", "gender", "nth", "part.kind", "part.canon")
    telling = F.when(F.col("gender") != "", F.col("gender"))
    entities = stored(
        pieces.filter("kind <> 'initial'")
        .groupBy("kind", "canon")
        .agg(F.when(F.min(telling) == F.max(telling), F.min(telling)).alias("told"))
    )
    given = distinct_surrogates(entities.select("kind", "canon"), key).join(entities, ["kind", "canon"])
    ending = F.coalesce(telling, F.col("told"), F.lit("n"))
    written = (
        pieces.join(given, ["kind", "canon"], "left")
        .withColumn(
            "surrogate",
            F.when(kind == "initial", _initials(key, F.col("canon")))
            .when(_is_name(kind), _ended(kind, F.col("surrogate"), ending))
            .otherwise(F.col("surrogate")),
        )
        .groupBy("written_as", "surface", "gender")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))).alias("made"))
        .select(
            F.col("written_as").alias("kind"),
            "surface",
            "gender",
            _written(
                F.col("written_as"), surface, F.transform("made", lambda m: m["surrogate"])
            ).alias("surrogate"),
        )
    )
    swaps = (
        found.join(written, ["kind", "surface", "gender"])
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("swaps"))
    )
    between = F.when(named, F.split(body, wide, -1)).otherwise(F.split(body, PATTERN, -1))
    shown = F.transform(
        matches, lambda m, i: F.coalesce(F.element_at(F.col("swaps"), i), m)
    )
    spliced = F.array_join(
        F.transform(
            between, lambda b, i: F.concat(b, F.coalesce(F.get(F.col("shown"), i), F.lit("")))
        ),
        "",
    )
    joined = marked.join(swaps, "row", "left").withColumn(
        "shown", F.when(F.col("swaps").isNotNull(), shown)
    )
    new_text = F.when(F.col("swaps").isNotNull(), spliced).otherwise(body)
    replaced = joined.select(
        *(
            (new_text if c == "text" else F.col("doc")[c]).alias(c)
            for c in columns
        ),
        *([F.coalesce(F.size("swaps"), F.lit(0)).cast("long").alias(count)] if count else []),
    )
    if count:
        clean = clean.withColumn(count, F.lit(0).cast("long"))
    return clean.unionByName(replaced)
