"""PII: surrogates for detected entities, by DataFrame functions only.

Entities (e-mail addresses, phone numbers, card numbers, IP addresses, social security and bank account numbers,
tokens, persons) are found by one regular expression. Each is enciphered by a keyed, format-preserving bijection: a
character is shifted within its own alphabet (digits, lower and upper case of its script, vowels and consonants in
names) by a keyed hash of the entity's characters before it, then, in a second pass, of those after it. So a surrogate
has its entity's script, case, length and punctuation; equal entities get equal surrogates whatever their case or the
punctuation between a phone number's digits; entities of one kind that differ get surrogates that differ. The address
part of IP numbers is permuted within valid octets, the country code of a phone number and the last label of a domain
stay. A person keeps the title; a given name of the lists is exchanged for one of the same gender.

The key is the session's setting ``spark.quarry.pii.key``; shifts are HMAC-SHA256 values under it.

Distinctness is checked over the whole corpus: an entity whose surrogate is itself an entity of the corpus, or is
another's surrogate, is enciphered under another key, with all its spellings (case, title, punctuation) and, of persons,
with all that share the last name, so that mentions of one person stay alike; this goes on until no clash is left, and if
that can't be reached an error is raised. Letters outside the alphabets are shifted within those of their script and
category. What this finds is a small table, joined by the texts' hash to the documents concerned; Spark broadcasts it only
if its size is below the session's threshold.

Null texts stay null, empty ones empty. Rows are treated each for itself, and all other columns stay as they are, save
``n_chars``, which follows the text where it is a column.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, documents, whole_row

#: The key where none is configured; and rounds of enciphering anew, at most, and those before names get longer.
NOT_SECRET = "quarry"
ROUNDS, SHORT = 40, 8
#: A character that marks where entities begin and end.
MARK = "\x01"
COUNTRY = r"^\+\d{1,3}(?=\D)|^\+\d{1,2}"

#: Given names by gender, titles by gender.
FEMALE = "Anna Maria Sophie Laura Julia Emma Clara Elena Lucia Carmen Isabel Marie Camille Claire Alice Sarah Emily Jane Mary Linda Susan Karen Helen Ruth Petra Ursula Monika Sabine Ingrid Teresa".split()
MALE = "John James Robert Michael William David Richard Thomas Charles Daniel Peter Paul Mark George Hans Karl Klaus Stefan Jürgen Wolfgang Jean Pierre Michel Louis François Antonio Manuel Carlos Javier Pedro".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame".split()

_GAP = r"[^\w\n]{1,6}"
#: Kind and pattern, in order of precedence.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)+"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("token", r"(?<![\p{L}\p{N}])(?:(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{24,128}|(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{24,128}|(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,})(?![\p{L}\p{N}])"),
    ("ip", r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)"),
    ("phone", rf"\+\d{{1,3}}{_GAP}(?:\d{{1,4}}{_GAP}){{1,4}}\d{{3,4}}(?![\p{{L}}\p{{N}}])|\(\d{{3}}\)[^\w\n]{{0,5}}\d{{3}}{_GAP}\d{{4}}(?![\p{{L}}\p{{N}}])|\+\d{{8,15}}(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}.-])(?:\d{{3}}[-. ])?\d{{3}}-\d{{4}}(?![\p{{L}}\p{{N}}])"),
    ("ssn", r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?![\p{L}\p{N}])"),
    ("person", rf"(?<!\p{{L}})(?=[A-Z])(?:(?:{'|'.join(TITLES)})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}\p{{Ll}}[\p{{L}}'-]*+)?|(?:{'|'.join(FEMALE + MALE)}) \p{{Lu}}\p{{Ll}}[\p{{L}}'-]*+)"),
)


def guarded(patterns: tuple[tuple[str, str], ...]) -> str:
    """All patterns as one expression without groups that a kind needs (the card's separator is told by both forms).

    Patterns that never start after a letter share one look at the character before, which spares the inside of words.
    """
    out, run = [], []
    for _, p in (*patterns, ("", "")):
        p = p.replace("([ -])\\d{4}\\1\\d{4}\\1", "(?: \\d{4} \\d{4} |-\\d{4}-\\d{4}-)")
        if p.startswith("(?<!") and "|" not in re.sub(r"\[[^]]*\]|\((?:[^()]|\([^()]*\))*\)", "", p):
            run.append(p)
            continue
        out += [r"(?<!\p{L})(?:" + "|".join(run) + ")"] if run else []
        out += [p] if p else []
        run = []
    return "|".join(out)


PATTERN = guarded(PATTERNS)

_DIGITS = "0123456789"
_OTHER = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
PLAIN = (_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *_OTHER)
HEX = ("0123456789abcdef",)
HEX_UPPER = ("0123456789ABCDEF",)
NAMES = ("aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", *_OTHER)
KINDS = tuple(k for k, _ in PATTERNS)


def letter_runs() -> list[tuple[int, int, int, int, int]]:
    """(first code point, letters, rank of the first, rank where its class begins, size of the class) of runs of the
    letters, marks and digits that PLAIN lacks; a class holds those of one script and category, or the few left over.
    """
    classes: dict[str, list[int]] = {}
    for c in range(0x80, 0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMN" and chr(c) not in "".join(_OTHER):
            script = unicodedata.name(chr(c), "?").split()[0].split("-")[0]
            classes.setdefault(f"{script} {kind}", []).append(c)
    few = sorted(c for own in classes.values() if len(own) < 8 for c in own)
    out, rank = [], 0
    for own in [*(own for own in classes.values() if len(own) >= 8), few]:
        start = rank
        for c in own:
            if out and out[-1][3] == start and c == out[-1][0] + out[-1][1]:
                out[-1][1] += 1
            else:
                out.append([c, 1, rank, start, len(own)])
            rank += 1
    return [tuple(r) for r in out]


#: The runs' numbers, in columns, as text: one literal in a plan.
_RUNS = [" ".join(map(str, x)) for x in zip(*letter_runs(), strict=True)]


def key_of(spark: SparkSession) -> str:
    """The secret key: the session's ``spark.quarry.pii.key``. Without it surrogates can be inverted by all who read this."""
    key = spark.conf.get("spark.quarry.pii.key", None)
    if not key:
        warnings.warn("spark.quarry.pii.key is not set: surrogates are made with a key that is not secret", stacklevel=2)
    return key or NOT_SECRET


def keyed(key: str, *parts: Column | str) -> Column:
    """HMAC-SHA256 of the parts under the key, its first 60 bits as a number."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    message = F.concat_ws("\u001f", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in raw)), message), 256))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in raw)), inner), 256), 1, 15), 16, 10).cast("long")


def shifted(c: Column, h: Column) -> Column:
    """A letter that no alphabet has, shifted within its class."""
    # not foldable: plans with folded arrays of all runs take minutes to optimise
    none = F.substring(c, 1, 0)
    first, letters, rank, start, size = (F.split(F.concat(F.lit(x), none), " ").cast("array<bigint>") for x in _RUNS)
    point = F.ascii(c).cast("bigint")
    runs = F.arrays_zip(first.alias("first"), letters.alias("letters"), rank.alias("rank"), start.alias("start"), size.alias("size"))

    def moved(all_runs: Column) -> Column:
        own = F.filter(all_runs, lambda r: (r["first"] <= point) & (point < r["first"] + r["letters"]))

        def one(r: Column) -> Column:
            to = r["start"] + F.pmod(r["rank"] + point - r["first"] - r["start"] + h, r["size"])
            at = F.filter(all_runs, lambda q: (q["rank"] <= to) & (to < q["rank"] + q["letters"]))[0]
            return F.decode(F.unhex(F.lpad(F.hex(at["first"] + to - at["rank"]), 8, "0")), "UTF-32")

        return F.get(F.transform(own, one), F.lit(0))

    # the runs are searched twice, but stand in the plan once
    return F.coalesce(F.transform(F.array(runs), moved)[0], c)


def one_pass(text: Column, alphabets: Column, key: str, tag: Column) -> Column:
    """Shifts each character by a hash of the letters and digits before it, regardless of their case."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        h = keyed(key, tag, F.lower(acc["seen"]))
        own = F.get(F.filter(alphabets, lambda letters: F.instr(letters, c) > 0), F.lit(0))
        far = (c > F.lit("\x7f")) & F.regexp_like(c, F.lit(r"[\p{L}\p{M}\p{N}]"))
        new = F.when(own.isNotNull(), F.substr(own, F.pmod(F.instr(own, c) - 1 + h, F.length(own)).cast("int") + 1, F.lit(1))).when(far, shifted(c, h)).otherwise(c)
        inside = own.isNotNull() | far
        return F.struct(F.concat(acc["out"], new).alias("out"), F.when(inside, F.concat(acc["seen"], c)).otherwise(acc["seen"]).alias("seen"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def cipher(text: Column, alphabets: Column, key: str, tag: Column) -> Column:
    """Both passes by one expression, so that the plan holds it once: each pass leaves the text reversed."""
    tags = F.array(tag, F.concat(tag, F.lit("-back")))
    return F.aggregate(tags, text, lambda out, t: F.reverse(one_pass(out, alphabets, key, t)))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def exchanged(name: Column, names: list[str], key: str, tag: str) -> Column:
    """A given name for another of its list: the position times and plus keyed numbers, which is a bijection."""
    n, seed = len(names), int.from_bytes(hmac.new(key.encode(), tag.encode(), "sha256").digest()[:7], "big")
    factor = next(a for a in range(3 + seed % 101, 10_000) if math.gcd(a, n) == 1)
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod((at - 1) * factor + 1 + seed % 997, F.lit(n)) + 1).cast("int"))


def part(text: Column | str, tag: str | None = None, alphabets: str = "plain", before: Column | str = "") -> Column:
    """What stays (before), and a text that is enciphered with the tag in its hashes, or stays without one."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(before).alias("before"), lit(text).alias("text"), F.lit(tag).cast("string").alias("tag"), F.lit(alphabets).alias("alphabets"))


def person(entity: Column, key: str) -> Column:
    """Title kept, given name exchanged within its gender, other words enciphered."""

    def one(w: Column, i: Column) -> Column:
        gap = F.when(i > 0, " ").otherwise("")
        return (
            F.when(F.regexp_replace(w, r"\.$", "").isin(TITLES), part(w, before=gap))
            .when(w.isin(FEMALE), part(exchanged(w, FEMALE, key, "female"), before=gap))
            .when(w.isin(MALE), part(exchanged(w, MALE, key, "male"), before=gap))
            .otherwise(part(w, "name", "names", gap))
        )

    return F.transform(F.split(entity, " "), one)


def ip(entity: Column, key: str) -> Column:
    """Valid octets for valid ones; null for others."""
    octet = F.transform(F.split(entity, "[.]"), lambda x: x.cast("long"))
    a, b = octet[0] * 256 + octet[1], octet[2] * 256 + octet[3]
    a2 = F.pmod(a + keyed(key, "ip", b.cast("string")), F.lit(65536))
    b2 = F.pmod(b + keyed(key, "ip2", a2.cast("string")), F.lit(65536))
    octets = [F.floor(a2 / 256), a2 % 256, F.floor(b2 / 256), b2 % 256]
    return F.when(F.forall(octet, lambda x: x < 256), F.concat_ws(".", *(x.cast("int").cast("string") for x in octets)))


def parts_of(entity: Column, kind: Column, key: str) -> Column:
    """The entity in parts, see ``part``."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    country = F.regexp_extract(entity, COUNTRY, 0)
    brand = F.regexp_extract(entity, r"^(?:AKIA|ghp_|sk-|xox[bp]-)", 0)
    return (
        F.when(kind == "email", F.array(part(local, "local"), part(host, "host", before="@"), part(top)))
        .when(kind == "phone", F.array(part(F.substr(entity, F.length(country) + 1), "phone", before=country)))
        .when(kind == "person", person(entity, key))
        .when((kind == "token") & (brand != ""), F.array(part(F.substr(entity, F.length(brand) + 1), "token", before=brand)))
        .when((kind == "token") & F.regexp_like(entity, F.lit("^[0-9a-f]*$")), F.array(part(entity, "hex", "hex")))
        .when(kind == "token", F.array(part(entity, "hex", "HEX")))
        .when((kind == "ip") & ip(entity, key).isNotNull(), F.array(part(ip(entity, key))))
        .otherwise(F.array(part(entity, "number")))
    )


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """One expression enciphers the parts of all kinds, which keeps plans small."""

    def one(p: Column) -> Column:
        array = lambda letters: F.array(*map(F.lit, letters))
        of = F.when(p["alphabets"] == "names", array(NAMES)).when(p["alphabets"] == "hex", array(HEX)).when(p["alphabets"] == "HEX", array(HEX_UPPER)).otherwise(array(PLAIN))
        return F.concat(p["before"], F.when(p["tag"].isNull(), p["text"]).otherwise(cipher(p["text"], of, key, p["tag"])))

    return F.array_join(F.transform(parts_of(entity, kind, key), one), "")


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, kind): the distinct entities of all texts, as written."""
    # explode_outer: for explode Spark would add a filter that searches each text a second time
    rows = docs.select(F.explode_outer(found(F.col(text_col).cast("string"))).alias("entity")).where("entity is not null").distinct()
    return rows.withColumn("kind", kind_of(F.col("entity")))


def canonical(entity: Column, kind: Column) -> Column:
    """What the spellings of one entity share: case, a person's title, and punctuation in numbers, make no difference."""
    digits = F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(entity, COUNTRY, ""), r"\D", ""))
        .when(kind == "person", F.lower(F.regexp_replace(entity, rf"^(?:{'|'.join(TITLES)})\.? ", "")))
        .when(kind.isin("email", "ip"), F.lower(entity))
        .otherwise(F.lower(digits))
    )


def unit_of(same: Column, kind: Column) -> Column:
    """What is enciphered anew together: an entity with all its spellings, and all persons of one last name."""
    return F.when(kind == "person", F.substring_index(same, " ", -1)).otherwise(same)


def longer(entity: Column, kind: Column, n: int) -> Column:
    """A name or address with n more letters, for where all of its own length are taken."""
    return F.when(kind == "person", F.concat(entity, F.lit("a" * n))).when(kind == "email", F.regexp_replace(entity, "@", "a" * n + "@")).otherwise(entity)


def clashes(docs: DataFrame, key: str, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(entity, other): entities whose first surrogate won't do, with the one that they get instead.

    A surrogate won't do if it is an entity of the corpus, or if another entity has it; of those that share one, the
    first in order keeps it. The others are enciphered under another key, until all surrogates will do. After ``SHORT``
    rounds names and addresses get longer; numbers, of which a corpus may hold all that there are, may then be those of
    other entities, but never their own, nor one that another has.
    """
    own = entities(docs, text_col).withColumn("same", canonical(F.col("entity"), F.col("kind"))).withColumn("unit", unit_of(F.col("same"), F.col("kind")))
    table = scratch.save(own.withColumn("first", surrogate(F.col("entity"), F.col("kind"), key)))
    taken = table.select("kind", F.col("same").alias("new_same")).distinct()
    changed = scratch.save(table.limit(0).select("entity", F.col("first").alias("other")))
    for k in range(1, ROUNDS + 1):
        now = table.join(changed, "entity", "left").withColumn("new_same", canonical(F.coalesce("other", "first"), F.col("kind")))
        shared = now.groupBy("kind", "new_same").agg(F.min("same").alias("keeps"), F.max("same").alias("last")).where("keeps <> last").select("kind", "new_same", "keeps")
        bad = now.join(taken.where(F.col("kind").isin("person", "email", "token")) if k > SHORT else taken, ["kind", "new_same"], "left_semi")
        bad = bad.select("kind", "unit").unionByName(now.where("same = new_same").select("kind", "unit"))
        bad = bad.unionByName(now.join(shared, ["kind", "new_same"]).where("same <> keeps").select("kind", "unit")).distinct()
        bad = scratch.save(table.join(bad, ["kind", "unit"], "left_semi").select("entity", "kind"))
        if not bad.limit(1).count():
            break
        new = surrogate(longer(F.col("entity"), F.col("kind"), max(0, k - SHORT)), F.col("kind"), f"{key}#{k}")
        changed = scratch.save(changed.join(bad, "entity", "left_anti").unionByName(bad.select("entity", new.alias("other"))))
    else:
        raise ValueError(f"op4: entities of {[r['kind'] for r in bad.select('kind').distinct().collect()]} have no surrogate of their own after {ROUNDS} rounds")
    return changed


def pieces(text: Column) -> Column:
    """The text cut at its entities: every second piece is one. One search, unless the text holds the mark itself."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    both = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found(text), lambda gap, e: F.array(gap, e)))
    return F.when(F.instr(text, MARK) == 0, marked).otherwise(F.slice(both, 1, F.size(both) - 1))


def replaced_texts(docs: DataFrame, key: str | None, scratch: Scratch | None, text_col: str) -> DataFrame:
    """(row, new, n): each row of ``docs`` as a struct, its text with the entities replaced, and their number."""
    spark = docs.sparkSession
    scratch, key = scratch or Scratch(spark, "pii", 1), key or key_of(spark)
    other = clashes(docs, key, scratch, text_col)
    rows = docs.select(whole_row(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    if other.limit(1).count():
        # texts are known by their hash: a text that has a hash by chance lacks the entities concerned
        met = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.explode_outer(found(F.col(text_col).cast("string"))).alias("entity")).where("entity is not null").distinct()
        maps = met.join(other, "entity").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "other"))).alias("map"))
        rows = rows.withColumn("h", F.xxhash64("text")).join(scratch.save(maps), "h", "left")
    else:
        rows = rows.withColumn("map", F.lit(None).cast("map<string,string>"))
    rows = rows.withColumn("cut", F.coalesce(pieces(F.col("text")), F.array(F.lit(""))))
    kinds = F.transform("cut", lambda e, i: F.struct(e.alias("e"), F.when(i % 2 == 1, F.coalesce(kind_of(e), F.lit("other"))).alias("kind")))
    new = F.transform(kinds, lambda x: F.when(x["kind"].isNull(), x["e"]).otherwise(F.coalesce(F.col("map")[x["e"]], surrogate(x["e"], x["kind"], key))))
    return rows.select("row", F.when(F.size("cut") > 1, F.array_join(new, "")).otherwise(F.col("text")).alias("new"), F.floor(F.size("cut") / 2).cast("int").alias("n"))


def with_columns(docs: DataFrame, rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` from rows' structs, some of them replaced, and those of ``new`` that ``docs`` lacks."""
    own = [(new.pop(c) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*own, *(value.alias(c) for c, value in new.items()))


def surrogates(docs: DataFrame, key: str | None = None, scratch: Scratch | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's entities replaced, and ``n_entities`` (not if ``docs`` has that column)."""
    more = {} if "n_entities" in docs.columns else {"n_entities": F.col("n")}
    return with_columns(docs, replaced_texts(docs, key, scratch, text_col), {text_col: F.col("new")} | more)


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The columns of ``docs``, entities replaced; n_chars follows the text."""
    size = {"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return with_columns(docs, replaced_texts(docs, key, None, "text"), {"text": F.col("new")} | size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(documents(spark, sf_dir)).select("doc_id", "n_entities", "text")
