"""Variant spellings of names linked to the registry member they name, by merge-and-rematch.

Labels are read into records (surname, given name, initial, cut-off or not) and counted once for each term, so that a
label which holds a third of all rows is one record. Each registry member starts as a profile with the spellings of
the surname, the given names and the initials known from the registry. In each round the records not yet merged are
blocked with the profiles (same spelling, same spelling less one letter, same sound, a part of a compound, same first
letters for cut-off names),
compared, and merged where exactly one profile fits; a merge unions the record's spelling, given name and
initial into the profile. Richer profiles re-enter blocking with the records that are left, until a round merges nothing.

Records and profiles are joined by equality of block keys, never all with all; profiles are broadcast where a count proves them few, else the
join is salted, so that a registry may have any size.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.annotations import strip_label
from hemispark.llm.characters import normalize_text
from hemispark.session import checkpoint, salted_join

#: Terms as debates write them and as the registry does.
TERMS = {"FIRST": "1st", "SECOND": "2nd", "THIRD": "3rd", "FOURTH": "4th", "FIFTH": "5th", "SIXTH": "6th", "SEVENTH": "7th", "EIGHTH": "8th", "NINTH": "9th", "TENTH": "10th"}
#: Short forms of given names.
NICKNAMES = {
    "alexandra": "alex sandra lexie sasha", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny", "catherine": "kate cathy katie cat kitty",
    "charles": "charlie chuck charley", "christine": "chris chrissie tina christy", "daniel": "dan danny", "deborah": "deb debbie debby", "dorothee": "dot dolly dottie doro dorothy",
    "edward": "ed eddie ted teddy ned", "elizabeth": "liz beth betty lizzie eliza", "francoise": "fanfan francie", "frederick": "fred freddie freddy", "gerard": "gege gerry",
    "henry": "harry hal hank", "isabelle": "isa bella belle", "jacqueline": "jackie jacky jacqui", "james": "jim jimmy jamie", "joseph": "joe jo joey", "kenneth": "ken kenny",
    "laurent": "lolo laurie larry", "margaret": "maggie peggy meg madge", "michael": "mike mick micky mickey", "natalie": "nat nathalie", "nicolas": "nick nico nicky",
    "patricia": "pat patsy trish tricia", "patrick": "pat paddy", "rebecca": "becky becca", "richard": "rick dick richie ricky", "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy", "susan": "sue susie suzie", "thomas": "tom tommy", "veronique": "vero ronnie", "victor": "vic", "victoria": "vicky vic tori vicki",
    "vincent": "vince vinny", "william": "will bill billy willy", "zacharie": "zach zac zack", "jean": "john jeannot", "philippe": "phil", "stephane": "steph",
}
_HONORIFIC = r"(?:the\s+)?(?:right\s+)?(?:hon(?:ourable|orable)?|mr|mrs|ms|dr|madam|mme|mlle|miss|sir|prof|m)"
_HONORIFICS = re.compile(rf"^(?:{_HONORIFIC}(?:\.\s*|\s+|(?=\.)))+", re.IGNORECASE)
_OFFICE = re.compile(
    r"^(?:the\b(?!\s+hon)|(?:ag\.|acting)\s)|\b(?:speaker|minister|chairperson|chairman|chair|president|leader|whip|attorney|secretary|clerk|members?|opposition|government|serjeant|committees?)\b",
    re.IGNORECASE,
)
#: A surname given in part has at least so many letters.
CUT = 3
_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("surname", "given", "initial", "cut", "shape")])


def fold(name: str | None) -> str:
    """Lower case, no accents, letters and single spaces only."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z]+", " ", bare.lower()).split())


def is_plain(raw: str, surname: str) -> bool:
    """Title, one space and the whole surname, but for case and accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", raw) if not unicodedata.combining(c)).casefold()
    return bool(re.fullmatch(rf"(?:mr|mrs|ms|dr|madam) {re.escape(surname)}", bare))


def read_label(raw: str | None) -> tuple[str, str, str, str, str] | None:
    """(surname, given, initial, cut, shape) of a label that names a person, else None.

    ``shape`` is ``given first``, ``surname first`` (a second reading of two bare words) or ``plain``.
    """
    label = strip_label(raw)[0]
    if not label:
        return None
    label = re.sub(r"\s+", " ", normalize_text(label)).strip()
    held = re.search(r"\(([^()]*)\)\s*$", label)
    if held and re.match(r"[A-Za-zÀ-ÿ. ]*[A-ZÀ-Þ]", held[1]):
        label = held[1].strip()
    elif _OFFICE.search(label) and not re.match(r"the\s+hon\b", label, re.IGNORECASE):
        return None
    bare = _HONORIFICS.sub("", label).strip(" .,;-–") if not re.search(r"[^\W\d_]\.$", label) else _HONORIFICS.sub("", label).strip(" ,;-–")
    if not bare or _OFFICE.search(bare):
        return None
    cut = bool(re.search(r"[^\W\d_]{2}\.$", bare)) and not re.search(r"\b[^\W\d_]\.$", bare)
    if "," in bare:
        surname, _, first = bare.partition(",")
        first = fold(first)
        return fold(surname), first if len(first) > 1 else "", first[:1], "", "given first"
    words = [w for w in re.split(r"\s+", re.sub(r"(?<=[A-Za-zÀ-ÿ])\.(?=[^\s])", ". ", bare)) if fold(w)]
    if not words:
        return None
    tail = words[-1]
    if len(words) > 1 and re.fullmatch(r"[A-ZÀ-Þ]\.?", tail):
        return fold(" ".join(words[:-1])), "", fold(tail), "", "given first"  # Surname I.
    if len(words) > 1 and re.fullmatch(r"[A-ZÀ-Þ]\.?", words[0]):
        return fold(" ".join(words[1:])), "", fold(words[0]), "cut" if cut else "", "given first"
    return fold(" ".join(words)), "", "", "cut" if cut else "", "plain" if len(words) == 1 else "words"


@F.pandas_udf(_RECORD)
def _records(labels: pd.Series) -> pd.DataFrame:
    known: dict[str | None, tuple] = {}
    out = []
    for raw in labels:
        if raw not in known:
            known[raw] = read_label(raw) or (None,) * 5
        out.append(known[raw])
    return pd.DataFrame(out, columns=["surname", "given", "initial", "cut", "shape"])


def _deletions(word: str) -> list[str]:
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


def sound(word: str) -> str:
    """Spelling by sound: one sign for sounds that are written in several ways."""
    word = re.sub(r"eau|au", "o", word)
    word = word.replace("y", "i").replace("w", "v").replace("ph", "f").replace("ck", "k")
    return re.sub(r"(.)\1+", r"\1", word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _block_keys(spellings: pd.Series) -> pd.Series:
    return spellings.map(lambda s: [*_deletions(s.replace(" ", "")), sound(s.replace(" ", "")) + "~", *(w + "+" for w in set(s.split()) if " " in s)])


def one_slip(a: str, b: str) -> bool:
    """Whether the words differ by one insertion, deletion, replacement or swap of neighbours at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


def readings(surname: str, given: str, initial: str, shape: str) -> list[tuple[str, str, str]]:
    """(surname, given, initial) ways to read the words of a label."""
    out = [(surname, given, initial)]
    words = surname.split()
    if shape in ("words", "given first") and len(words) > 1 and not given and not initial:
        out += [(" ".join(words[k:]), " ".join(words[:k]), "") for k in range(1, len(words))]
        out += [(" ".join(words[:k]), " ".join(words[k:]), "") for k in range(1, len(words))]
    return out


def given_fits(given: str, initial: str, names: list[str], initials: list[str]) -> bool:
    """Whether a record's given name or initial, if any, is one of a profile's."""
    if not given and not initial:
        return True
    if not given:
        return initial in initials
    return any(given == n or len(given) > 3 and one_slip(given, n) or given in NICKNAMES.get(n, "").split() or n in NICKNAMES.get(given, "").split() for n in names) or (len(given) == 1 and given in initials)


_CANDIDATE = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("surname", T.StringType()), T.StructField("given", T.StringType()), T.StructField("initial", T.StringType())])


@F.pandas_udf(_CANDIDATE)
def _compare(words: pd.Series, given: pd.Series, initial: pd.Series, cut: pd.Series, shape: pd.Series, spelling: pd.Series, learned: pd.Series, names: pd.Series, initials: pd.Series) -> pd.DataFrame:
    """The best fit of a record and a profile's spelling: 0 same, 1 a part of it, 2 one slip or same sound, None no fit."""
    out = []
    for w, g, i, c, sh, sp, le, ns, ins in zip(words, given, initial, cut, shape, spelling, learned, names, initials):
        best: tuple = (None, None, None, None)
        target = sp.replace(" ", "")
        for surname, first, letter in readings(w, g, i, sh):
            flat = surname.replace(" ", "")
            if not given_fits(first, letter, list(ns), list(ins)):
                continue
            if flat == target:
                tier = 0
            elif c and len(flat) >= CUT and target.startswith(flat) or " " in sp and surname in sp.split():
                tier = 1
            elif not le and len(flat) >= 4 and (one_slip(flat, target) or sound(flat) == sound(target)):
                tier = 2
            else:
                continue
            if best[0] is None or tier < best[0]:
                best = (tier, surname, first, letter)
        out.append(best)
    return pd.DataFrame(out, columns=["tier", "surname", "given", "initial"]).astype({"tier": "Int32"})


def registry_profiles(registry: DataFrame, member: str = "member_id", term: str = "assembly_term", key: str = "surname_key", full: str = "full_name") -> DataFrame:
    """(term, member_id, spelling, learned, names, initials), one row for each member of a term.

    Duplicates and rows for several parties are one member; the full name may be written surname first.
    Rows without a member, term or name are left out.
    """

    @F.pandas_udf(T.StructType([T.StructField("spelling", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]))
    def split(keys: pd.Series, fulls: pd.Series) -> pd.DataFrame:
        out = []
        for k, f in zip(keys, fulls):
            surname, whole = fold(k), fold(f)
            if f and "," in f:
                a, _, b = f.partition(",")
                surname, first = fold(a), fold(b)
            elif whole.endswith(surname) and surname:
                first = whole[: len(whole) - len(surname)].strip()
            else:
                surname, first = surname or whole.split(" ")[-1], whole.split(" ")[0] if whole else ""
            out.append((surname, [first] if first else []))
        return pd.DataFrame(out, columns=["spelling", "names"])

    rows = registry.where(F.col(member).isNotNull() & F.col(term).isNotNull() & (F.col(full).isNotNull() | F.col(key).isNotNull()))
    rows = rows.select(F.col(term).alias("term"), F.col(member).alias("member_id"), split(F.col(key), F.col(full)).alias("s")).where(F.length("s.spelling") > 0)
    known = rows.groupBy("term", "member_id", F.col("s.spelling").alias("spelling")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s.names")))).alias("names"))
    return known.withColumn("learned", F.lit(False)).withColumn("initials", F.transform("names", lambda n: F.substring(n, 1, 1)))


def _blocked(profiles: DataFrame) -> DataFrame:
    """Profiles by block key: spellings less one letter, and the first letters for names cut off."""
    exact = profiles.withColumn("block", F.explode(F.when(F.col("learned"), F.array(F.regexp_replace("spelling", " ", ""))).otherwise(_block_keys("spelling"))))
    flat = F.regexp_replace("spelling", " ", "")
    cut = profiles.where(~F.col("learned")).withColumn("block", F.concat(F.substring(flat, 1, CUT), F.lit("*")))
    return exact.unionByName(cut)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _record_blocks(words: pd.Series, given: pd.Series, initial: pd.Series, cut: pd.Series, shape: pd.Series) -> pd.Series:
    out = []
    for w, g, i, c, s in zip(words, given, initial, cut, shape):
        keys = set()
        for surname, _, _ in readings(w, g, i, s):
            flat = surname.replace(" ", "")
            keys.update([*_deletions(flat), sound(flat) + "~", surname + "+"])
            if c and len(flat) >= CUT:
                keys.add(flat[:CUT] + "*")
        out.append(sorted(keys))
    return pd.Series(out)


def match_once(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(record columns, member_id, tier, read) of the records that fit exactly one member at their best tier."""
    columns = ["term", "surname", "given", "initial", "cut", "shape"]
    blocks = records.withColumn("block", F.explode(_record_blocks("surname", "given", "initial", "cut", "shape")))
    pairs = salted_join(blocks, _blocked(profiles), ["term", "block"]).select(*columns, "member_id", "spelling", "learned", F.col("names"), F.col("initials")).distinct()
    pairs = pairs.withColumn("fit", _compare("surname", "given", "initial", "cut", "shape", "spelling", "learned", "names", "initials")).where("fit.tier is not null")
    best = pairs.groupBy(*columns, "member_id").agg(F.min(F.struct("fit.tier", "fit.surname", "fit.given", "fit.initial")).alias("fit"))
    # all members at the best tier: few, as members of a term that share a block
    top = best.groupBy(*columns).agg(F.min("fit.tier").alias("tier"), F.collect_set(F.struct(F.col("fit.tier").alias("tier"), "member_id", "fit")).alias("fits"))
    top = top.withColumn("fits", F.filter("fits", lambda f: f["tier"] == F.col("tier"))).where(F.size("fits") == 1)
    return top.select(*columns, F.col("fits")[0]["member_id"].alias("member_id"), "tier", F.col("fits")[0]["fit"].alias("read"))


def merge_and_rematch(records: DataFrame, profiles: DataFrame, rounds: int = 10) -> DataFrame:
    """(record columns, member_id) of all records that name exactly one member.

    Stops after the first round that merges nothing (``rounds`` is only a guard against endless loops and raises).
    A spelling learned from a record with a given name or initial counts as the member's from then on, but only if
    no other member of the term is written so; it matches as it stands, without further slips, so that spellings don't drift.
    """
    columns = ["term", "surname", "given", "initial", "cut", "shape"]
    left, merged = checkpoint(records.select(*columns).distinct()), None
    for _ in range(rounds):
        new = checkpoint(match_once(left, profiles))
        if new.isEmpty():
            break
        merged = new if merged is None else merged.unionByName(new)
        learned = new.where((F.col("tier") == 2) & ((F.col("read.given") != "") | (F.col("read.initial") != "")))
        learned = learned.groupBy("term", "member_id", F.col("read.surname").alias("spelling")).agg(F.lit(True).alias("learned"))
        single = learned.groupBy("term", "spelling").agg(F.countDistinct("member_id").alias("n")).where("n = 1").drop("n")
        # several members may carry a surname; a slip of it that only one of them was given stays open
        shared = profiles.where(~F.col("learned")).groupBy("term", "spelling").agg(F.countDistinct("member_id").alias("n")).where("n > 1")
        owners = profiles.where(~F.col("learned")).join(shared.drop("n"), ["term", "spelling"]).select("term", "member_id").distinct()
        learned = learned.join(single, ["term", "spelling"]).join(owners, ["term", "member_id"], "left_anti")
        learned = learned.join(profiles.select("term", "member_id", "spelling"), ["term", "member_id", "spelling"], "left_anti")
        given = new.where((F.col("read.given") != "") & (F.col("tier") < 2)).groupBy("term", "member_id").agg(F.collect_set("read.given").alias("more"))
        known = profiles.where(~F.col("learned")).select("term", "member_id", "names", "initials").distinct()
        enriched = profiles.unionByName(learned.join(known, ["term", "member_id"])).join(given, ["term", "member_id"], "left")
        enriched = enriched.withColumn("names", F.array_sort(F.array_union("names", F.coalesce("more", F.array().cast("array<string>")))))
        letters = F.transform(F.coalesce("more", F.array().cast("array<string>")), lambda x: F.substring(x, 1, 1))
        enriched = enriched.withColumn("initials", F.array_union("initials", letters)).drop("more")
        profiles = checkpoint(enriched)
        left = checkpoint(left.join(new.select(*columns), columns, "left_anti"))
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    empty = records.select(*columns).limit(0).withColumn("member_id", F.lit(None).cast("long"))
    return empty if merged is None else merged.select(*columns, "member_id")


def link_speakers(df: DataFrame, registry: DataFrame, label: str = "speaker_raw", term: str = "assembly", out: str = "member_id") -> DataFrame:
    """``df`` with ``out``: the registry member that the label names in the row's term; NULL where it names none or several.

    NULL and empty labels, offices alone and rows without a known term get NULL.
    """
    terms = F.create_map(*(F.lit(x) for pair in TERMS.items() for x in pair))
    rows = df.withColumn("_term", F.coalesce(F.get(F.array(F.try_element_at(terms, F.upper(F.trim(F.col(term))))), F.lit(0)), F.lower(F.trim(F.col(term))))).withColumn("_r", _records(F.col(label)))
    records = rows.where(F.col("_r.surname").isNotNull() & F.col("_term").isNotNull()).select(F.col("_term").alias("term"), "_r.*").distinct()
    known = merge_and_rematch(records, checkpoint(registry_profiles(registry)))
    known = known.select(F.struct("surname", "given", "initial", "cut", "shape").alias("_r"), F.col("term").alias("_term"), F.col("member_id").alias("_member"))
    named = salted_join(rows.where(F.col("_r.surname").isNotNull()), known, ["_term", "_r"], "left")
    none = rows.where(F.col("_r.surname").isNull()).withColumn("_member", F.lit(None).cast("long"))
    return named.unionByName(none).withColumn(out, F.col("_member")).drop("_term", "_r", "_member")


@F.pandas_udf(T.BooleanType())
def _plain(labels: pd.Series, surnames: pd.Series) -> pd.Series:
    return pd.Series([any(is_plain(x, s) for s in ss) for x, ss in zip(labels, surnames)], dtype=bool)


def variant_names(df: DataFrame, registry: DataFrame, keys: list[str], label: str = "speaker_raw", term: str = "assembly") -> DataFrame:
    """(keys, member_id): rows whose label names exactly one member, but not in the plain form.

    NULL and empty labels, offices alone, labels that fit several members and rows without a known term give no rows;
    redelivered rows count once. An empty registry gives no rows.
    """
    linked = link_speakers(df.select(*keys, label, term), registry, label, term).where(F.col("member_id").isNotNull())
    surnames = registry_profiles(registry).groupBy("member_id").agg(F.collect_set("spelling").alias("_surnames"))
    return salted_join(linked, surnames, ["member_id"]).where(~_plain(label, "_surnames")).select(*keys, "member_id").distinct()
