"""Variant spellings of names, linked through their canonical rewritings.

Each distinct spelling is rewritten in every way the rules allow: nicknames become
given names, titles go, legal forms take one spelling or go, order does not matter,
a given name may shrink to its initial, and a typo is met by leaving out one letter.
Middle names may be missing or shrink to an initial, but two different ones are two
persons. Forms are exploded and joined; the rarity of a form is one over the number
of persons who share it, and only a form of rarity one, which leads to one person,
decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.components import connected_components
from mosaicry.operators.hashes import star_links
from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize

# Given names with their short and pet forms. Names of other languages and rarer forms are a parameter.
NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe", "albert": "al bert bertie", "alexander": "alex alec sandy", "alexandra": "alex sandra lexie", "alfred": "alfie fred", "amanda": "mandy", "andrew": "andy drew",
    "anthony": "tony", "arthur": "art artie", "augustus": "gus", "barbara": "babs barb", "bartholomew": "bart", "beatrice": "bea", "benjamin": "benny ben", "bernard": "bernie", "bridget": "biddy",
    "caroline": "carrie", "catherine": "cathy kate", "charles": "charlie chuck", "charlotte": "lottie", "christina": "chris tina", "christopher": "kit chris", "clifford": "cliff", "constance": "connie",
    "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb", "dominic": "dom", "donald": "don donnie", "dorothy": "dot dolly", "douglas": "doug", "edmund": "ed eddie",
    "edward": "ned eddie ted", "eleanor": "nora ellie", "elizabeth": "liz beth betty lizzie libby eliza", "emily": "em", "ernest": "ernie", "eugene": "gene", "florence": "flo", "frances": "fran francie",
    "francis": "frank", "frederick": "fritz fred freddie", "gabriel": "gabe", "geoffrey": "geoff", "gerald": "gerry", "gregory": "greg", "gwendolyn": "gwen", "harold": "hal harry", "harriet": "hattie",
    "henrietta": "hettie", "henry": "hank", "herbert": "herb", "isabella": "izzy bella", "isidore": "izo", "jacob": "jake", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny",
    "jeremiah": "jerry", "jessica": "jess", "jonathan": "jon", "joseph": "joe joey", "josephine": "josie jo", "joshua": "josh", "judith": "judy", "katherine": "kathy katie kay", "kenneth": "ken kenny",
    "kimberly": "kim", "lawrence": "larry", "leonard": "len lenny", "lillian": "lily", "louis": "lou", "lucille": "lucy", "madeleine": "maddie", "margaret": "peggy maggie meg", "martha": "patsy", "matilda": "tilda tilly",
    "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey", "mildred": "millie", "mitchell": "mitch", "nancy": "nan", "nathaniel": "nate nat", "nicholas": "nick nicky", "nicolette": "colette nicky",
    "octavia": "tavi", "oliver": "ollie", "pamela": "pam", "patricia": "trish pat patty", "patrick": "paddy pat", "penelope": "penny", "peter": "pete", "phillip": "pip phil", "priscilla": "prissy", "prudence": "prue",
    "quentin": "quent", "quilla": "quill", "raymond": "ray", "rebecca": "becky", "reginald": "reg reggie", "richard": "dick rick richie", "robert": "bob bobby rob", "roderick": "rod", "ronald": "ron ronnie",
    "rosemary": "rosie", "samuel": "sam sammy", "sebastian": "seb", "solomon": "sol", "stanley": "stan", "stephanie": "steph", "stephen": "steve stevie", "susannah": "suki sue", "sylvester": "sly", "tabitha": "tabby",
    "terence": "terry", "theodore": "teddy theo ted", "theresa": "tess", "thomas": "tom tommy", "timothy": "tim", "tobias": "toby", "ulysses": "uly", "ursula": "ulla", "valerie": "val", "veronica": "ronnie",
    "victoria": "vicky tori", "vincent": "vinnie vince", "virginia": "ginny", "walter": "walt wally", "wilhelmina": "mina", "william": "bill billy will", "winifred": "winnie", "xanthe": "xan",
    "xavier": "xavi", "yannick": "yan", "yolanda": "yoli", "zachary": "zack", "zuleika": "zula",
}
# Words before or after a personal name that are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor capt captain sir dame rev col sgt lt hon jr sr ii iii phd md".split())
# Legal forms of organisations, each with its spellings.
LEGAL = {
    "ltd": "ltd limited", "inc": "inc incorporated", "llc": "llc", "corp": "corp corporation", "co": "co company", "plc": "plc", "gmbh": "gmbh", "ag": "ag aktiengesellschaft", "bv": "bv", "nv": "nv", "sa": "sa", "llp": "llp", "kg": "kg",
}
# Words that stand for a name nobody has given.
PLACEHOLDERS = frozenset("unknown unnamed nobody none null na nan test tbd face person people untitled anonymous someone".split())
# Particles that belong to the surname after them.
PARTICLES = frozenset("van von de del della di da la le du den der ten ter bin ibn al st".split())

_LEGAL = {w: k for k, ws in LEGAL.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def given_names(nicknames: dict[str, str]) -> dict[str, list[str]]:
    """The given names that each short form may stand for."""
    out: dict[str, list[str]] = {}
    for g, ns in nicknames.items():
        for n in ns.split():
            out.setdefault(n, []).append(g)
    return out


_GIVEN = given_names(NICKNAMES)


def parse(name: str | None, given: dict[str, list[str]] = _GIVEN) -> tuple[str, str, str, str] | None:
    """(kind, first, middle, last) of a spelling; None if it names nobody.

    full: a person; initial: with a one-letter first; org: with a legal form, whose
    words are in ``first`` and whose legal form is in ``last``; single: one word of three letters at least
    that is neither a given name nor a placeholder.
    """
    if not name:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("_", " ")
    words = _TOKEN.findall(plain.replace(".", " ") if re.search(r"\b\w\.\w\.", plain) else plain)
    n = len(words)
    while n > 1 and words[n - 1] in _LEGAL:
        n -= 1
    if n < len(words):
        return ("org", " ".join(sorted(words[:n])), "", _LEGAL[words[-1]])
    if plain.count(",") == 1:
        last, first = plain.split(",")
        if any(t not in TITLES for t in _TOKEN.findall(first)):
            plain = f"{first} {last}"
    tokens: list[str] = []
    for t in (t for t in _TOKEN.findall(plain) if t not in TITLES):
        if tokens and len(tokens) > 1 and tokens[-1].split(" ")[-1] in PARTICLES:
            tokens[-1] += " " + t
        else:
            tokens.append(t)
    if len(tokens) == 1:
        one = tokens[0]
        known = one in given or any(one in g for g in given.values()) or one in NICKNAMES
        return None if len(one) < 3 or known or one in PLACEHOLDERS or words != tokens or any(map(str.isdigit, plain)) else ("single", one, "", "")
    if not tokens or PLACEHOLDERS.intersection(tokens):
        return None
    first, last, middle = tokens[0], tokens[-1], " ".join(tokens[1:-1])
    if len(last) == 1 and len(first) > 1:
        first, last = last, first
    if len(last) == 1:
        return None
    return ("initial", first, "", last) if len(first) == 1 else ("full", first, middle, last)


def _shorter(t: str) -> set[str]:
    return {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))} if len(t) > 3 else {t}


def rewritings(kind: str, first: str, middle: str, last: str, given: dict[str, list[str]] = _GIVEN) -> list[tuple[int, str, str]]:
    """(tier, form, changed) of a spelling; lower tiers say more. ``changed`` is the part that lost a letter.

    Tier 0: all names in order, or with the last one moved to the front. 1: both names, unordered; an
    organisation's words and legal form; a single word. 2: one name kept, a letter of the other left
    out. 3: initial and surname; an organisation without its legal form. 4: initial, and a letter of the surname left out.
    """
    out = set()
    if kind == "initial":
        out.add((3, f"i|{first}|{last}", ""))
        out |= {(4, f"j|{first}|{s}", last) for s in _shorter(last)}
    elif kind == "org":
        out |= {(1, f"o|{last}|{first}", ""), (3, f"b|{first}", "")}
        words = first.split(" ")
        for i, w in enumerate(words):
            rest = " ".join(words[:i] + words[i + 1 :])
            out |= {(2, f"x|{last}|{rest}|{s}", w) for s in _shorter(w)}
    elif kind == "single":
        out |= {(1, f"s|{first}", ""), (3, f"b|{first}", "")}
    else:
        for a in given.get(first, [first]):
            if middle:
                out |= {(0, f"t|{a} {middle} {last}", ""), (0, f"t|{middle} {last} {first}", "")}
            for b in given.get(last, [last]) if first not in given else [last]:
                out.add((1, "e|" + "|".join(sorted((a, b))), ""))
                for x, y in ((a, b), (b, a)):
                    out |= {(2, f"d|{x}|{s}", y) for s in _shorter(y)}
                    out.add((3, f"i|{x[0]}|{y}", ""))
                    out |= {(4, f"j|{x[0]}|{s}", y) for s in _shorter(y)}
    return sorted(out)


def _spellings(given: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(n, given) for n in b.column(0).to_pylist()]
            open_ = lambda g: g[0] == "full" and len({f for t, f, _ in rewritings(*g, given) if t == 1}) > 1
            kind = [g[0] + ("?" if open_(g) else "") if g else None for g in got]
            node = ["|".join((g[0][0], *g[1:])) if g else None for g in got]
            middle = [g[2] if g else None for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in (kind, node, middle))], names=["name", "kind", "node", "middle"])

    return run


def _forms(given: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, k, m, *f) for k, n, m in zip(*(b.column(i).to_pylist() for i in range(3))) for f in rewritings(k.rstrip("?"), *n.split("|")[1:], given)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["node", "kind", "middle", "tier", "form", "changed"])

    return run


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one letter added, lost, replaced, or swapped with its neighbour."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def _spread(t: DataFrame, rows: int = 5_000) -> DataFrame:
    """A written table in parts of about so many rows, for work that multiplies them."""
    return t.repartition(max(1, -(-t.count() // rows)))


def spellings(names: DataFrame, id_col: str, name: str, given: dict[str, list[str]] = _GIVEN) -> DataFrame:
    """(id, kind, node, middle): each row's spelling; rows that name nobody are left out."""
    rows = names.select(F.col(id_col).cast("long").alias("id"), F.col(name).alias("name")).filter("id IS NOT NULL AND name IS NOT NULL").dropDuplicates(["id"])
    known = _spread(materialize(rows.select("name").distinct(), "names")).mapInArrow(_spellings(given), "name string, kind string, node string, middle string").filter("node IS NOT NULL")
    return rows.join(known, "name").select("id", "kind", "node", "middle")


def compatible_middles(a: Column, b: Column) -> Column:
    """Whether two middle names may be one person's: one is missing, they are equal, or one is the other's initial."""
    short = (F.length(a) == 1) | (F.length(b) == 1)
    return (a == "") | (b == "") | (a == b) | (short & (F.substring(a, 1, 1) == F.substring(b, 1, 1)))


def _middle_classes(exact: DataFrame) -> DataFrame:
    """(node, form, mid): the middle name each spelling of a tier 1 form stands for, as far as the others of the form tell.

    An initial stands for the only name that begins with it; no middle name stands for the only one there is. Where
    there are several, such a spelling stands for itself.
    """
    t = exact.select("node", "form", "middle", F.substring("middle", 1, 1).alias("letter"))
    long = t.filter("length(middle) > 1").groupBy("form", "letter").agg(F.min("middle").alias("lo"), F.max("middle").alias("hi"))
    t = t.join(long, ["form", "letter"], "left")
    t = t.withColumn("mid", F.when((F.length("middle") == 1) & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("middle")))
    only = t.filter("mid <> ''").groupBy("form").agg(F.min("mid").alias("lo"), F.max("mid").alias("hi")).filter("lo = hi").select("form", F.col("lo").alias("only"))
    t = t.select("node", "form", "mid").join(only, "form", "left")
    return t.select("node", "form", F.when(F.col("mid") == "", F.coalesce("only", F.lit(""))).otherwise(F.col("mid")).alias("mid"))


def link_names(register: DataFrame, reg_id: str, reg_name: str, others: DataFrame | None = None, other_id: str = "id", other_name: str = "name", nicknames: dict[str, str] = NICKNAMES) -> tuple[DataFrame, DataFrame | None]:
    """((id, person_id) of the register, the same of ``others``): rows that mean one person or organisation get its smallest register id.

    Spellings of the register that share a tier 0 or 1 form, or a tier 2 form and
    differ in one edit, are one person, also through others, unless their middle names
    differ; a spelling without a middle name goes to the only person it may mean, or
    stands for itself. Initials, ambiguous nicknames, single words and the names of ``others`` then join
    the person of their lowest tier with any match, if its forms have rarity one, that is,
    lead to one person only. Those of the register that match nobody mean one
    person each if spelled alike; those that lead to several mean nobody. Placeholders, nulls and names of nobody in
    the register get no row. Repeated ids count once.
    """
    given = given_names(nicknames)
    schema = "node string, kind string, middle string, tier int, form string, changed string"

    def forms_of(nodes: DataFrame) -> DataFrame:
        return _spread(nodes.select("kind", "node", "middle")).mapInArrow(_forms(given), schema)

    reg = materialize(spellings(register, reg_id, reg_name, given), "register")
    nodes = materialize(reg.select("kind", "node", "middle").distinct(), "nodes")
    forms = materialize(forms_of(nodes), "forms")
    full = forms.filter("kind IN ('full', 'org')")
    mids = materialize(_middle_classes(full.filter("tier = 1")), "middles")
    exact = star_links(mids.select("node", F.concat_ws("|", "form", "mid").alias("form")), "node", "form").unionByName(star_links(full.filter("tier = 0"), "node", "form"))
    mid = mids.select("node", "mid")
    two = full.filter("tier = 2").join(mid, "node").select("form", "node", "changed", "mid")
    left = two.select("form", F.col("node").alias("a"), F.col("changed").alias("ca"), F.col("mid").alias("ma"))
    near = salted_join(left, two.select("form", F.col("node").alias("b"), F.col("changed").alias("cb"), F.col("mid").alias("mb")), "form", "a")
    near = near.filter("a < b").filter(compatible_middles(F.col("ma"), F.col("mb"))).select("a", "b", "ca", "cb", "ma", "mb").distinct()
    near = materialize(near.filter(one_edit(F.col("ca"), F.col("cb"))).select("a", "b", "ma", "mb"), "near")
    # a misspelling without a middle name that is near to persons with different ones decides nothing
    both = near.select(F.col("a").alias("node"), "ma", "mb").unionByName(near.select(F.col("b").alias("node"), F.col("mb").alias("ma"), F.col("ma").alias("mb"))).filter("ma = '' AND mb <> ''")
    vague = both.groupBy("node").agg(F.min("mb").alias("lo"), F.max("mb").alias("hi")).filter(~compatible_middles(F.col("lo"), F.col("hi"))).select("node")
    told, plain = near.filter("ma <> '' OR mb <> ''"), near.filter("ma = '' AND mb = ''")
    told = told.join(vague.withColumnRenamed("node", "a"), "a", "left_anti").join(vague.withColumnRenamed("node", "b"), "b", "left_anti")
    links = exact.unionByName(told.unionByName(plain).select("a", "b"))
    comp = connected_components(links).withColumnsRenamed({"node": "n", "component": "c"})
    person = nodes.filter("kind IN ('full', 'org')").join(comp, F.col("node") == F.col("n"), "left").select("node", F.coalesce("c", "node").alias("person"))
    person = materialize(person, "persons")
    # what a form of the register's persons leads to: one person, or from the first to the last of several
    targets = full.join(person, "node").join(mid, "node").groupBy("tier", "form", "changed", "mid").agg(F.min("person").alias("p"), F.max("person").alias("q"))
    targets = materialize(targets, "targets")

    def attach(some: DataFrame) -> DataFrame:
        hit = some.select("node", "tier", "form", F.col("changed").alias("mine"), "middle").join(targets, ["tier", "form"])
        hit = hit.filter(compatible_middles(F.col("middle"), F.col("mid"))).filter((F.col("changed") == "") | one_edit(F.col("mine"), F.col("changed")))
        best = hit.groupBy("node", "tier").agg(F.min("p").alias("p"), F.max("q").alias("q"))
        best = best.groupBy("node").agg(F.min_by(F.struct("p", "q"), "tier").alias("b"))
        return best.select("node", F.when(F.col("b.p") == F.col("b.q"), F.col("b.p")).alias("person"))

    loose = materialize(attach(forms.filter("kind NOT IN ('full', 'org')")), "attached")
    alone = nodes.filter("kind NOT IN ('full', 'org')").select("node").join(loose.select("node"), "node", "left_anti").select("node", F.col("node").alias("person"))
    person_all = materialize(person.unionByName(loose.filter("person IS NOT NULL")).unionByName(alone), "persons")
    rows = reg.join(person_all, "node").select("id", "person")
    smallest = materialize(rows.groupBy("person").agg(F.min("id").alias("person_id")), "smallest")
    mine = materialize(rows.join(smallest, "person").select("id", "person_id"), "linked")
    if others is None:
        return mine, None
    oth = materialize(spellings(others, other_id, other_name, given), "others")
    kinds = materialize(oth.select("kind", "node", "middle").distinct(), "nodes")
    theirs = attach(forms_of(kinds).filter("kind <> 'full' OR tier < 3")).filter("person IS NOT NULL")
    return mine, oth.join(theirs, "node").join(smallest, "person").select("id", "person_id")
