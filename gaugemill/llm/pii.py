"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Fixed patterns find the personal data: e-mail addresses, IP addresses, card and phone numbers. Each stands for two protected entities, itself
and the group it belongs to (an address's domain, a network, an issuer, an area). Corpus co-occurrence then
estimates how strongly other words reveal them. With N documents, n(e) with entity e, n(t) with term t anywhere, and
n(t,e) with both, t outside of base spans, the disclosure of e by t is the share of e's information content that t gives away:

    disclosure(t, e) = log(n(t,e) N / (n(t) n(e))) / log(N / n(e))

1 means that t names e. A pair needs support in s >= ``SUPPORT`` different texts, and more than chance would give: with l = n(t) n(e) / N and P pairs
in the corpus, P l^s / s! at most ``CHANCE`` (by Stirling's formula). So in a large corpus two rare words that meet twice prove nothing. Then
disclosure of at least ``GENERALISE`` adds a span of kind ``term`` wherever t stands, in documents that name no entity too. In sanitised texts such a term is generalised: to the
word that reveals most of e below the threshold among those that stand in at least ``COVER`` of t's documents with e and in more documents
than t. What is left of the disclosure is then that word's. Terms without such a word, and from ``REMOVE`` on, are removed.

Results: null and empty texts have no spans. Base spans of one kind don't overlap and are always reported; a term never overlaps
one. Spans of different kinds may overlap; in a sanitised text the earlier one, or of two at one place the longer one, is
replaced. A term that reveals several entities counts with its strongest, ties by the entity's name. Equal rows give equal results, an
empty table none. Very long texts are searched whole, in time that grows with their length. Extra columns stay in
``sanitised``, whatever their names; columns of ``spans`` are its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import discard, free_name, scratch, sized, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE, COVER = 2, 0.9, 0.99, 0.8
#: Pairs that may come by chance: a term isn't revealing where so many of the corpus's pairs would have its support anyway.
CHANCE = 0.1
#: Terms, or entries of texts' lists of them, up to whose number a table of them is sent to every executor; beyond, the same join is merged.
BROADCAST_TERMS = 200_000
#: Changed rows up to whose number their spans are sent to every executor; beyond, texts are shuffled.
BROADCAST_ROWS = 50_000
BLOCK = 64
WORD = r"\p{L}{3,}"
#: Fixed patterns, as they are given. What stands before [0-9]++ or the local part keeps a long run from being tried at
#: each of its characters; it changes no match. Possessive repeats don't either, as nothing that follows could use their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these have none of the kind's.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERMS = "array<struct<kind:string,start:bigint,end:bigint,disclosure:double,broader:string>>"
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def running(lengths: Column) -> Column:
    """The sums of an array's numbers before each place and after the last. Sums are made in blocks, so that no long array is copied for each number."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def sums(first: Column, numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def whole(found: Column) -> Column:
        firsts = sums(F.lit(0).cast("long"), F.transform(found, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x)))
        inner = F.transform(found, lambda b, i: F.slice(sums(F.get(firsts, i), b), F.lit(1), F.size(b)))
        return F.concat(F.flatten(inner), F.array(F.element_at(firsts, -1)))

    return F.element_at(F.transform(F.array(blocks), whole), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points: what lies between them gives the places."""
    found = F.struct(F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def placed_in(f: Column) -> Column:
        lengths = F.zip_with(f["gaps"], F.transform(f["values"], lambda v: F.length(v).cast("long")), lambda g, n: g + F.coalesce(n, F.lit(0).cast("long")))
        both = F.struct(f["values"].alias("values"), f["gaps"].alias("gaps"), running(lengths).alias("at"))
        return F.element_at(F.transform(F.array(both), spans_of), 1)

    def spans_of(b: Column) -> Column:
        return F.transform(b["values"], lambda v, i: F.struct((F.get(b["at"], i) + F.get(b["gaps"], i)).alias("start"), F.get(b["at"], i + 1).alias("end"), v.alias("value")))

    return F.element_at(F.transform(F.array(found), placed_in), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def part_fits(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(number) <= 3) & (F.substring(number, 1, 3).cast("int") <= 255)


def valid(kind: str, value: Column) -> Column:
    number = digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), part_fits)
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """The names of an entity, however it is written, and of its group."""
    own = F.lower(value) if kind == "email" else digits(value) if kind in ("card", "phone") else value
    group = {"email": F.substring_index(own, "@", -1), "ip": F.substring_index(own, ".", 3), "card": F.substring(own, 1, 6), "phone": F.substring(own, 1, 4)}[kind]
    return F.array(F.concat(F.lit(f"{kind}:"), own), F.concat(F.lit(f"{kind} group:"), group))


def named_spans(text: Column, kind: str) -> Column:
    kept = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), entity(kind, s["value"]).alias("entities")))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then by place: array of (kind, start, end, entity)."""
    parts = []
    for kind in KINDS:
        named = named_spans(text, kind)
        parts.append(F.when(text.rlike(HINTS[kind]), named).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,entities:array<string>>>")))
    return F.concat(*parts)


#: Marks that are put in order at a time, characters of a text in a block: what is copied for one mark.
MARKS, CHARS = 256, 1024


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def replaced(text: Column, marks: Column, cover: bool = False) -> Column:
    """The text with each of ``marks``, an ordered array of (start, end, put), replaced by its ``put``, in time that grows with text and marks.

    A mark that begins within the one before it is left out; with ``cover`` its rest is a mark of its own, all ``put`` being blanks. Marks become
    cuts, ``MARKS`` at a time; the text is taken apart into blocks of ``CHARS`` characters, so a cut looks at its own blocks only."""

    def cut(acc: Column, s: Column) -> Column:
        if cover:
            upto, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
            new = F.struct(acc["at"].alias("begin"), upto.alias("upto"), F.repeat(F.lit(" "), (end - upto).cast("int")).alias("put"))
            return F.struct(end.alias("at"), F.concat(acc["cuts"], F.array(new)).alias("cuts"))
        new = F.struct(acc["at"].alias("begin"), s["start"].alias("upto"), s["put"].alias("put"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["cuts"], F.array(new)).alias("cuts"))).otherwise(acc)

    none = F.array().cast("array<struct<begin:bigint,upto:bigint,put:string>>")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / MARKS).cast("int")), lambda i: F.slice(marks, i * MARKS + 1, F.lit(MARKS)))

    def cut_group(acc: Column, group: Column) -> Column:
        own = F.aggregate(group, F.struct(acc["at"].alias("at"), none.alias("cuts")), cut)
        return bound(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["groups"], F.array(o["cuts"])).alias("groups")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<begin:bigint,upto:bigint,put:string>>>").alias("groups"))
    last = lambda acc: F.concat(F.flatten(acc["groups"]), F.array(F.struct(acc["at"].alias("begin"), F.length(text).cast("long").alias("upto"), F.lit("").alias("put"))))
    cuts = F.aggregate(groups, begin, cut_group, last)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))

    def piece(both: Column, c: Column) -> Column:
        first = F.floor(c["begin"] / CHARS).cast("int")
        near = F.array_join(F.slice(both["blocks"], first + 1, F.floor((c["upto"] - 1) / CHARS).cast("int") - first + 1), "")
        return F.when(c["upto"] > c["begin"], F.concat(F.substring(near, (c["begin"] % CHARS + 1).cast("int"), (c["upto"] - c["begin"]).cast("int")), c["put"])).otherwise(c["put"])

    joined = bound(F.struct(blocks.alias("blocks"), cuts.alias("cuts")), lambda both: F.array_join(F.transform(both["cuts"], lambda c: piece(both, c)), ""))
    return F.when(F.size(marks) > 0, joined).otherwise(text)


def outside(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans, so that places stay."""
    marks = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put"))))
    return bound(marks, lambda m: replaced(text, m, cover=True))


def terms_of(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def placed(text: Column, known: Column) -> Column:
    """Every occurrence of a key of ``known``, a map from terms to (disclosure, broader): array of (kind, start, end, disclosure, broader) by place."""
    found = F.transform(matches(text, WORD), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(known, F.lower(m["value"])).alias("of")))
    hits = F.filter(found, lambda m: m["of"].isNotNull())
    return F.transform(hits, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["of"]["disclosure"].alias("disclosure"), m["of"]["broader"].alias("broader")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame, folder: str) -> DataFrame:
    """Per row of ``docs`` doc_id, row (a hash of id and text), words (one of the text), base, and with base spans rest, the text outside of them; written, so that the texts are searched once."""
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    based = text.withColumn("base", base_spans(F.col("text")))
    rest = F.when(F.size("base") > 0, outside(F.col("text"), F.col("base")))
    return stored(based.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("words"), "base", rest.alias("rest")), f"{folder}/detected")


def together(found: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The entities of at least ``SUPPORT`` texts, with their documents and id; and each text that holds some: words, docs, entities (ids), rest."""
    held = found.filter(F.size("base") > 0)
    # copies of a text are many documents but one support
    each = stored(held.select("words", F.explode(F.array_distinct(F.flatten(F.transform("base", lambda s: s["entities"])))).alias("entity")).groupBy("words", "entity").agg(F.count(F.lit(1)).alias("docs")), f"{folder}/each")
    entities = stored(each.groupBy("entity").agg(F.sum("docs").alias("of_entity"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT).drop("texts").withColumn("id", F.xxhash64("entity")), f"{folder}/entities")
    # a list is as long as a text has entities
    own = each.join(entities.hint("merge"), "entity").groupBy("words").agg(F.max("docs").alias("docs"), F.collect_list("id").alias("entities"))
    texts = held.select("words", "rest").dropDuplicates(["words"])
    return entities, stored(own.join(texts.hint("merge"), "words"), f"{folder}/together")


def both(texts: DataFrame) -> DataFrame:
    """Each entity of a text with each of the text's terms: words, docs, id, term."""
    return texts.select("words", "docs", "entities", F.explode(terms_of(F.col("rest"))).alias("term")).select("words", "docs", "term", F.explode("entities").alias("id"))


def estimated(docs: DataFrame, total: int, entities: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Disclosure of every (term, entity) with support, from counts over all documents: term, id, entity, of_term, joint, disclosure, chance (a logarithm)."""
    joint = stored(both(texts).groupBy("id", "term").agg(F.sum("docs").alias("joint"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT), f"{folder}/joint")
    terms = stored(joint.select("term").distinct(), f"{folder}/terms")
    words = docs.select(F.explode(terms_of(F.col("text").cast("string"))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:  # other words never leave their task
        of_term = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    else:  # words are counted before they are joined: a common term is one row of each task
        of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("of_term")).join(terms.hint("merge"), "term", "left_semi")
    known = joint.join(of_term.hint("merge"), "term").join(entities.hint("merge"), "id").withColumn("of_term", F.greatest("of_term", "joint"))
    information = F.log(F.lit(float(total)) / F.col("of_entity"))
    disclosure = F.when(information > 0, F.log(F.col("joint") * float(total) / (F.col("of_term") * F.col("of_entity"))) / information)
    s = F.col("texts").cast("double")
    by_chance = s * F.log(F.col("of_term") * F.col("of_entity") / float(total)) - (s * F.log(s) - s + F.log(2 * math.pi * s) / 2) + math.log(max(1, joint.count()))
    done = stored(known.select("term", "id", "entity", "of_term", "joint", disclosure.alias("disclosure"), by_chance.alias("chance")), f"{folder}/estimated")
    discard(docs.sparkSession, f"{folder}/joint", f"{folder}/terms")
    return done


def revealing(known: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """The terms beyond the threshold: term, disclosure, entity (the one they reveal most), broader (null where none is safe, or the term is removed) and left, its disclosure."""
    strong = known.filter((F.col("disclosure") >= GENERALISE) & (F.col("chance") <= math.log(CHANCE))).groupBy("term").agg(F.max_by(F.struct("id", "entity", "of_term", "joint", "disclosure"), F.struct("disclosure", "entity")).alias("s")).select("term", "s.*")
    strong = stored(strong, f"{folder}/strong")
    weak = known.filter(F.col("disclosure") < GENERALISE).select("id", F.col("term").alias("broader"), F.col("of_term").alias("of_broader"), F.col("disclosure").alias("left"))
    # the other words of a term's documents with its entity; counted before they are joined. Terms that are removed need none
    open_to = sized(strong.filter(F.col("disclosure") < REMOVE).select("term", "id"), BROADCAST_TERMS)
    beside = both(texts).join(open_to, ["term", "id"]).select("words", "docs", "term", "id")
    others = beside.join(texts.select("words", "rest").hint("merge"), "words").select("term", "id", "docs", F.explode(terms_of(F.col("rest"))).alias("broader"))
    shared = others.groupBy("term", "id", "broader").agg(F.sum("docs").alias("shared")).join(strong.select("term", "of_term", "joint").hint("merge"), "term")
    fit = shared.filter(F.col("shared") >= COVER * F.col("joint")).join(weak.hint("merge"), ["id", "broader"]).filter("of_broader > of_term")
    best = fit.groupBy("term").agg(F.max_by(F.struct("broader", "left"), F.struct("left", "broader")).alias("b")).select("term", "b.*")
    return stored(strong.join(best.hint("merge"), "term", "left").select("term", "entity", "disclosure", "broader", "left"), f"{folder}/revealing")


def spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` doc_id, row, base and terms: the base spans, and the revealing terms as (kind, start, end, disclosure, broader)."""
    folder = scratch(docs.sparkSession, "pii")
    found = detected(docs, folder)
    entities, texts = together(found, folder)
    strong = sized(revealing(estimated(docs, found.count(), entities, texts, folder), texts, folder), BROADCAST_TERMS)
    discard(docs.sparkSession, *(f"{folder}/{name}" for name in ("each", "together", "entities", "estimated", "strong")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.xxhash64(text).alias("words"), F.explode(terms_of(text)).alias("term"))
    # a map is as long as a text has revealing terms
    hit = words.join(strong.select("term", "disclosure", "broader"), "term").groupBy("words").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", F.struct("disclosure", "broader").alias("v"))))).alias("known"))
    hit = sized(stored(hit, f"{folder}/hit"), BROADCAST_TERMS, F.size("known"))
    # their few texts are searched again, so that no row of ``found`` moves for them
    own = docs.select(F.xxhash64(text).alias("words"), text.alias("text")).join(hit, "words").dropDuplicates(["words"])
    rest = own.withColumn("base", base_spans(F.col("text"))).select("words", "known", outside(F.col("text"), F.col("base")).alias("rest"))
    own = stored(rest.select("words", placed(F.col("rest"), F.col("known")).alias("terms")), f"{folder}/placed")
    kept = found.drop("rest").join(sized(own, BROADCAST_TERMS, F.size("terms")), "words", "left")
    return kept.select("doc_id", "row", "base", F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans as text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = spans(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    base, terms = written(F.col("base")), written(F.col("terms"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, revealing terms generalised or removed; n_chars, where there is one, follows."""
    found = spans(docs).filter((F.size("base") > 0) | (F.size("terms") > 0))
    instead = lambda s: F.when((s["disclosure"] >= REMOVE) | s["broader"].isNull(), "").otherwise(F.concat(F.lit("["), s["broader"], F.lit("]")))
    put = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), instead(s).alias("put"))),
    )
    row, own, other, marks_of = (free_name(docs, n) for n in ("row", "own", "other", "put"))
    marks = found.select(F.col("doc_id").alias(own), F.col("row").alias(other), F.array_sort(put).alias(marks_of)).dropDuplicates([own, other])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    side = sized(marks, BROADCAST_ROWS)
    joined = docs.withColumn(row, F.xxhash64("doc_id", text)).join(side, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(row) == F.col(other)), "left")
    whole = F.transform(marks_of, lambda s: F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["put"].alias("put")))
    changed = joined.withColumn("text", F.when(F.col(marks_of).isNull(), F.col("text")).otherwise(bound(whole, lambda m: replaced(F.col("text"), m))))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(marks_of).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
