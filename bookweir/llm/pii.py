"""Personal data: pattern spans, and terms that give away what they stand beside. Native throughout.

Four kinds of entities are found by pattern. A term (a word of a text that holds an entity,
wherever it stands) discloses the entity as far as the corpus ties the two together: with counts
over texts, the pointwise mutual information log2(N n_te / (n_t n_e)) over the entity's own
information log2(N / n_e) is 1 if the term occurs with the entity only, and falls as it occurs
elsewhere. Terms over a first threshold are generalised, over a second one removed, in the
texts that hold the entity. Equal texts are one piece of evidence, and a text is none about
itself: what a term discloses in a text is counted over the other texts. No number of texts is
asked for beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.llm.work import quoted, settle

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The disclosure from which a term is generalised or removed.
GENERALISE = 0.8
REMOVE = 0.95

# Possessive forms of the patterns: the same matches, without going back over long runs. A
# match of an e-mail address starts where its run of characters starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TERMS = r"[\p{L}\p{N}]+"
#: Stands for every character of an entity where words are read; no pattern has it.
_HIDE = "|"
_CHUNK = 512
_SPAN = "array<struct<start:int,end:int,found:string>>"


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _placed(gaps: Column, found: Column) -> Column:
    """Start, end and string of matches, from the text between them, in code points.

    A running sum in chunks, so that the cost stays linear in the number of matches.
    """
    items = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m"))
    )
    last = F.floor((F.size(found) - 1) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _CHUNK + 1, F.lit(_CHUNK)))

    def within(chunk: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(_SPAN).alias("out"))

        def add(a: Column, i: Column) -> Column:
            lo = a["at"] + i["gap"]
            span = F.struct(lo.alias("start"), (lo + i["n"]).alias("end"), i["m"].alias("found"))
            return F.struct((lo + i["n"]).alias("at"), F.array_append(a["out"], span).alias("out"))

        return F.aggregate(chunk, start, add, lambda a: a["out"])

    def whole(parts: Column) -> Column:
        sums = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, i: a + i["gap"] + i["n"]))
        firsts = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + s))
        return F.flatten(F.zip_with(parts, F.slice(firsts, F.lit(1), F.size(parts)), within))

    return _let(chunks, whole)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    digits = _digits(found)
    if kind == "card":
        return _let(digits, lambda d: (F.length(d) <= 19) & _luhn(d))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["found"])


_CUES = {"email": "@", "ip": ".", "phone": "+"}


def with_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """Columns row (struct of all columns), text (null as empty), a span array per kind, and bare: the text with entities blotted out."""
    out = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        every = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        every = F.when(F.contains("text", F.lit(_CUES[kind])), every).otherwise(none) if kind in _CUES else every
        out = out.withColumn(f"{kind}_found", every)
    for kind in KINDS:
        found = F.col(f"{kind}_found")
        spans = _placed(F.split("text", F.lit(PATTERNS[kind]), F.lit(-1)), found)
        valid = F.filter(spans, _check(kind))
        out = out.withColumn(kind, F.when(F.size(found) > 0, valid).otherwise(F.array().cast(_SPAN)))
    out = out.withColumn("bare", F.col("text"))
    for kind in KINDS:
        out = out.withColumn("bare", F.when(F.size(kind) > 0, _blotted(kind, F.col("bare"))).otherwise(F.col("bare")))
    return out.select("row", "text", *KINDS, "bare")


def _blotted(kind: str, text: Column) -> Column:
    """The text, as long as before, without the entities of a kind."""
    pattern = F.lit(PATTERNS[kind])

    def blot(found: Column) -> Column:
        return F.when(_valid(kind, found), F.repeat(F.lit(_HIDE), F.length(found))).otherwise(found)

    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), blot)
    return F.array_join(F.zip_with(F.split(text, pattern, F.lit(-1)), F.array_append(found, F.lit("")), lambda gap, m: F.concat(gap, m)), "")


def _key() -> Column:
    """128 bits that stand for a text: what is found in a text depends on nothing else of its row."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))


def _name(kind: str, found: Column) -> Column:
    """The entity that a match stands for."""
    return F.concat(F.lit(f"{kind}:"), F.lower(found) if kind in ("email", "ip") else _digits(found))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERMS), F.lit(0)), lambda t: F.lower(t)))


def _holders(entities: DataFrame) -> DataFrame:
    """One row per text that holds an entity: key, bare text and the entities in it."""

    def name(kind: str):
        return lambda s: _name(kind, s["found"])

    every = F.concat(*[F.transform(kind, name(kind)) for kind in KINDS])
    return entities.filter(F.size(every) > 0).select(_key().alias("key"), "bare", F.array_distinct(every).alias("entities")).distinct()


def _shared(holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of two texts or more with n_e, and key, bare and such entities of the texts that hold them.

    Of an entity that one text holds, the others say nothing.
    """
    named = holders.select("key", F.explode("entities").alias("entity"))
    n_e = named.groupBy("entity").agg(F.count("*").alias("n_e")).filter("n_e > 1")
    some = named.join(n_e, "entity").groupBy("key").agg(F.collect_list("entity").alias("entities"))
    return n_e, holders.select("key", "bare").join(some, "key")


def _pairs(shared: DataFrame) -> DataFrame:
    """Key, entity and term, for the words of each text and its entities."""
    return shared.select("key", "entities", F.explode(_words(F.col("bare"))).alias("term")).select("key", "term", F.explode("entities").alias("entity"))


def disclosing_terms(entities: DataFrame, holders: DataFrame, least: float = GENERALISE) -> DataFrame:
    """Columns entity, term and disclosure, for the terms that disclose an entity.

    Counts are of different texts, over the whole corpus, without the one that the term is to
    be judged in; it holds both, so that is one less of each. Pairs and words are counted in
    place and combined before the shuffle, so a common entity or word is one row a task.
    """
    n_all = entities.select(_key().alias("key")).distinct().select(F.count("*")).scalar()
    n_e, shared = _shared(holders)
    pairs = _pairs(shared).groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter("n_te > 1")
    texts = entities.select(_key().alias("key"), "bare").distinct()
    n_t = texts.select(F.explode(_words(F.col("bare"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    joined = pairs.join(n_e, "entity").join(n_t, "term").withColumn("n_all", n_all)
    others = joined.select("entity", "term", *[(F.col(n) - 1).alias(n) for n in ("n_all", "n_e", "n_t", "n_te")])
    information = F.log2(F.col("n_all") / F.col("n_e"))
    mutual = F.log2(F.col("n_all") * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    scored = others.filter("n_all > n_e").select("entity", "term", (mutual / information).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= least)


def _telling(word: Column) -> Column:
    """Whether a word may be a name: of more than two characters, or of letters and not in small ones (Li, but not ok)."""
    small = (F.lower(word) == word) & (F.upper(word) != word)
    return (F.length(word) > 2) | (word.rlike(r"^\p{L}+$") & ~small)


def _marked(shared: DataFrame, terms: DataFrame, remove: float) -> DataFrame:
    """Key, spans of terms and the terms to be removed, for the texts that have any."""
    held = _pairs(shared).join(terms, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    words = F.regexp_extract_all("bare", F.lit(_TERMS), F.lit(0))
    placed = shared.select("key", F.explode(F.filter(_placed(F.split("bare", F.lit(_TERMS), F.lit(-1)), words), lambda s: _telling(s["found"]))).alias("s"))
    met = placed.withColumn("term", F.lower("s.found")).join(held, ["key", "term"])
    gone = F.collect_set(F.when(F.col("disclosure") >= remove, F.col("term")))
    return met.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias(TERM), F.sort_array(gone).alias("gone"))


def find(docs: DataFrame, text_col: str = "text", least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Every row with its personal data.

    Columns: row (struct of all columns), text (null as empty), spans arrays `email`, `ip`,
    `card`, `phone` and `term` of (start, end, found), in code points, end exclusive, and
    `gone`: the lower-case terms to be removed rather than generalised. Base spans are never
    changed by the method; terms only come to them, beside them. Repeated rows get the same
    spans; empty texts and tables have none.
    """
    entities = with_entities(docs, text_col)
    # Texts that hold an entity are few; they are read several times.
    holders = settle(_holders(entities))
    terms = disclosing_terms(entities, holders, least)
    marked = _marked(_shared(holders)[1], terms, remove)
    joined = entities.withColumn("key", _key()).join(marked, "key", "left")

    def apart(s: Column) -> Column:
        return ~F.exists(F.concat(*KINDS), lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"]))

    return joined.select(
        "row",
        "text",
        *KINDS,
        F.when(F.col(TERM).isNotNull(), F.filter(TERM, apart)).otherwise(F.array().cast(_SPAN)).alias(TERM),
        F.coalesce("gone", F.array().cast("array<string>")).alias("gone"),
    )


def _listed(kinds) -> Column:
    def said(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.array_join(F.concat(*[F.transform(kind, said(kind)) for kind in kinds]), ",")


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows with entities replaced by their kind, terms generalised to `<TERM>` or removed."""
    found = find(docs, text_col, **options)

    def tag(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("to"))

    tagged = F.concat(
        *[F.transform(kind, tag(kind)) for kind in KINDS],
        F.transform(
            TERM,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.when(F.array_contains("gone", F.lower(s["found"])), F.lit("")).otherwise(F.lit("<TERM>")).alias("to"),
            ),
        ),
    )
    text = F.col("text")

    def splice(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(
            s["start"] >= a["at"], F.struct(F.array_append(a["out"], F.concat(gap, s["to"])).alias("out"), s["end"].alias("at"))
        ).otherwise(a)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    rebuilt = F.aggregate(F.sort_array(tagged), start, splice, end)
    others = [F.col("row")[c].alias(c) for c in docs.columns if c != text_col]
    whole = F.when(F.col("row")[text_col].isNotNull(), rebuilt).alias(text_col)
    return found.select(*others, whole).select(*[quoted(c) for c in docs.columns])


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the four kinds, base_sha256 and all spans."""
    found = find(docs.select(quoted(id_col), quoted(text_col)), text_col)
    return found.select(
        F.col("row")[id_col].alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed((*KINDS, TERM)).alias("spans"),
    )
