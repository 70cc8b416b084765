"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The corpus then says
how strongly each term reveals an entity (one address, one number) or a kind of entity: with
N terms in the corpus, n(e) of them within `REACH` characters of entity e, n(t) the uses of
term t and n(t, e) those near e,

    disclosure(t, e) = log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e)),

the share of the information of "here is e" that t gives away: 1 if t never stands
elsewhere, 0 if it is as likely anywhere. Terms of `DISCLOSED` or more that stand near the
entity in `SUPPORT` different places are generalised (or removed) wherever they stand, in
all texts. A place in copies of one text counts once as support; a term discloses a kind only
if it stands near `SUPPORT` different entities of it. Counts are over all documents. All of
it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REACH = 40
DISCLOSED = 0.95
SUPPORT = 5
#: Terms that may be sent to all tasks; with more of them the join shuffles.
BROADCAST_ROWS = 1_000_000

# Possessive forms of the patterns searched for: they match the same, but do not go back
# over long runs, nor need stack for them. An address starts where a run of its characters
# starts, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]],
         block: int = 64) -> Column:
    """An output for each item of an array, with a state handed from item to item. `step`:
    (state, item) to (state, output); `kind`: type of the output. Outputs are gathered by
    blocks, so long arrays are not copied once for each item."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["o"], F.array(out)).alias("o"))

    def many(acc, b):
        part = F.aggregate(F.slice(items, b * block + 1, block), F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return bound(part, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    whole = F.aggregate(blocks, F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o")), many)
    return F.when(F.size(items) > 0, F.flatten(whole["o"])).otherwise(none)


SPAN = "struct<start:int,end:int,value:string>"


def located(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: start, end (exclusive) in characters, value."""
    def of(found):
        pieces = F.split(text, pattern, -1)
        sizes = F.zip_with(F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.length(p)), found,
                           lambda a, v: F.struct(a.alias("a"), v.alias("v")))
        def next_span(at, x):
            begin = at + x["a"]
            end = begin + F.length(x["v"])
            return end, F.struct(begin.alias("start"), end.alias("end"), x["v"].alias("value"))

        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(
            bound(sizes, lambda s: scan(s, F.lit(0), SPAN, next_span)))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return bound(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _of_kind(text: Column, no: int, kind: str) -> Column:
    found = F.transform(
        F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["value"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"),
                           F.lit(kind).alias("kind"), x["value"].alias("value")))
    if not MARKS[kind]:
        return found
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,value:string>>")
    return F.when(F.contains(text, F.lit(MARKS[kind])), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans (start, no of the kind, end, kind, value) by start, then kind as listed."""
    return F.array_sort(F.concat(*(_of_kind(text, no, kind) for no, kind in enumerate(KINDS))))


LETTERS = r"\p{L}+"


def _near(text: Column, spans: Column) -> Column:
    """Terms near each span: kind, value of the entity, term, start, end. A term that the
    reach cuts is left out, and so are the spans themselves."""
    def terms(piece: Column, offset: Column, whole_start: Column, whole_end: Column, x: Column):
        inside = F.filter(located(piece, LETTERS), lambda t: (whole_start | (t["start"] > 0)) & (whole_end | (t["end"] < F.length(piece))))
        return F.transform(inside, lambda t: F.struct(
            x["kind"].alias("kind"), x["value"].alias("value"), F.lower(t["value"]).alias("term"),
            (t["start"] + offset).alias("start"), (t["end"] + offset).alias("end")))

    def around(x):
        low = F.greatest(x["start"] - REACH, F.lit(0))
        left = F.substring(text, low + 1, x["start"] - low)
        right = F.substring(text, x["end"] + 1, F.lit(REACH))
        return F.concat(
            bound(left, lambda s: terms(s, low, low == 0, F.lit(True), x)),
            bound(right, lambda s: terms(s, x["end"], F.lit(True), F.length(s) < REACH, x)))

    found = F.flatten(F.transform(spans, around))
    return F.filter(found, lambda t: ~F.exists(spans, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), spans, near."""
    rows = W.text_frame(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.withColumn("spans", base_spans(F.col("text")))
    none = "array<struct<kind:string,value:string,term:string,start:int,end:int>>"
    near = F.when(F.size("spans") > 0, bound(F.col("spans"), lambda s: _near(F.col("text"), s))).otherwise(F.array().cast(none))
    return found.select("doc_id", F.xxhash64("text").alias("tid"), "spans", near.alias("near"))


WORD_BREAKS = r"[^\p{L}]+"
#: Stands for all entities of a kind; no entity is an empty text.
ANY = ""


def _uses(near: Column) -> Column:
    """Each use of a term near an entity, and near any of the entity's kind, once a text."""
    use = lambda value: lambda t: F.struct(t["kind"], value(t).alias("value"), t["term"], t["start"])
    return F.array_distinct(F.concat(F.transform(near, use(lambda t: t["value"])), F.transform(near, use(lambda t: F.lit(ANY)))))


def _among(words: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """`words` (term) with the `names` (known) they are among."""
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    return words.join(names, F.col("term") == F.col("known"), how)


def disclosing_terms(docs: DataFrame, based: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """term, kind, value, disclosure of the terms at or above the threshold; value is the
    entity, or empty where the term discloses the kind."""
    near = based.filter(F.size("near") > 0).select("tid", F.explode(_uses(F.col("near"))).alias("u")).select("tid", "u.*")
    uses = staged(near.groupBy("kind", "value", "term").agg(
        F.count(F.lit(1)).alias("n_te"), F.count_distinct(F.xxhash64("tid", "start")).alias("places")), "pii-uses")
    entities = uses.groupBy("kind", "value").agg(F.sum("n_te").alias("n_e"))
    kinds = {r["kind"]: r["n_e"] for r in entities.filter(F.col("value") == ANY).collect()}  # one row a kind
    of_kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in kinds.items()], F.lit(None).cast("long"))
    one = uses.filter((F.col("value") != ANY) & (F.col("places") >= support)).join(entities.filter(F.col("value") != ANY), ["kind", "value"])
    spread = uses.filter(F.col("value") != ANY).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("entities")).filter(F.col("entities") >= support)
    several = uses.filter((F.col("value") == ANY) & (F.col("places") >= support)).join(spread, ["kind", "term"], "left_semi")
    columns = ("kind", "value", "term", "n_te", "n_e")
    candidates = staged(one.select(*columns).unionByName(several.withColumn("n_e", of_kind).select(*columns)), "pii-candidates")
    words = docs.select(F.explode(F.split(F.coalesce(docs["text"], F.lit("")), WORD_BREAKS)).alias("term")).filter("term != ''").select(F.lower("term").alias("term"))
    # One pass: candidates by name, all other terms as the null group.
    names = candidates.select(F.col("term").alias("known")).distinct()
    counted = staged(_among(words, names, "left").groupBy("known").agg(F.count(F.lit(1)).alias("n_t")), "pii-counts")
    total = F.lit(float(counted.agg(F.sum("n_t")).first()[0] or 0))
    scored = candidates.join(counted, F.col("term") == F.col("known"))
    gain = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log2(total / F.col("n_e")), F.lit(1e-9))
    return scored.withColumn("disclosure", gain).filter(F.col("disclosure") >= disclosed).select("term", "kind", "value", "disclosure")


def _extra(docs: DataFrame, based: DataFrame, **thresholds) -> DataFrame:
    """_id, _tid, extra: every place of a disclosing term, in all texts. Which texts have
    any is found by a join on their distinct words; only those are searched for places."""
    names = staged(disclosing_terms(docs, based, **thresholds).select(F.col("term").alias("known")).distinct(), "pii-terms")
    texts = W.text_frame(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = texts.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tid"), F.explode(F.array_distinct(F.split("text", WORD_BREAKS))).alias("term"),
    ).withColumn("term", F.lower("term"))
    marked = staged(_among(held, names, "inner").groupBy("_id", "_tid").agg(F.collect_set("known").alias("marked")), "pii-marked")
    if (marked.agg(F.sum(F.size("marked") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        marked = F.broadcast(marked)  # else all texts would be moved to meet a few rows
    place = lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("no"), t["end"].alias("end"), F.lit(TERM).alias("kind"))
    found = F.transform(F.filter(located(F.col("text"), LETTERS), lambda t: F.array_contains("marked", F.lower(t["value"]))), place)
    met = texts.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tid")))
    # Repeated rows are one here, as each of them will meet it.
    return met.select("_id", "_tid", found.alias("extra")).groupBy("_id", "_tid").agg(F.first("extra").alias("extra"))


def _joined(rows: DataFrame, extra: DataFrame) -> DataFrame:
    met = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")), "left")
    plain = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    # A term within an entity is part of it.
    free = F.filter("extra", lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return met.withColumn("all", F.array_sort(F.concat(plain, F.coalesce(free, none)))).drop("_id", "_tid", "extra")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def personal_data(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term of each row.

    Spans are kind:start:end in characters, by start, then kind. A null text is empty, null
    ids stay, repeated rows count by themselves. Other columns of `docs` are not read.
    """
    based = staged(with_base(docs), "pii-base")
    rows = _joined(based, _extra(docs, based, **thresholds))
    count = lambda c, kind: F.size(F.filter(c, lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *(count("spans", k).alias(f"n_{k}") for k in KINDS), F.sha2(_listed("spans"), 256).alias("base_sha256"),
        _listed("all").alias("spans"), count("all", TERM).alias("n_term"))


def sanitised(docs: DataFrame, remove_terms: bool = False, **thresholds) -> DataFrame:
    """`docs` with base spans replaced by [EMAIL], [IP], [CARD], [PHONE] and disclosing
    terms by [TERM] (or nothing); of spans that overlap the first stays. A null text stays
    null. All columns stay as they are but text."""
    based = staged(with_base(docs), "pii-base")
    extra = _extra(docs, based, **thresholds)
    whole = F.coalesce("text", F.lit(""))
    # The row travels as one column, so its names meet none of those made here.
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), "doc_id", "text")
    rows = _joined(own.withColumn("tid", F.xxhash64(whole)).withColumn("spans", base_spans(whole)), extra)

    def keep(last, x):
        free = x["start"] >= last
        return F.when(free, x["end"]).otherwise(last), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), free.alias("free"))

    def rebuilt(spans):
        free = F.filter(scan(spans, F.lit(0), "struct<start:int,end:int,kind:string,free:boolean>", keep), lambda x: x["free"])
        mark = lambda x: F.when((x["kind"] == TERM) & F.lit(remove_terms), F.lit("")).otherwise(
            F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))

        def pieces(kept):
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(kept, i - 1)["end"])
            parts = F.transform(kept, lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), mark(x)))
            tail = F.element_at(kept, -1)["end"]
            return F.concat(F.array_join(parts, ""), F.substring(F.col("text"), tail + 1, F.length("text")))

        return bound(free, pieces)

    text = F.when(F.size("all") == 0, F.col("text")).otherwise(bound(F.col("all"), rebuilt))
    new = F.when(F.col("text").isNull(), F.col("text")).otherwise(text)
    return rows.select(*((new if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns))
