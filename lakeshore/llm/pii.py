"""Personal data: patterns, and terms that reveal them by co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers.  Their values are the protected entities.  A term t (a run of letters
and digits outside base spans, lower case) reveals entity e by pointwise
mutual information over distinct texts, PMI = log(n(t,e) n / (n(t) n(e))),
measured against what there is to reveal, IC(e) = log(n / n(e)).  For an entity
and a term that meet in at least ``SUPPORT`` distinct texts, the term is
generalised in the texts with e when PMI / IC(e) reaches ``GENERALISE``, and
removed when it reaches ``REMOVE`` (a term that occurs only with e has 1).
Counts cover all documents, equal texts once.  All of it is DataFrame
functions: patterns are found with their places by splitting a text at the
matches and adding up lengths.

The patterns of the contract are rewritten to match the same spans in linear
time and without deep recursion on very long runs: joining marks (the dots of
a domain, the separators of a card number) become one private character first,
which does not move anything.

Defined cases: null text counts as empty and has no spans; null ids and
repeated rows are rows like others; of overlapping spans the sanitised text
replaces the union, named after the first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import materialise, text_key, text_or_empty

#: Kinds in the order of the contract; terms come last.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Distinct texts in which an entity and a term must meet.
SUPPORT = 3
GENERALISE = 0.85
#: Items of the lists in which matches are gathered.
CHUNK = 256
REMOVE = 0.97

_JOIN, _OTHER = "\ue000", "\ue001"      # the second stands for the first where a text has it
_LOCAL = rf"[A-Za-z0-9._%+{_JOIN}-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_JOIN}[A-Za-z0-9{_JOIN}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{_JOIN}])[0-9][0-9{_JOIN}]{{10,35}}[0-9](?![0-9{_JOIN}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORDS = r"[\p{L}\p{N}]++"
SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("len"), hit.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
        "array<array<struct<start:bigint,end:bigint,value:string>>>").alias("full"), empty.alias("last"))

    def step(s: Column, p: Column) -> Column:
        # Appended to a short list that moves to ``full`` when it has CHUNK
        # items: appending to one long list would copy it each time.
        end = s["at"] + p["gap"] + p["len"]
        item = F.array(F.struct((s["at"] + p["gap"]).alias("start"), end.alias("end"), p["value"].alias("value")))
        closed = F.size(s["last"]) >= CHUNK
        return F.struct(end.alias("at"), F.when(closed, F.concat(s["full"], F.array(s["last"]))).otherwise(s["full"]).alias("full"),
                        F.when(closed, item).otherwise(F.concat(s["last"], item)).alias("last"))

    return F.aggregate(pairs, start, step, lambda s: F.flatten(F.concat(s["full"], F.array(s["last"]))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, failing matches dropped."""
    plain = F.replace(text, F.lit(_JOIN), F.lit(_OTHER))
    domain = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOIN)
    number = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", _JOIN)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def only(sign: str, spans: Column) -> Column:
        return F.when(F.contains(text, F.lit(sign)), spans).otherwise(none)

    small = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"
    ip = F.filter(matches(plain, IP), lambda m: F.forall(F.split(m["value"], r"\."), lambda p: p.rlike(small)))
    card = F.filter(matches(number, CARD), lambda m: F.length(_digits(m["value"])).between(12, 19)
                    & _luhn(_digits(m["value"])))
    phone = F.filter(matches(plain, PHONE), lambda m: F.length(_digits(m["value"])).between(9, 15))
    return {"email": only("@", matches(domain, EMAIL)), "ip": only(".", ip), "card": card, "phone": only("+", phone)}


def _entity(kind: Column, value: Column) -> Column:
    """Equal data in different spelling are one entity."""
    mail = F.lower(F.replace(value, F.lit(_JOIN), F.lit(".")))
    return F.concat(kind, F.lit(":"), F.when(kind == "email", mail).when(kind == "ip", value).otherwise(_digits(value)))


def _blank(text: Column, spans: Column) -> Column:
    """``text`` with the spans turned into spaces."""
    return F.aggregate(spans, text, lambda t, s: F.concat(
        F.substr(t, F.lit(1), s["start"].cast("int")), F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")),
        F.substr(t, (s["end"] + 1).cast("int"))))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``rid``, ``id``, ``key``, ``base`` (spans by
    start, then kind), and the text of those with spans."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumns({k: c for k, c in base_spans(F.col("text")).items()})

    def named(order: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"),
                                                    m["end"].alias("end"), F.lit(kind).alias("kind"),
                                                    m["value"].alias("value")))

    spans = [named(i, k) for i, k in enumerate(KINDS)]
    rows = rows.select("id", text_key(F.col("text")).alias("key"), F.array_sort(F.concat(*spans)).cast(SPAN).alias("base"),
                       "text", F.monotonically_increasing_id().alias("rid"))
    return materialise(rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base-spans")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def revealing_terms(docs: DataFrame, base: DataFrame, text_col: str, support: int = SUPPORT,
                    generalise: float = GENERALISE) -> DataFrame:
    """``entity``, ``term``, ``disclosure`` (PMI / IC) of the terms that reveal."""
    texts = base.filter("text is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    texts = materialise(texts, "texts-with-entities")
    entities = texts.select("key", F.explode(F.array_distinct(F.transform("base", lambda s: _entity(s["kind"], s["value"])))).alias("entity"))
    often = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    held = materialise(entities.join(often, "entity"), "frequent-entities")
    # Terms only of texts that hold such an entity; a pair meets in as many rows as texts.
    inside = texts.join(held.select("key").distinct(), "key", "left_semi").select(
        "key", F.explode(_terms(_blank(F.col("text"), F.col("base")))).alias("term"))
    pairs = inside.join(held, "key").groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = materialise(pairs.filter(F.col("n_te") >= support), "entity-terms")
    # Document frequencies over all distinct texts.
    rows = docs.select(text_or_empty(F.col(text_col)).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    distinct = rows.groupBy("key").agg(F.first("text").alias("text"))
    total = base.select("key").distinct().count()
    frequency = distinct.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    if pairs.isEmpty():     # nothing to weigh
        frequency = pairs.select("term", F.col("n_te").alias("n_t"))
    pmi = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    weighed = pairs.join(frequency, "term").withColumn("disclosure", F.when(ic > 0, F.least(pmi / ic, F.lit(1.0))))
    return materialise(weighed.filter(F.col("disclosure") >= generalise).select("entity", "term", "disclosure"), "revealing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
         generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``base`` and ``spans`` (all spans,
    by start, then kind; array<struct<start, order, end, kind, value>>) and
    ``clean``, the sanitised text of rows that have spans (else null)."""
    base = _base(docs, id_col, text_col)
    terms = revealing_terms(docs, base, text_col, support, generalise)
    entities = base.select("rid", F.explode(F.array_distinct(F.transform("base", lambda s: _entity(s["kind"], s["value"])))).alias("entity"))
    hide = entities.join(terms, "entity").groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"))
    hide = hide.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("hide"))
    rows = base.join(hide, "rid", "left")
    words = matches(_blank(F.col("text"), F.col("base")), WORDS)
    rows = rows.withColumn("words", F.when(F.col("hide").isNotNull(), words))
    chosen = F.filter("words", lambda w: F.map_contains_key(F.col("hide"), F.lower(w["value"])))
    added = F.transform(chosen, lambda w: F.struct(
        w["start"].alias("start"), F.lit(len(KINDS)).alias("order"), w["end"].alias("end"), F.lit(TERM).alias("kind"),
        F.when(F.element_at("hide", F.lower(w["value"])) >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("value")))
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce(added, F.array().cast(SPAN))).cast(SPAN))
    rows = rows.withColumn("spans", spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def replace(state: Column, s: Column) -> Column:
        sign = F.when(s["value"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        sign = F.when(s["start"] >= state["at"], sign).otherwise(F.lit(""))
        gap = F.greatest(s["start"] - state["at"], F.lit(0)).cast("int")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(
            state["out"], F.substr(F.col("text"), (state["at"] + 1).cast("int"), gap), sign).alias("out"))

    clean = F.aggregate("spans", start, replace, lambda s: F.concat(s["out"], F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    return rows.select("id", "base", "spans", F.when(F.col("text").isNotNull(), clean).alias("clean"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
