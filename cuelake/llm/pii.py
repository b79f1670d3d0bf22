"""Personal data by patterns, and terms that give protected entities away, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bitmap import bitmap_of, marked
from cuelake.staging import written

#: Kinds in the order in which they are listed; the last is what the method adds.
KINDS = ["email", "ip", "card", "phone", "term"]
#: Characters that no text has: they stand for a space, a hyphen or a dot between two characters that
#: it joins, so that patterns need no repeated groups (on which Java's matcher recurses).
JOIN_SPACE, JOIN_HYPHEN, JOIN_DOT = "﷐", "﷑", "﷒"
#: Another such character, for a span that is left out.
CUT = "\ufdd4"
LOCAL = r"A-Za-z0-9._%+\-" + JOIN_DOT
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9\-]++{JOIN_DOT}[A-Za-z0-9\-{JOIN_DOT}]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{JOIN_SPACE}{JOIN_HYPHEN}])[0-9][0-9{JOIN_SPACE}{JOIN_HYPHEN}]{{13,}}+",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
SPAN = "struct<start:int,kind:int,stop:int,value:string>"
WORD = r"[\p{L}\p{N}_]{3,}"


def _prepared(text: Column) -> dict[str, Column]:
    """The text as each pattern reads it, character for character."""
    text = F.translate(text, JOIN_SPACE + JOIN_HYPHEN + JOIN_DOT, "﷓﷓﷓")
    dotted = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])", JOIN_DOT)).otherwise(F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9])\x20(?=[0-9])", JOIN_SPACE), r"(?<=[0-9])-(?=[0-9])", JOIN_HYPHEN)
    return {"email": dotted, "ip": text, "card": joined, "phone": F.when(F.contains(text, F.lit("+")), text).otherwise(F.lit(""))}


def _placed(text: Column, pattern: str, hits: Column, kind: int, offset: Column) -> Column:
    """Matches as spans: between them stands what a split at the pattern gives."""
    between = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda h, b: F.struct(h.alias("hit"), b.alias("between")))
    empty = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    found = F.aggregate(pairs, F.struct(offset.cast("int").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["value"]))


def base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """`docs` with _spans: array of (start, kind, stop, value) by start, then kind as in KINDS (from 0)."""
    prepared = docs.withColumns({f"_in_{k}": c for k, c in _prepared(F.col(text)).items()})
    hits = prepared.withColumns({f"_hit_{k}": F.regexp_extract_all(f"_in_{k}", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    placed = hits.withColumns({f"_at_{k}": _passing(k, _placed(F.col(f"_in_{k}"), p, F.col(f"_hit_{k}"), KINDS.index(k), F.lit(0))) for k, p in PATTERNS.items()})
    spans = F.array_sort(F.concat(*(F.col(f"_at_{k}") for k in PATTERNS)))
    return placed.withColumn("_spans", spans).drop(*(f"_{w}_{k}" for w in ("in", "hit", "at") for k in PATTERNS))


def _free(spans: Column, word: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < word["stop"]) & (word["start"] < b["stop"]))


def _outside(text: Column, spans: Column) -> Column:
    """The text without its spans and without the rest of a word that a span cuts."""
    text = F.translate(text, CUT, " ")

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        at = F.greatest(acc["at"], s["stop"])
        ends = F.substring(text, s["start"] + 1, F.lit(1)), F.lit(CUT), F.substring(text, at, F.lit(1))
        return F.struct(at.alias("at"), F.concat(acc["out"], piece, *ends).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    cut = rf"(?<![\p{{L}}\p{{N}}_{CUT}])[\p{{L}}\p{{N}}_]*+{CUT}[\p{{L}}\p{{N}}_{CUT}]*+"
    return F.when(F.size(spans) > 0, F.regexp_replace(whole, cut, " ")).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _standing(text: Column, terms: Column) -> Column:
    """The words of a text that are among `terms` (lower-cased), as spans."""
    words, between = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        stop = start + F.length(x["word"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index("term")).alias("kind"), stop.alias("stop"), F.lower(x["word"]).alias("value"))
        out = F.when(F.array_contains(terms, F.lower(x["word"])), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    pairs = F.zip_with(words, F.slice(between, 1, F.size(words)), lambda w, b: F.struct(w.alias("word"), b.alias("between")))
    empty = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def disclosing_terms(docs: DataFrame, alpha: float, min_docs: int, filter_bits: int) -> DataFrame:
    """Rows (term): the words that give an entity away.

    docs: (_key, _entities, _terms), a row for each document, with distinct entities and words. A word can
    reach alpha only in n_entity ^ alpha * n_docs ^ (1 - alpha) documents, as no more than n_entity hold both;
    others are dropped before words and entities are paired, and no pair that counts is lost.
    """
    n_docs = max(1, docs.count())
    shown = docs.where(F.size("_entities") > 0)
    entities = shown.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = written(entities.where((F.col("n_entity") >= min_docs) & (F.col("n_entity") < n_docs)), "pii-entities")
    most = F.pow(F.col("n_entity"), F.lit(alpha)) * F.pow(F.lit(float(n_docs)), F.lit(1 - alpha)) * (1 + 1e-9)
    widest = entities.agg(F.max(most)).first()[0] or 0.0

    beside = shown.select("_key", F.explode("_entities").alias("entity")).join(entities, "entity")
    beside = written(beside.select("_key", "entity", "n_entity", most.alias("most")), "pii-beside")
    near = shown.join(beside.select("_key").distinct(), "_key", "left_semi").select("_key", F.explode("_terms").alias("term"))
    likely = near.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(min_docs, widest)).select("term")
    likely = written(likely, "pii-likely")
    bitmap = bitmap_of(likely, F.xxhash64("term"), filter_bits)
    every = marked(docs.select(F.explode("_terms").alias("term")), F.xxhash64("term"), bitmap, filter_bits).where("_marked")
    terms = every.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") <= widest).join(likely, "term", "left_semi")
    terms = written(terms, "pii-terms")

    bitmap = bitmap_of(terms, F.xxhash64("term"), filter_bits)
    near = marked(near, F.xxhash64("term"), bitmap, filter_bits).where("_marked").select("_key", "term").join(terms, "term")
    seen = written(near, "pii-near").join(beside, "_key").where(F.col("n_term") <= F.col("most"))
    both = seen.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term")).where(F.col("n_both") >= min_docs)
    gained = F.log(F.col("n_both") / F.col("n_term")) - F.log(F.col("n_entity") / F.lit(n_docs))
    return written(both.where(gained >= alpha * -F.log(F.col("n_entity") / F.lit(n_docs))).select("term").distinct(), "pii-disclosing")


def disclosing_spans(found: DataFrame, rows: DataFrame, terms: DataFrame, filter_bits: int) -> DataFrame:
    """Rows (_key, _added): spans of every occurrence of `terms` outside base spans, in all texts.

    found: (_key, _spans, _terms), a row for each document; rows: (_key, _text).
    """
    bitmap = bitmap_of(terms, F.xxhash64("term"), filter_bits)
    held = marked(found.select("_key", F.explode("_terms").alias("term")), F.xxhash64("term"), bitmap, filter_bits).where("_marked")
    held = held.select("_key", "term").join(terms, "term").groupBy("_key").agg(F.collect_set("term").alias("_own"))
    held = written(held, "pii-held")
    texts = marked(rows, F.col("_key"), bitmap_of(held, F.col("_key"), filter_bits), filter_bits).where("_marked").select("_key", "_text")
    texts = texts.join(held, "_key").dropDuplicates(["_key"]).join(found.select("_key", "_spans"), "_key")
    standing = F.filter(_standing(F.col("_text"), F.col("_own")), lambda t: F.coalesce(_free(F.col("_spans"), t), F.lit(True)))
    return written(texts.select("_key", standing.alias("_added")), "pii-added")


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, and disclosing terms by [term]; of spans that overlap the first counts."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["stop"]).otherwise(F.greatest(acc["at"], s["stop"])).alias("at"), F.when(free, new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.9, min_docs: int = 3, filter_bits: int = 1 << 23, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base (listed spans), spans (all listed)
    and, `with_text`, sanitised.

    Base spans are leftmost matches of the kinds' patterns that pass their tests. Their values are the
    protected entities. Words are runs of three letters, digits or underscores at least that overlap no base
    span. A word that is in at least `min_docs` documents with an entity, wherever it stands in them, gives
    it away if the documents that hold the word raise the entity's log probability by at least `alpha` of its
    information: log(P(e|t) / P(e)) >= alpha * -log P(e), with counts over all documents. Every occurrence
    of such a word is a span of kind `term`, in all documents, those without the entity too. An entity
    that all documents show has no information and is given away by nothing.

    Words of whole documents are paired with entities; those that occur too often to reach alpha are
    dropped first (`disclosing_terms`). Pairs are counted before they are shuffled, so an entity of a
    third of all rows spreads over its documents. Only words that a bitmap of `filter_bits` bits
    admits are shuffled, and only texts with a disclosing word. What is gathered is one document's spans.

    Null text counts as empty and has no spans. Rows with the same id and text are one document in the
    counts and get the same spans; rows with the same id and another text are others. A null id is an
    id. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key = F.struct(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("i"), F.xxhash64("_id", "_text").alias("h"))
    rows = rows.withColumn("_key", F.xxhash64(key))
    found = base_spans(rows)
    entities = F.array_distinct(F.transform("_spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    words = _words(_outside(F.col("_text"), F.col("_spans")))
    found = found.select("_id", "_key", F.when(F.size("_spans") > 0, F.col("_spans")).alias("_spans"), entities.alias("_entities"), words.alias("_terms"))
    found = written(found, "pii-found")
    again = written(found.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "pii-again")
    once = found.join(again, "_key", "left_anti").unionByName(found.join(again, "_key", "left_semi").dropDuplicates(["_key"])).drop("_id")
    terms = disclosing_terms(once, alpha, min_docs, filter_bits)
    added = disclosing_spans(once, rows.select("_key", "_text"), terms, filter_bits)

    base = F.coalesce("_spans", F.from_json(F.lit("[]"), f"array<{SPAN}>"))
    out = found.drop("_entities", "_terms").join(added, "_key", "left").withColumn("_base", base)
    out = out.withColumn("_all", F.when(F.col("_added").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", "_added"))))
    counts = {f"n_{k}": _number(F.col("_base"), i) for i, k in enumerate(KINDS[:4])}
    out = out.withColumns(counts | {"base": _listed(F.col("_base")), "spans": _listed(F.col("_all"))})
    if with_text:
        texts = rows.dropDuplicates(["_key"]).select("_key", "_text")
        out = out.join(texts, "_key").withColumn("sanitised", _sanitised(F.col("_text"), F.col("_all")))
    return out.select(F.col("_id").alias(id_col), *counts, "base", "spans", *(["sanitised"] if with_text else []))
