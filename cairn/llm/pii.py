"""Personal data, with information-theoretic sanitisation. Column expressions and SQL only, no Python on executors.

Base spans are found by pattern. Then the corpus tells how strongly the words of a text give its values away: of word t and
value e together in n(t, e) documents, of n(t) and n(e) that hold either, the disclosure is PMI(t; e) / IC(e) =
log(N n(t, e) / (n(t) n(e))) / log(N / n(e)). Wherever they stand in a document with the value, words at or over REMOVE are
removed, those at or over GENERALISE generalised; a value in one document is protected like any other.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, fresh, join_counted, table, text_key

#: The kinds in order, with their patterns (possessive where that changes no match, so that no text can exhaust a stack or take quadratic time).
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What a text must hold for a pattern to match it, checked first.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Disclosure thresholds.
GENERALISE, REMOVE = 0.9, 0.999
#: What parts words, and a word.
BLANK, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]++"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of 10."""
    d = F.reverse(_digits(m))
    total = F.lit(0)
    for i in range(19):
        v = F.coalesce(F.ascii(F.nullif(F.substring(d, i + 1, 1), F.lit(""))) - 48, F.lit(0))
        total = total + (v if i % 2 == 0 else v * 2 - F.when(v > 4, 9).otherwise(0))
    return F.length(d).between(16, 19) & (total % 10 == 0)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
SPAN = "array<struct<start:int,stop:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f(value), where value is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts: gaps[i] is the text before match i since the one before.

    Sums are run within blocks of 256 and over the blocks, so that thousands of matches don't take quadratic time.
    """
    sizes = F.zip_with(found, gaps, lambda m, g: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    walk = lambda block: F.aggregate(block, empty, lambda a, s: F.struct((a.at + s.gap + s.own).alias("at"), F.concat(a.out, F.array(a.at + s.gap)).alias("out")))
    walked = _let(sizes, lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / 256).cast("int")), lambda b: walk(F.slice(every, b * 256 + 1, 256))))
    shifts = lambda w: F.aggregate(w, empty, lambda a, x: F.struct((a.at + x.at).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")))["out"]
    starts = _let(walked, lambda w: F.flatten(F.zip_with(w, shifts(w), lambda x, shift: F.transform(x.out, lambda v: v + shift))))
    return F.when(F.size(found) > 0, F.slice(starts, 1, F.size(found))).otherwise(F.array().cast("array<int>"))


def spans_of(kind: str, text: Column) -> Column:
    """The valid spans of one kind, in order; positions are code points, stop is exclusive.

    The text is split at the matches: lengths of the pieces and of the matches add up to positions.
    """
    found = F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))
    starts = _starts(F.split(text, KINDS[kind], -1), found)
    spans = F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("value")))
    valid = F.filter(spans, lambda s: _VALID[kind](s.value))
    may = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9](?:[\\x20-]?[0-9]){15}")
    if kind == "ip":
        may = text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return F.when(may, valid).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key and the spans of each kind; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text_key().alias("key"), text.alias("text")).select("doc_id", "key", "text", *(spans_of(k, F.col("text")).alias(k) for k in KINDS))


def _each(kind: str, f) -> Column:
    """The array column kind with f(span, kind) for each span."""
    return F.transform(F.col(kind), lambda s: f(s, kind))


def _terms(text: Column) -> Column:
    """One row for each distinct word."""
    return F.explode(F.filter(F.array_distinct(F.split(F.coalesce(text, F.lit("")), BLANK)), lambda t: t != "")).alias("term")


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """See _revealing; the result is a table of its own."""
    with Scratch(docs.sparkSession) as scratch:
        return cut(_revealing(docs, found, scratch))


def _revealing(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """_d, _k, shown: for each document with revealing words, a map of them to remove or generalise. Rows are counted.

    A word that reaches the threshold is in n(e) ** 0.9 * N ** 0.1 documents at most, as n(t, e) <= n(e); others go early.
    """
    n = float(docs.count())
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    every = F.concat(*(_each(k, lambda s, k: F.concat(F.lit(f"{k}:"), s.value)) for k in KINDS))
    values = found.select("doc_id", "key", F.explode(F.array_distinct(every)).alias("entity"))
    # Values that are in the same rows give the same result: their rows' number and summed hashes stand for all of them.
    row = lambda salt: F.sum(F.xxhash64(F.lit(salt), "doc_id", "key").cast("decimal(38,0)"))
    known = scratch.cut(values.groupBy("entity").agg(F.count("*").alias("n_e"), F.concat_ws(":", F.count("*"), row(0), row(1)).alias("same")))
    most = lambda n_e: F.pow(n_e.cast("double"), GENERALISE) * n ** (1 - GENERALISE) * (1 + 1e-9)
    top = known.agg(most(F.max("n_e"))).first()[0] or 0.0
    total = known.agg(F.sum("n_e")).first()[0] or 0
    of = join_counted(values, known, "entity", "n_e", total).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set(F.struct("n_e", F.col("same").alias("entity"))).alias("e"))
    counts = docs.select(_terms(F.col("text"))).groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") <= top)
    rows = found.select("doc_id", "key", "text").join(of, same).select("_d", "_k", "e", _terms(F.col("text")))
    rows = rows.join(counts, "term").withColumn("e", F.filter("e", lambda v: F.col("n_t") <= most(v.n_e)))
    rows = scratch.cut(rows.select("_d", "_k", "term", "n_t", F.explode("e").alias("e")).select("_d", "_k", "term", "n_t", "e.*"))
    pairs = rows.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"))
    ic = F.log(F.lit(n) / F.col("n_e"))
    pmi = F.log(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    pairs = pairs.filter(ic > 0).select("entity", "term", "n_te", (pmi / ic).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    # Words of a value that very many rows hold are joined apart.
    both = F.struct("entity", "term").alias("both")
    best = join_counted(rows.select("_d", "_k", "term", both), pairs.select(both, "n_te", "disclosure"), "both", "n_te", rows.count()).groupBy("_d", "_k", "term").agg(F.max("disclosure").alias("disclosure"))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    return best.groupBy("_d", "_k").agg(F.map_from_entries(F.collect_list(F.struct("term", action.alias("action")))).alias("shown"))


def _masked(kind: str, text: Column) -> Column:
    """text with other characters, of the same number, for all but the blanks of the valid matches of a kind."""
    found = F.transform(F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0)), lambda m: F.when(_VALID[kind](m), F.regexp_replace(m, r"[^\x20\x09-\x0D]", "\0")).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, KINDS[kind], -1), found, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def _places(text: Column, shown: Column) -> Column:
    """start, stop, action of each occurrence of the words in shown, but those in base spans: words that a mask of these changes."""
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    kind = "array<struct<start:int,stop:int,action:string>>"
    every = lambda found: F.zip_with(_starts(F.split(text, WORD, -1), found), found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("word")))
    out = _let(words(text), every)
    for k in KINDS:
        whole = F.zip_with(out, words(_masked(k, text)), lambda w, m: F.when(w.word == m, w))
        out = F.when(F.size(F.col(k)) > 0, whole).otherwise(out)
    free = F.filter(F.transform(out, lambda w: F.when(w.isNotNull(), F.struct(w.start.alias("start"), w.stop.alias("stop"), shown[w.word].alias("action")))), lambda w: w.action.isNotNull())
    return F.when(shown.isNotNull(), free).otherwise(F.array().cast(kind))


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, the kinds' spans, and terms (start, stop, action), words to generalise or remove.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no spans. A document's repeated rows stay.
    """
    found = cut(base_spans(docs).withColumn("text", F.when(reduce(lambda a, b: a + b, [F.size(k) for k in KINDS]) > 0, F.col("text"))))
    shown = revealing(docs, found.filter("text IS NOT NULL"))
    out = found.join(shown, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return out.withColumn("terms", _places(F.col("text"), F.col("shown"))).drop("text", "_d", "_k", "shown")


def _joined(kinds: list[str]) -> Column:
    parts = [_each(k, lambda s, k: F.concat_ws(":", F.lit("term" if k == "terms" else k), s.start.cast("string"), s.stop.cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with values replaced by their kind and revealing words by [TERM] or nothing; all columns and rows stay.

    Null and empty texts stay as they are. Only documents that hold a value take part in joins; the others pass by.
    """
    x = fresh(docs, "x")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(x, F.struct(text_key().alias("key"), *(spans_of(k, text).alias(k) for k in KINDS)))
    held = reduce(lambda a, b: a + b, [F.size(F.col(x)[k]) for k in KINDS]) > 0
    found = cut(marked.filter(held))
    named = found.select("doc_id", F.col(x)["key"].alias("key"), "text", *(F.col(x)[k].alias(k) for k in KINDS))
    shown = revealing(docs, named)
    # Rows equal in doc_id and text have equal edits.
    edits = named.join(shown, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").withColumn("terms", _places(F.col("text"), F.col("shown")))
    whole = F.concat(
        *(_each(k, lambda s, k: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.lit(f"[{k.upper()}]").alias("to"))) for k in KINDS),
        F.transform("terms", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.when(s.action == "remove", "").otherwise("[TERM]").alias("to"))),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    # Kinds can overlap (digits in an address and a card): an edit within what is already replaced only widens it.
    done = F.aggregate("e", start, lambda a, s: F.struct(F.greatest(a.at, s.stop).alias("at"), F.when(s.start >= a.at, F.concat(a.out, F.array(F.substring(F.col("text"), a.at + 1, s.start - a.at), s.to))).otherwise(a.out).alias("out")))
    fixed = edits.select("doc_id", "key", "text", F.sort_array(whole).alias("e")).withColumn("done", done)
    fixed = fixed.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.concat(F.array_join("done.out", ""), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("to")).dropDuplicates(["_d", "_k"])
    fixed = fixed.select(F.struct("_d", "_k", "to").alias(y := fresh(found, "y")))
    joined = found.join(fixed, F.col("doc_id").eqNullSafe(F.col(y)["_d"]) & (F.col(x)["key"] == F.col(y)["_k"])).withColumn("text", F.col(y)["to"])
    return marked.filter(~held).select(*docs.columns).unionByName(joined.select(*docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(list(KINDS)), 256).alias("base_sha256"), _joined([*KINDS, "terms"]).alias("spans"), F.size("terms").cast("long").alias("n_terms"))
