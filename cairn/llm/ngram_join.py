"""N-gram Jaccard self-join by token-combination prefixes.

A document is its set of word shingles, as 64-bit hashes; equal sets are one class. Two similar sets of up to top
shingles differ in d = (100 - percent) * 2 * top / (100 + percent) at most. Shingles fall into m > d classes by hash, and
a set's signatures are the combinations of all its shingles of a class: one shingle in small sets, several in large
ones. Each shingle in which two sets differ spoils one class, so they share m - d signatures at least. So far the
prefixes extend over whole sets; now the corpus says which combinations are frequent: of a set's signatures, only the
d + 1 rarest are indexed, and similar sets share one of these. Rarest are those without a second set, which need no entry.

m, d and the classes belong to a level, a range of sizes; a pair meets at the larger one's level. Classes without a
shingle count as most frequent, and are indexed only where a set has too many of them.

Candidates only draw clusters. Within these, whole sets are compared exactly, in blocks of bounded size; blocks of what
the first round already joined into a cluster's largest component need no second comparison.
"""

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, cut, holds, join_counted, key_filter, mix, run_hashes, ship, small_batches, table, word_hashes
from cairn.llm.components import components

ship(__name__)

#: Sets that share a signature and still link as pairs, not to the least of them; sets in a block.
PAIRS, BLOCK = 16, 512
#: The largest size of each level.
TOPS = [4]
while TOPS[-1] < 1 << 40:
    TOPS.append(TOPS[-1] * 3 // 2)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of width words in a row, sorted; of all words, if there are fewer; of an empty text, none."""
    h = word_hashes(text, lower=True)
    if 0 < len(h) < width:
        return run_hashes(h, len(h)) ^ np.uint64(0x5851F42D4C957F2D)
    return np.unique(run_hashes(h, width))


def _set_id(s: np.ndarray) -> int:
    """Names the whole set; as signed 64 bits."""
    with np.errstate(over="ignore"):
        a = mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) ^ mix(mix(s) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) * np.uint64(3)
    return int(mix(np.array([a + np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def _differ(top: int, percent: int) -> int:
    """In how many shingles two similar sets of up to top can differ."""
    return (100 - percent) * 2 * top // (100 + percent)


def _signatures(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """Of the set s: level, how many of the most frequent signatures needn't be indexed, and signatures."""
    out, scattered = [], mix(s ^ np.uint64(0xA0761D6478BD642F))
    for level in range(bisect_left(TOPS, len(s)), bisect_left(TOPS, len(s) * 100 // percent) + 1):
        if not (d := _differ(TOPS[level], percent)):
            continue  # only equal sets are similar
        spare = max(2, d // 3)
        m = d + 1 + spare
        with np.errstate(over="ignore"):
            cls = (mix(s + np.uint64(level * 2 + 1)) % np.uint64(m)).astype(np.min_scalar_type(m))  # short integers sort faster
            order = np.argsort(cls, kind="stable")
            ranked = cls[order]
            at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            place = mix(np.arange(m, dtype=np.uint64) + np.uint64(level << 32))
            full = cls[order[at]].astype(np.int64)
            signs = mix(np.add.reduceat(scattered[order], at) + place[full])
        void = np.sort(np.delete(place, full))
        out.append((level, max(0, spare - len(void)), np.concatenate((signs, void[: max(0, len(void) - spare)]))))
    return out


def _named(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, sid, n of each row of docs; n is 0 without words."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, width) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "sid": [_set_id(s) if len(s) else 0 for s in sets], "n": [len(s) for s in sets]})

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, sid long, n int")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _each_once(docs: DataFrame, classes: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Each class once: sid, n, and of each level the signatures, w, and their level, spare and number, parts, as bytes.

    Only those of classes that a filter takes for repeated are shuffled, from documents that may be their least.
    """
    context = docs.sparkSession.sparkContext
    again = context.broadcast(key_filter(classes.filter("rows > 1").select(F.col("sid").alias("h"))))

    def taken(batches):
        for b in batches:
            yield b.loc[holds(again.value, b["sid"].to_numpy().view(np.uint64)), ["h"]]

    reps = context.broadcast(key_filter(classes.select("sid", F.xxhash64("rep").alias("h")).mapInPandas(taken, "h long")))

    def sign(repeated: bool):
        def run(batches):
            for b in batches:
                texts = b["text"][holds(reps.value, b["h"].to_numpy().view(np.uint64))] if repeated else b["text"]
                sets = [s for s in (shingles(t, width) for t in texts) if len(s)]
                ids = np.array([_set_id(s) for s in sets], np.int64)
                rows = []
                for sid, s, known in zip(ids.tolist(), sets, holds(again.value, ids.view(np.uint64)), strict=True):
                    if known == repeated:
                        signs = _signatures(s, percent)
                        parts = np.array([(level, spare, len(w)) for level, spare, w in signs], np.int32)
                        rows.append((sid, len(s), b"".join(w.tobytes() for *_, w in signs), parts.tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["sid", "n", "w", "parts"])

        return run

    texts, schema = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text"), "sid long, n int, w binary, parts binary"
    twice = texts.mapInPandas(sign(True), schema).groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "w", "parts")))
    return scratch.cut(texts.mapInPandas(sign(False), schema).unionByName(twice))


def _candidates(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: links between classes (sid, n, w, parts) that put each pair of similar ones into one cluster.

    classes, the largest table here, is deleted once its repeated signatures are listed.
    """

    def count(batches):
        for b in batches:
            h, n = np.unique(np.frombuffer(b"".join(b["w"]), np.int64), return_counts=True)
            yield pd.DataFrame({"h": h, "c": n})

    counts = scratch.cut(classes.select("w").mapInPandas(count, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1"))
    twice = scratch.spark.sparkContext.broadcast(key_filter(counts))

    def emit(batches):
        for b in batches:
            w = np.frombuffer(b"".join(b["w"]), np.uint64)
            parts = np.frombuffer(b"".join(b["parts"]), np.int32).reshape(-1, 3)
            part = np.repeat(np.arange(len(parts)), parts[:, 2])
            row = np.repeat(np.arange(len(b)), [len(p) // 12 for p in b["parts"]])[part]
            at = holds(twice.value, w)
            at &= (np.bincount(part[at], minlength=len(parts)) > parts[:, 1])[part]
            yield pd.DataFrame({"h": w[at].view(np.int64), "sid": b["sid"].to_numpy()[row[at]], "n": b["n"].to_numpy()[row[at]], "level": parts[part[at], 0], "spare": parts[part[at], 1]})

    rows = scratch.cut(classes.select("sid", "n", "w", "parts").mapInPandas(emit, "h long, sid long, n int, level int, spare int"))
    scratch.drop(classes)
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = Window.partitionBy("sid", "level").orderBy(F.desc("c"), F.desc("h"))
    index = scratch.cut(join_counted(rows, counts, "h", "c", total).withColumn("r", F.row_number().over(often)).filter("r > spare").select("h", "sid", "n", "c"))
    scratch.drop(rows, counts)
    lists = index.filter(F.col("c") <= PAIRS).groupBy("h").agg(F.collect_set(F.struct("sid", "n")).alias("s")).filter("size(s) > 1")
    fits = lambda y: (y.sid > F.col("x.sid")) & (100 * F.least(y.n, F.col("x.n")) >= percent * F.greatest(y.n, F.col("x.n")))
    pairs = lists.select("s", F.explode("s").alias("x")).select(F.col("x.sid").alias("a"), F.explode(F.filter("s", fits)).alias("y")).select("a", F.col("y.sid").alias("b"))
    many = index.filter(F.col("c") > PAIRS).select("h", "sid")
    least = many.groupBy("h").agg(F.min("sid").alias("a"), F.count("*").alias("k"))
    stars = join_counted(many, least, "h", "k", total).filter("sid <> a").select("a", F.col("sid").alias("b"))
    return pairs.unionAll(stars).distinct()


def _linked(ids: list, sets: list, percent: int, fixed: np.ndarray) -> list:
    """Edges that join what is linked among these sets; pairs of fixed ones needn't be compared."""
    sizes = np.array([len(s) for s in sets])
    _, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes)[shared[back]]
    col = column[back][shared[back]]
    inter, wide = np.zeros((len(sets), len(sets)), np.float64), max(1, (1 << 24) // len(sets))
    for at in range(0, int(shared.sum()), wide):
        part = (col >= at) & (col < at + wide)
        m = np.zeros((len(sets), min(wide, int(shared.sum()) - at)), np.float32)
        m[row[part], col[part] - at] = 1
        inter += m @ m.T
    link = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    link &= ~(fixed[:, None] & fixed[None, :])
    np.fill_diagonal(link, False)
    out, seen = [], np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not seen[i]:
            seen[i], front = True, [i]
            while front:
                new = np.flatnonzero(link[front.pop()] & ~seen)
                seen[new] = True
                out += [(ids[i], ids[j]) for j in new]
                front += new.tolist()
    return out


def _compare(tasks: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links. tasks: task (a key), sid, fixed, s (the set, as bytes); each task is at most two blocks."""

    def run(batches):
        task, rows = None, {}

        def done():
            if len(rows) > 1:
                ids = list(rows)
                yield from _linked(ids, [rows[i][0] for i in ids], percent, np.array([rows[i][1] for i in ids]))

        for b in batches:
            out = []
            for t, sid, fixed, s in zip(b["task"], b["sid"], b["fixed"], b["s"], strict=True):
                if t != task:
                    out += done()
                    task, rows = t, {}
                rows[sid] = np.frombuffer(s, np.uint64), fixed
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if out := list(done()):
            yield pd.DataFrame(out, columns=["a", "b"])

    return tasks.repartition("task").sortWithinPartitions("task").select("task", "sid", "fixed", "s").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """sid, s: the whole sets of members (sid, rep), read from the documents rep; at least once each."""
    have = docs.sparkSession.sparkContext.broadcast(key_filter(members.filter("rep IS NOT NULL").select(F.xxhash64("rep").alias("h"))))

    def run(batches):
        for b in batches:
            got = [shingles(t, width) for t in b["text"][holds(have.value, b["h"].to_numpy().view(np.uint64))]]
            got = [s for s in got if len(s)]
            yield pd.DataFrame({"sid": [_set_id(s) for s in got], "s": [s.tobytes() for s in got]})

    mine = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "text")
    return mine.mapInPandas(run, "sid long, s binary")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored).

    Linked are documents whose sets of width-word shingles have 100 * intersection >= percent * union. component_id is
    the smallest doc_id that links lead to. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a text are linked; a null doc_id stands for nothing in a minimum, and its class takes no other links.
    docs is read several times, so it should be a table.
    """
    with Scratch(docs.sparkSession) as scratch:
        return cut(_components(docs, width, percent, scratch))


def _components(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    named = scratch.cut(_named(docs, width))
    classes = scratch.cut(named.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    clusters = components(_candidates(_each_once(docs, classes, width, percent, scratch), percent, scratch), scratch).select(F.col("node").alias("sid"), F.col("component").alias("cid"))
    members = scratch.cut(clusters.join(classes.select("sid", "rep"), "sid"))
    sizes = members.groupBy("cid").agg(F.count("*").alias("size"))
    sized = members.join(sizes, "cid").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    sets = _sets(docs, members, width)
    block = F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks"))
    tasks = sized.select("sid", F.xxhash64("cid", block).alias("task"), F.lit(False).alias("fixed")).join(sets, "sid")
    joined = components(_compare(tasks, percent), scratch)
    large = scratch.cut(sized.filter("blocks > 1").select("sid", "cid", "rep"))
    if large.take(1):
        parted = large.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        most = parted.groupBy("cid", "component").agg(F.count("*").alias("k")).groupBy("cid").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("all"))
        split = parted.join(most, "cid").withColumn("fixed", F.col("component") == F.col("most.component"))
        own = F.when(F.col("fixed"), F.col("most.k")).otherwise(F.col("all") - F.col("most.k"))
        rest, fixed = F.ceil((F.col("all") - F.col("most.k")) / BLOCK), F.ceil(F.col("most.k") / BLOCK)
        split = split.withColumns({"mine": F.pmod(F.xxhash64("sid", F.lit(6)), F.ceil(own / BLOCK)), "rest": rest, "fixed_blocks": fixed}).filter("rest > 0")
        # Open blocks meet each other and every fixed block; fixed ones don't meet.
        meets = F.when(F.col("fixed"), F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: F.struct(i.alias("i"), (F.col("mine") + F.col("rest")).alias("j")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("rest") + F.col("fixed_blocks") - 1), lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
        )
        again = split.select("sid", "cid", "fixed", F.explode(meets).alias("t")).select("sid", F.xxhash64("cid", "t.i", "t.j").alias("task"), "fixed")
        more = _compare(again.join(_sets(docs, large, width), "sid"), percent)
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), scratch)
    # Only classes in links have another least document than their own.
    linked = joined.withColumnRenamed("node", "sid").join(classes.select("sid", "rep"), "sid")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "component").select("sid", "least")
    ids = named.select("doc_id", "sid", F.col("n").cast("long").alias("n_shingles"))
    reps = classes.select("sid", "rep").join(moved, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"))
    some = ids.filter("n_shingles > 0").join(reps, "sid").select("doc_id", "n_shingles", "component_id")
    return some.unionAll(ids.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)
