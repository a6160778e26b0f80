"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, in an order common to all: shingles of crowded counters last, else by hash. Two documents of n and m
shingles that are alike enough share at least `need` of them, so of the first L(n) and L(m) in that order they share at least
min(L(n) - n + need, L(m) - m + need). L is the classic prefix length plus a piece that each document chooses for itself: among a few lengths the one
with the least estimated cost, candidates being dearer to verify than postings to read. The longer it is, the more matches are asked for.

Documents with equal sets are one class. How many classes have each shingle in the longest prefix that they can choose is counted by partial sums, so the
frequencies that costs follow from are exact, whatever the corpus's size. Shingles of one class go there; the others go along by document, which chooses its
length and drops what lies beyond. Then a shingle of few classes makes their pairs, which are counted and kept where matches suffice. A shingle of many
classes makes no pairs: its classes are compared with one of them, the hub, in a join that Spark can split. So no task gets all of a hot shingle.

Pairs whose sketches show too many differences go. Of the rest each class is first verified with its smallest partner; after the links so found, only
pairs of classes that are still apart are verified. Where a shingle of many classes spans several groups, classes outside of the hub's group meet those of
like size and like distance from the hub only: sketches obey the triangle inequality, so classes whose distances from the hub differ by more than alike
sets may differ can't be alike. So a large group of near copies costs its size, and no link between different texts that could join two components is
left out.

Cases: null texts and texts without words have no shingles and link with nothing; with fewer words than a shingle the whole sequence is the one shingle.
Very long texts are whole sets like any other. Rows with the same id are one document: linked if any of them is. A null id links with nothing and has a
null component. Repeated rows get one output row each; of a tie for the hub or the smallest partner the smallest id counts. An empty table gives an empty
table. Extra columns of the input are not looked at by groups() and go along in one_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsight.llm.components import connected
from depsight.llm.shared import doc_of, drop, few, fresh, mixed, put, run_hashes, steps, table, text_of, word_hashes, words_of

SHINGLE, PERCENT = 3, 90
#: Counters of the common order: a fixed size for what is counted, collected and broadcast.
COUNTER_BITS = 18
#: Prefix lengths beyond the classic one that a document can choose from (four, as two bits hold the choice), and the cost of a candidate in postings.
EXTRA, CANDIDATE = (0, 2, 4, 8), 20.0
#: A shingle of more classes makes no pairs.
CROWD = 12
#: Classes of a crowded shingle that are dealt together.
PART = 500
#: Least longs of a set's sketch, which has about a bit for each shingle: bit i is odd if an odd number of shingles fall on i, so two sketches differ in no
#: more bits than the sets in shingles. A sketch folds into one of half its length by exclusive or of its halves.
SKETCH = 8
#: Size bands between two sizes that can just be alike.
FINE = 3
#: A posting's size, chosen length and place in one long, from high bits to low ones.
SIZE_AT, CHOICE_AT = 34, 32


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the place of each text's first one."""
    flat, offsets = words_of(pc.ascii_lower(texts))
    h, n = word_hashes(flat), np.diff(offsets)
    doc = doc_of(offsets)
    parts = []
    if len(h) >= size:
        runs = run_hashes(h, size)
        inside = doc[: len(runs)] == doc[size - 1 :]
        parts.append((doc[: len(runs)][inside], runs[inside]))
    for k in range(1, size):  # short texts: the whole sequence
        brief = np.flatnonzero(n == k)
        if len(brief):
            whole = run_hashes(h, k)[offsets[:-1][brief]]
            parts.append((brief, mixed(whole + np.uint64(k))))
    doc, runs = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if parts else (np.empty(0, np.int64), np.empty(0, np.uint64))
    order = np.lexsort((runs, doc))
    doc, runs = doc[order], runs[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1])
    doc, runs = doc[new], runs[new]
    return runs, np.searchsorted(doc, np.arange(len(n) + 1))


def base_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def counters(base: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall on each of a fixed number of counters, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for t in steps(batches):
            runs, _ = sets_of(text_of(t), size)
            total += np.bincount((runs >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield put(counter=pa.array(at, pa.int32()), n=total[at])

    found = base.select("text").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(base: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (sums that stand for the set), sketch, pre (the longest prefix that can be chosen, in the common order) for each row."""
    mean = counts.mean()
    shipped = base.sparkSession.sparkContext.broadcast(counts > 2 * mean + 6 * np.sqrt(mean) + 8)  # 2**COUNTER_BITS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = shipped.value
        for t in steps(batches):
            runs, places = sets_of(text_of(t), size)
            n = np.diff(places)
            doc = doc_of(places)
            counter = (runs >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
            sums = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                ends = np.concatenate([[np.uint64(0)], np.cumsum(mixed(runs ^ np.uint64(salt)))])
                sums.append((ends[places[1:]] - ends[places[:-1]]).view(np.int64))
            longs = np.maximum(SKETCH, 1 << np.round(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64))
            begin = np.concatenate([[0], np.cumsum(longs)])
            bits = np.bincount(begin[doc] * 64 + (runs.astype(np.int64) & (longs[doc] * 64 - 1)), minlength=begin[-1] * 64).astype(np.uint8) & 1
            sketch = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(np.packbits(bits).view(np.int64)))
            order = np.argsort(doc * 2 + crowded[counter], kind="stable")  # within a text sorted by hash already
            longest = np.minimum(n - (percent * n + 99) // 100 + 1 + max(EXTRA), n)
            at = np.repeat(places[:-1] - np.cumsum(longest) + longest, longest) + np.arange(longest.sum())
            pre = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(longest)]), pa.int32()), pa.array(runs[order][at].view(np.int64)))
            yield put(doc_id=t["doc_id"].combine_chunks(), n=pa.array(n, pa.int64()), s1=sums[0], s2=sums[1], sketch=sketch, pre=pre)

    return base.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>, pre array<long>")


def whole_sets(base: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and its set, for the ids (a table) only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steps(batches):
            runs, places = sets_of(text_of(t), size)
            yield put(doc_id=t["doc_id"].combine_chunks(), tokens=pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(runs.view(np.int64))))

    return base.join(few(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, tokens array<long>")


def need(n: Column, m: Column, percent: int) -> Column:
    """The least number of shared shingles of sets of n and m that are alike enough."""
    return F.ceil(percent * (n + m) / F.lit(float(100 + percent)) - F.lit(1e-9))


def place(posting: Column) -> tuple[Column, Column, Column]:
    """Size, choice and place of a packed posting."""
    return F.shiftright(posting, SIZE_AT), F.shiftright(posting, CHOICE_AT).bitwiseAND(3), posting.bitwiseAND((1 << CHOICE_AT) - 1)


def length(n: Column, choice: Column, percent: int) -> Column:
    """The prefix length that a document of n shingles has chosen."""
    return F.least(n, n - F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)) + 1 + F.element_at(F.array(*map(F.lit, EXTRA)), (choice + 1).cast("int")))


def asked(a: tuple[Column, Column], b: tuple[Column, Column], percent: int) -> Column:
    """Matches that a pair of (size, choice) must have in its prefixes."""
    least = need(a[0], b[0], percent)
    return F.greatest(F.lit(1), F.least(length(*a, percent) - a[0] + least, length(*b, percent) - b[0] + least))


def near_sizes(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def early(a: Column, b: Column, percent: int) -> Column:
    """Whether a shared shingle can be the first one: before it neither set may have more that the other lacks than it can spare."""
    (n, _, i), (m, _, k) = place(a), place(b)
    least = need(n, m, percent)
    return near_sizes(n, m, percent) & (i <= n - least) & (k <= m - least)


def folded(sketch: Column) -> Column:
    """A sketch of half the length."""
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded once: sizes that can be alike are less than twice one another."""
    one = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a)
    other = F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def short(sketch: Column) -> Column:
    """A sketch folded to SKETCH longs, where distances between sets of any sizes obey the triangle inequality."""
    return F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda k: F.aggregate(F.filter(sketch, lambda _, i: i % SKETCH == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))


def verified(pairs: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are alike enough, as a table."""
    ids = table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "asked")
    sets = table(whole_sets(base, ids, size), "sets")
    rows = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    found = table(rows.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct(), "links")
    drop(sets, ids)
    return found


def possible(pairs: DataFrame, known: DataFrame, percent: int, matches: bool = False) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than sets that are alike enough may.

    With matches, column k has the shared shingles of few classes; what is missing must be possible among those of many.
    """
    of = lambda x: known.select(F.col("doc").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "choice", "sketch", "hot")])
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    n, m = F.col("a_n"), F.col("b_n")
    rows = rows.where(differing(F.col("a_sketch"), F.col("b_sketch")) <= n + m - 2 * need(n, m, percent))
    enough = asked((n, F.col("a_choice")), (m, F.col("b_choice")), percent)
    hot = F.least("a_hot", "b_hot")
    return rows.where(F.greatest(F.lit(1), enough - hot) <= F.col("k") if matches else hot >= enough).select("a", "b")


def chosen(classes: DataFrame, percent: int) -> DataFrame:
    """token, doc, c, choice, at (a packed posting) of the shingles that a class shares with others within the prefix that it chooses; c classes have the
    shingle in the longest prefix that they can choose.

    The postings read at a length are the other classes of its shingles, and at most a part of them, as many as matches are asked for, becomes candidates. A
    class that shares nothing in its classic prefix keeps that and has no row.
    """
    spread = classes.select("doc", "n", F.posexplode("pre").alias("pos", "token"))
    shared = table(spread.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "shared")  # written, as Spark splits a hot token in a join of plain tables only
    own = Window.partitionBy("doc")  # at most a class's prefix
    lengths = [length(F.col("n"), F.lit(k), percent) for k in range(len(EXTRA))]
    read = [F.sum(F.when(F.col("pos") < at, F.col("c") - 1).otherwise(0)).over(own) for at in lengths]
    rows = spread.join(shared, "token").select("*", *[(r * F.lit(1 + CANDIDATE / (1 + e))).alias(f"cost{k}") for k, (r, e) in enumerate(zip(read, EXTRA, strict=True))])
    choice = F.array_position(F.array(*[f"cost{k}" for k in range(len(EXTRA))]), F.least(*[f"cost{k}" for k in range(len(EXTRA))])) - 1  # the first, so the shortest, of the cheapest
    rows = rows.select("token", "doc", "n", "pos", "c", choice.alias("choice")).where(F.col("pos") < length(F.col("n"), F.col("choice"), percent))
    packed = F.shiftleft("n", SIZE_AT).bitwiseOR(F.shiftleft("choice", CHOICE_AT)).bitwiseOR(F.col("pos").cast("long"))
    return rows.select("token", "doc", "c", F.col("choice").cast("int").alias("choice"), packed.alias("at"))


def pairs_of_few(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, k) of the classes of shingles of at most CROWD classes: pairs that can be alike by size, and how many of these shingles they share."""
    order = Window.partitionBy("token").orderBy(place(F.col("at"))[2], "doc")  # at most CROWD rows each
    before = F.collect_list(F.struct("doc", "at")).over(order.rowsBetween(-max(1, CROWD - 1), -1))
    each = rows.where(F.col("c") <= CROWD).select(F.col("doc").alias("own"), F.col("at").alias("own_at"), before.alias("before")).select("own", "own_at", F.inline("before"))
    each = each.where((F.col("own") != F.col("doc")) & near_sizes(place(F.col("own_at"))[0], place(F.col("at"))[0], percent))
    return each.select(F.least("own", "doc").alias("a"), F.greatest("own", "doc").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))


def crowds(rows: DataFrame) -> DataFrame:
    """token, doc, at, hub, hub_at of shingles of more than CROWD classes; the hub has the shingle first. A shingle's classes meet it in parts of about PART rows."""
    many = rows.where(F.col("c") > CROWD)
    last = F.floor(F.col("c") / PART).cast("int")
    heads = many.groupBy("token", "c").agg(F.count("*").alias("left"), F.min(F.struct(place(F.col("at"))[2].alias("pos"), "doc", "at")).alias("h")).where("left > 1")
    heads = heads.select("token", F.col("h.doc").alias("hub"), F.col("h.at").alias("hub_at"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return many.withColumn("part", F.pmod(F.xxhash64("doc"), last + 1).cast("int")).join(heads, ["token", "part"]).select("token", "doc", "at", "hub", "hub_at")


def apart(crowd: DataFrame, found: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes of one crowded shingle that the links found so far leave in different groups; and these groups (node, component)."""
    parts = table(connected(found), "parts")
    placed = crowd.join(parts, F.col("doc") == F.col("node"), "left").select("token", "doc", "at", "hub", F.coalesce("component", "doc").alias("part"))
    placed = table(placed, "placed")
    per = placed.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.max(F.when(F.col("doc") == F.col("hub"), F.col("part"))).alias("home"))
    per = table(per.where("x <> y").select("token", "home"), "split")
    sketch = lambda x, *more: known.select(F.col("doc").alias(x), F.col("short").alias(f"{x}_sketch"), *more)
    rows = placed.join(per, "token").join(sketch("doc", "hot"), "doc").join(sketch("hub"), "hub")
    rows = table(rows.select("token", "doc", "at", "part", "home", "hot", differing(F.col("doc_sketch"), F.col("hub_sketch")).alias("far")), "apart")
    drop(placed)

    # a class is kept at its size's band and at its distance's step, whose width is the most that classes alike to one of that band may differ by; a class
    # outside of home asks at the bands and steps where classes alike to it can be
    t, n, pos = percent / 100, place(F.col("at"))[0].cast("double"), place(F.col("at"))[2]
    fine = float(np.log(1 / t)) / FINE
    edge = lambda k: F.exp(k * F.lit(fine))
    band = F.floor(F.log(n) / F.lit(fine) + F.lit(1e-9))
    step = lambda k, d: F.floor((F.col("far") + d) / F.greatest(F.lit(1.0), edge(k + 1) * F.lit((1 / t - 1) * (1 + 1e-9))))
    least_hot = lambda m: t * (n + m) / (1 + t) - t * F.greatest(n, m) + F.lit(1 - 1e-6)  # noqa: E731  matches asked of a pair of these sizes, at least

    def can(k: Column) -> Column:
        low, high = F.greatest(edge(k), n * t), F.least(edge(k + 1), n / t)
        return (low <= high * (1 + 1e-9)) & (low <= (n - pos) * (1 + t) / t - n + 1) & (F.col("hot") >= F.least(least_hot(low), least_hot(high)))

    inner = rows.withColumn("band", band).select("token", "band", step(F.col("band"), F.lit(0)).alias("step"), F.col("doc").alias("b"), F.col("at").alias("b_at"), F.col("part").alias("b_part"), (F.col("part") == F.col("home")).alias("inside"))
    bands = F.filter(F.transform(F.sequence(F.lit(-FINE - 1), F.lit(FINE + 1)), lambda d: band + d), can)
    outer = rows.where("part <> home").select("token", F.col("doc").alias("a"), "at", F.col("at").alias("a_at"), F.col("part").alias("a_part"), "far", F.explode(bands).alias("band"))
    slack = (n + F.least(n / t, edge(F.col("band") + 1))) * F.lit((1 - t) / (1 + t) * (1 + 1e-9))
    outer = outer.select("token", "a", "a_at", "a_part", "band", F.explode(F.sequence(step(F.col("band"), -slack), step(F.col("band"), slack))).alias("step"))
    rest = outer.join(inner, ["token", "band", "step"]).where((F.col("a_part") != F.col("b_part")) & (F.col("inside") | (F.col("a") < F.col("b"))) & early(F.col("a_at"), F.col("b_at"), percent))
    return rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), parts


def links(base: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links that join all classes that belong together; classes: doc, n, sketch, pre of one document of each class."""
    shared = table(chosen(classes, percent), "chosen")
    crowd = table(crowds(shared), "crowd")
    hot = crowd.groupBy("doc").agg(F.count("*").alias("hot"))
    own = shared.groupBy("doc").agg(F.first("choice").alias("choice")).join(hot, "doc", "left").withColumnRenamed("doc", "own")
    known = classes.join(own, F.col("doc") == F.col("own"), "left")
    known = table(known.select("doc", "n", F.coalesce("choice", F.lit(0)).alias("choice"), "sketch", short(F.col("sketch")).alias("short"), F.coalesce("hot", F.lit(0)).alias("hot")), "known")
    drop(classes)

    pairs = possible(pairs_of_few(shared, percent), known, percent, matches=True)
    star = crowd.where((F.col("doc") != F.col("hub")) & early(F.col("at"), F.col("hub_at"), percent)).select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    pairs = table(pairs.union(possible(star.distinct(), known, percent)).distinct(), "pairs")
    drop(shared)
    tried = table(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    found = verified(tried, base, size, percent)

    # pairs, and shingles of many classes, whose classes are not yet all together
    rest, parts = apart(crowd, found, known, percent)
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
    left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    left = left.where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    rest = table(left.union(possible(rest, known, percent)).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    return found if rest.isEmpty() else found.union(verified(rest, base, size, percent))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    base = base_of(docs, id_col, text_col)
    sets = table(prefixes(base, counters(base, size), size, percent), "prefixes")
    named = ["n", "s1", "s2"]
    real = sets.where("n > 0 and doc_id is not null")
    # copies are merged before the shuffle; equal sets have equal sketches and prefixes
    first = real.groupBy(*named).agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("sketch", "pre")])
    first = table(first, "classes")
    every = table(sets.select("doc_id", *named), "every")
    drop(sets)
    known = table(every.join(first.select(*named, "doc"), named).where("doc_id is not null").select("doc_id", "doc").distinct(), "members")
    found = links(base, first, size, percent)
    same = known.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    same = known.join(same, "doc_id").select("a", F.col("doc").alias("b")).where("a <> b")  # rows of one id in several classes
    parts = connected(found.union(same))
    spot = known.groupBy("doc_id").agg(F.min("doc").alias("doc")).join(parts, F.col("doc") == F.col("node"), "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "doc").alias("part"))
    out = every.join(spot, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("part", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stay when of each group only the document with the smallest id does.

    Documents without words and rows with a null id are in no group and stay. Of rows that repeat an id that with the smallest text hash stays.
    """
    found = table(groups(docs, id_col, text_col, size, percent), "groups")
    gone_id, again_id, key = (fresh(docs, c) for c in ("gone", "again", "key"))
    gone = few(table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone"))
    left = docs.join(gone, docs[id_col].cast("long") == gone[gone_id], "left_anti")
    again = table(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("most")).where("n > 1 and most > 0").select(F.col("doc_id").alias(again_id)), "again")
    if again.isEmpty():
        return left
    same = docs[id_col].cast("long") == again[again_id]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = left.join(again, same, "left_semi").groupBy(F.col(f"`{id_col}`").alias(key)).agg(F.min_by(row, F.xxhash64(docs[text_col])).alias("row"))
    return left.join(again, same, "left_anti").unionByName(first.select("row.*"))
