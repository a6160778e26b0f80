"""Document fingerprints by SimHash.

Terms are runs of five words, or the words themselves in texts of fewer, each as often as it occurs. Every term's 64-bit hash votes on the 64
bits of the fingerprint, one vote for each occurrence; a bit is set where the ones have the majority. All of it is built-in expressions:
words are exploded inside generated code, and their votes, four counters to a long, are summed before the shuffle, which gets one row for each
text and block of words.

All fingerprints within a Hamming radius come from permuted block tables: with the bits cut into blocks, two such fingerprints agree on all but radius
blocks, so for each choice of the others there is a table keyed by them, and a pair counts in the first table that holds it. near_pairs() returns the pairs;
compared() counts, for the documents that ask, the documents within the radius: copies are one fingerprint with a count, and counts are summed before
they are shuffled.

Cases: null texts count as empty; texts without words have fingerprint 0. Very long texts vote in blocks, whole; a bit whose votes tie is 0. Equal texts have
equal fingerprints. Repeated rows get one output row each. Of rows that share an id but not a text, that with the smallest text hash is what neighbours
see. A null id comes first in the order of ids. An empty table gives an empty table. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import numbered, table

SHINGLE = 5
#: Terms of a block: a 16-bit counter holds them, and the highest one leaves the sign alone.
BLOCK = 16_384
LANES = 16
#: Bits within which fingerprints are near, and the blocks of the tables that find them: a table's key has the bits of blocks minus radius blocks. More
#: blocks mean more tables with longer keys, for larger tables of fingerprints.
RADIUS, BLOCKS = 3, 5
#: Documents whose id is divisible by this ask which fingerprints are near.
EVERY = 20
ONES = 0x0001000100010001


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fingerprint (a long) for each distinct combination of keys."""
    split = texts.select(*keys, words_of(F.col(text_col)).alias("_words"))
    placed = split.select(*keys, "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
    n, at = F.size("_words"), F.coalesce(F.col("_pos"), F.lit(0))
    term = F.when(F.col("_pos").isNull(), F.lit(0).cast("long")).when(n < SHINGLE, F.xxhash64("_word")).otherwise(F.xxhash64(*[F.get("_words", at + k) for k in range(SHINGLE)]))
    terms = placed.where((n < SHINGLE) | (at <= n - SHINGLE)).select(*keys, F.floor(at / BLOCK).alias("_block"), F.col("_pos").alias("_pos"), term.alias("_h"))
    votes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(ONES))).alias(f"_v{k}") for k in range(LANES)]
    blocks = terms.groupBy(*keys, "_block").agg(F.count("_pos").alias("_n"), *votes)
    # unpacked: bit 16 * j + k is counter j of lane k
    ones = [F.sum(F.shiftrightunsigned(f"_v{k}", 16 * j).bitwiseAND(0xFFFF)).alias(f"_b{16 * j + k}") for j in range(4) for k in range(LANES)]
    summed = blocks.groupBy(*keys).agg(F.sum("_n").alias("_n"), *ones)
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.shiftleft((2 * F.col(f"_b{b}") > F.col("_n")).cast("long"), b))
    return summed.select(*keys, value.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def followers(docs: DataFrame) -> DataFrame:
    """id, quarter (the most code points that its rows want of the next document) and next_id for each distinct id of (id, n_chars) rows."""
    per = numbered(docs.groupBy("id").agg(F.max(F.floor(F.col("n_chars") / 4)).cast("int").alias("quarter")), [F.col("id").asc_nulls_first()])
    total = per.count()
    after = per.select(F.col("id").alias("next_id"), F.when(F.col("rank") == 0, F.lit(total)).otherwise(F.col("rank")).alias("_place"))
    return table(per.join(after, per["rank"] + 1 == after["_place"]).select("id", "quarter", "next_id"), "followers")


def edited(docs: DataFrame, chain: DataFrame) -> DataFrame:
    """id, text and edited for (id, text) rows: the text with its last quarter replaced by the beginning of the next document.

    Both joins deal out the same two columns by id, so Spark moves a text once and uses the exchange twice; of the next document only the
    piece that is wanted moves on.
    """
    wanted = chain.select(F.col("id").alias("asker"), "quarter", "next_id")
    pieces = docs.join(wanted, F.col("id").eqNullSafe(F.col("next_id"))).select("asker", F.struct(F.xxhash64("text").alias("hash"), F.expr("substring(text, 1, quarter)").alias("piece")).alias("piece"))
    pieces = pieces.groupBy("asker").agg(F.min("piece")["piece"].alias("piece"))
    changed = F.expr("concat(substring(text, 1, cast(char_length(text) - floor(char_length(text) / 4) as int)), substring(piece, 1, cast(floor(char_length(text) / 4) as int)))")
    return docs.join(pieces, F.col("id").eqNullSafe(F.col("asker"))).select("id", "text", changed.alias("edited"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: Column | None = None) -> DataFrame:
    """For each row its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    With asked, a condition on docs, also near_docs: for rows that meet it the number of other documents whose fingerprints are within RADIUS bits of theirs
    (rows with the same id and text are one document), for others null.
    """
    asks = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(False)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), asks.alias("asks"))
    base = texts.select("id", F.xxhash64("text").alias("hash"), F.char_length("text").cast("long").alias("n_chars"), "asks")
    texts = texts.drop("asks")
    chain = followers(base.select("id", "n_chars"))
    changed = edited(texts, chain).select("id", F.xxhash64("text").alias("hash"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), "text", "edited")
    both = changed.select("id", "hash", "sha", F.posexplode(F.array("text", "edited")).alias("kind", "one"))
    found = fingerprints(both, ["id", "hash", "sha", "kind"], "one")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    prints = table(found.groupBy("id", "hash", "sha").agg(pick(0).alias("f0"), pick(1).alias("f1")), "prints")
    first = prints.groupBy("id").agg(F.min_by("f0", "hash").alias("next_print")).withColumnRenamed("id", "of")
    after = chain.select(F.col("id").alias("asker"), "next_id").join(first, F.col("next_id").eqNullSafe(F.col("of"))).select("asker", "next_print")
    known = prints.withColumnsRenamed({"id": "print_id", "hash": "print_hash"})
    rows = base.join(known, F.col("id").eqNullSafe(F.col("print_id")) & (F.col("hash") == F.col("print_hash"))).join(after, F.col("id").eqNullSafe(F.col("asker")))
    near = []
    if asked is not None:
        rows = table(rows, "compared")
        counts = near_counts(rows.select("id", "hash", "f0", "asks").distinct().groupBy(F.col("f0").alias("f")).agg(F.count("*").alias("n"), F.max("asks").alias("asks")))
        rows = rows.join(counts, F.col("f0") == F.col("f"), "left")
        near = [F.when(F.col("asks"), F.col("near")).alias("near_docs")]
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("f0")).alias("fingerprint"), as_text(F.col("f1")).alias("edited_fingerprint"), likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("next_print")).alias("near_next"), *near)


class BlockTables:
    """The tables of fingerprints keyed by all but radius of their blocks."""

    def __init__(self, radius: int, blocks: int):
        self.edges = [64 * k // blocks for k in range(blocks + 1)]
        self.choices = list(combinations(range(blocks), blocks - radius))

    def block(self, f: Column, k: int) -> Column:
        return F.shiftrightunsigned(f, self.edges[k]).bitwiseAND((1 << (self.edges[k + 1] - self.edges[k])) - 1)

    def rows(self, prints: DataFrame, f: str, *more: str) -> DataFrame:
        """no, key, f and more for each table."""
        keyed = [F.struct(F.lit(i).alias("no"), F.xxhash64(*[self.block(F.col(f), k) for k in ks]).alias("key")) for i, ks in enumerate(self.choices)]
        return prints.select(f, *more, F.inline(F.array(*keyed)))

    def first(self, differs: Column) -> Column:
        """The first table that holds a pair with this difference."""
        return F.coalesce(*[F.when(F.lit(True) if not ks else ~F.greatest(*[(self.block(differs, k) != 0) for k in ks], F.lit(False)), i) for i, ks in enumerate(self.choices)])


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """f and near, a table: for each fingerprint that asks how many others are within the radius; prints: f, n (documents with it), asks, distinct by f."""
    prints, tables = table(prints.where("f is not null"), "fingerprints"), BlockTables(radius, blocks)
    asking = tables.rows(prints.where("asks"), "f").withColumnsRenamed({"f": "g", "no": "own_no", "key": "own_key"})
    rows = tables.rows(prints, "f", "n")
    differs = F.col("f").bitwiseXOR(F.col("g"))
    met = rows.join(asking, (F.col("no") == F.col("own_no")) & (F.col("key") == F.col("own_key")) & (F.col("f") != F.col("g")))
    met = met.where((F.bit_count(differs) <= radius) & (tables.first(differs) == F.col("no"))).groupBy("g").agg(F.sum("n").alias("others"))
    return table(prints.where("asks").join(met, F.col("f") == F.col("g"), "left").select("f", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("near")), "near")


def near_pairs(prints: DataFrame, fingerprint_col: str = "fingerprint", radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """a, b, distance for all pairs of different fingerprints (longs) within the radius, a below b; documents join by fingerprint.

    Equal fingerprints are one, so copies make no pairs. A pair comes from the first table that holds it and from no other.
    """
    tables = BlockTables(radius, blocks)
    rows = tables.rows(prints.select(F.col(fingerprint_col).alias("f")).where(F.col("f").isNotNull()).distinct(), "f")
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.no") == F.col("y.no")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f"))).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.col("x.no").alias("no"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    return pairs.where((F.bit_count(differs) <= radius) & (tables.first(differs) == F.col("no"))).select("a", "b", F.bit_count(differs).alias("distance"))
