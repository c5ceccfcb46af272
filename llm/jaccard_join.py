"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct shingles of SHINGLE words.  Two sets of
similarity of at least SIMILAR / 100 share an element among the first
n - ceil(n * SIMILAR / 100) + 1 of each (n: size) in any common order.  The order
here is by rarity, from a fixed-width table of shingle counts over all documents,
so that passages which many documents share stand last.

1. Documents with equal sets become one class (its smallest key stands for it).
2. Classes of equal prefix and size become one group; groups are posted, with the
   places of the elements, under their prefix; postings of one group only are dropped.
3. Within each posting every group is paired with a few pivots; pairs are filtered
   by size, expanded to members, filtered by a bit vector (the bits that differ are
   at most the elements that differ) and verified on the whole sets.
4. Links give components.  For completeness groups of one posting that are still in
   different components are joined on it, members of one group too.  Of postings that
   the same groups have, only the first is used.  The condition of that join is the size filter, the positional filter (no more elements can be shared
   than stand behind the common one), a short bit vector, and that the two elements before
   it are not shared, which would make it a later common element of a pair that is met already.  Pairs within
   a component are left out: they could add no link between components.

All large joins are between written tables, so that adaptive execution deals the rows
of a hot key over several tasks.

Defined results: a null or empty text has an empty set, linked with nothing; a text
of fewer words is one shingle; rows with a null key are left out of the join and
returned with component_id null; repeated rows give equal rows each; rows of one key
with different texts are joined each by its own text; an empty table gives an empty
result; keys of any orderable type; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .sketch import fixed_array
from .textkernel import blocks, give_back, grams, mix, signed, texts_as_bytes, words_of

#: Parameters: words of a shingle, least similarity in per cent, pivots of a posting, entries of the count table and of
#: the membership tables (bits), both of fixed size; bits of the short vectors of sets of up to CODED elements (larger sets
#: have about as many bits as elements).
SHINGLE, SIMILAR, PIVOTS, COUNTS, BITS, CODE, CODED = 5, 75, 8, 1 << 20, 1 << 26, 512, 560


def shingle_sets(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    words = words_of(buf, bounds, lower=True)
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    g = grams(words.hash, SHINGLE)
    whole = text[: len(g)] == text[SHINGLE - 1 : SHINGLE - 1 + len(g)]
    owners, hashes = [text[: len(g)][whole]], [g[whole]]
    for m in range(1, SHINGLE):
        short = np.flatnonzero(sizes == m)
        if len(short):
            owners.append(short)
            hashes.append(mix(grams(words.hash, m)[words.first[short]] + np.uint64(m)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """For each bucket of shingle hashes the doubled binary logarithm of its count over all documents."""

    def fill(own: np.ndarray, batch: pa.RecordBatch) -> None:
        buf, bounds = texts_as_bytes(batch.column("text"))
        for a, b in blocks(bounds):
            own += np.bincount(bucket(shingle_sets(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])[1]), minlength=COUNTS)

    counts = fixed_array(docs.select("text"), COUNTS, "int64", fill, np.add)
    return (2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def code_bits(n: np.ndarray) -> np.ndarray:
    """Most bits of the short vectors of sets of so many elements; those of two sets that could be linked differ by a factor of two at most."""
    return np.where(n <= CODED, CODE, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def bit_vectors(h: np.ndarray, n: np.ndarray, most: int | np.ndarray = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, words of 64 bits): per set the parities of its elements in as many bits as twice their number, rounded up
    to a power of two (64 at least, `most` at most).  n: sizes of the sets, whose elements stand in h one set after the other."""
    width = np.minimum(most, np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)))
    start = np.r_[0, np.cumsum(width)]
    at = np.repeat(start[:-1], n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    return start // 64, np.packbits(parity, bitorder="little").view(np.int64)


def differing_bits(x: str, y: str) -> Column:
    """Bits that differ when the longer vector (at most twice as long) is folded to the shorter one: no more than the
    elements that differ."""
    short, long = F.when(F.size(x) <= F.size(y), F.col(x)).otherwise(F.col(y)), F.when(F.size(x) <= F.size(y), F.col(y)).otherwise(F.col(x))
    bits = F.transform(short, lambda v, i: F.bit_count(v.bitwiseXOR(F.get(long, i)).bitwiseXOR(F.coalesce(F.get(long, i + F.size(short)), F.lit(0).cast("long")))))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


SET_TYPE = "n long, one long, two long"
PREFIX_TYPE = f"{SET_TYPE}, prefix long, tokens array<long>, bits array<long>, code array<long>"


def _sets(docs: DataFrame, level: np.ndarray | None = None, among: np.ndarray | None = None) -> DataFrame:
    """Per document doc, the size n and two hashes of its set; with level also its prefix (hash and elements) and bit vector.
    With among, instead all elements, of those documents whose `key` that membership table admits."""
    sent = docs.sparkSession.sparkContext.broadcast(level) if level is not None else None
    admitted = docs.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if admitted is not None:
                batch = batch.filter(pa.array(_maybe(admitted.value, batch.column("key").to_numpy())))
            buf, bounds = texts_as_bytes(batch.column("text"))
            out: dict = {}
            for a, b in blocks(bounds):
                owner, h = shingle_sets(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                n = np.bincount(owner, minlength=b - a)
                place = np.r_[0, np.cumsum(n)]
                sums = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)][place])
                out = {"doc": batch.column("doc").slice(a, b - a), "n": pa.array(n), "one": pa.array(signed(sums(mix(h)))), "two": pa.array(signed(sums(mix(h ^ np.uint64(0xABCDEF)))))}
                if admitted is not None:
                    out["elements"] = pa.ListArray.from_arrays(pa.array(place, type=pa.int32()), pa.array(signed(h)))
                if sent is not None:
                    order = np.lexsort((h, sent.value[bucket(h)], owner))
                    size = np.where(n > 0, n - -(-n * SIMILAR // 100) + 1, 0)
                    keep = np.arange(len(h)) - place[owner] < size[owner]
                    tokens = h[order][keep]
                    at = np.r_[0, np.cumsum(size)]
                    prefix = np.diff(np.r_[np.uint64(0), np.cumsum(mix(tokens ^ np.uint64(0x77)), dtype=np.uint64)][at])
                    start, bits = bit_vectors(h, n)
                    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values))
                    out |= {"prefix": pa.array(signed(prefix)), "tokens": lists(at, signed(tokens)), "bits": lists(start, bits), "code": lists(*bit_vectors(h, n, code_bits(n)))}
                yield pa.RecordBatch.from_pydict(out)
            del batch, buf, bounds, out  # before the next batch is read
        give_back()

    kind = f"{SET_TYPE}, elements array<long>" if among is not None else SET_TYPE if level is None else PREFIX_TYPE
    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, {kind}")


def _membership(df: DataFrame, column: str) -> np.ndarray:
    """A bit per bucket of the values of a long column: a fixed-size table that rules most other values out."""

    def fill(own: np.ndarray, batch: pa.RecordBatch) -> None:
        at = (mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return fixed_array(df.select(column), BITS // 8, "uint8", fill, np.bitwise_or)


def _maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (mix(values.view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _may_hold(df: DataFrame, column: str, values: Column) -> Column:
    """Whether the membership table of df's column admits the (long) values; only they travel to Python."""
    sent = df.sparkSession.sparkContext.broadcast(_membership(df, column))

    @F.arrow_udf("boolean")
    def admitted(v: pa.Array) -> pa.Array:
        return pa.array(_maybe(sent.value, v.to_numpy(zero_copy_only=False)))

    return admitted(values)


POSTED_TYPE = "token long, g long, n long, pos int, r1 long, r2 long"


def _postings(heads: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row for each element of each group's prefix that `bits` does not rule out, with its place and the two such elements
    that stand before it."""
    sent = heads.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            tokens, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = _maybe(sent.value, tokens)
            owner = np.repeat(np.arange(len(counts)), counts)
            pos = (np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts))[keep].astype(np.int32)
            tokens, owner = tokens[keep], owner[keep]

            def before(k: int) -> pa.Array:
                other = np.r_[np.full(min(k, len(owner)), -1), owner[:-k]]
                return pa.array(np.r_[np.zeros(min(k, len(tokens)), dtype=np.int64), tokens[:-k]], mask=other != owner)

            g, n = (batch.column(c).to_numpy()[owner] for c in ("g", "n"))
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens), "g": pa.array(g), "n": pa.array(n), "pos": pa.array(pos), "r1": before(1), "r2": before(2)})

    return heads.select("tokens", "g", "n").mapInArrow(run, POSTED_TYPE)


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= SIMILAR * F.greatest(F.col(a), F.col(b))


def _early() -> Column:
    """Whether an element stands where the first common one of the smaller set of a linked pair can stand."""
    return (100 + SIMILAR) * F.col("pos") <= (100 - SIMILAR) * F.col("n")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b) of classes."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    asked = materialize(classes.select("id", "doc", "n", "one", "two", "bits").join(asked, "id"), "jaccard-asked")
    side = lambda c: asked.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    may = (100 + SIMILAR) * differing_bits("xa", "xb") <= (100 - SIMILAR) * (F.col("na") + F.col("nb"))
    close = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("na", "nb") & may).select("a", "b", "na", "nb"), "jaccard-close")
    near = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    wanted = materialize(asked.drop("bits").join(near, "id").withColumn("key", F.xxhash64("doc")), "jaccard-wanted")
    whole = _sets(docs.withColumn("key", F.xxhash64("doc")), among=_membership(wanted, "key")).drop("doc")
    same = ["n", "one", "two"]
    held = whole.groupBy(*same).agg(F.min("elements").alias("h")).join(wanted.select("id", *same), same).select("id", "h")
    held = materialize(held, "jaccard-elements")
    both = close.join(held.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(held.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return materialize(both.where(100 * shared >= SIMILAR * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest member) of all linked ones, by alternating large and small stars.

    Least neighbours are aggregated with partial sums and written before they are joined back, so that the rows of a hub
    are dealt over several tasks.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "stars-least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "stars-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "stars-least")
        small = large.join(least.select("u", "m"), "u").select(F.col("v").alias("x"), "u", "m")
        edges = materialize(small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        # done when each vertex has one edge and it leads to one that has none
        if least.where("k > 1").isEmpty() and least.select(F.col("m").alias("u")).join(least.select("u"), "u", "left_semi").isEmpty():
            return least.select(F.col("u").alias("id"), F.col("m").alias("component")).unionByName(least.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())


#: What the ids are exclusively or'ed with for the orders in which a posting's pivots are the first.
ORDERS = [0, *(int(x) for x in mix(np.arange(1, PIVOTS, dtype=np.uint64)) >> np.uint64(1))]


def _pivoted(posted: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs a < b of classes: each group's members with the heads of some groups of its postings, and with its own head."""
    couples = posted.where("held = 2").groupBy("token").agg(F.min("g").alias("p"), F.max("g").alias("g"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(F.col("n") - F.col("pos")).alias("left"))
    couples = couples.where(_sizes_fit("lo", "hi") & ((100 + SIMILAR) * F.col("left") >= SIMILAR * (F.col("lo") + F.col("hi")))).select("g", "p")
    # places up to those where a first common element of sets of one size can stand
    crowds = posted.where((F.col("held") > 2) & _early()).select("token", "g")
    firsts = [F.min(F.col("g").bitwiseXOR(F.lit(x))).alias(f"p{i}") for i, x in enumerate(ORDERS)]
    pivots = crowds.groupBy("token").agg(*firsts).select("token", F.array_distinct(F.array(*[F.col(f"p{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(ORDERS)])).alias("ps"))
    star = couples.unionByName(crowds.join(materialize(pivots, "jaccard-pivots"), "token").select("g", F.explode("ps").alias("p"))).where("g <> p").distinct()
    star = materialize(star, "jaccard-star")
    head_size = members.where("id = g").select(F.col("g").alias("p"), F.col("n").alias("np"))
    expanded = star.join(members, "g").join(head_size, "p").where(_sizes_fit("n", "np")).select(F.col("id").alias("x"), F.col("p").alias("y"))
    inside = members.where("id <> g").select(F.col("id").alias("x"), F.col("g").alias("y"))
    return expanded.unionByName(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open_tokens(posted: DataFrame, own: DataFrame) -> DataFrame:
    """token of the postings (token, g, pos) that hold several components, less those that the same groups have as another one
    earlier in the order of elements.

    The first common element of a pair is never left out, and there the pair is met; a passage that many texts share is
    one posting of each text then, not one for each of its shingles.
    """
    span = materialize(own.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "jaccard-spans")
    same = [F.bit_xor(F.xxhash64("g")).alias("s"), F.bit_xor(F.xxhash64("g", F.lit("second"))).alias("t"), F.count(F.lit(1)).alias("k"), F.min(F.struct("g", "pos")).alias("m")]
    held = posted.select("token", "g", "pos").join(span, "g").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *same).where("lo < hi")
    first = held.groupBy("s", "t", "k", F.col("m.g").alias("least")).agg(F.min(F.struct("m.pos", "token"))["token"].alias("token"))
    return materialize(first.select("token"), "jaccard-several")


def _still_apart(posted: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a < b of classes in different components that share a posting or a group and pass all filters on it."""
    own = materialize(members.join(found, "id", "left").select("id", "n", "g", F.coalesce("component", "id").alias("c"), "code"), "jaccard-own")
    crowd = materialize(own.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "jaccard-crowds")
    nothing = F.lit(None).cast("long")
    inside = crowd.select(F.xxhash64("g", F.lit("group")).alias("token"), "g", F.lit(0).alias("pos"), nothing.alias("r1"), nothing.alias("r2"))
    # a posting of two groups of one class each holds one pair, which has been tried
    larger = posted.where("held = 2").join(crowd, "g", "left_semi").select("token").distinct()
    open_ = posted.where("held > 2").unionByName(posted.where("held = 2").join(larger, "token", "left_semi"))
    open_ = open_.select("token", "g", "pos", "r1", "r2").unionByName(inside)
    apart = materialize(open_.join(_open_tokens(open_, own), "token", "left_semi").join(own, "g").drop("g"), "jaccard-apart")
    columns = ("id", "n", "pos", "r1", "r2", "c", "code")
    left = apart.where(_early()).select("token", *[F.col(c).alias(f"{c}_x") for c in columns])
    right = apart.select("token", *[F.col(c).alias(f"{c}_y") for c in columns])
    once = F.col("n_x") < F.col("n_y")
    once |= (F.col("n_x") == F.col("n_y")) & ((F.col("pos_x") < F.col("pos_y")) | (F.col("pos_x") == F.col("pos_y")) & (F.col("id_x") < F.col("id_y")))
    room = (100 + SIMILAR) * F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= SIMILAR * (F.col("n_x") + F.col("n_y"))
    same = F.lit(False)
    for x in ("r1_x", "r2_x"):
        for y in ("r1_y", "r2_y"):
            same |= F.coalesce(F.col(x) == F.col(y), F.lit(False))
    near = (100 + SIMILAR) * differing_bits("code_x", "code_y") <= (100 - SIMILAR) * (F.col("n_x") + F.col("n_y"))
    two = left.join(right, "token").where((F.col("c_x") != F.col("c_y")) & once & _sizes_fit("n_x", "n_y") & room & ~same & near)
    return two.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every document (component_id null where the key is)."""
    everything = documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    docs = everything.where("doc is not null")
    same = ["n", "one", "two"]
    with scratch(documents.sparkSession):
        least = _sets(docs, rarity(docs)).where("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "prefix", "tokens", "bits", "code")).alias("x"))
        classes = materialize(least.select(F.monotonically_increasing_id().alias("id"), *same, "x.*"), "jaccard-classes")
        groups = materialize(classes.groupBy("n", "prefix").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("k")).where("k > 1"), "jaccard-groups")
        members = classes.select("id", "n", "prefix", "code").join(groups, ["n", "prefix"], "left").select("id", "n", F.coalesce("g", "id").alias("g"), "code")
        members = materialize(members, "jaccard-members")
        others = materialize(members.where("id <> g").select("id"), "jaccard-others")
        heads = classes.join(others, "id", "left_anti").select(F.col("id").alias("g"), "n", "tokens")
        # elements that two groups have, and one where they can be the first common one of the smaller set
        tokens = heads.select("n", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null")
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.count_if(_early()).alias("early"))
        shared = shared.where("held > 1 and early > 0").select("token", "held")
        shared = materialize(shared, "jaccard-shared")
        posted = materialize(_postings(heads, _membership(shared, "token")).join(shared, "token"), "jaccard-posted")
        tried = materialize(_pivoted(posted, members), "jaccard-pairs")
        found = materialize(components(verified(tried, classes, docs)), "jaccard-components")
        rest = _still_apart(posted, members, found).join(tried, ["a", "b"], "left_anti")
        more = verified(materialize(rest, "jaccard-rest"), classes, docs)
        # the further links join components
        named = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        wider = materialize(components(between), "jaccard-wider").select(F.col("id").alias("c"), F.col("component").alias("w"))
        placed = classes.select("id", "doc", *same).join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
        placed = materialize(placed.join(wider, "c", "left").select("doc", *same, F.coalesce("w", "c").alias("c")), "jaccard-placed")
        smallest = materialize(placed.groupBy("c").agg(F.min("doc").alias("component_id")), "jaccard-smallest")
        ids = materialize(placed.join(smallest, "c").select(*same, "component_id"), "jaccard-ids", keep=True)
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return _sets(everything).join(ids, same, "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those whose component has a smaller document; rows without a key stay, and all columns.

    A fixed-size table of the dropped keys lets most documents pass where they are; only
    those that it cannot rule out are joined with the exact list.
    """
    found = near_duplicates(documents.select(f"`{key}`", f"`{text}`"), key, text)
    gone = found.where(F.col("component_id") < F.col(f"`{key}`")).select(F.col(f"`{key}`").alias("__gone")).distinct()
    gone = materialize(gone.withColumn("__hash", F.xxhash64("__gone")), "jaccard-gone")
    known = F.col(f"`{key}`")
    marked = documents.withColumn("__maybe", known.isNotNull() & _may_hold(gone, "__hash", F.xxhash64(known)))
    unsure = marked.where("__maybe").join(gone, known == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").unionByName(unsure).drop("__maybe")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL = {
    "op4_jaccard_join": """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS s FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL
  UNION SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
}
