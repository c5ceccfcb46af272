"""Fill-in-middle, line dedup and spelling variants against plain Python, with everything awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("llm")

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from llm import fill_middle, line_dedup, registry, spelling_variants  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_line_dedup", "op13_spelling_variants"])
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns
    key = lambda row: tuple(str(v) for v in row)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


# fill in middle


def filled(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or c % 100 >= 90:
        return len(units), "plain", None, None, text
    form = "spm" if d % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_any_text(spark):
    rng = random.Random(3)
    pieces = ["word", "A", "é", "\U0001F600", "\n", " ", "<", "P", ">", "<S", "M>", "0", "\r\n", "\x00", "ÿ", "'"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(400)] + ["<P>", "x<M>y", "", None, "long " * 100_000, "<", "a<P", ">b"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "same key"), (3, "same key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("output", F.lit(1))
    made = fill_middle.fill_in_middle(docs)
    key = lambda r: tuple(str(v) for v in r)
    got = made.collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((k, *filled(k, t)) for k, t in rows), key=key)
    assert Counter(r["restored"] for r in got) == Counter(t or "" for _, t in rows)
    assert Counter(r["restored"] for r in fill_middle.restore(made).collect()) == Counter(t or "" for _, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_shares_and_text_keys(spark):
    docs = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), F.lit("some words to be cut").alias("body"))
    forms = Counter(r["form"] for r in fill_middle.fill_in_middle(docs, "name", "body", transformed=50, suffix_first=50, seed="7:").collect())
    assert all(abs(forms[f] - n) < 150 for f, n in {"plain": 2000, "psm": 1000, "spm": 1000}.items()), forms


def test_fill_in_middle_runs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "RUN_BYTES", 50)
    schema = pa.schema([(n, t) for n, t in zip("knfpmor", [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)])
    run = fill_middle._through_duckdb(fill_middle._transform_sql(90, 20), {"seed": "1:"}, schema, 1)
    texts = ["abc def", None, "x" * 200, "", "é é é"] * 5
    out = list(run(iter([pa.RecordBatch.from_pydict({"k": list(range(25)), "body": texts})])))
    assert len(out) > 5 and [r["r"] for b in out for r in b.to_pylist()] == [t or "" for t in texts]


# line dedup


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def deduped(rows):
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n") if k is not None else []:
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if k is None or len(line_key(x)) < 10 or len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_rows():
    rng = random.Random(5)
    stock = ["a line that is repeated", "  A LINE that is repeated\t", "short", "", "ten points", "nine poin", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", " padded with nbsp ", "x" * 5000, "line\rwith return", "\v\f only blanks \r"]
    rows = [(i if i % 11 else None, "\n".join(rng.choice([*stock, f"own line number {rng.randrange(400)}"]) for _ in range(rng.randrange(9)))) for i in range(300)]
    return [*rows, (7, None), (7, "a line that is repeated"), (7, ""), (None, None), (400, "only here, twice\nonly here, twice"), (400, "only here, twice"), (401, "\n\n"), (402, "long enough line " + "y" * 900_000 + "\nx\nlong enough line " + "y" * 900_000)]


@pytest.mark.parametrize("bits", [1 << 20, 1 << 12])
def test_line_dedup_equals_brute_force(spark, monkeypatch, bits):
    """With filters that are filled up as well: only more lines are shuffled then."""
    monkeypatch.setattr(line_dedup, "filter_bits", lambda lines: bits)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("gone", F.lit(1)).withColumn("line", F.lit("clash"))
    got = line_dedup.drop_repeated_lines(docs).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(deduped(rows), key=key)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_text_keys_and_a_hot_line(spark):
    rows = [(f"k{i:04d}", f"boilerplate of the site\nown text of document {i}") for i in range(500)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "name string, body string").repartition(7), "name", "body").collect()
    assert sorted(tuple(r) for r in got) == sorted(deduped(rows))


def test_twice_filter_holds_what_is_repeated_and_little_else(spark):
    rows = [(i, f"line of its own {i}\nshared line {i // 2}") for i in range(4000)]
    words = line_dedup.twice_filter(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    own = line_dedup.Lines(np.frombuffer("\n".join(f"line of its own {i}" for i in range(4000)).encode(), dtype=np.uint8), np.array([0, len("\n".join(f"line of its own {i}" for i in range(4000)))]))
    both = "\n".join(f"shared line {i}" for i in range(2000)).encode()
    shared = line_dedup.Lines(np.frombuffer(both, dtype=np.uint8), np.array([0, len(both)]))
    assert line_dedup._has(words, shared.hash).all() and line_dedup._has(words, own.hash).mean() < 0.01
    assert line_dedup.filter_bits(10**12) == line_dedup.MOST_BITS and line_dedup.filter_bits(0) == 1 << 20


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    out = {}
    for w, n in counts.items():
        by = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = by[0] if by and -by[0][0] >= 5 * n else None
        out[w] = [n, len(by), best and best[1], best and -best[0]]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return sorted((w, *row) for w, row in out.items())


def spelled(rows):
    counts = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def word_texts():
    rng = random.Random(9)
    words = ["banana", "bananas", "banan", "bananna", "Größen", "größen", "grössen", "ÀÉÎÕÜÿ", "aaaaaaa", "aaaaaa", "aaaaaaaa", "abababab", "babababa", "abababa", "x" * 90, "x" * 89, "kitten", "mitten", "sitten", "kittens"]
    rows = [(i if i % 5 else None, " ".join(rng.choices(words, weights=[2 ** (k % 7) for k in range(len(words))], k=60)) + rng.choice([".", "", "\n", "1", "Ā"])) for i in range(400)]
    return [*rows, (1, None), (1, ""), (1, "banana"), (1, "banana"), (2, "z" * 3000 + " " + "z" * 2999), *[(3, "q" * 3000 + "w")] * 6, *[(4, "q" * 3001 + "w")] * 6]


def test_counts_equal_brute_force(spark):
    rows = word_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["word"]: r["n"] for r in spelling_variants.count_words(docs).collect()}
    assert got == spelled(rows)
    found = spelling_variants.spelling_variants(docs)
    assert sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in found.collect()) == variants({w: n for w, n in spelled(rows).items() if n >= 5})
    assert spelling_variants.spelling_variants(docs.limit(0)).count() == 0


def test_texts_that_meet_keep_their_words(spark):
    rows = [(i, t) for i, t in enumerate(["ending", "starting", "", "É", "é" * 7, None, "ßßßßßß"])]
    got = {r["word"]: r["n"] for r in spelling_variants.count_words(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == spelled(rows)


@pytest.mark.parametrize("points", [40, 4_000_000])
def test_variants_equal_brute_force_over_any_number_of_shards(spark, points):
    rng = random.Random(points)
    counts = {"".join(rng.choices("abé", k=rng.randrange(1, 7))): rng.choice([5, 6, 30, 200, 1200, 9000]) for _ in range(150)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    if points == 40:
        assert spelling_variants.trie_shards(words, points).count() > 10
    got = spelling_variants.group_variants(words, shard_points=points).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == variants(counts)


def test_trie_emits_each_neighbour_once():
    words = sorted({"aab", "aaab", "ab", "aabb", "aba", "b", "aa", "aac", "caab", "aacb"})
    trie = spelling_variants.Trie.unpack(**spelling_variants.Trie.of(words, [1] * len(words)).pack())
    for w in [*words, "", "zzz", "aaa"]:
        found = [v for v, _ in trie.neighbours(w)]
        assert sorted(found) == [v for v in words if near(w, v)], w


# near copies of long texts that share passages


def test_templated_long_texts_leave_few_pairs_to_the_last_join(spark, monkeypatch):
    """Texts of 14 of 20 shared passages of 50 words, about 700 shingles: equal to brute force, and the last join is far from all pairs."""
    from llm import jaccard_join

    rng = random.Random(1)
    passages = [[f"p{i}w{rng.randrange(10**6)}" for _ in range(50)] for i in range(20)]
    texts = [[w for k in sorted(rng.sample(range(20), 14)) for w in passages[k]] for _ in range(200)]
    counted, inner = {}, jaccard_join.materialize

    def noted(df, name, keep=False):
        out = inner(df, name, keep)
        if name == "jaccard-rest":
            counted[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}
    assert counted["jaccard-rest"] < 0.05 * 200 * 199 / 2


def test_short_vectors_of_linked_sizes_fold():
    from llm import jaccard_join

    n = np.arange(1, 20_000)
    width = np.minimum(jaccard_join.code_bits(n), np.maximum(64, 2 ** np.ceil(np.log2(2 * n)).astype(np.int64)))
    larger = width[np.minimum(n * 4 // 3, len(n)) - 1]
    assert np.isin(larger / width, (1, 2)).all()


def test_substring_dedup_judges_each_row_by_its_own_text(spark):
    from llm import substring_dedup

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (2, a), (3, f"{b} {a}"), (3, b + " end")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == [(1, 60, 0), (2, 60, 0), (2, 60, 60), (2, 60, 60), (3, 61, 60), (3, 120, 120)]
