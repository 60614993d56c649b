"""The training-data operators against brute force, round trips and planted cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import bpe, common, compaction, components, decontam, jaccard_forest, licenses, line_rules, pii, quality_crf, repair_store, suffix_dedup  # noqa: E402
from tessera.llm.common import alnum_words, shared_dir  # noqa: E402
from tessera.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns with the names that operators use inside."""
    rng = random.Random(5)
    long = prose(rng, 5000)
    rows = [(1, None, None, "h"), (None, "some text without an id", "en", None), (None, None, None, None), (2, "", "en", "h"), (3, " \n\t ", "en", "h"), (4, long, "en", "h"), (4, long, "en", "h"), (5, long, "de", "i"), (6, "x", "en", "h"), (7, "é" * 30000, "fr", "h"), (8, "a\x00b\nc", "en", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("n_words", "rk", "cid", "label", "_row", "h", "score", "part", "token_ids", "kept", "i", "id", "_rk", "_key", "_gone", "_gs", "gs", "row", "r", "t", "at", "u", "size", "a.b", "_shard", "arrival", "item_id", "rows", "salt"):
        df = df.withColumn(c, F.lit(1))
    return df


LONG = (4, 4, 5)

#: What each operator gives on the odd rows: a function of its result, and the value that it must have.
ON = {
    "bpe": (lambda d: bpe.encode_texts(d, P.path("byte_bpe_50k.json")), lambda g: {(r.doc_id, r.n_tokens) for r in g if r.doc_id in (1, 2)} | {r.n_tokens > 5000 for r in g if r.doc_id in LONG}, {(1, 0), (2, 0), True}),
    "repair": (lambda d: repair_store.store_tokens(d, P.path("word_bpe_49k.json")), lambda g: sorted(r.n_tokens for r in g if r.doc_id in (1, 2, 3)) + [len({r.start for r in g})], [1, 1, 1, 11]),
    "rules": (line_rules.quality_rules, lambda g: sorted(r.doc_id for r in g if r.kept), [4, 4, 5]),
    "apply_rules": (line_rules.apply_quality_rules, lambda g: sorted(r.doc_id for r in g), [4, 4, 5]),
    "licenses": (licenses.scan_licenses, lambda g: {(r.n_base, r.labels, r.score) for r in g}, {(0, "", 0.0)}),
    "pii": (pii.find_pii, lambda g: {(r.spans, r.n_spans, r.n_secret) for r in g}, {("", 0, 0)}),
    "redact": (pii.redact, lambda g: sorted(map(len, filter(None, (r.text for r in g))))[-1], 30000),
    "jaccard": (jaccard_forest.ngram_jaccard_join, lambda g: {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in g if r.doc_id}, {1: (1, 0, 1), 2: (1, 0, 1), 3: (1, 0, 1), 4: (4, 0, 4), 5: (4, 0, 4), 6: (6, 0, 6), 7: (7, 0, 7), 8: (8, 0, 8)}),
    "keep_one": (jaccard_forest.keep_one_of_each_group, lambda g: sorted(r.doc_id or 0 for r in g), [0, 1, 4, 6, 7, 8]),
    "suffixes": (suffix_dedup.repeated_passages, lambda g: {(r.doc_id, r.passages) for r in g if r.passages}, {(4, "0:5000"), (5, "0:5000")}),
    "remove_repeats": (suffix_dedup.remove_repeats, lambda g: sorted((r.doc_id, len(r.text) > 9000) for r in g if r.doc_id in LONG), [(4, True), (4, True), (5, False)]),
    "compaction": (compaction.shard_arrivals, lambda g: sorted(r.n_chars or 0 for r in g)[-1], 30000),
    "quality": (lambda d: quality_crf.quality_classifier(d, d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"))), lambda g: {r.score for r in g if r.doc_id in (1, 2, 3)}, {0.0}),
    "decontam": (lambda d: decontam.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda g: {(r.doc_id, r.n_items, r.contaminated) for r in g}, {(1, 0, False), (None, 0, False), (None, 0, True), (2, 0, False), (3, 0, False), (4, 2, True), (5, 2, True), (6, 1, True), (7, 1, True), (8, 1, True)}),
}
ON["decontam_large"] = (lambda d: decontam.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text"), max_index_bytes=-1), *ON["decontam"][1:])
DROPS = {"apply_rules", "keep_one"}


@pytest.mark.parametrize("name", ON)
def test_odd_rows(odd, name):
    run, seen, want = ON[name]
    out = run(odd)
    got = out.collect()
    assert (name in DROPS or len(got) == 11) and seen(got) == want
    if name in DROPS | {"redact", "remove_repeats"}:
        assert out.columns == odd.columns and all(r[c] == 1 for r in got for c in out.columns[4:])


@pytest.mark.parametrize("name", ON)
def test_empty_tables(odd, name):
    assert ON[name][0](odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
@pytest.mark.parametrize("name", ON)
def test_ids_of_other_types(odd, name, kind):
    if (name, kind) == ("quality", "string"):
        return  # its labels here come from a remainder
    run, seen, want = ON[name]
    out = run(odd.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert out.schema["doc_id"].dataType.simpleString() == kind
    got = out.withColumn("doc_id", F.col("doc_id").cast("long"))
    if name == "jaccard":
        got = got.withColumn("class_id", F.col("class_id").cast("long")).withColumn("group_id", F.col("group_id").cast("long"))
    assert seen(got.collect()) == want


def test_pipeline_stages_on_odd_rows(odd, sf):
    import corpus_pipeline as cp

    want = {"quality rules": [4, 4, 5], "n-gram Jaccard join": [0, 1, 4, 6, 7, 8], "benchmark decontamination": [0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8], "PII": [0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8]}
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(odd.sparkSession, docs, sf)
        assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == want[name], name
        assert stage(odd.sparkSession, docs.limit(0), sf).count() == 0
    assert cp.STAGES[-1][1](odd.sparkSession, docs, sf).count() == 11


# 1


def test_bpe_is_the_library(texts):
    path = P.path("byte_bpe_50k.json")
    model, library = bpe.load(path), Tokenizer.from_file(path)
    more = ["", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "x" * 500, "日本語 текст x\x85y　", "it's I'LL 'twas don't", "a\r\n\n  b \t"]
    rng = random.Random(16)
    kinds = ["abcdefgh ", "the and ing tion ", " \n\t\r", "'s't're'll", "0123 ", "éüßñçø ÀÉ", "\xa0\x85\u3000", "日本語の文", ".,!?#$%&*()[]", "".join(map(chr, range(1, 0x260)))]
    more += ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    for t in [*texts.values(), *more]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = model.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids and model.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_cut_only_between_tokens():
    model = bpe.load(P.path("byte_bpe_50k.json"))
    inside = {(a, b) for t in model.token_bytes for a, b in zip(t, t[1:])}
    raw = random.Random(1).randbytes(500)
    parts = model.fragments(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    assert all((a[-1], b[0]) not in inside for a, b in zip(parts, parts[1:]))


def test_bpe_keeps_no_long_pieces():
    model = bpe.load(P.path("byte_bpe_50k.json"))
    long = "ab" * 5_000_000
    assert len(model.encode(long)) > 1_000_000
    for cache in (model.piece, model.fragment):
        assert max(map(len, cache), default=0) <= cache.longest and cache.held <= cache.most_chars + cache.longest
    small = common.Bounded(str.upper, 10, 20, 5)
    for x in ("a" * 30, *(c * 4 for c in "bcdefghi")):
        assert small[x] == x.upper() and sum(map(len, small)) <= 24


def test_rows_with_arrays_count_by_their_items(spark):
    df = spark.range(3).withColumn("gs", F.sequence(F.lit(1), F.lit(1000)))
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.sized(df, 100)) and not hinted(common.sized(df, 100, F.size("gs"))) and hinted(common.sized(df, 4000, F.size("gs")))
    assert hinted(common.sized(df.limit(0), 0, F.size("gs")))


def test_lines_taken_away_from_a_text_of_many_lines(spark, monkeypatch):
    """A text of 100 000 lines over the limit, whose line hashes are more than may be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1000)
    lines = [f"a{i} b{i} c{i}" for i in range(100_000)]
    rows = [(i, "\n".join(lines), "h") for i in range(3)] + [(9, "\n".join(["one two three four five six seven eight nine ten eleven", lines[5]]), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_rules.apply_quality_rules(docs, max_docs=2).collect()}
    assert len(got) == 2 and got[0] == rows[0][1] and got[9] == rows[3][1].split("\n")[0]


def test_bpe_rows(docs, texts):
    path = P.path("byte_bpe_50k.json")
    got = bpe.encode_texts(docs, path)
    for r in got.collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens * 4 == len(r.token_ids)
    assert {r.doc_id: r.text for r in bpe.decode_ids(got, path).collect()} == texts


# 2


def test_quality_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_crf.quality_classifier(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert all(got["held_out"]) and set(got["predicted"]) <= {0, 1} and got["score"].between(0, 1).all()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes, t = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    u = rng.normal(size=8)
    *_, odds = quality_crf.forward_backward(u, sizes, t)
    at = 0
    for n in sizes:
        p = np.zeros((n, 2))
        for y in np.ndindex(*[2] * n):
            s = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            for i in range(n):
                p[i, y[i]] += s
        assert np.allclose(np.log(p[:, 1] / p[:, 0]), odds[at : at + n])
        at += n


def test_chain_sums_are_those_of_enumeration():
    rng = np.random.default_rng(5)
    sizes, t, u = np.array([4, 1, 3]), rng.normal(size=(2, 2)), rng.normal(size=8)
    logz, m, joint = quality_crf.chain_sums(u, sizes, t)
    at, pair = 0, 0
    for k, n in enumerate(sizes):
        total, one, two = 0.0, np.zeros(n), np.zeros((4, max(0, n - 1)))
        for y in np.ndindex(*[2] * n):
            p = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += p
            one += p * np.array(y)
            for i in range(n - 1):
                two[2 * y[i] + y[i + 1], i] += p
        assert np.allclose(logz[k], np.log(total)) and np.allclose(m[at : at + n], one / total) and np.allclose(joint[:, pair : pair + n - 1], two / total)
        at, pair = at + n, pair + n - 1


def test_good_and_bad_lines_of_one_text_come_apart(spark):
    """Texts of lines from good and from bad documents that the fit has not seen: the marginals tell them from each other."""
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.train(d, l)
    unseen = d.where(quality_crf.held_out(F.col("doc_id"))).join(l, "doc_id").orderBy("doc_id").collect()
    good, bad = ([x for r in unseen if r.quality == q and r.text for x in r.text.split("\n") if len(x) > 60 and len(set(x.split())) > 5] for q in (1, 0))
    bad = [x for x in bad if re.search("!!|[#$%&*]{3}", x)]  # what makes a line of these documents bad
    assert len(good) > 30 and len(bad) > 10
    rng = random.Random(7)
    rank = []
    for _ in range(200):
        lines = [(rng.choice(good), 1) for _ in range(4)] + [(rng.choice(bad), 0) for _ in range(3)]
        rng.shuffle(lines)
        p = [x for _, x in model.lines("\n".join(x for x, _ in lines))]
        rank += [a > b for a, (_, x) in zip(p, lines) for b, (_, y) in zip(p, lines) if x > y]
    assert np.mean(rank) > 0.9
    assert model.lines("") == [] and np.diag(model.transitions).sum() - model.transitions[0, 1] - model.transitions[1, 0] < 6


def test_quality_of_repeated_ids_and_odd_labels(spark):
    rows = [(i % 7, "good words in a line, as it should be." if i % 2 else "BAD!! LINE!! $$$ $$$", "x") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    l = spark.createDataFrame([(i % 7, i % 2) for i in range(14)] + [(None, 1), (3, None), (900, 1)], "doc_id int, quality int")
    got = quality_crf.quality_classifier(d, l)
    assert got.schema["doc_id"].dataType.simpleString() == "int" and got.count() == 200 and {r.score for r in got.collect()} == {0.5}


# 3


def jaccard_brute(rows, s=0.8):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := alnum_words(t)) else frozenset() for i, t in rows}
    classes = collections.defaultdict(list)
    for i, x in sets.items():
        classes[x].append(i)
    reps = {x: min(v) for x, v in classes.items()}
    links = collections.Counter()
    root = {i: i for i in reps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    full = [x for x in reps if x]
    for i, x in enumerate(full):
        for y in full[:i]:
            if len(x & y) >= s * len(x | y) - 1e-9:
                links[reps[x]] += 1
                links[reps[y]] += 1
                a, b = sorted((find(reps[x]), find(reps[y])))
                root[b] = a
    return {i: (reps[x], links[reps[x]], find(reps[x])) for i, x in sets.items()}


def near_family(n, size=200, seed=3):
    rng = random.Random(seed)
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(size)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, -1])
def test_jaccard_join_is_exact(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    every = near_family(300) + [prose(rng, 120) for _ in range(60)] + ["", None, "a b", "a b", "A, b!"] + near_family(5, 60, 9)
    rows = list(enumerate(every))
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard_forest.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_brute(rows)
    df = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").withColumn("lang", F.lit("x"))
    kept = jaccard_forest.keep_one_of_each_group(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({g for _, _, g in got.values()})


def test_prefixes_are_shortened_until_the_recall():
    levels, depths, trees = jaccard_forest.prefix_levels, jaccard_forest.DEPTH - jaccard_forest.ROOT + 1, jaccard_forest.TREES
    recall = lambda d: 1 - (1 - 0.8**d) ** trees
    assert levels([]) == [] and levels([[2] * depths] * trees) == [2] * trees and recall(7) >= jaccard_forest.RECALL > recall(8)
    # one crowded prefix stays long, and the others are shortened for it
    assert levels([[2] * depths] * 39 + [[900, 900, 900, 900, 2, 1]]) == [1] * 39 + [4]
    # in a family that crowds every tree nothing is left out
    assert levels([[900] * depths] * trees) == [2] * trees
    assert levels([[2] * depths] * trees, threshold=0.95) == [depths - 1] * trees


def test_jaccard_join_of_texts_that_share_most_words(spark):
    rng = random.Random(14)
    shared, rows = prose(rng, 150, 4000).split(), []
    for _ in range(150):  # families of near-duplicates, all with the same 150 words
        own = prose(rng, 60, 4000).split()
        for _ in range(rng.randrange(1, 4)):
            w = list(own)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(shared + w)))
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard_forest.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_brute(rows)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(500):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in p for p in pairs if p[0] != p[1])}


# 4


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 300, 400)
    seqs = [np.concatenate([*(base[s : s + 40] for s in rng.integers(0, 360, rng.integers(0, 30))), [2]]).astype("<u2") for _ in range(60)]
    blob = repair_store.pack([s.tobytes() for s in seqs], 49408)
    shard = repair_store.Shard(blob)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(shard.docs(), seqs, strict=True))
    assert len(blob) < sum(s.nbytes for s in seqs) and shard.lengths.max() > 2
    for i, s in enumerate(seqs):
        a = int(rng.integers(0, len(s)))
        b = int(rng.integers(a, len(s) + 1))
        assert (shard.doc(i, a, b) == s[a:b]).all() and (shard.doc(i) == s).all()


def most_frequent(shard):
    """How often the most frequent pair within documents stands in a shard."""
    inside = np.ones(len(shard.seq), bool)
    inside[shard.ends - 1] = False
    pairs = (shard.seq[:-1].astype(np.int64) << 32 | shard.seq[1:])[inside[:-1]]
    return np.unique(pairs, return_counts=True)[1].max() if len(pairs) else 0


def test_repair_goes_on_below_a_hot_pair():
    rng = np.random.default_rng(2)
    ids = rng.integers(10, 49408, 300_000)
    at = rng.permutation(75_000)[:5_250] * 4
    ids[at], ids[at + 1] = 3, 4  # one pair 5120 times, 13 others 10 times each
    for k in range(13):
        ids[at[5_120 + 10 * k : 5_130 + 10 * k]] = 5
        ids[at[5_120 + 10 * k : 5_130 + 10 * k] + 1] = 10 + k
    shard = repair_store.Shard(repair_store.pack([x.astype("<u2").tobytes() for x in np.split(ids, 100)], 49408))
    assert (np.concatenate(list(shard.docs())) == ids).all()
    assert most_frequent(shard) < repair_store.MIN_COUNT


def test_repair_has_as_many_rules_as_it_needs():
    """More rules than 16 bits have room for: pairs of 30 000 ids, six times each, and pairs of those."""
    rng = np.random.default_rng(6)
    words = rng.permutation(np.arange(10, 49_000))[:40_000].reshape(-1, 2)
    ids = np.concatenate([words[rng.permutation(20_000)].ravel() for _ in range(7)])
    blob = repair_store.pack([x.astype("<u2").tobytes() for x in np.split(ids, 100)], 49408)
    shard = repair_store.Shard(blob)
    assert len(shard.lengths) > repair_store.SYMBOLS and int(shard.seq.max()) >= repair_store.SYMBOLS and most_frequent(shard) < repair_store.MIN_COUNT
    assert (np.concatenate(list(shard.docs())) == ids).all() and (shard.doc(3, 10, 500) == np.split(ids, 100)[3][10:500]).all()


def test_no_frequent_pair_is_left_in_large_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    path = shared_dir(spark, "token-shards")
    repair_store.write_shards(docs.coalesce(2), path, P.path("word_bpe_49k.json"))
    rules = []
    for r in spark.read.parquet(path).select("blob").toLocalIterator():
        shard = repair_store.Shard(r.blob)
        rules.append(len(shard.lengths) - shard.first)
        assert most_frequent(shard) < repair_store.MIN_COUNT
    assert max(rules) > repair_store.SYMBOLS - 49408  # 16 bits would not have been enough


def test_token_files(docs, texts):
    library, at, want, every = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}, {}
    for i in sorted(texts):
        ids = every[i] = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = repair_store.store_tokens(docs, P.path("word_bpe_49k.json"))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want
    path = shared_dir(docs.sparkSession, "token-shards")
    repair_store.write_shards(docs, path, P.path("word_bpe_49k.json"))
    for a, b in ((0, 10), (7, 300), (100_000, 100_010)):
        assert {r.doc_id: r.ids for r in repair_store.read_slices(docs.sparkSession, path, a, b).collect()} == {i: x[a:b] for i, x in every.items()}
    # the method's point: what is stored is smaller than the ids, and no frequent pair is left in any shard
    stored = docs.sparkSession.read.parquet(path).collect()
    assert sum(len(r.blob) for r in stored) < 0.8 * 2 * at
    for r in stored:
        assert most_frequent(repair_store.Shard(r.blob)) < repair_store.MIN_COUNT


def test_word_pieces_are_the_library():
    model, end = repair_store.load(P.path("word_bpe_49k.json")), b""
    odd = [c for cp in [*range(1, 0x300), 0x1F2, 0x3A3, 0x130, 0x2003, 0x4E00, 0x1E9E] if (c := chr(cp))]
    for t in [f"A{c}b 1{c} {c}{c}. '{c}'S" for c in odd] + ["<|endoftext|> x", "don't WON'T 'll", "", "é Å"]:
        assert np.frombuffer(model.encode([t], end)[0], "<u2").tolist() == model.library.encode(t, add_special_tokens=False).ids


# 5


def test_line_rules(spark):
    rng = random.Random(8)
    shared = "this very line stands in a great many documents of one host only"
    rows = [(i, f"{prose(rng, 30)}\n{shared.upper() if i % 2 else shared}", "h") for i in range(30)] + [(100 + i, f"{shared}\n{prose(rng, 3)}", "h") for i in range(5)] + [(200 + i, f"{shared}\n{prose(rng, 3)}", "other") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.quality_rules(df).collect()}
    assert all(got[i].kept for i in range(30)) and got[0].n_removed_words == 0 and got[1].n_removed_words == 13
    assert not any(got[100 + i].kept for i in range(5)) and all(got[200 + i].kept for i in range(5))
    left = {r.doc_id: r.text for r in line_rules.apply_quality_rules(df).collect()}
    assert set(left) == {i for i, r in got.items() if r.kept} and "\n" not in left[1] and shared in left[0] and shared in left[200]


def test_line_rules_on_repeated_rows_and_nulls(spark):
    """Distinct ids count, not rows; held against the SQL, which sees the same table."""
    rng = random.Random(9)
    a, b, c = (f"{name} line that stands in a number of documents of its host" for name in ("one", "another", "a third"))
    rows = [(1, f"{a}\n{prose(rng, 12)}", "h")] * 30 + [(2, f"{a}\n{prose(rng, 12)}", "h")]  # 31 rows of 2 documents
    rows += [(10 + i, f"{b}\n{prose(rng, 12)}", None) for i in range(25)] + [(None, f"{b}\n{prose(rng, 12)}", None)] * 2  # a null host
    rows += [(None, f"{c}\n{prose(rng, 12)}", "h") for _ in range(40)]  # ids are all null
    rows += [(50 + i, f"{b}\n{b}\n{prose(rng, 12)}", "h") for i in range(21)] * 2 + [(50, f"{b}\n{b}\n{prose(rng, 12)}", "i"), (99, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.quality_rules(df).toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(oracle_sql()["op5_line_rules"]).df()
    key = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).replace({"<NA>": "nan", "nan": "none"}).values))
    plain = lambda x: x.assign(doc_id=x.doc_id.map(lambda i: "none" if i != i or i is None else str(int(i))))
    assert key(plain(got)) == key(plain(want)) and got.n_removed_words.max() > 0
    assert set(got.n_removed_words[got.doc_id.isin([1, 2])]) == {0}


def test_base_counts(docs, texts):
    word = re.compile("[^\x20\x09-\x0d]+")
    extra = {10**6: "a b c d e f g a b c d e x a b c d e", 10**6 + 1: "x " * 30, 10**6 + 2: " lead\n\nlead\n# $\v&"}
    df = docs.select("doc_id", "text", "source").union(docs.sparkSession.createDataFrame([(k, v, "s") for k, v in extra.items()], "doc_id long, text string, source string"))
    for r in line_rules.quality_rules(df).collect():
        t = (texts | extra)[r.doc_id] or ""
        w = word.findall(t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


# 6


def test_licenses(docs, texts):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    extra = {10**6: "Under the MIT-License; under the mit license! CC BY CC BY-NC", 10**6 + 1: "Permission is hereby granted, free of charge, to any person obtaining a copy"}
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(list(extra.items()), "doc_id long, text string"))
    for r in licenses.scan_licenses(df).collect():
        w = alnum_words((texts | extra)[r.doc_id])
        at = [(i, l) for l, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({l for _, l in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.doc_id == 10**6 + 1:
            assert r.labels == "mit" and r.score > 0.5


def licenses_brute(text, idf):
    """Every template at every place, without an index."""
    words, found = alnum_words(text), []
    for t in licenses.TEMPLATES:
        (at, size), slack = t.keys[0], licenses.SLACK if t.whole else 0
        for s in range(len(words) - size + 1):
            if tuple(words[s : s + size]) != t.phrase():
                continue
            got = 0.0
            for wanted, side in ((t.words[at:], words[s:]), (t.words[:at][::-1], words[:s][::-1])):
                side, p = side[: len(wanted) + slack], 0
                for w, nxt in zip(wanted, [*wanted[1:], None]):
                    places = [p] + [q for q in range(max(0, p - slack), p + slack) if nxt and q + 1 < len(side) and side[q + 1] == nxt]
                    q = next((q for q in places if q < len(side) and side[q] == w), None)
                    got += idf[w] * (q is not None)
                    p = (p if q is None else q) + 1
            share = got / sum(idf[w] for w in t.words)
            others = all(any(tuple(words[max(0, q) : q + n]) == t.words[i : i + n] for q in range(s + i - at - slack, s + i - at + slack + 1)) for i, n in t.keys[1:])
            if not t.whole or others and share >= licenses.COVERED:
                found.append((t.label, share))
    return ",".join(sorted({x for x, _ in found})), min(1.0, max((x for _, x in found), default=0.0))


def test_license_labels_and_scores_against_brute_force(spark, texts):
    from tessera.llm.license_texts import TEXTS

    rng, made = random.Random(15), []
    for _, text, _ in TEXTS:
        w = text.split()
        cut = list(w)
        for _ in range(rng.randrange(1, 6)):
            cut[rng.randrange(len(cut))] = rng.choice(["some", "other thing", "The"])
        made += [text, f"{prose(rng, 20)} {text} {prose(rng, 20)}", " ".join(cut), " ".join(w[: len(w) // 2]), " ".join(w[::-1]), " ".join(w + w)]
    made += [" ".join(rng.choice("under the mit license cc by nc nd sa apache version 2 gnu general public".split()) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*made, *texts.values()])), "doc_id long, text string")
    index = licenses.RareWordIndex(*licenses.word_frequencies(df))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate([*made, *texts.values()]):
        labels, score = licenses_brute(t, index.idf)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9, t
    for k, (label, _, _) in enumerate(TEXTS):
        for i in range(3):  # as it is, among other words, and with some words changed
            assert i == 2 or label in got[6 * k + i].labels.split(",") and got[6 * k + i].score > 0.99
        # words in reverse order are no licence, but for an address that is one piece
        assert label == "apache-2" or label not in got[6 * k + 4].labels.split(",")


# 7


def pii_brute(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, x):
        d = [c for c in x if c.isdigit()]
        return {"email": True, "ip": k != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 12 <= len(d) <= 19 and pii._luhn("".join(d)), "phone": 9 <= len(d) <= 15}[k]

    return ",".join(f"{k}:{s}:{e}" for s, i, k, e in sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if ok(k, m[0])))


def test_pii_base(texts):
    rng = random.Random(6)
    made = ["".join(rng.choice("a1.@+-() 9x2") for _ in range(60)) for _ in range(3000)]
    for t in [*filter(None, texts.values()), *made, "a.b@c.d@e.f", "1" * 3000, "4111 1111 1111 1111 +1 (555) 010-9999", "x@y.z@y.z", "1.2.3.4.5.6.7.8"]:
        assert pii.joined(pii.base_spans(t)) == pii_brute(t)


def test_pii_many_repeats_of_one_cue(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for cued in (0, 25, 49):
        t = " and ".join(f'token = "{key}"' if i == cued else f"beta {key}" for i in range(50))
        at = [m.start() for m in re.finditer(key, t)]
        assert model.added([t], [pii.base_spans(t)])[0] == [(i, "secret", i + len(key)) for i in at]
    t = "call +15550109999 or " + " or ".join(["15550109999"] * 50)
    assert [k for _, k, _ in model.added([t], [pii.base_spans(t)])[0]] == ["phone"] * 50
    t = " and ".join(["beta 83920174"] * 50)
    assert model.added([t], [pii.base_spans(t)]) == [[]]


def test_pii_messages_reach_far_nodes():
    k, n = pii.NONE + 1, 40
    model = pii.SkipChainCRF(np.zeros((len(pii.FEATURES), k)), np.zeros((k, k)), 4 * np.eye(k))
    x = np.zeros((n, len(pii.FEATURES)))
    given = np.array([0] + [-1] * (n - 1))  # an address, the only evidence
    row = np.array([(i, i + 1) for i in range(n - 1)])
    p = model.marginals(x, np.empty((0, 2), np.int64), row, given)[:, 0]
    less = ((np.exp(4) - 1) / (np.exp(4) + k - 1)) ** np.arange(n)
    assert np.abs(p - (1 - less) / k - less).max() < 1e-3


def test_pii_marginals_are_those_of_enumeration():
    rng, k = np.random.default_rng(3), pii.NONE + 1
    for n, loopy in ((5, False), (6, False), (5, True)):
        size = 0.3 if loopy else 1.5
        model = pii.SkipChainCRF(rng.normal(size=(len(pii.FEATURES), k)), size * rng.normal(size=(k, k)), size * np.eye(k))
        x = rng.normal(size=(n, len(pii.FEATURES))) * 0.5
        cut = n // 2  # two chains, and one skip link between them: a tree; two more skip links close loops
        chain = np.array([(i, i + 1) for i in range(n - 1) if i + 1 != cut])
        skip = np.array([(0, n - 1), (1, n - 2), (0, cut)] if loopy else [(0, n - 1)])
        given = np.array([-1] * (n - 1) + [2])
        want = np.zeros((n, k))
        for y in np.ndindex(*[k] * n):
            if y[-1] == 2:
                p = np.exp(sum((x[i] @ model.node)[y[i]] for i in range(n)) + sum(model.chain[y[a], y[b]] for a, b in chain) + sum(model.skip[y[a], y[b]] for a, b in skip))
                want[range(n), y] += p
        want /= want.sum(1, keepdims=True)
        assert np.abs(model.marginals(x, chain, skip, given) - want).max() < (0.05 if loopy else 1e-3)


def test_pii_potentials_are_fitted():
    """Equal labels attract only as far as the sample says, and kinds that are rare in it share what the others show."""
    rng, k = np.random.default_rng(4), pii.NONE + 1
    x = np.zeros((4000, len(pii.FEATURES)))
    x[:, 0] = 1
    pairs = np.arange(4000).reshape(-1, 2)
    y = np.repeat(rng.choice([pii.RANK["secret"], pii.NONE], 2000), 2)
    flip = y.copy()
    flip[1::2] = rng.permutation(flip[1::2])  # the same labels, but pairs agree by chance alone
    no, free = np.empty((0, 2), np.int64), np.ones(4000, bool)
    tied, loose = (pii.SkipChainCRF.fit(x, z, no, pairs, free).skip for z in (y, flip))
    pull = lambda s, kind: s[pii.RANK[kind]][pii.RANK[kind]] + s[pii.NONE][pii.NONE] - 2 * s[pii.RANK[kind]][pii.NONE]
    assert pull(tied, "secret") > 6 and abs(pull(loose, "secret")) < 0.5 and pull(tied, "phone") > 2


def test_pii_long_runs_take_linear_time(spark):
    model = pii.SkipChainCRF(*(np.zeros((n, pii.NONE + 1)) for n in (len(pii.FEATURES), pii.NONE + 1, pii.NONE + 1)))
    began = time.time()
    for t in ["1" + "字" * 10**6, "@" * 10**6, "0" * 10**6 + ".1.2.3", "1." + "9" * 10**6 + ".1.1", "(" * 10**6 + "1", "+1" * 10**5, "a@" * 10**5, "1 " * 10**5, "1.1" * 10**5]:
        model.added([t], [b := pii.base_spans(t)])
        assert not t.startswith("0") or ("ip" in {k for _, k, _ in b})
    assert time.time() - began < 60


def test_pii_adds_secrets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    t = f'alpha token = "{key}" beta {key} gamma 4111111111111112 and 17 dogs'
    more = model.added([t], [pii.base_spans(t)])[0]
    assert [t[s:e] for s, k, e in more if k == "secret"] == [key, key] and len(more) == 2
    clean = "In 2024 there were 17 dogs, 3.5 cats and 1000 birds."
    assert model.added([clean], [[]]) == [[]]
    got = pii.redact(spark.createDataFrame([(1, t + " me@x.org"), (2, None)], "doc_id long, text string"), model=model).collect()
    assert got[0].text == "alpha token = \"[SECRET]\" beta [SECRET] gamma 4111111111111112 and 17 dogs [EMAIL]" and got[1].text is None


# 8


def repeats_brute(rows, m=50):
    words = {i: alnum_words(t) for i, t in rows}
    seen = collections.Counter(tuple(w[i : i + m]) for w in words.values() for i in range(len(w) - m + 1))
    out = {}
    for k, w in words.items():
        spans = []
        for i in range(len(w) - m + 1):
            if seen[tuple(w[i : i + m])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + m
                else:
                    spans.append([i, i + m])
        out[k] = (len(w), ",".join(f"{a}:{b}" for a, b in spans))
    return out


@pytest.mark.parametrize("bits", [suffix_dedup.MOST_BITS, 4])
def test_repeated_passages(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", bits)  # few bits: the runs are joined
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (49, 50, 51, 55, 70, 90, 200)]
    made = [" ".join([prose(rng, rng.randrange(0, 80)), rng.choice(passages), prose(rng, rng.randrange(0, 80))]) for _ in range(250)]
    rows = list(enumerate([*made, *near_family(120, 150), *texts.values()]))
    got = {r.doc_id: (r.n_words, r.passages) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats_brute(rows)


def test_passages_over_many_boundaries(spark, monkeypatch):
    """More partitions than rows: neighbours lie many partitions apart."""
    rng = random.Random(13)
    passages = [prose(rng, 60) for _ in range(12)]
    rows = [(i, f"{prose(rng, rng.randrange(0, 30))} {rng.choice(passages)} {prose(rng, rng.randrange(0, 30))}") for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "BOUNDARIES", 5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_words, r.passages) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == repeats_brute(rows)


def test_remove_repeats_keeps_the_first(spark):
    rng = random.Random(12)
    passages = [prose(rng, n, 3000) for n in (50, 70, 120)]
    rows = [(i, "; ".join([prose(rng, rng.randrange(0, 40), 3000), rng.choice(passages), prose(rng, rng.randrange(0, 40), 3000)])) for i in range(40)]
    rows += [(100, f"{passages[0]} and {passages[0]}"), (101, None), (102, ""), (103, rows[0][1]), (None, passages[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(7))
    out = suffix_dedup.remove_repeats(df)
    got = {r.doc_id: r.text for r in out.collect()}
    # by brute force: a word goes if a window around it stood before, in the order of ids
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = alnum_words(t)
        gone = set()
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            gone |= set(range(s, s + 50)) if key in seen else set()
            seen.add(key)
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert out.columns == df.columns and {i: alnum_words(t) for i, t in got.items()} == want
    assert got[101] is None and got[102] == "" and got[103] == "" and all(r.at == 7 for r in out.collect())
    assert sum(passages[2] in (t or "") for t in got.values()) == 1 and suffix_dedup.repeated_passages(out).where("n_passages > 0").count() == 0


# 9


def contamination_brute(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in rows:
        w, hit, its = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if g := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    its |= g
        out[d] = decontam.verdict(len(w), len(hit), its)
    return out


@pytest.mark.parametrize("limit", [decontam.MAX_INDEX_BYTES, -1])
def test_contamination(spark, sf, texts, limit):
    rng = random.Random(12)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "short one"), (901, ""), (902, None), (903, "!!"), (904, "aa " * 20), (905, prose(rng, 13))]
    rows = [*texts.items(), (10**6, items[3][1] + " tail"), (10**6 + 1, "x Short, ONE y"), (10**6 + 2, "aa " * 30), (10**6 + 3, prose(rng, 300) + " " + " ".join(alnum_words(items[5][1])[:13])), (10**6 + 4, None)]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_index_bytes=limit)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == contamination_brute(rows, items)


# 10


def test_compaction(spark, docs):
    t = compaction.ShardedTable(spark, shared_dir(spark, "t"), target_bytes=200_000)
    for a in range(9):
        t.append(docs.where(F.col("doc_id") % 9 == a).repartition(3), a)
    before, want = t.segments(), sorted(map(tuple, docs.collect()))
    rows_of = lambda version=None: sorted(map(tuple, t.read(version).select(docs.columns).collect()))
    assert t.version() == 9 and rows_of() == want and sum(s.files for s in before) == 27
    t.compact()
    after = t.segments()
    assert len(after) < len(before) and sum(s.files for s in after) < 9 and not t.runs(after) and rows_of() == want
    # older versions stay readable until they are forgotten
    assert rows_of(9) == want and rows_of(1) == sorted(map(tuple, docs.where("doc_id % 9 = 0").collect()))
    assert t.vacuum(keep_versions=100, older_than_ms=0) == 0
    assert t.vacuum(keep_versions=1, older_than_ms=0) >= len({s.path for s in before} - {s.path for s in after}) > 4 and t.versions() == [t.version()] and rows_of() == want
    with pytest.raises(compaction.CommitConflict):
        t.commit(t.version() - 1, [], t.schema())
    t.append(docs.limit(2).withColumn("_shard", F.lit(1)))
    got = t.read()
    assert got.columns[-3:] == ["_shard", "__shard", "_size"] and got.where("_shard = 1").count() == 2 and got.count() == len(want) + 2


def test_compaction_keeps_segments_of_other_sizes_apart():
    t = compaction.ShardedTable.__new__(compaction.ShardedTable)
    t.target, t.fan_in = 1000, 4
    seg = lambda k, files, size: compaction.Segment(f"p{k}", files, size, k)
    small, tiny = [seg(k, 1, 30) for k in range(4)], [seg(10 + k, 1, 2) for k in range(3)]
    assert t.runs(small + tiny) == [small] and t.runs(tiny) == []
    assert t.runs([seg(0, 1, 900), seg(1, 3, 3900)]) == []  # full
    assert t.runs([seg(0, 500, 5000)]) == [[seg(0, 500, 5000)]]  # one arrival of many small shards


def test_compaction_with_concurrent_writers(spark):
    import concurrent.futures

    root = shared_dir(spark, "t")
    tables = [compaction.ShardedTable(spark, root, target_bytes=50_000) for _ in range(3)]

    def work(k):
        for i in range(6):
            if k == 2:
                tables[k].compact()
            else:
                tables[k].append(spark.range(100 * (6 * k + i), 100 * (6 * k + i + 1), 1, 2).withColumn("x", F.lit(str(k))), i)

    with concurrent.futures.ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    tables[0].compact()
    assert sorted(r.id for r in tables[1].read().collect()) == list(range(1200)) and len(tables[0].segments()) < 4


def test_shard_arrivals_returns_what_is_stored(spark, docs, texts):
    got = compaction.shard_arrivals(docs, 5, 300_000).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == {k: v if v is None else hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()}
    assert len({r.arrival for r in got}) == 5 and max(r.shard_bytes for r in got) <= 600_000


# queries and pipeline


def test_queries_with_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values))
        assert key(got) == key(want), name


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in d.collect()}
        out = stage(spark, d, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "n-gram Jaccard join":
            assert set(after) == {g for _, _, g in jaccard_brute(sorted(before.items())).values()}
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {k for k, v in contamination_brute(before.items(), items).items() if not v[-1]}
        elif name == "PII":
            assert set(after) == set(before) and not any("@mail" in t for t in after.values())
        else:
            assert set(after) < set(before)
        d = spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)
    last = cp.STAGES[-1][1](spark, d, sf)
    assert last.count() == d.count() and {r.doc_id for r in last.collect()} == {r.doc_id for r in cp.run(spark, sf).collect()}
