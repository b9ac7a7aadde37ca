"""The training-data operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import blocks, bpe, common, kneser_ney, license_scan, media, mixing, packing, quality_rules, queries, simhash, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def sentence(rng, n, vocabulary=("the", "of", "and", "café", "word", "x1", "END.")):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    shared = sentence(rng, 120)
    rows = [
        (1, None, None, None, None),
        (None, "no id here " * 5, "en", "a", 3),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "b", 3),
        (4, long, "en", "b", len(long)),
        (5, shared, "fr", None, len(shared)),
        (5, shared, "fr", None, len(shared)),
        (6, "before " + shared + " after", "fr", "a", 1),
        (7, "one", "de", "a", 3),
        (8, "one", "de", "c", 3),
        (9, "a\x00b \U0001f600 é" * 40, "en", "a", 1),
        (10, "<|endoftext|> Released under the MIT License. " + sentence(rng, 20), "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("k1", "k2", "h", "s1", "spans", "row", "fp", "node", "root", "_size", "_id", "_row", "size", "target", "trusted", "block", "bucket", "kept", "shard", "t", "w", "pos")
    return df.withColumns({c: F.lit(7) for c in clash})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=((4, 1, 0), (6, 1, 0), (9, 1, 0), (10, 1, 1), (7, 0, 0), (None, 1, 0), (5, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# Common


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 40)] + [(900 + k, 901 + k) for k in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1


# 1


def brute_kneser_ney(texts):
    """log p(w | u v) of interpolated modified Kneser-Ney over word trigrams, from dictionaries."""
    counts = {3: collections.Counter(), 2: collections.Counter(), 1: collections.Counter()}
    for x in texts:
        words = ["<s>", "<s>", *words_of(x), "</s>"]
        counts[3].update(tuple(words[k - 2 : k + 1]) for k in range(2, len(words)))
    for g, n in counts[3].items():
        counts[2][g[1:]] += n if g[1] == "<s>" else 1
    for g in counts[2]:
        counts[1][g[1:]] += 1
    cut, total, freed = {}, collections.Counter(), collections.Counter()
    for k, table in counts.items():
        n = [sum(c == m for c in table.values()) for m in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        cut[k] = [0.0] + [max(kneser_ney.LEAST, min(m, m - (m + 1) * y * n[m + 1] / max(1, n[m]) if m < 4 else 0)) for m in (1, 2, 3)]
        for g, c in table.items():
            total[g[:-1], k] += c
            freed[g[:-1], k] += cut[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, context = len(g), (g[:-1], len(g))
        if not total[context]:
            return p(g[1:])
        c = counts[k][g]
        return max(0, c - cut[k][min(c, 3)]) / total[context] + freed[context] / total[context] * p(g[1:])

    return p, counts[1]


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(2)
    langs = ("en", "fr", None)
    rows = [(k, sentence(rng, rng.choice([1, 2, 60, 300]), ("a", "b", "c é", "d")), langs[k % 3], "s", 1) for k in range(90)]
    rows += [(100, "a1 unseen a1 a1 words", "en", "s", 1), (101, "#", "de", "s", 1), (None, "a1 a2", "en", "s", 1), (102, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = labels(spark, [(k, 1, 0) for k in range(70)])
    held = {r.doc_id for r in docs.where(kneser_ney.held_out()).collect()}
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, trusted).collect()}
    for lang in langs:
        p, seen = brute_kneser_ney([x for k, x, l, *_ in rows if l == lang and k is not None and k < 70 and k not in held])
        assert sum(p(("<s>", "<s>", *w)) for w in [*seen, ("never",)]) == pytest.approx(1)
        assert sum(p((b"a1", b"b2", *w)) for w in [*seen, ("never",)]) == pytest.approx(1)
        for k, x, l, *_ in rows:
            if l == lang and words_of(x):
                words = ["<s>", "<s>", *words_of(x), "</s>"]
                want = -sum(math.log(p(tuple(words[i - 2 : i + 1]))) for i in range(2, len(words)))
                assert got[k].nll / kneser_ney.UNIT == pytest.approx(want, abs=1e-4) and got[k].n_words == len(words) - 3
    assert got[101].nll is None and got[102].nll is None and got[102].n_words == 0


def test_kneser_ney_shards_and_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, sentence(rng, 60), "en" if k % 3 else None, "s", 1) for k in range(60)] + [(99, "#$%^ " * 40, "en", "s", 1), (None, sentence(rng, 60), "en", "s", 1), (1 << 60 | 1, sentence(rng, 60), "en", "s", 1)], DOCS)
    trusted = labels(spark, [(k, 1, 0) for k in range(50)])
    a = {r.doc_id: r for r in kneser_ney.classify(docs, trusted).collect()}
    monkeypatch.setattr(kneser_ney, "BLOCK_WORDS", 300)
    b = {r.doc_id: r for r in kneser_ney.classify(docs.repartition(7), trusted, space=kneser_ney.Keys(44, 13)).collect()}
    assert a == b and len(a) == 63 and None in a and (1 << 60 | 1) in a
    assert not a[99].kept and sum(a[k].kept for k in range(60)) >= 57


def test_statistics_of_languages_meet_no_ngram():
    """Even in a small space the keys of languages lie outside those of n-grams, and apart from each other."""
    space = kneser_ney.Keys(16, 7)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1 << 18).astype(np.uint64)
    grams = np.concatenate([space.of(hashes, k) for k in (1, 2, 3)])
    langs = np.array([kneser_ney.lang_hash(f"l{k}") for k in range(500)], np.uint64)
    own = np.concatenate([np.concatenate([s, s ^ 1]) for s in (space.stats(langs, k) for k in (1, 2, 3))])
    assert len(np.unique(own)) == 3000 and own.min() > grams.max()


def test_verdicts_follow_perplexity_and_threshold(spark):
    rng = random.Random(45)
    rows = [(k, sentence(rng, rng.choice([1, 4, 30, 200]), ("the", "of", "and")), "en", "a", 1) for k in range(150)]
    rows += [(200 + k, sentence(rng, rng.choice([1, 4, 30]), ("zzq", "xwv", "#$")), "en", "a", 1) for k in range(50)]
    out = kneser_ney.classify(spark.createDataFrame(rows, DOCS), labels(spark, [(k, 1, 0) for k in range(100)])).collect()
    assert all(r.kept == (r.perplexity <= r.threshold) for r in out) and len({r.kept for r in out}) == 2


# 2


def test_media_store(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (5, "x" * 65)], "doc_id long, text string")
    rows = {r.doc_id: r for r in media.document_media(docs).collect()}
    for k, x in ((1, b""), (2, b""), (3, "é".encode() * 32), (4, b"x" * 65)):
        data = x + b"\0" * (max(1, -(-len(x) // 64)) * 64 - len(x))
        stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(x), len(data), hashlib.sha256(data).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(data)
    assert rows[4].feature == rows[5].feature and rows[1].n_bytes == 0


def test_sequences_stay_aligned(spark):
    html = '<p>A <b>b</b></p><figure><img src="data:,ab" alt="x"><img src="s.png"><figcaption>both &amp; one</figcaption></figure><script>no</script>tail'
    pages = spark.createDataFrame([(1, html, 5), (2, None, 6), (1, html, 5)], "page_id long, html string, items int")
    seq = media.sequences(pages, out="seq")
    items = [[(i.pos, i.kind, i.text, i.caption) for i in r.seq] for r in seq.collect()]
    want = [(0, "text", "A b", None), (1, "image", None, "both & one"), (2, "image", None, "both & one"), (3, "text", "tail", None)]
    assert items == [want, [], want]
    store = spark.createDataFrame([(hashlib.sha256(b"ab").hexdigest(), 2)], "digest string, n int")
    out = media.resolved(seq.dropDuplicates(["page_id"]), store, ["page_id"], "seq").where("page_id = 1").first()
    assert [x.media.n if x.media else None for x in out.resolved] == [None, 2, None, None]


# 3


def brute_windows(texts, length):
    at = collections.defaultdict(list)
    for k, x in enumerate(texts):
        for p in range(len(x) - length + 1):
            at[x[p : p + length]].append((k, p))
    out = [[] for _ in texts]
    for places in at.values():
        if len(places) > 1:
            for k, p in places:
                out[k].append(p)
    return [sorted(x) for x in out]


def test_interval_expansion_finds_all_repeats():
    rng = random.Random(3)
    for _ in range(120):
        length, letters = rng.choice([5, 8, 20, 40]), rng.choice([b"ab", b"abc\0\xff", bytes(range(60, 90))])
        base = bytes(rng.choices(letters, k=100))
        texts = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 80)
            s = bytearray(base[a : a + rng.randint(0, 80)])
            for _ in range(rng.randint(0, 2)):
                if s:
                    s[rng.randrange(len(s))] = rng.choice(letters)
            texts.append(bytes(s))
        want = brute_windows(texts, length)
        unique = list(dict.fromkeys(texts))
        weights = [texts.count(x) for x in unique]
        for found in (suffix_dedup.repeated_windows(unique, weights, length), suffix_dedup.bounded_windows(unique, weights, length, 30)):
            assert [f.tolist() for f in found] == [want[texts.index(x)] for x in unique]


@pytest.mark.parametrize("many", [512, 1])
def test_removed_is_exact(spark, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup.covered, "__defaults__", (suffix_dedup.LENGTH, None, many))
    rng = random.Random(4)
    base = [sentence(rng, 200) for _ in range(6)]
    texts = []
    for k in range(40):
        s = rng.choice(base)
        a = rng.randrange(600)
        s = s[a : a + rng.randrange(1200)]
        if k % 3 == 0:
            s = sentence(rng, 5) + s
        if k % 5 == 0:
            s = s[:300] + "Z" + s[301:]
        texts.append(s)
    texts += ["ab" * 700, None, "", texts[0], "x" * 399, "y" * 400, "y" * 400]
    data = [(x or "").encode() for x in texts]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    for k, (b, starts) in enumerate(zip(data, brute_windows(data, 400))):
        covered = np.zeros(len(b) + 2, bool)
        for p in starts:
            covered[p + 1 : p + 401] = True
        kept = bytes(x for x, c in zip(b, covered[1:]) if not c)
        runs = int((covered[1:] & ~covered[:-1]).sum())
        assert got[k] == (len(b), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())


# 4


def test_base_counts():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "$ ", "a b a b a b "]) for _ in range(rng.randrange(120)))
        words = text.encode().split()
        ids, seen = blocks.word_ids(words)
        n = len(words) - 4
        windows = [tuple(words[k : k + 5]) for k in range(max(0, n))]
        count = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in lines
                lines.add(line)
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert quality_rules.base_counts(text, words, ids, len(seen)) == want


def test_repeated_words_of_many_kinds():
    words = [str(k).encode() for k in range(30_000)] + [b"1", b"2", b"3", b"4", b"5"]
    assert quality_rules.repeated_words(*(lambda i, s: (i, len(s)))(*blocks.word_ids(words))) == 10


def test_log_ratio_verdicts(spark):
    rng = random.Random(7)
    good = [(k, sentence(rng, 80, ("alpha", "beta", "gamma")), "en", "a", 1) for k in range(60)]
    bad = [(k, sentence(rng, 80, ("spam", "win", "cash")), "en", "a", 1) for k in range(100, 130)]
    docs = spark.createDataFrame(good + bad, DOCS)
    trusted = labels(spark, [(k, 1, 0) for k in range(40)])
    out = {r.doc_id: r for r in quality_rules.judge(docs, trusted).collect()}
    assert all(out[k].kept for k in range(60)) and not any(out[k].kept for k in range(100, 130))
    assert {r.doc_id for r in quality_rules.accepted(docs, trusted).collect()} == set(range(60))
    again = {r.doc_id: r for r in quality_rules.judge(docs.repartition(7), trusted).collect()}
    assert again == out
    # Scores by hand: both multinomials over the buckets, integer log ratios.
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)

    def hashed(words):
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        return np.concatenate([quality_rules.buckets(x, quality_rules.BUCKETS) for x in (h * quality_rules._UNIGRAM, blocks.mixed(h[:-1], h[1:]))])

    at = {k: hashed(words_of(x)) for k, x, *_ in good + bad}
    for k, b in at.items():
        np.add.at(raw, b, 1)
        if k < 40:
            np.add.at(target, b, 1)
    for k, b in at.items():
        own = np.bincount(b, minlength=len(raw))
        r, t = raw - own, target - own * (k < 40)
        ratio = np.rint(np.log((t + quality_rules.PSEUDO) / (r * (t.sum() / r.sum()) + quality_rules.PSEUDO)) * quality_rules.UNIT)
        assert math.isclose(out[k].score, ratio[b].sum() / len(b) / quality_rules.UNIT, abs_tol=1e-9)


def test_ratios_do_not_mix_in_a_large_vocabulary(spark, monkeypatch):
    # More distinct n-grams than the least number of buckets, in several blocks and shards.
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 15_000)
    monkeypatch.setattr(blocks, "SLICE_WORDS", 4_000)
    monkeypatch.setattr(quality_rules, "SHARD_GRAMS", 40_000, raising=False)
    rng = random.Random(31)
    words = [[f"w{int(30_000 * rng.random() ** 3)}" for _ in range(400)] for _ in range(240)]
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a", 1) for k, w in enumerate(words)], DOCS)
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels(spark, [(k, 1, 0) for k in range(120)])).collect()}
    own = [collections.Counter([*w, *zip(w, w[1:])]) for w in words]
    raw, target = sum(own, collections.Counter()), sum(own[:120], collections.Counter())
    assert len(raw) > quality_rules.BUCKETS
    for k, c in enumerate(own):
        r, t = raw.total() - c.total(), target.total() - c.total() * (k < 120)
        want = sum(n * math.log((target[g] - n * (k < 120) + quality_rules.PSEUDO) / ((raw[g] - n) * t / r + quality_rules.PSEUDO)) for g, n in c.items())
        assert math.isclose(out[k].score, want / c.total(), abs_tol=0.003)


# 5


def test_packed_rows_are_written_and_read_back(spark):
    rng = random.Random(44)
    docs = spark.createDataFrame([(k, sentence(rng, rng.choice([3, 40, 900])), "en", "a", 1) for k in range(60)], DOCS)
    rows = packing.packed(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), length=256)
    back = packing.stored(rows)
    assert all("/packed-" in f for f in back.inputFiles())
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert back.where("octet_length(ids) <> 512 or element_at(cu_seqlens, -1) <> n_tokens or cu_seqlens[0] <> 0 or slice(cu_seqlens, 1, size(resets)) <> resets").count() == 0


def test_best_fit():
    rng = random.Random(8)
    for _ in range(200):
        length = rng.randint(3, 40)
        sizes = sorted((rng.randint(1, length) for _ in range(rng.randrange(60))), reverse=True)
        left = {}
        for size, row in zip(sizes, packing.best_fit(sizes, length)):
            fitting = [v for v in left.values() if v >= size]
            assert (left[row] == min(fitting)) if row in left else not fitting
            left[row] = left.get(row, length) - size


def test_packing_loses_nothing(spark):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    rng = random.Random(9)
    texts = [sentence(rng, rng.randrange(400)) for _ in range(30)] + [None, "", "again", "again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.packed(docs, path, length=128).cache()
    for r in rows.collect():
        assert len(r.ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.resets == r.cu_seqlens[:-1]
    parts = collections.defaultdict(dict)
    for r in packing.unpacked(rows).collect():
        parts[r.doc_id][r.piece] = bytes(r.ids)
    encode = packing.tokenizer(path).encode_ordinary
    for k, x in enumerate(texts):
        ids = b"".join(v for _, v in sorted(parts[k].items()))
        assert np.frombuffer(ids, "<u2").tolist() == encode(x or "") + [packing.END]
    first = packing.with_positions(rows).first()
    assert first.positions[: first.cu_seqlens[1]] == list(range(first.cu_seqlens[1]))


# 6


def test_alias_verdicts(spark):
    rows = [
        (1, "http://a.net/x", '<link href="/y" rel=canonical>'),
        (2, "http://a.net/y", None),
        (3, "http://b.example.org/es/1", '<meta http-equiv="Refresh" content="0; URL=http://a.net/y">'),
        (4, None, "x"),
        (5, "nope", "y"),
        (6, "HTTP://X.COM/De/", ""),
        (7, "http://q.net#a/b", ""),
        (8, "http://w.org/z", '<link rel="canonical" href="http://q.net">'),
        (9, "http://b.example.org", ""),
        (10, "http://x.com/de/1", '<link rel="canonical" href="http://w.org/z">'),
        (11, "http://c.net/1?utm_source=a", ""),
        (12, "http://c.net/1", '<link rel="canonical" href="http://x.com/de/9">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"root": F.lit(1), "rule": F.lit("r"), "host": F.lit("h")})
    out = {r.page_id: r for r in url_filter.judged(pages, url_filter.rules_table(spark)).collect()}
    verdicts = {k: r.verdict for k, r in out.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "block", 12: "block"}
    assert (out[4].host, out[4].path, out[6].host, out[6].path, out[9].path) == ("", "", "x.com", "/De/", "")
    assert out[3].rule == "example.org/es/" and out[8].rule == "org/" and out[7].rule is None


def test_redirect_table(spark):
    pages = spark.createDataFrame([(1, "http://m.net/1", None), (2, "http://n.net/2", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://m.net/1", "http://z.com/de/"), (None, "x")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, url_filter.rules_table(spark), moves).collect()} == {1: "block", 2: "allow"}


# 7


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, "c": 100}, {"a": 3, "b": 1, "c": 2})
    assert t["b"] == 20 and math.isclose(sum(t.values()), 315) and all(t[k] <= 2 * n for k, n in {"a": 100, "b": 10, "c": 100}.items())


def test_flow_repeats_only_what_it_must():
    sizes = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    flow = mixing.min_cost_flow(sizes, {"a": 120, "b": 50})
    used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in sizes}
    assert sum(used.values()) == 170
    assert sum(max(0, used[p] - sizes[p]) for p in sizes) == 10  # 160 fresh words, 10 repeated
    assert sum(n for (_, s), n in flow.items() if s == "b") == 50


def test_mix(spark):
    rng = random.Random(10)
    rows = [(k, sentence(rng, rng.randint(5, 30)), "en", f"s{k % 5}" if k % 11 else None, 1) for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    source = {k: s for k, _, _, s, _ in rows}
    taken, size = collections.Counter(), collections.Counter()
    for r in out:
        assert r.size == len(words_of(rows[r.doc_id][1])) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(taken[s] - r.target) <= 16
    copies = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in out)


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, "a b c d", "en", "x", 1) for k in range(100)], DOCS)
    members = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    found, sizes, target = mixing.with_times(docs, members)
    assert sizes == {"a": 400, "b": 200} and found.count() == 100 and target["b"] <= 400


# 8


def test_bpe_is_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    ref, mine = Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(11)
    letters = "aaab  \n\t\r\x0b\x1c\x85   eétß́'’sdmvrl<>|endoftext\U0001f600漢字١٢٣ªº²½_-.,!​﻿\x00"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "ab" * 999, "<|endoftext|>a<|endoftext|><|endoftext|> b", "", "".join(map(chr, range(0x3000)))]
    texts += [w * k for w in (" the", "ing", "aa", "...", "!!!!", "=-=-") for k in range(1, 40)]
    for text in texts:
        ids = ref.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
        assert mine.decode(mine.encode(text)) == ref.decode(ids, skip_special_tokens=False)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest() and rows[1].n_tokens == 2
    assert all((rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (0, nothing, nothing) for k in (2, 3))
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "a b", 2: "", 3: ""}


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    kept = bpe.Pieces(lambda b: [len(b)])
    for k in range(20):
        assert kept["x" * k] == struct.pack("<I", k)
        assert len(kept) <= 3


# 9


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(12)
    for n in [0, 1, 2, 3, 4, 5, 50, 500]:
        text = sentence(rng, n) + " ÀÉ Z"
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("few", [48, 1])
def test_links_connect_what_all_pairs_would(spark, few, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base) | {0, 1, 3, 7, (1 << 64) - 1}
    for f in base:
        for _ in range(8):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints = sorted(prints)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(prints)], "fp long, node long")
    roots = {r.node: r.root for r in common.components(simhash.links(nodes)).collect()}
    assert [roots.get(k, k) for k in range(len(prints))] == [find(k) for k in range(len(prints))]


def test_representatives(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (5, "other words here"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [2, 5, 7]


# 10


def brute_licenses(text):
    w = license_scan.template_words(text or "")
    shingles = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
    out = set()
    for name, template in license_scan.TEMPLATES.items():
        want = set(license_scan.template_shingles(template))
        m, s = len(license_scan.template_shingles(template)), license_scan.stride(len(license_scan.template_shingles(template)))
        for start in range(0, len(shingles), s):
            if len(want & set(shingles[start : start + m + s - 1])) >= 0.8 * m:
                out.add(name)
    return ";".join(sorted(out))


def test_licenses(spark):
    rng = random.Random(14)
    texts = [None, "", "license", "Licensed under"]
    for name, x in license_scan.TEMPLATES.items():
        w = x.split()
        texts += [x, x.upper(), f"{sentence(rng, 40)} {x} {sentence(rng, 40)}", " ".join(w[: len(w) // 2]), " ".join([*w[:-1], "other"]), " ".join(["other", *w[2:]])]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    assert got == {k: brute_licenses(x) for k, x in enumerate(texts)}


def test_needed_words_are_needed():
    for x in license_scan.TEMPLATES.values():
        shingles, words = license_scan.template_shingles(x), license_scan.needed_words(x)
        assert sum(any(w in s.split() for w in words) for s in shingles) > 0.2 * len(shingles)
    assert (1 - license_scan.JACCARD) ** license_scan.BANDS < 1e-4


# Awkward tables


def everything(docs, trusted):
    path, ranks = queries.tokenizer_path(), queries.tokenizer_path("byte_bpe_50k.tiktoken")
    return {
        "op1": kneser_ney.classify(docs, trusted),
        "op2": media.document_media(docs),
        "op3": suffix_dedup.removed(docs),
        "op4": quality_rules.judge(docs, trusted),
        "op7": mixing.mix(docs),
        "op8": bpe.round_trip(docs, path),
        "op9": simhash.near_duplicates(docs),
        "op10": license_scan.scan(docs),
        "op5": packing.packed(docs, ranks),
    }


def test_awkward_rows_all_have_a_result(spark):
    docs = awkward(spark)
    n = docs.count()
    out = everything(docs, labels(spark))
    for name, df in out.items():
        if name != "op5":
            assert df.count() == n, name
    pieces = packing.unpacked(out["op5"]).where("piece = 0").collect()
    assert len(pieces) == n and sum(r.doc_id is None for r in pieces) == 1
    got = {r.doc_id: r for r in out["op3"].collect()}
    assert got[5].n_removed == got[5].n_bytes and got[6].n_removed < got[6].n_bytes and got[1].n_bytes == 0
    assert {r.doc_id: r.n_licenses for r in out["op10"].collect()}[10] == 1


def test_awkward_rows_keep_their_columns(spark):
    docs = awkward(spark)
    for df in (quality_rules.accepted(docs, labels(spark)), suffix_dedup.cleaned(docs), simhash.representatives(docs), mixing.mixed(docs)):
        assert df.columns == docs.columns
        rows = df.collect()
        assert rows and all(r["k1"] == r["spans"] == r["_size"] == r["w"] == 7 for r in rows)
    cleaned = {r.doc_id: r.text for r in suffix_dedup.cleaned(docs).collect()}
    assert cleaned[5] == "" and cleaned[6].startswith("before") and cleaned[1] is None and cleaned[4] == {r.doc_id: r.text for r in docs.collect()}[4]


def test_empty_tables(spark):
    for name, df in everything(empty(spark), labels(spark, [])).items():
        assert df.count() == 0, name
    for df in (quality_rules.accepted(empty(spark), labels(spark)), suffix_dedup.cleaned(empty(spark)), simhash.representatives(empty(spark)), mixing.mixed(empty(spark))):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judged(pages, url_filter.rules_table(spark)).count() == 0
    assert media.sequences(pages).count() == 0


def test_no_trusted_text(spark):
    docs = awkward(spark)
    assert all(r.kept or not words_of(r.lang) or r.n_words == 0 for r in kneser_ney.classify(docs, labels(spark, [])).collect())
    assert all(r.score == 0 for r in quality_rules.judge(docs, labels(spark, [])).collect())
