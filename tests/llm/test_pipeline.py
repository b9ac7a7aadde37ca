"""The pipeline's stages in order, each on what its predecessor kept."""

import collections
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices(["ba", "ko", "ti", "re", "su", "na"], k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(150)
    rows = [(k, text(120), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100 + k, f"{text(60)} {passage} {text(60)}", "en", "s0", 1) for k in range(4)]  # a shared passage
    rows += [(200, rows[5][1], "en", "s1", 1), (201, "xx yy zz ww vv " * 20, "en", "s1", 1), (202, "short", "en", "s1", 1), (203, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    a = corpus_pipeline.quality(spark, docs, path)
    assert a.columns == docs.columns and not ids(a) & {201, 202, 203} and set(range(60)) <= ids(a)
    b = corpus_pipeline.near_dedup(spark, a, path)
    assert 5 in ids(b) and 200 not in ids(b)
    c = corpus_pipeline.substring_dedup(spark, b, path)
    texts = {r.doc_id: (r.text, r.n_chars) for r in c.collect()}
    assert all(passage not in texts[100 + k][0] and texts[100 + k][0] for k in range(4) if 100 + k in texts)
    assert all(len(t) == n for t, n in texts.values())
    d = corpus_pipeline.mix(spark, c, path)
    assert d.columns == docs.columns and max(collections.Counter(r.doc_id for r in d.collect()).values()) <= 2
    e = corpus_pipeline.encode(spark, d, path)
    assert e.count() == d.count()
    assert corpus_pipeline.run(spark, path).count() == e.count()


def brute_quality(rows, trusted):
    """Stage 1 in plain Python: base rules, and log ratios with the text itself left out."""
    from docloom.llm import quality_rules as rules
    from docloom.llm.blocks import mixed

    def hashed(words):
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        return [x for part in (h * rules._UNIGRAM, mixed(h[:-1], h[1:])) for x in rules.buckets(part, rules.BUCKETS).tolist()]

    grams = {k: collections.Counter(hashed((r[1] or "").encode().split())) for k, r in enumerate(rows)}
    raw, target = collections.Counter(), collections.Counter()
    for k, r in enumerate(rows):
        raw.update(grams[k])
        if r[0] in trusted:
            target.update(grams[k])

    def score(k, good):
        own = grams[k]
        r, t = raw.total() - own.total(), target.total() - own.total() * good
        if r <= 0 or t <= 0:
            return 0
        return sum(n * round(math.log((target[b] - n * good + rules.PSEUDO) / ((raw[b] - n) * (t / r) + rules.PSEUDO)) * rules.UNIT) for b, n in own.items())

    steps = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] in trusted and grams[k]:
            steps[r[2]].append(score(k, True) * 1000 // (grams[k].total() * rules.UNIT))

    def least(found):
        found = sorted(found)
        at = next((x for n, x in enumerate(found, 1) if sum(y <= x for y in found) > len(found) * rules.QUANTILE), None)
        return min(math.floor(rules.THRESHOLD * rules.UNIT), rules.UNIT if at is None else at * rules.UNIT // 1000)

    other = least([x for v in steps.values() for x in v])
    kept = []
    for k, r in enumerate(rows):
        words = (r[1] or "").split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = collections.Counter(windows)
        repeated = len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)})
        bad = len(words) < 10 or 100 * repeated > 20 * len(words)
        limit = least(steps[r[2]]) if len(steps.get(r[2], ())) >= rules.ENOUGH else other
        if not bad and score(k, r[0] in trusted) >= limit * grams[k].total():
            kept.append(r)
    return kept


def brute_near(rows):
    from xxhash import xxh64_intdigest

    prints = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if x == a else x for x in group]
    first = {}
    for r, g in zip(rows, group):
        first[g] = min(first.get(g, r), r, key=lambda x: x[0])
    return list(first.values())


def brute_repeats(rows):
    data = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(d[p : p + 400] for d in data for p in range(len(d) - 399))
    out = []
    for r, d in zip(rows, data):
        gone = set()
        for p in range(len(d) - 399):
            if seen[d[p : p + 400]] > 1:
                gone.update(range(p, p + 400))
        text = bytes(x for k, x in enumerate(d) if k not in gone).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def brute_mix(rows):
    from xxhash import xxh64_intdigest

    from docloom.llm import mixing

    size = [len((r[1] or "").split()) for r in rows]
    sources = sorted({r[3] for r in rows})
    sizes = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    left, active, target = 1.5 * sum(sizes.values()), set(sources), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    while active:
        over = {s for s in active if weight[s] * left / sum(weight[x] for x in active) > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * left / sum(weight[x] for x in active) for s in active}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        active -= over
    out = []
    for s in sources:
        own = [(r, n) for r, n in zip(rows, size) if r[3] == s]
        at = lambda r: xxh64_intdigest(struct.pack("<q", r[0]), xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)) >> 1
        own.sort(key=lambda x: at(x[0]))
        times, rest = divmod(round(target[s]), sizes[s])
        extra, open_rows = set(), True
        for r, n in own:
            if open_rows and rest and n <= rest:
                extra.add(r[0])
                rest -= n
            else:
                open_rows = False
        for _ in range(mixing.EXTRA):
            fits = [(n, at(r), r[0]) for r, n in own if r[0] not in extra and 0 < n <= rest]
            if fits:
                n, _, k = max(fits)
                extra.add(k)
                rest -= n
        for r, _ in own:
            out += [r] * (times + (r[0] in extra))
    return out


def test_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    from docloom.llm.queries import tokenizer_path

    path, _ = folder
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/documents.parquet").collect()))
    rows = brute_mix(brute_repeats(brute_near(brute_quality(rows, set(range(40))))))
    coder = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in rows:
        ids = coder.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("few", [48, 2])
def test_near_dedup_takes_four_fifths_of_five_word_shingles(spark, monkeypatch, few):
    from docloom.llm import simhash

    # With buckets of over two members taken in chunks, and as they are.
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "MANY", min(few, 3) if few < 48 else simhash.MANY)
    rng = random.Random(41)
    text = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(text)]
    for k, w in enumerate(text):  # n words changed apart: each takes five shingles
        for n in range(1, 7):
            rows.append((100 * n + k, " ".join("new" if i % 30 == 10 and i < 30 * n else x for i, x in enumerate(w))))
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for _, x in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if x == a else x for x in group]
    want = {}
    for r, g in zip(rows, group):
        want[g] = min(want.get(g, r[0]), r[0])
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], DOCS)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want.values()) and len(want) < len(rows)


def test_empty_table_and_clashing_columns(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clash = docs.withColumns({c: F.lit(7) for c in ("row", "kept", "block", "print", "bucket", "node", "spans", "size", "taken")})
    for k, (table, n) in enumerate(((docs.limit(0), 0), (clash, None))):
        at = f"{tmp_path}/{k}"
        table.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at)
        want = corpus_pipeline.run(spark, path)
        assert out.columns == want.columns
        assert out.count() == (want.count() if n is None else n)


def test_near_dedup_groups_by_fingerprints(spark):
    """Texts of one fingerprint are one group though they share no five words in a row."""
    docs = spark.createDataFrame([(7, "w w w"), (3, "w w w w w w"), (5, "something else is written here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [3, 5]
    assert any("SimHash" in name for name, stage in corpus_pipeline.STAGES if stage is corpus_pipeline.near_dedup)


def test_shard_sums_take_little_memory():
    """A shard of the quality rules' counts is summed in a fraction of the memory that all its columns would take at once."""
    import tracemalloc

    import pyarrow as pa

    from docloom.llm import quality_rules
    from docloom.llm.blocks import narrow, widened

    class Caught:  # stands for the counts: takes the function that Spark would run
        def groupBy(self, *_):
            return self

        def applyInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(3)
    each = [np.unique(rng.integers(0, 3_000_000, 500_000)) for _ in range(4)]
    raw, target = ([rng.integers(0, most, len(x)) for x in each] for most in (9, 3))
    columns = {"block": range(4), "checksum": range(4), "shard": [0] * 4, "size": map(len, each), "keys": (narrow(np.diff(x, prepend=0)) for x in each), "raw": map(narrow, raw), "target": map(narrow, target)}
    table = pa.table({k: pa.array(list(v)) for k, v in columns.items()})
    tracemalloc.start()
    out = quality_rules.shard_sums(Caught())(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for name, own in (("raw", raw), ("target", target)):
        total = np.zeros(3_000_000, np.int64)
        for x, n in zip(each, own):
            total[x] += n
        for x, n, got in zip(each, own, out.column(name).to_pylist()):
            assert np.array_equal(widened(got, len(x)), total[x] - n)
    assert peak < 40 * sum(map(len, each))
