"""Cuckoo index, prefix trie and fill-in-middle against brute force, on small fixtures and the smallest tables; wrong spans and bounds of samples."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tripflow.llm import cuckoo_index, fill_in_middle, license_scan, pairwise_quality, ppm_language, prefix_trie, queries, suffix_dedup
from tripflow.llm._spark import Tables

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a  b", "a\tb", "a b ", "é\n", "x" * 30_000, "one two three\n" * 5_000, "ends <P> here", "<S", "<S" * 9, "same\nsame", "same\nsame", "same same"]


@pytest.mark.parametrize("name", ["op11_cuckoo_dedup", "op12_prefix_trie", "op13_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, found.select(*names).collect())) == Counter(expected)


# Cuckoo index.

def test_filter():
    rng = random.Random(5)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(20_000)]
    f, held, grown = cuckoo_index.CuckooFilter(), [], 0
    for k in keys:
        held.append(k)
        if not f.add(k):
            f, grown = f.grown(held), grown + 1
    assert grown >= 5 and all(k in f for k in keys)
    for k in keys[:15_000]:
        f.discard(k)
    assert all(k in f for k in keys[15_000:])
    assert sum(k in f for k in keys[:15_000]) < 50
    assert sum(map(bool, f.slots)) == 5_000


def classes_of(rows):
    """(key, keep, size, sha256) of brute force, as a multiset, and the number of different texts."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    out = Counter()
    for t, ks in groups.items():
        least = min((k for k in ks if k is not None), default=None)
        out.update((k, least, len(ks), hashlib.sha256(t.encode()).hexdigest()) for k in ks)
    return out, groups


def check_classes(frame, rows):
    expected, groups = classes_of(rows)
    found = frame.collect()
    assert Counter((r.key, r.keep_id, r.group_size, r.sha256) for r in found) == expected
    stay = [r for r in found if r.kept]
    assert Counter(r.sha256 for r in stay) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.key == r.keep_id for r in stay)


def weak(c):
    """A digest with many collisions."""
    return F.pmod(F.xxhash64(c), F.lit(7)).cast("long")


@pytest.mark.parametrize("digest", [F.xxhash64, weak])
def test_index_inserts_and_deletes(spark, digest):
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(150)]]
    rows = [(rng.choice([None, *range(120)]), t) for t in texts + texts[:40] + ["hot text"] * 90]
    rows += rows[:10]
    frame = lambda part: spark.createDataFrame([(k, t, 1, 2) for k, t in part], "doc_id long, text string, digest int, row int")
    index = cuckoo_index.CuckooIndex(Tables(spark, "test"), 3, digest)
    index.insert(frame(rows[:100]))
    index.insert(frame(rows[100:]))
    check_classes(index.classes(), rows)
    gone = set(range(0, 120, 3))
    index.delete(spark.createDataFrame([(k,) for k in (*gone, None, 10**9)], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    check_classes(index.classes(), left)
    index.insert(frame(rows[:30]))
    check_classes(index.classes(), left + rows[:30])
    slots = index.state.where("kind = 0").collect()
    live = index.state.where("kind = 1").count()
    assert sum(sum(map(bool, cuckoo_index.array("H", bytes(r.slots)))) for r in slots) == live == index.rows.select("digest").distinct().count()


def test_index_grows_parts_and_filters(spark):
    index = cuckoo_index.CuckooIndex(Tables(spark, "test"), 1)
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2_500).cast("string").alias("text"))
    index.insert(docs)
    assert max(len(r.slots) for r in index.state.where("kind = 0").collect()) > 2 * 4 * 64
    index._resize(digests=500)
    assert index.parts == 6 and index.state.where("kind = 0").count() == 6
    index.insert(docs)
    assert index.classes().where("kept").count() == 2_500
    assert index.classes().where("group_size = 4").count() == 2_000


def test_dedup_of_nothing(spark):
    assert cuckoo_index.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Prefix trie.

def trie_of(conversations):
    """Nodes by brute force: paths as tuples."""
    convs = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - c % 20, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in sorted(rebuilt.items()):
        ends[tuple(ts)].append(c)
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(cs) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return Counter((cs[0], len(n), members[n[:-1]][0] if n else None, len(cs), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, cs in members.items())


def trie_rows(spark, rows, tmp_path, monkeypatch):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "RANGE", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    rng = random.Random(seed)
    text = lambda: rng.choice(["a", "b c", "", None, "d  e\nf", "é"])
    rows = [(c, t, rng.choice(["user", None]), text()) for c in rng.sample(range(1, 200), 60) for t in range(rng.randint(1, 3))]
    rows += [(c, t, "user", f"shared {t}") for c in range(400, 460) for t in range(rng.choice([9, 10, 11]))]
    rows += [(c, t, "user", f"shared {t}" if t < 5 else "other") for c in range(500, 520) for t in range(8)]
    rows += [(701, t, "user", f"long {t % 3}") for t in range(60)] + [(None, 1, "user", "lost"), (603, None, "user", "first"), (603, 5, None, None), (603, 5, None, None), (603, 5, "z", "tie")]
    rng.shuffle(rows)
    assert trie_rows(spark, rows, tmp_path, monkeypatch) == trie_of(rows)


def test_trie_of_little(spark, tmp_path, monkeypatch):
    turnless = [(c, 0, "user", "only") for c in range(21, 40)]  # their head, 20, isn't there
    assert trie_rows(spark, turnless, tmp_path / "a", monkeypatch) == trie_of(turnless)
    assert trie_rows(spark, [], tmp_path / "b", monkeypatch) == trie_of([]) == Counter()


# Fill-in-middle.

def fim(name, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"7:{name}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in fill_in_middle.MARKERS):
        return len(lines), "plain", None, None, t
    a, b = sorted(v % (len(lines) + 1) for v in h[:2])
    p, m, s = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("memo", [8 << 20, 1])
def test_fill_in_middle(spark, memo):
    rng = random.Random(8)
    long = "".join(rng.choice("abé <P\n") for _ in range(60_000))
    texts = [*ODD, long.replace("<P>", ""), "start\n" + long, long[:9_000] + "<S>" + long, *["\n".join(rng.choice(["x", "", "<M", "é é"]) for _ in range(rng.randint(1, 9))) for _ in range(200)]]
    rows = [(None if i % 17 == 5 else i % 150, t) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame([(k, t, 3, "x") for k, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    made = fill_in_middle.transform(docs, memo_bytes=memo).withColumn("back", fill_in_middle.restored()).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == Counter((k, *fim("null" if k is None else k, t)) for k, t in rows)
    assert Counter(r.back for r in made) == Counter(t or "" for _, t in rows)
    assert fill_in_middle.transform(docs.where("false")).count() == 0


def test_chunks_follow_content():
    import numpy as np

    rng = np.random.default_rng(4)
    body = rng.integers(32, 127, 200_000, dtype=np.uint8)
    text = np.concatenate([rng.integers(32, 127, 777, dtype=np.uint8), body])
    data, offsets = np.concatenate([body, text]), np.array([0, 0, len(body), len(body) + len(text)])
    at = fill_in_middle.chunk_bounds(data, offsets, step=5_000)
    assert np.array_equal(at, fill_in_middle.chunk_bounds(data, offsets)) and set(offsets) <= set(at) and max(np.diff(at)) <= fill_in_middle.MOST
    chunks = [data[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
    repeats = sum(len(c) * (n - 1) for c, n in Counter(chunks).items())
    assert repeats > 0.9 * len(body)


# Passages that differ in one word, and samples of rows whose ids say nothing.

@pytest.mark.parametrize("hot", [100_000, 1_000])
def test_no_spans_where_nothing_repeats(spark, hot):
    """49 words that all texts share and one of their own: no passage of 50 words occurs twice."""
    shared = " ".join(f"w{i}" for i in range(49))
    for text in (F.concat(F.lit(shared + " own"), F.col("id")), F.concat(F.lit("own"), F.col("id"), F.lit(" " + shared))):
        docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"))
        assert suffix_dedup.spans(docs, hot_rows=hot).count() == 0


def test_samples_of_rows_without_ids(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    assert 850 < ppm_language.drawn(rows).count() < 1_150
    same = rows.withColumn("text", F.lit("one text"))
    assert ppm_language.drawn(same).count() <= 1 and ppm_language.drawn(same, 20_000).count() == 1
    repeated = rows.withColumn("doc_id", F.lit(7).cast("long"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert 850 < pairwise_quality.drawn(repeated, labels, 1_000).count() < 1_150
    assert pairwise_quality.drawn(rows, labels).count() == 0


# Licence notices inside other text.

def slow_runs(text, templates, t=0.8):
    """Kept runs (license, start, end, dice) by all pairs of starts and ends."""
    grams = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    w = re.findall("[a-z0-9]+", (text or "").lower())
    runs = set()
    for name, body in templates:
        want = grams(re.findall("[a-z0-9]+", body.lower()))
        for s in range(len(w)):
            found = []
            for e in range(s + 2, min(len(w), s + len(want) * 3 // 2 + 1) + 1):
                have = grams(w[s:e])
                if " ".join(w[s : s + 2]) in want and " ".join(w[e - 2 : e]) in want:
                    found.append((-2 * len(have & want) / (len(have) + len(want)), e))
            if found and min(found)[0] <= -t:
                runs.add((name, s, min(found)[1], -min(found)[0]))
    order = lambda x: (-x[3], x[1] - x[2], x[0], x[1])
    return {x for x in runs if not any(order(y) < order(x) and y[1] < x[2] and x[1] < y[2] for y in runs)}


def test_all_runs(spark):
    rng = random.Random(6)
    templates = {"A": ["use of this source code is governed by a style license", "licensed under the a license"], "B": ["licensed under the b license", "licensed under the b license version two of it"]}
    flat = [(k, t) for k, ts in templates.items() for t in ts]
    words = sorted({w for _, t in flat for w in t.split()}) + ["x", "y"]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    for _, t in flat * 12:  # notices with words put in, left out and repeated, one after the other
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.randint(0, len(w)), rng.choice(words))
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 5)), *w, *(w if rng.random() < 0.4 else []), *rng.choices(words, k=3)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.window_dice, r.n_windows) for r in license_scan.scan(docs, templates, windows=True).where("n_windows > 0").collect()}
    want = defaultdict(list)
    for i, text in enumerate(texts):
        for name, *_, dice in slow_runs(text, flat):
            want[i, name].append(dice)
    assert got == {k: (max(v), len(v)) for k, v in want.items()} and len(got) > 30


def test_a_notice_with_words_put_in(spark):
    text = "As said in its files, use of this source code is (as amended here) governed by a BSD-style license that can be found in the LICENSE file. And so on."
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), windows=True).collect()
    assert [(r.license, r.window_dice, r.n_windows, r.n_units) for r in found] == [("BSD-3-Clause", 2 * 18 / 41, 1, 0)]
