"""Each operator against a brute-force version, on texts with every odd case."""

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, license_scan, lm, minhash, mixing, quality, rules, text, topk, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t, lower=True):
    return WORD.findall((t or "").translate(LOW) if lower else t or "")


def by_row(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_and_hashes():
    raw = "Ab\x0bc  é\xa0x\n" * 3 + "z"
    buf = np.frombuffer(raw.encode(), np.uint8)
    t = text.Texts(buf, np.array([0, 4, 4, len(buf)]))
    s, e, w = t.words()
    got = [bytes(buf[a:b]).decode() for a, b in zip(s, e)]
    assert got == words(raw[:4], False) + words(raw[4:], False)
    assert list(np.diff(w)) == [2, 0, len(got) - 2]
    h = t.hashes(s, e)
    names = [x.translate(LOW) for x in got]
    assert all((h[i] == h[j]) == (names[i] == names[j]) for i in range(len(h)) for j in range(len(h)))


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_against_all_pairs(docs, rows, n):
    sets = []
    for i, t, _ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    want = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        comp = min(ids) if ids else i
        want.append((i, len(sets[a]), comp, i is None or i == comp))
    got = minhash.near_duplicates(docs, n=n).select("doc_id", "n_shingles", "component_id", "kept")
    assert by_row(got) == sorted(want, key=str)


def test_minhash_links_large_groups_in_blocks(spark, monkeypatch):
    """A group around one text whose members are often not linked with each other."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.choice(100, 6, replace=False):
            w[at] = f"e{k}x{at}"
        texts.append(" ".join(w))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    parent = list(range(60))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, n=2).collect()}
    assert got == {k: find(k) for k in range(60)}


def test_minhash_small_texts_of_a_long_list_meet_every_large_component(spark):
    """Two large components and over BLOCK // 8 small ones in one posting list, against all pairs of a list."""
    rng = np.random.default_rng(8)
    texts, lists = [], collections.defaultdict(list)

    def edited(words, *at):
        return [f"e{len(texts)}x{k}" if k in at else w for k, w in enumerate(words)]

    def add(words, *toks):
        for tok in toks:
            lists[tok].append(len(texts))
        texts.append(words)

    for c in range(2):
        base = [f"b{c}w{k}" for k in range(104)]
        toks = [100 + 10 * c + k for k in range(6)]
        add(base, *toks)
        for k, tok in enumerate(toks):
            member = edited(base, 10 + 12 * k, 16 + 12 * k)
            add(member, tok, 1)
            # near this member only: too far from the text in the middle and from the others
            add(edited(member, 90, 96), 1)
    for k in range(40):
        add([f"s{k}w{rng.integers(1000)}" for _ in range(50)], 1)
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for members in lists.values():
        for a in members:
            for b in members:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[find(b)] = find(a)
    groups = collections.defaultdict(set)
    for k in range(len(texts)):
        groups[find(k)].add(k)
    assert sorted(map(len, groups.values()))[-3:] == [1, 13, 13]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    nodes = minhash.signatures(df, 5).cache()
    node = {r.doc_id: r.node for r in nodes.select("doc_id", "node").collect()}
    posts = spark.createDataFrame([(tok, node[k]) for tok, ks in lists.items() for k in ks], "tok long, node long")
    sets_ = minhash.Sets(df, nodes.select("node", "text_key"), 5)
    got = {r.node: r.c for r in minhash.link(posts, nodes.select("node", "sig", F.col("n_shingles").alias("n")), sets_, minhash.MATCHES, 80).collect()}
    found = collections.defaultdict(set)
    for k, x in node.items():
        found[got.get(x, x)].add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_block_links_equals_brute_force():
    rng = np.random.default_rng(1)
    side = [{"node": k, "c": k % 7, "sig": list(rng.integers(0, 3, 64)), "items": sorted(set(rng.integers(0, 12, 10).tolist()))} for k in range(40)]
    kind = pa.struct([("node", pa.int64()), ("c", pa.int64()), ("sig", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
    made = pa.array([{**x, "sig": [int(y) for y in x["sig"]]} for x in side], kind)
    left, right = minhash.Side.of(made[:20]), minhash.Side.of(made[20:])
    got = set(minhash.block_links(left, right, 20, 60, False))
    want = set()
    for a in side[:20]:
        for b in side[20:]:
            i, u = len(set(a["items"]) & set(b["items"])), len(set(a["items"]) | set(b["items"]))
            if a["c"] != b["c"] and sum(x == y for x, y in zip(a["sig"], b["sig"])) >= 20 and 100 * i >= 60 * u:
                want.add((a["node"], b["node"]))
    assert got == want
    assert {a for a, _ in minhash.block_links(left, right, 20, 60, True)} == {a for a, _ in want}


def test_minhash_links_through_null_ids(spark):
    """1 - null - 3: the text in the middle has no id, and no other link joins the ends."""
    base = [f"w{k}" for k in range(200)]
    edit = lambda w, *at: [f"e{k}" if k in at else x for k, x in enumerate(w)]
    mid = edit(base, 20, 50, 80)
    df = spark.createDataFrame([(1, " ".join(base)), (None, " ".join(mid)), (3, " ".join(edit(mid, 110, 140, 170)))], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, n=5).select("doc_id", "component_id").collect()), key=str)
    sets = [set(zip(*(t[k:] for k in range(5)))) for t in (base, mid, edit(mid, 110, 140, 170))]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    assert got == [(1, 1), (3, 1), (None, 1)]


def test_minhash_links_against_union_find(spark, monkeypatch):
    """Chains, large components and common passages, with every join's frequent keys and blocks made small."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 1200)
    monkeypatch.setattr(common, "HEAVY", 3)
    rng = np.random.default_rng(12)
    common_part = [f"c{k}" for k in range(90)]
    texts = []
    for c in range(5):
        base = [*common_part, *(f"b{c}w{k}" for k in range(40))]
        chain = base
        for k in range(16):
            chain = [f"e{len(texts)}x{i}" if i in at else w for at in [set(rng.choice(len(base), 2, replace=False).tolist())] for i, w in enumerate(chain if k % 2 else base)]
            texts.append(" ".join(chain))
    texts += [" ".join([*common_part[:60], *(f"s{k}w{i}" for i in range(rng.integers(10, 60)))]) for k in range(50)]
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, n=2).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_license_spans(docs, rows):
    got = {(r.doc_id, r.license): (r.coverage, r.span_start, r.span_end) for r in license_scan.scan(docs).collect()}
    t = dict((i, t) for i, t, _ in rows)[12]
    assert set(got) == {(12, "all-rights-reserved"), (12, "apache-2.0")}
    assert got[12, "all-rights-reserved"] == (1.0, 0, t.index("reserved") + len("reserved"))
    assert t[got[12, "apache-2.0"][1] :].startswith("Licensed under")


def test_license_with_edits(spark):
    words_ = license_scan.TEMPLATES["mit-grant"].split()
    words_[8] = "CHANGED"
    del words_[20]
    df = spark.createDataFrame([(1, "intro words here " + " ".join(words_) + " and more")], "doc_id long, text string")
    (r,) = license_scan.scan(df).collect()
    assert r.license == "mit-grant" and 0.8 <= r.coverage < 1 and r.span_start == len("intro words here ")


def test_license_notices_side_by_side(spark):
    df = spark.createDataFrame([(1, "All rights reserved. All rights reserved.\nall RIGHTS reserved"), (2, "Released under the OLD License. Released the MIT License.")], "doc_id long, text string")
    got = [(r.doc_id, r.license, r.matched, r.span_start) for r in license_scan.scan(df).orderBy("doc_id", "span_start").collect()]
    assert got == [(1, "all-rights-reserved", 3, 0), (1, "all-rights-reserved", 3, 21), (1, "all-rights-reserved", 3, 42), (2, "mit", 4, 0), (2, "mit", 4, 32)]


def test_license_recall_against_full_alignment():
    """Every template with random words changed, left out or put in, against an alignment of all words (no index, no band)."""
    rng = np.random.default_rng(7)
    index = license_scan.Index(license_scan.TEMPLATES)
    word = re.compile(r"[A-Za-z0-9\x80-\uffff]+")

    def common_words(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    wanted = found = 0
    for k, (name, template) in enumerate(license_scan.TEMPLATES.items()):
        tpl = word.findall(template.lower())
        for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
            w = list(tpl)
            for at in rng.choice(len(w), int(share * len(w)), replace=False):
                w[at] = str(rng.choice(["", "other", f"{w[at]} more"]))
            w = " ".join(w).split()
            raw = " ".join([*(f"f{i}" for i in range(30)), *w, *(f"g{i}" for i in range(30))])
            buf = np.frombuffer(raw.encode(), np.uint8)
            hits = [x for x in license_scan.scan_piece(text.Texts(buf, np.array([0, len(buf)])), index, license_scan.LEAST) if x[1] == k]
            true = common_words(tpl, w) >= license_scan.LEAST * len(tpl)
            wanted += true
            found += true and len(hits) == 1
            assert true or not hits, (name, share)
    assert wanted > 80 and found >= 0.95 * wanted, (found, wanted)


def test_rule_statistics(docs, rows):
    def brute(t):
        w, seen, dup, marked = words(t, False), set(), 0, set()
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                marked.update(range(i, i + 8))
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(marked)

    got = rules.judge(docs, "true").select("doc_id", *rules.STATS[:5])
    assert by_row(got) == sorted([(i, *brute(t)) for i, t, _ in rows], key=str)


def test_decision_list_learns_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(rules.RATIOS)))
    bad = (x[:, 0] > 0.7) & (x[:, 3] <= 0.5) | (x[:, 5] > 0.9)
    found = rules.learn(x, bad)
    cover = np.zeros(600, bool)
    for r in found:
        cover |= rules._covers(r, x)
    assert (cover == bad).mean() > 0.96
    assert rules.expression(found).startswith("(CASE WHEN ") and rules.expression([]) == "true"


def test_lm_base_scores_and_model(docs, rows, spark):
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) == 2
    got = lm.lm_scores(docs, held).collect()
    mark = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    c = collections.Counter(w for (_, t, _), m in zip(rows, mark) if not m for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for (i, t, _), m in zip(rows, mark):
        w = [*words(t), None]
        want[(i, m, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e7 < r.score < 0 for r in got)


def test_lm_is_a_distribution_and_windows_score_each_id_once():
    rng = np.random.default_rng(2)
    counts = np.zeros(lm.IDS)
    counts[:200] = rng.integers(1, 90, 200)
    m = lm.Model(*lm.class_of(counts))
    pairs = rng.integers(0, 5, (lm.IDS, lm.CLASSES)).astype(float)
    m.counted(counts, pairs, rng.integers(0, 3, (lm.TOP, lm.TOP)).astype(float))
    m.train([rng.integers(0, 200, 150) for _ in range(4)], epochs=1)
    x = np.tile(rng.integers(0, 200, lm.WIDTH), (1, 1))
    z = m.attend(x)[4][:, -1] @ m.wo + m.bigram[x[:, -1]]
    p = np.exp(z - np.log(np.exp(z).sum()))
    assert abs(p.sum() - 1) < 1e-4
    ids = rng.integers(0, 200, 90)
    whole = m.score(np.concatenate([ids, ids[:3]]), np.array([0, 90, 90, 93]))
    full = np.concatenate([[lm.BOS], ids, [lm.EOS]])
    total = 0.0
    for k in range(len(full) - 1):
        # the window that scores place k
        start = 0 if k < lm.WIDTH else lm.STEP * ((k - lm.WIDTH) // lm.STEP + 1)
        w = np.resize(full[start : start + lm.WIDTH], lm.WIDTH)
        total += m.log_probs(w[None, :], np.full((1, lm.WIDTH), full[k + 1]), k - start)[0]
    assert abs(whole[0] - total / np.log(10)) < 1e-3
    assert whole[1] < 0 and len(whole) == 3


def test_lm_learns_from_all_texts(spark, monkeypatch):
    """Ranks are those of the whole corpus; windows reach the ends of long texts and grow in number with the input."""
    took = []
    train = lm.trained

    def trained(tables, model, groups):
        got = tables.where("base = 2").select("g", "id_n").collect()
        rows = np.concatenate([np.frombuffer(r.id_n, np.uint16).reshape(-1, lm.WIDTH + 2) for r in got])
        before = model.flat()
        train(tables, model, groups)
        took.append((model.rank, rows[:, :-1], rows[:, -1].astype(int), groups, len({r.g for r in got}), np.abs(model.flat() - before).max()))

    monkeypatch.setattr(lm, "trained", trained)
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 64)
    monkeypatch.setattr(lm, "EVERY", 4)
    monkeypatch.setattr(lm, "GROUP", 400)
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "EPOCHS", 1)
    # 600 texts of which some alone have a frequent word; long ones end in another
    rows = [(k, "one two three four " * 20 + ("zebra " * 300 if k % 40 == 0 else "")) for k in range(600)]
    rows += [(1000 + k, "one two " * 1500 + "apple " * 200) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    codec = bpe.codec(bpe.vocabulary_path())
    for part in (df.where("doc_id < 300"), df):
        lm.lm_scores(part, F.lit(False)).count()
    texts = []
    for _, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        urow, _ = codec.rows(text.Texts(raw, np.array([0, len(raw)])))
        texts.append(bpe.gather(codec.ids, codec.id_end, urow)[0].astype(np.int64))
    counts = np.bincount(np.concatenate([*texts, np.full(len(texts), lm.EOS)]), minlength=lm.IDS)
    rank, w, n, groups, dealt, moved = took[1]
    assert groups == dealt > took[0][3] and 0.01 < moved < 5
    assert (rank == np.minimum(lm.class_of(counts)[1], lm.TOP)).all()
    total = sum(-(-(len(t) + 1) // lm.WIDTH) for t in texts)
    assert abs(len(w) - (64 + total / 4)) < 0.2 * (64 + total / 4) and len(w) > 1.5 * len(took[0][1])
    # the ends of long texts are drawn, and a text's end is only where it ends
    assert (w[:, 0] == texts[-1][-1]).any()
    ends = [(row[: k + 1] == lm.EOS).nonzero()[0] for row, k in zip(w, n)]
    last = {t[-1] for t in texts}
    assert all(len(at) == 0 or (len(at) == 1 and at[0] == k and row[k - 1] in last) for at, row, k in zip(ends, w, n) if k > 0)


def test_lm_sums_counts_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 100)
    monkeypatch.setattr(lm, "FAN", 2)
    rng = np.random.default_rng(3)
    rows, want = [], collections.Counter()
    for k in range(9):
        key = np.sort(rng.choice(1000, 60, replace=False)).astype(np.uint64)
        n = rng.integers(1, 2**40, 60)
        rows.append((k % 2, bytearray(key.tobytes()), bytearray(n.tobytes())))
        want.update({(k % 2, int(x)): int(c) for x, c in zip(key, n)})
    got = lm.summed(spark.createDataFrame(rows, "base long, id_key binary, id_n binary").repartition(5))
    pairs = [((r.base, int(x)), int(c)) for r in got for x, c in zip(np.frombuffer(r.id_key, np.uint64), np.frombuffer(r.id_n, np.int64))]
    assert dict(pairs) == want and len(pairs) == len(want)


def test_lm_empty(empty):
    assert lm.lm_scores(empty, F.lit(False)).count() == 0


def _toxic(spark, n=400):
    rng = np.random.default_rng(4)
    clean = [f"w{k}" for k in range(300)]
    rows, lab = [], []
    for k in range(n):
        w = list(rng.choice(clean, rng.integers(5, 90)))
        y = k % 4 == 0
        if y:
            for at in rng.choice(len(w), min(3, len(w)), replace=False):
                w[at] = str(rng.choice(["vile", "nasty", "zorg" + str(rng.choice(clean))]))
        rows.append((k, " ".join(w)))
        lab.append((k, int(not y), int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), np.array([x[2] for x in lab])


def test_toxicity_held_out(spark, docs, empty):
    d, lab, y = _toxic(spark)
    net = toxicity.fit(d, lab, F.col("doc_id") < 250)
    got = {r.doc_id: r.score for r in toxicity.score(d, net).collect()}
    pred = np.array([got[k] >= 0.5 for k in range(len(y))])
    assert (pred[250:] == y[250:]).mean() > 0.9
    odd = toxicity.score(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, net).count() == 0 and toxicity.keep(docs, net).columns == docs.columns


def test_toxicity_learns_from_whole_long_texts(spark):
    """A short passage anywhere in a long text, where 24 evenly spaced stretches of 32 words would miss it."""
    rng = np.random.default_rng(6)
    clean = [f"{a}{b}" for a in ("lo", "mi", "ra", "tu", "se") for b in ("ban", "dor", "fel", "gim", "hup", "kin", "lat", "mon", "pes", "rix")]
    at = np.linspace(0, 1600 - 32, 24).astype(int)
    rows, lab = [], []
    for k in range(160):
        w = list(rng.choice(clean, 1600))
        if k % 4 == 0:
            start = at[rng.integers(0, 23)] + 45
            w[start : start + 10] = rng.choice(["vile", "nasty", "zorgish"], 10)
        rows.append((k, " ".join(w)))
        lab.append((k, int(k % 4 == 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), np.array([x[1] for x in lab])
    net = toxicity.fit(d, spark.createDataFrame(lab, "doc_id long, toxic int"), F.col("doc_id") < 100)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(d, net).collect()}
    assert (np.array([got[k] for k in range(100, 160)]) == y[100:]).mean() > 0.95
    # a bound on words takes fewer texts, and those whole
    took, train = [], toxicity.train
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "train", lambda texts: took.extend(texts) or train(texts[:2], epochs=1))
        toxicity.fit(d, spark.createDataFrame(lab, "doc_id long, toxic int"), F.col("doc_id") < 100, words=8000)
    assert [len(x) for x, _ in took] == [1600] * 10 and sorted(label for _, label in took) == [0] * 5 + [1] * 5


def test_toxicity_windows_of_a_long_text_in_batches():
    """A text's logits don't depend on how many windows are scored at a time."""
    rng = np.random.default_rng(2)
    net = toxicity.Net()
    x = rng.integers(0, 1 << toxicity.BITS, (5000, toxicity.INPUTS)).astype(np.uint16)
    offs = np.array([0, 0, 7, 4990, 5000])
    first, woffs = toxicity.windows(offs)
    stop = np.repeat(offs[1:], np.diff(woffs))
    assert np.allclose(net.logits(x, first, stop, 10_000), net.logits(x, first, stop, 3), atol=1e-5)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Net()
    for k in ("v", "w", "u", "wx"):
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.integers(0, 1 << toxicity.BITS, (toxicity.LENGTH, 3, toxicity.INPUTS)).astype(np.uint16)
    hole = np.zeros((toxicity.LENGTH, 3), bool)
    hole[20:, 1] = True
    y, wt = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        flat = x.reshape(-1, toxicity.INPUTS)
        idx = np.where(hole, len(flat), np.arange(len(flat)).reshape(toxicity.LENGTH, 3))
        z = net.head(net.states(net.project(flat), idx), hole)[2]
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    g = net.step(x, hole, y, wt)
    for name, at in (("w", (3,)), ("v", (9,)), ("u", (1, 2, 20)), ("u", (0, 4, 3)), ("wx", (2, 30))):
        old = net.p[name][at]
        net.p[name][at] = old + 0.05
        up = loss()
        net.p[name][at] = old - 0.05
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 0.1 - g[name][at]) < 2e-3 + 0.1 * abs(g[name][at])


def test_quality_held_out(spark, docs, empty):
    d, lab, y = _toxic(spark)
    model = quality.fit(d, lab, F.col("doc_id") < 250)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (y[k] == 0) for k in range(250, 400)]) > 0.85
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty, model).count() == 0


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert rules.fit(docs, none) == "true"
    one = spark.createDataFrame([(3, 1, 1), (5, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.9 for r in quality.score(docs, quality.fit(docs, one, F.lit(True))).collect())
    assert all(r.score > 0.9 for r in toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).collect())


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vecs = [(int(k), rng.integers(-40, 40, 8).astype(float).__truediv__(64).tolist()) for k in range(120)]
    vecs += [(50, vecs[3][1]), (7, vecs[3][1]), (200, None), (201, [1.0] * 7 + [float("nan")]), (202, [1.0] * 7 + [None]), (250, [0.5, 0.25]), (None, [0.1] * 8), (203, [float("inf")] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in topk.top_k(df, 5, 50).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = [(k, i, np.floor(256 * np.array(v, np.float32).astype(float))) for k, (i, v) in enumerate(vecs) if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = collections.defaultdict(list)
    for k, i, v in ok:
        if i % 50 == 0:
            best = sorted((-int(v @ u), j, m) for m, j, u in ok if m != k and len(u) == len(v))[:5]
            want[i] += [(n + 1, j, -s) for n, (s, j, _) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert topk.top_k(df.where("false")).count() == 0


def test_bpe_equals_the_library(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, s, _ in rows:
        ids = t.encode(s or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        assert bpe.decode(ids) == said
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert by_row(bpe.digests(docs)) == sorted(want, key=str)
    full = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs.where("doc_id = 11"), keep=("source",)).collect()}
    assert full[11][1] == bpe.decode(full[11][0])


@pytest.mark.parametrize("remember", [50, 100_000])
def test_bpe_odd_texts(remember):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    t = tokenizers.Tokenizer.from_file(path)
    c = bpe.Codec(bpe.codec(path).v, remember)
    odd = ["", "don't I'LL 'S", "ΣΑΣ Σ İ ß ẞ Ǆ", "a\u00a0b\u2003c", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "e\u0301 \u0301x", "½²①", "!!!???..", "日本 テ", "ab" * 999, "a" * 3000, "\x00\x1c\x85\u200b", "🙂👩\u200d👧", "É×÷È", "x1y22z"]
    batch = pa.RecordBatch.from_arrays([pa.array(odd * 2)], names=["text"])
    for lo, hi, piece in text.pieces(batch, target=64):
        rows_, offs = c.rows(piece)
        ids, io = bpe.gather(c.ids, c.id_end, rows_)
        for k in range(piece.n):
            want = t.encode((odd * 2)[lo + k], add_special_tokens=False).ids
            assert ids[io[offs[k]] : io[offs[k + 1]]].tolist() == want


def test_url_filter(spark):
    urls = ["https://shop.example.net/de/80"] * 40 + ["http://b.org/x"] * 33 + ["http://a.example.com/en/7", "HTTP://A.Example.COM/en/8?x#y", "https://example.com/en/70/", "https://com/en/", "http://x.net/de/8", "https://example.net/de/81#q", "no scheme", None, "", "http://", "ftp://u@h.org:80/es/", "x://a.org?/es/", "http://ccom/en/", "http://a.example.com/en/7"]
    pages = spark.createDataFrame([(k % 13, u, "h") for k, u in enumerate(urls)], "page_id long, url string, digest string")
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark)).select("page_id", "url", "host", "path", "rule", "verdict")
    want = []
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0].translate(LOW)
        path = re.split("[?#]", rest[len(host) :])[0]
        hits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        top = max(hits, default=(0, None, "allow"))
        want.append((k % 13, u, host, path, top[1], top[2]))
    assert by_row(got) == sorted(want, key=str)
    assert url_filter.judge_urls(pages, url_filter.rules_frame(spark, [("block", "", "/")])).where("rule IS NOT NULL").count() == 0
    assert url_filter.judge_urls(pages.where("false"), url_filter.rules_frame(spark)).count() == 0


def test_targets():
    assert mixing.targets([10, 100, 100], [3, 1, 2]) == pytest.approx([20, 295 / 3, 590 / 3])
    assert mixing.targets([0, 0], [1, 1]) == [0, 0] and mixing.targets([], []) == []
    t = mixing.targets([5, 50, 500], [3, 1, 2])
    assert sum(t) == pytest.approx(1.5 * 555) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [5, 50, 500]))


def test_mixing(docs, rows):
    sized = mixing.sized(docs)
    got = mixing.mix_sources(sized).collect()
    assert len(got) == len(rows)
    size = {i: len(words(t)) for i, t, _ in rows}
    per = collections.defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"])
        x = per[r.source]
        x[0] += r["size"]
        x[1] += r.taken
        x[2], x[3] = r.target, max(x[3], r["size"])
        assert r.source_size == sum(len(words(t)) for _, t, s in rows if s == r.source)
    assert all(abs(taken - target) <= biggest for _, taken, target, biggest in per.values())
    again = mixing.mix_sources(mixing.sized(docs.orderBy(F.desc("text")).repartition(3))).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(r.doc_id), r["size"], r.taken) for r in again)
    assert mixing.mix_sources(sized.where("false")).count() == 0


def test_empty_tables(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert rules.judge(empty, "true").count() == 0
    assert bpe.digests(empty).count() == 0


def test_the_driver_collects_its_garbage_between_written_tables(spark):
    from tessera.llm import common

    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    with common.scratch():
        for _ in range(common.TIDY):
            common.saved(spark.range(1).toDF("x"))
    assert full() > before


def test_saved_tables_let_the_driver_give_back_native_memory(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    if not common.trim_native(spark):
        pytest.skip("this JVM can't trim")
    pid = jvm.java.lang.ProcessHandle.current().pid()
    rss = lambda: int(pathlib.Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 2**20
    # freed in between such as are held: the C library keeps the pages
    held = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    for k, x in enumerate(held):
        if k % 20:
            x.end()
    jvm.System.gc()
    before = rss()
    monkeypatch.setattr(common, "_writes", common.TIDY - 1)
    with common.scratch():
        common.saved(spark.range(1).toDF("x"))
    assert rss() < before - 30
    assert len(held) == 1000


def test_lm_layer_learns_from_every_window_of_every_training_text(spark, monkeypatch):
    took = []
    train = lm.trained

    def trained(tables, model, groups):
        got = tables.where("base = 2").select("g", "turn", "id_n").collect()
        took.append((groups, [(r.g, r.turn, np.frombuffer(r.id_n, np.uint16).reshape(-1, lm.WIDTH + 2)) for r in got]))
        train(tables, model, groups)

    monkeypatch.setattr(lm, "trained", trained)
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 64)  # else a corpus as small as this was whole before
    monkeypatch.setattr(lm, "GROUP", 300)
    df = spark.range(500).selectExpr("id doc_id", "repeat(concat('one two three four ', id, ' '), 30) text")
    rows = lm.lm_scores(df, F.col("doc_id") % 5 == 0).collect()
    assert len(rows) == 500 and all(np.isfinite(r.score) for r in rows)
    codec, total = bpe.codec(bpe.vocabulary_path()), 0
    for r in df.where("doc_id % 5 <> 0").collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        urow, _ = codec.rows(text.Texts(raw, np.array([0, len(raw)])))
        total += -(-(len(bpe.gather(codec.ids, codec.id_end, urow)[0]) + 1) // lm.WIDTH)
    groups, got = took[0]
    assert sum(len(w) for *_, w in got) == total and groups == round(total / 300) > 1
    assert {t for _, t, _ in got} == set(range(lm.ROUNDS)) and {g for g, *_ in got} == set(range(groups))


def test_lm_scoring_leaves_one_models_tables_on_disk(spark, monkeypatch):
    made = []
    kind = type(spark.sparkContext)
    broadcast = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    docs = spark.createDataFrame([(k, f"some words and {k % 7} more of them " * 5) for k in range(40)], "doc_id long, text string")
    assert lm.lm_scores(docs, F.col("doc_id") % 5 == 0).count() == 40
    # each is a file on the driver and on every executor
    left = [pathlib.Path(b._path).stat().st_size / 2**20 for b in made if pathlib.Path(b._path).exists()]
    assert max(left) > 10  # the scores' tables are there
    assert sum(left) < 40


def test_lm_learning_steps_are_those_of_the_plain_gradient():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 300, 64 * lm.WIDTH)
    m = lm.Model(*lm.class_of(np.bincount(ids, minlength=lm.IDS)))
    m.bigram = rng.standard_normal((lm.IDS, lm.CLASSES)).astype(np.float32)
    windows, size, _ = lm.cut(ids, np.array([0, 50, 90, len(ids)]))
    rate, names = 1e-3, [k for k in lm.LAYER if k != "emb"]

    def loss(change=None):
        n = lm.Model.of(m.__dict__ | (change or {}))
        n.ready()
        x, y = windows[:, :-1].astype(int), windows[:, 1:].astype(int)
        z = (n.attend(x)[4] @ n.wo + n.bigram[x]).astype(float)
        lp = np.take_along_axis(z, n.classes[y][..., None], 2)[..., 0] - np.log(np.exp(z).sum(2))
        return -lp[np.arange(lm.WIDTH) < size[:, None]].mean()

    before = {k: getattr(m, k).copy() for k in lm.LAYER}
    new = lm.Model.of(dict(m.__dict__) | {"emb": m.emb.copy()})
    new.learn(windows, size, epochs=1, batch=len(windows), rate=rate)
    # the first step of each number is ``rate`` against the sign of its slope
    for k in names:
        for at in list(np.ndindex(before[k].shape))[::37]:
            up, down = before[k].copy(), before[k].copy()
            up[at] += 0.02
            down[at] -= 0.02
            slope = (loss({k: up}) - loss({k: down})) / 0.04
            if abs(slope) > 1e-4:
                assert np.sign(before[k][at] - getattr(new, k)[at]) == np.sign(slope), (k, at)
    assert loss({k: getattr(new, k) for k in lm.LAYER}) < loss()


def test_bpe_short_words_are_taken_side_by_side(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    rng, alone = np.random.default_rng(8), []
    for name in ("propose", "exact"):
        one = getattr(bpe.Vocabulary, name)
        monkeypatch.setattr(bpe.Vocabulary, name, lambda self, piece, one=one: alone.append(len(piece)) or one(self, piece))
    words = ["".join(rng.choice(list("aeinorstthx"), n)) for n in [*rng.integers(1, 20, 3000), 63, 64, 65, 500]]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    rows, _ = bpe.Codec(bpe.codec(path).v).rows(text.Texts(raw, np.array([0, len(raw)])))
    assert len(rows) == len(words)
    # one by one a word takes some 30 microseconds; that is for long ones
    assert sorted(set(alone)) == [65, 500]
    want = tokenizers.Tokenizer.from_file(path).encode(" ".join(words), add_special_tokens=False).ids
    for ids_only, remember in ((False, 100_000), (True, 100_000), (True, 50)):
        c = bpe.Codec(bpe.codec(path).v, remember, ids_only)
        for _ in range(2):
            assert bpe.gather(c.ids, c.id_end, c.rows(text.Texts(raw, np.array([0, len(raw)])))[0])[0].tolist() == want


def test_bpe_lookup_finds_what_it_took_up():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), np.arange(-50, 50)]))
    rng.shuffle(keys)
    at = bpe.Lookup(keys[:3], np.arange(3), -1)
    for lo in range(3, 4000, 400):
        part = np.arange(lo, min(lo + 400, 4000))
        at.add(keys[part], part)
        assert (at(keys) == np.where(np.arange(len(keys)) < part[-1] + 1, np.arange(len(keys)), -1)).all()
    assert len(at(keys[:0])) == 0


def test_lm_counts_equal_those_of_a_long_table():
    rng = np.random.default_rng(3)
    counts, want = np.zeros(500, np.int32), np.zeros(500, int)
    for n in (0, 1, 3000, 2):
        keys = rng.integers(0, 500, n).astype(np.int32)
        lm.add_counts(counts, keys)
        want += np.bincount(keys, minlength=500)
    assert (counts == want).all()
