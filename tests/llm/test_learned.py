import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from formspark.llm import near, pii, suffixes, toxicity
from formspark.llm.graph import components

from .edge import documents, edge_texts, prose


def luhn_ok(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn_ok(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("aZ09.@-+ ()_%é1234") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_base(t), t
    for t in ("a@b.c@d.e", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (907) 555-1190.", "0001.2.3.4", "é x.y@z.co"):
        assert pii.base_spans(t) == brute_base(t)
    pii.base_spans("a" * 200000 + "@" + "1" * 200000)  # in linear time
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [(0, 1, 6007)]


def test_private_spans(spark):
    texts = [*edge_texts(), "mail me: joe.x@mail.example.com from 10.0.0.1, card 4111 1111 1111 1111, call +1 (907) 555-1190"] + [f'x token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y' for i in range(30)]
    rows = {r.doc_id: r for r in pii.find_private(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert set(filter(None, said.split(","))) <= set(rows[i].spans.split(","))
    masked = {r.doc_id: r.text for r in pii.mask_private(documents(spark, texts)).collect()}
    assert masked[0] is None and masked[4] == "a" and "[EMAIL] from [IP], card [CARD], call [PHONE]" in masked[len(edge_texts())]
    assert pii.find_private(documents(spark, ["a"]).limit(0)).count() == 0


def test_em_finds_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.9, 0.5]
    votes = Counter("".join("+" if (t if rng.random() < p else not t) else "-" for p in right) for t in truth)
    share, table, _ = pii.reliabilities(list(votes.items()))
    assert abs(share - 0.4) < 0.05 and table[1, 0, 2] > 0.9 and abs(table[1, 3, 2] - 0.5) < 0.06


def test_em_equals_a_plain_loop():
    rng = random.Random(4)
    patterns = [("".join(rng.choice("+-0") for _ in range(5)), rng.randint(1, 50)) for _ in range(40)]
    post = [1 / (1 + np.exp(-sum({"+": 1, "-": -1, "0": 0}[c] for c in p))) for p, _ in patterns]
    for _ in range(60):
        share = (sum(n * q for (_, n), q in zip(patterns, post)) + 1) / (sum(n for _, n in patterns) + 2)
        chance = {}
        for y in (0, 1):
            mass = [n * (q if y else 1 - q) for (_, n), q in zip(patterns, post)]
            for j in range(5):
                for v in "-0+":
                    chance[y, j, v] = (sum(m for m, (p, _) in zip(mass, patterns) if p[j] == v) + 0.5) / (sum(mass) + 1.5)
        odds = [share / (1 - share) * np.prod([chance[1, j, c] / chance[0, j, c] for j, c in enumerate(p)]) for p, _ in patterns]
        post = [o / (1 + o) for o in odds]
    got, _, found = pii.reliabilities(patterns)
    assert abs(got - share) < 1e-9 and np.allclose(found, post)


def test_added_spans(spark):
    """Long secrets and spelled-out addresses are found whole; what only looks like them stays out."""
    key = lambda i, n: (hashlib.sha256(str(i).encode()).hexdigest() * 9)[:n]
    texts = [f"w{i} token = {key(i, 40)} end" for i in range(60)] + [f"w{i} secret: {key(i, 300)}, end" for i in range(20)]
    texts += [f"mail ann{i}.{'x' * 70}[at]mail.example[dot]com today" for i in range(40)] + [f"plain words number {i} only" for i in range(60)]
    masked = {r.doc_id: r.text for r in pii.mask_private(documents(spark, texts)).collect()}
    assert all(masked[i] == f"w{i} token = [SECRET] end" for i in range(60))
    assert all(key(i, 300)[-40:] not in masked[60 + i] or masked[60 + i] == texts[60 + i] for i in range(20))
    assert all(masked[80 + i] in ("mail [EMAIL] today", texts[80 + i]) for i in range(40))
    assert all(masked[i] == texts[i] for i in range(120, 180))


def test_nnpu_equals_a_plain_loop():
    """The same steps with one text and one feature at a time."""
    rng = np.random.default_rng(2)
    toxic = [np.unique(np.append(rng.integers(0, 6, 2), rng.integers(0, 40, 3))) for _ in range(60)]
    unlabelled = [np.unique(rng.integers(0, 40, 4)) for _ in range(150)] + toxic[:20]
    prior, steps, dims = 0.2, 30, 40
    known = [d for d in range(dims) if toxicity.lifted(toxic, unlabelled, dims)[d]]
    assert 0 < len(known) < dims
    w, b = {d: 0.0 for d in known}, float(np.log(prior / (1 - prior)))
    m, v = {d: 0.0 for d in [*known, "b"]}, {d: 0.0 for d in [*known, "b"]}
    p = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        z = lambda f: b + sum(w[d] for d in f.tolist() if d in w)
        zp, zu = [z(f) for f in toxic], [z(f) for f in unlabelled]
        negative = np.mean([np.log1p(np.exp(x)) for x in zu]) - prior * np.mean([np.log1p(np.exp(x)) for x in zp])
        g = {d: 0.0 for d in m}
        for rows, zs, weight in ((toxic, zp, -prior / len(toxic)), (unlabelled, zu, 1 / len(unlabelled))):
            for f, x in zip(rows, zs):
                for d in [*[d for d in f.tolist() if d in w], "b"]:
                    g[d] += (weight if negative >= 0 else -weight) * p(x)
        if negative >= 0:
            for f, x in zip(toxic, zp):
                for d in [*[d for d in f.tolist() if d in w], "b"]:
                    g[d] -= prior * p(-x) / len(toxic)
        for d in g:
            full = g[d] + (1e-4 * w[d] if d != "b" else 0)
            m[d], v[d] = 0.9 * m[d] + 0.1 * full, 0.99 * v[d] + 0.01 * full * full
            step = 0.1 * (m[d] / (1 - 0.9**t)) / ((v[d] / (1 - 0.99**t)) ** 0.5 + 1e-8)
            if d == "b":
                b -= step
            else:
                w[d] -= step
    got, bias = toxicity.fit_nnpu(toxic, unlabelled, prior, steps=steps, dims=dims)
    assert abs(bias - b) < 1e-6 and all(abs(got[d] - w.get(d, 0.0)) < 1e-6 for d in range(dims))


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["foulword", "nastyword", "vileword"]
    texts, labels = [], []
    for i in range(600):
        t, toxic = prose(rng, 60).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "!!!"]
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.rate_documents(docs, known).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert {r.score for r in toxicity.rate_documents(docs, known.limit(0)).collect()} < {r.score for r in rows} | {x for x in [toxicity.sigmoid(np.array([-60.0]))[0]]}
    kept = toxicity.without_toxic(docs, toxicity.learn(docs, known))
    assert kept.columns == docs.columns and kept.count() < 520


def test_toxicity_of_long_texts(spark):
    """Words of any hash count in texts of more features than a prefix would hold."""
    rng = random.Random(8)
    feature = lambda w: toxicity.features(pa.array([w]))[1]
    bad = next(w for w in (prose(rng, 1)[:4].upper() + str(i) for i in range(10**6)) if len(f := feature(w)) and f.min() > 0.95 * toxicity.DIMS)
    texts = [" ".join(f"{rng.randrange(36**3):03x}" for _ in range(7000)) + (f" {bad}" if i % 3 == 0 else "") for i in range(120)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.rate_documents(docs, labels).collect() if r.held_out]
    assert len(held) > 20 and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)


def test_toxicity_with_repeated_ids(spark, monkeypatch):
    """Repeated rows change no score, and the samples stay bounded when one id has many texts."""
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 150)
    rng = random.Random(6)
    texts = [prose(rng, 40) + (" foulword nastyword" if i % 4 == 0 else "") for i in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    plain = toxicity.learn(docs, labels)
    again = docs
    for i in range(9):
        again = again.unionByName(docs.filter(F.col("doc_id").isin([r.doc_id for r in toxicity.sampled(docs, 5).collect()]) | (F.col("doc_id") % 4 == i % 4)))
    other = toxicity.learn(again, labels)
    assert np.array_equal(plain.weights, other.weights) and plain.bias == other.bias
    many = documents(spark, [prose(rng, 20) for _ in range(500)], ids=[2] * 500).unionByName(docs)
    wanted = spark.createDataFrame([(i, p) for i in range(100) for p in range(3)], "doc_id long, part int")
    got = toxicity.sampled_texts(many.unionByName(many), wanted, (120, 50, 700)).collect()
    by = Counter(r.part for r in got)
    assert (by[0], by[1], by[2]) == (120, 50, 600) and len(set(got)) == len(got)
    assert len({r.doc_id for r in got if r.part == 0}) == 100


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passage, other = prose(rng, 150), prose(rng, 90)
    texts = [*edge_texts(), passage, prose(rng, 20) + passage + prose(rng, 30), passage[:-60] + "é" + other, other + passage[100:] + other, "ab" * 700, "x" * 399, "y" * 400, "y" * 401, passage[:500] + passage[:500], None]
    texts += [prose(rng, 5) + passage[rng.randrange(40) :] + prose(rng, 5) for _ in range(60)]
    short = ["a" * rng.randint(1, 3) + str(i) for i in range(61)]
    texts += [prose(rng, 60) + " " + " ".join(short[rng.randrange(15) : rng.randrange(45, 62)]) + "\n" + prose(rng, 9) for _ in range(40)]
    texts += [(prose(rng, 70) + " ") * 3, " ".join(short[:49]), "\t ".join(short[3:53]), prose(rng, 50)]
    texts += [prose(rng, 3) + " " + " ".join([*short[:20], f"own{i}", *short[20:]]) for i in range(5)]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + 400] for x in raw for p in range(len(x) - 399))
    passages = [{tuple(w[k : k + 50]) for k in range(len(w) - 49)} for w in (re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts)]
    said = Counter(x for own in passages for x in own)
    rows = {r.doc_id: r for r in suffixes.remove_repeats(documents(spark, texts)).collect()}
    for i, x in enumerate(raw):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - 399):
            if seen[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(c for c, g in zip(x, gone) if not g)
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans) == (len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])), i
        assert rows[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert rows[i].shares_passage == int(any(said[x] > 1 for x in passages[i])), i
    assert 0 < sum(r.shares_passage and not r.n_removed for r in rows.values()) < len(rows)
    monkeypatch.setattr(suffixes, "SAMPLED", 0.5)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert {r.doc_id: r for r in suffixes.remove_repeats(documents(spark, texts)).collect()} == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = suffixes.remove_repeats(documents(spark, ["y" * 400, "y" * 400, "z" * 10], ids=[None, None, 5])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in ids) == [(0, 400), (0, 400), (5, 0)]


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 9, 50_000), rng.integers(-5, 5, 50_000)]
    order = suffixes.multikey_quicksort(keys, small=100)
    assert (np.diff(keys[0][order] * 100 + keys[1][order]) >= 0).all() and len(set(order.tolist())) == 50_000


def test_splitters_cut_hot_keys():
    rng = np.random.default_rng(3)
    rows = np.array([np.where(rng.random(20_000) < 0.4, 7, rng.integers(0, 50, 20_000)), *(rng.integers(0, 3, 20_000) for _ in range(3)), rng.integers(-(2**60), 2**60, 20_000), rng.integers(0, 9, 20_000)])
    split = suffixes.splitters(rows[:, ::10], np.ones(2000), 16)
    bucket = suffixes.bucket_of(list(rows), list(split))
    assert max(Counter(bucket.tolist()).values()) < 2 * 20_000 / 16 and set(bucket.tolist()) == set(range(16))
    order = np.lexsort(rows[::-1])
    assert (np.diff(bucket[order]) >= 0).all()
    assert suffixes.bucket_of(list(rows), list(suffixes.splitters(rows[:, :0], np.ones(0), 16))).max() == 0


def test_similar_equal_brute_force(spark):
    rng = random.Random(8)
    texts = list(edge_texts())
    for _ in range(12):
        base = prose(rng, 140).split()
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            texts.append(" ".join(own))
    texts += texts[-3:] + ["one two three", "one two  three", "one two three four"]
    sets = {}
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    for t in by:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {t: {u for u in by if u != t and sets[t] & sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])} for t in by}
    root = {t: min(by[t]) for t in by}
    for _ in range(len(by)):
        root = {t: min([root[t], *(root[u] for u in links[t])]) for t in by}
    rows = {r.doc_id: r for r in near.join_similar(documents(spark, texts)).collect()}
    for t, own in by.items():
        for i in own:
            assert (rows[i].class_id, rows[i].n_links, rows[i].n_copies) == (root[t], len(links[t]), len(own)), i
    left = near.one_of_each(documents(spark, texts))
    assert {r.doc_id for r in left.collect()} == set(root.values())
    assert near.join_similar(documents(spark, ["a"]).limit(0)).count() == 0


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "CLUSTER_TILE", 4)
    monkeypatch.setattr(near, "BUCKET_TILE", 5)
    rng = random.Random(9)
    base = prose(rng, 200)
    texts = [base + f" tail{i}" for i in range(30)]
    rows = near.join_similar(documents(spark, texts)).collect()
    assert {(r.class_id, r.n_links) for r in rows} == {(0, 29)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[102]} == {100}


def test_pipeline_equals_its_stages_in_plain_python(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.rate_documents(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    want = {i: r.text for i, r in rows.items() if scores[i] < 0.7}
    out = dict(p.STAGES)["toxicity"](spark, docs, d)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == want

    grams = {}
    for i, t in want.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in want}
    near_ = {i: [j for j in want if j != i and ((want[i] or "") == (want[j] or "") or grams[i] & grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]))] for i in want}
    for _ in want:
        new = {i: min([root[i], *(root[j] for j in near_[i])]) for i in want}
        if new == root:
            break
        root = new
    out = dict(p.STAGES)["near_duplicates"](spark, out, d)
    want = {i: t for i, t in want.items() if root[i] == i}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == want

    taken = frozenset(pii.accepted(out.select("doc_id", "text").mapInArrow(pii.scan, pii.FOUND).select("base", "more")))
    out = dict(p.STAGES)["personal_data"](spark, out, d)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, t in want.items():
        spans = brute_base(t or "")
        spans = sorted([*spans, *(s for s in pii.candidates(t or "", spans) if (s[1], pii.votes(t, *s)) in taken)])
        masked, end = "", 0
        for s, k, e in spans:
            masked += (t[end:s] + f"[{pii.KINDS[k].upper()}]") if s >= end else ""
            end = max(end, e)
        want[i] = None if t is None else masked + t[end:]
    assert out.columns == docs.columns and got == {i: (t, None if t is None else len(t)) for i, t in want.items()}

    out = dict(p.STAGES)["source_mix"](spark, out, d)
    mixed = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and set(mixed) == set(want) and max(mixed.values()) <= 3
    tokens = Counter()
    for i, t in want.items():
        tokens[rows[i].source] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    seen = Counter()
    for i, n in mixed.items():
        seen[rows[i].source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", want[i] or ""))
    top = max(tokens, key=tokens.get)
    assert seen[top] == tokens[top] and all(tokens[s] <= seen[s] < 3 * tokens[s] for s in tokens if tokens[s])

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = p.run(spark, d).collect()
    assert Counter(r.doc_id for r in final) == mixed
    for r in final:
        assert r.ids == np.array(plain.encode_ordinary(want[r.doc_id] or ""), "<u4").tobytes() and r.n_tokens * 4 == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest()
