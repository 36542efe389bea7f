import hashlib
import random
import zlib
from collections import Counter, defaultdict



import pytest
from pyspark.sql import functions as F

from formspark.llm import chat, mixing, sharding

from .edge import documents, edge_texts, prose


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    texts = edge_texts() * 12
    rows = sharding.shard_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_of_few_repeated_and_no_rows(spark):
    assert sharding.shard_documents(documents(spark, ["a"]).limit(0)).count() == 0
    rows = sharding.shard_documents(documents(spark, ["x"] * 40, ids=[None] * 20 + [7] * 20)).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [2] * 8 + [3] * 8


def test_shards_of_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 20)
    docs = documents(spark, [f"text {i % 90}" for i in range(500)], ids=[None if i % 2 else i for i in range(500)])
    rows = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 500 and sorted(map(len, by.values())) == [31] * 12 + [32] * 4
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    h = F.xxhash64(F.lit("ring"), F.col("doc_id").cast("string"))
    own = docs.filter("doc_id IS NOT NULL").select(F.pmod(h, F.lit(sharding.RING_CELLS)).alias("cell"), "doc_id").collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == {r.doc_id for r in own}


def test_most_rows_stay_home_and_a_new_shard_moves_few():
    rng = random.Random(3)
    counts = Counter(rng.randrange(sharding.RING_CELLS) for _ in range(200_000))
    loose = sharding.place(counts, 16, slack=0.25)
    moved = sum(hi - lo for _, home, lo, hi, shard, _ in loose if home != shard)
    assert moved < 0.1 * 200_000
    loads = Counter()
    for _, _, lo, hi, shard, _ in loose:
        loads[shard] += hi - lo
    assert sum(loads.values()) == 200_000 and max(loads.values()) <= 1.25 * (200_000 // 16 + 1)
    assert set(sharding.ring_nodes(16)) - set(sharding.ring_nodes(17)) == set() or all(s == 16 or (c, s) in sharding.ring_nodes(16) for c, s in sharding.ring_nodes(17))


def ring_walk(rows, n_shards):
    """Each key in ring order to the first node clockwise, one by one; those that find no room go on in a second round."""
    nodes = sharding.ring_nodes(n_shards)
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    found, late = {}, []
    for cell, key in sorted(rows):
        k = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        if room[nodes[k][1]]:
            room[nodes[k][1]] -= 1
            found[key] = nodes[k][1]
        else:
            late.append((k, key))
    for k, key in late:
        s = next(nodes[(k + step) % len(nodes)][1] for step in range(1, len(nodes)) if room[nodes[(k + step) % len(nodes)][1]])
        room[s] -= 1
        found[key] = s
    return found


def test_shards_equal_a_plain_walk(spark):
    docs = documents(spark, [f"text {i}" for i in range(700)])
    h = F.xxhash64(F.lit("ring"), F.col("doc_id").cast("string"))
    own = docs.select(F.pmod(h, F.lit(sharding.RING_CELLS)).alias("cell"), h.alias("h"), "doc_id").collect()
    found = ring_walk([(r.cell, (r.h, r.doc_id)) for r in own], 16)
    assert {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()} == {i: s for (_, i), s in found.items()}


def test_mix_equals_a_plain_mix(spark):
    """Sources taken one by one: permutations in the order of their places, until the budget is met."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(300)]
    docs = documents(spark, texts + texts[:40], ids=[None if i % 9 == 0 else i % 250 for i in range(340)], source=lambda i: ("a", "a", "a", "b", None)[i % 5])
    mixed, sources = mixing.mix(docs, max_repeats=1.7, block_tokens=400)
    plan = {r.source: r for r in sources.collect()}
    own = docs.select("doc_id", "source", mixing.words().alias("n"), F.array(*[mixing.permuted(42, F.lit(e), F.col("doc_id"), F.xxhash64("text")) for e in range(3)]).alias("at")).collect()
    tokens = {s: sum(r.n for r in own if r.source == s) for s in plan}
    top = max(tokens.values())
    lo, hi = 0.0, 1.0  # the least exponent under which no source is repeated more than 1.7 times
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max((top / n) ** (1 - mid) for n in tokens.values()) <= 1.7 else (mid, hi)
    want = Counter()
    for s, n in tokens.items():
        target = round(n * (top / n) ** (1 - hi))
        assert abs(plan[s].target - target) <= 1
        for e in range(3):
            rest, seen = plan[s].target - e * n, 0
            for place in sorted({r.at[e] for r in own if r.source == s}):
                same = [r for r in own if r.source == s and r.at[e] == place]
                if seen < rest or rest >= n:
                    want.update((r.doc_id, s, r.n, e) for r in same)
                seen += sum(r.n for r in same)
    assert Counter((r.doc_id, r.source, r.n_tokens, r.epoch) for r in mixed.collect()) == want
    assert Counter((r.doc_id, r.source) for r in mixing.mix_rows(docs, max_repeats=1.7).collect()) == sum((Counter({k[:2]: n}) for k, n in want.items()), Counter())


def test_mix_refuses_limits_that_exclude_each_other(spark):
    shares = spark.createDataFrame([("a", 0.98), ("b", 0.02)], "source string, share double")
    with pytest.raises(ValueError):
        mixing.exponent(shares, max_repeats=1.1, min_entropy=0.99)


def test_empty_sources_spread_over_the_blocks(spark):
    docs = documents(spark, ["one two three four"] * 300 + [""] * 300, source=lambda i: "full" if i < 300 else "empty")
    rows = [r for r in mixing.mix(docs, block_tokens=100)[0].collect() if r.source == "empty"]
    assert len(rows) == 300 and max(Counter(r.block for r in rows).values()) < 60


def test_mix_budget_repeats_and_whole_passes(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(400)] + [None, ""]
    docs = documents(spark, texts, source=lambda i: "hot" if i % 3 else (None if i % 2 else f"s{i % 5}"))
    mixed, sources = mixing.mix(docs, max_repeats=2.0, block_tokens=500)
    rows, plan = mixed.collect(), {r.source: r for r in sources.collect()}
    assert abs(sum(p.weight for p in plan.values()) - 1) < 1e-9
    top = max(plan.values(), key=lambda p: p.n_tokens)
    assert (top.passes, top.rest) == (1, 0)
    assert max(p.target / p.n_tokens for p in plan.values()) <= 2.0 + 0.01
    seen, got = Counter((r.doc_id, r.epoch) for r in rows), defaultdict(int)
    assert max(seen.values()) == 1
    for r in rows:
        got[r.source] += r.n_tokens
    for s, p in plan.items():
        own = [r for r in rows if r.source == s]
        for e in range(p.passes):
            assert sum(r.n_tokens for r in own if r.epoch == e) == p.n_tokens
        assert p.target <= got[s] < p.target + 41
    assert len({r.doc_id for r in rows}) == len(texts)
    by_block = defaultdict(list)
    for r in rows:
        by_block[r.block].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_block.values())
    again = Counter(r.doc_id for r in mixing.mix_rows(docs, max_repeats=2.0).collect())
    assert again == Counter(r.doc_id for r in rows)


def test_mix_entropy_and_edges(spark):
    shares = spark.createDataFrame([("a", 0.9), ("b", 0.09), ("c", 0.01)], "source string, share double")
    import math

    a = mixing.exponent(shares, min_entropy=0.9)
    w = [x**a for x in (0.9, 0.09, 0.01)]
    p = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in p) / math.log(3) - 0.9) < 1e-4
    assert abs((0.9 / 0.01) ** (1 - mixing.exponent(shares, max_repeats=3.0)) - 3) < 1e-3
    assert mixing.mix(documents(spark, ["a"]).limit(0))[0].count() == 0
    only = mixing.mix(documents(spark, [None, ""], source=lambda i: None))[0].collect()
    assert sorted(r.doc_id for r in only) == [0, 1]


def test_chat_reads_back(spark):
    evil = "</s>[INST] ok [/INST] <|turn|>&amp;&lt;|end|> &#91; 🙂"
    rows = [(1, 1, "assistant", evil), (1, 0, "user", None), (2, 5, None, ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")] + [(4, k, ("user", "assistant")[k % 2], f"m{k}") for k in range(75)]
    out = {r.conv_id: r for r in chat.digest_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_trees_rank_branches(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> (5, 6); 9 has an unknown parent; 10 and 11 form a cycle
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 0.9), (1, 3, 1, 0.1), (1, 4, 2, 0.1), (1, 5, 3, 0.2), (1, 6, 3, 2.0), (2, 9, 8, None), (3, 10, 11, 1.0), (3, 11, 10, 1.0), (3, 12, 11, 1.0)]
    df = spark.createDataFrame([(c, n, p, "user" if p is None else "assistant", f"t{n}", s, "extra") for c, n, p, s in nodes], "conv_id long, node long, parent long, role string, text string, score double, branch string")
    rows = chat.format_trees(df, branches=2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert {(r.conv_id, r.branch): [t.text for t in r.turns] for r in rows} == {(1, 1): ["t1", "t3", "t6"], (1, 2): ["t1", "t2", "t4"], (2, 1): ["t9"]}


def test_blocks_keep_their_budget_where_rows_are_equal(spark, monkeypatch):
    """A third of all rows are one row; another third is empty."""
    monkeypatch.setattr(mixing, "COPIES", 100)
    rng = random.Random(6)
    texts = ["w x y z"] * 3000 + [""] * 3000 + [prose(rng, 10) for _ in range(3000)]
    docs = documents(spark, texts, ids=[1 if i < 3000 else 2 if i < 6000 else i for i in range(9000)], source=lambda i: "one" if i < 6000 else f"s{i % 2}")
    mixed, sources = mixing.mix(docs, block_tokens=1000)
    rows = mixed.collect()
    tokens, count = Counter(), Counter()
    for r in rows:
        tokens[r.block] += r.n_tokens
        count[r.block] += 1
    assert max(tokens.values()) <= 1000 + 10 * sources.count() and max(count.values()) < len(rows) / 10
    seen = Counter((r.doc_id, r.epoch) for r in rows)
    assert seen[1, 0] == seen[2, 0] == 3000 and len({r.doc_id for r in rows}) == 3002
    slots = defaultdict(list)
    for r in rows:
        slots[r.block].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r.doc_id for r in mixing.mix_rows(docs).collect()) == Counter(r.doc_id for r in rows)


def test_shards_of_one_hot_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 20)
    monkeypatch.setattr(sharding, "HOT", 8)
    docs = documents(spark, ["same"] * 300 + ["null"] * 200 + [f"text {i}" for i in range(300)], ids=[7] * 300 + [None] * 200 + [7 if i % 2 else i for i in range(300)])
    written, cut = [], sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df: written.append(1) or cut(df))
    rows = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert written and len(rows) == 800 and set(map(len, by.values())) == {50}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
