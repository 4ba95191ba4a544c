"""Decontamination, mixing, sharding and URL rules against plain versions, with the awkward rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from lodeframe.llm import decontaminate, mixing, sharding, url_rules
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [(1, None), (2, ""), (3, f"Before ONE two, {PASSAGE[8:]} after"), (3, f"Before ONE two, {PASSAGE[8:]} after"), (4, "café au lait!"), (None, PASSAGE), (5, "x " * 30_000 + PASSAGE + " y" * 10), (6, "cafés au lait")]
ITEMS = [(7, PASSAGE), (8, "Café AU-lait"), (9, None), (10, ""), (None, "nine ten"), (7, "eleven twelve after")]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("blocks", [500_000, 2])
def test_contamination_of_odd_rows(spark, blocks):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_words=blocks)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()), key=repr) == sorted((x[:4] for x in brute.contamination(ODD, ITEMS)), key=repr)
    assert not decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count()
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_contamination_removed(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {1, 2, 6}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "span").collect()}
    assert cut[3].split() == ["Before"] and cut[6] == "cafés au lait" and cut[4] == "!" and cut[1] is None
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "nothing")


def test_op2_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(docs, items)
    assert rows(decontaminate.op2_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert any(w[5] for w in want)


MIXED = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i % 11)) for i in range(200)] + [(900, "s0", None), (900, "s0", None), (901, "empty", ""), (None, "s1", "a b")]


def test_mixing_reaches_targets(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in MIXED], "doc_id long, source string, text string, mix string")
    got = mixing.plan_mix(docs).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(MIXED)
    sizes = defaultdict(int)
    for _, s, t in MIXED:
        sizes[s] += len((t or "").split())
    want = brute.targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert rows(mixing.plan_mix(docs), "doc_id", "mix") == rows(mixing.plan_mix(docs.repartition(5)), "doc_id", "mix")
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_mixing_order_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * 10) for i in range(3000)], "doc_id long, source string, text string")
    got = mixing.mix_documents(docs, weights=(1.0,), share=1.5).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and len(got) == 4500
    early = Counter(r.source for r in got[:450])
    assert early["s0"] > 1.2 * early["s1"] > 1.2 * 1.2 * early["s2"]
    for knots in mixing.SCHEDULES:
        area = mixing._areas(knots)[-1]
        for u in (0.0, 0.1, 0.5, 0.77, 1.0):
            t = spark.range(1).select(mixing.invert_demand(knots, mixing.F.lit(u))).first()[0]
            steps = 20000
            at = [(k + 0.5) / steps * t for k in range(steps)]
            w = lambda x: next(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if x <= b[0])
            assert sum(map(w, at)) * t / steps / area == pytest.approx(u, abs=1e-3)


def plain_mix(spark, rows):
    """(doc_id, text) -> times, and (position, doc_id) of every copy, by running through each source in hash order."""
    sizes, members = defaultdict(int), defaultdict(list)
    hashes = spark.createDataFrame([(k, d, t) for k, (d, _, t) in enumerate(rows)], "k int, d long, t string").select("k", mixing.F.shiftrightunsigned(mixing.F.xxhash64(mixing.F.lit(17), "d", "t"), 1).alias("h")).collect()
    for r in hashes:
        d, s, t = rows[r.k]
        sizes[s] += len((t or "").split())
        members[s].append((r.h, len((t or "").split()), d))
    times, placed = Counter(), []
    want = brute.targets(dict(sizes))
    for rank, s in enumerate(sorted(sizes, key=lambda x: (x is None, (x or "").encode()))):
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        last, start = round(want[s] - whole * sizes[s]), 0
        knots = mixing.SCHEDULES[rank % len(mixing.SCHEDULES)]
        for _, n, d in sorted(members[s]):
            extra = min(n, max(0, last - start))
            for copy in range(whole + (start < last and 2 * extra >= n)):
                u = min(1.0, (copy * sizes[s] + start + (n if copy < whole else extra) / 2) / want[s]) if want[s] else 0.0
                placed.append((time_of(knots, u), d))
                times[d] += 1
            start += n
    return times, placed


def time_of(knots, u):
    area, least, most = mixing._areas(knots)[-1], 0.0, 1.0
    def reached(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            end = min(t, t1)
            if end > t0:
                out += (w0 + w0 + (w1 - w0) * (end - t0) / (t1 - t0)) / 2 * (end - t0)
        return out
    for _ in range(60):
        mid = (least + most) / 2
        least, most = (mid, most) if reached(mid) < u * area else (least, mid)
    return least


@pytest.mark.parametrize("per_bucket", [2048, 3])
def test_every_copy_and_position_equals_a_plain_mix(spark, monkeypatch, per_bucket):
    """Whatever the number of rows is, the order inside a source is the same."""
    monkeypatch.setattr("lodeframe.llm.common.ROWS_PER_BUCKET", per_bucket)
    rows_ = [(i, f"s{i % 5}" if i % 7 else None, "w " * (i % 11 + 1)) for i in range(300)] + [(900, "s0", None)] * 3 + [(901, "s1", "a b c")] * 40 + [(None, "s2", "x y")] * 30 + [(902, "s9", "w " * 500), (903, "empty", "")]
    docs = spark.createDataFrame([(*r, "t", 1, 2) for r in rows_], "doc_id long, source string, text string, target string, _size int, rank int")
    got = mixing.mix_documents(docs).collect()
    times, placed = plain_mix(spark, rows_)
    assert Counter(r.doc_id for r in got) == times
    assert sorted((round(r.position, 6), r.doc_id or -1) for r in got) == sorted((round(p, 6), d or -1) for p, d in placed)
    assert all((r.target, r._size, r["rank"]) == ("t", 1, 2) for r in got)


def test_op4_is_the_mix_itself(spark, tmp_path, monkeypatch):
    rows_ = [(i, f"s{i % 3}", "w " * 10) for i in range(300)] + [(1000, "s1", "w " * 900), (1001, "s2", "w " * 901), (None, None, None)]
    spark.createDataFrame(rows_, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op4_mixing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, *_ in rows_), key=repr)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and all(0 <= x <= 1 and list(r.positions) == sorted(r.positions) for r in got for x in r.positions)
    mixed = mixing.mix_documents(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert sorted((r.doc_id, x) for r in got for x in r.positions) == sorted((r.doc_id, r.position) for r in mixed)
    assert all(r.taken == len(r.positions) * r["size"] for r in got) and all(r.mix.taken == r.mix.size for r in mixed)
    monkeypatch.setattr(mixing.mix_schedule, "__defaults__", ((((0.0, 1.0), (1.0, 1.0)),), *mixing.mix_schedule.__defaults__[1:]))
    assert [r.positions for r in mixing.op4_mixing(spark, str(tmp_path)).collect()] != [r.positions for r in got]


def test_op4_adds_up_over_its_own_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows_ = docs.select("doc_id", "source").join(mixing.op4_mixing(spark, "/root/testdata/sf0.01"), "doc_id").collect()
    assert len(rows_) == docs.count()
    sizes, taken, most, target = Counter(), Counter(), Counter(), {}
    for r in rows_:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute.targets(dict(sizes))
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in want)


def plain_shards(sizes, shards):
    """Loads after every group, one by one, has gone to the least-loaded shard (of equals, the first)."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


SHARDED = [(i, f"text {i % 50} " * (i % 50)) for i in range(400)] + [(1000 + i, "copy" * 40) for i in range(300)]
SHARDED += [(2, None), (2, None), (None, ""), (3, ""), (5000, "long " * 40_000)] + [(6000 + i, f"{i:06}") for i in range(700)] + [(None, "null id")] * 90


def test_sharding_equals_the_plain_schedule(spark):
    docs = spark.createDataFrame([(*r, 1) for r in SHARDED], "doc_id long, text string, shard int")
    got = sharding.assign_shards(docs, shards=4).collect()
    assert len(got) == len(SHARDED)
    where, slots, loads, texts, groups = defaultdict(set), defaultdict(list), [0] * 4, defaultdict(set), Counter()
    for d, t in SHARDED:
        texts[d].add(t)
        groups[t] += len((t or "").encode()) + 1
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        if len(texts[r.doc_id]) == 1:
            where[next(iter(texts[r.doc_id]))].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert loads == plain_shards(groups.values(), 4)
    again = sharding.assign_shards(docs.repartition(3), shards=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, shards=0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op5_loads_equal_the_plain_schedule(spark, sf):
    texts = Counter()
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect():
        texts[r.text] += len((r.text or "").encode()) + 1
    got = {r.shard: r.b for r in sharding.op5_shards(spark, f"/root/testdata/{sf}").groupBy("shard").agg(sharding.F.sum("size").alias("b")).collect()}
    assert [got[k] for k in range(16)] == plain_shards(texts.values(), 16)


def test_long_runs_of_equal_groups_are_cut_as_the_heap_would():
    rnd = random.Random(3)
    for trial in range(60):
        shards = rnd.randint(1, 7)
        sizes = [(s, rnd.choice((1, 3, 20, 200))) for s in rnd.sample(range(1, 400), 12)]
        loads = [0] * shards
        for size, ks, upto in sharding.longest_first(sizes, shards):
            for k, a, b in zip(ks, [0, *upto], upto):
                loads[k] += (b - a) * size
        assert loads == plain_shards([s for s, n in sizes for _ in range(n)], shards)


URLS = {"https://A.com/x": ("a.com", "/x", "com/", "allow"), "http://m.example.com/en/1?q=1#z": ("m.example.com", "/en/1", "example.com/en/", "block"), "http://www.EXAMPLE.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "ftp://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"), "http://a.com": ("a.com", "", None, "allow"), "http://a.com?x=/": ("a.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}


def tokens_of(spark, labelled):
    """labelled: (url, bad) pairs."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "id long, url string, bad boolean")
    return frame.select("id", url_rules.url_tokens(url_rules.F.col("url")).alias("tokens"), "bad")


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    none = url_rules.mine_rules(tokens_of(spark, []))
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, none).collect()}
    assert got == URLS
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0
    assert url_rules.mine_rules(tokens_of(spark, [("http://a.org/x", False)] * 50)).count() == 0
    clash = pages.withColumns({c: url_rules.F.lit(c) for c in ("_set", "tokens", "items", "_pages", "_doc", "_fixed", "token")})
    assert all(r["_set"] == "_set" and r.token == "token" for r in url_rules.judge_urls(clash, none).collect())


def test_mined_rules_block_and_agree_with_a_scan(spark):
    urls = [(f"http://h{i % 5}.org/{'bad' if i % 3 == 0 else 'ok'}/{i}?ref={i}", i % 3 == 0) for i in range(300)]
    rules = url_rules.mine_rules(tokens_of(spark, urls))
    found = [(set(r.tokens), r.confidence) for r in rules.collect()]
    assert ({"path=bad"}, 1.0) in found and len(found) == 1
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(999, "http://zz.org/bad/1")] * 9, "page_id long, url string")
    got = {r.url: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert all((got[u] == "block") == b for u, b in urls) and got["http://zz.org/bad/1"] == "block"


def test_long_rules_and_rules_of_mostly_bad_labels_are_kept(spark):
    five = ("bad", "a", "b", "x", "y")
    url = lambda h, a, b, x, y: f"http://{h}.org/{a}/{b}?{x}=1&{y}=2"
    # Only all five tokens together are bad: with any four of them, half of the pages are not.
    urls = [(url(*five), True)] * 60 + [(url(*[f"no{k}" if k == j else t for k, t in enumerate(five)]), False) for j in range(5)] * 60
    for labelled, bad in ((urls, url(*five)), ([("http://h.org/bad", True)] * 160 + [("http://h.org/ok", False)] * 40, "http://z.org/bad")):
        rules = url_rules.mine_rules(tokens_of(spark, labelled))
        assert [r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, bad)], "page_id long, url string"), rules).collect()] == ["block"]


def test_rules_equal_a_scan_of_all_combinations(spark):
    """Mining with equal tokens as one item finds what every combination of tokens would."""
    rnd = random.Random(8)
    names = ("a", "b", "c", "d", "e")
    urls = []
    for i in range(240):
        some = [n for n in names if rnd.random() < 0.5]
        bad = ("a" in some and "c" in some) != (rnd.random() < 0.1)
        urls.append(("http://x.org/" + "/".join([*some, *(["twin"] if "a" in some else [])]), bad))
    labelled = tokens_of(spark, urls)
    rows_ = [(set(r.tokens), r.bad) for r in labelled.collect()]
    tokens = sorted({t for s, _ in rows_ for t in s})
    held = {}
    for size in range(1, len(tokens) + 1):
        for combo in itertools.combinations(tokens, size):
            n = [b for s, b in rows_ if set(combo) <= s]
            if sum(n) >= url_rules.MIN_PAGES and sum(n) / len(n) >= 0.6:
                held[frozenset(combo)] = sum(n) / len(n)
    minimal = {c: p for c, p in held.items() if not any(d < c and q >= p for d, q in held.items())}
    got = {}
    for r in url_rules.candidate_rules(labelled).collect():
        for combo in itertools.product(*r["items"]):
            got[frozenset(combo)] = r.confidence
    assert got == pytest.approx(minimal)


def test_combinations_that_go_together_are_one_item(spark):
    """Thirty tokens of the same pages have 2**30 subsets."""
    long = "http://long.org/" + "/".join(f"p{'x' * k}" for k in range(30))
    rules = url_rules.mine_rules(tokens_of(spark, [(long, True)] * 60 + [(f"http://h{i}.org/ok", False) for i in range(200)]))
    assert [r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), rules).collect()] == ["block"]


def test_labels_without_a_signal_give_no_rule(spark):
    rnd = random.Random(5)
    urls = [(f"http://h{rnd.randint(0, 20)}.org/{rnd.choice('abcdef')}/{rnd.choice('uvwxyz')}?{rnd.choice('mn')}=1", rnd.random() < 0.15) for _ in range(900)]
    assert url_rules.mine_rules(tokens_of(spark, urls)).count() == 0


def test_op7_table(spark):
    got = url_rules.op7_url_rules(spark, SF).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages) and {r.verdict for r in got} <= {"allow", "block"}
    for r in got:
        rest = pages[r.page_id].partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        assert (r.host, r.path) == (host.lower(), re.match("[^?#]*", rest[len(host):])[0])
        fits = [(v, h, p) for v, h, p in url_rules.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        if fits:
            v, h, p = max(fits, key=lambda x: len(x[1] + x[2]))
            assert (r.rule, r.verdict) == (h + p, v)
        else:
            assert r.rule is None and (r.verdict == "block") == (r.confidence is not None)
