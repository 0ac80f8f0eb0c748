import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import blocks, components, embedding_dedup, hnsw, kneser_ney, mixing, ngram_join, packing, quality_rules, secret_scan, substring_dedup, textkit, token_counts, token_files
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    """Random prose with copies, near copies, shared passages, repeats, odd white space, and nulls."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "der", "#x", "été", "a", "b"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 12, 13, 40, 120]))]
        t = " ".join(w)
        if i % 7 == 3:
            t += "\n" + passage + "\t" + t
        if i % 5 == 4 and out[-1][1]:
            parts = out[-1][1].split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            t = " ".join(parts)
        if i % 9 == 8:
            t = out[rng.randrange(len(out))][1]
        out.append((i, t, "en", f"s{i % 3}", len(t or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \n\t ", "en", "s0", 4), (n + 3, "x\x0by\x0cz " * 30, "fr", None, 1), (n + 4, "long " * 30_000, "de", "s1", 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "kept")  # a clashing name


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_ngram_join_matches_plain(docs, rows):
    got = sorted(map(tuple, ngram_join.ngram_join(docs).collect()))
    assert got == plain.ngram_join([(r[0], r[1]) for r in rows])


def test_substring_dedup_matches_plain(docs, rows):
    got = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    assert got == plain.substring_dedup([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("seed", [11, 12])
def test_pairs_on_other_corpora(spark, seed):
    rows = corpus(45, seed)
    d = frame(spark, rows)
    assert sorted(map(tuple, ngram_join.ngram_join(d).collect())) == plain.ngram_join([(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, substring_dedup.remove_repeats(d).collect())) == plain.substring_dedup([(r[0], r[1]) for r in rows])


def test_chunked_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 2000)  # many chunks for each bucket
    rng = random.Random(5)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == plain.ngram_join([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("chunk", [600, 6 << 20])
def test_postings_whose_head_is_far_lose_no_link(spark, monkeypatch, chunk):
    # chains of edits and lengths: members of a posting link with one another, not with its smallest document
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", chunk)
    rng = random.Random(8)
    rows, i = [], 0
    for _ in range(4):
        base = [f"t{rng.randrange(10**6)}" for _ in range(70)]
        for step in range(14):
            base = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = f"e{i}"
            base += [f"x{i}.{k}" for k in range(rng.choice([0, 3, 9]))]
            rows.append((rng.randrange(10**6), " ".join(base), "en", "s", 0))
            i += 1
    rows += [(10**7 + k, " ".join(["same"] * k), "en", "s", 0) for k in range(1, 9)]
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == plain.ngram_join([(r[0], r[1]) for r in rows])


def test_repeated_and_null_ids(spark):
    t = " ".join(f"q{i}" for i in range(40))
    rows = [(1, t, "en", "s", 0), (1, t, "en", "s", 0), (2, t, "en", "s", 0), (None, t, "en", "s", 0), (None, None, None, None, None)]
    d = frame(spark, rows)
    assert sorted((r[0] or -1, r[2] or -1) for r in ngram_join.ngram_join(d).collect()) == [(-1, -1), (-1, -1), (1, 1), (1, 1), (2, 1)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.remove_repeats(d).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, 40)]
    assert quality_rules.quality_rules(d).count() == 5 and secret_scan.secret_scan(d).count() == 5
    assert token_counts.token_counts(d).count() == 5 and packing.pack(d).count() == 5
    assert mixing.mix(d)[0].count() == 5


def test_empty_tables(spark):
    none = frame(spark, [(1, "x", "en", "s", 0)]).where("false")
    assert ngram_join.ngram_join(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0 and secret_scan.secret_scan(none).count() == 0
    assert mixing.mix(none)[0].count() == 0 and packing.pack(none).count() == 0 and token_counts.token_counts(none).count() == 0
    assert kneser_ney.classify(none, none.select("doc_id")).count() == 0
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_links(vec).count() == 0


def test_quality_counts_match_plain(docs, rows):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {r[0]: plain.quality(r[1]) for r in rows}


def test_quality_rules_can_be_filtered(docs):
    q = quality_rules.quality_rules(docs)
    assert q.where("kept").count() == sum(r["kept"] for r in q.collect())


def test_secrets_match_plain_and_are_redacted(spark):
    h = "0123456789abcdef" * 2
    texts = [f"password: {h}", "secret = token: abcdefg", "api_key='AbC123+/=' x", "AKIA" + "A" * 16 + " é " + h, "AKIA123", None, "", "token=12345", f"TOKEN={h} {h}", "ghp_" + "a1B2" * 9]
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(texts)]
    d = frame(spark, rows)
    found = {r["doc_id"]: r["found"] for r in secret_scan.secret_scan(d).collect()}
    import hashlib

    for i, t in enumerate(texts):
        base = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found[i] if x["kind_no"] < 3)
        assert hashlib.sha256(base.encode()).hexdigest() == plain.base_spans(t)
    assert any(x["kind"] == "provider" for x in found[9])
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(d).collect()}
    assert clean[0] == "[secret]" and clean[3] == "[secret] é [secret]" and clean[5] is None and clean[7] == texts[7]


def test_ownership_tells_copied_examples_from_live_values(spark):
    """Brute force over the added kinds: a value stays if fewer than MANY_OWNERS sources hold it, in however many documents."""
    import re

    rng = random.Random(4)
    pool = ["ghp_" + "".join(rng.choice("aZ0bY1cX2") for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(160):
        k = rng.randrange(len(pool))
        owner = f"s{rng.randrange(k + 1)}"  # value k has up to k + 1 owners
        rows.append((i, f"x {pool[k]} y" + (f" token={pool[k]}" if i % 9 == 0 else ""), "en", None if owner == "s0" else owner, 0))
    pattern = re.compile(r"gh[opsru]_[A-Za-z0-9_-]{16,}")
    owners, repos = {}, {}
    for i, t, _, s, _ in rows:
        for v in set(pattern.findall(t)):
            owners.setdefault(v, set()).add(s)
            repos.setdefault(v, set()).add(i)
    got = {r["doc_id"]: r["found"] for r in secret_scan.secret_scan(frame(spark, rows)).collect()}
    assert {len(o) >= secret_scan.MANY_OWNERS for o in owners.values()} == {True, False}
    for i, t, _, s, _ in rows:
        want = [(m.start(), m.end()) for m in pattern.finditer(t) if len(owners[m[0]]) < secret_scan.MANY_OWNERS]
        assert [(x["start"], x["end"]) for x in got[i] if x["kind"] == "provider"] == want
        assert all((x["n_owners"], x["n_repos"]) == (len(owners[t[x["start"] : x["end"]]]), len(repos[t[x["start"] : x["end"]]])) for x in got[i] if x["kind"] == "provider")


def test_copied_tokens_are_examples(spark):
    t = "key ghp_" + "a1B2" * 9
    rows = [(i, t, "en", f"s{i}", 0) for i in range(secret_scan.MANY_OWNERS)]
    assert all(not r["found"] for r in secret_scan.secret_scan(frame(spark, rows)).collect())


def test_mix_reaches_targets(spark, docs, rows):
    per, pieces = mixing.mix(docs, block=16)
    got = per.collect()
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), block=16)[0].collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[0])
    taken = {r["doc_id"]: r for r in got}
    for ids in by.values():
        assert abs(sum(taken[i]["taken"] for i in ids) - taken[ids[0]]["target"]) <= 1
    assert pieces.groupBy("rid", "epoch", "word_from").count().where("count > 1").count() == 0
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    assert sum(len(plain.words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]


def test_splitting_tree_is_exact():
    pools = [5, 0, 17, 200, 1, 64]
    for quota in (0, 1, 100, 287):
        got = mixing.split_quota(quota, pools, 3, "s")
        assert sum(got) == quota and all(0 <= g <= p for g, p in zip(got, pools))
    drawn = np.array([mixing.split_quota(60, pools, seed, 0) for seed in range(2000)])
    mean, share = drawn.mean(0), np.array(pools) / 287
    spread = np.sqrt(60 * share * (1 - share) * (287 - 60) / 286)  # of a multivariate hypergeometric draw
    assert np.allclose(mean, 60 * share, atol=0.6) and np.allclose(drawn.std(0), spread, rtol=0.1, atol=0.03)


def test_large_hypergeometric_draws_are_not_their_mean():
    got = [mixing.hypergeometric(6 * 10**8, 6 * 10**8, 4 * 10**8, np.random.default_rng(i)) for i in range(300)]
    assert abs(np.mean(got) - 2 * 10**8) < 3000 and 7000 < np.std(got) < 9500
    assert mixing.hypergeometric(3, 2 * 10**9, 2 * 10**9, np.random.default_rng(1)) in (2, 3)


def test_mix_matches_plain(spark, docs, rows):
    """The mix again, from the rows' hashes alone: water level, buckets, blocks, tree, draws and cuts."""
    from pyspark.sql import functions as F

    block, seed, shards, bucket_words = 16, 5, 7, mixing.BUCKET_WORDS
    got = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs, block=block, seed=seed, shards=shards)[0].collect())
    other = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs, block=block, seed=seed + 1, shards=shards)[0].collect())
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text", "source"), F.lit(0)).alias("h")).collect()}
    size = {r[0]: len(plain.words(r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    total = [sum(size[r[0]] for r in rows if r[3] == n) for n in names]
    want = mixing.targets(total, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    spots, streams = [], {}
    for sid, name in enumerate(names):
        assert total[sid] <= bucket_words
        at = 0
        for i in sorted((r[0] for r in rows if r[3] == name and size[r[0]]), key=lambda i: h[i]):
            streams.setdefault(sid, []).append((i, at, at + size[i]))
            at += size[i]
        n = -(-at // block)
        spots += [(sid, 0, k, at * k // n, at * (k + 1) // n) for k in range(n)] if at else []
    keyed = spark.createDataFrame([s[:3] for s in spots], "sid long, bucket int, block long")
    of = lambda salt: F.xxhash64(F.lit(seed + salt), "sid", "bucket", "block")
    keys = {(r[0], r[2]): (r[3] % shards, r[4]) for r in keyed.select("*", F.pmod(of(1), F.lit(shards)), of(2)).collect()}
    taken = dict.fromkeys(size, 0)
    for sid in streams:
        blocks = [(s[2], s[3], s[4]) for s in spots if s[0] == sid]
        quota = min(round(want[sid]), 2 * total[sid])
        epochs, rest = divmod(quota, total[sid])
        least = total[sid] // len(blocks)
        drawn = min(len(blocks), -(-rest // least))
        pools = {}
        for k, a, b in blocks:
            pools.setdefault(keys[sid, k][0], []).append((keys[sid, k][1], k, a, b))
        order = sorted(pools)
        mine = []
        for shard, n in zip(order, mixing.split_quota(drawn, [len(pools[s]) for s in order], seed, sid)):
            mine += [(a, b) for _, _, a, b in sorted(pools[shard])[:n]]
        words, upto = sum(b - a for a, b in mine), 0
        cover = [(a, b, epochs) for _, a, b in blocks]
        for a, b in mine:
            take = (upto + b - a) * rest // words - upto * rest // words
            upto += b - a
            cover.append((a, a + take, 1))
        for i, lo, hi in streams[sid]:
            taken[i] += sum(k * max(0, min(hi, b) - max(lo, a)) for a, b, k in cover)
    assert got == sorted(taken.items()) and got != other


def test_mixed_rows_come_in_their_shards_order(spark, docs):
    per, pieces = mixing.mix(docs, block=16)
    assert pieces.groupBy("shard", "order").agg({"rid": "count"}).count() > mixing.LEAST_SHARDS
    assert pieces.select("shard").distinct().count() == mixing.LEAST_SHARDS
    assert mixing.mixed_documents(docs, block=16).count() == pieces.select("rid", "epoch").distinct().count()


def test_mix_of_repeated_rows_and_many_sources(spark):
    rows = [(1, "a b c d e f", "en", "s", 0)] * 40 + [(i, "x y z w", "en", f"http://{i}", 0) for i in range(2, 400)]
    got = mixing.mix(frame(spark, rows), block=2)[0].collect()
    assert len(got) == 438 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got if r["doc_id"] == 1) - got[0]["target"]) <= 1 or got[0]["doc_id"] != 1


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 90), f"s{i % 3}", i // 2) for i in range(300)]
    got = packing.pack_rows(rows, 50, 2)
    bins: dict = {}
    order = sorted(((min(50, w - k * 50), i, k) for i, w, _, _ in rows for k in range(-(-w // 50))), key=lambda x: (-x[0], x[1], x[2]))
    by = {(i, k): (b, off) for i, k, _, b, off in got}
    for w, i, k in order:
        _, _, s, c = rows[i]
        ok = [(50 - v[0], b) for b, v in bins.items() if 50 - v[0] >= w and c not in v[1] and v[2].count(s) < 2]
        b, off = by[i, k]
        if ok:
            assert b in bins and 50 - bins[b][0] == min(ok)[0]  # the least residual that is compatible
        else:
            assert b not in bins
        v = bins.setdefault(b, [0, set(), []])
        assert off == v[0]
        v[0] += w
        v[1].add(c)
        v[2].append(s)


def test_packing_fills_bins_of_one_source_and_holds_large_clusters_apart():
    rows = [(i, 5, "s", i) for i in range(20_000)]
    got = packing.pack_rows(rows, 4096, limits=packing.source_limits(rows, 4096, packing.MAX_SAME_SOURCE))
    assert len({b for *_, b, _ in got}) == -(-20_000 // (4096 // 5))
    rows = [(i, 5, f"s{i % 4}", "hot" if i % 3 else i) for i in range(3_000)]
    got = packing.pack_rows(rows, 100, limits=packing.source_limits(rows, 100, packing.MAX_SAME_SOURCE))
    hot = [b for i, _, _, b, _ in got if i % 3]
    assert len(set(hot)) == len(hot) == 2_000 and len({b for *_, b, _ in got}) == 2_000


def test_repeated_rows_are_dealt_to_several_shards(spark):
    got = packing.pack(frame(spark, [(1, "a b c", "en", "s", 0)] * 500), shard_words=100)
    assert got.count() == 500 and got.select("shard").distinct().count() > 10
    assert packing.fill(got).agg({"words": "sum"}).first()[0] == 1500


def test_packed_pieces_cover_all_words(docs, rows):
    got = packing.pack(docs, shard_words=3000).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_words"]
    assert total == {r[0]: len(plain.words(r[1])) for r in rows}


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_vocabulary())
    path = str(tmp_path / "ids")
    extra = [(900, "don't STOP!! <|endoftext|> İstanbul ΣΑΣ é 12½ a'b", "en", "s", 0)]
    d = docs.unionByName(frame(spark, extra))
    token_files.write_token_files(d, path, files=3)
    got = token_files.digest(token_files.read_token_files(spark, path)).orderBy("doc_id").collect()
    at = 0
    for r, (i, t, *_) in zip(got, rows + extra):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_token_files_of_repeated_null_and_no_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_vocabulary())
    rows = [(5, "b a", "en", "s", 0), (5, "a", "en", "s", 0), (None, "x", "en", "s", 0), (None, None, None, None, None), (2, "", "en", "s", 0), (5, "a", "en", "s", 0)]
    path = str(tmp_path / "a")
    token_files.write_token_files(frame(spark, rows), path, files=2)
    got = token_files.digest(token_files.read_token_files(spark, path)).orderBy("start").collect()
    order = [(None, None), (None, "x"), (2, ""), (5, "a"), (5, "a"), (5, "b a")]
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    token_files.write_token_files(frame(spark, rows).where("false"), str(tmp_path / "b"))
    assert token_files.digest(token_files.read_token_files(spark, str(tmp_path / "b"))).count() == 0


def test_token_files_hold_indexes_and_bloom_filters_that_prune(spark, tmp_path):
    path = str(tmp_path / "ids")
    d = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    token_files.write_token_files(d, path, files=4)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f for f in (tmp_path / "ids").iterdir() if f.suffix == ".orc"]
    assert len(files) == 4
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        kinds = {s.getKind().toString() for stripe in reader.getStripes() for s in reader.rows().readStripeFooter(stripe).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds

    def rows_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    assert rows_read(spark.read.orc(path).select("doc_id")) == 20_000
    hit, miss = token_files.lookup(spark, path, [30_000]), token_files.lookup(spark, path, [30_001])
    assert [r["doc_id"] for r in hit.collect()] == [30_000] and miss.count() == 0
    assert rows_read(hit) <= 1000 and rows_read(miss) == 0  # 30,001 lies between ids: only the Bloom filter can tell


def test_token_counts_match_plain():
    scores = {"▁": -3.0, "▁ab": -1.0, "a": -2.0, "b": -2.0, "abc": -1.5, "c": -2.5, "▁a": -1.2}
    count = token_counts.TrieCounter(scores, max_nodes=20)

    def best(w):
        w = token_counts.MARK + w
        f = [(0.0, 0)] + [None] * len(w)
        for i in range(1, len(w) + 1):
            f[i] = max((f[j][0] + scores.get(w[j:i], token_counts.UNKNOWN if i - j == 1 else -1e9), f[j][1] - 1) for j in range(i))
        return -f[-1][1]

    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 8)))
        assert count(w) == best(w)


def test_long_words_need_no_more_nodes():
    scores = token_counts.load_scores(token_counts.default_vocabulary())
    deep, flat = token_counts.TrieCounter(scores), token_counts.TrieCounter(scores)
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoin shrdlu-é漢").strip() or "e" for _ in range(n)) for n in (62, 63, 64, 65, 130, 700, 5000)]
    for w in words:
        w = token_counts.MARK + w
        f = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            f.append(max((f[j][0] + scores.get(w[j:i], token_counts.UNKNOWN if i - j == 1 else -1e9), f[j][1] - 1) for j in range(max(0, i - deep.longest), i)))
        assert deep(w[1:]) == -f[-1][1]
    flat("".join(rng.choice("abc") for _ in range(300_000)))
    assert len(flat.children) <= token_counts.DEPTH + 1 and not flat.terminal


def test_token_counts_over_documents(docs, rows):
    count = token_counts.TrieCounter(token_counts.load_scores(token_counts.default_vocabulary()))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect()}
    assert got == {r[0]: (len(plain.words(r[1])), sum(map(count, plain.words(r[1])))) for r in rows}


def test_small_world_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[500:560] = x[500] + 0.03 * rng.normal(size=(60, 24))  # a tight group
    g = hnsw.Graph(np.arange(1500), x)
    rows, points, recall, _ = embedding_dedup.search_shard(g, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = (u @ u.T) >= 0.95
    assert len(rows) >= 0.98 * truth.sum() and recall >= 0.99


def _losing(g, lost):
    """g, whose beams never meet the lost (query row, point) pairs; rows are told by their vectors."""
    near = g.near

    def beams(q, *a):
        rows, points, wide = near(q, *a)
        keep = [(int((g.unit @ q[r]).argmax()), int(p)) not in lost for r, p in zip(rows, points)]
        return rows[keep], points[keep], wide

    g.near = beams
    return g


@pytest.mark.parametrize("group", [0, 300])
def test_audit_counts_no_self_matches_and_no_group_for_others(group):
    # beams lose links of a few pairs; self-matches, or the pairs of a group, hid that
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x[:group] = x[0] + 0.02 * rng.normal(size=(group, 24))
    x[890:] = x[880:890] + 0.01 * rng.normal(size=(10, 24))
    g = hnsw.Graph(np.arange(900), x)
    at = {int(i): k for k, i in enumerate(g.ids)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = set(map(tuple, np.argwhere(u @ u.T >= 0.95).tolist()))
    links = lambda got: {(r, int(g.ids[p])) for r, p in zip(got[0].tolist(), got[1].tolist())}
    one = {(at[884], at[894])}
    assert links(embedding_dedup.search_shard(_losing(g, one), x)) == truth
    # a part drawn, where there are enough of both classes
    every = {(at[i], at[j]) for i in range(880, 900) for j in range(880, 900) if i != j}
    assert links(embedding_dedup.search_shard(_losing(g, every), x, audit=4, ids=np.arange(900))) == truth


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_tight_group_and_many_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 16))
    x[3000:4000] = x[2000:3000] + 0.02 * rng.normal(size=(1000, 16))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    t = u @ u.T >= 0.95
    np.fill_diagonal(t, False)
    pairs = np.argwhere(t)
    root = plain.roots(range(6000), pairs[pairs[:, 0] > pairs[:, 1]].tolist())
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(d).collect()}
    found, n = sum(v[0] for v in got.values()), int(t.sum())
    assert found <= n and found >= 0.995 * n
    assert sum(got[i][1] == root[i] for i in got) >= 0.995 * 6000 and all(got[i][1] >= root[i] for i in got)
    audit = embedding_dedup.embedding_audit(d).collect()
    assert sum(r["queries"] for r in audit) == 6 * (d.select("embedding").distinct().count())
    assert all(r["beam"] == 0 or r["recall"] >= embedding_dedup.RECALL or r["beam"] >= embedding_dedup.MAX_BEAM for r in audit)


def test_vectors_of_repeated_and_null_ids_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in embedding_dedup.embedding_links(d).collect())
    assert got == [(-1, 0, -1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4)]


def test_embedding_links_match_plain(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[40:60] = x[40] + 0.02 * rng.normal(size=(20, 8))
    x[70] = x[71]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    t = u @ u.T >= 0.95
    np.fill_diagonal(t, False)
    root = plain.roots(range(120), np.argwhere(t).tolist())
    assert got == {i: (int(t[i].sum()), root[i], root[i] == i) for i in range(120)} | {i: (0, i, True) for i in range(200, 205)}


def test_perplexity_matches_plain(spark):
    rng = random.Random(4)
    vocab = ["aa", "bb", "cc", "dd", "ee"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30)), "en", "s", 0) for i in range(40)]
    rows += [(100, "zz yy xx ww vv uu", "en", "s", 0), (101, "", "en", "s", 0), (102, None, "en", "s", 0)]
    d = frame(spark, rows)
    p = {r["doc_id"]: r for r in kneser_ney.perplexity(d, d.where("doc_id < 40").select("doc_id")).collect()}
    held = {i for i, r in p.items() if r["held_out"]}
    train = [rows[i][1].split() for i in range(40) if i not in held]
    from collections import Counter

    c2 = Counter((a, b) for w in train for a, b in zip(["<s>", *w], w))
    n2 = [sum(v == k for v in c2.values()) for k in (1, 2, 3, 4)]
    cont = Counter(b for _, b in c2)
    n1 = [sum(v == k for v in cont.values()) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(n2), kneser_ney.discounts(n1)
    disc = lambda c, d: 0.0 if not c else d[min(c, 3) - 1]
    ctx = Counter()
    for (a, _), v in c2.items():
        ctx[a] += v
    types, vocabulary = sum(cont.values()), len({*[a for a, _ in c2], *[b for _, b in c2]})
    rare = (d1[0] * n1[0] + d1[1] * n1[1] + d1[2] * (vocabulary - n1[0] - n1[1])) / types

    def logp(a, b):
        p1 = max(cont[b] - disc(cont[b], d1), 0) / types + rare / (vocabulary + 1) + 1e-12
        if not ctx[a]:
            return -np.log(p1)
        g = sum(disc(v, d2) for (x, _), v in c2.items() if x == a) / ctx[a]
        return -np.log(max(c2[a, b] - disc(c2[a, b], d2), 0) / ctx[a] + g * p1)

    for i in [*range(40), 100]:
        w = rows[i][1].split() if i < 40 else rows[40][1].split()
        want = sum(logp(a, b) for a, b in zip(["<s>", *w], w)) / len(w)
        assert p[i]["log_perplexity"] == pytest.approx(want, rel=1e-9)
    assert p[101]["log_perplexity"] is None and p[102]["log_perplexity"] is None
    out = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(d, d.where("doc_id < 40").select("doc_id")).collect()}
    assert not out[100] or not held


def test_counts_are_exact_over_a_large_vocabulary(spark):
    # 100,000 words, each bigram once: an unseen bigram of seen words must not meet the count of another
    d = spark.range(5_000).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 19), i -> concat('w', id * 20 + i)), ' ') AS text", "'en' AS lang")
    odd = spark.range(5_000).selectExpr("id + 100000 AS doc_id", "array_join(transform(sequence(19, 0, -1), i -> concat('w', id * 20 + i)), ' ') AS text", "'en' AS lang")
    p = {r["doc_id"]: r for r in kneser_ney.perplexity(d.unionByName(odd), d.select("doc_id")).select("doc_id", "log_perplexity", "held_out").collect()}
    train = [i for i in range(5_000) if not p[i]["held_out"]]
    # reversed texts hold no bigram of the model: all have the one perplexity of their words, but for the first
    assert len({round(p[100_000 + i]["log_perplexity"], 9) for i in train}) == 1
    assert len({round(p[i]["log_perplexity"], 9) for i in train}) == 1 and p[train[0]]["log_perplexity"] < p[100_000 + train[0]]["log_perplexity"]


def test_classifier_keeps_by_language_quantile(spark):
    rng = random.Random(12)
    good = {"en": [f"e{i}" for i in range(40)], "de": [f"d{i}" for i in range(400)], None: [f"n{i}" for i in range(60)]}
    rows, trusted = [], []
    for k, (lang, vocab) in enumerate(good.items()):
        for i in range(150):
            rows.append((k * 1000 + i, " ".join(rng.choice(vocab) for _ in range(25)), lang, "s", 0))
            trusted.append(k * 1000 + i)
    rows += [(9000 + i, " ".join(f"junk{rng.randrange(10**6)}" for _ in range(25)), "en", "s", 0) for i in range(20)]
    rows += [(9100, "free words", "fr", "s", 0), (9100, "free words", "fr", "s", 0), (None, rows[0][1], "en", "s", 0), (9101, None, "en", "s", 0)]
    d = frame(spark, rows)
    t = d.select("doc_id").where("doc_id < 9000")
    scored = {r["doc_id"]: r for r in kneser_ney.perplexity(d, t).collect()}
    out = kneser_ney.classify(d, t).collect()
    for lang in good:
        held = sorted(r["log_perplexity"] for r in scored.values() if r["held_out"] and r["lang"] == lang)
        for r in out:
            if r["lang"] == lang and r["log_perplexity"] is not None:
                assert r["threshold"] == pytest.approx(held[max(0, int(np.ceil(kneser_ney.QUANTILE * len(held))) - 1)] + kneser_ney.SLACK)
                assert r["kept"] == (r["log_perplexity"] <= r["threshold"] + kneser_ney.SHORT / r["n_words"])
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert kept.count(9100) == 2 and 9101 not in kept and not any(9000 <= (i or 0) < 9020 for i in kept) and None in kept
    assert sum(i is not None and i < 9000 for i in kept) >= 440


def test_all_training_texts_are_counted(spark):
    # 24,000 trusted texts of three words, each with a word of its own: seen words are likelier than unseen ones
    d = spark.range(24_000).selectExpr("id AS doc_id", "concat('a w', id, ' b') AS text", "'en' AS lang")
    more = spark.range(24_000).selectExpr("id + 100000 AS doc_id", "concat('a w', id, ' b') AS text", "'en' AS lang")
    other = spark.createDataFrame([(200_000, "a unseen b", "en")], "doc_id long, text string, lang string")
    p = {r["doc_id"]: r for r in kneser_ney.perplexity(d.unionByName(more).unionByName(other), d.select("doc_id")).select("doc_id", "log_perplexity", "held_out").collect()}
    train = [i for i in range(24_000) if not p[i]["held_out"]]
    assert len(train) > 20_000
    assert sum(p[100_000 + i]["log_perplexity"] >= p[200_000]["log_perplexity"] for i in train) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.lists(st.integers(0, 100_000), max_size=60))
def test_codes_round_trip(keys, counts):
    k = np.array(sorted(keys), dtype=np.uint64)
    c = np.array(counts, dtype=np.int64)
    data = blocks.pack_keys(k) + blocks.pack_counts(c)
    got, at = blocks.unpack_keys(data)
    assert got.tolist() == k.tolist() and blocks.unpack_counts(data, at)[0].tolist() == counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \t\x0b\n é", max_size=30), max_size=6))
def test_hashes_tell_words_apart(texts):
    h, first = textkit.word_hashes([t.encode() for t in texts])
    w = [x for t in texts for x in t.encode().split()]
    assert len(h) == len(w) and first[-1] == len(w)
    assert len({(a, b) for a, b in zip(h.tolist(), w)}) == len(set(w)) == len(set(h.tolist()))


def test_long_texts_and_long_words_hash_as_short_ones():
    word, long = b"abc", b"xy" * (3 * textkit._CHUNK // 2)
    text = b" ".join([word, long] + [b"w%d" % (i % 50) for i in range(300_000)] + [long, word])
    h, first = textkit.word_hashes([b"abc w7", text, long])
    want, _ = textkit.word_hashes([b"abc w7"])
    w = text.split()
    assert first.tolist() == [0, 2, 2 + len(w), 3 + len(w)]
    assert h[2] == want[0] and h[1 + len(w)] == want[0] and h[3] == h[len(w)] == h[-1]
    assert {x for x, y in zip(w, h[2:-1].tolist()) if y == want[1]} == {b"w7"}


def test_components_match_plain(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)]
    ids = {x for e in edges for x in e}
    want = plain.roots(ids, edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for i in got} and {i for i in ids if want[i] != i} <= set(got)


def test_pipeline_edge_cases(spark, sf_dir):
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, source string, n_chars long, gone string, shard int, kept boolean, doc_id_2 long"
    good = " ".join(f"the word{i} and of to in" for i in range(40)) + "."
    rows = [(1, good, "en", "s", 5, "x", 1, True, 2), (1, good, "en", "s", 5, "x", 1, True, 2), (2, good, None, None, None, None, None, None, None), (None, good + " more", "en", "s", 1, None, None, None, None)]
    rows += [(3, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, "x", 1, True, 2), (5, (good + "\n") * 2, "en", "t", 0, "", 0, False, 0), (6, " ".join(f"long{i} the of and to" for i in range(60_000)), "en", "t", 0, "", 0, False, 0)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        for k, (name, stage) in enumerate(p.STAGES):
            before, docs = docs, spark.createDataFrame(stage(spark, docs, sf_dir).collect(), names if k < 4 else None) if not docs.isEmpty() else stage(spark, docs, sf_dir)
            if k < 4:
                assert docs.columns == before.columns
            ids = [r["doc_id"] for r in docs.collect()]
            if name == "ngram_join" and ids:
                assert sorted(i or 0 for i in ids).count(1) == 2 and 2 not in ids


def test_pipeline_matches_plain_steps(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "ngram_join", "secret_scan", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = p.STAGES[0][1](spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and all(plain.quality(rows[i]["text"])[5] is False for i in kept)
    two = p.STAGES[1][1](spark, out, sf_dir).cache()
    want = {c for _, _, c in plain.ngram_join([(i, rows[i]["text"]) for i in sorted(kept)])}
    assert {r["doc_id"] for r in two.collect()} == want
    three = p.STAGES[2][1](spark, two, sf_dir).cache()
    none = plain.base_spans("")
    assert all(plain.base_spans(r["text"]) == none for r in three.collect())
    four = p.STAGES[3][1](spark, three, sf_dir).cache()
    sizes = sum(len(plain.words(r["text"])) for r in three.collect())
    assert abs(sum(len(plain.words(r["text"])) for r in four.collect()) - 1.5 * sizes) <= 20
    five = p.STAGES[4][1](spark, four, sf_dir)
    assert five.agg({"n_words": "sum"}).first()[0] == sum(len(plain.words(r["text"])) for r in four.collect())


def test_small_graphs_are_built_without_beams_and_beams_open_several_points(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    steps = []
    search = hnsw.Level.search
    monkeypatch.setattr(hnsw.Level, "search", lambda *a: steps.append(a[3]) or search(*a))
    g = hnsw.Graph(np.arange(1200), x)
    assert not steps
    monkeypatch.setattr(hnsw, "SMALL", 300)
    by_beams = hnsw.Graph(np.arange(1200), x)
    assert steps
    sims = g.unit @ g.unit.T
    want = np.argsort(-sims, 1)[:, :10]
    for graph in (g, by_beams):
        ids, got = graph.levels[0].search(graph.unit, graph.entries(graph.unit, 0), 64)
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids.tolist() for r in [np.array(r)]) and (np.diff(got, axis=1) <= 0).all()
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), want.tolist())]) > 0.98
