"""Operators against brute force, batch against stream, and failure handling."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import bpe as B
from lexiloom.operators import dedup as D
from lexiloom.operators import enrich as EN
from lexiloom.operators import graph as GR
from lexiloom.operators import neighbours as NB
from lexiloom.operators import ordering as O
from lexiloom.operators import profile as R
from lexiloom.operators import tokens as K
from lexiloom.operators import vectors as VE
from lexiloom.session import scratch_path
from lexiloom.sources import arrow_files as A
from lexiloom.sources import jsonl as J
from lexiloom.sources import manifest as M
from lexiloom.streaming import frames as FR


def planted_signatures(seed: int) -> dict[int, list[int]]:
    """Families of near copies, a hot family, exact copies and unrelated rows sharing one band."""
    rng = random.Random(seed)
    base = lambda: [rng.randrange(10**6) for _ in range(100)]
    sigs: dict[int, list[int]] = {}
    hot, shared = base(), base()[:5]
    for doc in range(400):
        kind = rng.random()
        if kind < 0.4:  # near copies of one document, 0 to 30 slots changed
            row = list(hot)
            for slot in rng.sample(range(100), rng.randrange(0, 31)):
                row[slot] = rng.randrange(10**6)
        elif kind < 0.5:
            row = list(hot)
        elif kind < 0.8:  # unrelated but in one common band
            row = shared + base()[5:]
        else:
            row = base()
        sigs[doc] = row
    return sigs


def brute_drops(sigs: dict[int, list[int]]) -> set[int]:
    gone = set()
    for a, b in itertools.combinations(sorted(sigs), 2):
        x, y = sigs[a], sigs[b]
        band = any(x[i : i + 5] == y[i : i + 5] for i in range(0, 100, 5))
        if band and sum(p == q for p, q in zip(x, y)) >= 80:
            gone.add(b)
    return gone


@pytest.mark.parametrize("limit", [4, 1000])
def test_near_duplicates_match_brute_force(spark, limit):
    sigs = planted_signatures(limit)
    df = spark.createDataFrame(list(sigs.items()), "doc bigint, sig array<int>")
    found = {r.doc for r in D.near_duplicates(df, bucket_limit=limit, salt=3).collect()}
    assert found == brute_drops(sigs)


def test_dedup_is_pairwise_not_transitive(spark):
    a = list(range(100))
    b = a[:85] + [-i for i in range(1, 16)]  # 85 slots in common with a
    c = [-100 - i for i in range(15)] + b[15:]  # 85 with b, 70 with a
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc bigint, sig array<int>")
    assert sorted(r.doc for r in D.near_duplicates(df).collect()) == [2, 3]


def test_short_texts_always_stay(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "id bigint, text string")
    assert D.drop_near_duplicates(df, "id").count() == 3


def test_minhash_estimates_jaccard(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = [rng.choice(words) for _ in range(300)]
    b = a[:240] + [rng.choice(words) for _ in range(60)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "id bigint, text string")
    s = {r.doc: r.sig for r in D.signatures(df, "id").collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    exact = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert sum(x == y for x, y in zip(s[1], s[2])) / 100 == pytest.approx(exact, abs=0.15)


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_packing(spark, width):
    rng = random.Random(width)
    docs = [(i, [rng.randrange(5, 99) for _ in range(rng.randrange(0, 40))]) for i in range(0, 200, 3)]
    df = spark.createDataFrame(docs, "id bigint, ids array<int>").repartition(5)
    stream = [t for _, ids in docs for t in [3, *ids, 4, 4]]
    stream += [1] * (-len(stream) % 16)
    blocks = {r.block_id: r.ids for r in K.pack_blocks(df, "id", block_len=16, width=width).collect()}
    assert [t for b in sorted(blocks) for t in blocks[b]] == stream
    counts = K.bigram_counts(K.pack_blocks(df, "id", block_len=16, width=width))
    assert {(r.x, r.y): r.nxy for r in counts.collect()} == Counter(zip(stream, stream[1:]))


@pytest.mark.parametrize("ids", ["sparse", "lumpy", "negative"])
def test_packing_with_sparse_keys(spark, ids):
    """Random 63-bit keys, or a dense lump with far outliers, fill the ranges alike."""
    rng = random.Random(3)
    keys = {
        "sparse": [rng.getrandbits(63) for _ in range(300)], "lumpy": [*range(295), 2**40, 2**50, 2**60, 2**62, -(2**62)],
        "negative": [-k for k in [rng.getrandbits(63) for _ in range(300)]],
    }[ids]
    docs = sorted((k, [rng.randrange(5, 99) for _ in range(rng.randrange(0, 9))]) for k in keys)
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "id bigint, ids array<int>")
    stream = [t for _, d in docs for t in [3, *d, 4, 4]]
    stream += [1] * (-len(stream) % 16)
    blocks = {r.block_id: r.ids for r in K.pack_blocks(df, "id", block_len=16, width=2).collect()}
    assert [t for b in sorted(blocks) for t in blocks[b]] == stream
    sized = df.select("id", F.size("ids").alias("n"))
    groups = O._range_bounds(sized, "id", 10)
    assert len(groups) == 1 and len(groups[0]) >= 25


def test_packing_example(spark):
    df = spark.createDataFrame([(1, [7, 8, 9]), (2, [10, 11])], "id bigint, ids array<int>")
    row = K.pack_blocks(df, "id").first()
    assert row.ids[:11] == [3, 7, 8, 9, 4, 4, 3, 10, 11, 4, 4] and row.ids[11:] == [1] * 501
    assert len(K.blocks_disjoint(K.pack_blocks(df, "id")).first().x) == 511
    assert K.blocks_overlap(K.pack_blocks(df, "id")).count() == 0


def test_global_rank_with_hot_bucket(spark):
    rows = [(i, 7 if i % 3 else i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, n int")
    out = O.length_batches(df, F.col("n"), 16, "id")
    ranks = [(r.rank, r.len) for r in out.collect()]
    assert sorted(k for k, _ in ranks) == list(range(500))
    assert [n for _, n in sorted(ranks)] == sorted(n for _, n in rows)


def greedy_bpe(words: dict[str, int], n: int) -> list[tuple[str, str]]:
    table = {tuple(B.SPACE_MARK + w): f for w, f in words.items()}
    merges = []
    for _ in range(n):
        counts = Counter()
        for parts, f in table.items():
            for pair in zip(parts, parts[1:]):
                counts[pair] += f
        best = min(((-c, p) for p, c in counts.items() if c >= 2), default=None)
        if best is None:
            break
        merges.append(best[1])
        fresh = {}
        for parts, f in table.items():
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == best[1]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            fresh[tuple(out)] = fresh.get(tuple(out), 0) + f
        table = fresh
    return merges


@pytest.mark.parametrize("candidates", [8, 512])
def test_batched_merges_equal_greedy_merges(spark, candidates):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    assert B.train_bpe(B.word_table(df), 15, candidates=candidates) == greedy_bpe(Counter(words), 15)


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([("low lower lowest new newer",), ("low low new",)], "text string")
    words = B.word_table(df)
    merges = B.train_bpe(words, 10)
    vocab = B.build_vocab(B.alphabet(words), merges)
    ids = df.withColumn("ids", B.encoder(merges, vocab)("text"))
    assert [r[0] for r in ids.select(B.decode(F.col("ids"), vocab)).collect()] == [r.text for r in df.collect()]


@pytest.mark.parametrize("blocks", [1, 5])
def test_nearest_neighbours_match_brute_force(spark, blocks):
    x = np.random.default_rng(3).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-sims[i])[:4]}
    got = VE.nearest_neighbours(df, "id", "v", k=4, blocks=blocks)
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_pagerank_sums_to_one_and_converges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("d", "a")], "src string, dst string")
    ranks = {r.node: r.rank for r in GR.pagerank(edges, iterations=25, tolerance=1e-4).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["c"] > ranks["b"] > ranks["d"]


def test_bfs_page_budget(spark):
    edges = spark.createDataFrame([(i, j) for i in range(20) for j in (2 * i + 1, 2 * i + 2)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,)], "src bigint")
    levels = GR.bfs_expand(edges, seeds, max_depth=5, max_pages=6)
    assert sorted((r.depth, r.src) for r in levels.collect()) == [(1, 0), (2, 1), (2, 2), (3, 3), (3, 4), (3, 5)]


def test_enrichment_isolates_and_redrives(spark):
    from lexiloom.plans.evals import stub_client

    state = spark.createDataFrame([(b, f"1. c{b} (PageRank: 0.5)") for b in range(8)], "batch bigint, prompt string")

    def client(prompt: str) -> str:
        if "c3 " in prompt:
            raise TimeoutError("down")
        return "not json" if "c5 " in prompt else stub_client(prompt)

    rows, ledger = EN.enrich(state, client, wait=0.0)
    assert sorted(r.batch for r in rows.collect()) == [0, 1, 2, 4, 6, 7]
    assert Counter(r["round"] for r in ledger.filter("not ok").collect()) == {0: 2, 1: 2, 2: 2}
    assert EN.completion_rate(state, ledger).first().completed_pct == 75.0


def test_streamed_frames_equal_batch(spark):
    rows = [(f"r{i}", s, w) for i in range(6) for s, w in enumerate([". ", "好", f" w{i}", " end", FR.DONE])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "request_id string, seq int, frame string")
    want = {(r.request_id, r.answer) for r in FR.assemble_frames(df, "request_id").collect()}
    src, out, state = (scratch_path(spark, n) for n in ("frames", "answers", "answers-state"))
    df.repartition(3).write.json(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src)
    query = FR.assemble_stream(stream, timeout_ms=None).writeStream.format("parquet").option("path", out)
    query.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert {(r.request_id, r.answer) for r in got.collect()} == want and got.filter("is_done").count() == 6


def test_numbered_quarantine(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("  ",)], "value string").coalesce(1).write.text(path)
    out = J.quarantine(J.numbered_lines(spark, path)).orderBy("line_no").collect()
    assert [(r.line_no, r.problem) for r in out] == [(1, None), (2, "invalid json"), (3, "blank line")]


def test_feather_schema_and_config_mismatch(spark):
    path = scratch_path(spark, "feather")
    files = A.write_feather(spark.range(10), path)
    assert A.feather_schema(files.first().file).names == ["id"]
    assert A.read_feather(spark, path, "id bigint").count() == 10
    old = spark.createDataFrame([("top_k", "16"), ("model", "a")], "name string, value string")
    new = spark.createDataFrame([("top_k", "32"), ("model", "a")], "name string, value string")
    assert [r.name for r in M.config_mismatches(old, new).collect()] == ["top_k"]


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_exact_quantiles_match_numpy(spark, limit):
    """Ties at both ends of an interval, one hot value, long tails, nulls."""
    rng = random.Random(limit)
    xs = [rng.gauss(0, 1e6) for _ in range(1500)] + [7.5] * 900 + [rng.choice([-1.0, 2.0]) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 5, "x double")
    probs = [0.0, 0.06, 0.25, 0.5, 0.731, 0.85, 1.0]
    assert np.allclose(O.exact_quantiles(df, "x", probs, limit), np.quantile(xs, probs), rtol=1e-12)
    assert O.exact_quantiles(df.filter("x IS NULL"), "x", [0.5]) == [None]


@pytest.mark.parametrize("n_codes, limit", [(5000, 4096), (60, 5)])
def test_codebook_of_several_blocks(spark, n_codes, limit):
    rng = np.random.default_rng(5)
    codes, rows = rng.normal(size=(n_codes, 4)), rng.normal(size=(40, 4))
    codes[n_codes - 1] = codes[3]  # a tie across blocks goes to the first code
    rows[0] = codes[3] * 2
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "code int, v array<double>")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, v array<double>")
    sims = (rows / np.linalg.norm(rows, axis=1)[:, None]) @ (codes / np.linalg.norm(codes, axis=1)[:, None]).T
    got = {r["id"]: r for r in VE.codebook_assign(df, book, "v", "code", limit).collect()}
    assert got[0]["code"] == 3
    assert all(got[i]["code"] == sims[i].argmax() for i in range(1, 40))
    best = {r["id"]: r["max_sim"] for r in VE.max_anchor_sim(df, book, "v", "code", limit).collect()}
    assert np.allclose([best[i] for i in range(40)], sims.max(axis=1))


def test_loss_smooth_against_direct_fits(spark):
    """Uneven and repeated steps, short epochs and an epoch of one step only, in a long curve of 30,000 steps."""
    rng = np.random.default_rng(5)
    curves = {
        1: np.cumsum(rng.integers(1, 9, 30_000)), 2: np.sort(rng.integers(0, 40, 300)), 3: np.array([7, 9, 12]),
        4: np.full(20, 5), 5: np.concatenate([np.arange(50), 10_000 + np.arange(50)]), 6: np.arange(5) * 3,
    }
    losses = {e: rng.normal(size=len(x)) + np.sin(x / 50) for e, x in curves.items()}
    rows = [(e, int(x), float(y)) for e, xs in curves.items() for x, y in zip(xs, losses[e])]
    df = spark.createDataFrame([*rows, (1, 3, None), (None, 1, 1.0)], "epoch int, step int, loss double")
    got: dict = {}
    for r in R.loss_smooth(df, points=20).collect():
        got.setdefault(r.epoch, []).append((r.step, r.loss, r.smooth))
    assert set(got) == set(curves)
    for e, x in curves.items():
        x, y = x.astype(float), losses[e]
        n = len(x)
        k = min(n, max(4, int(0.2 * n)))
        at, fits = np.linspace(x[0], x[-1], 21), []
        for p in at:
            far = np.abs(x - p)
            reach = np.sort(far)[k - 1]
            keep = far < reach
            if n < 4 or not keep.any():
                fits.append(y.mean())
                continue
            u = (x[keep] - p) / reach
            w = (1 - np.abs(u) ** 3) ** 3
            s = [(w * u**j).sum() for j in range(5)]
            normal = np.array([s[0:3], s[1:4], s[2:5]])
            t = np.array([(w * u**j * y[keep]).sum() for j in range(3)])
            fits.append(np.linalg.solve(normal, t)[0] if np.linalg.det(normal) > 1e-9 * s[0] ** 3 else t[0] / s[0])
        want = np.interp(x, at, fits) if x[0] < x[-1] else np.full(n, fits[0])
        assert len(got[e]) == n
        np.testing.assert_allclose(sorted(got[e]), sorted(zip(x, y, want)), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_bpe_merges_one_at_a_time(spark, letters):
    """Few letters make the same symbol from different parts and many ties."""
    rng = random.Random(len(letters))
    words = Counter("".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(60))
    text = " ".join(w for w, n in words.items() for _ in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    assert B.train_bpe(B.word_table(df), n_merges=25) == greedy_bpe(words, 25)


def test_bpe_batch_ends_where_a_symbol_is_spelt_anew():
    ranked = [("a", "bc", 9), ("x", "y", 8), ("abc", "d", 7)]
    assert B.independent_prefix(ranked, True, 10) == [("a", "bc"), ("x", "y"), ("abc", "d")]
    assert B.independent_prefix(ranked, True, 10, {"bc", "abc"}) == [("a", "bc")]


def test_spreads_keep_digits_with_large_means(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) + 1e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = VE.embedding_collapse(df, "v").first()
    cov = np.cov(x.T)
    assert got["var_loss"] == pytest.approx(np.maximum(1 - np.sqrt(x.var(axis=0) + 1e-4), 0).mean(), rel=1e-4)
    assert got["cov_loss"] == pytest.approx(((cov**2).sum() - (np.diag(cov) ** 2).sum()) / 4, rel=1e-4)
    losses = spark.createDataFrame([(1, float(v)) for v in x[:, 0]], "token int, loss double")
    assert R.token_loss_profile(losses, digits=9).first()["sd_loss"] == pytest.approx(x[:, 0].std(ddof=1), rel=1e-6)


def token_blocks(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "block_id long, ids array<int>")


def tokens_at(spark, path):
    return [r.token for r in A.read_token_bin(spark, path, 3).orderBy("pos").collect()]


def test_token_parts_appear_with_the_commit(spark):
    path = scratch_path(spark, "token-parts")
    ids = [[b * 10 + i for i in range(4)] for b in range(20)]
    flat = [i for b in ids for i in b]
    A.write_token_bin(token_blocks(spark, ids), path, parts=7)
    assert tokens_at(spark, path) == flat
    # A run with fewer parts leaves none of the older ones, and an appending one goes on behind the last.
    A.write_token_bin(token_blocks(spark, ids[:5]), path, parts=2)
    assert tokens_at(spark, path) == flat[:20] and len(A.list_files(spark, path, ".bin")) == len(A.committed_parts(path)) == 2
    A.write_token_bin(token_blocks(spark, ids[5:]), path, parts=3, append=True)
    assert tokens_at(spark, path) == flat
    assert [p["first"] for p in A.committed_parts(path)] == sorted({p["first"] for p in A.committed_parts(path)})


@pytest.mark.parametrize("append", [False, True])
def test_a_failed_run_changes_nothing(spark, append):
    path = scratch_path(spark, "token-fails")
    A.write_token_bin(token_blocks(spark, [[1, 2], [3]]), path, parts=1)
    with pytest.raises(Exception, match="16 bits"):
        A.write_token_bin(token_blocks(spark, [[4], [5], [70_000]]), path, parts=3, append=append)
    assert tokens_at(spark, path) == [1, 2, 3] and len(A.list_files(spark, path, ".bin")) == 1
    A.write_token_bin(token_blocks(spark, []), path, parts=2, append=True)
    assert tokens_at(spark, path) == [1, 2, 3]


def test_only_listed_attempts_are_read(spark):
    """Of two attempts of a task, as speculation makes them, the accepted one counts."""
    path = scratch_path(spark, "token-attempts")
    writer = A.TokenBinWriter(path, True)
    fs, root = A.open_fs(path)
    fs.create_dir(f"{root}/{writer.run}", recursive=True)
    messages = []
    for name, ids in (("part-000000-0.bin", [9, 9, 9]), ("part-000000-7.bin", [1, 2]), ("part-000001-8.bin", [3])):
        batch = A.pa.RecordBatch.from_pydict({"ids": A.pa.array([ids], A.pa.list_(A.pa.int32()))})
        with fs.open_output_stream(f"{root}/{writer.run}/{name}") as stream:
            n = writer.encode([batch], stream)
        messages.append(A.PartMessage(int(name[5:11]), f"{writer.run}/{name}", n))
    assert A.committed_parts(path) is None
    writer.commit([messages[2], None, messages[1]])
    assert tokens_at(spark, path) == [1, 2, 3]


def test_feather_overwrites_and_appends(spark):
    path = scratch_path(spark, "feather-parts")
    A.write_feather(spark.range(0, 100, 1, 6), path)
    A.write_feather(spark.range(0, 10, 1, 2), path)
    assert A.write_feather(spark.range(10, 15, 1, 1), path, append=True).count() == 3
    assert sorted(r.id for r in A.read_feather(spark, path, "id bigint").collect()) == list(range(15))


@pytest.mark.parametrize("cells,block", [(1, 5), (9, 4), (9, 10_000)])
def test_cell_index_against_brute_force(spark, cells, block):
    """Clustered vectors, one of which a third of the rows share; all cells are exact, a few reach the recall."""
    rng = np.random.default_rng(cells)
    centre = rng.normal(size=(9, 6)) * 4
    rows = [(i, (centre[i % 9] + rng.normal(size=6)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(500, None)]
    units = NB.unit_rows(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v")
    index = NB.CellIndex(units, 4, cells, block)
    assert index.rows.count() == 120 + 4  # of the shared vector five rows answer for all
    queries = units.filter("id % 3 = 0")
    mat = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}
    got = {}
    for r in index.search(queries, len(index.centres)).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.sim))
    assert set(got) == {i for i in mat if i % 3 == 0}
    for src, found in got.items():
        sims = {j: float(mat[src] @ mat[j]) for j in mat if j != src}
        best = sorted(sims.values(), reverse=True)[:4]
        assert [round(s, 9) for _, _, s in sorted(found)] == [round(s, 9) for s in best]
        assert len({d for _, d, _ in found}) == 4 and all(abs(sims[d] - s) < 1e-9 for _, d, s in found)
    probes = index.probes_for(0.95)
    near = {(r.src, r.dst) for r in index.search(queries, probes).collect()}
    true = {(s, d) for s, found in got.items() for _, d, _ in found}
    assert 1 <= probes <= len(index.centres) and len(near & true) >= 0.9 * len(true)
    assert index.search(units.limit(0), 2).count() == 0


def test_cell_index_of_nothing(spark):
    units = NB.unit_rows(spark.createDataFrame([], "k long, v array<double>"), "k", "v")
    index = NB.CellIndex(units, 3)
    assert index.n == 0 and index.probes_for(0.9) == 1


@pytest.mark.parametrize("candidates,segments", [(2048, 100_000), (7, 100_000), (40, 60), (5, 0)])
def test_bpe_until_nothing_repeats(spark, candidates, segments):
    """Whole runs: in one batch, in many, with stretches that go on, and without any."""
    rng = random.Random(candidates + segments)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(12)]
    words = Counter("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(150))
    df = spark.createDataFrame([(" ".join(w for w, n in words.items() for _ in range(n)),)], "text string")
    got = B.train_bpe(B.word_table(df), candidates=candidates, segments=segments, n_merges=60 if segments < 100 else 10_000)
    want = greedy_bpe(words, 60 if segments < 100 else 10_000)
    assert got == want and len(got) > 50


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_changes_of_a_merge_are_those_of_a_new_count(letters):
    rng = random.Random(len(letters))
    words = [[rng.randrange(len(letters)) for _ in range(rng.randrange(1, 12))] for _ in range(200)]
    freqs = [rng.randrange(1, 9) for _ in words]
    runs = B.SymbolRuns(np.concatenate(words), np.array([len(w) for w in words]), np.array(freqs))
    for whole, (left, right) in enumerate([(0, 0), (1, 0), (len(letters), 1), (0, 1), (len(letters) + 1, len(letters) + 1)], len(letters)):
        known = Counter(dict(zip(*[a.tolist() for a in runs.pairs()])))
        for code, d in zip(*runs.merge(left, right, whole, changes=True)):
            known[int(code)] += int(d)
        words = [_joined(w, left, right, whole) for w in words]
        want = Counter()
        for w, f in zip(words, freqs):
            for a, b in zip(w, w[1:]):
                want[(a << 32) | b] += f
        assert +known == +want == Counter(dict(zip(*[a.tolist() for a in runs.pairs()])))
    ids, lengths, kept = runs.words()
    assert ids.tolist() == [i for w in words if len(w) > 1 for i in w]
    assert list(zip(lengths, kept)) == [(len(w), f) for w, f in zip(words, freqs) if len(w) > 1]


def _joined(word, left, right, whole):
    out, i = [], 0
    while i < len(word):
        hit = word[i : i + 2] == [left, right]
        out.append(whole if hit else word[i])
        i += 1 + hit
    return out


def test_bpe_takes_many_merges_a_round(spark, monkeypatch):
    """Few of the words fit on the driver, and nearly all pairs share symbols."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5))) for _ in range(30)]
    words = Counter("".join(rng.choice(stems) for _ in range(rng.randrange(1, 6))) for _ in range(3000))
    df = spark.createDataFrame([(" ".join(w for w, n in words.items() for _ in range(n)),)], "text string")
    rounds, real = [], B.proven_steps
    monkeypatch.setattr(B, "proven_steps", lambda *args: rounds.append(1) or real(*args))
    assert B.train_bpe(B.word_table(df), 200, segments=500) == greedy_bpe(words, 200)
    assert len(rounds) <= 20


def test_encoder_pieces_hold_every_text(spark, monkeypatch):
    """Texts pass in pieces: nulls, empty texts and texts longer than a piece keep their places."""
    monkeypatch.setattr(B, "PIECE", 12)
    texts = ["low lower", None, "", "lowest low low low new", "x", " ", "new low", None]
    merges = [("l", "o"), ("lo", "w"), ("▁", "low"), ("e", "r")]
    vocab = ["▁low", "er", "▁", "n", "e", "w", "s", "t"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = dict(df.select("i", B.encoder(merges, vocab)("text")).collect())
    words = {"low": [1], "lower": [1, 2], "lowest": [1, 5, 7, 8], "new": [3, 4, 5, 6], "x": [3, 2], "": []}
    assert got == {i: None if t is None else [k for w in t.split(" ") for k in words[w]] for i, t in enumerate(texts)}


def test_slot_minima_at_the_borders_of_the_prime():
    """Sums that fold to 0, to the prime itself and to just below its double."""
    from lexiloom.operators import dedup as D

    rng = np.random.default_rng(4)
    edge = [0, 1, 2, D.PRIME // 2, D.PRIME - 2, D.PRIME - 1]
    a = np.array([1, 2, D.PRIME - 2, D.PRIME - 1, *rng.integers(1, D.PRIME, 40)])
    b = np.array([*rng.integers(0, D.PRIME, 40), 0, 1, D.PRIME - 2, D.PRIME - 1])
    for hashes in (*([h] for h in edge), edge, rng.integers(0, D.PRIME, 700).tolist()):
        want = [min((int(x) * int(h) + int(y)) % D.PRIME for h in hashes) for x, y in zip(a, b)]
        assert D.slot_minima(a, b, np.array(hashes, np.int64)).tolist() == want


def test_signatures_are_those_of_words_joined_by_spaces(spark):
    import hashlib

    from lexiloom.operators import dedup as D

    texts = ["één twee één twee één twee drie", None, "kort", "eins zwei drei vier fünf sechs", "a b c d e"]
    df = spark.createDataFrame([(i, t.split(" ") if t else None) for i, t in enumerate(texts)], "i int, w array<string>").coalesce(1)
    a, b = (v.tolist() for v in D.hash_family(20, 7))
    for i, sig in df.select("i", D.minhash(20, 7, 5)("w")).filter("i > 0 OR i = 0").collect():
        words = (texts[i] or "").split(" ")
        grams = {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
        hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") % D.PRIME for g in grams]
        assert sig == ([min((x * h + y) % D.PRIME for h in hashes) for x, y in zip(a, b)] if grams else None)


def test_stretches_join_where_their_surroundings_meet(spark):
    words = spark.createDataFrame([("xabcdefghijkabz", 3), ("abcab", 1)], "w string, freq long")
    wrap = F.concat(F.lit(B.OPEN), F.array_join(F.split("w", ""), B.CLOSE + B.OPEN), F.lit(B.CLOSE)).alias("symbols")
    found = sorted(("|".join(s), f) for s, f in B.pair_segments(words.select(wrap, "freq"), [("a", "b")], 10))
    assert found == [("a|b|c|a|b", 1), ("x|a|b|c|d|", 3), ("|j|k|a|b|z", 3)]
    assert B.pair_segments(words.select(wrap, "freq"), [("a", "b")], 2) is None
