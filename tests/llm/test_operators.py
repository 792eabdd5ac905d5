"""The operators against brute-force versions, planted rows and hand rows; edge cases included."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from draper.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, simhash, source_mix, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, hits string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(1, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passage, line = prose(70, rng), "a line that very many documents have in common"
    texts = [None, "", " \n\t ", "...", "one", "one", "é" * 250, "ab" * 300, prose(400, rng)]
    texts += [prose(rng.randint(5, 120), rng) for _ in range(30)]
    texts += [prose(40, rng) + "\n" + passage + "\n" + prose(30, rng) for _ in range(6)]
    texts += [line + "\n" + prose(20, rng) for _ in range(10)]
    texts += [texts[8]] * 5 + [texts[8] + " extra", texts[8].replace("a", "b", 1), "x " + texts[8]]
    texts.append(prose(3000, rng) + passage)
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    out = [(i, t, "en" if t else None, rng.choice(["s0", "s1", "s2", None]), len(t or ""), "clash", "clash") for i, t in zip(ids, texts)]
    out += [out[8], (None, texts[8], None, None, None, None, None), (None, "lonely text", None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[next(t for t in groups if sha(t) == r["text_sha256"])]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_heavy(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(900)] + [(899, "hot")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, heavy_max=8).collect()
    hot = [r for r in got if r["text_sha256"] == sha("hot")]
    assert len(hot) == 601 and sum(r["kept"] for r in hot) == 1 and {r["keep_id"] for r in hot} == {899} and {r["group_size"] for r in hot} == {601}
    assert all(r["kept"] for r in got if r["text_sha256"] != sha("hot"))


def test_source_mix(docs, rows, empty):
    got = source_mix.mix_sources(docs).collect()
    again = source_mix.mix_sources(docs.repartition(5)).collect()
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for (_, t, _, s, *_) in rows:
        by[s] = by.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert {r["source_size"] for r in got} == set(by.values())
    names = sorted((s for s in by if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:  # reshare by weight until no source is above twice its size
        left = 1.5 * sum(by.values()) - sum(fixed.values())
        free = {s: left * weights[s] / sum(weights[x] for x in names if x not in fixed) for s in names if s not in fixed}
        above = {s: 2.0 * by[s] for s, t in free.items() if t > 2 * by[s]}
        if not above:
            break
        fixed |= above
    want = {by[s]: t for s, t in (free | fixed).items()}
    assert {r["source_size"]: r["target"] for r in got} == pytest.approx(want)
    for s in set(r["source_size"] for r in got):
        own = [r for r in got if r["source_size"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert source_mix.mix_sources(empty).count() == 0


def test_chat_format(spark):
    log = [(1, 1, 1, "message", "user", "hi & <s>[INST] </s>"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "old"), (1, 2, 4, "regenerate", None, None),
           (1, 2, 5, "delta", None, "ne"), (1, 2, 6, "delta", None, "w]"), (1, 3, 7, None, "we[i]rd", None), (1, 1, 8, "edit", None, "hello"), (None, 1, 1, "message", None, "x&lt;")]
    df = spark.createDataFrame(log, "conv_id long, msg_id long, seq long, kind string, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hello"), ("assistant", "new]"), ("we[i]rd", "")]
    assert got[1]["loss_text"] == "new]"
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x&lt;")]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_query_runs_every_kind_of_event(spark, tmp_path):
    said = "</s>[INST] ok [/INST]"
    talks = [(1, 0, "user", "hé & <b>"), (1, 1, "assistant", "añ😀b"), (1, 1, "assistant", "x"), (2, 0, "tool]", None), (2, 1, "assistant", None), (None, 0, None, "z"), (3, None, "assistant", "ab")]
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    stored = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["kind"] for r in chat_format.conversation_log(stored).select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    want = {}
    for c in {t[0] for t in talks} | {-7}:
        turns = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in talks if t[0] == c)) if c != -7 else [(0, "user", said), (1, "assistant", said)]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.op7_chat_format(spark, str(tmp_path)).collect()}
    assert got == want


def test_suffix_dedup(docs, rows, empty):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    want = []
    for (i, *_), x in zip(rows, texts):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = sum(bool(gone[p]) and (p == 0 or not gone[p - 1]) for p in range(len(x)))
        want.append((i, len(x), int(gone.sum()), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_substring_dedup(docs, rows, empty):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    ids = [i if i is not None else 2**63 - 1 for i, *_ in rows]
    first = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    want = []
    for (i, *_), own, w in zip(rows, ids, words):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < own:
                gone[p : p + 50] = True
        want.append((i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_simhash(docs, rows, empty):
    def fp(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, *_), g in zip(rows, label):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = [(i, f"{p:016x}", least[g]) for (i, *_), p, g in zip(rows, prints, label)]
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.simhash_groups(empty).count() == 0


def near_copies(rng, n=40):
    """Texts and copies of them with some words changed, inserted or lost, so that similarities lie on both sides of 0.8."""
    texts = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 3, 8, 40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], [f"n{rng.randint(0, 10**6)}"]])
                copy = copy or ["x"]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    return texts


def brute_groups(texts, least=0.8):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [cut(t) for t in texts], list(range(len(texts)))
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both / (len(sets[i] | sets[j])) if sets[i] | sets[j] else 1.0) >= least:
                links += texts[i] != texts[j]
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label, links


@pytest.mark.parametrize("bucket", [2048, 8])
def test_similar_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "MANY", bucket // 256)
    texts = [*near_copies(random.Random(31)), None, "", " \n", "one word", "one  WORD", *["same again"] * 3]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["cls"]: r["component"] for r in simhash.similar_groups(df, bucket=bucket).collect()}
    cls = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").selectExpr("i", "xxhash64(coalesce(text, '')) c").orderBy("i").select("c").collect()]
    mine = [got.get(c, c) for c in cls]
    want, links = brute_groups(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j] and cls[i] != cls[j]]
    assert links > 30 and sum(mine[i] == mine[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert not [1 for i in range(len(texts)) for j in range(i) if mine[i] == mine[j] and want[i] != want[j]]
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_verified_forest_skips_what_is_not_similar():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint32).tobytes() for _ in range(60)]
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = map(np.array, zip(*[(i, j) for i in range(60) for j in range(i + 1, 60)]))
    left, right = simhash.verified_forest(fps, sets, a, b, 0.6)
    each = [len(set(np.frombuffer(sets[i], np.uint32).tolist()) & set(np.frombuffer(sets[j], np.uint32).tolist())) for i, j in zip(a.tolist(), b.tolist())]
    whole = [(len(sets[i]) + len(sets[j])) // 4 - n for i, j, n in zip(a.tolist(), b.tolist(), each)]
    assert simhash.similarities(sets, a, b, 7) == pytest.approx([n / u for n, u in zip(each, whole)])
    assert simhash.similarities([b"", b"", sets[0]], np.array([0, 0]), np.array([1, 2])).tolist() == [1.0, 0.0]
    plain = [set(np.frombuffer(x, np.uint32).tolist()) for x in sets]
    like = lambda i, j: len(plain[i] & plain[j]) / len(plain[i] | plain[j]) >= 0.6
    assert all(like(i, j) for i, j in zip(left, right))
    label = list(range(60))
    for i, j in zip(*map(np.ndarray.tolist, (a, b))):
        if like(i, j):
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    assert len(left) == 60 - len(set(label))


def test_gray_index_matches_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for c in centre]))
    group = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.index_links(group, fps, 4)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_large_buckets_lose_no_link(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)})
    df = spark.createDataFrame([(x,) for x in fps] + [(-1,)], "fp long")
    from draper.llm.common import Scratch
    from draper.llm.components import components

    scratch = Scratch(spark, "t")
    got = components(simhash.fingerprint_links(df, scratch, bucket=16), scratch).collect()
    assert {r["node"] for r in got} == set(fps) and {r["component"] for r in got} == {min(fps)}


def test_line_dedup(docs, rows, empty, spark):
    got = line_dedup.dedup_lines_of(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(rows)
    assert line_dedup.dedup_lines_of(empty).count() == 0
    a, b, c = "first line of some words here", "second line of some words", "third line that is different"
    df = spark.createDataFrame([(1, f"{a}\n\n{b}", "k"), (2, f"{c}\n{a}\n\n{b}\nshort", "k"), (3, c, "k"), (3, c, "k"), (4, None, "k"), (None, b, "k")], "doc_id long, text string, gone string")
    out = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines_of(df).collect()), key=key)
    assert out == sorted([(1, f"{a}\n\n{b}", 3, 0), (2, f"{c}\nshort", 5, 3), (3, "", 1, 1), (3, "", 1, 1), (4, None, 0, 0), (None, "", 1, 1)], key=key)


def test_decontaminate_long_insertion():
    rng = random.Random(21)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(204)]
    copy = words[:100] + [f"new{k}" for k in range(30)] + words[100:]
    around = [f"x{k}" for k in range(300)]
    text = " ".join(around[:150] + copy + around[150:] + words[:5])
    ((similarity, first, n),) = (d[1] for d in decontaminate.ItemIndex([(1, " ".join(words))]).search([text]))
    assert similarity == pytest.approx(196 / 234) and (first, n) == (150, 234)


def test_best_stretch():
    rng = random.Random(22)
    for _ in range(100):
        item = Counter(rng.randint(0, 9) for _ in range(12))
        row = [rng.randint(0, 14) for _ in range(25)]
        places = np.array([k for k, x in enumerate(row) if x in item], int)
        want = 0.0
        for a in places.tolist():
            for b in places[places >= a].tolist():
                both = sum((item & Counter(row[a : b + 1])).values())
                want = max(want, both / (12 + b + 1 - a - both))
        got = decontaminate.ItemIndex._best(places, np.array(row)[places], item, 12)[0]
        assert got == pytest.approx(want) or (want < decontaminate.SIMILARITY and got < decontaminate.SIMILARITY)


def test_decontaminate_recall():
    """Planted copies of every size against the weighted similarity by brute force: those of 0.8 or more are found, with that similarity or a better stretch's."""
    rng = random.Random(23)
    items = [(k, [f"w{rng.randint(0, 10**6)}" for _ in range(n)]) for k, n in enumerate([9, 12, 14, 18, 22, 25, 31, 40, 59, 80, 130, 200])]
    index = decontaminate.ItemIndex([(k, " ".join(w)) for k, w in items])
    counts = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    texts, want = [], []
    for k, w in items:
        for _ in range(40):
            copy = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [f"n{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 1, 1, 2]))]
            copy = copy[rng.randint(0, len(w) // 15) :]
            a, b = counts(w), counts(copy)
            similarity = sum((a & b).values()) / sum((a | b).values())
            if similarity >= decontaminate.SIMILARITY:
                around = [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 300))]
                cut = rng.randint(0, len(around))
                texts.append(" ".join(around[:cut] + copy + around[cut:]))
                want.append((k, similarity))
    found = index.search(texts)
    caught = sum(k in f and f[k][0] >= similarity - 1e-9 for f, (k, similarity) in zip(found, want))
    assert len(want) > 250 and caught >= 0.99 * len(want)
    assert all(set(f) <= {k} for f, (k, _) in zip(found, want))
    clean = [" ".join(f"x{rng.randint(0, 10**4)}" for _ in range(500)) for _ in range(50)]
    assert not any(index.search(clean))


def test_decontaminate_long_text_and_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 300)
    rng = random.Random(24)
    items = [(k, prose(30, rng)) for k in range(6)]
    long = " ".join(f"x{rng.randint(0, 10**5)}" for _ in range(3000))
    text = long + " " + items[2][1] + " " + long + " " + items[5][1]
    ((hits),) = decontaminate.ItemIndex(items).search([text])
    assert {k: v[1] for k, v in hits.items()} == {2: 3000, 5: 6000 + len(decontaminate.WORDS.findall(items[2][1]))}
    df = spark.createDataFrame([(1, items[0][1], "a"), (2, items[4][1] + " x " + items[1][1], "b"), (3, None, None)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    slices = list(decontaminate.benchmark_slices(bench, "item_id", "text", most=100))
    assert len(slices) > 3
    monkeypatch.setattr(decontaminate, "benchmark_slices", lambda *a: iter(slices))
    got = decontaminate.with_hits(df, bench)
    assert got.columns == ["doc_id", "text", "hits", "hits_"]
    assert {r["doc_id"]: sorted(h["item_id"] for h in r["hits_"]) for r in got.collect()} == {1: [0], 2: [1, 4], 3: []}


def test_edge_windows_settled_in_a_task():
    from draper.llm.repeats import cover, settle, thinned

    rng = np.random.default_rng(4)
    for ids in (False, True):
        name, text = rng.integers(0, 30, 200).astype(np.uint64), np.sort(rng.integers(0, 12, 200))
        own = text.astype(np.int64) // 2 if ids else None
        known, witness = settle(name, own)
        for i in range(200):
            same = [j for j in range(200) if name[j] == name[i]]
            assert known[i] == (any(own[j] < own[i] for j in same) if ids else len(same) > 1)
        assert all(witness[name == v].any() for v in set(name.tolist())) and (witness | known).all()
    for _ in range(50):
        place = np.sort(rng.choice(400, 60, replace=False))
        known, text = rng.random(60) < 0.6, np.zeros(60, int)
        kept = thinned(text, place, known, 20)
        assert not (kept & ~known).any() and (cover(place[kept], 20, 420) == cover(place[known], 20, 420)).all()


def deduped(spark, rows):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("rare", [1000, 2])
def test_line_dedup_finds_repeated_and_moved_lines(spark, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    line = "a line that its first document has twice"
    assert deduped(spark, [(1, f"{line}\nx\n{line}"), (2, f"y\n{line}\nw"), (3, f"z\n{line}\nv\n{line}")]) == {1: f"{line}\nx\n{line}", 2: "y\nw", 3: "z\nv"}
    rng = random.Random(9)
    lines = [f"line number {k} of a few dozen" for k in range(25)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        want[i] = "\n".join(x for x in t.split("\n") if x not in seen)
        seen |= {*t.split("\n")}
    assert deduped(spark, rows) == want


@pytest.mark.parametrize("rare", [1000, 2])
def test_line_dedup_finds_blocks_of_short_lines(spark, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    verse = "one short line\nand another"
    assert deduped(spark, [(1, f"a\n{verse}\nb"), (2, f"c\n{verse}"), (3, f"{verse}\nd"), (4, "and another")]) == {1: f"a\n{verse}\nb", 2: "c", 3: "d", 4: "and another"}
    rng = random.Random(12)
    vocab = ["", " ", "a", "bb", "ccc", "d" * 6, "e" * 9, "f" * 12, "g" * 19, "h" * 25]
    rows = [(i, "\n".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    want = {}
    for i, t in rows:  # blocks of 20 characters or more that any earlier document has anywhere
        a, gone = t.split("\n"), set()
        for _, u in rows[:i]:
            b = u.split("\n")
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if sum(len(z.strip(" ")) for z in a[x : x + n]) >= 20:
                        gone |= {*range(x, x + n)}
        want[i] = "\n".join(z for k, z in enumerate(a) if k not in gone)
    assert deduped(spark, rows) == want


def test_patience():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        m, left = line_dedup.patience(a, b)
        assert left == [i for i in range(len(a)) if a[i] in b and i not in {x for x, _ in m}]
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
        assert line_dedup.patience(a, a) == ([(i, i) for i in range(len(a))], [])


def test_alignment_decides_and_the_look_up_takes_what_it_leaves(spark, monkeypatch):
    lines = [f"line {k} of some twenty characters" for k in range(12)]
    moved = [lines[8], *lines[:8], *lines[9:]]
    rows = [(1, "\n".join(lines)), (2, "new\n" + "\n".join(lines[2:9])), (3, "\n".join(moved)), (4, "\n".join(["own", lines[3], lines[3]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_aligned"]) for r in line_dedup.dedup_lines_of(df).collect()}
    assert got == {1: (0, 0), 2: (7, 7), 3: (12, 11), 4: (2, 0)}
    whole = line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: ([], []))
    assert all(r["n_removed"] == 0 for r in line_dedup.dedup_lines_of(df).collect())  # nothing goes that no alignment has seen
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: (whole(a, b)[0], []))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines_of(df).collect()}
    assert got == {1: 0, 2: 7, 3: 11, 4: 0}


def test_decontaminate(docs, empty, spark):
    rng = random.Random(8)
    items = [(k, prose(n, rng)) for k, n in enumerate([3, 6, 13, 20, 33, 58, 90])]
    bench = spark.createDataFrame([*items, (7, None), (8, "")], "item_id long, text string")
    planted = [(100 + k, prose(50, rng) + " " + t.upper() + " " + prose(37, rng)) for k, t in items]
    w = items[5][1].split()
    w[30] = "changed"
    planted.append((200, prose(31, rng) + " " + " ".join(w) + " " + prose(9, rng)))
    df = spark.createDataFrame([*planted, (1, None), (2, ""), (3, prose(200, rng)), (None, "x")], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], h["item_id"]): h["similarity"] for r in decontaminate.with_hits(df, bench).collect() for h in r["hits"]}
    want = {(100 + k, k) for k, _ in items} | {(200, 5)}
    assert set(got) == want and all(got[100 + k, k] == 1.0 for k, _ in items) and 0.8 <= got[200, 5] < 1
    assert decontaminate.with_hits(empty, bench, hits="found").count() == 0
    assert all(not r["hits"] for r in decontaminate.with_hits(df, bench.limit(0)).collect())


def test_language(spark, empty):
    rng = random.Random(4)
    words = {"aa": "bacada", "ee": "wexyze"}
    make = lambda k: " ".join("".join(rng.choice(words[k]) for _ in range(5)) for _ in range(rng.randint(3, 60)))
    rows = [(i, make(k), k) for i in range(120) for k in ["aa" if i % 2 else "ee"]]
    more = [(500, None, "aa"), (501, "123 ...", "ee"), (502, "", None), (None, make("aa"), None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(df).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right) and got[None]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert language_id.identify_languages(empty).count() == 0
    assert {r["doc_id"] for r in language_id.keep_identified(df).collect()} == set(range(120)) | {None}


def test_language_stage_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, "éà", None), (4, None, None), (None, "x", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language_id.keep_identified(df).collect()} == {1, 3, None}


def test_training_rows_of_a_repeated_id(spark):
    rows = [(0, f"aaaa {k}", "aa") for k in range(700)] + [(0, "aaaa", "aa")] * 200 + [(k, f"zz {k}", "zz") for k in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = df.where(~language_id.held_out()).groupBy("lang").count().collect()
    assert {r["lang"] for r in kept} == {"aa", "zz"}
    langs, x = language_id.training_windows(df, "doc_id", "text", "lang", most=40)
    seen = Counter(langs)
    assert len(langs) == len(x) == 40 and seen["aa"] == 20 and seen["zz"] == 20
    assert language_id.shares({"a": 100, "b": 3, "c": 50}, 60) == {"a": 28, "b": 3, "c": 29}


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-0.35, -0.35, 1.0, 2.0]) for _ in range(rng.randint(1, 30))]
        got = toxicity.maximal_segments(np.array(s))

        def split(lo, hi):
            best = max(((sum(s[i : j + 1]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0,))
            if best[0] <= 1e-12:
                return []
            i, j = best[3], best[4]
            return split(lo, i) + [(i, j)] + split(j + 1, hi)

        assert [(a, b) for a, b, _ in got] == split(0, len(s))
        assert [v for *_, v in got] == pytest.approx([sum(s[i : j + 1]) for i, j in split(0, len(s))])


def test_segment_scores_fall_back_and_calibrate():
    odds = {"vile": 2.0, "^abcde": 1.0, "^abcd": -0.5}
    assert toxicity.token_scores("Vile abcdefg, abcdxy 12 other", odds) == pytest.approx(np.array([2.0, 1.0, -0.5, 0.0]) - toxicity.COST)
    values, share = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert toxicity.solve_lambda(values, share) == pytest.approx(np.log(3))
    best, total, many, n = toxicity.normalised(np.array([4.0, 0.1]), 50, {"lambda": 1.5, "k": 0.1})
    assert (best, n) == (pytest.approx(6 - np.log(6)), 1) and total == pytest.approx(best) and many == pytest.approx(np.log(2))


def test_toxicity(spark, empty):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(rng.randint(20, 80), rng).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), "vilewort")
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "vilewort vilewort vilewort")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    assert sum((got[i]["predicted"] == 1) == (i % 5 == 0) for i in range(600)) >= 595
    assert got[900]["predicted"] == 0 and got[900]["score"] == got[901]["score"] and got[None]["predicted"] == 1
    assert toxicity.score_toxicity(empty, lab.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(df, lab.limit(0)).collect()} == {0}


def test_toxicity_learns_from_one_row_of_an_id(spark):
    rng = random.Random(8)
    rows = [(i, prose(30, rng) + (" wicked vile" if i % 3 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    score = lambda df: {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, labels).collect()}
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.unionByName(spark.createDataFrame([rows[7]] * 300, "doc_id long, text string"))
    assert score(often.repartition(3)) == score(once)


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    a, b, c, d, e = (prose(60, rng) for _ in range(5))
    rows = [(5, a), (None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (7, e), (8, e), (9, a + " more")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.near_dedup(spark, df, "").collect()]
    assert sorted(got, key=key) == sorted([(5, a), (None, b), (None, c), (7, d), (7, e)], key=key)


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, prose(40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["_id", "_key", "_gone", "_node", "_nth", "_hits", "hits", "copy", "_copies", "n_removed"]
    rows = [(k, prose(30), "en", "s0", 7, *[f"{c}{k}" for c in extra]) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in cp.STAGES:
        out = str(tmp_path / name)
        stage(spark, df, str(tmp_path)).write.parquet(out)
        df = spark.read.parquet(out)
    assert df.columns == [*("doc_id text lang source n_chars".split()), *extra, "copy_"]
    assert df.count() and all(r[c] == f"{c}{r['doc_id']}" for r in df.collect() for c in extra)


def test_mix_stage_shares_copies_of_equal_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c", "en", "s0", 5)] * 5 + [(None, "d e", "en", "s0", 3), (None, "f g", "en", "s1", 3), (2, None, None, None, None), (2, "h", "fr", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter()
    for r in source_mix.mix_sources(df.withColumn("k", df["text"]), id_col="k").collect():
        taken[r["doc_id"]] += r["copies"]
    got = Counter(r["text"] for r in cp.mix(spark, df, "").collect())
    assert sum(got.values()) == sum(taken.values()) and got["a b c"] == taken["a b c"]
    assert sorted(r["copy"] for r in cp.mix(spark, df, "").where("doc_id = 1").collect()) == list(range(1, got["a b c"] + 1))


def test_pipeline(spark, rows, empty, tmp_path):
    import corpus_pipeline as cp

    bench = spark.createDataFrame([(1, prose(40))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, df in enumerate((spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars"))):
        for name, stage in cp.STAGES:
            out = str(tmp_path / f"{n}-{name}")
            stage(spark, df, str(tmp_path)).write.parquet(out)
            df = spark.read.parquet(out)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
        assert (df.count() > 0) == (n == 0)
